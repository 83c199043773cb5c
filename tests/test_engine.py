"""The futures-like interface, argument binding, failures and the pool."""

from __future__ import annotations

import io
import os
import time

import pytest

from weftline.engine import ALL_COMPLETED, ALWAYS, ANY_COMPLETED, Calls, Engine, get_result, percent_done, union, wait
from weftline.functions.binding import as_calls, bind, extended
from weftline.functions.globs import glob_to_regex
from weftline.functions.paths import split_url
from weftline.operators import opaque
from weftline.pool import Pool, cpu_count
from weftline.sources.store import NoSuchKey, Store, TaskStore


def test_results_keep_the_order_and_are_read_once(spark):
    engine = Engine(spark)
    engine.map(lambda x: x * 2, [3, 1, 2])
    assert engine.get_result() == [6, 2, 4]
    engine.call_async(lambda x: x + 7, 1)
    assert engine.get_result() == 8


def test_none_results_are_left_out_but_reducers_see_them(spark):
    odd = lambda x: x if x % 2 else None
    engine = Engine(spark)
    engine.map(odd, range(5))
    assert engine.get_result() == [1, 3]
    engine.map_reduce(odd, range(5), lambda results: len(results))
    assert engine.get_result() == 5


def test_chains_fan_tuples_out(spark):
    engine = Engine(spark)
    engine.map(lambda x: (x, x + 1), [1, 2]).map(lambda a, b: a * b)
    assert engine.get_result() == [2, 6]


def test_failures(spark):
    def fails(x):
        if x == 1:
            raise KeyError("one")
        return x

    engine = Engine(spark)
    engine.map(fails, [0, 1, 2])
    with pytest.raises(KeyError):
        engine.get_result()
    engine = Engine(spark)
    engine.map(fails, [0, 1, 2])
    assert engine.get_result(throw_except=False) == [0, None, 2]


def test_injected_id_environment_and_extra_arguments(spark):
    engine = Engine(spark)
    engine.map(lambda x, y, id: (x, y, id, os.environ["MARK"]), [5, 6], extra_args=(9,), extra_env={"MARK": True})
    assert engine.get_result() == [(5, 9, 0, "True"), (6, 9, 1, "True")]


def test_time_limits_and_silent_ends(spark):
    calls = opaque.inputs(spark, [{"x": i} for i in range(3)])

    def waits(x):
        if x == 1:
            time.sleep(60)
        if x == 2:
            os._exit(3)
        return x

    rows = {r["call_id"]: r["exc_type"] for r in opaque.apply(calls, waits, timeout=8).collect()}
    assert rows == {0: None, 1: "TimeoutError", 2: "MemoryError"}


@pytest.mark.parametrize(("done", "total", "wanted", "reached"), [(1, 3, 33, True), (1, 3, 34, False), (0, 0, 100, True), (3, 3, ALL_COMPLETED, True)])
def test_quorums_round_down(done, total, wanted, reached):
    assert percent_done(done, total, wanted) is reached


def test_binding():
    assert as_calls((1, 2)) == [(1, 2)] and as_calls(range(2)) == [0, 1] and as_calls("ab") == ["ab"]
    assert extended(1, (2,)) == (1, 2) and extended({"a": 1}, {"b": 2}) == {"a": 1, "b": 2}
    assert bind(lambda a, b: 0, (1, 2)) == {"a": 1, "b": 2}
    assert bind(lambda a: 0, [1, 2]) == {"a": [1, 2]}
    with pytest.raises(ValueError):
        bind(lambda a, b=1: 0, {"a": 1})


def test_globs_and_urls():
    import re

    assert re.match(glob_to_regex("a/*/c"), "a/b/c") and not re.match(glob_to_regex("a/*"), "a/b/c")
    assert re.match(glob_to_regex("**/c"), "a/b/c")
    with pytest.raises(ValueError):
        glob_to_regex("a**")
    assert split_url("s3://b/p/q/o") == ("aws_s3", "b", "p/q", "o")
    assert split_url("file://b/p/") == ("file", "b", "p", "")


def test_pool(spark):
    with Pool(spark) as pool:
        assert pool.map(abs, [-1, 2]) == [1, 2]
        assert pool.starmap(lambda a, b: a + b, [(1, 2), (3, 4)]) == [3, 7]
        assert pool.apply(lambda a, k: a + k, (1,), {"k": 2}) == 3
    with pytest.raises(ValueError):
        pool.map(abs, [1])


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.put_object("b", "foo/x", "0123456789")
    store.put_object("b", "foo_bar/y", b"")
    assert store.list_keys("b", "foo") == ["foo/x", "foo_bar/y"] and store.list_keys("b", "foo/") == ["foo/x"]
    assert store.get_object("b", "foo/x", (2, 4)) == b"234"
    assert store.head_object("b", "foo_bar/y") == {"content-length": "0"}
    store.delete_objects("b", ["foo/x"])
    with pytest.raises(NoSuchKey):
        store.get_object("b", "foo/x")


def test_built_in_functions_and_starred_ones(spark):
    engine = Engine(spark)
    engine.map(abs, [-1, 2])
    assert engine.get_result() == [1, 2]
    engine.map(len, ["ab", "", "abc"])
    assert engine.get_result() == [2, 0, 3]
    engine.map(lambda a, b=1, *more, **named: (a, b, more, named), [(1,), (1, 2, 3), {"a": 5, "z": 6}])
    assert engine.get_result() == [(1, 1, (), {}), (1, 2, (3,), {}), (5, 1, (), {"z": 6})]


def test_further_calls_take_their_callers_place(spark):
    engine = Engine(spark)
    engine.call_async(lambda n: Calls(lambda x: x + 1, range(n)), 3)
    assert engine.get_result() == [1, 2, 3]
    engine.call_async(lambda n: [Calls(lambda x: x + 1, range(n)), Calls(lambda x: x + 1, range(n))], 3)
    assert engine.get_result() == [1, 2, 3, 1, 2, 3]
    engine.call_async(lambda x: Calls(lambda y: y + 1, x + 5), 3)
    assert engine.get_result() == 9
    engine.map(lambda n: Engine().map(lambda x: x, range(n)).results(), range(1, 5))  # in the call's own process
    assert engine.get_result() == [list(range(i)) for i in range(1, 5)]


def test_retried_calls_raise_in_the_end_and_time_limits_hold(spark):
    def fails(x):
        raise KeyError(x)

    engine = Engine(spark, retries=1)
    engine.call_async(fails, 1)
    with pytest.raises(KeyError):
        engine.get_result(throw_except=False)
    engine = Engine(spark)
    engine.call_async(lambda x: time.sleep(60), 1, timeout=5)
    with pytest.raises(TimeoutError):
        engine.get_result()


def test_hooks_run_around_calls(spark):
    def before():
        os.environ["HOOKED"] = "yes"

    def after():
        os.environ.pop("HOOKED")

    engine = Engine(spark)
    engine.map(lambda x: os.environ.get("HOOKED"), [1, 2], hooks=(before, after))
    assert engine.get_result() == ["yes", "yes"]


def test_partial_completion(spark):
    def slow(x):
        time.sleep(0 if x < 2 else 6)
        return x

    engine = Engine(spark)
    handle = engine.map(slow, range(4))
    assert len(wait([handle], ALWAYS)[0]) <= 2
    done, missing = wait([handle], ANY_COMPLETED)
    assert 1 <= len(done) and [i for _, i in missing] == sorted({*range(4)} - {r["call_id"] for r in done})
    assert len(engine.wait(return_when=50)[0]) >= 2
    with pytest.raises(TimeoutError):
        wait([engine.map(slow, [3])], timeout=0.5)
    assert engine.wait([handle]) == (handle.rows(), [])


def test_handles_of_several_engines_and_saved_ones(spark, tmp_path):
    one, two = Engine(spark).map(lambda x: x + 1, [1, 2]), Engine(spark).map(lambda x: x * 10, [3])
    assert get_result([one, two]) == [2, 3, 30]
    assert {(r["source"], r["call_id"]) for r in union({"one": one, "two": two}).collect()} == {("one", 0), ("one", 1), ("two", 0)}
    one.save(str(tmp_path / "saved"))
    assert Engine(spark).open(str(tmp_path / "saved")).results() == [2, 3]
    with pytest.raises(NotImplementedError):
        one.cancel()


def test_functions_get_the_storage(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    engine = Engine(spark, storage=store.for_tasks())
    engine.map_reduce(lambda x, storage: storage.put_cloudobject(f"body {x}"), [1, 2], lambda results: results)
    kept = engine.get_result()
    assert [store.get_cloudobject(x) for x in kept] == [b"body 1", b"body 2"]
    engine.call_async(lambda x, storage: b"".join(storage.get_cloudobject(c) for c in x), kept)
    assert engine.get_result() == b"body 1body 2"
    with pytest.raises(ValueError):
        TaskStore("/elsewhere").get_cloudobject(kept[0])
    store.clean()
    assert store.list_keys("tmp") == []


@pytest.mark.parametrize("kind", [Store, TaskStore])
def test_storage(spark, tmp_path, kind):
    store = Store(spark, str(tmp_path)) if kind is Store else TaskStore(str(tmp_path))
    with pytest.raises(NoSuchKey):
        store.head_bucket("b")
    store.create_bucket("b")
    assert store.head_bucket("b") == {}
    for key in ("foo/baz", "foo/bar/baz", "foo_bar/baz", "foo_baz", "bar", "bar_baz"):
        store.put_object("b", key, key)
    assert [len(store.list_keys("b", p)) for p in ("foo", "foo/", "bar", "absent")] == [4, 2, 2, 0]
    assert all(x["Size"] == len(x["Key"]) for x in store.list_objects("b"))
    assert [x["Key"] for x in store.list_objects("b", match_pattern="foo/*")] == ["foo/baz"]
    store.put_object("b", "digits", io.BytesIO(b"0123456789"))
    assert store.get_object("b", "digits", (1, 4)) == b"1234" and store.get_object("b", "digits", (8, 20)) == b"89"
    assert store.get_object("b", "digits", stream=True).readline() == b"0123456789"
    with store.open("b", "notes/a.txt", "w") as file:
        file.write("one\ntwo é\n")
    assert list(store.open("b", "notes/a.txt")) == ["one\n", "two é\n"]
    assert store.isfile("b", "notes/a.txt") and store.isdir("b", "notes") and not store.exists("b", "note")
    assert store.listdir("b", "foo") == ["bar", "baz"]
    store.download_file("b", "digits", str(tmp_path / "local" / "d"))
    store.upload_file(str(tmp_path / "local" / "d"), "b", "again")
    assert store.get_object("b", "again") == b"0123456789"
    store.delete_objects("b", ["again", "digits"])
    with pytest.raises(NoSuchKey):
        store.get_object("b", "digits")


def test_pool_results_come_in_order_and_can_be_waited_for(spark):
    with Pool(spark, processes=2) as pool:
        assert list(pool.imap(lambda x: x * x, range(5))) == [0, 1, 4, 9, 16]
        late = pool.apply_async(lambda: time.sleep(5))
        with pytest.raises(TimeoutError):
            late.get(timeout=0.5)
        late.wait()
        assert late.ready() and late.successful() and cpu_count(spark) == 8
