"""The Python lane's fan-out: results, failures and how the work is dealt."""

from __future__ import annotations

import pytest

from weftline import catalog
from weftline.functions.binding import bind, signature
from weftline.operators import opaque


def test_fanout_is_one_pass_dealt_to_all_cores(spark, small):
    """One small file holds all calls; their further calls must not run in the one task that reads it, nor pass Python five times."""
    frame = catalog.queries()["fanout_py"](spark, small)
    assert frame._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert frame.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_fanned_calls_equal_the_pickled_ones(spark):
    rows = [(1, 3), (2, 0), (3, None), (4, 2), (5, 7), (6, -1)]
    df = spark.createDataFrame(rows, "k long, n int").coalesce(1)

    def ask(n):
        return None if n == -1 else [(x, n) for x in range(n)]

    def answer(x, n, id):
        if x == 1:
            raise KeyError(f"{n}")
        return 100 * n + 10 * x + id

    fast = opaque.fanned(df, "k", {"n": "n"}, ask, answer, "long", retries=1, held=4)
    asked = opaque.fan_out(opaque.apply(opaque.calls_of(df, "k", {"n": "n"}), ask), answer, held=4)
    slow = opaque.typed(opaque.apply(asked, answer, retries=1, keep=["parent_id"]), "long")
    same = [sorted(map(tuple, x.select("parent_id", "call_id", "result", "attempts", "exc_type", "exc_message").collect()), key=str) for x in (fast, slow)]
    assert same[0] == same[1] and len(same[0]) == 12
    assert {r for r in same[0] if r[1] == 1} == {(p, 1, None, 2, "KeyError", f"'{n}'") for p, n in ((1, 3), (4, 2), (5, 7))}
    assert all(r[2] == 100 * {1: 3, 4: 2, 5: 7}[r[0]] + 11 * r[1] for r in same[0] if r[1] != 1)


def test_calls_that_nothing_asks_for(spark):
    df = spark.createDataFrame([], "k long, n int")
    assert opaque.fanned(df, "k", {"n": "n"}, lambda n: [n], lambda x: x, "long").count() == 0


@pytest.mark.parametrize("function", [lambda a, b: 0, lambda a, b=1: 0, lambda id, a, storage, b=2: 0, lambda a, /, b=3: 0, lambda a, *more, k=1: 0, lambda **named: 0, lambda: 0])
@pytest.mark.parametrize("element", [1, None, [1], (), (1,), (1, 2), (1, 2, 3), (None, ())])
def test_binding_by_place_equals_the_signature(function, element):
    whole = signature(function)
    own = whole.replace(parameters=[p for p in whole.parameters.values() if p.name not in ("id", "storage")])
    try:
        wanted = dict(own.bind(*(element if isinstance(element, tuple) else (element,))).arguments)
    except TypeError:
        with pytest.raises(TypeError):
            bind(function, element)
    else:
        assert bind(function, element) == wanted
