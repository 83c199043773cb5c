"""Calls over chunks of stored objects, against plain slices of the files."""

from __future__ import annotations

import sys
import threading
from functools import partial
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark import cloudpickle

from weftline.engine import Engine
from weftline.sources import objects

BODIES = {
    "words.txt": b"".join(b"word%d line of text\n" % i for i in range(400)),
    "no_end.txt": b"one\ntwo\n\nthree",
    "long.txt": b"x" * 3000 + b"\nshort\n",
    "multi.txt": ("é" * 30 + "\n").encode() * 9,
    "one.txt": b"1",
    "even.txt": b"abcd\n" * 20,
    "empty.txt": b"",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("objects")
    for name, body in BODIES.items():
        (root / name).write_bytes(body)
    (root / "below").mkdir()
    (root / "below" / "deep.txt").write_bytes(b"deep\nlines\n")
    return root


def plain_chunks(body: bytes, size: int, separator: bytes) -> list[bytes]:
    """The lines whose first byte lies in each chunk."""
    out, at = [b""] * -(-len(body) // size), 0
    while at < len(body):
        found = body.find(separator, at)
        end = len(body) if found < 0 else found + len(separator)
        out[at // size] += body[at:end]
        at = end
    return out


read = lambda obj, mark=None: (obj.key.rpartition("/")[2], obj.part, obj.total_parts, obj.data_stream.read(), mark)  # noqa: E731  goes to the workers by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.mark.parametrize("size", [7, 100, 1000])
def test_chunks_own_whole_lines(spark, folder, size):
    engine = Engine(spark)
    engine.map(read, str(folder), obj_chunk_size=size, extra_args={"mark": 9})
    got = {}
    for name, part, total, body, mark in engine.get_result():
        got.setdefault(name, []).append((part, total, body))
        assert mark == 9
    wanted = {n: plain_chunks(b, size, b"\n") for n, b in BODIES.items() if b}
    assert got == {n: [(i + 1, len(c), x) for i, x in enumerate(c)] for n, c in wanted.items()}


def test_chunk_numbers_separators_bytes_and_whole_objects(spark, folder):
    engine = Engine(spark)
    engine.map(read, f"{folder}/words.txt", obj_chunk_number=3, obj_chunk_size=5)  # the number counts
    body = BODIES["words.txt"]
    assert [r[3] for r in engine.get_result()] == plain_chunks(body, -(-len(body) // 3), b"\n")
    engine.map(read, f"{folder}/words.txt", obj_chunk_size=1000, obj_newline="line ")
    assert [r[3] for r in engine.get_result()] == plain_chunks(body, 1000, b"line ")
    engine.map(read, f"{folder}/words.txt", obj_chunk_size=1000, obj_newline=None)
    assert [r[3] for r in engine.get_result()] == [body[i : i + 1000] for i in range(0, len(body), 1000)]
    engine.map(lambda obj: (obj.data_byte_range, list(obj.data_stream)[-1], obj.data_stream.tell()), [f"{folder}/no_end.txt", f"{folder}/one.txt"])
    assert engine.get_result() == [(None, b"three", 14), (None, b"1", 1)]


def test_prefixes_globs_and_folders(spark, folder):
    names = lambda sources: sorted(r["uri"].rpartition("/")[2] for r in objects.listing(spark, sources).collect())
    top = sorted(n for n, b in BODIES.items() if b)
    assert names([str(folder)]) == top
    assert names([f"{folder}/"]) == sorted([*top, "deep.txt"])
    assert names([f"{folder}/*/d*.txt"]) == ["deep.txt"]
    assert names([f"{folder}/o*.txt", f"{folder}/one.txt"]) == ["one.txt"]
    with pytest.raises(ValueError):
        Engine(spark).map(read, f"{folder}/*.none")
    with pytest.raises(ValueError):
        objects.kind_of(["http://x/y", "/z"])


def test_reduce_by_object_or_over_all(spark, folder):
    count = lambda obj: len(obj.data_stream.read().split())
    engine = Engine(spark)
    engine.map_reduce(count, str(folder), sum, obj_chunk_size=64)
    assert engine.get_result() == sum(len(b.split()) for b in BODIES.values())
    engine.map_reduce(count, str(folder), sum, obj_chunk_size=64, obj_reduce_by_key=True)
    assert sorted(engine.get_result()) == sorted(len(b.split()) for b in BODIES.values() if b)


class Handler(BaseHTTPRequestHandler):
    ranges = True

    def do_HEAD(self):
        self._answer(send=False)

    def do_GET(self):
        self._answer(send=True)

    def _answer(self, send):
        body, asked = BODIES[self.path.strip("/")], self.headers.get("Range")
        partial_ = asked and self.ranges
        if partial_:
            first, last = asked.removeprefix("bytes=").split("-")
            body = body[int(first) : int(last) + 1]
        self.send_response(206 if partial_ else 200)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        if send:
            self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.mark.parametrize("ranges", [True, False])
def test_web_addresses(spark, ranges):
    server = ThreadingHTTPServer(("127.0.0.1", 0), type("Own", (Handler,), {"ranges": ranges}))
    threading.Thread(target=partial(server.serve_forever, 0.1), daemon=True).start()
    urls = [f"http://127.0.0.1:{server.server_port}/{n}" for n, b in BODIES.items() if b]
    engine = Engine(spark)
    try:
        for separator in ("\n", "line "):
            engine.map(lambda obj: (obj.url.rpartition("/")[2], obj.data_stream.read()), urls, obj_chunk_size=500, obj_newline=separator)
            got = {}
            for name, body in engine.get_result():
                got.setdefault(name, []).append(body)
            assert got == {n: plain_chunks(b, 500, separator.encode()) for n, b in BODIES.items() if b}
    finally:
        server.shutdown()
