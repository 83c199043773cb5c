"""A futures-like interface over lazy DataFrames of calls."""

from __future__ import annotations

import pickle
import threading
import time
from collections.abc import Callable
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.binding import as_calls, bind, extended, signature
from weftline.operators import opaque
from weftline.sources import objects

ALWAYS, ANY_COMPLETED, ALL_COMPLETED = 0, -1, 100


class CallError(RuntimeError):
    """Raised for a failed call whose own exception could not be carried over."""


class Calls:
    """What a call returns to have further calls made: their results, in order, take its result's place."""

    def __init__(self, function: Callable, iterdata: Any, extra_args: Any = None):
        self.function, self.iterdata, self.extra_args = function, iterdata, extra_args


def _requests(value: Any) -> list[Calls]:
    """The further calls that a result asks for: one :class:`Calls`, or a list that begins with one."""
    if isinstance(value, Calls):
        return [value]
    return value if type(value) is list and value and isinstance(value[0], Calls) else []


class Handle:
    """The calls of one job: a lazy table of results, in call order."""

    def __init__(self, engine: Engine, frame: DataFrame, single: bool, silent: bool = False, total: int | None = None):
        self.engine, self.frame, self.single, self.silent, self.read, self.total = engine, frame, single, silent, False, total
        self._got: list = []
        self._changed = threading.Condition()
        self._thread: threading.Thread | None = None
        self._ended, self._error, self._nested = False, None, {}

    def map(self, function: Callable, **options: Any) -> Handle:
        """Feed each result to ``function``; a tuple fans out to its parameters.  These calls then give no result of their own."""
        self.silent = True
        return self.engine._added(opaque.apply(opaque.rebound(self.frame, function), function, **options), single=False)

    def reduce(self, function: Callable, extra: tuple = (), key: str | None = None) -> Handle:
        """Call ``function`` with the list of results, or once for each value of the column ``key``."""
        self.silent = True
        return self.engine._added(opaque.reduce(self.frame, function, key=key, extra=extra), single=key is None)

    def map_reduce(self, map_function: Callable, reduce_function: Callable, extra: tuple = ()) -> Handle:
        return self.map(map_function).reduce(reduce_function, extra)

    def start(self) -> Handle:
        """Begin to evaluate the calls; their rows come in by and by."""
        if self._thread is None:
            self._thread = InheritableThread(target=self._fetch, daemon=True)
            self._thread.start()
        return self

    def _fetch(self) -> None:
        try:
            for row in self.frame.toLocalIterator(prefetchPartitions=True):
                with self._changed:
                    self._got.append(row)
                    self._changed.notify_all()
        except Exception as e:
            self._error = e
        with self._changed:
            self._ended = True
            self._changed.notify_all()

    def await_rows(self, enough: Callable[[int, int | None, bool], bool], deadline: float | None = None) -> None:
        """Wait until ``enough`` (calls done, calls in all if known, all ended) holds."""
        self.start()
        with self._changed:
            while not enough(len(self._got), self.total, self._ended) and not self._ended:
                left = None if deadline is None else deadline - time.monotonic()
                if left is not None and left <= 0:
                    raise TimeoutError("the calls were not done in time")
                self._changed.wait(left)
        if self._error:
            raise self._error

    def rows(self) -> list:
        """All rows, by call."""
        self.await_rows(lambda done, total, ended: ended)
        return sorted(self._got, key=lambda r: r["call_id"])

    @property
    def done(self) -> bool:
        return self._ended

    def cancel(self) -> None:
        raise NotImplementedError("calls that were submitted cannot be cancelled")

    def cancelled(self) -> bool:
        raise NotImplementedError("calls that were submitted cannot be cancelled")

    def results(self, throw_except: bool = True) -> list:
        """The calls' results; with retries, a call that failed to the last raises in any case."""
        out = []
        for row in self.rows():
            if row["exc_type"]:
                if throw_except or row["attempts"] > 1:
                    raise pickle.loads(row["exc"]) if row["exc"] else CallError(f"{row['exc_type']}: {row['exc_message']}")
                out.append(None)
            elif not row["is_none"]:
                value = pickle.loads(row["value"])
                asked = _requests(value)
                out += self._spliced(row["call_id"], asked, throw_except) if asked else [value]
        return out

    def _spliced(self, call_id: int, asked: list[Calls], throw_except: bool) -> list:
        if call_id not in self._nested:
            self._nested[call_id] = [self.engine._run(c.function, as_calls(c.iterdata), c.extra_args, 1, None, None, single=False, add=False).start() for c in asked]
        return [x for handle in self._nested[call_id] for x in handle.results(throw_except)]

    def save(self, path: str) -> None:
        """Write the results, to be opened again by :meth:`Engine.open`."""
        self.frame.write.parquet(path)


class Engine:
    """Runs Python functions over lists of inputs on a session, and gives results in call order.

    Without a session the calls are made one by one in the present process: what a call itself may use.
    ``storage`` is what functions get that declare a parameter of that name.
    """

    def __init__(self, spark: SparkSession | None = None, retries: int = 0, storage: Any = None):
        self.spark, self.retries, self.storage, self.handles = spark, retries, storage, []

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *error: object) -> None:
        self.handles.clear()

    def _added(self, frame: DataFrame, single: bool, total: int | None = None, add: bool = True) -> Handle:
        handle = Handle(self, frame, single, total=total)
        if add:
            self.handles.append(handle)
        return handle

    def call_async(self, function: Callable, data: Any, extra_env: dict | None = None, retries: int | None = None, timeout: float | None = None, hooks: tuple = (None, None)) -> Handle:
        return self._run(function, [data], None, 1, extra_env, retries, single=True, timeout=timeout, hooks=hooks)

    def map(
        self, function: Callable, iterdata: Any, chunksize: int = 1, extra_args: Any = None, extra_env: dict | None = None, retries: int | None = None,
        timeout: float | None = None, hooks: tuple = (None, None), obj_chunk_size: int | None = None, obj_chunk_number: int | None = None, obj_newline: str | None = "\n",
    ) -> Handle:
        """A call for each element; for a function with a parameter ``obj``, a call for each chunk of the objects that the elements name."""
        taken = signature(function).parameters.get("obj")
        if taken is not None and taken.kind is not taken.POSITIONAL_ONLY:
            calls = objects.object_calls(self.spark, as_calls(iterdata), obj_chunk_number, obj_chunk_size, obj_newline, extra_args or {})
            options = self._options(extra_env, retries, timeout, hooks)
            return self._added(opaque.apply(calls, function, keep=["uri", "part"], **options), single=False)
        return self._run(function, as_calls(iterdata), extra_args, chunksize, extra_env, retries, single=False, timeout=timeout, hooks=hooks)

    def map_reduce(
        self, map_function: Callable, iterdata: Any, reduce_function: Callable, extra_args: Any = None, extra_args_reduce: tuple = (), chunksize: int = 1,
        obj_reduce_by_key: bool = False, spawn_reducer: int = 20, **options: Any,
    ) -> Handle:
        """``reduce_function`` gets the list of results, or with ``obj_reduce_by_key`` a list for each object.

        ``spawn_reducer``, the share of done calls at which a reducer may start, has no effect on a result: Spark
        starts a stage when its inputs are there.
        """
        mapped = self.map(map_function, iterdata, chunksize, extra_args, **options)
        return mapped.reduce(reduce_function, extra_args_reduce, key="uri" if obj_reduce_by_key else None)

    def _options(self, extra_env: dict | None, retries: int | None, timeout: float | None, hooks: tuple) -> dict:
        return {"retries": self.retries if retries is None else retries, "extra_env": extra_env, "timeout": timeout, "hooks": hooks, "storage": self.storage}

    def _run(self, function, elements, extra, chunksize, extra_env, retries, single, timeout=None, hooks=(None, None), add=True) -> Handle:
        if not callable(function):
            raise ValueError("a function or an object with __call__ is needed")
        bound = [bind(function, extended(e, extra)) for e in elements]
        if self.spark is None:
            rows = [(i, *opaque.attempt(function, b, i, self.retries if retries is None else retries, extra_env, hooks, self.storage)) for i, b in enumerate(bound)]
            return self._local(rows, single, add)
        frame = opaque.apply(opaque.inputs(self.spark, bound, chunksize), function, **self._options(extra_env, retries, timeout, hooks))
        return self._added(frame, single, len(bound), add)

    def _local(self, rows: list[tuple], single: bool, add: bool) -> Handle:
        handle = self._added(None, single, len(rows), add)
        names = [x.split()[0] for x in opaque.RESULT.split(", ")]
        handle._got, handle._ended, handle._thread = [dict(zip(names, r, strict=True)) for r in rows], True, threading.current_thread()
        return handle

    def open(self, path: str, single: bool = False) -> Handle:
        """The saved results of a handle of this or another session."""
        return self._added(self.spark.read.parquet(path), single)

    def wait(self, handles: list[Handle] | None = None, return_when: int = ALL_COMPLETED, timeout: float | None = None) -> tuple[list, list]:
        return wait(handles or self.handles, return_when, timeout)

    def get_result(self, handles: list[Handle] | None = None, throw_except: bool = True, timeout: float | None = None) -> Any:
        """Results not read before, in order; None results are left out; a lone call's result comes bare."""
        return get_result(handles or [h for h in self.handles if not h.read], throw_except, timeout)


def percent_done(done: int, total: int, wanted: int) -> bool:
    """Whether the rounded-down percentage of completed calls has been reached."""
    return total == 0 or done * 100 // total >= wanted


def wait(handles: list[Handle], return_when: int = ALL_COMPLETED, timeout: float | None = None) -> tuple[list, list]:
    """(done, not done) of the calls of handles, of any engines: rows of results, and (handle, call id) of the others.

    ALWAYS starts the calls and returns at once; ANY_COMPLETED waits for one of each handle; a percentage for as many of each
    handle's calls.  A handle whose number of calls is not known before, such as a chain's, is waited for to its end.
    """
    deadline = None if timeout is None else time.monotonic() + timeout

    def enough(done: int, total: int | None, ended: bool) -> bool:
        if return_when == ALWAYS or ended:
            return True
        if return_when == ANY_COMPLETED:
            return done > 0
        return total is not None and return_when < ALL_COMPLETED and percent_done(done, total, return_when)

    for handle in handles:
        handle.start()
    for handle in handles:
        handle.await_rows(enough, deadline)
    done = [r for h in handles for r in sorted(list(h._got), key=lambda r: r["call_id"])]
    missing = [(h, i) for h in handles if h.total is not None for i in sorted({*range(h.total)} - {r["call_id"] for r in list(h._got)})]
    return done, missing


def get_result(handles: list[Handle], throw_except: bool = True, timeout: float | None = None) -> Any:
    """The results of handles of any engines, in order; a lone call's result comes bare."""
    chosen = [h for h in handles if not h.silent]
    wait(chosen, ALL_COMPLETED, timeout)
    out = []
    for h in chosen:
        h.read = True
        out += h.results(throw_except)
    return out[0] if len(out) == 1 and chosen[-1].single else out


def union(handles: dict[str, Handle]) -> DataFrame:
    """The result rows of handles with a column ``source``: whose they are."""
    frames = [h.frame.withColumn("source", F.lit(name)) for name, h in handles.items()]
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out
