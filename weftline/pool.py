"""A process-pool interface over the engine."""

from __future__ import annotations

import pickle
import time
from collections.abc import Callable, Iterable, Iterator
from typing import Any

from pyspark.sql import SparkSession

from weftline.engine import CallError, Engine, Handle


class AsyncResult:
    """A result to come; the callbacks run when it is fetched."""

    def __init__(self, handle: Handle, one: bool, callback: Callable | None = None, error_callback: Callable | None = None):
        self.handle, self.one, self.callback, self.error_callback = handle.start(), one, callback, error_callback

    def get(self, timeout: float | None = None) -> Any:
        try:
            self.wait(timeout)
            values = [value_of(row) for row in self.handle.rows()]
        except Exception as e:
            if self.error_callback:
                self.error_callback(e)
            raise
        out = values[0] if self.one else values
        if self.callback:
            self.callback(out)
        return out

    def ready(self) -> bool:
        return self.handle.done

    def wait(self, timeout: float | None = None) -> None:
        """Wait for all calls; TimeoutError if they take longer."""
        self.handle.await_rows(lambda done, total, ended: ended, None if timeout is None else time.monotonic() + timeout)

    def successful(self) -> bool:
        if not self.ready():
            raise ValueError("the calls are not done")
        return all(r["exc_type"] is None for r in self.handle.rows())


def value_of(row: Any) -> Any:
    """A call's result, None included; a failed call raises its exception."""
    if row["exc_type"]:
        raise pickle.loads(row["exc"]) if row["exc"] else CallError(f"{row['exc_type']}: {row['exc_message']}")
    return pickle.loads(row["value"])


def cpu_count(spark: SparkSession) -> int:
    """How many calls run at a time."""
    return spark.sparkContext.defaultParallelism


def _with_initializer(function: Callable, initializer: Callable | None, initargs: tuple) -> Callable:
    """The initializer runs before every call."""
    if initializer is None:
        return lambda args, kwargs: function(*args, **kwargs)

    def call(args: tuple, kwargs: dict) -> Any:
        initializer(*initargs)
        return function(*args, **kwargs)

    return call


class Pool:
    """``map``, ``starmap``, ``apply`` and their asynchronous forms."""

    def __init__(self, spark: SparkSession, processes: int | None = None, initializer: Callable | None = None, initargs: tuple = ()):
        self.engine, self.processes, self.open = Engine(spark), processes or spark.sparkContext.defaultParallelism, True
        self.initializer, self.initargs = initializer, initargs

    def __enter__(self) -> Pool:
        return self

    def __exit__(self, *error: object) -> None:
        self.terminate()

    def close(self) -> None:
        self.open = False

    terminate = close

    def join(self) -> None:
        if self.open:
            raise ValueError("the pool is still running")

    def _start(self, function: Callable, calls: list[tuple[tuple, dict]], one: bool, callback=None, error_callback=None) -> AsyncResult:
        if not self.open:
            raise ValueError("the pool is not running")
        handle = self.engine.map(_with_initializer(function, self.initializer, self.initargs), calls, chunksize=-(-len(calls) // self.processes) or 1)
        return AsyncResult(handle, one, callback, error_callback)

    def apply_async(self, function: Callable, args: tuple = (), kwds: dict | None = None, callback=None, error_callback=None) -> AsyncResult:
        return self._start(function, [(args, kwds or {})], True, callback, error_callback)

    def map_async(self, function: Callable, iterable: Iterable, chunksize: int | None = None, callback=None, error_callback=None) -> AsyncResult:
        return self._start(function, [((x,), {}) for x in iterable], False, callback, error_callback)

    def starmap_async(self, function: Callable, iterable: Iterable, chunksize: int | None = None, callback=None, error_callback=None) -> AsyncResult:
        return self._start(function, [(tuple(x), {}) for x in iterable], False, callback, error_callback)

    def apply(self, function: Callable, args: tuple = (), kwds: dict | None = None) -> Any:
        return self.apply_async(function, args, kwds).get()

    def map(self, function: Callable, iterable: Iterable, chunksize: int | None = None) -> list:
        return self.map_async(function, iterable).get()

    def starmap(self, function: Callable, iterable: Iterable, chunksize: int | None = None) -> list:
        return self.starmap_async(function, iterable).get()

    def imap(self, function: Callable, iterable: Iterable, chunksize: int | None = None) -> Iterator:
        """Results in order, each as soon as it is there."""
        handle = self.map_async(function, iterable).handle
        for at in range(handle.total):
            handle.await_rows(lambda done, total, ended, at=at: ended or done > at)
            if at >= len(handle._got):
                raise CallError("a call gave no result")
            yield value_of(handle._got[at])  # partitions hold ascending calls and come in order

    imap_unordered = imap
