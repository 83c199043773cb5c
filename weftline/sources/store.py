"""Objects below a root of a file system: on the driver by Hadoop's, in functions by a handle that can be pickled."""

from __future__ import annotations

import io
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.globs import glob_to_regex


class NoSuchKey(KeyError):
    """The object is not there."""


@dataclass(frozen=True)
class CloudObject:
    """Where an object without a name of its own is."""

    root: str
    bucket: str
    key: str


class Storage:
    """What can be done with objects ``root/bucket/key`` on top of reading, writing, listing and deleting them."""

    root: str

    def _write(self, bucket: str, key: str, body: bytes) -> None:
        raise NotImplementedError

    def _read(self, bucket: str, key: str, first: int = 0, length: int | None = None) -> bytes:
        raise NotImplementedError

    def _size(self, bucket: str, key: str) -> int | None:
        """Bytes of an object, None if there is none."""
        raise NotImplementedError

    def _sizes(self, bucket: str, prefix: str) -> Iterator[tuple[str, int]]:
        raise NotImplementedError

    def _delete(self, bucket: str, key: str) -> None:
        raise NotImplementedError

    def _folder(self, bucket: str, make: bool) -> bool:
        """Whether the bucket is there, which ``make`` sees to."""
        raise NotImplementedError

    def put_object(self, bucket: str, key: str, body: Any) -> None:
        """``body``: bytes, text, or a file opened for reading."""
        body = body.read() if hasattr(body, "read") else body
        self._write(bucket, key, body.encode() if isinstance(body, str) else bytes(body))

    def get_object(self, bucket: str, key: str, byte_range: tuple[int, int] | None = None, stream: bool = False) -> Any:
        """The object's bytes, or a stream of them; a range includes both ends, and only its bytes are read."""
        if self._size(bucket, key) is None:
            raise NoSuchKey(key)
        body = self._read(bucket, key) if byte_range is None else self._read(bucket, key, byte_range[0], byte_range[1] - byte_range[0] + 1)
        return io.BytesIO(body) if stream else body

    def head_object(self, bucket: str, key: str) -> dict[str, str]:
        size = self._size(bucket, key)
        if size is None:
            raise NoSuchKey(key)
        return {"content-length": str(size)}

    def create_bucket(self, bucket: str) -> None:
        self._folder(bucket, make=True)

    def head_bucket(self, bucket: str) -> dict:
        if not self._folder(bucket, make=False):
            raise NoSuchKey(bucket)
        return {}

    def list_objects(self, bucket: str, prefix: str = "", match_pattern: str | None = None) -> list[dict]:
        import re

        matches = re.compile(glob_to_regex(match_pattern)).match if match_pattern else lambda key: True
        return [{"Key": key, "Size": size} for key, size in sorted(self._sizes(bucket, prefix)) if matches(key)]

    def list_keys(self, bucket: str, prefix: str = "") -> list[str]:
        return [key for key, _ in sorted(self._sizes(bucket, prefix))]

    def delete_object(self, bucket: str, key: str) -> None:
        self._delete(bucket, key)

    def delete_objects(self, bucket: str, keys: list[str]) -> None:
        for key in keys:
            self._delete(bucket, key)

    def upload_file(self, name: str, bucket: str, key: str | None = None) -> None:
        with open(name, "rb") as file:
            self.put_object(bucket, key or os.path.basename(name), file)

    def download_file(self, bucket: str, key: str, name: str | None = None) -> None:
        name = name or os.path.basename(key)
        os.makedirs(os.path.dirname(name) or ".", exist_ok=True)
        with open(name, "wb") as file:
            file.write(self.get_object(bucket, key))

    # ---- objects without a name of their own ---------------------------------------------------

    def put_cloudobject(self, body: Any, bucket: str = "tmp", key: str | None = None) -> CloudObject:
        key = key or f"cloudobjects/{uuid.uuid4().hex}"
        self.put_object(bucket, key, body)
        return CloudObject(self.root, bucket, key)

    def _own(self, cloudobject: CloudObject) -> CloudObject:
        if cloudobject.root != self.root:
            raise ValueError(f"the object is in another storage: {cloudobject.root}")
        return cloudobject

    def get_cloudobject(self, cloudobject: CloudObject, stream: bool = False) -> Any:
        own = self._own(cloudobject)
        return self.get_object(own.bucket, own.key, stream=stream)

    def delete_cloudobject(self, cloudobject: CloudObject) -> None:
        own = self._own(cloudobject)
        self._delete(own.bucket, own.key)

    def delete_cloudobjects(self, cloudobjects: list[CloudObject]) -> None:
        for x in cloudobjects:
            self.delete_cloudobject(x)

    def clean(self, bucket: str = "tmp", prefix: str = "cloudobjects/") -> None:
        """Delete what :meth:`put_cloudobject` left under names that it gave."""
        self.delete_objects(bucket, self.list_keys(bucket, prefix))

    # ---- files and folders ------------------------------------------------------------------------

    def open(self, bucket: str, name: str, mode: str = "r") -> io.IOBase:
        """A file in memory: read whole when it is opened, or written when it is closed."""
        text = "b" not in mode
        if mode.strip("bt") == "r":
            raw = io.BytesIO(self.get_object(bucket, name))
            return io.TextIOWrapper(raw, "utf-8") if text else raw
        if mode.strip("bt") != "w":
            raise ValueError(f"mode {mode}: an object is read or written whole")
        raw = _Written(self, bucket, name)
        return io.TextIOWrapper(raw, "utf-8") if text else raw

    def isfile(self, bucket: str, path: str) -> bool:
        return self._size(bucket, path.strip("/")) is not None

    def isdir(self, bucket: str, path: str) -> bool:
        return next(iter(self._sizes(bucket, path.strip("/") + "/")), None) is not None

    def exists(self, bucket: str, path: str) -> bool:
        return self.isfile(bucket, path) or self.isdir(bucket, path)

    def listdir(self, bucket: str, path: str = "") -> list[str]:
        """The names right below a folder."""
        at = path.strip("/") + "/" if path.strip("/") else ""
        return sorted({key[len(at) :].split("/", 1)[0] for key, _ in self._sizes(bucket, at)})

    def remove(self, bucket: str, path: str) -> None:
        self._delete(bucket, path.strip("/"))

    def mkdir(self, bucket: str, path: str) -> None:
        """Folders are there as soon as there are objects in them."""

    makedirs = mkdir


class _Written(io.BytesIO):
    def __init__(self, storage: Storage, bucket: str, key: str):
        super().__init__()
        self.target = storage, bucket, key

    def close(self) -> None:
        if not self.closed:
            storage, bucket, key = self.target
            storage.put_object(bucket, key, self.getvalue())
        super().close()


class TaskStore(Storage):
    """Objects on a file system that pyarrow reaches; it can be pickled, and functions get it as ``storage``."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def _at(self, bucket: str, key: str = "") -> tuple[pyarrow.fs.FileSystem, str]:
        fs, path = pyarrow.fs.FileSystem.from_uri(self.root)
        return fs, f"{path}/{bucket}/{key}".rstrip("/")

    def _write(self, bucket: str, key: str, body: bytes) -> None:
        fs, path = self._at(bucket, key)
        fs.create_dir(os.path.dirname(path), recursive=True)
        with fs.open_output_stream(path) as out:
            out.write(body)

    def _read(self, bucket: str, key: str, first: int = 0, length: int | None = None) -> bytes:
        fs, path = self._at(bucket, key)
        with fs.open_input_file(path) as file:
            file.seek(min(first, file.size()))
            return file.read(length)

    def _size(self, bucket: str, key: str) -> int | None:
        fs, path = self._at(bucket, key)
        info = fs.get_file_info(path)
        return info.size if info.type == pyarrow.fs.FileType.File else None

    def _sizes(self, bucket: str, prefix: str) -> Iterator[tuple[str, int]]:
        fs, path = self._at(bucket)
        found = fs.get_file_info(pyarrow.fs.FileSelector(path, allow_not_found=True, recursive=True))
        each = ((x.path[len(path) + 1 :], x.size) for x in found if x.type == pyarrow.fs.FileType.File and not x.base_name.endswith(".crc"))
        return ((key, size) for key, size in each if key.startswith(prefix))

    def _delete(self, bucket: str, key: str) -> None:
        fs, path = self._at(bucket, key)
        if self._size(bucket, key) is not None:
            fs.delete_file(path)

    def _folder(self, bucket: str, make: bool) -> bool:
        fs, path = self._at(bucket)
        if make:
            fs.create_dir(path, recursive=True)
        return fs.get_file_info(path).type == pyarrow.fs.FileType.Directory


class Store(Storage):
    """Objects on any Hadoop file system, for the driver."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self._jvm = spark, root.rstrip("/"), spark._jvm

    def for_tasks(self) -> TaskStore:
        """The same objects for functions; the root must be a path or URL that pyarrow knows as well."""
        return TaskStore(self.root)

    def _path(self, bucket: str, key: str = ""):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{bucket}/{key}".rstrip("/"))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _write(self, bucket: str, key: str, body: bytes) -> None:
        path, fs = self._path(bucket, key)
        out = fs.create(path, True)
        try:
            out.write(bytearray(body))
        finally:
            out.close()

    def _read(self, bucket: str, key: str, first: int = 0, length: int | None = None) -> bytes:
        path, fs = self._path(bucket, key)
        stream = fs.open(path)
        try:
            left = max(0, fs.getFileStatus(path).getLen() - first)
            stream.seek(first if left else 0)
            io_utils = self._jvm.org.apache.commons.io.IOUtils
            return bytes(io_utils.toByteArray(stream, left if length is None else min(left, length)))
        finally:
            stream.close()

    def _size(self, bucket: str, key: str) -> int | None:
        path, fs = self._path(bucket, key)
        return fs.getFileStatus(path).getLen() if fs.exists(path) and not fs.getFileStatus(path).isDirectory() else None

    def listing(self, bucket: str, prefix: str = "", pattern: str | None = None) -> DataFrame:
        """(key, size) of the objects whose key starts with ``prefix`` and matches the glob, empty ones included.

        The driver lists one after another; :func:`weftline.sources.objects.listing` has Spark list many, but leaves out
        empty ones, as Spark's file sources do.
        """
        frame = self.spark.createDataFrame(list(self._sizes(bucket, prefix)), "key string, size long")
        return frame.filter(F.col("key").rlike(glob_to_regex(pattern))) if pattern else frame

    def _sizes(self, bucket: str, prefix: str) -> Iterator[tuple[str, int]]:
        path, fs = self._path(bucket)
        if fs.exists(path):
            base, files = len(fs.getFileStatus(path).getPath().toString()) + 1, fs.listFiles(path, True)
            while files.hasNext():
                status = files.next()
                key = status.getPath().toString()[base:]
                if key.startswith(prefix) and not key.endswith(".crc"):
                    yield key, status.getLen()

    def _delete(self, bucket: str, key: str) -> None:
        path, fs = self._path(bucket, key)
        fs.delete(path, False)

    def _folder(self, bucket: str, make: bool) -> bool:
        path, fs = self._path(bucket)
        return fs.mkdirs(path) if make else fs.exists(path)
