"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHITESPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared checkpoint folder.

    Only a local session may go without ``spark.checkpoint.dir``; it then gets a temporary one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="weftline-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/weftline/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs meanwhile are deleted when it has ended."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends here."""
    spark = df.sparkSession
    path = workspace(spark, name)
    with shuffles_go(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of :func:`stored` tables that nothing reads any more."""
    for frame in frames:
        if path := getattr(frame, "stored_at", None):
            spark = frame.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fold(doc_id: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(modulus)


def fresh(name: str, columns: Iterable[str]) -> str:
    """``name`` behind as many underscores as none of ``columns`` has; case does not count."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def plain_text(name: str = "text") -> Column:
    """The text column with null read as the empty text."""
    return F.coalesce(F.col(quoted(name)), F.lit(""))


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def by_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str, most: str = "2m") -> DataFrame:
    """``df.mapInArrow`` over batches of at most ``most`` bytes or one row, unless the session sets that limit itself.

    Spark's own limits are 10,000 rows and 64 MB.  An executor holds a batch of each of its tasks several times over: while it
    is built, as a message and in the task's Python process, which gives it back when the task ends.  The limit stays
    set, as the result may be computed later.
    """
    conf = df.sparkSession.conf
    if _BATCH_BYTES not in conf.getAll:
        conf.set(_BATCH_BYTES, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches cut to at most ``rows`` rows, so that Python objects for one slice stay few."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null reads as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    """``batch`` with the column ``name`` replaced or appended."""
    names = list(batch.schema.names)
    columns = list(batch.columns)
    if name in names:
        columns[names.index(name)] = values
    else:
        names.append(name)
        columns.append(values)
    return pa.RecordBatch.from_arrays(columns, names=names)
