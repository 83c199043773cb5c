"""Shared counters and dictionaries, fed by streams instead of locks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def counters(events: DataFrame, key: str, amount: str) -> DataFrame:
    """(key, total, n): the running sum of each counter, batch or streaming."""
    return events.groupBy(key).agg(F.sum(amount).alias("total"), F.count("*").alias("n"))


def last_writes(events: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value): the value with the greatest order of each key."""
    return events.groupBy(key).agg(F.max_by(value, order).alias(value))


def drain(frame: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Run a stream over all that is available now into the in-memory table ``name``."""
    query = frame.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def drain_to(frame: DataFrame, path: str, checkpoint: str, output_mode: str = "complete") -> StreamingQuery:
    """Run a stream over all that is available now; each batch's rows go to a folder of their own below ``path``, the last one's being the result."""
    query = frame.writeStream.outputMode(output_mode).foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(f"{path}/{batch:09d}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


class Queue:
    """Rows that producers put and one consumer gets, each once and in batches; they lie in a shared folder, so that nothing is lost or dropped."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def put(self, rows: DataFrame) -> None:
        rows.select(*self.spark.createDataFrame([], self.schema).columns).write.mode("append").parquet(f"{self.folder}/rows")

    def consume(self, task: Callable[[DataFrame, int], None]) -> None:
        """Hand all rows that were put since the last call to ``task``, batch by batch; a batch that failed comes again with its number."""
        waiting = self.spark.readStream.schema(self.schema).parquet(f"{self.folder}/rows")
        waiting.writeStream.foreachBatch(task).option("checkpointLocation", f"{self.folder}/taken").trigger(availableNow=True).start().awaitTermination()
