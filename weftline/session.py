"""Sessions with the settings that the library expects."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``settings`` use underscores for dots."""
    builder = SparkSession.builder.appName("weftline").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for name, value in settings.items():
        builder = builder.config(name.replace("_", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder below ``spark.checkpoint.dir``, which all executors share; a local session may go without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="weftline-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/weftline/{name}-{uuid.uuid4().hex}"
