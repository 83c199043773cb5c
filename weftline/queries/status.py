"""Statistics of calls, shared state and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import stats
from weftline.queries.registry import query, table
from weftline.session import shared_folder
from weftline.streaming import state


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as calls: the flag is the job, the number the memory, the quantity the run time."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("job"), F.col("l_linenumber").alias("memory"), F.col("l_quantity").alias("runtime"))


@query("""SELECT l_returnflag AS job, count(*) AS calls, CAST(sum(l_linenumber) AS BIGINT) AS memory, avg(l_quantity) AS runtime
FROM lineitem GROUP BY ROLLUP (l_returnflag)""")
def job_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.job_summary(_calls(spark, sf_dir), "job", "memory", "runtime").drop("cost")


@query("SELECT l_returnflag AS job, round(sum(l_quantity * l_linenumber / 1024) * 0.000017, 8) AS cost FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def job_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.job_summary(_calls(spark, sf_dir), "job", "memory", "runtime").select("job", F.round("cost", 8).alias("cost"))


@query("SELECT event_id, epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events) AS since_start FROM events")
def timeline_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Microseconds since the first call; the least value comes from an aggregate of one row."""
    events = table(spark, sf_dir, "events").select("event_id", F.expr("unix_micros(cast(ts as timestamp))").alias("us"))
    first = events.agg(F.min("us").alias("first"))
    return events.join(F.broadcast(first)).select("event_id", (F.col("us") - F.col("first")).alias("since_start"))


@query("""WITH calls AS (SELECT event_id, epoch_us(ts) AS submitted, epoch_us(ts) + 1000 * (event_id % 7) AS started, epoch_us(ts) + 1000 * (event_id % 7) + 1000000 * CAST(floor(abs(value)) AS BIGINT) AS ended FROM events)
SELECT event_id, milestone, moment - (SELECT min(submitted) FROM calls) AS since FROM (UNPIVOT calls ON submitted, started, ended INTO NAME milestone VALUE moment)""")
def timeline_milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each call was submitted, started and ended, since the first was submitted."""
    us = "unix_micros(cast(ts as timestamp))"
    calls = table(spark, sf_dir, "events").selectExpr("event_id", f"{us} AS submitted", f"{us} + 1000 * (event_id % 7) AS started", f"{us} + 1000 * (event_id % 7) + 1000000 * cast(floor(abs(value)) as bigint) AS ended")
    return stats.timeline(calls, "event_id", {x: x for x in ("submitted", "started", "ended")}, "submitted")


@query("SELECT event_id FROM events WHERE event_type = 'error' AND epoch_us(ts) + 3605000000 < (SELECT max(epoch_us(ts)) FROM events)")
def overdue_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls without a result whose limit of an hour has passed when the last call is submitted."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", F.expr("unix_micros(cast(ts as timestamp))").alias("us"))
    now = events.agg(F.max("us").alias("now"))  # one row
    return stats.overdue(events.join(F.broadcast(now)), "us", F.col("event_type") != "error", F.col("now"), 3600).select("event_id")


@query("""SELECT 'e/' || user_id AS job, count(*) FILTER (WHERE event_type = 'error') AS running, count(*) FILTER (WHERE event_type <> 'error') AS done FROM events GROUP BY user_id""")
def job_status_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running and done calls of each job, from a listing of the keys that they left."""
    kinds = F.when(F.col("event_type") == "error", F.array(F.lit("init"))).otherwise(F.array(F.lit("init"), F.lit("status")))
    each = table(spark, sf_dir, "events").select("user_id", "event_id", F.explode(kinds).alias("kind"))
    keys = each.select(F.concat_ws("/", F.lit("e"), "user_id", "event_id", "kind").alias("key"))
    return stats.job_status(keys, "key")


@query("SELECT event_type, CAST(time_bucket(INTERVAL 1 HOUR, ts) AS TIMESTAMP) AS hour, count(*) AS n FROM events GROUP BY 1, 2")
def stream_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour, counted by a stream that reads all that is there and then ends."""
    folder = shared_folder(spark, "stream")
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    hours = events.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select("event_type", F.col("w.start").alias("hour"), "n")
    state.drain_to(hours, f"{folder}/out", f"{folder}/checkpoint")
    done = spark.read.option("recursiveFileLookup", "true").schema(hours.schema).parquet(f"{folder}/out").withColumn("batch", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    last = done.agg(F.max("batch").alias("last"))
    return done.join(F.broadcast(last), F.col("batch") == F.col("last")).select("event_type", "hour", "n")


@query("""WITH calls AS (SELECT epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 + CAST(floor(value) AS BIGINT) * 60 AS e FROM events WHERE value >= 1),
bins AS (SELECT unnest(generate_series((SELECT (min(s) + 3599) // 3600 * 3600 FROM calls), (SELECT (max(e) + 3599) // 3600 * 3600 - 3600 FROM calls), 3600)) AS bin)
SELECT bin, count(s) AS active FROM bins LEFT JOIN calls ON s <= bin AND bin < e GROUP BY bin""")
def active_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that run at each full hour."""
    calls = table(spark, sf_dir, "events").filter("value >= 1").selectExpr("event_id", "unix_micros(cast(ts as timestamp)) div 1000000 AS s", "unix_micros(cast(ts as timestamp)) div 1000000 + cast(floor(value) as bigint) * 60 AS e")
    return stats.active_calls(calls, "s", "e", 3600)


@query("SELECT user_id AS counter, CAST(sum(event_id) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY user_id")
def shared_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.counters(table(spark, sf_dir, "events").withColumnRenamed("user_id", "counter"), "counter", "event_id")


@query("SELECT user_id, max_by(value, event_id) AS value FROM events GROUP BY user_id")
def dict_last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.last_writes(table(spark, sf_dir, "events"), "user_id", "value", "event_id")


@query("""SELECT pos, round(sum(x), 4) AS total FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY pos""")
def param_server(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient vectors summed position by position."""
    each = table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("pos", "x"))
    return each.groupBy(F.col("pos").cast("long").alias("pos")).agg(F.round(F.sum(F.col("x").cast("double")), 4).alias("total"))


@query("SELECT event_id, props ->> '$.k' AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("""SELECT user_id, CAST(sum(CASE WHEN last IS NULL OR ts - last >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) AS BIGINT) AS sessions
FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS last FROM events) GROUP BY user_id""")
def session_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    sessions = events.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return sessions.groupBy("user_id").agg(F.count("*").alias("sessions"))
