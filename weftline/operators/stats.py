"""Statistics over call status relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRICE = 0.000017


def job_summary(calls: DataFrame, job: str, memory: str, runtime: str) -> DataFrame:
    """Calls, memory, mean run time and cost of each job, and of all under a null job."""
    cost = F.sum(F.col(runtime) * F.col(memory) / 1024) * PRICE
    return calls.rollup(job).agg(F.count("*").alias("calls"), F.sum(memory).alias("memory"), F.avg(runtime).alias("runtime"), cost.alias("cost"))


def active_calls(calls: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """(bin, active): calls with start <= bin < end at each multiple of ``width`` from the first to the last that a call could cover.

    Each call adds one at its first bin and takes one away behind its last; a running sum over the
    bins replaces the join of bins with intervals.  Its window has a row for each bin, not for each call.
    """
    first, behind = ((F.ceil(F.col(c) / width) * width).cast("long") for c in (start, end))
    both = F.array(F.struct(first.alias("bin"), F.lit(1).alias("d")), F.struct(behind.alias("bin"), F.lit(-1).alias("d")))
    changes = calls.select(F.explode(both).alias("e")).groupBy("e.bin").agg(F.sum("e.d").alias("d"))
    w = Window.orderBy("bin")
    runs = changes.select("bin", F.lead("bin").over(w).alias("until"), F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("active")).filter("until is not null")
    return runs.select(F.explode(F.sequence(F.col("bin"), F.col("until") - width, F.lit(width).cast("long"))).alias("bin"), "active")


def timeline(calls: DataFrame, call_id: str, milestones: dict[str, str], origin: str) -> DataFrame:
    """(call id, milestone, since): the milestones of each call, since the least value of the column ``origin``."""
    first = calls.agg(F.min(origin).alias("_first"))  # one row
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("milestone"), F.col(column).alias("at")) for name, column in milestones.items()])).alias("m")
    return calls.select(call_id, each).join(F.broadcast(first)).select(call_id, "m.milestone", (F.col("m.at") - F.col("_first")).alias("since"))


def overdue(calls: DataFrame, start: str, done: Column, now: Column, timeout: float, slack: float = 5) -> DataFrame:
    """The calls that are not done though their time limit passed more than ``slack`` seconds ago; ``start`` and ``now`` in microseconds."""
    return calls.filter(~done & (now > F.col(start) + F.lit(int((timeout + slack) * 1_000_000))))


def job_status(listing: DataFrame, key: str) -> DataFrame:
    """(job, running, done) from keys ``executor/job/call/kind``: calls with an ``init`` key but no ``status`` key run, those with one are done."""
    parts = F.split(key, "/")
    calls = listing.select(F.concat_ws("/", parts[0], parts[1]).alias("job"), parts[2].alias("call"), parts[3].alias("kind"))
    each = calls.groupBy("job", "call").agg(F.bool_or(F.col("kind") == "status").alias("ended"))
    return each.groupBy("job").agg(F.count_if(~F.col("ended")).alias("running"), F.count_if("ended").alias("done"))


def export(statistics: DataFrame, path: str) -> None:
    """Statistics as lines of JSON."""
    statistics.write.json(path)
