"""Mapping, reducing, chaining, quorums and retries as column expressions, and the same by Python functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import opaque
from weftline.operators.ordered import dense_ids
from weftline.queries.registry import query, table


@query("SELECT r_regionkey, r_regionkey + 7 AS result FROM region WHERE r_regionkey = 0")
def call_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").filter("r_regionkey = 0").selectExpr("r_regionkey", "r_regionkey + 7 AS result")


@query("SELECT l_orderkey, l_linenumber, l_quantity + 7 AS result FROM lineitem")
def map_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") + 7).alias("result"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice + l_quantity AS result FROM lineitem")
def map_pair_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") + F.col("l_quantity")).alias("result"))


@query("SELECT l_orderkey, l_linenumber, l_quantity + 10 + 3 AS result FROM lineitem")
def map_extra_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = (10, 3)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") + extra[0] + extra[1]).alias("result"))


@query("SELECT n_name, CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS BIGINT) AS call_id FROM nation")
def map_with_call_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_ids(table(spark, sf_dir, "nation"), "n_nationkey").select("n_name", "call_id")


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) * 2, 4) AS result FROM embeddings")
def map_list_arg(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(total * 2, 4).alias("result"))


@query("SELECT event_id, value * 2 AS result FROM events WHERE event_type <> 'error'")
def map_none_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls without a result are left out."""
    result = F.when(F.col("event_type") != "error", F.col("value") * 2)
    return table(spark, sf_dir, "events").select("event_id", result.alias("result")).filter("result IS NOT NULL")


@query("SELECT event_type, count(*) AS n_calls, count(CASE WHEN event_type <> 'error' THEN value END) AS n_results FROM events GROUP BY event_type")
def reduce_sees_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reducer gets the missing results too."""
    result = F.when(F.col("event_type") != "error", F.col("value"))
    return table(spark, sf_dir, "events").select("event_type", result.alias("r")).groupBy("event_type").agg(F.count("*").alias("n_calls"), F.count("r").alias("n_results"))


@query("SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS result FROM orders")
def map_reduce_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("result"))


@query("SELECT source, count(*) AS n_objects, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes FROM documents GROUP BY source")
def reduce_by_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n_objects"), F.sum(F.octet_length("text")).alias("n_bytes"))


@query("SELECT conv_id, count(*) AS n_turns, md5(string_agg(text, '|' ORDER BY turn, text)) AS joined_md5 FROM conversations GROUP BY conv_id")
def reduce_ordered_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results of each reducer in call order; the joined text is one value by definition."""
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "|")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.md5(ordered).alias("joined_md5"))


@query("SELECT o_orderkey, (o_orderkey + 1) * (o_custkey + 2) - 3 AS result FROM orders")
def chain_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "orders").select("o_orderkey", F.struct((F.col("o_orderkey") + 1).alias("a"), (F.col("o_custkey") + 2).alias("b")).alias("r"))
    two = one.select("o_orderkey", (F.col("r.a") * F.col("r.b")).alias("r"))
    return two.select("o_orderkey", (F.col("r") - 3).alias("result"))


@query("SELECT p_partkey, unnest(range(CAST(p_size AS BIGINT))) AS call_id FROM part")
def fanout_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call that asks for p_size further calls."""
    return table(spark, sf_dir, "part").filter("p_size > 0").selectExpr("p_partkey", "explode(sequence(0L, p_size - 1L)) AS call_id")


@query("SELECT 'customer' AS engine, c_custkey AS id, c_acctbal + 1 AS result FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal + 1 FROM supplier")
def union_engines(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "customer").select(F.lit("customer").alias("engine"), F.col("c_custkey").alias("id"), (F.col("c_acctbal") + 1).alias("result"))
    two = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("engine"), F.col("s_suppkey").alias("id"), (F.col("s_acctbal") + 1).alias("result"))
    return one.unionByName(two)


@query("SELECT user_id, count(*) FILTER (WHERE event_type <> 'error') * 100 // count(*) AS percent, count(*) FILTER (WHERE event_type <> 'error') * 100 // count(*) >= 75 AS reached FROM events GROUP BY user_id")
def quorum_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the rounded-down share of completed calls reaches the percentage asked for."""
    percent = F.expr("count_if(event_type <> 'error') * 100 div count(*)")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(percent.alias("percent")).withColumn("reached", F.col("percent") >= 75)


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'P') AS pending, count(*) FILTER (WHERE o_orderstatus = 'O') AS running, count(*) FILTER (WHERE o_orderstatus = 'F') AS done FROM orders GROUP BY o_orderpriority")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [F.count_if(F.col("o_orderstatus") == s).alias(n) for s, n in (("P", "pending"), ("O", "running"), ("F", "done"))]
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(*counts)


@query("SELECT user_id, min(event_id) AS call_id, min_by(value, event_id) AS value FROM events WHERE event_type = 'error' GROUP BY user_id")
def first_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The failed call with the lowest number is the one whose exception is raised."""
    failed = table(spark, sf_dir, "events").filter("event_type = 'error'")
    return failed.groupBy("user_id").agg(F.min("event_id").alias("call_id"), F.min_by("value", "event_id").alias("value"))


@query("""SELECT e.event_id, coalesce(CASE WHEN e.event_type <> 'error' THEN e.value END, r.value * 10) AS result
FROM events e LEFT JOIN (SELECT event_id, value FROM events WHERE event_type = 'error' AND event_id % 2 = 0) r USING (event_id)""")
def retry_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of a first run, the failed ones patched from a second run over their ids."""
    events = table(spark, sf_dir, "events")
    first = events.select("event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("first"))
    second = events.filter("event_type = 'error' AND event_id % 2 = 0").select("event_id", (F.col("value") * 10).alias("second"))
    return first.join(second, "event_id", "left").select("event_id", F.coalesce("first", "second").alias("result"))


@query("SELECT event_id, least(event_id % 4, 2) + 1 AS attempts, event_id % 4 <= 2 AS success FROM events")
def attempt_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call that fails ``event_id % 4`` times, with two retries."""
    failures = F.col("event_id") % 4
    return table(spark, sf_dir, "events").select("event_id", (F.least(failures, F.lit(2)) + 1).alias("attempts"), (failures <= 2).alias("success"))


@query("SELECT o_orderkey // 100 AS batch, count(*) AS n_calls, min(o_orderkey) AS first_call FROM orders GROUP BY 1")
def batch_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.expr("o_orderkey div 100").alias("batch")).agg(F.count("*").alias("n_calls"), F.min("o_orderkey").alias("first_call"))


@query("""SELECT s.s_nationkey AS nation, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity
FROM lineitem JOIN supplier s ON l_suppkey = s_suppkey GROUP BY s.s_nationkey""")
def broadcast_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that share one table of arguments; Spark broadcasts it while it is below its threshold."""
    shared = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation"))
    calls = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").cast("long").alias("q"))
    return calls.join(shared, "l_suppkey").groupBy("nation").agg(F.count("*").alias("n"), F.sum("q").alias("quantity"))


@query("""SELECT count(*) AS n, CAST(sum(CASE WHEN x * x + y * y <= 4611686014132420609 THEN 1 ELSE 0 END) AS BIGINT) AS inside FROM (
  SELECT x, (x * 1103515245 + 12345) % 2147483648 AS y FROM (SELECT (event_id * 1103515245 + 12345) % 2147483648 AS x FROM events))""")
def pi_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points from a linear congruence over the ids; four times inside / n estimates pi."""
    step = lambda c: (c * 1103515245 + 12345) % 2147483648
    points = table(spark, sf_dir, "events").select(step(F.col("event_id")).alias("x")).select("x", step(F.col("x")).alias("y"))
    inside = F.col("x") * F.col("x") + F.col("y") * F.col("y") <= (2**31 - 1) ** 2
    return points.agg(F.count("*").alias("n"), F.count_if(inside).alias("inside"))


@query("""WITH losses AS (SELECT p_brand, k, sum((CAST(p_retailprice AS DECIMAL(18,2)) - 200 * k) * (CAST(p_retailprice AS DECIMAL(18,2)) - 200 * k)) AS loss
  FROM part, (SELECT unnest([2, 4, 6, 8]) AS k) GROUP BY p_brand, k)
SELECT p_brand, arg_min(k, (loss, k)) AS best FROM losses GROUP BY p_brand""")
def grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parameter with the least loss for each brand; every row is evaluated under each of the four."""
    price, k = F.col("p_retailprice").cast("decimal(18,2)"), F.col("k")
    tried = table(spark, sf_dir, "part").select("p_brand", price.alias("price"), F.explode(F.array(*[F.lit(x) for x in (2, 4, 6, 8)])).alias("k"))
    off = F.col("price") - 200 * k
    losses = tried.groupBy("p_brand", "k").agg(F.sum(off * off).alias("loss"))
    return losses.groupBy("p_brand").agg(F.min_by("k", F.struct("loss", "k")).alias("best"))


# ---- the same by Python functions, call by call ----------------------------------------------------


def _doubled(o_orderkey: int, o_custkey: int) -> int:
    return (o_orderkey + 1) * (o_custkey + 2)


def _less_three(x: int) -> int:
    return x - 3


@query("SELECT o_orderkey, (o_orderkey + 1) * (o_custkey + 2) AS result FROM orders")
def map_py(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = opaque.mapped(table(spark, sf_dir, "orders"), "o_orderkey", {"o_orderkey": "o_orderkey", "o_custkey": "o_custkey"}, [_doubled], "long")
    return out.select(F.col("call_id").alias("o_orderkey"), "result")


@query("SELECT o_orderkey, (o_orderkey + 1) * (o_custkey + 2) - 3 AS result FROM orders")
def chain_py(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = opaque.mapped(table(spark, sf_dir, "orders"), "o_orderkey", {"o_orderkey": "o_orderkey", "o_custkey": "o_custkey"}, [_doubled, _less_three], "long")
    return out.select(F.col("call_id").alias("o_orderkey"), "result")


@query("SELECT o_orderkey, (o_orderkey + 1) * (o_custkey + 2) - 3 AS result FROM orders")
def chain_pickled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by pickled calls, whose results may be any objects."""
    calls = opaque.calls_of(table(spark, sf_dir, "orders"), "o_orderkey", {"o_orderkey": "o_orderkey", "o_custkey": "o_custkey"})
    second = opaque.rebound(opaque.apply(calls, _doubled), _less_three)
    return opaque.typed(opaque.apply(second, _less_three), "long").select(F.col("call_id").alias("o_orderkey"), "result")


@query("SELECT c_mktsegment, CAST(sum(c_custkey) AS BIGINT) AS result FROM customer GROUP BY c_mktsegment")
def map_reduce_py(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed reduction by an associative Python function, folded before and after the shuffle."""
    return opaque.fold(table(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey", lambda a, b: a + b, "long").withColumnRenamed("value", "result")


def _flaky(event_id: int, tries: list | None = None) -> int:
    seen = _flaky.__dict__.setdefault("seen", {})
    seen[event_id] = seen.get(event_id, 0) + 1
    if seen[event_id] <= event_id % 4:
        raise ValueError(f"call {event_id} fails")
    del seen[event_id]
    return event_id


@query("SELECT event_id, CAST(least(event_id % 4, 2) + 1 AS INTEGER) AS attempts, event_id % 4 <= 2 AS success FROM events")
def retry_py(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = opaque.calls_of(table(spark, sf_dir, "events"), "event_id", {"event_id": "event_id"})
    return opaque.apply(calls, _flaky, retries=2).select(F.col("call_id").alias("event_id"), "attempts", F.col("exc_type").isNull().alias("success"))


@query("SELECT p_partkey, unnest(range(CAST(p_size AS BIGINT))) AS result FROM part")
def fanout_py(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python call that answers with requests for further calls, each of which is then made."""
    out = opaque.fanned(table(spark, sf_dir, "part"), "p_partkey", {"n": "p_size"}, lambda n: list(range(n)), _same, "long")
    return out.select(F.col("parent_id").alias("p_partkey"), "result")


def _same(x: int) -> int:
    return x
