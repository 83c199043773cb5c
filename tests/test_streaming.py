"""Queues and counters fed by streams."""

from __future__ import annotations

from weftline.operators import stats
from weftline.streaming import state


def test_queue_hands_every_row_out_once(spark, tmp_path):
    queue, got = state.Queue(spark, str(tmp_path), "id long, body string"), []
    take = lambda rows, batch: got.extend(r["id"] for r in rows.collect())
    queue.put(spark.range(5).selectExpr("id", "'a' AS body"))
    queue.consume(take)
    assert sorted(got) == [0, 1, 2, 3, 4]
    queue.put(spark.range(5, 7).selectExpr("'b' AS body", "id"))
    queue.put(spark.range(7, 8).selectExpr("id", "'c' AS body"))
    queue.consume(take)
    queue.consume(take)
    assert sorted(got) == list(range(8))


def test_counters_of_a_stream(spark, tmp_path):
    spark.range(100).selectExpr("id % 3 AS k", "id").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, id long").parquet(str(tmp_path / "in"))
    state.drain(state.counters(stream, "k", "id"), "drained", str(tmp_path / "checkpoint"))
    assert {r["k"]: (r["total"], r["n"]) for r in spark.table("drained").collect()} == {k: (sum(range(k, 100, 3)), len(range(k, 100, 3))) for k in range(3)}


def test_statistics_are_exported(spark, tmp_path):
    stats.export(spark.range(2), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
