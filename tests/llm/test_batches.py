"""What one task's Python process is given at once."""

from __future__ import annotations

import subprocess
import sys

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import _common, line_dedup, minhash, mixing, packing, toxicity

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def sizes():
    def measure(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["rows", "size"])

    return measure


def test_whole_texts_come_in_small_batches(spark, sizes):
    texts = spark.range(3000, numPartitions=1).select(F.repeat(F.lit("x "), 2000).alias("text"))
    made = _common.by_batches(texts, sizes, "rows long, size long").collect()
    assert sum(r["rows"] for r in made) == 3000 and max(r["size"] for r in made) < 3 << 20


def test_a_limit_of_the_session_holds(spark, sizes):
    spark.conf.set(LIMIT, "8m")
    try:
        assert _common.by_batches(spark.range(1), sizes, "rows long, size long").count() == 1
        assert spark.conf.get(LIMIT) == "8m"
    finally:
        spark.conf.unset(LIMIT)


@pytest.mark.parametrize("call", [
    lambda d, tmp: mixing.described(d, "n", topic="t", model=mixing.TopicModel(mixing.np.zeros((0, mixing.WIDTH)))),
    lambda d, tmp: minhash.signatures(d, 20, 5),
    lambda d, tmp: packing.pieces(d, tmp),
    lambda d, tmp: line_dedup._references(d, "doc_id", "text", 20),
    lambda d, tmp: toxicity.ToxicityModel({}, None, mixing.np.zeros(1), mixing.np.zeros(1)).apply(d),
])
def test_stages_bound_their_batches(spark, tmp_path, call):
    spark.conf.unset(LIMIT)
    call(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), str(tmp_path))
    assert spark.conf.get(LIMIT) == "2m"


def test_tasks_of_mixing_go_without_pandas():
    subprocess.run([sys.executable, "-c", "import sys, weftline.llm.mixing; assert 'pandas' not in sys.modules"], check=True)
