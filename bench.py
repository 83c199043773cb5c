"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path
from statistics import median

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"

HEADLINES = ("map_scalar", "map_reduce_sum", "reduce_by_object", "wordcount_global", "line_frequency", "chunk_plan_size", "chunk_row_ownership", "job_summary", "active_calls", "param_server", "payload_offsets", "map_py", "map_reduce_py")


def main() -> None:
    from weftline import catalog
    from weftline.session import session

    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    base = tempfile.mkdtemp(prefix="spark-")
    spark = session(f"local[{cpus}]", spark_sql_shuffle_partitions=cpus, spark_ui_enabled="false", spark_ui_showConsoleProgress="false", spark_driver_memory="8g", spark_local_dir=base)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINES:
        took = []
        for _ in range(4):
            began = time.time()
            catalog.queries()[name](spark, folder).write.format("noop").mode("overwrite").save()
            took.append(time.time() - began)
        seconds[name] = round(median(took[1:]), 3)  # the first run warms up
    spark.stop()
    print(json.dumps({"metric": "total seconds of the headline queries, warm, median of 3", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(folder).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
