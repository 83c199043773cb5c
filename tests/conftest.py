from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"  # for the workers

from weftline.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("spark")
    settings = {"spark_sql_shuffle_partitions": "4", "spark_ui_enabled": "false", "spark_local_dir": str(base), "spark_sql_warehouse_dir": str(base / "warehouse"), "spark_checkpoint_dir": str(base / "shared")}
    made = session("local[8]", **settings)
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture(scope="session")
def small() -> str:
    return "/root/testdata/sf0.001"
