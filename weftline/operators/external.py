"""Programs of any language as the function of a map: a line in and a line out for each row."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def piped(df: DataFrame, column: str, command: list[str], name: str = "answer") -> DataFrame:
    """``df`` with what ``command`` writes for each value of ``column``, a process for each batch of rows.

    A null is an empty line; line breaks in a value are sent as spaces.  A program that fails, or that does not answer
    with a line for each row, fails the task with what it wrote as errors.
    """
    schema = T.StructType([*(f for f in df.schema.fields if f.name != name), T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lines = [(str(v) if v is not None else "").replace("\r", " ").replace("\n", " ") for v in batch.column(column).to_pylist()]
            done = subprocess.run(command, input="\n".join(lines) + "\n", capture_output=True, text=True, encoding="utf-8", check=False)
            answers = done.stdout.split("\n")[:-1]
            if done.returncode or len(answers) != len(lines):
                raise RuntimeError(f"{command[0]}: status {done.returncode}, {len(answers)} answers to {len(lines)} lines: {done.stderr[-500:]}")
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in schema.fields[:-1]), pa.array(answers, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)
