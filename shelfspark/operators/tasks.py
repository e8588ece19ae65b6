"""User callbacks per task."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


TASKS_PER_BATCH = 200


def apply_per_task(tasks: DataFrame, fn: Callable[[dict], Iterable[dict]], schema: T.StructType) -> DataFrame:
    """Calls ``fn`` with every task row; its result rows land in ``data``, an exception in ``error``.

    Output: the task columns, success, data, execution_time and error. One failing task does not end the job.
    """
    added = [
        T.StructField("success", T.BooleanType()),
        T.StructField("data", T.ArrayType(schema)),
        T.StructField("execution_time", T.DoubleType()),
        T.StructField("error", T.StringType()),
    ]
    out = T.StructType([*tasks.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        rows = []
        for batch in batches:
            for task in batch.to_pylist():
                started = time.perf_counter()
                try:
                    outcome = {"success": True, "data": list(fn(dict(task))), "error": None}
                except Exception as problem:  # noqa: BLE001 - reported per row
                    outcome = {"success": False, "data": [], "error": f"{type(problem).__name__}: {problem}"}
                rows.append({**task, **outcome, "execution_time": time.perf_counter() - started})
                if len(rows) >= TASKS_PER_BATCH:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return tasks.mapInArrow(run, out)
