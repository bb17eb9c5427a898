"""One pass over a table that adds up arrays of a size that does not depend on
the rows: gradients, histograms, Gram matrices of iterative fits."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIRECT = 16     # arrays the driver adds itself; more are added in tasks first,
DIRECT_MB = 8   # and so are fewer that are larger than this together
SLICE_KB = 64   # arrays below are cut into few slices


def fitting(df: DataFrame, rows: int, each: int = 2_000) -> DataFrame:
    """``df`` in no more partitions than it has ``each`` rows for: hundreds
    of passes over a small table cost their tasks, not their rows."""
    return df.coalesce(max(1, -(-rows // each)))


def summed(df: DataFrame, make, size: int) -> np.ndarray:
    """Sum over all tasks of the arrays of ``size`` doubles that ``make``
    (batches -> array or None) returns. Where tasks are many or their arrays
    large, these are cut into slices and each slice is added up in a task, so
    that the driver gets one array, not one per task."""
    n = df.rdd.getNumPartitions()
    direct = n <= DIRECT and 8 * size * n <= DIRECT_MB << 20
    slices = 1 if direct else max(1, min(math.isqrt(n) if 8 * size < SLICE_KB << 10 else n, size))
    cut = np.linspace(0, size, slices + 1).astype(int)

    def run(batches):
        from pyspark import TaskContext
        got = make(batches)
        if got is not None:
            got = np.ascontiguousarray(got, np.float64)
            task = TaskContext.get().partitionId()
            for i, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
                yield pa.record_batch({"part": pa.array([i], pa.int32()), "task": pa.array([task], pa.int32()),
                                       "v": pa.array([got[a:b].tobytes()], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        i = table["part"][0].as_py()
        total = np.zeros(cut[i + 1] - cut[i])
        for v in table.sort_by("task")["v"]:
            total += np.frombuffer(v.as_buffer(), np.float64)
        return pa.table({"part": table["part"][:1], "task": table["task"][:1], "v": pa.array([total.tobytes()], pa.binary())})

    schema = "part int, task int, v binary"
    parts = df.mapInArrow(run, schema)
    if not direct:
        parts = parts.groupBy("part").applyInArrow(add, schema)
    total = np.zeros(size)
    got = parts.select("part", "v").toArrow()
    for i, v in zip(got["part"].to_pylist(), got["v"]):
        total[cut[i]:cut[i + 1]] += np.frombuffer(v.as_buffer(), np.float64)
    return total
