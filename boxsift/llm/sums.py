"""Sums of arrays over all tasks of a pass, met in a tree of groups."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxsift.llm.common import map_batches
from boxsift.llm.shingles import text_chunks

#: Sums that meet in one group of the tree.
FAN_IN = 64


def tree_sum(parts: DataFrame, n_parts: int, kind: str) -> DataFrame:
    """Rows (slot, part, value), value an array of numbers as bytes: one row for each slot with the sum of its arrays.

    At most FAN_IN arrays meet in a group, however many tasks there were.
    """

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(v, kind) for v in rows["value"]], axis=0, dtype=kind)
        return pd.DataFrame({"slot": rows["slot"][:1], "part": rows["part"][:1] // FAN_IN, "value": [total.tobytes()]})

    for _ in range(max(1, math.ceil(math.log(max(n_parts, 2), FAN_IN)))):
        parts = parts.groupBy("slot", F.expr(f"part div {FAN_IN}").alias("up")).applyInPandas(add, "slot int, part long, value binary")
    return parts


def summed(rows: DataFrame, task: Callable[[Iterator[tuple[pa.RecordBatch, list[bytes]]]], np.ndarray | None], kind: str, slots: int, lower: bool = False) -> np.ndarray:
    """Sum over all tasks of the array, of fixed size, that task makes of its chunks of rows with a text; empty without rows.

    The arrays meet in so many slots, each in groups of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = task(text_chunks(batches, lower=lower))
        if total is not None:
            pieces = np.array_split(total.reshape(-1), slots)
            part = TaskContext.get().partitionId()
            columns = [pa.array(range(slots), pa.int32()), pa.array([part] * slots, pa.int64()), pa.array([p.tobytes() for p in pieces], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["slot", "part", "value"])

    parts = map_batches(rows, run, "slot int, part long, value binary")
    got = tree_sum(parts, rows.rdd.getNumPartitions(), kind).collect()
    return np.concatenate([np.frombuffer(r["value"], kind) for r in sorted(got, key=lambda r: r["slot"])]) if got else np.empty(0, kind)
