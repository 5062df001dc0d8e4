"""Sums of arrays over all rows, added up inside Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def summed(df: DataFrame, size: int, of: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum of ``of(batch)``, an array of ``size`` numbers, over all batches of ``df``.

    A task adds up its batches; the tasks' arrays are summed by position with a partial aggregate, so one row per
    position reaches the driver however many tasks there are.
    """
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(size), False
        for batch in batches:
            if batch.num_rows:
                total, seen = total + of(batch), True
        if seen:
            yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(size), pa.int32()), "v": pa.array(total)})

    rows = df.mapInArrow(partial, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size)
    for r in rows:
        out[r["i"]] = r["v"]
    return out
