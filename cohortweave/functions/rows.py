"""Row-wise expressions on several columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cohortweave.session import staged


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def latest_of(*cols: str | Column) -> Column:
    """Row-wise maximum that skips NULLs."""
    return F.greatest(*[_c(c) for c in cols])


def first_known(sources: Sequence[tuple[str, Column]]) -> tuple[Column, Column]:
    """First non-NULL of labelled sources, and the label it came from."""
    value = F.coalesce(*[c for _, c in sources])
    label = reduce(lambda acc, s: acc.when(s[1].isNotNull(), F.lit(s[0])), sources[1:],
                   F.when(sources[0][1].isNotNull(), F.lit(sources[0][0])))
    return value, label


def censor_after(col: str | Column, cutoff: str | Column) -> Column:
    """The date, or NULL when it lies after the administrative cut-off."""
    limit = F.lit(cutoff).cast("date") if isinstance(cutoff, str) else cutoff
    return F.when(_c(col) <= limit, _c(col))


def plausible(col: str | Column, low: float | None = None, high: float | None = None,
              closed: bool = False) -> Column:
    """Range test, open at both ends unless ``closed``; NULL values fail it."""
    x = _c(col)
    tests = [x.isNotNull()]
    if low is not None:
        tests.append(x >= low if closed else x > low)
    if high is not None:
        tests.append(x <= high if closed else x < high)
    return reduce(lambda a, b: a & b, tests)


def plausible_pressure(systolic: str, diastolic: str) -> Column:
    """Blood pressure: both readings known and non-zero, systolic above diastolic."""
    s, d = F.col(systolic), F.col(diastolic)
    return s.isNotNull() & d.isNotNull() & (s != 0) & (d != 0) & (s > d)


def inverse_logit(col: str | Column) -> Column:
    return 1.0 / (1.0 + F.exp(-_c(col)))


def binary(col: str | Column, exposed: str) -> Column:
    """1 for the exposed level, 0 for every other value."""
    return F.when(_c(col) == exposed, 1).otherwise(0)


def recode(col: str | Column, mapping: Mapping[str, str], default: Column | None = None) -> Column:
    """Relabel values; values without a label keep their text (or take ``default``)."""
    source = _c(col)
    expr = F.lit(None).cast("string")
    for old, new in reversed(list(mapping.items())):
        expr = F.when(source == old, F.lit(new)).otherwise(expr)
    return F.coalesce(expr, source.cast("string") if default is None else default)


def dense_ids(df: DataFrame, bucket: Sequence[str], order: Sequence[str], name: str = "id") -> DataFrame:
    """Dense row ids 1..n in (bucket, order) order, without one global sort task.

    The rows are range partitioned by the whole key, sorted and kept in the checkpoint folder with their place inside
    their partition; the driver adds up one row count per partition, and a row's id is its place plus the count before its partition.
    """
    key = [*bucket, *order]
    # The built-in id holds the partition in its upper 31 bits and the place in the lower 33.
    ranged = staged(df.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).cast("int")
    sizes = {r["_part"]: r["count"] for r in ranged.groupBy(part.alias("_part")).count().collect()}
    before, offsets = 0, []
    for k in sorted(sizes):
        offsets.append((k, before))
        before += sizes[k]
    # One row per partition: as small as the task list of the job itself.
    starts = F.broadcast(df.sparkSession.createDataFrame(offsets, "_part int, _offset long"))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (ranged.withColumn("_part", part).join(starts, "_part")
            .withColumn(name, F.col("_offset") + place + 1).drop("_part", "_at", "_offset"))
