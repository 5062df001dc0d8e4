"""Wide and long forms, person-period expansion, parameter grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortweave.functions.text import same_text


def pivot_dates(df: DataFrame, keys: Sequence[str], category: str, date: str, values: Mapping[str, str],
                agg: str = "max") -> DataFrame:
    """One date column per category (text compared without case), by one conditional aggregate."""
    pick = {"max": F.max, "min": F.min}[agg]
    return df.groupBy(*keys).agg(*[
        pick(F.when(same_text(category, text), F.col(date))).alias(name) for text, name in values.items()])


def expand_periods(df: DataFrame, periods: str, start: str | None = None, time: str = "time",
                   interval_start: str = "interval_start", event: str | None = None,
                   flag: str = "event") -> DataFrame:
    """One row per period 0..T-1, with the interval start and an event flag on the last period.

    Rows with T < 1 (or NULL) have no period.
    """
    out = (df.where(F.col(periods) >= 1)
           .withColumn(time, F.explode(F.sequence(F.lit(0), F.col(periods).cast("int") - 1))))
    if start:
        out = out.withColumn(interval_start, F.add_months(F.col(start), F.col(time)))
    if event:
        last = F.col(time) + 1 == F.col(periods)
        out = out.withColumn(flag, F.when(last & (F.col(event) == 1), 1).otherwise(0))
    return out


def melt(df: DataFrame, ids: Sequence[str], columns: Sequence[str], variable: str = "variable",
         value: str = "value") -> DataFrame:
    """Wide to long."""
    return df.unpivot(list(ids), list(columns), variable, value)


def stack_arms(df: DataFrame, ids: Sequence[str], arms: Mapping[int, Mapping[str, str]], arm: str = "exp") -> DataFrame:
    """Turn per-arm columns into rows: ``arms[a]`` maps target name to the column of arm a."""
    rows = F.array(*[F.struct(F.lit(a).alias(arm), *[F.col(c).alias(t) for t, c in cols.items()])
                     for a, cols in arms.items()])
    return df.select(*ids, F.explode(rows).alias("_r")).select(*ids, "_r.*")


def shell(spark: SparkSession, arms: Sequence[int] = (0, 1), horizon: int = 42) -> DataFrame:
    """Prediction shell: one row per arm and period 0..horizon-1."""
    return spark.range(horizon).select(
        F.explode(F.array(*[F.lit(a) for a in arms])).alias("exp"), F.col("id").cast("int").alias("time"))


def grid(**lists: Sequence) -> list[dict]:
    """All combinations of parameter values."""
    return [dict(zip(lists, combo)) for combo in product(*lists.values())]
