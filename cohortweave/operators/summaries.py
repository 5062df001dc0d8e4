"""Grouped summaries: daily means, modal category, exact quantiles, spec-driven aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortweave.functions.dates import usable_from
from cohortweave.functions.text import same_text
from cohortweave.session import staged


def daily_mean(df: DataFrame, by: Sequence[str], ts: str, value: str, extra: Sequence[str] = (),
               day: str = "day", name: str | None = None) -> DataFrame:
    """Mean per (by, day) after duplicate (by, day, value, extra) rows fall away."""
    rows = df.select(*by, F.col(ts).cast("date").alias(day), value, *extra).distinct()
    return rows.groupBy(*by, day).agg(F.avg(value).alias(name or value))


def modal_category(index: DataFrame, facts: DataFrame, by: str, at: str, ts: str, category: str,
                   codes: Mapping[str, int], name: str = "code") -> DataFrame:
    """Most frequent category up to the index date, per (by, at).

    ``codes`` lists the categories in order of precedence for ties, with the code to
    report.  Index rows without a known category get NULL.  Facts are counted per
    (person, category, day) before they meet the index.
    """
    daily = (facts.where(F.lower(F.col(category)).isin([c.lower() for c in codes]) & F.col(ts).isNotNull())
             .groupBy(by, F.lower(F.col(category)).alias("_cat"), usable_from(ts).alias("_day"))
             .agg(F.count(F.lit(1)).alias("_n")))
    points = index.select(by, at).distinct()
    seen = (points.join(daily, by).where(F.col("_day") <= F.col(at)).groupBy(by, at).agg(*[
        F.coalesce(F.sum(F.when(F.col("_cat") == c.lower(), F.col("_n"))), F.lit(0)).alias(f"_n{i}")
        for i, c in enumerate(codes)]))
    best = F.greatest(*[
        F.struct(F.col(f"_n{i}").alias("n"), F.lit(-i).alias("rank"), F.lit(code).alias("code"))
        for i, code in enumerate(codes.values())]) if len(codes) > 1 else F.struct(
        F.col("_n0").alias("n"), F.lit(0).alias("rank"), F.lit(next(iter(codes.values()))).alias("code"))
    return points.join(seen.select(by, at, best["code"].alias(name)), [by, at], "left")


def modal_counts(facts: DataFrame, by: Sequence[str], category: str, names: Mapping[str, str]) -> DataFrame:
    """Count per category as columns, 0 where a category is absent."""
    return facts.groupBy(*by).agg(*[
        F.sum(F.when(same_text(category, text), 1).otherwise(0)).cast("long").alias(col)
        for text, col in names.items()])


def window_summary(df: DataFrame, keys: Sequence[str], spec: Sequence[tuple[str, str, str]]) -> DataFrame:
    """One aggregate from a list of (column, function, name)."""
    functions = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min, "count": F.count}
    return df.groupBy(*keys).agg(*[functions[f](c).alias(n) for c, f, n in spec])


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float],
                    method: str = "linear", name: str = "q", frequency: str | None = None) -> DataFrame:
    """Exact quantiles per group, without gathering a group in one task.

    1. Equal values are counted per (by, value) with a map-side combine.
    2. The counts are ranged by (by, value) at sample quantiles of their own and kept in the
       checkpoint folder: every range fits a task, whatever the scale of the values, and the
       input is read once.
    3. A running total over the ranges of a group tells which range holds each wanted rank, and only
       those are ordered by value.

    ``method``: ``linear`` interpolates between the two neighbours (type 7),
    ``disc`` returns the smallest value whose cumulative share reaches the
    probability.  ``frequency`` names a column of row multiplicities.
    Output: (by, ``prob``, ``name``).  NULL and NaN values are skipped.
    """
    by = list(by)
    x = F.col(value).cast("double")
    counts = (df.where(x.isNotNull() & ~F.isnan(x)).groupBy(*by, x.alias("_x"))
              .agg((F.sum(frequency) if frequency else F.count(F.lit(1))).alias("_c")))
    groups = by or ["_all"]
    if not by:
        counts = counts.withColumn("_all", F.lit(0))
    counts = staged(counts.repartitionByRange(*groups, "_x").withColumn("_b", F.spark_partition_id()))
    ranges = counts.groupBy(*groups, "_b").agg(F.sum("_c").alias("_bc"))
    w = Window.partitionBy(*groups).orderBy("_b")
    totals = ranges.select(
        *groups, "_b", "_bc",
        F.coalesce(F.sum("_bc").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
        F.sum("_bc").over(Window.partitionBy(*groups)).alias("_n"))

    def target(p: float) -> Column:
        n = F.col("_n")
        if method == "disc":
            low = F.greatest(F.ceil(n * F.lit(float(p))), F.lit(1)) - 1
            high, share = low, F.lit(0.0)
        else:
            h = (n - 1) * F.lit(float(p))
            low = F.floor(h)
            high, share = F.ceil(h), h - F.floor(h)
        return F.struct(F.lit(float(p)).alias("p"), low.cast("long").alias("lo"),
                        high.cast("long").alias("hi"), share.cast("double").alias("share"))

    wanted = F.array(*[target(p) for p in probs])
    inside = lambda r: (r >= F.col("_base")) & (r < F.col("_base") + F.col("_bc"))
    hot = (totals.withColumn("_t", F.filter(wanted, lambda t: inside(t["lo"]) | inside(t["hi"])))
           .where(F.size("_t") > 0).select(*groups, "_b", "_base", "_t"))
    v = Window.partitionBy(*groups, "_b").orderBy("_x")
    ranked = (counts.join(hot, [*groups, "_b"])
              .withColumn("_to", F.col("_base") + F.sum("_c").over(v.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("_from", F.col("_to") - F.col("_c")))
    holds = lambda r: (r >= F.col("_from")) & (r < F.col("_to"))
    picked = (ranked.withColumn("_t", F.filter("_t", lambda t: holds(t["lo"]) | holds(t["hi"])))
              .where(F.size("_t") > 0).select(*groups, "_x", "_from", "_to", F.explode("_t").alias("_t")))
    low = F.max(F.when(holds(F.col("_t.lo")), F.col("_x")))
    high = F.max(F.when(holds(F.col("_t.hi")), F.col("_x")))
    share = F.max("_t.share")
    out = picked.groupBy(*groups, F.col("_t.p").alias("prob")).agg((low + (high - low) * share).alias(name))
    return out if by else out.drop("_all")


def percentile_interval(df: DataFrame, by: Sequence[str], columns: Sequence[str],
                        low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentile limits per group (type 7, NULLs skipped) for groups of bounded size,
    such as the bootstrap replicates of one time point."""
    aggs = []
    for c in columns:
        aggs += [F.percentile(c, F.lit(low)).alias(f"{c}_lcl"), F.percentile(c, F.lit(high)).alias(f"{c}_ucl")]
    return df.groupBy(*by).agg(*aggs)


def median_disc(df: DataFrame, by: Sequence[str], value: str, name: str = "median",
                frequency: str | None = None) -> DataFrame:
    """Discrete median per group: the lower of the two middle values."""
    return exact_quantiles(df, by, value, [0.5], "disc", name, frequency).drop("prob")
