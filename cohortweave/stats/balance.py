"""Table 1, standardised mean differences and score histograms."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cohortweave.operators.reshape import melt
from cohortweave.operators.summaries import exact_quantiles

OVERALL = "Overall"
MISSING = "NA"


def table_one(df: DataFrame, strata: str, numeric: Sequence[str] = (), nonnormal: Sequence[str] = (),
              categories: Sequence[str] = ()) -> DataFrame:
    """Baseline table, long: (variable, level, stratum, stat, value), per stratum and overall.

    Numbers: n, missing_pct, mean and sd, or median, q1 and q3 for ``nonnormal``.
    Categories: count and percent of every level, a missing value being a level.
    """
    numbers = [*numeric, *nonnormal]
    parts = []
    stratum = F.coalesce(F.col(strata).cast("string"), F.lit(MISSING))
    if numbers:
        base = df.select(stratum.alias("_s"), *[F.col(c).cast("double").alias(c) for c in numbers])
        aggs = [F.grouping("_s").alias("_g"), F.count(F.lit(1)).alias("_n")]
        for c in numbers:
            aggs.append(F.count(c).alias(f"n:{c}"))
            if c in numeric:
                aggs += [F.avg(c).alias(f"mean:{c}"), F.stddev_samp(c).alias(f"sd:{c}")]
        wide = base.rollup("_s").agg(*aggs).withColumn(
            "stratum", F.when(F.col("_g") == 1, OVERALL).otherwise(F.col("_s")))
        stats = []
        for c in numbers:
            pairs = [("n", F.col(f"n:{c}").cast("double")),
                     ("missing_pct", (100.0 * (F.col("_n") - F.col(f"n:{c}")) / F.col("_n")))]
            if c in numeric:
                pairs += [("mean", F.col(f"mean:{c}")), ("sd", F.col(f"sd:{c}"))]
            stats += [F.struct(F.lit(c).alias("variable"), F.lit("").alias("level"), F.lit(s).alias("stat"),
                               v.cast("double").alias("value")) for s, v in pairs]
        parts.append(wide.select("stratum", F.explode(F.array(*stats)).alias("_r"))
                     .select("_r.variable", "_r.level", "stratum", "_r.stat", "_r.value"))
    if nonnormal:
        base = df.select(F.explode(F.array(stratum, F.lit(OVERALL))).alias("stratum"),
                         *[F.col(c).cast("double").alias(c) for c in nonnormal])
        long = melt(base, ["stratum"], nonnormal, "variable", "_value")
        q = exact_quantiles(long, ["variable", "stratum"], "_value", [0.25, 0.5, 0.75])
        stat = F.when(F.col("prob") == 0.25, "q1").when(F.col("prob") == 0.5, "median").otherwise("q3")
        parts.append(q.select("variable", F.lit("").alias("level"), "stratum", stat.alias("stat"),
                              F.col("q").alias("value")))
    if categories:
        base = df.select(stratum.alias("_s"),
                         *[F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(c) for c in categories])
        counts = melt(base, ["_s"], categories, "variable", "level").groupBy("variable", "level", "_s").count()
        # Overall comes from the per-stratum counts, not from the rows again.
        counts = counts.select("variable", "level", F.explode(F.array(F.col("_s"), F.lit(OVERALL))).alias("stratum"),
                               "count").groupBy("variable", "level", "stratum").agg(F.sum("count").alias("n"))
        totals = counts.groupBy("variable", "stratum").agg(F.sum("n").alias("_total"))
        joined = counts.join(totals, ["variable", "stratum"])
        rows = F.array(F.struct(F.lit("count").alias("stat"), F.col("n").cast("double").alias("value")),
                       F.struct(F.lit("percent").alias("stat"), (100.0 * F.col("n") / F.col("_total")).alias("value")))
        parts.append(joined.select("variable", "level", "stratum", F.explode(rows).alias("_r"))
                     .select("variable", "level", "stratum", "_r.stat", "_r.value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _numeric_smd(df: DataFrame, numeric: Sequence[str], treat: str, weight: str | None) -> DataFrame:
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    base = df.select(F.col(treat).cast("int").alias("_t"), w.alias("_w"),
                     *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(numeric)])
    # Moments are taken around one anchor per variable, which keeps them stable.
    anchors = base.agg(*[F.coalesce(F.avg(f"x{i}"), F.lit(0.0)).alias(f"a{i}") for i in range(len(numeric))])
    shifted = base.crossJoin(F.broadcast(anchors))
    aggs = []
    for i in range(len(numeric)):
        x = F.col(f"x{i}") - F.col(f"a{i}")
        wi = F.when(x.isNotNull(), F.col("_w"))
        aggs += [F.count(x).alias(f"n{i}"), F.sum(wi).alias(f"w{i}"), F.sum(wi * x).alias(f"s{i}"),
                 F.sum(wi * x * x).alias(f"q{i}")]
    arms = shifted.groupBy("_t").agg(*aggs)
    rows = []
    for i, c in enumerate(numeric):
        n, mean = F.col(f"n{i}"), F.try_divide(f"s{i}", f"w{i}")
        var = F.try_divide((F.try_divide(f"q{i}", f"w{i}") - mean * mean) * n, n - 1)
        rows.append(F.struct(F.lit(c).alias("variable"), mean.alias("m"), var.alias("v")))
    long = arms.select("_t", F.explode(F.array(*rows)).alias("_r")).select("_t", "_r.*")
    side = lambda t, c: F.max(F.when(F.col("_t") == t, F.col(c)))
    both = long.groupBy("variable").agg(side(1, "m").alias("m1"), side(0, "m").alias("m0"),
                                        side(1, "v").alias("v1"), side(0, "v").alias("v0"))
    gap, spread = F.abs(F.col("m1") - F.col("m0")), F.sqrt((F.col("v1") + F.col("v0")) / 2)
    return both.select("variable", F.when(gap == 0, 0.0).otherwise(F.try_divide(gap, spread)).alias("smd"))


def _category_distance(pdf: pd.DataFrame) -> pd.DataFrame:
    """Mahalanobis distance between the level shares of two arms (first level dropped)."""
    wide = pdf.pivot_table(index="level", columns="_t", values="_w", aggfunc="sum", fill_value=0.0).sort_index()
    for arm in (0, 1):
        if arm not in wide:
            wide[arm] = 0.0
    share = wide / wide.sum()
    p1, p0 = share[1].to_numpy()[1:], share[0].to_numpy()[1:]
    cov = (np.diag(p1) - np.outer(p1, p1) + np.diag(p0) - np.outer(p0, p0)) / 2
    gap = p1 - p0
    dist = float(np.sqrt(max(gap @ np.linalg.pinv(cov) @ gap, 0.0))) if len(gap) else 0.0
    return pd.DataFrame({"variable": [pdf["variable"].iloc[0]], "smd": [dist]})


def _category_smd(df: DataFrame, categories: Sequence[str], treat: str, weight: str | None) -> DataFrame:
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    base = df.select(F.col(treat).cast("int").alias("_t"), w.alias("_w"),
                     *[F.col(c).cast("string").alias(c) for c in categories])
    cells = (melt(base, ["_t", "_w"], categories, "variable", "level").where("level is not null")
             .groupBy("variable", "level", "_t").agg(F.sum("_w").alias("_w")))
    return cells.groupBy("variable").applyInPandas(_category_distance, "variable string, smd double")


def smd(df: DataFrame, treat: str, numeric: Sequence[str] = (), categories: Sequence[str] = (),
        weight: str | None = None) -> DataFrame:
    """Standardised mean difference per variable between treated and others.

    Numbers: |difference of means| over the root of the mean variance; the weighted
    variance carries the factor n/(n-1).  Categories: Mahalanobis distance of the
    level shares.  Rows with a missing value are left out per variable.
    """
    parts = []
    if numeric:
        parts.append(_numeric_smd(df, numeric, treat, weight))
    if categories:
        parts.append(_category_smd(df, categories, treat, weight))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def smd_long(frames: dict[str, DataFrame]) -> DataFrame:
    """One row per variable and weighting method."""
    wide = None
    for method, frame in frames.items():
        part = frame.withColumnRenamed("smd", method)
        wide = part if wide is None else wide.join(part, "variable", "full")
    return melt(wide, ["variable"], list(frames), "method", "smd")


def histogram(df: DataFrame, column: str, width: float, by: Sequence[str]) -> DataFrame:
    """Counts per bin [k*width, (k+1)*width) and group."""
    bin_no = F.floor(F.col(column) / F.lit(width))
    return (df.where(F.col(column).isNotNull()).groupBy(*by, bin_no.alias("bin"))
            .agg(F.count(F.lit(1)).alias("n")).withColumn("bin_start", F.col("bin") * F.lit(width)))
