"""Lookups of a fact relative to an index date.

Every lookup first reduces the facts to one row per (person, day) with a
map-side combine.  Because index dates are days this loses nothing, and a
person who owns a large share of the facts brings at most one row per calendar
day into any join or window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortweave.functions.dates import usable_from
from cohortweave.operators.timeline import Latest, timeline


def _list(x: str | Sequence[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def _pick(ts: str, tie: Sequence[str], values: Sequence[str]) -> Column:
    return F.struct(F.col(ts).cast("timestamp_ntz").alias("_ts"),
                    *[F.col(c).alias(f"_tie{i}") for i, c in enumerate(tie)],
                    *[F.col(v).alias(v) for v in values])


def _daily_latest(facts: DataFrame, by: list[str], ts: str, tie, values, day: Column) -> DataFrame:
    """One row per (by, day): the latest fact, with the day of the next row."""
    daily = (facts.where(F.col(ts).isNotNull())
             .groupBy(*by, day.alias("_day")).agg(F.max(_pick(ts, tie, values)).alias("_pick")))
    return daily.withColumn("_next", F.lead("_day").over(Window.partitionBy(*by).orderBy("_day")))


def asof_latest(index: DataFrame, facts: DataFrame, by: str | Sequence[str], at: str, ts: str,
                values: Sequence[str], tie: Sequence[str] = (), strict: bool = False,
                ts_name: str | None = None, gap: str | None = None, gap_from: str | None = None) -> DataFrame:
    """Latest fact at or before (``strict``: before) the index date, per (by, at).

    ``at`` may be a date (its midnight counts) or a timestamp.  Ties on ``ts`` go to
    the largest ``tie`` columns, then the largest values.  ``gap`` adds the days from
    the fact (or its column ``gap_from``) to the index date.  Index rows without a
    fact give no row.
    """
    by = _list(by)
    keys = by + [at]
    points = index.select(*keys).distinct()
    if dict(index.dtypes)[at] == "date":
        daily = _daily_latest(facts, by, ts, tie, values, usable_from(ts, strict))
        hits = points.join(daily, by).where(
            (F.col("_day") <= F.col(at)) & (F.col("_next").isNull() | (F.col(at) < F.col("_next"))))
    else:
        hits = _asof_timestamp(points, facts, by, at, ts, values, tie, strict)
    out = hits.select(*keys, "_pick._ts", *[F.col(f"_pick.{v}").alias(v) for v in values])
    if gap:
        out = out.withColumn(gap, F.datediff(F.col(at), F.col(gap_from or "_ts")))
    return out.withColumnRenamed("_ts", ts_name or ts) if (ts_name or ts) not in values else out.drop("_ts")


def _carry(points: DataFrame, facts: DataFrame, by: list[str], block: Column | None, strict: bool, name: str) -> DataFrame:
    """Add to each point (``_at``) the latest fact (``_when``, ``_pick``) of its block at or before it (``strict``: before).

    Points and facts are one union ordered by time; the last fact is carried over the points, so no pair is made.
    """
    fact_first = F.lit(1 if strict else 0)
    both = (points.withColumn("_when", F.col("_at")).withColumn("_order", F.lit(0 if strict else 1))
            .unionByName(facts.select(*by, "_when", "_pick").withColumn("_order", fact_first), allowMissingColumns=True))
    group = [*by] if block is None else [*by, block]
    run = Window.partitionBy(*group).orderBy("_when", "_order").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(name, F.last("_pick", ignorenulls=True).over(run)).where(F.col("_at").isNotNull()).drop("_when", "_order", "_pick")


def _asof_timestamp(points, facts, by, at, ts, values, tie, strict) -> DataFrame:
    """Timestamp index, in three levels of time blocks whose rows are bounded.

    Facts of one microsecond are one row, so a second of a person holds a million rows at most: the last fact is carried over
    the points inside it.  Each second's last fact then stands for the second inside the day (86,400 at most), and each day's for the
    day, for the points that found nothing closer.
    """
    known = (facts.where(F.col(ts).isNotNull()).groupBy(*by, F.col(ts).cast("timestamp_ntz").alias("_when"))
             .agg(F.max(_pick(ts, tie, values)).alias("_pick")))
    second, day = F.date_trunc("second", "_when").cast("timestamp_ntz"), F.date_trunc("day", "_when").cast("timestamp_ntz")
    seconds = known.groupBy(*by, second.alias("_when")).agg(F.max("_pick").alias("_pick"))
    days = seconds.groupBy(*by, day.alias("_when")).agg(F.max("_pick").alias("_pick"))
    stamp = F.col(at).cast("timestamp_ntz")
    found = _carry(points.withColumn("_at", stamp), known, by, second, strict, "_same_second")
    found = _carry(found.withColumn("_at", F.date_trunc("second", stamp).cast("timestamp_ntz")), seconds, by, day, True, "_same_day")
    found = _carry(found.withColumn("_at", F.date_trunc("day", stamp).cast("timestamp_ntz")), days, by, None, True, "_earlier")
    return (found.select(*by, at, F.coalesce("_same_second", "_same_day", "_earlier").alias("_pick"))
            .where(F.col("_pick").isNotNull()))


def asof_latest_wide(index: DataFrame, facts: DataFrame, by: str | Sequence[str], at: str, ts: str,
                     kind: str, value: str, kinds: Mapping[str, str], tie: Sequence[str] = (),
                     suffix: str = "", date_suffix: str = "_dt") -> DataFrame:
    """Latest value of several kinds of measurement at or before the index date, wide.

    ``kinds`` maps the kind text (any case) to a column stem.  All kinds share one
    reduction, one join and one aggregate.
    """
    by = _list(by)
    label = F.lower(F.col(kind))
    wanted = facts.where(label.isin([k.lower() for k in kinds])).withColumn("_kind", label)
    hits = _asof_kinds(index, wanted, by, at, ts, value, tie)
    aggs = []
    for text, stem in kinds.items():
        mine = F.col("_kind") == text.lower()
        aggs += [F.max(F.when(mine, F.col(value))).alias(f"{stem}{suffix}"),
                 F.max(F.when(mine, F.col("_when"))).alias(f"{stem}{suffix}{date_suffix}")]
    return hits.groupBy(*by, at).agg(*aggs)


def _asof_kinds(index, facts, by, at, ts, value, tie) -> DataFrame:
    points = index.select(*by, at).distinct()
    daily = (facts.where(F.col(ts).isNotNull()).groupBy(*by, "_kind", usable_from(ts).alias("_day"))
             .agg(F.max(_pick(ts, tie, [value])).alias("_pick"))
             .repartition(*by))  # one placement for the window and the join
    daily = daily.withColumn("_next", F.lead("_day").over(Window.partitionBy(*by, "_kind").orderBy("_day")))
    return (points.join(daily, by)
            .where((F.col("_day") <= F.col(at)) & (F.col("_next").isNull() | (F.col(at) < F.col("_next"))))
            .select(*by, at, "_kind", F.col("_pick._ts").alias("_when"), F.col(f"_pick.{value}").alias(value)))


def asof_nearest(index: DataFrame, facts: DataFrame, by: str | Sequence[str], at: str, date: str,
                 values: Sequence[str]) -> DataFrame:
    """Fact whose date lies nearest to the index date, in either direction.

    Equal distance: the earlier date; equal date: the smallest values.  A fact
    without a date has no distance and wins, as a NULL sorts first.  Each date owns
    the span of index dates it is nearest to, so the join emits one row per index row.
    """
    by = _list(by)
    keys = by + [at]
    points = index.select(*keys).distinct()
    day = F.col(date).cast("date")
    pick = F.struct(*[F.col(v).alias(v) for v in values])
    daily = facts.groupBy(*by, day.alias("_day")).agg(F.min(pick).alias("_pick"))
    undated = daily.where("_day is null").select(*by, F.col("_pick").alias("_undated"))
    w = Window.partitionBy(*by).orderBy("_day")
    number = F.unix_date(F.col("_day"))
    cells = (daily.where("_day is not null").withColumn("_d", number)
             .withColumn("_prev", F.lag("_d").over(w)).withColumn("_next", F.lead("_d").over(w)))
    twice = F.unix_date(F.col(at)) * 2
    near = (points.join(cells, by)
            .where((F.col("_prev").isNull() | (twice > F.col("_prev") + F.col("_d")))
                   & (F.col("_next").isNull() | (twice <= F.col("_d") + F.col("_next"))))
            .select(*keys, "_day", F.col("_pick").alias("_near")))
    both = points.join(near, keys, "left").join(undated, by, "left")
    use_undated = F.col("_undated").isNotNull()
    picked = both.select(
        *keys, F.when(~use_undated, F.col("_day")).alias(date),
        F.coalesce(F.col("_undated"), F.col("_near")).alias("_v"),
        F.abs(F.datediff(F.when(~use_undated, F.col("_day")), F.col(at))).alias("distance_days"))
    return picked.where(F.col("_v").isNotNull()).select(
        *keys, date, "distance_days", *[F.col("_v")[v].alias(v) for v in values])


def asof_by_period(spans: DataFrame, facts: DataFrame, by: str | Sequence[str], row_id: Sequence[str],
                   start: str, periods: str, ts: str, values: Mapping[str, Column],
                   where: Mapping[str, Column] | None = None, tie: Sequence[str] = (),
                   dates: bool = False) -> DataFrame:
    """Latest value at or before each monthly period start, several measures at once.

    ``spans`` holds one row per (person, arm) with its start date and number of
    periods.  A fact goes to the first period that may use it and is carried forward
    (``timeline``).  The cost is linear in the facts.
    """
    latest = Latest(facts, ts, values, where, tie, tuple(values) if dates else ())
    return timeline(spans, [latest], by, row_id, start, periods)
