"""Interval and window lookups: active at a date, look-back, rolling-month overlap."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from cohortweave.operators.timeline import Current, Touching, timeline


def _list(x: str | Sequence[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def active_at(index: DataFrame, intervals: DataFrame, by: str | Sequence[str], at: str,
              start: str, end: str, keep: Sequence[str] = ()) -> DataFrame:
    """Intervals with ``start < index <= end``.

    Of intervals that share their start only the longest can matter for the test,
    so a person brings at most one row per day and category into the join.
    """
    by = _list(by)
    spans = intervals.groupBy(*by, *keep, start).agg(F.max(end).alias(end))
    return (index.select(*by, at).distinct().join(spans, by)
            .where((F.col(start) < F.col(at)) & (F.col(at) <= F.col(end))))


def in_window(index: DataFrame, facts: DataFrame, by: str | Sequence[str], at: str, day: str,
              months: int) -> DataFrame:
    """Facts in ``[index - months, index)``; ``day`` is a date column."""
    by = _list(by)
    return (index.select(*by, at).distinct().join(facts, by)
            .where((F.col(day) >= F.add_months(F.col(at), -months)) & (F.col(day) < F.col(at))))


def lookback_count(index: DataFrame, facts: DataFrame, by: str | Sequence[str], at: str, ts: str,
                   months: int = 12, name: str = "n") -> DataFrame:
    """Number of facts in the look-back window, for index rows that have any."""
    by = _list(by)
    daily = (facts.where(F.col(ts).isNotNull()).groupBy(*by, F.col(ts).cast("date").alias("_day"))
             .agg(F.count(F.lit(1)).alias("_n")))
    return in_window(index, daily, by, at, "_day", months).groupBy(*by, at).agg(
        F.sum("_n").cast("long").alias(name))


def lookback_latest(index: DataFrame, facts: DataFrame, by: str | Sequence[str], at: str, ts: str,
                    months: int = 12, name: str = "latest") -> DataFrame:
    """Latest fact day in the look-back window."""
    by = _list(by)
    days = facts.select(*by, F.col(ts).cast("date").alias("_day")).distinct()
    return in_window(index, days, by, at, "_day", months).groupBy(*by, at).agg(F.max("_day").alias(name))


def overlaps(windows: DataFrame, intervals: DataFrame, by: str | Sequence[str], s: str, e: str,
             a: str, d: str) -> DataFrame:
    """Pairs of window [s, e) and interval [a, d] that touch: a in the window, d in the
    window, or e inside the interval.  An open interval (d NULL) only counts by its start.
    """
    S, E, A, D = (F.col(c) for c in (s, e, a, d))
    hit = ((S <= A) & (A < E)) | ((S <= D) & (D < E)) | ((E >= A) & (E <= D))
    month = lambda x: F.year(x) * 12 + F.month(x)
    # Both sides are laid out by calendar month.  A pair that touches shares the later
    # of the two first months, and is emitted there only.
    spread = lambda df, lo, hi, first: df.withColumn(first, month(lo)).withColumn(
        "_month", F.explode(F.sequence(F.col(first), month(hi))))
    left = spread(windows, S, E, "_w0")
    right = spread(intervals.where(A.isNotNull() | D.isNotNull()), F.least(A, D), F.greatest(A, D), "_i0")
    return (left.join(right, [*_list(by), "_month"])
            .where(hit & (F.col("_month") == F.greatest("_w0", "_i0"))).drop("_month", "_w0", "_i0"))


def overlap_count(spans: DataFrame, intervals: DataFrame, by: str | Sequence[str], row_id: Sequence[str],
                  start: str, periods: str, a: str, d: str, name: str = "n", cumulative: str | None = None) -> DataFrame:
    """Intervals touching the rolling month before each period start, for every period.

    Each interval adds +1 where its run of periods begins and -1 after it ends; a
    running sum over the periods of a span gives the count.  No (interval, period)
    pairs are made.  ``cumulative`` adds the running total of the counts.
    """
    return timeline(spans, [Touching(intervals, a, d, name, cumulative)], by, row_id, start, periods)


def overlap_pivot(spans: DataFrame, intervals: DataFrame, by: str | Sequence[str], row_id: Sequence[str],
                  start: str, periods: str, a: str, d: str, category: str,
                  values: Mapping[str, str]) -> DataFrame:
    """Latest start of an interval touching each rolling month, one column per category.

    ``a`` and ``d`` are dates.  Rows appear for periods with at least one interval.
    """
    out = timeline(spans, [Current(intervals, a, d, category, values, "_any")], by, row_id, start, periods)
    return out.where(F.col("_any").isNotNull()).drop("_any")
