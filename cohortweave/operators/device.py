"""Device feeds: text exports to daily rows, and rolling-month summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cohortweave.functions.dates import first_period_ending_after, last_period_opening_by
from cohortweave.functions.text import flag_or_null, number_or_null
from cohortweave.sources.tables import harmonise

# Sums, means and extremes of the monthly device summary.
MONTHLY_SPEC = [
    ("transmission_flag", "sum", "transmission_cnt"),
    ("day_hr", "mean", "day_hr_mean"),
    ("night_hr", "mean", "night_hr_mean"),
    ("hrv", "mean", "hrv_mean"),
    ("fluid_index", "mean", "fluid_index_mean"),
    ("fluid_index", "max", "fluid_index_max"),
    ("activity_min", "mean", "activity_mean"),
    ("activity_min", "max", "activity_max"),
    ("activity_min", "min", "activity_minimum"),
    ("at_af_min", "mean", "at_af_mean"),
    ("vt_vf_cnt", "sum", "vt_vf_cnt"),
    ("nst_cnt", "sum", "nst_cnt"),
    ("a_paced_pct", "mean", "a_paced_mean"),
    ("v_paced_pct", "mean", "v_paced_mean"),
    ("n_atp", "sum", "n_atp"),
    ("n_shocks", "sum", "n_shocks"),
]


def signal_columns(serial: str, date: str, flag: str, signals: Mapping[str, tuple[str, str]]) -> dict[str, Column]:
    """Column map of one export: ``signals`` maps target to (source column, number type)."""
    out = {"serial": F.col(serial), "trend_date": F.col(date).cast("date"),
           "transmission_flag": flag_or_null(flag)}
    out.update({target: number_or_null(F.col(source), dtype=dtype) for target, (source, dtype) in signals.items()})
    return out


def device_daily(exports: Sequence[DataFrame], columns: Sequence[Mapping[str, Column]], event_log: DataFrame,
                 owners: DataFrame, log_ts: str = "event_ts", counts: Sequence[str] = ("n_atp", "n_shocks"),
                 millis: Mapping[str, str] | None = None) -> DataFrame:
    """Daily rows of both exports with the event log's daily sums (0 where no event).

    ``owners`` maps serial to person; ``millis`` maps millisecond columns to the
    names of their value in whole minutes.
    """
    feed = harmonise(exports, columns)
    log = (event_log.groupBy("serial", F.col(log_ts).cast("date").alias("trend_date"))
           .agg(*[F.sum(c).alias(c) for c in counts]))
    rows = feed.join(owners, "serial").join(log, ["serial", "trend_date"], "left")
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counts})
    for source, target in (millis or {}).items():
        rows = rows.withColumn(target, (F.col(source) / 60000).cast("decimal(10,0)")).drop(source)
    return rows


def device_monthly(spans: DataFrame, daily: DataFrame, by: str, row_id: Sequence[str], start: str, periods: str,
                   day: str = "trend_date", serial: str = "serial",
                   spec: Sequence[tuple[str, str, str]] = tuple(MONTHLY_SPEC)) -> DataFrame:
    """Summary of the device days in the rolling month before each period start.

    A day lies in one window, or in two where month lengths make windows overlap;
    the windows are found by arithmetic, so the join does not multiply by periods.
    """
    # Totals per device day first: a device with very many rows brings one row per day.
    measures = list(dict.fromkeys(c for c, _, _ in spec))
    totals = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}
    by_day = daily.groupBy(by, serial, day).agg(*[
        f(c).alias(f"{n}:{c}") for c in measures for n, f in totals.items()])
    lo = F.greatest(F.lit(0), first_period_ending_after(start, day))
    hi = F.least(F.col(periods) - 1, last_period_opening_by(start, day))
    rows = (spans.select(*dict.fromkeys([by, *row_id, start, periods])).join(by_day, by)
            .withColumn("_lo", lo).withColumn("_hi", hi).where(F.col("_lo") <= F.col("_hi"))
            .withColumn("time", F.explode(F.sequence("_lo", "_hi"))))
    mean = lambda c: F.sum(f"sum:{c}") / F.sum(f"count:{c}")
    over = {"sum": lambda c: F.sum(f"sum:{c}"), "max": lambda c: F.max(f"max:{c}"),
            "min": lambda c: F.min(f"min:{c}"), "count": lambda c: F.sum(f"count:{c}"), "mean": mean}
    return rows.groupBy(*row_id, serial, "time").agg(*[over[f](c).alias(n) for c, f, n in spec])
