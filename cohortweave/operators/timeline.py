"""Person-month tables in one placement: every source brings updates, one aggregate and one window carry them all.

A source is reduced to at most one record per person and day (and category), says in which periods of a span its record counts, and
how the measures carry on from there.  Each source meets the spans by person and brings one update per span and period that it changes;
its measures travel as one struct, so a row is as wide as its own source.  The updates of all sources are placed by person once; what
follows (the running values, the rows of quiet months) keeps that placement, so no exchange is keyed by the period.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortweave.functions.dates import first_period_ending_after, first_period_ending_from, last_period_opening_by, usable_from
from cohortweave.functions.text import same_text

_SLOT = "array<struct<time:int,sign:int>>"


def runs(start: str, a: Column, a_up: Column, d: Column, proper: Column) -> Column:
    """Runs of periods that an interval touches, as an array of (lo, hi).

    ``a``/``d`` are the days of both ends, ``a_up`` the first day not before the
    start.  A proper interval touches one run; an open one the periods that contain
    its start; one that ends before it starts the periods containing either end.
    """
    def containing(day: Column) -> Column:
        return F.struct(first_period_ending_after(start, day).alias("lo"),
                        last_period_opening_by(start, day).alias("hi"))

    a_run, d_run = containing(a), containing(d)
    whole = F.struct(first_period_ending_from(start, a_up).alias("lo"),
                     last_period_opening_by(start, d).alias("hi"))
    # Both runs are merged when they meet, so that no period is counted twice.
    lo, hi = F.least(a_run["lo"], d_run["lo"]), F.greatest(a_run["hi"], d_run["hi"])
    meet = F.greatest(a_run["lo"], d_run["lo"]) <= F.least(a_run["hi"], d_run["hi"])
    merged = F.array(F.struct(lo.alias("lo"), hi.alias("hi")))
    return (F.when(d.isNull(), F.array(a_run))
            .when(proper, F.array(whole))
            .when(meet, merged).otherwise(F.array(a_run, d_run)))


def _clipped(found: Column, periods: str) -> Column:
    """Runs cut to the span's periods, the empty ones left out."""
    cut = F.transform(found, lambda r: F.struct(F.greatest(F.lit(0), r["lo"]).cast("int").alias("lo"),
                                                F.least(F.col(periods) - 1, r["hi"]).cast("int").alias("hi")))
    return F.filter(cut, lambda r: r["lo"] <= r["hi"])


def _point(time: Column, sign: Column | int = 0) -> Column:
    return F.struct(time.cast("int").alias("time"), (F.lit(sign) if isinstance(sign, int) else sign).cast("int").alias("sign"))


def _each_month(found: Column) -> Column:
    return F.flatten(F.transform(found, lambda r: F.transform(F.sequence(r["lo"], r["hi"]), lambda t: _point(t))))


@dataclass(frozen=True)
class Latest:
    """Values known at each period start: the latest fact at or before it, carried forward."""

    facts: DataFrame
    ts: str
    values: Mapping[str, Column]
    where: Mapping[str, Column] | None = None
    tie: Sequence[str] = ()
    dates: Sequence[str] = ()  # values whose day is wanted too, as <name>_dt
    scale: str | None = None  # type of the values in the table; they are cast once picked, per change and not per month

    def records(self, by: list[str]) -> DataFrame:
        where, ties = self.where or {}, [F.col(c).alias(f"_tie{i}") for i, c in enumerate(self.tie)]
        # Facts of one moment first, then the last moment of the day: numbers and times alone are aggregated by hash.
        moments = (self.facts.where(F.col(self.ts).isNotNull()).groupBy(*by, usable_from(self.ts).alias("_a"), F.col(self.ts).cast("timestamp_ntz").alias("_ts"))
                   .agg(*[F.max(F.when(where.get(n, F.lit(True)), F.struct(*ties, v.alias("_v")) if ties else v)).alias(n) for n, v in self.values.items()],
                        *[F.max(F.when(where[n], 1)).alias(f"{n}:seen") for n in self.values if n in where]))
        at = {n: F.when(F.col(f"{n}:seen").isNotNull(), F.col("_ts")) if n in where else F.col("_ts") for n in self.values}
        return moments.groupBy(*by, "_a").agg(*[c for n in self.values for c in (
            F.max_by(F.col(n)["_v"] if ties else F.col(n), at[n]).alias(n), F.max(at[n]).alias(f"{n}:ts"))])

    def placed(self, met: DataFrame, start: str, periods: str) -> DataFrame:
        return met.withColumn("_at", F.greatest(F.lit(0), first_period_ending_from(start, "_a")).cast("int"))

    def updates(self) -> list[Column]:
        return [c for n in self.values for c in (F.max_by(n, f"{n}:ts").alias(n), F.max(f"{n}:ts").alias(f"{n}:ts"))]

    def carried(self, run, had: str) -> list[Column]:
        # A later slot holds a later fact, so the last one known is the latest.
        stamp = {n: F.col(had)[f"{n}:ts"] for n in self.values}
        value = {n: F.col(had)[n].cast(self.scale) if self.scale else F.col(had)[n] for n in self.values}
        return [F.last(F.when(stamp[n].isNotNull(), F.struct(stamp[n].alias("_ts"), value[n].alias("_v"))), ignorenulls=True).over(run).alias(n)
                for n in self.values]

    def rows(self, age: Column) -> list[Column]:
        out = []
        for n in self.values:
            out.append(F.col(n)["_v"].alias(n))
            if n in self.dates:
                out.append(F.col(n)["_ts"].cast("date").alias(f"{n}_dt"))
        return out


class _Slotted:
    """Sources whose record may count in several periods."""

    def placed(self, met: DataFrame, start: str, periods: str) -> DataFrame:
        slot = met.withColumn("_slot", F.explode(self.slots(start, periods).cast(_SLOT)))
        return slot.withColumn("_at", F.col("_slot.time")).withColumn("_sign", F.col("_slot.sign"))


@dataclass(frozen=True)
class Touching(_Slotted):
    """Number of intervals that touch the rolling month before each period start, and optionally its running total."""

    intervals: DataFrame
    a: str
    d: str
    name: str
    cumulative: str | None = None

    def records(self, by: list[str]) -> DataFrame:
        a, d = F.col(self.a).cast("timestamp_ntz"), F.col(self.d).cast("timestamp_ntz")
        # Window ends are midnights: the tests only see these days of each interval.
        return (self.intervals.where(F.col(self.a).isNotNull() | F.col(self.d).isNotNull())
                .groupBy(*by, a.cast("date").alias("_a"), usable_from(self.a).alias("_up"), d.cast("date").alias("_d"), (a <= d).alias("_proper"))
                .agg(F.count(F.lit(1)).alias(self.name)))

    def slots(self, start: str, periods: str) -> Column:
        found = _clipped(runs(start, F.col("_a"), F.col("_up"), F.col("_d"), F.col("_proper")), periods)
        return F.flatten(F.transform(found, lambda r: F.array(_point(r["lo"], 1), _point(r["hi"] + 1, -1))))

    def updates(self) -> list[Column]:
        return [F.sum(F.col(self.name) * F.col("_sign")).alias(self.name)]

    def carried(self, run, had: str) -> list[Column]:
        return [F.sum(F.coalesce(F.col(had)[self.name], F.lit(0))).over(run).cast("long").alias(self.name)]

    def totals(self, before) -> list[Column]:
        """Sum of the counts of all earlier months, from the months that each slot stands for."""
        if not self.cumulative:
            return []
        return [F.coalesce(F.sum(F.col(self.name) * F.col("_months")).over(before), F.lit(0)).alias(self.cumulative)]

    def rows(self, age: Column) -> list[Column]:
        out = [F.col(self.name)]
        if self.cumulative:
            out.append((F.col(self.cumulative) + F.col(self.name) * (age + 1)).cast("long").alias(self.cumulative))
        return out


class _Monthly(_Slotted):
    """Measures that hold in the very months of a record only."""

    def carried(self, run, had: str) -> list[Column]:
        fields = F.struct(F.col("_at"), *[F.col(had)[n].alias(n) for n in self._names()])
        return [F.last(F.when(F.col(had).isNotNull(), fields), ignorenulls=True).over(run).alias(self._kept())]

    def _kept(self) -> str:
        return "_kept:" + "|".join(self._names())

    def rows(self, age: Column) -> list[Column]:
        kept = F.col(f"`{self._kept()}`")
        return [F.when((age == 0) & (kept["_at"] == F.col("_at")), kept[n]).alias(n) for n in self._names()]


@dataclass(frozen=True)
class Current(_Monthly):
    """Latest start of an interval that touches each rolling month, one column per category; ``a`` and ``d`` are dates.

    ``marker`` names a column that is 1 where an interval of any category, listed or not, touches the month.
    """

    intervals: DataFrame
    a: str
    d: str
    category: str
    values: Mapping[str, str]
    marker: str | None = None

    def _names(self) -> list[str]:
        return [*self.values.values(), *([self.marker] if self.marker else [])]

    def records(self, by: list[str]) -> DataFrame:
        label = F.lower(F.col(self.category))
        listed = label.isin([v.lower() for v in self.values])
        known = self.intervals if self.marker else self.intervals.where(listed)
        longest = known.groupBy(*by, F.when(listed, label).alias("_cat"), F.col(self.a).alias("_a")).agg(F.max(self.d).alias("_d"))
        return longest.where(F.col("_a").isNotNull() | F.col("_d").isNotNull()).select(
            *by, "_a", F.col("_a").alias("_up"), "_d", (F.col("_a") <= F.col("_d")).alias("_proper"),
            *[F.when(same_text("_cat", text), F.col("_a")).alias(name) for text, name in self.values.items()],
            *([F.lit(1).alias(self.marker)] if self.marker else []))

    def slots(self, start: str, periods: str) -> Column:
        return _each_month(_clipped(runs(start, F.col("_a"), F.col("_up"), F.col("_d"), F.col("_proper")), periods))

    def updates(self) -> list[Column]:
        return [F.max(n).alias(n) for n in self._names()]


@dataclass(frozen=True)
class DayTotals(_Monthly):
    """Sums, means and extremes of daily measures over the rolling month; all devices of a person count together.

    ``label`` names a text column, such as the serial number, whose largest value in the month is kept.
    """

    daily: DataFrame
    day: str
    spec: Sequence[tuple[str, str, str]]
    label: str | None = None

    def _names(self) -> list[str]:
        return [*([self.label] if self.label else []), *[n for _, _, n in self.spec]]

    def records(self, by: list[str]) -> DataFrame:
        over = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}
        return self.daily.groupBy(*by, F.col(self.day).alias("_a")).agg(*([F.max(self.label).alias(self.label)] if self.label else []), *[
            f(c).alias(f"{n}:{c}") for c in dict.fromkeys(c for c, _, _ in self.spec) for n, f in over.items()])

    def slots(self, start: str, periods: str) -> Column:
        run = F.struct(first_period_ending_after(start, "_a").alias("lo"), last_period_opening_by(start, "_a").alias("hi"))
        return _each_month(_clipped(F.array(run), periods))

    def updates(self) -> list[Column]:
        over = {"sum": lambda c: F.sum(f"sum:{c}"), "max": lambda c: F.max(f"max:{c}"), "min": lambda c: F.min(f"min:{c}"),
                "count": lambda c: F.sum(f"count:{c}"), "mean": lambda c: F.try_divide(F.sum(f"sum:{c}"), F.sum(f"count:{c}"))}
        return [*([F.max(self.label).alias(self.label)] if self.label else []), *[over[f](c).alias(n) for c, f, n in self.spec]]


Source = Latest | Touching | Current | DayTotals


def timeline(spans: DataFrame, sources: Sequence[Source], by: str | Sequence[str], row_id: Sequence[str], start: str, periods: str) -> DataFrame:
    """(row_id, time, measures of all sources): one row for every period 0..periods-1 of every span."""
    by = [by] if isinstance(by, str) else list(by)
    keys = list(dict.fromkeys([*by, *row_id, start, periods]))
    rest = [c for c in keys if c not in by]
    base = spans.select(*keys).where(F.col(periods) >= 1).dropna(subset=by).distinct()
    # A span goes by its number within the person; its own columns travel with its first period, which always has a slot, so that quiet
    # spans and months before the first fact are there.
    base = base.withColumn("_span", F.row_number().over(Window.partitionBy(*by).orderBy(*rest)))
    parts = [base.select(*by, "_span", F.lit(0).alias("_at"), F.struct(*rest).alias("_row"))]
    for i, s in enumerate(sources):
        # The spans are the built side: records pass by without a sort.
        met = s.records(by).join(base.select(*dict.fromkeys([*by, "_span", start, periods])).hint("shuffle_hash"), by)
        found = s.placed(met, start, periods).where(F.col("_at") < F.col(periods)).groupBy(*by, "_span", "_at").agg(*s.updates())
        parts.append(found.select(*by, "_span", "_at", F.struct(*[c for c in found.columns if c not in (*by, "_span", "_at")]).alias(f"_had{i}")))
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).repartition(*by)
    # A period may hold the updates of several sources, one row each: the last of them has seen them all and stands for the period,
    # the others stand for no month.
    order = Window.partitionBy(*by, "_span").orderBy("_at")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    held = every.select(*by, "_span", "_at", F.last("_row", ignorenulls=True).over(run).alias("_row"), F.lead("_at").over(order).alias("_next"),
                        *[c for i, s in enumerate(sources) for c in s.carried(run, f"_had{i}")])
    held = held.withColumn("_months", (F.coalesce("_next", F.col("_row")[periods]) - F.col("_at")).cast("int")).where("_months > 0")
    totals = [c for s in sources if isinstance(s, Touching) for c in s.totals(before)]
    if totals:
        held = held.select("*", *totals)
    age = F.col("time") - F.col("_at")
    rows = held.withColumn("time", F.explode(F.sequence(F.col("_at"), F.col("_at") + F.col("_months") - 1)))
    return rows.select(*[F.col(c) if c in by else F.col("_row")[c].alias(c) for c in row_id], "time", *[c for s in sources for c in s.rows(age)])
