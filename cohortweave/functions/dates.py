"""Calendar expressions.

All index dates of a cohort are calendar days, i.e. midnights.  A fact at a
finer timestamp can therefore be reduced to the first or last *day* on which it
counts (``usable_from``) without changing any comparison against an index date.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def midnight(day: str | Column) -> Column:
    """The timestamp (no zone) at the start of a day."""
    return _c(day).cast("date").cast("timestamp_ntz")


def month_boundaries(start: str | Column, end: str | Column) -> Column:
    """Number of calendar-month boundaries crossed (31 Jan to 1 Feb is 1)."""
    a, b = _c(start), _c(end)
    return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)


def day_gap(start: str | Column, end: str | Column) -> Column:
    """Days from ``start`` to ``end``."""
    return F.datediff(_c(end), _c(start))


def add_days(day: str | Column, n: str | Column) -> Column:
    return F.date_add(_c(day).cast("date"), _c(n).cast("int"))


def fiscal_year(day: str | Column) -> Column:
    """US federal fiscal year: October to December belong to the next year."""
    return F.year(F.add_months(_c(day), 3))


def fiscal_quarter(day: str | Column) -> Column:
    """``Q1`` (October to December) to ``Q4`` (July to September)."""
    return F.concat(F.lit("Q"), F.quarter(F.add_months(_c(day), 3)).cast("string"))


def usable_from(ts: str | Column, strict: bool = False) -> Column:
    """First day D for which ``ts <= midnight(D)`` (``ts < midnight(D)`` when strict)."""
    stamp = _c(ts).cast("timestamp_ntz")
    day = stamp.cast("date")
    if strict:
        return F.date_add(day, 1)
    return F.when(stamp == midnight(day), day).otherwise(F.date_add(day, 1))


# Monthly periods.  Period t of a row that starts at S covers the rolling month
# [add_months(e, -1), e) with e = add_months(S, t).  Both ends rise with t, so
# every test below picks a contiguous run of periods, found by arithmetic.

def period_end(start: Column, t: Column) -> Column:
    return F.add_months(start, t.cast("int"))


def first_period_ending_from(start: str | Column, day: str | Column) -> Column:
    """Smallest t with ``add_months(start, t) >= day``."""
    s, d = _c(start), _c(day)
    m = month_boundaries(s, d)
    return m + F.when(period_end(s, m) < d, 1).otherwise(0)


def first_period_ending_after(start: str | Column, day: str | Column) -> Column:
    """Smallest t with ``add_months(start, t) > day``."""
    return first_period_ending_from(start, F.date_add(_c(day), 1))


def last_period_opening_by(start: str | Column, day: str | Column) -> Column:
    """Largest t with ``add_months(add_months(start, t), -1) <= day``."""
    s, d = _c(start), _c(day)
    m = month_boundaries(s, d)
    opens = F.add_months(period_end(s, m + 1), -1)
    return m + F.when(opens <= d, 1).otherwise(0)
