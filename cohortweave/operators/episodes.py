"""Treatment episodes and what follows from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortweave.operators.asof import asof_latest
from cohortweave.operators.reshape import pivot_dates


def _open_days(by_day: DataFrame, eligible: DataFrame, exposed: str, comparator: str, person: str, arm: str,
               eligible_date: str) -> DataFrame:
    """Rows of one (person, arm, day) each that pass the rule of their arm."""
    first = by_day.where(F.col(arm) == exposed).groupBy(person).agg(F.min("start_date").alias("_first"))
    people = eligible.select(person, eligible_date).join(first, person, "left")
    opens = F.when(F.col(arm) == exposed, F.col("_first") >= F.col(eligible_date)).when(
        F.col(arm) == comparator, F.col("start_date") >= F.col(eligible_date))
    return by_day.join(people, person).where(opens).drop("_first")


def _known(fills: DataFrame, person: str, arm: str, release: str, days: str, columns: Sequence[str]) -> DataFrame:
    return (fills.where(F.col(release).isNotNull() & F.col(days).isNotNull())
            .select(person, arm, F.col(release).cast("date").alias("start_date"), release, days, *columns))


def exposure_fills(fills: DataFrame, eligible: DataFrame, exposed: str, comparator: str, person: str = "person_id",
                   arm: str = "arm", release: str = "release_ts", days: str = "days_supply",
                   eligible_date: str = "eligible_date", columns: Sequence[str] = ()) -> DataFrame:
    """Fills that open exposure, by arm, with start and end day.

    Exposed arm: all fills of persons whose first fill of that arm is not before the
    eligibility date.  Comparator arm: fills released at or after it.  Fills equal in
    all listed columns count once.

    The rule only looks at days, so it is decided on one row per (person, arm, day);
    the fills then meet their day, which spreads a person with very many fills.
    """
    known = _known(fills, person, arm, release, days, columns)
    by_day = known.select(person, arm, "start_date").distinct()
    open_days = _open_days(by_day, eligible, exposed, comparator, person, arm, eligible_date)
    return (known.join(open_days, [person, arm, "start_date"])
            .withColumn("end_date", F.date_add(F.col("start_date"), F.col(days).cast("int")))
            .select(person, arm, release, days, "start_date", "end_date", eligible_date, *columns).distinct())


def exposure_starts(fills: DataFrame, eligible: DataFrame, exposed: str, comparator: str, person: str = "person_id",
                    arm: str = "arm", release: str = "release_ts", days: str = "days_supply",
                    eligible_date: str = "eligible_date", name: str = "start_date") -> DataFrame:
    """First day per (person, arm) of the fills in ``exposure_fills``: only the distinct days of a person are looked at."""
    by_day = _known(fills, person, arm, release, days, []).select(person, arm, "start_date").distinct()
    open_days = _open_days(by_day, eligible, exposed, comparator, person, arm, eligible_date)
    return open_days.groupBy(person, arm).agg(F.min("start_date").alias(name))


def exposure_days(fills: DataFrame, eligible: DataFrame, exposed: str, comparator: str, person: str = "person_id",
                  arm: str = "arm", release: str = "release_ts", days: str = "days_supply",
                  eligible_date: str = "eligible_date", columns: Sequence[str] = ()) -> DataFrame:
    """Days of supply per (person, arm, start day) of the fills in ``exposure_fills``.

    This is all that episodes need: fills are summed per day before they meet the
    person, and what follows keeps the placement by person.
    """
    unique = _known(fills, person, arm, release, days, columns).distinct()
    by_day = unique.groupBy(person, arm, "start_date").agg(F.sum(F.col(days).cast("long")).alias(days))
    return _open_days(by_day, eligible, exposed, comparator, person, arm, eligible_date)


def treatment_episodes(fills: DataFrame, keys: Sequence[str], start: str = "start_date",
                       days: str = "days_supply", grace: int = 30) -> DataFrame:
    """Episodes of continuous treatment with a grace gap and stockpiling.

    A fill that starts more than ``grace`` days after the covered-until day opens a
    new episode; otherwise its days are added to the later of covered-until and its
    start.  With D the running days of supply, covered-until is
    ``D + running max(start - D before the fill)``.

    Fills of one day are summed first, which does not change the result; a person
    then has at most one row per calendar day in the window.
    """
    keys = list(keys)
    daily = fills.groupBy(*keys, start).agg(F.sum(F.col(days).cast("long")).alias("_d"))
    w = Window.partitionBy(*keys).orderBy(start)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    s = F.unix_date(F.col(start))
    steps = (daily.withColumn("_total", F.sum("_d").over(run))
             .withColumn("_covered", F.col("_total") + F.max(s - (F.col("_total") - F.col("_d"))).over(run)))
    opens = F.when(s > F.lag("_covered").over(w) + grace, 1).otherwise(0)
    marked = steps.withColumn("_open", opens).withColumn("_ep", F.sum("_open").over(run))
    return marked.groupBy(*keys, "_ep").agg(
        F.min(start).alias("start_date"),
        F.date_from_unix_date(F.max("_covered").cast("int")).alias("end_date"),
        F.sum("_d").alias("days_total")).drop("_ep")


def index_episodes(episodes: DataFrame, keys: Sequence[str], start: str = "start_date") -> DataFrame:
    """First episode per key."""
    keys = list(keys)
    rest = [c for c in episodes.columns if c not in keys]
    first = F.min(F.struct(F.col(start).alias("_s"), *rest))
    return episodes.groupBy(*keys).agg(first.alias("_f")).select(*keys, *[F.col("_f")[c].alias(c) for c in rest])


def user_type(index: DataFrame, prior: DataFrame, person: str = "person_id", at: str = "start_date",
              start: str = "start_date", end: str = "end_date", days: int = 180) -> DataFrame:
    """``Prevalent`` when the latest earlier comparator fill ended at most ``days`` before the index.

    A fill that still runs at the index date has a negative gap and counts as
    Prevalent; no earlier fill counts as New.  Of fills with one start the longest counts.
    """
    earlier = prior.select(person, F.col(start).alias("_start"), F.col(end).alias("prior_end"))
    last = asof_latest(index, earlier, person, at, "_start", ["prior_end"], strict=True,
                       gap="gap_days", gap_from="prior_end").drop("_start", "prior_end")
    out = index.join(last, [person, at], "left")
    return out.withColumn("user_type", F.when(F.col("gap_days") <= days, "Prevalent").otherwise("New"))


def crossover_date(index: DataFrame, episodes: DataFrame, arms: Sequence[str], person: str = "person_id",
                   arm: str = "arm", start: str = "start_date") -> DataFrame:
    """First later episode of either arm, and of the other arm (crossover)."""
    names = {a: f"next_{i}" for i, a in enumerate(arms)}
    later = episodes.select(person, F.col(arm).alias("_arm"), F.col(start).alias("_later"))
    pairs = index.select(person, arm, start).join(later, person).where(F.col("_later") > F.col(start))
    wide = pivot_dates(pairs, [person, arm, start], "_arm", "_later", names, "min")
    other: Column = F.when(F.col(arm) == arms[0], F.col("next_1")).otherwise(F.col("next_0"))
    return wide.withColumn("crossover_date", other)
