"""Eligibility, death and phenotype rules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortweave.functions.dates import usable_from
from cohortweave.functions.rows import first_known, latest_of
from cohortweave.operators.persons import with_scalar


def cohort_seed(demographics: DataFrame, deaths: DataFrame, keep: Column, cutoff: str, person: str = "person_id",
                death_ts: str = "death_ts") -> DataFrame:
    """Persons that pass ``keep``, with their last known death record up to the cut-off."""
    known = deaths.where(F.col(death_ts).isNull() | (F.col(death_ts) <= F.lit(cutoff).cast("timestamp_ntz")))
    last = known.groupBy(person).agg(F.max(death_ts).cast("date").alias("death_date"))
    return demographics.where(keep).distinct().join(last, person, "left")


def first_dates(sources: Sequence[tuple[DataFrame, str]], person: str = "person_id", name: str = "first_date") -> DataFrame:
    """Earliest day per person over several dated record sets."""
    parts = [df.groupBy(person).agg(F.min(F.col(ts).cast("date")).alias(name)) for df, ts in sources]
    stacked = reduce(lambda a, b: a.unionByName(b), parts)
    return stacked.groupBy(person).agg(F.min(name).alias(name))


def eligible_date(cohort: DataFrame, first: DataFrame, dates: Sequence[str], floor: str,
                  person: str = "person_id", name: str = "eligible_date") -> DataFrame:
    """Latest of the given dates and the study start; unknown dates are skipped."""
    return cohort.join(first, person, "left").withColumn(
        name, latest_of(*[F.col(d).cast("date") for d in dates], F.lit(floor).cast("date")))


def death_date(crosswalk: DataFrame, master: DataFrame, later: Sequence[tuple[str, DataFrame, str]],
               key: str, person: str, master_dates: Sequence[tuple[str, str]]) -> DataFrame:
    """Death date by source priority.

    The columns of ``master`` (label, column) come first, then the ``later`` sources
    (label, frame keyed by ``key``, column), which only count when newer than the last
    date in the master's first column.  One row per distinct (person, date, source).
    """
    last = F.max(F.col(master_dates[0][1]))
    linked = crosswalk.select(*dict.fromkeys([person, key])).distinct().join(master, key, "left")
    linked = with_scalar(linked, master, last, "_last")
    sources = [(label, F.col(col)) for label, col in master_dates]
    for i, (label, frame, col) in enumerate(later):
        newer = frame.select(F.col(key), F.col(col).alias(f"_s{i}"))
        newer = with_scalar(newer, master, last, "_limit").where(F.col(f"_s{i}") > F.col("_limit")).drop("_limit")
        linked = linked.join(newer, key, "left")
        sources.append((label, F.col(f"_s{i}")))
    value, label = first_known(sources)
    return (linked.select(person, value.cast("date").alias("death_date"), label.alias("death_source"))
            .where(F.col("death_date").isNotNull()).distinct())


def phenotype_onset(index: DataFrame, inpatient: DataFrame, outpatient: DataFrame, by: str, at: str,
                    concept: str = "concept", inpatient_ts: str = "ts", visit_ts: str = "visit_ts",
                    record_ts: str = "ts", n_out: int = 2, name: str = "onset") -> DataFrame:
    """First inpatient record or ``n_out``-th distinct outpatient datetime, whichever is earlier.

    Only records at or before the index date count (outpatient: by ``visit_ts``).
    Per (person, concept, usable day) only the first inpatient record and the
    ``n_out`` earliest distinct outpatient datetimes can matter; the ranking filter
    is applied map-side before the shuffle.
    """
    points = index.select(by, at).distinct()
    first_in = (inpatient.where(F.col(inpatient_ts).isNotNull())
                .groupBy(by, concept).agg(F.min(inpatient_ts).alias("_ts"))
                .join(points, by).where(F.col("_ts") <= F.col(at).cast("timestamp_ntz"))
                .select(by, at, concept, "_ts"))
    times = (outpatient.where(F.col(visit_ts).isNotNull())
             .groupBy(by, concept, F.col(record_ts).alias("_ts")).agg(F.min(usable_from(visit_ts)).alias("_day")))
    daily = times.withColumn("_rn", F.row_number().over(
        Window.partitionBy(by, concept, "_day").orderBy("_ts"))).where(F.col("_rn") <= n_out).drop("_rn")
    ranked = daily.join(points, by).where(F.col("_day") <= F.col(at)).withColumn("_rn", F.row_number().over(
        Window.partitionBy(by, at, concept).orderBy("_ts")))
    nth_out = ranked.where(F.col("_rn") == n_out).select(by, at, concept, "_ts")
    return (first_in.unionByName(nth_out).groupBy(by, at, concept).agg(F.min("_ts").alias(name)))
