"""From source tables to the baseline row per (person, arm) and the person-month table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortweave.functions.dates import fiscal_quarter, fiscal_year, month_boundaries, usable_from
from cohortweave.functions.rows import censor_after, plausible, plausible_pressure
from cohortweave.operators.asof import asof_latest, asof_latest_wide, asof_nearest
from cohortweave.operators.device import MONTHLY_SPEC
from cohortweave.operators.episodes import crossover_date
from cohortweave.operators.intervals import active_at, lookback_count, lookback_latest
from cohortweave.operators.persons import merge_covariates
from cohortweave.operators.phenotype import phenotype_onset
from cohortweave.operators.reshape import pivot_dates
from cohortweave.operators.summaries import daily_mean, median_disc, modal_category
from cohortweave.operators.timeline import Current, DayTotals, Latest, Source, Touching, timeline
from cohortweave.sources.tables import stage_by

PERSON, ARM, START = "person_id", "arm", "start_date"
INDEX = [PERSON, START]
ROW = [PERSON, ARM, START]
# Parts that the persons of one area and quarter are dealt over.
AREA_SALT = 16
# Labs whose day is kept per month, and the scales of the monthly device columns.
DATED_LABS = ["BNP", "NT-proBNP"]
DEVICE_SCALES = {
    **dict.fromkeys(["day_hr_mean", "night_hr_mean", "hrv_mean", "fluid_index_mean", "fluid_index_max", "activity_mean", "activity_max",
                     "activity_minimum", "at_af_mean"], "decimal(10,1)"),
    **dict.fromkeys(["a_paced_mean", "v_paced_mean"], "decimal(10,2)"),
    **dict.fromkeys(["vt_vf_cnt", "nst_cnt", "n_atp", "n_shocks"], "decimal(10,0)"),
}


@dataclass(frozen=True)
class Sources:
    """Person-level fact tables (identities already resolved), by column contract.

    vitals(person_id, kind, ts, value, systolic, diastolic); labs(person_id,
    phenotype, ts, value); smoking(person_id, ts, status); addresses(person_id,
    updated, zip, urh); inpatient(person_id, concept, ts); outpatient(person_id,
    concept, ts, visit_ts); rx(person_id, rx_class, start_date, end_date);
    stays(person_id, admit_ts, discharge_ts) and hf_stays alike, one row per stay;
    flu(person_id, ts); homes(person_id, geo); area(geo, fiscal_year, quarter, rank);
    ejection(person_id, ts, value); device(person_id, serial, trend_date, ...).
    """

    demographics: DataFrame
    vitals: DataFrame
    labs: DataFrame
    smoking: DataFrame
    addresses: DataFrame
    inpatient: DataFrame
    outpatient: DataFrame
    rx: DataFrame
    stays: DataFrame
    hf_stays: DataFrame
    flu: DataFrame
    homes: DataFrame
    area: DataFrame
    ejection: DataFrame
    device: DataFrame | None = None


@dataclass(frozen=True)
class Study:
    """Study parameters: cut-off, plausible ranges, code lists and label maps."""

    cutoff: str
    weight_range: tuple[float, float] = (75, 700)
    height_range: tuple[float, float] = (48, 84)
    # Category text to code, in order of precedence for ties.
    smoking_codes: Mapping[str, int] = field(default_factory=lambda: {
        "CURRENT SMOKER": 1, "FORMER SMOKER": 2, "NEVER SMOKER": 0})
    lab_columns: Mapping[str, str] = field(default_factory=lambda: {
        "Creatinine": "creatinine", "potassium": "potassium", "BNP": "bnp", "NT-proBNP": "probnp",
        "Albumin": "albumin", "Hemoglobin": "hb"})
    conditions: Mapping[str, str] = field(default_factory=dict)
    rx_classes: Mapping[str, str] = field(default_factory=dict)


def exposure_with_death(index: DataFrame, types: DataFrame, deaths: DataFrame, cutoff: str, required: str) -> DataFrame:
    """Index rows with user type and death date censored at the cut-off; ``required`` must be known."""
    return (index.where(F.col(required).isNotNull())
            .join(types.select(*ROW, "gap_days", "user_type"), ROW, "left")
            .join(deaths.select(PERSON, "death_date").distinct(), PERSON, "left")
            .withColumn("death_date", censor_after("death_date", cutoff)).distinct())


def is_weight(study: Study) -> Column:
    return (F.lower("kind") == "weight") & plausible("value", *study.weight_range)


def is_height(study: Study) -> Column:
    return (F.lower("kind") == "height") & plausible("value", *study.height_range)


def is_pressure() -> Column:
    return (F.lower("kind") == "blood pressure") & plausible_pressure("systolic", "diastolic")


def area_index(index: DataFrame, homes: DataFrame, area: DataFrame) -> DataFrame:
    """Lowest area rank of the person's fiscal quarter, over the person's areas.

    ``homes`` (person_id, geo) place persons, ``area`` (geo, fiscal_year, quarter, rank) ranks areas.  The persons of an area and
    quarter are dealt over ``AREA_SALT`` parts, and the one rank of an area and quarter is repeated for each part, so an area
    that holds a third of all persons does not meet in one task; no rank is fanned out to persons.
    """
    points = (index.select(*INDEX).distinct().join(homes.select(PERSON, "geo").distinct(), PERSON)
              .withColumns({"fiscal_year": fiscal_year(START), "quarter": fiscal_quarter(START), "_part": F.pmod(F.xxhash64(*INDEX), F.lit(AREA_SALT)).cast("int")}))
    lowest = (area.groupBy("geo", "fiscal_year", "quarter").agg(F.min("rank").alias("area_rank"))
              .withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(AREA_SALT - 1)))))
    return points.join(lowest, ["geo", "fiscal_year", "quarter", "_part"]).groupBy(*INDEX).agg(F.min("area_rank").alias("area_rank"))


def baseline(index: DataFrame, src: Sources, study: Study) -> DataFrame:
    """One row per index row with every baseline covariate as of its start date.

    Each covariate is grouped by (person, start date), so the merges share one
    placement of the rows.
    """
    # Weight and pressure share one pass over the vitals; their value is one struct.
    reading = F.struct(F.when(is_weight(study), F.col("value")).alias("value"), "systolic", "diastolic")
    vitals = asof_latest_wide(
        index, src.vitals.where(is_weight(study) | is_pressure()).withColumn("_v", reading), PERSON, START, "ts", "kind",
        "_v", {"weight": "_w", "blood pressure": "_bp"}).select(
        *INDEX, F.col("_w.value").alias("weight_bl"), F.col("_w_dt").cast("date").alias("weight_bl_dt"),
        F.col("_bp.systolic").alias("sbp_bl"), F.col("_bp.diastolic").alias("dbp_bl"))
    tall = src.vitals.where(is_height(study))
    tall = (tall.groupBy(PERSON, "value", usable_from("ts").alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
            .join(index.select(*INDEX).distinct(), PERSON).where(F.col("_day") <= F.col(START)))
    height = median_disc(tall, INDEX, "value", "height_bl", frequency="_n")
    ef = daily_mean(src.ejection, [PERSON], "ts", "value", name="ef")
    frames = {
        "vitals": vitals,
        "height": height,
        "smoking": modal_category(index, src.smoking, PERSON, START, "ts", "status", study.smoking_codes, "smoking"),
        "address": asof_nearest(index, src.addresses, PERSON, START, "updated", ["zip", "urh"]).select(
            *INDEX, "zip", "urh"),
        "labs": asof_latest_wide(index, src.labs, PERSON, START, "ts", "phenotype", "value", study.lab_columns,
                                 suffix="_bl"),
        "ejection": asof_latest(index, ef, PERSON, START, "day", ["ef"]).select(
            *INDEX, F.col("ef").alias("lvef_bl")),
        "conditions": pivot_dates(
            phenotype_onset(index, src.inpatient, src.outpatient, PERSON, START)
            .withColumn("onset", F.col("onset").cast("date")), INDEX, "concept", "onset", study.conditions),
        "drugs": pivot_dates(
            active_at(index, src.rx.withColumnRenamed(START, "_from"), PERSON, START, "_from", "end_date",
                      ["rx_class"]), INDEX, "rx_class", "_from", study.rx_classes),
        "stays": lookback_count(index, src.hf_stays, PERSON, START, "discharge_ts", 12, "hf_stays_12m"),
        "flu": lookback_latest(index, src.flu, PERSON, START, "ts", 12, "flu_dt"),
        "area": area_index(index, src.homes, src.area),
    }
    base = index.join(src.demographics, PERSON, "left")
    return merge_covariates(base, frames, INDEX)


def followup(df: DataFrame, start: str, event_date: str, cutoff: str, time: str = "periods",
             event: str = "event_itt") -> DataFrame:
    """Periods of follow-up to the event or the cut-off, and the event flag."""
    end = F.coalesce(F.col(event_date), F.lit(cutoff).cast("date"))
    return df.withColumns({time: month_boundaries(start, end) + 1,
                           event: F.when(F.col(event_date).isNotNull(), 1).otherwise(0)})


def time_varying(spans: DataFrame, episodes: DataFrame, src: Sources, study: Study, arms: Sequence[str],
                 rx_columns: Mapping[str, str]) -> DataFrame:
    """Person-month rows with the covariates known at each interval start.

    All sources share one timeline: no exchange is keyed by the period.  The spans, which every source meets, are staged by person with
    all that belongs to the span (end and crossover date).  A person's devices count together.
    """
    periods = "periods"
    labs = {k: study.lab_columns[k] for k in study.lab_columns if k not in ("Albumin", "Hemoglobin")}
    lab_label = F.lower(F.col("phenotype"))
    # Both pressures are of one reading: of a moment's readings the largest systolic, then the largest diastolic.
    pressures = (src.vitals.where(is_pressure() & F.col("ts").isNotNull()).groupBy(PERSON, "ts", "systolic").agg(F.max("diastolic").alias("diastolic"))
                 .groupBy(PERSON, "ts").agg(F.max("systolic").alias("sbp"), F.max_by("diastolic", "systolic").alias("dbp")))
    sources: list[Source] = [
        Latest(src.vitals.where(is_weight(study)), "ts", {"weight_tv": F.col("value")}, scale="decimal(10,1)"),
        Latest(pressures, "ts", {"sbp_tv": F.col("sbp"), "dbp_tv": F.col("dbp")}),
        Latest(daily_mean(src.ejection, [PERSON], "ts", "value", name="ef"), "day", {"lvef_tv": F.col("ef")}),
        Latest(src.labs.where(lab_label.isin([k.lower() for k in labs])), "ts", {f"{stem}_tv": F.col("value") for stem in labs.values()},
               {f"{stem}_tv": lab_label == text.lower() for text, stem in labs.items()},
               dates=[f"{labs[k]}_tv" for k in DATED_LABS if k in labs], scale="decimal(10,1)"),
        Touching(src.hf_stays, "admit_ts", "discharge_ts", "hf_stays_tv", "hf_stays_cum"),
        Touching(src.stays, "admit_ts", "discharge_ts", "stays_tv"),
        Current(src.rx.withColumnRenamed(START, "_from"), "_from", "end_date", "rx_class", rx_columns),
    ]
    if src.device is not None:
        sources.append(DayTotals(src.device, "trend_date", MONTHLY_SPEC, "serial"))
    keyed = spans.select(*ROW, periods).distinct()
    # The end and the crossover date belong to the span, so they join the spans and not their months; equal spans stay apart.
    switch = crossover_date(keyed.select(*ROW), episodes, arms).select(*ROW, "crossover_date")
    ends = spans.select(*ROW, "end_date").join(switch, ROW, "left").withColumn(
        "_copy", F.row_number().over(Window.partitionBy(*ROW).orderBy("end_date")))
    rows = stage_by(keyed.join(ends, ROW), [PERSON])
    months = timeline(rows, sources, PERSON, rows.columns, START, periods)
    measures = [c for c in months.columns if c not in (*rows.columns, "time", "sbp_tv", "dbp_tv")]
    out = months.select(*ROW, "end_date", periods, "time", F.add_months(F.col(START), F.col("time")).alias("interval_start"),
                        *measures, "sbp_tv", "dbp_tv", "crossover_date")
    return out.withColumns({c: F.col(c).cast(t) for c, t in DEVICE_SCALES.items()}) if src.device is not None else out
