"""Checks of the composed cohort operators: episodes, baseline, person-month table, devices."""

from __future__ import annotations

import os
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortweave.catalog.registry import check
from cohortweave.catalog.relational import AREA, LABS_WIDE, MODE, ONSET
from cohortweave.catalog.roles import CUTOFF, FLOOR, STUDY, Roles, with_roles
from cohortweave.operators import device as dev, episodes as E, phenotype as P, reshape
from cohortweave.operators.intervals import overlap_pivot
from cohortweave.operators.timeline import Latest, Touching, timeline
from cohortweave.functions.dates import month_boundaries
from cohortweave.plans import cohort as plan
from cohortweave.plans.study import StudyFrames, modelling_frame, study
from cohortweave.session import ensure_checkpoint_dir, staged
from cohortweave.sources import load
from cohortweave.sources.tables import save, stage_by
from cohortweave.stats.features import known_flag

ROW = plan.ROW
EXPOSURE = "person_id, arm, release_ts, days_supply, start_date, end_date, drug_name"

# The fold over the ordered fills, one fill at a time.
FOLD = {
    "f": """SELECT person_id, arm, start_date AS s, days_supply AS d,
        ROW_NUMBER() OVER (PARTITION BY person_id, arm ORDER BY start_date, days_supply) AS rn FROM expo""",
    "fold": """SELECT person_id, arm, rn, s AS ep_start, s + d AS e, CAST(d AS BIGINT) AS total, 1 AS ep FROM f WHERE rn = 1
        UNION ALL SELECT f.person_id, f.arm, f.rn, CASE WHEN f.s > fold.e + 30 THEN f.s ELSE ep_start END,
        CASE WHEN f.s > fold.e + 30 THEN f.s ELSE GREATEST(fold.e, f.s) END + f.d,
        CASE WHEN f.s > fold.e + 30 THEN f.d ELSE total + f.d END, ep + CASE WHEN f.s > fold.e + 30 THEN 1 ELSE 0 END
        FROM fold JOIN f ON f.person_id = fold.person_id AND f.arm = fold.arm AND f.rn = fold.rn + 1""",
    "ep": """SELECT person_id, arm, MIN(ep_start) AS start_date, MAX(e) AS end_date, MAX(total) AS days_total
        FROM fold GROUP BY person_id, arm, ep""",
    "ixe": """SELECT person_id, arm, start_date, end_date, days_total FROM (SELECT *, ROW_NUMBER() OVER
        (PARTITION BY person_id, arm ORDER BY start_date) AS rn FROM ep) WHERE rn = 1""",
    "ut": """SELECT i.person_id, i.arm, i.start_date, gap AS gap_days,
        CASE WHEN gap <= 180 THEN 'Prevalent' ELSE 'New' END AS user_type FROM ixe i LEFT JOIN (
        SELECT person_id, arm, start_date, CAST(date_diff('day', prior_end, start_date) AS BIGINT) AS gap FROM (
        SELECT i.person_id, i.arm, i.start_date, f.end_date AS prior_end, ROW_NUMBER() OVER (PARTITION BY i.person_id,
        i.arm, i.start_date ORDER BY f.start_date DESC, f.end_date DESC) AS rn FROM ixe i JOIN fill f
        ON i.person_id = f.person_id AND f.arm = 'A' AND f.start_date < i.start_date) WHERE rn = 1) g
        ON i.person_id = g.person_id AND i.arm = g.arm""",
}
DEATH = {
    "master": """SELECT o_custkey AS icn, MIN(o_orderdate) FILTER (WHERE o_orderdate < TIMESTAMP '1997-01-01') AS dod,
        MIN(o_orderdate) FILTER (WHERE o_orderpriority = '1-URGENT') AS missing FROM orders WHERE o_orderstatus = 'F'
        GROUP BY 1""",
    "dead": """SELECT DISTINCT x.person_id, CAST(COALESCE(dod, missing, o.d, p.d) AS DATE) AS death_date,
        CASE WHEN dod IS NOT NULL THEN 'master' WHEN missing IS NOT NULL THEN 'missing' WHEN o.d IS NOT NULL
        THEN 'registry' ELSE 'patient' END AS death_source FROM xw x LEFT JOIN master m ON x.person_id = m.icn
        LEFT JOIN (SELECT o_custkey, MAX(o_orderdate) AS d FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) o
          ON o.o_custkey = x.person_id AND o.d > (SELECT MAX(dod) FROM master)
        LEFT JOIN (SELECT o_custkey, MAX(o_orderdate) AS d FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) p
          ON p.o_custkey = x.person_id AND p.d > (SELECT MAX(dod) FROM master)
        WHERE COALESCE(dod, missing, o.d, p.d) IS NOT NULL""",
}


def _episodes(r: Roles) -> DataFrame:
    return E.treatment_episodes(r.exposure_days, ["person_id", "arm"])


def _index(r: Roles) -> DataFrame:
    return E.index_episodes(_episodes(r), ["person_id", "arm"])


def _user_type(r: Roles, index: DataFrame) -> DataFrame:
    prior = r.fills.where("arm = 'A'").select(
        "person_id", F.col("release_ts").cast("date").alias("start_date"),
        F.date_add(F.col("release_ts").cast("date"), F.col("days_supply")).alias("end_date"))
    return E.user_type(index, prior).withColumn("gap_days", F.col("gap_days").cast("long"))


def _deaths(r: Roles) -> DataFrame:
    orders = r.table("orders", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority").withColumnRenamed(
        "o_custkey", "icn")
    early = F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz")
    master = orders.where("o_orderstatus = 'F'").groupBy("icn").agg(
        F.min(F.when(early, F.col("o_orderdate"))).alias("dod"),
        F.min(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderdate"))).alias("missing"))
    last = lambda s: orders.where(F.col("o_orderstatus") == s).groupBy("icn").agg(F.max("o_orderdate").alias("d"))
    links = r.crosswalk.select("person_id", F.col("person_id").alias("icn"))
    return P.death_date(links, master, [("registry", last("O"), "d"), ("patient", last("P"), "d")], "icn", "person_id",
                        [("master", "dod"), ("missing", "missing")])


# ---- cohort, exposure, episodes --------------------------------------------------------

@check("""SELECT c_custkey AS person_id, c_mktsegment AS generator, CAST(d.ts AS DATE) AS death_date FROM customer LEFT JOIN
    (SELECT o_custkey, MAX(o_orderdate) AS ts FROM orders WHERE o_orderstatus = 'F'
     AND o_orderdate <= TIMESTAMP '2000-12-31' GROUP BY 1) d ON c_custkey = d.o_custkey WHERE c_mktsegment = 'MACHINERY'""")
def cohort_seed(spark: SparkSession, sf: str) -> DataFrame:
    r = Roles(spark, sf)
    people = r.table("customer", "c_custkey", "c_mktsegment").select(
        F.col("c_custkey").alias("person_id"), F.col("c_mktsegment").alias("generator"))
    deaths = r.table("orders", "o_custkey", "o_orderdate", "o_orderstatus").where("o_orderstatus = 'F'").select(
        F.col("o_custkey").alias("person_id"), F.col("o_orderdate").alias("death_ts"))
    return P.cohort_seed(people, deaths, F.col("generator") == "MACHINERY", "2000-12-31")


@check(with_roles(["elig"], "SELECT person_id, implant_date, hf_date, eligible_date FROM elig"))
def eligible_date(spark: SparkSession, sf: str) -> DataFrame:
    return Roles(spark, sf).eligible


@check(with_roles(["expo"], f"SELECT {EXPOSURE} FROM expo"))
def exposure_fills(spark: SparkSession, sf: str) -> DataFrame:
    return Roles(spark, sf).exposure.select(*EXPOSURE.split(", "))


@check(with_roles(["expo"], "SELECT * FROM ep", FOLD))
def treatment_episodes(spark: SparkSession, sf: str) -> DataFrame:
    return _episodes(Roles(spark, sf, share=True))


@check(with_roles(["expo"], "SELECT * FROM ixe", FOLD))
def index_episodes(spark: SparkSession, sf: str) -> DataFrame:
    return _index(Roles(spark, sf, share=True))


@check(with_roles(["expo"], """SELECT arm, COUNT(*) AS persons, ROUND(AVG(days_total), 6) AS mean_days,
    MIN(start_date) AS first_start, MAX(end_date) AS last_end FROM ixe GROUP BY arm""", FOLD))
def exposure_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _index(Roles(spark, sf, share=True)).groupBy("arm").agg(
        F.count(F.lit(1)).alias("persons"), F.round(F.avg("days_total"), 6).alias("mean_days"),
        F.min("start_date").alias("first_start"), F.max("end_date").alias("last_end"))


@check(with_roles(["expo"], "SELECT person_id, arm, start_date, gap_days, user_type FROM ut", FOLD))
def user_type(spark: SparkSession, sf: str) -> DataFrame:
    r = Roles(spark, sf, share=True)
    return _user_type(r, staged(_index(r))).select(*ROW, "gap_days", "user_type")


CROSS = """SELECT i.person_id, i.arm, i.start_date, MIN(CASE WHEN e.arm = 'A' THEN e.start_date END) AS next_0,
    MIN(CASE WHEN e.arm = 'B' THEN e.start_date END) AS next_1,
    MIN(CASE WHEN e.arm <> i.arm THEN e.start_date END) AS crossover_date
    FROM ixe i JOIN ep e ON i.person_id = e.person_id AND e.start_date > i.start_date GROUP BY 1, 2, 3"""


@check(with_roles(["expo"], CROSS, FOLD))
def crossover_date(spark: SparkSession, sf: str) -> DataFrame:
    episodes = staged(_episodes(Roles(spark, sf, share=True)))
    return E.crossover_date(E.index_episodes(episodes, ["person_id", "arm"]), episodes, ["A", "B"])


@check(with_roles(["xw"], "SELECT * FROM dead", DEATH))
def death_cascade(spark: SparkSession, sf: str) -> DataFrame:
    return _deaths(Roles(spark, sf))


WITH_DEATH = f"""SELECT i.person_id, i.arm, i.start_date, i.end_date, i.days_total,
    e.eligible_date, e.hf_date, gap_days, user_type, CASE WHEN death_date <= DATE '{CUTOFF}' THEN death_date END AS death_date
    FROM ixe i JOIN elig e ON i.person_id = e.person_id JOIN ut u ON i.person_id = u.person_id AND i.arm = u.arm
    LEFT JOIN dead d ON i.person_id = d.person_id WHERE hf_date IS NOT NULL"""


@check(with_roles(["expo", "elig", "xw"], WITH_DEATH, {**FOLD, **DEATH}))
def exposure_with_death(spark: SparkSession, sf: str) -> DataFrame:
    r = Roles(spark, sf, share=True)
    first = staged(_index(r))
    index = first.join(r.eligible.select("person_id", "eligible_date", "hf_date"), "person_id")
    return plan.exposure_with_death(index, _user_type(r, first), _deaths(r), CUTOFF, "hf_date")


# ---- baseline ------------------------------------------------------------------------------

_I = "(SELECT DISTINCT person_id, start_date FROM ix)"


def _pick(table: str, where: str, ts: str, order: str, cols: str) -> str:
    return f"""SELECT person_id, start_date, {cols} FROM (SELECT i.person_id, i.start_date, v.* EXCLUDE (person_id),
        ROW_NUMBER() OVER (PARTITION BY i.person_id, i.start_date ORDER BY {order}) AS rn FROM {_I} i
        JOIN {table} v ON i.person_id = v.person_id WHERE {ts} <= CAST(i.start_date AS TIMESTAMP) AND {where}) WHERE rn = 1"""


_BASE = {
    "b_weight": _pick("vital", "kind = 'WEIGHT' AND value > 75 AND value < 700", "ts", "ts DESC, value DESC",
                      "value AS weight_bl, CAST(ts AS DATE) AS weight_bl_dt"),
    "b_height": f"""SELECT i.person_id, i.start_date, quantile_disc(value, 0.5) AS height_bl FROM {_I} i JOIN vital v
        ON i.person_id = v.person_id WHERE kind = 'HEIGHT' AND value > 48 AND value < 84
        AND ts <= CAST(start_date AS TIMESTAMP) GROUP BY 1, 2""",
    "b_bp": _pick("vital", "kind = 'BLOOD PRESSURE' AND systolic <> 0 AND diastolic <> 0 AND systolic > diastolic", "ts",
                  "ts DESC, systolic DESC, diastolic DESC", "systolic AS sbp_bl, diastolic AS dbp_bl"),
    "b_smoke": MODE,
    "b_addr": f"""SELECT person_id, start_date, zip, urh FROM (SELECT i.person_id, i.start_date, zip, urh, ROW_NUMBER() OVER (
        PARTITION BY i.person_id, i.start_date ORDER BY abs(date_diff('day', updated, start_date)) NULLS FIRST,
        updated NULLS FIRST, zip, urh) AS rn FROM {_I} i JOIN addr a ON i.person_id = a.person_id) WHERE rn = 1""",
    "b_lab": LABS_WIDE,
    "b_ef": _pick("ef", "TRUE", "CAST(day AS TIMESTAMP)", "day DESC", "ROUND(ef, 9) AS lvef_bl"),
    "onset": ONSET,
    "b_dx": """SELECT person_id, start_date, CAST(MAX(CASE WHEN concept = 'C_low' THEN onset END) AS DATE) AS c_low_dt,
        CAST(MAX(CASE WHEN concept = 'C_ten' THEN onset END) AS DATE) AS c_ten_dt,
        CAST(MAX(CASE WHEN concept = 'C_twenty' THEN onset END) AS DATE) AS c_twenty_dt FROM onset GROUP BY 1, 2""",
    "b_rx": f"""SELECT i.person_id, i.start_date, MAX(CASE WHEN rx_class = 'STANDARD' THEN f.start_date END) AS rx_standard_dt,
        MAX(CASE WHEN rx_class = 'MEDIUM' THEN f.start_date END) AS rx_medium_dt,
        MAX(CASE WHEN rx_class = 'SMALL' THEN f.start_date END) AS rx_small_dt FROM {_I} i JOIN fill f
        ON i.person_id = f.person_id WHERE i.start_date > f.start_date AND i.start_date <= f.end_date GROUP BY 1, 2""",
    "b_hf": f"""SELECT i.person_id, i.start_date, COUNT(*) AS hf_stays_12m FROM {_I} i JOIN hf_stay h
        ON i.person_id = h.person_id WHERE discharge_ts >= start_date - INTERVAL 12 MONTH AND discharge_ts < start_date
        GROUP BY 1, 2""",
    "b_flu": f"""SELECT i.person_id, i.start_date, MAX(CAST(ts AS DATE)) AS flu_dt FROM {_I} i JOIN rw
        ON i.person_id = rw.person_id AND rx_class = 'ECONOMY' WHERE CAST(ts AS DATE) >= start_date - INTERVAL 12 MONTH
        AND CAST(ts AS DATE) < start_date GROUP BY 1, 2""",
    "b_area": AREA,
}
_PARTS = ["weight", "height", "bp", "smoke", "addr", "lab", "ef", "dx", "rx", "hf", "flu", "area"]
BASELINE = ("SELECT x.*, demo.* EXCLUDE (person_id), "
            + ", ".join(f"b_{p}.* EXCLUDE (person_id, start_date)" for p in _PARTS)
            + f" FROM ({WITH_DEATH}) x JOIN demo ON x.person_id = demo.person_id "
            + " ".join(f"LEFT JOIN b_{p} ON x.person_id = b_{p}.person_id AND x.start_date = b_{p}.start_date"
                       for p in _PARTS))
_BASE_ROLES = ["ix", "elig", "xw", "vital", "smoke", "addr", "lab", "ef", "rec", "hf_stay", "area", "demo"]
_STUDY_SQL = {**FOLD, **DEATH, **_BASE}


def _study(r: Roles) -> StudyFrames:
    prior = r.fills.where("arm = 'A'").select(
        "person_id", F.col("release_ts").cast("date").alias("start_date"),
        F.date_add(F.col("release_ts").cast("date"), F.col("days_supply")).alias("end_date"))
    return study(r.exposure_days, staged(r.eligible), prior, _deaths(r), r.sources, STUDY)


@check(with_roles(_BASE_ROLES, BASELINE, _STUDY_SQL))
def baseline_table(spark: SparkSession, sf: str) -> DataFrame:
    return _study(Roles(spark, sf, share=True)).baseline.withColumns({"lvef_bl": F.round("lvef_bl", 9), "gap_days": F.col("gap_days").cast("long")})


# The modelling frame of the study, under the name that the model checks read.
_FRAME_SQL = {**_STUDY_SQL, "bl": BASELINE, "frame": f"""SELECT * FROM (SELECT CAST(person_id AS VARCHAR) || '|' || arm AS row_key, person_id, arm, start_date,
    CASE WHEN arm = 'B' THEN 1 ELSE 0 END AS exp, date_diff('month', start_date, COALESCE(death_date, DATE '{CUTOFF}')) + 1 AS periods,
    CASE WHEN death_date IS NOT NULL THEN 1 ELSE 0 END AS event_itt, segment, zone, user_type, weight_bl, creatinine_bl,
    CASE WHEN c_low_dt IS NOT NULL THEN 'Yes' ELSE 'No' END AS c_low, date_diff('month', hf_date, start_date) AS time_hf FROM bl) WHERE periods >= 1"""}
_IMPUTED = ", ".join(f"COALESCE({c}, (SELECT quantile_cont({c}, 0.5) FROM frame))::DOUBLE AS {c}" for c in ("weight_bl", "creatinine_bl"))


def study_frame_of(r: Roles) -> DataFrame:
    features = {"c_low": known_flag("c_low_dt"), "time_hf": month_boundaries("hf_date", "start_date")}
    return modelling_frame(_study(r).baseline, STUDY, "B", features, ["weight_bl", "creatinine_bl"])


@check(with_roles(_BASE_ROLES, f"""SELECT row_key, exp::BIGINT AS exp, periods::BIGINT AS periods, event_itt::BIGINT AS event_itt, segment, zone, user_type,
    c_low, time_hf::BIGINT AS time_hf, {_IMPUTED} FROM frame""", _FRAME_SQL))
def study_frame(spark: SparkSession, sf: str) -> DataFrame:
    """The modelling frame from the source tables, kept as a stage table and read back."""
    frame = study_frame_of(Roles(spark, sf, share=True))
    path = f"{ensure_checkpoint_dir(spark)}/study-frame-{uuid.uuid4().hex}.parquet"
    save(frame, path)
    back = load(spark, os.path.dirname(path), os.path.basename(path).removesuffix(".parquet"))
    return back.select("row_key", *[F.col(c).cast("long").alias(c) for c in ("exp", "periods", "event_itt", "time_hf")], "segment", "zone", "user_type",
                       "c_low", "weight_bl", "creatinine_bl")


# ---- follow-up and person-months ----------------------------------------------------------------

@check(with_roles(["span"], """SELECT person_id, arm, start_date, event_date, CAST(periods AS BIGINT) AS periods,
    CAST(event_itt AS BIGINT) AS event_itt FROM span"""))
def followup_time(spark: SparkSession, sf: str) -> DataFrame:
    return Roles(spark, sf).spans.withColumns({c: F.col(c).cast("long") for c in ("periods", "event_itt")})


@check(with_roles(["per"], """SELECT person_id, arm, start_date, CAST(time AS BIGINT) AS time, e AS interval_start,
    CAST(CASE WHEN time + 1 = periods AND event_itt = 1 THEN 1 ELSE 0 END AS BIGINT) AS event FROM per"""))
def person_months(spark: SparkSession, sf: str) -> DataFrame:
    long = reshape.expand_periods(Roles(spark, sf).spans, "periods", "start_date", event="event_itt")
    return long.select(*ROW, F.col("time").cast("long").alias("time"), "interval_start",
                       F.col("event").cast("long").alias("event"))


@check(with_roles(["per"], """SELECT arm, CAST(time AS BIGINT) AS time, COUNT(*) AS n, CAST(SUM(CASE WHEN time + 1 = periods
    AND event_itt = 1 THEN 1 ELSE 0 END) AS BIGINT) AS events FROM per GROUP BY 1, 2"""))
def event_flag(spark: SparkSession, sf: str) -> DataFrame:
    long = reshape.expand_periods(Roles(spark, sf).spans, "periods", event="event_itt")
    return long.groupBy("arm", F.col("time").cast("long").alias("time")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("event").cast("long").alias("events"))


_K = "person_id, arm, start_date, time"


def _tv(table: str, where: str, ts: str, order: str, cols: str) -> str:
    return f"""SELECT {_K}, {cols} FROM (SELECT p.person_id, p.arm, p.start_date, p.time, v.* EXCLUDE (person_id),
        ROW_NUMBER() OVER (PARTITION BY p.person_id, p.arm, p.start_date, p.time ORDER BY {order}) AS rn FROM per p
        JOIN {table} v ON p.person_id = v.person_id WHERE {ts} <= CAST(p.e AS TIMESTAMP) AND {where}) WHERE rn = 1"""


_TOUCH = """(p.s <= {a} AND {a} < p.e) OR (p.s <= {d} AND {d} < p.e) OR (p.e >= {a} AND p.e <= {d})"""


def _count(table: str, name: str) -> str:
    hit = _TOUCH.format(a="admit_ts", d="discharge_ts")
    return f"""SELECT p.person_id, p.arm, p.start_date, p.time, COUNT(h.person_id) AS {name} FROM per p LEFT JOIN {table} h
        ON p.person_id = h.person_id AND ({hit}) GROUP BY 1, 2, 3, 4"""


_TV_LABS = {"creatinine": "Creatinine", "potassium": "Potassium", "bnp": "BNP", "probnp": "NT-proBNP"}
TV = {
    "t_weight": _tv("vital", "kind = 'WEIGHT' AND value > 75 AND value < 700", "ts", "ts DESC, value DESC",
                    "CAST(CAST(value AS DECIMAL(10,1)) AS DOUBLE) AS weight_tv"),
    "t_bp": _tv("vital", "kind = 'BLOOD PRESSURE' AND systolic <> 0 AND diastolic <> 0 AND systolic > diastolic", "ts",
                "ts DESC, systolic DESC, diastolic DESC", "systolic AS sbp_tv, diastolic AS dbp_tv"),
    "t_ef": _tv("ef", "TRUE", "CAST(day AS TIMESTAMP)", "day DESC", "ROUND(ef, 9) AS lvef_tv"),
    **{f"t_{s}": _tv("lab", f"phenotype = '{p}'", "ts", "ts DESC, value DESC",
                     f"CAST(CAST(value AS DECIMAL(10,1)) AS DOUBLE) AS {s}_tv"
                     + (f", CAST(ts AS DATE) AS {s}_tv_dt" if p in plan.DATED_LABS else "")) for s, p in _TV_LABS.items()},
}
HOSP = {
    "t_hf0": _count("hf_stay", "hf_stays_tv"),
    "t_hf": f"SELECT *, CAST(SUM(hf_stays_tv) OVER (PARTITION BY person_id, arm, start_date ORDER BY time) AS BIGINT) "
            f"AS hf_stays_cum FROM t_hf0",
    "t_stay": _count("stay", "stays_tv"),
}
RX_TV = {"t_rx": f"""SELECT p.person_id, p.arm, p.start_date, p.time,
    MAX(CASE WHEN rx_class = 'STANDARD' THEN f.start_date END) AS rx_standard_tvdt,
    MAX(CASE WHEN rx_class = 'LARGE' THEN f.start_date END) AS rx_large_tvdt FROM per p JOIN fill f
    ON p.person_id = f.person_id AND ({_TOUCH.format(a='f.start_date', d='f.end_date')}) GROUP BY 1, 2, 3, 4"""}
RX_COLUMNS = {"standard": "rx_standard_tvdt", "large": "rx_large_tvdt"}


def _merge(parts: list[str], head: str = "p.person_id, p.arm, p.start_date, CAST(p.time AS BIGINT) AS time") -> str:
    cols = ", ".join(f"{t}.* EXCLUDE ({_K})" for t in parts)
    joins = " ".join(f"LEFT JOIN {t} ON p.person_id = {t}.person_id AND p.arm = {t}.arm AND p.start_date = {t}.start_date "
                     f"AND p.time = {t}.time" for t in parts)
    return f"SELECT {head}, {cols} FROM per p {joins}"


def _long_time(df: DataFrame) -> DataFrame:
    return df.withColumn("time", F.col("time").cast("long"))


@check(with_roles(["per", "vital", "lab", "ef"], _merge(["t_weight", "t_creatinine", "t_bnp"]), TV))
def tv_asof(spark: SparkSession, sf: str) -> DataFrame:
    r = Roles(spark, sf)
    labs = Latest(r.labs, "ts", {"creatinine_tv": F.col("value"), "bnp_tv": F.col("value")},
                  {"creatinine_tv": F.col("phenotype") == "Creatinine", "bnp_tv": F.col("phenotype") == "BNP"}, dates=["bnp_tv"])
    weight = Latest(r.vitals.where(plan.is_weight(STUDY)), "ts", {"weight_tv": F.col("value")})
    out = timeline(staged(r.spans), [weight, labs], "person_id", ROW, "start_date", "periods")
    return _long_time(out).withColumns({c: F.col(c).cast("decimal(10,1)").cast("double") for c in ("weight_tv", "creatinine_tv", "bnp_tv")})


@check(with_roles(["per", "stay", "hf_stay"], _merge(["t_hf", "t_stay"]), HOSP))
def tv_overlap_cumulative(spark: SparkSession, sf: str) -> DataFrame:
    r = Roles(spark, sf)
    hf = Touching(r.hf_stays, "admit_ts", "discharge_ts", "hf_stays_tv", "hf_stays_cum")
    every = Touching(r.stays, "admit_ts", "discharge_ts", "stays_tv")
    return _long_time(timeline(staged(r.spans), [hf, every], "person_id", ROW, "start_date", "periods"))


@check(with_roles(["per", "fill"], "SELECT person_id, arm, start_date, CAST(time AS BIGINT) AS time, rx_standard_tvdt, "
                  "rx_large_tvdt FROM t_rx", RX_TV))
def tv_overlap_pivot(spark: SparkSession, sf: str) -> DataFrame:
    r = Roles(spark, sf)
    return _long_time(overlap_pivot(r.spans, r.rx.withColumnRenamed("start_date", "rx_start"), "person_id", ROW,
                                    "start_date", "periods", "rx_start", "end_date", "rx_class", RX_COLUMNS))


# ---- device feed --------------------------------------------------------------------------------

# Signals: (name, text expression on value v and count k, number type).
_SIGNALS = [
    ("day_hr", "v", "decimal(10,0)"), ("night_hr", "k", "decimal(10,0)"), ("hrv", "v * 2", "decimal(10,0)"),
    ("fluid_index", "v + k", "decimal(10,0)"), ("activity_min", "k * 3", "decimal(10,0)"),
    ("at_af_ms", "k * 1000000", "decimal(20,0)"), ("vt_vf_cnt", "k", "decimal(10,0)"), ("nst_cnt", "v", "decimal(10,0)"),
    ("a_paced_pct", "k", "decimal(10,0)"), ("v_paced_pct", "v", "decimal(10,0)"),
]
_TEXT = ("CASE WHEN event_type = 'error' THEN 'NULL' WHEN event_type = 'signup' AND k > 50 THEN '' "
         "ELSE CAST(CAST(({x}) AS DECIMAL(18,2)) AS {t}) END")
_KEY = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"


def _device(r: Roles) -> DataFrame:
    ev = r.table("events", "user_id", "ts", "event_type", "value", "props").selectExpr(
        "user_id", "ts", "event_type", "value AS v", f"{_KEY} AS k")
    raw = ev.selectExpr("concat('S', user_id) AS serial", "cast(ts AS date) AS day", "event_type",
                        "CASE WHEN k > 70 THEN 'true' WHEN k > 20 THEN 'FALSE' ELSE '' END AS flag",
                        *[f"{_TEXT.format(x=x, t='STRING')} AS `{n}`" for n, x, _ in _SIGNALS])
    first = raw.where("event_type IN ('view', 'click')").select(
        F.col("serial").alias("Device Serial"), F.col("day").alias("TrendDate"), F.col("flag").alias("Annotation"),
        *[F.col(n).alias(f"{n} (text)") for n, _, _ in _SIGNALS])
    second = raw.where("event_type NOT IN ('view', 'click')").select(
        F.col("serial").alias("deviceserial"), F.col("day").alias("trenddate"), F.col("flag").alias("annotation"),
        *[F.col(n).alias(n.replace("_", "")) for n, _, _ in _SIGNALS])
    maps = [dev.signal_columns("Device Serial", "TrendDate", "Annotation",
                               {n: (f"`{n} (text)`", t) for n, _, t in _SIGNALS}),
            dev.signal_columns("deviceserial", "trenddate", "annotation",
                               {n: (n.replace("_", ""), t) for n, _, t in _SIGNALS})]
    log = ev.where("event_type = 'purchase'").selectExpr(
        "concat('S', user_id) AS serial", "ts AS event_ts", "1 AS n_atp", "CASE WHEN k > 50 THEN 1 ELSE 0 END AS n_shocks")
    owners = ev.select(F.concat(F.lit("S"), "user_id").alias("serial"), F.col("user_id").alias("person_id")).distinct()
    return dev.device_daily([first, second], maps, log, owners, millis={"at_af_ms": "at_af_min"})


_DEVICE_SQL = {
    "ev": f"SELECT user_id, ts, event_type, value AS v, {_KEY} AS k FROM events",
    "feed": "SELECT DISTINCT 'S' || user_id AS serial, user_id AS person_id, CAST(ts AS DATE) AS trend_date, "
            "CASE WHEN k > 70 THEN 1 WHEN k > 20 THEN 0 END AS transmission_flag, "
            + ", ".join(f"CASE WHEN event_type = 'error' OR (event_type = 'signup' AND k > 50) THEN NULL ELSE "
                        f"CAST(CAST(CAST(({x}) AS DECIMAL(18,2)) AS VARCHAR) AS {t}) END AS {n}" for n, x, t in _SIGNALS)
            + " FROM ev",
    "log": "SELECT 'S' || user_id AS serial, CAST(ts AS DATE) AS trend_date, COUNT(*) AS n_atp, "
           "SUM(CASE WHEN k > 50 THEN 1 ELSE 0 END) AS n_shocks FROM ev WHERE event_type = 'purchase' GROUP BY 1, 2",
    "daily": "SELECT f.* EXCLUDE (at_af_ms), CAST(at_af_ms / 60000 AS DECIMAL(10,0)) AS at_af_min, "
             "COALESCE(n_atp, 0) AS n_atp, COALESCE(n_shocks, 0) AS n_shocks FROM feed f LEFT JOIN log l "
             "ON f.serial = l.serial AND f.trend_date = l.trend_date",
}
_NUMBERS = ["transmission_flag", *[n for n, _, _ in _SIGNALS if n != "at_af_ms"], "at_af_min", "n_atp", "n_shocks"]


@check(with_roles([], "SELECT serial, person_id, trend_date, "
                  + ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in _NUMBERS) + " FROM daily", _DEVICE_SQL))
def device_daily(spark: SparkSession, sf: str) -> DataFrame:
    return _device(Roles(spark, sf)).select(
        "serial", "person_id", "trend_date", *[F.col(n).cast("long").alias(n) for n in _NUMBERS])


_AGG = {"sum": "CAST(SUM({c}) AS DOUBLE)", "mean": "ROUND(AVG(CAST({c} AS DOUBLE)), 6)", "max": "CAST(MAX({c}) AS DOUBLE)",
        "min": "CAST(MIN({c}) AS DOUBLE)"}


@check(with_roles([], "SELECT w.person_id, w.start_date, d.serial, CAST(w.time AS BIGINT) AS time, "
                  + ", ".join(f"{_AGG[f].format(c=c)} AS {n}" for c, f, n in dev.MONTHLY_SPEC)
                  + " FROM (SELECT person_id, start_date, t AS time, CAST(start_date + to_months(CAST(t AS INTEGER)) AS DATE)"
                    " AS e FROM (SELECT user_id AS person_id, CAST(MIN(ts) AS DATE) AS start_date, UNNEST(range(3)) AS t"
                    " FROM ev WHERE event_type = 'purchase' GROUP BY 1)) w JOIN daily d ON w.person_id = d.person_id"
                    " AND d.trend_date >= w.e - INTERVAL 1 MONTH AND d.trend_date < w.e GROUP BY 1, 2, 3, 4", _DEVICE_SQL))
def device_monthly(spark: SparkSession, sf: str) -> DataFrame:
    r = Roles(spark, sf)
    spans = r.table("events", "user_id", "ts", "event_type").where("event_type = 'purchase'").groupBy(
        F.col("user_id").alias("person_id")).agg(F.min("ts").cast("date").alias("start_date")).withColumn(
        "periods", F.lit(3))
    daily = _device(r)
    daily = daily.withColumns({c: F.col(c).cast("double") for c in _NUMBERS})
    out = dev.device_monthly(spans, daily, "person_id", ["person_id", "start_date"], "start_date", "periods")
    return _long_time(out).withColumns({n: F.round(n, 6) for _, f, n in dev.MONTHLY_SPEC if f == "mean"})


# ---- the person-month table -------------------------------------------------------------------------

# Columns of the records that the sources of the table read.
TV_RECORDS = ["site_id", "person_id", "arm", "rx_class", "drug_name", "code", "is_inpatient", "l_shipdate", "l_linenumber", "l_quantity",
              "l_extendedprice", "l_returnflag", "l_linestatus"]
# The device feed belongs to other years than the cohort: its days are moved back by 25 of them.
DEVICE_SHIFT = 9132
_SCALED = {n: t for n, t in plan.DEVICE_SCALES.items()}
_MONTH_AGG = {"sum": "SUM({c})", "mean": "AVG(CAST({c} AS DOUBLE))", "max": "MAX({c})", "min": "MIN({c})"}
DEVICE_TV = {"t_device": f"""SELECT {", ".join("p." + k for k in _K.split(", "))}, MAX(d.serial) AS serial, """ + ", ".join(
    "CAST(" + (f"CAST({_MONTH_AGG[f].format(c=c)} AS {_SCALED[n]})" if n in _SCALED else _MONTH_AGG[f].format(c=c)) + f" AS DOUBLE) AS {n}"
    for c, f, n in dev.MONTHLY_SPEC) + f""" FROM per p JOIN daily d ON p.person_id = d.person_id
    AND d.trend_date - {DEVICE_SHIFT} >= p.s AND d.trend_date - {DEVICE_SHIFT} < p.e GROUP BY 1, 2, 3, 4"""}


@check(with_roles(["per", "vital", "lab", "ef", "stay", "hf_stay"], f"""SELECT q.*, c.crossover_date FROM (
    {_merge([*TV, 't_hf', 't_stay', 't_rx', 't_device'], 'p.person_id, p.arm, p.start_date, CAST(p.time AS BIGINT) AS time, '
            'CAST(p.periods AS BIGINT) AS periods, p.e AS interval_start')}) q
    LEFT JOIN ({CROSS}) c ON q.person_id = c.person_id AND q.arm = c.arm AND q.start_date = c.start_date""",
                  {**FOLD, **TV, **HOSP, **RX_TV, **_DEVICE_SQL, **DEVICE_TV}))
def tv_table(spark: SparkSession, sf: str) -> DataFrame:
    r = Roles(spark, sf, share=TV_RECORDS)
    r.eligible = staged(r.eligible)
    episodes = stage_by(_episodes(r), ["person_id"])
    # The first day of the first episode is the first exposure day, so the starts are looked up among the episodes.
    opened = episodes.select("person_id", "arm", F.col("start_date").alias("release_ts"), F.col("days_total").alias("days_supply"))
    r.index = staged(E.exposure_starts(opened, r.eligible, "B", "A"))
    spans = staged(r.spans.withColumn("end_date", F.col("start_date")))
    daily = _device(r).withColumns({c: F.col(c).cast("double") for c in _NUMBERS}).withColumn("trend_date", F.date_sub("trend_date", DEVICE_SHIFT))
    out = plan.time_varying(spans, episodes, replace(r.sources, device=daily), STUDY, ["A", "B"], RX_COLUMNS).drop("end_date")
    decimals = [f.name for f in out.schema if f.dataType.typeName() == "decimal"]
    return _long_time(out).withColumns({
        **{c: F.col(c).cast("double") for c in decimals}, "periods": F.col("periods").cast("long"),
        "lvef_tv": F.round("lvef_tv", 9)})
