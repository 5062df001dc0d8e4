"""The given tables in the roles of a cohort study.

Each role exists twice: as a DataFrame (``Roles``) and as a SQL common table
expression (``CTE``), so that a check starts from the same inputs.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortweave.functions.dates import fiscal_quarter, fiscal_year, month_boundaries
from cohortweave.functions.text import match_patterns
from cohortweave.operators.codes import NameRule, code_set
from cohortweave.operators.episodes import exposure_days, exposure_fills, exposure_starts
from cohortweave.operators.phenotype import eligible_date, first_dates
from cohortweave.plans.cohort import Sources, Study, followup
from cohortweave.session import tune
from cohortweave.sources import load
from cohortweave.sources.tables import stage_by

CUTOFF = "2001-08-01"
FLOOR = "1996-01-01"

# Declared schemas of the given tables: no footer is read to plan a query.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
              "o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
}

HF_RULE = NameRule("HF", include=["brand#2_"])
CONDITION_RULES = [
    NameRule("C_low", include=["Brand#_"], exclude=["%#[7-9]"]),
    NameRule("C_ten", include=["Brand#1[0-4]"], exact=["BRAND#25"]),
    NameRule("C_twenty", include=["Brand#2%"], not_exact=["Brand#2"], minus=["C_ten"]),
]
STUDY = Study(
    cutoff=CUTOFF,
    conditions={"c_low": "c_low_dt", "c_ten": "c_ten_dt", "c_twenty": "c_twenty_dt"},
    rx_classes={"standard": "rx_standard_dt", "medium": "rx_medium_dt", "small": "rx_small_dt"},
)


class Roles:
    """Role tables of one data folder.

    With ``share``, the records that several sources read are written once as a stage table laid out by person; a list of
    columns writes these of ``rows`` only.
    """

    def __init__(self, spark: SparkSession, folder: str, share: bool | Sequence[str] = False) -> None:
        self.spark, self.folder, self.share = tune(spark), folder, share
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str, *columns: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = load(self.spark, self.folder, name, schema=SCHEMAS.get(name))
        return self._tables[name].select(*columns) if columns else self._tables[name]

    @cached_property
    def crosswalk(self) -> DataFrame:
        return self.table("orders", "o_orderkey", "o_custkey").select(
            F.col("o_orderkey").alias("site_id"), F.col("o_custkey").alias("person_id"))

    @cached_property
    def drugs(self) -> DataFrame:
        return self.table("part", "p_partkey", "p_type", "p_name", "p_brand").select(
            F.col("p_partkey").alias("drug_id"), F.col("p_type").alias("rx_class"), F.col("p_name").alias("drug_name"),
            F.col("p_brand").alias("code"), F.when(F.col("p_type") == "PROMO", "B").otherwise("A").alias("arm"))

    @cached_property
    def rows(self) -> DataFrame:
        """Site-level records: one per lineitem, with person, setting, drug columns and timestamps."""
        fact = self.table("lineitem").select(
            F.col("l_orderkey").alias("site_id"), F.col("l_partkey").alias("drug_id"), "l_suppkey", "l_linenumber",
            "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
        links = self.table("orders", "o_orderkey", "o_custkey", "o_orderstatus").select(
            F.col("o_orderkey").alias("site_id"), F.col("o_custkey").alias("person_id"), (F.col("o_orderstatus") == "F").alias("is_inpatient"))
        out = fact.join(links, "site_id").join(self.drugs, "drug_id")
        if self.share:
            out = stage_by(out if self.share is True else out.select(*self.share), ["person_id"])
        return out.withColumn("ts", F.expr("l_shipdate + make_dt_interval(0, l_linenumber - 1)"))

    def _records(self, *columns: str) -> list[str]:
        """Those of the columns that the records have."""
        return [c for c in columns if c in self.rows.columns]

    @cached_property
    def fills(self) -> DataFrame:
        return self.rows.where(F.col("l_shipdate") <= F.lit(CUTOFF).cast("timestamp_ntz")).select(
            "person_id", "arm", *self._records("rx_class", "drug_name"), F.col("l_shipdate").alias("release_ts"),
            F.col("l_quantity").cast("int").alias("days_supply"))

    @cached_property
    def diagnoses(self) -> DataFrame:
        return self.rows.select(*self._records("site_id"), "person_id", "code", "ts", F.col("l_shipdate").alias("visit_ts"), "l_linenumber", "is_inpatient")

    @cached_property
    def codes(self) -> DataFrame:
        """(concept, code) of the condition rules on the distinct codes of the dimension."""
        return code_set(self.table("part", "p_brand").distinct(), "p_brand", CONDITION_RULES).select(
            "concept", F.col("p_brand").alias("code"))

    @cached_property
    def first_hf(self) -> DataFrame:
        hf = self.diagnoses.where(match_patterns("code", HF_RULE.include)).withColumn(
            "day", F.when(F.col("is_inpatient"), F.col("ts")).otherwise(F.col("visit_ts")))
        return first_dates([(hf, "day")], name="hf_date")

    @cached_property
    def implants(self) -> DataFrame:
        return self.table("orders", "o_custkey", "o_orderdate").groupBy(F.col("o_custkey").alias("person_id")).agg(
            F.min("o_orderdate").cast("date").alias("implant_date"))

    @cached_property
    def eligible(self) -> DataFrame:
        return eligible_date(self.implants, self.first_hf, ["implant_date", "hf_date"], FLOOR)

    @cached_property
    def exposure(self) -> DataFrame:
        return exposure_fills(self.fills, self.eligible, "B", "A", columns=["drug_name"])

    @cached_property
    def exposure_days(self) -> DataFrame:
        return exposure_days(self.fills, self.eligible, "B", "A", columns=["drug_name"])

    @cached_property
    def index(self) -> DataFrame:
        """First exposure day per (person, arm)."""
        return exposure_starts(self.fills, self.eligible, "B", "A")

    @cached_property
    def stays(self) -> DataFrame:
        days = (F.col("o_orderkey") % 14).cast("int")
        out = F.expr("o_orderdate + make_dt_interval(cast(o_orderkey % 14 as int), 10)")
        return self.table("orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority").withColumn(
            "_d", days).select(
            F.col("o_orderkey").alias("stay_id"), F.col("o_custkey").alias("person_id"),
            F.col("o_orderdate").alias("admit_ts"),
            F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", out).alias("discharge_ts"))

    @cached_property
    def hf_stays(self) -> DataFrame:
        hf = self.diagnoses.where(match_patterns("code", HF_RULE.include) & F.col("l_linenumber").isin(1, 2, 3))
        marked = hf.select(F.col("site_id").alias("stay_id")).distinct()
        return self.stays.join(marked, "stay_id", "left_semi").select(
            "person_id", "admit_ts", "discharge_ts").distinct()

    @cached_property
    def vitals(self) -> DataFrame:
        kind = (F.when(F.col("l_returnflag") == "A", "WEIGHT").when(F.col("l_returnflag") == "N", "HEIGHT")
                .otherwise("BLOOD PRESSURE"))
        value = F.when(F.col("l_returnflag") == "A", F.col("l_extendedprice") / 128).otherwise(
            F.col("l_quantity") + 40)
        return self.rows.select(
            "person_id", kind.alias("kind"), "ts", value.alias("value"),
            (F.col("l_quantity") + 50).alias("systolic"), (F.col("l_linenumber") * 12.0).alias("diastolic"))

    @cached_property
    def labs(self) -> DataFrame:
        both = F.concat("l_returnflag", "l_linestatus")
        phenotype = (F.when(both == "AF", "Creatinine").when(both == "AO", "BNP").when(both == "NF", "NT-proBNP")
                     .when(both == "NO", "Potassium").when(both == "RF", "Albumin").otherwise("Hemoglobin"))
        return self.rows.select("person_id", phenotype.alias("phenotype"), "ts",
                                (F.col("l_quantity") / 8).alias("value"))

    @cached_property
    def smoking(self) -> DataFrame:
        status = (F.when(F.col("rx_class") == "SMALL", "CURRENT SMOKER")
                  .when(F.col("rx_class") == "MEDIUM", "former smoker")
                  .when(F.col("rx_class") == "LARGE", "NEVER SMOKER").otherwise("UNKNOWN"))
        return self.rows.select("person_id", "ts", status.alias("status"))

    @cached_property
    def addresses(self) -> DataFrame:
        undated = (F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "P")
        return self.table("orders").select(
            F.col("o_custkey").alias("person_id"), F.when(~undated, F.col("o_orderdate")).alias("updated"),
            F.col("o_orderkey").alias("zip"), F.col("o_orderpriority").alias("urh"))

    @cached_property
    def concept_records(self) -> DataFrame:
        # A few (concept, code) pairs: never the records of a code in one place.
        return self.diagnoses.join(F.broadcast(self.codes), "code").select(
            "person_id", "concept", "ts", "visit_ts", "is_inpatient")

    @cached_property
    def rx(self) -> DataFrame:
        start = F.col("release_ts").cast("date")
        return self.fills.select("person_id", "rx_class", start.alias("start_date"),
                                 F.date_add(start, F.col("days_supply")).alias("end_date"))

    @cached_property
    def flu(self) -> DataFrame:
        return self.rows.where(F.col("rx_class") == "ECONOMY").select("person_id", "ts")

    @cached_property
    def homes(self) -> DataFrame:
        return self.table("customer", "c_custkey", "c_nationkey").select(F.col("c_custkey").alias("person_id"), F.col("c_nationkey").alias("geo"))

    @cached_property
    def area(self) -> DataFrame:
        """Shipped quantity per nation, fiscal quarter and return flag."""
        return self.rows.join(self.homes, "person_id").groupBy(
            "geo", fiscal_year("l_shipdate").alias("fiscal_year"), fiscal_quarter("l_shipdate").alias("quarter"),
            "l_returnflag").agg(F.sum("l_quantity").alias("rank")).select("geo", "fiscal_year", "quarter", "rank")

    @cached_property
    def ejection(self) -> DataFrame:
        return self.rows.where(F.col("rx_class") == "STANDARD").select(
            "person_id", "ts", (F.col("l_quantity") + 10).alias("value"))

    @cached_property
    def demographics(self) -> DataFrame:
        return self.table("customer", "c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey").select(
            F.col("c_custkey").alias("person_id"), F.col("c_acctbal").alias("balance"),
            F.col("c_mktsegment").alias("segment"), (F.col("c_nationkey") % 5).cast("string").alias("zone"))

    @cached_property
    def sources(self) -> Sources:
        records = self.concept_records
        return Sources(
            demographics=self.demographics, vitals=self.vitals, labs=self.labs, smoking=self.smoking,
            addresses=self.addresses, inpatient=records.where("is_inpatient"),
            outpatient=records.where(~F.col("is_inpatient")), rx=self.rx, stays=self.stays, hf_stays=self.hf_stays,
            flu=self.flu, homes=self.homes, area=self.area, ejection=self.ejection)

    @cached_property
    def spans(self) -> DataFrame:
        """Index rows with the first urgent order after the start as event, and periods to it or the cut-off."""
        urgent = self.table("orders", "o_custkey", "o_orderdate", "o_orderpriority").where(
            F.col("o_orderpriority") == "1-URGENT").select(
            F.col("o_custkey").alias("person_id"), F.col("o_orderdate").cast("date").alias("_day")).distinct()
        event = (self.index.join(urgent, "person_id").where(F.col("_day") > F.col("start_date"))
                 .groupBy("person_id", "arm", "start_date").agg(F.min("_day").alias("event_date")))
        return followup(self.index.join(event, ["person_id", "arm", "start_date"], "left"),
                        "start_date", "event_date", CUTOFF)

    @cached_property
    def analysis(self) -> DataFrame:
        """Modelling frame: exposure, follow-up and a few covariates per (person, arm)."""
        prior = (self.stays.groupBy("person_id", F.col("admit_ts").cast("date").alias("_day"))
                 .agg(F.count(F.lit(1)).alias("_n")).join(self.index, "person_id")
                 .where(F.col("_day") < F.col("start_date")).groupBy("person_id", "arm")
                 .agg(F.sum("_n").alias("prior_stays")))
        return (self.spans.join(self.demographics, "person_id").join(prior, ["person_id", "arm"], "left").select(
            F.concat_ws("|", F.col("person_id").cast("string"), "arm").alias("row_key"), "person_id", "arm",
            "start_date", F.when(F.col("arm") == "B", 1).otherwise(0).alias("exp"), "periods", "event_itt", "balance",
            "segment", "zone", F.coalesce("prior_stays", F.lit(0)).alias("prior_stays"),
            month_boundaries(F.lit(FLOOR).cast("date"), "start_date").alias("trial_num")))


# ---- the same roles in SQL -----------------------------------------------------

CTE: dict[str, tuple[list[str], str]] = {
    "xw": ([], "SELECT o_orderkey AS site_id, o_custkey AS person_id FROM orders"),
    "drug": ([], """SELECT p_partkey AS drug_id, p_type AS rx_class, p_name AS drug_name, p_brand AS code,
        CASE WHEN p_type = 'PROMO' THEN 'B' ELSE 'A' END AS arm FROM part"""),
    "rw": (["xw", "drug"], """SELECT l.*, x.person_id, d.*, l_shipdate + to_hours(l_linenumber - 1) AS ts
        FROM lineitem l JOIN xw x ON l.l_orderkey = x.site_id JOIN drug d ON l.l_partkey = d.drug_id"""),
    "fill": (["rw"], f"""SELECT person_id, arm, rx_class, drug_name, l_shipdate AS release_ts,
        CAST(l_quantity AS INTEGER) AS days_supply, CAST(l_shipdate AS DATE) AS start_date,
        CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER) AS end_date
        FROM rw WHERE l_shipdate <= TIMESTAMP '{CUTOFF}'"""),
    "dx": (["drug"], """SELECT l_orderkey AS site_id, o_custkey AS person_id, d.code, l_linenumber,
        l_shipdate + to_hours(l_linenumber - 1) AS ts, l_shipdate AS visit_ts, o_orderstatus = 'F' AS is_inpatient
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN drug d ON l_partkey = d.drug_id"""),
    "codes": ([], """SELECT 'C_low' AS concept, code FROM (SELECT DISTINCT p_brand AS code FROM part)
        WHERE regexp_full_match(code, 'Brand#.') AND NOT regexp_full_match(code, '.*#[7-9]')
        UNION SELECT 'C_ten', code FROM (SELECT DISTINCT p_brand AS code FROM part)
        WHERE regexp_full_match(code, 'Brand#1[0-4]') OR code = 'Brand#25'
        UNION SELECT 'C_twenty', code FROM (SELECT DISTINCT p_brand AS code FROM part)
        WHERE code LIKE 'Brand#2%' AND code <> 'Brand#2' AND NOT (regexp_full_match(code, 'Brand#1[0-4]')
              OR code = 'Brand#25')"""),
    "hf_first": (["dx"], """SELECT person_id, MIN(CAST(CASE WHEN is_inpatient THEN ts ELSE visit_ts END AS DATE))
        AS hf_date FROM dx WHERE code LIKE 'Brand#2_' GROUP BY person_id"""),
    "implant": ([], """SELECT o_custkey AS person_id, CAST(MIN(o_orderdate) AS DATE) AS implant_date FROM orders
        GROUP BY o_custkey"""),
    "elig": (["hf_first", "implant"], f"""SELECT i.person_id, implant_date, hf_date,
        GREATEST(implant_date, hf_date, DATE '{FLOOR}') AS eligible_date
        FROM implant i LEFT JOIN hf_first h ON i.person_id = h.person_id"""),
    "expo": (["fill", "elig"], """SELECT DISTINCT f.person_id, f.arm, release_ts, days_supply, start_date, end_date,
        drug_name FROM fill f JOIN elig e ON f.person_id = e.person_id
        WHERE (f.arm = 'A' AND release_ts >= eligible_date)
           OR (f.arm = 'B' AND (SELECT MIN(g.start_date) FROM fill g WHERE g.person_id = f.person_id AND g.arm = 'B')
               >= eligible_date)"""),
    "ix": (["expo"], """SELECT person_id, arm, MIN(start_date) AS start_date FROM expo GROUP BY person_id, arm"""),
    "stay": ([], """SELECT o_orderkey AS stay_id, o_custkey AS person_id, o_orderdate AS admit_ts,
        CASE WHEN o_orderpriority <> '4-NOT SPECIFIED'
             THEN o_orderdate + to_days(CAST(o_orderkey % 14 AS INTEGER)) + to_hours(10) END AS discharge_ts
        FROM orders"""),
    "hf_stay": (["stay", "dx"], """SELECT DISTINCT person_id, admit_ts, discharge_ts FROM stay WHERE stay_id IN
        (SELECT site_id FROM dx WHERE code LIKE 'Brand#2_' AND l_linenumber IN (1, 2, 3))"""),
    "vital": (["rw"], """SELECT person_id, CASE l_returnflag WHEN 'A' THEN 'WEIGHT' WHEN 'N' THEN 'HEIGHT'
        ELSE 'BLOOD PRESSURE' END AS kind, ts,
        CASE WHEN l_returnflag = 'A' THEN l_extendedprice / 128 ELSE l_quantity + 40 END AS value,
        l_quantity + 50 AS systolic, l_linenumber * 12.0::DOUBLE AS diastolic FROM rw"""),
    "lab": (["rw"], """SELECT person_id, CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'Creatinine'
        WHEN 'AO' THEN 'BNP' WHEN 'NF' THEN 'NT-proBNP' WHEN 'NO' THEN 'Potassium' WHEN 'RF' THEN 'Albumin'
        ELSE 'Hemoglobin' END AS phenotype, ts, l_quantity / 8 AS value FROM rw"""),
    "smoke": (["rw"], """SELECT person_id, ts, CASE rx_class WHEN 'SMALL' THEN 'CURRENT SMOKER'
        WHEN 'MEDIUM' THEN 'former smoker' WHEN 'LARGE' THEN 'NEVER SMOKER' ELSE 'UNKNOWN' END AS status FROM rw"""),
    "addr": ([], """SELECT o_custkey AS person_id, CASE WHEN NOT (o_orderpriority = '5-LOW' AND o_orderstatus = 'P')
        THEN CAST(o_orderdate AS DATE) END AS updated, o_orderkey AS zip, o_orderpriority AS urh FROM orders"""),
    "rec": (["dx", "codes"], """SELECT person_id, concept, ts, visit_ts, is_inpatient FROM dx
        JOIN codes ON dx.code = codes.code"""),
    "ef": (["rw"], """SELECT person_id, CAST(ts AS DATE) AS day, AVG(value) AS ef FROM
        (SELECT DISTINCT person_id, CAST(ts AS DATE) AS ts, l_quantity + 10 AS value FROM rw
         WHERE rx_class = 'STANDARD') GROUP BY 1, 2"""),
    "area": (["rw"], """SELECT c.c_custkey AS person_id, s.fiscal_year, s.quarter, s.rank FROM customer c JOIN
        (SELECT c_nationkey, YEAR(l_shipdate + INTERVAL 3 MONTH) AS fiscal_year,
                'Q' || QUARTER(l_shipdate + INTERVAL 3 MONTH) AS quarter, l_returnflag, SUM(l_quantity) AS rank
         FROM rw JOIN customer ON c_custkey = person_id GROUP BY 1, 2, 3, 4) s ON s.c_nationkey = c.c_nationkey"""),
    "demo": ([], """SELECT c_custkey AS person_id, c_acctbal AS balance, c_mktsegment AS segment,
        CAST(c_nationkey % 5 AS VARCHAR) AS zone FROM customer"""),
    "span": (["ix"], f"""SELECT person_id, arm, start_date, event_date,
        date_diff('month', start_date, COALESCE(event_date, DATE '{CUTOFF}')) + 1 AS periods,
        CASE WHEN event_date IS NOT NULL THEN 1 ELSE 0 END AS event_itt
        FROM (SELECT i.*, (SELECT MIN(CAST(o_orderdate AS DATE)) FROM orders WHERE o_custkey = i.person_id
                           AND o_orderpriority = '1-URGENT' AND CAST(o_orderdate AS DATE) > i.start_date) AS event_date
              FROM ix i)"""),
    "per": (["span"], """SELECT person_id, arm, start_date, periods, event_itt, CAST(t AS INTEGER) AS time,
        CAST(start_date + to_months(CAST(t AS INTEGER)) AS DATE) AS e,
        CAST(CAST(start_date + to_months(CAST(t AS INTEGER)) AS DATE) - INTERVAL 1 MONTH AS DATE) AS s
        FROM (SELECT *, UNNEST(range(periods)) AS t FROM span)"""),
    "ana": (["span", "demo", "stay"], f"""SELECT CAST(s.person_id AS VARCHAR) || '|' || arm AS row_key, s.person_id, arm,
        start_date, CASE WHEN arm = 'B' THEN 1 ELSE 0 END AS exp, periods, event_itt, balance, segment, zone,
        (SELECT COUNT(*) FROM stay y WHERE y.person_id = s.person_id AND CAST(admit_ts AS DATE) < start_date)
        AS prior_stays, date_diff('month', DATE '{FLOOR}', start_date) AS trial_num
        FROM span s JOIN demo d ON s.person_id = d.person_id"""),
}


def with_roles(roles: list[str], final: str, extra: dict[str, str] | None = None) -> str:
    """SQL text: the named roles (and what they need), extra expressions, then the final query."""
    order: list[str] = []

    def need(name: str) -> None:
        for dep in CTE[name][0]:
            need(dep)
        if name not in order:
            order.append(name)

    for r in roles:
        need(r)
    parts = [f"{n} AS ({CTE[n][1]})" for n in order]
    parts += [f"{n} AS ({q})" for n, q in (extra or {}).items()]
    return f"WITH RECURSIVE {', '.join(parts)} {final}" if parts else final
