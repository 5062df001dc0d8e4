"""Checks of features, weights, balance, outcome models, bootstrap and boosting."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cohortweave.catalog import cohorts as C
from cohortweave.catalog.registry import check
from cohortweave.catalog.roles import Roles, with_roles
from cohortweave.functions.rows import inverse_logit
from cohortweave.operators.reshape import expand_periods, grid
from cohortweave.operators.summaries import percentile_interval
from cohortweave.session import ensure_checkpoint_dir, staged
from cohortweave.sources.tables import save_tsv
from cohortweave.stats import balance as B, boosted as M, boosting as G, bootstrap as BS, features as X, outcome as O, weights as W

TERMS = [
    X.Term("trial_num", "spline"), X.Term("balance", "spline"), X.Term("prior_stays", "numeric"),
    X.Term("segment", "category", ref="BUILDING"), X.Term("zone", "category", ref="0"),
]
GBT_TERMS = [X.Term("trial_num"), X.Term("balance"), X.Term("prior_stays"), X.Term("segment", "category"),
             X.Term("zone", "category")]
# The final fit in tenth the trees with ten times the step: summed steps of 10 as in FINAL_PARAMS.
GBT_PARAMS = {**G.FINAL_PARAMS, "trees": G.FINAL_PARAMS["trees"] // 10, "shrinkage": G.FINAL_PARAMS["shrinkage"] * 10}
# Trees that a search may grow, and the trees without gain after which it ends.
TUNE_TREES, TUNE_PATIENCE = 150, 15
REPLICATES, BOOSTED_REPLICATES = 500, 50


def _rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})


# ---- features -------------------------------------------------------------------------

@check("""SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_shipdate, ROUND(age, 9) AS age, ROUND(bmi, 9) AS bmi,
    CASE WHEN bmi < 18.5 THEN 'under' WHEN bmi < 25 THEN 'normal' WHEN bmi < 30 THEN 'over' ELSE 'obese' END AS bmi_cat,
    ROUND(142 * POW(LEAST(cr / k, 1), a) * POW(GREATEST(cr / k, 1), -1.2) * POW(0.9938, age) * f, 6) AS egfr,
    returned, CAST(trial_num AS BIGINT) AS trial_num, year_index FROM (
    SELECT *, date_diff('day', DATE '1950-03-01', CAST(l_shipdate AS DATE)) / 365.25 AS age,
      (l_extendedprice / 250) * 703 / POW(58 + l_linenumber * 2, 2) AS bmi, l_quantity / 10 AS cr,
      CASE WHEN l_returnflag = 'A' THEN 0.7 ELSE 0.9 END AS k, CASE WHEN l_returnflag = 'A' THEN -0.241 ELSE -0.302 END AS a,
      CASE WHEN l_returnflag = 'A' THEN 1.012 ELSE 1 END AS f, CASE WHEN l_discount > 0.05 THEN 'Yes' ELSE 'No' END AS returned,
      date_diff('month', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS trial_num,
      CAST(YEAR(l_shipdate) AS BIGINT) AS year_index FROM lineitem)""")
def baseline_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = Roles(spark, sf).table("lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_shipdate",
                                  "l_extendedprice", "l_quantity", "l_returnflag", "l_discount").withColumns({
        "start": F.col("l_shipdate").cast("date"), "birth": F.lit("1950-03-01").cast("date"),
        "study_start": F.lit("1995-01-01").cast("date"), "weight": F.col("l_extendedprice") / 250,
        "height": 58 + F.col("l_linenumber") * 2, "creatinine": F.col("l_quantity") / 10,
        "flag_dt": F.when(F.col("l_discount") > 0.05, F.col("l_shipdate"))})
    out = X.baseline_features(rows, {
        "age": X.age_years("birth", "start"), "bmi": X.body_mass_index("weight", "height"),
        "bmi_cat": X.cut("bmi", [18.5, 25, 30], ["under", "normal", "over", "obese"]),
        "egfr": X.egfr_2021("creatinine", "age", F.col("l_returnflag") == "A"), "returned": X.known_flag("flag_dt"),
        "trial_num": X.months_to("study_start", "start").cast("long"), "year_index": F.year("start").cast("long")})
    return out.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_shipdate", F.round("age", 9).alias("age"),
                      F.round("bmi", 9).alias("bmi"), "bmi_cat", F.round("egfr", 6).alias("egfr"), "returned",
                      "trial_num", "year_index")


@check("""SELECT o_orderkey, COALESCE(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END, (SELECT
    quantile_cont(o_totalprice, 0.5) FROM orders WHERE o_orderstatus <> 'P')) AS price FROM orders""")
def median_impute(spark: SparkSession, sf: str) -> DataFrame:
    orders = Roles(spark, sf).table("orders", "o_orderkey", "o_orderstatus", "o_totalprice").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("price"))
    return X.median_impute(orders, ["price"])


@check("""SELECT c_custkey, CAST(c_mktsegment = 'AUTOMOBILE' AS INT)::DOUBLE AS automobile,
    CAST(c_mktsegment = 'FURNITURE' AS INT)::DOUBLE AS furniture, CAST(c_mktsegment = 'HOUSEHOLD' AS INT)::DOUBLE
    AS household, CAST(c_mktsegment = 'MACHINERY' AS INT)::DOUBLE AS machinery FROM customer""")
def encode_levels(spark: SparkSession, sf: str) -> DataFrame:
    df = Roles(spark, sf).table("customer", "c_custkey", "c_mktsegment")
    d = X.design(df, [X.Term("c_mktsegment", "category", ref="BUILDING")])
    return df.select("c_custkey", *[c.alias(n.split("=")[1].lower()) for n, c in zip(d.names, d.columns)])


@check("""SELECT c_custkey, COALESCE(CAST(s = 'AUTOMOBILE' AS INT), 0)::DOUBLE AS automobile, COALESCE(CAST(s = 'MACHINERY' AS INT), 0)::DOUBLE AS machinery,
    CAST(s IS NULL AS INT)::DOUBLE AS missing FROM (SELECT c_custkey, CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS s FROM customer
    WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY'))""")
def encode_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Missing categories have a column of their own beside declared levels."""
    df = Roles(spark, sf).table("customer", "c_custkey", "c_mktsegment", "c_nationkey").where(F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING", "MACHINERY"))
    df = df.withColumn("s", F.when(F.col("c_nationkey") % 5 != 0, F.col("c_mktsegment")))
    d = X.design(df, [X.Term("s", "category", levels=["AUTOMOBILE", "BUILDING", "MACHINERY"], ref="BUILDING")])
    return df.select("c_custkey", *[c.alias(n.removeprefix("s=").removeprefix("s ").lower()) for n, c in zip(d.names, d.columns)])


_CUBE = "POW(GREATEST({u} - {k}, 0), 3)"


def _bend(k: str) -> str:
    return f"(({_CUBE.format(u='u', k=k)} - {_CUBE.format(u='u', k='1')}) / (1 - {k}))"


@check(f"""WITH q AS (SELECT MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi, quantile_cont(o_totalprice, 1/3) AS a,
    quantile_cont(o_totalprice, 2/3) AS b FROM orders), z AS (SELECT o_orderkey, (o_totalprice - lo) / (hi - lo) AS u,
    (a - lo) / (hi - lo) AS za, (b - lo) / (hi - lo) AS zb FROM orders, q)
    SELECT o_orderkey, ROUND(u, 8) AS s1, ROUND({_bend('0')} - {_bend('zb')}, 8) AS s2,
    ROUND({_bend('za')} - {_bend('zb')}, 8) AS s3 FROM z""")
def ns_basis(spark: SparkSession, sf: str) -> DataFrame:
    df = Roles(spark, sf).table("orders", "o_orderkey", "o_totalprice")
    d = X.design(df, [X.Term("o_totalprice", "spline", df=3)])
    return df.select("o_orderkey", *[F.round(c, 8).alias(f"s{i + 1}") for i, c in enumerate(d.columns)])


# ---- balance -------------------------------------------------------------------------------

_T1 = {
    "s": "SELECT arm AS stratum, balance, periods, segment, zone FROM ana UNION ALL "
         "SELECT 'Overall', balance, periods, segment, zone FROM ana",
    "num": """SELECT stratum, COUNT(*) AS n, AVG(balance) AS mean, STDDEV_SAMP(balance) AS sd, quantile_cont(periods, 0.25) AS q1,
        quantile_cont(periods, 0.5) AS median, quantile_cont(periods, 0.75) AS q3 FROM s GROUP BY 1""",
    "cat": """SELECT variable, level, stratum, COUNT(*)::DOUBLE AS n, SUM(COUNT(*)) OVER (PARTITION BY variable, stratum)
        AS total FROM (SELECT stratum, 'segment' AS variable, segment AS level FROM s UNION ALL
        SELECT stratum, 'zone', zone FROM s) GROUP BY 1, 2, 3""",
}


@check(with_roles(["ana"], """SELECT variable, level, stratum, stat, ROUND(value, 6) AS value FROM (
    SELECT 'balance' AS variable, '' AS level, stratum, 'mean' AS stat, mean AS value FROM num
    UNION ALL SELECT 'balance', '', stratum, 'sd', sd FROM num UNION ALL SELECT 'balance', '', stratum, 'n', n FROM num
    UNION ALL SELECT 'balance', '', stratum, 'missing_pct', 0 FROM num
    UNION ALL SELECT 'periods', '', stratum, 'n', n FROM num UNION ALL SELECT 'periods', '', stratum, 'missing_pct', 0 FROM num
    UNION ALL SELECT 'periods', '', stratum, 'q1', q1 FROM num UNION ALL SELECT 'periods', '', stratum, 'median', median
    FROM num UNION ALL SELECT 'periods', '', stratum, 'q3', q3 FROM num
    UNION ALL SELECT variable, level, stratum, 'count', n FROM cat
    UNION ALL SELECT variable, level, stratum, 'percent', 100.0 * n / total FROM cat)""", _T1))
def table_one(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(B.table_one(staged(Roles(spark, sf).analysis), "arm", ["balance"], ["periods"], ["segment", "zone"]), 6)


@check(with_roles(["ana"], """SELECT variable, level, stratum, stat, CAST(ROUND(value, 6) AS DOUBLE) AS value FROM (
    SELECT 'balance' AS variable, '' AS level, stratum, 'mean' AS stat, mean AS value FROM num UNION ALL SELECT 'balance', '', stratum, 'sd', sd FROM num
    UNION ALL SELECT 'balance', '', stratum, 'n', n FROM num UNION ALL SELECT 'balance', '', stratum, 'missing_pct', 0 FROM num
    UNION ALL SELECT variable, level, stratum, 'count', n FROM cat UNION ALL SELECT variable, level, stratum, 'percent', 100.0 * n / total FROM cat)""", _T1))
def table_one_tsv(spark: SparkSession, sf: str) -> DataFrame:
    """Table 1 written as dated tab-separated text without a header, and read back."""
    table = _rounded(B.table_one(staged(Roles(spark, sf).analysis), "arm", ["balance"], [], ["segment", "zone"]), 6).select(
        "variable", "level", "stratum", "stat", "value")
    path = save_tsv(table, f"{ensure_checkpoint_dir(spark)}/table-one-{uuid.uuid4().hex}.tsv", date(2024, 1, 31))
    back = spark.read.option("sep", "\t").schema("variable string, level string, stratum string, stat string, value double").csv(path)
    return back.withColumn("level", F.coalesce("level", F.lit("")))


_PS = {
    "ps": """SELECT a.*, AVG(exp) OVER (PARTITION BY segment, zone) AS pd, AVG(exp) OVER () AS pn FROM ana a""",
    "wt": "SELECT *, CASE WHEN exp = 1 THEN pn / pd ELSE (1 - pn) / (1 - pd) END AS iptw FROM ps",
}


def _weighted(r: Roles) -> DataFrame:
    return W.iptw(W.ps_saturated(staged(r.analysis), "exp", ["segment", "zone"]), "exp")


@check(with_roles(["ana"], "SELECT row_key, ROUND(pd, 9) AS pd FROM ps", _PS))
def ps_saturated(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(W.ps_saturated(staged(Roles(spark, sf).analysis), "exp", ["segment", "zone"]).select("row_key", "pd"))


@check(with_roles(["ana"], "SELECT row_key, ROUND(pn, 9) AS pn, ROUND(pd, 9) AS pd, ROUND(iptw, 9) AS iptw FROM wt", _PS))
def iptw(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_weighted(Roles(spark, sf)).select("row_key", "pn", "pd", "iptw"))


@check(with_roles(["ana"], """SELECT arm, CAST(FLOOR(pd / 0.025) AS BIGINT) AS bin, COUNT(*) AS n,
    ROUND(FLOOR(pd / 0.025) * 0.025, 6) AS bin_start FROM ps GROUP BY 1, 2, 4""", _PS))
def ps_histogram(spark: SparkSession, sf: str) -> DataFrame:
    ps = W.ps_saturated(staged(Roles(spark, sf).analysis), "exp", ["segment", "zone"])
    return _rounded(B.histogram(ps, "pd", 0.025, ["arm"]), 6)


def _smd_sql(w: str) -> str:
    def moments(col: str) -> str:
        return f"""SELECT '{col}' AS variable, exp, SUM({w} * {col}) / SUM({w}) AS m,
            (SUM({w} * {col} * {col}) / SUM({w}) - POW(SUM({w} * {col}) / SUM({w}), 2)) * COUNT(*) / (COUNT(*) - 1) AS v
            FROM wt GROUP BY exp"""
    return f"""SELECT variable, ROUND(ABS(m1 - m0) / SQRT((v1 + v0) / 2), 6) AS smd FROM (
        SELECT variable, MAX(CASE WHEN exp = 1 THEN m END) AS m1, MAX(CASE WHEN exp = 0 THEN m END) AS m0,
        MAX(CASE WHEN exp = 1 THEN v END) AS v1, MAX(CASE WHEN exp = 0 THEN v END) AS v0 FROM (
        {moments('balance')} UNION ALL {moments('prior_stays')} UNION ALL {moments('trial_num')}
        UNION ALL SELECT 'built', exp, p, p * (1 - p) FROM (SELECT exp, SUM(CASE WHEN segment = 'BUILDING' THEN {w} ELSE 0 END)
            / SUM({w}) AS p FROM wt GROUP BY exp)) GROUP BY variable)"""


_NUMERIC = ["balance", "prior_stays", "trial_num"]


def _with_flag(df: DataFrame) -> DataFrame:
    return df.withColumn("built", F.when(F.col("segment") == "BUILDING", "Yes").otherwise("No"))


@check(with_roles(["ana"], _smd_sql("1.0::DOUBLE"), _PS))
def smd_unweighted(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(B.smd(_with_flag(staged(Roles(spark, sf).analysis)), "exp", _NUMERIC, ["built"]), 6)


@check(with_roles(["ana"], _smd_sql("iptw"), _PS))
def smd_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(B.smd(_with_flag(_weighted(Roles(spark, sf))), "exp", _NUMERIC, ["built"], "iptw"), 6)


@check(with_roles(["ana"], f"""SELECT variable, 'unadjusted' AS method, smd FROM ({_smd_sql('1.0::DOUBLE')})
    UNION ALL SELECT variable, 'weighted', smd FROM ({_smd_sql('iptw')})""", _PS))
def smd_long(spark: SparkSession, sf: str) -> DataFrame:
    df = _with_flag(_weighted(Roles(spark, sf)))
    return _rounded(B.smd_long({"unadjusted": B.smd(df, "exp", _NUMERIC, ["built"]),
                                "weighted": B.smd(df, "exp", _NUMERIC, ["built"], "iptw")}), 6)


def _smd_category_sql(method: str, w: str) -> str:
    """The covariance of level shares is a diagonal less two outer products, so its inverse is a 2 x 2 one."""
    shares = " UNION ALL ".join(f"""SELECT '{v}' AS variable, {v} AS level, SUM(CASE WHEN exp = 1 THEN {w} ELSE 0 END) AS t1,
        SUM(CASE WHEN exp = 0 THEN {w} ELSE 0 END) AS t0 FROM wt GROUP BY 2""" for v in ("segment", "zone"))
    return f"""SELECT variable, '{method}' AS method, ROUND(SQRT(GREATEST(dd + (m22 * v1 * v1 - 2 * m12 * v1 * v0 + m11 * v0 * v0)
        / (m11 * m22 - m12 * m12), 0)), 5) AS smd FROM (
        SELECT variable, SUM((p1 - p0) * (p1 - p0) / d) AS dd, 1 - SUM(p1 * p1 / d) / 2 AS m11, -SUM(p1 * p0 / d) / 2 AS m12,
          1 - SUM(p0 * p0 / d) / 2 AS m22, SUM(p1 * (p1 - p0) / d) / SQRT(2) AS v1, SUM(p0 * (p1 - p0) / d) / SQRT(2) AS v0
        FROM (SELECT *, (p1 + p0) / 2 AS d FROM (SELECT variable, level, t1 / SUM(t1) OVER (PARTITION BY variable) AS p1,
              t0 / SUM(t0) OVER (PARTITION BY variable) AS p0, ROW_NUMBER() OVER (PARTITION BY variable ORDER BY level) AS k
              FROM ({shares}))) WHERE k > 1 GROUP BY variable)"""


@check(with_roles(["ana"], f"{_smd_category_sql('unadjusted', '1.0::DOUBLE')} UNION ALL {_smd_category_sql('weighted', 'iptw')}", _PS))
def smd_categories(spark: SparkSession, sf: str) -> DataFrame:
    """Mahalanobis form for variables with several levels (a matrix inverse)."""
    df, variables = _weighted(Roles(spark, sf)), ["segment", "zone"]
    return _rounded(B.smd_long({"unadjusted": B.smd(df, "exp", (), variables),
                                "weighted": B.smd(df, "exp", (), variables, "iptw")}), 5)


# ---- scores and outcome ----------------------------------------------------------------------

@check()
def ps_logistic(spark: SparkSession, sf: str) -> DataFrame:
    df = staged(Roles(spark, sf).analysis)
    return W.iptw(W.ps_logistic(df, "exp", X.design(df, TERMS)), "exp").select("row_key", "exp", "pn", "pd", "iptw")


@check(with_roles(["ana"], """SELECT 'segment=' || segment AS term, ROUND(SUM(exp), 2)::DOUBLE AS total FROM ana GROUP BY 1
    UNION ALL SELECT 'zone=' || zone, ROUND(SUM(exp), 2)::DOUBLE FROM ana GROUP BY 1
    UNION ALL SELECT 'prior_stays', ROUND(SUM(exp * prior_stays), 2)::DOUBLE FROM ana
    UNION ALL SELECT 'balance', ROUND(SUM(exp * balance) / 1000, 2) FROM ana
    UNION ALL SELECT 'trial_num', ROUND(SUM(exp * trial_num), 2)::DOUBLE FROM ana"""))
def ps_logistic_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The score equations of the fit: predicted and observed totals agree for every level and every number.

    A natural spline holds the straight line, so they hold for the splined columns too.
    """
    df = staged(Roles(spark, sf).analysis)
    ps = W.ps_logistic(df, "exp", X.design(df, TERMS))
    terms = F.array(*[F.struct(name.alias("term"), (F.col("pd") * x).alias("x")) for name, x in (
        (F.concat(F.lit("segment="), "segment"), F.lit(1.0)), (F.concat(F.lit("zone="), "zone"), F.lit(1.0)),
        (F.lit("prior_stays"), F.col("prior_stays")), (F.lit("balance"), F.col("balance") / 1000),
        (F.lit("trial_num"), F.col("trial_num")))])
    return ps.select(F.explode(terms).alias("t")).groupBy("t.term").agg(F.round(F.sum("t.x"), 2).alias("total"))


_MONTHS = {
    **_PS,
    "mt": """SELECT exp, time, COUNT(*) AS n_risk, SUM(iptw) AS w_risk, SUM(CASE WHEN time + 1 = periods AND event_itt = 1
        THEN 1 ELSE 0 END) AS n_event, SUM(CASE WHEN time + 1 = periods AND event_itt = 1 THEN iptw ELSE 0 END) AS w_event
        FROM (SELECT *, UNNEST(range(periods)) AS time FROM wt) GROUP BY 1, 2""",
    "hz": """SELECT *, w_event / w_risk AS hazard, CASE WHEN MIN(1 - w_event / w_risk) OVER (PARTITION BY exp ORDER BY time)
        <= 0 THEN 0 ELSE EXP(SUM(LN(GREATEST(1 - w_event / w_risk, 1e-300))) OVER (PARTITION BY exp ORDER BY time)) END
        AS survival FROM mt""",
}


def _cells(r: Roles) -> DataFrame:
    return O.outcome_cells(_weighted(r), "exp", "periods", "event_itt", "iptw")


@check(with_roles(["ana"], """SELECT CAST(exp AS BIGINT) AS exp, CAST(time AS BIGINT) AS time, CAST(n_risk AS BIGINT) AS n_risk,
    CAST(n_event AS BIGINT) AS n_event, ROUND(w_risk, 6) AS w_risk, ROUND(w_event, 6) AS w_event,
    ROUND(hazard, 8) AS hazard, ROUND(survival, 8) AS survival FROM hz""", _MONTHS))
def weighted_hazards(spark: SparkSession, sf: str) -> DataFrame:
    h = O.weighted_hazards(O.month_table(_cells(Roles(spark, sf))))
    return h.select(*[F.col(c).cast("long").alias(c) for c in ("exp", "time", "n_risk", "n_event")],
                    F.round("w_risk", 6).alias("w_risk"), F.round("w_event", 6).alias("w_event"),
                    F.round("hazard", 8).alias("hazard"), F.round("survival", 8).alias("survival"))


@check(with_roles(["ana"], """SELECT CAST(time AS BIGINT) AS time, CAST(events_0 AS BIGINT) AS events_0,
    CAST(events_1 AS BIGINT) AS events_1, ROUND(c0, 8) AS cuminc_0, ROUND(c1, 8) AS cuminc_1, ROUND(c1 - c0, 8) AS rd,
    ROUND(c1 / c0, 8) AS rr FROM (SELECT time, MAX(CASE WHEN exp = 0 THEN ev END) AS events_0,
    MAX(CASE WHEN exp = 1 THEN ev END) AS events_1, MAX(CASE WHEN exp = 0 THEN 1 - survival END) AS c0,
    MAX(CASE WHEN exp = 1 THEN 1 - survival END) AS c1 FROM (SELECT *, SUM(n_event) OVER (PARTITION BY exp ORDER BY time)
    AS ev FROM hz) GROUP BY time)""", _MONTHS))
def risk_curves_saturated(spark: SparkSession, sf: str) -> DataFrame:
    out = O.risk_curves_saturated(O.month_table(_cells(Roles(spark, sf))))
    return _rounded(out.withColumn("time", F.col("time").cast("long")), 8)


@check()
def pooled_hr(spark: SparkSession, sf: str) -> DataFrame:
    return O.pooled_hr(_cells(Roles(spark, sf)))


@check()
def risk_curves(spark: SparkSession, sf: str) -> DataFrame:
    return O.risk_curves(_cells(Roles(spark, sf)))


@check(with_roles(["ana"], """SELECT CAST(exp AS BIGINT) AS exp, ROUND(SUM(w_event), 4) AS events, ROUND(SUM(time * w_event), 3) AS event_months
    FROM mt GROUP BY 1""", _MONTHS))
def risk_curves_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The score equations of the curves: per arm, predicted and observed weighted events and their months agree."""
    cells = staged(_cells(Roles(spark, sf)))
    cum = O.risk_curves(cells).select("time", F.explode(F.array(*[F.struct(F.lit(a).alias("exp"), F.col(f"cuminc_{a}").alias("ci"))
                                                                   for a in (0, 1)])).alias("_r")).select("time", "_r.*")
    before = F.coalesce(F.lag("ci").over(Window.partitionBy("exp").orderBy("time")), F.lit(0.0))
    hazard = cum.select("exp", "time", F.try_divide(F.col("ci") - before, 1 - before).alias("hazard"))
    expected = O.month_table(cells).join(hazard, ["exp", "time"]).withColumn("_e", F.col("w_risk") * F.col("hazard"))
    return expected.groupBy(F.col("exp").cast("long").alias("exp")).agg(
        F.round(F.sum("_e"), 4).alias("events"), F.round(F.sum(F.col("time") * F.col("_e")), 3).alias("event_months"))


def _adjustment(df: DataFrame) -> X.Design:
    return X.design(df, [X.Term("segment", "category", ref="BUILDING"), X.Term("trial_num")])


@check()
def risk_curves_adjusted(spark: SparkSession, sf: str) -> DataFrame:
    df = staged(_weighted(Roles(spark, sf)))
    return O.risk_curves_adjusted(df, "exp", "periods", "event_itt", "iptw", _adjustment(df), {"segment": "MACHINERY", "trial_num": 24})


@check()
def pooled_hr_adjusted(spark: SparkSession, sf: str) -> DataFrame:
    df = staged(_weighted(Roles(spark, sf)))
    return O.pooled_hr_adjusted(df, "exp", "periods", "event_itt", "iptw", _adjustment(df))


@check(with_roles(["ana"], """SELECT term, ROUND(SUM(iptw), 3) AS total, CAST(COUNT(*) AS BIGINT) AS n FROM (
    SELECT 'arm=' || exp AS term, iptw, event_itt FROM wt UNION ALL SELECT 'segment=' || segment, iptw, event_itt FROM wt
    UNION ALL SELECT 'trial_num', iptw * trial_num / 10, event_itt FROM wt
    UNION ALL SELECT 'month, arm=' || exp, iptw * (periods - 1) / 10, event_itt FROM wt) WHERE event_itt = 1 GROUP BY 1""", _PS))
def outcome_adjusted_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The score equations of the outcome model with covariates: weighted events that the model expects, against those seen."""
    df = staged(_weighted(Roles(spark, sf)))
    fit = O.fit_adjusted(df, "exp", "periods", "event_itt", "iptw", _adjustment(df))
    parts = dict(zip(fit.names, fit.beta))
    row = F.lit(float(parts["intercept"])) + F.lit(float(parts["exp"])) * F.col("exp")
    for name, column in zip(fit.covariates.names, fit.covariates.columns):
        row = row + F.lit(float(parts[name])) * column
    long = expand_periods(df, "periods")
    knots = [0.0, *[k for k in O.INNER_KNOTS if k < fit.high], fit.high]
    for i, basis in enumerate(X.ns_basis("time", knots)):
        row = row + (F.lit(float(parts[f"time~{i}"])) + F.lit(float(parts[f"exp:time~{i}"])) * F.col("exp")) * basis
    expected = long.withColumn("e", F.col("iptw") * inverse_logit(row))
    terms = F.array(*[F.struct(name.alias("term"), (F.col("e") * by).alias("x")) for name, by in (
        (F.concat(F.lit("arm="), F.col("exp").cast("string")), F.lit(1.0)), (F.concat(F.lit("segment="), "segment"), F.lit(1.0)),
        (F.lit("trial_num"), F.col("trial_num") / 10), (F.concat(F.lit("month, arm="), F.col("exp").cast("string")), F.col("time") / 10))])
    totals = expected.select(F.explode(terms).alias("t")).groupBy("t.term").agg(F.round(F.sum("t.x"), 3).alias("total"))
    seen = df.where("event_itt = 1").select(F.explode(F.array(F.concat(F.lit("arm="), F.col("exp").cast("string")), F.concat(F.lit("segment="), "segment"),
                                                              F.lit("trial_num"), F.concat(F.lit("month, arm="), F.col("exp").cast("string")))).alias("term"))
    return totals.join(seen.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "term")


@check(with_roles(["ana"], """SELECT arm, CAST(b AS BIGINT) AS time, CAST(SUM(CASE WHEN periods >= b THEN 1 ELSE 0 END) AS BIGINT)
    AS n_risk FROM ana, (SELECT UNNEST([0, 6, 12, 18, 24, 30, 36, 42]) AS b) GROUP BY 1, 2"""))
def at_risk(spark: SparkSession, sf: str) -> DataFrame:
    return O.at_risk(Roles(spark, sf).analysis, "arm", "periods").withColumn("time", F.col("time").cast("long"))


@check(with_roles(["ana"], """SELECT arm, time, n_risk, n_event, ROUND(s, 8) AS survival, ROUND(1 - s, 8) AS cuminc FROM (
    SELECT *, CASE WHEN MIN(1 - n_event / n_risk) OVER (PARTITION BY arm ORDER BY time) <= 0 THEN 0
      ELSE EXP(SUM(LN(GREATEST(1 - n_event / n_risk, 1e-300))) OVER (PARTITION BY arm ORDER BY time)) END AS s FROM (
      SELECT arm, CAST(periods AS BIGINT) AS time, CAST(SUM(COUNT(*)) OVER (PARTITION BY arm ORDER BY periods DESC) AS BIGINT)
      AS n_risk, CAST(SUM(event_itt) AS BIGINT) AS n_event FROM ana GROUP BY arm, periods))"""))
def kaplan_meier(spark: SparkSession, sf: str) -> DataFrame:
    out = O.kaplan_meier(Roles(spark, sf).analysis, "arm", "periods", "event_itt")
    return _rounded(out.withColumns({c: F.col(c).cast("long") for c in ("time", "n_risk", "n_event")}), 8)


# ---- from the source tables to the estimates --------------------------------------------------------

_STUDY_ANA = {**C._FRAME_SQL, "ana": "SELECT * FROM frame"}


@check(with_roles(C._BASE_ROLES, """SELECT CAST(time AS BIGINT) AS time, CAST(events_0 AS BIGINT) AS events_0, CAST(events_1 AS BIGINT) AS events_1,
    ROUND(c0, 8) AS cuminc_0, ROUND(c1, 8) AS cuminc_1, ROUND(c1 - c0, 8) AS rd, ROUND(CASE WHEN c0 <> 0 THEN c1 / c0 END, 8) AS rr FROM (
    SELECT time, MAX(CASE WHEN exp = 0 THEN ev END) AS events_0, MAX(CASE WHEN exp = 1 THEN ev END) AS events_1,
    MAX(CASE WHEN exp = 0 THEN 1 - survival END) AS c0, MAX(CASE WHEN exp = 1 THEN 1 - survival END) AS c1
    FROM (SELECT *, SUM(n_event) OVER (PARTITION BY exp ORDER BY time) AS ev FROM hz) GROUP BY time)""", {**_STUDY_ANA, **_MONTHS}))
def study_curves_saturated(spark: SparkSession, sf: str) -> DataFrame:
    """Source tables to risk curves: episodes, baseline, frame, category scores, weights, one level per month."""
    frame = staged(C.study_frame_of(Roles(spark, sf, share=True)))
    weighted = W.iptw(W.ps_saturated(frame, "exp", ["segment", "zone"]), "exp")
    out = O.risk_curves_saturated(O.month_table(O.outcome_cells(weighted, "exp", "periods", "event_itt", "iptw")))
    return _rounded(out.withColumn("time", F.col("time").cast("long")), 8)


STUDY_TERMS = [X.Term("weight_bl", "spline"), X.Term("creatinine_bl"), X.Term("time_hf", "spline"), X.Term("user_type", "category", ref="New"),
               X.Term("c_low", "category", ref="No"), X.Term("segment", "category", ref="BUILDING")]


@check()
def study_curves(spark: SparkSession, sf: str) -> DataFrame:
    """Source tables to standardised risk curves with logistic scores on the study's baseline covariates."""
    frame = staged(C.study_frame_of(Roles(spark, sf, share=True)))
    weighted = W.iptw(W.ps_logistic(frame, "exp", X.design(frame, STUDY_TERMS)), "exp")
    return O.risk_curves(O.outcome_cells(weighted, "exp", "periods", "event_itt", "iptw"))


# ---- bootstrap -----------------------------------------------------------------------------------

@check("""SELECT l_suppkey, ROUND(quantile_cont(l_discount, 0.025), 9) AS l_discount_lcl,
    ROUND(quantile_cont(l_discount, 0.975), 9) AS l_discount_ucl, ROUND(quantile_cont(l_tax, 0.025), 9) AS l_tax_lcl,
    ROUND(quantile_cont(l_tax, 0.975), 9) AS l_tax_ucl FROM lineitem GROUP BY 1""")
def bootstrap_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    df = Roles(spark, sf).table("lineitem", "l_suppkey", "l_discount", "l_tax")
    return _rounded(percentile_interval(df, ["l_suppkey"], ["l_discount", "l_tax"]))


@check()
def bootstrap_curves(spark: SparkSession, sf: str) -> DataFrame:
    df = staged(Roles(spark, sf).analysis)
    return BS.bootstrap_curves(df, "exp", "periods", "event_itt", X.design(df, TERMS), "row_key", REPLICATES, 7)


@check()
def bootstrap_curves_exact(spark: SparkSession, sf: str) -> DataFrame:
    """The n-of-n resampling scheme, as plot rows per arm."""
    df = staged(Roles(spark, sf).analysis)
    curves = BS.bootstrap_curves(df, "exp", "periods", "event_itt", X.design(df, TERMS), "row_key", REPLICATES, 7,
                                 "multinomial")
    return O.curve_long(curves, ["A", "B"])


# ---- boosting --------------------------------------------------------------------------------------

@check()
def ps_gbt(spark: SparkSession, sf: str) -> DataFrame:
    df = staged(Roles(spark, sf).analysis)
    scored, _ = M.ps_boosted(df, "exp", X.design(df, GBT_TERMS), "row_key", GBT_PARAMS)
    return W.iptw(scored, "exp").select("row_key", "exp", "pn", "pd", "iptw")


@check(with_roles(["ana"], """SELECT row_key, ROUND(1 / (1 + EXP(-2 * (2 * AVG(exp) OVER (PARTITION BY segment = 'BUILDING') - 1))), 9)
    AS pd FROM ana"""))
def ps_gbt_stump(spark: SparkSession, sf: str) -> DataFrame:
    """One tree of depth 1 on a variable of two levels, without subsampling: the boosted score has a closed form."""
    df = _with_flag(staged(Roles(spark, sf).analysis))
    d = X.design(df, [X.Term("built", "category", ref="No")])
    scored, _ = G.ps_gbt(df, "exp", d, {"trees": 1, "depth": 1, "shrinkage": 0.1, "min_node": 1, "bag": 1.0})
    return _rounded(scored.select("row_key", "pd"))


def _stumps_sql(lanes: list[tuple[int, float, int]], trees: int, least: int) -> dict[str, str]:
    """Boosted one-split trees in SQL, on cells of equal category levels: lanes are (id, step, held-out fold)."""
    flags = [f"CAST(segment = '{v}' AS INT)" for v in ("AUTOMOBILE", "FURNITURE", "HOUSEHOLD", "MACHINERY")]
    flags += [f"CAST(zone = '{v}' AS INT)" for v in "1234"]
    p = "(1 / (1 + EXP(-f)))"
    parts = {
        "cell": f"""SELECT segment, zone, exp AS y, person_id % 3 AS fold, COUNT(*)::DOUBLE AS n, [{', '.join(flags)}] AS x
            FROM ana GROUP BY ALL""",
        "lane": f"SELECT * FROM (VALUES {', '.join(map(str, lanes))}) AS v(lane, rate, held)",
        "lc": "SELECT *, CASE WHEN fold = held THEN 0 ELSE n END AS w FROM cell, lane",
        "f0": "SELECT *, LN(SUM(w * y) OVER (PARTITION BY lane) / SUM(w * (1 - y)) OVER (PARTITION BY lane)) AS f FROM lc"}
    for k in range(1, trees + 1):
        parts[f"g{k}"] = f"""SELECT lane, any_value(rate) AS rate, q, SUM(w * x[q]) AS w1, SUM(w * (1 - x[q])) AS w0, SUM(w * x[q] * (y - {p})) AS g1,
            SUM(w * (1 - x[q]) * (y - {p})) AS g0, SUM(w * x[q] * {p} * (1 - {p})) AS h1, SUM(w * (1 - x[q]) * {p} * (1 - {p})) AS h0
            FROM f{k - 1}, range(1, {len(flags) + 1}) AS r(q) GROUP BY lane, q"""
        parts[f"d{k}"] = f"""SELECT *, w0 * w1 / (w0 + w1) * POW(g0 / w0 - g1 / w1, 2) AS dropped FROM g{k}
            WHERE w0 >= {least} AND w1 >= {least}"""
        parts[f"b{k}"] = f"""SELECT lane, q, rate * g1 / h1 AS s1, rate * g0 / h0 AS s0 FROM (SELECT *, MAX(dropped) OVER (PARTITION BY lane)
            AS top FROM d{k}) WHERE dropped >= top * (1 - 1e-9) QUALIFY ROW_NUMBER() OVER (PARTITION BY lane ORDER BY q) = 1"""
        parts[f"f{k}"] = f"""SELECT a.* EXCLUDE (f), f + CASE WHEN x[q] = 1 THEN s1 ELSE s0 END AS f FROM f{k - 1} a JOIN b{k} b
            ON a.lane = b.lane"""
    return parts


STUMP_TERMS = [X.Term("segment", "category", ref="BUILDING"), X.Term("zone", "category", ref="0")]
_RATES = [0.6, 0.2, 0.05]
_FOLD_LANES = [(3 * i + k, rate, k) for i, rate in enumerate(_RATES) for k in range(3)]


@check(with_roles(["ana"], """SELECT row_key, ROUND(1 / (1 + EXP(-f)), 9) AS pd FROM ana a JOIN (SELECT DISTINCT segment, zone, f FROM f8) c
    ON a.segment = c.segment AND a.zone = c.zone""", _stumps_sql([(0, 0.2, -1)], 8, 5)))
def ps_gbt_trees(spark: SparkSession, sf: str) -> DataFrame:
    """Eight one-split trees without subsampling, against the same growth in SQL."""
    df = staged(Roles(spark, sf).analysis)
    params = {"trees": 8, "depth": 1, "shrinkage": 0.2, "min_node": 5, "bag": 1.0}
    scored, _ = M.ps_boosted(df, "exp", X.design(df, STUMP_TERMS), "row_key", params)
    return _rounded(scored.select("row_key", "pd"))


@check(with_roles(["ana"], """SELECT rate AS shrinkage, ROUND(SQRT(MIN(dev)), 7) AS score, CAST(arg_min(k, dev) AS BIGINT) AS best_trees FROM (
    SELECT k, rate, SUM(loss) / SUM(n) AS dev FROM (""" + " UNION ALL ".join(
        f"SELECT {k} AS k, rate, n, 2 * n * (LN(1 + EXP(f)) - y * f) AS loss FROM f{k} WHERE fold = held" for k in range(1, 9)) + """)
    GROUP BY k, rate) GROUP BY rate""", _stumps_sql(_FOLD_LANES, 8, 5)))
def tune_gbt_folds(spark: SparkSession, sf: str) -> DataFrame:
    """Cross-validated deviance of three rates on a shared fold column, against the same search in SQL."""
    df = staged(Roles(spark, sf).analysis)
    grid_ = grid(shrinkage=_RATES, depth=[1], min_node=[5], bag=[1.0])
    rows = M.cross_validated(df, "exp", X.design(df, STUMP_TERMS), "row_key", grid_, 8, 3, F.col("person_id") % 3, patience=None)
    return _rounded(spark.createDataFrame([(r["shrinkage"], r["score"], r["best_trees"]) for r in rows], "shrinkage double, score double, best_trees long"), 7)


@check()
def gbt_importance(spark: SparkSession, sf: str) -> DataFrame:
    df = staged(Roles(spark, sf).analysis)
    rows = M.matrix(df, "exp", X.design(df, GBT_TERMS), "row_key", 1)
    fit = M.boost(rows, [M.Lane.of(GBT_PARAMS)], GBT_PARAMS["trees"])
    return M.relative_influence(df, fit, labels={"trial_num": "Month of baseline"})


@check()
def tune_gbt(spark: SparkSession, sf: str) -> DataFrame:
    """Ten-fold search: learning rate first, then depth and node size at the best rate."""
    df = staged(Roles(spark, sf).analysis)
    d = X.design(df, GBT_TERMS)
    first = M.cross_validated(df, "exp", d, "row_key", grid(shrinkage=G.LEARNING_RATES, depth=[3], min_node=[10]), TUNE_TREES, patience=TUNE_PATIENCE)
    rate = G.best_params(first)["shrinkage"]
    second = M.cross_validated(df, "exp", d, "row_key", grid(shrinkage=[rate], depth=G.DEPTHS, min_node=G.NODE_SIZES), TUNE_TREES, patience=TUNE_PATIENCE)
    rows = [(r["shrinkage"], int(r["depth"]), int(r["min_node"]), int(r["best_trees"]), float(r["score"]), bool(r["at_limit"]))
            for r in [*first, *second]]
    return spark.createDataFrame(rows, "shrinkage double, depth int, min_node int, best_trees int, score double, at_limit boolean")


@check()
def bootstrap_curves_gbt(spark: SparkSession, sf: str) -> DataFrame:
    df = staged(Roles(spark, sf).analysis)
    return BS.bootstrap_curves_gbt(df, "exp", "periods", "event_itt", X.design(df, GBT_TERMS), "row_key", GBT_PARAMS, BOOSTED_REPLICATES)
