"""Checks of the relational operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortweave.catalog.registry import check
from cohortweave.catalog.roles import CONDITION_RULES, CUTOFF, HF_RULE, STUDY, Roles, with_roles
from cohortweave.functions import dates as D, rows as R, text as T
from cohortweave.operators import asof, codes, intervals, labs as L, persons, phenotype, reshape, summaries as S
from cohortweave.plans.cohort import area_index, is_height, is_pressure, is_weight
from cohortweave.session import staged
from cohortweave.sources import expect

# ---- projection, scalars ---------------------------------------------------------

@check("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(o_orderdate AS DATE) + 30 AS plus_days,
    CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) AS plus_month, CAST(o_orderdate - INTERVAL 1 MONTH AS DATE) AS minus_month,
    CAST(date_diff('day', DATE '1998-02-28', CAST(o_orderdate AS DATE)) AS BIGINT) AS gap_days,
    CAST(abs(date_diff('day', DATE '1998-02-28', CAST(o_orderdate AS DATE))) AS BIGINT) AS abs_gap,
    CAST(date_diff('month', DATE '1998-01-31', CAST(o_orderdate AS DATE)) AS BIGINT) AS month_bounds,
    CAST(YEAR(o_orderdate + INTERVAL 3 MONTH) AS BIGINT) AS fiscal_year,
    'Q' || QUARTER(o_orderdate + INTERVAL 3 MONTH) AS fiscal_quarter,
    GREATEST(CAST(o_orderdate AS DATE), DATE '1997-06-01') AS floor_date FROM orders""")
def date_functions(spark: SparkSession, sf: str) -> DataFrame:
    day, base = F.col("day"), F.lit("1998-02-28").cast("date")
    return Roles(spark, sf).table("orders", "o_orderkey", "o_orderdate").select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("day")).select(
        "o_orderkey", "day", D.add_days(day, F.lit(30)).alias("plus_days"), F.add_months(day, 1).alias("plus_month"),
        F.add_months(day, -1).alias("minus_month"), D.day_gap(base, day).cast("long").alias("gap_days"),
        F.abs(D.day_gap(base, day)).cast("long").alias("abs_gap"),
        D.month_boundaries(F.lit("1998-01-31").cast("date"), day).cast("long").alias("month_bounds"),
        D.fiscal_year(day).cast("long").alias("fiscal_year"), D.fiscal_quarter(day).alias("fiscal_quarter"),
        R.latest_of(day, F.lit("1997-06-01").cast("date")).alias("floor_date"))


@check(f"""SELECT DISTINCT l_orderkey, l_suppkey, CASE WHEN l_quantity > 40 THEN 'large' WHEN l_quantity > 20 THEN 'middle' END
    AS size_class, CASE WHEN l_shipdate > TIMESTAMP '2000-01-01' THEN NULL ELSE CAST(l_shipdate AS DATE) END AS ship_day,
    CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS returned,
    CASE l_returnflag WHEN 'A' THEN 'Accepted' WHEN 'R' THEN 'Returned' ELSE l_returnflag END AS flag_label FROM lineitem""")
def projection_case(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("l_quantity")
    return Roles(spark, sf).table("lineitem", "l_orderkey", "l_suppkey", "l_quantity", "l_shipdate", "l_returnflag").select(
        "l_orderkey", "l_suppkey", F.when(q > 40, "large").when(q > 20, "middle").alias("size_class"),
        R.censor_after(F.col("l_shipdate").cast("date"), "2000-01-01").alias("ship_day"),
        R.binary("l_returnflag", "R").alias("returned"),
        R.recode("l_returnflag", {"A": "Accepted", "R": "Returned"}).alias("flag_label")).distinct()


@check("SELECT o_orderkey, ROUND(1 / (1 + EXP(-(o_totalprice / 100000 - 2.5))), 9) AS p FROM orders")
def inverse_logit(spark: SparkSession, sf: str) -> DataFrame:
    return Roles(spark, sf).table("orders", "o_orderkey", "o_totalprice").select(
        "o_orderkey", F.round(R.inverse_logit(F.col("o_totalprice") / 100000 - 2.5), 9).alias("p"))


# ---- joins, set operations, ordering -----------------------------------------------

@check(with_roles(["rw"], """SELECT person_id, rx_class, COUNT(*) AS n, SUM(CAST(l_quantity AS BIGINT))::BIGINT AS qty
    FROM rw GROUP BY 1, 2"""))
def person_facts(spark: SparkSession, sf: str) -> DataFrame:
    return Roles(spark, sf).rows.groupBy("person_id", "rx_class").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("qty"))


@check("""SELECT l_orderkey AS site_row, o_custkey AS person_id, CAST(l_shipdate AS DATE) AS ship_day,
    COUNT(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1, 2, 3""")
def semi_cohort(spark: SparkSession, sf: str) -> DataFrame:
    r = Roles(spark, sf)
    cohort = r.table("customer", "c_custkey", "c_mktsegment").where("c_mktsegment = 'BUILDING'").select(
        F.col("c_custkey").alias("person_id"))
    fact = r.table("lineitem", "l_orderkey", "l_shipdate").select(
        F.col("l_orderkey").alias("site_id"), F.col("l_orderkey").alias("site_row"),
        F.col("l_shipdate").cast("date").alias("ship_day"))
    return persons.to_person(fact, r.crosswalk, cohort).groupBy("site_row", "person_id", "ship_day").agg(
        F.count(F.lit(1)).alias("n"))


@check("""SELECT p_partkey, p_name FROM part WHERE (lower(p_name) LIKE '%ring%' OR lower(p_name) LIKE '%red%')
    AND p_partkey NOT IN (SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%red%' AND lower(p_name) NOT LIKE '%bolt%')""")
def anti_codes(spark: SparkSession, sf: str) -> DataFrame:
    part = Roles(spark, sf).table("part", "p_partkey", "p_name")
    wide = part.where(T.match_patterns("p_name", ["%RING%", "%red%"]))
    narrow = part.where(T.match_patterns("p_name", ["%Red%"], ["%bolt%"]))
    return wide.join(narrow.select("p_partkey"), "p_partkey", "left_anti")


@check("""SELECT o_custkey AS person_id, CAST(o_orderdate AS DATE) AS day FROM orders UNION
    SELECT o_custkey, CAST(l_shipdate AS DATE) FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def union_distinct(spark: SparkSession, sf: str) -> DataFrame:
    r = Roles(spark, sf)
    ordered = r.table("orders", "o_custkey", "o_orderdate").select(
        F.col("o_custkey").alias("person_id"), F.col("o_orderdate").cast("date").alias("day"))
    shipped = r.table("lineitem", "l_orderkey", "l_shipdate").join(
        r.crosswalk, F.col("l_orderkey") == F.col("site_id")).select(
        "person_id", F.col("l_shipdate").cast("date").alias("day"))
    return ordered.unionByName(shipped).distinct()


@check("""SELECT o_orderkey AS id, 'price' AS measure, o_totalprice AS value FROM orders UNION ALL
    SELECT c_custkey, 'balance', c_acctbal FROM customer""")
def union_all_stack(spark: SparkSession, sf: str) -> DataFrame:
    r = Roles(spark, sf)
    a = r.table("orders").select(F.col("o_orderkey").alias("id"), F.lit("price").alias("measure"),
                                 F.col("o_totalprice").alias("value"))
    b = r.table("customer").select(F.col("c_custkey").alias("id"), F.lit("balance").alias("measure"),
                                   F.col("c_acctbal").alias("value"))
    return a.unionByName(b)


@check("""SELECT o_orderkey, o_custkey, c_mktsegment, n_name FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey""")
def inner_merge(spark: SparkSession, sf: str) -> DataFrame:
    r = Roles(spark, sf)
    people = r.table("customer", "c_custkey", "c_mktsegment", "c_nationkey").join(
        r.table("nation", "n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return r.table("orders", "o_orderkey", "o_custkey").join(people, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "o_custkey", "c_mktsegment", "n_name")


@check("SELECT o_custkey, o_orderdate, o_orderkey FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey")
def ordered_output(spark: SparkSession, sf: str) -> DataFrame:
    return Roles(spark, sf).table("orders", "o_custkey", "o_orderdate", "o_orderkey").orderBy(
        "o_custkey", F.col("o_orderdate").desc(), "o_orderkey")


@check("SELECT o_orderkey, CAST(ROW_NUMBER() OVER (ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS id FROM orders")
def surrogate_ids(spark: SparkSession, sf: str) -> DataFrame:
    orders = Roles(spark, sf).table("orders", "o_orderkey", "o_orderdate").withColumn(
        "block", F.floor(F.col("o_orderkey") / 1048576))
    return R.dense_ids(orders, ["o_orderdate", "block"], ["o_orderkey"]).select("o_orderkey", "id")


@check("""SELECT o_custkey AS person_id, CAST(MIN(o_orderdate) AS DATE) AS first_day,
    CAST(MAX(o_orderdate) AS DATE) AS last_day, COUNT(*) AS n FROM orders GROUP BY 1""")
def first_last_dates(spark: SparkSession, sf: str) -> DataFrame:
    return Roles(spark, sf).table("orders", "o_custkey", "o_orderdate").groupBy(
        F.col("o_custkey").alias("person_id")).agg(
        F.min("o_orderdate").cast("date").alias("first_day"), F.max("o_orderdate").cast("date").alias("last_day"),
        F.count(F.lit(1)).alias("n"))


@check("""SELECT DISTINCT l_suppkey, quantile_disc(l_quantity, 0.5) OVER (PARTITION BY l_suppkey) AS median_qty
    FROM lineitem""")
def median_window(spark: SparkSession, sf: str) -> DataFrame:
    # The value of the window per partition is the grouped median: no row needs to be ranked.
    return S.median_disc(Roles(spark, sf).table("lineitem", "l_suppkey", "l_quantity"), ["l_suppkey"], "l_quantity",
                         "median_qty")


# ---- filters, checks, text ---------------------------------------------------------

@check(with_roles(["vital"], f"""SELECT person_id, kind, ts, value, systolic, diastolic FROM vital WHERE
    (kind = 'WEIGHT' AND value > 75 AND value < 700) OR (kind = 'HEIGHT' AND value > 48 AND value < 84)
    OR (kind = 'BLOOD PRESSURE' AND systolic <> 0 AND diastolic <> 0 AND systolic > diastolic)"""))
def plausible_values(spark: SparkSession, sf: str) -> DataFrame:
    return Roles(spark, sf).vitals.where(is_weight(STUDY) | is_height(STUDY) | is_pressure())


@check(f"""SELECT l_suppkey, l_linestatus, COUNT(*) AS n FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag IN ('A', 'N')
    AND l_linenumber NOT IN (6, 7) AND l_shipdate IS NOT NULL AND l_shipdate >= TIMESTAMP '1996-01-01'
    AND l_shipdate <= TIMESTAMP '{CUTOFF}' GROUP BY 1, 2""")
def flagged_rows(spark: SparkSession, sf: str) -> DataFrame:
    ship = F.col("l_shipdate")
    rows = Roles(spark, sf).table("lineitem", "l_suppkey", "l_linestatus", "l_returnflag", "l_linenumber", "l_shipdate")
    return rows.where((F.col("l_linestatus") == "O") & F.col("l_returnflag").isin("A", "N")
                      & ~F.col("l_linenumber").isin(6, 7) & ship.isNotNull()
                      & (ship >= D.midnight(F.lit("1996-01-01"))) & (ship <= D.midnight(F.lit(CUTOFF)))).groupBy(
        "l_suppkey", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@check("""SELECT failed_checks, COUNT(*) AS n FROM (SELECT CASE WHEN l_quantity > 25 THEN '' ELSE 'quantity;' END ||
    CASE WHEN l_discount < 0.08 THEN '' ELSE 'discount;' END AS failed_checks FROM lineitem) GROUP BY 1""")
def expect_checks(spark: SparkSession, sf: str) -> DataFrame:
    valid, rejected = expect(Roles(spark, sf).table("lineitem", "l_quantity", "l_discount"), {
        "quantity": F.col("l_quantity") > 25, "discount": F.col("l_discount") < 0.08})
    joined = F.concat(F.array_join("failed_checks", ";"), F.lit(";"))
    return (valid.select(F.lit("").alias("failed_checks")).unionByName(rejected.select(joined.alias("failed_checks")))
            .groupBy("failed_checks").agg(F.count(F.lit(1)).alias("n")))


_RESULT_TEXT = """CASE l_linenumber WHEN 1 THEN '<' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)
    WHEN 2 THEN '>' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || '000H' WHEN 3 THEN 'see comment' WHEN 4 THEN 'canc'
    WHEN 5 THEN ' ' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || '.5 ' WHEN 6 THEN 'pending'
    ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END"""


def _lab_rows(r: Roles) -> DataFrame:
    q = F.col("l_quantity").cast("int").cast("string")
    n = F.col("l_linenumber")
    text = (F.when(n == 1, F.concat(F.lit("<"), q)).when(n == 2, F.concat(F.lit(">"), q, F.lit("000H")))
            .when(n == 3, "see comment").when(n == 4, "canc").when(n == 5, F.concat(F.lit(" "), q, F.lit(".5 ")))
            .when(n == 6, "pending").otherwise(q))
    units = (F.when(F.col("rx_class") == "PROMO", "pg/dL").when(F.col("rx_class") == "STANDARD", "PG/ML")
             .when(F.col("rx_class") == "SMALL", "mg/dL").when(F.col("rx_class") == "LARGE", "g/L")
             .when(F.col("rx_class") == "MEDIUM", "mg/24 h"))
    both = F.concat("l_returnflag", "l_linestatus")
    phenotype = (F.when(both == "AF", "Creatinine").when(both == "AO", "BNP").when(both == "NF", "NT-proBNP")
                 .when(both == "NO", "Potassium").when(both == "RF", "Albumin").otherwise("Hemoglobin"))
    return r.rows.select(
        "person_id", phenotype.alias("phenotype"), F.col("drug_name").alias("test_name"),
        F.col("ts").alias("specimen_ts"), text.alias("result_text"),
        F.when(n.isin(4, 5, 7), F.col("l_quantity")).alias("result_number"), units.alias("units"),
        F.when(F.col("l_discount") > 0.02, F.lit("5.0")).alias("ref_high"),
        F.when(F.col("l_tax") > 0.05, F.lit("12")).when(F.col("l_tax") > 0.01, F.lit("3.5")).alias("ref_low"))


_LAB_CTE = {"lr": f"""SELECT person_id, CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'Creatinine'
    WHEN 'AO' THEN 'BNP' WHEN 'NF' THEN 'NT-proBNP' WHEN 'NO' THEN 'Potassium' WHEN 'RF' THEN 'Albumin'
    ELSE 'Hemoglobin' END AS phenotype, drug_name AS test_name, ts AS specimen_ts, {_RESULT_TEXT} AS result_text,
    CASE WHEN l_linenumber IN (4, 5, 7) THEN l_quantity END AS result_number,
    CASE rx_class WHEN 'PROMO' THEN 'pg/dL' WHEN 'STANDARD' THEN 'PG/ML' WHEN 'SMALL' THEN 'mg/dL'
        WHEN 'LARGE' THEN 'g/L' WHEN 'MEDIUM' THEN 'mg/24 h' END AS units,
    CASE WHEN l_discount > 0.02 THEN '5.0' END AS ref_high,
    CASE WHEN l_tax > 0.05 THEN '12' WHEN l_tax > 0.01 THEN '3.5' END AS ref_low FROM rw"""}
_STRIP = "TRIM(TRIM(TRIM(TRIM(result_text, '<'), '>'), 'Hh'), ' ')"


@check(with_roles(["rw"], f"""SELECT person_id, specimen_ts, result_text, result_number, CAST(COALESCE(
    CAST(result_number AS DECIMAL(14,2)), CASE WHEN lower(result_text) <> 'see comment' THEN
    TRY_CAST({_STRIP} AS DECIMAL(14,2)) END) AS DOUBLE) AS parsed FROM lr""", _LAB_CTE))
def parse_text_result(spark: SparkSession, sf: str) -> DataFrame:
    parsed = L.parse_result("result_number", "result_text", ["<", ">", "Hh", " "], "decimal(14,2)", ["see comment"])
    return _lab_rows(Roles(spark, sf)).select("person_id", "specimen_ts", "result_text", "result_number",
                                              parsed.cast("double").alias("parsed"))


@check(with_roles(["rw"], f"""SELECT DISTINCT person_id, phenotype, specimen_ts, result_text, units, CAST(CASE phenotype
      WHEN 'Creatinine' THEN CAST(result_number AS DECIMAL(8,2))
      WHEN 'BNP' THEN CASE WHEN result_number IS NOT NULL AND lower(units) = 'pg/dl'
             THEN CAST(result_number / 100 AS DECIMAL(8,2))
           WHEN result_number IS NOT NULL AND lower(units) IN ('pgm/ml', 'ng/ml', 'pg/ml')
             THEN CAST(result_number AS DECIMAL(8,2))
           WHEN result_number IS NULL AND lower(result_text) = 'see comment' THEN NULL
           ELSE TRY_CAST(TRIM(TRIM(TRIM(result_text, '<'), '>'), ' <') AS DECIMAL(8,2)) END
      WHEN 'NT-proBNP' THEN COALESCE(CAST(result_number AS DECIMAL(14,2)), TRY_CAST({_STRIP} AS DECIMAL(14,2)))
      ELSE CAST(result_number AS DECIMAL(14,2)) END AS DOUBLE) AS value
    FROM lr WHERE lower(result_text) NOT IN ('canc', 'comment') AND units NOT ILIKE '%g/24%'
      AND units NOT ILIKE '%gm/24%' AND units NOT ILIKE '%gms/24' AND specimen_ts <= TIMESTAMP '{CUTOFF}'
      AND CASE phenotype
        WHEN 'Creatinine' THEN result_number IS NOT NULL AND test_name NOT ILIKE '%urine%' AND result_number <= 7
          AND ref_high IS NOT NULL AND lower(units) NOT IN ('gm/vol', 'gm/volume', 'ml/mn/1.73', 'ml/min', 'u/l',
              'ng/ml', 'mg/day', 'mmol/l', 'g/l')
        WHEN 'BNP' THEN lower(result_text) NOT IN ('nonreportable', 'not reported')
        WHEN 'NT-proBNP' THEN result_text <> '' AND lower(units) NOT IN ('ug/l', 'mcg/l')
        WHEN 'Potassium' THEN ref_low NOT IN ('12', '19', '25', '25.0', '26.0', '27', '30', '35')
          AND units NOT ILIKE '%/24h' AND (ref_low IS NOT NULL OR result_number <= 8.5)
        WHEN 'Albumin' THEN lower(units) IN ('g/dl', 'mg/dl', 'gm/dl', 'gms/dl', 'g/l', 'gr/dl')
          AND ref_high IS NOT NULL AND ref_high NOT IN ('5000', '50', '5410')
        ELSE test_name NOT ILIKE '%serum%' AND test_name NOT ILIKE '%plasma%' END""", _LAB_CTE))
def clean_labs(spark: SparkSession, sf: str) -> DataFrame:
    # The made-up result columns are worked out once: left in the plan, every rule would repeat them.
    rows = staged(L.admissible_labs(_lab_rows(Roles(spark, sf)), CUTOFF))
    return L.clean_labs(rows, keep=["person_id", "phenotype", "specimen_ts", "result_text", "units"]).withColumn(
        "value", F.col("value").cast("double"))


# ---- code sets ---------------------------------------------------------------------

# Codes of both vocabularies and curated labels, dealt to the parts by their key.
_CODES_9 = ["402.11", "404.93", "404.90", "428.0", "290.1", "331.0", "331.83", "331.9", "V42.1", "285.9", "250.0"]
_CODES_10 = ["I11.0", "I13.2", "I13.1", "I50.9", "F03", "G30.1", "G31.83", "Z94.1", "D64.9", "D65", "E11.9"]
_CURATED = ["MI", "CMB_HTN", "Flu", "CMB_unlisted", "TIA"]
_NUMBERS = [9901, 9907, 9910, 9999]


def _dealt(values: list) -> str:
    return f"[{', '.join(map(repr, values))}][1 + p_partkey % {len(values)}]"


@check(f"""WITH d AS (SELECT {_dealt(_CODES_9)} AS c9, {_dealt(_CODES_10)} AS c10, {_dealt(_CURATED)} AS label, {_dealt(_NUMBERS)} AS number FROM part)
    SELECT DISTINCT concept, code, vocabulary FROM (
    SELECT 'HF' AS concept, c9 AS code, 9 AS vocabulary FROM d WHERE c9 LIKE '402._1%' OR c9 LIKE '404._1%' OR c9 LIKE '404._3%' OR c9 LIKE '428%'
    UNION ALL SELECT 'HF', c10, 10 FROM d WHERE c10 LIKE 'I11.0%' OR c10 LIKE 'I13.0%' OR c10 LIKE 'I13.2%' OR c10 LIKE 'I50%'
    UNION ALL SELECT 'HeartTx', c9, 9 FROM d WHERE c9 LIKE 'V42.1%' UNION ALL SELECT 'HeartTx', c10, 10 FROM d WHERE c10 LIKE 'Z94.1%'
    UNION ALL SELECT 'Anemia', c9, 9 FROM d WHERE regexp_matches(c9, '^28[0-5]') UNION ALL SELECT 'Anemia', c10, 10 FROM d WHERE regexp_matches(c10, '^D5|^D6[0-4]')
    UNION ALL SELECT 'Dementia', c9, 9 FROM d WHERE regexp_matches(c9, '^290|^331[.][01]|^331[.]8[23]')
    UNION ALL SELECT 'Dementia', c10, 10 FROM d WHERE regexp_matches(c10, '^F0[0-3]|^G30|^G31[.]0|^G31[.]8[34]')
    UNION ALL SELECT label, label, 0 FROM d WHERE label IN ('MI', 'CMB_HTN', 'Flu', 'TIA')
    UNION ALL SELECT CASE number WHEN 9901 THEN 'LVAD' WHEN 9907 THEN 'Long_QT' ELSE 'Brugada' END, CAST(number AS VARCHAR), 0 FROM d WHERE number < 9999)""")
def default_code_sets(spark: SparkSession, sf: str) -> DataFrame:
    """The default heart-failure and comorbidity lists on dimensions of both vocabularies and a curated table."""
    dealt = lambda values: F.element_at(F.array(*map(F.lit, values)), (1 + F.col("p_partkey") % len(values)).cast("int"))
    dim = Roles(spark, sf).table("part", "p_partkey").select(
        dealt(_CODES_9).alias("c9"), dealt(_CODES_10).alias("c10"), dealt(_CURATED).alias("label"), dealt(_NUMBERS).alias("number")).distinct()
    found = [codes.pattern_codes(dim, "c9", [codes.HEART_FAILURE_9, *codes.COMORBIDITY_9], 9),
             codes.pattern_codes(dim, "c10", [codes.HEART_FAILURE_10, *codes.COMORBIDITY_10], 10)]
    listed = codes.listed_codes(dim, codes.COMORBIDITY_LISTED, "label").select(F.col("label").alias("concept"), F.col("label").alias("code"))
    numbered = codes.numbered_codes(dim, codes.COMORBIDITY_NUMBERED, "number").select("concept", F.col("number").cast("string").alias("code"))
    curated = [df.withColumn("vocabulary", F.lit(0)) for df in (listed, numbered)]
    return codes.stack_code_sets([df.select("concept", "code", "vocabulary") for df in [*found, *curated]])


_NAME_RULES = [
    codes.NameRule("metal", include=["%bolt%", "%[^a-z]ring%"], exclude=["%red%", "%_old%"], exact=["RED BOLT"]),
    codes.NameRule("small", include=["small%", "[a-c]%"], not_exact=["Small Widget"]),
    codes.NameRule("rest", include=["%bolt%", "%widget%"], minus=["metal"]),
]


@check("""WITH p AS (SELECT p_partkey, p_name, lower(p_name) AS n FROM part),
    m AS (SELECT *, (regexp_matches(n, 'bolt|[^a-z]ring') AND n NOT LIKE '%red%' AND n NOT LIKE '%_old%')
          OR n = 'red bolt' AS metal FROM p)
    SELECT 'metal' AS concept, p_partkey, p_name FROM m WHERE metal UNION ALL
    SELECT 'small', p_partkey, p_name FROM m WHERE regexp_matches(n, '^(small|[a-c])') AND n <> 'small widget' UNION ALL
    SELECT 'rest', p_partkey, p_name FROM m WHERE regexp_matches(n, 'bolt|widget') AND NOT metal""")
def pattern_code_set(spark: SparkSession, sf: str) -> DataFrame:
    return codes.code_set(Roles(spark, sf).table("part", "p_partkey", "p_name"), "p_name", _NAME_RULES, ["p_partkey"])


@check(with_roles(["codes"], """SELECT DISTINCT p_partkey, p_brand, concept FROM part
    JOIN (SELECT concept, code FROM codes UNION SELECT 'HF', p_brand FROM part WHERE p_brand LIKE 'Brand#2_'
          UNION SELECT CASE WHEN p_size = 7 THEN 'Seven' ELSE 'Nine' END, p_brand FROM part
          WHERE p_size IN (7, 9)) u ON p_brand = u.code"""))
def resolve_codes(spark: SparkSession, sf: str) -> DataFrame:
    part = Roles(spark, sf).table("part", "p_partkey", "p_brand", "p_size")
    dim = part.select("p_brand").distinct()
    numbered = codes.numbered_codes(part, {7: "Seven", 9: "Nine"}, "p_size").select(
        "concept", F.col("p_brand").alias("code"))
    patterns = codes.pattern_codes(dim, "p_brand", [*CONDITION_RULES, HF_RULE], 9).select("concept", "code")
    return codes.resolve_codes(part, codes.stack_code_sets([patterns, numbered]), "p_brand", ["p_partkey"])


@check("""SELECT DISTINCT p_partkey AS drug_id, p_type AS rx_class, p_name AS name, p_name || ' ' || p_size AS dosed,
    p_brand AS form FROM part WHERE p_type IN ('SMALL', 'LARGE') AND p_name NOT ILIKE '%ring%' AND p_name NOT ILIKE '%red%'
    UNION SELECT p_partkey, 'RX_Gizmo', p_name, p_name || ' ' || p_size, p_brand FROM part
    WHERE p_name ILIKE '%gizmo%' AND p_brand NOT IN ('Brand#3')""")
def drug_class_set(spark: SparkSession, sf: str) -> DataFrame:
    part = Roles(spark, sf).table("part").select(
        F.col("p_partkey").alias("drug_id"), F.col("p_type").alias("rx_class"), F.col("p_name").alias("name"),
        F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("dosed"), F.col("p_brand").alias("form"))
    return codes.drug_class_set(part, part.drop("rx_class"), "drug_id", "rx_class", "name", "dosed", "form",
                                ["SMALL", "LARGE"], ["%RING%", "%red%"],
                                codes.NameRule("RX_Gizmo", include=["%GIZMO%"]), ["Brand#3"])


# ---- lookups relative to the index date ---------------------------------------------

@check(with_roles(["ix", "vital"], """SELECT person_id, start_date, ts, value FROM (SELECT i.person_id, i.start_date, ts,
    value, ROW_NUMBER() OVER (PARTITION BY i.person_id, i.start_date ORDER BY ts DESC, value DESC) AS rn
    FROM (SELECT DISTINCT person_id, start_date FROM ix) i JOIN vital v ON i.person_id = v.person_id
    WHERE kind = 'WEIGHT' AND value > 75 AND value < 700 AND ts <= CAST(start_date AS TIMESTAMP)) WHERE rn = 1"""))
def asof_latest(spark: SparkSession, sf: str) -> DataFrame:
    r = Roles(spark, sf)
    return asof.asof_latest(r.index, r.vitals.where(is_weight(STUDY)), "person_id", "start_date", "ts", ["value"])


_PURCHASE = {"pt": """SELECT user_id, ts AS index_ts FROM events WHERE event_type = 'purchase'"""}


@check(with_roles([], """SELECT user_id, index_ts, ts, value, props FROM (SELECT p.user_id, index_ts, e.ts, value, props,
    ROW_NUMBER() OVER (PARTITION BY p.user_id, index_ts ORDER BY e.ts DESC, value DESC, props DESC) AS rn
    FROM pt p JOIN events e ON p.user_id = e.user_id AND e.event_type = 'view' AND e.ts <= index_ts)
    WHERE rn = 1""", _PURCHASE))
def asof_timestamp(spark: SparkSession, sf: str) -> DataFrame:
    ev = Roles(spark, sf).table("events", "user_id", "ts", "event_type", "value", "props")
    points = ev.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("index_ts"))
    return asof.asof_latest(points, ev.where("event_type = 'view'"), "user_id", "index_ts", "ts", ["value", "props"])


@check(with_roles(["ix", "fill"], """SELECT person_id, start_date, prior_start, prior_end,
    CAST(date_diff('day', prior_end, start_date) AS BIGINT) AS gap_days FROM (
    SELECT i.person_id, i.start_date, f.start_date AS prior_start, f.end_date AS prior_end,
    ROW_NUMBER() OVER (PARTITION BY i.person_id, i.start_date ORDER BY f.start_date DESC, f.end_date DESC) AS rn
    FROM (SELECT DISTINCT person_id, start_date FROM ix) i JOIN fill f ON i.person_id = f.person_id AND f.arm = 'A'
    AND f.start_date < i.start_date) WHERE rn = 1"""))
def asof_strict_gap(spark: SparkSession, sf: str) -> DataFrame:
    r = Roles(spark, sf)
    prior = r.fills.where("arm = 'A'").select(
        "person_id", F.col("release_ts").cast("date").alias("prior_start"),
        F.date_add(F.col("release_ts").cast("date"), F.col("days_supply")).alias("prior_end"))
    out = asof.asof_latest(r.index, prior, "person_id", "start_date", "prior_start", ["prior_end"], strict=True,
                           gap="gap_days", gap_from="prior_end")
    return out.withColumns({"prior_start": F.col("prior_start").cast("date"), "gap_days": F.col("gap_days").cast("long")})


@check(with_roles(["ix", "addr"], """SELECT person_id, start_date, updated, distance_days, zip, urh FROM (
    SELECT i.person_id, i.start_date, updated, CAST(abs(date_diff('day', updated, start_date)) AS BIGINT) AS distance_days,
    zip, urh, ROW_NUMBER() OVER (PARTITION BY i.person_id, i.start_date ORDER BY
        abs(date_diff('day', updated, start_date)) NULLS FIRST, updated NULLS FIRST, zip, urh) AS rn
    FROM (SELECT DISTINCT person_id, start_date FROM ix) i JOIN addr a ON i.person_id = a.person_id) WHERE rn = 1"""))
def asof_nearest(spark: SparkSession, sf: str) -> DataFrame:
    r = Roles(spark, sf)
    return asof.asof_nearest(r.index, r.addresses, "person_id", "start_date", "updated", ["zip", "urh"]).withColumn(
        "distance_days", F.col("distance_days").cast("long"))


def _lab_pick(phenotype: str, stem: str) -> str:
    return (f"MAX(CASE WHEN phenotype = '{phenotype}' THEN value END) AS {stem}_bl, "
            f"MAX(CASE WHEN phenotype = '{phenotype}' THEN ts END) AS {stem}_bl_dt")


_LAB_COLUMNS = ", ".join(_lab_pick(p, s) for p, s in (
    ("Creatinine", "creatinine"), ("Potassium", "potassium"), ("BNP", "bnp"), ("NT-proBNP", "probnp"),
    ("Albumin", "albumin"), ("Hemoglobin", "hb")))
LABS_WIDE = f"""SELECT person_id, start_date, {_LAB_COLUMNS} FROM (SELECT i.person_id, i.start_date, phenotype, ts, value,
    ROW_NUMBER() OVER (PARTITION BY i.person_id, i.start_date, phenotype ORDER BY ts DESC, value DESC) AS rn
    FROM (SELECT DISTINCT person_id, start_date FROM ix) i JOIN lab l ON i.person_id = l.person_id
    WHERE ts <= CAST(start_date AS TIMESTAMP)) WHERE rn = 1 GROUP BY 1, 2"""


@check(with_roles(["ix", "lab"], LABS_WIDE))
def baseline_labs_wide(spark: SparkSession, sf: str) -> DataFrame:
    r = Roles(spark, sf)
    return asof.asof_latest_wide(r.index, r.labs, "person_id", "start_date", "ts", "phenotype", "value",
                                 STUDY.lab_columns, suffix="_bl")


@check(with_roles(["ix", "fill"], """SELECT i.person_id, i.start_date,
    MAX(CASE WHEN rx_class = 'STANDARD' THEN f.start_date END) AS rx_standard_dt,
    MAX(CASE WHEN rx_class = 'MEDIUM' THEN f.start_date END) AS rx_medium_dt,
    MAX(CASE WHEN rx_class = 'SMALL' THEN f.start_date END) AS rx_small_dt
    FROM (SELECT DISTINCT person_id, start_date FROM ix) i JOIN fill f ON i.person_id = f.person_id
    WHERE i.start_date > f.start_date AND i.start_date <= f.end_date GROUP BY 1, 2"""))
def active_at_index(spark: SparkSession, sf: str) -> DataFrame:
    r = Roles(spark, sf)
    hits = intervals.active_at(r.index, r.rx.withColumnRenamed("start_date", "rx_start"), "person_id", "start_date",
                               "rx_start", "end_date", ["rx_class"])
    return reshape.pivot_dates(hits, ["person_id", "start_date"], "rx_class", "rx_start", STUDY.rx_classes)


@check(with_roles(["stay"], """SELECT w.person_id, w.day, COUNT(*) AS n FROM
    (SELECT DISTINCT o_custkey AS person_id, CAST(o_orderdate AS DATE) AS day FROM orders) w
    JOIN stay b ON w.person_id = b.person_id
    WHERE (w.day - INTERVAL 1 MONTH <= admit_ts AND admit_ts < w.day)
       OR (w.day - INTERVAL 1 MONTH <= discharge_ts AND discharge_ts < w.day)
       OR (w.day >= admit_ts AND w.day <= discharge_ts) GROUP BY 1, 2"""))
def interval_overlap_count(spark: SparkSession, sf: str) -> DataFrame:
    r = Roles(spark, sf)
    windows = r.table("orders", "o_custkey", "o_orderdate").select(
        F.col("o_custkey").alias("person_id"), F.col("o_orderdate").cast("date").alias("day")).distinct()
    windows = windows.withColumns({"s": D.midnight(F.add_months("day", -1)), "e": D.midnight("day")})
    return intervals.overlaps(windows, r.stays, "person_id", "s", "e", "admit_ts", "discharge_ts").groupBy(
        "person_id", "day").agg(F.count(F.lit(1)).alias("n"))


@check(with_roles(["ix", "hf_stay"], """SELECT i.person_id, i.start_date, COUNT(*) AS n FROM
    (SELECT DISTINCT person_id, start_date FROM ix) i JOIN hf_stay h ON i.person_id = h.person_id
    WHERE discharge_ts >= start_date - INTERVAL 12 MONTH AND discharge_ts < start_date GROUP BY 1, 2"""))
def lookback_count(spark: SparkSession, sf: str) -> DataFrame:
    r = Roles(spark, sf)
    return intervals.lookback_count(r.index, r.hf_stays, "person_id", "start_date", "discharge_ts")


@check(with_roles(["ix", "rw"], """SELECT i.person_id, i.start_date, MAX(CAST(ts AS DATE)) AS latest FROM
    (SELECT DISTINCT person_id, start_date FROM ix) i JOIN rw ON i.person_id = rw.person_id AND rx_class = 'ECONOMY'
    WHERE CAST(ts AS DATE) >= start_date - INTERVAL 12 MONTH AND CAST(ts AS DATE) < start_date GROUP BY 1, 2"""))
def lookback_latest(spark: SparkSession, sf: str) -> DataFrame:
    r = Roles(spark, sf)
    return intervals.lookback_latest(r.index, r.flu, "person_id", "start_date", "ts")


ONSET = """SELECT person_id, start_date, concept, MIN(ts) AS onset FROM (
    SELECT i.person_id, i.start_date, concept, MIN(ts) AS ts FROM (SELECT DISTINCT person_id, start_date FROM ix) i
    JOIN rec r ON i.person_id = r.person_id WHERE is_inpatient AND ts <= CAST(start_date AS TIMESTAMP) GROUP BY 1, 2, 3
    UNION ALL
    SELECT person_id, start_date, concept, ts FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY person_id, start_date, concept
        ORDER BY ts) AS rn FROM (SELECT DISTINCT i.person_id, i.start_date, concept, ts
        FROM (SELECT DISTINCT person_id, start_date FROM ix) i JOIN rec r ON i.person_id = r.person_id
        WHERE NOT is_inpatient AND visit_ts <= CAST(start_date AS TIMESTAMP))) WHERE rn = 2) GROUP BY 1, 2, 3"""


# What index dates and onsets need of the records, written once by person.
ONSET_COLUMNS = ["person_id", "arm", "code", "l_shipdate", "l_linenumber", "l_quantity", "is_inpatient"]


@check(with_roles(["ix", "rec"], ONSET))
def phenotype_onset(spark: SparkSession, sf: str) -> DataFrame:
    r = Roles(spark, sf, share=ONSET_COLUMNS)
    records = r.concept_records
    return phenotype.phenotype_onset(r.index, records.where("is_inpatient"), records.where(~F.col("is_inpatient")), "person_id", "start_date")


@check(with_roles(["ix", "rec"], """SELECT person_id, start_date,
    CAST(MAX(CASE WHEN concept = 'C_low' THEN onset END) AS DATE) AS c_low_dt,
    CAST(MAX(CASE WHEN concept = 'C_ten' THEN onset END) AS DATE) AS c_ten_dt,
    CAST(MAX(CASE WHEN concept = 'C_twenty' THEN onset END) AS DATE) AS c_twenty_dt FROM onset GROUP BY 1, 2""",
                  {"onset": ONSET}))
def pivot_dates(spark: SparkSession, sf: str) -> DataFrame:
    long = phenotype_onset(spark, sf).withColumn("onset", F.col("onset").cast("date"))
    return reshape.pivot_dates(long, ["person_id", "start_date"], "concept", "onset", STUDY.conditions)


# ---- summaries -----------------------------------------------------------------------

MODE = """SELECT i.person_id, i.start_date, CASE WHEN c IS NULL THEN NULL WHEN c >= p AND c >= n THEN 1
    WHEN p >= n THEN 2 ELSE 0 END AS smoking FROM (SELECT DISTINCT person_id, start_date FROM ix) i LEFT JOIN (
    SELECT j.person_id, j.start_date, SUM(CASE WHEN upper(status) = 'CURRENT SMOKER' THEN 1 ELSE 0 END) AS c,
        SUM(CASE WHEN upper(status) = 'FORMER SMOKER' THEN 1 ELSE 0 END) AS p,
        SUM(CASE WHEN upper(status) = 'NEVER SMOKER' THEN 1 ELSE 0 END) AS n
    FROM (SELECT DISTINCT person_id, start_date FROM ix) j JOIN smoke s ON j.person_id = s.person_id
    WHERE ts <= CAST(j.start_date AS TIMESTAMP) AND status <> 'UNKNOWN' GROUP BY 1, 2) k
    ON i.person_id = k.person_id AND i.start_date = k.start_date"""


@check(with_roles(["ix", "smoke"], MODE))
def modal_category(spark: SparkSession, sf: str) -> DataFrame:
    r = Roles(spark, sf)
    return S.modal_category(r.index, r.smoking, "person_id", "start_date", "ts", "status", STUDY.smoking_codes, "smoking")


@check("""SELECT user_id, COUNT(*) FILTER (WHERE event_type = 'view') AS views,
    COUNT(*) FILTER (WHERE event_type = 'click') AS clicks, COUNT(*) FILTER (WHERE event_type = 'error') AS errors
    FROM events GROUP BY 1""")
def modal_counts(spark: SparkSession, sf: str) -> DataFrame:
    return S.modal_counts(Roles(spark, sf).table("events", "user_id", "event_type"), ["user_id"], "event_type",
                          {"VIEW": "views", "Click": "clicks", "error": "errors"})


@check(with_roles(["vital"], """SELECT person_id, quantile_disc(value, 0.5) AS height FROM vital
    WHERE kind = 'HEIGHT' AND value > 48 AND value < 84 GROUP BY 1"""))
def median_disc(spark: SparkSession, sf: str) -> DataFrame:
    v = Roles(spark, sf).vitals.where(is_height(STUDY))
    return S.median_disc(v, ["person_id"], "value", "height")


@check(with_roles(["ef"], "SELECT person_id, day, ROUND(ef, 9) AS ef FROM ef"))
def daily_mean(spark: SparkSession, sf: str) -> DataFrame:
    return S.daily_mean(Roles(spark, sf).ejection, ["person_id"], "ts", "value", name="ef").withColumn(
        "ef", F.round("ef", 9))


@check("""SELECT user_id, CAST(ts AS DATE) AS day, COUNT(*) AS n, ROUND(SUM(value), 6) AS total FROM events GROUP BY 1, 2""")
def event_sums(spark: SparkSession, sf: str) -> DataFrame:
    ev = Roles(spark, sf).table("events", "user_id", "ts", "value").withColumn("day", F.col("ts").cast("date"))
    return S.window_summary(ev, ["user_id", "day"], [("value", "count", "n"), ("value", "sum", "total")]).withColumn(
        "total", F.round("total", 6))


AREA = """SELECT i.person_id, i.start_date, MIN(rank) AS area_rank FROM (SELECT DISTINCT person_id, start_date FROM ix) i
    JOIN area a ON i.person_id = a.person_id AND a.fiscal_year = YEAR(i.start_date + INTERVAL 3 MONTH)
    AND a.quarter = 'Q' || QUARTER(i.start_date + INTERVAL 3 MONTH) GROUP BY 1, 2"""


@check(with_roles(["ix", "area"], AREA))
def fiscal_area_index(spark: SparkSession, sf: str) -> DataFrame:
    r = Roles(spark, sf)
    return area_index(r.index, r.homes, r.area)


@check("""SELECT l_returnflag, ROUND(quantile_cont(l_extendedprice, 0.025), 6) AS q025,
    ROUND(quantile_cont(l_extendedprice, 0.5), 6) AS q500, ROUND(quantile_cont(l_extendedprice, 0.975), 6) AS q975
    FROM lineitem GROUP BY 1""")
def exact_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    q = S.exact_quantiles(Roles(spark, sf).table("lineitem", "l_returnflag", "l_extendedprice"), ["l_returnflag"],
                          "l_extendedprice", [0.025, 0.5, 0.975])
    return q.groupBy("l_returnflag").agg(*[
        F.round(F.max(F.when(F.col("prob") == p, F.col("q"))), 6).alias(n)
        for p, n in ((0.025, "q025"), (0.5, "q500"), (0.975, "q975"))])
