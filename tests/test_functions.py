"""Dates, text and row expressions on hand-made edge cases."""

from datetime import date, datetime

from pyspark.sql import functions as F

from cohortweave.functions import dates as D, rows as R, text as T


def one(spark, expr, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


def test_month_boundaries(spark):
    m = lambda a, b: one(spark, D.month_boundaries("a", "b"), a=a, b=b)
    assert m(date(2020, 1, 31), date(2020, 2, 1)) == 1
    assert m(date(2020, 1, 1), date(2020, 1, 31)) == 0
    assert m(date(2020, 3, 1), date(2019, 12, 31)) == -3


def test_month_end_is_clamped(spark):
    assert one(spark, F.add_months(F.col("d"), -1), d=date(2020, 3, 31)) == date(2020, 2, 29)
    assert one(spark, F.add_months(F.col("d"), 1), d=date(2020, 2, 29)) == date(2020, 3, 29)


def test_fiscal_period(spark):
    f = lambda d: (one(spark, D.fiscal_year("d"), d=d), one(spark, D.fiscal_quarter("d"), d=d))
    assert f(date(2019, 10, 1)) == (2020, "Q1")
    assert f(date(2019, 9, 30)) == (2019, "Q4")
    assert f(date(2020, 2, 29)) == (2020, "Q2")


def test_usable_from(spark):
    df = spark.createDataFrame([(datetime(2020, 1, 5),), (datetime(2020, 1, 5, 0, 0, 1),)], "ts timestamp_ntz")
    got = df.select(D.usable_from("ts").alias("d"), D.usable_from("ts", strict=True).alias("s")).collect()
    assert [r["d"] for r in got] == [date(2020, 1, 5), date(2020, 1, 6)]
    assert [r["s"] for r in got] == [date(2020, 1, 6), date(2020, 1, 6)]


def test_period_arithmetic_matches_search(spark):
    """Every start day of two years against days around it, compared with a search over periods."""
    starts = spark.sql("SELECT explode(sequence(date'2019-01-27', date'2020-03-31', interval 1 day)) AS s")
    days = spark.sql("SELECT explode(sequence(date'2019-03-25', date'2019-06-05', interval 1 day)) AS d")
    grid = starts.crossJoin(days).select(
        "s", "d", D.first_period_ending_from("s", "d").alias("ge"), D.first_period_ending_after("s", "d").alias("gt"),
        D.last_period_opening_by("s", "d").alias("le"))
    t = F.explode(F.sequence(F.lit(-16), F.lit(6)))
    found = (grid.withColumn("t", t).withColumn("e", F.add_months("s", F.col("t")))
             .groupBy("s", "d", "ge", "gt", "le").agg(
                 F.min(F.when(F.col("e") >= F.col("d"), F.col("t"))).alias("ge2"),
                 F.min(F.when(F.col("e") > F.col("d"), F.col("t"))).alias("gt2"),
                 F.max(F.when(F.add_months("e", -1) <= F.col("d"), F.col("t"))).alias("le2")))
    assert found.where("ge <> ge2 OR gt <> gt2 OR le <> le2").count() == 0


def test_wildcards(spark):
    rows = ["serum K level", "Potassium", "24H K ur", "pro-BNP", "PRO_BNP", "proXBNP", "CAPPROF-BNP5", "402.91", "402x11",
            None]
    df = spark.createDataFrame([(r,) for r in rows], "n string")
    hit = lambda **k: {r["n"] for r in df.where(T.match_patterns("n", **k)).collect()}
    assert hit(include=["%[^a-z]K[^a-z]%", "%potas%"], exclude=["%24h%"]) == {"serum K level", "Potassium"}
    assert hit(include=["%pro[- /_]BNP%"]) == {"pro-BNP", "PRO_BNP"}
    assert hit(include=["%BNP%"], exclude=["%pro%"], exact=["capprof-bnp5"]) == {"CAPPROF-BNP5"}
    assert hit(include=["402._1%"]) == {"402.91"}
    assert hit(include=["%BNP"], not_exact=["pro-bnp"]) == {"PRO_BNP", "proXBNP"}
    assert df.where(T.none_of("n", ["%bnp%"])).count() == 5  # an unknown name is dropped


def test_default_lab_names(spark):
    from cohortweave.operators.codes import LAB_NAME_RULES, code_set

    names = ["BNP", "proBNP", "NT pro-BNP", "POTASSIUM", "Urine Potassium", "ISTAT K (POC)", "C TELOPEPTIDE BNP",
             "CAPPROF-BNP5", "ZZSodium/Potassium (OLD 10/00)"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id int, name string")
    got = {(r["concept"], r["name"]) for r in code_set(df, "name", LAB_NAME_RULES, ["id"]).collect()}
    assert got == {("BNP", "BNP"), ("NT-proBNP", "proBNP"), ("NT-proBNP", "NT pro-BNP"), ("potassium", "POTASSIUM"),
                   ("potassium", "ISTAT K (POC)"), ("BNP", "CAPPROF-BNP5")}


def test_numbers_and_flags(spark):
    df = spark.createDataFrame([("12",), ("",), ("NULL",), ("junk",), ("72.5",), (None,)], "t string")
    got = [r["x"] for r in df.select(T.number_or_null("t").cast("int").alias("x")).collect()]
    assert got == [12, None, None, None, 73, None]
    flags = spark.createDataFrame([("true",), ("False",), ("",)], "t string")
    assert [r["x"] for r in flags.select(T.flag_or_null("t").alias("x")).collect()] == [1, 0, None]


def test_first_known_and_censor(spark):
    df = spark.createDataFrame([(None, "b"), ("a", "b"), (None, None)], "x string, y string")
    value, label = R.first_known([("first", F.col("x")), ("second", F.col("y"))])
    assert [tuple(r) for r in df.select(value, label).collect()] == [("b", "second"), ("a", "first"), (None, None)]
    assert one(spark, R.censor_after("d", "2020-09-30"), d=date(2020, 10, 1)) is None
    assert one(spark, R.censor_after("d", "2020-09-30"), d=date(2020, 9, 30)) == date(2020, 9, 30)


def test_parse_result(spark):
    from cohortweave.operators.labs import parse_result

    df = spark.createDataFrame(
        [(None, "<5"), (None, ">70000H"), (None, " "), (None, "see comment"), (3.0, "x"), (None, "junk")],
        "n double, t string")
    got = [r["x"] for r in df.select(parse_result("n", "t", ["<", ">", "Hh", " "], "decimal(14,2)", ["see comment"])
                                     .cast("double").alias("x")).collect()]
    assert got == [5.0, 70000.0, None, None, 3.0, None]


def test_mixed_wildcard_classes(spark):
    texts = ["5", "-", ".", "x", "]", "q"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    hits = lambda p: [t for t in texts if df.where((F.col("t") == t) & F.col("t").rlike(T.any_pattern([p]))).count()]
    assert hits("[0-9.]") == ["5", "."] and hits("[^a-z0-9 ]") == ["-", ".", "]"] and hits("[]x]") == ["x", "]"]
