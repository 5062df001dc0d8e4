"""Person-month tables: every source in one placement."""

import datetime as dt
import re

from pyspark.sql import functions as F

from cohortweave.operators.timeline import Current, DayTotals, Latest, Touching, timeline

D = dt.date


def inputs(spark):
    spans = spark.createDataFrame([(1, "A", D(2020, 1, 31), 4), (1, "B", D(2020, 3, 1), 2), (2, "A", D(2020, 2, 1), 3), (3, "A", D(2020, 2, 1), 0)],
                                  "person_id long, arm string, start_date date, periods int")
    weights = spark.createDataFrame([(1, dt.datetime(2019, 5, 1), 80.0), (1, dt.datetime(2020, 2, 29), 82.0), (1, dt.datetime(2020, 2, 29, 5), 90.0),
                                     (1, dt.datetime(2020, 2, 29), 81.0), (9, dt.datetime(2020, 1, 1), 1.0), (2, None, 5.0)], "person_id long, ts timestamp_ntz, kg double")
    stays = spark.createDataFrame([(1, dt.datetime(2020, 2, 1, 9), dt.datetime(2020, 2, 3)), (1, dt.datetime(2020, 2, 10), None)], "person_id long, a timestamp_ntz, d timestamp_ntz")
    drugs = spark.createDataFrame([(1, "Statin", D(2020, 1, 15), D(2020, 3, 10)), (1, "STATIN", D(2020, 2, 20), D(2020, 2, 25)), (2, "other", D(2020, 1, 1), D(2021, 1, 1))],
                                  "person_id long, kind string, a date, d date")
    daily = spark.createDataFrame([(1, "S1", D(2020, 2, 10), 4.0), (1, "S2", D(2020, 2, 10), 8.0), (1, "S1", D(2020, 2, 11), 3.0), (1, "S1", D(2020, 2, 12), None)],
                                  "person_id long, serial string, day date, hr double")
    return spans, [Latest(weights, "ts", {"kg": F.col("kg")}, dates=["kg"]), Touching(stays, "a", "d", "n", "n_cum"),
                   Current(drugs, "a", "d", "kind", {"statin": "statin"}),
                   DayTotals(daily, "day", [("hr", "mean", "hr_mean"), ("hr", "max", "hr_max"), ("hr", "sum", "hr_sum")], "serial")]


ROW = ["person_id", "arm", "start_date"]


def test_every_source(spark):
    spans, sources = inputs(spark)
    out = timeline(spans, sources, "person_id", ROW, "start_date", "periods").orderBy(*ROW, "time").collect()
    got = [(r["person_id"], r["arm"], r["time"], r["kg"], r["kg_dt"], r["n"], r["n_cum"], r["statin"], r["serial"], r["hr_mean"], r["hr_max"], r["hr_sum"]) for r in out]
    # Spans start on 31 January: periods end 31 Jan, 29 Feb, 31 Mar, 30 Apr.
    old = D(2019, 5, 1)
    assert got == [
        (1, "A", 0, 80.0, old, 0, 0, D(2020, 1, 15), None, None, None, None),
        (1, "A", 1, 82.0, D(2020, 2, 29), 2, 2, D(2020, 2, 20), "S2", 5.0, 8.0, 15.0),
        (1, "A", 2, 90.0, D(2020, 2, 29), 0, 2, D(2020, 1, 15), None, None, None, None),
        (1, "A", 3, 90.0, D(2020, 2, 29), 0, 2, None, None, None, None, None),
        (1, "B", 0, 90.0, D(2020, 2, 29), 2, 2, D(2020, 2, 20), "S2", 5.0, 8.0, 15.0),
        (1, "B", 1, 90.0, D(2020, 2, 29), 0, 2, D(2020, 1, 15), None, None, None, None),
        *[(2, "A", t, None, None, 0, 0, None, None, None, None, None) for t in range(3)]]


def test_no_source_and_no_span(spark):
    spans, sources = inputs(spark)
    assert timeline(spans, [], "person_id", ROW, "start_date", "periods").count() == 9
    assert timeline(spans.where("person_id > 9"), sources, "person_id", ROW, "start_date", "periods").count() == 0


def test_no_exchange_of_person_months(spark):
    spans, sources = inputs(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = timeline(spans, sources, "person_id", ROW, "start_date", "periods")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    # The sources' own reductions by person and day, their union and the spans by person: nothing by month.
    assert exchanges and not any("_at#" in e or "time#" in e for e in exchanges)


def test_span_columns_join_no_months(spark):
    """What belongs to a span travels with it: nothing is joined or exchanged above the rows of the months, and equal spans stay apart."""
    from cohortweave.plans.cohort import Sources, Study, time_varying

    def empty(schema):
        return spark.createDataFrame([], schema)

    spans, sources = inputs(spark)
    spans = spans.withColumn("end_date", F.col("start_date")).where("person_id = 1")
    spans = spans.unionByName(spans.where("arm = 'B'"))
    episodes = spark.createDataFrame([(1, "A", D(2020, 1, 31)), (1, "B", D(2020, 3, 1))], "person_id long, arm string, start_date date")
    at = dt.datetime(2020, 2, 1)
    vitals = spark.createDataFrame([(1, "Blood Pressure", at, None, 120.0, 80.0), (1, "blood pressure", at, None, 130.0, 70.0), (1, "blood pressure", at, None, 130.0, 75.0),
                                    (1, "blood pressure", at, None, 90.0, 95.0), (1, "Weight", at, 180.04, None, None), (1, "weight", at, 180.06, None, None)],
                                   "person_id long, kind string, ts timestamp_ntz, value double, systolic double, diastolic double")
    stay = empty("person_id long, admit_ts timestamp_ntz, discharge_ts timestamp_ntz")
    src = Sources(None, vitals, empty("person_id long, phenotype string, ts timestamp_ntz, value double"), None, None, None, None,
                  empty("person_id long, rx_class string, start_date date, end_date date"), stay, stay, None, None, None,
                  empty("person_id long, ts timestamp_ntz, value double"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = time_varying(spans, episodes, src, Study("2021-01-01"), ["A", "B"], {"statin": "statin_tv"})
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    above = plan[:plan.index("Generate explode(sequence(")]
    assert "Join" not in above and "Exchange" not in above
    got = [(r["arm"], r["time"], float(r["weight_tv"] or 0), r["sbp_tv"], r["dbp_tv"], r["crossover_date"]) for r in out.orderBy("arm", "time").collect()]
    cross = D(2020, 3, 1)
    assert got == [("A", 0, 0.0, None, None, cross), *[("A", t, 180.1, 130.0, 75.0, cross) for t in (1, 2, 3)],
                   *[("B", t, 180.1, 130.0, 75.0, None) for t in (0, 0, 1, 1)]]
