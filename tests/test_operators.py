"""Cohort operators against plain folds and searches on small data."""

import random
from collections import defaultdict
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cohortweave.operators import asof, episodes as E, intervals as I, persons, phenotype, reshape, summaries as S

DAY0 = date(2019, 1, 1)


def fold(fills, grace=30):
    """The episode rule, one fill at a time."""
    out, state = [], {}
    for key, s, d in sorted(fills, key=lambda f: (f[0], f[1])):
        if key in state and s <= state[key][1] + timedelta(days=grace):
            first, end, total = state[key]
            state[key] = (first, max(end, s) + timedelta(days=d), total + d)
        else:
            if key in state:
                out.append((*key, *state[key]))
            state[key] = (s, s + timedelta(days=d), d)
    return sorted(out + [(*k, *v) for k, v in state.items()])


def run_episodes(spark, fills, partitions=None):
    df = spark.createDataFrame([(*k, s, d) for k, s, d in fills],
                               "person_id int, arm string, start_date date, days_supply int")
    if partitions:
        df = df.repartition(partitions)
    return sorted(tuple(r) for r in E.treatment_episodes(df, ["person_id", "arm"]).collect())


def test_episode_edges(spark):
    k = (1, "A")
    fills = [(k, DAY0, 10), (k, DAY0 + timedelta(days=40), 5),        # gap of exactly 30: bridged
             (k, DAY0 + timedelta(days=76), 5),                       # gap of 31: new episode
             (k, DAY0 + timedelta(days=77), 30), (k, DAY0 + timedelta(days=77), 30),  # stockpiled, same day
             ((2, "A"), DAY0, 1), ((2, "B"), DAY0, 1)]
    assert run_episodes(spark, fills) == fold(fills)


@pytest.mark.parametrize("partitions", [1, 7, 64])
def test_episodes_equal_fold_with_a_hot_person(spark, partitions):
    rng = random.Random(5)
    fills = [((rng.randint(2, 40), rng.choice("AB")), DAY0 + timedelta(days=rng.randint(0, 900)), rng.randint(1, 50))
             for _ in range(800)]
    fills += [((1, "A"), DAY0 + timedelta(days=rng.randint(0, 3000)), rng.randint(1, 3)) for _ in range(400)]
    assert run_episodes(spark, fills, partitions) == fold(fills)


def test_exposure_rules(spark):
    fills = spark.createDataFrame([
        (1, "B", datetime(2020, 1, 5), 10), (1, "B", datetime(2020, 1, 5), 10), (1, "A", datetime(2019, 12, 1), 10),
        (2, "B", datetime(2019, 12, 1), 10), (2, "B", datetime(2020, 2, 1), 10), (2, "A", datetime(2020, 1, 1), 10),
        (3, "A", datetime(2020, 1, 3), None)], "person_id int, arm string, release_ts timestamp_ntz, days_supply int")
    eligible = spark.createDataFrame([(p, date(2020, 1, 1)) for p in (1, 2, 3)], "person_id int, eligible_date date")
    rows = E.exposure_fills(fills, eligible, "B", "A").select("person_id", "arm", "start_date", "end_date").collect()
    # Person 2 had arm B before eligibility: the whole arm is dropped.
    assert sorted(map(tuple, rows)) == [(1, "B", date(2020, 1, 5), date(2020, 1, 15)),
                                        (2, "A", date(2020, 1, 1), date(2020, 1, 11))]
    days = E.exposure_days(fills, eligible, "B", "A").select("person_id", "arm", "days_supply").collect()
    assert sorted(map(tuple, days)) == [(1, "B", 10), (2, "A", 10)]


def test_user_type(spark):
    index = spark.createDataFrame([(p, "B", date(2020, 7, 1)) for p in (1, 2, 3, 4)], "person_id int, arm string, start_date date")
    prior = spark.createDataFrame([
        (1, date(2019, 12, 1), date(2020, 1, 3)), (2, date(2019, 12, 1), date(2020, 1, 2)),
        (3, date(2020, 6, 1), date(2020, 9, 1)), (4, date(2020, 7, 1), date(2020, 8, 1))],
        "person_id int, start_date date, end_date date")
    got = {r["person_id"]: (r["gap_days"], r["user_type"]) for r in E.user_type(index, prior).collect()}
    assert got == {1: (180, "Prevalent"), 2: (181, "New"), 3: (-62, "Prevalent"), 4: (None, "New")}


def _facts(spark, rng, n=400, persons=12):
    rows = [(rng.randint(1, persons), datetime(2019, 1, 1) + timedelta(days=rng.randint(0, 500), hours=rng.choice([0, 0, 9])),
             float(rng.randint(0, 50))) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "person_id int, ts timestamp_ntz, value double")


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("kind", ["date", "timestamp_ntz"])
def test_asof_latest(spark, strict, kind):
    rng = random.Random(3)
    rows, facts = _facts(spark, rng)
    if kind == "date":
        points = sorted({(rng.randint(1, 14), DAY0 + timedelta(days=rng.randint(0, 500))) for _ in range(60)})
    else:
        points = sorted({(rng.randint(1, 14), rng.choice(rows)[1] + timedelta(hours=rng.choice([0, 0, 1]))) for _ in range(60)})
    index = spark.createDataFrame(points, f"person_id int, at {kind}")
    want = {}
    for p, at in points:
        stamp = datetime(at.year, at.month, at.day) if kind == "date" else at
        hits = [(ts, v) for q, ts, v in rows if q == p and (ts < stamp if strict else ts <= stamp)]
        if hits:
            want[(p, at)] = max(hits)
    got = {(r["person_id"], r["at"]): (r["ts"], r["value"])
           for r in asof.asof_latest(index, facts, "person_id", "at", "ts", ["value"], strict=strict).collect()}
    assert got == want


def test_asof_nearest(spark):
    rng = random.Random(4)
    rows = [(rng.randint(1, 9), None if rng.random() < 0.03 else DAY0 + timedelta(days=rng.randint(0, 60)), rng.randint(0, 9))
            for _ in range(150)]
    facts = spark.createDataFrame(rows, "person_id int, day date, zip int")
    points = sorted({(rng.randint(1, 10), DAY0 + timedelta(days=rng.randint(-10, 80))) for _ in range(80)})
    index = spark.createDataFrame(points, "person_id int, at date")
    want = {}
    for p, at in points:
        mine = [(d is not None, abs((d - at).days) if d else 0, d or DAY0, z) for q, d, z in rows if q == p]
        if mine:
            best = min(mine)
            want[(p, at)] = (best[2] if best[0] else None, best[3])
    got = {(r["person_id"], r["at"]): (r["day"], r["zip"])
           for r in asof.asof_nearest(index, facts, "person_id", "at", "day", ["zip"]).collect()}
    assert got == want


def add_months(d, n):
    m = d.month - 1 + n
    y, m = d.year + m // 12, m % 12 + 1
    last = [31, 29 if y % 4 == 0 and (y % 100 or y % 400 == 0) else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][m - 1]
    return date(y, m, min(d.day, last))


def _touch(s, e, a, d):
    return (a is not None and s <= a < e) or (d is not None and s <= d < e) or (None not in (a, d) and a <= e <= d)


def _spans(spark, rng):
    rows = [(p, "A", DAY0 + timedelta(days=rng.randint(0, 60)) if p > 3 else date(2019, 1, 31), rng.randint(1, 14))
            for p in range(1, 10)]
    return rows, spark.createDataFrame(rows, "person_id int, arm string, start_date date, periods int")


def test_overlap_count_and_pairs(spark):
    rng = random.Random(8)
    spans, spans_df = _spans(spark, rng)
    stays = []
    for _ in range(300):
        a = datetime(2018, 11, 1) + timedelta(days=rng.randint(0, 500), hours=rng.choice([0, 7]))
        d = rng.choice([None, a + timedelta(days=rng.choice([0, 1, 3, 40, 200]), hours=rng.choice([0, 5])),
                        a - timedelta(days=rng.randint(1, 70))])
        stays.append((rng.randint(1, 9), a if rng.random() > 0.05 else None, d))
    stays_df = spark.createDataFrame(stays, "person_id int, a timestamp_ntz, d timestamp_ntz")
    midnight = lambda x: datetime(x.year, x.month, x.day)
    want, windows = {}, []
    for p, arm, start, periods in spans:
        for t in range(periods):
            e = add_months(start, t)
            s = midnight(add_months(e, -1))
            windows.append((p, t, s, midnight(e)))
            want[(p, t)] = sum(_touch(s, midnight(e), a, d) for q, a, d in stays if q == p)
    got = I.overlap_count(spans_df, stays_df, "person_id", ["person_id", "arm", "start_date"], "start_date", "periods", "a",
                          "d", "n", "cum").collect()
    assert {(r["person_id"], r["time"]): r["n"] for r in got} == want
    running = defaultdict(int)
    for r in sorted(got, key=lambda r: (r["person_id"], r["time"])):
        running[r["person_id"]] += r["n"]
        assert r["cum"] == running[r["person_id"]]
    w = spark.createDataFrame(windows, "person_id int, t int, s timestamp_ntz, e timestamp_ntz")
    pairs = I.overlaps(w, stays_df, "person_id", "s", "e", "a", "d").groupBy("person_id", "t").count().collect()
    assert {(r["person_id"], r["t"]): r["count"] for r in pairs} == {k: v for k, v in want.items() if v}


def test_asof_by_period(spark):
    rng = random.Random(9)
    rows, facts = _facts(spark, rng, 200, 9)
    spans, spans_df = _spans(spark, rng)
    want = {}
    for p, arm, start, periods in spans:
        for t in range(periods):
            e = add_months(start, t)
            hits = [(ts, v) for q, ts, v in rows if q == p and ts <= datetime(e.year, e.month, e.day)]
            want[(p, t)] = max(hits)[1] if hits else None
    got = asof.asof_by_period(spans_df, facts, "person_id", ["person_id", "arm", "start_date"], "start_date", "periods", "ts",
                              {"v": F.col("value")}).collect()
    assert {(r["person_id"], r["time"]): r["v"] for r in got} == want


def test_active_at_and_lookback_edges(spark):
    index = spark.createDataFrame([(1, date(2020, 3, 31))], "person_id int, at date")
    rx = spark.createDataFrame([(1, "start", date(2020, 3, 31), date(2020, 5, 1)), (1, "end", date(2020, 3, 1), date(2020, 3, 31)),
                                (1, "over", date(2020, 3, 1), date(2020, 3, 30))], "person_id int, c string, s date, e date")
    assert [r["c"] for r in I.active_at(index, rx, "person_id", "at", "s", "e", ["c"]).collect()] == ["end"]
    facts = spark.createDataFrame([(1, datetime(2020, 2, 29)), (1, datetime(2020, 2, 28, 23)), (1, datetime(2020, 3, 30, 23)),
                                   (1, datetime(2020, 3, 31))], "person_id int, ts timestamp_ntz")
    assert I.lookback_count(index, facts, "person_id", "at", "ts", 1).first()["n"] == 2
    assert I.lookback_latest(index, facts, "person_id", "at", "ts", 1).first()["latest"] == date(2020, 3, 30)


def test_phenotype_rule(spark):
    index = spark.createDataFrame([(p, date(2020, 6, 1)) for p in range(1, 6)], "person_id int, at date")
    inp = spark.createDataFrame([(4, "c", datetime(2020, 3, 1)), (5, "c", datetime(2020, 7, 1))],
                                "person_id int, concept string, ts timestamp_ntz")
    t = datetime(2020, 1, 1, 10)
    out = spark.createDataFrame([(1, "c", t, t), (2, "c", t, t), (2, "c", t, t), (3, "c", t, t), (3, "c", datetime(2020, 2, 1), t),
                                 (4, "c", t, t), (4, "c", datetime(2020, 4, 1), t), (5, "c", t, t),
                                 (5, "c", datetime(2020, 1, 9), datetime(2020, 6, 2))],
                                "person_id int, concept string, ts timestamp_ntz, visit_ts timestamp_ntz")
    got = {r["person_id"]: r["onset"] for r in phenotype.phenotype_onset(index, inp, out, "person_id", "at").collect()}
    assert got == {3: datetime(2020, 2, 1), 4: datetime(2020, 3, 1)}


def test_modal_category_ties(spark):
    codes = {"CURRENT SMOKER": 1, "FORMER SMOKER": 2, "NEVER SMOKER": 0}
    at, t = date(2020, 6, 1), datetime(2020, 1, 1)
    rows = [(1, "CURRENT SMOKER"), (1, "FORMER SMOKER"), (2, "former smoker"), (2, "NEVER SMOKER"), (3, "NEVER SMOKER"),
            (4, "UNKNOWN"), (5, "NEVER SMOKER"), (5, "NEVER SMOKER"), (5, "CURRENT SMOKER")]
    facts = spark.createDataFrame([(p, t, s) for p, s in rows], "person_id int, ts timestamp_ntz, status string")
    index = spark.createDataFrame([(p, at) for p in range(1, 6)], "person_id int, at date")
    got = {r["person_id"]: r["code"] for r in S.modal_category(index, facts, "person_id", "at", "ts", "status", codes).collect()}
    assert got == {1: 1, 2: 2, 3: 0, 4: None, 5: 0}


@pytest.mark.parametrize("method", ["linear", "disc"])
def test_exact_quantiles(spark, method):
    import numpy as np

    rng = random.Random(2)
    groups = {"a": [rng.gauss(0, 1000) for _ in range(301)], "b": [7.0] * 50, "c": [70.0, 71.0, 72.0, 73.0], "d": [-1.5],
              "e": [rng.choice([1e-9, 1e12, -3.0, 0.0]) for _ in range(77)]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in [*vs, None]], "g string, v double")
    probs = [0.0, 0.025, 1 / 3, 0.5, 0.975, 1.0]
    got = {(r["g"], r["prob"]): r["q"] for r in S.exact_quantiles(df.repartition(7), ["g"], "v", probs, method).collect()}
    for g, vs in groups.items():
        for p in probs:
            want = np.quantile(vs, p, method="linear" if method == "linear" else "inverted_cdf")
            assert got[(g, p)] == pytest.approx(want, rel=1e-12, abs=1e-12)


def test_pivot_ignores_case_and_expansion(spark):
    df = spark.createDataFrame([(1, "mi", DAY0), (1, "MI", date(2020, 1, 1)), (2, "other", DAY0)], "k int, c string, d date")
    got = {r["k"]: (r["mi_dt"], r["tia_dt"]) for r in reshape.pivot_dates(df, ["k"], "c", "d", {"Mi": "mi_dt", "TIA": "tia_dt"}).collect()}
    assert got == {1: (date(2020, 1, 1), None), 2: (None, None)}
    spans = spark.createDataFrame([(1, date(2020, 1, 31), 1, 1), (2, date(2020, 1, 31), 3, 1), (3, DAY0, 0, 1)],
                                  "id int, s date, T int, ev int")
    rows = [tuple(r) for r in reshape.expand_periods(spans, "T", "s", event="ev").select(
        "id", "time", "interval_start", "event").orderBy("id", "time").collect()]
    assert rows == [(1, 0, date(2020, 1, 31), 1), (2, 0, date(2020, 1, 31), 0), (2, 1, date(2020, 2, 29), 0),
                    (2, 2, date(2020, 3, 31), 1)]


def test_merge_rejects_repeated_keys(spark):
    base = spark.createDataFrame([(1,), (2,)], "k int")
    good = spark.createDataFrame([(1, "x")], "k int, v string")
    assert persons.merge_covariates(base, {"good": good}, ["k"]).count() == 2
    bad = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(Exception, match="not unique"):
        persons.merge_covariates(base, {"bad": bad}, ["k"]).collect()


def test_death_cascade_labels(spark):
    links = spark.createDataFrame([(p, p) for p in range(1, 6)] + [(1, 1)], "person_id int, icn int")
    master = spark.createDataFrame([(1, datetime(2020, 1, 1), None), (2, None, datetime(2019, 1, 1))],
                                   "icn int, dod timestamp_ntz, missing timestamp_ntz")
    reg = spark.createDataFrame([(1, datetime(2021, 1, 1)), (3, datetime(2019, 1, 1)), (4, datetime(2020, 2, 1))], "icn int, d timestamp_ntz")
    pat = spark.createDataFrame([(3, datetime(2020, 3, 1)), (4, datetime(2020, 3, 1))], "icn int, d timestamp_ntz")
    out = phenotype.death_date(links, master, [("registry", reg, "d"), ("patient", pat, "d")], "icn", "person_id",
                               [("master", "dod"), ("missing", "missing")])
    assert sorted(map(tuple, out.collect())) == [
        (1, date(2020, 1, 1), "master"), (2, date(2019, 1, 1), "missing"), (3, date(2020, 3, 1), "patient"),
        (4, date(2020, 2, 1), "registry")]


def test_dense_ids(spark):
    from cohortweave.functions.rows import dense_ids

    df = spark.createDataFrame([(i % 3, i) for i in range(50)], "b int, k int")
    got = sorted((r["b"], r["k"], r["id"]) for r in dense_ids(df.repartition(5), ["b"], ["k"]).collect())
    assert [x[2] for x in got] == list(range(1, 51))


def test_sources_round_trip(spark, tmp_path):
    from cohortweave.sources import expect, harmonise, load, save, save_tsv

    df = spark.createDataFrame([(1, "a"), (2, None), (-1, "b")], "k int, v string")
    save(df, str(tmp_path / "t.parquet"))
    save(df, str(tmp_path / "t.parquet"))
    assert load(spark, str(tmp_path), "t", ["k"]).count() == 3
    save_tsv(df.orderBy("k").coalesce(1), str(tmp_path / "tsv"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "tsv").glob("part-*")))
    assert text.splitlines()[0].split("\t") == ["-1", "b"]
    assert save_tsv(df, str(tmp_path / "table1.txt"), date(2024, 3, 5)) == str(tmp_path / "table1_2024-03-05.txt")
    assert spark.read.csv(str(tmp_path / "table1_2024-03-05.txt"), sep="\t").count() == 3
    valid, rejected = expect(df, {"positive": F.col("k") > 0, "known": F.col("v") != "zz"})
    assert valid.count() == 2 and [r["failed_checks"] for r in rejected.collect()] == [["positive"]]
    other = df.withColumnsRenamed({"k": "Key", "v": "Value"})
    assert harmonise([df, other], [{"id": "k", "t": "v"}, {"id": "Key", "t": "Value"}]).count() == 3


def test_influenza_shots(spark):
    from cohortweave.operators.codes import listed_shots

    rows = [(1, "140", datetime(2019, 10, 1, 9)), (2, "17", datetime(2019, 10, 1)), (3, " 88", datetime(2013, 1, 1)), (4, "150", datetime(2012, 12, 31, 23)),
            (5, "150", datetime(2020, 9, 30)), (6, "150", datetime(2020, 9, 30, 8)), (7, None, datetime(2019, 1, 1)), (8, "15", None)]
    shots = spark.createDataFrame(rows, "person_id int, cvx string, ts timestamp")
    out = listed_shots(shots, "cvx", "ts", "2013-01-01", "2020-09-30")
    assert sorted(r["person_id"] for r in out.collect()) == [1, 3, 5]
    assert [r["person_id"] for r in listed_shots(shots, "cvx", "ts", "2013-01-01", "2020-09-30", ["17"]).collect()] == [2]


def test_onset_reads_the_records_once(spark):
    """Index dates and both kinds of records come from one compact stage table, without an exchange of its rows by code."""
    from cohortweave.catalog import QUERIES
    from cohortweave.catalog.relational import ONSET_COLUMNS

    plan = QUERIES["phenotype_onset"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_partkey" not in plan and "drug_name" not in plan and "stage_" in plan
    assert "strategy=broadcast" in plan and len(ONSET_COLUMNS) == 7


def test_exposure_starts_are_the_first_exposure_days(spark):
    from cohortweave.operators.episodes import exposure_days, exposure_starts

    def day(k):
        return datetime(2000, 1, 1) + timedelta(days=k)
    fills = [(p, a, day((p * 7 + i * 13) % 60), i % 3 or None) for p in range(9) for i, a in enumerate("ABABAA")] + [(None, "A", day(3), 1)]
    fills = spark.createDataFrame(fills + fills[:5], "person_id int, arm string, release_ts timestamp_ntz, days_supply int")
    eligible = spark.createDataFrame([(p, day(p * 4).date()) for p in range(8)] + [(2, day(1).date()), (None, day(1).date())], "person_id int, eligible_date date")
    want = exposure_days(fills, eligible, "B", "A").groupBy("person_id", "arm").agg(F.min("start_date").alias("start_date"))
    got = exposure_starts(fills, eligible, "B", "A")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
