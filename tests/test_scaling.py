"""Operators whose groups must not meet in one task: results against plain loops, and what the plans hold."""

import random
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortweave.functions.rows import dense_ids
from cohortweave.operators import asof, summaries as S
from cohortweave.stats import bootstrap as BS


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("strict", [False, True])
def test_timestamp_asof_levels(spark, strict):
    """Same microsecond, same second, same day, earlier day; ties go to the largest value."""
    rng = random.Random(5)
    base = datetime(2024, 1, 1, 23, 59, 58)
    moments = [base + timedelta(microseconds=m) for m in (0, 1, 2, 500_000, 999_999, 1_000_000, 1_500_000, 2_000_000, 2_000_001, 40_000_000_000, 90_000_000_000)]
    facts = [(p, rng.choice(moments), float(v)) for p in (1, 2) for v in range(40)] + [(3, moments[-1], 1.0), (1, None, 9.0), (None, moments[0], 4.0)]
    points = [(p, m) for p in (1, 2, 3, 4) for m in moments]
    got = asof.asof_latest(spark.createDataFrame(points + points[:3], "p int, at timestamp_ntz"), spark.createDataFrame(facts, "p int, ts timestamp_ntz, v double"),
                           "p", "at", "ts", ["v"], strict=strict)
    want = {}
    for p, at in points:
        before = [(t, v) for q, t, v in facts if q == p and t is not None and (t < at if strict else t <= at)]
        if before:
            want[p, at] = max(before)
    assert {(r["p"], r["at"]): (r["ts"], r["v"]) for r in got.collect()} == want
    assert got.count() == len(want) and "Join" not in plan_of(got)


def test_timestamp_asof_hot_day(spark):
    """200,000 facts of one person in one day and 2,000 points: rows, not pairs."""
    facts = spark.range(200_000).select(F.lit(1).alias("p"), F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 400_000).cast("timestamp_ntz").alias("ts"),
                                        F.col("id").cast("double").alias("v"))
    points = spark.range(2000).select(F.lit(1).alias("p"), F.timestamp_micros(F.lit(1_700_000_000_100_000) + F.col("id") * 40_000_000).cast("timestamp_ntz").alias("at"))
    got = asof.asof_latest(points, facts, "p", "at", "ts", ["v"])
    assert got.count() == 2000 and got.agg(F.sum("v")).first()[0] == sum(min(100 * i, 199_999) for i in range(2000))


def test_quantiles_of_any_scale(spark):
    """Epoch seconds of one day, nanosecond steps and mixed signs: ranges come from the values, not from a fixed scale."""
    rng = np.random.default_rng(3)
    groups = {"epoch": 1.7e9 + rng.integers(0, 86_400, 4000), "fine": 1 + rng.integers(0, 1000, 3000) * 1e-9, "signs": rng.normal(size=2000) * 10.0 ** rng.integers(-200, 200, 2000)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double").repartition(6)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for method, name in (("linear", "linear"), ("disc", "inverted_cdf")):
            got = {(r["g"], r["prob"]): r["q"] for r in S.exact_quantiles(df, ["g"], "v", [0.01, 0.5, 0.9], method).collect()}
            assert all(got[g, p] == pytest.approx(np.quantile(vs, p, method=name), rel=1e-14) for g, vs in groups.items() for p in (0.01, 0.5, 0.9))
        out = S.exact_quantiles(df, [], "v", [0.5])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert out.count() == 1 and "Scan parquet" not in plan_of(out) and "LocalTableScan" not in plan_of(out)  # only the kept counts are read
    assert S.exact_quantiles(df.where("v IS NULL"), ["g"], "v", [0.5]).count() == 0


def test_dense_ids_over_partitions(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), (F.col("id") % 3).alias("b"))
    got = dense_ids(df.repartition(9), ["b"], ["k"])
    rows = sorted((r["b"], r["k"], r["id"]) for r in got.collect())
    assert [r[2] for r in rows] == list(range(1, 5001)) and "SinglePartition" not in plan_of(got)
    assert dense_ids(df.where("k < 0"), ["b"], ["k"]).count() == 0


def test_exact_resampling_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(BS, "ROWS_PER_BUCKET", 90)
    df = spark.range(1000).select(F.concat(F.lit("k"), "id").alias("key"))

    def drawn(frame):
        counts = np.zeros((1000, 40))
        for r in BS.resample_counts(frame, "key", 40, 3).collect():
            for d in r["draws"]:
                counts[int(r["key"][1:]), d["replicate"]] = d["count"]
        return counts
    counts = drawn(df.repartition(4))
    assert (counts.sum(axis=0) == 1000).all() and 0.85 < counts.var() < 1.15 and abs(np.corrcoef(counts[:, 0], counts[:, 1])[0, 1]) < 0.15
    assert (drawn(df.repartition(7)) == counts).all()


def test_packed_draws_equal_the_pairs(spark, monkeypatch):
    """A row's draws take a byte per replicate; counts over 255 and rows of an unknown key are kept apart."""
    monkeypatch.setattr(BS, "ROWS_PER_BUCKET", 90)
    df = spark.range(300).select(F.when(F.col("id") > 0, F.concat(F.lit("k"), "id")).alias("key"))
    pairs = {r["key"]: r["draws"] for r in BS.resample_counts(df, "key", 40, 3).collect()}
    packed = BS.resample_counts(df, "key", 40, 3, packed=True).toArrow()
    assert {len(v) for v in packed.column("draws").to_pylist() if v} == {40}
    got = BS.unpack_counts(packed.column("draws").combine_chunks(), 40)
    for key, row in zip(packed.column("key").to_pylist(), got):
        assert {k: int(c) for k, c in enumerate(row) if c} == {d["replicate"]: d["count"] for d in pairs[key] or []}
    wide = pa.array([np.array([300, 1], "<u8").tobytes(), None, bytes([2, 0])], pa.binary())
    assert BS.unpack_counts(wide, 2).tolist() == [[300, 1], [0, 0], [2, 0]]


def test_limits_leave_out_unconverged_replicates(spark):
    point = spark.createDataFrame([(0, 0.1, 0.2, 0.1, 2.0)], "time int, cuminc_0 double, cuminc_1 double, rd double, rr double")
    rows = [(k, 0, 0.1, 0.2, 0.1 * k, 2.0, k < 3) for k in range(4)]
    out = BS.with_limits(point, spark.createDataFrame(rows, "replicate int, time int, cuminc_0 double, cuminc_1 double, rd double, rr double, converged boolean")).first()
    assert out["n_replicates"] == 3 and out["rd_ucl"] < 0.2
