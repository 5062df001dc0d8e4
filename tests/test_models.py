"""Weights, balance, outcome models and bootstrap against numpy on small data."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortweave.stats import balance as B, bootstrap as BS, features as X, outcome as O, weights as W


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(1)
    n = 900
    x, g = rng.normal(50, 10, n), rng.choice(["u", "v", "w"], n)
    p = 1 / (1 + np.exp(-(-0.5 + 0.04 * (x - 50) + 0.6 * (g == "v"))))
    exp = (rng.random(n) < p).astype(int)
    T = np.minimum(rng.geometric(0.05 + 0.02 * exp), 30)
    event = (T < 30).astype(int)
    pdf = pd.DataFrame({"key": [f"k{i}" for i in range(n)], "x": x, "g": g, "exp": exp, "T": T, "event": event})
    return pdf, spark.createDataFrame(pdf).cache()


def newton(Xm, y, w):
    b = np.zeros(Xm.shape[1])
    for _ in range(60):
        mu = 1 / (1 + np.exp(-Xm @ b))
        H = (Xm * (w * mu * (1 - mu))[:, None]).T @ Xm
        b = b + np.linalg.solve(H, Xm.T @ (w * (y - mu)))
    return b, np.linalg.inv(H)


def ns(x, knots):
    ks = np.array(knots)
    u, z = (x - ks[0]) / (ks[-1] - ks[0]), (ks - ks[0]) / (ks[-1] - ks[0])
    bend = lambda k: (np.maximum(u - k, 0) ** 3 - np.maximum(u - 1, 0) ** 3) / (1 - k)
    return np.column_stack([u] + [bend(k) - bend(z[-2]) for k in z[:-2]])


TERMS = [X.Term("x", "spline", df=3), X.Term("g", "category", ref="u")]


def matrix(pdf):
    x = pdf["x"].to_numpy()
    knots = np.quantile(x, [0, 1 / 3, 2 / 3, 1])
    return np.column_stack([np.ones(len(x)), ns(x, knots), pdf["g"] == "v", pdf["g"] == "w"]).astype(float)


def test_ps_logistic_matches_numpy(spark, frame):
    pdf, df = frame
    got = W.iptw(W.ps_logistic(df, "exp", X.design(df, TERMS)), "exp").toPandas().set_index("key").loc[pdf["key"]]
    Xm = matrix(pdf)
    b, _ = newton(Xm, pdf["exp"].to_numpy(), np.ones(len(pdf)))
    pd_ = 1 / (1 + np.exp(-Xm @ b))
    assert np.allclose(got["pd"], pd_, atol=1e-6)
    pn = pdf["exp"].mean()
    assert np.allclose(got["iptw"], np.where(pdf["exp"] == 1, pn / pd_, (1 - pn) / (1 - pd_)), rtol=1e-5)


def test_saturated_weights_average_one(spark, frame):
    _, df = frame
    w = W.iptw(W.ps_saturated(df, "exp", ["g"]), "exp")
    for r in w.groupBy("exp").agg(F.avg("iptw").alias("m")).collect():
        assert r["m"] == pytest.approx(1.0, abs=1e-12)
    assert B.smd(w, "exp", categories=["g"], weight="iptw").first()["smd"] < 1e-7


def test_smd_matches_numpy(spark, frame):
    pdf, df = frame
    got = {r["variable"]: r["smd"] for r in B.smd(df, "exp", ["x"], ["g"]).collect()}
    a, b = (pdf[pdf["exp"] == v]["x"] for v in (1, 0))
    assert got["x"] == pytest.approx(abs(a.mean() - b.mean()) / np.sqrt((a.var() + b.var()) / 2), rel=1e-9)
    share = [pdf[pdf["exp"] == v]["g"].value_counts(normalize=True).sort_index().to_numpy()[1:] for v in (1, 0)]
    cov = sum(np.diag(p) - np.outer(p, p) for p in share) / 2
    gap = share[0] - share[1]
    assert got["g"] == pytest.approx(np.sqrt(gap @ np.linalg.inv(cov) @ gap), rel=1e-9)


def expanded(pdf, w):
    rows = np.repeat(np.arange(len(pdf)), pdf["T"])
    t = np.concatenate([np.arange(T) for T in pdf["T"]])
    y = ((t + 1 == pdf["T"].to_numpy()[rows]) & (pdf["event"].to_numpy()[rows] == 1)).astype(float)
    return pdf["exp"].to_numpy()[rows].astype(float), t.astype(float), y, w[rows]


@pytest.fixture(scope="module")
def weighted(spark, frame):
    pdf, df = frame
    w = np.linspace(0.4, 2.2, len(pdf))
    ws = spark.createDataFrame(pd.DataFrame({"key": pdf["key"], "w": w}))
    return pdf, w, df.join(ws, "key")


def test_pooled_hr_matches_expanded_fit(spark, weighted):
    pdf, w, df = weighted
    exp, t, y, wl = expanded(pdf, w)
    Xm = np.column_stack([np.ones(len(t)), exp, ns(t, [0, 6, 12, 24, t.max()])])
    b, inv = newton(Xm, y, wl)
    mu = 1 / (1 + np.exp(-Xm @ b))
    meat = (Xm * ((wl * (y - mu)) ** 2)[:, None]).T @ Xm
    got = O.pooled_hr(O.outcome_cells(df, "exp", "T", "event", "w")).first()
    assert got["estimate"] == pytest.approx(b[1], abs=1e-7)
    assert got["se"] == pytest.approx(np.sqrt((inv @ meat @ inv)[1, 1]), rel=1e-6)


def test_risk_curves_match_expanded_fit(spark, weighted):
    pdf, w, df = weighted
    exp, t, y, wl = expanded(pdf, w)
    S = ns(t, [0, 6, 12, 24, t.max()])
    b, _ = newton(np.column_stack([np.ones(len(t)), exp, S, S * exp[:, None]]), y, wl)
    months = np.arange(int(t.max()) + 1, dtype=float)
    Sm = ns(months, [0, 6, 12, 24, t.max()])
    got = O.risk_curves(O.outcome_cells(df, "exp", "T", "event", "w")).orderBy("time").toPandas()
    for arm in (0.0, 1.0):
        Xs = np.column_stack([np.ones_like(months), np.full_like(months, arm), Sm, Sm * arm])
        ci = 1 - np.cumprod(1 - 1 / (1 + np.exp(-Xs @ b)))
        assert np.allclose(got[f"cuminc_{int(arm)}"], ci, atol=1e-7)
    assert np.allclose(got["rd"], got["cuminc_1"] - got["cuminc_0"])
    assert got["events_1"].iloc[-1] == ((pdf["exp"] == 1) & (pdf["event"] == 1)).sum()


def test_adjusted_curves_match_expanded_fit(spark, weighted):
    pdf, w, df = weighted
    exp, t, y, wl = expanded(pdf, w)
    rows = np.repeat(np.arange(len(pdf)), pdf["T"])
    v, ww = ((pdf["g"] == k).to_numpy(float)[rows] for k in ("v", "w"))
    S = ns(t, [0, 6, 12, 24, t.max()])
    b, _ = newton(np.column_stack([np.ones(len(t)), exp, S, S * exp[:, None], v, ww]), y, wl)
    got = O.risk_curves_adjusted(df, "exp", "T", "event", "w", X.design(df, [X.Term("g", "category", ref="u")]), {"g": "v"},
                                 int(pdf["T"].max())).orderBy("time").toPandas()
    months = np.arange(int(t.max()) + 1, dtype=float)
    Sm = ns(months, [0, 6, 12, 24, t.max()])
    one, zero = np.ones_like(months), np.zeros_like(months)
    ci = 1 - np.cumprod(1 - 1 / (1 + np.exp(-np.column_stack([one, one, Sm, Sm, one, zero]) @ b)))
    assert np.allclose(got["cuminc_1"], ci, atol=1e-5)


@pytest.mark.parametrize("scheme", ["poisson", "multinomial"])
def test_bootstrap_is_stable_and_matches_refits(spark, frame, scheme):
    pdf, df = frame
    d = X.design(df, TERMS)
    args = ("exp", "T", "event", d, "key", 6, 7, scheme)
    a = BS.bootstrap_replicates(df.repartition(3), *args).orderBy("replicate", "time").toPandas()
    b = BS.bootstrap_replicates(df.repartition(5), *args).orderBy("replicate", "time").toPandas()
    assert np.allclose(a["rd"], b["rd"], atol=1e-9)
    if scheme == "multinomial":
        rows = BS.resample_counts(df, "key", 6, 7).toPandas().set_index("key").loc[pdf["key"]]
        counts = np.zeros((len(pdf), 6))
        for i, draws in enumerate(rows["draws"]):
            for r in draws if draws is not None else []:
                counts[i, r["replicate"]] = r["count"]
        assert (counts.sum(axis=0) == len(pdf)).all()
    else:
        h = df.select("key", F.xxhash64("key").alias("h")).toPandas().set_index("key").loc[pdf["key"], "h"].to_numpy()
        counts = BS.poisson_counts(h, 7, 6)
        assert abs(counts.mean() - 1) < 0.1 and abs(counts.var() - 1) < 0.15
    # One replicate by hand: refit the score with the counts, then the outcome model.
    k, Xm, y = counts[:, 2], matrix(pdf), pdf["exp"].to_numpy()
    beta, _ = newton(Xm, y, k)
    pd_, pn = 1 / (1 + np.exp(-Xm @ beta)), (k * y).sum() / k.sum()
    w = k * np.where(y == 1, pn / pd_, (1 - pn) / (1 - pd_))
    keep = k > 0
    sub = pdf[keep].reset_index(drop=True)
    exp, t, ev, wl = expanded(sub, w[keep])
    S = ns(t, [0, 6, 12, 24, t.max()])
    b2, _ = newton(np.column_stack([np.ones(len(t)), exp, S, S * exp[:, None]]), ev, wl)
    months = np.arange(int(t.max()) + 1, dtype=float)
    Sm = ns(months, [0, 6, 12, 24, t.max()])
    ci = 1 - np.cumprod(1 - 1 / (1 + np.exp(-np.column_stack([np.ones_like(months), np.ones_like(months), Sm, Sm]) @ b2)))
    assert np.allclose(a[a["replicate"] == 2]["cuminc_1"], ci, atol=1e-6)


def test_adjusted_outcome_equals_expanded_fit(spark, frame, monkeypatch):
    """Sums per row and month give the coefficients, robust errors and curves of the person-month table."""
    pdf, df = frame
    monkeypatch.setattr(O, "ROWS_PER_WALK", 37)
    weights = 0.5 + (np.arange(len(pdf)) % 7) / 5
    df = spark.createDataFrame(pdf.assign(w=weights)).repartition(5)
    d = X.design(df, [X.Term("x"), X.Term("g", "category")])
    exp, t, ev, wl = expanded(pdf, weights)
    rows = np.repeat(np.arange(len(pdf)), pdf["T"].to_numpy())
    cov = np.column_stack([pdf["x"].to_numpy(), *[(pdf["g"] == lv).to_numpy(float) for lv in sorted(pdf["g"].unique())[1:]]])
    S = ns(t, [0, 6, 12, 24, t.max()])
    for interaction in (False, True):
        fit = O.fit_adjusted(df, "exp", "T", "event", "w", d, interaction)
        full = np.column_stack([np.ones(len(t)), exp, cov[rows], S, *([S * exp[:, None]] if interaction else [])])
        beta, _ = newton(full, ev, wl)
        p = 1 / (1 + np.exp(-full @ beta))
        assert fit.converged and np.allclose(1 / (1 + np.exp(-full @ fit.beta)), p, atol=1e-7)
        bread = np.linalg.pinv((full * (wl * p * (1 - p))[:, None]).T @ full)
        r = wl * (ev - p)
        robust = bread @ (full * (r * r)[:, None]).T @ full @ bread
        assert np.allclose(fit.beta[1:2 + cov.shape[1]], beta[1:2 + cov.shape[1]], atol=1e-6)
        assert np.allclose(np.diag(fit.robust)[1:2 + cov.shape[1]], np.diag(robust)[1:2 + cov.shape[1]], rtol=1e-5)
    ratios = O.pooled_hr_adjusted(df, "exp", "T", "event", "w", d).toPandas()
    assert list(ratios["term"]) == ["exp", *d.names] and (ratios["lower"] < ratios["estimate"]).all()
    curves = O.risk_curves_adjusted(df, "exp", "T", "event", "w", d, {"x": 0.5, "g": sorted(pdf["g"].unique())[0]}, horizon=20).toPandas().sort_values("time")
    months = np.arange(20.0)
    Sm = ns(months, [0, 6, 12, 24, t.max()])
    one = np.column_stack([np.ones(20), np.ones(20), np.full(20, 0.5), np.zeros((20, cov.shape[1] - 1)), Sm, Sm])
    assert np.allclose(curves["cuminc_1"], 1 - np.cumprod(1 - 1 / (1 + np.exp(-one @ beta))), atol=1e-6)
    hits = (pdf["exp"] == 1) & (pdf["event"] == 1) & (pdf["T"] <= 20)
    assert curves["events_1"].iloc[-1] == hits.sum() and curves["w_events_1"].iloc[-1] == pytest.approx(weights[hits].sum())


def test_bootstrap_interval_covers_estimate(spark, frame):
    _, df = frame
    out = BS.bootstrap_curves(df, "exp", "T", "event", X.design(df, TERMS), "key", 30, 7).toPandas()
    inside = (out["rd_lcl"] <= out["rd"]) & (out["rd"] <= out["rd_ucl"])
    assert inside.mean() > 0.9


def test_replicate_fits_over_many_partitions(spark, frame):
    _, df = frame
    d = X.design(df, TERMS)
    data = df.select(F.xxhash64("key").alias("h"), F.col("exp").cast("double").alias("treat"), F.col("T").cast("int").alias("periods"),
                     F.col("event").cast("int").alias("event"), d.array(intercept=True).alias("x"))
    start = np.zeros(len(d.columns) + 1)
    few, share, done = BS.fit_replicates(data.repartition(2), start, 4, 7)
    many, again, _ = BS.fit_replicates(data.repartition(130), start, 4, 7)  # three partial sums for each replicate
    assert done.all() and np.allclose(few, many, atol=1e-6) and np.allclose(share, again)
    assert not BS.fit_replicates(data, start, 4, 7, max_iter=1)[2].any()


def test_poisson_column(spark):
    m = spark.range(20000).select(BS.poisson_count(F.col("id"), 3, 1).alias("c")).agg(F.avg("c"), F.variance("c")).first()
    assert abs(m[0] - 1) < 0.05 and abs(m[1] - 1) < 0.08


def test_boosting(spark, frame):
    from cohortweave.stats import boosting as G

    pdf, df = frame
    d = X.design(df, [X.Term("x"), X.Term("g", "category")])
    params = {"trees": 10, "depth": 2, "shrinkage": 0.2, "min_node": 20}
    scored, model = G.ps_gbt(df, "exp", d, params)
    again, _ = G.ps_gbt(df, "exp", d, params)
    got = scored.select("key", "pd").toPandas().set_index("key").loc[pdf["key"], "pd"].to_numpy()
    assert ((got > 0) & (got < 1)).all()
    assert np.allclose(got, again.select("key", "pd").toPandas().set_index("key").loc[pdf["key"], "pd"])
    y, null = pdf["exp"].to_numpy(), pdf["exp"].mean()
    dev = lambda p: -2 * np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
    assert dev(got) < dev(np.full(len(y), null))
    before = B.smd(df, "exp", ["x"]).first()["smd"]
    assert B.smd(W.iptw(scored, "exp"), "exp", ["x"], weight="iptw").first()["smd"] < before
    imp = G.importance(df, model, d, {"x": "Marker"}).toPandas()
    assert imp["rel_inf"].sum() == pytest.approx(100) and set(imp["variable"]) <= {"x", "g"}
    res = G.tune_gbt(df, "exp", d, [{**params, "trees": 4}], "key", folds=2)
    assert 1 <= res[0]["best_trees"] <= 4 and G.best_params(res)["trees"] == res[0]["best_trees"]


def test_month_table_and_survival(spark, frame):
    pdf, df = frame
    got = O.month_table(O.outcome_cells(df, "exp", "T", "event")).toPandas().set_index(["exp", "time"])
    for arm in (0, 1):
        mine = pdf[pdf["exp"] == arm]
        for t in (0, 5, 20):
            assert got.loc[(arm, t), "n_risk"] == (mine["T"] > t).sum()
            assert got.loc[(arm, t), "n_event"] == ((mine["T"] == t + 1) & (mine["event"] == 1)).sum()
    km = O.kaplan_meier(df, "exp", "T", "event").toPandas()
    assert (km.groupby("exp")["survival"].min() >= 0).all()
    risk = O.at_risk(df, "exp", "T", [0, 6]).toPandas().set_index(["exp", "time"])["n_risk"]
    assert risk[(1, 6)] == ((pdf["exp"] == 1) & (pdf["T"] >= 6)).sum()


def test_running_product_reaches_zero(spark):
    cells = spark.createDataFrame([(0, 1, 1, 2, 2.0, 2.0), (1, 1, 0, 1, 1.0, 1.0), (1, 2, 1, 1, 1.0, 1.0)],
                                  "exp int, periods int, event int, n long, w double, w2 double")
    h = {(r["exp"], r["time"]): r["survival"] for r in O.weighted_hazards(O.month_table(cells)).collect()}
    assert h == {(0, 0): 0.0, (1, 0): 1.0, (1, 1): 0.0}


def test_features(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 4.0), (None, 8.0), (4.0, None)], "a double, b double")
    got = [tuple(r) for r in X.median_impute(df, ["a", "b"]).collect()]
    assert got == [(1.0, 6.0), (2.0, 4.0), (2.0, 8.0), (4.0, 6.0)]
    cut = df.select(X.cut("a", [2, 4], ["low", "mid", "high"]).alias("c")).collect()
    assert [r["c"] for r in cut] == ["low", "mid", None, "high"]
    t1 = B.table_one(df.withColumn("arm", F.lit("z")), "arm", ["a"], ["b"], ["b"]).toPandas()
    pick = lambda **k: t1[(t1[list(k)] == pd.Series(k)).all(axis=1)]["value"].iloc[0]
    assert pick(variable="a", stratum="z", stat="missing_pct") == 25.0
    assert pick(variable="b", stratum="Overall", stat="median") == 6.0
    assert pick(variable="b", level="NA", stratum="z", stat="count") == 2.0


def test_ratios_without_events_or_variance(spark):
    """No event in one arm, no variance, one row in an arm: NULL instead of a division error."""
    from cohortweave.stats.balance import smd
    from cohortweave.stats.outcome import month_table, outcome_cells, risk_curves_saturated

    df = spark.createDataFrame([(0, 2, 0, 1.0), (0, 3, 0, 1.0), (1, 2, 1, 2.0), (1, 3, 0, 2.0)], "t int, months int, died int, x double")
    curves = risk_curves_saturated(month_table(outcome_cells(df, "t", "months", "died"))).collect()
    assert curves and all(r["rr"] is None for r in curves)
    assert smd(df, "t", numeric=["x"]).first()["smd"] is None
    assert smd(df.where("t = 0 OR died = 1"), "t", numeric=["x"]).count() == 1
