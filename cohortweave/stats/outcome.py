"""Pooled logistic outcome models on person-month data that is never expanded.

The outcome model depends on (arm, month) only, so the weighted likelihood is a
function of sums per (arm, months of follow-up, event).  These cells come from one
aggregate; everything after it has at most a few hundred rows per replicate.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortweave.session import staged
from cohortweave.stats.features import Design
from cohortweave.stats.sums import summed

INNER_KNOTS = (6.0, 12.0, 24.0)


def outcome_cells(df: DataFrame, treat: str, periods: str, event: str, weight: str | Column | None = None,
                  by: Sequence[str] = ()) -> DataFrame:
    """(by, exp, periods, event): rows, sum of weights and of squared weights."""
    w = F.lit(1.0) if weight is None else (F.col(weight) if isinstance(weight, str) else weight).cast("double")
    return (df.where(F.col(periods) >= 1)
            .groupBy(*by, F.col(treat).cast("int").alias("exp"), F.col(periods).cast("int").alias("periods"),
                     F.coalesce(F.col(event).cast("int"), F.lit(0)).alias("event"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"), F.sum(w * w).alias("w2")))


def month_table(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, exp, time): weights and rows at risk and with the event, for every month of follow-up."""
    by = list(by)
    ends = cells.groupBy(*by, "exp", "periods").agg(
        F.sum("n").alias("n"), F.sum("w").alias("w"),
        F.sum(F.when(F.col("event") == 1, F.col("n")).otherwise(0)).alias("d"),
        F.sum(F.when(F.col("event") == 1, F.col("w")).otherwise(0.0)).alias("dw"))
    last = ends.groupBy(*by, "exp").agg(F.max("periods").alias("_last"))
    months = last.select(*by, "exp", F.explode(F.sequence(F.lit(0), F.col("_last") - 1)).alias("time"))
    filled = months.join(ends.withColumn("time", F.col("periods") - 1), [*by, "exp", "time"], "left")
    later = Window.partitionBy(*by, "exp").orderBy(F.col("time").desc()).rowsBetween(Window.unboundedPreceding, 0)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return filled.select(
        *by, "exp", "time", F.sum(zero("n")).over(later).alias("n_risk"), F.sum(zero("w")).over(later).alias("w_risk"),
        zero("d").alias("n_event"), zero("dw").cast("double").alias("w_event"))


def running_product(column: Column, window) -> Column:
    """Running product of (1 - column) for values in [0, 1]."""
    step = F.when(column >= 1, F.lit(float("-inf"))).otherwise(F.log1p(-column))
    return F.exp(F.sum(step).over(window))


def weighted_hazards(months: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Weighted hazard and survival per (by, exp, time), one level per month."""
    run = Window.partitionBy(*by, "exp").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    h = months.withColumn("hazard", F.try_divide("w_event", "w_risk"))
    return h.withColumn("survival", running_product(F.col("hazard"), run))


def risk_curves_saturated(months: DataFrame) -> DataFrame:
    """Risk curves with one level per month and arm: events so far, cumulative incidence, RD, RR."""
    run = Window.partitionBy("exp").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    h = weighted_hazards(months).withColumn("events", F.sum("n_event").over(run))
    side = lambda a, c: F.max(F.when(F.col("exp") == a, c))
    wide = h.groupBy("time").agg(
        side(0, F.col("events")).cast("long").alias("events_0"), side(1, F.col("events")).cast("long").alias("events_1"),
        side(0, 1 - F.col("survival")).alias("cuminc_0"), side(1, 1 - F.col("survival")).alias("cuminc_1"))
    return wide.withColumn("rd", F.col("cuminc_1") - F.col("cuminc_0")).withColumn(
        "rr", F.try_divide("cuminc_1", "cuminc_0"))


# ---- small fits on the cells of one replicate --------------------------------

def _spline(t: np.ndarray, low: float, high: float) -> np.ndarray:
    ks = np.unique([low, *[k for k in INNER_KNOTS if low < k < high], high])
    if len(ks) < 2:
        return np.zeros((len(t), 0))
    u, z = (t - low) / (high - low), (ks - low) / (high - low)

    def bend(k: float) -> np.ndarray:
        return (np.maximum(u - k, 0) ** 3 - np.maximum(u - 1, 0) ** 3) / (1 - k)

    return np.column_stack([u] + [bend(k) - bend(z[-2]) for k in z[:-2]])


def _month_arrays(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
    """Per arm and month: weights (and squares) at risk and with the event."""
    size = int(pdf["periods"].max())
    out = {k: np.zeros((2, size)) for k in ("w", "w2", "n")}
    event = {k: np.zeros((2, size)) for k in ("w", "w2", "n")}
    arm, t, is_event = pdf["exp"].to_numpy(int), pdf["periods"].to_numpy(int) - 1, pdf["event"].to_numpy() == 1
    for k in out:
        v = pdf[k].to_numpy(float)
        np.add.at(out[k], (arm, t), v)
        np.add.at(event[k], (arm[is_event], t[is_event]), v[is_event])
        out[k] = out[k][:, ::-1].cumsum(axis=1)[:, ::-1]
    return {**{f"risk_{k}": v for k, v in out.items()}, **{f"event_{k}": v for k, v in event.items()}}


def _newton(X: np.ndarray, risk: np.ndarray, event: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted binomial fit; returns coefficients and the inverse information."""
    beta = np.zeros(X.shape[1])
    share = event.sum() / risk.sum()
    beta[0] = np.log(max(share, 1e-12) / max(1 - share, 1e-12))
    inv = np.zeros((X.shape[1],) * 2)

    def deviance(b: np.ndarray) -> float:
        eta = np.clip(X @ b, -500, 500)
        return float(2 * np.sum(risk * np.logaddexp(0, eta) - event * eta))

    dev = deviance(beta)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(X @ beta, -500, 500)))
        inv = np.linalg.pinv((X * (risk * p * (1 - p))[:, None]).T @ X)
        step = inv @ (X.T @ (event - risk * p))
        scale = 1.0
        new = beta + step
        while deviance(new) > dev + 1e-9 * abs(dev) and scale > 1e-4:
            scale /= 2
            new = beta + scale * step
        change, beta, last = np.max(np.abs(new - beta)), new, dev
        dev = deviance(beta)
        if change < 1e-10 or abs(last - dev) < 1e-12 * (abs(dev) + 1e-12):
            break
    return beta, inv


def _model(pdf: pd.DataFrame, interaction: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict, float]:
    cells = _month_arrays(pdf)
    size = cells["risk_w"].shape[1]
    t = np.tile(np.arange(size, dtype=float), 2)
    arm = np.repeat([0.0, 1.0], size)
    high = float(size - 1)
    S = _spline(t, 0.0, high)
    cols = [np.ones_like(t), arm, *S.T]
    if interaction:
        cols += list((S * arm[:, None]).T)
    X = np.column_stack(cols)
    risk, event = cells["risk_w"].ravel(), cells["event_w"].ravel()
    keep = risk > 0
    beta, inv = _newton(X[keep], risk[keep], event[keep])
    return beta, inv, X, cells, high


_HR_SCHEMA = "term string, estimate double, se double, lower double, upper double, p_value double"


def _hazard_ratio(pdf: pd.DataFrame) -> pd.DataFrame:
    from math import erfc, sqrt

    beta, inv, X, cells, _ = _model(pdf, interaction=False)
    p = 1 / (1 + np.exp(-X @ beta))
    r2, e2 = cells["risk_w2"].ravel(), cells["event_w2"].ravel()
    meat = (X * (e2 * (1 - p) ** 2 + (r2 - e2) * p ** 2)[:, None]).T @ X
    se = float(np.sqrt((inv @ meat @ inv)[1, 1]))
    est = float(beta[1])
    z = 1.959963984540054
    return pd.DataFrame({"term": ["exp"], "estimate": [est], "se": [se], "lower": [est - z * se],
                         "upper": [est + z * se], "p_value": [erfc(abs(est / se) / sqrt(2)) if se > 0 else None]})


def pooled_hr(cells: DataFrame) -> DataFrame:
    """Log hazard ratio of the exposed arm with robust (HC0) standard error, interval and p-value.

    Model: event ~ arm + natural spline of month, weighted.
    """
    return cells.groupBy(F.lit(0).alias("_r")).applyInPandas(_hazard_ratio, _HR_SCHEMA)


_CURVE = "time int, events_0 long, events_1 long, cuminc_0 double, cuminc_1 double, rd double, rr double"


def curve_rows(pdf: pd.DataFrame, horizon: int | None) -> pd.DataFrame:
    """Risk curve of one replicate's cells."""
    beta, _, _, cells, high = _model(pdf, interaction=True)
    months = np.arange(int(high) + 1 if horizon is None else min(horizon, int(high) + 1), dtype=float)
    S = _spline(months, 0.0, high)
    one = np.ones_like(months)
    cum = []
    for arm in (0.0, 1.0):
        X = np.column_stack([one, one * arm, S, S * arm])
        cum.append(1 - np.cumprod(1 - 1 / (1 + np.exp(-np.clip(X @ beta, -500, 500)))))
    events = cells["event_n"].cumsum(axis=1)[:, : len(months)]
    with np.errstate(divide="ignore", invalid="ignore"):
        rr = cum[1] / cum[0]
    return pd.DataFrame({"time": months.astype("int32"), "events_0": events[0].astype("int64"),
                         "events_1": events[1].astype("int64"), "cuminc_0": cum[0], "cuminc_1": cum[1],
                         "rd": cum[1] - cum[0], "rr": rr})


def risk_curves(cells: DataFrame, by: str | None = None, horizon: int | None = None) -> DataFrame:
    """Standardised risk curves from the cells, per replicate when ``by`` is given.

    Model: event ~ arm * natural spline of month, weighted; survival is the running
    product of one minus the predicted monthly risk.
    """
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        out = curve_rows(pdf, horizon)
        if by:
            out.insert(0, by, pdf[by].iloc[0])
        return out

    if by:
        kind = dict(cells.dtypes)[by]
        return cells.groupBy(by).applyInPandas(fit, f"{by} {kind}, {_CURVE}")
    return cells.groupBy(F.lit(0).alias("_r")).applyInPandas(fit, _CURVE)


# ---- outcome models with covariates ---------------------------------------------

ROWS_PER_WALK = 4096


@dataclass
class AdjustedFit:
    """A fitted outcome model: event ~ arm + covariates + spline of month (+ arm x spline)."""

    names: list[str]
    beta: np.ndarray
    inverse: np.ndarray
    robust: np.ndarray
    covariates: Design
    high: float
    interaction: bool
    converged: bool

    def basis(self, months: np.ndarray) -> np.ndarray:
        return _spline(months, 0.0, self.high)

    def log_odds(self, arm: float, months: np.ndarray, covariates: np.ndarray) -> np.ndarray:
        """Log odds of an event in each month for one covariate row."""
        S = self.basis(months)
        k = S.shape[1]
        fixed = np.concatenate([[1.0, arm], covariates])
        out = np.full(len(months), fixed @ self.beta[:len(fixed)]) + S @ self.beta[len(fixed):len(fixed) + k]
        return out + (arm * S @ self.beta[len(fixed) + k:] if self.interaction else 0.0)


def _walk(batch, beta: np.ndarray, p: int, S: np.ndarray, interaction: bool, squares: bool) -> np.ndarray:
    """Gradient, information (or the scores' squares) and deviance of a batch, month by month.

    A row's months share its covariates: its monthly residuals and curvatures are summed per row first, and meet the spline
    of the month in products of the covariate width, so no person-month row exists.
    """
    k = S.shape[1]
    width = p + k * (2 if interaction else 1)
    gradient, square, deviance = np.zeros(width), np.zeros((width, width)), 0.0
    X = np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, p)
    T, event, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("periods", "event", "w"))
    for at in range(0, len(X), ROWS_PER_WALK):
        rows = slice(at, at + ROWS_PER_WALK)
        order = np.argsort(-T[rows], kind="stable")  # rows still followed stand in front
        x, t, e, v = X[rows][order], T[rows][order], event[rows][order], w[rows][order]
        arm = x[:, 1]
        fixed = x @ beta[:p]
        pull, bend = np.zeros(len(x)), np.zeros(len(x))
        for month in range(int(t[0])):
            n = int(np.searchsorted(-t, -month, side="left"))  # rows with t > month
            line = S[month] @ beta[p:p + k]
            eta = fixed[:n] + line
            if interaction:
                eta = eta + arm[:n] * (S[month] @ beta[p + k:])
            eta = np.clip(eta, -500, 500)
            mu = 1 / (1 + np.exp(-eta))
            hit = (t[:n] == month + 1) * e[:n]
            r = v[:n] * (hit - mu)
            h = r * r if squares else v[:n] * mu * (1 - mu)
            deviance += 2 * float(np.sum(v[:n] * (np.logaddexp(0, eta) - hit * eta)))
            pull[:n] += r
            bend[:n] += h
            spline = S[month]
            sides = [(slice(p, p + k), None)] + ([(slice(p + k, width), arm[:n])] if interaction else [])
            for where, scale in sides:
                rs, hs = (r, h) if scale is None else (r * scale, h * scale)
                gradient[where] += rs.sum() * spline
                square[:p, where] += np.outer(x[:n].T @ hs, spline)
                for other, second in sides:
                    square[where, other] += (hs if second is None else hs * second).sum() * np.outer(spline, spline)
        gradient[:p] += x.T @ pull
        square[:p, :p] += (x * bend[:, None]).T @ x
    square[p:, :p] = square[:p, p:].T
    return np.concatenate([gradient, square.ravel(), [deviance]])


def fit_adjusted(df: DataFrame, treat: str, periods: str, event: str, weight: str | None, covariates: Design,
                 interaction: bool = True, max_iter: int = 50) -> AdjustedFit:
    """Weighted pooled logistic fit with covariates, by Newton steps whose sums are made without expanding rows.

    Each step is one pass over the person rows; a step that raises the deviance is halved.  ``robust`` is the HC0 sandwich
    over person-months.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = covariates.rows(df).where(F.col(periods) >= 1).select(
        F.array(F.lit(1.0), F.col(treat).cast("double"), *[c.cast("double") for c in covariates.columns]).alias("x"),
        F.col(periods).cast("int").alias("periods"), F.coalesce(F.col(event).cast("double"), F.lit(0.0)).alias("event"), w.alias("w"))
    rows = staged(rows)
    facts = rows.agg(F.max("periods").alias("last"), F.sum(F.col("w") * F.col("periods")).alias("months"), F.sum(F.col("w") * F.col("event")).alias("events")).first()
    if facts["last"] is None:
        raise ValueError("no row with a period of follow-up")
    high = float(facts["last"] - 1)
    S = _spline(np.arange(facts["last"], dtype=float), 0.0, high)
    p, k = 2 + len(covariates.columns), S.shape[1]
    width = p + k * (2 if interaction else 1)

    def sums(beta: np.ndarray, squares: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
        flat = summed(rows, width + width * width + 1, lambda b: _walk(b, beta, p, S, interaction, squares))
        return flat[:width], flat[width:-1].reshape(width, width), float(flat[-1])

    beta = np.zeros(width)
    share = min(max(facts["events"] / facts["months"], 1e-12), 1 - 1e-12)
    beta[0] = np.log(share / (1 - share))
    gradient, information, deviance = sums(beta)
    converged = False
    for _ in range(max_iter):
        step = np.linalg.pinv(information, hermitian=True) @ gradient
        scale = 1.0
        while True:
            trial = sums(beta + scale * step)
            if trial[2] <= deviance + 1e-9 * abs(deviance) or scale < 1e-4:
                break
            scale /= 2
        change, last = np.max(np.abs(scale * step) / (1 + np.abs(beta))), deviance
        beta, (gradient, information, deviance) = beta + scale * step, trial
        if change < 1e-9 or abs(last - deviance) < 1e-13 * (abs(deviance) + 1e-12):
            converged = True
            break
    if not converged:
        warnings.warn(f"outcome fit did not converge in {max_iter} steps (separated groups?)", stacklevel=2)
    inverse = np.linalg.pinv(information, hermitian=True)
    robust = inverse @ sums(beta, squares=True)[1] @ inverse
    names = ["intercept", "exp", *covariates.names, *[f"time~{i}" for i in range(k)], *([f"exp:time~{i}" for i in range(k)] if interaction else [])]
    return AdjustedFit(names, beta, inverse, robust, covariates, high, interaction, converged)


def pooled_hr_adjusted(df: DataFrame, treat: str, periods: str, event: str, weight: str | None, covariates: Design) -> DataFrame:
    """Log hazard ratios of the arm and of every covariate column, with robust errors, intervals and p-values."""
    from math import erfc, sqrt

    fit = fit_adjusted(df, treat, periods, event, weight, covariates, interaction=False)
    z, rows = 1.959963984540054, []
    for i in range(1, 2 + len(covariates.columns)):
        est, se = float(fit.beta[i]), float(np.sqrt(max(fit.robust[i, i], 0.0)))
        rows.append((fit.names[i], est, se, est - z * se, est + z * se, erfc(abs(est / se) / sqrt(2)) if se > 0 else None))
    return df.sparkSession.createDataFrame(rows, _HR_SCHEMA)


def risk_curves_adjusted(df: DataFrame, treat: str, periods: str, event: str, weight: str, covariates: Design,
                         profile: dict[str, object], horizon: int | None = None) -> DataFrame:
    """Risk curves of an outcome model that also carries covariates, at one covariate profile, with events so far.

    ``events_0``/``events_1`` count events up to a month, ``w_events_0``/``w_events_1`` their weights.
    """
    spark = df.sparkSession
    fit = fit_adjusted(df, treat, periods, event, weight, covariates)
    point = spark.range(1).select(*[F.lit(v).alias(c) for c, v in profile.items()])
    x = np.array(point.select(F.array(*[c.cast("double") for c in covariates.columns]).alias("x")).first()["x"], dtype=float) \
        if covariates.columns else np.zeros(0)
    months = np.arange(int(fit.high) + 1 if horizon is None else min(horizon, int(fit.high) + 1), dtype=float)
    cum = [1 - np.cumprod(1 - 1 / (1 + np.exp(-np.clip(fit.log_odds(arm, months, x), -500, 500)))) for arm in (0.0, 1.0)]
    rows = [(int(t), float(a), float(b), float(b - a), float(b / a) if a > 0 else None) for t, a, b in zip(months, *cum)]
    curves = spark.createDataFrame(rows, "time int, cuminc_0 double, cuminc_1 double, rd double, rr double")
    run = Window.partitionBy("exp").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    counts = month_table(outcome_cells(df, treat, periods, event, weight)).select(
        "exp", "time", F.sum("n_event").over(run).alias("n"), F.sum("w_event").over(run).alias("w"))
    side = lambda arm, c: F.max(F.when(F.col("exp") == arm, F.col(c)))
    events = counts.groupBy("time").agg(side(0, "n").cast("long").alias("events_0"), side(1, "n").cast("long").alias("events_1"),
                                        side(0, "w").alias("w_events_0"), side(1, "w").alias("w_events_1"))
    return curves.join(events, "time", "left").select("time", "events_0", "events_1", "w_events_0", "w_events_1", "cuminc_0", "cuminc_1", "rd", "rr")


# ---- unweighted survival ------------------------------------------------------

def kaplan_meier(df: DataFrame, treat: str, time: str, event: str) -> DataFrame:
    """Product-limit survival per (arm, time), from counts per (arm, time)."""
    counts = df.groupBy(treat, F.col(time).alias("time")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.coalesce(F.col(event).cast("long"), F.lit(0))).alias("n_event"))
    later = Window.partitionBy(treat).orderBy(F.col("time").desc()).rowsBetween(Window.unboundedPreceding, 0)
    run = Window.partitionBy(treat).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    risk = counts.withColumn("n_risk", F.sum("_n").over(later))
    return risk.withColumn("survival", running_product(F.try_divide("n_event", "n_risk"), run)).select(
        treat, "time", "n_risk", "n_event", "survival", (1 - F.col("survival")).alias("cuminc"))


def at_risk(df: DataFrame, treat: str, time: str, breaks: Sequence[int] = tuple(range(0, 43, 6))) -> DataFrame:
    """Number still followed at each break, per arm."""
    flags = [F.sum(F.when(F.col(time) >= b, 1).otherwise(0)).cast("long").alias(f"b{b}") for b in breaks]
    rows = F.array(*[F.struct(F.lit(b).alias("time"), F.col(f"b{b}").alias("n_risk")) for b in breaks])
    return (df.groupBy(treat).agg(*flags).select(treat, F.explode(rows).alias("_r"))
            .select(treat, "_r.time", "_r.n_risk"))


def curve_long(curves: DataFrame, arms: Sequence[str], percent: bool = True) -> DataFrame:
    """Plot data: one row per arm and time with the incidence and its limits."""
    from cohortweave.operators.reshape import stack_arms

    stacked = stack_arms(curves, ["time"], {
        i: {"cuminc": f"cuminc_{i}", "lcl": f"cuminc_{i}_lcl", "ucl": f"cuminc_{i}_ucl"} for i in (0, 1)})
    if percent:
        stacked = stacked.withColumns({c: F.col(c) * 100 for c in ("cuminc", "lcl", "ucl")})
    return stacked.withColumn("arm", F.when(F.col("exp") == 0, arms[0]).otherwise(arms[1])).distinct()
