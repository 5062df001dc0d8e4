"""Bootstrap of the whole weighting-and-outcome chain without copying rows.

A resample is a count per (replicate, row).  All replicates share every pass over
the data: a pass multiplies a batch of rows by the counts of all replicates and
emits sums only.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence
from math import ceil, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from cohortweave.operators.summaries import percentile_interval
from cohortweave.session import staged
from cohortweave.stats.features import Design
from cohortweave.stats.outcome import outcome_cells, risk_curves
from cohortweave.stats.weights import fit_logistic, iptw, score

ROWS_PER_STEP = 2048
# Rows of a bucket of exact resampling.
ROWS_PER_BUCKET = 20_000
LIMITS = ("cuminc_0", "cuminc_1", "rd", "rr")
# Cumulative probabilities of a Poisson(1) count 0, 1, 2, ...
POISSON_CDF = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1, 16)])))


def scramble(z: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64), element-wise."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def poisson_counts(row_hash: np.ndarray, seed: int, n: int) -> np.ndarray:
    """Counts (rows x replicates) that depend on (seed, replicate, row) alone."""
    with np.errstate(over="ignore"):
        key = scramble((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1_000_003))
                        * np.uint64(0x9E3779B97F4A7C15))
        z = scramble(row_hash.astype(np.int64).view(np.uint64)[:, None] ^ key[None, :])
    u = (z >> np.uint64(11)).astype(float) * 2.0 ** -53
    return np.searchsorted(POISSON_CDF, u.ravel(), side="right").reshape(u.shape).astype(float)


def poisson_count(key: Column, seed: int, replicate: int) -> Column:
    """The same kind of count as a column expression, for one replicate."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.lit(replicate), key), F.lit(1 << 53)) / float(1 << 53)
    expr = F.lit(len(POISSON_CDF))
    for k in reversed(range(len(POISSON_CDF))):
        expr = F.when(u < float(POISSON_CDF[k]), k).otherwise(expr)
    return expr


def resample_counts(df: DataFrame, row_key: str, n: int, seed: int, packed: bool = False) -> DataFrame:
    """Exact n-of-n resampling: add ``draws``, the (replicate, count) pairs of each row.

    Every replicate draws as many rows as there are.  The draws are split over hash buckets of ``ROWS_PER_BUCKET`` rows on average by one
    multinomial draw per replicate on the driver (bucket sizes only), and over the rows of a bucket in its own task, both from
    seeds, so a lost task draws the same again.  ``row_key`` is unique.

    ``packed``: ``draws`` holds the counts of replicates 0..n-1 as bytes instead (one byte each, eight where a bucket has a count
    over 255), which ``unpack_counts`` reads.
    """
    size = df.count()
    buckets = max(1, -(-size // ROWS_PER_BUCKET))
    bucket = F.pmod(F.xxhash64(F.lit("bucket"), F.col(row_key)), F.lit(buckets)).cast("int")
    keys = df.select(row_key, bucket.alias("_bucket"))
    sizes = np.zeros(buckets)
    for r in keys.groupBy("_bucket").count().collect():
        sizes[r["_bucket"]] = r["count"]
    totals = np.random.default_rng([seed, 0]).multinomial(size, sizes / max(size, 1), size=n).T if size else np.zeros((buckets, n), int)
    shares = df.sparkSession.createDataFrame([(b, [int(v) for v in totals[b]]) for b in range(buckets)], "_bucket int, _totals array<long>")

    def draw(rows: pa.Table, share: pa.Table) -> pa.Table:
        m = rows.num_rows
        rows = rows.take(pa.array(rows.to_pandas().sort_values(row_key).index.to_numpy()))
        counts = np.zeros((n, m), dtype=np.uint32)
        if m:
            rng, even = np.random.default_rng([seed, 1, rows.column("_bucket")[0].as_py()]), np.full(m, 1 / m)
            for k, t in enumerate(share.column("_totals")[0].as_py()):
                counts[k] = rng.multinomial(t, even)
        counts = counts.T
        if packed:
            held = counts.astype("<u1" if counts.max(initial=0) < 256 else "<u8")
            draws = pa.array([row.tobytes() for row in held], pa.binary())
        else:
            row, replicate = np.nonzero(counts)
            pairs = pa.StructArray.from_arrays([pa.array(replicate, pa.int32()), pa.array(counts[row, replicate], pa.int32())], ["replicate", "count"])
            draws = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(m + 1)), pa.int32()), pairs)
        return pa.table({row_key: rows.column(row_key), "draws": draws})

    kind = keys.schema[row_key].dataType.simpleString()
    drawn = keys.groupBy("_bucket").cogroup(shares.groupBy("_bucket")).applyInArrow(
        draw, f"`{row_key}` {kind}, draws {'binary' if packed else 'array<struct<replicate:int,count:int>>'}")
    return df.join(drawn, row_key, "left")


def unpack_counts(draws: pa.Array, n: int) -> np.ndarray:
    """Counts (rows x replicates) of packed draws; a row without draws has none."""
    out = np.zeros((len(draws), n))
    for i, row in enumerate(draws.to_pylist()):
        if row:
            out[i] = np.frombuffer(row, f"<u{len(row) // n}")
    return out


def _batches(batches: Iterator[pa.RecordBatch], p: int, seed: int, n: int):
    """Blocks of (X, treated, periods, event, counts)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        X = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
        treat, T, event, h = (batch.column(c).to_numpy(zero_copy_only=False)
                              for c in ("treat", "periods", "event", "h"))
        draws = batch.column("draws") if "draws" in batch.schema.names else None
        for i in range(0, len(X), ROWS_PER_STEP):
            rows = slice(i, i + ROWS_PER_STEP)
            if draws is None:
                counts = poisson_counts(h[rows], seed, n)
            else:
                counts = unpack_counts(draws.slice(i, len(X[rows])), n)
            yield X[rows], treat[rows], T[rows], event[rows], counts


_SUMS = "gram array<double>, grad array<double>, deviance double, size double, treated double"
_GRAM = f"part int, replicate int, {_SUMS}"


def _gram_pass(data: DataFrame, betas: np.ndarray, seed: int, groups: int) -> DataFrame:
    """Per partition and replicate: information matrix (upper triangle), gradient, deviance, counts.

    ``part`` deals the partitions into ``groups`` for the first level of sums.
    """
    n, p = betas.shape
    upper = np.triu_indices(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, grad = np.zeros((n, len(upper[0]))), np.zeros((n, p))
        deviance, size, treated, seen = np.zeros(n), np.zeros(n), np.zeros(n), False
        for X, treat, _, _, counts in _batches(batches, p, seed, n):
            seen = True
            eta = np.clip(X @ betas.T, -500, 500)
            mu = 1 / (1 + np.exp(-eta))
            gram += (counts * mu * (1 - mu)).T @ (X[:, upper[0]] * X[:, upper[1]])
            grad += (counts * (treat[:, None] - mu)).T @ X
            deviance += 2 * (counts * (np.logaddexp(0, eta) - treat[:, None] * eta)).sum(axis=0)
            size += counts.sum(axis=0)
            treated += counts.T @ treat
        if seen:
            part = TaskContext.get().partitionId() % groups
            yield pa.RecordBatch.from_pydict({
                "part": pa.array(np.full(n, part), pa.int32()), "replicate": pa.array(np.arange(n), pa.int32()),
                "gram": pa.array(list(gram)), "grad": pa.array(list(grad)), "deviance": pa.array(deviance),
                "size": pa.array(size), "treated": pa.array(treated)})

    return data.mapInArrow(run, _GRAM)


def _sum_parts(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sum of some partition results of one replicate."""
    return pd.DataFrame({
        "replicate": [pdf["replicate"].iloc[0]], "gram": [np.sum(np.stack(pdf["gram"]), axis=0)],
        "grad": [np.sum(np.stack(pdf["grad"]), axis=0)], "deviance": [pdf["deviance"].sum()],
        "size": [pdf["size"].sum()], "treated": [pdf["treated"].sum()]})


def fit_replicates(data: DataFrame, start: np.ndarray, n: int, seed: int, max_iter: int = 25,
                   tol: float = 1e-6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic coefficients of all replicates (n x p), their treated shares, and which fits converged.

    Newton steps from the full-data fit, halved where the deviance rises.  One pass over the data per
    step; partition results are added up on two levels, and only n x p numbers per step reach the driver.
    """
    p = len(start)
    upper = np.triu_indices(p)
    # Both levels add up about as many results as the square root of the number of partitions.
    groups = max(1, ceil(sqrt(data.rdd.getNumPartitions())))

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        s = _sum_parts(pdf)
        H = np.zeros((p, p))
        H[upper] = s["gram"].iloc[0]
        H = H + np.triu(H, 1).T
        move = np.linalg.pinv(H, hermitian=True) @ s["grad"].iloc[0]
        return pd.DataFrame({"replicate": s["replicate"], "move": [move], "deviance": s["deviance"], "size": s["size"],
                             "treated": s["treated"]})

    betas = np.tile(start, (n, 1))
    held, least = betas.copy(), np.full(n, np.inf)
    share, converged = np.zeros(n), np.zeros(n, dtype=bool)
    for _ in range(max_iter):
        rows = (_gram_pass(data, betas, seed, groups).groupBy("replicate", "part")
                .applyInPandas(_sum_parts, f"replicate int, {_SUMS}").groupBy("replicate")
                .applyInPandas(step, "replicate int, move array<double>, deviance double, size double, treated double").collect())
        moves = np.zeros_like(betas)
        for r in rows:
            k = r["replicate"]
            share[k] = r["treated"] / r["size"] if r["size"] else np.nan
            if r["deviance"] > least[k] + 1e-9 * (1 + abs(least[k])):
                moves[k] = (held[k] - betas[k]) / 2
                converged[k] = False
            else:
                held[k], least[k], moves[k] = betas[k], r["deviance"], r["move"]
                converged[k] = np.max(np.abs(r["move"]) / (1 + np.abs(betas[k] + r["move"]))) < tol
        betas = betas + moves
        if converged.all():
            break
    return betas, share, converged


def cell_sums(sums: dict[tuple[int, int, int], np.ndarray], treat: np.ndarray, periods: np.ndarray, event: np.ndarray,
              counts: np.ndarray, w: np.ndarray) -> None:
    """Add a block's (n, w, w2) per (arm, periods, event) and replicate; ``counts`` and ``w`` are rows x replicates."""
    key = np.stack([treat.astype(int), periods.astype(int), event.astype(int)], axis=1)
    cells, where = np.unique(key, axis=0, return_inverse=True)
    order = np.argsort(where.ravel(), kind="stable")
    cut = np.searchsorted(where.ravel()[order], np.arange(len(cells)))
    stacked = [np.add.reduceat(v[order], cut, axis=0) for v in (counts, counts * w, counts * w * w)]
    for i, cell in enumerate(map(tuple, cells)):
        add = np.stack([s[i] for s in stacked])
        sums[cell] = sums[cell] + add if cell in sums else add


def cell_rows(sums: dict[tuple[int, int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The cells of each replicate that has rows in them."""
    for (arm, periods, event), v in sums.items():
        keep = np.flatnonzero(v[0])
        yield pa.RecordBatch.from_pydict({
            "replicate": pa.array(keep, pa.int32()), "exp": pa.array(np.full(len(keep), arm), pa.int32()),
            "periods": pa.array(np.full(len(keep), periods), pa.int32()),
            "event": pa.array(np.full(len(keep), event), pa.int32()),
            "n": pa.array(v[0][keep]), "w": pa.array(v[1][keep]), "w2": pa.array(v[2][keep])})


def replicate_cells(data: DataFrame, betas: np.ndarray, share: np.ndarray, seed: int) -> DataFrame:
    """Outcome cells (n, w, w2) per replicate with its own stabilised weights."""
    n, p = betas.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int, int], np.ndarray] = {}
        for X, treat, T, event, counts in _batches(batches, p, seed, n):
            pd_ = 1 / (1 + np.exp(-np.clip(X @ betas.T, -500, 500)))
            on = treat[:, None] == 1
            w = np.where(on, share / pd_, (1 - share) / (1 - pd_))
            cell_sums(sums, treat, T, event, counts, w)
        yield from cell_rows(sums)

    parts = data.mapInArrow(run, "replicate int, exp int, periods int, event int, n double, w double, w2 double")
    return parts.groupBy("replicate", "exp", "periods", "event").agg(
        F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum("w2").alias("w2"))


def bootstrap_replicates(df: DataFrame, treat: str, periods: str, event: str, design: Design, row_key: str, n: int,
                         seed: int, scheme: str = "poisson", horizon: int | None = None) -> DataFrame:
    """Risk curve of every replicate: (replicate, time, ..., converged), score model refitted per replicate."""
    cols = [F.xxhash64(row_key).alias("h"), F.col(treat).cast("double").alias("treat"),
            F.col(periods).cast("int").alias("periods"),
            F.coalesce(F.col(event).cast("int"), F.lit(0)).alias("event"), design.array(intercept=True).alias("x")]
    rows = design.rows(df).where(F.col(periods) >= 1)
    if scheme == "multinomial":
        rows = resample_counts(rows, row_key, n, seed, packed=True)
        cols.append(F.col("draws"))
    data = rows.select(*cols).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = fit_logistic(df.where(F.col(periods) >= 1), treat, design)
        start = np.concatenate([[model.intercept], model.coefficients.toArray()])
        betas, share, converged = fit_replicates(data, start, n, seed)
        # Written before the cache goes: a few hundred rows per replicate.
        cells = staged(replicate_cells(data, betas, share, seed))
    finally:
        data.unpersist()
    if not converged.all():
        warnings.warn(f"{int((~converged).sum())} of {n} score fits did not converge", stacklevel=2)
    curves = risk_curves(cells, by="replicate", horizon=horizon)
    return curves.withColumn("converged", ~F.col("replicate").isin([int(k) for k in np.flatnonzero(~converged)]))


def with_limits(point: DataFrame, replicates: DataFrame) -> DataFrame:
    """Point estimate joined with percentile limits per time.

    Replicates whose score fit did not converge (column ``converged``) are left out of the limits; ``n_replicates`` says how
    many each limit rests on.
    """
    used = replicates.where("converged") if "converged" in replicates.columns else replicates
    limits = percentile_interval(used, ["time"], LIMITS)
    return point.join(limits.join(used.groupBy("time").agg(F.count(F.lit(1)).alias("n_replicates")), "time"), "time", "left")


def bootstrap_curves(df: DataFrame, treat: str, periods: str, event: str, design: Design, row_key: str,
                     n: int = 500, seed: int = 7, scheme: str = "poisson", horizon: int | None = None) -> DataFrame:
    """Weighted risk curves with percentile limits; logistic scores refitted in every replicate.

    ``scheme``: ``poisson`` draws independent counts (the default at scale),
    ``multinomial`` draws exactly as many rows as the data has.
    """
    model = fit_logistic(df, treat, design)
    weighted = iptw(score(df, model, design, "pd"), treat)
    point = risk_curves(outcome_cells(weighted, treat, periods, event, "iptw"), horizon=horizon)
    return with_limits(point, bootstrap_replicates(df, treat, periods, event, design, row_key, n, seed, scheme, horizon))


def bootstrap_curves_gbt(df: DataFrame, treat: str, periods: str, event: str, design: Design, row_key: str,
                         params: dict, n: int = 2, seed: int = 7, horizon: int | None = None) -> DataFrame:
    """The same with boosted scores, fitted on each resample and scored on its rows.

    The point estimate and all replicates are lanes of one boosted fit, so the number of passes and the plan do not grow with ``n``.
    """
    from cohortweave.stats import boosted as B

    lanes = [B.Lane.of(params), *[B.Lane.of(params, replicate=b) for b in range(n)]]
    extra = {"periods": F.col(periods), "event": F.coalesce(F.col(event).cast("int"), F.lit(0))}
    rows = B.matrix(df.where(F.col(periods) >= 1), treat, design, row_key, len(lanes), replicates=n, seed=seed, extra=extra)
    cells = staged(B.boosted_cells(B.boost(rows, lanes, int(params["trees"]))))
    point = risk_curves(cells.where("replicate = 0").drop("replicate"), horizon=horizon)
    return with_limits(point, risk_curves(cells.where("replicate > 0"), by="replicate", horizon=horizon))


__all__: Sequence[str] = ("bootstrap_curves", "bootstrap_curves_gbt", "bootstrap_replicates", "fit_replicates",
                          "cell_rows", "cell_sums", "poisson_count", "poisson_counts", "scramble", "replicate_cells", "resample_counts", "unpack_counts", "with_limits")
