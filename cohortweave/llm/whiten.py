"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

With ``x = floor(64 * c) + 1000000`` and the centred rows ``X``, each step makes ``X v_j - beta u_{j-1}`` and ``X' u_j - alpha v_j`` by one
distributed pass each, both fully reorthogonalised (classical Gram-Schmidt, twice).  A left vector is as long as the table, so it is never
written: ``u_j = X w_j`` for a short ``w_j``, and each pass makes its rows of the left vectors anew and sums their products.  The right
vectors, the ``w_j`` and the bidiagonal matrix are as wide as the embeddings and live on the driver.  The SVD of the bidiagonal matrix gives
the components and the deviations; all ``dim`` steps are taken unless ``steps`` says fewer, so equal and clustered eigenvalues are found too
(a vanishing step starts again from a fresh direction).

On Spark: rows are packed once into blocks of ``BLOCK`` rows, written to the shared folder; a pass reads the blocks and sends one array
of sums per partition, added up by position in a distributed aggregate.  Nothing that grows with the rows reaches the driver or a task.
Sums of x are exact integers; a row is centred as ``(n x - S) / n`` from exact integers.

Odd cases: rows whose vector is null, empty or holds a null or non-finite entry (or one too large for ``64 c`` to be a long) take no part.
Vectors of another length are a table of their own: each length has its own n, components and error.  A repeated row counts each time.
Components beyond the rank of the rows (constant or repeated dimensions, a single row) have explained 0 and whitened 0 and do not enter
identity_error.  A deviation too large for a long is null.  An empty table gives no rows.  Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cohortweave.llm.common import staged

BLOCK = 2048
COMPONENTS = 32
#: Share of the largest singular value below which a step has found nothing new, and a component counts as absent.
NOTHING = 1e-10

_BLOCKS = "rows int, ids array<long>, x binary"
_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def packed(vectors: DataFrame) -> DataFrame:
    """(size, rows, ids, x): the usable vectors as integers, in blocks of one vector length; written once."""
    c = "cast(embedding AS array<double>)"
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.expr(c).alias("c")).where(
        "size(c) > 0 AND forall(c, e -> e IS NOT NULL AND NOT isnan(e) AND abs(e) < 1e16)")
    whole = usable.select("vec_id", F.size("c").alias("size"), F.expr("transform(c, e -> cast(floor(64 * e) AS long) + 1000000L)").alias("x"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, part in batch.groupby("size"):
                for at in range(0, len(part), BLOCK):
                    rows = part.iloc[at:at + BLOCK]
                    ids = [None if pd.isna(v) else int(v) for v in rows["vec_id"]]
                    yield pd.DataFrame({"size": [size], "rows": [len(rows)], "ids": [ids], "x": [np.stack(rows["x"].to_numpy()).astype("<i8").tobytes()]})

    return staged(whole.mapInPandas(pack, f"size int, {_BLOCKS}"))


def _matrix(data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, dtype="<i8").reshape(rows, -1)


def _summed(blocks: DataFrame, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``of(integer rows)`` over all blocks: one array per partition, added up by position."""
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            for rows, data in zip(batch["rows"], batch["x"]):
                part = of(_matrix(data, rows))
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"part": [total]})

    sums = blocks.select("rows", "x").mapInPandas(partial, "part array<double>")
    by_place = sums.select(F.posexplode("part").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(len(by_place))
    out[by_place["i"]] = by_place["v"]
    return out


def _exact_sums(blocks: DataFrame, dim: int) -> list[int]:
    """Sums by dimension as whole numbers: halves of 32 bits are summed apart, as decimals."""
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low, high = [0] * dim, [0] * dim
        for batch in batches:
            for rows, data in zip(batch["rows"], batch["x"]):
                x = _matrix(data, rows)
                low = [a + int(b) for a, b in zip(low, (x & 0xFFFFFFFF).sum(axis=0))]
                high = [a + int(b) for a, b in zip(high, (x >> 32).sum(axis=0))]
        yield pd.DataFrame({"i": range(dim), "s": [str(a + (b << 32)) for a, b in zip(low, high)]})

    sums = blocks.select("rows", "x").mapInPandas(partial, "i int, s string")
    return [int(r["s"]) for r in sums.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()]


class Centre:
    """Centres integer rows from exact sums."""

    def __init__(self, n: int, sums: list[int]):
        # S = n * base + rest: x - base is a small whole number, so n * (x - base) - rest is exact.
        self.n, self.base = n, np.array([s // n for s in sums], dtype=np.int64)
        self.rest = np.array([s % n for s in sums], dtype=np.int64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base).astype(np.float64) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)**2 for each row, exact."""
        away = x - self.base
        bound = float(self.n) * (np.abs(away).max(axis=1).astype(np.float64) + 1)
        easy = bound * bound * x.shape[1] < 2.0 ** 62
        exact = np.zeros(len(x), dtype=object)
        exact[easy] = ((self.n * away[easy] - self.rest) ** 2).sum(axis=1).tolist()
        for i in np.flatnonzero(~easy):
            exact[i] = sum((self.n * int(a) - int(r)) ** 2 for a, r in zip(away[i], self.rest))
        return [int(v) if v < 1 << 63 else None for v in exact]


def _against(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for b in basis:
            v = v - b * (b @ v)
    return v


def bidiagonalise(blocks: DataFrame, centre: Centre, dim: int, steps: int | None = None, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(right vectors in columns, upper bidiagonal matrix B) with X V = U B."""
    rng = np.random.default_rng(seed)
    steps = min(steps or dim, dim)
    right: list[np.ndarray] = []
    lefts = np.empty((dim, 0))  # column j: w_j with u_j = X w_j
    images = np.empty((dim, 0))  # column j: X' u_j
    alphas, betas, scale = [], [], 0.0

    def fresh() -> np.ndarray:
        v = _against(rng.standard_normal(dim), right)
        return v / np.linalg.norm(v)

    v, beta = fresh(), 0.0
    while True:
        right.append(v)
        w = v - beta * lefts[:, -1] if lefts.shape[1] else v

        # X v - beta u: its products with all left vectors so far, and its length.
        def forward(x, w=w, lefts=lefts):
            rows = centre(x)
            p = rows @ w
            return np.append((rows @ lefts).T @ p, p @ p)
        got = _summed(blocks, forward)
        w = w - lefts @ got[:-1]

        # X' u, with the second round of products with the left vectors.
        def backward(x, w=w, lefts=lefts):
            rows = centre(x)
            u = rows @ w
            return np.concatenate([rows.T @ u, (rows @ lefts).T @ u, [u @ u]])
        again = _summed(blocks, backward)
        image, products, square = again[:dim], again[dim:-1], again[-1]
        w, image = w - lefts @ products, image - images @ products
        alpha = float(np.sqrt(max(square - products @ products, 0.0)))
        scale = max(scale, alpha, beta)
        alpha = alpha if alpha > NOTHING * scale else 0.0
        alphas.append(alpha)
        lefts = np.column_stack([lefts, w / alpha if alpha else np.zeros(dim)])
        images = np.column_stack([images, image / alpha if alpha else np.zeros(dim)])
        if len(right) == steps:
            break
        r = _against(images[:, -1] - alpha * v, right)
        beta = float(np.linalg.norm(r))
        beta = beta if beta > NOTHING * scale else 0.0
        v = r / beta if beta else fresh()
        betas.append(beta)
    return np.column_stack(right), np.diag(alphas) + np.diag(betas, 1)


def components(blocks: DataFrame, dim: int, steps: int | None = None, keep: int = COMPONENTS) -> tuple[Centre, np.ndarray, np.ndarray, float]:
    """(centre, unit components in columns, eigenvalues, trace of the covariance) of blocks of one vector length."""
    n = blocks.agg(F.sum("rows")).first()[0]
    centre = Centre(n, _exact_sums(blocks, dim))
    right, bidiagonal = bidiagonalise(blocks, centre, dim, steps)
    _, singular, q = np.linalg.svd(bidiagonal)
    trace = float(_summed(blocks, lambda x: (centre(x) ** 2).sum(axis=0)).sum() / n)
    return centre, (right @ q.T)[:, :keep], singular[:keep] ** 2 / n, trace


def whitened(vectors: DataFrame, keep: int = COMPONENTS, steps: int | None = None) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per usable vector and component."""
    spark = vectors.sparkSession
    table = packed(vectors)
    out = spark.createDataFrame([], _OUT)
    for size in sorted(r["size"] for r in table.select("size").distinct().collect()):
        blocks = table.where(F.col("size") == size)
        centre, axes, values, trace = components(blocks, size, steps, keep)
        there = values > (NOTHING * NOTHING) * max(values[0], 0.0)
        scaled = np.where(there, axes / np.sqrt(np.where(there, values, 1.0)), 0.0)
        k, n = len(values), centre.n
        mean = _summed(blocks, lambda x, c=centre, s=scaled: (c(x) @ s).sum(axis=0)) / n

        def spread(x, c=centre, s=scaled, m=mean):
            y = c(x) @ s - m
            return (y.T @ y).ravel()
        error = float(np.abs(_summed(blocks, spread).reshape(k, k) / n - np.diag(there.astype(float))).max())
        explained = np.where(there, values / trace if trace else 0.0, 0.0)

        def scored(batches, c=centre, s=scaled, share=explained, error=error, k=k):
            for batch in batches:
                for rows, ids, data in zip(batch["rows"], batch["ids"], batch["x"]):
                    x = _matrix(data, rows)
                    yield pd.DataFrame({
                        "vec_id": pd.Series(ids, dtype="Int64").repeat(k).to_numpy(), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), rows),
                        "n": c.n, "deviation": pd.Series(c.deviations(x), dtype="Int64").repeat(k).to_numpy(), "whitened": (c(x) @ s).ravel(),
                        "explained": np.tile(share, rows), "identity_error": error})

        out = out.unionByName(blocks.select("rows", "ids", "x").mapInPandas(scored, _OUT))
    return out
