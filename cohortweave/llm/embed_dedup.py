"""Embedding near-duplicates by collision-counting projections (operator 1).

Unit vectors are projected on many random lines.  On a line, two vectors at cosine ``c`` lie apart by a normal deviate of
spread r = sqrt(2 - 2c), so a query-centred window of known width catches them with a known chance.

* Tables: a table cuts ``cells`` lines into ranges of random offset and sorts the vectors of one cell along a further line.
  A query's window on that line gives the pairs to count.  The number of lines grows with log(n), so that a cell's windows
  stay small, and the number of tables follows from the recall asked for at the threshold (``plan``).
* Counting: on ``LINES`` other lines the windows that hold the pair are counted, first on a quarter of them.  Pairs below
  a count that a pair at the threshold reaches with chance ``COUNT_RECALL`` are dropped.
* The others are verified by cosine in double precision.  A pair belongs to the first table that meets it, so it is
  counted once, and tasks emit one row for each vector and cell (links, smallest partner), never the pairs.

Equal vectors are merged before and counted as links of each other.  Cells of more than ``BLOCK`` vectors are split in
block pairs, so no task holds an unbounded cell.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of other
lengths link with nothing of this length; an id that repeats is one vector, the smallest one; null ids are dropped;
an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cohortweave.llm.common import components, staged

LINES = 64
FIRST = 16
COUNT_RECALL = 0.999
BLOCK = 2048
CELL_WIDTH = 3.6  # in spreads r
WINDOW = 2.5
COUNT_WINDOW = 1.0


def _phi(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def _same_range(width: float) -> float:
    """Chance that two points fall into one range of ``width`` spreads with a random offset."""
    return 1 - 2 * _phi(-width) - 2 / (math.sqrt(2 * math.pi) * width) * (1 - math.exp(-width * width / 2))


def _least(n: int, p: float, recall: float) -> int:
    """The largest count that Binomial(n, p) reaches with chance ``recall``."""
    total = 0.0
    for k in range(n, -1, -1):
        total += math.comb(n, k) * p ** k * (1 - p) ** (n - k)
        if total >= recall:
            return k
    return 0


@dataclass(frozen=True)
class Plan:
    spread: float
    cells: int
    tables: int
    least_first: int
    least: int
    cosine: float


def plan(n: int, cosine: float, recall: float = 0.995) -> Plan:
    r = math.sqrt(2 - 2 * cosine)
    near, far = _same_range(CELL_WIDTH), _same_range(CELL_WIDTH * r / math.sqrt(2))
    cells = max(1, math.ceil(math.log(max(n, 2) / 50) / -math.log(far)))
    meet = near ** cells * (1 - 2 * _phi(-WINDOW))
    p = 1 - 2 * _phi(-COUNT_WINDOW)
    return Plan(r, cells, math.ceil(math.log(1 - recall) / math.log(1 - meet)), _least(FIRST, p, COUNT_RECALL), _least(LINES, p, COUNT_RECALL), cosine)


def _lines(dim: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, n)).astype(np.float32)


def _placed(x: np.ndarray, p: Plan) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, tables): cell keys and places on the sorted line.

    Vectors and lines are rounded to whole numbers whose products add up exactly in double precision, so a vector's
    places are the same in every task and batch.
    """
    dim, x = x.shape[1], np.rint(x * 2 ** 20)
    rng = np.random.default_rng([3, dim])
    width = p.spread * CELL_WIDTH
    keys, at = np.empty((len(x), p.tables), dtype=np.int64), np.empty((len(x), p.tables), dtype=np.float32)
    for t in range(p.tables):
        lines = np.rint(_lines(dim, p.cells + 1, 1000 + t).astype(np.float64) * 2 ** 12)
        h = x @ lines / 2.0 ** 32
        cell = np.floor((h[:, :-1] + rng.random(p.cells) * width) / width).astype(np.int64)
        key = np.full(len(x), np.random.default_rng([5, dim, t]).integers(1 << 62), dtype=np.uint64)
        for c in cell.T:
            key = (key ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        keys[:, t], at[:, t] = key.view(np.int64), h[:, -1]
    return keys, at


def _vectors(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), dtype=np.float64).reshape(len(raw), -1)


def normalised(vectors: DataFrame, id_: str, column: str) -> DataFrame:
    """(id, n, unit): equal vectors merged; their smallest id, how many there are, the unit vector as bytes."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for v in x["v"]:
                v = np.asarray(v, dtype=np.float64)
                v = v / np.abs(v).max()
                out.append((v / np.linalg.norm(v)).tobytes())
            yield pd.DataFrame({"id": x["id"], "n": x["n"], "unit": out})

    merged = usable(vectors, id_, column).groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    return merged.mapInPandas(run, "id long, n long, unit binary")


def one_per_id(vectors: DataFrame, id_: str, column: str) -> DataFrame:
    """(id, v): one vector for each id, components as double."""
    return (vectors.where(F.col(id_).isNotNull()).select(F.col(id_).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"))
            .groupBy("id").agg(F.min("v").alias("v")))


def usable(vectors: DataFrame, id_: str, column: str) -> DataFrame:
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return one_per_id(vectors, id_, column).where(F.col("v").isNotNull() & ~bad & F.exists("v", lambda c: c != 0))


def _roots(a: np.ndarray, b: np.ndarray) -> dict[int, int]:
    """Smallest id reachable over the given links."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(up)}


def _links(ids: np.ndarray, group: np.ndarray, at: np.ndarray, table: np.ndarray, half: np.ndarray, x: np.ndarray, p: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs (row numbers) among rows sorted by (group, at); half: 0/1 for a block pair's sides, -1 for whole cells."""
    count_h = x.astype(np.float32) @ _lines(x.shape[1], LINES, 7)
    window, count_window = np.float32(WINDOW * p.spread), np.float32(COUNT_WINDOW * p.spread)
    left, k, found = np.arange(len(ids)), 1, []
    while True:
        left = left[left + k < len(ids)]
        right = left + k
        near = (group[left] == group[right]) & (at[right] - at[left] <= window)
        left = left[near]
        if not len(left):
            break
        right = left + k
        a, b = left[(half[left] < 0) | (half[left] != half[right])], None
        for s in range(0, len(a), 1 << 15):
            i = a[s:s + (1 << 15)]
            hits = (np.abs(count_h[i, :FIRST] - count_h[i + k, :FIRST]) <= count_window).sum(axis=1)
            i, hits = i[hits >= p.least_first], hits[hits >= p.least_first]
            hits = hits + (np.abs(count_h[i, FIRST:] - count_h[i + k, FIRST:]) <= count_window).sum(axis=1)
            i = i[hits >= p.least]
            i = i[np.einsum("ij,ij->i", x[i], x[i + k]) >= p.cosine]
            if len(i):
                found.append((i, i + k))
        k += 1
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = (np.concatenate(part) for part in zip(*found, strict=True))
    # The first table that meets a pair owns it.
    rows, place = np.unique(np.concatenate([i, j]), return_inverse=True)
    keys, places = _placed(x[rows], p)
    u, v = place[: len(i)], place[len(i):]
    own = np.ones(len(i), dtype=bool)
    for t in range(p.tables - 1):
        own &= ~((table[i] > t) & (keys[u, t] == keys[v, t]) & (np.abs(places[u, t] - places[v, t]) <= window))
    return i[own], j[own]


def near_duplicates(vectors: DataFrame, *, id_: str = "vec_id", column: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """id, n_links, component_id, kept for every id."""
    base = staged(normalised(vectors, id_, column))
    p = plan(base.count(), cosine)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, x in batch.groupby(batch["unit"].map(len)):
                for s in range(0, len(x), 1024):
                    part = x.iloc[s:s + 1024]
                    keys, at = _placed(_vectors(part["unit"].tolist()), p)
                    yield pd.DataFrame({"key": keys.ravel(), "at": at.ravel(), "t": np.tile(np.arange(p.tables), len(part)),
                                        "id": np.repeat(part["id"].to_numpy(), p.tables)})

    cells = staged(base.select("id", "unit").mapInPandas(place, "key long, at float, t int, id long"))
    sizes = cells.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    rows = cells.join(sizes, "key").withColumn("nb", blocks).withColumn("own", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    half = F.when(F.col("i") == F.col("j"), F.lit(-1)).when(F.col("own") == F.col("i"), F.lit(0)).otherwise(F.lit(1))
    rows = rows.select("key", "i", "j", half.alias("half"), "at", "t", "id").join(base, "id")

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None

        def solve(x: pd.DataFrame) -> pd.DataFrame:
            out = []
            for _, y in x.groupby(x["unit"].map(len)):
                group = np.cumsum(np.append(0, (y[["key", "i", "j"]].to_numpy()[1:] != y[["key", "i", "j"]].to_numpy()[:-1]).any(axis=1)))
                ids, n = y["id"].to_numpy(), y["n"].to_numpy()
                a, b = _links(ids, group, y["at"].to_numpy(), y["t"].to_numpy(), y["half"].to_numpy(), _vectors(y["unit"].tolist()), p)
                if len(a):
                    roots = _roots(ids[a], ids[b])
                    count = pd.Series(np.concatenate([n[b], n[a]])).groupby(np.concatenate([ids[a], ids[b]])).sum()
                    out.append(pd.DataFrame({"id": count.index.to_numpy(), "links": count.to_numpy(), "root": [roots[k] for k in count.index.tolist()]}))
            return pd.concat(out) if out else pd.DataFrame({"id": [], "links": [], "root": []}, dtype="int64")

        for x in batches:  # rows arrive by cell; the last cell of a batch may go on
            held = x if held is None else pd.concat([held, x], ignore_index=True)
            last = held.iloc[-1] if len(held) else None
            if last is not None:
                goes_on = ((held["key"] == last["key"]) & (held["i"] == last["i"]) & (held["j"] == last["j"])).to_numpy()
                yield solve(held[~goes_on])
                held = held[goes_on]
        if held is not None and len(held):
            yield solve(held)

    found = staged(rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "at", "id")
                   .mapInPandas(link, "id long, links long, root long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))).select(F.col("id").alias("gid"), F.col("root").alias("groot"))
    per_vector = (base.select("id", "n").join(links, "id", "left").join(groups, F.col("id") == F.col("gid"), "left")
                  .select(F.col("id").alias("rep"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("groot", "id").alias("component_id")))
    members = usable(vectors, id_, column)
    reps = members.groupBy("v").agg(F.min("id").alias("rep"))
    named = members.join(reps, "v").select("id", "rep").join(per_vector, "rep")
    every = vectors.where(F.col(id_).isNotNull()).select(F.col(id_).cast("long").alias("id")).distinct()
    out = every.join(named, "id", "left")
    root = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), (F.col("id") == root).alias("kept"))
