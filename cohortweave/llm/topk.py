"""Exact top-k search over a bit-sliced index (operator 5).

Components are integers.  The index stores, for each block of rows and each dimension, bit slices: bitmaps of the bits of
(component - least component of the block).  A query's score is the sum of q times the component over its dimensions.  q is a
sum and difference of powers of two: the dimensions' slices are added at these places, flipped where a power is taken off, so that
only sums of non-negative numbers remain and one constant for each query and block makes up the difference.  Carry-save adders of
bitmap arithmetic add up until one number, in slices, is left for each row.

The best rows are then selected from the most significant slice downward: rows above for certain, and rows that may tie.
Rows that tie at the boundary are resolved exactly, to the smallest ids.  A task keeps each query's best rows over its
blocks, and the ranked rows of all tasks meet in one window for each query.

Queries are a stated set.  The index is sliced and dealt once, the queries are; a task reads one part of either (``BLOCKS`` blocks,
one by one, and the queries of one set), so that its memory does not grow with the table and no block is written again for the
queries it meets.

Edge cases: vectors that are null, empty or hold null or non-finite components take no part; an id that repeats is one vector,
the smallest one; null ids are dropped; vectors of other lengths than a query's are no candidates of it; components beyond
2**40 / 64 in size score by exact integers and are cut to the long range; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortweave.llm.common import staged
from cohortweave.llm.embed_dedup import one_per_id

ROWS = 32768  # bitmaps of 512 words: long enough that an operation outweighs its call
QUERIES = 256
#: Components of a block and of a query set, blocks that a task reads.
CELLS, QUERY_CELLS, BLOCKS = 1 << 22, 1 << 18, 64
SAFE = 1 << 20


def integers(vectors: DataFrame, id_: str, column: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * component) as whole doubles, of usable vectors only."""
    whole = F.transform("v", lambda c: F.expr("0D") + F.floor(c * scale).cast("double"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return one_per_id(vectors, id_, column).where(F.col("v").isNotNull() & (F.size("v") > 0) & ~bad).select("id", whole.alias("v"))


def slices(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Least value of each column, and each column's bit slices (bits, words) of 64 rows a word."""
    low = x.min(axis=0)
    out, words = [], -(-len(x) // 64)
    for column in (x - low).T.astype(np.uint64):
        bits = max(1, int(column.max()).bit_length())
        planes = (column[None, :] >> np.arange(bits, dtype=np.uint64)[:, None] & np.uint64(1)).astype(np.uint8)
        padded = np.zeros((bits, words * 64), dtype=np.uint8)
        padded[:, : len(x)] = planes
        out.append(np.packbits(padded, axis=1, bitorder="little").view(np.uint64))
    return low, out


class Adder:
    """Adds bitmaps up by place: three of a place become one, and a carry one place up, a third of a pile at a time.

    The piles and their temporary bitmaps stay in memory that all sums share.
    """

    def __init__(self, bitmaps: np.ndarray):
        self.bitmaps, self.room = bitmaps, [np.empty((0, bitmaps.shape[1]), np.uint64)] * 3

    def sum(self, rows: np.ndarray, places: np.ndarray) -> list[np.ndarray | None]:
        """Slices, lowest first, of the sum of the bitmaps ``rows`` at ``places``."""
        counts = np.bincount(places).tolist() if len(places) else []
        held, first = [], 0
        while len(held) < len(counts) or first:
            held.append(first + (counts[len(held)] if len(held) < len(counts) else 0))
            first = held[-1] // 2
        if max(held, default=0) > len(self.room[0]):
            self.room = [np.empty((max(held), self.bitmaps.shape[1]), np.uint64) for _ in range(3)]
        rows, at, out, first = rows[np.argsort(places, kind="stable")], 0, [], 0
        now, up, spare = self.room
        for place, size in enumerate(held):  # the carries of the place below are the first of a pile
            if size > first:
                self.bitmaps.take(rows[at:at + size - first], axis=0, out=now[first:size], mode="clip")
                at += size - first
            pile, first = now[:size], 0
            while (third := len(pile) // 3):
                a, b, c, ab, carry = pile[:third], pile[third:2 * third], pile[2 * third:3 * third], spare[:third], up[first:first + third]
                np.bitwise_xor(a, b, out=ab)
                np.bitwise_and(ab, c, out=carry)
                c ^= ab
                a &= b
                carry |= a
                pile, first = pile[2 * third:], first + third
            if len(pile) == 2:
                np.bitwise_and(pile[0], pile[1], out=up[first])
                pile[1] ^= pile[0]
                pile, first = pile[1:], first + 1
            out.append(pile[0].copy() if size else None)
            now, up = up, now
        return out


def select(sum_slices: list[np.ndarray], k: int, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(above, ties): bitmaps of the rows that are among the best k for certain, and of those that tie for the places left."""
    above, ties = np.zeros_like(allowed), allowed.copy()
    for plane in reversed(sum_slices):
        if plane is None:
            continue
        both = above | (ties & plane)
        enough = np.bitwise_count(both).sum() >= k
        if enough:
            ties &= plane
        else:
            above, ties = both, ties & ~plane
    return above, ties


def _bits(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def best(ids: np.ndarray, low: np.ndarray, planes: list[np.ndarray], query_ids: np.ndarray, queries: np.ndarray,
         k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, ids, scores) of each query's best k rows of a sliced block, in any order."""
    sizes = np.array([len(p) for p in planes])
    adder = Adder(np.concatenate([*planes, *(~p for p in planes)]))  # flipped from the middle on
    dim, bit = np.repeat(np.arange(len(planes)), sizes), np.concatenate([np.arange(n) for n in sizes])
    words = planes[0].shape[1]
    everyone = np.packbits(np.arange(words * 64) < len(ids), bitorder="little").view(np.uint64)
    for q_id, q in zip(query_ids.tolist(), queries, strict=True):
        # q as a difference of two numbers with as few powers of two as there can be (no two beside each other).
        half = np.abs(q) >> 1
        more = np.abs(q) + half
        plus, minus = more & (half ^ more), half & (half ^ more)
        plus, minus = np.where(q < 0, minus, plus), np.where(q < 0, plus, minus)
        shifts = range(int(more.max()).bit_length())
        taken = [(np.flatnonzero(part[dim] >> shift & 1), shift, flip) for part, flip in ((plus, 0), (minus, len(dim))) for shift in shifts]
        rows, places = np.concatenate([on + flip for on, _, flip in taken] or [dim[:0]]), np.concatenate([bit[on] + shift for on, shift, _ in taken] or [bit[:0]])
        allowed = everyone
        if (own := np.flatnonzero(ids == q_id)).size:
            allowed = everyone.copy()
            allowed[own // 64] &= ~(np.uint64(1) << (own % 64).astype(np.uint64))
        sums = adder.sum(rows, places)
        above, ties = select(sums, k, allowed)
        sure, maybe = _bits(above), _bits(ties)
        if len(maybe) > k - len(sure):
            maybe = maybe[np.argsort(ids[maybe], kind="stable")[: k - len(sure)]]
        rows = np.concatenate([sure, maybe])
        score = np.zeros(len(rows), dtype=np.int64)
        for place, plane in enumerate(sums):
            if plane is not None:
                score += ((plane[rows // 64] >> (rows % 64).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << place
        base = int((q * low - minus * ((1 << sizes) - 1)).sum())
        yield q_id, ids[rows], score + base


def exact(ids: np.ndarray, x: list[list[int]], query_ids: list[int], queries: list[list[int]], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The same for numbers of any size, by Python integers."""
    for q_id, q in zip(query_ids, queries, strict=True):
        scored = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, v, strict=True)))), i)
                        for i, v in zip(ids.tolist(), x, strict=True) if i != q_id)[:k]
        yield q_id, np.array([i for _, i in scored], dtype=np.int64), np.array([-s for s, _ in scored], dtype=np.int64)


def unsliced(low: np.ndarray, planes: list[np.ndarray], n: int) -> np.ndarray:
    """The whole numbers (rows x dimensions) that the slices stand for."""
    out = np.empty((n, len(planes)), dtype=np.int64)
    for d, own in enumerate(planes):
        bits = np.unpackbits(own.view(np.uint8), axis=1, bitorder="little")[:, :n].astype(np.int64)
        out[:, d] = low[d] + (bits << np.arange(len(own))[:, None]).sum(axis=0)
    return out


def _by_length(batches: Iterator[pa.RecordBatch], limit: Callable[[int], int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, components) of up to ``limit(dim)`` rows of one task and length."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def cut(dim: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        ids, x = (np.concatenate(parts) for parts in zip(*held.pop(dim)))
        if len(ids) > size:
            held[dim] = [(ids[size:], x[size:])]
        return ids[:size], x[:size]

    for batch in batches:
        ids, v = batch.column("id").to_numpy(), batch.column("v")
        lengths, flat = np.diff(v.offsets.to_numpy()), v.flatten().to_numpy()
        first = np.concatenate([[0], np.cumsum(lengths)])
        for dim in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == dim)
            held.setdefault(dim, []).append((ids[own], flat[first[own][:, None] + np.arange(dim)]))
            while sum(len(i) for i, _ in held.get(dim, [])) >= limit(dim):
                yield cut(dim, limit(dim))
    for dim in list(held):
        yield cut(dim, limit(dim))


def blocks(rows: DataFrame) -> DataFrame:
    """One row for each block of the index, cut from one task's rows: dim, ids, least values, bits of each dimension and the slices;
    without bits, the components themselves, of a block beyond ``SAFE``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _by_length(batches, lambda dim: 2 * max(64, min(ROWS, CELLS // dim))):
            low, bits, data = np.zeros(0, np.int64), b"", x.astype("<f8").tobytes()
            if np.abs(x).max() < SAFE:
                low, planes = slices(x.astype(np.int64))
                bits, data = bytes(len(p) for p in planes), b"".join(p.tobytes() for p in planes)
            yield pa.RecordBatch.from_pydict({"dim": pa.array([x.shape[1]], pa.int32()), "ids": [ids.astype("<i8").tobytes()],
                                              "low": [low.astype("<i8").tobytes()], "bits": [bits], "data": [data]})

    return rows.mapInArrow(run, "dim int, ids binary, low binary, bits binary, data binary")


def query_sets(rows: DataFrame) -> DataFrame:
    """One row for each task's queries of one length: task, dim, ids and components (bytes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, q in _by_length(batches, lambda dim: 2 * max(1, min(QUERIES, QUERY_CELLS // dim))):
            yield pa.RecordBatch.from_pydict({"task": pa.array([TaskContext.get().partitionId()], pa.int32()), "dim": pa.array([q.shape[1]], pa.int32()),
                                              "q_ids": [ids.astype("<i8").tobytes()], "q": [q.astype("<f8").tobytes()]})

    return rows.mapInArrow(run, "task int, dim int, q_ids binary, q binary")


def found_in(dim: int, ids: np.ndarray, low: np.ndarray, bits: bytes, data: bytes, q_ids: np.ndarray, q: np.ndarray,
             k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, ids, scores) of each query's best k rows of one written block."""
    if bits:
        ends, words = np.cumsum([0, *bits]), -(-len(ids) // 64)
        whole = np.frombuffer(data, np.uint64).reshape(-1, words)
        planes = [whole[a:b] for a, b in zip(ends[:-1], ends[1:])]
        if np.abs(q).max() < SAFE:
            return best(ids, low, planes, q_ids, q.astype(np.int64), k)
        rows = unsliced(low, planes, len(ids)).tolist()
    else:
        rows = [[int(c) for c in v] for v in np.frombuffer(data, "<f8").reshape(len(ids), dim).tolist()]
    return exact(ids, rows, q_ids.tolist(), [[int(c) for c in v] for v in q.tolist()], k)


def search(vectors: DataFrame, is_query: Column, *, id_: str = "vec_id", column: str = "embedding", scale: int = 64, k: int = 20) -> DataFrame:
    """query_id, rank, id, score: the k best rows of every query by integer inner product, ties to the smaller id."""
    rows = staged(integers(vectors, id_, column, scale))
    asked = rows.where(is_query)

    def tasks(of: DataFrame, size: int, cells: int) -> int:
        n, whole = of.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("v").cast("long")), F.lit(0))).first()
        return max(1, -(-n // size), -(-whole // cells))

    n_blocks, n_sets = tasks(rows, ROWS, CELLS), tasks(asked, QUERIES, QUERY_CELLS)
    # Both sides are dealt once; a task reads one part of either, so that no block is copied for the queries it meets.
    index = blocks(rows.repartition(n_blocks)).repartition(max(1, -(-n_blocks // BLOCKS)))
    sets = query_sets(asked.repartition(n_sets)).repartitionById(n_sets, F.col("task"))
    both = index.join(sets.drop("task").hint("shuffle_replicate_nl"), "dim")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for i in range(batch.num_rows):  # one joined row at a time: a block is a megabyte or two
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                ids, low, q_ids = (np.frombuffer(row[name], "<i8") for name in ("ids", "low", "q_ids"))
                q = np.frombuffer(row["q"], "<f8").reshape(len(q_ids), row["dim"])
                for q_id, new, score in found_in(row["dim"], ids, low, row["bits"], row["data"], q_ids, q, k):
                    if q_id in held:
                        new, score = np.concatenate([held[q_id][0], new]), np.concatenate([held[q_id][1], score])
                    order = np.lexsort((new, ~score))[:k]
                    held[q_id] = new[order], score[order]
        for q_id, (ids, score) in held.items():
            if len(ids):
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(np.full(len(ids), q_id), pa.int64()), "id": pa.array(ids, pa.int64()),
                                                  "score": pa.array(score, pa.int64())})

    found = both.mapInArrow(run, "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_), "score")
