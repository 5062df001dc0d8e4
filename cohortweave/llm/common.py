"""Shared helpers: staged tables in the shared folder, whole-text batches, vectorised word hashes, components."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Text bytes that one vectorised step works on; a longer text is a step of its own.
STEP_BYTES = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a session without it (a test) gets a folder of its own."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        folder = tempfile.mkdtemp(prefix="llm-shared-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """The frame as a written table of the shared folder: computed once, independent of lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the Python workers, once for each Spark application."""
    sc = spark.sparkContext
    if _shipped.get("to") == sc.applicationId:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="modules-"), f"{os.path.basename(top)}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(top)))
    sc.addPyFile(archive)
    _shipped["to"] = sc.applicationId


_shipped: dict[str, str] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steps(sizes: Iterable[int], limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes add up to ``limit`` at most, or that hold one larger item."""
    first, total, i = 0, 0, -1
    for i, n in enumerate(sizes):
        if i > first and total + n > limit:
            yield first, i
            first, total = i, 0
        total += n
    if i + 1 > first:
        yield first, i + 1


def text_steps(texts: list[str | None], limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    if texts:
        yield from steps((len(t) if t else 0 for t in texts), limit)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BREAK = _SPACE.copy()
_BREAK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse modulo 2**64; kept for the common size only."""
    if len(_powers["up"]) >= n:
        return _powers["up"], _powers["down"]
    size = max(n, 2 * STEP_BYTES)
    tables = []
    for base in (_BASE, _BASE_INVERSE):
        steps_ = np.full(size, base, dtype=np.uint64)
        steps_[0] = 1
        tables.append(np.multiply.accumulate(steps_))
    if size <= 8 * STEP_BYTES:
        _powers["up"], _powers["down"] = tables
    return tables[0], tables[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[bytes], lower: bool, punctuation: bool = True, cuts: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words ``[^\\x20\\x09-\\x0D]+`` in order, and the offset of each text's first word.

    The hash of a word is the difference of two prefix sums of byte * base**position, shifted back to
    position 0: no Python work per word.  ``lower`` folds A-Z; without ``punctuation``, ASCII punctuation ends words as well.
    With ``cuts``, further rows hold the hashes of each word's first so many bytes.
    """
    data = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    begins = np.concatenate(([0], np.cumsum(sizes)))
    if lower:
        data = _LOWER[data]
    word = ~(_SPACE if punctuation else _BREAK)[data]
    edge = np.diff(word.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _power_table(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])

    def until(stops: np.ndarray) -> np.ndarray:
        return mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    hashes = until(ends)
    if cuts:
        hashes = np.stack([hashes, *(until(np.minimum(ends, starts + n)) for n in cuts)])
    return hashes, np.searchsorted(starts, begins)


def long_text_pieces(text: bytes, limit: int = 4 * STEP_BYTES) -> list[bytes]:
    """A very long text cut at white space, so that a step's arrays stay small; no word is cut."""
    if len(text) <= limit:
        return [text]
    out, at = [], 0
    while at < len(text):
        end = at + limit
        while end < len(text) and not _SPACE[text[end]]:
            end += 1
        out.append(text[at:end])
        at = end
    return out


def each_word_hashes(texts: list[str | None], lower: bool, punctuation: bool = True, cuts: tuple[int, ...] = ()) -> Iterator[tuple[int, np.ndarray]]:
    """(index, word hashes) of every whole text, worked on in bounded steps."""
    for first, last in text_steps(texts):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts[first:last]]
        if last - first == 1 and len(raw[0]) > 4 * STEP_BYTES:
            yield first, np.concatenate([word_hashes([piece], lower, punctuation, cuts)[0] for piece in long_text_pieces(raw[0])], axis=-1)
            continue
        hashes, offsets = word_hashes(raw, lower, punctuation, cuts)
        for i in range(last - first):
            yield first + i, hashes[..., offsets[i]:offsets[i + 1]]


def sample_labels(labels: DataFrame, column: str, held_out: Column, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, label) of at most ``per_class`` rows of each class, least by a hash, and the rows of each class.

    Rows that are held out, or lack an id or a label of 0 or 1, are not read.  An id with both labels counts as 1.
    """
    known = (labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & ~held_out)
             .groupBy("doc_id").agg(F.max(column).cast("int").alias("label")))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    return staged(parts[0].union(parts[1])), counts


def crc_remainder(modulus: int, of: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``; null without an id."""
    return F.pmod(F.crc32(F.col(of).cast("string").cast("binary")), F.lit(modulus))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root): the smallest id that each end of an edge reaches.

    Alternating large-star and small-star steps, each one shuffle of the edge list, staged after every
    round; the number of rounds is logarithmic for the star-shaped groups that the operators emit.  A hub's
    neighbours are reduced by ``min`` with partial sums, so a large group does not meet in one task.
    """
    spark = edges.sparkSession
    now = staged(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    count = None
    while True:
        # Large star: every larger neighbour of u is linked to u's smallest neighbour (u included).
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # Small star: every smaller neighbour of u, and u, is linked to the smallest of them.
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u")
        after = staged(joined.select(F.col("u"), F.col("m").alias("v"))
                       .union(joined.select(F.col("v").alias("u"), F.col("m").alias("v")))
                       .where("u <> v").distinct())
        state = after.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if count == tuple(state):
            break
        count, now = tuple(state), after
    roots = after.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return roots.union(after.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
