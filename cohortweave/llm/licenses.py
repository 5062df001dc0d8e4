"""License scans by diagonal voting.

The rolling ``K``-word hashes of every whole text are joined with the positions of the same hashes in the templates.  A match at word
``pos`` of the text and ``tpos`` of a template votes for the diagonal ``pos - tpos``.  Votes are counted by (text, template, diagonal),
diagonals with few votes go, neighbouring ones (a word put in or left out moves the diagonal) are merged to spans, and a span is verified by
the share of the template's word groups that it holds: all for a phrase, ``COVER`` or more for other templates.  Every vote must agree
in two independent 64-bit hashes, so a span stands for the same words.

On Spark: one pass over the texts makes the hashes; the templates are the small side of the join (their number is known on the driver, and
beyond ``BROADCAST`` word groups an ordinary join is used), so no text and no hash without a match is shuffled.  Matches are keyed by a digest of the
text: copies share one key, and their repeated matches fall away in the first partial aggregate.  A text's matches are bounded by its own
length.  A worker holds a step of ``PIECE`` bytes at a time, also of one very long text, and sends flat rows of hashes.

Odd cases: null and empty texts, and texts of fewer than ``K`` words, have no match; a repeated row gives a row each time; rows without an
id keep their row; a text without a span has score 0, empty labels and null words.  Further columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cohortweave.llm.common import mix, steps
from cohortweave.llm.license_texts import PHRASES, TEMPLATES

K = 3
#: Share of a template's word groups that a span must hold.
COVER = 0.8
#: Votes that a diagonal of a template needs (all, if the template has fewer).
VOTES = 3
#: Diagonals this near, whose places are at most ``GAP`` words apart, are one span.
SHIFT, GAP = 8, 16
#: Rows of hashes after which a worker sends what it has.
CHUNK = 1 << 15
BROADCAST = 200_000
#: Parts that the copies of a text are dealt over when they meet its marks.
PARTS = 16
#: Bytes of text that one step works on.
PIECE = 1 << 17

#: A-Z to lower case; every ASCII character that is no letter or digit to a blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_tables: list[tuple[np.ndarray, np.ndarray]] = []


def _powers() -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of the two bases and of their inverses modulo 2**64, for a piece of text."""
    if not _tables:
        for base in _BASES:
            pair = []
            for b in (base, pow(base, -1, 1 << 64)):
                steps = np.full(2 * PIECE, b, dtype=np.uint64)
                steps[0] = 1
                pair.append(np.multiply.accumulate(steps))
            _tables.append(tuple(pair))
    return _tables


def _piece_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each word (rows) and the words' starts, of folded text that ends with a blank."""
    raw = np.frombuffer(data, dtype=np.uint8)
    edge = np.diff((raw != 32).astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    value = raw.astype(np.uint64) + np.uint64(1)
    found = np.empty((2, len(starts)), dtype=np.uint64)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    for row, (up, down) in enumerate(_powers()):
        np.cumsum(value * up[:len(raw)], out=sums[1:])
        found[row] = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return found, starts


def _pieces(data: bytes) -> Iterator[bytes]:
    """A folded text in pieces that end at a blank; one word longer than a piece is hashed by its own digest."""
    at = 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        if end < len(data):
            cut = data.rfind(b" ", at, end)
            if cut < 0:  # a word longer than a piece: its place is kept by a stand-in that no template holds
                cut = data.find(b" ", end)
                cut = len(data) if cut < 0 else cut
                yield hashlib.sha256(data[at:cut]).hexdigest().encode() * 2 + b" "
                at = cut
                continue
            end = cut + 1
        yield data[at:end] + b" "
        at = end


def _runs(raw: list[bytes], k: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(index, number of the first word, two rows of hashes of the runs of ``k`` words from it) of texts that make one step.

    A text longer than ``PIECE`` is a step of its own and comes piece by piece, the last ``k - 1`` words carried over.
    """
    weights = [np.uint64(w) for w in np.random.default_rng(11).integers(1, 1 << 62, size=k) * 2 + 1]

    def run(words: np.ndarray) -> np.ndarray:
        n = max(words.shape[1] - k + 1, 0)
        return mix(sum((words[:, j:j + n] * weights[j] for j in range(k)), np.zeros((2, n), np.uint64))).view(np.int64)

    folded = [t.translate(_FOLD) for t in raw]
    if len(folded) == 1:
        at, carried = 0, np.empty((2, 0), np.uint64)
        for piece in _pieces(folded[0]):
            words = np.concatenate([carried, _piece_words(piece)[0]], axis=1)
            found = run(words)
            yield 0, at, found
            at, carried = at + found.shape[1], words[:, found.shape[1]:]
        return
    words, starts = _piece_words(b" ".join([*folded, b""]))
    begins = np.searchsorted(starts, np.concatenate(([0], np.cumsum([len(t) + 1 for t in folded]))))
    found = run(words)
    for i in range(len(folded)):
        yield i, 0, found[:, begins[i]:max(begins[i], begins[i + 1] - k + 1)]


def grams(text: str, k: int = K) -> np.ndarray:
    """Two rows of hashes of all runs of ``k`` words of a text."""
    return np.concatenate([np.empty((2, 0), np.int64), *(found for _, _, found in _runs([text.encode("utf-8", "surrogatepass")], k))], axis=1)


def template_grams(spark: SparkSession, templates: list[tuple[str, str, bool]], k: int = K) -> DataFrame:
    """(a, b, template, tpos) of every word group of the templates; each needs ``k`` words."""
    rows = []
    for i, (_, text, _) in enumerate(templates):
        found = grams(text, k)
        if not found.shape[1]:
            raise ValueError(f"template of fewer than {k} words: {text!r}")
        rows += [(int(a), int(b), i, t) for t, (a, b) in enumerate(found.T)]
    df = spark.createDataFrame(rows, "a long, b long, template int, tpos int")
    return F.broadcast(df) if len(rows) <= BROADCAST else df


def known() -> list[tuple[str, str, bool]]:
    """(label, text, is a phrase) of the wordings kept here."""
    return [(label, text, True) for label, text in PHRASES] + [(label, text, False) for label, text in TEMPLATES]


def _text_key():
    return F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))


def _rows(held: list[tuple[bytes, int, np.ndarray]]) -> pa.RecordBatch:
    """One row for each run of words: key (32 bytes), pos, a, b."""
    sizes = [found.shape[1] for _, _, found in held]
    n = sum(sizes)
    keys = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, 32 * n + 1, 32, dtype=np.int32)), pa.py_buffer(b"".join(key * m for (key, _, _), m in zip(held, sizes, strict=True)))])
    pos = np.concatenate([np.arange(at, at + m) for (_, at, _), m in zip(held, sizes, strict=True)])
    a, b = np.concatenate([found for _, _, found in held], axis=1)
    return pa.RecordBatch.from_arrays([keys, pa.array(pos, pa.int64()), pa.array(a), pa.array(b)], names=["key", "pos", "a", "b"])


def matches(docs: DataFrame, templates: list[tuple[str, str, bool]] | None = None, k: int = K) -> DataFrame:
    """(key, template, pos, tpos): every word group of a text that a template holds, once for each text."""
    spark = docs.sparkSession

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, held, size = batch.column("text").cast(pa.binary()), [], 0
            for first, last in steps((n + 1 for n in pc.binary_length(texts).to_pylist()), PIECE):
                keys = batch.column("key").slice(first, last - first).to_pylist()
                for i, at, found in _runs(texts.slice(first, last - first).to_pylist(), k):
                    held.append((keys[i], at, found))
                    size += found.shape[1]
                    if size >= CHUNK:
                        yield _rows(held)
                        held, size = [], 0
            if size:
                yield _rows(held)

    each = (docs.where(F.col("text").isNotNull()).select(_text_key().alias("key"), "text")
            .mapInArrow(hashed, "key binary, pos long, a long, b long"))
    return (each.join(template_grams(spark, templates or known(), k), ["a", "b"])
            .groupBy("key", "template", "pos", "tpos").agg(F.count(F.lit(1)).alias("copies")).drop("copies"))


def spans(docs: DataFrame, templates: list[tuple[str, str, bool]] | None = None, k: int = K, cover: float = COVER) -> DataFrame:
    """(key, template, label, phrase, start, end, score): verified spans of each distinct text; key is the text's SHA-256, words count from 0."""
    templates = templates or known()
    sizes = [grams(text, k).shape[1] for _, text, _ in templates]
    facts = docs.sparkSession.createDataFrame(
        [(i, label, phrase, sizes[i], sizes[i] if phrase else min(VOTES, sizes[i]), 1.0 if phrase else cover) for i, (label, _, phrase) in enumerate(templates)],
        "template int, label string, phrase boolean, grams int, votes_least int, cover double")
    facts = F.broadcast(facts) if len(templates) <= BROADCAST else facts
    diagonals = (matches(docs, templates, k).groupBy("key", "template", (F.col("pos") - F.col("tpos")).alias("diagonal"))
                 .agg(F.count(F.lit(1)).alias("votes"), F.min("pos").alias("start"), (F.max("pos") + k).alias("end"), F.collect_set("tpos").alias("held"))
                 .join(facts, "template").where("votes >= votes_least"))
    by = Window.partitionBy("key", "template").orderBy("start", "diagonal")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    apart = (F.col("phrase") | F.lag("diagonal").over(by).isNull() | (F.abs(F.col("diagonal") - F.lag("diagonal").over(by)) > SHIFT)
             | (F.col("start") > F.max("end").over(before) + GAP))
    marked = diagonals.withColumn("span", F.sum(apart.cast("int")).over(by))
    whole = (marked.groupBy("key", "template", "label", "phrase", "cover", "grams", "span")
             .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.size(F.array_distinct(F.flatten(F.collect_list("held")))).alias("covered")))
    return (whole.withColumn("score", F.col("covered") / F.col("grams")).where("score >= cover")
            .select("key", "template", "label", "phrase", "start", "end", "score"))


def scan(docs: DataFrame, templates: list[tuple[str, str, bool]] | None = None, k: int = K) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    found = spans(docs, templates, k)

    def joined(which):
        return F.array_join(F.array_sort(F.collect_set(which)), ",")

    base = F.when(F.col("phrase"), F.col("start"))
    marks = found.groupBy("key").agg(
        F.count(base).alias("n_base"), F.min(base).alias("first_word"), F.max(base).alias("last_word"),
        joined(F.when(F.col("phrase"), F.col("label"))).alias("base_labels"), joined(F.col("label")).alias("labels"), F.max("score").alias("score"))
    n_words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long")
    rows = docs.select("doc_id", "text", n_words.alias("n_words"))
    # Texts too short for a match would all meet in the key of the empty text: their keys are numbers that no digest equals.
    number = F.monotonically_increasing_id().cast("string").cast("binary")
    rows = rows.select("doc_id", "n_words", F.when(F.col("n_words") >= k, _text_key()).otherwise(number).alias("key"))
    # Copies of one marked text are dealt over parts, each with the marks of the text.
    rows = rows.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("int"))
    marks = marks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    out = rows.join(marks, ["key", "part"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
                      F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
                      F.coalesce("score", F.lit(0.0)).alias("score"))
