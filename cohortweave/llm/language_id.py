"""Language identification of mixed-language text (operator 3).

Every letter is scored for every learned language by hashed character n-grams (the letter alone, and the three and four
letters around it, inside its word).  Script ranges narrow the candidates: a language whose training text hardly ever uses
the script of a word can't label that word while another one can.  A Viterbi search over the words' scores, with a penalty
for each switch, labels spans; the language of most labelled letters is the prediction.

The search is exact and vectorised: documents are cut into blocks of ``BLOCK`` words, each block is solved for every label
that may stand before it, and blocks are then chained; with the labels at their borders known, each block is solved once more
for its own.  Long texts cost no more per word than short ones.  Any number of languages may be learned: as many blocks are
solved at once as ``CELLS`` numbers hold.

Model: counts of n-gram buckets by language, from a sample of about ``per_language`` labelled documents of each language
(chosen by a hash of doc_id, whole texts), summed by Spark; the table has ``BUCKETS`` rows whatever the input.

Edge cases: null, empty and letterless texts get ``und`` and score 0; equal scores go to the label first in code point order;
repeated rows give one row each; an empty table gives an empty table, and with no labelled document every text is ``und``.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cohortweave.llm.common import crc_remainder, text_steps

BUCKETS = 1 << 16
BLOCK = 256
STEP_CHARS = 1 << 19
# Numbers that a table of the search, or of the letters' scores, holds at once.
CELLS = 1 << 23
UNKNOWN = "und"
RARE_SCRIPT = 0.005
# First and last code points by script; letters elsewhere form the script 0.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}
N_SCRIPTS = len(SCRIPTS) + 1
_tables: dict[str, np.ndarray] = {}


def _table(name: str) -> np.ndarray:
    """Per code point: part of a word, letter, lower case, script."""
    if not _tables:
        size = sys.maxunicode + 1
        word, letter = np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)
        lower, script = np.arange(size, dtype=np.uint32), np.zeros(size, dtype=np.uint8)
        for cp in (*range(0xD800), *range(0xE000, 0x32400)):
            c = chr(cp)
            kind = unicodedata.category(c)[0]
            if kind == "L":
                letter[cp] = word[cp] = True
                if len(low := c.lower()) == 1:
                    lower[cp] = ord(low)
            elif kind == "M":
                word[cp] = True
        for k, ranges in enumerate(SCRIPTS.values(), 1):
            for first, last in ranges:
                script[first:last + 1] = k
        _tables.update(word=word, letter=letter, lower=lower, script=script)
    return _tables[name]


@dataclass
class Letters:
    """The letters of some texts, in order, and where their words and texts begin."""

    code: np.ndarray  # lower-case code points, 0 between words
    at: np.ndarray  # positions of letters and marks in code
    word_first: np.ndarray  # index into ``at`` of each word's first character
    word_begin: np.ndarray  # position of each word in code
    word_end: np.ndarray
    text_word: np.ndarray  # index of each text's first word, and the number of words
    text_begin: np.ndarray  # position of each text in code


def letters(texts: list[str]) -> Letters:
    """All words (runs of letters and marks that hold a letter) of the texts."""
    joined = "\n".join([*texts, ""])
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    word = _table("word")[code]
    is_letter = _table("letter")[code]
    edge = np.diff(word.astype(np.int8), prepend=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(begin):
        real = np.add.reduceat(is_letter.astype(np.int64), begin) > 0  # runs of marks alone are no words
        if not real.all():
            for b, e in zip(begin[~real], end[~real], strict=True):
                word[b:e] = False
            begin, end = begin[real], end[real]
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    starts = np.concatenate(([0], np.cumsum(sizes)))
    at = np.flatnonzero(word)
    code = np.where(word, _table("lower")[code], np.uint32(0))
    return Letters(code, at, np.searchsorted(at, begin), begin, end, np.searchsorted(begin, starts), starts[:-1])


def features(x: Letters) -> list[np.ndarray]:
    """Buckets of the n-grams at every character of ``x.at``."""
    c = np.concatenate((np.zeros(2, dtype=np.uint64), x.code.astype(np.uint64), np.zeros(1, dtype=np.uint64)))
    i = x.at + 2
    now, last, following = c[i], c[i - 1], c[i + 1]
    before = np.where(last == 0, np.uint64(0), c[i - 2])
    a, b = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    three = ((last * a + now) * b + following) * a
    four = (three + before * b + np.uint64(1)) * a
    one = (now + np.uint64(7)) * b
    return [(h >> np.uint64(48)).astype(np.int64) for h in (one, three, four)]


@dataclass
class Model:
    labels: list[str]
    weight: np.ndarray  # (BUCKETS, labels): log share of a bucket among a language's n-grams
    scripts: np.ndarray  # (N_SCRIPTS, labels): may the language write in the script?
    switch: float

    def word_scores(self, x: Letters) -> np.ndarray:
        """(words, labels): mean score of the three n-gram orders, summed over the word."""
        grams, ends = features(x), np.append(x.word_first[1:], len(x.at))
        out, a, most = np.zeros((len(ends), len(self.labels)), dtype=self.weight.dtype), 0, max(1, CELLS // len(self.labels))
        while a < len(ends):
            begin = x.word_first[a]
            b = max(a + 1, int(np.searchsorted(ends, begin + most, side="right")))
            score = sum(self.weight[f[begin:ends[b - 1]]] for f in grams) / 3
            out[a:b] = np.add.reduceat(score, x.word_first[a:b] - begin, axis=0)
            a = b
        allowed = self.scripts[_table("script")[x.code[x.at[x.word_first]]]]
        narrowed = allowed.any(axis=1)
        out -= out.max(axis=1, keepdims=True)
        return np.where(narrowed[:, None] & ~allowed, np.float32(-1e6), out)


def viterbi(scores: np.ndarray, text_word: np.ndarray, switch: float) -> np.ndarray:
    """The labels of all words: largest sum of scores less ``switch`` for each change of label within a text."""
    n_labels = scores.shape[1]
    begin, first = [], []
    for a, b in zip(text_word[:-1], text_word[1:], strict=True):
        begin += range(a, b, BLOCK)
        first += [k == a for k in range(a, b, BLOCK)]
    if not begin:
        return np.zeros(0, dtype=np.int32)
    begin = np.array(begin)
    size = np.minimum(begin + BLOCK, text_word[1:][np.searchsorted(text_word[1:], begin, side="right")]) - begin
    # Chain the blocks of each text forward, then fix the labels at their borders backward.
    came = np.zeros((len(begin), n_labels), dtype=np.int32)
    entry, exit_ = np.zeros(len(begin), dtype=np.int32), np.zeros(len(begin), dtype=np.int32)
    value, start, most = np.zeros(n_labels), 0, max(1, CELLS // n_labels ** 2)
    for a in range(0, len(begin), most):
        for k, best in enumerate(_solved(scores, begin[a:a + most], size[a:a + most], switch), a):
            if first[k]:
                value, start = np.zeros(n_labels), k  # any label may stand before a text, so its first word costs no switch
            total = value[:, None] + best
            came[k] = total.argmax(axis=0)
            value = total.max(axis=0)
            if k + 1 == len(begin) or first[k + 1]:
                last = int(value.argmax())
                for j in range(k, start - 1, -1):
                    exit_[j] = last
                    last = int(came[j, last])
                    entry[j] = last
    out, most = np.zeros(len(scores), dtype=np.int32), max(1, CELLS // (BLOCK * n_labels))
    order = np.argsort(-size, kind="stable")
    for a in range(0, len(order), most):
        k = order[a:a + most]
        _traced(scores, begin[k], size[k], entry[k], exit_[k], switch, out)
    return out


def _solved(scores: np.ndarray, begin: np.ndarray, size: np.ndarray, switch: float) -> np.ndarray:
    """(blocks, before, now): best sum of each block that ends in the label ``now`` with ``before`` in front of it."""
    order = np.argsort(-size, kind="stable")
    size, begin, rank = size[order], begin[order], np.argsort(order, kind="stable")
    change = np.where(np.eye(scores.shape[1], dtype=bool), 0.0, -switch)
    best, live = change[None] + scores[begin][:, None, :], len(begin)
    for t in range(1, int(size[0])):
        while size[live - 1] <= t:
            live -= 1
        old = best[:live]
        best[:live] = np.maximum(old, old.max(axis=2, keepdims=True) - switch) + scores[begin[:live] + t][:, None, :]
    return best[rank]


def _traced(scores: np.ndarray, begin: np.ndarray, size: np.ndarray, entry: np.ndarray, exit_: np.ndarray, switch: float, out: np.ndarray) -> None:
    """Write to ``out`` the labels of blocks, longest first, of which the labels in front (entry) and at the end are known."""
    n_labels, live = scores.shape[1], len(begin)
    labels = np.arange(n_labels, dtype=np.int32)
    best = np.where(labels == entry[:, None], 0.0, -switch) + scores[begin]
    back = np.zeros((int(size[0]), len(begin), n_labels), dtype=np.int32)
    for t in range(1, int(size[0])):
        while size[live - 1] <= t:
            live -= 1
        old = best[:live]
        top = old.argmax(axis=1)[:, None]
        peak = np.take_along_axis(old, top, axis=1) - switch
        back[t, :live] = np.where(old >= peak, labels, top)
        best[:live] = np.maximum(old, peak) + scores[begin[:live] + t]
    now, live = exit_.copy(), 0
    for t in range(int(size[0]) - 1, -1, -1):
        while live < len(size) and size[live] > t:
            live += 1
        out[begin[:live] + t] = now[:live]
        if t:
            now[:live] = back[t, np.arange(live), now[:live]]


def _in_batches(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[str]]]:
    for batch in batches:
        texts = ["" if t is None else t for t in batch["text"]]
        for a, b in text_steps(texts, STEP_CHARS):
            yield batch.iloc[a:b], texts[a:b]


def fit(docs: DataFrame, *, per_language: int = 2000, switch: float = 12.0) -> Model:
    """Learn from ``text`` and non-null ``lang``: n-gram and script counts, summed by Spark."""
    known = docs.where("lang IS NOT NULL").select(F.xxhash64("doc_id").alias("h"), "text", "lang")
    totals = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(totals, key=lambda s: s.encode("utf-8", "surrogatepass"))
    if not names:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((N_SCRIPTS, 0), bool), switch)
    rule = F.lit(False)
    for name in names:
        share = min(1.0, per_language / totals[name])
        rule = rule | ((F.col("lang") == name) & (F.pmod("h", F.lit(1_000_000)) < int(share * 1_000_000) + 1))
    index = {name: i for i, name in enumerate(names)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buckets = np.zeros((len(names), 3 * BUCKETS + N_SCRIPTS), dtype=np.int64)
        for part, texts in _in_batches(batches):
            x = letters(texts)
            if not len(x.at):
                continue
            own = np.repeat([index[s] for s in part["lang"]], np.diff(np.searchsorted(x.at, np.append(x.text_begin, len(x.code)))))
            kinds = [*(f + k * BUCKETS for k, f in enumerate(features(x))), 3 * BUCKETS + _table("script")[x.code[x.at]].astype(np.int64)]
            for f in kinds:
                np.add(buckets, np.bincount(own * buckets.shape[1] + f, minlength=buckets.size).reshape(buckets.shape), out=buckets)
        lang, bucket = np.nonzero(buckets)
        yield pd.DataFrame({"lang": lang, "bucket": bucket, "n": buckets[lang, bucket]})

    counted = (known.where(rule).select("text", "lang").mapInPandas(count, "lang int, bucket int, n long")
               .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())
    table = np.zeros((3 * BUCKETS + N_SCRIPTS, len(names)))
    table[counted["bucket"], counted["lang"]] = counted["n"]
    scripts = table[3 * BUCKETS:]
    # The three orders use the same buckets: their counts add up to one table.
    grams = sum(table[k * BUCKETS:(k + 1) * BUCKETS] for k in range(3)) + 0.5
    weight = np.log(grams / grams.sum(axis=0, keepdims=True))
    return Model(names, weight.astype(np.float32), scripts > RARE_SCRIPT * np.maximum(scripts.sum(axis=0), 1), switch)


def _labelled(model: Model, texts: list[str], with_spans: bool) -> tuple[np.ndarray, np.ndarray, list[list[dict]]]:
    """Prediction, score and spans of each text."""
    names = np.array([*model.labels, UNKNOWN], dtype=object)
    n, k = len(texts), len(model.labels)
    pred, score, spans = np.full(n, k), np.zeros(n), [[] for _ in range(n)]
    x = letters(texts)
    if k and len(x.at):
        found = viterbi(model.word_scores(x), x.text_word, model.switch)
        text_of = np.repeat(np.arange(n), np.diff(x.text_word))
        share = np.bincount(text_of * k + found, weights=x.word_end - x.word_begin, minlength=n * k).reshape(n, k)
        some = share.sum(axis=1) > 0
        pred[some] = share[some].argmax(axis=1)
        score[some] = share[some].max(axis=1) / share[some].sum(axis=1)
        if with_spans:
            new = np.flatnonzero((np.diff(found, prepend=-1) != 0) | (np.diff(text_of, prepend=-1) != 0))
            last = np.append(new[1:], len(found)) - 1
            for a, b in zip(new, last, strict=True):
                begin = x.text_begin[text_of[a]]
                spans[text_of[a]].append({"start": int(x.word_begin[a] - begin), "end": int(x.word_end[b] - begin), "lang": names[found[a]]})
    return names[pred], score, spans


def label(docs: DataFrame, model: Model, *, with_spans: bool = True) -> DataFrame:
    """doc_id, lang_pred, score (share of the letters labelled with the prediction) and, if wanted, spans.

    A span is (start, end, lang): code points of a longest run of words with one label.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, texts in _in_batches(batches):
            pred, score, spans = _labelled(held.value, texts, with_spans)
            out = pd.DataFrame({"doc_id": part["doc_id"].array, "lang_pred": pred, "score": score})
            yield out.assign(spans=spans) if with_spans else out

    schema = "doc_id string, lang_pred string, score double" + (", spans array<struct<start: int, end: int, lang: string>>" if with_spans else "")
    out = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, schema)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows, with all their columns, whose text has a language; no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            keep = np.zeros(len(texts), dtype=bool)
            for a, b in text_steps(texts, STEP_CHARS):
                keep[a:b] = _labelled(held.value, texts[a:b], False)[0] != UNKNOWN
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def is_held_out() -> Column:
    """Rows that are not learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(crc_remainder(4) == 2, F.lit(False))


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, learned from the rows that are not held out."""
    model = fit(docs.where(~is_held_out()))
    return label(docs, model, with_spans=False).withColumn("held_out", is_held_out()).select("doc_id", "held_out", "lang_pred", "score")
