"""MinHash near-duplicates with sequential Bayesian verification (operator 10).

1. Every whole text becomes the set of its distinct shingles (64-bit hashes), one key of that set, and a signature of
   ``HASHES`` minima, cut to 8 bits each.  Equal sets meet by key and are one row with an id of their own from then on, however many
   rows, ids and texts repeat; links between sets become links between their smallest ids at the end.
2. Banding: ``ROWS`` minima make a band; at the similarity asked for a pair shares no band with a chance below 2e-4.
   Each bucket's smallest id is its hub; (member, hub) are the first candidates, so a bucket of n gives n - 1 pairs.
3. Sequential verification compares the signatures of a pair in batches and stops as soon as the posterior chance of a
   similarity at or above the threshold, under a uniform prior, is below ``miss``.  Survivors are verified exactly on
   the full sets, read again from the texts.
4. Verified links join ids to components.  A bucket whose members then still lie in several components may hide links
   between members other than the hub: the members outside its largest component are compared with all its members by
   signature, inside tasks of bounded blocks, which name the components that may be linked.  Such components are compared
   member by member in blocks that hold each text once, by signature and then exactly; pairs are never written out.

A link is lost only if no band meets or the sequential test errs; none is made up.  Large groups of near copies fall into
one component in step 3 and cost nothing in step 4.

Edge cases: null texts and texts without words have no shingles and link with nothing; a text of fewer words than a
shingle is one shingle; rows that repeat an id count as one document whose links are those of all its texts; null ids
form no links; ids are integers; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cohortweave.llm.common import components, each_word_hashes, mix, staged

ROWS = 8
BANDS = 50
HASHES = ROWS * BANDS
BATCH = 40
MISS = 1e-4
BLOCK = 512
_rng = np.random.default_rng(20)
_SCALE = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_SHIFT = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text's word hashes."""
    if len(words) == 0:
        return words
    n = max(len(words) - width + 1, 1)
    span = min(width, len(words))
    h = np.full(n, len(words) if len(words) < width else 0, dtype=np.uint64)
    for k in range(span):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[k:k + n])
    return np.unique(h)


def signature(shingle: np.ndarray) -> np.ndarray:
    """``HASHES`` minima over 32-bit hashes, cut to their upper mixed 8 bits."""
    x = (shingle >> np.uint64(32)).astype(np.uint32) ^ shingle.astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for a in range(0, len(x), 2048):  # blocks that stay in the cache
        part = x[a:a + 2048]
        for b in range(0, HASHES, 16):
            h = part[None, :] * _SCALE[b:b + 16, None] + _SHIFT[b:b + 16, None]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            np.minimum(least[b:b + 16], h.min(axis=1), out=least[b:b + 16])
    return ((least * np.uint32(0x297A2D39)) >> np.uint32(24)).astype(np.uint8)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_key, n, k1, k2, sig, row): hash of the text, set size, 128-bit key of the set, signature (null without shingles), a number of its own."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, rows, known = batch["text"].tolist(), [], {}
            for _, words in each_word_hashes(texts, lower=True):
                s = shingles(words, width)
                if not len(s):
                    rows.append((0, 0, 0, None))
                    continue
                k1, k2 = (int(np.add.reduce(mix(s ^ np.uint64(c))).astype(np.int64)) for c in (0x51ED270B0F4A1D2B, 0xA24BAED4963EE407))
                if (k1, k2) not in known:
                    known[k1, k2] = signature(s).tobytes()
                rows.append((len(s), k1, k2, known[k1, k2]))
            out = pd.DataFrame(rows, columns=["n", "k1", "k2", "sig"])
            out.insert(0, "doc_id", batch["doc_id"].array)
            out.insert(1, "text_key", batch["text_key"].array)
            yield out

    narrow = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    out = narrow.mapInPandas(run, "doc_id string, text_key long, n long, k1 long, k2 long, sig binary")
    return out.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("row", F.monotonically_increasing_id())


def least_matches(threshold: float, miss: float) -> np.ndarray:
    """For each batch end, the fewest equal minima with which a pair goes on.

    With a uniform prior, P(similarity >= t | m of n equal) = P(Binomial(n + 1, t) <= m).  Different minima are equal
    after the cut to 8 bits with chance 1/256, which moves t up.
    """
    out, threshold = [], threshold + (1 - threshold) / 256
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return np.array(out)


def survive(a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which rows of two signature matrices pass every batch of the sequential test."""
    alive, equal = np.arange(len(a)), np.zeros(len(a), dtype=np.int32)
    for k, m in enumerate(least):
        if not len(alive):
            break
        part = slice(k * BATCH, (k + 1) * BATCH)
        equal = equal + (a[alive, part] == b[alive, part]).sum(axis=1)
        keep = equal >= m
        alive, equal = alive[keep], equal[keep]
    out = np.zeros(len(a), dtype=bool)
    out[alive] = True
    return out


def _matrix(sigs: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), dtype=np.uint8).reshape(len(sigs), HASHES)


def plausible(pairs: DataFrame, sigs: DataFrame, least: np.ndarray) -> DataFrame:
    """The pairs (a, b) whose signatures pass the sequential test."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                yield x.loc[survive(_matrix(x["sa"]), _matrix(x["sb"]), least), ["a", "b"]]

    both = (pairs.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a")
            .join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b"))
    return both.mapInPandas(run, "a long, b long").distinct()


def _similar(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * common >= percent * (len(s) + len(t) - common)


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * common >= percent * union shingles, by their whole texts (id, text)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for x in batches:
            hubs = x["tb"].tolist()
            new = [t for t in dict.fromkeys(hubs) if t not in held]
            if len(held) > 64:  # pairs arrive by hub: few sets are needed again
                held, new = {}, list(dict.fromkeys(hubs))
            held.update((new[i], shingles(w, width)) for i, w in each_word_hashes(new, lower=True))
            keep = []
            for (_, w), hub in zip(each_word_hashes(x["ta"].tolist(), lower=True), hubs, strict=True):
                keep.append(_similar(shingles(w, width), held[hub], percent))
            yield x.loc[np.array(keep, dtype=bool), ["a", "b"]]

    both = (pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
            .join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b"))
    return both.mapInPandas(run, "a long, b long").distinct()


def _split_buckets(members: DataFrame, sigs: DataFrame, roots: DataFrame, least: np.ndarray) -> DataFrame:
    """(a, b): components of which a bucket holds members whose signatures pass the sequential test."""
    m = members.join(roots, members["id"] == roots["rid"], "left").select("bucket", "id", F.coalesce("root", "id").alias("root"))
    mixed = m.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("c")).where("lo < hi AND c > 2")
    m = staged(m.join(mixed.select("bucket", "c"), "bucket"))
    sizes = m.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("x")).select("bucket", F.col("x.root").alias("main"), F.col("x.n").alias("nm"))
    m = m.join(main, "bucket").withColumn("u", F.col("c") - F.col("nm"))
    rows = F.ceil(F.col("u") / BLOCK).cast("int")
    cols = F.ceil(F.col("c") / BLOCK).cast("int")
    h = F.xxhash64("id")
    left = (m.where("root <> main").withColumn("i", F.pmod(h, rows).cast("int"))
            .withColumn("j", F.explode(F.sequence(F.lit(0), cols - 1))).withColumn("side", F.lit(0)))
    right = (m.withColumn("j", F.pmod(h, cols).cast("int"))
             .withColumn("i", F.explode(F.sequence(F.lit(0), rows - 1))).withColumn("side", F.lit(1)))
    keep = ["bucket", "i", "j", "side", "id", "root"]
    both = left.select(*keep).union(right.select(*keep)).join(sigs.select("id", "sig"), "id")

    def run(x: pd.DataFrame) -> pd.DataFrame:
        a, b = x[x["side"] == 0], x[x["side"] == 1]
        out = []
        if len(a) and len(b):
            sa, sb, ra, rb = _matrix(a["sig"]), _matrix(b["sig"]), a["root"].to_numpy(), b["root"].to_numpy()
            for k in range(len(a)):
                other = np.flatnonzero(rb != ra[k])
                hit = other[survive(np.broadcast_to(sa[k], (len(other), HASHES)), sb[other], least)]
                out += [(max(ra[k], v), min(ra[k], v)) for v in np.unique(rb[hit])]
        return pd.DataFrame(list(set(out)), columns=["a", "b"], dtype="int64")

    return both.groupBy("bucket", "i", "j").applyInPandas(run, "a long, b long").distinct()


def _between(joined: DataFrame, texts: DataFrame, sigs: DataFrame, roots: DataFrame, least: np.ndarray, width: int, percent: int) -> DataFrame:
    """Links (a, b) between members of the components ``joined`` (a, b).

    The larger component of a pair is cut into blocks, and so are the members of all its partners; a task holds one block
    of each, every text once.  Members that a task has linked already are not compared again.
    """
    named = joined.select(F.col("a").alias("root")).union(joined.select(F.col("b").alias("root"))).distinct()
    m = staged(named.join(roots, "root", "left").select("root", F.coalesce("rid", "root").alias("id")))
    sizes = m.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    sized = joined.join(sizes.select(F.col("root").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("root").alias("b"), F.col("n").alias("nb")), "b")
    larger = F.col("na") > F.col("nb")
    sized = staged(sized.select(F.when(larger, F.col("a")).otherwise(F.col("b")).alias("big"), F.when(larger, F.col("b")).otherwise(F.col("a")).alias("small"),
                                F.greatest("na", "nb").alias("n"), F.least("na", "nb").alias("partner")))
    split = sized.groupBy("big").agg(F.ceil(F.max("n") / BLOCK).cast("int").alias("rows"), F.ceil(F.sum("partner") / BLOCK).cast("int").alias("cols"))
    h = F.xxhash64("id")
    left = (split.join(m, F.col("big") == F.col("root")).withColumn("i", F.pmod(h, F.col("rows")).cast("int"))
            .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("cols") - 1))).withColumn("side", F.lit(0)))
    right = (sized.select("big", "small").join(split, "big").join(m, F.col("small") == F.col("root")).withColumn("j", F.pmod(h, F.col("cols")).cast("int"))
             .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).withColumn("side", F.lit(1)))
    keep = ["big", "i", "j", "side", "root", "id"]
    both = left.select(*keep).union(right.select(*keep)).join(sigs.select("id", "sig"), "id").join(texts, "id")

    def run(x: pd.DataFrame) -> pd.DataFrame:
        a, b = x[x["side"] == 0], x[x["side"] == 1]
        out, done = [], set()
        if len(a) and len(b):
            sa, sb, ia, ib, rb = _matrix(a["sig"]), _matrix(b["sig"]), a["id"].to_numpy(), b["id"].to_numpy(), b["root"].to_numpy()
            sets = [shingles(w, width) for _, w in each_word_hashes(a["text"].tolist(), lower=True)]
            for k, (_, words) in enumerate(each_word_hashes(b["text"].tolist(), lower=True)):
                if rb[k] in done:  # its whole component is joined already
                    continue
                own = shingles(words, width)
                for v in np.flatnonzero(survive(sa, np.broadcast_to(sb[k], sa.shape), least)):
                    if _similar(sets[v], own, percent):
                        out.append((max(ia[v], ib[k]), min(ia[v], ib[k])))
                        done.add(rb[k])
                        break
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return both.groupBy("big", "i", "j").applyInPandas(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reached by links), kept (is that id) of every row."""
    least = least_matches(percent / 100, miss)
    every = staged(signatures(docs, width))
    sets = every.where("n > 0 AND doc_id IS NOT NULL")
    same = sets.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), F.min("row").alias("first"))
    # Ids with equal sets are linked; an id that repeats with other texts links those texts' groups as well.
    owned = sets.join(same, ["k1", "k2", "n"])
    copies = owned.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    # One row per distinct set, whatever repeats: its first, with an id of its own and the (doc_id, text) that its text is read from.
    sigs = staged(owned.where("row = first").select(F.xxhash64("k1", "k2", "n").alias("id"), "rep", "doc_id", "text_key", "sig"))
    band = F.expr(f"transform(sequence(0, {BANDS - 1}), k -> xxhash64(k, substring(sig, k * {ROWS} + 1, {ROWS})))")
    buckets = sigs.select("id", F.explode(band).alias("bucket"))
    hubs = buckets.groupBy("bucket").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last")
    members = staged(buckets.join(hubs.select("bucket", "hub"), "bucket"))
    pairs = members.where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    needed = sigs.join(members.select("id").distinct(), "id", "left_semi").select("id", "doc_id", "text_key")
    once = docs.groupBy("doc_id", F.xxhash64("text").alias("text_key")).agg(F.any_value("text").alias("text"))
    texts = staged(once.join(needed, ["doc_id", "text_key"]).select("id", "text"))
    links = staged(verified(plausible(pairs, sigs, least), texts, width, percent))
    roots = components(links).select(F.col("id").alias("rid"), "root")
    more = _between(staged(_split_buckets(members.select("bucket", "id"), sigs, roots, least)), texts, sigs, roots, least, width, percent)
    named = sigs.select("id", "rep")
    by_doc = (links.union(more).join(named.select(F.col("id").alias("a"), F.col("rep").alias("ra")), "a")
              .join(named.select(F.col("id").alias("b"), F.col("rep").alias("rb")), "b").select("ra", "rb"))
    groups = components(by_doc.union(copies).toDF("a", "b"))
    out = every.join(groups, every["doc_id"] == groups["id"], "left")
    root = F.coalesce("root", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), root.alias("component_id"), (F.col("doc_id") == root).alias("kept"))


def representatives(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, with all its columns: the one of the smallest id.

    Rows that repeat an id are one document: each of its texts stays once, from the row whose other columns come first as JSON;
    rows without an id all stay.
    """
    kept = near_duplicates(docs, width=width, percent=percent).where("kept").select("doc_id").distinct()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    first = F.min_by(F.struct(*columns), F.to_json(F.struct(*rest)) if rest else F.lit(0))
    one = docs.join(kept, "doc_id", "left_semi").groupBy(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__text")).agg(first.alias("__row"))
    return one.select("__row.*").union(docs.where("doc_id IS NULL"))
