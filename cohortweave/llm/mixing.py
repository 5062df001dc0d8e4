"""Mixing sources to target weights (operator 8).

Documents are aggregated by membership pattern (the set of sources that a document belongs to).  A min-cost flow carries
words from patterns to source quotas; each further repetition of a pattern costs more, so repeats are spread evenly and used
only where a quota needs them.  A pattern's flow is then laid over its documents in seeded order: document positions are
prefix sums of sizes in hash order, and the documents whose middle falls into a source's interval are taken for it, once in
each repetition.  Only one row for each pattern and source reaches the driver; prefix sums use three levels of hash ranges,
so that no window holds more than 256 rows or a 65,536th of a source.  No document reaches the driver.

Edge cases: a null or empty text has size 0 and is never taken; a null source is a source of its own, last in order;
repeated rows, and other texts of an id or of none, are separate documents at other places of the order; an empty table gives an
empty table; further columns of the input are dropped.
"""

from __future__ import annotations

import heapq
from collections.abc import Container, Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortweave.llm.common import staged

MAX_REPEATS = 3
LARGE = 200
#: Facts of patterns and sources up to this size are broadcast.
BROADCAST_BYTES = 8 << 20
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: Sequence[float], weights: Sequence[float], cap: float = MAX_REPEATS) -> list[float]:
    """Shares of the total by weight; a target stops at ``cap`` times its size and the rest is shared again.

    Sources reach their cap in the order of ``cap * size / weight``, so one pass in that order settles all of them.
    """
    left, active = float(sum(sizes)), sorted((i for i, s in enumerate(sizes) if s > 0), key=lambda i: cap * sizes[i] / weights[i])
    weight, out = sum(weights[i] for i in active), [0.0] * len(sizes)
    for at, i in enumerate(active):
        if left * weights[i] / weight <= cap * sizes[i]:
            for k in active[at:]:
                out[k] = left * weights[k] / weight
            break
        out[i] = float(cap * sizes[i])
        left, weight = left - out[i], weight - weights[i]
    return out


def min_cost_flow(arcs: list[tuple[int, int, int, int]], n: int, source: int, sink: int) -> list[int]:
    """Flow on each arc (tail, head, capacity, cost >= 0) of a largest flow of least cost: successive shortest paths."""
    graph: list[list[int]] = [[] for _ in range(n)]
    to, room, cost = [], [], []
    for u, v, capacity, price in arcs:
        for a, b, c, p in ((u, v, capacity, price), (v, u, 0, -price)):
            graph[a].append(len(to))
            to.append(b)
            room.append(c)
            cost.append(p)
    potential = [0] * n
    while True:
        far = [float("inf")] * n
        far[source], via, queue = 0, [-1] * n, [(0, source)]
        while queue:
            d, u = heapq.heappop(queue)
            if d > far[u]:
                continue
            for e in graph[u]:
                nd = d + cost[e] + potential[u] - potential[to[e]]
                if room[e] > 0 and nd < far[to[e]]:
                    far[to[e]], via[to[e]] = nd, e
                    heapq.heappush(queue, (nd, to[e]))
        if far[sink] == float("inf"):
            break
        potential = [p + (d if d < float("inf") else 0) for p, d in zip(potential, far, strict=True)]
        path, v = [], sink
        while v != source:
            path.append(via[v])
            v = to[via[v] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push
    return [room[2 * i + 1] for i in range(len(arcs))]


def linked_patterns(patterns: Iterable[tuple], sources: Container) -> list[list[tuple]]:
    """Patterns in groups that share no source: each group's flow is a problem of its own."""
    above: dict = {}

    def top(x):
        while above.setdefault(x, x) != x:
            above[x] = x = above[above[x]]
        return x

    groups: dict = {}
    for key in patterns:
        own = [s for s in key if s in sources]
        for s in own[1:]:
            above[top(s)] = top(own[0])
    for key in patterns:
        own = next((s for s in key if s in sources), key)
        groups.setdefault(top(own) if own is not key else (key,), []).append(key)
    return list(groups.values())


def route(patterns: dict[tuple, int], quotas: dict, repeats: int = MAX_REPEATS) -> dict[tuple, dict]:
    """Words of each membership pattern for each source: a pattern's k-th repetition costs k, a quota is never exceeded.

    The work is that of the flows of groups of overlapping patterns, however many such groups there are.
    """
    out: dict[tuple, dict] = {key: {} for key in patterns}
    for keys in linked_patterns(patterns, quotas):
        sources = list(dict.fromkeys(s for key in keys for s in key if s in quotas))
        place = {s: 1 + len(keys) + j for j, s in enumerate(sources)}
        end, arcs, between = 1 + len(keys) + len(sources), [], []
        for i, key in enumerate(keys):
            arcs += [(0, 1 + i, patterns[key], k) for k in range(repeats)]
        for i, key in enumerate(keys):
            for s in dict.fromkeys(s for s in key if s in place):
                between.append((key, s, len(arcs)))
                arcs.append((1 + i, place[s], repeats * patterns[key], 0))
        arcs += [(place[s], end, int(quotas[s]), 0) for s in sources]
        flow = min_cost_flow(arcs, end + 1, 0, end)
        for key, s, at in between:
            if flow[at]:
                out[key][s] = flow[at]
    return out


def fill(amounts: dict, items: list[tuple], repeats: int) -> tuple[dict, list[list]]:
    """Words left of each amount, and the sources that each (size, ...) item's repetitions go to: first fit in order."""
    left, plans = dict(amounts), [[] for _ in items]
    for _ in range(repeats):
        for item, plan in zip(items, plans, strict=True):
            source = max(left, key=lambda s: left[s], default=None)
            if left and item[0] <= left[source]:
                left[source] -= item[0]
                plan.append(source)
    return left, plans


def cuts_of(flows: list[tuple], used: dict) -> tuple[list[float], list[float]]:
    """Low and high ends of the sources' intervals of a pattern, without the words that its large documents gave."""
    low, high, at = [], [], 0
    for s, words in flows:
        low.append(float(at))
        at += words - used.get(s, 0)
        high.append(float(at))
    return low, high


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``h``, in place of ``same``: equal for the first of equal (same, key, size), a hash of its own for each further one.

    Rows are counted within the task that reads them and start after those of the tasks before, so that equal rows never
    meet in one task, and which hashes they take does not depend on the partitioning.
    """
    equal = ["same", "key", "size"]
    at = F.row_number().over(Window.partitionBy("part", *equal).orderBy("size"))
    within = staged(rows.withColumn("part", F.spark_partition_id()).withColumn("at", at))
    sizes = within.groupBy(*equal, "part").agg(F.max("at").cast("long").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*equal).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    later = sizes.select(*equal, "part", before.alias("before")).where("before IS NOT NULL")
    nth = F.coalesce("before", F.lit(0)) + F.col("at")
    return staged(within.join(later, [*equal, "part"], "left").withColumn("h", F.when(nth == 1, F.col("same")).otherwise(F.xxhash64("same", nth)))
                  .drop("same", "part", "at", "before"))


def _small(table: DataFrame, size: int) -> DataFrame:
    """``table``, broadcast if its ``size`` in bytes is known to be small; larger ones are joined by their key."""
    return F.broadcast(table) if size <= BROADCAST_BYTES else table


def allocate(docs: DataFrame, targets: dict, *, seed: int = 7, repeats: int = MAX_REPEATS) -> DataFrame:
    """``docs`` (doc_id, size, pattern array<string>) with ``plan``: array<struct<source, times>>.

    ``targets`` gives the words wanted of each source.  A document's order key is a hash of (seed, doc_id, content), where
    ``content`` is a column that may be absent, and of its number among equal rows: reruns and other partitionings agree.  Further
    columns of ``docs`` stay.  Documents above a ``LARGE``-th of their pattern (fewer than ``LARGE`` of each pattern) would make the
    cut coarse: they get their share of the flow by first fit in a task per pattern, and what they leave goes to the others.
    """
    spark = docs.sparkSession
    names = docs.columns
    order = [F.col(c) for c in ("doc_id", "content") if c in names]
    hashed = numbered(docs.select(*names, F.xxhash64(F.lit(seed), *order).alias("same"), F.to_json(F.struct("pattern")).alias("key")))
    totals = {r["key"]: (tuple(r["pattern"]), r["s"]) for r in
              hashed.groupBy("key").agg(F.first("pattern").alias("pattern"), F.sum("size").alias("s")).collect()}
    flows = route({k: s for k, s in totals.values()}, {s: round(t) for s, t in targets.items()}, repeats)
    rows, held = [], 0
    for name, (pattern, size) in totals.items():
        parts = sorted(flows[pattern].items(), key=lambda x: (x[0] is None, x[0]))
        rows.append((name, size, [s for s, _ in parts], [w for _, w in parts], *cuts_of(parts, {})))
        held += 2 * len(name) + 100 * (1 + len(parts))
    facts = spark.createDataFrame(rows, "key string, whole long, sources array<string>, words array<long>, low array<double>, high array<double>")
    marked = hashed.join(_small(facts.select("key", "whole"), held), "key").withColumn("is_large", F.col("size") * LARGE > F.col("whole"))

    def first_fit(x: pd.DataFrame) -> pd.DataFrame:
        """A row (h, size, sources, times) for each large document of one pattern, and one of the cuts for its other documents."""
        x = x.sort_values(["h", "size"])
        name, size, parts = x["key"].iloc[0], int(x["whole"].iloc[0]), [(s, int(w)) for s, w in zip(x["sources"].iloc[0], x["words"].iloc[0], strict=True)]
        items = [(int(n), int(h)) for n, h in zip(x["size"], x["h"], strict=True)]
        own = sum(n for n, _ in items)
        share = {s: round(w * own / size) for s, w in parts}
        left, plans = fill(share, items, repeats)
        out = [(name, False, h, n, [s for s, _ in parts if s in plan], [plan.count(s) for s, _ in parts if s in plan], [], [], 0)
               for (n, h), plan in zip(items, plans, strict=True)]
        out.append((name, True, 0, 0, [], [], *cuts_of(parts, {s: share[s] - left[s] for s in share}), own))
        return pd.DataFrame(out, columns=["key", "is_cut", "h", "size", "names", "times", "low", "high", "own"])

    large = marked.where("is_large")
    fitted = staged(large.select("key", "h", "size", "whole").join(_small(facts.select("key", "sources", "words"), held), "key").groupBy("key")
                    .applyInPandas(first_fit, "key string, is_cut boolean, h long, size long, names array<string>, times array<long>, "
                                              "low array<double>, high array<double>, own long"))
    kept = fitted.where("is_cut").select("key", F.col("low").alias("l"), F.col("high").alias("g"), "own")
    cuts = facts.join(kept, "key", "left").select(
        "key", "sources", F.coalesce("l", "low").alias("low"), F.coalesce("g", "high").alias("high"),
        (F.col("whole") - F.coalesce("own", F.lit(0))).cast("double").alias("total"))
    small = (marked.where("NOT is_large").drop("whole")
             .withColumn("hi", F.pmod(F.shiftrightunsigned("h", 56), F.lit(256)).cast("int"))
             .withColumn("mid", F.pmod(F.shiftrightunsigned("h", 48), F.lit(256)).cast("int")))
    middle = small.groupBy("key", "hi", "mid").agg(F.sum("size").alias("s"))
    high = middle.groupBy("key", "hi").agg(F.sum("s").alias("s"))

    def before(part: list[str], *order: str):
        return Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)

    high = high.select("key", "hi", F.coalesce(F.sum("s").over(before(["key"], "hi")), F.lit(0)).alias("from_hi"))
    middle = middle.select("key", "hi", "mid", F.coalesce(F.sum("s").over(before(["key", "hi"], "mid")), F.lit(0)).alias("from_mid"))
    starts = middle.join(high, ["key", "hi"])
    placed = (small.withColumn("own", F.coalesce(F.sum("size").over(before(["key", "hi", "mid"], "h", "doc_id", "size")), F.lit(0)))
              .join(starts, ["key", "hi", "mid"]).join(_small(cuts, held), "key"))
    point = F.col("from_hi") + F.col("from_mid") + F.col("own") + F.col("size") / 2

    def times(c):
        """How many of the positions point + k * total lie in [low, high)."""
        return sum(((point + F.lit(k) * F.col("total") >= c["low"]) & (point + F.lit(k) * F.col("total") < c["high"])).cast("long")
                   for k in range(repeats))

    def plan(source: str, counts: Column) -> Column:
        pairs = F.zip_with(source, counts, lambda s, n: F.struct(s.alias("source"), n.alias("times")))
        return F.filter(pairs, lambda c: (c["times"] > 0) & (F.col("size") > 0)).alias("plan")

    counts = F.zip_with("low", "high", lambda low, high: times({"low": low, "high": high}))
    placed = placed.select(*names, plan("sources", counts))
    picks = fitted.where("NOT is_cut").select("key", "h", "size", F.col("names").alias("__names"), F.col("times").alias("__times"))
    picked = large.join(picks, ["key", "h", "size"]).select(*names, plan("__names", F.col("__times")))
    return placed.unionByName(picked)


def sized(docs: DataFrame, *further: str) -> DataFrame:
    """(doc_id, size, source, content) and ``further`` columns: the number of words and a hash of every whole text."""
    return docs.select("doc_id", *further, F.xxhash64("text").alias("content"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), "source")


def mix(docs: DataFrame, *, weights: Sequence[float] = (5, 2, 1), seed: int = 7, repeats: int = MAX_REPEATS) -> DataFrame:
    """doc_id, size, source_size, target, taken for documents of one source each.

    Sources in code point order, null last, take the weights in turn and share all words of the table.
    """
    base = staged(sized(docs))
    placed, facts = _planned(base, weights, seed, repeats)
    out = placed.select("doc_id", "size", F.col("pattern")[0].alias("source"), (_repetitions() * F.col("size")).alias("taken"))
    return (out.join(facts, out["source"].eqNullSafe(facts["source"]))
            .select("doc_id", "size", "source_size", "target", "taken"))


def mixed(docs: DataFrame, *, weights: Sequence[float] = (5, 2, 1), seed: int = 7, repeats: int = MAX_REPEATS) -> DataFrame:
    """The documents that the mix takes, each as many times as it is taken, with all their columns.

    Every row has its own count, rows that repeat an id and rows without one included: rows are numbered as they are written.
    """
    rows = staged(docs.withColumn("__row", F.monotonically_increasing_id()))
    placed, _ = _planned(staged(sized(rows, "__row")), weights, seed, repeats)
    rows = rows.join(placed.select("__row", _repetitions().alias("__times")).where("__times > 0"), "__row")
    names = [F.col(f"`{c}`") for c in docs.columns]
    return rows.select(*names, F.explode(F.array_repeat(F.lit(0), F.col("__times").cast("int"))).alias("__k")).drop("__k")


def _repetitions():
    return F.aggregate("plan", F.lit(0).cast("long"), lambda a, c: a + c["times"])


def _planned(base: DataFrame, weights: Sequence[float], seed: int, repeats: int) -> tuple[DataFrame, DataFrame]:
    """The plan of every row of ``sized``, and (source, source_size, target)."""
    spark = base.sparkSession
    # Spark orders strings by their bytes, which for UTF-8 is code point order.
    totals = [(r["source"], r["s"]) for r in
              base.groupBy("source").agg(F.sum("size").alias("s")).orderBy(F.col("source").asc_nulls_last()).collect()]
    wanted = source_targets([s for _, s in totals], [weights[i % len(weights)] for i in range(len(totals))], repeats)
    targets = {name: t for (name, _), t in zip(totals, wanted, strict=True)}
    placed = allocate(base.withColumn("pattern", F.array("source")).drop("source"), targets, seed=seed, repeats=repeats)
    facts = spark.createDataFrame([(n, s, t) for (n, s), t in zip(totals, wanted, strict=True)], "source string, source_size long, target double")
    return placed, _small(facts, sum(2 * len(n or "") + 50 for n, _ in totals))
