"""Secret scans with a trigram inverted index, in DataFrame functions only (operator 2).

Each rule is a regular expression.  From its parse tree the driver derives a Boolean query: a list of alternatives, each a set
of trigrams that every match holds (after lower-casing).  The index holds a posting (trigram, doc_id) for each trigram of the
rule set that a document's lower-cased text contains.  A document is a candidate of a rule if the postings of all trigrams of
one alternative hold it; candidates are verified with the rule itself on the whole text.  Rules without a mandatory trigram
(a run of hexadecimal digits) scan every text.

Positions come from the pieces that a split leaves between the matches: a match starts after the lengths of all pieces and
matches before it.  Java's and RE2's leftmost matches agree on these rules.

Edge cases: a null text is an empty one; repeated rows and null ids give one row each (an id is only a key of the index, and
verification is on the row's own text); an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: Literal strings that an alternation may stand for before the derivation takes what it has.
MAX_STRINGS = 16


@dataclass(frozen=True)
class Rule:
    """``group`` of a match must have ``least`` characters, or the match is dropped; the group ``lead`` at its start is no part of the span.
    Base rules are those of the contract."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1
    base: bool = False
    lead: int = 0


RULES = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
                   r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),  # runs of 24+ characters are the long ones of all maximal runs
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),  # one class: a repeated group would recurse in Java
    # From the start of a run only: a run of many ``eyJ`` is read once.
    Rule("web_token", r"(^|[^A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", lead=1),
)


def trigram_query(regex: str) -> list[frozenset[str]] | None:
    """Alternatives of trigrams, one of which every match holds in full after lower-casing; None: no trigram is mandatory."""
    def join(found: list[set], text: set[str]) -> list[set]:
        """The alternatives of ``found``, each with the trigrams of one string of ``text``."""
        grams = [{t[i:i + 3] for i in range(len(t) - 2)} for t in text]
        if not all(grams):
            return found
        return [f | g for f in found for g in grams]

    def walk(items, found: list[set], open_: set[str]) -> tuple[list[set], set[str]]:
        """``open_``: the literal strings that end at this place."""
        for kind, value in items:
            options: set[str] | None = None
            if kind is sre.LITERAL:
                options = {chr(value).lower()}
            elif kind is sre.IN and value[0][0] is not sre.NEGATE and all(k in (sre.LITERAL, sre.RANGE) for k, _ in value):
                options = set()
                for k, v in value:
                    options |= {chr(c).lower() for c in (range(v[0], min(v[1], v[0] + MAX_STRINGS) + 1) if k is sre.RANGE else (v,))}
            elif kind is sre.MAX_REPEAT and value[:2] == (0, 1) and (inner := exact(value[2])) is not None:
                options = {""} | inner
            elif kind is sre.SUBPATTERN:
                options = exact(value[3])
            elif kind is sre.BRANCH:
                options = exact([(kind, value)])
            if options is not None and len(options) * len(open_) <= MAX_STRINGS:
                open_ = {a + b for a in open_ for b in options}
                continue
            found, open_ = join(found, open_), {""}
            if kind is sre.MAX_REPEAT and value[0] >= 1 or kind is sre.SUBPATTERN:
                found, open_ = walk(value[-1], found, {""})
                found, open_ = join(found, open_), {""}
        return found, open_

    def exact(items) -> set[str] | None:
        """All strings that the items stand for, lower-cased, if they are few."""
        out = {""}
        for kind, value in items:
            if kind is sre.BRANCH:
                parts = [exact(x) for x in value[1]]
                options = None if None in parts else set().union(*parts)
            else:
                found, options = walk([(kind, value)], [set()], {""})
                if found != [set()] or options == {""}:
                    options = None
            if options is None or len(options) * len(out) > MAX_STRINGS:
                return None
            out = {a + b for a in out for b in options}
        return out

    found, open_ = walk(list(parser.parse(regex)), [set()], {""})
    alternatives = {frozenset(x) for x in join(found, open_)}
    return None if frozenset() in alternatives else sorted(alternatives, key=sorted)


def postings(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The inverted index: (trigram, doc_id) for the trigrams that the rules' queries name."""
    grams = sorted({g for r in rules for alternative in trigram_query(r.regex) or [] for g in alternative})
    low = F.lower(F.coalesce("text", F.lit("")))
    # The scan that feeds the index reads each text once; ``contains`` is a plain byte search.
    held = F.filter(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]), lambda g: g.isNotNull())
    return docs.select("doc_id", low.alias("low")).select("doc_id", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(doc_id, kinds): the rules of which a document holds all trigrams of one alternative."""
    spark = index.sparkSession
    wanted = [(g, r.kind, k, len(alternative)) for r in rules for k, alternative in enumerate(trigram_query(r.regex) or []) for g in alternative]
    named = spark.createDataFrame(wanted, "trigram string, kind string, alternative int, needed int")
    met = (index.join(F.broadcast(named), "trigram")  # a fixed number of rows: the rules' trigrams
           .groupBy("doc_id", "kind", "alternative", "needed").agg(F.count_distinct("trigram").alias("n")).where("n = needed"))
    return met.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


#: Items of an array that one running sum copies, and code points of a piece of text.
RUN, PIECE = 256, 4096


def _running(items: Column, value: Callable[[Column], Column], merge: Callable[[Column, Column], Column]) -> Column:
    """array<struct<item, before>>: each item with the fold of ``value`` over the items before it (0 at first).

    An array that grows item by item is copied each time, so the fold runs over blocks of ``RUN`` items and over the blocks.
    ``items`` is a column, not an expression: the blocks are cut from it one by one.
    """
    zero, nothing = F.lit(0), F.expr("CAST(array() AS array<int>)")
    n = F.size(items)
    blocks = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / RUN).cast("int")), lambda b: F.slice(items, b * RUN + 1, F.lit(RUN))))
    totals = F.transform(blocks, lambda block: F.aggregate(block, zero, lambda s, x: merge(s, value(x)).cast("int")))
    starts = F.aggregate(totals, F.struct(zero.alias("at"), nothing.alias("out")), lambda s, t: F.struct(
        merge(s["at"], t).cast("int").alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))["out"]
    befores = F.zip_with(blocks, starts, lambda block, first: F.aggregate(block, F.struct(first.alias("at"), nothing.alias("out")), lambda s, x: F.struct(
        merge(s["at"], value(x)).cast("int").alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))["out"])
    return F.zip_with(items, F.coalesce(F.flatten(befores), nothing), lambda x, at: F.struct(x.alias("item"), at.alias("before")))


def _matches(rule: Rule, text: Column) -> Column:
    """array<struct<w, c, l, g>> of the rule's matches in a whole text: lengths of the match, of its checked group, of its lead and of the text before it."""
    regex = F.lit(rule.regex)
    whole = F.regexp_extract_all(text, regex, F.lit(0))
    checked = whole if rule.group == 0 else F.regexp_extract_all(text, regex, F.lit(rule.group))
    sizes = F.zip_with(whole, checked, lambda w, c: F.struct(F.length(w).alias("w"), F.length(c).alias("c"), F.lit(0).alias("l")))
    if rule.lead:
        sizes = F.zip_with(sizes, F.regexp_extract_all(text, regex, F.lit(rule.lead)), lambda m, x: F.struct(m["w"].alias("w"), m["c"].alias("c"), F.length(x).alias("l")))
    # One more piece than matches: the last pair has no match and goes.
    lengths = F.zip_with(sizes, F.transform(F.split(text, rule.regex, -1), lambda g: F.length(g)),
                         lambda m, g: F.struct(m["w"].alias("w"), m["c"].alias("c"), m["l"].alias("l"), g.alias("g")))
    return F.filter(lengths, lambda m: m["w"].isNotNull())


def _spans(rule: Rule, order: int, matches: Column) -> Column:
    """array<struct<start, kind, end>> of a rule's matches, a column: a match starts after all pieces and matches before it."""
    placed = F.filter(_running(matches, lambda m: m["g"] + m["w"], lambda a, b: a + b), lambda p: p["item"]["c"] >= rule.least)
    return F.transform(placed, lambda p: F.struct(
        (p["before"] + p["item"]["g"] + p["item"]["l"]).cast("int").alias("start"), F.lit(order).alias("kind"),
        (p["before"] + p["item"]["g"] + p["item"]["w"]).cast("int").alias("end")))


def _cut(pieces: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` to ``end`` of a text that is given in pieces of ``PIECE``."""
    first, last = F.floor(start / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int")
    head = F.substring(F.get(pieces, first), start - first * PIECE + 1, F.lit(PIECE))
    inner = F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    tail = F.substring(F.get(pieces, last), F.lit(1), end - last * PIECE)
    same = F.substring(F.get(pieces, first), start - first * PIECE + 1, end - start)
    return F.when(end <= start, F.lit("")).when(first == last, same).otherwise(F.concat(head, inner, tail))


def _scanned(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(row, text, found): the input's row, its text and its spans.  The row crosses one shuffle, to meet its candidates."""
    chosen = candidates(postings(docs.select("doc_id", "text"), rules), rules)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.join(chosen, F.col("row.doc_id").eqNullSafe(chosen["doc_id"]), "left")
    rows = rows.select("row", F.coalesce("row.text", F.lit("")).alias("text"), "kinds")
    none = F.expr("CAST(array() AS array<struct<w:int,c:int,l:int,g:int>>)")
    # The matches are columns of their own, worked out once: a lambda would work an expression out again for each item.
    held, spans = [], []
    for order, rule in enumerate(rules):
        asked = F.array_contains("kinds", rule.kind) if trigram_query(rule.regex) else F.col("text").rlike(rule.regex)
        held.append(F.when(F.coalesce(asked, F.lit(False)), _matches(rule, F.col("text"))).otherwise(none).alias(f"matches_{order}"))
        spans.append(_spans(rule, order, F.col(f"matches_{order}")))
    return rows.select("row", "text", *held).select("row", "text", F.array_sort(F.flatten(F.array(*spans))).alias("found"))


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Every row's doc_id with ``found``: array<struct<start, kind, end>> by start, then rule order.

    Kinds are positions in ``rules``.
    """
    return _scanned(docs.select("doc_id", "text"), rules).select("row.doc_id", "found")


def listed(found: Column, rules: Sequence[Rule] = RULES) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def digests(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id, the count of each base kind, base_sha256 and spans."""
    base = [k for k, r in enumerate(rules) if r.base]
    rows = scan(docs, rules)
    is_base = F.filter("found", lambda s: reduce(lambda a, k: a | (s["kind"] == k), base, F.lit(False)))

    def count(kind: int) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{rules[k].kind}") for k in base]
    return rows.select("doc_id", *counts, F.sha2(listed(is_base, rules), 256).alias("base_sha256"), listed(F.col("found"), rules).alias("spans"))


def redacted(docs: DataFrame, rules: Sequence[Rule] = RULES, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every span of every text replaced (overlapping ones once); other columns and null texts stay."""
    rows = _scanned(docs, rules).select(
        "row", "text", "found", F.when(F.size("found") > 0, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).alias("pieces"))
    # A span that starts before the end of an earlier one adds nothing; of the others, the text up to the span and the mask are joined.
    reach = _running(F.col("found"), lambda m: m["end"], lambda a, b: F.greatest(a, b))
    parts = F.transform(F.filter(reach, lambda p: (p["before"] == 0) | (p["item"]["start"] >= p["before"])),
                        lambda p: F.concat(_cut(F.col("pieces"), p["before"], p["item"]["start"]), F.lit(mask)))
    rest = _cut(F.col("pieces"), F.array_max(F.transform("found", lambda m: m["end"])), F.length("text"))
    text = F.when(F.size("found") == 0, F.col("row.text")).otherwise(F.concat(F.array_join(parts, ""), rest))
    return rows.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
