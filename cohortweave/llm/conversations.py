"""Conversation structure repair by a run-length dynamic program.

Rows of a conversation stand in order of turn (null first), then role, then the text's digest.  A row's symbol is its role's initial
(s, u, a, other) with its first fault: blank or duplicate (both must be deleted), truncated, or none.  A conversation is right when its
initials read ``(s?(ua)+)?``: an automaton of four states (start, after s, after u, after a).  A row's edit moves between states at a cost, so a row
is a 4 x 4 min-plus matrix, inserts before it included.  Equal consecutive symbols are one run; a run of length L is advanced through
cached binary powers of its matrix.  Costs to the end are carried backwards over the runs, and the choices are then unrolled forwards, each time the
ASCII-least letter that keeps the least cost (D < I < K < R; the role of I and R follows from the state, so a letter fixes the next state and
greedy choice gives the least string).  Long runs unroll in halves of cached pieces.

On Spark, without texts: rows are reduced to (conversation, turn, role, digest) with a count, so repeats cost one row; the first place of
each (conversation, role, text) is one aggregate, joined back on the whole key, which no hot conversation skews.  The symbols are range
partitioned by (conversation, order), which cuts a long conversation over many tasks.  A conversation that lies inside one partition is solved there.
Of those at a partition's edge only pieces leave the task: the piece's matrix meets the other pieces of the conversation (at most one
for each partition) to give the cost at its end; then each piece is unrolled from all four states in parallel, and the parts that fit are
joined.  Texts are shuffled once, by conversation, to be read beside the audit as a sorted stream in bounded memory; a SHA-256 over a
conversation is sequential by definition, and so is its stream.

Odd cases: a null conv_id is a conversation of its own; null turns come first and are no turn in ``gaps``; null roles and texts are one space (as in
the key of the damage), so such a text is blank and such a role, like an empty one, has no initial of the pattern; rows of equal turn stand by role
and digest; equal rows are duplicates of the first.  An empty table gives an empty result.  Further columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cohortweave.llm.common import staged

INF = 1 << 60
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
NEXT_ROLE = (1, 1, 2, 1)  # by state: the role that R and I give, as 1 user, 2 assistant
ROLES = {1: "user", 2: "assistant"}
#: Symbols: role initial 0 s, 1 u, 2 a, 3 other, plus 4 when truncated; 8 must be deleted.
MUST_DELETE = 8
#: Runs up to this length are unrolled row by row.
SHORT = 32
_WHITE = " \t\n\x0b\x0c\r"


# The program: costs, runs and choices

def _kept_state(state: int, symbol: int) -> int | None:
    """The state after a row is kept, or None where the pattern forbids it."""
    initial = symbol & 3
    if initial == 0:
        return 1 if state == 0 else None
    if initial == 1:
        return None if state == 2 else 2
    return 3 if initial == 2 and state == 2 else None


def _moves(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits that use up a row."""
    moves = [("D", DELETE, state)]
    if symbol != MUST_DELETE:
        extra = TRUNCATED if symbol & 4 else 0
        if (kept := _kept_state(state, symbol)) is not None:
            moves.append(("K", KEEP + extra, kept))
        moves.append(("R", REROLE + extra, NEXT_ROLE[state] + 1))
    return moves


def _after_insert(state: int) -> int:
    return NEXT_ROLE[state] + 1


Matrix = tuple[tuple[int, ...], ...]
Costs = tuple[int, ...]


def times(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus product."""
    return tuple(tuple(min(min(x + y for x, y in zip(row, column)), INF) for column in zip(*b)) for row in a)


def advance(a: Matrix, costs: Costs) -> Costs:
    return tuple(min(min(x + y for x, y in zip(row, costs)), INF) for row in a)


def _inserts() -> Matrix:
    """Least cost of inserts alone between states."""
    step = tuple(tuple(0 if i == j else INSERT if j == _after_insert(i) else INF for j in range(4)) for i in range(4))
    return functools.reduce(times, [step] * 4)


@functools.lru_cache(maxsize=None)
def power(symbol: int, k: int) -> Matrix:
    """The matrix of a run of 2**k rows of a symbol, inserts before each row included."""
    if k:
        return times(power(symbol, k - 1), power(symbol, k - 1))
    row = [[INF] * 4 for _ in range(4)]
    for state in range(4):
        for _, cost, to in _moves(symbol, state):
            row[state][to] = min(row[state][to], cost)
    return times(_inserts(), tuple(map(tuple, row)))


IDENTITY: Matrix = tuple(tuple(0 if i == j else INF for j in range(4)) for i in range(4))
#: Costs behind the last row: the pattern may end at the start or after an assistant; inserts may still follow.
AT_END: Costs = advance(_inserts(), (0, INF, INF, 0))


@functools.lru_cache(maxsize=1 << 16)
def _run_shifted(symbol: int, length: int, costs: Costs) -> Costs:
    k = 0
    while length:
        if length & 1:
            costs = advance(power(symbol, k), costs)
        length, k = length >> 1, k + 1
    return costs


def run_costs(symbol: int, length: int, costs: Costs) -> Costs:
    """Costs before a run, from those behind it."""
    least = min(costs)
    shifted = _run_shifted(symbol, length, tuple(c - least if c < INF else INF for c in costs))
    return tuple(c + least if c < INF else INF for c in shifted)


def run_matrix(symbol: int, length: int) -> Matrix:
    out, k = IDENTITY, 0
    while length:
        if length & 1:
            out = times(out, power(symbol, k))
        length, k = length >> 1, k + 1
    return out


@functools.lru_cache(maxsize=1 << 16)
def _unrolled(symbol: int, length: int, behind: Costs, state: int) -> tuple[str, int]:
    """(letters, state after) of a run, given the costs behind it less their least."""
    if length > SHORT:
        second = 1 << ((length - 1).bit_length() - 1)
        first, state = unroll(symbol, length - second, run_costs(symbol, second, behind), state)
        rest, state = _unrolled(symbol, second, behind, state)
        return first + rest, state
    costs = [behind]
    for _ in range(length):
        costs.append(advance(power(symbol, 0), costs[-1]))
    letters = []
    for left in range(length, 0, -1):
        while True:
            here, after = costs[left], costs[left - 1]
            best = min(((letter, to) for letter, cost, to in _moves(symbol, state) if cost + after[to] == here[state]), default=("Z", 0))
            to = _after_insert(state)
            if INSERT + here[to] == here[state] and "I" < best[0]:
                letters.append("I")
                state = to
                continue
            letters.append(best[0])
            state = best[1]
            break
    return "".join(letters), state


def unroll(symbol: int, length: int, behind: Costs, state: int) -> tuple[str, int]:
    least = min(behind)
    return _unrolled(symbol, length, tuple(c - least if c < INF else INF for c in behind), state)


def unroll_end(state: int) -> str:
    """Inserts behind the last row."""
    out = ""
    while AT_END[state]:
        out, state = out + "I", _after_insert(state)
    return out


Runs = list[tuple[int, int]]


def costs_behind(runs: Runs, end: Costs) -> list[Costs]:
    """Costs behind each run, and before the first one as last item."""
    out = [end]
    for symbol, length in reversed(runs):
        out.append(run_costs(symbol, length, out[-1]))
    return out


def unroll_runs(runs: Runs, end: Costs, state: int) -> tuple[str, int]:
    behind = costs_behind(runs, end)
    parts = []
    for i, (symbol, length) in enumerate(runs):
        letters, state = unroll(symbol, length, behind[len(runs) - 1 - i], state)
        parts.append(letters)
    return "".join(parts), state


def solve(runs: Runs) -> tuple[int, str]:
    """(least cost, ASCII-least audit) of a whole conversation."""
    letters, state = unroll_runs(runs, AT_END, 0)
    return costs_behind(runs, AT_END)[-1][0], letters + unroll_end(state)


# Rows and faults on Spark

def _spaced(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that crc32 of ``conv_id:turn`` decides; rows that it repeats stand twice."""
    kind = F.crc32(F.concat(_spaced("conv_id"), F.lit(":"), _spaced("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", r"[.!?]", "")).otherwise(F.col("text"))
    return (rows.select("conv_id", "turn", _spaced("role").alias("role"), _spaced("text").alias("text"), kind.alias("kind")).where("kind <> 0")
            .select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                    F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
            .drop("copy"))


_ORDER = ["known", "conv", "turned", "at", "role", "digest"]


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows with key columns that hold no null: known/conv for the conversation, turned/at for the turn, role, digest."""
    return rows.select(F.col("conv_id").isNotNull().alias("known"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"),
                       F.col("turn").isNotNull().alias("turned"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("at"),
                       _spaced("role").alias("role"), _spaced("text").alias("text"),
                       F.unhex(F.sha2(_spaced("text"), 256)).alias("digest"))


def symbols(rows: DataFrame) -> DataFrame:
    """One row for each distinct (conversation, turn, role, text): its key, initial, first fault and number of copies."""
    last = F.right(F.rtrim("text", F.lit(_WHITE)), F.lit(1))
    fault = F.when(last == "", "blank").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    plain = _ordered(rows).select(*_ORDER, fault.alias("fault"))
    once = plain.groupBy(*_ORDER, "fault").agg(F.count(F.lit(1)).alias("copies"))
    firsts = (once.where("fault <> 'blank'").groupBy("known", "conv", "role", "digest").agg(F.min(F.struct("turned", "at")).alias("first"))
              .select("known", "conv", F.col("first.turned").alias("turned"), F.col("first.at").alias("at"), "role", "digest", F.lit(True).alias("is_first")))
    return staged(once.join(firsts, _ORDER, "left").withColumn("is_first", F.coalesce("is_first", F.lit(False))))


_STATS = "gaps_distinct long, turn_min long, turn_max long, blank long, duplicate long, truncated long, illegal long, rows long"
_STAT_NAMES = [part.split()[0] for part in _STATS.split(", ")]
_PIECE = f"known boolean, conv long, whole boolean, part long, {_STATS}, cost long, audit string, symbol array<int>, length array<long>, " \
         "matrix array<long>, initials array<string>, turns array<long>, turned array<boolean>"
_PIECE_NAMES = [part.split()[0] for part in _PIECE.split(", ")]
_LEGAL = {"su", "ua", "au"}
_CODE = {"s": 0, "u": 1, "a": 2}


class _Piece:
    """Rows of one conversation in one partition, taken in batch by batch as runs."""

    def __init__(self, known: bool, conv: int):
        self.known, self.conv = known, conv
        self.runs: list[list[int]] = []
        self.stats = dict.fromkeys(_STAT_NAMES, 0)
        self.first = self.last = self.first_turn = self.last_turn = None
        self.low = self.high = None

    def add(self, turned: bool, at: int, role: str, fault: str, first: bool, copies: int) -> None:
        s, initial = self.stats, role[:1]
        turn = at if turned else None
        if turned:
            if self.low is None or turn != self.high:
                s["gaps_distinct"] += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        if self.first is None:
            self.first, self.first_turn = initial, turn
        elif self.last + initial not in _LEGAL:
            s["illegal"] += 1
        self.last, self.last_turn = initial, turn
        if copies > 1:  # equal roles side by side
            s["illegal"] += copies - 1
        s["rows"] += copies
        symbol = _CODE.get(initial, 3)
        if fault == "blank":
            s["blank"] += copies
            self.put(MUST_DELETE, copies)
            return
        kept = 1 if first else 0
        s["duplicate"] += copies - kept
        if kept:
            s["truncated"] += fault == "truncated"
            self.put(symbol + 4 if fault == "truncated" else symbol, 1)
        if copies > kept:
            self.put(MUST_DELETE, copies - kept)

    def put(self, symbol: int, count: int) -> None:
        if self.runs and self.runs[-1][0] == symbol:
            self.runs[-1][1] += count
        else:
            self.runs.append([symbol, count])

    def row(self, whole: bool, part: int) -> tuple:
        stats = {**self.stats, "turn_min": self.low, "turn_max": self.high}
        values = [self.known, self.conv, whole, part, *(stats[name] for name in _STAT_NAMES)]
        runs = [tuple(r) for r in self.runs]
        if whole:
            return (*values, *solve(runs), None, None, None, None, None, None)
        matrix = functools.reduce(times, (run_matrix(*r) for r in runs), IDENTITY)
        return (*values, None, None, [r[0] for r in runs], [r[1] for r in runs], [c for line in matrix for c in line],
                [self.first, self.last], [self.first_turn or 0, self.last_turn or 0], [self.first_turn is not None, self.last_turn is not None])


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows of a range partition: solved conversations, and the first and last one as pieces, since they may go on elsewhere."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    out, now, first = [], None, True
    for batch in batches:
        for known, conv, turned, at, role, fault, is_first, copies in zip(*(batch[c].tolist() for c in (
                "known", "conv", "turned", "at", "role", "fault", "is_first", "copies"))):
            if now is None or now.conv != conv or now.known != known:
                if now is not None:
                    out.append(now.row(not first, part))
                    first = False
                now = _Piece(known, conv)
            now.add(turned, at, role, fault, is_first, copies)
        if len(out) > 2000:
            yield pd.DataFrame(out, columns=_PIECE_NAMES, dtype=object)
            out = []
    if now is not None:
        out.append(now.row(False, part))
        yield pd.DataFrame(out, columns=_PIECE_NAMES, dtype=object)


def _border_costs(group: pd.DataFrame) -> pd.DataFrame:
    """Costs behind each piece of a conversation, from the pieces' matrices."""
    group = group.sort_values("part")
    costs, out = AT_END, []
    for known, conv, part, flat in zip(group["known"][::-1], group["conv"][::-1], group["part"][::-1], group["matrix"][::-1]):
        out.append((known, conv, part, list(costs)))
        flat = [int(c) for c in flat]
        costs = advance(tuple(tuple(flat[4 * i:4 * i + 4]) for i in range(4)), costs)
    return pd.DataFrame(out, columns=["known", "conv", "part", "behind"])


def _unrolled_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The letters and the last state of each piece, from each of the four states."""
    for batch in batches:
        for i in range(len(batch)):
            line = batch.iloc[i:i + 1]
            runs = list(zip(map(int, line["symbol"].iat[0]), map(int, line["length"].iat[0])))
            behind = tuple(int(c) for c in line["behind"].iat[0])
            found = [unroll_runs(runs, behind, state) for state in range(4)]
            yield line.drop(columns=["symbol", "length"]).assign(letters=[[f[0] for f in found]], after=[[f[1] for f in found]])


def _joined_pieces(group: pd.DataFrame) -> pd.DataFrame:
    """The pieces of one conversation as one row."""
    group = group.sort_values("part")
    total = {name: int(group[name].sum()) for name in _STAT_NAMES if not name.startswith("turn_")}
    state, letters, before = 0, [], None
    for line in group.to_dict("records"):
        if before is not None:
            total["illegal"] += before["initials"][1] + line["initials"][0] not in _LEGAL
            same = before["turned"][1] and line["turned"][0] and before["turns"][1] == line["turns"][0]
            total["gaps_distinct"] -= bool(same)
        letters.append(line["letters"][state])
        state, before = int(line["after"][state]), line
    first = group.iloc[0]
    flat = [int(c) for c in first["matrix"]]
    cost = advance(tuple(tuple(flat[4 * i:4 * i + 4]) for i in range(4)), tuple(int(c) for c in first["behind"]))[0]
    low, high = group["turn_min"].min(), group["turn_max"].max()
    return pd.DataFrame([{"known": first["known"], "conv": first["conv"], **total, "turn_min": low, "turn_max": high, "cost": cost,
                          "audit": "".join(letters) + unroll_end(state)}])


_SOLVED = f"known boolean, conv long, {_STATS}, cost long, audit string"


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation that has rows."""
    sorted_rows = symbols(rows).repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
    pieces = staged(sorted_rows.mapInPandas(_pieces, _PIECE))
    edge = pieces.where("NOT whole")
    behind = edge.select("known", "conv", "part", "matrix").groupBy("known", "conv").applyInPandas(_border_costs, "known boolean, conv long, part long, behind array<long>")
    parts = edge.drop("whole", "cost", "audit").join(behind, ["known", "conv", "part"])
    kept = ", ".join(p for p in _PIECE.split(", ") if p.split()[0] not in ("whole", "cost", "audit", "symbol", "length"))
    parts = parts.mapInPandas(_unrolled_pieces, f"{kept}, behind array<long>, letters array<string>, after array<int>")
    joined = parts.groupBy("known", "conv").applyInPandas(_joined_pieces, _SOLVED)
    names = [part.split()[0] for part in _SOLVED.split(", ")]
    solved = pieces.where("whole").select(*names).unionByName(joined.select(*names))
    gaps = F.coalesce(F.col("turn_max") - F.col("turn_min") + 1 - F.col("gaps_distinct"), F.lit(0)).alias("gaps")
    return solved.select(F.when(F.col("known"), F.col("conv")).alias("conv_id"), gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _repaired_stream(batches: Iterator[pd.DataFrame], begin: Callable, row: Callable, end: Callable) -> Iterator[pd.DataFrame]:
    """Walk sorted rows; a conversation's first row carries its audit, whose letters say what becomes of the rows behind it."""
    audit, place, state, open_ = "", 0, 0, False

    def inserted() -> None:
        nonlocal place, state
        while place < len(audit) and audit[place] == "I":
            row(ROLES[NEXT_ROLE[state]], "", "I")
            place, state = place + 1, _after_insert(state)

    for batch in batches:
        for known, conv, letters, role, text in zip(*(batch[c].tolist() for c in ("known", "conv", "audit", "role", "text"))):
            if letters is not None:
                if open_:
                    inserted()
                    end()
                audit, place, state, open_ = letters, 0, 0, True
                begin(conv if known else None)
                continue
            inserted()
            letter = audit[place]
            place += 1
            if letter == "K":
                state = _kept_state(state, _CODE[role[:1]])
                row(role, text, "K")
            elif letter == "R":
                row(ROLES[NEXT_ROLE[state]], text, "R")
                state = _after_insert(state)
        yield None
    if open_:
        inserted()
        end()
    yield None


def _beside_audits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Texts and audits by conversation, sorted, the audit first; blank texts are left out (their rows stay)."""
    blank = F.rtrim("text", F.lit(_WHITE)) == ""
    texts = _ordered(rows).select(*_ORDER, F.when(~blank, F.col("text")).alias("text"), F.lit(None).cast("string").alias("audit"))
    heads = found.select(F.col("conv_id").isNotNull().alias("known"), F.coalesce("conv_id", F.lit(0)).alias("conv"), F.lit(False).alias("turned"),
                         F.lit(0).cast("long").alias("at"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("string").alias("text"), "audit")
    order = ["known", "conv", F.col("audit").isNull(), "turned", "at", "role", "digest"]
    return texts.unionByName(heads).repartition("known", "conv").sortWithinPartitions(*order).select("known", "conv", "audit", "role", "text")


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, position (from 0), role, text, edit (K, R or I): the rows of the repaired conversations; ``found`` is ``audits(rows)``."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, now = [], [None, 0]

        def begin(conv):
            now[:] = [conv, 0]

        def row(role, text, edit):
            out.append((now[0], now[1], role, text, edit))
            now[1] += 1
        for _ in _repaired_stream(batches, begin, row, lambda: None):
            frame = pd.DataFrame(out, columns=["conv_id", "position", "role", "text", "edit"])
            frame["conv_id"] = frame["conv_id"].astype("Int64")
            yield frame
            out.clear()

    return _beside_audits(rows, found).mapInPandas(work, "conv_id long, position long, role string, text string, edit string")


def repaired_digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: SHA-256 of the repaired ``role:text`` rows, joined by newlines."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, now = [], {}

        def begin(conv):
            now.update(conv=conv, hash=hashlib.sha256(), any=False)

        def row(role, text, edit):
            now["hash"].update(f"{chr(10) if now['any'] else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            now["any"] = True
        for _ in _repaired_stream(batches, begin, row, lambda: out.append((now["conv"], now["hash"].hexdigest()))):
            frame = pd.DataFrame(out, columns=["conv_id", "repaired_sha256"])
            frame["conv_id"] = frame["conv_id"].astype("Int64")
            yield frame
            out.clear()

    return _beside_audits(rows, found).mapInPandas(work, "conv_id long, repaired_sha256 string")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """The contract's digest: a row for every original conv_id after the damage, zeros where no row is left."""
    rows = damaged(conversations)
    found = staged(audits(rows))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id"))
    parts = ids.unionByName(found, allowMissingColumns=True).unionByName(repaired_digests(rows, found), allowMissingColumns=True)
    nothing = F.sha2(F.lit(""), 256)
    return (parts.groupBy("conv_id").agg(*(F.max(c).alias(c) for c in [*counts, "audit", "repaired_sha256"]))
            .select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("repaired_sha256", nothing).alias("repaired_sha256")))
