"""License scans, whitening and conversation repair against brute force, and on odd and empty tables."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def table(spark, name, folder=SMALL):
    return spark.read.parquet(f"{folder}/{name}.parquet")


# 11, licenses

PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, label) for label, phrase in PHRASES.items() for p in [phrase.split()] for i in range(len(words)) if words[i:i + len(p)] == p]
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places})))


def base_rows(spark_rows):
    return sorted(((str(r["doc_id"]), r["n_words"], r["n_base"], str(r["first_word"]), str(r["last_word"]), r["base_labels"]) for r in spark_rows))


def want_base(rows):
    return sorted((str(r["doc_id"]), n, b, str(f), str(s), labels) for r in rows for n, b, f, s, labels in [brute_base(r["text"])])


@pytest.mark.parametrize("which", ["given", "odd", "none"])
def test_license_phrases(llm, odd_docs, no_docs, which):
    from cohortweave.llm import licenses

    docs = {"given": table(llm, "documents", "/root/testdata/sf0.01"), "odd": odd_docs, "none": no_docs}[which]
    assert base_rows(licenses.scan(docs).collect()) == want_base(docs.collect())


def test_license_phrases_in_long_and_repeated_texts(llm):
    from cohortweave.llm import licenses

    texts = ["Under the MIT\x01License; cc-by-nc", "under the mit licensee", "cc by", "CC BY NC " * 30_000, "x" * 3_000_000 + " under the MIT license",
             "é" * 700_000 + " cc by nc " + "word " * 500_000 + "Apache License, Version 2.0", "under the mit license under the mit license", "café cc by nc"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(6, texts[6])] * 500 + [(None, texts[0])]
    docs = llm.createDataFrame(rows, "doc_id long, text string")
    assert base_rows(licenses.scan(docs).collect()) == want_base(docs.collect())


def test_license_spans(llm):
    from cohortweave.llm import licenses
    from cohortweave.llm.license_texts import TEMPLATES

    mit, bsd = TEMPLATES[0][1], TEMPLATES[4][1]
    words = mit.split()
    moved = " ".join(words[:40] + ["really"] + words[40:90] + words[92:])  # a word put in, two left out
    rows = [(1, "intro words here " + mit), (2, moved), (3, " ".join(words[:60])), (4, mit + " and also " + bsd), (5, " ".join(reversed(words))),
            (6, "nothing of the kind")]
    docs = llm.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert [got[i]["labels"] for i in range(1, 7)] == ["mit", "mit", "", "bsd-3,mit", "", ""]
    assert got[1]["score"] == 1.0 and 0.8 <= got[2]["score"] < 1 and got[3]["score"] == 0
    key = F.unhex(F.sha2("text", 256))
    span = licenses.spans(docs).join(docs.where("doc_id = 2").select(key.alias("key")), "key").where("NOT phrase").first()
    assert (span["start"], span["end"]) == (0, len(re.findall(r"[a-z0-9]+", moved.lower())))


# 12, whitening

def brute_white(x, keep=32):
    n = len(x)
    centred = x - x.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:keep], axes[:, ::-1][:, :keep]
    deviation = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, x.sum(axis=0))) for row in x.astype(np.int64)]
    return centred @ axes / np.sqrt(values), values / np.trace(centred.T @ centred / n), deviation


def as_integers(vectors):
    return np.floor(64 * np.array(vectors, dtype=np.float32).astype(np.float64)) + 1_000_000


def test_whitening(llm):
    from cohortweave.llm import whiten

    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(700, 12)) @ rng.normal(size=(12, 12)) * np.linspace(0.3, 3, 12)
    df = llm.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got = whiten.whitened(df).toPandas().sort_values(["vec_id", "component"])
    white, share, deviation = brute_white(as_integers(vectors))
    have = got["whitened"].to_numpy().reshape(700, 12)
    assert np.abs(have * np.sign((have * white).sum(axis=0)) - white).max() < 1e-8
    assert np.abs(got["explained"].to_numpy()[:12] / share - 1).max() < 1e-9 and got["identity_error"].max() < 1e-10 and (got["n"] == 700).all()
    assert got["deviation"].to_numpy()[::12].tolist() == deviation


def test_whitening_equal_eigenvalues_and_low_rank(llm):
    from cohortweave.llm import whiten

    square = [(i, [float(a), float(b), 0.0, float(a)]) for i, (a, b) in enumerate(itertools.product((-1, 1), repeat=2))] * 3
    got = whiten.whitened(llm.createDataFrame(square, "vec_id long, embedding array<double>")).toPandas()
    share = got.drop_duplicates("component").sort_values("component")["explained"].to_numpy()
    assert np.allclose(share, [2 / 3, 1 / 3, 0, 0]) and got["identity_error"].max() < 1e-9 and len(got) == 48
    assert (got[got["component"] > 2]["whitened"] == 0).all()


def test_whitening_odd_rows(llm):
    from cohortweave.llm import whiten

    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [0.0, 2.0], 1), (2, [0.0, 2.0], 1), (None, [3.0, 1.0], 1), (3, None, 1), (4, [], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1),
            (7, [None, 1.0], 1), (8, [5.0], 1), (9, [1e300, 1.0], 1)]
    df = llm.createDataFrame(rows, "vec_id long, embedding array<double>, n long")
    got = whiten.whitened(df).toPandas()
    pairs = got[got["n"] == 4]
    assert len(pairs) == 8 and sorted(pairs["vec_id"].dropna().astype(int)) == [1, 1, 2, 2, 2, 2] and pairs["identity_error"].max() < 1e-9
    alone = got[got["n"] == 1]
    assert alone["vec_id"].tolist() == [8] and alone["whitened"].tolist() == [0] and alone["deviation"].tolist() == [0]
    assert len(got) == 9 and whiten.whitened(df.where("vec_id > 99")).count() == 0


# 13, conversations

def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub(r"[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def brute_repair(rows):
    """All least-cost edits by a walk over (row, initials' state), as whole strings."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
    faults, seen = [], set()
    for _, _, role, text in rows:
        shown = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "" if shown[-1] in ".!?" else "truncated"
        seen.add((role, text))
        faults.append(fault)
    turns = [r[1] for r in rows if r[1] is not None]
    initials = [r[2][:1] for r in rows]
    goes = {("start", "s"): "s", ("start", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {}

    def ways(i, state):
        if i == len(rows):
            return [(0, "", [])] if state in ("start", "a") else []
        return best[i, state]

    def closed(i, found):
        for state in ("start", "s", "u", "a"):
            todo = list(found.get(state, []))
            one = [(s, r) for s in ("u", "a") if (to := goes.get((state, s))) for r in [to]]
            for s, to in one:
                role = "user" if s == "u" else "assistant"
                todo += [(c + 3, "I" + w, [(role, "")] + t) for c, w, t in found.get(to, [])]
                for s2 in ("u", "a"):
                    if (to2 := goes.get((to, s2))):
                        role2 = "user" if s2 == "u" else "assistant"
                        todo += [(c + 6, "II" + w, [(role, ""), (role2, "")] + t) for c, w, t in found.get(to2, [])]
            best[i, state] = [min(todo, key=lambda x: (x[0], x[1]))] if todo else []

    closed(len(rows), {s: [(0, "", [])] if s in ("start", "a") else [] for s in ("start", "s", "u", "a")})
    for i in range(len(rows) - 1, -1, -1):
        _, _, role, text = rows[i]
        found = {}
        for state in ("start", "s", "u", "a"):
            todo = [(c + 4, "D" + w, t) for c, w, t in best[i + 1, state]]
            if faults[i] not in ("blank", "duplicate"):
                more = 3 if faults[i] == "truncated" else 0
                if (to := goes.get((state, initials[i]))):
                    todo += [(c + more, "K" + w, [(role, text)] + t) for c, w, t in best[i + 1, to]]
                for s, new in (("u", "user"), ("a", "assistant")):
                    if (to := goes.get((state, s))):
                        todo += [(c + 3 + more, "R" + w, [(new, text)] + t) for c, w, t in best[i + 1, to]]
            found[state] = todo
        closed(i, found)
    cost, audit, out = best[0, "start"][0]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


SCHEMA = "conv_id long, turn long, role string, text string"


def brute_query(rows):
    groups = {r[0]: [] for r in rows}
    for r in brute_damage(rows):
        groups[r[0]].append(r)
    return {k: brute_repair(v) for k, v in groups.items()}


def found(df):
    rows = df.collect()
    out = {r["conv_id"]: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_conversations_given(llm):
    from cohortweave.llm import conversations

    df = table(llm, "conversations", "/root/testdata/sf0.01")
    assert found(conversations.repair_damaged(df)) == brute_query([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_conversations_odd(llm):
    from cohortweave.llm import conversations

    rng = np.random.default_rng(8)
    roles, texts = ["system", "user", "assistant", "tool", "", "sys", None, "User"], ["Hello.", "cut off", "", " \n", None, "What?", "a. b", "Well\x0c!", "é"]
    rows = [(int(c), None if rng.random() < 0.1 else int(t), roles[rng.integers(8) if rng.random() < 0.4 else 1 + t % 2], texts[rng.integers(9) if rng.random() < 0.5 else 0] if rng.random() < 0.7 else f"row {t}.")
            for c in range(150) for t in range(rng.integers(1, 12))]
    rows += [(None, t, roles[1 + t % 2], f"text {t}") for t in range(30)] + [(900, 1, "user", "Same.")] * 700 + [(901, None, None, None), (902, 5, "user", "")]
    df = llm.createDataFrame([(*r, 1, "K", "x") for r in rows], SCHEMA + ", cost long, audit string, fault string")
    assert found(conversations.repair_damaged(df)) == brute_query(rows)
    assert conversations.repair_damaged(df.where("conv_id > 9999")).count() == 0


def test_conversation_over_many_partitions(llm):
    """One conversation holds most rows; its pieces meet at turns that repeat."""
    from cohortweave.llm import conversations

    rng = np.random.default_rng(4)
    roles = ["user", "assistant", "system", "tool"]
    hot = [(7, t // 2, roles[int(rng.choice(4, p=[0.5, 0.4, 0.05, 0.05]))], f"t {t % 900}" + ".?"[t % 2] * (t % 3 > 0)) for t in range(6000)]
    runs = [(8, t, "user" if t < 2500 else "assistant", f"said {t}.") for t in range(4000)]
    rows = hot + runs + [(c, t, roles[t % 2], "fine.") for c in (1, 2, 30, 40) for t in range(4)]
    df = llm.createDataFrame(rows, SCHEMA).repartition(6)
    before = llm.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    llm.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(conversations.repair_damaged(df)) == brute_query(rows)
    finally:
        llm.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_repaired_rows(llm):
    from cohortweave.llm import conversations

    rows = [(1, 0, "system", "Be brief."), (1, 1, "user", "Hi."), (1, 2, "user", "Again?"), (1, 3, "assistant", "Yes."), (2, 0, "assistant", " ")]
    df = llm.createDataFrame(rows, SCHEMA)
    audits = conversations.audits(df)
    assert {r["conv_id"]: (r["cost"], r["audit"]) for r in audits.collect()} == {1: (3, "KKIKK"), 2: (4, "D")}
    out = conversations.repaired(df, audits).orderBy("conv_id", "position").collect()
    assert [(r["role"], r["text"], r["edit"]) for r in out] == [("system", "Be brief.", "K"), ("user", "Hi.", "K"), ("assistant", "", "I"), ("user", "Again?", "K"), ("assistant", "Yes.", "K")]


def test_run_powers():
    """A run advanced by binary powers costs what its rows cost one by one, and unrolls to the same letters."""
    from cohortweave.llm.conversations import AT_END, MUST_DELETE, advance, power, run_costs, solve

    for symbol in [*range(8), MUST_DELETE]:
        for length in (1, 2, 7, 33, 100, 257):
            costs = AT_END
            for _ in range(length):
                costs = advance(power(symbol, 0), costs)
            assert run_costs(symbol, length, AT_END) == costs
            assert solve([(symbol, length)]) == solve([(symbol, 1)] * length)
    cost, audit = solve([(1, 1_000_000)])
    assert cost == 1_500_000 and len(audit) == 1_000_000  # every second user row becomes the assistant's
