"""Thin registered queries over the operators, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortweave.llm.common import read_table, ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Register under the function's name; the modules are sent to the workers first."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)
    QUERIES[fn.__name__] = run
    return fn


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    from cohortweave.llm import language_id

    return language_id.predict(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


@query
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers

    from cohortweave.llm import bpe

    docs = read_table(spark, sf_dir, "documents")
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    from cohortweave.llm import mixing

    return mixing.mix(read_table(spark, sf_dir, "documents"))


@query
def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op8_mixing that SQL can express: doc_id, size, source_size, target."""
    return op8_mixing(spark, sf_dir).drop("taken")


# Sources reach three times their size in the order of size to weight; those that do keep it, the others share what is left.
SQL["mixing_targets"] = r"""
WITH d AS (SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY source),
w AS (SELECT source, n, row_number() OVER (ORDER BY source NULLS LAST) AS i, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight,
             CAST(sum(n) OVER () AS DOUBLE) AS total FROM s),
r AS (SELECT *, total - CAST(COALESCE(sum(3 * n) OVER (ORDER BY 3.0 * n / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS left_over,
             CAST(sum(weight) OVER (ORDER BY 3.0 * n / weight, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS weights
      FROM w WHERE n > 0),
c AS (SELECT *, left_over * weight / weights > 3 * n AS capped FROM r),
f AS (SELECT any_value(total) - CAST(COALESCE(sum(3 * n) FILTER (WHERE capped), 0) AS DOUBLE) AS left_over,
             CAST(sum(weight) FILTER (WHERE NOT capped) AS DOUBLE) AS weights FROM c),
t AS (SELECT source, n, CASE WHEN capped THEN CAST(3 * n AS DOUBLE) ELSE f.left_over * weight / f.weights END AS target FROM c, f)
SELECT d.doc_id, d.size, s.n AS source_size, COALESCE(t.target, 0.0) AS target
FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source LEFT JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""


@query
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    from cohortweave.llm import secret_scan

    return secret_scan.digests(read_table(spark, sf_dir, "documents"))


@query
def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    from cohortweave.llm import minhash

    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), width=2)


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    from cohortweave.llm import toxicity

    return toxicity.predict(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    from cohortweave.llm import quality

    return quality.predict(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query
def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    from cohortweave.llm import embed_dedup

    return embed_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


@query
def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score."""
    from pyspark.sql import functions as F

    from cohortweave.llm import topk

    return topk.search(read_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


@query
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars."""
    from cohortweave.llm import html_extract

    pages = read_table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.fit(pages))


@query
def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    from cohortweave.llm import licenses

    return licenses.scan(read_table(spark, sf_dir, "documents"))


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error."""
    from cohortweave.llm import whiten

    return whiten.whitened(read_table(spark, sf_dir, "embeddings"))


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    from cohortweave.llm import conversations

    return conversations.repair_damaged(read_table(spark, sf_dir, "conversations"))


SQL["op5_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: floor(64 * c::DOUBLE)::BIGINT) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
part AS (SELECT vec_id, unnest(x) AS c, unnest(range(1, len(x) + 1)) AS d, len(x) AS dim FROM v),
score AS (SELECT q.vec_id AS query_id, p.vec_id, sum(q.c * p.c)::BIGINT AS score
          FROM part q JOIN part p ON q.d = p.d AND q.dim = p.dim AND q.vec_id <> p.vec_id
          WHERE q.vec_id % 20 = 0 GROUP BY 1, 2)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM score QUALIFY rank <= 20
"""


def _secret_sql() -> str:
    """Spans of every rule by splitting at its matches: a match starts after all pieces and matches before it."""
    from cohortweave.llm.secret_scan import RULES

    parts = []
    for k, rule in enumerate(RULES):
        regex = rule.regex.replace("'", "''")
        parts.append(f"""SELECT doc_id, {k} AS k, '{rule.kind}' AS kind, {rule.base} AS base, {rule.least} AS least,
            regexp_extract_all(t, '{regex}', 0) AS whole, regexp_extract_all(t, '{regex}', {rule.group}) AS checked,
            {f"regexp_extract_all(t, '{regex}', {rule.lead})" if rule.lead else "NULL::VARCHAR[]"} AS lead, string_split_regex(t, '{regex}') AS gaps FROM d""")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(parts)}),
e AS (SELECT doc_id, k, kind, base, least, whole, checked, lead, gaps, unnest(range(1, len(whole) + 1)) AS i FROM m),
s AS (SELECT doc_id, k, kind, base, length(whole[i]) - coalesce(length(lead[i]), 0) AS w, length(checked[i]) >= least AS good,
             (coalesce(length(lead[i]), 0) + list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda g: length(g))), 0))::BIGINT AS start
      FROM e),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(kind || ':' || start || ':' || (start + w), ',' ORDER BY start, k) FILTER (base) AS base,
             string_agg(kind || ':' || start || ':' || (start + w), ',' ORDER BY start, k) AS spans
      FROM s WHERE good GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""


SQL["op2_secret_scan"] = _secret_sql()


# Components: the least id reaches a group by paths of larger ids, so only such paths are followed.
_COMPONENTS = """
e AS (SELECT a AS x, b AS y FROM link UNION SELECT b, a FROM link),
reach AS (SELECT id, id AS root FROM node UNION SELECT e.y, reach.root FROM reach JOIN e ON e.x = reach.id WHERE reach.root < e.y),
least AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)
"""

SQL["op1_embedding_dedup"] = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
      AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id < b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.9),
node AS (SELECT vec_id AS id FROM embeddings), {_COMPONENTS},
n AS (SELECT x, count(*) AS n_links FROM e GROUP BY x)
SELECT id AS vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, id = component_id AS kept FROM least LEFT JOIN n ON id = x
"""

SQL["op10_minhash"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
      FROM w),
one AS (SELECT min(doc_id) AS rep, len(s) AS n, s FROM (SELECT doc_id, list_sort(s) AS s FROM s WHERE len(s) > 0) GROUP BY s),
g AS (SELECT rep, n, unnest(s) AS shingle FROM one),
near AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n + b.n) AS total, count(*) AS common FROM g a JOIN g b
         ON a.shingle = b.shingle AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2),
link AS (SELECT a, b FROM near WHERE 100 * common >= 80 * (total - common)
         UNION ALL SELECT rep, doc_id FROM s JOIN one ON list_sort(s.s) = one.s WHERE doc_id <> rep),
node AS (SELECT doc_id AS id FROM documents), {_COMPONENTS}
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN least ON doc_id = id
"""


def _license_sql() -> str:
    """Word groups joined by their words, votes by diagonal, neighbouring diagonals merged, spans kept by their share of the template."""
    from cohortweave.llm.licenses import COVER, GAP, K, SHIFT, VOTES, known

    def words(of: str) -> str:
        low = f"translate(coalesce({of}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        return f"list_filter(regexp_split_to_array({low}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

    def groups(of: str) -> str:
        run = " || ' ' || ".join(f"w[i + {j + 1}]" for j in range(K))
        return f"SELECT *, i AS p, {run} AS g FROM (SELECT *, unnest(range(0, len(w) - {K - 1})) AS i FROM {of})"

    rows = ", ".join("({}, '{}', {}, '{}')".format(i, label, phrase, text.replace("'", "''")) for i, (label, text, phrase) in enumerate(known()))
    return f"""
WITH known(template, label, phrase, said) AS (VALUES {rows}),
t AS (SELECT template, label, phrase, {words("said")} AS w FROM known),
size AS (SELECT template, label, phrase, len(w) - {K - 1} AS grams FROM t),
d AS (SELECT row_number() OVER () AS r, doc_id, {words("text")} AS w FROM documents),
tg AS (SELECT template, p, g FROM ({groups("t")})), dg AS (SELECT r, p, g FROM ({groups("d")})),
vote AS (SELECT r, template, dg.p - tg.p AS diagonal, dg.p AS pos, tg.p AS tpos FROM dg JOIN tg ON dg.g = tg.g),
dia AS (SELECT r, template, diagonal, count(*) AS votes, min(pos) AS s, max(pos) + {K} AS e, list(tpos) AS held FROM vote GROUP BY 1, 2, 3),
good AS (SELECT * FROM dia JOIN size USING (template) WHERE votes >= CASE WHEN phrase THEN grams ELSE least({VOTES}, grams) END),
prior AS (SELECT *, lag(diagonal) OVER w AS before, max(e) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
          FROM good WINDOW w AS (PARTITION BY r, template ORDER BY s, diagonal)),
mark AS (SELECT *, sum(CASE WHEN phrase OR before IS NULL OR abs(diagonal - before) > {SHIFT} OR s > reach + {GAP} THEN 1 ELSE 0 END)
                   OVER (PARTITION BY r, template ORDER BY s, diagonal) AS span FROM prior),
span AS (SELECT r, template, label, phrase, min(s) AS s, len(list_distinct(flatten(list(held)))) / any_value(grams) AS score FROM mark GROUP BY 1, 2, 3, 4, span),
fine AS (SELECT * FROM span WHERE score >= CASE WHEN phrase THEN 1.0 ELSE {COVER} END),
m AS (SELECT r, count(*) FILTER (phrase) AS n_base, min(s) FILTER (phrase) AS first_word, max(s) FILTER (phrase) AS last_word,
             array_to_string(list_sort(list(DISTINCT label) FILTER (phrase)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels,
             max(score) AS score FROM fine GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN m USING (r)
"""


SQL["op11_license_scan"] = _license_sql()


def _repair_sql() -> str:
    """Backwards over the rows: for each state the least of (cost, audit), as text that sorts alike, with the repaired rows behind chr(1)."""
    def then(value: str, cost: str, letter: str, line: str = "''") -> str:
        return (f"(lpad((left({value}, 12)::BIGINT + {cost})::VARCHAR, 12, '0') || '{letter}' || substr({value}, 13, instr({value}, chr(1)) - 12)"
                f" || {line} || substr({value}, instr({value}, chr(1)) + 1))")

    line = "chr(10) || {} || ':' || {}".format
    after = {0: 2, 1: 2, 2: 3, 3: 2}
    given = {0: "'user'", 1: "'user'", 2: "'assistant'", 3: "'user'"}
    kept = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    rows = []
    for s in range(4):
        ways = [then(f"v{s}", "4", "D")]
        ways += [f"CASE WHEN NOT gone AND initial = '{i}' THEN {then(f'v{to}', 'more', 'K', line('role', 'text'))} END" for i, to in kept[s].items()]
        ways.append(f"CASE WHEN NOT gone THEN {then(f'v{after[s]}', '3 + more', 'R', line(given[s], 'text'))} END")
        rows.append(f"least({', '.join(ways)}) AS b{s}")
    user, reply = line("'user'", "''"), line("'assistant'", "''")
    start = f"{then(then('b3', '3', 'I', reply), '3', 'I', user)}"
    closed = [f"least(b0, {then('b2', '3', 'I', user)}, {start}) AS v0", f"least(b1, {then('b2', '3', 'I', user)}, {start}) AS v1",
              f"least(b2, {then('b3', '3', 'I', reply)}) AS v2", f"least(b3, {then('b2', '3', 'I', user)}) AS v3"]
    blank = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8),
    lambda a, k: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END, n)) AS tab),
given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT),
    lambda a, c: xor(tab[(xor(a, c) & 255) + 1], a >> 8), 4294967295)) % 20 AS kind FROM conversations, crc),
left_rows AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM given WHERE kind <> 0),
ordered AS (SELECT *, dense_rank() OVER (ORDER BY conv_id) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
    left(role, 1) AS initial, right(rtrim(text, {blank}), 1) AS ending FROM left_rows),
faults AS (SELECT *, ending = '' AS blank, ending <> '' AND row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS duplicate,
    lag(initial) OVER (PARTITION BY c ORDER BY i) AS before FROM ordered),
marked AS (SELECT *, blank OR duplicate AS gone, NOT blank AND NOT duplicate AND ending NOT IN ('.', '!', '?') AS truncated,
    CASE WHEN NOT blank AND NOT duplicate AND ending NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS more FROM faults),
counts AS (SELECT c, any_value(conv_id) AS conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY c),
back AS (SELECT c, n AS i, '000000000000' || chr(1) AS v0, '000000000006II' || chr(1) || {user} || {reply} AS v1,
    '000000000003I' || chr(1) || {reply} AS v2, '000000000000' || chr(1) AS v3 FROM counts
    UNION ALL SELECT c, i, {', '.join(closed)} FROM (SELECT back.c, back.i - 1 AS i, {', '.join(rows)} FROM back JOIN marked ON marked.c = back.c AND marked.i = back.i)),
solved AS (SELECT c, left(v0, 12)::BIGINT AS cost, substr(v0, 13, instr(v0, chr(1)) - 13) AS audit, substr(v0, instr(v0, chr(1)) + 2) AS said FROM back WHERE i = 0),
whole AS (SELECT * FROM counts JOIN solved USING (c))
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
    coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
    sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN whole ON ids.conv_id IS NOT DISTINCT FROM whole.conv_id
"""


SQL["op13_conversation_repair"] = _repair_sql()
