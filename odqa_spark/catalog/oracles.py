"""The registered queries as DuckDB SQL.

Each string is written from the operator's rule, not from its Spark plan: plain
list filters instead of block summaries, pair joins instead of block products.
"""

from __future__ import annotations

import unicodedata

from odqa_spark.catalog.fixtures import UNANSWERED
from odqa_spark.catalog.queries import CLS, EMBEDDING_DIM, INDEX_START, PACK_LENGTH, PAD, SEP, SHORT_TEXT, TOP_K, WIDE
from odqa_spark.functions import prompts
from odqa_spark.functions.tokens import PIECE_PATTERN
from odqa_spark.operators.chunk import CHUNK_OVERLAP, CHUNK_SIZE, SEPARATORS
from odqa_spark.operators.models import HASH_DIM, MAX_ANSWER_WORDS, SENTENCE, WORD_BREAK
from odqa_spark.operators.profile import CHAR_EDGES, TOKEN_EDGES, bucket_labels

# The accented letters of the test data; RE2 and DuckDB have no NFD.
ACCENTED = "ÄÇÈÉÊÍÑÓÖÜäçèéêíñóöü"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def tokens(x: str) -> str:
    return f"regexp_extract_all({x}, {lit(PIECE_PATTERN)})"


def token_count(x: str) -> str:
    return f"CAST(len({tokens(x)}) AS BIGINT)"


def nfd(x: str) -> str:
    for c in ACCENTED:
        x = f"replace({x}, {lit(c)}, {lit(unicodedata.normalize('NFD', c))})"
    return x


def _plain(x: str) -> str:
    return f"regexp_replace(lower({x}), '[!-/:-@\\[-`{{-~]', '', 'g')"


def normalize(x: str) -> str:
    """RE2's word boundary knows ASCII letters only, so the one letter NFD leaves is spelled out meanwhile."""
    spelled = f"replace({_plain(nfd(x))}, 'ß', 'QsQ')"
    no_articles = f"replace(regexp_replace({spelled}, '\\b(a|an|the)\\b', ' ', 'g'), 'QsQ', 'ß')"
    return f"trim(regexp_replace({no_articles}, '\\s+', ' ', 'g'))"


def f1_tokens(x: str) -> str:
    return f"list_filter(string_split_regex({_plain(x)}, '\\s+'), lambda t: t NOT IN ('', 'a', 'an', 'the'))"


def sentences(x: str) -> str:
    found = f"regexp_extract_all({x}, {lit(SENTENCE)})"
    return f"list_filter(list_transform({found}, lambda s: trim(s)), lambda s: s <> '')"


def terms(x: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(lower({x}), {lit(WORD_BREAK)}), lambda w: w <> ''))"


def clean(x: str) -> str:
    chars = "[.()\"'',]"
    return f"regexp_replace({x}, '{chars}', '', 'g')"


def r6(x: str) -> str:
    return f"round({x}, 6)"


ARTICLES = "a AS (SELECT CAST(doc_id AS VARCHAR) AS id, source AS title, lang AS url, text FROM documents)"

PAIRS = """p AS (
  SELECT row_number() OVER (ORDER BY u.conv_id, u.turn) - 1 AS row_idx, u.text AS question, r.text AS reply,
         string_split(r.text, ' ') AS w
  FROM conversations u JOIN conversations r ON r.conv_id = u.conv_id AND r.turn = u.turn + 1
  WHERE u.role = 'user' AND r.role = 'assistant')"""

RUNS = f"""{PAIRS},
g AS (SELECT *, CASE row_idx % 5
      WHEN 0 THEN ['zzqx absent']
      WHEN 1 THEN [array_to_string(w[-2:], ' '), 'zzqx']
      ELSE [array_to_string(w[2:3], ' '), w[5]] END AS answer FROM p),
runs AS (
  SELECT row_idx, 'k10_r' || (row_idx % 2) AS config, question, answer, reply AS retrieved,
         array_to_string(w[1:len(w) // 2], ' ')
           || CASE WHEN row_idx % 15 = 0 THEN ' zzqx absent' ELSE '' END AS summary,
         CASE (row_idx // 2) % 4 WHEN 0 THEN answer[1] WHEN 1 THEN replace(upper(answer[1]), 'ẞ', 'SS') || '.'
           WHEN 2 THEN answer[1] || ',zz' ELSE 'nothing' END AS predicted
  FROM g)"""


def judged(runs: str = "runs") -> str:
    return f"""n AS (
  SELECT *, list_transform(answer, lambda x: {normalize('x')}) AS an, {normalize('predicted')} AS pn,
    list_transform(CASE WHEN contains(predicted, ',') THEN string_split(predicted, ',')
      WHEN contains(predicted, 'and') THEN string_split(predicted, 'and') ELSE [] END, lambda x: {normalize('x')}) AS parts,
    {normalize('retrieved')} AS rn, {normalize('summary')} AS sn
  FROM {runs}),
j AS (
  SELECT *,
    CASE WHEN list_contains(an, pn) THEN 1.0::DOUBLE
      WHEN len(parts) > 0 THEN len(list_filter(parts, lambda x: list_contains(an, x)))::DOUBLE / len(parts)
      ELSE 0.0::DOUBLE END AS em,
    coalesce(len(list_filter(an, lambda x: contains(rn, x))) > 0, false) AS had,
    coalesce(len(list_filter(an, lambda x: contains(sn, x))) > 0, false) AS kept
  FROM n)"""


def best_f1(answer: str, predicted: str) -> str:
    same = (
        "list_sum(list_transform(list_distinct(gt), lambda t: "
        "least(len(list_filter(gt, lambda x: x = t)), len(list_filter(pt, lambda x: x = t)))))"
    )
    return f"""(SELECT max(CASE WHEN {same} > 0 THEN 2.0::DOUBLE * {same} / (len(gt) + len(pt)) ELSE 0.0::DOUBLE END)
      FROM (SELECT {f1_tokens('ga')} AS gt, {f1_tokens(predicted)} AS pt
            FROM (SELECT unnest({answer}) AS ga)))"""


def metrics(where: str = "true") -> str:
    def pct(part: str, whole: str = "count(*)") -> str:
        return f"round(100.0::DOUBLE * {part} / nullif({whole}, 0), 6)"

    def cnt(test: str) -> str:
        return f"count(*) FILTER (WHERE {test})"

    s = "bool_or(coalesce(summary, '') <> '')"

    def if_s(x: str) -> str:
        return f"CASE WHEN {s} THEN {x} END"

    return f"""SELECT config, count(*) AS rows, {s} AS summarized,
  {pct('sum(em)')} AS exact_match, {pct('sum(f1)')} AS f1,
  round(sum(pt) / count(*)::DOUBLE, 6) AS psgs_tokens, {if_s('round(sum(st) / count(*)::DOUBLE, 6)')} AS summary_tokens,
  {if_s(pct(cnt('NOT had AND kept')))} AS sum_tn, {if_s(pct(cnt('had AND NOT kept')))} AS sum_fn,
  {if_s(pct(cnt('had AND kept'), cnt('had')))} AS sum_rc,
  {pct(cnt('had'))} AS ret_em, {if_s(pct(cnt('kept')))} AS sum_em,
  CASE WHEN {s} THEN {pct(cnt('kept AND em = 0'))} ELSE {pct(cnt('had AND em = 0'))} END AS read_fp,
  CASE WHEN {s} THEN {pct(cnt('NOT kept AND em <> 0'))} ELSE {pct(cnt('NOT had AND em <> 0'))} END AS read_tn
FROM (SELECT *, {best_f1('answer', 'predicted')} AS f1, {token_count('retrieved')} AS pt, {token_count('summary')} AS st
      FROM j WHERE {where}) GROUP BY config"""


def histogram(length: str, edges: list[int]) -> str:
    labels = bucket_labels(edges)
    lows = ["-1", *map(str, edges)]
    highs = [*map(str, edges), "NULL"]
    rows = ", ".join(
        f"({i}, {lit(label)}, {lo}, {hi})" for i, (label, lo, hi) in enumerate(zip(labels, lows, highs))
    )
    return f"""WITH b(bucket_no, bucket, lo, hi) AS (VALUES {rows}),
d AS (SELECT {length} AS n FROM documents)
SELECT CAST(bucket_no AS INTEGER) AS bucket_no, bucket, count(d.n) AS n,
  100.0::DOUBLE * count(d.n) / (SELECT count(*) FROM d) AS pct
FROM b LEFT JOIN d ON d.n > b.lo AND (b.hi IS NULL OR d.n <= b.hi) GROUP BY bucket_no, bucket"""


DOC_TOKENS = token_count("source || chr(10) || text")

TOKEN_CHUNKS = f"""WITH {ARTICLES},
k AS (SELECT id, title, url, {tokens("array_to_string(list_filter(string_split(title || chr(10) || text, ' '), lambda w: length(w) < 1000), ' ')")} AS tok FROM a),
n AS (SELECT *, len(tok) AS n, (len(tok) - 1) // 256 AS m,
        list_filter(range(len(tok)), lambda q: starts_with(tok[q + 1], ' ')) AS b FROM k WHERE len(tok) > 0),
c AS (SELECT *, unnest(range(m + 1)) AS i FROM n),
s AS (SELECT *,
    CASE WHEN i < m AND starts_with(tok[i * 256 + 1], ' ') THEN i * 256
      WHEN i < m THEN coalesce(list_max(list_filter(b, lambda q: q < i * 256)), 0)
      WHEN n <= 256 OR starts_with(tok[1], ' ') THEN greatest(n - 256, 0)
      ELSE coalesce(list_max(list_filter(b, lambda q: q < n - 256)), 0) END AS st,
    CASE WHEN i < m THEN coalesce(list_min(list_filter(b, lambda q: q >= (i + 1) * 256)), n) ELSE n END AS en
  FROM c)
SELECT id || '_' || i AS id, title, url, array_to_string(tok[st + 1:en], '') AS text FROM s"""


def sentence_groups(shuffled: bool) -> str:
    order = "md5(md5(text) || ':' || (i - 1))" if shuffled else "i"
    return f"""WITH d AS (SELECT doc_id, text, {sentences('text')} AS s FROM documents),
u AS (SELECT doc_id, text, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM d),
o AS (SELECT doc_id, list(x ORDER BY {order}, i) AS s FROM u GROUP BY doc_id),
e AS (SELECT d.doc_id, coalesce(o.s, []) AS s FROM d LEFT JOIN o USING (doc_id)),
f AS (SELECT doc_id, s, unnest(range(len(s) // 3 + 1)) AS j FROM e)
SELECT doc_id, CAST(j AS INTEGER) AS group_no,
  coalesce(array_to_string(CASE WHEN j < len(s) // 3 THEN s[j * 3 + 1:j * 3 + 3]
    ELSE s[greatest(len(s) - 3, 0) + 1:] END, chr(10)), '') AS text FROM f"""


def hashed(name: str, source: str, key: str, text: str) -> str:
    """Hashed bag-of-words vectors of ``text`` as list ``v`` per ``key``."""
    return f"""{name}_w AS (SELECT {key} AS k, unnest(list_filter(string_split(replace(lower({text}), chr(10), ' '), ' '), lambda w: w <> '')) AS w FROM {source}),
{name}_h AS (SELECT k, ('0x' || substr(md5(w), 1, 4))::INTEGER % {HASH_DIM} AS d,
    sum(1 - 2 * (('0x' || substr(md5(w), 5, 1))::INTEGER % 2)) AS c FROM {name}_w GROUP BY ALL),
{name}_g AS (SELECT k, r.d, coalesce(h.c, 0)::DOUBLE AS c
    FROM (SELECT DISTINCT {key} AS k FROM {source}) CROSS JOIN (SELECT unnest(range({HASH_DIM})) AS d) r
    LEFT JOIN {name}_h h USING (k, d)),
{name}_n AS (SELECT k, greatest(sqrt(sum(c * c)), 1e-12) AS z FROM {name}_g GROUP BY k),
{name} AS (SELECT k, list(c / z ORDER BY d) AS v FROM {name}_g JOIN {name}_n USING (k) GROUP BY k)"""


DOC_VECTORS = hashed("dv", "documents", "doc_id", "source || chr(10) || text")


def searched(questions: str, key: str, text: str, k: int) -> str:
    return f"""{DOC_VECTORS}, {hashed('qv', questions, key, text)},
top AS (SELECT qv.k AS q_id, dv.k AS p_id,
    row_number() OVER (PARTITION BY qv.k ORDER BY list_dot_product(qv.v, dv.v) DESC, dv.k) AS rank FROM qv, dv
    QUALIFY rank <= {k}),
ctx AS (SELECT q_id, string_agg(text, chr(10) ORDER BY rank) AS retrieved
    FROM top JOIN documents ON doc_id = p_id GROUP BY q_id)"""


def condensed(source: str, key: str, question: str, text: str, name: str = "condensed") -> str:
    return f"""{name}_t AS (SELECT {key} AS k, {terms(question)} AS qt, {sentences(text)} AS s FROM {source}),
{name}_s AS (SELECT k, qt, len(s) AS n, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM {name}_t),
{name}_r AS (SELECT k, n, x, i,
    row_number() OVER (PARTITION BY k ORDER BY len(list_intersect({terms('x')}, qt)) DESC, i) AS r FROM {name}_s),
{name} AS (SELECT {name}_t.k, coalesce(c.summary, '') AS summary FROM {name}_t LEFT JOIN (
    SELECT k, string_agg(x, ' ' ORDER BY i) AS summary FROM {name}_r WHERE r <= ceil(n / 3.0) GROUP BY k) c USING (k))"""


def read(source: str, key: str, question: str, context: str, name: str = "readings") -> str:
    """``k, score, raw, ctx``: the default reader on every row of ``source``; no row if nothing can be read."""
    return f"""{name}_t AS (SELECT {key} AS k, {context} AS ctx, {terms(question)} AS qt, {sentences(context)} AS s FROM {source}),
{name}_s AS (SELECT k, qt, ctx, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM {name}_t),
{name}_b AS (SELECT k, ctx, qt, len(list_intersect({terms('x')}, qt))::DOUBLE / greatest(len(qt), 1) AS score, string_split(x, ' ') AS w FROM {name}_s
    QUALIFY row_number() OVER (PARTITION BY k ORDER BY len(list_intersect({terms('x')}, qt)) DESC, i) = 1),
{name}_w AS (SELECT *, array_to_string(w[j + 1:j + {MAX_ANSWER_WORDS}], ' ') AS raw
    FROM (SELECT *, unnest(range(greatest(len(w) - {MAX_ANSWER_WORDS}, 0) + 1)) AS j FROM {name}_b)),
{name} AS (SELECT k, ctx, score, raw FROM {name}_w
    QUALIFY row_number() OVER (PARTITION BY k ORDER BY len(list_intersect({terms('raw')}, qt)) DESC, j) = 1)"""


VEC = "embedding::DOUBLE[]"
PHI = f"(SELECT max(list_dot_product({VEC}, {VEC})) FROM embeddings)"


def knn(columns: str = "q_id, p_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank") -> str:
    return f"""WITH s AS (SELECT q.vec_id AS q_id, p.vec_id AS p_id, list_dot_product(q.{VEC}, p.{VEC}) AS score
  FROM embeddings q, embeddings p),
t AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, p_id) AS rank FROM s QUALIFY rank <= {TOP_K})
SELECT {columns} FROM t"""


KNN_L2 = f"""WITH v AS (SELECT vec_id, {VEC} AS v FROM embeddings),
a AS (SELECT vec_id, v, list_concat(v, [sqrt(greatest({PHI} - list_dot_product(v, v), 0))]) AS x FROM v),
s AS (SELECT q.vec_id AS q_id, p.vec_id AS p_id, list_distance(list_concat(q.v, [0.0::DOUBLE]), p.x) AS l2,
        list_dot_product(q.v, p.v) AS ip FROM a q, a p),
t AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY l2, p_id) AS rank FROM s QUALIFY rank <= {TOP_K})
SELECT q_id, p_id, round(l2, 6) AS l2, round(ip, 6) AS ip, CAST(rank AS INTEGER) AS rank FROM t"""

L2_NORMALIZED = f"""WITH d AS (SELECT vec_id, unnest({VEC}) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
z AS (SELECT vec_id, greatest(sqrt(sum((x * i) * (x * i))), 1e-12) AS z FROM d GROUP BY vec_id)
SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, round(x * i / z, 6) AS x FROM d JOIN z USING (vec_id)"""

MASKED_MEAN = f"""WITH d AS (SELECT vec_id, unnest({VEC}) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
SELECT vec_id, CAST(i % 8 AS INTEGER) AS pos, round(sum(x) / count(*), 6) AS x
FROM d WHERE (vec_id + i // 8) % 4 <> 0 GROUP BY vec_id, i % 8"""

BEST_SPANS = f"""WITH e AS (SELECT vec_id, label, {VEC} AS v FROM embeddings),
t AS (SELECT vec_id, label, unnest(range(32)) AS i, v[1:32] AS s, v[33:64] AS e FROM e),
c AS (SELECT vec_id, label, s, i, unnest(range(i, least(i + 8, 32))) AS j, e FROM t),
r AS (SELECT *, s[i + 1] + e[j + 1] AS score,
        row_number() OVER (PARTITION BY vec_id ORDER BY s[i + 1] + e[j + 1] DESC, i, j) AS rk FROM c QUALIFY rk <= 10),
x AS (SELECT *, list_max(list_filter(range(i + 1), lambda q: NOT s[q + 1] > 0.1)) AS a,
        list_min(list_filter(range(j + 1, 33), lambda q: q = 32 OR NOT s[q + 1] > 0.1)) - 1 AS b FROM r)
SELECT vec_id AS passage_id, CAST(rk - 1 AS INTEGER) AS span_rank, CAST(coalesce(a, 0) AS INTEGER) AS start_index,
  CAST(b AS INTEGER) AS end_index, round(score, 6) AS span_score, label::DOUBLE AS relevance_score,
  array_to_string(list_transform(range(coalesce(a, 0), b + 1), lambda q: CAST(floor(abs(s[q + 1]) * 1000) + q AS INTEGER)), ' ') AS prediction_text
FROM x"""

BEST_PASSAGE = f"""WITH d AS (SELECT doc_id, {sentences('text')} AS s FROM documents),
u AS (SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) - 1 AS i FROM d)
SELECT doc_id AS row_idx, CAST(i AS INTEGER) AS rank, len({terms('x')})::DOUBLE AS score, x AS answer FROM u
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY len({terms('x')}) DESC, i) = 1"""


def _ids(x: str) -> str:
    return f"list_transform({tokens(x)}, lambda t: unicode(t))"


PACKED = f"""WITH d AS (SELECT doc_id, {_ids('source')} AS a, {_ids("regexp_replace(text, '^\\s+|\\s+$', '', 'g')")} AS b FROM documents),
x AS (SELECT *, greatest(len(a) + len(b) - {PACK_LENGTH - 3}, 0) AS cut, least(greatest(len(a) + len(b) - {PACK_LENGTH - 3}, 0), abs(len(a) - len(b))) AS lev FROM d),
y AS (SELECT *, CASE WHEN len(a) > len(b) THEN lev ELSE 0 END + (cut - lev) // 2 AS ca FROM x),
z AS (SELECT doc_id, list_concat([{CLS}], a[1:len(a) - ca], [{SEP}], b[1:len(b) - (cut - ca)], [{SEP}]) AS p FROM y),
f AS (SELECT doc_id, list_resize(p, {PACK_LENGTH}, {PAD}) AS p FROM z)
SELECT doc_id, array_to_string(p, ' ') AS ids,
  array_to_string(list_transform(p, lambda q: CASE WHEN q <> {PAD} THEN '1' ELSE '0' END), '') AS mask FROM f"""


NQ = f"""nq AS (SELECT CAST(doc_id AS VARCHAR) AS example_id, doc_id, text AS document_text,
    array_to_string(string_split(text, ' ')[1:5], ' ') AS question_text,
    list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS w FROM documents WHERE source <> {lit(UNANSWERED)}),
ans AS (SELECT *, coalesce(array_to_string(w[4:30], ' '), '') AS long_answer_text,
    coalesce(array_to_string(w[6:7], ' '), '') AS short_answer_text FROM nq)"""


def recursive_chunks() -> str:
    """Cut level by level; merge every run of short pieces greedily, one chunk per recursion step.

    ``w0..w3`` are the stretches to cut at each separator, ``p0..p3`` their pieces.
    """
    steps = ["w0 AS (SELECT example_id, document_text AS t, 0::BIGINT AS lo, length(document_text) AS hi FROM ans)"]
    s = "substr(t, lo + 1, hi - lo)"
    for k, sep in enumerate(SEPARATORS[:-1]):
        n, q = len(sep), lit(sep)
        steps.append(f"""c{k} AS (SELECT example_id, t, lo AS w, hi AS e, unnest(string_split({s}, {q})) AS x,
    generate_subscripts(string_split({s}, {q}), 1) AS i FROM w{k} WHERE contains({s}, {q})),
d{k} AS (SELECT *, w + coalesce(sum(length(x) + {n}) OVER (PARTITION BY example_id, w ORDER BY i
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM c{k}),
p{k} AS (SELECT * FROM (SELECT example_id, t, w, CASE WHEN i = 1 THEN pos ELSE pos - {n} END AS lo, pos + length(x) AS hi FROM d{k}) WHERE hi > lo),
w{k + 1} AS (SELECT example_id, t, lo, hi FROM p{k} WHERE hi - lo >= {CHUNK_SIZE}
    UNION ALL SELECT * FROM w{k} WHERE NOT contains({s}, {q}))""")
    last = len(SEPARATORS) - 1
    steps.append(f"""p{last} AS (SELECT example_id, t, lo AS w, l AS lo, l + 1 AS hi
    FROM (SELECT *, unnest(range(lo, hi)) AS l FROM w{last}))""")
    pieces = " UNION ALL ".join(f"SELECT {k} AS lv, * FROM p{k}" for k in range(last + 1))
    first_at_least = "len(list_filter(e, lambda x: x < {})) + 1"
    return f"""WITH RECURSIVE {NQ}, {", ".join(steps)},
pieces AS (SELECT *, hi - lo >= {CHUNK_SIZE} AS big FROM ({pieces})),
runs AS (SELECT *, count(*) FILTER (WHERE big) OVER (PARTITION BY example_id, lv, w ORDER BY lo) AS run FROM pieces),
edges AS (SELECT example_id, any_value(t) AS t, list_append(list(lo ORDER BY lo), max(hi)) AS e FROM runs WHERE NOT big
    GROUP BY example_id, lv, w, run),
merged AS (
  SELECT example_id, t, e, 1::BIGINT AS a, len(list_filter(e, lambda x: x <= e[1] + {CHUNK_SIZE})) AS b FROM edges
  UNION ALL
  SELECT example_id, t, e, n AS a, len(list_filter(e, lambda x: x <= e[n] + {CHUNK_SIZE})) AS b FROM (
    SELECT *, least(b, greatest({first_at_least.format(f"e[b] - {CHUNK_OVERLAP}")}, {first_at_least.format(f"e[b + 1] - {CHUNK_SIZE}")})) AS n
    FROM merged WHERE b < len(e))),
chunks AS (SELECT example_id, e[a] AS st, regexp_replace(substr(t, e[a] + 1, e[b] - e[a]), '^\\s+|\\s+$', '', 'g') AS c FROM merged),
kept AS (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY st) AS i FROM chunks WHERE c <> '')
SELECT example_id, example_id || '_' || i AS split_id, c AS document_text, short_answer_text,
  contains(c, short_answer_text) AS answer_exist_chunk FROM kept JOIN ans USING (example_id)"""


def rewrite_prompt(document: str, question: str, answer: str) -> str:
    requirement = f"CASE WHEN contains({document}, {answer}) THEN {lit(prompts.ANSWER_PRESENT)} ELSE {lit(prompts.ANSWER_ABSENT)} END"
    filled = (
        lit(prompts.REWRITE_TEMPLATE)
        .replace("{requirement}", f"' || {requirement} || '")
        .replace("{document}", f"' || {document} || '")
        .replace("{question}", f"' || {question} || '")
        .replace("{answer}", f"' || {answer} || '")
    )
    return f"({filled})"


def summarizer_prompts() -> str:
    versions = [*prompts.INSTRUCTION_VERSIONS, "v99"]
    table = ", ".join(
        f"({lit(v)}, {lit(prompts.instruction_text(*spec))})" for v, spec in prompts.INSTRUCTION_VERSIONS.items()
    )
    names = ", ".join(lit(v) for v in versions)
    return f"""WITH {RUNS}, ins(version, instruction) AS (VALUES {table}),
m AS (SELECT *, [{names}][row_idx % {len(versions)} + 1] AS version FROM runs)
SELECT row_idx, CASE WHEN instruction IS NULL THEN 'gpt-3.5.' || m.version ELSE 'gpt-3.5' END AS model,
  instruction AS system_prompt,
  CASE WHEN instruction IS NULL THEN 'unknown instruction version: ' || m.version END AS error,
  '###Question###' || question || chr(10) || chr(10) || '###Passages###' || chr(10) || retrieved AS prompt,
  question || '<sep>' || retrieved AS model_input
FROM m LEFT JOIN ins USING (version)"""


READER_PROMPT = "'###Question###' || chr(10) || question || chr(10) || chr(10) || '###Context###' || chr(10) || "

CHECKED = f"""SELECT CAST(d.doc_id AS VARCHAR) AS id, d.text,
  CASE WHEN length(CAST(d.doc_id AS VARCHAR)) > 16 THEN 'id'
    WHEN e.embedding IS NULL OR len(e.embedding) <> {EMBEDDING_DIM} THEN 'vec'
    WHEN d.source IS NULL OR length(d.source) > 1024 THEN 'title'
    WHEN d.text IS NULL OR length(d.text) > {SHORT_TEXT} THEN 'text' ELSE 'accepted' END AS status
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id"""

READER = "CASE WHEN doc_id % 2 = 0 THEN lang || '/reader-' || source ELSE source END"
READER_NAME = "CASE WHEN doc_id % 2 = 0 THEN 'reader-' || source ELSE source END"

GROUPED_CONDENSE = f"""WITH {RUNS},
gs AS (SELECT row_idx, question, {sentences('retrieved')} AS s FROM runs),
gj AS (SELECT *, unnest(range(len(s) // 4 + 1)) AS j FROM gs),
gt AS (SELECT row_idx, question, j, row_idx * 100000 + j AS k, coalesce(array_to_string(
    CASE WHEN j < len(s) // 4 THEN s[j * 4 + 1:j * 4 + 4] ELSE s[greatest(len(s) - 4, 0) + 1:] END, chr(10)), '') AS t FROM gj),
{condensed('gt', 'k', 'question', 't')}
SELECT row_idx, string_agg(summary, chr(10) ORDER BY j) AS summary FROM gt JOIN condensed USING (k) GROUP BY row_idx"""

GROUPED_PROMPTS = f"""WITH {RUNS},
gs AS (SELECT row_idx, question, {sentences('retrieved')} AS s FROM runs),
gj AS (SELECT *, unnest(range(len(s) // 3 + 1)) AS j FROM gs),
gt AS (SELECT row_idx, question, j, length('###Question###' || question || chr(10) || chr(10) || '###Passages###' || chr(10) || coalesce(array_to_string(
    CASE WHEN j < len(s) // 3 THEN s[j * 3 + 1:j * 3 + 3] ELSE s[greatest(len(s) - 3, 0) + 1:] END, chr(10)), '')) AS n FROM gj)
SELECT row_idx, string_agg(CASE WHEN n % 7 = 0 THEN '' ELSE CAST(n AS VARCHAR) END, chr(10) ORDER BY j) AS summary,
  CASE WHEN bool_or(n % 7 = 0) THEN 'ValueError: no luck' END AS summary_error, CAST(NULL AS VARCHAR) AS read_error,
  any_value(question) || '<sep>' || string_agg(CASE WHEN n % 7 = 0 THEN '' ELSE CAST(n AS VARCHAR) END, chr(10) ORDER BY j) AS model_input
FROM gt GROUP BY row_idx"""

QA_ROWS = f"""WITH {RUNS}, {searched('runs', 'row_idx', 'question', 3)},
one AS (SELECT q_id * 10 + rank AS k, q_id, rank, question, text FROM top JOIN documents ON doc_id = p_id JOIN runs ON row_idx = q_id),
{read('one', 'k', 'question', 'text')},
won AS (SELECT q_id, raw, score FROM readings JOIN one USING (k)
  QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY score DESC, rank) = 1)
SELECT row_idx, 'k3' AS config, question, ctx.retrieved, CAST(NULL AS VARCHAR) AS summary,
  coalesce({clean('raw')}, '') AS predicted, round(coalesce(score, 0.0::DOUBLE), 6) AS score
FROM runs JOIN ctx ON ctx.q_id = row_idx LEFT JOIN won ON won.q_id = row_idx"""

QA_METRICS = f"""WITH {RUNS}, {searched('runs', 'row_idx', 'question', 3)},
c0 AS (SELECT row_idx, question, answer, ctx.retrieved FROM runs JOIN ctx ON ctx.q_id = row_idx),
{condensed('c0', 'row_idx', 'question', 'retrieved')},
c1 AS (SELECT c0.*, summary FROM c0 JOIN condensed ON k = row_idx),
{read('c1', 'row_idx', 'question', 'summary')},
c2 AS (SELECT 'k3_sum' AS config, c1.*, coalesce({clean('raw')}, '') AS predicted FROM c1 LEFT JOIN readings ON k = row_idx),
{judged('c2')}
{metrics()}"""

STREAM_QA = f"""WITH uq AS (SELECT conv_id * 1000 + turn AS row_idx, text AS question FROM conversations WHERE role = 'user'),
{searched('uq', 'row_idx', 'question', 3)},
c0 AS (SELECT row_idx, question, retrieved FROM uq JOIN ctx ON q_id = row_idx),
{read('c0', 'row_idx', 'question', 'retrieved')}
SELECT row_idx, coalesce({clean('raw')}, '') AS predicted, round(coalesce(score, 0.0::DOUBLE), 6) AS score
FROM c0 LEFT JOIN readings ON k = row_idx"""


def all_sql() -> dict[str, str]:
    chars = histogram("length(text)", CHAR_EDGES)
    token_hist = histogram(DOC_TOKENS, TOKEN_EDGES)
    verdicts = f"WITH {RUNS}, {judged()}"
    stream_index = f"SELECT CAST(doc_id AS VARCHAR) AS id, source AS title, CAST({EMBEDDING_DIM} AS INTEGER) AS dim, CAST(length(text) AS INTEGER) AS n_chars, CASE WHEN length(text) <= {SHORT_TEXT} THEN 'accepted' ELSE 'text' END AS status FROM documents"
    return {
        "token_stats": f"WITH {ARTICLES} SELECT id, title, text, {token_count('title || chr(10) || text')} AS token_length, "
        "CAST(length(text) AS BIGINT) AS text_length FROM a",
        "token_histogram": token_hist,
        "char_histogram": chars,
        "token_chunks": TOKEN_CHUNKS,
        "ratio_groups": sentence_groups(False),
        "seeded_ratio_groups": sentence_groups(True),
        "recursive_chunks": recursive_chunks(),
        "normalized_text": f"SELECT doc_id, {normalize('text')} AS normalized FROM documents",
        "filtered_words": "SELECT doc_id, coalesce(array_to_string(list_filter(string_split(text, ' '), lambda w: length(w) < 12), ' '), '') AS text FROM documents",
        "exact_match_score": f"{verdicts} SELECT row_idx, config, {r6('em')} AS em FROM j",
        "contain_flags": f"{verdicts} SELECT row_idx, had AS in_retrieved, kept AS in_summary FROM j",
        "rescored_runs": f"{verdicts} SELECT row_idx, config, predicted, {r6('em')} AS score FROM j",
        "squad_f1": f"WITH {RUNS} SELECT row_idx, {r6(best_f1('answer', 'predicted'))} AS f1 FROM runs",
        "squad_v2_f1": f"""WITH {RUNS},
v AS (SELECT row_idx, CASE row_idx % 3 WHEN 0 THEN [''] WHEN 1 THEN ['the', answer[1]] ELSE answer END AS a,
    CASE WHEN row_idx % 4 < 2 THEN '' ELSE predicted END AS p FROM runs),
t AS (SELECT row_idx, {f1_tokens('p')} AS pt, list_filter(list_transform(a, lambda x: {f1_tokens('x')}), lambda g: len(g) > 0) AS gs FROM v),
u AS (SELECT row_idx, pt, unnest(CASE WHEN len(gs) > 0 THEN gs ELSE [[]::VARCHAR[]] END) AS gt FROM t),
o AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(gt), lambda g: least(len(list_filter(gt, lambda x: x = g)), len(list_filter(pt, lambda x: x = g))))), 0) AS same FROM u)
SELECT row_idx, round(max(CASE WHEN len(gt) = 0 OR len(pt) = 0 THEN (CASE WHEN len(gt) = len(pt) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
  WHEN same > 0 THEN 2.0::DOUBLE * same / (len(gt) + len(pt)) ELSE 0.0::DOUBLE END), 6) AS f1 FROM o GROUP BY row_idx""",
        "eval_run_metrics": f"{verdicts} {metrics()}",
        "config_filter_eval": f"{verdicts} {metrics("contains(config, 'k10') AND NOT contains(config, 'r1')")}",
        "error_samples": f"""{verdicts},
c AS (SELECT config, row_idx, question, predicted, unnest([
    CASE WHEN NOT had AND kept THEN 'sum_tn' END, CASE WHEN had AND NOT kept THEN 'sum_fn' END,
    CASE WHEN kept AND em = 0 THEN 'read_fp' END, CASE WHEN NOT kept AND em <> 0 THEN 'read_tn' END]) AS error_class FROM j)
SELECT config, error_class, row_idx, question, predicted FROM c WHERE error_class IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY config, error_class ORDER BY row_idx) = 1""",
        "answer_offsets": f"""WITH {RUNS}, u AS (SELECT row_idx, retrieved, unnest(answer) AS a, generate_subscripts(answer, 1) - 1 AS pos FROM runs)
SELECT row_idx, CAST(pos AS INTEGER) AS pos, CAST(CASE WHEN a = '' THEN 0 ELSE strpos(retrieved, a) - 1 END AS INTEGER) AS answer_start FROM u""",
        "matched_predictions": f"WITH {RUNS} SELECT row_idx, question AS id, array_to_string(answer, '|') AS answers, predicted AS prediction_text FROM runs",
        "clean_answers": f"SELECT conv_id, turn, {clean('text')} AS answer FROM conversations",
        "knn_join": knn(),
        "knn_mips_l2": KNN_L2,
        "external_id_join": knn(
            "q_id, 'label-' || (SELECT label FROM embeddings WHERE vec_id = t.p_id) || '/' || p_id AS p_id, CAST(rank AS INTEGER) AS rank"
        ),
        "l2_normalized": L2_NORMALIZED,
        "masked_mean_pool": MASKED_MEAN,
        "retrieved_context": f"WITH {PAIRS}, {searched('p', 'row_idx', 'question', 3)} SELECT q_id, retrieved FROM ctx",
        "hashed_embed": f"WITH {DOC_VECTORS} SELECT k AS p_id, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS pos, round(unnest(v), 6) AS x FROM dv",
        "vector_table_check": f"SELECT id, status FROM ({CHECKED})",
        "vector_table_load": f"SELECT id, status, CAST(length(text) AS INTEGER) AS n_chars FROM ({CHECKED})",
        "embed_missing": f"""WITH {DOC_VECTORS},
m AS (SELECT d.doc_id, coalesce(e.{VEC}, dv.v) AS v FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id JOIN dv ON dv.k = d.doc_id)
SELECT CAST(doc_id AS VARCHAR) AS id, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS pos, round(unnest(v), 6) AS x FROM m""",
        "vector_counts": """SELECT count(*) AS rows, count(d.doc_id) = count(d.text) AS ids_match_texts, count(d.doc_id) = count(e.embedding) AS ids_match_vectors
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id""",
        "best_spans": BEST_SPANS,
        "best_passage": BEST_PASSAGE,
        "packed_ids": PACKED,
        "nq_answers": f"WITH {NQ} SELECT example_id, long_answer_text, short_answer_text FROM ans",
        "nq_prompts": f"""WITH {NQ}, q AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN short_answer_text || ' #' ELSE short_answer_text END AS a FROM ans)
SELECT example_id, {rewrite_prompt('document_text', 'question_text', 'a')} AS prompt FROM q""",
        "reader_prompts": f"WITH {RUNS} SELECT row_idx, {READER_PROMPT} coalesce(summary, retrieved) AS prompt FROM runs",
        "summarizer_prompts": summarizer_prompts(),
        "prompt_completion": f"""WITH {RUNS}, q AS (SELECT row_idx, {READER_PROMPT} retrieved AS t FROM runs)
SELECT row_idx, CASE WHEN length(t) % 5 = 0 THEN '' ELSE length(t) || ' characters' END AS completion,
  CASE WHEN length(t) % 5 = 0 THEN 'ValueError: no luck' END AS error FROM q""",
        "training_pairs": f"""WITH {NQ},
r AS (SELECT example_id AS split_id, question_text, document_text, short_answer_text,
    CASE WHEN toxic = 1 THEN '' WHEN quality = 1 THEN {clean('document_text')} END AS s FROM ans LEFT JOIN labels USING (doc_id)),
b AS (SELECT * FROM r UNION ALL SELECT split_id || '_b', question_text, document_text, short_answer_text, s FROM r)
SELECT split_id, question_text || chr(10) || document_text AS input, s AS target FROM b
WHERE contains(document_text, short_answer_text) AND s IS DISTINCT FROM ''""",
        "row_range": """SELECT row_idx, doc_id, lang FROM (SELECT row_number() OVER (ORDER BY lang, doc_id) - 1 AS row_idx, doc_id, lang FROM documents)
WHERE row_idx >= 100""",
        "row_range_counts": """SELECT row_idx, role, conv_id, turn FROM (SELECT row_number() OVER (ORDER BY role, conv_id, turn) - 1 AS row_idx, role, conv_id, turn FROM conversations)
WHERE row_idx < 300""",
        "run_key_names": f"""WITH d AS (SELECT doc_id, lang, source, {READER} AS reader, {READER_NAME} AS name FROM documents),
k AS (SELECT *, source || '.' || lang || '.' || doc_id || '_' || name AS plain_key FROM d)
SELECT doc_id, plain_key, source || '.' || lang || '.' || doc_id || '_sum.2_' || name AS full_key,
  plain_key || '^2' AS second_key, plain_key || '^3' AS third_key, lang || '/' || source || '-256' AS split_table,
  CASE WHEN contains(reader, '/') THEN name ELSE lang || '/' || reader END || '-token' AS count_table FROM k""",
        "published_configs": f"WITH {RUNS} SELECT config, count(*) AS rows FROM runs GROUP BY config",
        "resummarize_join": f"WITH {RUNS}, {condensed('runs', 'row_idx', 'question', 'summary')} SELECT row_idx, runs.summary AS retrieved, condensed.summary FROM runs JOIN condensed ON k = row_idx",
        "extractive_condense": f"WITH {RUNS}, {condensed('runs', 'row_idx', 'question', 'retrieved')} SELECT k AS row_idx, summary FROM condensed",
        "grouped_condense": GROUPED_CONDENSE,
        "lexical_read": f"""WITH {RUNS}, {read('runs', 'row_idx', 'question', 'retrieved')}
SELECT row_idx, round(score, 6) AS score, CAST(strpos(ctx, raw) - 1 AS INTEGER) AS start,
  CAST(strpos(ctx, raw) - 1 + length(raw) AS INTEGER) AS "end", {clean('raw')} AS answer
FROM runs LEFT JOIN readings ON k = row_idx""",
        "qa_rows": QA_ROWS,
        "qa_metrics": QA_METRICS,
        "stream_chunks": TOKEN_CHUNKS,
        "stream_histogram": token_hist,
        "stream_index": stream_index,
        "stream_qa": STREAM_QA,
        "stream_files": TOKEN_CHUNKS,
        "stream_running_histogram": chars,
        "knn_wide_ids": knn(f"q_id, p_id + {WIDE} AS p_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank"),
        "wide_context": f"""WITH {RUNS}, {searched('runs', 'row_idx', 'question', 6)}
SELECT row_idx, CAST((SELECT count(*) FROM top WHERE q_id = row_idx) AS INTEGER) AS n_psgs, ctx.retrieved FROM runs JOIN ctx ON q_id = row_idx""",
        "index_load": f"""SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN length(text) > {SHORT_TEXT} THEN 'text' ELSE 'accepted' END AS status,
  CAST({EMBEDDING_DIM} AS INTEGER) AS dim FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) WHERE i >= {INDEX_START}""",
        "knn_block_join": knn(),
        "reduced_context": f"WITH {PAIRS}, {searched('p', 'row_idx', 'question', 3)} SELECT q_id, retrieved FROM ctx",
        "resumed_completion": f"""WITH {RUNS}, q AS (SELECT row_idx, {READER_PROMPT} retrieved AS t FROM runs)
SELECT row_idx, CASE WHEN length(t) % 5 = 0 THEN '' ELSE length(t) || ' characters' END AS completion,
  CASE WHEN length(t) % 5 = 0 THEN 'ValueError: no luck' END AS error,
  CAST((SELECT count(DISTINCT t) FROM q) AS INTEGER) AS first_calls, CAST(0 AS INTEGER) AS second_calls FROM q""",
        "index_counts": f"""WITH d AS (
  SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, length(text) <= {SHORT_TEXT} AS ok, e.embedding IS NULL AS absent
  FROM documents LEFT JOIN embeddings e ON vec_id = doc_id
), l AS (
  SELECT 1 AS load, true AS fresh, * FROM d WHERE i >= {INDEX_START} UNION ALL SELECT 2, i < {INDEX_START}, * FROM d
), c AS (
  SELECT load, unnest(['rows', 'held', 'embedded', 'accepted', 'rejected', 'duplicate']) AS what,
    unnest([count(*), count(*) FILTER (NOT fresh), count(*) FILTER (fresh AND absent), count(*) FILTER (fresh AND ok),
      count(*) FILTER (fresh AND NOT ok), 0]) AS n FROM l GROUP BY load
  UNION ALL SELECT 0, CASE WHEN ok THEN 'accepted' ELSE 'rejected' END, count(*) FROM d GROUP BY ok
) SELECT CAST(load AS INTEGER) AS load, what, CAST(n AS BIGINT) AS n FROM c""",
        "stream_state": stream_index,
        "paced_chunks": f"SELECT *, CAST(4 AS INTEGER) AS batches, true AS paced FROM ({TOKEN_CHUNKS})",
        "qa_published": QA_METRICS.replace("'k3_sum' AS config", "unnest(['db.docs.3_third.1_reader', 'db.docs.3_third.1_reader^2']) AS config"),
        "qa_grouped_prompts": GROUPED_PROMPTS,
        "json_lines_scan": f"""SELECT CAST(doc_id AS VARCHAR) AS example_id, text AS document_text, array_to_string(string_split(text, ' ')[1:5], ' ') AS question_text,
  CAST(3 AS INTEGER) AS long_start, CAST(CASE WHEN source = {lit(UNANSWERED)} THEN 0 ELSE 1 END AS INTEGER) AS n_short FROM documents""",
        "parquet_write": f"WITH {ARTICLES} SELECT id, title, text, {token_count('title || chr(10) || text')} AS token_length, "
        "CAST(length(text) AS BIGINT) AS text_length FROM a",
        "summary_table": f"""WITH c AS (SELECT r.*, array_to_string(string_split(d.text, ' ')[1:5], ' ') AS q
  FROM ({recursive_chunks()}) r JOIN documents d ON CAST(d.doc_id AS VARCHAR) = r.example_id),
p AS (SELECT row_number() OVER (ORDER BY split_id) - 1 AS row_idx, split_id, length({rewrite_prompt('document_text', 'q', 'short_answer_text')}) AS n FROM c)
SELECT row_idx, split_id, CASE WHEN n % 5 = 0 THEN '' ELSE n || ' characters' END AS summarization_text,
  CASE WHEN n % 5 = 0 THEN 'ValueError: no luck' END AS error FROM p""",
        "corpus_profile": f"""SELECT 'tokens' AS kind, bucket, printf('%.2f%%', pct) AS percent FROM ({token_hist})
UNION ALL SELECT 'chars', bucket, printf('%.2f%%', pct) FROM ({chars})""",
    }
