import hashlib
import random
import re

import pytest
from odqa_spark.llm import queries, sketches
from odqa_spark.llm.frames import table
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, id string, h string, row string, block string, pair string, n_chars string, units string"


def _pieces(text):
    return set(re.findall(r"[^\n]{1,200}[^\n ]*", text))


def _near(a, b):
    a, b = _pieces(a), _pieces(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def _brute(rows, digest):
    """Rows in descending order of ids, nulls last, then of hashes, each with the next one's text."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -digest[r[1] or ""]))
    out = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), _near(t, edited), _near(t, after)))
    return out


def _key(r):
    return (r[0] is None, r)


def _check(spark, rows, got):
    texts = sorted({t or "" for _, t in rows})
    hashed = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t").alias("h")).collect() if texts else []
    want = _brute(rows, {r.t: r.h for r in hashed})
    seen = [(r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got]
    assert sorted(map(str, seen)) == sorted(map(str, want))


def _run(spark, rows):
    df = spark.createDataFrame([(i, t, *"abcdefg") for i, t in rows], SCHEMA)
    return sketches.document_fingerprints(df).collect()


def _texts(n, seed=7):
    rng = random.Random(seed)
    lines = [" ".join("".join(rng.choices("abcé", k=rng.randint(1, 9))) for _ in range(rng.randint(1, 90))) for _ in range(60)]
    return ["\n".join(rng.choices(lines, k=rng.randint(0, 12))) for _ in range(n)]


def test_matches_sets_of_paragraphs(spark):
    texts = _texts(120)
    rows = [(k * 3, t) for k, t in enumerate(texts)]
    rows += [(500, None), (501, ""), (502, "x" * 5000), (503, "w " * 60000), (504, texts[3]), (505, texts[3]), (506, "😀é" * 30)]
    got = _run(spark, rows)
    _check(spark, rows, got)
    by = {r.doc_id: r for r in got}
    assert by[504].fingerprint == by[505].fingerprint == by[9].fingerprint != by[0].fingerprint
    assert by[500].fingerprint == by[501].fingerprint and set(by[500].fingerprint) == {"0"}
    assert all(len(r.fingerprint) == len(r.edited_fingerprint) == 40 * 3 * sketches.BASE for r in got)


def test_null_and_repeated_ids(spark):
    """Ids of which some hold a third of the rows are cut by hash and still follow in order."""
    texts = _texts(90, 8)
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, t) for k, t in enumerate(texts)]
    _check(spark, rows, _run(spark, rows))
    rows = [(None, "a"), (None, "b"), (3, "c"), (3, "c"), (3, "c")]
    _check(spark, rows, _run(spark, rows))


def test_few_rows(spark):
    assert _run(spark, []) == []
    _check(spark, [(1, "one\ntwo")], _run(spark, [(1, "one\ntwo")]))
    _check(spark, [(None, None)], _run(spark, [(None, None)]))


@pytest.mark.parametrize("n", [3, 900])
def test_retries_until_all_is_recovered(spark, n):
    """Versions that differ by far more digests than the first try has cells."""
    rng = random.Random(n)
    both = [rng.getrandbits(63) for _ in range(40)]
    rows = [(k, k % 2, both + [rng.getrandbits(63) for _ in range(n * k)], both[k:] + [rng.getrandbits(63) for _ in range(n)]) for k in range(4)]
    pairs = spark.createDataFrame(rows, "row bigint, pair int, left array<bigint>, right array<bigint>")
    got = {(r.row, r.pair): (r.ours, r.theirs) for r in sketches.differences(pairs, first=2).collect()}
    assert got == {(k, p): (len(set(a) - set(b)), len(set(b) - set(a))) for k, p, a, b in rows}


def test_plan_has_no_python(spark, sf):
    df = sketches.with_next(table(spark, sf, "documents"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString() and "Arrow" not in df._jdf.queryExecution().executedPlan().toString()


def test_query_against_brute_force(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    got = queries.op12_paragraph_sketches(spark, sf).collect()
    _check(spark, rows, got)
    assert sum(r.near_edited > r.near_next for r in got) > 0.8 * len(got)
