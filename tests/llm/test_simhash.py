import random

import xxhash

from odqa_spark.llm import queries, simhash
from odqa_spark.llm.frames import table

SCHEMA = "doc_id bigint, text string, fp string, root string, mark string"


def brute_fingerprint(text, n=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance=3):
    """{node: smallest node of its component} over fingerprints within ``distance``."""
    left, root = set(prints), {}
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            a = todo.pop()
            group.add(a)
            near = {b for b in left if bin(a ^ b).count("1") <= distance}
            left -= near
            todo += near
        root |= {a: min(group) for a in group}
    return root


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


TEXTS = [None, "", " \t\n", "A b", "a  B\n", "one two three", "One TWO three four", "x" * 80 + " y z w", " lead a b c d", "É À b c", "a b c " * 300]


def test_fingerprints():
    got = simhash.fingerprint(TEXTS)
    assert [int(g) & (2**64 - 1) for g in got] == [brute_fingerprint(t) for t in TEXTS]
    assert len(simhash.fingerprint([])) == 0


def test_links_and_components_match_brute_force(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)] + [0, (1 << 64) - 1, 1 << 63]
    prints = set(base)
    for b in base[:20]:
        for _ in range(12):  # chains of near copies
            for _ in range(rng.randint(1, 3)):
                b ^= 1 << rng.randrange(64)
            prints.add(b)
    want = {}
    for node, root in brute_components(prints).items():
        want.setdefault(root, set()).add(_signed(node))
    want = sorted(sorted(g) for g in want.values() if len(g) > 1)
    nodes = spark.createDataFrame([(_signed(p),) for p in prints], "fp bigint")
    for sizes in ({}, {"cell_rows": 1, "block_rows": 3}):
        got = {}
        for r in simhash.components(simhash.links(nodes, **sizes)).collect():
            got.setdefault(r.root, set()).add(r.node)
            assert r.root <= r.node
        assert sorted(sorted(g) for g in got.values()) == want


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(5, 5)], "a bigint, b bigint")
    got = simhash.components(edges).collect()
    assert len(got) == 201 and {r.root for r in got} == {0}


def test_rows_nulls_and_repeats(spark):
    rows = [(5, "a b c d"), (3, "a b c d"), (3, "a b c d"), (9, None), (8, ""), (None, "a b c d"), (7, "other words here now")]
    df = spark.createDataFrame([(i, t, "x", "x", "x") for i, t in rows], SCHEMA)
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.simhash_components(df).collect())
    assert got == [(-1, 3), (3, 3), (3, 3), (5, 3), (7, 7), (8, 8), (9, 8)]
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 3, 7, 8]
    none = spark.createDataFrame([], SCHEMA)
    assert simhash.simhash_components(none).count() == 0 and simhash.one_of_each(none).count() == 0


def test_query_matches_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    prints = {i: brute_fingerprint(t) for i, t in docs}
    root = brute_components(set(prints.values()))
    first = {}
    for i, p in prints.items():
        first[root[p]] = min(i, first.get(root[p], i))
    want = sorted((i, f"{p:016x}", first[root[p]]) for i, p in prints.items())
    assert sorted(tuple(r) for r in queries.op5_simhash_segments(spark, sf).collect()) == want


def test_one_of_each_keeps_the_smallest_id(spark, sf):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    prints = {i: brute_fingerprint(t) for i, t in docs}
    root = brute_components(set(prints.values()))
    first = {}
    for i, p in prints.items():
        first[root[p]] = min(i, first.get(root[p], i))
    assert len(first) < len(docs)
    assert sorted(r.doc_id for r in simhash.one_of_each(table(spark, sf, "documents")).collect()) == sorted(first.values())


def test_one_of_each_with_a_repeated_id_in_two_groups(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "quite other words in here"), (1, "quite other words in here"), (4, "A b c d")]
    df = spark.createDataFrame([(i, t, "x", "x", "x") for i, t in rows], SCHEMA)
    assert sorted((r.doc_id, r.text) for r in simhash.one_of_each(df).collect()) == [(1, "a b c d"), (1, "quite other words in here")]
