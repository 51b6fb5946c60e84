import itertools
import random
import re

import pytest
from compare import differences, duck
from odqa_spark.llm import audit, queries

DOCS = "doc_id bigint, text string, source string, part string, id string, mask string, n int, cells string"
LABELS = "doc_id bigint, quality int, toxic int, part string"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def _fails(rows):
    """For each row the letters it fails."""
    out = []
    for i, text, _ in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0d]+", text)
        f = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text))
        f += "D" * bool(re.search(r"[#$%&*|]", text))
        f += "E" * any(i is not None and j is not None and j < i and (t or "") == text for j, t, _ in rows)
        out.append(set(f))
    return out


def _brute(rows, labels):
    fails = _fails(rows)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out = {}
    for part in {s or "" for _, _, s in rows}:
        mine = [(i, f) for (i, _, s), f in zip(rows, fails) if (s or "") == part]
        removed_all = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            alive = mine
            for step, letter in enumerate(order):
                gone = [(i, f) for i, f in alive if letter in f]
                before = len(alive)
                alive = [(i, f) for i, f in alive if letter not in f]
                failing = sum(letter in f for _, f in mine)
                removed_all[letter] += before - len(alive)
                out[part, "".join(order), step + 1] = [
                    len(alive), len(gone), failing - len(gone), sum(f == {letter} for _, f in mine),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                ]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(removed_all[order[step - 1]])
    return out


def _run(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, s, "p", "i", "m", 1, "c") for i, t, s in rows], DOCS)
    got = audit.interaction_audit(docs, spark.createDataFrame([(*r, "p") for r in labels], LABELS)).collect()
    return {(r.part, r.filter_order, r.step): [r[c] for c in COUNTS] for r in got}


def _rows():
    rng = random.Random(3)
    long = " ".join(f"word{k}" for k in range(220))
    texts = [None, "", " \t", "a b c", "A B C", "a | b", long, long + " #", long.upper(), "x " * 300, "x " * 300 + "&", "É\x1cÀ b", long + "Z" * 9000, "a" * 70000]
    rows = [(rng.choice([*range(40), None]), rng.choice(texts), rng.choice(["s", "t", "", None])) for _ in range(150)]
    return rows + rows[:20]


def test_against_every_order_by_hand(spark):
    rows = _rows()
    labels = [(i, i % 2, i % 3 // 2) for i in range(0, 50, 2)] + [(4, 1, 1), (None, 1, 1), (6, None, None)]
    got = _run(spark, rows, labels)
    assert got == _brute(rows, labels)
    # a document is removed once in each of the orders, whatever removes it
    assert all(sum(got[p, "ABCDE", s][6] for s in range(1, 6)) == 120 * sum(bool(f) for (_, _, q), f in zip(rows, _fails(rows)) if (q or "") == p) for p in ("s", "t", ""))


def test_empty_tables(spark):
    assert _run(spark, [], [(1, 1, 1)]) == {}
    assert _run(spark, [(1, "a", "s")], []) == _brute([(1, "a", "s")], [])


@pytest.mark.parametrize("held", [200, 1 << 20])
def test_small_bounds_change_nothing(spark, monkeypatch, held):
    """Tasks that flush after every slice, tries that end early, prefixes that are all shared."""
    rows = [(k, "the same beginning of a text " * 3 + str(k % 17) * (k % 5) + "tail", "s") for k in range(120)]
    rows += [(200 + k, "hot text that many have", None) for k in range(60)]
    monkeypatch.setattr(audit, "HELD_BYTES", held)
    monkeypatch.setattr(audit, "PREFIX_BYTES", 100)
    assert _run(spark, rows, []) == _brute(rows, [])


def test_trie_holds_least_values():
    rng = random.Random(1)
    texts = [bytes(rng.choices(b"ab", k=rng.randrange(9))) for _ in range(400)]
    trie, want = audit.Trie(), {}
    for k, t in enumerate(texts):
        v = (rng.randrange(1000), k)
        trie.insert(t, v)
        want[t] = min(v, want.get(t, v))
    assert sorted(trie.terminals()) == sorted(want.values())


def test_query_equals_sql(spark, sf):
    name = "op11_filter_audit"
    assert differences(queries.op11_filter_audit(spark, sf), duck(sf), queries.ORACLES[name]) is None
