from pyspark.sql import functions as F

from odqa_spark.llm import linelog, queries
from odqa_spark.llm.frames import table

SCHEMA = "doc_id bigint, text string, mark string, lines string, template string"


def _clean(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "m", "l", "t") for i, t in rows], SCHEMA)
    out = linelog.without_recurring_lines(df, **options)
    assert out.columns == df.columns
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)


def _body(i):
    return f"body number {i} of words alpha{i} beta{i} gamma{i}"


def _own(i):
    return " ".join(f"w{chr(97 + (i * k) % 26)}{chr(97 + (i + k) % 26)}{chr(97 + i % 26)}x" for k in range(1, 9))


def test_fixed_and_variable_fields(spark):
    rows = []
    for i in range(30):
        names = ["anna", "berta", "carla", "doris", "emma"][i % 5] + chr(97 + i % 26)
        rows.append((i, f"{_own(i)}\nAll rights reserved worldwide.\nPosted on 2024-01-{i:02d} by {names} in news"))
    got = dict(_clean(spark, rows))
    assert got == {i: _own(i) for i in range(30)}
    # too few documents: nothing goes
    assert dict(_clean(spark, rows[:9])) == dict(rows[:9])


def test_copies_of_documents_are_left(spark):
    copy = "\n".join(_own(100 + k) for k in range(4))
    rows = [(i, copy) for i in range(40)] + [(100 + i, f"{_own(i)}\nSubscribe to our letter now") for i in range(20)]
    got = dict(_clean(spark, rows))
    assert all(got[i] == copy for i in range(40))
    assert all(got[100 + i] == _own(i) for i in range(20))


def test_defined_cases(spark):
    foot = "Subscribe to our letter now"
    rows = [(i, f"{_own(i)}\n\nok\n{foot}") for i in range(15)]
    rows += [(50, None), (51, ""), (52, foot), (None, f"tail of its own\n{foot}"), (0, rows[0][1]), (60, f"{foot}\n{foot}\nlast line of sixty"), (61, "x " * 100000 + "\n" + foot)]
    got = _clean(spark, rows)
    assert got.count((0, _own(0) + "\n\nok")) == 2
    by = dict(got)
    assert by[50] is None and by[51] == "" and by[52] == "" and by[None] == "tail of its own"
    assert by[60] == "last line of sixty" and by[61] == "x " * 100000
    assert _clean(spark, []) == []


def _brute(docs, min_docs=10):
    """Lines whose words, digits masked, are the same in enough documents that differ otherwise."""
    import re

    def masked(line):
        w = re.findall(r"\w+", line.lower())
        return tuple("*" if re.search("[0-9]", x) else x for x in w) if len(w) >= 3 else None

    of = {}
    for d, t in docs:
        lines = {masked(x) for x in (t or "").split("\n")} - {None}
        for m in lines:
            of.setdefault(m, []).append(frozenset(lines - {m}))
    sure = {m for m, o in of.items() if len(o) >= min_docs and len(set(o)) >= 0.9 * len(o)}
    return sure, of, masked


def test_query_against_brute_force(spark, sf):
    docs = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    sure, of, masked = _brute(docs)
    got = {r.doc_id: r for r in queries.op7_line_templates(spark, sf).collect()}
    assert len(got) == len(docs) and sure
    # lines of a template have one number of words and the same leading words: so many documents at most share it
    leaf = lambda m: (len(m), m[:3])
    holders = {}
    for m, o in of.items():
        holders[leaf(m)] = holders.get(leaf(m), 0) + len(o)
    dropped = stayed = 0
    for d, t in docs:
        before, after = t.split("\n"), got[d].text.split("\n") if got[d].text else []
        assert got[d].n_lines == len(before)
        it = iter(before)
        assert all(x in it for x in after)
        # lines that must go, and lines that must stay, as often as they stand there
        assert not any(masked(x) in sure for x in after)
        safe = [x for x in before if x and (masked(x) is None or holders[leaf(masked(x))] < 10)]
        assert [x for x in after if x in set(safe)] == safe
        stayed += len(safe)
        dropped += len(before) - len(after)
    assert dropped and stayed > dropped


def test_the_size_of_the_filters_changes_nothing(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    shared = [_text(f"shared{x}", 60) for x in "abc"]
    own = {1000 + i: _text(f"own{chr(97 + i)}", 60) for i in range(14)}
    pages = spark.createDataFrame([(i, "\n".join([*shared, t])) for i, t in own.items()] * 2, "doc_id bigint, text string")
    both = docs.unionByName(pages)
    want = sorted(tuple(r) for r in linelog.without_recurring_lines(both).collect())
    got = sorted(tuple(r) for r in linelog.without_recurring_lines(both, filter_bits=64).collect())
    assert got == want and {t for i, t in got if i in own} == set(own.values())


def test_wildcards_need_constant_words(spark):
    # same length and leading words, but less than half of the words constant
    rows = [(i, f"{_own(i)}\nsee the list " + " ".join(f"q{chr(97 + (i + k) % 26)}{chr(97 + i % 26)}{chr(97 + k)}" for k in range(9))) for i in range(26)]
    assert dict(_clean(spark, rows)) == dict(rows)


def _text(tag, words):
    return " ".join(f"{tag}{chr(97 + k % 26)}{chr(97 + k // 26)}q" for k in range(words))


def test_passage_in_a_hot_copy_group_and_elsewhere(spark):
    foot = "Subscribe to our letter now"
    copy = "\n".join(_own(200 + k) for k in range(4))
    rows = [(i, f"{copy}\n{foot}") for i in range(60)] + [(100 + i, f"{_own(i)}\n{foot}") for i in range(20)]
    got = dict(_clean(spark, rows))
    assert all(got[i] == copy for i in range(60))
    assert all(got[100 + i] == _own(i) for i in range(20))


def test_pages_with_several_shared_passages(spark):
    shared = [_text(f"shared{x}", 60) for x in "abc"]
    own = {i: _text(f"own{chr(97 + i)}", 60) for i in range(14)}
    got = dict(_clean(spark, [(i, "\n".join([*shared, t])) for i, t in own.items()]))
    assert got == own


def test_near_copies_count_once(spark):
    # copies of twenty lines with a line of their own each are no boilerplate
    lines = [_text(f"line{chr(97 + k)}", 12) for k in range(20)]
    rows = {i: "\n".join([*lines[:7], _text(f"new{chr(97 + i)}", 12), *lines[7:]]) for i in range(24)}
    assert dict(_clean(spark, list(rows.items()))) == rows
