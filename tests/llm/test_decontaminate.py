import re

from pyspark.sql import functions as F

from odqa_spark.llm import decontaminate, queries
from odqa_spark.llm.frames import table

DOCS = "doc_id bigint, text string, key string, item string, mark string"
ITEM = "A farmer in the valley sells 12 kg of apples to Anna Miller for 30 dollars and 12 more to Peter the next day."
SHORT = "which river flows through the city"


def _found(spark, docs, items):
    d = spark.createDataFrame([(i, t, "", "", "") for i, t in docs], DOCS)
    b = spark.createDataFrame(items, "item_id bigint, text string")
    return sorted((r.id, r.item, r.verbatim) for r in decontaminate.leaks(d, b).collect())


def test_template(spark):
    df = spark.createDataFrame([("He met Anna Maria in Rome. The 1,250.5 km took two hours, said I",)], "t string")
    got = df.select(decontaminate.template(F.col("t"))).first()[0]
    assert got == "he met <NAME> in <NAME> the <NUMBER> <UNIT> took <NUMBER> <UNIT> said i"


def test_copies_and_new_values(spark):
    lead, tail = "Some words that come first and say nothing. ", " Then the text goes on with other words."
    again = ITEM.replace("12", "45").replace("30", "77").replace("Anna Miller", "Zoe").replace("Peter", "Luis Alba").replace("kg", "lb")
    mixed = ITEM.replace("sells 12", "sells 45")  # the other 12 stays: not the same question again
    docs = [
        (1, lead + ITEM + tail),
        (2, lead + ITEM.upper() + tail),
        (3, lead + again + tail),
        (4, lead + mixed + tail),
        (5, lead + tail),
        (6, None),
        (7, ""),
        (8, "Nobody knew " + SHORT + " of glass"),
        (9, ITEM),
        (9, ITEM),
        (10, "word " * 100000 + ITEM),
    ]
    got = _found(spark, docs, [(1, ITEM), (2, SHORT), (3, "too short"), (4, None), (5, "")])
    assert [x for x in got if x[0] not in (2,)] == [(1, 1, True), (3, 1, False), (8, 2, True), (9, 1, True), (10, 1, True)]


def test_part_of_an_item_counts_from_thirteen_words(spark):
    w = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma".split()
    docs = [(n, " ".join(w[:n])) for n in (8, 12, 13, 16)]
    assert _found(spark, docs, [(1, " ".join(w))]) == [(13, 1, True), (16, 1, True)]


def test_rows_kept(spark):
    d = spark.createDataFrame([(1, ITEM, "", "", ""), (2, "clean", "", "", ""), (None, ITEM, "", "", ""), (3, None, "", "", ""), (1, "clean", "", "", "")], DOCS)
    b = spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    kept = decontaminate.decontaminated(d, b)
    assert kept.columns == d.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(1, "clean"), (2, "clean"), (3, "")]
    none, empty = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.decontaminated(d, empty).count() == 5 and decontaminate.decontaminated(none, b).count() == 0


def _brute(docs, items, window=8, least=6):
    """Word windows in common on one diagonal; the tables hold no numbers, units or names in the items."""
    words = lambda t: re.findall(r"\w+", t.lower())
    index = {}
    for i, t in items:
        w = words(t)
        for p in range(len(w) - window + 1):
            index.setdefault(tuple(w[p : p + window]), []).append((i, p))
    out = set()
    for d, t in docs:
        w, hits = words(t), {}
        for p in range(len(w) - window + 1):
            for i, q in index.get(tuple(w[p : p + window]), ()):
                hits.setdefault((i, p - q), set()).add(q)
        out |= {(d, i) for (i, _), q in hits.items() if len(q) >= least}
    return out


def test_query_matches_brute_force(spark, sf):
    docs = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in table(spark, sf, "benchmark").select("item_id", "text").collect()]
    got = {(r.doc_id, r.item_id) for r in queries.op2_template_decontamination(spark, sf).collect()}
    assert got == _brute(docs, items) and got


OPENERS = "Tom has 5 red apples. Tom buys 3 green apples. Tom gives 2 apples to Ann. How many apples does Tom have now?"


def test_names_in_any_case_and_at_the_start_of_a_sentence(spark):
    tail = " And then how the rest goes on is of no matter to anybody here."
    docs = [
        (1, ITEM.upper()),
        (2, ITEM.lower()),
        (3, OPENERS.replace("Tom", "Sam")),
        (4, OPENERS.replace("Tom", "Sam").replace("Ann", "Eve").replace("5", "9") + tail),
        (5, OPENERS.lower()),
        (6, tail),
    ]
    got = _found(spark, docs, [(1, ITEM), (2, OPENERS)])
    assert got == [(1, 1, True), (2, 1, True), (3, 2, False), (4, 2, False), (5, 2, True)]
