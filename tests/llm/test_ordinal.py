import math
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from odqa_spark.llm import ordinal, queries, tokens
from odqa_spark.llm.frames import fold, table

DOCS = "doc_id bigint, text string, y string, quality string"
LABELS = "doc_id bigint, quality int, text string"


def _corpus(spark):
    rows, labels = [], []
    for i in range(300):
        g = i % 3
        words = [f"w{(i * 5 + k) % 40}" for k in range(20)] + ["good"] * (2 * g) + ["bad!"] * (2 * (2 - g))
        rows.append((i, " ".join(words), "", ""))
        labels.append((i, [1, 2, 5][g], "x"))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)


def test_three_grades(spark):
    docs, labels = _corpus(spark)
    model = ordinal.fit_ordinal(docs, labels, F.col("doc_id") % 5 != 0)
    assert model.grades == [1, 2, 5] and model.thresholds[0] < model.thresholds[1]
    extra = spark.createDataFrame([(-1, None, "", ""), (-2, "", "", ""), (None, "good " * 50000, "", "")], DOCS)
    got = {r.doc_id: r for r in ordinal.grade(docs.unionByName(extra), model).collect()}
    near = sum(min((1, 2, 5), key=lambda g: abs(g - got[i].expected_grade)) == [1, 2, 5][i % 3] for i in range(300))
    assert near > 280
    assert all(1 <= r.expected_grade <= 5 and 0 <= r.tail_probability <= 1 for r in got.values())
    assert got[-1].quality == got[-2].quality == 0
    low = {r.doc_id: r.tail_probability for r in ordinal.grade(docs, model, tail=2).collect()}
    assert all(low[i] >= got[i].tail_probability for i in range(300))
    assert ordinal.grade(docs, model, tail=1).where("tail_probability < 1").count() == 0


def test_no_ratings_one_grade_empty(spark):
    docs, labels = _corpus(spark)
    use = F.lit(True)
    none = ordinal.grade(docs, ordinal.fit_ordinal(docs, labels.limit(0), use)).collect()
    assert {(r.expected_grade, r.tail_probability) for r in none} == {(None, 0.0)}
    one = ordinal.grade(docs, ordinal.fit_ordinal(docs, labels.where("quality = 5"), use)).collect()
    assert {(r.expected_grade, r.tail_probability) for r in one} == {(5.0, 1.0)}
    assert ordinal.grade(docs.limit(0), ordinal.fit_ordinal(docs, labels, use)).count() == 0
    # ratings of documents that are not there
    far = labels.withColumn("doc_id", F.col("doc_id") + 10000)
    assert ordinal.grade(docs, ordinal.fit_ordinal(docs, far, use)).count() == 300


def test_held_out_ratings(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op9_ordinal_quality(spark, sf).drop("quality").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    r = got.where("held_out").agg(F.avg(((F.col("quality") == 1) == F.col("keep")).cast("int"))).first()[0]
    assert r > 0.85


def _plain_value(text, weight):
    """The quality value of one text by counting, given the weights."""
    kept = tokens.plain(text or "")
    low = tokens.lowered(kept)
    raw, cased = low.encode(), kept.encode()
    cased = cased if len(cased) == len(raw) else raw
    w = re.findall(rb"[0-9a-z_A-Z\x80-\xff]+", raw)
    if not w:
        return 0.0
    n, span = len(w), len(raw) + 1
    bytes_of = Counter(raw + b"\0")
    kinds = [bytes_of[b] for b in ordinal._MARKS] + [sum(bytes_of[b] for b in range(48, 58)), bytes_of[10]]
    kinds.append(span - sum(kinds))
    dense = [min(20 * k / span, 3.0) for k in kinds]
    pairs = list(zip(w, w[1:]))
    dense += [
        4 * sum(a != b for a, b in zip(raw, cased)) / span, 4 * sum(a == b for a, b in pairs) / n,
        4 * (len(pairs) - len(set(pairs))) / n, len(set(w)) / n, sum(map(len, w)) / n / 10, math.log1p(n) / 10, 1.0,
    ]
    bucket = lambda x: ((tokens.hash_word(x.decode()) % 2**64) >> 8) % ordinal.BUCKETS
    mean = sum(weight[bucket(x)] for x in w) / n
    return ordinal._SCALE * mean + sum(d * weight[ordinal.BUCKETS + i] for i, d in enumerate(dense))


def test_query_against_cumulative_logits_by_hand(spark, sf):
    docs = table(spark, sf, "documents")
    model = ordinal.fit_ordinal(docs, table(spark, sf, "labels"), fold("doc_id", 5) != 0)
    assert model.grades == [0, 1] and len(model.thresholds) == 1
    got = {r.doc_id: r for r in queries.op9_ordinal_quality(spark, sf).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for i, text in rows:
        f = _plain_value(text, model.weight)
        p = 1 / (1 + math.exp(-(f - model.thresholds[0])))
        # weights are summed in another order on the way
        assert abs(got[i].quality - f) < 1e-4 and abs(got[i].tail_probability - p) < 1e-4 and abs(got[i].expected_grade - p) < 1e-4
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and got[i].keep == (got[i].tail_probability >= 0.5)
