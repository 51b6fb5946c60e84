import functools
import itertools
import math
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from odqa_spark.llm import queries, tokens, toxicity
from odqa_spark.llm.frames import fold, table
from odqa_spark.llm.labelled import labelled_sample

DOCS = "doc_id bigint, text string, y string, score string, id string"
LABELS = "doc_id bigint, toxic int, text string"


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(2)
    scores, trans, lengths = rng.normal(size=(4, 3)), rng.normal(size=(2, 2)), np.array([4, 1, 3])
    gamma, pairs = toxicity.forward_backward(scores, lengths, trans)
    want_pairs = np.zeros((2, 2))
    for c, n in enumerate(lengths):
        total, one, two = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            p = math.exp(sum(scores[t, c] * y[t] for t in range(n)) + sum(trans[a, b] for a, b in zip(y, y[1:])))
            total += p
            one += p * np.array(y)
            for a, b in zip(y, y[1:]):
                two[a, b] += p
        assert np.allclose(gamma[:n, c], one / total)
        want_pairs += two / total
    assert np.allclose(pairs, want_pairs)


def _corpus(spark, n=400):
    words = "the of and to in is it you that he was for on are with as his they at be this from have or by one had not but what".split()
    rows, labels = [], []
    for i in range(n):
        w = [words[(i * 7 + k * (3 + i % 5)) % len(words)] + ("" if k % 4 else chr(97 + (i + k) % 26)) for k in range(30)]
        if i % 4 == 0:
            w[i % 30] = "Vile!"
            w[(i + (1 if i % 8 else 11)) % 30] = "nasty"
        rows.append((i, " ".join(w), "", "", ""))
        labels.append((i, int(i % 4 == 0), "x"))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)


def test_learns_scores_and_offsets(spark):
    docs, labels = _corpus(spark)
    model = toxicity.fit_toxicity(docs, labels, fold("doc_id", 5) != 0)
    extra = spark.createDataFrame(
        [(-1, None, "", "", ""), (-2, "", "", "", ""), (-3, "Çé “vile” nasty über", "", "", ""), (-4, "the of " * 50000 + "vile", "", "", ""), (None, "the of", "", "", "")], DOCS
    )
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs.unionByName(extra), model).collect()}
    assert sum(got[i].predicted == (i % 4 == 0) for i in range(400)) > 390
    assert got[-1].predicted == got[-2].predicted == 0 and got[-1].spans == [] and 0 <= got[-1].score <= 1
    text = "Çé “vile” nasty über"
    hit = " ".join(text[s.start : s.end] for s in got[-3].spans)
    assert "vile" in hit and "nasty" in hit and "über" not in hit
    assert [(s.start, s.end) for s in got[-4].spans] == [(350000, 350004)]
    kept = toxicity.without_toxic(docs, labels, fold("doc_id", 5) != 0)
    assert kept.columns == docs.columns and 290 <= kept.count() <= 310


def test_no_labels_one_class_and_empty(spark):
    docs, labels = _corpus(spark, 20)
    use = F.lit(True)
    none = labels.limit(0)
    assert {(r.score, r.predicted) for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, none, use)).collect()} == {(0.0, 0)}
    bad = labels.where("toxic = 1")
    assert {(r.score, r.predicted) for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, bad, use)).collect()} == {(1.0, 1)}
    assert toxicity.without_toxic(docs.limit(0), labels, use).count() == 0
    mixed = labels.withColumn("toxic", F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.col("toxic")))
    assert toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, mixed.unionByName(mixed), use)).count() == 20


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op8_crf_toxicity(spark, sf).join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id")
    r = got.groupBy("held_out").agg(F.avg((F.col("toxic") == F.col("predicted")).cast("int")).alias("a"), F.count("*").alias("n")).collect()
    assert len(r) == 2 and all(x.a > 0.85 for x in r)


@functools.lru_cache(maxsize=None)
def _keys_of(word):
    """Hashes of a word and of its beginnings."""
    keys = [tokens.hash_word(word.decode()) % 2**64]
    for n in toxicity._STEMS:
        if len(word) > n:
            part = np.frombuffer(word[:n], np.uint8)
            keys.append(int(tokens.mix(tokens.hash_range(part, np.array([0]), np.array([n])) + np.uint64(n))[0]))
    return keys


def _plain_score(text, model, entry):
    """The score of one text word by word, given the model: features, chains of 64 words, marginals, link."""
    kept = tokens.plain(text or "")
    low = tokens.lowered(kept)
    raw, cased = low.encode(), kept.encode()
    cased = cased if len(cased) == len(raw) else raw
    spans = [m.span() for m in re.finditer(rb"[0-9a-z_A-Z\x80-\xff]+", raw)]
    lex, best = [], []
    for a, b in spans:
        found, e = len(model.keys), 0.0
        for k in _keys_of(raw[a:b]):
            if k in entry and model.evidence[entry[k]] > e:
                found, e = entry[k], model.evidence[entry[k]]
        lex.append(found)
        best.append(sum(e >= x for x in toxicity._BINS))
    total, most = 0.0, 0.0
    for at in range(0, len(spans), toxicity.CHAIN):
        chain = range(at, min(at + toxicity.CHAIN, len(spans)))
        psi = []
        for i in chain:
            a, b = spans[i]
            up = sum(x != y for x, y in zip(raw[a:b], cased[a:b]))
            f = [best[i], 5 + (best[i - 1] if i else 0), 10 + (best[i + 1] if i + 1 < len(spans) else 0)]
            f += [15 + (0 if up == 0 else 2 if up > 1 else 1), 18 + sum(b - a >= x for x in (3, 6, 12))]
            s = (model.word_weight[lex[i]] if lex[i] < len(model.keys) else 0.0) + sum(model.weight[c] for c in f)
            psi.append([1.0, math.exp(min(max(s, -30), 30))])
        m = np.exp(model.trans)
        ahead = [[psi[0][0], psi[0][1]]]
        for p in psi[1:]:
            v = [p[y] * sum(ahead[-1][x] * m[x, y] for x in (0, 1)) for y in (0, 1)]
            ahead.append([x / sum(v) for x in v])
        back = [1.0, 1.0]
        for t in range(len(psi) - 1, -1, -1):
            one, zero = ahead[t][1] * back[1], ahead[t][0] * back[0]
            g = one / (one + zero)
            total, most = total + g, max(most, g)
            v = [sum(m[x, y] * psi[t][y] * back[y] for y in (0, 1)) for x in (0, 1)]
            back = [x / sum(v) for x in v]
    p = min(max(most, 1e-6), 1 - 1e-6)
    x = [1.0, math.log(p / (1 - p)), math.log1p(total), math.log(1e-3 + total / max(len(spans), 1))]
    return 1 / (1 + math.exp(-min(max(float(np.dot(x, model.link)), -40), 40)))


def test_query_against_scores_word_by_word(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf, "labels"), fold("doc_id", 5) != 0)
    assert model.base is None and len(model.keys)
    got = {r.doc_id: r for r in queries.op8_crf_toxicity(spark, sf).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    entry = {int(k): i for i, k in enumerate(model.keys)}
    for i, text in rows:
        score = _plain_score(text, model, entry)
        assert abs(got[i].score - score) < 1e-6 and got[i].predicted == (got[i].score >= 0.5)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_chains_are_drawn_per_class(spark):
    """Few chains of many clean texts do not push out those of the toxic ones."""
    docs, labels = _corpus(spark)
    sample, _ = labelled_sample(docs, labels.withColumn("u", F.lit(True)), "toxic", 400, F.col("u"))
    keys, evidence = toxicity._lexicon(sample, 100)
    _, gold, lengths = toxicity._training_chains(sample, keys, evidence, 40)
    assert len(lengths) == 80 and gold.sum() >= 40
