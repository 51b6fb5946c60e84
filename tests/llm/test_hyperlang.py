import os
import pathlib
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from odqa_spark.llm import hyperlang, queries
from odqa_spark.llm.frames import fold, table

ROOT = str(pathlib.Path(__file__).resolve().parents[2])
SCHEMA = "doc_id bigint, text string, lang string, score string, lang_pred string"


def test_profile_is_the_bundle_of_bound_vectors(spark):
    rows = [(1, "Ab", "x", "", ""), (2, "1 ab!", "x", "", "")]
    got = hyperlang.language_profiles(spark.createDataFrame(rows, SCHEMA), dims=64)["x"]
    letters = {c: hyperlang._letter_vector(ord(c), 64).astype(int) for c in " ab"}
    gram = lambda g: letters[g[0]] * np.roll(letters[g[1]], 1) * np.roll(letters[g[2]], 2)
    assert (got == 2 * gram(" ab") + 2 * gram("ab ")).all()


def test_cosine_and_undefined_texts(spark):
    train = spark.createDataFrame([(1, "aaaa bbbb", "x", "", ""), (2, "cccc dddd", "y", "", ""), (3, "zz", None, "", ""), (4, None, "q", "", "")], SCHEMA)
    profiles = hyperlang.language_profiles(train)
    assert list(profiles) == ["x", "y"]
    rows = [(1, "aaa bbb", None, None, None), (2, "DDD\nccc", None, None, None), (3, "12 !", None, None, None), (4, None, None, None, None), (5, "", None, None, None), (5, "", None, None, None)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in hyperlang.identify(spark.createDataFrame(rows, SCHEMA), profiles).collect()}
    assert [got[i][0] for i in (1, 2, 3, 4, 5)] == ["x", "y", "und", "und", "und"]
    assert 0.2 < got[1][1] <= 1 and got[3][1] == 0


def test_no_training_rows_and_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert hyperlang.language_profiles(none) == {}
    one = spark.createDataFrame([(1, "abc", "x", "", "")], SCHEMA)
    assert hyperlang.identify(one, {}).collect()[0].lang_pred == "und"
    assert hyperlang.identify(none, {}).count() == 0


def test_long_text_and_wide_alphabet(spark):
    wide = "".join(chr(0x4E00 + i % 3000) for i in range(60000))
    train = spark.createDataFrame([(1, wide, "zh", "", ""), (2, "abc " * 100000, "en", "", "")], SCHEMA)
    got = hyperlang.identify(train, hyperlang.language_profiles(train)).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["zh", "en"]


def test_pieces_hold_every_ngram_once(monkeypatch):
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(list("abcÄ  .\n1"), 5000))
    grams = lambda parts: Counter(tuple(g) for p in parts for g in _all_grams(p))

    def _all_grams(piece):
        g, _, index = hyperlang._grams([piece], 3)
        return g[index].tolist()

    whole = grams(hyperlang._pieces(text, 3))
    for size in (1, 7, 100):
        monkeypatch.setattr(hyperlang, "PIECE_CHARS", size)
        parts = list(hyperlang._pieces(text, 3))
        assert len(parts) > 10 and grams(parts) == whole


def test_memory_of_a_wide_text():
    """Megabytes with a million of different n-grams, in a process of its own."""
    code = """
import resource, numpy as np
from odqa_spark.llm import hyperlang
rng = np.random.default_rng(1)
text = rng.integers(0x4E00, 0x9000, 1_500_000).astype(np.uint32).tobytes().decode("utf-32-le")
hyperlang._bundles(["abc"], np.zeros(1, int), 1, 64, 3)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
hyperlang._bundles([text], np.zeros(1, int), 1, 8, 3)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, env={**os.environ, "PYTHONPATH": ROOT})
    assert float(done.stdout) < 300


def test_query_against_dictionaries(spark, sf):
    """Cosines of profiles made letter by letter, for every document."""
    docs = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text", "lang").collect()]
    vectors = {}

    def profile(counted):
        out = np.zeros(hyperlang.DIMENSIONS)
        for g, n in counted.items():
            if g not in vectors:
                vectors[g] = np.prod([np.roll(hyperlang._letter_vector(ord(c), hyperlang.DIMENSIONS).astype(int), i) for i, c in enumerate(g)], axis=0)
            out += n * vectors[g]
        return out

    def counted(text):
        t = " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + " "
        t = " ".join(["", *t.split(), ""]) if t.strip() else " "
        return Counter(t[i : i + 3] for i in range(len(t) - 2))

    counts = {i: counted(t) for i, t, _ in docs}
    total = {}
    for i, t, lang in docs:
        if zlib.crc32(str(i).encode()) % 3 != 1 and lang is not None and t is not None:
            total.setdefault(lang, Counter()).update(counts[i])
    profiles = {k: profile(total[k]) for k in sorted(total)}
    got = {r.doc_id: r for r in queries.op3_hyperdimensional_langid(spark, sf).collect()}
    assert len(got) == len(docs)
    for i, _, _ in docs:
        own = profile(counts[i])
        near = {k: own @ v / np.linalg.norm(own) / np.linalg.norm(v) for k, v in profiles.items()} if own.any() else {}
        best = max(near, key=near.get) if near else "und"
        assert got[i].lang_pred == best and abs(got[i].score - max(near.get(best, 0), 0)) < 1e-9
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)


def test_held_out_accuracy(spark, sf):
    d = table(spark, sf, "documents")
    profiles = hyperlang.language_profiles(d.where(fold("doc_id", 3) != 1))
    pred = hyperlang.identify(d, profiles).join(d.where(fold("doc_id", 3) == 1).select("doc_id", "lang"), "doc_id")
    right = pred.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95
