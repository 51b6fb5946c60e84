import random

import brute
import pytest
from ranks import PATTERN, write_ranks
from pyspark.sql import functions as F

from odqa_spark.catalog import fixtures as fx
from odqa_spark.functions.tokens import bpe_tokenizer
from odqa_spark.operators import chunk


def _articles(spark, rows):
    return spark.createDataFrame(rows, "id string, title string, url string, text string")


def _edge_articles():
    rng = random.Random(7)
    words = ["abcd", "ab", "\n", "x" * 30, "", "é"]
    rows = [
        ("one", "", "u", "x"), ("space", " title", "u", "abcd " * 50), ("none", "t", "u", "z" * 300),
        ("every", " a", "u", " a" * 40), ("long", "t" * 1000, "u", ""), ("kept", "", "u", "y" * 998),
        ("gone", "", "", "y" * 1000), ("half", "w" * 200, "u", " b" * 30 + "q" * 200),
    ]
    for n in (3, 7, 8, 9, 15, 16, 17, 31, 32, 33):
        rows.append((f"n{n}", " a", "u", " bcd" * (n - 2)))
    for i in range(300):
        rows.append((f"r{i}", rng.choice(["", " s", "ti"]), "u", rng.choice([" ", ""]).join(rng.choices(words, k=rng.randint(0, 60)))))
    return rows


@pytest.mark.parametrize("window", [1, 4, 8])
def test_token_chunks_match_brute_force(spark, window):
    rows = _edge_articles()
    got = {(r.id, r.text) for r in chunk.token_chunks(_articles(spark, rows), window).collect()}
    want = {c for r in rows for c in brute.token_chunks(dict(zip(["id", "title", "url", "text"], r)), window)}
    assert got == want


def test_token_chunks_on_documents(spark, sf):
    a = fx.articles(spark, sf)
    got = {(r.id, r.text) for r in chunk.token_chunks(a, 256).collect()}
    assert got == {c for r in a.collect() for c in brute.token_chunks(r.asDict(), 256)}


def test_tail_start_depends_on_the_first_token(spark):
    """The tail moves back although it starts at a word, since the article does not start with a space."""
    rows = [("a", "abcd", "u", " bcd" * 12), ("b", " bcd", "u", " bcd" * 12)]
    got = {r.id: r.text for r in chunk.token_chunks(_articles(spark, rows), 4).collect()}
    assert got["a_3"] == " bcd" * 5
    assert got["b_3"] == " bcd" * 4


def test_chunks_cover_all_tokens(spark, sf):
    a = fx.articles(spark, sf)
    texts = {r.id: f"{r.title}\n{r.text}" for r in a.collect()}
    by_doc = {}
    for r in chunk.token_chunks(a, 256).collect():
        doc, pos = r.id.rsplit("_", 1)
        by_doc.setdefault(doc, {})[int(pos)] = r.text
    assert set(by_doc) == set(texts)
    for doc, chunks in by_doc.items():
        assert sorted(chunks) == list(range(len(chunks)))
        at = 0
        for i in range(len(chunks)):
            start = texts[doc].rfind(chunks[i], 0, at + len(chunks[i]))
            assert 0 <= start <= at
            at = max(at, start + len(chunks[i]))
        assert at == len(texts[doc])


def test_chunks_with_a_trained_vocabulary(spark, sf, tmp_path):
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    path = write_ranks(tmp_path)
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def pieces(s):
        return [enc.decode_single_token_bytes(t).decode("latin-1") for t in enc.encode_ordinary(s)]

    a = fx.articles(spark, sf).limit(30)
    got = {(r.id, r.text) for r in chunk.token_chunks(a, 64, bpe_tokenizer(path, PATTERN)).collect()}
    want = {
        (i, t.encode("latin-1").decode("utf-8", errors="replace"))
        for r in a.collect() for i, t in brute.token_chunks(r.asDict(), 64, pieces)
    }
    assert got == want


def test_recursive_chunks_match_brute_force(spark, sf):
    rng = random.Random(5)
    alphabet = ["ab", " ", "\n", "\n\n", "c" * 9, "é"]
    for _ in range(3000):
        t = "".join(rng.choices(alphabet, k=rng.randint(0, 60)))
        size = rng.randint(2, 30)
        overlap = rng.randint(0, size - 1)
        assert chunk.recursive_spans(t, size, overlap) == brute.recursive_chunks(t, size, overlap), (t, size, overlap)
    docs = fx.table(spark, sf, "documents").select("text", chunk.recursive_chunks(F.col("text")).alias("c")).collect()
    assert all(r.c == brute.recursive_chunks(r.text) for r in docs)


@pytest.mark.parametrize("ratio", [1, 2, 3, 10, 11])
def test_ratio_groups(spark, ratio):
    p = [str(i) for i in range(10)]
    df = spark.createDataFrame([(p,), ([],)], "p array<string>").coalesce(1)
    got = [r.g for r in df.select(chunk.ratio_groups(F.col("p"), ratio).alias("g")).collect()]
    assert got[0] == [p[j * ratio : (j + 1) * ratio] for j in range(10 // ratio)] + [p[-ratio:]]
    assert got[1] == [[]]
    dedupe = df.select(chunk.ratio_groups(F.col("p"), ratio, tail="dedupe").alias("g")).head().g
    assert len(dedupe) == len(got[0]) - (10 % ratio == 0)


def test_seeded_order_is_a_fixed_permutation(spark):
    p = [str(i) for i in range(20)]
    df = spark.createDataFrame([(p, "s1"), (p, "s2")], "p array<string>, s string")
    one = [r.o for r in df.coalesce(1).select(chunk.seeded_order(F.col("p"), F.col("s")).alias("o")).collect()]
    two = [r.o for r in df.repartition(2).select("s", chunk.seeded_order(F.col("p"), F.col("s")).alias("o")).orderBy("s").collect()]
    assert one == two and sorted(one[0]) == sorted(p) and one[0] != one[1] and one[0] != p
