import random

import brute
import pytest
from ranks import PATTERN, write_ranks
from pyspark.sql import functions as F

from odqa_spark.catalog import fixtures as fx
from odqa_spark.functions import prompts, scoring, text
from odqa_spark.functions.tokens import bpe_tokenizer, default_tokenizer

EDGE_TEXTS = [
    "The  Cat!", "à la carte", "ßä", "a", "", "x y", "An apple, a day", "the\x1fan x", "Ångström 가나 ﬁ",
    "á b", "theatre the", "it_s a_b", "١ a ² an", "  the  ", "İstanbul ΑΣ",
]


def test_normalize_matches_brute_force(spark, sf):
    rows = [(t,) for t in EDGE_TEXTS] + [(None,)]
    df = spark.createDataFrame(rows, "t string")
    got = [(r.t, r.n) for r in df.select("t", text.normalize(F.col("t")).alias("n")).collect()]
    assert [n for _, n in got] == [brute.normalize(t) for t in EDGE_TEXTS] + [None]
    docs = fx.table(spark, sf, "documents").select("text", text.normalize(F.col("text")).alias("n")).collect()
    assert all(r.n == brute.normalize(r.text) for r in docs)


def test_normalize_each_keeps_nulls_and_lengths(spark):
    rows = [(["é", None, "the x"],), (None,), ([],), (["plain"],), (["ä", "à b"],)]
    df = spark.createDataFrame(rows, "a array<string>").coalesce(1)
    got = [r.n for r in df.select(text.normalize_each(F.col("a")).alias("n")).collect()]
    want = [None if a is None else [None if t is None else brute.normalize(t) for t in a] for (a,) in rows]
    assert got == want


def test_drop_long_words(spark):
    rows = [("x" * 1000,), ("x" * 999,), ("a " + "y" * 1000 + " b",), ("a  b",), ("\n" + "z" * 999 + " q",)]
    df = spark.createDataFrame(rows, "t string")
    got = [r.t for r in df.select(text.drop_long_words(F.col("t")).alias("t")).collect()]
    assert got == [" ".join(w for w in t.split(" ") if len(w) < 1000) for (t,) in rows]


def test_word_span_is_clipped_like_a_slice(spark):
    rows = [("a b  c\nd", s, e) for s, e in [(0, 2), (1, 9), (3, 4), (5, 7), (2, 1), (0, 0)]]
    df = spark.createDataFrame(rows, "t string, s int, e int")
    got = [r.w for r in df.select(text.word_span(F.col("t"), F.col("s"), F.col("e")).alias("w")).collect()]
    assert got == [" ".join(t.split()[s:e]) for t, s, e in rows]


CASES = [
    (["x"], "x", 1), (["x"], "x, y", 0.5), (["x", "y"], "x and y", 1), (["island"], "land", 0), (["l"], "land", 0.5),
    (["the"], "", 1), (["x"], "", 0), (["x"], "X.", 1), (["x"], "y,x,z", 1 / 3), (["café"], "Café!", 1),
    (["x", None], "x", 1), (["d"], "anḋ", 0),
]


def test_exact_match_cases_and_brute_force(spark):
    rng = random.Random(3)
    vocab = ["x", "y", "and", ",", "the", "é", "land", " ", "a", "."]
    rows = [(a, p) for a, p, _ in CASES]
    rows += [
        (["".join(rng.choices(vocab, k=2)) for _ in range(rng.randint(0, 3))], "".join(rng.choices(vocab, k=rng.randint(0, 5))))
        for _ in range(300)
    ]
    df = spark.createDataFrame(rows, "answer array<string>, p string").coalesce(1)
    norm = df.select(
        text.normalize_each(F.col("answer")).alias("a"),
        text.normalize(F.col("p")).alias("n"),
        text.normalize_each(scoring.prediction_parts(F.col("p"))).alias("parts"),
    )
    got = [r.em for r in norm.select(scoring.exact_match(F.col("a"), F.col("n"), F.col("parts")).alias("em")).collect()]
    assert got[: len(CASES)] == pytest.approx([c[2] for c in CASES])
    want = [brute.exact_match([a for a in answers if a is not None], p) for answers, p in rows]
    assert got == pytest.approx(want)


def test_f1(spark):
    rows = [(["a cat sat"], "the cat sat down"), (["x x y"], "x x x"), (["q"], "z"), (["the"], "a"), (["a b", "c d e"], "d e"), ([], "x")]
    df = spark.createDataFrame(rows, "a array<string>, p string").coalesce(1)
    got = [r.f for r in df.select(scoring.token_f1(F.col("a"), F.col("p")).alias("f")).collect()]
    assert got[:-1] == pytest.approx([brute.f1(a, p) for a, p in rows[:-1]])
    assert got[-1] is None
    v2 = [r.f for r in df.select(scoring.token_f1(F.col("a"), F.col("p"), "squad_v2").alias("f")).collect()]
    assert v2[3] == 1.0 and v2[5] == 0.0
    with pytest.raises(ValueError):
        scoring.token_f1(F.col("a"), F.col("p"), "rouge")


def test_contain_and_offsets(spark):
    rows = [(["the"], "zz"), ([], "zz"), (["b c"], "a  B, c"), (["q"], "abc")]
    df = spark.createDataFrame(rows, "a array<string>, c string").coalesce(1)
    norm = df.select(text.normalize_each(F.col("a")).alias("a"), text.normalize(F.col("c")).alias("c"))
    got = [r.x for r in norm.select(scoring.exact_contain(F.col("a"), F.col("c")).alias("x")).collect()]
    assert got == [True, False, True, False]
    df = spark.createDataFrame([(["b", "zz", ""], "abb")], "a array<string>, c string")
    assert df.select(scoring.answer_starts(F.col("a"), F.col("c")).alias("s")).head().s == [1, -1, 0]


def test_clean_answer(spark):
    df = spark.createDataFrame([("\"It's\" (a, b).",)], "t string")
    assert df.select(text.clean_answer(F.col("t")).alias("c")).head().c == "Its a b"


def test_default_tokenizer_is_lossless(spark, sf):
    tok = default_tokenizer()
    d = fx.table(spark, sf, "documents").select(
        "text", tok.pieces(F.col("text")).alias("p"), tok.join(tok.pieces(F.col("text"))).alias("j"), tok.count(F.col("text")).alias("n")
    )
    for r in d.collect():
        assert r.j == r.text and r.n == len(r.p) and r.p == brute.PIECE.findall(r.text)


def test_bpe_tokenizer_round_trip(spark, sf, tmp_path):
    pytest.importorskip("tiktoken")
    tok = bpe_tokenizer(write_ranks(tmp_path), PATTERN)
    d = fx.table(spark, sf, "documents").select("text").limit(40)
    d = d.select("text", tok.pieces(F.col("text")).alias("p")).select("text", "p", tok.join(F.col("p")).alias("j"), tok.count(F.col("text")).alias("n"))
    for r in d.collect():
        assert r.j == r.text and r.n == len(r.p)


def test_prompts(spark):
    df = spark.createDataFrame([("q", "doc ans", "ans"), ("q", "doc", "ans")], "q string, d string, a string").coalesce(1)
    r = df.select(
        prompts.reader_prompt(F.col("q"), F.col("d")).alias("r"),
        prompts.summarizer_prompt(F.col("q"), F.col("d")).alias("s"),
        prompts.model_input(F.col("q"), F.col("d")).alias("m"),
        prompts.rewrite_prompt(F.col("d"), F.col("q"), F.col("a"), "{requirement}|{document}|{question}|{answer}|{document}", "in", "out").alias("w"),
    ).collect()
    assert r[0].r == "###Question###\nq\n\n###Context###\ndoc ans"
    assert r[0].s == "###Question###q\n\n###Passages###\ndoc ans"
    assert r[0].m == "q\ndoc ans"
    assert [x.w for x in r] == ["in|doc ans|q|ans|doc ans", "out|doc|q|ans|doc"]


def test_instruction_lookup(spark):
    df = spark.createDataFrame([(1, "gpt-3.5.v13"), (2, "gpt-4"), (3, "m.v6")], "i int, summarizer string")
    got = {r.i: r for r in prompts.with_instruction(df).collect()}
    assert got[1].model == "gpt-3.5" and got[1].error is None and got[1].system_prompt
    assert got[2].model == "gpt-4" and "unknown instruction version" in got[2].error and got[2].system_prompt is None
    assert got[3].model == "m" and "bullet" in got[3].system_prompt
