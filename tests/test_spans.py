import itertools
import random

from pyspark.sql import functions as F

from odqa_spark.operators import models, spans


def _brute(starts, ends, sub, max_len, top):
    found = [((i, j), starts[i] + ends[j]) for i in range(len(starts)) for j in range(i, min(i + max_len, len(ends)))]
    found.sort(key=lambda x: -x[1])
    out = []
    for (i, j), score in found[:top]:
        while i > 0 and sub[i]:
            i -= 1
        while j < len(sub) - 1 and sub[j + 1]:
            j += 1
        out.append((i, j, score))
    return out


def test_best_spans_match_brute_force(spark):
    rng = random.Random(2)
    rows = [(0, [1, 2, 3], [False, True, True], [1.0] * 3, [1.0] * 3, 0.5)]
    for pid in range(1, 60):
        n = rng.randint(1, 14)
        rows.append((
            pid, list(range(n)), [rng.random() < 0.4 for _ in range(n)],
            [float(rng.randint(0, 3)) for _ in range(n)], [float(rng.randint(0, 3)) for _ in range(n)], 1.0,
        ))
    schema = "passage_id int, token_ids array<int>, is_subword array<boolean>, start_logits array<double>, end_logits array<double>, relevance double"
    for max_len, top in ((1, 10), (3, 10), (8, 4)):
        got = {}
        out = spans.best_spans(spark.createDataFrame(rows, schema), max_len, top).orderBy("passage_id", "span_rank")
        for r in out.collect():
            got.setdefault(r.passage_id, []).append((r.start_index, r.end_index, r.span_score))
            ids = next(x for x in rows if x[0] == r.passage_id)[1]
            assert r.prediction_text == " ".join(map(str, ids[r.start_index : r.end_index + 1]))
        assert got == {r[0]: _brute(r[3], r[4], r[2], max_len, top) for r in rows}


def _pack(title, text, length):
    """Take tokens away one at a time, from the longer part, from the text when equal."""
    a, b = list(title), list(text)
    if not a:
        b = b[: length - 2]
        ids = [101, *b, 102]
    else:
        while len(a) + len(b) > length - 3:
            (a if len(a) > len(b) else b).pop()
        ids = [101, *a, 102, *b, 102]
    return ids + [0] * (length - len(ids))


def test_pack_ids(spark):
    rows = [(list(range(1, n + 1)), list(range(201, 201 + m))) for n, m in itertools.product((0, 1, 3, 4, 5, 6, 9, 12), repeat=2)]
    df = spark.createDataFrame(rows, "a array<int>, b array<int>").coalesce(1)
    got = df.select(spans.pack_ids(F.col("b"), 12, 0, 102, 101, F.col("a")).alias("p")).collect()
    assert [r.p for r in got] == [_pack(a, b, 12) for a, b in rows]
    for r, row in zip(df.select(spans.pack_ids(F.col("b"), 8, 0, 102, 101).alias("p")).collect(), rows):
        assert r.p == _pack([], row[1], 8)
    short = df.select(spans.pack_ids(F.col("b"), 12, 0, 102, 101, F.col("a"), pad_to_max=False).alias("p")).collect()
    assert [r.p for r in short] == [[x for x in _pack(a, b, 12) if x] for a, b in rows]
    mask = df.select(spans.attention_mask(F.array(F.lit(101), F.lit(0)), 0).alias("m")).head().m
    assert mask == [True, False]


def test_best_answer_takes_the_first_of_equal_scores(spark):
    info = "array<struct<score double, start int, end int, answer string>>"
    rows = [([(0.5, 0, 1, "z"), (0.9, 0, 1, "b"), (0.9, 0, 1, "a")],), ([None, (0.0, 0, 0, "x")],), ([],)]
    df = spark.createDataFrame(rows, f"i {info}").coalesce(1)
    got = [r.a and r.a.answer for r in df.select(models.best_answer(F.col("i")).alias("a")).collect()]
    assert got == ["b", "x", None]
    table = spark.createDataFrame([(1, 2, 0.9, "b"), (1, 1, 0.9, "a"), (1, 0, 0.1, "c"), (2, 0, 0.0, "d")], "row_idx int, rank int, score double, answer string")
    assert sorted((r.row_idx, r.answer) for r in models.best_passage(table).collect()) == [(1, "a"), (2, "d")]
