import threading
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from odqa_spark.operators import models


def test_batches_and_one_load_per_task(spark):
    def make():
        loaded = threading.get_ident()

        def fn(texts):
            assert len(texts) <= 4
            return [f"{t}:{len(texts)}:{loaded == threading.get_ident()}" for t in texts]

        return fn

    df = spark.createDataFrame([(str(i),) for i in range(10)], "t string").coalesce(1)
    got = [r.x for r in df.select(models.model_column(make, T.StringType(), F.col("t"), batch_size=4).alias("x")).collect()]
    assert got == [f"{i}:{4 if i < 8 else 2}:True" for i in range(10)]


def test_a_filter_on_the_result_does_not_repeat_the_call(spark):
    df = spark.range(5).select("id", models.embed(F.col("id").cast("string")).alias("v"))
    plan = df.where(F.size("v") > 0).select("id", F.posexplode("v"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_default_embedding(spark):
    df = spark.createDataFrame([("a b a",), ("",), (None,), ("A  B\na",)], "t string").coalesce(1)
    v = [r.v for r in df.select(models.embed(F.col("t")).alias("v")).collect()]
    assert v[0] == v[3] and sum(x * x for x in v[0]) == pytest.approx(1.0)
    assert v[1] == v[2] == [0.0] * models.HASH_DIM


def test_words_are_digested_all_at_once(monkeypatch):
    import hashlib

    import numpy as np

    def by_word(text):
        v = np.zeros(models.HASH_DIM)
        for w in (text or "").lower().replace("\n", " ").split(" "):
            if w:
                h = hashlib.md5(w.encode()).hexdigest()
                v[int(h[:4], 16) % models.HASH_DIM] += 1 - 2 * (int(h[4], 16) & 1)
        return v / max(np.sqrt((v**2).sum()), 1e-12)

    # every length up to two blocks, in one and in more bytes a letter; a word told from its beginning by what follows a NUL
    texts = [" ".join(c * n for n in range(1, 130)) for c in "aZé€😀"] + ["a\x00b A\x00C a", "", " \n ", None, "  x\r\ty ", "İ Σς ß"]
    asked = []
    monkeypatch.setattr(models.hashlib, "md5", lambda b, f=hashlib.md5: asked.append(b) or f(b))
    got = models.hashed_words()()(texts)
    assert all(len(w) > 55 for w in asked) and len(asked) > 0
    monkeypatch.undo()
    assert (np.array(got) == np.array([by_word(t) for t in texts])).all()
    monkeypatch.setattr(models, "WORDS_AT_ONCE", 7)
    assert (np.array(models.hashed_words()()(texts)) == np.array(got)).all()
    assert models.hashed_words()()([]) == []


def test_embed_if_missing_asks_only_for_missing_rows(spark):
    def make():
        def fn(texts):
            assert "known" not in texts
            return [[float(len(t or ""))] for t in texts]

        return fn

    df = spark.createDataFrame([("known", [7.0]), ("xyz", None)], "t string, embeddings array<float>").coalesce(1)
    got = [r.vec for r in models.embed_if_missing(df, F.col("t"), make).collect()]
    assert got == [[7.0], [3.0]]
    bare = [r.vec for r in models.embed_if_missing(df.select("t").where("t = 'xyz'"), F.col("t"), make).collect()]
    assert bare == [[3.0]]


def test_grouped_condensing_keeps_the_question_with_its_groups(spark):
    def _joined():
        return lambda questions, texts: [f"<{q}|{t}>" for q, t in zip(questions, texts)]

    rows = [("q1", ["a", "b", "c"]), ("q2", ["d", "e"]), ("q3", [])]
    df = spark.createDataFrame(rows, "question string, psgs array<string>").coalesce(1)
    got = [r.summary for r in models.condense_passages(df, 2, _joined, shuffle=False).collect()]
    assert got == ["<q1|a\nb>\n<q1|b\nc>", "<q2|d\ne>\n<q2|d\ne>", "<q3|>"]
    deduped = models.condense_passages(df, 2, _joined, shuffle=False, tail="dedupe").collect()
    assert deduped[1].summary == "<q2|d\ne>"
    whole = [r.summary for r in models.condense_passages(df, 1, _joined).collect()]
    assert whole == ["<q1|a\nb\nc>", "<q2|d\ne>", "<q3|>"]
    alone = [r.summary for r in models.condense_passages(df.where("question = 'q2'"), 2, _joined).collect()]
    batched = [r.summary for r in models.condense_passages(df, 2, _joined).collect()]
    assert alone[0] == batched[1]


def test_a_native_summary_can_feed_a_model(spark):
    def shout():
        return lambda texts: [t.upper() for t in texts]

    spark.createDataFrame([("burn", "ids")], "a string, b string").collect()
    rows = [("cat", ["The cat sat. Dogs bark. More."]), ("x", ["y", "z"])]
    df = spark.createDataFrame(rows, "question string, psgs array<string>").coalesce(1)
    for ratio in (1, 2):
        s = models.condense_passages(df, ratio, shuffle=False)
        got = s.select(models.model_column(shout, T.StringType(), F.col("summary")).alias("x")).collect()
        assert [r.x for r in got] == [r.summary.upper() for r in s.collect()]


def test_default_condenser(spark):
    text = "Nothing here. The cat sat! Dogs bark.\nA cat and a dog. More. End"
    df = spark.createDataFrame([("cat dog", text), ("x", "")], "q string, t string").coalesce(1)
    got = [r.s for r in df.select(models.condense(F.col("q"), F.col("t")).alias("s")).collect()]
    assert got == ["The cat sat! A cat and a dog.", ""]


def test_readers(spark):
    df = spark.createDataFrame([("who sat", "Dogs bark. The (big) cat, sat on a mat for a day. x")], "q string, c string")
    a = df.select(models.read_answer(F.col("q"), F.col("c")).alias("a")).head().a
    assert (a.answer, a.score, a.start, a.end) == ("The big cat sat on a mat for", 0.5, 11, 42)
    assert df.select(models.read_answer(F.col("q"), F.lit("")).alias("a")).head().a is None

    def make():
        return lambda q, c: [{"score": float(len(x)), "start": 0, "end": 1, "answer": f"'{x}'."} for x in c]

    got = df.select(models.read_each(F.col("q"), F.array(F.lit("a"), F.lit("bb")), make).alias("a")).head().a
    assert [(x.answer, x.score) for x in got] == [("a", 1.0), ("bb", 2.0)]
    assert df.select(models.read_answer(F.col("q"), F.lit("z"), make).alias("a")).head().a.answer == "z"


def test_completion_retries_then_records_the_error(spark):
    def make():
        tries = {}

        def fn(prompt):
            tries[prompt] = tries.get(prompt, 0) + 1
            if prompt == "flaky" and tries[prompt] < 3:
                raise TimeoutError("slow")
            if prompt == "down":
                raise ConnectionError("refused")
            if prompt == "bad":
                raise ValueError("no")
            return f"{prompt}:{tries[prompt]}"

        return fn

    rows = [(p,) for p in ("ok", "flaky", "down", "bad", None)]
    df = spark.createDataFrame(rows, "p string").coalesce(1)
    got = [r.c for r in df.select(models.complete(F.col("p"), make, retries=2).alias("c")).collect()]
    assert [c.text for c in got] == ["ok:1", "flaky:3", "", "", ""]
    assert [c.error for c in got] == [None, None, "ConnectionError: refused", "ValueError: no", "no prompt"]


def test_completion_respects_the_cap(spark):
    def make():
        lock, state = threading.Lock(), {"now": 0, "most": 0}

        def fn(prompt):
            with lock:
                state["now"] += 1
                state["most"] = max(state["most"], state["now"])
            time.sleep(0.01)
            with lock:
                state["now"] -= 1
            return str(state["most"])

        return fn

    df = spark.range(60).select(F.col("id").cast("string").alias("p")).coalesce(1)
    got = [int(r.c.text) for r in df.select(models.complete(F.col("p"), make, max_in_flight=8, parallel_tasks=2).alias("c")).collect()]
    assert 1 < max(got) <= 4


def test_requests_of_all_tasks_share_one_cap(spark):
    def make():
        import time

        def fn(prompt):
            start = time.time()
            time.sleep(0.05)
            return f"{start} {time.time()}"

        return fn

    df = spark.range(48).repartition(4).select(F.col("id").cast("string").alias("p"))
    spans = [tuple(map(float, r.c.text.split())) for r in df.select(models.complete(F.col("p"), make, max_in_flight=8).alias("c")).collect()]
    at_once = max(sum(a <= t < b for a, b in spans) for t, _ in spans)
    assert 2 <= at_once <= 8


def test_batches_of_bounded_tokens(spark):
    """Rows times the longest text stay within the bound, each different text is passed once, order is kept."""
    batches = []

    def make():
        def fn(texts):
            batches.append(list(texts))
            return [[float(len(t or ""))] for t in texts]

        return fn

    texts = [" ".join("w" * 1 for _ in range(n % 37 + 1)) for n in range(300)] + [None, "", "x " * 500, None]
    got = models.within_tokens(make, 64)()(texts)
    assert got == [[float(len(t or ""))] for t in texts]
    size = lambda b: len(b) * max(len(t.split()) if t else 1 for t in b)
    assert all(size(b) <= 64 or len(b) == 1 for b in batches)
    assert sorted(map(str, (t for b in batches for t in b))) == sorted(map(str, set(texts)))
    # far fewer calls than texts, and texts of a batch about as long
    assert len(batches) < 40 and models.within_tokens(make, 64)()([]) == []


def test_embedding_in_token_batches_changes_nothing(spark):
    df = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(i % 50))) for i in range(400)], "id int, t string")
    plain = {r.id: r.v for r in df.select("id", models.embed(F.col("t")).alias("v")).collect()}
    got = {r.id: r.v for r in df.select("id", models.embed(F.col("t"), max_tokens=100).alias("v")).collect()}
    assert got == plain


def test_counters_come_with_the_pass(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def make():
        def fn(texts):
            calls.add(len(texts))
            return [[1.0] for _ in texts]

        return fn

    df = spark.range(50).select("id", F.col("id").cast("string").alias("t"))
    seen = models.Counters(rows=F.count(F.lit(1)), even=F.count_if(F.col("id") % 2 == 0))
    seen.on(df.withColumn("v", models.embed(F.col("t"), make))).write.parquet(str(tmp_path / "o"))
    assert seen.counts == {"rows": 50, "even": 25} and calls.value == 50
    # rows that do not come out, or an exchange of none, are counted all the same
    seen = models.Counters(rows=F.count(F.lit(1)))
    with models.counted(spark):
        seen.on(spark.range(70).repartition(3)).where("id < 0").repartition(4, "id").write.parquet(str(tmp_path / "p"))
    assert seen.counts == {"rows": 70}
    seen = models.Counters(rows=F.count(F.lit(1)))
    seen.on(spark.range(0)).write.parquet(str(tmp_path / "q"))
    assert seen.counts == {"rows": 0}
    assert spark.conf.get(models._EXCLUDED, "") == ""
