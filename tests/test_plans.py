import pytest
from pyspark.sql import functions as F

from odqa_spark.catalog import fixtures as fx
from odqa_spark.catalog import queries
from odqa_spark.operators import chunk, profile
from odqa_spark.operators.models import embed
from odqa_spark.plans import corpus, qa, summaries
from odqa_spark.plans.evaluation import evaluate_published
from odqa_spark.sources import tables
from odqa_spark.streaming import jobs

QUESTIONS = [(0, "where is the red barn", ["hill"]), (1, "who feeds blue fish", ["nora"]), (2, "zzz", ["none"])]
PASSAGES = [
    (1, "a", "The red barn is on a hill."), (2, "b", "Nora feeds the blue fish, daily."), (3, "c", "Plain words here."),
    (4, "d", "A red barn burned."), (5, "e", "blue fish swim"),
]


@pytest.fixture
def qa_tables(spark):
    q = spark.createDataFrame(QUESTIONS, "row_idx bigint, question string, answer array<string>")
    p = spark.createDataFrame(PASSAGES, "p_id bigint, title string, text string")
    return q, p.withColumn("p_vec", embed(F.col("text")))


def test_run_variants(qa_tables):
    q, p = qa_tables
    run = {r.row_idx: r for r in qa.qa_run(q, p, "k2", 2, reader="passages").collect()}
    assert len(run) == 3 and all(len(r.retrieved.split("\n")) == 2 and r.summary is None for r in run.values())
    assert run[0].predicted == "The red barn is on a hill" and run[1].predicted == "Nora feeds the blue fish daily"
    whole = {r.row_idx: r for r in qa.qa_run(q, p, "k2", 2).collect()}
    assert whole[0].retrieved == run[0].retrieved
    grouped = {r.row_idx: r for r in qa.qa_run(q, p, "k2", 2, summarize=True, ratio=2).collect()}
    assert all(len(r.retrieved.split("\n")) == 4 for r in grouped.values())
    assert all(len(r.summary.split("\n")) == 3 for r in grouped.values())
    with pytest.raises(ValueError):
        qa.qa_run(q, p, "k2", reader="oracle")
    with pytest.raises(ValueError):
        qa.qa_run(q, p, "k2", reader="completion")


def test_completion_reader_and_condensing_an_earlier_run(qa_tables):
    q, p = qa_tables

    def reply():
        return lambda prompt, system: prompt.splitlines()[1]

    first = qa.qa_run(q, p, "one", 2, summarize=True)
    rows = {r.row_idx: r for r in first.collect()}
    again = {r.row_idx: r for r in qa.qa_run(q, p, "one^2", summarize=True, earlier=first, reader="completion", read_fn=reply).collect()}
    for i, question, _ in QUESTIONS:
        assert again[i].retrieved == rows[i].summary and again[i].predicted == question and again[i].score == 0.0


def test_condensing_by_instruction_version(qa_tables):
    q, p = qa_tables

    def reply():
        return lambda prompt, system: f"{'bullet' in system}:{prompt.splitlines()[0]}"

    run = qa.qa_run(q, p, "gpt", 2, summarize=True, summarizer="gpt-3.5.v6", condense_fn=reply)
    assert {r.summary for r in run.collect()} == {f"True:###Question###{text}" for _, text, _ in QUESTIONS}
    with pytest.raises(ValueError):
        qa.qa_run(q, p, "gpt", 2, summarize=True, summarizer="gpt-4", condense_fn=reply)


def test_prompts_by_groups_and_errors(qa_tables):
    q, p = qa_tables

    def reply():
        def fn(prompt, system):
            if "zzz" in prompt:
                raise ValueError("no")
            return str(len(prompt.split("###Passages###")[1].strip().split("\n")))

        return fn

    run = qa.qa_run(q, p, "g", 1, summarize=True, ratio=2, summarizer="gpt.v6", condense_fn=reply, shuffle=False, special_token=True)
    rows = {r.row_idx: r for r in run.collect()}
    # two passages are one full group and the tail group that repeats it
    assert rows[0].summary == "2\n2" and rows[0].summary_error is None and rows[0].read_error is None
    assert rows[2].summary == "\n" and rows[2].summary_error == "ValueError: no"
    assert rows[0].model_input == "where is the red barn<sep>2\n2"
    read = qa.qa_run(q, p, "c", 1, reader="completion", read_fn=reply, calls={"max_in_flight": 4}).collect()
    assert {r.row_idx: r.read_error.split(":")[0] for r in read} == {0: "IndexError", 1: "IndexError", 2: "ValueError"}
    assert {r.predicted for r in read} == {""}


def test_named_versioned_published_and_scored(spark, qa_tables, tmp_path):
    q, p = qa_tables
    root = str(tmp_path / "runs")
    names = []
    for _ in range(3):
        name, metrics = qa.run_and_publish(q, p, root, "db", "coll", "me/reader", top_k=2)
        names.append(name)
        assert metrics.head().rows == 3
    assert names == ["db.coll.2_reader", "db.coll.2_reader^2", "db.coll.2_reader^3"]
    name, _ = qa.run_and_publish(q, p, root, "db", "coll", "me/reader", top_k=2, summarize=True, ratio=2, summarizer_name="me/sum")
    assert name == "db.coll.2_sum.2_reader" and len(tables.list_configs(spark, root)) == 4


def test_apostrophes_in_config_names(spark, sf, tmp_path):
    a = fx.articles(spark, sf).limit(20)
    tokens, _ = corpus.profile_corpus(a, str(tmp_path / "c"), "it's")
    assert len(tokens.head().percent) > 3


def test_articles_without_title_or_text_are_counted(spark):
    a = spark.createDataFrame([("1", None, "u", "some words"), ("2", "t", "u", None), ("3", None, "u", None)], "id string, title string, url string, text string")
    assert {r.id for r in chunk.token_chunks(a, 8).collect()} >= {"1_0", "2_0"}
    assert profile.histogram_row(profile.token_stats(a)).head().total == 3


def test_evaluating_published_runs(spark, sf, tmp_path):
    root = str(tmp_path / "runs")
    tables.publish(fx.qa_runs(spark, sf), root)
    before = {r.config: r for r in evaluate_published(spark, root).collect()}
    assert set(before) == {"k10_r0", "k10_r1"}
    after = evaluate_published(spark, root, contain="k10", exclude="r1", upload=True).collect()
    assert [r.config for r in after] == ["k10_r0"] and after[0] == before["k10_r0"]
    stored = spark.read.parquet(root).groupBy("config").agg(F.sum("score").alias("s"), F.count("*").alias("n")).collect()
    scores = {r.config: (r.s, r.n) for r in stored}
    assert scores["k10_r1"] == (0.0, before["k10_r1"].rows) and scores["k10_r0"][1] == before["k10_r0"].rows
    assert 100 * scores["k10_r0"][0] / scores["k10_r0"][1] == pytest.approx(before["k10_r0"].exact_match)


def test_run_survives_more_than_one_partition_layout(qa_tables):
    q, p = qa_tables
    a = {tuple(map(str, r)) for r in qa.qa_run(q.coalesce(1), p.coalesce(1), "k2", 2, summarize=True, ratio=2).collect()}
    b = {tuple(map(str, r)) for r in qa.qa_run(q.repartition(3), p.repartition(4), "k2", 2, summarize=True, ratio=2).collect()}
    assert a == b


def test_split_and_profile_a_corpus(spark, sf, tmp_path):
    a = fx.articles(spark, sf)
    corpus.split_corpus(a, str(tmp_path / "split"), "default", 128)
    assert spark.read.parquet(str(tmp_path / "split")).count() == chunk.token_chunks(a, 128).count()
    tokens, chars = corpus.profile_corpus(a, str(tmp_path / "count"), "default")
    assert sum(float(v.rstrip("%")) for v in tokens.head().percent.values()) == pytest.approx(100, abs=0.1)
    assert len(chars.head().percent) == 9


def test_summaries_of_a_range(spark, sf, tmp_path):
    def reply():
        return lambda prompt: f"{len(prompt)}"

    split = summaries.split_annotated(fx.nq_raw(spark, sf))
    from odqa_spark.operators.rows import with_row_idx

    numbered = with_row_idx(split, "split_id")
    path = summaries.summarize_range(numbered, 1, 5, str(tmp_path), reply)
    assert path.endswith("chatgpt-nq_1-5.parquet")
    got = spark.read.parquet(path)
    assert got.count() == 5 and got.where("summarization_text = '' or error is not null").count() == 0
    # overlapping ranges of one store: a chunk is summarised once
    calls = spark.sparkContext.accumulator(0)

    def counted():
        def call(prompt):
            calls.add(1)
            return f"{len(prompt)}"

        return call

    for start, end in ((1, 5), (3, 8)):
        path = summaries.summarize_range(numbered, start, end, str(tmp_path / "kept"), counted, store=str(tmp_path / "store"))
    assert spark.read.parquet(path).schema == got.schema and calls.value == 8


def test_arrivals_of_a_large_table_are_many_files_in_four_batches(spark, tmp_path):
    rows = spark.range(0, 800, 1, 16).selectExpr("CAST(id AS STRING) AS id", "'t' AS title", "'u' AS url", "CONCAT('word ', id) AS text")
    source, out, state = (str(tmp_path / x) for x in ("files", "out", "state"))
    files = queries._as_files(rows, 4, source)
    written = list((tmp_path / "files").glob("*.parquet"))
    assert (files, len(written)) == (4, 16)
    assert max(spark.read.parquet(str(w)).count() for w in written) <= 60
    batches = jobs.drained(jobs.stream_chunks(tables.stream_parquet(spark, source, rows.schema, max_files=files), out, state, period="0 seconds"))
    assert len(batches) == 4 and spark.read.parquet(out).count() == 800


def test_stream_files_one_at_a_time_equal_the_batch(spark, sf, tmp_path):
    source = str(tmp_path / "in")
    fx.articles(spark, sf).repartition(4).write.parquet(source)
    batch = spark.read.parquet(source)

    def stream():
        return tables.stream_parquet(spark, source, batch.schema, max_files=1)

    q = jobs.stream_chunks(stream(), str(tmp_path / "chunks"), str(tmp_path / "s1"), 256)
    q.awaitTermination()
    assert len([p for p in q.recentProgress if p.numInputRows]) == 4
    got = sorted((r.id, r.text) for r in spark.read.parquet(str(tmp_path / "chunks")).collect())
    assert got == sorted((r.id, r.text) for r in chunk.token_chunks(batch, 256).collect())

    jobs.stream_histogram(stream(), str(tmp_path / "hist"), str(tmp_path / "s2")).awaitTermination()
    assert len(list((tmp_path / "hist").glob("state=*"))) <= 2
    assert jobs.newest_state(spark, str(tmp_path / "hist")).head() == profile.histogram_row(profile.token_stats(batch)).head()


def test_stream_index_twice_adds_nothing(spark, sf, tmp_path):
    from odqa_spark.operators.vector_table import create_if_absent

    source = str(tmp_path / "in")
    fx.articles(spark, sf).repartition(3).write.parquet(source)
    schema = spark.read.parquet(source).schema
    create_if_absent(spark, "stream_vt", str(tmp_path / "vt"))
    for run in ("a", "b"):
        s = tables.stream_parquet(spark, source, schema, max_files=1)
        jobs.stream_index(s, "stream_vt", str(tmp_path / run), dim=64, max_text=10**6).awaitTermination()
    assert spark.table("stream_vt").count() == spark.read.parquet(source).count()


def test_stream_state_over_batches_and_restarts(spark, sf, tmp_path):
    """Each id is embedded once by keyed state; a version that a limit rejects can come again."""
    from odqa_spark.operators.vector_table import create_if_absent

    calls = spark.sparkContext.accumulator(0)

    def make():
        def fn(texts):
            calls.add(len(texts))
            return [[1.0, 2.0] for _ in texts]

        return fn

    source = str(tmp_path / "in")
    create_if_absent(spark, "state_vt", str(tmp_path / "vt"))
    schema = "id string, title string, url string, text string"
    ids = [(str(i), "t", "u", "x" * (99 if i == 7 else 5)) for i in range(20)]
    steps = [[ids[:12], ids[6:15]], [ids[10:20], [("7", "t", "u", "short"), *ids[:3], (None, "t", "u", "a"), (None, "t", "u", "b")]]]
    for step in steps:
        for rows in step:
            spark.createDataFrame(rows * 2, schema).coalesce(1).write.mode("append").parquet(source)
        s = tables.stream_parquet(spark, source, spark.read.parquet(source).schema, max_files=1)
        jobs.stream_new_articles(s, "state_vt", str(tmp_path / "state"), make_fn=make, dim=2, max_text=50).awaitTermination()
    assert sorted(int(r.id) for r in spark.table("state_vt").collect()) == list(range(20))
    lost = sorted((str(r.id), r.reject_reason, r.text[:1]) for r in spark.table("state_vt_rejected").collect())
    assert lost == [("7", "text", "x"), ("None", "id", "a"), ("None", "id", "b")]
    assert calls.value == 23
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != jobs.ROCKSDB
    states = {f.suffix for f in (tmp_path / "state" / "state").rglob("*") if f.is_file()}
    assert ".zip" in states or ".changelog" in states


def test_paced_batches(spark, sf, tmp_path):
    import datetime

    source = str(tmp_path / "in")
    fx.articles(spark, sf).repartition(3).write.parquet(source)
    batch = spark.read.parquet(source)
    s = tables.stream_parquet(spark, source, batch.schema, max_bytes=1)
    query = jobs.stream_chunks(s, str(tmp_path / "out"), str(tmp_path / "state"), period="2 seconds")
    seen = jobs.drained(query)
    assert not query.isActive and len(seen) == 3 and sum(b["rows"] for b in seen) == batch.count()
    at = [datetime.datetime.fromisoformat(b["start"].replace("Z", "+00:00")) for b in seen]
    # triggers lie at multiples of the period: no two batches start in the same
    assert len({int(a.timestamp()) // 2 for a in at}) == 3
    assert spark.read.parquet(str(tmp_path / "out")).count() == chunk.token_chunks(batch, 256).count()


def test_stream_questions(spark, qa_tables, tmp_path):
    q, p = qa_tables
    source = str(tmp_path / "in")
    q.repartition(3, "row_idx").write.parquet(source)
    s = tables.stream_parquet(spark, source, q.schema, max_files=1)
    jobs.stream_qa(s, p, str(tmp_path / "out"), str(tmp_path / "state"), "k2", top_k=2).awaitTermination()
    got = sorted((r.row_idx, r.retrieved, r.predicted) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted((r.row_idx, r.retrieved, r.predicted) for r in qa.qa_run(q, p, "k2", 2).collect())


def _tables(spark, folder):
    """Questions in eight small files, and documents."""
    turns = spark.range(16).selectExpr("id AS conv_id", "explode(array(0, 1)) AS turn")
    turns = turns.selectExpr("conv_id", "turn", "IF(turn = 0, 'user', 'assistant') AS role", "concat('what does word', conv_id, ' mean') AS text")
    turns.repartition(8, "conv_id").sortWithinPartitions("conv_id").write.option("maxRecordsPerFile", 4).parquet(f"{folder}/conversations.parquet")
    docs = spark.range(20).selectExpr("id AS doc_id", "concat('The word', id, ' means ', id, '. More.') AS text", "'en' AS lang", "'src1' AS source", "20L AS n_chars")
    docs.coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_a_batch_of_questions_takes_what_has_arrived(spark, tmp_path, monkeypatch):
    sf = _tables(spark, tmp_path / "sf")
    files = len(list((tmp_path / "sf" / "conversations.parquet").glob("*.parquet")))
    sizes, run = [], jobs.qa_run
    monkeypatch.setattr(jobs, "qa_run", lambda batch, *a, **k: sizes.append(batch.count()) or run(batch, *a, **k))
    got = sorted(map(tuple, queries.stream_qa(spark, sf).collect()))
    assert sizes == [16] and len(got) == 16
    # a batch is bounded: it holds one file at least and no more than the bytes allow
    sizes.clear()
    monkeypatch.setattr(queries, "ARRIVED_BYTES", 1)
    assert sorted(map(tuple, queries.stream_qa(spark, sf).collect())) == got
    assert files > 1 and len(sizes) == files and sum(sizes) == 16


def test_published_runs_embed_the_passages_once(spark, tmp_path, monkeypatch):
    sf = _tables(spark, tmp_path / "sf")
    seen = []
    publish = qa.run_and_publish
    monkeypatch.setattr(qa, "run_and_publish", lambda q, p, *a, **k: seen.append((q, p)) or publish(q, p, *a, **k))
    assert queries.qa_published(spark, sf).count() == 2
    assert len(seen) == 2
    for q, p in seen:
        assert "Python" not in p._jdf.queryExecution().executedPlan().toString()
        assert len(p.inputFiles()) > 0 and "passages" in p.inputFiles()[0] and "questions" in q.inputFiles()[0]


def test_plans_have_no_cross_join(spark, sf):
    for name in ("knn_join", "knn_mips_l2", "retrieved_context", "qa_metrics", "eval_run_metrics", "error_samples"):
        plan = getattr(queries, name)(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
