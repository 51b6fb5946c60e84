"""One registered query per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odqa_spark.catalog import fixtures as fx
from odqa_spark.functions import prompts, scoring, text, vectors
from odqa_spark.functions.tokens import default_tokenizer
from odqa_spark.operators import annotations, chunk, completion, evaluate, knn, models, profile, retrieval, rows, spans, vector_table
from odqa_spark.plans import corpus, indexing, qa, summaries
from odqa_spark.session import hadoop_path, materialize, scratch_path
from odqa_spark.sources import run_keys, tables
from odqa_spark.streaming import jobs

TOP_K = 10
WIDE = 1 << 60
INDEX_START = 100
EMBEDDING_DIM = 64
SHORT_TEXT = 3000  # text limit of the vector-table queries, so that some documents break it
PACK_LENGTH = 64
PAD, CLS, SEP = 0, 101, 102
ARRIVED_BYTES = 64 << 20  # of the files of a batch of questions


def _r6(c):
    return F.round(c, 6)


# --- corpus profile ---


def token_stats(spark, sf):
    return profile.token_stats(fx.articles(spark, sf))


def token_histogram(spark, sf):
    return profile.token_histogram(profile.token_stats(fx.articles(spark, sf)))


def char_histogram(spark, sf):
    return profile.char_histogram(profile.token_stats(fx.articles(spark, sf)))


# --- chunks ---


def token_chunks(spark, sf):
    return chunk.token_chunks(fx.articles(spark, sf), 256)


def _sentence_groups(spark, sf, shuffled):
    d = fx.documents(spark, sf, "doc_id", "text").select("doc_id", "text", models.sentences(F.col("text")).alias("psgs"))
    psgs = chunk.seeded_order(F.col("psgs"), F.col("text")) if shuffled else F.col("psgs")
    groups = d.select("doc_id", F.posexplode(chunk.ratio_groups(psgs, 3)).alias("group_no", "g"))
    return groups.select("doc_id", "group_no", F.array_join("g", "\n").alias("text"))


def ratio_groups(spark, sf):
    return _sentence_groups(spark, sf, False)


def seeded_ratio_groups(spark, sf):
    return _sentence_groups(spark, sf, True)


def recursive_chunks(spark, sf):
    return summaries.split_annotated(fx.nq_raw(spark, sf)).select(
        "example_id", "split_id", "document_text", "short_answer_text", "answer_exist_chunk"
    )


# --- text and scoring ---


def normalized_text(spark, sf):
    return fx.documents(spark, sf, "doc_id", "text").select("doc_id", text.normalize(F.col("text")).alias("normalized"))


def filtered_words(spark, sf):
    """Word filter at a limit that the data reaches."""
    return fx.documents(spark, sf, "doc_id", "text").select(
        "doc_id", text.drop_long_words(F.col("text"), 12).alias("text")
    )


def exact_match_score(spark, sf):
    return evaluate.judge_rows(fx.qa_runs(spark, sf)).select("row_idx", "config", _r6("em").alias("em"))


def contain_flags(spark, sf):
    return evaluate.judge_rows(fx.qa_runs(spark, sf)).select("row_idx", "in_retrieved", "in_summary")


def rescored_runs(spark, sf):
    return evaluate.rescore(fx.qa_runs(spark, sf)).select("row_idx", "config", "predicted", _r6("score").alias("score"))


def squad_f1(spark, sf):
    return fx.qa_runs(spark, sf).select(
        "row_idx", _r6(scoring.token_f1(F.col("answer"), F.col("predicted"))).alias("f1")
    )


def squad_v2_f1(spark, sf):
    """Questions without an answer, empty answers beside others, empty predictions."""
    i, first = F.col("row_idx"), F.get("answer", F.lit(0))
    answer = F.when(i % 3 == 0, F.array(F.lit(""))).when(i % 3 == 1, F.array(F.lit("the"), first)).otherwise(F.col("answer"))
    predicted = F.when(i % 4 < 2, "").otherwise(F.col("predicted"))
    f1 = scoring.token_f1(answer, predicted, "squad_v2")
    return fx.qa_runs(spark, sf).select("row_idx", _r6(f1).alias("f1"))


def _rounded_metrics(m: DataFrame) -> DataFrame:
    return m.select(*[_r6(c).alias(c) if t == "double" else F.col(c) for c, t in m.dtypes])


def eval_run_metrics(spark, sf):
    return _rounded_metrics(evaluate.run_metrics(fx.qa_runs(spark, sf)))


def config_filter_eval(spark, sf):
    return _rounded_metrics(evaluate.run_metrics(tables.filter_configs(fx.qa_runs(spark, sf), "k10", "r1")))


def error_samples(spark, sf):
    return evaluate.error_samples(fx.qa_runs(spark, sf)).select(
        "config", "error_class", "row_idx", "question", "predicted"
    )


def answer_offsets(spark, sf):
    refs = evaluate.squad_references(fx.qa_runs(spark, sf))
    return refs.select("row_idx", F.posexplode("answers.answer_start").alias("pos", "answer_start"))


def matched_predictions(spark, sf):
    runs = fx.qa_runs(spark, sf)
    both = evaluate.match_predictions(
        evaluate.squad_references(runs), runs.select("row_idx", F.col("predicted").alias("prediction_text"))
    )
    return both.select("row_idx", "id", F.array_join("answers.text", "|").alias("answers"), "prediction_text")


def clean_answers(spark, sf):
    return fx.table(spark, sf, "conversations").select(
        "conv_id", "turn", text.clean_answer(F.col("text")).alias("answer")
    )


# --- vectors ---


def _vector_sides(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    return (
        e.select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_vec")),
        e.select(F.col("vec_id").alias("p_id"), F.col("embedding").alias("p_vec")),
    )


def knn_join(spark, sf):
    q, p = _vector_sides(spark, sf)
    return knn.topk_join(q, p, TOP_K, dim=EMBEDDING_DIM).select("q_id", "p_id", _r6("score").alias("score"), "rank")


def knn_block_join(spark, sf):
    """The same search with a question set beyond the bound: both sides in about twenty blocks."""
    q, p = _vector_sides(spark, sf)
    block = 8 * EMBEDDING_DIM * max(1, p.count() // 20)
    found = knn.topk_join(q, p, TOP_K, dim=EMBEDDING_DIM, broadcast_bytes=block)
    return found.select("q_id", "p_id", _r6("score").alias("score"), "rank")


def knn_mips_l2(spark, sf):
    q, p = _vector_sides(spark, sf)
    found = knn.topk_join_l2(q, p, TOP_K, dim=EMBEDDING_DIM)
    return found.select("q_id", "p_id", _r6("l2").alias("l2"), _r6("ip").alias("ip"), "rank")


def external_id_join(spark, sf):
    q, p = _vector_sides(spark, sf)
    names = fx.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("p_id"), F.concat(F.lit("label-"), "label", F.lit("/"), "vec_id").alias("external_id")
    )
    return knn.external_ids(knn.topk_join(q, p, TOP_K, dim=EMBEDDING_DIM), names).select("q_id", "p_id", "rank")


def l2_normalized(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    raw = F.transform(vectors.as_double(F.col("embedding")), lambda x, i: x * (i + 1))
    return e.select("vec_id", F.posexplode(vectors.l2_normalize(raw)).alias("pos", "x")).select(
        "vec_id", "pos", _r6("x").alias("x")
    )


def masked_mean_pool(spark, sf):
    v = vectors.as_double(F.col("embedding"))
    tokens = F.sequence(F.lit(0), F.lit(7))
    e = fx.table(spark, sf, "embeddings").select(
        "vec_id",
        F.transform(tokens, lambda j: F.slice(v, j * 8 + 1, 8)).alias("hidden"),
        F.transform(tokens, lambda j: F.when((F.col("vec_id") + j) % 4 == 0, 0).otherwise(1)).alias("mask"),
    )
    pooled = vectors.masked_mean(F.col("hidden"), F.col("mask"))
    return e.select("vec_id", F.posexplode(pooled).alias("pos", "x")).select("vec_id", "pos", _r6("x").alias("x"))


def _question_vectors(spark, sf):
    q = fx.qa_pairs(spark, sf).select(F.col("row_idx").alias("q_id"), models.embed(F.col("question")).alias("q_vec"))
    return materialize(q, "question-vectors")


def retrieved_context(spark, sf):
    found = retrieval.retrieve(_question_vectors(spark, sf), fx.passages(spark, sf), 3, dim=models.HASH_DIM)
    return retrieval.collect_context(found).select("q_id", "retrieved")


def reduced_context(spark, sf):
    """The same contexts where the ranked ids are too many to be broadcast."""
    found = retrieval.retrieve(_question_vectors(spark, sf), fx.passages(spark, sf), 3, block_bytes=0, dim=models.HASH_DIM)
    return retrieval.collect_context(found).select("q_id", "retrieved")


def hashed_embed(spark, sf):
    e = fx.passages(spark, sf).select("p_id", F.posexplode("p_vec").alias("pos", "x"))
    return e.select("p_id", "pos", _r6("x").alias("x"))


def _checkable_rows(spark, sf):
    d = fx.documents(spark, sf, "doc_id", "source", "text")
    e = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    return d.join(e, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("id"), "vec", F.col("source").alias("title"), "text"
    )


def vector_table_check(spark, sf):
    out = vector_table.checked(_checkable_rows(spark, sf), EMBEDDING_DIM, SHORT_TEXT)
    return out.select("id", F.coalesce("reject_reason", F.lit("accepted")).alias("status"))


def _new_table(spark):
    path = scratch_path(spark, "vectors")
    name = "vectors_" + path.rsplit("-", 1)[1]
    vector_table.create_if_absent(spark, name, path)
    return name, path


def vector_table_load(spark, sf):
    """The table after the same load ran twice."""
    name, _ = _new_table(spark)
    for _ in range(2):
        vector_table.append_passages(_checkable_rows(spark, sf), name, EMBEDDING_DIM, SHORT_TEXT)
    kept, lost = spark.table(name), spark.table(f"{name}_rejected")
    return kept.select("id", F.lit("accepted").alias("status"), F.length("text").alias("n_chars")).unionByName(
        lost.select("id", F.col("reject_reason").alias("status"), F.length("text").alias("n_chars"))
    )


def embed_missing(spark, sf):
    """Stored vectors where present, computed ones elsewhere."""
    src = _checkable_rows(spark, sf).withColumnRenamed("vec", "embeddings")
    out = indexing.vector_rows(src).select("id", F.posexplode("vec").alias("pos", "x"))
    return out.select("id", "pos", _r6("x").alias("x"))


def vector_counts(spark, sf):
    src = _checkable_rows(spark, sf)
    return evaluate.count_check(src, ids_match_texts=("id", "text"), ids_match_vectors=("id", "vec"))


# --- spans ---


def best_spans(spark, sf):
    v = vectors.as_double(F.col("embedding"))
    src = fx.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("passage_id"),
        F.transform(F.slice(v, 1, 32), lambda x, i: (F.floor(F.abs(x) * 1000) + i).cast("int")).alias("token_ids"),
        F.transform(F.slice(v, 1, 32), lambda x: x > 0.1).alias("is_subword"),
        F.slice(v, 1, 32).alias("start_logits"),
        F.slice(v, 33, 32).alias("end_logits"),
        F.col("label").cast("double").alias("relevance"),
    )
    return spans.best_spans(src).select(
        "passage_id", "span_rank", "start_index", "end_index", _r6("span_score").alias("span_score"),
        "relevance_score", "prediction_text",
    )


def best_passage(spark, sf):
    """Per document, the sentence with most terms; the first one on ties."""
    d = fx.documents(spark, sf, "doc_id", "text").select("doc_id", F.posexplode(models.sentences(F.col("text"))).alias("rank", "answer"))
    scored = d.select(
        F.col("doc_id").alias("row_idx"), "rank", F.size(models.terms(F.col("answer"))).cast("double").alias("score"), "answer"
    )
    return models.best_passage(scored).select("row_idx", "rank", "score", "answer")



def packed_ids(spark, sf):
    tok = default_tokenizer()

    def ids(c):
        return F.transform(tok.pieces(c), lambda p: F.ascii(p))

    trimmed = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    packed = fx.documents(spark, sf, "doc_id", "source", "text").select(
        "doc_id", spans.pack_ids(ids(trimmed), PACK_LENGTH, PAD, SEP, CLS, ids(F.col("source"))).alias("ids")
    )
    mask = spans.attention_mask(F.col("ids"), PAD)
    return packed.select(
        "doc_id",
        F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"),
        F.array_join(F.transform(mask, lambda m: F.when(m, "1").otherwise("0")), "").alias("mask"),
    )


# --- annotated documents and prompts ---


def nq_answers(spark, sf):
    return annotations.add_answer_texts(annotations.with_short_answer(fx.nq_raw(spark, sf))).select(
        "example_id", "long_answer_text", "short_answer_text"
    )


def nq_prompts(spark, sf):
    """Every third answer is changed so that its document lacks it."""
    a = annotations.add_answer_texts(annotations.with_short_answer(fx.nq_raw(spark, sf)))
    answer = F.when(F.col("example_id").cast("bigint") % 3 == 0, F.concat("short_answer_text", F.lit(" #"))).otherwise(F.col("short_answer_text"))
    return a.select(
        "example_id", prompts.rewrite_prompt(F.col("document_text"), F.col("question_text"), answer).alias("prompt")
    )


def reader_prompts(spark, sf):
    r = fx.qa_runs(spark, sf)
    return r.select("row_idx", prompts.reader_prompt(F.col("question"), F.coalesce("summary", "retrieved")).alias("prompt"))


def summarizer_prompts(spark, sf):
    versions = F.array(*[F.lit(v) for v in [*prompts.INSTRUCTION_VERSIONS, "v99"]])
    n = len(prompts.INSTRUCTION_VERSIONS) + 1
    version = F.element_at(versions, (F.col("row_idx") % n + 1).cast("int"))
    r = fx.qa_runs(spark, sf).withColumn("summarizer", F.concat(F.lit("gpt-3.5."), version))
    out = prompts.with_instruction(r)
    return out.select(
        "row_idx", "model", "system_prompt", "error",
        prompts.summarizer_prompt(F.col("question"), F.col("retrieved")).alias("prompt"),
        prompts.model_input(F.col("question"), F.col("retrieved"), True).alias("model_input"),
    )


def _length_model():
    """A stand-in completion function: fails on every fifth length, else tells the length."""

    def reply(prompt: str) -> str:
        if len(prompt) % 5 == 0:
            raise ValueError("no luck")
        return f"{len(prompt)} characters"

    return reply


def prompt_completion(spark, sf):
    r = fx.qa_runs(spark, sf).select(
        "row_idx", prompts.reader_prompt(F.col("question"), F.col("retrieved")).alias("prompt")
    )
    done = r.withColumn("done", models.complete(F.col("prompt"), _length_model))
    return done.select("row_idx", F.col("done.text").alias("completion"), F.col("done.error").alias("error"))


def resumed_completion(spark, sf):
    """Completions asked for twice: the second time all answers are there, and the model is not called."""
    calls = spark.sparkContext.accumulator(0)

    def counted():
        reply = _length_model()

        def call(prompt: str) -> str:
            calls.add(1)
            return reply(prompt)

        return call

    store = scratch_path(spark, "completions")
    r = fx.qa_runs(spark, sf).select("row_idx", "question", "retrieved")
    prompt = prompts.reader_prompt(F.col("question"), F.col("retrieved"))
    made = []
    for _ in range(2):
        done = completion.complete_stored(r, prompt, counted, store, "stand-in", retry_failed=False)
        made.append(calls.value)
    return done.select(
        "row_idx", F.col("text").alias("completion"), "error", F.lit(made[0]).alias("first_calls"),
        F.lit(made[1] - made[0]).alias("second_calls"),
    )


def training_pairs(spark, sf):
    """Failed, missing and written summaries by label; two tables as one."""
    raw = annotations.add_answer_texts(annotations.with_short_answer(fx.nq_raw(spark, sf)))
    labels = fx.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("example_id"), "quality", "toxic")
    summary = F.when(F.col("toxic") == 1, F.lit("")).when(F.col("quality") == 1, text.clean_answer(F.col("document_text")))
    r = raw.join(labels, "example_id", "left").select(
        F.col("example_id").alias("split_id"), "question_text", "document_text", summary.alias("summarization_text"),
        F.contains("document_text", "short_answer_text").alias("answer_exist_chunk"),
    )
    both = tables.union_all(r, r.withColumn("split_id", F.concat("split_id", F.lit("_b"))))
    return annotations.training_pairs(both)


# --- rows, keys, runs ---


def row_range(spark, sf):
    d = rows.numbered_rows(fx.table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id")
    name, start, end = rows.split_range("train[100:]")
    return d.slice(start, end).select("row_idx", "doc_id", "lang")


def row_range_counts(spark, sf):
    """Row numbers of an inclusive range that starts at 0."""
    d = rows.with_row_idx(fx.table(spark, sf, "conversations").select("conv_id", "turn", "role"), "role", "conv_id", "turn")
    return rows.row_range_inclusive(d, 0, 300).select("row_idx", "role", "conv_id", "turn")


def run_key_names(spark, sf):
    d = fx.table(spark, sf, "documents")
    reader = F.when(F.col("doc_id") % 2 == 0, F.concat("lang", F.lit("/reader-"), "source")).otherwise(F.col("source"))
    plain = run_keys.run_key(F.col("source"), F.col("lang"), F.col("doc_id"), reader)
    full = run_keys.run_key(F.col("source"), F.col("lang"), F.col("doc_id"), reader, F.concat("source", F.lit("/sum")), F.lit(2))
    return d.select(
        "doc_id", plain.alias("plain_key"), full.alias("full_key"),
        run_keys.next_version(plain).alias("second_key"),
        run_keys.next_version(run_keys.next_version(plain)).alias("third_key"),
        run_keys.split_table_name(F.col("lang"), F.col("source"), F.lit(256)).alias("split_table"),
        run_keys.count_table_name(F.col("lang"), reader).alias("count_table"),
    )


def published_configs(spark, sf):
    """Runs written by configuration, one of them republished, read back."""
    root = scratch_path(spark, "runs")
    runs = fx.qa_runs(spark, sf)
    tables.publish(runs, root)
    tables.publish(tables.filter_configs(runs, "r1"), root)
    back = tables.read_parquet_folder(spark, root)
    names = spark.createDataFrame([(c,) for c in tables.list_configs(spark, root)], "config string")
    return names.join(back.groupBy("config").agg(F.count("*").alias("rows")), "config", "left")


def resummarize_join(spark, sf):
    runs = fx.qa_runs(spark, sf)
    again = qa.contexts_from_run(runs.select("row_idx", "question", "answer"), runs)
    return models.condense_passages(again).select("row_idx", "retrieved", "summary")


def extractive_condense(spark, sf):
    r = fx.qa_runs(spark, sf)
    return r.select("row_idx", models.condense(F.col("question"), F.col("retrieved")).alias("summary"))


def grouped_condense(spark, sf):
    r = fx.qa_runs(spark, sf).select("row_idx", "question", models.sentences(F.col("retrieved")).alias("psgs"))
    return models.condense_passages(r, ratio=4, shuffle=False).select("row_idx", "summary")


def lexical_read(spark, sf):
    r = fx.qa_runs(spark, sf).select("row_idx", models.read_answer(F.col("question"), F.col("retrieved")).alias("a"))
    return r.select(
        "row_idx", _r6("a.score").alias("score"), F.col("a.start").alias("start"), F.col("a.end").alias("end"),
        F.col("a.answer").alias("answer"),
    )


def _questions(spark, sf):
    return fx.qa_runs(spark, sf).select("row_idx", "question", "answer")


def qa_rows(spark, sf):
    """Search, read every passage, keep the best answer."""
    run = qa.qa_run(_questions(spark, sf), fx.passages(spark, sf), "k3", 3, reader="passages", dim=models.HASH_DIM)
    return run.select("row_idx", "config", "question", "retrieved", "summary", "predicted", _r6("score").alias("score"))


def qa_metrics(spark, sf):
    """A condensed run end to end, scored."""
    run = qa.qa_run(_questions(spark, sf), fx.passages(spark, sf), "k3_sum", 3, summarize=True, dim=models.HASH_DIM)
    return _rounded_metrics(evaluate.run_metrics(run))


# --- whole jobs ---


def knn_wide_ids(spark, sf):
    """Ids above 2^53, as hashes are."""
    q, p = _vector_sides(spark, sf)
    wide = p.withColumn("p_id", F.col("p_id") + F.lit(WIDE))
    return knn.topk_join(q, wide, TOP_K, dim=EMBEDDING_DIM).select("q_id", "p_id", _r6("score").alias("score"), "rank")


def wide_context(spark, sf):
    """Contexts of two passages times a group size of three."""
    q = _questions(spark, sf)
    found = qa.contexts(q, fx.passages(spark, sf), retrieval.passage_limit(2, 3, True), dim=models.HASH_DIM)
    return found.select("row_idx", F.size("psgs").alias("n_psgs"), "retrieved")


def _numbered_articles(spark, sf):
    stored = _checkable_rows(spark, sf).withColumnRenamed("vec", "embeddings")
    return rows.numbered_rows(stored.withColumn("doc_id", F.col("id").cast("bigint")), "doc_id")


def index_load(spark, sf):
    """A range of rows loaded twice; embeddings that are not stored are computed."""
    name = "vectors_" + scratch_path(spark, "index").rsplit("-", 1)[1]
    rows_ = _numbered_articles(spark, sf)
    for _ in range(2):
        indexing.load_index(rows_, name, scratch_path(spark, "index"), INDEX_START, None, dim=EMBEDDING_DIM, max_text=SHORT_TEXT)
    kept, lost = spark.table(name), spark.table(f"{name}_rejected")
    return kept.select("id", F.lit("accepted").alias("status"), F.size("vec").alias("dim")).unionByName(
        lost.select("id", F.col("reject_reason").alias("status"), F.size("vec").alias("dim"))
    )


def index_counts(spark, sf):
    """What the passes of two loads counted: a range of rows, then all rows."""
    name, path = "vectors_" + scratch_path(spark, "index").rsplit("-", 1)[1], scratch_path(spark, "index")
    rows_ = _numbered_articles(spark, sf)
    loads = [indexing.load_index(rows_, name, path, start, None, dim=EMBEDDING_DIM, max_text=SHORT_TEXT) for start in (INDEX_START, 0)]
    counted = [(i + 1, what, n) for i, seen in enumerate(loads) for what, n in seen.items()]
    stored = spark.table(f"{name}_rows").groupBy(F.lit(0).alias("load"), F.col("status").alias("what")).agg(F.count("*").alias("n"))
    return spark.createDataFrame(counted, "load int, what string, n bigint").unionByName(stored)


def qa_published(spark, sf):
    """Two runs of one configuration: named, versioned, published, scored from what is stored."""
    root = scratch_path(spark, "published")
    # every run reads both more than once
    questions, stored = materialize(_questions(spark, sf), "questions"), materialize(fx.passages(spark, sf), "passages")
    scored = [
        qa.run_and_publish(
            questions, stored, root, "db", "docs", "me/reader", top_k=3, summarize=True,
            summarizer_name="me/third", dim=models.HASH_DIM,
        )[1]
        for _ in range(2)
    ]
    return _rounded_metrics(tables.union_all(*scored))


def _size_model():
    """A stand-in summarizer: tells the length of its prompt, fails on every seventh."""

    def reply(prompt: str, system: str) -> str:
        if len(prompt) % 7 == 0:
            raise ValueError("no luck")
        return str(len(prompt))

    return reply


def qa_grouped_prompts(spark, sf):
    """Groups of three passages, one call each; failed calls are told from empty summaries."""
    r = fx.qa_runs(spark, sf).select("row_idx", "question", "answer", "retrieved", models.sentences(F.col("retrieved")).alias("psgs"))
    run = qa.answer_rows(r, "g", summarize=True, ratio=3, condense_fn=_size_model, summarizer="gpt-3.5.v6", shuffle=False, special_token=True)
    return run.select("row_idx", "summary", "summary_error", "read_error", "model_input")


def json_lines_scan(spark, sf):
    """Annotated articles through JSON lines and back."""
    path = scratch_path(spark, "json")
    fx.nq_raw(spark, sf).write.json(path)
    back = tables.read_json_lines(spark, path)
    first = F.element_at("annotations", 1)
    return back.select(
        "example_id", "document_text", "question_text", first["long_answer"]["start_token"].alias("long_start"),
        F.size(first["short_answers"]).alias("n_short"),
    )


def parquet_write(spark, sf):
    path = scratch_path(spark, "stats")
    tables.write_parquet(profile.token_stats(fx.articles(spark, sf)), path)
    return tables.read_dataset(spark, path, split="train")


def summary_table(spark, sf):
    """Prompts and summaries of all chunks, written in two ranges and read as one table."""
    folder = scratch_path(spark, "summaries")
    numbered = rows.with_row_idx(summaries.split_annotated(fx.nq_raw(spark, sf)), "split_id")
    n = numbered.count()
    for start, end in ((1, n // 2), (n // 2 + 1, n)):
        summaries.summarize_range(numbered, start, end, folder, _length_model)
    back = tables.read_parquet_folder(spark, folder + "/*")
    return back.select("row_idx", "split_id", "summarization_text", "error")


def corpus_profile(spark, sf):
    """Percentages by bucket, as text, from published lengths."""
    maps = corpus.profile_corpus(fx.articles(spark, sf), scratch_path(spark, "profile"), "it's all")
    named = [m.select(F.lit(kind).alias("kind"), F.explode("percent").alias("bucket", "percent")) for kind, m in zip(("tokens", "chars"), maps)]
    return tables.union_all(*named)


# --- streams ---


def _stream(spark, sf, name="documents", **throttle):
    """A table as arriving files, whether it is one file or a folder of them; one per batch unless a ``throttle`` is given."""
    schema, throttle = fx.table(spark, sf, name).schema, throttle or {"max_files": 1}
    fs, path = hadoop_path(spark, f"{sf}/{name}.parquet")
    if fs.getFileStatus(path).isDirectory():
        return tables.stream_parquet(spark, f"{sf}/{name}.parquet", schema, **throttle)
    return tables.stream_parquet(spark, sf, schema, pattern=f"{name}.parquet", **throttle)


def _as_files(rows: DataFrame, batches: int, path: str) -> int:
    """Append ``rows`` to a folder in ``batches`` times as many files as keep a file no larger than a part of their scan; how many make a batch."""
    files = max(1, -(-rows.rdd.getNumPartitions() // batches))
    rows.repartition(batches * files).write.mode("append").parquet(path)
    return files


def stream_files(spark, sf):
    """Four equal arrivals, one per batch, with a repeated start from the same state."""
    source, out, state = (scratch_path(spark, x) for x in ("files", "chunks", "state"))
    files = _as_files(fx.as_articles(fx.table(spark, sf, "documents")), 4, source)
    schema = spark.read.parquet(source).schema
    for _ in range(2):
        _finish(jobs.stream_chunks(tables.stream_parquet(spark, source, schema, max_files=files), out, state, partitions=max(_cores(spark), files)))
    return spark.read.parquet(out)


def stream_running_histogram(spark, sf):
    """A running state over four batches."""
    source, out, state = (scratch_path(spark, x) for x in ("files", "histogram", "state"))
    files = _as_files(fx.as_articles(fx.table(spark, sf, "documents")), 4, source)
    schema = spark.read.parquet(source).schema
    _finish(jobs.stream_histogram(tables.stream_parquet(spark, source, schema, max_files=files), out, state, partitions=max(_cores(spark), files)))
    return profile.histogram_table(jobs.newest_state(spark, out), "char_counts", profile.CHAR_EDGES)


def _cores(spark):
    return spark.sparkContext.defaultParallelism


def _finish(query):
    query.awaitTermination()


def stream_chunks(spark, sf):
    out, state = scratch_path(spark, "chunks"), scratch_path(spark, "state")
    _finish(jobs.stream_chunks(fx.as_articles(_stream(spark, sf)), out, state, partitions=_cores(spark)))
    return spark.read.parquet(out)


def stream_histogram(spark, sf):
    out, state = scratch_path(spark, "histogram"), scratch_path(spark, "state")
    _finish(jobs.stream_histogram(fx.as_articles(_stream(spark, sf)), out, state, partitions=_cores(spark)))
    return profile.histogram_table(jobs.newest_state(spark, out), "token_counts", profile.TOKEN_EDGES)


def stream_index(spark, sf):
    name, _ = _new_table(spark)
    state = scratch_path(spark, "state")
    _finish(jobs.stream_index(fx.as_articles(_stream(spark, sf)), name, state, dim=EMBEDDING_DIM, max_text=SHORT_TEXT, partitions=_cores(spark)))
    return _stored_articles(spark, name)


def _stored_articles(spark, name):
    shown = ["id", "title", F.size("vec").alias("dim"), F.length("text").alias("n_chars")]
    kept = spark.table(name).select(*shown, F.lit("accepted").alias("status"))
    return kept.unionByName(spark.table(f"{name}_rejected").select(*shown, F.col("reject_reason").alias("status")))


def stream_state(spark, sf):
    """Four arrivals with repeated ids, a restart after the second: each article is stored once, by keyed state."""
    name, _ = _new_table(spark)
    source, state = scratch_path(spark, "files"), scratch_path(spark, "state")
    d = fx.table(spark, sf, "documents")
    schema = fx.as_articles(d).schema
    for start in range(2):
        arriving = d.where((F.col("doc_id") % 2 == start) | (F.col("doc_id") % 3 == 0))
        again = arriving.where("doc_id % 5 = 0")
        files = _as_files(fx.as_articles(arriving.unionByName(again)), 2, source)
        articles = tables.stream_parquet(spark, source, schema, max_files=files)
        _finish(jobs.stream_new_articles(articles, name, state, dim=EMBEDDING_DIM, max_text=SHORT_TEXT, partitions=max(_cores(spark), files)))
    return _stored_articles(spark, name)


def paced_chunks(spark, sf):
    """Four arrivals, a batch each second, ended after the last; how many batches there were, and whether each waited for a second of its own."""
    source, out, state = (scratch_path(spark, x) for x in ("files", "chunks", "state"))
    files = _as_files(fx.as_articles(fx.table(spark, sf, "documents")), 4, source)
    articles = tables.stream_parquet(spark, source, spark.read.parquet(source).schema, max_files=files)
    batches = jobs.drained(jobs.stream_chunks(articles, out, state, period="1 second", partitions=max(_cores(spark), files)))
    seconds = {b["start"][:19] for b in batches}
    return spark.read.parquet(out).withColumns({"batches": F.lit(len(batches)), "paced": F.lit(len(seconds) == len(batches))})


def stream_qa(spark, sf):
    """User turns as arriving questions, keyed by conversation and turn.

    A batch reads all passages, so it takes what has arrived, up to ``ARRIVED_BYTES``, and not a single file.
    """
    out, state = scratch_path(spark, "qa"), scratch_path(spark, "state")
    questions = _stream(spark, sf, "conversations", max_bytes=ARRIVED_BYTES).where("role = 'user'").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_idx"),
        F.col("text").alias("question"),
        F.array("role").alias("answer"),
    )
    stored = materialize(fx.passages(spark, sf), "passages")
    _finish(jobs.stream_qa(questions, stored, out, state, "stream", top_k=3, dim=models.HASH_DIM))
    return spark.read.parquet(out).select("row_idx", "predicted", _r6("score").alias("score"))


ALL = [
    token_stats, token_histogram, char_histogram, token_chunks, ratio_groups, seeded_ratio_groups, recursive_chunks,
    normalized_text, filtered_words, exact_match_score, contain_flags, rescored_runs, squad_f1, eval_run_metrics,
    config_filter_eval, error_samples, answer_offsets, matched_predictions, clean_answers, knn_join, knn_mips_l2,
    external_id_join, l2_normalized, masked_mean_pool, retrieved_context, hashed_embed, vector_table_check,
    vector_table_load, embed_missing, vector_counts, best_spans, best_passage, packed_ids, nq_answers, nq_prompts,
    reader_prompts, summarizer_prompts, prompt_completion, training_pairs, row_range, row_range_counts, run_key_names,
    published_configs, resummarize_join, extractive_condense, grouped_condense, lexical_read, qa_rows, qa_metrics,
    stream_chunks, stream_histogram, stream_index, stream_qa, stream_files, stream_running_histogram, knn_wide_ids,
    wide_context, index_load, qa_published, qa_grouped_prompts, json_lines_scan, parquet_write, summary_table, corpus_profile, squad_v2_f1,
    knn_block_join, reduced_context, resumed_completion, index_counts, stream_state, paced_chunks,
]
