"""End-to-end QA run: embed, retrieve, condense, read, record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odqa_spark.functions.prompts import READER_INSTRUCTION, model_input, reader_prompt
from odqa_spark.operators.evaluate import run_metrics
from odqa_spark.operators.models import best_answer, complete, condense_by_prompt, condense_passages, embed, read_answer, read_each
from odqa_spark.operators.retrieval import collect_context, passage_limit, retrieve
from odqa_spark.operators.rows import join_by_position
from odqa_spark.session import materialize
from odqa_spark.sources.run_keys import next_version, run_key
from odqa_spark.sources.tables import list_configs, publish

READERS = ("passages", "context", "completion")


def contexts(questions: DataFrame, passages: DataFrame, limit: int, embed_fn=None, **options) -> DataFrame:
    """Questions with ``psgs`` and ``retrieved``. Passages come as ``p_id, p_vec, title, text``."""
    vectors = questions.select(F.col("row_idx").alias("q_id"), embed(F.col("question"), embed_fn).alias("q_vec"))
    vectors = materialize(vectors, "question-vectors")
    found = collect_context(retrieve(vectors, passages, limit, **options))
    joined = questions.join(found.withColumnRenamed("q_id", "row_idx"), "row_idx", "left")
    return joined.withColumns({
        "psgs": F.coalesce("psgs", F.array().cast("array<string>")),
        "retrieved": F.coalesce("retrieved", F.lit("")),
    })


def contexts_from_run(questions: DataFrame, earlier: DataFrame) -> DataFrame:
    """Questions with the summary of an earlier run at the same position as their only passage."""
    joined = join_by_position(questions, earlier, "summary", "retrieved")
    return joined.withColumn("psgs", F.array("retrieved"))


def answer_rows(
    rows: DataFrame, config: str, summarize: bool = False, ratio: int = 1, reader: str = "context",
    condense_fn=None, read_fn=None, shuffle: bool = True, summarizer: str | None = None,
    special_token: bool = False, calls: dict | None = None,
) -> DataFrame:
    """Run rows from questions with contexts.

    ``passages`` reads every passage and keeps the best answer (unless a summary
    replaces them), ``context`` reads the summary or the joined passages once,
    ``completion`` calls ``read_fn(prompt, system)`` and scores 0. ``summarizer``
    names an instruction version; ``condense_fn`` is then a completion function
    too. ``calls`` are options of completion calls (see ``complete``).
    ``special_token`` adds ``model_input``, question and context with a separator
    token between them instead of a line break. ``summary_error`` and
    ``read_error`` tell a failed call from an empty answer.
    """
    if reader not in READERS:
        raise ValueError(f"reader must be one of {READERS}, not {reader!r}")
    no_error = F.lit(None).cast("string")
    rows = rows.withColumn("summary_error", no_error)
    if summarize and summarizer is not None:
        rows = condense_by_prompt(rows, summarizer, condense_fn, ratio, shuffle, **(calls or {}))
    elif summarize:
        rows = condense_passages(rows, ratio, condense_fn, shuffle)
    else:
        rows = rows.withColumn("summary", F.lit(None).cast("string"))
    question, context = F.col("question"), F.col("summary") if summarize else F.col("retrieved")
    read_error = no_error
    if reader == "completion":
        if read_fn is None:
            raise ValueError("the completion reader needs read_fn")
        info = complete(reader_prompt(question, context), read_fn, F.lit(READER_INSTRUCTION), **(calls or {}))
        rows = rows.withColumn("_info", info)
        predicted, score, read_error = F.col("_info.text"), F.lit(0.0), F.col("_info.error")
    else:
        if reader == "passages" and not summarize:
            info = best_answer(read_each(question, F.col("psgs"), read_fn))
        else:
            info = read_answer(question, context, read_fn)
        rows = rows.withColumn("_info", info)
        predicted, score = F.coalesce(F.col("_info.answer"), F.lit("")), F.coalesce(F.col("_info.score"), F.lit(0.0))
    extra = [model_input(question, context, True).alias("model_input")] if special_token else []
    return rows.select(
        "row_idx",
        F.lit(config).alias("config"),
        "question",
        "answer",
        "retrieved",
        "summary",
        predicted.alias("predicted"),
        score.alias("score"),
        "summary_error",
        read_error.alias("read_error"),
        *extra,
    )


def qa_run(
    questions: DataFrame, passages: DataFrame, config: str, top_k: int = 10, summarize: bool = False,
    ratio: int = 1, reader: str = "context", earlier: DataFrame | None = None,
    embed_fn=None, condense_fn=None, read_fn=None, shuffle: bool = True, summarizer: str | None = None,
    special_token: bool = False, calls: dict | None = None, **options,
) -> DataFrame:
    """One run over ``row_idx, question, answer``; ``earlier`` condenses an earlier run again instead of searching."""
    if earlier is not None:
        rows = contexts_from_run(questions, earlier)
    else:
        rows = contexts(questions, passages, passage_limit(top_k, ratio, summarize), embed_fn, **options)
    return answer_rows(
        rows, config, summarize, ratio, reader, condense_fn, read_fn, shuffle, summarizer, special_token, calls
    )


def run_name(
    spark: SparkSession, root: str, db: str, collection: str, top_k: int, reader: str,
    summarizer: str | None = None, ratio: int = 1,
) -> str:
    """The key of a new run below ``root``: its version goes up until no published run has it."""
    text = [F.lit(x) for x in (db, collection, str(top_k), reader)]
    key = run_key(*text) if summarizer is None else run_key(*text, F.lit(summarizer), F.lit(str(ratio)))
    taken = set(list_configs(spark, root))
    name = spark.range(1).select(key.alias("k")).first()["k"]
    while name in taken:
        name = spark.range(1).select(next_version(F.lit(name)).alias("k")).first()["k"]
    return name


def run_and_publish(
    questions: DataFrame, passages: DataFrame, root: str, db: str, collection: str, reader_name: str,
    top_k: int = 10, summarize: bool = False, ratio: int = 1, summarizer_name: str | None = None,
    metric: str = "squad", **options,
) -> tuple[str, DataFrame]:
    """The whole job: name the run, make it, publish it, score what was published.

    The models run once, when the run is written; ``(config, metrics)`` come from the
    stored run. ``summarizer_name`` and ``reader_name`` go into the key; other
    options are those of ``qa_run``.
    """
    spark = questions.sparkSession
    named = (summarizer_name or "default") if summarize else None
    config = run_name(spark, root, db, collection, top_k, reader_name, named, ratio)
    publish(qa_run(questions, passages, config, top_k, summarize, ratio, **options), root)
    stored = spark.read.parquet(root).where(F.col("config") == config)
    return config, run_metrics(stored, metric=metric)
