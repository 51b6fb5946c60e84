"""Summary table job: annotated documents to chunks, prompts and written summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odqa_spark.functions.prompts import rewrite_prompt
from odqa_spark.operators.annotations import add_answer_texts, split_documents, with_short_answer
from odqa_spark.operators.completion import complete_stored
from odqa_spark.operators.models import complete
from odqa_spark.operators.rows import row_range_inclusive
from odqa_spark.sources.tables import range_file_name, write_parquet


def split_annotated(raw: DataFrame) -> DataFrame:
    return split_documents(add_answer_texts(with_short_answer(raw)))


def add_summaries(chunks: DataFrame, make_fn, store: str | None = None, model: str = "default", **options) -> DataFrame:
    """Add ``summarization_text`` (``''`` if the call failed) and ``error``.

    With ``store``, a folder of results, calls that an earlier run has made with ``model`` are not made again.
    """
    prompt = rewrite_prompt(F.col("document_text"), F.col("question_text"), F.col("short_answer_text"))
    if store is None:
        done = chunks.withColumn("_done", complete(prompt, make_fn, **options)).select(*chunks.columns, "_done.text", "_done.error")
    else:
        done = complete_stored(chunks, prompt, make_fn, store, model, **options)
    return done.withColumnRenamed("text", "summarization_text")


def summarize_range(chunks: DataFrame, start: int, end: int, folder: str, make_fn, **options) -> str:
    """Summaries of rows ``start`` to ``end`` (from 1), written to a path of their own; options of ``add_summaries``."""
    path = f"{folder.rstrip('/')}/{range_file_name(start, end)}.parquet"
    write_parquet(add_summaries(row_range_inclusive(chunks, start, end), make_fn, **options), path)
    return path
