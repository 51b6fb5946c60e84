"""Annotated documents to answer texts, chunks and training pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odqa_spark.functions.prompts import model_input
from odqa_spark.functions.text import word_span
from odqa_spark.operators.chunk import recursive_chunks


def with_short_answer(raw: DataFrame) -> DataFrame:
    """Rows whose first annotation has a short answer."""
    return raw.where(F.size(F.get(F.col("annotations"), F.lit(0))["short_answers"]) > 0)


def add_answer_texts(raw: DataFrame) -> DataFrame:
    """Add ``long_answer_text`` and ``short_answer_text`` of the first annotation."""
    first = F.get(F.col("annotations"), F.lit(0))
    long_span, short_span = first["long_answer"], F.get(first["short_answers"], F.lit(0))

    def text(span: Column) -> Column:
        return word_span(F.col("document_text"), span["start_token"], span["end_token"])

    return raw.withColumns({"long_answer_text": text(long_span), "short_answer_text": text(short_span)})


def split_documents(answered: DataFrame) -> DataFrame:
    """One row per chunk of ``document_text``, with ``split_id`` (from 1) and ``answer_exist_chunk``."""
    kept = [c for c in answered.columns if c != "document_text"]
    return answered.select(*kept, F.posexplode(recursive_chunks(F.col("document_text"))).alias("_pos", "document_text")).select(
        *answered.columns,
        F.concat_ws("_", F.col("example_id"), (F.col("_pos") + 1).cast("string")).alias("split_id"),
        F.contains("document_text", "short_answer_text").alias("answer_exist_chunk"),
    )


def drop_failed_summaries(rows: DataFrame) -> DataFrame:
    """Leave out rows whose summary is the empty text; a null summary stays."""
    return rows.where(~F.col("summarization_text").eqNullSafe(F.lit("")))


def training_pairs(rows: DataFrame, special_token: bool = False) -> DataFrame:
    """``split_id, input, target`` of the chunks that hold their answer and whose summary did not fail."""
    return drop_failed_summaries(rows).where("answer_exist_chunk").select(
        "split_id",
        model_input(F.col("question_text"), F.col("document_text"), special_token).alias("input"),
        F.col("summarization_text").alias("target"),
    )
