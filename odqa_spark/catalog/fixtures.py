"""Inputs of the registered queries, derived from the given tables by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from odqa_spark.functions.text import embed_input
from odqa_spark.operators.models import embed
from odqa_spark.operators.rows import with_row_idx
from odqa_spark.session import spread


UNANSWERED = "src9"  # articles of this source have no short answer


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Columns of ``documents``, on all cores even when the file is small."""
    return spread(table(spark, sf, "documents").select(*columns))


def articles(spark: SparkSession, sf: str) -> DataFrame:
    return as_articles(documents(spark, sf, "doc_id", "source", "lang", "text"))


def as_articles(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), F.col("lang").alias("url"), "text"
    )


def passages(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their default embedding."""
    d = documents(spark, sf, "doc_id", "source", "text").select(F.col("doc_id").alias("p_id"), F.col("source").alias("title"), "text")
    return d.withColumn("p_vec", embed(embed_input(F.col("title"), F.col("text"))))


def qa_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """User turns with the assistant turn that follows, at dense positions."""
    c = table(spark, sf, "conversations")
    user = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    reply = c.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply")
    )
    return with_row_idx(user.join(reply, ["conv_id", "turn"]), "conv_id", "turn")


def _words(w: Column, start: int, n) -> Column:
    return F.array_join(F.slice(w, start, n), " ")


def qa_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Two run configurations with every verdict class in them."""
    w = F.split("reply", " ", -1)
    absent = F.lit("zzqx absent")
    i = F.col("row_idx")
    last_two = F.array_join(F.slice(w, F.greatest(F.size(w) - 1, F.lit(1)), 2), " ")
    answer = (
        F.when(i % 5 == 0, F.array(absent))
        .when(i % 5 == 1, F.array(last_two, F.lit("zzqx")))
        .otherwise(F.array(_words(w, 2, 2), F.get(w, F.lit(4))))
    )
    half = F.array_join(F.slice(w, F.lit(1), F.floor(F.size(w) / 2).cast("int")), " ")
    kind = F.floor(i / 2) % 4
    first = F.get(F.col("answer"), F.lit(0))
    return qa_pairs(spark, sf).withColumn("answer", answer).select(
        "row_idx",
        F.concat(F.lit("k10_r"), (i % 2).cast("string")).alias("config"),
        "question",
        "answer",
        F.col("reply").alias("retrieved"),
        F.when(i % 15 == 0, F.concat(half, F.lit(" zzqx absent"))).otherwise(half).alias("summary"),
        F.when(kind == 0, first)
        .when(kind == 1, F.concat(F.upper(first), F.lit(".")))
        .when(kind == 2, F.concat(first, F.lit(",zz")))
        .otherwise(F.lit("nothing"))
        .alias("predicted"),
        F.lit(0.0).alias("score"),
    )


def nq_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as annotated articles; those of one source have no short answer."""
    span = "struct<start_token int, end_token int>"

    def tokens(a: int, b: int) -> Column:
        return F.struct(F.lit(a).alias("start_token"), F.lit(b).alias("end_token"))

    short = F.when(F.col("source") == UNANSWERED, F.array().cast(f"array<{span}>")).otherwise(F.array(tokens(5, 7)))
    return documents(spark, sf, "doc_id", "text", "source").select(
        F.col("doc_id").cast("string").alias("example_id"),
        F.col("text").alias("document_text"),
        _words(F.split("text", " ", -1), 1, 5).alias("question_text"),
        F.array(F.struct(tokens(3, 30).alias("long_answer"), short.alias("short_answers"))).alias("annotations"),
    )
