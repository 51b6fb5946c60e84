"""Corpus length profile: per-row lengths and fixed-bucket histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odqa_spark.functions.text import embed_input
from odqa_spark.functions.tokens import Tokenizer, default_tokenizer

# Right-closed upper edges; a last open bucket follows.
TOKEN_EDGES = [128, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768, 65536, 128000]
CHAR_EDGES = [512, 1024, 2048, 4096, 8192, 16384, 32768, 65536]


def bucket_labels(edges: list[int]) -> list[str]:
    inner = [f"{a}~{b}" for a, b in zip(edges, edges[1:])]
    return [f"~{edges[0]}", *inner, f"{edges[-1]}~"]


def token_stats(articles: DataFrame, tokenizer: Tokenizer | None = None) -> DataFrame:
    """``id, title, text, token_length, text_length``; tokens of title and text, characters of text.

    A missing title or text counts as empty.
    """
    tok = tokenizer or default_tokenizer()
    return articles.select(
        "id",
        "title",
        "text",
        tok.count(embed_input(F.col("title"), F.col("text"))).alias("token_length"),
        F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("text_length"),
    )


def _bucket_counts(length: Column, edges: list[int]) -> list[Column]:
    tests = [length <= edges[0]]
    tests += [(length > low) & (length <= high) for low, high in zip(edges, edges[1:])]
    tests.append(length > edges[-1])
    return [F.count_if(t) for t in tests]


def histogram_row(stats: DataFrame) -> DataFrame:
    """Both histograms and the row count in one row: ``total, token_counts, char_counts``.

    One global aggregate with map-side partial sums: no shuffle by bucket, no
    join with a bucket list, and empty buckets are 0. Works on streams too.
    """
    tokens = _bucket_counts(F.col("token_length"), TOKEN_EDGES)
    chars = _bucket_counts(F.col("text_length"), CHAR_EDGES)
    return stats.agg(
        F.count_if(F.col("token_length").isNotNull()).alias("total"),
        F.array(*tokens).alias("token_counts"),
        F.array(*chars).alias("char_counts"),
    )


def histogram_table(row: DataFrame, counts: str, edges: list[int]) -> DataFrame:
    """``bucket_no, bucket, n, pct`` of one histogram; pct is null for an empty table.

    The token total is the denominator of both histograms.
    """
    labels = F.array(*[F.lit(b) for b in bucket_labels(edges)])
    return row.select("total", F.posexplode(counts).alias("bucket_no", "n")).select(
        "bucket_no",
        F.element_at(labels, F.col("bucket_no") + 1).alias("bucket"),
        F.col("n").cast("bigint").alias("n"),
        F.try_divide(F.lit(100.0) * F.col("n"), F.col("total")).alias("pct"),
    )


def token_histogram(stats: DataFrame) -> DataFrame:
    return histogram_table(histogram_row(stats), "token_counts", TOKEN_EDGES)


def char_histogram(stats: DataFrame) -> DataFrame:
    return histogram_table(histogram_row(stats), "char_counts", CHAR_EDGES)


def percent_text(pct: Column) -> Column:
    """Display form of a percentage."""
    return F.format_string("%.2f%%", pct)


def percent_map(histogram: DataFrame) -> DataFrame:
    """One row with the map bucket -> percent text, in bucket order."""
    entries = F.array_sort(F.collect_list(F.struct("bucket_no", "bucket", percent_text(F.col("pct")).alias("text"))))
    return histogram.agg(
        F.map_from_entries(F.transform(entries, lambda e: F.struct(e["bucket"], e["text"]))).alias("percent")
    )
