"""Corpus jobs: cut a corpus into passages, profile its lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odqa_spark.functions.tokens import Tokenizer
from odqa_spark.operators.chunk import token_chunks
from odqa_spark.operators.profile import CHAR_EDGES, TOKEN_EDGES, histogram_row, histogram_table, percent_map, token_stats
from odqa_spark.session import materialize
from odqa_spark.sources.tables import publish


def split_corpus(articles: DataFrame, root: str, config: str, window: int = 256, tokenizer: Tokenizer | None = None) -> None:
    """Publish the token-window passages of ``articles``."""
    publish(token_chunks(articles, window, tokenizer), root, config)


def profile_corpus(
    articles: DataFrame, root: str, config: str, tokenizer: Tokenizer | None = None
) -> tuple[DataFrame, DataFrame]:
    """Publish the per-row lengths, then give the token and character percentages from them."""
    publish(token_stats(articles, tokenizer), root, config)
    stored = articles.sparkSession.read.parquet(root).where(F.col("config") == config)
    # one pass over the lengths: both maps come from its single row
    row = materialize(histogram_row(stored), "histogram")
    return (
        percent_map(histogram_table(row, "token_counts", TOKEN_EDGES)),
        percent_map(histogram_table(row, "char_counts", CHAR_EDGES)),
    )
