"""Index job: articles to validated rows of the vector table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odqa_spark.functions.text import embed_input
from odqa_spark.operators.models import Counters, embed_if_missing
from odqa_spark.operators.rows import NumberedRows, row_slice
from odqa_spark.operators.vector_table import FATE, append_passages, create_if_absent, left_to_load, with_fate
from odqa_spark.schemas import TEXT_MAX, VECTOR_DIM


def vector_rows(articles: DataFrame, prefix: str = "", make_fn=None, max_tokens: int | None = None) -> DataFrame:
    """``id, vec, title, text``; stored ``embeddings`` are reused."""
    text = embed_input(F.col("title"), F.col("text"), prefix)
    keep = [c for c in articles.columns if c in FATE]
    return embed_if_missing(articles, text, make_fn, max_tokens=max_tokens).select("id", "vec", "title", "text", *keep)


def load_index(
    articles: DataFrame | NumberedRows, table: str, path: str, start_index: int | None = None, end_index: int | None = None,
    prefix: str = "", make_fn=None, dim: int = VECTOR_DIM, max_text: int = TEXT_MAX, method: str = "exact",
    mode: str = "skip_existing", max_tokens: int | None = None,
) -> dict[str, int]:
    """Create the table if absent, then append the rows of a position range; returns the counts of ``append_articles``.

    With ``skip_existing`` rows that the table holds are left out before anything
    is embedded, so a load that is run again calls the model for new rows only. Of
    ``NumberedRows`` only the partitions of the range are read.
    """
    ranged = start_index is not None or end_index is not None
    if isinstance(articles, NumberedRows):
        articles = articles.slice(start_index, end_index)
    elif ranged:
        articles = row_slice(articles, start_index, end_index)
    create_if_absent(articles.sparkSession, table, path, method)
    return append_articles(articles, table, prefix, make_fn, dim, max_text, mode, max_tokens)


def append_articles(
    articles: DataFrame, table: str, prefix: str = "", make_fn=None, dim: int = VECTOR_DIM, max_text: int = TEXT_MAX,
    mode: str = "skip_existing", max_tokens: int | None = None,
) -> dict[str, int]:
    """Decide what becomes of each row, embed what is new, and append it.

    Returns counts that the same pass made: ``rows`` of the load, those ``held`` by the table,
    ``embedded`` by the model, ``accepted``, ``rejected``, and of these ``duplicate``.
    """
    before = Counters(rows=F.count(F.lit(1)), held=F.count_if(F.col("held_accepted") | F.col("held_rejected")))
    rows = before.on(with_fate(articles, table))
    if mode == "skip_existing":
        rows = left_to_load(rows, max_text)
    fresh = Counters(embedded=F.count_if(F.col("embeddings").isNull() if "embeddings" in rows.columns else F.lit(True)))
    written = append_passages(vector_rows(fresh.on(rows), prefix, make_fn, max_tokens), table, dim, max_text, mode)
    return before.counts | fresh.counts | written
