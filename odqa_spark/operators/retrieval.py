"""From ranked passage ids to the context of a question."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odqa_spark.operators.knn import topk_join
from odqa_spark.session import materialize

BROADCAST_BYTES = 64 << 20  # ranked ids up to this size are sent to every executor
FILTER_BITS = 1 << 24  # of the filter of ranked ids beyond that size: 2 MiB
PROBES = 3
ROW_BYTES = 48  # of a ranked row besides its ids


def passage_limit(top_k: int, ratio: int = 1, summarize: bool = False) -> int:
    """Passages to fetch per question."""
    return int(top_k) * ratio if summarize else int(top_k)


def may_hold(ids: DataFrame, column: str, key: Column, n_bits: int = FILTER_BITS) -> Column:
    """Whether ``key`` may be among the values of a column: a Bloom filter, made by Spark, as a scalar subquery.

    True for all that are, and for some that are not; its size does not depend on the data.
    """
    places = lambda c: [F.pmod(F.xxhash64(F.lit(i), c), F.lit(n_bits).cast("bigint")) for i in range(PROBES)]
    at = ids.select(F.explode(F.array(*places(F.col(column)))).alias("at"))
    # a row for every word, so that the place of a word in the array is its number
    every = ids.sparkSession.range(n_bits // 64).selectExpr("id AS word", "0L AS bits")
    words = at.selectExpr("at div 64 AS word", "shiftleft(1L, int(at % 64)) AS bits").unionByName(every)
    words = words.groupBy("word").agg(F.bit_or("bits").alias("bits"))
    whole = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"]).alias("words")).scalar()
    tests = [F.getbit(F.get(whole, F.shiftright(p, 6).cast("int")), (p % 64).cast("int")) == 1 for p in places(key)]
    return reduce(Column.__and__, tests)


def retrieve(
    questions: DataFrame, passages: DataFrame, limit: int, block_bytes: int = BROADCAST_BYTES, filter_bits: int = FILTER_BITS, **options
) -> DataFrame:
    """``q_id, p_id, rank, score, title, text``: ranked passages of every question.

    The search reads ids and vectors only. Its ranked ids are written to the shared
    folder: the search is not repeated when an executor is lost, and their size
    is known before the texts are fetched. Up to ``block_bytes`` of them are broadcast. More are
    joined by a shuffle, whose sides Spark chooses and splits by their sizes; a Bloom filter of
    the ranked ids, of ``filter_bits`` whatever their number, lets only few other texts leave
    their scan. The texts are scanned once in both cases.
    """
    found = materialize(topk_join(questions, passages, limit, **options), "ranked")
    wide = F.length(F.col("q_id").cast("string")) + F.length(F.col("p_id").cast("string")) + ROW_BYTES
    size = found.agg(F.sum(wide.cast("bigint")).alias("n")).first()["n"] or 0
    texts = passages.select("p_id", "title", "text")
    if size <= block_bytes:
        return texts.join(F.broadcast(found), "p_id")
    return texts.where(may_hold(found, "p_id", F.col("p_id"), filter_bits)).join(found, "p_id")


def collect_context(retrieved: DataFrame) -> DataFrame:
    """``q_id, psgs, retrieved``: texts in rank order as an array and joined by newlines.

    Groups hold at most the retrieval limit.
    """
    ordered = F.array_sort(F.collect_list(F.struct("rank", "text")))
    return (
        retrieved.groupBy("q_id")
        .agg(F.transform(ordered, lambda r: r["text"]).alias("psgs"))
        .withColumn("retrieved", F.array_join("psgs", "\n"))
    )
