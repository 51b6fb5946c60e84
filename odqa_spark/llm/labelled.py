"""A bounded sample of labelled rows, with their texts, for fitting a model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odqa_spark.llm.frames import materialize


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, per_class: int, usable: Column, id_col: str = "doc_id", text: str = "text", max_classes: int = 64
) -> tuple[DataFrame, dict[int, float]]:
    """((id, text, y), rows per class): up to ``per_class`` rows of each label value, by hash of the id.

    The sample has at most ``per_class * max_classes`` ids, so it is sent to the scan of the
    texts; these do not move. The counts cover all usable labels. Of rows that repeat an id one is
    taken, and of an id with two labels the larger.
    """
    named = labels.where(usable & F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("y"))
    counts = {int(r["y"]): float(r["count"]) for r in named.groupBy("y").count().orderBy("y").limit(max_classes + 1).collect()}
    if len(counts) > max_classes:
        raise ValueError(f"more than {max_classes} label values")
    if not counts:
        return docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"), F.lit(0).alias("y")).limit(0), {}
    parts = [named.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class) for y in counts]
    picked = materialize(reduce(DataFrame.unionByName, parts), "sample-ids")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    found = rows.join(F.broadcast(picked), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    return materialize(found.select("id", "text", "y"), "sample"), counts
