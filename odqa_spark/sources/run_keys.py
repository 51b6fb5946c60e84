"""Names of runs and of published tables, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from odqa_spark.functions.text import model_name


def run_key(
    db: Column, collection: Column, top_k: Column, reader: Column,
    summarizer: Column | None = None, ratio: Column | None = None,
) -> Column:
    """``db.collection.k_reader`` or ``db.collection.k_summarizer.ratio_reader``; owner parts are dropped."""
    base = F.concat_ws(".", db, collection, top_k.cast("string"))
    if summarizer is None:
        return F.concat_ws("_", base, model_name(reader))
    return F.concat_ws("_", base, F.concat_ws(".", model_name(summarizer), ratio.cast("string")), model_name(reader))


def next_version(key: Column) -> Column:
    """``key`` -> ``key^2``, ``key^n`` -> ``key^(n+1)``."""
    parts = F.split(key, r"\^", -1)
    bumped = F.concat(parts[0], F.lit("^"), (F.get(parts, F.lit(1)).cast("int") + 1).cast("string"))
    return F.when(F.size(parts) == 1, F.concat(key, F.lit("^2"))).when(F.size(parts) == 2, bumped).otherwise(key)


def split_table_name(user: Column, dataset: Column, split: Column) -> Column:
    """Name of a chunked corpus: ``user/dataset-split``."""
    return F.concat(user, F.lit("/"), dataset, F.lit("-"), split.cast("string"))


def count_table_name(user: Column, dataset: Column) -> Column:
    """Name of a token-count table: the dataset's own name, with the user only if it has no owner."""
    owned = F.contains(dataset, F.lit("/"))
    return F.concat(F.when(owned, F.split_part(dataset, F.lit("/"), F.lit(2))).otherwise(F.concat(user, F.lit("/"), dataset)), F.lit("-token"))
