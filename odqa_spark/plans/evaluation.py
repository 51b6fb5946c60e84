"""Evaluation of published runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from odqa_spark.operators.evaluate import rescore, run_metrics
from odqa_spark.session import materialize
from odqa_spark.sources.tables import filter_configs, publish


def evaluate_published(
    spark: SparkSession, root: str, contain: str | None = None, exclude: str | None = None, upload: bool = False,
    metric: str = "squad", **columns,
) -> DataFrame:
    """Metrics of the configurations below ``root`` whose names pass the filters, in one job.

    ``upload`` also publishes these runs again with the exact-match score. They
    are written elsewhere first, as the folders they come from are replaced.
    """
    runs = filter_configs(spark.read.parquet(root), contain, exclude)
    if upload:
        publish(materialize(rescore(runs, **columns), "rescored"), root)
        runs = filter_configs(spark.read.parquet(root), contain, exclude)
    return run_metrics(runs, metric=metric, **columns)
