"""Reading and publishing tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from odqa_spark.operators.rows import row_slice, split_range
from odqa_spark.schemas import NQ_RAW
from odqa_spark.session import hadoop_path


def read_dataset(
    spark: SparkSession, root: str, config: str | None = None, split: str | None = None, only_split: str = "train"
) -> DataFrame:
    """A published table, one configuration of it, and a row range of that.

    ``split`` is a name with an optional range, such as ``train[100:200]``; the
    configuration filter prunes folders, the range filter reaches the scan. A table
    without a ``split`` column is one split, named ``only_split``; any other name is refused.
    """
    df = spark.read.parquet(root)
    if config is not None:
        df = df.where(F.col("config") == config)
    if split is not None:
        name, start, end = split_range(split)
        if "split" in df.columns:
            df = df.where(F.col("split") == name)
        elif name != only_split:
            raise ValueError(f"{root} has no split column: its rows are the split {only_split!r}, not {name!r}")
        if start is not None or end is not None:
            df = row_slice(df, start, end)
    return df


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType = NQ_RAW) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_parquet_folder(spark: SparkSession, folder: str) -> DataFrame:
    """All Parquet files of a folder as one table: scan and bag union in one read."""
    return spark.read.parquet(folder)


def stream_parquet(
    spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None, pattern: str | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """Parquet files as a stream; ``max_files`` or ``max_bytes`` (one of them) per trigger throttles it."""
    reader = spark.readStream.schema(schema)
    if max_bytes is not None:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)


def list_configs(spark: SparkSession, root: str) -> list[str]:
    """Configurations of a published table, from its folder names: no row is read."""
    fs, path = hadoop_path(spark, root)
    if not fs.exists(path):
        return []
    names = [e.getPath().getName() for e in fs.listStatus(path) if e.isDirectory()]
    unescape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    return sorted(unescape(n.removeprefix("config=")) for n in names if n.startswith("config="))


def filter_configs(df: DataFrame, contain: str | None = None, exclude: str | None = None) -> DataFrame:
    """Configurations whose name contains one text and not another; an empty text filters nothing."""
    if contain:
        df = df.where(F.contains("config", F.lit(str(contain))))
    if exclude:
        df = df.where(~F.contains("config", F.lit(str(exclude))))
    return df


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def publish(df: DataFrame, root: str, config: str | None = None) -> None:
    """Write ``df`` below ``root``, one folder per configuration, replacing only those it has.

    Every task writes to the folders it has rows for, so one large configuration
    is written by many tasks.
    """
    if config is not None:
        df = df.withColumn("config", F.lit(config))
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("config").parquet(root)


def union_all(*tables: DataFrame) -> DataFrame:
    """Bag union by column name."""
    first, *rest = tables
    for t in rest:
        first = first.unionByName(t)
    return first


def range_file_name(start: Column | int, end: Column | int) -> str:
    """File name of the summaries made for rows ``start`` to ``end``."""
    return f"chatgpt-nq_{start}-{end}"
