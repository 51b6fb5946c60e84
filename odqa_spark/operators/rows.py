"""Row positions and positional access."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from odqa_spark.session import materialize, scratch_path

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in its lower 33 bits


@dataclass
class NumberedRows:
    """A stored table in row order: one folder per partition, and how many rows each has."""

    stored: DataFrame
    counts: list[tuple[int, int]]  # (partition, rows), partitions in order

    def _offsets(self) -> list[tuple[int, int, int]]:
        ends = list(accumulate(n for _, n in self.counts))
        return [(part, end - n, n) for (part, n), end in zip(self.counts, ends)]

    def frame(self) -> DataFrame:
        """All rows with ``row_idx``."""
        return self._numbered(self.stored, self._offsets())

    def slice(self, start: int | None = None, end: int | None = None) -> DataFrame:
        """Rows ``[start, end)`` with ``row_idx``; only the partitions that hold some of them are read."""
        first = max(int(start or 0), 0)
        hit = [(p, at, n) for p, at, n in self._offsets() if at + n > first and (end is None or at < int(end))]
        rows = self.stored.where(F.col("_part").isin([p for p, _, _ in hit]))
        # only the first and the last of them can hold rows outside the range
        if hit and first > hit[0][1]:
            rows = rows.where((F.col("_part") != hit[0][0]) | (F.col("_pos") >= first - hit[0][1]))
        if hit and end is not None and int(end) < hit[-1][1] + hit[-1][2]:
            rows = rows.where((F.col("_part") != hit[-1][0]) | (F.col("_pos") < int(end) - hit[-1][1]))
        return self._numbered(rows, hit)

    def _numbered(self, rows: DataFrame, offsets: list[tuple[int, int, int]]) -> DataFrame:
        # one row per partition of the write: bounded by the number of shuffle partitions
        known = rows.sparkSession.createDataFrame([(p, at) for p, at, _ in offsets], "_part bigint, _offset bigint")
        joined = rows.join(F.broadcast(known), "_part")
        return joined.withColumn("row_idx", F.col("_pos") + F.col("_offset")).drop("_part", "_pos", "_offset")


def _in_parts(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` range-partitioned by ``keys``, with the partition of each row and its place in it."""
    return (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_mid", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_mid", _ROW_BITS))
        .withColumn("_pos", F.col("_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
        .drop("_mid")
    )


def numbered_rows(df: DataFrame, *keys: str, path: str | None = None) -> NumberedRows:
    """The rows of ``df`` in the order of ``keys``, which must identify a row, stored for positional access.

    As ``with_row_idx``, but stored in a folder for each partition, so that a range of positions reads
    only the partitions it lies in.
    """
    numbered = _in_parts(df, *keys)
    path = path or scratch_path(df.sparkSession, "row-idx")
    numbered.write.partitionBy("_part").parquet(path)
    stored = df.sparkSession.read.schema(numbered.schema).parquet(path)
    counts = stored.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect()
    return NumberedRows(stored, [(r["_part"], r["n"]) for r in counts])


def with_row_idx(df: DataFrame, *keys: str, path: str | None = None) -> DataFrame:
    """Add a dense 0-based ``row_idx`` in the order of ``keys``, which must identify a row.

    Rows are range-partitioned by the whole key (a repeated first key column is
    split by the next ones) and numbered inside their partition; the numbered
    table is written to the shared folder, so partition numbers cannot change on
    a retry. Only one count per partition goes through a window. With ``path`` the
    numbered table is written there, for the caller to keep; otherwise it goes with
    the application.
    """
    numbered = _in_parts(df, *keys)
    if path is None:
        stored = materialize(numbered, "row-idx")
    else:
        numbered.write.parquet(path)
        stored = df.sparkSession.read.schema(numbered.schema).parquet(path)
    # one row per partition of the write: bounded by the number of shuffle partitions
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        stored.groupBy("_part").agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        stored.join(F.broadcast(offsets), "_part")
        .withColumn("row_idx", F.col("_pos") + F.col("_offset"))
        .drop("_part", "_pos", "_offset")
    )


def _positional(df: DataFrame) -> None:
    if "row_idx" not in df.columns:
        raise ValueError("positional access needs a row_idx column; see with_row_idx")


def row_slice(df: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Rows ``[start, end)`` by ``row_idx``: a filter that reaches the scan of a stored table."""
    _positional(df)
    if end is not None:
        df = df.where(F.col("row_idx") < int(end))
    if start is not None:
        df = df.where(F.col("row_idx") >= int(start))
    return df


def row_range_inclusive(df: DataFrame, start: int, end: int) -> DataFrame:
    """Rows ``start`` to ``end`` counted from 1, both included; start 0 means 1."""
    return row_slice(df, max(int(start) - 1, 0), int(end))


_SPLIT = re.compile(r"(\w+)(?:\[(\d*):(\d*)\])?")


def split_range(expression: str) -> tuple[str, int | None, int | None]:
    """``train[10630000:]`` -> ``("train", 10630000, None)``."""
    m = _SPLIT.fullmatch(expression.strip())
    if not m:
        raise ValueError(f"not a split expression: {expression!r}")
    bound = [int(x) if x else None for x in (m[2], m[3])]
    return m[1], bound[0], bound[1]


def join_by_position(rows: DataFrame, earlier: DataFrame, column: str, alias: str) -> DataFrame:
    """Bring ``column`` of an earlier run to the rows at the same position.

    A position that the earlier run lacks fails the job: no row is lost in silence.
    """
    _positional(rows)
    _positional(earlier)
    found = earlier.select("row_idx", F.col(column).alias(alias), F.lit(True).alias("_found"))
    joined = rows.join(found, "row_idx", "left")
    lacks = F.concat(F.lit("the earlier run lacks row "), F.col("row_idx").cast("string"))
    return joined.where(F.assert_true(F.coalesce("_found", F.lit(False)), lacks).isNull()).drop("_found")
