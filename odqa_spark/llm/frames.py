"""Shared pieces: bounded Arrow slices, fixed-size key sketches, hash folds, whole-table helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from odqa_spark.session import materialize, scratch_path  # noqa: F401

SLICE_BYTES = 1 << 19
SLICE_ROWS = 2048


def fold(doc_id: str, parts: int) -> Column:
    """Remainder of crc32 of the id as text: the fixed split of rows into folds (null for a null id)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string or binary column with about ``limit`` bytes each, one row at least, ``SLICE_ROWS`` at most."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)
    at, n = 0, len(sizes)
    ends = np.cumsum(sizes)
    while at < n:
        base = ends[at - 1] if at else 0
        to = min(max(at + 1, int(np.searchsorted(ends, base + limit, "right"))), at + SLICE_ROWS)
        yield at, to
        at = to


def map_slices(
    df: DataFrame, text: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, limit: int = SLICE_BYTES
) -> DataFrame:
    """``fn`` on slices of ``df`` with a bounded number of bytes in the column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(text), limit):
                out = fn(batch.slice(a, b - a))
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


class KeySketch:
    """A Bloom filter of 64-bit keys with a fixed number of bits.

    Its size does not depend on the data, so it may be sent to every task. It has no false
    negatives; what passes is to be joined exactly afterwards. With more keys than it is made for,
    more rows pass, never fewer, so nothing may be concluded from a row that passes.
    """

    PROBES = 3

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def _positions(keys: np.ndarray, n_bits: int) -> list[np.ndarray]:
        with np.errstate(over="ignore"):
            h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            step = (h >> np.uint64(32)) | np.uint64(1)
            return [((h >> np.uint64(7)) + np.uint64(i) * step) % np.uint64(n_bits) for i in range(KeySketch.PROBES)]

    @classmethod
    def of(cls, keys: DataFrame, column: str, n_bits: int = 1 << 24) -> "KeySketch":
        """Built by the tasks; the driver gets at most ``n_bits`` / 64 words."""

        def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                k = np.asarray(batch.column(0)).view(np.uint64)
                at = np.unique(np.concatenate(cls._positions(k, n_bits)))
                bit = np.left_shift(np.uint64(1), at % np.uint64(64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((at // np.uint64(64)).astype(np.int64)), pa.array(bit)], ["word", "bit"])

        found = keys.where(F.col(column).isNotNull()).select(F.col(column).cast("bigint").alias("k"))
        rows = found.mapInArrow(words, "word bigint, bit bigint").groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
        bits = np.zeros(n_bits // 64, np.uint64)
        bits[rows.column("word").to_numpy()] = rows.column("bit").to_numpy().view(np.uint64)
        return cls(bits)

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        n_bits = len(self.bits) * 64
        keep = np.ones(len(keys), bool)
        for at in self._positions(keys.view(np.uint64), n_bits):
            keep &= (self.bits[at // np.uint64(64)] >> (at % np.uint64(64))) & np.uint64(1) == 1
        return keep


def list_array(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """A list column from flat values and the number of values per row."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)
