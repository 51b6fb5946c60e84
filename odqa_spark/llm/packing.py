"""Variable-capacity best-fit packing of token sequences.

Several sequence lengths are permitted. Texts longer than the largest are cut into pieces.
Pieces go, longest first, to the open bin that they fill best. If none has room, a bin is
opened in the size that costs least per token it can still be filled with, given what is left
to pack; the cost of a bin is its length plus a fixed overhead. At the end each bin shrinks to
the smallest permitted length that holds its contents.

Pieces are counted, then dealt in rounds to shards of equal size, whatever their keys are, and each
shard is packed on its own; a shard holds lengths and ids only.

Defined cases: texts without tokens get one row with bin null; ids may be null or repeat, each
row is packed for itself. Empty input: no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odqa_spark.llm.frames import materialize

SIZES = (512, 1024, 2048, 4096)
OVERHEAD = 64
SHARD_ROWS = 100_000


def word_count(text: Column) -> Column:
    """Tokens of a text: its words between white space."""
    trimmed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(trimmed == "", 0).otherwise(F.char_length(trimmed) - F.char_length(F.replace(trimmed, F.lit(" "), F.lit(""))) + 1)


def pack(lengths: np.ndarray, sizes: Sequence[int] = SIZES, overhead: int = OVERHEAD) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(bin of each piece, offset in it, length of each bin); every length lies between 1 and the largest size."""
    sizes = sorted(sizes)
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    used: list[int] = []
    size_of: list[int] = []
    rooms: list[int] = []  # the different amounts of room among open bins, ascending
    bins_with: dict[int, list[int]] = {}
    # tokens left in pieces of at most x, from the lengths still to come
    ascending = np.sort(lengths)
    total = np.concatenate([[0], np.cumsum(ascending)])
    taken = 0
    for i in order.tolist():
        need = int(lengths[i])
        at = bisect_left(rooms, need)
        if at < len(rooms):
            room = rooms[at]
            b = bins_with[room].pop()
            if not bins_with[room]:
                del bins_with[room]
                rooms.pop(at)
        else:
            best = None
            left = len(lengths) - taken - 1  # the shorter ones, a prefix of ``ascending``
            for size in sizes[bisect_left(sizes, need) :]:
                fits = min(left, int(np.searchsorted(ascending, size - need, "right")))
                cost = (size + overhead) / (need + min(size - need, int(total[fits])))
                if best is None or cost < best[0]:
                    best = (cost, size)
            b, room = len(used), best[1]
            used.append(0)
            size_of.append(best[1])
        where[i], offset[i] = b, used[b]
        used[b] += need
        room -= need
        if room:
            if room not in bins_with:
                insort(rooms, room)
                bins_with[room] = []
            bins_with[room].append(b)
        taken += 1
    return where, offset, [sizes[bisect_left(sizes, u)] for u in used]


def best_fit_packing(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    tokens: Column | None = None,
    sizes: Sequence[int] = SIZES,
    overhead: int = OVERHEAD,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(id_col, piece, token_start, n_tokens, bin_id, bin_size, bin_offset): one row per piece."""
    count = word_count(F.col(text)) if tokens is None else tokens
    largest = max(sizes)
    # tokens are counted once, for the number of pieces and for the pieces
    rows = materialize(docs.select(F.col(id_col).alias("id"), count.cast("bigint").alias("n")), "lengths")
    cuts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(largest).cast("bigint")))
    pieces = rows.select("id", "n", cuts.alias("token_start")).select("id", "token_start", F.least(F.col("n") - F.col("token_start"), F.lit(largest)).alias("n_tokens"))
    n_pieces = rows.agg(F.sum(F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("n") / largest))).alias("n")).first()["n"] or 0
    shards = max(1, -(-n_pieces // shard_rows))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).sort_by([("n_tokens", "descending"), ("id", "ascending"), ("token_start", "ascending")]).combine_chunks()
        n = t.column("n_tokens").to_numpy()
        full = int((n > 0).sum())
        where, offset, size = pack(n[:full], sizes, overhead)
        first = TaskContext.get().partitionId() << 32
        pad = [None] * (len(n) - full)
        size = np.array(size, np.int64)[where] if full else np.zeros(0, np.int64)
        start = t.column("token_start").to_numpy()
        columns = [
            t.column("id").combine_chunks(),
            pa.array(start // largest),
            pa.array(start),
            pa.array(n),
            pa.array([first + b for b in where.tolist()] + pad, pa.int64()),
            pa.array(size.tolist() + pad, pa.int64()),
            pa.array(offset.tolist() + pad, pa.int64()),
        ]
        yield from pa.Table.from_arrays(columns, names).to_batches(max_chunksize=10_000)

    names = [id_col, "piece", "token_start", "n_tokens", "bin_id", "bin_size", "bin_offset"]
    schema = f"`{id_col}` {kind}, " + ", ".join(f"{c} bigint" for c in names[1:])
    # equal shards by dealing rows in turn; Spark sorts before it, so a repeated task deals alike
    return pieces.repartition(shards).mapInArrow(run, schema)
