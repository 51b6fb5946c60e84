"""Exact top-k inner products by a Voronoi kNN join.

Inner products become distances by one more coordinate: data vectors get
``sqrt(M^2 - |x|^2)`` (M the largest norm), queries 0, so the nearest neighbours are the
largest products. Both sides are cut into Voronoi cells around a bounded set of pivots. Per
cell a summary holds its radius, its row count and its ``k + 1`` smallest pivot distances.
From these alone every query cell gets an upper bound on the distance of its k-th neighbour,
and a data cell is sent to a query group only as far as the triangle inequality lets it hold
such a neighbour. Groups and the data sent to them are cut into blocks of bounded size, solved
locally and merged.

Defined cases: vectors that are null, or hold null or non-finite components, and rows with a
null id take no part; missing trailing components count as 0; components saturate at
+-2^31; scores are exact as long as they fit 53 bits. Equal scores go to the smaller id. Rows
that repeat an id count once, with their best score. No queries or no data: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odqa_spark.llm.frames import materialize

PIVOTS = 256
QUERIES_PER_GROUP = 512
ROWS_PER_BLOCK = 32_768
BLOCK_BYTES = 64 << 20
_LIMIT = float(1 << 31)
_SLACK = 1e-6  # relative, for distances in double precision


def scaled(vector: Column, factor: float) -> Column:
    """floor(factor * x) of every component as long; null unless all components are finite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform(x, lambda v: F.greatest(F.least(F.floor(v * factor).cast("double"), F.lit(_LIMIT)), F.lit(-_LIMIT)).cast("bigint"))
    return F.when(finite & (F.size(vector) >= 0), whole)


def _unpack(blobs, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.int64).reshape(-1, dim)


def _packed(df: DataFrame, id_col: str, vector: str, dim: int) -> DataFrame:
    """(id, vec): vectors as ``dim`` little-endian longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            sizes = np.asarray(pc.list_value_length(lists), np.int64)
            out = np.zeros((b.num_rows, dim), np.int64)
            row = np.repeat(np.arange(b.num_rows), sizes)
            col = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            out[row, col] = np.asarray(lists.flatten(), np.int64)
            raw = out.tobytes()
            width = dim * 8
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([raw[i * width : (i + 1) * width] for i in range(b.num_rows)], pa.binary())], ["id", "vec"]
            )

    ok = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).alias("v")).where("id is not null and v is not null")
    return ok.mapInArrow(run, "id bigint, vec binary")


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows (augmented, double) to pivots."""
    d = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2.0 * (x @ pivots.T)
    return np.sqrt(np.maximum(d, 0.0))


def _augmented(vecs: np.ndarray, top: float | None) -> np.ndarray:
    x = vecs.astype(np.float64)
    last = np.zeros(len(x)) if top is None else np.sqrt(np.maximum(top - (x * x).sum(1), 0.0))
    return np.concatenate([x, last[:, None]], 1)


def _celled(packed: DataFrame, dim: int, pivots: np.ndarray, top: float | None) -> DataFrame:
    """(id, vec, cell, dist): the nearest pivot of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            d = _distances(_augmented(_unpack(b.column(1).to_pylist(), dim), top), pivots)
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(cell)), cell])],
                ["id", "vec", "cell", "dist"],
            )

    return packed.mapInArrow(run, "id bigint, vec binary, cell int, dist double")


def _bounds(q_cells: pd.DataFrame, d_cells: pd.DataFrame, nearest: pd.DataFrame, pivots: np.ndarray, k: int) -> dict[int, dict[int, float]]:
    """Per query cell: the data cells it must see, each with the least pivot distance that counts."""
    between = _distances(pivots, pivots)
    n_cell, n_dist, n_id = (nearest[c].to_numpy() for c in ("cell", "dist", "id"))
    reach: dict[int, dict[int, float]] = {}
    for i, radius in zip(q_cells["cell"], q_cells["radius"]):
        up = radius + between[i][n_cell] + n_dist
        # k + 1 different ids within this distance: one of them may be the query itself
        order = np.lexsort((n_id, up))
        first = np.sort(np.unique(n_id[order], return_index=True)[1])[: k + 1]
        limit = up[order[first[-1]]] if len(first) > k else np.inf
        limit *= 1 + _SLACK
        seen = {}
        for j, far, near in zip(d_cells["cell"], d_cells["radius"], d_cells["near"]):
            gap = between[i][j] - radius - limit
            low = max(gap * (1 - _SLACK) if gap > 0 else 0.0, 0.0)
            # an object at distance s from pivot j is at least |s - between| - radius from every query
            if low <= far * (1 + _SLACK) and near - between[i][j] - radius <= limit * (1 + _SLACK):
                seen[int(j)] = low
        reach[int(i)] = seen
    return reach


def _local(k: int, dim: int):
    def solve(key: tuple[int, ...], q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        if not len(q) or not len(d):
            return empty
        x, y = _unpack(q["vec"], dim), _unpack(d["vec"], dim)
        q_id, d_id = q["id"].to_numpy(np.int64), d["id"].to_numpy(np.int64)
        order = np.argsort(d_id, kind="stable")
        d_id, y = d_id[order], y[order]
        head = np.flatnonzero(np.concatenate([[True], d_id[1:] != d_id[:-1]]))
        exact = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * max(dim, 1) < 2.0**53
        xf, yf = (x.astype(np.float64), y.T.astype(np.float64)) if exact else (x, y.T)
        found = []
        for a in range(0, len(x), 64):
            s = (xf[a : a + 64] @ yf).astype(np.int64)
            if len(head) < len(d_id):
                s = np.maximum.reduceat(s, head, axis=1)
            ids = d_id[head]
            for r in range(len(s)):
                own = ids != q_id[a + r]
                row, who = s[r][own], ids[own]
                if len(row) > k:
                    cut = np.partition(row, len(row) - k)[len(row) - k]
                    pick = np.flatnonzero(row >= cut)
                    pick = pick[np.lexsort((who[pick], -row[pick]))[:k]]
                    row, who = row[pick], who[pick]
                found.append((np.full(len(row), q_id[a + r]), who, row))
        if not found:
            return empty
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*found)))))

    return solve


def voronoi_knn_join(
    queries: DataFrame,
    data: DataFrame,
    k: int,
    id_col: str = "id",
    vector: str = "vector",
    pivots: int = PIVOTS,
    queries_per_group: int = QUERIES_PER_GROUP,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """The ``k`` largest inner products of every query with the other rows of ``data``.

    ``vector`` holds arrays of long (see ``scaled``). Returns query_id, rank, vec_id, score.
    The driver gets the pivots and the cell summaries: at most ``pivots`` * (k + 1) rows.
    """
    spark = data.sparkSession
    result = "query_id bigint, rank int, vec_id bigint, score bigint"
    size = F.max(F.size(vector))
    dim = max(data.agg(size.alias("n")).first().n or 0, queries.agg(size.alias("n")).first().n or 0)
    if dim <= 0:
        return spark.createDataFrame([], result)
    rows_per_block = max(1, min(rows_per_block, BLOCK_BYTES // (8 * dim)))
    d_packed = _packed(data, id_col, vector, dim)

    norm = F.aggregate(vector, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    top = data.agg(F.max(norm).alias("n")).first().n
    sample = d_packed.orderBy(F.xxhash64("id"), "id", "vec").limit(pivots).toPandas()
    if top is None or not len(sample):
        return spark.createDataFrame([], result)
    centers = np.unique(_augmented(_unpack(sample["vec"], dim), top), axis=0)

    d_cells = materialize(_celled(d_packed, dim, centers, top), "voronoi-data")
    q_once = _packed(queries, id_col, vector, dim).groupBy("id").agg(F.min("vec").alias("vec"))
    q_cells = materialize(_celled(q_once, dim, centers, None), "voronoi-queries")

    q_sum = q_cells.groupBy("cell").agg(F.max("dist").alias("radius"), F.count("*").alias("n")).orderBy("cell").toPandas()
    d_sum = d_cells.groupBy("cell").agg(F.max("dist").alias("radius"), F.min("dist").alias("near"), F.count("*").alias("n")).toPandas()
    once = d_cells.groupBy("cell", "id").agg(F.min("dist").alias("dist"))
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("dist", "id"))
    nearest = once.withColumn("rank", rank).where(F.col("rank") <= k + 1).drop("rank").toPandas()
    if not len(q_sum):
        return spark.createDataFrame([], result)
    reach = _bounds(q_sum, d_sum, nearest, centers, k)

    # neighbouring query cells share a group until it has enough queries; large cells are cut into chunks
    rows_in = dict(zip(d_sum["cell"], d_sum["n"]))
    groups: list[list[int]] = [[]]
    load = 0
    for cell, n in zip(q_sum["cell"], q_sum["n"]):
        if groups[-1] and load + n > queries_per_group:
            groups.append([])
            load = 0
        groups[-1].append(int(cell))
        load += n
    n_of = dict(zip(q_sum["cell"], q_sum["n"]))
    q_plan, d_plan = [], []
    for g, cells in enumerate(groups):
        chunks = -(-int(sum(n_of[c] for c in cells)) // queries_per_group)
        low: dict[int, float] = {}
        for c in cells:
            for j, least in reach[c].items():
                low[j] = min(least, low.get(j, np.inf))
        blocks = max(1, -(-int(sum(rows_in[j] for j in low)) // rows_per_block))
        q_plan += [(c, g, chunks, blocks) for c in cells]
        d_plan += [(j, g, chunks, blocks, float(least)) for j, least in low.items()]

    # both plans are bounded by the number of pivots and groups, not by rows
    q_rule = spark.createDataFrame(q_plan, "cell int, g int, chunks int, blocks int")
    d_rule = spark.createDataFrame(d_plan, "cell int, g int, chunks int, blocks int, low double")
    slot = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    q_sent = q_cells.join(F.broadcast(q_rule), "cell").select(
        "g", slot.alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", "vec"
    )
    part = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    d_sent = (
        d_cells.join(F.broadcast(d_rule), "cell")
        .where(F.col("dist") >= F.col("low"))
        .select("g", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), part.alias("block"), "id", "vec")
    )
    keys = ["g", "chunk", "block"]
    local = q_sent.groupBy(*keys).cogroup(d_sent.groupBy(*keys)).applyInPandas(_local(k, dim), "query_id bigint, vec_id bigint, score bigint")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return local.select("query_id", best.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
