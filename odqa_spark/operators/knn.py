"""Exact top-k join of question vectors with passage vectors."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from odqa_spark.functions.vectors import as_double, finite, squared_norm, with_aux_dim
from odqa_spark.session import materialize

BROADCAST_BYTES = 64 << 20  # question matrices up to this size are sent to every executor; blocks of larger joins have it too
BLOCK_BYTES = 64 << 20  # largest score matrix or product held at once inside a task
TILE = (256, 512)  # questions and passages scored at once: their scores stay in a core's cache
GROUP = 4096  # questions whose candidates are ranked together
PENDING = 1 << 17  # candidates of a group that wait to be ranked
TASKS_PER_CORE = 2  # of a round of blocks
ROWS_OUT = 1 << 16  # of an Arrow batch of winners
FLOOR_QUESTIONS = 4096  # from so many on, a share of the passages is searched first
FLOOR_SHARE = 16  # one in so many passages
NORM_CLASSES = 16  # passages are cut into blocks within so many classes of their norm
ROUND_GROWTH = 8  # each round of blocks is so many times the one before
SLACK = 1e-9  # relative; rounding of norms and scores stays far below it
MERGE_PARTS = 64  # task winners of one question meet in so many places before they meet in one


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.empty((0, 0))
    flat = np.asarray(column.flatten())
    flat = flat if flat.dtype == np.float32 else flat.astype(np.float64, copy=False)
    if flat.size % len(column):
        raise ValueError("vectors must all have the same length")
    return flat.reshape(len(column), -1)


def _exact(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Scores of aligned rows, summed from the left: the same on any batch or block layout."""
    a, b = a.astype(np.float64, copy=False), b.astype(np.float64, copy=False)
    terms = a * b if metric == "ip" else (a - b) ** 2
    total = np.cumsum(terms, axis=1)[:, -1]
    return total if metric == "ip" else -np.sqrt(total)


class _TopK:
    """Running best ``k`` passages of every question, ties to the lower passage id."""

    def __init__(self, questions: np.ndarray, k: int, metric: str, floor: np.ndarray | None = None):
        self.q, self.k, self.metric = questions, k, metric
        self.floor = np.full(len(questions), -np.inf) if floor is None else floor.copy()
        # question, score, passage, by group; the first batch sets the type of the ids
        self.groups: list[tuple[np.ndarray, ...] | None] = [None] * -(-len(questions) // GROUP)
        self.q_sq = np.square(questions, dtype=np.float64).sum(axis=1)
        self.q_max = self.q_sq[np.isfinite(self.q_sq)].max(initial=0.0)
        self.seen = 0
        self._cast = questions

    @property
    def held(self) -> tuple[np.ndarray, ...] | None:
        found = [g for g in self.groups if g is not None]
        return tuple(np.concatenate(c) for c in zip(*found)) if found else None

    @property
    def best(self) -> pd.DataFrame | None:
        held = self.held
        if held is None:
            return None
        q, score, p = held
        order = np.lexsort((_order(p), -score, q))
        return pd.DataFrame({"q": q[order], "score": score[order], "p": p[order]})

    def add(self, ids: np.ndarray, passages: np.ndarray) -> None:
        if not len(ids) or not len(self.q):
            return
        p_sq = np.square(passages, dtype=np.float64).sum(axis=1)
        if not np.isfinite(p_sq).all():
            finite = np.isfinite(p_sq)
            return self.add(ids[finite], passages[finite])
        # Products only pick candidates, so single precision will do for inner products. The margin is
        # twice the error bound of a sum of products; what lies within it is scored exactly.
        q_max, p_max = np.sqrt(self.q_max), np.sqrt(p_sq.max())
        single = self.metric == "ip" and max(q_max, p_max) < 1e15
        kind = np.float32 if single else np.float64
        scale = q_max * p_max if self.metric == "ip" else (q_max + p_max) ** 2
        margin = 4.0 * (passages.shape[1] + 4) * np.finfo(kind).eps * scale + np.finfo(kind).tiny
        if self._cast.dtype != kind:
            self._cast = self.q.astype(kind, copy=False)
        cast = passages.astype(kind, copy=False)
        # Scores of a part rank before the next one, so that few of its passages reach the score of
        # the best so far; parts grow with what was seen, so they are few.
        for group in range(len(self.groups)):
            at = 0
            while at < len(ids):
                part = slice(at, at + max(TILE[1], 4 * self.k, 3 * (self.seen + at)))
                self._add_part(group, ids[part], passages[part], cast[part], p_sq[part], margin)
                at = part.stop
        self.seen += len(ids)

    def _add_part(self, group: int, ids: np.ndarray, passages: np.ndarray, cast: np.ndarray, p_sq: np.ndarray, margin: float) -> None:
        wide = min(len(ids), max(TILE[1], 4 * self.k))
        high = max(1, min(TILE[0], BLOCK_BYTES // (8 * wide)))
        scores = np.empty((high, wide), self._cast.dtype)
        found, pending = [], 0
        end = min(len(self.q), (group + 1) * GROUP)
        for left in range(0, len(ids), wide):
            some = cast[left : left + wide].T
            for lo in range(group * GROUP, end, high):
                tile = slice(lo, min(lo + high, end))
                near = np.matmul(self._cast[tile], some, out=scores[: tile.stop - lo, : some.shape[1]])
                floor = self.floor[tile]
                if self.metric == "l2":
                    near = 2 * near - self.q_sq[tile, None] - p_sq[left : left + wide]
                    floor = np.where(np.isfinite(floor), -(floor**2), floor)
                if near.shape[1] > self.k and np.isneginf(floor).any():
                    floor = np.maximum(floor, np.partition(near, near.shape[1] - self.k, axis=1)[:, near.shape[1] - self.k])
                # the best of a tile's passages tells for most questions that none reaches the floor
                least = (floor - margin).astype(near.dtype)
                some_q = np.flatnonzero(~(near.max(axis=1) < least))
                hits = np.flatnonzero(near[some_q] >= least[some_q, None])
                if len(hits):
                    qi, pi = np.divmod(hits, near.shape[1])
                    found.append((some_q[qi] + lo, pi + left))
                    pending += len(hits)
                if pending >= PENDING:
                    self._rank(group, found, ids, passages)
                    found, pending = [], 0
        self._rank(group, found, ids, passages)

    def _rank(self, group: int, found: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, passages: np.ndarray) -> None:
        """Score candidates exactly and rank them among what their questions have."""
        if not found:
            return
        q, at = (np.concatenate(c) for c in zip(*found))
        pairs = max(1, BLOCK_BYTES // (16 * passages.shape[1]))
        score = np.concatenate([
            _exact(self.metric, self.q[q[lo : lo + pairs]], passages[at[lo : lo + pairs]]) for lo in range(0, len(q), pairs)
        ])
        p, rest, held = ids[at], None, self.groups[group]
        if held is not None:
            asked = np.zeros(GROUP, bool)
            asked[q - group * GROUP] = True
            again = asked[held[0] - group * GROUP]
            rest = [c[~again] for c in held]
            q, score, p = (np.concatenate([c[again], new]) for c, new in zip(held, (q, score, p)))
        order = np.lexsort((_order(p), -score, q))
        q, score, p = q[order], score[order], p[order]
        first = np.flatnonzero(np.diff(q, prepend=-1))
        rank = np.arange(len(q)) - np.repeat(first, np.diff(first, append=len(q)))
        last, keep = rank == self.k - 1, rank < self.k
        self.floor[q[last]] = np.maximum(self.floor[q[last]], score[last])
        kept = (q[keep], score[keep], p[keep])
        self.groups[group] = kept if rest is None else tuple(np.concatenate(c) for c in zip(rest, kept))


def _order(ids: np.ndarray) -> np.ndarray:
    """Numbers in the order of the ids."""
    return pd.factorize(ids, sort=True)[0] if ids.dtype == object else ids


def _result(top: _TopK, q_ids: pa.Array, schema: pa.Schema) -> pa.Table:
    held = top.held
    if held is None:
        return schema.empty_table()
    q, score, p = held
    return pa.table(
        [
            q_ids.take(pa.array(q, pa.int64())).cast(schema.field(0).type),
            pa.array(p.tolist() if p.dtype == object else p).cast(schema.field(1).type),
            pa.array(score, pa.float64()),
        ],
        schema=schema,
    )


def _ids(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def topk_join(
    questions: DataFrame,
    passages: DataFrame,
    k: int,
    metric: str = "ip",
    dim: int | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``q_id, p_id, score, rank``: the ``k`` best passages of every question.

    Takes ``q_id, q_vec`` and ``p_id, p_vec`` (ids unique, vectors of one length).
    Null vectors and vectors with NaN or infinite parts have no rank.
    ``metric`` is ``ip`` (larger is better) or ``l2`` (score is the negated distance).
    ``dim``, if known, saves a look at the first question.

    A question matrix of up to ``broadcast_bytes`` is sent to every executor: passage
    vectors are not shuffled then, every task multiplies its Arrow batches with the
    matrix and emits its own ``k`` best per question. Task winners are ranked in two
    steps, first among the tasks of a part, then by question. Many questions are searched for
    in a share of the passages first: the score of their ``k`` best there is known to
    all tasks, which then rank only what reaches it. More questions meet the
    passages in blocks (``_block_join``); the driver then gets counts and norms of blocks,
    never a question. Both sides are read more than once, so computed vectors should be
    stored before.
    """
    if metric not in ("ip", "l2"):
        raise ValueError(f"metric must be 'ip' or 'l2', not {metric!r}")
    q, p = _vectors(questions, "q_id", "q_vec"), _vectors(passages, "p_id", "p_vec")
    schema = T.StructType([
        T.StructField("q_id", q.schema["q_id"].dataType),
        T.StructField("p_id", p.schema["p_id"].dataType),
        T.StructField("score", T.DoubleType()),
    ])
    # counting stops at one row more than fits
    max_rows = max(1, broadcast_bytes // (8 * (dim or _dimension(q))))
    if q.limit(max_rows + 1).count() > max_rows:
        return _block_join(q, p, k, metric, schema, max_rows)
    head, floor = q.toArrow(), None
    if head.num_rows >= FLOOR_QUESTIONS:
        p = materialize(p, "vectors")
        floor = _floors(head, p, k, metric, schema)
    return _merged(_block_topk(head, p, k, metric, schema, floor), k)


def _floors(head: pa.Table, p: DataFrame, k: int, metric: str, schema: T.StructType) -> np.ndarray:
    """A score that ``k`` passages reach for every question, from a share of the passages; the driver has the questions and gets a number for each."""
    share = p.where(F.pmod(F.xxhash64("p_id"), F.lit(FLOOR_SHARE)) == 0)
    found = _merged(_block_topk(head, share, k, metric, schema), k).where((F.col("rank") == k) & ~F.isnan("score"))
    found = found.select("q_id", "score").toArrow()
    at = pc.index_in(head.column("q_id").combine_chunks(), value_set=found.column("q_id").combine_chunks())
    return found.column("score").combine_chunks().take(at).fill_null(-np.inf).to_numpy(zero_copy_only=False)


def _merged(partial: DataFrame, k: int) -> DataFrame:
    part = F.pmod(F.spark_partition_id(), F.lit(MERGE_PARTS))
    some = _best(partial.withColumn("_part", part), k, "q_id", "_part").drop("_part", "rank")
    return _best(some, k, "q_id")


def _in_blocks(p: DataFrame, block_rows: int) -> tuple[Column, list[dict]]:
    """(block of a passage, ``block, low, high`` of every block): classes of falling norm, each cut by hash."""
    steps = [i / NORM_CLASSES for i in range(1, NORM_CLASSES)]
    cuts = sorted(set(p.agg(F.percentile_approx("norm", steps, 10_000)).first()[0] or []), reverse=True)
    kind = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: F.col("norm") < c)) if cuts else F.lit(0)
    sizes = {r["c"]: r["n"] for r in p.groupBy(kind.alias("c")).agg(F.count("*").alias("n")).collect()}
    counts = [-(-sizes.get(c, 0) // block_rows) for c in range(len(cuts) + 1)]
    first = [sum(counts[:c]) for c in range(len(counts))]
    place = F.pmod(F.xxhash64("p_id"), F.greatest(F.get(F.array(*map(F.lit, counts)), kind), F.lit(1)))
    block = (F.get(F.array(*map(F.lit, first)), kind) + place).cast("int")
    norms = p.groupBy(block.alias("block")).agg(F.min("norm").alias("low"), F.max("norm").alias("high")).orderBy("block").collect()
    return block, [r.asDict() for r in norms]


def _hopeless(metric: str, block: Column) -> Column:
    """Whether no passage of a block can be among the best of a question with ``norm`` and ``floor``."""
    q, floor = F.col("norm"), F.col("floor")
    if metric == "ip":
        out = q * block["high"] * (1 + SLACK) < floor - F.abs(floor) * SLACK
    else:
        gap = F.greatest(block["low"] - q, q - block["high"], F.lit(0.0)) - (q + block["high"]) * SLACK
        out = ~F.isnan(gap) & (gap < float("inf")) & (gap > -floor * (1 + SLACK))
    return F.coalesce(out, F.lit(False))


def _block_join(q: DataFrame, p: DataFrame, k: int, metric: str, schema: T.StructType, block_rows: int) -> DataFrame:
    """The search where the question matrix is too large to be sent to every executor.

    Passages are cut into blocks of about ``block_rows``, largest norms first. Questions are
    sent to the blocks in rounds, each ``ROUND_GROWTH`` times as many blocks as the one before: after
    a round every question knows the score of its ``k`` best so far, and it is sent only to
    blocks whose norms allow a better one. A round of few blocks deals the questions of each to
    several tasks, so that all cores have work. In a task the passages of its block come first and
    stay, the questions stream past in batches and leave with what reaches their score. Every
    passage is shuffled once per task of its block, every question once per block that it needs.
    """
    norm = lambda vec: F.sqrt(squared_norm(as_double(F.col(vec))))
    same = q.schema["q_vec"].dataType == p.schema["p_vec"].dataType
    vector = lambda vec: F.col(vec) if same else as_double(F.col(vec))
    q = materialize(q.select("q_id", vector("q_vec").alias("vec"), norm("q_vec").alias("norm")), "questions")
    p = materialize(p.select("p_id", vector("p_vec").alias("vec"), norm("p_vec").alias("norm")), "vectors")
    block, blocks = _in_blocks(p, block_rows)
    none = lambda name: F.lit(None).cast(schema[name].dataType).alias(name)
    best = q.sparkSession.createDataFrame([], T.StructType([*schema.fields, T.StructField("rank", T.IntegerType())]))
    at, size = 0, 1
    while at < len(blocks):
        now, at, size = blocks[at : at + size], at + size, size * ROUND_GROWTH
        asking = q.join(best.where(F.col("rank") == k).select("q_id", F.col("score").alias("floor")), "q_id", "left")
        if metric == "ip":
            # blocks that no question needs are not read
            least = F.when(F.col("norm") > 0, F.col("floor") / F.col("norm"))
            reach = asking.agg(F.min(F.coalesce(least, F.lit(float("-inf"))))).first()[0]
            now = [b for b in now if reach is None or not b["high"] * (1 + SLACK) < reach - abs(reach) * SLACK]
        if not now:
            continue
        slices = -(-TASKS_PER_CORE * q.sparkSession.sparkContext.defaultParallelism // len(now))
        now = [{**b, "task": i * slices} for i, b in enumerate(now)]
        spans = F.from_json(F.lit(json.dumps(now)), "array<struct<block int, low double, high double, task int>>", {"allowNonNumericNumbers": "true"})
        needed = F.explode(F.filter(spans, lambda b: ~_hopeless(metric, b)))
        asked = asking.select("q_id", "vec", "floor", needed.alias("b"))
        # tasks of a block are numbered one after another
        first = ((F.array_position(F.array(*[F.lit(b["block"]) for b in now]), block) - 1) * slices).cast("int")
        tasks = F.explode(F.sequence(first, first + F.lit(slices - 1)))
        dealt = F.col("b.task") + F.pmod(F.xxhash64("q_id"), F.lit(slices)).cast("int")
        sides = (
            p.where(block.isin([b["block"] for b in now]))
            .select(tasks.alias("task"), F.lit(0).alias("side"), "p_id", none("q_id"), "vec", F.lit(None).cast("double").alias("floor"))
            .unionByName(asked.select(dealt.alias("task"), F.lit(1).alias("side"), none("p_id"), "q_id", "vec", "floor"))
        )
        met = sides.repartitionById(len(now) * slices, F.col("task")).sortWithinPartitions("task", "side").mapInArrow(_solver(k, metric, schema), schema)
        best = materialize(_merged(met.unionByName(best.drop("rank")), k), "ranked-round")
    return best


def _solver(k: int, metric: str, schema: T.StructType):
    arrow = _arrow_schema(schema)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, matrices = None, [], []
        for batch in batches:
            task, side = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            edges = np.flatnonzero((np.diff(task) != 0) | (np.diff(side) != 0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(task)]):
                part = batch.slice(a, b - a)
                if part.num_rows == 0:
                    continue
                if side[a] == 0:
                    if held != task[a]:
                        held, ids, matrices = task[a], [], []
                    ids.append(_ids(part.column(2)))
                    matrices.append(_matrix(part.column(4)))
                elif held == task[a]:
                    if len(ids) > 1:
                        ids, matrices = [np.concatenate(ids)], [np.concatenate(matrices)]
                    floor = part.column(5).fill_null(-np.inf).to_numpy(zero_copy_only=False)
                    top = _TopK(_matrix(part.column(4)), k, metric, floor)
                    top.add(ids[0], matrices[0])
                    yield from _result(top, part.column(3), arrow).to_batches(ROWS_OUT)

    return solve


def _best(found: DataFrame, k: int, *keys: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("p_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _vectors(df: DataFrame, key: str, vec: str) -> DataFrame:
    """Ids and vectors; single precision stays as it is on the way to Python, where products are double."""
    item = df.schema[vec].dataType.elementType
    value = F.col(vec) if isinstance(item, (T.FloatType, T.DoubleType)) else as_double(F.col(vec))
    return df.select(key, value.alias(vec)).where(F.col(vec).isNotNull() & finite(F.col(vec)))


def _dimension(q: DataFrame) -> int:
    first = q.select(F.size("q_vec")).head()
    return max(1, first[0]) if first else 1


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _block_topk(head: pa.Table, p: DataFrame, k: int, metric: str, schema: T.StructType, floor: np.ndarray | None = None) -> DataFrame:
    arrow = _arrow_schema(schema)
    shared = p.sparkSession.sparkContext.broadcast(
        (head.column("q_id").combine_chunks(), _matrix(head.column("q_vec")), floor)
    )

    def best_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, matrix, floor = shared.value
        top = _TopK(matrix, k, metric, floor)
        for batch in batches:
            top.add(_ids(batch.column(0)), _matrix(batch.column(1)))
        yield from _result(top, q_ids, arrow).to_batches(ROWS_OUT)

    return p.mapInArrow(best_of_task, schema)


def topk_join_l2(questions: DataFrame, passages: DataFrame, k: int, dim: int | None = None, **options) -> DataFrame:
    """The same search through distances: ``q_id, p_id, l2, ip, rank``.

    Passages get one more dimension, ``sqrt(phi - |v|^2)`` with ``phi`` the largest
    squared norm, questions get a 0; distance order is then inner-product order.
    ``phi`` enters the plan as a scalar subquery.
    """
    q = questions.select("q_id", as_double(F.col("q_vec")).alias("q_vec"))
    p = passages.select("p_id", as_double(F.col("p_vec")).alias("p_vec"))
    phi = p.agg(F.max(squared_norm(F.col("p_vec"))).alias("phi"))
    found = topk_join(
        q.select("q_id", F.concat("q_vec", F.array(F.lit(0.0))).alias("q_vec")),
        p.select("p_id", with_aux_dim(F.col("p_vec"), phi.scalar()).alias("p_vec")),
        k,
        metric="l2",
        dim=dim + 1 if dim else None,
        **options,
    )
    l2 = -F.col("score")
    norms = q.select("q_id", squared_norm(F.col("q_vec")).alias("_n"))
    return found.join(norms, "q_id").select(
        "q_id", "p_id", l2.alias("l2"), ((F.col("_n") + phi.scalar() - l2 * l2) / 2).alias("ip"), "rank"
    )


def external_ids(found: DataFrame, mapping: DataFrame) -> DataFrame:
    """Replace internal passage positions by external ids; ``mapping`` has ``p_id, external_id``."""
    return found.join(mapping, "p_id").drop("p_id").withColumnRenamed("external_id", "p_id")
