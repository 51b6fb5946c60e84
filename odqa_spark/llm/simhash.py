"""Near-duplicates by SimHash, linked through a grid of segment bit counts.

The fingerprint follows the usual rule over XXH64 hashes of word shingles. To link
fingerprints that differ in at most ``distance`` bits, the 64 bits are cut into 32 segments of
two bits and mapped to the bit count of each. The Manhattan distance of two count vectors
never exceeds the number of differing bits, and of the two halves of the vector one lies
within ``distance // 2``: with 3, within 1. So each half is a cell of an integer grid, joined
with the cells one step away, and what meets is verified on the fingerprints.

Equal fingerprints are one node. Cells with many nodes are cut into blocks that meet pair by
pair, and each pair of blocks gives only a spanning forest of its links; components come from
alternating star operations on the links, all in Spark.

Defined cases: null and wordless texts have fingerprint zero and link like others. Rows with a
null id have a fingerprint and the component of their fingerprint's group; a group without any
id has none. Repeated rows are rows like others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odqa_spark.llm.frames import map_slices, materialize
from odqa_spark.llm.tokens import text_of

SHINGLE = 3
DISTANCE = 3
SEED = 42
CELL_ROWS = 32
BLOCK_ROWS = 1024
_PAIRS = 0x5555555555555555
#: The primes of XXH64.
_PRIMES = tuple(
    np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)
_GAP = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_VALUE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _rotated(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _xxh64(buffer: bytes, start: np.ndarray, end: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many byte ranges: those under 32 bytes, most shingles, as arrays, others one by one."""
    p1, p2, p3, p4, p5 = _PRIMES
    out = np.empty(len(start), np.uint64)
    size = end - start
    long = np.flatnonzero(size >= 32)
    out[long] = np.array([xxhash.xxh64_intdigest(buffer[a:b], seed) for a, b in zip(start[long].tolist(), end[long].tolist())], np.uint64)
    short = np.flatnonzero(size < 32)
    padded = buffer + bytes(8)
    lanes = np.ndarray((len(buffer) + 1,), "<u8", padded, strides=(1,))
    halves = np.ndarray((len(buffer) + 1,), "<u4", padded, strides=(1,))
    at, left = start[short].copy(), size[short].copy()
    h = left.astype(np.uint64) + np.uint64((seed + int(p5)) & (2**64 - 1))
    with np.errstate(over="ignore"):
        while len(on := np.flatnonzero(left >= 8)):
            k = _rotated(lanes[at[on]] * p2, 31) * p1
            h[on] = _rotated(h[on] ^ k, 27) * p1 + p4
            at[on] += 8
            left[on] -= 8
        on = np.flatnonzero(left >= 4)
        h[on] = _rotated(h[on] ^ (halves[at[on]].astype(np.uint64) * p1), 23) * p2 + p3
        at[on] += 4
        left[on] -= 4
        single = np.frombuffer(padded, np.uint8)
        while len(on := np.flatnonzero(left)):
            h[on] = _rotated(h[on] ^ (single[at[on]].astype(np.uint64) * p5), 11) * p1
            at[on] += 1
            left[on] -= 1
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
    out[short] = h ^ (h >> np.uint64(32))
    return out


def _shingles(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text row) of each text's word shingles; A-Z count as a-z, words end at ASCII white space."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    buffer = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    sizes = np.array([len(r) + 1 for r in raw], np.int64)
    text_start = np.cumsum(sizes) - sizes
    gap = _GAP[buffer]
    first = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    doc = text_of(first, text_start)
    # one space between words, whatever stood there
    keep = ~(gap & np.concatenate([[True], gap[:-1]]))
    line = np.where(gap[keep], np.uint8(32), buffer[keep])
    inside = line != 32
    start = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]]))
    end = np.flatnonzero(~inside)
    words = np.bincount(doc, minlength=len(texts))
    # the first word of each shingle: a text of fewer words is one shingle
    rest = np.repeat(np.cumsum(words), words) - np.arange(len(doc))
    opens = np.flatnonzero((rest >= n) | (rest == words[doc]))
    return _xxh64(line.tobytes(), start[opens], end[opens + np.minimum(rest[opens], n) - 1]), doc[opens]


def fingerprint(texts: list[str | None], n: int = SHINGLE) -> np.ndarray:
    """Signed 64-bit SimHash of each text's word shingles."""
    hashes, of = _shingles(texts, n)
    # how often each value stands in each byte of a text's hashes; then bits of values
    cell = (of[:, None] * 8 + np.arange(8)) * 256 + hashes.view(np.uint8).reshape(-1, 8)
    values = np.bincount(cell.ravel(), minlength=len(texts) * 2048).reshape(len(texts), 8, 256)
    ones = (values @ _VALUE_BITS).reshape(len(texts), 64)
    set_in = 2 * ones > np.bincount(of, minlength=len(texts))[:, None]
    return np.packbits(set_in, axis=1, bitorder="little").view(np.int64).ravel()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = SHINGLE) -> DataFrame:
    """(id_col, mark, fp): one row per row of ``docs``; mark is a hash of the text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = fingerprint(batch.column(1).to_pylist(), n)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps)], [id_col, "mark", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.col(text).cast("string").alias("text"), F.xxhash64(text).alias("mark"))
    return map_slices(rows, "text", run, f"`{id_col}` {kind}, mark bigint, fp bigint")


def _counts(fp: Column) -> Column:
    """The bit count (0 to 2) of each two-bit segment, packed in place."""
    odd, even = F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_PAIRS)), fp.bitwiseAND(F.lit(_PAIRS))
    return F.shiftleft(odd.bitwiseAND(even), 1).bitwiseOR(odd.bitwiseXOR(even))


def _cells(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(own, beside): each node's two cells, and the cells one step up from them."""
    c = _counts(F.col("fp"))
    halves = F.array(
        F.struct(F.lit(0).alias("half"), F.shiftrightunsigned(c, 32).alias("cell")),
        F.struct(F.lit(1).alias("half"), c.bitwiseAND(F.lit(0xFFFFFFFF)).alias("cell")),
    )
    own = nodes.select("fp", F.explode(halves).alias("at")).select("at.half", "at.cell", "fp")
    up = F.array(*[F.col("cell") + F.lit(1 << 2 * i) for i in range(16)])
    # a segment at 2 would become 3, which is no count
    legal = F.filter(up, lambda x: x.bitwiseAND(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(_PAIRS)) == 0)
    return own, own.select("half", F.explode(legal).alias("cell"), "fp")


def _forest(distance: int):
    """Links of a block pair as a spanning forest: no more rows than members."""

    def run(key: tuple[int, ...], rows: pd.DataFrame) -> pd.DataFrame:
        left = rows.loc[rows["side"] == 0, "fp"].unique()
        right = rows.loc[rows["side"] == 1, "fp"].unique()
        members, at = np.unique(np.concatenate([left, right]), return_inverse=True)
        l_at, r_at = at[: len(left)], at[len(left) :]
        label = np.arange(len(members))
        bits = members.view(np.uint64)
        out = []
        for i in l_at:
            near = r_at[np.bitwise_count(bits[i] ^ bits[r_at]) <= distance]
            others, first = np.unique(label[near], return_index=True)
            new = others != label[i]
            if new.any():
                out += [(members[i], members[j]) for j in near[first[new]]]
                label[np.isin(label, others)] = label[i]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def links(nodes: DataFrame, distance: int = DISTANCE, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b) pairs of different fingerprints that join all fingerprints within ``distance`` <= 3 bits.

    ``nodes`` holds distinct ``fp``. Cells of up to ``cell_rows`` nodes are joined directly;
    larger ones in blocks.
    """
    if distance // 2 > 1:
        raise ValueError("two halves bound distances up to 3")
    own, beside = _cells(nodes)
    size = own.groupBy("half", "cell").agg(F.count("*").alias("n"))
    own = materialize(own.join(size, ["half", "cell"]), "simhash-cells")
    small = own.where(F.col("n") <= cell_rows).select("half", "cell", F.col("fp").alias("a"))
    meets = small.withColumnRenamed("a", "b").unionByName(beside.withColumnRenamed("fp", "b"))
    close = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance) & (F.col("a") != F.col("b"))
    found = small.join(meets, ["half", "cell"]).where(close).select("a", "b")

    large = own.where(F.col("n") > cell_rows)
    hot = large.groupBy("half", "cell").agg(F.ceil(F.first("n") / block_rows).cast("int").alias("lb"))
    around = beside.join(hot, ["half", "cell"])
    crowd = around.groupBy("half", "cell").agg(F.count("*").alias("m"))
    both = (
        hot.join(crowd, ["half", "cell"], "left")
        .withColumn("rb", F.ceil((F.coalesce("m", F.lit(0)) + F.col("lb") * block_rows) / block_rows).cast("int"))
        .select("half", "cell", "lb", "rb")
    )
    part = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = large.join(both, ["half", "cell"]).select("half", "cell", part("lb").alias("l"), span("rb").alias("r"), "fp", F.lit(0).alias("side"))
    near = large.select("half", "cell", "fp").unionByName(around.select("half", "cell", "fp"))
    right = near.join(both, ["half", "cell"]).select("half", "cell", span("lb").alias("l"), part("rb").alias("r"), "fp", F.lit(1).alias("side"))
    blocks = left.unionByName(right).groupBy("half", "cell", "l", "r").applyInPandas(_forest(distance), "a bigint, b bigint")
    return found.unionByName(blocks)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each node's component, for all nodes of ``edges`` (a, b).

    Large-star and small-star rounds until the links are stars; every round is written to the
    shared folder, so a lost executor costs one round at most. Joins by sorting keep the
    rounds away from the driver.
    """
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = materialize(ordered, "links")
    before = None
    for _ in range(max_rounds):
        state = now.agg(F.count("*").alias("n"), F.sum((F.xxhash64("u", "v") % 1000003).cast("bigint")).alias("h"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).first()
        if state == before or not state.n:
            break
        before = state
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        big = both.where("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.withColumnRenamed("m", "v"))
        now = materialize(small.where("u <> v").distinct(), "links")
    else:
        raise RuntimeError(f"links did not become stars in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(id_col, mark, fp, root, component_id) for every row.

    root is the smallest fingerprint reachable over near fingerprints, component_id the smallest id.
    """
    prints = materialize(fingerprints(docs, id_col, text, n), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min(id_col).alias("first")), "nodes")
    near = components(links(nodes.select("fp"), distance))
    # components are of fingerprints; their smallest id comes from the nodes' smallest ids
    linked = nodes.join(near.withColumnRenamed("node", "fp"), "fp")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    moved = linked.join(least, "root").select("fp", "root", "least")
    group = nodes.join(moved, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id")
    )
    # written first: with plain exchanges on both sides Spark can split a fingerprint that many rows have
    return prints.join(materialize(group, "groups"), "fp").select(id_col, "mark", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``docs`` with one row per group of near copies (``simhash_components``): that with the smallest id.

    Of rows of that id in one group the text with the smallest hash stays, once. Rows with a null id
    cannot be named as copies and stay.
    """
    same = materialize(simhash_components(docs, id_col, text, n, distance).where(F.col(id_col).isNotNull()), "near-copies")
    rows = same.groupBy(F.col(id_col).alias("_llm_id"), F.col("mark").alias("_llm_mark"), "root", "component_id").agg(F.count("*").alias("_llm_n"))
    heads = rows.where("_llm_id = component_id")
    first = heads.groupBy("root").agg(F.min("_llm_mark").alias("first"))
    heads = heads.join(first, "root").withColumn("_llm_loses", F.col("_llm_mark") != F.col("first"))
    # only rows that go, or that stand there twice, are joined back to the texts
    known = rows.where("_llm_id <> component_id").withColumn("_llm_loses", F.lit(True)).unionByName(heads.drop("first"))
    known = known.where("_llm_loses or _llm_n > 1").select("_llm_id", "_llm_mark", "_llm_n", "_llm_loses")
    at = (F.col(id_col) == F.col("_llm_id")) & (F.xxhash64(F.col(text)) == F.col("_llm_mark"))
    joined = docs.join(known, at, "left")
    single = joined.where("_llm_n is null").select(*docs.columns)
    double = joined.where("_llm_n > 1 and not _llm_loses").dropDuplicates(["_llm_id", "_llm_mark"]).select(*docs.columns)
    return single.unionByName(double)
