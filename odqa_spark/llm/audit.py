"""Interaction of quality filters: what each removes in every order they could be applied in.

Five filters mark a document: few words (A), few different words (B), many capitals (C), marks of
markup (D), and a text that a document with a smaller id has too (E). A to D follow from the text
alone. For E equal texts must meet: each task first reduces its own texts to the least id of each,
then texts are range-partitioned by prefixes, longer where many bytes share one, and inserted into
compressed tries that hold the least id at each terminal. A partition is sorted by text, so a trie
that has grown to its bound holds whole classes and gives way to a new one. Traversal gives the one
document of each text that is no duplicate; all others with an id are.

The five marks of a document are a mask of five bits. Counts per part and mask, 32 at most, are all
that the orders need, so the 120 orders are worked out on counts and never on documents.

Defined cases: a null text is the empty text, a null part is the empty string. A null id is not
larger than any id and fails no E; a repeated row has no smaller id either. Rows of one id are told
apart by a 64-bit hash of the text. A document with several labels has each mark that one of them
has. An empty table has no parts and gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import itertools
import json
import os.path
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odqa_spark.llm.frames import materialize, slices

FILTERS = "ABCDE"
MIN_WORDS = 200
#: Bytes of texts that a task or a trie holds before it passes them on.
HELD_BYTES = 16 << 20
#: Bytes of texts that may share a prefix before a longer one is taken, and the share of all texts.
PREFIX_BYTES = 16 << 20
PREFIX_SHARE = 4096
PREFIXES = (16, 64, 256, 1024, 4096)
_UPPER = bytes(set(range(256)) - set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
_MARKS = bytes(set(range(256)) - set(b"#$%&*|"))


def text_mask(text: bytes, n_chars: int) -> int:
    """Bits 0 to 3: whether the text fails A, B, C, D."""
    words = text.split()
    fails = (
        len(words) < MIN_WORDS,
        100 * len(set(words)) < 50 * len(words),
        100 * len(text.translate(None, _UPPER)) > 2 * n_chars,
        len(text.translate(None, _MARKS)) > 0,
    )
    return sum(1 << i for i, f in enumerate(fails) if f)


class Trie:
    """A compressed trie of byte strings; each terminal holds the least value inserted for its string."""

    def __init__(self) -> None:
        self.root: list = [b"", None, {}]  # label, least value, children by first byte
        self.size = 0

    def insert(self, text: bytes, value: tuple) -> None:
        node, at = self.root, 0
        while at < len(text):
            child = node[2].get(text[at])
            if child is None:
                node[2][text[at]] = [text[at:], value, {}]
                self.size += len(text) - at
                return
            if not text.startswith(child[0], at):
                common = len(os.path.commonprefix([child[0], text[at : at + len(child[0])]]))
                fork = [child[0][:common], None, {child[0][common]: child}]
                child[0] = child[0][common:]
                node[2][text[at]] = child = fork
            node, at = child, at + len(child[0])
        if node[1] is None or value < node[1]:
            node[1] = value

    def terminals(self) -> Iterator[tuple]:
        """The value of every string."""
        stack = [self.root]
        while stack:
            _, value, children = stack.pop()
            if value is not None:
                yield value
            stack.extend(children.values())


def _scanned(rows: DataFrame, kind: str) -> DataFrame:
    """A row with ``mask`` per document, and rows with ``text`` and least id for the texts of each task."""
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(rows.schema["id"].dataType)
    types = [id_type, pa.string(), pa.int64(), pa.int32(), pa.binary()]
    names = ["id", "part", "digest", "mask", "text"]

    def batch_of(*columns: list | pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types)], names)

    def texts_of(held: dict) -> pa.RecordBatch:
        n = len(held)
        return batch_of([v[0] for v in held.values()], [None] * n, [v[1] for v in held.values()], [None] * n, list(held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        size = 0
        for batch in batches:
            for a, b in slices(batch.column(3)):
                part = batch.slice(a, b - a)
                ids, digests, texts = part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist()
                masks = [text_mask(t, n) for t, n in zip(texts, part.column(4).to_pylist())]
                yield batch_of(part.column(0), part.column(1), part.column(2), masks, [None] * len(ids))
                for i, digest, text in zip(ids, digests, texts):
                    if i is None:
                        continue
                    known = held.get(text)
                    if known is None:
                        held[text] = [i, digest, 1]
                        size += len(text)
                    else:
                        known[0], known[2] = min(i, known[0]), known[2] + 1
                if size > HELD_BYTES:
                    # texts met again stay, so that a hot text leaves a task once
                    again = {t: v for t, v in held.items() if v[2] > 1}
                    size = sum(map(len, again))
                    if size > HELD_BYTES // 2:
                        again, size = {}, 0
                    yield texts_of({t: v for t, v in held.items() if t not in again})
                    held = again
        if held:
            yield texts_of(held)

    return rows.mapInArrow(run, f"id {kind}, part string, digest bigint, mask int, text binary")


def _prefix_key(texts: DataFrame) -> Column:
    """The shortest of the prefixes that few bytes of different texts share.

    What is collected are hashes of prefixes, ``PREFIX_SHARE`` of each length at most. Longer common prefixes are
    split by the hash of the text.
    """
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    limit = max(PREFIX_BYTES, total // PREFIX_SHARE)
    rest, key = texts, F.substring("text", 1, PREFIXES[-1])
    shared = []
    for length in PREFIXES[:-1]:
        own = F.xxhash64(F.substring("text", 1, length))
        groups = rest.groupBy(own.alias("p")).agg(
            F.sum(F.octet_length("text")).alias("n"), F.min("digest").alias("low"), F.max("digest").alias("high")
        )
        hot = [r["p"] for r in groups.where((F.col("n") > limit) & (F.col("low") < F.col("high"))).select("p").collect()]
        shared.append((length, own.isin(hot) if hot else F.lit(False)))
        if not hot:
            break
        rest = rest.where(own.isin(hot))
    for length, longer in reversed(shared):
        key = F.when(~longer, F.substring("text", 1, length)).otherwise(key)
    return key


def _first_of_each(texts: DataFrame, kind: str) -> DataFrame:
    """(id, digest) of the document with the least id of every text."""
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(texts.schema["id"].dataType)

    def rows(trie: Trie) -> pa.RecordBatch:
        found = list(trie.terminals())
        return pa.RecordBatch.from_arrays([pa.array([v[0] for v in found], id_type), pa.array([v[1] for v in found], pa.int64())], ["id", "digest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, last = Trie(), None
        for batch in batches:
            for a, b in slices(batch.column(2)):
                for i, digest, text in zip(*(batch.column(c).slice(a, b - a).to_pylist() for c in range(3))):
                    if trie.size > HELD_BYTES and text != last:
                        yield rows(trie)
                        trie = Trie()
                    trie.insert(text, (i, digest))
                    last = text
        yield rows(trie)

    ranged = texts.select("id", "digest", "text", _prefix_key(texts).alias("key")).repartitionByRange("key", "digest")
    return ranged.sortWithinPartitions("text").select("id", "digest", "text").mapInArrow(run, f"id {kind}, digest bigint")


def filter_masks(docs: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(id, part, mask) per document; bit i of the mask: it fails filter i."""
    kind = docs.schema[id_col].dataType.simpleString()
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.xxhash64(whole).alias("digest"), whole.cast("binary").alias("text"), F.char_length(whole).alias("n_chars"),
    )
    seen = materialize(_scanned(rows, kind), "audit-scan")
    first = _first_of_each(seen.where("mask is null").select("id", "digest", "text"), kind)
    marked = seen.where("mask is not null").select("id", "part", "digest", "mask")
    # rows without an id would all meet in one place of the join
    named = marked.where("id is not null").join(first.withColumn("first", F.lit(True)), ["id", "digest"], "left")
    named = named.select("id", "part", F.when(F.col("first"), F.col("mask")).otherwise(F.col("mask") + (1 << 4)).alias("mask"))
    return named.unionByName(marked.where("id is null").select("id", "part", "mask"))


def interaction_audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "source"
) -> DataFrame:
    """One row per part, order of the filters and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    masks = filter_masks(docs, id_col, text, part)
    some = lambda mark: F.max(F.coalesce(F.col(mark) == 1, F.lit(False)))
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(some("quality").alias("good"), some("toxic").alias("toxic"))
    known = masks.where("id is not null").join(marks, "id", "left")
    known = known.unionByName(masks.where("id is null"), allowMissingColumns=True)
    cells = known.groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.count_if(F.col("good")).alias("good"), F.count_if(F.col("toxic")).alias("toxic")
    )
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    orders = ["".join(o) for o in itertools.permutations(FILTERS)]
    steps = [
        {"o": o, "s": s + 1, "before": sum(1 << FILTERS.index(f) for f in o[:s]), "bit": 1 << FILTERS.index(o[s])}
        for o in orders
        for s in range(len(FILTERS))
    ]
    step = F.from_json(F.lit(json.dumps(steps)), "array<struct<o string, s int, before int, bit int>>")
    rows = parts.select("part", "cells", F.explode(step).alias("x"))
    before, bit = F.col("x.before"), F.col("x.bit")

    def total(where, what) -> Column:
        return F.aggregate(F.filter("cells", where), F.lit(0).cast("bigint"), lambda a, c: a + what(c))

    fails = lambda c: c["mask"].bitwiseAND(bit) > 0
    here = lambda c: fails(c) & (c["mask"].bitwiseAND(before) == 0)
    # of the orders a document with f failures is removed by each of them in an f-th
    share = lambda c: c["n"] * F.floor(F.lit(len(orders)) / F.bit_count(c["mask"]))
    return rows.select(
        "part", F.col("x.o").alias("filter_order"), F.col("x.s").alias("step"),
        total(lambda c: c["mask"].bitwiseAND(before + bit) == 0, lambda c: c["n"]).alias("kept"),
        total(here, lambda c: c["n"]).alias("removed"),
        total(lambda c: fails(c) & (c["mask"].bitwiseAND(before) > 0), lambda c: c["n"]).alias("redundant"),
        total(lambda c: c["mask"] == bit, lambda c: c["n"]).alias("unique_fails"),
        total(here, lambda c: c["good"]).alias("good_lost"),
        total(here, lambda c: c["toxic"]).alias("toxic_lost"),
        total(fails, share).alias("shapley"),
    )
