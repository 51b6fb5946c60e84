"""Benchmark decontamination by template canonicalisation.

Words are lower-cased; numbers, units after numbers and names become typed placeholders, so a
question asked again with other values has the same template. Windows of eight template words
with at least five literal ones are hashed and joined with the windows of the benchmark. Hits
of one document and item that lie on one diagonal are one alignment; it counts when it has six
windows (thirteen words), or all windows of a shorter item, and when the slots are
consistent: the same value of the item always meets the same value in the document.

What is a name follows from capitals, so each window is looked up in three readings, aligned each
by itself: names as literal words, which no change of case can hide; names as slots where they
stand inside a sentence; and, where a text has such a name at the start of a sentence too and
never in small letters, those as slots as well.

Only windows that may be in the benchmark leave the scan: a filter of fixed size, built from the
benchmark's windows, is sent to the tasks; the join after it is exact.

Defined cases: null and empty texts match nothing. Items shorter than a window are one window
of their own length; items with fewer than five literal words, names counted, match nothing. Repeated rows of
documents or items each count. An empty benchmark leaves all documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odqa_spark.llm.frames import KeySketch, list_array, map_slices, materialize
from odqa_spark.llm.tokens import Words, among, hash_word, mix, words

WINDOW = 8
LITERALS = 5
MIN_WINDOWS = 6
NUMBER, UNIT, NAME = (np.uint64(x) for x in (0x4E554D4245520001, 0x554E495400000002, 0x4E414D4500000003))
#: Words that stand for a unit after a number.
UNITS = (
    "mm cm m km kg g mg lb lbs oz l ml s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "inch inches ft foot feet yd mile miles kmh mph usd eur gbp dollar dollars cents euro euros pound pounds percent degrees kw kwh w v hz gb mb kb"
).split()
#: Number words.
NUMBERS = (
    "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty "
    "thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()
_ROOT = 0x9E3779B97F4A7C15 | 1
#: Bytes after which a capital opens a sentence: text or line start, ! . : ?
_BREAK = np.isin(np.arange(256), [0, 10, 33, 46, 58, 63])
#: Readings of names: literal words, slots inside a sentence, slots at its start as well.
LITERAL, INSIDE, ANYWHERE = READINGS = (0, 1, 2)
_TABLES: dict[str, np.ndarray] = {}


def _hashes(name: str, of: list[str]) -> np.ndarray:
    if name not in _TABLES:
        _TABLES[name] = np.sort(np.array([hash_word(w) for w in of], np.int64).view(np.uint64))
    return _TABLES[name]


def _flag(size: int, at: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(at)])[: size + 1]


class Templates:
    """Template words of a block of texts: code, text row and byte range of each."""

    def __init__(self, w: Words, reading: int = ANYWHERE):
        self.reading = reading
        buf, low = w.cased, w.buffer
        start, end, doc, code = w.start, w.end, w.doc, w.hash.copy()
        self.buffer, self.n_texts = buf, w.n_texts
        if not len(start):
            self.code, self.doc, self.start, self.end, self.kind = code, doc, start, end, np.zeros(0, np.int8)
            return
        digit = (low[start] >= 48) & (low[start] <= 57)
        number = digit | among(code, _hashes("numbers", NUMBERS))
        # 1,000 and 3.14 are one number
        touches = np.concatenate([[False], (start[1:] - end[:-1] == 1) & ((low[end[:-1]] == 44) | (low[end[:-1]] == 46)) & digit[1:] & digit[:-1]])
        unit = np.concatenate([[False], number[:-1]]) & among(code, _hashes("units", UNITS)) & ~number
        # a name has a capital at its head only and does not open a sentence
        raised = _flag(len(low), buf != low)
        breaks = _flag(len(low), _BREAK[low])
        before = np.concatenate([[0], end[:-1]])
        opens = (breaks[start] > breaks[before]) | (np.arange(len(start)) == 0)
        head = raised[np.minimum(start + 2, end)] > raised[start]
        like_name = head & (raised[end] - raised[start] == 1) & (end - start > 1) & ~number & ~unit
        name = like_name & ~opens if reading != LITERAL else np.zeros(len(start), bool)
        if reading == ANYWHERE and name.any():
            with np.errstate(over="ignore"):
                of_text = mix(code + mix(doc.astype(np.uint64) + np.uint64(1)))
            named = np.unique(of_text[name])
            small = among(of_text, named) & (raised[end] == raised[start])
            named = np.setdiff1d(named, of_text[small])
            name |= like_name & among(of_text, named)
        kind = np.select([number, unit, name], [1, 2, 3], 0).astype(np.int8)
        code[number], code[unit], code[name] = NUMBER, UNIT, NAME
        # a run of names, and the parts of a number, are one slot
        same = np.concatenate([[False], (doc[1:] == doc[:-1]) & name[1:] & name[:-1]]) | touches
        first = np.flatnonzero(~same)
        last = np.concatenate([first[1:], [len(start)]]) - 1
        self.code, self.doc, self.kind = code[first], doc[first], kind[first]
        self.start, self.end = start[first], end[last]

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of the windows of ``n`` words with enough literals."""
        size = len(self.code) - n + 1
        if size <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            h, power = np.full(size, np.uint64(n + (self.reading << 32)), np.uint64), np.uint64(1)
            for i in range(n):
                power = power * np.uint64(_ROOT)
                h += self.code[i : i + size] * power
        literal = _flag(len(self.code), self.kind == 0)
        ok = (self.doc[:size] == self.doc[n - 1 :]) & (literal[n:] - literal[:size] >= LITERALS)
        at = np.flatnonzero(ok)
        return at, mix(h[at]).view(np.int64)

    def slots(self, at: int, n: int) -> list[str]:
        return [
            self.buffer[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace") for i in range(at, at + n) if self.kind[i]
        ]

    def first_of_text(self) -> np.ndarray:
        return np.searchsorted(self.doc, np.arange(self.n_texts))

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_texts)


def _emit(t: Templates, batch: pa.RecordBatch, found: list[tuple[np.ndarray, np.ndarray, int]], names: list[str]) -> pa.RecordBatch | None:
    at = np.concatenate([f[0] for f in found])
    if not len(at):
        return None
    keys = np.concatenate([f[1] for f in found])
    size = np.concatenate([np.full(len(f[0]), f[2]) for f in found])
    row = t.doc[at]
    slots = [t.slots(a, n) for a, n in zip(at.tolist(), size.tolist())]
    flat = pa.array([x for s in slots for x in s], pa.string())
    take = pa.array(row)
    keep = [batch.column(i).take(take) for i in range(1, batch.num_columns)]
    place = pa.array(at - t.first_of_text()[row])
    reading = pa.array(np.full(len(at), t.reading, np.int32))
    return pa.RecordBatch.from_arrays(keep + [reading, place, pa.array(keys), list_array(flat, np.array([len(s) for s in slots]))], names)


def _joined(batches: list[pa.RecordBatch | None]) -> pa.RecordBatch | None:
    some = [b for b in batches if b is not None]
    return pa.Table.from_batches(some).combine_chunks().to_batches()[0] if some else None


def _item_windows(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """(size, total, item, reading, ipos, key, islots): the windows of the benchmark; total is their number in the item's text."""

    def read(w: Words, reading: int, batch: pa.RecordBatch) -> pa.RecordBatch | None:
        t = Templates(w, reading)
        n = t.counts()
        found = []
        for size in sorted({min(window, int(c)) for c in n if c >= LITERALS}):
            at, key = t.windows(size)
            whole = (n[t.doc[at]] == size) if size < window else np.ones(len(at), bool)
            found.append((at[whole], key[whole], size))
        out = _emit(t, batch, found, ["item", "reading", "ipos", "key", "islots"]) if found else None
        if out is None:
            return None
        sizes = np.concatenate([np.full(len(f[0]), f[2]) for f in found])
        row = t.doc[np.concatenate([f[0] for f in found])]
        total = np.bincount(row)[row]
        return pa.RecordBatch.from_arrays(
            [pa.array(sizes.astype(np.int32)), pa.array(total.astype(np.int32)), *out.columns], ["size", "total", *out.schema.names]
        )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        w = words(batch.column(0).to_pylist(), cased=True)
        return _joined([read(w, r, batch) for r in READINGS])

    kind = items.schema[item_id].dataType.simpleString()
    rows = items.select(F.col(text).cast("string").alias("text"), F.col(item_id).alias("item"))
    return map_slices(rows, "text", run, f"size int, total int, item {kind}, reading int, ipos bigint, key bigint, islots array<string>")


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    min_windows: int = MIN_WINDOWS,
) -> DataFrame:
    """(id, mark, item, windows, verbatim): alignments that make a document contaminated, one row per document and item.

    mark is the hash of the document's text.
    """
    items = materialize(_item_windows(benchmark, item_id, item_text, window), "benchmark-windows")
    # at most ``window`` values for each reading
    sizes = [(r["reading"], r["size"]) for r in items.select("reading", "size").distinct().collect()]
    sketch = KeySketch.of(items, "key")

    def read(w: Words, reading: int, batch: pa.RecordBatch) -> pa.RecordBatch | None:
        t = Templates(w, reading)
        found = []
        for of, size in sizes:
            if of == reading:
                at, key = t.windows(size)
                may = sketch.may_hold(key)
                found.append((at[may], key[may], size))
        return _emit(t, batch, found, ["id", "mark", "reading", "pos", "key", "slots"]) if found else None

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        w = words(batch.column(0).to_pylist(), cased=True)
        return _joined([read(w, r, batch) for r in READINGS])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"))
    seen = map_slices(rows, "text", run, f"id {kind}, mark bigint, reading int, pos bigint, key bigint, slots array<string>")
    hits = seen.join(items.drop("size"), ["reading", "key"])
    pair = F.transform(F.arrays_zip("islots", "slots"), lambda p: F.struct(p["islots"].alias("i"), p["slots"].alias("d")))
    aligned = (
        hits.withColumn("pair", pair)
        .groupBy("id", "mark", "item", "reading", (F.col("pos") - F.col("ipos")).alias("diagonal"))
        .agg(F.min("total").alias("total"), F.size(F.collect_set("ipos")).alias("windows"), F.array_distinct(F.flatten(F.collect_set("pair"))).alias("pairs"))
    )
    consistent = F.size("pairs") == F.size(F.array_distinct("pairs.i"))
    verbatim = F.forall("pairs", lambda p: F.lower(p["i"]) == F.lower(p["d"]))
    ok = aligned.where((F.col("windows") >= F.least(F.lit(min_windows), F.col("total"))) & consistent)
    return ok.groupBy("id", "mark", "item").agg(F.max("windows").alias("windows"), F.max(verbatim).alias("verbatim"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item."""
    found = leaks(docs, benchmark, id_col, text, **options).select(F.col("id").alias("_llm_id"), F.col("mark").alias("_llm_mark")).distinct()
    at = (F.xxhash64(F.col(text)) == F.col("_llm_mark")) & F.col(id_col).eqNullSafe(F.col("_llm_id"))
    return docs.join(found, at, "left_anti")


def template(text: Column) -> Column:
    """The template as text, for inspection."""

    @F.pandas_udf("string")
    def show(values):
        out = []
        for v in values:
            t = Templates(words([v], cased=True))
            names = {1: "<NUMBER>", 2: "<UNIT>", 3: "<NAME>"}
            out.append(" ".join(names.get(int(k)) or t.buffer[a:b].tobytes().decode("utf-8", "replace").lower() for k, a, b in zip(t.kind, t.start, t.end)))
        return type(values)(out, dtype=object)

    return show(text)
