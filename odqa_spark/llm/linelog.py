"""Line de-duplication with a log-template tree.

A line is filed by a tree of fixed depth: its number of words, then its three leading words,
words with digits as wildcards. In a leaf with enough documents a word stays in the template
where enough documents have it at its place; other places are variable fields and become
wildcards. A template that recurs across documents is boilerplate and its lines are dropped.

Copies of whole documents are not boilerplate: they are left to near-duplicate removal. So a
template needs enough independent documents, a number and not a share. What else a document holds
gives it several marks, the smallest hashes of three-word windows under as many seeds; a document
counts when in each mark it is the first that has it, so near copies count once. Windows are taken
from lines that are in no candidate template. Only where these are less than a fifth of the
document, as in copies, all its other lines give the marks.

Words of lines that need no look (all but those in leaves with enough documents) never leave
the scan: a filter of fixed size holds the leaves, another the lines of templates, and the joins
after them are exact. A line that only the filter takes for a candidate is known by the join; its
windows then count among the document's own, so the size of the filters changes no result.

Defined cases: null texts stay null. Lines with fewer than three words, blank ones included,
stay. A text of which all lines go becomes empty. Repeated rows are documents of their own.
Empty input: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odqa_spark.llm.frames import KeySketch, list_array, map_slices, materialize
from odqa_spark.llm.tokens import mix, words

LEADING = 3
MIN_DOCS = 10
MIN_WORDS = 3
MIN_CONSTANT = 0.5
MARKS = 8
MIN_OWN = 0.2
FILTER_BITS = 1 << 24
WILD = np.uint64(0x2A)
_ROOT = np.uint64(0x9E3779B97F4A7C15)


class Lines:
    """The lines of a block of texts that have enough words: text row, line number, leaf, masked line."""

    def __init__(self, texts: list[str | None], leading: int = LEADING, min_words: int = MIN_WORDS):
        w = words(texts)
        # string functions of the JVM cut at line feeds only, and so does this
        feeds = np.concatenate([[0], np.cumsum(w.buffer == 10)])
        digits = np.concatenate([[0], np.cumsum((w.buffer >= 48) & (w.buffer <= 57))])
        code = np.where(digits[w.end] > digits[w.start], WILD, w.hash)
        line = feeds[w.start] - feeds[w.text_start[w.doc]] if len(w.doc) else np.zeros(0, np.int64)
        head = np.flatnonzero(np.concatenate([[True], (w.doc[1:] != w.doc[:-1]) | (line[1:] != line[:-1])])) if len(code) else np.zeros(0, np.int64)
        size = np.diff(np.concatenate([head, [len(code)]]))
        self.code = code
        with np.errstate(over="ignore"):
            leaf = size.astype(np.uint64) * _ROOT
            for i in range(leading):
                at = np.minimum(head + i, max(len(code) - 1, 0))
                leaf = mix(leaf ^ np.where(size > i, code[at] if len(code) else leaf, np.uint64(0)))
            place = (np.arange(len(code)) - np.repeat(head, size)).astype(np.uint64)
            term = mix(code + mix(place + np.uint64(1)))
            masked = mix(np.add.reduceat(term, head) + leaf) if len(head) else np.zeros(0, np.uint64)
            window = np.full(len(code), np.iinfo(np.uint64).max, np.uint64)
            window[:-2] = mix(code[:-2] + np.uint64(3) * code[1:-1] + np.uint64(5) * code[2:])
        # windows stay inside their line
        last = head + size
        window[np.concatenate([last - 1, last[size > 1] - 2])] = np.iinfo(np.uint64).max
        keep = size >= min_words
        self._window, self._head, self._keep = window, head, keep
        self.head, self.size, self.leaf, self.masked = head[keep], size[keep], leaf[keep].view(np.int64), masked[keep].view(np.int64)
        self.doc, self.line = (w.doc[head][keep], line[head][keep]) if len(head) else (head, head)

    def low(self, seed: int) -> np.ndarray:
        """The smallest window hash of each line under a seed."""
        none = np.iinfo(np.uint64).max
        with np.errstate(over="ignore"):
            rank = mix(self._window ^ mix(np.full(1, seed + 1, np.uint64)))
        rank[self._window == none] = none
        return (np.minimum.reduceat(rank, self._head) if len(self._head) else rank)[self._keep]

    def codes(self, which: np.ndarray) -> pa.ListArray:
        parts = [self.code[h : h + n] for h, n in zip(self.head[which].tolist(), self.size[which].tolist())]
        flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        return list_array(pa.array(flat.view(np.int64)), self.size[which])


def _firsts(ls: Lines) -> np.ndarray:
    """Whether each line is the first of its kind in its document."""
    order = np.lexsort((np.arange(len(ls.doc)), ls.masked, ls.doc))
    d, m = ls.doc[order], ls.masked[order]
    first = np.zeros(len(d), bool)
    first[order[np.concatenate([[True], (d[1:] != d[:-1]) | (m[1:] != m[:-1])])]] = True
    return first


def _ordered(x: np.ndarray) -> np.ndarray:
    """Unsigned values as longs of the same order."""
    return (x ^ np.uint64(1 << 63)).view(np.int64)


def _marks(ls: Lines, first: np.ndarray, candidate: np.ndarray) -> dict[str, np.ndarray]:
    """For each candidate line: its windows, those of all and of sure own lines of the document, and
    under each of the ``MARKS`` seeds the smallest hash of the line, of the sure own lines, and of all other lines."""
    n = int(ls.doc.max()) + 1
    windows = np.where(first, ls.size - 2, 0)
    own = np.bincount(ls.doc, np.where(candidate, 0, windows), minlength=n)
    every = np.bincount(ls.doc, windows, minlength=n)
    at = np.flatnonzero(candidate)
    doc = ls.doc[at]
    none = np.uint64(np.iinfo(np.uint64).max)
    rows = np.flatnonzero(first)
    low, least, other = (np.empty((len(at), MARKS), np.uint64) for _ in range(3))
    for seed in range(MARKS):
        value = ls.low(seed)
        sure = np.full(n, none)
        np.minimum.at(sure, ls.doc[~candidate], value[~candidate])
        # the two smallest of all different lines: the second where the first is the line's own
        order = rows[np.lexsort((value[rows], ls.doc[rows]))]
        d = ls.doc[order]
        head = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        one, two = np.full(n, none), np.full(n, none)
        one[d[head]] = value[order[head]]
        more = head[np.flatnonzero(np.diff(np.concatenate([head, [len(d)]])) > 1)] + 1
        two[d[more]] = value[order[more]]
        low[:, seed], least[:, seed] = value[at], sure[doc]
        other[:, seed] = np.where(value[at] == one[doc], two[doc], one[doc])
    counts = {"windows": ls.size[at] - 2, "every": every[doc], "own": own[doc]}
    return {k: v.astype(np.int64) for k, v in counts.items()} | {"low": _ordered(low), "least": _ordered(least), "other": _ordered(other)}


def recurring_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    min_docs: int = MIN_DOCS,
    min_constant: float = MIN_CONSTANT,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """(id, mark, lines): the line numbers, from 0, that belong to recurring templates; mark is the text's hash."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"))

    def filed(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ls = Lines(batch.column(0).to_pylist())
        first = _firsts(ls)
        return pa.RecordBatch.from_arrays([pa.array(ls.leaf[first]), pa.array(ls.masked[first])], ["leaf", "masked"])

    firsts = map_slices(rows.select("text"), "text", filed, "leaf bigint, masked bigint")
    known = materialize(firsts.groupBy("leaf", "masked").agg(F.count("*").alias("docs")), "masked-lines")
    leaves = materialize(known.groupBy("leaf").agg(F.sum("docs").alias("n")).where(F.col("n") >= min_docs).select("leaf"), "leaves")
    sketch = KeySketch.of(leaves, "leaf", filter_bits)

    def spelled(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ls = Lines(batch.column(0).to_pylist())
        which = np.flatnonzero(sketch.may_hold(ls.leaf))
        which = which[np.unique(ls.masked[which], return_index=True)[1]]
        return pa.RecordBatch.from_arrays([pa.array(ls.leaf[which]), pa.array(ls.masked[which]), ls.codes(which)], ["leaf", "masked", "codes"])

    seen = map_slices(rows.select("text"), "text", spelled, "leaf bigint, masked bigint, codes array<bigint>")
    lines = seen.dropDuplicates(["leaf", "masked"]).join(known.join(leaves, "leaf", "left_semi"), ["leaf", "masked"])
    lines = materialize(lines, "spelled-lines")
    placed = lines.select("leaf", "masked", "docs", F.posexplode("codes").alias("pos", "code"))
    often = placed.where(F.col("code") != int(WILD)).groupBy("leaf", "pos", "code").agg(F.sum("docs").alias("n")).where(F.col("n") >= min_docs)
    constant = placed.join(often.drop("n"), ["leaf", "pos", "code"]).groupBy("leaf", "masked").agg(
        F.sort_array(F.collect_list(F.struct("pos", "code"))).alias("words")
    )
    enough = F.size("words") >= F.greatest(F.lit(MIN_WORDS), F.ceil(F.size("codes") * F.lit(min_constant)))
    templates = (
        constant.join(lines.select("leaf", "masked", "codes"), ["leaf", "masked"])
        .where(enough)
        .select("leaf", "masked", F.xxhash64("leaf", "words").alias("template"))
    )
    # written first: with plain exchanges on both sides Spark can split a line that many documents have
    templates = materialize(templates, "templates")
    candidates = KeySketch.of(templates, "masked", filter_bits)

    def marked(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ls = Lines(batch.column(0).to_pylist())
        candidate = candidates.may_hold(ls.masked)
        if not candidate.any():
            return None
        first = _firsts(ls)
        known = _marks(ls, first, candidate)
        take = pa.array(ls.doc[candidate])
        columns = [batch.column(1).take(take), batch.column(2).take(take), pa.array(ls.line[candidate].astype(np.int32))]
        columns += [pa.array(x[candidate]) for x in (ls.leaf, ls.masked, first)]
        columns += [pa.array(known[c]) for c in ("windows", "every", "own")]
        each = np.full(int(candidate.sum()), MARKS)
        columns += [list_array(pa.array(known[c].ravel()), each) for c in ("low", "least", "other")]
        names = ["id", "mark", "line", "leaf", "masked", "first", "windows", "every", "own", "low", "least", "other"]
        return pa.RecordBatch.from_arrays(columns, names)

    schema = f"id {kind}, mark bigint, line int, leaf bigint, masked bigint, first boolean, windows bigint, every bigint, own bigint, "
    schema += "low array<bigint>, least array<bigint>, other array<bigint>"
    found = materialize(map_slices(rows, "text", marked, schema), "candidate-lines")
    found = materialize(found.join(templates, ["leaf", "masked"], "left").drop("leaf"), "template-lines")
    # lines that the filter let pass but no template has are the document's own
    own = found.where("first and template is null").groupBy("id", "mark", "masked").agg(F.first("windows").alias("windows"), F.first("low").alias("low"))
    own = own.groupBy(F.col("id").alias("_id"), F.col("mark").alias("_mark")).agg(
        F.sum("windows").alias("more"), F.array(*[F.min(F.get("low", F.lit(i))) for i in range(MARKS)]).alias("lower")
    )
    used = found.where("template is not null").join(own, F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left")
    by_own = F.col("own") + F.coalesce("more", F.lit(0)) >= F.greatest(F.col("every") - F.col("windows"), F.lit(1)) * MIN_OWN
    of_own = F.when(F.col("lower").isNull(), F.col("least")).otherwise(F.zip_with("least", "lower", lambda a, b: F.least(a, b)))
    used = used.select("id", "mark", "line", "first", "template", F.when(by_own, of_own).otherwise(F.col("other")).alias("marks"))
    holders = used.where("first").groupBy("template", F.xxhash64("id", "mark").alias("doc")).agg(F.min("marks").alias("marks"))
    leads = holders.select("template", "doc", F.posexplode("marks").alias("slot", "value")).groupBy("template", "slot", "value").agg(F.min("doc").alias("doc"))
    alone = leads.groupBy("template", "doc").agg(F.count("*").alias("n")).where(F.col("n") == MARKS)
    recurring = alone.groupBy("template").agg(F.count("*").alias("kinds")).where(F.col("kinds") >= min_docs).select("template")
    lines = found.where("template is not null").select("id", "mark", "line", "template")
    return lines.join(materialize(recurring, "recurring"), "template", "left_semi").groupBy("id", "mark").agg(F.collect_set("line").alias("lines"))


def without_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with the lines of recurring templates taken out of ``text``; all rows and columns stay."""
    found = recurring_lines(docs, id_col, text, **options).select(
        F.col("id").alias("_llm_id"), F.col("mark").alias("_llm_mark"), F.col("lines").alias("_llm_lines")
    )
    at = (F.xxhash64(F.col(text)) == F.col("_llm_mark")) & F.col(id_col).eqNullSafe(F.col("_llm_id"))
    rest = F.filter(F.split(F.col(text), "\n", -1), lambda x, i: ~F.array_contains("_llm_lines", i))
    cleaned = F.when(F.col("_llm_lines").isNull(), F.col(text)).otherwise(F.array_join(rest, "\n"))
    return docs.join(found, at, "left").select(*[cleaned.alias(c) if c == text else F.col(c) for c in docs.columns])
