"""Chunkers: token windows, recursive character chunks, fixed-size passage groups."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from odqa_spark.functions.binding import let
from odqa_spark.functions.text import drop_long_words, embed_input
from odqa_spark.functions.tokens import Tokenizer, default_tokenizer

# Fixed values of the recursive chunker.
CHUNK_SIZE = 3000
CHUNK_OVERLAP = 100
SEPARATORS = ["\n\n", "\n", " ", ""]


BOUNDS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def window_bounds(word: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the windows over tokens, of which ``word`` marks those that start a word.

    A window begins at the last word start at or before its place and ends before the
    first word start at or after the next one's. The last window covers the last
    ``window`` tokens; its start moves back whenever the *first* token starts no word.
    """
    n = len(word)
    at = np.arange(0, max(n - 1, 0) // window + 1) * window
    starts = np.concatenate([[0], np.flatnonzero(word), [n]])
    begin = starts[np.searchsorted(starts[1:-1], at, "right")]
    end = starts[1:][np.searchsorted(starts[1:-1], at + window)]
    tail = max(n - window, 0)
    if n and tail and not word[0]:
        tail = starts[np.searchsorted(starts[1:-1], tail)]
    begin[-1], end[-1] = tail, n
    return begin, end


def _bounds(word: Column, window: int) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            flags = np.asarray(lists.flatten().fill_null(False).to_numpy(zero_copy_only=False), bool)
            sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
            ends = np.cumsum(sizes)
            # an article without tokens has no chunk
            spans = [window_bounds(flags[e - n : e], window) if n else (np.zeros(0, int),) * 2 for e, n in zip(ends.tolist(), sizes.tolist())]
            offsets = np.cumsum([0, *(len(b) for b, _ in spans)]).astype(np.int32)
            column = lambda i: pa.array(np.concatenate([s[i] for s in spans] or [np.zeros(0)]).astype(np.int32))
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([column(0), column(1)], ["start", "end"]))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    # not deterministic to the optimizer: no filter is pushed below it and tokenizes twice
    return F.arrow_udf(run, BOUNDS).asNondeterministic()(word)


def token_chunks(articles: DataFrame, window: int = 256, tokenizer: Tokenizer | None = None) -> DataFrame:
    """Cut articles into windows of ``window`` tokens, snapped outwards to word starts.

    ``id, title, url, text`` in; one row per chunk out, ``id`` extended by ``_0``,
    ``_1``... Everything is row-local: no shuffle, and a long article only makes
    its own row longer. Only the word-start flags cross to Python, where all bounds of
    an article are found by binary search; texts are joined once per chunk.
    """
    tok = tokenizer or default_tokenizer()
    pieces = articles.select(
        "id", "title", "url", tok.pieces(drop_long_words(embed_input(F.col("title"), F.col("text")))).alias("tok")
    )
    spans = pieces.withColumn("spans", _bounds(F.transform("tok", tok.starts_word), window))
    texts = F.transform("spans", lambda s: tok.join(F.slice("tok", s["start"] + 1, s["end"] - s["start"])))
    return spans.select("id", "title", "url", F.posexplode(texts).alias("pos", "text")).select(
        F.concat_ws("_", "id", F.col("pos").cast("string")).alias("id"), "title", "url", "text"
    )


def _merge(edges: list[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """Greedy chunks over contiguous pieces given by their edges."""
    out, a, last = [], 0, len(edges) - 1
    while True:
        b = bisect_right(edges, edges[a] + size) - 1
        out.append((edges[a], edges[b]))
        if b == last:
            return out
        a = min(b, max(bisect_left(edges, edges[b] - overlap), bisect_left(edges, edges[b + 1] - size)))


def _spans(text: str, lo: int, hi: int, level: int, size: int, overlap: int):
    """Chunk offsets of ``text[lo:hi]``, cut at the first separator from ``level`` on that occurs."""
    while SEPARATORS[level] and text.find(SEPARATORS[level], lo, hi) < 0:
        level += 1
    sep = SEPARATORS[level]
    if sep:
        edges, at = [lo], text.find(sep, lo, hi)
        while at >= 0:
            if at > lo:
                edges.append(at)
            at = text.find(sep, at + len(sep), hi)
        edges.append(hi)
    else:
        edges = list(range(lo, hi + 1))

    run = [edges[0]]
    for left, right in zip(edges, edges[1:]):
        if right - left < size:
            run.append(right)
            continue
        if len(run) > 1:
            yield from _merge(run, size, overlap)
        yield from _spans(text, left, right, level + 1, size, overlap)
        run = [right]
    if len(run) > 1:
        yield from _merge(run, size, overlap)


def recursive_spans(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> list[str]:
    """Chunks of one text: works on offsets, the text is sliced once per chunk."""
    chunks = (text[a:b].strip() for a, b in _spans(text, 0, len(text), 0, size, overlap))
    return [c for c in chunks if c]


@F.arrow_udf(T.ArrayType(T.StringType()))
def _recursive_chunks(texts: pa.Array) -> pa.Array:
    return pa.array(
        [None if t is None else recursive_spans(t) for t in texts.to_pylist()], pa.list_(pa.string())
    )


def recursive_chunks(text: Column) -> Column:
    """Array of chunks of at most 3000 characters with up to 100 characters of overlap."""
    return _recursive_chunks(text)


def ratio_groups(passages: Column, ratio: int, tail: str = "keep") -> Column:
    """Groups of ``ratio`` passages in order, then the last ``ratio`` passages as a tail group.

    The tail repeats the last full group when the count divides evenly;
    ``tail="dedupe"`` leaves it out then.
    """
    return let(passages, lambda p: _groups(p, ratio, tail))


def _groups(passages: Column, ratio: int, tail: str) -> Column:
    n = F.size(passages)
    full = F.floor(n / ratio).cast("int")
    heads = F.when(
        full > 0,
        F.transform(F.sequence(F.lit(0), full - 1), lambda j: F.slice(passages, j * ratio + 1, ratio)),
    ).otherwise(F.array().cast("array<array<string>>"))
    last = F.array(F.slice(passages, F.greatest(n - ratio, F.lit(0)) + 1, ratio))
    groups = F.concat(heads, last)
    if tail == "dedupe":
        return F.when((n > 0) & (n % ratio == 0), heads).otherwise(groups)
    return groups


def seeded_order(passages: Column, seed_text: Column) -> Column:
    """Reproducible permutation of an array, fixed by a text; the same on any partitioning."""
    keyed = let(
        F.md5(seed_text),
        lambda seed: F.transform(
            passages, lambda p, i: F.struct(F.md5(F.concat(seed, F.lit(":"), i.cast("string"))).alias("k"), p.alias("p"))
        ),
    )
    return F.transform(F.array_sort(keyed), lambda s: s["p"])
