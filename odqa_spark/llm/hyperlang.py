"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram is the element-wise product of its
letters' vectors, each rotated by its place; a profile is the sum of the n-gram vectors. A
document's profile is compared with the profiles of the languages by cosine.

Defined cases: a text that is null or has no letter gets ``und`` and score 0. Training rows
with null language or text are left out. Without any training row all documents are ``und``.
Equal cosines go to the language first in order. Runs of other characters count as one space.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odqa_spark.llm.frames import SLICE_BYTES, map_slices, slices
from odqa_spark.llm.tokens import mix

DIMENSIONS = 1024
ORDER = 3
MAX_PROFILE_BYTES = 64 << 20
PIECE_CHARS = 1 << 18
GRAMS = 1024  # vectors multiplied at once
KEPT_BYTES = 64 << 20  # of vectors that a worker keeps for its next texts
_SPACE = 0x20
_END = 0x0A  # never a letter: between documents
_LETTER = np.zeros(0, bool)


def _letters() -> np.ndarray:
    global _LETTER
    if not len(_LETTER):
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


@lru_cache(maxsize=1 << 16)
def _letter_vector(code: int, dims: int) -> np.ndarray:
    return np.where(np.random.Generator(np.random.PCG64(code)).random(dims) < 0.5, -1, 1).astype(np.int8)


def _pieces(text: str | None, order: int) -> Iterator[str]:
    """A text in lower case between two spaces, long ones in pieces that hold each of its n-grams once.

    A piece ends where letters stand on both sides, so that gaps stay whole, and goes on into the
    next one by the letters of an n-gram that begins before the cut.
    """
    t = "\x20" + (text or "").lower() + "\x20"
    at = 0
    while len(t) - at > PIECE_CHARS + order:
        cut = at + PIECE_CHARS
        while cut + order < len(t) and not t[cut - 1 : cut + order - 2].isalpha():
            cut += 1
        if cut + order >= len(t):
            break
        yield t[at : cut + order - 1]
        at = cut
    yield t[at:]


def _grams(raw: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes of the distinct n-grams, row per n-gram occurrence, index of its distinct n-gram)."""
    codes = np.frombuffer("\x0a".join(raw).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(r) + 1 for r in raw], np.int64)
    row = np.repeat(np.arange(len(raw)), sizes)[: len(codes)]
    letter = _letters()[codes]
    codes = np.where(letter, codes, np.where(codes == _END, _END, _SPACE))
    # a line feed inside a text is an ordinary gap: only the joints between rows end a profile
    joint = np.zeros(len(codes), bool)
    joint[np.cumsum(sizes)[:-1] - 1] = True
    codes = np.where(joint, _END, np.where(codes == _END, _SPACE, codes))
    gap = codes == _SPACE
    keep = ~(gap & np.concatenate([[False], gap[:-1]]))
    codes, row = codes[keep], row[keep]
    if len(codes) < order:
        return np.zeros((0, order), np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    alphabet = np.flatnonzero(np.bincount(codes, minlength=1))
    small = np.zeros(int(codes.max()) + 1, np.int64)
    small[alphabet] = np.arange(len(alphabet))
    at = small[codes]
    size = len(alphabet)
    key = np.zeros(len(codes) - order + 1, np.int64)
    ok = np.ones(len(key), bool)
    some = np.zeros(len(key), bool)
    for i in range(order):
        part = codes[i : i + len(key)]
        key = key * size + at[i : i + len(key)]
        ok &= part != _END
        some |= part > _SPACE
    ok &= some
    key, row = key[ok], row[: len(ok)][ok]
    if size**order <= 1 << 22:
        present = np.flatnonzero(np.bincount(key, minlength=1))
        index = np.zeros(size**order, np.int64)
        index[present] = np.arange(len(present))
        index = index[key]
    else:
        present, index = np.unique(key, return_inverse=True)
    grams = np.empty((len(present), order), np.uint32)
    rest = present.copy()
    for i in reversed(range(order)):
        grams[:, i] = alphabet[rest % size]
        rest //= size
    return grams, row, index


def _made(grams: np.ndarray, dims: int) -> np.ndarray:
    """The product of each n-gram's letter vectors, each rotated by its place."""
    letters, at = np.unique(grams, return_inverse=True)
    at = at.reshape(grams.shape)
    table = np.stack([_letter_vector(int(c), dims) for c in letters])
    out = np.ones((len(grams), dims), np.int8)
    for place in range(grams.shape[1]):
        out *= np.roll(table, place, axis=1)[at[:, place]]
    return out


class _Kept:
    """Vectors of the n-grams met last, one for each of a fixed number of slots."""

    def __init__(self, dims: int, order: int):
        slots = KEPT_BYTES // dims
        self.grams = np.full((slots, order), np.iinfo(np.uint32).max, np.uint32)
        self.vectors = np.zeros((slots, dims), np.int8)

    def vectors_of(self, grams: np.ndarray) -> np.ndarray:
        key = np.zeros(len(grams), np.uint64)
        with np.errstate(over="ignore"):
            for place in range(grams.shape[1]):
                key = mix(key * np.uint64(31) + grams[:, place])
        slot = (key % np.uint64(len(self.grams))).astype(np.int64)
        out = self.vectors[slot]
        new = np.flatnonzero((self.grams[slot] != grams).any(axis=1))
        if len(new):
            out[new] = _made(grams[new], out.shape[1])
            self.grams[slot[new]], self.vectors[slot[new]] = grams[new], out[new]
        return out.astype(np.float32)


@lru_cache(maxsize=1)
def _kept(dims: int, order: int) -> _Kept:
    return _Kept(dims, order)


def _bundles(texts: list[str | None], which: np.ndarray, n: int, dims: int, order: int) -> np.ndarray:
    """``n`` profiles: the n-gram vectors of all texts, each added to the profile ``which`` of its text.

    Texts go in pieces, and n-grams in blocks, so that memory is bounded for any text and alphabet.
    """
    out = np.zeros((n, dims))
    kept = _kept(dims, order)
    held: list[str] = []
    rows: list[int] = []

    def add() -> None:
        grams, row, index = _grams(held, order)
        if not len(grams):
            return
        # sixteen bits, where they do, are sorted much faster
        by_gram = np.argsort(index.astype(np.uint16) if len(grams) <= 1 << 16 else index, kind="stable")
        row, index = row[by_gram], index[by_gram]
        own = np.zeros((len(held), dims), np.float64)
        for a in range(0, len(grams), GRAMS):
            b = min(a + GRAMS, len(grams))
            lo, hi = np.searchsorted(index, [a, b])
            counts = np.bincount(row[lo:hi] * (b - a) + index[lo:hi] - a, minlength=len(held) * (b - a))
            own += counts.reshape(len(held), b - a).astype(np.float32) @ kept.vectors_of(grams[a:b])
        np.add.at(out, rows, own)

    size = 0
    for text, row in zip(texts, which.tolist()):
        for piece in _pieces(text, order):
            held.append(piece)
            rows.append(row)
            size += len(piece)
            if size > PIECE_CHARS:
                add()
                held.clear()
                rows.clear()
                size = 0
    if held:
        add()
    return out


def language_profiles(train: DataFrame, text: str = "text", lang: str = "lang", dims: int = DIMENSIONS, order: int = ORDER) -> dict[str, np.ndarray]:
    """Bundle of each language over all rows of ``train``.

    Tasks send one vector per language; the driver gets one per language and raises if these
    exceed ``MAX_PROFILE_BYTES``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for a, b in slices(batch.column(0), SLICE_BYTES):
                piece = batch.slice(a, b - a)
                langs = np.array(piece.column(1).to_pylist(), object)
                names, which = np.unique(langs.astype(str), return_inverse=True)
                sums = _bundles(piece.column(0).to_pylist(), which, len(names), dims, order)
                for name, v in zip(names, sums):
                    total[name] = total.get(name, 0) + v
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total)), pa.array([np.rint(v).astype(np.int64) for v in total.values()], pa.list_(pa.int64()))], ["lang", "v"]
            )

    rows = train.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    parts = rows.mapInArrow(run, "lang string, v array<bigint>").select("lang", F.posexplode("v").alias("i", "x"))
    sums = parts.groupBy("lang", "i").agg(F.sum("x").alias("x"))
    n = sums.where("i = 0").count()
    if n * dims * 8 > MAX_PROFILE_BYTES:
        raise ValueError(f"{n} languages exceed the bound on profiles")
    got = sums.toPandas()
    out = {}
    for name, g in got.groupby("lang"):
        v = np.zeros(dims)
        v[g["i"].to_numpy()] = g["x"].to_numpy(np.float64)
        out[str(name)] = v
    return dict(sorted(out.items()))


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], id_col: str = "doc_id", text: str = "text", dims: int = DIMENSIONS, order: int = ORDER) -> DataFrame:
    """(id_col, lang_pred, score): the language whose profile has the largest cosine with the text's."""
    names = list(profiles)
    matrix = np.stack([v / max(np.linalg.norm(v), 1e-30) for v in profiles.values()]) if names else None

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        best, score = np.full(n, -1), np.zeros(n)
        if names:
            own = _bundles(batch.column(1).to_pylist(), np.arange(n), n, dims, order)
            size = np.linalg.norm(own, axis=1)
            some = np.flatnonzero(size)
            cosine = (own[some] / size[some, None]) @ matrix.T
            best[some] = cosine.argmax(1)
            score[some] = np.clip(cosine.max(1, initial=-1.0), 0.0, 1.0)
        pred = pa.array([names[i] if i >= 0 else "und" for i in best.tolist()], pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), pred, pa.array(score)], [id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_slices(docs.select(id_col, text), text, run, f"`{id_col}` {kind}, lang_pred string, score double")
