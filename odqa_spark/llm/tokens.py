"""Words of many texts at once, as arrays of positions and 64-bit hashes.

A word is a run of letters, digits and underscores of any script. Texts are joined into one
byte buffer; a prefix sum of byte values times powers of an odd base gives the hash of every
word without a loop over words.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_OTHER = re.compile(r"[^\w\x00-\x7f]")
#: Lead bytes of punctuation outside ASCII: Latin, general, symbols, CJK, full-width, Arabic, Indic.
_LEADS = (b"\xc2", b"\xe2", b"\xe3\x80", b"\xef\xb8", b"\xef\xbc", b"\xef\xbd", b"\xd8", b"\xe0\xa5", b"\xf0", b"\xcc", b"\xd6", b"\xe1", b"\xdb", b"\xce", b"\xcd", b"\xd7")
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

_WORD = np.zeros(256, bool)
_WORD[[b for b in range(128) if chr(b).isalnum() or chr(b) == "_"]] = True
_WORD[128:] = True


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            with np.errstate(over="ignore"):
                _POWERS[i] = np.cumprod(p, dtype=np.uint64)
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads close ones (splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_prefix(buffer: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``hash_cut`` takes the hash of any byte range."""
    power, _ = _powers(len(buffer) + 1)
    prefix = np.zeros(len(buffer) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * power[: len(buffer)], out=prefix[1:])
    return prefix


def hash_cut(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each range, the same wherever they stand; not for the empty range."""
    _, inverse = _powers(len(prefix))
    with np.errstate(over="ignore"):
        return mix((prefix[end] - prefix[start]) * inverse[start])


def hash_range(buffer: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return hash_cut(hash_prefix(buffer), start, end)


def plain(text: str) -> str:
    """``text`` with other scripts' punctuation as spaces: same length."""
    if text.isascii():
        return text
    raw = text.encode("utf-8", "surrogatepass")
    return _OTHER.sub(" ", text) if any(b in raw for b in _LEADS) else text


def lowered(text: str) -> str:
    """Lower case with the same number of characters."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low


def hash_word(word: str) -> int:
    """Signed hash of one word, as the arrays have it."""
    b = np.frombuffer(word.encode("utf-8", "surrogatepass"), np.uint8)
    return int(hash_range(b, np.array([0]), np.array([len(b)])).view(np.int64)[0])


@dataclass
class Words:
    """Words of a block of texts: row of the text, byte range in ``buffer``, hash of the lower-cased word."""

    buffer: np.ndarray
    cased: np.ndarray
    text_start: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    n_texts: int

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_texts)

    def word(self, i: int) -> str:
        return self.buffer[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


def text_of(start: np.ndarray, text_start: np.ndarray) -> np.ndarray:
    """The row of the text in which each (ascending) position lies."""
    first = np.searchsorted(start, text_start)
    return np.repeat(np.arange(len(text_start)), np.diff(np.concatenate([first, [len(start)]])))


def among(codes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which codes are in the few sorted ``keys``: a table of their low bits first, then exactly."""
    table = np.zeros(1 << 16, bool)
    table[keys & np.uint64(0xFFFF)] = True
    found = table[codes & np.uint64(0xFFFF)]
    may = np.flatnonzero(found)
    found[may] = np.isin(codes[may], keys)
    return found


def words(texts: list[str | None], cased: bool = False) -> Words:
    """All words of the texts; with ``cased`` the buffer before lower-casing is kept too."""
    kept = [plain(t or "") for t in texts]
    low = [lowered(t) for t in kept]
    raw = [t.encode("utf-8", "surrogatepass") for t in low]
    buffer = np.frombuffer(b"\x00".join(raw) + b"\x00", np.uint8)
    sizes = np.array([len(r) + 1 for r in raw], np.int64)
    text_start = np.cumsum(sizes) - sizes
    other = np.empty(0, np.uint8)
    if cased:
        # lower-casing can change the number of bytes; such texts fall back to the lower form
        pieces = [t.encode("utf-8", "surrogatepass") for t in kept]
        other = np.frombuffer(b"\x00".join(c if len(c) == len(r) else r for c, r in zip(pieces, raw)) + b"\x00", np.uint8)
    inside = _WORD[buffer]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[::2], edge[1::2]
    doc = text_of(start, text_start)
    return Words(buffer, other, text_start, doc, start, end, hash_range(buffer, start, end), len(texts))
