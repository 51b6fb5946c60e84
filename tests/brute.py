"""Plain Python forms of the rules, row by row, as written in the operator descriptions."""

from __future__ import annotations

import re
import string
import unicodedata
from collections import Counter

PIECE = re.compile(r" ?[^ \t\r\n]{1,4}|[ \t\r\n]")


def normalize(s: str) -> str:
    s = unicodedata.normalize("NFD", s).lower()
    s = "".join(c for c in s if c not in string.punctuation)
    return " ".join(re.sub(r"\b(a|an|the)\b", " ", s).split())


def exact_match(answers: list[str], prediction: str) -> float:
    known = {normalize(a) for a in answers}
    if normalize(prediction) in known:
        return 1.0
    for sep in (",", "and"):
        if sep in prediction:
            parts = [normalize(p) in known for p in prediction.split(sep)]
            return sum(parts) / len(parts)
    return 0.0


def f1(answers: list[str], prediction: str) -> float:
    def bag(s: str) -> list[str]:
        s = "".join(c for c in s.lower() if c not in string.punctuation)
        return re.sub(r"\b(a|an|the)\b", " ", s).split()

    best = 0.0
    for a in answers:
        p, g = bag(prediction), bag(a)
        same = sum((Counter(p) & Counter(g)).values())
        best = max(best, 2 * same / (len(p) + len(g)) if same else 0.0)
    return best


def token_chunks(article: dict, window: int, pieces=lambda s: PIECE.findall(s)) -> list[tuple[str, str]]:
    """Token by token: grow to the right up to a word start, to the left down to one."""
    text = " ".join(w for w in f"{article['title']}\n{article['text']}".split(" ") if len(w) < 1000)
    t = pieces(text)
    if not t:
        return []
    count = int((len(t) - 1) / window)
    out = []
    for i in range(count):
        lo, hi = i * window, (i + 1) * window
        while hi < len(t) and not t[hi].startswith(" "):
            hi += 1
        while lo > 0 and not t[lo].startswith(" "):
            lo -= 1
        out.append((f"{article['id']}_{i}", "".join(t[lo:hi])))
    lo = max(len(t) - window, 0)
    if lo > 0 and not t[0].startswith(" "):
        lo -= 1
        while lo > 0 and not t[lo].startswith(" "):
            lo -= 1
    out.append((f"{article['id']}_{count}", "".join(t[lo:])))
    return out


def recursive_chunks(text: str, size: int = 3000, overlap: int = 100, seps=("\n\n", "\n", " ", "")) -> list[str]:
    """Strings all the way: split, merge lists of strings, recurse on long pieces."""
    sep = next(s for s in seps if s in text)
    if sep:
        first, *rest = text.split(sep)
        pieces = [p for p in [first] + [sep + r for r in rest] if p]
    else:
        pieces = list(text)
    out: list[str] = []
    short: list[str] = []

    def merge() -> None:
        held: list[str] = []
        for p in short:
            total = sum(map(len, held))
            if total + len(p) > size:
                if held:
                    out.append("".join(held).strip())
                while total > overlap or (total + len(p) > size and total > 0):
                    total -= len(held.pop(0))
            held.append(p)
        if held:
            out.append("".join(held).strip())
        short.clear()

    for p in pieces:
        if len(p) < size:
            short.append(p)
        else:
            merge()
            out.extend(recursive_chunks(p, size, overlap, seps[seps.index(sep) + 1 :]))
    merge()
    return [c for c in out if c]
