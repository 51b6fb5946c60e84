"""Tokenizers as column expressions.

A tokenizer turns a text column into an array of *pieces* whose concatenation is
the text, and pieces back into text. The default is native and lossless; its
counts are not comparable with those of a trained vocabulary. ``bpe`` runs a
vocabulary file the user holds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: a piece is a space, if any, with up to four non-space characters, or one white-space character.
PIECE_PATTERN = r" ?[^ \t\r\n]{1,4}|[ \t\r\n]"


@dataclass(frozen=True)
class Tokenizer:
    pieces: Callable[[Column], Column]
    join: Callable[[Column], Column]
    count: Callable[[Column], Column]

    @staticmethod
    def starts_word(piece: Column) -> Column:
        return F.startswith(piece, F.lit(" "))


def default_tokenizer() -> Tokenizer:
    pattern = F.lit(PIECE_PATTERN)
    return Tokenizer(
        pieces=lambda text: F.regexp_extract_all(text, pattern, F.lit(0)),
        join=lambda pieces: F.array_join(pieces, ""),
        count=lambda text: F.regexp_count(text, pattern).cast("bigint"),
    )


def bpe_tokenizer(ranks_path: str, split_pattern: str, name: str = "user") -> Tokenizer:
    """Byte-pair tokenizer from a local rank file (base64 token and rank per line).

    The file must be readable on every worker (shipped with ``--files`` or baked
    into the image). A piece holds one character per byte (ISO-8859-1), since a
    token may end inside a UTF-8 character.
    """

    cache: dict[str, object] = {}

    def encoding():
        if "enc" not in cache:
            import base64

            import tiktoken

            with open(ranks_path, "rb") as f:
                pairs = (line.split() for line in f if line.strip())
                ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
            cache["enc"] = tiktoken.Encoding(name, pat_str=split_pattern, mergeable_ranks=ranks, special_tokens={})
        return cache["enc"]

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def pieces(texts: pa.Array) -> pa.Array:
        enc = encoding()
        out = []
        for text in texts.to_pylist():
            if text is None:
                out.append(None)
            else:
                out.append([enc.decode_single_token_bytes(t).decode("latin-1") for t in enc.encode_ordinary(text)])
        return pa.array(out, pa.list_(pa.string()))

    @F.arrow_udf(T.LongType())
    def count(texts: pa.Array) -> pa.Array:
        enc = encoding()
        return pa.array(
            [None if t is None else len(enc.encode_ordinary(t)) for t in texts.to_pylist()], pa.int64()
        )

    def join(parts: Column) -> Column:
        raw = F.encode(F.array_join(parts, ""), "ISO-8859-1")
        return F.make_valid_utf8(raw.cast("string"))

    return Tokenizer(pieces=pieces, join=join, count=count)
