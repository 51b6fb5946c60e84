"""Text expressions: normalisation, clean-up, word filters, prompt inputs."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The patterns the scoring and reading rules are defined by.
ASCII_PUNCTUATION = r"[!-/:-@\[-`{-~]"
ARTICLES = r"(?=[at])(?<![\p{L}\p{N}_])(a|an|the)(?![\p{L}\p{N}_])"
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"
ANSWER_NOISE = r"""[.()"',]"""
MAX_WORD = 1000


@F.arrow_udf(T.StringType())
def _nfd(texts: pa.Array) -> pa.Array:
    return pc.utf8_normalize(texts, form="NFD")


@F.arrow_udf(T.ArrayType(T.StringType()))
def _nfd_each(lists: pa.Array) -> pa.Array:
    # flatten() honours slicing and skips null lists, so offsets are rebuilt from list lengths.
    lengths = pc.fill_null(pc.list_value_length(lists), 0)
    ends = pc.cumulative_sum(lengths).to_pylist()
    offsets = pa.array([0] + ends, pa.int32())
    mask = pc.is_null(lists)
    values = pc.utf8_normalize(lists.flatten(), form="NFD")
    return pa.ListArray.from_arrays(offsets, values, mask=mask)


def _non_ascii(text: Column) -> Column:
    return F.octet_length(text) != F.length(text)


def nfd(text: Column) -> Column:
    """Canonical decomposition. Pure ASCII rows cross to Python as null, so only the rest pays."""
    odd = _non_ascii(text)
    return F.when(odd, _nfd(F.when(odd, text))).otherwise(text)


def nfd_each(texts: Column) -> Column:
    odd = F.exists(texts, _non_ascii)
    return F.when(odd, _nfd_each(F.when(odd, texts))).otherwise(texts)


def fold(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces."""
    bare = F.regexp_replace(F.lower(text), ASCII_PUNCTUATION, "")
    bare = F.regexp_replace(bare, ARTICLES, " ")
    return F.trim(F.regexp_replace(bare, WHITESPACE, " "))


def normalize(text: Column) -> Column:
    """Answer normalisation: decompose, then :func:`fold`."""
    return fold(nfd(text))


def normalize_each(texts: Column) -> Column:
    return F.transform(nfd_each(texts), fold)


def clean_answer(answer: Column) -> Column:
    """Delete the punctuation a span reader leaves around an answer."""
    return F.regexp_replace(answer, ANSWER_NOISE, "")


def embed_input(title: Column, text: Column, prefix: str = "") -> Column:
    """``prefix + title + newline + text``; a missing title or text is empty, so no row is lost."""
    return F.concat(F.lit(prefix), F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")))


def drop_long_words(text: Column, limit: int = MAX_WORD) -> Column:
    """Remove space-separated words of ``limit`` or more characters."""
    long_word = "[^ ]{%d,}" % limit
    kept = F.array_join(F.filter(F.split(text, " ", -1), lambda w: F.length(w) < limit), " ")
    return F.when(text.rlike(long_word), kept).otherwise(text)


def words(text: Column) -> Column:
    """Words between runs of white space, none of them empty."""
    return F.filter(F.split(text, WHITESPACE, -1), lambda w: w != "")


def word_span(text: Column, start: Column, end: Column) -> Column:
    """Words ``start`` (0-based) up to but not including ``end``, clipped, single-spaced."""
    size = F.greatest(end - start, F.lit(0))
    return F.array_join(F.slice(words(text), start + 1, size), " ")


def model_name(model: Column) -> Column:
    """``owner/name`` -> ``name``; text without a slash is kept."""
    return F.when(F.contains(model, F.lit("/")), F.split_part(model, F.lit("/"), F.lit(2))).otherwise(model)
