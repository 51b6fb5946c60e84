"""Answer spans from start and end scores, and packing of token ids. Row-local array work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odqa_spark.functions.binding import let

TOP_SPANS = 10  # fixed value: spans returned per passage


def scored_spans(start_logits: Column, end_logits: Column, max_length: int) -> Column:
    """All spans of at most ``max_length`` tokens as ``(neg_score, i, j)``."""

    def ends(s: Column, i: Column) -> Column:
        return F.transform(
            F.slice(end_logits, i + 1, max_length),
            lambda e, d: F.struct((-(s + e)).alias("neg_score"), i.alias("i"), (i + d).alias("j")),
        )

    return F.flatten(F.transform(start_logits, ends))


def word_start(is_subword: Column, at: Column) -> Column:
    """Position of the token that starts the word of ``at``; 0 if none does."""
    back = F.array_position(F.reverse(F.slice(is_subword, 1, at + 1)), False)
    return F.when(back > 0, at + 1 - back).otherwise(0).cast("int")


def word_end(is_subword: Column, at: Column) -> Column:
    """Last position of the word of ``at``."""
    following = F.slice(is_subword, at + 2, F.size(is_subword))
    ahead = F.array_position(following, False)
    return F.when(ahead > 0, at + ahead - 1).otherwise(F.size(is_subword) - 1).cast("int")


def best_spans(
    passages: DataFrame,
    max_length: int = 8,
    top: int = TOP_SPANS,
    to_text=None,
) -> DataFrame:
    """The ``top`` spans of every passage, best first; equal scores in ``(i, j)`` order.

    Columns in: ``passage_id, token_ids, is_subword, start_logits, end_logits,
    relevance``. Scores are taken before spans grow to whole words, so two spans
    may grow to the same text and both stay. ``to_text`` maps the id array of a
    span to text; by default ids are joined with spaces.
    """
    render = to_text or (lambda ids: F.array_join(ids.cast("array<string>"), " "))
    ranked = F.slice(
        F.array_sort(scored_spans(F.col("start_logits"), F.col("end_logits"), max_length)), 1, top
    )
    rows = passages.select("*", F.posexplode(ranked).alias("span_rank", "_s")).select(
        "*",
        word_start(F.col("is_subword"), F.col("_s.i")).alias("start_index"),
        word_end(F.col("is_subword"), F.col("_s.j")).alias("end_index"),
    )
    span_ids = F.slice("token_ids", F.col("start_index") + 1, F.col("end_index") - F.col("start_index") + 1)
    return rows.select(
        "passage_id",
        "span_rank",
        "start_index",
        "end_index",
        (-F.col("_s.neg_score")).alias("span_score"),
        F.col("relevance").alias("relevance_score"),
        render(span_ids).alias("prediction_text"),
        F.col("token_ids").alias("passage_token_ids"),
    )


def pack_ids(
    text_ids: Column,
    length: int,
    pad: int,
    sep: int,
    cls: int,
    title_ids: Column | None = None,
    pad_to_max: bool = True,
) -> Column:
    """``[cls] title [sep] text [sep]`` (no title part if it is empty), padded to ``length``.

    What does not fit is cut from the longer of the two parts first, then from
    both in turn, text first. The last id is ``sep`` when the row is full.
    """

    def padded(packed: Column) -> Column:
        return F.concat(packed, F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - F.size(packed), F.lit(0))))

    if title_ids is None:
        packed = _joined(None, text_ids, length, sep, cls)
    else:
        packed = let(title_ids, lambda a: let(text_ids, lambda b: _joined(a, b, length, sep, cls)))
    return let(packed, padded) if pad_to_max else packed


def _joined(title_ids: Column | None, text_ids: Column, length: int, sep: int, cls: int) -> Column:
    none = F.array().cast("array<int>")
    mark = F.array(F.lit(sep))
    if title_ids is None:
        head, text = none, F.slice(text_ids, 1, length - 2)
    else:
        room = length - 3
        n_title, n_text = F.size(title_ids), F.size(text_ids)
        excess = F.greatest(n_title + n_text - room, F.lit(0))
        level = F.least(excess, F.abs(n_title - n_text))
        rest = excess - level
        cut_title = F.when(n_title > n_text, level).otherwise(0) + F.floor(rest / 2).cast("int")
        cut_text = excess - cut_title
        paired = n_title > 0
        head = F.when(paired, F.concat(F.slice(title_ids, 1, F.greatest(n_title - cut_title, F.lit(0))), mark)).otherwise(none)
        text = F.when(paired, F.slice(text_ids, 1, F.greatest(n_text - cut_text, F.lit(0)))).otherwise(
            F.slice(text_ids, 1, length - 2)
        )
    return F.concat(F.array(F.lit(cls)), head, text, mark)


def attention_mask(ids: Column, pad: int) -> Column:
    return F.transform(ids, lambda x: x != pad)
