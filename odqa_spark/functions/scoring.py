"""Answer scoring expressions. They take columns normalised once by the caller."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from odqa_spark.functions.binding import let
from odqa_spark.functions.text import fold


def prediction_parts(prediction: Column) -> Column:
    """Parts that can earn partial credit: by comma, else by ``and``, else none."""
    return (
        F.when(F.contains(prediction, F.lit(",")), F.split(prediction, ",", -1))
        .when(F.contains(prediction, F.lit("and")), F.split(prediction, "and", -1))
        .otherwise(F.array().cast("array<string>"))
    )


def exact_match(answers_norm: Column, prediction_norm: Column, parts_norm: Column) -> Column:
    """1 if any answer equals the prediction, else the share of parts that equal an answer."""
    hits = let(answers_norm, lambda known: F.size(F.filter(parts_norm, lambda p: F.array_contains(known, p))))
    return (
        F.when(F.array_contains(answers_norm, prediction_norm), F.lit(1.0))
        .when(F.size(parts_norm) > 0, hits.cast("double") / F.size(parts_norm))
        .otherwise(F.lit(0.0))
    )


def exact_contain(answers_norm: Column, context_norm: Column) -> Column:
    """True if any normalised answer occurs in the normalised context."""
    return let(context_norm, lambda c: F.exists(answers_norm, lambda a: F.contains(c, a)))


def answer_starts(answers: Column, context: Column) -> Column:
    """First offset of every answer in the raw context, -1 if absent, 0 if empty."""
    return F.transform(answers, lambda a: F.when(a == "", 0).otherwise(F.instr(context, a) - 1))


def _tokens(text: Column) -> Column:
    return F.filter(F.split(fold(text), " ", -1), lambda t: t != "")


def _overlap_f1(gold: Column, predicted: Column) -> Column:
    def times(bag: Column, token: Column) -> Column:
        return F.size(F.filter(bag, lambda t: t == token))

    same = F.aggregate(
        F.array_distinct(gold), F.lit(0), lambda acc, t: acc + F.least(times(gold, t), times(predicted, t))
    )
    total = F.size(gold) + F.size(predicted)
    return F.when(same > 0, F.lit(2.0) * same / total).otherwise(F.lit(0.0))


def _overlap_or_both_empty(gold: Column, predicted: Column) -> Column:
    one_empty = (F.size(gold) == 0) | (F.size(predicted) == 0)
    return F.when(one_empty, (F.size(gold) == F.size(predicted)).cast("double")).otherwise(_overlap_f1(gold, predicted))


def token_f1(answers: Column, prediction: Column, metric: str = "squad") -> Column:
    """Best token-overlap F1 over the answers, from 0 to 1.

    ``squad_v2`` lets an empty prediction match an answer that is empty too, and
    skips empty answers when others exist.
    """
    golds = F.transform(answers, _tokens)
    if metric == "squad":
        score = _overlap_f1
    elif metric == "squad_v2":
        golds = let(golds, lambda all_: F.filter(all_, lambda g: F.size(g) > 0))
        golds = let(golds, lambda g: F.when(F.size(g) > 0, g).otherwise(F.array(F.array().cast("array<string>"))))
        score = _overlap_or_both_empty
    else:
        raise ValueError(f"unknown metric: {metric!r}")
    return let(_tokens(prediction), lambda predicted: F.array_max(F.transform(golds, lambda g: score(g, predicted))))
