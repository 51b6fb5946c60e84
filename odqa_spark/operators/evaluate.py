"""Scoring of QA runs: row verdicts, metrics per run configuration, error samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odqa_spark.functions.scoring import answer_starts, exact_contain, exact_match, prediction_parts, token_f1
from odqa_spark.functions.text import normalize, normalize_each
from odqa_spark.functions.tokens import Tokenizer, default_tokenizer
from odqa_spark.session import materialize


def judge_rows(
    runs: DataFrame,
    label_col: str = "answer",
    predict_col: str = "predicted",
    context_col: str = "retrieved",
    summary_col: str = "summary",
) -> DataFrame:
    """Add ``em`` (0..1), ``in_retrieved`` and ``in_summary`` to every run row.

    Each text is normalised once; the verdicts are row-local, so no shuffle.
    """
    norm = runs.select(
        "*",
        normalize_each(F.col(label_col)).alias("_answers"),
        normalize(F.col(predict_col)).alias("_predicted"),
        normalize_each(prediction_parts(F.col(predict_col))).alias("_parts"),
        normalize(F.col(context_col)).alias("_retrieved"),
        normalize(F.col(summary_col)).alias("_summary"),
    )
    return norm.select(
        *runs.columns,
        exact_match(F.col("_answers"), F.col("_predicted"), F.col("_parts")).alias("em"),
        F.coalesce(exact_contain(F.col("_answers"), F.col("_retrieved")), F.lit(False)).alias("in_retrieved"),
        F.coalesce(exact_contain(F.col("_answers"), F.col("_summary")), F.lit(False)).alias("in_summary"),
    )


def rescore(runs: DataFrame, **columns) -> DataFrame:
    """The run table with ``score`` replaced by the exact-match score."""
    return judge_rows(runs, **columns).withColumn("score", F.col("em")).select(*runs.columns)


def _has_summary(summary_col: str) -> Column:
    return F.coalesce(F.col(summary_col), F.lit("")) != ""


def _percent(part: Column, whole: Column) -> Column:
    return F.try_divide(F.lit(100.0) * part, whole)


def run_metrics(
    runs: DataFrame,
    by: str = "config",
    metric: str = "squad",
    tokenizer: Tokenizer | None = None,
    label_col: str = "answer",
    predict_col: str = "predicted",
    context_col: str = "retrieved",
    summary_col: str = "summary",
) -> DataFrame:
    """All metrics of all run configurations in one aggregate.

    A run counts as summarised if any of its rows has a summary; then the reader
    saw the summary, else the retrieved text. Summary metrics are null otherwise.
    """
    tok = tokenizer or default_tokenizer()
    rows = judge_rows(runs, label_col, predict_col, context_col, summary_col).select(
        by, "em", "in_retrieved", "in_summary",
        token_f1(F.col(label_col), F.col(predict_col), metric).alias("f1"),
        _has_summary(summary_col).alias("has_summary"),
        tok.count(F.col(context_col)).alias("psgs_tokens"),
        tok.count(F.col(summary_col)).alias("summary_tokens"),
    )
    had, kept, right = F.col("in_retrieved"), F.col("in_summary"), F.col("em") != 0
    sums = rows.groupBy(by).agg(
        F.count("*").alias("rows"),
        F.bool_or("has_summary").alias("summarized"),
        F.sum("em").alias("em"),
        F.sum("f1").alias("f1"),
        F.sum("psgs_tokens").alias("psgs_tokens"),
        F.sum("summary_tokens").alias("summary_tokens"),
        F.count_if(had).alias("had"),
        F.count_if(kept).alias("kept"),
        F.count_if(had & kept).alias("had_kept"),
        F.count_if(had & ~kept).alias("lost"),
        F.count_if(~had & kept).alias("appeared"),
        F.count_if(had & ~right).alias("fp_retrieved"),
        F.count_if(kept & ~right).alias("fp_summary"),
        F.count_if(~had & right).alias("tn_retrieved"),
        F.count_if(~kept & right).alias("tn_summary"),
    )
    rows_, summarized = F.col("rows"), F.col("summarized")

    def if_summary(value: Column) -> Column:
        return F.when(summarized, value)

    def by_context(in_summary: str, in_retrieved: str) -> Column:
        return _percent(F.when(summarized, F.col(in_summary)).otherwise(F.col(in_retrieved)), rows_)

    return sums.select(
        by,
        "rows",
        "summarized",
        _percent(F.col("em"), rows_).alias("exact_match"),
        _percent(F.col("f1"), rows_).alias("f1"),
        (F.col("psgs_tokens") / rows_).alias("psgs_tokens"),
        if_summary(F.col("summary_tokens") / rows_).alias("summary_tokens"),
        if_summary(_percent(F.col("appeared"), rows_)).alias("sum_tn"),
        if_summary(_percent(F.col("lost"), rows_)).alias("sum_fn"),
        if_summary(_percent(F.col("had_kept"), F.col("had"))).alias("sum_rc"),
        _percent(F.col("had"), rows_).alias("ret_em"),
        if_summary(_percent(F.col("kept"), rows_)).alias("sum_em"),
        by_context("fp_summary", "fp_retrieved").alias("read_fp"),
        by_context("tn_summary", "tn_retrieved").alias("read_tn"),
    )


def error_samples(runs: DataFrame, by: str = "config", **columns) -> DataFrame:
    """The first row, by ``row_idx``, of every error class of every run.

    Only row numbers are aggregated (hash aggregate on longs). The winners, at most
    four per run, are written first, so the planner knows how few they are and
    broadcasts them instead of shuffling the run texts.
    """
    predict_col = columns.get("predict_col", "predicted")
    context_col = columns.get("context_col", "retrieved")
    summary_col = columns.get("summary_col", "summary")
    label_col = columns.get("label_col", "answer")
    had, kept, right = F.col("in_retrieved"), F.col("in_summary"), F.col("em") != 0

    def first(test: Column) -> Column:
        return F.min(F.when(test, F.col("row_idx")))

    firsts = judge_rows(runs, **columns).select(
        by, "row_idx", "em", "in_retrieved", "in_summary", _has_summary(summary_col).alias("has_summary")
    ).groupBy(by).agg(
        F.bool_or("has_summary").alias("s"),
        first(~had & kept).alias("appeared"),
        first(had & ~kept).alias("lost"),
        first(kept & ~right).alias("fp_s"),
        first(had & ~right).alias("fp_r"),
        first(~kept & right).alias("tn_s"),
        first(~had & right).alias("tn_r"),
    )

    def entry(name: str, row_idx: Column) -> Column:
        return F.struct(F.lit(name).alias("error_class"), row_idx.alias("row_idx"))

    s = F.col("s")
    classes = F.array(
        entry("sum_tn", F.when(s, F.col("appeared"))),
        entry("sum_fn", F.when(s, F.col("lost"))),
        entry("read_fp", F.when(s, F.col("fp_s")).otherwise(F.col("fp_r"))),
        entry("read_tn", F.when(s, F.col("tn_s")).otherwise(F.col("tn_r"))),
    )
    winners = materialize(firsts.select(by, F.inline(classes)).where(F.col("row_idx").isNotNull()), "samples")
    texts = runs.select(by, "row_idx", "question", context_col, summary_col, label_col, predict_col)
    return texts.join(winners, [by, "row_idx"])


def squad_references(runs: DataFrame, label_col: str = "answer", context_col: str = "retrieved") -> DataFrame:
    """References in span form: ``id`` and ``answers<answer_start, text>`` per row."""
    return runs.select(
        "row_idx",
        F.col("question").alias("id"),
        F.struct(
            answer_starts(F.col(label_col), F.col(context_col)).alias("answer_start"),
            F.col(label_col).alias("text"),
        ).alias("answers"),
    )


def match_predictions(references: DataFrame, predictions: DataFrame) -> DataFrame:
    """Pair predictions with references by row, since questions may repeat."""
    return references.join(predictions, "row_idx")


def count_check(df: DataFrame, **pairs: tuple[str, str]) -> DataFrame:
    """One row: for every name, whether both columns of the pair have the same number of values."""
    tests = [(F.count(a) == F.count(b)).alias(name) for name, (a, b) in pairs.items()]
    return df.agg(F.count("*").alias("rows"), *tests)
