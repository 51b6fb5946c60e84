"""Completion calls that are kept: over all runs, each different prompt is called once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from odqa_spark.operators.models import MAX_IN_FLIGHT, complete
from odqa_spark.session import hadoop_path, materialize

STORE = "key string, text string, error string"
WIDTH = 50  # tasks of a wave of calls, whatever the number of executors
WAVE_CALLS = 100_000  # calls whose results are committed together


def call_key(model: str, system: Column, prompt: Column) -> Column:
    """What a stored result belongs to: a digest of model, system text and prompt."""
    return F.sha2(F.to_json(F.struct(F.lit(model).alias("model"), system.alias("system"), prompt.alias("prompt"))), 256)


def stored_results(spark: SparkSession, store: str) -> DataFrame:
    """``key, text, error``: one row per key, an answer if one of its calls gave one."""
    fs, path = hadoop_path(spark, store)
    calls = spark.read.schema(STORE).parquet(store) if fs.exists(path) else spark.createDataFrame([], STORE)
    best = F.min_by(F.struct("text", "error"), F.col("error").isNotNull())
    return calls.groupBy("key").agg(best.alias("best")).select("key", "best.text", "best.error")


def complete_stored(
    rows: DataFrame,
    prompt: Column,
    make_fn: Callable[[], Callable[..., str]],
    store: str,
    model: str,
    system: Column | None = None,
    max_in_flight: int = MAX_IN_FLIGHT,
    width: int = WIDTH,
    wave_calls: int = WAVE_CALLS,
    retry_failed: bool = True,
    **options,
) -> DataFrame:
    """``rows`` with ``text, error`` (in place of columns of that name), called only for what ``store`` does not hold yet.

    ``store`` is a folder of results by ``call_key``. Prompts that it answers are not called, a
    prompt that many rows have is called once, and results are appended in waves: a job that
    is ended resumes behind its last wave. Stored failures are called again unless ``retry_failed``
    is off. A wave has ``width`` tasks, ``max_in_flight`` at most, that share ``max_in_flight``
    requests: the bound holds with any number of executors, also when it changes. A row
    without prompt is not called. Other options are those of ``complete``.
    """
    spark = rows.sparkSession
    asked = F.lit(None).cast("string") if system is None else system
    columns = rows.columns
    keyed = rows.select("*", prompt.alias("_prompt"), asked.alias("_system"))
    keyed = keyed.withColumn("_key", F.when(F.col("_prompt").isNotNull(), call_key(model, F.col("_system"), F.col("_prompt"))))
    wanted = keyed.where("_key is not null").groupBy(F.col("_key").alias("key")).agg(
        F.any_value("_prompt").alias("prompt"), F.any_value("_system").alias("system")
    )
    held = stored_results(spark, store)
    if retry_failed:
        held = held.where("error is null")
    missing = materialize(wanted.join(held.select("key"), "key", "left_anti"), "missing-calls")
    width = min(width, max_in_flight)
    waves = -(-missing.count() // wave_calls)
    for wave in range(waves):
        part = missing.where(F.pmod(F.xxhash64("key"), F.lit(waves)) == wave).repartition(width)
        text = F.col("system") if system is not None else None
        done = part.withColumn("done", complete(F.col("prompt"), make_fn, text, max_in_flight, width, **options))
        done.select("key", "done.text", "done.error").write.mode("append").parquet(store)
    answers = materialize(stored_results(spark, store).join(wanted.select("key"), "key", "left_semi"), "answers")
    answers = answers.select(F.col("key").alias("_answered"), F.struct("text", "error").alias("_answer"))
    # rows without prompt have a key that no prompt has, and do not meet in one task
    key = F.coalesce("_key", F.concat(F.lit("none "), F.xxhash64(*columns).cast("string")))
    found = keyed.join(answers, key == F.col("_answered"), "left")
    none = F.struct(F.lit("").alias("text"), F.lit("no prompt").alias("error"))
    done = found.withColumn("_answer", F.when(F.col("_key").isNull(), none).otherwise(F.col("_answer")))
    kept = [c for c in columns if c not in ("text", "error")]
    return done.select(*kept, F.col("_answer.text").alias("text"), F.col("_answer.error").alias("error"))
