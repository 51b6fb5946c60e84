"""The batch operators on unbounded input.

Every job runs what is available, then stops, unless a ``period`` is given: then a batch starts
each period, and ``drained`` ends the query when its source is empty.
``partitions`` spreads micro-batches of few files over more tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from odqa_spark.functions.tokens import Tokenizer
from odqa_spark.operators.chunk import token_chunks
from odqa_spark.operators.profile import histogram_row, token_stats
from odqa_spark.operators.vector_table import FATE, append_passages, early_reason
from odqa_spark.plans.indexing import append_articles, vector_rows
from odqa_spark.plans.qa import qa_run
from odqa_spark.schemas import TEXT_MAX, VECTOR_DIM
from odqa_spark.session import hadoop_path, scratch_scope, settings


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _start(writer, checkpoint: str, period: str | None) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=period) if period else writer.trigger(availableNow=True)
    return writer.start()


def _spread(rows: DataFrame, partitions: int | None) -> DataFrame:
    return rows.repartition(partitions) if partitions else rows


def stream_chunks(
    articles: DataFrame, out: str, checkpoint: str, window: int = 256, tokenizer: Tokenizer | None = None,
    period: str | None = None, partitions: int | None = None,
) -> StreamingQuery:
    """Stateless: passages are appended to Parquet files at ``out``."""
    chunks = token_chunks(_spread(articles, partitions), window, tokenizer)
    return _start(chunks.writeStream.format("parquet").option("path", out).outputMode("append"), checkpoint, period)


def stream_histogram(
    articles: DataFrame, out: str, checkpoint: str, tokenizer: Tokenizer | None = None, period: str | None = None,
    partitions: int | None = None,
) -> StreamingQuery:
    """Running token and character histograms; ``newest_state(out)`` is the latest one-row state.

    Every batch writes a folder of its own and then removes the older ones, so a
    reader never meets an empty folder; a repeated batch replaces its own.
    """
    running = histogram_row(token_stats(_spread(articles, partitions), tokenizer))

    def replace(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/state={batch_id}")
        fs, root = hadoop_path(batch.sparkSession, out)
        for entry in fs.listStatus(root):
            name = entry.getPath().getName()
            if name.startswith("state=") and int(name[6:]) < batch_id - 1:
                fs.delete(entry.getPath(), True)

    return _start(running.writeStream.outputMode("complete").foreachBatch(replace), checkpoint, period)


def newest_state(spark: SparkSession, out: str) -> DataFrame:
    """The latest complete state that ``stream_histogram`` wrote."""
    fs, root = hadoop_path(spark, out)
    done = [e.getPath() for e in fs.listStatus(root) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(e.getPath(), "_SUCCESS"))]
    newest = max(done, key=lambda p: int(p.getName()[6:]))
    return spark.read.parquet(newest.toString())


def stream_index(
    articles: DataFrame, table: str, checkpoint: str, prefix: str = "", make_fn=None, dim: int = VECTOR_DIM,
    max_text: int = TEXT_MAX, period: str | None = None, partitions: int | None = None,
) -> StreamingQuery:
    """Append to the vector table. A repeated batch finds its ids present: it embeds and adds nothing.

    A batch of few ids reads only the buckets of the table that can hold them.
    """

    def load(batch: DataFrame, batch_id: int) -> None:
        with scratch_scope(batch.sparkSession):
            append_articles(_spread(batch, partitions), table, prefix, make_fn, dim, max_text)

    return _start(articles.writeStream.foreachBatch(load), checkpoint, period)


def stream_new_articles(
    articles: DataFrame, table: str, checkpoint: str, prefix: str = "", make_fn=None, dim: int = VECTOR_DIM,
    max_text: int = TEXT_MAX, period: str | None = None, partitions: int | None = None,
) -> StreamingQuery:
    """Append to a vector table that only this stream writes, told apart by keyed state instead of the table.

    The ids that the stream has passed on are its state, in RocksDB and in the checkpoint, so a batch is
    not compared with the table: an id is embedded once, whatever the table's size, over batches and
    restarts. An article that a limit rejects is passed on once per limit, so that a later
    version with the same id can still be accepted. The first batch after a start may be one that
    was written but not committed; it alone is compared with the table.
    """
    # rows without id are told apart by their content
    own = F.coalesce(F.col("id").cast("string"), F.concat(F.lit("\u0000"), F.xxhash64("title", "text").cast("string")))
    known = articles.withColumns({"_own": own, "_limit": early_reason(max_text)}).dropDuplicates(["_own", "_limit"]).drop("_own", "_limit")
    first = []

    def load(batch: DataFrame, batch_id: int) -> None:
        with scratch_scope(batch.sparkSession):
            rows = _spread(batch, partitions)
            if first:
                rows = rows.withColumns({flag: F.lit(False) for flag in FATE})
                append_passages(vector_rows(rows, prefix, make_fn), table, dim, max_text, "append_all")
            else:
                append_articles(rows, table, prefix, make_fn, dim, max_text)
        first.append(batch_id)

    # a started query keeps the settings it has seen
    with settings(articles.sparkSession, spark__sql__streaming__stateStore__providerClass=ROCKSDB):
        return _start(known.writeStream.foreachBatch(load), checkpoint, period)


def drained(query: StreamingQuery) -> list[dict]:
    """Stop a paced query once all its source had at hand is processed: number, rows and start of its batches."""
    try:
        query.processAllAvailable()
        return [
            {"batch": p["batchId"], "rows": p["numInputRows"], "start": p["timestamp"]}
            for p in query.recentProgress
            if p["numInputRows"] > 0
        ]
    finally:
        query.stop()


def stream_qa(
    questions: DataFrame, passages: DataFrame, out: str, checkpoint: str, config: str, period: str | None = None, **options
) -> StreamingQuery:
    """Answer arriving questions against a static passage table; every batch owns one folder of ``out``.

    Every batch searches all passages, so their vectors should be stored, not computed
    columns. What a batch leaves in the shared folder is deleted after its commit.
    """

    def answer(batch: DataFrame, batch_id: int) -> None:
        with scratch_scope(batch.sparkSession):
            qa_run(batch, passages, config, **options).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return _start(questions.writeStream.foreachBatch(answer), checkpoint, period)
