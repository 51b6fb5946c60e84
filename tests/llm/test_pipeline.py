import corpus_pipeline
from pyspark.sql import functions as F

from compare import differences, duck
from odqa_spark.llm import decontaminate, queries, simhash
from odqa_spark.llm.frames import table


def test_stages_are_the_dealt_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]


def test_each_stage_takes_effect(spark, sf):
    docs = table(spark, sf, "documents").withColumn("_extra", F.lit("x"))
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = corpus_pipeline.scratch_path(spark, "t")
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        kept[name] = docs
    count = {k: v.count() for k, v in kept.items()}
    assert count["toxicity"] == count["line_dedup"] > count["near_dedup"] > count["decontamination"] > 0
    assert kept["line_dedup"].where(F.col("n_chars") != F.char_length("text")).count() == 0
    # nothing is left to do for the last two filters
    last = kept["decontamination"]
    assert simhash.simhash_components(last).where("doc_id <> component_id").count() == 0
    assert decontaminate.leaks(last, table(spark, sf, "benchmark")).count() == 0
    packed = corpus_pipeline.pack(spark, last, sf)
    assert packed.select("doc_id").distinct().count() == last.select("doc_id").distinct().count()


def test_run(spark, sf):
    packed = corpus_pipeline.run(spark, sf)
    bins = packed.where("bin_id is not null").groupBy("bin_id", "bin_size").agg(F.sum("n_tokens").alias("n"))
    assert bins.count() and bins.where("n > bin_size").count() == 0


def test_search_query_matches_sql(spark, sf):
    assert differences(queries.op1_voronoi_knn_join(spark, sf), duck(sf), queries.ORACLES["op1_voronoi_knn_join"]) is None


def test_empty_documents(spark, sf, tmp_path):
    docs = table(spark, sf, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
