import json
import re

import pytest
from pyspark.sql import functions as F

from odqa_spark import schemas
from odqa_spark.catalog import fixtures as fx
from odqa_spark.operators import annotations
from odqa_spark.operators.rows import join_by_position, numbered_rows, row_range_inclusive, row_slice, split_range, with_row_idx
from odqa_spark.session import build_session, settings, shared_dir
from odqa_spark.sources import run_keys, tables


def test_publish_replaces_only_its_configs(spark, tmp_path):
    root = str(tmp_path / "runs")
    a = spark.createDataFrame([(0, "x")], "row_idx bigint, v string")
    tables.publish(a, root, "k10_a")
    tables.publish(a, root, "k10_b")
    tables.publish(spark.createDataFrame([(0, "y"), (1, "z")], "row_idx bigint, v string"), root, "k10_b")
    assert tables.list_configs(spark, root) == ["k10_a", "k10_b"] and tables.list_configs(spark, root + "-none") == []
    assert [r.v for r in tables.read_dataset(spark, root, "k10_a").collect()] == ["x"]
    assert [r.v for r in tables.read_dataset(spark, root, "k10_b", "train[1:]").collect()] == ["z"]
    plan = tables.read_dataset(spark, root, "k10_b", "train[1:]")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(config" in plan and "GreaterThanOrEqual(row_idx,1)" in plan


def test_config_filters(spark):
    df = spark.createDataFrame([("k10_r0",), ("k10_r1",), ("k5",)], "config string")

    def names(**kw):
        return sorted(r.config for r in tables.filter_configs(df, **kw).collect())

    assert names() == names(contain="", exclude=None) == ["k10_r0", "k10_r1", "k5"]
    assert names(contain="k10") == ["k10_r0", "k10_r1"]
    assert names(contain="k10", exclude="r1") == ["k10_r0"]


def test_folder_read_is_a_bag_union(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "a")], "i int, t string")
    for part in ("one", "two"):
        tables.write_parquet(df, str(tmp_path / "all" / part))
    folder = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "all"))
    assert folder.count() == 4 == tables.union_all(df, df.select("t", "i")).count()


def test_json_lines_to_answers(spark, tmp_path):
    row = {
        "example_id": "7", "document_text": "w0 w1  w2\tw3 w4", "question_text": "q",
        "annotations": [{"long_answer": {"start_token": 1, "end_token": 9}, "short_answers": [{"start_token": 2, "end_token": 4}]}],
    }
    none = {**row, "example_id": "8", "annotations": [{"long_answer": {"start_token": 0, "end_token": 1}, "short_answers": []}]}
    path = tmp_path / "nq.jsonl"
    path.write_text("\n".join(map(json.dumps, [row, none])))
    raw = tables.read_json_lines(spark, str(path))
    assert raw.schema == schemas.NQ_RAW
    got = annotations.add_answer_texts(annotations.with_short_answer(raw)).collect()
    assert [(r.example_id, r.long_answer_text, r.short_answer_text) for r in got] == [("7", "w1 w2 w3 w4", "w2 w3")]


def test_split_ids_count_from_one(spark):
    rows = [("7", "a b\n" * 900, "q", "a b"), ("8", "", "q", "x")]
    df = spark.createDataFrame(rows, "example_id string, document_text string, question_text string, short_answer_text string")
    got = annotations.split_documents(df).collect()
    assert [r.split_id for r in got] == ["7_1", "7_2"] and all(r.answer_exist_chunk for r in got)
    assert all(len(r.document_text) <= 3000 for r in got)


def test_training_rows(spark):
    rows = [("1", "q", "d", "", True), ("2", "q", "d", None, True), ("3", "q", "d", "s", True), ("4", "q", "d", "s", False)]
    df = spark.createDataFrame(rows, "split_id string, question_text string, document_text string, summarization_text string, answer_exist_chunk boolean")
    assert [r.split_id for r in annotations.drop_failed_summaries(df).collect()] == ["2", "3", "4"]
    got = annotations.training_pairs(df, special_token=True).collect()
    assert [(r.split_id, r.input, r.target) for r in got] == [("2", "q<sep>d", None), ("3", "q<sep>d", "s")]


def test_row_idx_is_dense_and_ordered_with_a_hot_key(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50).cast("int").alias("a"), F.col("id").alias("b")
    ).repartition(6)
    got = with_row_idx(rows, "a", "b").orderBy("row_idx").collect()
    assert [r.row_idx for r in got] == list(range(3000))
    assert [(r.a, r.b) for r in got] == sorted((r.a, r.b) for r in rows.collect())


@pytest.mark.parametrize("bounds", [(None, None), (0, 0), (0, 1), (700, 2100), (2999, None), (3000, None), (None, 5), (100, 90), (-5, 20)])
def test_numbered_rows_read_only_the_partitions_of_a_range(spark, bounds):
    rows = spark.range(3000).select((F.col("id") % 3).alias("a"), F.col("id").alias("b"))
    if not hasattr(test_numbered_rows_read_only_the_partitions_of_a_range, "kept"):
        with settings(spark, spark__sql__adaptive__coalescePartitions__enabled="false"):
            test_numbered_rows_read_only_the_partitions_of_a_range.kept = numbered_rows(rows, "a", "b")
    numbered = test_numbered_rows_read_only_the_partitions_of_a_range.kept
    start, end = bounds
    order = sorted((r.a, r.b) for r in rows.collect())
    want = [(i, *order[i]) for i in range(max(start or 0, 0), min(3000, 3000 if end is None else end))]
    got = numbered.slice(start, end)
    assert sorted((r.row_idx, r.a, r.b) for r in got.collect()) == want
    offsets = numbered._offsets()
    assert sum(n for _, _, n in offsets) == 3000 and len(offsets) == 4
    # the scan lists the partitions that hold a row of the range, and no other
    if not want:
        return
    scan = next(line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line)
    listed = scan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    for p, at, n in offsets:
        hit = at < want[-1][0] + 1 and at + n > want[0][0]
        assert hit == bool(re.search(rf"\b{p}\b", re.sub(r"_part#\d+|\[plan_id=\d+\]", "", listed))) or len(want) == 3000


def test_numbered_rows_of_an_empty_table(spark):
    numbered = numbered_rows(spark.range(0), "id")
    assert numbered.frame().columns == ["id", "row_idx"] and numbered.slice(5, 9).count() == 0


def test_row_slices(spark):
    df = spark.range(10).withColumnRenamed("id", "row_idx")

    def ids(d):
        return sorted(r.row_idx for r in d.collect())

    assert ids(row_slice(df, 3, 5)) == [3, 4] and ids(row_slice(df)) == list(range(10))
    assert ids(row_range_inclusive(df, 0, 2)) == ids(row_range_inclusive(df, 1, 2)) == [0, 1]
    assert ids(row_range_inclusive(df, 9, 99)) == [8, 9]
    with pytest.raises(ValueError):
        row_slice(spark.range(1), 0, 1)
    assert split_range("train[10630000:]") == ("train", 10630000, None)
    assert split_range("validation") == ("validation", None, None)
    with pytest.raises(ValueError):
        split_range("train[1:2")


def test_join_by_position(spark):
    c = spark.createDataFrame([(0, "q0"), (1, "q1"), (2, "q2")], "row_idx bigint, question string")
    a = c.where("row_idx < 2")
    b = spark.createDataFrame([(1, "s1"), (0, "s0")], "row_idx bigint, summary string")
    got = sorted(join_by_position(a, b, "summary", "retrieved").collect())
    assert [tuple(r) for r in got] == [(0, "q0", "s0"), (1, "q1", "s1")]
    with pytest.raises(Exception, match="lacks row 2"):
        join_by_position(c, b, "summary", "retrieved").collect()


def test_run_keys(spark):
    df = spark.createDataFrame([("o/reader-x", "o/sum", "key", "key^2", "key^9")], "r string, s string, a string, b string, c string")
    L = F.lit
    r = df.select(
        run_keys.run_key(L("db"), L("coll"), L(10), F.col("r")).alias("p"),
        run_keys.run_key(L("db"), L("coll"), L(10), L("gpt-4"), F.col("s"), L(2)).alias("f"),
        *[run_keys.next_version(F.col(c)).alias(c) for c in "abc"],
        run_keys.split_table_name(L("me"), L("wiki"), L(256)).alias("split"),
        run_keys.count_table_name(L("me"), L("wiki")).alias("mine"),
        run_keys.count_table_name(L("me"), L("you/wiki")).alias("yours"),
    ).head()
    assert r.p == "db.coll.10_reader-x" and r.f == "db.coll.10_sum.2_gpt-4"
    assert (r.a, r.b, r.c) == ("key^2", "key^3", "key^10")
    assert (r.split, r.mine, r.yours) == ("me/wiki-256", "me/wiki-token", "wiki-token")


def test_shared_dir_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert build_session().conf.get("spark.sql.session.timeZone") == "UTC"


def test_documents_table_has_the_expected_columns(spark, sf):
    assert fx.articles(spark, sf).schema == schemas.ARTICLE
