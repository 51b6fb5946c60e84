import numpy as np
import pytest
from pyspark.sql import functions as F

from odqa_spark.functions import vectors
from odqa_spark.operators import knn, retrieval, vector_table
from odqa_spark.plans import indexing
from odqa_spark.operators.rows import with_row_idx
from odqa_spark.session import materialize

VEC = "array<float>"


def _table(spark, prefix, ids, mat, id_type="bigint"):
    rows = [(i, [float(x) for x in v]) for i, v in zip(ids, mat)]
    return spark.createDataFrame(rows, f"{prefix}_id {id_type}, {prefix}_vec {VEC}")


def _brute(q_ids, q, p_ids, p, k):
    out = {}
    for i, v in zip(q_ids, q):
        scores = [float(np.cumsum(v.astype(float) * w.astype(float))[-1]) for w in p]
        order = sorted(range(len(p)), key=lambda j: (-scores[j], p_ids[j]))[:k]
        out[i] = [(p_ids[j], scores[j]) for j in order]
    return out


def _collect(df):
    out = {}
    for r in df.orderBy("q_id", "rank").collect():
        out.setdefault(r.q_id, []).append((r.p_id, r.score))
    return out


@pytest.fixture
def tied():
    """A third of the passages are copies of one vector, so ties reach far beyond k."""
    rng = np.random.default_rng(1)
    p = rng.normal(size=(90, 6)).astype(np.float32)
    p[::3] = p[0]
    q = np.concatenate([rng.normal(size=(7, 6)), p[:1], np.zeros((1, 6))]).astype(np.float32)
    return list(range(len(q))), q, list(range(100, 190)), p


@pytest.mark.parametrize("k", [1, 5, 40, 200])
def test_topk_matches_brute_force(spark, tied, k):
    q_ids, q, p_ids, p = tied
    left, right = _table(spark, "q", q_ids, q), _table(spark, "p", p_ids, p).repartition(5)
    assert _collect(knn.topk_join(left, right, k)) == _brute(q_ids, q, p_ids, p, k)


@pytest.mark.parametrize("metric", ["ip", "l2"])
@pytest.mark.parametrize("k", [1, 5, 40, 200])
def test_floors_from_a_share_give_the_same_rows(spark, tied, monkeypatch, metric, k):
    q_ids, q, p_ids, p = tied
    left, right = _table(spark, "q", q_ids, q), _table(spark, "p", p_ids, p).repartition(5)
    want = _collect(knn.topk_join(left, right, k, metric))
    known = []
    search = knn._block_topk
    monkeypatch.setattr(knn, "FLOOR_QUESTIONS", 1)
    monkeypatch.setattr(knn, "FLOOR_SHARE", 2)
    monkeypatch.setattr(knn, "_block_topk", lambda *a: known.append(a[5] if len(a) > 5 else None) or search(*a))
    assert _collect(knn.topk_join(left, right, k, metric)) == want
    assert known[0] is None and len(known[1]) == len(q)
    assert np.isfinite(known[1]).all() == (k < 200)
    # ids that repeat or are missing: their rows rank together, with or without floors
    odd = left.select(F.when(F.col("q_id") > 2, F.col("q_id") % 2).alias("q_id"), "q_vec")
    with_floors = knn.topk_join(odd, right, k, metric).drop("p_id").collect()
    monkeypatch.setattr(knn, "FLOOR_QUESTIONS", 1 << 30)
    assert sorted(map(str, with_floors)) == sorted(map(str, knn.topk_join(odd, right, k, metric).drop("p_id").collect()))


def test_a_task_that_knows_floors_ranks_few_candidates(monkeypatch):
    rng = np.random.default_rng(4)
    q, p = rng.normal(size=(300, 16)), rng.normal(size=(20_000, 16))
    ranked = []
    exact = knn._exact
    monkeypatch.setattr(knn, "_exact", lambda m, a, b: ranked.append(len(a)) or exact(m, a, b))
    first = knn._TopK(q, 3, "ip")
    first.add(np.arange(0, 20_000, 16), p[::16])
    for floor, most in ((None, 1 << 30), (first.floor, 300 * 3 * 16 * 2)):
        ranked.clear()
        top = knn._TopK(q, 3, "ip", floor)
        for lo in range(0, 20_000, 1_000):
            top.add(np.arange(lo, lo + 1_000), p[lo : lo + 1_000])
        got = {i: list(zip(g["p"], g["score"])) for i, g in top.best[top.best["q"] < 10].groupby("q")}
        assert got == _brute(range(10), q[:10], range(20_000), p, 3)
        assert sum(ranked) <= most


def _no_rows_on_the_driver(monkeypatch):
    """Fails if a frame with ids of questions or passages, or with vectors, is fetched."""
    from pyspark.sql.classic.dataframe import DataFrame

    def guarded(name):
        own = getattr(DataFrame, name)

        def fetch(self, *args, **kw):
            assert not {"q_id", "p_id", "vec", "q_vec", "p_vec"} & set(self.columns), self.columns
            return own(self, *args, **kw)

        return fetch

    for name in ("collect", "toArrow", "toPandas", "toLocalIterator"):
        monkeypatch.setattr(DataFrame, name, guarded(name))


@pytest.mark.parametrize("metric", ["ip", "l2"])
@pytest.mark.parametrize("k", [1, 7, 200])
def test_question_blocks_give_the_same_rows(spark, tied, monkeypatch, metric, k):
    q_ids, q, p_ids, p = tied
    left, right = _table(spark, "q", q_ids, q), _table(spark, "p", p_ids, p).repartition(5)
    want = _collect(knn.topk_join(left, right, k, metric))
    with monkeypatch.context() as m:
        _no_rows_on_the_driver(m)
        # blocks of three vectors: thirty and more of passages, in four rounds
        got = knn.topk_join(left, right, k, metric, dim=6, broadcast_bytes=6 * 8 * 3)
    assert _collect(got) == want


def test_blocks_without_hope_are_not_met(spark, monkeypatch):
    """Norms that fall off: later rounds neither read the small passages nor send questions to them."""
    rng = np.random.default_rng(4)
    direction = rng.normal(size=(400, 6)).astype(np.float32)
    p = (direction / np.linalg.norm(direction, axis=1, keepdims=True) * np.geomspace(100, 0.001, 400)[:, None]).astype(np.float32)
    q = np.abs(rng.normal(size=(30, 6))).astype(np.float32)
    left, right = _table(spark, "q", range(30), q), _table(spark, "p", range(400), p)
    rounds = []
    dumps = knn.json.dumps

    def seen(value, *args, **kw):
        if isinstance(value, list) and value and "high" in value[0]:
            rounds.append(len(value))
        return dumps(value, *args, **kw)

    monkeypatch.setattr(knn.json, "dumps", seen)
    got = knn.topk_join(left, right, 3, dim=6, broadcast_bytes=6 * 8 * 8)
    assert _collect(got) == _brute(range(30), q, range(400), p, 3)
    # of sixty and more blocks those of large norms only
    assert sum(rounds) < 40


def test_equal_norms_are_cut_by_hash(spark):
    """One norm for all passages, as with normalised vectors: blocks stay bounded."""
    p = np.tile(np.eye(4, dtype=np.float32), (100, 1))
    right = _table(spark, "p", range(400), p).select("p_id", F.lit(1.0).alias("norm"))
    block, blocks = knn._in_blocks(right, 20)
    sizes = [r.n for r in right.groupBy(block.alias("b")).agg(F.count("*").alias("n")).collect()]
    assert len(blocks) == len(sizes) >= 18 and max(sizes) < 60 and sum(sizes) == 400


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 8 * 3}])
def test_ids_keep_their_type(spark, options):
    big = 1 << 60
    for ids, kind in (([big + 1, big + 3, -5], "bigint"), (["b", "a", "c"], "string"), ([3, 1, 2], "int")):
        left = spark.createDataFrame([(i, [1.0, float(n)]) for n, i in enumerate(ids)], f"q_id {kind}, q_vec {VEC}")
        right = spark.createDataFrame([(i, [1.0, 0.0]) for i in ids], f"p_id {kind}, p_vec {VEC}")
        got = knn.topk_join(left, right, 2, **options)
        assert got.schema["p_id"].dataType.simpleString() == kind
        assert _collect(got) == {i: [(p, 1.0) for p in sorted(ids)[:2]] for i in ids}


def test_broken_vectors_have_no_rank_on_either_side(spark):
    odd = [(1, [1.0, float("nan")]), (2, [float("inf"), 0.0]), (3, [1.0, 0.0]), (4, None), (5, [1.0, None])]
    left = spark.createDataFrame(odd, f"q_id int, q_vec {VEC}")
    right = spark.createDataFrame(odd, f"p_id int, p_vec {VEC}")
    assert _collect(knn.topk_join(left, right, 3)) == {3: [(3, 1.0)]}


def test_small_blocks_give_the_same_rows(spark, tied, monkeypatch):
    q_ids, q, p_ids, p = tied
    top = knn._TopK(q.astype(float), 7, "ip")
    monkeypatch.setattr(knn, "BLOCK_BYTES", 512)
    for lo in range(0, 90, 11):
        top.add(np.array(p_ids[lo : lo + 11]), p[lo : lo + 11].astype(float))
    got = {i: list(zip(g["p"], g["score"])) for i, g in top.best.groupby("q")}
    assert got == _brute(q_ids, q, p_ids, p, 7)


def test_a_task_holds_tiles_and_candidates_of_few_questions():
    import tracemalloc

    rng = np.random.default_rng(3)
    q, p = rng.normal(size=(20_000, 8)), rng.normal(size=(3_000, 8))
    top = knn._TopK(q, 3, "ip")
    tracemalloc.start()
    top.add(np.arange(3_000), p)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = {i: list(zip(g["p"], g["score"])) for i, g in top.best[top.best["q"] < 20].groupby("q")}
    assert got == _brute(range(20), q[:20], range(3_000), p, 3)
    assert peak < 32 << 20


def test_topk_with_text_ids_and_missing_vectors(spark):
    left = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None)], f"q_id string, q_vec {VEC}")
    right = spark.createDataFrame([("z", [1.0, 0.0]), ("y", [1.0, 0.0]), ("x", None)], f"p_id string, p_vec {VEC}")
    assert _collect(knn.topk_join(left, right, 3)) == {"a": [("y", 1.0), ("z", 1.0)]}
    with pytest.raises(ValueError):
        knn.topk_join(left, right, 3, metric="cosine")


def test_broken_vectors_do_not_hide_others(spark):
    nan, inf = float("nan"), float("inf")
    left = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [nan, 0.0])], f"q_id string, q_vec {VEC}")
    right = spark.createDataFrame([("z", [1.0, 0.0]), ("y", [nan, 1.0]), ("x", [inf, 0.0]), ("w", [0.5, 0.0])], f"p_id string, p_vec {VEC}")
    assert _collect(knn.topk_join(left, right.coalesce(1), 1)) == {"a": [("z", 1.0)]}


def test_empty_sides(spark):
    left = spark.createDataFrame([], f"q_id bigint, q_vec {VEC}")
    right = spark.createDataFrame([(1, [1.0])], f"p_id bigint, p_vec {VEC}")
    assert knn.topk_join(left, right, 3).count() == 0
    assert knn.topk_join(right.toDF("q_id", "q_vec"), right.where("p_id > 5"), 3).count() == 0


def test_distance_order_is_inner_product_order(spark):
    rng = np.random.default_rng(2)
    q, p = rng.normal(size=(6, 5)).astype(np.float32), rng.normal(size=(40, 5)).astype(np.float32)
    left, right = _table(spark, "q", range(6), q), _table(spark, "p", range(40), p)
    by_ip = {(r.q_id, r.rank): (r.p_id, r.score) for r in knn.topk_join(left, right, 10).collect()}
    by_l2 = {(r.q_id, r.rank): (r.p_id, r.ip) for r in knn.topk_join_l2(left, right, 10).collect()}
    assert {k: v[0] for k, v in by_ip.items()} == {k: v[0] for k, v in by_l2.items()}
    assert all(by_l2[k][1] == pytest.approx(by_ip[k][1]) for k in by_ip)


def test_search_reads_only_ids_and_vectors(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    p = e.select(F.col("vec_id").alias("p_id"), F.col("embedding").alias("p_vec"), F.col("label").alias("title"))
    q = e.select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_vec"))
    plan = knn.topk_join(q, p, 3)._jdf.queryExecution().toString()
    assert "label" not in plan[plan.index("== Physical Plan ==") :]
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_external_ids_and_limits(spark):
    found = spark.createDataFrame([(1, 0, 1)], "q_id bigint, p_id bigint, rank int")
    names = spark.createDataFrame([(0, "doc-0")], "p_id bigint, external_id string")
    assert knn.external_ids(found, names).select("q_id", "p_id", "rank").collect() == [(1, "doc-0", 1)]
    assert retrieval.passage_limit(10, 3) == 10 and retrieval.passage_limit(10, 3, summarize=True) == 30


def test_context_keeps_rank_order(spark):
    rows = [(1, 2, "b"), (1, 1, "a"), (1, 10, "c"), (2, 1, "x")]
    got = retrieval.collect_context(spark.createDataFrame(rows, "q_id int, rank int, text string"))
    assert {r.q_id: r.retrieved for r in got.collect()} == {1: "a\nb\nc", 2: "x"}


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [[1.0, 2.0], [3.0, 6.0], [9.0, 9.0]], [1, 1, 0])], "v array<double>, h array<array<double>>, m array<int>")
    r = df.select(
        vectors.squared_norm(F.col("v")).alias("d"),
        vectors.l2_normalize(F.col("v")).alias("n"),
        vectors.l2_normalize(F.array(F.lit(0.0))).alias("z"),
        vectors.with_aux_dim(F.col("v"), F.lit(34.0)).alias("a"),
        vectors.masked_mean(F.col("h"), F.col("m")).alias("p"),
        vectors.masked_mean(F.col("h"), F.array(*[F.lit(0)] * 3)).alias("none"),
    ).head()
    assert (r.d, r.n, r.z, r.a, r.p, r.none) == (25.0, [0.6, 0.8], [0.0], [3.0, 4.0, 3.0], [2.0, 4.0], None)


def test_vector_table_rejects_and_repeats(spark, tmp_path):
    rows = spark.createDataFrame(
        [("a", [1.0, 2.0], "t", "x"), ("b" * 17, [1.0, 2.0], "t", "x"), ("c", [1.0], "t", "x"), ("d", [1.0, 2.0], "t" * 1025, "x"),
         ("e", [1.0, 2.0], "t", "x" * 11), ("f" * 16, [1.0, 2.0], "t" * 1024, "x" * 10), ("g", None, "t", "x")],
        f"id string, vec {VEC}, title string, text string",
    )
    vector_table.create_if_absent(spark, "vt_one", str(tmp_path / "vt"))
    vector_table.create_if_absent(spark, "vt_one", str(tmp_path / "vt"))
    for _ in range(2):
        vector_table.append_passages(rows, "vt_one", dim=2, max_text=10)
    assert sorted(r.id for r in spark.table("vt_one").collect()) == ["a", "f" * 16]
    reasons = {r.id: r.reject_reason for r in spark.table("vt_one_rejected").collect()}
    assert reasons == {"b" * 17: "id", "c": "vec", "d": "title", "e": "text", "g": "vec"}
    fixed = spark.createDataFrame([("e", [1.0, 2.0], "t", "x")], rows.schema)
    vector_table.append_passages(fixed, "vt_one", dim=2, max_text=10)
    assert spark.table("vt_one").where("id = 'e'").count() == 1
    vector_table.append_passages(fixed, "vt_one", dim=2, max_text=10, mode="append_all")
    assert spark.table("vt_one").where("id = 'e'").count() == 2
    with pytest.raises(ValueError):
        vector_table.create_if_absent(spark, "vt_two", str(tmp_path / "v2"), method="hnsw")
    with pytest.raises(ValueError):
        vector_table.append_passages(fixed, "vt_one", mode="upsert")


def test_index_load_of_a_row_range(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(
        F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), "text", "doc_id"
    )
    indexed = with_row_idx(docs, "doc_id")
    indexing.load_index(indexed, "vt_range", str(tmp_path / "r"), 10, 25, dim=64, max_text=10**6)
    assert sorted(int(r.id) for r in spark.table("vt_range").collect()) == list(range(10, 25))
    assert spark.table("vt_range").select(F.min(F.size("vec")), F.max(F.size("vec"))).head()[:] == (64, 64)


def test_texts_are_fetched_by_either_join(spark, tied):
    q_ids, q, p_ids, p = tied
    left = _table(spark, "q", q_ids, q)
    right = _table(spark, "p", p_ids, p).select("*", F.lit("t").alias("title"), F.concat(F.lit("x"), "p_id").alias("text"))
    stored = materialize(right, "texts")
    small = sorted(tuple(r) for r in retrieval.retrieve(left, stored, 9).select("q_id", "rank", "p_id", "text").collect())
    found = retrieval.retrieve(left, stored, 9, block_bytes=1000)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # one scan of the texts, reduced by the filter, however many ids were ranked
    assert plan.count("title#") and sum("Relation" in line and "text#" in line for line in plan.splitlines()) == 1
    assert "getbit" in plan and "scalar-subquery" in plan
    large = sorted(tuple(r) for r in found.select("q_id", "rank", "p_id", "text").collect())
    assert small == large and len(small) == 9 * len(q_ids)
    # every question retrieves copies of the same hot passage; none is dropped
    assert all(text == f"x{p_id}" for _, _, p_id, text in small)


def test_filter_of_ranked_ids(spark):
    ids = spark.range(0, 3000, 3).withColumnRenamed("id", "p_id")
    keys = spark.range(30000).withColumnRenamed("id", "p_id")
    kept = keys.where(retrieval.may_hold(ids, "p_id", F.col("p_id"), 1 << 14))
    assert kept.join(ids, "p_id").count() == 1000 and kept.count() < 3000
    # a filter that is full lets all pass
    assert keys.where(retrieval.may_hold(ids, "p_id", F.col("p_id"), 64)).count() == 30000
    assert keys.where(retrieval.may_hold(ids.limit(0), "p_id", F.col("p_id"), 64)).count() == 0


def test_loads_join_the_table_in_place(spark, tmp_path, monkeypatch):
    """The table's ids are neither moved nor, for a small load, all read."""
    monkeypatch.setattr(vector_table, "LITERAL_IDS", 10)
    vector_table.create_if_absent(spark, "vt_buckets", str(tmp_path / "b"), n_buckets=16)
    rows = spark.range(200).select(F.col("id").cast("string").alias("id"), F.array(F.lit(1.0), F.lit(2.0)).alias("vec"), F.lit("t").alias("title"), F.lit("x").alias("text"))
    vector_table.append_passages(rows, "vt_buckets", dim=2)
    assert vector_table.buckets(spark, "vt_buckets") == 16
    held = vector_table.held_ids(spark, "vt_buckets")
    load = materialize(rows.select(F.col("id").alias("_id")), "ids")
    plan = load.repartition(16, "_id").join(held.hint("merge"), "_id")._jdf.queryExecution().executedPlan().toString()
    table_side = plan[plan.index("vt_buckets") - 2000 :]
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in table_side
    few = vector_table.held_ids(spark, "vt_buckets", ["3", "77"])._jdf.queryExecution().executedPlan().toString()
    assert "SelectedBucketsCount: 2 out of 16" in few or "SelectedBucketsCount: 1 out of 16" in few
    vector_table.append_passages(rows.limit(5), "vt_buckets", dim=2)
    vector_table.append_passages(rows, "vt_buckets", dim=2)
    assert spark.table("vt_buckets").count() == 200


def test_hot_ids_and_rows_without_id(spark, tmp_path):
    """Ids and nulls that a third of a load has: one row of each id is taken, every other row is kept as rejected."""
    rows = [("hot", "t", f"text {k % 7}") for k in range(60)] + [(None, "t", f"no id {k}") for k in range(60)]
    rows += [("twin", "a", "same")] * 9 + [(f"id{k}", "t", "x") for k in range(20)]
    df = spark.createDataFrame([(i, [1.0, 2.0], t, x) for i, t, x in rows], "id string, vec array<double>, title string, text string")
    vector_table.create_if_absent(spark, "vt_hot", str(tmp_path / "h"), n_buckets=8)
    vector_table.append_passages(df, "vt_hot", dim=2)
    kept = sorted((r.id, r.text) for r in spark.table("vt_hot").collect())
    assert kept == sorted([("hot", "text 0"), ("twin", "same"), *((f"id{k}", "x") for k in range(20))])
    lost = [(r.id, r.reject_reason) for r in spark.table("vt_hot_rejected").collect()]
    assert {x: lost.count(x) for x in set(lost)} == {("hot", "duplicate"): 59, ("twin", "duplicate"): 8, (None, "id"): 60}
    # again: rows without id cannot be known, all others are
    vector_table.append_passages(df, "vt_hot", dim=2)
    assert spark.table("vt_hot").count() == 22 and spark.table("vt_hot_rejected").where("id is not null").count() == 67


def test_a_load_reads_its_source_twice(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), "text")
    vector_table.create_if_absent(spark, "vt_plan", str(tmp_path / "p"))
    plan = indexing.vector_rows(vector_table.left_to_load(vector_table.with_fate(docs, "vt_plan")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("Relation") == 2 and "Aggregate" not in plan


def test_index_load_embeds_new_rows_only(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def make():
        def fn(texts):
            calls.add(sum(t is not None for t in texts))
            return [[1.0, 2.0] for _ in texts]

        return fn

    rows = [("a", "t", "x"), ("b", "t", "y"), ("b", "t", "x"), ("b", "t", "y"), ("c", "t", "z" * 99), ("d" * 17, "t", "x"), ("e", None, "x")]
    df = spark.createDataFrame(rows, "id string, title string, text string")
    for run in range(2):
        indexing.load_index(df, "vt_fresh", str(tmp_path / "f"), make_fn=make, dim=2, max_text=50)
        assert calls.value == (len(rows) if run == 0 else len(rows))
    kept = sorted((r.id, r.text) for r in spark.table("vt_fresh").collect())
    assert kept == [("a", "x"), ("b", "x")]
    lost = sorted((r.id, r.reject_reason) for r in spark.table("vt_fresh_rejected").collect())
    assert lost == [("b", "duplicate"), ("b", "duplicate"), ("c", "text"), ("d" * 17, "id"), ("e", "title")]
    # a text that fits now is taken
    indexing.load_index(df.where("id = 'c'").withColumn("text", F.lit("z")), "vt_fresh", str(tmp_path / "f"), make_fn=make, dim=2, max_text=50)
    assert spark.table("vt_fresh").where("id = 'c'").count() == 1
