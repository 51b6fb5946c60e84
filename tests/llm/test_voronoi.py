import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from odqa_spark.llm import voronoi

SCHEMA = "vec_id bigint, v array<float>, rank int, cell int"


def _brute(rows, k, picked):
    ok = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ok[i] = [math.floor(256 * float(np.float32(x))) for x in v]
    out = []
    for q in ok:
        if not picked(q):
            continue
        s = [(-sum(a * b for a, b in zip(ok[q], ok[o])), o) for o in ok if o != q]
        out += [(q, n + 1, o, -m) for n, (m, o) in enumerate(sorted(s)[:k])]
    return sorted(out)


def _run(spark, rows, k=3, **options):
    df = spark.createDataFrame([(i, v, 7, 7) for i, v in rows], SCHEMA).withColumn("x", voronoi.scaled(F.col("v"), 256.0))
    got = voronoi.voronoi_knn_join(df.where("vec_id % 5 = 0"), df, k, "vec_id", "x", **options)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in got.collect())


def test_matches_brute_force_with_ties_and_broken_vectors(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)]) for i in range(120)]
    rows += [(1000, None), (1005, [float("nan"), 1.0, 1.0, 1.0]), (1010, [1.0, None, 0.0, 0.0]), (None, [1.0] * 4), (1015, [float("inf")] * 4)]
    want = _brute(rows, 3, lambda q: q % 5 == 0)
    assert _run(spark, rows, pivots=7, queries_per_group=5, rows_per_block=16) == want
    assert _run(spark, rows) == want


def test_repeated_rows_short_vectors_and_few_candidates(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (5, [1.0]), (7, [0.5, 0.25]), (7, [0.5, 0.25])]
    want = _brute([(0, [1.0, 2.0]), (5, [1.0, 0.0]), (7, [0.5, 0.25])], 5, lambda q: q % 5 == 0)
    assert _run(spark, rows, k=5, pivots=2) == want


def test_empty_tables(spark):
    assert _run(spark, []) == []
    assert _run(spark, [(1, [1.0])]) == []
    assert _run(spark, [(0, [])]) == []


def test_far_cells_are_not_sent():
    pivots = np.array([[0.0, 0.0], [100.0, 0.0]])
    q = pd.DataFrame({"cell": [0], "radius": [1.0]})
    d = pd.DataFrame({"cell": [0, 1], "radius": [2.0, 2.0], "near": [0.0, 0.0]})
    nearest = pd.DataFrame({"cell": [0, 0, 1], "dist": [0.5, 1.0, 0.0], "id": [1, 2, 3]})
    assert set(voronoi._bounds(q, d, nearest, pivots, 1)[0]) == {0}
    assert set(voronoi._bounds(q, d, nearest, pivots, 2)[0]) == {0, 1}
