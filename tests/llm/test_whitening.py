import math

import numpy as np
import pytest
from odqa_spark.llm import queries, whitening
from odqa_spark.llm.frames import table

SCHEMA = "vec_id bigint, embedding array<{}>, component string, n string, x string"


def _brute(rows, k=4):
    """Exact integers and the dense eigenproblem."""
    ok = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in ok})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    centre = np.array([[float(n * x[j] - sums[j]) / n for j in range(d)] for x in fit])
    e, vectors = np.linalg.eigh(centre.T @ centre / n)
    e, vectors = e[::-1], vectors[:, ::-1]
    out = {}
    for i, x in ok:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        c = np.array([float(n * a - s) / n for a, s in zip(x, sums)])
        for j in range(min(k, d)):
            out.setdefault((i, j + 1), []).append((n, deviation, c @ vectors[:, j] / math.sqrt(e[j]) if e[j] > 1e-9 else None, e[j] / e.sum()))
    return out


def _check(rows, got, near=1e-9):
    want = _brute(rows)
    seen = {}
    for r in got:
        seen.setdefault((r.vec_id, r.component), []).append(r)
    assert {k: len(v) for k, v in seen.items()} == {k: len(v) for k, v in want.items()}
    for j in {c for _, c in want}:
        mine = [(r, w) for k, v in want.items() if k[1] == j for r, w in zip(sorted(seen[k], key=lambda r: r.deviation), sorted(v))]
        assert all((r.n, r.deviation) == w[:2] and abs(r.explained - w[3]) < 1e-9 for r, w in mine)
        a, b = np.array([r.whitened for r, _ in mine]), np.array([w[2] for _, w in mine])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < near
        assert all(r.identity_error < 1e-9 for r, _ in mine)


def _run(spark, rows, kind="float"):
    return whitening.whiten(spark.createDataFrame([(i, v, "c", "n", "x") for i, v in rows], SCHEMA.format(kind))).collect()


def test_against_dense_eigenvectors(spark):
    rng = np.random.default_rng(5)
    basis = rng.standard_normal((40, 40)) * np.geomspace(3, 0.05, 40)[:, None]
    rows = [(k, [float(x) for x in np.float32(v)]) for k, v in enumerate(rng.standard_normal((600, 40)) @ basis + 5)]
    bad = [(1000, None), (1001, []), (1002, [float("nan")] + [0.0] * 39), (1003, [None] + [0.0] * 39), (1004, [float("inf")] + [0.0] * 39)]
    copies = [(2000 + k, rows[0][1]) for k in range(300)] + [rows[1], (None, rows[2][1])]
    _check(rows + copies, _run(spark, rows + bad + copies))


def test_flat_spectrum_and_far_mean(spark):
    rng = np.random.default_rng(6)
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(rng.standard_normal((400, 64)) + 1e7)]
    _check(rows, _run(spark, rows, "double"), 1e-6)


@pytest.mark.parametrize("d", [1, 2, 5])
def test_few_dimensions(spark, d):
    rng = np.random.default_rng(d)
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(rng.standard_normal((50, d)) * np.arange(1, d + 1))]
    _check(rows, _run(spark, rows, "double"))


def test_without_variance(spark):
    got = _run(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got] == [(1, 0, None, None, 0.0)] * 4
    assert _run(spark, []) == [] and _run(spark, [(1, None), (2, [])]) == []
    # one direction only: the second component has no variance
    got = _run(spark, [(k, [k / 4, 0.0]) for k in range(8)])
    assert all((r.whitened is None) == (r.component == 2) for r in got) and got[0].identity_error < 1e-12


def test_sums_beyond_64_bits_and_lengths(spark):
    rows = [(k, [k * 1e15, float(k)]) for k in range(4)]
    with pytest.raises(Exception, match="(?i)too large|too big|overflow|bounds"):
        _run(spark, rows, "double")
    with pytest.raises(Exception, match="one length"):
        _run(spark, [(1, [1.0, 2.0]), (2, [1.0])])
    with pytest.raises(Exception, match="64 bits"):
        _run(spark, [(1, [1e300, 2.0])], "double")


def test_query_against_brute_force(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "embeddings").select("vec_id", "embedding").collect()]
    _check(rows, queries.op13_chebyshev_whitening(spark, sf).collect())
