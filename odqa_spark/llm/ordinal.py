"""Quality by ordinal regression with cumulative logits on graded ratings.

One set of weights on hashed words and simple shares of a text gives a quality value f; ordered
thresholds turn it into P(grade > j) = sigmoid(f - threshold j). The expected grade and the
probability of the best grades select documents.

Defined cases: null and empty texts have f from the intercept-free zero vector, that is 0.
Without usable ratings, or with one grade only, every text gets that grade's value (null
without ratings) and tail probability 1 if the grade reaches the tail, else 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odqa_spark.llm.frames import list_array, map_slices
from odqa_spark.llm.labelled import labelled_sample
from odqa_spark.llm.tokens import words

PER_GRADE = 3000
BUCKETS = 1 << 14
#: Kinds of bytes: each ASCII mark of its own, digits, line feeds, all others.
_MARKS = [b for b in range(33, 127) if not chr(b).isalnum()]
_KINDS = len(_MARKS) + 3
_KIND = np.full(256, _KINDS - 1)
_KIND[_MARKS] = np.arange(len(_MARKS))
_KIND[48:58] = len(_MARKS)
_KIND[10] = len(_MARKS) + 1
_DENSE = _KINDS + 7
_RIDGE = 1e-3  # on the weights of hashed words
_SCALE = 30.0


@dataclass
class OrdinalModel:
    grades: list[int]
    weight: np.ndarray
    thresholds: np.ndarray


def _distinct(doc: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """The number of different values of each text."""
    order = np.lexsort((value, doc))
    d, v = doc[order], value[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
    return np.bincount(d[new], minlength=n)


def _features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text of each word, bucket of each word, words per text, dense shares)."""
    w = words(texts, cased=True)
    n = w.counts()
    spans = np.diff(np.concatenate([w.text_start, [len(w.buffer)]]))
    text_of_byte = np.repeat(np.arange(w.n_texts), spans)
    kinds = np.bincount(text_of_byte * _KINDS + _KIND[w.buffer], minlength=w.n_texts * _KINDS).reshape(-1, _KINDS) / np.maximum(spans, 1)[:, None]
    raised = np.bincount(text_of_byte[w.cased != w.buffer], minlength=w.n_texts) / np.maximum(spans, 1)
    distinct = _distinct(w.doc, w.hash, w.n_texts)
    inside = w.doc[1:] == w.doc[:-1]
    pairs = (w.hash[:-1] + np.uint64(3) * w.hash[1:])[inside]
    pair_of = w.doc[1:][inside]
    same = np.bincount(w.doc[1:][inside & (w.hash[1:] == w.hash[:-1])], minlength=w.n_texts)
    again = np.maximum(n - 1, 0) - _distinct(pair_of, pairs, w.n_texts)
    length = np.bincount(w.doc, w.end - w.start, minlength=w.n_texts)
    dense = np.concatenate(
        [
            np.minimum(20 * kinds, 3.0),
            np.stack([4 * raised, 4 * same / np.maximum(n, 1), 4 * again / np.maximum(n, 1), distinct / np.maximum(n, 1), length / np.maximum(n, 1) / 10, np.log1p(n) / 10, (n > 0).astype(float)], 1),
        ],
        1,
    )
    dense[n == 0] = 0
    return w.doc, (w.hash >> np.uint64(8)).astype(np.int64) % BUCKETS, n, dense


def _value(doc: np.ndarray, bucket: np.ndarray, n: np.ndarray, dense: np.ndarray, weight: np.ndarray) -> np.ndarray:
    mean = np.bincount(doc, weight[bucket], minlength=len(n)) / np.maximum(n, 1)
    return _SCALE * mean + dense @ weight[BUCKETS:]


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(
    docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", id_col: str = "doc_id", text: str = "text", per_grade: int = PER_GRADE, rounds: int = 200
) -> OrdinalModel:
    """A model from at most ``per_grade`` rated rows of each grade; word shares are sent, not texts."""
    sample, counts = labelled_sample(docs, labels.select(id_col, label, usable.alias("_llm_use")), label, per_grade, F.col("_llm_use"), id_col, text)
    grades = sorted(counts)
    if len(grades) < 2:
        return OrdinalModel(grades, np.zeros(BUCKETS + _DENSE), np.zeros(0))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, bucket, n, dense = _features(batch.column(0).to_pylist())
        key, times = np.unique(doc * BUCKETS + bucket, return_counts=True)
        of = key // BUCKETS
        per = np.bincount(of, minlength=len(n))
        share = times / np.maximum(n[of], 1)
        return pa.RecordBatch.from_arrays(
            [batch.column(1), list_array(pa.array((key % BUCKETS).astype(np.int32)), per), list_array(pa.array(share.astype(np.float32)), per), list_array(pa.array(dense.ravel()), np.full(len(n), _DENSE))],
            ["y", "bucket", "share", "dense"],
        )

    got = map_slices(sample.select("text", "y"), "text", run, "y int, bucket array<int>, share array<float>, dense array<double>").toArrow().combine_chunks()
    m = got.num_rows
    if not m:
        return OrdinalModel(grades[:1], np.zeros(BUCKETS + _DENSE), np.zeros(0))
    column = lambda c: got.column(c).combine_chunks()
    y = np.searchsorted(grades, np.asarray(column("y"), np.int64))
    row = np.repeat(np.arange(m), np.asarray(column("bucket").value_lengths(), np.int64))
    bucket, share = np.asarray(column("bucket").flatten(), np.int64), np.asarray(column("share").flatten(), np.float64) * _SCALE
    dense = np.asarray(column("dense").flatten(), np.float64).reshape(m, _DENSE)
    # grades count as often as among all ratings
    have = np.bincount(y, minlength=len(grades))
    sample_weight = np.array([counts[g] for g in grades])[y] / np.maximum(have[y], 1)
    sample_weight = sample_weight / sample_weight.sum()

    k = len(grades) - 1
    theta = np.zeros(BUCKETS + _DENSE + k)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        weight, raw = theta[: BUCKETS + _DENSE], theta[BUCKETS + _DENSE :]
        gaps = np.exp(np.clip(raw[1:], -20, 20))
        thresholds = raw[0] + np.concatenate([[0.0], np.cumsum(gaps)])
        f = np.bincount(row, share * weight[bucket], minlength=m) + dense @ weight[BUCKETS:]
        above = _sigmoid(f[:, None] - thresholds[None, :])
        edge = np.concatenate([np.ones((m, 1)), above, np.zeros((m, 1))], 1)
        slope = np.concatenate([np.zeros((m, 1)), above * (1 - above), np.zeros((m, 1))], 1)
        at = np.arange(m)
        p = np.maximum(edge[at, y] - edge[at, y + 1], 1e-12)
        d_f = -sample_weight * (slope[at, y] - slope[at, y + 1]) / p
        d_t = np.zeros(k)
        np.add.at(d_t, np.clip(y - 1, 0, k - 1), np.where(y > 0, sample_weight * slope[at, y] / p, 0.0))
        np.add.at(d_t, np.clip(y, 0, k - 1), np.where(y < k, -sample_weight * slope[at, y + 1] / p, 0.0))
        d_raw = np.concatenate([[d_t.sum()], gaps * (np.cumsum(d_t[::-1])[::-1][1:])])
        g = np.concatenate([np.bincount(bucket, share * d_f[row], minlength=BUCKETS), dense.T @ d_f, d_raw])
        g[:BUCKETS] += _RIDGE * weight[:BUCKETS]
        g[BUCKETS : BUCKETS + _DENSE] += 1e-5 * weight[BUCKETS:]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        theta = theta - 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    raw = theta[BUCKETS + _DENSE :]
    return OrdinalModel(grades, theta[: BUCKETS + _DENSE], raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(np.clip(raw[1:], -20, 20)))]))


def grade(docs: DataFrame, model: OrdinalModel, tail: int | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, quality, expected_grade, tail_probability): tail is P(grade >= ``tail``), of the best grade by default."""
    grades = np.array(model.grades, float)
    least = (max(model.grades) if model.grades else 0) if tail is None else tail

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(0).to_pylist()
        f = _value(*_features(texts), model.weight)
        if len(grades) < 2:
            expected = [float(grades[0]) if len(grades) else None] * len(texts)
            reach = [float(len(grades) > 0 and grades[0] >= least)] * len(texts)
        else:
            above = _sigmoid(f[:, None] - model.thresholds[None, :])
            expected = grades[0] + above @ np.diff(grades)
            j = int(np.searchsorted(grades, least))
            reach = np.ones(len(f)) if j == 0 else np.zeros(len(f)) if j == len(grades) else above[:, j - 1]
        return pa.RecordBatch.from_arrays(
            [batch.column(1), pa.array(f), pa.array(expected, pa.float64()), pa.array(reach, pa.float64())], [id_col, "quality", "expected_grade", "tail_probability"]
        )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(id_col))
    return map_slices(rows, "text", run, f"`{id_col}` {kind}, quality double, expected_grade double, tail_probability double")
