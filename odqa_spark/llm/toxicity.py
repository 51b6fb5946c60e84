"""Toxic spans by a linear-chain conditional random field.

Labels are of documents, so tokens are labelled first: a lexicon of the sample counts in how many
toxic and how many clean documents each word and each word beginning stands (near copies count
once), so inflected forms share evidence; in toxic documents the words with strong evidence are
the toxic tokens. The field scores a token by its lexicon entry, its evidence, its neighbours'
evidence and its shape, plus transitions between labels. Forward-backward marginals give the
offending offsets; the largest marginal, the expected number of toxic tokens and their share
give the document's score through a logistic link fitted on the sample, weighted back to the
shares of all labels.

A chain is a run of 64 words; every word of a text is in one.

Defined cases: null and empty texts get the score of a text without toxic tokens. Without any
usable label, or with one class only, the score is that class's share for every text (0 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odqa_spark.llm.frames import list_array, map_slices, materialize, slices
from odqa_spark.llm.labelled import labelled_sample
from odqa_spark.llm.tokens import Words, hash_cut, hash_prefix, mix, words

PER_CLASS = 4000
LEXICON = 4096
CHAIN = 64
MIN_SUPPORT = 5
STRONG = 3.0
_BINS = (1.0, 2.0, STRONG, 4.0)
_FEATURES = 3 * 5 + 3 + 4
#: A word of a training chain: lexicon entry, features, label.
_TOKEN = np.dtype([("lex", "<u2"), ("f", "u1", 5), ("gold", "u1")])
#: Bytes of the word beginnings that are looked at.
_STEMS = (5, 6, 7, 8, 9)
_TABLE = 1 << 20


@dataclass
class ToxicModel:
    keys: np.ndarray  # sorted hashes of the lexicon's words and beginnings
    evidence: np.ndarray  # log odds of each
    word_weight: np.ndarray
    weight: np.ndarray
    trans: np.ndarray
    link: np.ndarray  # intercept, largest marginal, expected number, expected share
    base: float | None = None


def _logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def _forms(w: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(which words, key): the words themselves and the beginnings of longer ones."""
    forms = [(np.arange(len(w.hash)), w.hash)]
    size = w.end - w.start
    prefix = hash_prefix(w.buffer)
    for n in _STEMS:
        which = np.flatnonzero(size > n)
        forms.append((which, mix(hash_cut(prefix, w.start[which], w.start[which] + n) + np.uint64(n))))
    return forms


def _looked_up(w: Words, keys: np.ndarray, evidence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lexicon entry, evidence) of each word: its strongest form's; no entry is ``len(keys)``."""
    entry, best = np.full(len(w.hash), len(keys)), np.zeros(len(w.hash))
    if not len(keys):
        return entry, best
    table = np.zeros(_TABLE, bool)
    table[keys % np.uint64(_TABLE)] = True
    for which, key in _forms(w):
        may = np.flatnonzero(table[key % np.uint64(_TABLE)])
        at = np.minimum(np.searchsorted(keys, key[may]), len(keys) - 1)
        hit = keys[at] == key[may]
        word, at = which[may[hit]], at[hit]
        more = evidence[at] > best[word]
        entry[word[more]], best[word[more]] = at[more], evidence[at[more]]
    return entry, best


class _Chains:
    """Features of a block of texts, padded to chains of ``CHAIN`` words."""

    def __init__(self, texts: list[str | None], keys: np.ndarray, evidence: np.ndarray):
        w: Words = words(texts, cased=True)
        self.w = w
        n = len(w.hash)
        self.lex, best = _looked_up(w, keys, evidence)
        e = np.digitize(best, _BINS).astype(np.int8)
        same = w.doc[1:] == w.doc[:-1]
        before = np.concatenate([[0], np.where(same, e[:-1], 0)]) if n else e
        after = np.concatenate([np.where(same, e[1:], 0), [0]]) if n else e
        raised = np.concatenate([[0], np.cumsum(w.cased != w.buffer)])
        up = raised[w.end] - raised[w.start]
        shape = np.where(up == 0, 0, np.where(up > 1, 2, 1))
        length = np.digitize(w.end - w.start, (3, 6, 12))
        self.columns = [e, 5 + before, 10 + after, 15 + shape, 18 + length]
        self.evidence = e
        counts = w.counts()
        self.first = np.cumsum(counts) - counts
        inside = np.arange(n) - self.first[w.doc] if n else np.zeros(0, np.int64)
        per_text = -(-counts // CHAIN)
        base = np.cumsum(per_text) - per_text
        self.row = (base[w.doc] + inside // CHAIN) if n else inside
        self.col = inside % CHAIN
        self.rows = int(per_text.sum())

    def scores(self, word_weight: np.ndarray, weight: np.ndarray) -> np.ndarray:
        s = np.concatenate([word_weight, [0.0]])[self.lex]
        for c in self.columns:
            s = s + weight[c]
        return s

    def padded(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros((CHAIN, self.rows))
        out[self.col, self.row] = values
        return out


def forward_backward(scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(marginals of label 1, expected transition counts) of chains in columns, each ``lengths`` words long.

    ``scores`` are those of label 1 against label 0; ``trans[a, b]`` that of a followed by b.
    """
    steps, n = scores.shape
    psi, m = np.exp(np.clip(scores, -30, 30)), np.exp(trans)
    ahead = np.empty((steps, n))
    p = psi[0] / (1 + psi[0])
    ahead[0] = p
    for t in range(1, steps):
        one = ((1 - p) * m[0, 1] + p * m[1, 1]) * psi[t]
        zero = (1 - p) * m[0, 0] + p * m[1, 0]
        p = one / (one + zero)
        ahead[t] = p
    gamma = np.empty((steps, n))
    b1 = np.full(n, 0.5)
    pairs = np.zeros((2, 2))
    for t in range(steps - 1, -1, -1):
        if t + 1 < steps:
            live = lengths > t + 1
            in1, in0 = psi[t + 1] * b1, 1 - b1
            pair = np.array([[(1 - ahead[t]) * m[0, 0] * in0, (1 - ahead[t]) * m[0, 1] * in1], [ahead[t] * m[1, 0] * in0, ahead[t] * m[1, 1] * in1]])
            pairs += (pair / np.maximum(pair.sum((0, 1)), 1e-300))[:, :, live].sum(2)
            up1, up0 = m[1, 0] * in0 + m[1, 1] * in1, m[0, 0] * in0 + m[0, 1] * in1
            b1 = np.where(live, up1 / (up1 + up0), 0.5)
        one, zero = ahead[t] * b1, (1 - ahead[t]) * (1 - b1)
        gamma[t] = one / np.maximum(one + zero, 1e-300)
    return gamma, pairs


def _marginals(c: _Chains, model: ToxicModel) -> np.ndarray:
    if not c.rows:
        return np.zeros(0)
    lengths = np.bincount(c.row, minlength=c.rows)
    gamma, _ = forward_backward(c.padded(c.scores(model.word_weight, model.weight)), lengths, model.trans)
    return gamma[c.col, c.row]


def _document_features(c: _Chains, gamma: np.ndarray) -> np.ndarray:
    """Per text: 1, logit of the largest marginal, log of the expected number of toxic words, and of their share."""
    n, counts = c.w.n_texts, c.w.counts()
    most, total = np.zeros(n), np.bincount(c.w.doc, gamma, minlength=n)
    some = np.flatnonzero(counts)
    if len(some):
        most[some] = np.maximum.reduceat(gamma, c.first[some])
    return np.stack([np.ones(n), _logit(most), np.log1p(total), np.log(1e-3 + total / np.maximum(counts, 1))], 1)


def _scores(c: _Chains, gamma: np.ndarray, model: ToxicModel) -> np.ndarray:
    if model.base is not None:
        return np.full(c.w.n_texts, model.base)
    return _sigmoid(_document_features(c, gamma) @ model.link)


def _lexicon(sample: DataFrame, lexicon: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and evidence of the words and beginnings that tell toxic from clean documents best."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        w = words(batch.column(0).to_pylist())
        if not len(w.hash):
            return None
        # near copies share the smallest hash of their word pairs
        pair = mix(w.hash[:-1] + np.uint64(3) * w.hash[1:]) if len(w.hash) > 1 else w.hash
        copy = np.full(w.n_texts, np.iinfo(np.uint64).max, np.uint64)
        inside = w.doc[1:] == w.doc[:-1] if len(w.hash) > 1 else np.ones(1, bool)
        np.minimum.at(copy, w.doc[: len(pair)][inside], pair[inside])
        forms = _forms(w)
        doc = np.concatenate([w.doc[which] for which, _ in forms])
        key = np.concatenate([k for _, k in forms])
        order = np.lexsort((key, doc))
        doc, key = doc[order], key[order]
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])
        doc, key = doc[new], key[new]
        y = batch.column(1).take(pa.array(doc))
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), y, pa.array(copy[doc].view(np.int64))], ["word", "y", "copy"])

    seen = map_slices(sample.select("text", "y"), "text", run, "word bigint, y int, copy bigint").distinct()
    sizes = {r["y"]: r["n"] for r in seen.groupBy("y").agg(F.count_distinct("copy").alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    counted = seen.groupBy("word").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good"))
    weight = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("good") + 0.5) / (good + 1.0))
    least = max(MIN_SUPPORT, int(0.002 * bad))
    top = counted.where(F.col("bad") >= least).withColumn("e", weight).where(F.col("e") >= _BINS[0]).orderBy(F.desc("e"), "word").limit(lexicon).toPandas()
    key = top["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(key)
    return key[order], top["e"].to_numpy(float)[order]


def _training_chains(sample: DataFrame, keys: np.ndarray, evidence: np.ndarray, per_class: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(feature columns, labels, chain lengths): per sampled text its chains with evidence and one without.

    Of the chains from texts of each class ``per_class`` at most, those with the smallest hash.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        c = _Chains(batch.column(0).to_pylist(), keys, evidence)
        if not c.rows:
            return None
        y = np.asarray(batch.column(1)).astype(np.int64)
        gold = (y[c.w.doc] == 1) & (c.evidence >= 3)
        has = np.bincount(c.row, c.evidence > 0, minlength=c.rows) > 0
        text_of = np.zeros(c.rows, np.int64)
        text_of[c.row] = c.w.doc
        plain = np.flatnonzero(~has)
        has[plain[np.unique(text_of[plain], return_index=True)[1]]] = True
        kept = has[c.row]
        values = np.zeros(int(kept.sum()), _TOKEN)
        values["lex"] = c.lex[kept]
        for i, x in enumerate(c.columns):
            values["f"][:, i] = x[kept]
        values["gold"] = gold[kept]
        counts = np.bincount(c.row[kept], minlength=c.rows)
        ends = np.cumsum(counts[counts > 0])
        chains = pa.array([x.tobytes() for x in np.split(values, ends[:-1])], pa.binary())
        return pa.RecordBatch.from_arrays([chains, pa.array(y[text_of[counts > 0]].astype(np.int32))], ["chain", "y"])

    rows = materialize(map_slices(sample.select("text", "y"), "text", run, "chain binary, y int"), "chains")
    picked = [rows.where(F.col("y") == y).orderBy(F.xxhash64("chain"), "chain").limit(per_class) for y in (0, 1)]
    chains = picked[0].unionByName(picked[1]).select("chain").toArrow().column(0).to_pylist()
    lengths = np.array([len(x) for x in chains], np.int64) // _TOKEN.itemsize
    flat = np.frombuffer(b"".join(chains), _TOKEN)
    return [flat["lex"], *flat["f"].T], flat["gold"], lengths


def _fit_field(features: list[np.ndarray], gold: np.ndarray, lengths: np.ndarray, n_words: int, rounds: int = 80) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights by gradient steps (Adam) on the conditional likelihood with a small ridge."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    col = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    lex, columns = features[0], features[1:]
    size = n_words + 1 + _FEATURES + 4
    theta, first, second = np.zeros(size), np.zeros(size), np.zeros(size)
    follows = (row[1:] == row[:-1]) if len(row) else np.zeros(0, bool)
    gold = gold.astype(np.int64)
    seen = np.bincount(2 * gold[:-1][follows] + gold[1:][follows], minlength=4) if len(row) else np.zeros(4)
    n = max(len(row), 1)
    for step in range(1, rounds + 1):
        word_w, w, trans = theta[: n_words + 1], theta[n_words + 1 : -4], theta[-4:].reshape(2, 2)
        s = word_w[lex] * (lex < n_words)
        for c in columns:
            s = s + w[c]
        grid = np.zeros((CHAIN, len(lengths)))
        grid[col, row] = s
        gamma, pairs = forward_backward(grid, lengths, trans)
        off = gamma[col, row] - gold
        g = np.concatenate(
            [
                np.bincount(lex, off, minlength=n_words + 1),
                sum(np.bincount(c, off, minlength=_FEATURES) for c in columns),
                pairs.ravel() - seen,
            ]
        ) / n + 1e-5 * theta
        g[n_words] = 0
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        theta = theta - 0.2 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta[:n_words], theta[n_words + 1 : -4], theta[-4:].reshape(2, 2)


def _fit_link(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic weights of the documents' features by damped Newton steps with a small ridge."""
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = _sigmoid(x @ b)
        g = x.T @ (weight * (p - y)) + 1e-2 * b
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(b))
        step = np.linalg.solve(h, g)
        b = b - step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
    return b


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", id_col: str = "doc_id", text: str = "text", per_class: int = PER_CLASS, lexicon: int = LEXICON,
    chains_per_class: int | None = None,
) -> ToxicModel:
    """A model from at most ``per_class`` labelled rows of each class (label 1: toxic, others: clean).

    The field is fitted on at most ``chains_per_class`` chains from the texts of each class, by default as many as rows.
    """
    flags = labels.select(F.col(id_col), (F.col(label) == 1).cast("int").alias("_llm_y"), usable.alias("_llm_use"))
    sample, counts = labelled_sample(docs, flags, "_llm_y", per_class, F.col("_llm_use"), id_col, text)
    none = np.zeros(0, np.uint64)
    total = sum(counts.values())
    if len(counts) < 2:
        share = counts.get(1, 0.0) / total if total else 0.0
        return ToxicModel(none, np.zeros(0), np.zeros(0), np.zeros(_FEATURES), np.zeros((2, 2)), np.zeros(4), share)
    keys, evidence = _lexicon(sample, lexicon)
    features, gold, lengths = _training_chains(sample, keys, evidence, chains_per_class or per_class)
    word_w, w, trans = _fit_field(features, gold, lengths, len(keys)) if len(lengths) else (np.zeros(len(keys)), np.zeros(_FEATURES), np.zeros((2, 2)))
    model = ToxicModel(keys, evidence, word_w, w, trans, np.zeros(4))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = _Chains(batch.column(0).to_pylist(), keys, evidence)
        x = _document_features(c, _marginals(c, model))
        return pa.RecordBatch.from_arrays([batch.column(1), list_array(pa.array(x.ravel()), np.full(len(x), x.shape[1]))], ["y", "x"])

    got = map_slices(sample.select("text", "y"), "text", run, "y int, x array<double>").toPandas()
    y = got["y"].to_numpy(float)
    in_sample = {c: max((y == c).sum(), 1) for c in counts}
    weight = np.array([counts[int(v)] / in_sample[int(v)] for v in y]) / total * len(y) if len(y) else np.zeros(0)
    if len(set(y.tolist())) < 2:
        model.base = counts.get(1, 0.0) / total
    else:
        model.link = _fit_link(np.stack(got["x"].to_numpy()), y, weight)
    return model


def score_toxicity(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id_col, mark, score, predicted, spans): spans are (start, end, marginal) in characters of the text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = _Chains(batch.column(0).to_pylist(), model.keys, model.evidence)
        gamma = _marginals(c, model)
        score = _scores(c, gamma, model)
        hit = np.flatnonzero(gamma >= 0.5) if model.base is None else np.zeros(0, np.int64)
        doc = c.w.doc[hit]
        # words next to each other are one span
        new = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (doc[1:] != doc[:-1])]) if len(hit) else np.zeros(0, bool)
        head = np.flatnonzero(new)
        tail = np.concatenate([head[1:], [len(hit)]]) - 1 if len(head) else head
        chars = np.concatenate([[0], np.cumsum((c.w.buffer & 0xC0) != 0x80)])
        base = chars[c.w.text_start[doc[head]]] if len(head) else np.zeros(0, np.int64)
        spans = pa.StructArray.from_arrays(
            [
                pa.array((chars[c.w.start[hit[head]]] - base).astype(np.int32)),
                pa.array((chars[c.w.end[hit[tail]]] - base).astype(np.int32)),
                pa.array(np.maximum.reduceat(gamma[hit], head) if len(head) else np.zeros(0)),
            ],
            ["start", "end", "marginal"],
        )
        per_text = np.bincount(doc[head], minlength=len(score)) if len(head) else np.zeros(len(score), np.int64)
        return pa.RecordBatch.from_arrays(
            [batch.column(1), batch.column(2), pa.array(score), pa.array((score >= threshold).astype(np.int32)), list_array(spans, per_text)],
            [id_col, "mark", "score", "predicted", "spans"],
        )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(id_col), F.xxhash64(text).alias("mark"))
    schema = f"`{id_col}` {kind}, mark bigint, score double, predicted int, spans array<struct<start int, end int, marginal double>>"
    return map_slices(rows, "text", run, schema)


def without_toxic(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that the model scores toxic; columns stay as they are."""
    model = fit_toxicity(docs, labels, usable, id_col=id_col, text=text, **options)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(at)):
                piece = batch.slice(a, b - a)
                c = _Chains(piece.column(at).to_pylist(), model.keys, model.evidence)
                yield piece.filter(pa.array(_scores(c, _marginals(c, model), model) < 0.5))

    return docs.mapInArrow(run, docs.schema)
