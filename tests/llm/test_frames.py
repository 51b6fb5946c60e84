import random

import numpy as np
import pyarrow as pa

from odqa_spark.llm import frames, tokens


def test_slices_cover_all_rows():
    col = pa.array(["a" * 5, None, "", "b" * 100, "c", "d" * 3])
    assert list(frames.slices(col, 8)) == [(0, 3), (3, 4), (4, 6)]
    assert list(frames.slices(pa.array([], pa.string()))) == []


def test_sketch_has_no_false_negatives(spark):
    keys = [random.Random(i).getrandbits(64) - (1 << 63) for i in range(500)]
    sketch = frames.KeySketch.of(spark.createDataFrame([(k,) for k in keys] + [(None,)], "k bigint"), "k", 1 << 14)
    assert sketch.may_hold(np.array(keys, np.int64)).all()
    assert sketch.may_hold(np.arange(10_000, dtype=np.int64)).mean() < 0.05
    assert not frames.KeySketch.of(spark.createDataFrame([], "k bigint"), "k").may_hold(np.arange(5)).any()


def test_words_and_hashes():
    w = tokens.words(["One two_3 ÉTÉ", None, "", "x—y “z”", "İstanbul one"], cased=True)
    assert [w.word(i) for i in range(len(w.doc))][:3] == ["one", "two_3", "été"]
    assert w.doc.tolist() == [0, 0, 0, 3, 3, 3, 4, 4]
    assert int(w.hash[0]) == int(w.hash[7]) == tokens.hash_word("one") % (1 << 64)
    assert len(tokens.words([]).doc) == 0
