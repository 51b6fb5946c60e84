import brute
import pytest
from pyspark.sql import functions as F

from odqa_spark.catalog import fixtures as fx
from odqa_spark.operators import evaluate, profile

RUN = "row_idx bigint, config string, question string, answer array<string>, retrieved string, summary string, predicted string, score double"


def _by_config(df):
    return {r.config: r.asDict() for r in df.collect()}


def test_every_verdict_class_counted(spark):
    texts = {(1, 1): ("has gold", "gold"), (1, 0): ("has gold", "lost"), (0, 1): ("no", "gold now"), (0, 0): ("no", "no")}
    rows, i = [], 0
    for (had, kept), (ret, summ) in texts.items():
        for predicted in ("Gold!", "wrong"):
            rows.append((i, "c", "q", ["gold"], ret, summ, predicted, 0.0))
            i += 1
    m = _by_config(evaluate.run_metrics(spark.createDataFrame(rows, RUN)))["c"]
    assert (m["rows"], m["summarized"], m["exact_match"], m["f1"]) == (8, True, 50.0, 50.0)
    assert (m["sum_tn"], m["sum_fn"], m["sum_rc"], m["ret_em"], m["sum_em"]) == (25.0, 25.0, 50.0, 50.0, 50.0)
    assert (m["read_fp"], m["read_tn"]) == (25.0, 25.0)


def test_run_without_summary_or_without_answers(spark):
    rows = [
        (0, "plain", "q", ["gold"], "gold", None, "gold", 0.0), (1, "plain", "q", ["gold"], "no", None, "gold", 0.0),
        (0, "never", "q", ["gold"], "no", "no", "x", 0.0),
    ]
    m = _by_config(evaluate.run_metrics(spark.createDataFrame(rows, RUN)))
    assert m["plain"]["summarized"] is False and m["plain"]["sum_rc"] is None and m["plain"]["sum_em"] is None
    assert (m["plain"]["ret_em"], m["plain"]["read_fp"], m["plain"]["read_tn"]) == (50.0, 0.0, 50.0)
    assert m["never"]["sum_rc"] is None and m["never"]["sum_em"] == 0.0
    assert evaluate.run_metrics(spark.createDataFrame([], RUN)).count() == 0


def test_documented_counts_of_the_derived_runs(spark):
    runs = fx.qa_runs(spark, "/root/testdata/sf0.01")
    m = _by_config(evaluate.run_metrics(runs))
    want = {"k10_r0": (117, 93, 78, 23, 8, 72.5, 19, 27), "k10_r1": (116, 93, 77, 24, 8, 71.1667, 20, 28)}
    for config, (n, ret, kept, fn, tn, em, fp, rtn) in want.items():
        got = [m[config][c] for c in ("ret_em", "sum_em", "sum_fn", "sum_tn", "exact_match", "read_fp", "read_tn")]
        assert m[config]["rows"] == n
        assert got == pytest.approx([100 * x / n for x in (ret, kept, fn, tn, em, fp, rtn)], abs=1e-4)
        assert m[config]["sum_rc"] == pytest.approx(100 * (ret - fn) / ret)


def test_verdicts_match_brute_force(spark, sf):
    rows = evaluate.judge_rows(fx.qa_runs(spark, sf)).collect()
    for r in rows:
        answers = [a for a in r.answer if a is not None]
        assert r.em == pytest.approx(brute.exact_match(answers, r.predicted))
        for text, flag in ((r.retrieved, r.in_retrieved), (r.summary, r.in_summary)):
            assert flag == any(brute.normalize(a) in brute.normalize(text) for a in answers)


def test_metrics_do_not_depend_on_partitions(spark, sf):
    runs = fx.qa_runs(spark, sf)
    one = _by_config(evaluate.run_metrics(runs.coalesce(1)))
    many = _by_config(evaluate.run_metrics(runs.repartition(8, F.rand(3))))
    for c in one:
        for k, v in one[c].items():
            assert many[c][k] == (pytest.approx(v) if isinstance(v, float) else v)
        assert one[c]["ret_em"] - one[c]["sum_fn"] + one[c]["sum_tn"] == pytest.approx(one[c]["sum_em"])


def test_labels_and_predictions_by_other_names(spark):
    rows = [(0, "c", "q", ["gold"], "gold", None, "gold", 0.0)]
    df = spark.createDataFrame(rows, RUN).withColumnsRenamed({"answer": "gold", "predicted": "said", "retrieved": "ctx"})
    names = {"label_col": "gold", "predict_col": "said", "context_col": "ctx"}
    assert _by_config(evaluate.run_metrics(df, **names))["c"]["exact_match"] == 100.0
    assert evaluate.rescore(df, **names).head().score == 1.0
    assert {r.error_class for r in evaluate.error_samples(df, **names).collect()} == set()


def test_error_samples_are_first_rows(spark, sf):
    runs = fx.qa_runs(spark, sf)
    judged = evaluate.judge_rows(runs).collect()
    tests = {
        "sum_tn": lambda r: not r.in_retrieved and r.in_summary, "sum_fn": lambda r: r.in_retrieved and not r.in_summary,
        "read_fp": lambda r: r.in_summary and r.em == 0, "read_tn": lambda r: not r.in_summary and r.em != 0,
    }
    want = set()
    for config in {r.config for r in judged}:
        for name, test in tests.items():
            hits = [r.row_idx for r in judged if r.config == config and test(r)]
            if hits:
                want.add((config, name, min(hits)))
    assert {(r.config, r.error_class, r.row_idx) for r in evaluate.error_samples(runs).collect()} == want


def test_references_pair_by_row_not_by_question(spark):
    rows = [(0, "c", "same", ["a"], "b a", None, "x", 0.0), (1, "c", "same", ["z"], "b a", None, "y", 0.0)]
    runs = spark.createDataFrame(rows, RUN)
    both = evaluate.match_predictions(evaluate.squad_references(runs), runs.select("row_idx", "predicted"))
    got = sorted((r.row_idx, r.predicted, r.answers.answer_start) for r in both.collect())
    assert got == [(0, "x", [2]), (1, "y", [-1])]


def test_histogram_edges(spark):
    lengths = [0, 128, 129, 512, 513, 65536, 65537, 128000, 128001]
    df = spark.createDataFrame([(n, n) for n in lengths], "token_length bigint, text_length bigint")
    tokens = [r.n for r in profile.token_histogram(df).orderBy("bucket_no").collect()]
    chars = [r.n for r in profile.char_histogram(df).orderBy("bucket_no").collect()]
    assert tokens == [2, 1, 1, 1, 0, 0, 0, 0, 0, 1, 2, 1]
    assert chars == [4, 1, 0, 0, 0, 0, 0, 1, 3]
    labels = [r.bucket for r in profile.token_histogram(df).orderBy("bucket_no").collect()]
    assert labels[0] == "~128" and labels[1] == "128~256" and labels[-2:] == ["65536~128000", "128000~"]
    empty = profile.token_histogram(df.limit(0)).collect()
    assert len(empty) == 12 and all(r.n == 0 and r.pct is None for r in empty)
    text = profile.percent_map(profile.token_histogram(df)).head().percent
    assert len(text) == 12 and text["~128"] == "22.22%" and text["128~256"] == "11.11%"


def test_count_check(spark):
    df = spark.createDataFrame([(1, 1), (2, None)], "a int, b int")
    assert evaluate.count_check(df, same=("a", "a"), other=("a", "b")).head()[:] == (2, True, False)
