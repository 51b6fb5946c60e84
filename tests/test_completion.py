from pyspark.sql import functions as F

from odqa_spark.operators import completion, models

SCHEMA = "row_idx int, prompt string, system string, key string"


def _model(spark, down=None):
    """(model, counter): a model that counts its calls over all tasks and fails at prompts with the word ``down``."""
    calls = spark.sparkContext.accumulator(0)

    def make():
        def call(prompt, system="-"):
            calls.add(1)
            if down and down in prompt:
                raise ValueError("down")
            return f"{system}:{prompt.upper()}"

        return call

    return make, calls


def _rows(spark, n=40):
    rows = [(i, None if i % 4 == 0 else "hot" if i % 4 == 1 else f"p{i}", f"s{i % 2}", "k") for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def _got(df):
    return {r.row_idx: (r.text, r.error) for r in df.collect()}


def test_each_prompt_is_called_once_over_all_runs(spark, tmp_path):
    (model, calls), store = _model(spark), str(tmp_path / "store")
    rows = _rows(spark)
    for _ in range(2):
        out = completion.complete_stored(rows, F.col("prompt"), model, store, "m", width=3, wave_calls=7)
        assert out.columns == [*rows.columns, "text", "error"]
        want = {r.row_idx: ("", "no prompt") if r.prompt is None else (f"-:{r.prompt.upper()}", None) for r in rows.collect()}
        assert _got(out) == want
        assert calls.value == 21
    # another model, or another system text, is another call
    completion.complete_stored(rows, F.col("prompt"), model, store, "other")
    assert calls.value == 42
    out = completion.complete_stored(rows, F.col("prompt"), model, store, "m", system=F.col("system"))
    assert calls.value == 63 and _got(out)[1] == ("s1:HOT", None)


def test_failures_are_called_again(spark, tmp_path):
    (model, calls), store = _model(spark), str(tmp_path / "store")
    rows = _rows(spark, 12)
    broken, tried = _model(spark, "hot")
    assert _got(completion.complete_stored(rows, F.col("prompt"), broken, store, "m"))[1] == ("", "ValueError: down")
    first = tried.value
    completion.complete_stored(rows, F.col("prompt"), broken, store, "m", retry_failed=False)
    assert tried.value == first == 7
    assert _got(completion.complete_stored(rows, F.col("prompt"), model, store, "m"))[1] == ("-:HOT", None)
    assert calls.value == 1


def test_an_ended_job_resumes_behind_its_last_wave(spark, tmp_path, monkeypatch):
    (model, calls), store = _model(spark), str(tmp_path / "store")
    rows = spark.createDataFrame([(i, f"p{i}", "s", "k") for i in range(60)], SCHEMA)
    waves = []
    own = completion.complete

    def ends(*args, **options):
        waves.append(1)
        if len(waves) == 3:
            raise KeyboardInterrupt
        return own(*args, **options)

    monkeypatch.setattr(completion, "complete", ends)
    try:
        completion.complete_stored(rows, F.col("prompt"), model, store, "m", wave_calls=15)
    except KeyboardInterrupt:
        pass
    done = calls.value
    assert 0 < done < 60
    out = completion.complete_stored(rows, F.col("prompt"), model, store, "m", wave_calls=15)
    assert calls.value == 60 and len(_got(out)) == 60


def test_width_bounds_the_requests(spark, tmp_path, monkeypatch):
    """The share of a task follows from the width of the stage, not from the cluster."""
    asked = []
    own = models._completer

    def seen(make_fn, max_in_flight, parallel_tasks, *rest):
        asked.append((max_in_flight, parallel_tasks))
        return own(make_fn, max_in_flight, parallel_tasks, *rest)

    monkeypatch.setattr(models, "_completer", seen)
    rows = _rows(spark)
    completion.complete_stored(rows, F.col("prompt"), _model(spark)[0], str(tmp_path / "a"), "m", max_in_flight=8, width=50)
    completion.complete_stored(rows, F.col("prompt"), _model(spark)[0], str(tmp_path / "b"), "m", max_in_flight=200, width=50)
    assert asked == [(8, 8), (200, 50)]


def test_empty_rows(spark, tmp_path):
    rows = _rows(spark).limit(0)
    assert completion.complete_stored(rows, F.col("prompt"), _model(spark)[0], str(tmp_path / "s"), "m").count() == 0
