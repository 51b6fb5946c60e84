"""Model stages with injected functions, and the defaults that need no model.

A stage takes ``make_fn``: called once per task, it loads the model and returns a
function over lists. Only the columns the model needs cross to Python, in Arrow
batches cut to ``batch_size``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from odqa_spark.functions.binding import let, pinned
from odqa_spark.functions.prompts import default_instructions, summarizer_prompt
from odqa_spark.functions.text import clean_answer
from odqa_spark.operators.chunk import ratio_groups, seeded_order
from odqa_spark.session import settings

MAX_ANSWER_WORDS = 8  # fixed value: longest answer of the reader
MAX_IN_FLIGHT = 200  # fixed value: completion requests running at once
HASH_DIM = 64
WORDS_AT_ONCE = 1 << 14  # that the default embedder digests: their blocks stay in a core's cache
_EXCLUDED = "spark.sql.adaptive.optimizer.excludedRules"

ModelFn = Callable[..., list]


def model_column(make_fn: Callable[[], ModelFn], return_type: T.DataType, *inputs: Column, batch_size: int = 32) -> Column:
    """A column computed by a batched model function over the input columns."""
    from pyspark.sql.pandas.types import to_arrow_type

    arrow_type = to_arrow_type(return_type)

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        fn = make_fn()
        for arrays in batches:
            out: list = []
            for lo in range(0, len(arrays[0]), batch_size):
                out.extend(fn(*[a.slice(lo, batch_size).to_pylist() for a in arrays]))
            yield pa.array(out, arrow_type)

    def run_one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from run((a,) for a in batches)

    # the annotations pick the iterator form of the UDF
    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    run_one.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    # Not deterministic to the optimizer: otherwise a filter on the result, or one inferred from
    # exploding it, is pushed below and calls the model a second time.
    return F.arrow_udf(run_one if len(inputs) == 1 else run, return_type).asNondeterministic()(*inputs)


class Counters:
    """Counters of a pass over a frame, filled by the action that runs it."""

    def __init__(self, **counters: Column):
        self._seen, self._columns = Observation(), counters

    def on(self, df: DataFrame) -> DataFrame:
        """``df``, counted where it passes here."""
        return df.observe(self._seen, *[c.alias(name) for name, c in self._columns.items()])

    @property
    def counts(self) -> dict[str, int]:
        """The values after the action; 0 where Spark saw before running that no row can pass."""
        try:
            found = self._seen.get
        except Py4JJavaError:
            found = {}
        return {name: found.get(name, 0) for name in self._columns}


def counted(spark: SparkSession):
    """Keeps counters alive while an action runs: a stage that gave no row is otherwise cut out together with them."""
    rules = [spark.conf.get(_EXCLUDED, ""), "org.apache.spark.sql.execution.adaptive.AQEPropagateEmptyRelation"]
    return settings(spark, **{_EXCLUDED: ",".join(r for r in rules if r)})


def model_over_array(
    make_fn: Callable[[], ModelFn], item_type: T.DataType, question: Column, texts: Column, batch_size: int = 32
) -> Column:
    """Apply ``fn(questions, texts)`` to every element of an array, each with its row's question."""

    def make() -> ModelFn:
        fn = make_fn()

        def each(questions: list, lists: list) -> list:
            flat = [(q, text) for q, group in zip(questions, lists) for text in group or []]
            done: list = []
            for lo in range(0, len(flat), batch_size):
                part = flat[lo : lo + batch_size]
                done.extend(fn([q for q, _ in part], [text for _, text in part]))
            results = iter(done)
            return [[next(results) for _ in group or []] for group in lists]

        return each

    return model_column(make, T.ArrayType(item_type), question, texts, batch_size=batch_size)


# --- embedding -----------------------------------------------------------------------------------


# MD5 (RFC 1321): the words of a message are taken in turn by four rounds
_MD5_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_MD5_TURNS = [turn for turns in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for turn in turns * 4]
_MD5_STEPS = [(1, 0), (5, 1), (3, 5), (7, 0)]
_MD5_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_ONE_BLOCK = 55  # most bytes of a word that is one block with its length


def _md5_heads(text: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The first four bytes, last one highest, of the MD5 of every word of at most ``_ONE_BLOCK`` bytes, all words at once."""
    u4 = np.uint32
    text, starts = text[starts[0] : starts[-1] + sizes[-1]], starts - starts[0]
    padded = np.frombuffer(text + bytes(_ONE_BLOCK + 5), np.uint8).astype(u4)
    four = padded[:-3] | padded[1:-2] << u4(8) | padded[2:-1] << u4(16) | padded[3:] << u4(24)
    kept = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], u4)
    message: list = [None] * 16  # parts that are 0 for all words add nothing
    for j in range(int(sizes.max(initial=0)) // 4 + 1):
        left = sizes - 4 * j
        end = np.where((left >= 0) & (left < 4), u4(0x80) << (left.astype(u4) % u4(4) * u4(8)), u4(0))
        message[j] = (four[starts + 4 * j] & kept[np.clip(left, 0, 4)]) | end
    message[14] = (sizes * 8).astype(u4)
    a, b, c, d = (np.full(len(starts), x, u4) for x in _MD5_START)
    for i in range(64):
        if i < 16:
            mixed = d ^ (b & (c ^ d))
        elif i < 32:
            mixed = c ^ (d & (b ^ c))
        elif i < 48:
            mixed = b ^ c ^ d
        else:
            mixed = c ^ (b | ~d)
        step, first = _MD5_STEPS[i // 16]
        part = message[(step * i + first) % 16]
        mixed += a
        mixed += u4(_MD5_SINES[i])
        if part is not None:
            mixed += part
        turn = _MD5_TURNS[i]
        a, d, c, b = d, c, b, b + (mixed << u4(turn) | mixed >> u4(32 - turn))
    return a + u4(_MD5_START[0])


def _words(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The texts in one, and text number, start and size of their words: what stands between spaces, if anything."""
    joined = [t.encode() for t in texts]
    whole = b" ".join(joined)
    spaces = np.flatnonzero(np.frombuffer(whole, np.uint8) == ord(" "))
    starts = np.concatenate([[0], spaces + 1])
    sizes = np.diff(starts, append=len(whole) + 1) - 1
    starts, sizes = starts[sizes > 0], sizes[sizes > 0]
    ends = np.cumsum([len(t) + 1 for t in joined])
    return whole, np.searchsorted(ends, starts, "right"), starts, sizes


def hashed_words(dim: int = HASH_DIM) -> Callable[[], ModelFn]:
    """Default embedder: signed hashed bag of lower-case words, L2-normalised.

    Word ``w`` adds +1 or -1 to one dimension; the first four hex digits of
    ``md5(w)`` choose it, the fifth gives the sign. Deterministic on every engine.
    """

    def make() -> ModelFn:
        def embed(texts: list) -> list:
            whole, row, starts, sizes = _words([(t or "").lower().replace("\n", " ") for t in texts])
            head = np.empty(len(starts), np.uint32)
            fits = np.flatnonzero(sizes <= _ONE_BLOCK)
            for lo in range(0, len(fits), WORDS_AT_ONCE):
                some = fits[lo : lo + WORDS_AT_ONCE]
                head[some] = _md5_heads(whole, starts[some], sizes[some])
            for i in np.flatnonzero(sizes > _ONE_BLOCK).tolist():
                head[i] = int.from_bytes(hashlib.md5(whole[starts[i] : starts[i] + sizes[i]]).digest()[:4], "little")
            # hex digits stand for the bytes in their order
            place = ((head & 0xFF) << 8 | head >> 8 & 0xFF).astype(np.int64) % dim
            counts = np.bincount(
                row * dim + place, weights=1.0 - 2.0 * (head >> 20 & 1), minlength=len(texts) * dim
            ).reshape(len(texts), dim)
            norms = np.maximum(np.sqrt((counts**2).sum(axis=1)), 1e-12)
            return list(counts / norms[:, None])

        return embed

    return make


def within_tokens(make_fn: Callable[[], ModelFn], max_tokens: int, count: Callable[[str], int] | None = None) -> Callable[[], ModelFn]:
    """The model function called on batches of bounded size: rows times the tokens of the longest, at most ``max_tokens``.

    Of the texts it is given, each different one is passed on once, shortest first, so that texts of a
    batch are about as long; results come back in the order of the texts. A text that is too
    long on its own is a batch of its own. ``count`` tells the tokens of a text, by default its words.
    """
    tokens = count or (lambda text: len(text.split()))

    def make() -> ModelFn:
        fn = make_fn()

        def batched(texts: list) -> list:
            sizes = {t: max(1, tokens(t)) if t is not None else 1 for t in dict.fromkeys(texts)}
            done: dict = {}
            batch: list = []
            for t in sorted(sizes, key=lambda t: sizes[t]):
                # sizes rise, so the text at hand is the longest of its batch
                if batch and (len(batch) + 1) * sizes[t] > max_tokens:
                    done |= zip(batch, fn(batch))
                    batch = []
                batch.append(t)
            if batch:
                done |= zip(batch, fn(batch))
            return [done[t] for t in texts]

        return batched

    return make


def embed(text: Column, make_fn: Callable[[], ModelFn] | None = None, batch_size: int = 1024, max_tokens: int | None = None) -> Column:
    """Vectors of texts, ``array<double>``.

    With ``max_tokens`` the model is called on batches of bounded tokens (``within_tokens``), taken
    from ``batch_size`` rows at a time.
    """
    make = make_fn or hashed_words()
    if max_tokens is not None:
        make = within_tokens(make, max_tokens)
    return model_column(make, T.ArrayType(T.DoubleType()), text, batch_size=batch_size)


def embed_if_missing(
    df: DataFrame, text: Column, make_fn=None, column: str = "embeddings", out: str = "vec", max_tokens: int | None = None
) -> DataFrame:
    """Reuse stored vectors; compute the others (all of them if the column is absent)."""
    if column not in df.columns:
        return df.withColumn(out, embed(text, make_fn, max_tokens=max_tokens))
    stored = F.col(column).cast("array<double>")
    # rows that have a vector send null text, so the model sees only the rest
    computed = embed(F.when(stored.isNull(), text), make_fn, max_tokens=max_tokens)
    return df.withColumn(out, F.coalesce(stored, computed))


# --- condensing ----------------------------------------------------------------------------------

# Fixed values of the default condenser and reader, which are this package's own.
SENTENCE = r"[^.!?\n]+[.!?]*"
WORD_BREAK = r"[^\p{L}\p{N}]+"


def sentences(text: Column) -> Column:
    parts = F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), lambda s: F.btrim(s))
    return F.filter(parts, lambda s: s != "")


def terms(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), WORD_BREAK, -1), lambda w: w != ""))


def _ranked(question_terms: Column, sentence_list: Column) -> Column:
    """Sentences as ``(-shared terms, position, text)``, best first."""
    return let(
        question_terms,
        lambda known: F.array_sort(
            F.transform(
                sentence_list,
                lambda s, i: F.struct(
                    (-F.size(F.array_intersect(terms(s), known))).alias("o"), i.alias("i"), s.alias("s")
                ),
            )
        ),
    )


def extract_sentences(question: Column, text: Column) -> Column:
    """Default condenser: the third of the sentences that shares most terms with the question, in text order."""
    kept = let(
        _ranked(terms(question), sentences(text)),
        lambda ranked: F.slice(ranked, 1, F.ceil(F.size(ranked) / 3).cast("int")),
    )
    in_order = F.array_sort(F.transform(kept, lambda r: F.struct(r["i"].alias("i"), r["s"].alias("s"))))
    return F.array_join(F.transform(in_order, lambda r: r["s"]), " ")


def condense(question: Column, text: Column, make_fn: Callable[[], ModelFn] | None = None, batch_size: int = 30) -> Column:
    """Summary of ``text`` for ``question``; ``fn(questions, texts) -> summaries``."""
    if make_fn is None:
        return extract_sentences(question, text)
    return model_column(make_fn, T.StringType(), question, text, batch_size=batch_size)


def condense_passages(
    df: DataFrame, ratio: int = 1, make_fn: Callable[[], ModelFn] | None = None, shuffle: bool = True,
    tail: str = "keep", batch_size: int = 30,
) -> DataFrame:
    """Add ``summary`` from ``question`` and the passage array ``psgs``.

    With ``ratio`` 1 all passages are condensed together. Otherwise they are put
    in seeded order, grouped by ``ratio``, every group is condensed with its own
    question, and the group summaries are joined. Groups stay arrays of their
    row, so no row is moved.
    """
    q = F.col("question")
    if ratio == 1:
        return df.withColumn("summary", pinned(condense(q, F.array_join("psgs", "\n"), make_fn, batch_size)))
    psgs = seeded_order(F.col("psgs"), F.array_join("psgs", "\n")) if shuffle else F.col("psgs")
    inputs = F.transform(ratio_groups(psgs, ratio, tail), lambda g: F.array_join(g, "\n"))
    if make_fn is None:
        summary = F.array_join(F.transform(inputs, lambda t: extract_sentences(q, t)), "\n")
        return df.withColumn("summary", pinned(summary))
    each = model_over_array(make_fn, T.StringType(), q, F.col("_inputs"), batch_size)
    return df.withColumn("_inputs", pinned(inputs)).withColumn("summary", F.array_join(each, "\n")).drop("_inputs")


# --- reading -------------------------------------------------------------------------------------

ANSWER_TYPE = T.StructType([
    T.StructField("score", T.DoubleType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("answer", T.StringType()),
])


def _best_run(words: Column, known: Column, size: int) -> Column:
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - size, F.lit(0)))

    def run(i: Column) -> Column:
        text = F.array_join(F.slice(words, i + 1, size), " ")
        return F.struct(F.size(F.array_intersect(terms(text), known)).alias("n"), (-i).alias("i"), text.alias("t"))

    return F.array_max(F.transform(starts, run))["t"]


def lexical_answer(question: Column, context: Column, max_words: int = MAX_ANSWER_WORDS) -> Column:
    """Default reader: the words, ``max_words`` at most, of the sentence that shares most terms with the question.

    Of a longer sentence the run with most of these terms is taken, the first on ties.

    ``score`` is the share of question terms found in the sentence; null if the context has no sentence.
    """

    def info(best: Column, known: Column) -> Column:
        def found(answer: Column) -> Column:
            start = F.instr(context, answer) - 1
            return F.struct(
                (-best["o"] / F.greatest(F.size(known), F.lit(1))).alias("score"),
                start.alias("start"),
                (start + F.length(answer)).alias("end"),
                answer.alias("answer"),
            )

        answer = let(F.split(best["s"], " ", -1), lambda words: _best_run(words, known, max_words))
        return F.when(best.isNotNull(), let(answer, found))

    return let(
        terms(question),
        lambda known: let(
            F.get(_ranked(known, sentences(context)), F.lit(0)), lambda best: info(best, known)
        ),
    )


def read_answer(question: Column, context: Column, make_fn: Callable[[], ModelFn] | None = None, batch_size: int = 32) -> Column:
    """``answer_info`` of one context, answer cleaned.

    ``fn(questions, contexts)`` returns dicts with ``score, start, end, answer``.
    """
    if make_fn is None:
        info = lexical_answer(question, context)
    else:
        info = model_column(make_fn, ANSWER_TYPE, question, context, batch_size=batch_size)
    return let(info, _cleaned)


def _cleaned(info: Column) -> Column:
    return info.withField("answer", clean_answer(info["answer"]))


def read_each(question: Column, passages: Column, make_fn: Callable[[], ModelFn] | None = None, batch_size: int = 32) -> Column:
    """``answer_info`` of every passage of an array, answers cleaned."""
    if make_fn is None:
        return F.transform(passages, lambda p: read_answer(question, p))
    infos = model_over_array(make_fn, ANSWER_TYPE, question, passages, batch_size)
    return F.transform(infos, _cleaned)


def best_answer(infos: Column) -> Column:
    """The answer with the highest score of an array in rank order; the first one wins ties."""
    keyed = F.transform(
        F.filter(infos, lambda a: a.isNotNull()), lambda a, i: F.struct(a["score"].alias("s"), (-i).alias("r"), a.alias("a"))
    )
    return F.array_max(keyed)["a"]


# --- completion ----------------------------------------------------------------------------------

COMPLETION_TYPE = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("error", T.StringType()),
])


def complete(
    prompt: Column,
    make_fn: Callable[[], Callable[..., str]],
    system: Column | None = None,
    max_in_flight: int = MAX_IN_FLIGHT,
    parallel_tasks: int | None = None,
    retries: int = 3,
    retry_on: tuple[type[BaseException], ...] = (TimeoutError, OSError),
    wait: float = 0.0,
) -> Column:
    """``text, error`` per prompt from a one-prompt function, requests overlapping in threads.

    The function is called as ``fn(prompt)``, or ``fn(prompt, system)`` if a column
    of system prompts is given.
    ``max_in_flight`` bounds the requests of the whole job: it is shared by
    ``parallel_tasks`` tasks, by default as many as the cluster has slots, and
    each task has one request at least. Errors in ``retry_on``
    are retried at most ``retries`` times; a prompt that still fails gets text
    ``''`` and the error, and never fails the job. Write the result before using it
    twice: a lost executor repeats only the unwritten calls. ``completion.complete_stored``
    keeps results over runs, and its bound holds when the number of executors changes.
    """
    make, threads = _completer(make_fn, max_in_flight, parallel_tasks, retries, retry_on, wait)
    inputs = [prompt] if system is None else [prompt, system]
    return model_column(make, COMPLETION_TYPE, *inputs, batch_size=max(threads * 4, 64))


def _completer(
    make_fn: Callable[[], Callable[..., str]], max_in_flight: int = MAX_IN_FLIGHT, parallel_tasks: int | None = None,
    retries: int = 3, retry_on: tuple[type[BaseException], ...] = (TimeoutError, OSError), wait: float = 0.0,
) -> tuple[Callable[[], ModelFn], int]:
    """The batched form of a one-prompt function, and its number of threads."""
    slots = parallel_tasks or SparkSession.active().sparkContext.defaultParallelism
    threads = max(1, max_in_flight // max(1, slots))

    def make() -> ModelFn:
        import time

        fn = make_fn()

        def one(*prompt: str | None) -> dict:
            if None in prompt:
                return {"text": "", "error": "no prompt"}
            for attempt in range(retries + 1):
                try:
                    return {"text": str(fn(*prompt)), "error": None}
                except retry_on as e:
                    failure = e
                    if wait and attempt < retries:
                        time.sleep(wait)
                except Exception as e:
                    failure = e
                    break
            return {"text": "", "error": f"{type(failure).__name__}: {failure}"}

        def batch(*columns: list) -> list:
            with ThreadPoolExecutor(threads) as pool:
                return list(pool.map(one, *columns))

        return batch

    return make, threads


def complete_each(prompts: Column, make_fn: Callable[[], Callable[..., str]], system: Column, **options) -> Column:
    """``text, error`` of every prompt of an array, each called with its row's ``system``; see ``complete``."""
    single, threads = _completer(make_fn, **options)

    def make() -> ModelFn:
        batch = single()
        return lambda systems, texts: batch(texts, systems)

    return model_over_array(make, COMPLETION_TYPE, system, prompts, batch_size=max(threads * 4, 64))


def condense_by_prompt(
    df: DataFrame, summarizer: str, make_fn: Callable[[], Callable[[str, str], str]], ratio: int = 1,
    shuffle: bool = True, tail: str = "keep", **options,
) -> DataFrame:
    """Add ``summary`` and ``summary_error`` from a completion function.

    ``summarizer`` is ``model.version`` of a known instruction. With ``ratio``
    above 1 the passages are grouped as in ``condense_passages``, one call per
    group; the summary joins what the calls gave, and the error is the first of theirs.
    """
    version = summarizer.rsplit(".", 1)[-1]
    known = default_instructions()
    if version not in known:
        raise ValueError(f"unknown instruction version {version!r} in summarizer {summarizer!r}")
    question = F.col("question")
    if ratio == 1:
        prompt = summarizer_prompt(question, F.array_join("psgs", "\n"))
        done = complete(prompt, make_fn, F.lit(known[version]), **options)
        rows = df.withColumn("_done", done)
        return rows.withColumns({"summary": F.col("_done.text"), "summary_error": F.col("_done.error")}).drop("_done")
    psgs = seeded_order(F.col("psgs"), F.array_join("psgs", "\n")) if shuffle else F.col("psgs")
    prompts = F.transform(ratio_groups(psgs, ratio, tail), lambda g: summarizer_prompt(question, F.array_join(g, "\n")))
    rows = df.withColumn("_prompts", pinned(prompts))
    rows = rows.withColumn("_done", complete_each(F.col("_prompts"), make_fn, F.lit(known[version]), **options))
    return rows.withColumns({
        "summary": F.array_join("_done.text", "\n"),
        "summary_error": F.get(F.filter("_done.error", lambda e: e.isNotNull()), F.lit(0)),
    }).drop("_done", "_prompts")


def best_passage(candidates: DataFrame) -> DataFrame:
    """One row per ``row_idx``: the candidate with the best score, lowest ``rank`` first on ties."""
    from pyspark.sql import Window

    w = Window.partitionBy("row_idx").orderBy(F.col("score").desc(), F.col("rank"))
    return candidates.withColumn("_best", F.row_number().over(w)).where(F.col("_best") == 1).drop("_best")
