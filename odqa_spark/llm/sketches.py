"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A document is the set of its paragraphs: lines, long ones cut at the first end of a word after
``PIECE`` characters. Each paragraph has a 64-bit digest, which is entered into one cell of each of
three tables; a cell keeps the number of digests, their exclusive or, and that of a check value. Of
two versions the cells are subtracted: what both have cancels, and a cell with one digest left gives
that digest away. Taking it out of its other cells frees more, in rounds, until nothing is left. If
something is left after ``ROUNDS`` rounds, the pair is tried again with larger tables. The numbers of
digests recovered on both sides give the likeness: common paragraphs by all paragraphs of the two.

Only DataFrame functions are used. Cells are rows, keyed by pair; a try moves the digests of a pair
to one place, and all its rounds run there without another exchange.

The fingerprint is the sketch with ``BASE`` cells per table in hexadecimal: count, digests, checks.
It can be subtracted from another one as it is; a few differing paragraphs can be read from it.

The edited text of a document has its second half replaced by the beginning of the next document's
text, documents in descending order of ids. Rows are cut into blocks of this order, and the first
row of a block is also sent, marked, to the end of the block before.

Defined cases: a null text is the empty text; it has no paragraphs, and two empty sets are alike by
1. Null ids come last, rows of one id in descending order of a 64-bit hash of their texts; equal
rows have the same next text up to the last of them. One document is its own next. Paragraphs that stand
twice count once. An empty table gives no rows. Ids are numbers. Other columns are not looked at.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odqa_spark.functions.binding import let
from odqa_spark.llm.frames import materialize

PIECE = 200
TABLES = 3
BASE = 3
#: Cells per table of the first try, and by how much a retry is larger.
FIRST = 12
GROWTH = 4
ROUNDS = 8
#: Blocks of the order of ids for each partition of a shuffle.
BLOCKS = 4


def digests(text: Column) -> Column:
    """Digests of the different paragraphs of a text."""
    pieces = F.regexp_extract_all(text, F.lit(rf"[^\n]{{1,{PIECE}}}[^\n ]*"), F.lit(0))
    return F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p)))


def _place(digest: str, table: int | str, size: int) -> str:
    return f"pmod(xxhash64({digest}, {table}), {size}L)"


def _check(digest: str) -> str:
    return f"xxhash64({digest}, {TABLES})"


def fingerprint(units: str, size: int = BASE) -> Column:
    """The cells of the sketch of an array of digests, as hexadecimal text: 8, 16 and 16 digits of each."""
    folded = lambda values: f"aggregate({values}, 0L, (a, x) -> a ^ x)"
    digits = lambda value, n: f"lpad(lower(hex({value})), {n}, '0')"
    mine = f"filter({units}, d -> {_place('d', f'int(c div {size})', size)} = c % {size})"
    shown = f"concat({digits('size(m)', 8)}, {digits(folded('m'), 16)}, {digits(folded(f'transform(m, d -> {_check("d")})'), 16)})"
    return F.expr(f"array_join(transform(sequence(0, {TABLES * size - 1}), c -> transform(array({mine}), m -> {shown})[0]), '')")


def _blocks(docs: DataFrame, n: int):
    """(block of a row as a column of ``id`` and ``h``, last block): ranges of descending id, nulls last."""
    probs = [(i + 1) / n for i in range(n - 1)]
    bounds = F.percentile_approx("id", probs, 20 * n) if probs else F.lit(None)
    found = docs.agg(F.count("*").alias("n"), F.count("id").alias("named"), bounds.alias("bounds")).first()
    cuts = sorted(found["bounds"] or [], reverse=True)
    nulls = 1 + n * (found["n"] - found["named"]) // max(1, found["n"])
    width = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    kind = docs.schema["id"].dataType.simpleString()
    last_of = F.from_json(F.lit(json.dumps([float(g[-1]) if kind in ("float", "double") else int(g[-1]) for g in groups])), f"array<{kind}>")
    group = F.from_json(F.lit(json.dumps([[float(x) if kind in ("float", "double") else int(x) for x in g] for g in groups] + [[]])), f"array<array<{kind}>>")

    def above(test) -> Column:
        """How many cuts pass a test that holds from the first cut on up to some cut: whole groups first."""
        return let(F.size(F.filter(last_of, test)), lambda g: g * width + F.size(F.filter(F.get(group, g), test)))

    # rows of one id, if many, are cut by the hash of the text; so are those without an id
    high = F.lit(0.5) - F.col("h").cast("double") / F.lit(2.0**64)
    spread = lambda parts: F.least(F.floor(F.greatest(high, F.lit(0.0)) * parts), parts - 1).cast("int")
    more = above(lambda c: c > F.col("id"))
    same = above(lambda c: c >= F.col("id")) - more
    named = F.when(same > 1, more + spread(same)).otherwise(more)
    return F.when(F.col("id").isNull(), F.lit(len(cuts) + 1) + spread(F.lit(nulls))).otherwise(named).cast("int"), len(cuts) + 1 + nulls


def with_next(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, id, text, next_text) with a number of its own per row; the first document follows the last."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(whole).alias("h"), whole.alias("text"))
    spark = docs.sparkSession
    block, n = _blocks(docs.select(F.col(id_col).alias("id")), BLOCKS * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.withColumn("block", block)
    # the first row of each block that has rows: as many as there are blocks
    first = rows.groupBy("block").agg(F.max(F.struct(F.col("id").isNotNull().alias("named"), "id", "h")).alias("f")).select("block", "f.id", "f.h")
    heads = {r["block"]: r for r in first.collect()}
    order = sorted(heads)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    known = [[int(heads[b]["h"]), before[b]] if b in heads else None for b in range(n + 1)]
    head = F.get(F.from_json(F.lit(json.dumps([dict(zip(("h", "before"), k)) if k else None for k in known])), "array<struct<h bigint, before int>>"), F.col("block"))
    ids = {b: heads[b]["id"] for b in order if heads[b]["id"] is not None}
    kind = rows.schema["id"].dataType.simpleString()
    number = float if kind in ("float", "double") else int
    head_id = F.get(F.from_json(F.lit(json.dumps([number(ids[b]) if b in ids else None for b in range(n + 1)])), f"array<{kind}>"), F.col("block"))
    leads = F.col("id").eqNullSafe(head_id) & (F.col("h") == head["h"])
    to = F.array(F.struct(F.col("block").alias("block"), F.lit(False).alias("extra")))
    both = F.concat(to, F.array(F.struct(head["before"].alias("block"), F.lit(True).alias("extra"))))
    placed = rows.select("id", "h", "text", F.explode(F.when(leads, both).otherwise(to)).alias("at"))
    placed = placed.select("id", "h", "text", "at.block", "at.extra").repartition("block")
    here = Window.partitionBy("block").orderBy("extra", F.col("id").desc_nulls_last(), F.col("h").desc(), F.col("text").desc())
    follows = placed.select("*", F.lead("text").over(here).alias("next_text"), F.row_number().over(here).alias("at"))
    number_of = F.shiftleft(F.col("block").cast("bigint"), 40) + F.col("at")
    return follows.where("not extra").select(number_of.alias("row"), "id", "text", "next_text")


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last half replaced by the beginning of ``following``, as long if that is long enough."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.char_length(text) - half), F.substr(following, F.lit(1), half))


def _subtracted(pairs: DataFrame, size: int) -> DataFrame:
    """(row, pair, cell, n, key, check): the cells of the one sketch less those of the other."""
    signed = "concat(transform(left, d -> struct(d, 1L AS s)), transform(right, d -> struct(d, -1L AS s)))"
    cells = ", ".join(f"{_place('e.d', t, size)} + {t * size}" for t in range(TABLES))
    each = pairs.selectExpr("row", "pair", f"explode({signed}) AS e")
    return _merged(each.selectExpr("row", "pair", f"explode(array({cells})) AS cell", "e.s AS n", "e.d AS key", f"{_check('e.d')} AS check"))


def _merged(cells: DataFrame) -> DataFrame:
    sums = cells.groupBy("row", "pair", "cell").agg(F.expr("sum(n) AS n"), F.expr("bit_xor(key) AS key"), F.expr("bit_xor(check) AS check"))
    return sums.where("n <> 0 or key <> 0 or check <> 0")


def _peeled(cells: DataFrame, size: int) -> DataFrame:
    """One round: digests of cells that hold one leave all their cells; cells -1 and -2 count them by side."""
    lone = f"cell >= 0 and abs(n) = 1 and check = {_check('key')}"
    as_cell = "struct(false AS found, cell AS item, n, key, check)"
    as_key = "struct(true AS found, key AS item, n, key, check)"
    items = cells.selectExpr("row", "pair", f"explode(if({lone}, array({as_cell}, {as_key}), array({as_cell}))) AS i")
    # a digest may be alone in more than one of its cells
    once = items.selectExpr("row", "pair", "i.*").groupBy("row", "pair", "found", "item").agg(
        F.expr("any_value(n) AS n"), F.expr("any_value(key) AS key"), F.expr("any_value(check) AS check")
    )
    leaves = ", ".join(f"struct({_place('key', t, size)} + {t * size} AS cell, -n AS n, key, check)" for t in range(TABLES))
    tally = "struct(if(n > 0, -1L, -2L) AS cell, 1L AS n, 0L AS key, 0L AS check)"
    moves = f"explode(if(found, array({leaves}, {tally}), array(struct(item AS cell, n, key, check)))) AS c"
    return _merged(once.selectExpr("row", "pair", moves).selectExpr("row", "pair", "c.*"))


def _tried(pairs: DataFrame, size: int) -> DataFrame:
    """(row, pair, rest, ours, theirs): cells not emptied and digests recovered, of pairs that differ."""
    cells = _subtracted(pairs, size)
    for _ in range(ROUNDS):
        cells = _peeled(cells, size)
    return cells.groupBy("row", "pair").agg(
        F.expr("count_if(cell >= 0) AS rest"), F.expr("sum(if(cell = -1, n, 0)) AS ours"), F.expr("sum(if(cell = -2, n, 0)) AS theirs")
    )


def differences(pairs: DataFrame, first: int = FIRST) -> DataFrame:
    """(row, pair, ours, theirs): how many digests only ``left`` and only ``right`` has, of the pairs that differ."""
    done, size = [], first
    waiting = pairs.repartition("row", "pair")
    while True:
        tried = materialize(_tried(waiting, size), "sketch-try")
        done.append(tried.where("rest = 0").select("row", "pair", "ours", "theirs"))
        failed = tried.where("rest > 0").select("row", "pair")
        if failed.isEmpty():
            break
        waiting = pairs.join(failed.hint("merge"), ["row", "pair"], "left_semi")
        size *= GROWTH
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found


def _likeness(n: Column, ours: Column, theirs: Column) -> Column:
    ours, theirs = F.coalesce(ours, F.lit(0)), F.coalesce(theirs, F.lit(0))
    return F.when(n + theirs == 0, 1.0).otherwise((n - ours) / F.greatest(n + theirs, F.lit(1)))


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next per row of ``docs``."""
    rows = with_next(docs, id_col, text).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = materialize(
        rows.select(
            "row", "id", F.char_length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
            digests(F.col("text")).alias("units"), digests(F.col("edited")).alias("edited_units"), digests(F.col("next_text")).alias("next_units"),
        ),
        "sketch-rows",
    )
    other = F.array(F.struct(F.lit(0).alias("pair"), F.col("edited_units").alias("right")), F.struct(F.lit(1).alias("pair"), F.col("next_units").alias("right")))
    pairs = rows.select("row", F.col("units").alias("left"), F.explode(other).alias("o")).select("row", "left", "o.pair", "o.right")
    of = lambda name, pair: F.max(F.when(F.col("pair") == pair, F.col(name))).alias(f"{name}_{pair}")
    apart = differences(pairs).groupBy("row").agg(*[of(name, pair) for name in ("ours", "theirs") for pair in (0, 1)])
    n = F.size("units")
    return (
        rows.select(
            "row", "id", "n_chars", "edited_sha256", n.alias("n"), fingerprint("units").alias("fingerprint"),
            fingerprint("edited_units").alias("edited_fingerprint"),
        )
        .join(apart, "row", "left")
        .select(
            F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
            _likeness(F.col("n"), F.col("ours_0"), F.col("theirs_0")).alias("near_edited"),
            _likeness(F.col("n"), F.col("ours_1"), F.col("theirs_1")).alias("near_next"),
        )
    )
