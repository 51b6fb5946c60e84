"""The passage-and-vector table: typed, length-checked, appended to in batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from odqa_spark.functions.vectors import finite
from odqa_spark.operators.models import Counters, counted
from odqa_spark.schemas import ID_MAX, TEXT_MAX, TITLE_MAX, VECTOR_DIM, VECTOR_PASSAGE
from odqa_spark.session import materialize

METHODS = ("exact",)
ACCEPTED, REJECTED = "accepted", "rejected"
FATE = ("duplicate", "held_accepted", "held_rejected")
LITERAL_IDS = 1000  # a load of up to so many ids reads only the buckets that can hold them


def check_method(method: str) -> str:
    """Search methods the engine offers; anything else is refused here, not at search time."""
    if method not in METHODS:
        raise ValueError(f"unknown search method {method!r}; choose one of {METHODS}")
    return method


def reject_reason(dim: int = VECTOR_DIM, max_text: int = TEXT_MAX) -> Column:
    """Null for a row the table accepts, else the first limit it breaks."""
    return (
        F.when(F.col("id").isNull() | (F.length("id") > ID_MAX), "id")
        .when(F.col("vec").isNull() | (F.size("vec") != dim) | ~finite(F.col("vec")), "vec")
        .when(F.col("title").isNull() | (F.length("title") > TITLE_MAX), "title")
        .when(F.col("text").isNull() | (F.length("text") > max_text), "text")
    )


def early_reason(max_text: int = TEXT_MAX) -> Column:
    """Null for a row that no limit but the vector's can reject: known before anything is embedded."""
    return (
        F.when(F.col("id").isNull() | (F.length(F.col("id").cast("string")) > ID_MAX), "id")
        .when(F.col("title").isNull() | (F.length("title") > TITLE_MAX), "title")
        .when(F.col("text").isNull() | (F.length("text") > max_text), "text")
    )


def checked(rows: DataFrame, dim: int = VECTOR_DIM, max_text: int = TEXT_MAX) -> DataFrame:
    """Rows with ``reject_reason``."""
    return rows.withColumn("reject_reason", reject_reason(dim, max_text))


def buckets(spark: SparkSession, name: str) -> int:
    """Into how many buckets of ids the table is cut."""
    shown = spark.sql(f"DESCRIBE TABLE EXTENDED {name}_rows").where("col_name = 'Num Buckets'").first()
    return int(shown["data_type"])


def held_ids(spark: SparkSession, name: str, ids: list[str] | None = None) -> DataFrame:
    """``_id, held_accepted, held_rejected`` of every id in the table, or of ``ids``.

    The table is bucketed by id, so its ids are grouped and joined where they are read;
    with ``ids`` only their buckets, and in them the row groups that can hold them, are read.
    """
    stored = spark.table(f"{name}_rows").select("id", "status")
    if ids is not None:
        stored = stored.where(F.col("id").isin(ids))
    has = lambda status: F.bool_or(F.col("status") == status)
    return stored.groupBy(F.col("id").alias("_id")).agg(has(ACCEPTED).alias("held_accepted"), has(REJECTED).alias("held_rejected"))


def _first_rows(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """``_id, first, equal``: of each repeated id the mark of its first row by title and text, and how many rows are like it."""
    some = rows.join(repeated, "_id").groupBy("_id", "title", "text", "_mark").agg(F.count("*").alias("c"))
    first = some.groupBy("_id").agg(F.min(F.struct("title", "text", "_mark", "c")).alias("f"))
    return first.select("_id", F.col("f._mark").alias("first"), F.col("f.c").alias("equal"))


def with_fate(rows: DataFrame, name: str) -> DataFrame:
    """Adds what becomes of each row of a load: ``duplicate``, ``held_accepted``, ``held_rejected``.

    The ids of the load are counted, joined with the ids of the table without moving these,
    and written: only ids that repeat or that the table holds. The rows are then joined with that
    small table, so the source is read twice, or three times if ids repeat. An id that a third of the
    rows has, or rows without id, do not meet in one task: counts are combined before they are
    moved, the join can be split, and rows without id are spread by their content.
    ``duplicate`` is true for all but the first row by title and text of an id.
    """
    spark = rows.sparkSession
    columns = rows.columns
    mark = F.xxhash64("title", "text")
    keyed = rows.withColumn("_id", F.col("id").cast("string")).withColumn("_mark", mark)
    load = materialize(keyed.where("_id is not null").groupBy("_id").agg(F.count("*").alias("n")), "load-ids")
    head = [r["_id"] for r in load.select("_id").limit(LITERAL_IDS + 1).collect()]
    held = held_ids(spark, name, head if len(head) <= LITERAL_IDS else None)
    fate = load.repartition(buckets(spark, name), "_id").join(held, "_id", "left")
    fate = materialize(fate.where("n > 1 or held_accepted or held_rejected"), "load-fates")
    repeated = fate.where("n > 1").select("_id")
    firsts = None
    if not repeated.isEmpty():
        firsts = materialize(_first_rows(keyed, repeated), "load-firsts")
        fate = fate.join(firsts, "_id", "left")
    else:
        fate = fate.withColumns({"first": F.lit(None).cast("bigint"), "equal": F.lit(None).cast("bigint")})
    known = fate.select(F.col("_id").alias("_key"), "held_accepted", "held_rejected", "first", "equal")
    # a row without id has a key that no id is
    key = F.coalesce("_id", F.concat(F.lit("\u0000"), F.col("_mark").cast("string")))
    joined = keyed.join(known, key == F.col("_key"), "left")
    other = F.coalesce(F.col("_mark") != F.col("first"), F.lit(False))
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in FATE[1:]]
    if firsts is None or firsts.where("equal > 1").isEmpty():
        return joined.select(*columns, other.alias("duplicate"), *flags)
    # rows that are alike: one counts, the others repeat it
    alike = (F.col("equal") > 1) & ~other
    single = joined.where(F.coalesce(~alike, F.lit(True))).select(*columns, other.alias("duplicate"), *flags)
    row = F.struct(*columns, *flags).alias("row")
    many = joined.where(alike).groupBy("_id").agg(F.any_value(row).alias("row"), F.count("*").alias("n"))
    each = many.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("i"))
    return single.unionByName(each.select("row.*", (F.col("i") > 1).alias("duplicate")))


def left_to_load(rows: DataFrame, max_text: int = TEXT_MAX) -> DataFrame:
    """Rows (``with_fate``) that a load still has to embed.

    Left out are ids the table has accepted, and ids it has rejected as long as a
    limit other than the vector's rejects them still. Needs no vectors.
    """
    return rows.where(~F.col("held_accepted") & (~F.col("held_rejected") | early_reason(max_text).isNull()))


def create_if_absent(spark: SparkSession, name: str, path: str, method: str = "exact", n_buckets: int | None = None) -> None:
    """Create the vector table unless it exists.

    ``name_rows`` holds every row, one partition for accepted and one for rejected
    rows, so a load writes both in one pass; ``name`` and ``name_rejected`` are
    views that each read one partition. It is bucketed by id, into as many buckets as a
    shuffle has partitions if ``n_buckets`` is not given, so that later loads join it in place.
    """
    check_method(method)
    n_buckets = n_buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in VECTOR_PASSAGE.fields)
    fields = ", ".join(f.name for f in VECTOR_PASSAGE.fields)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name}_rows ({columns}, reject_reason string, status string) "
        f"USING parquet PARTITIONED BY (status) CLUSTERED BY (id) SORTED BY (id) INTO {n_buckets} BUCKETS LOCATION '{path}'"
    )
    spark.sql(
        f"CREATE VIEW IF NOT EXISTS {name} AS SELECT {fields} FROM {name}_rows WHERE status = '{ACCEPTED}'"
    )
    spark.sql(
        f"CREATE VIEW IF NOT EXISTS {name}_rejected AS "
        f"SELECT {fields}, reject_reason FROM {name}_rows WHERE status = '{REJECTED}'"
    )


def append_passages(
    rows: DataFrame, name: str, dim: int = VECTOR_DIM, max_text: int = TEXT_MAX, mode: str = "skip_existing"
) -> dict[str, int]:
    """Append valid rows to ``name`` and the others to ``name_rejected``, in one pass.

    ``skip_existing`` leaves out ids the table has, so a repeated load changes
    nothing (an id rejected before may still be accepted later); ``append_all``
    adds every row again. Of rows of one load with the same id the first by title
    and text counts, the others are rejected as ``duplicate``. Columns that
    ``with_fate`` made before are used as they are. Rows are moved once, to the task that
    writes their bucket; duplicates and rows without id are spread over all tasks.
    Returns how many rows were ``accepted``, ``rejected``, and of these ``duplicate``, counted by the
    pass that writes them.
    """
    if mode not in ("skip_existing", "append_all"):
        raise ValueError(f"unknown mode: {mode!r}")
    if FATE[0] not in rows.columns:
        rows = with_fate(rows, name)
    typed = rows.select(*[F.col(f.name).cast(f.dataType) for f in VECTOR_PASSAGE.fields], *FATE)
    status = F.when(F.col("reject_reason").isNull(), ACCEPTED).otherwise(REJECTED)
    reason = F.coalesce(F.when(F.col("duplicate"), "duplicate"), reject_reason(dim, max_text))
    out = typed.withColumn("reject_reason", reason).withColumn("status", status)
    if mode == "skip_existing":
        out = out.where(~F.when(F.col("status") == ACCEPTED, F.col("held_accepted")).otherwise(F.col("held_rejected")))
    seen = Counters(
        accepted=F.count_if(F.col("status") == ACCEPTED), rejected=F.count_if(F.col("status") == REJECTED),
        duplicate=F.count_if(F.col("reject_reason") == "duplicate"),
    )
    out = seen.on(out)
    n = buckets(rows.sparkSession, name)
    spread = F.col("duplicate") | F.col("id").isNull()
    place = F.pmod(F.when(spread, F.hash("title", "text")).otherwise(F.hash("id")), F.lit(n))
    fields = [f.name for f in VECTOR_PASSAGE.fields]
    with counted(rows.sparkSession):
        out.repartition(n, place).select(*fields, "reject_reason", "status").write.mode("append").insertInto(f"{name}_rows")
    return seen.counts
