"""Session settings, scratch locations and package shipping."""

from __future__ import annotations

import contextlib
import pathlib
import tempfile
import threading
import uuid
import zipfile

from pyspark.sql import SparkSession

_SHIPPED = set()
_MARKED = set()
_SCOPES = threading.local()


def build_session(app: str = "odqa_spark", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators are written for.

    On a cluster the master, memory and partition counts come from spark-submit;
    ``conf`` keys use ``__`` for dots (``spark__sql__shuffle__partitions=8``).
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    if master:
        b = b.master(master)
    for key, value in conf.items():
        b = b.config(key.replace("__", "."), value)
    session = b.getOrCreate()
    ship_package(session)
    return session


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only a local
    session without that setting gets a temporary folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="odqa-spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the application's part of the shared folder.

    That part is deleted when the application's JVM ends; what was made inside a
    ``scratch_scope`` goes when the scope ends.
    """
    root = f"{shared_dir(spark)}/odqa_spark/{spark.sparkContext.applicationId}"
    if root not in _MARKED:
        fs, path = hadoop_path(spark, root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _MARKED.add(root)
    made = f"{root}/{label}-{uuid.uuid4().hex}"
    for paths in getattr(_SCOPES, "open", ()):
        paths.append(made)
    return made


@contextlib.contextmanager
def scratch_scope(spark: SparkSession):
    """Deletes the scratch paths made inside, once what they were made for is written elsewhere."""
    paths: list[str] = []
    _SCOPES.open = [*getattr(_SCOPES, "open", ()), paths]
    try:
        yield
    finally:
        _SCOPES.open = _SCOPES.open[:-1]
        for made in paths:
            fs, path = hadoop_path(spark, made)
            fs.delete(path, True)


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings for what is planned or started inside; ``__`` stands for dots."""
    named = {key.replace("__", "."): value for key, value in values.items()}
    before = {key: spark.conf.get(key, None) for key in named}
    for key, value in named.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def hadoop_path(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path: for listing and deleting in any store Spark writes to."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def materialize(df, label: str):
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df):
    """Spread a small table over all cores before heavy row-local work.

    A table of few files gives few tasks. Only then are its rows shuffled; a scan
    with at least as many partitions as the cluster has cores is left alone, so
    this never moves a large table.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = pathlib.Path(__file__).resolve().parent
    target = pathlib.Path(tempfile.mkdtemp(prefix="odqa-zip-")) / "odqa_spark_pkg.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)
