"""Shared plumbing: the cluster's shared folder, written tables, connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ROWS_A_TASK = 20_000
_LOCAL_FALLBACK: dict[str, str] = {}
_OWN: dict[str, tuple] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir`` of the session.

    Only a local master without that setting gets a temporary folder of its own.
    """
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FALLBACK:
        _LOCAL_FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="quillchain-")
    return _LOCAL_FALLBACK[app]


def _own_folder(spark: SparkSession) -> str:
    """This application's folder; what is left in it goes when the application ends."""
    folder = f"{shared_dir(spark)}/quillchain/{spark.sparkContext.applicationId}"
    if folder not in _OWN:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        _OWN[folder] = path, path.getFileSystem(spark._jsc.hadoopConfiguration())
        atexit.register(_remove, folder)
    return folder


def _remove(folder: str) -> None:
    path, fs = _OWN[folder]
    try:
        fs.delete(path, True)
    except (Py4JError, OSError):
        pass  # the JVM ended first


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, codec: str = "zstd", rows: int | None = None, per_file: int = ROWS_A_TASK) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends here,
    and a lost executor costs only a re-read.  Spark drops the job's shuffle files as soon
    as the table is there.  ``rows``, if about known, sizes the tasks that write it: small
    tables get few files, large ones as many as the session deals out."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, label)
    if rows is not None:
        most = int(spark.conf.get("spark.sql.shuffle.partitions"))
        df = df.coalesce(n) if (n := 1 + rows // per_file) < most else df
    with settings(spark, **{CLEANUP: "true"}):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings (dots written as __) that hold inside the block."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    old = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def slim_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Bounds the bytes of an Arrow batch for this session, unless it has a bound already:
    by default only rows are counted, and 10,000 long texts are too much for a worker."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, "-1", "64MB", str(64 << 20)):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def clear(spark: SparkSession) -> None:
    """Deletes every table that this application's operators have written, once their
    results have been consumed: results that are still lazy read some of them."""
    _remove(_own_folder(spark))


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables made by ``written`` that no later step reads."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b") % 1000003)).first()
    return tuple(row)


def connected_components(edges: DataFrame, label: str = "cc", rows: int | None = None) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b); root is the least node.

    Alternating large-star and small-star rounds over an edge table.  Each is a partial
    aggregation, whose result is stored, and an equi-join of two plain tables, so adaptive
    execution can split a hot centre.  Rounds grow with the logarithm of the component
    size.  Nulls and self-loops are ignored; the driver sees three numbers a round.
    ``rows`` is about the number of edges, if known.
    """
    spark = edges.sparkSession
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = written(e, label, rows=rows)
    seen = _fingerprint(e)
    while seen[0]:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        least = written(least, f"{label}-least", rows=seen[0])
        large = both.join(least.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, f"{label}-large", rows=seen[0])
        down = written(large.groupBy("a").agg(F.min("b").alias("m")), f"{label}-down", rows=seen[0])
        joined = large.join(down.hint("merge"), "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", F.col("m").alias("b")))
        small = small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        old, e = e, written(small, label, rows=seen[0])
        now = _fingerprint(e)
        discard(spark, old, least, large, down)
        if now == seen:
            break
        seen = now
    roots = e.groupBy("a").agg(F.min("b").alias("root"))
    return roots.select(F.col("a").alias("node"), "root").union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
