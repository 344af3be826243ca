"""Reading the given tables, folds by checksum, and bounded label samples."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; 0 for a null key."""
    return F.coalesce(F.crc32(c(key).cast("string")) % parts, F.lit(0)).cast("int")


def label_sample(labels: DataFrame, label: str, parts: int, held: int, most: int) -> dict[int, int]:
    """{doc_id: label} of at most ``most`` labelled rows outside fold ``held``.

    The rows with the smallest hash of their id are taken, so a larger table
    gives an equally random sample. Null ids and labels are left out; of several
    labels of one id the largest counts.
    """
    rows = (
        labels.select(c("doc_id").cast("long").alias("doc_id"), c(label).cast("int").alias("label"))
        .filter(c("doc_id").isNotNull() & c("label").isNotNull() & (fold("doc_id", parts) != held))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    return {r.doc_id: r.label for r in rows.collect()}


def only_ids(docs: DataFrame, ids: list[int]) -> DataFrame:
    """Rows of a bounded sample of ids (the sample's size is a parameter), sent to every task."""
    wanted = docs.sparkSession.createDataFrame([(x,) for x in ids], "doc_id long")
    return docs.join(F.broadcast(wanted), "doc_id", "left_semi")


#: Spark removes an execution's shuffle files at its end where this is set.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, whose shuffle files are gone.

    For tables that several later steps read: a lost executor re-reads files, the rows are
    computed once, and they take less room than a checkpoint's. ``forget`` removes the table.
    """
    spark, folder = df.sparkSession, scratch_folder(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(folder)


def forget(*made: DataFrame | None) -> None:
    """Remove tables of ``written`` that nothing reads any more."""
    for df in made:
        for file in df.inputFiles()[:1] if df is not None else []:
            spark = df.sparkSession
            jvm, conf = spark._jvm, spark._jsc.sc().hadoopConfiguration()
            path = jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(conf).delete(path, True)


_lent: list[Broadcast] = []


def lend(spark: SparkSession, value) -> Broadcast:
    """``value`` for all tasks, until ``take_back``."""
    _lent.append(spark.sparkContext.broadcast(value))
    return _lent[-1]


def take_back() -> None:
    """Executors let go of what was lent; a task that still needs some of it fetches it again."""
    while _lent:
        _lent.pop().unpersist()


def _tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What earlier tasks left in this worker goes: cached tables, encoders, pooled memory."""
    from . import packing, words

    words._tables.clear()
    packing._encoders.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)
    for _ in batches:
        yield from ()


def tidy_workers(spark: SparkSession) -> None:
    """Python workers live on from stage to stage; a few short tasks on each let go of what they hold."""
    n = 4 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).mapInArrow(_tidy, "id long").count()


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Python workers get texts in batches of this many rows at most, so that long ones don't pile up."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder of ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
