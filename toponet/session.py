"""Session defaults and helpers that steer how Spark runs a plan."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str = "8", name: str = "toponet") -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shorten_plans(spark: SparkSession) -> None:
    """Cap the text form of plans: folding tables travel as literals, and adaptive
    execution would print them again after every stage."""
    spark.conf.set("spark.sql.maxPlanStringLength", "65536")


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns``, each computed once per row whatever reads them.

    Spark moves filters and join keys below a projection and computes its expressions again
    there, several times over for a chain of them. It doesn't move them below a generator.
    """
    made = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select("*", F.inline(F.array(made)))


def _checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only where no folder is configured (tests, local runs) is one created here.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
            "spark.checkpoint.dir"
        )
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder.

    Iterative jobs call this so that a lost executor re-reads files instead of
    replaying every round.
    """
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def snapshot(df: DataFrame) -> DataFrame:
    """As ``cut_lineage``, for tables of many rows: Parquet files, a fraction of a checkpoint's size.

    Readers take only the columns they use. How the rows were dealt out is not kept. Spark takes
    the files' size for that of the rows, a fraction of it, so joins are told not to broadcast them.
    """
    spark = df.sparkSession
    folder = f"{_checkpoint_folder(spark)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder).hint("merge")
