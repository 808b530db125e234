"""Session settings and the shared-storage helpers that iterative and multi-pass operators need."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast on purpose only up to this many rows; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def build(app: str = "folioscope", master: str = "local[*]", partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> None:
    """Make sure a checkpoint folder is set: the one in spark.checkpoint.dir, or a private one in local mode only."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="folioscope-checkpoint-")
    sc.setCheckpointDir(named)


def materialize(df: DataFrame) -> DataFrame:
    """Compute once into the shared checkpoint folder and cut the lineage; survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize_plain(df: DataFrame) -> DataFrame:
    """The same, without what the optimizer has inferred of the rows. Where a materialized table is united with others, inferred
    constraints that name columns it no longer has make the optimizer fail."""
    spark = df.sparkSession
    was = spark.conf.get("spark.sql.constraintPropagation.enabled")
    spark.conf.set("spark.sql.constraintPropagation.enabled", "false")
    try:
        return materialize(df)
    finally:
        spark.conf.set("spark.sql.constraintPropagation.enabled", was)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A materialized df, hinted for broadcast only if its counted rows stay under the bound."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
