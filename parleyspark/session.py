"""Session construction and cluster settings."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "parleyspark", master: str | None = None, **conf) -> SparkSession:
    """Session with the settings every job here relies on.

    UTC keeps day buckets stable, AQE re-plans skewed joins and coalesces
    small shuffles, and RocksDB keeps streaming state off the heap.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster. In local mode a fresh one if it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="parley-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def cut_lineage(df: DataFrame) -> DataFrame:
    """Compute once and keep the result in the shared checkpoint folder.

    Used for narrow results that several steps read, such as indices derived
    from whole texts. A lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_root(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write df once to a folder of its own under the shared checkpoint folder and read it back.

    For values that a second run of the plan could give otherwise, such as partition numbers.
    """
    path = f"{checkpoint_root(df.sparkSession).rstrip('/')}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """Rebalance a scan that has fewer splits than the cluster has cores.

    Text work is CPU-bound, so a table in one row group would run on one core.
    A table with enough splits is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def computed_once(df: DataFrame, **columns) -> DataFrame:
    """Add columns that later filters and projections read but never recompute.

    A filter on a plain computed column is pushed below its projection, which
    evaluates the expression again for every use. Values that leave a generator
    stay values. No shuffle and no extra row is involved.
    """
    held = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return df.select("*", F.explode_outer(held).alias("_held")).select(*df.columns, "_held.*")
