"""Session settings and the shared folder for cut lineage and scratch tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session for tests and benches; on a cluster use the one you are given."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tripchain")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Small inputs still use all cores.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one in local mode only."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tripchain-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Cut a plan's lineage: write it to the shared folder and go on from the table.

    Survives the loss of executors, and the planner knows the size of what it reads.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle_by(df: DataFrame, name: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """``settle`` in so many buckets of ``keys``: what is grouped or joined by them next needs no exchange.

    The catalog names the table only until it is resolved; the files stay like those of ``settle``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = os.path.basename(path).replace("-", "_")
    df.write.option("path", path).bucketBy(buckets, *keys).saveAsTable(table)
    kept = spark.table(table).select(*df.columns)
    spark.sql(f"DROP TABLE {table}")
    return kept
