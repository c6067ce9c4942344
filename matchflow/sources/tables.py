"""Reading the driver's parquet tables.

Every read selects only the columns the caller needs, so Catalyst prunes the
parquet scan (``ReadSchema``) and pushes filters into it.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

DEFAULT_SF_DIR = "/root/testdata/sf0.01"


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str, *cols: str,
               spread: bool = False) -> DataFrame:
    """Read one driver table, projected to ``cols`` (all columns when empty).

    ``spread`` makes sure the scan feeds at least ``defaultParallelism``
    tasks: a file written as a single row group is one split, and a narrow
    pipeline downstream of it (JSON work, explodes, a broadcast join's
    output) would otherwise run in one task. It is for the *streamed* root
    of such pipelines only -- a side that is broadcast or shuffled by a join
    or aggregate is spread by that exchange anyway. On a cluster, where a
    large table has thousands of splits, it is a no-op.
    """
    df = spark.read.parquet(table_path(sf_dir, name))
    df = df.select(*cols) if cols else df
    return ensure_parallelism(df) if spread else df


def ensure_parallelism(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin repartition when ``df`` has fewer partitions than the cluster
    has cores. Retries stay deterministic (Spark sorts before a round-robin
    repartition)."""
    if df.isStreaming:
        return df
    want = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df
