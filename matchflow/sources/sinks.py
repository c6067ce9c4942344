"""Table sinks (S6-S9), idempotent per batch.

Every write is keyed by a ``batch_id`` directory, written with dynamic
partition overwrite: re-running a batch (after a failure, or a streaming
retry of the same epoch) replaces that batch's files instead of appending a
second copy.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _overwrite_partitions(df: DataFrame, path: str, partition_cols: list[str]) -> None:
    (df.write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic")
       .partitionBy(*partition_cols).parquet(path))


def write_partitioned(curated: DataFrame, path: str, batch_id: int,
                      cols: tuple[str, ...] = ("year", "month", "day")) -> None:
    """Detail table partitioned by year/month/day of ``date_match``.

    ``rebalance`` clusters rows by the partition columns (few files per
    directory, no small-file explosion) while AQE splits a hot day -- one day
    may hold a third of the rows -- over several tasks instead of one, and
    merges small ones. Rows with a null date land in the default (null)
    partition."""
    df = curated.withColumn("batch_id", F.lit(batch_id)).hint("rebalance", *cols)
    _overwrite_partitions(df, path, ["batch_id", *cols])


def write_batch(df: DataFrame, path: str, batch_id: int, stamp: bool = False, by: tuple[str, ...] = ()) -> None:
    """Append-style table, idempotent per batch; ``stamp`` adds the
    processing time like the source's statistics snapshots; ``by`` are columns
    whose folders come before the batch's."""
    out = df.withColumn("batch_id", F.lit(batch_id))
    if stamp:
        out = out.withColumn("processed_time", F.current_timestamp())
    _overwrite_partitions(out, path, [*by, "batch_id"])


def write_snapshot(state: DataFrame, root: str, batch_id: int) -> str:
    """Versioned state snapshot: ``root/v=<batch_id>``; readers take the
    highest complete version. Plain parquet has no MERGE, so each batch
    writes the new full state next to the old one."""
    path = os.path.join(root, f"v={batch_id}")
    state.write.mode("overwrite").parquet(path)
    return path


def latest_snapshot_path(spark, root: str, before: int | None = None) -> str | None:
    """Path of the highest complete snapshot version under ``root`` (only
    versions below ``before`` when given)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(conf)
    if not fs.exists(p):
        return None
    best = None
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if name.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            v = int(name[2:])
            if before is not None and v >= before:
                continue
            best = v if best is None or v > best else best
    return None if best is None else os.path.join(root, f"v={best}")


def children(spark, root: str, prefix: str, complete: bool = False) -> list[str]:
    """What follows ``prefix`` in the names of a folder's children (``complete``: only of those that
    a writer has finished)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    found = [st.getPath() for st in fs.listStatus(p) if st.getPath().getName().startswith(prefix)]
    return [x.getName()[len(prefix):] for x in found if not complete or fs.exists(jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]


def modified(spark, path: str) -> int:
    """When a folder was last written to, in milliseconds."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getFileStatus(p).getModificationTime() if fs.exists(p) else 0


def delete(spark, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def compact(spark, src: str, dst: str, partition_cols: list[str] | tuple[str, ...] = ()) -> None:
    """Compaction job for small files (one file per trigger and task adds up):
    rewrite ``src`` into ``dst`` with files of about the advisory partition
    size (``spark.sql.adaptive.advisoryPartitionSizeInBytes``). ``rebalance``
    keeps each directory's rows together, merges small directories' rows
    into few files and splits a hot directory over several tasks."""
    df = spark.read.parquet(src).hint("rebalance", *partition_cols)
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_cols) if partition_cols else w).parquet(dst)


def _image(df: DataFrame, c: str):
    """A number that sorts like the column (text by its first six bytes)."""
    kind = df.schema[c].dataType.typeName()
    if kind == "string":
        return F.conv(F.rpad(F.substring(F.hex(F.col(c)), 1, 12), 12, "0"), 16, 10).cast("double")
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return F.unix_micros(F.col(c).cast("timestamp")).cast("double")
    return F.col(c).cast("double")


def _rank(image, edges: list[float]):
    """How many of the edges are not above a column's value."""
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda edge: edge <= image))


def z_value(df: DataFrame, cols: list[str] | tuple[str, ...], bits: int = 5):
    """A column that interleaves the bits of each column's rank among ``2 ** bits`` quantile
    ranges, so that neighbours in any one of the columns lie near each other. Bounds come from
    one aggregate (2 ** bits - 1 numbers a column); nulls rank first."""
    cuts = [i / (1 << bits) for i in range(1, 1 << bits)]
    bounds = df.agg(*[F.percentile_approx(_image(df, c), cuts, 1000).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    z = F.lit(0).cast("long")
    for i, c in enumerate(cols):
        image = _image(df, c)
        edges = sorted(set(bounds[i] or []))
        # few different values are spread over all the bits, so that each column has its say in the high ones
        rank = F.floor(_rank(image, edges or [0.0]) * (1 << bits) / (len(edges) + 1)).cast("int")
        rank = F.when(image.isNull() | F.lit(not edges), F.lit(0)).otherwise(rank)
        for b in range(bits):
            z = z.bitwiseOR(F.shiftleft(F.shiftright(rank, b).bitwiseAND(F.lit(1)).cast("long"), b * len(cols) + i))
    return z


def compact_clustered(spark, src: str, dst: str, cols: list[str] | tuple[str, ...], files: int) -> None:
    """Compaction along a space-filling curve (F3): ``src`` rewritten into about ``files`` files, each a
    stretch of the z-order of ``cols``, so that the files' and row groups' statistics rule most of
    them out for a search on any of the columns. Ranges are sampled, not one file per value: a hot
    value is cut by the other columns. Timestamps are written as microseconds, for which
    Parquet keeps statistics (it keeps none for Spark's default of 96 bits)."""
    session = spark.newSession()
    session.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")
    session.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    df = session.read.parquet(src)
    df.withColumn("_z", z_value(df, cols)).repartitionByRange(files, "_z", *cols).sortWithinPartitions("_z", *cols).drop("_z") \
        .write.mode("overwrite").parquet(dst)


def create_parquet_table(spark, name: str, location: str | None = None) -> None:
    """The robust_test example table as a parquet data-source table."""
    loc = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (id INT, value STRING, load_ts TIMESTAMP) "
              f"USING parquet{loc}")
