"""Joins whose left side has a few keys that hold a large share of its rows.

A mergeable frequency sketch finds the heavy keys in one pass over the key column: its partial
sketches are built in the scan's tasks and merged, at most ``tracked`` items each. A heavy key's
rows are dealt into as many parts as its share asks for and the right side's row is copied into
each of them; all other keys are joined as they are. That doesn't depend on how partitions
come out at run time, and a heavy key's rows never meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that can be told heavy, and items that the sketch tracks.
HEAVY, TRACKED = 100, 10_000
#: A heavy key's parts are to a fair share of the rows as 1 to this, so that they even out.
FINER = 4


def heavy_keys(df: DataFrame, key: str, parts: int, heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """(key, copies): the keys that hold more than a FINERth of a part's fair share of the rows, and
    the parts that each is to be dealt into. At most ``heavy`` rows, worked out as a part of the plan."""
    found = df.where(F.col(key).isNotNull()).agg(F.count(F.lit(1)).alias("_all"), F.expr(f"approx_top_k(`{key}`, {heavy}, {tracked})").alias("_top"))
    share = F.col("_top.count") * FINER * parts / F.col("_all")
    return found.select("_all", F.explode("_top").alias("_top")) \
        .select(F.col("_top.item").alias(key), F.ceil(share).cast("int").alias("copies")).where("copies > 1")


def salted_left_join(left: DataFrame, right: DataFrame, key: str, spread: str, parts: int | None = None) -> DataFrame:
    """``left.join(right, key, "left")`` with heavy keys of ``left`` dealt by a hash of ``spread``.
    The table of heavy keys is broadcast (at most HEAVY rows). Rows without a key join nothing."""
    parts = parts or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = heavy_keys(left, key, parts)
    dealt = left.join(F.broadcast(hot), key, "left").withColumn("_salt", F.when(F.col("copies").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.col("copies"))).cast("int"))
    copied = right.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)))
    return dealt.drop("copies").join(copied.drop("copies"), [key, "_salt"], "left").drop("_salt")
