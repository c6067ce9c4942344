"""Distinct counts over batches (A5, A2): stored theta sketches per day and type.

Each batch adds a row per (day, type): a count and, for users and matches, a sketch of the ids seen.
Sketches of any batches, days or types merge on read, so a report over a month reads a few rows
per batch instead of its notifications. Below ``EXACT`` distinct ids a merged sketch is exact; above,
its standard error is 1 / sqrt(EXACT), 0.8 per cent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchflow.functions.scalars import parse_ts_ntz
from matchflow.sources import sinks

LG_EXACT = 14
EXACT = 1 << LG_EXACT


def sketch_notifications(notes: DataFrame) -> DataFrame:
    """(jour, type, nombre, utilisateurs, matchs): sketches of one batch's notifications. Null ids
    aren't counted; an unparsable date is the null day."""
    day = F.to_date(parse_ts_ntz("date_envoi")).alias("jour")
    return notes.groupBy(day, "type").agg(F.count(F.lit(1)).alias("nombre"), F.theta_sketch_agg("user_id", LG_EXACT).alias("utilisateurs"),
                                          F.theta_sketch_agg("match_id", LG_EXACT).alias("matchs"))


def write_sketches(notes: DataFrame, path: str, batch_id: int) -> None:
    sinks.write_batch(sketch_notifications(notes), path, batch_id)


def read_distinct(spark: SparkSession, path: str, by: tuple[str, ...] = ("type",), first: str | None = None, last: str | None = None) -> DataFrame:
    """Counts and distinct counts merged over all batches, by any of jour and type, of the days
    from ``first`` to ``last``."""
    rows = spark.read.parquet(path)
    if first:
        rows = rows.where(F.col("jour") >= F.lit(first).cast("date"))
    if last:
        rows = rows.where(F.col("jour") <= F.lit(last).cast("date"))
    merged = lambda c: F.theta_sketch_estimate(F.theta_union_agg(c, LG_EXACT))
    return rows.groupBy(*by).agg(F.sum("nombre").alias("nombre_notifications"), merged("utilisateurs").alias("nombre_utilisateurs_distincts"),
                                 merged("matchs").alias("nombre_matchs_distincts"))
