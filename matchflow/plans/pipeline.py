"""Daily batch chain (Y2) and branch decisions.

``run_pipeline`` is the load -> process -> report chain as one function:
decode and validate the match topic, write the curated table partitioned by
year/month/day, write the quarantine, the merged state and the statistics
snapshots. Intermediate results are written tables (no driver loops), so a
lost executor only re-runs the stage it was in.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchflow.operators import decode, marts, state
from matchflow.schemas import MATCH
from matchflow.sources import sinks

GENERATE, SKIP = "generate_matchs", "skip_generation"


def generation_branch(matches: DataFrame, threshold: int) -> DataFrame:
    """Generate new matches while the table holds fewer than ``threshold``."""
    return matches.agg(F.count(F.lit(1)).alias("nombre_matchs")).select(
        "nombre_matchs",
        F.when(F.col("nombre_matchs") < threshold, F.lit(GENERATE)).otherwise(F.lit(SKIP))
         .alias("branche"))


def next_state(spark: SparkSession, valid: DataFrame, root: str, batch_id: int) -> DataFrame:
    """The merged state after this batch, with the cells it stands for (``_cells``): the
    previous version's cells and the batch's combine by (timestamp, partition, offset),
    so keys that the batch doesn't touch stay, its partial records update what they
    carry, and a row of another partition, or a late one, takes its place in the log's
    order. A re-run of the batch starts from the same version (the newest below ``batch_id``)."""
    fold = state.folding("matchs")
    cells = fold.cells(valid)
    path = sinks.latest_snapshot_path(spark, root, before=batch_id)
    if path is not None:
        cells = state.combine_cells(cells.unionByName(spark.read.parquet(path).select(fold.key, "_cells.*")), fold.key)
    return cells.select(*fold.columns(cells.schema), F.struct(*[c for c in cells.columns if c != fold.key]).alias("_cells"))


def run_pipeline(spark: SparkSession, records: DataFrame, out_root: str,
                 batch_id: int = 0) -> dict[str, str]:
    """Y2: decode -> validate -> curated partitioned table + quarantine ->
    merged state -> statistics snapshots keyed by ``batch_id``.

    Returns the paths written. Re-running the same ``batch_id`` overwrites
    that batch's output, so retries never duplicate rows.
    """
    dec = decode.decode_json(records, MATCH, keep_raw=True)
    tagged = decode.classify(dec, "match_id", nonzero=True).persist()
    try:
        valid = tagged.where(F.col(decode.REASON).isNull()).drop(decode.REASON, decode.RAW)
        bad = tagged.where(F.col(decode.REASON).isNotNull()).select(
            decode.OFFSET, decode.RAW, decode.REASON)
        paths = {k: os.path.join(out_root, k) for k in
                 ("matchs", "quarantine", "state", "stats_matchs_par_sport")}
        curated = decode.curate_matches(valid.drop(decode.KEYS))
        sinks.write_partitioned(curated, paths["matchs"], batch_id)
        sinks.write_batch(bad, paths["quarantine"], batch_id)
        sinks.write_batch(marts.matches_per_sport(valid), paths["stats_matchs_par_sport"], batch_id,
                          stamp=True)
        sinks.write_snapshot(next_state(spark, valid, paths["state"], batch_id), paths["state"], batch_id)
        return paths
    finally:
        tagged.unpersist()
