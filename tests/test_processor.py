"""The keyed state processor equals the batch merge, over batches, partitions and restarts."""

import os

import pytest
from pyspark.sql import functions as F

from matchflow.plans.queries import merged_matches
from matchflow.sources import fixtures as fx
from matchflow.sources import topics
from matchflow.streaming import processor
from tests.conftest import SF_SMALL

ONCE = {"availableNow": True}


@pytest.mark.parametrize("files", [1, 3, 9])
def test_state_processor_equals_batch(spark, scratch, files):
    recs = fx.match_topic(spark, SF_SMALL).select((F.col("offset") % 2).cast("int").alias("partition"), "offset", "timestamp",
                                                  F.col("value").cast("string").alias("value"))
    halves = [recs.where(F.pmod(F.xxhash64("offset"), F.lit(2)) == i) for i in (0, 1)]
    want = merged_matches(spark, SF_SMALL)
    for half in halves:  # the second run goes on from the first's checkpoint
        topics.write_dir_topic(half.repartition(files), os.path.join(scratch, "topics"), "matchs")
        processor.start_processor(spark, os.path.join(scratch, "topics"), os.path.join(scratch, "ck"), ONCE, max_files_per_trigger=3).awaitTermination()
    got = processor.read_processor_state(spark, os.path.join(scratch, "ck"))
    assert got.count() == want.count()
    assert got.select(*want.columns).exceptAll(want).count() == 0


def test_matches_of_a_block_share_a_state_and_keep_their_own_cells(spark, scratch):
    import json
    full = {"sport_id": 1, "sport_nom": "F", "lieu": "L", "statut": "programmé"}

    def send(*rows):
        df = spark.createDataFrame([(0, o, f"2024-01-01 00:00:{s:02d}", json.dumps(m)) for o, s, m in rows], "partition int, offset long, t string, value string")
        topics.write_dir_topic(df.selectExpr("partition", "offset", "CAST(t AS TIMESTAMP) AS timestamp", "value"), os.path.join(scratch, "topics"), "matchs")
        processor.start_processor(spark, os.path.join(scratch, "topics"), os.path.join(scratch, "ck"), ONCE).awaitTermination()
    send(*[(i, 1, dict(full, match_id=i)) for i in range(1, 1 << processor.BLOCK_BITS)], (90, 1, {"match_id": -1, "statut": "en cours"}))
    send((100, 2, {"match_id": 3, "statut": "terminé"}), (101, 2, dict(full, match_id=1000)), (102, 2, {"match_id": -1, "score_domicile": 4}))
    states = spark.read.format("statestore").option("path", os.path.join(scratch, "ck", "state_processor")).option("stateVarName", "cells").load()
    assert states.count() == 3  # blocks
    got = {r.match_id: r for r in processor.read_processor_state(spark, os.path.join(scratch, "ck")).collect()}
    assert set(got) == {-1, 1000, *range(1, 1 << processor.BLOCK_BITS)}
    assert [got[i].statut for i in (2, 3, 1000, -1)] == ["programmé", "terminé", "programmé", "en cours"]
    assert (got[3].lieu, got[3].first_offset, got[3].last_offset, got[-1].score_domicile) == ("L", 3, 100, 4)
