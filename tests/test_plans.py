"""Plan checks: pushdown, pruning, scans, join strategies."""

import os

from pyspark.sql import functions as F

from matchflow.operators import decode, marts, serve
from matchflow.sources import fixtures as fx, sinks
from matchflow.sources.tables import read_table
from tests.conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_prunes_columns_and_pushes_filters(spark):
    df = read_table(spark, SF_SMALL, "orders", "o_orderkey", "o_orderstatus").where("o_orderstatus = 'F'")
    p = _plan(df)
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in p


def test_team_totals_scans_orders_once(spark):
    df = marts.team_totals(fx.match_log(spark, SF_SMALL))
    df.collect()  # AQE settles the final plan (exchange reuse happens per stage)
    p = df._jdf.queryExecution().executedPlan().toString()
    p = p.split("== Final Plan ==")[1].split("== Initial Plan ==")[0]
    lines = p.splitlines()
    shared = [l for l in lines if "Exchange hashpartitioning(sport_id" in l and "equipe" in l
              and "ReusedExchange" not in l and "total_matchs" not in l]
    reused = [l for l in lines if "ReusedExchange" in l and "sum" in l]
    scans = [l for l in lines if "FileScan parquet" in l and "o_orderkey" in l]
    assert len(shared) == 1 and len(reused) >= 1 and len(scans) == 1, p


def test_search_prunes_partitions(spark, scratch):
    m = fx.matchs(spark, SF_SMALL)
    cur = decode.curate_matches(m.withColumn("date_match", F.date_format("date_match", "yyyy-MM-dd HH:mm:ss")))
    path = os.path.join(scratch, "matchs")
    sinks.write_partitioned(cur, path, 0)
    t = spark.read.parquet(path)
    q = serve.match_search(t, date_debut="1996-01-01", date_fin="1996-12-31",
                           partition_cols=("year", "month", "day"))
    p = _plan(q)
    assert "PartitionFilters: [" in p and "year" in p.split("PartitionFilters: [")[1].split("]")[0]
    want = serve.match_search(cur, date_debut="1996-01-01", date_fin="1996-12-31")
    assert q.count() == want.count()


def test_decode_parses_once(spark):
    recs = fx.match_topic(spark, SF_SMALL)
    valid, _ = decode.split_valid(decode.decode_json(recs, __import__("matchflow.schemas", fromlist=["MATCH"]).MATCH),
                                  "match_id", nonzero=True)
    p = _plan(valid)
    assert p.count("from_json(") == 1


def test_compaction_keeps_rows_and_cuts_files(spark, scratch):
    import glob
    m = fx.matchs(spark, SF_SMALL)
    cur = decode.curate_matches(m.withColumn("date_match", F.date_format("date_match", "yyyy-MM-dd HH:mm:ss")))
    src, dst = os.path.join(scratch, "small"), os.path.join(scratch, "compact")
    cur.repartition(16).write.partitionBy("year").parquet(src)
    sinks.compact(spark, src, dst, ["year"])
    n_src = len(glob.glob(src + "/year=*/*.parquet"))
    n_dst = len(glob.glob(dst + "/year=*/*.parquet"))
    assert spark.read.parquet(dst).count() == cur.count()
    assert n_dst == len(glob.glob(dst + "/year=*")) < n_src


def test_partitioned_write_rebalances(spark, scratch):
    m = fx.matchs(spark, SF_SMALL)
    cur = decode.curate_matches(m.withColumn("date_match", F.date_format("date_match", "yyyy-MM-dd HH:mm:ss")))
    path = os.path.join(scratch, "detail")
    sinks.write_partitioned(cur, path, 0)
    plan = cur.hint("rebalance", "year", "month", "day")._jdf.queryExecution().executedPlan().toString()
    assert "REBALANCE_PARTITIONS_BY_COL" in plan
    assert spark.read.parquet(path).count() == cur.count()
