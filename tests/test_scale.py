"""Heavy keys, distinct sketches, undeclared fields, observed sizes, clustered compaction."""

import glob
import json
import os
import statistics

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from matchflow.operators import marts, notify, serve, sketches, skew
from matchflow.sources import feed, sinks
from matchflow.sources import fixtures as fx
from tests.conftest import SF_SMALL


@pytest.fixture()
def plain(spark):
    """What AQE and broadcasts do at run time is out of the way."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    for k, v in zip(old, ("false", "-1", "16")):
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def notes(spark, n, hot):
    i = F.col("id")
    return spark.range(n).select(i.alias("notification_id"), (i % 77).alias("user_id"), F.when(i % 2 == 0, hot).otherwise(i % 5000).alias("match_id"),
                                 F.lit("but").alias("type"), F.lit("lue").alias("statut"))


def test_half_of_all_rows_in_one_match(spark, plain):
    n = notes(spark, 60_000, 7).unionByName(notes(spark, 10, 7).withColumn("match_id", F.lit(None).cast("long")))
    m = spark.range(4000).select(F.col("id").alias("match_id"), (F.col("id") % 5).cast("int").alias("sport_id"), F.lit("x").alias("sport_nom"))
    got = notify.notification_enriched(n, m)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 60_010 and max(sizes) < 2 * statistics.median(sizes)
    want = n.join(m, "match_id", "left").select("notification_id", "match_id", "sport_id", "sport_nom")
    assert got.select(*want.columns).exceptAll(want).count() == 0 and want.exceptAll(got.select(*want.columns)).count() == 0
    assert [r.match_id for r in skew.heavy_keys(n, "match_id", 16).collect()] == [7]
    assert notify.notification_enriched(n.limit(0), m).count() == 0
    assert notify.notification_enriched(n, m.limit(0)).where("sport_id IS NULL").count() == 60_010


def test_sketches_merge_over_batches(spark, scratch):
    path = os.path.join(scratch, "s")
    n = fx.notifications(spark, SF_SMALL)
    for b in (0, 1, 2, 1):  # one is run again
        sketches.write_sketches(n.where(F.col("notification_id") % 3 == b), path, b)
    got, want = sketches.read_distinct(spark, path), marts.stats_notifications(n)
    assert got.select(*want.columns).exceptAll(want).count() == 0 and got.count() == want.count()
    day = n.where("date_envoi >= '2024-01-03' AND date_envoi < '2024-01-04'")
    got, want = sketches.read_distinct(spark, path, first="2024-01-03", last="2024-01-03"), marts.stats_notifications(day)
    assert got.select(*want.columns).exceptAll(want).count() == 0 and got.count() == want.count()


@pytest.mark.parametrize("distinct", [sketches.EXACT // 2, 300_000])
def test_sketch_error(spark, scratch, distinct):
    path = os.path.join(scratch, "s")
    for b in range(3):
        sketches.write_sketches(spark.range(distinct).withColumn("id", F.col("id") + b * distinct // 4).select(
            F.lit("but").alias("type"), F.col("id").alias("user_id"), (F.col("id") % 9).alias("match_id"), F.lit("2024-01-01 00:00:00").alias("date_envoi")), path, b)
    r = sketches.read_distinct(spark, path).first()
    real = distinct + 2 * distinct // 4
    assert r.nombre_matchs_distincts == 9 and r.nombre_notifications == 3 * distinct
    if real < sketches.EXACT:
        assert r.nombre_utilisateurs_distincts == real
    else:
        assert abs(r.nombre_utilisateurs_distincts - real) < 0.02 * real


def test_variant_feed_survives_odd_documents(spark):
    item = {"utcDate": "2024-01-01T10:00:00Z", "status": "FINISHED", "venue": "V", "homeTeam": {"name": "A", "crest": "x.png"}, "awayTeam": {"name": "B"},
            "score": {"fullTime": {"home": 2, "away": 1}, "duration": "REGULAR"}, "odds": {"msg": [1, 2]}}
    docs = [{"matches": [item, {}, {"score": "none", "homeTeam": 5, "utcDate": None}, 7], "count": 4}, {"other": 1}, {"matches": "no"}]
    rows = [(i, 1000 + 100 * i, json.dumps(d)) for i, d in enumerate(docs)] + [(3, 1300, "not json"), (4, 1400, None)]
    v = feed.feed_variants(spark.createDataFrame(rows, "doc_id long, id_base long, doc string"))
    got = {r.match_id: r for r in feed.normalize_variants(v).collect()}
    assert set(got) == {1000, 1001, 1002, 1003}
    assert (got[1000].equipe_domicile, got[1000].score_domicile, got[1000].statut) == ("A", 2, "terminé")
    assert (got[1001].equipe_domicile, got[1001].score_domicile, got[1002].equipe_exterieur) == ("", 0, "")
    shape = feed.feed_schema(v.where("match_id < 1002")).first()
    assert shape.matches == 2 and "odds" in shape["shape"] and "crest" in shape["shape"]


def test_observed_sizes(spark, scratch):
    from matchflow.streaming import ingest
    from tests.test_buckets import FULL, records
    store = ingest.bucket_store(spark, scratch, "matchs", buckets=4)
    store.apply(records(spark, [(0, i, 1, dict(FULL, match_id=i)) for i in range(1, 30)]), 0, "a")
    store.apply(records(spark, [(0, 99, 2, dict(FULL, match_id=40)), (0, 98, 2, {"match_id": 5, "statut": "terminé"})]), 1, "a")
    store.remove(spark.createDataFrame([(5,), (6,), (777,)], "match_id long"))
    assert [tuple(r)[:3] for r in store.sizes().orderBy("v").collect()] == [(29, 0, 0), (1, 1, 0), (0, 0, 2)]
    assert store.sizes().agg(F.sum(F.col("inserted") - F.col("removed"))).first()[0] == store.read().count() == 28


def test_threshold_probe_stops_at_one_row(spark):
    p = spark.createDataFrame([(1, 10.0), (2, 2500.0)], "produit_id int, prix double")
    assert serve.reaches(p) and not serve.reaches(p.where("prix < 100")) and not serve.reaches(p.limit(0))


def test_clustered_compaction_rules_out_files(spark, scratch):
    src, flat, dst = (os.path.join(scratch, x) for x in ("src", "flat", "dst"))
    m = fx.matchs(spark, "/root/testdata/sf0.01").withColumn("date_match", F.col("date_match").cast("timestamp"))
    m.repartition(24).write.parquet(src)
    m.repartition(24).write.parquet(flat)
    sinks.compact_clustered(spark, src, dst, ["sport_id", "statut", "date_match"], 24)
    assert spark.read.parquet(dst).exceptAll(spark.read.parquet(src)).count() == 0 and spark.read.parquet(dst).count() == m.count()

    def groups(path, ask):
        n = 0
        for f in glob.glob(f"{path}/*.parquet"):
            meta = pq.ParquetFile(f).metadata
            for g in range(meta.num_row_groups):
                stats = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c).statistics for c in range(meta.num_columns)}
                n += all(s is None or not s.has_min_max or (s.min <= hi and s.max >= lo) for c, (lo, hi) in ask.items() for s in (stats[c],))
        return n
    import datetime
    days = (datetime.datetime(1996, 1, 1, tzinfo=datetime.UTC), datetime.datetime(1996, 6, 30, tzinfo=datetime.UTC))
    for ask in ({"sport_id": (2, 2)}, {"statut": ("terminé", "terminé")}, {"date_match": days}, {"sport_id": (2, 2), "statut": ("terminé", "terminé"), "date_match": days}):
        assert groups(flat, ask) == 24 and groups(dst, ask) <= (17 if len(ask) == 1 else 6), (ask, groups(dst, ask))
    search = dict(sport_id=2, statut="terminé", date_debut="1996-01-01", date_fin="1996-06-30")
    a, b = (serve.match_search(spark.read.parquet(x), **search) for x in (flat, dst))
    assert a.count() == b.count() > 0 and a.exceptAll(b).count() == 0
