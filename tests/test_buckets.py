"""State in buckets: copy-on-write, commits, deltas, change feed, lookups."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from matchflow.operators import decode, marts, state
from matchflow.plans.queries import merged_matches
from matchflow.schemas import MATCH
from matchflow.sources import fixtures as fx
from matchflow.sources import topics
from matchflow.streaming import buckets, ingest
from tests.conftest import SF_SMALL
from tests.test_state import FULL

ONCE = {"availableNow": True}


def records(spark, msgs):
    """(partition, offset, second, dict)"""
    rows = [(p, o, f"2024-01-01 00:00:{s:02d}", json.dumps(m)) for p, o, s, m in msgs]
    df = spark.createDataFrame(rows, "partition int, offset long, ts string, value string")
    return decode.decode_json(df.withColumn("timestamp", F.col("ts").cast("timestamp")).drop("ts"), MATCH)


def same(a, b, cols):
    return a.select(*cols).exceptAll(b.select(*cols)).count() == 0 and a.count() == b.count()


def data_files(root):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{root}/data/**/*.parquet", recursive=True)}


def topic_parts(spark, parts):
    """The decoded topic dealt into batches across its order."""
    dec = decode.decode_json(fx.match_topic(spark, SF_SMALL), MATCH).where(state.valid_key("match_id"))
    return [dec.where(F.pmod(F.xxhash64("_offset"), F.lit(parts)) == i) for i in range(parts)]


def test_batches_touch_their_buckets_only_and_retries_change_nothing(spark, scratch):
    store = ingest.bucket_store(spark, scratch, "matchs", buckets=16)
    for i, part in enumerate(topic_parts(spark, 3)):
        store.apply(part, i, "a")
    want = merged_matches(spark, SF_SMALL)
    assert same(store.read(), want, want.columns)
    files, manifest = data_files(store.root), store.version()
    one = records(spark, [(0, 10**9, 5, {"match_id": 10**9 + 1, "statut": "terminé"})])
    v = store.apply(one, 3, "a")
    assert v.number == 3 and sum(n == 3 for n in v.holds.values()) == 1 and v.run == "a" and v.batch == 3
    assert {p: t for p, t in data_files(store.root).items() if "/v=3/" not in p} == files
    assert {b: n for b, n in v.holds.items() if n != 3}.items() <= manifest.holds.items()
    assert store.apply(one, 3, "a") == v == store.version()  # committed: nothing is done
    lost = f"{store.root}/manifest/v=3/_SUCCESS"  # as if the job had died before its commit
    os.rename(lost, lost + "-gone")
    assert store.version() == manifest
    assert store.apply(one, 3, "a") == v
    assert store.read().count() == want.count() + 1


def test_order_is_the_logs_whatever_the_batches(spark, scratch):
    store = ingest.bucket_store(spark, scratch, "matchs", buckets=4)
    part = {"match_id": 1, "statut": "terminé"}
    # a newer update of another partition with a smaller offset, then the full record, late
    store.apply(records(spark, [(0, 10, 5, dict(FULL, statut="programmé"))]), 0, "a")
    store.apply(records(spark, [(1, 3, 9, part)]), 1, "a")
    r = store.lookup(1).first()
    assert (r.statut, r.lieu) == ("terminé", "L")
    store.apply(records(spark, [(1, 1, 2, {"match_id": 2, "statut": "en cours"}), (0, 12, 30, {"match_id": 3, "lieu": "x"})]), 2, "a")
    store.apply(records(spark, [(0, 1, 1, dict(FULL, match_id=2))]), 3, "a")
    r = store.lookup(2).first()
    assert (r.statut, r.lieu) == ("en cours", "L")  # the late full record lies under the update
    everything = [(0, 10, 5, dict(FULL, statut="programmé")), (1, 3, 9, part), (1, 1, 2, {"match_id": 2, "statut": "en cours"}),
                  (0, 12, 30, {"match_id": 3, "lieu": "x"}), (0, 1, 1, dict(FULL, match_id=2))]
    fold = state.folding("matchs")
    whole = fold.finish(fold.cells(records(spark, everything)))
    assert same(store.read(), whole, whole.columns)
    store.apply(records(spark, everything), 0, "b")  # another job replays the topic
    assert same(store.read(), whole, whole.columns)


def test_deltas_equal_full_counts(spark, scratch):
    store = ingest.bucket_store(spark, scratch, "matchs", buckets=8)
    hot = [records(spark, [(0, 10**8 + i, i, dict(FULL, match_id=5, statut=("en cours", "terminé")[i % 2], score_domicile=i))]) for i in range(4)]
    for i, part in enumerate(topic_parts(spark, 4) + hot):
        store.apply(part, i, "a")
        if i == 5:
            for name in store.marts:
                store.fold_mart(name)
    now = store.read()
    for f, full in ((buckets.matches_per_status, marts.matches_per_status), (buckets.matches_per_month, marts.matches_per_month)):
        assert same(f(store), full(now), full(now).columns)
    rounded = lambda df: df.withColumns({f"moyenne_score_{x}": F.round(f"moyenne_score_{x}", 9) for x in ("domicile", "exterieur")})
    assert same(rounded(buckets.stats_matchs(store)), rounded(marts.stats_matchs(now)), marts.stats_matchs(now).columns)
    counts = now.groupBy("sport_id").agg(F.count("*").alias("nombre_matchs"))
    assert same(buckets.matches_per_sport(store), counts, counts.columns)
    store.remove(now.where("statut = 'en cours'").select("match_id"))
    assert "en cours" not in {r.statut for r in store.mart("matches_per_status").collect()}
    assert store.read().where("statut = 'en cours'").count() == 0


def test_changes_between_versions(spark, scratch):
    store = ingest.bucket_store(spark, scratch, "matchs", buckets=8)
    store.apply(records(spark, [(0, i, 1, dict(FULL, match_id=i)) for i in range(1, 60)]), 0, "a")
    store.apply(records(spark, [(0, 100, 2, {"match_id": 7, "statut": "terminé"}), (0, 101, 2, dict(FULL, match_id=70)),
                                (0, 8, 1, dict(FULL, match_id=8))]), 1, "a")  # 8 is a replay
    store.remove(spark.createDataFrame([(9,), (10**6,)], "match_id long"))
    got = {r.match_id: r for r in store.changes(0, 2).collect()}
    assert {k: r.change for k, r in got.items()} == {7: "update", 70: "insert", 9: "delete"}
    assert got[7].before.statut == "programmé" and got[7].after.statut == "terminé" and got[70].before is None and got[9].after is None
    assert store.changes(1, 1).count() == 0 and {r.change for r in store.changes(2, 1).collect()} == {"insert"}
    files = store.changes(1, 2).inputFiles()
    assert len({os.path.dirname(f) for f in files}) <= 2  # the one bucket, old and new
    store.resize(3)
    assert store.changes(2, 3).count() == 0 and store.read().count() == 59
    store.vacuum(keep=1)
    assert store.read().count() == 59 and len(glob.glob(f"{store.root}/data/v=*")) == 1


def test_a_key_opens_one_bucket(spark, scratch):
    store = ingest.bucket_store(spark, scratch, "matchs", buckets=16)
    assert store.lookup(3) is None and store.read() is None
    for i, part in enumerate(topic_parts(spark, 2)):
        store.apply(part, i, "a")
    everything = store.read()
    for k in [r.match_id for r in everything.orderBy("match_id").limit(5).collect()]:
        got = store.lookup(k)
        assert [r.match_id for r in got.collect()] == [k]
        assert len(got.inputFiles()) == 1 < len(everything.inputFiles()) / 8
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "EqualTo(match_id" in plan
    assert store.lookup(-(10**12)).count() == 0


@pytest.mark.parametrize("entity", ["matchs", "users", "sports", "notifications"])
def test_streams_of_all_entities(spark, scratch, entity):
    """1, 3 batches, two partitions, a restart, and a job with a new checkpoint."""
    tr = os.path.join(scratch, "topics")
    if entity == "matchs":
        recs = fx.match_topic(spark, SF_SMALL).select("partition", "offset", "timestamp", F.col("value").cast("string").alias("value"))
        key, wanted = "match_id", merged_matches(spark, SF_SMALL)
    else:
        table = {"users": fx.users, "sports": fx.sports, "notifications": fx.notifications}[entity](spark, SF_SMALL)
        key = table.columns[0]
        wanted = table.withColumn(key, F.col(key).cast("string")) if entity == "notifications" else table
        old = wanted.withColumn(wanted.columns[2], F.lit("old"))
        stamp = lambda df, at, p: df.select(F.lit(p).alias("partition"), F.col(key).cast("long").alias("offset"),
                                            F.lit(at).cast("timestamp").alias("timestamp"), F.to_json(F.struct("*")).alias("value"))
        recs = stamp(old, "2024-01-01 00:00:00", 0).unionByName(stamp(wanted, "2024-01-02 00:00:00", 1))
    half = recs.where(F.pmod(F.xxhash64("value"), F.lit(2)) == 0).repartition(3)
    topics.write_dir_topic(half, tr, entity)
    start = lambda ck: ingest.start_state(spark, tr, scratch, os.path.join(scratch, ck), entity, trigger=ONCE, mode="buckets", buckets=4, max_files_per_trigger=2).awaitTermination()
    start("ck")
    topics.write_dir_topic(recs.join(half.select("value"), "value", "left_anti"), tr, entity)
    start("ck")  # goes on from its checkpoint
    store = ingest.bucket_store(spark, scratch, entity)
    assert same(store.read(), wanted, wanted.columns)
    n = store.version().number
    start("ck")
    assert store.version().number == n  # nothing new
    start("other")  # replays the topic from its start
    assert store.version().number > n and same(store.read(), wanted, wanted.columns)


def test_large_buckets_are_written_in_parts_and_nothing_is_cached(spark, scratch, monkeypatch):
    monkeypatch.setattr(buckets, "TASK_ROWS", 100)
    held = set(spark.sparkContext._jsc.getPersistentRDDs())
    store = ingest.bucket_store(spark, scratch, "matchs", buckets=2)
    for i, part in enumerate(topic_parts(spark, 2)):
        store.apply(part, i, "a")
    want = merged_matches(spark, SF_SMALL)
    assert same(store.read(), want, want.columns)
    assert store._parts(2000, [0, 1]) == 11 and store._parts(99, [0]) == 1
    gone = want.where("statut = 'terminé'").select("match_id")
    v = store.remove(gone)
    assert same(store.read(), want.where("statut <> 'terminé'"), want.columns)
    assert {r.change for r in store.changes(v.number - 1, v.number).collect()} == {"delete"}
    assert {r.statut for r in store.mart("matches_per_status").collect()} == {"en cours", "programmé"}
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) <= held
    assert spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) is None


def test_a_full_record_has_one_position(spark):
    cells = state.folding("matchs").cells(records(spark, [(0, 1, 1, FULL), (0, 2, 2, dict(FULL, match_id=9, statut="x"))]))
    assert all(r[f"_{f}"] is None and r["_full"][f] is not None for r in cells.collect() for f in ("sport_id", "statut", "score_domicile"))


def test_state_sports_makes_the_sports_store_only(spark, monkeypatch):
    from matchflow.plans import queries
    made = []
    start = ingest.start_state
    monkeypatch.setattr(ingest, "start_state", lambda *a, **k: made.append(a[4]) or start(*a, **k))
    fx._MEMO.clear()
    assert queries.QUERIES["state_sports"](spark, SF_SMALL).count() == 5
    assert set(made) == {"sports"}
