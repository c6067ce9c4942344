"""Structured Streaming: batch = stream for the state queries (1, 3 and many
files), idempotent retries, ingest outputs, stream-static notifications."""

import os

import pytest
from pyspark.sql import functions as F

from matchflow.plans.queries import merged_matches
from matchflow.sources import fixtures as fx
from matchflow.sources import sinks, topics
from matchflow.streaming import ingest
from tests.conftest import SF_SMALL

ONCE = {"availableNow": True}


def _write_topic(spark, root, files):
    recs = fx.match_topic(spark, SF_SMALL).select(
        "partition", "offset", "timestamp", F.col("value").cast("string").alias("value"))
    topics.write_dir_topic(recs.repartition(files), root, "matchs")


@pytest.mark.parametrize("files", [1, 3, 9])
def test_stream_merge_equals_batch(spark, scratch, files):
    tr, out, ck = (os.path.join(scratch, x) for x in ("topics", "out", "ckpt"))
    _write_topic(spark, tr, files)
    q = ingest.start_state(spark, tr, out, ck, "matchs", trigger=ONCE, max_files_per_trigger=1)
    q.awaitTermination()
    got = ingest.read_state(spark, out, "matchs")
    want = merged_matches(spark, SF_SMALL)
    cols = want.columns
    assert got.count() == want.count()
    assert got.select(*cols).exceptAll(want.select(*cols)).count() == 0


def test_snapshot_upsert_is_idempotent(spark, scratch):
    root = os.path.join(scratch, "state")
    up = ingest.upsert_snapshot(root, "k")
    b0 = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    b1 = spark.createDataFrame([(2, "c")], "k int, v string")
    up(b0, 0)
    up(b1, 1)
    up(b1, 1)  # retry of batch 1
    cur = spark.read.parquet(sinks.latest_snapshot_path(spark, root))
    assert sorted((r.k, r.v) for r in cur.collect()) == [(1, "a"), (2, "c")]


def test_ingest_writes_curated_quarantine_stats_once(spark, scratch):
    tr, out, ck = (os.path.join(scratch, x) for x in ("topics", "out", "ckpt"))
    _write_topic(spark, tr, 2)
    bad = spark.createDataFrame([(0, 99, "not json"), (0, 100, '{"match_id":0}')],
                                "partition int, offset long, value string")
    topics.write_dir_topic(bad, tr, "matchs")
    q = ingest.start_ingest(spark, tr, out, ck, "matchs", trigger=ONCE)
    q.awaitTermination()
    n_log = fx.match_log(spark, SF_SMALL).count()
    assert spark.read.parquet(os.path.join(out, "matchs")).count() == n_log
    assert spark.read.parquet(os.path.join(out, "quarantine", "matchs")).count() == 2
    # a retry of the same batch id overwrites its output
    batch = topics.read_dir_topic(spark, tr, "matchs")
    ingest.process_batch("matchs", out)(batch, 0)
    ingest.process_batch("matchs", out)(batch, 0)
    assert spark.read.parquet(os.path.join(out, "matchs")).where("batch_id = 0").count() == n_log


def test_notifier_stream_static(spark, scratch):
    tr, out, ck = (os.path.join(scratch, x) for x in ("topics", "out", "ckpt"))
    _write_topic(spark, tr, 2)
    users = fx.users(spark, SF_SMALL)
    sinks.write_snapshot(users, os.path.join(out, "state", "users"), 0)
    q = ingest.start_notifier(spark, tr, out, ck, trigger=ONCE)
    q.awaitTermination()
    notes = topics.read_dir_topic(spark, tr, "notifications")
    from matchflow.operators import notify
    full = fx.match_log(spark, SF_SMALL).where("sport_id IS NOT NULL")
    expect = notify.fan_out(full.select("sport_id"), notify.audience(users)).count()
    assert notes.count() == expect
    assert notes.select("key").distinct().count() == expect


def test_all_topics_ingest_and_state(spark, scratch):
    """ST1 / ST3 / ST5: the ingest and state queries of all four topics run
    together; each state table holds one row per valid key."""
    from matchflow.operators import decode
    tr, out, ck = (os.path.join(scratch, x) for x in ("topics", "out", "ckpt"))
    domain = {"sports": fx.sports(spark, SF_SMALL), "users": fx.users(spark, SF_SMALL),
              "notifications": fx.notifications(spark, SF_SMALL)}
    for name, df in domain.items():
        enc = decode.encode_json(df).withColumn("offset", F.monotonically_increasing_id())
        topics.write_dir_topic(enc.withColumn("partition", F.lit(0)), tr, name)
    _write_topic(spark, tr, 2)
    qs = ingest.start_all(spark, tr, out, ck, trigger=ONCE)
    for q in qs:
        q.awaitTermination()
    ingest.await_any_then_stop(spark, qs, timeout=1)
    from matchflow.operators import state
    from matchflow.schemas import key_of, schema_of
    for name, df in domain.items():
        key = key_of(name)
        st = ingest.read_state(spark, out, name)
        assert st.count() == df.select(key).distinct().count()
        assert spark.read.parquet(os.path.join(out, name)).count() == df.count()
        # batch = stream for W1: the same topic read as a batch
        dec = decode.decode_json(topics.read_dir_topic(spark, tr, name), schema_of(name))
        cols = schema_of(name).fieldNames()
        want = state.latest_per_key(dec.where(F.col(key).isNotNull()).select(*cols, decode.OFFSET),
                                    key, decode.OFFSET)
        assert st.select(*want.columns).exceptAll(want).count() == 0
    assert ingest.read_state(spark, out, "matchs").count() == merged_matches(spark, SF_SMALL).count()


def test_supervise_restarts_from_checkpoint_without_duplicates(spark, scratch):
    """ST4 / ST8: a batch that fails once fails its query (no silent loss);
    the supervisor restarts it from the checkpoint, the batch is replayed and
    its idempotent sink holds every row exactly once."""
    tr, out, ck = (os.path.join(scratch, x) for x in ("topics", "out", "ckpt"))
    _write_topic(spark, tr, 3)
    flag = os.path.join(scratch, "failed_once")
    body = ingest.process_batch("matchs", out)

    def flaky(batch, batch_id):
        body(batch, batch_id)
        if batch_id == 1 and not os.path.exists(flag):
            open(flag, "w").close()
            raise RuntimeError("injected executor loss")

    def start():
        s = ingest.topic_stream(spark, tr, "matchs", max_files_per_trigger=1)
        q = (s.writeStream.foreachBatch(flaky)
              .option("checkpointLocation", os.path.join(ck, "flaky"))
              .trigger(availableNow=True).start())
        return [q]

    assert ingest.supervise(start, max_restarts=2, delay_s=0.1) == 1
    assert spark.read.parquet(os.path.join(out, "matchs")).count() == fx.match_log(spark, SF_SMALL).count()


def test_landing_zone_stream(spark, scratch):
    """One streaming query lands all topics; raw tables read them back
    (malformed lines included, as all-null rows)."""
    from matchflow.operators import decode
    tr, land, ck = (os.path.join(scratch, x) for x in ("topics", "landing", "ckpt"))
    _write_topic(spark, tr, 2)
    users = decode.encode_json(fx.users(spark, SF_SMALL)).withColumn("offset", F.lit(0).cast("long"))
    topics.write_dir_topic(users, tr, "users")
    bad = spark.createDataFrame([(0, 1, "not json")], "partition int, offset long, value string")
    topics.write_dir_topic(bad, tr, "users")
    q = ingest.start_landing(spark, tr, land, ck, trigger=ONCE, entities=("matchs", "users"))
    q.awaitTermination()
    m = topics.read_raw(spark, land, "matchs")
    u = topics.read_raw(spark, land, "users")
    assert m.count() == fx.match_log(spark, SF_SMALL).count()
    assert u.count() == fx.users(spark, SF_SMALL).count() + 1
    assert u.where("user_id IS NULL").count() == 1


def test_changelog_state_equals_batch_and_compacts(spark, scratch):
    """Changelog mode: each batch appends only its changed keys; merge on read
    equals the batch merge, before and after compaction."""
    tr, out, ck = (os.path.join(scratch, x) for x in ("topics", "out", "ckpt"))
    _write_topic(spark, tr, 3)
    q = ingest.start_state(spark, tr, out, ck, "matchs", trigger=ONCE, mode="changelog",
                           max_files_per_trigger=1)
    q.awaitTermination()
    root = os.path.join(out, "state", "matchs")
    want = merged_matches(spark, SF_SMALL)
    cols = want.columns
    for step in ("before", "after"):
        got = ingest.read_changelog_state(spark, root, "match_id")
        assert got.count() == want.count(), step
        assert got.select(*cols).exceptAll(want.select(*cols)).count() == 0, step
        if step == "before":
            assert ingest.compact_changelog(spark, root, "match_id") is not None


def test_state_orders_partitions_by_time(spark, scratch):
    import json

    from matchflow.streaming import ingest
    root, out = os.path.join(scratch, "t"), os.path.join(scratch, "o")
    full = {"match_id": 5, "sport_id": 1, "sport_nom": "F", "statut": "old"}
    recs = spark.createDataFrame([(0, 9, "2024-01-01 00:00:00", json.dumps(full)), (1, 2, "2024-01-01 01:00:00", json.dumps({**full, "statut": "new"}))],
                                 "partition int, offset long, t string, value string").selectExpr("partition", "offset", "CAST(t AS TIMESTAMP) AS timestamp", "value")
    topics.write_dir_topic(recs, root, "matchs")
    q = ingest.start_state(spark, root, out, os.path.join(scratch, "c"), "matchs", trigger={"availableNow": True})
    q.awaitTermination()
    assert [r.statut for r in ingest.read_state(spark, out, "matchs").collect()] == ["new"]


def test_notifier_fails_rather_than_drop_events(spark, scratch):
    import json

    import pytest
    from pyspark.errors import StreamingQueryException

    from matchflow.streaming import ingest
    root = os.path.join(scratch, "t")
    recs = spark.createDataFrame([(0, 1, json.dumps({"match_id": 5, "sport_id": 1, "sport_nom": "F", "statut": "rappel"}))], "partition int, offset long, value string") \
        .selectExpr("partition", "offset", "CAST('2024-01-01 00:00:00' AS TIMESTAMP) AS timestamp", "value")
    topics.write_dir_topic(recs, root, "matchs")
    args = (spark, root, os.path.join(scratch, "o"), os.path.join(scratch, "c"))
    with pytest.raises(StreamingQueryException):
        ingest.start_notifier(*args, trigger={"availableNow": True}).awaitTermination()
    users = spark.createDataFrame([(0, 1, json.dumps({"user_id": 3, "sports_favoris": [1]}))], "partition int, offset long, value string") \
        .selectExpr("partition", "offset", "CAST('2024-01-01 00:00:00' AS TIMESTAMP) AS timestamp", "value")
    topics.write_dir_topic(users, root, "users")
    ingest.start_notifier(*args, trigger={"availableNow": True}).awaitTermination()  # replays the batch
    assert topics.read_dir_topic(spark, root, "notifications").count() == 1


def test_supervise_sees_the_second_query_fail(spark, scratch):
    from matchflow.streaming import ingest
    runs = []

    def start():
        runs.append(1)

        def body(batch, _):
            if len(runs) == 1:
                raise ValueError("boom")

        s = spark.readStream.format("rate").load()
        ok = s.writeStream.foreachBatch(lambda b, i: None).trigger(processingTime="1 second").start()
        bad = s.writeStream.foreachBatch(body).trigger(processingTime="1 second").start()
        return [ok, bad]

    assert ingest.supervise(start, max_restarts=2, delay_s=0.1, timeout=8) == 1
    for q in spark.streams.active:
        q.stop()


def _wire(spark, rows):
    import json
    return spark.createDataFrame([(p, o, t, json.dumps(m)) for p, o, t, m in rows], "partition int, offset long, t string, value string") \
        .selectExpr("partition", "offset", "CAST(t AS TIMESTAMP) AS timestamp", "value")


def test_changelog_of_two_jobs_and_a_compaction(spark, scratch):
    """A job with a new checkpoint, after a compaction: its rows are read, and those it
    replays don't undo newer ones."""
    root, out = os.path.join(scratch, "t"), os.path.join(scratch, "o")
    full = {"match_id": 5, "sport_id": 1, "sport_nom": "F", "statut": "old"}
    start = lambda c: ingest.start_state(spark, root, out, os.path.join(scratch, c), "matchs", trigger=ONCE, max_files_per_trigger=1).awaitTermination()
    status = lambda: [r.statut for r in ingest.read_state(spark, out, "matchs").collect()]
    for i, s in enumerate(("old", "old2")):
        topics.write_dir_topic(_wire(spark, [(0, i, f"2024-01-01 00:0{i}:00", {**full, "statut": s})]).coalesce(1), root, "matchs")
        start("c")
    assert status() == ["old2"] and ingest.compact_changelog(spark, os.path.join(out, "state", "matchs"), "match_id")
    assert status() == ["old2"]
    topics.write_dir_topic(_wire(spark, [(1, 0, "2024-01-01 01:00:00", {**full, "statut": "new"})]).coalesce(1), root, "matchs")
    start("other")
    assert status() == ["new"]
    assert ingest.compact_changelog(spark, os.path.join(out, "state", "matchs"), "match_id")
    start("third")
    assert status() == ["new"]


def test_state_is_read_from_the_layout_written_last(spark, scratch):
    root, out = os.path.join(scratch, "t"), os.path.join(scratch, "o")
    full = {"match_id": 5, "sport_id": 1, "sport_nom": "F"}
    for i, mode in enumerate(("snapshot", "changelog", "buckets")):
        topics.write_dir_topic(_wire(spark, [(0, i, f"2024-01-01 00:0{i}:00", {**full, "statut": mode})]), root, "matchs")
        ingest.start_state(spark, root, out, os.path.join(scratch, mode), "matchs", trigger=ONCE, mode=mode).awaitTermination()
        assert [r.statut for r in ingest.read_state(spark, out, "matchs").collect()] == [mode]


@pytest.mark.parametrize("mode", [None, "changelog", "buckets"])
def test_a_replayed_batch_sees_the_users_it_was_begun_with(spark, scratch, monkeypatch, mode):
    """Users change between a batch's failure and its replay; the notifications don't."""
    from pyspark.errors import StreamingQueryException
    root, out, ck = (os.path.join(scratch, x) for x in ("t", "o", "c"))

    def users(offset, *ids):
        topics.write_dir_topic(_wire(spark, [(0, offset + i, "2024-01-01 00:00:00", {"user_id": u, "sports_favoris": [1]}) for i, u in enumerate(ids)]), root, "users")
        if mode:
            ingest.start_state(spark, root, out, ck, "users", trigger=ONCE, mode=mode).awaitTermination()
    users(0, 3, 4)
    topics.write_dir_topic(_wire(spark, [(0, i, "2024-01-01 00:00:00", {"match_id": i + 1, "sport_id": 1, "sport_nom": "F", "statut": "rappel"}) for i in range(3)]), root, "matchs")
    write = topics.write_dir_topic

    def failing(*a, **k):
        write(*a, **k)
        raise RuntimeError("lost after the write")
    monkeypatch.setattr(topics, "write_dir_topic", failing)
    with pytest.raises(StreamingQueryException):
        ingest.start_notifier(spark, root, out, ck, trigger=ONCE).awaitTermination()
    monkeypatch.setattr(topics, "write_dir_topic", write)
    users(2, 7)
    ingest.start_notifier(spark, root, out, ck, trigger=ONCE).awaitTermination()
    got = topics.read_dir_topic(spark, root, "notifications")
    assert got.count() == 6 and got.select("partition", "offset").distinct().count() == 6
    topics.write_dir_topic(_wire(spark, [(0, 9, "2024-01-01 00:00:00", {"match_id": 9, "sport_id": 1, "sport_nom": "F", "statut": "rappel"})]), root, "matchs")
    ingest.start_notifier(spark, root, out, ck, trigger=ONCE).awaitTermination()
    assert topics.read_dir_topic(spark, root, "notifications").count() == 9  # the next batch sees all three


def test_notification_groups_are_all_notifications_in_rows_of_events_and_members(spark, scratch):
    from matchflow.operators import marts, notify
    tr, out, ck = (os.path.join(scratch, x) for x in ("topics", "out", "ckpt"))
    people = [{"user_id": u, "sports_favoris": [1, 2] if u % 2 else [2, 2], "notification_active": None if u % 3 else True} for u in range(40)] \
        + [{"user_id": 90, "sports_favoris": [1], "notification_active": False}, {"user_id": 91}]
    topics.write_dir_topic(_wire(spark, [(0, i, "2024-01-01 00:00:00", p) for i, p in enumerate(people)]), tr, "users")
    events = [{"match_id": i % 7 + 1, "sport_id": s, "sport_nom": "F", "statut": t}
              for i, (s, t) in enumerate([(1, "rappel"), (2, "rappel"), (2, "en cours"), (9, "seul"), (None, "rappel")] * 6)]
    topics.write_dir_topic(_wire(spark, [(0, i, "2024-01-01 00:00:01", e) for i, e in enumerate(events)]), tr, "matchs")
    for grouped, entity in ((False, "notifications"), (True, "notification_groups")):
        ingest.start_notifier(spark, tr, out, os.path.join(ck, entity), trigger=ONCE, grouped=grouped).awaitTermination()
        ingest.start_ingest(spark, tr, out, ck, entity, trigger=ONCE).awaitTermination()
    each = spark.read.parquet(os.path.join(out, "notifications"))
    groups, members = ingest.read_groups(spark, out)
    cols = ["notification_id", "user_id", "match_id", "type", "contenu", "date_envoi", "statut"]
    got = notify.expand_groups(groups, members)
    assert got.count() == each.count() > 400 and got.select(cols).exceptAll(each.select(cols)).count() == 0
    want = marts.stats_notifications(each)
    stats = marts.stats_notification_groups(groups, members)
    assert stats.columns == want.columns and sorted(stats.collect()) == sorted(want.collect())
    assert topics.read_dir_topic(spark, tr, "notification_groups").count() == 24 and members.count() == 60


def test_ingest_keeps_no_rows_in_executors_and_no_scratch_table(spark, scratch, monkeypatch):
    from matchflow.session import checkpoint_dir
    kept = os.path.join(checkpoint_dir(spark).removeprefix("file:"), "scratch")
    tables = lambda: {x for x in (os.listdir(kept) if os.path.isdir(kept) else ()) if x.startswith("batch-")}
    spark.catalog.clearCache()
    before, held, write = tables(), [], sinks.write_batch

    def seen(*a, **b):
        held.append(spark.sparkContext._jsc.getPersistentRDDs().size())
        return write(*a, **b)

    monkeypatch.setattr(sinks, "write_batch", seen)
    batch = spark.createDataFrame([(0, 1, '{"notification_id":1,"type":"but","date_envoi":"2024-01-02 03:04:05"}'), (0, 2, "not json"),
                                   (1, 1, '{"notification_id":2,"type":"but"}'), (1, 2, '{"notification_id":null}'), (1, 3, None)],
                                  "partition int, offset long, value string")
    ingest.process_batch("notifications", scratch)(batch, 4)
    assert held == [0, 0, 0] and tables() == before
    read = lambda *p: spark.read.parquet(os.path.join(scratch, *p))
    assert sorted((r.notification_id, r.type, str(r.date_envoi)) for r in read("notifications").collect()) == [("1", "but", "2024-01-02 03:04:05"), ("2", "but", "None")]
    assert {(r._offset, r._raw, r._reject_reason) for r in read("quarantine", "notifications").collect()} == \
        {(2, "not json", "not_an_object"), (2, '{"notification_id":null}', "bad_key"), (3, None, "not_an_object")}
    assert [(r.type, r.nombre_notifications) for r in read("stats", "notifications").collect()] == [("but", 2)]

    def broken(*a, **b):
        raise RuntimeError("sink")

    monkeypatch.setattr(sinks, "write_batch", broken)
    with pytest.raises(RuntimeError, match="sink"):
        ingest.process_batch("notifications", scratch)(batch, 5)
    assert tables() == before
