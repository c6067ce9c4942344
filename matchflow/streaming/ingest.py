"""Structured Streaming jobs (ST1-ST9).

* ``start_ingest``: one query per topic; each micro-batch is decoded,
  validated, written to its curated table (matches partitioned by
  year/month/day), bad rows to a quarantine table, and its statistics
  snapshot -- all keyed by ``batch_id``, so a retried batch overwrites itself.
* ``start_state``: the latest state per key as a *streaming aggregation*
  (the same ``merge_partial`` / ``latest_per_key`` functions as in batch);
  ``update`` mode emits only changed keys and ``upsert_snapshot`` writes the
  next version of the state table (anti-join of the old version + changes).
* ``start_notifier``: stream-static fan-out of match events to the users
  table as it stands at each micro-batch.

Errors are never swallowed (ST4): a failing batch fails the query, which
restarts from its checkpoint and replays the batch -- no silent data loss.
Tests drive every query with ``trigger(availableNow=True)``.
"""

from __future__ import annotations

import hashlib
import json
import os
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from matchflow.functions.scalars import parse_ts
from matchflow.operators import decode, marts, notify, state
from matchflow.schemas import key_of, schema_of
from matchflow.session import scratch_path
from matchflow.sources import sinks, topics
from matchflow.streaming.buckets import BUCKETS, MATCH_MARTS, BucketStore

ENTITIES = ("sports", "matchs", "users", "notifications")


def _trigger(w, trigger: dict | None):
    return w.trigger(**(trigger or {"processingTime": "30 seconds"}))


def topic_stream(spark: SparkSession, topics_root: str, topic: str,
                 max_files_per_trigger: int | None = None, kafka: str | None = None,
                 min_partitions: int | None = None, starting: str | None = None,
                 fail_on_data_loss: bool = False) -> DataFrame:
    """Topic records as a stream: Kafka when ``kafka`` names brokers (offset
    ranges split over ``min_partitions`` tasks, first run from ``starting``),
    else a directory topic, read from its first file (ST1, ST9)."""
    if kafka:
        return topics.read_kafka(spark, kafka, topic, stream=True, starting=starting,
                                 fail_on_data_loss=fail_on_data_loss,
                                 min_partitions=min_partitions or spark.sparkContext.defaultParallelism)
    return topics.read_dir_topic(spark, topics_root, topic, stream=True,
                                 max_files_per_trigger=max_files_per_trigger)


# --- ingest: curated tables, quarantine, statistics ------------------------------------------

def _batch_stats(entity: str, valid: DataFrame) -> DataFrame | None:
    if entity == "matchs":
        return marts.matches_per_sport(valid)
    if entity == "users":
        return marts.favourite_counts(valid)
    if entity == "notifications":
        return marts.notifications_per_type(valid)
    return None


def _typed(detail: DataFrame) -> DataFrame:
    """Wire dates of users and notifications as timestamps (bad -> null)."""
    for c in ("date_inscription", "date_envoi"):
        if c in detail.columns:
            detail = detail.withColumn(c, parse_ts(c))
    return detail


def process_batch(entity: str, out_root: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch body of one topic's ingest query.

    A batch is decoded once, into a table in the scratch folder that goes when the batch has ended:
    kept in the executors, the rows of a large batch fill their memory."""
    key = key_of(entity)

    def run(batch: DataFrame, batch_id: int) -> None:
        if decode.is_empty(batch):
            return
        spark, held = batch.sparkSession, scratch_path(batch.sparkSession, f"batch-{entity}")
        dec = decode.decode_json(batch, schema_of(entity), keep_raw=True)
        tagged = decode.classify(dec, key, nonzero=(entity == "matchs")).drop(decode.KEYS) \
            .withColumn(decode.RAW, F.when(F.col(decode.REASON).isNotNull(), F.col(decode.RAW)))
        try:
            tagged.write.parquet(held)
            tagged = spark.read.schema(tagged.schema).parquet(held)
            valid = tagged.where(F.col(decode.REASON).isNull()).drop(decode.REASON, decode.RAW)
            bad = tagged.where(F.col(decode.REASON).isNotNull()).select(
                decode.OFFSET, decode.RAW, decode.REASON)
            if entity == "matchs":
                sinks.write_partitioned(decode.curate_matches(valid),
                                        os.path.join(out_root, entity), batch_id)
            else:
                sinks.write_batch(_typed(valid).withColumn("processed_time", F.current_timestamp()),
                                  os.path.join(out_root, entity), batch_id)
            sinks.write_batch(bad, os.path.join(out_root, "quarantine", entity), batch_id)
            st = _batch_stats(entity, valid)
            if st is not None:
                sinks.write_batch(st, os.path.join(out_root, "stats", entity), batch_id, stamp=True)
        finally:
            sinks.delete(spark, held)

    return run


def start_ingest(spark: SparkSession, topics_root: str, out_root: str, ckpt_root: str,
                 entity: str, trigger: dict | None = None, **src) -> StreamingQuery:
    """ST1 / ST2: one checkpointed micro-batch query for one topic."""
    s = topic_stream(spark, topics_root, entity, **src)
    w = (s.writeStream.queryName(f"ingest_{entity}")
          .foreachBatch(process_batch(entity, out_root))
          .option("checkpointLocation", os.path.join(ckpt_root, f"ingest_{entity}")))
    return _trigger(w, trigger).start()


# --- raw landing zone -----------------------------------------------------------------------

def start_landing(spark: SparkSession, topics_root: str, landing_root: str, ckpt_root: str,
                  trigger: dict | None = None, entities=ENTITIES, kafka: str | None = None,
                  **src) -> StreamingQuery:
    """S3: ONE streaming query lands every message of every topic as a JSON
    line under ``topic=<name>`` (one file per task and trigger, never one
    per message). The file sink with a checkpoint is exactly-once: a replayed
    batch does not duplicate lines. With Kafka, one source subscribes to all
    topics; with directory topics, the per-topic streams are unioned."""
    if kafka:
        s = topics.read_kafka(spark, kafka, ",".join(entities), stream=True, **src)
    else:
        parts = [topic_stream(spark, topics_root, e, **src).select("value", "topic") for e in entities]
        s = parts[0]
        for p in parts[1:]:
            s = s.unionByName(p)
    out = s.select(F.col("value").cast("string").alias("value"), "topic")
    w = (out.writeStream.queryName("landing").format("text").partitionBy("topic")
            .option("path", landing_root)
            .option("checkpointLocation", os.path.join(ckpt_root, "landing")))
    return _trigger(w, trigger).start()


# --- latest state ------------------------------------------------------------------------------

def upsert_snapshot(root: str, key: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch body writing state version ``batch_id``: the previous
    complete version without the changed keys, plus the changed rows.

    The previous version is the highest one *below* ``batch_id``, so a retry
    of the same batch rebuilds the same version (idempotent)."""

    def run(changed: DataFrame, batch_id: int) -> None:
        spark = changed.sparkSession
        changed = changed.persist()
        try:
            prev_path = sinks.latest_snapshot_path(spark, root, before=batch_id)
            if prev_path is None:
                new = changed
            else:
                prev = spark.read.parquet(prev_path)
                new = prev.join(changed.select(key), key, "left_anti").unionByName(changed)
            sinks.write_snapshot(new, root, batch_id)
        finally:
            changed.unpersist()

    return run


def append_changes(root: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch body of the changelog mode: append the cells of the batch's
    changed keys (one row per key, as ``update`` mode emits them) under
    ``changes/run=<query>/batch_id=<id>`` -- O(changes) per batch, idempotent on
    retry; a job with a new checkpoint is another run and replaces nothing."""

    def run(changed: DataFrame, batch_id: int) -> None:
        sinks.write_batch(changed.withColumn("run", F.lit(run_of(changed))), f"{root.rstrip('/')}/changes", batch_id, by=("run",))

    return run


def _changes(spark: SparkSession, root: str, base: int | None) -> DataFrame:
    """Changes that aren't in a base version; which batches are is a small table beside it."""
    ch = spark.read.parquet(f"{root}/changes")
    if base is None:
        return ch
    done = spark.read.schema("run string, upto long").json(f"{root}/folded/v={base}")
    return ch.join(F.broadcast(done), "run", "left").where("upto IS NULL OR batch_id > upto").drop("upto")  # a row for each run of the job


def _changelog_cells(spark: SparkSession, root: str, key: str, changes: DataFrame | None = None) -> DataFrame:
    base_path = sinks.latest_snapshot_path(spark, f"{root}/base")
    ch = changes if changes is not None else _changes(spark, root, int(base_path.rsplit("v=", 1)[1]) if base_path else None)
    ch = ch.drop("run", "batch_id")
    return state.combine_cells(ch.unionByName(spark.read.parquet(base_path)) if base_path else ch, key)


def read_changelog_state(spark: SparkSession, root: str, key: str) -> DataFrame:
    """Merge on read: the cells of the newest compacted base and of the changes
    that it lacks, combined by key (one aggregate, map-side combined). Cells
    carry their places in the log, so neither the order of batches nor their
    numbers matter, which a new checkpoint begins anew: what a second job
    replays doesn't undo anything newer."""
    fold = state.folding(next(e for e in ENTITIES if key_of(e) == key))
    return fold.finish(_changelog_cells(spark, root.rstrip("/"), key))


def compact_changelog(spark: SparkSession, root: str, key: str) -> str | None:
    """Fold the changelog into a new base version; later reads skip the folded
    batches. The base counts only when its list of batches is there, which is written first."""
    root = root.rstrip("/")
    upto = spark.read.parquet(f"{root}/changes").groupBy("run").agg(F.max("batch_id").cast("long").alias("upto")).collect()  # a row for each run
    if not upto:
        return None
    v = 1 + max(map(int, sinks.children(spark, f"{root}/base", "v=", complete=True)), default=-1)
    folded = _changelog_cells(spark, root, key)
    spark.createDataFrame([tuple(r) for r in upto], "run string, upto long").coalesce(1).write.mode("overwrite").json(f"{root}/folded/v={v}")
    return sinks.write_snapshot(folded, f"{root}/base", v)


def state_stream(spark: SparkSession, topics_root: str, entity: str, **src) -> DataFrame:
    """Streaming cells of one entity's latest state: field merge for matches
    (W2, ST6), whole-record replace for the others (W1, ST5)."""
    src.setdefault("starting", "earliest")  # state replays the whole log (ST5)
    src.setdefault("fail_on_data_loss", True)
    dec = decode.decode_json(topic_stream(spark, topics_root, entity, **src), schema_of(entity))
    return state.folding(entity).cells(dec.where(state.valid_key(key_of(entity), nonzero=(entity == "matchs"))))


def start_state(spark: SparkSession, topics_root: str, out_root: str, ckpt_root: str,
                entity: str, trigger: dict | None = None, mode: str = "changelog",
                **src) -> StreamingQuery:
    """Streaming latest state of one entity. ``mode="snapshot"`` writes a full
    new state version per batch (simple readers, O(state) per batch);
    ``mode="changelog"`` appends only the changed keys (O(changes) per batch)
    and readers merge on read (``read_changelog_state``), with
    ``compact_changelog`` folding old changes into a base; ``mode="buckets"``
    rewrites the buckets that a batch touches (``streaming.buckets``), keeps no
    state of its own, and adds its changes to the marts."""
    if mode == "buckets":
        return _start_buckets(spark, topics_root, out_root, ckpt_root, entity, trigger, **src)
    s = state_stream(spark, topics_root, entity, **src)
    root = os.path.join(out_root, "state", entity)
    if mode == "snapshot":
        s = state.folding(entity).finish(s)
    body = upsert_snapshot(root, key_of(entity)) if mode == "snapshot" else append_changes(root)
    w = (s.writeStream.queryName(f"state_{entity}").outputMode("update")
          .foreachBatch(body)
          .option("checkpointLocation", os.path.join(ckpt_root, f"state_{entity}")))
    return _trigger(w, trigger).start()


def bucket_store(spark: SparkSession, out_root: str, entity: str, buckets: int = BUCKETS) -> BucketStore:
    return BucketStore(spark, os.path.join(out_root, "state", entity, "buckets"), state.folding(entity), buckets,
                       MATCH_MARTS if entity == "matchs" else None)


def _start_buckets(spark: SparkSession, topics_root: str, out_root: str, ckpt_root: str, entity: str,
                   trigger: dict | None, buckets: int = BUCKETS, **src) -> StreamingQuery:
    src.setdefault("starting", "earliest")
    src.setdefault("fail_on_data_loss", True)
    dec = decode.decode_json(topic_stream(spark, topics_root, entity, **src), schema_of(entity))
    valid = dec.where(state.valid_key(key_of(entity), nonzero=(entity == "matchs")))

    def body(batch: DataFrame, batch_id: int) -> None:
        store = bucket_store(batch.sparkSession, out_root, entity, buckets)
        store.apply(batch, batch_id, run_of(batch))

    w = (valid.writeStream.queryName(f"state_{entity}").foreachBatch(body)
          .option("checkpointLocation", os.path.join(ckpt_root, f"state_{entity}")))
    return _trigger(w, trigger).start()


def run_of(batch: DataFrame) -> str:
    """The id of the streaming query that a batch belongs to; it stays as long as its checkpoint."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or ""


def state_version(spark: SparkSession, out_root: str, entity: str) -> dict | None:
    """What ``read_state`` reads now, to be read again later: of the layouts that are there
    the one written last (a job may have changed its mode); None if there is none."""
    root = os.path.join(out_root, "state", entity)
    found = []
    if (v := bucket_store(spark, out_root, entity).version()) is not None:
        found.append((sinks.modified(spark, f"{root}/buckets/manifest"), {"layout": "buckets", "version": v.number}))
    if p := sinks.latest_snapshot_path(spark, root):
        found.append((sinks.modified(spark, root), {"layout": "snapshot", "version": int(p.rsplit("v=", 1)[1])}))
    if _exists(spark, f"{root}/changes"):
        upto = spark.read.parquet(f"{root}/changes").groupBy("run").agg(F.max("batch_id").cast("long").alias("upto")).collect()
        found.append((max(sinks.modified(spark, f"{root}/changes/run={r.run}") for r in upto) if upto else 0,
                      {"layout": "changelog", "upto": {r.run or "": r.upto for r in upto}}))
    return max(found, key=lambda x: x[0])[1] if found else None


def read_state(spark: SparkSession, out_root: str, entity: str, version: dict | None = None) -> DataFrame | None:
    """Current state of an entity, from the layout that was written last, or as it was at a
    ``state_version``; None if there is none. (A changelog's version counts the batches up to
    it; once these are compacted with later ones, its rows are the later ones'.)"""
    version = version or state_version(spark, out_root, entity)
    root = os.path.join(out_root, "state", entity)
    if version is None:
        return None
    if version["layout"] == "buckets":
        return bucket_store(spark, out_root, entity).read(version["version"])
    if version["layout"] == "snapshot":
        return spark.read.parquet(f"{root}/v={version['version']}")
    upto = version["upto"]
    if not sinks.latest_snapshot_path(spark, f"{root}/base"):
        known = spark.createDataFrame(list(upto.items()), "run string, _upto long")
        ch = spark.read.parquet(f"{root}/changes").withColumn("run", F.coalesce("run", F.lit("")))
        ch = ch.join(F.broadcast(known), "run").where("batch_id <= _upto").drop("_upto")
        return state.folding(entity).finish(_changelog_cells(spark, root, key_of(entity), ch))
    return read_changelog_state(spark, root, key_of(entity))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


# --- notifications -----------------------------------------------------------------------------

def pinned(spark: SparkSession, path: str, now: Callable[[], dict | None]) -> dict | None:
    """The version under which a batch was begun: read from ``path``, or ``now()`` and put there
    before anything else is done, so that a replay of the batch sees the same."""
    if _exists(spark, f"{path}/_SUCCESS"):
        return json.loads(spark.read.text(path).first()[0])
    found = now()
    if found is not None:
        spark.createDataFrame([(json.dumps(found),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return found


def notifier_batch(users_at: Callable[[dict], DataFrame], users_now: Callable[[], dict | None], topics_root: str, pins: str,
                   strict: bool = False, kafka: str | None = None, groups: str | None = None) -> Callable[[DataFrame, int], None]:
    """ST7: each match event of the batch x the users at the version that the batch
    is pinned to -> rendered notifications on the notification topic: Kafka's, or a
    directory per batch, overwritten on retry. Ids are deterministic; a task's rows are a
    partition of the directory topic, their offsets go up batch by batch.

    ``groups``: a folder for audiences. Then a record of the topic ``notification_groups`` is an event
    with the audience that gets it, and the audiences of a users version, (sport_id, user_id),
    are written to the folder once, before the first record that names them."""

    def run(events: DataFrame, batch_id: int) -> None:
        if decode.is_empty(events):
            return
        spark = events.sparkSession
        version = pinned(spark, f"{pins}/run={run_of(events)}/batch={batch_id}", users_now)
        if version is None:  # the batch fails and is replayed: its events aren't lost
            raise RuntimeError("no users table and no users topic yet")
        how = dict(event_key=decode.OFFSET, id_key=[decode.PARTITION, decode.OFFSET],
                   sent_at=F.date_format(F.col(decode.TS), "yyyy-MM-dd HH:mm:ss"))
        if groups:
            audience = _audience_id(version, strict)
            path = f"{groups}/audience={audience}"
            if not _exists(spark, f"{path}/_SUCCESS"):
                notify.audience(users_at(version), strict).write.mode("overwrite").parquet(path)
            topic, key, notes = "notification_groups", "group_id", notify.notification_groups(events, audience, **how)
        else:
            topic, key = "notifications", "notification_id"
            notes = notify.notifications_for(events, users_at(version), strict=strict, also=(decode.OFFSET,), **how)
        row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        recs = notes.select(
            F.spark_partition_id().alias("partition"), (F.lit(batch_id << 33) + row).alias("offset"),
            F.current_timestamp().alias("timestamp"), F.col(key).alias("key"),
            F.to_json(F.struct(*[F.col(c) for c in notes.columns if c != decode.OFFSET])).alias("value"))
        if kafka:
            topics.write_kafka(recs.select("key", "value"), kafka, topic)
        else:
            topics.write_dir_topic(recs, topics_root, topic, mode="overwrite", batch_id=batch_id)

    return run


def _audience_id(version: dict, strict: bool) -> str:
    """A name of the audiences of a users version."""
    return "a" + hashlib.sha256(json.dumps([version, strict], sort_keys=True).encode()).hexdigest()[:24]


def read_groups(spark: SparkSession, out_root: str) -> tuple[DataFrame, DataFrame]:
    """The ingested notification groups and the members (audience, sport_id, user_id) of their audiences;
    ``notify.expand_groups`` gives the notifications."""
    members = spark.read.schema("user_id long, sport_id int, audience string").parquet(_audiences(out_root))
    return spark.read.parquet(os.path.join(out_root, "notification_groups")), members


def _audiences(out_root: str) -> str:
    return os.path.join(out_root, "notifier", "audiences")


def start_notifier(spark: SparkSession, topics_root: str, out_root: str, ckpt_root: str,
                   trigger: dict | None = None, strict: bool = False, grouped: bool = False, **src) -> StreamingQuery:
    """Matches stream -> notifications. Only raw records that carry a sport
    produce notifications (F11), as in the source, which passes the raw
    message rather than the merged state. ``grouped``: a record for each event and its
    audience instead of one for each user (``notifier_batch``)."""
    dec = decode.decode_json(topic_stream(spark, topics_root, "matchs", **src), schema_of("matchs"))
    events = dec.where(state.valid_key("match_id") & decode.present("sport_id")
                       & F.col("sport_id").isNotNull())

    def records():
        if src.get("kafka"):
            return topics.read_kafka(spark, src["kafka"], "users", stream=False)
        if _exists(spark, topics.topic_dir(topics_root, "users")):
            return topics.read_dir_topic(spark, topics_root, "users")
        return None

    def users_now():
        # The users' state when the state query has written one; before that, the users
        # topic up to its present offsets, so that notifications never depend on which query
        # started first.
        if (found := state_version(spark, out_root, "users")) is not None:
            return found
        recs = records()
        if recs is None:
            return None
        last = recs.groupBy(F.coalesce("partition", F.lit(0)).alias("p")).agg(F.max("offset").alias("o")).collect()  # a row for each partition
        return {"layout": "topic", "upto": {str(r.p): r.o for r in last}}

    def users_at(version):
        if version["layout"] != "topic":
            return read_state(spark, out_root, "users", version)
        upto = spark.createDataFrame([(int(p), o) for p, o in version["upto"].items()], "_p int, _o long")
        recs = records().withColumn("_p", F.coalesce("partition", F.lit(0))).join(F.broadcast(upto), "_p").where("offset IS NULL OR offset <= _o")
        fold = state.folding("users")
        return fold.finish(fold.cells(decode.decode_json(recs, schema_of("users"), with_keys=False)))

    w = (events.writeStream.queryName("notifier")
               .foreachBatch(notifier_batch(users_at, users_now, topics_root, os.path.join(out_root, "notifier", "pins"), strict, src.get("kafka"),
                                            _audiences(out_root) if grouped else None))
               .option("checkpointLocation", os.path.join(ckpt_root, "notifier")))
    return _trigger(w, trigger).start()


# --- orchestration -----------------------------------------------------------------------------

def start_all(spark: SparkSession, topics_root: str, out_root: str, ckpt_root: str,
              trigger: dict | None = None, **src) -> list[StreamingQuery]:
    """ST1: the four ingest queries plus the state queries."""
    qs = [start_ingest(spark, topics_root, out_root, ckpt_root, e, trigger, **src) for e in ENTITIES]
    qs += [start_state(spark, topics_root, out_root, ckpt_root, e, trigger, **src) for e in ENTITIES]
    return qs


def supervise(start: Callable[[], list[StreamingQuery]], max_restarts: int = 3,
              delay_s: float = 5.0, timeout: float | None = None) -> int:
    """ST8: run the queries built by ``start``; when one fails, stop the others,
    wait ``delay_s`` and start them all again -- each resumes from its
    checkpoint, and the per-batch sinks make the replayed batch idempotent.
    Returns the number of restarts; re-raises after ``max_restarts``."""
    import time
    from pyspark.errors import StreamingQueryException
    restarts = 0
    until = time.monotonic() + timeout if timeout else None
    while True:
        qs = start()
        try:
            while True:  # any query's failure counts, whichever it is
                running = [q for q in qs if q.isActive]
                for q in qs:
                    if not q.isActive and q.exception() is not None:
                        raise q.exception()
                if not running or (until and time.monotonic() > until):
                    return restarts
                running[0].awaitTermination(0.5)
        except StreamingQueryException:
            for q in qs:
                if q.isActive:
                    q.stop()
            restarts += 1
            if restarts > max_restarts:
                raise
            time.sleep(delay_s)


def await_any_then_stop(spark: SparkSession, queries: list[StreamingQuery],
                        timeout: float | None = None) -> None:
    """ST3: wait for any query to end (or fail), then stop all of them; a
    failure is re-raised so the job-level retry (ST8) restarts everything
    from the checkpoints."""
    try:
        spark.streams.awaitAnyTermination(timeout)
    finally:
        for q in queries:
            if q.isActive:
                q.stop()
