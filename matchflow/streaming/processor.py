"""ST6 as a keyed state processor (``transformWithState``): one value state per block of neighbouring matches.

A state is fetched from and sent to Spark's process once for a key, which costs far more than
folding a record, so a key is a block of ids and its value one JSON object with the cells of each
of its matches (those that are null are left out). A match's cells: for every field its last value and the log position that it came
from, and the positions of the first, the last and the last full record. Records are folded in one
by one as Spark hands them over, in any order, so the memory of a task doesn't grow with a hot key.
The state lies in the checkpoint's RocksDB store and is read from there (``read_processor_state``),
without replaying the topic and without an output table.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import MapType, StringType, StructField, StructType

from matchflow.functions import constants as K
from matchflow.operators import decode, state
from matchflow.schemas import MATCH, schema_of

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_TEXT = StringType()
#: Positions are text that sorts like (timestamp, partition, offset).
CELLS = StructType([StructField(n, _TEXT) for n in ("last_full", "first_at", "last_at", "first_ts")]
                   + [f for name in state.MATCH_FIELDS for f in (StructField(f"{name}_at", _TEXT), StructField(name, MATCH[name].dataType))])
#: The ids of a block are the same but for their last bits.
BLOCK_BITS = 5
BLOCK = StructType([StructField("matches", _TEXT)])
_KEYS = [(f, f"{f}_at", f in state.ALWAYS_PRESENT) for f in state.MATCH_FIELDS]


def position() -> F.Column:
    """Where a record stands in the log, as text of fixed width."""
    return F.format_string("%020d %010d %020d", F.unix_micros(decode.TS), F.col(decode.PARTITION), F.col(decode.OFFSET))


class MergeProcessor(StatefulProcessor):
    """Folds a match's records into its cells, and gives the match as it is after a batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cells = handle.getValueState("cells", BLOCK)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        block = self.cells.get()
        held = json.loads(block[0]) if block else {}
        seen = {}
        for _, match_id, record in rows:
            cells = held.setdefault(str(match_id), {})
            self.fold(cells, json.loads(record))
            seen[match_id] = cells
        self.cells.update((json.dumps(held, ensure_ascii=False, separators=(",", ":")),))
        for match_id, cells in seen.items():
            yield Row(match_id=match_id, last_at=cells["last_at"])

    @staticmethod
    def fold(held: dict, row) -> None:
        """``row``: a record without its null columns; ``held``: a match's cells, likewise."""
        at, carried = row["at"], row["carried"]
        if "first_at" not in held or at < held["first_at"]:
            held["first_at"], held["first_ts"] = at, row.get("stamp")
        held["last_at"] = max(held.get("last_at", at), at)
        if all(f in carried for f in state.FULL_MARKERS):
            held["last_full"] = max(held.get("last_full", at), at)
        for f, f_at, always in _KEYS:
            there = f in carried
            if (there or always) and held.get(f_at, "") <= at:
                held[f_at] = at
                value = row.get(f) if there else 0
                if value is None:
                    held.pop(f, None)
                else:
                    held[f] = value

    def close(self) -> None:
        pass


def start_processor(spark: SparkSession, topics_root: str, ckpt_root: str, trigger: dict | None = None, **src) -> StreamingQuery:
    """The state processor over the match topic; its state is its only output."""
    from matchflow.streaming.ingest import _trigger, topic_stream
    session = spark.newSession()  # the store's kind is this query's own
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    session.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    src.setdefault("starting", "earliest")
    src.setdefault("fail_on_data_loss", True)
    dec = decode.decode_json(topic_stream(session, topics_root, "matchs", **src), schema_of("matchs"))
    rows = dec.where(state.valid_key("match_id")).select(
        F.shiftright("match_id", BLOCK_BITS).alias("block"), "match_id", F.to_json(F.struct(position().alias("at"), F.date_format(decode.TS, "yyyy-MM-dd HH:mm:ss").alias("stamp"),
        F.coalesce(F.col(decode.KEYS), F.array().cast("array<string>")).alias("carried"), *state.MATCH_FIELDS)).alias("record"))
    out = rows.groupBy("block").transformWithState(MergeProcessor(), "match_id long, last_at string", "Update", "None")
    w = out.writeStream.queryName("state_processor").outputMode("update").format("noop") \
        .option("checkpointLocation", os.path.join(ckpt_root, "state_processor"))
    return _trigger(w, trigger).start()


def read_processor_state(spark: SparkSession, ckpt_root: str) -> DataFrame:
    """The matches as the processor's state has them, read from the checkpoint's store."""
    found = spark.read.format("statestore").option("path", os.path.join(ckpt_root, "state_processor")).option("stateVarName", "cells").load() \
        .select(F.explode(F.from_json("value.matches", MapType(_TEXT, CELLS))).alias("match_id", "cells"))
    cell = F.col("cells")
    out = [F.col("match_id").cast("long").alias("match_id")]
    for f in state.MATCH_FIELDS:
        kind = MATCH[f].dataType
        if f in state.ALWAYS_PRESENT:
            out.append(cell[f].alias(f))
            continue
        default = cell["first_ts"] if f == "date_match" else F.lit(K.UNKNOWN_MATCH_DEFAULTS.get(f)).cast(kind)
        value = F.when(cell["last_full"].isNull(), F.when(cell[f"{f}_at"].isNotNull(), cell[f]).otherwise(default)) \
            .when(cell[f"{f}_at"] >= cell["last_full"], cell[f])
        out.append(value.cast(kind).alias(f))
    offset = lambda c: F.element_at(F.split(cell[c], " "), -1).cast("long")
    return found.select(*out, offset("first_at").alias("first_offset"), offset("last_at").alias("last_offset"))
