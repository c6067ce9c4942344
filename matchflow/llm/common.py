"""Helpers shared by the operators: text buffers, hashes, written tables, components."""

from __future__ import annotations

import os
import tempfile
import zipfile
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchflow.session import scratch_path
from matchflow.sources.sinks import delete

#: Bytes of text that one numpy step works on; a longer document is a step of its own.
STEP_BYTES = 1 << 19
#: Rows of texts that Spark hands to Python at a time, where the session doesn't say (Spark's own: 10,000).
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

_ODD = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_ODD, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


#: Shuffle files of a query go when it ends, instead of when the driver happens to collect its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, clean: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared scratch folder and read it back: cuts the
    lineage in a place that every executor sees, so a lost executor loses nothing.
    ``clean``: the shuffle files of the writing go with it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true" if clean else before)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` gave, as it gave them, once nothing reads them any more."""
    for t in tables:
        for path in {os.path.dirname(f) for f in t.inputFiles()}:
            delete(t.sparkSession, path)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def column(batch: pa.RecordBatch, i: int) -> list[str]:
    """A string column as Python strings, null as empty."""
    return [t or "" for t in batch.column(i).to_pylist()]


def buffers(texts: pa.Array, step: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of consecutive rows, null as empty.
    A step holds about ``step`` bytes, or one longer text."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    n = len(texts)
    if not n:
        return
    raw = texts.buffers()
    wide = pa.types.is_large_string(texts.type)
    off = np.frombuffer(raw[1], np.int64 if wide else np.int32)[texts.offset:texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + step, "right")) - 1)
        yield at, end, data[off[at]:off[end]], off[at:end + 1] - off[at]
        at = end


def _power(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i below n."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, STEP_BYTES + 4096)
        have = np.empty(size, np.uint64)
        have[0] = 1
        filled = 1
        while filled < size:
            k = min(filled, size - filled)
            have[filled:filled + k] = have[:k] * np.uint64(pow(base, filled, 1 << 64))
            filled += k
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Spans:
    """64-bit hashes of any spans of a sequence, from one running sum."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _power(_ODD, n), out=self.sums[1:])
        self.back = _power(_INVERSE, n + 1)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.back[start]
        return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document number of every word `[^\\x20\\x09-\\x0D]+`, and the mask of
    bytes in words. Works on UTF-8 bytes: the separators are ASCII."""
    inside = ~is_space(data)
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, inside
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1, inside


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k hashes (one for each start with k left)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i:i + n]
    return mix(out)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once for each application (what
    ``--py-files`` does), so that jobs also run where it isn't installed."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    import matchflow
    root = os.path.dirname(os.path.abspath(matchflow.__file__))
    fd, path = tempfile.mkstemp(prefix="matchflow-", suffix=".zip")
    with os.fdopen(fd, "wb") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("matchflow", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(os.path.realpath(path))
    _shipped.add(app)


def map_batches(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with this package at hand on the executors, in batches of few long texts."""
    ship(df.sparkSession)
    if df.sparkSession.conf.get(_BATCH) == "10000":
        df.sparkSession.conf.set(_BATCH, str(BATCH_ROWS))
    return df.mapInArrow(f, schema)


def map_rows(df: DataFrame, schema: str, f: Callable[[pa.RecordBatch], Iterator[dict]]) -> DataFrame:
    """``mapInArrow`` for a function from one batch to dicts of columns."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for b in batches:
            for out in f(b):
                yield pa.RecordBatch.from_arrays(
                    [out[k.name] if isinstance(out[k.name], pa.Array) and out[k.name].type == k.type
                     else pa.array(out[k.name], k.type) for k in kinds], schema=kinds)
    return map_batches(df, run, schema)


def components(edges: DataFrame, name: str = "components", rounds: int = 64) -> DataFrame:
    """Connected components of ``edges(a, b)``: (node, root) of every node with an edge, root
    being the component's smallest node. Alternates star contractions, each an aggregate and
    a join over the edge table, which is written to the shared folder after every round; no
    node's neighbours are gathered in one place."""
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                .distinct(), name)
    seen = None
    for _ in range(rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*") \
            .where("u <> v").distinct()
        e = written(small, name)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")) \
        .union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


_ALNUM = np.zeros(256, bool)
_ALNUM[[c for c in range(256) if c >= 128 or chr(c).isalnum()]] = True


def alphanumeric(data: np.ndarray) -> np.ndarray:
    """ASCII letters and digits, and bytes of non-ASCII characters."""
    return _ALNUM[data]


def terms(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and document numbers of the terms: runs of ASCII letters and digits and
    non-ASCII characters, with A-Z in lower case."""
    starts, ends, doc, _ = words(np.where(_ALNUM[data], data, np.uint8(32)), off)
    return Spans(lower_ascii(data)).hash(starts, ends), doc


def apart(spans: list[tuple], base: list[tuple]) -> list[tuple]:
    """Those of ``spans`` that overlap none of ``base``, both (start, end, ...); base by start."""
    starts, reach = [b[0] for b in base], list(accumulate((b[1] for b in base), max))
    at = lambda s: bisect_left(starts, s[1])
    return [s for s in spans if not (i := at(s)) or reach[i - 1] <= s[0]]


def fold(id_col: str) -> F.Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5
