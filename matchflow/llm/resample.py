"""Importance resampling towards a target: documents are drawn without replacement, likelier the
more their word n-grams look like the target texts'.

Weights: n-grams are hashed into a fixed number of buckets, counted over all documents and all
target texts; a document's weight is the sum of its buckets' log ratios. Counting and weighing work on
arrays: the CRC of a word is the xor of its bytes' shares, that of an n-gram joins its words' by
shifts, which are linear and looked up.

Ranks: parallel sorting by regular sampling. Every task sorts what it has; regular samples of the
sorted runs give splitters; the rows of a segment between two splitters go to one task, which
merges them; the counts of the segments before it give exact ranks. Rows are told apart by run and
place, so that equal ones can be split, too. Segments behind the last rank that is drawn aren't exchanged.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchflow.llm.common import alphanumeric, buffers, lower_ascii, map_batches, words, written

BUCKETS = 10_000
LONGEST = 3  # words of an n-gram
#: Words hashed at a time.
BLOCK_WORDS = 1 << 17
#: Samples of all runs together that go to the driver; beyond that they lie further apart.
SAMPLES = 1 << 19
_EMPTY = np.uint32(0xFFFFFFFF)


def _levels() -> tuple[np.ndarray, list[np.ndarray]]:
    """Share of a byte value in a CRC register, and tables that move a register over 0 to 255
    bytes, 256 times as many, and so on: [bytes][byte of the register][its value]."""
    byte = np.arange(256, dtype=np.uint32)
    share = byte.copy()
    for _ in range(8):
        share = np.where(share & 1, (share >> 1) ^ np.uint32(0xEDB88320), share >> 1)

    def move(table, register):
        return (table[0][register & 255] ^ table[1][register >> 8 & 255]
                ^ table[2][register >> 16 & 255] ^ table[3][register >> 24])
    one = np.stack([share, *(byte << np.uint32(8 * (k - 1)) for k in (1, 2, 3))])  # one byte on
    levels = []
    for _ in range(4):
        table = np.empty((256, 4, 256), np.uint32)
        table[0] = np.stack([byte << np.uint32(8 * k) for k in range(4)])
        for n in range(1, 256):
            table[n] = move(one, table[n - 1])
        levels.append(table)
        one = move(one, table[255])
    return share, levels


_tables: list = []


def _crc_tables():
    if not _tables:
        _tables.extend(_levels())
    return _tables


def shift(register: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRC registers moved over n bytes each."""
    out = register
    for k, table in enumerate(_crc_tables()[1]):
        part = n >> (8 * k)
        if k and not part.any():
            break
        part = part & 255
        out = (table[part, 0, out & 255] ^ table[part, 1, out >> 8 & 255]
               ^ table[part, 2, out >> 16 & 255] ^ table[part, 3, out >> 24])
    return out


def _plain(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC of words without the usual start and end values, which makes it linear."""
    size = ends - starts
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    at = np.arange(int(size.sum())) - np.repeat(first - starts, size)
    behind = np.repeat(ends, size) - at - 1
    return np.bitwise_xor.reduceat(shift(_crc_tables()[0][data[at]], behind), first)


def gram_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(CRC-32, document) of all runs of 1 to LONGEST words of a document, joined by one space."""
    space = np.uint32(_crc_tables()[0][32])
    for low in range(0, len(starts), BLOCK_WORDS):
        high = min(low + BLOCK_WORDS, len(starts))
        more = min(high + LONGEST - 1, len(starts))
        s, e, d = starts[low:more], ends[low:more], doc[low:more]
        size = e - s
        word = _plain(data, s, e)
        register, length, n = word, size, high - low
        for k in range(LONGEST):
            if k:  # the n-gram, a space and the next word
                m = len(s) - k
                nxt = size[k:]
                register = shift(register[:m], nxt + 1) ^ shift(np.full(m, space), nxt) ^ word[k:]
                length = length[:m] + 1 + nxt
                n = min(high - low, m)
            same = d[:n] == d[k:n + k]
            crc = register[:n] ^ shift(np.full(n, _EMPTY), length[:n]) ^ _EMPTY
            yield crc[same], d[:n][same]


def _grams(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, words per row, buckets, row from the first) of a column of texts."""
    for first, end, data, off in buffers(texts):
        low = lower_ascii(data)
        starts, ends, doc, _ = words(np.where(alphanumeric(low), low, np.uint8(32)), off)
        n_words = np.bincount(doc, minlength=end - first)
        parts = list(gram_crcs(low, starts, ends, doc)) if len(starts) else []
        bucket = np.concatenate([p[0] for p in parts]) % np.uint32(BUCKETS) if parts else np.zeros(0, np.uint32)
        yield first, n_words, bucket, np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)


def bucket_counts(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """Features of all texts in each bucket: added up in every task, then over the tasks."""
    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, bucket, _ in _grams(batch.column(0)):
                total += np.bincount(bucket, minlength=BUCKETS)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found])], names=["bucket", "n"])
    counts = np.zeros(BUCKETS, np.int64)
    for bucket, n in map_batches(texts.select(text_col), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():  # at most BUCKETS rows
        counts[bucket] = n
    return counts


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's log ratio of shares, in thousandths, rounded down."""
    up = (target + 1.0) * (float(documents.sum()) + BUCKETS)
    down = (documents + 1.0) * (float(target.sum()) + BUCKETS)
    return np.floor(1000 * np.log(up / down)).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight) of every row's whole text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            n_words, features, weight = (np.zeros(n, np.int64) for _ in range(3))
            for first, some, bucket, row in _grams(batch.column(1)):
                here = slice(first, first + len(some))
                n_words[here] = some
                features[here] = np.bincount(row, minlength=len(some))
                weight[here] = np.bincount(row, gain[bucket], len(some)).astype(np.int64)  # whole numbers, exact to 2 ** 53
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n_words, features, weight))],
                                             names=[id_col, "n_words", "n_features", "weight"])
    return map_batches(docs.select(id_col, text_col), run, f"{id_col} {kind}, n_words long, n_features long, weight long")


def _number(df: DataFrame, schema: str, column) -> DataFrame:
    """One more column of rows in the order they lie in their task: ``column(batch, state)``."""
    def run(batches):
        state: dict = {}
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *column(batch, state)], names=[*batch.schema.names, *names])
    names = [x.split()[0] for x in schema.split(",")]
    old = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return map_batches(df, run, f"{old}, {schema}")


def ranked(scored: DataFrame, quota: int, parts: int, total: int) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, ... for the ``quota`` highest scores among the ``total``
    rows marked ``eligible``, ties to the smaller id (null: first), null for all others.
    ``scored`` needs columns id, score and eligible, besides any others.

    Sorted runs, regular samples and segments as in the module's text. Every row is written once
    in its sorted run, so run and place, which tell equal rows apart, stay as they are when a
    task is run again."""
    def place(batch, state):
        at = state.get("at", 0)
        state["at"] = at + batch.num_rows
        return pa.array(np.full(batch.num_rows, TaskContext.get().partitionId(), np.int64)), pa.array(np.arange(at, at + batch.num_rows))

    order = [F.col("eligible").desc(), F.col("score").desc(), F.col("id").asc_nulls_first()]
    runs = written(_number(scored.sortWithinPartitions(*order), "run long, place long", place), "runs")
    none = F.lit(None).cast("long")
    if not quota:
        return runs.withColumn("rank", none)
    n_runs = max(1, runs.where("eligible").agg(F.countDistinct("run")).first()[0])
    parts = max(1, min(parts, total))
    # Places 0, step, 2 * step, ... of each run: parts samples from a run of middle length.
    step = max(1, total // (n_runs * parts), total // SAMPLES)
    key = ["score", "id", "run", "place"]
    samples = sorted((-s, i is not None, i, r, p) for s, i, r, p in runs.where(f"eligible AND place % {step} = 0").select(*key).collect())
    splitters = [samples[k * len(samples) // parts] for k in range(1, parts)]
    bounds = np.array([s[0] for s in splitters])

    def segment(batch, _):
        score, ids, run, at = (batch.column(batch.schema.get_field_index(c)) for c in key)
        high = -score.to_numpy(zero_copy_only=False)
        out = np.searchsorted(bounds, high, "left")
        # where the score is a splitter's, the rest of the key decides
        for i in np.flatnonzero(out != np.searchsorted(bounds, high, "right")):
            name = ids[i].as_py()
            out[i] = bisect_right(splitters, (high[i], name is not None, name, run[i].as_py(), at[i].as_py()))
        return pa.array(out.astype(np.int32)),

    fields = [f"`{f.name}`" for f in runs.schema]
    dealt = _number(runs.where("eligible"), "segment int", segment)
    counts = dict(dealt.groupBy("segment").count().collect())  # a row for each segment
    before, drawn = {}, 0
    for s in range(parts):
        before[s] = drawn
        drawn += counts.get(s, 0)
    needed = [s for s in range(parts) if before[s] < quota and counts.get(s)]
    cut = needed[-1]

    def rank(batch, state):
        seg = batch.column(batch.schema.get_field_index("segment")).to_numpy()
        out = np.empty(len(seg), np.int64)
        edges = [0, *(np.flatnonzero(seg[1:] != seg[:-1]) + 1).tolist(), len(seg)]
        for low, high in zip(edges, edges[1:]):  # rows of one segment
            if high > low:
                at = state.get(int(seg[low]), before[int(seg[low])])
                out[low:high] = np.arange(at + 1, at + 1 + high - low)
                state[int(seg[low])] = at + high - low
        return pa.array(out),

    exchanged = dealt.where(F.col("segment") <= cut).repartitionById(len(needed), _position(needed)) \
        .sortWithinPartitions("segment", F.col("score").desc(), F.col("id").asc_nulls_first(), "run", "place")
    merged = _number(exchanged, "rank long", rank).select(*fields, F.when(F.col("rank") <= quota, F.col("rank")).alias("rank"))
    behind = dealt.where(F.col("segment") > cut).select(*fields, none.alias("rank"))
    return merged.unionByName(behind).unionByName(runs.where("NOT eligible").withColumn("rank", none))


def _position(needed: list[int]):
    """Place of a segment among those exchanged (segments without rows have none)."""
    return F.array_position(F.array(*map(F.lit, needed)), F.col("segment")).cast("int") - 1


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
             percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """(id, n_features, weight, score, rank, n_words): a row for each row of ``docs``.

    ``percent`` of the rows with ``least_words`` words or more are drawn: those with the highest
    scores, a score being the weight and a Gumbel value made of a hash of seed and id, in thousandths
    (Gumbel-top-k draws without replacement in proportion to the weights). Ties go to the smaller id,
    among rows that repeat an id to any of them. A null text is empty; a null id hashes as an
    empty one and comes before others; an empty table gives no rows, an empty target even weights;
    other columns are not read.

    To the driver go the counts of the buckets, the samples (at most some SAMPLES and one for each
    task) and a count for each segment."""
    spark = docs.sparkSession
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, target_text))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10)
    gumbel = F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0))).cast("long")
    weighed = weigh(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), gain, "id", "text")
    scored = written(weighed.withColumns({"score": F.col("weight") + gumbel, "eligible": F.col("n_words") >= least_words}), "weighed")
    total = scored.where("eligible").count()
    out = ranked(scored, percent * total // 100, int(spark.conf.get("spark.sql.shuffle.partitions")), total)
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank", "n_words")
