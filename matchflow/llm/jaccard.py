"""N-gram Jaccard join by filters under several global orders.

A document's set is its distinct word shingles; two documents link when the sets' Jaccard
similarity is at least a threshold. Documents with the same set are one class, and classes
are what is joined. Under any total order of the shingles, two similar sets share one within
their prefixes (the first size - ceil(t * size) + 1). Orders put shingles first that are rare
in the corpus and break ties by different hashes; candidates must share a prefix shingle
under each, and only then are the sets compared.

A group of documents that share a prefix shingle may be large. So a first round compares each
class with the smallest one that it shares most prefix shingles with. The links found merge
classes into components, and the second round only pairs classes of different components:
links inside a component can't change it, and no other link is lost.

Most candidates are far from similar. So their sets are first compared by parity marks, of which a
set has a few for each shingle: marks that differ stand for shingles that differ. Only sets that
may still be similar are moved. Tables and shuffle files go as soon as they are used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchflow.llm.common import Spans, buffers, components, discard, lower_ascii, map_batches, map_rows, mix, windows, words
from matchflow.llm.common import written as _written

#: Shingles whose rank by frequency is known: at most so many go to every task (9 bytes each).
#: It decides the order's quality, never which pairs are found.
RANKED = 1 << 18
#: Shingles that a task counts at a time; those that it meets once are not reported.
COUNTED = 1 << 23
#: Classes in candidate pairs up to which their ids are sent to every task (some 40 bytes each).
BROADCAST_REPS = 500_000
#: Of more, slots that their ids fall into are: a bit each, at most so many (an eighth of a byte each, and its row's share).
ID_SLOTS = 1 << 26
#: Parity marks of a set for each of its shingles, at least; their number is a power of two.
MARKS = 4


def written(df: DataFrame, name: str) -> DataFrame:
    return _written(df, name, clean=True)


@dataclass(frozen=True)
class Setting:
    k: int = 5  # words in a shingle
    percent: int = 75  # least Jaccard similarity
    orders: int = 3

    def prefix(self, size: np.ndarray) -> np.ndarray:
        return size + (-(self.percent * size) // 100) + 1


def shingles(data: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document; fewer than k words are one shingle."""
    n = len(off) - 1
    starts, ends, doc, _ = words(data, off)
    h = Spans(lower_ascii(data)).hash(starts, ends)
    first = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))])
    runs = windows(h, k)
    out = []
    for i in range(n):
        a, z = first[i], first[i + 1]
        if z - a >= k:
            out.append(np.unique(runs[a:z - k + 1]))
        elif z > a:
            out.append(windows(h[a:z], int(z - a)) ^ np.uint64(z - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def frequent(docs: DataFrame, text_col: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the most frequent shingles and the logarithms of their counts.

    Tasks count COUNTED shingles at a time and report those that they met twice or more (lossy
    counting: a count is too small by one for each time at most). Of the reported ones as many
    levels of frequency are kept as stay within RANKED."""
    def run(batches):
        held, size = [], 0

        def report():
            token, times = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            more = times > 1
            return pa.RecordBatch.from_arrays([pa.array(token[more].view(np.int64)), pa.array(times[more])], names=["token", "times"])

        for b in batches:
            for _, _, data, off in buffers(b.column(0)):
                sets = shingles(data, off, k)
                held += sets
                size += sum(map(len, sets))
                if size >= COUNTED:
                    yield report()
                    size = 0
        if held:
            yield report()

    counted = written(map_batches(docs.select(text_col), run, "token long, times long").groupBy("token")
                      .agg(F.sum("times").alias("times")).select("token", F.floor(F.log2("times")).cast("int").alias("level")), "shingle-counts")
    least, room = 64, RANKED
    for level, n in sorted(counted.groupBy("level").count().collect(), reverse=True):  # 63 levels at most
        if n > room:
            break
        least, room = level, room - n
    top = counted.where(F.col("level") >= least).toArrow().sort_by("token")  # RANKED rows at most
    discard(counted)
    token = top.column("token").to_numpy().view(np.uint64)
    by = np.argsort(token)
    return token[by], top.column("level").to_numpy()[by].astype(np.uint8)


def in_order(tokens: np.ndarray, ranked: tuple[np.ndarray, np.ndarray], order: int) -> np.ndarray:
    """The tokens under one of the global orders: rare first, ties by a hash of the order."""
    known, level = ranked
    mine = np.zeros(len(tokens), np.uint8)
    if len(known):
        at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
        mine = np.where(known[at] == tokens, level[at], 0)
    return tokens[np.lexsort((mix(tokens ^ np.uint64(0x51ED270B * (order + 1))), mine))]


def signature(tokens: np.ndarray) -> bytes | None:
    """128 bits that name a set; none for an empty one."""
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def class_table(docs: DataFrame, id_col: str, text_col: str, setting: Setting, ranked) -> tuple[DataFrame, DataFrame]:
    """(id, sig, n) of every row, and (rep, sig, n, prefix) of every class of equal sets, rep
    being the class's smallest id."""
    held = docs.sparkSession.sparkContext.broadcast(ranked)  # RANKED rows at most
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch) -> Iterator[dict]:
        for a, z, data, off in buffers(batch.column(1)):
            sets = shingles(data, off, setting.k)
            yield {"id": batch.column(0).slice(a, z - a), "sig": list(map(signature, sets)),
                   "n": [len(s) for s in sets],
                   "prefix": [_signed(in_order(s, held.value, 0)[:setting.prefix(len(s))]) if len(s) else None for s in sets]}

    # two passes over the texts (rows here, classes above) move less than one whose rows are kept
    made = map_rows(docs.select(id_col, text_col), f"id {kind}, sig binary, n long, prefix array<long>", run)
    classes = made.where("sig IS NOT NULL AND id IS NOT NULL").groupBy("sig").agg(
        F.min(F.struct("id", "n", "prefix")).alias("x")).select(F.col("x.id").alias("rep"), "sig", "x.n", "x.prefix")

    def signatures(batch) -> Iterator[dict]:
        for a, z, data, off in buffers(batch.column(1)):
            sets = shingles(data, off, setting.k)
            yield {"id": batch.column(0).slice(a, z - a), "sig": list(map(signature, sets)),
                   "n": [len(s) for s in sets]}

    return map_rows(docs.select(id_col, text_col), f"id {kind}, sig binary, n long", signatures), classes


def marks(tokens: np.ndarray) -> bytes:
    """How often the set's tokens fall on each mark, modulo 2."""
    n = 1 << max(6, (MARKS * len(tokens) - 1).bit_length())
    return np.packbits(np.bincount((tokens & np.uint64(n - 1)).view(np.int64), minlength=n).astype(np.uint8) & 1, bitorder="little").tobytes()


def differing(x: bytes, y: bytes) -> int:
    """In how many tokens two sets differ, at least: as many as their marks (of the one with fewer)."""
    if len(x) > len(y):
        x, y = y, x
    p, q = int.from_bytes(x, "little"), 0
    for at in range(0, len(y), len(x)):  # marks fold, their numbers being powers of two
        q ^= int.from_bytes(y[at:at + len(x)], "little")
    return (p ^ q).bit_count()


def in_id_slots(docs: DataFrame, reps: DataFrame, id_col: str) -> DataFrame:
    """The rows of docs whose id falls into a slot that an id of ``reps`` falls into: all rows that a
    join could find, and few others. Only the slots' bits are sent to the tasks."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(ID_SLOTS))
    taken = reps.select(slot("rep").alias("s")).groupBy(F.expr("s div 64").alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(s % 64 as int)))").alias("_bits"))
    return docs.withColumn("_slot", slot(id_col)).join(F.broadcast(taken), F.expr("_slot div 64 = _word")) \
        .where("bit_get(_bits, cast(_slot % 64 as int)) = 1").drop("_slot", "_word", "_bits")  # at most ID_SLOTS / 64 rows are sent


def set_table(docs: DataFrame, reps: DataFrame, id_col: str, text_col: str, setting: Setting, make=np.ndarray.tobytes) -> DataFrame:
    """(rep, n, tokens) of the classes in reps(rep, sig): the sorted set as packed 64-bit numbers, or
    what else ``make`` gives for it. The few classes that are in a candidate pair are looked up
    where the texts lie; of more than BROADCAST_REPS, what was made is joined by a shuffle, and no text is moved."""
    kind = docs.schema[id_col].dataType.simpleString()
    few = reps.count() <= BROADCAST_REPS
    texts = docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text"))
    texts = texts.join(F.broadcast(reps), "rep") if few else in_id_slots(texts, reps, "rep").withColumn("sig", F.lit(None).cast("binary"))

    def run(batch) -> Iterator[dict]:
        for a, z, data, off in buffers(batch.column("text")):
            sets = shingles(data, off, setting.k)
            sigs, named = batch.column("sig").slice(a, z - a).to_pylist(), list(map(signature, sets))
            keep = [i for i, s in enumerate(named) if s and sigs[i] in (None, s)]  # an id may repeat with another text
            if keep:
                yield {"rep": batch.column("rep").slice(a, z - a).take(pa.array(keep)), "sig": [named[i] for i in keep],
                       "n": [len(sets[i]) for i in keep], "tokens": [make(sets[i]) for i in keep]}

    made = map_rows(texts, f"rep {kind}, sig binary, n long, tokens binary", run)
    return (made if few else made.join(reps, ["rep", "sig"], "left_semi")).drop("sig")


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """How many of x are in the sorted y."""
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def similar(x: np.ndarray, y: np.ndarray, setting: Setting, ranked) -> bool:
    """Do two sorted sets share a prefix token under every order, and are they similar?"""
    p, q = setting.prefix(len(x)), setting.prefix(len(y))
    for order in range(setting.orders):
        if not _common(in_order(x, ranked, order)[:p], np.sort(in_order(y, ranked, order)[:q])):
            return False
    both = _common(x, y)
    return 100 * both >= setting.percent * (len(x) + len(y) - both)


def _both(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with the two sets' sizes (na, nb) and tokens (ta, tb)."""
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("rep").alias(side), F.col("n").alias(f"n{side}"), F.col("tokens").alias(f"t{side}")), side)
    return pairs


def _held(batch: pa.RecordBatch, holds) -> Iterator[dict]:
    """(a, b) of the pairs for which ``holds`` is true of na, ta, nb and tb."""
    columns = [batch.column(c) for c in ("na", "ta", "nb", "tb")]
    hold = [i for i, x in enumerate(zip(*columns, strict=True)) if holds(*(v.as_py() for v in x))]
    if hold:
        yield {c: batch.column(c).take(pa.array(hold)) for c in "ab"}


def verify(pairs: DataFrame, docs: DataFrame, size: DataFrame, id_col: str, text_col: str, setting: Setting, ranked, name: str) -> DataFrame:
    """The similar ones of the pairs (a, b), written; size has (rep, sig) of every class."""
    held = docs.sparkSession.sparkContext.broadcast(ranked)  # RANKED rows at most
    kind = pairs.schema["a"].dataType.simpleString()
    percent = setting.percent

    def may(n: int, x: bytes, m: int, y: bytes) -> bool:
        both = (n + m - differing(x, y)) // 2
        return 100 * both >= percent * (n + m - both)

    def are(n: int, x: bytes, m: int, y: bytes) -> bool:
        return similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), setting, held.value)

    pairs = pairs.select("a", "b")
    for make, holds, step in ((marks, may, "near-marks"), (np.ndarray.tobytes, are, name)):
        ends = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
        reps = written(size.select("rep", "sig").join(ends, "rep", "left_semi"), "pair-ends")
        sets = written(set_table(docs, reps, id_col, text_col, setting, make), f"{step}-sets")
        before, pairs = pairs, written(map_rows(_both(pairs, sets), f"a {kind}, b {kind}", lambda batch, holds=holds: _held(batch, holds)), step)
        discard(before, reps, sets)
    return pairs


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", setting: Setting | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, sig, n) of every row, and (sig, root) of every class: the smallest id that links
    reach from it.

    A text without words (null, empty, white space) has a null sig and no links. A row with a
    null id has its n, takes no part in links and names no component; rows that repeat an id
    with another text count as one document of that id. An empty table gives no rows; other
    columns are not read."""
    setting = setting or Setting()
    percent = setting.percent
    # sizes fit; and all common tokens up to where the first of the two prefixes ends are in
    # both prefixes, so these with what stands behind that prefix must be enough
    sizes = f"100 * least(n, m) >= {percent} * greatest(n, m)"
    enough = f"{100 + percent} * (c + ({percent} * greatest(n, m) + 99) div 100 - 1) >= {percent} * (n + m)"
    ranked = frequent(docs, text_col, setting.k)
    rows, classes = class_table(docs, id_col, text_col, setting, ranked)
    classes = written(classes, "classes")
    size = written(classes.select("rep", "sig", "n"), "class-sizes")
    # tokens that two classes or more have in their prefixes, with the smallest class
    posts = classes.select("rep", F.posexplode("prefix").alias("pos", "token"))
    shared = written(posts.groupBy("token").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).where("first < last")
                     .select("token", "first"), "shared-tokens")
    posts = written(posts.join(shared, "token"), "postings")
    discard(classes, shared)
    near = posts.where("first <> rep").groupBy("rep", "first").agg(F.count("*").alias("c")) \
        .groupBy("rep").agg(F.max(F.struct("c", "first")).alias("x")).select(F.col("x.first").alias("a"), F.col("rep").alias("b"), "x.c")
    near = near.join(size.select(F.col("rep").alias("a"), "n"), "a").join(size.select(F.col("rep").alias("b"), F.col("n").alias("m")), "b")
    edges = verify(written(near.where(sizes).where(enough), "pairs-1"), docs, size, id_col, text_col, setting, ranked, "links-1")
    label = components(edges, "round-1")
    mine = posts.join(size.select("rep", "n"), "rep").join(label.withColumnRenamed("node", "rep"), "rep", "left") \
        .select("token", "rep", "n", "pos", F.coalesce("root", "rep").alias("label"))
    several = mine.groupBy("token").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l < h").select("token")
    mine = written(mine.join(several, "token", "left_semi"), "open-tokens")
    discard(posts)
    # of a similar pair's common tokens, the first in the order has enough behind it in both sets
    cross = mine.alias("x").join(mine.alias("y"), F.expr(
        f"x.token = y.token AND x.label < y.label AND 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) "
        f"AND {100 + percent} * least(x.n - x.pos, y.n - y.pos) >= {percent} * (x.n + y.n)")) \
        .select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    cross = written(cross, "pairs-2")
    discard(mine)
    more = verify(cross, docs, size, id_col, text_col, setting, ranked, "links-2")
    root = components(edges.union(more), "round-2")
    return rows, size.select("rep", "sig").join(root.withColumnRenamed("node", "rep"), "rep", "left") \
        .select("sig", F.coalesce("root", "rep").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", setting: Setting | None = None) -> DataFrame:
    """(id, n_shingles, component_id) of every row; component_id is the row's own id where it has no words."""
    rows, classes = link(docs, id_col, text_col, setting)
    out = rows.join(classes.withColumnRenamed("sig", "_sig"), F.col("sig") == F.col("_sig"), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                      F.when(F.col("id").isNotNull(), F.coalesce("root", "id")).alias("component_id"))
