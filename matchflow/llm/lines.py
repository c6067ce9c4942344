"""Near-duplicate lines by a segment-partition edit join.

Two lines within ``edits`` edits of each other: if the shorter is cut into edits + 1 segments,
one of them occurs in the longer, near its own place. Segments are indexed by length, number
and content; a line probes the indexes of its own length and of up to ``edits`` less with the
few substrings that could match (those shifted too far would cost too many edits elsewhere).
Candidates whose character and bigram parities differ too much are dropped in the join; the
others are verified with a bit-parallel edit distance on a band of 2 * edits + 1 diagonals.
Lines linked by such pairs are one class; of a class's occurrences in the corpus, the first
(by document id, then line number) stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchflow.llm.common import Spans, column, components, map_batches, map_rows, mix, written

EDITS = 2
MIN_CHARS = 20  # shorter lines are never removed
BLANK = " \t\n\v\f\r"
#: Lines a task remembers having emitted; when it forgets them, a line is emitted again.
REMEMBERED = 300_000
#: Texts whose lines a task works on at a time; its memory goes with them.
TEXTS = 100
#: Slots of the documents' copies: at most so many numbers go to every task (8 bytes each). They
#: decide which texts are moved to be looked at, never which lines are found.
SLOTS = 1 << 22


def line_hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def long_lines(text: str, min_chars: int) -> Iterator[tuple[int, str]]:
    """(number, line without blanks at its ends) of the lines that count."""
    for i, line in enumerate(text.split("\n")):
        if len(line) >= min_chars and len(line := line.strip(BLANK)) >= min_chars:
            yield i, line


def occurrences(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(line, id, copy, no): every occurrence of a line; copy is a hash of the document's text,
    which tells apart documents that repeat an id."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch) -> Iterator[dict]:
        names, line, of, no = batch.column(0), [], [], []
        for k, text in enumerate(column(batch, 1)):
            for i, s in long_lines(text, min_chars):
                line.append(line_hash(s))
                of.append(k)
                no.append(i)
        of = pa.array(of, pa.int64())
        yield {"line": line, "id": names.take(of), "copy": batch.column(2).take(of), "no": no}

    held = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col), F.col(text_col), F.xxhash64(text_col))
    return map_rows(held, f"line long, id {kind}, copy long, no int", run)


class Points:
    """Code points of some lines, end to end, with their starts and sizes."""

    def __init__(self, lines: list[str]):
        self.points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.size = np.array([len(s) for s in lines], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.spans = Spans(self.points)

    def parities(self) -> np.ndarray:
        """Low half: parities of how often the characters of each of 32 classes occur; high half: of the bigrams."""
        p = self.points
        # a class is the highest bits of a product: the filter holds for any classes
        high = p[:-1] * np.uint32(0x85EBCA6B)
        high += p[1:]
        high *= np.uint32(0x9E3779B1)
        high >>= np.uint32(27)
        bits = np.zeros((len(p), 2), np.uint32)  # a word's low and high half
        one = np.uint32(1)
        np.left_shift(one, (p * np.uint32(0x9E3779B1)) >> np.uint32(27), out=bits[:, 0])
        np.left_shift(one, high, out=bits[:-1, 1])
        bits[self.start + self.size - 1, 1] = 0  # no bigram across lines
        return np.bitwise_xor.reduceat(bits.view("<u8").ravel(), self.start)


def segment(size: np.ndarray, i: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of segment i of lines of the sizes: even, the longer ones last."""
    short, extra = size // (edits + 1), size % (edits + 1)
    longer = np.maximum(i - (edits + 1 - extra), 0)
    return i * short + longer, short + (i >= edits + 1 - extra)


def _key(p: Points, start: np.ndarray, size: np.ndarray, i: int, length: np.ndarray) -> np.ndarray:
    return mix(p.spans.hash(start, start + size) + (length * 64 + i).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


#: What a key is to a line: a segment of its own, in place (indexed, and looked up for lines of its
#: length), or looked up only, for lines of its length or for shorter ones.
INDEXED, SAME, SHORTER = 0, 1, 2


def line_keys(p: Points, edits: int, min_chars: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(rows, keys, kind) of every segment and every substring to look up."""
    out = []
    for less in range(edits + 1):
        length = p.size - less
        for i in range(edits + 1):
            s, n = segment(length, i, edits)
            after = edits - i
            for at in range(max(-i, less - after), min(i, less + after) + 1):
                rows = np.flatnonzero((length >= min_chars) & (s + at >= 0) & (s + at + n <= p.size))
                out.append((rows, _key(p, p.start[rows] + s[rows] + at, n[rows], i, length[rows]), SHORTER if less else SAME if at else INDEXED))
    return out


def _emit(docs: DataFrame, id_col: str, text_col: str, min_chars: int, schema: str, make) -> DataFrame:
    """Rows that ``make`` gives for the lines of the documents; a line that occurs often in a
    task is taken once (while it is remembered)."""
    def run(batches):
        seen: set[int] = set()
        for b in batches:
            texts = column(b, 0)
            for k in range(0, len(texts), TEXTS):
                fresh: dict[int, str] = {}
                for text in texts[k:k + TEXTS]:
                    for _, s in long_lines(text, min_chars):
                        h = line_hash(s)
                        if h not in seen:
                            seen.add(h)
                            fresh[h] = s
                if fresh:
                    p = Points(list(fresh.values()))
                    yield from make(p, np.fromiter(fresh, np.int64, len(fresh)), p.parities().view(np.int64))
                if len(seen) > REMEMBERED:
                    seen.clear()

    return map_batches(docs.where(F.col(id_col).isNotNull()).select(text_col), run, schema)


def candidates(docs: DataFrame, id_col: str, text_col: str, edits: int, min_chars: int) -> DataFrame:
    """(a, b): pairs of lines that share a segment in place and whose parities allow it. The index
    is made of those keys that are a line's own segments."""
    def keys(p, line, parity):
        rows, key, kind = zip(*line_keys(p, edits, min_chars), strict=True)
        kinds = np.repeat(np.array(kind, np.int8), [len(r) for r in rows])
        row = np.concatenate(rows)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key).view(np.int64)), pa.array(line[row]), pa.array(parity[row]), pa.array(kinds)],
                                         names=["key", "line", "parity", "kind"])

    y = _emit(docs, id_col, text_col, min_chars, "key long, line long, parity long, kind byte", keys).repartition("key")
    x = y.where(F.col("kind") == INDEXED).select("key", "line", "parity").distinct()  # a line of many tasks is indexed once
    return x.alias("x").join(y.alias("y"), F.expr(
        f"x.key = y.key AND x.line <> y.line AND (y.kind = {SHORTER} OR y.line < x.line) "
        f"AND bit_count((x.parity ^ y.parity) & 4294967295L) <= {2 * edits} "
        f"AND bit_count(shiftrightunsigned(x.parity ^ y.parity, 32)) <= {4 * edits}")) \
        .select(F.least("x.line", "y.line").alias("a"), F.greatest("x.line", "y.line").alias("b")).distinct()


def within(pairs: list[tuple[str, str]], edits: int) -> np.ndarray:
    """Whether each pair is within ``edits`` edits: bit-parallel columns of the distance matrix,
    a word holding the 2 * edits + 1 rows around the diagonal; all pairs of a batch at a time."""
    n = len(pairs)
    if not n:
        return np.zeros(0, bool)
    k, width = edits, 2 * edits + 1
    a = [x if len(x) >= len(y) else y for x, y in pairs]
    b = [y if len(x) >= len(y) else x for x, y in pairs]
    la, lb = np.array([len(s) for s in a]), np.array([len(s) for s in b])
    top = int(la.max())
    rows = np.full((n, top + 2 * width + 1), 0xFFFFFFFE, np.uint32)  # a, from column k on
    cols = np.full((n, top + 1), 0xFFFFFFFF, np.uint32)
    for i in range(n):
        rows[i, k:k + la[i]] = np.frombuffer(a[i].encode("utf-32-le", "surrogatepass"), np.uint32)
        cols[i, :lb[i]] = np.frombuffer(b[i].encode("utf-32-le", "surrogatepass"), np.uint32)
    word = np.uint64((1 << width) - 1)
    one = np.uint64(1)
    vp = np.full(n, ((1 << (k + 1)) - 1) << k, np.uint64)  # rows 1, 2, ... of the first column's band
    vn = np.zeros(n, np.uint64)
    score = np.full(n, k, np.int64)  # of the band's lowest row, then of the last row
    alive = la - lb <= k
    for j in range(int(lb.max())):
        eq = np.zeros(n, np.uint64)
        for d in range(width):
            eq |= (rows[:, j + d] == cols[:, j]).astype(np.uint64) << np.uint64(d)
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & word
        hp = (vn | ~(d0 | vp)) & word
        hn = d0 & vp
        here = j < lb
        diagonal = here & (j + 1 + k <= la)
        score += diagonal & (d0 >> np.uint64(2 * k) & one == 0)
        last = np.clip(la - (j + 1) + k, 0, 2 * k).astype(np.uint64)  # the last row's bit
        flat = here & ~diagonal
        score += flat * ((hp >> last & one).astype(np.int64) - (hn >> last & one).astype(np.int64))
        vp, vn = (hn | ~((d0 >> one) | hp)) & word, (d0 >> one) & hp
        vp, vn = np.where(here, vp, 0), np.where(here, vn, 0)
    return alive & (score <= edits)


def _slot(copy: str, slots: int) -> F.Column:
    return F.pmod(F.col(copy), F.lit(slots))


def in_slots(docs: DataFrame, of: DataFrame, slots: int) -> DataFrame:
    """The rows of docs(_copy, ...) whose copy falls into a slot that a row of ``of`` falls into:
    all rows that a join could find, and few others. Only slot numbers are sent to the tasks."""
    taken = of.select(_slot("_copy", slots).alias("_slot")).distinct()  # at most slots rows
    return docs.join(F.broadcast(taken), _slot("_copy", slots) == F.col("_slot"), "left_semi")


def verified(pairs: DataFrame, docs: DataFrame, first: DataFrame, id_col: str, text_col: str, edits: int, min_chars: int) -> DataFrame:
    """The pairs within ``edits`` edits. The lines' texts are read from their first documents; texts
    that hold none of them stay where they lie."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("line")).distinct()
    of = written(needed.join(first, "line").groupBy(F.col("first.id").alias("_id"), F.col("first.copy").alias("_copy"))
                 .agg(F.collect_set("line").alias("_lines")), "line-homes")  # lines of one document
    held = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_copy"), F.col(text_col).alias("_text"))
    held = in_slots(held, of, SLOTS).join(of, ["_id", "_copy"]).select("_text", "_lines")

    def texts(batch) -> Iterator[dict]:
        line, out = [], []
        for text, wanted in zip(column(batch, 0), batch.column(1).to_pylist(), strict=True):
            wanted = set(wanted)
            for _, s in long_lines(text, min_chars):
                if (h := line_hash(s)) in wanted:
                    wanted.discard(h)
                    line.append(h)
                    out.append(s)
        yield {"line": line, "s": out}

    t = written(map_rows(held, "line long, s string", texts).dropDuplicates(["line"]), "line-texts")

    def check(batch) -> Iterator[dict]:
        s, z = batch.column("s").to_pylist(), batch.column("z").to_pylist()
        order = sorted(range(len(s)), key=lambda i: len(s[i]))
        keep, at = [], 0
        while at < len(order):
            some = order[at:at + max(16, min(4096, (1 << 21) // max(1, len(s[order[at]]))))]
            keep += [i for i, ok in zip(some, within([(s[i], z[i]) for i in some], edits), strict=True) if ok]
            at += len(some)
        if keep:
            yield {"a": batch.column("a").take(pa.array(keep)), "b": batch.column("b").take(pa.array(keep))}

    joined = pairs.join(t.withColumnRenamed("line", "a"), "a").join(t.select(F.col("line").alias("b"), F.col("s").alias("z")), "b")
    return map_rows(joined.select("a", "b", "s", "z"), "a long, b long", check)


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, copy, drop array<int>): the numbers of the lines of a document that repeat an earlier one."""
    seen = written(occurrences(docs, id_col, text_col, min_chars), "line-occurrences")
    lines = written(seen.groupBy("line").agg(F.min(F.struct("id", "copy", "no")).alias("first"), F.count("*").alias("times")), "lines")
    pairs = written(candidates(docs, id_col, text_col, edits, min_chars), "line-pairs")
    root = components(verified(pairs, docs, lines, id_col, text_col, edits, min_chars), "line-classes")
    lines = lines.join(root.withColumnRenamed("node", "line"), "line", "left").withColumn("root", F.coalesce("root", "line"))
    classes = lines.groupBy("root").agg(F.min("first").alias("kept"), F.sum("times").alias("times")).where("times > 1")
    keep = written(lines.select("line", "root").join(classes.select("root", "kept"), "root").select("line", "kept"), "kept-lines")
    # a class whose occurrences all lie in one place (rows that repeat a document) drops nothing
    return seen.join(keep, "line").where("NOT (id = kept.id AND copy = kept.copy AND no = kept.no)").groupBy("id", "copy").agg(F.collect_set("no").alias("drop"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """All columns of all rows, with the repeated lines cut out of the text, and n_lines and
    n_removed (long) behind them (in place of columns that docs has under these names).

    Only lines of ``min_chars`` characters or more, blanks at their ends not counted, repeat
    anything; the others, and blank ones, stay. A null text stays null, with no lines. Rows
    with a null id stay as they are and nothing repeats them. Rows that repeat an id and a text
    are one document: each loses the same lines. Rows that repeat an id with other texts are
    documents of their own, in the order of a hash of their texts. An empty table gives no rows."""
    own = ("n_lines", "n_removed")
    drop = repeated_lines(docs, id_col, text_col, edits, min_chars)
    text = F.col("row")[text_col]
    out = docs.select(F.struct(*[F.col(c) for c in docs.columns if c not in own]).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("copy")) \
        .join(drop, ["id", "copy"], "left")
    every = F.split(text, "\n", -1)
    kept = F.when(F.col("drop").isNull(), text).otherwise(
        F.array_join(F.filter(every, lambda _, i: ~F.array_contains(F.col("drop"), i)), "\n"))
    return out.select(*[F.col("row")[c].alias(c) if c != text_col else kept.alias(c) for c in docs.columns if c not in own],
                      F.when(text.isNull(), F.lit(0)).otherwise(F.size(every)).cast("long").alias("n_lines"),
                      F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_removed"))
