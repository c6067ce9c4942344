"""Toxicity by class-conditional Kneser-Ney models.

Two models over the letters of terms, of toxic and of ordinary text: a term is a walk from
its first byte to its end, each step given all bytes before it. A step's count
in the class is discounted, and what the discount takes goes to one shared distribution: in
how many different terms of documents, over the whole corpus, the step occurs. A rare expression so weighs the
same in both models, but for the part of it that the classes use differently. The
length-normalised log-likelihood difference of the whole text and of its most toxic window,
and the most toxic term, are turned into a probability by a logistic regression on labelled
rows that the counts haven't seen.

A run of letters that is longer than LONGEST bytes, or of a script whose characters take three
bytes or more (many are written without blanks), is read as the terms of PIECE bytes from each
of its characters, so that every part of it is walked from its start.

All counts are exact and kept in Spark tables that grow with the corpus: the texts' different
terms with their counts are one aggregate, split by splitters into ranges of the sorted terms.
All terms with a common prefix lie in one range, but for prefixes of a range's first or last
term, whose counts are exchanged; so each range works out its terms' ratios by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchflow.llm.common import Spans, alphanumeric, buffers, fold, lower_ascii, map_batches, map_rows, mix, ship, words, written

DISCOUNT = 0.75
SPAN = 12  # terms in a window
PIECE = 12  # bytes of the terms that a long run, or one of a script with wide characters, is read as
LONGEST = 32  # bytes of a run that is one term
RANGE = 1 << 16  # terms in a range, on average; a task's memory goes with it
SAMPLED = 64  # terms for each range among which the splitters are chosen
STEP = 1 << 20  # bytes of text whose terms are counted together; a task's memory goes with them
#: Labelled rows up to which they are sent to the texts; beyond that the texts are joined by a shuffle.
BROADCAST_LABELS = 2_000_000
#: Most frequent terms whose ratios are sent to every task; those of other terms are joined by a shuffle.
BROADCAST_TERMS = 4_000_000
FEATURES = ("top_term", "top_ratio", "mean_ratio")
_END = np.uint64(0xA5A5A5A5A5A5A5A5)


def runs(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, place) of each element of groups of these sizes."""
    own = np.repeat(np.arange(len(size)), size)
    return own, np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)


def terms(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the terms, in their order."""
    starts, ends, doc, _ = words(np.where(alphanumeric(data), data, np.uint8(32)), off)
    wide = np.concatenate([[0], np.cumsum(data >= 0xE0)])
    size = ends - starts
    cut = (size > LONGEST) | ((wide[ends] > wide[starts]) & (size > PIECE))
    if not cut.any():
        return starts, ends, doc
    own, at = runs(size[cut] - PIECE + 1)
    begin = starts[cut][own] + at
    head = (data[begin] & 0xC0) != 0x80
    own, begin = own[head], begin[head]
    end = begin + PIECE
    last = np.append(own[1:] != own[:-1], True)
    end[last] = ends[cut][own[last]]  # at most three bytes more
    begin, end, of = np.concatenate([starts[~cut], begin]), np.concatenate([ends[~cut], end]), np.concatenate([doc[~cut], doc[cut][own]])
    order = np.argsort(begin, kind="stable")
    return begin[order], end[order], of[order]


def binaries(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    own, at = runs(ends - starts)
    off = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(off), pa.py_buffer(data[starts[own] + at])])


def term_counts(rows: DataFrame, text_col: str, toxic_col: str) -> DataFrame:
    """(term, toxic, plain, df): every different term with its occurrences in texts of either class
    (``toxic_col`` 1 or 0; null teaches no class) and the number of texts that have it."""
    def run(batches):
        for b in batches:
            label = np.asarray(b.column(1).fill_null(-1).to_pylist(), np.int64)
            for a, z, data, off in buffers(b.column(0), STEP):
                starts, ends, doc = terms(data, off)
                data = lower_ascii(data)
                _, at, term = np.unique(Spans(data).hash(starts, ends), return_index=True, return_inverse=True)
                n = len(at)
                if not n:
                    continue
                cls = label[a:z][doc]
                yield pa.RecordBatch.from_arrays(
                    [binaries(data, starts[at], ends[at]), pa.array(np.bincount(term[cls == 1], minlength=n)), pa.array(np.bincount(term[cls == 0], minlength=n)),
                     pa.array(np.bincount(np.unique(doc * n + term) % n, minlength=n))], names=["term", "toxic", "plain", "df"])

    made = map_batches(rows.select(text_col, toxic_col), run, "term binary, toxic long, plain long, df long")
    return made.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("toxic", "plain", "df")])


def ranges(counts: DataFrame, size: int = RANGE) -> DataFrame:
    """``counts`` with the number of the range of sorted terms that each lies in (range)."""
    spark, n = counts.sparkSession, counts.count()
    parts = -(-n // size)
    every = max(1, n // max(1, parts * SAMPLED))
    sample = sorted(counts.where(F.pmod(F.xxhash64("term"), F.lit(every)) == 0).select("term").toArrow().column(0).to_pylist()) if parts > 1 else []
    cuts = [sample[i * len(sample) // parts] for i in range(1, parts)] if len(sample) >= parts else sample
    held = spark.sparkContext.broadcast(np.array(cuts, f"S{LONGEST}"))  # terms have no zero bytes

    def run(batch) -> Iterator[dict]:
        at = np.searchsorted(held.value, np.array(batch.column(0).to_pylist(), f"S{LONGEST}"), "right")
        yield {c: batch.column(i) for i, c in enumerate(batch.schema.names)} | {"range": at}

    return map_rows(counts, "term binary, toxic long, plain long, df long, range int", run)


class Range:
    """The walks of a range's terms: the steps (key), each with its parent and its counts, toxic,
    ordinary and shared; and for every term and step on its way (own, step)."""

    def __init__(self, table: pa.Table):
        _, n, data, off = next(buffers(table.column("term").combine_chunks(), 1 << 40))
        size = off[1:] - off[:-1]
        self.own, level = runs(size + 1)
        self.spans, begin = Spans(data), off[:-1][self.own]
        self.hash = self.spans.hash(off[:-1], off[1:])
        parent = self.spans.hash(begin, begin + level)
        last = level == size[self.own]
        to = mix(parent ^ _END)
        to[~last] = self.spans.hash(begin[~last], begin[~last] + level[~last] + 1)
        self.key, at, self.step = np.unique(to, return_index=True, return_inverse=True)
        self.parent = parent[at]
        self.counts = [np.bincount(self.step, table.column(c).to_numpy()[self.own]) for c in ("toxic", "plain", "df")]
        raw = table.column("term").to_pylist()
        ends = [raw.index(x) for x in (min(raw), max(raw))]
        #: steps from prefixes of the range's first or last term
        self.outer = np.isin(self.parent, np.concatenate([self.spans.hash(np.full(size[i] + 1, off[i]), off[i] + np.arange(size[i] + 1)) for i in ends]))

    def ratios(self, outer: tuple[np.ndarray, ...]) -> np.ndarray:
        """log P(term | toxic) - log P(term | ordinary) of every term. ``outer``: (parent, step, counts...)
        over all ranges of the steps from outer prefixes, by step."""
        parents, inverse = np.unique(self.parent, return_inverse=True)
        mine = np.flatnonzero(self.outer)
        at = np.searchsorted(outer[1], self.key[mine])
        theirs = np.flatnonzero(np.isin(outer[0], self.parent[mine]))
        node = np.searchsorted(parents, outer[0][theirs])
        whole = np.unique(node)

        def counted(count: np.ndarray, everywhere: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Of every step: its count, its parent's, and how many steps the parent has."""
            count = count.copy()
            total, fan = np.bincount(inverse, count), np.bincount(inverse, count > 0)
            count[mine] = everywhere[at]
            total[whole] = np.bincount(node, everywhere[theirs], len(parents))[whole]
            fan[whole] = np.bincount(node, everywhere[theirs] > 0, len(parents))[whole]
            return count, total[inverse], fan[inverse]

        toxic, plain, (df, all_df, _) = (counted(c, e) for c, e in zip(self.counts, outer[2:], strict=True))
        p = []
        for count, total, fan in (toxic, plain):
            some = np.maximum(total, 1)
            p.append(np.maximum(count - DISCOUNT, 0) / some + np.where(total > 0, DISCOUNT * fan / some, 1) * df / all_df)
        return np.bincount(self.own, np.log(p[0] / p[1])[self.step], len(self.hash))


def term_ratios(counts: DataFrame, size: int = RANGE) -> DataFrame:
    """(hash, ratio, df) of every term of ``term_counts``."""
    spark = counts.sparkSession
    ship(spark)
    ranged = ranges(counts, size).groupBy("range")

    def edges(table: pa.Table) -> pa.Table:
        r = Range(table)
        return pa.table({"parent": r.parent[r.outer].view(np.int64), "step": r.key[r.outer].view(np.int64)}
                        | {c: v[r.outer].astype(np.int64) for c, v in zip(("toxic", "plain", "df"), r.counts, strict=True)})

    shared = ranged.applyInArrow(edges, "parent long, step long, toxic long, plain long, df long").groupBy("parent", "step") \
        .agg(*[F.sum(c).alias(c) for c in ("toxic", "plain", "df")]).toArrow()  # a few hundred for each range
    outer = [shared.column(i).to_numpy() for i in range(5)]
    outer = [outer[0].view(np.uint64), outer[1].view(np.uint64), *outer[2:]]
    order = np.argsort(outer[1])
    held = spark.sparkContext.broadcast(tuple(c[order] for c in outer))

    def solve(table: pa.Table) -> pa.Table:
        r = Range(table)
        return pa.table({"hash": r.hash.view(np.int64), "ratio": r.ratios(held.value).round(9), "df": table.column("df")})

    return ranged.applyInArrow(solve, "hash long, ratio double, df long")


def summaries(ratio: np.ndarray, doc: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """For each document: terms, mean ratio, the largest ratio, and the largest mean over SPAN
    neighbouring terms (short texts count as SPAN terms); 0 without terms."""
    size = np.bincount(doc, minlength=n)
    sums = np.concatenate([[0.0], np.cumsum(ratio)])
    first = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(len(doc))
    end = np.minimum(at + SPAN, first[1:][doc])
    top, term = np.full(n, -np.inf), np.full(n, -np.inf)
    np.maximum.at(top, doc, (sums[end] - sums[at]) / SPAN)
    np.maximum.at(term, doc, ratio)
    return {"n_terms": size, "mean_ratio": np.bincount(doc, ratio, n) / np.maximum(size, 1),
            "top_ratio": np.where(size > 0, top, 0.0), "top_term": np.where(size > 0, term, 0.0)}


class Held:
    """The ratios of some terms, by hash."""

    def __init__(self, found: pa.Table):
        h = found.column("hash").to_numpy().view(np.uint64)
        order = np.argsort(h)
        self.hash, self.ratio = h[order], found.column("ratio").to_numpy()[order]

    def get(self, h: np.ndarray) -> np.ndarray:
        """The ratios of different terms; NaN for others."""
        if not len(self.hash):
            return np.full(len(h), np.nan)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where(self.hash[at] == h, self.ratio[at], np.nan)


def log_ratios(docs: DataFrame, ratios: DataFrame, id_col: str, text_col: str, most: int = BROADCAST_TERMS) -> DataFrame:
    """(id, n_terms, mean_ratio, top_ratio, top_term) of every row, from texts that were counted (of
    others, terms that no counted text has give 0). Up to ``most`` terms' ratios are
    sent to every task. If there are more, the ``most`` frequent are, the others' occurrences
    are joined by a shuffle, and the windows are Spark's."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_terms long, mean_ratio double, top_ratio double, top_term double"
    fits = ratios.count() <= most
    sent = ratios if fits else ratios.orderBy(F.desc("df"), "hash").limit(most)
    held = docs.sparkSession.sparkContext.broadcast(Held(sent.select("hash", "ratio").toArrow()))

    def looked_up(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts, ends, doc = terms(data, off)
        h, term = np.unique(Spans(lower_ascii(data)).hash(starts, ends), return_inverse=True)
        return held.value.get(h)[term], h[term], doc

    def whole(batch) -> Iterator[dict]:
        for a, z, data, off in buffers(batch.column(1)):
            ratio, _, doc = looked_up(data, off)
            yield {id_col: batch.column(0).slice(a, z - a)} | summaries(np.nan_to_num(ratio), doc, z - a)

    if fits:
        return map_rows(docs.select(id_col, text_col), schema, whole)

    def single(batch) -> Iterator[dict]:
        for a, z, data, off in buffers(batch.column(1)):
            ratio, h, doc = looked_up(data, off)
            size = np.bincount(doc, minlength=z - a)
            row = np.concatenate([np.arange(z - a), doc])  # a row without a term first, then the terms
            pos = np.concatenate([np.full(z - a, -1), runs(size)[1]])
            yield {id_col: batch.column(0).slice(a, z - a).take(pa.array(row)), "row": batch.column(2).slice(a, z - a).take(pa.array(row)), "pos": pos,
                   "hash": np.concatenate([np.zeros(z - a, np.int64), h.view(np.int64)]),
                   "ratio": pa.array(np.concatenate([np.zeros(z - a), ratio]), pa.float64(), from_pandas=True)}

    one = map_rows(docs.select(id_col, text_col, F.monotonically_increasing_id().alias("row")), f"{id_col} {kind}, row long, pos long, hash long, ratio double", single)
    one = written(one, "toxic-terms")
    rest = one.where("ratio IS NULL").drop("ratio").join(ratios.select("hash", "ratio"), "hash", "left").fillna(0.0, ["ratio"])
    one = one.where("ratio IS NOT NULL").unionByName(rest)
    ahead = Window.partitionBy("row").orderBy("pos").rowsBetween(0, SPAN - 1)
    term = F.col("pos") >= 0
    of = one.withColumn("_top", F.sum("ratio").over(ahead) / SPAN).groupBy("row").agg(
        F.min(id_col).alias(id_col), F.count_if(term).alias("n_terms"), F.avg(F.when(term, F.col("ratio"))).alias("mean_ratio"),
        F.max(F.when(term, F.col("_top"))).alias("top_ratio"), F.max(F.when(term, F.col("ratio"))).alias("top_term"))
    return of.select(id_col, "n_terms", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mean_ratio", "top_ratio", "top_term")])


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3) -> np.ndarray:
    """Weights and intercept (last) by Newton steps; without both classes, the base rate."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    if len(y) == 0 or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 10)
        w[-1] = np.log(rate / (1 - rate))
        return w
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) / len(y) + penalty * w
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x / len(y) + penalty * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "toxic", fit_rows: int = 20_000) -> DataFrame:
    """(id, held_out, n_terms, mean_ratio, top_ratio, top_term, score, predicted) of every row.

    Learns from rows whose id's fold is not 0: folds 1 to 3 give the counts, fold 4 the
    logistic regression (at most ``fit_rows`` rows, those with the smallest id hashes; the
    models' counts have no such bound). Rows of labels with a null id or label teach nothing;
    a repeated id counts with its largest label. Texts that are null or have no term score
    what the regression gives a text without evidence. Ids may be null or repeat: each row
    gives a row. Other columns are not read."""
    known = labels.where(f"{id_col} IS NOT NULL AND {label_col} IS NOT NULL").groupBy(id_col).agg(F.max(label_col).cast("int").alias("_toxic"))
    known = known.select(F.col(id_col).alias("_id"), "_toxic", fold(id_col).alias("_fold"))
    teaching = written(known.where("_fold IN (1, 2, 3)").drop("_fold"), "toxic-labels")
    teaching = F.broadcast(teaching) if teaching.count() <= BROADCAST_LABELS else teaching
    taught = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(teaching, "_id", "left")
    ratios = written(term_ratios(written(term_counts(taught, "_text", "_toxic"), "toxic-counts")), "toxic-terms")
    found = written(log_ratios(docs, ratios, id_col, text_col), "toxic-ratios")
    sample = found.join(known.where("_fold = 4"), found[id_col] == F.col("_id")) \
        .select(*FEATURES, "_toxic", "_id").orderBy(F.xxhash64("_id"), "_id", *FEATURES).limit(fit_rows).toArrow()
    x = np.column_stack([sample.column(f).to_numpy() for f in FEATURES])
    w = [float(v) for v in fit_logistic(x, sample.column("_toxic").to_numpy().astype(float))]
    z = F.lit(w[-1])
    for f, v in zip(FEATURES, w, strict=False):
        z = z + F.lit(v) * F.col(f)
    return found.select(id_col, (F.coalesce(fold(id_col), F.lit(1)) == 0).alias("held_out"), "n_terms", *FEATURES,
                        (1 / (1 + F.exp(-z))).alias("score")) \
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
