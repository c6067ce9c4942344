"""Quality by ordinal cumulative-link regression.

Graded ratings 0 < 1 < ... share one vector of weights over hashed text; ordered thresholds
t_1 < t_2 < ... give P(grade >= k) = sigmoid(x.w - t_k), from which come the expected grade and
the tail probability that selects. A text's features are the relative frequencies of its terms
and of the four-grams of its character classes, and marks for its size and repetition. A text's
x.w is the mean of its features' weights, computed where the text lies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchflow.llm.common import Spans, buffers, fold, map_rows, mix, terms
from matchflow.llm.rules import counts

SIZE = 1 << 14  # hashed features
GRAM = 4
#: Character classes: a lower-case letter or a byte above ASCII, capital, digit, line feed, white space, others themselves.
CLASS = np.arange(256, dtype=np.uint8)
CLASS[128:] = CLASS[97:123] = 97
CLASS[65:91] = 65
CLASS[48:58] = 48
CLASS[[9, 11, 12, 13]] = 32


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, document and weight of every feature; a document's weights of a kind sum to 1."""
    n = len(off) - 1
    h, doc = terms(data, off)
    parts = [(mix(h ^ np.uint64(1)), doc)]
    classes = CLASS[data]
    at = np.arange(max(len(data) - GRAM + 1, 0))
    own = np.searchsorted(off, at, "right") - 1
    whole = at + GRAM <= off[own + 1]
    at, own = at[whole], own[whole]
    parts.append((Spans(classes).hash(at, at + GRAM), own))
    c = counts(data, off)
    size = np.maximum(c["n_words"], 1)
    marks = np.stack([np.log2(size).astype(np.int64), 10 * c["n_repeat_words"] // size, np.minimum(20 * c["n_dup_lines"] // size, 20),
                      np.minimum(c["word_chars"] // size, 30), np.minimum(20 * c["n_symbols"] // np.maximum(c["word_chars"], 1), 20)])
    ids = np.arange(n)
    for k, m in enumerate(marks):
        parts.append((mix((m + 1000 * (k + 1)).astype(np.uint64)), ids))
    scale = (3.0, 3.0, 0.2, 0.5, 0.5, 0.5, 0.5)  # of terms, four-grams and the marks
    bucket = np.concatenate([(p & np.uint64(SIZE - 1)).astype(np.int64) for p, _ in parts])
    of = np.concatenate([d for _, d in parts])
    share = np.concatenate([s / np.bincount(d, minlength=n)[d] for (_, d), s in zip(parts, scale, strict=True)])
    return bucket, of, share


class Model:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, eta: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - eta[:, None], -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, top: int, steps: int = 150, rate: float = 0.3,
        penalty: float = 1e-4) -> Model:
    """Penalised maximum likelihood by Adam; the thresholds stay in order as a first one plus
    positive steps. Each row is (buckets, values)."""
    n = len(rows)
    if not n:
        return Model(np.zeros(SIZE), np.arange(top) - 20.0)  # nothing known: everything is good
    at = np.concatenate([b for b, _ in rows])
    val = np.concatenate([v for _, v in rows])
    doc = np.repeat(np.arange(n), [len(b) for b, _ in rows])
    w = np.zeros(SIZE)
    above = np.array([(grades >= k).sum() + 0.5 for k in range(1, top + 1)]) / (n + 1)
    logit = np.log((1 - above) / above)
    free = np.concatenate([logit[:1], np.log(np.maximum(np.diff(logit), 1e-3))])
    state = [np.zeros(SIZE), np.zeros(SIZE), np.zeros(top), np.zeros(top)]
    for step in range(1, steps + 1):
        t = np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
        eta = np.bincount(doc, w[at] * val, n)
        tail = 1 / (1 + np.exp(np.clip(t[None] - eta[:, None], -30, 30)))
        full = np.column_stack([np.ones(n), tail, np.zeros(n)])
        slope = full * (1 - full)
        i = np.arange(n)
        p = np.maximum(full[i, grades] - full[i, grades + 1], 1e-9)
        g_eta = -(slope[i, grades] - slope[i, grades + 1]) / p / n
        g_t = np.zeros(top + 2)
        np.add.at(g_t, grades, slope[i, grades] / p / n)
        np.add.at(g_t, grades + 1, -slope[i, grades + 1] / p / n)
        g_t = g_t[1:-1]
        g_free = np.cumsum(g_t[::-1])[::-1] * np.concatenate([[1.0], np.exp(free[1:])])
        g_w = np.bincount(at, g_eta[doc] * val, SIZE) + penalty * w
        for k, (x, g) in enumerate(((w, g_w), (free, g_free))):
            state[2 * k] = 0.9 * state[2 * k] + 0.1 * g
            state[2 * k + 1] = 0.99 * state[2 * k + 1] + 0.01 * g * g
            x -= rate * (state[2 * k] / (1 - 0.9 ** step)) / (np.sqrt(state[2 * k + 1] / (1 - 0.99 ** step)) + 1e-6)
    return Model(w, np.cumsum(np.concatenate([free[:1], np.exp(free[1:])])))


def train(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade",
          max_rows: int = 4000) -> Model:
    """Fit on at most ``max_rows`` rated rows: those with the smallest id hashes, so the sample
    is spread over the whole table. Null ids and grades teach nothing; an id that repeats in
    ratings counts with its largest grade."""
    known = ratings.where(f"{id_col} IS NOT NULL AND {grade_col} IS NOT NULL").groupBy(id_col).agg(F.max(grade_col).cast("int").alias("_grade"))
    known = known.select(F.col(id_col).alias("_id"), "_grade")
    top = max(1, known.agg(F.max("_grade")).first()[0] or 1)
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), "_id")  # max_rows rows

    def run(batch) -> Iterator[dict]:
        for a, z, data, off in buffers(batch.column(1)):
            bucket, of, share = features(data, off)
            key, which = np.unique(of * SIZE + bucket, return_inverse=True)
            value = np.bincount(which, share, len(key)).astype(np.float32)
            cut = np.searchsorted(key, np.arange(z - a + 1) * SIZE)
            yield {"id": batch.column(0).slice(a, z - a), "grade": batch.column(2).slice(a, z - a),
                   "at": pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array((key % SIZE).astype(np.int32))),
                   "val": pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(value))}

    got = map_rows(texts, "id long, grade int, at array<int>, val array<float>", run).toArrow().sort_by("id")
    rows = [(np.asarray(a.values), np.asarray(v.values)) for a, v in zip(got.column("at"), got.column("val"), strict=True)]
    return fit(rows, np.clip(np.asarray(got.column("grade").to_pylist(), np.int64), 0, top), top)


def rate(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """(id, also..., expected_grade, tails array<double>) of every row's whole text; null text
    is empty and gets the marks of an empty text. Ids may be null or repeat."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # SIZE weights
    keep = [id_col, *also]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", expected_grade double, tails array<double>"

    def run(batch) -> Iterator[dict]:
        for a, z, data, off in buffers(batch.column(len(keep))):
            bucket, of, share = features(data, off)
            tails = held.value.tails(np.bincount(of, held.value.weights[bucket] * share, z - a))
            yield {c: batch.column(i).slice(a, z - a) for i, c in enumerate(keep)} | {"expected_grade": tails.sum(1), "tails": list(tails)}

    return map_rows(docs.select(*keep, F.col(text_col).alias("_text")), schema, run)


def ratings(labels: DataFrame) -> DataFrame:
    """The labels' grades: 0 poor, 1 good prose but toxic, 2 good."""
    return labels.selectExpr("doc_id", "CASE WHEN quality = 0 THEN 0 WHEN quality = 1 THEN 2 - coalesce(toxic, 0) END AS grade")


def classify(docs: DataFrame, rated: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 1,
             tail: float = 0.5, max_rows: int = 4000) -> DataFrame:
    """(id, held_out, expected_grade, tail, selected) of every row: selected where
    P(grade >= ``least``) is ``tail`` or more. Ratings of rows of fold 0 aren't learnt from."""
    model = train(docs, rated.where(fold(id_col) != 0), id_col, text_col, max_rows=max_rows)
    out = rate(docs, model, id_col, text_col)
    return out.select(id_col, (F.coalesce(fold(id_col), F.lit(1)) == 0).alias("held_out"), "expected_grade",
                      F.col("tails")[least - 1].alias("tail")).withColumn("selected", F.col("tail") >= tail)
