"""Quality rules with adaptive thresholds.

Each document's measures are counted where it lies; thresholds come from mergeable quantile
sketches (KLL) of every measure for each language and source, and are joined back. A group's
sketches are built in every task and merged, so a hot source costs no more than another. A
group's fences are a weighted mean of its own and those of its language (the sources' sketches
merged), and a language's of its own and those of all rows: the more rows, the more its own count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchflow.llm.common import Spans, buffers, map_rows, mix, windows, words, written

WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: measure: count, its base, the part of a group's rows that is usual by it, how many times its distance
#: from the median is still usual, and a count that is never odd in a text of the group's median base.
MEASURES = {
    "symbol_share": ("n_symbols", "word_chars", 0.75, 3.0, 3),
    "repeat_share": ("n_repeat_words", "n_words", 0.99, 1.0, 2 * WINDOW),
    "dup_line_words": ("n_dup_lines", "n_words", 0.99, 1.0, 2),
    "word_length": ("word_chars", "n_words", 0.9, 3.0, 0),
}
BASES = ("word_chars", "n_words")
SKETCH = 4096  # k of the sketches: quantiles are right to about 0.1% of the rows
BELIEF = 200  # rows that weigh as much as what a group falls back on


def _share(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[off[1:]] - sums[off[:-1]]


def counts(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each document of a step of bytes."""
    n = len(off) - 1
    starts, ends, doc, inside = words(data, off)
    out = {"n_words": np.bincount(doc, minlength=n), "n_symbols": _share(SYMBOLS[data], off),
           "word_chars": _share(inside & ((data & 0xC0) != 0x80), off)}
    spans = Spans(data)
    # lines: the text between line feeds and the document's bounds
    feeds = np.flatnonzero(data == 10)
    first = np.sort(np.concatenate([off[:-1], feeds + 1]))
    last = np.sort(np.concatenate([feeds, off[1:]]))
    of = np.repeat(np.arange(n), 1 + _share(data == 10, off))
    seen = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=seen[1:])
    full = seen[last] > seen[first]
    first, last, of = first[full], last[full], of[full]
    key = mix(spans.hash(first, last) + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, at = np.unique(key, return_index=True)
    out["n_dup_lines"] = np.bincount(of, minlength=n) - np.bincount(of[at], minlength=n)
    # windows of words that occur twice or more in a document
    w = windows(spans.hash(starts, ends), WINDOW)
    same = doc[:len(w)] == doc[WINDOW - 1:] if len(w) else np.zeros(0, bool)
    begin = np.flatnonzero(same)
    key = mix(w[begin] + doc[begin].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, which, times = np.unique(key, return_inverse=True, return_counts=True)
    begin = begin[times[which] > 1]
    cover = np.zeros(len(doc) + 1, np.int64)
    np.add.at(cover, begin, 1)
    np.add.at(cover, begin + WINDOW, -1)
    out["n_repeat_words"] = np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=n)
    return out


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(id, by..., counts...) of every row's whole text; null text: no words."""
    keep = [id_col, *by]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"{c} long" for c in COUNTS])

    def run(batch) -> Iterator[dict]:
        for a, b, data, off in buffers(batch.column(len(keep))):
            yield {c: batch.column(i).slice(a, b - a) for i, c in enumerate(keep)} | counts(data, off)

    return map_rows(docs.select(*keep, text_col), schema, run)


def failed(c: str = "") -> str:
    return "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"


def _share_of(m: str) -> str:
    return f"{MEASURES[m][0]} / greatest({MEASURES[m][1]}, 1)"


def _fence(m: str, spread: float) -> str:
    """The fence of a measure over a row of sketches."""
    _, base, p, times, least = MEASURES[m]
    q = lambda c, p: f"kll_sketch_get_quantile_double({c}, {p}D)"
    return f"{q(m, p)} + {spread * times}D * ({q(m, p)} - {q(m, 0.5)}) + {spread * least}D / greatest({q(base, 0.5)}, 1D)"


def thresholds(measured: DataFrame, by: tuple[str, ...] = ("lang", "source"), spread: float = 1.0, belief: float = BELIEF) -> DataFrame:
    """(by..., n, <measure>_max) of each group's rows that pass the base rules.

    A group's own fence is the quantile in MEASURES, that many times its distance from the
    median above it, and a count in MEASURES for a text of the group's median size, so that
    where nearly all rows have none a single one isn't odd. ``spread`` scales the last two.
    The fence of a group of n rows is n / (n + belief) parts its own, the rest that of the groups
    that share its keys but the last, which is made the same way, down to all rows. Null keys
    are a group like any other."""
    ok = measured.where(f"NOT ({failed()})").selectExpr(*[f"`{c}`" for c in by], *[f"{_share_of(m)} AS {m}" for m in MEASURES], *BASES)
    sketched = (*MEASURES, *BASES)
    own = ok.groupBy(*by).agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(F.col(m).cast("double"), F.lit(SKETCH)).alias(m) for m in sketched])
    own = written(own, "rule-sketches")
    fences = lambda df, name: [F.expr(_fence(m, spread)).alias(f"{name}{m}_max") for m in MEASURES]
    out = None
    for level in range(len(by) + 1):
        keys = by[:level]
        at = own if level == len(by) else own.groupBy(*keys).agg(
            F.sum("n").alias("n"), *[F.kll_merge_agg_double(m, F.lit(SKETCH)).alias(m) for m in sketched])
        at = at.where("n > 0").select(*keys, "n", *fences(at, "_own_"))
        if out is None:
            out = at.select("n", *[F.col(f"_own_{m}_max").alias(f"{m}_max") for m in MEASURES])
            continue
        wide = out.select(*[F.col(c).alias(f"_w_{c}") for c in keys[:-1]], *[F.col(f"{m}_max").alias(f"_w_{m}_max") for m in MEASURES])
        same = F.lit(True)
        for c in keys[:-1]:
            same = same & F.col(c).eqNullSafe(F.col(f"_w_{c}"))
        out = at.join(wide, same).selectExpr(*[f"`{c}`" for c in keys], "n", *[
            f"(n * _own_{m}_max + {belief}D * _w_{m}_max) / (n + {belief}D) AS {m}_max" for m in MEASURES])
    return out


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                by: tuple[str, ...] = ("lang", "source"), spread: float = 1.0, belief: float = BELIEF) -> DataFrame:
    """(id, by..., counts..., base_failed, kept, reason) of every row.

    A row is kept unless the base rules fail or a measure passes its group's fence. Rows with
    null or repeated ids each give a row; a null language or source is a group of its own;
    a group all of whose rows fail the base rules has no fence and needs none. The counts
    are written once and joined with the fences, one row for each group."""
    m = written(measure(docs, id_col, text_col, by), "rule-counts")
    t = thresholds(m, by, spread, belief).select(*[F.col(c).alias(f"_t_{c}") for c in by], *[f"{x}_max" for x in MEASURES])
    cond = F.lit(True)
    for c in by:
        cond = cond & m[c].eqNullSafe(t[f"_t_{c}"])
    j = m.join(t, cond, "left").withColumn("base_failed", F.expr(failed()))
    j = j.withColumn("reason", F.expr(
        "CASE WHEN base_failed THEN 'base' " + " ".join(f"WHEN {_share_of(x)} > {x}_max THEN '{x}'" for x in MEASURES) + " END"))
    return j.select(id_col, *by, *COUNTS, "base_failed", F.col("reason").isNull().alias("kept"), "reason")
