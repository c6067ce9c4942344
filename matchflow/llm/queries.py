"""Registered queries of the operators, over whole tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchflow.llm import bpe, decontam, html, jaccard, lines, packing, pii, quality, resample, rules, secrets, toxicity, turns
from matchflow.llm.common import read


def _digest(df: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Counts of the base kinds, and digests, from (doc_id, spans)."""
    text = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["base"])
    of = lambda k: F.size(F.filter(base, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return df.select("doc_id", *map(of, kinds),
                     F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(secrets.find_secrets(read(spark, sf_dir, "documents")), secrets.KINDS[:3])


def op2_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def packed(docs: DataFrame) -> DataFrame:
    return packing.pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read(spark, sf_dir, "documents"))


def op4_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), quality.ratings(read(spark, sf_dir, "labels")))


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op6_line_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op7_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(pii.find_personal(read(spark, sf_dir, "documents")), pii.BASE)


def op8_multi_order_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(read(spark, sf_dir, "documents"))


def op9_tree_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(read(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op10_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.apply_rules(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "reason")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_turn_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair_damaged(read(spark, sf_dir, "conversations"))


def op13_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.round_trip(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (op1_secrets, op2_template_leaks, op3_bin_slack, op4_ordinal_quality, op5_kneser_ney, op6_line_join,
                                   op7_crf, op8_multi_order_jaccard, op9_tree_text, op10_adaptive_rules,
                                   op11_importance_resampling, op12_turn_alignment, op13_bpe_stream)}

_WORDS = r"""
w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[\p{L}\p{M}\p{N}]+(?:[.,][0-9]+)*') AS toks FROM documents),
b AS (SELECT DISTINCT item_id, regexp_extract_all(coalesce(text, ''), '[\p{L}\p{M}\p{N}]+(?:[.,][0-9]+)*') AS toks FROM benchmark)"""


def _in(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


_PLAIN = f"""WHEN lower(t) IN ({_in(decontam.NUMBERS)}) THEN '#1' WHEN lower(t) IN ({_in(decontam.UNITS)}) THEN '#3' ELSE lower(t) END"""
_TYPES = f"""CASE WHEN t >= '0' AND t < ':' THEN '#1' WHEN t <> lower(t) THEN '#2' {_PLAIN} AS y,
  CASE WHEN t >= '0' AND t < ':' THEN '#1' {_PLAIN} AS z"""

# Windows are compared as text here, typed (y) and with the letter case folded (z), and slots row by row.
_SQL2 = f"""WITH {_WORDS},
dt AS (SELECT doc_id, i, toks[i] AS t FROM (SELECT doc_id, toks, unnest(range(1, len(toks) + 1)) AS i FROM w)),
it AS (SELECT item_id, i, toks[i] AS t FROM (SELECT item_id, toks, unnest(range(1, len(toks) + 1)) AS i FROM b)),
dy AS (SELECT doc_id, i, t, {_TYPES} FROM dt),
iy AS (SELECT item_id, i, t, {_TYPES} FROM it),
dp AS (SELECT doc_id, i, string_agg(y, ' ') OVER v AS win, string_agg(z, ' ') OVER v AS fold, count(*) OVER v AS n FROM dy
  WINDOW v AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {decontam.WIDTH - 1} FOLLOWING)),
dw AS (SELECT doc_id, i, win, true AS typed FROM dp WHERE n = {decontam.WIDTH}
  UNION ALL SELECT doc_id, i, fold, false FROM dp WHERE n = {decontam.WIDTH} AND fold <> win),
ip AS (SELECT item_id, i, string_agg(y, ' ') OVER v AS win, string_agg(z, ' ') OVER v AS fold, count(*) OVER v AS n,
  sum(CASE WHEN y[1] = '#' THEN 0 ELSE 1 END) OVER v >= {decontam.LITERALS} AS of_typed, sum(CASE WHEN z[1] = '#' THEN 0 ELSE 1 END) OVER v >= {decontam.LITERALS} AS of_folded FROM iy
  WINDOW v AS (PARTITION BY item_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {decontam.WIDTH - 1} FOLLOWING)),
iu AS (SELECT *, bool_or(of_typed) OVER (PARTITION BY item_id) AS some_typed FROM ip WHERE n = {decontam.WIDTH}),
ik AS (SELECT * FROM iu WHERE CASE WHEN some_typed THEN of_typed ELSE of_folded END),
iv AS (SELECT item_id, i, win, true AS typed FROM ik WHERE of_typed
  UNION ALL SELECT item_id, i, fold, false FROM ik WHERE NOT (of_typed AND fold = win)),
nw AS (SELECT item_id, count(DISTINCT i) AS n_windows FROM iv GROUP BY item_id),
hit AS (SELECT DISTINCT doc_id, iv.item_id, unnest(CASE WHEN dw.typed AND iv.typed THEN [0, 1] ELSE [1] END) AS way, dw.i - iv.i AS shift, iv.i AS pos FROM dw JOIN iv USING (win)),
cov AS (SELECT DISTINCT doc_id, item_id, way, shift, pos + k AS p FROM hit, range(0, {decontam.WIDTH}) r(k)),
slots AS (SELECT DISTINCT c.doc_id, c.item_id, c.way, c.shift, lower(iy.t) AS mine, lower(dy.t) AS theirs FROM cov c
  JOIN iy ON iy.item_id = c.item_id AND iy.i = c.p JOIN dy ON dy.doc_id = c.doc_id AND dy.i = c.p + c.shift WHERE iy.y[1] = '#'),
sl AS (SELECT doc_id, item_id, way, shift, count(*) AS n_slots, count(DISTINCT mine) AS n_mine, bool_and(mine = theirs) AS exact FROM slots GROUP BY ALL),
ln AS (SELECT h.doc_id, h.item_id, h.way, h.pos, coalesce(n_slots, 0) AS n_slots, coalesce(exact, true) AS exact FROM hit h LEFT JOIN sl USING (doc_id, item_id, way, shift)
  WHERE coalesce(n_slots = n_mine, true)),
found AS (SELECT doc_id, item_id, way, count(DISTINCT pos) AS n_matched, any_value(n_windows) AS n_windows, max(n_slots) AS n_slots, bool_and(exact) AS exact
  FROM ln JOIN nw USING (item_id) GROUP BY doc_id, item_id, way HAVING count(DISTINCT pos) >= 0.5 * any_value(n_windows)
  UNION ALL SELECT DISTINCT w.doc_id, b.item_id, 0, 1, 1, 0, true FROM w JOIN b ON len(b.toks) >= {decontam.SHORTEST} AND b.item_id NOT IN (SELECT item_id FROM iv)
    AND contains(lower(' ' || array_to_string(w.toks, ' ') || ' '), lower(' ' || array_to_string(b.toks, ' ') || ' ')))
SELECT doc_id, item_id, n_matched, n_windows, n_slots, exact FROM found
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_matched DESC, n_slots DESC, exact DESC) = 1"""

_SQL8 = r"""WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) END AS s FROM words),
toks AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c FROM toks a JOIN toks b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM pairs WHERE 100 * c >= 75 * (n + m - c)),
sym AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach(x, y) AS (SELECT x, y FROM sym UNION SELECT r.x, s.y FROM reach r JOIN sym s ON r.y = s.x)
SELECT doc_id, len(s) AS n_shingles, least(doc_id, coalesce((SELECT min(y) FROM reach r WHERE r.x = sets.doc_id), doc_id)) AS component_id FROM sets"""

ORACLE_SQL = {"op2_template_leaks": _SQL2, "op8_multi_order_jaccard": _SQL8}
