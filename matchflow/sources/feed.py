"""Upstream match feed (S12): nested JSON documents -> match rows.

A feed document is ``{"matches": [ {utcDate, status, venue, homeTeam{name},
awayTeam{name}, score{fullTime{home, away}}} ... ]}``; match ids are assigned
by position from a per-document base. ``normalize_feed`` is pure DataFrame
code (``from_json`` -> ``posexplode`` -> nested select), so a directory of
feed files is read with ``spark.read.schema(FEED).json(dir)`` and normalised
in parallel, one document per task slice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchflow.functions.scalars import iso_to_wire, score_or_zero, status_label
from matchflow.schemas import FEED

# --- fixed values: the feed is a football feed; ids start at 1000
FEED_SPORT_ID = 1
FEED_SPORT_NAME = "Football"
FEED_FIRST_ID = 1000

# Codes used when feed documents are derived from the match table (test input).
FEED_CODES = ["SCHEDULED", "TIMED", "IN_PLAY", "PAUSED", "FINISHED", "LIVE", "POSTPONED"]
DOC_SIZE = 100


def feed_documents(matches: DataFrame) -> DataFrame:
    """Derive feed documents from match rows: ``DOC_SIZE`` consecutive matches
    per document (a bounded group), status code by ``match_id % 7``, no score
    before kick-off, ISO-8601 UTC dates (``TBD`` for unspecified venues).
    Columns: doc_id, id_base, doc (JSON text)."""
    code = F.element_at(F.array(*[F.lit(c) for c in FEED_CODES]),
                        (F.col("match_id") % len(FEED_CODES) + 1).cast("int"))
    not_started = code.isin("SCHEDULED", "TIMED")
    item = F.struct(
        F.when(F.col("lieu") == "4-NOT SPECIFIED", F.lit("TBD"))
         .otherwise(F.date_format("date_match", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("utcDate"),
        code.alias("status"), F.col("lieu").alias("venue"),
        F.struct(F.col("equipe_domicile").alias("name")).alias("homeTeam"),
        F.struct(F.col("equipe_exterieur").alias("name")).alias("awayTeam"),
        F.struct(F.struct(F.when(~not_started, F.col("score_domicile")).alias("home"),
                          F.when(~not_started, F.col("score_exterieur")).alias("away"))
                 .alias("fullTime")).alias("score"))
    doc_id = F.expr(f"(match_id - 1) div {DOC_SIZE}")
    grouped = (matches.select(doc_id.alias("doc_id"), F.struct("match_id", item.alias("m")).alias("e"))
                      .groupBy("doc_id").agg(F.sort_array(F.collect_list("e")).alias("es")))
    return grouped.select(
        "doc_id",
        (F.lit(FEED_FIRST_ID) + F.col("doc_id") * DOC_SIZE).alias("id_base"),
        F.to_json(F.struct(F.transform("es", lambda e: e["m"]).alias("matches"))).alias("doc"))


def feed_items(docs: DataFrame, doc_col: str = "doc", id_base: str | None = "id_base") -> DataFrame:
    """Documents -> one row per feed match with its assigned ``match_id``."""
    base = F.col(id_base) if id_base else F.lit(FEED_FIRST_ID)
    parsed = docs.select(base.alias("_base"), F.from_json(F.col(doc_col), FEED).alias("_d"))
    ex = parsed.select("_base", F.posexplode("_d.matches").alias("_pos", "m"))
    return ex.select((F.col("_base") + F.col("_pos")).alias("match_id"), "m.*")


def normalize_feed(items: DataFrame) -> DataFrame:
    """Feed matches -> wire match rows."""
    return items.select(
        "match_id",
        F.lit(FEED_SPORT_ID).alias("sport_id"),
        F.lit(FEED_SPORT_NAME).alias("sport_nom"),
        F.coalesce(F.col("homeTeam.name"), F.lit("")).alias("equipe_domicile"),
        F.coalesce(F.col("awayTeam.name"), F.lit("")).alias("equipe_exterieur"),
        score_or_zero("score.fullTime.home").alias("score_domicile"),
        score_or_zero("score.fullTime.away").alias("score_exterieur"),
        iso_to_wire(F.coalesce(F.col("utcDate"), F.lit(""))).alias("date_match"),
        F.coalesce(F.col("venue"), F.lit("")).alias("lieu"),
        status_label(F.coalesce(F.col("status"), F.lit("")), "insert").alias("statut"))


def status_codes(items: DataFrame) -> DataFrame:
    """Each feed match's code under both label maps."""
    code = F.coalesce(F.col("status"), F.lit(""))
    return items.select("match_id", F.col("status").alias("code"),
                        status_label(code, "insert").alias("statut_insert"),
                        status_label(code, "update").alias("statut_update"))


# --- documents with fields that nobody declared --------------------------------------------------

#: Paths of a feed match that are read, with their types.
FEED_PATHS = {"utcDate": ("$.utcDate", "string"), "status": ("$.status", "string"), "venue": ("$.venue", "string"),
              "home": ("$.homeTeam.name", "string"), "away": ("$.awayTeam.name", "string"),
              "home_goals": ("$.score.fullTime.home", "int"), "away_goals": ("$.score.fullTime.away", "int")}


def feed_variants(docs: DataFrame, doc_col: str = "doc", id_base: str | None = "id_base") -> DataFrame:
    """Documents -> (match_id, v): each match as it came, as a variant. A document that is no JSON,
    or whose ``matches`` is no array, has no matches."""
    base = F.col(id_base) if id_base else F.lit(FEED_FIRST_ID)
    parsed = docs.select(base.alias("_base"), F.try_parse_json(F.col(doc_col)).alias("_d"))
    items = F.try_variant_get("_d", "$.matches", "array<variant>")
    return parsed.select("_base", F.posexplode(items).alias("_pos", "v")).select((F.col("_base") + F.col("_pos")).alias("match_id"), "v")


def normalize_variants(variants: DataFrame) -> DataFrame:
    """Feed matches -> wire match rows, like ``normalize_feed``, reading only the paths needed: a
    missing part or one of another type is null, parts nobody declared are left alone."""
    at = {n: F.try_variant_get("v", path, kind) for n, (path, kind) in FEED_PATHS.items()}
    team = lambda n: F.struct(at[n].alias("name"))
    goals = F.struct(F.struct(at["home_goals"].alias("home"), at["away_goals"].alias("away")).alias("fullTime"))
    return normalize_feed(variants.select("match_id", at["utcDate"].alias("utcDate"), at["status"].alias("status"), at["venue"].alias("venue"),
                                          team("home").alias("homeTeam"), team("away").alias("awayTeam"), goals.alias("score")))


def feed_schema(variants: DataFrame) -> DataFrame:
    """One row (matches, shape): how many matches there are and the schema of all of them
    together, undeclared parts included (an aggregate, combined in the tasks)."""
    return variants.agg(F.count("v").alias("matches"), F.schema_of_variant_agg("v").alias("shape"))
