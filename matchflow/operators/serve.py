"""Serving queries: search, lookup, facets, top-k, feed, display labels.

F3-F6, F9/F10, O1-O5, U2, P17-P22. Filters are plain column predicates, so
Catalyst pushes them into the parquet scan; on a table written partitioned
by year/month/day, ``match_search`` adds partition predicates next to the
date range so that whole directories are pruned. Top-k uses ``orderBy +
limit`` (TakeOrderedAndProject: a per-partition top-k, then a merge of k rows
per partition -- never a global sort to one task).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchflow.functions import constants as K
from matchflow.functions.scalars import (active_label, category_colour, full_name, initials,
                                         parse_ts_ntz, safe_ts, score_line, status_colour, versus)


def _given(v) -> bool:
    """Absent, 0 and '' mean "no filter" (F3, F5)."""
    return v is not None and v != 0 and v != ""


def _moment(m: DataFrame, date_col: str):
    """The date column as a timestamp; the merged state holds wire text there,
    whose unparsable dates are null and so in no range."""
    text = isinstance(m.schema[date_col].dataType, T.StringType)
    return parse_ts_ntz(date_col) if text else F.col(date_col)


def match_search(m: DataFrame, sport_id=None, statut=None, date_debut=None, date_fin=None,
                 sport_nom=None, date_col: str = "date_match",
                 partition_cols: tuple[str, str, str] | None = None) -> DataFrame:
    """Conditional filter chain; date bounds inclusive.

    ``partition_cols`` names the year/month/day columns of a partitioned
    table: the year range derived from the bounds is added as a predicate on
    them, which prunes directories (a range on the timestamp alone cannot).
    """
    out = m
    if _given(sport_id):
        out = out.where(F.col("sport_id") == F.lit(sport_id))
    if _given(sport_nom):
        out = out.where(F.col("sport_nom") == F.lit(sport_nom))
    if _given(statut):
        out = out.where(F.col("statut") == F.lit(statut))
    d = _moment(m, date_col)
    if _given(date_debut):
        lo = F.lit(date_debut).cast("timestamp_ntz")
        out = out.where(d >= lo)
        if partition_cols:
            out = out.where(F.col(partition_cols[0]) >= F.year(lo))
    if _given(date_fin):
        hi = F.lit(date_fin).cast("timestamp_ntz")
        out = out.where(d <= hi)
        if partition_cols:
            out = out.where(F.col(partition_cols[0]) <= F.year(hi))
    return out


def match_lookup(m: DataFrame, match_id) -> DataFrame:
    """point lookup; an empty result is the "not found" answer."""
    return m.where(F.col("match_id") == F.lit(match_id))


def user_notifications(n: DataFrame, user_id=None) -> DataFrame:
    """notifications of one user; absent or 0 = all users."""
    return n.where(F.col("user_id") == F.lit(user_id)) if _given(user_id) else n


def recent_notifications(n: DataFrame, type_filter=None) -> DataFrame:
    """Newest first; null or unparsable dates sort as the epoch,
    i.e. last. Ties keep id order. A distributed range sort."""
    out = n.where(F.col("type") == F.lit(type_filter)) if _given(type_filter) else n
    out = out.withColumn("date_tri", safe_ts("date_envoi"))
    return out.orderBy(F.col("date_tri").desc(), F.col("notification_id"))


def head(df: DataFrame, n: int = 10, order: str | None = None) -> DataFrame:
    """The first ``n`` rows, in a fixed order so that reruns agree."""
    return (df.orderBy(order) if order else df).limit(n)


def top_sports(per_sport: DataFrame, k: int = 3) -> DataFrame:
    """O3: the ``k`` sports with most matches; ties broken by sport_id."""
    return per_sport.orderBy(F.col("nombre_matchs").desc(), F.col("sport_id")).limit(k)


def activity_feed(matches: DataFrame, notes: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` most recent items of mixed sources (matches, notifications)."""
    mm = matches.select(
        F.lit("match").alias("source"), F.col("match_id").alias("item_id"),
        safe_ts("date_match").alias("moment"),
        F.concat(F.lit("Match "), versus("equipe_domicile", "equipe_exterieur"),
                 F.lit(" "), F.col("statut"), F.lit(": "),
                 score_line(F.coalesce("score_domicile", F.lit(0)),
                            F.coalesce("score_exterieur", F.lit(0)))).alias("texte"))
    nn = notes.select(
        F.lit("notification").alias("source"), F.col("notification_id").alias("item_id"),
        safe_ts("date_envoi").alias("moment"), F.col("contenu").alias("texte"))
    return (mm.unionByName(nn)
              .orderBy(F.col("moment").desc(), F.col("source"), F.col("item_id")).limit(k))


def pick_order(key, seed: int = 0):
    """Seeded pseudo-random rank of a key of any range: the MD5 of ``key:seed``."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat_ws(":", k.cast("string"), F.lit(str(seed))).cast("binary"))


def random_pick(df: DataFrame, key: str, n: int = 1, seed: int = 0) -> DataFrame:
    """``n`` seeded random rows (ties by key). A top-n on the seeded rank:
    per-partition top-n then a merge of n rows per partition -- no ``tail``
    or ``collect`` of the table to the driver."""
    return df.orderBy(pick_order(key, seed), F.col(key)).limit(n)


def facets(matches: DataFrame, notes: DataFrame) -> DataFrame:
    """Distinct choice-list values: sport names, statuses, notification types."""
    parts = [matches.select(F.lit("sport_nom").alias("facette"), F.col("sport_nom").alias("valeur")),
             matches.select(F.lit("statut").alias("facette"), F.col("statut").alias("valeur")),
             notes.select(F.lit("type").alias("facette"), F.col("type").alias("valeur"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


def status_bucket(matches: DataFrame) -> DataFrame:
    """Match status -> display colour (case-insensitive)."""
    return matches.select("match_id", "statut", status_colour("statut").alias("couleur"))


def match_labels(matches: DataFrame) -> DataFrame:
    """P19: "A vs B" and "h - a" display labels."""
    return matches.select(
        "match_id",
        versus("equipe_domicile", "equipe_exterieur").alias("affiche"),
        score_line("score_domicile", "score_exterieur").alias("score"))


def user_labels(users: DataFrame) -> DataFrame:
    """Full name, initials, lower-case email, active label."""
    return users.select(
        "user_id", full_name("prenom", "nom").alias("nom_complet"),
        initials("prenom", "nom").alias("initiales"), F.lower("email").alias("email"),
        active_label("notification_active").alias("notifications"))


def sports_view(sports: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """Sport category -> colour, with each sport's match count when the
    match table is given (counts aggregated first, then joined to the small
    sports dimension; sports without matches show 0)."""
    out = sports.select("sport_id", "nom", "categorie", category_colour("categorie").alias("couleur"))
    if matches is None:
        return out
    counts = matches.groupBy("sport_id").agg(F.count(F.lit(1)).alias("nombre_matchs"))
    return out.join(counts, "sport_id", "left").select(
        "sport_id", "nom", "categorie", "couleur",
        F.coalesce(F.col("nombre_matchs"), F.lit(0)).alias("nombre_matchs"))


def upcoming_matches(m: DataFrame, today: str, days: int = 7,
                     date_col: str = "date_match") -> DataFrame:
    """matches dated from ``today`` to ``today + days`` (inclusive days)."""
    d0 = F.lit(today).cast("date")
    d = F.to_date(_moment(m, date_col))
    return m.where(d.between(d0, F.date_add(d0, days)))


def threshold_branch(products: DataFrame, threshold: float = K.PRICE_THRESHOLD,
                     price_col: str = "prix") -> DataFrame:
    """Does any row reach the price threshold? -> branch label.

    The predicate is pushed into the scan (row groups whose max price is
    below the threshold are skipped) and a global count of the survivors is
    taken with map-side partial aggregation: one row out, no driver loop.
    Where only the branch is asked for, ``reaches`` looks for one row."""
    hits = products.where(F.col(price_col) >= F.lit(threshold))
    a1, a2 = K.BRANCH_LABELS
    return hits.agg(F.count(F.lit(1)).alias("lignes")).select(
        F.when(F.col("lignes") > 0, F.lit(a1)).otherwise(F.lit(a2)).alias("branche"), "lignes")


def reaches(products: DataFrame, threshold: float = K.PRICE_THRESHOLD, price_col: str = "prix") -> bool:
    """Whether any row reaches the threshold; the scan ends with the first found."""
    return not products.where(F.col(price_col) >= F.lit(threshold)).limit(1).isEmpty()
