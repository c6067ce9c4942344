"""Statistics marts: the SQL views, per-batch statistics and API reports.

A1-A16, J1-J3, U1. Everything is a hash aggregate with map-side partial
aggregation; joins only ever meet *aggregated* sides (teams, sports), never
raw match rows.

Two families, on purpose (see SURVEY section 7.3 rule 3):
* ``stats_*`` over the raw match log count *messages*: duplicates and
  partial updates (null sport, null teams) are rows;
* ``*_latest`` and the API reports count *latest matches* (merged state).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchflow.functions import constants as K
from matchflow.functions.scalars import month_key, parse_ts_ntz
from matchflow.plans.strategy import barrier

TEAM_KEYS = ["sport_id", "sport_nom", "equipe"]


def stats_matchs(m: DataFrame) -> DataFrame:
    """A1: matches by (sport, statut): count and average scores."""
    return m.groupBy("sport_id", "sport_nom", "statut").agg(
        F.count(F.lit(1)).alias("nombre_matchs"),
        F.avg("score_domicile").alias("moyenne_score_domicile"),
        F.avg("score_exterieur").alias("moyenne_score_exterieur"))


def stats_sportifs(m: DataFrame) -> DataFrame:
    """A2: by sport: count, goal sums, distinct home teams + distinct away teams
    (a team playing on both sides counts twice, as in the source view)."""
    return m.groupBy("sport_id", "sport_nom").agg(
        F.count(F.lit(1)).alias("nombre_matchs"),
        F.sum("score_domicile").alias("total_buts_domicile"),
        F.sum("score_exterieur").alias("total_buts_exterieur"),
        (F.countDistinct("equipe_domicile") + F.countDistinct("equipe_exterieur"))
        .alias("nombre_equipes"))


def _side_totals(m: DataFrame) -> DataFrame:
    """Home and away totals of every (sport_id, sport_nom, equipe) from ONE scan
    and ONE aggregate: each match row is unpivoted into its home and its away
    view; the aggregate keeps both sides' counts and sums as columns.

    The result sits behind ``barrier`` so that the home view, the away view
    and both join branches all reuse this single aggregate's exchange."""
    home = F.struct(F.lit("d").alias("side"), F.col("equipe_domicile").alias("equipe"),
                    F.col("score_domicile").alias("pour"), F.col("score_exterieur").alias("contre"))
    away = F.struct(F.lit("e").alias("side"), F.col("equipe_exterieur").alias("equipe"),
                    F.col("score_exterieur").alias("pour"), F.col("score_domicile").alias("contre"))
    u = m.select("sport_id", "sport_nom", F.explode(F.array(home, away)).alias("t")).select(
        "sport_id", "sport_nom", "t.*")
    aggs = []
    for sd in ("d", "e"):
        on = F.col("side") == sd
        aggs += [F.count_if(on).alias(f"{sd}_n"),
                 F.sum(F.when(on, F.col("pour"))).alias(f"{sd}_pour"),
                 F.sum(F.when(on, F.col("contre"))).alias(f"{sd}_contre")]
    return barrier(u.groupBy(*TEAM_KEYS).agg(*aggs))


def _side(totals: DataFrame, sd: str) -> DataFrame:
    """One side's groups (those where the team played on that side)."""
    return totals.where(F.col(f"{sd}_n") > 0).select(
        *TEAM_KEYS, F.col(f"{sd}_n").alias("nombre_matchs_joues"),
        F.col(f"{sd}_pour").alias("buts_marques"), F.col(f"{sd}_contre").alias("buts_encaisses"))


def stats_equipes_domicile(m: DataFrame) -> DataFrame:
    """A3: home team totals."""
    return m.groupBy("sport_id", "sport_nom", F.col("equipe_domicile").alias("equipe")).agg(
        F.count(F.lit(1)).alias("nombre_matchs_joues"),
        F.sum("score_domicile").alias("buts_marques"),
        F.sum("score_exterieur").alias("buts_encaisses"))


def stats_equipes_exterieur(m: DataFrame) -> DataFrame:
    """A4: away team totals (scored / conceded swapped)."""
    return m.groupBy("sport_id", "sport_nom", F.col("equipe_exterieur").alias("equipe")).agg(
        F.count(F.lit(1)).alias("nombre_matchs_joues"),
        F.sum("score_exterieur").alias("buts_marques"),
        F.sum("score_domicile").alias("buts_encaisses"))


def _combine(a: DataFrame, b: DataFrame) -> DataFrame:
    """``a`` LEFT JOIN ``b`` on (sport_id, equipe); a's names, summed totals with
    b's side defaulted to 0 (a's own null sums stay null)."""
    bb = b.select(F.col("sport_id").alias("_b_sport_id"), F.col("equipe").alias("_b_equipe"),
                  F.col("nombre_matchs_joues").alias("_b_n"),
                  F.col("buts_marques").alias("_b_pour"), F.col("buts_encaisses").alias("_b_contre"))
    j = a.join(bb, (a.sport_id == bb._b_sport_id) & (a.equipe == bb._b_equipe), "left")
    return j.select(
        "sport_id", "sport_nom", "equipe",
        (F.col("nombre_matchs_joues") + F.coalesce("_b_n", F.lit(0))).alias("total_matchs"),
        (F.col("buts_marques") + F.coalesce("_b_pour", F.lit(0))).alias("total_buts_marques"),
        (F.col("buts_encaisses") + F.coalesce("_b_contre", F.lit(0))).alias("total_buts_encaisses"))


def team_home_left(m: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Home totals LEFT JOIN away totals on (sport_id, equipe)."""
    s = totals if totals is not None else _side_totals(m)
    return _combine(_side(s, "d"), _side(s, "e"))


def team_away_only(m: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Away-only teams (no home group with the same (sport_id, equipe));
    null keys never match, so a null-team away group is always kept."""
    s = totals if totals is not None else _side_totals(m)
    d, e = _side(s, "d"), _side(s, "e")
    anti = e.join(d.select("sport_id", "equipe"), ["sport_id", "equipe"], "left_anti")
    return anti.select("sport_id", "sport_nom", "equipe",
                       F.col("nombre_matchs_joues").alias("total_matchs"),
                       F.col("buts_marques").alias("total_buts_marques"),
                       F.col("buts_encaisses").alias("total_buts_encaisses"))


def team_totals(m: DataFrame) -> DataFrame:
    """Combined team totals = J1 UNION (distinct) J2.

    Faithful to the source view, including its null-team behaviour: null keys
    never join, so a null team can yield two rows (home view and away view)
    that collapse only when their totals are equal. Plan: one scan, one
    aggregate for both sides (reused by both branches), joins on aggregates.
    """
    totals = _side_totals(m)
    return team_home_left(m, totals).unionByName(team_away_only(m, totals)).distinct()


def team_totals_unpivot(m: DataFrame) -> DataFrame:
    """Faster combine for validated input (non-null teams, one sport name per
    (sport, team)): one aggregate over both sides, no join."""
    s = _side_totals(m)
    return s.select(*TEAM_KEYS, (F.col("d_n") + F.col("e_n")).alias("total_matchs"),
                    _add_sums("d_pour", "e_pour").alias("total_buts_marques"),
                    _add_sums("d_contre", "e_contre").alias("total_buts_encaisses"))


def _add_sums(a: str, b: str):
    """Sum of two side sums where a missing side counts as nothing."""
    return F.when(F.col(a).isNull() & F.col(b).isNull(), F.lit(None)).otherwise(
        F.coalesce(F.col(a), F.lit(0)) + F.coalesce(F.col(b), F.lit(0)))


def stats_notifications(n: DataFrame) -> DataFrame:
    """A5: notifications by type: count, distinct users, distinct matches."""
    return n.groupBy("type").agg(
        F.count(F.lit(1)).alias("nombre_notifications"),
        F.countDistinct("user_id").alias("nombre_utilisateurs_distincts"),
        F.countDistinct("match_id").alias("nombre_matchs_distincts"))


def stats_notification_groups(groups: DataFrame, members: DataFrame) -> DataFrame:
    """A5 of the notifications that groups stand for (``notify.expand_groups``), without making them: a
    group counts its audience's members, and each audience's users are told apart once for a
    type. A group without members is no notification."""
    to = ["audience", "sport_id"]
    sent = groups.join(members.groupBy(*to).agg(F.count(F.lit(1)).alias("_n")), to)
    counts = sent.groupBy("type").agg(F.sum("_n").alias("nombre_notifications"),
                                      F.countDistinct("match_id").alias("nombre_matchs_distincts"))
    users = sent.select(F.col("type").alias("_type"), *to).distinct().join(members, to) \
        .groupBy("_type").agg(F.countDistinct("user_id").alias("nombre_utilisateurs_distincts"))
    return counts.join(users, F.col("type").eqNullSafe(F.col("_type"))).select(
        "type", "nombre_notifications", "nombre_utilisateurs_distincts", "nombre_matchs_distincts")


def stats_notifications_approx(n: DataFrame, rsd: float = 0.02) -> DataFrame:
    """A5 with HyperLogLog distinct counts: no Expand, fixed-size state."""
    return n.groupBy("type").agg(
        F.count(F.lit(1)).alias("nombre_notifications"),
        F.approx_count_distinct("user_id", rsd).alias("nombre_utilisateurs_distincts"),
        F.approx_count_distinct("match_id", rsd).alias("nombre_matchs_distincts"))


def matches_per_sport(m: DataFrame) -> DataFrame:
    """Match count by (sport_id, sport_nom)."""
    return m.groupBy("sport_id", "sport_nom").agg(F.count(F.lit(1)).alias("nombre_matchs"))


def favourite_counts(users: DataFrame) -> DataFrame:
    """Favourite popularity; null or empty favourite lists add nothing."""
    return (users.select(F.explode("sports_favoris").alias("sport_id"))
                 .groupBy("sport_id").agg(F.count(F.lit(1)).alias("nombre_utilisateurs")))


def notifications_per_type(n: DataFrame) -> DataFrame:
    """Notification count by type."""
    return n.groupBy("type").agg(F.count(F.lit(1)).alias("nombre_notifications"))


def matches_per_sport_latest(state: DataFrame, order: str = "first_offset") -> DataFrame:
    """A10: latest matches by sport_id; the name is the one of the match seen
    first (the source keeps matches in first-seen order)."""
    return state.groupBy("sport_id").agg(
        F.min_by("sport_nom", F.col(order)).alias("nom"),
        F.count(F.lit(1)).alias("nombre_matchs"))


def matches_per_status(state: DataFrame) -> DataFrame:
    """Exactly the three counted statuses, 0 when absent; others ignored.

    One global aggregate of three conditional counts, then unpivoted to rows --
    no join and no shuffle of match rows."""
    sts = K.COUNTED_STATUSES
    agg = state.agg(*[F.count_if(F.col("statut") == s).alias(f"c{i}") for i, s in enumerate(sts)])
    rows = F.array(*[F.struct(F.lit(s).alias("statut"), F.col(f"c{i}").alias("nombre_matchs"))
                     for i, s in enumerate(sts)])
    return agg.select(F.inline(rows))


def matches_per_month(state: DataFrame, date_col: str = "date_match") -> DataFrame:
    """Count by ``yyyy-MM`` of the match date (unparsable dates -> null month)."""
    return state.groupBy(month_key(parse_ts_ntz(date_col)).alias("mois")).agg(
        F.count(F.lit(1)).alias("nombre_matchs"))


def unread_count(n: DataFrame) -> DataFrame:
    """Number of notifications still 'envoyée'."""
    return n.agg(F.count_if(F.col("statut") == K.SENT_STATUS).alias("non_lues"))


def dashboard_kpis(state: DataFrame) -> DataFrame:
    """One row -- sports with matches, matches per counted status and their
    sum (the intended total; the source UI reads a wrong key and shows NaN)."""
    p, c, t = K.COUNTED_STATUSES
    st = F.col("statut")
    return state.agg(
        F.countDistinct("sport_id").alias("sports"),
        F.count_if(st == p).alias("programmes"),
        F.count_if(st == c).alias("en_cours"),
        F.count_if(st == t).alias("termines"),
        F.count_if(st.isin(p, c, t)).alias("total"))


def table_counts(**tables: DataFrame) -> DataFrame:
    """Size of every collection, one row each (``collection``, ``n``)."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("collection"), "n")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
