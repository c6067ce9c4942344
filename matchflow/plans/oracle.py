"""DuckDB oracle SQL for every registered query.

Written independently of the Spark code: the adapters are the SQL of
FIXTURES.md, the merge is formulated with "last full record" lookups instead
of struct maxima, rendering uses ``str.format`` on the fixed templates.
DuckDB types are cast where they differ from Spark's (SUM -> HUGEINT,
``year()`` -> BIGINT).
"""

from __future__ import annotations

from matchflow.functions import constants as K
from matchflow.plans import queries as Q

_MATCHS = """matchs AS (
  SELECT o.o_orderkey + 1 AS match_id, CAST(n.n_regionkey + 1 AS INTEGER) AS sport_id,
    r.r_name AS sport_nom, n.n_name AS equipe_domicile, x.n_name AS equipe_exterieur,
    CAST(o.o_custkey % 6 AS INTEGER) AS score_domicile, CAST(o.o_orderkey % 5 AS INTEGER) AS score_exterieur,
    o.o_orderdate AS date_match, o.o_orderpriority AS lieu,
    CASE o.o_orderstatus WHEN 'P' THEN 'programmé' WHEN 'O' THEN 'en cours' ELSE 'terminé' END AS statut
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN nation x ON x.n_nationkey = (n.n_nationkey + 5 * (1 + o.o_orderkey % 4)) % 25)"""

_LOG = """match_log AS (
  SELECT 4 * match_id AS log_offset, date_match AS log_ts, true AS is_full, match_id, sport_id,
    sport_nom, equipe_domicile, equipe_exterieur,
    CASE WHEN statut <> 'programmé' THEN score_domicile END AS score_domicile,
    CASE WHEN statut <> 'programmé' THEN score_exterieur END AS score_exterieur,
    CASE lieu WHEN '1-URGENT' THEN strftime(date_match, '%Y-%m-%dT%H:%M:%SZ')
              WHEN '4-NOT SPECIFIED' THEN 'date inconnue'
              ELSE strftime(date_match, '%Y-%m-%d %H:%M:%S') END AS date_match,
    lieu, statut, CAST(NULL AS VARCHAR) AS derniere_mise_a_jour, statut <> 'programmé' AS has_score
  FROM matchs
  UNION ALL
  SELECT 4 * match_id + 1, date_match + INTERVAL 2 HOUR, false, match_id, NULL, NULL, NULL, NULL,
    score_domicile + 1, score_exterieur, NULL, NULL, 'terminé',
    strftime(date_match + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S'), true
  FROM matchs WHERE match_id % 3 = 0
  UNION ALL
  SELECT 4 * match_id + 2, date_match + INTERVAL 1 HOUR, false, -match_id, NULL, NULL,
    NULL, NULL, 1, 2, NULL, NULL, 'en cours',
    strftime(date_match + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S'), true
  FROM matchs WHERE match_id % 50 = 0)"""

_MERGED = """lg AS (SELECT * FROM match_log WHERE match_id IS NOT NULL AND match_id <> 0),
agg AS (
  SELECT match_id,
    MAX(log_offset) FILTER (WHERE is_full) AS lf,
    MIN(log_offset) AS first_offset, MAX(log_offset) AS last_offset,
    arg_min(log_ts, log_offset) AS first_ts,
    arg_max_null(statut, log_offset) AS statut,
    arg_max_null(CASE WHEN has_score THEN score_domicile ELSE 0 END, log_offset) AS score_domicile,
    arg_max_null(CASE WHEN has_score THEN score_exterieur ELSE 0 END, log_offset) AS score_exterieur,
    arg_max_null(derniere_mise_a_jour, log_offset) FILTER (WHERE NOT is_full) AS last_upd,
    MAX(log_offset) FILTER (WHERE NOT is_full) AS last_upd_off
  FROM lg GROUP BY match_id),
merged AS (
  SELECT a.match_id,
    CASE WHEN a.lf IS NULL THEN 0 ELSE f.sport_id END AS sport_id,
    CASE WHEN a.lf IS NULL THEN 'Inconnu' ELSE f.sport_nom END AS sport_nom,
    CASE WHEN a.lf IS NULL THEN 'Équipe A' ELSE f.equipe_domicile END AS equipe_domicile,
    CASE WHEN a.lf IS NULL THEN 'Équipe B' ELSE f.equipe_exterieur END AS equipe_exterieur,
    a.score_domicile, a.score_exterieur,
    CASE WHEN a.lf IS NULL THEN strftime(a.first_ts, '%Y-%m-%d %H:%M:%S') ELSE f.date_match END AS date_match,
    CASE WHEN a.lf IS NULL THEN 'Lieu inconnu' ELSE f.lieu END AS lieu,
    a.statut,
    CASE WHEN a.lf IS NULL OR a.last_upd_off > a.lf THEN a.last_upd END AS derniere_mise_a_jour,
    a.first_offset, a.last_offset
  FROM agg a LEFT JOIN lg f ON f.match_id = a.match_id AND f.log_offset = a.lf)"""

_USERS = """users AS (
  SELECT c_custkey + 1 AS user_id, c_mktsegment AS prenom, c_name AS nom,
    lower(concat(c_mktsegment, '.', c_name, '@example.com')) AS email,
    [CAST(c_custkey % 5 + 1 AS INTEGER), CAST((c_custkey + 1 + c_custkey % 3) % 5 + 1 AS INTEGER)] AS sports_favoris,
    CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 7 < 3 THEN false ELSE true END AS notification_active
  FROM customer)"""

_NOTES = """notifications AS (
  SELECT event_id AS notification_id, user_id + 1 AS user_id, (event_id - event_id % 3) // 3 + 1 AS match_id,
    CASE event_type WHEN 'signup' THEN 'programmé' WHEN 'view' THEN 'rappel' WHEN 'click' THEN 'debut_match'
      WHEN 'purchase' THEN 'but' ELSE 'carton' END AS type,
    props AS contenu, strftime(ts, '%Y-%m-%d %H:%M:%S') AS date_envoi,
    CASE WHEN value < 50 THEN 'envoyée' ELSE 'lue' END AS statut
  FROM events)"""

_SPORTS = """sports AS (
  SELECT CAST(r_regionkey + 1 AS INTEGER) AS sport_id, r_name AS nom,
    CASE WHEN r_regionkey % 2 = 0 THEN 'Collectif' ELSE 'Individuel' END AS categorie,
    CAST(r_regionkey * 2 + 3 AS INTEGER) AS nombre_joueurs, 'Sport ' || r_name AS description
  FROM region)"""

_AUDIENCE = """aud AS (
  SELECT user_id, sport_id FROM (
    SELECT user_id, notification_active, unnest(list_distinct(sports_favoris)) AS sport_id FROM users)
  WHERE COALESCE(notification_active, true) AND sport_id IS NOT NULL)"""

MATCH_COLS = ("sport_id, sport_nom, equipe_domicile, equipe_exterieur, score_domicile, "
              "score_exterieur, date_match, lieu, statut, derniere_mise_a_jour")


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _type_expr(key: str = "match_id") -> str:
    h = f"(({key} * 31) % 100)"
    live = "[" + ", ".join(_sq(t) for t in K.LIVE_EVENT_TYPES) + "]"
    return (f"CASE WHEN COALESCE(statut, {_sq(K.STATUS_LABEL_DEFAULT)}) = {_sq(K.LIVE_STATUS)} "
            f"AND {h} < {K.LIVE_EVENT_PERCENT} THEN {live}[{h} % {len(K.LIVE_EVENT_TYPES)} + 1] "
            f"ELSE COALESCE(statut, {_sq(K.STATUS_LABEL_DEFAULT)}) END")


def _render_expr(key: str = "match_id") -> str:
    home = f"COALESCE(equipe_domicile, {_sq(K.TEAM_HOME_DEFAULT)})"
    away = f"COALESCE(equipe_exterieur, {_sq(K.TEAM_AWAY_DEFAULT)})"
    sh, sa = "CAST(COALESCE(score_domicile, 0) AS VARCHAR)", "CAST(COALESCE(score_exterieur, 0) AS VARCHAR)"
    home_scores = f"(({key} * 17) % 2) = 0"
    slots = {
        "equipe_domicile": home, "equipe_exterieur": away, "score_domicile": sh,
        "score_exterieur": sa,
        "equipe_marqueuse": f"CASE WHEN {home_scores} THEN {home} ELSE {away} END",
        "equipe_adverse": f"CASE WHEN {home_scores} THEN {away} ELSE {home} END",
        "type_carton": f"CASE WHEN (({key} * 13) % 2) = 0 THEN {_sq(K.CARD_COLOURS[0])} "
                       f"ELSE {_sq(K.CARD_COLOURS[1])} END",
        "equipe": f"CASE WHEN (({key} * 7) % 2) = 0 THEN {home} ELSE {away} END",
    }

    def sql_text(template: str) -> str:
        marked = template.replace("'", "''").format(**{k: "'||" + v + "||'" for k, v in slots.items()})
        return "('" + marked + "')"

    whens = " ".join(f"WHEN {_sq(t)} THEN {sql_text(tpl)}" for t, tpl in K.TEMPLATES.items())
    return f"CASE type {whens} ELSE {sql_text(K.TEMPLATE_FALLBACK)} END"


def _status_colour(col: str) -> str:
    whens = " ".join(f"WHEN lower({col}) IN ({', '.join(_sq(v) for v in vals)}) THEN {_sq(c)}"
                     for c, vals in K.STATUS_COLOURS.items())
    return f"CASE {whens} ELSE 'default' END"


def _map_case(col: str, mapping, default: str) -> str:
    whens = " ".join(f"WHEN {_sq(k) if isinstance(k, str) else k} THEN {_sq(v)}" for k, v in mapping.items())
    return f"CASE {col} {whens} ELSE {default} END"


_FEED = """feed AS (
  SELECT 1000 + ((match_id - 1) // 100) * 100
           + row_number() OVER (PARTITION BY (match_id - 1) // 100 ORDER BY match_id) - 1 AS fid,
    ['SCHEDULED', 'TIMED', 'IN_PLAY', 'PAUSED', 'FINISHED', 'LIVE', 'POSTPONED'][match_id % 7 + 1] AS code,
    * FROM matchs)"""


def oracle_sql() -> dict[str, str]:
    m, lgc, mg = _MATCHS, _LOG, _MERGED
    s = {}
    s["stats_matchs"] = _with(m, lgc) + """SELECT sport_id, sport_nom, statut, COUNT(*) AS nombre_matchs,
  AVG(score_domicile) AS moyenne_score_domicile, AVG(score_exterieur) AS moyenne_score_exterieur
FROM match_log GROUP BY sport_id, sport_nom, statut"""
    s["stats_sportifs"] = _with(m, lgc) + """SELECT sport_id, sport_nom, COUNT(*) AS nombre_matchs,
  CAST(SUM(score_domicile) AS BIGINT) AS total_buts_domicile,
  CAST(SUM(score_exterieur) AS BIGINT) AS total_buts_exterieur,
  COUNT(DISTINCT equipe_domicile) + COUNT(DISTINCT equipe_exterieur) AS nombre_equipes
FROM match_log GROUP BY sport_id, sport_nom"""
    # Every match once for each side; a team's home and away figures side by side.
    side = """sides AS (
  SELECT sport_id, sport_nom, equipe_domicile AS equipe, true AS home, score_domicile AS pour, score_exterieur AS contre FROM match_log
  UNION ALL SELECT sport_id, sport_nom, equipe_exterieur, false, score_exterieur, score_domicile FROM match_log),
team AS (SELECT sport_id, sport_nom, equipe, sport_id IS NOT NULL AND equipe IS NOT NULL AS named,
    COUNT(*) FILTER (home) AS n_home, COUNT(*) FILTER (NOT home) AS n_away,
    CAST(SUM(pour) FILTER (home) AS BIGINT) AS for_home, CAST(SUM(pour) FILTER (NOT home) AS BIGINT) AS for_away,
    CAST(SUM(contre) FILTER (home) AS BIGINT) AS against_home, CAST(SUM(contre) FILTER (NOT home) AS BIGINT) AS against_away
  FROM sides GROUP BY sport_id, sport_nom, equipe)"""

    def one_side(x: str) -> str:
        return f"""SELECT sport_id, sport_nom, equipe, n_{x} AS nombre_matchs_joues, for_{x} AS buts_marques,
  against_{x} AS buts_encaisses FROM team WHERE n_{x} > 0"""

    def totals(x: str, other: str, also: str) -> str:
        """Figures of side x, with the other side's for teams with a name (null keys join nothing)."""
        plus = lambda c: f"{c}_{x} + CASE WHEN named THEN COALESCE({c}_{other}, 0) ELSE 0 END"
        return f"""SELECT sport_id, sport_nom, equipe, {plus('n')} AS total_matchs, {plus('for')} AS total_buts_marques,
  {plus('against')} AS total_buts_encaisses FROM team WHERE n_{x} > 0{also}"""

    home_left, away_only = totals("home", "away", ""), totals("away", "home", " AND NOT (named AND n_home > 0)")
    s["stats_equipes_domicile"] = _with(m, lgc, side) + one_side("home")
    s["stats_equipes_exterieur"] = _with(m, lgc, side) + one_side("away")
    s["team_home_left"] = _with(m, lgc, side) + home_left
    s["team_away_only"] = _with(m, lgc, side) + away_only
    s["team_totals"] = _with(m, lgc, side) + f"SELECT DISTINCT * FROM ({home_left} UNION ALL {away_only})"
    s["matches_per_sport"] = _with(m, lgc) + """SELECT sport_id, sport_nom, COUNT(*) AS nombre_matchs
FROM match_log GROUP BY sport_id, sport_nom"""
    s["stats_notifications"] = _with(_NOTES) + """SELECT type, COUNT(*) AS nombre_notifications,
  COUNT(DISTINCT user_id) AS nombre_utilisateurs_distincts, COUNT(DISTINCT match_id) AS nombre_matchs_distincts
FROM notifications GROUP BY type"""
    s["notifications_per_type"] = _with(_NOTES) + """SELECT type, COUNT(*) AS nombre_notifications
FROM notifications GROUP BY type"""
    s["favourite_counts"] = _with(_USERS) + """SELECT sport_id, COUNT(*) AS nombre_utilisateurs
FROM (SELECT unnest(sports_favoris) AS sport_id FROM users) GROUP BY sport_id"""
    s["unread_count"] = _with(_NOTES) + f"""SELECT COUNT(*) FILTER (WHERE statut = {_sq(K.SENT_STATUS)}) AS non_lues
FROM notifications"""

    s["latest_per_key"] = _with(m, lgc) + f"""SELECT match_id, {MATCH_COLS}, log_offset FROM (
  SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY log_offset DESC) AS rn FROM match_log)
WHERE rn = 1"""
    s["merge_partial"] = _with(m, lgc, mg) + "SELECT * FROM merged"
    s["stats_matchs_latest"] = _with(m, lgc, mg) + """SELECT sport_id, sport_nom, statut, COUNT(*) AS nombre_matchs,
  AVG(score_domicile) AS moyenne_score_domicile, AVG(score_exterieur) AS moyenne_score_exterieur
FROM merged GROUP BY sport_id, sport_nom, statut"""
    side_latest = side.replace("FROM match_log", "FROM merged")
    s["team_totals_latest"] = _with(m, lgc, mg, side_latest) + f"SELECT DISTINCT * FROM ({home_left} UNION ALL {away_only})"
    s["matches_per_sport_latest"] = _with(m, lgc, mg) + """SELECT sport_id, arg_min(sport_nom, first_offset) AS nom,
  COUNT(*) AS nombre_matchs FROM merged GROUP BY sport_id"""
    vals = ", ".join(f"({_sq(v)}, {i})" for i, v in enumerate(K.COUNTED_STATUSES))
    s["matches_per_status"] = _with(m, lgc, mg) + f"""SELECT s.statut, COALESCE(c.n, 0) AS nombre_matchs
FROM (VALUES {vals}) s(statut, ord)
LEFT JOIN (SELECT statut, COUNT(*) AS n FROM merged GROUP BY statut) c ON s.statut = c.statut"""
    s["matches_per_month"] = _with(m, lgc, mg) + """SELECT strftime(TRY_CAST(date_match AS TIMESTAMP), '%Y-%m') AS mois,
  COUNT(*) AS nombre_matchs FROM merged GROUP BY 1"""
    p, c, t = (_sq(x) for x in K.COUNTED_STATUSES)
    s["dashboard_kpis"] = _with(m, lgc, mg) + f"""SELECT COUNT(DISTINCT sport_id) AS sports,
  COUNT(*) FILTER (WHERE statut = {p}) AS programmes, COUNT(*) FILTER (WHERE statut = {c}) AS en_cours,
  COUNT(*) FILTER (WHERE statut = {t}) AS termines, COUNT(*) FILTER (WHERE statut IN ({p}, {c}, {t})) AS total
FROM merged"""
    s["table_counts"] = _with(m, lgc, mg) + """SELECT 'sports' AS collection, COUNT(*) AS n FROM region
UNION ALL SELECT 'matchs', COUNT(*) FROM merged
UNION ALL SELECT 'users', COUNT(*) FROM customer
UNION ALL SELECT 'notifications', COUNT(*) FROM events"""
    s["upsert_batch"] = _with(_USERS) + """SELECT u.user_id, u.prenom, u.nom, u.email,
  array_to_string(u.sports_favoris, ',') AS sports_favoris,
  CASE WHEN c.c_acctbal < 0 THEN false ELSE u.notification_active END AS notification_active,
  CAST(CASE WHEN c.c_acctbal < 0 THEN 1 ELSE 0 END AS BIGINT) AS log_offset
FROM users u JOIN customer c ON u.user_id = c.c_custkey + 1"""

    full_k = "date_match,equipe_domicile,equipe_exterieur,lieu,match_id,score_domicile,score_exterieur,sport_id,sport_nom,statut"
    sched_k = "date_match,equipe_domicile,equipe_exterieur,lieu,match_id,sport_id,sport_nom,statut"
    part_k = "derniere_mise_a_jour,match_id,score_domicile,score_exterieur,statut"
    s["topic_decode"] = _with(m, lgc) + f"""SELECT log_offset, match_id, {MATCH_COLS},
  CASE WHEN NOT is_full THEN '{part_k}' WHEN has_score THEN '{full_k}' ELSE '{sched_k}' END AS present_keys
FROM match_log"""
    s["typed_dates"] = _with(m, lgc) + """SELECT log_offset, match_id,
  TRY_CAST(date_match AS TIMESTAMP) AS date_match_ts,
  TRY_CAST(derniere_mise_a_jour AS TIMESTAMP) AS derniere_mise_a_jour_ts FROM match_log"""
    s["partition_counts"] = _with(m, lgc) + """SELECT CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
  COUNT(*) AS nombre_matchs
FROM (SELECT TRY_CAST(date_match AS TIMESTAMP) AS ts FROM match_log) GROUP BY 1, 2"""
    s["stream_state"] = s["state_buckets"] = s["stream_state_processor"] = s["merge_partial"]
    s["state_sports"] = _with(_SPORTS) + "SELECT * FROM sports"
    s["state_users"] = _with(_USERS) + """SELECT user_id, prenom, nom, email, array_to_string(sports_favoris, ',') AS sports_favoris,
  notification_active FROM users"""
    s["state_notifications"] = _with(_NOTES) + """SELECT CAST(notification_id AS VARCHAR) AS notification_id, user_id, match_id, type, contenu,
  date_envoi, statut FROM notifications"""
    s["table_counts_stream"] = s["table_counts"]
    s["stats_notifications_sketched"] = s["stats_notifications"]
    for name in ("matches_per_status", "matches_per_month"):
        s[f"{name}_delta"] = s[name]
    s["stats_matchs_delta"] = s["stats_matchs_latest"]
    s["state_changes"] = _with(m, lgc, mg) + """, a AS (SELECT match_id, log_offset, statut, COALESCE(score_domicile, 0) AS score_domicile,
  COALESCE(score_exterieur, 0) AS score_exterieur FROM match_log WHERE log_offset % 4 = 0 AND match_id % 5 <> 0),
b AS (SELECT * FROM merged WHERE lieu IS DISTINCT FROM '5-LOW')
SELECT COALESCE(a.match_id, b.match_id) AS match_id,
  CASE WHEN a.match_id IS NULL THEN 'insert' WHEN b.match_id IS NULL THEN 'delete' ELSE 'update' END AS type,
  a.statut AS statut_avant, a.score_domicile AS score_domicile_avant, a.score_exterieur AS score_exterieur_avant,
  b.statut AS statut_apres, b.score_domicile AS score_domicile_apres, b.score_exterieur AS score_exterieur_apres
FROM a FULL OUTER JOIN b ON a.match_id = b.match_id WHERE a.match_id IS NULL OR b.match_id IS NULL OR a.log_offset <> b.last_offset"""
    s["stream_ingest"] = _with(m, lgc) + """SELECT CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
  CAST(day(ts) AS INTEGER) AS day, COUNT(*) AS nombre_matchs
FROM (SELECT TRY_CAST(date_match AS TIMESTAMP) AS ts FROM match_log) GROUP BY 1, 2, 3"""
    s["stream_stats"] = _with(m, lgc, _USERS, _NOTES) + """SELECT 'matchs' AS collection, CAST(sport_id AS VARCHAR) AS groupe,
  COUNT(*) AS nombre FROM match_log GROUP BY sport_id
UNION ALL SELECT 'users', CAST(sport_id AS VARCHAR), COUNT(*) FROM (SELECT unnest(sports_favoris) AS sport_id FROM users) GROUP BY sport_id
UNION ALL SELECT 'notifications', type, COUNT(*) FROM notifications GROUP BY type"""
    s["notify_roundtrip"] = _with(m, lgc, _USERS, _AUDIENCE) + f"""SELECT ev.type, COUNT(*) AS nombre_notifications,
  COUNT(DISTINCT aud.user_id) AS nombre_utilisateurs_distincts, COUNT(DISTINCT ev.match_id) AS nombre_matchs_distincts
FROM (SELECT match_id, sport_id, {_type_expr("log_offset")} AS type FROM match_log WHERE sport_id IS NOT NULL) ev
JOIN aud ON ev.sport_id = aud.sport_id GROUP BY ev.type"""
    s["encode_json"] = _with(m) + """SELECT match_id, CAST(to_json({'match_id': match_id, 'sport_id': sport_id,
  'sport_nom': sport_nom, 'equipe_domicile': equipe_domicile, 'equipe_exterieur': equipe_exterieur,
  'score_domicile': score_domicile, 'score_exterieur': score_exterieur,
  'date_match': strftime(date_match, '%Y-%m-%d %H:%M:%S'), 'lieu': lieu, 'statut': statut}) AS VARCHAR) AS value
FROM matchs"""
    s["valid_rows"] = _with(m, lgc) + """SELECT raison, COUNT(*) AS nombre FROM (
  SELECT 'valide' AS raison FROM match_log
  UNION ALL
  SELECT CASE event_type WHEN 'error' THEN 'not_an_object' WHEN 'click' THEN 'bad_key'
    WHEN 'view' THEN 'missing_key' WHEN 'signup' THEN 'not_an_object' ELSE 'zero_key' END FROM events)
GROUP BY raison"""
    s["raw_scan"] = _with(m, lgc) + f"""SELECT match_id, {MATCH_COLS} FROM match_log"""
    s["score_defaults"] = _with(m, lgc) + """SELECT log_offset, match_id, COALESCE(score_domicile, 0) AS score_domicile,
  COALESCE(score_exterieur, 0) AS score_exterieur FROM match_log"""
    ins = _map_case("code", K.STATUS_LABELS_INSERT, _sq(K.STATUS_LABEL_DEFAULT))
    upd = _map_case("code", K.STATUS_LABELS_UPDATE, _sq(K.STATUS_LABEL_DEFAULT))
    s["feed_normalize"] = _with(m, _FEED) + f"""SELECT fid AS match_id, 1 AS sport_id, 'Football' AS sport_nom,
  equipe_domicile, equipe_exterieur,
  CASE WHEN code IN ('SCHEDULED', 'TIMED') THEN 0 ELSE score_domicile END AS score_domicile,
  CASE WHEN code IN ('SCHEDULED', 'TIMED') THEN 0 ELSE score_exterieur END AS score_exterieur,
  CASE WHEN lieu = '4-NOT SPECIFIED' THEN 'TBD' ELSE strftime(date_match, '%Y-%m-%d %H:%M:%S') END AS date_match,
  lieu, {ins} AS statut
FROM feed"""
    s["feed_normalize_variant"] = s["feed_normalize"]
    s["status_map"] = _with(m, _FEED) + f"""SELECT fid AS match_id, code, {ins} AS statut_insert, {upd} AS statut_update
FROM feed"""

    s["notify_audience"] = _with(_USERS, _AUDIENCE) + "SELECT user_id, sport_id FROM aud"
    s["notify_type"] = _with(m) + f"SELECT match_id, {_type_expr()} AS type FROM matchs WHERE sport_id IS NOT NULL"
    s["notify_render"] = _with(m) + f"""SELECT match_id, sport_id, type, {_render_expr()} AS contenu
FROM (SELECT *, {_type_expr()} AS type FROM matchs WHERE sport_id IS NOT NULL)"""
    s["notify_fanout"] = _with(m, _USERS, _AUDIENCE) + f"""SELECT 
  aud.user_id, ev.match_id, ev.type
FROM (SELECT match_id, sport_id, {_type_expr()} AS type FROM matchs WHERE sport_id IS NOT NULL) ev
JOIN aud ON ev.sport_id = aud.sport_id"""
    s["notify_counts"] = _with(m, _USERS, _AUDIENCE) + f"""SELECT ev.match_id, ev.type, COUNT(*) AS destinataires
FROM (SELECT match_id, sport_id, {_type_expr()} AS type FROM matchs WHERE sport_id IS NOT NULL) ev
JOIN aud ON ev.sport_id = aud.sport_id GROUP BY ev.match_id, ev.type"""
    s["new_notifications"] = _with(_NOTES) + f"""SELECT n.notification_id, n.user_id, n.statut,
  k.id IS NULL AS is_new, (n.statut = {_sq(K.SENT_STATUS)} OR k.id IS NULL) AS nouvelle
FROM notifications n
LEFT JOIN (SELECT DISTINCT notification_id AS id FROM notifications WHERE date_envoi < {_sq(Q.POLL_CUTOFF)}) k
  ON n.notification_id = k.id"""
    names = " ".join(f"WHEN {k} THEN {_sq(v)}" for k, v in K.SPORT_NAMES.items())
    s["favourite_names"] = _with(_USERS) + f"""SELECT user_id, CAST(position AS INTEGER) AS position, sport_id,
  CASE sport_id {names} ELSE {_sq(K.SPORT_NAME_PREFIX)} || CAST(sport_id AS VARCHAR) END AS nom_sport
FROM (SELECT user_id, generate_subscripts(sports_favoris, 1) - 1 AS position, unnest(sports_favoris) AS sport_id
      FROM users)"""
    tc = _map_case("n.type", K.TYPE_COLOURS, _sq(K.TYPE_COLOUR_DEFAULT))
    s["notification_enriched"] = _with(m, _NOTES) + f"""SELECT n.notification_id, n.user_id, n.match_id, n.type,
  n.statut, mm.sport_id, mm.sport_nom, {tc} AS couleur
FROM notifications n LEFT JOIN matchs mm ON n.match_id = mm.match_id"""

    a = Q.SEARCH
    s["match_search"] = _with(m) + f"""SELECT * FROM matchs WHERE sport_id = {a['sport_id']}
  AND statut = {_sq(a['statut'])} AND date_match >= TIMESTAMP '{a['date_debut']}'
  AND date_match <= TIMESTAMP '{a['date_fin']}'"""
    s["match_lookup"] = _with(m, lgc, mg) + f"SELECT * FROM merged WHERE match_id = {Q.LOOKUP_ID}"
    s["user_notifications"] = _with(_NOTES) + f"SELECT * FROM notifications WHERE user_id = {Q.USER_ID}"
    s["recent_notifications"] = _with(_NOTES) + """SELECT *,
  COALESCE(TRY_CAST(date_envoi AS TIMESTAMP), TIMESTAMP '1970-01-01 00:00:00') AS date_tri
FROM notifications ORDER BY date_tri DESC, notification_id"""
    s["head10"] = _with(m) + "SELECT * FROM matchs ORDER BY match_id LIMIT 10"
    s["top_sports"] = _with(m, lgc, mg) + """SELECT sport_id, sport_nom, COUNT(*) AS nombre_matchs
FROM merged GROUP BY sport_id, sport_nom ORDER BY nombre_matchs DESC, sport_id LIMIT 3"""
    s["activity_feed"] = _with(m, lgc, mg, _NOTES) + """SELECT * FROM (
  SELECT 'match' AS source, CAST(match_id AS BIGINT) AS item_id,
    COALESCE(TRY_CAST(date_match AS TIMESTAMP), TIMESTAMP '1970-01-01 00:00:00') AS moment,
    'Match ' || equipe_domicile || ' vs ' || equipe_exterieur || ' ' || statut || ': '
      || CAST(COALESCE(score_domicile, 0) AS VARCHAR) || ' - ' || CAST(COALESCE(score_exterieur, 0) AS VARCHAR) AS texte
  FROM merged
  UNION ALL
  SELECT 'notification', notification_id,
    COALESCE(TRY_CAST(date_envoi AS TIMESTAMP), TIMESTAMP '1970-01-01 00:00:00'), contenu
  FROM notifications)
ORDER BY moment DESC, source, item_id LIMIT 20"""
    s["random_pick"] = _with(m) + f"""SELECT * FROM matchs
ORDER BY md5(CAST(match_id AS VARCHAR) || ':{Q.PICK_SEED}'), match_id
LIMIT {Q.PICK_N}"""
    s["facets"] = _with(m, _NOTES) + """SELECT 'sport_nom' AS facette, sport_nom AS valeur FROM matchs
UNION SELECT 'statut', statut FROM matchs
UNION SELECT 'type', type FROM notifications"""
    s["status_bucket"] = _with(m, lgc, mg) + f"""SELECT match_id, statut, {_status_colour('statut')} AS couleur
FROM merged"""
    s["labels"] = _with(m) + """SELECT match_id, equipe_domicile || ' vs ' || equipe_exterieur AS affiche,
  CAST(score_domicile AS VARCHAR) || ' - ' || CAST(score_exterieur AS VARCHAR) AS score FROM matchs"""
    on, off = K.ACTIVE_LABELS
    s["user_labels"] = _with(_USERS) + f"""SELECT user_id, prenom || ' ' || nom AS nom_complet,
  left(prenom, 1) || left(nom, 1) AS initiales, lower(email) AS email,
  CASE WHEN notification_active THEN {_sq(on)} ELSE {_sq(off)} END AS notifications FROM users"""
    cc = _map_case("lower(categorie)", K.CATEGORY_COLOURS, "'default'")
    s["sports_view"] = _with(_SPORTS, m) + f"""SELECT s.sport_id, s.nom, s.categorie, {cc} AS couleur,
  COALESCE(c.n, 0) AS nombre_matchs
FROM sports s LEFT JOIN (SELECT sport_id, COUNT(*) AS n FROM matchs GROUP BY sport_id) c ON s.sport_id = c.sport_id"""
    s["upcoming_matches"] = _with(m) + f"""SELECT * FROM matchs
WHERE CAST(date_match AS DATE) BETWEEN DATE '{Q.TODAY}' AND DATE '{Q.TODAY}' + INTERVAL 7 DAY"""
    moment = """COALESCE(try_strptime(date_match, '%Y-%m-%d %H:%M:%S'), try_strptime(date_match, '%Y-%m-%dT%H:%M:%SZ'))"""
    s["upcoming_matches_latest"] = _with(m, lgc, mg) + f"""SELECT * FROM merged
WHERE CAST({moment} AS DATE) BETWEEN DATE '{Q.TODAY}' AND DATE '{Q.TODAY}' + INTERVAL 7 DAY"""
    lo, hi = Q.SEARCH_LATEST["date_debut"], Q.SEARCH_LATEST["date_fin"]
    s["match_search_latest"] = _with(m, lgc, mg) + f"""SELECT * FROM merged WHERE statut = {_sq(Q.SEARCH_LATEST["statut"])}
  AND {moment} BETWEEN TIMESTAMP '{lo}' AND TIMESTAMP '{hi}'"""
    a1, a2 = K.BRANCH_LABELS
    s["threshold_branch"] = f"""SELECT CASE WHEN COUNT(*) > 0 THEN {_sq(a1)} ELSE {_sq(a2)} END AS branche,
  COUNT(*) AS lignes FROM part WHERE p_retailprice >= {K.PRICE_THRESHOLD}"""
    s["generation_branch"] = _with(m, lgc, mg) + f"""SELECT COUNT(*) AS nombre_matchs,
  CASE WHEN COUNT(*) < {Q.GENERATION_THRESHOLD} THEN 'generate_matchs' ELSE 'skip_generation' END AS branche
FROM merged"""
    return s
