"""The one declared schema set, and the key of every entity.

All columns are nullable: the wire format is loose JSON, and validation
(``operators.decode``) decides what to keep.
"""

from __future__ import annotations

from pyspark.sql import types as T

I, L, S, B = T.IntegerType(), T.LongType(), T.StringType(), T.BooleanType()


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


SPORT = _struct(("sport_id", I), ("nom", S), ("categorie", S),
                ("nombre_joueurs", I), ("description", S))

# Wire shape of a match record; dates travel as strings.
MATCH = _struct(("match_id", L), ("sport_id", I), ("sport_nom", S),
                ("equipe_domicile", S), ("equipe_exterieur", S),
                ("score_domicile", I), ("score_exterieur", I),
                ("date_match", S), ("lieu", S), ("statut", S),
                ("derniere_mise_a_jour", S))

# A partial update carries a subset of MATCH's fields.
MATCH_UPDATE = _struct(("match_id", L), ("statut", S), ("score_domicile", I),
                       ("score_exterieur", I), ("derniere_mise_a_jour", S))

USER = _struct(("user_id", L), ("prenom", S), ("nom", S), ("email", S),
               ("date_inscription", S), ("sports_favoris", T.ArrayType(I)),
               ("notification_active", B))

# A generated notification's id names its event and its user, see operators.notify.
NOTIFICATION = _struct(("notification_id", S), ("user_id", L), ("match_id", L),
                       ("type", S), ("contenu", S), ("date_envoi", S), ("statut", S))

# The notifications of one event, which differ in nothing but their users: the event and the audience
# that gets it, see operators.notify.
NOTIFICATION_GROUP = _struct(("group_id", S), ("audience", S), ("sport_id", I), ("match_id", L),
                             ("type", S), ("contenu", S), ("date_envoi", S), ("statut", S))

PRODUCT = _struct(("produit_id", L), ("nom", S), ("categorie", S), ("prix", T.DoubleType()))

# Upstream feed document: {"matches": [ {utcDate, status, venue, homeTeam{name},
# awayTeam{name}, score{fullTime{home, away}}} ]}
FEED = _struct(("matches", T.ArrayType(_struct(
    ("utcDate", S), ("status", S), ("venue", S),
    ("homeTeam", _struct(("name", S))), ("awayTeam", _struct(("name", S))),
    ("score", _struct(("fullTime", _struct(("home", I), ("away", I))))),
))))

# Record of a topic: what a Kafka source yields, and what a directory topic stores.
TOPIC_RECORD = T.StructType([
    T.StructField("key", T.BinaryType(), True),
    T.StructField("value", T.BinaryType(), True),
    T.StructField("topic", S, True),
    T.StructField("partition", I, True),
    T.StructField("offset", T.LongType(), True),
    T.StructField("timestamp", T.TimestampType(), True),
])

ENTITIES = {
    "sports": (SPORT, "sport_id"),
    "matchs": (MATCH, "match_id"),
    "users": (USER, "user_id"),
    "notifications": (NOTIFICATION, "notification_id"),
    "notification_groups": (NOTIFICATION_GROUP, "group_id"),
}

# Curated match columns whose wire strings become timestamps.
MATCH_DATE_COLUMNS = ("date_match", "derniere_mise_a_jour")


def schema_of(entity: str) -> T.StructType:
    return ENTITIES[entity][0]


def key_of(entity: str) -> str:
    return ENTITIES[entity][1]
