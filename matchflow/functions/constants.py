"""Fixed values.

These must equal the source application's values for results to match:
labels, templates, seed rows and defaults. They are listed plainly and in
their natural order; nothing else lives here.
"""

# --- fixed values: match status code -> label, used when a feed match is inserted
STATUS_LABELS_INSERT = {
    "SCHEDULED": "prévu",
    "TIMED": "programmé",
    "IN_PLAY": "en cours",
    "PAUSED": "en pause",
    "FINISHED": "terminé",
    "LIVE": "en cours",
}

# --- fixed values: match status code -> label, used for a feed match update
STATUS_LABELS_UPDATE = {
    "SCHEDULED": "programmé",
    "LIVE": "en cours",
    "FINISHED": "terminé",
    "POSTPONED": "reporté",
    "CANCELLED": "annulé",
}

# --- fixed values: label when the status code is missing or unknown
STATUS_LABEL_DEFAULT = "programmé"

# --- fixed values: notification templates by type; {name} slots are match fields
TEMPLATES = {
    "programmé": "Un match que vous pourriez aimer a été programmé: {equipe_domicile} vs {equipe_exterieur}",
    "rappel": "Rappel: Le match {equipe_domicile} vs {equipe_exterieur} commence bientôt!",
    "debut_match": "Le match {equipe_domicile} vs {equipe_exterieur} vient de commencer!",
    "mi_temps": "Mi-temps: {equipe_domicile} {score_domicile} - {score_exterieur} {equipe_exterieur}",
    "but": "BUT! {equipe_marqueuse} marque contre {equipe_adverse}! {equipe_domicile} {score_domicile} - {score_exterieur} {equipe_exterieur}",
    "carton": "Carton {type_carton} pour un joueur de {equipe}!",
    "fin_match": "Fin du match: {equipe_domicile} {score_domicile} - {score_exterieur} {equipe_exterieur}",
}
TEMPLATE_FALLBACK = "Mise à jour du match {equipe_domicile} vs {equipe_exterieur}"

# --- fixed values: in-play event types drawn for a live match, card colours
LIVE_EVENT_TYPES = ["but", "carton", "mi_temps"]
LIVE_EVENT_PERCENT = 30
CARD_COLOURS = ["jaune", "rouge"]
LIVE_STATUS = "en cours"
SENT_STATUS = "envoyée"

# --- fixed values: defaults of a missing match field in a rendered message
TEAM_HOME_DEFAULT = "Équipe A"
TEAM_AWAY_DEFAULT = "Équipe B"

# --- fixed values: the row a partial update of an unknown match starts from
# (date_match is the time the update arrived)
UNKNOWN_MATCH_DEFAULTS = {
    "sport_id": 0,
    "sport_nom": "Inconnu",
    "equipe_domicile": "Équipe A",
    "equipe_exterieur": "Équipe B",
    "score_domicile": 0,
    "score_exterieur": 0,
    "lieu": "Lieu inconnu",
    "statut": "programmé",
}

# --- fixed values: statuses counted by the match status report, in order
COUNTED_STATUSES = ["programmé", "en cours", "terminé"]

# --- fixed values: seed sports (sport_id, nom, categorie, nombre_joueurs, description)
SEED_SPORTS = [
    (1, "Football", "Collectif", 11, "Le football se joue avec un ballon entre deux equipes de 11 joueurs"),
    (2, "Basketball", "Collectif", 5, "Le basketball est un sport ou deux equipes de cinq joueurs s'affrontent pour marquer des paniers"),
    (3, "Tennis", "Individuel", 2, "Le tennis est un sport de raquette qui oppose soit deux joueurs, soit deux equipes de deux joueurs"),
    (4, "Rugby", "Collectif", 15, "Le rugby est un sport collectif de contact qui se joue avec un ballon ovale"),
    (5, "Volleyball", "Collectif", 6, "Le volleyball est un sport ou deux equipes s'affrontent avec un ballon sur un terrain separe par un filet"),
]

# --- fixed values: seed products (produit_id, nom, categorie, prix)
SEED_PRODUCTS = [
    (1, "Smartphone", "Electronique", 599.99),
    (2, "Laptop", "Electronique", 1299.99),
    (3, "Casque audio", "Accessoires", 149.99),
    (4, "Livre", "Culture", 19.99),
    (5, "Chaussures de sport", "Mode", 89.99),
]

# --- fixed values: price threshold of the branch probe and its two labels
PRICE_THRESHOLD = 2000
BRANCH_LABELS = ("action1", "action2")

# --- fixed values: display colour of a match status (lower-cased), default "default"
STATUS_COLOURS = {
    "primary": ["programmé", "prévu", "timed", "scheduled"],
    "success": ["en cours", "in_play", "live", "en pause", "paused"],
    "default": ["terminé", "finished"],
    "warning": ["reporté", "postponed"],
    "error": ["annulé", "cancelled"],
}

# --- fixed values: display colour of a notification type, default grey
TYPE_COLOURS = {
    "debut_match": "#1976d2",
    "but": "#ff9800",
    "fin_match": "#4caf50",
    "programmé": "#9c27b0",
    "carton": "#f44336",
}
TYPE_COLOUR_DEFAULT = "#757575"

# --- fixed values: display colour of a sport category (lower-cased), default "default"
CATEGORY_COLOURS = {"collectif": "primary", "individuel": "secondary"}

# --- fixed values: labels of the notification-active flag
ACTIVE_LABELS = ("Activées", "Désactivées")

# --- fixed values: sport names known to the user page, fallback "Sport <id>"
SPORT_NAMES = {1: "Football", 2: "Basketball", 3: "Tennis", 4: "Rugby", 5: "Volleyball"}
SPORT_NAME_PREFIX = "Sport "
