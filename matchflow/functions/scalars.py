"""Column-level functions (JVM-side built-ins only; no Python UDFs).

Each function takes and returns ``Column`` objects so that it composes
into any projection and stays inside whole-stage codegen.
"""

from __future__ import annotations

from itertools import chain
from typing import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchflow.functions import constants as K


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def map_lookup(key, mapping: Mapping, default) -> Column:
    """``mapping.get(key, default)`` as a literal map lookup."""
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.coalesce(m[col_(key)], F.lit(default))


def status_label(code, kind: str = "insert") -> Column:
    """Feed status code -> French label (P10 for inserts, P11 for updates)."""
    mapping = K.STATUS_LABELS_INSERT if kind == "insert" else K.STATUS_LABELS_UPDATE
    return map_lookup(code, mapping, K.STATUS_LABEL_DEFAULT)


ISO_Z_PATTERN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"


def iso_to_wire(x) -> Column:
    """``yyyy-MM-ddTHH:mm:ssZ`` -> ``yyyy-MM-dd HH:mm:ss``; anything else kept.

    The instant is UTC, so the wall-clock conversion is done on a
    zone-free timestamp and never depends on the session time zone.
    """
    x = col_(x)
    parsed = F.when(x.rlike(ISO_Z_PATTERN), x.try_cast("timestamp_ntz"))
    return F.coalesce(F.date_format(parsed, "yyyy-MM-dd HH:mm:ss"), x)


def parse_ts(x) -> Column:
    """Wire date string -> TIMESTAMP; unparsable -> null instead of an error.

    Offsets such as ``Z`` are honoured; strings without one are read in the
    session zone (UTC in every session this library builds).
    """
    return col_(x).try_cast("timestamp")


def parse_ts_ntz(x) -> Column:
    """Wire date string -> zone-free TIMESTAMP_NTZ (UTC wall clock)."""
    return col_(x).try_cast("timestamp_ntz")


def safe_ts(x, fallback: str = "1970-01-01 00:00:00") -> Column:
    """Date parse with a fixed fallback for null or bad input."""
    return F.coalesce(parse_ts_ntz(x), F.lit(fallback).cast("timestamp_ntz"))


def month_key(ts) -> Column:
    """``yyyy-MM`` month key of a timestamp."""
    return F.date_format(col_(ts), "yyyy-MM")


def score_or_zero(c) -> Column:
    """Missing score -> 0."""
    return F.coalesce(col_(c), F.lit(0))


def status_colour(statut) -> Column:
    """Match status -> display colour, case-insensitive."""
    s = F.lower(col_(statut))
    out = None
    for colour, values in K.STATUS_COLOURS.items():
        cond = s.isin(values)
        out = F.when(cond, F.lit(colour)) if out is None else out.when(cond, F.lit(colour))
    return out.otherwise(F.lit("default"))


def type_colour(t) -> Column:
    """Notification type -> colour (P20)."""
    return map_lookup(t, K.TYPE_COLOURS, K.TYPE_COLOUR_DEFAULT)


def category_colour(categorie) -> Column:
    """Sport category -> colour, case-insensitive."""
    return map_lookup(F.lower(col_(categorie)), K.CATEGORY_COLOURS, "default")


def active_label(flag) -> Column:
    """Notification-active flag -> label; null reads as off, like a falsy flag."""
    on, off = K.ACTIVE_LABELS
    return F.when(col_(flag), F.lit(on)).otherwise(F.lit(off))


def versus(home, away) -> Column:
    """"A vs B" (P19)."""
    return F.concat_ws(" vs ", col_(home), col_(away))


def score_line(home, away) -> Column:
    """"h - a" (P19)."""
    return F.concat_ws(" - ", col_(home).cast("string"), col_(away).cast("string"))


def full_name(prenom, nom) -> Column:
    """"prenom nom" (P19)."""
    return F.concat_ws(" ", col_(prenom), col_(nom))


def initials(prenom, nom) -> Column:
    """First letter of first and last name, missing parts empty."""
    return F.concat(F.coalesce(F.substring(col_(prenom), 1, 1), F.lit("")),
                    F.coalesce(F.substring(col_(nom), 1, 1), F.lit("")))


def pmod(x, n: int) -> Column:
    """Non-negative modulo, identical to SQL ``((x % n) + n) % n``."""
    return F.pmod(col_(x), F.lit(n))
