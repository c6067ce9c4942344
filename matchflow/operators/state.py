"""Latest state per key (W1) and field-level merge of partial updates.

Both are ONE hash aggregate keyed by the entity key:

* every value travels as ``struct(order, value)`` and the aggregate is a plain
  ``max`` -- Spark combines it map-side (partial aggregation), so a key that
  holds a third of all records is reduced inside each map task before the
  shuffle instead of landing whole in one task, as a window sort would;
* there is no window, no self-join and no driver loop;
* the same function is a valid streaming aggregation (``update`` mode), so
  batch and stream share the code and the state store keeps one small struct
  per key and field.

Merge rules (log order per key): a record is *full* when it carries both
``sport_id`` and ``sport_nom`` (a null value still counts as carried); a full
record replaces the whole state; a partial record overwrites only the fields
it carries, explicit nulls included; scores missing from any record count as
0; a partial record for an unknown key starts from the fixed default row,
whose ``date_match`` is the arrival time of the first record.
"""

from __future__ import annotations

from typing import Callable, Iterable, Mapping, NamedTuple, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from matchflow.functions import constants as K
from matchflow.operators.decode import KEYS, OFFSET, PARTITION, TS
from matchflow.schemas import key_of, schema_of

MATCH_FIELDS = ("sport_id", "sport_nom", "equipe_domicile", "equipe_exterieur",
                "score_domicile", "score_exterieur", "date_match", "lieu", "statut",
                "derniere_mise_a_jour")
FULL_MARKERS = ("sport_id", "sport_nom")
ALWAYS_PRESENT = ("score_domicile", "score_exterieur")


def _order(order: str | Sequence[str]) -> Column:
    if isinstance(order, str):
        return F.col(order)
    return F.struct(*[F.col(c) for c in order])


def _present(df: DataFrame, field: str) -> Column:
    """Field carried by the record. Without a ``_keys`` column (typed input
    that never went through JSON) a non-null value counts as carried."""
    if KEYS in df.columns:
        return F.coalesce(F.array_contains(F.col(KEYS), F.lit(field)), F.lit(False))
    return F.col(field).isNotNull()


def valid_key(key: str, nonzero: bool = True) -> Column:
    """Key not null (and not 0 for matches) -- records failing it are skipped."""
    k = F.col(key)
    return (k.isNotNull() & (k != 0)) if nonzero else k.isNotNull()


def latest_per_key(df: DataFrame, key: str, order: str | Sequence[str] = OFFSET,
                   cols: Iterable[str] | None = None) -> DataFrame:
    """Last record per key in log order, whole-row replace.

    ``max_by(struct(cols), order)`` per key: one aggregate with map-side
    combine; ties on ``order`` cannot occur for (partition, offset) orders.
    """
    order_cols = [order] if isinstance(order, str) else list(order)
    cols = [c for c in (cols or df.columns) if c != key and c not in order_cols]
    o = _order(order)
    agg = df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.max_by(F.struct(*[F.col(c) for c in cols]), o).alias("_row"),
        F.max(o).alias("_last"))
    last = [F.col("_last").alias(order_cols[0])] if len(order_cols) == 1 else \
        [F.col(f"_last.{c}").alias(c) for c in order_cols]
    return agg.select(key, *[F.col(f"_row.{c}").alias(c) for c in cols], *last)


def merge_cells(df: DataFrame, key: str = "match_id", order: str | Sequence[str] = OFFSET,
                ts: str | None = TS, fields: Sequence[str] = MATCH_FIELDS,
                full_markers: Sequence[str] = FULL_MARKERS,
                always_present: Sequence[str] = ALWAYS_PRESENT,
                default_ts_field: str | None = "date_match",
                nonzero_key: bool = True) -> DataFrame:
    """The mergeable half of W2: one row of cells per key: the last full record, and the
    last value of each field in partial records, with their log positions (a full record, of which a
    log has the most, carries one position for all its fields). Cells of any parts of a log, in
    any order and however often, combine (``combine_cells``) to those of the whole log."""
    o = _order(order)
    src = df.where(valid_key(key, nonzero_key))
    is_full = None
    for m in full_markers:
        p = _present(src, m)
        is_full = p if is_full is None else (is_full & p)

    def value(f):
        v = F.when(_present(src, f), F.col(f))
        return v.otherwise(F.lit(0).cast(src.schema[f].dataType)) if f in always_present else v

    aggs = [F.max(F.when(is_full, F.struct(o.alias("o"), *[value(f).alias(f) for f in fields]))).alias("_full"),
            F.min(o).alias("_first_o"), F.max(o).alias("_last_o")]
    if ts and ts in src.columns and default_ts_field:
        aggs.append(F.min_by(F.col(ts), o).alias("_first_ts"))
    for f in fields:
        carried = ~is_full if f in always_present else ~is_full & _present(src, f)
        aggs.append(F.max(F.when(carried, F.struct(o.alias("o"), value(f).alias("v")))).alias(f"_{f}"))
    return src.groupBy(key).agg(*aggs)


def combining(columns: Iterable[str]) -> list[Column]:
    """The aggregates that combine cells of one key: the last value of each, the first of firsts."""
    out = []
    for c in columns:
        if c == "_first_o":
            out.append(F.min(c).alias(c))
        elif c == "_first_ts":
            out.append(F.min_by(c, "_first_o").alias(c))
        else:
            out.append(F.max(c).alias(c))
    return out


def combine_cells(cells: DataFrame, key: str = "match_id") -> DataFrame:
    return cells.groupBy(key).agg(*combining(c for c in cells.columns if c != key))


def finish_columns(cells: StructType, key: str = "match_id", fields: Sequence[str] = MATCH_FIELDS,
                   always_present: Sequence[str] = ALWAYS_PRESENT,
                   defaults: Mapping[str, object] = K.UNKNOWN_MATCH_DEFAULTS,
                   default_ts_field: str | None = "date_match") -> list[Column]:
    """The state's columns over a table of cells: key, ``fields``, ``first_offset``, ``last_offset``."""
    full = F.col("_full")
    out = [F.col(key)]
    for f in fields:
        cell = F.col(f"_{f}")
        dtype = cells[f"_{f}"].dataType["v"].dataType
        newest = F.when(cell["o"] >= full["o"], cell["v"]).otherwise(full[f])
        if f in always_present:
            val = F.when(full.isNull(), cell["v"]).otherwise(newest)
        else:
            if f == default_ts_field and "_first_ts" in cells.names:
                dflt = F.date_format(F.col("_first_ts"), "yyyy-MM-dd HH:mm:ss").cast(dtype)
            elif f in defaults:
                dflt = F.lit(defaults[f]).cast(dtype)
            else:
                dflt = F.lit(None).cast(dtype)
            val = F.when(full.isNull(), F.when(cell.isNotNull(), cell["v"]).otherwise(dflt)).otherwise(newest)
        out.append(val.cast(dtype).alias(f))
    return out + [F.col("_first_o").alias("first_offset"), F.col("_last_o").alias("last_offset")]


def merge_partial(df: DataFrame, key: str = "match_id", order: str | Sequence[str] = OFFSET,
                  ts: str | None = TS, fields: Sequence[str] = MATCH_FIELDS,
                  full_markers: Sequence[str] = FULL_MARKERS,
                  always_present: Sequence[str] = ALWAYS_PRESENT,
                  defaults: Mapping[str, object] = K.UNKNOWN_MATCH_DEFAULTS,
                  default_ts_field: str | None = "date_match",
                  nonzero_key: bool = True) -> DataFrame:
    """Field-level merge of full and partial records per key.

    Output: key, ``fields`` (wire types), ``first_offset`` and ``last_offset``
    (the log positions of the first and last record applied).
    """
    cells = merge_cells(df, key, order, ts, fields, full_markers, always_present, default_ts_field, nonzero_key)
    return cells.select(*finish_columns(cells.schema, key, fields, always_present, defaults, default_ts_field))


def latest_cells(df: DataFrame, key: str, order: str | Sequence[str], cols: Iterable[str]) -> DataFrame:
    """The mergeable half of W1: the last row of each key with its log position."""
    row = F.struct(*[F.col(c) for c in cols if c != key])
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(_order(order).alias("o"), row.alias("v"))).alias("_row"))


class Folding(NamedTuple):
    """How an entity's decoded records become cells, and the state's columns over cells; cells of
    one key combine by ``combining``."""
    key: str
    kind: str  # the key's type
    cells: Callable[[DataFrame], DataFrame]
    columns: Callable[[StructType], list[Column]]
    nonzero: bool = False  # a key of 0 counts as none

    def finish(self, cells: DataFrame) -> DataFrame:
        return cells.select(*self.columns(cells.schema))


def folding(entity: str) -> Folding:
    """State of an entity by (timestamp, partition, offset): field merge for matches (W2), whole
    records for the others (W1)."""
    key, order = key_of(entity), (TS, PARTITION, OFFSET)  # offsets only order one partition
    kind = schema_of(entity)[key].dataType.simpleString()
    if entity == "matchs":
        return Folding(key, kind, lambda df: merge_cells(df, key, order),
                       lambda t: [*finish_columns(t, key)[:-2], F.col("_first_o")[OFFSET].alias("first_offset"), F.col("_last_o")[OFFSET].alias("last_offset")], True)
    cols = [c for c in schema_of(entity).fieldNames() if c != key]
    return Folding(key, kind, lambda df: latest_cells(df, key, order, cols),
                   lambda t: [F.col(key), *[F.col("_row.v")[c].alias(c) for c in cols], F.col("_row.o")[OFFSET].alias(OFFSET)])
