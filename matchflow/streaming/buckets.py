"""State kept in buckets, updated copy-on-write (ST5, ST6, W1, W2).

A key's hash names its bucket. A version of the state is a manifest: for each bucket, the
version whose files hold it. A batch reads and rewrites only the buckets that its keys touch;
the others' files stay and are pointed to again. Writing the manifest is the one commit: until
its ``_SUCCESS`` is there, readers see the version before, and a batch that is run again writes the
same version over. A batch that has been committed is recognised by its job's id and its
number and isn't applied twice.

What is stored are cells (``operators.state``): they combine in any order, so late rows, rows
of other partitions, and a job that starts anew with a new checkpoint and replays its topic give
the same state. A row that a version changed also has what it was before (``_before``), from which
the marts take their deltas: -1 for the old row, +1 for the new one.

    root/data/v=<version>/bucket=<b>/...   rows of one bucket, sorted by key, with Bloom filters
    root/manifest/v=<version>/...          bucket, version, buckets, run, batch
    root/marts/<name>/v=<version>/...      what the version adds to a mart
    root/sizes/v=<version>/...             rows it inserted, updated and removed
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Callable, Mapping, NamedTuple, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from matchflow.functions import constants as K
from matchflow.functions.scalars import month_key, parse_ts_ntz
from matchflow.operators.state import Folding, combining, valid_key
from matchflow.sources import sinks

BUCKETS = 64
#: Rows that a task sorts at most, about (cells are some 1.2 KB wide in memory).
TASK_ROWS = 250_000
_SIZES = "inserted long, updated long, removed long"
_MANIFEST = "bucket int, version long, buckets int, run string, batch long"


class Mart(NamedTuple):
    """Counts and sums per group of the state's rows, as SQL expressions over them (or functions
    that give a column)."""
    by: Mapping[str, str | Callable[[], Column]]
    sums: Mapping[str, str] = {}


def _present(column: str) -> str:
    return f"if({column} IS NULL, 0, 1)"


#: A10, A11, A12 and A1 over the latest matches.
MATCH_MARTS = {
    "matches_per_sport": Mart({"sport_id": "sport_id"}),
    "matches_per_status": Mart({"statut": "statut"}),
    "matches_per_month": Mart({"mois": lambda: month_key(parse_ts_ntz("date_match"))}),
    "stats_matchs": Mart({"sport_id": "sport_id", "sport_nom": "sport_nom", "statut": "statut"},
                         {"buts_domicile": "score_domicile", "n_domicile": _present("score_domicile"),
                          "buts_exterieur": "score_exterieur", "n_exterieur": _present("score_exterieur")}),
}


class Version(NamedTuple):
    number: int
    buckets: int
    holds: dict[int, int]  # bucket: version whose files hold it (none: no rows)
    run: str
    batch: int


class BucketStore:
    """``root``: folder of one entity's state; ``fold``: its records to cells to rows."""

    def __init__(self, spark: SparkSession, root: str, fold: Folding, buckets: int = BUCKETS, marts: Mapping[str, Mart] | None = None):
        self.spark, self.root, self.fold, self.buckets, self.marts = spark, root.rstrip("/"), fold, buckets, marts or {}

    # --- versions -------------------------------------------------------------------------

    def version(self, number: int | None = None) -> Version | None:
        """A committed version, the newest by default. A manifest has a row for each bucket."""
        path = f"{self.root}/manifest/v={number}" if number is not None else sinks.latest_snapshot_path(self.spark, f"{self.root}/manifest")
        if path is None:
            return None
        rows = self.spark.read.schema(_MANIFEST).json(path).collect()
        return Version(int(path.rsplit("v=", 1)[1]), rows[0].buckets, {r.bucket: r.version for r in rows if r.version is not None}, rows[0].run, rows[0].batch)

    def _bucket(self, buckets: int, key: Column | None = None) -> Column:
        return F.pmod(F.xxhash64(F.col(self.fold.key) if key is None else key), F.lit(buckets)).cast("int")

    def _cells(self, v: Version, buckets: Sequence[int]) -> DataFrame | None:
        """Cells of some buckets."""
        paths = [f"{self.root}/data/v={v.holds[b]}/bucket={b}" for b in buckets if b in v.holds]
        return self.spark.read.parquet(*paths).drop("_before", "_changed") if paths else None

    # --- writing --------------------------------------------------------------------------

    def apply(self, records: DataFrame, batch: int, run: str = "") -> Version:
        """Fold a batch of decoded records in; ``run`` and ``batch`` name it. A batch that was
        committed already, or one before it, changes nothing. Only the touched buckets are read,
        and the keys' old rows and new cells meet in one aggregate."""
        old = self.version()
        if old and old.run == run and batch <= old.batch:
            return old
        number, buckets = (old.number + 1, old.buckets) if old else (0, self.buckets)
        found = records.where(valid_key(self.fold.key, self.fold.nonzero)).groupBy(self._bucket(buckets).alias("b")).count().collect()  # at most the buckets
        touched, rows = [r.b for r in found], sum(r["count"] for r in found)
        cells = self.fold.cells(records)
        before = self._cells(old, touched) if old else None
        rows += before.count() if before is not None else 0
        with self._partitions(rows, touched):
            if before is None:
                merged = self._arranged(cells, rows, buckets, touched).withColumns({"_changed": F.lit(True), "_before": F.lit(None).cast(self._row_type(cells))})
            else:
                merged = self._merged(cells, before, rows, buckets, touched)
            return self._publish(merged, Version(number, buckets, old.holds if old else {}, run, batch), touched)

    def _merged(self, cells: DataFrame, before: DataFrame, rows: int, buckets: int, touched: Sequence[int]) -> DataFrame:
        """A bucket's old rows and a batch's cells, key by key; what a changed row was before is made of
        its old cells only when they have met."""
        key = self.fold.key
        names = [c for c in cells.columns if c != key]
        both = self._arranged(cells.withColumn("_changed", F.lit(True)).unionByName(before.withColumn("_changed", F.lit(False))), rows, buckets, touched)
        held = [F.max(F.when(~F.col("_changed"), F.col(c))).alias(f"_old{c}") for c in names]
        found = both.groupBy("bucket", key, "_part").agg(*combining(names), *held, F.max("_changed").alias("_changed"), F.min("_changed").alias("_new"))
        sides = found.select("bucket", key, "_part", F.struct(*names).alias("_now"), "_changed", "_new", *[F.col(f"_old{c}").alias(c) for c in names])
        return self._with_row(sides, "_before").select("bucket", key, "_part", "_now.*", "_changed", F.when(F.col("_changed") & ~F.col("_new"), F.col("_before")).alias("_before"))

    def _parts(self, rows: int, touched: Sequence[int]) -> int:
        """Parts that a bucket's rows are written in."""
        return 1 + rows // (TASK_ROWS * max(1, len(touched)))

    @contextmanager
    def _partitions(self, rows: int, touched: Sequence[int]) -> Iterator[None]:
        """Exchanges inside begin with partitions enough for the rows, so that none has to be sorted
        on disk; adaptive execution puts small ones together again."""
        conf, name = self.spark.conf, "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
        held = conf.get(name, None)
        conf.set(name, str(max(rows // TASK_ROWS + 1, 2 * len(touched) * self._parts(rows, touched), int(held or conf.get("spark.sql.shuffle.partitions")))))
        try:
            yield
        finally:
            if held is None:
                conf.unset(name)
            else:
                conf.set(name, held)

    def _arranged(self, cells: DataFrame, rows: int, buckets: int, touched: Sequence[int]) -> DataFrame:
        """Cells with their bucket, and the part of it that a task writes."""
        key, parts = F.col(self.fold.key), self._parts(rows, touched)
        return cells.withColumns({"bucket": self._bucket(buckets), "_part": F.pmod(F.xxhash64(F.lit("part"), key), F.lit(parts)).cast("int")}).repartition("bucket", "_part")

    def remove(self, keys: DataFrame) -> Version:
        """Take keys out of the state; the buckets they are in are rewritten. A key whose records
        are replayed later comes back."""
        old = self.version()
        if old is None:
            raise ValueError("no state yet")
        gone = keys.select(self.fold.key).distinct().persist()
        try:
            near = [b for (b,) in gone.select(self._bucket(old.buckets).alias("b")).distinct().collect()]
            found = self._cells(old, near)
            if found is None:
                return old
            hits = dict(found.join(gone, self.fold.key, "left_semi").groupBy(self._bucket(old.buckets).alias("b")).count().collect())  # at most the buckets
            touched = list(hits)
            if not touched:
                return old
            found = self._cells(old, touched)
            dead = [(-1, self.fold.finish(found.join(gone, self.fold.key, "left_semi")))]
            rows = found.count()
            names = [c for c in found.columns if c != self.fold.key]
            with self._partitions(rows, touched):
                tagged = found.withColumn("_gone", F.lit(False)).unionByName(gone.withColumn("_gone", F.lit(True)), allowMissingColumns=True)
                kept = self._arranged(tagged.where(self._bucket(old.buckets).isin(touched)), rows, old.buckets, touched)
                kept = kept.groupBy("bucket", self.fold.key, "_part").agg(*combining(names), F.max("_gone").alias("_gone")).where("NOT _gone").drop("_gone")
                return self._publish(self._unchanged(kept), old._replace(number=old.number + 1), touched, dead, sum(hits.values()))
        finally:
            gone.unpersist()

    def resize(self, buckets: int) -> Version:
        """The same state in another number of buckets."""
        old = self.version()
        cells = self._cells(old, sorted(old.holds))
        rows = cells.count()
        with self._partitions(rows, range(buckets)):
            return self._publish(self._unchanged(self._arranged(cells, rows, buckets, range(buckets))), old._replace(number=old.number + 1, buckets=buckets, holds={}), range(buckets))

    def _publish(self, rows: DataFrame, v: Version, touched: Sequence[int], changed: Sequence[tuple[int, DataFrame]] | None = None, removed: int = 0) -> Version:
        """Write the touched buckets' rows (``_arranged``) and the marts' deltas, then the manifest."""
        data, key = f"{self.root}/data/v={v.number}", self.fold.key
        # a bucket's rows lie together, a large one's in several files, sorted by key
        out = rows.sortWithinPartitions("bucket", key).drop("_part")
        seen = Observation()
        out = out.observe(seen, F.count_if(F.col("_changed") & F.col("_before").isNull()).alias("inserted"),
                          F.count_if(F.col("_changed") & F.col("_before").isNotNull()).alias("updated"))
        out.write.mode("overwrite").partitionBy("bucket").option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(data)
        sizes = [(seen.get["inserted"], seen.get["updated"], removed)]
        self.spark.createDataFrame(sizes, _SIZES).coalesce(1).write.mode("overwrite").json(f"{self.root}/sizes/v={v.number}")
        filled = [int(b) for b in sinks.children(self.spark, data, "bucket=")]
        v = v._replace(holds={b: n for b, n in v.holds.items() if b not in set(touched)} | dict.fromkeys(filled, v.number))
        if changed is None and filled and self.marts:
            written = self.spark.read.parquet(*[f"{data}/bucket={b}" for b in filled]).where("_changed")
            changed = [(-1, written.where("_before IS NOT NULL").select("_before.*")), (1, self.fold.finish(written))]
        if changed is not None and self.marts:
            self._write_deltas(changed, v.number)
        self._commit(v)
        return v

    def _commit(self, v: Version) -> None:
        rows = [(b, v.holds.get(b), v.buckets, v.run, v.batch) for b in range(v.buckets)]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").json(f"{self.root}/manifest/v={v.number}")

    def _with_row(self, cells: DataFrame, name: str) -> DataFrame:
        """Cells with the state's row that they stand for."""
        return cells.withColumn(name, F.struct(*self.fold.columns(cells.schema)))

    def _row_type(self, cells: DataFrame):
        return self._with_row(cells, "_row_of").schema["_row_of"].dataType

    def _unchanged(self, cells: DataFrame) -> DataFrame:
        return cells.withColumns({"_changed": F.lit(False), "_before": F.lit(None).cast(self._row_type(cells))})

    def vacuum(self, keep: int = 2) -> None:
        """Delete what the newest ``keep`` versions don't point to; older versions can't be read after."""
        numbers = sorted(map(int, sinks.children(self.spark, f"{self.root}/manifest", "v=", complete=True)))
        if not numbers:
            return
        held = {n for number in numbers[-keep:] for n in self.version(number).holds.values()}
        for number in numbers[:-keep]:
            sinks.delete(self.spark, f"{self.root}/manifest/v={number}")
        for n in map(int, sinks.children(self.spark, f"{self.root}/data", "v=")):
            if n not in held and n < numbers[-keep:][0]:
                sinks.delete(self.spark, f"{self.root}/data/v={n}")

    # --- marts by deltas (A1, A10-A12) --------------------------------------------------------

    def _write_deltas(self, changed: Sequence[tuple[int, DataFrame]], number: int) -> None:
        """What changed rows add to the marts: each old row -1, each new row +1. The rows are read once,
        into counts by all the marts' groups together, of which each mart's are a summary."""
        by = list(dict.fromkeys((n, e) for mart in self.marts.values() for n, e in mart.by.items()))
        sums = list(dict.fromkeys(e for mart in self.marts.values() for e in mart.sums.values()))
        parts = [rows.select(F.lit(sign).alias("_sign"), *[(F.expr(e) if isinstance(e, str) else e()).alias(f"_by{i}") for i, (_, e) in enumerate(by)],
                             *[(F.lit(sign) * F.expr(e)).alias(f"_sum{i}") for i, e in enumerate(sums)]) for sign, rows in changed]
        base = functools.reduce(DataFrame.unionByName, parts).groupBy(*[f"_by{i}" for i in range(len(by))]).agg(
            *[F.sum(c).cast("long").alias(c) for c in ("_sign", *[f"_sum{i}" for i in range(len(sums))])]).persist()
        try:
            for name, mart in self.marts.items():
                out = base.groupBy(*[F.col(f"_by{by.index(x)}").alias(x[0]) for x in mart.by.items()]).agg(
                    F.sum("_sign").cast("long").alias("nombre"), *[F.sum(f"_sum{sums.index(e)}").cast("long").alias(n) for n, e in mart.sums.items()])
                out.write.mode("overwrite").parquet(f"{self.root}/marts/{name}/v={number}")
        finally:
            base.unpersist()

    def mart(self, name: str) -> DataFrame:
        """A mart at the newest version: its deltas added up. Groups without rows left are gone."""
        v, root, mart = self.version(), f"{self.root}/marts/{name}", self.marts[name]
        base = max((int(n) for n in sinks.children(self.spark, root, "base=", complete=True) if int(n) <= v.number), default=-1)
        paths = [f"{root}/v={n}" for n in map(int, sinks.children(self.spark, root, "v=", complete=True)) if base < n <= v.number]
        rows = self.spark.read.parquet(*paths, *([f"{root}/base={base}"] if base >= 0 else []))
        return rows.groupBy(*mart.by).agg(*[F.sum(c).cast("long").alias(c) for c in ("nombre", *mart.sums)]).where("nombre <> 0")

    def fold_mart(self, name: str) -> None:
        """Put the deltas so far into one table, which later reads start from."""
        self.mart(name).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/marts/{name}/base={self.version().number}")

    def sizes(self) -> DataFrame:
        """(v, inserted, updated, removed) of every committed version, counted while it was written;
        what was inserted less what was removed is the state's size, without reading the state."""
        now = self.version()
        rows = self.spark.read.schema(_SIZES + ", v int").json(f"{self.root}/sizes")
        return rows.where(F.col("v") <= (now.number if now else -1))

    # --- reading --------------------------------------------------------------------------

    def read(self, number: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame | None:
        """The state's rows at a version (the newest by default), of all buckets or some."""
        v = self.version(number)
        found = self._cells(v, sorted(v.holds) if buckets is None else buckets) if v else None
        return None if found is None else self.fold.finish(found)

    def lookup(self, value) -> DataFrame | None:
        """the row of one key. One bucket's files are opened; in them statistics and Bloom filters
        leave the row groups that can hold it."""
        v = self.version()
        if v is None:
            return None
        key = F.lit(value).cast(self.fold.kind)
        at = self.spark.range(1).select(self._bucket(v.buckets, key)).first()[0]
        if at not in v.holds:
            return self.read().where("false")
        return self.fold.finish(self._cells(v, [at]).where(F.col(self.fold.key) == key))

    def changes(self, first: int, second: int) -> DataFrame:
        """(key, change, before, after) between two versions: insert, update or delete, with the
        rows as structs. Only buckets whose files differ are read; rows that are the same go
        before anything else is done with them, in one aggregate by key."""
        key, a, b = self.fold.key, self.version(first), self.version(second)
        differ = range(max(a.buckets, b.buckets)) if a.buckets != b.buckets else [x for x in range(a.buckets) if a.holds.get(x) != b.holds.get(x)]
        sides = [(n, rows) for n, rows in (("before", self.read(first, differ)), ("after", self.read(second, differ))) if rows is not None]
        if not sides:
            return self.read(second).select(key, F.lit("").alias("change"), F.struct("*").alias("before"), F.struct("*").alias("after")).where("false")
        tagged = [rows.select(key, F.lit(n).alias("side"), F.struct("*").alias("row")) for n, rows in sides]
        both = tagged[0].unionByName(tagged[1]) if len(tagged) > 1 else tagged[0]
        parts = max(1 + sum(rows.count() for _, rows in sides) // TASK_ROWS, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        found = both.repartition(parts, key).groupBy(key).agg(*[F.max(F.when(F.col("side") == n, F.col("row"))).alias(n) for n in ("before", "after")])
        kind = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").otherwise("update")
        return found.where(~F.col("before").eqNullSafe(F.col("after"))).select(key, kind.alias("change"), "before", "after")


# --- marts of the matches, as the API gives them ----------------------------------------------


def stats_matchs(store: BucketStore) -> DataFrame:
    """A1 from its deltas."""
    mean = lambda side: (F.col(f"buts_{side}") / F.nullif(F.col(f"n_{side}"), F.lit(0))).alias(f"moyenne_score_{side}")
    return store.mart("stats_matchs").select("sport_id", "sport_nom", "statut", F.col("nombre").alias("nombre_matchs"), mean("domicile"), mean("exterieur"))


def matches_per_status(store: BucketStore) -> DataFrame:
    """A11 from its deltas: the three counted statuses, 0 when absent."""
    counts = store.mart("matches_per_status").agg(*[F.coalesce(F.sum(F.when(F.col("statut") == s, F.col("nombre"))), F.lit(0)).cast("long").alias(f"c{i}")
                                                     for i, s in enumerate(K.COUNTED_STATUSES)])
    rows = F.array(*[F.struct(F.lit(s).alias("statut"), F.col(f"c{i}").alias("nombre_matchs")) for i, s in enumerate(K.COUNTED_STATUSES)])
    return counts.select(F.inline(rows))


def matches_per_month(store: BucketStore) -> DataFrame:
    """A12 from its deltas."""
    return store.mart("matches_per_month").select("mois", F.col("nombre").alias("nombre_matchs"))


def matches_per_sport(store: BucketStore) -> DataFrame:
    """A10's counts from their deltas (a group's first name can't be taken back, so it has none)."""
    return store.mart("matches_per_sport").select("sport_id", F.col("nombre").alias("nombre_matchs"))
