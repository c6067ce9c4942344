"""Benchmark decontamination by templates.

Numbers, names and units of a text become typed placeholders; every window of ``width``
template tokens is hashed and joined with the benchmark's. Windows of a document and an item
that lie on one diagonal (same distance of their positions) are an alignment, and its slots
must be consistent: one value of the item stands for one value of the document throughout.
That finds items that were copied and items that were asked anew with other numbers and names.
Beside each window goes one in which the letter case is folded: a word is a name only for its
capital, so a copy in capitals or in lower case has other names, but the same folded windows.
Items that have no window, because they are short or nearly all placeholders, are found verbatim
in any letter case: their first tokens are hash-joined, and the rest is compared.
Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchflow.llm.common import written

WIDTH = 8  # a power of two
LITERALS = 4  # tokens of an item's window that must not be placeholders
SHORTEST = 5  # tokens of the shortest item that is looked for
#: Item windows up to which they are sent to every task; more are joined by a shuffle.
BROADCAST_WINDOWS = 1_000_000
# Words that are numbers, and units.
NUMBERS = """zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen
nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half twice""".split()
UNITS = """mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons tonne tonnes ounce ounces
pound pounds ml l liter liters litre litres gallon gallons cup cups second seconds minute minutes hour hours day days week weeks month months
year years dollar dollars cent cents euro euros percent degree degrees meter meters metre metres kilometer kilometers kilometre kilometres
centimeter centimeters mph kmh kph hz khz mhz ghz kb mb gb tb watt watts kw volt volts joule joules newton newtons""".split()
NUMBER, NAME, UNIT = 1, 2, 3


def tokens(text: Column) -> Column:
    """Words and numbers of a text, as they stand."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{M}\p{N}]+(?:[.,][0-9]+)*"), F.lit(0))


def template(words: Column, folded: bool = False) -> Column:
    """A hash for every token; a placeholder's is its type. ``folded``: no token is a name."""
    def one(t: Column) -> Column:
        low = F.lower(t)
        typed = F.when((t >= "0") & (t < ":"), F.lit(NUMBER).cast("long"))
        return (typed if folded else typed.when(t != low, F.lit(NAME).cast("long"))) \
            .when(low.isin(NUMBERS), F.lit(NUMBER).cast("long")).when(low.isin(UNITS), F.lit(UNIT).cast("long")) \
            .otherwise(F.xxhash64(low))
    return F.transform(words, one)


def _joined(column: str, step: int):
    """Hash of an element and the one ``step`` behind it."""
    return lambda x, i: F.xxhash64(x, F.get(F.col(column), i + step))


def _windows(df: DataFrame, column: str) -> DataFrame:
    """``column`` (token hashes) becomes the hashes of the WIDTH tokens from each; those with
    fewer tokens left are no windows. To be taken apart by posexplode_outer: for posexplode
    Spark infers a filter on the array's size, and moves it below these steps, where it would
    work them out again for every element."""
    df = df.withColumn("_n", F.size(column))
    step = 1
    while step < WIDTH:
        df = df.withColumn(column, F.transform(column, _joined(column, step)))
        step *= 2
    return df.withColumn(column, F.slice(column, 1, F.greatest(F.col("_n") - (WIDTH - 1), F.lit(0)))).drop("_n")


def _both(df: DataFrame, *keep: str) -> DataFrame:
    """(keep..., at, w, f, typed): each window of tokens ``t`` as typed (w) and folded (f), once
    to be taken typed and, where that isn't the same, once folded."""
    df = _windows(_windows(df.withColumns({"w": template(F.col("t")), "f": template(F.col("t"), True)}), "w"), "f")
    df = df.select(*keep, F.posexplode_outer(F.arrays_zip("w", "f")).alias("at", "x")).select(*keep, "at", "x.w", "x.f")
    return df.withColumn("typed", F.explode(F.array(F.lit(True), F.lit(False))))


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, item_tokens, item_types, at, window, typed): the windows of the items that have
    enough literal tokens, typed and folded, with the item's tokens and template. An item none of
    whose typed windows has enough (one in capitals) has those whose folded ones have."""
    base = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item"), tokens(F.col(text_col)).alias("item_tokens")).distinct()
    base = base.withColumns({"item_types": template(F.col("item_tokens")), "_plain": template(F.col("item_tokens"), True)})
    w = _both(base.withColumn("t", F.col("item_tokens")), "item", "item_tokens", "item_types", "_plain")
    enough = lambda c: F.size(F.filter(F.slice(c, F.col("at") + 1, WIDTH), lambda x: ~x.isin(NUMBER, NAME, UNIT))) >= LITERALS
    w = w.where("at IS NOT NULL").withColumns({"_typed": enough("item_types"), "_folded": enough("_plain")})
    w = w.withColumn("_any", F.max("_typed").over(Window.partitionBy("item", "item_tokens")))
    w = w.where("IF(_any, _typed, _folded) AND IF(typed, _typed, NOT (_typed AND w = f))")
    return w.select("item", "item_tokens", "item_types", "at", F.expr("IF(typed, w, f)").alias("window"), "typed")


def _firsts(column: str) -> Column:
    """Hashes of the SHORTEST tokens from each on; those with fewer left are none."""
    hashed = F.transform(column, lambda x, i: F.xxhash64(x, *[F.get(F.col(column), i + k) for k in range(1, SHORTEST)]))
    return F.slice(hashed, 1, F.greatest(F.size(column) - (SHORTEST - 1), F.lit(0)))


def _verbatim(docs: DataFrame, items: DataFrame, windows: DataFrame, id_col: str, text_col: str, item_id: str, item_text: str) -> DataFrame | None:
    """(id, item_id, 1, 1, 0, true): documents that hold all tokens of an item that has no window,
    in any letter case. None where there is no such item, so that no text is read for none."""
    short = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item"), tokens(F.col(item_text)).alias("item_tokens")) \
        .where(F.size("item_tokens") >= SHORTEST).join(windows.select("item", "item_tokens").distinct(), ["item", "item_tokens"], "left_anti")
    short = short.select("item", F.transform("item_tokens", F.lower).alias("item_tokens")).distinct() \
        .select("*", F.get(_firsts("item_tokens"), F.lit(0)).alias("first"))
    n = short.count()
    if not n:
        return None
    low = docs.select(F.col(id_col).alias("doc"), F.transform(tokens(F.col(text_col)), F.lower).alias("t"))
    found = low.select("doc", F.posexplode_outer(_firsts("t")).alias("pos", "first")) \
        .join(F.broadcast(short) if n <= BROADCAST_WINDOWS else short, "first").drop("first")
    hits = found.select(F.col("doc").alias("_hit")).distinct()
    words = low.withColumnRenamed("doc", "_id").join(hits, F.col("_id").eqNullSafe(F.col("_hit")), "left_semi").distinct()
    found = found.join(words, F.col("doc").eqNullSafe(F.col("_id"))).where(F.slice("t", F.col("pos") + 1, F.size("item_tokens")) == F.col("item_tokens"))
    one = F.lit(1).cast("long")
    return found.select(F.col("doc").alias(id_col), F.col("item").alias("item_id"), one.alias("n_matched"), one.alias("n_windows"),
                        F.lit(0).cast("long").alias("n_slots"), F.lit(True).alias("exact")).distinct()


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_id: str = "item_id", item_text: str = "text", share: float = 0.5) -> DataFrame:
    """(id, item, n_matched, n_windows, n_slots, exact): documents that hold an item.

    Reported where the item's windows found on consistent alignments are at least ``share`` of
    its windows, typed ones alone or together with folded ones, which cover the item's windows as
    well. exact: every slot has the item's own value, in any letter case. A null text is empty;
    items of fewer than WIDTH tokens, or without a window of LITERALS literal tokens (or words,
    where all have capitals) are reported where all their tokens are found in their order, in any
    letter case. Items with a null id or of fewer than SHORTEST tokens aren't looked for. Documents with a null id are reported under the null id, and
    rows that repeat an id count as one document; items that repeat an id with another text are
    matched by whichever text has more. Empty tables give no rows; other columns are not read."""
    windows = item_windows(items, item_id, item_text)
    key = windows.select(F.col("window"), "item", "at", F.xxhash64("item_tokens").alias("text_hash"), F.col("typed").alias("_typed"))
    small = windows.count() <= BROADCAST_WINDOWS
    key = F.broadcast(key) if small else key
    texts = docs.select(F.col(id_col).alias("doc"), tokens(F.col(text_col)).alias("t"))
    found = _both(texts, "doc").where("typed OR w <> f") \
        .select("doc", F.col("at").alias("pos"), F.expr("IF(typed, w, f)").alias("window"), "typed").join(key, "window")
    # alignments of typed windows (way 0), and of all (way 1): a folded hit takes no typed one away
    found = found.withColumn("way", F.explode(F.expr("IF(typed AND _typed, array(0, 1), array(1))")))
    diagonal = found.groupBy("doc", "item", "text_hash", "way", (F.col("pos") - F.col("at")).alias("shift")) \
        .agg(F.collect_set("at").alias("ats"))  # at most the item's windows
    diagonal = written(diagonal, "diagonals")  # read twice; the texts are taken apart once
    about = windows.groupBy("item", "item_tokens", "item_types").agg(F.countDistinct("at").alias("n_windows")) \
        .withColumn("text_hash", F.xxhash64("item_tokens"))
    words = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    hits = diagonal.select(F.col("doc").alias("_hit")).distinct()
    words = words.join(hits, F.col("_id").eqNullSafe(F.col("_hit")), "left_semi").distinct() \
        .select("_id", tokens(F.col("_text")).alias("doc_tokens"))
    lines = diagonal.join(about, ["item", "text_hash"]).join(words, F.col("doc").eqNullSafe(F.col("_id")))
    cover = F.array_distinct(F.flatten(F.transform("ats", lambda p: F.sequence(p, p + F.lit(WIDTH - 1)))))
    slot = F.transform(F.filter(cover, lambda i: F.get(F.col("item_types"), i).isin(NUMBER, NAME, UNIT)),
                       lambda i: F.struct(F.lower(F.get(F.col("item_tokens"), i)).alias("mine"),
                                          F.lower(F.coalesce(F.get(F.col("doc_tokens"), F.when(i + F.col("shift") >= 0, i + F.col("shift"))), F.lit(""))).alias("theirs")))
    lines = lines.withColumn("slots", F.array_distinct(slot)) \
        .where(F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda s: s["mine"])))) \
        .withColumn("exact", F.forall("slots", lambda s: s["mine"] == s["theirs"]))
    whole = lines.groupBy("doc", "item", "text_hash", "way").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("ats")))).cast("long").alias("n_matched"), F.max("n_windows").alias("n_windows"),
        F.max(F.size("slots")).cast("long").alias("n_slots"), F.min("exact").alias("exact"))
    best = lambda df, doc, item: df.groupBy(doc, item).agg(
        F.max(F.struct(F.col("n_matched"), F.col("n_windows"), F.col("n_slots"), F.col("exact"))).alias("b"))
    out = best(whole.where(F.col("n_matched") >= share * F.col("n_windows")), "doc", "item") \
        .select(F.col("doc").alias(id_col), F.col("item").alias("item_id"), "b.*")
    more = _verbatim(docs, items, windows, id_col, text_col, item_id, item_text)
    return out if more is None else best(out.unionByName(more), id_col, "item_id").select(id_col, "item_id", "b.*")
