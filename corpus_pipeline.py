"""The corpus pipeline: quality, line and document duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; run() writes
what a stage returns to the shared folder and reads it back as the next one's docs. All but
the last return the columns of documents, with any further columns that docs has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchflow.llm import decontam, jaccard, lines, quality
from matchflow.llm.common import read, written
from matchflow.llm.queries import packed


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier selects; rows are scored where they lie, so a null or
    repeated id loses none. Ratings of fold 0 are not learnt from."""
    rated = quality.ratings(read(spark, sf_dir, "labels")).where(quality.fold("doc_id") != 0)
    model = quality.train(docs, rated)
    scored = quality.rate(docs.select("doc_id", "text", F.struct("*").alias("_row")), model, also=("_row",))
    return scored.where(F.col("tails")[0] >= 0.5).select("_row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier one; those that had nothing else go."""
    out = lines.dedup_lines(docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c != "text"]).alias("_row")))
    left = (F.col("n_removed") == 0) | (F.length(F.trim(F.regexp_replace("text", "\\s+", " "))) > 0)
    return out.where(left).select(*[F.col("text") if c == "text" else F.char_length("text").cast("long").alias(c) if c == "n_chars"
                                    else F.col("_row")[c].alias(c) for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates. Rows without
    words or with a null id are in no group and stay; rows that repeat an id are one document."""
    found = jaccard.near_duplicates(docs).where("component_id IS NOT NULL AND n_shingles > 0")
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, as it stands or asked anew."""
    found = decontam.contaminated(docs, read(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_leak")).distinct()
    held = docs.select(F.col("doc_id").alias("_id"), F.struct("*").alias("_row"))
    return held.join(found, F.col("_id").eqNullSafe(F.col("_leak")), "left_anti").select("_row.*")


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packed(docs)


STAGES = [("quality classifier", quality_stage), ("line dedup", line_stage), ("n-gram jaccard join", near_stage),
          ("benchmark decontamination", leak_stage), ("packing", pack_stage)]

#: Trained weights and hashed packing aren't SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
