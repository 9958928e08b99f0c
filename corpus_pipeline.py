"""A corpus pipeline of four operators: quality rules, language ID, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. The first three
return documents with all their columns; the last returns the packed pieces. ``run`` writes what
each stage returns as Parquet into the shared folder and reads it back for the next one.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import common, near_copies, op1_language_id, op2_packing, op5_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base tests or are more likely bad than good."""
    common.prepare(spark)
    return op5_quality.keep_good(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language that could be learned."""
    common.prepare(spark)
    return op1_language_id.keep_known(docs)


#: Names that no column of documents has.
FILE, ROW = "__file_of_row", "__place_in_file"


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``FILE`` and ``ROW``, a hash of a row's file and its place there: they tell even equal rows apart.

    What is not a Parquet table as it was read is stored first.
    """
    def placed(df: DataFrame) -> DataFrame:
        file = df.metadataColumn("_metadata")
        return df.select(*(F.col(f"`{c}`") for c in df.columns), F.xxhash64(file["file_path"]).alias(FILE), file["row_index"].alias(ROW))

    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        try:
            return placed(docs)
        except AnalysisException:  # a table of another kind has no such places
            pass
    return placed(common.scratch(docs, "docs"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near copies (operator 4 over five-word shingles, and similarity 0.8 or more).

    It is that with the smallest doc_id, null ids last, ties by the place of the row. Rows that go are looked up by
    place: they are broadcast while they are few (``near_copies.FEW``), and texts are not shuffled.
    """
    common.prepare(spark)
    rows = numbered(docs)
    found = near_copies.classes(rows.select("doc_id", F.col(FILE).alias("a"), F.col(ROW).alias("b"), "text"))
    placed = common.scratch(found.select("root", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "a", "b").alias("place")), "placed")
    first = placed.groupBy("root").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    gone = common.split_join(placed, first, "root", placed.count(), counted="n").filter("place <> first").select(F.col("place.a").alias(FILE), F.col("place.b").alias(ROW))
    gone = common.scratch(gone, "gone")
    few = F.broadcast(gone) if gone.count() <= near_copies.FEW else gone
    return rows.join(few, [FILE, ROW], "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return op2_packing.pack(op2_packing.pieces(docs))


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("packing", packing)]

#: EM, a trained network and components have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.scratch(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
