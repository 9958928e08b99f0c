"""Seeded inputs and query sets, and a timer."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.plans.prefix import dense_positions, occurrence_index


def _below(most, seed: int):
    return F.floor(F.rand(seed) * most).cast("bigint")


def gen_sequence(spark: SparkSession, n: int, sigma: int, seed: int = 1) -> DataFrame:
    """Symbols uniform in [0, sigma)."""
    return spark.range(n).select(F.lit(0).cast("bigint").alias("seq_id"), F.col("id").alias("pos"), _below(sigma, seed).alias("sym"))


def gen_queries(spark: SparkSession, q: int, most: int, seed: int = 2) -> DataFrame:
    return spark.range(q).select(F.col("id").alias("qid"), F.lit(0).cast("bigint").alias("seq_id"), _below(most, seed).alias("i"))


def gen_range_queries(spark: SparkSession, q: int, n: int, seed: int = 3) -> DataFrame:
    both = spark.range(q).select(F.col("id").alias("qid"), _below(n + 1, seed).alias("a"), _below(n + 1, seed + 1).alias("b"))
    return both.select("qid", F.lit(0).cast("bigint").alias("seq_id"), F.least("a", "b").alias("l"), F.greatest("a", "b").alias("r"))


def gen_pairs(spark: SparkSession, q: int, most_a: int, most_b: int, seed: int = 4) -> DataFrame:
    return spark.range(q).select(F.col("id").alias("qid"), _below(most_a, seed).alias("a"), _below(most_b, seed + 1).alias("b"))


def gen_rank_queries(seq: DataFrame, q: int, n: int, seed: int = 5) -> DataFrame:
    """A random position, and the symbol at another: symbols as often as they occur."""
    spark = seq.sparkSession
    drawn = spark.range(q).select(F.col("id").alias("qid"), _below(n + 1, seed).alias("i"), _below(n, seed + 1).alias("pos"))
    return drawn.join(seq, "pos").select("qid", "seq_id", "sym", "i")


def gen_select_queries(seq: DataFrame, q: int, n: int, seed: int = 6) -> DataFrame:
    """A symbol as often as it occurs, and one of its occurrences, from 0."""
    spark = seq.sparkSession
    drawn = spark.range(q).select(F.col("id").alias("qid"), _below(n, seed).alias("pos"))
    return drawn.join(occurrence_index(seq, ["seq_id", "sym"]), "pos").select("qid", "seq_id", "sym", "k")


def gen_increasing(spark: SparkSession, n: int, most: int, seed: int = 7) -> DataFrame:
    """n strictly increasing values below ``most``: sorted draws from [0, most - n], each plus its index."""
    drawn = dense_positions(spark.range(n).select(_below(most - n + 1, seed).alias("v"), "id"), ["v", "id"], "pos")
    return drawn.select(F.lit(0).cast("bigint").alias("seq_id"), "pos", (F.col("v") + F.col("pos")).alias("sym"))


def top_symbols(seq: DataFrame, k: int) -> DataFrame:
    counts = seq.groupBy("seq_id", "sym").agg(F.count(F.lit(1)).alias("cnt"))
    place = F.row_number().over(Window.partitionBy("seq_id").orderBy(F.desc("cnt"), "sym"))
    return counts.withColumn("_p", place).filter(F.col("_p") <= k).drop("_p")


@dataclass
class Timing:
    """Seconds of runs; per query if told how many there are."""

    queries: int = 1
    runs: list[float] = field(default_factory=list)

    def measure(self, action):
        start = time.perf_counter()
        out = action()
        self.runs.append((time.perf_counter() - start) / self.queries)
        return out

    def summary(self) -> dict[str, float]:
        return {"min": min(self.runs), "max": max(self.runs), "avg": sum(self.runs) / len(self.runs)}
