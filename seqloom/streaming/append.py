"""Symbol counts and range counts kept up to date over an appended stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.sources.builders import SEQUENCE


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files that arrive in a sequence's folder."""
    return spark.readStream.schema(SEQUENCE).parquet(path)


def frequencies(stream: DataFrame) -> DataFrame:
    """Running symbol counts."""
    return stream.groupBy("seq_id", "sym").agg(F.count(F.lit(1)).alias("cnt"))


def bucket_counts(stream: DataFrame, bucket: int = 4096) -> DataFrame:
    """Running counts by bucket of positions: what batched rank sums up."""
    return stream.groupBy("seq_id", "sym", F.expr(f"pos div {bucket}").alias("bucket")).agg(F.count(F.lit(1)).alias("cnt"))
