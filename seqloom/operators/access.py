"""Point access and ordered iteration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def get(seq: DataFrame, queries: DataFrame, at: str = "i") -> DataFrame:
    """queries (qid, seq_id, i) with sym; NULL out of range."""
    s = seq.select("seq_id", F.col("pos").alias(at), "sym")
    return queries.join(s, ["seq_id", at], "left").select("qid", "sym")


def iterate(seq: DataFrame, backward: bool = False) -> DataFrame:
    """Rows in the order of positions, or against it."""
    return seq.orderBy("seq_id", F.desc("pos") if backward else F.asc("pos"))
