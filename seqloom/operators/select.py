"""Batched select: the position of a symbol's k-th occurrence, k from 0."""

from __future__ import annotations

from pyspark.sql import DataFrame

from seqloom.plans.prefix import StoredIndex, prefix_select

KEYS = ["seq_id", "sym"]


def select(seq: DataFrame, queries: DataFrame, index: StoredIndex | None = None) -> DataFrame:
    """queries (qid, seq_id, sym, k) to (qid, pos); NULL where there is no such occurrence."""
    return prefix_select(queries, seq, KEYS, index=index).select("qid", "pos")
