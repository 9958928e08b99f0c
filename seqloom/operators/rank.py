"""Batched rank: occurrences of a symbol before a position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.operators.ranges import frequencies
from seqloom.plans.prefix import PLANS, StoredIndex, prefix_count

KEYS = ["seq_id", "sym"]


def _bounded(found: DataFrame, meta: DataFrame, value: Column, most: str = "sigma") -> DataFrame:
    m = meta.select("seq_id", F.col("n").alias("_len"), F.col("sigma").alias("_most") if most == "sigma" else F.lit(int(most)).cast("bigint").alias("_most"))
    ok = (F.col("i") >= 0) & (F.col("i") <= F.col("_len")) & (F.col("sym") >= 0) & (F.col("sym") <= F.col("_most"))
    return found.join(m, "seq_id", "left").select("qid", F.when(ok, value).alias("rank"))


def rank(seq: DataFrame, queries: DataFrame, meta: DataFrame, huffman: bool = False, plan: str = "bucketed", most: str = "sigma", index: StoredIndex | None = None) -> DataFrame:
    """queries (qid, seq_id, sym, i) to (qid, rank).

    NULL if i is beyond the length or the symbol beyond the largest one; a symbol that does not
    occur has rank 0 in plain sequences and NULL in Huffman ones. With an index only the buckets that queries fall into are read.
    """
    if index:
        found = prefix_count(queries, index.data(queries), KEYS, stored=index.counted(queries))
    else:
        found = PLANS[plan](queries, seq, KEYS)
    value = F.col("r")
    if huffman:
        found = found.join(index.frequencies(queries) if index else frequencies(seq), KEYS, "left")
        value = F.when(F.col("cnt").isNotNull(), value)
    return _bounded(found, meta, value, most)


def rank_in_texts(texts: DataFrame, queries: DataFrame) -> DataFrame:
    """The same of characters of texts (seq_id, text): each text is met as a whole by its queries, so it is never dealt by characters.

    Occurrences are the characters that leave the prefix when theirs are taken out. Texts of one seq_id add up, as their rows would.
    """
    q = queries.withColumn("_q", F.monotonically_increasing_id())
    prefix = F.expr("substring(text, 1, cast(greatest(0L, least(i, length(text))) as int))")
    some = F.expr("sym between 0 and 1114111 and not sym between 55296 and 57343")  # surrogates are no characters
    character = F.when(some, F.expr("decode(unhex(lpad(hex(sym), 8, '0')), 'UTF-32')"))
    most = F.ascii(F.array_max(F.split("text", ""))).cast("bigint")  # strings are in the order of code points
    most = F.when(F.contains(F.col("text"), character), F.col("sym")).otherwise(most)  # only whether it reaches sym is asked
    gone = F.length(prefix) - F.length(F.replace(prefix, character, F.lit("")))
    met = q.join(texts.filter("text <> ''"), "seq_id", "left").select(*q.columns, F.length("text").cast("bigint").alias("n"), most.alias("sigma"), F.coalesce(gone, F.lit(0)).cast("bigint").alias("r"))
    found = met.groupBy(*q.columns).agg(*(f(c).alias(c) for f, c in ((F.sum, "n"), (F.max, "sigma"), (F.sum, "r"))))
    return found.select("qid", F.when(F.expr("i >= 0 and i <= n and sym >= 0 and sym <= sigma"), F.col("r")).alias("rank"))


def rank_block(seq: DataFrame, queries: DataFrame, meta: DataFrame, block: int) -> DataFrame:
    """Rank at the start of the block of 256 or 512 symbols that holds i."""
    q = queries.select("qid", "seq_id", "sym", F.col("i").alias("_i"), F.expr(f"i - i % {block}").alias("i"))
    found = PLANS["bucketed"](q, seq, KEYS).drop("i").withColumnRenamed("_i", "i")
    return _bounded(found, meta, F.col("r"), "3")


def approx_rank(seq: DataFrame, queries: DataFrame, meta: DataFrame, shift: int = 11) -> DataFrame:
    """Rank from samples one per 2^shift occurrences: never above the rank, below by less than two intervals."""
    rate = 1 << shift
    q = queries.join(meta.select("seq_id", F.col("n").alias("_n")), "seq_id", "left")
    q = q.select("qid", "seq_id", "sym", F.col("i").alias("_i"), F.least(F.expr(f"(i div {rate}) * {rate} + 1"), F.coalesce("_n", F.lit(0).cast("bigint"))).alias("i"))
    found = PLANS["bucketed"](q, seq, KEYS).drop("i").withColumnRenamed("_i", "i")
    return _bounded(found, meta, F.expr(f"(r div {rate}) * {rate}"))
