"""Token counts by an exact length histogram (operator 10).

Documents are aggregated by encoded length; suffix sums over the lengths then answer, for every
context limit at which an answer can change, how many documents are longer, how many tokens are
kept when each document is cut at the limit, and which quantile the limit is. The histogram has
one row for each length that occurs; suffix sums run in blocks of lengths, each block's own rows in
one window, so no task takes all lengths. Null texts count as empty texts (length 0); an empty
table gives an empty histogram. Only ``doc_id`` (its values do not matter) and ``text`` are read.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.llm import byte_bpe, common

#: Lengths in a block of the suffix sums.
BLOCK = 64


def encoded_lengths(df: DataFrame, keep: list[str], ranks_path: str | None = None, json_path: str | None = None) -> DataFrame:
    """``keep[0]`` and ``n_tokens`` of each whole text."""
    ranks = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    json = json_path or public_tokenizers.path("byte_bpe_50k.json")
    schema = T.StructType([df.schema[keep[0]], T.StructField("n_tokens", T.LongType())])

    def made(keys, texts):
        encode = byte_bpe.library_encoder(ranks, json)
        return keys, [len(encode(common.text_of(t))) for t in texts]

    return common.map_columns(df, [keep[0], "text"], schema, made)


def histogram(lengths: DataFrame) -> DataFrame:
    """One row for each length: ``n_tokens``, ``n_docs``. Partial sums leave one row a task and length to shuffle."""
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def _suffix(name: str) -> list[Column]:
    """Sums over lengths above the row's: within its block, and over later blocks."""
    inner = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return [(F.coalesce(F.sum(name).over(inner), F.lit(0)) + F.col(f"after_{name}")).cast("long")]


def limits(hist: DataFrame) -> DataFrame:
    """Answers for every context limit that is a length of some document.

    ``docs_longer``: documents cut by the limit. ``tokens_total``: tokens of all documents.
    ``tokens_kept``: the sum of min(length, limit). ``tokens_cut``: the difference.
    ``share_fitting``: the share of documents no longer than the limit; the limit is the quantile of
    that share. Between two lengths, ``docs_longer`` stays as at the smaller one and ``tokens_kept``
    grows by it for each token of the limit.
    """
    h = common.scratch(hist.withColumns({"block": F.expr(f"n_tokens div {BLOCK}"), "tokens": F.col("n_tokens") * F.col("n_docs")}), "lengths")
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("n_docs"), F.sum("tokens").alias("tokens"))
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    blocks = blocks.select(
        "block",
        *(F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"after_{c}") for c in ("n_docs", "tokens")),
        *(F.sum(c).over(everything).alias(f"all_{c}") for c in ("n_docs", "tokens")),
    )
    out = h.join(blocks, "block").select("n_tokens", "n_docs", *(c.alias(f"longer_{n}") for n in ("n_docs", "tokens") for c in _suffix(n)), "all_n_docs", "all_tokens")
    kept = F.col("all_tokens") - F.col("longer_tokens") + F.col("n_tokens") * F.col("longer_n_docs")
    return out.select(
        F.col("n_tokens").alias("context_limit"),
        "n_docs",
        F.col("longer_n_docs").alias("docs_longer"),
        F.col("all_tokens").alias("tokens_total"),
        kept.alias("tokens_kept"),
        (F.col("all_tokens") - kept).alias("tokens_cut"),
        ((F.col("all_n_docs") - F.col("longer_n_docs")) / F.col("all_n_docs")).alias("share_fitting"),
    )


def quantile(answers: DataFrame, share: float) -> DataFrame:
    """The smallest length that at least ``share`` of the documents do not exceed."""
    return answers.filter(F.col("share_fitting") >= share).agg(F.min("context_limit").alias("length"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return limits(histogram(encoded_lengths(docs, ["doc_id"])))
