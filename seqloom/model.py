"""Sequences with their variant: one implementation, whose variants differ where the semantics do."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions.words import msb, n_digits
from seqloom.operators import access, ranges, transforms
from seqloom.operators import rank as ranks
from seqloom.operators import select as selects
from seqloom.plans.prefix import StoredIndex
from seqloom.sources import builders
from seqloom.sources.scratch import shared_dir

#: name: (bits of a digit, Huffman-shaped)
VARIANTS = {"plain": (2, False), "plain2": (1, False), "huffman4": (2, True), "huffman2": (1, True)}


def meta_of(seq: DataFrame) -> DataFrame:
    """seq_id, n and sigma, the largest symbol."""
    return seq.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"), F.max("sym").alias("sigma"))


@dataclass(frozen=True)
class Sequence:
    """``df``: seq_id, pos (dense from 0) and sym (0 <= sym < 2^63), all BIGINT."""

    df: DataFrame
    variant: str = "plain"
    index: StoredIndex | None = None

    def __post_init__(self):
        if self.variant not in VARIANTS:
            raise ValueError(f"variant must be one of {sorted(VARIANTS)}")
        kinds = dict(self.df.dtypes)
        for c in ("seq_id", "pos", "sym"):
            if kinds.get(c) != "bigint":
                raise TypeError(f"{c} must be bigint, not {kinds.get(c)}")

    def checked(self) -> Sequence:
        """The same; negative symbols are an error when rows are computed."""
        ok = F.when(F.col("sym") >= 0, F.col("sym")).otherwise(F.raise_error(F.lit("negative symbol")).cast("bigint"))
        return replace(self, df=self.df.withColumn("sym", ok), index=None)

    def indexed(self, path: str | None = None) -> Sequence:
        """The same with stored bucket counts: the build that every later rank, select and range batch reuses.

        ``path`` keeps the index, and one that is complete there is loaded; otherwise it is a table of this session.
        """
        spark = self.df.sparkSession
        path = path or f"{shared_dir(spark)}/seqloom-index-{uuid.uuid4().hex}"
        built = StoredIndex.load(spark, path) if builders.complete(spark, f"{path}/meta") else None
        if built is None:
            builders.remove(spark, path)
            built = StoredIndex.build(self.df, path)
        return replace(self, df=built.data(), index=built)

    @property
    def bits(self) -> int:
        return VARIANTS[self.variant][0]

    @property
    def huffman(self) -> bool:
        return VARIANTS[self.variant][1]

    @cached_property
    def meta(self) -> DataFrame:
        return self.index.meta() if self.index else meta_of(self.df)

    def get(self, queries: DataFrame) -> DataFrame:
        return access.get(self.index.data(queries) if self.index else self.df, queries)

    def iterate(self, backward: bool = False) -> DataFrame:
        return access.iterate(self.df, backward)

    def rank(self, queries: DataFrame, plan: str = "bucketed") -> DataFrame:
        return ranks.rank(self.df, queries, self.meta, self.huffman, plan, index=self.index)

    def rank_prefetch(self, queries: DataFrame) -> DataFrame:
        """The answers of ``rank``: prefetching is a matter of memory hierarchies."""
        return self.rank(queries)

    def approx_rank(self, queries: DataFrame, shift: int = 11) -> DataFrame:
        return ranks.approx_rank(self.df, queries, self.meta, shift)

    def rank_block(self, queries: DataFrame, block: int = 256) -> DataFrame:
        return ranks.rank_block(self.df, queries, self.meta, block)

    def select(self, queries: DataFrame) -> DataFrame:
        return selects.select(self.df, queries, self.index)

    def occs_range(self, l: int | None = None, r: int | None = None) -> DataFrame:  # noqa: E741
        return ranges.occs_range(self.df, l, r)

    def occs_range_batch(self, queries: DataFrame) -> DataFrame:
        return ranges.occs_range_batch(self.df, queries, self.meta, index=self.index)

    def range_status(self, queries: DataFrame) -> DataFrame:
        return ranges.range_status(queries, self.meta)

    def frequencies(self) -> DataFrame:
        return self.index.frequencies() if self.index else ranges.frequencies(self.df)

    def levels(self) -> DataFrame:
        """The content of every level: digits of symbols, or of codes in a Huffman-shaped sequence."""
        if self.huffman:
            return transforms.code_levels(self.df, self.codes(), self.bits)
        return transforms.levels(self.df, self.bits)

    def codes(self) -> DataFrame:
        return transforms.codes(self.df, self.bits)

    def n_levels(self) -> DataFrame:
        """seq_id and n_levels: digits of the largest symbol, or of the longest code."""
        if self.huffman:
            return self.codes().groupBy("seq_id").agg((F.max("len") / self.bits).cast("bigint").alias("n_levels"))
        return self.meta.select("seq_id", n_digits("sigma", self.bits).alias("n_levels"))

    def space(self, overhead: float = 0.125) -> DataFrame:
        """seq_id and modelled bits, with counters of 12.5 % (blocks of 256) or 6.25 % (of 512)."""
        if self.huffman:
            own = transforms.huffman_cost(self.df, self.codes())
        else:
            own = self.meta.select("seq_id", (F.col("n") * n_digits("sigma", self.bits) * self.bits).alias("bits"))
        return own.select("seq_id", F.round(F.col("bits") * (1 + overhead)).cast("bigint").alias("bits"))

    def extend(self, more: DataFrame) -> Sequence:
        return replace(self, df=builders.append(self.df, more), index=None)

    def save(self, path: str, mode: str = "errorifexists") -> None:
        builders.save(self.df, path, mode)

    def equals(self, other: Sequence) -> bool:
        return self.df.exceptAll(other.df).isEmpty() and other.df.exceptAll(self.df).isEmpty()

    def register(self, name: str) -> None:
        """For SQL: view ``name``, table functions ``name_occs_range(l, r)``, ``name_rank(sym, i)`` and ``name_select(sym, k)`` on it."""
        spark = self.df.sparkSession
        self.df.createOrReplaceTempView(name)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}_occs_range(l BIGINT, r BIGINT) RETURNS TABLE(sym BIGINT, cnt BIGINT) RETURN SELECT s.sym, count(*) FROM {name} s WHERE s.pos >= l AND s.pos < r GROUP BY s.sym")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}_rank(c BIGINT, i BIGINT) RETURNS TABLE(rank BIGINT) RETURN SELECT count(*) FROM {name} s WHERE s.sym = c AND s.pos < i")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}_select(c BIGINT, k BIGINT) RETURNS TABLE(pos BIGINT) RETURN SELECT o.pos FROM (SELECT s.pos, row_number() OVER (ORDER BY s.pos) - 1 AS n FROM {name} s WHERE s.sym = c) o WHERE o.n = k")


class QuadSequence(Sequence):
    """Symbols 0 to 3: others are cut to their two low bits."""

    @classmethod
    def of(cls, df: DataFrame) -> QuadSequence:
        return cls(builders.quads(df))

    def rank(self, queries: DataFrame, plan: str = "bucketed") -> DataFrame:
        return ranks.rank(self.df, queries, self.meta, False, plan, "3", self.index)

    def occs(self) -> DataFrame:
        return ranges.occs(self.df)


@dataclass(frozen=True)
class TextSequence(Sequence):
    """The characters of ``texts`` (seq_id, text), one sequence a row: ranks are counted in the texts themselves."""

    texts: DataFrame | None = None

    @classmethod
    def of(cls, df: DataFrame, text: str, seq_id: str) -> TextSequence:
        texts = df.select(F.col(seq_id).cast("bigint").alias("seq_id"), F.col(text).alias("text"))
        return cls(builders.from_text(texts, "text", "seq_id"), texts=texts)

    def rank(self, queries: DataFrame, plan: str = "texts") -> DataFrame:
        if plan != "texts" or self.index or self.huffman:
            return super().rank(queries, "bucketed" if plan == "texts" else plan)
        return ranks.rank_in_texts(self.texts, queries)

    def checked(self) -> Sequence:
        return self._rows().checked()

    def extend(self, more: DataFrame) -> Sequence:
        return self._rows().extend(more)

    def _rows(self) -> Sequence:
        """The same without its texts, which other rows would not agree with."""
        return Sequence(self.df, self.variant, self.index)


__all__ = ["VARIANTS", "QuadSequence", "Sequence", "TextSequence", "meta_of", "msb"]
