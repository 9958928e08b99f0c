"""Bit functions on 64-bit words held in BIGINT columns; all are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def msb(value: Column | str) -> Column:
    """Index of the highest set bit; 0 for 0."""
    return (F.length(F.bin(_col(value))) - 1).cast("bigint")


def select_in_word(word: Column | str, k: Column | str) -> Column:
    """Position of the (k+1)-th set bit, 64 if there is none."""
    w = _col(word)
    ones = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda x: F.getbit(w, x) == 1)
    return F.coalesce(F.get(ones, _col(k).cast("int")), F.lit(64)).cast("bigint")


def select_in_word_128(low: Column | str, high: Column | str, k: Column | str) -> Column:
    """The same in 128 bits given as two words; 128 if there is none."""
    here = F.bit_count(_col(low)).cast("bigint")
    return F.when(here > _col(k), select_in_word(low, k)).otherwise(64 + select_in_word(high, _col(k) - here))


def popcnt_wide(words: Column | str, n: int) -> Column:
    """Set bits in the first ``n`` words of an array."""
    return F.aggregate(F.slice(_col(words), 1, n), F.lit(0).cast("bigint"), lambda a, w: a + F.bit_count(w).cast("bigint"))


def digit(sym: Column | str, shift: int | Column, bits: int = 2) -> Column:
    """``bits`` bits of a symbol, from bit ``shift`` on."""
    s = _col(sym)
    moved = F.shiftright(s, shift) if isinstance(shift, int) else F.call_function("shiftright", s, shift)
    return moved.bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))


def n_digits(sigma: Column | str, bits: int = 2) -> Column:
    """Digits that the largest symbol takes: the number of levels of a plain sequence."""
    return F.ceil((msb(sigma) + 1) / bits).cast("bigint")


def register(spark: SparkSession) -> None:
    """``seq_msb``, ``seq_select_in_word`` and ``seq_popcnt`` for SQL, as SQL functions that the optimizer inlines."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION seq_msb(v BIGINT) RETURNS BIGINT RETURN length(bin(v)) - 1")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION seq_select_in_word(w BIGINT, k BIGINT) RETURNS BIGINT RETURN coalesce(get(filter(sequence(0, 63), x -> getbit(w, x) = 1), cast(k AS INT)), 64)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION seq_popcnt(ws ARRAY<BIGINT>, n INT) RETURNS BIGINT RETURN aggregate(slice(ws, 1, n), 0L, (a, w) -> a + bit_count(w))")
