import random

import pytest
from helpers import answers, ask, values
from pyspark.sql import functions as F
from seqloom.functions import words
from seqloom.operators.bits import BitSequence, SortedSet, negate


def ones(spark, places):
    return BitSequence.from_positions(spark.createDataFrame([(0, p) for p in places], "seq_id bigint, pos bigint"))


def positions(df):
    return [r["pos"] for r in df.orderBy("pos").collect()]


def test_reading(spark):
    b = ones(spark, [4, 0, 2, 3, 5, 5])
    c = b.counts().first()
    assert (c["n_bits"], c["count_ones"], c["count_zeros"], c["n_lines"]) == (6, 5, 1, 1)
    assert answers(b.get(ask(spark, "get", [1, 5, 10])), "bit") == [False, True, None]
    assert answers(b.get_bits(ask(spark, "bits", [(1, 3), (1, 8), (0, 65), (0, 0)])), "value") == [6, None, None, None]
    assert [r["word"] for r in ones(spark, [0, 2, 3, 4, 5, 64, 129]).words().orderBy("w").collect()] == [61, 1, 2]
    assert [r["word"] for r in ones(spark, [63]).words().collect()] == [-(1 << 63)]


def test_scans_from_a_place(spark):
    b = ones(spark, [0, 63, 128, 129, 254, 1026])  # fixed values: known answers, FIXTURES.md F22
    for start, want in ((2, [63, 128, 129, 254, 1026]), (129, [129, 254, 1026]), (130, [254, 1026]), (1027, [])):
        assert positions(b.ones(start)) == want
    assert positions(b.zeros()) == [i for i in range(1027) if i not in (0, 63, 128, 129, 254, 1026)]
    assert positions(b.zeros(63))[0] == 64 and positions(b.zeros(63))[-1] == 1025


def test_select_and_rank(spark):
    at = [3, 5, 8, 128, 129, 513, 1000, 1024, 1025]  # fixed values: known answers, FIXTURES.md F23
    b = ones(spark, at)
    assert answers(b.select(ask(spark, "bit", [0, 1, 2, 3, 4, 5, 8, 9])), "pos") == [3, 5, 8, 128, 129, 513, 1025, None]
    assert answers(b.select(ask(spark, "bit", [0, 1, 2, 3, 124, 125, 1016, 1017]), 0), "pos") == [0, 1, 2, 4, 127, 130, 1023, None]
    q = [*at, *(p + 1 for p in at), 1027]
    assert answers(b.rank(ask(spark, "get", q)), "rank") == [*range(9), *range(1, 10), None]
    assert answers(b.rank(ask(spark, "get", q), 0), "rank")[:9] == [p - j for j, p in enumerate(at)]
    empty = BitSequence.zeros_of(spark.createDataFrame([(0, 0)], "seq_id bigint, n_bits bigint"))
    assert answers(empty.rank(ask(spark, "get", [0, 100])), "rank") == [None, None]


def test_changes(spark):
    zeros = BitSequence.zeros_of(spark.createDataFrame([(0, 1037)], "seq_id bigint, n_bits bigint"))
    assert answers(zeros.get_bits(ask(spark, "bits", [(61, 35), (994, 42), (995, 42)]), strict_end=True), "value") == [0, 0, None]
    assert answers(zeros.get_bits(ask(spark, "bits", [(995, 42), (996, 42)])), "value") == [0, None]
    b = zeros.set_bits(0, 6, 42).set_bits(975, 61, 42).set_bits(969, 33, 42)
    assert answers(b.get_bits(ask(spark, "bits", [(0, 6), (969, 33)])), "value") == [42, 42]
    again = b.set_bits(0, 6, 1)
    assert again.counts().first()["count_ones"] == b.counts().first()["count_ones"] - 2
    with pytest.raises(ValueError, match="length"):
        zeros.append_bits(4, 2)
    with pytest.raises(Exception, match="out of range"):
        zeros.set_bits(1030, 8, 255).ones().collect()
    small = ones(spark, [1]).push(True).push(False).extend_zeros(3)
    assert positions(small.ones()) == [1, 2] and small.sizes.first()["n_bits"] == 7
    both = small.extend(ones(spark, [0]))
    assert positions(both.ones()) == [1, 2, 7] and both.sizes.first()["n_bits"] == 8
    grown = small.extend_positions(spark.createDataFrame([(0, 9), (0, 1)], "seq_id bigint, pos bigint"))
    assert positions(grown.ones()) == [1, 2, 9] and grown.sizes.first()["n_bits"] == 10


def test_sorted_set(spark):
    s = SortedSet.from_increasing(values(spark, [0, 12, 33, 42, 55, 61, 1000]), with_select0=True)
    assert answers(s.select(ask(spark, "bit", [1])), "pos") == [12]
    assert answers(s.select(ask(spark, "bit", [1, 11]), 0), "pos") == [2, 13]
    with pytest.raises(ValueError, match="select0"):
        SortedSet.from_increasing(values(spark, [1])).select(ask(spark, "bit", [0]), 0)
    with pytest.raises(Exception, match="increasing"):
        SortedSet.from_increasing(values(spark, [3, 3])).ones().collect()
    dense_after_sparse = [256 * i for i in range(1024)] + list(range(262144, 263168))
    assert answers(SortedSet.from_increasing(values(spark, dense_after_sparse)).select(ask(spark, "bit", [1024])), "pos") == [262144]


def test_negation_inverts(spark):
    r = random.Random(1)
    v = sorted(r.sample(range(300), 60))
    assert positions(negate(spark.createDataFrame([(0, x) for x in v], "seq_id bigint, pos bigint"))) == [x for x in range(v[-1]) if x not in v]


def test_words(spark):
    df = spark.createDataFrame([(1, 0), (2, 0), (63, 2), (1022, 1), (0x5050505050505050, 15), (0x5050505050505050, 16), (-1, 63)], "w bigint, k bigint")
    assert [r[0] for r in df.select(words.select_in_word("w", "k")).collect()] == [0, 1, 2, 2, 62, 64, 63]
    wide = spark.createDataFrame([(1, 6, 0), (1, 6, 2), (1, 6, 3)], "lo bigint, hi bigint, k bigint")
    assert [r[0] for r in wide.select(words.select_in_word_128("lo", "hi", "k")).collect()] == [0, 66, 128]
    one = spark.range(1)
    assert [one.select(words.msb(F.lit(v).cast("bigint"))).first()[0] for v in (0, 1, 10**6)] == [0, 0, 19]
    assert one.select(words.popcnt_wide(F.array(F.lit(3), F.lit(-1), F.lit(9)), 2)).first()[0] == 66
