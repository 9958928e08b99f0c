import random

import pytest
from helpers import answers, ask, rank_of, values
from seqloom.model import QuadSequence, Sequence, TextSequence
from seqloom.operators import ranges, transforms

F1 = [1, 0, 1, 0, 2, 4, 5, 3]  # fixed values: the documented example, FIXTURES.md F1
F4 = [1, 0, 1, 0, 3, 4, 5, 3, 7]


def test_golden_answers(spark):
    s = Sequence(values(spark, F1))
    assert answers(s.get(ask(spark, "get", [2, 3, 8])), "sym") == [1, 0, None]
    assert answers(s.rank(ask(spark, "rank", [(1, 2), (1, 0), (3, 8), (1, 9), (6, 1)])), "rank") == [1, 0, 1, None, None]
    assert answers(s.select(ask(spark, "select", [(1, 0), (1, 1), (0, 1), (0, 2), (4, 0), (5, 0), (1, 3), (6, 1)])), "pos") == [0, 2, 3, None, 5, 6, None, None]
    assert [tuple(r) for r in s.occs_range(2, 6).collect()] == [(0, 1), (1, 1), (2, 1), (4, 1)]
    m = s.meta.first()
    assert (m["n"], m["sigma"]) == (8, 5)


@pytest.mark.parametrize("variant", ["plain", "plain2", "huffman4", "huffman2"])
@pytest.mark.parametrize("plan", ["bucketed", "window", "join"])
def test_rank_in_every_variant_and_plan(spark, variant, plan):
    data = [*F4, 64001]
    asked = [(8, 1), (1, 11), (1, 9), (1, 10), (7, 9), (64001, 10), (70000, 1), (1, -1)]
    s = Sequence(values(spark, data), variant)
    assert answers(s.rank(ask(spark, "rank", asked), plan), "rank") == [rank_of(data, c, i, s.huffman) for c, i in asked]


@pytest.mark.parametrize(("variant", "n"), [("plain", 4), ("huffman4", 2), ("plain2", 8), ("huffman2", 3)])
def test_n_levels(spark, variant, n):
    assert Sequence(values(spark, [1, 0, 1, 0, 255, 4, 5, 3]), variant).n_levels().first()["n_levels"] == n


def test_select_inverts_rank_and_iteration_returns_the_sequence(spark):
    r = random.Random(3)
    data = [r.randrange(9) for _ in range(400)]
    s = Sequence(values(spark, data))
    assert [x["sym"] for x in s.iterate().collect()] == data
    assert [x["sym"] for x in s.iterate(backward=True).collect()] == data[::-1]
    ranks = answers(s.rank(ask(spark, "rank", [(c, i) for i, c in enumerate(data)])), "rank")
    assert answers(s.select(ask(spark, "select", list(zip(data, ranks)))), "pos") == list(range(len(data)))


def test_ranges_agree_with_counting_and_with_rank(spark):
    r = random.Random(4)
    data = [r.randrange(40) for _ in range(1500)]
    asked = [tuple(sorted((r.randrange(1501), r.randrange(1501)))) for _ in range(20)] + [(5, 4), (0, 1501), (7, 7), (None, 5), (3, None), (1500, 1500), (None, None)]
    df = values(spark, data)
    s, q = Sequence(df), ask(spark, "range", asked)
    want = {}
    for n, (a, b) in enumerate(asked):
        a, b = a or 0, len(data) if b is None else b
        if a <= b <= len(data):
            want |= {(n, c): data[a:b].count(c) for c in set(data[a:b])}
    for bucket in (4, 16, 1024):
        assert {(x["qid"], x["sym"]): x["cnt"] for x in ranges.occs_range_batch(df, q, s.meta, bucket).collect()} == want
    assert {(x["qid"], x["sym"]): x["cnt"] for x in ranges.occs_range_naive(df, q, s.meta).collect()} == want
    assert answers(s.range_status(q), "ok") == [n not in (20, 21) for n in range(len(asked))]
    assert ranges.normalised(None, 4, 9, r_closed=True) == (0, 5) and ranges.normalised(5, 4, 9) is None and ranges.normalised(9, None, 9) == (9, 9)


def test_small_buckets_count_as_large_ones(spark):
    from seqloom.plans.prefix import occurrence_index, prefix_count

    r = random.Random(5)
    data = [r.randrange(3) for _ in range(700)]
    df = values(spark, data)
    asked = [(r.randrange(3), r.randrange(701)) for _ in range(60)]
    got = prefix_count(ask(spark, "rank", asked), df, ["seq_id", "sym"], bucket=5)
    assert answers(got, "r") == [data[:i].count(c) for c, i in asked]
    indexed = {x["pos"]: x["k"] for x in occurrence_index(df, ["seq_id", "sym"], bucket=5).collect()}
    assert indexed == {i: data[:i].count(c) for i, c in enumerate(data)}


def test_empty_sequence(spark):
    s = Sequence(values(spark, []))
    assert answers(s.get(ask(spark, "get", [0])), "sym") == [None]
    assert answers(s.rank(ask(spark, "rank", [(0, 0)])), "rank") == [None]
    assert answers(s.select(ask(spark, "select", [(0, 0)])), "pos") == [None]
    assert s.occs_range().collect() == [] and s.meta.collect() == []
    assert [x["ok"] for x in s.range_status(ask(spark, "range", [(None, None), (0, 1)])).orderBy("qid").collect()] == [True, False]


def test_symbols_beyond_32_bits_and_beyond_the_largest(spark):
    big = 1 << 40
    s = Sequence(values(spark, [5, big, 5, big + 1]), "plain2")
    assert answers(s.select(ask(spark, "select", [(big, 0), (8, 0), (big + 1, 0)])), "pos") == [1, None, 3]
    assert answers(s.rank(ask(spark, "rank", [(big, 4), (1 << 41, 1)])), "rank") == [1, None]


def test_approximate_rank_is_near_rank(spark):
    """At most the rank behind the next symbol (a sample counts the position it stands at), and at most two intervals less."""
    r = random.Random(6)
    data = [r.randrange(2) for _ in range(300)]
    asked = [(r.randrange(2), r.randrange(301)) for _ in range(50)]
    s = Sequence(values(spark, data))
    for shift in (1, 3):
        for got, (c, i) in zip(answers(s.approx_rank(ask(spark, "rank", asked), shift), "rank"), asked):
            assert got <= rank_of(data, c, min(i + 1, len(data))) and rank_of(data, c, i) < got + 2 * (1 << shift)


def test_quads(spark):
    s = QuadSequence.of(values(spark, [i % 4 for i in range(10)]))
    assert answers(s.rank(ask(spark, "rank", [(0, 0), (0, 1), (0, 2), (0, 10), (0, 11), (4, 1)])), "rank") == [0, 1, 1, 3, None, None]
    assert answers(s.select(ask(spark, "select", [(0, 0), (0, 1), (0, 2), (0, 3)])), "pos") == [0, 4, 8, None]
    assert [tuple(x)[1:] for x in s.occs().orderBy("sym").collect()] == [(0, 3, 0), (1, 3, 3), (2, 2, 6), (3, 2, 8)]
    cut = QuadSequence.of(values(spark, [-1, 4, 7, 2]))
    assert [x["sym"] for x in cut.iterate().collect()] == [3, 0, 3, 2]
    zeros = QuadSequence.of(values(spark, [0] * 700))
    assert answers(zeros.rank_block(ask(spark, "rank", [(0, 255), (0, 256), (0, 600)]), 256), "rank") == [0, 256, 512]
    assert answers(zeros.rank_block(ask(spark, "rank", [(0, 600), (3, 600)]), 512), "rank") == [512, 0]


def test_partitions_are_stable_sorts(spark):
    data = [1, 2, 3, 0, 2, 2, 2, 3, 3, 0, 0, 0, 1, 3, 2, 1]
    for f, key in ((transforms.partition_of_4, lambda x: x & 3), (transforms.partition_of_2, lambda x: x & 1)):
        rows = f(values(spark, data), 0).orderBy("new_pos").collect()
        assert [x["pos"] for x in rows] == sorted(range(16), key=lambda i: key(data[i]))
        assert [x["new_pos"] for x in rows] == list(range(16))


@pytest.mark.parametrize("bits", [1, 2])
def test_levels_are_repeated_stable_partitions(spark, bits):
    data = [5, 17, 0, 33, 6, 17, 2, 9, 63, 1]
    n = -(-max(data).bit_length() // bits)
    want, now = {}, list(data)
    for level in range(n):
        digits = [x >> bits * (n - 1 - level) & ((1 << bits) - 1) for x in now]
        want |= {(level, i): d for i, d in enumerate(digits)}
        now = [x for _, x in sorted(zip(digits, now), key=lambda t: t[0])]
    got = {(x["level"], x["pos"]): x["digit"] for x in transforms.levels(values(spark, data), bits).collect()}
    assert got == want


@pytest.mark.parametrize("bits", [1, 2])
@pytest.mark.parametrize("weights", [{7: 5}, {0: 1, 1: 1}, {i: i * i + 1 for i in range(23)}, {i: 2**i for i in range(12)}])
def test_codes_are_prefix_free_and_as_long_as_told(bits, weights):
    lengths = transforms.huffman_lengths(weights, 1 << bits)
    codes = transforms.assign_codes(lengths, bits)
    assert {s: n // bits for s, (n, _) in codes.items()} == lengths
    texts = [format(c, f"0{n}b") for n, c in codes.values()]
    assert len(set(texts)) == len(texts) and not any(a != b and b.startswith(a) for a in texts for b in texts)
    assert sum((1 << bits) ** -n for n in lengths.values()) <= 1


def test_huffman_cost_is_least_and_codes_decode(spark):
    data = [0] * 50 + [1] * 20 + [2] * 9 + [3] * 8 + [4]
    s = Sequence(values(spark, data), "huffman2")
    codes = s.codes()
    assert transforms.huffman_cost(s.df, codes).first()["bits"] == 50 + 20 * 2 + 9 * 3 + 9 * 4
    back = transforms.decode(s.df.join(codes, ["seq_id", "sym"]).drop("sym"), codes)
    assert [x["sym"] for x in back.orderBy("pos").collect()] == data
    assert [x["n"] for x in transforms.level_lengths(s.df, codes, 1).orderBy("level").collect()] == [88, 38, 18, 9]
    assert transforms.partition_with_codes(s.df, codes, 1, 1).filter("len <= 1").selectExpr("min(new_pos)").first()[0] == 38


def test_validation(spark):
    with pytest.raises(ValueError, match="variant"):
        Sequence(values(spark, F1), "other")
    with pytest.raises(TypeError, match="bigint"):
        Sequence(spark.createDataFrame([(0, 0, "a")], "seq_id bigint, pos bigint, sym string"))
    with pytest.raises(Exception, match="negative symbol"):
        Sequence(values(spark, [1, -1])).checked().df.collect()


def test_sql_functions(spark):
    Sequence(values(spark, F1)).register("f_one")
    assert sorted(map(tuple, spark.sql("SELECT * FROM f_one_occs_range(2, 6)").collect())) == [(0, 1), (1, 1), (2, 1), (4, 1)]
    assert spark.sql("SELECT * FROM f_one_rank(1, 2)").first()[0] == 1


def test_ranks_in_texts_are_those_of_their_characters(spark):
    texts = [(1, "abcabéa\U0001f600"), (2, ""), (3, None), (4, "\x00z\x00"), (5, "x" * 50_000 + "y"), (6, "aab"), (6, "ba"), (7, "a�b")]
    s = TextSequence.of(spark.createDataFrame(texts, "id bigint, text string"), "text", "id")
    syms = [-1, 0, 97, 98, 120, 121, 233, 0xD800, 0xFFFD, 0x1F600, 0x110000, 1 << 40, None]
    asked = [(k, c, i) for k in range(9) for c in syms for i in (-1, 0, 1, 3, 8, 50_000, 1 << 40, None)]
    q = spark.createDataFrame([(n, *x) for n, x in enumerate([*asked, asked[3]])], "qid bigint, seq_id bigint, sym bigint, i bigint")
    got, want = s.rank(q), s.rank(q, "bucketed")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.filter("rank > 0").count() > 20
    assert "Generate" not in got._sc._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "formatted")  # no row a character
    assert s.rank(q.limit(0)).count() == 0 and not hasattr(s.extend(s.df), "texts")
