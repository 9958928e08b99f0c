"""The stored index, and plans that must not depend on a sequence's length in one task."""

import random
import re
from collections import Counter

import pytest
from helpers import answers, ask, rank_of, values
from pyspark.sql import functions as F

from seqloom.model import Sequence
from seqloom.operators import ranges, transforms
from seqloom.operators.bits import RUN, BitSequence, SortedSet
from seqloom.plans import prefix
from seqloom.plans.prefix import StoredIndex
from seqloom.sources import builders, scratch


def explained(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_answers_of_an_index_are_those_of_the_sequence(spark, tmp_path):
    r = random.Random(11)
    data = [r.choice([0, 2, 2, 2, 9, 40]) for _ in range(20_000)]
    df = values(spark, data)
    s = Sequence(df, "huffman4").indexed(str(tmp_path / "ix"))
    asked = [(r.choice([0, 1, 2, 9, 40, 41]), r.randrange(20_010)) for _ in range(200)]
    assert answers(s.rank(ask(spark, "rank", asked)), "rank") == [rank_of(data, c, i, huffman=True) for c, i in asked]
    places = {c: [i for i, x in enumerate(data) if x == c] for c in range(42)}
    asked = [(r.choice([0, 1, 2, 9, 40]), r.randrange(11_000)) for _ in range(200)] + [(2, -1), (50, 0)]
    assert answers(s.select(ask(spark, "select", asked)), "pos") == [places.get(c, [])[k] if 0 <= k < len(places.get(c, [])) else None for c, k in asked]
    assert answers(s.get(ask(spark, "get", [0, 7777, 19_999, 20_000])), "sym") == [data[0], data[7777], data[19_999], None]
    got = s.occs_range_batch(ask(spark, "range", [(5, 19_000), (100, 100), (8191, 8193)])).collect()
    want = [(q, c, sum(x == c for x in data[a:z])) for q, (a, z) in enumerate([(5, 19_000), (100, 100), (8191, 8193)]) for c in {*data[a:z]}]
    assert sorted((x["qid"], x["sym"], x["cnt"]) for x in got) == sorted(want)
    assert s.meta.first()["n"] == 20_000 and s.frequencies().count() == 4
    again = Sequence(df).indexed(str(tmp_path / "ix"))  # loaded, not built
    assert again.index.path == s.index.path and again.meta.first()["sigma"] == 40


def test_a_small_batch_reads_only_its_folders(spark, tmp_path):
    seq = spark.range(40).selectExpr("id seq_id", "explode(sequence(0L, 499L)) pos").withColumn("sym", F.col("pos") % 7)
    index = StoredIndex.build(seq, str(tmp_path / "ix"), parts=16)
    s = Sequence(index.data(), index=index)
    q = spark.range(1).selectExpr("1L qid", "3L seq_id", "2L sym", "400L i")  # its size is known
    plan = explained(s.rank(q))
    assert len(re.findall(r"PartitionFilters: \[.*part#", plan)) == 3  # rows, counts and supers
    assert s.rank(q).first()["rank"] == 57
    assert s.select(q.selectExpr("qid", "seq_id", "sym", "57L k")).first()["pos"] == 401
    counts = index.counted(q)[0]
    assert counts.count() < index.counts.count()


def test_a_half_written_index_is_built_again(spark, tmp_path):
    df, path = values(spark, [3, 1, 2]), str(tmp_path / "ix")
    df.write.parquet(f"{path}/rows")  # of a build that died
    assert Sequence(df).indexed(path).meta.first()["n"] == 3
    builders.save(df, str(tmp_path / "t"))
    (tmp_path / "t" / "_SUCCESS").unlink()
    assert builders.load_or_build(spark, str(tmp_path / "t"), lambda: values(spark, [9])).count() == 1


def test_bit_sequences_longer_than_an_array(spark):
    n = 1 << 33
    ones = spark.createDataFrame([(0, 5), (0, 6), (0, n - 2)], "seq_id bigint, pos bigint")
    b = BitSequence(ones, spark.createDataFrame([(0, n)], "seq_id bigint, n_bits bigint"))
    assert b.get_word(n // 64 - 1).first()["word"] == 1 << 62 and b.get_word(0).first()["word"] == 96 and b.get_word(n // 64).count() == 0
    ks = [0, 4, 5, n - 5, n - 4, n - 3]
    assert answers(b.select(ask(spark, "bit", ks), 0), "pos") == [0, 4, 7, n - 3, n - 1, None]
    assert [x["pos"] for x in b.zeros(n - 4).orderBy("pos").collect()] == [n - 4, n - 3, n - 1]
    assert "partitionBy: [seq_id" not in explained(b.zeros(n - 4))


@pytest.mark.parametrize("start", [0, 1, RUN - 1, RUN, RUN + 1, 3 * RUN])
def test_zeros_at_the_edges_of_runs(spark, start):
    n = 3 * RUN + 2
    ones = [0, RUN - 1, RUN, 2 * RUN + 7, n - 1]
    b = BitSequence.from_positions(spark.createDataFrame([(0, p) for p in ones], "seq_id bigint, pos bigint"))
    got = b.zeros(start).agg(F.count(F.lit(1)), F.sum("pos"), F.countDistinct("pos")).first()
    want = [p for p in range(start, n) if p not in ones]
    assert tuple(got) == (len(want), sum(want) if want else None, len(want))


def test_a_set_is_checked_over_the_edges_of_buckets(spark):
    n = RUN + 3
    up = spark.range(n).selectExpr("0L seq_id", "id pos", "2 * id sym")
    total = lambda seq: SortedSet.from_increasing(seq).ones_at.agg(F.sum("pos")).first()[0]
    assert total(up) == n * (n - 1)
    fall = up.withColumn("sym", F.when(F.col("pos") == RUN, 2 * RUN - 2).otherwise(F.col("sym")))  # equal to the last of the bucket before
    with pytest.raises(Exception, match="increasing"):
        total(fall)


def plain_partition(items, shift, bits):
    return sorted(items, key=lambda x: 1 << bits if x[1] <= shift else x[2] >> (x[1] - shift) & ((1 << bits) - 1))


@pytest.mark.parametrize("bits", [1, 2])
def test_partitions_and_levels_by_codes_are_those_of_a_plain_loop(spark, bits):
    r = random.Random(5)
    data = [min(r.randrange(40), r.randrange(40)) for _ in range(150)]
    s = Sequence(values(spark, data), "huffman4" if bits == 2 else "huffman2")
    codes = {x["sym"]: (x["len"], x["content"]) for x in s.codes().collect()}
    now = [(i, *codes[c]) for i, c in enumerate(data)]
    for shift in range(bits, 5 * bits, bits):
        got = transforms.partition_with_codes(s.df, s.codes(), shift, bits).orderBy("new_pos").collect()
        assert [x["pos"] for x in got] == [i for i, *_ in plain_partition([(i, *codes[c]) for i, c in enumerate(data)], shift, bits)]
    want, level, shift = {}, 0, bits
    while any(n >= shift for _, n, _ in now):
        want |= {(level, k): x[2] >> (x[1] - shift) & ((1 << bits) - 1) for k, x in enumerate(x for x in now if x[1] >= shift)}
        now, level, shift = plain_partition(now, shift, bits), level + 1, shift + bits
    assert {(x["level"], x["pos"]): x["digit"] for x in s.levels().collect()} == want


def test_codes_of_many_sequences_and_of_too_many_symbols(spark):
    many = spark.range(300).selectExpr("id seq_id", "explode(sequence(0L, 9L)) pos").withColumn("sym", F.pmod(F.xxhash64("seq_id", "pos"), F.lit(1000)))
    assert transforms.codes(many, most_symbols=10).select("seq_id").distinct().count() == 300
    with pytest.raises(Exception, match="over 5 symbols"):
        transforms.codes(many, most_symbols=5).collect()


def test_packed_words_must_hold_all_bits(spark):
    words = spark.createDataFrame([(0, 0, -1), (0, 1, 3)], "seq_id bigint, w bigint, word bigint")
    size = lambda n: spark.createDataFrame([(0, n)], "seq_id bigint, n_bits bigint")
    assert builders.from_words(words, size(128)).count() == 66
    with pytest.raises(Exception, match="64 times"):
        builders.from_words(words, size(129)).count()


def test_bytes_of_files_in_several_splits(spark, tmp_path):
    r = random.Random(2)
    files = {"a": r.randbytes(9000) + b"\n", "b": b"", "c": b"\n\n\r\n" + bytes(range(256)) * 3, "d": b"x"}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = builders.from_bytes(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    got = {}
    for x in sorted(rows, key=lambda x: (x["seq_id"], x["pos"])):
        got.setdefault(x["seq_id"], []).append((x["pos"], x["sym"]))
    assert list(got.values()) == [list(enumerate(c)) for c in files.values() if c]


def test_scratch_needs_a_shared_folder_off_one_machine(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda *_: None)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session())


def test_weighted_counts_and_selects_over_buckets(spark):
    r = random.Random(9)
    rows = sorted(r.sample(range(3000), 700))
    df = spark.createDataFrame([(0, p, r.randint(1, 5)) for p in rows], "seq_id bigint, pos bigint, w bigint")
    weight = {x["pos"]: x["w"] for x in df.collect()}
    q = ask(spark, "get", list(range(0, 3100, 37)))
    got = answers(prefix.prefix_count(q, df, ["seq_id"], bucket=8, weight="w"), "r")
    assert got == [sum(weight[p] for p in rows if p < i) for i in range(0, 3100, 37)]
    found = answers(prefix.prefix_select(ask(spark, "bit", list(range(-1, 705))), df.drop("w"), ["seq_id"], bucket=8), "pos")
    assert found == [None, *rows, None, None, None, None, None]


def test_ranges_that_meet_in_one_bucket_are_dealt_out(spark, monkeypatch):
    r = random.Random(3)
    data = [r.randrange(5) for _ in range(3000)]
    asked = [(a, min(3000, a + r.randrange(1500))) for a in (r.randrange(100) for _ in range(60))]
    q, want = ask(spark, "range", asked), sorted((i, c, sum(x == c for x in data[a:z])) for i, (a, z) in enumerate(asked) for c in {*data[a:z]})
    monkeypatch.setattr(ranges, "BATCH", 7)
    for small in (True, False):
        monkeypatch.setattr(ranges, "is_small", lambda _, small=small: small)
        got = Sequence(values(spark, data)).occs_range_batch(q).collect()
        assert sorted((x["qid"], x["sym"], x["cnt"]) for x in got) == want


def test_select_in_sql(spark):
    Sequence(values(spark, [4, 1, 4, 4])).register("s_four")
    assert [spark.sql(f"SELECT * FROM s_four_select(4, {k})").collect() for k in range(4)] == [[(0,)], [(2,)], [(3,)], []]


def test_counts_of_an_index_are_dealt_by_symbols(spark, tmp_path):
    seq = spark.range(60_000).selectExpr("0L seq_id", "id pos", "pmod(xxhash64(id), 500) sym")
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    was = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        index = StoredIndex.build(seq, str(tmp_path / "ix"), parts=1)
    finally:
        spark.conf.set(name, was)
    held = [x["count"] for x in index.counts.groupBy(F.input_file_name()).count().collect()]
    assert len(held) > 1 and max(held) < 0.6 * sum(held)


@pytest.mark.parametrize("small", [True, False])
def test_short_and_long_ranges_on_all_levels(spark, monkeypatch, small):
    r = random.Random(8)
    data = [min(r.randrange(30), r.randrange(30)) for _ in range(4000)]
    ends = [tuple(sorted((r.randrange(4001), r.randrange(4001)))) for _ in range(50)]
    asked = [*ends, *ends[:10], *((a, min(4000, a + r.randrange(40))) for a in range(0, 4000, 97)), (0, 4000), (16, 32), (5, 5), (9, 8), (0, 4001), (-1, 3)]
    want = sorted((i, c, n) for i, (a, z) in enumerate(asked) if 0 <= a <= z <= 4000 for c, n in Counter(data[a:z]).items())
    for name, value in (("FANOUT", 4), ("BATCH", 7), ("is_small", lambda _: small)):
        monkeypatch.setattr(ranges, name, value)
    s, q = Sequence(values(spark, data)), ask(spark, "range", asked)
    for of in (s.df, s.df.filter("pos % 5 <> 2 or pos > 3000")):  # and with gaps
        own = {x["pos"] for x in of.collect()}
        meta = s.meta
        got = ranges.occs_range_batch(of, q, meta, bucket=16).collect()
        expected = want if len(own) == 4000 else sorted((i, c, n) for i, (a, z) in enumerate(asked) if 0 <= a <= z <= 4000 for c, n in Counter(x for p, x in enumerate(data[a:z], a) if p in own).items())
        assert sorted((x["qid"], x["sym"], x["cnt"]) for x in got) == expected
    again = ask(spark, "range", [(3, 9), (2000, 2900)]).withColumn("qid", F.lit(5).cast("bigint"))  # all ranges of one qid
    assert {x["sym"]: x["cnt"] for x in s.occs_range_batch(again).collect()} == Counter(data[3:9] + data[2000:2900])


def test_counts_of_short_ranges_are_not_shuffled(spark):
    q = ask(spark, "range", [(3, 9), (40, 900)])
    s = Sequence(values(spark, [1, 2, 3] * 400))
    plan = explained(s.occs_range_batch(q))
    assert "Generate inline" in plan or "inline(" in plan
    assert not re.search(r"hashpartitioning\(qid", plan)


@pytest.mark.parametrize("bits", [1, 2])
def test_levels_over_blocks_of_positions(spark, monkeypatch, bits):
    monkeypatch.setattr(transforms, "BLOCK", 64)
    r = random.Random(6)
    data = [[min(r.randrange(40), r.randrange(40)) for _ in range(500)], [0] * 70, [(1 << 62) + 5, 1, 1 << 62]]
    seq = values(spark, data[0]).unionByName(builders.from_values(spark, data[1], 7)).unionByName(builders.from_values(spark, data[2], 9))
    found = transforms.levels(seq, bits)
    assert "Generate explode" not in explained(found)  # no row a level before the numbering
    want = set()
    for of, own in zip((0, 7, 9), data, strict=True):
        n = max(1, -(-max(own).bit_length() // bits))
        now = own
        for level in range(n):
            digits = [x >> bits * (n - 1 - level) & ((1 << bits) - 1) for x in now]
            want |= {(of, level, i, d) for i, d in enumerate(digits)}
            now = [x for _, x in sorted(zip(digits, now, strict=True), key=lambda y: y[0])]
    assert {(x["seq_id"], x["level"], x["pos"], x["digit"]) for x in found.collect()} == want and found.count() == len(want)
