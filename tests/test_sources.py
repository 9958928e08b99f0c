import __spark_entry__ as entry
import pytest
from helpers import values
from pyspark.sql import functions as F
from seqloom import generators
from seqloom.model import Sequence
from seqloom.operators import transforms
from seqloom.plans.prefix import dense_positions
from seqloom.sources import builders
from seqloom.streaming import append

SF = "/root/testdata/sf0.001"


def test_dense_positions_and_many_sequences(spark):
    df = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("o"), (F.col("id") % 3).alias("g"))
    assert [(r["o"], r["pos"]) for r in dense_positions(df, ["o"]).orderBy("o").collect()] == [(i, i) for i in range(1000)]
    many = builders.ordered(df, ["o"], "o", "g")
    for g in range(3):
        rows = many.filter(f"seq_id = {g}").orderBy("pos").collect()
        assert [r["pos"] for r in rows] == list(range(len(rows))) and [r["sym"] for r in rows] == sorted(r["sym"] for r in rows)


def test_texts_files_and_storage(spark, tmp_path):
    docs = spark.createDataFrame([(1, "aé\n"), (2, ""), (3, None)], "id bigint, text string")
    assert [tuple(r) for r in builders.from_text(docs, "text", "id").orderBy("pos").collect()] == [(1, 0, 97), (1, 1, 233), (1, 2, 10)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.bin").write_bytes(bytes([0, 255, 7]))
    assert [r["sym"] for r in builders.from_bytes(spark, str(tmp_path / "in")).orderBy("pos").collect()] == [0, 255, 7]
    s, path, built = Sequence(values(spark, [0] * 10)), str(tmp_path / "seq"), []
    for _ in range(2):
        back = Sequence(builders.load_or_build(spark, path, lambda: built.append(1) or s.df))
        assert back.equals(s)
    assert built == [1] and not s.equals(s.extend(values(spark, [1])))
    assert Sequence(builders.append(values(spark, []), s.df)).equals(s)


def test_words_round_trip(spark):
    from test_bits import ones, positions

    b = ones(spark, [0, 5, 63, 64, 130])
    assert positions(builders.from_words(b.words(), b.sizes)) == [0, 5, 63, 64, 130]


def test_remap(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "s string")
    assert sorted(((r["s"], r["code"]) for r in transforms.text_remap(df, "s").collect()), key=str) == sorted([("b", 1), ("a", 0), ("b", 1), (None, None)], key=str)


def test_generators(spark):
    s = generators.gen_sequence(spark, 500, 7)
    rows = s.collect()
    assert {r["sym"] for r in rows} == set(range(7)) and rows == generators.gen_sequence(spark, 500, 7).collect()
    assert all(r["l"] <= r["r"] <= 500 for r in generators.gen_range_queries(spark, 50, 500).collect())
    assert generators.gen_rank_queries(s, 50, 500).count() == 50
    picked = generators.gen_select_queries(s, 50, 500)
    assert Sequence(s).select(picked).filter("pos is null").isEmpty()
    up = [r["sym"] for r in generators.gen_increasing(spark, 100, 200).orderBy("pos").collect()]
    assert len(up) == 100 and all(a < b for a, b in zip(up, up[1:])) and up[-1] < 200
    assert generators.top_symbols(s, 2).count() == 2
    t = generators.Timing(10)
    t.measure(lambda: sum(range(1000)))
    assert t.summary()["min"] >= 0


def test_streamed_counts(spark, tmp_path):
    path = str(tmp_path / "stream")
    values(spark, [1, 1, 2]).write.parquet(path)
    run = append.frequencies(append.read_appended(spark, path)).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert sorted((r["sym"], r["cnt"]) for r in spark.table("counts").collect()) == [(1, 2), (2, 1)]
    run = append.bucket_counts(append.read_appended(spark, path), 2).writeStream.format("memory").queryName("buckets").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert sorted((r["sym"], r["bucket"], r["cnt"]) for r in spark.table("buckets").collect()) == [(1, 0, 2), (2, 1, 1)]


def test_entry_and_catalogue(spark):
    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _key(row):
    return tuple((x is None, str(x)) for x in row)


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op")))
def test_query_agrees_with_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from pathlib import Path

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = entry.queries()[name](spark, SF)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = [tuple(r[c] for c in want.columns) for r in got.collect()]
    assert sorted(rows, key=_key) == sorted(want.fetchall(), key=_key)
