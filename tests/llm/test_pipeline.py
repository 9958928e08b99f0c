import random

import corpus_pipeline
from llm_data import WORDS, documents, none_of, prose
from test_near_copies import brute_roots
from test_packing import check_sequences

from seqloom.llm import op1_language_id, op2_packing, op5_quality


def corpus():
    r = random.Random(12)
    langs = [r.choice(list(WORDS)) for _ in range(60)]
    texts = [prose(x, r.randint(60, 300), i) for i, x in enumerate(langs)]
    texts += [texts[3], texts[3], texts[9], "", "short", "BUY NOW!!! $$$ ### " * 30, None]
    return texts, [*langs, langs[3], langs[3], langs[9], None, "en", "en", None]


def test_every_stage_does_its_work_and_no_more(spark):
    texts, langs = corpus()
    docs = documents(spark, texts, langs)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "language", "near_duplicates", "packing"]

    good = stages["quality"](spark, docs, "")
    verdict = {r["doc_id"]: r["kept"] for r in op5_quality.score(docs).collect()}
    assert sorted(r["doc_id"] for r in good.collect()) == sorted(i for i, k in verdict.items() if k)
    assert set(range(60)) <= {r["doc_id"] for r in good.collect()}

    known = stages["language"](spark, good, "")
    net, those = op1_language_id.learn(good), good.collect()
    learned = op1_language_id.in_learned(net, [r["text"] for r in those])
    assert sorted(r["doc_id"] for r in known.collect()) == sorted(r["doc_id"] for r, ok in zip(those, learned, strict=True) if ok)

    left = stages["near_duplicates"](spark, known, "")
    rows = sorted((r["doc_id"], r["text"]) for r in known.collect())
    first = [rows[i][0] for i in brute_roots([t for _, t in rows])]
    assert sorted(r["doc_id"] for r in left.collect()) == first
    assert left.columns == docs.columns

    packed = stages["packing"](spark, left, "").collect()
    check_sequences(packed, op2_packing.LIMIT)
    assert {r["doc_id"] for r in packed} == set(first)


def test_run_applies_the_stages_in_order(spark, tmp_path):
    texts, langs = corpus()
    documents(spark, texts, langs, clashes=False).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {3, 9} <= got and not got & {60, 61, 62, 63, 64, 65, 66, None}


def test_an_empty_table(spark, tmp_path):
    none_of(documents(spark, clashes=False)).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_rows_and_ids(spark):
    text = prose("en", 100, 1)
    docs = documents(spark, [text, text, None])
    left = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(r["doc_id"] for r in left.collect()) == [0, 2]


def test_null_ids_and_one_id_with_two_texts(spark):
    a, b, c, d, e = (prose(x, 100, i) for i, x in enumerate(("en", "de", "fr", "en", "de")))
    rows = [(None, a), (None, a), (None, b), (None, c), (5, c), (1, d), (1, e), (2, d), (3, e), (3, e)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    left = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(left, key=str) == sorted([(None, a), (None, b), (5, c), (1, d), (1, e)], key=str)


def test_rows_are_told_apart_in_tables_of_any_kind(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "m"), (1, "a", "m"), (2, "b", "m")], "doc_id bigint, text string, _metadata string").repartition(1)
    rows.write.parquet(str(tmp_path / "p"))
    rows.write.csv(str(tmp_path / "c"))
    files = [spark.read.parquet(str(tmp_path / "p")), spark.read.schema(rows.schema).csv(str(tmp_path / "c")), rows, rows.unionByName(rows)]
    for df, n in zip(files, (3, 3, 3, 6), strict=True):
        got = corpus_pipeline.numbered(df)
        assert got.columns == [*rows.columns, corpus_pipeline.FILE, corpus_pipeline.ROW]
        assert got.select(corpus_pipeline.FILE, corpus_pipeline.ROW).distinct().count() == n == got.count()
