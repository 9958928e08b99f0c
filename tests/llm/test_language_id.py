import random
import zlib

import numpy as np
from llm_data import TEXTS, WORDS, documents, none_of, prose, rows_of

from seqloom.llm import gru
from seqloom.llm import op1_language_id as op


def test_gradients_are_those_of_the_loss():
    r = np.random.default_rng(1)
    net = gru.Network.new(["a", "b", "c"], hidden=3)
    bytes_, label = r.integers(0, 256, (5, 4)).astype(np.uint8), np.array([0, 1, 2, 1])
    weight = np.ones((5, 4), np.float32)
    weight[3:, 2] = 0
    for p in net.parameters():
        p *= 3
    _, grads = gru.loss_and_gradients(net, bytes_, label, weight)
    for p, g in zip(net.parameters(), grads, strict=True):
        places = [np.unravel_index(i, p.shape) for i in np.argsort(-np.abs(g), axis=None)[:4]]
        for at in places:
            was, step = p[at], 1e-2
            p[at] = was + step
            up, _ = gru.loss_and_gradients(net, bytes_, label, weight)
            p[at] = was - step
            down, _ = gru.loss_and_gradients(net, bytes_, label, weight)
            p[at] = was
            assert abs((up - down) / (2 * step) - g[at]) < 2e-3 + 0.03 * abs(g[at])


def test_pooling_is_the_mean_over_all_bytes():
    net = gru.Network.new(["a", "b"], hidden=4)
    text = bytes(range(200)) * 3
    each = []
    for at in range(0, len(text), gru.SEGMENT):
        part = text[at : at + gru.SEGMENT]
        each.append(gru.probabilities(net, np.frombuffer(part, np.uint8)[:, None])[:, 0])  # without padding
    got = gru.pooled(net, [b"", text, b"x"])
    assert np.allclose(got[1], np.concatenate(each).mean(axis=0), atol=1e-5)
    assert got[0].tolist() == [0, 0] and abs(got[2].sum() - 1) < 1e-5


def _corpus(n=240):
    r = random.Random(8)
    langs = [r.choice(list(WORDS)) for _ in range(n)]
    return [prose(x, r.randint(20, 120), i) for i, x in enumerate(langs)], langs


def test_held_out_documents_are_told_apart_and_not_learned_from(spark):
    texts, langs = _corpus()
    held = [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(len(texts))]
    docs = documents(spark, texts, langs)
    wrong = ["zz" if h else x for h, x in zip(held, langs, strict=True)]
    assert op.training_rows(docs) == op.training_rows(documents(spark, texts, wrong))
    net = op.learn(docs)
    got = {r["doc_id"]: r for r in op.identify(docs, net).collect()}
    right = [got[i]["lang_pred"] == langs[i] for i in range(len(texts)) if held[i]]
    assert len(right) > 40 and sum(right) / len(right) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())
    marked = docs.select("doc_id", op.held_out(docs["doc_id"]).alias("h"))
    assert all(r["h"] == (True if r["doc_id"] is None else held[r["doc_id"]]) for r in marked.collect())


def test_odd_rows(spark):
    docs = documents(spark)
    got = rows_of(op.identify(docs, op.learn(docs)), "doc_id", "lang_pred", "score")
    assert len(got) == len(TEXTS) + 2
    for doc, lang, score in got:
        t = None if doc is None else TEXTS[doc]
        if not any(map(str.isalpha, t or "")):
            assert (lang, score) == ("und", 0.0)
        else:
            assert lang == "en"
    assert op.learn(none_of(docs)) is None
    assert {r["lang_pred"] for r in op.identify(docs, None).collect()} == {"und"}
    assert op.identify(none_of(docs), None).count() == 0
    kept = op.keep_known(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, t in enumerate(TEXTS) if any(map(str.isalpha, t or ""))}


def test_the_sample_is_bounded(spark):
    texts, langs = _corpus()
    docs = documents(spark, texts, langs)
    rows = op.training_rows(docs, per_language=20)
    assert len(rows) == 3 * 20 and max(len(p) for _, p in rows) <= op.WINDOW
    assert len(op.training_rows(docs, per_language=20, total=30)) == 3 * 10
    one = spark.createDataFrame([(1, "a text", "en")] * 500 + [(2, "noch einer", "de")], "doc_id bigint, text string, lang string")
    assert sorted(op.training_rows(one, per_language=50)) == [("de", "noch einer")] + [("en", "a text")] * 50  # one id in all rows


def test_no_language_is_left_out(spark):
    rows = [(i, f"text {i}", f"l{i % 300:03}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert len({x for x, _ in op.training_rows(docs, total=100)}) == 300
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 220)]
    r = random.Random(5)
    made = lambda k, n: "".join(r.choice(letters[2 * k : 2 * k + 2]) for _ in range(n))
    names = [f"l{k:03}" for k in range(110)]  # more than a batch has places
    net = gru.train([made(k, 60) for k in range(110) for _ in range(3)], [n for n in names for _ in range(3)], steps=400)
    got, _ = op.predict(net, [made(k, 40) for k in range(110)])
    assert sum(a == b for a, b in zip(got, names, strict=True)) >= 100


def test_texts_of_no_learned_language_are_rejected(spark):
    texts, langs = _corpus()
    r = random.Random(4)
    words = ["".join(r.choice("bcdfghjklmnpqrstvwxzaeiou") for _ in range(r.randint(3, 9))) for _ in range(200)]
    strange = [" ".join(r.choice(words) for _ in range(150)) for _ in range(20)] + ["многие годы прошли с тех пор как они жили здесь " * 10, "これは知らない言葉で書かれた長い文章です。" * 10]
    docs = documents(spark, texts + strange, langs + [None] * len(strange))
    kept = {r["doc_id"] for r in op.keep_known(docs).collect()}
    assert len(kept & set(range(len(texts)))) >= len(texts) - 2
    assert len(kept - set(range(len(texts)))) <= 2
