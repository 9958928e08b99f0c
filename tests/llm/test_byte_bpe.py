import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_data import TEXTS, documents, none_of, prose, rows_of

from seqloom.llm import byte_bpe, op9_byte_bpe, op10_token_counts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return byte_bpe.rust_encoding(RANKS, public_tokenizers.PATTERN)


ODD = [
    "a b", "a  b", " a", "a ", "  ", "\n", "a\n b", "a \nb", "a\tb", "it's I'LL 'tis", "\x1c\x1d x\x1e y\x1f", "\x85 a b c 　", "x\x00y \x00 z", "1234 ١٢ ½ ²", "日本語 テキスト", "é ‍️", "\U0001f469‍\U0001f469", "�﻿",
    "a" * 300, "ab" * 200, "=" * 100, " " * 70 + "x", "\r\n\r\n", "don't 'sure", "_-_-_", "Ünï cödé",
]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts_as_the_library(library, text):
    assert op9_byte_bpe.encode_text(text, RANKS) == library.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'abcdeSTA1. ")), max_size=40))
def test_any_text_as_the_library(text):
    assert op9_byte_bpe.encode_text(text, RANKS) == byte_bpe.rust_encoding(RANKS, public_tokenizers.PATTERN).encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'abcdeSTA1. é")), max_size=40))
def test_library_encoder_is_the_tokenizers_one(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    assert byte_bpe.library_encoder(RANKS, JSON)(text) == t.encode(text, add_special_tokens=False).ids


def test_appends_and_edits_equal_a_new_encoding():
    enc, r = byte_bpe.prefix_encoder(RANKS), random.Random(3)
    piece = prose("en", 40, 5).replace(" ", "").encode()
    table = enc.table(piece)
    assert enc.walk(table) == enc.merge(piece)
    for _ in range(40):
        more = bytes(r.choices(b"etaoin shrdlu", k=r.randint(0, 9)))
        assert enc.append(piece, table, more)[1] == enc.table(piece + more)
        start = r.randrange(len(piece))
        stop = min(len(piece), start + r.randint(0, 5))
        whole, new, work = enc.edit(piece, table, start, stop, more)
        assert new == enc.table(whole) and enc.decode(enc.walk(new)) == whole
    long = piece * 9
    whole, new, work = enc.edit(long, enc.table(long), 0, 1, b"x")
    assert new == enc.table(whole) and work < len(long) // 2  # the rest of the table was kept


def test_small_caches_give_the_same(library):
    enc = byte_bpe.PrefixEncoder(byte_bpe.load_ranks(RANKS), pair_limit=3, prefix_limit=5)
    words = byte_bpe.Words(lambda w: enc.encode(w.encode()), limit=4)
    for w in prose("de", 60, 1).split(" "):
        assert words[w] == library.encode_ordinary(w)


def test_query_on_odd_rows(spark, library):
    docs = documents(spark)
    want = []
    for i, t in [*enumerate(TEXTS), (len(TEXTS) - 1, TEXTS[-1]), (None, None)]:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert rows_of(op9_byte_bpe.digests(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=lambda r: (r[0] is not None, r[0]))
    assert op9_byte_bpe.digests(none_of(docs)).count() == 0
    back = op9_byte_bpe.decode(op9_byte_bpe.encode(docs))
    assert {r["decoded"].decode() for r in back.collect()} == {t or "" for t in TEXTS}


def test_token_counts_equal_brute_force(spark, library):
    docs = documents(spark)
    lengths = [len(library.encode_ordinary(t or "")) for t in [*TEXTS, TEXTS[-1], None]]
    total = sum(lengths)
    want = [
        (c, lengths.count(c), sum(n > c for n in lengths), total, sum(min(n, c) for n in lengths), sum(max(0, n - c) for n in lengths), sum(n <= c for n in lengths) / len(lengths))
        for c in sorted(set(lengths))
    ]
    answers = op10_token_counts.limits(op10_token_counts.histogram(op10_token_counts.encoded_lengths(docs, ["doc_id"])))
    got = rows_of(answers, "context_limit", "n_docs", "docs_longer", "tokens_total", "tokens_kept", "tokens_cut", "share_fitting")
    assert [r[:6] for r in got] == [r[:6] for r in want]
    assert [r[6] for r in got] == pytest.approx([r[6] for r in want])
    for share in (0.1, 0.5, 0.9, 1.0):
        at = sorted(lengths)[max(0, -(-int(share * 1000) * len(lengths) // 1000) - 1)]
        assert op10_token_counts.quantile(answers, share).first()["length"] == at
    assert op10_token_counts.limits(op10_token_counts.histogram(op10_token_counts.encoded_lengths(none_of(docs), ["doc_id"]))).count() == 0


@pytest.mark.parametrize("text", ["before <|endoftext|> after", "<|endoftext|>", "  <|endoftext|><|endoftext|>\n\n", "日本 <|endoftext|>", "<|endoftext", "日本"])
def test_library_encoder_gives_added_tokens_as_the_library_does(text):
    from tokenizers import Tokenizer

    assert byte_bpe.library_encoder(RANKS, JSON)(text) == Tokenizer.from_file(JSON).encode(text, add_special_tokens=False).ids
