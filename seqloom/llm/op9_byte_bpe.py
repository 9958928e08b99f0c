"""Byte-level BPE encoding and decoding by prefix dynamic programming (operator 9).

Nulls encode as the empty text (no ids); a null ``doc_id`` stays null. Repeated rows give repeated
rows; an empty table gives an empty result. Only ``doc_id`` and ``text`` are read, so further
columns of any name do no harm. Texts are encoded whole: the table of a match grows with its
bytes, and a match's work is linear in them.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import chain

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from seqloom.llm import byte_bpe, common

RANKS = "byte_bpe_50k.tiktoken"


@lru_cache(maxsize=2)
def _parts(ranks_path: str) -> byte_bpe.Words:
    """word -> number of ids, their decimals each behind a space, and the decoded bytes."""
    enc, find = byte_bpe.prefix_encoder(ranks_path), byte_bpe.pattern().findall

    def parts(word: str) -> tuple[int, bytes, bytes]:
        matches = [word] if byte_bpe.one_match(word) else find(word)
        if not matches:
            return 0, b"", b""
        if len(matches) > 1:
            counts, ids, decoded = zip(*map(words.__getitem__, matches), strict=True)
            return sum(counts), b"".join(ids), b"".join(decoded)
        ids = enc.encode(word.encode("utf-8", "replace"))
        return len(ids), b" %d" * len(ids) % tuple(ids), enc.decode(ids)

    words = byte_bpe.Words(parts)
    return words


def digested(text: str | None, ranks_path: str) -> tuple[int, bytes, bytes]:
    """Number of ids of a whole text, their decimals joined by spaces, and the bytes that they decode to."""
    found = list(map(_parts(ranks_path).__getitem__, byte_bpe.chunks(common.text_of(text))))
    if not found:
        return 0, b"", b""
    counts, ids, decoded = zip(*found, strict=True)
    return sum(counts), b"".join(ids)[1:], b"".join(decoded)


def encode_text(text: str | None, ranks_path: str) -> list[int]:
    words = byte_bpe.id_words(ranks_path)
    return list(chain.from_iterable(map(words.__getitem__, byte_bpe.chunks(common.text_of(text)))))


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", ranks_path: str | None = None) -> DataFrame:
    """``key`` and the ids (``array<int>``) of each whole text."""
    path = ranks_path or public_tokenizers.path(RANKS)
    schema = T.StructType([df.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return common.map_columns(df, [key, text], schema, lambda k, texts: (k, [encode_text(t, path) for t in texts]))


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", ranks_path: str | None = None) -> DataFrame:
    """``key`` and the bytes that the ids stand for."""
    path = ranks_path or public_tokenizers.path(RANKS)
    schema = T.StructType([df.schema[key], T.StructField("decoded", T.BinaryType())])
    return common.map_columns(df, [key, ids], schema, lambda k, lists: (k, [byte_bpe.prefix_encoder(path).decode(x or ()) for x in lists]))


def digests(df: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """Encode and decode in one pass over the texts, so that ids never leave the worker.

    What a word adds to a digest is kept with the word: its number of ids, their decimals, and the bytes that they decode to.
    """
    path = ranks_path or public_tokenizers.path(RANKS)
    kinds = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    schema = T.StructType([df.schema["doc_id"], *(T.StructField(n, t) for n, t in kinds)])

    def made(keys, texts):
        n, sha, back = [], [], []
        for t in texts:
            count, ids, decoded = digested(t, path)
            n.append(count)
            sha.append(hashlib.sha256(ids).hexdigest())
            back.append(hashlib.sha256(decoded).hexdigest())
        return keys, n, sha, back

    return common.map_columns(df, ["doc_id", "text"], schema, made)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"))
