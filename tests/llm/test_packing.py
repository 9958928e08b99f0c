import random
import zlib
from collections import defaultdict

import public_tokenizers
from llm_data import TEXTS, documents, none_of, prose

from seqloom.llm import op2_packing as op


def ids_of(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [*t.encode(text or "", add_special_tokens=False).ids, 2]


def check_sequences(rows, limit):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    return by


def test_pieces_and_places(spark):
    rows = op.pack(op.pieces(documents(spark), limit=64), limit=64).collect()
    check_sequences(rows, 64)
    texts = dict(enumerate(TEXTS)) | {None: None}
    found = defaultdict(list)
    for r in rows:
        found[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    assert set(found) == set(texts)
    for doc, parts in found.items():
        ids, at, want = ids_of(texts[doc]), 0, []
        first = len(ids) % 64 or 64
        while at < len(ids):
            size = 64 if want else first
            want.append((len(want), at, size, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[at : at + size]))))
            at += size
        times = 2 if doc == len(TEXTS) - 1 else 1
        assert sorted(parts) == sorted(want * times)


def test_a_single_partition_has_its_certificate_too(spark):
    docs = documents(spark, [prose("en", 20, i) for i in range(60)], clashes=False)
    rows = op.pack(op.pieces(docs, limit=100), limit=100).collect()
    lengths, bins = [r["length"] for r in rows], len({r["sequence_id"] for r in rows})
    assert {(r["partition_bins"], r["partition_bound"], r["certified"]) for r in rows} == {(bins, op.lower_bound(lengths, 100), bins == op.lower_bound(lengths, 100))}


def test_equal_lengths_keep_the_order_of_rows():
    placed = op.best_fit_decreasing([5, 5, 5, 5, 3, 3], 10)
    assert placed == [(0, 0), (0, 5), (1, 0), (1, 5), (2, 0), (2, 3)]


def test_packing_of_nothing(spark):
    assert op.pack(op.pieces(none_of(documents(spark)))).count() == 0


def test_partitions_exchange_and_lose_nothing(spark):
    r = random.Random(4)
    docs = documents(spark, [prose("en", r.randint(1, 90), i) for i in range(400)], clashes=False)
    pieces = op.pieces(docs, limit=100)
    rows = op.pack(pieces, limit=100, per_partition=60).collect()
    by = check_sequences(rows, 100)
    assert len(rows) == pieces.count()
    for r in rows:
        assert r["partition_bound"] <= r["partition_bins"] and r["certified"] == (r["partition_bound"] == r["partition_bins"])
    lengths = [r["length"] for r in rows]
    together = len({b for b, _ in op.best_fit_decreasing(lengths, 100)})
    partitions = -(-len(rows) // 60)
    assert op.lower_bound(lengths, 100) <= len(by) <= together + partitions  # a partition leaves one bin with room or so


def test_bounds_never_exceed_the_bins_of_any_packing():
    r = random.Random(5)
    for limit in (10, 64, 1024):
        for _ in range(60):
            lengths = [r.randint(1, limit) for _ in range(r.randint(0, 60))]
            placed = op.best_fit_decreasing(lengths, limit)
            used = defaultdict(int)
            for (b, offset), n in zip(placed, lengths, strict=True):
                used[b] += n
            assert all(v <= limit for v in used.values())
            assert op.lower_bound(lengths, limit) <= len(used)
    assert op.lower_bound([6, 6, 6], 10) == 3  # the plain sum says 2
    assert op.lower_bound([4, 4, 4, 4, 4], 10) == 3
