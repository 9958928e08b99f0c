import random

import numpy as np
import xxhash
from llm_data import WORDS, prose

import corpus_pipeline
from pyspark.sql import functions as F
from seqloom.llm import near_copies


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def set_print(shingles):
    hashes = [xxhash.xxh64_intdigest(" ".join(s), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(texts):
    """The first text of each class: similarity 0.8 or more, or fingerprints of the sets within two bits."""
    up, sets = list(range(len(texts))), [shingle_set(t) for t in texts]
    prints = [set_print(s) for s in sets]

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or (a and b and 10 * len(a & b) >= 8 * len(a | b)) or (prints[i] ^ prints[j]).bit_count() <= 2:
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    return sorted({top(i) for i in range(len(texts))})


def test_near_copies_go_and_no_others(spark):
    r, texts = random.Random(8), []
    for i in range(12):
        words = prose(r.choice(list(WORDS)), r.randint(80, 300), i).split(" ")
        texts.append(" ".join(words))
        for _ in range(5):  # one more word changed each time: pairs above, near and below 0.8, and chains
            words[r.randrange(len(words))] = r.choice(["x", "y", "z"])
            texts.append(" ".join(words))
            words[r.randrange(len(words))] = r.choice(["x", "y", "z"])
    texts += [prose("en", 40, 99) + " " + prose("de", 60, 300 + i) for i in range(8)]  # a common passage, else different
    texts += ["one", "one two", "ONE  two", "", None, "a b c d e"]
    want = brute_roots(texts)
    assert len(want) < len(texts) - 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == want
    rows = docs.withColumnsRenamed({"doc_id": "a"}).withColumn("b", F.lit(0).cast("bigint"))
    found = {}
    for r in near_copies.classes(rows, block=2).collect():  # blocks of two
        found.setdefault(r["root"], []).append(r["a"])
    assert sorted(map(min, found.values())) == want


def test_groups_in_full_link_what_the_first_node_does_not():
    r = np.random.default_rng(1)
    sets = []
    for _ in range(6):
        base = r.integers(0, 1 << 63, 100, np.uint64)
        for n in range(0, 20, 2):
            sets.append(np.unique(np.concatenate([base[n:], r.integers(0, 1 << 63, n, np.uint64)])))
    items = [(i, i, x) for i, x in enumerate(sets)]
    near = lambda a, b: 10 * len(np.intersect1d(a, b)) >= 8 * len(np.union1d(a, b))
    alike = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if j < i and near(a, b)]
    assert len(alike) > len(sets)
    assert dict(near_copies.block_links(items)) == _roots(alike)
    assert dict(near_copies.block_links(items[:25], items[25:])) == _roots([(i, j) for i, j in alike if j < 25 <= i])
    known = [(i, i - i % 10, x) for i, x in enumerate(sets)]  # classes that are known already
    assert near_copies.block_links(known) == []


def _roots(pairs):
    root = {x: x for p in pairs for x in p}
    for _ in root:
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
    return {x: r for x, r in root.items() if x != r}


def test_bands_find_similar_sets():
    r = np.random.default_rng(2)
    missed = 0
    for _ in range(300):
        base = r.integers(0, 1 << 63, 180, np.uint64)
        a, b = base[:160], base[20:]  # 140 of 180 shared: below 0.8
        c = base[16:]  # 144 of 164 and more
        x = near_copies.bands_of([a, b, c])
        missed += not (x[1] == x[2]).any()
        assert (x[0] == near_copies.bands_of([a[::-1]])[0]).all()
    assert missed == 0
