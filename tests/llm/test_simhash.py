import random
import re

import xxhash
from llm_data import TEXTS, documents, none_of, prose, rows_of

from seqloom.llm import op4_simhash as op


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints):
    up = list(range(len(ids)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                up[top(i)] = top(j)
    least = {}
    for i, d in enumerate(ids):
        t = top(i)
        if d is not None:
            least[t] = d if least.get(t) is None else min(least[t], d)
        else:
            least.setdefault(t, None)
    return [least[top(i)] for i in range(len(ids))]


def test_fingerprints():
    for t in [*TEXTS, "A B", "a b", "ÀB c d", "x\x1cy z w\x0bv", "same same same same same"]:
        assert op.fingerprint(t) == brute_fingerprint(t)


def test_trees_find_all_within_the_radius():
    r = random.Random(1)
    values = [r.getrandbits(64) for _ in range(50)]
    values += [v ^ 1 << r.randrange(64) ^ 1 << r.randrange(64) for v in values for _ in range(3)]
    tree = op.BKTree()
    for v in values:
        tree.add(v)
    for v in values[:80]:
        for radius in (0, 1, 2, 5):
            assert sorted(tree.within(v, radius)) == sorted({x for x in values if (x ^ v).bit_count() <= radius})


def _near(texts, r):
    """Copies with one word changed, of which some stay within the radius and some chain."""
    out = list(texts)
    for t in texts:
        for _ in range(6):
            w = t.split(" ")
            w[r.randrange(len(w))] = r.choice(["x", "y", "zzz"])
            out.append(" ".join(w))
    return out


def test_classes_equal_brute_force(spark):
    r = random.Random(2)
    texts = [*_near([prose("en", 400, i) for i in range(12)], r), *TEXTS]
    docs = documents(spark, texts)
    ids = [*range(len(texts)), len(texts) - 1, None]
    all_texts = [*texts, texts[-1], None]
    prints = [brute_fingerprint(t) for t in all_texts]
    want = sorted(zip(ids, prints, brute_components(ids, prints), strict=True), key=lambda x: [(v is not None, v) for v in x])
    assert len({c for _, _, c in want}) < len(want) - 10  # there are links
    for limit in (op.SHARD_LIMIT, 2):  # the second sends every shard the other way
        got = [(d, f & (1 << 64) - 1, c) for d, f, c in rows_of(op.classes(docs, limit), "doc_id", "fp", "component_id")]
        assert sorted(got, key=lambda x: [(v is not None, v) for v in x]) == want


def test_both_ways_agree_on_a_large_group(spark):
    r = random.Random(3)
    base = r.getrandbits(63)
    prints = {base ^ 1 << r.randrange(63) ^ 1 << r.randrange(63) for _ in range(300)} | {r.getrandbits(63) for _ in range(100)}
    fps = spark.createDataFrame([(p,) for p in prints], "fp bigint").repartition(4)
    ordered = sorted(prints)
    want = brute_components(ordered, ordered)
    for limit in (op.SHARD_LIMIT, 20):
        roots = {x["node"]: x["root"] for x in op.star_components(op.links(fps, limit)).collect()}
        got = [roots.get(p, p) for p in ordered]
        assert [ordered.index(g) for g in got] == [ordered.index(w) for w in want]


def test_nothing(spark):
    assert op.classes(none_of(documents(spark))).count() == 0


def test_components_of_chains_stars_and_hubs(spark, monkeypatch):
    from seqloom.llm import components

    r = random.Random(4)
    chain = r.sample(range(1000), 120)
    links = list(zip(chain, chain[1:])) + [(2000, x) for x in range(2001, 2300)] + [(3999, x) for x in range(3000, 3300)] + [(5000, 5000)]
    want = {x: min(chain) for x in chain} | {x: 2000 for x in range(2001, 2300)} | {x: 3000 for x in [3999, *range(3001, 3300)]}
    want.pop(min(chain))
    df = spark.createDataFrame(links, "u bigint, v bigint").repartition(7)
    assert {x["node"]: x["root"] for x in components.star_components(df).collect()} == want
    monkeypatch.setattr(components, "_forest", lambda x: x.filter("u <> v").selectExpr("greatest(u, v) u", "least(u, v) v"))  # the rounds alone
    assert {x["node"]: x["root"] for x in components.star_components(df).collect()} == want
    assert components.star_components(df.filter("false")).count() == 0
