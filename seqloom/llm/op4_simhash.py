"""SimHash near-duplicate detection with BK-trees (operator 4).

Fingerprints of 64 bits, linked at ``RADIUS`` = 2 or fewer differing bits; the classes are the
connected components of the links.

* Equal fingerprints are one class member: links are searched between different fingerprints only.
* Two fingerprints that differ in 2 bits agree in at least two of four 16-bit blocks. Each of the
  six block pairs deals the fingerprints to shards, one per value. A shard's fingerprints are one
  BK-tree: children are keyed by the integer Hamming distance to their parent, and a search follows
  only edges within the radius. Each member that finds others is joined to them, and a shard
  returns its members' links to the smallest member they reach, so the output is linear in the shard.
* Shards are dealt to tasks by a shuffle, not broadcast: trees over all fingerprints grow with the
  corpus, and a broadcast of them would collect them on the driver.
* A shard of over ``SHARD_LIMIT`` fingerprints (a large group of near copies) is split into the
  subtrees of its root before it reaches a task: one a distance to the root. Each fingerprint is a
  member of its own subtree and a query to those that its edges within the radius lead to. Subtrees
  that are still too large are split again by a root of their own, up to ``DEEPEST`` times.

Nulls and empty texts have no words and the fingerprint zero, and are linked like any other.
``component_id`` is the smallest ``doc_id`` reachable; null ids never win against others. Repeated
rows are repeated in the result; an empty table gives none. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.llm import common
from seqloom.llm.components import star_components

RADIUS = 2
SHARD_LIMIT = 1500
DEEPEST = 8
WIDTH = 3
SEED = 42


def shingle_hashes(text: str | None, width: int = WIDTH, seed: int = SEED):
    """XXH64 of each shingle of ``width`` words of a whole text, repeats included; of fewer words the whole sequence."""
    import numpy as np
    import xxhash

    words = common.text_of(text).encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    n = len(words)
    if not n:
        return np.zeros(0, "<u8")
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n <= width:
        return np.array([digest(line, seed)], "<u8")
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[: n - width])]
    return np.array([digest(line[a:z], seed) for a, z in zip(starts, ends[width - 1 :], strict=True)], "<u8")


def majority(hashes) -> int:
    """The unsigned fingerprint of hashes: bits set in over half of them."""
    import numpy as np

    values = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(values), 1 << 16):
        ones += np.unpackbits(values[k : k + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, width: int = WIDTH, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of a whole text; zero without words."""
    return majority(shingle_hashes(text, width, seed))


class BKTree:
    """Metric tree over 64-bit integers: ``children[d]`` is the subtree at Hamming distance d from its node."""

    def __init__(self):
        self.root = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = (value, {})
            return
        node = self.root
        while True:
            d = (node[0] ^ value).bit_count()
            if d == 0:
                return
            child = node[1].get(d)
            if child is None:
                node[1][d] = (value, {})
                return
            node = child

    def within(self, value: int, radius: int) -> list[int]:
        """Members at most ``radius`` from ``value``: by the triangle inequality only edges d-r..d+r can lead there."""
        found, todo = [], [self.root] if self.root else []
        while todo:
            own, children = todo.pop()
            d = (own ^ value).bit_count()
            if d <= radius:
                found.append(own)
            if len(children) <= 2 * radius + 1:
                todo += [c for k, c in children.items() if d - radius <= k <= d + radius]
            else:
                todo += [children[k] for k in range(max(1, d - radius), d + radius + 1) if k in children]
        return found


def shard_links(members: list[int], queries: list[int] = (), radius: int = RADIUS) -> list[tuple[int, int]]:
    """(fingerprint, smallest one it reaches in this shard), for those that reach one.

    All pairs of members, and of a query and a member, count; pairs of queries do not.
    """
    tree, up = BKTree(), {m: m for m in (*members, *queries)}

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(m: int) -> None:
        for other in tree.within(m, radius):
            a, b = top(m), top(other)
            if a != b:
                up[max(a, b)] = min(a, b)

    for m in members:
        join(m)
        tree.add(m)
    for q in queries:
        join(q)
    return [(m, r) for m in up if (r := top(m)) != m]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed integer."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType())])
    return common.map_columns(docs, ["doc_id", "text"], schema, lambda k, texts: (k, [signed(fingerprint(t, width)) for t in texts]))


def _search(rows: DataFrame) -> DataFrame:
    """Links within each shard; rows (shard, query, fp) come with a shard's rows side by side, members first."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        shard, members, queries = None, [], []

        def links():
            # two's complement: the differing bits of masked values are those of the fingerprints
            mask = (1 << 64) - 1
            return [(signed(a), signed(b)) for a, b in shard_links([m & mask for m in members], [q & mask for q in queries])]

        def sent(out):
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], schema=arrow)

        for batch in batches:
            out = []
            for s, query, fp in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if s != shard:
                    out += links()
                    shard, members, queries = s, [], []
                (queries if query else members).append(fp)
            yield sent(out)
        yield sent(links())

    return rows.select("shard", "query", "fp").mapInArrow(run, schema)


def _subtrees(sized: DataFrame, level: int, radius: int) -> DataFrame:
    """Rows (shard, query, fp, n, root) of large shards dealt to the subtrees of their roots."""
    d = F.bit_count(F.col("fp").bitwiseXOR(F.col("root")))
    own = F.array(F.struct(d.alias("d"), F.lit(False).alias("query")), *(F.struct((d + k).alias("d"), F.lit(True).alias("query")) for k in range(1, radius + 1)))
    asked = F.array(*(F.struct((d + k).alias("d"), F.lit(True).alias("query")) for k in range(-radius, radius + 1)))
    each = sized.select("shard", "fp", F.explode(F.when(F.col("query"), asked).otherwise(own)).alias("to"))
    return each.select(F.xxhash64("shard", F.lit(level), "to.d").alias("shard"), F.col("to.query").alias("query"), "fp").distinct()


def links(fps: DataFrame, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """Links (u, v) whose components are those of all pairs within the radius; fps: one row a fingerprint."""
    blocks = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    pairs = [(a, b) for a in range(4) for b in range(a)]
    keys = [F.lit(k << 32).bitwiseOR(F.shiftleft(blocks[a], 16)).bitwiseOR(blocks[b]) for k, (a, b) in enumerate(pairs)]
    rows, out, total = fps.select(F.explode(F.array(*keys)).alias("shard"), F.lit(False).alias("query"), "fp"), [], len(keys) * fps.count()
    for level in range(DEEPEST + 1):
        sizes = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(~F.col("query"), F.col("fp"))).alias("root"))
        sizes = sizes.filter("n > 1 and root is not null").withColumn("count", F.col("n"))
        sized = common.scratch(common.split_join(rows, sizes, "shard", total, counted="count"), "shards")
        whole = "n > 0" if level == DEEPEST else f"n <= {shard_limit}"
        some = sized.filter(whole).select("shard", "query", "fp")
        out.append(common.scratch(_search(some.repartition("shard").sortWithinPartitions("shard", "query", "fp")), "found"))
        large = sized.filter(f"not ({whole})" if level < DEEPEST else "false")
        if large.isEmpty():
            return reduce(DataFrame.unionByName, out).distinct()
        rows = common.scratch(_subtrees(large, level, RADIUS), "subtrees")
        total = rows.count()


def classes(docs: DataFrame, shard_limit: int = SHARD_LIMIT, width: int = WIDTH) -> DataFrame:
    """doc_id, fp and component_id of every row of ``docs``."""
    rows = common.scratch(fingerprints(docs, width), "fingerprints")
    fps = common.scratch(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "different")
    roots = star_components(common.scratch(links(fps.select("fp"), shard_limit), "links"))
    named = fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    named = common.scratch(named, "named")
    totals = named.agg(F.count(F.lit(1)), F.sum("n")).first()
    least = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("count"))
    by_print = common.split_join(named.select("fp", "root", "n"), least, "root", totals[0], counted="count").select("fp", "component_id", "n")
    return common.split_join(rows, common.scratch(by_print, "components"), "fp", totals[1] or 0, counted="n")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classes(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
