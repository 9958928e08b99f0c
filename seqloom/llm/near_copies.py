"""Near copies: operator 4's classes over five-word shingles, completed to a similarity of 0.8.

Two texts are linked if their sets of ``SHINGLE``-word shingles (bytes, A-Z lowered, split at ASCII
white space; a shorter text is one shingle) have Jaccard similarity ``NUM`` / ``DEN`` = 0.8 or more, or
if the SimHash fingerprints of these sets differ in at most 2 bits. Classes are the connected components.

* Equal sets are one node.
* Fingerprints go through operator 4's shards of BK-trees, which links most copies. But 64 bits
  separate sets of similarity 0.8 by about ten bits, so more is needed for the rest:
* ``BANDS`` bands of ``ROWS`` minimum hashes deal nodes to groups. Sets of similarity s share no group with
  probability (1 - s^ROWS)^BANDS, 3e-7 at 0.8 and less above. Candidates are
  compared by their whole sets, so nothing below 0.8 is linked here.
* A group's nodes are compared with its smallest node by way of at most ``BLOCK`` to one node, unless
  they are already in one class. Groups whose nodes then are in several classes are compared in
  full, in blocks of ``BLOCK`` nodes, each a BK-tree over sets: children are keyed by the
  size of the symmetric difference, and a search follows only edges within the radius. Blocks
  are ordered by class, and two blocks of one class are not compared.

No task gets all of a large group of equal or near texts: see ``common.split_join``. Sets are built again from the
texts that need them, and texts themselves are only shuffled beyond ``FEW`` rows to look up.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.llm import common, op4_simhash
from seqloom.llm.components import star_components

SHINGLE = 5
NUM, DEN = 4, 5
BANDS, ROWS = 50, 6
BLOCK = 512
#: Rows of two integers up to which a side is broadcast; beyond it is joined by a shuffle.
FEW = 500_000


def shingles(text: str | None):
    """The sorted hashes of the shingles of a whole text."""
    import numpy as np

    return np.unique(op4_simhash.shingle_hashes(text, SHINGLE))


def node_of(found) -> int:
    import xxhash

    return op4_simhash.signed(xxhash.xxh64_intdigest(found.tobytes()))


def similar(both: int, a: int, b: int) -> bool:
    return (NUM + DEN) * both >= NUM * (a + b)


def radius(size: int) -> int:
    """The largest symmetric difference of a similar set: with one of size / 0.8."""
    return size * (DEN - NUM) // NUM


@lru_cache(maxsize=1)
def _mixers():
    import numpy as np

    r = np.random.default_rng(4)
    n = BANDS * ROWS
    return r.integers(0, 1 << 32, (n, 1), np.uint32), r.integers(0, 1 << 31, (n, 1), np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def bands_of(sets: list):
    """(sets, BANDS): which group of each band a set is in; sets are not empty."""
    import numpy as np

    flip, times, fold = _mixers()
    least = np.empty((len(sets), BANDS * ROWS), np.uint32)
    for i, s in enumerate(sets):
        short, own = (s >> np.uint64(32)).astype(np.uint32), None
        for at in range(0, len(short), 1024):
            now = ((short[at : at + 1024] ^ flip) * times).min(axis=1)
            own = now if own is None else np.minimum(own, now)
        least[i] = own
    mixed = (least.reshape(-1, BANDS, ROWS).astype(np.uint64) * fold).sum(axis=2, dtype=np.uint64)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return mixed.view(np.int64)


def _arrow(schema: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def nodes(rows: DataFrame) -> DataFrame:
    """``rows`` with node, fp and bands in place of text; bands only where a task meets a node for the first time."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    own = [c for c in rows.columns if c != "text"]
    schema = rows.select(*own).schema.add("node", "long").add("fp", "long").add("bands", T.ArrayType(T.LongType()))
    arrow = to_arrow_schema(schema)

    def run(batches):
        seen = set()
        for batch in batches:
            for part in common.slices(batch, 256):
                sets = [shingles(t) for t in part.column(len(own)).to_pylist()]
                found = [node_of(s) for s in sets]
                fresh = []
                for i, n in enumerate(found):
                    if n not in seen and len(sets[i]):
                        seen.add(n)
                        fresh.append(i)
                bands = [None] * len(sets)
                for i, x in zip(fresh, bands_of([sets[i] for i in fresh]) if fresh else (), strict=True):
                    bands[i] = x
                prints = [op4_simhash.signed(op4_simhash.majority(s)) for s in sets]
                made = [pa.array(x, f.type) for x, f in zip((found, prints, bands), list(arrow)[-3:], strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], schema=arrow)

    return rows.select(*own, "text").mapInArrow(run, schema)


def _print_links(known: DataFrame) -> DataFrame:
    """Links between nodes whose fingerprints are equal or linked by operator 4."""
    distinct = known.select("fp", "node").distinct()
    prints = common.scratch(distinct.groupBy("fp").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")), "prints")
    linked = op4_simhash.links(prints.select("fp"))
    first = prints.select("fp", "first")
    one = linked.join(first.withColumnRenamed("fp", "u"), "u").select("v", F.col("first").alias("one"))
    across = one.join(first.withColumnRenamed("fp", "v"), "v").select(F.col("one").alias("u"), F.col("first").alias("v"))
    inside = common.split_join(distinct, prints.filter("n > 1"), "fp", known.count(), counted="n").filter("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    return across.unionByName(inside).filter("u <> v").distinct()


def _met(known: DataFrame) -> DataFrame:
    """band, node and the node of the group that it is compared with, for groups of two or more nodes."""
    each = known.filter("bands is not null").select("node", F.explode("bands").alias("band"))
    order = Window.partitionBy("band").orderBy("node")
    ranked = each.select("band", "node", (F.dense_rank().over(order) - 1).alias("rank"), F.first("node").over(order).alias("least"), F.lag("node").over(order).alias("before"))
    seen = ranked.withColumn("first", F.last(F.when(F.col("rank") % BLOCK == 0, F.col("node")), ignorenulls=True).over(order))
    fresh = seen.filter("before is null or before <> node")  # several tasks may have met a node
    return fresh.withColumn("with", F.when(F.col("node") == F.col("first"), F.col("least")).otherwise(F.col("first"))).filter("node <> with").select("band", "node", "with")


def _rooted(df: DataFrame, roots: DataFrame, column: str, out: str) -> DataFrame:
    """``df`` with ``out``: the class of the node in ``column``. No node is in many rows: see ``BANDS`` and ``BLOCK``."""
    table = roots.select(F.col("node").alias(column), F.col("root").alias("_root"))
    return df.join(table, column, "left").withColumn(out, F.coalesce("_root", column)).drop("_root")


def _sets(rows: DataFrame, known: DataFrame, needed: DataFrame) -> DataFrame:
    """node and found (its set, as bytes) of the nodes in ``needed``, once each."""
    import pyarrow as pa

    one = common.scratch(known.groupBy("node").agg(F.min(F.struct("a", "b")).alias("at")).join(needed.select("node").distinct(), "node", "left_semi").select("at.a", "at.b"), "needed")
    texts = rows.select("a", "b", "text").join(F.broadcast(one) if one.count() <= FEW else one, ["a", "b"], "left_semi").select("text")
    schema = "node bigint, found array<bigint>"
    arrow = _arrow(schema)

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, 256):
                sets = [shingles(t) for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.view("<i8") for s in sets], pa.list_(pa.int64()))], schema=arrow)

    return common.scratch(texts.mapInArrow(run, schema), "sets")


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (u, v) whose sets are similar."""
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("found").alias("one")), "u")
    both = both.join(sets.select(F.col("node").alias("v"), F.col("found").alias("other")), "v")
    sizes = F.size("one") + F.size("other")
    near = NUM * F.greatest(F.size("one"), F.size("other")) <= DEN * F.least(F.size("one"), F.size("other"))
    return both.filter(near).filter((NUM + DEN) * F.size(F.array_intersect("one", "other")) >= NUM * sizes).select("u", "v")


class SetTree:
    """BK-tree over sets: children are keyed by the size of the symmetric difference to their parent."""

    def __init__(self):
        self.root = None

    @staticmethod
    def apart(a, b) -> int:
        import numpy as np

        return len(a) + len(b) - 2 * len(np.intersect1d(a, b, assume_unique=True))

    def add(self, node: int, own) -> None:
        if self.root is None:
            self.root = (node, own, {})
            return
        at = self.root
        while (d := self.apart(at[1], own)) in at[2]:
            at = at[2][d]
        at[2][d] = (node, own, {})

    def similar_to(self, own) -> list[int]:
        found, todo, r = [], [self.root] if self.root else [], radius(len(own))
        while todo:
            node, there, children = todo.pop()
            d = self.apart(there, own)
            if similar((len(there) + len(own) - d) // 2, len(there), len(own)):
                found.append(node)
            todo += [c for k, c in children.items() if d - r <= k <= d + r]
        return found


def block_links(left: list, right: list | None = None) -> list[tuple[int, int]]:
    """Links between ``left`` and ``right``, lists of (node, class, set), or within ``left``: one a class that another absorbs."""
    tree, up, class_of = SetTree(), {}, {}

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for node, own_class, _ in (*left, *(right or ())):
        up.setdefault(own_class, own_class)
        class_of[node] = own_class

    def join(node: int, own) -> None:
        for other in tree.similar_to(own):
            a, b = top(class_of[node]), top(class_of[other])
            if a != b:
                up[max(a, b)] = min(a, b)

    for node, _, own in left:
        if right is None:
            join(node, own)
        tree.add(node, own)
    for node, _, own in right or ():
        join(node, own)
    return [(c, r) for c in up if (r := top(c)) != c]


def _open(met: DataFrame, roots: DataFrame) -> DataFrame:
    """band, node and root of the groups in which nodes of several classes have not been compared.

    In a group of one block the first node has been, with all others. Of groups of the same nodes one stays.
    """
    ends = common.scratch(_rooted(_rooted(met, roots, "node", "x"), roots, "with", "y"), "ends")
    count, small = F.count(F.lit(1)), F.col("n") < BLOCK
    bands = ends.groupBy("band").agg(count.alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.min("y").alias("lo2"), F.max("y").alias("hi2"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("of"))
    apart = F.when(small, F.col("lo") != F.col("hi")).otherwise(F.least("lo", "lo2") != F.greatest("hi", "hi2"))
    bands = common.scratch(bands.filter(apart).withColumn("whole", ~small).dropDuplicates(["of", "n"]).select("band", "whole"), "bands")
    mine = ends.join(bands, "band")
    return mine.select("band", "node", F.col("x").alias("root")).unionByName(mine.filter("whole").select("band", F.col("with").alias("node"), F.col("y").alias("root"))).distinct()


def _all_compared(members: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """Links between classes within groups (band, node, root), in pairs of blocks that hold different classes."""
    import pyarrow as pa

    ranked = members.withColumn("rank", F.row_number().over(Window.partitionBy("band").orderBy("root", "node")) - 1)
    placed = common.scratch(ranked.select("band", "node", "root", F.expr(f"rank div {block}").alias("block")), "placed")
    blocks = common.scratch(placed.groupBy("band", "block").agg(F.min("root").alias("lo"), F.max("root").alias("hi")), "blocks")
    other = blocks.select("band", F.col("block").alias("right"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    tasks = blocks.withColumnRenamed("block", "left").join(other, "band").filter("left <= right and not (lo = hi and lo2 = hi2 and lo = lo2)")
    tasks = common.scratch(tasks.select("band", "left", "right"), "tasks")
    use = tasks.select("band", F.col("left").alias("block"), "left", "right", F.lit(0).alias("side")).unionByName(tasks.filter("left <> right").select("band", F.col("right").alias("block"), "left", "right", F.lit(1).alias("side")))
    full = placed.join(use, ["band", "block"]).join(sets, "node")
    schema = "u bigint, v bigint"
    arrow = _arrow(schema)

    def run(batches):
        task, sides = None, ([], [])

        def sent(out):
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], schema=arrow)

        def links():
            return block_links(sides[0], sides[1] if task and task[1] != task[2] else None)

        for batch in batches:
            out, found = [], batch.column(6)
            values, offsets = found.values.to_numpy(), found.offsets.to_numpy()
            for i, (band, left, right, side, node, root) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True)):
                if (band, left, right) != task:
                    out += links()
                    task, sides = (band, left, right), ([], [])
                sides[side].append((node, root, values[offsets[i] : offsets[i + 1]].copy()))
            yield sent(out)
        yield sent(links())

    by_task = full.repartition("band", "left", "right").sortWithinPartitions("band", "left", "right", "side", "node")
    return by_task.select("band", "left", "right", "side", "node", "root", "found").mapInArrow(run, schema).distinct()


def classes(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``rows`` with root (the class) in place of text; a and b together are a row's own place."""
    known = common.scratch(nodes(rows), "nodes")
    linked = common.scratch(_print_links(known), "links")
    roots = star_components(linked)
    met = common.scratch(_met(known), "met")
    pairs = met.select(F.col("node").alias("u"), F.col("with").alias("v")).distinct()
    apart = common.scratch(_rooted(_rooted(pairs, roots, "u", "x"), roots, "v", "y").filter("x <> y").select("u", "v"), "pairs")
    if not apart.isEmpty():
        sets = _sets(rows, known, apart.select(F.col("u").alias("node")).unionByName(apart.select(F.col("v").alias("node"))))
        linked = linked.unionByName(common.scratch(_compared(apart, sets), "compared"))
        roots = star_components(linked)
        members = common.scratch(_open(met, roots), "open")
        if not members.isEmpty():
            sets = _sets(rows, known, members)
            more = common.scratch(_all_compared(members, sets, block), "all-compared")
            roots = roots if more.isEmpty() else star_components(linked.unionByName(more))
    own = known.drop("fp", "bands")
    found = common.split_join(own, roots, "node", own.count(), "left")
    return found.withColumn("root", F.coalesce("root", "node")).drop("node")
