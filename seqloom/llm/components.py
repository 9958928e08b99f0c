"""Connected components of links, by alternating large-star and small-star steps.

First each task replaces the links that it reads by a forest of the same components, ``HELD`` nodes at a time.
Then every step is an aggregation and a join; each round is written to the shared folder, so lineage
stays short and nothing is collected. A node with a large share of all links (the root of a large
group) is no join key of one task: ``split_join`` broadcasts the few such nodes' smallest neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm import common

#: Rounds are logarithmic in the size of a component; this many only a fault would need.
MOST_ROUNDS = 60
#: Nodes that a task holds at once.
HELD = 500_000


def _forest(links: DataFrame) -> DataFrame:
    """Links (u, v), u > v, of the same components: in each task every node to the smallest that it reaches there."""
    import pyarrow as pa

    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        def sent():
            out = [(x, r) for x in list(up) if (r := top(x)) != x]
            up.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], schema=schema)

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = top(u), top(v)
                if a != b:
                    up[max(a, b)] = min(a, b)
            if len(up) > HELD:
                yield sent()
        yield sent()

    return links.select("u", "v").mapInArrow(run, "u bigint, v bigint")


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return common.split_join(both, least, "u", 2 * n, counted="n").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = common.split_join(edges, least, "u", 2 * n, counted="n").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def star_components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node it reaches) of every node with a link; links: (u, v)."""
    edges = common.scratch(_forest(links).distinct(), "forest")
    state = _state(edges)
    for _ in range(MOST_ROUNDS if state[0] else 0):
        edges = common.scratch(_small_star(_large_star(edges, state[0]), state[0]), "edges")
        now = _state(edges)
        if now == state:
            break
        state = now
    else:
        if state[0]:
            raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
