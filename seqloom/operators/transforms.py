"""Alphabets, stable partitions, levels and Huffman codes."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.words import digit, n_digits
from seqloom.operators.ranges import frequencies
from seqloom.plans.prefix import dense_positions, occurrence_index, prefix_count
from seqloom.sources.scratch import scratch


#: Positions of a sequence that one task numbers at once.
BLOCK = 1 << 15


def alphabet(df: DataFrame, sym: str) -> DataFrame:
    """Each distinct value and its rank among them, ``code``, from 0, by ranges of values: no window over the alphabet."""
    return dense_positions(df.select(sym).filter(F.col(sym).isNotNull()).distinct(), [sym], "code").select(sym, F.col("code").cast("bigint").alias("code"))


def text_remap(df: DataFrame, sym: str, out: str = "code") -> DataFrame:
    """``df`` with an order-preserving compact code of ``sym``."""
    return df.join(alphabet(df, sym).withColumnRenamed("code", out), sym, "left")


def _stable(seq: DataFrame, key: Column) -> DataFrame:
    """Rows with ``new_pos``: their place after a stable sort by ``key``, a small integer.

    Smaller keys' counts plus the row's index among its own key: no window over the sequence.
    """
    keyed = occurrence_index(seq.withColumn("_key", key), ["seq_id", "_key"], out="_k")
    before = Window.partitionBy("seq_id").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy("seq_id", "_key").agg(F.count(F.lit(1)).alias("_c"))
    offsets = counts.select("seq_id", "_key", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    return keyed.join(offsets, ["seq_id", "_key"]).withColumn("new_pos", F.col("_k") + F.col("_off")).drop("_key", "_k", "_off")


def partition_of_4(seq: DataFrame, shift: int = 0) -> DataFrame:
    return _stable(seq, digit("sym", shift, 2))


def partition_of_2(seq: DataFrame, shift: int = 0) -> DataFrame:
    return _stable(seq, digit("sym", shift, 1))


def partition_with_codes(seq: DataFrame, codes: DataFrame, shift: int, bits: int = 2) -> DataFrame:
    """Stable partition by the code's digit that ends ``shift`` bits from its start; codes that end there or before go last."""
    coded = seq.join(codes, ["seq_id", "sym"])
    own = F.call_function("shiftright", F.col("content"), (F.col("len") - shift).cast("int")).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))
    return _stable(coded, F.when(F.col("len") <= shift, F.lit(1 << bits).cast("bigint")).otherwise(own))


def _level_places(coded: DataFrame, bits: int) -> DataFrame:
    """seq_id, level, pos, digit of rows (seq_id, pos, value, len): at a level nodes in order, and in each as in the sequence.

    The digits of ``value``, of ``len`` bits, are those of its levels; a level holds the rows that reach it. A row's place is the
    counts of smaller nodes, those of its own node in earlier blocks of positions, and its index in node and block. Only counts of
    (block, value) are dealt by nodes; a block's rows are numbered at all levels at once, in one task's memory.
    """
    keys, mask = ["seq_id", "level"], (1 << bits) - 1
    coded = scratch(coded.select("seq_id", "pos", "value", F.col("len").cast("int").alias("len")).withColumn("blk", F.expr(f"pos div {BLOCK}")), "coded")
    distinct = coded.groupBy("seq_id", "blk", "value", "len").agg(F.count(F.lit(1)).alias("_c"))
    each = distinct.withColumn("level", F.explode(F.expr(f"sequence(0L, len div {bits} - 1)")))
    each = each.select(*keys, "blk", _backwards("value", f"len - {bits} * level", bits).alias("node"), "_c")
    counts = scratch(each.groupBy(*keys, "node", "blk").agg(F.sum("_c").alias("_c")), "nodes")
    nodes = counts.groupBy(*keys, "node").agg(F.sum("_c").alias("_c"))
    offsets = prefix_count(nodes.select(*keys, "node"), nodes, keys, at="node", pos="node", out="_off", weight="_c")
    earlier = prefix_count(counts.drop("_c"), counts, [*keys, "node"], at="blk", pos="blk", out="_k", weight="_c")
    starts = earlier.join(offsets, [*keys, "node"]).select(*keys, "node", "blk", (F.col("_k") + F.col("_off")).cast("bigint").alias("start"))

    def placed(rows, begin):
        import numpy as np
        import pandas as pd

        rows, begin = rows.sort_values("pos", kind="stable"), begin.sort_values(["level", "node"])
        value, size = rows["value"].to_numpy("int64"), rows["len"].to_numpy("int64")
        starts, levels = begin["start"].to_numpy("int64"), begin["level"].to_numpy("int64")
        order, node, level, out = np.arange(len(value)), np.zeros(len(value), "int64"), 0, []
        while True:  # rows stand by node, and in each node by position
            left = size[order] >= bits * (level + 1)
            order, node = order[left], node[left]
            if not len(order):
                break
            digit = value[order] >> (size[order] - bits * (level + 1)) & mask
            first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            runs = np.diff(np.r_[first, len(node)])
            own = starts[slice(*np.searchsorted(levels, [level, level + 1]))]
            if len(own) != len(first):
                raise ValueError("nodes of a block without a start")
            out.append((np.full(len(order), level), np.repeat(own - first, runs) + np.arange(len(order)), digit))
            by = np.argsort(digit, kind="stable")
            node = (node + (digit << (bits * level)))[by] if bits * (level + 1) < 64 else node[by]
            order, level = order[by], level + 1
        level, pos, digit = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, "int64"),) * 3
        of = (rows if len(rows) else begin)["seq_id"].iloc[0]
        return pd.DataFrame({"seq_id": np.full(len(pos), of), "level": level, "pos": pos, "digit": digit})

    by = ["seq_id", "blk"]
    return coded.groupBy(*by).cogroup(starts.groupBy(*by)).applyInPandas(placed, "seq_id bigint, level bigint, pos bigint, digit bigint")


def _backwards(value: str, lowest: str, bits: int) -> Column:
    """The ``level`` digits of ``value`` from bit ``lowest`` up as one number, the lowest of them its first digit."""
    mask = (1 << bits) - 1
    return F.expr(f"aggregate(sequence(0L, level), 0L, (a, j) -> case when j < level then (a << {bits}) | (shiftright({value}, cast({lowest} + {bits} * j as int)) & {mask}) else a end)")


def levels(seq: DataFrame, bits: int = 2) -> DataFrame:
    """seq_id, level, pos, digit: the content of every level, the most significant digit first.

    At a level, symbols stand ordered by their digits above it, the nearest first, and then as in the
    sequence. So a symbol's node is the string of those digits backwards.
    """
    sizes = seq.groupBy("seq_id").agg((n_digits(F.max("sym"), bits) * bits).alias("len"))
    return _level_places(seq.join(sizes, "seq_id").withColumnRenamed("sym", "value"), bits)


def code_levels(seq: DataFrame, codes: DataFrame, bits: int = 2) -> DataFrame:
    """The same of the codes of symbols: a level holds those symbols whose codes reach it."""
    return _level_places(seq.join(codes, ["seq_id", "sym"]).withColumnRenamed("content", "value"), bits)


def huffman_lengths(weights: dict[int, int], arity: int) -> dict[int, int]:
    """Code lengths, in digits, of an optimal prefix code of 2 or 4 digits; ties by symbol. One symbol has length 1."""
    if len(weights) <= 1:
        return dict.fromkeys(weights, 1)
    heap = [(w, i, [s]) for i, (s, w) in enumerate(sorted(weights.items()))]
    while (len(heap) - 1) % (arity - 1):
        heap.append((0, -len(heap), []))
    heapq.heapify(heap)
    out, tick = dict.fromkeys(weights, 0), len(heap)
    while len(heap) > 1:
        total, members = 0, []
        for _ in range(arity):
            w, _, below = heapq.heappop(heap)
            total += w
            members += below
        for s in members:
            out[s] += 1
        tick += 1
        heapq.heappush(heap, (total, tick, members))
    return out


def assign_codes(lengths: dict[int, int], bits: int) -> dict[int, tuple[int, int]]:
    """symbol: (length in bits, content), prefix-free; short codes take the largest contents, ties by symbol.

    Short codes come last among the nodes of their level, as a level-wise layout wants finished
    symbols behind the others.
    """
    if not lengths:
        return {}
    arity, longest = 1 << bits, max(lengths.values())
    out, free = {}, [0]  # nodes of the present depth that are not yet a code
    for depth in range(1, longest + 1):
        free = [node * arity + d for node in free for d in range(arity)]
        mine = sorted(s for s, n in lengths.items() if n == depth)
        for s in mine:
            out[s] = (depth * bits, free.pop())
        still = sum(1 for n in lengths.values() if n > depth)
        free = free[-max(1, still) :] if still else []
    return out


def codes(seq: DataFrame, bits: int = 2, most_symbols: int = 1 << 20) -> DataFrame:
    """seq_id, sym, len, content: one task a sequence builds its codes from its frequencies.

    One sequence's alphabet must fit a task: over ``most_symbols`` are an error when rows are computed. Codes take 63 bits at most.
    """
    import pandas as pd

    def made(rows: pd.DataFrame) -> pd.DataFrame:
        table = assign_codes(huffman_lengths(dict(zip(rows["sym"].tolist(), rows["cnt"].tolist(), strict=True)), 1 << bits), bits)
        if max(n for n, _ in table.values()) > 63:
            raise ValueError("a code of over 63 bits")
        return pd.DataFrame({"seq_id": rows["seq_id"].iloc[0], "sym": list(table), "len": [n for n, _ in table.values()], "content": [c for _, c in table.values()]})

    counted = frequencies(seq)
    sizes = counted.groupBy("seq_id").agg(F.count(F.lit(1)).alias("_n"))
    fits = F.when(F.col("_n") <= most_symbols, F.col("sym")).otherwise(F.raise_error(F.lit(f"over {most_symbols} symbols in one sequence")).cast("bigint"))
    return counted.join(sizes, "seq_id").select("seq_id", fits.alias("sym"), "cnt").groupBy("seq_id").applyInPandas(made, "seq_id bigint, sym bigint, len int, content bigint")


def decode(coded: DataFrame, code_table: DataFrame) -> DataFrame:
    """Rows with (seq_id, len, content) and the symbol of each."""
    return coded.join(code_table, ["seq_id", "len", "content"], "left")


def huffman_cost(seq: DataFrame, code_table: DataFrame) -> DataFrame:
    """seq_id and bits: the length of the coded sequence."""
    return frequencies(seq).join(code_table, ["seq_id", "sym"]).groupBy("seq_id").agg(F.sum(F.col("cnt") * F.col("len")).alias("bits"))


def level_lengths(seq: DataFrame, code_table: DataFrame, bits: int = 2) -> DataFrame:
    """seq_id, level, n: how many symbols have a digit at each level of the coded sequence."""
    reach = frequencies(seq).join(code_table, ["seq_id", "sym"]).withColumn("level", F.explode(F.expr(f"sequence(0L, len div {bits} - 1)")))
    return reach.groupBy("seq_id", "level").agg(F.sum("cnt").alias("n"))
