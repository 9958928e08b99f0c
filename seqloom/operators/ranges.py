"""Symbol distributions of position ranges, and total counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.plans.prefix import BUCKET as INDEX_BUCKET
from seqloom.plans.prefix import StoredIndex, prefix_count
from seqloom.plans.sizes import is_small

BUCKET = 1024
#: Queries that are joined with one bucket in one task.
BATCH = 4096
#: Nodes of one level in a node of the next.
FANOUT = 64


def frequencies(seq: DataFrame) -> DataFrame:
    return seq.groupBy("seq_id", "sym").agg(F.count(F.lit(1)).alias("cnt"))


def normalised(l: int | None, r: int | None, n: int, l_open: bool = False, r_closed: bool = False) -> tuple[int, int] | None:  # noqa: E741
    """Any range's half-open bounds in a sequence of ``n``; None if it is not one of its ranges."""
    low = 0 if l is None else l + l_open
    high = n if r is None else r + r_closed
    return None if high > n or low > high or low < 0 else (low, high)


def occs_range(seq: DataFrame, l: int | None = None, r: int | None = None) -> DataFrame:  # noqa: E741
    """sym and cnt of one range of a single sequence, by symbol; the bounds reach the scan as filters."""
    rows = seq
    if l is not None:
        rows = rows.filter(F.col("pos") >= l)
    if r is not None:
        rows = rows.filter(F.col("pos") < r)
    return rows.groupBy("sym").agg(F.count(F.lit(1)).alias("cnt")).orderBy("sym")


def range_status(queries: DataFrame, meta: DataFrame) -> DataFrame:
    """queries (qid, seq_id, l, r) with null bounds filled in, and ok: whether the range is one of the sequence's."""
    q = queries.join(meta.select("seq_id", "n"), "seq_id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    low, high = F.coalesce("l", F.lit(0).cast("bigint")), F.coalesce("r", "n")
    return q.select("qid", "seq_id", low.alias("l"), high.alias("r"), ((low >= 0) & (low <= high) & (high <= F.col("n"))).alias("ok"))


def _edges(q: DataFrame, low: str, high: str, by: int):
    """Full buckets [a, b) of [low, high), and what is left of it before and behind them (all if none is full)."""
    a, b = F.expr(f"({low} + {by - 1}) div {by}"), F.expr(f"{high} div {by}")
    q = q.withColumns({"_a": a, "_b": b})
    some = F.col("_a") < F.col("_b")
    parts = F.when(some, F.array(F.struct(F.col(low).alias("f"), (F.col("_a") * by).alias("t")), F.struct((F.col("_b") * by).alias("f"), F.col(high).alias("t")))).otherwise(F.array(F.struct(F.col(low).alias("f"), F.col(high).alias("t"))))
    rest = q.withColumn("_part", F.explode(parts)).withColumns({"f": F.col("_part.f"), "t": F.col("_part.t")}).filter("f < t")
    return q.filter("_a < _b").withColumns({"f": F.col("_a"), "t": F.col("_b")}), rest


def _met(asked: DataFrame, held: DataFrame, keys: list[str], small: bool) -> DataFrame:
    """Their join. Where ``asked`` is too large to be broadcast, a key with over ``BATCH`` rows of it is dealt to several tasks."""
    if small:
        return asked.join(held, keys)
    pieces = F.pmod(F.xxhash64(*asked.columns), F.expr(f"(most + {BATCH - 1}) div {BATCH}"))
    most = asked.groupBy(*keys).agg(F.count(F.lit(1)).alias("most"))
    asked = asked.join(most, keys).withColumn("piece", pieces).drop("most")
    held = held.join(most, keys).withColumn("piece", F.explode(F.expr(f"sequence(0L, (most - 1) div {BATCH})"))).drop("most")
    return asked.join(held, [*keys, "piece"]).drop("piece")


def _blocks(rows: DataFrame) -> DataFrame:
    """seq_id, u and the symbols of bucket u and the one behind it in the order of places; these too (``ats``) if they have gaps."""
    both = rows.select("seq_id", F.explode(F.array("u", F.col("u") - 1)).alias("u"), "at", "sym").filter("u >= 0")
    held = both.groupBy("seq_id", "u").agg(F.sort_array(F.collect_list(F.struct("at", "sym"))).alias("_held"))
    held = held.select("seq_id", "u", F.col("_held.at").alias("ats"), F.col("_held.sym").alias("syms"))
    dense = F.expr("ats[size(ats) - 1] - ats[0] + 1 = size(ats) and size(array_distinct(ats)) = size(ats)")
    return held.select("seq_id", "u", F.expr("ats[0]").alias("first"), F.when(~dense, F.col("ats")).alias("ats"), "syms")


#: The runs of equal symbols in the sorted ``cut``.
_RUNS = (
    "transform(array(sort_array(cut)), s -> transform(array(filter(sequence(1, size(s)), j -> j = size(s) or s[j] <> s[j - 1])), "
    "e -> transform(e, (j, k) -> named_struct('sym', s[j - 1], 'cnt', cast(j - if(k = 0, 0, e[k - 1]) as bigint)))))[0][0]"
)


def _counted(parts: DataFrame, rows: DataFrame, bucket: int, small: bool) -> DataFrame:
    """``parts`` (f, t and more), each within two buckets, with sym and cnt: cut out of one row of symbols and counted there."""
    asked = parts.withColumn("u", F.expr(f"f div {bucket}"))
    low, high = "greatest(f, first)", "least(t, first + size(syms))"
    dense = f"slice(syms, cast(greatest(1L, {low} - first + 1) as int), cast(greatest(0L, {high} - {low}) as int))"
    cut = F.expr(f"if(ats is null, {dense}, transform(filter(arrays_zip(ats, syms), x -> x.ats >= f and x.ats < t), x -> x.syms))")
    found = _met(asked, _blocks(rows), ["seq_id", "u"], small).select(*parts.columns, cut.alias("cut")).filter("size(cut) > 0")
    return found.select(*parts.columns, F.inline(F.expr(_RUNS)))


def occs_range_batch(seq: DataFrame, queries: DataFrame, meta: DataFrame, bucket: int = BUCKET, index: StoredIndex | None = None) -> DataFrame:
    """qid, sym, cnt for symbols present in each valid range.

    A range that holds no full bucket is cut out of a row that holds the symbols of two, and its counts need no further
    shuffle. Of longer ones, each different one is counted once: its two edges in the same way, and between them at most about
    ``2 FANOUT`` nodes of each of three levels, whose sums are shared by the ranges that they are common to. Where queries are too many
    to be broadcast, what over ``BATCH`` of them meet is dealt to several tasks. With an index its counts and its bucket size are used.
    """
    small = is_small(queries)
    bucket = INDEX_BUCKET if index else bucket
    ok = range_status(queries, meta).filter("ok").drop("ok")
    is_long = F.expr(f"(l + {bucket - 1}) div {bucket} < r div {bucket}")
    told = ok.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.max(is_long).alias("long")).agg(F.max("n").alias("n"), F.max("long").alias("long")).first()
    rows = seq.select("seq_id", F.expr(f"pos div {bucket}").alias("u"), F.col("pos").alias("at"), "sym")
    short = ok.filter(~is_long).filter("l < r").select("qid", "seq_id", F.col("l").alias("f"), F.col("r").alias("t"))
    out = _counted(short, rows, bucket, small).select("qid", "sym", "cnt")
    if told["long"]:
        out = out.unionByName(_long_ranges(ok.filter(is_long).select("qid", "seq_id", "l", "r"), rows, bucket, index, small))
    return out if (told["n"] or 0) <= 1 else out.groupBy("qid", "sym").agg(F.sum("cnt").alias("cnt"))  # of one qid, all its ranges


def _long_ranges(queries: DataFrame, rows: DataFrame, bucket: int, index: StoredIndex | None, small: bool) -> DataFrame:
    """qid, sym, cnt of ranges that hold a full bucket."""
    if index:
        counts, supers = index.stored
        nodes = [counts.select("seq_id", F.col("_p1").alias("at"), "sym", F.col("_w1").alias("c"))]
    else:
        nodes = [rows.groupBy("seq_id", F.col("u").alias("at"), "sym").agg(F.count(F.lit(1)).alias("c"))]
    for _ in range(2):
        nodes.append(nodes[-1].groupBy("seq_id", F.expr(f"at div {FANOUT}").alias("at"), "sym").agg(F.sum("c").alias("c")))
    if index and FANOUT * FANOUT == INDEX_BUCKET:
        nodes[2] = supers.select("seq_id", F.col("_p2").alias("at"), "sym", F.col("_w2").alias("c"))
    fields = ["seq_id", "l", "r", "f", "t"]
    rest, raw = _edges(queries.select("seq_id", "l", "r").distinct(), "l", "r", bucket)
    raw, parts = raw.select(*fields), []
    for level in range(2):
        rest, some = _edges(rest.select(*fields), "f", "t", FANOUT)
        parts.append(some.select(*fields, F.lit(level).alias("level")))
    parts = reduce(DataFrame.unionByName, [*parts, rest.select(*fields, F.lit(2).alias("level"))])
    keys = ["seq_id", "level", "f", "t"]
    spread = parts.select(*keys).distinct().withColumn("at", F.explode(F.expr("sequence(f, t - 1)")))
    every = reduce(DataFrame.unionByName, [n.withColumn("level", F.lit(level)) for level, n in enumerate(nodes)])
    sums = spread.join(every, ["seq_id", "level", "at"]).groupBy(*keys, "sym").agg(F.sum("c").alias("cnt"))
    edges = _counted(raw.select("seq_id", "f", "t").distinct(), rows, bucket, small).withColumn("level", F.lit(-1))
    each = parts.unionByName(raw.withColumn("level", F.lit(-1)))
    whole = _met(each, sums.unionByName(edges.select(sums.columns)), keys, small).groupBy("seq_id", "l", "r", "sym").agg(F.sum("cnt").alias("cnt"))
    return _met(queries, whole, ["seq_id", "l", "r"], small).select("qid", "sym", "cnt")


def occs_range_naive(seq: DataFrame, queries: DataFrame, meta: DataFrame) -> DataFrame:
    """The same as rank(sym, r) - rank(sym, l) of every symbol: a check of ``occs_range_batch``, for few queries."""
    ok = range_status(queries, meta).filter("ok").drop("ok")
    each = ok.join(frequencies(seq).select("seq_id", "sym"), "seq_id")
    low = prefix_count(each, seq, ["seq_id", "sym"], "l", out="a")
    both = prefix_count(low, seq, ["seq_id", "sym"], "r", out="b")
    return both.select("qid", "sym", (F.col("b") - F.col("a")).alias("cnt")).filter("cnt > 0")


def occs(quads: DataFrame) -> DataFrame:
    """seq_id, sym 0 to 3, occs and occs_smaller (occurrences of smaller symbols)."""
    four = quads.select("seq_id").distinct().withColumn("sym", F.explode(F.array(*(F.lit(c).cast("bigint") for c in range(4)))))
    counted = four.join(frequencies(quads), ["seq_id", "sym"], "left").select("seq_id", "sym", F.coalesce("cnt", F.lit(0).cast("bigint")).alias("occs"))
    before = Window.partitionBy("seq_id").orderBy("sym").rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("occs_smaller", F.coalesce(F.sum("occs").over(before), F.lit(0).cast("bigint")))
