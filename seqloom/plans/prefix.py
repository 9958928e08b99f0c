"""Prefix counts that no hot key can overload.

Positions are cut into buckets of ``BUCKET``, buckets into superbuckets of as many buckets. A
window then runs over the rows of one key in one bucket, over the buckets of one superbucket, and
over superbuckets: each partition holds at most ``BUCKET`` rows of data (the last, the square root
of what a plain window would). The rows themselves are shuffled once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.plans.sizes import is_small

BUCKET = 4096


def _div(column: str, by: int):
    return F.expr(f"`{column}` div {by}")


def bucket_prefixes(df: DataFrame, keys: list[str], pos: str = "pos", bucket: int = BUCKET) -> DataFrame:
    """keys, _b and _before: rows of the key in earlier buckets."""
    counts = df.groupBy(*keys, _div(pos, bucket).alias("_b")).agg(F.count(F.lit(1)).alias("_c")).withColumn("_s", _div("_b", bucket))
    within = Window.partitionBy(*keys, "_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    supers = counts.groupBy(*keys, "_s").agg(F.sum("_c").alias("_c")).select(*keys, "_s", F.coalesce(F.sum("_c").over(across), F.lit(0)).alias("_far"))
    near = counts.withColumn("_near", F.coalesce(F.sum("_c").over(within), F.lit(0)))
    return near.join(supers, [*keys, "_s"]).select(*keys, "_b", (F.col("_near") + F.col("_far")).alias("_before"))


def occurrence_index(df: DataFrame, keys: list[str], pos: str = "pos", out: str = "k", bucket: int = BUCKET) -> DataFrame:
    """``df`` with ``out``: how many rows of the same key stand at smaller positions."""
    own = Window.partitionBy(*keys, "_b").orderBy(pos)
    numbered = df.withColumn("_b", _div(pos, bucket)).withColumn("_n", F.row_number().over(own).cast("bigint") - 1)
    return numbered.join(bucket_prefixes(df, keys, pos, bucket), [*keys, "_b"]).withColumn(out, F.col("_before") + F.col("_n")).drop("_b", "_n", "_before")


def _as_of(queries: DataFrame, data: DataFrame, keys: list[str], at: str, weight: str, out: str) -> DataFrame:
    """``queries`` with ``out``: the sum of ``weight`` over data of the same keys whose ``at`` is less than theirs."""
    fields = queries.columns
    tagged = queries.select(*keys, at, F.lit(0).alias("_kind"), F.lit(0).cast("bigint").alias("_w"), F.struct(*fields).alias("_q"))
    rows = data.select(*keys, at, F.lit(1).alias("_kind"), F.col(weight).cast("bigint").alias("_w"), F.lit(None).cast(tagged.schema["_q"].dataType).alias("_q"))
    upto = Window.partitionBy(*keys).orderBy(at, "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = tagged.unionByName(rows).withColumn(out, F.sum("_w").over(upto)).filter("_kind = 0")
    return summed.select(*(F.col(f"_q.{c}").alias(c) for c in fields), out)


def bucket_counts(rows: DataFrame, keys: list[str], bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """keys, _p1 and _w1: what each bucket weighs; and of superbuckets _p2 and _w2. rows: keys, _p1 and _w0."""
    counts = rows.groupBy(*keys, "_p1").agg(F.sum("_w0").alias("_w1")).withColumn("_p2", _div("_p1", bucket))
    return counts, counts.groupBy(*keys, "_p2").agg(F.sum("_w1").alias("_w2"))


def prefix_count(
    queries: DataFrame, data: DataFrame, keys: list[str], at: str = "i", pos: str = "pos", out: str = "r", bucket: int = BUCKET, weight: str | None = None, stored: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """``queries`` with ``out``: rows of ``data`` with the same keys and ``pos`` less than ``at`` (exclusive as-of count), or the sum of their ``weight``.

    If the queries are small enough to broadcast, only data in buckets that some query falls into are shuffled. With
    ``stored`` bucket counts, data is read for those buckets alone, and never counted again.
    """
    w = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    rows = data.select(*keys, F.col(pos).alias("_p0"), w.alias("_w0")).withColumn("_p1", _div("_p0", bucket))
    counts, supers = stored or bucket_counts(rows, keys, bucket)
    q = queries.withColumn("_p0", F.col(at)).withColumn("_p1", _div("_p0", bucket)).withColumn("_p2", _div("_p1", bucket))
    if is_small(queries):
        wanted = q.select(*keys, "_p1").distinct()
        rows = rows.join(F.broadcast(wanted), [*keys, "_p1"], "left_semi")
        if stored:
            counts = counts.join(F.broadcast(q.select(*keys, "_p2").distinct()), [*keys, "_p2"], "left_semi")
            supers = supers.join(F.broadcast(q.select(*keys).distinct()), keys, "left_semi")
    q = _as_of(q, rows, [*keys, "_p1"], "_p0", "_w0", "_r0")
    q = _as_of(q, counts, [*keys, "_p2"], "_p1", "_w1", "_r1")
    q = _as_of(q, supers, keys, "_p2", "_w2", "_r2")
    return q.withColumn(out, reduce(lambda a, b: a + b, (F.col(f"_r{i}") for i in range(3)))).drop("_p0", "_p1", "_p2", "_r0", "_r1", "_r2")


def _holding(queries: DataFrame, data: DataFrame, keys: list[str], place: str, weight: str, k: str) -> DataFrame:
    """``queries`` with ``place`` of the row of ``data`` that holds the (``k`` + 1)-th unit of weight, and ``k`` counted from its start."""
    fields = [c for c in queries.columns if c != k]
    upto = Window.partitionBy(*keys).orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = data.select(*keys, place, (F.sum(weight).over(upto) - F.col(weight)).alias("_at"))
    tagged = queries.select(*keys, F.col(k).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("bigint").alias("_place"), F.lit(None).cast("bigint").alias("_from"), F.struct(*fields).alias("_q"))
    rows = starts.select(*keys, "_at", F.lit(0).alias("_kind"), F.col(place).alias("_place"), F.col("_at").alias("_from"), F.lit(None).cast(tagged.schema["_q"].dataType).alias("_q"))
    last = Window.partitionBy(*keys).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = tagged.unionByName(rows).withColumns({"_place": F.last("_place", ignorenulls=True).over(last), "_from": F.last("_from", ignorenulls=True).over(last)}).filter("_kind = 1")
    return found.select(*(F.col(f"_q.{c}").alias(c) for c in fields), F.col("_place").alias(place), (F.col("_at") - F.col("_from")).alias(k))


def prefix_select(queries: DataFrame, data: DataFrame, keys: list[str], k: str = "k", pos: str = "pos", bucket: int = BUCKET, index: StoredIndex | None = None) -> DataFrame:
    """``queries`` with ``pos`` of the row of ``data`` that has ``k`` rows of the same keys before it; NULL if there is none.

    The superbucket, then the bucket that holds it are found from their counts; only rows of buckets that
    were found are numbered. ``queries`` needs a column ``qid``.
    """
    rows = data.select(*keys, F.col(pos).alias("_p0"), F.lit(1).cast("bigint").alias("_w0")).withColumn("_p1", _div("_p0", bucket))
    counts, supers = index.counted(queries) if index else bucket_counts(rows, keys, bucket)
    small = is_small(queries)
    if small and index:
        supers = supers.join(F.broadcast(queries.select(*keys).distinct()), keys, "left_semi")
    q = _holding(queries.select("qid", *keys, F.col(k).cast("bigint").alias("_k")).filter("_k >= 0"), supers, keys, "_p2", "_w2", "_k")
    if small and index:
        counts = counts.join(F.broadcast(q.select(*keys, "_p2").distinct()), [*keys, "_p2"], "left_semi")
        rows = index.folders(q)
    q = _holding(q.filter("_p2 is not null"), counts, [*keys, "_p2"], "_p1", "_w1", "_k")
    wanted = q.select(*keys, "_p1").distinct()
    near = rows.join(F.broadcast(wanted) if small else wanted, [*keys, "_p1"], "left_semi")
    own = Window.partitionBy(*keys, "_p1").orderBy("_p0")
    numbered = near.select(*keys, "_p1", F.col("_p0").alias(pos), (F.row_number().over(own).cast("bigint") - 1).alias("_k"))
    found = q.join(numbered, [*keys, "_p1", "_k"]).select("qid", pos)
    return queries.join(found, "qid", "left")


def prefix_count_window(queries: DataFrame, data: DataFrame, keys: list[str], at: str = "i", pos: str = "pos", out: str = "r") -> DataFrame:
    """The same by one window a key: fewer steps, for keys without hot values."""
    rows = data.select(*keys, F.col(pos).alias("_p"), F.lit(1).alias("_w0"))
    return _as_of(queries.withColumn("_p", F.col(at)), rows, keys, "_p", "_w0", out).drop("_p")


def prefix_count_join(queries: DataFrame, data: DataFrame, keys: list[str], at: str = "i", pos: str = "pos", out: str = "r") -> DataFrame:
    """The same by a join with a residual range: for a handful of queries. ``queries`` needs a column ``qid``."""
    hits = data.select(*keys, F.col(pos).alias("_p")).join(queries.select("qid", *keys, F.col(at).alias("_i")), keys).filter("_p < _i")
    return queries.join(hits.groupBy("qid").agg(F.count(F.lit(1)).alias("_r")), "qid", "left").withColumn(out, F.coalesce("_r", F.lit(0))).drop("_r")


@dataclass(frozen=True)
class StoredIndex:
    """A sequence and its bucket counts in files, built once: batches of queries read the parts that they need.

    Rows lie in ``parts`` folders by a hash of sequence and superbucket, counts by one of sequence and symbol. A small batch
    prunes folders and, in them, rows and counts of other buckets before any shuffle.
    """

    path: str
    parts: int
    rows: DataFrame
    counts: DataFrame
    supers: DataFrame

    PART_ROWS = BUCKET * BUCKET // 4
    #: Tasks that the counts of one folder and superbucket are dealt to, by symbols: a folder has at most about PART_ROWS of them.
    PIECES = 16

    @staticmethod
    def _part(parts: int, *columns: str):
        return F.pmod(F.xxhash64(*(F.col(c).cast("bigint") for c in columns)), F.lit(parts)).cast("int").alias("part")

    @classmethod
    def build(cls, seq: DataFrame, path: str, parts: int | None = None) -> StoredIndex:
        parts = parts or max(1, min(4096, seq.count() // cls.PART_ROWS))
        rows = seq.select("seq_id", "pos", "sym", _div("pos", BUCKET).alias("_p1"), F.lit(1).cast("bigint").alias("_w0")).withColumn("_p2", _div("_p1", BUCKET))
        dealt = rows.select("seq_id", "pos", "sym", cls._part(parts, "seq_id", "_p2"))
        dealt.repartition("part", _div("pos", BUCKET * 16)).sortWithinPartitions("part", "seq_id", "pos").write.partitionBy("part").parquet(f"{path}/rows")
        counts, supers = bucket_counts(rows, ["seq_id", "sym"])
        for name, df, order in (("counts", counts, ["_p1"]), ("supers", supers, ["_p2"])):
            df.select("*", cls._part(parts, "seq_id", "sym")).repartition("part", "_p2", F.pmod(F.hash("seq_id", "sym"), F.lit(cls.PIECES))).sortWithinPartitions("part", "seq_id", "sym", *order).write.partitionBy("part").parquet(f"{path}/{name}")
        seq.sparkSession.createDataFrame([(parts,)], "parts int").coalesce(1).write.parquet(f"{path}/meta")  # last: an index without it is not complete
        return cls.load(seq.sparkSession, path)

    @classmethod
    def load(cls, spark, path: str) -> StoredIndex:
        parts = spark.read.parquet(f"{path}/meta").first()["parts"]
        return cls(path, parts, *(spark.read.parquet(f"{path}/{n}") for n in ("rows", "counts", "supers")))

    @property
    def stored(self) -> tuple[DataFrame, DataFrame]:
        return self.counts.drop("part"), self.supers.drop("part")

    def _asked(self, wanted: DataFrame, *columns: str):
        """A filter on the folders that a small table asks for: at most ``parts`` numbers, found by a job of their own."""
        found = wanted.select(self._part(self.parts, *columns)).distinct().collect()
        return F.col("part").isin([r["part"] for r in found])

    def folders(self, wanted: DataFrame) -> DataFrame:
        """Rows (_p0, _p1, _w0) of only those folders that hold what is in ``wanted`` (seq_id, _p2), a small table."""
        asked = self._asked(wanted, "seq_id", "_p2")
        return self.rows.filter(asked).select("seq_id", "sym", F.col("pos").alias("_p0"), F.lit(1).cast("bigint").alias("_w0")).withColumn("_p1", _div("_p0", BUCKET))

    def data(self, queries: DataFrame | None = None, at: str = "i") -> DataFrame:
        """seq_id, pos and sym; with a small batch of queries only the folders that hold the positions in ``at``."""
        if queries is None or not is_small(queries):
            return self.rows.drop("part")
        wanted = queries.select("seq_id", F.expr(f"`{at}` div {BUCKET} div {BUCKET}").alias("_p2"))
        return self.folders(wanted).select("seq_id", F.col("_p0").alias("pos"), "sym")

    def counted(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The counts; for a small batch only of folders that hold the queries' symbols."""
        if not is_small(queries):
            return self.stored
        asked = self._asked(queries, "seq_id", "sym")
        return tuple(df.filter(asked).drop("part") for df in (self.counts, self.supers))

    def frequencies(self, queries: DataFrame | None = None) -> DataFrame:
        """seq_id, sym and cnt; for a small batch only of folders that hold the queries' symbols."""
        supers = self.supers if queries is None else self.counted(queries)[1]
        return supers.groupBy("seq_id", "sym").agg(F.sum("_w2").alias("cnt"))

    def meta(self) -> DataFrame:
        return self.supers.groupBy("seq_id").agg(F.sum("_w2").alias("n"), F.max("sym").alias("sigma"))


PLANS = {"bucketed": prefix_count, "window": prefix_count_window, "join": prefix_count_join}


def dense_positions(df: DataFrame, order: list[str], out: str = "pos", partitions: int | None = None) -> DataFrame:
    """``df`` with 0-based positions in the order of ``order``, without a window over all rows.

    Rows are dealt by ranges of the order and sorted there; a row's position is its place in its
    part plus the sizes of the parts before (one row each, broadcast: as many as shuffle partitions).
    The parts are stored, since both uses must see the same ones.
    """
    from seqloom.sources.scratch import scratch

    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = scratch(dealt.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "dense")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return placed.join(F.broadcast(sizes), "_part").withColumn(out, F.col("_place") + F.col("_offset")).drop("_part", "_place", "_offset")
