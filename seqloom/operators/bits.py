"""Bit sequences: reading, rank, select and copy-on-write changes.

A bit sequence is its ones (seq_id, pos) and its lengths (seq_id, n_bits); zeros are what is missing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.plans.prefix import occurrence_index, prefix_count, prefix_select


def _long(x):
    return F.lit(x).cast("bigint")


#: Places that one row is expanded to at most.
RUN = 1 << 16


def _places(sizes: DataFrame, n: str, out: str, start: int = 0) -> DataFrame:
    """seq_id and ``out`` from ``start`` to below ``n``: no task makes all places of a sequence.

    Runs of runs are expanded first, then dealt to tasks as runs, and there to places.
    """
    top = RUN * RUN
    supers = sizes.select("seq_id", F.expr(f"cast({n} as bigint)").alias("_n")).filter(F.col("_n") > start).withColumn("_s", F.explode(F.expr(f"sequence({start // top}L, (_n - 1) div {top})")))
    runs = supers.withColumn("_r", F.explode(F.expr(f"sequence(greatest(_s * {RUN}, {start // RUN}L), least((_s + 1) * {RUN} - 1, (_n - 1) div {RUN}))")))
    dealt = runs.select("seq_id", "_n", "_r").repartition("seq_id", "_r")
    return dealt.select("seq_id", F.explode(F.expr(f"sequence(greatest(_r * {RUN}, {start}L), least((_r + 1) * {RUN} - 1, _n - 1))")).alias(out))


@dataclass(frozen=True)
class BitSequence:
    ones_at: DataFrame
    sizes: DataFrame

    @classmethod
    def from_bits(cls, df: DataFrame) -> BitSequence:
        """From (seq_id, pos, bit)."""
        return cls(df.filter("bit").select("seq_id", "pos"), df.groupBy("seq_id").agg((F.max("pos") + 1).alias("n_bits")))

    @classmethod
    def from_positions(cls, df: DataFrame) -> BitSequence:
        """From (seq_id, pos) of ones in any order, repeats allowed; the length is the last one's place plus 1."""
        checked = df.select("seq_id", F.when(F.col("pos") < 0, F.raise_error(F.lit("negative position"))).otherwise(F.col("pos")).cast("bigint").alias("pos"))
        ones = checked.distinct()
        return cls(ones, ones.groupBy("seq_id").agg((F.max("pos") + 1).alias("n_bits")))

    @classmethod
    def zeros_of(cls, sizes: DataFrame) -> BitSequence:
        return cls(sizes.select("seq_id", _long(0).alias("pos")).filter("false"), sizes)

    # reading

    def dense(self) -> DataFrame:
        places = _places(self.sizes, "n_bits", "pos")
        return places.join(self.ones_at.withColumn("bit", F.lit(True)), ["seq_id", "pos"], "left").withColumn("bit", F.coalesce("bit", F.lit(False)))

    def get(self, queries: DataFrame) -> DataFrame:
        """(qid, seq_id, i) to (qid, bit); NULL out of range."""
        ones = self.ones_at.select("seq_id", F.col("pos").alias("i"), F.lit(True).alias("_one"))
        found = queries.join(ones, ["seq_id", "i"], "left").join(self.sizes, "seq_id", "left")
        return found.select("qid", F.when((F.col("i") >= 0) & (F.col("i") < F.col("n_bits")), F.coalesce("_one", F.lit(False))).alias("bit"))

    def get_bits(self, queries: DataFrame, strict_end: bool = False) -> DataFrame:
        """(qid, seq_id, index, len) to (qid, value), bit ``index`` lowest.

        NULL unless 1 <= len <= 64 and the bits lie in the sequence; with ``strict_end`` they must
        also end before its last bit's end.
        """
        end = F.col("index") + F.col("len")
        inside = end < F.col("n_bits") if strict_end else end <= F.col("n_bits")
        q = queries.join(self.sizes, "seq_id", "left").withColumn("ok", F.coalesce((F.col("len") >= 1) & (F.col("len") <= 64) & (F.col("index") >= 0) & inside, F.lit(False)))
        spread = q.filter("ok").select("qid", "seq_id", "index", F.explode(F.expr("sequence(index, index + len - 1)")).alias("pos"))
        bits = spread.join(self.ones_at, ["seq_id", "pos"]).groupBy("qid").agg(F.expr("bit_or(shiftleft(1L, cast(pos - index as int)))").alias("_v"))
        return q.join(bits, "qid", "left").select("qid", F.when(F.col("ok"), F.coalesce("_v", _long(0))).alias("value"))

    def words(self) -> DataFrame:
        """seq_id, w, word: all packed words."""
        packed = self.ones_at.groupBy("seq_id", F.expr("pos div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(pos % 64 as int)))").alias("word"))
        every = _places(self.sizes, "(n_bits + 63) div 64", "w")
        return every.join(packed, ["seq_id", "w"], "left").withColumn("word", F.coalesce("word", _long(0)))

    def get_word(self, w: int) -> DataFrame:
        """Word ``w`` of every sequence that has one: only its own ones are read."""
        first = _long(64 * w)
        packed = self.ones_at.filter((F.col("pos") >= first) & (F.col("pos") < first + 64)).groupBy("seq_id").agg(F.expr("bit_or(shiftleft(1L, cast(pos % 64 as int)))").alias("word"))
        return self.sizes.filter(F.col("n_bits") > first).join(packed, "seq_id", "left").select("seq_id", _long(w).alias("w"), F.coalesce("word", _long(0)).alias("word"))

    def ones(self, start: int = 0) -> DataFrame:
        return self.ones_at.filter(F.col("pos") >= start)

    def zeros(self, start: int = 0) -> DataFrame:
        places = _places(self.sizes, "n_bits", "pos", start)
        return places.join(self.ones_at, ["seq_id", "pos"], "left_anti")

    def counts(self) -> DataFrame:
        """seq_id, n_bits, count_ones, count_zeros, n_lines (of 512 bits)."""
        ones = self.ones_at.groupBy("seq_id").agg(F.count(F.lit(1)).alias("_c"))
        c = F.coalesce("_c", _long(0))
        return self.sizes.join(ones, "seq_id", "left").select("seq_id", "n_bits", c.alias("count_ones"), (F.col("n_bits") - c).alias("count_zeros"), F.expr("(n_bits + 511) div 512").alias("n_lines"))

    # rank and select

    def rank(self, queries: DataFrame, bit: int = 1) -> DataFrame:
        """(qid, seq_id, i) to (qid, rank); NULL beyond the end, and in an empty sequence."""
        found = prefix_count(queries, self.ones_at, ["seq_id"]).join(self.sizes, "seq_id", "left")
        value = F.col("r") if bit else F.col("i") - F.col("r")
        return found.select("qid", F.when((F.col("n_bits") > 0) & (F.col("i") >= 0) & (F.col("i") <= F.col("n_bits")), value).alias("rank"))

    def select(self, queries: DataFrame, bit: int = 1) -> DataFrame:
        """(qid, seq_id, k) to (qid, pos); NULL where there are fewer.

        A zero is found from the ones: before the k-th zero stand those ones with at most k zeros before them.
        """
        if bit:
            return prefix_select(queries, self.ones_at, ["seq_id"]).select("qid", "pos")
        numbered = occurrence_index(self.ones_at, ["seq_id"], out="_k")
        runs = numbered.groupBy("seq_id", (F.col("pos") - F.col("_k")).alias("pos")).agg(F.count(F.lit(1)).alias("_n"))
        zeros = self.counts().select("seq_id", "count_zeros")
        found = prefix_count(queries.withColumn("i", F.col("k") + 1), runs, ["seq_id"], weight="_n").join(zeros, "seq_id", "left")
        return found.select("qid", F.when((F.col("k") >= 0) & (F.col("k") < F.col("count_zeros")), F.col("k") + F.col("r")).alias("pos"))

    # changes

    def extend_zeros(self, m: int) -> BitSequence:
        return BitSequence(self.ones_at, self.sizes.withColumn("n_bits", F.col("n_bits") + m))

    def append_bits(self, value: int, length: int) -> BitSequence:
        """``length`` bits of ``value`` behind the end, the lowest first."""
        if not 0 <= length <= 64 or value < 0 or value >> length:
            raise ValueError("length must be 0 to 64, and no bit of the value may lie beyond it")
        places = [j for j in range(length) if value >> j & 1]
        ones = self.ones_at
        if places:
            new = self.sizes.select("seq_id", F.explode(F.array(*(F.col("n_bits") + j for j in places))).alias("pos"))
            ones = ones.unionByName(new)
        return BitSequence(ones, self.sizes.withColumn("n_bits", F.col("n_bits") + length))

    def push(self, bit: bool) -> BitSequence:
        return self.append_bits(int(bit), 1)

    def extend(self, more: BitSequence) -> BitSequence:
        """The bits of ``more`` behind those of the same sequence."""
        moved = more.ones_at.join(self.sizes, "seq_id", "left").select("seq_id", (F.col("pos") + F.coalesce("n_bits", _long(0))).alias("pos"))
        sizes = self.sizes.unionByName(more.sizes).groupBy("seq_id").agg(F.sum("n_bits").alias("n_bits"))
        return BitSequence(self.ones_at.unionByName(moved), sizes)

    def extend_positions(self, positions: DataFrame) -> BitSequence:
        """Sets the bits at (seq_id, pos), growing the sequence if need be."""
        new = BitSequence.from_positions(positions)
        sizes = self.sizes.unionByName(new.sizes).groupBy("seq_id").agg(F.max("n_bits").alias("n_bits"))
        return BitSequence(self.ones_at.unionByName(new.ones_at).distinct(), sizes)

    def set(self, updates: DataFrame) -> BitSequence:
        """Writes the bits of (seq_id, pos, bit), positions distinct; one out of range is an error when rows are computed."""
        checked = updates.join(self.sizes, "seq_id", "left").select("seq_id", F.when((F.col("pos") >= 0) & (F.col("pos") < F.col("n_bits")), F.col("pos")).otherwise(F.raise_error(F.lit("position out of range")).cast("bigint")).alias("pos"), "bit")
        kept = self.ones_at.join(updates.select("seq_id", "pos"), ["seq_id", "pos"], "left_anti")
        return BitSequence(kept.unionByName(checked.filter("bit").select("seq_id", "pos")), self.sizes)

    def set_bits(self, index: int, length: int, value: int) -> BitSequence:
        """Writes ``length`` bits at ``index`` in every sequence, the lowest first."""
        if not 0 < length <= 64 or value < 0 or value >> length:
            raise ValueError("length must be 1 to 64, and no bit of the value may lie beyond it")
        each = F.array(*(F.struct(_long(index + j).alias("pos"), F.lit(bool(value >> j & 1)).alias("bit")) for j in range(length)))
        return self.set(self.sizes.select("seq_id", F.explode(each).alias("u")).select("seq_id", "u.pos", "u.bit"))


def negate(values: DataFrame) -> DataFrame:
    """seq_id and pos of the values below the largest that do not occur."""
    return BitSequence.from_positions(values).zeros()


@dataclass(frozen=True)
class SortedSet(BitSequence):
    """A strictly increasing sequence, by its characteristic bits; select(k) is its k-th element."""

    with_select0: bool = False

    @classmethod
    def from_increasing(cls, seq: DataFrame, with_select0: bool = False) -> SortedSet:
        """From (seq_id, pos, sym), sym increasing with pos; otherwise an error when rows are computed."""
        from pyspark.sql import Window

        bucket = F.expr(f"pos div {RUN}")
        before = F.lag("sym").over(Window.partitionBy("seq_id", "_b").orderBy("pos"))
        lasts = seq.filter(F.col("pos") % RUN == RUN - 1).select("seq_id", (bucket + 1).alias("_b"), F.col("sym").alias("_last"))
        placed = seq.withColumn("_b", bucket).withColumn("_before", before).join(lasts, ["seq_id", "_b"], "left")
        checked = placed.withColumn("_before", F.coalesce("_before", "_last")).select("seq_id", F.when(F.col("_before") >= F.col("sym"), F.raise_error(F.lit("not strictly increasing")).cast("bigint")).otherwise(F.col("sym")).alias("pos"))
        return cls(checked, checked.groupBy("seq_id").agg((F.max("pos") + 1).alias("n_bits")), with_select0)

    def select(self, queries: DataFrame, bit: int = 1) -> DataFrame:
        if not bit and not self.with_select0:
            raise ValueError("built without support for select0")
        return super().select(queries, bit)
