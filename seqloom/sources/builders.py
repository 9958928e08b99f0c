"""Sequences and bit sequences from tables, lists, texts, positions, words and files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.plans.prefix import dense_positions
from seqloom.sources.scratch import scratch

SEQUENCE = "seq_id bigint, pos bigint, sym bigint"
BITS = "seq_id bigint, pos bigint, bit boolean"


def _bigint(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def sequence(df: DataFrame, pos: str | Column, sym: str | Column, seq_id: str | Column | int = 0) -> DataFrame:
    """seq_id, pos, sym of a table whose ``pos`` is already dense and 0-based."""
    s = F.lit(seq_id) if isinstance(seq_id, int) else seq_id
    return df.select(_bigint(s).alias("seq_id"), _bigint(pos).alias("pos"), _bigint(sym).alias("sym"))


def ordered(df: DataFrame, order: list[str], sym: str | Column, seq_id: str | None = None) -> DataFrame:
    """A sequence from any table and its order; with ``seq_id`` one sequence a value, positions dense in each."""
    if seq_id is None:
        return sequence(dense_positions(df, order, "_pos"), "_pos", sym)
    placed = dense_positions(df, [seq_id, *order], "_pos")
    first = placed.groupBy(seq_id).agg(F.min("_pos").alias("_first"))
    return sequence(placed.join(first, seq_id), F.col("_pos") - F.col("_first"), sym, seq_id)


def from_values(spark: SparkSession, values: Iterable[int], seq_id: int = 0) -> DataFrame:
    rows = [(seq_id, i, int(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, SEQUENCE)


def from_text(df: DataFrame, text: str, seq_id: str) -> DataFrame:
    """Characters of a text column as code points, one sequence a row; nulls and empty texts have none."""
    chars = df.select(_bigint(seq_id).alias("seq_id"), F.posexplode(F.split(text, "")).alias("pos", "c")).filter("c <> ''")
    return chars.select("seq_id", _bigint("pos").alias("pos"), F.ascii("c").cast("bigint").alias("sym"))


def from_bytes(spark: SparkSession, path: str) -> DataFrame:
    """The bytes of files of any size, one sequence a file, by the order of paths.

    Files are read as lines that end at byte 10 only, in splits; a split's place is known, and a line's is the sum of those before
    it in its split. The bytes of a line must fit in a cell.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"), F.col("value").cast("binary").alias("bytes"))
    lines = scratch(lines, "lines")  # splits and lines are numbered once
    files = dense_positions(lines.select("path").distinct(), ["path"], "seq_id").select("path", "seq_id")
    sizes = lines.groupBy("path", "split").agg(F.sum(F.length("bytes") + 1).alias("_n"))
    earlier = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("path", "split", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    before = Window.partitionBy("path", "split").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.withColumn("_in", F.coalesce(F.sum(F.length("bytes") + 1).over(before), F.lit(0))).join(starts, ["path", "split"]).join(files, "path")
    ended = F.concat("bytes", F.when(F.col("_start") + F.col("_in") + F.length("bytes") < F.col("size"), F.unhex(F.lit("0A"))).otherwise(F.unhex(F.lit(""))))
    cells = placed.select("seq_id", (F.col("_start") + F.col("_in")).alias("_first"), ended.alias("bytes")).filter("length(bytes) > 0")
    two = F.expr("transform(sequence(1, length(bytes)), i -> conv(hex(substring(bytes, i, 1)), 16, 10))")
    return cells.select("seq_id", "_first", F.posexplode(two).alias("pos", "c")).select("seq_id", (F.col("_first") + F.col("pos")).alias("pos"), _bigint("c").alias("sym"))


def quads(seq: DataFrame) -> DataFrame:
    """Symbols cut to their two low bits."""
    return seq.withColumn("sym", F.col("sym").bitwiseAND(F.lit(3).cast("bigint")))


def append(seq: DataFrame, more: DataFrame) -> DataFrame:
    """``more``'s positions follow those of the same sequence in ``seq``."""
    value = next(c for c in seq.columns if c not in ("seq_id", "pos"))
    ends = seq.groupBy("seq_id").agg((F.max("pos") + 1).alias("_n"))
    moved = more.join(ends, "seq_id", "left").select("seq_id", (F.col("pos") + F.coalesce("_n", F.lit(0))).alias("pos"), value)
    return seq.select("seq_id", "pos", value).unionByName(moved)


def bits(df: DataFrame, pos: str | Column, bit: str | Column, seq_id: str | Column | int = 0) -> DataFrame:
    """seq_id, pos, bit of a table with a boolean at each dense position."""
    s = F.lit(seq_id) if isinstance(seq_id, int) else seq_id
    b = F.col(bit) if isinstance(bit, str) else bit
    return df.select(_bigint(s).alias("seq_id"), _bigint(pos).alias("pos"), b.cast("boolean").alias("bit"))


def from_words(words: DataFrame, n_bits: DataFrame) -> DataFrame:
    """Ones of packed words (seq_id, w, word), bit j of word w being position 64 w + j, below ``n_bits``.

    ``n_bits`` that the words of a sequence cannot hold are an error when rows are computed.
    """
    held = words.groupBy("seq_id").agg(((F.max("w") + 1) * 64).alias("_held"))
    fits = F.when(F.col("n_bits") <= F.coalesce("_held", F.lit(0)), F.col("n_bits")).otherwise(F.raise_error(F.lit("n_bits is over 64 times the number of words")).cast("bigint"))
    n_bits = n_bits.join(held, "seq_id", "left").select("seq_id", fits.alias("n_bits"))
    each = words.select("seq_id", "w", "word", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("j")).filter("getbit(word, j) = 1")
    return each.join(n_bits, "seq_id").select("seq_id", (F.col("w") * 64 + F.col("j")).alias("pos"), "n_bits").filter("pos < n_bits").drop("n_bits")


def save(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def save_bucketed(seq: DataFrame, name: str, buckets: int = 256) -> None:
    """A table whose joins by seq_id and sym need no shuffle."""
    seq.write.bucketBy(buckets, "seq_id", "sym").sortBy("pos").saveAsTable(name)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a job that wrote ``path`` ended: its last act is the marker."""
    return exists(spark, f"{path.rstrip('/')}/_SUCCESS")


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def load_or_build(spark: SparkSession, path: str, build) -> DataFrame:
    """What is stored whole at ``path``; if nothing is, or a build that died, what ``build()`` gives, stored there."""
    if not complete(spark, path):
        save(build(), path, "overwrite")
    return load(spark, path)
