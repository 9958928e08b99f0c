"""Helpers that the operators of this subpackage share: paths, workers, scratch tables."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.sources.scratch import scratch, shared_dir

__all__ = ["map_columns", "prepare", "scratch", "shared_dir", "slices", "split_join", "table", "text_of"]

ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this repository when the session was not started from it.

    On a cluster without a shared install, ship the package with ``--py-files`` instead.
    """
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *parts])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Keys with over one in so many rows are hot in ``split_join``; there are fewer of them than this.
HOT_ONE_IN = 1000


def split_join(rows: DataFrame, table: DataFrame, key: str, total: int, how: str = "inner", counted: str | None = None) -> DataFrame:
    """``rows.join(table, key, how)``, inner or left, where no task gets a hot key's rows.

    ``table`` has one row a key, ``rows`` has ``total`` rows at most. Under ``HOT_ONE_IN`` keys can have more than one
    in ``HOT_ONE_IN`` of the rows, whatever the data: their rows of ``table`` are broadcast, and their rows are dealt
    by a hash of all columns. ``counted`` names a column of ``table`` with the number of ``rows`` of its key, if there is one.
    """
    others = [c for c in table.columns if c not in (key, counted)]
    if counted:
        hot = table.filter(F.col(counted) * HOT_ONE_IN > total)
    else:
        hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") * HOT_ONE_IN > total).select(key).join(table, key)
    hot = hot.select(F.col(key).alias("_hot"), *(F.col(c).alias(f"_hot_{c}") for c in others))
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    dealt = marked.withColumn("_key", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(F.xxhash64(*rows.columns).cast(rows.schema[key].dataType)))
    plain = table.select(F.col(key).alias("_key"), F.lit(True).alias("_there"), *(F.col(c).alias(f"_own_{c}") for c in others))
    both = dealt.join(plain, "_key", "left")
    if how == "inner":
        both = both.filter("_hot is not null or _there")
    return both.select(*rows.columns, *(F.when(F.col("_hot").isNull(), F.col(f"_own_{c}")).otherwise(F.col(f"_hot_{c}")).alias(c) for c in others))


def text_of(value: str | None) -> str:
    return "" if value is None else value


#: Bytes of a slice that workers turn into Python objects at once; one longer row is a slice of its own.
SLICE_BYTES = 4 << 20


def slices(batch, rows: int, most: int = SLICE_BYTES):
    """``batch`` in slices of at most ``rows`` rows and, above one row, ``most`` bytes."""
    at = 0
    while at < batch.num_rows:
        n = min(rows, batch.num_rows - at)
        while n > 1 and batch.slice(at, n).nbytes > most:
            n //= 2
        yield batch.slice(at, n)
        at += n


def map_columns(df: DataFrame, columns: list[str], schema, fn, rows: int = 256):
    """``fn`` over ``slices`` of at most ``rows`` rows: lists of ``columns`` in, arrays or lists of ``schema``'s columns out.

    The first column is handed through as an Arrow array, so keys of any type survive.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for part in slices(batch, rows):
                out = fn(part.column(0), *(part.column(i).to_pylist() for i in range(1, part.num_columns)))
                arrays = [x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for x, f in zip(out, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.select(*columns).mapInArrow(run, schema)
