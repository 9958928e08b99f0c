import random

import pyarrow as pa
import pytest
from llm_data import rows_of
from pyspark.sql import functions as F

from seqloom.llm import common


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("kind", ["bigint", "string"])
@pytest.mark.parametrize("counted", [None, "n"])
def test_split_join_is_the_join(spark, how, kind, counted, monkeypatch):
    r = random.Random(1)
    keys = [r.choice([7, 7, 7, 8, *range(100, 160)]) for _ in range(600)] + [None] * 5 + [999] * 40  # 7 and 999 are hot; 999 has no row in the table
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key bigint, x bigint").withColumn("key", F.col("key").cast(kind)).repartition(3)
    count = rows.groupBy("key").count().withColumnRenamed("count", "n")
    table = count.filter("key is not null and key <> 999 and key <> 110").select("key", (F.col("n") * 2).alias("double"), F.when(F.col("key") == 8, None).otherwise(F.lit("v")).alias("v"), "n")
    table = table if counted else table.drop("n")
    monkeypatch.setattr(common, "HOT_ONE_IN", 20)
    got = common.split_join(rows, table, "key", len(keys), how, counted)
    assert got.columns == ["key", "x", "double", "v"]
    assert rows_of(got, "x", "key", "double", "v") == rows_of(rows.join(table, "key", how), "x", "key", "double", "v")


def test_slices_are_bounded_by_bytes_and_rows():
    batch = pa.RecordBatch.from_pydict({"t": ["x" * n for n in (10, 10, 5000, 10, 10, 10)]})
    for rows, most in ((2, 1 << 20), (256, 200), (256, 1)):
        parts = list(common.slices(batch, rows, most))
        assert sum((p.column(0).to_pylist() for p in parts), []) == batch.column(0).to_pylist()
        assert all(p.num_rows <= rows and (p.num_rows == 1 or p.nbytes <= most) for p in parts)
