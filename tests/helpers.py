"""Answers of single queries, and their definitions in plain Python."""

from seqloom.sources.builders import from_values

Q_RANK = "qid bigint, seq_id bigint, sym bigint, i bigint"


def answers(df, value):
    return [r[value] for r in df.orderBy("qid").collect()]


def ask(spark, kind, operands):
    fields = {"rank": "sym bigint, i bigint", "select": "sym bigint, k bigint", "get": "i bigint", "bit": "k bigint", "range": "l bigint, r bigint", "bits": "index bigint, len bigint"}[kind]
    rows = [(n, 0, *(o if isinstance(o, tuple) else (o,))) for n, o in enumerate(operands)]
    return spark.createDataFrame(rows, f"qid bigint, seq_id bigint, {fields}")


def values(spark, data):
    return from_values(spark, data)


def rank_of(data, c, i, huffman=False):
    if i > len(data) or i < 0 or not data or c > max(data) or c < 0 or (huffman and c not in data):
        return None
    return data[:i].count(c)
