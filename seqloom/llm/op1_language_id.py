"""Language identification by a bidirectional recurrent network over bytes (operator 1).

The network (``gru``) is trained on the driver from a bounded sample of documents that are not held
out (those whose crc32 of the id as text is 2 modulo 4 are never learned from; nor are rows without id, text or
language): of each language, however rare, the ``PER_LANGUAGE`` windows of ``WINDOW`` characters
that come first by a hash, and of many languages ``SAMPLE`` in equal parts, one each at least. It then labels every
byte of every whole text, and a document's probabilities are the mean of those at its bytes.

``lang_pred`` is ``und`` with score 0 for null texts, texts without a letter, and all texts if there
was nothing to learn from. Repeated rows are repeated; an empty table gives an empty result. Only
doc_id, text and lang are read, and lang only for training.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.llm import common, gru

#: Training windows of a language, and of all languages together, at most; only one a language may exceed the second.
PER_LANGUAGE, SAMPLE = 1000, 40_000
WINDOW = 256
#: Languages up to which their counts are broadcast.
FEW_LANGUAGES = 100_000
UNDETERMINED = "und"


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def training_rows(docs: DataFrame, per_language: int = PER_LANGUAGE, total: int = SAMPLE) -> list:
    """(lang, window) of a sample whose size does not grow with the table.

    A hash leaves some four times the rows that are wanted of each language, and ranks are cut off in every task before
    rows are shuffled (an id with any number of rows has one hash): a language with most rows overloads no task.
    """
    usable = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    languages, rows = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not languages:
        return []
    most = max(1, min(per_language, total // languages))
    start = 1 + F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.length("text") - WINDOW + 1, F.lit(1)))
    windows = usable.select("lang", F.substr("text", start.cast("int"), F.lit(WINDOW)).alias("window"), F.xxhash64("doc_id", "text").alias("order"))
    table = counts.withColumn("count", F.col("n"))
    known = windows.join(F.broadcast(table), "lang") if languages <= FEW_LANGUAGES else common.split_join(windows, table, "lang", rows, counted="count")
    likely = known.filter(F.pmod("order", F.lit(1 << 40)) / (1 << 40) * F.col("n") <= 4 * most + 100)  # so tasks pass on few of a frequent language
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("order", "window"))
    chosen = likely.select("lang", "window", F.pmod("order", F.lit(1 << 40)).alias("order")).withColumn("rank", rank).filter(F.col("rank") <= most)
    return sorted((r["lang"], r["window"]) for r in chosen.select("lang", "window").collect())


def learn(docs: DataFrame) -> gru.Network | None:
    rows = training_rows(docs)
    return gru.train([p for _, p in rows], [x for x, _ in rows]) if rows else None


def pooled(net: gru.Network | None, texts: list[str | None]):
    """Places of the texts that have a letter, and their probabilities: those of the learned languages, then that of none."""
    known = [i for i, t in enumerate(texts) if net is not None and t and any(map(str.isalpha, t))]
    return known, gru.pooled(net, [texts[i].encode("utf-8", "replace") for i in known]) if known else None


def predict(net: gru.Network | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Languages and scores of whole texts; a score is the language's share among the learned ones."""
    langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    known, found = pooled(net, texts)
    if known:
        found = found[:, : len(net.labels)]
        shares = found.max(axis=1) / found.sum(axis=1).clip(1e-9)
        for i, best, score in zip(known, found.argmax(axis=1).tolist(), shares.tolist(), strict=True):
            langs[i], scores[i] = net.labels[best], min(1.0, max(0.0, round(score, 4)))
    return langs, scores


def in_learned(net: gru.Network | None, texts: list[str | None]) -> list[bool]:
    """Whether a whole text has letters and is likelier in its best learned language than in none."""
    out = [False] * len(texts)
    known, found = pooled(net, texts)
    if known:
        n = len(net.labels)
        for i, ok in zip(known, (found[:, :n].max(axis=1) >= found[:, n]).tolist(), strict=True):
            out[i] = ok
    return out


def identify(docs: DataFrame, net: gru.Network | None) -> DataFrame:
    """doc_id, lang_pred and score of each row."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return common.map_columns(docs, ["doc_id", "text"], schema, lambda keys, texts: (keys, *predict(net, texts)))


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is in a learned language, all their columns."""
    net = learn(docs)

    @F.pandas_udf("boolean")
    def known(text):
        import pandas as pd

        return pd.Series([k for at in range(0, len(text), 256) for k in in_learned(net, list(text[at : at + 256]))], dtype="bool")

    return docs.filter(known(F.col("text")))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = identify(docs, learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
