"""The query catalogue: Spark queries by name, and the SQL that each must agree with.

Sequences over the given tables: ``ev_user`` (events by event_id, twice the user, so that odd
symbols do not occur), ``ev_type`` and ``ev_err`` (the event's type and whether it is an error),
``ord_cust`` and ``ord_prio`` (orders by key: customer, priority), ``doc_char`` (characters of each
document). Query tables come from ``part``; some of their operands are out of range on purpose.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom import generators
from seqloom.functions import words
from seqloom.model import QuadSequence, Sequence, TextSequence
from seqloom.operators import ranges, transforms
from seqloom.operators.bits import BitSequence, SortedSet, negate
from seqloom.sources import builders
from seqloom.sources.scratch import scratch, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


# Sequences and queries


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ev_user(spark, d, variant: str = "plain") -> Sequence:
    return Sequence(builders.sequence(_table(spark, d, "events"), "event_id", F.col("user_id") * 2), variant)


def ev_err(spark, d) -> BitSequence:
    return BitSequence.from_bits(builders.bits(_table(spark, d, "events"), "event_id", F.col("event_type") == "error"))


def ord_cust(spark, d, variant: str = "plain") -> Sequence:
    return Sequence(builders.sequence(_table(spark, d, "orders"), "o_orderkey", "o_custkey"), variant)


def ord_prio(spark, d) -> QuadSequence:
    return QuadSequence.of(builders.sequence(_table(spark, d, "orders"), "o_orderkey", F.substring("o_orderpriority", 1, 1).cast("bigint") - 1))


def doc_char(spark, d) -> TextSequence:
    return TextSequence.of(_table(spark, d, "documents"), "text", "doc_id")


def _parts(spark, d, **columns: str | Column) -> DataFrame:
    """One query a part: qid, seq_id 0, and expressions over p_partkey (``p``), n and sigma of a joined meta table."""
    p = _table(spark, d, "part").select(F.col("p_partkey").cast("bigint").alias("p"))
    return p.select(F.col("p").alias("qid"), F.lit(0).cast("bigint").alias("seq_id"), *(F.expr(e).cast("bigint").alias(n) for n, e in columns.items()))


def _parts_of(spark, d, meta: DataFrame, **columns: str) -> DataFrame:
    """The same with n (and sigma) of the one sequence in ``meta``: a one-row table."""
    p = _table(spark, d, "part").select(F.col("p_partkey").cast("bigint").alias("p"), F.lit(0).cast("bigint").alias("seq_id"))
    return p.join(F.broadcast(meta), "seq_id").select(F.col("p").alias("qid"), "seq_id", *(F.expr(e).cast("bigint").alias(n) for n, e in columns.items()))


EV = "s AS (SELECT event_id AS pos, user_id * 2 AS sym FROM events)"
OC = "s AS (SELECT o_orderkey AS pos, o_custkey AS sym FROM orders)"
PR = "s AS (SELECT o_orderkey AS pos, (CAST(substr(o_orderpriority, 1, 1) AS BIGINT) - 1) & 3 AS sym FROM orders)"
ER = "b AS (SELECT event_id AS pos, event_type = 'error' AS bit FROM events)"
DC = "s AS (SELECT doc_id AS seq_id, unnest(range(length(text))) AS pos, unnest(list_transform(string_split(text, ''), lambda x: unicode(x))) AS sym FROM documents WHERE text <> '')"
M = "m AS (SELECT count(*) AS n, max(sym) AS sigma FROM s)"
NB = "m AS (SELECT count(*) AS n FROM b)"


def _q(**columns: str) -> str:
    return "q AS (SELECT p AS qid, " + ", ".join(f"CAST({e} AS BIGINT) AS {n}" for n, e in columns.items()) + " FROM (SELECT p_partkey AS p FROM part), m)"


RANK_OPERANDS = {"i": "(p * 7919) % (n + 50)", "sym": "(p * 31) % (sigma + 5)"}
SELECT_OPERANDS = {"k": "p % 90", "sym": "(p * 31) % (sigma + 5)"}
BIT_OPERANDS = {"i": "(p * 7919) % (n + 50)"}
RANGE_OPERANDS = {"l": "(p * 7919) % (n + 50)", "r": "(p * 7919) % (n + 50) + (p * 31) % 400"}


def _rank_sql(seq: str, value: str = "count(s.pos)", i: str = "q.i", most: str = "m.sigma", absent: str = "") -> str:
    return (
        f"WITH {seq}, {M}, {_q(**RANK_OPERANDS)} SELECT q.qid, CAST(CASE WHEN q.i > m.n OR q.sym > {most} {absent} THEN NULL ELSE {value} END AS BIGINT) AS rank "
        f"FROM q CROSS JOIN m LEFT JOIN s ON s.sym = q.sym AND s.pos < {i} GROUP BY q.qid, q.i, q.sym, m.n, m.sigma"
    )


# Access and scans


#: Names of queries on the other variants, and their variants.
SHAPES = {"binary": "plain2", "huffman": "huffman4", "huffman_binary": "huffman2"}


def _on_variants(name: str, sql: str, run) -> None:
    """``name`` on the plain sequence, on those of ``SHAPES``, and on an index that is built first: ``run(spark, d, sequence)``."""
    query(name, sql)(lambda spark, d: run(spark, d, ev_user(spark, d)))
    for shape, variant in SHAPES.items():
        query(f"{name}_{shape}", sql)(lambda spark, d, v=variant: run(spark, d, ev_user(spark, d, v)))
    query(f"{name}_indexed", sql)(lambda spark, d: run(spark, d, ev_user(spark, d).indexed()))


_on_variants("get", f"WITH {EV}, {M}, {_q(i=RANK_OPERANDS['i'])} SELECT q.qid, s.sym FROM q LEFT JOIN s ON s.pos = q.i", lambda spark, d, s: s.get(_parts_of(spark, d, s.meta, i=RANK_OPERANDS["i"])))


@query("get_quad", f"WITH {PR}, {M}, {_q(i=RANK_OPERANDS['i'])} SELECT q.qid, s.sym FROM q LEFT JOIN s ON s.pos = q.i")
def _(spark, d):
    s = ord_prio(spark, d)
    return s.get(_parts_of(spark, d, s.meta, i=RANK_OPERANDS["i"]))


@query("get_bit", f"WITH {ER}, {NB}, {_q(**BIT_OPERANDS)} SELECT q.qid, b.bit FROM q LEFT JOIN b ON b.pos = q.i")
def _(spark, d):
    b = ev_err(spark, d)
    return b.get(_parts_of(spark, d, b.sizes.withColumnRenamed("n_bits", "n"), **BIT_OPERANDS))


def _get_bits_sql(end: str) -> str:
    q = _q(index="(p * 7919) % (n + 50)", len="p % 70")
    return (
        f"WITH {ER}, {NB}, {q} SELECT q.qid, CAST(CASE WHEN q.len < 1 OR q.len > 64 OR q.index + q.len {end} m.n THEN NULL ELSE "
        "coalesce(sum(CASE WHEN NOT b.bit THEN 0 WHEN b.pos - q.index = 63 THEN CAST(-9223372036854775808 AS HUGEINT) ELSE CAST(1 AS HUGEINT) << CAST(b.pos - q.index AS INTEGER) END), 0) END AS BIGINT) AS value "
        "FROM q CROSS JOIN m LEFT JOIN b ON b.pos >= q.index AND b.pos < q.index + q.len AND q.len <= 64 GROUP BY q.qid, q.len, q.index, m.n"
    )


def _get_bits(spark, d, strict: bool):
    b = ev_err(spark, d)
    return b.get_bits(_parts_of(spark, d, b.sizes.withColumnRenamed("n_bits", "n"), index="(p * 7919) % (n + 50)", len="p % 70"), strict)


@query("get_bits", _get_bits_sql(">"))
def _(spark, d):
    return _get_bits(spark, d, False)


@query("get_bits_strict", _get_bits_sql(">="))
def _(spark, d):
    return _get_bits(spark, d, True)


WORDS_SQL = f"WITH {ER} SELECT pos // 64 AS w, CAST(sum(CASE WHEN NOT bit THEN 0 WHEN pos % 64 = 63 THEN CAST(-9223372036854775808 AS HUGEINT) ELSE CAST(1 AS HUGEINT) << (pos % 64) END) AS BIGINT) AS word FROM b"


@query("words", WORDS_SQL + " GROUP BY 1")
def _(spark, d):
    return ev_err(spark, d).words().select("w", "word")


@query("get_word", WORDS_SQL + " WHERE pos // 64 = 3 GROUP BY 1")
def _(spark, d):
    return ev_err(spark, d).get_word(3).select("w", "word")


@query("iter_fwd", f"WITH {EV} SELECT pos, sym FROM s")
def _(spark, d):
    return ev_user(spark, d).iterate().select("pos", "sym")


@query("iter_rev", f"WITH {EV}, {M} SELECT n - 1 - pos AS step, sym FROM s, m")
def _(spark, d):
    s = ev_user(spark, d)
    back = s.iterate(backward=True).join(F.broadcast(s.meta), "seq_id")
    return back.select((F.col("n") - 1 - F.col("pos")).alias("step"), "sym")


for _name, _start in (("ones", 0), ("ones_from", 777)):
    query(_name, f"WITH {ER} SELECT pos FROM b WHERE bit AND pos >= {_start}")(lambda spark, d, s=_start: ev_err(spark, d).ones(s).select("pos"))
for _name, _start in (("zeros", 0), ("zeros_from", 777)):
    query(_name, f"WITH {ER} SELECT pos FROM b WHERE NOT bit AND pos >= {_start}")(lambda spark, d, s=_start: ev_err(spark, d).zeros(s).select("pos"))


@query("into_iter", f"WITH {OC} SELECT pos, sym FROM s")
def _(spark, d):
    return ord_cust(spark, d).extend(builders.from_values(spark, [])).iterate().select("pos", "sym")


@query("iter_quads", f"WITH {PR} SELECT pos, sym FROM s")
def _(spark, d):
    return ord_prio(spark, d).iterate().select("pos", "sym")


@query("iter_bits", f"WITH {ER} SELECT pos, bit FROM b")
def _(spark, d):
    return ev_err(spark, d).dense().select("pos", "bit")


@query("zero_filled", "SELECT CAST(unnest(range((SELECT count(*) FROM events))) AS BIGINT) AS pos, false AS bit")
def _(spark, d):
    return BitSequence.zeros_of(ev_err(spark, d).sizes).dense().select("pos", "bit")


@query("from_values", "SELECT CAST(unnest(range(5)) AS BIGINT) AS pos, CAST(unnest([3, 1, 4, 1, 5]) AS BIGINT) AS sym")
def _(spark, d):
    return builders.from_values(spark, [3, 1, 4, 1, 5]).select("pos", "sym")


@query("equality", "SELECT true AS same, false AS longer_is_same")
def _(spark, d):
    s = ev_user(spark, d)
    return spark.createDataFrame([(s.equals(ev_user(spark, d)), s.equals(s.extend(s.df)))], "same boolean, longer_is_same boolean")


@query("bytes_of_file", "SELECT CAST(unnest(range(length(t))) AS BIGINT) AS pos, CAST(unnest(list_transform(string_split(t, ''), lambda x: unicode(x))) AS BIGINT) AS sym FROM (SELECT string_agg(r_name, chr(10) ORDER BY r_name) || chr(10) AS t FROM region)")
def _(spark, d):
    import uuid

    path = f"{shared_dir(spark)}/seqloom-bytes-{uuid.uuid4().hex}"
    _table(spark, d, "region").select("r_name").coalesce(1).sortWithinPartitions("r_name").write.text(path)
    return builders.from_bytes(spark, path).select("pos", "sym")


# Rank


def _rank(variant: str = "plain", plan: str = "bucketed", of=ev_user):
    def run(spark, d):
        s = of(spark, d, variant)
        return s.rank(_parts_of(spark, d, s.meta, **RANK_OPERANDS), plan)

    return run


_ABSENT = "OR q.sym NOT IN (SELECT sym FROM s)"
query("rank", _rank_sql(EV))(_rank())
query("rank_window", _rank_sql(EV))(_rank(plan="window"))
query("rank_join", _rank_sql(EV))(_rank(plan="join"))
query("rank_binary", _rank_sql(EV))(_rank("plain2"))
query("rank_huffman", _rank_sql(EV, absent=_ABSENT))(_rank("huffman4"))
query("rank_huffman_binary", _rank_sql(EV, absent=_ABSENT))(_rank("huffman2"))
query("rank_indexed", _rank_sql(EV))(lambda spark, d: (s := ev_user(spark, d).indexed()).rank(_parts_of(spark, d, s.meta, **RANK_OPERANDS)))
query("rank_huffman_indexed", _rank_sql(EV, absent=_ABSENT))(lambda spark, d: (s := ev_user(spark, d, "huffman4").indexed()).rank(_parts_of(spark, d, s.meta, **RANK_OPERANDS)))
query("rank_orders", _rank_sql(OC))(_rank(of=ord_cust))


@query("rank_prefetch", _rank_sql(EV))
def _(spark, d):
    s = ev_user(spark, d)
    return s.rank_prefetch(_parts_of(spark, d, s.meta, **RANK_OPERANDS))


@query("rank_quad", _rank_sql(PR, most="3"))
def _(spark, d):
    s = ord_prio(spark, d)
    return s.rank(_parts_of(spark, d, s.meta, **RANK_OPERANDS))


for _block in (256, 512):

    def _run_block(spark, d, block=_block):
        s = ord_prio(spark, d)
        return s.rank_block(_parts_of(spark, d, s.meta, **RANK_OPERANDS), block)

    query(f"rank_block_{_block}", _rank_sql(PR, i=f"q.i - q.i % {_block}", most="3"))(_run_block)


@query("approx_rank", _rank_sql(OC, value="(count(s.pos) // 8) * 8", i="least((q.i // 8) * 8 + 1, m.n)"))
def _(spark, d):
    s = ord_cust(spark, d)
    return s.approx_rank(_parts_of(spark, d, s.meta, **RANK_OPERANDS), 3)


@query("approx_rank_2048", _rank_sql(PR, value="(count(s.pos) // 2048) * 2048", i="least((q.i // 2048) * 2048 + 1, m.n)"))
def _(spark, d):
    s = ord_prio(spark, d)
    return s.approx_rank(_parts_of(spark, d, s.meta, **RANK_OPERANDS))


for _bit, _value in ((1, "count(b.pos)"), (0, "q.i - count(b.pos)")):

    def _run_bit_rank(spark, d, bit=_bit):
        b = ev_err(spark, d)
        return b.rank(_parts_of(spark, d, b.sizes.withColumnRenamed("n_bits", "n"), **BIT_OPERANDS), bit)

    query(
        f"rank{_bit}",
        f"WITH {ER}, {NB}, {_q(**BIT_OPERANDS)} SELECT q.qid, CASE WHEN q.i > m.n THEN NULL ELSE {_value} END AS rank "
        "FROM q CROSS JOIN m LEFT JOIN b ON b.bit AND b.pos < q.i GROUP BY q.qid, q.i, m.n",
    )(_run_bit_rank)


# Select


def _select_sql(seq: str) -> str:
    return f"WITH {seq}, {M}, {_q(**SELECT_OPERANDS)} SELECT q.qid, o.pos FROM q LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY pos) - 1 AS k FROM s) o USING (sym, k)"


_on_variants("select", _select_sql(EV), lambda spark, d, s: s.select(_parts_of(spark, d, s.meta, **SELECT_OPERANDS)))


@query("select_quad", _select_sql(PR))
def _(spark, d):
    s = ord_prio(spark, d)
    return s.select(_parts_of(spark, d, s.meta, **SELECT_OPERANDS))


for _bit in (1, 0):

    def _run_bit_select(spark, d, bit=_bit):
        b = ev_err(spark, d)
        return b.select(_parts_of(spark, d, b.sizes.withColumnRenamed("n_bits", "n"), k=BIT_OPERANDS["i"]), bit)

    query(
        f"select{_bit}",
        f"WITH {ER}, {NB}, {_q(k=BIT_OPERANDS['i'])} SELECT q.qid, o.pos FROM q LEFT JOIN (SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS k FROM b WHERE {'' if _bit else 'NOT '}bit) o USING (k)",
    )(_run_bit_select)


_SET = "WITH b AS (SELECT o_orderkey * 3 AS v FROM orders), m AS (SELECT count(*) AS n FROM b), " + _q(k=BIT_OPERANDS["i"])
_GAPS = "(SELECT CAST(unnest(range((SELECT max(v) FROM b))) AS BIGINT) AS v)"
for _bit, _from in ((1, "b"), (0, f"{_GAPS} WHERE v NOT IN (SELECT v FROM b)")):

    def _run_set_select(spark, d, bit=_bit):
        s = builders.sequence(_table(spark, d, "orders"), "o_orderkey", F.col("o_orderkey") * 3)
        found = SortedSet.from_increasing(s, with_select0=not bit)
        return found.select(_parts_of(spark, d, Sequence(s).meta, k=BIT_OPERANDS["i"]), bit)

    query(f"set_select{'' if _bit else 0}", f"{_SET} SELECT q.qid, o.v AS pos FROM q LEFT JOIN (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k FROM {_from}) o USING (k)")(_run_set_select)


@query("select_sql", f"WITH {EV} SELECT pos FROM s WHERE sym = 20 ORDER BY pos LIMIT 1 OFFSET 3")
def _(spark, d):
    ev_user(spark, d).register("catalog_events")
    return spark.sql("SELECT pos FROM catalog_events_select(20, 3)")


# Ranges and counts


@query("occs_range", f"WITH {EV}, {M} SELECT sym, count(*) AS cnt FROM s WHERE pos >= 100 AND pos < 900 GROUP BY sym")
def _(spark, d):
    return ev_user(spark, d).occs_range(100, 900)


OCCS_SQL = f"WITH {EV}, {M}, {_q(**RANGE_OPERANDS)} SELECT q.qid, s.sym, count(*) AS cnt FROM q JOIN s ON s.pos >= q.l AND s.pos < q.r WHERE q.l <= q.r AND q.r <= (SELECT n FROM m) GROUP BY 1, 2"


_on_variants("occs_range_batch", OCCS_SQL, lambda spark, d, s: s.occs_range_batch(_parts_of(spark, d, s.meta, **RANGE_OPERANDS)))


@query("occs_range_wide", f"WITH {PR}, {M}, {_q(l='p * 3 % 2000', r='n - p % 1500')} SELECT q.qid, s.sym, count(*) AS cnt FROM q JOIN s ON s.pos >= q.l AND s.pos < q.r WHERE q.l <= q.r AND q.r <= (SELECT n FROM m) GROUP BY 1, 2")
def _(spark, d):
    s = ord_prio(spark, d)
    return s.occs_range_batch(_parts_of(spark, d, s.meta, l="p * 3 % 2000", r="n - p % 1500"))


NAIVE_OPERANDS = {"l": "p * 3 % 2000", "r": "n - p % 1500"}


@query("occs_range_naive", f"WITH {PR}, {M}, {_q(**NAIVE_OPERANDS)} SELECT q.qid, s.sym, count(*) AS cnt FROM q JOIN s ON s.pos >= q.l AND s.pos < q.r WHERE q.l <= q.r AND q.r <= (SELECT n FROM m) GROUP BY 1, 2")
def _(spark, d):
    s = ord_prio(spark, d)
    return ranges.occs_range_naive(s.df, _parts_of(spark, d, s.meta, **NAIVE_OPERANDS), s.meta)


@query("range_status", f"WITH {EV}, {M}, {_q(**RANGE_OPERANDS)} SELECT qid, l, r, l <= r AND r <= n AS ok FROM q, m")
def _(spark, d):
    s = ev_user(spark, d)
    return s.range_status(_parts_of(spark, d, s.meta, **RANGE_OPERANDS)).select("qid", "l", "r", "ok")


QUAD_COUNTS = f"WITH {PR}, c AS (SELECT v AS sym, (SELECT count(*) FROM s WHERE s.sym = v) AS occs, (SELECT count(*) FROM s WHERE s.sym < v) AS occs_smaller FROM (SELECT unnest(range(4)) AS v))"


@query("occs", QUAD_COUNTS + " SELECT sym, occs FROM c")
def _(spark, d):
    return ord_prio(spark, d).occs().select("sym", "occs")


@query("occs_smaller", QUAD_COUNTS + " SELECT sym, occs_smaller FROM c")
def _(spark, d):
    return ord_prio(spark, d).occs().select("sym", F.col("occs_smaller").cast("bigint").alias("occs_smaller"))


@query("count_ones", f"WITH {ER} SELECT count(*) AS count_ones FROM b WHERE bit")
def _(spark, d):
    return ev_err(spark, d).counts().select("count_ones")


@query("count_zeros", f"WITH {ER} SELECT count(*) AS count_zeros FROM b WHERE NOT bit")
def _(spark, d):
    return ev_err(spark, d).counts().select("count_zeros")


@query("n_lines", f"WITH {ER} SELECT (count(*) + 511) // 512 AS n_lines FROM b")
def _(spark, d):
    return ev_err(spark, d).counts().select("n_lines")


@query("frequencies", f"WITH {OC} SELECT sym, count(*) AS cnt FROM s GROUP BY sym")
def _(spark, d):
    return ord_cust(spark, d).frequencies().select("sym", "cnt")


@query("doc_char_occs", f"WITH {DC} SELECT seq_id, CAST(sym AS BIGINT) AS sym, count(*) AS cnt FROM s GROUP BY 1, 2")
def _(spark, d):
    return doc_char(spark, d).frequencies()


_DOC_Q = {"i": "(doc_id * 7919) % (n_chars + 9)", "sym": "97 + doc_id % 30"}


@query(
    "doc_char_rank",
    f"WITH {DC}, m AS (SELECT seq_id, count(*) AS n, max(sym) AS sigma FROM s GROUP BY 1), q AS (SELECT doc_id AS qid, {', '.join(f'CAST({e} AS BIGINT) AS {n}' for n, e in _DOC_Q.items())} FROM documents) "
    "SELECT q.qid, CASE WHEN max(m.n) IS NULL OR q.i > max(m.n) OR q.sym > max(m.sigma) THEN NULL ELSE count(s.pos) END AS rank FROM q LEFT JOIN m ON m.seq_id = q.qid LEFT JOIN s ON s.seq_id = q.qid AND s.sym = q.sym AND s.pos < q.i GROUP BY q.qid, q.i, q.sym",
)
def _(spark, d):
    docs = _table(spark, d, "documents")
    q = docs.select(F.col("doc_id").alias("qid"), F.col("doc_id").alias("seq_id"), *(F.expr(e).cast("bigint").alias(n) for n, e in _DOC_Q.items()))
    return doc_char(spark, d).rank(q)


# Metadata


@query(
    "meta",
    f"WITH {EV}, {M} SELECT n AS len, n = 0 AS is_empty, sigma, CAST(ceil(length(bin(sigma)) / 2.0) AS BIGINT) AS levels_quad, CAST(length(bin(sigma)) AS BIGINT) AS levels_bin FROM m",
)
def _(spark, d):
    return ev_user(spark, d).meta.select(F.col("n").alias("len"), (F.col("n") == 0).alias("is_empty"), "sigma", words.n_digits("sigma", 2).alias("levels_quad"), words.n_digits("sigma", 1).alias("levels_bin"))


# Changes


@query("set_bit", f"WITH {ER} SELECT pos, CASE WHEN pos % 7 = 3 THEN pos % 2 = 1 ELSE bit END AS bit FROM b")
def _(spark, d):
    b = ev_err(spark, d)
    updates = b.sizes.select("seq_id", F.explode(F.expr("sequence(3L, n_bits - 1, 7L)")).alias("pos")).withColumn("bit", F.col("pos") % 2 == 1)
    return b.set(updates).dense().select("pos", "bit")


@query("set_bits", f"WITH {ER} SELECT pos, CASE WHEN pos >= 61 AND pos < 67 THEN (42 >> (pos - 61)) & 1 = 1 ELSE bit END AS bit FROM b")
def _(spark, d):
    return ev_err(spark, d).set_bits(61, 6, 42).dense().select("pos", "bit")


@query("append_bits", f"WITH {ER}, {NB} SELECT pos, bit FROM b UNION ALL SELECT n + j, (42 >> j) & 1 = 1 FROM m, (SELECT CAST(unnest(range(9)) AS BIGINT) AS j)")
def _(spark, d):
    return ev_err(spark, d).append_bits(42, 9).dense().select("pos", "bit")


@query("push_bit", f"WITH {ER}, {NB} SELECT pos, bit FROM b UNION ALL SELECT n, true FROM m")
def _(spark, d):
    return ev_err(spark, d).push(True).dense().select("pos", "bit")


@query("extend_zeros", f"WITH {ER}, {NB} SELECT pos, bit FROM b UNION ALL SELECT n + j, false FROM m, (SELECT CAST(unnest(range(33)) AS BIGINT) AS j)")
def _(spark, d):
    return ev_err(spark, d).extend_zeros(33).dense().select("pos", "bit")


@query("extend_bits", f"WITH {ER}, {NB} SELECT pos, bit FROM b UNION ALL SELECT n + pos, bit FROM b, m")
def _(spark, d):
    b = ev_err(spark, d)
    return b.extend(b).dense().select("pos", "bit")


@query("extend_positions", f"WITH {ER} SELECT pos FROM b WHERE bit UNION SELECT p_partkey * 5 FROM part")
def _(spark, d):
    return ev_err(spark, d).extend_positions(_parts(spark, d, pos="p * 5").select("seq_id", "pos")).ones().select("pos")


@query("negate", "WITH v AS (SELECT DISTINCT user_id * 2 AS v FROM events) SELECT j AS pos FROM (SELECT CAST(unnest(range((SELECT max(v) FROM v))) AS BIGINT) AS j) WHERE j NOT IN (SELECT v FROM v)")
def _(spark, d):
    return negate(ev_user(spark, d).df.select("seq_id", F.col("sym").alias("pos"))).select("pos")


@query("from_words", f"WITH {ER} SELECT pos FROM b WHERE bit")
def _(spark, d):
    b = ev_err(spark, d)
    return builders.from_words(b.words(), b.sizes).select("pos")


@query("append_sequence", f"WITH {EV}, {M} SELECT pos, sym FROM s UNION ALL SELECT pos + n, sym FROM s, m")
def _(spark, d):
    s = ev_user(spark, d)
    return s.extend(s.df).df.select("pos", "sym")


@query("ordered_build", "SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS pos, o_custkey AS sym FROM orders")
def _(spark, d):
    return builders.ordered(_table(spark, d, "orders"), ["o_totalprice", "o_orderkey"], "o_custkey").select("pos", "sym")


@query("ordered_many", "SELECT user_id AS seq_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, CAST(length(event_type) AS BIGINT) AS sym FROM events")
def _(spark, d):
    return builders.ordered(_table(spark, d, "events"), ["event_id"], F.length("event_type"), "user_id")


# Transforms


@query("text_remap", "SELECT event_id AS pos, dense_rank() OVER (ORDER BY event_type) - 1 AS code FROM events")
def _(spark, d):
    return transforms.text_remap(_table(spark, d, "events"), "event_type").select(F.col("event_id").alias("pos"), "code")


@query("alphabet", "SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS code FROM (SELECT DISTINCT event_type FROM events)")
def _(spark, d):
    return transforms.alphabet(_table(spark, d, "events"), "event_type")


@query("partition_of_4", f"WITH {OC} SELECT pos, sym, row_number() OVER (ORDER BY (sym >> 2) & 3, pos) - 1 AS new_pos FROM s")
def _(spark, d):
    return transforms.partition_of_4(ord_cust(spark, d).df, 2).select("pos", "sym", F.col("new_pos").cast("bigint").alias("new_pos"))


@query("partition_of_2", f"WITH {OC} SELECT pos, sym, row_number() OVER (ORDER BY (sym >> 3) & 1, pos) - 1 AS new_pos FROM s")
def _(spark, d):
    return transforms.partition_of_2(ord_cust(spark, d).df, 3).select("pos", "sym", F.col("new_pos").cast("bigint").alias("new_pos"))


def _levels_sql(bits: int) -> str:
    base = 1 << bits
    n = f"CAST(ceil(length(bin(sigma)) / {bits}.0) AS BIGINT)"
    back = f"list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(level), lambda j: (sym >> ({bits} * (n_levels - level + j))) & {base - 1})), lambda a, x: a * {base} + x)"
    return (
        f"WITH {EV}, {M}, e AS (SELECT pos, sym, level, n_levels FROM (SELECT s.*, {n} AS n_levels, CAST(unnest(range({n})) AS BIGINT) AS level FROM s, m)) "
        f"SELECT level, row_number() OVER (PARTITION BY level ORDER BY {back}, pos) - 1 AS pos, (sym >> ({bits} * (n_levels - 1 - level))) & {base - 1} AS digit FROM e"
    )


@query("levels_quad", _levels_sql(2))
def _(spark, d):
    return ev_user(spark, d).levels().select("level", F.col("pos").cast("bigint").alias("pos"), "digit")


@query("levels_bin", _levels_sql(1))
def _(spark, d):
    return ev_user(spark, d, "plain2").levels().select("level", F.col("pos").cast("bigint").alias("pos"), "digit")


def _code_sql(bits: int) -> str:
    """CTEs: c (sym, w, len in bits, content) by merging the lightest nodes, ties by age and leaves by symbol first."""
    a = 1 << bits
    return (
        f"WITH RECURSIVE {EV}, f AS (SELECT sym, count(*) AS w FROM s GROUP BY 1), k AS (SELECT count(*) AS n FROM f), "
        f"leaves AS (SELECT w, row_number() OVER (ORDER BY sym) - 1 AS t, [CAST(sym AS BIGINT)] AS m FROM f "
        f"UNION ALL SELECT CAST(0 AS BIGINT), -(n + j), CAST([] AS BIGINT[]) FROM (SELECT n, unnest(range(({a - 1} - (n - 1) % {a - 1}) % {a - 1})) AS j FROM k)), "
        f"h AS (SELECT CAST(count(*) AS BIGINT) AS tick, list_sort(list(struct_pack(w := CAST(w AS BIGINT), t := CAST(t AS BIGINT), m := m))) AS nodes, CAST([] AS BIGINT[]) AS merged FROM leaves "
        f"UNION ALL SELECT tick + 1, list_sort(list_append(nodes[{a + 1}:], struct_pack(w := CAST(list_sum(list_transform(nodes[1:{a}], lambda x: x.w)) AS BIGINT), t := tick + 1, m := flatten(list_transform(nodes[1:{a}], lambda x: x.m))))), "
        f"flatten(list_transform(nodes[1:{a}], lambda x: x.m)) FROM h WHERE len(nodes) > 1), "
        f"l AS (SELECT f.sym, f.w, u.digits FROM f JOIN (SELECT sym, count(*) AS digits FROM (SELECT unnest(merged) AS sym FROM h) GROUP BY 1) u USING (sym)), "
        f"g AS (SELECT d, (SELECT count(*) FROM l WHERE digits = d) AS m, (SELECT count(*) FROM l WHERE digits > d) AS st FROM (SELECT unnest(range(1, (SELECT max(digits) FROM l) + 1)) AS d)), "
        f"r AS (SELECT CAST(0 AS BIGINT) AS d, CAST(0 AS BIGINT) AS lo, CAST(1 AS BIGINT) AS hi UNION ALL SELECT g.d, greatest(lo * {a}, hi * {a} - m - greatest(1, st)), hi * {a} - m FROM r JOIN g ON g.d = r.d + 1), "
        f"c AS (SELECT sym, w, digits * {bits} AS len, hi + m - row_number() OVER (PARTITION BY digits ORDER BY sym) AS content FROM l JOIN r ON r.d = l.digits JOIN g ON g.d = l.digits) "
    )


for _shape, _bits in (("", 2), ("_bin", 1)):
    _variant, _of = {2: "huffman4", 1: "huffman2"}[_bits], f"len // {_bits}"

    @query(f"huffman_lengths{_shape}", _code_sql(_bits) + "SELECT sym, CAST(len AS INTEGER) AS len FROM c")
    def _(spark, d, v=_variant):
        return ev_user(spark, d, v).codes().select("sym", "len")

    @query(f"huffman_codes{_shape}", _code_sql(_bits) + "SELECT sym, CAST(content AS BIGINT) AS content FROM c")
    def _(spark, d, v=_variant):
        return ev_user(spark, d, v).codes().select("sym", "content")

    @query(f"huffman_levels{_shape}", _code_sql(_bits) + f"SELECT level, CAST(sum(w) AS BIGINT) AS n FROM (SELECT w, CAST(unnest(range({_of})) AS BIGINT) AS level FROM c) GROUP BY 1")
    def _(spark, d, v=_variant, bits=_bits):
        s = ev_user(spark, d, v)
        return transforms.level_lengths(s.df, s.codes(), bits).select("level", "n")

    @query(f"huffman_cost{_shape}", _code_sql(_bits) + "SELECT CAST(sum(w * len) AS BIGINT) AS bits FROM c")
    def _(spark, d, v=_variant):
        s = ev_user(spark, d, v)
        return transforms.huffman_cost(s.df, s.codes()).select("bits")

    @query(f"huffman_n_levels{_shape}", _code_sql(_bits) + f"SELECT CAST(max({_of}) AS BIGINT) AS n_levels FROM c")
    def _(spark, d, v=_variant):
        return ev_user(spark, d, v).n_levels().select("n_levels")

    @query(f"space_huffman{_shape}", _code_sql(_bits) + "SELECT CAST(round(sum(w * len) * 1.125) AS BIGINT) AS bits FROM c")
    def _(spark, d, v=_variant):
        return ev_user(spark, d, v).space().select("bits")

    _digit = f"(content >> CAST(len - {_bits} * (level + 1) AS INTEGER)) & {(1 << _bits) - 1}"
    _back = f"list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(level), lambda j: (content >> CAST(len - {_bits} * (level - j) AS INTEGER)) & {(1 << _bits) - 1})), lambda a, x: a * {1 << _bits} + x)"

    @query(
        f"huffman_level_contents{_shape}",
        _code_sql(_bits) + f", e AS (SELECT pos, content, len, CAST(unnest(range({_of})) AS BIGINT) AS level FROM (SELECT s.pos, c.* FROM s JOIN c USING (sym))) SELECT level, row_number() OVER (PARTITION BY level ORDER BY {_back}, pos) - 1 AS pos, CAST({_digit} AS BIGINT) AS digit FROM e".lstrip(),
    )
    def _(spark, d, v=_variant):
        return ev_user(spark, d, v).levels().select("level", F.col("pos").cast("bigint").alias("pos"), "digit")

    for _shift in (_bits, 2 * _bits):

        @query(
            f"partition_with_codes{_shape}{'' if _shift == _bits else '_second'}",
            _code_sql(_bits) + f"SELECT pos, sym, row_number() OVER (ORDER BY CASE WHEN len <= {_shift} THEN {1 << _bits} ELSE (content >> CAST(len - {_shift} AS INTEGER)) & {(1 << _bits) - 1} END, pos) - 1 AS new_pos FROM (SELECT s.pos, s.sym, c.len, c.content FROM s JOIN c USING (sym))",
        )
        def _(spark, d, v=_variant, shift=_shift, bits=_bits):
            s = ev_user(spark, d, v)
            return transforms.partition_with_codes(s.df, s.codes(), shift, bits).select("pos", "sym", F.col("new_pos").cast("bigint").alias("new_pos"))


@query("huffman_decode", f"WITH {EV} SELECT pos, sym FROM s")
def _(spark, d):
    s = ev_user(spark, d, "huffman4")
    codes = scratch(s.codes(), "codes")
    return transforms.decode(s.df.join(codes, ["seq_id", "sym"]).drop("sym"), codes).select("pos", "sym")


@query("space_plain", f"WITH {EV}, {M} SELECT CAST(round(n * 2 * ceil(length(bin(sigma)) / 2.0) * 1.125) AS BIGINT) AS bits FROM m")
def _(spark, d):
    return ev_user(spark, d).space().select("bits")


@query("save_load", f"WITH {EV} SELECT pos, sym FROM s")
def _(spark, d):
    import uuid

    path = f"{shared_dir(spark)}/seqloom-saved-{uuid.uuid4().hex}"
    builders.load_or_build(spark, path, lambda: ev_user(spark, d).df)
    return builders.load_or_build(spark, path, None).select("pos", "sym")


# Scalar functions

PK = "FROM part"


@query("msb", f"SELECT p_partkey AS v, CAST(length(bin(p_partkey * 977)) - 1 AS BIGINT) AS msb {PK}")
def _(spark, d):
    return _table(spark, d, "part").select(F.col("p_partkey").alias("v"), words.msb(F.col("p_partkey") * 977).alias("msb"))


_SELECT_ARGS = "p_partkey * 2654435761 AS w, p_partkey % 20 AS k"


@query(
    "select_in_word",
    f"SELECT v, CAST(coalesce(list_filter(range(63), lambda x: (w >> x) & 1 = 1)[k + 1], 64) AS BIGINT) AS place FROM (SELECT p_partkey AS v, {_SELECT_ARGS} {PK})",
)
def _(spark, d):
    args = _table(spark, d, "part").selectExpr("p_partkey AS v", *_SELECT_ARGS.split(", "))
    return args.select("v", words.select_in_word("w", "k").alias("place"))


@query("select_in_word_sql", ORACLES["select_in_word"])
def _(spark, d):
    words.register(spark)
    args = _table(spark, d, "part").selectExpr("p_partkey AS v", *_SELECT_ARGS.split(", "))
    return args.selectExpr("v", "seq_select_in_word(w, k) AS place")


_WIDE_ARGS = "p_partkey * 2654435761 AS lo, p_partkey * 40503 AS hi, p_partkey % 40 AS k"


@query(
    "select_in_word_128",
    "SELECT v, CAST(coalesce(list_concat(list_filter(range(63), lambda x: (lo >> x) & 1 = 1), list_transform(list_filter(range(63), lambda x: (hi >> x) & 1 = 1), lambda x: x + 64))[k + 1], 128) AS BIGINT) AS place "
    f"FROM (SELECT p_partkey AS v, {_WIDE_ARGS} {PK})",
)
def _(spark, d):
    args = _table(spark, d, "part").selectExpr("p_partkey AS v", *_WIDE_ARGS.split(", "))
    return args.select("v", words.select_in_word_128("lo", "hi", "k").alias("place"))


@query("popcnt_wide", f"SELECT p_partkey AS v, CAST(bit_count(p_partkey) + bit_count(p_partkey * 977) AS BIGINT) AS ones {PK}")
def _(spark, d):
    w = F.array(F.col("p_partkey"), F.col("p_partkey") * 977, F.col("p_partkey") * 31)
    return _table(spark, d, "part").select(F.col("p_partkey").alias("v"), words.popcnt_wide(w, 2).alias("ones"))


@query("digits", f"SELECT p_partkey AS v, (p_partkey >> 4) & 3 AS digit {PK}")
def _(spark, d):
    return _table(spark, d, "part").select(F.col("p_partkey").alias("v"), words.digit("p_partkey", 4).alias("digit"))


# Generated inputs: what must hold of them, since their values are the generator's own


def _holds(spark, of: DataFrame, **checks) -> DataFrame:
    return of.agg(*(F.coalesce(c, F.lit(True)).alias(n) for n, c in checks.items()))


@query("generated_sequence", "SELECT true AS dense, true AS below_sigma, true AS repeatable")
def _(spark, d):
    s = generators.gen_sequence(spark, 5000, 40)
    same = s.exceptAll(generators.gen_sequence(spark, 5000, 40)).isEmpty()
    return _holds(spark, s, dense=(F.countDistinct("pos") == 5000) & (F.max("pos") == 4999), below_sigma=(F.min("sym") >= 0) & (F.max("sym") < 40), repeatable=F.lit(same))


@query("generated_queries", "SELECT true AS positions, true AS ranges, true AS pairs")
def _(spark, d):
    q = generators.gen_queries(spark, 700, 90).select("qid", "i")
    every = q.join(generators.gen_range_queries(spark, 700, 90).drop("seq_id"), "qid").join(generators.gen_pairs(spark, 700, 7, 9), "qid")
    return _holds(spark, every, positions=(F.min("i") >= 0) & (F.max("i") < 90), ranges=F.expr("min(l) >= 0 and max(r) <= 90 and bool_and(l <= r)"), pairs=F.expr("min(least(a, b)) >= 0 and max(a) < 7 and max(b) < 9"))


@query("generated_rank_select", "SELECT true AS rank_symbols_occur, true AS select_has_answers")
def _(spark, d):
    s = Sequence(scratch(generators.gen_sequence(spark, 5000, 40), "generated"))
    ranks = s.rank(generators.gen_rank_queries(s.df, 300, 5000)).agg(F.count("rank").alias("n"))
    found = s.select(generators.gen_select_queries(s.df, 300, 5000)).agg(F.count("pos").alias("m"))
    return ranks.join(found).select((F.col("n") == 300).alias("rank_symbols_occur"), (F.col("m") == 300).alias("select_has_answers"))


@query("generated_increasing", "SELECT true AS increasing, true AS below_most")
def _(spark, d):
    s = generators.gen_increasing(spark, 3000, 9000)
    ok = SortedSet.from_increasing(s).ones_at.agg(F.sum("pos")).first()[0] > 0  # an error where it is not increasing
    return _holds(spark, s, increasing=F.lit(ok), below_most=(F.min("sym") >= 0) & (F.max("sym") < 9000))


@query("timing", "SELECT CAST(3 AS BIGINT) AS runs, true AS ordered")
def _(spark, d):
    q = _table(spark, d, "part").count()
    timing = generators.Timing(q)
    for _ in range(3):
        timing.measure(lambda: ev_user(spark, d).frequencies().count())
    told = timing.summary()
    return spark.createDataFrame([(len(timing.runs), told["min"] <= told["avg"] <= told["max"])], "runs bigint, ordered boolean")
