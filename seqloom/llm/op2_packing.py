"""Best-fit packing with bound-certified repacking (operator 2).

1. Each whole text becomes ids, plus one end id; only longer ones are cut into pieces of at most
   ``limit`` ids, the first of which may be shorter. What is left of a document after its full
   pieces is its first piece.
2. Pieces go to partitions of about ``per_partition`` rows by a hash. Each partition runs best-fit
   decreasing and computes lower bounds by dual-feasible functions, in every round and at every size. Where the
   bound meets the number of bins, the partition is certified and done.
3. Of a partition with a gap, full bins stay; documents in bins with room are exchanged: they
   go to new partitions with those of other partitions, where best-fit decreasing runs again.
   After ``rounds`` rounds, or where a single partition is left, all bins stay.

Each piece says with what it was packed last: ``partition_bins`` and ``partition_bound`` of that partition, and
``certified``, whether no packing of it needs fewer bins; a gap that rounds left over is there to be read.

A null text is the empty text (only the end id). Repeated rows are packed as often as they occur,
a null ``doc_id`` stays null; an empty table gives no rows. Only ``doc_id`` and ``text`` are read.
Hot keys do not matter: rows are dealt by a hash of document, piece and row number.
"""

from __future__ import annotations

import zlib
from array import array

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.llm import byte_bpe, common

LIMIT = 1024
END_ID = 2
PER_PARTITION = 40_000
ROUNDS = 3


def pieces(docs: DataFrame, limit: int = LIMIT, end_id: int = END_ID, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32."""
    json = json_path or public_tokenizers.path("byte_bpe_50k.json")
    ranks = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    end = end_id.to_bytes(4, "little")
    kinds = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())]
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, t) for n, t in kinds)])

    def made(keys, texts):
        import pyarrow as pa

        encode = byte_bpe.library_encoder(ranks, json)
        row, piece, start, length, crc = [], [], [], [], []
        for r, t in enumerate(texts):
            ids = array("I", encode(common.text_of(t))).tobytes() + end
            n = len(ids) // 4
            first = n % limit or limit
            at, k, view = 0, 0, memoryview(ids)
            while at < n:
                to = min(n, at + (limit if k else first))
                row.append(r)
                piece.append(k)
                start.append(at)
                length.append(to - at)
                crc.append(zlib.crc32(view[4 * at : 4 * to]))
                at, k = to, k + 1
        return keys.take(pa.array(row, pa.int64())), piece, start, length, crc

    return common.map_columns(docs, ["doc_id", "text"], schema, made)


def best_fit_decreasing(lengths: list[int], limit: int = LIMIT) -> list[tuple[int, int]]:
    """(bin, offset) of each length; longest first, each into the fullest bin with room, ties in the order given."""
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    free: list[list[int]] = [[] for _ in range(limit + 1)]
    rooms, bins = 0, 0  # bit r of rooms: some bin has r ids of room
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                rooms &= ~(1 << room)
        else:
            room, b = limit, bins
            bins += 1
        out[i] = (b, limit - room)
        if room > n:
            free[room - n].append(b)
            rooms |= 1 << (room - n)
    return out


def lower_bound(lengths: list[int], limit: int = LIMIT) -> int:
    """The best of dual-feasible functions' bounds on the number of bins.

    Plain sum; for each threshold t up to half, the function that takes lengths over limit - t as
    whole bins and those under t as nothing; and for k from 1 to 40, rounding down to k-ths
    (lengths that are exact multiples of limit / (k + 1) keep their value).
    """
    count = [0] * (limit + 1)
    for n in lengths:
        count[n] += 1
    total = sum(n * c for n, c in enumerate(count))
    best = -(-total // limit)
    large, middle = 0, total  # lengths over limit - t; the sum of those from t to limit - t
    for t in range(1, limit // 2 + 1):
        large += count[limit - t + 1]
        middle -= count[limit - t + 1] * (limit - t + 1) + count[t - 1] * (t - 1)
        best = max(best, large + -(-middle // limit))
    sizes = [(n, c) for n, c in enumerate(count) if c]
    for k in range(1, 41):
        scaled = sum(c * (n * k if n * (k + 1) % limit == 0 else (n * (k + 1) // limit) * limit) for n, c in sizes)
        best = max(best, -(-scaled // (k * limit)))
    return best


def _deal(df: DataFrame, n: int, seed: int) -> DataFrame:
    """To n partitions by a hash; equal rows are told apart by ``row``."""
    return df.withColumn("part", F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(n)).cast("int")).repartition(n, "part")


def _packed(rows: DataFrame, limit: int, last: bool, base: int) -> DataFrame:
    """Best-fit decreasing in each partition: bin, offset, the partition's bins and bound, and whether the row stays."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    names = ["row", "length", "sequence_id", "offset", "partition_bins", "partition_bound"]
    schema = T.StructType([*(T.StructField(n, T.LongType()) for n in names), T.StructField("certified", T.BooleanType()), T.StructField("stays", T.BooleanType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        import numpy as np

        columns = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches if b.num_rows]
        if not columns:
            return
        parts, rows, lengths = (np.concatenate([c[i] for c in columns]) for i in range(3))
        order = np.lexsort((rows, -lengths, parts))
        parts, rows, lengths = parts[order], rows[order], lengths[order]
        edges = np.flatnonzero(np.diff(parts)) + 1
        for a, z in zip([0, *edges.tolist()], [*edges.tolist(), len(parts)], strict=True):
            mine = lengths[a:z].tolist()
            placed = np.array(best_fit_decreasing(mine, limit), dtype=np.int64).reshape(-1, 2)
            used = np.bincount(placed[:, 0], weights=mine).astype(np.int64)
            bound = lower_bound(mine, limit)
            certified, every = len(used) == bound, np.ones(z - a, dtype=np.int64)
            stays = every > 0 if certified or last else used[placed[:, 0]] == limit
            ids = base + (int(parts[a]) << 24) + placed[:, 0]
            columns = [rows[a:z], lengths[a:z], ids, placed[:, 1], every * len(used), every * bound, (every > 0) & certified, stays]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return rows.select("part", "row", "length").mapInArrow(run, schema)


def pack(piece_rows: DataFrame, limit: int = LIMIT, per_partition: int = PER_PARTITION, rounds: int = ROUNDS) -> DataFrame:
    """``piece_rows`` with sequence_id, offset, partition_bins, partition_bound and certified.

    ``per_partition`` bounds the rows that a task holds (three integers each), at any input size.
    Row numbers make repeated rows distinct; they are stored before they are used.
    """
    stored = common.scratch(piece_rows.withColumn("row", F.monotonically_increasing_id()), "pieces")
    todo, done = stored.select("row", "length"), None
    for k in range(rounds):
        n = todo.count()
        if not n and done is not None:
            break
        parts = max(1, -(-n // per_partition))
        last = k == rounds - 1 or parts == 1
        step = common.scratch(_packed(_deal(todo, parts, k), limit, last, k << 56), "packed")
        kept = step.filter("stays").drop("stays", "length")
        done = kept if done is None else done.unionByName(kept)
        if last:
            break
        todo = step.filter("not stays").select("row", "length")
    return stored.join(done, "row").drop("row")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(common.table(spark, sf_dir, "documents")))
