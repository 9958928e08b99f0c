"""Media columns: MPEG audio (operator 8).

``write_media`` stores each whole text as UTF-8, padded by spaces to a positive multiple of 192
bytes, in an MPEG stream (see ``mpeg``). ``read_media`` parses any column of MPEG streams: it
resynchronises on frame headers, reads tags and the variable-bitrate table (Xing, Info or VBRI),
verifies checksums of all three layers, and returns the exact duration (samples and rate) and the offset of every frame to seek to.

A null or empty text is 192 spaces; a null stream reads as an empty one. Repeated rows are
repeated; an empty table gives an empty result. Only the key and the named column are read.
"""

from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from seqloom.llm import common, mpeg


def media_of(text: str | None) -> bytes:
    raw = common.text_of(text).encode("utf-8", "replace")
    return mpeg.write(raw + b" " * (-len(raw) % mpeg.UNIT or (0 if raw else mpeg.UNIT)), {"n_bytes": str(len(raw))})


def write_media(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    schema = T.StructType([df.schema[key], T.StructField("media", T.BinaryType())])
    return common.map_columns(df, [key, text], schema, lambda k, texts: (k, [media_of(t) for t in texts]))


def read_media(df: DataFrame, key: str = "doc_id", media: str = "media", payload: bool = False) -> DataFrame:
    """One row a stream: samples, rate, frame_offsets, checksums and, if asked for, the payload."""
    kinds = [("n_frames", T.LongType()), ("samples", T.LongType()), ("rate", T.LongType()), ("frame_offsets", T.ArrayType(T.LongType())), ("checked", T.LongType()), ("broken", T.LongType()), ("skipped_bytes", T.LongType()), ("tags", T.MapType(T.StringType(), T.StringType())), *([("payload", T.BinaryType())] if payload else [])]
    schema = T.StructType([df.schema[key], *(T.StructField(n, t) for n, t in kinds)])

    def made(keys, streams):
        found = [mpeg.read(s or b"") for s in streams]
        out = [[len(s.offsets) for s in found], [s.samples for s in found], [s.rate for s in found], [s.offsets for s in found], [s.checked for s in found], [s.broken for s in found], [s.skipped for s in found], [list(s.tags.items()) for s in found]]
        return keys, *out, *([[b"".join(s.payload) for s in found]] if payload else [])

    return common.map_columns(df, [key, media], schema, made, rows=64)


VERSIONS = {3: "1", 2: "2", 0: "2.5"}


def feature_of(s: mpeg.Stream) -> str:
    seek = zlib.crc32(b"".join(o.to_bytes(8, "little") for o in s.offsets))
    return f"mpeg{VERSIONS[s.version]}-layer{s.layer} frames={len(s.offsets)} samples={s.samples}/{s.rate} kbps={','.join(map(str, sorted(s.kbps)))} crc={s.checked}/{s.checked + s.broken} vbr={s.vbr_frames},{s.vbr_bytes} toc={zlib.crc32(s.toc):08x} seek={seek:08x}"


_DIGESTS = [("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()), ("duration_s", T.DoubleType())]


def digest_of(media: bytes | None) -> tuple:
    """The contract's columns of one stored stream; without frames the payload is empty and lasts 0 s."""
    media = media or b""
    s = mpeg.read(media)
    payload, n = b"".join(s.payload), s.tags.get("n_bytes", "")
    return int(n) if n.isdecimal() else None, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(s), s.samples / s.rate if s.rate else 0.0


def _digest_columns(df: DataFrame, column: str, stored) -> DataFrame:
    schema = T.StructType([df.schema["doc_id"], *(T.StructField(n, t) for n, t in _DIGESTS)])

    def made(keys, values):
        rows = [digest_of(stored(v)) for v in values]
        return keys, *([r[i] for r in rows] for i in range(len(_DIGESTS)))

    return common.map_columns(df, ["doc_id", column], schema, made, rows=64)


def digests(df: DataFrame) -> DataFrame:
    """The contract's columns of a media column, all from the stored bytes."""
    return _digest_columns(df, "media", lambda m: m)


def stored_digests(df: DataFrame) -> DataFrame:
    """``digests(write_media(df))`` in one pass: no stream leaves the worker that wrote and reads it."""
    return _digest_columns(df, "text", media_of)


def op8_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_digests(common.table(spark, sf_dir, "documents"))
