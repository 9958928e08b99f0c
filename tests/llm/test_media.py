import hashlib
import random
import zlib

from llm_data import TEXTS, documents, none_of, rows_of

from seqloom.llm import mpeg
from seqloom.llm import op8_mpeg_audio as op


def test_streams_carry_bytes():
    r = random.Random(1)
    for units in (1, 2, 3, 4, 5, 7, 8, 401):
        payload = r.randbytes(mpeg.UNIT * units)
        s = mpeg.read(mpeg.write(payload, {"n_bytes": "7", "title": "é"}))
        assert b"".join(s.payload) == payload
        assert s.tags == {"n_bytes": "7", "title": "é"}
        assert (len(s.offsets), s.samples) == (-(-units // 4), 1152 * -(-units // 4))
        assert s.vbr_frames == len(s.offsets) and s.vbr_bytes == 240 + sum(s.lengths)
        assert (s.broken, s.skipped, s.checked) == (0, 0, len(s.offsets) + 1)
        assert len(s.toc) == 100 and list(s.toc) == sorted(s.toc)


def test_offsets_are_those_of_frame_headers():
    media = mpeg.write(b"\xff\xfb\x90\x00" * 480, {})
    s = mpeg.read(media)
    assert all(media[o : o + 2] == b"\xff\xfa" and mpeg.header(media[o : o + 4]) for o in s.offsets)
    assert [b - a for a, b in zip(s.offsets, s.offsets[1:])] == s.lengths[:-1]


def test_resynchronises_on_what_is_no_frame():
    clean = mpeg.write(bytes(range(192)) * 8, {})
    junk = b"\x00\xff\xff\xe0noise"
    s = mpeg.read(junk + clean[10:])  # no tag, but noise
    assert b"".join(s.payload) == bytes(range(192)) * 8 and s.skipped == len(junk)
    cut = mpeg.read(clean[:-3])
    assert len(cut.offsets) == 1 and cut.skipped > 0
    old = mpeg.read(clean + b"TAG" + bytes(125))
    assert old.skipped == 0 and len(old.offsets) == 2


def test_a_broken_checksum_is_counted():
    media = bytearray(mpeg.write(bytes(192) * 8, {}))
    s = mpeg.read(bytes(media))
    media[s.offsets[0] + 8] ^= 1  # side information
    assert mpeg.read(bytes(media)).broken == 1


def test_headers_of_other_layers_and_versions():
    h = mpeg.header(bytes((0xFF, 0xFB, 0x90, 0x00)))  # MPEG-1 Layer III, 128 kbit/s, 44.1 kHz
    assert (h.length, h.samples, h.side, h.checked) == (417, 1152, 32, False)
    assert mpeg.header(bytes((0xFF, 0xFB, 0x92, 0x00))).length == 418
    h = mpeg.header(bytes((0xFF, 0xF3, 0x80, 0xC0)))  # MPEG-2 Layer III, 64 kbit/s, 22.05 kHz, mono
    assert (h.length, h.samples, h.side) == (208, 576, 9)
    assert mpeg.header(bytes((0xFF, 0xFF, 0x44, 0x00))).samples == 384  # Layer I
    for bad in (b"\xff\xeb\x90\x00", b"\xff\xfb\xf0\x00", b"\xff\xfb\x9c\x00", b"\xff\xf9\x90\x00", b"\xff\xfb"):
        assert mpeg.header(bad) is None


def test_payloads_that_look_like_a_tag():
    for units in range(1, 9):
        n = mpeg.UNIT * units
        for back in range(3, 130):
            payload = b"a" * (n - back) + b"TAG" + b"b" * (back - 3)
            media = mpeg.write(payload, {"n_bytes": str(n)})
            for stream in (media, media + b"TAG" + bytes(125)):
                s = mpeg.read(stream)
                assert b"".join(s.payload) == payload and (s.skipped, s.broken) == (0, 0)


def test_streams_without_frames_have_defined_values():
    for media in (None, b"", b"no audio", b"TAG" + bytes(125)):
        n, size, _, _, _, _, feature, seconds = op.digest_of(media)
        assert (n, size, seconds) == (None, 0, 0.0) and "frames=0" in feature


def _crc_by_bits(bits):
    c = 0xFFFF
    for b in bits:
        top = c >> 15
        c = c << 1 & 0xFFFF
        if top != b:
            c ^= 0x8005
    return c


def test_checksums_of_layers_one_and_two():
    r = random.Random(3)
    # (second to fourth byte, bits covered behind the checksum for a body of zeros and of ones)
    cases = [((0xFE, 0x44, 0xC0), 128, 128), ((0xFE, 0x44, 0x00), 256, 256), ((0xFE, 0x44, 0x50), 4 * (32 + 8), 4 * (32 + 8)), ((0xFC, 0xA4, 0xC0), 88, 88 + 54)]
    for (b, c, d), zeros, ones in cases:
        head = bytes((0xFF, b, c, d))
        h = mpeg.header(head)
        for body, covered in ((bytes(h.length - 6), zeros), (b"\xff" * (h.length - 6), ones)):
            bits = [x >> 7 - k & 1 for x in head[2:] + body for k in range(8)][: 16 + covered]
            frame = head + _crc_by_bits(bits).to_bytes(2) + body
            assert mpeg.read(frame * 3).checked == 3
            broken = bytearray(frame)
            broken[6 + r.randrange(10)] ^= 0x10
            s = mpeg.read(frame + bytes(broken) + frame)
            assert (s.checked, s.broken) == (2, 1)


def test_a_vbri_table():
    head = bytes((0xFF, 0xFB, 0x90, 0x00))
    frame = (head + bytes(413)).ljust(417, b"\0")
    table = b"VBRI" + (1).to_bytes(2) + bytes(4) + (2000).to_bytes(4) + (7).to_bytes(4) + (3).to_bytes(2) + (1).to_bytes(2) + (2).to_bytes(2) + (1).to_bytes(2) + b"abcdef"
    first = (head + bytes(32) + table).ljust(417, b"\0")
    s = mpeg.read(first + frame * 7)
    assert (s.vbr_frames, s.vbr_bytes, s.toc, len(s.offsets)) == (7, 2000, b"abcdef", 7)


def test_one_pass_gives_what_two_give(spark):
    docs = documents(spark)
    kept = ("doc_id", "n_bytes", "payload_sha256", "media_sha256", "feature", "duration_s")
    assert rows_of(op.stored_digests(docs), *kept) == rows_of(op.digests(op.write_media(docs)), *kept)
    assert op.stored_digests(none_of(docs)).count() == 0


def test_query_on_odd_rows(spark):
    docs = documents(spark)
    want = []
    for i, t in [*enumerate(TEXTS), (len(TEXTS) - 1, TEXTS[-1]), (None, None)]:
        raw = (t or "").encode()
        padded = raw + b" " * (-len(raw) % 192 if raw else 192)
        want.append((i, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:])))
    got = op.digests(op.write_media(docs))
    assert rows_of(got, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == sorted(want, key=lambda r: (r[0] is not None, r[0]))
    stored = {r["doc_id"]: r["media"] for r in op.write_media(docs).collect()}
    for r in got.collect():
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored[r["doc_id"]]), hashlib.sha256(stored[r["doc_id"]]).hexdigest())
    by_text = {}
    for r in got.collect():
        by_text.setdefault(r["payload_sha256"], set()).add((r["media_sha256"], r["feature"]))
    assert all(len(v) <= 2 for v in by_text.values())  # a text and the same text with spaces at its end
    assert op.digests(op.write_media(none_of(docs))).count() == 0


def test_reading_a_media_column(spark):
    df = spark.createDataFrame([(1, bytearray(mpeg.write(b"a" * 384, {"n_bytes": "9"}))), (2, None), (3, bytearray(b"no audio"))], "doc_id bigint, media binary")
    rows = {r["doc_id"]: r for r in op.read_media(df, payload=True).collect()}
    assert rows[1]["payload"] == b"a" * 384 and rows[1]["samples"] == 1152 and rows[1]["tags"] == {"n_bytes": "9"}
    assert rows[2]["n_frames"] == rows[3]["n_frames"] == 0
