import hashlib
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import mpeg_audio as m


@given(st.binary(max_size=5000))
@settings(max_examples=60, deadline=None)
def test_round_trip_is_lossless(raw):
    media = m.encode_stream(m.pad(raw))
    parsed = m.parse_stream(media)
    assert m.read_payload(media, parsed) == m.pad(raw)
    assert parsed["crc_bad"] == 0 and parsed["skipped"] == 0
    assert parsed["vbr_frames"] == parsed["frames"] == len(parsed["offsets"])
    assert parsed["samples"] == 1152 * parsed["frames"]


def test_every_offset_is_a_frame_header():
    media = m.encode_stream(bytes(20_000))
    for at in m.parse_stream(media)["offsets"]:
        assert m.header(media[at : at + 4]).length > 0


def test_damage_is_found_and_passed_over():
    media = bytearray(m.encode_stream(bytes(10_000)))
    offsets = m.parse_stream(bytes(media))["offsets"]
    media[offsets[3] + 8] ^= 1  # in the protected side information
    media[offsets[5] : offsets[5]] = b"\xff\xfb\x00junk"
    parsed = m.parse_stream(bytes(media))
    assert parsed["crc_bad"] == 1
    assert parsed["frames"] == len(offsets)
    assert parsed["skipped"] == 7


def test_no_media():
    for data in (None, b"", b"\xff" * 500, b"not audio"):
        assert m.parse_stream(data)["frames"] == 0


def test_frames_of_other_versions():
    h = m.header(bytes([0xFF, 0xFB, 0x90, 0x00]))  # MPEG-1, 128 kbit/s, 44.1 kHz
    assert (h.length, h.samples, h.rate) == (417, 1152, 44100)
    h = m.header(bytes([0xFF, 0xF3, 0x40, 0xC0]))  # MPEG-2, 32 kbit/s, 22.05 kHz
    assert (h.length, h.samples, h.rate) == (104, 576, 22050)


def test_query_over_edge_rows(spark):
    rows = [(1, "abc"), (1, "abc"), (2, None), (3, ""), (None, "é" * 5000), (5, "x" * 64)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as frames", "2 as feature")
    got = m.payload_audio(df).collect()
    assert len(got) == 6
    by = {r.doc_id: r for r in got}
    for doc, text in rows:
        raw = m.pad((text or "").encode())
        r = by[doc]
        assert r.payload_sha256 == hashlib.sha256(raw).hexdigest()
        assert r.tail_crc32 == zlib.crc32(raw[-64:])
        assert (r.n_bytes if r.n_bytes < r.payload_bytes else None, r.payload_bytes) in (
            (len((text or "").encode()), len(raw)), (None, len(raw)))
        assert r.n_bytes == len((text or "").encode())


def test_audio_columns(spark):
    df = spark.createDataFrame([(1, bytearray(m.encode_stream(bytes(3000)))), (2, None)], "k long, media binary")
    got = {r.k: r.audio for r in m.audio_columns(df, keep=("k",)).collect()}
    assert got[1].frames == 4 and got[1].duration_ms == 96.0 and len(got[1].frame_offsets) == 4
    assert got[1].tags["payload_bytes"] == "3000"
    assert got[2].frames == 0 and got[2].duration_ms == 0.0


def test_empty_table(spark):
    assert m.payload_audio(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tags_of_both_versions():
    from tidemark.llm.mpeg_audio import _tag_fields

    def tag(version, frames):
        body = b"".join(frames) + bytes(20)
        n = len(body)
        return b"ID3" + bytes([version, 0, 0, n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + body

    plain = lambda n: n.to_bytes(4, "big")
    safe = lambda n: bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])
    for version, sized in ((3, plain), (4, safe)):
        long = b"\x03note\0" + b"x" * 300
        wide = b"\x01" + "Straße".encode("utf-16")
        data = tag(version, [b"TXXX" + sized(len(long)) + b"\0\0" + long, b"TIT2" + sized(len(wide)) + b"\0\0" + wide, b"COMM" + sized(3) + b"\0\0abc"])
        end, fields = _tag_fields(data + b"rest")
        assert end == len(data) and fields == {"note": "x" * 300, "TIT2": "Straße"}
    assert _tag_fields(b"ID3") == (0, {}) and _tag_fields(b"") == (0, {})


def frame(index=9, body=b""):
    """One MPEG-1 frame at 48 kHz, mono, without a checksum."""
    head = (0x7FF << 21 | 3 << 19 | 1 << 17 | 1 << 16 | index << 12 | 1 << 10 | 3 << 6).to_bytes(4, "big")
    return (head + bytes(17) + body).ljust(3 * m.BITRATES_V1[index], b"\0")


def safe(n):
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def text_frame(name, value, flags=b"\0\0", eight=False, packed=None):
    body = packed if packed is not None else b"\x03" + value
    return name + (len(body).to_bytes(4, "big") if eight else safe(len(body))) + flags + body


def test_foreign_tags():
    sound = frame() * 3
    plain = text_frame(b"TIT2", b"song")
    cases = {
        "extended 2.4": (b"ID3\x04\0\x40", safe(6) + b"\x01\0" + plain, b""),
        "extended 2.3": (b"ID3\x03\0\x40", (6).to_bytes(4, "big") + bytes(6) + text_frame(b"TIT2", b"song", eight=True), b""),
        "footer": (b"ID3\x04\0\x10", plain, b"3DI\x04\0\x10" + safe(len(plain))),
        "unsynchronised 2.3": (b"ID3\x03\0\x80", text_frame(b"TIT2", b"song", eight=True) + b"PRIV\0\0\0\x02\0\0\xff\0\xe0", b""),
        "unsynchronised frame": (b"ID3\x04\0\0", text_frame(b"PRIV", b"", b"\0\x02", packed=b"\xff\0\xe0") + plain, b""),
        "compressed": (b"ID3\x04\0\0", text_frame(b"TIT2", b"", b"\0\x09", packed=safe(5) + zlib.compress(b"\x03song")), b""),
        "encrypted before": (b"ID3\x04\0\0", text_frame(b"TPE1", b"", b"\0\x04", packed=b"\x01secret") + plain, b""),
    }
    for name, (head, body, footer) in cases.items():
        parsed = m.parse_stream(head + safe(len(body)) + body + footer + sound)
        assert parsed["fields"] == {"TIT2": "song"}, name
        assert (parsed["frames"], parsed["skipped"]) == (3, 0), name
    old = b"TT2" + (5).to_bytes(3, "big") + b"\0song" + b"TXX" + (4).to_bytes(3, "big") + b"\0a\0b"
    assert m.parse_stream(b"ID3\x02\0\0" + safe(len(old)) + old + sound)["fields"] == {"TT2": "song", "a": "b"}
    closing = b"TAG" + b"Title".ljust(30, b"\0") + b"Artist".ljust(30) + bytes(30) + b"1999" + b"note".ljust(28, b"\0") + b"\0\x07\x11"
    parsed = m.parse_stream(sound + closing)
    assert parsed["fields"] == {"v1:title": "Title", "v1:artist": "Artist", "v1:year": "1999", "v1:comment": "note", "v1:track": "7"} and parsed["frames"] == 3


def test_tables_of_other_encoders():
    lame = b"Info" + (1 | 8).to_bytes(4, "big") + (4).to_bytes(4, "big") + bytes(4) + b"LAME3.100" + bytes(12) + (576 << 12 | 1234).to_bytes(3, "big")
    parsed = m.parse_stream(frame(body=lame) + frame() * 4)
    assert (parsed["vbr_frames"], parsed["delay"], parsed["padding"], parsed["frames"]) == (4, 576, 1234, 4)
    assert parsed["played"] == 4 * 1152 - 576 - 1234
    vbri = bytes(15) + b"VBRI" + b"\0\x01" + (288).to_bytes(2, "big") + bytes(2) + (999).to_bytes(4, "big") + (4).to_bytes(4, "big") + b"\0\x02\0\x03\0\x02\0\x02" + b"\0\x0a\0\x14"
    parsed = m.parse_stream(frame(body=vbri) + frame(5) * 4)
    assert (parsed["vbr_frames"], parsed["vbr_bytes"], parsed["delay"], parsed["vbr_points"], parsed["vbr_each"], parsed["frames"]) == (4, 999, 288, [0, 30, 90], 2, 4)
