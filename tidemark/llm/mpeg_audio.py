"""Media columns: MPEG audio.

`encode_stream` stores a payload losslessly in an MPEG-1 Layer III stream (48 kHz, mono, CRC on, the
audio silent and the payload in the ancillary part of the frames), with an ID3v2 tag, a Xing table and
an ID3v1 tag. `parse_stream` reads any Layer III stream back: it skips tags, finds the frame headers
again after damage, reads the variable-bitrate table (Xing, Info or VBRI), verifies the CRC of each frame
and gives exact durations, with and without the delay and padding that an encoder tells, and the byte offset
of every frame. Tags are read in ID3v2.2 to 2.4, with extended header, footer and unsynchronisation, and ID3v1.

`audio_columns` parses a binary column, `payload_audio` is the round trip over a text column. Null or
empty text is the empty payload (64 zero bytes). Null or garbage media give zero frames. Repeated rows
are kept, and columns besides the named ones are not read.
"""

import hashlib
import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of ISO/IEC 11172-3 and 13818-3, Layer III: kbit/s by index, Hz by index and version.
BITRATES_V1 = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
BITRATES_V2 = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
SAMPLE_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
# Fixed values of the Xing header: which fields follow.
XING_FRAMES, XING_BYTES, XING_TOC, XING_QUALITY = 1, 2, 4, 8
# Names of encoders that keep delay and padding behind the table.
ENCODERS = (b"LAME", b"Lavf", b"Lavc")

PAYLOAD_UNIT = 64


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        crc = byte << 8
        for _ in range(8):
            crc = (crc << 1) ^ 0x8005 if crc & 0x8000 else crc << 1
        table.append(crc & 0xFFFF)
    return table


_CRC = _crc_table()


def crc16(data: bytes) -> int:
    """The checksum of the MPEG audio frame: polynomial 0x8005, start 0xFFFF."""
    crc = 0xFFFF
    for byte in data:
        crc = ((crc << 8) & 0xFFFF) ^ _CRC[(crc >> 8) ^ byte]
    return crc


class Header:
    """What the four header bytes say; `length` is 0 for bytes that are no Layer III header."""

    __slots__ = ("length", "samples", "rate", "side", "protected", "mono", "kbps")

    def __init__(self, raw: bytes) -> None:
        self.length = 0
        bits = int.from_bytes(raw, "big")
        version, layer = bits >> 19 & 3, bits >> 17 & 3
        bitrate, rate = bits >> 12 & 15, bits >> 10 & 3
        if bits >> 21 != 0x7FF or version == 1 or layer != 1 or bitrate in (0, 15) or rate == 3:
            return
        self.mono = bits >> 6 & 3 == 3
        self.protected = not bits >> 16 & 1
        self.rate = SAMPLE_RATES[version][rate]
        self.kbps = (BITRATES_V1 if version == 3 else BITRATES_V2)[bitrate]
        self.samples = 1152 if version == 3 else 576
        self.side = (17 if self.mono else 32) if version == 3 else (9 if self.mono else 17)
        self.length = self.samples // 8 * self.kbps * 1000 // self.rate + (bits >> 9 & 1)

    @property
    def body(self) -> int:
        """Where the main data begin in the frame."""
        return 4 + 2 * self.protected + self.side


_HEADERS: dict[bytes, Header] = {}


def header(raw: bytes) -> Header:
    found = _HEADERS.get(raw)
    if found is None:
        found = Header(raw)
        if len(_HEADERS) < 4096:
            _HEADERS[raw] = found
    return found


def _frame_head(index: int) -> bytes:
    """Header, CRC and silent side information of one of our frames (MPEG-1, 48 kHz, mono, CRC on)."""
    head = struct.pack(">I", 0x7FF << 21 | 3 << 19 | 1 << 17 | index << 12 | 1 << 10 | 3 << 6)
    side = bytes(17)
    return head + struct.pack(">H", crc16(head[2:] + side)) + side


_HEADS = {i: _frame_head(i) for i in range(1, 15)}
_ROOM = {i: 3 * BITRATES_V1[i] - 23 for i in _HEADS}
_TOP = 14


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _id3v2(fields: dict[str, str]) -> bytes:
    frames = b""
    for name, value in fields.items():
        body = b"\x03" + name.encode() + b"\0" + value.encode()
        frames += b"TXXX" + _synchsafe(len(body)) + b"\0\0" + body
    return b"ID3\x04\0\0" + _synchsafe(len(frames)) + frames


def encode_stream(payload: bytes, fields: dict[str, str] | None = None) -> bytes:
    """The payload as a stream; its length is kept in the tag."""
    room = _ROOM[_TOP]
    full, rest = divmod(len(payload), room)
    head = _HEADS[_TOP]
    parts = [head + payload[i * room : (i + 1) * room] for i in range(full)]
    if rest:
        index = next(i for i in sorted(_ROOM) if _ROOM[i] >= rest)
        parts.append((_HEADS[index] + payload[full * room :]).ljust(3 * BITRATES_V1[index], b"\0"))
    sizes = [len(x) for x in parts]
    info_len = 3 * BITRATES_V1[5]
    total = info_len + sum(sizes)
    starts, at = [], info_len
    for n in sizes:
        starts.append(at)
        at += n
    # the hundred points of the table: where the i-th percent of the frames begins, in 256ths
    toc = bytes(min(255, starts[i * len(starts) // 100] * 256 // total) if starts else 0 for i in range(100))
    xing = b"Xing" + struct.pack(">III", XING_FRAMES | XING_BYTES | XING_TOC, len(parts), total) + toc
    info = (_HEADS[5] + xing).ljust(info_len, b"\0")
    tag = _id3v2({"payload_bytes": str(len(payload)), **(fields or {})})
    return b"".join([tag, info, *parts, b"TAG".ljust(128, b"\0")])


_TEXT_CODES = ("latin-1", "utf-16", "utf-16-be", "utf-8")


def _synced(data: bytes) -> bytes:
    """Bytes without the zeros that unsynchronisation put behind 0xFF."""
    return data.replace(b"\xff\x00", b"\xff")


def _unsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _frame_body(body: bytes, version: int, flags: int) -> bytes | None:
    """A frame's content as its flags say; None where it is encrypted or broken."""
    try:
        if version >= 4:
            if flags & 0x04:
                return None
            body = body[(1 if flags & 0x40 else 0) :]
            body = body[(4 if flags & 0x01 else 0) :]
            body = _synced(body) if flags & 0x02 else body
            return zlib.decompress(body) if flags & 0x08 else body
        if flags & 0x40:
            return None
        packed = flags & 0x80
        body = body[(4 if packed else 0) + (1 if flags & 0x20 else 0) :]
        return zlib.decompress(body) if packed else body
    except zlib.error:
        return None


def _tag_fields(data: bytes) -> tuple[int, dict[str, str]]:
    """End of a leading ID3v2 tag (0 without one) and its text fields: TXXX by name, others by frame.

    Versions 2.2 to 2.4: sizes of frames have seven bits a byte from 2.4 on, eight before, and three bytes in 2.2.
    Unsynchronisation, an extended header, a footer, and compressed or grouped frames are read; encrypted ones are not.
    """
    if len(data) < 10 or data[:3] != b"ID3":
        return 0, {}
    version, flags, size = data[3], data[5], _unsafe(data[6:10])
    end = min(len(data), 10 + size + (10 if version >= 4 and flags & 0x10 else 0))
    body, at, found = data[10 : 10 + size], 0, {}
    if flags & 0x80 and version < 4:
        body = _synced(body)
    if flags & 0x40 and version >= 3 and len(body) >= 4:
        at = _unsafe(body[:4]) if version >= 4 else 4 + int.from_bytes(body[:4], "big")
    head = 6 if version == 2 else 10
    while at + head <= len(body) and body[at] != 0:
        frame = body[at : at + (3 if version == 2 else 4)]
        raw = body[at + len(frame) : at + 2 * len(frame)]
        size = _unsafe(raw) if version >= 4 else int.from_bytes(raw, "big")
        content = body[at + head : at + head + size]
        if version > 2:
            content = _frame_body(content, version, body[at + 9] | (0x02 if flags & 0x80 and version >= 4 else 0))
        if frame[:1] == b"T" and content:
            text = content[1:].decode(_TEXT_CODES[min(content[0], 3)], "replace").rstrip("\0")
            name, _, value = text.partition("\0") if frame in (b"TXXX", b"TXX") else (frame.decode("latin-1"), "", text)
            found[name.removeprefix("\ufeff")] = value.removeprefix("\ufeff")
        at += head + size
    return end, found


def _closing_fields(tag: bytes) -> dict[str, str]:
    """The fields of an ID3v1 tag that hold something, by `v1:` names."""
    text = lambda a, b: tag[a:b].split(b"\0")[0].decode("latin-1").rstrip()
    found = {"title": text(3, 33), "artist": text(33, 63), "album": text(63, 93), "year": text(93, 97), "comment": text(97, 127)}
    if tag[125] == 0 and tag[126]:
        found["track"] = str(tag[126])
    return {f"v1:{k}": v for k, v in found.items() if v}


def _bitrate_table(frame: bytes, body: int) -> dict:
    """What a first frame that is a table says: frames, bytes, seek points, encoder delay and padding; empty without one."""
    out: dict = {}
    if frame[body : body + 4] in (b"Xing", b"Info"):
        flags, where = int.from_bytes(frame[body + 4 : body + 8], "big"), body + 8
        for bit, name in ((XING_FRAMES, "vbr_frames"), (XING_BYTES, "vbr_bytes")):
            if flags & bit:
                out[name] = int.from_bytes(frame[where : where + 4], "big")
                where += 4
        if flags & XING_TOC:
            out["vbr_toc"] = frame[where : where + 100]
            where += 100
        where += 4 if flags & XING_QUALITY else 0
        if frame[where : where + 4] in ENCODERS and where + 24 <= len(frame):
            both = int.from_bytes(frame[where + 21 : where + 24], "big")
            out |= {"delay": both >> 12, "padding": both & 0xFFF}
        return out or {"vbr_toc": None}
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        delay, _, size, frames, points, scale, width, each = struct.unpack(">HHIIHHHH", frame[42:62])
        entries = [int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big") * scale for i in range(points) if 62 + (i + 1) * width <= len(frame)]
        return {"vbr_frames": frames, "vbr_bytes": size, "delay": delay, "vbr_points": list(accumulate(entries, initial=0)), "vbr_each": each}
    return out


def parse_stream(data: bytes | None) -> dict:
    """Frames, samples, rate, checksum results, table, tag fields and frame offsets of a stream.

    A header counts only where the next frame (or the end, or a closing tag) follows it, so bytes that
    look like a header inside damaged or foreign data are passed over; `skipped` counts those bytes.
    """
    data = data or b""
    at, fields = _tag_fields(data)
    end = len(data)
    if end - at >= 128 and data[-128:-125] == b"TAG":
        end -= 128
        fields = _closing_fields(data[end:]) | fields
    out = {"frames": 0, "samples": 0, "rate": 0, "crc_ok": 0, "crc_bad": 0, "skipped": 0,
           "vbr_frames": None, "vbr_bytes": None, "vbr_toc": None, "vbr_points": None, "vbr_each": None, "delay": 0, "padding": 0, "fields": fields, "offsets": [], "chunks": []}
    offsets, chunks, first = out["offsets"], out["chunks"], True
    sure = False
    while at + 4 <= end:
        h = header(data[at : at + 4])
        stop = at + h.length
        if not h.length or stop > end or not (sure or stop == end or header(data[stop : stop + 4]).length):
            ahead = data.find(b"\xff", at + 1, end)
            ahead = end if ahead < 0 else ahead
            out["skipped"] += ahead - at
            at, sure = ahead, False
            continue
        sure = stop + 4 <= end and header(data[stop : stop + 4]).length > 0
        body = at + h.body
        if h.protected:
            good = crc16(data[at + 2 : at + 4] + data[at + 6 : body]) == int.from_bytes(data[at + 4 : at + 6], "big")
            out["crc_ok" if good else "crc_bad"] += 1
        table = _bitrate_table(data[at:stop], body - at) if first else {}
        if table:
            out |= table
        else:
            out["frames"] += 1
            out["samples"] += h.samples
            out["rate"] = h.rate
            offsets.append(at)
            chunks.append((body, stop))
        first = False
        at = stop
    # what an encoder put before and behind the sound does not play
    out["played"] = max(0, out["samples"] - out["delay"] - out["padding"])
    return out


def read_payload(data: bytes, parsed: dict | None = None) -> bytes:
    """The payload that encode_stream stored."""
    parsed = parsed or parse_stream(data)
    size = int(parsed["fields"]["payload_bytes"])
    return b"".join([data[a:b] for a, b in parsed["chunks"]])[:size]


def pad(raw: bytes) -> bytes:
    """Zero bytes appended up to a positive multiple of the payload unit."""
    return raw.ljust(max(1, -(-len(raw) // PAYLOAD_UNIT)) * PAYLOAD_UNIT, b"\0")


AUDIO_FIELDS = (
    "frames long, duration_samples long, sample_rate long, duration_ms double, crc_ok long, crc_bad long, "
    "bytes_skipped long, vbr_frames long, vbr_bytes long, frame_offsets array<long>, tags map<string,string>, "
    "encoder_delay long, encoder_padding long, played_samples long, played_ms double"
)


def audio_columns(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """The `keep` columns and a struct `audio` of AUDIO_FIELDS for the binary column `media`."""

    def parse(values: pd.Series) -> pd.DataFrame:
        rows = []
        for data in values:
            p = parse_stream(bytes(data) if data is not None else None)
            rows.append({
                "frames": p["frames"], "duration_samples": p["samples"], "sample_rate": p["rate"],
                "duration_ms": 1000.0 * p["samples"] / p["rate"] if p["rate"] else 0.0,
                "crc_ok": p["crc_ok"], "crc_bad": p["crc_bad"], "bytes_skipped": p["skipped"],
                "vbr_frames": p["vbr_frames"], "vbr_bytes": p["vbr_bytes"],
                "frame_offsets": p["offsets"], "tags": p["fields"],
                "encoder_delay": p["delay"], "encoder_padding": p["padding"], "played_samples": p["played"],
                "played_ms": 1000.0 * p["played"] / p["rate"] if p["rate"] else 0.0,
            })
        return pd.DataFrame(rows, columns=[x.split()[0] for x in AUDIO_FIELDS.split(", ")])

    ddl = "struct<" + ",".join(":".join(x.split(" ", 1)) for x in AUDIO_FIELDS.split(", ")) + ">"
    udf = F.pandas_udf(parse, ddl)
    return df.select(*keep, udf(F.col(media)).alias("audio"))


DIGEST_SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, frames long, duration_samples long, crc_bad long"
)


def payload_audio(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text as MPEG audio, reads the stored bytes back and digests both (DIGEST_SCHEMA).

    `feature` names frames, samples, seconds, checksum results, the table's agreement with the frames
    and a digest of the seek offsets. One row in, one row out; a row needs memory for its own text only.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                rows = []
                for text in part.column(1):
                    raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                    rows.append((len(raw), *_round_trip(pad(raw))))
                columns = list(zip(*rows, strict=True))
                names = ["doc_id", *[x.split()[0] for x in DIGEST_SCHEMA.split(", ")[1:]]]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c) for c in columns]], names)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(digest, DIGEST_SCHEMA)


def _round_trip(payload: bytes) -> tuple:
    media = encode_stream(payload)
    parsed = parse_stream(media)
    back = read_payload(media, parsed)
    offsets = parsed["offsets"]
    seek = hashlib.sha256(struct.pack(f">{len(offsets)}Q", *offsets)).hexdigest()[:16]
    agrees = int(parsed["vbr_frames"] == parsed["frames"])
    feature = (
        f"frames={parsed['frames']};samples={parsed['samples']};rate={parsed['rate']};"
        f"ms={1000 * parsed['samples'] // parsed['rate'] if parsed['rate'] else 0};crc_ok={parsed['crc_ok']};"
        f"crc_bad={parsed['crc_bad']};vbr={agrees};seek={seek}"
    )
    return (
        len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-PAYLOAD_UNIT:]), len(media),
        hashlib.sha256(media).hexdigest(), feature, parsed["frames"], parsed["samples"], parsed["crc_bad"],
    )


def op7_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of `documents`, stored as MPEG audio and read back."""
    return payload_audio(spark.read.parquet(f"{sf_dir}/documents.parquet"))
