"""MPEG audio media columns: write payloads into frames, and read any MPEG audio bytes back.

Reading resynchronises on frame headers (a header counts if the next one follows where its length says, or
the stream ends there), parses ID3v2 and ID3v1 tags and Xing, Info and VBRI tables, verifies the checksum of
protected Layer III frames, and gives the exact duration in samples (also without what the encoder added before and
after, where the table tells), whether the table's count agrees, and every frame's offset for seeking.

Writing stores a payload losslessly as the ancillary data of MPEG-1 Layer III frames (48 kHz, one channel,
128 kbit/s, protected; side information of zeros, so all that follows it is ancillary data). The last frame
takes the least bitrate that holds the rest, hence a Xing table precedes; an ID3v2 tag holds the length.

Defined cases: a null text is empty and its payload one padded block; bytes without a frame give no frames, a
duration of 0 and an empty payload; a text of any length is one stream; repeated rows get equal results; an empty table
gives no rows. analyse keeps other columns but those named like its own, store_texts ignores them.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import extended, load, tidy

BLOCK = 192
# Bitrates in kbit/s by header index, for MPEG-1 Layers I to III and MPEG-2 Layer I and Layers II, III.
_RATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_SAMPLE_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


@lru_cache(maxsize=4096)
def header(four: bytes):
    """(length, samples, sample rate, protected, bytes of side information, layer, channels) of a header, or None."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    index, rate_index, padding = four[2] >> 4, four[2] >> 2 & 3, four[2] >> 1 & 1
    if version == 1 or layer == 4 or index in (0, 15) or rate_index == 3:
        return None
    family = 1 if version == 3 else 2
    kbps, rate = _RATES[family, layer][index], _SAMPLE_RATES[version][rate_index]
    mono = four[3] >> 6 == 3
    if layer == 1:
        length, samples = (12 * kbps * 1000 // rate + padding) * 4, 384
    else:
        samples = 576 if layer == 3 and family == 2 else 1152
        length = samples // 8 * kbps * 1000 // rate + padding
    side = 0 if layer != 3 else (17 if mono else 32) if family == 1 else (9 if mono else 17)
    return length, samples, rate, not four[1] & 1, side, layer, 1 if mono else 2


def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        c = b << 8
        for _ in range(8):
            c = c << 1 ^ 0x8005 if c & 0x8000 else c << 1
        out.append(c & 0xFFFF)
    return out


_CRC = _crc_table()


@lru_cache(maxsize=65536)
def checksum(protected: bytes) -> int:
    c = 0xFFFF
    for b in protected:
        c = (c << 8 & 0xFFFF) ^ _CRC[c >> 8 ^ b]
    return c


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _text(value: bytes) -> str:
    """A text frame's value: a byte of encoding, then the text."""
    return value[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(value[0], "utf-8"), "replace").rstrip("\0")


def _frames(body: bytes, major: int):
    """(name, value) of the frames of an ID3v2 tag: names and sizes take three bytes in version 2, four later on."""
    at, wide = 0, 3 if major == 2 else 4
    head = 6 if major == 2 else 10
    while at + head <= len(body) and body[at] >= 0x30:
        size = body[at + wide : at + 2 * wide]
        n = _syncsafe(size) if major == 4 else int.from_bytes(size, "big")
        value = body[at + head : at + head + n]
        if n <= 0 or len(value) < n:
            return
        if major == 4 and body[at + 9] & 2:
            value = value.replace(b"\xff\0", b"\xff")
        if major == 4 and body[at + 9] & 1:  # its length before it was unsynchronised
            value = value[4:]
        yield body[at : at + wide].decode("latin-1"), value
        at += head + n


def _tags(media: bytes) -> tuple[dict[str, str], int, int]:
    """Tags, where audio starts and where it ends. ID3v2.2 to 2.4, unsynchronised and with extended headers, and ID3v1."""
    tags, begin, end = {}, 0, len(media)
    while media[begin : begin + 3] == b"ID3" and len(media) >= begin + 10:
        size, major, flags = _syncsafe(media[begin + 6 : begin + 10]), media[begin + 3], media[begin + 5]
        body = media[begin + 10 : min(begin + 10 + size, end)]
        if flags & 0x80 and major < 4:
            body = body.replace(b"\xff\0", b"\xff")
        if flags & 0x40 and major > 2 and len(body) >= 4:  # version 3 does not count the size's own bytes
            body = body[_syncsafe(body[:4]) :] if major == 4 else body[4 + int.from_bytes(body[:4], "big") :]
        for name, value in _frames(body, major):
            if name[0] == "T" and value:
                value = _text(value)
                if name in ("TXXX", "TXX"):
                    key, _, value = value.partition("\0")
                    name = f"{name}:{key}"
                tags[name] = value
        begin += 10 + size + (10 if flags & 0x10 and major == 4 else 0)
    if end - begin >= 128 and media[end - 128 : end - 125] == b"TAG":
        end -= 128
        tags["ID3v1"] = media[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1")
    return tags, min(begin, end), end


def _vbr_table(media: bytes, at: int, side: int, protected: bool, length: int):
    for x in (at + 4 + side, at + 4 + 2 * protected + side):
        if (name := media[x : x + 4]) in (b"Xing", b"Info"):
            flags, x = int.from_bytes(media[x + 4 : x + 8], "big"), x + 8
            out = {"kind": name.decode(), "frames": None, "bytes": None, "toc": b"", "delay": 0, "padding": 0}
            if flags & 1:
                out["frames"], x = int.from_bytes(media[x : x + 4], "big"), x + 4
            if flags & 2:
                out["bytes"], x = int.from_bytes(media[x : x + 4], "big"), x + 4
            if flags & 4:
                out["toc"], x = media[x : x + 100], x + 100
            x += 4 * (flags >> 3 & 1)
            if media[x : x + 4] in (b"LAME", b"Lavc", b"Lavf", b"GOGO") and x + 24 <= at + length:  # twelve bits each of what the encoder added
                added = int.from_bytes(media[x + 21 : x + 24], "big")
                out["delay"], out["padding"] = added >> 12, added & 0xFFF
            return out
    if media[at + 36 : at + 40] == b"VBRI" and length > 62:
        n, scale, width = struct.unpack(">HHH", media[at + 54 : at + 60])
        table = media[at + 62 : at + 62 + n * width]
        return {"kind": "VBRI", "bytes": int.from_bytes(media[at + 46 : at + 50], "big"), "frames": int.from_bytes(media[at + 50 : at + 54], "big"), "toc": table, "delay": int.from_bytes(media[at + 42 : at + 44], "big"), "padding": 0}
    return None


def read(media: bytes) -> dict:
    """Everything that the bytes tell: see the columns of analyse."""
    tags, at, end = _tags(media)
    offsets, payload, rates, sizes = [], [], set(), set()
    samples = bad = checked = resyncs = skipped = 0
    vbr, channels, layer = None, 0, 0
    lost = False
    while at + 4 <= end:
        h = header(media[at : at + 4])
        stop = at + h[0] if h else 0
        sound = h is not None and (stop == end or stop < end and (stop + 4 > end or header(media[stop : stop + 4]) is not None))
        if not sound:
            if not lost:
                resyncs, lost = resyncs + 1, True
            to = media.find(b"\xff", at + 1, end)
            to = to if to >= 0 else end
            skipped += to - at
            at = to
            continue
        lost = False
        length, n, rate, protected, side, layer, channels = h
        body = at + 4 + 2 * protected + side
        if protected and layer == 3:
            checked += 1
            bad += checksum(media[at + 2 : at + 4] + media[at + 6 : at + 6 + side]) != int.from_bytes(media[at + 4 : at + 6], "big")
        if not offsets and vbr is None and layer == 3 and (vbr := _vbr_table(media, at, side, protected, length)):
            at = stop
            continue
        offsets.append(at)
        rates.add(rate)
        sizes.add(length)
        samples += n
        payload.append(media[body:stop])
        at = stop
    data = b"".join(payload)
    if tags.get("TXXX:payload_bytes", "").isdigit():
        data = data[: int(tags["TXXX:payload_bytes"])]
    return {
        "payload": data, "sample_rate": max(rates, default=0), "channels": channels, "layer": layer, "samples": samples, "frames": len(offsets),
        "seek_offsets": offsets, "checked": checked, "bad_checksums": bad, "resyncs": resyncs, "skipped_bytes": skipped + max(0, end - at),
        "played_samples": max(0, samples - (vbr["delay"] + vbr["padding"] if vbr else 0)), "table_agrees": vbr["frames"] == len(offsets) if vbr and vbr["frames"] is not None else None,
        "vbr_kind": vbr["kind"] if vbr else None, "vbr_frames": vbr["frames"] if vbr else None, "vbr_bytes": vbr["bytes"] if vbr else None, "tags": tags,
    }


_SIDE = bytes(17)


def _head(kbps: int) -> bytes:
    two = bytes([_RATES[1, 3].index(kbps) << 4 | 1 << 2, 0xC0])
    return b"\xff\xfa" + two + checksum(two + _SIDE).to_bytes(2, "big") + _SIDE


_HEADS = {kbps: _head(kbps) for kbps in _RATES[1, 3][1:10]}
_FULL = 128
_FRAME = 3 * _FULL
_BODY = _FRAME - len(_HEADS[_FULL])


def write(payload: bytes) -> bytes:
    """The payload as an MPEG audio stream."""
    full, rest = divmod(len(payload), _BODY)
    frames = np.empty((full, _FRAME), np.uint8)
    frames[:, : _FRAME - _BODY] = np.frombuffer(_HEADS[_FULL], np.uint8)
    frames[:, _FRAME - _BODY :] = np.frombuffer(payload, np.uint8, full * _BODY).reshape(full, _BODY)
    last = b""
    if rest:
        kbps = next(k for k in _HEADS if 3 * k - len(_HEADS[k]) >= rest)
        last = (_HEADS[kbps] + payload[full * _BODY :]).ljust(3 * kbps, b"\0")
    n, size = full + bool(rest), _FRAME * (full + 1) + len(last)
    toc = ((np.arange(100) * n // 100 + 1) * _FRAME * 256 // size).clip(0, 255).astype(np.uint8).tobytes()
    table = (_HEADS[_FULL] + b"Xing" + struct.pack(">III", 7, n, size) + toc).ljust(_FRAME, b"\0")
    text = b"\x03payload_bytes\0" + str(len(payload)).encode()
    tag = b"TXXX" + bytes([0, 0, 0, len(text)]) + b"\0\0" + text
    return b"ID3\x04\0\0" + bytes([0, 0, 0, len(tag)]) + tag + table + frames.tobytes() + last


def text_payload(text: str | None) -> tuple[int, bytes]:
    """Bytes of a text and its payload, padded with spaces to a positive multiple of BLOCK."""
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK), b" ")


def store_texts(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, media."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                made = [text_payload(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([write(p) for _, p in made], pa.binary())], names=["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(tidy(run), f"doc_id {kind}, n_bytes long, media binary")


_READ = [
    ("payload", "binary", pa.binary()), ("sample_rate", "int", pa.int32()), ("channels", "int", pa.int32()), ("layer", "int", pa.int32()), ("samples", "long", pa.int64()), ("frames", "long", pa.int64()),
    ("seek_offsets", "array<long>", pa.list_(pa.int64())), ("checked", "long", pa.int64()), ("bad_checksums", "long", pa.int64()), ("resyncs", "long", pa.int64()), ("skipped_bytes", "long", pa.int64()),
    ("played_samples", "long", pa.int64()), ("table_agrees", "boolean", pa.bool_()), ("vbr_kind", "string", pa.string()), ("vbr_frames", "long", pa.int64()), ("vbr_bytes", "long", pa.int64()), ("tags", "map<string,string>", pa.map_(pa.string(), pa.string())),
]


def analyse(media: DataFrame) -> DataFrame:
    """Rows with a binary column media -> all columns and what its bytes tell. Null media are empty."""

    def run(batches):
        for b in batches:
            k = b.schema.get_field_index("media")
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                rows = [read(m or b"") for m in part.column(k).to_pylist()]
                new = [pa.array([list(r[name].items()) if name == "tags" else r[name] for r in rows], kind) for name, _, kind in _READ]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*b.schema.names, *(x[0] for x in _READ)])

    plain = media.drop(*(x[0] for x in _READ))
    return plain.mapInArrow(tidy(run), extended(plain.schema, ", ".join(f"{name} {kind}" for name, kind, _ in _READ)))


def op4_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analyse(store_texts(load(spark, sf_dir, "documents")))
    feature = F.concat_ws(
        ";", F.format_string("layer=%d", "layer"), F.format_string("rate=%d", "sample_rate"), F.format_string("frames=%d", "frames"), F.format_string("samples=%d", "samples"),
        F.format_string("seconds=%.6f", F.col("samples") / F.col("sample_rate")), F.concat(F.lit("table="), F.col("vbr_kind")), F.format_string("table_frames=%d", "vbr_frames"),
        F.format_string("checked=%d", "checked"), F.format_string("bad=%d", "bad_checksums"), F.format_string("resyncs=%d", "resyncs"),
        F.concat(F.lit("seek="), F.crc32(F.array_join(F.col("seek_offsets").cast("array<string>"), ",").cast("binary")).cast("string")),
    )
    return found.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"), "samples", "frames",
    )
