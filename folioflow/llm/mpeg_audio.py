"""MPEG audio as a media column: writing, resynchronising and measuring streams.

`parse` walks any MPEG-1/2/2.5 Layer I-III byte string: it reads ID3v2 and
ID3v1 tags, finds frame headers again after foreign bytes, reads Xing/Info and
VBRI tables, verifies CRC-16 where it covers a fixed range (Layers I and III),
and returns the exact sample count and the offset of every frame. Layer II
checksums, whose range depends on the bit allocation, count as unchecked; of a
VBRI table only its counts are read; free-format streams have no frames here; and
the encoder's delay and padding, where a table names them, stay in the duration.

`store` is the lossless carrier: one VBR stream whose Layer III frames hold the
payload in their main-data area, with a Xing table and protected headers.

Defined results: null text counts as empty; an empty text still has one block
of 64 zero bytes; equal texts give equal streams; a byte string without any
frame parses to zero frames and duration 0.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm._arrow import map_columns

# Fixed values of the MPEG audio standard: kbit/s by index 1..14.
KBPS = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
# Sampling rates by version bits (3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5).
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

BLOCK = 64
SIDE = 17  # bytes of side information of a mono MPEG-1 Layer III frame
HEAD = 4 + 2 + SIDE


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        c = n << 8
        for _ in range(8):
            c = (c << 1) ^ 0x8005 if c & 0x8000 else c << 1
        out.append(c & 0xFFFF)
    return out


_CRC = _crc_table()


def crc16(data: bytes) -> int:
    """CRC-16 of MPEG audio: polynomial 0x8005, start 0xFFFF."""
    c = 0xFFFF
    for b in data:
        c = ((c << 8) & 0xFFFF) ^ _CRC[(c >> 8) ^ b]
    return c


def header(word: bytes) -> dict | None:
    """The fields of a four-byte frame header, or None if it isn't one (free format is not one)."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer = word[1] >> 3 & 3, 4 - (word[1] >> 1 & 3)
    rate, kbps = word[2] >> 2 & 3, word[2] >> 4
    if version == 1 or layer == 4 or rate == 3 or kbps in (0, 15) or word[3] & 3 == 2:
        return None
    first, mono = version == 3, word[3] >> 6 == 3
    hz, bits = RATES[version][rate], KBPS[1 if first else 2, layer][kbps - 1] * 1000
    pad = word[2] >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
    length = (12 * bits // hz + pad) * 4 if layer == 1 else samples // 8 * bits // hz + pad
    side = (17 if mono else 32) if first else (9 if mono else 17)
    return {"version": {3: "1", 2: "2", 0: "2.5"}[version], "layer": layer, "hz": hz, "bits": bits, "samples": samples, "length": length, "protected": not word[1] & 1, "channels": 1 if mono else 2, "side": side if layer == 3 else 0, "kind": (version, layer, rate)}


def _syncsafe(b: bytes) -> int:
    return (b[0] & 127) << 21 | (b[1] & 127) << 14 | (b[2] & 127) << 7 | b[3] & 127


def _tags(data: bytes) -> tuple[dict[str, str], int]:
    """ID3v2 text frames at the start, and the offset behind the tag."""
    if data[:3] != b"ID3" or len(data) < 10:
        return {}, 0
    end, at, major = min(len(data), 10 + _syncsafe(data[6:10])), 10, data[3]
    tags: dict[str, str] = {}
    while major >= 3 and at + 10 <= end and data[at : at + 1].isalnum():
        name = data[at : at + 4].decode("latin-1")
        n = _syncsafe(data[at + 4 : at + 8]) if major == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        body, at = data[at + 10 : at + 10 + n], at + 10 + n
        if name[0] == "T" and body:
            parts = body[1:].decode({0: "latin-1", 3: "utf-8"}.get(body[0], "utf-16"), "replace").rstrip("\0").split("\0")
            if name == "TXXX" and len(parts) > 1:
                name, parts = f"TXXX:{parts[0]}", parts[1:]
            tags[name] = parts[0]
    return tags, end


def _table(data: bytes, at: int, h: dict) -> dict | None:
    """The Xing, Info or VBRI table of a frame."""
    x = at + 4 + 2 * h["protected"] + h["side"]
    for x in (x, at + 4 + h["side"]):
        if data[x : x + 4] in (b"Xing", b"Info"):
            kind, flags, x = data[x : x + 4].decode(), int.from_bytes(data[x + 4 : x + 8], "big"), x + 8
            out: dict = {"kind": kind, "frames": None, "bytes": None, "toc": None}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name], x = int.from_bytes(data[x : x + 4], "big"), x + 4
            if flags & 4:
                out["toc"] = list(data[x : x + 100])
            return out
    x = at + 36
    if data[x : x + 4] == b"VBRI":
        return {"kind": "VBRI", "bytes": int.from_bytes(data[x + 10 : x + 14], "big"), "frames": int.from_bytes(data[x + 14 : x + 18], "big"), "toc": None}
    return None


def _covered(data: bytes, at: int, h: dict) -> bytes | None:
    """The bytes that the checksum covers, if their number is fixed."""
    n = h["side"] if h["layer"] == 3 else (16 if h["channels"] == 1 else 32) if h["layer"] == 1 else -1
    return data[at + 2 : at + 4] + data[at + 6 : at + 6 + n] if n >= 0 else None


def parse(data: bytes) -> dict:
    """Walk a stream. A header found out of sync counts only if it holds a table, or another one of its kind or the end follows it."""
    tags, at = _tags(data)
    end = len(data) - 128 if data[-128:-125] == b"TAG" else len(data)
    if end < len(data):
        tags["ID3v1:title"] = data[end + 3 : end + 33].decode("latin-1").rstrip("\0 ")
    heads: dict[bytes, dict | None] = {}
    sums: dict[bytes, int] = {}

    def head(at: int) -> dict | None:
        word = data[at : at + 4]
        if word not in heads:
            heads[word] = header(word)
        return heads[word]

    out: dict = {"tags": tags, "table": None, "offsets": [], "samples": 0, "crc_ok": 0, "crc_bad": 0, "crc_unchecked": 0, "skipped": 0, "resyncs": 0, "bitrates": set(), "first": None, "bodies": []}
    synced, kind = True, None
    while at + 4 <= end:
        h = head(at)
        after = at + h["length"] if h else 0
        good = h and after <= end and (kind is None or h["kind"] == kind)
        if good and (not synced or kind is None) and after != end and not (kind is None and _table(data, at, h)):
            follow = head(after)
            good = follow is not None and follow["kind"] == h["kind"]
        if not good:
            out["resyncs"] += synced
            synced = False
            found = data.find(b"\xff", at + 1, end)
            found = end if found < 0 else found
            out["skipped"] += found - at
            at = found
            continue
        synced = True
        if kind is None:
            kind, out["first"] = h["kind"], h
            out["table"] = _table(data, at, h)
            if out["table"]:
                at = after
                continue
        if h["protected"]:
            covered = _covered(data, at, h)
            if covered is None:
                out["crc_unchecked"] += 1
            else:
                if covered not in sums:
                    sums[covered] = crc16(covered)
                out["crc_ok" if data[at + 4 : at + 6] == sums[covered].to_bytes(2, "big") else "crc_bad"] += 1
        out["offsets"].append(at)
        out["bodies"].append((at + 4 + 2 * h["protected"] + h["side"], after))
        out["bitrates"].add(h["bits"])
        out["samples"] += h["samples"]
        at = after
    out["skipped"] += max(0, end - at)
    return out


def _frame_head(kbps_index: int, protected: bool) -> bytes:
    """MPEG-1 Layer III, 32 kHz, mono."""
    word = bytes((0xFF, 0xFA if protected else 0xFB, kbps_index << 4 | 2 << 2, 3 << 6))
    return word + crc16(word[2:] + bytes(SIDE)).to_bytes(2, "big") + bytes(SIDE) if protected else word + bytes(SIDE)


_LENGTHS = [144 * k * 1000 // 32000 for k in KBPS[1, 3]]
_HEADS = [_frame_head(i + 1, True) for i in range(14)]


def store(payload: bytes) -> bytes:
    """The payload as a variable-bitrate stream: full frames at 320 kbit/s, the last in the smallest that holds it."""
    full = _LENGTHS[13] - HEAD
    frames = [_HEADS[13] + payload[i : i + full] for i in range(0, len(payload) - full + 1, full)]
    if rest := payload[len(frames) * full :]:
        k = next(i for i, n in enumerate(_LENGTHS) if n - HEAD >= len(rest))
        frames.append(_HEADS[k] + rest + bytes(_LENGTHS[k] - HEAD - len(rest)))
    note = b"\x03payload_bytes\0%d" % len(payload)
    tag = b"TXXX" + struct.pack(">I", len(note)) + b"\0\0" + note if len(note) < 128 else b""
    size = sum(map(len, frames)) + _LENGTHS[0]
    marks, at = [], _LENGTHS[0]
    for f in frames:
        marks.append(at)
        at += len(f)
    toc = bytes(min(255, marks[len(marks) * p // 100] * 256 // size) for p in range(100))
    table = _frame_head(1, False) + b"Xing" + struct.pack(">III", 7, len(frames), size) + toc
    body = b"".join((table.ljust(_LENGTHS[0], b"\0"), *frames))
    return b"ID3\x04\0\0" + bytes((0, 0, 0, len(tag))) + tag + body


def load(data: bytes, parsed: dict | None = None) -> bytes:
    """The payload of `store`, from the frames' main data."""
    p = parsed or parse(data)
    return b"".join(data[a:b] for a, b in p["bodies"])[: int(p["tags"]["TXXX:payload_bytes"])]


def feature(p: dict) -> str:
    """A stream's measures as one line."""
    h, t = p["first"] or {"version": "-", "layer": 0, "hz": 1}, p["table"] or {"kind": "-", "frames": None}
    marks = hashlib.sha256(",".join(map(str, p["offsets"])).encode()).hexdigest()[:16]
    return f"mpeg{h['version']}.{h['layer']} hz={h['hz']} frames={len(p['offsets'])} samples={p['samples']} ms={p['samples'] * 1000 // h['hz']} bitrates={len(p['bitrates'])} table={t['kind']}:{t['frames']} crc={p['crc_ok']}/{p['crc_bad']}/{p['crc_unchecked']} skipped={p['skipped']} resyncs={p['resyncs']} offsets={marks}"


MEDIA = "n_frames long, samples long, sample_rate long, duration_s double, crc_ok long, crc_bad long, skipped_bytes long, resyncs long, table string, tags map<string,string>, frame_offsets array<long>"


def media_columns(df: DataFrame, key: str, content: str) -> DataFrame:
    """`key` and the measures of the stream in the binary column `content` (null: no stream, zero frames)."""

    def make():
        def work(keys, streams):
            ps = [parse(s or b"") for s in streams]
            hz = [(p["first"] or {"hz": 0})["hz"] for p in ps]
            return [keys, [len(p["offsets"]) for p in ps], [p["samples"] for p in ps], hz, [p["samples"] / h if h else 0.0 for p, h in zip(ps, hz, strict=True)], *([p[k] for p in ps] for k in ("crc_ok", "crc_bad", "skipped", "resyncs")), [(p["table"] or {"kind": None})["kind"] for p in ps], [list(p["tags"].items()) for p in ps], [p["offsets"] for p in ps]]

        return work

    kind = df.schema[key].dataType.simpleString()
    return map_columns(df.select(F.col(key).alias("key"), F.col(content).cast("binary")), make, f"key {kind}, {MEDIA}").withColumnRenamed("key", key)


def store_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """Every whole text as a stream: `key`, `n_bytes` (unpadded), `media` binary."""

    def make():
        def work(keys, texts):
            raw = [(t or "").encode() for t in texts]
            return [keys, [len(r) for r in raw], [store(r + bytes(-len(r) % BLOCK or BLOCK * (not r))) for r in raw]]

        return work

    kind = df.schema[key].dataType.simpleString()
    return map_columns(df.select(F.col(key).alias("key"), F.col(text).cast("string")), make, f"key {kind}, n_bytes long, media binary").withColumnRenamed("key", key)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest(stored: DataFrame) -> DataFrame:
    """Read each stored stream of `store_texts` back and derive its digest columns."""

    def make():
        def work(ids, sizes, streams):
            out = []
            for i, n, s in zip(ids, sizes, streams, strict=True):
                p = parse(s)
                back = load(s, p)
                out.append((i, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(s), hashlib.sha256(s).hexdigest(), feature(p)))
            return [list(c) for c in zip(*out, strict=True)] or [[] for _ in range(8)]

        return work

    return map_columns(stored.select(F.col("doc_id").cast("long"), "n_bytes", "media"), make, DIGEST)


def op9_media_mpeg_audio(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest(store_texts(docs, "doc_id", "text"))
