"""MPEG audio columns: writing frames, and reading MPEG-1/2/2.5 streams of layers I to III (free-format frames are skipped).

The reader resynchronises on frame headers, parses ID3v2.2 to 2.4 tags (unsynchronised ones and extended headers too; the
n-th frame of an id is `id#n`) and ID3v1 tags, and the variable-bitrate tables (Xing or Info, and VBRI), verifies the
checksums of guarded frames of every layer, and gives exact durations (samples over sample rate) and the seek offset of
every frame. The writer stores bytes losslessly in layer III frames: side information of a silent frame, a valid checksum,
and the payload in the frame's main data area; a last, smaller frame takes the rest, so the stream has a variable
bitrate and carries a Xing table.

Defined results: null text counts as empty and gives a payload of 64 zero bytes; texts of any length are stored whole, in as
many frames as they need; equal texts give equal media; null media has no frames; ids may be null or repeat, a row for each
row; an empty table gives no rows; columns of other names come back as they were from with_media.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import documents, map_texts, texts_udf, workspace, written

# Fixed values of the format: kbit/s by (MPEG-1?, layer) and index, samples a second by version bits and index,
# side information bytes by (MPEG-1?, mono?), samples of a frame by (MPEG-1?, layer).
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
SIDE = {(True, False): 32, (True, True): 17, (False, False): 17, (False, True): 9}
SAMPLES = {(True, 1): 384, (True, 2): 1152, (True, 3): 1152, (False, 1): 384, (False, 2): 1152, (False, 3): 576}
OWNER = b"corpusloom.payload\x00"


@lru_cache(4096)
def checksum(data: bytes, bits: int | None = None) -> int:
    """The CRC-16 of MPEG audio: polynomial 0x8005, all ones at first; of the first bits only, if their number is given."""
    crc = 0xFFFF
    for k in range(8 * len(data) if bits is None else bits):
        out = (crc >> 15) ^ (data[k >> 3] >> (7 - (k & 7)) & 1)
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if out else 0)
    return crc


def allocation(h: dict) -> list[int]:
    """Bits that the allocation of each subband has in a layer I or II frame."""
    if h["layer"] == 1:
        return [4] * 32
    if h["version"] != "1":
        return [4] * 4 + [3] * 7 + [2] * 19
    each = h["kbps"] // (1 if h["mono"] else 2)
    if 56 <= each <= 80 or (h["rate"] == 48000 and each >= 56):
        return [4] * 11 + [3] * 12 + [2] * 4
    if each >= 96:
        return [4] * 11 + [3] * 12 + [2] * 7
    return [4] * 2 + [3] * (6 if h["rate"] != 32000 else 10)


def guarded_bits(h: dict, data: bytes) -> int:
    """How many bits after the checksum it covers: side information, or allocations and, in layer II, scale factor choices."""
    if h["layer"] == 3:
        return 8 * h["side"]
    at, chosen = 0, 0
    channels = 1 if h["mono"] else 2
    for band, width in enumerate(allocation(h)):
        shared = channels == 2 and h["mode"] == 1 and band >= h["bound"]
        for _ in range(1 if shared else channels):
            used = int.from_bytes(data[at >> 3 : (at + 15) >> 3].ljust(2, b"\0")[:2]) >> (16 - (at & 7) - width) & ((1 << width) - 1)
            chosen += (2 if shared else 1) * 2 * bool(used)
            at += width
    return at + (chosen if h["layer"] == 2 else 0)


@lru_cache(4096)
def header(four: bytes) -> dict | None:
    """What a frame header says; None if it is none (free-format frames are not taken)."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    rate, speed = four[2] >> 2 & 3, four[2] >> 4
    if version == 1 or layer == 4 or rate == 3 or speed in (0, 15) or four[3] & 3 == 2:
        return None
    first, pad = version == 3, four[2] >> 1 & 1
    bits, hertz = BITRATES[first, layer][speed] * 1000, RATES[version][rate]
    if layer == 1:
        size = (12 * bits // hertz + pad) * 4
    else:
        size = SAMPLES[first, layer] // 8 * bits // hertz + pad
    mode = four[3] >> 6
    mono = mode == 3
    return {"mode": mode, "bound": 4 * ((four[3] >> 4 & 3) + 1), "version": {3: "1", 2: "2", 0: "2.5"}[version], "layer": layer, "kbps": bits // 1000, "rate": hertz, "mono": mono, "guarded": not four[1] & 1, "size": size, "samples": SAMPLES[first, layer], "side": SIDE[first, mono] if layer == 3 else 0}


def syncsafe(data: bytes) -> int:
    return sum((b & 127) << 7 * k for k, b in enumerate(reversed(data)))


def from_syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def tags(media: bytes) -> tuple[dict[str, bytes], int, int]:
    """The ID3v2 frames by id and the ID3v1 title, and where the audio starts and ends."""
    found, start, end = {}, 0, len(media)
    seen: dict[str, int] = {}
    while media[start : start + 3] == b"ID3" and start + 10 <= end:
        major, flags, size = media[start + 3], media[start + 5], syncsafe(media[start + 6 : start + 10])
        body = media[start + 10 : min(end, start + 10 + size)]
        if flags & 128 and major < 4:
            body = body.replace(b"\xff\0", b"\xff")
        at, short = 0, major == 2
        if flags & 64 and major >= 3:  # an extended header is passed over
            at = syncsafe(body[:4]) if major == 4 else 4 + int.from_bytes(body[:4])
        head = 6 if short else 10
        while at + head <= len(body) and body[at]:
            name, n = body[at : at + (3 if short else 4)].decode("latin-1"), body[at + (3 if short else 4) : at + (6 if short else 8)]
            n = syncsafe(n) if major == 4 else int.from_bytes(n)
            data = body[at + head : at + head + n]
            if major == 4 and body[at + 9] & 2:
                data = data.replace(b"\xff\0", b"\xff")
            seen[name] = seen.get(name, 0) + 1
            found[name if seen[name] == 1 else f"{name}#{seen[name]}"] = data
            at += head + n
        start = min(end, start + 10 + size + 10 * bool(flags & 16))
    if end - start >= 128 and media[end - 128 : end - 125] == b"TAG":
        found["ID3v1"] = media[end - 125 : end - 95].rstrip(b"\0 ")
        end -= 128
    return found, start, end


def vbr_table(frame: bytes, side: int) -> dict | None:
    """The Xing, Info or VBRI table of a frame, if it has one."""
    at = 4 + side
    if (kind := frame[at : at + 4]) in (b"Xing", b"Info") and len(frame) >= at + 8:
        flags, at, out = int.from_bytes(frame[at + 4 : at + 8]), at + 8, {"kind": kind.decode()}
        for bit, name, n in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
            if flags & bit:
                out[name] = frame[at : at + n] if name == "toc" else int.from_bytes(frame[at : at + n])
                at += n
        return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames = struct.unpack(">II", frame[46:54])
        entries, scale, width, per = struct.unpack(">HHHH", frame[54:62])
        toc = [int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width]) * scale for i in range(entries)]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": toc, "per": per}
    return None


def parse(media: bytes) -> dict:
    """Tags, the bitrate table, frames (offset, size, header), checksum counts, bytes skipped to resynchronise, samples."""
    found, at, end = tags(media)
    out = {"tags": found, "vbr": None, "frames": [], "checked": 0, "bad": 0, "skipped": 0, "samples": 0, "rate": None}
    kind, lost = None, True
    while at + 4 <= end:
        h = header(media[at : at + 4])
        if h and lost:  # a frame to start or go on from needs another one behind it, or the end
            after = at + h["size"]
            if after != end and not ((g := header(media[after : after + 4])) and (g["version"], g["layer"], g["rate"]) == (h["version"], h["layer"], h["rate"])):
                h = None
        if h is None or (kind and (h["version"], h["layer"], h["rate"]) != kind) or at + h["size"] > end:
            nxt = media.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            out["skipped"] += nxt - at
            at, lost = nxt, True
            continue
        lost = False
        if kind is None:
            kind = (h["version"], h["layer"], h["rate"])
            out["rate"] = h["rate"]
            out["vbr"] = vbr_table(media[at : at + h["size"]], h["side"])
            if out["vbr"]:
                at += h["size"]
                continue
        if h["guarded"]:
            data = media[at + 6 : at + min(h["size"], 160)]
            bits = guarded_bits(h, data)
            out["checked"] += 1
            out["bad"] += checksum(media[at + 2 : at + 4] + data[: (bits + 7) // 8], 16 + bits) != int.from_bytes(media[at + 4 : at + 6])
        out["frames"].append((at, h["size"], h))
        out["samples"] += h["samples"]
        at += h["size"]
    out["skipped"] += max(0, end - at)
    out["seconds"] = Fraction(out["samples"], out["rate"]) if out["rate"] else Fraction(0)
    return out


RATE, EMPTY = 32000, bytes(17)
LEAD = 4 + 2 + len(EMPTY)
#: Frame header and size by bitrate index: MPEG-1 layer III, guarded, 32 kHz, mono.
FRAMES = [(bytes((0xFF, 0xFA, k << 4 | 8, 0xC0)), 144 * b * 1000 // RATE) for k, b in enumerate(BITRATES[True, 3]) if b]
HEADS = {n: h + checksum(h[2:] + EMPTY).to_bytes(2) + EMPTY for h, n in FRAMES}
LARGEST = FRAMES[-1][1]
ROOM = LARGEST - LEAD


def encode(payload: bytes) -> bytes:
    """The payload in the main data of frames, after an ID3v2 tag that has its length and a frame with a Xing table."""
    whole, rest = divmod(len(payload), ROOM)
    frames = [HEADS[LARGEST] + payload[i * ROOM : (i + 1) * ROOM] for i in range(whole)]
    if rest:
        size = next(n for _, n in FRAMES if n - LEAD >= rest)
        frames.append((HEADS[size] + payload[whole * ROOM :]).ljust(size, b"\0"))
    sizes = [len(f) for f in frames]
    first = 216  # 48 kbit/s
    total, starts, at = first + sum(sizes), [], first
    for n in sizes:
        starts.append(at)
        at += n
    toc = bytes(min(255, starts[len(starts) * i // 100] * 256 // total) if starts else 0 for i in range(100))
    table = b"Xing" + struct.pack(">III", 15, len(frames), total) + toc + struct.pack(">I", 100)
    silent = (bytes((0xFF, 0xFB, 3 << 4 | 8, 0xC0)) + EMPTY + table).ljust(first, b"\0")
    private = OWNER + len(payload).to_bytes(8)
    tag = b"PRIV" + from_syncsafe(len(private)) + b"\0\0" + private
    return b"ID3\x04\0\0" + from_syncsafe(len(tag)) + tag + silent + b"".join(frames)


def decode(media: bytes, seen: dict | None = None) -> bytes:
    """The payload that encode() stored."""
    seen = seen or parse(media)
    private = seen["tags"].get("PRIV", b"")
    data = b"".join(media[at + 6 + h["side"] : at + n] for at, n, h in seen["frames"])
    return data[: int.from_bytes(private[len(OWNER) :])] if private.startswith(OWNER) else data


def feature(seen: dict) -> str:
    vbr, seconds = seen["vbr"] or {}, seen["seconds"]
    offsets = hashlib.sha256(struct.pack(f">{len(seen['frames'])}Q", *[f[0] for f in seen["frames"]])).hexdigest()[:16]
    return f"frames={len(seen['frames'])};samples={seen['samples']};seconds={seconds.numerator}/{seconds.denominator};vbr={vbr.get('kind', 'none')}:{vbr.get('frames', 0)}:{vbr.get('bytes', 0)};crc={seen['checked'] - seen['bad']}/{seen['checked']};skipped={seen['skipped']};seek={offsets}"


def _media(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return encode(raw + bytes(-len(raw) % 64 if raw else 64))


to_media = texts_udf(lambda texts: pa.array(map(_media, texts), pa.binary()), T.BinaryType())


def with_media(docs: DataFrame, text: Column, name: str = "media") -> DataFrame:
    """Adds the binary column of MPEG audio that stores the text's bytes, padded to a positive multiple of 64."""
    return docs.withColumn(name, to_media(text))


READ = T.StructType([T.StructField(n, t) for n, t in (("n_frames", T.LongType()), ("samples", T.LongType()), ("seconds", T.DoubleType()), ("bad_checksums", T.LongType()), ("skipped_bytes", T.LongType()), ("offsets", T.ArrayType(T.LongType())), ("payload", T.BinaryType()), ("feature", T.StringType()))])


def _read(media: list[bytes | None]) -> pa.Array:
    out = []
    for m in media:
        seen = parse(m or b"")
        out.append((len(seen["frames"]), seen["samples"], float(seen["seconds"]), seen["bad"], seen["skipped"], [f[0] for f in seen["frames"]], decode(m or b"", seen), feature(seen)))
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.string()]
    return pa.StructArray.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], READ.names)


#: Parses any MPEG audio column.
read_media = texts_udf(_read, READ)


def media_digests(media: DataFrame) -> DataFrame:
    """id, n_bytes, and the digests of the payload read back from each row's media."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for i, n, m in zip(frame["id"], frame["n_bytes"], frame["media"], strict=True):
                seen = parse(m)
                payload = decode(m, seen)
                out.append((i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature(seen)))
            found = pd.DataFrame(out, columns=["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
            found["id"] = found["id"].astype("Int64")
            yield found

    return map_texts(media, read, "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", "media")


def op7_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "text")
    stored = written(with_media(docs, F.col("text")).select("id", "n_bytes", "media"), f"{workspace(spark, 'mpeg')}/media")
    return media_digests(stored).withColumnRenamed("id", "doc_id")
