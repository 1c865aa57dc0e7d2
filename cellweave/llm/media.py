"""Media columns: lossless 8-bit containers, and sniffing of what a binary column really holds.

An Aho-Corasick automaton finds the magic bytes of all formats in one pass over a blob.  At each hit a format validator walks the
structure (chunk lengths, header sizes, checksums) and gives the item's exact length, so a chance hit is no find.  A find at offset
0 that fills the blob corrects the declared type; valid items elsewhere are carved out as embedded media.

A payload is stored as WAV, AU, BMP or PNG samples of 8 bits, by its checksum, so equal payloads have equal media.  Null texts are
empty; an empty text is stored as 64 zero bytes.  Blobs that hold no known format have a null type and no payload.  Valid media whose
samples are not plain 8-bit ones have a type, but null payload and feature: other depths or colours, compressed WAV or BMP, interlaced
or filtered PNG, PNG whose stream is damaged or does not inflate to exactly the rows its header declares, items cut off before their
samples end, and images of over MOST_SAMPLES samples, which one value of a binary column cannot hold.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.runtime import read, ship_package, slices, texts_of

BLOCK = 64
KINDS = ("wav", "au", "bmp", "png")
MIME = {"wav": "audio/wav", "au": "audio/basic", "bmp": "image/bmp", "png": "image/png", "gif": "image/gif", "jpeg": "image/jpeg"}
#: Fixed: the magic bytes of each format.
MAGIC = {b"RIFF": "wav", b".snd": "au", b"BM": "bmp", b"\x89PNG\r\n\x1a\n": "png", b"GIF87a": "gif", b"GIF89a": "gif", b"\xff\xd8\xff": "jpeg"}
#: Samples that a binary value can hold.
MOST_SAMPLES = 1 << 30
_PALETTE = b"".join(bytes((k, k, k, 0)) for k in range(256))


def pad(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of BLOCK."""
    return data + bytes(max(BLOCK, -(-len(data) // BLOCK) * BLOCK) - len(data))


def encode(payload: bytes, kind: str) -> bytes:
    """payload, a positive multiple of BLOCK bytes, as samples of this kind of file."""
    n = len(payload)
    if kind == "wav":
        return b"RIFF" + struct.pack("<I4s4sIHHIIHH4sI", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", n) + payload
    if kind == "au":
        return struct.pack(">4s5I", b".snd", 24, n, 2, 8000, 1) + payload
    if kind == "bmp":
        return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 1078 + n, 0, 0, 1078, 40, BLOCK, n // BLOCK, 1, 8, 0, n, 2835, 2835, 256, 0) + _PALETTE + payload
    rows = np.zeros((n // BLOCK, BLOCK + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK)
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", BLOCK, n // BLOCK, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def _wav(b: bytes, at: int) -> int | None:
    if len(b) - at < 44 or b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")
    k, names = at + 12, []
    while k + 8 <= min(end, len(b)):
        names.append(b[k : k + 4])
        k += 8 + int.from_bytes(b[k + 4 : k + 8], "little")
        k += (k - at) % 2
    return end - at if end <= len(b) and k == end and {b"fmt ", b"data"} <= set(names) else None


def _au(b: bytes, at: int) -> int | None:
    if len(b) - at < 24:
        return None
    head, n, code, rate, channels = struct.unpack_from(">5I", b, at + 4)
    return head + n if 24 <= head <= 1 << 16 and 1 <= code <= 27 and 0 < rate < 1 << 20 and 1 <= channels <= 64 and n != 0xFFFFFFFF and at + head + n <= len(b) else None


def _bmp(b: bytes, at: int) -> int | None:
    if len(b) - at < 54:
        return None
    total, r1, r2, start, head, width, height, planes, bits = struct.unpack_from("<IHHIIiiHH", b, at + 2)
    if r1 or r2 or head not in (40, 52, 56, 108, 124) or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or not height or at + total > len(b) or start < 14 + head:
        return None
    return total if start + (width * bits + 31) // 32 * 4 * abs(height) <= total or struct.unpack_from("<I", b, at + 30)[0] else None


def _png(b: bytes, at: int) -> int | None:
    k = at + 8
    while k + 12 <= len(b):
        n, name = int.from_bytes(b[k : k + 4], "big"), b[k + 4 : k + 8]
        if k + 12 + n > len(b) or (k == at + 8) != (name == b"IHDR") or zlib.crc32(b[k + 4 : k + 8 + n]) != int.from_bytes(b[k + 8 + n : k + 12 + n], "big"):
            return None
        k += 12 + n
        if name == b"IEND":
            return k - at
    return None


def _gif(b: bytes, at: int) -> int | None:
    if len(b) - at < 14:
        return None
    table = lambda flags: 3 * 2 ** ((flags & 7) + 1) if flags & 128 else 0
    k = at + 13 + table(b[at + 10])
    while k < len(b):
        if b[k] == 0x3B:
            return k + 1 - at
        if b[k] == 0x21:
            k += 2
        elif b[k] == 0x2C and k + 10 < len(b):
            k += 11 + table(b[k + 9])
        else:
            return None
        while k < len(b) and b[k]:
            k += 1 + b[k]
        k += 1
    return None


def _jpeg(b: bytes, at: int) -> int | None:
    k = at + 2
    while k + 4 <= len(b) and b[k] == 0xFF:
        mark = b[k + 1]
        if mark == 0xD9:
            return k + 2 - at
        if mark in (0x00, 0xFF, 0xD8):
            return None
        k += 2 if 0xD0 <= mark <= 0xD7 else 2 + int.from_bytes(b[k + 2 : k + 4], "big")
        if mark == 0xDA:  # entropy-coded data up to the next marker that is neither stuffed nor a restart
            while (k := b.find(b"\xff", k)) >= 0 and k + 1 < len(b) and (b[k + 1] == 0 or 0xD0 <= b[k + 1] <= 0xD7):
                k += 2
            if k < 0:
                return None
    return k + 2 - at if b[k : k + 2] == b"\xff\xd9" else None


VALID = {"wav": _wav, "au": _au, "bmp": _bmp, "png": _png, "gif": _gif, "jpeg": _jpeg}


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for magic, kind in MAGIC.items():
        a.add_word(magic.decode("latin-1"), (kind, len(magic)))
    a.make_automaton()
    return a


def sniff(blob: bytes) -> list[tuple[str, int, int]]:
    """(kind, offset, length) of every valid item in order; what lies inside an earlier uncompressed item follows it."""
    out = []
    for end, (kind, n) in automaton().iter(blob.decode("latin-1")):
        at = end + 1 - n
        length = VALID[kind](blob, at)
        if length:
            out.append((kind, at, length))
    return sorted(out, key=lambda f: (f[1], -f[2]))


def samples(blob: bytes, kind: str, at: int, length: int) -> bytes | None:
    """The stored 8-bit samples of a valid item of one of KINDS; None for what does not hold plain 8-bit samples as a whole."""
    whole = lambda start, n: blob[start : start + n] if 0 <= n <= MOST_SAMPLES and start + n <= at + length else None
    if kind == "au":
        head, n, code = struct.unpack_from(">3I", blob, at + 4)
        return whole(at + head, n) if code in (1, 2, 27) else None
    if kind == "bmp":
        start, width, height, bits, packing = *struct.unpack_from("<I", blob, at + 10), *struct.unpack_from("<ii", blob, at + 18), *struct.unpack_from("<HI", blob, at + 28)
        return whole(at + start, width * abs(height)) if bits == 8 and packing == 0 and width % 4 == 0 else None
    if kind == "wav":
        k, plain = at + 12, False
        while k + 8 <= at + length:
            name, n = blob[k : k + 4], int.from_bytes(blob[k + 4 : k + 8], "little")
            if name == b"fmt ":
                plain = n >= 16 and blob[k + 8 : k + 10] == b"\1\0" and blob[k + 22 : k + 24] == b"\x08\0"
            if name == b"data":
                return whole(k + 8, n) if plain else None
            k += 8 + n + n % 2
        return None
    if kind == "png":
        if struct.unpack_from(">I", blob, at + 8)[0] != 13:
            return None
        width, height, *form = struct.unpack_from(">IIBBBBB", blob, at + 16)
        if form != [8, 0, 0, 0, 0] or not 0 < (width + 1) * height <= MOST_SAMPLES:
            return None
        k, parts = at + 8, []
        while k < at + length:
            n = int.from_bytes(blob[k : k + 4], "big")
            if blob[k + 4 : k + 8] == b"IDAT":
                parts.append(blob[k + 8 : k + 8 + n])
            k += 12 + n
        inflate = zlib.decompressobj()
        try:
            rows = inflate.decompress(b"".join(parts), (width + 1) * height + 1)
        except zlib.error:
            return None
        if len(rows) != (width + 1) * height or not inflate.eof:
            return None
        rows = np.frombuffer(rows, np.uint8).reshape(height, width + 1)
        return None if rows[:, 0].any() else np.ascontiguousarray(rows[:, 1:]).tobytes()
    return None


def feature(payload: bytes, kind: str) -> str:
    """Kind, mean, deviation, zero share and entropy in bits of the samples."""
    hist = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p = hist / max(len(payload), 1)
    mean = float(p @ np.arange(256))
    spread = float(np.sqrt(max(p @ (np.arange(256) - mean) ** 2, 0)))
    q = p[p > 0]
    return f"{kind};mean={mean:.4f};sd={spread:.4f};zero={p[0]:.4f};bits={float(-(q * np.log2(q)).sum()):.4f}"


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared: str = "audio/wav") -> DataFrame:
    """(id, n_bytes, declared, media): every text as media; declared is what an upload would claim for all of them."""
    ship_package(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw = [t.encode() for t in texts_of(batch.column(1))]
            media = []
            for p in map(pad, raw):
                media.append(encode(p, KINDS[zlib.crc32(p) % len(KINDS)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array([declared] * len(raw)), pa.array(media, pa.binary())], names=[id_col, "n_bytes", "declared", "media"])

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, declared string, media binary")


def inspect(stored: DataFrame, keep: tuple[str, ...] = ("doc_id", "n_bytes"), media_col: str = "media", declared_col: str = "declared") -> DataFrame:
    """keep, media, detected (MIME type or null), corrected (it differs from the declared), payload, feature, embedded (kind, offset, length)."""
    ship_package(stored.sparkSession)
    found_type = pa.list_(pa.struct([("kind", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
    k = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, k):
            detected, corrected, payloads, features, embedded = [], [], [], [], []
            for blob, declared in zip(batch.column(k).to_pylist(), batch.column(k + 1).to_pylist(), strict=True):
                found = sniff(blob) if blob else []
                whole = next((f for f in found if f[1] == 0 and f[2] == len(blob)), None)
                detected.append(MIME[whole[0]] if whole else None)
                corrected.append(whole is not None and MIME[whole[0]] != declared)
                payloads.append(samples(blob, *whole) if whole else None)
                features.append(feature(payloads[-1], whole[0]) if payloads[-1] is not None else None)
                embedded.append([{"kind": f[0], "offset": f[1], "length": f[2]} for f in found if f is not whole])
            columns = [*batch.columns[: k + 1], pa.array(detected, pa.string()), pa.array(corrected), pa.array(payloads, pa.binary()), pa.array(features, pa.string()), pa.array(embedded, found_type)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, media_col, "detected", "corrected", "payload", "feature", "embedded"])

    kinds = ", ".join(f"`{c}` {stored.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{kinds}, `{media_col}` binary, detected string, corrected boolean, payload binary, feature string, embedded array<struct<kind:string,offset:long,length:long>>"
    return stored.select(*keep, media_col, declared_col).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    seen = inspect(store(read(spark, sf_dir, "documents")))
    return seen.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr(f"substring(payload, length(payload) - {BLOCK - 1}, {BLOCK})")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "detected",
        "corrected",
        F.size("embedded").cast("long").alias("n_embedded"),
    )
