"""Media that are valid but unusual, damaged, or cut off: a defined null, never an error."""

import random
import struct
import zlib

import pytest

from cellweave.llm import media

PAYLOAD = bytes(range(256)) * 16


def png(rows, width=64, height=64, depth=8, color=0, interlace=0, stream=None, head=None):
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    head = struct.pack(">IIBBBBB", width, height, depth, color, 0, 0, interlace) if head is None else head
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows) if stream is None else stream) + chunk(b"IEND", b"")


ROWS = b"".join(b"\0" + PAYLOAD[k : k + 64] for k in range(0, 4096, 64))
RLE = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 1078 + 8, 0, 0, 1078, 40, 64, 64, 1, 8, 1, 8, 2835, 2835, 256, 0) + media._PALETTE + b"\x40\x01\0\0\0\x01\0\x01"
ODD = {
    "interlaced": png(ROWS, interlace=1),
    "bad deflate": png(ROWS, stream=b"\x78\x9c" + b"\xff" * 40),
    "stream cut off": png(ROWS, stream=zlib.compress(ROWS)[:-9]),
    "too few rows": png(ROWS[:-65]),
    "too many rows": png(ROWS + bytes(65)),
    "bomb": png(bytes(1 << 26)),
    "bomb with a large header": png(bytes(1 << 20), width=1 << 20, height=1 << 30),
    "no width": png(ROWS, width=0),
    "colours": png(ROWS, color=2),
    "filtered": png(b"\x01" + ROWS[1:]),
    "short header": png(ROWS, head=b"\0\0\0\x40"),
    "rle8 bitmap": RLE,
    "adpcm wav": media.encode(PAYLOAD, "wav").replace(struct.pack("<IHH", 16, 1, 1), struct.pack("<IHH", 16, 2, 1)),
    "16-bit wav": media.encode(PAYLOAD, "wav").replace(struct.pack("<HH", 1, 8), struct.pack("<HH", 2, 16)),
}


@pytest.mark.parametrize("name", ODD)
def test_unusual_items_have_a_type_but_no_payload(name):
    blob = ODD[name]
    found = media.sniff(blob)
    assert found and found[0][1:] == (0, len(blob))
    assert media.samples(blob, *found[0]) is None


def test_plain_png_still_reads():
    assert media.samples(png(ROWS), "png", 0, len(png(ROWS))) == PAYLOAD


def test_damaged_items_raise_nothing():
    rng = random.Random(8)
    whole = [media.encode(PAYLOAD, k) for k in media.KINDS] + list(ODD.values()) + [b"GIF89a" + bytes(rng.choices(range(256), k=60)), b"\xff\xd8\xff\xe0" + bytes(60)]
    for _ in range(1500):
        blob = bytearray(rng.choice(whole)[: rng.choice((20, 60, 1100, 1 << 20))])
        for _ in range(rng.randint(0, 6)):
            blob[rng.randrange(min(len(blob), 1100))] = rng.choice((0, 1, 8, 127, 255, rng.randrange(256)))
        blob = bytes(blob)
        for item in media.sniff(blob):
            assert item[1] + item[2] <= len(blob)
            media.samples(blob, *item)


def test_frame_of_odd_items(spark):
    rows = [(k, blob, "image/png") for k, blob in enumerate(ODD.values())] + [(99, media.encode(PAYLOAD, "bmp"), "image/png"), (100, None, None), (101, b"", "image/png")]
    got = {r["doc_id"]: r for r in media.inspect(spark.createDataFrame(rows, "doc_id long, media binary, declared string"), keep=("doc_id",)).collect()}
    assert all(got[k]["payload"] is None and got[k]["feature"] is None and got[k]["detected"] for k in range(len(ODD)))
    assert bytes(got[99]["payload"]) == PAYLOAD and got[99]["corrected"]
    assert got[100]["detected"] is None and got[101]["detected"] is None
