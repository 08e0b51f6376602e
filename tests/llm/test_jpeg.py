import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from fathom.llm import jpeg


def payload(text):
    data = (text or "").encode()
    return data, data + b" " * (max(1, -(-len(data) // 192)) * 192 - len(data))


TEXTS = [None, "", " ", "x" * 191, "y" * 192, "z" * 193, "é日本" * 500, "\x00\xff\x7f" * 300, "q" * (192 * 8128 + 7), "".join(map(chr, range(1, 900)))]


def test_texts_come_back(spark):
    rows = [(k, t, "m", 1) for k, t in enumerate(TEXTS)] + [(None, "twice", "m", 1), (3, "twice", "m", 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, media string, `a.b` int")
    media = jpeg.encode_media(table)
    out = {(r["doc_id"], r["payload_sha256"]): r for r in jpeg.media_features(media).collect()}
    stored = {hashlib.sha256(r["media"]).hexdigest(): len(r["media"]) for r in media.collect()}
    assert len(out) == len(rows)
    for doc_id, text, *_ in rows:
        data, want = payload(text)
        r = out[doc_id, hashlib.sha256(want).hexdigest()]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"], r["error"]) == (len(data), len(want), zlib.crc32(want[-16:]), None)
        assert stored[r["media_sha256"]] == r["media_bytes"]
        assert (r["width"], r["height"]) == (1536, len(want) // 24)
    twice = [r for r in out.values() if r["n_bytes"] == 5]
    assert len(twice) == 2 and len({r["feature"] + r["media_sha256"] for r in twice}) == 1


def test_empty_and_damaged(spark):
    assert jpeg.media_features(jpeg.encode_media(spark.createDataFrame([], "doc_id long, text string"))).collect() == []
    whole = jpeg.encode_media(spark.createDataFrame([(1, "some words " * 90)], "doc_id long, text string")).collect()[0]["media"]
    progressive = whole.replace(b"\xff\xc0", b"\xff\xc2", 1)
    scan = bytearray(whole)
    scan[-6] ^= 0xFF if scan[-6] not in (0x00, 0xFF) else 0x11
    bad = [None, b"", b"text", whole[:200], whole[:-2], whole[:40], progressive, whole + b"x"]
    out = jpeg.media_features(spark.createDataFrame([(k, b) for k, b in enumerate(bad)] + [(99, bytes(whole))], "doc_id long, media binary")).collect()
    assert all((r["error"] is None) == (r["doc_id"] == 99) for r in out)
    assert all(r["payload_sha256"] is None for r in out if r["doc_id"] != 99)


class Bits:
    """A plain scan writer, code by code."""

    def __init__(self):
        self.bits = ""

    def put(self, value, n):
        self.bits += format(value, f"0{n}b") if n else ""

    def coded(self):
        bits = self.bits + "1" * (-len(self.bits) % 8)
        return bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")


def image(rng, width, height, sampling, interval, quantiser):
    """A baseline JPEG with AC terms, and its luminance DC grid by block row and column."""
    dc_table, dc = jpeg._huffman({k: 4 for k in range(12)})
    ac_table, ac = jpeg._huffman({0: 2, 0xF0: 5, **{r << 4 | s: 8 for r in range(8) for s in range(1, 11)}})
    wide, tall = max(h for h, _ in sampling), max(v for _, v in sampling)
    if len(sampling) == 1:
        wide = tall = 1
    units = (-(-height // (8 * tall)), -(-width // (8 * wide)))
    factors = sampling if len(sampling) > 1 else [(1, 1)]
    grid = np.zeros((units[0] * factors[0][1], units[1] * factors[0][0]), int)
    parts, bits, before, n = [], Bits(), [0] * len(factors), 0
    for y in range(units[0]):
        for x in range(units[1]):
            if interval and n and n % interval == 0:
                parts.append(bits.coded())
                bits, before = Bits(), [0] * len(factors)
            n += 1
            for c, (h, v) in enumerate(factors):
                for j in range(v):
                    for i in range(h):
                        value = rng.randrange(-1000, 1000) // quantiser
                        if c == 0:
                            grid[y * v + j, x * h + i] = value
                        d, before[c] = value - before[c], value
                        cat = abs(d).bit_length()
                        bits.put(*dc[cat])
                        bits.put(d if d >= 0 else d + (1 << cat) - 1, cat)
                        k = 1
                        while k < 64 and rng.random() < 0.7:
                            if rng.random() < 0.1 and k + 16 < 64:
                                bits.put(*ac[0xF0])
                                k += 16
                                continue
                            run, size = rng.randrange(min(8, 64 - k)), rng.randrange(1, 11)
                            bits.put(*ac[run << 4 | size])
                            bits.put(rng.randrange(1 << size), size)
                            k += run + 1
                        if k < 64:
                            bits.put(*ac[0])
    parts.append(bits.coded())
    scan = b"".join(p + (b"" if k == len(parts) - 1 else bytes([0xFF, 0xD0 + k % 8])) for k, p in enumerate(parts))
    seg = jpeg._segment
    head = b"\xff\xd8" + seg(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + seg(0xDB, b"\x10" + struct.pack(">64H", *[quantiser] * 64)) + seg(0xC4, b"\0" + dc_table + b"\x10" + ac_table)
    head += (seg(0xDD, struct.pack(">H", interval)) if interval else b"") + b"\xff" + seg(0xC0, struct.pack(">BHHB", 8, height, width, len(sampling)) + b"".join(bytes([k + 1, h << 4 | v, 0]) for k, (h, v) in enumerate(sampling)))
    head += seg(0xDA, bytes([len(sampling)]) + b"".join(bytes([k + 1, 0]) for k in range(len(sampling))) + b"\0\x3f\0")
    return head + scan + b"\xff\xd9", grid


@pytest.mark.parametrize("seed", range(4))
def test_any_baseline_scan(seed):
    rng = random.Random(seed)
    cases = [(1, 1, [(1, 1)], 0, 1), (70, 33, [(2, 2)], 0, 8), (50, 41, [(1, 1)] * 3, 3, 2), (100, 90, [(2, 2), (1, 1), (1, 1)], 2, 5), (64, 17, [(2, 1), (1, 1), (1, 1)], 0, 16), (33, 80, [(1, 2), (1, 1), (1, 1), (1, 2)], 1, 3)]
    made = [image(rng, *c) for c in cases]
    for (width, height, sampling, _, quantiser), (_, grid), got in zip(cases, made, jpeg.thumbnails([m for m, _ in made])):
        frames, (thumb,) = got
        if len(sampling) == 1:
            high, wide = -(-height // 8), -(-width // 8)
        else:
            high = -(-height * sampling[0][1] // (8 * max(v for _, v in sampling)))
            wide = -(-width * sampling[0][0] // (8 * max(h for h, _ in sampling)))
        x = grid[:high, :wide] * quantiser / 8
        want = np.clip(np.sign(x) * np.floor(np.abs(x) + 0.5) + 128, 0, 255)
        assert (frames[0].width, frames[0].height) == (width, height)
        assert thumb.shape == want.shape and (thumb == want).all()
