"""Texts as baseline JPEG media columns, and features of any baseline JPEG column.

Writing: a text's bytes, padded with spaces to a positive multiple of ``WIDTH``,
are the samples of a grey image of ``WIDTH`` blocks a row, each sample one flat
8 x 8 block. With a DC quantiser of 8 a flat block's DC coefficient is its
sample less 128, exactly, so nothing is lost. Each row of blocks is a restart
interval. A frame has at most ``FRAME_ROWS`` rows, as JPEG's height is 16 bits;
a longer text is several frames, one stream after another. A comment holds the
unpadded length.

Reading: markers are parsed (tables, frame, restart interval, scan), byte
stuffing is taken out, and Huffman codes are decoded in numpy, every restart
interval of every image of a batch being a lane and all lanes going forward
together, a symbol a step. AC codes are read and passed over; luminance DC
terms become thumbnails of one sample a block. It takes any baseline scan: grey
or colour with subsampling, with or without restart intervals.

Defined cases: a null text is an empty one and gives one row of spaces; equal
texts give equal media; repeated rows and ids stay rows of their own; an empty
table gives no rows; columns other than those read are ignored. Media that
are null, not baseline (progressive, arithmetic, 12 bits), cut off or damaged
give null features and the reason in ``error``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches
from .spans import gathered
from .textkit import release, text_buffer

WIDTH = 192
#: Rows of blocks in a frame: 8 * 8128 < 65536.
FRAME_ROWS = 8128
#: Rows of blocks that are coded at once.
PIECE_ROWS = 4096
#: Lengths of the DC codes of categories 0 to 8, in code order by length: text's differences are mostly of 2 to 7 bits.
DC_LENGTHS = {0: 4, 1: 4, 2: 3, 3: 3, 4: 3, 5: 2, 6: 3, 7: 4, 8: 5}


def _huffman(lengths: dict[int, int]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """A DHT table's counts and symbols, and each symbol's (code, length)."""
    by = sorted((n, s) for s, n in lengths.items())
    counts = bytes(sum(n == k for n, _ in by) for k in range(1, 17))
    code, last, codes = 0, by[0][0], {}
    for n, s in by:
        code <<= n - last
        codes[s] = (code, n)
        code, last = code + 1, n
    return counts + bytes(s for _, s in by), codes


_DC_TABLE, _DC_CODES = _huffman(DC_LENGTHS)
_AC_TABLE, _AC_CODES = _huffman({0: 1})  # end of block is all there is


def _block_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for a block whose DC difference is k - 255."""
    bits, size = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for d in range(-255, 256):
        cat = abs(d).bit_length()
        code, n = _DC_CODES[cat]
        code = (code << cat) | (d if d >= 0 else d + (1 << cat) - 1)
        end, m = _AC_CODES[0]
        bits[d + 255], size[d + 255] = (code << m) | end, n + cat + m
    return bits, size


_BITS, _SIZE = _block_codes()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_START = b"\xff\xd8"
_END = b"\xff\xd9"
_TABLES = _segment(0xDB, b"\0" + bytes([8] + [1] * 63)) + _segment(0xC4, b"\x00" + _DC_TABLE) + _segment(0xC4, b"\x10" + _AC_TABLE) + _segment(0xDD, struct.pack(">H", WIDTH)) + _segment(0xDA, b"\1\1\0\0\x3f\0")


def _header(rows: int, n_bytes: int) -> bytes:
    return _START + _segment(0xFE, str(n_bytes).encode()) + _segment(0xC0, struct.pack(">BHHB", 8, 8 * rows, 8 * WIDTH, 1) + b"\1\x11\0") + _TABLES


def code_rows(samples: np.ndarray, place: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of rows of samples as restart intervals: stuffed, each followed by its marker unless last; place counts rows in the frame."""
    diff = np.diff(samples.astype(np.int16), axis=1, prepend=np.int16(128)) + 255
    size, bits = _SIZE[diff], _BITS[diff].astype(np.uint64)
    for _ in range(2):  # four codes of 14 bits at most side by side, so that with a byte's rest they fit in 64 bits
        bits = bits[:, ::2] << size[:, 1::2].astype(np.uint64) | bits[:, 1::2]
        size = size[:, ::2] + size[:, 1::2]
    end = np.cumsum(size, axis=1)
    row_bytes = (end[:, -1] + 7) >> 3
    base = np.concatenate([[0], np.cumsum(row_bytes)])
    pos = (end - size + 8 * base[:-1, None]).ravel()
    at = pos >> 3
    wide = (bits.ravel() << (64 - (pos & 7) - size.ravel()).astype(np.uint64)).byteswap().view(np.uint8).reshape(-1, 8)
    n = int(base[-1])
    out = np.zeros(n + 8, np.float64)
    for k in range(8):  # bits of different codes never meet, so sums are ORs
        part = np.bincount(at, wide[:, k])
        out[k : k + len(part)] += part
    out = out[:n].astype(np.uint8)
    out[base[1:] - 1] |= ((1 << (8 * row_bytes - end[:, -1])) - 1).astype(np.uint8)  # filled with ones
    room = 1 + (out == 255)
    room[base[1:] - 1] += 2 * ~last
    to = np.concatenate([[0], np.cumsum(room)])
    coded = np.zeros(int(to[-1]), np.uint8)
    coded[to[:-1]] = out
    marks = to[base[1:]][~last]
    coded[marks - 2] = 255
    coded[marks - 1] = 0xD0 + place[~last] % 8
    return coded, to[base]


def _encoded(col: pa.Array) -> list[bytes]:
    data, offs = text_buffer(col)
    size = np.diff(offs)
    rows = np.maximum(1, -(-size // WIDTH))
    first = np.concatenate([[0], np.cumsum(rows)])
    samples = np.full(int(first[-1]) * WIDTH, 32, np.uint8)
    for k in range(len(size)):
        samples[first[k] * WIDTH : first[k] * WIDTH + size[k]] = data[offs[k] : offs[k + 1]]
    samples = samples.reshape(-1, WIDTH)
    in_text = np.arange(len(samples)) - np.repeat(first[:-1], rows)
    place = in_text % FRAME_ROWS
    last = place == FRAME_ROWS - 1
    last[first[1:] - 1] = True
    parts, bounds, n = [], [np.zeros(1, np.int64)], 0
    for k in range(0, len(samples), PIECE_ROWS):
        s = slice(k, k + PIECE_ROWS)
        coded, at = code_rows(samples[s], place[s], last[s])
        parts.append(coded)
        bounds.append(at[1:] + n)
        n += len(coded)
    coded = np.concatenate(parts).tobytes() if parts else b""
    bound = np.concatenate(bounds)
    out = []
    for k in range(len(size)):
        media = []
        for r in range(first[k], first[k + 1], FRAME_ROWS):
            to = min(r + FRAME_ROWS, first[k + 1])
            media += [_header(int(to - r), int(size[k])), coded[bound[r] : bound[to]], _END]
        out.append(b"".join(media))
    return out


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, media of each row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in _pieces(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_encoded(part.column(1)), pa.binary())], names=["doc_id", "media"])
            release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, media binary")


#: Bytes of a batch's column that are worked on at once; a longer value is worked on alone.
PIECE_BYTES = 4 << 20


def _pieces(batch: pa.RecordBatch):
    from .textkit import chunks

    _, offs = text_buffer(batch.column(1))
    for i, j in chunks(offs, PIECE_BYTES):
        yield batch.slice(i, j - i)


# --- reading ------------------------------------------------------------------


class Damaged(ValueError):
    """Media that can't be read, and why."""


@dataclass
class Frame:
    height: int
    width: int
    comment: bytes
    quantiser: int  # of luminance DC
    #: Of each component of the scan: (h, v, DC table, AC table); tables as DHT bytes.
    components: tuple
    interval: int
    #: Bounds of the restart intervals' bytes in the media.
    lanes: list[tuple[int, int]]

    @property
    def luminance(self) -> tuple[int, int]:
        """Rows and columns of luminance blocks that the image covers."""
        if len(self.components) == 1:
            return -(-self.height // 8), -(-self.width // 8)
        h, v = self.components[0][:2]
        tall, wide = max(c[1] for c in self.components), max(c[0] for c in self.components)
        return -(-self.height * v // (8 * tall)), -(-self.width * h // (8 * wide))

    @property
    def units(self) -> tuple[int, int]:
        """Rows and columns of MCUs."""
        if len(self.components) == 1:
            return self.luminance
        tall, wide = max(c[1] for c in self.components), max(c[0] for c in self.components)
        return -(-self.height // (8 * tall)), -(-self.width // (8 * wide))


def parse(media: bytes, marks: np.ndarray | None = None) -> list[Frame]:
    """The frames of a stream of baseline JPEGs. marks: places of the bytes 0xFF in it."""
    if marks is None:
        marks = np.flatnonzero(np.frombuffer(media, np.uint8) == 255)
    frames, at = [], 0
    while at < len(media):
        if media[at : at + 2] != _START:
            raise Damaged("no start of image")
        at += 2
        tables, quantisers, frame, comment, interval = {}, {}, None, b"", 0
        while True:
            if at + 4 > len(media) or media[at] != 0xFF:
                raise Damaged("no marker")
            marker = media[at + 1]
            if marker == 0xFF:  # fill
                at += 1
                continue
            n = int.from_bytes(media[at + 2 : at + 4], "big")
            body = media[at + 4 : at + 2 + n]
            if n < 2 or len(body) != n - 2:
                raise Damaged("cut off")
            at += 2 + n
            try:
                if marker == 0xDB:
                    while body:
                        wide = body[0] >> 4
                        quantisers[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                        body = body[1 + 64 * (1 + wide) :]
                elif marker == 0xC4:
                    while body:
                        m = 17 + sum(body[1:17])
                        if len(body) < m:
                            raise Damaged("short table")
                        tables[body[0]] = body[1:m]
                        body = body[m:]
                elif marker == 0xDD:
                    interval = int.from_bytes(body[:2], "big")
                elif marker == 0xFE:
                    comment = body
                elif marker in (0xC0, 0xC1):
                    depth, height, width, parts = struct.unpack(">BHHB", body[:6])
                    if depth != 8 or not height or not width:
                        raise Damaged("not 8 bits, or without a size")
                    frame = height, width, {body[6 + 3 * k]: (body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(parts)}
                elif 0xC2 <= marker <= 0xCF and marker != 0xC8:
                    raise Damaged("not baseline")
                elif marker == 0xDA:
                    break
            except (struct.error, IndexError) as e:
                raise Damaged("short segment") from e
        try:
            height, width, parts = frame
            chosen = [(body[1 + 2 * k], body[2 + 2 * k]) for k in range(body[0])]
            if len(chosen) != len(parts):
                raise Damaged("components in several scans")
            components = tuple((*(parts[c][:2] if len(chosen) > 1 else (1, 1)), tables[t >> 4], tables[0x10 | t & 15]) for c, t in chosen)
            quantiser = quantisers[parts[chosen[0][0]][2]]
        except (TypeError, KeyError, IndexError) as e:
            raise Damaged("scan without its tables") from e
        if any(not (1 <= c[k] <= 4) for c in components for k in (0, 1)):
            raise Damaged("sampling factor")
        lanes, begin = [], at
        for k in range(int(np.searchsorted(marks, at)), len(marks)):
            p = int(marks[k])
            kind = media[p + 1] if p + 1 < len(media) else 0xD9
            if kind == 0 or kind == 0xFF or p < begin:
                continue
            lanes.append((begin, p))
            begin = p + 2
            if not 0xD0 <= kind <= 0xD7:
                break
        else:
            raise Damaged("cut off")
        if kind != 0xD9:
            raise Damaged("a second scan")
        at = begin
        f = Frame(height, width, comment, quantiser, components, interval, lanes)
        units = f.units[0] * f.units[1]
        if len(lanes) != (-(-units // interval) if interval else 1):
            raise Damaged("restart intervals")
        frames.append(f)
    if not frames:
        raise Damaged("empty")
    return frames


@lru_cache(maxsize=64)
def _lookup(table: bytes) -> np.ndarray:
    """By the next 16 bits: symbol << 8 | length of the code, 0 where there is none."""
    out, code, at = np.zeros(1 << 16, np.uint32), 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            lo = code << (16 - length)
            out[lo : lo + (1 << (16 - length))] = table[at] << 8 | length
            code, at = code + 1, at + 1
        code <<= 1
    return out


def decode_lanes(data: np.ndarray, bounds: np.ndarray, units: np.ndarray, components: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Luminance DC coefficients of restart intervals with the same components, lane after lane, and which lanes came out whole.

    data: the lanes' bytes without stuffing, bounds: theirs in it, units: the MCUs of each.
    """
    blocks = np.array([k for k, c in enumerate(components) for _ in range(c[0] * c[1])])  # component of each block of an MCU
    per = len(blocks)
    tables = np.concatenate([t for c in components for t in (_lookup(c[2]), _lookup(c[3]))])
    first = np.concatenate([[0], np.cumsum(units * int((blocks == 0).sum()))])
    out = np.zeros(int(first[-1]), np.int32)
    padded = np.append(data, np.zeros(8, np.uint8)).astype(np.uint64)
    window = np.zeros(len(data) + 1, np.uint64)  # the 48 bits from each byte on, at the top
    for k in range(6):
        window |= padded[k : k + len(window)] << np.uint64(56 - 8 * k)
    before = np.zeros((len(units), len(components)), np.int32)
    sound = np.ones(len(units), bool)
    lane = np.flatnonzero(units > 0)  # lanes at work: those that end leave
    p, end, total, to = 8 * bounds[:-1][lane], 8 * bounds[1:][lane], units[lane] * per, first[lane]
    done, k = np.zeros(len(lane), np.int64), np.zeros(len(lane), np.int64)
    while len(lane):
        part = blocks[done % per]
        dc = k == 0
        w = window[p >> 3] << (p & 7).astype(np.uint64)
        entry = tables[((2 * part + ~dc) << 16) + (w >> np.uint64(48)).astype(np.int64)].astype(np.int64)
        length, symbol = entry & 255, entry >> 8
        extra = symbol & 15
        bits = ((w << length.astype(np.uint64)) >> np.uint64(48)).astype(np.int64) >> (16 - extra)
        p = p + length + extra
        if dc.any():
            d = np.flatnonzero(dc)
            v, m = bits[d], extra[d]
            before[lane[d], part[d]] += np.where((m > 0) & (v < (1 << m) >> 1), v - (1 << m) + 1, v).astype(np.int32)
            y = d[part[d] == 0]
            out[to[y]] = before[lane[y], 0]
            to[y] += 1
        k = np.where(dc, 1, np.where(symbol == 0, 64, k + (symbol >> 4) + 1))
        bad = (length == 0) | (p > end) | (k > 64) | (dc & (symbol > 11))
        full = k >= 64
        k[full] = 0
        done += full
        gone = bad | (done == total)
        if gone.any():
            sound[lane[bad]] = False
            stay = ~gone
            lane, p, end, total, to, done, k = (x[stay] for x in (lane, p, end, total, to, done, k))
    return out, sound


@lru_cache(maxsize=16)
def _flat_lookup(dc: bytes, ac: bytes) -> np.ndarray:
    """By the next 16 bits, for a block that has a DC code and the end of block in them: (DC difference + 4096) << 8 | bits; 0 for other blocks."""
    code, after = _lookup(dc), _lookup(ac)
    w = np.arange(1 << 16, dtype=np.int64)
    length, extra = (code & 255).astype(np.int64), (code >> 8 & 15).astype(np.int64)
    ok = (length > 0) & (code >> 8 < 12) & (length + extra < 16)
    n = np.where(ok, length + extra, 0)
    v = (w >> (16 - n)) & ((1 << extra) - 1)
    v = np.where((extra > 0) & (v < (1 << extra) >> 1), v - (1 << extra) + 1, v)
    end = after[(w << n) & 0xFFFF].astype(np.int64)
    total = n + (end & 255)
    ok &= (end & 255 > 0) & (end >> 8 == 0) & (total <= 16)
    return np.where(ok, (v + 4096) << 8 | total, 0).astype(np.int32)


def decode_flat(data: np.ndarray, bounds: np.ndarray, units: np.ndarray, dc: bytes, ac: bytes) -> tuple[np.ndarray, np.ndarray]:
    """As decode_lanes, for one component of flat blocks, a block a step; lanes with other blocks come out as not whole."""
    table = _flat_lookup(dc, ac)
    first = np.concatenate([[0], np.cumsum(units)])
    out = np.zeros(int(first[-1]), np.int32)
    sound = np.ones(len(units), bool)
    for lo in range(0, len(units), LANES):
        part = slice(lo, min(lo + LANES, len(units)))
        at = bounds[lo : part.stop + 1]
        _flat_lanes(data[at[0] : at[-1]], at - at[0], units[part], first[part] - first[lo], table, out[first[lo] : first[part.stop]], sound[part])
    total = np.concatenate([[0], np.cumsum(out, dtype=np.int64)])
    held = units > 0
    return (total[1:] - np.repeat(total[first[:-1][held]], units[held])).astype(np.int32), sound


#: Flat lanes that go forward together: their bytes and results stay in a core's cache.
LANES = 3072


def _flat_lanes(data: np.ndarray, bounds: np.ndarray, units: np.ndarray, first: np.ndarray, table: np.ndarray, out: np.ndarray, sound: np.ndarray) -> None:
    """DC differences into out, which lanes are flat into sound."""
    order = np.argsort(-units, kind="stable")
    size = units[order]
    p, to = 8 * bounds[:-1][order], first[order]
    padded = np.append(data, np.zeros(40, np.uint8)).astype(np.uint32)
    window = padded[:-2] << np.uint32(16) | padded[1:-1] << np.uint32(8) | padded[2:]  # 24 bits
    most = 8 * len(data) + 8
    flat = np.ones(len(units), bool)
    alive = len(size) - np.searchsorted(size[::-1], np.arange(1, int(size[0]) + 1), "left")
    for k, m in enumerate(alive):
        q = p[:m]
        e = table[window[q >> 3] >> (8 - (q & 7)).astype(np.uint32) & np.uint32(0xFFFF)]
        if not e.all():
            flat[:m] &= e > 0
            np.minimum(q, most, out=q)
        q += e & 255
        out[to[:m] + k] = (e >> 8) - 4096
    sound[order] = flat & (p <= 8 * bounds[1:][order])


def _decoded(data: np.ndarray, bounds: np.ndarray, units: np.ndarray, components: tuple) -> tuple[np.ndarray, np.ndarray]:
    """decode_lanes, with lanes of flat grey blocks read a block a step."""
    if len(components) > 1:
        return decode_lanes(data, bounds, units, components)
    dc, sound = decode_flat(data, bounds, units, *components[0][2:])
    rest = np.flatnonzero(~sound)
    if len(rest):
        part, at = gathered(data, bounds[rest], np.diff(bounds)[rest])
        again, sound[rest] = decode_lanes(part, at, units[rest], components)
        first = np.concatenate([[0], np.cumsum(units)])
        dc[np.repeat(first[rest] - np.cumsum(units[rest]) + units[rest], units[rest]) + np.arange(len(again))] = again
    return dc, sound


def thumbnails(media: list[bytes | None]) -> list[tuple[list[Frame], list[np.ndarray]] | Damaged]:
    """Frames and DC-only luminance thumbnails (uint8, a sample a block) of each of media, or why there are none."""
    out: list = []
    groups: dict = {}
    for k, m in enumerate(media):
        try:
            if m is None:
                raise Damaged("null")
            marks = np.flatnonzero(np.frombuffer(m, np.uint8) == 255)
            frames = parse(m, marks)
        except Damaged as e:
            out.append(e)
            continue
        out.append((frames, [None] * len(frames)))
        for j, f in enumerate(frames):
            groups.setdefault(f.components, []).append((k, j))
    for components, members in groups.items():
        parts, bounds, units = [], [np.zeros(1, np.int64)], []
        n = 0
        for k, j in members:
            f = out[k][0][j]
            lo, hi = f.lanes[0][0], f.lanes[-1][1]
            scan = np.frombuffer(media[k], np.uint8)[lo:hi]
            # stuffing and the markers between intervals go
            drop = np.zeros(len(scan), bool)
            drop[1:] = (scan[1:] == 0) & (scan[:-1] == 255)
            ends = np.array([b for _, b in f.lanes], np.int64) - lo
            drop[ends[:-1]] = drop[ends[:-1] + 1] = True
            parts.append(scan[~drop])
            at = np.concatenate([[0], np.cumsum(~drop)])
            bounds.append(n + at[ends])
            n += int(at[-1])
            total, step = f.units[0] * f.units[1], f.interval or f.units[0] * f.units[1]
            u = np.full(len(ends), step, np.int64)
            u[-1] = total - step * (len(ends) - 1)
            units.append(u)
        units = np.concatenate(units)
        dc, sound = _decoded(np.concatenate(parts), np.concatenate(bounds), units, components)
        h, v = components[0][:2]
        luma = h * v
        lane = at = 0
        for k, j in members:
            if isinstance(out[k], Damaged):
                lane += len(out[k].frames[j].lanes)
                at += out[k].frames[j].units[0] * out[k].frames[j].units[1] * luma
                continue
            f = out[k][0][j]
            rows, cols = f.units
            grid = dc[at : at + rows * cols * luma].reshape(rows, cols, v, h).transpose(0, 2, 1, 3).reshape(rows * v, cols * h)
            high, wide = f.luminance
            mean = _block_means(grid[:high, :wide], f.quantiser)
            whole = sound[lane : lane + len(f.lanes)].all()
            lane += len(f.lanes)
            at += rows * cols * luma
            out[k][1][j] = np.minimum(np.maximum(mean, 0), 255).astype(np.uint8)
            if not whole:
                e = Damaged("codes")
                e.frames = out[k][0]
                out[k] = e
    return out


def _block_means(dc: np.ndarray, quantiser: int) -> np.ndarray:
    """A block's mean is its DC term over 8, halves away from zero."""
    if quantiser % 8 == 0:
        return dc * (quantiser // 8) + 128
    x = dc.astype(np.int64) * quantiser
    return np.where(x < 0, -((4 - x) // 8), (x + 4) // 8) + 128


def difference_hash(thumbnail: np.ndarray) -> str:
    """64 bits of a thumbnail, 16 hex digits: over an 8 x 9 grid of its samples' means, whether each is less than its right neighbour."""
    h, w = thumbnail.shape
    r0, c0 = np.arange(8) * h // 8, np.arange(9) * w // 9
    r1, c1 = np.maximum(r0 + 1, np.arange(1, 9) * h // 8), np.maximum(c0 + 1, np.arange(1, 10) * w // 9)
    if w >= 9:
        across = np.add.reduceat(thumbnail, c0, axis=1, dtype=np.int64)
    else:
        across = np.stack([thumbnail[:, a:b].sum(axis=1, dtype=np.int64) for a, b in zip(c0, c1)], axis=1)
    down = np.concatenate([np.zeros((1, 9), np.int64), np.cumsum(across, axis=0)])
    s = down[r1] - down[r0]
    area = (r1 - r0)[:, None] * (c1 - c0)[None, :]
    less = s[:, :-1] * area[:, 1:] < s[:, 1:] * area[:, :-1]
    return np.packbits(less.ravel()).tobytes().hex()


FEATURES = (
    "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "feature string, frames int, width int, height int, thumbnail_hash string, error string"
)


def _features(media: list[bytes | None]) -> list[tuple]:
    rows = []
    for m, read in zip(media, thumbnails(media)):
        stored = (None, None) if m is None else (len(m), hashlib.sha256(m).hexdigest())
        if isinstance(read, Damaged):
            rows.append((None, None, None, None, *stored, None, None, None, None, None, str(read)))
            continue
        frames, thumbs = read
        payload = b"".join(t.tobytes() for t in thumbs)
        said = frames[0].comment
        n = int(said) if said.isdigit() and int(said) <= len(payload) else None
        width, height = max(f.width for f in frames), sum(f.height for f in frames)
        look = difference_hash(thumbs[0] if len(thumbs) == 1 or len({t.shape[1] for t in thumbs}) > 1 else np.concatenate(thumbs))
        rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), *stored, f"{width}x{height}:{look}", len(frames), width, height, look, None))
    return rows


def media_features(table: DataFrame) -> DataFrame:
    """doc_id and FEATURES of each row of table (doc_id, media): the payload is the thumbnails' samples as read back from the media."""

    def run(batches):
        fields = FEATURES.split(", ")
        types = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[f.split()[1]] for f in fields]
        for batch in batches:
            for part in _pieces(batch):
                rows = _features(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], names=["doc_id", *(f.split()[0] for f in fields)])
            release()

    small_batches(table.sparkSession)
    return table.select("doc_id", "media").mapInArrow(run, f"doc_id long, {FEATURES}")
