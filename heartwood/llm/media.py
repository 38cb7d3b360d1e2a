"""Media columns: payloads stored as progressive JPEG, read back scan by scan.

`store_payloads` keeps any bytes losslessly in a JPEG: one byte is one quantised DCT coefficient (the format's unit)
of a YCbCr image with 4:2:0 chroma and quantisation steps of 1. The image is written in eight scans: a first and a
refining scan of the DC coefficients (successive approximation), and of the AC coefficients of each component
(spectral selection and successive approximation), with restart markers.

`read_images` reads progressive JPEGs in general: it accumulates all scans into coefficient arrays, takes the inverse
transform as one matrix product, upsamples chroma and gives full-resolution RGB tensors. Entropy-coded segments
(between restart markers, scans and images) are independent, so that those of a whole batch are decoded side by side,
one numpy step for all of them.

Null texts count as empty; a payload is padded with bytes 0 to a positive multiple of 64. A payload of more than PIECE
bytes is stored as several JPEGs one after another; their tensors stand below each other. Null or broken images in a
column that is read give null tensors: what isn't progressive, what lacks or contradicts its own tables, and what declares
more blocks than its data has bits for. Equal payloads give equal bytes, tensors and features, whatever batch they are
in. Batches are worked off in slices of SLICE coefficients: memory is bounded by that, the largest single JPEG and a few
copies of the largest item.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, slices, text_or_empty

SLICE = 2 << 20
PIECE = 384 * 2730
RESTART = 8
#: Added to a payload byte to give its coefficient, which is then above 0 even without its lowest bit.
LIFT = 2

_cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (sum(p), p[sum(p) % 2 == 0]))
ROWS, COLUMNS = (np.array(x) for x in zip(*_cells))


def _basis() -> np.ndarray:
    """Pixel values (raster order) of each coefficient (zigzag order)."""
    scale = lambda k: np.where(k == 0, np.sqrt(0.5), 1.0)
    wave = lambda k: np.cos((2 * np.arange(8)[None] + 1) * k[:, None] * np.pi / 16) * scale(k)[:, None]
    return (wave(ROWS)[:, :, None] * wave(COLUMNS)[:, None, :] / 4).reshape(64, 64)


BASIS = _basis()


# ---- Huffman tables


def canonical(lengths: dict[int, int]) -> tuple[bytes, bytes]:
    """(numbers of codes by length 1..16, symbols in code order) of a table, as a JPEG holds it."""
    counts = bytes(sum(1 for x in lengths.values() if x == n) for n in range(1, 17))
    return counts, bytes(sorted(lengths, key=lambda s: (lengths[s], s)))


def codes(counts: bytes, symbols: bytes) -> list[tuple[int, int, int]]:
    """(symbol, code, length) of each symbol."""
    out, code, i = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((symbols[i], code, length))
            code, i = code + 1, i + 1
        code <<= 1
    return out


@lru_cache(256)
def lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """For each 16 bits ahead: length of the code there * 256 + its symbol."""
    table = np.full(65536, 16 << 8, np.int32)
    for symbol, code, length in codes(counts, symbols):
        table[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
    return table


#: Lengths of the codes that payloads are written with; short ones for the sizes that letters have.
DC_TABLE = canonical({s: 3 for s in range(6)} | {6: 4, 7: 4, 8: 4, 9: 5})
AC_TABLE = canonical({6: 1, 5: 2, 7: 3, 3: 5, 4: 5, 1: 6, 2: 6, 8: 6})
REFINE_TABLE = canonical({r << 4: 3 for r in range(4)} | {r << 4: 6 for r in range(4, 15)})


def _code_arrays(table: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    code, length = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for s, c, n in codes(*table):
        code[s], length[s] = c, n
    return code, length


# ---- writing


def _pack(code: np.ndarray, length: np.ndarray, lane: np.ndarray, n_lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, first byte of each lane and the end): codes one after another, each lane filled up with bits 1."""
    bits = np.bincount(lane, length, n_lanes).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum((bits + 7) // 8)])
    first = np.concatenate([[0], np.cumsum(bits)])
    at = np.cumsum(length) - length - first[lane] + 8 * starts[lane]
    pad = -bits % 8
    code = np.concatenate([code, (1 << pad) - 1])
    at = np.concatenate([at, 8 * starts[:-1] + bits])
    end = (at & 31) + np.concatenate([length, pad])
    word = at >> 5
    over = np.maximum(end - 32, 0)
    size = int(starts[-1]) // 4 + 2
    total = np.bincount(word, (code >> over) << np.maximum(32 - end, 0), size)
    cross = np.flatnonzero(over)
    total += np.bincount(word[cross] + 1, (code[cross] << (32 - over[cross])) & 0xFFFFFFFF, size)
    return total.astype(np.int64).astype(">u4").view(np.uint8)[: starts[-1]], starts


def _stream(data: np.ndarray, starts: np.ndarray, unit_first: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(entropy-coded bytes with stuffing and restart markers, first byte of each unit and the end). unit_first: index of
    the first lane of each unit (a scan of an image)."""
    n = len(starts) - 1
    within = np.arange(n) - np.repeat(unit_first, np.diff(np.append(unit_first, n)))
    markers = np.cumsum(within > 0)
    full = data == 255
    base = np.arange(len(data)) + np.cumsum(full) - full + 2 * np.repeat(markers, np.diff(starts))
    out = np.zeros(len(data) + int(full.sum()) + 2 * int(markers[-1]), np.uint8)
    out[base] = data
    again = np.flatnonzero(within > 0)
    at = base[starts[again]]
    out[at - 2], out[at - 1] = 255, 0xD0 + (within[again] - 1) % 8
    return out.tobytes(), np.append(base[starts[unit_first]], len(out))


def _unit_bytes(stream: bytes, firsts: np.ndarray, unit: int) -> bytes:
    return stream[firsts[unit] : firsts[unit + 1]]


def _bit_sizes(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)  # of non-negative integers


@lru_cache(4096)
def _mcu_order(wide: int, high: int) -> np.ndarray:
    """Block addresses (component after component, raster) of a 4:2:0 image in the order of an interleaved scan."""
    y, x = np.divmod(np.arange(wide * high), wide)
    luma = [(2 * y + i) * 2 * wide + 2 * x + j for i in (0, 1) for j in (0, 1)]
    return np.stack([*luma, 4 * wide * high + y * wide + x, 5 * wide * high + y * wide + x], 1).ravel()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def _scan_header(parts: list[tuple[int, int]], ss: int, se: int, ah: int, al: int) -> bytes:
    return _segment(0xDA, bytes([len(parts), *(b for p in parts for b in p), ss, se, ah << 4 | al]))


_TABLES = _segment(0xDB, bytes([0]) + b"\x01" * 64) + b"".join(_segment(0xC4, bytes([where]) + c + s) for where, (c, s) in ((0, DC_TABLE), (16, AC_TABLE), (17, REFINE_TABLE)))
_SCANS = [
    _scan_header([(1, 0), (2, 0), (3, 0)], 0, 0, 0, 1), _scan_header([(1, 0), (2, 0), (3, 0)], 0, 0, 1, 0),
    *(_scan_header([(c, 0)], 1, 63, 0, 1) for c in (1, 2, 3)), *(_scan_header([(c, 1)], 1, 63, 1, 0) for c in (1, 2, 3)),
]


def pad64(data: bytes) -> bytes:
    return data + bytes(-len(data) % 64 or (64 if not data else 0))


def store_payloads(payloads: list[bytes]) -> list[bytes]:
    """The JPEG, or JPEGs one after another, of each payload (a positive multiple of 64 bytes)."""
    pieces = [(i, p[s : s + PIECE]) for i, p in enumerate(payloads) for s in range(0, len(p), PIECE)]
    out: list[list[bytes]] = [[] for _ in payloads]
    for s, e in slices((len(p) for _, p in pieces), SLICE):
        for (i, _), jpeg in zip(pieces[s:e], _store([p for _, p in pieces[s:e]])):
            out[i].append(jpeg)
    return [b"".join(x) for x in out]


def _store(payloads: list[bytes]) -> list[bytes]:
    """A JPEG of each payload of PIECE bytes at most."""
    shapes = []
    for p in payloads:
        mcus = -(-len(p) // 384)
        high = -(-mcus // 64) if mcus <= 64 * 4000 else 4000
        shapes.append((-(-mcus // high), high))
    mcus = np.array([w * h for w, h in shapes])
    blocks = 6 * mcus
    base = np.concatenate([[0], np.cumsum(blocks)])
    flat = np.zeros(int(base[-1]) * 64, np.uint8)
    for p, b in zip(payloads, base):
        flat[b * 64 : b * 64 + len(p)] = np.frombuffer(p, np.uint8)
    grid = flat.reshape(-1, 64)
    # DC: units are images, lanes are RESTART minimal coded units.
    order = np.concatenate([_mcu_order(*s) + b for s, b in zip(shapes, base)])
    dc = grid[order, 0].astype(np.int64) + LIFT
    lanes = -(-mcus // RESTART)
    lane_first = np.concatenate([[0], np.cumsum(lanes)])
    within = np.arange(int(mcus.sum())) - np.repeat(np.cumsum(mcus) - mcus, mcus)
    lane = np.repeat(lane_first[:-1], mcus) + within // RESTART
    value = (dc >> 1).reshape(-1, 6)
    before = np.zeros_like(value)
    before[:, 1:4] = value[:, 0:3]
    before[1:, 0], before[1:, 4:] = value[:-1, 3], value[:-1, 4:]
    before[np.ix_(within % RESTART == 0, [0, 4, 5])] = 0
    diff = (value - before).ravel()
    s = _bit_sizes(np.abs(diff))
    code, length = _code_arrays(DC_TABLE)
    by6 = np.repeat(lane, 6)
    dc1 = _stream(*_pack(code[s] << s | (diff - (diff < 0) + (1 << s)) & ((1 << s) - 1), length[s] + s, by6, int(lane_first[-1])), lane_first[:-1])
    dc2 = _stream(*_pack(dc & 1, np.ones(len(dc), np.int64), by6, int(lane_first[-1])), lane_first[:-1])
    # AC: units are components of images, lanes are RESTART blocks.
    unit_blocks = (mcus[:, None] * np.array([4, 1, 1])).ravel()
    unit_lanes = -(-unit_blocks // RESTART)
    unit_first = np.concatenate([[0], np.cumsum(unit_lanes)])
    within = np.arange(len(grid)) - np.repeat(np.cumsum(unit_blocks) - unit_blocks, unit_blocks)
    lane = np.repeat(unit_first[:-1], unit_blocks) + within // RESTART
    n_lanes = int(unit_first[-1])
    code, length = _code_arrays(AC_TABLE)
    value = np.arange(256) + LIFT >> 1
    s = _bit_sizes(value)
    byte_code, byte_length = code[s] << s | value, length[s] + s
    ac = grid[:, 1:].ravel()
    ac1 = _stream(*_pack(byte_code[ac], byte_length[ac], np.repeat(lane, 63), n_lanes), unit_first[:-1])
    code, length = _code_arrays(REFINE_TABLE)
    held = np.bincount(lane, minlength=n_lanes)
    r = _bit_sizes(held) - 1
    run = code[r << 4] << r | held - (1 << r)
    thirds = ((grid[:, 1:] & 1).reshape(-1, 3, 21) @ (1 << np.arange(20, -1, -1))).astype(np.int64)
    first = np.flatnonzero(np.diff(lane, prepend=-1))
    where = np.repeat(np.arange(len(grid)) * 3, 3) + np.tile(np.arange(3), len(grid)) + np.repeat(lane + 1, 3)
    all_code, all_length = np.zeros(len(grid) * 3 + n_lanes, np.int64), np.full(len(grid) * 3 + n_lanes, 21)
    all_lane = np.zeros(len(all_code), np.int64)
    all_code[where], all_lane[where] = thirds.ravel(), np.repeat(lane, 3)
    head = first * 3 + np.arange(n_lanes)
    all_code[head], all_length[head], all_lane[head] = run, length[r << 4] + r, np.arange(n_lanes)
    ac2 = _stream(*_pack(all_code, all_length, all_lane, n_lanes), unit_first[:-1])
    out = []
    for i, ((wide, high), p) in enumerate(zip(shapes, payloads)):
        frame = struct.pack(">BHHB", 8, 16 * high, 16 * wide, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
        data = [_unit_bytes(*dc1, i), _unit_bytes(*dc2, i), *(_unit_bytes(*ac1, 3 * i + k) for k in range(3)), *(_unit_bytes(*ac2, 3 * i + k) for k in range(3))]
        head = b"\xff\xd8" + _segment(0xFE, b"payload %d" % len(p)) + _TABLES + _segment(0xC2, frame) + _segment(0xDD, struct.pack(">H", RESTART))
        out.append(head + b"".join(x for pair in zip(_SCANS, data) for x in pair) + b"\xff\xd9")
    return out


# ---- reading


@dataclass
class Scan:
    parts: list[int]
    dc: list[tuple[bytes, bytes] | None]
    ac: list[tuple[bytes, bytes] | None]
    ss: int
    se: int
    ah: int
    al: int
    restart: int
    data: list[bytes]


@dataclass
class Image:
    width: int = 0
    height: int = 0
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantisation table
    steps: dict[int, np.ndarray] = field(default_factory=dict)
    scans: list[Scan] = field(default_factory=list)
    payload: int | None = None

    def fits(self) -> bool:
        """Whether all components can be brought to one size."""
        hm, vm = max((p[1] for p in self.parts), default=0), max((p[2] for p in self.parts), default=0)
        return bool(self.parts) and all(1 <= h <= 4 and 1 <= v <= 4 and hm % h == 0 and vm % v == 0 for _, h, v, _ in self.parts)

    def blocks(self) -> int:
        return sum(g[2] * g[3] for g in self.geometry())

    def geometry(self) -> list[tuple[int, int, int, int, int, int]]:
        """Of each component: h, v, blocks across and down with padding, and without."""
        hm, vm = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        wide, high = -(-self.width // (8 * hm)), -(-self.height // (8 * vm))
        return [(h, v, wide * h, high * v, -(-(-(-self.width * h // hm)) // 8), -(-(-(-self.height * v // vm)) // 8)) for _, h, v, _ in self.parts]


END_OF_SCAN, RESTARTS = re.compile(rb"\xff[\x01-\xcf\xd8-\xfe]"), re.compile(rb"\xff[\xd0-\xd7]")


def parse(data: bytes, begin: int = 0) -> tuple[Image, int]:
    """The segments of the progressive JPEG that begins there, and where it ends; ValueError if it is none."""
    if data[begin : begin + 2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    image, at, restart = Image(), begin + 2, 0
    tables: dict[int, tuple[bytes, bytes]] = {}
    while at + 2 <= len(data):
        if data[at] != 255:
            raise ValueError("no marker where one must be")
        marker = data[at + 1]
        if marker == 0xD9:
            at += 2
            break
        if marker == 255:
            at += 1
            continue
        if at + 4 > len(data):
            break
        size = data[at + 2] << 8 | data[at + 3]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE and body.startswith(b"payload "):
            image.payload = int(body[8:])
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 128 if wide else 64
                image.steps[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.float64)
                if len(image.steps[body[0] & 15]) != 64:
                    raise ValueError("a short table of steps")
                body = body[1 + n :]
        elif marker == 0xC2:
            image.height, image.width = struct.unpack(">HH", body[1:5])
            image.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not progressive")
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                if len(body) < 17 + n:
                    raise ValueError("a short table of codes")
                tables[body[0]] = body[1:17], body[17 : 17 + n]
                body = body[17 + n :]
        elif marker == 0xDD:
            restart = body[0] << 8 | body[1]
        elif marker == 0xDA:
            ids = [p[0] for p in image.parts]
            n = body[0]
            parts = [ids.index(body[1 + 2 * i]) for i in range(n)]
            which = [body[2 + 2 * i] for i in range(n)]
            found = END_OF_SCAN.search(data, at)
            end = found.start() if found else len(data)
            coded = [x.replace(b"\xff\x00", b"\xff") for x in RESTARTS.split(data[at:end])]
            ss, se, a = body[1 + 2 * n : 4 + 2 * n]
            if not 1 <= n <= 4 or not ss <= se < 64 or ss and n > 1 or not image.fits():
                raise ValueError("a scan that the frame doesn't allow")
            image.scans.append(Scan(parts, [tables.get(w >> 4) for w in which], [tables.get(16 + (w & 15)) for w in which], ss, se, a >> 4, a & 15, restart, coded))
            at = end
    if not image.parts or not image.width or not image.height or not image.scans:
        raise ValueError("no image")
    if image.payload is not None and not 0 <= image.payload <= 64 * image.blocks():
        raise ValueError("a payload longer than the image")
    # The first scan of a block takes a bit at least.
    if image.blocks() > 8 * (at - begin):
        raise ValueError("more blocks than bits")
    return image, at


class Bits:
    """The coded bytes of many segments in one buffer; all questions are asked for many positions at once."""

    def __init__(self, segments: list[bytes]):
        gap = bytes(8)
        data = np.frombuffer(gap.join([*segments, b""]) + gap, np.uint8).astype(np.uint32)
        self.words = (data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]).astype(np.int64)
        sizes = np.array([len(x) + 8 for x in segments], np.int64)
        self.starts = 8 * (np.cumsum(sizes) - sizes)
        self.last = 8 * (len(self.words) - 1)

    def ahead(self, at: np.ndarray) -> np.ndarray:
        at = np.minimum(at, self.last)
        return self.words[at >> 3] >> (16 - (at & 7)) & 0xFFFF

    def take(self, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        at = np.minimum(at, self.last)
        return self.words[at >> 3] >> (32 - (at & 7) - n) & ((1 << n) - 1)


@dataclass
class Lanes:
    """Segments of scans of one kind: the blocks of lane i are order[first[i] : first[i] + count[i]]."""

    bits: Bits
    order: np.ndarray
    part: np.ndarray
    first: np.ndarray
    count: np.ndarray
    tables: np.ndarray  # of each lane and component of its scan: where its lookup table begins
    ss: np.ndarray
    se: np.ndarray
    al: np.ndarray
    look: np.ndarray


def signed(value: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(value < (1 << size) >> 1, value - (1 << size) + 1, value)


def dc_first(x: Lanes, grid: np.ndarray) -> None:
    at, by = x.bits.starts.copy(), np.argsort(-x.count, kind="stable")
    last = np.zeros((len(at), 4), np.int64)
    counts = x.count[by]
    for t in range(int(x.count.max(initial=0))):
        live = by[: np.searchsorted(-counts, -t, "left")]
        i = x.first[live] + t
        part = x.part[i]
        word = x.look[x.tables[live, part] + x.bits.ahead(at[live])]
        at[live] += word >> 8
        size = word & 15
        last[live, part] += signed(x.bits.take(at[live], size), size)
        at[live] += size
        grid[x.order[i], 0] = last[live, part] << x.al[live]


def dc_refine(x: Lanes, grid: np.ndarray) -> None:
    lane = np.repeat(np.arange(len(x.count)), x.count)
    t = np.arange(len(lane)) - np.repeat(np.cumsum(x.count) - x.count, x.count)
    grid[x.order[x.first[lane] + t], 0] |= x.bits.take(x.bits.starts[lane] + t, 1) << x.al[lane]


def ac_first(x: Lanes, grid: np.ndarray) -> None:
    at, block, k = x.bits.starts.copy(), np.zeros(len(x.count), np.int64), x.ss.astype(np.int64)
    first, count, table, ss, se, al = x.first, x.count, x.tables[:, 0], x.ss, x.se, x.al
    flat = grid.reshape(-1)
    while True:
        alive = block < count
        if not alive.all():
            at, block, k, first, count, table, ss, se, al = (v[alive] for v in (at, block, k, first, count, table, ss, se, al))
            if not len(at):
                return
        word = x.look[table + x.bits.ahead(at)]
        at += word >> 8
        r, s = word >> 4 & 15, word & 15
        coded = s > 0
        if coded.all():
            value = x.bits.take(at, s)
            at += s
            k += r
            flat[x.order[first + block] * 64 + np.minimum(k, 63)] = signed(value, s) << al
            k += 1
        else:
            more = np.where(coded, s, np.where(r < 15, r, 0))
            value = x.bits.take(at, more)
            at += more
            k += np.where(coded, r, np.where(r == 15, 16, 0))
            w = np.flatnonzero(coded & (k <= se))
            flat[x.order[first[w] + block[w]] * 64 + k[w]] = signed(value[w], s[w]) << al[w]
            k += coded
            ended = ~coded & (r < 15)
            block += np.where(ended, (1 << r) + value, 0)
            k = np.where(ended, ss, k)
        over = k > se
        block += over
        k = np.where(over, ss, k)


def ac_refine(x: Lanes, grid: np.ndarray) -> None:
    n = len(x.count)
    at, block, k = x.bits.starts.copy(), np.zeros(n, np.int64), x.ss.astype(np.int64)
    run, skip, new = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n, np.int64)  # skip: -1 if a symbol comes next
    step, every = 1 << x.al, np.arange(64)
    table = x.tables[:, 0]
    live = np.flatnonzero(block < x.count)
    while len(live):
        ends = live[run[live] > 0]
        if len(ends):  # what is left of these blocks: a bit for each coefficient that isn't 0
            rows = x.order[x.first[ends] + block[ends]]
            c = grid[rows]
            there = (c != 0) & (every >= k[ends, None]) & (every <= x.se[ends, None])
            place = np.cumsum(there, 1)
            bit = x.bits.take(at[ends, None] + place - 1, 1) * there
            grid[rows] = c + bit * np.where(np.abs(c) & step[ends, None], 0, np.sign(c) * step[ends, None])
            at[ends] += place[:, -1]
            run[ends] -= 1
            block[ends] += 1
            k[ends] = x.ss[ends]
        rest = live[(run[live] == 0) & (block[live] < x.count[live])]
        rest = rest[~np.isin(rest, ends, assume_unique=True)] if len(ends) else rest
        if len(rest):
            walk = rest[skip[rest] >= 0]
            ask = rest[skip[rest] < 0]
            if len(ask):
                word = x.look[table[ask] + x.bits.ahead(at[ask])]
                at[ask] += word >> 8
                r, s = word >> 4 & 15, word & 15
                ended = (s == 0) & (r < 15)
                more = np.where(ended, r, (s > 0).astype(np.int64))
                value = x.bits.take(at[ask], more)
                at[ask] += more
                run[ask] = np.where(ended, (1 << r) + value, 0)
                new[ask] = np.where(s > 0, np.where(value > 0, 1, -1), 0) * step[ask]
                skip[ask] = np.where(ended, -1, r)
            if len(walk):
                rows = x.order[x.first[walk] + block[walk]]
                c = grid[rows, k[walk]]
                there = c != 0
                bit = x.bits.take(at[walk], 1) * there
                at[walk] += there
                put = ~there & (skip[walk] == 0)
                grid[rows, k[walk]] = np.where(put, new[walk], c + bit * np.where(np.abs(c) & step[walk], 0, np.sign(c) * step[walk]))
                skip[walk] -= ~there
                k[walk] += 1
                over = walk[k[walk] > x.se[walk]]
                block[over] += 1
                k[over], skip[over] = x.ss[over], -1
        live = live[block[live] < x.count[live]]


KINDS = (dc_first, dc_refine, ac_first, ac_refine)


@lru_cache(8192)
def _scan_order(geometry: tuple, parts: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
    """(block addresses in an image, component of the scan that each belongs to, blocks of a minimal coded unit)."""
    base = np.cumsum([0, *(g[2] * g[3] for g in geometry)])
    if len(parts) == 1:
        _, _, stride, _, wide, high = geometry[parts[0]]
        order = (np.arange(high)[:, None] * stride + np.arange(wide)).ravel() + base[parts[0]]
        return order, np.zeros(len(order), np.int64), 1
    wide, high = geometry[0][2] // geometry[0][0], geometry[0][3] // geometry[0][1]
    y, x = np.divmod(np.arange(wide * high), wide)
    columns, part = [], []
    for j, p in enumerate(parts):
        h, v, stride, _, _, _ = geometry[p]
        columns += [base[p] + (y * v + i) * stride + x * h + k for i in range(v) for k in range(h)]
        part += [j] * (h * v)
    return np.stack(columns, 1).ravel(), np.tile(part, wide * high), len(part)


def coefficients(images: list[Image]) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients of all blocks in zigzag order, first block of each image and the end), all scans accumulated."""
    geometry = [tuple(i.geometry()) for i in images]
    base = np.concatenate([[0], np.cumsum([sum(g[2] * g[3] for g in gs) for gs in geometry])]).astype(np.int64)
    grid = np.zeros((int(base[-1]), 64), np.int64)
    for level in range(max((len(i.scans) for i in images), default=0)):
        kinds: list[list[tuple[int, Scan]]] = [[], [], [], []]
        for i, image in enumerate(images):
            if level < len(image.scans):
                s = image.scans[level]
                kinds[2 * (s.ss > 0) + (s.ah > 0)].append((i, s))
        for decode, scans in zip(KINDS, kinds):
            if scans:
                decode(_lanes(scans, geometry, base, decode in (ac_first, ac_refine)), grid)
    return grid, base


def _lanes(scans: list[tuple[int, Scan]], geometry: list[tuple], base: np.ndarray, ac: bool) -> Lanes:
    looks: dict[tuple[bytes, bytes] | None, int] = {}
    order, part, first, count, tables, segments = [], [], [], [], [], []
    settings, done = [], 0
    for i, s in scans:
        o, p, unit = _scan_order(geometry[i], tuple(s.parts))
        order.append(o + base[i])
        part.append(p)
        each = s.restart * unit if s.restart else len(o)
        n = -(-len(o) // each)
        data = (s.data + [b""] * n)[:n]
        segments += data
        at = np.arange(n) * each
        first.append(at + done)
        count.append(np.minimum(each, len(o) - at))
        done += len(o)
        used = [looks.setdefault(t, len(looks)) for t in (s.ac if ac else s.dc)]
        tables.append(np.tile((used + [0, 0, 0, 0])[:4], (n, 1)))
        settings.append(np.tile([s.ss, s.se, s.al], (n, 1)))
    ss, se, al = np.concatenate(settings).astype(np.int64).T
    look = np.concatenate([lookup(*t) if t else np.full(65536, 16 << 8, np.int32) for t in looks]).astype(np.int64)
    return Lanes(Bits(segments), np.concatenate(order), np.concatenate(part), np.concatenate(first), np.concatenate(count), np.concatenate(tables).astype(np.int64) * 65536, ss, se, al, look)


#: What red and blue difference add to the three colours (JFIF).
RED_R, RED_G, BLUE_G, BLUE_B = 1.402, -0.714136, -0.344136, 1.772
_diff = np.arange(256) - 128.0
_ADD = {k: np.floor(f * _diff + 0.5).astype(np.int16) for k, f in (("rr", RED_R), ("rg", RED_G), ("bg", BLUE_G), ("bb", BLUE_B))}


def tensors(images: list[Image], grid: np.ndarray, base: np.ndarray) -> list[np.ndarray]:
    """Full-resolution RGB (height, width, 3) of each image."""
    steps = np.ones((len(grid), 1))
    if any((q != 1).any() for i in images for q in i.steps.values()):
        steps = np.ones((len(grid), 64))
        for i, image in enumerate(images):
            at = base[i]
            for (_, _, _, q), (_, _, wide, high, _, _) in zip(image.parts, image.geometry()):
                steps[at : at + wide * high] = image.steps.get(q, 1)
                at += wide * high
    pixels = np.empty((len(grid), 64), np.uint8)
    for s in range(0, len(grid), 8192):  # the small addend decides halves alike in every batch
        pixels[s : s + 8192] = np.clip(np.floor((grid[s : s + 8192] * steps[s : s + 8192]) @ BASIS + (128.5 + 1e-7)), 0, 255)
    out = []
    for i, image in enumerate(images):
        at, planes, geometry = base[i], [], image.geometry()
        hm, vm = max(g[0] for g in geometry), max(g[1] for g in geometry)
        for h, v, wide, high, _, _ in geometry:
            plane = pixels[at : at + wide * high].reshape(high, wide, 8, 8).transpose(0, 2, 1, 3).reshape(8 * high, 8 * wide)
            at += wide * high
            if h < hm or v < vm:
                plane = plane.repeat(vm // v, 0).repeat(hm // h, 1)
            planes.append(plane[: image.height, : image.width])
        if len(planes) < 3:
            out.append(np.repeat(planes[0][:, :, None], 3, 2))
            continue
        y, blue, red = planes[0].astype(np.int16), planes[1], planes[2]
        rgb = np.empty((*y.shape, 3), np.uint8)
        rgb[:, :, 0] = np.clip(y + _ADD["rr"][red], 0, 255)
        rgb[:, :, 1] = np.clip(y + _ADD["rg"][red] + _ADD["bg"][blue], 0, 255)
        rgb[:, :, 2] = np.clip(y + _ADD["bb"][blue], 0, 255)
        out.append(rgb)
    return out


@dataclass
class Decoded:
    rgb: np.ndarray
    payload: bytes | None

    def feature(self) -> str:
        h, w, _ = self.rgb.shape
        return f"{w}x{h} " + " ".join(f"{m / (h * w):.3f}" for m in self.rgb.sum((0, 1), dtype=np.int64))


def below(parts: list[Decoded]) -> Decoded:
    """The pieces of one payload: tensors below each other, narrower ones filled up with black."""
    if len(parts) == 1:
        return parts[0]
    wide = max(p.rgb.shape[1] for p in parts)
    return Decoded(np.concatenate([np.pad(p.rgb, ((0, 0), (0, wide - p.rgb.shape[1]), (0, 0))) for p in parts]), b"".join(p.payload or b"" for p in parts))


def read_images(data: list[bytes | None]) -> list[Decoded | None]:
    """The tensor, and the payload if there is one, of each progressive JPEG; None for what is none."""
    images: list[tuple[int, Image]] = []
    for i, d in enumerate(data):
        found, at = [], 0
        try:
            while d and at < len(d) and (not found or found[-1][1].payload is not None):
                image, at = parse(d, at)
                found.append((i, image))
        except (ValueError, IndexError, struct.error):
            found = []
        images += found
    parts: list[list[Decoded]] = [[] for _ in data]
    for s, e in slices((64 * image.blocks() for _, image in images), SLICE):
        good = [image for _, image in images[s:e]]
        grid, base = coefficients(good)
        for k, ((i, image), rgb) in enumerate(zip(images[s:e], tensors(good, grid, base))):
            payload = None if image.payload is None else (grid[base[k] : base[k + 1]].reshape(-1)[: image.payload] - LIFT).astype(np.uint8).tobytes()
            parts[i].append(Decoded(rgb, payload))
    return [below(x) if x else None for x in parts]


# ---- DataFrames


def with_media(df: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes (of the text in UTF-8) and media: the padded text as a JPEG."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [t.encode() for t in b.column(1).to_pylist()]
            for s, e in slices(map(len, raw), SLICE):
                media = store_payloads([pad64(t) for t in raw[s:e]])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, e - s), pa.array(map(len, raw[s:e]), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return mapped(df.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text).alias("text")), run, "doc_id long, n_bytes long, media binary")


def read_media(df: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """key, height, width, rgb (bytes of the tensor) and feature of each image of a column; nulls for what is no image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(1).to_pylist()
            for s, e in slices([len(x or b"") for x in raw], SLICE):
                found = read_images(raw[s:e])
                shape = lambda k: pa.array([d and d.rgb.shape[k] for d in found], pa.int32())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, e - s), shape(0), shape(1), pa.array([d and d.rgb.tobytes() for d in found], pa.binary()), pa.array([d and d.feature() for d in found], pa.string())], [key, "height", "width", "rgb", "feature"])

    kind = df.schema[key].dataType.simpleString()
    return mapped(df.select(key, media), run, f"`{key}` {kind}, height int, width int, rgb binary, feature string")


def media_digest(docs: DataFrame) -> DataFrame:
    """Every text through its JPEG and back: sizes and digests of what was stored and of what was read, and the feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            media = b.column(2).to_pylist()
            for s, e in slices(map(len, media), SLICE):
                found, part = read_images(media[s:e]), media[s:e]
                back = [d.payload for d in found]
                columns = [
                    pa.array(map(len, back), pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in back], pa.string()), pa.array([zlib.crc32(p[-64:]) for p in back], pa.int64()),
                    pa.array(map(len, part), pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in part], pa.string()), pa.array([d.feature() for d in found], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, e - s), b.column(1).slice(s, e - s), *columns], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return mapped(with_media(docs), run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
