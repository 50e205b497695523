"""Media columns: progressive JPEG, written and read in numpy.

Reading accumulates spectral-selection and successive-approximation scans into coefficient arrays. All
restart segments of a scan, of all images of a batch, are decoded in step with each other: each numpy
operation takes one Huffman symbol from every segment. Then come the inverse transform (in exact integers), the
upsampling of chroma and the conversion to full-resolution RGB tensors.

Writing stores bytes losslessly: the format's unit here is the quantised coefficient. A byte b is the coefficient
b + 2; 64 bytes are a block in zigzag order; the blocks fill the Y, Cb and Cr planes of a 4:2:0 image in that order,
and a comment holds the number of bytes. Blocks beyond it are zero.

Defined results: null text is empty text, whose payload is 64 zero bytes; equal texts give equal bytes; rows are taken one
by one; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.llm.textscan import chunks

_U = np.uint64
#: MCUs between restart markers: short segments make wide steps.
RESTART = 2
OFFSET = 2
#: Images are one MCU wide up to this many MCUs, then wider.
MOST_ROWS = 4000
COMMENT = b"bytes:"

# The zigzag order of the 64 coefficients: diagonals in turn, each in the other direction.
ZIGZAG = np.array(sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8)))


def _canonical(counts: list[int], symbols: bytes) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length)."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[k]] = (code, length)
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _lookup(counts: list[int], symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Length and symbol by the next 16 bits."""
    lengths, found = np.zeros(65536, np.int64), np.zeros(65536, np.int64)
    for symbol, (code, length) in _canonical(counts, symbols).items():
        at = code << (16 - length)
        lengths[at : at + (1 << (16 - length))] = length
        found[at : at + (1 << (16 - length))] = symbol
    return lengths, found


# ---------------------------------------------------------------- writing

#: Tables of the files written here: (class and slot, counts by length, symbols).
_DC = (0x00, [0, 0, 0, 12] + [0] * 12, bytes(range(12)))
_AC = (0x10, [1, 1, 0, 0, 7] + [0] * 11, bytes([6, 5, 7, 4, 3, 2, 1, 8, 0]))
_AC_REFINE = (0x11, [1] + [0] * 15, bytes([0]))
#: (components, first and last coefficient, bit before, bit): first bit 1, then bit 0.
_SCANS = [((1, 2, 3), 0, 0, 0, 1), *(((c,), a, b, 0, 1) for a, b in ((1, 5), (6, 63)) for c in (1, 2, 3)), ((1, 2, 3), 0, 0, 1, 0), *(((c,), 1, 63, 1, 0) for c in (1, 2, 3))]


def _part(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _layout(n_blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Width and height in MCUs of images of so many blocks."""
    mcus = -(-n_blocks // 6)
    width = -(-mcus // MOST_ROWS)
    return width, -(-mcus // width)


def _sizes(x: np.ndarray) -> np.ndarray:
    """Bits of the magnitude."""
    return np.frexp(np.abs(x).astype(np.float64))[1].astype(np.int64)


def _pack(value: np.ndarray, bits: np.ndarray, seg: np.ndarray, seg_last: np.ndarray, n_seg: int) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes with stuffing and restart markers, and where the bytes of each segment end.

    Items have at most 17 bits and come in order of their segments; ``seg_last`` marks the last segment of an image.
    """
    length = np.bincount(seg, weights=bits, minlength=n_seg).astype(np.int64)
    size = (length + 7) // 8
    begin = np.cumsum(size) - size
    before = np.cumsum(bits) - bits
    pos = before - (np.cumsum(length) - length)[seg] + 8 * begin[seg]
    pad = 8 * size - length
    value, bits = np.concatenate([value, (1 << pad) - 1]), np.concatenate([bits, pad])
    pos = np.concatenate([pos, 8 * begin + length])
    window = value << (24 - (pos & 7) - bits)
    total = int(size.sum())
    data = sum(np.bincount((pos >> 3) + k, weights=(window >> (16 - 8 * k)) & 255, minlength=total + 3) for k in range(3))
    data = data[:total].astype(np.uint8)
    full = data == 255
    stuffed = np.cumsum(full) - full
    marks = np.cumsum(~seg_last) - ~seg_last
    owner = np.repeat(np.arange(n_seg), size)
    to = np.arange(total) + stuffed + 2 * marks[owner]
    stuffed_end = np.cumsum(np.bincount(owner, weights=full, minlength=n_seg)).astype(np.int64)
    end = begin + size + stuffed_end + 2 * marks
    out = np.zeros(total + int(full.sum()) + 2 * int((~seg_last).sum()), np.uint8)
    out[to] = data
    out[end[~seg_last]] = 0xFF
    first = np.concatenate([[True], seg_last[:-1]])
    start = np.flatnonzero(first)
    number = np.arange(n_seg) - np.repeat(start, np.diff(np.append(start, n_seg)))
    out[end[~seg_last] + 1] = 0xD0 + (number[~seg_last] & 7)
    return out, end


def encode(payloads: np.ndarray, off: np.ndarray) -> list[bytes]:
    """Files of payloads that are positive multiples of 64 bytes; ``off`` bounds them."""
    n_blocks = np.diff(off) // 64
    width, height = _layout(n_blocks)
    mcus = width * height
    total = 6 * mcus
    base = np.cumsum(total) - total
    coef = np.zeros((int(total.sum()), 64), np.int64)
    owner = np.repeat(np.arange(len(n_blocks)), n_blocks)
    row = np.arange(len(owner)) - (np.cumsum(n_blocks) - n_blocks)[owner] + base[owner]
    coef[row] = payloads.reshape(-1, 64).astype(np.int64) + OFFSET
    used = np.zeros(len(coef), bool)
    used[row] = True
    image = np.repeat(np.arange(len(mcus)), mcus)
    k = np.arange(len(image)) - (np.cumsum(mcus) - mcus)[image]
    blocks = _mcu_blocks(base, width, height, image, k)
    dc_code, ac_code = _canonical(*_DC[1:]), _canonical(*_AC[1:])
    ac_value, ac_bits = (np.array([ac_code.get(s, (0, 0))[x] for s in range(12)]) for x in (0, 1))
    eob, eob_bits = ac_code[0]
    per_comp = [4 * mcus, mcus, mcus]
    comp_base = [base, base + 4 * mcus, base + 5 * mcus]
    parts: list[list[bytes]] = [[] for _ in n_blocks]

    def put(value, bits, seg, n_seg_of):
        last = np.zeros(int(n_seg_of.sum()), bool)
        last[np.cumsum(n_seg_of) - 1] = True
        out, end = _pack(value, bits, seg, last, len(last))
        raw, at = out.tobytes(), 0
        for i, e in enumerate(end[last]):
            parts[i].append(raw[at:e])
            at = e

    for comps, first, stop, high, low in _SCANS:
        if first == 0:
            n_seg_of = -(-mcus // RESTART)
            seg = (np.cumsum(n_seg_of) - n_seg_of)[image] + k // RESTART
            seg = np.repeat(seg, 6)
            dc = coef[blocks.ravel(), 0]
            if high:
                put(dc & 1, np.ones(len(dc), np.int64), seg, n_seg_of)
                continue
            v = (dc >> low).reshape(-1, 6)
            before = np.zeros_like(v)
            before[:, 1:4] = v[:, :3]
            fresh = k % RESTART == 0
            for c, tail in ((0, 3), (4, 4), (5, 5)):
                before[1:, c] = v[:-1, tail]
                before[fresh, c] = 0
            diff = (v - before).ravel()
            size = _sizes(diff)
            extra = np.where(diff < 0, diff + (1 << size) - 1, diff)
            code = np.array([dc_code[s][0] for s in range(12)])[size]
            put((code << size) | extra, 4 + size, seg, n_seg_of)
            continue
        c = comps[0] - 1
        image_c = np.repeat(np.arange(len(mcus)), per_comp[c])
        k_c = np.arange(len(image_c)) - (np.cumsum(per_comp[c]) - per_comp[c])[image_c]
        at = comp_base[c][image_c] + k_c
        n_seg_of = -(-per_comp[c] // RESTART)
        seg = (np.cumsum(n_seg_of) - n_seg_of)[image_c] + k_c // RESTART
        band = coef[at, first : stop + 1]
        some = used[at]
        if high:  # all coefficients of a used block were known to be there: end of block, then a bit each
            value, bits = np.zeros((len(at), stop - first + 2), np.int64), np.ones((len(at), stop - first + 2), np.int64)
            value[:, 1:] = band & 1
            bits[~some, 1:] = 0
        else:
            v = band >> low
            size = np.where(some[:, None], _sizes(v), 0)
            value, bits = (ac_value[size] << size) | v, ac_bits[size] + size
            value[~some], bits[~some] = 0, 0
            value[~some, 0], bits[~some, 0] = eob, eob_bits
        keep = bits.ravel() > 0
        put(value.ravel()[keep], bits.ravel()[keep], np.repeat(seg, value.shape[1])[keep], n_seg_of)

    tables = b"".join(_part(0xC4, bytes([slot, *counts]) + symbols) for slot, counts, symbols in (_DC, _AC, _AC_REFINE))
    tables = _part(0xDB, bytes([0]) + bytes([1] * 64)) + tables + _part(0xDD, struct.pack(">H", RESTART))
    heads = [_part(0xDA, bytes([len(comps), *(x for c in comps for x in (c, 0x01 if first and high else 0x00)), first, stop, high << 4 | low])) for comps, first, stop, high, low in _SCANS]
    files = []
    for i, own in enumerate(parts):
        frame = _part(0xC2, struct.pack(">BHHB", 8, 16 * int(height[i]), 16 * int(width[i]), 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
        note = _part(0xFE, COMMENT + str(int(off[i + 1] - off[i])).encode())
        files.append(b"\xff\xd8" + note + tables + frame + b"".join(x for pair in zip(heads, own) for x in pair) + b"\xff\xd9")
    return files


def _mcu_blocks(base, width, height, image, k) -> np.ndarray:
    """Rows of the six blocks of each MCU; Y, Cb and Cr of an image stand one after the other, each row by row."""
    w, n = width[image], (width * height)[image]
    y, x = k // w, k % w
    out = np.empty((len(k), 6), np.int64)
    for j in range(4):
        out[:, j] = base[image] + (2 * y + j // 2) * 2 * w + 2 * x + j % 2
    out[:, 4], out[:, 5] = base[image] + 4 * n + k, base[image] + 5 * n + k
    return out


# ---------------------------------------------------------------- reading


@dataclass
class Image:
    """What the headers of one file say, and its scans with the places of their segments."""

    width: int = 0
    height: int = 0
    comps: tuple = ()
    quant: dict = field(default_factory=dict)
    comment: bytes = b""
    scans: list = field(default_factory=list)


def _parse(data: bytes, shift: int, ff: np.ndarray, kind: np.ndarray) -> Image:
    """Reads one file that begins at ``shift`` of a buffer; ff: places of 0xFF there, kind: the bytes after them."""
    im, at, huff, restart = Image(), shift + 2, {}, 0
    while True:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big") if data[at + 1] != 0xD9 else 0
        body = data[at + 4 : at + 2 + size]
        if marker == 0xD9:
            return im
        if marker == 0xDB:
            while body:
                wide = 1 + (body[0] >> 4)
                im.quant[body[0] & 15] = tuple(int.from_bytes(body[1 + wide * i : 1 + wide * (i + 1)], "big") for i in range(64))
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huff[body[0]] = body[1 : 17 + n]
                body = body[17 + n :]
        elif marker == 0xC2:
            im.height, im.width = struct.unpack(">HH", body[1:5])
            im.comps = tuple((body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5]))
        elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
            raise ValueError(f"frame type {marker:#x} isn't progressive Huffman")
        elif marker == 0xDD:
            restart = int.from_bytes(body, "big")
        elif marker == 0xFE:
            im.comment = body
        elif marker == 0xDA:
            n = body[0]
            comps = tuple(body[1 + 2 * i] for i in range(n))
            first, stop, bits = body[1 + 2 * n : 4 + 2 * n]
            slot = body[2]
            tables = tuple(huff.get(body[2 + 2 * i] >> 4) for i in range(n)) if first == 0 else (huff.get(0x10 | slot & 15),)
            begin = at + 2 + size
            i = int(np.searchsorted(ff, begin))
            j = i
            cuts = []
            while kind[j] == 0 or 0xD0 <= kind[j] <= 0xD7 or kind[j] == 0xFF:
                if 0xD0 <= kind[j] <= 0xD7:
                    cuts.append(int(ff[j]))
                j += 1
            end = int(ff[j])
            im.scans.append(((comps, first, stop, bits >> 4, bits & 15, restart, tables), [begin, *(c + 2 for c in cuts)]))
            at = end
            continue
        at += 2 + size


class Reader:
    """Files of one batch, decoded together. All must be 4:2:0 with whole MCUs, as ``encode`` writes them."""

    def __init__(self, files: list[bytes]):
        data = b"".join(files) + bytes(16)
        raw = np.frombuffer(data, np.uint8)
        ff = np.flatnonzero(raw[:-1] == 255)
        kind = raw[ff + 1]
        shift = np.cumsum([0, *map(len, files)])[:-1]
        self.images = [_parse(data, int(s), ff, kind) for s in shift]
        for im in self.images:
            if [c[1:3] for c in im.comps] != [(2, 2), (1, 1), (1, 1)] or im.width % 16 or im.height % 16:
                raise ValueError("only 4:2:0 images of whole MCUs")
        keep = np.ones(len(raw), bool)
        keep[ff[kind == 0] + 1] = False
        self.bytes = raw[keep]
        self._moved = np.cumsum(keep) - keep
        wide = np.concatenate([self.bytes, np.zeros(8, np.uint8)]).astype(_U)
        self.window = np.zeros(len(self.bytes), _U)
        for k in range(8):
            self.window |= wide[k : k + len(self.bytes)] << _U(56 - 8 * k)
        self.width = np.array([im.width // 16 for im in self.images])
        self.height = np.array([im.height // 16 for im in self.images])
        self.mcus = self.width * self.height
        self.base = np.cumsum(6 * self.mcus) - 6 * self.mcus
        self.coef = np.zeros((int(6 * self.mcus.sum()), 64), np.int32)
        groups: dict = defaultdict(list)
        for i, im in enumerate(self.images):
            for ordinal, (spec, places) in enumerate(im.scans):
                groups[ordinal, spec].append((i, places))
        for (_, spec), members in sorted(groups.items(), key=lambda g: g[0][0]):
            self._scan(spec, members)

    def _bits(self, pos: np.ndarray) -> np.ndarray:
        """The next bits of every segment, the first in front; 57 or more are valid."""
        return self.window[pos >> 3] << (pos & 7).astype(_U)

    def _scan(self, spec: tuple, members: list) -> None:
        comps, first, stop, high, low, restart, tables = spec
        image = np.array([m[0] for m in members])
        units = self.mcus[image] * (4 if comps == (1,) else 1)
        per = np.full(len(image), restart) if restart else units
        n_seg = -(-units // per)
        pos = self._moved[np.concatenate([m[1] for m in members])].astype(np.int64) * 8
        owner = np.repeat(np.arange(len(image)), n_seg)
        number = np.arange(len(owner)) - (np.cumsum(n_seg) - n_seg)[owner]
        unit = number * per[owner]
        count = np.minimum(per[owner], units[owner] - unit)
        image = image[owner]
        if first == 0:
            self._dc(comps, high, low, tables, pos, image, unit, count)
            return
        skip = np.array([0, 4, 5])[comps[0] - 1] * self.mcus[image]
        begin = self.base[image] + skip + unit
        lookup = _lookup(list(tables[0][:16]), tables[0][16:])
        (self._ac_refine if high else self._ac_first)(first, stop, low, lookup, pos, begin, begin + count)

    def _dc(self, comps, high, low, tables, pos, image, unit, count) -> None:
        lookups = {} if high else {c: _lookup(list(t[:16]), t[16:]) for c, t in zip(comps, tables)}
        before = {c: np.zeros(len(pos), np.int64) for c in comps}
        for step in range(int(count.max())):
            on = np.flatnonzero(step < count)
            k = unit[on] + step
            if len(comps) > 1:
                rows = _mcu_blocks(self.base, self.width, self.height, image[on], k)
                order = [(c, j) for c in comps for j in {1: (0, 1, 2, 3), 2: (4,), 3: (5,)}[c]]
            else:
                rows = (self.base[image[on]] + np.array([0, 4, 5])[comps[0] - 1] * self.mcus[image[on]] + k)[:, None]
                order = [(comps[0], 0)]
            for c, j in order:
                v = self._bits(pos[on])
                if high:
                    self.coef[rows[:, j], 0] |= (v >> _U(63)).astype(np.int32) << low
                    pos[on] += 1
                    continue
                code = (v >> _U(48)).astype(np.int64)
                length, size = lookups[c][0][code], lookups[c][1][code]
                before[c][on] += _extended(v << length.astype(_U), size)
                self.coef[rows[:, j], 0] = before[c][on] << low
                pos[on] += length + size

    def _ac_first(self, first, stop, low, lookup, pos, row, end) -> None:
        lengths, symbols = lookup
        flat = self.coef.reshape(-1)
        k = np.full(len(pos), first)
        while len(pos):
            for _ in range(16):
                v = self._bits(pos)
                code = (v >> _U(48)).astype(np.int64)
                length, symbol = lengths[code], symbols[code]
                size = symbol & 15
                run = symbol >> 4
                k += run
                rest = v << length.astype(_U)
                none = size == 0
                if none.any():
                    # run 15: sixteen zeros; else the band ends here and in the blocks that a number adds
                    ends = none & (run < 15) & (row < end)
                    more = np.where(ends & (run > 0), (rest >> _U(1) >> (63 - run).astype(_U)).astype(np.int64) + (1 << run) - 1, 0)
                    live = (row < end) & ~none
                    flat[row[live] * 64 + k[live]] = _extended(rest[live], size[live]) << low
                    k += 1
                    pos += np.where(row < end, length + size + np.where(ends, run, 0), 0)
                    k = np.where(ends, stop + 1, k)
                    row = row + more
                else:
                    if (row < end).all():
                        flat[row * 64 + k] = _extended(rest, size) << low
                        pos += length + size
                    else:
                        live = row < end
                        flat[row[live] * 64 + k[live]] = _extended(rest[live], size[live]) << low
                        pos += np.where(live, length + size, 0)
                    k += 1
                over = k > stop
                row = row + over
                k = np.where(over, first, k)
            on = row < end
            if not on.all():
                pos, row, end, k = pos[on], row[on], end[on], k[on]

    def _ac_refine(self, first, stop, low, lookup, pos, begin, end) -> None:
        lengths, symbols = lookup
        width = stop - first + 1
        place = np.arange(width)
        left = np.zeros(len(pos), np.int64)  # blocks, this one included, that the band has ended for
        bit = 1 << low
        for step in range(int((end - begin).max())):
            on = np.flatnonzero(begin + step < end)
            row = begin[on] + step
            band = self.coef[row, first : stop + 1]
            known = band != 0
            at = np.zeros(len(on), np.int64)
            p, more = pos[on], left[on]
            busy = np.flatnonzero(more == 0)
            while len(busy):
                v = self._bits(p[busy])
                code = (v >> _U(48)).astype(np.int64)
                length, symbol = lengths[code], symbols[code]
                run, size = symbol >> 4, symbol & 15
                rest = v << length.astype(_U)
                ends = (size == 0) & (run < 15)
                extra = np.where(ends & (run > 0), (rest >> _U(1) >> (63 - run).astype(_U)).astype(np.int64), 0)
                more[busy] = np.where(ends, (1 << run) + extra, 0)
                p[busy] += length + np.where(ends, run, size)
                go = ~ends
                busy, run, size, rest = busy[go], run[go], size[go], rest[go]
                if not len(busy):
                    break
                ahead = place >= at[busy][:, None]
                zeros = np.cumsum(~known[busy] & ahead, axis=1)
                hit = (zeros == (run + 1)[:, None]) & ~known[busy] & ahead
                target = np.where(hit.any(axis=1), hit.argmax(axis=1), width)
                passed = known[busy] & ahead & (place < target[:, None])
                p[busy] += self._correct(band, busy, passed, p[busy], bit)
                new = (size == 1) & (target < width)
                band[busy[new], target[new]] = np.where(rest[new] >> _U(63) == 1, bit, -bit)
                at[busy] = target + 1
                busy = busy[target + 1 < width]
            ended = np.flatnonzero(more > 0)
            if len(ended):
                passed = known[ended] & (place >= at[ended][:, None])
                p[ended] += self._correct(band, ended, passed, p[ended], bit)
                more[ended] -= 1
            self.coef[row, first : stop + 1] = band
            pos[on], left[on] = p, more

    def _correct(self, band, rows, passed, pos, bit) -> np.ndarray:
        """Adds a correction bit to each passed coefficient; returns how many bits that took."""
        rank = np.cumsum(passed, axis=1)
        r, c = np.nonzero(passed)
        where = pos[r] + rank[r, c] - 1
        got = ((self.bytes[where >> 3] >> (7 - (where & 7)).astype(np.uint8)) & 1).astype(bool)
        r, c = rows[r[got]], c[got]
        band[r, c] += np.where(band[r, c] > 0, bit, -bit).astype(np.int32)
        return rank[:, -1]

    def payloads(self) -> list[bytes]:
        """The bytes that ``encode`` stored."""
        raw = (self.coef - OFFSET).astype(np.uint8)
        return [raw[b : b + int(im.comment[len(COMMENT) :]) // 64].tobytes() for b, im in zip(self.base, self.images)]

    def tensors(self) -> Iterator[tuple[int, np.ndarray]]:
        """(image, RGB tensor of height x width x 3) of every image; images of equal width are transformed together."""
        for w in np.unique(self.width):
            own = np.flatnonzero(self.width == w)
            planes = []
            for c, scale in enumerate((2, 1, 1)):
                n = self.mcus[own] * scale * scale
                start = self.base[own] + np.array([0, 4, 5])[c] * self.mcus[own]
                rows = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                quant = np.array([self.images[i].quant[self.images[i].comps[c][3]] for i in own[:1]][0])
                pixels = inverse_transform(self.coef[rows], quant)
                across = int(w) * scale
                plane = pixels.reshape(-1, across, 8, 8).transpose(0, 2, 1, 3).reshape(-1, across * 8)
                planes.append(plane if scale == 2 else plane.repeat(2, axis=0).repeat(2, axis=1))
            rgb = to_rgb(*planes)
            stop = np.cumsum(self.height[own] * 16)
            for i, a, b in zip(own, stop - self.height[own] * 16, stop):
                yield int(i), rgb[a:b]


def _extended(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The signed number in the leading ``size`` bits."""
    value = (bits >> _U(1) >> (63 - size).astype(_U)).astype(np.int64)
    return np.where(value < (1 << size >> 1), value - (1 << size) + 1, value)


_SCALE = 13
_BASIS = np.round(np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)]) * (1 << _SCALE))


def inverse_transform(coef: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """Pixels 0 to 255 of zigzag blocks. All sums are whole numbers below 2**53, so doubles hold them exactly."""
    natural = np.zeros((len(coef), 64))
    natural[:, ZIGZAG] = coef * quant
    rows = natural.reshape(-1, 8) @ _BASIS
    turned = rows.reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 8) @ _BASIS
    out = turned.reshape(-1, 8, 8).transpose(0, 2, 1)
    return np.clip(np.floor(out / (1 << 2 * _SCALE) + 128.5), 0, 255).astype(np.int32)


def to_rgb(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    """Full-range YCbCr to RGB, in 16-bit fixed point."""
    cb, cr, y = cb - 128, cr - 128, (y << 16) + (1 << 15)
    out = np.empty((*y.shape, 3), np.uint8)
    for k, v in enumerate((y + 91881 * cr, y - 22554 * cb - 46802 * cr, y + 116130 * cb)):
        out[:, :, k] = np.clip(v >> 16, 0, 255)
    return out


# ---------------------------------------------------------------- Spark


def _padded(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zero bytes up to a positive multiple of 64."""
    size = np.maximum(-(-np.diff(off) // 64), 1) * 64
    to = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(to[-1], np.uint8)
    out[np.arange(len(raw)) + np.repeat(to[:-1] - off[:-1], np.diff(off))] = raw
    return out, to


def _media_batches(full: bool):
    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, off in chunks(batch.column(1)):
                files = encode(*_padded(raw, off))
                reader = Reader(files)
                back = reader.payloads()
                feature, tensor = [""] * (j - i), [b""] * (j - i)
                for k, rgb in reader.tensors():
                    sums = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64)
                    means = sums * 1000 // (rgb.shape[0] * rgb.shape[1])
                    feature[k] = f"{rgb.shape[0]}x{rgb.shape[1]}x3;mean={means[0]},{means[1]},{means[2]};crc={zlib.crc32(rgb.tobytes()):08x}"
                    if full:
                        tensor[k] = rgb.tobytes()
                columns = {
                    "doc_id": batch.column(0)[i:j],
                    "n_bytes": pa.array(np.diff(off)),
                    "payload_bytes": pa.array([len(b) for b in back], pa.int64()),
                    "payload_sha256": pa.array([hashlib.sha256(b).hexdigest() for b in back]),
                    "tail_crc32": pa.array([zlib.crc32(b[-64:]) for b in back], pa.int64()),
                    "media_bytes": pa.array([len(f) for f in files], pa.int64()),
                    "media_sha256": pa.array([hashlib.sha256(f).hexdigest() for f in files]),
                    "feature": pa.array(feature),
                }
                if full:
                    columns |= {"media": pa.array(files, pa.binary()), "height": pa.array(reader.height * 16), "width": pa.array(reader.width * 16), "rgb": pa.array(tensor, pa.binary())}
                yield pa.RecordBatch.from_pydict(columns)

    return store


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_columns(docs: DataFrame, full: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with the figures of its stored form; ``full`` adds the file and the RGB tensor (row-major)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_media_batches(full), SCHEMA + (", media binary, height long, width long, rgb binary" if full else ""))
