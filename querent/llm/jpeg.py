"""Progressive JPEG in numpy: coefficients in, scans out, and back to RGB.

A payload of 64-byte blocks is stored losslessly as quantised coefficients: byte
k of a block plus 256 is coefficient k in zigzag order of one 8 x 8 block.  The
blocks fill Y, Cb and Cr of a 4:2:0 image in turn.  Every scan leaves the lowest
bit to a refinement scan (successive approximation), and Y's AC coefficients go
out in two bands (spectral selection).

The decoder accumulates scans into one coefficient array per component.  It
reads any run/size symbols and end-of-band runs; scans in which all symbols are
alike, as the encoder writes them, are checked and read as an array.
"""

from __future__ import annotations

import re
import struct

import numpy as np

OFFSET = 256
LAYOUT = ((1, 2, 2), (2, 1, 1), (3, 1, 1))  # component id, horizontal and vertical sampling
_MCU_BLOCKS = 6


def _zigzag() -> np.ndarray:
    """Natural index of each zigzag place: diagonals, every other one reversed."""
    cells = [(r + c, (r if (r + c) % 2 else c), r * 8 + c) for r in range(8) for c in range(8)]
    return np.array([n for _, _, n in sorted(cells)])


ZIGZAG = _zigzag()


def _basis() -> np.ndarray:
    """64 x 64: a row of coefficients times this is a row of samples."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    c = np.cos((2 * x + 1) * k * np.pi / 16) / 2
    c[0] /= np.sqrt(2)
    return np.kron(c, c).astype(np.float32)


BASIS = _basis()


def shape_for(blocks: int) -> tuple[int, int]:
    """MCU rows and columns of the smallest near-square-free strip that holds the blocks."""
    mcus = -(-blocks // _MCU_BLOCKS)
    rows = -(-mcus // 4095)
    return rows, -(-mcus // rows)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, at: int, symbols: list[int], width: int) -> bytes:
    """A Huffman table that gives all symbols codes of one width."""
    counts = [0] * 16
    counts[width - 1] = len(symbols)
    return _segment(0xC4, bytes([kind << 4 | at, *counts, *symbols]))


def _stuffed(bits: np.ndarray) -> bytes:
    pad = -len(bits) % 8
    if pad:
        bits = np.concatenate([bits, np.ones(pad, np.uint8)])
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def _scan(components: list[tuple[int, int, int]], band: tuple[int, int], high: int, low: int, data: bytes) -> bytes:
    head = bytes([len(components), *(x for c, dc, ac in components for x in (c, dc << 4 | ac)), *band, high << 4 | low])
    return _segment(0xDA, head) + data


_BITS16 = np.arange(15, -1, -1)


def _var_bits(values: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """The low ``width`` bits of each value, one after another."""
    keep = _BITS16[None, :] < widths[:, None]
    return ((values[:, None] >> _BITS16[None, :]) & 1)[keep].astype(np.uint8)


def _bit_size(values: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(np.abs(values) + 1)).astype(np.int64)


def mcu_order(rows: int, cols: int) -> tuple[np.ndarray, np.ndarray]:
    """(component, block in it) of every block of an interleaved scan."""
    r, c = np.divmod(np.arange(rows * cols), cols)
    y = [(2 * r + v) * 2 * cols + 2 * c + h for v in (0, 1) for h in (0, 1)]
    block = np.stack([*y, r * cols + c, r * cols + c], axis=1).ravel()
    return np.tile([0, 0, 0, 0, 1, 2], rows * cols), block


_EOB_SYMBOLS = [n << 4 for n in range(15)]


def encode(payload: bytes) -> bytes:
    """The image that holds a payload, whose length is a positive multiple of 64."""
    blocks = len(payload) // 64
    rows, cols = shape_for(blocks)
    mcus = rows * cols
    flat = np.full((mcus * _MCU_BLOCKS, 64), OFFSET, np.int64)
    flat[:blocks] += np.frombuffer(payload, np.uint8).reshape(-1, 64)
    parts = [flat[: 4 * mcus], flat[4 * mcus : 5 * mcus], flat[5 * mcus :]]
    out = [b"\xff\xd8", _segment(0xEF, b"payload\0" + struct.pack(">Q", len(payload)))]
    out.append(_segment(0xDB, bytes([0] + [1] * 64)))
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, rows * 16, cols * 16, 3) + b"".join(bytes([i, h << 4 | v, 0]) for i, h, v in LAYOUT)))
    out += [_table(0, 0, list(range(12)), 4), _table(1, 0, [8], 1), _table(1, 1, _EOB_SYMBOLS, 4)]

    which, block = mcu_order(rows, cols)
    dc = np.empty(len(which), np.int64)
    for i, p in enumerate(parts):
        dc[which == i] = p[block[which == i], 0]
    high = dc >> 1
    diff = np.empty_like(high)
    for i in range(3):
        diff[which == i] = np.diff(high[which == i], prepend=0)
    size = _bit_size(diff)
    code = np.stack([size, np.where(diff < 0, diff + (1 << size) - 1, diff)], axis=1).ravel()
    width = np.stack([np.full_like(size, 4), size], axis=1).ravel()
    everyone = [(i, 0, 0) for i, _, _ in LAYOUT]
    out.append(_scan(everyone, (0, 0), 0, 1, _stuffed(_var_bits(code, width))))
    for (i, _, _), p, bands in zip(LAYOUT, parts, (((1, 5), (6, 63)), ((1, 63),), ((1, 63),)), strict=True):
        for a, b in bands:
            part = (p[:, a : b + 1] >> 1).astype(np.uint8).ravel()
            bits = np.zeros((len(part), 9), np.uint8)
            bits[:, 1:] = np.unpackbits(part[:, None], axis=1)
            out.append(_scan([(i, 0, 0)], (a, b), 0, 1, _stuffed(bits.ravel())))
    out.append(_scan(everyone, (0, 0), 1, 0, _stuffed((dc & 1).astype(np.uint8))))
    for (i, _, _), p in zip(LAYOUT, parts, strict=True):
        bits = []
        for at in range(0, len(p), 32767):
            own = p[at : at + 32767, 1:]
            n = len(own).bit_length() - 1
            bits += [_var_bits(np.array([n, len(own) - (1 << n)]), np.array([4, n])), (own & 1).astype(np.uint8).ravel()]
        out.append(_scan([(i, 0, 1)], (1, 63), 1, 0, _stuffed(np.concatenate(bits))))
    return b"".join([*out, b"\xff\xd9"])


class Huffman:
    def __init__(self, counts: bytes, symbols: bytes):
        self.codes: dict[tuple[int, int], int] = {}
        self.symbol = np.full(1 << 16, -1, np.int64)
        self.width = np.zeros(1 << 16, np.int64)
        code = at = 0
        for width in range(1, 17):
            for _ in range(counts[width - 1]):
                first = code << (16 - width)
                self.symbol[first : first + (1 << (16 - width))] = symbols[at]
                self.width[first : first + (1 << (16 - width))] = width
                self.codes[width, code] = symbols[at]
                code, at = code + 1, at + 1
            code <<= 1


_tables: dict[bytes, Huffman] = {}


class Bits:
    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff") + b"\xff\xff\xff\xff", np.uint8))
        self.at = 0

    def take(self, n: int) -> int:
        v = 0
        for b in self.bits[self.at : self.at + n].tolist():
            v = v << 1 | b
        self.at += n
        return v

    def symbol(self, table: Huffman) -> int:
        code = 0
        for width in range(1, 17):
            code = code << 1 | int(self.bits[self.at + width - 1])
            if (s := table.codes.get((width, code))) is not None:
                self.at += width
                return s
        raise ValueError("bad Huffman code")


def _signed(v: int, size: int) -> int:
    return v if size == 0 or v >> (size - 1) else v - (1 << size) + 1


def _dc_first(bits: Bits, table: Huffman, n: int) -> np.ndarray:
    """n differences: the next place is computed for all bits, then followed."""
    b = bits.bits.astype(np.int64)
    peek = np.zeros(len(b) - 16, np.int64)
    for k in range(16):
        peek = peek << 1 | b[k : k + len(peek)]
    size = table.symbol[peek]
    start = np.arange(len(peek)) + table.width[peek]
    follow, at, places = (start + np.maximum(size, 0)).tolist(), 0, []
    for _ in range(n):
        places.append(at)
        at = follow[at]
    where = np.array(places, np.int64)
    size, start = size[where], start[where]
    if (size < 0).any():
        raise ValueError("bad Huffman code")
    raw = np.where(size > 0, peek[np.minimum(start, len(peek) - 1)] >> (16 - size), 0)
    return np.where((size > 0) & (raw >> np.maximum(size - 1, 0) == 0), raw - (1 << size) + 1, raw)


def _ac_first(bits: Bits, table: Huffman, coef: np.ndarray, a: int, b: int, low: int) -> None:
    total, width = coef.shape[0] * (b - a + 1), 0
    first = bits.symbol(table)
    width, bits.at = bits.at, 0
    size = first & 15
    stride = width + size
    if first == size > 0 and total * stride <= len(bits.bits):
        grid = bits.bits[: total * stride].reshape(total, stride)
        if (grid[:, :width] == grid[0, :width]).all():  # every place decodes to the same symbol
            raw = grid[:, width:].astype(np.int64) @ (1 << np.arange(size - 1, -1, -1))
            value = np.where(raw >> (size - 1), raw, raw - (1 << size) + 1)
            coef[:, a : b + 1] = value.reshape(-1, b - a + 1) << low
            return
    run = 0
    for row in coef:
        if run:
            run -= 1
            continue
        k = a
        while k <= b:
            r, size = divmod(bits.symbol(table), 16)
            if size:
                k += r
                row[k] = _signed(bits.take(size), size) * (1 << low)
                k += 1
            elif r == 15:
                k += 16
            else:
                run = (1 << r) + bits.take(r) - 1
                break


def _ac_refine(bits: Bits, table: Huffman, coef: np.ndarray, a: int, b: int, low: int) -> None:
    step, block, n = 1 << low, 0, len(coef)
    full = (coef[:, a : b + 1] != 0).all(axis=1)
    while block < n:
        row, k = coef[block], a
        while k <= b:
            r, size = divmod(bits.symbol(table), 16)
            value = 0
            if size:
                value = step if bits.take(1) else -step
            elif r < 15:
                run = (1 << r) + bits.take(r)
                while run:
                    span = 0
                    if k == a and full[block]:
                        stop = block + run
                        span = run if full[block:stop].all() else int(full[block:stop].argmin())
                    if span:
                        grid = bits.bits[bits.at : bits.at + span * (b - a + 1)].reshape(span, -1).astype(np.int64)
                        own = coef[block : block + span, a : b + 1]
                        own += np.sign(own) * grid * step
                        bits.at += grid.size
                        block, run = block + span, run - span
                    else:
                        for j in range(k, b + 1):
                            if coef[block, j] and bits.take(1):
                                coef[block, j] += step if coef[block, j] > 0 else -step
                        block, run, k = block + 1, run - 1, a
                break
            while k <= b:
                if row[k]:
                    if bits.take(1):
                        row[k] += step if row[k] > 0 else -step
                elif r == 0:
                    if value:
                        row[k] = value
                    k += 1
                    break
                else:
                    r -= 1
                k += 1
            if k > b:
                block += 1
        else:
            continue


_END = re.compile(rb"\xff[^\x00\xd0-\xd7]", re.S)


def decode_coefficients(data: bytes) -> tuple[list[np.ndarray], dict]:
    """Per component an array (blocks, 64) in zigzag order, and the frame."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no start of image")
    at, frame, coefs = 2, {"quant": {}, "payload": None}, []
    tables: dict[tuple[int, int], Huffman] = {}
    while data[at + 1] != 0xD9:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                frame["quant"][body[0] & 15] = np.frombuffer(body[1:65], np.uint8)
                body = body[65:]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                own = bytes(body[1 : 17 + n])
                tables[body[0] >> 4, body[0] & 15] = _tables.setdefault(own, None) or _tables.__setitem__(own, Huffman(own[:16], own[16:])) or _tables[own]
                body = body[17 + n :]
        elif marker == 0xC2:
            _, height, width, n = struct.unpack(">BHHB", body[:6])
            frame |= {"height": height, "width": width, "rows": -(-height // 16), "cols": -(-width // 16), "ids": [body[6 + 3 * i] for i in range(n)]}
            if [(body[6 + 3 * i + 1] >> 4, body[6 + 3 * i + 1] & 15) for i in range(n)] != [(h, v) for _, h, v in LAYOUT]:
                raise ValueError("only 4:2:0 in three components is read")
            mcus = frame["rows"] * frame["cols"]
            coefs = [np.zeros((mcus * h * v, 64), np.int64) for _, h, v in LAYOUT]
        elif marker == 0xEF and body[:8] == b"payload\0":
            frame["payload"] = struct.unpack(">Q", body[8:16])[0]
        elif marker == 0xDA:
            end = _END.search(data, at).start()  # type: ignore[union-attr]
            bits, at = Bits(data[at:end]), end
            n = body[0]
            chosen = [(frame["ids"].index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)]
            a, b, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
            if a == 0:
                if n > 1:
                    which, block = mcu_order(frame["rows"], frame["cols"])
                else:
                    block = np.arange(len(coefs[chosen[0][0]]))
                    which = np.full(len(block), chosen[0][0])
                if high:
                    value = bits.bits[: len(which)].astype(np.int64) << low
                else:
                    value = _dc_first(bits, tables[0, chosen[0][1]], len(which))
                for i, _, _ in chosen:
                    own = which == i
                    if high:
                        coefs[i][block[own], 0] |= value[own]
                    else:
                        coefs[i][block[own], 0] = np.cumsum(value[own]) << low
            else:
                i, _, ac = chosen[0]
                (_ac_refine if high else _ac_first)(bits, tables[1, ac], coefs[i], a, b, low)
    return coefs, frame


def payload_of(coefs: list[np.ndarray], frame: dict) -> bytes:
    n = frame["payload"]
    blocks, out = n // 64, []
    for c in coefs:
        out.append(c[: max(0, blocks)])
        blocks -= len(c)
    return (np.concatenate(out).ravel()[:n] - OFFSET).astype(np.uint8).tobytes()


def rgb_of(coefs: list[np.ndarray], frame: dict) -> np.ndarray:
    """Full-resolution (height, width, 3) bytes; chroma samples are repeated."""
    rows, cols = frame["rows"], frame["cols"]
    planes = []
    for c, (_, h, v) in zip(coefs, LAYOUT, strict=True):
        natural = np.zeros(c.shape, np.float32)
        natural[:, ZIGZAG] = c * frame["quant"][0]
        samples = natural @ BASIS + np.float32(128)
        plane = samples.reshape(rows * v, cols * h, 8, 8).swapaxes(1, 2).reshape(rows * v * 8, cols * h * 8)
        planes.append(plane if h == 2 else plane.repeat(2, axis=0).repeat(2, axis=1))
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    out = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)[: frame["height"], : frame["width"]]
