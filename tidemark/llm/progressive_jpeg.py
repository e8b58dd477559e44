"""A progressive JPEG codec in numpy: scans accumulate in coefficient arrays, which alone make the pixels.

``decode`` reads any progressive (SOF2) file of 8-bit samples: spectral selection, successive
approximation, interleaved DC scans, restart intervals.  Runs that a table makes regular are
read as arrays: scans whose table has a single code, and the correction bits of end-of-band
runs.  ``encode`` stores bytes losslessly as AC coefficients of a 4:2:0 image.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np


def _zigzag() -> np.ndarray:
    """Raster positions by zigzag index: diagonals in turn, odd ones downwards."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    cells.sort(key=lambda rc: (rc[0] + rc[1], rc[0] if (rc[0] + rc[1]) % 2 else rc[1]))
    return np.array([r * 8 + c for r, c in cells])


ZIGZAG = _zigzag()
SHIFT = 20


def _inverse_matrix() -> np.ndarray:
    """Row k: the 64 pixels of coefficient k (zigzag), times 2**SHIFT, as whole numbers, so that sums are exact."""
    x = np.arange(8)
    wave = np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16) / 2
    wave[0] /= np.sqrt(2)
    both = np.einsum("ux,vy->uvxy", wave, wave).reshape(64, 64)
    return np.round(both[ZIGZAG] * (1 << SHIFT))


INVERSE = _inverse_matrix()


@dataclass
class Component:
    h: int
    v: int
    table: int
    width: int = 0  # in blocks, without padding
    height: int = 0
    coefficients: np.ndarray | None = None  # (rows of blocks, blocks, 64), zigzag, padded to whole MCUs


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: dict[int, Component] = field(default_factory=dict)
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    comments: list[bytes] = field(default_factory=list)


class Codes:
    """A Huffman table; ``single`` is (code length, symbol) if it has one code only."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.by_code: dict[tuple[int, int], int] = {}
        code = at = 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                self.by_code[length, code] = symbols[at]
                code, at = code + 1, at + 1
            code <<= 1
        self.single = next(((k[0], v) for k, v in self.by_code.items()), None) if len(self.by_code) == 1 else None


class Bits:
    """One entropy-coded interval, without stuffing."""

    def __init__(self, data: bytes):
        self.data, self.at, self._bits = np.frombuffer(data, np.uint8), 0, None

    @property
    def bits(self) -> np.ndarray:
        if self._bits is None:
            self._bits = np.unpackbits(self.data)
        return self._bits

    def take(self, n: int) -> int:
        value = 0
        for bit in self.bits[self.at : self.at + n].tolist():
            value = value << 1 | bit
        self.at += n
        return value

    def array(self, n: int) -> np.ndarray:
        self.at += n
        got = self.bits[self.at - n : self.at]
        if len(got) < n:
            raise ValueError("the scan ends too early")
        return got

    def symbol(self, codes: Codes) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | int(self.bits[self.at])
            self.at += 1
            if (length, code) in codes.by_code:
                return codes.by_code[length, code]
        raise ValueError("no such code")

    def regular(self, codes: Codes, n: int) -> np.ndarray | None:
        """n coded values at a constant stride, if the table has one code and no zero run."""
        if codes.single is None or self.at or codes.single[1] > 15:
            return None
        length, size = codes.single
        if length + size == 8:
            raw = self.data[:n] & ((1 << size) - 1)
            raw = raw.astype(np.int32)
        elif size:
            cells = self.array(n * (length + size)).reshape(n, -1)[:, length:]
            raw = cells @ (1 << np.arange(size - 1, -1, -1, dtype=np.int32))
        else:
            raw = np.zeros(n, np.int32)
        return np.where(raw >> (size - 1), raw, raw - (1 << size) + 1) if size else raw


def _extend(value: int, size: int) -> int:
    return value if size == 0 or value >> (size - 1) else value - (1 << size) + 1


def _dc_first(bits: Bits, order: np.ndarray, owner: np.ndarray, flat: dict[int, np.ndarray], codes: dict[int, Codes], low: int) -> None:
    regular = len({id(c) for c in codes.values()}) == 1
    steps = bits.regular(next(iter(codes.values())), len(order)) if regular else None
    if steps is None:
        steps = np.zeros(len(order), np.int32)
        for i, own in enumerate(owner.tolist()):
            size = bits.symbol(codes[own])
            steps[i] = _extend(bits.take(size), size)
    for own, blocks in flat.items():
        mine = owner == own
        blocks[order[mine], 0] = np.cumsum(steps[mine]) << low


def _ac_first(bits: Bits, blocks: np.ndarray, start: int, end: int, codes: Codes, low: int) -> None:
    values = bits.regular(codes, len(blocks) * (end - start + 1)) if codes.single and codes.single[1] & 15 else None
    if values is not None:
        blocks[:, start : end + 1] = (values << low).reshape(len(blocks), -1)
        return
    b = 0
    while b < len(blocks):
        k = start
        while k <= end:
            run, size = divmod(bits.symbol(codes), 16)
            if size == 0 and run < 15:
                b += (1 << run) + bits.take(run) - 1
                break
            k += run
            if size:
                blocks[b, k] = _extend(bits.take(size), size) << low
            k += 1
        b += 1


def _correct(bits: Bits, cells: np.ndarray, at: np.ndarray, low: int) -> None:
    """Correction bits of the non-zero cells ``at``."""
    got, now = bits.array(len(at)), cells[at]
    cells[at] = now + np.where((got > 0) & ((now & (1 << low)) == 0), np.sign(now) << low, 0)


def _ac_again(bits: Bits, blocks: np.ndarray, start: int, end: int, codes: Codes, low: int) -> None:
    cells = blocks.reshape(-1)  # a view: what is written lands in the blocks
    b = 0
    while b < len(blocks):
        k = start
        while k <= end:
            run, size = divmod(bits.symbol(codes), 16)
            if size == 0 and run < 15:
                length = (1 << run) + bits.take(run)
                held = blocks[b : b + length, start : end + 1] != 0
                held[0, : k - start] = False
                rows, columns = np.nonzero(held)
                _correct(bits, cells, (b + rows) * 64 + start + columns, low)
                b += length - 1
                break
            value = (1 if bits.take(1) else -1) << low if size else 0
            row = blocks[b]
            while k <= end:
                if row[k]:
                    _correct(bits, cells, np.array([b * 64 + k]), low)
                elif run:
                    run -= 1
                else:
                    row[k] = value
                    k += 1
                    break
                k += 1
        b += 1


_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def _scan(image: Image, chosen: list[tuple[Component, Codes | None, Codes | None]], band: tuple[int, int, int, int], data: bytes, interval: int) -> None:
    start, end, high, low = band
    parts = _RESTART.split(data) if interval else [data]
    if len(chosen) == 1:
        c = chosen[0][0]
        grid = (np.arange(c.height)[:, None] * c.coefficients.shape[1] + np.arange(c.width)).ravel()
        order, owner, units = grid, np.zeros(len(grid), np.int64), len(grid)
    else:
        rows, columns = (max(-(-c.height // c.v) for c, *_ in chosen), max(-(-c.width // c.h) for c, *_ in chosen))
        cells = []
        for n, (c, *_) in enumerate(chosen):
            y = np.arange(rows)[:, None, None, None] * c.v + np.arange(c.v)[None, None, :, None]
            x = np.arange(columns)[None, :, None, None] * c.h + np.arange(c.h)[None, None, None, :]
            at = (y * c.coefficients.shape[1] + x).reshape(rows * columns, -1)
            cells.append(np.stack([at, np.full_like(at, n)], axis=-1))
        both = np.concatenate(cells, axis=1)
        order, owner, units = both[..., 0].ravel(), both[..., 1].ravel(), rows * columns
    per_unit = len(order) // units
    flat = {n: c.coefficients.reshape(-1, 64) for n, (c, *_) in enumerate(chosen)}
    step = (interval or units) * per_unit
    for i, part in enumerate(parts):
        mine = slice(i * step, (i + 1) * step)
        if mine.start >= len(order):
            break
        bits = Bits(part.replace(b"\xff\x00", b"\xff"))
        if start == 0 and high == 0:
            _dc_first(bits, order[mine], owner[mine], flat, {n: dc for n, (_, dc, _) in enumerate(chosen)}, low)
        elif start == 0:
            got = bits.array(len(order[mine])).astype(np.int32) << low
            for n, blocks in flat.items():
                own = owner[mine] == n
                blocks[order[mine][own], 0] |= got[own]
        else:
            blocks = flat[0][order[mine]]
            (_ac_again if high else _ac_first)(bits, blocks, start, end, chosen[0][2], low)
            flat[0][order[mine]] = blocks


def decode(data: bytes) -> Image:
    """All scans of a progressive file, accumulated; a truncated or other file raises ValueError."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    image, at, interval = Image(), 2, 0
    tables: dict[int, Codes] = {}
    while True:
        marker = data[at + 1]
        if marker == 0xD9:
            return image
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE:
            image.comments.append(body)
        elif marker == 0xDD:
            interval = int.from_bytes(body[:2], "big")
        elif marker == 0xDB:
            while body:
                wide, name = divmod(body[0], 16)
                n = 128 if wide else 64
                image.quantisers[name] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = Codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC2:
            image.height, image.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            for i in range(body[5]):
                name, sampling, table = body[6 + 3 * i : 9 + 3 * i]
                image.components[name] = Component(sampling >> 4, sampling & 15, table)
            h, v = max(c.h for c in image.components.values()), max(c.v for c in image.components.values())
            for c in image.components.values():
                c.width, c.height = -(-(-(-image.width * c.h // h)) // 8), -(-(-(-image.height * c.v // v)) // 8)
                c.coefficients = np.zeros((-(-image.height // (8 * v)) * c.v, -(-image.width // (8 * h)) * c.h, 64), np.int32)
        elif marker == 0xDA:
            n = body[0]
            chosen = [(image.components[body[1 + 2 * i]], tables.get(body[2 + 2 * i] >> 4), tables.get(16 | body[2 + 2 * i] & 15)) for i in range(n)]
            start, end, bits = body[1 + 2 * n : 4 + 2 * n]
            stop = _MARKER.search(data, at)
            if stop is None:
                raise ValueError("the file has no end")
            _scan(image, chosen, (start, end, bits >> 4, bits & 15), data[at : stop.start()], interval)
            at = stop.start()
        elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
            raise ValueError("not a progressive file")


#: Blocks and pixel rows that are computed together, so that a large image takes few bytes a pixel beside its own.
_BLOCKS, _LINES = 8192, 256


def _pixels(images: list[Image]) -> np.ndarray:
    """(blocks, 64) samples of all components of all images."""
    blocks = [c.coefficients.reshape(-1, 64) * image.quantisers[c.table] for image in images for c in image.components.values()]
    blocks = np.concatenate(blocks) if len(blocks) > 1 else blocks[0]
    out = np.empty(blocks.shape, np.uint8)
    for a in range(0, len(blocks), _BLOCKS):
        sums = (blocks[a : a + _BLOCKS].astype(np.float64) @ INVERSE + (1 << SHIFT - 1)) / (1 << SHIFT)
        out[a : a + _BLOCKS] = np.clip(np.floor(sums) + 128, 0, 255)
    return out


def tensors(images: list[Image]) -> list[np.ndarray]:
    """(height, width, 3) RGB bytes of each image: inverse transform, chroma repeated to full size, colours."""
    if not images:
        return []
    pixels = _pixels(images)
    out, at = [], 0
    for image in images:
        h, v = max(c.h for c in image.components.values()), max(c.v for c in image.components.values())
        planes = []
        for c in image.components.values():
            rows, columns, _ = c.coefficients.shape
            plane = pixels[at : at + rows * columns].reshape(rows, columns, 8, 8).swapaxes(1, 2).reshape(rows * 8, columns * 8)
            at += rows * columns
            if v != c.v:
                plane = np.repeat(plane, v // c.v, axis=0)
            if h != c.h:
                plane = np.repeat(plane, h // c.h, axis=1)
            planes.append(plane[: image.height, : image.width])
        if len(planes) == 1:
            out.append(np.stack(planes * 3, axis=-1))
            continue
        tensor = np.empty((image.height, image.width, 3), np.uint8)
        for a in range(0, image.height, _LINES):
            y, blue, red = (p[a : a + _LINES].astype(np.int32) for p in planes)
            blue, red = blue - 128, red - 128
            # The colour weights 1.402, 0.344136, 0.714136 and 1.772 in 16-bit fixed point.
            colours = y + ((91881 * red + 32768) >> 16), y - ((22554 * blue + 46802 * red + 32768) >> 16), y + ((116130 * blue + 32768) >> 16)
            tensor[a : a + _LINES] = np.clip(np.stack(colours, axis=-1), 0, 255)
        out.append(tensor)
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _table(name: int, codes: dict[int, list[int]]) -> bytes:
    return bytes([name, *(len(codes.get(n, ())) for n in range(1, 17))]) + bytes(s for n in range(1, 17) for s in codes.get(n, ()))


#: Bytes stored in an MCU of four luma and two chroma blocks, 63 in each.
PER_MCU = 378
_MAX_MCU_ROWS = 4095
_HEAD = b"\xff\xd8" + _segment(0xDB, b"\x00" + b"\x01" * 64)
# DC differences are all 0; a first AC value is 7 bits behind code 0; end-of-band runs have 4-bit codes.
_TABLES = _segment(0xC4, _table(0x00, {1: [0x00]}) + _table(0x10, {1: [0x07]}) + _table(0x11, {4: [n << 4 for n in range(15)]}))


def _sos(components: list[int], tables: int, start: int, end: int, high: int, low: int) -> bytes:
    return _segment(0xDA, bytes([len(components), *(x for c in components for x in (c, tables)), start, end, high << 4 | low]))


def _run_bits(length: int) -> list[int]:
    """An end-of-band run of so many blocks: its code and the bits of its length."""
    size = length.bit_length() - 1
    return [*(size >> i & 1 for i in (3, 2, 1, 0)), *(length >> i & 1 for i in range(size - 1, -1, -1))]


def encode(payload: bytes) -> bytes:
    """A progressive 4:2:0 file whose AC coefficients hold the payload, one byte each.

    Byte b is the coefficient of magnitude 128 to 255 whose extra bits are b: b itself from
    128 on, b - 255 below.  The first scans send sign and upper bits, the refining scans
    the last bit of the magnitude.  The payload's size stands in a comment.
    """
    units = max(1, -(-len(payload) // PER_MCU))
    columns = -(-units // _MAX_MCU_ROWS)
    rows = -(-units // columns)
    cells = np.zeros(rows * columns * PER_MCU, np.uint8)
    cells[: len(payload)] = np.frombuffer(payload, np.uint8)
    blocks = rows * columns
    planes = {1: cells[: blocks * 252].reshape(-1, 63), 2: cells[blocks * 252 : blocks * 315].reshape(-1, 63), 3: cells[blocks * 315 :].reshape(-1, 63)}
    frame = bytes([8]) + (rows * 16).to_bytes(2, "big") + (columns * 16).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    flat = np.packbits(np.concatenate([np.zeros(blocks * 6, np.uint8), np.ones(-blocks * 6 % 8, np.uint8)])).tobytes()
    out = [_HEAD, _segment(0xFE, b"payload=%d" % len(payload)), _segment(0xC2, frame), _TABLES]
    out += [_sos([1, 2, 3], 0, 0, 0, 0, 1), flat, _sos([1, 2, 3], 0, 0, 0, 1, 0), flat]
    for name, plane in planes.items():
        # 7 bits of sign and magnitude: b >> 1 for either sign, as JPEG writes negative values by complement.
        upper = plane >> 1
        for start, end in ((1, 5), (6, 63)) if name == 1 else ((1, 63),):
            out += [_sos([name], 0, start, end, 0, 1), upper[:, start - 1 : end].tobytes()]
        last = np.where(plane >= 128, plane, 255 - plane) & 1
        bits = []
        for at in range(0, len(plane), 32767):
            part = last[at : at + 32767]
            bits += [np.array(_run_bits(len(part)), np.uint8), part.ravel()]
        bits = np.concatenate(bits)
        packed = np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes()
        out += [_sos([name], 1, 1, 63, 1, 0), packed.replace(b"\xff", b"\xff\x00")]
    return b"".join(out) + b"\xff\xd9"


def payload(image: Image) -> bytes:
    """What ``encode`` stored, from the coefficients."""
    size = next(int(c[8:]) for c in image.comments if c.startswith(b"payload="))
    cells = np.concatenate([c.coefficients[..., 1:].reshape(-1) for c in image.components.values()])[:size]
    return np.where(cells < 0, cells + 255, cells).astype(np.uint8).tobytes()
