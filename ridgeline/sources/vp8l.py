"""Decoding lossless WebP pictures (VP8L), which terrain tiles come in: prefix codes, back references, a
colour cache and four transforms that are undone in reverse order."""

from __future__ import annotations

import numpy as np

# Fixed values of the format: order in which code-length code lengths are stored, and the distances that the
# shortest distance codes stand for, as (x, y) offsets.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)


class Bits:
    """Bits from the lowest of each byte on."""

    def __init__(self, data: bytes):
        self.value, self.left, self.data, self.at = 0, 0, data, 0

    def fill(self, n: int) -> None:
        while self.left < n:
            part = self.data[self.at : self.at + 8]
            if not part:
                raise ValueError("the picture ends too early")
            self.value |= int.from_bytes(part, "little") << self.left
            self.left += 8 * len(part)
            self.at += len(part)

    def read(self, n: int) -> int:
        if not n:
            return 0
        self.fill(n)
        out = self.value & ((1 << n) - 1)
        self.value >>= n
        self.left -= n
        return out


class Code:
    """A canonical prefix code, looked up by (length, bits read so far)."""

    def __init__(self, lengths: list[int]):
        used = [i for i, n in enumerate(lengths) if n]
        self.single = used[0] if len(used) == 1 else 0 if not used else None
        self.table: dict[int, int] = {}
        if self.single is not None:
            return
        if sum(2.0 ** -lengths[i] for i in used) != 1.0:
            raise ValueError("an incomplete prefix code")
        code, last = 0, 0
        for n, symbol in sorted((lengths[i], i) for i in used):
            code <<= n - last
            last = n
            self.table[1 << n | code] = symbol
            code += 1

    def read(self, b: Bits) -> int:
        if self.single is not None:
            return self.single
        key, table = 1, self.table
        while True:
            if not b.left:
                b.fill(1)
            key = key << 1 | b.value & 1
            b.value >>= 1
            b.left -= 1
            if (found := table.get(key)) is not None:
                return found
            if key >> 16:
                raise ValueError("a bad prefix code")


def _read_code(b: Bits, size: int) -> Code:
    lengths = [0] * size
    if b.read(1):
        two = b.read(1)
        first = b.read(8 if b.read(1) else 1)
        lengths[first] = 1
        if two:
            lengths[b.read(8)] = 1
        return Code(lengths)
    outer = [0] * 19
    for i in range(4 + b.read(4)):
        outer[LENGTH_ORDER[i]] = b.read(3)
    code = Code(outer)
    most = 2 + b.read(2 + 2 * b.read(3)) if b.read(1) else size
    i, previous = 0, 8
    while i < size and most:
        most -= 1
        s = code.read(b)
        if s < 16:
            lengths[i] = s
            previous = s or previous
            i += 1
            continue
        value, n = (previous, 3 + b.read(2)) if s == 16 else (0, 3 + b.read(3)) if s == 17 else (0, 11 + b.read(7))
        if i + n > size:
            raise ValueError("code lengths run over")
        lengths[i : i + n] = [value] * n
        i += n
    return Code(lengths)


def _extended(b: Bits, symbol: int) -> int:
    """The number that a length or distance symbol and its further bits stand for."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + b.read(extra) + 1


def _image(b: Bits, width: int, height: int, main: bool) -> list[int]:
    """Pixels as 32-bit ARGB."""
    cache_bits = b.read(4) if b.read(1) else 0
    if cache_bits > 11:
        raise ValueError("a bad colour cache")
    groups, meta, shift, across = 1, None, 0, 0
    if main and b.read(1):
        shift = b.read(3) + 2
        across = -(-width >> shift)
        meta = [p >> 8 & 0xFFFF for p in _image(b, across, -(-height >> shift), False)]
        groups = max(meta) + 1
    codes = [[_read_code(b, n) for n in (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)] for _ in range(groups)]
    out, total = [], width * height
    cache, hash_shift = [0] * (1 << cache_bits), 32 - cache_bits
    stored = 0
    group = codes[0]
    while len(out) < total:
        n = len(out)
        if meta is not None:
            group = codes[meta[(n // width >> shift) * across + (n % width >> shift)]]
        s = group[0].read(b)
        if s < 256:
            red, blue, alpha = group[1].read(b), group[2].read(b), group[3].read(b)
            out.append(alpha << 24 | red << 16 | s << 8 | blue)
        elif s < 280:
            length = _extended(b, s - 256)
            code = _extended(b, group[4].read(b))
            if code > 120:
                back = code - 120
            else:
                dx, dy = NEAR[code - 1]
                back = max(1, dx + dy * width)
            if back > n or n + length > total:
                raise ValueError("a bad reference")
            for _ in range(length):
                out.append(out[-back])
        else:
            while stored < n:
                cache[(0x1E35A7BD * out[stored] & 0xFFFFFFFF) >> hash_shift] = out[stored]
                stored += 1
            out.append(cache[s - 280])
    return out


def _planes(pixels: list[int], width: int) -> np.ndarray:
    """Rows of (alpha, red, green, blue)."""
    return np.array(pixels, dtype=">u4").view(np.uint8).reshape(-1, width, 4).astype(np.int64)


def _predict(a: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    """Adds each pixel's prediction from those decoded before it."""
    h, w, _ = a.shape
    rows = a.tolist()
    avg = lambda p, q: [(i + j) >> 1 for i, j in zip(p, q, strict=True)]
    clip = lambda v: 0 if v < 0 else 255 if v > 255 else v

    def select(left, top, corner):
        dl = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
        dt = sum(abs(x - c) for x, c in zip(left, corner, strict=True))
        return left if dl < dt else top

    for y in range(h):
        row, above = rows[y], rows[y - 1]
        for x in range(w):
            if y == 0:
                p = [255, 0, 0, 0] if x == 0 else row[x - 1]
            elif x == 0:
                p = above[0]
            else:
                m = int(modes[y >> bits, x >> bits]) & 15
                left, top, corner = row[x - 1], above[x], above[x - 1]
                right = above[x + 1] if x + 1 < w else row[0]
                if m == 1:
                    p = left
                elif m == 2:
                    p = top
                elif m == 3:
                    p = right
                elif m == 4:
                    p = corner
                elif m == 5:
                    p = avg(avg(left, right), top)
                elif m == 6:
                    p = avg(left, corner)
                elif m == 7:
                    p = avg(left, top)
                elif m == 8:
                    p = avg(corner, top)
                elif m == 9:
                    p = avg(top, right)
                elif m == 10:
                    p = avg(avg(left, corner), avg(top, right))
                elif m == 11:
                    p = select(left, top, corner)
                elif m == 12:
                    p = [clip(i + j - k) for i, j, k in zip(left, top, corner, strict=True)]
                elif m == 13:
                    p = [clip(v + int((v - k) / 2)) for v, k in zip(avg(left, top), corner, strict=True)]
                else:
                    p = [255, 0, 0, 0]
            row[x] = [(i + j) & 255 for i, j in zip(row[x], p, strict=True)]
    return np.array(rows, dtype=np.int64)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.where(x > 127, x - 256, x)


def decode(data: bytes) -> np.ndarray:
    """Height x width x RGBA of a lossless WebP file."""
    data = bytes(data)
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not WebP")
    at = 12
    while data[at : at + 4] != b"VP8L":
        if at + 8 > len(data):
            raise ValueError("no lossless picture")
        at += 8 + (int.from_bytes(data[at + 4 : at + 8], "little") + 1 & ~1)
    b = Bits(data[at + 8 : at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")])
    if b.read(8) != 0x2F:
        raise ValueError("not a lossless picture")
    width, height = b.read(14) + 1, b.read(14) + 1
    b.read(1)
    if b.read(3):
        raise ValueError("an unknown version")
    transforms, inner = [], width
    while b.read(1):
        kind = b.read(2)
        if kind in (0, 1):
            bits = b.read(3) + 2
            across = -(-inner >> bits)
            transforms.append((kind, bits, _planes(_image(b, across, -(-height >> bits), False), across), inner))
        elif kind == 2:
            transforms.append((kind, 0, None, inner))
        else:
            n = b.read(8) + 1
            table = np.cumsum(_planes(_image(b, n, 1, False), n)[0], axis=0) & 255
            bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            transforms.append((kind, bits, table, inner))
            inner = -(-inner >> bits)
    a = _planes(_image(b, inner, height, True), inner)
    for kind, bits, table, w in reversed(transforms):
        if kind == 0:
            a = _predict(a, table[..., 2], bits)
        elif kind == 1:
            y, x = np.arange(height)[:, None] >> bits, np.arange(a.shape[1])[None, :] >> bits
            red_blue, green_blue, green_red = (_signed(table[y, x, c]) for c in (1, 2, 3))
            green = _signed(a[..., 2])
            a[..., 1] = (a[..., 1] + (green_red * green >> 5)) & 255
            a[..., 3] = (a[..., 3] + (green_blue * green >> 5) + (red_blue * _signed(a[..., 1]) >> 5)) & 255
        elif kind == 2:
            a[..., 1] = (a[..., 1] + a[..., 2]) & 255
            a[..., 3] = (a[..., 3] + a[..., 2]) & 255
        else:
            x, per = np.arange(w), 8 >> bits
            index = a[:, x >> bits, 2] >> ((x & ((1 << bits) - 1)) * per) & ((1 << per) - 1)
            full = np.zeros((1 << per, 4), dtype=np.int64)
            full[: len(table)] = table
            a = full[index]
    return a[..., [1, 2, 3, 0]].astype(np.uint8)
