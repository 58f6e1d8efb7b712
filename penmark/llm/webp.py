"""Lossless WebP (VP8L): a decoder of the whole format and a writer of palette images.

The decoder reads prefix codes, back-references, the colour cache and
meta prefix codes, and inverts the predictor, cross-colour, subtract-green and
palette transforms. The writer indexes colours, bundles indices, finds
back-references and gives symbols prefix codes by their counts. Images whose
green channel alone takes bits, as those of the writer do, are looked up at all
bit positions at once and then followed from code to code; those whose codes
all have one length are read a whole image at a time, all others symbol by symbol.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Fixed values of the format: the order in which code length code lengths are stored.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)

#: Fixed values of the format: (x, y) steps of the short distance codes 1 to 120.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3),
    (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3),
    (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5),
    (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7),
    (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6),
    (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)

LARGEST_SIDE = 1 << 14


class BadImage(ValueError):
    """The bytes are no lossless WebP image that this decoder can read."""


class Bits:
    """Reads little-endian bit fields; bits beyond the end are an error."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, len(data) * 8

    def peek(self) -> int:
        byte = self.at >> 3
        return int.from_bytes(self.data[byte : byte + 6], "little") >> (self.at & 7)

    def skip(self, n: int) -> None:
        self.at += n
        if self.at > self.end:
            raise BadImage("the image ends early")

    def read(self, n: int) -> int:
        value = self.peek() & ((1 << n) - 1)
        self.skip(n)
        return value


class PrefixCode:
    """A canonical prefix code, read from the least significant bit on."""

    def __init__(self, lengths: dict[int, int]):
        used = sorted((n, s) for s, n in lengths.items() if n)
        if not used:
            used = [(0, 0)]
        self.symbols = [s for _, s in used]
        self.flat = 0 if len(used) == 1 else used[0][0] if used[0][0] == used[-1][0] else None
        self.longest = 0 if len(used) == 1 else used[-1][0]
        self.table: list[tuple[int, int]] | None = None
        self.used = used
        if len(used) > 1 and sum(1 << (self.longest - n) for n, _ in used) != 1 << self.longest:
            raise BadImage("an incomplete prefix code")

    def read(self, bits: Bits) -> int:
        if not self.longest:
            return self.symbols[0]
        if self.table is None:
            self.table = self._table()
        symbol, n = self.table[bits.peek() & ((1 << self.longest) - 1)]
        bits.skip(n)
        return symbol

    def _table(self) -> list[tuple[int, int]]:
        table: list[tuple[int, int]] = [(0, 0)] * (1 << self.longest)
        code, last = 0, self.used[0][0]
        for n, symbol in self.used:
            code <<= n - last
            last = n
            reverse = int(f"{code:0{n}b}"[::-1], 2)
            for i in range(reverse, 1 << self.longest, 1 << n):
                table[i] = (symbol, n)
            code += 1
        return table


@lru_cache(maxsize=64)
def _even_code(symbols: int, length: int) -> PrefixCode:
    return PrefixCode(dict.fromkeys(range(symbols), length))


def _read_code(bits: Bits, alphabet: int) -> PrefixCode:
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        symbols = [bits.read(8 if wide else 1)]
        if two:
            symbols.append(bits.read(8))
        return PrefixCode(dict.fromkeys(symbols, 1))
    count = 4 + bits.read(4)
    code = PrefixCode({CODE_LENGTH_ORDER[i]: bits.read(3) for i in range(count)})
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    if code.flat == 0 and 0 < code.symbols[0] < 16:
        return _even_code(min(left, alphabet), code.symbols[0])
    lengths: dict[int, int] = {}
    at, previous = 0, 8
    table, mask = code._table() if code.longest else [(code.symbols[0], 0)], (1 << code.longest) - 1
    first = bits.at >> 3
    # Lengths take 14 bits each at most: they are read out of one number.
    value, used = int.from_bytes(bits.data[first : first + 2 * alphabet + 8], "little") >> (bits.at & 7), 0
    while at < alphabet and left:
        left -= 1
        n, size = table[value & mask]
        if n < 16:
            if n:
                lengths[at] = previous = n
            at += 1
        else:
            more, base = ((2, 3), (3, 3), (7, 11))[n - 16]
            times = base + (value >> size & (1 << more) - 1)
            if n == 16:
                for i in range(at, at + times):
                    lengths[i] = previous
            at += times
            size += more
        value >>= size
        used += size
    bits.skip(used)
    if at > alphabet:
        raise BadImage("too many code lengths")
    return PrefixCode(lengths)


def _number(bits: Bits, prefix: int) -> int:
    """A length or distance from its prefix symbol and extra bits."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _flat_pixels(bits: Bits, codes: list[PrefixCode], n: int) -> np.ndarray:
    """n pixels whose codes all have a fixed length, without back-references."""
    widths = [codes[i].flat for i in range(4)]
    total = sum(widths)
    start, stop = bits.at, bits.at + n * total
    bits.skip(n * total)
    raw = np.frombuffer(bits.data, dtype=np.uint8, count=(stop + 7 >> 3) - (start >> 3), offset=start >> 3)
    each = np.unpackbits(raw, bitorder="little")[start & 7 : (start & 7) + n * total].reshape(n, total)
    pixels, at = np.zeros(n, dtype=np.uint32), 0
    for code, width, shift in zip(codes, widths, (8, 16, 0, 24), strict=False):
        index = np.zeros(n, dtype=np.uint8)
        for i in range(at, at + width):
            index = index << 1 | each[:, i]
        pixels |= np.array(code.symbols, dtype=np.uint32)[index] << np.uint32(shift)
        at += width
    return pixels


#: Bytes of a stream that are looked up at once.
CHUNK = 1 << 17
#: Extra bits of the prefix symbols of lengths and distances, and the value that they are added to.
_EXTRA = np.array([0 if s < 4 else (s - 2) >> 1 for s in range(40)], dtype=np.int64)
_BASE = np.array([s + 1 if s < 4 else ((2 + (s & 1)) << ((s - 2) >> 1)) + 1 for s in range(40)], dtype=np.int64)


@lru_cache(maxsize=16)
def _reversed(n: int) -> np.ndarray:
    """The numbers of n bits with their bits in reverse order."""
    out = np.zeros(1, dtype=np.int64)
    for _ in range(n):
        out = np.concatenate([2 * out, 2 * out + 1])
    return out


def _looked_up(code: PrefixCode) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and length of the code that begins each possible window of its longest length."""
    if not code.longest:
        return np.array(code.symbols[:1], dtype=np.int16), np.zeros(1, dtype=np.uint8)
    lengths = np.array([n for n, _ in code.used], dtype=np.int64)
    which = np.repeat(np.arange(lengths.size), 1 << code.longest - lengths)[_reversed(code.longest)]
    return np.array(code.symbols, dtype=np.int16)[which], lengths.astype(np.uint8)[which]


def _green_pixels(bits: Bits, codes: list[PrefixCode], n: int, width: int) -> np.ndarray:
    """n pixels of which only green takes bits, with back-references: what would begin at each bit is looked up, then those that do are followed."""
    symbol, length = _looked_up(codes[0])
    far_symbol, far_length = _looked_up(codes[4])
    near = np.array([max(1, x + y * width) for x, y in NEAR], dtype=np.int64)
    out = bytearray(n)
    done, at = 0, bits.at
    while done < n:
        if at >= bits.end:
            raise BadImage("the image ends early")
        first = at >> 3
        raw = np.frombuffer(bits.data, np.uint8, count=min(CHUNK + 16, len(bits.data) - first), offset=first)
        size = min(CHUNK, raw.size)
        four = np.zeros(size + 16, dtype=np.uint32)
        for k in range(4):
            four[: max(0, raw.size - k)] |= raw[k:].astype(np.uint32) << np.uint32(8 * k)

        def peek(place: np.ndarray, four: np.ndarray = four) -> np.ndarray:
            return (four[place >> 3] >> (place & 7).astype(np.uint32)).astype(np.int64)

        window = (four[:size, None] >> np.arange(8, dtype=np.uint32) & np.uint32(symbol.size - 1)).ravel().astype(np.intp)
        green, step = symbol.take(window), length.take(window)
        copies = np.flatnonzero(green >= 256)
        kind, place = green[copies].astype(np.int64) - 256, copies + step[copies]
        copied = _BASE[kind] + (peek(place) & (1 << _EXTRA[kind]) - 1)
        place = place + _EXTRA[kind]
        seen = peek(place) & far_symbol.size - 1
        place, kind = place + far_length[seen], far_symbol[seen].astype(np.int64)
        back = _BASE[kind] + (peek(place) & (1 << _EXTRA[kind]) - 1)
        step[copies] = place + _EXTRA[kind] - copies
        back = np.where(back > 120, back - 120, near[np.minimum(back, 120) - 1])

        steps, here, end = step.tobytes(), at & 7, size * 8
        follow: list[int] = []
        add = follow.append
        while here < end:
            add(here)
            here += steps[here]
        begun = np.array(follow)
        ref = np.flatnonzero(green[begun] >= 256)
        which = np.searchsorted(copies, begun[ref])
        lengths = np.ones(begun.size, dtype=np.int64)
        lengths[ref] = copied[which]
        to = done + np.cumsum(lengths)
        used = int(np.searchsorted(to, n)) + 1  # what follows the last pixel is no code
        if used <= begun.size:
            here = int(begun[used - 1]) + steps[begun[used - 1]]
            begun, lengths, to = begun[:used], lengths[:used], to[:used]
            which, ref = which[ref < used], ref[ref < used]
        if to[-1] > n:
            raise BadImage("a back-reference outside the image")
        start = to - lengths
        plain = np.frombuffer(out, dtype=np.uint8)
        literal = np.ones(begun.size, dtype=bool)
        literal[ref] = False
        plain[start[literal]] = green[begun[literal]]
        del plain
        for s, k, d in zip(start[ref].tolist(), lengths[ref].tolist(), back[which].tolist(), strict=True):
            if d > s:
                raise BadImage("a back-reference outside the image")
            out[s : s + k] = out[s - d : s - d + k] if k <= d else (out[s - d : s] * (k // d + 1))[:k]
        done, at = int(to[-1]), first * 8 + here
    bits.skip(at - bits.at)
    red, blue, alpha = (codes[i].symbols[0] for i in (1, 2, 3))
    return np.frombuffer(out, np.uint8).astype(np.uint32) << np.uint32(8) | np.uint32(alpha << 24 | red << 16 | blue)


def _entropy_image(bits: Bits, width: int, height: int, top: bool) -> np.ndarray:
    """Pixels (ARGB, row by row) of an entropy-coded image; only the top image can have meta prefix codes."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise BadImage("a colour cache of more than 11 bits")
    groups, of_tile, tile_bits, tiles_wide = 1, None, 0, 0
    if top and bits.read(1):
        tile_bits = bits.read(3) + 2
        tiles_wide = -(-width >> tile_bits)
        of_tile = _entropy_image(bits, tiles_wide, -(-height >> tile_bits), False) >> 8 & 0xFFFF
        groups = int(of_tile.max()) + 1
    cache_size = 1 << cache_bits if cache_bits else 0
    codes = [[_read_code(bits, a) for a in (256 + 24 + cache_size, 256, 256, 256, 40)] for _ in range(groups)]
    n = width * height
    own = codes[0]
    if groups == 1 and not cache_bits and all(c.flat is not None and c.flat <= 8 for c in own[:4]) and own[0].symbols[-1] < 256:
        return _flat_pixels(bits, own, n)
    if groups == 1 and not cache_bits and own[0].longest and not any(c.longest for c in own[1:4]):
        return _green_pixels(bits, own, n, width)
    cache = [0] * cache_size
    pixels: list[int] = []
    while len(pixels) < n:
        if of_tile is not None:
            y, x = divmod(len(pixels), width)
            own = codes[of_tile[(y >> tile_bits) * tiles_wide + (x >> tile_bits)]]
        green = own[0].read(bits)
        if green < 256:
            red, blue, alpha = own[1].read(bits), own[2].read(bits), own[3].read(bits)
            new = [alpha << 24 | red << 16 | green << 8 | blue]
        elif green < 280:
            length = _number(bits, green - 256)
            code = _number(bits, own[4].read(bits))
            back = code - 120 if code > 120 else max(1, NEAR[code - 1][0] + NEAR[code - 1][1] * width)
            if back > len(pixels) or length > n - len(pixels):
                raise BadImage("a back-reference outside the image")
            new = [pixels[len(pixels) - back + i % back] for i in range(length)]
        else:
            new = [cache[green - 280]]
        pixels += new
        if cache_bits:
            for p in new:
                cache[(0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
    return np.array(pixels, dtype=np.uint32)


def _channels(pixels: np.ndarray) -> list[np.ndarray]:
    """Alpha, red, green, blue."""
    return [(pixels >> np.uint32(s) & np.uint32(255)).astype(np.int32) for s in (24, 16, 8, 0)]


def _joined(alpha: np.ndarray, red: np.ndarray, green: np.ndarray, blue: np.ndarray) -> np.ndarray:
    return sum((c & 255).astype(np.uint32) << np.uint32(s) for c, s in ((alpha, 24), (red, 16), (green, 8), (blue, 0)))


def _predicted(mode: int, left: tuple, top: tuple, top_right: tuple, top_left: tuple) -> tuple:
    """Channel-wise prediction of one pixel."""

    def mean(a: tuple, b: tuple) -> tuple:
        return tuple(x + y >> 1 for x, y in zip(a, b, strict=True))

    def clamped(values: list[int]) -> tuple:
        return tuple(min(255, max(0, v)) for v in values)

    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, top_left, strict=True))
        to_top = sum(abs(x - c) for x, c in zip(left, top_left, strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return clamped([x + t - c for x, t, c in zip(left, top, top_left, strict=True)])
    if mode == 13:
        return clamped([m + int((m - c) / 2) for m, c in zip(mean(left, top), top_left, strict=True)])
    simple = {
        1: lambda: left, 2: lambda: top, 3: lambda: top_right, 4: lambda: top_left,
        5: lambda: mean(mean(left, top_right), top), 6: lambda: mean(left, top_left), 7: lambda: mean(left, top),
        8: lambda: mean(top_left, top), 9: lambda: mean(top, top_right), 10: lambda: mean(mean(left, top_left), mean(top, top_right)),
    }
    return simple[mode]() if mode in simple else (255, 0, 0, 0)


@dataclass
class Transform:
    """A transform of the image as read; width is that before a palette bundles pixels."""

    kind: int
    width: int
    bits: int = 0
    data: np.ndarray | None = None

    def inverted(self, pixels: np.ndarray, height: int) -> np.ndarray:
        return (self._predictor, self._cross_colour, self._add_green, self._palette)[self.kind](pixels, height)

    def _tile(self, height: int) -> np.ndarray:
        """The transform's own pixel for each pixel."""
        wide = -(-self.width >> self.bits)
        y, x = np.divmod(np.arange(self.width * height), self.width)
        return self.data[(y >> self.bits) * wide + (x >> self.bits)]

    def _predictor(self, pixels: np.ndarray, height: int) -> np.ndarray:
        modes, width = (self._tile(height) >> 8 & 15).tolist(), self.width
        out = list(zip(*(c.tolist() for c in _channels(pixels)), strict=True))
        for i, residual in enumerate(out):
            if not i:
                guess = (255, 0, 0, 0)
            elif i < width:
                guess = out[i - 1]
            elif i % width == 0:
                guess = out[i - width]
            else:
                guess = _predicted(modes[i], out[i - 1], out[i - width], out[i - width + 1], out[i - width - 1])
            out[i] = tuple(r + g & 255 for r, g in zip(residual, guess, strict=True))
        return _joined(*(np.array(c, dtype=np.int32) for c in zip(*out, strict=True)))

    def _cross_colour(self, pixels: np.ndarray, height: int) -> np.ndarray:
        def delta(by: np.ndarray, colour: np.ndarray) -> np.ndarray:
            return by.astype(np.int8).astype(np.int32) * colour.astype(np.int8).astype(np.int32) >> 5

        _, red_to_blue, green_to_blue, green_to_red = _channels(self._tile(height))
        alpha, red, green, blue = _channels(pixels)
        red = red + delta(green_to_red, green) & 255
        return _joined(alpha, red, green, blue + delta(green_to_blue, green) + delta(red_to_blue, red))

    def _add_green(self, pixels: np.ndarray, height: int) -> np.ndarray:
        alpha, red, green, blue = _channels(pixels)
        return _joined(alpha, red + green, green, blue + green)

    def _palette(self, pixels: np.ndarray, height: int) -> np.ndarray:
        index = (pixels >> np.uint32(8) & np.uint32(255)).reshape(height, -1)
        if self.bits:
            each = 8 >> self.bits
            shifts = np.arange(1 << self.bits, dtype=np.uint32) * np.uint32(each)
            index = (index[:, :, None] >> shifts & np.uint32((1 << each) - 1)).reshape(height, -1)[:, : self.width]
        table = np.zeros(256, dtype=np.uint32)  # beyond the palette: transparent black
        table[: self.data.size] = self.data
        return table[index.ravel()]


def bundling(colours: int) -> int:
    """log2 of how many indices of a palette share a pixel."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _read_transform(bits: Bits, width: int, height: int) -> Transform:
    kind = bits.read(2)
    if kind < 2:
        size = bits.read(3) + 2
        return Transform(kind, width, size, _entropy_image(bits, -(-width >> size), -(-height >> size), False))
    if kind == 2:
        return Transform(kind, width)
    colours = bits.read(8) + 1
    steps = _channels(_entropy_image(bits, colours, 1, False))
    return Transform(kind, width, bundling(colours), _joined(*(np.cumsum(c) for c in steps)))


def decode(file: bytes) -> np.ndarray:
    """The ARGB pixels (height x width) of a lossless WebP file."""
    if file[:4] != b"RIFF" or file[8:12] != b"WEBP":
        raise BadImage("no WebP file")
    at = 12
    while file[at : at + 4] != b"VP8L":
        if at + 8 > len(file):
            raise BadImage("no lossless image")
        at += 8 + (struct.unpack_from("<I", file, at + 4)[0] + 1 & ~1)
    size = struct.unpack_from("<I", file, at + 4)[0]
    bits = Bits(file[at + 8 : at + 8 + size])
    if bits.read(8) != 0x2F:
        raise BadImage("no lossless image")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise BadImage("an unknown version")
    transforms: list[Transform] = []
    coded_width = width
    while bits.read(1):
        transforms.append(_read_transform(bits, coded_width, height))
        if transforms[-1].kind == 3:
            coded_width = -(-coded_width >> transforms[-1].bits)
    pixels = _entropy_image(bits, coded_width, height, True)
    for transform in reversed(transforms):
        pixels = transform.inverted(pixels, height)
    return pixels.reshape(height, width)


class BitWriter:
    """Collects little-endian bit fields."""

    def __init__(self) -> None:
        self.value, self.n = 0, 0

    def add(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def flat_code(self, length: int) -> None:
        """A prefix code of the symbols 0 to 2**length - 1, each `length` bits long (2 at least)."""
        self.add(0, 1)
        place = CODE_LENGTH_ORDER.index(length)
        self.add(max(place + 1, 4) - 4, 4)
        for i in range(max(place + 1, 4)):
            self.add(int(i == place), 3)
        self.add(1, 1)
        self.add(3, 3)
        self.add((1 << length) - 2, 8)

    def one_symbol(self, symbol: int) -> None:
        """A prefix code of one symbol, which takes no bits."""
        self.add(1, 1)
        self.add(0, 1)
        self.add(1, 1)
        self.add(symbol, 8)


#: The bits of each symbol in a flat code of 8 bits, in the order in which they are written.
_CODE_BITS = (np.arange(256)[:, None] >> np.arange(7, -1, -1) & 1).astype(np.uint8)
#: Least symbols of a back-reference, most of one, and the symbols within which the writer looks for them.
LEAST_COPY, MOST_COPY, SPAN = 8, 4096, 1 << 20
#: Bits of a code at most; the format has 15, but readers look up a window of this size.
LONGEST = 12


def _code_lengths(counts: np.ndarray, most: int) -> dict[int, int]:
    """Lengths of a prefix code of least total size, `most` at most (counts are levelled till they fit), of the symbols that occur."""
    used = np.flatnonzero(counts).tolist()
    if len(used) < 2:
        return dict.fromkeys(used, 1)
    own = counts[used].tolist()
    while True:
        heap = [(c, i) for i, c in enumerate(own)]
        heapq.heapify(heap)
        parent = [0] * (2 * len(used) - 1)
        for new in range(len(used), 2 * len(used) - 1):
            c, i = heapq.heappop(heap)
            d, j = heap[0]
            parent[i] = parent[j] = new
            heapq.heapreplace(heap, (c + d, new))
        depth = [0] * len(parent)
        for i in range(len(parent) - 2, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if max(depth[: len(used)]) <= most:
            return dict(zip(used, depth, strict=False))
        own = [c + 1 >> 1 for c in own]


def _codes(lengths: dict[int, int], alphabet: int) -> tuple[np.ndarray, np.ndarray]:
    """The canonical code of each symbol, its first bit lowest, and its length; a lone symbol takes no bits."""
    codes, sizes = np.zeros(alphabet, dtype=np.uint64), np.zeros(alphabet, dtype=np.int64)
    if len(lengths) > 1:
        symbols, n = np.array(list(lengths)), np.array(list(lengths.values()))
        order = np.lexsort((symbols, n))
        symbols, n = symbols[order], n[order]
        room = 1 << n[-1] - n
        codes[symbols], sizes[symbols] = _reversed(int(n[-1]))[np.cumsum(room) - room], n
    return codes, sizes


@lru_cache(maxsize=1)
def _code_of_lengths() -> tuple[list[int], list[int], int, int]:
    """Codes and lengths of the symbols that tell code lengths, always the same: zeros, runs and middle lengths are short; and what tells them."""
    own = {0: 2, **dict.fromkeys((3, 4, 5, 6, 7, 8, 9, 10), 4), **dict.fromkeys((2, 11, 12, 16, 17, 18), 5), **dict.fromkeys((1, 13), 6), **dict.fromkeys((14, 15), 6)}
    codes, sizes = (c.tolist() for c in _codes(own, 19))
    out = BitWriter()
    out.add(0, 1)
    out.add(len(CODE_LENGTH_ORDER) - 4, 4)
    for s in CODE_LENGTH_ORDER:
        out.add(own[s], 3)
    out.add(0, 1)
    return codes, sizes, out.value, out.n


def _write_lengths(out: BitWriter, lengths: dict[int, int], alphabet: int) -> None:
    """A prefix code by its lengths: a lone symbol of 8 bits by itself, else lengths and runs of them under a code of their own."""
    if len(lengths) < 2:
        out.one_symbol(next(iter(lengths), 0))
        return
    row = np.zeros(alphabet, dtype=np.int64)
    row[list(lengths)] = list(lengths.values())
    ends = np.append(np.flatnonzero(np.diff(row)) + 1, alphabet).tolist()
    said: list[tuple[int, int, int]] = []  # symbol, extra, bits of it
    at = 0
    for end in ends:
        n, left = int(row[at]), end - at
        at = end
        if n:
            said.append((n, 0, 0))
            left -= 1
        while left >= 3:
            k = min(left, 6 if n else 138 if left > 10 else 10)
            said.append((16, k - 3, 2) if n else (18, k - 11, 7) if k > 10 else (17, k - 3, 3))
            left -= k
        said += [(n, 0, 0)] * left
    codes, sizes, head, head_size = _code_of_lengths()
    value, total = head, head_size
    for s, extra, n in said:
        value |= (codes[s] | extra << sizes[s]) << total
        total += sizes[s] + n
    out.add(value, total)


def _prefixed(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix symbols of lengths or distances, and their extra bits."""
    symbol = np.searchsorted(_BASE, value, side="right") - 1
    return symbol, value - _BASE[symbol]


@lru_cache(maxsize=64)
def _near_codes(width: int) -> np.ndarray:
    """The distance code of each distance that is near enough for a short one somewhere."""
    steps = [max(1, x + y * width) for x, y in NEAR]
    codes = np.arange(max(steps) + 1, dtype=np.int64) + 120
    for code in range(120, 0, -1):
        codes[steps[code - 1]] = code
    return codes


def _copies(symbols: np.ndarray) -> np.ndarray:
    """(start, length, distance) of back-references, none over another: runs of places whose next LEAST_COPY symbols stood at one distance before, the first first."""
    places = symbols.size - LEAST_COPY + 1
    if places < 2:
        return np.zeros((0, 3), dtype=np.int64)
    value = np.zeros(places, dtype=np.uint64)
    for k in range(LEAST_COPY):
        value = value << np.uint64(8) | symbols[k : k + places]
    order = np.argsort(value, kind="stable")
    again = np.flatnonzero(value[order[1:]] == value[order[:-1]])
    back = np.zeros(places + 1, dtype=np.int64)
    back[order[again + 1]] = order[again + 1] - order[again]
    back[back > (1 << 20) - 120] = 0
    turn = np.append(0, np.flatnonzero(back[1:] != back[:-1]) + 1)
    some = np.flatnonzero(back[turn[:-1]])
    found, free = [], 0
    for start, end, distance in zip(turn[some].tolist(), (turn[some + 1] + LEAST_COPY - 1).tolist(), back[turn[some]].tolist(), strict=True):
        if start < free:
            start = free
        while end - start >= LEAST_COPY:
            n = end - start if end - start < MOST_COPY else MOST_COPY
            found.append((start, n, distance))
            start = free = start + n
    return np.array(found, dtype=np.int64).reshape(-1, 3)


@dataclass
class _Tokens:
    """Literals and back-references of a span in order: green symbols, and for those of `at` extra bits and distances."""

    green: np.ndarray
    at: np.ndarray
    extra: np.ndarray
    far: np.ndarray
    far_extra: np.ndarray

    @classmethod
    def of(cls, symbols: np.ndarray, width: int) -> _Tokens:
        start, length, distance = _copies(symbols).T
        covered = np.zeros(symbols.size + 1, dtype=np.int32)
        covered[start] += 1
        np.subtract.at(covered, start + length, 1)
        begins = np.cumsum(covered[:-1]) == 0
        begins[start] = True
        places = np.flatnonzero(begins)
        green, at = symbols[places].astype(np.int64), np.searchsorted(places, start)
        prefix, extra = _prefixed(length)
        green[at] = 256 + prefix
        near = _near_codes(width)
        code = np.where(distance < near.size, near[np.minimum(distance, near.size - 1)], distance + 120)
        return cls(green, at, extra, *_prefixed(code))

    def packed(self, green: tuple[np.ndarray, np.ndarray], far: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The bits of each token, 58 at most, and how many they are."""
        value, size = green[0][self.green], green[1][self.green]
        more, n = value[self.at], size[self.at]
        for bits, count in ((self.extra, _EXTRA[self.green[self.at] - 256]), (far[0][self.far], far[1][self.far]), (self.far_extra, _EXTRA[self.far])):
            more, n = more | bits.astype(np.uint64) << n.astype(np.uint64), n + count
        value[self.at], size[self.at] = more, n
        return value, size


def _spans(symbols: np.ndarray, width: int) -> Iterator[_Tokens]:
    for low in range(0, symbols.size, SPAN):
        yield _Tokens.of(symbols[low : low + SPAN], width)


def write_grey(samples: np.ndarray) -> bytes:
    """A file of 8-bit samples (height x width) as the green channel of a palette image.

    The palette holds the used values in order. Indices, bundled where they are
    few, become literals and back-references within spans of SPAN, under prefix
    codes by how often each occurs.
    """
    height, width = samples.shape
    palette = np.flatnonzero(np.bincount(samples.ravel(), minlength=256))
    lookup = np.zeros(256, dtype=np.uint8)
    lookup[palette] = np.arange(palette.size)
    index = lookup[samples]
    shared = bundling(palette.size)
    if shared:
        each = 8 >> shared
        index = np.pad(index, ((0, 0), (0, -width % (1 << shared)))).reshape(height, -1, 1 << shared)
        index = (index << (np.arange(1 << shared, dtype=np.uint8) * each)).sum(axis=2, dtype=np.uint8)
    spans = list(_spans(index.ravel(), index.shape[1]))
    green = _code_lengths(sum(np.bincount(s.green, minlength=280) for s in spans), LONGEST)
    far = _code_lengths(sum(np.bincount(s.far, minlength=40) for s in spans), LONGEST)

    out = BitWriter()
    out.add(0x2F, 8)
    out.add(width - 1, 14)
    out.add(height - 1, 14)
    out.add(0, 4)
    out.add(1, 1)
    out.add(3, 2)
    out.add(palette.size - 1, 8)
    out.add(0, 1)
    out.flat_code(8)
    out.one_symbol(0)
    out.one_symbol(0)
    out.add(1, 1)  # alpha is 255 at first and adds 0 from then on
    out.add(1, 1)
    out.add(1, 1)
    out.add(0, 8)
    out.add(255, 8)
    out.one_symbol(0)
    steps = np.zeros((palette.size, 9), dtype=np.uint8)
    steps[:, :8] = _CODE_BITS[np.diff(palette, prepend=0) & 255]
    steps[0, 8] = 1
    out.add(int.from_bytes(np.packbits(steps, bitorder="little").tobytes(), "little"), steps.size)
    out.add(0, 1)  # no further transform
    out.add(0, 1)  # no colour cache: indices are as short
    out.add(0, 1)  # one group of codes
    _write_lengths(out, green, 280)
    out.one_symbol(0)
    out.one_symbol(0)
    out.one_symbol(255)
    _write_lengths(out, far, 40)

    parts = [s.packed(_codes(green, 280), _codes(far, 40)) for s in spans]
    total = out.n + sum(int(size.sum()) for _, size in parts)
    words = np.zeros((total >> 6) + 2, dtype=np.uint64)
    head = np.frombuffer(out.value.to_bytes((out.n >> 6) * 8 + 8, "little"), dtype="<u8")
    words[: head.size] = head
    begin = out.n
    for value, size in parts:
        end = begin + np.cumsum(size)
        place = end - size
        shift = (place & 63).astype(np.uint64)
        of = place >> 6
        firsts = np.flatnonzero(np.diff(of, prepend=-1))
        words[of[firsts]] += np.add.reduceat(value << shift, firsts)  # no two share a bit
        words[of[firsts] + 1] += np.add.reduceat(value >> np.uint64(1) >> (np.uint64(63) - shift), firsts)
        begin = int(end[-1])
    data = words.astype("<u8").tobytes()[: total + 7 >> 3]
    padded = data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(padded)) + b"WEBPVP8L" + struct.pack("<I", len(data)) + padded
