"""The lossless WebP decoder on streams of a small encoder that uses every part of the format."""

import itertools
import struct

import numpy as np
import pytest

from penmark.llm.webp import CODE_LENGTH_ORDER, NEAR, BadImage, BitWriter, decode, write_grey


def canonical(lengths):
    """symbol -> (code with its first bit lowest, length)."""
    out, code, last = {}, 0, 0
    for n, s in sorted((n, s) for s, n in lengths.items() if n):
        code <<= n - last
        last = n
        out[s] = (int(f"{code:0{n}b}"[::-1], 2), n)
        code += 1
    return out


def some_lengths(symbols):
    """A complete code of uneven lengths."""
    symbols = sorted(symbols)
    if len(symbols) <= 10:
        return {s: min(i + 1, len(symbols) - 1) for i, s in enumerate(symbols)}
    n = (len(symbols) - 1).bit_length()
    short = (1 << n) - len(symbols)
    return {s: n - (i < short) for i, s in enumerate(symbols)}


def write_code(out, symbols, alphabet):
    if len(symbols) <= 2 and max(symbols, default=0) < 256:
        own = sorted(symbols) or [0]
        out.add(1, 1)
        out.add(len(own) - 1, 1)
        out.add(1, 1)
        for s in own:
            out.add(s, 8)
        return {own[0]: (0, 0)} if len(own) == 1 else {own[0]: (0, 1), own[1]: (1, 1)}
    if len(symbols) == 1:
        symbols = {*symbols, 0}
    lengths = some_lengths(symbols)
    meta = {s: 4 if s < 13 else 5 for s in range(19)}
    codes = canonical(meta)
    out.add(0, 1)
    out.add(15, 4)
    for s in CODE_LENGTH_ORDER:
        out.add(meta[s], 3)
    out.add(0, 1)
    previous = 8
    for n, run in itertools.groupby(lengths.get(s, 0) for s in range(alphabet)):
        left = len(list(run))
        while left:
            if n == 0 and left >= 11:
                k = min(left, 138)
                out.add(*codes[18])
                out.add(k - 11, 7)
            elif n == 0 and left >= 3:
                k = min(left, 10)
                out.add(*codes[17])
                out.add(k - 3, 3)
            elif n and n == previous and left >= 3:
                k = min(left, 6)
                out.add(*codes[16])
                out.add(k - 3, 2)
            else:
                k = 1
                out.add(*codes[n])
                previous = n or previous
            left -= k
    return canonical(lengths)


def prefixed(value):
    """(symbol, extra bits, number of extra bits) of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    extra = v.bit_length() - 2
    return 2 * (extra + 1) + (v >> extra & 1), v & ((1 << extra) - 1), extra


def write_entropy_image(out, pixels, width, cache_bits=0, references=False, top=False, tile_bits=0):
    pixels = [int(p) for p in pixels]
    tokens, cache, i = [], [None] * (1 << cache_bits), 0
    place = lambda p: (0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache_bits)
    near = {dx + dy * width: k + 1 for k, (dx, dy) in reversed(list(enumerate(NEAR))) if dx + dy * width > 0}
    while i < len(pixels):
        n, back = 0, 0
        for b in ([1, width, width + 1, 200, width * 9 + 3] if references else []):
            k = 0
            while b <= i and i + k < len(pixels) and k < 4000 and pixels[i + k] == pixels[i + k - b]:
                k += 1
            if k > n:
                n, back = k, b
        at = i
        if n >= 3:
            tokens.append((at, "copy", n, near.get(back, back + 120)))
        elif cache_bits and cache[place(pixels[i])] == pixels[i]:
            n = 1
            tokens.append((at, "cache", place(pixels[i]), 0))
        else:
            n = 1
            tokens.append((at, "pixel", pixels[i], 0))
        for p in pixels[i : i + n]:
            if cache_bits:
                cache[place(p)] = p
        i += n
    out.add(int(cache_bits > 0), 1)
    if cache_bits:
        out.add(cache_bits, 4)
    groups, of_tile, wide = 1, [0], 0
    if top:
        out.add(int(tile_bits > 0), 1)
        if tile_bits:
            wide, high = -(-width >> tile_bits), -(-(len(pixels) // width) >> tile_bits)
            of_tile = [k % 3 for k in range(wide * high)]
            groups = max(of_tile) + 1
            out.add(tile_bits - 2, 3)
            write_entropy_image(out, [k << 8 for k in of_tile], wide)
    group = lambda at: of_tile[(at // width >> tile_bits) * wide + (at % width >> tile_bits)] if tile_bits else 0
    used = [[set() for _ in range(5)] for _ in range(groups)]
    for at, kind, a, b in tokens:
        own = used[group(at)]
        if kind == "pixel":
            for k, shift in enumerate((8, 16, 0, 24)):
                own[k].add(a >> shift & 255)
        elif kind == "cache":
            own[0].add(280 + a)
        else:
            own[0].add(256 + prefixed(a)[0])
            own[4].add(prefixed(b)[0])
    codes = [[write_code(out, s, a) for s, a in zip(own, (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40), strict=True)] for own in used]
    for at, kind, a, b in tokens:
        own = codes[group(at)]
        if kind == "pixel":
            for k, shift in enumerate((8, 16, 0, 24)):
                out.add(*own[k][a >> shift & 255])
        elif kind == "cache":
            out.add(*own[0][280 + a])
        else:
            for code, value in ((own[0], prefixed(a)), (own[4], prefixed(b))):
                out.add(*code[value[0] + (256 if code is own[0] else 0)])
                out.add(value[1], value[2])


def split(p):
    return [p >> s & 255 for s in (24, 16, 8, 0)]


def joined(c):
    return sum((v & 255) << s for v, s in zip(c, (24, 16, 8, 0), strict=True))


def signed(v):
    return v - 256 if v > 127 else v


def predict(mode, l, t, tr, tl):  # noqa: E741
    avg = lambda a, b: [x + y >> 1 for x, y in zip(a, b, strict=True)]
    clamp = lambda v: [min(255, max(0, x)) for x in v]
    if mode == 11:
        p = [a + b - c for a, b, c in zip(l, t, tl, strict=True)]
        return l if sum(abs(x - y) for x, y in zip(p, l, strict=True)) < sum(abs(x - y) for x, y in zip(p, t, strict=True)) else t
    half = lambda a, b: clamp([x + int((x - y) / 2) for x, y in zip(a, b, strict=True)])
    return [
        [255, 0, 0, 0], l, t, tr, tl, avg(avg(l, tr), t), avg(l, tl), avg(l, t), avg(tl, t), avg(t, tr), avg(avg(l, tl), avg(t, tr)), None,
        clamp([a + b - c for a, b, c in zip(l, t, tl, strict=True)]), half(avg(l, t), tl),
    ][mode]


def image_file(pixels, transforms=(), **entropy):
    height, width = pixels.shape
    out = BitWriter()
    out.add(0x2F, 8)
    out.add(width - 1, 14)
    out.add(height - 1, 14)
    out.add(1, 1)
    out.add(0, 3)
    flat = [int(p) for p in pixels.ravel()]
    for kind in transforms:
        out.add(1, 1)
        out.add(kind, 2)
        if kind == 0:
            out.add(0, 3)
            wide = -(-width >> 2)
            modes = [k % 14 for k in range(wide * -(-height >> 2))]
            write_entropy_image(out, [m << 8 for m in modes], wide)
            rows, residual = [split(p) for p in flat], []
            for i, own in enumerate(rows):
                y, x = divmod(i, width)
                if i == 0:
                    guess = [255, 0, 0, 0]
                elif y == 0:
                    guess = rows[i - 1]
                elif x == 0:
                    guess = rows[i - width]
                else:
                    guess = predict(modes[(y >> 2) * wide + (x >> 2)], rows[i - 1], rows[i - width], rows[i - width + 1], rows[i - width - 1])
                residual.append(joined([a - b for a, b in zip(own, guess, strict=True)]))
            flat = residual
        elif kind == 1:
            out.add(1, 3)
            wide = -(-width >> 3)
            tiles = [joined([255, 17 * k, 31 * k + 5, 200 + k]) for k in range(wide * -(-height >> 3))]
            write_entropy_image(out, tiles, wide)
            for i, p in enumerate(flat):
                a, r, g, b = split(p)
                _, rb, gb, gr = split(tiles[(i // width >> 3) * wide + (i % width >> 3)])
                delta = lambda t, c: signed(t) * signed(c) >> 5
                flat[i] = joined([a, r - delta(gr, g), g, b - delta(gb, g) - delta(rb, r)])
        elif kind == 2:
            flat = [joined([a, r - g, g, b - g]) for a, r, g, b in map(split, flat)]
        else:
            palette = sorted(set(flat))
            out.add(len(palette) - 1, 8)
            steps = [joined([x - y for x, y in zip(split(b), split(a), strict=True)]) for a, b in zip([0, *palette], palette, strict=False)]
            write_entropy_image(out, steps, len(palette))
            shared = 3 if len(palette) <= 2 else 2 if len(palette) <= 4 else 1 if len(palette) <= 16 else 0
            each, per = 8 >> shared, 1 << shared
            bundled = []
            for y in range(height):
                row = [palette.index(p) for p in flat[y * width : (y + 1) * width]]
                bundled += [sum(v << (each * k) for k, v in enumerate(row[x : x + per])) << 8 for x in range(0, width, per)]
            flat, width = bundled, -(-width // per)
    out.add(0, 1)
    write_entropy_image(out, flat, width, top=True, **entropy)
    data = out.value.to_bytes(out.n + 7 >> 3, "little")
    data += b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 20 + len(data)) + b"WEBPVP8L" + struct.pack("<I", len(data)) + data


def picture(seed, colours, shape=(19, 23)):
    rng = np.random.default_rng(seed)
    table = rng.integers(0, 1 << 32, colours, dtype=np.uint64).astype(np.uint32)
    image = table[rng.integers(0, colours, shape)]
    image[6:11] = image[5]
    image[13:15, :10] = table[0]
    return image


@pytest.mark.parametrize("transforms", [(), (0,), (1,), (2,), (0, 1, 2), (2, 0), (1, 0)])
@pytest.mark.parametrize("entropy", [{}, {"cache_bits": 4}, {"references": True}, {"references": True, "cache_bits": 7, "tile_bits": 3}])
def test_transforms_and_entropy_coding(transforms, entropy):
    image = picture(len(transforms), 60)
    assert (decode(image_file(image, transforms, **entropy)) == image).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 60])
@pytest.mark.parametrize("references", [False, True])
def test_palettes(colours, references):
    image = picture(colours, colours)
    assert (decode(image_file(image, (3,), references=references)) == image).all()
    assert (decode(image_file(image, (3, 0), references=references)) == image).all()


@pytest.mark.parametrize("values", [1, 2, 3, 4, 5, 16, 17, 33, 64, 65, 129, 256])
def test_writer(values):
    samples = np.random.default_rng(values).integers(0, values, (9, 64)).astype(np.uint8)
    pixels = decode(write_grey(samples))
    assert ((pixels >> 8 & 255) == samples).all() and (pixels >> 24 == 255).all()


def test_broken_files():
    file = write_grey(np.arange(64, dtype=np.uint8).reshape(1, 64))
    for bad in (b"", b"RIFF", file[:40], file[:20] + b"\0" + file[21:]):
        with pytest.raises((BadImage, struct.error)):
            decode(bad)


def test_the_writer_codes_by_counts_and_refers_back():
    """Frequent values get shorter codes, and what stood before is not written again; before, all took the same bits."""
    rng = np.random.default_rng(7)
    uneven = np.minimum(rng.geometric(0.5, 64 * 200), 40).astype(np.uint8)
    line = rng.integers(0, 200, 640, dtype=np.uint8)
    for samples, most in ((uneven.reshape(-1, 64), 0.35), (np.tile(line, 50).reshape(-1, 64), 0.06), (np.zeros((100, 64), np.uint8), 0.05)):
        file = write_grey(samples)
        assert np.array_equal((decode(file) >> np.uint32(8)).astype(np.uint8), samples)
        assert len(file) <= most * samples.size, len(file) / samples.size


@pytest.mark.parametrize("colours", [1, 2, 3, 5, 16, 17, 256])
@pytest.mark.parametrize("rows", [1, 2, 70, 9000])
def test_written_images_are_read_back(colours, rows):
    rng = np.random.default_rng(colours * rows)
    samples = np.repeat(rng.integers(0, colours, rows * 32, dtype=np.uint8), 2).reshape(rows, 64)
    samples[rows // 2 :] = samples[: rows - rows // 2]
    assert np.array_equal((decode(write_grey(samples)) >> np.uint32(8)).astype(np.uint8), samples)


def test_codes_stay_within_their_longest_length():
    counts = [1, 1]
    while len(counts) < 24:
        counts.append(counts[-1] + counts[-2])
    samples = np.random.default_rng(3).permutation(np.repeat(np.arange(24, dtype=np.uint8), counts))
    samples = np.pad(samples, (0, -samples.size % 64)).reshape(-1, 64)
    assert np.array_equal((decode(write_grey(samples)) >> np.uint32(8)).astype(np.uint8), samples)


def test_a_shortened_file_is_an_error():
    file = write_grey(np.random.default_rng(5).integers(0, 99, (40, 64), dtype=np.uint8))
    with pytest.raises(BadImage):
        decode(file[: len(file) // 2])
