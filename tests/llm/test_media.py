import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from maskwright.llm import media, webp

RNG = np.random.default_rng(0)


def image(height, width, colours=None):
    if colours:
        table = RNG.integers(0, 2**32, colours, dtype=np.uint64).astype(np.uint32)
        return table[RNG.integers(0, colours, (height, width))]
    return RNG.integers(0, 2**32, (height, width), dtype=np.uint64).astype(np.uint32)


OPTIONS = [webp.Options(), webp.Options(copies=True), webp.Options(cache_bits=5), webp.Options(subtract_green=True), webp.Options(cross_colour=(5, 250, 17))]
OPTIONS += [webp.Options(predictor=mode) for mode in range(14)]
OPTIONS += [webp.Options(predictor=11, cross_colour=(200, 3, 9), subtract_green=True, cache_bits=3, copies=True)]


@pytest.mark.parametrize("options", OPTIONS)
@pytest.mark.parametrize("shape", [(1, 1), (1, 9), (9, 1), (13, 18)])
def test_round_trips(options, shape):
    for pixels in (image(*shape), image(*shape, colours=3), np.full(shape, 0x80FF0001, np.uint32)):
        assert (webp.decode(webp.encode(pixels, options)) == pixels).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 9, 16, 17, 256])
def test_palettes(colours):
    pixels = image(11, 21, colours)
    for options in (webp.Options(palette=True), webp.Options(palette=True, copies=True, cache_bits=2, predictor=1)):
        assert (webp.decode(webp.encode(pixels, options)) == pixels).all()
    with pytest.raises(ValueError):
        webp.encode(np.arange(300, dtype=np.uint32).reshape(10, 30), webp.Options(palette=True))


def bits(*fields):
    out = webp.BitWriter()
    for value, n in fields:
        out.write(value, n)
    return out


def test_copies_over_rows_and_meta_prefix_images():
    """A stream written by hand: two prefix groups, and a copy from the row above."""
    width = height = 8
    out = bits((webp.SIGNATURE, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3), (0, 1))  # no transform
    out.write(0, 1)  # no cache
    out.write(1, 1)  # a meta image
    out.write(0, 3)  # blocks of 4 by 4
    meta = np.array([0, 1, 0, 1], np.uint32) << np.uint32(8)
    webp.write_image(out, meta | np.uint32(0xFF000000), 2, False)
    codes = []
    for green in (10, 20):
        counts = [0] * 280
        counts[green] = counts[256] = counts[257] = counts[259] = 1
        codes.append(webp.write_code(out, webp.limited_lengths(counts)))
        for value in (1, 2, 255):
            webp.write_code(out, [int(i == value) for i in range(256)])
        webp.write_code(out, [1] + [0] * 39)  # distance code 1: the pixel above
    for x in range(width):
        codes[0 if x < 4 else 1].write(out, 10 if x < 4 else 20)
    row = [0xFF01 << 16 | g << 8 | 2 for g in [10] * 4 + [20] * 4]
    for _ in range(height - 1):
        # copies of 4 pixels: length symbol 259
        codes[0].write(out, 259)
        codes[1].write(out, 259)
    file = webp._riff([(b"VP8L", out.bytes())])
    assert webp.decode(file).tolist() == [row] * height


def by_spec(width, height, *fields):
    """A file of fields (value, bits), first bit lowest, without the encoder's help."""
    every = [(0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3), *fields]
    bits = [value >> k & 1 for value, n in every for k in range(n)]
    bits += [0] * (-len(bits) % 8)
    body = bytes(sum(bits[i + k] << k for k in range(8)) for i in range(0, len(bits), 8))
    chunk = b"VP8L" + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) & 1)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


def one(symbol):
    """A simple code of one symbol of eight bits."""
    return [(1, 1), (0, 1), (1, 1), (symbol, 8)]


def two(low, high):
    """A simple code of two symbols: bit 0 is the lower."""
    return [(1, 1), (1, 1), (1, 1), (low, 8), (high, 8)]


def constant(green, red, blue, alpha):
    return [*one(green), *one(red), *one(blue), *one(alpha), *one(0)]


def test_subtract_green_by_the_specification():
    file = by_spec(1, 1, (1, 1), (2, 2), (0, 1), (0, 1), (0, 1), *constant(10, 5, 250, 255))
    assert webp.decode(file).tolist() == [[0xFF0F0A04]]


@pytest.mark.parametrize(("mode", "green"), [(0, 1), (1, 3), (2, 3), (3, 3), (4, 2), (5, 3), (6, 2), (7, 3), (8, 2), (9, 3), (10, 2), (11, 3), (12, 4), (13, 3)])
def test_predictors_by_the_specification(mode, green):
    """Two by two pixels whose residuals are a green of 1: 1 and 2 above, 2 below them."""
    transform = [(1, 1), (0, 2), (0, 3), (0, 1), *constant(mode, 0, 0, 255)]
    file = by_spec(2, 2, *transform, (0, 1), (0, 1), (0, 1), *constant(1, 0, 0, 0))
    assert webp.decode(file).tolist() == [[0xFF000100, 0xFF000200], [0xFF000200, 0xFF000000 | green << 8]]


def test_cross_colour_by_the_specification():
    """Green to red 1, green to blue 2, red to blue -1: red 5 + 10, blue 7 + 20 - 15."""
    transform = [(1, 1), (1, 2), (0, 3), (0, 1), *constant(64, 0xE0, 32, 255)]
    file = by_spec(1, 1, *transform, (0, 1), (0, 1), (0, 1), *constant(10, 5, 7, 255))
    assert webp.decode(file).tolist() == [[0xFF0F0A0C]]


def test_palettes_by_the_specification():
    """Two colours, greens 3 and 3 + 9, and three pixels 1, 0, 1 in one."""
    table = [(0, 1), *two(3, 9), *one(0), *one(0), *two(0, 255), *one(0), (0, 1), (1, 1), (1, 1), (0, 1)]
    file = by_spec(3, 1, (1, 1), (3, 2), (1, 8), *table, (0, 1), (0, 1), (0, 1), *constant(0b101, 0, 0, 0))
    assert webp.decode(file).tolist() == [[0xFF000C00, 0xFF000300, 0xFF000C00]]


def test_a_copy_by_the_specification():
    """A code of the literal 7 and copies: the second symbol, 256, is written in a normal code."""
    # code lengths: 18 (138 zeros) + 17s make 7 and 256 the only symbols, each of one bit
    order = [0] * 19
    order[18], order[1], order[17] = 1, 2, 2
    own = [(order[s], 3) for s in webp.CODE_LENGTH_ORDER]
    eighteen, single, seventeen = (0, 1), (0b01, 2), (0b11, 2)
    lengths = [seventeen, (4, 3), single, eighteen, (127, 7), eighteen, (110 - 11, 7), single, eighteen, (23 - 11, 7)]
    green = [(0, 1), (15, 4), *own, (0, 1), *lengths]
    # distance code 2 is the pixel before; its prefix symbol is 1
    file = by_spec(3, 1, (0, 1), (0, 1), (0, 1), *green, *one(1), *one(2), *one(255), *one(1), (0, 1), (1, 1), (1, 1))
    assert webp.decode(file).tolist() == [[0xFF010702] * 3]


def test_both_ways_of_reading_agree(monkeypatch):
    """With and without a loop over symbols, also over many stretches of bits."""
    files = []
    for shape in ((20, 30), (3, 200), (50, 50)):
        for pixels in (image(*shape), image(*shape, colours=5), np.tile(image(5, shape[1]), (shape[0] // 5 + 1, 1))[: shape[0]]):
            files += [webp.encode(pixels, o) for o in OPTIONS] + [webp.encode(pixels, webp.Options(copies=True, cache_bits=4))]
    fast = [webp.decode(f) for f in files]
    monkeypatch.setattr(webp, "_STRETCH", 1 << 10)
    parted = [webp.decode(f) for f in files]
    monkeypatch.setattr(webp, "MANY", 1 << 40)
    assert all((a == webp.decode(f)).all() and (a == b).all() for a, b, f in zip(fast, parted, files))


def test_damaged_files(spark):
    """Cut at every byte and with every byte changed, a file is an image or an error."""
    rng, files, broken = np.random.default_rng(4), [], []
    for options in (webp.Options(), webp.Options(copies=True, cache_bits=3), webp.Options(predictor=11, copies=True), webp.Options(palette=True), webp.Options(cross_colour=(9, 8, 7), subtract_green=True)):
        files += [webp.encode(image(4, 5, colours=4), options), webp.encode(image(16, 20, colours=9), options)]
    for file in files:
        places = range(20, len(file)) if len(file) < 400 else rng.integers(20, len(file), 200)
        broken += [file[: int(k)] for k in places] + [file[: int(k)] + bytes([file[k] ^ 1 << int(rng.integers(8))]) + file[k + 1 :] for k in places if k > 24]
    ends = []
    for file in broken:
        try:
            ends.append(webp.decode(file).size)
        except ValueError:
            ends.append(None)
    assert ends.count(None) > len(ends) / 4
    df = spark.createDataFrame([(k, f) for k, f in enumerate(broken[::20])], "k int, file binary")
    assert [r.argb is None for r in media.pixel_arrays(df, "k", "file").orderBy("id").collect()] == [x is None for x in ends[::20]]


def test_broken_files():
    file = webp.encode(image(4, 4), webp.Options(copies=True))
    for broken in (b"", b"RIFF", file[:30], file.replace(b"VP8L", b"VP8 "), file[:20] + b"\0" + file[21:]):
        with pytest.raises(ValueError):
            webp.decode(broken)


def test_the_form_follows_the_content():
    def kind(data):
        payload = data.ljust(-(-len(data) // 64) * 64, b"\0")
        options, each = media.options_of(np.frombuffer(payload, np.uint8))
        file = media.media_of(payload)
        assert media.payload_of(file, webp.decode(file)) == payload
        return options.palette, options.predictor, options.cache_bits > 0, options.copies, each

    rng = np.random.default_rng(6)
    words = [bytes(rng.integers(97, 123, rng.integers(2, 9), dtype=np.uint8)) for _ in range(3000)]
    prose = b" ".join(words[k] for k in rng.integers(0, 3000, 9000))
    assert kind(b"0123 4567\n" * 300) == (True, None, False, True, 1)
    assert kind(bytes(range(32, 96)) * 40) == (False, 2, False, True, 1)
    assert kind(b"".join(bytes([k]) * 9 for k in range(30, 120))) == (False, 1, False, True, 1)
    assert kind(prose[:300]) == (False, None, False, False, 1)
    assert kind(prose[:5000] * 4) == (False, None, False, True, 1)
    assert kind(prose) == (False, None, True, False, 2)
    assert len(media.media_of(prose[: len(prose) // 64 * 64])) < 0.75 * len(prose)


def test_prefix_code_lengths_are_limited():
    fibonacci = [1, 1]
    while len(fibonacci) < 30:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    lengths = webp.limited_lengths(fibonacci)
    assert max(lengths) <= 15 and sum(2.0**-n for n in lengths) == 1
    with pytest.raises(ValueError):
        webp.PrefixCode([2, 2, 2])


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5000))
def test_length_prefixes(value):
    symbol, extra, n = webp._prefixed(value)
    assert webp._unprefixed(symbol, webp.BitReader(extra.to_bytes(4, "little"))) == value and extra < 1 << n or n == 0


@pytest.mark.parametrize("n", [64, 128, 64 * 16384, 64 * 16385, 64 * 50000])
def test_payloads(n):
    payload = RNG.integers(0, 256, n, dtype=np.uint8).tobytes()
    file = media.media_of(payload)
    assert media.payload_of(file, webp.decode(file)) == payload


def check(df):
    texts = {r.doc_id: (r.text or "").encode() for r in df.select("doc_id", "text").collect()}
    rows = media.read_back(media.stored(df)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        data = texts[r.doc_id]
        payload = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    return rows


def test_texts(documents, awkward):
    check(documents)
    rows = {r.doc_id: r for r in check(awkward)}
    assert rows[4].media_sha256 == rows[5].media_sha256 and rows[4].feature == rows[5].feature != rows[6].feature
    assert media.read_back(media.stored(awkward.limit(0))).count() == 0


def test_pixel_arrays(spark):
    pixels = image(2, 3)
    df = spark.createDataFrame([(1, webp.encode(pixels)), (2, None), (3, b"junk")], "k int, file binary")
    rows = {r.id: r for r in media.pixel_arrays(df, "k", "file").collect()}
    assert (rows[1].width, rows[1].height) == (3, 2) and [x & 0xFFFFFFFF for x in rows[1].argb] == pixels.ravel().tolist()
    assert rows[2].argb is None and rows[3].argb is None
