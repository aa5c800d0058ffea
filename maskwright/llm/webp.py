"""Lossless WebP (VP8L) from its public specification, in numpy.

``decode`` reads any still lossless image: simple and normal prefix codes, meta
prefix images, back-references with the 2-D distance map, the colour cache, and the
predictor, cross-colour, subtract-green and palette transforms. A damaged file is a
ValueError.

An image with one group of prefix codes is decoded without a loop over its symbols.
What a symbol that began there would be, and where the next began, is looked up for
every bit of a stretch; following those links from the first bit, sixteen at a time,
gives the symbols that are there. Copies are then made one by one, and cache hits
looked up among the literals before them.

``encode`` writes ARGB pixels with fitted prefix codes and, on request, any of the
transforms, a colour cache and back-references.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

# Fixed values of the format ---------------------------------------------------
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
DISTANCE_MAP = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
CACHE_FACTOR = 0x1E35A7BD
SIGNATURE = 0x2F
LONGEST_SIDE = 1 << 14

LONGEST_CODE, LONGEST_COPY = 15, 4096
#: Pixels from which an image is worth the set-up of decoding without a loop.
MANY = 256
_EIGHT = np.arange(8, dtype=np.uint32)
_STRETCH = 1 << 19
_REVERSED = [0]
for _bit in range(LONGEST_CODE):
    # the bits of a number of LONGEST_CODE bits in reverse
    _REVERSED = [*_REVERSED, *[x | 1 << (LONGEST_CODE - 1 - _bit) for x in _REVERSED]]


class BitReader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        """The next n bits, first bit lowest."""
        first, shift = self.at >> 3, self.at & 7
        value = int.from_bytes(self.data[first : first + (shift + n + 7) // 8], "little") >> shift
        self.at += n
        if self.at > 8 * len(self.data) + 4096:
            raise ValueError("the image ends early")
        return value & ((1 << n) - 1)

    def peek(self, n: int) -> int:
        """The next n bits, zeros beyond the end, without reading them."""
        first, shift = self.at >> 3, self.at & 7
        return (int.from_bytes(self.data[first : first + (shift + n + 7) // 8], "little") >> shift) & ((1 << n) - 1)


class BitWriter:
    """Bits, first bit lowest; whole bytes move to ``done`` with each long run."""

    def __init__(self):
        self.done, self.value, self.n = bytearray(), 0, 0

    def write(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def append(self, data: bytes, n: int) -> None:
        """n bits of ``data``."""
        self.value |= int.from_bytes(data, "little") << self.n
        self.n += n
        whole = self.n // 8
        self.done += (self.value & ((1 << 8 * whole) - 1)).to_bytes(whole, "little")
        self.value, self.n = self.value >> 8 * whole, self.n - 8 * whole

    def bytes(self) -> bytes:
        return bytes(self.done) + self.value.to_bytes((self.n + 7) // 8, "little")


# prefix codes -----------------------------------------------------------------


class PrefixCode:
    """A canonical prefix code; codes are read from their first bit."""

    def __init__(self, lengths: list[int]):
        self.lengths = lengths
        used = sorted([(n, symbol) for symbol, n in enumerate(lengths) if n])
        if not used:
            raise ValueError("a prefix code is empty")
        self.only = used[0][1] if len(used) == 1 else None
        self.longest = used[-1][0]
        self.codes: dict[int, tuple[int, int]] = {}
        code, last = 0, 0
        for n, symbol in used:
            code <<= n - last
            if code >> n:
                raise ValueError("a prefix code has too many codes")
            self.codes[symbol] = (_REVERSED[code] >> (LONGEST_CODE - n), n)
            code, last = code + 1, n
        if len(used) > 1 and code != 1 << last:
            raise ValueError("a prefix code is not complete")
        self._table: np.ndarray | None = None
        self._list: list[int] | None = None

    @property
    def table(self) -> np.ndarray:
        """symbol << 4 | length for each value of the next ``longest`` bits."""
        if self._table is None:
            self._table = np.zeros(1 << self.longest, np.int64)
            for symbol, (code, n) in self.codes.items():
                self._table[code :: 1 << n] = symbol << 4 | n
        return self._table

    @property
    def listed(self) -> list[int]:
        if self._list is None:
            self._list = self.table.tolist()
        return self._list

    def read(self, bits: BitReader) -> int:
        if self.only is not None:
            return self.only
        found = self.listed[bits.peek(self.longest)]
        bits.read(found & 15)
        return found >> 4

    def write(self, out: BitWriter, symbol: int) -> None:
        if self.only is None:
            out.write(*self.codes[symbol])


@lru_cache(4096)
def single(size: int, symbol: int) -> PrefixCode:
    """The code of one symbol, which takes no bits."""
    return PrefixCode([int(k == symbol) for k in range(size)])


@lru_cache(256)
def _shared(lengths: tuple[int, ...]) -> PrefixCode:
    """The code of code lengths, which many files have alike."""
    return PrefixCode(list(lengths))


def read_code(bits: BitReader, size: int) -> PrefixCode:
    if bits.read(1):
        head = bits.peek(18)
        wide = head >> 1 & 1
        first = head >> 2 & (255 if wide else 1)
        bits.at += 10 if wide else 3
        if not head & 1:
            return single(size, first)
        lengths = [0] * size
        lengths[first] = lengths[bits.read(8)] = 1
        return PrefixCode(lengths)
    many = 4 + bits.read(4)
    each, own = bits.read(3 * many), [0] * 19
    for k in range(many):
        own[CODE_LENGTH_ORDER[k]] = each >> 3 * k & 7
    code = _shared(tuple(own))
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    lengths = []
    last, only, mask = 8, code.only, (1 << code.longest) - 1
    table = None if only is not None else code.listed
    # a length takes 7 bits and 7 more at most; they are read from one number, some at a time
    ahead = known = taken = 0
    while len(lengths) < size and left > 0:
        left -= 1
        if known < 14:
            bits.at += taken
            taken, known = 0, 1024
            ahead = bits.peek(known)
        n, used = only, 0
        if n is None:
            found = table[ahead & mask]
            n, used = found >> 4, found & 15
        if n < 16:
            lengths.append(n)
            last = n or last
        else:
            more = (2, 3, 7)[n - 16]
            times = (ahead >> used & (1 << more) - 1) + (11 if n == 18 else 3)
            used += more
            lengths += [last if n == 16 else 0] * times
        ahead >>= used
        known -= used
        taken += used
    bits.at += taken
    bits.read(0)
    if len(lengths) > size:
        raise ValueError("code lengths run over")
    return PrefixCode(lengths + [0] * (size - len(lengths)))


def limited_lengths(counts: list[int], most: int = LONGEST_CODE) -> list[int]:
    """Prefix code lengths for symbol counts, none above ``most``."""
    used = [i for i, n in enumerate(counts) if n]
    lengths = [0] * len(counts)
    if len(used) <= 1:
        lengths[used[0] if used else 0] = 1
        return lengths
    floor, total = 0, sum(counts)
    while True:
        # leaves in order of weight, and inner nodes, which are made in that order
        weights = sorted((max(counts[i], floor), i) for i in used)
        n = len(weights)
        weight = [w for w, _ in weights]
        parent = [0] * (2 * n - 1)
        leaf, inner = 0, n
        for fresh in range(n, 2 * n - 1):
            both = 0
            for _ in range(2):
                if inner >= fresh or (leaf < n and weight[leaf] <= weight[inner]):
                    node, leaf = leaf, leaf + 1
                else:
                    node, inner = inner, inner + 1
                parent[node] = fresh
                both += weight[node]
            weight.append(both)
        depth = [0] * (2 * n - 1)
        for node in range(2 * n - 3, -1, -1):
            depth[node] = depth[parent[node]] + 1
        if max(depth[:n]) <= most:
            for k, (_, i) in enumerate(weights):
                lengths[i] = depth[k]
            return lengths
        floor = max(2 * floor, 1 + total // 4096)


#: The code that code lengths are written in, by length, and 17 and 18 for runs of zeros:
#: made for what text has. Lengths of 15 are not written.
_LENGTH_CODE = (4, 7, 7, 4, 4, 3, 3, 3, 3, 4, 4, 5, 5, 7, 7, 0, 0, 4, 5)


def write_code(out: BitWriter, lengths: list[int]) -> PrefixCode:
    """Write a code's lengths, with zero runs, and give the code."""
    used = [k for k, n in enumerate(lengths) if n]
    if len(used) == 1 and used[0] < 256:
        out.write(1 | 1 << 2 | used[0] << 3, 11)
        return single(len(lengths), used[0])
    code = PrefixCode(lengths)
    items, last = [], -1
    for k in [*used, len(lengths)]:
        gap = k - last - 1
        while gap >= 3:
            run = min(gap, 138)
            items.append((18, run - 11, 7) if run >= 11 else (17, run - 3, 3))
            gap -= run
        items += [(0, 0, 0)] * gap
        if k < len(lengths):
            items.append((lengths[k], 0, 0))
        last = k
    own = _shared(_LENGTH_CODE)
    out.write(15 << 1, 5)
    out.write(sum(_LENGTH_CODE[symbol] << 3 * k for k, symbol in enumerate(CODE_LENGTH_ORDER)), 57)
    out.write(0, 1)
    codes = own.codes
    value = n = 0
    for symbol, extra, more in items:
        bits, length = codes[symbol]
        value |= (bits | extra << length) << n
        n += length + more
    out.write(value, n)
    return code


def _prefixed(value: int) -> tuple[int, int, int]:
    """Prefix symbol, extra bits and their number of a length or distance from 1."""
    if value <= 4:
        return value - 1, 0, 0
    value -= 1
    high = value.bit_length() - 1
    n = high - 1
    return 2 * high + (value >> n & 1), value & ((1 << n) - 1), n


def _unprefixed(symbol: int, bits: BitReader) -> int:
    if symbol < 4:
        return symbol + 1
    n = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << n) + bits.read(n) + 1


# entropy-coded images ---------------------------------------------------------


def _cache_slot(argb: int, bits: int) -> int:
    return (CACHE_FACTOR * argb & 0xFFFFFFFF) >> (32 - bits)


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    dx, dy = DISTANCE_MAP[code - 1]
    return max(1, dx + dy * width)


def read_image(bits: BitReader, width: int, height: int, top: bool) -> np.ndarray:
    """The ARGB pixels of an entropy-coded image, as uint32 of height * width."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    meta, shift, groups = None, 0, 1
    if top and bits.read(1):
        shift = bits.read(3) + 2
        across = (width + (1 << shift) - 1) >> shift
        meta = (read_image(bits, across, (height + (1 << shift) - 1) >> shift, False) >> 8) & 0xFFFF
        groups = int(meta.max()) + 1
    sizes = (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [[read_code(bits, n) for n in sizes] for _ in range(groups)]
    n = width * height
    if groups == 1 and n >= MANY:
        return _read_many(bits, codes[0], width, n, cache_bits)
    out = np.zeros(n, np.uint32)
    colours = [0] * (1 << cache_bits)
    i, cached = 0, 0

    def remember(end: int) -> None:
        nonlocal cached
        while cached < end:
            argb = int(out[cached])
            colours[_cache_slot(argb, cache_bits)] = argb
            cached += 1

    while i < n:
        group = codes[int(meta[(i // width >> shift) * across + (i % width >> shift)])] if meta is not None else codes[0]
        symbol = group[0].read(bits)
        if symbol < 256:
            red, blue, alpha = (group[k].read(bits) for k in (1, 2, 3))
            out[i] = alpha << 24 | red << 16 | symbol << 8 | blue
            i += 1
        elif symbol < 280:
            length = _unprefixed(symbol - 256, bits)
            back = _distance(_unprefixed(group[4].read(bits), bits), width)
            if back > i or i + length > n:
                raise ValueError("a copy leaves the image")
            for k in range(i, i + length):
                out[k] = out[k - back]
            i += length
        else:
            remember(i)
            out[i] = colours[symbol - 280]
            i += 1
    return out


def _extra_bits(symbol: np.ndarray) -> np.ndarray:
    return np.maximum(symbol - 2, 0) >> 1


def _values(symbol: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """Lengths or distances of prefix symbols and their extra bits."""
    return np.where(symbol < 4, symbol + 1, (2 + (symbol & 1) << _extra_bits(symbol)) + extra + 1)


class _Stretch:
    """The bits of a stretch of an image's data, and what begins at each of them."""

    #: A symbol with its extra bits and its distance takes no more bits.
    SLACK = 128

    def __init__(self, data: bytes, at: int, codes: list[PrefixCode]):
        first = at >> 3
        own = np.frombuffer(data, np.uint8, min(_STRETCH // 8 + self.SLACK // 8 + 1, len(data) - first), first)
        self.first, self.n = 8 * first, 8 * len(own)
        padded = np.zeros(len(own) + 4, np.uint32)
        padded[: len(own)] = own
        words = padded[:-3] | padded[1:-2] << np.uint32(8) | padded[2:-1] << np.uint32(16) | padded[3:] << np.uint32(24)
        # 25 bits or more from each bit on; one place beyond the end leads nowhere
        self.ahead = (words[:, None] >> _EIGHT).reshape(-1)[: self.n + 1].astype(np.int64)
        self.codes = codes
        self.green = self.found(0)
        after = np.arange(self.n + 1) + (self.green & 15)
        following = after
        for k in (1, 2, 3):
            if codes[k].only is None:
                following = self.clipped(following)
                following = following + (self.found(k) & 15).take(following)
        if any(codes[0].lengths[256:]):
            symbol = self.green >> 4
            following = following.copy() if following is after else following
            copies = np.flatnonzero((symbol >= 256) & (symbol < 280))
            ends = self.clipped(after[copies] + _extra_bits(symbol[copies] - 256))
            distance = self.found(4)[ends]
            following[copies] = ends + (distance & 15) + _extra_bits(distance >> 4)
            cached = np.flatnonzero(symbol >= 280)
            following[cached] = after[cached]
        self.next = self.clipped(following)

    def clipped(self, places: np.ndarray) -> np.ndarray:
        return np.minimum(places, self.n)

    def found(self, k: int) -> np.ndarray:
        """symbol << 4 | bits of the k-th code at every bit."""
        code = self.codes[k]
        if code.only is not None:
            return np.full(self.n + 1, code.only << 4)
        return code.table.take(self.ahead & ((1 << code.longest) - 1))

    def symbols(self, at: int, end: int) -> np.ndarray:
        """The places of the symbols from ``at`` on that begin before ``end``."""
        hops = [self.next]
        for _ in range(4):
            hops.append(hops[-1].take(hops[-1]))
        far, place, stops = memoryview(hops[4]), at - self.first, []
        end = min(end - self.first, self.n)
        while place < end:
            stops.append(place)
            place = far[place]
        places = np.array(stops)
        for hop in hops[3::-1]:
            both = np.empty((len(places), 2), np.int64)
            both[:, 0], both[:, 1] = places, hop.take(places)
            places = both.reshape(-1)
        return places[places < end]

    def bits(self, places: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The n bits (25 at most) at each of the places."""
        return self.ahead[places] & ((1 << n) - 1)


def _read_many(bits: BitReader, codes: list[PrefixCode], width: int, n: int, cache_bits: int) -> np.ndarray:
    if all(c.only is not None for c in codes[:4]) and codes[0].only < 256:
        pixel = codes[3].only << 24 | codes[1].only << 16 | codes[0].only << 8 | codes[2].only
        return np.full(n, pixel, np.uint32)
    if codes[0].only is not None and codes[0].only >= 256:
        raise ValueError("an image begins with a copy")
    # by symbol: its green, the colour of a literal, its pixels and the distance of a copy
    parts: list[tuple] = []
    copying, caching = any(codes[0].lengths[256:280]), any(codes[0].lengths[280:])
    total = 0
    while total < n:
        if bits.at >= 8 * len(bits.data):
            raise ValueError("the image ends early")
        part = _Stretch(bits.data, bits.at, codes)
        places = part.symbols(bits.at, part.first + min(_STRETCH, part.n))
        found = part.green[places]
        green = found >> 4
        after = places + (found & 15)
        colour = green.astype(np.uint32) << np.uint32(8)
        at = after
        for k, shift in ((1, 16), (2, 0), (3, 24)):
            if codes[k].only is not None:
                colour |= np.uint32(codes[k].only << shift)
                continue
            at = part.clipped(at)
            channel = part.found(k).take(at)
            colour |= (channel >> 4).astype(np.uint32) << np.uint32(shift)
            at = at + (channel & 15)
        copy = np.flatnonzero((green >= 256) & (green < 280)) if copying else ()
        if not len(copy):
            used = min(len(places), n - total)
            total += used
            size = back = None
        else:
            size = np.ones(len(places), np.int64)
            back = np.zeros(len(places), np.int64)
            symbol, place = green[copy] - 256, part.clipped(after[copy])
            size[copy] = _values(symbol, part.bits(place, _extra_bits(symbol)))
            place = part.clipped(place + _extra_bits(symbol))
            distance = part.found(4)[place]
            place = part.clipped(place + (distance & 15))
            code = _values(distance >> 4, part.bits(place, _extra_bits(distance >> 4)))
            back[copy] = [_distance(x, width) for x in code.tolist()]
            ends = np.cumsum(size) + total
            used = int(np.searchsorted(ends, n)) + 1
            if used <= len(ends) and ends[used - 1] > n:
                raise ValueError("a copy leaves the image")
            used = min(used, len(ends))
            total = int(ends[used - 1])
            size, back = size[:used], back[:used]
        bits.at = part.first + int(part.next[places[used - 1]])
        parts.append((green[:used], colour[:used], size, back))
    if bits.at > 8 * len(bits.data):
        raise ValueError("the image ends early")
    green, colour = (np.concatenate([x[k] for x in parts]) if len(parts) > 1 else parts[0][k] for k in (0, 1))
    if not caching and all(x[2] is None for x in parts):
        return colour
    size = np.concatenate([np.ones(len(x[0]), np.int64) if x[2] is None else x[2] for x in parts])
    back = np.concatenate([np.zeros(len(x[0]), np.int64) if x[3] is None else x[3] for x in parts])
    return _laid(green, size, colour, back, cache_bits, n)


def _laid(green: np.ndarray, size: np.ndarray, colour: np.ndarray, back: np.ndarray, cache_bits: int, n: int) -> np.ndarray:
    """The pixels of symbols: literals, copies and cache hits."""
    copies, hits = np.flatnonzero(back), np.flatnonzero(green >= 280)
    place = np.cumsum(size) - size if len(copies) else size
    if (back[copies] > place[copies]).any():
        raise ValueError("a copy leaves the image")
    if len(hits) and len(copies):
        return _laid_in_turn(green, size, colour, back, cache_bits, n)
    if len(hits):
        # the slot that each symbol fills or reads; a hit has the colour of the last literal there
        slot = np.where(green < 280, ((colour * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - cache_bits)).astype(np.int64), green - 280)
        order = np.argsort(slot, kind="stable")
        known = green[order] < 280
        last = np.maximum.accumulate(np.where(known, np.arange(len(order)), -1))
        source = np.where(last >= 0, order[last], -1)
        missing = (source < 0) | (slot[source] != slot[order])
        filled = np.where(missing, np.uint32(0), colour[source])
        out = np.empty(len(order), np.uint32)
        out[order] = filled
        return out
    if not len(copies):
        return colour
    out = np.zeros(n, np.uint32)
    literal = back == 0
    out[place[literal]] = colour[literal]
    for a, length, distance in zip(place[copies].tolist(), size[copies].tolist(), back[copies].tolist(), strict=True):
        if distance >= length:
            out[a : a + length] = out[a - distance : a - distance + length]
        else:
            out[a : a + length] = np.resize(out[a - distance : a], length)
    return out


def _laid_in_turn(green: np.ndarray, size: np.ndarray, colour: np.ndarray, back: np.ndarray, cache_bits: int, n: int) -> np.ndarray:
    """The same where copies fill the cache that hits read."""
    out, slots, filled = [], [0] * (1 << cache_bits), 0
    for symbol, length, pixel, distance in zip(green.tolist(), size.tolist(), colour.tolist(), back.tolist(), strict=True):
        if symbol >= 280:
            for earlier in out[filled:]:
                slots[_cache_slot(earlier, cache_bits)] = earlier
            filled = len(out)
            out.append(slots[symbol - 280])
        elif distance:
            for _ in range(length):
                out.append(out[-distance])
        else:
            out.append(pixel)
    return np.array(out, np.uint32)


def found_copies(argb: np.ndarray, least: int = 12) -> list[tuple[int, int, int]]:
    """(place, length, distance) of copies of ``least`` pixels or more, in order.

    Runs of one pixel copy the pixel before; other stretches the first that begins
    with the same pixels. Candidates are found by hashes and compared.
    """
    n = len(argb)
    if n <= least:
        return []
    same = np.flatnonzero(argb[1:] == argb[:-1]) + 1
    runs = _stretches(same, np.ones(len(same), np.int64), 0) if len(same) >= least else []
    mark = _marks(argb, least)
    room = max(8, n.bit_length() + 1)
    key = (mark >> np.uint64(64 - room)).astype(np.int64)
    first = np.zeros(1 << room, np.int32)
    place = np.arange(len(mark), dtype=np.int32)
    first[key[::-1]] = place[::-1]
    source = first[key]
    again = np.flatnonzero((mark[source] == mark) & (source < place))
    found = _stretches(again, again - source[again], least - 1)
    chosen, done = [], 0
    for start, length, distance in sorted([r for r in runs if r[1] >= least] + found):
        if start < done:
            start, length = done, start + length - done
        if length >= least and (argb[start : start + length] == argb[start - distance : start - distance + length]).all():
            chosen += [(start + k, min(LONGEST_COPY, length - k), distance) for k in range(0, length, LONGEST_COPY)]
            done = start + length
    return chosen


def _marks(argb: np.ndarray, least: int) -> np.ndarray:
    """A hash of the ``least`` pixels from each place on, by doubling."""
    odd = np.uint64(0x9E3779B97F4A7C15)
    mark, have = (argb.astype(np.uint64) + np.uint64(0x632BE59B)) * odd, 1
    while have < least:
        step = min(have, least - have)
        mark = mark[: len(mark) - step] * odd + (mark[step:] ^ mark[step:] >> np.uint64(29))
        have += step
    return mark * odd


def _stretches(places: np.ndarray, distance: np.ndarray, more: int) -> list[tuple[int, int, int]]:
    """(first, length, distance) of runs of places at one distance."""
    if not len(places):
        return []
    fresh = np.ones(len(places), bool)
    fresh[1:] = (np.diff(places) != 1) | (np.diff(distance) != 0)
    first = np.flatnonzero(fresh)
    lengths = np.diff(np.append(first, len(places))) + more
    return list(zip(places[first].tolist(), lengths.tolist(), distance[first].tolist(), strict=True))


def cache_hits(argb: np.ndarray, cache_bits: int) -> np.ndarray:
    """Whether the cache holds each pixel when it comes, all pixels being put into it."""
    slot = (argb * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - cache_bits)
    order = np.argsort(slot, kind="stable")
    hit = np.zeros(len(argb), bool)
    hit[order[1:]] = (slot[order[1:]] == slot[order[:-1]]) & (argb[order[1:]] == argb[order[:-1]])
    # an empty slot holds transparent black
    first = order[np.flatnonzero(np.append(True, slot[order[1:]] != slot[order[:-1]]))]
    hit[first] = argb[first] == 0
    return hit


def _length_symbols(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_prefixed`` of an array."""
    three = np.array([_prefixed(x) for x in values.tolist()], np.int64).reshape(-1, 3)
    return three[:, 0], three[:, 1], three[:, 2]


def write_image(out: BitWriter, argb: np.ndarray, width: int, top: bool, cache_bits: int = 0, copies: bool = False) -> None:
    """Entropy-code pixels with codes fitted to them."""
    out.write(int(cache_bits > 0), 1)
    if cache_bits:
        out.write(cache_bits, 4)
    if top:
        out.write(0, 1)
    n = len(argb)
    ranges = found_copies(argb) if copies else []
    place, is_copy, own = None, np.zeros(n, bool), argb
    if ranges:
        kept = np.ones(n, bool)
        for a, length, _ in ranges:
            kept[a + 1 : a + length] = False
        place = np.flatnonzero(kept)
        own, is_copy = argb[place], np.zeros(len(place), bool)
        is_copy[np.searchsorted(place, np.array([a for a, _, _ in ranges], np.int64))] = True
    green = (own >> np.uint32(8) & np.uint32(255)).astype(np.int64)
    literal = ~is_copy
    if cache_bits:
        hit = cache_hits(argb, cache_bits)
        hit = (hit if place is None else hit[place]) & literal
        literal &= ~hit
        green[hit] = 280 + ((own[hit] * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - cache_bits)).astype(np.int64)
    spots = np.flatnonzero(is_copy)
    distance = np.zeros(0, np.int64)
    if ranges:
        length, length_extra, length_bits = _length_symbols(np.array([x[1] for x in ranges], np.int64))
        distance, distance_extra, distance_bits = _length_symbols(np.array([_distance_code(x[2], width) for x in ranges], np.int64))
        green[spots] = 256 + length
    # values and their numbers of bits, up to six a symbol
    fields = [_coded(out, green, 280 + (1 << cache_bits if cache_bits else 0), None, len(own))]
    literals = own[literal] if ranges or cache_bits else own
    rest = literals & np.uint32(0xFFFF00FF)
    if not len(rest) or (rest == rest[0]).all():
        # images of one channel
        literals = literals[:1]
    for shift in (16, 0, 24):
        fields.append(_coded(out, (literals >> np.uint32(shift) & np.uint32(255)).astype(np.int64), 256, literal, len(own)))
    last = _coded(out, distance, 40, spots, len(own))
    fields = [x for x in fields if x is not None]
    if ranges:
        extras = []
        for values, bits in ((length_extra, length_bits), (distance_extra, distance_bits)):
            value, many = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
            value[spots], many[spots] = values, bits
            extras.append((value, many))
        fields += [extras[0], *([last] if last is not None else []), extras[1]]
    if len(fields) == 1:
        _write_all(out, *fields[0])
    elif fields:
        _write_all(out, np.stack([x[0] for x in fields], axis=1).ravel(), np.stack([x[1] for x in fields], axis=1).ravel())


def _coded(out: BitWriter, symbols: np.ndarray, size: int, where: np.ndarray | None, n: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Write the code fitted to symbols; their codes and lengths, at ``where`` of n places.
    None if the code takes no bits."""
    low = int(symbols[0]) if len(symbols) else 0
    if low < 256 and not (symbols != low).any():
        # a simple code of one symbol of eight bits
        out.write(5 | low << 3, 11)
        return None
    code = write_code(out, limited_lengths(np.bincount(symbols, minlength=size).tolist(), _OWN_LONGEST))
    if code.only is not None:
        return None
    bits, lengths = _code_arrays(code, size)
    if where is None:
        return bits[symbols], lengths[symbols]
    value, many = np.zeros(n, np.int64), np.zeros(n, np.int64)
    value[where], many[where] = bits[symbols], lengths[symbols]
    return value, many


def _code_arrays(code: PrefixCode, size: int) -> tuple[np.ndarray, np.ndarray]:
    bits, lengths = np.zeros(size, np.int64), np.zeros(size, np.int64)
    symbols = list(code.codes)
    both = np.array(list(code.codes.values()), np.int64)
    bits[symbols], lengths[symbols] = both[:, 0], both[:, 1]
    return bits, lengths


#: Four codes and a shift of up to seven bits fit 63 bits.
_OWN_LONGEST = 14


def _write_all(out: BitWriter, value: np.ndarray, n: np.ndarray) -> None:
    """Write all values, each in its number of bits, 28 at most for two together."""
    for first in range(0, len(value), 1 << 18):
        v, k = value[first : first + (1 << 18)].astype(np.uint64), n[first : first + (1 << 18)]
        for _ in range(2):
            if int(k.max()) > 28:
                break
            if len(v) & 1:
                v, k = np.append(v, np.uint64(0)), np.append(k, 0)
            v, k = v[::2] | v[1::2] << k[::2].astype(np.uint64), k[::2] + k[1::2]
        ends = np.cumsum(k)
        at = ends - k
        total = int(ends[-1])
        v = v << (at & 7).astype(np.uint64)
        # the bytes of the words, summed where words share one
        parts = v.view(np.uint8).reshape(-1, 8)
        spread = (at >> 3)[:, None] + np.arange(8)
        data = np.bincount(spread.ravel(), weights=parts.ravel(), minlength=total // 8 + 9).astype(np.uint8)
        out.append(data[: (total + 7) // 8].tobytes(), total)


def _distance_code(distance: int, width: int) -> int:
    """The least code of a distance in pixels."""
    near = _NEAR.get(width)
    if near is None:
        near = _NEAR[width] = {}
        for code in range(120, 0, -1):
            near[_distance(code, width)] = code
        if len(_NEAR) > 64:
            _NEAR.pop(next(iter(_NEAR)))
    return near.get(distance, distance + 120)


_NEAR: dict[int, dict[int, int]] = {}


# transforms -------------------------------------------------------------------


def _channels(argb: np.ndarray) -> np.ndarray:
    """[..., 4] int32 of alpha, red, green, blue."""
    return np.stack([argb >> np.uint32(s) & np.uint32(255) for s in (24, 16, 8, 0)], axis=-1).astype(np.int32)


def _joined(channels: np.ndarray) -> np.ndarray:
    c = (channels & 255).astype(np.uint32)
    return c[..., 0] << np.uint32(24) | c[..., 1] << np.uint32(16) | c[..., 2] << np.uint32(8) | c[..., 3]


def _clamped(x):
    return np.clip(x, 0, 255)


def _half(a, b):
    return (a + b) >> 1


def predicted(mode: int, left, top, top_left, top_right):
    """The prediction of the format's mode from neighbours, [..., 4] arrays."""
    if mode == 0:
        return np.broadcast_to(np.array([255, 0, 0, 0], np.int32), left.shape)
    if mode in (1, 2, 3, 4):
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return _half(_half(left, top_right), top)
    if mode in (6, 7, 8, 9):
        return _half(*((left, top_left), (left, top), (top_left, top), (top, top_right))[mode - 6])
    if mode == 10:
        return _half(_half(left, top_left), _half(top, top_right))
    if mode == 11:
        to_left = np.abs(top - top_left).sum(axis=-1, keepdims=True)
        to_top = np.abs(left - top_left).sum(axis=-1, keepdims=True)
        return np.where(to_left < to_top, left, top)
    if mode == 12:
        return _clamped(left + top - top_left)
    if mode == 13:
        mean = _half(left, top)
        return _clamped(mean + ((mean - top_left) / 2).astype(np.int32))
    raise ValueError("no such predictor")


#: Predictors that look at the row above alone.
_ABOVE = (0, 2, 3, 4, 8, 9)


def _guessed(mode: int, done: np.ndarray, y: int, x0: int, x1: int) -> np.ndarray:
    """Predictions for columns x0 to x1 of row y from finished pixels around them."""
    above, width = done[y - 1], done.shape[1]
    right = above[x0 + 1 : x1 + 1]
    if x1 == width:
        # right of the last column lies the row's own first pixel
        right = np.concatenate([right, done[y, :1]])
    return predicted(mode, done[y, x0 - 1 : x1 - 1], above[x0:x1], above[x0 - 1 : x1 - 1], right)


def _predict(argb: np.ndarray, modes: np.ndarray, shift: int, inverse: bool) -> np.ndarray:
    """Add (inverse) or subtract predictions of a [height, width] image, by stretches of
    a row that share a predictor; where the pixel to the left counts, sums along the row
    or single steps undo it."""
    height, width = argb.shape
    own = _channels(argb)
    done = own if not inverse else own.copy()
    result = own.copy()
    result[0, 0] = own[0, 0] - (255, 0, 0, 0)
    if inverse:
        first = own[0].copy()
        first[0, 0] += 255
        done[0] = np.cumsum(first, axis=0) & 255
    else:
        result[0, 1:] = own[0, 1:] - own[0, :-1]
    for y in range(1, height):
        if inverse:
            done[y, 0] = (own[y, 0] + done[y - 1, 0]) & 255
        else:
            result[y, 0] = own[y, 0] - own[y - 1, 0]
        row = modes[y >> shift]
        edges = [0, *(np.flatnonzero(np.diff(row)) + 1).tolist(), len(row)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            mode, x0, x1 = int(row[a]), max(a << shift, 1), min(b << shift, width)
            if x0 >= x1:
                continue
            if not inverse:
                result[y, x0:x1] = own[y, x0:x1] - _guessed(mode, own, y, x0, x1)
            elif mode in _ABOVE:
                done[y, x0:x1] = (own[y, x0:x1] + _guessed(mode, done, y, x0, x1)) & 255
            elif mode == 1:
                done[y, x0:x1] = (np.cumsum(own[y, x0:x1], axis=0) + done[y, x0 - 1]) & 255
            else:
                for x in range(x0, x1):
                    done[y, x] = (own[y, x] + _guessed(mode, done, y, x, x + 1)[0]) & 255
    return _joined(done if inverse else result)


def _signed(x: np.ndarray) -> np.ndarray:
    return ((x & 255) ^ 128) - 128


def _cross(argb: np.ndarray, elements: np.ndarray, shift: int, inverse: bool) -> np.ndarray:
    """Cross-colour of a [height, width] image; elements are [rows, columns] ARGB."""
    height, width = argb.shape
    own = _channels(argb)
    e = _channels(elements)[np.arange(height)[:, None] >> shift, np.arange(width)[None, :] >> shift]
    red_to_blue, green_to_blue, green_to_red = (_signed(e[..., k]) for k in (1, 2, 3))
    red, green, blue = own[..., 1], own[..., 2], own[..., 3]
    sign = 1 if inverse else -1
    new_red = red + sign * (green_to_red * _signed(green) >> 5)
    used_red = new_red if inverse else red
    new_blue = blue + sign * (green_to_blue * _signed(green) >> 5) + sign * (red_to_blue * _signed(used_red) >> 5)
    return _joined(np.stack([own[..., 0], new_red, green, new_blue], axis=-1))


def _green(argb: np.ndarray, sign: int) -> np.ndarray:
    own = _channels(argb)
    own[..., 1] += sign * own[..., 2]
    own[..., 3] += sign * own[..., 2]
    return _joined(own)


def _bundle_shift(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _blocks(size: int, shift: int) -> int:
    return (size + (1 << shift) - 1) >> shift


# files ------------------------------------------------------------------------


@dataclass(frozen=True)
class Options:
    """How to encode: transforms, colour cache and back-references; none by default."""

    predictor: int | None = None
    cross_colour: tuple[int, int, int] | None = None
    subtract_green: bool = False
    palette: bool = False
    cache_bits: int = 0
    copies: bool = False


def encode(argb: np.ndarray, options: Options = Options()) -> bytes:
    """A WebP file of [height, width] uint32 ARGB pixels."""
    height, width = argb.shape
    if not (0 < width <= LONGEST_SIDE and 0 < height <= LONGEST_SIDE):
        raise ValueError("a side must be from 1 to 16384")
    out = BitWriter()
    out.write(SIGNATURE, 8)
    out.write(width - 1, 14)
    out.write(height - 1, 14)
    out.write(1, 1)
    out.write(0, 3)
    if options.palette:
        colours, index = np.unique(argb, return_inverse=True)
        if len(colours) > 256:
            raise ValueError("a palette holds 256 colours")
        _write_kind(out, PALETTE)
        out.write(len(colours) - 1, 8)
        steps = _joined(np.diff(_channels(colours), axis=0, prepend=0))
        write_image(out, steps, len(colours), False)
        shift = _bundle_shift(len(colours))
        each, bits = 1 << shift, 8 >> shift
        packed = np.zeros((height, _blocks(width, shift) * each), np.uint32)
        packed[:, :width] = index.reshape(height, width)
        packed = packed.reshape(height, -1, each)
        green = sum(packed[:, :, k] << np.uint32(k * bits) for k in range(each))
        argb, width = np.uint32(0xFF000000) | green << np.uint32(8), _blocks(width, shift)
    if options.subtract_green:
        _write_kind(out, SUBTRACT_GREEN)
        argb = _green(argb, -1)
    for kind, given in ((CROSS_COLOUR, options.cross_colour), (PREDICTOR, options.predictor)):
        if given is None:
            continue
        shift = 3
        rows, columns = _blocks(height, shift), _blocks(width, shift)
        _write_kind(out, kind)
        out.write(shift - 2, 3)
        if kind == PREDICTOR:
            modes = np.full((rows, columns), given)
            write_image(out, np.uint32(0xFF000000) | modes.ravel().astype(np.uint32) << np.uint32(8), columns, False)
            argb = _predict(argb, modes, shift, False)
        else:
            element = _joined(np.array([255, given[2], given[1], given[0]]))
            write_image(out, np.full(rows * columns, element, np.uint32), columns, False)
            argb = _cross(argb, np.full((rows, columns), element, np.uint32), shift, False)
    out.write(0, 1)
    write_image(out, argb.ravel(), width, True, options.cache_bits, options.copies)
    return _riff([(b"VP8L", out.bytes())])


def _write_kind(out: BitWriter, kind: int) -> None:
    out.write(1, 1)
    out.write(kind, 2)


def _riff(chunks: list[tuple[bytes, bytes]]) -> bytes:
    body = b"".join(name + len(x).to_bytes(4, "little") + x + b"\0" * (len(x) & 1) for name, x in chunks)
    return b"RIFF" + (len(body) + 4).to_bytes(4, "little") + b"WEBP" + body


def with_chunk(file: bytes, name: bytes, content: bytes) -> bytes:
    """``file`` with a further chunk, which readers that do not know it skip."""
    return _riff([*chunks(file), (name, content)])


def chunks(file: bytes) -> list[tuple[bytes, bytes]]:
    if file[:4] != b"RIFF" or file[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    found, at, end = [], 12, min(len(file), 8 + int.from_bytes(file[4:8], "little"))
    while at + 8 <= end:
        n = int.from_bytes(file[at + 4 : at + 8], "little")
        found.append((file[at : at + 4], file[at + 8 : at + 8 + n]))
        at += 8 + n + (n & 1)
    return found


def decode(file: bytes) -> np.ndarray:
    """The [height, width] uint32 ARGB pixels of a lossless WebP file."""
    try:
        return _decode(file)
    except (IndexError, KeyError, OverflowError, TypeError) as damage:
        raise ValueError("the file is damaged") from damage


def _decode(file: bytes) -> np.ndarray:
    stream = next((x for name, x in chunks(file) if name == b"VP8L"), None)
    if stream is None:
        raise ValueError("no lossless image")
    bits = BitReader(stream)
    if bits.read(8) != SIGNATURE:
        raise ValueError("no lossless signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, full, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform is repeated")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            shift = bits.read(3) + 2
            rows, columns = _blocks(height, shift), _blocks(width, shift)
            undo.append((kind, shift, width, read_image(bits, columns, rows, False).reshape(rows, columns)))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            colours = _joined(np.cumsum(_channels(read_image(bits, n, 1, False)), axis=0))
            shift = _bundle_shift(n)
            undo.append((kind, shift, width, colours))
            width = _blocks(width, shift)
        else:
            undo.append((kind, 0, width, None))
    argb = read_image(bits, width, height, True).reshape(height, width)
    for kind, shift, own_width, given in reversed(undo):
        if kind == PREDICTOR:
            argb = _predict(argb, given >> np.uint32(8) & np.uint32(15), shift, True)
        elif kind == CROSS_COLOUR:
            argb = _cross(argb, given, shift, True)
        elif kind == SUBTRACT_GREEN:
            argb = _green(argb, 1)
        else:
            bits_each = 8 >> shift
            index = argb >> np.uint32(8) & np.uint32(255)
            parts = [index >> np.uint32(k * bits_each) & np.uint32((1 << bits_each) - 1) for k in range(1 << shift)]
            index = np.stack(parts, axis=-1).reshape(height, -1)[:, :own_width]
            table = np.zeros(256, np.uint32)  # colours beyond the palette are transparent black
            table[: len(given)] = given
            argb = table[index]
    if bits.at > 8 * len(stream) or argb.shape != (height, full):
        raise ValueError("the image ends early")
    return argb
