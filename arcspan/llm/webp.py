"""Media columns: lossless WebP (VP8L), stored and read back with numpy.

:func:`decode` is a whole VP8L decoder: prefix codes, back-references, colour cache, several code groups, and the predictor,
cross-colour, subtract-green and palette transforms. Pixels are little-endian 32-bit ARGB. Pictures with one code group are unpacked
without a loop over their symbols (:func:`unpack`); those with several go symbol by symbol. Transforms are undone by row or at once;
only predictors that need the pixel to the left go by pixel.

:func:`store` writes a payload of bytes (a multiple of 64) as pictures 16 pixels wide, four bytes a pixel, of 4,096 rows at most;
a longer payload takes several, one RIFF file after the other. It chooses transforms, back-references, the colour cache and prefix
codes by what makes a picture shortest (:func:`plan`, :func:`write_pixels`). :func:`encode` writes with any given tools.

Defined results of the operator: null and empty texts are 64 zero bytes; equal texts give equal values; repeated rows each get a
result; of transforms with equal cost the first one is taken; an empty table gives an empty table; only the key and the text are
read, so other columns may have any name. One pass, no shuffle; memory is bounded by the batch and the longest text, which is stored
and read back picture by picture, about 60 MB each.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcspan.llm.common import lean, table

#: Pixels in a row of stored texts, and rows of a picture at most; longest code that is written, and longest back-reference.
WIDTH, ROWS, LONGEST, MOST_LENGTH = 16, 4096, 11, 4096
#: Pixels from which a picture is unpacked at once.
AT_ONCE = 24
#: Order in which a header gives the lengths of the codes of code lengths (fixed by the format).
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_MULT = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: Near pixels by distance code: those above or to the left, nearest first.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


class BitWriter:
    def __init__(self) -> None:
        self.value, self.n = 0, 0

    def put(self, value: int, bits: int) -> None:
        self.value |= value << self.n
        self.n += bits

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.n + 7) // 8, "little")


class BitReader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def peek(self, bits: int) -> int:
        byte, shift = self.at >> 3, self.at & 7
        return (int.from_bytes(self.data[byte : byte + (bits + shift + 7) // 8], "little") >> shift) & ((1 << bits) - 1)

    def get(self, bits: int) -> int:
        if self.at + bits > 8 * len(self.data):
            raise ValueError("the stream ends early")
        value = self.peek(bits)
        self.at += bits
        return value


@lru_cache(maxsize=16)
def _turned(bits: int) -> np.ndarray:
    """All numbers of so many bits, with their bits in reverse."""
    out = np.zeros(1, np.int64)
    for _ in range(bits):
        out = np.concatenate([2 * out, 2 * out + 1])
    return out


class Code:
    """A canonical prefix code given by the lengths of its symbols."""

    def __init__(self, lengths: list[int]) -> None:
        self.lengths = lengths
        used = [s for s, n in enumerate(lengths) if n]
        self.only = used[0] if len(used) == 1 else None
        self.longest = max(lengths, default=0)
        self.used = used
        if used and self.only is None and sum(1 << (self.longest - lengths[s]) for s in used) != 1 << self.longest:
            raise ValueError("not a complete prefix code")
        self.table: list[tuple[int, int]] | None = None
        self.arrays = self.bits = None

    @cached_property
    def codes(self) -> dict[int, int]:
        """The bits of each symbol, the first one lowest."""
        turned, out, at = _turned(self.longest), {}, 0
        for s in sorted(self.used, key=lambda s: (self.lengths[s], s)):
            out[s] = int(turned[at])  # of a code with zeros behind it, in reverse
            at += 1 << (self.longest - self.lengths[s])
        return out

    def read(self, r: BitReader) -> int:
        if self.only is not None:
            return self.only
        if self.table is None:
            if not self.used:
                raise ValueError("a code without symbols")
            self.table = [(0, 0)] * (1 << self.longest)
            for s, c in self.codes.items():
                for x in range(c, 1 << self.longest, 1 << self.lengths[s]):
                    self.table[x] = (s, self.lengths[s])
        s, n = self.table[r.peek(self.longest)]
        r.at += n
        if r.at > 8 * len(r.data):
            raise ValueError("the stream ends early")
        return s

    def tables(self) -> tuple[np.ndarray, np.ndarray, int]:
        """By the next bits of a stream: symbol and length; and the mask of those bits. A lone symbol takes none."""
        if self.arrays is None:
            if not self.used:
                raise ValueError("a code without symbols")
            if self.only is not None:
                self.arrays = np.array([self.only]), np.zeros(1, np.int64), 0
            else:
                order = sorted(self.used, key=lambda s: (self.lengths[s], s))
                length = np.array([self.lengths[s] for s in order])
                times = 1 << (self.longest - length)
                turned = _turned(self.longest)
                self.arrays = np.repeat(np.array(order), times)[turned], np.repeat(length, times)[turned], (1 << self.longest) - 1
        return self.arrays

    def written(self) -> tuple[np.ndarray, np.ndarray]:
        """By symbol: bits and their number."""
        if self.bits is None:
            bits, length = np.zeros(len(self.lengths), np.uint64), np.zeros(len(self.lengths), np.int64)
            if self.only is None:
                for s, c in self.codes.items():
                    bits[s], length[s] = c, self.lengths[s]
            self.bits = bits, length
        return self.bits

    def write(self, w: BitWriter, s: int) -> None:
        if self.only is None:
            w.put(self.codes[s], self.lengths[s])
        elif s != self.only:
            raise ValueError("not in the code")


def write_code(w: BitWriter, lengths: list[int]) -> None:
    """The header of a prefix code, run-length coded."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 1 and (not used or used[0] < 256):
        w.put(1, 1)
        w.put(0, 1)
        w.put(1, 1)
        w.put(used[0] if used else 0, 8)
        return
    tokens: list[tuple[int, int, int]] = []  # symbol, extra value, extra bits
    i, before = 0, 8
    end = used[-1] + 1
    while i < end:
        j = i
        while j < end and lengths[j] == lengths[i]:
            j += 1
        n, run = lengths[i], j - i
        i = j
        while run:
            if n == 0 and run >= 11:
                k = min(run, 138)
                tokens.append((18, k - 11, 7))
            elif n == 0 and run >= 3:
                k = min(run, 10)
                tokens.append((17, k - 3, 3))
            elif n and n == before and run >= 3:
                k = min(run, 6)
                tokens.append((16, k - 3, 2))
            else:
                k = 1
                tokens.append((n, 0, 0))
                before = n or before
            run -= k
    counts = [0] * 19
    for s, _, _ in tokens:
        counts[s] += 1
    of = lengths_of(counts, 7)
    if sum(1 for n in of if n) == 1:  # a code of one symbol takes no bits
        of = [1 if n else 0 for n in of]
    w.put(0, 1)
    w.put(19 - 4, 4)
    for s in LENGTH_ORDER:
        w.put(of[s], 3)
    w.put(1, 1)
    if len(tokens) < 2:
        raise ValueError("a code of one length takes the short header")
    half = max(0, -(-((len(tokens) - 2).bit_length() - 2) // 2))
    w.put(half, 3)
    w.put(len(tokens) - 2, 2 + 2 * half)
    code = Code(of)
    for s, extra, n in tokens:
        code.write(w, s)
        w.put(extra, n)


def lengths_of(counts: list[int], most: int = 15) -> list[int]:
    """Code lengths for symbol counts, none over ``most``."""
    used = [s for s, n in enumerate(counts) if n]
    out = [0] * len(counts)
    if len(used) <= 1:
        for s in used:
            out[s] = 1
        return out
    floor, n = 1, len(used)
    order = sorted(used, key=lambda s: counts[s])
    while True:
        # the leaves in order and the inner nodes as they are made are two queues, each sorted
        weight = [max(counts[s], floor) for s in order]
        parent = [0] * (2 * n - 1)
        leaf, inner = 0, n
        for new in range(n, 2 * n - 1):
            total = 0
            for _ in range(2):
                if leaf < n and (inner >= new or weight[leaf] <= weight[inner]):
                    x, leaf = leaf, leaf + 1
                else:
                    x, inner = inner, inner + 1
                total += weight[x]
                parent[x] = new
            weight.append(total)
        depth = [0] * (2 * n - 1)
        for x in range(2 * n - 3, -1, -1):
            depth[x] = depth[parent[x]] + 1
        if max(depth) <= most:
            break
        floor *= 2
    for s, d in zip(order, depth, strict=False):
        out[s] = d
    return out


def read_code(r: BitReader, alphabet: int) -> Code:
    lengths = [0] * alphabet
    if r.get(1):
        two, wide = r.get(1), r.get(1)
        lengths[r.get(8 if wide else 1)] = 1
        if two:
            lengths[r.get(8)] = 1
        return Code(lengths)
    of = [0] * 19
    for s in LENGTH_ORDER[: 4 + r.get(4)]:
        of[s] = r.get(3)
    code = Code(of)
    left = alphabet
    if r.get(1):
        left = 2 + r.get(2 + 2 * r.get(3))
    s, before = 0, 8
    while s < alphabet and left:
        left -= 1
        n = code.read(r)
        if n < 16:
            lengths[s] = n
            before = n or before
            s += 1
            continue
        n, run = (before, 3 + r.get(2)) if n == 16 else (0, 3 + r.get(3)) if n == 17 else (0, 11 + r.get(7))
        if s + run > alphabet:
            raise ValueError("too many code lengths")
        lengths[s : s + run] = [n] * run
        s += run
    return Code(lengths)


def read_group(r: BitReader, cache: int) -> list[Code]:
    """Codes of green (with lengths and cache), red, blue, alpha, distance. Those of :func:`standard` are known by their header."""
    for bits in STANDARD_CACHES:
        if cache == (1 << bits if bits else 0):
            codes, head, size = standard(bits)
            if r.at + size <= 8 * len(r.data) and r.peek(size) == head:
                r.at += size
                return codes
    return [read_code(r, n) for n in (280 + cache, 256, 256, 256, 40)]


def prefixed(value: int) -> tuple[int, int, int]:
    """Prefix symbol, extra value and extra bits of a length or a distance from 1 on."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    top = v.bit_length() - 1
    extra = top - 1
    return 2 * top + ((v >> extra) & 1), v & ((1 << extra) - 1), extra


def read_prefixed(r: BitReader, s: int) -> int:
    if s < 4:
        return s + 1
    extra = (s - 2) >> 1
    return ((2 + (s & 1)) << extra) + r.get(extra) + 1


def distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


@lru_cache(maxsize=64)
def _distances(width: int) -> np.ndarray:
    return np.array([0] + [distance(k + 1, width) for k in range(len(NEAR))])


def _extra(s: np.ndarray) -> np.ndarray:
    """Extra bits after a prefix symbol."""
    return np.where(s < 4, 0, (s - 2) >> 1)


def _whole(s: np.ndarray, extra: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """A length or distance from its prefix symbol and what follows it."""
    return np.where(s < 4, s + 1, ((2 + (s & 1)) << extra) + (bits & ((1 << extra) - 1)) + 1)


def colour_keys(pixels: np.ndarray, cache_bits: int) -> np.ndarray:
    return ((pixels.astype(np.uint64) * np.uint64(CACHE_MULT)) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - cache_bits)


def _before(keys: np.ndarray) -> np.ndarray:
    """The place before each one with the same key, -1 if there is none."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.full(len(keys), -1)
    out[order[1:][same]] = order[:-1][same]
    return out


def _roots(parent: np.ndarray) -> np.ndarray:
    """Follow parents, which come earlier, to places that are their own."""
    while True:
        further = parent[parent]
        if (further == parent).all():
            return parent
        parent = further


_EIGHT, _NONE = np.arange(8), np.zeros(0, np.int64)


def unpack(r: BitReader, codes: list[Code], cache_bits: int, width: int, n: int) -> np.ndarray:
    """The pixels of a picture with one code group.

    What a token would be is looked up for each bit of the stream at once; the tokens are those that follow each other from the
    first bit. Back-references and cache symbols are pointers to earlier pixels, followed together to the literals they come from.
    """
    green, red, blue, alpha, far = codes
    start, shift = r.at >> 3, r.at & 7
    most = sum(c.longest if c.only is None else 0 for c in codes[:4]) + 64
    raw = np.frombuffer(r.data, np.uint8)[start : start + (n * most >> 3) + 16]
    end = 8 * (len(r.data) - start)
    # zeros behind the stream, more than a token has bits, so that no place leaves the arrays
    wide = np.concatenate([raw, np.zeros(24, np.uint8)]).astype(np.int64)
    word = wide[:-3] | wide[1:-2] << 8 | wide[2:-1] << 16 | wide[3:] << 24
    peek = (word[:, None] >> _EIGHT).reshape(-1)
    size = 8 * len(raw)
    symbol, length, mask = green.tables()
    seen = peek[:size] & mask
    p = np.arange(size) + length[seen]
    after = p
    lengths: dict[int, np.ndarray] = {}
    for c in (red, blue, alpha):
        if c.only is None:
            if id(c) not in lengths:
                _, own, own_mask = c.tables()
                lengths[id(c)] = own[peek & own_mask]
            after = after + lengths[id(c)][after]
    at = np.flatnonzero((symbol > 255)[seen]) if symbol.max() > 255 else _NONE
    if len(at):
        after = after.copy() if after is p else after
        after[at] = p[at]
        s = symbol[seen[at]]
        at, s = at[s < 280], s[s < 280]
        if len(at) and far.used:
            f_symbol, f_length, f_mask = far.tables()
            q = p[at] + _extra(s - 256)
            d = peek[q] & f_mask
            after[at] = q + f_length[d] + _extra(f_symbol[d])
    found, place, step, stop = [], shift, memoryview(after), min(size, end)
    for _ in range(n):
        found.append(place)
        place = step[place]
        if place >= stop:
            break
    t = np.array(found)
    s, p = symbol[seen[t]], p[t]
    count, back = np.ones(len(t), np.int64), np.zeros(len(t), np.int64)
    copies = np.flatnonzero((s > 255) & (s < 280))
    if len(copies):
        f_symbol, f_length, f_mask = far.tables()
        k = s[copies] - 256
        count[copies] = _whole(k, _extra(k), peek[p[copies]])
        q = p[copies] + _extra(k)
        d = f_symbol[peek[q] & f_mask]
        told = _whole(d, _extra(d), peek[q + f_length[peek[q] & f_mask]])
        near = _distances(width)
        back[copies] = np.where(told < len(near), near[np.minimum(told, len(near) - 1)], told - len(NEAR))
    ends = np.cumsum(count)
    last = int(np.searchsorted(ends, n))
    if last == len(t) or after[t[last]] > end:
        raise ValueError("the stream ends early")
    if ends[last] > n:
        raise ValueError("a back-reference leaves the picture")
    r.at += int(after[t[last]]) - shift
    t, s, p, count, back, ends = (x[: last + 1] for x in (t, s, p, count, back, ends))
    value = s.astype(np.uint32) << np.uint32(8)
    q = p
    for c, to in ((red, 16), (blue, 0), (alpha, 24)):
        c_symbol, c_length, c_mask = c.tables()
        d = peek[q] & c_mask
        value |= c_symbol[d].astype(np.uint32) << np.uint32(to)
        q = q + c_length[d]
    if not (s > 255).any():
        return value
    begin = ends - count
    out, parent = np.zeros(n, np.uint32), np.arange(n)
    plain = s < 256
    out[begin[plain]] = value[plain]
    copies = np.flatnonzero((s > 255) & (s < 280))
    if (back[copies] > begin[copies]).any():
        raise ValueError("a back-reference leaves the picture")
    m = count[copies]
    inner = np.repeat(begin[copies] - (np.cumsum(m) - m), m) + np.arange(m.sum())
    parent[inner] = inner - np.repeat(back[copies], m)
    cached = np.flatnonzero(s >= 280)
    if len(cached):
        root = _roots(parent)
        keys = colour_keys(out, cache_bits)
        keys[begin[cached]] = (s[cached] - 280).astype(np.uint64)
        earlier = _before(keys[root])[begin[cached]]
        has = earlier >= 0  # an entry that nothing has filled is 0
        parent[begin[cached[has]]] = earlier[has]
    return out[_roots(parent)]


def read_pixels(r: BitReader, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded picture."""
    cache_bits = r.get(4) if r.get(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    cache = 1 << cache_bits if cache_bits else 0
    groups_of, bits, n_groups = None, 0, 1
    if main and r.get(1):
        bits = r.get(3) + 2
        w = (width + (1 << bits) - 1) >> bits
        h = (height + (1 << bits) - 1) >> bits
        groups_of = ((read_pixels(r, w, h, False) >> np.uint32(8)) & 0xFFFF).reshape(h, w).tolist()
        n_groups = 1 + max(map(max, groups_of))
    groups = [read_group(r, cache) for _ in range(n_groups)]
    n = width * height
    if groups_of is None and n >= AT_ONCE and all(c.used for c in groups[0][:4]):
        return unpack(r, groups[0], cache_bits, width, n)
    colours = [0] * cache
    shift = 32 - cache_bits
    pixels: list[int] = []
    group = groups[0]
    while len(pixels) < n:
        if groups_of is not None:
            y, x = divmod(len(pixels), width)
            group = groups[groups_of[y >> bits][x >> bits]]
        s = group[0].read(r)
        if s < 256:
            red, blue, alpha = group[1].read(r), group[2].read(r), group[3].read(r)
            new = [alpha << 24 | red << 16 | s << 8 | blue]
        elif s < 280:
            length = read_prefixed(r, s - 256)
            back = distance(read_prefixed(r, group[4].read(r)), width)
            if back > len(pixels) or len(pixels) + length > n:
                raise ValueError("a back-reference leaves the picture")
            at = len(pixels) - back
            new = pixels[at : at + length]
            while len(new) < length:
                new = (new + new)[:length]
        else:
            new = [colours[s - 280]]
        pixels += new
        if cache:
            for p in new:
                colours[(CACHE_MULT * p & 0xFFFFFFFF) >> shift] = p
    return np.array(pixels, np.uint32)


def _channels(p: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(p, "<u4").view(np.uint8).reshape(*p.shape, 4).astype(np.int32)


def _pixels(c: np.ndarray) -> np.ndarray:
    return (c & 255).astype(np.uint8).view("<u4").reshape(c.shape[:-1])


def _predict(mode: int, left: np.ndarray, top: np.ndarray, right: np.ndarray, corner: np.ndarray) -> np.ndarray:
    if mode == 1:
        return left
    if mode in (2, 3, 4):
        return (top, right, corner)[mode - 2]
    if mode == 5:
        return ((left + right >> 1) + top) >> 1
    if mode in (6, 7):
        return left + (corner, top)[mode - 6] >> 1
    if mode == 8:
        return corner + top >> 1
    if mode == 9:
        return top + right >> 1
    if mode == 10:
        return (left + corner >> 1) + (top + right >> 1) >> 1
    if mode == 11:
        to_left, to_top = np.abs(top - corner).sum(-1, keepdims=True), np.abs(left - corner).sum(-1, keepdims=True)
        return np.where(to_left < to_top, left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        mean = left + top >> 1
        half = mean - corner
        return np.clip(mean + np.sign(half) * (np.abs(half) >> 1), 0, 255)
    return _BLACK


#: Modes whose prediction doesn't need pixels of the same row.
ABOVE = (0, 2, 3, 4, 8, 9)
_BLACK = np.array([0, 0, 0, 255])


def undo_predictor(p: np.ndarray, bits: int, modes: np.ndarray) -> np.ndarray:
    """Row by row; within a row, stretches of one mode at once where the mode looks above or is the running sum, else by pixel."""
    c, m = _channels(p), (modes >> np.uint32(8)) & 15
    h, w = p.shape
    c[0, 0] += _BLACK
    c[0] = np.cumsum(c[0], axis=0) & 255
    for y in range(1, h):
        row, top = c[y], c[y - 1]
        row[0] = (row[0] + top[0]) & 255
        kinds = m[y >> bits]
        x = 1
        while x < w:
            mode, end = int(kinds[x >> bits]), ((x >> bits) + 1) << bits
            while end < w and kinds[end >> bits] == mode:
                end += 1 << bits
            end = min(end, w)
            if mode in ABOVE or mode > 13:
                right = top[x + 1 : end + 1] if end < w else np.concatenate([top[x + 1 :], c[y, :1]])
                row[x:end] = (row[x:end] + _predict(mode, top, top[x:end], right, top[x - 1 : end - 1])) & 255
            elif mode == 1:
                row[x:end] = (row[x - 1] + np.cumsum(row[x:end], axis=0)) & 255
            else:
                for i in range(x, end):
                    right = top[i + 1] if i + 1 < w else row[0]
                    row[i] = (row[i] + _predict(mode, row[i - 1], top[i], right, top[i - 1])) & 255
            x = end
    return _pixels(c)


def do_predictor(p: np.ndarray, bits: int, modes: np.ndarray) -> np.ndarray:
    c, m = _channels(p), (modes >> np.uint32(8)) & 15
    h, w = p.shape
    out = c.copy()
    out[0, 0] -= _BLACK
    out[0, 1:] -= c[0, :-1]
    out[1:, 0] -= c[:-1, 0]
    kinds = np.repeat(np.repeat(m, 1 << bits, 0), 1 << bits, 1)[1:h, 1:w]
    left, top, corner = c[1:, :-1], c[:-1, 1:], c[:-1, :-1]
    right = np.concatenate([c[:-1, 2:], c[1:, :1]], axis=1) if w > 1 else top
    for mode in np.unique(kinds).tolist():
        at = kinds == mode
        out[1:, 1:][at] -= _predict(mode, left[at], top[at], right[at], corner[at])
    return _pixels(out)


def cross_colour(p: np.ndarray, bits: int, elements: np.ndarray, sign: int) -> np.ndarray:
    """Undo (sign 1) or do (sign -1) the cross-colour transform."""
    c = _channels(p)
    h, w = p.shape
    e = np.repeat(np.repeat(_channels(elements).astype(np.int8).astype(np.int32), 1 << bits, 0), 1 << bits, 1)[:h, :w]
    signed = lambda x: (x & 255).astype(np.uint8).view(np.int8).astype(np.int32)
    green, red = signed(c[..., 1]), c[..., 2]
    new = red + sign * (e[..., 0] * green >> 5)
    blue = c[..., 0] + sign * ((e[..., 1] * green >> 5) + (e[..., 2] * signed(new if sign > 0 else red) >> 5))
    c[..., 2], c[..., 0] = new, blue
    return _pixels(c)


def green(p: np.ndarray, sign: int) -> np.ndarray:
    """Add green to red and blue, or subtract it."""
    c = _channels(p)
    c[..., 0] += sign * c[..., 1]
    c[..., 2] += sign * c[..., 1]
    return _pixels(c)


def packing(colours: int) -> int:
    """log2 of the pixels in a byte."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def undo_palette(p: np.ndarray, width: int, palette: np.ndarray) -> np.ndarray:
    index, pack = (p >> np.uint32(8)) & 255, packing(len(palette))
    if pack:
        bits = 8 >> pack
        index = np.stack([(index >> np.uint32(i * bits)) & ((1 << bits) - 1) for i in range(1 << pack)], -1).reshape(len(p), -1)[:, :width]
    whole = np.zeros(256, np.uint32)
    whole[: len(palette)] = palette
    return whole[index]


def decode(data: bytes) -> np.ndarray:
    """A lossless WebP file to its ARGB pixels, by row."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise ValueError("not a lossless WebP file")
    r = BitReader(data[21 : 20 + int.from_bytes(data[16:20], "little")])
    width, height = r.get(14) + 1, r.get(14) + 1
    r.get(1)
    if r.get(3):
        raise ValueError("unknown version")
    steps, w = [], width
    while r.get(1):
        kind = r.get(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = r.get(3) + 2
            sw, sh = (w + (1 << bits) - 1) >> bits, (height + (1 << bits) - 1) >> bits
            steps.append((kind, bits, read_pixels(r, sw, sh, False).reshape(sh, sw)))
        elif kind == SUBTRACT_GREEN:
            steps.append((kind, 0, None))
        else:
            n = r.get(8) + 1
            palette = _pixels(np.cumsum(_channels(read_pixels(r, n, 1, False)), axis=0))
            steps.append((kind, w, palette))
            w = (w + (1 << packing(n)) - 1) >> packing(n)
    p = read_pixels(r, w, height, True).reshape(height, w)
    for kind, arg, more in reversed(steps):
        if kind == PREDICTOR:
            p = undo_predictor(p, arg, more)
        elif kind == CROSS_COLOUR:
            p = cross_colour(p, arg, more, 1)
        elif kind == SUBTRACT_GREEN:
            p = green(p, 1)
        else:
            p = undo_palette(p, arg, more)
    return p


def riff(stream: bytes) -> bytes:
    body = b"\x2f" + stream
    pad = b"\0" * (len(body) & 1)
    return b"RIFF" + (12 + len(body) + len(pad)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body + pad


def matches(pixels: np.ndarray) -> list[tuple[int, int, int]]:
    """Greedy back-references: place, distance, length. A run of three pixels is looked up where it stood last."""
    n = len(pixels)
    if n < 4:
        return []
    x = pixels.astype(np.uint64)
    keys = (x[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (x[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (x[2:] * np.uint64(0x165667B19E3779F9))
    before = _before(keys)
    out, done = [], 0
    at = np.flatnonzero(before >= 0)
    for i, j in zip(at.tolist(), before[at].tolist(), strict=True):
        if i < done:
            continue
        length, step = 0, 16
        while length < MOST_LENGTH and i + length < n:
            m = min(step, MOST_LENGTH - length, n - i - length)
            differ = np.flatnonzero(pixels[i + length : i + length + m] != pixels[j + length : j + length + m])
            if len(differ):
                length += int(differ[0])
                break
            length, step = length + m, 4 * step
        if length >= 3:
            out.append((i, i - j, length))
            done = i + length
    return out


def cache_pays(pixels: np.ndarray) -> bool:
    """Whether a standard cache has one pixel in twenty; with less its symbols cost more than they save."""
    keys = colour_keys(pixels, STANDARD_CACHES[-1])
    before = _before(keys)
    return 20 * np.count_nonzero((before >= 0) & (pixels[before] == pixels)) > len(pixels)


class Tokens:
    """A picture as literals, back-references and cache symbols."""

    def __init__(self, pixels: np.ndarray, width: int, cache_bits: int, found: list[tuple[int, int, int]]) -> None:
        n = len(pixels)
        inside, starts = np.zeros(n, bool), np.zeros(n, bool)
        for i, _, length in found:
            inside[i : i + length] = True
            starts[i] = True
        cached = np.zeros(n, bool)
        if cache_bits:
            keys = colour_keys(pixels, cache_bits)
            before = _before(keys)
            cached = (before >= 0) & (pixels[before] == pixels) & ~inside
        places = np.flatnonzero(~inside | starts)
        self.count = len(places)
        #: Places among the tokens.
        self.copies, self.cached = np.flatnonzero(starts[places]), np.flatnonzero(cached[places])
        self.plain = np.flatnonzero(~starts[places] & ~cached[places])
        self.literals = np.ascontiguousarray(pixels[places[self.plain]], "<u4").view(np.uint8).reshape(-1, 4).astype(np.int64)
        self.keys = keys[places[self.cached]].astype(np.int64) if cache_bits else np.zeros(0, np.int64)
        near = {d: k for k, d in reversed([*enumerate(_distances(width).tolist())][1:])}
        self.lengths = np.array([prefixed(length) for _, _, length in found], np.int64).reshape(-1, 3)
        self.far = np.array([prefixed(near.get(d, d + len(NEAR))) for _, d, _ in found], np.int64).reshape(-1, 3)
        self.cache = 1 << cache_bits if cache_bits else 0

    def counts(self) -> list[np.ndarray]:
        """How often the five codes have their symbols."""
        first = np.concatenate([self.literals[:, 1], 256 + self.lengths[:, 0], 280 + self.keys])
        of = lambda x, n: np.bincount(x, minlength=n)
        return [of(first, 280 + self.cache), of(self.literals[:, 2], 256), of(self.literals[:, 0], 256), of(self.literals[:, 3], 256), of(self.far[:, 0], 40)]

    def fields(self, codes: list[Code]) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each token, and their number."""
        value, size = np.zeros(self.count, np.uint64), np.zeros(self.count, np.int64)

        def put(at: np.ndarray, bits: np.ndarray, n: np.ndarray) -> None:
            value[at] |= bits.astype(np.uint64) << size[at].astype(np.uint64)
            size[at] += n

        def symbol(at: np.ndarray, code: Code, s: np.ndarray) -> None:
            bits, n = code.written()
            put(at, bits[s], n[s])

        for code, channel in zip(codes, (1, 2, 0, 3), strict=False):
            symbol(self.plain, code, self.literals[:, channel])
        symbol(self.cached, codes[0], 280 + self.keys)
        symbol(self.copies, codes[0], 256 + self.lengths[:, 0])
        put(self.copies, self.lengths[:, 1], self.lengths[:, 2])
        symbol(self.copies, codes[4], self.far[:, 0])
        put(self.copies, self.far[:, 1], self.far[:, 2])
        return value, size


def _bits(value: np.ndarray, size: np.ndarray) -> tuple[int, int]:
    """Fields one after the other, as one number, and its bits."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    inner = np.arange(total) - np.repeat(ends - size, size)
    bits = (np.repeat(value, size) >> inner.astype(np.uint64)).astype(np.uint8) & 1
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little"), total


def _entropy(counts: np.ndarray) -> float:
    c = counts[counts > 0]
    return float(c.sum() * np.log2(c.sum()) - (c * np.log2(c)).sum()) if len(c) > 1 else 0.0


def _of_header(counts: list[np.ndarray]) -> float:
    """Bits that the headers of own codes take, about."""
    return sum(60 + 4.5 * np.count_nonzero(c) if np.count_nonzero(c) > 1 else 12 for c in counts)


def write_pixels(w: BitWriter, pixels: np.ndarray, width: int, main: bool, cache_bits: int | None = 0, references: bool = False) -> None:
    """An entropy-coded picture with one code group, a standard one unless its own saves :data:`LEAST_SAVED` bits: codes of its own
    take longer to write and read than all else of a short text.

    With ``cache_bits`` None, a standard cache is taken if it pays.
    """
    found = matches(pixels) if references else []
    bits = cache_bits if cache_bits is not None else STANDARD_CACHES[int(cache_pays(pixels))]
    t = Tokens(pixels, width, bits, found)
    counts, codes = t.counts(), None
    if bits in STANDARD_CACHES and main:
        codes, _, size = standard(bits)
        size += sum(int(c @ code.written()[1]) for c, code in zip(counts, codes, strict=True))
        # a small picture can't save so much
        if size > 3 * LEAST_SAVED and sum(map(_entropy, counts)) + _of_header(counts) + LEAST_SAVED < size:
            codes = None
    w.put(1 if bits else 0, 1)
    if bits:
        w.put(bits, 4)
    if main:
        w.put(0, 1)
    if codes is not None:
        w.put(standard(bits)[1], standard(bits)[2])
    else:
        codes = []
        if np.count_nonzero(counts[0]) == 1 and not counts[0][0]:
            counts[0][0] = 1  # a lone symbol over 255 has no short header
        for c in counts:
            lengths = lengths_of(c.tolist(), LONGEST)
            write_code(w, lengths)
            codes.append(Code(lengths if any(lengths) else [1] + lengths[1:]))
    extra, values = sum(c.longest for c in codes), t.fields(codes)
    if extra > 64 and (values[1] > 64).any():
        raise AssertionError("a token has over 64 bits")
    w.put(*_bits(*values))


LEAST_SAVED = 8192
#: Characters of usual text, frequent first, for the standard codes.
USUAL = b" etaoinsrhldcumpgfybwvk.,\n-'\"0123456789xjqz:;()/"
STANDARD_CACHES = (0, 6)


@lru_cache(maxsize=4)
def standard(cache_bits: int) -> tuple[list[Code], int, int]:
    """Codes for text of four characters a pixel, so that short texts need none of their own; their header and its bits."""
    literals = [8] * 33 + [16] * 95 + [8] * 64 + [2] * 64
    for rank, c in enumerate(USUAL):
        literals[c] = int(4000 * 0.88**rank) + 16
    literals[0xC3] = 100  # before most letters with accents
    first = literals + [60] * 24 + [(30 if cache_bits else 0)] * (1 << cache_bits if cache_bits else 0)
    red = Code(lengths_of(literals, LONGEST))
    codes = [Code(lengths_of(first, LONGEST)), red, red, red, Code(lengths_of([1] * 40, LONGEST))]
    w = BitWriter()
    for c in codes:
        write_code(w, c.lengths)
    return codes, w.value, w.n


def encode(p: np.ndarray, steps: tuple = (), cache_bits: int | None = 0, references: bool = False) -> bytes:
    """A picture with the given transforms, in order: (PREDICTOR or CROSS_COLOUR, bits, elements), (SUBTRACT_GREEN,), (PALETTE,)."""
    w = BitWriter()
    height, width = p.shape
    for x in (width - 1, height - 1):
        w.put(x, 14)
    w.put(1, 1)
    w.put(0, 3)
    for kind, *args in steps:
        w.put(1, 1)
        w.put(kind, 2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits, elements = args
            w.put(bits - 2, 3)
            write_pixels(w, elements.ravel(), elements.shape[1], False)
            p = do_predictor(p, bits, elements) if kind == PREDICTOR else cross_colour(p, bits, elements, -1)
        elif kind == SUBTRACT_GREEN:
            p = green(p, -1)
        else:
            palette, index = np.unique(p, return_inverse=True)
            if len(palette) > 256:
                raise ValueError("too many colours for a palette")
            w.put(len(palette) - 1, 8)
            c = _channels(palette)
            write_pixels(w, _pixels(np.diff(c, axis=0, prepend=0)), len(palette), False)
            index, pack = index.reshape(p.shape).astype(np.uint32), packing(len(palette))
            if pack:
                n, bits = 1 << pack, 8 >> pack
                index = np.pad(index, ((0, 0), (0, -index.shape[1] % n))).reshape(height, -1, n)
                index = sum(index[..., i] << np.uint32(i * bits) for i in range(n))
            p = (index << np.uint32(8)) | np.uint32(0xFF000000)
    w.put(0, 1)
    write_pixels(w, p.ravel(), p.shape[1], True, cache_bits, references)
    return riff(w.bytes())


def _cost(p: np.ndarray) -> float:
    """Bits of a picture without back-references, about, in standard codes or its own."""
    c = np.ascontiguousarray(p, "<u4").view(np.uint8).reshape(-1, 4)
    counts = [np.bincount(c[:, k], minlength=256) for k in range(4)]
    return min(float(sum(counts) @ standard(0)[0][1].written()[1]), sum(map(_entropy, counts)) + _of_header(counts))


#: Tiles of 4 x 4 pixels.
TILE = 2


def _tile_modes(p: np.ndarray) -> tuple[np.ndarray, float]:
    """The predictor that finds most bytes in each tile, of those that look one pixel away; the share of bytes found."""
    c = _channels(p)
    h, w = p.shape
    sh, sw = (h + 3) >> TILE, (w + 3) >> TILE
    hits = np.zeros((4, sh << TILE, sw << TILE), np.int32)
    hits[0, :, 1:w][:h] = (c[:, 1:] == c[:, :-1]).sum(-1)
    hits[1, 1:h, :w] = (c[1:] == c[:-1]).sum(-1)
    hits[2, 1:h, : w - 1] = (c[1:, :-1] == c[:-1, 1:]).sum(-1)
    hits[3, 1:h, 1:w] = (c[1:, 1:] == c[:-1, :-1]).sum(-1)
    tiles = hits.reshape(4, sh, 1 << TILE, sw, 1 << TILE).sum((2, 4))
    best = tiles.argmax(0)
    return (best + 1).astype(np.uint32) << np.uint32(8) | np.uint32(0xFF000000), float(tiles.max(0).sum() / c.size)


def plan(p: np.ndarray) -> tuple:
    """The transforms that make a picture shortest: none, a palette, predictors by tile, cross-colour or subtract-green.

    Those that find little of what they look for are not tried.
    """
    b = np.ascontiguousarray(p, "<u4").view(np.uint8).reshape(-1)
    ways: list[tuple[float, tuple]] = []
    ordered = np.sort(p, axis=None)
    new = np.flatnonzero(ordered[1:] != ordered[:-1]) + 1
    if len(new) < 256 and p.size >= 2 * (len(new) + 1):
        counts = np.diff(new, prepend=0, append=p.size)
        ways.append((150 + 30 * len(counts) + _entropy(counts), ((PALETTE,),)))
    row = 4 * p.shape[1]
    # bytes found by each predictor, whatever tile they are in
    if sum(np.count_nonzero(b[k:] == b[:-k]) for k in (4, row - 4, row, row + 4) if k < len(b)) > (LEAST_SHARE + 0.15) * len(b):
        modes, share = _tile_modes(p)
        if share > LEAST_SHARE:
            ways.append((150 + 2 * modes.size + _cost(do_predictor(p, TILE, modes)), ((PREDICTOR, TILE, modes),)))
    c = b.reshape(-1, 4)
    same = [np.count_nonzero(c[:, x] == c[:, y]) / len(c) for x, y in ((1, 2), (1, 0), (2, 0))]
    if max(same) > LEAST_SHARE:
        ways.append((1 + _cost(green(p, -1)), ((SUBTRACT_GREEN,),)))
        from_green, from_red = 32 * (same[1] >= same[2]), 32 * (same[1] < same[2])
        element = 0xFF000000 | from_red << 16 | from_green << 8 | 32 * (same[0] > LEAST_SHARE)
        elements = np.full(((p.shape[0] + 7) >> 3, (p.shape[1] + 7) >> 3), element, np.uint32)
        ways.append((100 + _cost(cross_colour(p, 3, elements, -1)), ((CROSS_COLOUR, 3, elements),)))
    return min([(_cost(p), ()), *ways], key=lambda x: x[0])[1] if ways else ()


#: Share of bytes that a transform must find before its cost is worked out.
LEAST_SHARE = 0.2


def store(payload: bytes) -> bytes:
    """A payload, in multiples of 64 bytes, as lossless pictures."""
    out = []
    most = WIDTH * 4 * ROWS
    for at in range(0, len(payload), most):
        p = np.frombuffer(payload, "<u4", min(most, len(payload) - at) // 4, at).reshape(-1, WIDTH)
        out.append(encode(p, plan(p), None, True))
    return b"".join(out)


def load(media: bytes) -> list[np.ndarray]:
    """The pictures of :func:`store`."""
    out, at = [], 0
    while at < len(media):
        n = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        out.append(decode(media[at : at + n]))
        at += n
    return out


def features(pictures: list[np.ndarray]) -> str:
    """Size, then for blue, green, red, alpha: sum and greatest value."""
    sums, most, rows = np.zeros(4, np.int64), np.zeros(4, np.uint8), 0
    for p in pictures:
        c = np.ascontiguousarray(p, "<u4").view(np.uint8).reshape(-1, 4)
        sums, most, rows = sums + c.sum(axis=0, dtype=np.int64), np.maximum(most, c.max(axis=0)), rows + len(p)
    return f"{WIDTH}x{rows}:" + ",".join(f"{s}/{m}" for s, m in zip(sums.tolist(), most.tolist(), strict=True))


def padded(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % 64 or 64 * (not text))


SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Key columns, then a text: what is read back of its stored form."""
    for batch in batches:
        column = batch.column(batch.num_columns - 1).cast(pa.large_binary())
        rows = []
        for x in column:
            text = x.as_py() or b""
            media = store(padded(text))
            pictures = load(media)
            back = b"".join(p.astype("<u4", copy=False).tobytes() for p in pictures)
            rows.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(pictures)))
        cols = list(zip(*rows, strict=True)) or [()] * 7
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        arrays = [*batch.columns[:-1], *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]]
        yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:-1], *[x.split()[0] for x in SCHEMA.split(", ")]])


def media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Key columns, then a text: its stored form in the text's place."""
    for batch in batches:
        stored = [store(padded(x.as_py() or b"")) for x in batch.column(batch.num_columns - 1).cast(pa.large_binary())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(stored, pa.binary())], names=[*batch.schema.names[:-1], "media"])


def to_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A media column (WebP files) of each text."""
    read = docs.select(key, text)
    return read.mapInArrow(lean(media), f"`{key}` {read.schema[0].dataType.simpleString()}, media binary")


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store each text, read it back, and give sizes, digests and features."""
    read = docs.select(F.col(key), F.col(text))
    return read.mapInArrow(lean(measure), f"`{key}` {read.schema[0].dataType.simpleString()}, {SCHEMA}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
