"""Cell keys and space-filling curves as Column expressions, and range algebra on the driver."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The masks that spread the bits of a coordinate over 2 or 3 lanes.
_SPREAD2 = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))
_SPREAD3 = ((32, 0x001F00000000FFFF), (16, 0x001F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))
BITS2, BITS3 = 31, 21


def _c(v) -> Column:
    return (F.col(v) if isinstance(v, str) else v if isinstance(v, Column) else F.lit(v)).cast("long")


def _spread(v: Column, steps, mask: int) -> Column:
    return reduce(lambda x, s: x.bitwiseOR(F.shiftleft(x, s[0])).bitwiseAND(F.lit(s[1])), steps, v.bitwiseAND(F.lit(mask)))


def _gather(v: Column, steps, mask: int) -> Column:
    v = v.bitwiseAND(F.lit(steps[-1][1]))
    masks = [m for _, m in steps[:-1]][::-1] + [mask]
    for (shift, _), m in zip(steps[::-1], masks):
        v = v.bitwiseXOR(F.shiftrightunsigned(v, shift)).bitwiseAND(F.lit(m))
    return v


def morton2(x, y) -> Column:
    """x in the even bits, y in the odd ones; up to 31 bits an axis."""
    return _spread(_c(x), _SPREAD2, (1 << BITS2) - 1).bitwiseOR(F.shiftleft(_spread(_c(y), _SPREAD2, (1 << BITS2) - 1), 1))


def demorton2(k) -> tuple[Column, Column]:
    k = _c(k)
    return _gather(k, _SPREAD2, (1 << 32) - 1), _gather(F.shiftrightunsigned(k, 1), _SPREAD2, (1 << 32) - 1)


def morton3(x, y, z) -> Column:
    """Bits of x, y and z interleaved, x lowest; up to 21 bits an axis."""
    parts = [F.shiftleft(_spread(_c(v), _SPREAD3, (1 << BITS3) - 1), i) for i, v in enumerate((x, y, z))]
    return parts[0].bitwiseOR(parts[1]).bitwiseOR(parts[2])


def demorton3(k) -> tuple[Column, Column, Column]:
    k = _c(k)
    return tuple(_gather(F.shiftrightunsigned(k, i), _SPREAD3, (1 << BITS3) - 1) for i in range(3))


def morton(coords: list) -> Column:
    return morton2(*coords) if len(coords) == 2 else morton3(*coords)


def cell_index(v, lo: float, cell: float, n: int) -> Column:
    """Index of a coordinate's cell, clamped to [0, n); a cell of no size is cell 0."""
    v = F.col(v) if isinstance(v, str) else v
    if cell <= 0:
        return F.lit(0).cast("long")
    return F.least(F.greatest(F.floor((v - lo) / cell), F.lit(0).cast("long")), F.lit(n - 1).cast("long"))


def coarser(key, steps: int, dims: int) -> Column:
    """Key of the cell that holds this one, `steps` levels up."""
    return F.shiftright(_c(key), steps * dims)


def prefix_range(prefix: int, digits: int, bits: int, dims: int) -> tuple[int, int]:
    """Inclusive key range below a prefix of `digits` levels."""
    if digits > bits:
        raise ValueError("a prefix has at most as many digits as the key")
    shift = (bits - digits) * dims
    return prefix << shift, ((prefix + 1) << shift) - 1


def location_level(code, dims: int) -> Column:
    """Level of a location code, whose leading one marks its depth."""
    return F.floor((F.length(F.bin(_c(code))) - 1) / dims).cast("int")


def child_octant(x, y, z, cx, cy, cz) -> Column:
    """Octant of a point about a centre: bit 0 for x, 1 for y, 2 for z."""
    bit = lambda v, c, b: F.when(v >= c, b).otherwise(0)
    return bit(x, cx, 1) + bit(y, cy, 2) + bit(z, cz, 4)


def hilbert3(x, y, z, bits: int) -> Column:
    """Hilbert index in three dimensions, by the transpose algorithm; a fold over the bits keeps the expression small."""
    def xor(a: Column, b: Column) -> Column:
        return a.bitwiseXOR(b)

    def exchange(v: list[Column], i: int, q: Column) -> list[Column]:
        p, high = q - 1, v[i].bitwiseAND(q) != 0
        swap = xor(v[0], v[i]).bitwiseAND(p)
        out = list(v)
        if i:
            out[i] = F.when(high, v[i]).otherwise(xor(v[i], swap))
        out[0] = F.when(high, xor(v[0], p)).otherwise(xor(v[0], swap))
        return out

    def state(v: list[Column]) -> Column:
        return F.struct(*(c.alias(n) for c, n in zip(v, "abc")))

    # One exchange a fold step: (bit, axis) pairs from the highest bit down.
    steps = F.array(*(F.struct(F.lit(1 << b).cast("long").alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(3)))

    def step(acc: Column, s: Column) -> Column:
        v = [acc.a, acc.b, acc.c]
        return F.when(s.i == 0, state(exchange(v, 0, s.q))).when(s.i == 1, state(exchange(v, 1, s.q))).otherwise(state(exchange(v, 2, s.q)))

    def finish(acc: Column) -> Column:
        b = xor(acc.b, acc.a)
        c = xor(acc.c, b)
        masks = F.array(*(F.lit(1 << k).cast("long") for k in range(bits - 1, 0, -1)))
        t = F.aggregate(masks, F.lit(0).cast("long"), lambda t, q: F.when(c.bitwiseAND(q) != 0, xor(t, q - 1)).otherwise(t))
        return F.struct(*(xor(v, t).alias(n) for v, n in zip((acc.a, b, c), "abc")))

    return F.transform(F.array(F.aggregate(steps, state([_c(x), _c(y), _c(z)]), step, finish)), lambda v: morton3(v.c, v.b, v.a))[0]


def encode(p: tuple[int, ...]) -> int:
    """Morton key of integer coordinates, on the driver."""
    return sum(((c >> b) & 1) << (b * len(p) + i) for i, c in enumerate(p) for b in range(c.bit_length()))


def box_ranges(lo: tuple[int, ...], hi: tuple[int, ...], bits: int, most: int | None = None) -> list[tuple[int, int]]:
    """Maximal Morton key ranges (inclusive) that cover an inclusive box of cells.

    With `most`, nearest ranges are merged until so many are left: a superset.
    """
    dims = len(lo)
    out: list[tuple[int, int]] = []

    def visit(corner: tuple[int, ...], level: int, key: int) -> None:
        size = 1 << level
        if any(c > h or c + size - 1 < a for c, a, h in zip(corner, lo, hi)):
            return
        if all(a <= c and c + size - 1 <= h for c, a, h in zip(corner, lo, hi)):
            first, last = key << (level * dims), ((key + 1) << (level * dims)) - 1
            if out and out[-1][1] + 1 == first:
                out[-1] = (out[-1][0], last)
            else:
                out.append((first, last))
            return
        half = size >> 1
        for child in range(1 << dims):
            visit(tuple(c + half * ((child >> i) & 1) for i, c in enumerate(corner)), level - 1, key << dims | child)

    visit((0,) * dims, bits, 0)
    while most and len(out) > most:
        i = min(range(len(out) - 1), key=lambda i: out[i + 1][0] - out[i][1])
        out[i : i + 2] = [(out[i][0], out[i + 1][1])]
    return out


def box_extremes(lo: tuple[int, ...], hi: tuple[int, ...]) -> tuple[int, int]:
    """Least and greatest Morton key in a box: its corners."""
    return encode(lo), encode(hi)


def _lane(bits: int, dims: int, axis: int, upto: int) -> int:
    """Bits of an axis below bit `upto` of a key."""
    return sum(1 << b for b in range(axis, min(upto, bits * dims), dims))


def next_in_box(key: int, lo: tuple[int, ...], hi: tuple[int, ...], bits: int) -> int | None:
    """Least key of the box that is at least `key`, by one walk down the bits.

    Where the key's bit parts the box in two, the upper half's least key is the
    answer so far if the key goes below, and the search goes on in its own half.
    """
    dims = len(lo)
    least, most, best = encode(lo), encode(hi), None
    for b in range(bits * dims - 1, -1, -1):
        bit, lane = 1 << b, _lane(bits, dims, b % dims, b)
        at, low, high = bool(key & bit), bool(least & bit), bool(most & bit)
        if low == high:
            if at != low:
                return best if at else least
            continue
        if at:
            least = (least & ~lane) | bit
        else:
            best = (least & ~lane) | bit
            most = (most & ~bit) | lane
    return key


def last_in_box(key: int, lo: tuple[int, ...], hi: tuple[int, ...], bits: int) -> int | None:
    """Greatest key of the box that is at most `key`; see ``next_in_box``."""
    dims = len(lo)
    least, most, best = encode(lo), encode(hi), None
    for b in range(bits * dims - 1, -1, -1):
        bit, lane = 1 << b, _lane(bits, dims, b % dims, b)
        at, low, high = bool(key & bit), bool(least & bit), bool(most & bit)
        if low == high:
            if at != low:
                return most if at else best
            continue
        if at:
            best = (most & ~bit) | lane
            least = (least & ~lane) | bit
        else:
            most = (most & ~bit) | lane
    return key


def runs(keys: list[int], lo: tuple[int, ...], hi: tuple[int, ...], bits: int) -> list[tuple[int, int]]:
    """Runs (first, last) of positions in a sorted key list whose keys lie in a box.

    A cursor leaps over each gap to the least key of the box behind it.
    """
    from bisect import bisect_left

    dims, out, at = len(lo), [], 0
    while at < len(keys):
        to = next_in_box(keys[at], lo, hi, bits)
        if to is None:
            break
        if to > keys[at]:
            at = bisect_left(keys, to, at)
            continue
        start = at
        while at < len(keys) and all(a <= sum(((keys[at] >> (b * dims + i)) & 1) << b for b in range(bits)) <= z for i, (a, z) in enumerate(zip(lo, hi))):
            at += 1
        out.append((start, at - 1))
    return out


def hilbert_encode(p: tuple[int, ...], bits: int) -> int:
    """Hilbert index on the driver, of the curve of ``hilbert3`` and its twins."""
    v = list(p)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(len(v)):
            if v[i] & q:
                v[0] ^= q - 1
            else:
                swap = (v[0] ^ v[i]) & (q - 1)
                v[0], v[i] = v[0] ^ swap, v[i] ^ swap
        q >>= 1
    for i in range(1, len(v)):
        v[i] ^= v[i - 1]
    turn = 0
    for b in range(bits - 1, 0, -1):
        if v[-1] >> b & 1:
            turn ^= (1 << b) - 1
    return encode(tuple(x ^ turn for x in reversed(v)))


def hilbert_ranges(lo: tuple[int, ...], hi: tuple[int, ...], bits: int) -> list[tuple[int, int]]:
    """Hilbert index ranges (inclusive, ascending) of an inclusive box of cells.

    Every aligned cube is one range: it starts at the index of any of its cells,
    with the digits below the cube's level cleared.
    """
    dims = len(lo)
    found: list[tuple[int, int]] = []

    def visit(corner: tuple[int, ...], level: int) -> None:
        size = 1 << level
        if any(c > h or c + size - 1 < a for c, a, h in zip(corner, lo, hi)):
            return
        if all(a <= c and c + size - 1 <= h for c, a, h in zip(corner, lo, hi)):
            first = hilbert_encode(corner, bits) >> (level * dims) << (level * dims)
            found.append((first, first + (1 << (level * dims)) - 1))
            return
        half = size >> 1
        for child in range(1 << dims):
            visit(tuple(c + half * ((child >> i) & 1) for i, c in enumerate(corner)), level - 1)

    visit((0,) * dims, bits)
    out: list[tuple[int, int]] = []
    for a, z in sorted(found):
        if out and out[-1][1] + 1 == a:
            out[-1] = (out[-1][0], z)
        else:
            out.append((a, z))
    return out


def hilbert_extremes(lo: tuple[int, ...], hi: tuple[int, ...], bits: int) -> tuple[int, int]:
    """Least and greatest Hilbert index in a box; not at its corners, unlike Morton keys."""
    ranges = hilbert_ranges(lo, hi, bits)
    return ranges[0][0], ranges[-1][1]


def midpoint(a, b) -> Column:
    """Integer midpoint, rounded down, that no sum can overflow."""
    a, b = _c(a), _c(b)
    return a.bitwiseAND(b) + F.shiftright(a.bitwiseXOR(b), 1)


def in_ranges(key, ranges: list[tuple[int, int]]) -> Column:
    """Whether a key lies in one of the ranges; pushed to the scan as comparisons."""
    key = _c(key)
    return reduce(lambda a, b: a | b, [(key >= a) & (key <= z) for a, z in ranges], F.lit(False))
