"""Regions as Column predicates.

A shape gives its bounding box, an exact ``contains`` predicate over coordinate
columns, and ``classify``, which tells for a box (columns or numbers) whether it
is outside (0), may be cut (1) or is inside (2).  Membership of round shapes and
of half-spaces is inclusive; rectangles and boxes are half-open.  The bounding
box is always emitted beside the exact test, so that it reaches the Parquet scan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

OUT, MAYBE, IN = 0, 1, 2


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.col(v) if isinstance(v, str) else F.lit(float(v))


def square(v: Column) -> Column:
    return v * v


def clamp(v: Column, lo, hi) -> Column:
    return F.greatest(_c(lo), F.least(_c(hi), v))


class Shape:
    """Extension point: subclasses give ``bounds`` and ``exact``; ``classify`` may be sharpened."""

    dims = 2

    def bounds(self) -> list[tuple[float, float]]:
        raise NotImplementedError

    def exact(self, *p: Column) -> Column:
        raise NotImplementedError

    def in_bounds(self, *p) -> Column:
        """Closed test of the bounding box."""
        out = None
        for v, (lo, hi) in zip(p, self.bounds()):
            one = (_c(v) >= lo) & (_c(v) <= hi)
            out = one if out is None else out & one
        return out

    def contains(self, *p) -> Column:
        p = [_c(v) for v in p]
        return self.in_bounds(*p) & self.exact(*p)

    def overlaps_box(self, lo: list, hi: list) -> Column:
        out = F.lit(True)
        for a, z, (b, y) in zip(lo, hi, self.bounds()):
            out = out & (_c(a) <= y) & (_c(z) >= b)
        return out

    def classify(self, lo: list, hi: list) -> Column:
        """Default: a box that meets the bounding box may be cut."""
        return F.when(self.overlaps_box(lo, hi), MAYBE).otherwise(OUT)


@dataclass(frozen=True)
class Rect(Shape):
    """Origin and extent, half-open in every axis; also the 3D box."""

    origin: tuple[float, ...]
    extent: tuple[float, ...]

    @property
    def dims(self) -> int:
        return len(self.origin)

    def bounds(self):
        return [(o, o + e) for o, e in zip(self.origin, self.extent)]

    def exact(self, *p):
        out = None
        for v, (lo, hi) in zip(p, self.bounds()):
            one = (v >= lo) & (v < hi)
            out = one if out is None else out & one
        return out

    def contains(self, *p):
        return self.exact(*map(_c, p))

    def contains_closed(self, *p) -> Column:
        return self.in_bounds(*p)

    def intersects(self, lo: list, hi: list) -> Column:
        """Open intersection: touching edges do not meet."""
        out = F.lit(True)
        for a, z, (b, y) in zip(lo, hi, self.bounds()):
            out = out & (_c(a) < y) & (_c(z) > b)
        return out

    def classify(self, lo, hi):
        inside = F.lit(True)
        for a, z, (b, y) in zip(lo, hi, self.bounds()):
            inside = inside & (_c(a) >= b) & (_c(z) <= y)
        return F.when(~self.intersects(lo, hi), OUT).when(inside, IN).otherwise(MAYBE)


def ball_contains(p: list[Column], centre: list, r) -> Column:
    total = square(p[0] - _c(centre[0]))
    for v, c in zip(p[1:], centre[1:]):
        total = total + square(v - _c(c))
    return total <= square(_c(r))


def box_distance2(q: list, lo: list, hi: list) -> Column:
    """Squared distance from a point to the nearest point of a box."""
    total = F.lit(0.0)
    for v, a, z in zip(q, lo, hi):
        total = total + square(F.greatest(_c(a) - _c(v), F.lit(0.0), _c(v) - _c(z)))
    return total


@dataclass(frozen=True)
class Ball(Shape):
    """Disc or sphere."""

    centre: tuple[float, ...]
    radius: float

    @property
    def dims(self) -> int:
        return len(self.centre)

    def bounds(self):
        return [(c - self.radius, c + self.radius) for c in self.centre]

    def exact(self, *p):
        return ball_contains(list(p), list(self.centre), self.radius)

    def classify(self, lo, hi):
        far = F.lit(0.0)
        for a, z, c in zip(lo, hi, self.centre):
            far = far + square(F.greatest(F.abs(_c(a) - c), F.abs(_c(z) - c)))
        near = box_distance2(list(self.centre), lo, hi)
        r2 = self.radius * self.radius
        return F.when(near > r2, OUT).when(far <= r2, IN).otherwise(MAYBE)


def capsule_distance2(p: list[Column], a: list, b: list) -> Column:
    """Squared distance to the segment a-b."""
    d = [_c(y) - _c(x) for x, y in zip(a, b)]
    w = [v - _c(x) for v, x in zip(p, a)]
    dot, length2 = w[0] * d[0], d[0] * d[0]
    for x, y in zip(w[1:], d[1:]):
        dot, length2 = dot + x * y, length2 + y * y
    t = F.when(length2 > 0, clamp(dot / length2, 0.0, 1.0)).otherwise(0.0)
    total = square(w[0] - t * d[0])
    for x, y in zip(w[1:], d[1:]):
        total = total + square(x - t * y)
    return total


@dataclass(frozen=True)
class Capsule(Shape):
    """A segment thickened by a radius, in the plane or in space."""

    a: tuple[float, ...]
    b: tuple[float, ...]
    radius: float

    @classmethod
    def from_ray(cls, origin, direction, reach: float, radius: float) -> Capsule:
        n = math.sqrt(sum(v * v for v in direction))
        return cls(tuple(origin), tuple(o + v / n * reach for o, v in zip(origin, direction)), radius)

    @property
    def dims(self) -> int:
        return len(self.a)

    def bounds(self):
        return [(min(x, y) - self.radius, max(x, y) + self.radius) for x, y in zip(self.a, self.b)]

    def exact(self, *p):
        return capsule_distance2(list(p), list(self.a), list(self.b)) <= self.radius * self.radius

    def classify(self, lo, hi):
        # By the box's centre and half diagonal: sound, if not tight.
        centre = [(_c(a) + _c(z)) / 2 for a, z in zip(lo, hi)]
        half = F.lit(0.0)
        for a, z in zip(lo, hi):
            half = half + square(_c(z) - _c(a))
        half = F.sqrt(half) / 2
        d = F.sqrt(capsule_distance2(centre, list(self.a), list(self.b)))
        return F.when(d - half > self.radius, OUT).when(d + half <= self.radius, IN).otherwise(MAYBE)


@dataclass(frozen=True)
class Polyhedron(Shape):
    """Intersection of half-spaces n.p <= d."""

    planes: tuple[tuple[float, float, float, float], ...]
    box: tuple[tuple[float, float], ...]
    dims = 3

    @classmethod
    def from_corners(cls, c: list[tuple[float, float, float]]) -> Polyhedron:
        """Six faces of a frustum: near corners 0-3 and far corners 4-7, each in ring order."""
        centre = [sum(p[k] for p in c) / 8 for k in range(3)]
        planes = []
        for i, j, k in ((0, 1, 2), (4, 5, 6), (0, 1, 5), (1, 2, 6), (2, 3, 7), (3, 0, 4)):
            u, v = ([c[m][x] - c[i][x] for x in range(3)] for m in (j, k))
            n = (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
            d = sum(a * b for a, b in zip(n, c[i]))
            if sum(a * b for a, b in zip(n, centre)) > d:  # outward normals
                n, d = tuple(-a for a in n), -d
            planes.append((*n, d))
        return cls(tuple(planes), tuple((min(p[k] for p in c), max(p[k] for p in c)) for k in range(3)))

    @classmethod
    def faceted_ball(cls, centre, radius: float, faces: int) -> Polyhedron:
        """Tangent planes at evenly spread normals, and the enclosing cube."""
        golden = math.pi * (3 - math.sqrt(5))
        normals = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
        for i in range(faces):
            z = 1 - 2 * (i + 0.5) / faces
            s = math.sqrt(1 - z * z)
            normals.append((s * math.cos(golden * i), s * math.sin(golden * i), z))
        planes = tuple((*n, sum(a * b for a, b in zip(n, centre)) + radius) for n in normals)
        return cls(planes, tuple((c - radius, c + radius) for c in centre))

    def inflated(self, r: float) -> Polyhedron:
        """A superset of the dilation by r."""
        return Polyhedron(
            tuple((a, b, c, d + r * math.sqrt(a * a + b * b + c * c)) for a, b, c, d in self.planes),
            tuple((lo - r, hi + r) for lo, hi in self.box),
        )

    def bounds(self):
        return list(self.box)

    def exact(self, *p):
        out = None
        for a, b, c, d in self.planes:
            one = p[0] * a + p[1] * b + p[2] * c <= d
            out = one if out is None else out & one
        return out

    def classify(self, lo, hi):
        out, inside = F.lit(False), F.lit(True)
        for plane in self.planes:
            least = most = F.lit(0.0)
            for n, a, z in zip(plane[:3], lo, hi):
                small, large = (_c(a) * n, _c(z) * n) if n >= 0 else (_c(z) * n, _c(a) * n)
                least, most = least + small, most + large
            out, inside = out | (least > plane[3]), inside & (most <= plane[3])
        return F.when(out | ~self.overlaps_box(lo, hi), OUT).when(inside, IN).otherwise(MAYBE)

    def segment_hit(self, a: list, b: list) -> Column:
        """Parameter in [0, 1] where the segment enters; null when it misses."""
        return segment_entry([_c(v) for v in a], [_c(v) for v in b], [tuple(map(F.lit, p)) for p in self.planes])


PARALLEL = 1e-12


def segment_entry(a: list[Column], b: list[Column], planes: list[tuple]) -> Column:
    """Clip a segment by half-spaces n.p <= d: the least parameter that stays inside."""
    t0, t1, miss = F.lit(0.0), F.lit(1.0), F.lit(False)
    for nx, ny, nz, d in planes:
        slope = (b[0] - a[0]) * nx + (b[1] - a[1]) * ny + (b[2] - a[2]) * nz
        gap = d - (a[0] * nx + a[1] * ny + a[2] * nz)
        flat = F.abs(slope) < PARALLEL
        t = gap / F.when(flat, F.lit(1.0)).otherwise(slope)
        miss = miss | (flat & (gap < 0))
        t0 = F.when(~flat & (slope < 0), F.greatest(t0, t)).otherwise(t0)
        t1 = F.when(~flat & (slope > 0), F.least(t1, t)).otherwise(t1)
    return F.when(~miss & (t0 <= t1), t0)


@dataclass(frozen=True)
class PolygonShape(Shape):
    """A ring of straight edges; the boundary counts as inside."""

    ring: tuple[tuple[float, float], ...]

    def bounds(self):
        return [(min(p[k] for p in self.ring), max(p[k] for p in self.ring)) for k in range(2)]

    def edges(self):
        return list(zip(self.ring, self.ring[1:] + self.ring[:1]))

    def exact(self, *p):
        x, y = p
        crossings, on = F.lit(0), F.lit(False)
        for (ax, ay), (bx, by) in self.edges():
            spans = (y >= min(ay, by)) & (y < max(ay, by))
            if ay != by:
                crossings = crossings + F.when(spans & ((y - ay) * ((bx - ax) / (by - ay)) + ax > x), 1).otherwise(0)
            cross = (x - ax) * (by - ay) - (y - ay) * (bx - ax)
            on = on | ((cross == 0) & x.between(min(ax, bx), max(ax, bx)) & y.between(min(ay, by), max(ay, by)))
        return on | (crossings % 2 == 1)

    def boundary_distance(self, x, y) -> Column:
        x, y = _c(x), _c(y)
        return F.sqrt(F.least(*(capsule_distance2([x, y], list(a), list(b)) for a, b in self.edges())))

    def within_dilation(self, r: float, x, y) -> Column:
        return self.contains(x, y) | (self.boundary_distance(x, y) <= r)

    def moved(self, dx: float, dy: float) -> PolygonShape:
        return PolygonShape(tuple((x + dx, y + dy) for x, y in self.ring))

    def scaled(self, f: float) -> PolygonShape:
        return PolygonShape(tuple((x * f, y * f) for x, y in self.ring))

    def rotated(self, degrees: float) -> PolygonShape:
        c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
        return PolygonShape(tuple((x * c - y * s, x * s + y * c) for x, y in self.ring))


def sector(facing_x, facing_z, dx, dz) -> Column:
    """front, rear, left or right of a facing direction, by dot and cross product."""
    dot = _c(facing_x) * _c(dx) + _c(facing_z) * _c(dz)
    cross = _c(facing_x) * _c(dz) - _c(facing_z) * _c(dx)
    return F.when(F.abs(dot) >= F.abs(cross), F.when(dot >= 0, "front").otherwise("rear")).otherwise(F.when(cross > 0, "left").otherwise("right"))


def angle_about(x, y, cx=0.0, cy=0.0) -> Column:
    """Angle of a point about a centre in [0, 2 pi)."""
    a = F.atan2(_c(y) - _c(cy), _c(x) - _c(cx))
    return F.when(a < 0, a + 2 * math.pi).otherwise(a)


def segments_cross(a, b, c, d) -> Column:
    """Whether segments a-b and c-d share a point that is interior to both."""
    def side(p, q, r):
        return (_c(q[0]) - _c(p[0])) * (_c(r[1]) - _c(p[1])) - (_c(q[1]) - _c(p[1])) * (_c(r[0]) - _c(p[0]))

    return (side(a, b, c) * side(a, b, d) < 0) & (side(c, d, a) * side(c, d, b) < 0)


def line_circle(a, b, centre, r) -> tuple[Column, Column]:
    """Parameters along a-b where its line meets a circle; null when it does not."""
    dx, dy = _c(b[0]) - _c(a[0]), _c(b[1]) - _c(a[1])
    fx, fy = _c(a[0]) - _c(centre[0]), _c(a[1]) - _c(centre[1])
    qa, qb, qc = dx * dx + dy * dy, 2 * (fx * dx + fy * dy), fx * fx + fy * fy - square(_c(r))
    disc = qb * qb - 4 * qa * qc
    root = F.when((disc >= 0) & (qa > 0), F.sqrt(F.greatest(disc, F.lit(0.0))))
    return (-qb - root) / (2 * qa), (-qb + root) / (2 * qa)


def line_distance(p, a, b) -> Column:
    """Distance of a point from the line through a and b; from a itself where they are one point."""
    dx, dy = _c(b[0]) - _c(a[0]), _c(b[1]) - _c(a[1])
    fx, fy = _c(p[0]) - _c(a[0]), _c(p[1]) - _c(a[1])
    n2 = dx * dx + dy * dy
    return F.when(n2 > 0, F.abs(dx * fy - dy * fx) / F.sqrt(F.when(n2 > 0, n2))).otherwise(F.sqrt(fx * fx + fy * fy))


def segments_meet(a, b, c, d) -> tuple[Column, Column]:
    """The point in which segments a-b and c-d cross (see ``segments_cross``); null when they do not."""
    ux, uy, vx, vy = _c(b[0]) - _c(a[0]), _c(b[1]) - _c(a[1]), _c(d[0]) - _c(c[0]), _c(d[1]) - _c(c[1])
    turn = ux * vy - uy * vx
    t = F.when(segments_cross(a, b, c, d), ((_c(c[0]) - _c(a[0])) * vy - (_c(c[1]) - _c(a[1])) * vx) / F.when(turn != 0, turn))
    return _c(a[0]) + t * ux, _c(a[1]) + t * uy


def line_arc(a, b, centre, r, start, sweep) -> tuple[Column, Column]:
    """Parameters along a-b where its line meets an arc from angle `start`, counterclockwise over `sweep`; null where it does not."""
    out = []
    for t in line_circle(a, b, centre, r):
        x, y = _c(a[0]) + t * (_c(b[0]) - _c(a[0])), _c(a[1]) + t * (_c(b[1]) - _c(a[1]))
        turn = angle_about(x, y, *centre) - _c(start)
        turn = turn - F.floor(turn / (2 * math.pi)) * (2 * math.pi)
        out.append(F.when(turn <= _c(sweep), t))
    return tuple(out)
