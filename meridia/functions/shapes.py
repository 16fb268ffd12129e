"""Boxes, spheres, planes, rays, segments and triangles as column expressions. No result is NULL."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import EPSILON, Vec, absolute, acos, clamp, col, greatest, least, num, pick, sqrt


class Box(NamedTuple):
    low: Vec
    high: Vec

    @classmethod
    def columns(cls, prefix: str = "") -> Box:
        return cls(Vec.columns(f"{prefix}lo_"), Vec.columns(f"{prefix}hi_"))

    def size(self) -> Vec:
        return self.high - self.low

    def centre(self) -> Vec:
        return self.low + self.size() * 0.5

    def volume(self) -> Column:
        s = self.size()
        return s.x * s.y * s.z

    def contains(self, p: Vec) -> Column:
        """Both ends included."""
        return _all((q >= a) & (q <= b) for q, a, b in zip(p, self.low, self.high))

    def overlaps(self, other: Box) -> Column:
        """Strictly: boxes that only touch do not overlap."""
        return _all((a < d) & (c < b) for a, b, c, d in zip(self.low, self.high, other.low, other.high))

    def intersection(self, other: Box) -> Box:
        some = self.overlaps(other)
        low = Vec(*(pick(some, greatest(a, b)) for a, b in zip(self.low, other.low)))
        return Box(low, Vec(*(pick(some, least(a, b)) for a, b in zip(self.high, other.high))))

    def union(self, other: Box) -> Box:
        low = Vec(*(least(a, b) for a, b in zip(self.low, other.low)))
        return Box(low, Vec(*(greatest(a, b) for a, b in zip(self.high, other.high))))

    def closest(self, p: Vec) -> Vec:
        return Vec(*(clamp(q, a, b) for q, a, b in zip(p, self.low, self.high)))

    def distance(self, p: Vec) -> Column:
        return self.closest(p).distance(p)


def _all(conditions) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out & c
    return out


class Ray(NamedTuple):
    """The direction is normalised on use."""

    origin: Vec
    direction: Vec

    def at(self, t: Column) -> Vec:
        return self.origin + self.direction.normalised() * t

    def closest(self, p: Vec) -> Vec:
        t = (p - self.origin).dot(self.direction.normalised())
        return self.at(greatest(t, num(0)))

    def plane(self, normal: Vec, d: Column) -> Column:
        """Distance to a plane n.p + d = 0; NULL where the ray is parallel to it or it lies behind."""
        facing = normal.dot(self.direction.normalised())
        t = -(normal.dot(self.origin) + d) / facing
        return pick((absolute(facing) > EPSILON) & (t >= 0), t)

    def box(self, box: Box) -> tuple[Column, Column]:
        """(entry, exit) distances by slabs, the entry not below 0; NULL on a miss or behind."""
        nears, fars, inside = [], [], []
        for o, d, low, high in zip(self.origin, self.direction.normalised(), box.low, box.high):
            flat = absolute(d) <= EPSILON
            if flat is True:
                a = b = 0.0
            else:
                a, b = (low - o) / d, (high - o) / d
            nears.append(pick(flat, -math.inf, least(a, b)))
            fars.append(pick(flat, math.inf, greatest(a, b)))
            inside.append(pick(flat, (o >= low) & (o <= high), True))
        near, far = greatest(*nears), least(*fars)
        hit = _all(inside) & (near <= far) & (far >= 0)
        return pick(hit, greatest(near, num(0))), pick(hit, far)

    def sphere(self, centre: Vec, radius: Column) -> tuple[Column, Column]:
        """(first, second) forward distances, ascending; a tangent has only the first."""
        to = self.origin - centre
        half = to.dot(self.direction.normalised())
        left = half * half - (to.squared() - radius * radius)
        root = pick(left >= 0, sqrt(greatest(left, num(0))))
        a, b = -half - root, -half + root
        single = root <= EPSILON
        first = pick(a >= 0, a, pick(b >= 0, b))
        return first, pick((a >= 0) & (b >= 0), pick(single, None, b))

    def triangle(self, a: Vec, b: Vec, c: Vec) -> Column:
        """Distance to a triangle, its border included within the tolerance; NULL on a miss."""
        d = self.direction.normalised()
        one, two = b - a, c - a
        p = d.cross(two)
        det = one.dot(p)
        to = self.origin - a
        u = to.dot(p) / det
        q = to.cross(one)
        v, t = d.dot(q) / det, two.dot(q) / det
        inside = (u >= -EPSILON) & (v >= -EPSILON) & (u + v <= 1 + EPSILON) & (t >= 0)
        return pick((absolute(det) > EPSILON) & inside, t)


def closest_on_segment(p: Vec, a: Vec, b: Vec) -> Vec:
    along = b - a
    n = along.squared()
    t = clamp((p - a).dot(along) / n, 0, 1)
    return Vec(*(pick(n > EPSILON, c) for c in a + along * t))


def project_to_plane(p: Vec, normal: Vec, d: Column) -> Vec:
    return p - normal * signed_distance(p, normal, d)


def signed_distance(p: Vec, normal: Vec, d: Column) -> Column:
    return normal.dot(p) + d


def closest_on_sphere(p: Vec, centre: Vec, radius: Column) -> Vec:
    """The centre itself maps to the +x side."""
    to = p - centre
    away = to.length() > EPSILON
    return centre + to.normalised().where(away, Vec.of(1, 0, 0)) * radius


def sphere_area(radius: Column) -> Column:
    return radius * radius * (4 * math.pi)


def sphere_volume(radius: Column) -> Column:
    return radius * radius * radius * (4 / 3 * math.pi)


def spheres_meet(a: Vec, ra: Column, b: Vec, rb: Column) -> Column:
    """Touching spheres meet."""
    return (b - a).squared() <= (ra + rb) * (ra + rb)


def sphere_meets_box(centre: Vec, radius: Column, box: Box) -> Column:
    return (box.closest(centre) - centre).squared() <= radius * radius


def sphere_collision(a: Vec, ra: Column, b: Vec, rb: Column) -> tuple[Vec, Column, Vec]:
    """(normal from a to b, depth, contact midway between the surfaces) of spheres that meet."""
    meet = spheres_meet(a, ra, b, rb)
    to = b - a
    normal = to.normalised().where(to.length() > EPSILON, Vec.of(1, 0, 0))
    depth = ra + rb - to.length()
    contact = ((a + normal * ra) + (b - normal * rb)) * 0.5
    only = lambda v: Vec(*(pick(meet, c) for c in v))
    return only(normal), pick(meet, depth), only(contact)


def ray_angle(a: Vec, b: Vec) -> Column:
    """Acute angle between two directions."""
    return acos(clamp(absolute(a.normalised().dot(b.normalised())), 0, 1))


def closest_between_rays(o1: Vec, d1: Vec, o2: Vec, d2: Vec) -> tuple[Vec, Vec]:
    """Nearest points of two lines; NULL where nearly parallel."""
    u, v, w = d1.normalised(), d2.normalised(), o1 - o2
    b, d, e = u.dot(v), u.dot(w), v.dot(w)
    below = 1 - b * b
    ok = absolute(below) > 1e-6
    s, t = (b * e - d) / below, (e - b * d) / below
    only = lambda p: Vec(*(pick(ok, c) for c in p))
    return only(o1 + u * s), only(o2 + v * t)


class Tri(NamedTuple):
    a: Vec
    b: Vec
    c: Vec

    def _cross(self) -> Vec:
        return (self.b - self.a).cross(self.c - self.a)

    def area(self) -> Column:
        return self._cross().length() * 0.5

    def normal(self) -> Vec:
        return self._cross().normalised()

    def centroid(self) -> Vec:
        return Vec(*((p + q + r) / 3 for p, q, r in zip(*self)))

    def barycentric(self, p: Vec) -> tuple[Column, Column, Column]:
        """Weights of the corners; NULL where two sides are parallel, whatever the triangle's size."""
        v0, v1, v2 = self.b - self.a, self.c - self.a, p - self.a
        normal = v0.cross(v1)
        below = normal.squared()
        ok = below > v0.squared() * v1.squared() * EPSILON**2
        v, w = v2.cross(v1).dot(normal) / below, v0.cross(v2).dot(normal) / below
        return pick(ok, 1 - v - w), pick(ok, v), pick(ok, w)

    def foot(self, p: Vec) -> Vec:
        """The nearest point of the triangle's plane."""
        normal = self.normal()
        return p - normal * normal.dot(p - self.a)

    def closest(self, p: Vec, foot: Vec) -> Vec:
        """The foot on the plane where it lies inside, else the best corner or edge point; earlier candidates win ties.

        ``foot`` is that of ``foot``, best held as columns.
        """
        u, v, w = self.barycentric(foot)
        inside = F.coalesce((u >= -EPSILON) & (v >= -EPSILON) & (w >= -EPSILON), F.lit(False))
        edges = [(self.a, self.b), (self.b, self.c), (self.c, self.a)]
        others = [*self, *(closest_on_segment(p, s, t) for s, t in edges)]
        ranked = F.array_min(F.filter(F.array(*(
            F.struct(col((q - p).squared()).alias("d"), F.lit(k).alias("k"), *(col(c).alias(n) for c, n in zip(q, "xyz")))
            for k, q in enumerate(others)
        )), lambda s: s["d"].isNotNull()))
        return foot.where(inside, Vec(ranked["x"], ranked["y"], ranked["z"]))


def iou(a: tuple, b: tuple) -> Column:
    """Of boxes (x, y, width, height); touching boxes give 0."""
    width = least(a[0] + a[2], b[0] + b[2]) - greatest(a[0], b[0])
    height = least(a[1] + a[3], b[1] + b[3]) - greatest(a[1], b[1])
    shared = greatest(width, 0) * greatest(height, 0)
    union = a[2] * a[3] + b[2] * b[3] - shared
    return pick((shared > 0) & (union > 0), shared / union, 0.0)


def padded(box: tuple, pad: Column, width: Column, height: Column) -> tuple[Column, Column, Column, Column]:
    """A box grown by ``pad`` on every side and clipped to an image."""
    x, y = greatest(box[0] - pad, 0), greatest(box[1] - pad, 0)
    right, bottom = least(box[0] + box[2] + pad, width), least(box[1] + box[3] + pad, height)
    return x, y, right - x, bottom - y
