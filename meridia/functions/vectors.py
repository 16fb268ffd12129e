"""3D vectors, quaternions and matrices as column expressions.

A ``Vec`` is three DOUBLE columns, a ``Quat`` four (x, y, z, w), a ``Mat`` a row-major grid of columns. Any component may be a
plain number instead, and what is made of numbers alone is worked out at once, so that a fixed rotation costs
nine constants a row. What has no result (a zero vector has no direction, a singular matrix no inverse) is NULL.

An expression repeats what it is made of. ``held`` turns intermediate results into columns, so that long
chains (camera poses, composed rotations of columns) are computed once a row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: single-precision machine epsilon, the tolerance of degenerate shapes (a fixed value)
EPSILON = 1.1920929e-07
#: double-precision machine epsilon, the least length of what has a direction (a fixed value)
TINY = 2.220446049250313e-16


def num(value):
    """A column as it is, anything else as a float."""
    return value if isinstance(value, Column) or value is None else float(value)


def col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _either(on_columns, on_numbers):
    def apply(*values):
        if any(v is None for v in values):
            return None
        if any(isinstance(v, Column) for v in values):
            return on_columns(*map(col, values))
        return on_numbers(*values)

    return apply


sqrt = _either(F.sqrt, math.sqrt)
sin = _either(F.sin, math.sin)
cos = _either(F.cos, math.cos)
acos = _either(F.acos, math.acos)
asin = _either(F.asin, math.asin)
atan2 = _either(F.atan2, math.atan2)
absolute = _either(F.abs, abs)
least = _either(F.least, min)
greatest = _either(F.greatest, max)


def pick(condition, yes, no=None):
    """``yes`` where the condition holds, else ``no`` (NULL if not given)."""
    if isinstance(condition, Column):
        return F.when(condition, col(yes)).otherwise(col(no))
    return yes if condition else no


def clamp(value, low, high):
    return least(greatest(value, num(low)), num(high))


def tidy(value, digits: int = 6) -> Column:
    """Rounded for comparison, without negative zeros.

    Averages of exact decimals often lie on a tie, where the order of the sum decides; a tenth of a billionth moves them off.
    """
    return F.round(col(value).cast("double") + 1e-10, digits) + F.lit(0.0)


def held(df: DataFrame, **values) -> tuple:
    """``df`` with the columns of the given vectors, rotations or poses, and these as references to the columns."""
    new: dict[str, Column] = {}

    def hold(name: str, value):
        if isinstance(value, Column):
            new[name] = value
            return F.col(name)
        if isinstance(value, Mat):
            return Mat(hold(name, tuple(tuple(row) for row in value.rows)))
        if isinstance(value, tuple):
            parts = [hold(f"{name}_{k}", v) for k, v in enumerate(value)]
            return type(value)(*parts) if hasattr(value, "_fields") else tuple(parts)
        return value

    out = [hold(f"_{name}", value) for name, value in values.items()]
    return (df.withColumns(new), *out)


class Vec(NamedTuple):
    x: Column | float
    y: Column | float
    z: Column | float

    @classmethod
    def of(cls, x, y, z) -> Vec:
        return cls(num(x), num(y), num(z))

    @classmethod
    def columns(cls, prefix: str = "") -> Vec:
        return cls(*(F.col(f"{prefix}{axis}").cast("double") for axis in "xyz"))

    def __add__(self, other: Vec) -> Vec:  # type: ignore[override]
        return Vec(*(a + b for a, b in zip(self, other)))

    def __sub__(self, other: Vec) -> Vec:
        return Vec(*(a - b for a, b in zip(self, other)))

    def __mul__(self, factor) -> Vec:  # type: ignore[override]
        return Vec(*(a * num(factor) for a in self))

    def times(self, other: Vec) -> Vec:
        return Vec(*(a * b for a, b in zip(self, other)))

    def dot(self, other: Vec) :
        return self.x * other.x + self.y * other.y + self.z * other.z

    def cross(self, other: Vec) -> Vec:
        return Vec(
            self.y * other.z - self.z * other.y, self.z * other.x - self.x * other.z, self.x * other.y - self.y * other.x
        )

    def squared(self) :
        return self.dot(self)

    def length(self):
        return sqrt(self.squared())

    def distance(self, other: Vec) :
        return (self - other).length()

    def normalised(self) -> Vec:
        n = self.length()
        if not isinstance(n, Column) and n <= TINY:
            return Vec(None, None, None)
        return Vec(*(pick(n > TINY, a / n) for a in self))

    def where(self, condition: Column, other: Vec) -> Vec:
        """This vector where the condition holds, the other elsewhere."""
        return Vec(*(pick(condition, a, b) for a, b in zip(self, other)))

    def named(self, prefix: str = "") -> list[Column]:
        return [tidy(c).alias(f"{prefix}{axis}") for c, axis in zip(self, "xyz")]


class Quat(NamedTuple):
    """A rotation; inputs are normalised on use, a zero quaternion gives NULL."""

    x: Column | float
    y: Column | float
    z: Column | float
    w: Column | float

    @classmethod
    def of(cls, x, y, z, w) -> Quat:
        return cls(num(x), num(y), num(z), num(w))

    @classmethod
    def about(cls, axis: Vec, angle) -> Quat:
        half, unit = num(angle) / 2, axis.normalised()
        s = sin(half)
        return cls(unit.x * s, unit.y * s, unit.z * s, cos(half))

    @classmethod
    def euler(cls, order: str, x, y, z) -> Quat:
        """Rotations about the axes by their angles, applied in the named order (such as "xyz": x first)."""
        turns = {"x": cls.about(Vec.of(1, 0, 0), x), "y": cls.about(Vec.of(0, 1, 0), y), "z": cls.about(Vec.of(0, 0, 1), z)}
        first, second, third = (turns[axis] for axis in order.lower())
        return third * second * first

    def to_euler(self, order: str) -> tuple[Column, Column, Column]:
        """(x, y, z) angles that ``euler`` of the same order turns back into this rotation."""
        i, j, k = ("xyz".index(axis) for axis in reversed(order.lower()))
        sign = 1.0 if (j - i) % 3 == 1 else -1.0
        m = self.matrix().rows
        middle = asin(clamp(m[i][k] * sign, -1, 1))
        first = atan2(m[j][k] * -sign, m[k][k])
        last = atan2(m[i][j] * -sign, m[i][i])
        angles = {i: first, j: middle, k: last}
        return angles[0], angles[1], angles[2]

    def dot(self, other: Quat) :
        return self.x * other.x + self.y * other.y + self.z * other.z + self.w * other.w

    def normalised(self) -> Quat:
        n = sqrt(self.dot(self))
        if not isinstance(n, Column) and n <= TINY:
            return Quat(None, None, None, None)
        return Quat(*(pick(n > TINY, a / n) for a in self))

    def conjugate(self) -> Quat:
        return Quat(-self.x, -self.y, -self.z, self.w)

    def __mul__(self, other: Quat) -> Quat:  # type: ignore[override]
        a, b = self, other
        return Quat(
            a.w * b.x + a.x * b.w + a.y * b.z - a.z * b.y,
            a.w * b.y - a.x * b.z + a.y * b.w + a.z * b.x,
            a.w * b.z + a.x * b.y - a.y * b.x + a.z * b.w,
            a.w * b.w - a.x * b.x - a.y * b.y - a.z * b.z,
        )

    def rotate(self, v: Vec) -> Vec:
        q = self.normalised()
        axis = Vec(q.x, q.y, q.z)
        side = axis.cross(v) * 2.0
        return v + side * q.w + axis.cross(side)

    def _blend(self, other: Quat, a: Column, b: Column) -> Quat:
        return Quat(*(p * a + q * b for p, q in zip(self, other))).normalised()

    def nlerp(self, other: Quat, t) -> Quat:
        """Normalised linear blend along the shorter way."""
        p, q, t = self.normalised(), other.normalised(), num(t)
        sign = pick(p.dot(q) < 0, -1.0, 1.0)
        return p._blend(q, 1 - t, t * sign)

    def slerp(self, other: Quat, t) -> Quat:
        """Spherical blend along the shorter way; linear where the two are nearly alike."""
        p, q, t = self.normalised(), other.normalised(), num(t)
        cosine = p.dot(q)
        sign = pick(cosine < 0, -1.0, 1.0)
        angle = acos(least(absolute(cosine), 1.0))
        near = absolute(cosine) > 0.9995
        if near is True:
            return p.nlerp(q, t)
        a = pick(near, 1 - t, sin(angle * (1 - t)) / sin(angle))
        b = pick(near, t, sin(angle * t) / sin(angle))
        return p._blend(q, a, b * sign)

    def matrix(self) -> Mat:
        x, y, z, w = self.normalised()
        return Mat(
            [
                [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
                [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
                [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
            ]
        )

    def named(self, prefix: str = "q") -> list[Column]:
        return [tidy(c).alias(f"{prefix}{axis}") for c, axis in zip(self, "xyzw")]


def _total(values):
    out = None
    for v in values:
        out = v if out is None else out + v
    return out


class Mat:
    """A small matrix of columns, row-major."""

    def __init__(self, rows: Sequence[Sequence]):
        self.rows = [[num(c) for c in row] for row in rows]

    @classmethod
    def identity(cls, n: int) -> Mat:
        return cls([[1.0 if i == j else 0.0 for j in range(n)] for i in range(n)])

    @classmethod
    def from_array(cls, column: Column, n: int) -> Mat:
        return cls([[column[i * n + j].cast("double") for j in range(n)] for i in range(n)])

    def __matmul__(self, other: Mat) -> Mat:
        columns = list(zip(*other.rows))
        return Mat([[_total(a * b for a, b in zip(row, column)) for column in columns] for row in self.rows])

    def transpose(self) -> Mat:
        return Mat(list(zip(*self.rows)))

    def minor(self, i: int, j: int) -> Mat:
        return Mat([[c for q, c in enumerate(row) if q != j] for p, row in enumerate(self.rows) if p != i])

    def determinant(self) :
        if len(self.rows) == 1:
            return self.rows[0][0]
        terms = (self.rows[0][j] * self.minor(0, j).determinant() * (-1.0) ** j for j in range(len(self.rows)))
        return _total(terms)

    def inverse(self) -> Mat:
        """By cofactors; NULL where the determinant vanishes."""
        n, d = len(self.rows), self.determinant()
        if not isinstance(d, Column) and d == 0:
            return Mat([[None] * n for _ in range(n)])
        scale = pick(d != 0, 1.0 / d)
        return Mat([[self.minor(j, i).determinant() * (-1.0) ** (i + j) * scale for j in range(n)] for i in range(n)])

    def apply(self, v: Vec) -> Vec:
        """Times a vector; a fourth column is the translation of an affine matrix."""
        out = []
        for row in self.rows[:3]:
            value = row[0] * v.x + row[1] * v.y + row[2] * v.z
            out.append(value + row[3] if len(row) > 3 else value)
        return Vec(*out)

    def quaternion(self) -> Quat:
        """Of a rotation matrix, by its largest diagonal combination."""
        m = self.rows
        trace = m[0][0] + m[1][1] + m[2][2]
        big = [
            1 + trace,
            1 + m[0][0] - m[1][1] - m[2][2],
            1 - m[0][0] + m[1][1] - m[2][2],
            1 - m[0][0] - m[1][1] + m[2][2],
        ]
        forms = [
            (m[2][1] - m[1][2], m[0][2] - m[2][0], m[1][0] - m[0][1], big[0]),
            (big[1], m[0][1] + m[1][0], m[0][2] + m[2][0], m[2][1] - m[1][2]),
            (m[0][1] + m[1][0], big[2], m[1][2] + m[2][1], m[0][2] - m[2][0]),
            (m[0][2] + m[2][0], m[1][2] + m[2][1], big[3], m[1][0] - m[0][1]),
        ]
        best = greatest(*big)
        chosen = [pick(big[0] == best, forms[0][k], pick(big[1] == best, forms[1][k], pick(big[2] == best, forms[2][k], forms[3][k]))) for k in range(4)]
        return Quat(*chosen).normalised()

    def array(self) :
        return F.array(*(col(c) for row in self.rows for c in row))


class Similarity(NamedTuple):
    """Scale, rotate, translate. ``then`` applies this first and the other after it, for every kind of transform here."""

    rotation: Quat
    translation: Vec
    scale: Column

    def apply(self, p: Vec) -> Vec:
        return self.rotation.rotate(p * self.scale) + self.translation

    def then(self, other: Similarity) -> Similarity:
        rotation = other.rotation.normalised() * self.rotation.normalised()
        return Similarity(rotation, other.apply(self.translation), self.scale * other.scale)

    def inverse(self) -> Similarity:
        back, scale = self.rotation.normalised().conjugate(), 1.0 / self.scale
        return Similarity(back, back.rotate(self.translation) * (-1.0 * scale), scale)

    def affine(self) -> Mat:
        return trs(self.translation, self.rotation, Vec(self.scale, self.scale, self.scale))


def rigid(rotation: Quat, translation: Vec) -> Similarity:
    return Similarity(rotation, translation, 1.0)


def trs(translation: Vec, rotation: Quat, scale: Vec) -> Mat:
    """Affine matrix that scales by axis, then rotates, then translates."""
    turn = rotation.matrix().rows
    rows = [[*(c * s for c, s in zip(row, scale)), t] for row, t in zip(turn, translation)]
    return Mat([*rows, [0.0, 0.0, 0.0, 1.0]])
