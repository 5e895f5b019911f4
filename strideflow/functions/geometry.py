"""Quaternion, rotation and frame functions as column expressions over small arrays. Quaternions are (x, y, z, w)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(a: Column, n: int) -> list[Column]:
    return [F.get(a, F.lit(k)).cast("double") for k in range(n)]


def to_y_up(p: Column) -> Column:
    """z-up (x, y, z) to y-up (x, z, -y)."""
    x, y, z = parts(p, 3)
    return F.array(x, z, -y)


def to_z_up(p: Column) -> Column:
    x, y, z = parts(p, 3)
    return F.array(x, -z, y)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dot(a: list[Column], b: list[Column]) -> Column:
    return sum((x * y for x, y in zip(a[1:], b[1:], strict=True)), a[0] * b[0])


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def normalize(q: Column, n: int = 4, strict: bool = True) -> Column:
    """The array over its length; a zero or non-finite one raises, or with strict=False gives null."""
    length = F.sqrt(dot(parts(q, n), parts(q, n)))
    good = (length > 0) & (length < F.lit(float("inf")))
    unit = F.transform(q, lambda x: x.cast("double") / length)
    return F.when(good, unit).otherwise(F.raise_error(F.lit("degenerate vector")).cast("array<double>") if strict else F.lit(None))


def wxyz_to_xyzw(q: Column) -> Column:
    w, x, y, z = parts(q, 4)
    return F.array(x, y, z, w)


def quaternion_to_y_up(q: Column) -> Column:
    """Change of basis from z-up to y-up: the vector part is reordered, and the sign makes w >= 0."""
    x, y, z, w = parts(q, 4)
    sign = F.when(w < 0, -1.0).otherwise(1.0)
    return F.array(x * sign, z * sign, -y * sign, w * sign)


def quaternion_to_z_up(q: Column) -> Column:
    x, y, z, w = parts(q, 4)
    sign = F.when(w < 0, -1.0).otherwise(1.0)
    return F.array(x * sign, -z * sign, y * sign, w * sign)


def to_matrix(q: Column) -> Column:
    """Row-major 3x3 matrix of a unit quaternion."""
    x, y, z, w = parts(q, 4)
    return F.array(
        1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
        2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
        2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y),
    )


def from_matrix(m: Column) -> Column:
    """Unit quaternion with w >= 0 of a rotation matrix: the largest component first, so nothing small is divided by."""
    a = parts(m, 9)
    trace = a[0] + a[4] + a[8]
    cases = [
        (trace, [a[7] - a[5], a[2] - a[6], a[3] - a[1], 1 + trace]),
        (a[0], [1 + a[0] - a[4] - a[8], a[1] + a[3], a[2] + a[6], a[7] - a[5]]),
        (a[4], [a[1] + a[3], 1 - a[0] + a[4] - a[8], a[5] + a[7], a[2] - a[6]]),
        (a[8], [a[2] + a[6], a[5] + a[7], 1 - a[0] - a[4] + a[8], a[3] - a[1]]),
    ]
    best = F.greatest(*[c for c, _ in cases])
    raw = F.coalesce(*[F.when(c == best, F.array(*q)) for c, q in cases])
    length = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    sign = F.when(F.get(raw, F.lit(3)) < 0, -1.0).otherwise(1.0)
    return F.transform(raw, lambda x: x * sign / length)


def slerp(q0: Column, q1: Column, share: Column) -> Column:
    """Along the shorter arc; linear where the arc is tiny; of length 1 again."""

    def shares(ends: Column) -> Column:
        """The weight of each end."""
        angle, sign = F.acos(F.least(F.abs(ends["d"]), F.lit(1.0))), F.when(ends["d"] < 0, -1.0).otherwise(1.0)
        flat = F.sin(angle) < 1e-8
        u = F.when(flat, 1 - share).otherwise(F.sin((1 - share) * angle) / F.sin(angle))
        v = F.when(flat, share).otherwise(F.sin(share * angle) / F.sin(angle)) * sign
        return F.struct(ends["a"].alias("a"), ends["b"].alias("b"), u.alias("u"), v.alias("v"))

    ends = let(F.struct(F.array(*parts(q0, 4)).alias("a"), F.array(*parts(q1, 4)).alias("b")), lambda e: F.struct(e["a"].alias("a"), e["b"].alias("b"), dot(parts(e["a"], 4), parts(e["b"], 4)).alias("d")))
    mixed = let(let(ends, shares), lambda s: F.zip_with(s["a"], s["b"], lambda x, y: x * s["u"] + y * s["v"]))
    return let(mixed, lambda m: normalize(m))


def matrix_to_6d(m: Column) -> Column:
    """The first two columns."""
    a = parts(m, 9)
    return F.array(a[0], a[3], a[6], a[1], a[4], a[7])


def matrix_from_6d(r: Column) -> Column:
    """Gram-Schmidt: x from the first axis, z across both, y across z and x; null for degenerate axes. Each step is computed once: nested in each other their expressions would grow by a factor a step."""
    length = lambda v: F.sqrt(dot(parts(v, 3), parts(v, 3)))
    unit = lambda v: let(v, lambda v: let(length(v), lambda n: F.transform(v, lambda c: c / n)))
    axes = lambda s: F.array(*[F.get(c, F.lit(k)) for k in range(3) for c in (s["x"], s["y"], s["z"])])
    whole = lambda s: let(F.struct(s["x"].alias("x"), s["z"].alias("z"), F.array(*cross(parts(s["z"], 3), parts(s["x"], 3))).alias("y")), axes)
    across = lambda s: let(F.struct(s["x"].alias("x"), unit(F.array(*cross(parts(s["x"], 3), parts(s["b"], 3)))).alias("z")), whole)
    turned = lambda s: let(F.struct(unit(s["a"]).alias("x"), s["b"].alias("b")), across)
    good = lambda s: (dot(parts(s["a"], 3), parts(s["a"], 3)) > 0) & let(F.array(*cross(parts(s["a"], 3), parts(s["b"], 3))), lambda c: dot(parts(c, 3), parts(c, 3)) > 0)
    ends = let(r, lambda r: F.struct(F.array(*parts(r, 6)[:3]).alias("a"), F.array(*parts(r, 6)[3:]).alias("b")))
    return let(ends, lambda s: F.when(good(s), turned(s)))


def rotvec(q: Column) -> Column:
    """Axis times angle of a unit quaternion with w >= 0 (from_matrix gives one)."""
    x, y, z, w = parts(q, 4)
    length = F.sqrt(x * x + y * y + z * z)
    scale = F.when(length < 1e-12, F.lit(2.0)).otherwise(2 * F.atan2(length, w) / length)
    return F.array(x * scale, y * scale, z * scale)


def rotvec_to_matrix(v: Column) -> Column:
    x, y, z = parts(v, 3)
    angle = F.sqrt(x * x + y * y + z * z)
    half = F.when(angle < 1e-12, F.lit(0.5)).otherwise(F.sin(angle / 2) / angle)
    return to_matrix(F.array(x * half, y * half, z * half, F.cos(angle / 2)))


def multiply(m: Column, v: Column) -> Column:
    """3x3 matrix times vector."""
    a, x = parts(m, 9), parts(v, 3)
    return F.array(*[dot(a[3 * k : 3 * k + 3], x) for k in range(3)])


def geodesic(m0: Column, m1: Column) -> Column:
    """Angle between two rotations."""
    trace = dot(parts(m0, 9), parts(m1, 9))
    return F.acos(F.greatest(F.least((trace - 1) / 2, F.lit(1.0)), F.lit(-1.0)))


def yaw_of_matrix(m: Column) -> Column:
    """Yaw about the y axis as the prepared data has it."""
    a = parts(m, 9)
    return F.atan2(a[6], a[0])


def episode_basis(q: Column) -> Column:
    """Row-major axes of the frame anchored on a root rotation: z is its x axis flattened to the floor, y is up; null if that is upright."""
    m = parts(to_matrix(q), 9)
    length = F.sqrt(m[0] * m[0] + m[6] * m[6])
    fx, fz = m[0] / length, m[6] / length
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.when(length > 1e-8, F.array(fz, zero, -fx, zero, one, zero, fx, zero, fz))


def to_episode(p: Column, origin: Column, basis: Column) -> Column:
    """A position in an anchored frame whose origin is the root's point on the floor."""
    o = parts(origin, 3)
    return multiply(basis, F.zip_with(p, F.array(o[0], F.lit(0.0), o[2]), lambda a, b: a.cast("double") - b))


def product(a: list[Column], b: list[Column]) -> list[Column]:
    """Quaternion product, scalar last."""
    v = [a[3] * y + b[3] * x + c for x, y, c in zip(a[:3], b[:3], cross(a[:3], b[:3]), strict=True)]
    return [*v, a[3] * b[3] - dot(a[:3], b[:3])]


def conjugate(q: list[Column]) -> list[Column]:
    return [-q[0], -q[1], -q[2], q[3]]


def rotate(q: list[Column], v: list[Column]) -> list[Column]:
    """A vector turned by a unit quaternion."""
    t = [2 * x for x in cross(q[:3], v)]
    return [x + q[3] * y + z for x, y, z in zip(v, t, cross(q[:3], t), strict=True)]


def arc(a: list[Column], b: list[Column]) -> Column:
    """The rotation from direction a to direction b by the half-way rule, for vectors of any length; null for opposite ones and for a zero vector."""
    raw = F.array(*cross(a, b), F.sqrt(dot(a, a) * dot(b, b)) + dot(a, b))
    return let(raw, lambda q: normalize(q, strict=False))


def upright(q: list[Column]) -> Column:
    """A quaternion as an array with w >= 0."""
    return F.array(*[x * F.when(q[3] < 0, -1.0).otherwise(1.0) for x in q])


def facing(left: Column, right: Column) -> tuple[Column, Column]:
    """Unit facing (x, z): up crossed with right minus left."""
    d = [b - a for a, b in zip(parts(left, 3), parts(right, 3), strict=True)]
    length = F.sqrt(d[0] * d[0] + d[2] * d[2])
    return d[2] / length, -d[0] / length
