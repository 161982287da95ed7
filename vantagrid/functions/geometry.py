"""Vector, quaternion, ray and box arithmetic as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(*names: str) -> Vec:
    return tuple(F.col(n) for n in names)


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(x - y for x, y in zip(a, b))


def add(a: Vec, b: Vec) -> Vec:
    return tuple(x + y for x, y in zip(a, b))


def scale(a: Vec, s: Column) -> Vec:
    return tuple(x * s for x in a)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def length(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def rotate(q: Sequence[Column], v: Vec) -> Vec:
    """``v`` turned by the unit quaternion (x, y, z, w)."""
    u = (q[0], q[1], q[2])
    t = scale(cross(u, v), F.lit(2.0))
    return add(add(v, scale(t, q[3])), cross(u, t))


def unrotate(q: Sequence[Column], v: Vec) -> Vec:
    """``v`` in the frame of the quaternion, by its conjugate."""
    return rotate((-q[0], -q[1], -q[2], q[3]), v)


def f32(c: Column) -> Column:
    """Rounded to single precision, as a double."""
    return c.cast("float").cast("double")


def ray_hit(origin: Vec, direction: Vec, a: Vec, b: Vec, c: Vec, low: Column, high: Column) -> Column:
    """Whether the ray meets the triangle at a distance strictly within (low, high); both faces count."""
    e1, e2 = sub(b, a), sub(c, a)
    p = cross(direction, e2)
    det = dot(e1, p)
    s = sub(origin, a)
    q = cross(s, e1)
    safe = F.when(F.abs(det) < 1e-7, F.lit(1.0)).otherwise(det)
    u, v, t = dot(s, p) / safe, dot(direction, q) / safe, dot(e2, q) / safe
    return (F.abs(det) >= 1e-7) & (u >= 0) & (v >= 0) & (u + v <= 1) & (t > low) & (t < high)


def in_box(p: Vec, centre: Vec, half: Vec, q: Sequence[Column]) -> Column:
    """Whether a point lies in an oriented box, its surface included; parameters count in single precision."""
    local = unrotate([f32(x) for x in q], sub(p, tuple(f32(x) for x in centre)))
    return (F.abs(local[0]) <= f32(half[0])) & (F.abs(local[1]) <= f32(half[1])) & (F.abs(local[2]) <= f32(half[2]))


def obb_extent(centre: Vec, half: Vec, q: Sequence[Column]) -> tuple[Vec, Vec]:
    """Least and largest corner of an oriented box: a half-axis reaches as far as its turned parts add up to."""
    turned = [rotate(q, tuple(half[i] if i == k else F.lit(0.0) for i in range(3))) for k in range(3)]
    reach = tuple(sum((F.abs(t[axis]) for t in turned[1:]), F.abs(turned[0][axis])) for axis in range(3))
    return sub(centre, reach), add(centre, reach)


def halton(index: Column, base: int) -> Column:
    """The radical inverse of ``index`` in ``base``: its digits mirrored behind the point."""
    digits = F.sequence(F.lit(0), F.ceil(F.log(F.greatest(index, F.lit(1)).cast("double") + 1) / F.log(F.lit(float(base)))).cast("int"))
    power = lambda d: F.pow(F.lit(float(base)), d)
    return F.aggregate(digits, F.lit(0.0), lambda total, d: total + (F.floor(index / power(d)) % base).cast("double") / power(d + 1))


def inverses(index: Column, bases: Sequence[int]) -> Column:
    """``halton`` of an index in several bases, as an array: digit by digit for a batch of rows at once, with the same sums."""

    @F.pandas_udf("array<double>")
    def digits(places: pd.Series) -> pd.Series:
        at, out = places.to_numpy(np.int64), np.zeros((len(places), len(bases)))
        for n, base in enumerate(bases):
            for d in range(math.ceil(math.log(max(int(at.max(initial=1)), 1) + 1) / math.log(base)) + 1):
                out[:, n] += np.fmod(np.floor(at / float(base) ** d).astype(np.int64), base) / float(base) ** (d + 1)
        return pd.Series(list(out))

    return F.when(index.isNotNull(), digits(F.coalesce(index.cast("long"), F.lit(0))))


def ball_point(index: Column, radius: float, bases: tuple[int, int, int] = (2, 3, 5)) -> Vec:
    """A low-discrepancy point of a ball: distance, height and turn from the radical inverses in three bases."""
    return ball_point_of(*(halton(index, b) for b in bases), radius)


def ball_point_of(first: Column, second: Column, third: Column, radius: float) -> Vec:
    """``ball_point`` of radical inverses that are known."""
    far, height, turn = radius * F.cbrt(first), 2 * second - 1, 2 * math.pi * third
    flat = far * F.sqrt(1 - height * height)
    return flat * F.cos(turn), far * height, flat * F.sin(turn)


def coverage_weight(n: Column, alpha: float = 2.0) -> Column:
    """Fixed-point weight of one more camera on a place that ``n`` already see."""
    return F.floor(16384 / F.pow(n + 1, F.lit(alpha)) + 0.5).cast("long")


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash of the text's UTF-16 units; products are split so that they fit a long."""
    prime, mask = 16777619, 0xFFFFFFFF
    raw = F.hex(F.encode(text, "UTF-16BE"))
    units = F.transform(F.sequence(F.lit(0), F.length(text) - 1), lambda i: F.conv(F.substring(raw, i * 4 + 1, F.lit(4)), 16, 10).cast("long"))
    times = lambda h: (((F.shiftright(h, 16) * prime).bitwiseAND(0xFFFF) * 65536) + h.bitwiseAND(0xFFFF) * prime).bitwiseAND(F.lit(mask))
    start = F.lit(2166136261).cast("long")
    return F.when(F.length(text) == 0, start).otherwise(F.aggregate(units, start, lambda h, u: times(h.bitwiseXOR(u))))


def horizontal_fov(vertical: Column, aspect: Column) -> Column:
    """Degrees across, from degrees upright; an aspect that isn't positive counts as 1."""
    ratio = F.when(aspect > 0, aspect).otherwise(F.lit(1.0))
    return F.degrees(2 * F.atan(F.tan(F.radians(vertical) / 2) * ratio))


def yaw_pitch(yaw: Column, pitch: Column) -> tuple[Column, Column, Column, Column]:
    """The quaternion of a turn about y, then about the new x; degrees, pitch held within 89."""
    half_yaw, half_pitch = F.radians(yaw) / 2, F.radians(F.least(F.greatest(pitch, F.lit(-89.0)), F.lit(89.0))) / 2
    return F.cos(half_yaw) * F.sin(half_pitch), F.sin(half_yaw) * F.cos(half_pitch), -F.sin(half_yaw) * F.sin(half_pitch), F.cos(half_yaw) * F.cos(half_pitch)


def segment_distance(p: Vec, a: Vec, b: Vec) -> Column:
    """How far a point lies from the stretch between a and b."""
    way = sub(b, a)
    along = F.coalesce(F.try_divide(dot(sub(p, a), way), dot(way, way)), F.lit(0.0))
    return length(sub(p, add(a, scale(way, F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))))))


def rectangle_distance(p: Vec, centre: Vec, q: Sequence[Column], width: Column, depth: Column) -> Column:
    """How far a point lies from a rectangle that its quaternion turns out of the xz plane."""
    local = unrotate(q, sub(p, centre))
    beyond = lambda c, size: F.greatest(F.abs(c) - size / 2, F.lit(0.0))
    return length((beyond(local[0], width), local[1], beyond(local[2], depth)))


def euler_quaternion(yaw: Column, pitch: Column, roll: Column) -> tuple[Column, Column, Column, Column]:
    """The quaternion of turns about y, then the new x, then the new z; degrees."""
    (sy, cy), (sp, cp), (sr, cr) = ((F.sin(F.radians(a) / 2), F.cos(F.radians(a) / 2)) for a in (yaw, pitch, roll))
    return cy * sp * cr + sy * cp * sr, sy * cp * cr - cy * sp * sr, cy * cp * sr - sy * sp * cr, cy * cp * cr + sy * sp * sr


def quaternion_euler(q: Sequence[Column]) -> tuple[Column, Column, Column]:
    """Yaw, pitch and roll in degrees; looking straight up or down, the roll is 0."""
    x, y, z, w = q
    sine = F.least(F.greatest(2 * (w * x - y * z), F.lit(-1.0)), F.lit(1.0))
    level = F.abs(sine) < 0.9999999
    yaw = F.when(level, F.atan2(2 * (x * z + w * y), 1 - 2 * (x * x + y * y))).otherwise(F.atan2(-2 * (x * z - w * y), 1 - 2 * (y * y + z * z)))
    roll = F.when(level, F.atan2(2 * (x * y + w * z), 1 - 2 * (x * x + z * z))).otherwise(F.lit(0.0))
    return F.degrees(yaw), F.degrees(F.asin(sine)), F.degrees(roll)
