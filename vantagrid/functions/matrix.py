"""Matrices of four by four: arrays of sixteen numbers, column by column, kept in single precision; sums and products are taken in double.

Give named columns where a matrix goes into another: expressions repeat what they are given.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import Vec, f32


def _kept(entries: Sequence[Column]) -> Column:
    return F.array(*(f32(e) for e in entries))


def _entry(m: Column, row: int, column: int) -> Column:
    return F.get(m, F.lit(4 * column + row))


def identity() -> Column:
    return F.array(*(F.lit(float(row == column)) for column in range(4) for row in range(4)))


def multiply(a: Column, b: Column) -> Column:
    return _kept([sum((_entry(a, row, k) * _entry(b, k, column) for k in range(1, 4)), _entry(a, row, 0) * _entry(b, 0, column)) for column in range(4) for row in range(4)])


def world(position: Vec, q: Sequence[Column]) -> Column:
    """From the frame that is turned by a quaternion and stands at ``position`` to the scene's."""
    x, y, z, w = q
    axes = [
        [1 - 2 * (y * y + z * z), 2 * (x * y + z * w), 2 * (x * z - y * w)],
        [2 * (x * y - z * w), 1 - 2 * (x * x + z * z), 2 * (y * z + x * w)],
        [2 * (x * z + y * w), 2 * (y * z - x * w), 1 - 2 * (x * x + y * y)],
        list(position),
    ]
    return _kept([e for n, axis in enumerate(axes) for e in (*axis, F.lit(float(n == 3)))])


def _det3(m: list[list[Column]]) -> Column:
    (a, b, c), (d, e, f), (g, h, i) = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def _named(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _adjugate(m: Column) -> Column:
    """The transposed cofactors, column by column, and the determinant."""
    rows = [[_entry(m, r, c) for c in range(4)] for r in range(4)]
    minor = lambda r, c: _det3([[e for j, e in enumerate(row) if j != c] for i, row in enumerate(rows) if i != r])
    cofactor = [[minor(r, c) * (-1) ** (r + c) for c in range(4)] for r in range(4)]
    det = sum((rows[0][c] * cofactor[0][c] for c in range(1, 4)), rows[0][0] * cofactor[0][0])
    return F.array(*(cofactor[column][row] for column in range(4) for row in range(4)), det)


def invert(m: Column) -> Column:
    """The inverse by cofactors; null where there is none."""
    det = lambda a: F.get(a, F.lit(16))
    divided = lambda a: F.when(det(a) != 0, F.transform(F.slice(a, 1, 16), lambda e: f32(e / det(a))))
    return _named(_named(m, _adjugate), divided)


def perspective(fov: Column, aspect: Column, near: Column, far: Column) -> Column:
    """The projection of a camera that looks along -z, ``fov`` upright in radians, depths from 0 to 1; ``far`` may be infinite."""
    scale, zero, open_ = 1 / F.tan(fov / 2), F.lit(0.0), F.abs(far) == float("inf")
    depth = F.when(open_, F.lit(-1.0)).otherwise(far / (near - far))
    shift = F.when(open_, -near).otherwise(far * near / (near - far))
    return _kept([scale / aspect, zero, zero, zero, zero, scale, zero, zero, zero, zero, depth, F.lit(-1.0), zero, zero, shift, zero])


def clip(m: Column, p: Vec) -> tuple[Column, Column, Column, Column]:
    """Where a matrix takes a point, with its fourth coordinate."""
    return tuple(_entry(m, row, 0) * p[0] + _entry(m, row, 1) * p[1] + _entry(m, row, 2) * p[2] + _entry(m, row, 3) for row in range(4))


def within(at: Sequence[Column]) -> Column:
    """Whether a clip coordinate lies in the view: sides, near and far inclusive."""
    x, y, z, w = at
    return (w > 0) & (F.abs(x) <= w) & (F.abs(y) <= w) & z.between(F.lit(0.0), w)
