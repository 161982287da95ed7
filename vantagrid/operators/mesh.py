"""Triangle soups: scanning, cleaning, moving and measuring them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import add, cross, length, rotate, sub, vec

CORNER_NAMES = [f"{n}{a}" for n in "abc" for a in "xyz"]
LEAST_AREA = 1e-10


def soup(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """scene, tri_id and the nine coordinates of each face (scene, tri_id, va, vb, vc), from vertices (scene, vertex, x, y, z)."""
    rows = faces
    for n in "abc":
        corner = vertices.select(F.col("scene"), F.col("vertex").alias(f"v{n}"), *(F.col(c).alias(f"{n}{c}") for c in "xyz"))
        rows = rows.join(corner.hint("merge"), ["scene", f"v{n}"])
    return rows.select("scene", "tri_id", *CORNER_NAMES)


def merged(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The meshes of each scene as one, in the order of ``mesh``: vertices (scene, vertex, x, y, z) and faces (scene, tri_id, va, vb, vc).

    ``vertices`` (scene, mesh, vertex, x, y, z) and ``faces`` (scene, mesh, tri_id, va, vb, vc) are numbered from 0 without gaps in each mesh.  Only counts go through a
    window; a mesh without vertices or faces moves nothing.  Joins are by shuffle: sizes of what ``explode`` makes are estimated far too small.
    """
    counts = vertices.groupBy("scene", "mesh").agg(F.count("*").alias("_v"), F.lit(0).cast("long").alias("_f"))
    counts = counts.unionByName(faces.groupBy("scene", "mesh").agg(F.lit(0).cast("long").alias("_v"), F.count("*").alias("_f"))).groupBy("scene", "mesh").agg(F.sum("_v").alias("_v"), F.sum("_f").alias("_f"))
    before = Window.partitionBy("scene").orderBy("mesh").rowsBetween(Window.unboundedPreceding, -1)
    moved = counts.select("scene", "mesh", *(F.coalesce(F.sum(c).over(before), F.lit(0).cast("long")).alias(c) for c in ("_v", "_f")))
    moved = moved.hint("shuffle_hash")
    corners = vertices.join(moved, ["scene", "mesh"]).select("scene", (F.col("vertex") + F.col("_v")).alias("vertex"), "x", "y", "z")
    rebased = [(F.col(c) + F.col(by)).alias(c) for c, by in (("tri_id", "_f"), ("va", "_v"), ("vb", "_v"), ("vc", "_v"))]
    return corners, faces.join(moved, ["scene", "mesh"]).select("scene", *rebased)


def clean(triangles: DataFrame) -> DataFrame:
    """Without triangles that have a coordinate that isn't finite, or next to no area."""
    finite = F.lit(True)
    for c in CORNER_NAMES:
        finite = finite & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    a, b, c = (vec(*(f"{n}{x}" for x in "xyz")) for n in "abc")
    return triangles.where(finite & (0.5 * length(cross(sub(b, a), sub(c, a))) >= LEAST_AREA))


def placed(triangles: DataFrame, position: tuple[Column, ...], turn: tuple[Column, ...], scale: tuple[Column, ...]) -> DataFrame:
    """Corners scaled along each axis, turned by the quaternion and moved, kept in single precision."""
    moved = {}
    for n in "abc":
        corner = add(rotate(turn, tuple(F.col(f"{n}{x}") * k for x, k in zip("xyz", scale))), position)
        moved |= {f"{n}{x}": c.cast("float").cast("double") for x, c in zip("xyz", corner)}
    return triangles.withColumns(moved)


def bounds(triangles: DataFrame, margin: float = 0.5) -> DataFrame:
    """scene and the corners of its extent, widened on all sides."""
    ends = []
    for x in "xyz":
        names = [f"{n}{x}" for n in "abc"]
        ends += [(F.min(F.least(*names)) - margin).alias(f"min_{x}"), (F.max(F.greatest(*names)) + margin).alias(f"max_{x}")]
    return triangles.groupBy("scene").agg(*ends)
