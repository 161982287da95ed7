"""Queries on indexed meshes and on matrices, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import matrix as M
from ..functions.geometry import vec
from ..operators import mesh
from ..sources import scene
from . import oracle as O
from .queries import Room, _query

#: Corners of a unit box by number, and its faces by the numbers of their corners.
_CORNERS = [(n & 1, n >> 1 & 1, n >> 2) for n in range(8)]
_FACES = [[_CORNERS.index(tuple(int(x) for x in p)) for p in face] for face in scene.CORNERS]


def _boxes(r: Room) -> tuple[DataFrame, DataFrame]:
    """Every box as an indexed mesh of eight corners and twelve faces."""
    boxes = r.of(scene.boxes)
    corner = F.explode(F.array(*(F.struct(F.lit(n).cast("long").alias("vertex"), *(F.lit(float(c)).alias(f"u{a}") for c, a in zip(p, "xyz"))) for n, p in enumerate(_CORNERS)))).alias("u")
    face = F.explode(F.array(*(F.struct(F.lit(n).cast("long").alias("tri_id"), *(F.lit(v).cast("long").alias(f"v{a}") for v, a in zip(f, "abc"))) for n, f in enumerate(_FACES)))).alias("f")
    vertices = boxes.select("*", corner).select("scene", F.col("box").alias("mesh"), "u.vertex", *((F.col(f"{a}0") + F.col(f"u.u{a}") * F.col(f"s{a}")).alias(a) for a in "xyz"))
    return vertices, boxes.select("scene", F.col("box").alias("mesh"), face).select("scene", "mesh", "f.*")


_NTH = "row_number() OVER (PARTITION BY scene ORDER BY box) - 1"


@_query("s13_merged_mesh", O.sql(f"SELECT scene, nth * 12 + t AS tri_id, nth * 8 + a AS va, nth * 8 + b AS vb, nth * 8 + c AS vc FROM (SELECT scene, {_NTH} AS nth FROM boxes), (VALUES {', '.join(f'({t}, {a}, {b}, {c})' for t, (a, b, c) in enumerate(_FACES))}) AS f(t, a, b, c)", "boxes"))
def s13(s, d):
    """Faces of all boxes of a room as one mesh, their corners numbered anew."""
    return mesh.merged(*_boxes(Room(s, d)))[1]


_XYZ = ", ".join(f"tri.v{n}{a} AS {n}{a}" for n in "abc" for a in "xyz")


@_query("s1_soup", O.sql(f"SELECT tri.scene, nth * 12 + tri_id % 12 AS tri_id, {_XYZ} FROM tri JOIN (SELECT scene, box, {_NTH} AS nth FROM boxes) AS b ON b.scene = tri.scene AND b.box = tri_id // 12", "tri"))
def s1(s, d):
    """The merged mesh of each room as triangles with their coordinates."""
    return mesh.soup(*mesh.merged(*_boxes(Room(s, d))))


_AXES = [("1 - 2 * (qy * qy + qz * qz)", "2 * (qx * qy + qz * qw)", "2 * (qx * qz - qy * qw)"), ("2 * (qx * qy - qz * qw)", "1 - 2 * (qx * qx + qz * qz)", "2 * (qy * qz + qx * qw)"), ("2 * (qx * qz + qy * qw)", "2 * (qy * qz - qx * qw)", "1 - 2 * (qx * qx + qy * qy)"), ("px", "py", "pz")]
_ENTRIES = ", ".join(f"CAST(CAST({e} AS FLOAT) AS DOUBLE) AS m{4 * c + r}" for c, axis in enumerate(_AXES) for r, e in enumerate(axis))


@_query("x2_matrices", O.sql(f"SELECT scene, cam_idx, {_ENTRIES}, true AS upright FROM cams", "cams"))
def x2(s, d):
    """The matrix of every camera, and that its inverse undoes it."""
    rows = Room(s, d).of(scene.cameras).withColumn("m", M.world(vec("px", "py", "pz"), [F.col(f"q{a}") for a in "xyzw"])).withColumn("inverse", M.invert(F.col("m")))
    rows = rows.withColumn("both", M.multiply(F.col("inverse"), F.col("m"))).withColumn("one", M.identity())
    upright = F.forall(F.zip_with("both", "one", lambda a, b: F.abs(a - b)), lambda e: e < 1e-3)
    return rows.select("scene", "cam_idx", *(F.get("m", F.lit(4 * c + r)).alias(f"m{4 * c + r}") for c in range(4) for r in range(3)), upright.alias("upright"))
