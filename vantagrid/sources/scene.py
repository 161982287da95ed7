"""Scenes: from the driver's tables, and as JSON documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import Workspace
from .tables import table

#: Suppliers of one room are its cameras; 128 at most may share a scene.
RIG = 100
#: Parts of a room stand as boxes on its floor, so many to a row, this far apart.
ROW, PITCH = 50, 2.0
VOXEL, CHUNK, HEIGHT = 0.5, 10.0, 3.0
#: A task makes what stands in so many rooms, where there are enough of them.
TASK_ROOMS = 4


@dataclass(frozen=True)
class Layout:
    """Rooms of one size: as many as the suppliers fill with rigs, and as long as the parts need."""

    rooms: int
    rows: int

    @property
    def space(self) -> Workspace:
        return Workspace((0.0, 0.0, 0.0), (ROW * PITCH + 1, HEIGHT, self.rows * PITCH + 1), VOXEL, CHUNK)


def layout(spark: SparkSession, sf_dir: str) -> Layout:
    most = lambda name, key: (table(spark, sf_dir, name).agg(F.max(key)).first()[0] or 0) + 1
    rooms = -(-most("supplier", "s_suppkey") // RIG)
    return Layout(rooms, -(-(-(-most("part", "p_partkey") // rooms)) // ROW))


#: The two triangles of each face of a unit box, as corners of (x, y, z).
_FACES = [((0, 0, 0), (0, 0, 1), (0, 1, 1), (0, 1, 0)), ((1, 0, 0), (1, 1, 0), (1, 1, 1), (1, 0, 1)), ((0, 0, 0), (1, 0, 0), (1, 0, 1), (0, 0, 1)),
          ((0, 1, 0), (0, 1, 1), (1, 1, 1), (1, 1, 0)), ((0, 0, 0), (0, 1, 0), (1, 1, 0), (1, 0, 0)), ((0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1))]
CORNERS = [(f[0], f[1 + h], f[2 + h]) for f in _FACES for h in (0, 1)]

CAMERAS_SQL = """
SELECT CAST(s_suppkey // 100 AS BIGINT) AS scene, CAST(s_suppkey % 100 AS INT) AS cam_idx,
  CAST(5.63127 AS DOUBLE) + CAST(9.25043 AS DOUBLE) * (s_suppkey % 10) AS px, CAST(2.37183 AS DOUBLE) AS py, CAST(0.63291 AS DOUBLE) + CAST(0.203173 AS DOUBLE) * {rows} * (s_suppkey % 100 // 10) AS pz,
  CAST(CASE WHEN s_suppkey % 100 < 50 THEN 0.0 ELSE -0.17364817766693033 END AS DOUBLE) AS qx, CAST(CASE WHEN s_suppkey % 100 < 50 THEN 0.984807753012208 ELSE 0.0 END AS DOUBLE) AS qy,
  CAST(CASE WHEN s_suppkey % 100 < 50 THEN 0.17364817766693033 ELSE 0.0 END AS DOUBLE) AS qz, CAST(CASE WHEN s_suppkey % 100 < 50 THEN 0.0 ELSE 0.984807753012208 END AS DOUBLE) AS qw,
  CAST(60.0 AS DOUBLE) AS fov, CAST(1.5 AS DOUBLE) AS aspect, CAST(0.1 AS DOUBLE) AS near, CAST(8.0 AS DOUBLE) AS far, s_acctbal >= 0 AS enabled
FROM supplier
"""

#: A part in twenty is a large box with an inside.
BOXES_SQL = """
SELECT scene, box, CAST(0.5625 AS DOUBLE) + CAST(2.0 AS DOUBLE) * (b % 50) + CASE WHEN big THEN CAST(0 AS DOUBLE) ELSE CAST(0.125 AS DOUBLE) * (p_size % 5) END AS x0,
  CAST(0.0625 AS DOUBLE) AS y0, CAST(0.5625 AS DOUBLE) + CAST(2.0 AS DOUBLE) * (b // 50) + CASE WHEN big THEN CAST(0 AS DOUBLE) ELSE CAST(0.125 AS DOUBLE) * (box % 6) END AS z0,
  CASE WHEN big THEN CAST(1.75 AS DOUBLE) ELSE CAST(0.375 AS DOUBLE) + CAST(0.125 AS DOUBLE) * (p_size % 3) END AS sx,
  CASE WHEN big THEN CAST(1.75 AS DOUBLE) ELSE CAST(0.75 AS DOUBLE) + CAST(0.25 AS DOUBLE) * (box % 4) END AS sy, CASE WHEN big THEN CAST(1.75 AS DOUBLE) ELSE CAST(0.375 AS DOUBLE) END AS sz
FROM (SELECT CAST(p_partkey % {rooms} AS BIGINT) AS scene, CAST(p_partkey AS BIGINT) AS box, CAST(p_partkey // {rooms} AS BIGINT) AS b, p_partkey // {rooms} % 20 = 7 AS big, p_size FROM part) AS p
"""

POINTS_SQL = """
SELECT CAST(l_suppkey // 100 AS BIGINT) AS scene, CAST(l_orderkey AS BIGINT) * 8 + l_linenumber AS point,
  CAST(0.03371 AS DOUBLE) + ((l_partkey * 7 + l_linenumber * 131) % 3229) * CAST(0.03125 AS DOUBLE) AS x, CAST(0.04593 AS DOUBLE) + (l_orderkey % 89) * CAST(0.03125 AS DOUBLE) AS y,
  CAST(0.02517 AS DOUBLE) + (l_orderkey * 13 % (64 * {rows})) * CAST(0.03125 AS DOUBLE) AS z
FROM lineitem
"""

PROBES_SQL = """
SELECT CAST(event_id % {rooms} AS BIGINT) AS scene, CAST(event_id AS BIGINT) AS probe, (event_id * 53 % 6701) * CAST(0.015625 AS DOUBLE) - CAST(0.4765625 AS DOUBLE) AS qx,
  (event_id % 13) * CAST(0.265625 AS DOUBLE) + CAST(0.015625 AS DOUBLE) AS qy, (event_id * 29 % (128 * {rows} + 97)) * CAST(0.015625 AS DOUBLE) + CAST(0.0078125 AS DOUBLE) AS qz
FROM events
"""

#: Regions of every room, after the nations.
REGIONS_SQL = """
SELECT CAST(room AS BIGINT) AS scene, CAST(room * 25 + n_nationkey AS BIGINT) AS region, CAST(room * 5 + n_regionkey AS BIGINT) AS group_id,
  CAST(2.6875 AS DOUBLE) + CAST(3.9375 AS DOUBLE) * n_nationkey AS rx, CAST(1.0625 AS DOUBLE) AS ry, CAST(1.8125 AS DOUBLE) + CAST(0.40625 AS DOUBLE) * {rows} * (n_nationkey % 5) AS rz,
  CAST(2.6875 AS DOUBLE) AS hx, CAST(0.8125 AS DOUBLE) AS hy, CAST(1.5625 AS DOUBLE) AS hz, CAST(0 AS DOUBLE) AS rqx, CAST(CASE WHEN n_nationkey % 2 = 0 THEN 0 ELSE 0.25881904510252074 END AS DOUBLE) AS rqy,
  CAST(0 AS DOUBLE) AS rqz, CAST(CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0.9659258262890683 END AS DOUBLE) AS rqw
FROM nation, {each_room}
"""


def _sql(spark: SparkSession, sf_dir: str, name: str, text: str, of: Layout) -> DataFrame:
    """The same SQL that the oracle runs, over one table."""
    text = text.replace("{rooms}", str(of.rooms)).replace("{rows}", str(of.rows)).replace("{each_room}", f"(SELECT id AS room FROM range({of.rooms})) AS r")
    return spark.sql(text.replace("//", "div").replace(f"FROM {name}", "FROM {source}"), source=table(spark, sf_dir, name))


def _tasks(spark: SparkSession, of: Layout) -> int:
    return max(spark.sparkContext.defaultParallelism, of.rooms // TASK_ROOMS)


def cameras(spark: SparkSession, sf_dir: str, of: Layout) -> DataFrame:
    """Dealt to many tasks, as what lies in the frustum of each is made from it."""
    return _sql(spark, sf_dir, "supplier", CAMERAS_SQL, of).repartition(_tasks(spark, of), "scene", "cam_idx")


def points(spark: SparkSession, sf_dir: str, of: Layout) -> DataFrame:
    return _sql(spark, sf_dir, "lineitem", POINTS_SQL, of)


def probes(spark: SparkSession, sf_dir: str, of: Layout) -> DataFrame:
    return _sql(spark, sf_dir, "events", PROBES_SQL, of)


def regions(spark: SparkSession, sf_dir: str, of: Layout) -> DataFrame:
    return _sql(spark, sf_dir, "nation", REGIONS_SQL, of)


def boxes(spark: SparkSession, sf_dir: str, of: Layout) -> DataFrame:
    """Dealt to many tasks: a file of parts is small, but what is made of each box is not."""
    return _sql(spark, sf_dir, "part", BOXES_SQL, of).repartition(_tasks(spark, of), "box")


def triangles(spark: SparkSession, sf_dir: str, of: Layout) -> DataFrame:
    return box_triangles(boxes(spark, sf_dir, of))


def room_boxes(rooms: DataFrame, thickness: float) -> DataFrame:
    """Floor and four walls of open rooms (scene, half_x, half_z, height), as boxes below and around them."""
    x, z, h, t = F.col("half_x"), F.col("half_z"), F.col("height"), F.lit(thickness)
    parts = [(-x - t, -t, -z - t, 2 * (x + t), t, 2 * (z + t)), (-x - t, 0 * h, -z - t, t, h, 2 * (z + t)), (x, 0 * h, -z - t, t, h, 2 * (z + t)), (-x, 0 * h, -z - t, 2 * x, h, t), (-x, 0 * h, z, 2 * x, h, t)]
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("n"), *(F.lit(c).cast("double").alias(name) if isinstance(c, int) else c.cast("double").alias(name) for c, name in zip(p, ("x0", "y0", "z0", "sx", "sy", "sz")))) for n, p in enumerate(parts))))
    return rooms.select("scene", each.alias("b")).select("scene", (F.col("scene") * 5 + F.col("b.n")).alias("box"), "b.x0", "b.y0", "b.z0", "b.sx", "b.sy", "b.sz")


def box_triangles(boxes: DataFrame) -> DataFrame:
    """The twelve triangles of every axis-parallel box (scene, box, x0, y0, z0, sx, sy, sz)."""
    # The corners are one constant and a triangle is worked out behind the explode, so its code is written once and short enough to be compiled.
    unit = F.array(*(F.struct(F.lit(t).alias("t"), *(F.lit(float(c)).alias(f"{n}{a}") for n, p in zip("abc", corners) for a, c in zip("xyz", p))) for t, corners in enumerate(CORNERS)))
    rows = boxes.select("scene", "box", *(f"{a}0" for a in "xyz"), *(f"s{a}" for a in "xyz"), F.explode(unit).alias("tri"))
    corner = lambda n, a: (F.col(f"{a}0") + F.col(f"tri.{n}{a}") * F.col(f"s{a}")).alias(f"{n}{a}")
    return rows.select("scene", (F.col("box") * len(CORNERS) + F.col("tri.t")).alias("tri_id"), *(corner(n, a) for n in "abc" for a in "xyz"))


DOCUMENT = "version int, name string, cameras array<struct<id: string, name: string, position: array<double>, rotation: array<double>, fov: double, aspect: double, near: double, far: double, enabled: boolean>>, zones array<struct<id: string, name: string, enabled: boolean>>, volumes array<struct<id: string, zoneId: string, center: array<double>, size: array<double>, rotation: array<double>, enabled: boolean>>"


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """Scene documents, one row for each file; unknown fields are left out, broken files raise."""
    return spark.read.schema(DOCUMENT).option("multiLine", True).option("mode", "FAILFAST").json(path)


def document_cameras(document: DataFrame) -> DataFrame:
    """One row for each camera of a document, in its order."""
    rows = document.select(F.posexplode("cameras").alias("cam_idx", "c"))
    xyz = lambda field, names: [F.get(F.col(f"c.{field}"), i).alias(n) for i, n in enumerate(names)]
    return rows.select("cam_idx", "c.id", *xyz("position", ("px", "py", "pz")), *xyz("rotation", ("qx", "qy", "qz", "qw")), "c.fov", "c.aspect", "c.near", "c.far", F.coalesce("c.enabled", F.lit(True)).alias("enabled"))


def document_volumes(document: DataFrame) -> DataFrame:
    """One row for each volume, as a region of its zone; a volume without a zone or rotation gets none and the identity."""
    rows = document.select(F.posexplode("volumes").alias("region", "v"))
    part = lambda f, i, d: F.coalesce(F.get(F.col(f"v.{f}"), i), F.lit(d))
    return rows.select("region", F.col("v.zoneId").alias("zone_id"), *(part("center", i, 0.0).alias(f"r{a}") for i, a in enumerate("xyz")), *((part("size", i, 0.0) / 2).alias(f"h{a}") for i, a in enumerate("xyz")), *(part("rotation", i, d).alias(f"rq{a}") for i, (a, d) in enumerate((("x", 0.0), ("y", 0.0), ("z", 0.0), ("w", 1.0)))), F.coalesce("v.enabled", F.lit(True)).alias("enabled"))


def write_document(cameras: DataFrame, path: str, name: str) -> None:
    """A scene document with these cameras, as one JSON file (128 cameras at most)."""
    camera = F.struct("id", F.array("px", "py", "pz").alias("position"), F.array("qx", "qy", "qz", "qw").alias("rotation"), "fov", "aspect", "near", "far", "enabled")
    rows = cameras.groupBy().agg(F.sort_array(F.collect_list(F.struct("cam_idx", camera.alias("c")))).alias("all"))
    rows.select(F.lit(4).alias("version"), F.lit(name).alias("name"), F.transform("all", lambda x: x["c"]).alias("cameras")).coalesce(1).write.mode("overwrite").json(path)
