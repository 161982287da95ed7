"""The triangles of scene documents from their geometry records, and what a folder of documents holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mesh
from .assets import decode_meshes
from .runs import Folder, Steps, fingerprint
from .scene import box_triangles, room_boxes
from .scene_files import Documents
from .tables import checkpointed

#: Triangles of one object are numbered within so many.
OBJECT = 1 << 32
#: Around a scene whose enabled objects give no triangle.
FALLBACK = ((-10.0, 0.0, -10.0), (10.0, 5.0, 10.0))
_LOCAL = ["key", "nth", *mesh.CORNER_NAMES]


def local_meshes(spark: SparkSession, folder: str, sources: list[str]) -> DataFrame:
    """src, tri_id, corners and problem of mesh files, decoded once for as long as the files stay as they are; a missing file is a problem of its own."""
    at = {src: Folder(spark, f"{folder}/{src}") for src in sources}
    there = {src: f for src, f in at.items() if f.has()}
    missing = spark.createDataFrame([(src, "not found") for src in sources if src not in there], "src string, problem string")

    def decoded() -> DataFrame:
        names = spark.createDataFrame([(f.fs.makeQualified(f._of()).toString(), src) for src, f in there.items()], "path string, src string")
        files = spark.read.format("binaryFile").load([f.path for f in there.values()])
        plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
        return decode_meshes(files).withColumn("path", plain("path")).join(names.withColumn("path", plain("path")), "path").drop("path")

    if not there:
        return missing
    found = Steps(spark).get(fingerprint("meshes", *(f"{s}:{f.revision()}" for s, f in sorted(there.items()))), decoded)
    return found.unionByName(missing, allowMissingColumns=True)


def assemble(geometry: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(scene, tri_id, corners) of all enabled objects, and (scene, id, problem) of meshes that can't be read, whose scenes have no triangles at all.

    ``geometry`` are checked records (see ``documents.check_geometry``).  Disabled objects cost nothing: their files aren't even read.  The names of the
    enabled files go through the driver, their contents don't; an object that is only moved is placed again from triangles that are kept.
    """
    spark = geometry.sparkSession
    rows = checkpointed(geometry.where("enabled").withColumn("key", F.monotonically_increasing_id()))
    boxes = rows.where("kind = 'box'").select(F.col("key").alias("scene"), F.col("key").alias("box"), *(F.get("low", i).alias(f"{a}0") for i, a in enumerate("xyz")), *((F.get("high", i) - F.get("low", i)).alias(f"s{a}") for i, a in enumerate("xyz")))
    rooms = rows.where("kind = 'room'").select(F.col("key").alias("scene"), "half_x", "half_z", "height", "thickness")
    made = [box_triangles(b).select(F.col("scene").alias("key"), (F.col("tri_id") % n).alias("nth"), *mesh.CORNER_NAMES) for b, n in ((boxes, 12), (room_boxes(rooms, F.col("thickness")), 60))]
    meshes = rows.where("kind = 'mesh'").select("key", "src")
    sources = sorted(r["src"] for r in meshes.select("src").distinct().collect())
    problems = spark.createDataFrame([], "scene long, id string, problem string")
    if sources:
        found = meshes.join(local_meshes(spark, folder, sources), "src")
        if "tri_id" in found.columns:
            made.append(found.where("problem IS NULL").select("key", F.col("tri_id").cast("long").alias("nth"), *mesh.CORNER_NAMES))
        problems = found.where("problem IS NOT NULL").select("key", "problem").distinct().join(rows.select("key", "scene", "id"), "key").select("scene", "id", "problem")
    local = reduce(DataFrame.unionByName, (m.select(*_LOCAL) for m in made))
    where = rows.select("key", "scene", "pos", "position", "rotation", "scale").join(problems.select("scene").distinct(), "scene", "left_anti")
    three = lambda c, n=3: tuple(F.get(c, i) for i in range(n))
    placed = mesh.placed(local.join(where, "key"), three("position"), three("rotation", 4), three("scale"))
    return placed.select("scene", (F.col("pos") * F.lit(OBJECT) + F.col("nth")).alias("tri_id"), *mesh.CORNER_NAMES), problems


def extents(scenes: DataFrame, triangles: DataFrame, margin: float = 0.5) -> DataFrame:
    """The bounds of every scene (see ``mesh.bounds``); one without triangles has ``FALLBACK``."""
    rows = scenes.select("scene").distinct().join(mesh.bounds(triangles, margin), "scene", "left")
    ends = {f"{end}_{a}": F.coalesce(f"{end}_{a}", F.lit(FALLBACK[n][i])) for n, end in enumerate(("min", "max")) for i, a in enumerate("xyz")}
    return rows.withColumns(ends)


def catalogue(read: Documents) -> DataFrame:
    """Every document with the reason against it, or with how many objects, cameras and zones it has; a broken one is listed like any other."""
    out = read.problems()
    for section in ("geometry", "cameras", "zones"):
        out = out.join(read.records(section).groupBy("scene").agg(F.count("*").alias(section)), "scene", "left")
    counts = {s: F.when(F.col("problem").isNull(), F.coalesce(s, F.lit(0))) for s in ("geometry", "cameras", "zones")}
    return out.withColumns(counts)


def copy_plan(read: Documents) -> DataFrame:
    """scene and src of every file that a copy of a document must take along, once, enabled or not."""
    meshes = read.records("geometry").where("kind = 'mesh'").select("scene", "src")
    return meshes.union(read.records("splats").select("scene", "src")).distinct()
