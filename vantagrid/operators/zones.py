"""Zones and volumes from geometry: triangles are split level by level, where the split is cheapest by surface area.

Each level is a few aggregations over all triangles of all scenes at once; a node never lies in one task but for its
few slices. Nodes are numbered from 1 as in a heap: node n has the parts 2 n and 2 n + 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import checkpointed

#: Nodes of so many triangles aren't split; centroids fall into so many slices along the longest side.
LEAF, SLICES = 8, 16
LEAST_SIDE, LEAST_EDGE = 1e-12, 0.05
#: A node that must be cut in halves is ranked within so many finer slices.
FINE = 1024
MOST_LEVEL = 8

_AXES = "xyz"


def _area(low: list[Column], high: list[Column]) -> Column:
    x, y, z = (F.greatest(h - l, F.lit(0.0)) for l, h in zip(low, high))  # noqa: E741
    return 2 * (x * y + y * z + z * x)


def _boxes(prefix: str = "") -> list[Column]:
    return [F.min(f"low_{a}").alias(f"{prefix}low_{a}") for a in _AXES] + [F.max(f"high_{a}").alias(f"{prefix}high_{a}") for a in _AXES]


def _measured(triangles: DataFrame) -> DataFrame:
    """scene, tri_id, extent and centroid in single precision, and the node, at first the root."""
    f32 = lambda c: c.cast("float").cast("double")
    ends = {}
    for a in _AXES:
        corners = [f32(F.col(f"{n}{a}")) for n in "abc"]
        ends |= {f"low_{a}": F.least(*corners), f"high_{a}": F.greatest(*corners)}
    rows = triangles.select("scene", "tri_id", *(c.alias(n) for n, c in ends.items()))
    return rows.withColumns({f"mid_{a}": f32((F.col(f"low_{a}") + F.col(f"high_{a}")) * 0.5) for a in _AXES} | {"node": F.lit(1).cast("long")})


def _splits(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where the nodes are cut (scene, node, axis, start, step, cut; a null cut: in halves), and the rows with their ``slice``."""
    sides = [F.max(f"mid_{a}") - F.min(f"mid_{a}") for a in _AXES]
    nodes = rows.groupBy("scene", "node").agg(F.count("*").alias("n"), *_boxes("all_"), *(s.alias(f"side_{a}") for s, a in zip(sides, _AXES)), *(F.min(f"mid_{a}").alias(f"from_{a}") for a in _AXES))
    longest = F.greatest(*(f"side_{a}" for a in _AXES))
    axis = F.when(F.col("side_x") == longest, "x").when(F.col("side_y") == longest, "y").otherwise("z")
    nodes = nodes.where((F.col("n") > LEAF) & (longest >= LEAST_SIDE)).withColumns({"axis": axis, "side": longest, "start": F.when(axis == "x", F.col("from_x")).when(axis == "y", F.col("from_y")).otherwise(F.col("from_z"))})
    nodes = nodes.withColumn("whole", F.col("n") * _area([F.col(f"all_low_{a}") for a in _AXES], [F.col(f"all_high_{a}") for a in _AXES]))
    nodes = nodes.select("scene", "node", "axis", "start", "n", "whole", (SLICES * (1 - 1e-6) / F.col("side")).alias("step"))
    placed = rows.join(nodes.drop("n", "whole"), ["scene", "node"]).withColumn("along", F.when(F.col("axis") == "x", F.col("mid_x")).when(F.col("axis") == "y", F.col("mid_y")).otherwise(F.col("mid_z")) - F.col("start"))
    placed = placed.withColumn("slice", F.least(F.greatest((F.col("along") * F.col("step")).cast("int"), F.lit(0)), F.lit(SLICES - 1)))
    slices = placed.groupBy("scene", "node", "slice").agg(F.count("*").alias("n"), *_boxes())
    own = Window.partitionBy("scene", "node").orderBy("slice")
    before, after = own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(0, Window.unboundedFollowing)
    sums = {}
    for name, w in (("left", before), ("right", after)):
        low, high = [F.min(f"low_{a}").over(w) for a in _AXES], [F.max(f"high_{a}").over(w) for a in _AXES]
        area = _area(low, high)
        sums[name] = F.sum("n").over(w) * (area.cast("float").cast("double") if name == "left" else area)
    costs = slices.select("scene", "node", "slice", (sums["left"] + sums["right"]).alias("cost")).where("cost IS NOT NULL")
    best = costs.groupBy("scene", "node").agg(F.min(F.struct("cost", (-F.col("slice")).alias("back"))).alias("b"))
    cuts = nodes.join(best, ["scene", "node"], "left").withColumn("cut", F.when(F.col("b.cost") < F.col("whole"), -F.col("b.back")))
    return cuts.select("scene", "node", "n", "cut"), placed.select("scene", "node", "tri_id", "along", "step", "slice")


def _right_half(placed: DataFrame, halved: DataFrame) -> DataFrame:
    """Triangles (scene, node, tri_id, ``right``) of the nodes that are cut in halves along their longest side."""
    at = F.floor(F.col("along") * F.col("step") * (FINE / SLICES))
    rows = placed.join(halved.select("scene", "node", "n"), ["scene", "node"]).withColumn("fine", at)
    counts = rows.groupBy("scene", "node", "fine").agg(F.count("*").alias("here"))
    earlier = F.coalesce(F.sum("here").over(Window.partitionBy("scene", "node").orderBy("fine").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("scene", "node", "fine", earlier.alias("earlier"))
    rank = F.row_number().over(Window.partitionBy("scene", "node", "fine").orderBy("along", "tri_id")) + F.col("earlier")
    return rows.join(counts, ["scene", "node", "fine"]).select("scene", "node", "tri_id", (rank > F.floor(F.col("n") / 2)).alias("right"))


def _level(rows: DataFrame) -> DataFrame:
    cuts, placed = _splits(rows)
    cuts = checkpointed(cuts)
    by_area = placed.join(cuts.where("cut IS NOT NULL").select("scene", "node", "cut"), ["scene", "node"]).select("scene", "node", "tri_id", (F.col("slice") >= F.col("cut")).alias("right"))
    sides = by_area.unionByName(_right_half(placed, cuts.where("cut IS NULL")))
    moved = rows.join(sides, ["scene", "node", "tri_id"], "left")
    return moved.withColumn("node", F.coalesce(F.col("node") * 2 + F.col("right").cast("long"), F.col("node"))).select(*rows.columns)


def _depth(node: Column) -> Column:
    return F.length(F.bin(node)) - 1


def _numbered(nodes: DataFrame, kind: str) -> DataFrame:
    """``kind-N`` for the nodes of each scene, left parts first."""
    key = F.col("node") * F.pow(F.lit(2), MOST_LEVEL - _depth(F.col("node"))).cast("long")
    number = F.row_number().over(Window.partitionBy("scene").orderBy(key))
    return nodes.withColumn("id", F.concat(F.lit(f"{kind}-"), number.cast("string")))


def generate(triangles: DataFrame, zone_level: int, box_level: int, voxel: float) -> tuple[DataFrame, DataFrame]:
    """Zones (scene, node, id, name, enabled) and volumes (scene, id, zone_id, centre and edges) from triangles.

    Nodes of ``zone_level``, or that end above it, are zones; what they split into down to ``box_level`` are their
    volumes, with edges of one voxel at least. Scenes without triangles have neither. Among equal centroids of a
    node that is cut in halves, the smaller tri_id goes left.
    """
    if not 0 <= zone_level <= 6 or not 0 <= box_level <= MOST_LEVEL:
        raise ValueError("zone_level must be 0 to 6, box_level 0 to 8")
    rows = checkpointed(_measured(triangles))
    for _ in range(max(zone_level, box_level)):
        rows = checkpointed(_level(rows))
    boxes = rows.groupBy("scene", "node").agg(*_boxes())
    zone = F.when(_depth(F.col("node")) > zone_level, F.floor(F.col("node") / F.pow(F.lit(2), _depth(F.col("node")) - zone_level))).otherwise(F.col("node")).cast("long")
    boxes = boxes.withColumn("zone", zone)
    zones = _numbered(boxes.select("scene", F.col("zone").alias("node")).distinct(), "zone")
    named = zones.select("scene", F.col("node").alias("zone"), F.col("id").alias("zone_id"))
    least = F.lit(max(voxel, LEAST_EDGE))
    middle = [((F.col(f"low_{a}") + F.col(f"high_{a}")) / 2).alias(f"r{a}") for a in _AXES]
    edges = [F.greatest(least, F.col(f"high_{a}") - F.col(f"low_{a}")).alias(f"size_{a}") for a in _AXES]
    volumes = _numbered(boxes, "volume").join(named, ["scene", "zone"]).select("scene", "id", "zone_id", *middle, *edges)
    return zones.withColumns({"name": F.concat(F.lit("Zone "), F.substring("id", 6, 20)), "enabled": F.lit(True)}), volumes
