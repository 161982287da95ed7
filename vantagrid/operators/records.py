"""Records of scene documents: what is wrong with them, what they default to, and choices among them.

Every relation carries the ``scene`` it belongs to; a problem is a column with the reason, null for a good record.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.display import file_stem
from ..functions.geometry import add, ball_point, in_box, length, sub, vec

KINDS = ("point", "polyline", "plane")
ORIENTATIONS = ("horizontal", "vertical-x", "vertical-z")
SUMMARIES = ("mean", "max", "min", "blind")
#: World axes of a section: the one that collapses, and those that it spans.
AXES = {"horizontal": (1, 0, 2), "vertical-x": (0, 2, 1), "vertical-z": (2, 0, 1)}
LEAST_CLIP, CLIP = 0.1, 2.0
DRAWS = 256
#: A draw takes bases 2 and 3 for its place on the constraint, and these for the way off it.
BALL_BASES = (5, 7, 11)


def finite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def _numbers(array: Column, n: int) -> Column:
    return F.coalesce(F.size(array) == n, F.lit(False)) & F.forall(array, lambda x: finite(x))


def _first_reason(*checks: tuple[Column, str]) -> Column:
    """The reason of the first check that doesn't hold; a check that is null doesn't."""
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(reason)) for ok, reason in checks))


def unique_ids(rows: DataFrame, kind: str, order: str = "pos") -> DataFrame:
    """``problem`` of every record whose id an earlier one of its scene has, where it has none yet."""
    again = F.row_number().over(Window.partitionBy("scene", "id").orderBy(order)) > 1
    return rows.withColumn("problem", F.coalesce("problem", F.when(again & F.col("id").isNotNull(), F.concat(F.lit(f"duplicate {kind} id "), F.col("id")))))


def check_cameras(rows: DataFrame) -> DataFrame:
    """Cameras (scene, pos, id, position, rotation, fov, aspect, near, far, enabled) with defaults and ``problem``."""
    optional = [(F.col(c).isNull() | finite(F.col(c)), f"{c} must be a number") for c in ("aspect", "near", "far")]
    needed = F.col("id").isNotNull() & _numbers(F.col("position"), 3) & _numbers(F.col("rotation"), 4) & finite(F.col("fov"))
    rows = rows.withColumn("problem", _first_reason((needed, "requires id, position, rotation, fov"), *optional))
    return unique_ids(rows.withColumn("enabled", F.coalesce("enabled", F.lit(True))), "camera")


def check_sections(rows: DataFrame) -> DataFrame:
    """Sections (scene, pos, id, orientation, min, max, aggregation, enabled, visible, clip_range) with ``problem``."""
    enabled = F.coalesce("enabled", "visible")
    known = F.col("orientation").isin(*ORIENTATIONS) & F.col("aggregation").isin(*SUMMARIES)
    needed = F.col("id").isNotNull() & known & finite(F.col("min")) & finite(F.col("max")) & enabled.isNotNull()
    clip = F.when(finite(F.col("clip_range")), F.greatest(F.col("clip_range"), F.lit(LEAST_CLIP))).otherwise(F.lit(CLIP))
    rows = rows.withColumn("problem", _first_reason((needed, "requires id, orientation, min, max, aggregation, enabled")))
    return unique_ids(rows.withColumns({"enabled": enabled, "clip_range": clip}).drop("visible"), "section")


def resolve_footprints(sections: DataFrame, extents: DataFrame) -> DataFrame:
    """In-plane bounds (min_a, max_a, min_b, max_b); a pair that isn't wholly given takes the scene's extent."""
    rows = sections.join(extents, "scene")
    for n, name in ((1, "a"), (2, "b")):
        given = finite(F.col(f"min_{name}")) & finite(F.col(f"max_{name}"))
        for end in ("min", "max"):
            axis = F.get(F.array(*(F.col(f"{end}_{x}") for x in ("wx", "wy", "wz"))), _axis(n))
            rows = rows.withColumn(f"_{end}_{name}", F.when(given, F.col(f"{end}_{name}")).otherwise(axis))
    found = {f"{end}_{name}": F.col(f"_{end}_{name}") for name in "ab" for end in ("min", "max")}
    return rows.withColumns(found).select(*sections.columns)


def _axis(n: int) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for o, axes in AXES.items() for x in (o, axes[n]))), F.col("orientation"))


def index_range(low: Column, high: Column, origin: Column, voxel: Column, dim: Column) -> tuple[Column, Column]:
    """First and last voxel of a stretch of metres, held inside of the grid; at least one voxel."""
    held = lambda c: F.least(F.greatest(c.cast("long"), F.lit(0)), dim - 1)
    start = held(F.floor((low - origin) / voxel))
    return start, F.greatest(start, held(F.ceil((high - origin) / voxel) - 1))


def check_groups(rows: DataFrame, zones: DataFrame) -> DataFrame:
    """Groups (scene, pos, id, zone_ids, fov, far, pool_size, max_count, trials, epsilon, seed) with ``problem``.

    ``zone_ids`` keep their order and lose repeats and zones (scene, zone_id) that the scene doesn't have.
    """
    live = zones.groupBy("scene").agg(F.collect_set("zone_id").alias("_live"))  # 31 zones to a scene
    whole = lambda c: finite(F.col(c)) & (F.col(c) == F.floor(F.col(c)))
    counts = [(whole(c) & (F.col(c) >= 1), f"{c} must be an integer of 1 or more") for c in ("pool_size", "max_count", "trials")]
    numbers = [(finite(F.col(c)), f"{c} must be a number") for c in ("fov", "far", "pool_size", "max_count", "trials", "epsilon", "seed")]
    rest = [((F.col("fov") > 0) & (F.col("fov") < 180), "fov must be in (0, 180)"), (F.col("far") > 0, "far must be > 0"), *counts, (F.col("epsilon") >= 0, "epsilon must be 0 or more"), (whole("seed"), "seed must be an integer")]
    reason = _first_reason((F.col("id").isNotNull(), "requires a string id"), *numbers, *rest)
    kept = F.array_intersect(F.array_distinct(F.coalesce("zone_ids", F.array().cast("array<string>"))), F.coalesce("_live", F.array().cast("array<string>")))
    return unique_ids(rows.join(live, "scene", "left").withColumns({"zone_ids": kept, "problem": reason}).drop("_live"), "constraint group")


def check_constraints(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Constraints (scene, pos, id, group_id, kind, distance, position, points, rotation, size) with ``problem``."""
    known = groups.select("scene", F.col("id").alias("group_id"), F.lit(True).alias("_known")).distinct()
    kind, points = F.col("kind"), F.col("points")
    shape = F.when(kind == "point", _numbers(F.col("position"), 3))
    shape = shape.when(kind == "polyline", (F.size(points) >= 2) & F.forall(points, lambda p: _numbers(p, 3)))
    shape = shape.when(kind == "plane", _numbers(F.col("position"), 3) & _numbers(F.col("rotation"), 4) & _numbers(F.col("size"), 2) & F.forall("size", lambda x: x > 0))
    reason = _first_reason((F.col("id").isNotNull() & F.col("group_id").isNotNull(), "requires id and group_id"), (F.col("_known"), "group_id references no constraint group"), (kind.isin(*KINDS), "kind must be one of point, polyline, plane"), (finite(F.col("distance")) & (F.col("distance") >= 0), "distance must be a number of 0 or more"), (shape, "geometry doesn't fit the kind"))
    return unique_ids(rows.join(known, ["scene", "group_id"], "left").withColumn("problem", reason).drop("_known"), "constraint")


def within_cap(rows: DataFrame, cap: int, order: str) -> DataFrame:
    """The first ``cap`` records of each scene, and how many were ``dropped`` behind them."""
    own = Window.partitionBy("scene")
    ranked = rows.withColumn("_n", F.row_number().over(own.orderBy(order))).withColumn("dropped", F.greatest(F.count("*").over(own) - cap, F.lit(0)))
    return ranked.where(F.col("_n") <= cap).drop("_n")


def next_ids(rows: DataFrame, prefix: str) -> DataFrame:
    """The next id of each scene: one more than the largest number behind the prefix."""
    number = F.nullif(F.regexp_extract("id", f"^{prefix}-([0-9]+)$", 1), F.lit("")).cast("long")
    return rows.groupBy("scene").agg(F.concat(F.lit(f"{prefix}-"), (F.coalesce(F.max(number), F.lit(0)) + 1).cast("string")).alias("next_id"))


def nearest(rows: DataFrame, by: Sequence[str], distance: str, order: str, *keep: str) -> DataFrame:
    """The nearest candidate, the earliest one at equal distance."""
    best = F.min(F.struct(distance, order, *keep)).alias("best")
    return rows.groupBy(*by).agg(best).select(*by, *(f"best.{c}" for c in (distance, order, *keep)))


def best_samples(rows: DataFrame, by: Sequence[str], count: str, order: str) -> DataFrame:
    """The sample that sees most, the earliest of equals; none where no sample sees anything."""
    best = F.max(F.struct(F.col(count), (-F.col(order)).alias("early"))).alias("best")
    return rows.where(F.col(count) > 0).groupBy(*by).agg(best).select(*by, F.col(f"best.{count}").alias(count), (-F.col("best.early")).alias(order))


def zone_key(zone_ids: Column) -> Column:
    """The same text for the same set of zones, in whatever order."""
    return F.array_join(F.array_sort(F.array_distinct(zone_ids)), "|")


def file_names(rows: DataFrame, extension: str) -> DataFrame:
    """File names of the cameras (scene, pos, id, label; 128 to a scene): letter case doesn't tell names apart, repeats are numbered."""
    stem = F.coalesce(F.nullif(file_stem(F.col("label")), F.lit("")), F.nullif(file_stem(F.col("id")), F.lit("")), F.lit("camera"))
    scenes = rows.withColumn("stem", stem).groupBy("scene").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "stem"))).alias("all"))

    def name(used: Column, stem: Column) -> Column:
        tries = F.transform(F.sequence(F.lit(1), F.size(used) + 1), lambda n: F.concat(stem, F.when(n == 1, F.lit("")).otherwise(F.concat(F.lit("-"), n.cast("string"))), F.lit(f".{extension}")))
        return F.get(F.filter(tries, lambda t: ~F.exists(used, lambda u: F.lower(u) == F.lower(t))), 0)

    taken = F.aggregate("all", F.array().cast("array<string>"), lambda used, x: F.concat(used, F.array(name(used, x["stem"]))))
    each = F.posexplode(F.arrays_zip("all", taken.alias("file"))).alias("_n", "x")
    return scenes.select("scene", each).select("scene", "x.all.pos", "x.all.id", "x.file")


def mount_overlap(constraints: DataFrame, volumes: DataFrame) -> DataFrame:
    """The share of ``DRAWS`` positions around each point constraint (scene, id, px, py, pz, distance, start) that lie in a volume of its scene."""
    keys, boxes = ["scene", "id"], volumes.select("scene", *(f"{k}{a}" for k in ("r", "h", "rq") for a in "xyz"), "rqw")
    turn = [F.col(f"rq{a}") for a in "xyzw"]
    # Mounts meet volumes before they are drawn around: most of a scene's volumes lie further away than any draw.
    far = F.abs("distance") + length(vec("hx", "hy", "hz"))
    apart = length(sub(vec("px", "py", "pz"), vec("rx", "ry", "rz")))
    slack = 1e-5 * (1 + far + length(vec("px", "py", "pz")) + length(vec("rx", "ry", "rz")))  # centres and sides count in single precision
    unit = F.abs(sum((q * q for q in turn[1:]), turn[0] * turn[0]) - 1) < 1e-6
    pairs = constraints.select(*keys, "px", "py", "pz", "distance", "start").join(boxes.hint("shuffle_hash"), "scene").where((apart <= far + slack) | ~unit)
    # Offsets hang on the start alone.
    starts = constraints.select("start").distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1))))
    offsets = starts.select("start", "draw", F.array(*ball_point(F.col("start") + F.col("draw"), 1.0, BALL_BASES)).alias("_off"))
    at = add(vec("px", "py", "pz"), tuple(F.col("distance") * F.get("_off", i) for i in range(3)))
    drawn = pairs.join(offsets.hint("merge"), "start").withColumns(dict(zip("xyz", at)))
    hits = drawn.where(in_box(vec("x", "y", "z"), vec("rx", "ry", "rz"), vec("hx", "hy", "hz"), turn))
    counts = hits.select(*keys, "draw").distinct().groupBy(*keys).agg(F.count("*").alias("n")).hint("merge")
    return constraints.select("scene", "id").join(counts, ["scene", "id"], "left").select("scene", "id", (F.coalesce("n", F.lit(0)) / DRAWS).alias("share"))


def propose_aims(rows: DataFrame, least_gain: float = 0.01) -> DataFrame:
    """``gain`` of the best direction over the present one (current, best), and whether the camera is to be ``moved``."""
    gain = F.when(F.col("current") > 0, F.col("best") / F.col("current") - 1).when(F.col("best") > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))
    return rows.withColumn("gain", gain).withColumn("moved", finite(F.col("best")) & (F.col("gain") >= least_gain))


def recentred(low: Column, high: Column, centre: Column) -> tuple[Column, Column]:
    """The bounds around another middle."""
    half = (high - low) / 2
    return centre - half, centre + half
