"""Statistics of a visibility relation: chunks, regions, groups, columns, cubes, probes, images, zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import in_box, obb_extent, vec
from ..sources.tables import checkpointed

#: What a scene may declare of each; the joins don't need these caps, descriptors are held to them.
CAPS = {"regions": 64, "slabs": 32, "probes": 256, "groups": 32, "projections": 8}


def held_to_caps(declared: DataFrame, kind: str) -> DataFrame:
    """The rows of a descriptor; a scene that declares more than its cap, or a descriptor for all scenes that does, fails where it is used."""
    n = F.count("*").over(Window.partitionBy("scene" if "scene" in declared.columns else F.lit(0)))
    fine = F.when(n <= CAPS[kind], F.lit(True)).otherwise(F.raise_error(F.lit(f"AGGREGATE_TOO_LARGE: {kind}")).cast("boolean"))
    return declared.withColumn("_fine", fine).where("_fine").drop("_fine")


def chunk_stats(masked: DataFrame) -> DataFrame:
    return masked.groupBy("chunk_id").agg(F.count("*").alias("valid"), F.count_if(F.col("cameras") > 0).alias("covered"))


def chunk_counts(space, chunks: DataFrame, occupied: DataFrame, seen: DataFrame) -> DataFrame:
    """``chunk_stats`` of all of the ``chunks``' voxels that aren't ``occupied`` (point), from what is ``seen`` (point) alone, once or often.

    No voxel is made or shuffled: a chunk has as many valid ones as are left of its size, and what is seen is a bit in the word of its stretch of
    a chunk's row.  Chunks without a valid voxel have no row.
    """
    words = lambda rows: space.words(rows).groupBy("chunk_id", "line", "part").agg(F.bit_or("bit").alias("bits"))
    full, lit = words(occupied), words(seen).withColumnRenamed("bits", "lit")
    rows = full.join(lit.hint("merge"), ["chunk_id", "line", "part"], "full").fillna(0, ["bits", "lit"])
    counts = rows.groupBy("chunk_id").agg(F.sum(F.bit_count("bits")).alias("_full"), F.sum(F.bit_count(F.col("lit").bitwiseAND(F.bitwise_not("bits")))).alias("covered"))
    rows = chunks.select("chunk_id", (F.col("size_x") * F.col("size_y") * F.col("size_z")).alias("_size")).join(counts.hint("merge"), "chunk_id", "left").fillna(0, ["_full", "covered"])
    return rows.select("chunk_id", (F.col("_size") - F.col("_full")).alias("valid"), F.col("covered").cast("long")).where("valid > 0")


def summary(masked: DataFrame) -> DataFrame:
    """Voxels, covered voxels and the rate over all; 0 where there are none."""
    n = masked.agg(F.count("*").alias("valid_voxels"), F.count_if(F.col("cameras") > 0).alias("covered"))
    return n.withColumn("overall_rate", F.coalesce(F.try_divide(F.col("covered").cast("double"), F.col("valid_voxels")), F.lit(0.0)))


def per_camera(cameras: DataFrame, seen: DataFrame, masked: DataFrame) -> DataFrame:
    """Every camera, the disabled ones too, with how many voxels of its scene it sees and their share."""
    counts = seen.groupBy("scene", "cam_idx").agg(F.count("*").alias("visible"))
    total = masked.groupBy("scene").agg(F.count("*").alias("n"))
    rows = cameras.select("scene", "cam_idx").join(counts, ["scene", "cam_idx"], "left").join(total, "scene", "left").fillna(0, ["visible"])
    return rows.select("scene", "cam_idx", "visible", F.coalesce(F.try_divide(F.col("visible").cast("double"), F.col("n")), F.lit(0.0)).alias("rate"))


def chunk_visible(points: DataFrame, seen: DataFrame) -> DataFrame:
    """How many voxels of each chunk each camera sees."""
    return seen.join(points.select("point", "chunk_id").hint("merge"), "point").groupBy("chunk_id", "cam_idx").agg(F.count("*").alias("visible"))


def in_regions(space, points: DataFrame, regions: DataFrame) -> DataFrame:
    """Points (with their chunk_id) joined with every oriented box (scene, region, group_id, centre, half, quaternion) that holds them.

    Boxes go to the chunks that their extent reaches, so a point meets the boxes of its chunk only.
    """
    centre, half, turn = vec("rx", "ry", "rz"), vec("hx", "hy", "hz"), [F.col(c) for c in ("rqx", "rqy", "rqz", "rqw")]
    low, high = obb_extent(centre, half, turn)
    dealt = space.to_chunks(regions, (low[0] - 1e-3, low[2] - 1e-3), (high[0] + 1e-3, high[2] + 1e-3)).drop("scene")
    return points.join(dealt, "chunk_id").where(in_box(vec("x", "y", "z"), centre, half, turn))


def region_voxels(space, scenes: int, regions: DataFrame) -> DataFrame:
    """The voxels, once each, whose centres lie within the extent of some region: all that ``in_regions`` may hold."""
    low, high = obb_extent(vec("rx", "ry", "rz"), vec("hx", "hy", "hz"), [F.col(c) for c in ("rqx", "rqy", "rqz", "rqw")])
    spread = space.spanned(regions, [(a - 1e-3, b + 1e-3) for a, b in zip(low, high)], scenes)
    return spread.select("scene", "point", "i", "j", "k", "chunk_id", "x", "y", "z").distinct()


def _counts() -> list[Column]:
    return [F.count("*").alias("valid"), F.count_if(F.col("cameras") > 0).alias("covered"), F.count_if(F.col("cameras") == 0).alias("blind")]


def region_stats(space, masked: DataFrame, regions: DataFrame) -> DataFrame:
    """Every region, empty ones with zeros."""
    counts = in_regions(space, masked, regions).groupBy("region").agg(*_counts())
    return regions.select("region").join(counts, "region", "left").fillna(0)


def region_visible(space, points: DataFrame, seen: DataFrame, regions: DataFrame) -> DataFrame:
    """How many voxels of each region each camera sees."""
    held = in_regions(space, points, regions).select("point", "region")
    return held.join(seen.select("point", "cam_idx").hint("merge"), "point").groupBy("region", "cam_idx").agg(F.count("*").alias("seen"))


def _once(space, masked: DataFrame, regions: DataFrame) -> DataFrame:
    """A voxel once in each group, however many of the group's regions hold it."""
    return in_regions(space, masked, regions).where("group_id IS NOT NULL").dropDuplicates(["point", "group_id"])


def group_stats(space, masked: DataFrame, regions: DataFrame) -> DataFrame:
    counts = _once(space, masked, regions).groupBy("group_id").agg(*_counts())
    return regions.select("group_id").where("group_id IS NOT NULL").distinct().join(counts, "group_id", "left").fillna(0)


def group_visible(space, points: DataFrame, seen: DataFrame, regions: DataFrame) -> DataFrame:
    once = _once(space, points, regions).select("point", "group_id")
    return once.join(seen.select("point", "cam_idx").hint("merge"), "point").groupBy("group_id", "cam_idx").agg(F.count("*").alias("seen"))


def _within() -> Column:
    """Whether a cell lies within the bounds of a slab."""
    return F.col("i").between(F.col("i0"), F.col("i1")) & F.col("j").between(F.col("j0"), F.col("j1")) & F.col("k").between(F.col("k0"), F.col("k1"))


def in_slabs(cells: DataFrame, slabs: DataFrame) -> DataFrame:
    """The cells, once each, that some slab holds: all that ``column_stats`` counts."""
    return cells.join(F.broadcast(held_to_caps(slabs, "slabs")), _within(), "left_semi")


def column_stats(cells: DataFrame, slabs: DataFrame) -> DataFrame:
    """For each scene, slab and column of it: sum, largest, smallest (255 if none) of the camera counts, and how many cells are blind, valid, obstacles, filtered.

    ``cells`` has scene, i, j, k, cameras, mask, mask_high, valid and ``marked``, whether the regions that the slabs ask for hold it; a slab
    has an axis to collapse (0, 1, 2), inclusive index bounds and ``filter``, whether it takes marked cells only.  Slabs hold for every scene.
    """
    rows = cells.join(F.broadcast(held_to_caps(slabs, "slabs")), _within())  # 32 rows at most, or it fails
    rows = rows.withColumn("a", F.when(F.col("axis") == 0, F.col("j")).otherwise(F.col("i"))).withColumn("b", F.when(F.col("axis") == 2, F.col("j")).otherwise(F.col("k")))
    rows = rows.withColumn("out", F.col("filter") & ~F.col("marked")).withColumn("valid", F.col("valid") & ~F.col("out")).withColumn("solid", ~F.col("valid") & ~F.col("out"))
    n, capped = F.when(F.col("valid"), F.col("cameras")), F.when(F.col("valid"), F.least(F.col("cameras"), F.lit(255)))
    word = lambda c: F.bit_or(F.when(F.col("valid"), F.col(c)).otherwise(F.lit(0).cast("long")))
    return rows.groupBy("scene", "slab", "a", "b").agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("total"),
        F.coalesce(F.max(capped), F.lit(0)).alias("most"),
        F.coalesce(F.min(capped), F.lit(255)).alias("least"),
        F.count_if(F.col("valid") & (F.col("cameras") == 0)).alias("blind"),
        F.count_if("valid").alias("valid"),
        F.count_if("solid").alias("obstacle"),
        F.count_if("out").alias("filtered"),
        word("mask").alias("seen"),
        word("mask_high").alias("seen_high"),
    )


def merge_columns(*parts: DataFrame) -> DataFrame:
    """Column statistics of disjoint sets of cells as those of all together."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    sums, words = ("total", "blind", "valid", "obstacle", "filtered"), ("seen", "seen_high")
    return every.groupBy("scene", "slab", "a", "b").agg(*(F.sum(c).alias(c) for c in sums), F.max("most").alias("most"), F.min("least").alias("least"), *(F.bit_or(c).alias(c) for c in words))


def section_cells(columns: DataFrame, cameras: int) -> DataFrame:
    """The heat map of a section: mean share of cameras, blind share, and black cells without valid voxels."""
    mean = F.coalesce(F.try_divide(F.col("total").cast("double"), F.col("valid") * cameras), F.lit(0.0))
    blind = F.coalesce(F.try_divide(F.col("blind").cast("double"), F.col("valid")), F.lit(0.0))
    return columns.select("scene", "slab", "a", "b", F.greatest(F.lit(0.0), F.least(mean, F.lit(1.0))).alias("mean"), blind.alias("blind_share"), "valid", "obstacle", ((F.col("obstacle") > 0) & (F.col("valid") == 0)).cast("int").alias("black"))


def section_stats(cells: DataFrame) -> DataFrame:
    coloured = F.col("valid") > 0
    return cells.groupBy("scene", "slab").agg(
        F.count("*").alias("total_cells"),
        F.count_if(coloured).alias("valid_cells"),
        F.coalesce(F.avg(F.when(coloured, F.col("mean"))), F.lit(0.0)).alias("coverage"),
        F.count_if(coloured & (F.col("blind_share") == 1)).alias("blind_cells"),
    )


def cubes(cells: DataFrame, levels: int | None = None) -> DataFrame:
    """Cells of equal camera counts joined to cubes, bottom up: (i, j, k, edge, cameras) of every cube that is left whole; until nothing joins, or for so many ``levels``."""
    rows = cells.select("scene", "i", "j", "k", F.lit(1).cast("long").alias("edge"), "cameras")
    done, level = None, 0
    while levels is None or level < levels:
        level += 1
        up = [F.floor(F.col(c) / 2).alias(f"u{c}") for c in "ijk"]
        place = sum(((F.col(c) - F.col(f"u{c}") * 2) * (1 << n) for n, c in enumerate("ijk")), F.lit(0))
        # One row for eight cells, grouped before the shuffle where they lie together.
        eight = [F.max(F.when(F.col("_at") == n, F.col("cameras"))).alias(f"_{n}") for n in range(8)]
        groups = rows.select("*", *up).withColumn("_at", place).groupBy("scene", "ui", "uj", "uk").agg(F.max("edge").alias("edge"), *eight)
        groups = checkpointed(groups) if levels is None else groups
        each = [F.col(f"_{n}") for n in range(8)]
        whole = (F.least(*each) == F.greatest(*each)) & (sum((c.isNotNull().cast("int") for c in each[1:]), each[0].isNotNull().cast("int")) == 8)
        apart = groups.where(~whole).select("scene", "ui", "uj", "uk", "edge", F.posexplode(F.array(*each)).alias("_at", "cameras")).where("cameras IS NOT NULL")
        kept = apart.select("scene", *((F.col(f"u{c}") * 2 + F.shiftright(F.col("_at"), n).bitwiseAND(F.lit(1))).alias(c) for n, c in enumerate("ijk")), "edge", "cameras")
        done = kept if done is None else done.union(kept)
        rows = groups.where(whole).select("scene", *(F.col(f"u{c}").alias(c) for c in "ijk"), (F.col("edge") * 2).alias("edge"), F.col("_0").alias("cameras"))
        if levels is None and rows.isEmpty():
            break
    return rows if done is None else done.union(rows)


def majority(cells: DataFrame, depth: int) -> DataFrame:
    """For every cube of 2 ** depth cells along each side (scene, i, j, k) what most of its cells are: mask, mask_high, valid, and how many they are.

    Whole masks are told apart, and cells that aren't valid from those that nothing sees.  Of equals the one counts whose first cell comes first, by octants, x before y before z.
    """
    bit = lambda c, b: F.shiftright(F.col(c), b).bitwiseAND(F.lit(1).cast("long"))
    place = sum((F.shiftleft(bit(c, b), 3 * b + n) for b in range(depth) for n, c in enumerate("ijk")), F.lit(0).cast("long"))
    up = [F.shiftright(F.col(c), depth).alias(c) for c in "ijk"]
    rows = cells.select("scene", *up, "mask", "mask_high", "valid", place.alias("place"))
    each = rows.groupBy("scene", "i", "j", "k", "mask", "mask_high", "valid").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    best = F.max_by(F.struct("mask", "mask_high", "valid", "n"), F.struct("n", -F.col("first"))).alias("b")
    return each.groupBy("scene", "i", "j", "k").agg(best).select("scene", "i", "j", "k", "b.*")


def probes(space, masked: DataFrame, asked: DataFrame) -> DataFrame:
    """scene, probe, hit (0 outside, 1 valid, 2 not valid), both mask words and the number of cameras at each probe: an equi-join on cells."""
    cells = [space.cell(a, F.col(c).cast("float").cast("double")).alias(n) for a, (c, n) in enumerate((("qx", "i"), ("qy", "j"), ("qz", "k")))]
    inside = F.lit(True)
    for c, n in zip("ijk", space.dims):
        inside = inside & F.col(c).between(0, n - 1)
    found = asked.select("scene", "probe", *cells).join(masked.select("scene", "i", "j", "k", "mask", "mask_high", "cameras"), ["scene", "i", "j", "k"], "left")
    zero = F.lit(0).cast("long")
    hit = F.when(~inside, 0).when(F.col("cameras").isNull(), 2).otherwise(1)
    return found.select("scene", "probe", hit.alias("hit"), F.coalesce("mask", zero).alias("mask"), F.coalesce("mask_high", zero).alias("mask_high"), F.coalesce("cameras", zero).alias("cameras"))


def bits(mask: str = "mask", mask_high: str = "mask_high") -> Column:
    """The camera indices of both mask words, in order."""
    word = lambda c, base: F.filter(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.when(F.call_function("getbit", F.col(c), b) == 1, b + base)), lambda b: b.isNotNull())
    return F.concat(word(mask, 0), word(mask_high, 64))


def probe_results(found: DataFrame) -> DataFrame:
    """scene, probe, its status and the cameras that see it, as text in order; no-data outside and in geometry."""
    status = F.when(F.col("hit") == 1, F.when(F.col("cameras") > 0, F.lit("seen")).otherwise(F.lit("blind"))).otherwise(F.lit("no-data"))
    return found.select("scene", "probe", status.alias("status"), "cameras", F.array_join(bits().cast("array<string>"), ",").alias("camera_list"))


def image_histogram(masked: DataFrame, seen: DataFrame, cameras: DataFrame, bins: int, weights: list[int]) -> DataFrame:
    """Weight that falls on each bin of each camera's image (y from the top); the weight of a voxel goes by how many cameras see it."""
    from .visibility import in_view, prepared

    rows = seen.join(masked.select("point", "x", "y", "z", F.col("cameras").alias("n")).hint("merge"), "point").join(prepared(cameras), ["scene", "cam_idx"])
    x, y, depth = in_view(vec("x", "y", "z"))
    place = lambda c, t: F.least(F.greatest(F.floor((c / (t * depth) + 1) / 2 * bins), F.lit(0)), F.lit(bins - 1)).cast("long")
    table = F.array(*(F.lit(w).cast("long") for w in weights))
    rows = rows.select("scene", "cam_idx", place(x, F.col("tan_h")).alias("bin_x"), place(-y, F.col("tan_v")).alias("bin_y"), F.get(table, F.least(F.col("n"), F.lit(len(weights) - 1)).cast("int")).alias("w"))
    return rows.where("w > 0").groupBy("scene", "cam_idx", "bin_x", "bin_y").agg(F.sum("w").alias("weight"))


def zone_summary(space, masked: DataFrame, volumes: DataFrame, zones: DataFrame) -> DataFrame:
    """Every zone with its voxels, covered share and blind voxels; a zone is the union of its volumes."""
    stats = group_stats(space, masked, volumes.withColumnRenamed("zone_id", "group_id")).withColumnRenamed("group_id", "zone_id")
    rows = zones.select("zone_id").join(stats, "zone_id", "left").fillna(0)
    rate = F.coalesce(F.try_divide(F.col("covered").cast("double"), F.col("valid")), F.lit(0.0))
    return rows.select("zone_id", "valid", rate.alias("rate"), "blind")


def compare_zones(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes of coverage by zone, losses first and the worst of them first; zones empty on both sides are left out."""
    b = before.select("zone_id", F.col("rate").alias("before"), F.col("valid").alias("v0"))
    a = after.select("zone_id", F.col("rate").alias("after"), F.col("valid").alias("v1"))
    rows = b.join(a, "zone_id", "full").fillna(0).where("v0 > 0 OR v1 > 0").withColumn("delta", F.col("after") - F.col("before"))
    rows = rows.withColumn("regressed", (F.col("delta") < -0.0005).cast("int"))
    key = F.when(F.col("regressed") == 1, F.col("delta")).otherwise(-F.col("delta"))
    return rows.orderBy(F.desc("regressed"), key, "zone_id").select("zone_id", "before", "after", "delta", "regressed")
