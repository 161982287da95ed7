"""Which cameras see which points: frustum joins and occlusion as an anti-join.

Every relation carries its ``scene``, and all joins are equi-joins that grow with what lies near each other:

* Points meet cameras through cells of the ground plane: a camera is dealt to the cells of its frustum's extent.
* Rays meet triangles through tiles of the camera's image.  All rays end in a camera, so a ray lies in one tile, and a
  triangle in the tiles that its projection reaches; whatever shares no tile can't hide the point.
* All voxels of a grid needn't be met: those within a frustum's extent are made from the camera.  A camera is dealt to the tiles of its image and makes the
  rays of each where that tile's triangles lie, so no ray is shuffled; of triangles only corners are.

Nothing is broadcast by hand, and what is made by ``explode`` isn't broadcast at all: Spark estimates it by the size of the files below, so it would
pass it whole through the driver.  Cells of cameras, 128 at most in a place, are hashed by partition; tiles are sorted and merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import add, cross, dot, length, rotate, scale, sub, vec

NEAREST = 1e-3
MOST_CAMERAS = 128
#: Width of the cells where points and cameras meet.
CELL = 2.0
#: Tiles of a camera's image, along each side.  More of them mean more copies of triangles, fewer mean more tests for a ray.
TILES = 6
#: What rays and triangles share.
TILE = ("scene", "cam_idx", "tile_u", "tile_v")


def prepared(cameras: DataFrame, most: int = MOST_CAMERAS) -> DataFrame:
    """Cameras with their axes (right, up, ahead along -z) and the half-openings of their frustum.

    A camera's index is its bit in masks, so 128 is a scene's limit; a larger index fails.  Only who builds no masks may ask for ``most`` others.
    """
    up = F.tan(F.radians("fov") / 2)
    turn = [F.col(c) for c in ("qx", "qy", "qz", "qw")]
    axes = {"right": (1.0, 0.0, 0.0), "up": (0.0, 1.0, 0.0), "ahead": (0.0, 0.0, -1.0)}
    named = [c.alias(f"{name}_{a}") for name, unit in axes.items() for c, a in zip(rotate(turn, tuple(map(F.lit, unit))), "xyz")]
    index = F.when(F.col("cam_idx").between(0, most - 1), F.col("cam_idx")).otherwise(F.raise_error(F.lit("TOO_MANY_CAMERAS")).cast("int"))
    return cameras.withColumn("cam_idx", index).select("*", up.cast("float").cast("double").alias("tan_v"), (up * F.col("aspect")).cast("float").cast("double").alias("tan_h"), *named)


def in_view(p: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    """A point as the prepared camera sees it: to the right, upwards, and its depth."""
    away = sub(p, vec("px", "py", "pz"))
    return tuple(dot(away, vec(*(f"{name}_{a}" for a in "xyz"))) for name in ("right", "up", "ahead"))


def in_frustum(p: tuple[Column, Column, Column]) -> Column:
    """All six sides inclusive; ``far`` also bounds the distance itself."""
    x, y, depth = in_view(p)
    inside = (F.abs(x) <= F.col("tan_h") * depth) & (F.abs(y) <= F.col("tan_v") * depth) & (depth >= F.col("near")) & (depth <= F.col("far"))
    return inside & (length(sub(p, vec("px", "py", "pz"))) <= F.col("far"))


def frustum_extent(axis: str) -> tuple[Column, Column]:
    """Least and largest coordinate of a prepared camera's frustum along x, y or z."""
    eye, far = F.col(f"p{axis}"), F.col("far")
    ahead, right, up = (F.col(f"{n}_{axis}") for n in ("ahead", "right", "up"))
    corners = [eye + far * (ahead + r * F.col("tan_h") * right + u * F.col("tan_v") * up) for r in (-1, 1) for u in (-1, 1)]
    return F.greatest(eye - far, F.least(eye, *corners)), F.least(eye + far, F.greatest(eye, *corners))


def _cell(c: Column) -> Column:
    return F.floor(c / CELL).cast("long")


def _whole(rows: DataFrame, *names: str) -> DataFrame:
    """The rows of which none of these numbers is missing, with columns that can't be null.

    Without tests for nulls a stage's method stays below the 8,000 bytes up to which the JVM compiles it.  Whatever lacks a number sees and hides nothing.
    """
    return rows.na.drop(subset=list(names)).withColumns({n: F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names})


def _enabled(cameras: DataFrame, most: int) -> DataFrame:
    frame = [f"{name}_{axis}" for name in ("right", "up", "ahead") for axis in "xyz"]
    return _whole(prepared(cameras, most).where("enabled"), "px", "py", "pz", "near", "far", "tan_h", "tan_v", *frame)


def camera_cells(cameras: DataFrame, most: int = MOST_CAMERAS) -> DataFrame:
    """Enabled, prepared cameras once for each cell of the ground plane that their frustum's extent reaches."""
    rows = _enabled(cameras, most)
    for axis in "xz":
        low, high = frustum_extent(axis)
        rows = rows.withColumn(f"first_{axis}", _cell(low - 1e-9)).withColumn(f"cell_{axis}", F.explode(F.sequence(_cell(low - 1e-9), _cell(high + 1e-9))))
    return rows


def candidates(points: DataFrame, cameras: DataFrame, most: int = MOST_CAMERAS) -> DataFrame:
    """Pairs of a point (scene, ``point``, x, y, z) and an enabled camera of its scene whose frustum holds it."""
    placed = _whole(points, "x", "y", "z").withColumn("cell_x", _cell(F.col("x"))).withColumn("cell_z", _cell(F.col("z")))
    pairs = placed.join(camera_cells(cameras, most).hint("shuffle_hash"), ["scene", "cell_x", "cell_z"])
    return pairs.where(in_frustum(vec("x", "y", "z"))).drop("cell_x", "cell_z", "first_x", "first_z")


def voxel_candidates(space, scenes: int, cameras: DataFrame, most: int = MOST_CAMERAS) -> DataFrame:
    """``candidates`` of all voxels of ``scenes`` workspaces, made from the cameras: no voxel is shuffled."""
    extents = [(low - 1e-9, high + 1e-9) for low, high in map(frustum_extent, "xyz")]
    return space.spanned(_enabled(cameras, most), extents, scenes).where(in_frustum(vec("x", "y", "z")))


def _tile(c: Column) -> Column:
    """The tile of an image coordinate in -1 to 1."""
    return F.least(F.greatest(F.floor((c + 1) / 2 * TILES), F.lit(0)), F.lit(TILES - 1)).cast("int")


def blockers(cameras: DataFrame, triangles: DataFrame, most: int = MOST_CAMERAS) -> DataFrame:
    """For each tile of a camera's image the triangles that may hide something there.

    What of the ray test depends on camera and triangle alone, three vectors and a number, is computed once for each pair:
    seen from the camera a test is three dot products with the ray's direction.
    """
    corners = [vec(*(f"{n}{a}" for a in "xyz")) for n in "abc"]
    a, b, c = corners
    dealt = _whole(triangles, *(f"{n}{axis}" for n in "abc" for axis in "xyz"))
    for axis in "xz":
        names = [f"{n}{axis}" for n in "abc"]
        dealt = dealt.withColumn(f"from_{axis}", _cell(F.least(*names) - 1e-9))
        dealt = dealt.withColumn(f"cell_{axis}", F.explode(F.sequence(F.col(f"from_{axis}"), _cell(F.greatest(*names) + 1e-9))))
    pairs = dealt.join(camera_cells(cameras, most).hint("shuffle_hash"), ["scene", "cell_x", "cell_z"])
    # A pair may share several cells: the least of them counts.
    pairs = pairs.where(" AND ".join(f"cell_{axis} = greatest(from_{axis}, first_{axis})" for axis in "xz"))
    seen = [in_view(p) for p in corners]
    pairs = pairs.select("*", *(v.alias(f"_{name}{n}") for n, view in enumerate(seen) for name, v in zip("uvd", view)))
    depth = [F.col(f"_d{n}") for n in range(3)]
    inside = (F.greatest(*depth) > 0) & (F.least(*depth) <= F.col("far") + 1e-9)
    # A triangle that reaches behind the camera has no bounded projection: it counts for the whole image.
    whole = F.least(*depth) < 1e-3
    for name, tan in (("u", "tan_h"), ("v", "tan_v")):
        at = [F.col(f"_{name}{n}") / (F.col(tan) * F.greatest(d, F.lit(1e-3))) for n, d in enumerate(depth)]
        low, high = F.least(*at) - 1e-9, F.greatest(*at) + 1e-9
        pairs = pairs.withColumn(f"_low_{name}", F.when(whole, -1.0).otherwise(low)).withColumn(f"_high_{name}", F.when(whole, 1.0).otherwise(high))
        inside = inside & (F.col(f"_high_{name}") >= -1) & (F.col(f"_low_{name}") <= 1)
    # The condition stands in the first explode: as a filter Spark would move it into the join, with all that it is made of written out again.
    for name, asked in (("u", inside), ("v", F.lit(True))):
        pairs = pairs.withColumn(f"tile_{name}", F.explode(F.when(asked, F.sequence(_tile(F.col(f"_low_{name}")), _tile(F.col(f"_high_{name}"))))))
    # Corners pack better than what is worked out of them, so that is done behind the shuffle.
    pairs = pairs.select(*TILE, *(f"{n}{axis}" for n in "abc" for axis in "xyz"), "px", "py", "pz").repartition(*TILE)
    e1, e2, s = sub(b, a), sub(c, a), sub(vec("px", "py", "pz"), a)
    q = cross(s, e1)
    vectors = {"n": cross(e2, e1), "u": cross(e2, s), "v": q}
    return pairs.select(*TILE, *(x.alias(f"{name}{axis}") for name, v in vectors.items() for x, axis in zip(v, "xyz")), dot(e2, q).alias("tn"))


def _blocks() -> Column:
    """The test on a row of ``blockers`` for the ray from the camera along d to the distance ``dist``."""
    d = vec("dx", "dy", "dz")
    det, un, vn = dot(d, vec("nx", "ny", "nz")), dot(d, vec("ux", "uy", "uz")), dot(d, vec("vx", "vy", "vz"))
    sign = F.signum(det)
    size = F.abs(det)
    near, t = NEAREST * size, F.col("tn") * sign
    inside = (un * sign >= 0) & (vn * sign >= 0) & ((un + vn) * sign <= size)
    return (size >= 1e-7) & inside & (t > near) & (t < F.col("dist") * size - near)


def sees(points: DataFrame, cameras: DataFrame, triangles: DataFrame, *keep: str, most: int = MOST_CAMERAS) -> DataFrame:
    """scene, ``point``, ``cam_idx`` (and the columns ``keep`` of the points) of every free line of sight."""
    return _free(candidates(points, cameras, most), cameras, triangles, keep, most)


def sees_voxels(space, scenes: int, cameras: DataFrame, triangles: DataFrame, most: int = MOST_CAMERAS, *keep: str) -> DataFrame:
    """``sees`` of all voxels of ``scenes`` workspaces, of those too that geometry meets."""
    rays = _rays(_in_tile(space.filled(_camera_tiles(space, scenes, cameras, most))), keep)
    return _unhidden(rays, cameras, triangles, most).select("scene", "point", "cam_idx", *keep)


def _camera_tiles(space, scenes: int, cameras: DataFrame, most: int, around: float = 0.0) -> DataFrame:
    """Enabled cameras once for each tile of their image, dealt by tile, with the bounds of the voxels whose centres may lie in it, or ``around`` them along each axis.

    Where cameras have ``lo_cx`` to ``hi_cz``, the chunks that are asked for, voxels outside of these are left out.
    """
    rows = _enabled(cameras, most).where(F.col("scene").between(0, scenes - 1))
    # In voxels: the eye, and how far the frustum reaches ahead, to its sides and at all.  Behind a tile it reaches from the eye to four corners.
    scaled = {f"_e{x}": (F.col(f"p{x}") - space.low[n]) / space.voxel - 0.5 for n, x in enumerate("xyz")} | {"_far": F.col("far") / space.voxel}
    ways = {"a": lambda x: F.col(f"ahead_{x}"), "h": lambda x: F.col("tan_h") * F.col(f"right_{x}"), "v": lambda x: F.col("tan_v") * F.col(f"up_{x}")}
    rows = rows.withColumns(scaled | {f"_{n}{x}": F.col("far") / space.voxel * way(x) for x in "xyz" for n, way in ways.items()})
    for n, t in (("h", "tile_u"), ("v", "tile_v")):
        rows = rows.withColumn(t, F.explode(F.sequence(F.lit(0), F.lit(TILES - 1))))
        rows = rows.withColumns({"_from": F.col(t) * (2 / TILES) - (1 + 1e-7), "_to": F.col(t) * (2 / TILES) - (1 - 2 / TILES - 1e-7)})
        rows = rows.withColumns({f"_{end}{n}{x}": f(F.col("_from") * F.col(f"_{n}{x}"), F.col("_to") * F.col(f"_{n}{x}")) for x in "xyz" for end, f in (("low", F.least), ("high", F.greatest))})
    slack, zero, ends = (1e-6 + around) / space.voxel, F.lit(0.0), {}
    for x, c, size in zip("xyz", "ijk", space.dims):
        low, high = (F.col(f"_a{x}") + F.col(f"_{end}h{x}") + F.col(f"_{end}v{x}") for end in ("low", "high"))
        ends[f"_first_{c}"] = F.greatest(F.ceil(F.col(f"_e{x}") + F.greatest(-F.col("_far"), F.least(zero, low)) - slack), F.lit(0).cast("long"))
        ends[f"_last_{c}"] = F.least(F.floor(F.col(f"_e{x}") + F.least(F.col("_far"), F.greatest(zero, high)) + slack), F.lit(size - 1).cast("long"))
    rows = rows.withColumns(ends)
    if "lo_cx" in cameras.columns:
        n = space.chunk_voxels
        for c, axis in (("i", "x"), ("k", "z")):
            first, last = F.greatest(f"_first_{c}", F.col(f"lo_c{axis}") * n), F.least(F.col(f"_last_{c}"), F.col(f"hi_c{axis}") * n + (n - 1))
            rows = rows.withColumns({f"_first_{c}": first, f"_last_{c}": last})
    bounds = [f"_{end}_{c}" for c in "ijk" for end in ("first", "last")]
    some = " AND ".join(f"_first_{c} <= _last_{c}" for c in "ijk")
    frame = [f"{name}_{a}" for name in ("right", "up", "ahead") for a in "xyz"]
    return rows.where(some).select(*TILE, "px", "py", "pz", "near", "far", "tan_h", "tan_v", *frame, *bounds).repartition(*TILE)


def _image() -> tuple[Column, Column]:
    """The tile of a point in the prepared camera's frustum."""
    u, v, depth = in_view(vec("x", "y", "z"))
    return _tile(u / (F.col("tan_h") * depth)), _tile(v / (F.col("tan_v") * depth))


def _in_tile(pairs: DataFrame) -> DataFrame:
    """Of points and the tiles of cameras the pairs where the point lies in the frustum, and there in the tile."""
    u, v = _image()
    return pairs.where(in_frustum(vec("x", "y", "z"))).where((F.col("tile_u") == u) & (F.col("tile_v") == v))


def _free(pairs: DataFrame, cameras: DataFrame, triangles: DataFrame, keep: tuple[str, ...], most: int) -> DataFrame:
    """Of candidates those that nothing hides."""
    u, v = _image()
    rays = _rays(pairs.withColumns({"tile_u": u, "tile_v": v}), keep)
    return _unhidden(rays, cameras, triangles, most).select("scene", "point", "cam_idx", *keep)


def _rays(pairs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Distance and direction of candidates whose tile is known."""
    pairs = pairs.withColumn("dist", length(sub(vec("px", "py", "pz"), vec("x", "y", "z"))))
    away = F.greatest("dist", F.lit(1e-12))
    return pairs.select(*TILE, "point", *keep, "dist", *(((F.col(c) - F.col(f"p{c}")) / away).alias(f"d{c}") for c in "xyz"))


def _unhidden(rays: DataFrame, cameras: DataFrame, triangles: DataFrame, most: int, by: str = "merge") -> DataFrame:
    """Rays that no triangle of their tile stops."""
    table = blockers(cameras, triangles, most)
    table = table.select(*(F.col(k).alias(f"_{k}") for k in TILE), *(c for c in table.columns if c not in TILE))
    same = F.lit(True)
    for k in TILE:
        same = same & (F.col(k) == F.col(f"_{k}"))
    blocked = same & (F.col("dist") >= 2 * NEAREST) & _blocks()
    return rays.join(table.hint(by), blocked, "left_anti")


def sees_by_samples(points: DataFrame, cameras: DataFrame, triangles: DataFrame, voxel: float, threshold: int = 1) -> DataFrame:
    """scene, point, cam_idx and how many of eight places within the voxel the camera sees, where it is ``threshold`` at least."""
    signs = F.explode(F.array(*(F.struct(*(F.lit(0.35 * voxel * s).alias(n) for s, n in zip((a, b, c), ("ox", "oy", "oz")))) for a in (-1, 1) for b in (-1, 1) for c in (-1, 1)))).alias("o")
    moved = points.select("scene", "point", "x", "y", "z", signs).select("scene", "point", *((F.col(c) + F.col(f"o.o{c}")).alias(c) for c in "xyz"))
    return sees(moved, cameras, triangles).groupBy("scene", "point", "cam_idx").agg(F.count("*").alias("samples")).where(F.col("samples") >= threshold)


def sees_voxels_by_samples(space, scenes: int, cameras: DataFrame, triangles: DataFrame, threshold: int = 1) -> DataFrame:
    """``sees_by_samples`` of all voxels of ``scenes`` workspaces, of those too that geometry meets; as neither voxels nor rays are shuffled, only counts are."""
    step = 0.35 * space.voxel
    signs = F.explode(F.array(*(F.struct(*(F.lit(step * s).alias(n) for s, n in zip((a, b, c), ("ox", "oy", "oz")))) for a in (-1, 1) for b in (-1, 1) for c in (-1, 1)))).alias("o")
    near = space.filled(_camera_tiles(space, scenes, cameras, MOST_CAMERAS, step))
    moved = near.select("*", signs).withColumns({c: F.col(c) + F.col(f"o.o{c}") for c in "xyz"}).drop("o")
    # Rays are many more than what hides them, so they pass by a table of it and aren't sorted.
    free = _unhidden(_rays(_in_tile(moved), ()), cameras, triangles, MOST_CAMERAS, "shuffle_hash")
    return free.groupBy("scene", "point", "cam_idx").agg(F.count("*").alias("samples")).where(F.col("samples") >= threshold)


def subset(seen: DataFrame, chosen: DataFrame) -> DataFrame:
    """Of a visibility relation what the chosen cameras (scene, cam_idx) see, or of cameras the chosen ones: rays of others needn't be traced; every statistic may be taken of it."""
    return seen.join(chosen.select("scene", "cam_idx"), ["scene", "cam_idx"], "left_semi")


def chunk_cameras(space, chunks: DataFrame, cameras: DataFrame) -> DataFrame:
    """chunk_id and cam_idx where a frustum may reach into a chunk; no pair that matters is left out.

    A frustum's side leaves a chunk out if all eight corners lie beyond it.
    """
    x0, z0 = (space.low[a] + F.col(c) * space.chunk_voxels * space.voxel for a, c in ((0, "cx"), (2, "cz")))
    ends = {"x": (x0, x0 + F.col("size_x") * space.voxel), "y": (F.lit(space.low[1]), F.lit(space.high[1])), "z": (z0, z0 + F.col("size_z") * space.voxel)}
    used = prepared(cameras).where("enabled")
    spanned = used.select("*", *(c.alias(f"{side}_{axis}") for axis in "xz" for side, c in zip(("lo", "hi"), frustum_extent(axis))))
    spanned = space.to_chunks(spanned, (F.col("lo_x"), F.col("lo_z")), (F.col("hi_x"), F.col("hi_z"))).drop("scene")
    pairs = chunks.join(spanned, "chunk_id")
    axis_of = lambda n: vec(*(f"{n}_{a}" for a in "xyz"))
    ahead, right, up = axis_of("ahead"), axis_of("right"), axis_of("up")
    sides = [(add(scale(ahead, F.col(tan)), scale(way, F.lit(sign))), F.lit(0.0)) for way, tan in ((right, "tan_h"), (up, "tan_v")) for sign in (-1.0, 1.0)]
    sides += [(ahead, F.col("near")), (scale(ahead, F.lit(-1.0)), -F.col("far"))]
    within = F.lit(True)
    for normal, least in sides:  # inside where normal . (p - eye) >= least
        furthest = sum((F.greatest(n * (lo - F.col(f"p{a}")), n * (hi - F.col(f"p{a}"))) for n, a, (lo, hi) in zip(normal, "xyz", ends.values())), F.lit(0.0))
        within = within & (furthest >= least - 1e-9)
    return pairs.where(within).select("chunk_id", "cam_idx")


def chunk_spans(space, chunks: DataFrame, cameras: DataFrame) -> DataFrame:
    """The cameras that may see into some of the ``chunks``, with the span of these (``lo_cx`` to ``hi_cz``): what ``sees_voxels`` makes is held to it."""
    met = chunk_cameras(space, chunks, cameras).join(chunks.select("chunk_id", "scene", "cx", "cz").hint("merge"), "chunk_id")
    spans = met.groupBy("scene", "cam_idx").agg(*(f(c).alias(f"{end}_{c}") for c in ("cx", "cz") for end, f in (("lo", F.min), ("hi", F.max))))
    return cameras.join(spans.hint("merge"), ["scene", "cam_idx"])


def masks(points: DataFrame, seen: DataFrame) -> DataFrame:
    """Every point with its cameras as two longs (camera c is bit c % 64 of word c div 64) and their number; what else is seen is left out."""
    bit = F.expr("shiftleft(1L, cast(cam_idx % 64 as int))")
    words = seen.groupBy("point").agg(
        F.coalesce(F.bit_or(F.when(F.col("cam_idx") < 64, bit)), F.lit(0).cast("long")).alias("mask"),
        F.coalesce(F.bit_or(F.when(F.col("cam_idx") >= 64, bit)), F.lit(0).cast("long")).alias("mask_high"),
    )
    filled = points.join(words.hint("shuffle_hash"), "point", "left").fillna(0, ["mask", "mask_high"])
    return filled.withColumn("cameras", (F.bit_count("mask") + F.bit_count("mask_high")).cast("long"))


def told(space, seen: DataFrame, occupied: DataFrame) -> DataFrame:
    """point, mask, mask_high and ``valid`` of the voxels that are seen or ``occupied`` (point); those of all others are zeros and true (see ``Workspace.others``).

    Dealt by chunk, so that what lies side by side stays together.
    """
    rows = seen.select("point", "cam_idx").unionByName(occupied.select("point", F.lit(-1).alias("cam_idx")))
    rows = space.placed(rows).select("chunk_id", "point", "cam_idx").repartition("chunk_id")
    bit, zero, free = F.expr("shiftleft(1L, cast(cam_idx % 64 as int))"), F.lit(0).cast("long"), F.min("cam_idx") >= 0
    word = lambda low: F.when(free, F.coalesce(F.bit_or(F.when(F.col("cam_idx").between(low, low + 63), bit)), zero)).otherwise(zero)
    return rows.groupBy("chunk_id", "point").agg(word(0).alias("mask"), word(64).alias("mask_high"), free.alias("valid")).drop("chunk_id")


def _ray_cells(rays: DataFrame, triangles: DataFrame) -> DataFrame:
    """Rays (scene, p, d) once for each cell of the ground plane that they pass between entering and leaving the extent of their scene's triangles."""
    slack = 1e-6
    ends = triangles.groupBy("scene").agg(*(f(g(*(F.col(f"{n}{a}") for n in "abc"))).alias(f"{side}_{a}") for a in "xyz" for side, f, g in (("lo", F.min, F.least), ("hi", F.max, F.greatest))))
    rows = rays.join(ends, "scene")
    place = lambda axis, t: F.col(f"p{axis}") + t * F.col(f"d{axis}")

    def between(axis: str, low: Column, high: Column) -> tuple[Column, Column]:
        """The stretch of a ray between two planes across an axis; all of it, where the ray runs along them."""
        flat = F.abs(F.col(f"d{axis}")) < 1e-12
        at = [(c - F.col(f"p{axis}")) / F.when(flat, F.lit(1.0)).otherwise(F.col(f"d{axis}")) for c in (low - slack, high + slack)]
        return F.when(flat, F.lit(float("-inf"))).otherwise(F.least(*at)), F.when(flat, F.lit(float("inf"))).otherwise(F.greatest(*at))

    cut = [between(a, F.col(f"lo_{a}"), F.col(f"hi_{a}")) for a in "xyz"]
    rows = rows.withColumn("enter", F.greatest(F.lit(0.0), *(c[0] for c in cut))).withColumn("leave", F.least(*(c[1] for c in cut))).where("enter <= leave")
    span = lambda axis: F.explode(F.sequence(_cell(F.least(*(place(axis, F.col(t)) for t in ("enter", "leave"))) - slack), _cell(F.greatest(*(place(axis, F.col(t)) for t in ("enter", "leave"))) + slack)))
    rows = rows.withColumn("cell_x", span("x"))
    first, last = between("x", F.col("cell_x") * CELL, (F.col("cell_x") + 1) * CELL)
    rows = rows.withColumns({"enter": F.greatest("enter", first), "leave": F.least("leave", last)}).where("enter <= leave")
    return rows.withColumn("cell_z", span("z")).select(*rays.columns, "cell_x", "cell_z")


def nearest_hits(cameras: DataFrame, triangles: DataFrame) -> DataFrame:
    """For each camera the distance at which its centre ray first meets the mesh, null if never.

    The ray has no end but where it leaves its scene; it meets the triangles of the cells of the ground plane that it passes.
    """
    eye = vec("px", "py", "pz")
    ahead = rotate([F.col(c) for c in ("qx", "qy", "qz", "qw")], (F.lit(0.0), F.lit(0.0), F.lit(-1.0)))
    rays = cameras.select("scene", "cam_idx", "px", "py", "pz", *(c.alias(f"d{a}") for c, a in zip(ahead, "xyz")))
    a, b, c = vec("ax", "ay", "az"), vec("bx", "by", "bz"), vec("cx", "cy", "cz")
    e1, e2, s, d = sub(b, a), sub(c, a), sub(eye, a), vec("dx", "dy", "dz")
    p, q = cross(d, e2), cross(s, e1)
    dealt = triangles
    for axis in "xz":
        names = [f"{n}{axis}" for n in "abc"]
        dealt = dealt.withColumn(f"cell_{axis}", F.explode(F.sequence(_cell(F.least(*names) - 1e-9), _cell(F.greatest(*names) + 1e-9))))
    # A pair that meets in several cells counts once, as the least of equal distances.
    pairs = dealt.join(_ray_cells(rays, triangles).hint("shuffle_hash"), ["scene", "cell_x", "cell_z"])
    pairs = pairs.select("scene", "cam_idx", dot(e1, p).alias("det"), dot(s, p).alias("un"), dot(d, q).alias("vn"), dot(e2, q).alias("tn")).where("abs(det) >= 1e-7")
    hits = pairs.where("un / det >= 0 AND vn / det >= 0 AND un / det + vn / det <= 1 AND tn / det > 1e-9").groupBy("scene", "cam_idx").agg(F.min(F.col("tn") / F.col("det")).alias("distance"))
    return cameras.select("scene", "cam_idx").join(hits.hint("shuffle_hash"), ["scene", "cam_idx"], "left")
