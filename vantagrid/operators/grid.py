"""The voxel grid as a generated relation, its chunks, and what geometry occupies."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import checkpointed

CELLS = ("i", "j", "k")
#: So many voxels are made by a task, where there are enough of them.
TASK_VOXELS = 1_000_000
#: A task makes the voxels around what stands in so many scenes, where there are enough of them.
TASK_SCENES = 4
#: So many cells are held against triangles at once.
MOST_CELLS = 1 << 18


def _half_up(x: float) -> int:
    return math.floor(x + 0.5)


@dataclass(frozen=True)
class Workspace:
    """A box of space cut into voxels and, along x and z, into chunks of full height."""

    low: tuple[float, float, float]
    high: tuple[float, float, float]
    voxel: float
    chunk: float

    def __post_init__(self):
        if self.voxel <= 0 or self.chunk <= 0 or any(h <= a for a, h in zip(self.low, self.high)):
            raise ValueError("INVALID_STATE: a workspace needs a positive extent")

    @property
    def dims(self) -> tuple[int, int, int]:
        return tuple(max(1, _half_up((h - a) / self.voxel)) for a, h in zip(self.low, self.high))

    @property
    def chunk_voxels(self) -> int:
        return max(1, _half_up(self.chunk / self.voxel))

    @property
    def chunk_counts(self) -> tuple[int, int]:
        return tuple(-(-n // self.chunk_voxels) for n in (self.dims[0], self.dims[2]))

    def chunk_of(self, i: Column, k: Column) -> Column:
        return (F.floor(i / self.chunk_voxels) + self.chunk_counts[0] * F.floor(k / self.chunk_voxels)).cast("long")

    def centre(self, axis: int, index: Column) -> Column:
        return self.low[axis] + (index + 0.5) * self.voxel

    def cell(self, axis: int, place: Column) -> Column:
        return F.floor((place - self.low[axis]) / self.voxel).cast("long")

    @property
    def size(self) -> int:
        return math.prod(self.dims)

    @property
    def chunk_total(self) -> int:
        return math.prod(self.chunk_counts)

    def voxels(self, spark: SparkSession, scenes: int = 1) -> DataFrame:
        """scene, point, i, j, k, chunk_id and the centre x, y, z of every voxel of ``scenes`` equal workspaces.

        x runs fastest; points and chunks are numbered through all scenes.
        """
        total = scenes * self.size
        return self.placed(spark.range(0, total, 1, max(spark.sparkContext.defaultParallelism, total // TASK_VOXELS)).withColumnRenamed("id", "point"))

    def spanned(self, rows: DataFrame, extents: list[tuple[Column, Column]], scenes: int) -> DataFrame:
        """``rows`` (with a scene) once for every voxel of ``scenes`` workspaces whose centre lies within their extents along x, y and z, with the columns of ``voxels``."""
        rows = self.bounded(rows.where(F.col("scene").between(0, scenes - 1)), extents)
        # Few rows become many, so they are dealt to tasks; what is made of them is compiled apart from the extents.
        return self.filled(rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, scenes // TASK_SCENES)))

    def bounded(self, rows: DataFrame, extents: list[tuple[Column, Column]]) -> DataFrame:
        """``rows`` with the first and last index along each axis of the voxels whose centres lie within their extents; null where a number is missing."""
        for axis, (c, (low, high)) in enumerate(zip(CELLS, extents)):
            first = F.when(low <= high, F.greatest(F.ceil((low - self.low[axis]) / self.voxel - 0.5), F.lit(0)))
            last = F.least(F.floor((high - self.low[axis]) / self.voxel - 0.5), F.lit(self.dims[axis] - 1))
            rows = rows.withColumns({f"_first_{c}": first.cast("long"), f"_last_{c}": last.cast("long")})
        return rows

    def filled(self, rows: DataFrame) -> DataFrame:
        """``bounded`` rows once for each of their voxels, with the columns of ``voxels``."""
        for c in CELLS:
            rows = rows.withColumn(c, F.explode(F.expr(f"if(_first_{c} <= _last_{c}, sequence(_first_{c}, _last_{c}), null)"))).drop(f"_first_{c}", f"_last_{c}")
        rows = self.numbered(rows).withColumn("chunk_id", F.col("scene") * self.chunk_total + self.chunk_of(F.col("i"), F.col("k")))
        return rows.select("*", *(self.centre(a, F.col(c)).alias(n) for a, (c, n) in enumerate(zip(CELLS, "xyz"))))

    def numbered(self, cells: DataFrame) -> DataFrame:
        """Cells (scene, i, j, k) with the ``point`` that ``voxels`` gives them."""
        nx, ny, _ = self.dims
        return cells.withColumn("point", F.col("scene") * self.size + F.col("i") + nx * (F.col("j") + ny * F.col("k")))

    def placed(self, points: DataFrame) -> DataFrame:
        """Points by their number with the other columns of ``voxels``: only numbers need to be kept or shuffled."""
        nx, ny, _ = self.dims
        rows = points.withColumn("scene", F.floor(F.col("point") / self.size)).withColumn("_v", F.col("point") % self.size)
        rows = rows.withColumn("i", F.col("_v") % nx).withColumn("j", F.floor(F.col("_v") / nx) % ny).withColumn("k", F.floor(F.col("_v") / (nx * ny))).drop("_v")
        rows = rows.withColumn("chunk_id", F.col("scene") * self.chunk_total + self.chunk_of(F.col("i"), F.col("k")))
        return rows.select("*", *(self.centre(a, F.col(c)).alias(n) for a, (c, n) in enumerate(zip(CELLS, "xyz"))))

    def words(self, points: DataFrame) -> DataFrame:
        """Points as a ``bit`` each of the word of their stretch (chunk_id, line, part): 64 voxels along x at most, all of one row and one chunk."""
        nx, n = self.dims[0], self.chunk_voxels
        rows = points.select("point", F.floor(F.col("point") / nx).alias("line")).withColumn("_x", F.col("point") % nx)
        at = F.col("_x") % n
        chunk = F.floor(F.col("point") / self.size) * self.chunk_total + self.chunk_of(F.col("_x"), F.floor(F.col("point") % self.size / (nx * self.dims[1])))
        return rows.select("point", "line", chunk.alias("chunk_id"), F.floor(at / 64).alias("part"), F.expr("1L").alias("_one"), (at % 64).cast("int").alias("_at")).select("chunk_id", "line", "part", F.call_function("shiftleft", "_one", "_at").alias("bit"))

    def others(self, told: DataFrame, scenes: int, deal: Callable[[DataFrame], DataFrame] = lambda words: words) -> DataFrame:
        """The voxels of ``scenes`` workspaces that aren't among the ``told`` (point), with the columns of ``voxels``.

        Only words are shuffled (see ``words``); each becomes its voxels behind that.  ``deal`` may join the words by their chunk_id and so adds columns.
        """
        spark, (nx, ny, nz), n, (cx, _) = told.sparkSession, self.dims, self.chunk_voxels, self.chunk_counts
        parts = -(-n // 64)
        total = scenes * ny * nz * cx * parts
        rows = spark.range(0, total, 1, max(spark.sparkContext.defaultParallelism, total // TASK_VOXELS)).select(F.floor(F.col("id") / (cx * parts)).alias("line"), F.floor(F.col("id") / parts % cx).alias("_cx"), (F.col("id") % parts).alias("part"))
        k = F.floor(F.col("line") % (ny * nz) / ny)
        rows = rows.withColumn("chunk_id", F.floor(F.col("line") / (ny * nz)) * self.chunk_total + self.chunk_of(F.col("_cx") * n, k))
        full = self.words(told).groupBy("chunk_id", "line", "part").agg(F.bit_or("bit").alias("bits"))
        rows = deal(rows.join(full.hint("shuffle_hash"), ["chunk_id", "line", "part"], "left").drop("_cx").fillna(0, ["bits"]))
        start = (F.col("chunk_id") % self.chunk_total % cx * n + F.col("part") * 64).cast("long")
        last = (F.least(F.lit(64), n - F.col("part") * 64, nx - F.col("_start")) - 1).cast("int")
        rows = rows.withColumn("_start", start).withColumn("_last", last).where("_last >= 0").withColumn("_at", F.explode(F.sequence(F.lit(0), F.col("_last"))))
        rows = rows.where(F.call_function("getbit", F.col("bits"), F.col("_at")) == 0).withColumn("point", F.col("line") * nx + F.col("_start") + F.col("_at"))
        return self.placed(rows.drop("line", "part", "bits", "chunk_id", "_start", "_last", "_at"))

    def chunks(self, spark: SparkSession, scenes: int = 1) -> DataFrame:
        """chunk_id, its scene and place and size; chunks at the far edges may be smaller."""
        cx, _ = self.chunk_counts
        n, (nx, ny, nz) = self.chunk_voxels, self.dims
        rows = spark.range(scenes * self.chunk_total).withColumnRenamed("id", "chunk_id").withColumn("scene", F.floor(F.col("chunk_id") / self.chunk_total))
        rows = rows.withColumn("cx", F.col("chunk_id") % self.chunk_total % cx).withColumn("cz", F.floor(F.col("chunk_id") % self.chunk_total / cx))
        size = lambda c, most: F.least(F.lit(n), most - F.col(c) * n).cast("long")
        return rows.select("*", size("cx", nx).alias("size_x"), F.lit(ny).cast("long").alias("size_y"), size("cz", nz).alias("size_z"))

    def chunk_span(self, axis: int, low: Column, high: Column) -> Column:
        """The chunk indices along x (0) or z (2) that [low, high] reaches; what lies outside goes to the edge."""
        edge, most = self.chunk_voxels * self.voxel, self.chunk_counts[axis // 2] - 1
        at = lambda c: F.least(F.greatest(F.floor((c - self.low[axis]) / edge), F.lit(0)), F.lit(most)).cast("long")
        return F.sequence(at(low), at(high))

    def to_chunks(self, rows: DataFrame, low: tuple[Column, Column], high: tuple[Column, Column]) -> DataFrame:
        """``rows`` (with a scene) once for every chunk that their extent in x and z reaches."""
        rows = rows.withColumn("_cx", F.explode(self.chunk_span(0, low[0], high[0]))).withColumn("_cz", F.explode(self.chunk_span(2, low[1], high[1])))
        return rows.withColumn("chunk_id", F.col("scene") * self.chunk_total + F.col("_cx") + self.chunk_counts[0] * F.col("_cz")).drop("_cx", "_cz")


def advise_chunk(dims: tuple[int, int, int], voxel: float, cameras: int, target: int = 2_000_000, most: int = 4_000_000, readback: int = 256 << 20) -> float:
    """A chunk length for about ``target`` voxels in each."""
    bytes_per_voxel = 4 * max(1, -(-cameras // 32)) + 1.125
    n = math.floor(math.sqrt(min(target, most, readback / bytes_per_voxel) / dims[1]))
    return max(1, min(n, max(dims[0], dims[2]))) * voxel


def triangle_chunks(space: Workspace, triangles: DataFrame) -> DataFrame:
    """tri_id and chunk_id for every chunk that a triangle's extent reaches; those outside go to the edge."""
    span = lambda f: (f("ax", "bx", "cx"), f("az", "bz", "cz"))
    return space.to_chunks(triangles, span(F.least), span(F.greatest)).select("tri_id", "chunk_id")


def _separating_axes(corners: np.ndarray, half: float) -> Iterator[tuple[list[tuple[int, np.ndarray]], np.ndarray, np.ndarray]]:
    """What of the exact test of triangles (n, corner, axis) against a cube depends on the triangles alone: axes as their parts that aren't 0, with low and high.

    A cube of half-width ``half`` is apart from a triangle where an axis' product with its centre lies outside of
    [low, high].  Axes are a triangle's normal and the crosses of its edges with the cube's axes; the cube's own
    axes are left out, there the extents of the two decide.
    """
    edges = np.roll(corners, -1, axis=1) - corners
    e, f = edges[:, 0].T, edges[:, 1].T
    normal = [e[1] * f[2] - e[2] * f[1], e[2] * f[0] - e[0] * f[2], e[0] * f[1] - e[1] * f[0]]
    levels = [normal[0] * p[0] + normal[1] * p[1] + normal[2] * p[2] for p in (corners[:, 0].T, corners[:, 1].T)]  # the same for all corners, but for rounding
    reach = half * (np.abs(normal[0]) + np.abs(normal[1]) + np.abs(normal[2]))
    yield list(enumerate(normal)), np.minimum(*levels) - reach, np.maximum(*levels) + reach
    for n in range(3):
        edge = edges[:, n].T
        for k in range(3):  # cross with the unit vector k: only the two other components count
            i, j = (k + 1) % 3, (k + 2) % 3
            spans = corners[:, :, i] * edge[j][:, None] - corners[:, :, j] * edge[i][:, None]
            reach = half * (np.abs(edge[i]) + np.abs(edge[j]))
            yield sorted([(i, edge[j]), (j, -edge[i])], key=lambda part: part[0]), spans.min(axis=1) - reach, spans.max(axis=1) + reach


def _cells_met(space: Workspace, scenes: np.ndarray, corners: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The cells that triangles meet, ``MOST_CELLS`` of their extents at a time; a cell that several meet may be told several times."""
    low, most = np.array(space.low), np.array(space.dims) - 1
    # Cells whose closed extent meets that of the triangle.
    first = np.maximum(np.ceil((corners.min(axis=1) - low) / space.voxel) - 1, 0)
    last = np.minimum(np.floor((corners.max(axis=1) - low) / space.voxel), most)
    some = (first <= last).all(axis=1)  # not so where a coordinate is missing
    scenes, corners, first, last = scenes[some], corners[some], first[some].astype(np.int64), last[some].astype(np.int64)
    wide = last - first + 1
    ends = np.cumsum(wide.prod(axis=1))
    axes = list(_separating_axes(corners, space.voxel / 2))
    for start in range(0, int(ends[-1]) if len(ends) else 0, MOST_CELLS):
        place = np.arange(start, min(start + MOST_CELLS, int(ends[-1])))
        of = np.searchsorted(ends, place, side="right")
        place -= ends[of] - wide[of].prod(axis=1)
        cells = []
        for axis in range(3):
            cells.append(first[of, axis] + place % wide[of, axis])
            place //= wide[of, axis]
        for parts, least, greatest in axes:
            at = sum(part[of] * (low[a] + (cells[a] + 0.5) * space.voxel) for a, part in parts)
            meets = (at >= least[of]) & (at <= greatest[of])
            of, cells = of[meets], [c[meets] for c in cells]
        yield pa.RecordBatch.from_arrays([pa.array(scenes[of]), *map(pa.array, cells)], names=["scene", *CELLS])


def mixed_cells(space: Workspace, triangles: DataFrame) -> DataFrame:
    """scene, i, j, k of the voxels that some triangle of the scene meets; touching counts.

    A triangle is dealt to the cells of its extent, and each is held against separating axes that are
    computed once for the triangle, for a batch of triangles at a time: written as one plan this makes methods that the JVM doesn't compile.
    """
    names = [f"{n}{x}" for n in "abc" for x in "xyz"]

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            corners = np.stack([batch[n].to_numpy(zero_copy_only=False) for n in names], axis=1)
            yield from _cells_met(space, batch["scene"].to_numpy(zero_copy_only=False), corners.reshape(-1, 3, 3))

    whole = triangles.select("scene", *(F.col(n).cast("double").alias(n) for n in names)).where("scene IS NOT NULL")
    return whole.mapInArrow(met, "scene long, i long, j long, k long").distinct()


def solid_cells(space: Workspace, mixed: DataFrame) -> DataFrame:
    """scene, i, j, k of closed-in voxels: empty ones that no path of face neighbours joins to the border.

    Empty voxels are first joined to runs along x, and runs that stand above or beside each other in the
    same scene are linked; a lone line without walls is open at both ends and needs no link, so only lines with walls and their
    neighbours take part.  Each step of the fill is written to the shared folder.  Steps are small as files and large as rows, so none is left to
    Spark's estimate: it would broadcast them.
    """
    nx, ny, nz = space.dims
    lines = mixed.groupBy("scene", "j", "k").agg(F.sort_array(F.collect_set("i")).alias("walls"))  # at most nx each
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("walls", lambda w: w + 1))
    ends = F.concat(F.transform("walls", lambda w: w - 1), F.array(F.lit(nx - 1).cast("long")))
    spans = lines.select("scene", "j", "k", F.explode(F.arrays_zip(starts.alias("a"), ends.alias("b"))).alias("s"))
    spans = checkpointed(spans.select("scene", "j", "k", F.col("s.a").alias("a"), F.col("s.b").alias("b")).where("a <= b"))
    aside = F.explode(F.array(*(F.struct((F.col("j") + dj).alias("j"), (F.col("k") + dk).alias("k")) for dj, dk in ((1, 0), (-1, 0), (0, 1), (0, -1)))))
    beside = spans.withColumn("p", aside).select("scene", "p.j", "p.k", "j", "k", "a", "b").toDF("scene", "j", "k", "oj", "ok", "a", "b")
    # A run next to a line without walls reaches the border through it.
    bare = beside.join(lines.select("scene", "j", "k").hint("shuffle_hash"), ["scene", "j", "k"], "left_anti").select("scene", F.col("oj").alias("j"), F.col("ok").alias("k"), "a", "b")
    border = (F.col("a") == 0) | (F.col("b") == nx - 1) | F.col("j").isin(0, ny - 1) | F.col("k").isin(0, nz - 1)
    keys = ["scene", "j", "k", "a", "b"]
    inside = ((F.col("j") >= 0) & (F.col("j") < ny)) & ((F.col("k") >= 0) & (F.col("k") < nz))
    fresh = checkpointed(spans.where(border).union(bare.where(inside)).distinct())
    rest = checkpointed(spans.join(fresh.hint("merge"), keys, "left_anti"))
    while not fresh.isEmpty():  # what is open already isn't asked again
        near = fresh.select("scene", F.col("j").alias("nj"), F.col("k").alias("nk"), F.col("a").alias("fa"), F.col("b").alias("fb")).hint("merge")
        asked = rest.withColumn("p", aside).select(*keys, F.col("p.j").alias("pj"), F.col("p.k").alias("pk")).alias("r")
        meets = (F.col("r.scene") == F.col("n.scene")) & (F.col("pj") == F.col("nj")) & (F.col("pk") == F.col("nk")) & (F.col("a") <= F.col("fb")) & (F.col("fa") <= F.col("b"))
        fresh = checkpointed(asked.join(near.alias("n"), meets, "left_semi").select(*keys).distinct())
        rest = checkpointed(rest.join(fresh.hint("merge"), keys, "left_anti"))
    return rest.select("scene", F.explode(F.sequence("a", "b")).alias("i"), "j", "k")


def occupancy(space: Workspace, triangles: DataFrame, solid: bool) -> DataFrame:
    """scene, i, j, k and kind (1 where geometry lies, 2 closed in) of every voxel that isn't empty."""
    mixed = checkpointed(mixed_cells(space, triangles))
    kinds = mixed.withColumn("kind", F.lit(1))
    return kinds.unionByName(solid_cells(space, mixed).withColumn("kind", F.lit(2))) if solid else kinds


def region_bounds(regions: list[dict]) -> Column:
    """Whether (x, y, z) lies in one of the sampling regions, bounds inclusive; no region is all of space.

    A region is {"kind": "full"}, {"kind": "heightBand", "y": (low, high)} or {"kind": "box", "low": (x, y, z), "high": (x, y, z)}.
    """
    inside = F.lit(not regions)
    for r in regions:
        if r["kind"] == "full":
            inside = F.lit(True)
        elif r["kind"] == "heightBand":
            inside = inside | F.col("y").between(*r["y"])
        elif r["kind"] == "box":
            within = F.lit(True)
            for c, low, high in zip("xyz", r["low"], r["high"]):
                within = within & F.col(c).between(low, high)
            inside = inside | within
        else:
            raise ValueError(f"INVALID_STATE: sampling region {r['kind']}")
    return inside


def validity(voxels: DataFrame, occupied: DataFrame, regions: list[dict] | None = None, stride: int = 1) -> DataFrame:
    """Empty voxels within the sampling regions, every ``stride``-th along each axis by its index in the whole grid.

    ``occupied`` that is numbered (see ``Workspace.numbered``) is met by its ``point``, which the joins after this one take too.
    """
    if stride not in (1, 2, 4):
        raise ValueError("INVALID_STATE: stride")
    rows = voxels.where(region_bounds(regions or []))
    for c in CELLS if stride > 1 else ():
        rows = rows.where(F.col(c) % stride == 0)
    keys = ["point"] if "point" in occupied.columns else ["scene", *CELLS]
    return rows.join(occupied.select(*keys).hint("shuffle_hash"), keys, "left_anti")


def cells_at(space: Workspace, asked: DataFrame, occupied: DataFrame) -> DataFrame:
    """``asked`` (scene, i, j, k) with the kind of each cell; 0 for empty ones and outside of the grid."""
    return asked.join(occupied.select("scene", *CELLS, "kind").hint("merge"), ["scene", *CELLS], "left").fillna(0, ["kind"])


def effective_cameras(space: Workspace, cameras: DataFrame, occupied: DataFrame) -> DataFrame:
    """Cameras, those in closed-in voxels switched off and marked with a warning."""
    at = [space.cell(a, F.col(c)).alias(n) for a, (c, n) in enumerate(zip(("px", "py", "pz"), CELLS))]
    kinds = cells_at(space, cameras.select("*", *at), occupied)
    inside = F.col("enabled") & (F.col("kind") == 2)
    return kinds.withColumn("warning", F.when(inside, F.lit("CAMERA_INSIDE_GEOMETRY"))).withColumn("enabled", F.col("enabled") & ~inside).drop("kind", *CELLS)
