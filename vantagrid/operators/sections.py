"""Sections over whole scenes: slabs from sections, columns with region filters, the cells of a heat map, their figures, and cameras of each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregates import bits, held_to_caps
from .records import _axis, index_range

#: What a cell shows, by the section's choice.
SHOWS = {"mean": "mean", "max": "most", "min": "least", "blind": "blind_share"}


def admitted(asked: Column, held: Column) -> Column:
    """Whether a filter of region numbers lets a voxel through that lies in the regions ``held``; an empty filter, or none, lets all through."""
    return F.coalesce((F.size(asked) == 0) | F.arrays_overlap(asked, F.coalesce(held, F.array().cast("array<long>"))), F.lit(True))


def section_slabs(space, sections: DataFrame) -> DataFrame:
    """Sections (scene, section, orientation, min, max, min_a, max_a, min_b, max_b in metres, mask_regions), with bounds resolved, as slabs of voxels.

    Adds axis, i0 to k1 (inclusive), ``length``, the voxels of a whole column, and ``transposed``: whether its first side comes after its second.
    """
    ends = {0: ("min", "max"), 1: ("min_a", "max_a"), 2: ("min_b", "max_b")}
    out = {"axis": _axis(0).cast("int"), "transposed": _axis(1) > _axis(2)}
    for axis, letter in enumerate("ijk"):
        # Which of the section's three stretches lies along this axis.
        low, high = (F.coalesce(*(F.when(_axis(n) == axis, F.col(ends[n][end])) for n in range(3))) for end in (0, 1))
        out[f"{letter}0"], out[f"{letter}1"] = index_range(low, high, F.lit(space.low[axis]), F.lit(space.voxel), F.lit(space.dims[axis]).cast("long"))
    rows = sections.withColumns(out)
    span = lambda c: F.col(f"{c}1") - F.col(f"{c}0") + 1
    return rows.withColumn("length", F.when(F.col("axis") == 0, span("i")).when(F.col("axis") == 1, span("j")).otherwise(span("k")))


def section_columns(space, cells: DataFrame, slabs: DataFrame, others: Callable[[Callable[[DataFrame], DataFrame]], DataFrame] | None = None) -> DataFrame:
    """Column statistics (see ``aggregates.column_stats``) of slabs that belong to a scene each, by scene and section.

    ``cells`` has chunk_id and ``regions``, the numbers of the regions that hold it (null for none).  Slabs are dealt to the chunks that they reach, so a
    cell meets those of its chunk alone.  A scene with more slabs than its cap fails.  ``others`` makes further cells out of what a function that it is given
    has joined with the slabs by chunk_id, as ``Workspace.others`` does.
    """
    n = space.chunk_voxels
    steps = lambda c: F.explode(F.sequence(F.floor(F.col(f"{c}0") / n), F.floor(F.col(f"{c}1") / n)))
    dealt = held_to_caps(slabs, "slabs").withColumn("_cx", steps("i")).withColumn("_cz", steps("k"))
    dealt = dealt.withColumn("chunk_id", F.col("scene") * space.chunk_total + F.col("_cx") + space.chunk_counts[0] * F.col("_cz"))
    dealt = dealt.select("chunk_id", "section", "axis", "mask_regions", *(f"{c}{e}" for c in "ijk" for e in (0, 1)))
    within = [F.col(c).between(F.col(f"{c}0"), F.col(f"{c}1")) for c in "ijk"]
    meet = lambda rows: rows.join(dealt.hint("shuffle_hash"), "chunk_id")
    rows = meet(cells) if others is None else meet(cells).unionByName(others(meet), allowMissingColumns=True)
    rows = rows.where(within[0] & within[1] & within[2])
    rows = rows.withColumn("a", F.when(F.col("axis") == 0, F.col("j")).otherwise(F.col("i"))).withColumn("b", F.when(F.col("axis") == 2, F.col("j")).otherwise(F.col("k")))
    rows = rows.withColumn("out", ~admitted(F.col("mask_regions"), F.col("regions")))
    counts, zero = F.col("valid") & ~F.col("out"), F.lit(0).cast("long")
    capped = F.when(counts, F.least(F.col("cameras"), F.lit(255)))
    word = lambda c: F.bit_or(F.when(counts, F.col(c)).otherwise(zero)).alias
    return rows.groupBy("scene", "section", "a", "b").agg(
        F.coalesce(F.sum(F.when(counts, F.col("cameras"))), zero).alias("total"),
        F.coalesce(F.max(capped), F.lit(0)).alias("most"),
        F.coalesce(F.min(capped), F.lit(255)).alias("least"),
        F.count_if(counts & (F.col("cameras") == 0)).alias("blind"),
        F.count_if(counts).alias("valid"),
        F.count_if(~F.col("valid") & ~F.col("out")).alias("obstacle"),
        F.count_if("out").alias("filtered"),
        word("mask")("seen"),
        word("mask_high")("seen_high"),
    )


def section_grid(columns: DataFrame, slabs: DataFrame, run_cameras: DataFrame) -> DataFrame:
    """Cells of each section's heat map, u along its first side and v along its second.

    ``run_cameras`` (scene, n) says how many cameras the run had.  A cell whose column isn't wholly counted, obstacles and filtered voxels included, has no
    data (``no_data``); one of obstacles alone is black; one with valid voxels is coloured.  Shares are 0 where nothing is valid.
    """
    rows = columns.join(slabs.select("scene", "section", "transposed", "length", "i0", "j0", "k0", "axis"), ["scene", "section"]).join(run_cameras, "scene")
    a = F.col("a") - F.when(F.col("axis") == 0, F.col("j0")).otherwise(F.col("i0"))
    b = F.col("b") - F.when(F.col("axis") == 2, F.col("j0")).otherwise(F.col("k0"))
    some = F.col("valid") > 0
    share = lambda n, of: F.when(some, F.greatest(F.lit(0.0), F.least(F.coalesce(F.try_divide(n.cast("double"), of), F.lit(0.0)), F.lit(1.0)))).otherwise(0.0)
    missing = F.col("length") - (F.col("valid") + F.col("obstacle") + F.col("filtered")) > 0
    return rows.select(
        "scene", "section",
        F.when(F.col("transposed"), b).otherwise(a).alias("u"), F.when(F.col("transposed"), a).otherwise(b).alias("v"),
        share(F.col("total"), F.col("valid") * F.col("n")).alias("mean"), share(F.col("most"), F.col("n")).alias("most"), share(F.col("least"), F.col("n")).alias("least"),
        share(F.col("blind"), F.col("valid")).alias("blind_share"), some.alias("coloured"), missing.alias("no_data"), ((F.col("obstacle") > 0) & ~missing & ~some).alias("black"), "seen", "seen_high",
    )


def shown(aggregation: Column) -> Column:
    """What a cell shows by the section's choice of mean, max, min or blind."""
    return F.coalesce(*(F.when(aggregation == name, F.col(c)) for name, c in SHOWS.items()))


def section_figures(grid: DataFrame, sections: DataFrame) -> DataFrame:
    """One row for each section (scene, section, aggregation): cells coloured or black, their coverage, and the mean of what is shown; zeros where nothing is coloured."""
    on, zero = F.col("coloured"), F.lit(0.0)
    of = lambda f, c: F.coalesce(f(F.when(on, c)), zero)
    figures = grid.join(sections.select("scene", "section", "aggregation"), ["scene", "section"]).groupBy("scene", "section").agg(
        F.count_if(on | F.col("black")).alias("total_cells"), F.count_if(on).alias("valid_cells"), F.count_if("black").alias("obstacle_cells"),
        of(F.avg, F.col("mean")).alias("coverage"), F.count_if(on & (F.col("blind_share") == 1)).alias("blind_cells"),
        of(F.min, F.col("mean")).alias("least"), of(F.max, F.col("mean")).alias("most"), of(F.avg, shown(F.col("aggregation"))).alias("badge"),
    )
    rows = sections.select("scene", "section").join(figures, ["scene", "section"], "left").fillna(0)
    return rows.withColumn("blind_pct", F.coalesce(F.try_divide(F.col("blind_cells").cast("double"), F.col("valid_cells")), zero))


def section_cameras(grid: DataFrame, sections: DataFrame, cameras: DataFrame) -> DataFrame:
    """For every section and enabled camera of its scene, the share of coloured cells in which the camera sees a voxel."""
    lit = grid.where("coloured").select("scene", "section", bits("seen", "seen_high").alias("sees"))
    sizes = lit.groupBy("scene", "section").agg(F.count("*").alias("n"))
    counts = lit.select("scene", "section", F.explode("sees").alias("cam_idx")).groupBy("scene", "section", "cam_idx").agg(F.count("*").alias("saw"))
    rows = sections.select("scene", "section").join(cameras.where("enabled").select("scene", "cam_idx"), "scene")
    rows = rows.join(sizes, ["scene", "section"], "left").join(counts, ["scene", "section", "cam_idx"], "left").fillna(0, ["saw"])
    return rows.select("scene", "section", "cam_idx", F.coalesce(F.try_divide(F.col("saw").cast("double"), F.col("n")), F.lit(0.0)).alias("share"))
