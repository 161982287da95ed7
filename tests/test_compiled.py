"""Stages on sight lines stay below the size of a method that the JVM compiles; rows that lack a number see and hide nothing."""

import re

from pyspark.sql import functions as F

from vantagrid.operators import grid, visibility
from vantagrid.plans.queries import Room
from vantagrid.sources import scene

COMPILED = 8000


def methods(df):
    debug = getattr(getattr(df.sparkSession._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    kept = df.sparkSession.conf.get("spark.sql.adaptive.enabled")
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = debug.codegenString(df.select("*")._jdf.queryExecution().executedPlan())
    finally:
        df.sparkSession.conf.set("spark.sql.adaptive.enabled", kept)
    return [int(n) for n in re.findall(r"maxMethodCodeSize:(-?\d+)", text)]


def test_stages_of_sight_lines_are_compiled(spark):
    r = Room(spark, "/root/testdata/sf0.001")
    for made in (r.mixed(), r.of(scene.triangles), r.seen()):
        sizes = methods(made)
        assert sizes and all(0 < n <= COMPILED for n in sizes)


def test_cells_are_met_in_slices(spark, monkeypatch):
    monkeypatch.setattr(grid, "MOST_CELLS", 7)
    space = grid.Workspace((0, 0, 0), (3, 3, 3), 1.0, 3.0)
    import numpy as np

    corners = np.array([[[0.5, 0.5, 0.5], [2.5, 0.5, 0.5], [0.5, 0.5, 2.5]], [[0.5, 1.5, 0.5], [np.nan, 1.5, 0.5], [0.5, 1.5, 2.5]]])
    batches = list(grid._cells_met(space, np.array([4, 5]), corners))
    cells = {tuple(row.values()) for b in batches for row in b.to_pylist()}
    assert len(batches) == 2  # nine cells of one triangle; the other lacks a number
    assert cells == {(4, 0, 0, 0), (4, 1, 0, 0), (4, 2, 0, 0), (4, 0, 0, 1), (4, 1, 0, 1), (4, 0, 0, 2)} | {(4, 2, 0, 1), (4, 1, 0, 2)}


def test_what_lacks_a_number_sees_and_hides_nothing(spark):
    cameras = spark.createDataFrame([(0, c, x, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 60.0, 1.0, 0.1, 9.0, True) for c, x in ((0, 0.0), (1, None))], "scene long, cam_idx int, px double, py double, pz double, qx double, qy double, qz double, qw double, fov double, aspect double, near double, far double, enabled boolean")
    points = spark.createDataFrame([(0, 1, 0.0, 0.0, -5.0), (0, 2, None, 0.0, -5.0)], "scene long, point long, x double, y double, z double")
    wall = spark.createDataFrame([(0, 0, None, -1.0, -2.0, 1.0, 2.0, 0.5)], "scene long, box long, x0 double, y0 double, z0 double, sx double, sy double, sz double")
    seen = visibility.sees(points, cameras, scene.box_triangles(wall))
    assert [tuple(r) for r in seen.collect()] == [(0, 1, 0)]
    whole = scene.box_triangles(wall.withColumn("x0", F.lit(-0.5)))
    assert visibility.sees(points, cameras, whole).count() == 0
