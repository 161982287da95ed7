"""Zones that overlap or hold nothing, and which summary is shown."""

import pytest

from vantagrid.operators import grid, summaries

VOLUME = "scene long, zone_id long, rx double, ry double, rz double, hx double, hy double, hz double, rqx double, rqy double, rqz double, rqw double"


@pytest.fixture(scope="module")
def scenes(spark):
    space = grid.Workspace((0.0, 0.0, 0.0), (4.0, 1.0, 4.0), 0.5, 2.0)
    points = space.voxels(spark, 2)
    flat = (0.0, 0.0, 0.0, 1.0)
    volumes = [(s, 10 * s + z, x, 0.5, 1.0, 1.0, 0.5, 1.0, *flat) for s in (0, 1) for z, x in ((1, 1.0), (1, 1.5), (2, 2.0))] + [(0, 3, 50.0, 0.5, 1.0, 1.0, 0.5, 1.0, *flat)]
    zones = [(0, 1, True), (0, 2, True), (0, 3, True), (1, 11, False), (1, 12, False)]
    cameras = spark.createDataFrame([(s, c, c < 2) for s in (0, 1) for c in range(3)], "scene long, cam_idx int, enabled boolean")
    seen = points.where("x < 1").selectExpr("scene", "point", "0 AS cam_idx")
    masked = points.join(seen.selectExpr("point", "1L AS cameras"), "point", "left").fillna(0, ["cameras"])
    return space, masked, seen, spark.createDataFrame(volumes, VOLUME), spark.createDataFrame(zones, "scene long, zone_id long, enabled boolean"), cameras


def test_zones_and_their_cameras(scenes):
    space, masked, seen, volumes, _, cameras = scenes
    got = {(r["zone_id"], r["cam_idx"]): r["rate"] for r in summaries.zone_cameras(space, masked, seen, volumes, cameras).collect()}
    # Zone 1 spans x from 0 to 2.5, five columns of cells of which two are seen; zone 3 holds nothing.
    assert got[1, 0] == got[11, 0] == 2 / 5 and got[2, 0] == 0 and got[3, 0] == 0 and got[1, 1] == 0 and all(c < 2 for _, c in got)


def test_what_is_shown(spark, scenes):
    space, masked, seen, volumes, zones, cameras = scenes
    union = summaries.enabled_union(space, masked, seen, volumes, zones, cameras)
    total = {r["scene"]: tuple(r)[1:] for r in union[0].collect()}
    assert total == {0: (6 * 4 * 2, 2 / 6, 4 * 4 * 2)}  # x from 0 to 3, each cell once; scene 1 has no enabled zone
    whole = (spark.createDataFrame([(0, 100, 0.5), (1, 100, 0.25)], "scene long, valid_voxels long, overall_rate double"), cameras.selectExpr("scene", "cam_idx", "0.75D AS rate"))
    shown = lambda active: {(r["scene"], r["cam_idx"]): tuple(r)[2:] for r in summaries.displayed(whole, union, spark.createDataFrame(active, "scene long"), cameras).collect()}
    by_zones, plain = {(0, 0): (48, 2 / 6, 2 / 6), (0, 1): (48, 2 / 6, 0.0)}, {(s, c): (100, 0.5 if s == 0 else 0.25, 0.75) for s in (0, 1) for c in (0, 1)}
    assert shown([(0,), (1,)]) == plain | by_zones and shown([(1,)]) == plain
    empty = summaries.enabled_union(space, masked, seen, volumes, zones.where("zone_id = 3"), cameras)
    nothing = summaries.displayed(whole, empty, spark.createDataFrame([(0,)], "scene long"), cameras).where("scene = 0").collect()
    assert [tuple(r)[2:] for r in nothing] == [(0, 0.0, None)] * 2


def test_merging_keeps_what_one_part_knows(spark):
    a, b = (spark.createDataFrame(rows, "region long, valid long, covered long") for rows in ([(1, 5, 2)], [(1, 1, 1), (2, 3, 0)]))
    assert sorted(map(tuple, summaries.merge_regions(a, b).collect())) == [(1, 6, 3), (2, 3, 0)]
