"""The line-of-sight engine on hand-made scenes, and that the entry module works alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantagrid.operators import aggregates, grid, mesh, placement, visibility
from vantagrid.sources import scene

CAMERA = "scene long, cam_idx int, px double, py double, pz double, qx double, qy double, qz double, qw double, fov double, aspect double, near double, far double, enabled boolean"


def boxes(spark, *rows):
    return scene.box_triangles(spark.createDataFrame([(0, *r) for r in rows], "scene long, box long, x0 double, y0 double, z0 double, sx double, sy double, sz double"))


def test_grid_dims_and_chunks(spark):
    space = grid.Workspace((0, 0, 0), (5, 2, 3), 0.5, 2.0)
    assert space.dims == (10, 4, 6) and space.chunk_counts == (3, 2)
    assert space.chunks(spark).selectExpr("sum(size_x * size_y * size_z)").first()[0] == space.voxels(spark).count() == 240
    with pytest.raises(ValueError):
        grid.Workspace((0, 0, 0), (0, 1, 1), 0.5, 1)


def test_closed_box_is_solid(spark):
    space = grid.Workspace((0, 0, 0), (3.5, 3.5, 3.5), 0.5, 2.0)
    mixed = grid.mixed_cells(space, boxes(spark, (0, 0.6, 0.6, 0.6, 2.3, 2.3, 2.3)))
    inside = {(0, i, j, k) for i in (2, 3, 4) for j in (2, 3, 4) for k in (2, 3, 4)}
    assert {tuple(r) for r in grid.solid_cells(space, mixed).select("scene", "i", "j", "k").collect()} == inside
    occupied = grid.occupancy(space, boxes(spark, (0, 0.6, 0.6, 0.6, 2.3, 2.3, 2.3)), True)
    assert occupied.where("kind = 2").count() == 27 and occupied.where("kind = 1").count() == mixed.count()
    pose = (0.0, 0.0, 0.0, 1.0, 60.0, 1.0, 0.1, 9.0)
    cameras = spark.createDataFrame([(0, 0, 1.75, 1.75, 1.75, *pose, True), (0, 1, 0.2, 0.2, 0.2, *pose, True), (0, 2, 1.75, 1.75, 1.75, *pose, False), (0, 3, 99.0, 0.0, 0.0, *pose, True)], CAMERA)
    found = {r["cam_idx"]: (r["enabled"], r["warning"]) for r in grid.effective_cameras(space, cameras, occupied).collect()}
    assert found == {0: (False, "CAMERA_INSIDE_GEOMETRY"), 1: (True, None), 2: (False, None), 3: (True, None)}


def test_touching_counts_as_meeting(spark):
    space = grid.Workspace((0, 0, 0), (2, 2, 2), 0.5, 2.0)
    wall = boxes(spark, (0, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5))
    assert {tuple(r)[1:] for r in grid.mixed_cells(space, wall).collect()} == {(i, j, k) for i in range(3) for j in range(3) for k in range(3)} - set()


def test_sampling_regions_and_stride(spark):
    space = grid.Workspace((0, 0, 0), (4, 2, 4), 0.5, 2.0)
    nothing = spark.createDataFrame([], "scene long, i long, j long, k long")
    count = lambda *a: grid.validity(space.voxels(spark), nothing, *a).count()
    assert count() == 256 and count([], 2) == 32 and count([{"kind": "full"}]) == 256
    assert count([{"kind": "heightBand", "y": (0.25, 0.75)}]) == 128 and count([{"kind": "heightBand", "y": (0.25, 0.75)}, {"kind": "box", "low": (0, 0, 0), "high": (0.6, 2, 0.6)}]) == 130
    with pytest.raises(ValueError):
        count([{"kind": "sphere"}])


def test_a_wall_hides_what_is_behind_it(spark):
    ahead = (0.0, 0.0, 5.0, 0.0, 0.0, 0.0, 1.0, 60.0, 1.0, 0.1, 20.0)
    cameras = spark.createDataFrame([(0, 0, *ahead, True), (0, 1, *ahead, False), (1, 70, *ahead, True)], CAMERA)
    at = [(0, 0.1, 0.1, 3.0), (1, 0.1, 0.1, -3.0), (2, 0.0, 0.0, 9.0), (3, 2.5, 0.0, -3.0)]
    points = spark.createDataFrame([(s, 10 * s + i, *p) for s in (0, 1) for i, *p in at], "scene long, point long, x double, y double, z double")
    wall = boxes(spark, (0, -0.5, -0.5, 0.0, 1.0, 1.0, 0.1))
    seen = visibility.sees(points, cameras, wall)
    assert {tuple(r) for r in seen.collect()} == {(0, 0, 0), (0, 3, 0), (1, 10, 70), (1, 11, 70), (1, 13, 70)}
    assert visibility.nearest_hits(cameras, wall).where("scene = 0 AND cam_idx = 0").first()["distance"] == pytest.approx(4.9)
    assert visibility.nearest_hits(cameras, wall).where("scene = 1").first()["distance"] is None
    masked = visibility.masks(points, seen)
    assert masked.selectExpr("sum(mask)", "sum(mask_high)").first()[:] == (2, 3 * 64) and aggregates.summary(masked).first()["overall_rate"] == 5 / 8
    assert visibility.subset(seen, spark.createDataFrame([(1, 70)], "scene long, cam_idx int")).count() == 3
    with pytest.raises(Exception, match="TOO_MANY_CAMERAS"):
        visibility.prepared(cameras.withColumn("cam_idx", cameras.cam_idx + 100)).collect()


def test_cameras_beyond_64_are_kept_in_columns_and_probes(spark):
    space = grid.Workspace((0, 0, 0), (1, 1, 1), 0.5, 1.0)
    cells = space.voxels(spark).selectExpr("*", "0L AS mask", "64L AS mask_high", "1L AS cameras", "true AS valid", "false AS marked")
    slabs = spark.createDataFrame([(0, 1, 0, 9, 0, 9, 0, 9, False), (1, 1, 0, 9, 0, 9, 0, 9, True)], "slab int, axis int, i0 int, i1 int, j0 int, j1 int, k0 int, k1 int, filter boolean")
    found = aggregates.column_stats(cells, slabs)
    assert {(r["slab"], r["seen"], r["seen_high"], r["total"], r["filtered"]) for r in found.collect()} == {(0, 0, 64, 2, 0), (1, 0, 0, 0, 2)}
    halves = [aggregates.column_stats(cells.where(f"j = {j}"), slabs) for j in (0, 1)]
    assert sorted(map(tuple, aggregates.merge_columns(*halves).select(*found.columns).collect())) == sorted(map(tuple, found.collect()))
    asked = spark.createDataFrame([(0, 5, 0.3, 0.3, 0.3), (0, 6, 7.0, 0.0, 0.0)], "scene long, probe long, qx double, qy double, qz double")
    told = {r["probe"]: (r["status"], r["camera_list"]) for r in aggregates.probe_results(aggregates.probes(space, cells, asked)).collect()}
    assert told == {5: ("seen", "70"), 6: ("no-data", "")}


def test_chunk_culling_leaves_nothing_out(spark):
    from vantagrid.plans.queries import Room
    from vantagrid.streaming import incremental

    r = Room(spark, "/root/testdata/sf0.001")
    voxels, cameras = r.voxels(), r.of(scene.cameras)
    needed = visibility.candidates(voxels, cameras).select("chunk_id", "cam_idx").distinct()
    kept = visibility.chunk_cameras(r.space, r.chunks(), cameras)
    assert needed.join(kept, ["chunk_id", "cam_idx"], "left_anti").isEmpty() and kept.count() < r.chunks().count() * cameras.count()
    dirty = incremental.dirty_chunks(r.space, r.chunks(), cameras, r.fewer())
    assert needed.where("cam_idx % 3 = 0").select("chunk_id").distinct().join(dirty, "chunk_id", "left_anti").isEmpty()


def test_assignment_is_least(spark):
    from itertools import permutations

    rng = np.random.default_rng(3)
    for n, m in ((1, 1), (3, 4), (4, 4), (3, 6)):
        for cost in (rng.random((n, m)), rng.integers(0, 3, (n, m)).astype(float)):
            chosen = placement.least_matching(cost)
            assert len(set(chosen.tolist())) == n
            assert cost[np.arange(n), chosen].sum() == pytest.approx(min(sum(cost[i, p] for i, p in enumerate(order)) for order in permutations(range(m), n)))
    kind = "scene long, {} int, px double, py double, pz double"
    cameras = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0), (0, 1, 5.0, 0.0, 1.0), (1, 0, 0.0, 0.0, 0.0)], kind.format("camera"))
    targets = spark.createDataFrame([(0, 0, 4.0, 0.0, 0.0), (0, 1, 0.0, 0.0, 0.0), (0, 2, 9.0, 9.0, 9.0)], kind.format("target"))
    plan = {tuple(r)[:4] for r in placement.assign(cameras, targets).collect()}
    assert plan == {(0, "move", 0, 1), (0, "move", 1, 0), (0, "create", None, 2), (1, "disable", 0, None)}


def test_greedy_takes_most_first(spark):
    sets = {(1,): 3, (1, 70): 2, (70, 3): 1, (3,): 1}
    word = lambda s, low: sum(1 << (c - low) for c in s if low <= c < low + 64)
    groups = spark.createDataFrame([(0, word(s, 0), word(s, 64), n) for s, n in sets.items()], "scene long, mask long, mask_high long, n long")
    places = spark.createDataFrame([(0, p, float(p), 0.0, 0.0) for p in (1, 3, 70, 5)], "scene long, place int, px double, py double, pz double")
    # After 1 and 3 all is covered; then the farthest from those chosen.
    assert [tuple(r) for r in placement.greedy_curve(groups, places).orderBy("step").collect()] == [(0, 1, 1, 5), (0, 2, 3, 7), (0, 3, 70, 7), (0, 4, 5, 7)]


def test_shares_take_back_what_is_too_much(spark):
    weights = spark.createDataFrame([(0, 100.0), *((i, 0.1) for i in range(1, 6))], "idx int, w double")
    assert {r["idx"]: r["share"] for r in placement.shares(weights, 10).collect()} == {0: 5, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1}
    assert placement.shares(weights, 3).agg({"share": "max"}).first()[0] == 1


def test_radical_inverses_and_hashes(spark):
    from vantagrid.functions import geometry

    row = spark.range(100, 101).select(geometry.halton(F.col("id"), 2), geometry.halton(F.col("id"), 3), geometry.fnv1a(F.lit("a")), geometry.fnv1a(F.lit(""))).first()
    assert row[0] == 0.1484375 and row[1] == pytest.approx(1 / 3 * 1 + 0 / 9 + 2 / 27 + 0 / 81 + 1 / 243) and row[2] == 0xE40C292C and row[3] == 2166136261
    assert all(spark.range(50).select(geometry.length(geometry.ball_point(F.col("id"), 2.0)).alias("d")).where("d > 2.0000001").isEmpty() for _ in [0])


def test_meshes(spark):
    corner = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0), (0, 1, 2.0, 0.0, 0.0), (0, 2, 0.0, 2.0, 0.0), (0, 3, float("nan"), 0.0, 0.0)], "scene long, vertex long, x double, y double, z double")
    faces = spark.createDataFrame([(0, 0, 0, 1, 2), (0, 1, 0, 1, 1), (0, 2, 0, 1, 3)], "scene long, tri_id long, va long, vb long, vc long")
    kept = mesh.clean(mesh.soup(corner, faces))
    assert [r["tri_id"] for r in kept.collect()] == [0]
    lit = lambda *v: tuple(F.lit(float(x)) for x in v)
    moved = mesh.placed(kept, lit(1, 1, 1), lit(0, 0, 1, 0), lit(2, 1, 1))  # half a turn about z
    r = mesh.bounds(moved, 0.0).first()
    assert (r["min_x"], r["max_x"], r["min_y"], r["max_y"]) == pytest.approx((-3, 1, -1, 1))


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).first()["valid_voxels"] > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_greedy_query_takes_every_place(spark):
    from vantagrid.plans import queries

    r = queries.Room(spark, "/root/testdata/sf0.001")
    found = queries.w1(spark, r.dir).orderBy("step").collect()
    assert {x["place"] for x in found} == {x["cam_idx"] for x in r.of(scene.cameras).collect()}
    assert found[-1]["covered"] == r.seen().select("point").distinct().count()


def test_a_slab_too_many_fails(spark):
    cells = spark.createDataFrame([(0, 0, 0, 0, 1, 1, 0, True, True)], "scene long, i int, j int, k int, cameras long, mask long, mask_high long, valid boolean, marked boolean")
    slabs = lambda n: spark.range(n).selectExpr("id AS slab", "0 AS axis", "0 AS i0", "1 AS i1", "0 AS j0", "1 AS j1", "0 AS k0", "1 AS k1", "false AS filter")
    assert aggregates.column_stats(cells, slabs(32)).count() == 32
    with pytest.raises(Exception, match="AGGREGATE_TOO_LARGE"):
        aggregates.column_stats(cells, slabs(33)).collect()
