"""Kept steps, and the store of runs: replaced by chunk, swapped at once, stale and stopped runs."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from vantagrid.operators import aggregates, grid, visibility
from vantagrid.sources import runs, scene
from vantagrid.streaming import incremental

CAMERA = "scene long, cam_idx int, px double, py double, pz double, qx double, qy double, qz double, qw double, fov double, aspect double, near double, far double, enabled boolean"


@pytest.fixture
def store(spark, request):
    return runs.RunStore(spark, request.node.name)


def held(store):
    found = store.read()
    return found and {r["chunk_id"]: r["n"] for r in found.collect()}


def part(spark, rows):
    return spark.createDataFrame(rows, "chunk_id long, n long")


def test_a_chunk_is_replaced_not_added_to(spark, store):
    assert store.read() is None and store.about is None and store.chunks() is None
    assert store.commit(0, part(spark, [(1, 10), (2, 20)]), spark.range(1, 4).toDF("chunk_id"), {"mode": 1})
    assert held(store) == {1: 10, 2: 20} and sorted(r[0] for r in store.chunks().collect()) == [1, 2, 3]
    for n in range(9):  # more parts than are kept apart
        assert store.commit(0, part(spark, [(2, n)] if n % 2 else [(2, n), (3, n)]), spark.range(2, 4).toDF("chunk_id"), {"mode": 1}, incremental=True)
        assert held(store) == {1: 10, 2: n} | ({} if n % 2 else {3: n})
    assert len(store._pointer()[1]["parts"]) <= runs.MOST_PARTS
    before = len(store.folder.names("parts"))
    store.vacuum()
    assert held(store) == {1: 10, 2: 8, 3: 8} and len(store.folder.names("parts")) < before and len(store.folder.names("pointers")) == 1
    assert store.commit(0, part(spark, [(9, 1)]), spark.range(9, 10).toDF("chunk_id"), {"mode": 2})  # another descriptor: both at once
    assert held(store) == {9: 1} and store.about == {"mode": 2}


def test_a_stale_run_is_dropped(spark, store):
    token = store.generation
    store.commit(token, part(spark, [(1, 1)]), spark.range(2).toDF("chunk_id"), {})
    store.clear()
    assert not store.commit(token, part(spark, [(1, 2)]), spark.range(2).toDF("chunk_id"), {}, incremental=True)
    assert store.read() is None and store.generation == token + 1
    assert store.commit(store.generation, part(spark, [(1, 3)]), spark.range(2).toDF("chunk_id"), {})
    store.drop(token)  # of a run that failed, but is over anyway
    assert held(store) == {1: 3} and not store._point(store._pointer()[0], {})


@pytest.fixture(scope="module")
def room(spark):
    space = grid.Workspace((0.0, 0.0, 0.0), (24.0, 2.0, 8.0), 0.5, 4.0)
    pose = (0.0, 0.0, 0.0, 1.0, 60.0, 1.0, 0.1, 5.0)
    cameras = spark.createDataFrame([(0, i, 2.2 + 6.1 * i, 1.1, 6.3, *pose, True) for i in range(4)], CAMERA)
    boxes = spark.createDataFrame([(0, 0, 2.0, 0.1, 3.1, 0.7, 1.2, 0.6)], "scene long, box long, x0 double, y0 double, z0 double, sx double, sy double, sz double")
    triangles = scene.box_triangles(boxes)
    valid = grid.validity(space.voxels(spark, 1), grid.mixed_cells(space, triangles)).cache()
    stats = lambda points, cams: aggregates.chunk_stats(visibility.masks(points, visibility.sees(points, cams, triangles)))
    return space, space.chunks(spark, 1), valid, cameras, stats


def rows_of(df):
    return {r["chunk_id"]: (r["valid"], r["covered"]) for r in df.collect()}


def test_incremental_runs_equal_full_ones(store, room):
    space, chunks, valid, cameras, stats = room
    settings, seen = {"mode": 1}, []
    counting = lambda points, cams: seen.append(points.select("chunk_id").distinct().count()) or stats(points, cams)
    run = lambda cams, about=settings, **k: incremental.run(store, space, chunks, valid, cams, counting, about, **k)
    done, rows = run(cameras)
    assert not done and rows_of(rows) == rows_of(stats(valid, cameras)) and seen == [12]
    turned = cameras.withColumn("enabled", F.col("cam_idx") != 2)
    done, rows = run(turned)
    assert done and 0 < seen[-1] < 12 and rows_of(rows) == rows_of(stats(valid, turned))
    done, rows = run(turned)
    assert done and seen[-1] == 0 and rows_of(rows) == rows_of(stats(valid, turned))  # nothing changed
    assert not run(turned, {"mode": 2})[0] and not run(turned.where("cam_idx < 3"), {"mode": 2})[0]  # other settings, another list
    assert rows_of(incremental.scoped(valid, chunks.where("chunk_id < 3"), cameras, stats)) == {k: v for k, v in rows_of(stats(valid, cameras)).items() if k < 3}
    assert rows_of(store.read()) == rows_of(stats(valid, turned.where("cam_idx < 3")))


def test_a_run_that_is_stopped(spark, store, room):
    space, chunks, valid, cameras, stats = room
    incremental.run(store, space, chunks, valid, cameras, stats, {})

    def slow(points, cams):
        wait = F.udf(lambda c: time.sleep(20) or c, "long")
        return stats(points, cams).withColumn("covered", wait("covered"))

    stopper = threading.Timer(3, lambda: runs.cancel(spark, "mine"))
    stopper.start()
    began = time.time()
    with pytest.raises(runs.RunCanceled):
        incremental.run(store, space, chunks, valid, cameras, slow, {}, tag="mine", incremental=False)
    assert time.time() - began < 60 and store.read() is None  # no results of two states
    done, rows = incremental.run(store, space, chunks, valid, cameras, stats, {}, tag="mine")
    assert not done and rows_of(rows) == rows_of(stats(valid, cameras))


def test_a_run_whose_store_is_cleared_meanwhile(store, room):
    space, chunks, valid, cameras, stats = room
    clearing = lambda points, cams: store.clear() or stats(points, cams)
    _, rows = incremental.run(store, space, chunks, valid, cameras, clearing, {})
    assert rows_of(rows) == rows_of(stats(valid, cameras)) and store.read() is None


def test_a_run_that_fails_leaves_no_baseline(store, room):
    space, chunks, valid, cameras, stats = room
    incremental.run(store, space, chunks, valid, cameras, stats, {})
    with pytest.raises(ValueError):
        incremental.run(store, space, chunks, valid, cameras.withColumn("far", F.lit(2.0)), lambda *_: (_ for _ in ()).throw(ValueError()), {})
    assert store.read() is None


def test_steps_are_found_again_and_deleted(spark, tmp_path):
    steps, made = runs.Steps(spark), []
    key = runs.fingerprint("x", 1, None)
    make = lambda: made.append(1) or spark.range(5)
    assert steps.get(key, make).count() == steps.get(key, make).count() == 5 and made == [1]
    assert key in steps.keys() and key != runs.fingerprint("x", 2, None)
    assert steps.forget(key) and not steps.forget(key)
    assert steps.get(key, make).count() == 5 and made == [1, 1]
    steps.clear()
    assert not steps.keys()
    table = str(tmp_path / "t")
    spark.range(3).write.parquet(table)
    first = runs.Folder(spark, table).revision()
    assert first == runs.Folder(spark, table).revision()
    spark.range(4).write.mode("overwrite").parquet(table)
    assert first != runs.Folder(spark, table).revision()


def test_target_revisions():
    volumes = [("v1", (0, 0, 0), (0, 0, 0, 1), (1, 1, 1)), ("v2", (1, 0, 0), (0, 0, 0, 1), (1, 1, 1))]
    one = runs.target_revision(["b", "a"], volumes)
    assert one == runs.target_revision(["a", "b"], volumes[::-1]) != runs.target_revision(["a", "b"], volumes[:1]) and runs.target_revision([], volumes) == ""
