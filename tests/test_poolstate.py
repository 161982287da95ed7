"""The life of a pool, with reach through real visibility."""

import pytest
from pyspark.sql import functions as F

from vantagrid.operators import grid, pool, poolstate, reachsets, rounds
from vantagrid.sources import scene


@pytest.fixture(scope="module")
def site(spark):
    space = grid.Workspace((0.0, 0.0, 0.0), (10.0, 2.0, 6.0), 0.5, 4.0)
    # A closed box: positions in it reach what is in it, those inside of its filled neighbour nothing.
    boxes = spark.createDataFrame([(0, 0, 6.1, 0.1, 1.1, 1.8, 1.8, 3.8)], "scene long, box long, x0 double, y0 double, z0 double, sx double, sy double, sz double")
    triangles = scene.box_triangles(boxes)
    valid = grid.validity(space.voxels(spark, 1), grid.mixed_cells(space, triangles)).where("x < 5.9").cache()
    flat = [0.0, 0.0, 0.0, 1.0]
    rows = [(0, "post", "point", [1.1, 1.3, 1.2], None, None, None, 0.0, 0), (0, "rail", "polyline", None, [[0.6, 1.4, 5.3], [9.4, 1.4, 5.3]], None, None, 0.2, 0), (0, "sealed", "point", [7.0, 1.0, 3.0], None, None, None, 0.1, 0)]
    rows.append((0, "wall", "plane", [3.1, 1.6, 2.2], None, flat, [4.0, 1.0], 0.3, 0))
    constraints = spark.createDataFrame(rows, pool.CONSTRAINT).cache()
    return valid, constraints, triangles


def shares(spark, n):
    return spark.createDataFrame([(0, "post", 1), (0, "rail", n), (0, "sealed", 1), (0, "wall", 2 * n)], "scene long, id string, share long")


def places(df):
    return {(r["id"], r["draw"]): (r["x"], r["y"], r["z"], r["reach"]) for r in df.collect()}


def test_a_pool_is_built_extended_truncated_and_rebuilt(spark, site):
    valid, constraints, triangles = site
    asked = []
    real = poolstate.reach_of(valid, triangles, 0.1, 3.0)
    sets_of = lambda draws: asked.append(draws.count()) or real(draws)
    kept = poolstate.Pool(spark, "life")
    assert kept.about is None and kept.samples().count() == 0
    build = lambda n, seed=5, mark="f": kept.build(constraints, shares(spark, n), 3 * n + 2, seed, mark, sets_of)
    assert build(3) == "build"
    small, drawn = places(kept.positions(shares(spark, 3))), sum(asked)
    summary = {r["id"]: tuple(r)[2:] for r in kept.summary(shares(spark, 3)).collect()}
    assert summary["sealed"] == (1, 3, 0, 3) and summary["post"] == (1, 1, 1, 0)  # it may not see what counts: three tries
    assert build(6) == "extend" and 0 < sum(asked) - drawn <= 3 * 9
    large, drawn = places(kept.positions(shares(spark, 6))), sum(asked)
    assert small.items() <= large.items() and len(large) > len(small)
    for c in ("rail", "wall"):  # the pool of n is the first of the pool of 2 n
        mine = sorted(d for i, d in large if i == c)
        assert sorted(d for i, d in small if i == c) == mine[: len([1 for i, _ in small if i == c])]
    sets = kept.sets(shares(spark, 6))
    together = rounds.reach(valid, sets.select("scene", F.col("place").alias("cam_idx"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"), F.lit(0.1).alias("near"), F.lit(3.0).alias("far")).distinct(), triangles).select("point").distinct().count()
    assert kept.ceiling(shares(spark, 6)).first()["n"] == together
    greedy = reachsets.greedy(sets, sets.select("scene", "place", F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz")).distinct(), 2)
    assert 0 < greedy.agg(F.max("covered")).first()[0] <= together
    assert build(3) == "truncate" and sum(asked) == drawn and places(kept.positions(shares(spark, 3))) == small
    assert build(6) == "extend" and sum(asked) == drawn and places(kept.positions(shares(spark, 6))) == large
    assert build(6, seed=6) == "rebuild" and sum(asked) > drawn and places(kept.positions(shares(spark, 6))) != large
    kept.forget()
    assert poolstate.Pool(spark, "life").about is None


def test_what_a_build_would_do():
    about = {"fingerprint": "f", "seed": 1, "size": 10, "parts": []}
    ask = lambda f="f", n=10, seed=1: poolstate.build_action(about, f, n, seed)
    assert [ask(), ask(n=11), ask(n=9), ask("g", 9), ask(n=11, seed=2), poolstate.build_action(None, "f", 1, 1)] == ["rebuild", "extend", "truncate", "rebuild", "rebuild", "build"]
