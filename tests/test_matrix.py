"""Matrices against numpy, merged meshes by hand."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantagrid.functions import matrix as M
from vantagrid.functions.geometry import vec
from vantagrid.operators import mesh


def table(cells):
    return np.array(cells, dtype=np.float64).reshape(4, 4).T


def test_matrices_equal_those_of_numpy(spark):
    rng = random.Random(2)
    rows = []
    for n in range(40):
        q = np.array([rng.gauss(0, 1) for _ in range(4)])
        free = [float(np.float32(rng.uniform(-2, 2))) for _ in range(16)]
        rows.append((n, *(rng.uniform(-9, 9) for _ in range(3)), *map(float, q / np.linalg.norm(q)), rng.uniform(0.3, 2.5), rng.uniform(0.5, 2), 0.1, math.inf if n % 5 == 0 else rng.uniform(5, 50), free if n else [1.0] * 16))
    df = spark.createDataFrame(rows, "n int, x double, y double, z double, qx double, qy double, qz double, qw double, fov double, aspect double, near double, far double, free array<double>")
    df = df.withColumns({"m": M.world(vec("x", "y", "z"), [F.col(f"q{a}") for a in "xyzw"]), "p": M.perspective(*(F.col(c) for c in ("fov", "aspect", "near", "far"))), "back": M.invert(F.col("free"))})
    df = df.withColumn("view", M.invert(F.col("m"))).withColumn("all", M.multiply(F.col("p"), F.col("view")))
    at = M.clip(F.col("all"), (F.lit(1.0), F.lit(-2.0), F.lit(3.0)))
    inside = 0
    for r in df.withColumn("at", F.array(*at)).withColumn("seen", M.within(at)).collect():
        x, y, z, w = (r[f"q{a}"] for a in "xyzw")
        turn = np.array([[w * w + x * x - y * y - z * z, 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), w * w - x * x + y * y - z * z, 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), w * w - x * x - y * y + z * z]])
        eye = np.array([r["x"], r["y"], r["z"]])
        assert np.allclose(table(r["m"])[:3, :3], turn, atol=1e-6) and np.allclose(table(r["m"])[:, 3], [*eye, 1], atol=1e-5)
        assert np.allclose(table(r["view"]) @ table(r["m"]), np.eye(4), atol=1e-4)
        assert (r["back"] is None) == (r["n"] == 0) and (r["back"] is None or np.allclose(table(r["back"]), np.linalg.inv(table(r["free"])), rtol=1e-4, atol=1e-4))
        assert np.allclose(r["at"], table(r["p"]) @ table(r["view"]) @ [1, -2, 3, 1], atol=1e-3)
        right, up, depth = turn.T @ (np.array([1.0, -2.0, 3.0]) - eye) * [1, 1, -1]
        v = math.tan(r["fov"] / 2)
        assert r["seen"] == (r["near"] <= depth <= r["far"] and abs(up) <= v * depth and abs(right) <= v * r["aspect"] * depth)
        assert all(float(np.float32(e)) == e for e in r["all"])
        inside += r["seen"]
    assert 2 < inside < 38
    assert table(spark.range(1).select(M.identity().alias("m")).first()["m"]).tolist() == np.eye(4).tolist()


def test_merged_meshes_are_numbered_anew(spark):
    vertices = spark.createDataFrame([(s, m, v, float(v), float(m), float(s)) for s, m, n in ((0, 1, 3), (0, 4, 4), (0, 6, 3), (1, 2, 3)) for v in range(n)], "scene long, mesh long, vertex long, x double, y double, z double")
    faces = spark.createDataFrame([(0, 1, 0, 0, 1, 2), (0, 4, 0, 0, 1, 2), (0, 4, 1, 3, 2, 1), (0, 6, 0, 2, 1, 0), (1, 2, 0, 0, 2, 1)], "scene long, mesh long, tri_id long, va long, vb long, vc long")
    corners, together = mesh.merged(vertices, faces)
    assert sorted(map(tuple, together.collect())) == [(0, 0, 0, 1, 2), (0, 1, 3, 4, 5), (0, 2, 6, 5, 4), (0, 3, 9, 8, 7), (1, 0, 0, 2, 1)]
    assert sorted(r["vertex"] for r in corners.where("scene = 0").collect()) == list(range(10))
    # Each face keeps the corners of its own mesh: y holds the mesh's number.
    assert {r["tri_id"]: {r["ay"], r["by"], r["cy"]} for r in mesh.soup(corners, together).where("scene = 0").collect()} == {0: {1.0}, 1: {4.0}, 2: {4.0}, 3: {6.0}}
    assert mesh.merged(vertices.limit(0), faces.limit(0))[1].count() == 0
    # A mesh of loose corners still moves those after it.
    loose = mesh.merged(vertices, faces.where("mesh <> 4"))[1].where("scene = 0").collect()
    assert sorted(map(tuple, loose)) == [(0, 0, 0, 1, 2), (0, 1, 9, 8, 7)]


def test_a_singular_matrix_has_no_inverse(spark):
    rows = spark.createDataFrame([([0.0] * 16,), (None,)], "m array<double>")
    assert all(r["i"] is None for r in rows.select(M.invert(F.col("m")).alias("i")).collect())
    assert pytest.approx(1.0) == spark.range(1).select(M.identity().alias("m")).select(F.get(M.invert(F.col("m")), F.lit(0)).alias("e")).first()["e"]
