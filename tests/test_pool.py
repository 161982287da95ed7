"""Draws of constraints against plain Python."""

import math

from vantagrid.operators import pool


def _inverse(i, base):
    out, part = 0.0, 1.0
    while i:
        part /= base
        out += part * (i % base)
        i //= base
    return out


def _start(text, seed):
    h = 0x811C9DC5
    for c in text:
        h = (h ^ ord(c)) * 0x01000193 & 0xFFFFFFFF
    return (h ^ (seed * 0x9E3779B1 & 0xFFFFFFFF)) % 1_000_003 + 1


def test_draws_equal_plain_python(spark):
    half = math.sqrt(0.5)
    path = [[0.0, 0.0, 0.0], [2.0, 0.0, 0.0], [2.0, 0.0, 0.0], [2.0, 3.0, 0.0]]
    rows = [(0, "con-1", "point", [1.0, 2.0, 3.0], None, None, None, 2.0, 7), (0, "con-2", "plane", [0.0, 1.0, 0.0], None, [half, 0.0, 0.0, half], [4.0, 2.0], 0.0, 7), (1, "con-3", "polyline", None, path, None, None, 0.5, 1), (1, "con-4", "polyline", None, [[1.0, 1.0, 1.0]] * 2, None, None, 0.0, 0)]
    given = spark.createDataFrame(rows, pool.CONSTRAINT)
    found = {(r["id"], r["draw"]): (r["x"], r["y"], r["z"]) for r in pool.drawn(given, given.selectExpr("scene", "id", "0 AS first", "24 AS last")).collect()}
    assert len(found) == 100
    for _, name, kind, at, points, _, size, distance, seed in rows:
        for k in range(25):
            i = _start(name, seed) + k
            u, v, a, b, c = (_inverse(i, n) for n in (2, 3, 5, 7, 11))
            if kind == "point":
                base = at
            elif kind == "plane":  # a quarter turn about x takes z to -y
                base = [(u - 0.5) * size[0], 1.0 - (v - 0.5) * size[1], 0.0]
            elif name == "con-3":
                base = [min(5 * u, 2.0), max(5 * u - 2, 0.0), 0.0]
            else:
                base = [1.0, 1.0, 1.0]
            far, height, turn = distance * a ** (1 / 3), 2 * b - 1, 2 * math.pi * c
            flat = far * math.sqrt(1 - height * height)
            expected = (base[0] + flat * math.cos(turn), base[1] + far * height, base[2] + flat * math.sin(turn))
            assert all(abs(x - y) < 1e-9 for x, y in zip(found[name, k], expected)), (name, k)
    assert [round(r[0], 9) for r in given.orderBy("id").select(pool.measure()).collect()] == [1.0, 8.0, 5.0, 0.0]


def test_a_pool_grows_until_its_tries_are_used(spark):
    shares = spark.createDataFrame([(0, "a", 2), (0, "b", 2), (0, "c", 1), (0, "d", 2)], "scene int, id string, share int")
    rows = [(0, "a", k, n) for k, n in enumerate((0, 5, 0, 3, 9))] + [(0, "b", k, 0) for k in range(6)] + [(0, "c", 0, 0)]
    samples = spark.createDataFrame(rows, "scene int, id string, draw int, reach int")
    assert sorted((r["id"], r["draw"]) for r in pool.kept(samples, shares).collect()) == [("a", 1), ("a", 3)]
    assert sorted(tuple(r)[1:] for r in pool.still_wanted(samples, shares).collect()) == [("c", 1, 1), ("d", 0, 1)]
