"""Centre rays against every triangle of their scene, in plain Python."""

import math
import random

import pytest

from vantagrid.operators.visibility import nearest_hits


def plain(o, d, tri):
    """Distance along d, by the plane of the triangle and areas."""
    a, b, c = tri
    sub = lambda p, q: [x - y for x, y in zip(p, q)]
    dot = lambda p, q: sum(x * y for x, y in zip(p, q))
    cross = lambda p, q: [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]
    n = cross(sub(b, a), sub(c, a))
    slope = dot(n, d)
    if abs(slope) < 1e-7:
        return None
    t = dot(n, sub(a, o)) / slope
    hit = [x + t * y for x, y in zip(o, d)]
    sides = [dot(n, cross(sub(q, p), sub(hit, p))) for p, q in ((a, b), (b, c), (c, a))]
    return t if t > 1e-9 and min(sides) >= 0 else None


def turned(yaw, pitch):
    """The quaternion of a turn about y after one about x, and where it looks."""
    (sy, cy), (sp, cp) = ((math.sin(v / 2), math.cos(v / 2)) for v in (yaw, pitch))
    return (cy * sp, sy * cp, -sy * sp, cy * cp), (-math.sin(yaw) * math.cos(pitch), math.sin(pitch), -math.cos(yaw) * math.cos(pitch))


def test_nearest_hits_equal_a_scan_of_all_triangles(spark):
    rng = random.Random(4)
    triangles, cameras, rays = [], [], {}
    for scene in range(3):
        for t in range(500):
            at = [rng.uniform(-30, 30), rng.uniform(0, 4), rng.uniform(-30, 30)]
            wide = 25 if t % 30 == 0 else 3
            triangles.append((scene, t, *(x + rng.uniform(-wide, wide) for _ in range(3) for x in at)))
        for cam in range(60):
            yaw, pitch = [(rng.uniform(-3.2, 3.2), rng.uniform(-1, 1)), (0.0, 0.0), (math.pi / 2, 0.0), (0.3, math.pi / 2), (0.0, -math.pi / 2)][cam % 10 if cam % 10 < 5 else 0]
            q, d = turned(yaw, pitch)
            eye = [rng.uniform(-60, 60), rng.uniform(-2, 8), rng.uniform(-60, 60)] if cam % 4 == 0 else [rng.uniform(-30, 30), rng.uniform(0, 4), rng.uniform(-30, 30)]
            cameras.append((scene, cam, *eye, *q))
            rays[scene, cam] = (eye, d)
    cameras.append((9, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0))  # a scene without triangles
    names = ", ".join(f"{n}{a} double" for n in "abc" for a in "xyz")
    mesh = spark.createDataFrame(triangles, f"scene long, tri_id long, {names}")
    rigs = spark.createDataFrame(cameras, "scene long, cam_idx int, px double, py double, pz double, qx double, qy double, qz double, qw double")
    found = {(r["scene"], r["cam_idx"]): r["distance"] for r in nearest_hits(rigs, mesh).collect()}
    assert len(found) == len(cameras) and found[9, 0] is None
    hits = 0
    for (scene, cam), (o, d) in rays.items():
        every = [plain(o, d, [t[2 + 3 * n : 5 + 3 * n] for n in range(3)]) for t in triangles if t[0] == scene]
        want = min((t for t in every if t is not None), default=None)
        hits += want is not None
        assert (found[scene, cam] is None) == (want is None) and (want is None or found[scene, cam] == pytest.approx(want, rel=1e-9)), (scene, cam)
    assert 60 < hits < 180
    assert nearest_hits(rigs, mesh.limit(0)).where("distance IS NOT NULL").count() == 0
