"""Mesh files, zones, aims and edits, against files made by hand and plain recursion and counting."""

import json
import math
import struct

import numpy as np
import pytest

from vantagrid.operators import aim, documents, edits, zones
from vantagrid.sources import assets

CORNERS = [f"{n}{a}" for n in "abc" for a in "xyz"]


def _decoded(spark, files):
    rows = assets.decode_meshes(spark.createDataFrame(files, "path string, content binary")).orderBy("path", "tri_id").collect()
    return {p: [(r["problem"], *(r[c] for c in CORNERS)) for r in rows if r["path"] == p] for p, _ in files}


def _glb(document, binary):
    text = json.dumps(document).encode()
    text += b" " * (-len(text) % 4)
    chunks = struct.pack("<II", len(text), 0x4E4F534A) + text + struct.pack("<II", len(binary), 0x004E4942) + binary
    return struct.pack("<4sII", b"glTF", 2, 12 + len(chunks)) + chunks


def test_mesh_files_of_all_kinds(spark):
    head = "ply\nformat {} 1.0\ncomment x\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nelement face 2\nproperty list uchar int vertex_indices\nend_header\n"
    points = [(0, 0, 0), (1, 0, 0), (1, 2, 0), (0, 2, 0.5)]
    text = "".join(f"{x} {y} {z}\n" for x, y, z in points) + "3 0 1 2\n4 0 1 2 3\n"
    binary = lambda o: b"".join(struct.pack(o + "3f", *p) for p in points) + struct.pack(o + "B3iB4i", 3, 0, 1, 2, 4, 0, 1, 2, 3)
    document = {
        "scene": 0, "scenes": [{"nodes": [0]}],
        "nodes": [{"translation": [10, 0, 0], "children": [1]}, {"mesh": 0, "scale": [2, 1, 1], "rotation": [0, 0, math.sqrt(0.5), math.sqrt(0.5)]}],
        "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "indices": 1}, {"attributes": {"POSITION": 0}, "mode": 1}]}],
        "accessors": [{"bufferView": 0, "componentType": 5126, "count": 3, "type": "VEC3"}, {"bufferView": 1, "componentType": 5123, "count": 3, "type": "SCALAR"}],
        "bufferViews": [{"buffer": 0, "byteLength": 36}, {"buffer": 0, "byteOffset": 36, "byteLength": 6}],
        "buffers": [{"byteLength": 42}],
    }
    data = struct.pack("<9f", 1, 0, 0, 0, 1, 0, 0, 0, 1) + struct.pack("<3H", 0, 2, 1)
    outside = dict(document, buffers=[{"byteLength": 42, "uri": "mesh.bin"}])
    loop = dict(document, nodes=[{"children": [1]}, {"children": [0]}])
    files = [("a.ply", (head.format("ascii") + text).encode()), ("b.ply", head.format("binary_little_endian").encode() + binary("<")), ("c.ply", head.format("binary_big_endian").encode() + binary(">"))]
    files += [("d.glb", _glb(document, data)), ("e.ply", b""), ("f.ply", None), ("g.gltf", json.dumps(outside).encode()), ("h.ply", (head.format("ascii") + "0 0 0").encode()), ("i.glb", _glb(loop, data))]
    found = _decoded(spark, files)
    flat = lambda *ids: (None, *(float(c) for i in ids for c in points[i]))
    assert found["a.ply"] == found["b.ply"] == found["c.ply"] == [flat(0, 1, 2), flat(0, 1, 2), flat(0, 2, 3)]
    (glb,) = found["d.glb"]  # stretched along x, a quarter turn about z, moved
    assert glb[0] is None and [round(c, 6) for c in glb[1:]] == [10, 2, 0, 10, 0, 1, 9, 0, 0]
    for name in ("e.ply", "f.ply", "g.gltf", "h.ply", "i.glb"):
        ((problem, *rest),) = found[name]
        assert problem.startswith("unreadable") and rest == [None] * 9, name
    assert assets.decode_meshes(spark.createDataFrame([], "path string, content binary")).count() == 0


def test_meshes_are_read_from_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "one.PLY").write_text("ply\nformat ascii 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_index\nend_header\n0 0 0\n1 0 0\n0 1 0\n3 0 1 2\n")
    (tmp_path / "note.txt").write_text("no mesh")
    (row,) = assets.read_meshes(spark, str(tmp_path)).collect()
    assert row["path"].endswith("one.PLY") and row["bx"] == 1.0


def _cut(triangles, level, path, out):
    """Nodes by recursion over lists: (id, low, high, mids) of each triangle."""
    low, high = [min(t[1][a] for t in triangles) for a in range(3)], [max(t[2][a] for t in triangles) for a in range(3)]
    area = lambda lo, hi: 2 * sum(max(0.0, hi[a] - lo[a]) * max(0.0, hi[b] - lo[b]) for a, b in ((0, 1), (1, 2), (2, 0)))
    span = lambda ts: ([min(t[1][a] for t in ts) for a in range(3)], [max(t[2][a] for t in ts) for a in range(3)])
    sides = [max(t[3][a] for t in triangles) - min(t[3][a] for t in triangles) for a in range(3)]
    axis = sides.index(max(sides))
    if level == 0 or len(triangles) <= zones.LEAF or sides[axis] < 1e-12:
        out[path] = (low, high, len(triangles))
        return
    start, step = min(t[3][axis] for t in triangles), 16 * (1 - 1e-6) / sides[axis]
    place = lambda t: min(15, max(0, int((t[3][axis] - start) * step)))
    best = (math.inf, None)
    for i in range(15, 0, -1):
        left, right = [t for t in triangles if place(t) < i], [t for t in triangles if place(t) >= i]
        if left and right:
            cost = float(np.float32(area(*span(left)))) * len(left) + area(*span(right)) * len(right)
            best = min(best, (cost, i), key=lambda b: b[0])
    if best[0] < len(triangles) * area(low, high):
        left, right = [t for t in triangles if place(t) < best[1]], [t for t in triangles if place(t) >= best[1]]
    else:
        ordered = sorted(triangles, key=lambda t: (t[3][axis], t[0]))
        left, right = ordered[: len(ordered) // 2], ordered[len(ordered) // 2 :]
    _cut(left, level - 1, path * 2, out)
    _cut(right, level - 1, path * 2 + 1, out)


def test_zones_equal_a_recursion(spark):
    random = np.random.default_rng(7)
    rows = []
    for i in range(300):  # many small triangles
        at = random.uniform(0, 20, 3)
        rows.append((1, i, *np.float32(np.concatenate([at + random.uniform(0, 1, 3) for _ in range(3)])).astype(float)))
    for i in range(40):  # large ones over each other are cut in halves
        rows.append((2, i, *np.float32(np.concatenate([random.uniform(-50, -49, 3), random.uniform(49, 50, 3), [i % 5, 0, 0]])).astype(float)))
    rows += [(3, i, *map(float, (0, 0, 0, 1, 0, 0, 0, 1, 0))) for i in range(20)]  # all alike: no cut
    triangles = spark.createDataFrame([(s, i, *map(float, c)) for s, i, *c in rows], "scene long, tri_id long, " + ", ".join(f"{c} double" for c in CORNERS))
    found, volumes = zones.generate(triangles, 1, 4, 0.25)
    got, named = volumes.collect(), {(r["scene"], r["id"]): r for r in found.collect()}
    for scene in (1, 2, 3):
        own = []
        for s, i, *c in rows:
            if s == scene:
                low, high = [min(c[a::3]) for a in range(3)], [max(c[a::3]) for a in range(3)]
                own.append((i, low, high, [float(np.float32((lo + hi) * 0.5)) for lo, hi in zip(low, high)]))
        cut: dict = {}
        _cut(own, 4, 1, cut)
        expected = {(tuple((lo + hi) / 2 for lo, hi in zip(low, high)), tuple(max(0.25, hi - lo) for lo, hi in zip(low, high))) for low, high, _ in cut.values()}
        mine = [r for r in got if r["scene"] == scene]
        assert {((r["rx"], r["ry"], r["rz"]), (r["size_x"], r["size_y"], r["size_z"])) for r in mine} == expected and len(mine) == len(cut)
        assert sorted(int(r["id"].split("-")[1]) for r in mine) == list(range(1, len(cut) + 1))
        depth = {p.bit_length() - 1: 1 for p in cut}
        assert {r["zone_id"] for r in mine} == ({"zone-1"} if list(depth) == [0] else {"zone-1", "zone-2"})
    assert named[1, "zone-2"]["name"] == "Zone 2" and named[3, "zone-1"]["node"] == 1
    nothing = zones.generate(triangles.where("scene > 9"), 1, 2, 0.25)
    assert nothing[0].count() == nothing[1].count() == 0
    with pytest.raises(ValueError):
        zones.generate(triangles, 7, 7, 0.25)


def test_aims_equal_trying_every_turn(spark):
    random = np.random.default_rng(3)
    size, keys = 8, []
    for cam, n in ((0, 40), (1, 5)):
        taken = sorted({tuple(int(v) for v in random.integers(0, (6, size, size))) for _ in range(n)})
        keys += [(1, cam, *t, int(random.integers(1, 20000)), int(random.integers(0, 3))) for t in taken]
    bins = spark.createDataFrame(keys, "scene long, cam_idx int, face int, x int, y int, score long, blind long")
    lenses = [(1, 0, 0.0, 0.0, 0.0, 1.0, 50.0, 1.5), (1, 1, 0.0, 1.0, 0.0, 0.0, 30.0, 1.0), (1, 2, 0.0, 0.0, 0.0, 1.0, 50.0, 1.5)]
    cameras = spark.createDataFrame(lenses, "scene long, cam_idx int, qx double, qy double, qz double, qw double, fov double, aspect double")
    found = {r["cam_idx"]: r for r in aim.propose(cameras, bins, size, 90).collect()}
    for cam in (0, 1):
        rows = [k for k in keys if k[1] == cam]
        fov, aspect, q = lenses[cam][6], lenses[cam][7], np.array([lenses[cam][2:6]])
        ways = aim.directions(*(np.array([r[k] for r in rows]) for k in (2, 3, 4)), size)
        score, blind = np.array([float(r[5]) for r in rows]), np.array([float(r[6]) for r in rows])
        # By angles of each direction in the camera's own frame.
        def taken(yaw, pitch):
            total = dark = 0.0
            cy, sy, cp, sp = math.cos(math.radians(yaw)), math.sin(math.radians(yaw)), math.cos(math.radians(pitch)), math.sin(math.radians(pitch))
            for (x, y, z), s, b in zip(ways, score, blind):
                x1, z1 = cy * x - sy * z, sy * x + cy * z
                y2, ahead = cp * y + sp * z1, -(cp * z1 - sp * y)
                up = math.tan(math.radians(fov) / 2)
                if ahead > 0 and abs(x1) <= up * aspect * ahead and abs(y2) <= up * ahead:
                    total, dark = total + s, dark + b
            return total, dark

        now = taken(180.0 if cam else 0.0, 0.0)
        r = found[cam]
        assert (r["current"] * aim.UNIT, r["now_blind"]) == now
        assert (r["best"] * aim.UNIT, r["best_blind"]) == taken(r["yaw"], r["pitch"]) and r["best_blind"] >= now[1]
        sample = [(y, p) for y in range(-180, 180, 3) for p in range(-89, 90, 4)]
        assert all(t <= r["best"] * aim.UNIT for t, dark in (taken(*c) for c in sample) if dark >= now[1])
        assert r["moved"] == (r["best"] >= 1.01 * r["current"] if r["current"] else True)
    assert found[2]["current"] == 0 and not found[2]["moved"]


def test_a_face_is_where_its_rig_camera_looks(spark):
    rows = [(0, 0, *map(float, way), 1, 0) for way in ((0, 0, -1), (-1, 0, 0), (0, 0, 1), (1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 0), (0.3, 0.4, -1), (-0.9, 1.0, -0.2), (0.2, -1.0, 0.7))]
    bins = aim.face_bins(spark.createDataFrame(rows, "scene long, cam_idx int, dx double, dy double, dz double, score long, blind long"), 64).collect()
    assert sorted(r["face"] for r in bins) == [0, 0, 1, 2, 3, 4, 4, 5, 5]
    ways = aim.directions(*(np.array([r[c] for r in bins]) for c in ("face", "x", "y")), 64)
    given = np.array([w[2:5] for w in rows if any(w[2:5])])
    given /= np.linalg.norm(given, axis=1)[:, None]
    assert all((given @ w).max() > 0.999 for w in ways)


def test_ids_are_filled_around_those_spelt_out(spark):
    rows = spark.createDataFrame([(0, 0, None), (0, 1, "geom-2"), (0, 2, ""), (0, 3, "geom-02"), (0, 4, None), (0, 5, "geom-4"), (0, 6, "geom-2"), (1, 0, None)], "scene int, pos int, id string")
    found = {(r["scene"], r["pos"]): r["id"] for r in documents.backfilled_ids(rows, "geom").collect()}
    assert found == {(0, 0): "geom-1", (0, 1): "geom-2", (0, 2): "geom-3", (0, 3): "geom-02", (0, 4): "geom-5", (0, 5): "geom-4", (0, 6): "geom-2", (1, 0): "geom-1"}


def test_edits_in_order(spark):
    rows = spark.createDataFrame([(0, "a", 0, "A", 1.0), (0, "b", 1, "B", 2.0)], "scene int, id string, pos int, name string, fov double")
    log = [(0, 5, "b", "put", None, 9.0), (0, 1, "a", "delete", None, None), (0, 2, "a", "put", "new", None), (0, 3, "c", "put", "C", 3.0), (0, 4, "c", "delete", None, None)]
    found = edits.applied(rows, spark.createDataFrame(log, "scene int, seq int, id string, action string, name string, fov double")).orderBy("pos").collect()
    assert [tuple(r) for r in found] == [(0, "b", 0, "B", 9.0), (0, "a", 1, "new", None)]
    order = edits.moved(rows.select("scene", "id", "pos"), spark.createDataFrame([(0, "a", None)], "scene int, id string, before string")).orderBy("pos")
    assert [r["id"] for r in order.collect()] == ["b", "a"]
    with pytest.raises(Exception, match="unknown action"):
        edits.applied(rows, spark.createDataFrame([(0, 1, "a", "burn", None, None)], "scene int, seq int, id string, action string, name string, fov double")).collect()


def test_camera_info_of_a_quarter_turn(spark):
    half = math.sqrt(0.5)
    rows = spark.createDataFrame([(0, 0, "cam-7", " ", [1.0000005, -0.0000004, 3.0], [0.0, half, 0.0, half], None)], "scene int, pos int, id string, name string, position array<double>, rotation array<double>, hit array<double>")
    (row,) = documents.camera_info(rows).collect()
    assert row["name"] == "Camera 7" and json.loads(row["info"])["rot"] == [0, 90, 0] and '"hit":null' in row["info"] and '"pos":[1.000001,0,3]' in row["info"]
