"""Geometry of documents from files, and folders of documents."""

import json

import pytest

from vantagrid.sources import assembly, scene_files

PLY = "ply\nformat ascii 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_index\nend_header\n0 0 0\n1 0 0\n0 1 0\n3 0 1 2\n"
Q = [0, 0, 0, 1]


def thing(kind, at=(0, 0, 0), scale=(1, 1, 1), **more):
    return {"kind": kind, "position": list(at), "rotation": Q, "scale": list(scale)} | more


def document(*geometry, **more):
    return {"formatVersion": 4, "geometry": list(geometry), "cameras": [], "probes": [], "sections": []} | more


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "one.ply").write_text(PLY)
    (tmp_path / "m" / "broken.ply").write_text("no mesh")
    return tmp_path


def read(spark, *documents):
    return scene_files.Documents(spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(documents)], "scene long, document string"))


def test_enabled_objects_make_the_scene(spark, folder):
    room = thing("room", halfX=2, halfZ=1, height=3, thickness=0.5)
    box = thing("box", (10, 0, 0), (2, 1, 1), min=[0, 0, 0], max=[1, 1, 1])
    asleep = thing("mesh", src="m/broken.ply", enabled=False)
    docs = read(spark, document(room, box, asleep), document(thing("mesh", (5, 0, 0), (1, 2, 1), src="m/one.ply"), thing("mesh", src="m/one.ply"), asleep), document(asleep), document(box, thing("mesh", src="m/broken.ply")), document(box, thing("mesh", src="m/gone.ply")))
    triangles, problems = assembly.assemble(docs.records("geometry"), str(folder))
    rows = triangles.collect()
    count = lambda s: len([r for r in rows if r["scene"] == s])
    assert [count(s) for s in range(5)] == [5 * 12 + 12, 2, 0, 0, 0]  # what is switched off isn't missed, what is broken is
    assert len({(r["scene"], r["tri_id"]) for r in rows}) == len(rows)
    assert {(r["scene"], r["id"]): r["problem"][:10] for r in problems.collect()} == {(3, "geom-2"): "unreadable", (4, "geom-2"): "not found"}
    moved = sorted((r["ax"], r["bx"], r["cy"]) for r in rows if r["scene"] == 1)
    assert moved == [(0.0, 1.0, 1.0), (5.0, 6.0, 2.0)]
    ends = {r["scene"]: tuple(r)[1:] for r in assembly.extents(docs.good(), triangles, 0.0).collect()}
    assert ends[0][1] == 12.0 and ends[1][:2] == (0.0, 6.0) and ends[2] == (-10.0, 10.0, 0.0, 5.0, -10.0, 10.0)


def test_a_moved_object_is_placed_from_what_is_kept(spark, folder, monkeypatch):
    first = assembly.assemble(read(spark, document(thing("mesh", src="m/one.ply"))).records("geometry"), str(folder))[0]
    assert first.count() == 1
    monkeypatch.setattr(assembly, "decode_meshes", lambda files: 1 / 0)
    (row,) = assembly.assemble(read(spark, document(thing("mesh", (7, 0, 0), src="m/one.ply"))).records("geometry"), str(folder))[0].collect()
    assert row["ax"] == 7.0


def test_a_folder_of_documents(spark, folder):
    splat = {"id": "s", "src": "m/one.ply", "position": [0, 0, 0], "rotation": Q, "scale": 1}
    (folder / "a.json").write_text(json.dumps(document(thing("mesh", src="m/x.ply"), thing("mesh", src="m/x.ply", enabled=False), zones=[{"id": "z"}], splats=[splat])))
    (folder / "b.json").write_text("{")
    (folder / "c.json").write_text("")
    (folder / "d.json").write_text(json.dumps(document()))
    texts = scene_files.read_texts(spark, str(folder)).selectExpr("path AS scene", "document")
    docs = scene_files.Documents(texts)
    found = {r["scene"].rsplit("/", 1)[-1]: tuple(r)[1:] for r in assembly.catalogue(docs).collect()}
    broken = ("scene.json must be a JSON object", None, None, None)
    assert found == {"a.json": (None, 2, 0, 1), "b.json": broken, "c.json": broken, "d.json": (None, 0, 0, 0)}
    assert sorted(r["src"] for r in assembly.copy_plan(docs).collect()) == ["m/one.ply", "m/x.ply"]
