"""Scene documents as a whole, on documents made by hand."""

import copy
import json

import pytest

from vantagrid.sources import scene_files

T = [0, 0.5, 0]
Q = [0, 0, 0, 1]


def good():
    return {
        "formatVersion": 4,
        "geometry": [{"kind": "room", "position": T, "rotation": Q, "scale": [1, 1, 1], "halfX": 4, "halfZ": 3, "height": 2.5, "thickness": 0.2}, {"id": "geom-1", "kind": "mesh", "src": "a/b.ply", "position": T, "rotation": Q, "scale": [1, 2, 1], "enabled": False}],
        "cameras": [{"id": "cam-1", "name": " A ", "position": T, "rotation": Q, "fov": 60, "constraintId": "con-1"}, {"id": "cam-2", "position": T, "rotation": Q, "fov": 50.5, "near": 0.2, "enabled": False, "aimLocked": True}],
        "probes": [{"id": "cam-1", "position": T}],
        "sections": [{"id": "s", "orientation": "horizontal", "min": 0, "max": 1, "aggregation": "mean", "visible": True}],
        "clipSectionId": "s", "useZones": True,
        "zones": [{"id": "z1"}, {"id": "z2", "enabled": False, "name": "Hall"}],
        "volumes": [{"id": "v", "zoneId": "z1", "position": T, "rotation": Q, "size": [1, 1, 2]}],
        "constraintGroups": [{"id": "g", "zoneIds": ["z2", "gone", "z2"], "fov": 60, "far": 9, "poolSize": 10, "maxCount": 3, "trials": 5, "epsilon": 0.5, "seed": 1}],
        "constraints": [{"id": "con-1", "groupId": "g", "kind": "polyline", "distance": 0, "points": [T, [1, 0, 0]]}],
        "splats": [{"id": "sp", "src": "c.ply", "position": T, "rotation": Q, "scale": 1}],
    }


def changed(path, value):
    doc = copy.deepcopy(good())
    at = doc
    for p in path[:-1]:
        at = at[p]
    if value is ...:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return doc


CASES = [
    (good(), None), ("[1, 2]", "scene.json must be a JSON object"), ("", "scene.json must be a JSON object"), ("{", "scene.json must be a JSON object"), (None, "scene.json must be a JSON object"),
    (changed(["formatVersion"], 5), 'unsupported scene.json formatVersion "5" (expected 1 or 2 or 3 or 4)'), (changed(["formatVersion"], "4"), 'unsupported scene.json formatVersion "4" (expected 1 or 2 or 3 or 4)'), (changed(["formatVersion"], ...), 'unsupported scene.json formatVersion "undefined" (expected 1 or 2 or 3 or 4)'),
    (changed(["cameras"], {}), "cameras must be an array"), (changed(["probes"], ...), "probes must be an array"), (changed(["zones"], "x"), "zones must be an array"),
    (changed(["geometry", 1, "scale"], [1, 0, 1]), "geometry[1]: scale components must be > 0"), (changed(["geometry", 1, "src"], "../x.ply"), "geometry[1]: unsafe mesh src"), (changed(["geometry", 0, "kind"], "cone"), "geometry[0]: unknown kind"),
    (changed(["cameras", 1, "id"], "cam-1"), "duplicate camera id cam-1"), (changed(["cameras", 1, "fov"], "60"), "cameras[1]: requires id, position, rotation, fov"), (changed(["cameras", 0, "aspect"], "1.5"), "cameras[0]: aspect must be a number"),
    (changed(["cameras", 0, "far"], None), "cameras[0]: far must be a number"), (changed(["cameras", 1, "enabled"], "no"), "cameras[1]: enabled must be a boolean"), (changed(["cameras", 1, "aimLocked"], 1), "cameras[1]: aimLocked must be a boolean"), (changed(["cameras", 0, "id"], 7), "cameras[0]: requires id, position, rotation, fov"),
    (changed(["cameras", 0, "constraintId"], "con-9"), 'camera "cam-1": constraintId "con-9" references no constraint'), (changed(["volumes", 0, "zoneId"], "z9"), "volumes[0]: zone_id references no zone"), (changed(["useZones"], "yes"), "useZones must be a boolean"),
    (changed(["constraints", 0, "groupId"], "h"), "constraints[0]: group_id references no constraint group"), (changed(["constraintGroups", 0, "fov"], 180), "constraintGroups[0]: fov must be in (0, 180)"), (changed(["splats", 0, "scale"], 0), "splats[0]: scale must be a number > 0"),
]


@pytest.fixture(scope="module")
def documents(spark):
    old = changed(["formatVersion"], 1)
    for name in ("zones", "volumes", "useZones", "constraintGroups", "constraints", "splats"):
        del old[name]
    del old["cameras"][0]["constraintId"]
    old["geometry"][1]["kind"] = "gltf"
    two = changed(["volumes", 0, "size"], [0, 1, 1])  # two things wrong: the earlier section counts
    two["cameras"][1]["fov"] = None
    rows = [(i, json.dumps(d) if isinstance(d, dict) else d) for i, (d, _) in enumerate(CASES)]
    rows += [(100, json.dumps(old)), (101, json.dumps(two)), (102, json.dumps(changed(["clipSectionId"], "gone")))]
    return scene_files.Documents(spark.createDataFrame(rows, "scene long, document string").repartition(3).cache())


def test_the_first_reason_refuses_a_document(documents):
    found = {r["scene"]: r["problem"] for r in documents.problems().collect()}
    for i, (_, reason) in enumerate(CASES):
        assert found[i] == reason, i
    assert found[100] is None and found[101] == "cameras[1]: requires id, position, rotation, fov" and found[102] is None


def test_records_of_refused_documents_are_not_there(documents):
    assert {r["scene"] for r in documents.records("cameras").collect()} == {0, 100, 102}
    cameras = {(r["scene"], r["id"]): r for r in documents.records("cameras").collect()}
    assert (cameras[0, "cam-2"]["near"], cameras[0, "cam-2"]["enabled"], cameras[0, "cam-2"]["aim_locked"], cameras[0, "cam-1"]["enabled"]) == (0.2, False, True, True)
    assert {(r["scene"], r["pos"]): (r["id"], r["kind"]) for r in documents.records("geometry").where("scene <> 102").collect()} == {(s, p): (("geom-2", "room"), ("geom-1", "mesh"))[p] for s in (0, 100) for p in (0, 1)}
    assert [r["zone_ids"] for r in documents.records("constraintGroups").where("scene = 0").collect()] == [["z2"]]
    assert {r["scene"]: (r["use_zones"], r["clip_section_id"]) for r in documents.good().collect()} == {0: (True, "s"), 100: (False, "s"), 102: (True, None)}
    assert documents.records("zones").where("scene = 100").count() == 0 and [r["enabled"] for r in documents.records("sections").where("scene = 0").collect()] == [True]


def test_documents_go_round(documents):
    out = scene_files.written(documents.good(), documents.records)
    texts = {r["scene"]: json.loads(r["document"]) for r in out.collect()}
    doc = texts[0]
    assert doc["formatVersion"] == 4 and doc["cameras"][0]["name"] == "A" and "enabled" not in doc["cameras"][0] and doc["cameras"][1]["enabled"] is False and "name" not in doc["cameras"][1]
    assert texts[100]["zones"] == [] and texts[100]["geometry"][1]["kind"] == "mesh" and "clipSectionId" not in texts[102]
    again = scene_files.Documents(out)
    assert {r["problem"] for r in again.problems().collect()} == {None}
    for section in scene_files.FIELDS:
        key = lambda df: sorted(str(tuple(r)) for r in df.collect())
        assert key(again.records(section)) == key(documents.records(section)), section


def test_texts_are_read_from_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(good()))
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "note.txt").write_text("no scene")
    rows = scene_files.read_texts(spark, str(tmp_path)).selectExpr("path AS scene", "document")
    found = {r["scene"].rsplit("/", 1)[-1]: r["problem"] for r in scene_files.Documents(rows).problems().collect()}
    assert found == {"a.json": None, "b.json": "scene.json must be a JSON object"}
