"""Descriptors that are wrong in one thing, sections with gaps and filters, groups and zones that draw."""

import pytest

from vantagrid.operators import descriptors as D
from vantagrid.operators import gates, grid
from vantagrid.operators import sections as S

NAN = float("nan")
UNIT = [0.0, 0.0, 0.0, 1.0]
REGION = ([0.0, 0.0, 0.0], [1.0, 1.0, 1.0], UNIT, [0.0, 31.0])
SLAB = (1.0, [[0.0, 3.0]] * 3, [0.0])
PROJECTION = (128.0, [0.0] * 16, 1.0, [], [[1.0] * 3] * 2)


def descriptor(**with_):
    base = {"scene": 0, "num_cameras": 2, "regions": [REGION], "slabs": [SLAB], "leaf_mask": [0.0], "probes": [[1.0, 2.0, 3.0]], "projections": [PROJECTION], "camera_words": [3]}
    return tuple((base | with_).values())


def changed(row, n, value):
    return row[:n] + (value,) + row[n + 1 :]


WRONG = [
    ({}, None, None),
    ({"regions": None, "slabs": None, "leaf_mask": None, "probes": None, "projections": None, "camera_words": None}, None, None),
    ({"regions": [REGION] * 64}, None, None),
    ({"regions": [REGION] * 65}, "AGGREGATE_TOO_LARGE", "regions: 65 of at most 64"),
    ({"regions": [REGION, changed(REGION, 0, [0.0, NAN, 0.0])]}, "INVALID_AGGREGATE", "regions[1] centre must be three numbers"),
    ({"regions": [changed(REGION, 1, [1.0, 1.0])]}, "INVALID_AGGREGATE", "regions[0] half must be three numbers"),
    ({"regions": [changed(REGION, 1, [1.0, 0.0, 1.0])]}, "INVALID_AGGREGATE", "regions[0] half must be positive"),
    ({"regions": [changed(REGION, 2, [0.0, 0.0, float("inf"), 1.0])]}, "INVALID_AGGREGATE", "regions[0] rotation must be four numbers"),
    ({"regions": [changed(REGION, 3, [32.0])]}, "INVALID_AGGREGATE", "regions[0] groups must lie in 0 to 31"),
    ({"regions": [changed(REGION, 3, [0.5])]}, "INVALID_AGGREGATE", "regions[0] groups must lie in 0 to 31"),
    ({"slabs": [SLAB] * 33}, "AGGREGATE_TOO_LARGE", "slabs: 33 of at most 32"),
    ({"slabs": [changed(SLAB, 0, 3.0)]}, "INVALID_AGGREGATE", "slabs[0] axis must be 0, 1 or 2"),
    ({"slabs": [SLAB, changed(SLAB, 1, [[0.0, 1.0]] * 2)]}, "INVALID_AGGREGATE", "slabs[1] range must cover three axes"),
    ({"slabs": [changed(SLAB, 1, [[0.0, 1.5]] * 3)]}, "INVALID_AGGREGATE", "slabs[0] range must hold pairs of integers"),
    ({"slabs": [changed(SLAB, 1, [[2.0, 1.0]] * 3)]}, "INVALID_AGGREGATE", "slabs[0] range is empty"),
    ({"slabs": [changed(SLAB, 2, [1.0])]}, "INVALID_AGGREGATE", "slabs[0] mask names no region"),
    ({"leaf_mask": [-1.0]}, "INVALID_AGGREGATE", "leaf_mask names no region"),
    ({"regions": [], "slabs": [], "leaf_mask": [0.0]}, "INVALID_AGGREGATE", "leaf_mask names no region"),
    ({"probes": [[0.0] * 3] * 256}, None, None),
    ({"probes": [[0.0] * 3] * 257}, "AGGREGATE_TOO_LARGE", "probes: 257 of at most 256"),
    ({"probes": [[0.0, None, 0.0]]}, "INVALID_AGGREGATE", "probes[0] must be three numbers"),
    ({"projections": [PROJECTION] * 9}, "AGGREGATE_TOO_LARGE", "projections: 9 of at most 8"),
    ({"projections": [changed(PROJECTION, 0, 0.0)]}, "INVALID_AGGREGATE", "projections[0] bins must lie in 1 to 128"),
    ({"projections": [changed(PROJECTION, 1, [0.0] * 15)]}, "INVALID_AGGREGATE", "projections[0] matrix must be sixteen numbers"),
    ({"projections": [changed(PROJECTION, 2, -1.0)]}, "INVALID_AGGREGATE", "projections[0] camera must be 0 or more"),
    ({"projections": [changed(PROJECTION, 2, 2.0)]}, "INVALID_AGGREGATE", "projections[0] camera isn't in the run"),
    ({"projections": [changed(PROJECTION, 2, 2.0)], "num_cameras": None}, None, None),
    ({"projections": [changed(PROJECTION, 3, [9.0])]}, "INVALID_AGGREGATE", "projections[0] mask names no region"),
    ({"projections": [changed(PROJECTION, 4, [])]}, "INVALID_AGGREGATE", "projections[0] weights must hold 1 to 4 tables"),
    ({"projections": [changed(PROJECTION, 4, [[1.0] * 3, [1.0] * 2])]}, "INVALID_AGGREGATE", "projections[0] weights must be of one length"),
    ({"projections": [changed(PROJECTION, 4, [[1.0] * 2])]}, "INVALID_AGGREGATE", "projections[0] weights need an entry more than there are cameras"),
    ({"camera_words": [1, 2]}, "INVALID_AGGREGATE", "camera_words must hold 1"),
    ({"camera_words": [1, 2], "num_cameras": None}, None, None),
    ({"regions": [changed(REGION, 3, [40.0])], "probes": [[NAN] * 3]}, "INVALID_AGGREGATE", "regions[0] groups must lie in 0 to 31"),
]


def test_the_first_thing_wrong_with_a_descriptor(spark):
    rows = [changed(descriptor(**w), 0, n) for n, (w, _, _) in enumerate(WRONG)]
    told = {r["scene"]: (r["code"], r["problem"]) for r in D.check_descriptors(spark.createDataFrame(rows, D.SCHEMA)).collect()}
    assert told == {n: (code, why) for n, (_, code, why) in enumerate(WRONG)}


def test_a_wrong_descriptor_fails_the_job_and_an_empty_one_is_told(spark):
    good = D.accepted(spark.createDataFrame([descriptor()], D.SCHEMA))
    assert [f.name for f in good.schema] == [c.split()[0] for c in ("scene", "num_cameras", "regions", "slabs", "leaf_mask", "probes", "projections", "camera_words")] and good.count() == 1
    with pytest.raises(Exception, match="AGGREGATE_TOO_LARGE: probes: 257 of at most 256"):
        D.accepted(spark.createDataFrame([descriptor(probes=[[0.0] * 3] * 257)], D.SCHEMA)).collect()
    nothing = {"regions": [], "slabs": None, "leaf_mask": None, "probes": [], "projections": None}
    rows = [descriptor(scene=0, **nothing), descriptor(scene=1, **(nothing | {"leaf_mask": []})), descriptor(scene=2, **(nothing | {"probes": [[0.0] * 3]}))]
    assert {r["scene"]: r["empty"] for r in D.asks_nothing(spark.createDataFrame(rows, D.SCHEMA)).collect()} == {0: True, 1: False, 2: False}


@pytest.fixture(scope="module")
def rooms(spark):
    """Two rooms of 8 x 2 x 6 cells, the second lacks a chunk; cells seen by both cameras, by one or by none."""
    space = grid.Workspace((0.0, 0.0, 0.0), (4.0, 1.0, 3.0), 0.5, 2.0)
    cells = space.voxels(spark, 2).where("NOT (scene = 1 AND chunk_id % 4 = 3)")
    cells = cells.selectExpr("scene", "chunk_id", "i", "j", "k", "CASE WHEN i < 2 THEN 3L WHEN i < 4 AND j = 0 THEN 1L ELSE 0L END AS mask", "0L AS mask_high", "CASE WHEN k = 5 THEN array(7L) WHEN k = 4 THEN array(7L, 8L) END AS regions", "i != 6 AS valid")
    cells = cells.selectExpr("*", "CASE mask WHEN 3 THEN 2L ELSE mask END AS cameras")
    made = "scene long, section int, orientation string, min double, max double, min_a double, max_a double, min_b double, max_b double, mask_regions array<long>, aggregation string"
    rows = [(s, n, o, 0.0, a, 0.0, b, 0.0, c, mask, agg) for s in (0, 1) for n, o, a, b, c, mask, agg in [(0, "horizontal", 1.0, 4.0, 3.0, [], "mean"), (1, "vertical-x", 4.0, 3.0, 1.0, None, "min"), (2, "vertical-z", 3.0, 4.0, 1.0, [8], "blind")]]
    sections = spark.createDataFrame(rows, made)
    cameras = spark.createDataFrame([(s, c, not (s == 1 and c == 1)) for s in (0, 1) for c in (0, 1)], "scene long, cam_idx int, enabled boolean")
    slabs = S.section_slabs(space, sections)
    grid_ = S.section_grid(S.section_columns(space, cells, slabs), slabs, cameras.groupBy("scene").count().withColumnRenamed("count", "n"))
    return cells, sections, cameras, slabs, grid_


def test_slabs_of_sections(rooms):
    slabs = {r["section"]: r for r in rooms[3].where("scene = 0").collect()}
    ends = lambda r: [(r[f"{c}0"], r[f"{c}1"]) for c in "ijk"]
    assert all(ends(r) == [(0, 7), (0, 1), (0, 5)] for r in slabs.values())
    assert [(slabs[n]["axis"], slabs[n]["length"], slabs[n]["transposed"]) for n in range(3)] == [(1, 2, False), (0, 8, True), (2, 6, False)]


def test_cells_of_sections_against_a_plain_run(rooms):
    cells, _, _, _, grid_ = rooms
    plain = {}
    for c in cells.collect():
        for section, (u, v), mask in ((0, (c["i"], c["k"]), []), (1, (c["k"], c["j"]), []), (2, (c["i"], c["j"]), [8])):
            plain.setdefault((c["scene"], section, u, v), []).append((c["valid"], not mask or bool(set(mask) & set(c["regions"] or [])), c["cameras"], c["mask"]))
    length = {0: 2, 1: 8, 2: 6}
    found = {(r["scene"], r["section"], r["u"], r["v"]): r for r in grid_.collect()}
    assert set(found) == set(plain)
    for key, column in plain.items():
        counts = [n for valid, taken, n, _ in column if valid and taken]
        r, some, missing = found[key], bool(counts), len(column) < length[key[1]]
        assert (r["coloured"], r["no_data"]) == (some, missing)
        assert r["black"] == (not some and not missing and any(taken and not valid for valid, taken, _, _ in column))
        want = (sum(counts) / (2 * len(counts)), max(counts) / 2, min(counts) / 2, counts.count(0) / len(counts)) if some else (0.0,) * 4
        assert (r["mean"], r["most"], r["least"], r["blind_share"]) == pytest.approx(want)
        word = 0
        for valid, taken, _, m in column:
            word |= m if valid and taken else 0
        assert r["seen"] == word
    assert any(r["no_data"] for r in found.values()) and any(r["black"] for r in found.values())


def test_figures_of_sections(spark, rooms):
    _, sections, cameras, _, grid_ = rooms
    cells = grid_.collect()
    shows = {"mean": "mean", "min": "least", "blind": "blind_share"}
    figures = {(r["scene"], r["section"]): r for r in S.section_figures(grid_, sections).collect()}
    shares = {(r["scene"], r["section"], r["cam_idx"]): r["share"] for r in S.section_cameras(grid_, sections, cameras).collect()}
    assert (1, 0, 1) not in shares and len(shares) == 9
    for s in sections.collect():
        mine = [c for c in cells if (c["scene"], c["section"]) == (s["scene"], s["section"])]
        lit, r = [c for c in mine if c["coloured"]], figures[s["scene"], s["section"]]
        assert (r["total_cells"], r["valid_cells"], r["obstacle_cells"]) == (len(lit) + sum(c["black"] for c in mine), len(lit), sum(c["black"] for c in mine))
        assert r["coverage"] == pytest.approx(sum(c["mean"] for c in lit) / len(lit)) and r["badge"] == pytest.approx(sum(c[shows[s["aggregation"]]] for c in lit) / len(lit))
        assert r["blind_cells"] == sum(c["blind_share"] == 1 for c in lit) and r["blind_pct"] == pytest.approx(r["blind_cells"] / len(lit))
        assert shares[s["scene"], s["section"], 0] == pytest.approx(sum(c["seen"] & 1 for c in lit) / len(lit))
    nothing = S.section_figures(grid_.limit(0), sections).collect()
    assert all(r["total_cells"] == 0 and r["coverage"] == 0 and r["blind_pct"] == 0 for r in nothing) and len(nothing) == 6


def test_a_scene_with_a_slab_too_many_fails(spark, rooms):
    from vantagrid.operators.grid import Workspace

    cells, sections, _, _, _ = rooms
    space = Workspace((0.0, 0.0, 0.0), (4.0, 1.0, 3.0), 0.5, 2.0)
    many = sections.where("scene = 0 AND section = 0").selectExpr("scene", "explode(sequence(0, 32)) AS section", "orientation", "min", "max", "min_a", "max_a", "min_b", "max_b", "mask_regions", "aggregation")
    with pytest.raises(Exception, match="AGGREGATE_TOO_LARGE"):
        S.section_columns(space, cells, S.section_slabs(space, many)).collect()


def test_groups_and_zones_that_draw(spark):
    groups = spark.createDataFrame([(0, "a", True, ["z1"]), (0, "b", False, ["z2", "gone"]), (0, "c", False, ["z3"]), (1, "a", False, ["z1"])], "scene long, group_id string, enabled boolean, zone_ids array<string>")
    zones = spark.createDataFrame([(s, z, z == "z4") for s in (0, 1) for z in ("z1", "z2", "z3", "z4")], "scene long, zone_id string, enabled boolean")
    placing = spark.createDataFrame([(0, "b"), (1, None)], "scene long, group_id string")
    drawable = gates.drawable_groups(groups, placing)
    assert sorted(map(tuple, drawable.collect())) == [(0, "a"), (0, "b")]
    drawn = gates.visible_zones(zones, groups, drawable)
    assert sorted(map(tuple, drawn.collect())) == [(0, "gone"), (0, "z1"), (0, "z2"), (0, "z4"), (1, "z4")]
    volumes = spark.createDataFrame([(0, "z1", 1), (0, "z1", 2), (0, "z3", 3), (1, "z1", 4), (1, "z4", 5)], "scene long, zone_id string, v long")
    assert sorted(r["v"] for r in gates.volumes_of_zones(volumes, drawn).collect()) == [1, 2, 5]
    assert gates.volumes_of_zones(volumes, drawn.limit(0)).count() == 0
    geometry = spark.createDataFrame([(0, True), (0, False), (1, False)], "scene long, enabled boolean")
    assert sorted(map(tuple, gates.run_blockers(zones.select("scene").union(spark.range(2, 3)), geometry).collect())) == [(0, None), (1, "no_geometry"), (2, "no_geometry")]
