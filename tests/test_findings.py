"""What the review of round 3 found."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from test_compiled import COMPILED, methods
from vantagrid.operators import aggregates as A
from vantagrid.operators import grid, mesh, visibility
from vantagrid.plans import documents, meshes, queries, sections
from vantagrid.plans.queries import Room
from vantagrid.sources import assets, scene


def test_sections_ask_for_regions_of_even_number_in_every_room(spark):
    room = SimpleNamespace(spark=spark, rooms=3, space=grid.Workspace((0, 0, 0), (5, 2, 3), 0.5, 2.0))
    asked = {r["scene"]: r["mask_regions"] for r in sections._sections(room).where("section = 2").collect()}
    assert asked == {s: [n for n in range(25 * s, 25 * s + 25) if n % 2 == 0] for s in range(3)}


def broadcasts(df):
    return df._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin")


def test_what_explode_makes_is_not_broadcast(spark):
    r = Room(spark, "/root/testdata/sf0.001")
    assert broadcasts(visibility.sees(r.of(scene.points), r.of(scene.cameras), r.of(scene.triangles))) == 0
    assert broadcasts(r.valid()) == 0
    hits = visibility.nearest_hits(r.of(scene.cameras), r.of(scene.triangles))
    assert broadcasts(hits) <= 1  # extents, a row for each scene


def test_merged_meshes_are_not_broadcast(spark):
    r = Room(spark, "/root/testdata/sf0.001")
    vertices, faces = mesh.merged(*meshes._boxes(r))
    assert broadcasts(faces) == 0 and broadcasts(mesh.soup(vertices, faces)) == 0


def test_boxes_are_dealt_to_tasks(spark):
    made = scene.boxes(spark, "/root/testdata/sf0.001", scene.Layout(40, 2))
    assert made.rdd.getNumPartitions() == 10


def test_cells_are_numbered_as_voxels_are(spark):
    space = grid.Workspace((0, 0, 0), (5, 2, 3), 0.5, 2.0)
    voxels = space.voxels(spark, 2)
    assert space.numbered(voxels.select("scene", "i", "j", "k", F.col("point").alias("was"))).where("point <> was").count() == 0


def test_candidates_of_voxels_are_made_without_a_join(spark):
    """No voxel is shuffled to meet cameras, and the pairs are those of a join; rooms that the grid doesn't have see nothing."""
    r = Room(spark, "/root/testdata/sf0.001")
    space, cameras = r.space, r.of(scene.cameras)
    cameras = cameras.unionByName(cameras.withColumn("scene", F.lit(1).cast("long"))).unionByName(cameras.withColumn("scene", F.lit(7).cast("long"))).unionByName(cameras.withColumn("scene", F.lit(None).cast("long")))
    made = visibility.voxel_candidates(space, 2, cameras)
    assert "Join" not in made._jdf.queryExecution().sparkPlan().toString()
    names = ["scene", "point", "cam_idx", "i", "j", "k", "chunk_id", "x", "y", "z"]
    joined = visibility.candidates(space.voxels(spark, 2), cameras)
    found, expected = ({tuple(row) for row in rows.select(*names).collect()} for rows in (made, joined))
    assert found == expected and found and made.count() == len(found)


def test_rays_end_in_regions_and_slabs_only_where_these_alone_are_asked_for(spark):
    """The voxels that are traced are few, and all that is counted."""
    r = Room(spark, "/root/testdata/sf0.001")
    regions, slabs = r.of(scene.regions), queries.slabs(spark)
    near, every = r.region_voxels(), r.voxels()
    held = lambda points: {tuple(x) for x in A.in_regions(r.space, points, regions).select("point", "region", "x", "y", "z").collect()}
    assert held(near) == held(every) and near.count() == near.select("point").distinct().count() < every.count() / 2
    bounds = [x.asDict() for x in slabs.collect()]
    asked = {x["point"] for x in every.collect() if any(all(b[f"{c}0"] <= x[c] <= b[f"{c}1"] for c in "ijk") for b in bounds)}
    assert [x["point"] for x in A.in_slabs(every, slabs).select("point").orderBy("point").collect()] == sorted(asked)


def test_regions_that_lack_a_number_hold_no_voxel(spark):
    r = Room(spark, "/root/testdata/sf0.001")
    assert A.region_voxels(r.space, r.rooms, r.of(scene.regions).withColumn("hx", F.lit(None).cast("double"))).count() == 0


def test_lines_of_sight_are_not_broadcast(spark):
    """Spark took what is made from a small file of cameras for small."""
    r = Room(spark, "/root/testdata/sf0.001")
    seen, regions = r.traced(), r.of(scene.regions)
    for made in (A.chunk_visible(r.valid(), seen), A.region_visible(r.space, r.region_voxels(), seen, regions), A.group_visible(r.space, r.region_voxels(), seen, regions)):
        plan = made._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin [point" in plan


def test_stages_of_masks_are_compiled(spark):
    r = Room(spark, "/root/testdata/sf0.001")
    for made in (A.chunk_stats(r.masked()), r.region_voxels()):
        assert all(0 < n <= COMPILED for n in methods(made))


def test_small_files_are_decoded_in_batches_of_many():
    """a batch for each file cost six times the reading of it; a problem, a second file and a missing path keep their rows."""
    face = b"ply\nformat ascii 1.0\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n0 0 1\nnan 0 1\n5 3 1\n0 3 1\n4 0 1 2 3\n"
    parts = [p for path, content in (("a", face), ("b", b""), (None, face)) for p in assets._parts(path, content)]
    made = assets._together(parts).to_pylist()
    assert [(r["path"], r["tri_id"], r["problem"]) for r in made] == [("a", 0, None), ("a", 1, None), ("b", None, "unreadable: no PLY header"), (None, 0, None), (None, 1, None)]
    assert made[0]["bx"] != made[0]["bx"] and made[0]["cx"] == 5.0 and made[2]["ax"] is None


def test_files_of_parts_are_dealt_to_tasks(spark):
    """the table of parts is one small file, which one task read and decoded alone."""
    assert documents.s15(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_lines_are_grouped_before_their_elements_are_made(spark):
    """what is shuffled of a line is four numbers, not the lists that it stands for."""
    plan = sections._descriptors(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    grouped = next(line for line in plan.splitlines() if "collect_list" in line and "partial_" in line)
    assert "array_repeat" not in grouped
