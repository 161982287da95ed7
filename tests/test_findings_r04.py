"""What the review of round 4 found."""

from pyspark.sql import functions as F

from test_findings import broadcasts
from vantagrid.functions import geometry as G
from vantagrid.operators import aggregates as A
from vantagrid.operators import grid, visibility
from vantagrid.operators import records as R
from vantagrid.plans import layout, queries, records, sections
from vantagrid.plans.queries import Room
from vantagrid.sources import scene


def test_steps_of_the_fill_are_not_broadcast(spark, monkeypatch):
    """steps are small as files, so Spark passed them whole through the driver."""
    steps, keep = [], grid.checkpointed
    monkeypatch.setattr(grid, "checkpointed", lambda df: steps.append(broadcasts(df)) or keep(df))
    r = Room(spark, "/root/testdata/sf0.001")
    assert grid.occupancy(r.space, r.of(scene.triangles), True).where("kind = 2").count() > 0
    assert len(steps) > 4 and not any(steps)


def test_cameras_in_boxes_are_found_without_a_broadcast(spark):
    """boxes, and what they occupy, met the cameras by broadcast."""
    assert broadcasts(queries.f12(spark, "/root/testdata/sf0.001")) == 0


def test_starts_of_draws_are_hashed_once(spark):
    """the hash of a constraint's id was worked out again for every digit of every draw."""
    plan = layout.r7_draws(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("utf-16be") + plan.count("UTF-16BE") == 1


def test_inverses_of_batches_are_those_of_columns(spark):
    rows = spark.range(0, 3000, 7).select((F.col("id") * F.col("id") * 104729).alias("i")).union(spark.sql("SELECT CAST(NULL AS BIGINT)"))
    bases = (2, 3, 5, 7, 11)
    same = F.lit(True)
    for n, b in enumerate(bases):
        same = same & F.get("h", n).eqNullSafe(G.halton(F.col("i"), b))
    assert rows.withColumn("h", G.inverses(F.col("i"), bases)).where(~same).count() == 0


def test_draws_around_mounts_meet_volumes_without_a_broadcast(spark):
    """all draws around all mounts were broadcast to meet all volumes of their scenes."""
    assert broadcasts(records.j9(spark, "/root/testdata/sf0.001")) == 0


def test_volumes_that_are_left_out_hold_no_draw(spark):
    """near, far, turned and stretched volumes, with what a plain join of all pairs finds."""
    mounts = spark.sql("SELECT CAST(id % 3 AS BIGINT) AS scene, concat('con-', id) AS id, 0.7D * id AS px, 1.0D AS py, 0.3D * (id % 5) AS pz, CAST(id % 4 AS DOUBLE) AS distance, id * 7 + 1 AS start FROM range(24)")
    turned = "CASE id % 3 WHEN 0 THEN 1.0D WHEN 1 THEN 0.8D ELSE 0.5D END"
    volumes = spark.sql(f"SELECT CAST(id % 3 AS BIGINT) AS scene, 1.1D * id AS rx, 1.2D AS ry, 0.5D AS rz, 0.9D AS hx, 0.4D AS hy, 1.3D AS hz, 0.0D AS rqx, CASE id % 3 WHEN 1 THEN 0.6D ELSE 0.0D END AS rqy, 0.0D AS rqz, {turned} AS rqw FROM range(15)")
    draws = mounts.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(255))))
    off = G.ball_point(F.col("start") + F.col("draw"), 1.0, R.BALL_BASES)
    at = G.add(G.vec("px", "py", "pz"), tuple(F.col("distance") * c for c in off))
    hits = draws.join(volumes, "scene").where(G.in_box(at, G.vec("rx", "ry", "rz"), G.vec("hx", "hy", "hz"), [F.col(f"rq{a}") for a in "xyzw"]))
    expected = {r["id"]: r["n"] / 256 for r in hits.groupBy("id").agg(F.count_distinct("draw").alias("n")).collect()}
    found = {r["id"]: r["share"] for r in R.mount_overlap(mounts, volumes).collect()}
    assert len(found) == 24 and {k: v for k, v in found.items() if v} == expected and 0 < len(expected) < 24


def behind_the_shuffle(df):
    """What stands in the plan between the join of rays with what hides them and the first shuffle of rays."""
    lines = df.select("*")._jdf.queryExecution().executedPlan().toString().splitlines()
    join = next(n for n, line in enumerate(lines) if "LeftAnti" in line and "tile_u" in line)
    return lines[join : next(n for n in range(join, len(lines)) if "Exchange hashpartitioning" in lines[n])]


def test_rays_are_made_behind_the_shuffle(spark):
    """Cameras are dealt to tiles and make their rays there; before, every ray was shuffled."""
    r = Room(spark, "/root/testdata/sf0.001")
    cameras, triangles = r.of(scene.cameras), r.of(scene.triangles)
    sampled = visibility.sees_voxels_by_samples(r.space, r.rooms, cameras, triangles, 4)
    for made in (r.traced(), sampled):
        assert sum("Generate explode" in line for line in behind_the_shuffle(made)) >= 3
    found, expected = ({tuple(x) for x in rows.collect()} for rows in (r.traced(), visibility.sees(r.voxels(), cameras, triangles)))
    assert found == expected and found
    found, expected = ({tuple(x) for x in rows.collect()} for rows in (sampled, visibility.sees_by_samples(r.voxels(), cameras, triangles, r.space.voxel, 4)))
    assert found == expected and found


def test_chunks_are_counted_without_their_voxels(spark):
    """Statistics of chunks shuffled all voxels of all dirty chunks, several times."""
    r = Room(spark, "/root/testdata/sf0.001")
    cameras, chunks = r.of(scene.cameras), r.chunks()
    rows = lambda df: {x["chunk_id"]: (x["valid"], x["covered"]) for x in df.collect()}
    expected = rows(r.run(r.valid(), cameras))
    assert rows(r.run_chunks(chunks, cameras)) == expected and any(n for _, n in expected.values())
    some = chunks.where("chunk_id % 3 = 1")
    made = r.run_chunks(some, cameras)
    assert rows(made) == {k: v for k, v in expected.items() if k % 3 == 1}
    assert f"Range (0, {r.space.size * r.rooms}," not in made._jdf.queryExecution().optimizedPlan().toString()


def test_words_of_wide_chunks(spark):
    space = grid.Workspace((0, 0, 0), (200, 2, 90), 1.0, 100.0)
    made = space.words(space.voxels(spark, 2)).groupBy("chunk_id", "line", "part").agg(F.count("*").alias("n"), F.bit_count(F.bit_or("bit")).alias("b")).where("n <> b OR n > 64")
    assert made.count() == 0


def test_zones_are_compared_on_their_own_voxels(spark, monkeypatch):
    """masks of all voxels were made and kept twice, though zones count those in regions alone."""
    monkeypatch.setattr(Room, "kept_masked", None)
    monkeypatch.setattr(Room, "traced", None)
    assert queries.a21(spark, "/root/testdata/sf0.001").count() > 0


def test_voxels_without_a_word_are_made_last(spark):
    """all voxels were shuffled to meet masks that few of them have; now no voxel is but those that are seen or in geometry."""
    r = Room(spark, "/root/testdata/sf0.001")
    every = r.every()
    assert every.count() == every.select("point").distinct().count() == r.voxels().count()
    assert every.select(*r.voxels().columns).exceptAll(r.voxels()).isEmpty()
    masked = r.masked().select("point", "mask", "mask_high")
    assert every.where("valid").select("point", "mask", "mask_high").exceptAll(masked).isEmpty() and every.where("valid").count() == masked.count()
    wide = grid.Workspace((0, 0, 0), (150, 2, 90), 1.0, 100.0)
    told = wide.voxels(spark, 2).where("point % 7 = 3")
    assert sorted(x["point"] for x in wide.others(told, 2).collect()) == [n for n in range(2 * wide.size) if n % 7 != 3]
    plan = queries.w11(spark, "/root/testdata/sf0.001").select("*")._jdf.queryExecution().optimizedPlan().toString()
    assert f"Range (0, {r.space.size * r.rooms}," not in plan


def test_cubes_are_grouped_before_the_shuffle(spark):
    """a window over every cell shuffled and sorted each of them, for each level."""
    cells = grid.Workspace((0, 0, 0), (5, 4, 6), 1.0, 6.0).voxels(spark, 2).withColumn("cameras", F.when((F.col("i") == 1) & (F.col("j") < 2), 3).otherwise(200).cast("long"))
    made = A.cubes(cells, 1)
    assert "Window" not in made._jdf.queryExecution().optimizedPlan().toString()
    found = {tuple(x) for x in made.collect()}
    expected, blocks = set(), {}
    for x in cells.collect():
        blocks.setdefault((x["scene"], x["i"] // 2, x["j"] // 2, x["k"] // 2), []).append((x["scene"], x["i"], x["j"], x["k"], 1, x["cameras"]))
    for key, rows in blocks.items():
        expected |= {(*key, 2, rows[0][5])} if len(rows) == 8 and len({x[5] for x in rows}) == 1 else set(rows)
    assert found == expected and {x[4] for x in found} == {1, 2}


def test_sections_meet_words_not_voxels(spark):
    """all voxels were shuffled to meet masks, regions and slabs, one after the other."""
    r = Room(spark, "/root/testdata/sf0.001")
    columns = sections._columns(r)[2]
    assert broadcasts(columns) == 0
    assert f"Range (0, {r.space.size * r.rooms}," not in columns.select("*")._jdf.queryExecution().optimizedPlan().toString()
