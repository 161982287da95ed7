"""Records of scene documents on hand-made rows."""

import math

from pyspark.sql import functions as F

from vantagrid.functions import display, geometry
from vantagrid.operators import records


def test_file_names_never_collide(spark):
    labels = ["a", "a-2", "A", "a", " con ", "con", "...", None, "x/y", "tab\there"]
    rows = spark.createDataFrame([(0, i, f"cam-{i}", n) for i, n in enumerate(labels)], "scene int, pos int, id string, label string")
    found = [r["file"] for r in records.file_names(rows, "png").orderBy("pos").collect()]
    # " con " has blanks around it, which become signs that fall off.
    assert found[:6] == ["a.png", "a-2.png", "A-3.png", "a-4.png", "_con.png", "_con-2.png"]
    assert found[6:] == ["cam-6.png", "cam-7.png", "x-y.png", "tab-here.png"]
    assert len({f.lower() for f in found}) == len(found)


def test_problems_of_odd_records(spark):
    schema = "scene int, pos int, id string, position array<double>, rotation array<double>, fov double, aspect double, near double, far double, enabled boolean"
    good = ([0.0, 0.0, 0.0], [0.0, 0.0, 0.0, 1.0], 60.0, None, None, None, None)
    rows = [(0, 0, "a", *good), (0, 1, "a", *good), (1, 2, "a", *good), (0, 3, "b", [0.0, math.nan, 0.0], *good[1:]), (0, 4, "c", *good[:3], math.inf, None, None, False), (0, 5, "d", None, *good[1:])]
    found = {r["pos"]: (r["problem"], r["enabled"]) for r in records.check_cameras(spark.createDataFrame(rows, schema)).collect()}
    needed = "requires id, position, rotation, fov"
    assert found == {0: (None, True), 1: ("duplicate camera id a", True), 2: (None, True), 3: (needed, True), 4: ("aspect must be a number", False), 5: (needed, True)}
    assert records.check_cameras(spark.createDataFrame([], schema)).count() == 0


def test_mount_overlap_equals_counting(spark):
    mounts = spark.createDataFrame([(0, "a", 0.0, 0.0, 0.0, 2.0, 5), (0, "b", 50.0, 0.0, 0.0, 1.0, 9), (1, "a", 0.0, 0.0, 0.0, 1.0, 5)], "scene int, id string, px double, py double, pz double, distance double, start int")
    box = (0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 1.0)
    volumes = spark.createDataFrame([(0, *box), (0, 0.5, *box[1:])], "scene int, " + ", ".join(f"{k}{a} double" for k in ("r", "h", "rq") for a in "xyz") + ", rqw double")

    def inverse(i, base):
        out, part = 0.0, 1.0
        while i:
            part /= base
            out += part * (i % base)
            i //= base
        return out

    hits = 0
    for k in range(records.DRAWS):
        far, height, turn = inverse(5 + k, 5) ** (1 / 3), 2 * inverse(5 + k, 7) - 1, 2 * math.pi * inverse(5 + k, 11)
        flat = far * math.sqrt(1 - height * height)
        x, y, z = 2 * flat * math.cos(turn), 2 * far * height, 2 * flat * math.sin(turn)
        hits += abs(y) <= 1 and abs(z) <= 1 and (abs(x) <= 1 or abs(x - 0.5) <= 1)
    found = {(r["scene"], r["id"]): r["share"] for r in records.mount_overlap(mounts, volumes).collect()}
    assert found == {(0, "a"): hits / records.DRAWS, (0, "b"): 0.0, (1, "a"): 0.0} and hits > 0


def test_looking_straight_up_keeps_no_roll(spark):
    q = geometry.euler_quaternion(F.lit(30.0), F.lit(90.0), F.lit(0.0))
    yaw, pitch, roll = spark.range(1).select(*geometry.quaternion_euler(q)).first()
    assert round(yaw, 6) == 30 and round(pitch, 4) == 90 and roll == 0


def test_caps_and_choices(spark):
    rows = spark.createDataFrame([(0, i, 5 - i % 3) for i in range(6)], "scene int, pos int, n int")
    assert [tuple(r) for r in records.within_cap(rows.select("scene", "pos"), 4, "pos").orderBy("pos").collect()] == [(0, i, 2) for i in range(4)]
    assert tuple(records.best_samples(rows, ["scene"], "n", "pos").first()) == (0, 5, 0)
    assert tuple(records.nearest(rows, ["scene"], "n", "pos").first()) == (0, 3, 2)
    assert records.best_samples(rows.withColumn("n", F.lit(0)), ["scene"], "n", "pos").count() == 0
