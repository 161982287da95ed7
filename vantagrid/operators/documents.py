"""The rest of a scene document's records (geometry, zones, volumes, captures), and what other tools read and write.

As in ``records``: relations carry their ``scene`` and ``pos``, and ``problem`` has the first reason, null for a good record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.display import label, safe_asset_path
from .records import _first_reason, _numbers, finite, unique_ids

EXPORT_ASPECT, EXPORT_NEAR, EXPORT_FAR = 16 / 9, 0.1, 1000.0
KNOWN_VERSIONS = (1, 2)
LEAST_TURN = 1e-8


def _then(rows: DataFrame, *checks: tuple[Column, str]) -> DataFrame:
    """Further checks, for records that have no problem yet."""
    return rows.withColumn("problem", F.coalesce("problem", _first_reason(*checks)))


def backfilled_ids(rows: DataFrame, prefix: str) -> DataFrame:
    """Records without an id (null or empty) get ``prefix-N``, in order of ``pos``, with the smallest N that no record spells out."""
    named = F.col("id").isNotNull() & (F.col("id") != "")
    own = Window.partitionBy("scene")
    number = F.regexp_extract("id", f"^{prefix}-([1-9][0-9]{{0,17}})$", 1)
    spelt = rows.where(named & (number != "")).select("scene", number.cast("long").alias("n")).distinct()
    # So many numbers lie free below the j-th spelt one; the record that needs more of them passes it.
    spelt = spelt.withColumn("_at", F.col("n") - F.row_number().over(own.orderBy("n")) + 1)
    bare = rows.where(~named).select("scene", "pos", F.row_number().over(own.orderBy("pos")).cast("long").alias("_at"))
    both = bare.withColumn("_spelt", F.lit(0)).unionByName(spelt.select("scene", F.lit(None).cast("long").alias("pos"), "_at", F.lit(1).alias("_spelt")))
    passed = F.sum("_spelt").over(own.orderBy("_at", F.desc("_spelt")).rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("_given", F.concat(F.lit(f"{prefix}-"), (F.col("_at") + passed).cast("string"))).where("pos IS NOT NULL").select("scene", "pos", "_given")
    return rows.join(found, ["scene", "pos"], "left").withColumn("id", F.coalesce("_given", "id")).select(*rows.columns)


def check_geometry(rows: DataFrame) -> DataFrame:
    """Geometry (scene, pos, id, name, enabled, kind, position, rotation, scale, half_x, half_z, height, thickness, low, high, src).

    Missing ids are filled in, names trimmed, ``enabled`` is true by default, and the old kind ``gltf`` reads as ``mesh``.
    """
    rows = backfilled_ids(rows, "geom")
    rows = rows.withColumns({"kind": F.when(F.col("kind") == "gltf", F.lit("mesh")).otherwise(F.col("kind")), "name": F.trim(F.coalesce("name", F.lit(""))), "enabled": F.coalesce("enabled", F.lit(True))})
    moved = _numbers(F.col("position"), 3) & _numbers(F.col("rotation"), 4) & (F.size("scale") == 3)
    rows = rows.withColumn("problem", _first_reason((moved, "missing or invalid position/rotation/scale"), (F.forall("scale", lambda x: finite(x) & (x > 0)), "scale components must be > 0")))
    rows = unique_ids(rows, "geometry")
    is_kind = lambda k: F.coalesce(F.col("kind") == k, F.lit(False))
    room = finite(F.col("half_x")) & finite(F.col("half_z")) & finite(F.col("height")) & finite(F.col("thickness"))
    return _then(
        rows,
        (F.col("kind").isin("room", "box", "mesh"), "unknown kind"),
        (~is_kind("room") | room, "room requires numeric half_x, half_z, height, thickness"),
        (~is_kind("box") | (_numbers(F.col("low"), 3) & _numbers(F.col("high"), 3)), "box requires min and max"),
        (~is_kind("mesh") | F.col("src").isNotNull(), "mesh requires a src"),
        (~is_kind("mesh") | safe_asset_path(F.col("src")), "unsafe mesh src"),
    )


def check_zones(rows: DataFrame) -> DataFrame:
    """Zones (scene, pos, id, name, enabled); a blank name is no problem, the zone's number stands in."""
    rows = rows.withColumn("problem", _first_reason((F.col("id").isNotNull(), "requires a string id")))
    named = label(F.col("name"), F.col("id"), "zone", "Zone")
    return unique_ids(rows, "zone").withColumns({"name": named, "enabled": F.coalesce("enabled", F.lit(True))})


def check_volumes(rows: DataFrame, zones: DataFrame) -> DataFrame:
    """Volumes (scene, pos, id, zone_id, position, rotation, size), each of a zone of its scene."""
    needed = F.col("id").isNotNull() & F.col("zone_id").isNotNull() & _numbers(F.col("position"), 3) & _numbers(F.col("rotation"), 4) & _numbers(F.col("size"), 3)
    rows = unique_ids(rows.withColumn("problem", _first_reason((needed, "requires id, zone_id, position, rotation, size"))), "volume")
    known = zones.select("scene", F.col("id").alias("zone_id")).distinct().withColumn("_known", F.lit(True))
    rows = rows.join(known, ["scene", "zone_id"], "left")
    return _then(rows, (F.col("_known"), "zone_id references no zone"), (F.forall("size", lambda x: x > 0), "size components must be > 0")).drop("_known")


def check_captures(rows: DataFrame) -> DataFrame:
    """Point captures (scene, pos, id, name, src, enabled, position, rotation, scale); the file itself isn't looked for."""
    rows = unique_ids(rows.withColumn("problem", _first_reason((F.col("id").isNotNull(), "requires a string id"))), "splat")
    scale = finite(F.col("scale")) & (F.col("scale") > 0)
    rows = _then(rows, (F.col("src").isNotNull(), "requires a string src"), (safe_asset_path(F.col("src")), "unsafe splat src"), (_numbers(F.col("position"), 3), "position must be [x,y,z]"), (_numbers(F.col("rotation"), 4), "rotation must be [x,y,z,w]"), (scale, "scale must be a number > 0"))
    return rows.withColumns({"name": F.trim(F.coalesce("name", F.lit(""))), "enabled": F.coalesce("enabled", F.lit(True))})


def _unit(rotation: Column) -> Column:
    """The quaternion at length one; null where it has next to no length."""
    size = F.sqrt(F.aggregate(rotation, F.lit(0.0), lambda t, x: t + x * x))
    return F.when(finite(size) & (size >= LEAST_TURN), F.transform(rotation, lambda x: x / size))


def export_cameras(rows: DataFrame) -> DataFrame:
    """Cameras as the image exporter takes them: stricter lenses, rotations at length one, and a far plane of 1000 by default."""
    held = lambda c: F.col(c).isNull()
    near = F.coalesce("near", F.lit(EXPORT_NEAR))
    checks = [
        (F.trim("id") != "", "id must be a non-empty string"),
        (_numbers(F.col("position"), 3), "position must be 3 finite numbers"),
        (_numbers(F.col("rotation"), 4), "rotation must be 4 finite numbers"),
        (_unit(F.col("rotation")).isNotNull(), "rotation must be a non-zero quaternion"),
        (finite(F.col("fov")) & (F.col("fov") > 0) & (F.col("fov") < 180), "fov must be a number in (0, 180)"),
        (held("aspect") | (finite(F.col("aspect")) & (F.col("aspect") > 0)), "aspect must be a positive number"),
        (held("near") | (finite(F.col("near")) & (F.col("near") > 0)), "near must be a positive number"),
        (held("far") | finite(F.col("far")), "far must be a number"),
        (held("far") | (F.col("far") > near), "far must be greater than near"),
    ]
    rows = rows.withColumn("problem", _first_reason(*checks))
    read = {"id": F.trim("id"), "name": F.trim(F.coalesce("name", F.lit(""))), "rotation": _unit(F.col("rotation")), "aspect": F.coalesce("aspect", F.lit(EXPORT_ASPECT)), "near": near, "far": F.coalesce("far", F.lit(EXPORT_FAR)), "enabled": F.coalesce("enabled", F.lit(True))}
    return rows.withColumns(read)


def export_notices(documents: DataFrame, cameras: DataFrame) -> DataFrame:
    """What to tell about documents (scene, version): a refusal for a version that isn't a positive number, notices for newer ones and for no cameras."""
    counts = cameras.groupBy("scene").agg(F.count("*").alias("_n"))
    rows = documents.join(counts, "scene", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    newer = F.when((F.col("version") >= 1) & ~F.col("version").isin(*KNOWN_VERSIONS), F.concat(F.lit("formatVersion "), F.col("version").cast("string"), F.lit(" is newer than known")))
    notices = F.filter(F.array(newer, F.when(F.col("_n") == 0, F.lit("no cameras"))), lambda x: x.isNotNull())
    wrong = _first_reason((F.col("version") >= 1, "formatVersion must be a positive integer"))
    return rows.select("scene", wrong.alias("problem"), F.array_join(notices, "; ").alias("notices"))


def check_alignments(rows: DataFrame) -> DataFrame:
    """Alignments (position, rotation, scale) with ``problem``, the rotation at length one, and whether it is the half turn about z."""
    turn = _unit(F.col("rotation"))
    scale = finite(F.col("scale")) & (F.col("scale") > 0)
    rows = rows.withColumn("problem", _first_reason((_numbers(F.col("position"), 3), "position must be 3 finite numbers"), (_numbers(F.col("rotation"), 4), "rotation must be 4 finite numbers"), (turn.isNotNull(), "rotation must be a non-zero quaternion"), (scale, "scale must be a positive number")))
    return rows.withColumn("rotation", turn).withColumn("flipped", F.coalesce(F.abs(F.abs(F.get("rotation", 2)) - 1) < 1e-6, F.lit(False)))


def _six_places(c: Column) -> Column:
    """A number as JSON has it, half a millionth rounded up, without trailing zeros."""
    exact = (F.floor(c * 1e6 + 0.5).cast("double") / 1e6).cast("decimal(24,6)").cast("string")
    return F.regexp_replace(exact, "\\.?0+$", "")


def _triple(numbers: list[Column]) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *map(_six_places, numbers)), F.lit("]"))


def xyz_euler(q: list[Column]) -> list[Column]:
    """Degrees about x, then the new y, then the new z; at a quarter turn about y, z takes none."""
    x, y, z, w = q
    sine = F.least(F.greatest(2 * (x * z + w * y), F.lit(-1.0)), F.lit(1.0))
    free = F.abs(sine) < 0.9999999
    first = F.when(free, F.atan2(-2 * (y * z - w * x), 1 - 2 * (x * x + y * y))).otherwise(F.atan2(2 * (y * z + w * x), 1 - 2 * (x * x + z * z)))
    last = F.when(free, F.atan2(-2 * (x * y - w * z), 1 - 2 * (y * y + z * z))).otherwise(F.lit(0.0))
    return [F.degrees(first), F.degrees(F.asin(sine)), F.degrees(last)]


def camera_info(cameras: DataFrame) -> DataFrame:
    """scene, pos, name and ``info`` (JSON text) of cameras (scene, pos, id, name, position, rotation, hit); a ray that hits nothing has a null hit."""
    part = lambda c, n: [F.get(F.col(c), i) for i in range(n)]
    hit = F.when(F.col("hit").isNull(), F.lit("null")).otherwise(_triple(part("hit", 3)))
    info = F.concat(F.lit('{"pos":'), _triple(part("position", 3)), F.lit(',"rot":'), _triple(xyz_euler(part("rotation", 4))), F.lit(',"hit":'), hit, F.lit("}"))
    return cameras.select("scene", "pos", label(F.col("name"), F.col("id"), "cam", "Camera").alias("name"), info.alias("info"))


def write_camera_info(info: DataFrame, path: str) -> None:
    """JSON lines of name and info, a folder for each scene."""
    info.select("scene", "name", "info").write.partitionBy("scene").mode("overwrite").json(path)


def manifest(cameras: DataFrame, settings: dict, generator: str) -> DataFrame:
    """One row for each exported camera (scene, pos, file, id, ..., width, height), and what it was rendered with.

    A far override replaces the camera's own far plane; quality is told of lossy images only.
    """
    lossy = settings.get("format") == "jpeg"
    told = {"generator": generator, **{k: v for k, v in settings.items() if k != "quality" or lossy}}
    override = settings.get("far_override")
    far = F.col("far") if override is None else F.lit(float(override))
    return cameras.withColumn("far_rendered", far).withColumn("render", F.to_json(F.struct(*(F.lit(v).alias(k) for k, v in sorted(told.items()) if v is not None))))
