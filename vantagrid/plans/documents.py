"""Queries over geometry, zones, volumes, captures, mesh files and exports that the driver's tables stand for, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import documents as D
from ..sources import assets, scene_files
from ..sources.tables import table
from .queries import _query
from .records import _nan, _said


def _with(rows: DataFrame, **columns: str) -> DataFrame:
    """A place and a turn for all records, and further columns, from SQL expressions."""
    given = {"position": "array(0.0D, 1.0D, 2.0D)", "rotation": "array(0.5D, 0.5D, 0.5D, 0.5D)"} | columns
    return rows.withColumns({name: F.expr(c) for name, c in given.items()})


_UNNAMED = {"name": "CAST(NULL AS STRING)", "enabled": "CAST(NULL AS BOOLEAN)"}


_GEOMETRY = f"SELECT CAST(p_partkey % 7 AS BIGINT) AS scene, CAST(p_partkey AS BIGINT) AS pos, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN concat('geom-', p_partkey % 40) ELSE concat('g', p_partkey) END AS id, CASE p_partkey % 6 WHEN 0 THEN 'gltf' WHEN 1 THEN 'mesh' WHEN 3 THEN 'room' WHEN 4 THEN 'blob' ELSE 'box' END AS kind, CASE WHEN p_partkey % 9 = 0 THEN '../x' WHEN p_partkey % 9 <> 1 THEN concat('m/', p_partkey) END AS src, CAST(CASE WHEN p_partkey % 31 = 4 THEN 0 ELSE 1 END AS DOUBLE) AS last, {_nan('p_partkey % 23 = 3')} AS half FROM part"


@_query("s5_geometry", f"""WITH g AS ({_GEOMETRY}),
spelt AS (SELECT DISTINCT scene, id FROM g WHERE id LIKE 'geom-%'),
free AS (SELECT scene, name, row_number() OVER (PARTITION BY scene ORDER BY n) AS k FROM (SELECT scene, n, 'geom-' || n AS name FROM (SELECT scene, unnest(range(1, count(*) + 50)) AS n FROM g GROUP BY scene)) AS c WHERE NOT EXISTS (SELECT 1 FROM spelt WHERE spelt.scene = c.scene AND spelt.id = c.name)),
bare AS (SELECT scene, pos, row_number() OVER (PARTITION BY scene ORDER BY pos) AS k FROM g WHERE coalesce(id, '') = ''),
named AS (SELECT g.* REPLACE (coalesce(free.name, g.id) AS id, CASE kind WHEN 'gltf' THEN 'mesh' ELSE kind END AS kind) FROM g LEFT JOIN bare USING (scene, pos) LEFT JOIN free ON free.scene = bare.scene AND free.k = bare.k)
SELECT scene, pos, id, kind, CASE WHEN last = 0 THEN 'scale components must be > 0' WHEN nth > 1 THEN 'duplicate geometry id ' || id WHEN kind = 'blob' THEN 'unknown kind' WHEN kind = 'room' AND isnan(half) THEN 'room requires numeric half_x, half_z, height, thickness' WHEN kind = 'mesh' AND src IS NULL THEN 'mesh requires a src' WHEN kind = 'mesh' AND src = '../x' THEN 'unsafe mesh src' END AS problem
FROM (SELECT *, row_number() OVER (PARTITION BY scene, id ORDER BY pos) AS nth FROM named)""")
def s5(s, d):
    sizes = {"half_x": "half", "half_z": "2.0D", "height": "3.0D", "thickness": "0.3D", "low": "array(0.0D, 0.0D, 0.0D)", "high": "array(1.0D, 1.0D, 1.0D)"}
    rows = _with(_said(s, d, "part", _GEOMETRY), scale="array(1.0D, 1.0D, last)", **sizes, **_UNNAMED)
    return D.check_geometry(rows).select("scene", "pos", "id", "kind", "problem")


_ZONES = "SELECT CAST(s_suppkey % 5 AS BIGINT) AS scene, CAST(s_suppkey AS BIGINT) AS pos, CASE WHEN s_suppkey % 9 <> 4 THEN concat('zone-', s_suppkey - CASE WHEN s_suppkey % 9 = 5 THEN 5 ELSE 0 END) END AS id, CASE WHEN s_suppkey % 3 = 0 THEN '  ' WHEN s_suppkey % 3 = 2 THEN concat(' ', s_name, ' ') END AS name, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal > 0 END AS enabled FROM supplier"


@_query("s7_zones", f"SELECT scene, pos, CASE WHEN trim(coalesce(name, '')) <> '' THEN trim(name) ELSE 'Zone ' || substr(id, 6) END AS name, coalesce(enabled, true) AS enabled, CASE WHEN id IS NULL THEN 'requires a string id' WHEN nth > 1 THEN 'duplicate zone id ' || id END AS problem FROM (SELECT *, row_number() OVER (PARTITION BY scene, id ORDER BY pos) AS nth FROM ({_ZONES}))")
def s7_zones(s, d):
    return D.check_zones(_said(s, d, "supplier", _ZONES)).select("scene", "pos", "name", "enabled", "problem")


_VOLUMES = "SELECT CAST(c_custkey % 5 AS BIGINT) AS scene, CAST(c_custkey AS BIGINT) AS pos, concat('volume-', c_custkey - CASE WHEN c_custkey % 17 = 6 THEN 5 ELSE 0 END) AS id, CASE WHEN c_custkey % 19 <> 7 THEN concat('zone-', c_custkey % 60 + CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE 0 END) END AS zone_id, CAST(CASE WHEN c_custkey % 13 = 2 THEN 0 ELSE 1.5 END AS DOUBLE) AS depth FROM customer"


@_query("s7_volumes", f"SELECT scene, pos, CASE WHEN zone_id IS NULL THEN 'requires id, zone_id, position, rotation, size' WHEN nth > 1 THEN 'duplicate volume id ' || id WHEN (scene, zone_id) NOT IN (SELECT (scene, id) FROM ({_ZONES}) WHERE id IS NOT NULL) THEN 'zone_id references no zone' WHEN depth = 0 THEN 'size components must be > 0' END AS problem FROM (SELECT *, row_number() OVER (PARTITION BY scene, id ORDER BY pos) AS nth FROM ({_VOLUMES}))")
def s7_volumes(s, d):
    rows = _with(_said(s, d, "customer", _VOLUMES), size="array(1.0D, 2.0D, depth)")
    return D.check_volumes(rows, _said(s, d, "supplier", _ZONES)).select("scene", "pos", "problem")


_CAPTURES = f"SELECT CAST(p_partkey % 3 AS BIGINT) AS scene, CAST(p_partkey AS BIGINT) AS pos, CASE WHEN p_partkey % 29 <> 1 THEN concat('splat-', p_partkey - CASE WHEN p_partkey % 11 = 5 THEN 3 ELSE 0 END) END AS id, CASE WHEN p_partkey % 7 = 0 THEN concat('/', p_name) WHEN p_partkey % 7 <> 1 THEN concat('s/', p_name) END AS src, CASE WHEN p_partkey % 13 = 4 THEN CAST(-1 AS DOUBLE) ELSE {_nan('p_partkey % 17 = 2')} END AS scale FROM part"


@_query("s7_captures", f"SELECT scene, pos, CASE WHEN id IS NULL THEN 'requires a string id' WHEN nth > 1 THEN 'duplicate splat id ' || id WHEN src IS NULL THEN 'requires a string src' WHEN src LIKE '/%' THEN 'unsafe splat src' WHEN isnan(scale) OR scale <= 0 THEN 'scale must be a number > 0' END AS problem FROM (SELECT *, row_number() OVER (PARTITION BY scene, id ORDER BY pos) AS nth FROM ({_CAPTURES}))")
def s7_captures(s, d):
    rows = _with(_said(s, d, "part", _CAPTURES), **_UNNAMED)
    return D.check_captures(rows).select("scene", "pos", "problem")


#: A task decodes so many small files, where there are enough of them: the table of parts is one small file.
TASK_FILES = 20_000
_LF, _CRLF = "chr(10)", "concat(chr(13), chr(10))"
_HEADERS = f"SELECT o_orderkey, concat_ws(CASE WHEN o_orderkey % 2 = 1 THEN {_CRLF} ELSE {_LF} END, CASE WHEN o_orderkey % 6 = 3 THEN 'plyx' ELSE 'ply' END, concat('comment ', repeat('x', CAST(o_orderkey % 4300 AS INT))), 'element vertex 3', CASE o_orderkey % 6 WHEN 1 THEN 'property float opacity' WHEN 5 THEN 'property float my_opacity' ELSE 'property float x' END, CASE o_orderkey % 6 WHEN 2 THEN 'comment element face' WHEN 5 THEN '  element  face 0 ' ELSE 'element face 1' END, CASE WHEN o_orderkey % 6 = 4 THEN 'end' ELSE 'end_header' END, '') AS head FROM orders"


@_query("s16_ply_kinds", f"SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (3, 4) OR strpos(head, 'end_header') + 9 > 4096 THEN 'unreadable' WHEN o_orderkey % 6 = 1 THEN 'splat' WHEN o_orderkey % 6 = 2 THEN 'points' ELSE 'mesh' END AS kind FROM ({_HEADERS})")
def s16(s, d):
    return _said(s, d, "orders", _HEADERS).select("o_orderkey", assets.ply_kind(F.encode("head", "UTF-8")).alias("kind"))


_FILES = "SELECT concat('parts/', p_partkey, '.ply') AS path, concat_ws(chr(10), 'ply', 'format ascii 1.0', 'element vertex 4', 'property float x', 'property float y', 'property float z', concat('element face ', CASE WHEN p_partkey % 10 = 9 THEN '0' ELSE '1' END), 'property list uchar int vertex_indices', 'end_header', '0 0 1', concat(p_size, ' 0 1'), concat(p_size, ' ', p_partkey % 7 + 1, ' 1'), concat('0 ', p_partkey % 7 + 1, ' 1'), CASE WHEN p_partkey % 10 = 9 THEN '' ELSE '4 0 1 2 3' END) AS text FROM part"
_QUAD = {"ax": "0", "ay": "0", "az": "1", "bx": "p_size", "by": "CASE t WHEN 0 THEN 0 ELSE p_partkey % 7 + 1 END", "bz": "1", "cx": "CASE t WHEN 0 THEN p_size ELSE 0 END", "cy": "p_partkey % 7 + 1", "cz": "1"}


@_query("s15_meshes", "SELECT 'parts/' || p_partkey || '.ply' AS path, CASE WHEN p_partkey % 10 <> 9 THEN t END AS tri_id, " + ", ".join(f"CASE WHEN p_partkey % 10 <> 9 THEN CAST({v} AS DOUBLE) END AS {n}" for n, v in _QUAD.items()) + ", CASE WHEN p_partkey % 10 = 9 THEN 'no faces' END AS problem FROM part, (SELECT unnest([0, 1])::BIGINT AS t) WHERE p_partkey % 10 <> 9 OR t = 0")
def s15(s, d):
    """Every part as a mesh file of one square."""
    files = _said(s, d, "part", _FILES).select("path", F.encode("text", "UTF-8").alias("content"))
    return assets.decode_meshes(files.repartition(max(s.sparkContext.defaultParallelism, table(s, d, "part").count() // TASK_FILES), "path"))


_TURNS = "SELECT CAST(c_nationkey AS BIGINT) AS scene, CAST(c_custkey AS BIGINT) AS pos, concat('cam-', c_custkey) AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS name, c_custkey % 359 - 179 AS a, c_custkey % 179 - 89 AS b, c_custkey % 353 - 176 AS c, CAST(c_custkey % 97 - 40 AS DOUBLE) / 8 AS x, CAST(c_custkey % 9 AS DOUBLE) AS y FROM customer"
_TEXT = lambda e: f"regexp_replace(CAST(CAST({e} AS DECIMAL(18, 6)) AS VARCHAR), '[.]?0+$', '')"


@_query("s17_camera_info", f"SELECT scene, pos, coalesce(name, 'Camera ' || substr(id, 5)) AS name, '{{\"pos\":[' || {_TEXT('x')} || ',' || {_TEXT('y')} || ',0],\"rot\":[' || a || ',' || b || ',' || c || '],\"hit\":' || CASE WHEN pos % 3 = 0 THEN 'null' ELSE '[1,' || {_TEXT('x')} || ',-2.5]' END || '}}' AS info FROM ({_TURNS})")
def s17(s, d):
    rows = _said(s, d, "customer", _TURNS)
    (s1, c1), (s2, c2), (s3, c3) = ((F.sin(F.radians(n) / 2), F.cos(F.radians(n) / 2)) for n in "abc")
    turn = F.array(s1 * c2 * c3 + c1 * s2 * s3, c1 * s2 * c3 - s1 * c2 * s3, c1 * c2 * s3 + s1 * s2 * c3, c1 * c2 * c3 - s1 * s2 * s3)
    hit = F.when(F.col("pos") % 3 != 0, F.array(F.lit(1.0), F.col("x"), F.lit(-2.5)))
    return D.camera_info(rows.withColumns({"position": F.array("x", "y", F.lit(0.0)), "rotation": turn, "hit": hit}))


_LENSES = f"SELECT CAST(s_suppkey AS BIGINT) AS pos, CASE WHEN s_suppkey % 10 = 1 THEN '  ' ELSE concat(' cam-', s_suppkey) END AS id, CAST(CASE WHEN s_suppkey % 10 = 2 THEN 0 ELSE s_suppkey % 4 + 1 END AS DOUBLE) AS w, CAST(CASE WHEN s_suppkey % 10 = 3 THEN 180 ELSE 60 END AS DOUBLE) AS fov, CASE WHEN s_suppkey % 10 = 4 THEN CAST(0 AS DOUBLE) END AS aspect, CASE WHEN s_suppkey % 10 = 5 THEN {_nan('true')} WHEN s_suppkey % 10 > 5 THEN CAST(0.5 AS DOUBLE) END AS near, CASE s_suppkey % 10 WHEN 7 THEN CAST(0.5 AS DOUBLE) WHEN 8 THEN CAST(9 AS DOUBLE) END AS far FROM supplier"


@_query("s18_export_cameras", f"SELECT pos, trim(id) AS id, CASE WHEN w > 0 THEN 1.0::DOUBLE END AS turn_w, round(coalesce(aspect, 16.0::DOUBLE / 9), 9) AS aspect, coalesce(far, 1000) AS far, CASE pos % 10 WHEN 1 THEN 'id must be a non-empty string' WHEN 2 THEN 'rotation must be a non-zero quaternion' WHEN 3 THEN 'fov must be a number in (0, 180)' WHEN 4 THEN 'aspect must be a positive number' WHEN 5 THEN 'near must be a positive number' WHEN 7 THEN 'far must be greater than near' END AS problem FROM ({_LENSES})")
def s18(s, d):
    rows = _with(_said(s, d, "supplier", _LENSES), rotation="array(0.0D, 0.0D, 0.0D, w)", **_UNNAMED)
    return D.export_cameras(rows).select("pos", "id", F.get("rotation", 3).alias("turn_w"), F.round("aspect", 9).alias("aspect"), "far", "problem")


@_query("s18_notices", "SELECT CAST(n_nationkey AS BIGINT) AS scene, CASE WHEN v < 1 THEN 'formatVersion must be a positive integer' END AS problem, array_to_string(list_filter([CASE WHEN v > 2 THEN 'formatVersion ' || v || ' is newer than known' END, CASE WHEN n_nationkey % 4 = 1 OR n_nationkey NOT IN (SELECT c_nationkey FROM customer) THEN 'no cameras' END], lambda x: x IS NOT NULL), '; ') AS notices FROM (SELECT *, n_nationkey % 5 AS v FROM nation)")
def s18_notices(s, d):
    documents = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("scene"), (F.col("n_nationkey") % 5).alias("version"))
    cameras = table(s, d, "customer").where("c_nationkey % 4 <> 1").select(F.col("c_nationkey").cast("long").alias("scene"))
    return D.export_notices(documents, cameras)


_ALIGNED = f"SELECT event_id, CAST(event_id % 3 AS DOUBLE) AS z, CAST(event_id % 2 AS DOUBLE) * 4 AS w, CASE WHEN event_id % 7 = 0 THEN CAST(-1 AS DOUBLE) ELSE {_nan('event_id % 7 = 1')} END AS scale FROM events"


@_query("s19_alignments", f"SELECT event_id, CASE WHEN z + w > 0 THEN round(z / sqrt(z * z + w * w), 9) END AS turn_z, z > 0 AND w = 0 AS flipped, CASE WHEN z + w = 0 THEN 'rotation must be a non-zero quaternion' WHEN event_id % 7 < 2 THEN 'scale must be a positive number' END AS problem FROM ({_ALIGNED})")
def s19(s, d):
    rows = _with(_said(s, d, "events", _ALIGNED), rotation="array(0.0D, 0.0D, z, w)")
    return D.check_alignments(rows).select("event_id", F.round(F.get("rotation", 2), 9).alias("turn_z"), "flipped", "problem")


@_query("s20_manifest", "SELECT CAST(s_suppkey AS BIGINT) AS pos, CASE WHEN s_suppkey % 2 = 0 THEN 25.0::DOUBLE ELSE 8 + s_nationkey END AS far_rendered, CASE WHEN s_suppkey % 2 = 0 THEN '{\"far_override\":25.0,\"format\":\"png\",\"generator\":\"export\"}' ELSE '{\"format\":\"jpeg\",\"generator\":\"export\",\"quality\":0.9}' END AS render FROM supplier")
def s20(s, d):
    rows = table(s, d, "supplier").select(F.col("s_suppkey").cast("long").alias("pos"), (8.0 + F.col("s_nationkey")).alias("far"))
    plain = D.manifest(rows.where("pos % 2 = 0"), {"format": "png", "quality": 0.9, "far_override": 25.0}, "export")
    lossy = D.manifest(rows.where("pos % 2 = 1"), {"format": "jpeg", "quality": 0.9, "far_override": None}, "export")
    return plain.unionByName(lossy).select("pos", "far_rendered", "render")


_FAULTS = """WITH c AS (SELECT CAST(c_nationkey AS BIGINT) AS scene, c_custkey % 67 = 7 AS bad, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS pos FROM customer),
v AS (SELECT CAST(s_nationkey AS BIGINT) AS scene, s_suppkey % 17 = 11 AS bad, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS pos FROM supplier),
n AS (SELECT CAST(n_nationkey AS BIGINT) AS scene, CASE WHEN n_nationkey % 9 = 4 THEN 7 ELSE 1 + n_nationkey % 4 END AS version FROM nation),
cs AS (SELECT scene, count(*) AS cameras, min(pos) FILTER (bad) AS wrong FROM c GROUP BY scene), vs AS (SELECT scene, count(*) AS volumes, min(pos) FILTER (bad) AS wrong FROM v GROUP BY scene),
p AS (SELECT n.scene, CASE WHEN version = 7 THEN 'unsupported scene.json formatVersion "7" (expected 1 or 2 or 3 or 4)' WHEN cs.wrong IS NOT NULL THEN 'cameras[' || cs.wrong || ']: requires id, position, rotation, fov' WHEN vs.wrong IS NOT NULL THEN 'volumes[' || vs.wrong || ']: zone_id references no zone' END AS problem, coalesce(cameras, 0) AS cameras, coalesce(volumes, 0) AS volumes FROM n LEFT JOIN cs ON cs.scene = n.scene LEFT JOIN vs ON vs.scene = n.scene)
SELECT scene, problem, CASE WHEN problem IS NULL THEN cameras ELSE 0 END AS cameras, CASE WHEN problem IS NULL THEN volumes ELSE 0 END AS volumes, CAST(CASE WHEN problem IS NULL THEN 3 ELSE 0 END AS BIGINT) AS zones FROM p"""


def _texts(s, d) -> DataFrame:
    """One document for each nation: its customers as cameras, some without a lens, and its suppliers as volumes, some of a zone that isn't there."""
    place = (F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0)).alias("position"), F.array(*map(F.lit, (0.0, 0.0, 0.0, 1.0))).alias("rotation"))
    listed = lambda rows, key, made: rows.groupBy(F.col(key).cast("long").alias("scene")).agg(F.sort_array(F.collect_list(F.struct("at", made.alias("r")))).alias("all")).select("scene", F.transform("all", lambda x: x["r"]).alias("list"))
    camera = F.struct(F.concat(F.lit("cam-"), "at").alias("id"), *place, F.when(F.col("at") % 67 != 7, F.lit(60.0)).alias("fov"))
    volume = F.struct(F.concat(F.lit("volume-"), "at").alias("id"), F.when(F.col("at") % 17 == 11, F.lit("zone-9")).otherwise(F.concat(F.lit("zone-"), F.col("at") % 3)).alias("zoneId"), *place, F.array(*[F.lit(1.5)] * 3).alias("size"))
    cameras = listed(table(s, d, "customer").withColumn("at", F.col("c_custkey").cast("long")), "c_nationkey", camera).withColumnRenamed("list", "cameras")
    volumes = listed(table(s, d, "supplier").withColumn("at", F.col("s_suppkey").cast("long")), "s_nationkey", volume).withColumnRenamed("list", "volumes")
    rows = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("scene"), F.expr("CASE WHEN n_nationkey % 9 = 4 THEN 7 ELSE 1 + n_nationkey % 4 END").alias("formatVersion"))
    rows = rows.join(cameras, "scene", "left").join(volumes, "scene", "left")
    none = lambda c: F.coalesce(c, F.array().cast(dict(rows.dtypes)[c])).alias(c)
    empty = F.array().cast("array<string>")
    zones = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct(F.concat(F.lit("zone-"), i).alias("id")))
    return rows.select("scene", F.to_json(F.struct("formatVersion", none("cameras"), none("volumes"), *(empty.alias(n) for n in ("geometry", "probes", "sections")), zones.alias("zones"))).alias("document"))


@_query("s4_documents", _FAULTS)
def s4(s, d):
    """Whole documents: those with a reason against them have no records at all."""
    read = scene_files.Documents(_texts(s, d))
    out = read.problems()
    for name in ("cameras", "volumes", "zones"):
        out = out.join(read.records(name).groupBy("scene").agg(F.count("*").alias(name)), "scene", "left")
    return out.fillna(0, ["cameras", "volumes", "zones"])


@_query("s10_written", "SELECT scene, problem, cameras, volumes, zones FROM (" + _FAULTS + ") WHERE problem IS NULL")
def s10(s, d):
    """The documents that are taken over, written and read again."""
    read = scene_files.Documents(_texts(s, d))
    again = scene_files.Documents(scene_files.written(read.good(), read.records))
    out = again.problems()
    for name in ("cameras", "volumes", "zones"):
        out = out.join(again.records(name).groupBy("scene").agg(F.count("*").alias(name)), "scene", "left")
    return out.fillna(0, ["cameras", "volumes", "zones"])
