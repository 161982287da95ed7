"""Queries over records of scene documents that the driver's tables stand for, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import display as D
from ..functions import geometry as G
from ..operators import records as R
from ..sources import scene
from ..sources.tables import table
from .queries import Room, _query


def _said(s, d, name: str, sql: str) -> DataFrame:
    """The same SQL that the oracle runs, over one table."""
    return s.sql(sql.replace(f"FROM {name}", "FROM {t}"), t=table(s, d, name))


def _nan(c: str) -> str:
    return f"CAST(CASE WHEN {c} THEN 'NaN' ELSE '1.5' END AS DOUBLE)"


_PATHS = "SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN concat('/', p_name) WHEN 1 THEN concat('meshes/../', p_name) WHEN 2 THEN concat('file:', p_name) WHEN 3 THEN concat('meshes//', p_name) WHEN 4 THEN '' WHEN 5 THEN concat('meshes', chr(92), p_name) WHEN 6 THEN concat('./', p_name) ELSE concat('meshes/', p_name) END AS src FROM part"


@_query("s11_asset_paths", f"SELECT p_partkey, src <> '' AND src NOT LIKE '/%' AND src NOT LIKE '%//%' AND src NOT LIKE '%/' AND position(chr(92) IN src) = 0 AND NOT regexp_matches(src, '^[a-zA-Z][a-zA-Z0-9+.-]*:') AND NOT regexp_matches(src, '(^|/)[.][.]?(/|$)') AS safe FROM ({_PATHS})")
def s11(s, d):
    return _said(s, d, "part", _PATHS).select("p_partkey", D.safe_asset_path(F.col("src")).alias("safe"))


_NAMED = "SELECT CAST(c_nationkey AS BIGINT) AS scene, CAST(c_custkey AS BIGINT) AS pos, CASE WHEN c_custkey % 3 = 0 THEN concat('cam-', c_custkey) ELSE concat('c', c_custkey) END AS id, CASE WHEN c_custkey % 4 = 0 THEN '  ' WHEN c_custkey % 4 = 1 THEN NULL ELSE concat(' ', c_mktsegment, ' ') END AS name FROM customer"


@_query("x14_labels", f"SELECT pos, CASE WHEN trim(coalesce(name, '')) <> '' THEN trim(name) WHEN id LIKE 'cam-%' THEN 'Camera ' || substr(id, 5) ELSE id END AS label FROM ({_NAMED})")
def x14(s, d):
    return _said(s, d, "customer", _NAMED).select("pos", D.label(F.col("name"), F.col("id"), "cam", "Camera").alias("label"))


@_query("x19_next_ids", f"SELECT scene, 'cam-' || (coalesce(max(TRY_CAST(substr(id, 5) AS BIGINT)) FILTER (id LIKE 'cam-%'), 0) + 1) AS next_id FROM ({_NAMED}) GROUP BY scene")
def x19(s, d):
    return R.next_ids(_said(s, d, "customer", _NAMED), "cam")


_RIGS = "SELECT CAST(s_suppkey // 100 AS BIGINT) AS scene, CAST(s_suppkey AS BIGINT) AS pos, concat('cam-', s_suppkey) AS id, CASE WHEN s_suppkey % 5 = 0 THEN concat('Gate: ', s_nationkey) WHEN s_suppkey % 5 = 1 THEN concat('GATE? ', s_nationkey) WHEN s_suppkey % 5 = 2 THEN 'lpt1' ELSE concat('..', s_name, '-') END AS label FROM supplier"


@_query("s21_file_names", f"SELECT scene, pos, id, stem || CASE WHEN n > 1 THEN '-' || n ELSE '' END || '.png' AS file FROM (SELECT *, row_number() OVER (PARTITION BY scene, lower(stem) ORDER BY pos) AS n FROM (SELECT *, CASE WHEN label = 'lpt1' THEN '_lpt1' ELSE regexp_replace(regexp_replace(regexp_replace(label, '[ :?#]', CASE WHEN label LIKE '%#%' THEN '#' ELSE '-' END, 'g'), '-+', '-', 'g'), '^[.-]+|[.-]+$', '', 'g') END AS stem FROM ({_RIGS})))")
def s21(s, d):
    return R.file_names(_said(s, d, "supplier", _RIGS.replace("//", "div")), "png")


_CAMERAS = f"SELECT CAST(s_suppkey // 100 AS BIGINT) AS scene, CAST(s_suppkey AS BIGINT) AS pos, CASE WHEN s_suppkey % 11 = 3 THEN NULL ELSE concat('cam-', s_suppkey - CASE WHEN s_suppkey % 7 = 1 THEN 1 ELSE 0 END) END AS id, {_nan('s_suppkey % 13 = 5')} AS fov, {_nan('s_suppkey % 17 = 5')} AS far, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal > 0 END AS enabled FROM supplier"


@_query("s6_cameras", f"SELECT scene, pos, coalesce(enabled, true) AS enabled, CASE WHEN id IS NULL OR isnan(fov) THEN 'requires id, position, rotation, fov' WHEN isnan(far) THEN 'far must be a number' WHEN nth > 1 THEN 'duplicate camera id ' || id END AS problem FROM (SELECT *, row_number() OVER (PARTITION BY scene, id ORDER BY pos) AS nth FROM ({_CAMERAS}))")
def s6(s, d):
    rows = _said(s, d, "supplier", _CAMERAS.replace("//", "div")).withColumns({"position": F.array(*[F.lit(0.0)] * 3), "rotation": F.array(*[F.lit(0.5)] * 4), "aspect": F.lit(None).cast("double"), "near": F.lit(0.1)})
    return R.check_cameras(rows).select("scene", "pos", "enabled", "problem")


_SECTIONS = f"SELECT CAST(p_size AS BIGINT) AS scene, CAST(p_partkey AS BIGINT) AS pos, concat('sec-', p_partkey // 2) AS id, CASE p_partkey % 4 WHEN 0 THEN 'horizontal' WHEN 1 THEN 'vertical-x' WHEN 2 THEN 'vertical-z' ELSE CASE WHEN p_partkey % 3 = 0 THEN 'tilted' ELSE 'horizontal' END END AS orientation, CAST(p_partkey % 9 AS DOUBLE) AS min, CAST(p_partkey % 9 + 1 AS DOUBLE) AS max, {_nan('p_partkey % 5 = 0')} AS min_a, {_nan('p_partkey % 6 = 1')} AS max_a, {_nan('p_partkey % 7 = 2')} AS min_b, CAST(NULL AS DOUBLE) AS max_b, 'mean' AS aggregation, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey % 3 = 1 END AS enabled, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE true END AS visible, CAST(p_partkey % 4 AS DOUBLE) / 8 AS clip_range FROM part"


@_query("s6_sections", f"SELECT scene, pos, coalesce(enabled, visible) AS enabled, greatest(0.1::DOUBLE, clip_range) AS clip_range, CASE WHEN orientation = 'tilted' OR coalesce(enabled, visible) IS NULL THEN 'requires id, orientation, min, max, aggregation, enabled' WHEN nth > 1 THEN 'duplicate section id ' || id END AS problem FROM (SELECT *, row_number() OVER (PARTITION BY scene, id ORDER BY pos) AS nth FROM ({_SECTIONS}))")
def s6_sections(s, d):
    return R.check_sections(_said(s, d, "part", _SECTIONS.replace("//", "div"))).select("scene", "pos", "enabled", "clip_range", "problem")


_EXTENTS = "SELECT DISTINCT CAST(p_size AS BIGINT) AS scene, " + ", ".join(f"CAST({k} AS DOUBLE) AS min_w{a}, CAST({k} + 10 + p_size AS DOUBLE) AS max_w{a}" for k, a in enumerate("xyz")) + " FROM part"
_pick = lambda end, n: f"CASE orientation WHEN 'horizontal' THEN {end}_w{'xz'[n]} WHEN 'vertical-x' THEN {end}_w{'zy'[n]} ELSE {end}_w{'xy'[n]} END"


@_query("s9_footprints", "SELECT pos, " + ", ".join(f"CASE WHEN isnan(min_a) OR isnan(max_a) THEN {_pick(e, 0)} ELSE {e}_a END AS {e}_a, {_pick(e, 1)} AS {e}_b" for e in ("min", "max")) + f" FROM ({_SECTIONS}) AS a JOIN ({_EXTENTS}) AS e ON e.scene = a.scene WHERE orientation <> 'tilted'")
def s9(s, d):
    rows = _said(s, d, "part", _SECTIONS.replace("//", "div")).where("orientation <> 'tilted'")
    return R.resolve_footprints(rows, _said(s, d, "part", _EXTENTS)).select("pos", "min_a", "max_a", "min_b", "max_b")


_GROUPS = f"SELECT CAST(o_custkey AS BIGINT) AS scene, CAST(o_orderkey AS BIGINT) AS pos, concat('grp-', o_orderkey) AS id, array('zone-1', concat('zone-', o_orderkey % 5), 'zone-1', concat('zone-', o_orderkey % 3)) AS zone_ids, CAST(o_orderkey % 200 AS DOUBLE) AS fov, {_nan('o_orderkey % 19 = 0')} AS far, CAST(o_orderkey % 4 AS DOUBLE) / 2 + 0.5 AS pool_size, CAST(8 AS DOUBLE) AS max_count, CAST(o_orderkey % 6 AS DOUBLE) AS trials, CAST(0.01 AS DOUBLE) AS epsilon, CAST(7 AS DOUBLE) AS seed FROM orders"
_ZONES = "SELECT CAST(c_custkey AS BIGINT) AS scene, concat('zone-', k) AS zone_id FROM customer, range(4) AS r(k)"
_REASON = "CASE WHEN isnan(far) THEN 'far must be a number' WHEN fov <= 0 OR fov >= 180 THEN 'fov must be in (0, 180)' WHEN pool_size <> floor(pool_size) OR pool_size < 1 THEN 'pool_size must be an integer of 1 or more' WHEN trials < 1 THEN 'trials must be an integer of 1 or more' END"


def _groups(s, d) -> DataFrame:
    zones = table(s, d, "customer").select(F.col("c_custkey").alias("scene"), F.explode(F.array(*(F.lit(f"zone-{k}") for k in range(4)))).alias("zone_id"))
    return R.check_groups(_said(s, d, "orders", _GROUPS), zones)


@_query("s8_groups", f"SELECT pos, array_to_string(list_filter(list_distinct_in_order, lambda z: z <> 'zone-4'), ',') AS zones, {_REASON} AS problem FROM (SELECT *, CASE WHEN z2 = 'zone-1' THEN CASE WHEN z3 = 'zone-1' THEN ['zone-1'] ELSE ['zone-1', z3] END WHEN z3 = z2 OR z3 = 'zone-1' THEN ['zone-1', z2] ELSE ['zone-1', z2, z3] END AS list_distinct_in_order FROM (SELECT *, zone_ids[2] AS z2, zone_ids[4] AS z3 FROM ({_GROUPS.replace('array(', 'list_value(')})))")
def s8(s, d):
    return _groups(s, d).select("pos", F.array_join("zone_ids", ",").alias("zones"), "problem")


@_query("u6_zone_keys", f"SELECT pos, array_to_string(list_sort(list_distinct(zone_ids)), '|') AS zone_key FROM ({_GROUPS.replace('array(', 'list_value(')})")
def u6(s, d):
    return _said(s, d, "orders", _GROUPS).select("pos", R.zone_key(F.col("zone_ids")).alias("zone_key"))


_CONSTRAINTS = "SELECT CAST(o_custkey AS BIGINT) AS scene, CAST(o_orderkey AS BIGINT) AS pos, concat('con-', o_orderkey % 40) AS id, CASE WHEN o_orderkey % 23 = 0 THEN 'gone' ELSE 'grp' END AS group_id, CASE o_orderkey % 4 WHEN 0 THEN 'point' WHEN 1 THEN 'polyline' WHEN 2 THEN 'plane' ELSE CASE WHEN o_orderkey % 9 = 0 THEN 'disc' ELSE 'point' END END AS kind, CAST(o_orderkey % 12 - 1 AS DOUBLE) AS distance, o_custkey % 3 AS many FROM orders"


@_query("z2_constraints", f"SELECT scene, pos, CASE WHEN group_id = 'gone' THEN 'group_id references no constraint group' WHEN kind = 'disc' THEN 'kind must be one of point, polyline, plane' WHEN distance < 0 THEN 'distance must be a number of 0 or more' WHEN kind = 'polyline' AND many < 2 OR kind = 'plane' AND many = 0 THEN 'geometry doesn''t fit the kind' WHEN row_number() OVER (PARTITION BY scene, id ORDER BY pos) > 1 THEN 'duplicate constraint id ' || id END AS problem FROM ({_CONSTRAINTS})")
def z2(s, d):
    at = F.array(*[F.lit(1.0)] * 3)
    rows = _said(s, d, "orders", _CONSTRAINTS)
    rows = rows.withColumns({"position": at, "points": F.slice(F.array(at, at, at), F.lit(1), F.col("many").cast("int")), "rotation": F.array(*[F.lit(0.5)] * 4), "size": F.array(F.lit(2.0), F.col("many").cast("double"))})
    return R.check_constraints(rows, rows.select("scene", F.lit("grp").alias("id")).distinct()).select("scene", "pos", "problem")


@_query("t5_caps", "SELECT CAST(c_nationkey AS BIGINT) AS scene, c_custkey AS pos, greatest(n - 31, 0) AS dropped FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS nth, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) WHERE nth <= 31")
def t5(s, d):
    """The cap of 31 zones to a scene is the feature."""
    return R.within_cap(table(s, d, "customer").select(F.col("c_nationkey").cast("long").alias("scene"), F.col("c_custkey").alias("pos")), 31, "pos")


@_query("x23_nearest", "SELECT l_suppkey, l_quantity AS distance, min(l_orderkey * 8 + l_linenumber) AS pos FROM lineitem AS a WHERE l_quantity = (SELECT min(l_quantity) FROM lineitem AS b WHERE b.l_suppkey = a.l_suppkey) GROUP BY l_suppkey, l_quantity")
def x23(s, d):
    rows = table(s, d, "lineitem").select("l_suppkey", F.col("l_quantity").alias("distance"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"))
    return R.nearest(rows, ["l_suppkey"], "distance", "pos")


@_query("w5_best_sample", "SELECT l_partkey, n, min(pos) AS pos FROM (SELECT l_partkey, CAST(l_quantity AS BIGINT) - 25 AS n, l_orderkey * 8 + l_linenumber AS pos, max(CAST(l_quantity AS BIGINT) - 25) OVER (PARTITION BY l_partkey) AS most FROM lineitem) WHERE n = most AND n > 0 GROUP BY l_partkey, n")
def w5(s, d):
    rows = table(s, d, "lineitem").select("l_partkey", (F.col("l_quantity").cast("long") - 25).alias("n"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"))
    return R.best_samples(rows, ["l_partkey"], "n", "pos")


@_query("w9_aims", "SELECT event_id, now = 0 AND best > 0 AS endless, CASE WHEN now > 0 THEN round(best / now - 1, 9) WHEN best > 0 THEN NULL ELSE 0 END AS gain, CASE WHEN now > 0 THEN best / now - 1 >= 0.01 ELSE best > 0 END AS moved FROM (SELECT event_id, CAST(event_id % 7 AS DOUBLE) AS now, CAST(event_id % 11 AS DOUBLE) AS best FROM events)")
def w9(s, d):
    k = F.col("event_id")
    rows = R.propose_aims(table(s, d, "events").select("event_id", (k % 7).cast("double").alias("current"), (k % 11).cast("double").alias("best")))
    endless = F.col("gain") == float("inf")
    return rows.select("event_id", endless.alias("endless"), F.when(~endless, F.round("gain", 9)).alias("gain"), "moved")


@_query("x10_index_range", "SELECT event_id, lo AS first_voxel, greatest(lo, hi) AS last_voxel FROM (SELECT event_id, least(greatest(CAST(floor((a - 1.5) / 0.5) AS BIGINT), 0), 39) AS lo, least(greatest(CAST(ceil((a + w - 1.5) / 0.5) AS BIGINT) - 1, 0), 39) AS hi FROM (SELECT event_id, event_id % 97 * 0.25::DOUBLE AS a, event_id % 5 * 0.375::DOUBLE AS w FROM events))")
def x10(s, d):
    low = F.col("event_id") % 97 * 0.25
    start, end = R.index_range(low, low + F.col("event_id") % 5 * 0.375, F.lit(1.5), F.lit(0.5), F.lit(40))
    return table(s, d, "events").select("event_id", start.alias("first_voxel"), end.alias("last_voxel"))


@_query("x21_recentred", "SELECT event_id, c - w / 2 AS low, c + w / 2 AS high FROM (SELECT event_id, event_id % 31 * 0.5::DOUBLE AS c, 1.0::DOUBLE + event_id % 9 AS w FROM events)")
def x21(s, d):
    k = F.col("event_id")
    low, high = R.recentred(k * 0.0, 1.0 + k % 9, k % 31 * 0.5)
    return table(s, d, "events").select("event_id", low.alias("low"), high.alias("high"))


_STOPS = "[" + ", ".join("[" + ", ".join(f"{c}::DOUBLE" for c in stop) + "]" for stop in D.STOPS) + "]"
_HUE = "SELECT event_id, h, 1 - abs(h - 2 * floor(h / 2) - 1) AS x, CAST(event_id % 131 AS DOUBLE) / 120 - 0.02 AS t FROM (SELECT event_id, event_id * 7 % 360 / 60.0::DOUBLE AS h FROM events)"


@_query("x12_colours", "SELECT event_id, " + ", ".join(f"round(({_STOPS})[i + 1][{c}] * (1 - f) + ({_STOPS})[i + 2][{c}] * f, 9) AS ramp_{n}" for c, n in enumerate(("red", "green", "blue"), 1)) + ", round(CASE WHEN h < 1 OR h >= 5 THEN 1 WHEN h >= 2 AND h < 4 THEN 0 ELSE x END, 9) AS hue_red, round(CASE WHEN h >= 1 AND h < 3 THEN 1 WHEN h >= 4 THEN 0 ELSE x END, 9) AS hue_green, round(CASE WHEN h >= 3 AND h < 5 THEN 1 WHEN h < 2 THEN 0 ELSE x END, 9) AS hue_blue FROM (SELECT *, v - i AS f FROM (SELECT *, CAST(least(6, floor(v)) AS INT) AS i FROM (SELECT *, least(greatest(t, 0), 1) * 7 AS v FROM (" + _HUE + "))))")
def x12(s, d):
    k = F.col("event_id")
    names = ("red", "green", "blue")
    shown = [F.round(c, 9).alias(f"ramp_{n}") for n, c in zip(names, D.ramp((k % 131).cast("double") / 120 - 0.02))]
    return table(s, d, "events").select("event_id", *shown, *(F.round(c, 9).alias(f"hue_{n}") for n, c in zip(names, D.hue((k * 7 % 360).cast("double")))))


@_query("a23_overlay", "SELECT event_id, event_id % 2 = 0 OR n = 0 AS draw, CASE WHEN event_id % 2 = 1 THEN CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE 0 END ELSE round(least(1, n / greatest(1, cams)), 9) END AS intensity FROM (SELECT event_id, CAST(event_id % 13 AS DOUBLE) AS n, event_id % 9 AS cams FROM events)")
def a23(s, d):
    k = F.col("event_id")
    draw, strong = D.overlay(k % 13, k % 9, k % 2 == 1)
    return table(s, d, "events").select("event_id", draw.alias("draw"), F.round(strong, 9).alias("intensity"))


@_query("x4_euler", "SELECT event_id, " + ", ".join(f"round({e}, 9) + 0.0e0 AS {n}" for n, e in (("qx", "cos(y) * sin(p) * cos(r) + sin(y) * cos(p) * sin(r)"), ("qy", "sin(y) * cos(p) * cos(r) - cos(y) * sin(p) * sin(r)"), ("qz", "cos(y) * cos(p) * sin(r) - sin(y) * sin(p) * cos(r)"), ("qw", "cos(y) * cos(p) * cos(r) + sin(y) * sin(p) * sin(r)"))) + ", CAST(event_id % 351 - 175 AS DOUBLE) AS yaw, CAST(event_id % 171 - 85 AS DOUBLE) AS pitch, CAST(event_id % 91 - 45 AS DOUBLE) AS roll FROM (SELECT event_id, radians(event_id % 351 - 175) / 2 AS y, radians(event_id % 171 - 85) / 2 AS p, radians(event_id % 91 - 45) / 2 AS r FROM events)")
def x4(s, d):
    """Angles to quaternions and back again."""
    k = F.col("event_id")
    q = G.euler_quaternion(*((k % m - o).cast("double") for m, o in ((351, 175), (171, 85), (91, 45))))
    names = ("qx", "qy", "qz", "qw")
    rows = table(s, d, "events").select("event_id", *(c.alias(n) for n, c in zip(names, q)))
    back = G.quaternion_euler([F.col(n) for n in names])
    return rows.select("event_id", *((F.round(n, 9) + 0.0).alias(n) for n in names), *((F.round(c, 6) + 0.0).alias(n) for n, c in zip(("yaw", "pitch", "roll"), back)))


@_query("j9_mount_overlap")
def j9(s, d):
    """Draws around every camera that lie in a region of its room; held against brute force in the tests."""
    r = Room(s, d)
    mounts = r.of(scene.cameras).select("scene", F.concat(F.lit("con-"), "cam_idx").alias("id"), "px", "py", "pz", F.lit(2.0).alias("distance"), (F.col("cam_idx") * 7 + 1).alias("start"))
    return R.mount_overlap(mounts, r.of(scene.regions))
