"""Queries on sections over whole rooms, on descriptors, and on what counts and draws, with SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import descriptors as D
from ..operators import gates
from ..operators import records as R
from ..operators import sections as S
from ..sources import scene
from ..sources.tables import checkpointed, table
from . import oracle as O
from .queries import Room, _query, _rate
from .records import _EXTENTS, _GROUPS, _SECTIONS, _ZONES, _pick, _said

# --- sections of every room -------------------------------------------------------------------------


def _sections(r: Room) -> DataFrame:
    """Three of every room, each as wide as the room: from above, along x for twelve metres, and along z where regions of even number lie."""
    high = dict(zip("xyz", (float(x) for x in r.space.high)))
    row = lambda n, o, low, top, a, b, mask, agg: F.struct(F.lit(n).alias("section"), F.lit(o).alias("orientation"), low.alias("min"), F.lit(top).alias("max"), F.lit(0.0).alias("min_a"), F.lit(a).alias("max_a"), F.lit(0.0).alias("min_b"), F.lit(b).alias("max_b"), mask.alias("mask_regions"), F.lit(agg).alias("aggregation"))
    none, even = F.array().cast("array<long>"), F.filter(F.sequence(F.col("scene") * 25, F.col("scene") * 25 + 24), lambda n: n % 2 == 0)
    rows = [
        row(0, "horizontal", F.lit(scene.VOXEL) * (F.col("scene") % 2), high["y"], high["x"], high["z"], none, "mean"),
        row(1, "vertical-x", F.lit(2.0), 14.0, high["z"], high["y"], none, "blind"),
        row(2, "vertical-z", F.lit(0.0), high["z"], high["x"], high["y"], even, "max"),
    ]
    return r.spark.range(r.rooms).select(F.col("id").alias("scene")).withColumn("s", F.explode(F.array(*rows))).select("scene", "s.*")


def _columns(r: Room) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sections, their slabs, and their columns over every cell of the rooms."""
    sections = _sections(r)
    slabs = S.section_slabs(r.space, sections)
    held = A.in_regions(r.space, r.region_voxels(), r.of(scene.regions)).groupBy("point").agg(F.collect_set("region").alias("regions"))
    # Voxels that nothing is known of, neither seen nor in geometry or regions, are made where they are counted.
    named = checkpointed(r.kept_told().join(held.hint("merge"), "point", "full"))
    zeros, told = {c: F.lit(0).cast("long") for c in ("mask", "mask_high", "cameras")}, named.withColumn("cameras", (F.bit_count("mask") + F.bit_count("mask_high")).cast("long"))
    cells = r.space.placed(told.fillna(0, list(zeros)).fillna(True, ["valid"]))
    plain = lambda meet: r.space.others(named, r.rooms, meet).withColumns(zeros | {"valid": F.lit(True)})
    return sections, slabs, S.section_columns(r.space, cells, slabs, plain)


def _grid(r: Room) -> tuple[DataFrame, DataFrame]:
    sections, slabs, columns = _columns(r)
    return sections, S.section_grid(columns, slabs, r.of(scene.cameras).groupBy("scene").agg(F.count("*").alias("n")))


_BAND = f"CAST(floor(2 / {O._V}) AS BIGINT)", f"CAST(ceil(14 / {O._V}) AS BIGINT) - 1"
_ROOMS = {
    "spans": f"SELECT room AS scene, section, axis, i0, i1, j0, j1, k0, k1, len FROM (SELECT unnest(range((SELECT rooms FROM par))) AS room) AS r, par, LATERAL (SELECT * FROM (VALUES (0, 1, 0, nx - 1, room % 2, ny - 1, 0, nz - 1, ny - room % 2), (1, 0, {_BAND[0]}, {_BAND[1]}, 0, ny - 1, 0, nz - 1, {_BAND[1]} - {_BAND[0]} + 1), (2, 2, 0, nx - 1, 0, ny - 1, 0, nz - 1, nz)) AS t(section, axis, i0, i1, j0, j1, k0, k1, len))",
    "evens": O._PARTS["marks"] + " AND r.region % 2 = 0",
    "cut": "SELECT v.scene, section, len, axis, i0, j0, k0, CASE WHEN axis = 0 THEN v.j ELSE v.i END AS a, CASE WHEN axis = 2 THEN v.j ELSE v.k END AS b, m.cameras, m.mask, m.mask_high, section = 2 AND evens.point IS NULL AS filtered FROM vox AS v JOIN spans AS s ON s.scene = v.scene AND v.i BETWEEN i0 AND i1 AND v.j BETWEEN j0 AND j1 AND v.k BETWEEN k0 AND k1 LEFT JOIN masked AS m ON m.point = v.point LEFT JOIN evens ON evens.point = v.point",
    "piled": "SELECT scene, section, a, b, any_value(len) AS len, any_value(axis) AS axis, any_value(i0) AS i0, any_value(j0) AS j0, any_value(k0) AS k0, CAST(coalesce(sum(cameras) FILTER (NOT filtered), 0) AS BIGINT) AS total, coalesce(max(cameras) FILTER (NOT filtered), 0) AS most, coalesce(min(cameras) FILTER (NOT filtered), 255) AS least, count(*) FILTER (cameras = 0 AND NOT filtered) AS blind, count(cameras) FILTER (NOT filtered) AS valid, count(*) FILTER (cameras IS NULL AND NOT filtered) AS obstacle, count(*) FILTER (filtered) AS filtered, CAST(coalesce(bit_or(mask) FILTER (NOT filtered), 0) AS BIGINT) AS seen, CAST(coalesce(bit_or(mask_high) FILTER (NOT filtered), 0) AS BIGINT) AS seen_high FROM cut GROUP BY scene, section, a, b",
    "tiles": "SELECT p.scene, section, CASE WHEN axis = 0 THEN b - k0 ELSE a - i0 END AS u, CASE axis WHEN 0 THEN a - j0 WHEN 2 THEN b - j0 ELSE b - k0 END AS v, CASE WHEN valid > 0 THEN total::DOUBLE / (valid * n) ELSE 0 END AS mean, CASE WHEN valid > 0 THEN p.most::DOUBLE / n ELSE 0 END AS most, CASE WHEN valid > 0 THEN p.least::DOUBLE / n ELSE 0 END AS least, CASE WHEN valid > 0 THEN blind::DOUBLE / valid ELSE 0 END AS blind_share, valid > 0 AS coloured, valid + obstacle + filtered < len AS no_data, obstacle > 0 AND valid = 0 AND valid + obstacle + filtered >= len AS black, seen, seen_high FROM piled AS p JOIN (SELECT scene, count(*) AS n FROM cams GROUP BY scene) AS c ON c.scene = p.scene",
    "names": "SELECT DISTINCT scene, section, CASE section WHEN 0 THEN 'mean' WHEN 1 THEN 'blind' ELSE 'max' END AS aggregation FROM spans",
}


def _sql(select: str) -> str:
    return O.sql(select, "masked", "regions", "cams", more=_ROOMS)


@_query("a7_sections", _sql("SELECT scene, section, a, b, total, most, least, blind, valid, obstacle, filtered, seen, seen_high FROM piled"))
def a7(s, d):
    """Columns of sections as wide as each room, one of them behind a filter of regions."""
    return _columns(Room(s, d))[2]


@_query("a19_section_grid", _sql("SELECT scene, section, u, v, round(mean, 9) AS mean, round(most, 9) AS most, round(least, 9) AS least, round(blind_share, 9) AS blind_share, coloured, no_data, black, seen, seen_high FROM tiles"))
def a19(s, d):
    rates = ("mean", "most", "least", "blind_share")
    return _grid(Room(s, d))[1].withColumns({c: F.round(c, 9) for c in rates})


_MEAN = "round(coalesce(avg({}) FILTER (coloured), 0), 9)"
@_query("a20_section_figures", _sql(f"SELECT n.scene, n.section, count(*) FILTER (coloured OR black) AS total_cells, count(*) FILTER (coloured) AS valid_cells, count(*) FILTER (black) AS obstacle_cells, {_MEAN.format('mean')} AS coverage, count(*) FILTER (coloured AND blind_share = 1) AS blind_cells, round(coalesce(min(mean) FILTER (coloured), 0), 9) AS least, round(coalesce(max(mean) FILTER (coloured), 0), 9) AS most, {_MEAN.format('CASE aggregation WHEN ' + chr(39) + 'mean' + chr(39) + ' THEN mean WHEN ' + chr(39) + 'blind' + chr(39) + ' THEN blind_share ELSE t.most END')} AS badge, round(coalesce(count(*) FILTER (coloured AND blind_share = 1)::DOUBLE / nullif(count(*) FILTER (coloured), 0), 0), 9) AS blind_pct FROM names AS n LEFT JOIN tiles AS t ON t.scene = n.scene AND t.section = n.section GROUP BY n.scene, n.section"))
def a20(s, d):
    sections, grid = _grid(Room(s, d))
    return S.section_figures(grid, sections).withColumns({c: F.round(c, 9) for c in ("coverage", "least", "most", "badge", "blind_pct")})


_BIT = "CASE WHEN cam_idx < 64 THEN seen ELSE seen_high END >> (cam_idx % 64)"
@_query("a20_section_cameras", _sql(f"SELECT n.scene, n.section, c.cam_idx, round(coalesce(count(*) FILTER (coloured AND ({_BIT}) & 1 = 1)::DOUBLE / nullif(count(*) FILTER (coloured), 0), 0), 9) AS share FROM names AS n JOIN cams AS c ON c.scene = n.scene AND enabled LEFT JOIN tiles AS t ON t.scene = n.scene AND t.section = n.section GROUP BY n.scene, n.section, c.cam_idx"))
def a20_cameras(s, d):
    r = Room(s, d)
    sections, grid = _grid(r)
    return S.section_cameras(checkpointed(grid), sections, r.of(scene.cameras)).select("scene", "section", "cam_idx", _rate("share"))


_FOOT = f"SELECT pos, orientation, min, max, " + ", ".join(f"CASE WHEN isnan(min_a) OR isnan(max_a) THEN {_pick(e, 0)} ELSE {e}_a END AS {e}_a, {_pick(e, 1)} AS {e}_b" for e in ("min", "max")) + f" FROM ({_SECTIONS}) AS a JOIN ({_EXTENTS}) AS e ON e.scene = a.scene WHERE orientation <> 'tilted'"
_ALONG = {"i": "CASE orientation WHEN 'vertical-x' THEN {0} ELSE {0}_a END", "j": "CASE orientation WHEN 'horizontal' THEN {0} ELSE {0}_b END", "k": "CASE orientation WHEN 'horizontal' THEN {0}_b WHEN 'vertical-x' THEN {0}_a ELSE {0} END"}
_START = {c: f"least(greatest(floor(({_ALONG[c].format('min')}) / {O._V}), 0), n{x} - 1)" for c, x in zip("ijk", "xyz")}
_END = {c: f"greatest({_START[c]}, least(greatest(ceil(({_ALONG[c].format('max')}) / {O._V}) - 1, 0), n{x} - 1))" for c, x in zip("ijk", "xyz")}
_INDEX = ", ".join(f"CAST({_START[c]} AS BIGINT) AS {c}0, CAST({_END[c]} AS BIGINT) AS {c}1" for c in "ijk")


@_query("x11_section_slabs", O.sql(f"SELECT *, CASE axis WHEN 0 THEN i1 - i0 WHEN 1 THEN j1 - j0 ELSE k1 - k0 END + 1 AS length FROM (SELECT pos, CASE orientation WHEN 'horizontal' THEN 1 WHEN 'vertical-x' THEN 0 ELSE 2 END AS axis, orientation = 'vertical-x' AS transposed, {_INDEX} FROM ({_FOOT}), par)", "par"))
def x11(s, d):
    """Sections of documents as slabs of the rooms' grid."""
    rows = _said(s, d, "part", _SECTIONS.replace("//", "div")).where("orientation <> 'tilted'")
    slabs = S.section_slabs(Room(s, d).space, R.resolve_footprints(rows, _said(s, d, "part", _EXTENTS)))
    return slabs.select("pos", "axis", "transposed", "i0", "i1", "j0", "j1", "k0", "k1", "length")


# --- descriptors --------------------------------------------------------------------------------------

#: How often each line of an order stands in a list of the order's descriptor.
_TIMES = {"regions": "CASE WHEN o % 17 = 0 THEN 20 ELSE 1 END", "slabs": "CASE WHEN o % 19 = 0 THEN 9 ELSE 1 END", "probes": "CASE WHEN o % 29 = 0 THEN 64 ELSE 1 END", "projections": "CASE WHEN o % 31 = 0 THEN 3 ELSE 1 END"}
_LINES = "SELECT CAST(l_orderkey AS BIGINT) AS o, CAST(l_linenumber AS INT) AS n, CAST(l_partkey AS BIGINT) AS p, CAST(l_suppkey AS BIGINT) AS s, CAST(floor(l_quantity) AS DOUBLE) AS q FROM lineitem"
_ELEMENTS = {
    "regions": "named_struct('centre', array(double(p), CASE WHEN s % 53 = 0 THEN double('NaN') ELSE 1D END, double(n)), 'half', array(q, 1D, CASE WHEN p % 41 = 0 THEN 0D ELSE 1D END), 'rotation', CASE WHEN s % 61 = 0 THEN array(0D, 0D, 1D) ELSE array(0D, 0D, 0D, 1D) END, 'groups', array(double(n), CASE WHEN p % 43 = 0 THEN 32D ELSE 31D END))",
    "slabs": "named_struct('axis', CASE WHEN p % 59 = 0 THEN 1.5D ELSE double(n % 3) END, 'range', array(array(0D, q), array(double(n), CASE WHEN s % 31 = 0 THEN n - 1D ELSE double(n) END), array(0D, CASE WHEN p % 71 = 0 THEN 2.5D ELSE 4D END)), 'mask', CASE WHEN p % 37 = 0 THEN array(0D, 500D) ELSE array(0D) END)",
    "probes": "array(1D, 2D, CASE WHEN s % 67 = 0 THEN double('Infinity') ELSE 3D END)",
    "projections": "named_struct('bins', CASE WHEN p % 73 = 0 THEN 129D ELSE 128D END, 'matrix', array_repeat(0D, CASE WHEN p % 79 = 0 THEN 15 ELSE 16 END), 'camera', CASE WHEN p % 83 = 0 THEN -1D WHEN s % 71 = 0 THEN 5D ELSE 4D END, 'mask', array_repeat(500D, CASE WHEN p % 47 = 0 THEN 1 ELSE 0 END), 'weights', array_repeat(array_repeat(1D, CASE WHEN s % 79 = 0 THEN 7 ELSE 6 END), CASE WHEN p % 89 = 0 THEN 0 WHEN p % 97 = 0 THEN 5 ELSE 2 END))",
}


def _of_line(e: str) -> str:
    """An expression over the columns of a line as one over the element ``l`` of an order's lines."""
    return re.sub(r"\b([npsq])\b", r"l.\1", e)


def _descriptors(s, d) -> DataFrame:
    """One for each order, from its lines: lines are grouped as they are, their elements are made behind the shuffle."""
    lines = _said(s, d, "lineitem", _LINES)
    made = lines.groupBy("o").agg(F.sort_array(F.collect_list(F.struct("n", "p", "s", "q"))).alias("lines"))
    lists = {c: F.expr(f"flatten(transform(lines, l -> array_repeat({_of_line(e)}, cast({_of_line(_TIMES[c])} AS int))))") for c, e in _ELEMENTS.items()}
    rows = made.select(F.col("o").alias("scene"), F.when(F.col("o") % 2 == 0, F.lit(5)).alias("num_cameras"), *(v.alias(c) for c, v in lists.items()))
    leaf = F.array(F.when(F.col("scene") % 23 == 0, F.size("regions")).otherwise(0).cast("double"))
    return rows.withColumn("leaf_mask", leaf).withColumn("camera_words", F.array_repeat(F.lit(0).cast("long"), F.when(F.col("scene") % 7 == 0, 2).otherwise(1)))


_CAP = "SELECT o, {step} AS step, 0 AS pos, 'AGGREGATE_TOO_LARGE' AS code, '{list}: ' || sum({times}) || ' of at most {cap}' AS problem FROM lines GROUP BY o HAVING sum({times}) > {cap}"
_BAD = "SELECT o, {step}, place, 'INVALID_AGGREGATE', '{list}[' || place || '] ' || why FROM (SELECT o, {why} AS why, CAST(coalesce(sum({times}) OVER (PARTITION BY o ORDER BY n, p, s, q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place FROM lines) WHERE why IS NOT NULL"
_WHY = {
    "regions": "CASE WHEN s % 53 = 0 THEN 'centre must be three numbers' WHEN s % 61 = 0 THEN 'rotation must be four numbers' WHEN q <= 0 OR p % 41 = 0 THEN 'half must be positive' WHEN p % 43 = 0 THEN 'groups must lie in 0 to 31' END",
    "slabs": "CASE WHEN p % 59 = 0 THEN 'axis must be 0, 1 or 2' WHEN p % 71 = 0 THEN 'range must hold pairs of integers' WHEN s % 31 = 0 THEN 'range is empty' WHEN p % 37 = 0 THEN 'mask names no region' END",
    "probes": "CASE WHEN s % 67 = 0 THEN 'must be three numbers' END",
    "projections": "CASE WHEN p % 73 = 0 THEN 'bins must lie in 1 to 128' WHEN p % 79 = 0 THEN 'matrix must be sixteen numbers' WHEN p % 83 = 0 THEN 'camera must be 0 or more' WHEN p % 47 = 0 THEN 'mask names no region' WHEN p % 89 = 0 OR p % 97 = 0 THEN 'weights must hold 1 to 4 tables' WHEN o % 2 = 0 AND s % 71 = 0 THEN 'camera isn''t in the run' WHEN o % 2 = 0 AND s % 79 = 0 THEN 'weights need an entry more than there are cameras' END",
}
_REASONS = [t.format(step=10 * k + 2 * (k > 1) + n, list=c, times=_TIMES[c], cap=A.CAPS[c], why=_WHY[c]) for k, c in enumerate(_TIMES) for n, t in enumerate((_CAP, _BAD))]
_REASONS += ["SELECT DISTINCT o, 15, 0, 'INVALID_AGGREGATE', 'leaf_mask names no region' FROM lines WHERE o % 23 = 0", "SELECT DISTINCT o, 90, 0, 'INVALID_AGGREGATE', 'camera_words must hold 1' FROM lines WHERE o % 2 = 0 AND o % 7 = 0"]


@_query("a3_descriptors", f"WITH lines AS MATERIALIZED ({_LINES}), reasons AS ({' UNION ALL '.join(_REASONS)}), firsts AS (SELECT o, arg_min(code, step * 100000 + pos) AS code, arg_min(problem, step * 100000 + pos) AS problem FROM reasons GROUP BY o) SELECT DISTINCT lines.o AS scene, code, problem FROM lines LEFT JOIN firsts ON firsts.o = lines.o")
def a3(s, d):
    """The first thing that is wrong with each order's descriptor."""
    return D.check_descriptors(_descriptors(s, d)).select("scene", "code", "problem")


# --- what counts and draws ----------------------------------------------------------------------------

_GATED = _GROUPS.replace("AS pos,", "AS pos, o_orderkey % 3 = 0 AS enabled,").replace("AS id,", "AS group_id,")
_DRAWN = {
    "placed": "SELECT CAST(o_custkey AS BIGINT) AS scene, concat('grp-', min(o_orderkey)) AS group_id FROM orders WHERE o_custkey % 4 = 0 GROUP BY o_custkey",
    "groups": _GATED.replace("array(", "list_value("),
    "drawable": "SELECT g.* FROM groups AS g LEFT JOIN placed AS p ON p.scene = g.scene AND p.group_id = g.group_id WHERE enabled OR p.scene IS NOT NULL",
    "drawn": f"SELECT scene, zone_id FROM ({_ZONES}) WHERE scene % 3 = 0 AND zone_id <> 'zone-2' UNION SELECT scene, unnest(zone_ids) FROM drawable",
}


def _drawn(s, d) -> DataFrame:
    orders, groups = table(s, d, "orders"), _said(s, d, "orders", _GATED)
    zones = table(s, d, "customer").select(F.col("c_custkey").cast("long").alias("scene"), F.explode(F.array(*(F.lit(f"zone-{k}") for k in range(4)))).alias("zone_id"))
    placing = orders.where("o_custkey % 4 = 0").groupBy(F.col("o_custkey").cast("long").alias("scene")).agg(F.concat(F.lit("grp-"), F.min("o_orderkey").cast("string")).alias("group_id"))
    drawable = gates.drawable_groups(groups, placing)
    return gates.visible_zones(zones.withColumn("enabled", (F.col("scene") % 3 == 0) & (F.col("zone_id") != "zone-2")), groups, drawable)


@_query("f16_drawn_zones", O.sql("SELECT scene, zone_id FROM drawn", more=_DRAWN))
def f16(s, d):
    """Zones that draw: enabled, or aimed at by a group that is enabled or being placed."""
    return _drawn(s, d)


@_query("f16_blockers", "SELECT CAST(c_custkey AS BIGINT) AS scene, CASE WHEN NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') THEN 'no_geometry' END AS blocker FROM customer")
def f16_blockers(s, d):
    """Customers none of whose orders is enabled can't start a run."""
    geometry = table(s, d, "orders").select(F.col("o_custkey").cast("long").alias("scene"), (F.col("o_orderstatus") == "F").alias("enabled"))
    return gates.run_blockers(table(s, d, "customer").select(F.col("c_custkey").cast("long").alias("scene")), geometry)


@_query("f6_zone_volumes", O.sql("SELECT CAST(o_orderkey AS BIGINT) AS volume, v.scene, v.zone_id FROM (SELECT *, CAST(o_custkey AS BIGINT) AS scene, concat('zone-', o_orderkey % 5) AS zone_id FROM orders) AS v WHERE EXISTS (SELECT 1 FROM drawn WHERE drawn.scene = v.scene AND drawn.zone_id = v.zone_id)", more=_DRAWN))
def f6(s, d):
    """Volumes of the zones that draw; every order is one."""
    volumes = table(s, d, "orders").select(F.col("o_orderkey").cast("long").alias("volume"), F.col("o_custkey").cast("long").alias("scene"), F.concat(F.lit("zone-"), (F.col("o_orderkey") % 5).cast("string")).alias("zone_id"))
    return gates.volumes_of_zones(volumes, _drawn(s, d))
