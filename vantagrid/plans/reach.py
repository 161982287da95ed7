"""Queries on sets of what positions reach, for pools of more than 128 positions; with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import poolstate, reachsets, visibility
from ..sources import scene
from ..sources.runs import Folder, fingerprint
from ..sources.tables import checkpointed, table
from . import oracle as O
from .queries import Room, _query

#: Every camera twice, as it stands and turned about.
_TURNED = {"qx": "-qz", "qy": "qw", "qz": "qx", "qw": "-qy"}
_TRIALS, _TAKEN = 6, 16
_unsigned = lambda v: f"CAST(({v}) % 4294967296 AS BIGINT)"


def _number(seed: str, n: str) -> str:
    """A subquery of the n-th number of a stream, step by step on whole numbers."""
    x = _unsigned(f"CAST({seed} AS HUGEINT) + CAST({n} + 1 AS HUGEINT) * {reachsets.STRIDE}")
    steps = f"SELECT xor(x, x >> 16) AS x FROM (SELECT {x} AS x)"
    for factor in reachsets.FACTORS:
        steps = f"SELECT xor(x, x >> 15) AS x FROM (SELECT {_unsigned(f'CAST(x AS HUGEINT) * {factor}')} AS x FROM ({steps}))"
    return f"(SELECT x / 4294967296.0e0 FROM ({steps}))"


_POOL = {
    "twins": "SELECT scene, CAST(cam_idx * 2 + t AS INT) AS cam_idx, px, py, pz, " + ", ".join(f"CASE WHEN t = 0 THEN {q} ELSE {v} END AS {q}" for q, v in _TURNED.items()) + ", fov, aspect, near, far, enabled FROM cams, (VALUES (0), (1)) AS v(t)",
    "twin_around": O._PARTS["around"].replace("FROM cams", "FROM twins"),
    "twin_near": O._PARTS["near"].replace("FROM cams", "FROM twins"),
    "reached": "SELECT scene, cam_idx AS place, point FROM (" + O._sees("valid").replace("JOIN around ON around.", "JOIN twin_around AS around ON around.").replace("JOIN near ON near.", "JOIN twin_near AS near ON near.") + ")",
}
_DRAWN = {
    "pools": "SELECT scene, list(cam_idx ORDER BY cam_idx) AS o, count(*) AS n, scene * 7919 + 5 AS seed FROM twins WHERE enabled GROUP BY scene",
    "swaps": f"SELECT scene, o, n, seed, CAST(-1 AS BIGINT) AS s FROM pools UNION ALL SELECT scene, list_transform(o, lambda v, p: CASE WHEN p = i + 1 THEN o[j + 1] WHEN p = j + 1 THEN o[i + 1] ELSE v END), n, seed, s FROM (SELECT *, i + CAST(floor(u * (n - i)) AS BIGINT) AS j FROM (SELECT scene, o, n, seed, s + 1 AS s, (s + 1) % {_TAKEN} AS i, "
    + _number(f"xor(seed, {_unsigned(f'CAST((s + 1) // {_TAKEN} + 1 AS HUGEINT) * {reachsets.TRIAL_MIX}')})", f"(s + 1) % {_TAKEN}")
    + f" AS u FROM swaps WHERE s + 1 < {_TRIALS * _TAKEN}))",
    "orders": f"SELECT scene, CAST(s // {_TAKEN} AS INT) AS trial, CAST(unnest(range(1, {_TAKEN} + 1)) AS INT) AS k, unnest(o[1:{_TAKEN}]) AS place FROM swaps WHERE s % {_TAKEN} = {_TAKEN - 1}",
}


def _places(r: Room):
    """Two places for each camera of each room."""
    turned = {q: F.when(F.col("t") == 0, F.col(q)).otherwise(F.expr(v)) for q, v in _TURNED.items()}
    rows = r.of(scene.cameras).where("enabled").select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("t"))
    return rows.withColumns({"place": (F.col("cam_idx") * 2 + F.col("t")).cast("int"), **turned}).drop("t", "cam_idx")


def _pool(s, d):
    """The places, and the sets that they reach."""
    r = Room(s, d)
    places = _places(r)
    seen = r.sights(places.withColumnRenamed("place", "cam_idx"), 2 * visibility.MOST_CAMERAS)[1]
    return places, checkpointed(reachsets.reach_sets(seen.withColumnRenamed("cam_idx", "place")))


@_query("a22_reach_counts", O.sql("SELECT scene, place, count(*) AS n FROM reached GROUP BY scene, place", "valid", "cams", "tri", more=_POOL))
def a22(s, d):
    return reachsets.counts(_pool(s, d)[1])


@_query("u4_union", O.sql("SELECT scene, count(DISTINCT point) AS n FROM reached GROUP BY scene", "valid", "cams", "tri", more=_POOL))
def u4_union(s, d):
    return reachsets.union_count(_pool(s, d)[1])


@_query("u4_gains", O.sql("SELECT scene, place, count(*) FILTER (point NOT IN (SELECT point FROM reached WHERE place % 2 = 0)) AS gain FROM reached WHERE place % 2 = 1 GROUP BY scene, place", "valid", "cams", "tri", more=_POOL))
def u4_gains(s, d):
    """What every turned camera would add to what the others reach."""
    sets = _pool(s, d)[1]
    return reachsets.gains(sets.where("place % 2 = 1"), reachsets.union(sets.where("place % 2 = 0")))


def _orders(pool):
    return reachsets.trial_orders(pool.select("scene", "place", (F.col("scene") * 7919 + 5).alias("seed")), _TRIALS, _TAKEN)


@_query("w2_seeded_orders", O.sql("SELECT * FROM orders", "cams", more={"twins": _POOL["twins"], **_DRAWN}))
def w2_orders(s, d):
    return _orders(_places(Room(s, d)))


@_query("w2_seeded_curve", O.sql(
    "SELECT o.scene, o.trial, o.k, CAST(sum(coalesce(n, 0)) OVER (PARTITION BY o.scene, o.trial ORDER BY o.k) AS BIGINT) AS score FROM orders AS o LEFT JOIN (SELECT scene, trial, k, count(*) AS n FROM (SELECT o.scene, trial, point, min(k) AS k FROM reached AS r JOIN orders AS o ON o.scene = r.scene AND o.place = r.place GROUP BY o.scene, trial, point) GROUP BY scene, trial, k) AS f ON f.scene = o.scene AND f.trial = o.trial AND f.k = o.k",
    "valid", "cams", "tri", more=_POOL | _DRAWN))
def w2_curve(s, d):
    """Random layouts of pools of 200 places."""
    places, sets = _pool(s, d)
    return reachsets.trial_curve(_orders(places), sets)


@_query("w1_reach_greedy")
def w1_reach(s, d):
    """Greedy layouts from pools of 200 places; held against brute force in the tests."""
    places, sets = _pool(s, d)
    return reachsets.greedy(sets, places, 8)


@_query("x7_generator", f"SELECT o_orderkey, {_number('o_orderkey * 2654435761 % 4294967296', 'o_custkey')} AS u FROM orders")
def x7_generator(s, d):
    """One number of the stream of each order."""
    return table(s, d, "orders").select("o_orderkey", reachsets.generator(F.col("o_orderkey") * 2654435761, F.col("o_custkey")).alias("u"))


def _mounts(s, d):
    """A pool of mounts in each room: every region carries a plane to mount on, larger ones take more."""
    r = Room(s, d)
    regions = r.of(scene.regions).selectExpr("scene", "concat('con-', region) AS id", "'plane' AS kind", "array(rx, 1.9D, rz) AS position", "CAST(NULL AS array<array<double>>) AS points", "array(rqx, rqy, rqz, rqw) AS rotation", "array(2 * hx, 2 * hz) AS size", "0.25D AS distance", "CAST(7 AS BIGINT) AS seed", "CAST(1 + region % 3 AS BIGINT) AS share")
    pool = poolstate.Pool(s, fingerprint("r7", *(Folder(s, f"{d}/{t}.parquet").revision() for t in ("part", "supplier", "nation"))))
    shares = regions.select("scene", "id", "share")
    pool.build(regions.drop("share"), shares, 50, 7, "room|0.5||0.1|6", poolstate.reach_of(r.kept_valid(), r.of(scene.triangles), 0.1, 6.0))
    return pool, shares


@_query("r7_pool")
def r7_pool(s, d):
    """What the constraints of every room have drawn, and what of it reaches anything; held against the pool's rules in the tests."""
    pool, shares = _mounts(s, d)
    return pool.summary(shares)
