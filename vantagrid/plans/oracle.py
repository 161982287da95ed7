"""SQL that derives the same results by other ways, all rays against all triangles in range, for any engine that reads the tables."""

from __future__ import annotations

from itertools import product

from ..sources.scene import BOXES_SQL, CAMERAS_SQL, CHUNK, CORNERS, PITCH, POINTS_SQL, PROBES_SQL, REGIONS_SQL, RIG, ROW, VOXEL, Layout

_NX, _NY, _ = Layout(1, 1).space.dims  # the third depends on the number of parts
_V, _CV = VOXEL, round(CHUNK / VOXEL)
_CX = -(-_NX // _CV)


def _triangles() -> str:
    rows = ", ".join(f"({t}, {', '.join(str(c) for p in corners for c in p)})" for t, corners in enumerate(CORNERS))
    names = ", ".join(f"u{n}{a}" for n in "abc" for a in "xyz")
    made = ", ".join(f"{a}0 + u{n}{a} * s{a} AS v{n}{a}" for n in "abc" for a in "xyz")
    return f"SELECT scene, box * {len(CORNERS)} + t AS tri_id, {made} FROM boxes, (VALUES {rows}) AS v(t, {names})"


def _local(x: str, y: str, z: str, q: str = "q") -> list[str]:
    """A vector in the frame of the quaternion columns, by the rotation matrix."""
    a, b, c, w = (f"{q}{n}" for n in "xyzw")
    m = [[f"(1 - 2 * ({b} * {b} + {c} * {c}))", f"(2 * ({a} * {b} - {c} * {w}))", f"(2 * ({a} * {c} + {b} * {w}))"],
         [f"(2 * ({a} * {b} + {c} * {w}))", f"(1 - 2 * ({a} * {a} + {c} * {c}))", f"(2 * ({b} * {c} - {a} * {w}))"],
         [f"(2 * ({a} * {c} - {b} * {w}))", f"(2 * ({b} * {c} + {a} * {w}))", f"(1 - 2 * ({a} * {a} + {b} * {b}))"]]
    return [f"({m[0][i]} * ({x}) + {m[1][i]} * ({y}) + {m[2][i]} * ({z}))" for i in range(3)]


def _frustum() -> str:
    lx, ly, lz = _local("x - px", "y - py", "z - pz")
    v = "CAST(CAST(tan(radians(fov) / 2) AS FLOAT) AS DOUBLE)"
    h = "CAST(CAST(tan(radians(fov) / 2) * aspect AS FLOAT) AS DOUBLE)"
    return f"enabled AND abs{lx} <= {h} * (-{lz}) AND abs{ly} <= {v} * (-{lz}) AND -{lz} >= near AND -{lz} <= far AND sqrt((x-px)*(x-px)+(y-py)*(y-py)+(z-pz)*(z-pz)) <= far"


def _hit(ox: str, dx: str, low: str, high: str, found: str = "1") -> str:
    """A subquery of triangles that the ray meets within (low, high); ox and dx name its columns by prefix."""
    e1, e2 = [f"(vb{a} - va{a})" for a in "xyz"], [f"(vc{a} - va{a})" for a in "xyz"]
    d, s = [f"{dx}{a}" for a in "xyz"], [f"({ox}{a} - va{a})" for a in "xyz"]
    cr = lambda p, q: [f"({p[1]}*{q[2]} - {p[2]}*{q[1]})", f"({p[2]}*{q[0]} - {p[0]}*{q[2]})", f"({p[0]}*{q[1]} - {p[1]}*{q[0]})"]
    dt = lambda p, q: f"({p[0]}*{q[0]} + {p[1]}*{q[1]} + {p[2]}*{q[2]})"
    p, q = cr(d, e2), cr(s, e1)
    inner = f"SELECT {dt(e1, p)} AS det, {dt(s, p)} AS un, {dt(d, q)} AS vn, {dt(e2, q)} AS tn FROM tri WHERE tri.scene = r.scene"
    return f"(SELECT {found} FROM ({inner}) WHERE abs(det) >= 1e-7 AND un / det >= 0 AND vn / det >= 0 AND un / det + vn / det <= 1 AND tn / det > {low} AND tn / det < {high})"


def _sees(source: str) -> str:
    """Lines of sight by testing every ray against every triangle within the camera's range."""
    dist = "sqrt((x-px)*(x-px)+(y-py)*(y-py)+(z-pz)*(z-pz))"
    pairs = f"SELECT s.scene, s.point, cam_idx, x AS ox, y AS oy, z AS oz, (px-x)/dist AS dx, (py-y)/dist AS dy, (pz-z)/dist AS dz, dist FROM (SELECT v.*, cam_idx, px, py, pz, {dist} AS dist FROM {source} AS v JOIN around ON around.scene = v.scene AND cell_x = floor(x / 4) AND cell_z = floor(z / 4) WHERE {_frustum()}) AS s"
    e1, e2 = [f"(vb{a} - va{a})" for a in "xyz"], [f"(vc{a} - va{a})" for a in "xyz"]
    d, o = [f"d{a}" for a in "xyz"], [f"(o{a} - va{a})" for a in "xyz"]
    cr = lambda p, q: [f"({p[1]}*{q[2]} - {p[2]}*{q[1]})", f"({p[2]}*{q[0]} - {p[0]}*{q[2]})", f"({p[0]}*{q[1]} - {p[1]}*{q[0]})"]
    dt = lambda p, q: f"({p[0]}*{q[0]} + {p[1]}*{q[1]} + {p[2]}*{q[2]})"
    p, q = cr(d, e2), cr(o, e1)
    tests = f"SELECT r.scene, r.point, r.cam_idx, r.ox, r.oy, r.oz, {dt(e1, p)} AS det, {dt(o, p)} AS un, {dt(d, q)} AS vn, {dt(e2, q)} AS tn, dist FROM ({pairs}) AS r JOIN near ON near.scene = r.scene AND near.cam_idx = r.cam_idx WHERE dist >= 0.002"
    hits = f"SELECT DISTINCT scene, point, cam_idx, ox, oy, oz FROM ({tests}) WHERE abs(det) >= 1e-7 AND un / det >= 0 AND vn / det >= 0 AND un / det + vn / det <= 1 AND tn / det > 0.001 AND tn / det < dist - 0.001"
    same = " AND ".join(f"h.{c} = p.{c}" for c in ("scene", "point", "cam_idx", "ox", "oy", "oz"))
    return f"SELECT p.scene, p.point, p.cam_idx FROM ({pairs}) AS p LEFT JOIN ({hits}) AS h ON {same} WHERE h.point IS NULL"


def _meets() -> str:
    """The separating-axis test of tri and the voxel around (x, y, z)."""
    h = _V / 2
    v = {n: [f"(v{n}{a} - {a})" for a in "xyz"] for n in "abc"}
    edges = [[f"(vb{a} - va{a})" for a in "xyz"], [f"(vc{a} - vb{a})" for a in "xyz"], [f"(va{a} - vc{a})" for a in "xyz"]]
    axes = []
    for e in edges:
        axes += [["0", f"(-{e[2]})", e[1]], [e[2], "0", f"(-{e[0]})"], [f"(-{e[1]})", e[0], "0"]]
    axes += [["1", "0", "0"], ["0", "1", "0"], ["0", "0", "1"]]
    n, m = edges[0], edges[1]
    axes.append([f"({n[1]}*{m[2]} - {n[2]}*{m[1]})", f"({n[2]}*{m[0]} - {n[0]}*{m[2]})", f"({n[0]}*{m[1]} - {n[1]}*{m[0]})"])
    tests = []
    for ax in axes:
        spans = ", ".join(f"({ax[0]}*{p[0]} + {ax[1]}*{p[1]} + {ax[2]}*{p[2]})" for p in v.values())
        reach = f"{h} * (abs({ax[0]}) + abs({ax[1]}) + abs({ax[2]}))"
        tests.append(f"least({spans}) <= {reach} AND greatest({spans}) >= -({reach})")
    return " AND ".join(tests)


def _derived(text: str) -> str:
    """The scene's SQL with its numbers looked up."""
    return text.replace("{rooms}", "(SELECT rooms FROM par)").replace("{rows}", "(SELECT rows FROM par)").replace("{each_room}", "(SELECT unnest(range((SELECT rooms FROM par))) AS room) AS r")


def _range_of(c: str, n: str, last: str) -> str:
    names = ", ".join(f"v{k}{n}" for k in "abc")
    return f"unnest(range(CAST(greatest(floor(least({names}) / {_V}) - 1, 0) AS BIGINT), CAST(least(floor(greatest({names}) / {_V}), {last}) AS BIGINT) + 1)) AS {c}"


_NZ_SQL = f"{round(PITCH / _V)} * rows + {round(1 / _V)}"
_CELL = ", ".join(f"({c} + 0.5::DOUBLE) * {_V} AS {n}" for c, n in zip("ijk", "xyz"))
_PARTS = {
    "par": f"SELECT rooms, rows, {_NX} AS nx, {_NY} AS ny, CAST({_NZ_SQL} AS BIGINT) AS nz, CAST({_CX} * (({_NZ_SQL} + {_CV - 1}) // {_CV}) AS BIGINT) AS nc FROM (SELECT rooms, CAST(((parts + rooms - 1) // rooms + {ROW - 1}) // {ROW} AS BIGINT) AS rows FROM (SELECT (max(s_suppkey) + {RIG}) // {RIG} AS rooms, (SELECT max(p_partkey) + 1 FROM part) AS parts FROM supplier))",
    "cams": _derived(CAMERAS_SQL),
    "boxes": _derived(BOXES_SQL),
    "tri": _triangles(),
    "near": "SELECT c.cam_idx, tri.* FROM cams AS c JOIN tri ON tri.scene = c.scene AND " + " AND ".join(f"least(va{a}, vb{a}, vc{a}) <= p{a} + far AND greatest(va{a}, vb{a}, vc{a}) >= p{a} - far" for a in "xz"),
    "around": "SELECT *, unnest(range(CAST(floor((pz - far) / 4) AS BIGINT), CAST(floor((pz + far) / 4) AS BIGINT) + 1)) AS cell_z FROM (SELECT *, unnest(range(CAST(floor((px - far) / 4) AS BIGINT), CAST(floor((px + far) / 4) AS BIGINT) + 1)) AS cell_x FROM cams)",
    "cloud": _derived(POINTS_SQL),
    "asked": _derived(PROBES_SQL),
    "vox": f"SELECT scene, scene * nx * ny * nz + v AS point, i, j, k, scene * nc + i // {_CV} + {_CX} * (k // {_CV}) AS chunk_id, {_CELL} FROM (SELECT *, v % nx AS i, (v // nx) % ny AS j, v // (nx * ny) AS k FROM (SELECT u // (nx * ny * nz) AS scene, u % (nx * ny * nz) AS v, nx, ny, nz, nc FROM (SELECT unnest(range((SELECT rooms * nx * ny * nz FROM par))) AS u), par))",
    "mixed": f"SELECT DISTINCT scene, i, j, k FROM (SELECT *, {_CELL} FROM (SELECT *, {_range_of('k', 'z', '(SELECT nz FROM par) - 1')} FROM (SELECT *, {_range_of('j', 'y', str(_NY - 1))} FROM (SELECT *, {_range_of('i', 'x', str(_NX - 1))} FROM tri)))) WHERE {_meets()}",
    "valid": "SELECT * FROM vox WHERE NOT EXISTS (SELECT 1 FROM mixed WHERE mixed.scene = vox.scene AND mixed.i = vox.i AND mixed.j = vox.j AND mixed.k = vox.k)",
    "seen": _sees("valid"),
    "words": "SELECT point, CAST(bit_or(CASE WHEN cam_idx < 64 THEN bit ELSE 0 END) AS BIGINT) AS mask, CAST(bit_or(CASE WHEN cam_idx >= 64 THEN bit ELSE 0 END) AS BIGINT) AS mask_high, count(*) AS n FROM (SELECT *, CASE WHEN cam_idx % 64 = 63 THEN CAST(-9223372036854775808 AS BIGINT) ELSE 1::BIGINT << CAST(cam_idx % 64 % 63 AS BIGINT) END AS bit FROM seen) GROUP BY point",
    "masked": "SELECT v.*, CAST(coalesce(m.mask, 0) AS BIGINT) AS mask, CAST(coalesce(m.mask_high, 0) AS BIGINT) AS mask_high, CAST(coalesce(m.n, 0) AS BIGINT) AS cameras FROM valid AS v LEFT JOIN words AS m ON m.point = v.point",
    "regions": _derived(REGIONS_SQL),
    "held": "",
    "slabs": "SELECT * FROM (VALUES (0, 1, 0, 199, 1, 3, 0, 59, FALSE), (1, 0, 20, 50, 0, 5, 3, 33, FALSE), (2, 2, 0, 119, 0, 5, 5, 16, TRUE)) AS s(slab, axis, i0, i1, j0, j1, k0, k1, filter)",
    "cols": "SELECT v.scene, slab, CASE WHEN axis = 0 THEN v.j ELSE v.i END AS a, CASE WHEN axis = 2 THEN v.j ELSE v.k END AS b, m.cameras, m.mask, m.mask_high, filter AND marks.point IS NULL AS filtered FROM vox AS v JOIN slabs ON v.i BETWEEN i0 AND i1 AND v.j BETWEEN j0 AND j1 AND v.k BETWEEN k0 AND k1 LEFT JOIN masked AS m ON m.point = v.point LEFT JOIN marks ON marks.point = v.point",
}
_lx, _ly, _lz = _local("x - rx", "y - ry", "z - rz", "fq")
_F32 = ", ".join(f"CAST(CAST({c} AS FLOAT) AS DOUBLE) AS {c}" for c in ("rx", "ry", "rz", "hx", "hy", "hz"))
_PARTS["held"] = (
    f"SELECT m.*, r.region, r.group_id FROM masked AS m JOIN (SELECT scene, region, group_id, {_F32}, {', '.join(f'CAST(CAST(rq{a} AS FLOAT) AS DOUBLE) AS fq{a}' for a in 'xyzw')} FROM regions) AS r ON r.scene = m.scene WHERE abs{_lx} <= hx AND abs{_ly} <= hy AND abs{_lz} <= hz"
)
#: Voxels, free or not, that the regions hold.
_PARTS["marks"] = _PARTS["held"].replace("SELECT m.*, r.region, r.group_id FROM masked", "SELECT DISTINCT m.point FROM vox")
_NEEDS = {
    "cams": ["par"], "boxes": ["par"], "cloud": ["par"], "asked": ["par"], "regions": ["par"], "vox": ["par"], "tri": ["boxes"], "near": ["cams", "tri", "around"], "around": ["cams"], "mixed": ["tri"], "valid": ["vox", "mixed"],
    "seen": ["valid", "near"], "words": ["seen"], "masked": ["valid", "words"], "held": ["masked", "regions"], "marks": ["vox", "regions"], "cols": ["vox", "slabs", "masked", "marks"],
}


def sql(select: str, *parts: str, more: dict[str, str] | None = None) -> str:
    """``select`` with the named parts, and what those need, before it."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for p in parts:
        add(p)
    bodies = [f"{n} AS MATERIALIZED ({_PARTS[n]})" for n in order] + [f"{n} AS ({b})" for n, b in (more or {}).items()]
    return ("WITH RECURSIVE " + ",\n".join(bodies) + "\n" if bodies else "") + select


SEES_CLOUD = _sees("cloud")
OFFSETS = [tuple(0.35 * _V * s for s in signs) for signs in product((-1, 1), repeat=3)]
SAMPLES = "SELECT scene, point, x + ox AS x, y + oy AS y, z + oz AS z FROM valid, (VALUES " + ", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for a, b, c in OFFSETS) + ") AS o(ox, oy, oz)"
SEES_SAMPLES = _sees("samples")
_ax, _ay, _az = (f"(-{('(2 * (qx * qz + qy * qw))', '(2 * (qy * qz - qx * qw))', '(1 - 2 * (qx * qx + qy * qy))')[i]})" for i in range(3))
CENTRE_RAYS = f"SELECT scene, cam_idx, {_hit('p', 'd', '1e-9', '1e300', 'min(tn / det)')} AS distance FROM (SELECT *, {_ax} AS dx, {_ay} AS dy, {_az} AS dz FROM cams) AS r"
