"""Choosing camera positions: marginal gains, random layouts, the best per count, shares, and assignment of cameras to targets.

What a layout covers depends only on which sets of cameras see a voxel, so voxels are first counted by their set
(``mask_groups``); all that follows works on these counts, scene by scene.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import bits


def mask_groups(masked: DataFrame) -> DataFrame:
    """scene, mask, mask_high and n: how many voxels each set of cameras covers; uncovered ones are left out."""
    return masked.where("mask != 0 OR mask_high != 0").groupBy("scene", "mask", "mask_high").agg(F.count("*").alias("n"))


def _greedy(groups: pa.Table, places: pa.Table) -> pa.Table:
    schema = pa.schema([("scene", pa.int64()), ("step", pa.int32()), ("place", pa.int32()), ("covered", pa.int64())])
    if not places.num_rows:
        return schema.empty_table()
    place, at = places["place"].to_numpy(), np.stack([places[c].to_numpy() for c in ("px", "py", "pz")], axis=1)
    order = np.argsort(place)
    place, at = place[order], at[order]
    words = [groups[c].to_numpy().view(np.uint64) if groups.num_rows else np.zeros(0, np.uint64) for c in ("mask", "mask_high")]
    n = groups["n"].to_numpy() if groups.num_rows else np.zeros(0, np.int64)
    sees = np.stack([(words[p // 64] >> np.uint64(p % 64)) & np.uint64(1) for p in place]).astype(bool)
    left, free, apart, chosen, curve = n.copy(), np.ones(len(place), bool), np.zeros(len(place)), [], [0]
    while free.any():
        gain = np.where(free, sees @ left, -1)
        best = np.flatnonzero(gain == gain.max())
        pick = best[np.argmax(apart[best])]
        curve.append(curve[-1] + int(gain[pick]))
        chosen.append(int(place[pick]))
        free[pick], left = False, np.where(sees[pick], 0, left)
        away = np.linalg.norm(at - at[pick], axis=1)
        apart = away if len(chosen) == 1 else np.minimum(apart, away)
    scene = places["scene"][0].as_py()
    return pa.table([[scene] * len(chosen), range(1, len(chosen) + 1), chosen, curve[1:]], schema=schema)


def greedy_curve(groups: DataFrame, places: DataFrame) -> DataFrame:
    """scene, step, place and the voxels covered so far: each step takes the place that newly covers most.

    Equal gains go to the place farthest from those chosen, then to the lower number.  ``places`` (scene, place, px, py, pz) are
    at most 128 a scene, and a scene's groups are its different sets of cameras, not its voxels.
    """
    return groups.groupBy("scene").cogroup(places.groupBy("scene")).applyInArrow(_greedy, "scene long, step int, place int, covered long")


def trial_curve(orders: DataFrame, groups: DataFrame) -> DataFrame:
    """scene, trial, k and how many voxels the first k places of that trial's order cover: a set counts where its first camera appears."""
    each = groups.select("scene", "mask", "mask_high", "n", F.explode(bits()).alias("place"))
    first = orders.join(each, ["scene", "place"]).groupBy("scene", "trial", "mask", "mask_high").agg(F.min("k").alias("k"), F.first("n").alias("n"))
    fresh = first.groupBy("scene", "trial", "k").agg(F.sum("n").alias("fresh"))
    steps = orders.select("scene", "trial", "k").join(fresh, ["scene", "trial", "k"], "left").fillna(0)
    return steps.select("scene", "trial", "k", F.sum("fresh").over(Window.partitionBy("scene", "trial").orderBy("k")).alias("score"))


def separations(orders: DataFrame, places: DataFrame) -> DataFrame:
    """scene, trial, k and the least distance between any two of the first k places; null for the first."""
    at = orders.join(places, ["scene", "place"])
    earlier = at.select("scene", "trial", F.col("k").alias("k0"), *(F.col(c).alias(f"{c}0") for c in ("px", "py", "pz")))
    away = F.sqrt(sum(((F.col(c) - F.col(f"{c}0")) ** 2 for c in ("px", "py", "pz")), F.lit(0.0)))
    near = at.join(earlier, ["scene", "trial"]).where("k0 < k").groupBy("scene", "trial", "k").agg(F.min(away).alias("d"))
    steps = orders.select("scene", "trial", "k").join(near, ["scene", "trial", "k"], "left")
    return steps.select("scene", "trial", "k", F.min("d").over(Window.partitionBy("scene", "trial").orderBy("k")).alias("separation"))


def best_per_count(curve: DataFrame, apart: DataFrame) -> DataFrame:
    """For each scene and k the trial with the highest score, then the widest separation, then the lower trial."""
    order = Window.partitionBy("scene", "k").orderBy(F.desc("score"), F.desc_nulls_last("separation"), "trial")
    rows = curve.join(apart, ["scene", "trial", "k"]).withColumn("nth", F.row_number().over(order))
    return rows.where("nth = 1").select("scene", "k", "trial", "score")


def knee(curve: DataFrame, total: int, percent: float) -> DataFrame:
    """For each scene the fewest cameras whose score is within ``percent`` of ``total`` of the best."""
    best = curve.groupBy("scene").agg(F.max("score").alias("best"), F.count("*").alias("n"))
    enough = F.min(F.when(F.col("score") >= F.col("best") - percent / 100 * total, F.col("k")))
    return curve.join(best, "scene").groupBy("scene").agg(F.coalesce(enough, F.max("n")).alias("cameras"))


def shares(weights: DataFrame, pool: int) -> DataFrame:
    """``pool`` places dealt to constraints by weight, one each at least; what rounding leaves or takes too much is settled in rounds, in order of weight."""
    one = weights.groupBy().agg(F.sum("w").alias("total"), F.count("*").alias("n"))
    rows = weights.crossJoin(F.broadcast(one))  # one row
    rows = rows.withColumn("share", F.greatest(F.lit(1), F.floor(pool * F.col("w") / F.col("total") + 0.5)).cast("long"))
    every = Window.partitionBy(F.lit(0))  # constraints are declared by hand: a few dozen rows
    rows = rows.withColumn("rank", F.row_number().over(every.orderBy(F.desc("w"), "idx"))).withColumn("missing", pool - F.sum("share").over(every))
    extra = F.when(F.col("missing") > 0, F.floor(F.col("missing") / F.col("n")) + (F.col("rank") <= F.col("missing") % F.col("n")).cast("long")).otherwise(F.lit(0))
    # Too much goes back one by one, a round through all that have more than one at a time.
    back = rows.where("missing < 0 AND share > 1").select("idx", "rank", "missing", F.explode(F.sequence(F.lit(1).cast("long"), F.col("share") - 1)).alias("turn"))
    back = back.withColumn("nth", F.row_number().over(every.orderBy("turn", "rank"))).where("nth <= -missing").groupBy("idx").agg(F.count("*").alias("back"))
    rows = rows.withColumn("extra", extra).join(back, "idx", "left").fillna(0, ["back"])
    return rows.select("idx", F.when(F.lit(pool) <= F.col("n"), F.lit(1)).otherwise(F.col("share") + F.col("extra") - F.col("back")).cast("long").alias("share"))


def least_matching(cost: np.ndarray) -> np.ndarray:
    """For each row of a cost matrix with at least as many columns its column in a matching of least total cost.

    Each round relaxes all alternating paths from the free rows until none gets shorter and turns the shortest one over.
    """
    n, m = cost.shape
    taken, owner = np.full(n, -1), np.full(m, -1)
    for _ in range(n):
        to_row, from_column = np.where(taken < 0, 0.0, np.inf), np.full(m, -1)
        to_column = np.full(m, np.inf)
        while True:
            through = to_row[:, None] + cost
            through[np.flatnonzero(taken >= 0), taken[taken >= 0]] = np.inf
            best = through.argmin(axis=0)
            shorter = through[best, np.arange(m)] < to_column - 1e-12
            if not shorter.any():
                break
            to_column[shorter], from_column[shorter] = through[best, np.arange(m)][shorter], best[shorter]
            held = np.flatnonzero(owner >= 0)
            to_row[owner[held]] = to_column[held] - cost[owner[held], held]
        column = int(np.where(owner < 0, to_column, np.inf).argmin())
        while column >= 0:
            row = int(from_column[column])
            owner[column], taken[row], column = row, column, int(taken[row])
    return taken


_PLAN = "scene long, action string, camera int, target int, distance double"


def _matched(cameras: pa.Table, targets: pa.Table) -> pa.Table:
    place = lambda t, key: (t[key].to_numpy(), np.stack([t[c].to_numpy() for c in ("px", "py", "pz")], axis=1)) if t.num_rows else (np.zeros(0, np.int64), np.zeros((0, 3)))
    (cams, a), (wanted, b) = place(cameras, "camera"), place(targets, "target")
    scene = (cameras if cameras.num_rows else targets)["scene"][0].as_py()
    by_cam, by_want = np.argsort(cams, kind="stable"), np.argsort(wanted, kind="stable")
    cams, a, wanted, b = cams[by_cam], a[by_cam], wanted[by_want], b[by_want]
    cost = np.linalg.norm(a[:, None] - b[None], axis=2)
    if len(cams) <= len(wanted):
        pairs = list(enumerate(least_matching(cost).tolist())) if len(cams) else []
    else:
        pairs = [(c, t) for t, c in enumerate(least_matching(cost.T).tolist())] if len(wanted) else []
    rows = [("move", int(cams[c]), int(wanted[t]), float(cost[c, t])) for c, t in sorted(pairs, key=lambda p: tuple(b[p[1]]))]
    used, met = {c for c, _ in pairs}, {t for _, t in pairs}
    rows += [("create", None, int(t), None) for k, t in enumerate(wanted) if k not in met] + [("disable", int(c), None, None) for k, c in enumerate(cams) if k not in used]
    columns = list(zip(*rows)) or [(), (), (), ()]
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.float64())
    return pa.table([pa.array([scene] * len(rows), pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["scene", "action", "camera", "target", "distance"])


def assign(cameras: DataFrame, targets: DataFrame) -> DataFrame:
    """How the cameras of each scene get to its targets with the least total way: scene, action, camera, target, distance.

    The scarcer side is matched wholly (``move``); targets left over ask for new cameras (``create``), cameras left over are switched off
    (``disable``).  A scene has 128 cameras at most, so its matching is one small task; scenes are dealt to tasks.
    """
    return cameras.groupBy("scene").cogroup(targets.groupBy("scene")).applyInArrow(_matched, _PLAN)
