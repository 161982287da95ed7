"""Hard negatives by dual-tree search (operator 12).

An anchor's positives are its ``POSITIVES`` nearest other rows of the same label by inner product.  For each positive of score p the hard
negatives are the nearest rows of another label with scores from ``LEAST_PERCENT`` of p to p.

Both are searches over the same shards (``vectors``), in two sweeps: probes of the first want rows of their own label, probes of the
second, one for each anchor and positive, rows of another label inside of the positive's window.  In a tile there is a tree over
the probes and one over the shard's blocks; every node has its box, its ball and its labels.  From the pair of roots down, a pair
of nodes has an interval of inner products (of the boxes, cut to what the balls allow); a pair whose interval lies below
what every probe of the node still needs, above what any of them may take, or whose labels rule each other out, goes with all
its descendants, so whole groups of anchors are pruned at once.  Pairs of leaves that stay are scored exactly, best intervals first.

Nulls: rows without label, and vectors that are null or hold null or non-finite entries, take no part; a row without vec_id is no anchor and comes
after its equals.  A positive with a negative score has an empty window.  Repeated rows are rows of their own.  An empty table, or one
of a single label, gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise
from .vectors import Shards, Tile, embeddings, halved, quantised

POSITIVES, NEGATIVES = 5, 5
FACTOR = 256
LEAST_PERCENT = 80
#: Probes in a leaf of their tree.
LEAF = 8
#: Pairs of nodes whose intervals are found at once.
PAIRS_AT_ONCE = 1 << 15


class Tree:
    """Leaves and, pair by pair, what lies above them; ``levels[0]`` are the leaves.  Each level has boxes, radii around their middles, and labels."""

    def __init__(self, x: np.ndarray, label: np.ndarray, first: np.ndarray):
        fold = lambda f, v: f.reduceat(v, first[:-1], axis=0)
        x = x.astype("f8")
        lo, hi, a, b = fold(np.minimum, x), fold(np.maximum, x), fold(np.minimum, label), fold(np.maximum, label)
        sizes = np.diff(first)
        self.levels = []
        while True:
            away = np.linalg.norm(x - np.repeat((lo + hi) / 2, sizes, axis=0), axis=1)
            ends = np.append(0, np.cumsum(sizes))
            self.levels.append((lo, hi, np.maximum.reduceat(away, ends[:-1]), a, b))
            if len(lo) == 1:
                return
            pairs = np.arange(0, len(lo), 2)
            lo, hi, a, b, sizes = np.minimum.reduceat(lo, pairs), np.maximum.reduceat(hi, pairs), np.minimum.reduceat(a, pairs), np.maximum.reduceat(b, pairs), np.add.reduceat(sizes, pairs)


def interval(mine: tuple[np.ndarray, ...], theirs: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of any vectors of two nodes, pair by pair; whole numbers, never too narrow."""
    (lo, hi, r), (low, high, s) = mine[:3], theirs[:3]
    ends = np.stack([lo * low, lo * high, hi * low, hi * high])
    c, d = (lo + hi) / 2, (low + high) / 2
    middle, spread = (c * d).sum(axis=1), r * np.linalg.norm(d, axis=1) + s * np.linalg.norm(c, axis=1) + r * s
    slack = 1e-9 * (np.abs(middle) + spread) + 1e-6
    return np.maximum(ends.min(axis=0).sum(axis=1), np.ceil(middle - spread - slack)), np.minimum(ends.max(axis=0).sum(axis=1), np.floor(middle + spread + slack))


def descend(probes: Tree, blocks: Tree, need: list[np.ndarray], most: list[np.ndarray], same: bool, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The pairs of leaves that may hold a find, the largest score of each, and how many pairs of nodes were looked at.

    ``need``: for each level of the probes' tree what a find of any of a node's probes must pass (see ``Tile``), ``most`` the largest score that one may take.
    """
    i, j = len(probes.levels) - 1, len(blocks.levels) - 1
    mine, theirs, looked = np.zeros(1, np.int64), np.zeros(1, np.int64), 0
    while True:
        keep, top = [], []
        for start in range(0, len(mine), PAIRS_AT_ONCE):
            m, t = mine[start : start + PAIRS_AT_ONCE], theirs[start : start + PAIRS_AT_ONCE]
            node, other = (tuple(v[w] for v in tree.levels[level]) for tree, level, w in ((probes, i, m), (blocks, j, t)))
            lo, hi = interval(node, other)
            good = (hi * scale > need[i][m]) & (lo <= most[i][m])
            if same:
                good &= (node[3] <= other[4]) & (other[3] <= node[4])
            else:
                good &= (node[3] != node[4]) | (other[3] != other[4]) | (node[3] != other[3])
            keep.append(good)
            top.append(hi)
        looked += len(mine)
        good, top = np.concatenate([np.zeros(0, bool), *keep]), np.concatenate([np.zeros(0), *top])
        mine, theirs, top = mine[good], theirs[good], top[good]
        if not i and not j:
            return mine, theirs, top, looked
        for tree, level in ((probes, i), (blocks, j)):
            if level:
                n = len(tree.levels[level - 1][0])
                which = mine if tree is probes else theirs
                child = (2 * which[:, None] + np.arange(2)).ravel()
                mine, theirs = (child, np.repeat(theirs, 2)) if tree is probes else (np.repeat(mine, 2), child)
                mine, theirs = mine[child < n], theirs[child < n]
        i, j = max(0, i - 1), max(0, j - 1)


def search_tile(held: pa.Table, asked: pa.Table, width: int, exact: str, k: int, same: bool) -> tuple[pa.Table, int, int]:
    """The finds of a tile, the pairs of leaves scored, and all pairs of leaves."""
    tile = Tile(held, asked, width, exact, k)
    most = asked["most"].fill_null(1 << 45).to_numpy()
    members = halved(tile.q, tile.q_label, LEAF)
    order = np.concatenate(members)
    first = np.append(0, np.cumsum([len(m) for m in members]))
    probes, blocks = Tree(tile.q[order], tile.q_label[order], first), Tree(tile.x, tile.label, tile.first)
    need, cap = [np.minimum.reduceat(tile.need[order], first[:-1])], [np.maximum.reduceat(most[order], first[:-1])]
    for _ in probes.levels[1:]:
        pairs = np.arange(0, len(need[-1]), 2)
        need.append(np.minimum.reduceat(need[-1], pairs))
        cap.append(np.maximum.reduceat(cap[-1], pairs))
    leaf, block, top, _ = descend(probes, blocks, need, cap, same, tile.scale)
    best = top.astype(np.int64) * tile.scale - tile.reduce(np.minimum, tile.rank)[block]

    def allowed(which: np.ndarray, rows: np.ndarray, score: np.ndarray) -> np.ndarray:
        alike = tile.q_label[which][:, None] == tile.label[rows]
        return (alike == same) & (score <= most[which][:, None])

    scored = tile.resolve(leaf, block, best, members, allowed)
    return tile.finds(), scored, len(members) * (len(tile.first) - 1)


def _kernel(width: int, exact: str, k: int, same: bool):
    def run(held: pa.Table, asked: pa.Table) -> pa.Table:
        if not held.num_rows or not asked.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "slot": pa.array([], pa.int32()), **{c: pa.array([], pa.int64()) for c in ("score", "vec_id", "row")}})
        return search_tile(held, asked, width, exact, k, same)[0]

    return run


def mine(df: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least_percent: int = LEAST_PERCENT, factor: int = FACTOR) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score for the rows of ``df`` (vec_id, label, embedding) where ``anchors`` holds."""
    rows = quantised(df.where("label IS NOT NULL"), factor, [F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label")])
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()))
    index = Shards(rows, by_label=True)
    none = F.lit(None).cast("long")
    asking = index.rows.where(anchors).select(F.col("row").alias("query"), F.col("vec_id").alias("anchor_id"), "shard", "label", "vector")
    first = asking.select("query", F.lit(0).alias("slot"), "shard", "label", "vector", none.alias("least"), none.alias("most"))
    near = index.search(first, _kernel(index.width, index.exact, positives, True), positives)
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row"))
    near = near.select("query", nth.alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    pairs = materialise(asking.join(near, "query"))
    least = F.expr(f"({least_percent} * positive_score + 99) DIV 100")
    second = pairs.where("positive_score >= 0").select("query", "slot", "shard", "label", "vector", least.alias("least"), F.col("positive_score").alias("most"))
    far = index.search(second, _kernel(index.width, index.exact, negatives, False), negatives)
    rank = F.row_number().over(Window.partitionBy("query", "slot").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row"))
    far = far.select("query", "slot", rank.alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return pairs.join(far, ["query", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir).withColumn("label", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"))
    return mine(rows, F.col("vec_id") % 100 == 0)
