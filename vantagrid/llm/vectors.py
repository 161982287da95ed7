"""Embeddings as integer vectors, dealt into shards and blocks of neighbours, and searches that sweep over the shards.

*Vectors.*  A vector takes part if it is there and none of its entries is null or not finite; every entry c becomes floor(factor * c).
Vectors of different lengths are filled up with zeros.  Scores are exact whole numbers: a vector whose scores might pass 2 ** 44
raises an error (entries of 64 dimensions may reach 524,288).

*Shards.*  Rows are ordered by label (where that counts), then by the nearest of ``PIVOTS`` rows and by how near it is, and cut into
ranges of near equal size, ``SHARD_ROWS`` at most by count; the pivots are a bounded sample and decide on order alone.  A row's number
breaks ties, so one vector that holds a third of all rows fills several shards.  Inside of a shard a task halves the rows at the
median of their widest direction until blocks have ``BLOCK_ROWS``.

*Sweeps.*  A search looks at its own shard first, then at the next 15 around the circle of shards, then at the next 240, ...  What it has
found so far is a bound for the shards to come: before a probe is sent anywhere, the largest score that its shard could give is
held against it.  Probes and shards meet as tiles of bounded size on both sides, and every round's finds are written to the shared
folder, so a lost executor repeats tiles of one round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, materialise

PIVOTS = 64
SHARD_ROWS, LEAST_ROWS = 65_536, 1024
BLOCK_ROWS = 64
#: Probes that meet a shard in one tile.
TILE_PROBES = 65_536
#: Shards that a round looks at, in all, grow by this.
ROUND = 16
#: The shards' extents go to the tasks up to this size; beyond it every probe goes to every shard of its round.
EXTENT_BYTES = 8 << 20
_MOST = 1 << 44
_FOUND = "query long, slot int, score long, vec_id long, row long"


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def quantised(df: DataFrame, factor: int, keep: list[str]) -> DataFrame:
    """``keep`` and the whole numbers ``x`` of every vector that takes part."""
    finite = F.forall("v", lambda c: F.abs(c) < float("inf"))  # NaN is larger, null is neither
    rows = df.select(*keep, F.col("embedding").cast("array<double>").alias("v")).where("v IS NOT NULL").where(finite)
    return rows.select(*keep, F.transform("v", lambda c: F.floor(c * factor).cast("long")).alias("x"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of ``width`` whole numbers, short ones filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def packed(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(x, "<i4")], pa.binary())


def unpacked(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, width) if width else np.zeros((len(column), 0), "<i4")


def halved(x: np.ndarray, label: np.ndarray, size: int) -> list[np.ndarray]:
    """The rows in groups of ``size`` at most, by halving: between labels where there are several, else at the median of the widest direction."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        part = todo.pop()
        if len(part) <= size:
            out.append(part)
            continue
        own, cut = label[part], len(part) // 2
        if own.min() != own.max():
            by = np.argsort(own, kind="stable")
            edges = np.flatnonzero(np.diff(own[by])) + 1
            cut = int(edges[np.abs(edges - cut).argmin()])
        else:
            v = x[part]
            by = np.argpartition(v[:, v.var(axis=0).argmax()], cut) if v.shape[1] else np.arange(len(part))
        todo += [part[by[cut:]], part[by[:cut]]]
    return out


class Shards:
    """A table of vectors (row, vec_id, label, x) as blocks, and the probes taken from it."""

    def __init__(self, rows: DataFrame, by_label: bool):
        spark = rows.sparkSession
        largest = F.array_max(F.transform("x", lambda c: F.abs(c)))
        self.n, self.width, top = (v or 0 for v in rows.agg(F.count("*"), F.max(F.size("x")), F.max(largest)).first())
        if top * top * self.width >= _MOST:
            raise ValueError(f"entries up to {top} in {self.width} dimensions: scores may pass 2 ** 44")
        self.exact = "f4" if top * top * self.width < 1 << 24 else "f8"
        cores = spark.sparkContext.defaultParallelism
        self.shards = max(1, -(-self.n // SHARD_ROWS), min(2 * cores, -(-self.n // LEAST_ROWS)))
        width, exact = self.width, self.exact
        pivots = [r[0] for r in rows.orderBy(F.xxhash64("x"), "row").limit(PIVOTS).select("x").collect()]
        pivots = matrix(pa.array(pivots, pa.list_(pa.int64())), width).astype("f8")

        def nearest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for x in batches:
                score = matrix(x, width) @ pivots.T
                best = score.argmax(axis=1) if len(pivots) else np.zeros(len(x), np.int64)
                yield pa.StructArray.from_arrays([pa.array(best, pa.int32()), pa.array(score[np.arange(len(x)), best].astype(np.int64))], ["pivot", "near"])

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            shard, got = TaskContext.get().partitionId(), [b for b in batches if b.num_rows]
            if not got:
                return
            table = pa.Table.from_batches(got).combine_chunks()
            x, label = matrix(table["x"], width), table["label"].fill_null(-1).to_numpy()
            for k, part in enumerate(halved(x, label if by_label else np.zeros(len(x), np.int64), BLOCK_ROWS)):
                rows = table.select(["row", "vec_id", "label"]).take(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(part), pa.int32()), pa.array([k] * len(part), pa.int32()), *(c.combine_chunks() for c in rows.columns), packed(x[part])],
                    ["shard", "block", "row", "vec_id", "label", "vector"],
                )

        at = rows.withColumn("at", F.arrow_udf(nearest, "pivot int, near long")("x"))
        order = [*(["label"] if by_label else []), "at.pivot", F.desc("at.near"), "row"]
        dealt = at.repartitionByRange(self.shards, *order).select("row", "vec_id", F.col("label").cast("long").alias("label"), "x")
        self.rows = materialise(dealt.mapInArrow(blocks, "shard int, block int, row long, vec_id long, label long, vector binary"))
        self.shards = (self.rows.agg(F.max("shard")).first()[0] or 0) + 1
        self.extent = self._extents() if self.shards * self.width * 8 <= EXTENT_BYTES else None

    def _extents(self) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest entry of each shard in each direction."""
        width = self.width

        def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, shard = unpacked(b["vector"], width), b["shard"].to_numpy()
                for s in np.unique(shard):
                    own = x[shard == s]
                    yield pa.RecordBatch.from_arrays([pa.array([int(s)], pa.int32()), pa.array([own.min(axis=0)]), pa.array([own.max(axis=0)])], ["shard", "least", "most"])

        each = self.rows.select("shard", "vector").mapInArrow(of_task, "shard int, least array<int>, most array<int>")
        fold = lambda c, best: F.array(*(best(F.col(c)[d]) for d in range(width))).alias(c)
        least, most = np.zeros((self.shards, width)), np.zeros((self.shards, width))
        least[:], most[:] = np.inf, -np.inf  # a shard without rows can't be of use
        for s, a, b in each.groupBy("shard").agg(fold("least", F.min), fold("most", F.max)).collect():
            least[s], most[s] = a, b
        return least, most

    def search(self, probes: DataFrame, kernel: Callable[[pa.Table, pa.Table], pa.Table], k: int) -> DataFrame:
        """query, slot, score, vec_id and row of the first ``k`` finds of each probe, by score, then vec_id.

        ``probes``: query (number of the row that asks), slot, shard (where it lies), label, vector, least (score that a find must have; may be null).
        ``kernel`` gets the rows of a shard and the probes that may find something there, with ``score`` and ``vec_id`` of what they'd have to beat.
        """
        spark, width, shards, extent = probes.sparkSession, self.width, self.shards, self.extent
        groups = max(1, -(-probes.count() // TILE_PROBES))
        found, a = spark.createDataFrame([], _FOUND), 0

        def visits(a: int, b: int):
            def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
                for vector, home, need in batches:
                    x, start = unpacked(vector, width).astype("f8"), home.to_numpy()
                    least = need.fill_null(-(1 << 62)).to_numpy()
                    out = (start[:, None] + np.arange(a, b)) % shards
                    keep = np.ones(out.shape, bool)
                    if extent and len(x):
                        ends = [np.where(np.isfinite(e), e, 0) for e in extent]
                        reach = np.maximum(x, 0) @ ends[1].T + np.minimum(x, 0) @ ends[0].T
                        reach[:, ~np.isfinite(extent[1]).all(axis=1)] = -np.inf
                        keep = np.take_along_axis(reach, out, 1) >= least[:, None]
                    yield pa.array([o[m].tolist() for o, m in zip(out, keep)], pa.list_(pa.int32()))

            return F.arrow_udf(run, "array<int>")

        while a < shards:
            b = min(shards, 1 if not a else a * ROUND)
            full = found.groupBy("query", "slot").agg(F.count("*").alias("n"), F.max(F.struct(-F.col("score"), "vec_id")).alias("last")).where(F.col("n") == k)
            beat = full.select("query", "slot", (-F.col("last.col1")).alias("score"), F.col("last.vec_id").alias("vec_id"))
            asked = probes.join(beat, ["query", "slot"], "left") if a else probes.withColumns({"score": F.lit(None).cast("long"), "vec_id": F.lit(None).cast("long")})
            to = F.explode(visits(a, b)("vector", "shard", F.greatest("score", "least"))).alias("to")
            group = F.floor(F.col("shard") * groups / shards).cast("int").alias("tile")
            sent = materialise(asked.select(group, to, "query", "slot", "label", "vector", "least", *(["most"] if "most" in probes.columns else []), "score", "vec_id"))
            tiles = sent.select(F.col("tile").alias("meets"), F.col("to").alias("shard")).distinct()
            hits = self.rows.join(tiles, "shard").groupBy("meets", "shard").cogroup(sent.groupBy("tile", "to")).applyInArrow(kernel, _FOUND)
            nth = F.row_number().over(Window.partitionBy("query", "slot").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row"))
            found = materialise((found.union(hits) if a else hits).withColumn("nth", nth).where(F.col("nth") <= k).drop("nth"))
            a = b
        return found


class Tile:
    """The rows of a shard in the order of their blocks, against probes of which each keeps its ``k`` best.

    A find is one whole number, its score times the number of rows less its rank by vec_id: so scores, ties and what is still
    to be beaten compare at once, and nothing is lost among equals.
    """

    def __init__(self, held: pa.Table, probes: pa.Table, width: int, exact: str, k: int):
        held = held.sort_by("block")
        self.x, block = unpacked(held["vector"], width).astype(exact), held["block"].to_numpy()
        self.first = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(block))
        self.row, self.label = held["row"].to_numpy(), held["label"].fill_null(-1).to_numpy()
        ids = held["vec_id"].to_numpy() if not held["vec_id"].null_count else held["vec_id"].fill_null((1 << 63) - 1).to_numpy()
        self.id, order = held["vec_id"].combine_chunks(), np.lexsort((self.row, ids))
        self.by_rank, self.rank = order, np.empty(len(ids), np.int64)
        self.rank[order] = np.arange(len(ids))
        self.scale, self.k, self.probes = len(ids) + 1, k, probes
        self.q = unpacked(probes["vector"], width).astype(exact)
        self.own, self.q_label = probes["query"].to_numpy(), probes["label"].fill_null(-1).to_numpy()
        none = -(1 << 62)
        score, least = (probes[c].fill_null(none).to_numpy() for c in ("score", "least"))
        passed = np.searchsorted(ids[order], probes["vec_id"].fill_null((1 << 63) - 1).to_numpy())
        beat = np.where(score > none, np.maximum(score, -_MOST) * self.scale - passed, none)
        self.need = np.maximum(beat, np.where(least > none, (np.maximum(least, -_MOST) - 1) * self.scale, none))
        self.best = np.full((len(self.q), k), none)

    def reduce(self, fold: np.ufunc, values: np.ndarray) -> np.ndarray:
        """``values`` of the rows, folded block by block."""
        return fold.reduceat(values, self.first[:-1], axis=0)

    def resolve(self, unit: np.ndarray, block: np.ndarray, best: np.ndarray, members: list[np.ndarray] | None, allowed: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None) -> int:
        """Scores pairs of units (probes, or groups of them: ``members``) and blocks, those with the best bounds of each unit first, as long as a bound passes what some member has as its ``k``-th; gives the pairs scored."""
        order = np.lexsort((-best, unit))
        unit, block, best = unit[order], block[order], best[order]
        place = np.arange(len(unit)) - np.searchsorted(unit, unit)
        scored, a, b = 0, 0, 1
        while True:
            need = self.need if members is None else np.array([self.need[m].min() for m in members])
            alive = (place >= a) & (best > need[unit]) if len(unit) else np.zeros(0, bool)
            if not alive.any():
                return scored
            unit, block, best, place = unit[alive], block[alive], best[alive], place[alive]
            now = np.flatnonzero(place < b)
            now = now[np.argsort(block[now], kind="stable")]
            scored += len(now)
            edges = np.flatnonzero(np.diff(block[now], prepend=-1, append=-1))
            finds = []
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                which = unit[now[lo:hi]] if members is None else np.concatenate([members[u] for u in unit[now[lo:hi]]])
                rows = slice(self.first[block[now[lo]]], self.first[block[now[lo]] + 1])
                score = self.q[which] @ self.x[rows].T
                key = score.astype(np.int64) * self.scale - self.rank[rows]
                good = (key > self.need[which][:, None]) & (self.row[rows] != self.own[which][:, None])
                if allowed is not None:
                    good &= allowed(which, np.arange(rows.start, rows.stop), score)
                p, r = np.nonzero(good)
                finds.append((which[p], key[p, r]))
            self._keep(np.concatenate([f for f, _ in finds]), np.concatenate([f for _, f in finds]))
            a, b = b, 2 * b

    def _keep(self, probe: np.ndarray, key: np.ndarray) -> None:
        order = np.lexsort((-key, probe))
        probe, key = probe[order], key[order]
        nth = np.arange(len(probe)) - np.searchsorted(probe, probe)
        probe, key, nth = (v[nth < self.k] for v in (probe, key, nth))
        mine, at = np.unique(probe, return_inverse=True)
        fresh = np.full((len(mine), self.k), -(1 << 62))
        fresh[at, nth] = key
        self.best[mine] = -np.sort(-np.concatenate([self.best[mine], fresh], axis=1), axis=1)[:, : self.k]
        self.need[mine] = np.maximum(self.need[mine], self.best[mine, -1])

    def finds(self) -> pa.Table:
        p, j = np.nonzero(self.best > -(1 << 62))
        key = self.best[p, j]
        rank = -key % self.scale
        at = self.by_rank[rank]
        columns = [pa.array(self.own[p]), self.probes["slot"].combine_chunks().take(pa.array(p)), pa.array((key + rank) // self.scale), self.id.take(pa.array(at)), pa.array(self.row[at])]
        return pa.table(columns, names=["query", "slot", "score", "vec_id", "row"])
