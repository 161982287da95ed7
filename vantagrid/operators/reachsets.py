"""Sets of places that positions reach, as bitmaps: counts, unions, gains, random layouts and greedy ones, for pools of any size.

A set is a few rows: for each run of 32,768 points that it touches a bitmap of 4 KB, which pack well where reach is sparse.  Unions and counts are
Spark's own bitmap functions.  A layout needs no set in one place: each run of points is counted by itself and the counts are added up.

``sets`` have scene, place, bucket and bits; a place that reaches nothing has no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import checkpointed

BUCKET_BYTES = 4096
#: Fixed values of the 32-bit generator: its stride, its two factors, and what trials are mixed with.
STRIDE, FACTORS, TRIAL_MIX = 0x9E3779B9, (0x21F0AAAD, 0x735A2D97), 0x9E3779B1
_MASK = 0xFFFFFFFF


def reach_sets(rows: DataFrame) -> DataFrame:
    """The sets of (scene, place, point); repeated rows count once."""
    bucket, bit = F.bitmap_bucket_number("point").alias("bucket"), F.bitmap_construct_agg(F.bitmap_bit_position("point")).alias("bits")
    return rows.groupBy("scene", "place", bucket).agg(bit)


def counts(sets: DataFrame, *by: str) -> DataFrame:
    """How many points each set holds."""
    return sets.groupBy("scene", *(by or ("place",))).agg(F.sum(F.bitmap_count("bits")).alias("n"))


def union(sets: DataFrame) -> DataFrame:
    """scene, bucket and bits of what all sets of a scene hold together."""
    return sets.groupBy("scene", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def union_count(sets: DataFrame) -> DataFrame:
    return union(sets).groupBy("scene").agg(F.sum(F.bitmap_count("bits")).alias("n"))


def _bytes(column: pa.Array) -> np.ndarray:
    """Bitmaps as rows of bytes; null is empty."""
    none = bytes(BUCKET_BYTES)
    return np.frombuffer(b"".join(none if b is None else b for b in column.to_pylist()), np.uint8).reshape(len(column), BUCKET_BYTES)


def _fresh(bits: pa.Array, held: pa.Array) -> pa.Array:
    return pa.array(np.bitwise_count(_bytes(bits) & ~_bytes(held)).sum(axis=1, dtype=np.int64))


def gains(sets: DataFrame, held: DataFrame) -> DataFrame:
    """scene, place and how many points a set would add to what is ``held`` (scene, bucket, bits)."""
    fresh = F.arrow_udf(_fresh, "long")
    rows = sets.join(held.select("scene", "bucket", F.col("bits").alias("held")), ["scene", "bucket"], "left")
    return rows.groupBy("scene", "place").agg(F.sum(fresh("bits", "held")).alias("gain"))


def greedy(sets: DataFrame, places: DataFrame, most: int) -> DataFrame:
    """scene, step, place, covered: each of ``most`` steps takes the place (scene, place, px, py, pz) that adds most; of equals the one farthest from those taken, then the lower number.

    A step is one job for all scenes; a scene with fewer places ends earlier.
    """
    spark = sets.sparkSession
    left = places.select("scene", "place", "px", "py", "pz", F.lit(float("inf")).alias("apart"))
    held = spark.createDataFrame([], "scene long, bucket long, bits binary")
    chosen = spark.createDataFrame([], "scene long, step int, place int, gain long")
    for step in range(1, most + 1):
        rows = left.join(gains(sets, held), ["scene", "place"], "left").fillna(0, ["gain"])
        best = F.max_by(F.struct("place", "gain", "px", "py", "pz"), F.struct("gain", "apart", -F.col("place"))).alias("b")
        pick = checkpointed(rows.groupBy("scene").agg(best).select("scene", "b.*"))
        if pick.isEmpty():
            break
        chosen = chosen.union(pick.select("scene", F.lit(step).alias("step"), "place", "gain"))
        held = checkpointed(union(held.union(sets.join(pick.select("scene", "place"), ["scene", "place"], "left_semi").select("scene", "bucket", "bits"))))
        at = pick.select("scene", F.col("place").alias("taken"), *(F.col(f"p{a}").alias(f"t{a}") for a in "xyz"))
        away = F.sqrt(sum(((F.col(f"p{a}") - F.col(f"t{a}")) ** 2 for a in "xyz"), F.lit(0.0)))
        left = left.join(at, "scene").where("place <> taken").withColumn("apart", F.least("apart", away)).select(left.columns)
        left = checkpointed(left)
    return chosen.select("scene", "step", "place", F.sum("gain").over(Window.partitionBy("scene").orderBy("step")).alias("covered"))


def generator(seed, n):
    """The ``n``-th number, from 0, of the stream of ``seed``: at least 0, below 1.  Columns."""
    times = lambda h, f: (((F.shiftright(h, 16) * f).bitwiseAND(0xFFFF) * 65536) + h.bitwiseAND(0xFFFF) * f).bitwiseAND(F.lit(_MASK))
    x = (seed.cast("long").bitwiseAND(F.lit(_MASK)) + (n.cast("long") + 1) * F.lit(STRIDE)).bitwiseAND(F.lit(_MASK))
    x = x.bitwiseXOR(F.shiftright(x, 16))
    for factor in FACTORS:
        x = times(x, factor)
        x = x.bitwiseXOR(F.shiftright(x, 15))
    return x / F.lit(float(1 << 32))


def numbers(seed: int, count: int) -> np.ndarray:
    """The first ``count`` numbers of a stream."""
    x = np.uint32(seed & _MASK) + np.arange(1, count + 1, dtype=np.uint32) * np.uint32(STRIDE)
    x ^= x >> np.uint32(16)
    for factor in FACTORS:
        x *= np.uint32(factor)
        x ^= x >> np.uint32(15)
    return x / float(1 << 32)


def trial_orders(places: DataFrame, trials: int, most: int) -> DataFrame:
    """scene, trial, k and place: for every trial the first ``most`` places of a random order, from the scene's ``seed`` (scene, place, seed).

    A trial goes on from the order that the one before has left, with numbers that depend on seed and trial alone.  A scene's orders are one small task.
    """

    def orders(table: pa.Table) -> pa.Table:
        order, seed = np.sort(table["place"].to_numpy()), table["seed"][0].as_py()
        n, take, out = len(order), min(most, len(order)), []
        for t in range(trials):
            u = numbers(seed ^ ((t + 1) * TRIAL_MIX & _MASK), take)
            for i, j in enumerate((np.arange(take) + np.floor(u * (n - np.arange(take))).astype(int)).tolist()):
                order[[i, j]] = order[[j, i]]
            out.append(order[:take].copy())
        column = np.concatenate([*out, np.zeros(0, order.dtype)])
        return pa.table([pa.array(np.full(len(column), table["scene"][0].as_py()), pa.int64()), pa.array(np.repeat(np.arange(trials), take), pa.int32()), pa.array(np.tile(np.arange(1, take + 1), trials), pa.int32()), pa.array(column, pa.int32())], names=["scene", "trial", "k", "place"])

    return places.select("scene", F.col("place").cast("int").alias("place"), F.col("seed").cast("long").alias("seed")).groupBy("scene").applyInArrow(orders, "scene long, trial int, k int, place int")


def _prefixes(sets: pa.Table, orders: pa.Table) -> pa.Table:
    """How many points of one bucket the k-th place of each trial adds to those before it."""
    schema = pa.schema([("scene", pa.int64()), ("trial", pa.int32()), ("k", pa.int32()), ("fresh", pa.int64())])
    if not sets.num_rows or not orders.num_rows:
        return schema.empty_table()
    place, bits = sets["place"].to_numpy(), _bytes(sets["bits"].combine_chunks())
    by = np.argsort(place)
    orders = orders.sort_by([("trial", "ascending"), ("k", "ascending")])
    asked, trial = orders["place"].to_numpy(), orders["trial"].to_numpy()
    at = np.minimum(np.searchsorted(place[by], asked), len(place) - 1)
    here = np.flatnonzero(place[by][at] == asked)
    fresh = np.zeros(len(here), np.int64)
    edges = np.append(np.flatnonzero(np.diff(trial[here], prepend=-1)), len(here))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        upto = np.bitwise_count(np.bitwise_or.accumulate(bits[by[at[here[a:b]]]], axis=0)).sum(axis=1, dtype=np.int64)
        fresh[a:b] = np.diff(upto, prepend=0)
    rows = orders.take(here)
    return pa.table([rows["scene"], rows["trial"], rows["k"], pa.array(fresh)], schema=schema)


def trial_curve(orders: DataFrame, sets: DataFrame) -> DataFrame:
    """scene, trial, k and how many points the first k places of a trial's order reach together.

    Every bucket of a scene counts all trials for itself: its task holds the pool's bitmaps of that bucket, 4 KB a place.
    """
    runs = sets.select(F.col("scene").alias("scene"), F.col("bucket").alias("run")).distinct()
    each = sets.groupBy("scene", "bucket").cogroup(orders.join(runs, "scene").groupBy("scene", "run")).applyInArrow(_prefixes, "scene long, trial int, k int, fresh long")
    fresh = each.groupBy("scene", "trial", "k").agg(F.sum("fresh").alias("fresh"))
    steps = orders.select("scene", "trial", "k").join(fresh, ["scene", "trial", "k"], "left").fillna(0)
    return steps.select("scene", "trial", "k", F.sum("fresh").over(Window.partitionBy("scene", "trial").orderBy("k")).alias("score"))
