"""The life of a pool of positions: built, extended, truncated and rebuilt, with what each position reaches.

Draw k of a constraint doesn't depend on the pool's size, so what was drawn and reached stays good while the pool's fingerprint and seed do: a larger
pool adds draws, a smaller one only counts fewer.  All draws that are wanted at once go through one visibility job; those that
reach nothing are replaced by further draws, in rounds, until every share is filled or its tries are used up.

A pool is kept in the shared folder: ``samples`` (scene, id, draw, x, y, z, reach) and the ``sets`` (scene, id, draw, bucket, bits) of those that reach anything,
one part for each round, and a pointer that names the parts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.runs import RunStore
from . import pool, reachsets
from .rounds import reach

SAMPLES = "scene long, id string, draw long, x double, y double, z double, reach long"
SETS = "scene long, id string, draw long, bucket long, bits binary"


def build_action(about: dict | None, fingerprint: str, size: int, seed: int) -> str:
    """What a build would do to the pool there is: ``build``, ``extend``, ``truncate`` or ``rebuild``."""
    if not about:
        return "build"
    if about["fingerprint"] != fingerprint or about["seed"] != seed or about["size"] == size:
        return "rebuild"
    return "extend" if size > about["size"] else "truncate"


def reach_of(points: DataFrame, triangles: DataFrame, near: float, far: float) -> Callable[[DataFrame], DataFrame]:
    """The sets (scene, id, draw, bucket, bits) of draws (scene, id, draw, x, y, z) through real visibility, all around."""

    def sets(draws: DataFrame) -> DataFrame:
        nth = (F.row_number().over(Window.partitionBy("scene").orderBy("id", "draw")) - 1).cast("int")
        mounts = draws.where("x IS NOT NULL").withColumn("cam_idx", nth)
        at = mounts.select("scene", "cam_idx", *(F.col(a).alias(f"p{a}") for a in "xyz"), F.lit(near).alias("near"), F.lit(far).alias("far"))
        most = (mounts.agg(F.max("cam_idx")).first()[0] or 0) + 1
        found = reachsets.reach_sets(reach(points, at, triangles, most).withColumnRenamed("cam_idx", "place"))
        return mounts.select("scene", "id", "draw", F.col("cam_idx").alias("place")).join(found, ["scene", "place"]).select("scene", "id", "draw", "bucket", "bits")

    return sets


class Pool:
    """One pool by name."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.store = spark, RunStore(spark, f"pool-{name}")

    @property
    def about(self) -> dict | None:
        return self.store.about

    def _table(self, what: str, schema: str) -> DataFrame:
        parts = (self.about or {}).get("parts", [])
        out = self.spark.createDataFrame([], schema)
        for part in parts:
            out = out.unionByName(self.spark.read.schema(schema).parquet(f"{self.store.folder.path}/{part}/{what}"))
        return out

    def samples(self) -> DataFrame:
        """All draws so far, those that reach nothing too."""
        return self._table("samples", SAMPLES)

    def positions(self, shares: DataFrame) -> DataFrame:
        """The pool under ``shares`` (scene, id, share): the first draws of each constraint that reach anything."""
        return pool.kept(self.samples(), shares)

    def sets(self, shares: DataFrame) -> DataFrame:
        """The sets of the pool's positions, with ``place``, the position's number in its scene."""
        nth = (F.row_number().over(Window.partitionBy("scene").orderBy("id", "draw")) - 1).cast("int")
        places = self.positions(shares).select("scene", "id", "draw", "x", "y", "z").withColumn("place", nth)
        return places.join(self._table("sets", SETS), ["scene", "id", "draw"])

    def ceiling(self, shares: DataFrame) -> DataFrame:
        """scene and how many points any layout from the pool can cover at most: what all its positions reach together."""
        return reachsets.union_count(self.sets(shares))

    def summary(self, shares: DataFrame) -> DataFrame:
        """For each constraint its share, the draws made within its tries, those kept and those rejected."""
        tried = self.samples().join(shares, ["scene", "id"]).where(F.col("draw") < pool.TRIES * F.col("share"))
        counts = tried.groupBy("scene", "id").agg(F.count("*").alias("drawn"), F.count_if(F.col("reach") == 0).alias("rejected"))
        held = self.positions(shares).groupBy("scene", "id").agg(F.count("*").alias("held"))
        return shares.join(counts, ["scene", "id"], "left").join(held, ["scene", "id"], "left").fillna(0).select("scene", "id", "share", "drawn", "held", "rejected")

    def build(self, constraints: DataFrame, shares: DataFrame, size: int, seed: int, fingerprint: str, sets_of: Callable[[DataFrame], DataFrame]) -> str:
        """Bring the pool to ``shares`` of ``size`` in all, and say what that took; ``constraints`` (see ``pool.CONSTRAINT``) are drawn from under ``seed``."""
        action = build_action(self.about, fingerprint, size, seed)
        parts = [] if action in ("build", "rebuild") else list(self.about["parts"])
        about = {"fingerprint": fingerprint, "seed": seed, "size": size, "parts": parts}
        samples = self.spark.createDataFrame([], SAMPLES) if not parts else self.samples()
        while action != "truncate":
            wanted = pool.still_wanted(samples, shares)
            if wanted.isEmpty():
                break
            parts.append(self._draw(constraints.withColumn("seed", F.lit(seed).cast("long")), wanted, sets_of))
            samples = samples.unionByName(self.spark.read.schema(SAMPLES).parquet(f"{self.store.folder.path}/{parts[-1]}/samples"))
        self._point(about)
        return action

    def _draw(self, constraints: DataFrame, wanted: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> str:
        part, at = f"parts/{uuid.uuid4().hex}", self.store.folder.path
        pool.drawn(constraints, wanted).selectExpr("scene", "id", "CAST(draw AS BIGINT) AS draw", "x", "y", "z").write.parquet(f"{at}/{part}/draws")
        draws = self.spark.read.parquet(f"{at}/{part}/draws")
        sets_of(draws).selectExpr("scene", "id", "draw", "bucket", "bits").write.parquet(f"{at}/{part}/sets")
        sizes = self.spark.read.schema(SETS).parquet(f"{at}/{part}/sets").groupBy("scene", "id", "draw").agg(F.sum(F.bitmap_count("bits")).alias("reach"))
        draws.join(sizes, ["scene", "id", "draw"], "left").fillna(0, ["reach"]).select("scene", "id", "draw", "x", "y", "z", "reach").write.parquet(f"{at}/{part}/samples")
        return part

    def _point(self, about: dict) -> None:
        number, now = self.store._pointer()
        if not self.store._point(number + 1, now | {"about": about, "parts": about["parts"]}):
            raise RuntimeError("the pool was changed meanwhile")

    def forget(self) -> None:
        """Delete the pool and all its parts."""
        self.store.folder.delete()
