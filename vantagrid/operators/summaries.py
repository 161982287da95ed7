"""Statistics as they are shown: parts merged, zones with their cameras, the union of enabled zones, and which summary stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregates import in_regions


def _together(parts: tuple[DataFrame, ...]) -> DataFrame:
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every


def merge_counts(*parts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Region, group or camera counts of disjoint sets of points as those of all together; what only one part knows stays."""
    every = _together(parts)
    return every.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in every.columns if c not in keys))


def merge_regions(*parts: DataFrame) -> DataFrame:
    return merge_counts(*parts, keys=("region",))


def merge_projections(*parts: DataFrame) -> DataFrame:
    return merge_counts(*parts, keys=("scene", "cam_idx", "bin_x", "bin_y"))


def _rate(n: Column, of: Column) -> Column:
    return F.coalesce(F.try_divide(n.cast("double"), of), F.lit(0.0))


def _by_camera(held: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """How many of the points held under ``key`` each camera sees."""
    return held.select(key, "point").join(seen.select("point", "cam_idx").hint("merge"), "point").groupBy(key, "cam_idx").agg(F.count("*").alias("n"))


def zone_cameras(space, points: DataFrame, seen: DataFrame, volumes: DataFrame, cameras: DataFrame) -> DataFrame:
    """zone_id, cam_idx and the share of the zone's points that the camera sees, for every enabled camera of the zone's scene; 0 in an empty zone.

    ``volumes`` (see ``in_regions``) have ``zone_id``; a point counts once in a zone, however many of its volumes hold it.
    """
    once = in_regions(space, points, volumes).dropDuplicates(["point", "zone_id"])
    sizes = once.groupBy("zone_id").agg(F.count("*").alias("valid"))
    every = volumes.select("scene", "zone_id").distinct().join(cameras.where("enabled").select("scene", "cam_idx"), "scene")
    rows = every.join(sizes, "zone_id", "left").join(_by_camera(once, seen, "zone_id"), ["zone_id", "cam_idx"], "left").fillna(0, ["n"])
    return rows.select("zone_id", "cam_idx", _rate(F.col("n"), F.col("valid")).alias("rate"))


def enabled_union(space, masked: DataFrame, seen: DataFrame, volumes: DataFrame, zones: DataFrame, cameras: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of what the enabled zones (scene, zone_id, enabled) of a scene hold together: (scene, valid_voxels, overall_rate, blind), and (scene, cam_idx, rate) of enabled cameras.

    Points in several zones count once.  A scene whose enabled zones hold nothing has zeros.
    """
    on = zones.where("enabled").select("scene", "zone_id")
    once = in_regions(space, masked, volumes.join(on, ["scene", "zone_id"], "left_semi")).dropDuplicates(["point"])
    sums = once.groupBy("scene").agg(F.count("*").alias("valid_voxels"), F.count_if(F.col("cameras") > 0).alias("covered"), F.count_if(F.col("cameras") == 0).alias("blind"))
    whole = on.select("scene").distinct().join(sums, "scene", "left").fillna(0)
    each = whole.join(cameras.where("enabled").select("scene", "cam_idx"), "scene").join(_by_camera(once, seen, "scene"), ["scene", "cam_idx"], "left").fillna(0, ["n"])
    return whole.select("scene", "valid_voxels", _rate(F.col("covered"), F.col("valid_voxels")).alias("overall_rate"), "blind"), each.select("scene", "cam_idx", _rate(F.col("n"), F.col("valid_voxels")).alias("rate"))


def displayed(whole: tuple[DataFrame, DataFrame], union: tuple[DataFrame, DataFrame], active: DataFrame, cameras: DataFrame) -> DataFrame:
    """scene, cam_idx, valid_voxels, overall_rate and rate as all readouts show them.

    Scenes whose sampling is ``active`` (scene) show the union of their enabled zones, if they have any, others the whole volume; cameras that are switched off
    aren't listed.  Where nothing is marked, no rate means anything: ``rate`` is null.
    """
    shown = union[0].join(active.select("scene").distinct(), "scene", "left_semi").select("scene", "valid_voxels", "overall_rate", F.lit(True).alias("by_zones"))
    plain = whole[0].join(shown.select("scene"), "scene", "left_anti").select("scene", "valid_voxels", "overall_rate", F.lit(False).alias("by_zones"))
    rates = union[1].withColumn("by_zones", F.lit(True)).unionByName(whole[1].withColumn("by_zones", F.lit(False)).select("scene", "cam_idx", "rate", "by_zones"))
    rows = shown.unionByName(plain).join(rates, ["scene", "by_zones"]).join(cameras.where("enabled").select("scene", "cam_idx"), ["scene", "cam_idx"], "left_semi")
    return rows.select("scene", "cam_idx", "valid_voxels", "overall_rate", F.when(F.col("valid_voxels") > 0, F.col("rate")).alias("rate"))
