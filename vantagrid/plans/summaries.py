"""Queries on merged parts and on what readouts show, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import summaries
from ..sources import scene
from ..sources.tables import checkpointed
from . import oracle as O
from .queries import _ONCE, _W, ORACLE_SQL, Room, _query, _rate


@_query("a13_merged_regions", ORACLE_SQL["a5_regions"])
def a13(s, d):
    """Regions over chunks of even and of odd number, merged."""
    r = Room(s, d)
    masked, regions = r.kept_masked(), r.of(scene.regions)
    return summaries.merge_regions(*(A.region_stats(r.space, masked.where(F.col("chunk_id") % 2 == half), regions) for half in (0, 1)))


@_query("a15_merged_projections", ORACLE_SQL["a10_projection"])
def a15(s, d):
    """Image histograms over chunks of even and of odd number, merged."""
    r = Room(s, d)
    seen, cameras = checkpointed(r.traced()), r.of(scene.cameras)
    masked = r.kept_masked(seen)
    return summaries.merge_projections(*(A.image_histogram(masked.where(F.col("chunk_id") % 2 == half), seen, cameras, 8, _W) for half in (0, 1)))


def _zones(r: Room):
    volumes = r.of(scene.regions).withColumnRenamed("group_id", "zone_id")
    return volumes, volumes.select("scene", "zone_id", (F.col("zone_id") % 2 == 0).alias("enabled")).distinct()


_PER_ZONE = {"sizes": "SELECT group_id, count(*) AS valid FROM once GROUP BY group_id", "looks": "SELECT group_id, cam_idx, count(*) AS n FROM once JOIN seen ON seen.point = once.point GROUP BY group_id, cam_idx"}


@_query("a17_zone_cameras", O.sql("SELECT z.group_id AS zone_id, c.cam_idx, round(coalesce(n::DOUBLE / nullif(valid, 0), 0), 9) AS rate FROM (SELECT DISTINCT scene, group_id FROM regions) AS z JOIN cams AS c ON c.scene = z.scene AND enabled LEFT JOIN sizes ON sizes.group_id = z.group_id LEFT JOIN looks ON looks.group_id = z.group_id AND looks.cam_idx = c.cam_idx", "held", more=_ONCE | _PER_ZONE))
def a17_cameras(s, d):
    r = Room(s, d)
    valid = r.valid_of(r.region_voxels())
    return summaries.zone_cameras(r.space, valid, r.seen(valid), _zones(r)[0], r.of(scene.cameras)).select("zone_id", "cam_idx", _rate())


_SHOWN = {
    "marked": "SELECT DISTINCT scene, point, cameras FROM held WHERE group_id % 2 = 0",
    "counted": "SELECT scene, point, cameras FROM marked WHERE scene % 2 = 0 UNION ALL SELECT scene, point, cameras FROM masked WHERE scene % 2 = 1",
    "totals": "SELECT scene, count(*) AS valid_voxels, count(*) FILTER (cameras > 0)::DOUBLE / count(*) AS overall_rate FROM counted GROUP BY scene",
    "sights": "SELECT counted.scene, cam_idx, count(*) AS n FROM counted JOIN seen ON seen.point = counted.point GROUP BY counted.scene, cam_idx",
}


@_query("a18_displayed", O.sql("SELECT c.scene, c.cam_idx, valid_voxels, round(overall_rate, 9) AS overall_rate, round(coalesce(n, 0)::DOUBLE / valid_voxels, 9) AS rate FROM cams AS c JOIN totals ON totals.scene = c.scene LEFT JOIN sights ON sights.scene = c.scene AND sights.cam_idx = c.cam_idx WHERE enabled", "held", more=_SHOWN))
def a18(s, d):
    """Rooms of even number show their enabled zones, the others the whole room."""
    r = Room(s, d)
    valid, masked, cameras = r.kept_valid(), r.kept_masked(), r.of(scene.cameras)
    seen = checkpointed(r.seen(valid))
    sums = masked.groupBy("scene").agg(F.count("*").alias("valid_voxels"), (F.count_if(F.col("cameras") > 0) / F.count("*")).alias("overall_rate"))
    each = A.per_camera(cameras, seen, valid).select("scene", "cam_idx", "rate")
    union = summaries.enabled_union(r.space, masked, seen, *_zones(r), cameras)
    return summaries.displayed((sums, each), union, cameras.where("scene % 2 = 0"), cameras).select("scene", "cam_idx", "valid_voxels", _rate("overall_rate"), _rate())
