"""What of a scene counts and what is drawn: runs that can't start, groups and zones that draw, the volumes of zones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_blockers(scenes: DataFrame, geometry: DataFrame) -> DataFrame:
    """scene and ``blocker``: ``no_geometry`` where no object (scene, enabled) of the scene is enabled, null where a run can start."""
    some = geometry.where("enabled").select("scene").distinct().withColumn("_some", F.lit(True))
    return scenes.select("scene").distinct().join(some, "scene", "left").select("scene", F.when(F.col("_some").isNull(), F.lit("no_geometry")).alias("blocker"))


def drawable_groups(groups: DataFrame, placing: DataFrame) -> DataFrame:
    """scene and group_id of what draws: enabled groups (scene, group_id, enabled), and that which is being placed (scene, group_id), enabled or not."""
    return groups.where("enabled").select("scene", "group_id").unionByName(placing.select("scene", "group_id").where("group_id IS NOT NULL")).distinct()


def visible_zones(zones: DataFrame, groups: DataFrame, drawable: DataFrame) -> DataFrame:
    """scene and zone_id of zones whose volumes draw: enabled ones (scene, zone_id, enabled) and those that a drawable group (scene, group_id, zone_ids) aims at."""
    aimed = groups.join(drawable, ["scene", "group_id"], "left_semi").select("scene", F.explode("zone_ids").alias("zone_id"))
    return zones.where("enabled").select("scene", "zone_id").unionByName(aimed).distinct()


def volumes_of_zones(volumes: DataFrame, wanted: DataFrame) -> DataFrame:
    """The volumes (scene, zone_id, ...) of the wanted zones (scene, zone_id), every one once; none where none is wanted."""
    return volumes.join(wanted.select("scene", "zone_id"), ["scene", "zone_id"], "left_semi")
