"""Whole scene documents: read, checked in order, and taken over with all their records or refused with the first reason; and written again.

A document is one JSON text; ``Documents`` holds any number of them, each under its ``scene``.  Versions 1 to 4 are read: older ones have no zones, volumes,
constraint groups or constraints, their geometry gets ids by position and its kind ``gltf`` reads as ``mesh``.  The first thing wrong, by section, then by
position, refuses the document with all its records.  Values of the wrong type are never converted: a number as text is as bad as none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents as D
from ..operators import records as R
from .runs import Folder
from .tables import checkpointed

VERSION, VERSIONS = 4, (1, 2, 3, 4)
#: The fields of each section by kind: s text, n number, b yes or no, v numbers, p list of places, t list of texts; and the names that records give them.
FIELDS: dict[str, dict[str, str]] = {
    "geometry": {"id": "s", "name": "s", "enabled": "b", "kind": "s", "position": "v", "rotation": "v", "scale": "v", "halfX": "n", "halfZ": "n", "height": "n", "thickness": "n", "min": "v", "max": "v", "src": "s"},
    "cameras": {"id": "s", "name": "s", "enabled": "b", "aimLocked": "b", "position": "v", "rotation": "v", "fov": "n", "aspect": "n", "near": "n", "far": "n", "constraintId": "s"},
    "probes": {"id": "s", "name": "s", "position": "v"},
    "sections": {"id": "s", "name": "s", "orientation": "s", "min": "n", "max": "n", "aggregation": "s", "enabled": "b", "visible": "b", "clipRange": "n", "minA": "n", "maxA": "n", "minB": "n", "maxB": "n"},
    "zones": {"id": "s", "name": "s", "enabled": "b"},
    "volumes": {"id": "s", "zoneId": "s", "position": "v", "rotation": "v", "size": "v"},
    "constraintGroups": {"id": "s", "enabled": "b", "namePrefix": "s", "zoneIds": "t", "fov": "n", "far": "n", "poolSize": "n", "maxCount": "n", "trials": "n", "epsilon": "n", "seed": "n"},
    "constraints": {"id": "s", "name": "s", "enabled": "b", "groupId": "s", "kind": "s", "distance": "n", "position": "v", "points": "p", "rotation": "v", "size": "v"},
    "splats": {"id": "s", "name": "s", "src": "s", "enabled": "b", "position": "v", "rotation": "v", "scale": "n"},
}
_NEEDED = ("geometry", "cameras", "probes", "sections")
_RENAMED = {"geometry": {"min": "low", "max": "high"}}
#: In the order in which sections are checked; ``useZones`` stands between volumes and groups, bindings of cameras at the end.
_ORDER = {name: 10 * n for n, name in enumerate(FIELDS, 1)}
_USE_ZONES, _BINDINGS = _ORDER["volumes"] + 5, 1000
_TYPE = {"b": "boolean", "v": "array<double>", "p": "array<array<double>>", "t": "array<string>"}
_SAID = {"b": "BOOLEAN", "v": r"ARRAY<(BIGINT|DOUBLE|FLOAT|DECIMAL.*|VOID)>", "p": r"ARRAY<(ARRAY<(BIGINT|DOUBLE|FLOAT|DECIMAL.*|VOID)>|VOID)>", "t": "ARRAY<(STRING|VOID)>"}


def _snake(name: str) -> str:
    return "".join(f"_{c.lower()}" if c.isupper() else c for c in name)


def _said(item: Column, path: str) -> Column:
    """What kind of value stands there; null where the key is missing."""
    return F.schema_of_variant(F.try_variant_get(item, path, "variant"))


def _value(item: Column, name: str, kind: str) -> Column:
    """The field, null where it is missing; of the wrong kind, a number is NaN, anything else null."""
    path, said = f"$.{name}", _said(item, f"$.{name}")
    if kind == "s":
        return F.when(said == "STRING", F.try_variant_get(item, path, "string"))
    if kind == "n":
        return F.when(said.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(item, path, "double")).when(said.isNotNull(), F.lit(float("nan")))
    return F.when(said.rlike(f"^{_SAID[kind]}$"), F.try_variant_get(item, path, _TYPE[kind]))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path and document of all JSON files below ``path``; a file that isn't UTF-8 has what can be read of it.

    Spark's readers pass over empty files, so these are listed by name, with an empty text.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(path)
    empty = [(name, "") for name, size in Folder(spark, path).sizes().items() if not size and name.endswith(".json")]
    return files.select("path", F.col("content").cast("string").alias("document")).union(spark.createDataFrame(empty, "path string, document string"))


def check_probes(rows: DataFrame) -> DataFrame:
    """Probes (scene, pos, id, name, position) with ``problem``."""
    rows = rows.withColumn("problem", R._first_reason((F.col("id").isNotNull() & R._numbers(F.col("position"), 3), "requires id, position")))
    return R.unique_ids(rows, "probe")


class Documents:
    """Documents (scene, document) and their records.

    The texts, and what was found against them, are written to the shared folder once: every section is read from the one and held against the other.
    """

    def __init__(self, texts: DataFrame):
        self._problems: DataFrame | None = None
        self.rows = checkpointed(texts.select("scene", "document")).withColumn("root", F.try_parse_json(F.col("document")))
        zones, groups = self._items("zones"), self._items("constraintGroups")
        self.checked: dict[str, DataFrame] = {
            "geometry": D.check_geometry(self._items("geometry")), "cameras": R.check_cameras(self._items("cameras")), "probes": check_probes(self._items("probes")),
            "sections": R.check_sections(self._items("sections")), "zones": D.check_zones(zones), "volumes": D.check_volumes(self._items("volumes"), zones),
            "constraintGroups": R.check_groups(groups, zones.select("scene", F.col("id").alias("zone_id"))), "constraints": R.check_constraints(self._items("constraints"), groups), "splats": D.check_captures(self._items("splats")),
        }

    def _items(self, section: str) -> DataFrame:
        """One row for each record of a section; a value that isn't yes or no where one should be is named in ``wrong``."""
        rows = self.rows.select("scene", F.posexplode(F.when(_said(F.col("root"), f"$.{section}").startswith("ARRAY"), F.try_variant_get("root", f"$.{section}", "array<variant>"))).alias("pos", "item"))
        renamed = _RENAMED.get(section, {})
        held = {f: _value(F.col("item"), f, k) for f, k in FIELDS[section].items()}
        if "name" in held and section != "zones":  # a blank name of a zone gives way to its number
            held["name"] = F.trim(F.coalesce(held["name"], F.lit("")))
        fields = [c.alias(renamed.get(f, _snake(f))) for f, c in held.items()]
        flags = [F.when(~F.coalesce(_said(F.col("item"), f"$.{f}"), F.lit("BOOLEAN")).isin("BOOLEAN"), F.lit(f"{f} must be a boolean")) for f, k in FIELDS[section].items() if k == "b" and f != "visible"]
        texts = [F.when(~F.coalesce(_said(F.col("item"), f"$.{f}"), F.lit("STRING")).isin("STRING"), F.lit(f"{f} must be a string")) for f in ("constraintId", "namePrefix") if f in FIELDS[section]]
        return rows.select("scene", "pos", *fields, F.coalesce(*flags, *texts, F.lit(None).cast("string")).alias("wrong"))

    def _whole(self) -> DataFrame:
        """What is wrong with documents as such: scene, nth, pos, reason."""
        root, version = F.col("root"), _said(F.col("root"), "$.formatVersion")
        kind = F.schema_of_variant(root)
        number = F.when(version.rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(root, "$.formatVersion", "double"))
        unknown = F.concat(F.lit('unsupported scene.json formatVersion "'), F.coalesce(F.get_json_object("document", "$.formatVersion"), F.lit("undefined")), F.lit(f'" (expected {" or ".join(map(str, VERSIONS))})'))
        checks = [(0, ~F.coalesce(kind.startswith("OBJECT"), F.lit(False)), F.lit("scene.json must be a JSON object")), (1, ~F.coalesce(number.isin(*map(float, VERSIONS)), F.lit(False)), unknown)]
        for name, nth in _ORDER.items():
            said = _said(root, f"$.{name}")
            bad = ~said.startswith("ARRAY")
            checks.append((nth, F.coalesce(bad, F.lit(name in _NEEDED)), F.lit(f"{name} must be an array")))
        checks.append((_USE_ZONES, F.coalesce(_said(root, "$.useZones") != "BOOLEAN", F.lit(False)), F.lit("useZones must be a boolean")))
        first = F.array_compact(F.array(*(F.when(bad, F.struct(F.lit(nth).alias("nth"), F.lit(-1).alias("pos"), reason.alias("reason"))) for nth, bad, reason in checks)))
        return self.rows.select("scene", F.explode(first).alias("w")).select("scene", "w.*")

    def problems(self) -> DataFrame:
        """Every document's scene and the first reason against it, null for a good one."""
        if self._problems is None:
            self._problems = checkpointed(self._found())
        return self._problems

    def _found(self) -> DataFrame:
        found = self._whole()
        for name, rows in self.checked.items():
            reason = F.coalesce("problem", "wrong")
            placed = F.when(reason.startswith("duplicate"), reason).otherwise(F.concat(F.lit(f"{name}["), F.col("pos"), F.lit("]: "), reason))
            found = found.unionByName(rows.where(reason.isNotNull()).select("scene", F.lit(_ORDER[name]).alias("nth"), "pos", placed.alias("reason")))
        bound = self.checked["cameras"].where("constraint_id IS NOT NULL")
        known = self.checked["constraints"].select("scene", F.col("id").alias("constraint_id"))
        lost = bound.join(known, ["scene", "constraint_id"], "left_anti")
        said = F.concat(F.lit('camera "'), F.col("id"), F.lit('": constraintId "'), F.col("constraint_id"), F.lit('" references no constraint'))
        found = found.unionByName(lost.select("scene", F.lit(_BINDINGS).alias("nth"), "pos", said.alias("reason")))
        first = found.groupBy("scene").agg(F.min_by("reason", F.struct("nth", "pos")).alias("problem"))
        return self.rows.select("scene").join(first, "scene", "left")

    def good(self) -> DataFrame:
        """scene, use_zones and clip_section_id of the documents that are taken over; a clip that names no section is none."""
        fine = self.problems().where("problem IS NULL").select("scene")
        rows = self.rows.join(fine, "scene", "left_semi").select("scene", F.coalesce(F.try_variant_get("root", "$.useZones", "boolean"), F.lit(False)).alias("use_zones"), _value(F.col("root"), "clipSectionId", "s").alias("clip"))
        named = self.checked["sections"].select("scene", F.col("id").alias("clip"), F.col("id").alias("clip_section_id")).distinct()
        return rows.join(named, ["scene", "clip"], "left").select("scene", "use_zones", "clip_section_id")

    def records(self, section: str) -> DataFrame:
        """The records of a section, with defaults, of all documents that are taken over."""
        return self.checked[section].join(self.problems().where("problem IS NULL").select("scene"), "scene", "left_semi").drop("problem", "wrong")


def written(scenes: DataFrame, records: Callable[[str], DataFrame]) -> DataFrame:
    """scene and document of ``scenes`` (scene, use_zones, clip_section_id) as JSON of the present version; blank names, true flags and absent values are left out."""
    out = scenes
    for section, fields in FIELDS.items():
        renamed, rows = _RENAMED.get(section, {}), records(section)
        held = []
        for f, kind in fields.items():
            name = renamed.get(f, _snake(f))
            if name not in rows.columns:
                continue
            c = F.col(name)
            if f in ("name", "namePrefix"):
                c = F.when(F.trim(c) != "", F.trim(c))
            elif f == "enabled" and section != "sections":
                c = F.when(~c, c)
            elif f == "aimLocked":
                c = F.when(c, c)
            elif kind == "n":
                c = F.when(~F.isnan(c), c)
            held.append(c.alias(f))
        each = rows.groupBy("scene").agg(F.sort_array(F.collect_list(F.struct("pos", F.struct(*held).alias("r")))).alias("all"))
        out = out.join(each.select("scene", F.transform("all", lambda x: x["r"]).alias(section)), "scene", "left")
        out = out.withColumn(section, F.coalesce(section, F.array().cast(dict(out.dtypes)[section])))
    body = F.struct(F.lit(VERSION).alias("formatVersion"), *FIELDS, F.col("use_zones").alias("useZones"), F.col("clip_section_id").alias("clipSectionId"))
    return out.select("scene", F.to_json(body, {"ignoreNullFields": "true"}).alias("document"))
