"""Edits of scene records: a log folded into the records, copies and removals with what hangs on them, order among siblings.

Records carry ``scene``, ``id`` and ``pos``, their order within the scene.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .records import next_ids


def applied(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """The records after a log of edits (scene, seq, id, action, and the records' own columns).

    ``put`` adds a record or changes those of its fields that aren't null, ``delete`` removes it, and what comes later
    in ``seq`` wins. A record that is put after its removal starts anew, with no older field. ``pos`` is that of the
    first put that still counts, so added records follow; edits of unknown actions raise.
    """
    fields = [c for c in rows.columns if c not in ("scene", "id", "pos")]
    known = F.when(F.col("action").isin("put", "delete"), F.col("action")).otherwise(F.raise_error(F.concat(F.lit("unknown action "), F.coalesce("action", F.lit("null")))))
    old = rows.select("scene", "id", F.lit(-1).cast("long").alias("seq"), F.col("pos").cast("long").alias("pos"), F.lit("put").alias("action"), *fields)
    new = edits.select("scene", "id", F.col("seq").cast("long").alias("seq"), F.lit(None).cast("long").alias("pos"), known.alias("action"), *fields)
    log = old.unionByName(new)
    gone = log.withColumn("_gone", F.max(F.when(F.col("action") == "delete", F.col("seq"))).over(Window.partitionBy("scene", "id")))
    live = gone.where("_gone IS NULL OR seq > _gone")
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in fields]
    kept = live.groupBy("scene", "id").agg(F.min(F.struct("seq", "pos")).alias("_first"), *last)
    order = F.row_number().over(Window.partitionBy("scene").orderBy("_first.seq", "_first.pos", "id"))
    return kept.withColumn("pos", order.cast("long") - 1).select("scene", "id", "pos", *fields)


def duplicated(rows: DataFrame, chosen: DataFrame, prefix: str) -> DataFrame:
    """Copies of the chosen records (scene, id; one a scene) with the next free id of their scene, and the id they were ``copied`` from."""
    copies = rows.join(chosen.select("scene", "id").distinct(), ["scene", "id"]).join(next_ids(rows, prefix), "scene")
    return copies.withColumnsRenamed({"id": "copied", "next_id": "id"}).select(*rows.columns, "copied")


def duplicated_parts(parts: DataFrame, owners: DataFrame, owner: str, prefix: str) -> DataFrame:
    """Copies of the parts of duplicated owners, in their order, each with the next free id, under the new owner."""
    number = F.row_number().over(Window.partitionBy("scene").orderBy("pos"))
    rows = parts.join(owners.select("scene", F.col("copied").alias(owner), F.col("id").alias("_owner")), ["scene", owner])
    first = next_ids(parts, prefix).select("scene", F.regexp_extract("next_id", "([0-9]+)$", 1).cast("long").alias("_from"))
    rows = rows.join(first, "scene").withColumn("id", F.concat(F.lit(f"{prefix}-"), (F.col("_from") + number - 1).cast("string")))
    return rows.withColumn(owner, F.col("_owner")).select(*parts.columns)


def removed(rows: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    """The records but those that are gone (scene, id), or whose owner (``key``) is; null owners stay."""
    return rows.join(gone.select("scene", F.col("id").alias(key)).distinct(), ["scene", key], "left_anti").select(*rows.columns)


def moved(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """The records with new ``pos``: that of each scene's move (scene, id, before) goes ahead of ``before``, or to the end where it is null or unknown."""
    target = rows.select("scene", F.col("id").alias("before"), F.col("pos").alias("_at"))
    keys = moves.join(target, ["scene", "before"], "left").select("scene", "id", F.coalesce(F.col("_at") - 0.5, F.lit(float("inf"))).alias("_key"))
    order = F.row_number().over(Window.partitionBy("scene").orderBy(F.coalesce("_key", F.col("pos").cast("double")), "pos"))
    return rows.join(keys, ["scene", "id"], "left").withColumn("pos", order.cast("long") - 1).select(*rows.columns)
