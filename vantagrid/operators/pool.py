"""Positions that constraints allow: drawn in a fixed sequence for each constraint, so that a larger pool keeps what a smaller one had."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import add, ball_point_of, fnv1a, inverses, length, rotate, scale, sub
from .records import BALL_BASES

#: Draws start at one of so many places of the sequence, by the constraint's id and the group's seed.
STARTS = 1_000_003
MIX = 0x9E3779B1
#: A constraint may draw so many times its share to replace positions that reach nothing.
TRIES = 3

CONSTRAINT = "scene long, id string, kind string, position array<double>, points array<array<double>>, rotation array<double>, size array<double>, distance double, seed long"


def start_of(constraint_id: Column, seed: Column) -> Column:
    mixed = F.pmod(seed.cast("long") * F.lit(MIX), F.lit(1 << 32))
    return fnv1a(constraint_id).bitwiseXOR(mixed) % STARTS + 1


def _triple(a: Column) -> tuple[Column, Column, Column]:
    return a[0], a[1], a[2]


def _segments(points: Column) -> Column:
    """The stretches of a polyline: from, to and length."""
    ends = F.arrays_zip(F.slice(points, 1, F.size(points) - 1).alias("a"), F.slice(points, 2, F.size(points) - 1).alias("b"))
    return F.transform(ends, lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), length(sub(_triple(s["b"]), _triple(s["a"]))).alias("len")))


def measure() -> Column:
    """How much a constraint weighs when a pool is shared out: 1 for a point, else its length or area."""
    way = F.aggregate(_segments(F.col("points")), F.lit(0.0), lambda t, s: t + s["len"])
    return F.when(F.col("kind") == "point", F.lit(1.0)).when(F.col("kind") == "plane", F.get("size", 0) * F.get("size", 1)).otherwise(way)


def _on_polyline(u: Column) -> Column:
    """The place (an array) at the share ``u`` of a polyline's length."""
    segments = _segments(F.col("points"))
    none = F.struct(F.lit(None).cast("array<double>").alias("at"), (u * measure()).alias("left"))

    def walk(state: Column, s: Column) -> Column:
        here = F.when(s["len"] == 0, F.lit(0.0)).otherwise(F.least(F.greatest(state["left"] / s["len"], F.lit(0.0)), F.lit(1.0)))
        at = F.array(*add(_triple(s["a"]), scale(sub(_triple(s["b"]), _triple(s["a"])), here)))
        # Until a stretch holds the place, its far end stands in: rounding may leave a rest behind the last one.
        return F.struct(F.when(state["left"] < 0, state["at"]).otherwise(at).alias("at"), F.when(state["left"] <= s["len"], F.lit(-1.0)).otherwise(state["left"] - s["len"]).alias("left"))

    return F.aggregate(segments, none, walk)["at"]


def drawn(constraints: DataFrame, wanted: DataFrame) -> DataFrame:
    """Positions (scene, id, draw, x, y, z) of constraints (see ``CONSTRAINT``) for the draws ``first`` to ``last`` of each (scene, id, first, last).

    Draw k depends on the constraint and its group's seed alone. Constraints of unknown kind give null positions.
    """
    # The start is hashed once for a constraint: inside of the inverses it would be worked out again for each digit.
    rows = constraints.join(wanted.where("last >= first").hint("merge"), ["scene", "id"]).withColumn("_start", start_of(F.col("id"), F.col("seed")))
    rows = rows.withColumn("draw", F.explode(F.sequence("first", "last")))
    rows = rows.withColumn("_h", inverses(F.col("_start") + F.col("draw"), (2, 3, *BALL_BASES)))
    rows = rows.withColumns({"_u": F.get("_h", 0), "_v": F.get("_h", 1)})
    rows = rows.withColumn("_line", F.when(F.col("kind") == "polyline", _on_polyline(F.col("_u"))))
    turn = [F.get("rotation", i) for i in range(4)]
    flat = ((F.col("_u") - 0.5) * F.get("size", 0), F.lit(0.0), (F.col("_v") - 0.5) * F.get("size", 1))
    at = _triple_of("position")
    plane, line = add(at, rotate(turn, flat)), _triple_of("_line")
    base = [F.when(F.col("kind") == "point", p).when(F.col("kind") == "plane", q).when(F.col("kind") == "polyline", r) for p, q, r in zip(at, plane, line)]
    off = ball_point_of(*(F.get("_h", n) for n in range(2, 5)), 1.0)
    placed = add(tuple(base), tuple(F.when(F.col("distance") > 0, F.col("distance") * c).otherwise(F.lit(0.0)) for c in off))
    return rows.select("scene", "id", "draw", *(c.alias(n) for n, c in zip("xyz", placed)))


def _triple_of(name: str) -> tuple[Column, Column, Column]:
    return tuple(F.get(name, i) for i in range(3))


def kept(samples: DataFrame, shares: DataFrame) -> DataFrame:
    """The pool: of the draws (scene, id, draw, reach) of each constraint, the first ``share`` (scene, id, share) that reach anything.

    Only the first ``TRIES`` times share draws count, so a constraint that reaches little stays short.
    """
    rows = samples.join(shares, ["scene", "id"]).where((F.col("draw") < TRIES * F.col("share")) & (F.col("reach") > 0))
    nth = F.row_number().over(Window.partitionBy("scene", "id").orderBy("draw"))
    return rows.withColumn("_n", nth).where(F.col("_n") <= F.col("share")).select(*samples.columns)


def still_wanted(samples: DataFrame, shares: DataFrame) -> DataFrame:
    """What to draw next (scene, id, first, last) for shares that the draws so far don't fill; none once the tries are used up."""
    so_far = samples.groupBy("scene", "id").agg((F.max("draw") + 1).alias("next"), F.count_if(F.col("reach") > 0).alias("held"))
    rows = shares.join(so_far, ["scene", "id"], "left").select("scene", "id", "share", F.coalesce("next", F.lit(0)).alias("first"), F.coalesce("held", F.lit(0)).alias("held"))
    last = F.least(F.col("first") + F.col("share") - F.col("held"), TRIES * F.col("share")) - 1
    return rows.withColumn("last", last).where("held < share AND last >= first").select("scene", "id", "first", "last")
