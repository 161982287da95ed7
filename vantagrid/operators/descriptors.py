"""Descriptors of what a run shall count: held to their caps and shapes before anything is computed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregates import CAPS
from .records import _numbers, finite

#: The largest image of a projection, its most weight tables, bits of a camera word, and the codes of both failures.
MOST_BINS, MOST_TABLES, WORD = 128, 4, 32
TOO_LARGE, INVALID = "AGGREGATE_TOO_LARGE", "INVALID_AGGREGATE"

#: One row is the descriptor of one scene's run.  All lists may be null; ``num_cameras`` null leaves out what depends on the run.
SCHEMA = (
    "scene long, num_cameras int, regions array<struct<centre: array<double>, half: array<double>, rotation: array<double>, groups: array<double>>>,"
    " slabs array<struct<axis: double, range: array<array<double>>, mask: array<double>>>, leaf_mask array<double>, probes array<array<double>>,"
    " projections array<struct<bins: double, matrix: array<double>, camera: double, mask: array<double>, weights: array<array<double>>>>, camera_words array<long>"
)


def _whole(x: Column) -> Column:
    return finite(x) & (x == F.floor(x))


def _index(x: Column, end: Column | int) -> Column:
    return _whole(x) & (x >= 0) & (x < end)


def _all(list_: Column, ok) -> Column:
    """Whether all of a list hold; of none, they do."""
    return F.coalesce(F.forall(list_, ok), F.lit(True))


def _pair(r: Column) -> Column:
    return _numbers(r, 2) & F.forall(r, _whole)


def _first(checks: list[tuple[Column, str]]) -> Column:
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(reason)) for ok, reason in checks))


def _each(list_: str, name: str, checks) -> Column:
    """The reason of the first element that fails, with its place."""
    reasons = F.transform(list_, lambda x, n: F.struct(n.alias("n"), _first(checks(x)).alias("why")))
    bad = F.get(F.filter(reasons, lambda r: r["why"].isNotNull()), F.lit(0))
    return F.when(bad.isNotNull(), F.concat(F.lit(f"{name}["), bad["n"].cast("string"), F.lit("] "), bad["why"]))


def _capped(list_: str) -> Column:
    return F.when(F.size(list_) > CAPS[list_], F.concat(F.lit(f"{list_}: "), F.size(list_).cast("string"), F.lit(f" of at most {CAPS[list_]}")))


def check_descriptors(rows: DataFrame) -> DataFrame:
    """Adds ``code`` and ``problem``, of the first thing that is wrong: regions, slabs, the mask of cubes, probes, projections, camera words, in this order; null where nothing is.

    A cap goes before the elements of its list, elements by their place, and of an element the checks as they stand below.
    """
    n, regions = F.col("num_cameras"), F.coalesce(F.size("regions"), F.lit(0))
    known = n.isNotNull()
    masked = lambda m: _all(m, lambda x: _index(x, F.greatest(regions, F.lit(0))))
    region = lambda r: [
        (_numbers(r["centre"], 3), "centre must be three numbers"),
        (_numbers(r["half"], 3), "half must be three numbers"),
        (_numbers(r["rotation"], 4), "rotation must be four numbers"),
        (F.forall(r["half"], lambda h: h > 0), "half must be positive"),
        (_all(r["groups"], lambda g: _index(g, CAPS["groups"])), f"groups must lie in 0 to {CAPS['groups'] - 1}"),
    ]
    slab = lambda s: [
        (s["axis"].isin(0.0, 1.0, 2.0), "axis must be 0, 1 or 2"),
        (F.size(s["range"]) == 3, "range must cover three axes"),
        (F.forall(s["range"], _pair), "range must hold pairs of integers"),
        (F.forall(s["range"], lambda r: F.get(r, F.lit(1)) >= F.get(r, F.lit(0))), "range is empty"),
        (masked(s["mask"]), "mask names no region"),
    ]
    tables = lambda p: F.coalesce(F.size(p["weights"]), F.lit(0))
    width = lambda p: F.size(F.get(p["weights"], F.lit(0)))
    projection = lambda p: [
        (_index(p["bins"] - 1, MOST_BINS), f"bins must lie in 1 to {MOST_BINS}"),
        (_numbers(p["matrix"], 16), "matrix must be sixteen numbers"),
        (_whole(p["camera"]) & (p["camera"] >= 0), "camera must be 0 or more"),
        (masked(p["mask"]), "mask names no region"),
        ((tables(p) >= 1) & (tables(p) <= MOST_TABLES), f"weights must hold 1 to {MOST_TABLES} tables"),
        (F.forall(p["weights"], lambda t: F.size(t) == width(p)), "weights must be of one length"),
        (~known | (p["camera"] < n), "camera isn't in the run"),
        (~known | (width(p) == n + 1), "weights need an entry more than there are cameras"),
    ]
    words = F.greatest(F.lit(1), F.ceil(n / WORD))
    large = {c: _capped(c) for c in ("regions", "slabs", "probes", "projections")}
    steps = [
        (TOO_LARGE, large["regions"]), (INVALID, _each("regions", "regions", region)),
        (TOO_LARGE, large["slabs"]), (INVALID, _each("slabs", "slabs", slab)),
        (INVALID, F.when(~masked(F.col("leaf_mask")), F.lit("leaf_mask names no region"))),
        (TOO_LARGE, large["probes"]), (INVALID, _each("probes", "probes", lambda p: [(_numbers(p, 3), "must be three numbers")])),
        (TOO_LARGE, large["projections"]), (INVALID, _each("projections", "projections", projection)),
        (INVALID, F.when(known & F.col("camera_words").isNotNull() & (F.size("camera_words") != words), F.concat(F.lit("camera_words must hold "), words.cast("string")))),
    ]
    found = F.coalesce(*(F.when(why.isNotNull(), F.struct(F.lit(code).alias("code"), why.alias("problem"))) for code, why in steps))
    return rows.withColumn("_found", found).withColumns({"code": F.col("_found.code"), "problem": F.col("_found.problem")}).drop("_found")


def accepted(rows: DataFrame) -> DataFrame:
    """The descriptors as they are; the first that is wrong fails the job with its code and reason."""
    told = check_descriptors(rows)
    fine = F.when(F.col("code").isNull(), F.lit(True)).otherwise(F.raise_error(F.concat_ws(": ", "code", "problem")).cast("boolean"))
    return told.where(fine).drop("code", "problem")


def asks_nothing(rows: DataFrame) -> DataFrame:
    """Adds ``empty``: nothing is to be counted."""
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    return rows.withColumn("empty", none("regions") & none("slabs") & none("probes") & none("projections") & F.col("leaf_mask").isNull())
