"""Document fingerprints as threshold-scaled sketches (operator 3).

DataFrame functions only.  A text's shingles (five words, or the whole sequence where there are fewer)
are hashed to 64 bits, and every hash below a fixed fraction (1 / ``SCALE``) of the range is
retained, whatever the length of the text.  Where that leaves fewer than ``FLOOR``, the ``FLOOR`` smallest
are retained, so that short texts have a sketch too; a text with fewer shingles is retained whole.
Each sketch is complete below its own *reach*.  Two sketches are compared below the smaller of
their reaches, where both are samples of the same hash function:
Jaccard similarity for likeness, and containment of one in the other, which stays meaningful between very unequal
documents.  The sketch of a union is the union of sketches cut in the same way, so they can be merged.

The *next* document (descending doc_id, after the last the first) is found without a global order:
documents are dealt into ranges between quantiles of doc_id, each range also gets a copy of the first row of the
following one, and a window within the range looks one row ahead.  A doc_id that fills several quantiles, and a null
one, is cut into ranges by a hash of the text.  The number of ranges is
bounded, so only that many bounds and range heads reach the driver.

Null text counts as empty; empty texts have the empty fingerprint.  Two empty
sketches have likeness 1, an empty one and another 0.  Rows with a null doc_id come last;
equal doc_ids follow each other by a hash of the text.  Repeated rows are kept.  Extra
columns are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, whole_text
from .words import SHINGLE_WORDS

SCALE = 8
FLOOR = 16
ROWS_PER_RANGE = 1000
MOST_RANGES = 1 << 16
_LOWEST, _HIGHEST = -(1 << 63), (1 << 63) - 1
_BELOW = _LOWEST + (1 << 64) // SCALE


def add_sketch(rows: DataFrame, text: str, name: str, k: int = SHINGLE_WORDS) -> DataFrame:
    """Add ``name``, the sorted retained hashes of the column ``text``."""
    words = F.filter(F.split(F.col(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    rows = rows.withColumn("_h", F.transform(words, lambda w: F.xxhash64(w)))
    places = F.sequence(F.lit(0), F.size("_h") - k)
    runs = F.transform(places, lambda i: F.xxhash64(*(F.get(F.col("_h"), i + j) for j in range(k))))
    every = F.when(F.size("_h") >= k, runs).when(F.size("_h") > 0, F.array(F.xxhash64("_h"))).otherwise(F.array().cast("array<long>"))
    rows = rows.withColumn("_s", every)
    rows = rows.withColumn("_low", F.sort_array(F.array_distinct(F.filter("_s", lambda x: x < _BELOW))))
    fewest = F.slice(F.sort_array(F.array_distinct("_s")), 1, FLOOR)
    return rows.withColumn(name, F.when(F.size("_low") >= FLOOR, F.col("_low")).otherwise(fewest)).drop("_h", "_s", "_low")


def reach(sketch: Column) -> Column:
    """Up to this hash the sketch holds every shingle of its text."""
    return F.when(F.size(sketch) < FLOOR, F.lit(_HIGHEST)).otherwise(F.greatest(F.lit(_BELOW - 1), F.element_at(sketch, -1)))


def _compared(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Add ``_both``, ``_a`` and ``_b``: sizes of the common part and of each sketch below the common reach."""
    rows = rows.withColumn("_t", F.least(reach(F.col(a)), reach(F.col(b))))
    below = lambda c: F.size(F.filter(c, lambda x: x <= F.col("_t"))).cast("double")
    both = F.size(F.filter(F.array_intersect(a, b), lambda x: x <= F.col("_t"))).cast("double")
    return rows.withColumn("_both", both).withColumn("_a", below(F.col(a))).withColumn("_b", below(F.col(b))).drop("_t")


def add_likeness(rows: DataFrame, a: str, b: str, name: str, containment: str | None = None) -> DataFrame:
    """Add the estimated Jaccard similarity, and that share of ``a`` which ``b`` contains."""
    rows = _compared(rows, a, b)
    either = F.col("_a") + F.col("_b") - F.col("_both")
    rows = rows.withColumn(name, F.when(either == 0, F.lit(1.0)).otherwise(F.col("_both") / F.greatest(either, F.lit(1.0))))
    if containment:
        rows = rows.withColumn(containment, F.when(F.col("_a") == 0, F.lit(1.0)).otherwise(F.col("_both") / F.greatest(F.col("_a"), F.lit(1.0))))
    return rows.drop("_both", "_a", "_b")


def merge(a: Column, b: Column) -> Column:
    """The sketch of two texts together, from their sketches."""
    every = F.sort_array(F.array_union(a, b))
    low = F.filter(every, lambda x: x < _BELOW)
    return F.when(F.size(low) >= FLOOR, low).otherwise(F.slice(every, 1, FLOOR))


def as_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.lower(F.hex(x))), " ")


def _ranged(rows: DataFrame) -> DataFrame:
    """Add ``_hash`` of the text and ``_range``: larger ranges come first, as larger doc_ids do."""
    n, some = rows.agg(F.count("*"), F.count("doc_id")).first()
    ranges = min(MOST_RANGES, -(-n // ROWS_PER_RANGE)) or 1
    bounds: list[int] = []
    if some and ranges > 1:
        quantiles = F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10 * ranges)
        bounds = list(rows.agg(quantiles).first()[0])  # fewer than ``ranges``
    often = {v: c + 1 for v, c in Counter(bounds).items() if c > 1}
    bounds = sorted(set(bounds))
    width = max(1, math.isqrt(len(bounds)))
    parts = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    below = lambda of, last: F.size(F.filter(of, lambda x: x <= F.col("doc_id") if last else x < F.col("doc_id")))
    first = F.from_json(F.lit(json.dumps([p[0] for p in parts])), "array<bigint>")
    fine = F.from_json(F.lit(json.dumps(parts)), "array<array<bigint>>")
    part = F.greatest(below(first, True) - 1, F.lit(0))
    cell = (part * width + F.coalesce(below(F.get(fine, part), False), F.lit(0))).cast("long")
    pieces = F.coalesce(F.try_element_at(F.from_json(F.lit(json.dumps({str(v): c for v, c in often.items()})), "map<string,int>"), F.col("doc_id").cast("string")), F.lit(0)) if often else F.lit(0)
    nulls = -(-(n - some) // ROWS_PER_RANGE)
    share = lambda count: F.floor(F.shiftrightunsigned("_hash", 32) * count / (1 << 32)).cast("long")
    known = F.when(pieces > 0, (2 * cell + 1) * MOST_RANGES + MOST_RANGES - 1 - share(pieces)).otherwise(2 * cell * MOST_RANGES)
    # Hashes count as unsigned in the order too, so that ranges and order agree.
    rows = rows.withColumn("_hash", F.xxhash64("text"))
    return rows.withColumn("_range", F.when(F.col("doc_id").isNull(), -1 - share(F.lit(min(MOST_RANGES, max(1, nulls))))).otherwise(known))


def with_next(rows: DataFrame, *columns: str) -> DataFrame:
    """Add ``next_<column>``: that of the next row by descending doc_id, after the last that of the first."""
    ranged = _ranged(rows)
    rank = F.col("_hash").bitwiseXOR(F.lit(_LOWEST))  # rises as the unsigned hash does
    head = F.max(F.struct("doc_id", F.bitwise_not(rank).alias("rank")))
    heads = [(r["_range"], *r["head"]) for r in ranged.groupBy("_range").agg(head.alias("head")).orderBy(F.desc("_range")).collect()]  # bounded by the ranges
    ghosts = [(mine, doc_id, at, heads[i - 1][0]) for i, (mine, doc_id, at) in enumerate(heads)]
    to = rows.sparkSession.createDataFrame(ghosts, "_range long, _head long, _head_rank long, _ghost long")
    joined = ranged.join(F.broadcast(to), "_range").withColumn("_rank", rank)
    own, copy = F.struct(F.col("_range"), F.lit(False).alias("ghost")), F.struct(F.col("_ghost").alias("_range"), F.lit(True).alias("ghost"))
    is_head = F.col("doc_id").eqNullSafe(F.col("_head")) & (F.bitwise_not("_rank") == F.col("_head_rank"))
    dealt = joined.withColumn("_to", F.explode(F.when(is_head, F.array(own, copy)).otherwise(F.array(own))))
    dealt = dealt.withColumn("_range", F.col("_to._range")).withColumn("_copy", F.col("_to.ghost")).drop("_to", "_head", "_head_rank", "_ghost", "_hash")
    order = Window.partitionBy("_range").orderBy("_copy", F.desc_nulls_last("doc_id"), "_rank", "text")
    return dealt.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns)).where(~F.col("_copy")).drop("_copy", "_range", "_rank")


def fingerprints(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    rows = with_next(add_sketch(rows, "text", "sketch"), "text", "sketch")
    cut = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    rows = rows.withColumn("edited", edited).withColumn("n_chars", F.length("text").cast("long")).withColumn("edited_sha256", F.sha2("edited", 256)).drop("text", "next_text")
    rows = add_sketch(rows, "edited", "edited_sketch").drop("edited")
    rows = add_likeness(rows, "sketch", "edited_sketch", "near_edited", "in_edited")
    rows = add_likeness(rows, "sketch", "next_sketch", "near_next", "in_next")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited", "near_next", "in_edited", "in_next",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
