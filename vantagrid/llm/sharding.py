"""Sharding by longest-processing-time scheduling (operator 9).

Rows with equal texts form a group that stays together.  Groups are sorted
by size and each goes to the least-loaded shard, kept in a heap; equal loads go to the lower shard.

Groups stay distributed.  What the scheduler gets is the sorted list of *runs*: how many groups there are of
each size.  A size of more than ``EXACT_BITS`` bits counts by its leading ones, so the list is bounded whatever the input.
Equal groups of a run are alike to the scheduler: it says how many of them each shard
takes, a short run one by one through the heap, a long one by the level up to which greedy choice fills the shards.
Each group finds its place in its run by numbering within strips of the run, and so its shard.
No shard is then larger than the mean by more than its last group, unless one
group alone is larger than a fair shard, which no scheduling can mend.

A null text has no bytes and belongs with the empty texts: size 1, CRC 0.
Rows whose doc_id is null or repeated each get a slot of their own.  Extra
columns are dropped, whatever their names.  Very long texts are only measured and hashed.  An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialise, small

SHARDS = 16
EXACT_BITS = 17
#: Runs up to this length go through the heap one by one.
SHORT_RUN = 64


def longest_first(runs: Iterable[tuple[int, int]], shards: int) -> list[tuple[int, list[int]]]:
    """(size, groups for each shard) of (size, groups) runs, the largest size first."""
    loads, out = [0] * shards, []
    for size, count in sorted(runs, reverse=True):
        taken = _short(loads, size, count) if count <= SHORT_RUN else _long(loads, size, count)
        loads = [load + size * n for load, n in zip(loads, taken)]
        out.append((size, taken))
    return out


def _short(loads: list[int], size: int, count: int) -> list[int]:
    heap = [(load, s) for s, load in enumerate(loads)]
    heapq.heapify(heap)
    taken = [0] * len(loads)
    for _ in range(count):
        load, s = heap[0]
        taken[s] += 1
        heapq.heapreplace(heap, (load + size, s))
    return taken


def _long(loads: list[int], size: int, count: int) -> list[int]:
    """As ``_short``: greedy choice takes the ``count`` least of the loads that shards pass through."""
    below = lambda level: [max(0, -(-(level - load) // size)) for load in loads]  # noqa: E731  choices at a load under the level
    low, high = min(loads), min(loads) + size * (count + 1)
    while high - low > 1:  # the highest level below which at most ``count`` choices lie
        middle = (low + high) // 2
        low, high = (middle, high) if sum(below(middle)) <= count else (low, middle)
    taken, left = below(low), count - sum(below(low))
    for s, load in enumerate(loads):
        if left and load <= low and (low - load) % size == 0:
            taken[s] += 1
            left -= 1
    return taken


def _leading(size: Column) -> Column:
    """The size, or its leading bits where it has more than ``EXACT_BITS``."""
    extra = F.greatest(F.lit(0), F.floor(F.log2(size)).cast("int") + 1 - EXACT_BITS)
    return F.call_function("shiftleft", F.call_function("shiftright", size, extra), extra)


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, group_id and shard for every row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.md5(text).alias("group_id"),
    )
    groups = rows.groupBy("group_id").agg(F.sum("size").alias("bytes")).withColumn("run", _leading(F.col("bytes")))
    strips = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = materialise(groups.select("group_id", "run", F.pmod(F.xxhash64("group_id"), F.lit(strips)).cast("int").alias("strip")))
    counts = materialise(groups.groupBy("run", "strip").agg(F.count("*").alias("n")))
    runs = [(r["run"], r["n"]) for r in counts.groupBy("run").agg(F.sum("n").alias("n")).toLocalIterator()]  # a run for each leading value
    bounds = [(size, s, sum(taken[:s]), sum(taken[: s + 1])) for size, taken in longest_first(runs, shards) for s in range(shards) if taken[s]]
    placed = spark.createDataFrame(bounds, "run long, shard int, first long, end long")
    # The groups of a strip have consecutive places in their run.
    before = Window.partitionBy("run").orderBy("strip").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("run", "strip", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    nth = F.row_number().over(Window.partitionBy("run", "strip").orderBy("group_id")) - 1
    numbered = groups.withColumn("nth", nth).join(starts, ["run", "strip"]).select("group_id", "run", (F.col("start") + F.col("nth")).alias("place"))
    homes = numbered.join(small(placed, 48), "run").where("place >= first AND place < end").select("group_id", "shard")
    return rows.join(small(materialise(homes), 64), "group_id")


def slots(placed: DataFrame, parts: int | None = None) -> DataFrame:
    """Number the rows of each shard from 0 without a gap.

    Rows of a shard are dealt by hash into ``parts`` strips that are numbered
    side by side; a strip starts where the counts of those before it end.
    """
    spark = placed.sparkSession
    n = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    strip = F.pmod(F.xxhash64("doc_id", "group_id"), F.lit(n)).cast("int")
    dealt = placed.withColumn("strip", strip)
    counts = dealt.groupBy("shard", "strip").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("strip").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "strip", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "strip").orderBy("doc_id", "group_id")
    numbered = dealt.withColumn("nth", F.row_number().over(within) - 1)
    return numbered.join(starts, ["shard", "strip"]).withColumn("slot", (F.col("start") + F.col("nth")).cast("long"))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    return slots(assign(docs, shards)).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))
