"""Exact top-k search by block-at-a-time pruning (operator 13).

Every vector is a document whose terms are its directions, with whole-number weights.  Documents are cut into blocks of neighbours
(``vectors``); of each block the least and the largest weight of every term are kept.  For a query, a block's bound is the sum over
its terms of the largest product that the block can give: the query's weight with the largest entry where it is positive, with the least
where it is negative.  Blocks are ordered by that bound and scored through their forward index, the rows of their documents, best
bounds first, until no bound passes what the query has as its k-th; equal bounds go on as long as the block holds a smaller vec_id.
The k-th of one round of shards bounds the next, so whole shards fall away as well.

Every result is exact.  How much is pruned depends on the vectors: see the README for figures on vectors without structure.

Nulls: a vector that is null or holds null or non-finite entries takes no part; a row without vec_id asks nothing and comes after its equals.
Rows that repeat a vec_id are rows of their own: each asks, and may be found by the other.  Empty tables give empty results, a
table with fewer rows fewer ranks.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise
from .vectors import Shards, Tile, embeddings, quantised

K = 20
FACTOR = 64
#: Queries that are held against all blocks of a shard at once.
QUERIES_AT_ONCE = 2048


def search_tile(held: pa.Table, asked: pa.Table, width: int, exact: str, k: int) -> tuple[pa.Table, int, int]:
    """The finds of a tile, the pairs of queries and blocks scored, and all such pairs."""
    parts, scored, every = [], 0, 0
    for start in range(0, asked.num_rows, QUERIES_AT_ONCE):
        tile = Tile(held, asked.slice(start, QUERIES_AT_ONCE), width, exact, k)
        most, least, first = tile.reduce(np.maximum, tile.x), tile.reduce(np.minimum, tile.x), tile.reduce(np.minimum, tile.rank)
        bound = np.maximum(tile.q, 0) @ most.T + np.minimum(tile.q, 0) @ least.T
        best = bound.astype(np.int64) * tile.scale - first
        unit, block = np.divmod(np.flatnonzero(best.ravel() > np.repeat(tile.need, best.shape[1])), best.shape[1])
        scored += tile.resolve(unit, block, best[unit, block], None)
        every += best.size
        parts.append(tile.finds())
    return pa.concat_tables(parts), scored, every


def top_k(df: DataFrame, queries: Column, k: int = K, factor: int = FACTOR) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` rows with the highest inner products for every row where ``queries`` holds."""
    rows = quantised(df.withColumn("label", F.lit(0)), factor, [F.col("vec_id").cast("long").alias("vec_id"), "label"])
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()))
    index = Shards(rows, by_label=False)
    width, exact = index.width, index.exact

    def kernel(held: pa.Table, asked: pa.Table) -> pa.Table:
        if not held.num_rows or not asked.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "slot": pa.array([], pa.int32()), **{c: pa.array([], pa.int64()) for c in ("score", "vec_id", "row")}})
        return search_tile(held, asked, width, exact, k)[0]

    asking = index.rows.where(queries)
    probes = asking.select(F.col("row").alias("query"), F.lit(0).alias("slot"), "shard", "label", "vector", F.lit(None).cast("long").alias("least"))
    found = index.search(probes, kernel, k)
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row"))
    return found.join(asking.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id")), "query").select("query_id", nth.alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(embeddings(spark, sf_dir), F.col("vec_id") % 20 == 0)
