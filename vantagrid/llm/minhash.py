"""Near-duplicates by b-bit MinHash (operator 1).

Every set of word shingles gets ``PERMUTATIONS`` minima.  ``BANDS`` bands of
``BAND_ROWS`` of the whole minima give the buckets in which candidates meet; of each
minimum only the ``BITS`` low bits are kept, packed into longs.  From the
number of unequal places in two packed signatures follows the similarity,
corrected for places that agree by chance: with a share m of equal places it
is (m - 2^-b) / (1 - 2^-b).  Pairs that this estimate puts far below the
threshold are dropped; the rest is confirmed on the full sets.

No bucket emits all its pairs.  Equal sets are one *class* from the start.
First every member of a bucket is compared with one centre drawn for that
bucket, and what is confirmed is contracted to components.  Then members of one
bucket that lie in different components are compared inside tasks, in tiles
of bounded size on both sides: by packed signatures, and what stays a candidate by full sets.
A task gives only links that join components it had not joined yet, so its
output is bounded by its members.  Every pair that shares a bucket is either
compared or already connected.

With 32 bands of 4 rows a pair of similarity 0.75 meets in some bucket with
probability 1 - 5e-6; the estimate's margin of four standard errors loses
fewer than 1 in 10,000 of the pairs at the threshold itself.

Null and empty texts have no shingles and are linked with nothing.  Rows with
a null doc_id are linked like others, and the smallest doc_id that is there
names their component (null if there is none).  Repeated rows are one class;
all rows that bear the smallest doc_id are kept.  ``deduplicate`` judges each row by its own
text, so rows that share a doc_id may differ.  Extra columns are ignored
by ``near_duplicates`` and kept by ``deduplicate``, whatever their names, and an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, documents, frugal, give_back, materialise, small, unused_name
from .components import components
from .words import SHINGLE_WORDS, mix, pieces, shingles

PERMUTATIONS = 512
BANDS = 32
BAND_ROWS = 4
BITS = 2
PERCENT = 75
MARGIN_ERRORS = 4.0
BLOCK = 4096

_LONGS = PERMUTATIONS * BITS // 64
_SIGS = [f"s{i}" for i in range(_LONGS)]
_LOW = 0x5555555555555555
_MULTIPLIERS = (mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_ADDENDS = (mix(np.arange(1001, PERMUTATIONS + 1001, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """The least value of each set under each permutation; sets must not be empty."""
    values = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    at = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), PERMUTATIONS), dtype=np.uint32)
    held = np.empty_like(values)
    for k in range(PERMUTATIONS):
        np.multiply(values, _MULTIPLIERS[k], out=held)
        held += _ADDENDS[k]
        out[:, k] = np.minimum.reduceat(held, at)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key for each band of each row."""
    bands = least[:, : BANDS * BAND_ROWS].astype(np.uint64).reshape(len(least), BANDS, BAND_ROWS)
    keys = np.arange(bands.shape[1], dtype=np.uint64)[None, :].repeat(len(least), axis=0)
    for i in range(BAND_ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, i])
    return keys


def packed(least: np.ndarray) -> np.ndarray:
    """The low bits of the minima, 64 / BITS of them in each long."""
    low = (least & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(least), _LONGS, -1)
    return (low << (np.arange(low.shape[2], dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64)


_CHANCE = 2.0**-BITS


def estimate(unequal):
    """Similarity from the number of unequal places (a column or an array), corrected for places that agree by chance."""
    return ((1 - unequal / PERMUTATIONS) - _CHANCE) / (1 - _CHANCE)


def least_estimate(percent: int = PERCENT) -> float:
    """From this estimate on a pair stays a candidate: ``MARGIN_ERRORS`` standard errors below the threshold."""
    equal = percent / 100 + (1 - percent / 100) * _CHANCE
    return percent / 100 - MARGIN_ERRORS * (equal * (1 - equal) / PERMUTATIONS) ** 0.5 / (1 - _CHANCE)


def unequal_places(left: str, right: str) -> Column:
    """Unequal places of two packed signatures, by bit counts."""
    total = F.lit(0)
    for s in _SIGS:
        x = F.col(f"{left}.{s}").bitwiseXOR(F.col(f"{right}.{s}"))
        total = total + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(_LOW)))
    return total


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, _, _, words in pieces(batch["text"], lower=True):
                sets = shingles(words, k)
                full = [s for s in sets if len(s)]
                rows = np.flatnonzero([len(s) > 0 for s in sets])
                keys = [None] * len(sets)
                bands = np.zeros((0, BANDS), np.int64)
                sigs = np.zeros((len(sets), _LONGS), np.int64)
                if full:
                    least = minima(full)
                    bands = band_keys(least).view(np.int64)
                    sigs[rows] = packed(least).view(np.int64)
                    for r, s in zip(rows.tolist(), full):
                        keys[r] = hashlib.md5(s.tobytes()).digest()
                sizes = np.zeros(len(sets) + 1, np.int32)
                sizes[1:][rows] = bands.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(bands.ravel())), *(pa.array(np.ascontiguousarray(sigs[:, s])) for s in range(_LONGS)),
                     *(batch[c].slice(i, j - i) for c in batch.schema.names[2:])],
                    ["doc_id", "n_shingles", "key", "bands", *_SIGS, *batch.schema.names[2:]],
                )

    return run


def signatures(docs: DataFrame, k: int = SHINGLE_WORDS, text_key: bool = False) -> DataFrame:
    """doc_id, n_shingles, key (of the set), bands, and the packed signature in ``s0 ...``; with ``text_key`` also the MD5 of the text."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *([F.md5(text).alias("text_key")] if text_key else []))
    kinds = "doc_id long, n_shingles long, key binary, bands array<long>, " + ", ".join(f"{s} long" for s in _SIGS)
    return rows.mapInArrow(frugal(_signatures(k)), kinds + (", text_key string" if text_key else ""))


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = set()
        for batch in batches:
            for i, j, _, _, words in pieces(batch["text"], lower=True):
                keys, sets = [], []
                for s, key in zip(shingles(words, k), batch["key"].slice(i, j - i).to_pylist()):
                    if key not in given and hashlib.md5(s.tobytes()).digest() == key:
                        given.add(key)
                        keys.append(key)
                        sets.append(s)
                ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
                items = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(items))], ["key", "items"])

    return run


def full_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """The full sets (key, items) of the classes ``wanted(key)``.

    Sets are made anew from the text of one document of each class; where a
    doc_id is repeated or null, the text whose set has the asked key is taken.
    """
    ids = materialise(classes.join(wanted, "key", "left_semi").select("key", F.col("first_id").alias("doc_id")))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    texts = rows.join(small(ids, 64), F.col("id").eqNullSafe(F.col("doc_id"))).select("key", "text")
    return materialise(texts.mapInArrow(frugal(_sets(k)), "key binary, items array<long>"))


def confirm(docs: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose full sets are similar enough."""
    wanted = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
    sets = full_sets(docs, classes, wanted, k)
    left = pairs.join(sets.select(F.col("key").alias("a"), F.col("items").alias("left")), "a")
    both = left.join(sets.select(F.col("key").alias("b"), F.col("items").alias("right")), "b")
    shared = F.size(F.array_intersect("left", "right"))
    return materialise(both.where(100 * shared >= percent * (F.size("left") + F.size("right") - shared)).select("a", "b"))


def _estimated(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    left = nodes.select(F.col("key").alias("a"), F.struct(*_SIGS).alias("l"))
    right = nodes.select(F.col("key").alias("b"), F.struct(*_SIGS).alias("r"))
    near = pairs.join(left, "a").join(right, "b").where(estimate(unequal_places("l", "r")) >= least_estimate(percent))
    return near.select("a", "b")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int32)


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """A small integer for each distinct value."""
    return column.combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)


def _suspects(least: float):
    """Within one tile of a bucket: the members of pairs that lie in different components and stay candidates.

    The tile's guests (some of the members outside the bucket's most frequent component) are compared
    with its residents; a pair of such members only with the larger key as resident.
    """

    def run(table: pa.Table) -> pa.Table:
        comp, key = _codes(table["component"]), np.asarray(table["key"].to_pylist(), dtype=object)
        guest, resident, outside = table["guest"].to_numpy(), table["resident"].to_numpy(), table["outside"].to_numpy()
        sigs = np.stack([table[s].to_numpy() for s in _SIGS], axis=1).view(np.uint64)
        bands = table["bands"].combine_chunks().flatten().to_numpy().reshape(len(comp), BANDS)
        bucket, here = table["bucket"][0].as_py(), np.flatnonzero(resident)
        asked = np.zeros(len(comp), bool)
        for i in np.flatnonzero(guest).tolist():
            js = here[(comp[here] != comp[i]) & (~outside[here] | (key[here] > key[i]))]
            x = sigs[i] ^ sigs[js]
            js = js[estimate(_popcount((x | (x >> np.uint64(1))) & np.uint64(_LOW)).sum(axis=1)) >= least]
            # A pair that shares several buckets is looked at in the first of them only.
            js = js[bands[i, (bands[js] == bands[i]).argmax(axis=1)] == bucket]
            asked[js] = True
            asked[i] |= len(js) > 0
        give_back()
        return table.select(["bucket", "row", "column", "key", "component", "guest", "resident"]).filter(pa.array(asked))

    return run


def _forest(percent: int):
    """Within one tile of a bucket: links, by full sets, that suffice to join the components they join."""

    def run(table: pa.Table) -> pa.Table:
        comp, keys = _codes(table["component"]).copy(), table["key"].combine_chunks()
        guest, resident = table["guest"].to_numpy(), table["resident"].to_numpy()
        items = table["items"].combine_chunks()
        at, values = items.offsets.to_numpy(), items.values.to_numpy()
        sizes = np.diff(at)
        held, codes = np.unique(values[at[0] : at[-1]], return_inverse=True)
        at = at - at[0]
        # Postings: who holds each shingle.
        order = np.argsort(codes, kind="stable")
        owner = np.repeat(np.arange(len(sizes)), sizes)[order]
        first = np.searchsorted(codes[order], np.arange(len(held) + 1))
        left, right = [], []
        for i in np.flatnonzero(guest).tolist():
            mine = codes[at[i] : at[i + 1]]
            shared = np.zeros(len(sizes), np.int64)
            for c in mine.tolist():
                shared[owner[first[c] : first[c + 1]]] += 1
            linked = resident & (comp != comp[i]) & (100 * shared >= percent * (sizes + sizes[i] - shared))
            for j in np.flatnonzero(linked).tolist():
                if comp[j] != comp[i]:
                    comp[comp == comp[j]] = comp[i]
                    left.append(i)
                    right.append(j)
        a, b = pa.array(left, pa.int64()), pa.array(right, pa.int64())
        give_back()
        return pa.table({"a": keys.take(a), "b": keys.take(b)}, schema=pa.schema([("a", pa.binary()), ("b", pa.binary())]))

    return run


def _between_components(docs: DataFrame, classes: DataFrame, members: DataFrame, nodes: DataFrame, names: DataFrame, k: int, percent: int) -> DataFrame:
    """Links, confirmed on full sets, between members of one bucket that lie in different components.

    Pairs are never emitted: tasks first name the members that stand in a
    candidate pair, then get the full sets of these and give a forest of links.
    A bucket's members are its columns, those outside its most frequent component its rows;
    both are cut into parts of about ``BLOCK``, so a tile's size doesn't grow with the bucket.
    """
    named = members.join(names.select(F.col("node").alias("key"), "component"), "key", "left")
    named = materialise(named.withColumn("component", F.coalesce("component", "key")))
    each = named.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    mixed = each.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("home"), F.sum("n").alias("n"), F.count("*").alias("parts")).where("parts > 1 AND n > 2")  # a bucket of two has been compared with its centre
    parts = lambda n: F.ceil(n / BLOCK).cast("int")
    mixed = mixed.select("bucket", F.col("home.component").alias("home"), parts(F.col("n")).alias("columns"), parts(F.col("n") - F.col("home.n")).alias("rows"))
    placed = named.join(mixed, "bucket").join(nodes.select("key", "bands", *_SIGS), "key")
    own = lambda salt, n: F.pmod(F.xxhash64("key", F.lit(salt)), F.col(n)).cast("int")
    placed = placed.withColumn("outside", F.col("component") != F.col("home")).withColumn("own_row", own(1, "rows")).withColumn("own_column", own(2, "columns"))
    tile = lambda row, column: F.struct(row.alias("row"), column.alias("column"))
    down = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda r: tile(r, F.col("own_column")))
    across = F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda c: tile(F.col("own_row"), c))
    placed = placed.withColumn("tile", F.explode(F.when(F.col("outside"), F.array_union(down, across)).otherwise(down)))
    placed = placed.withColumn("row", F.col("tile.row")).withColumn("column", F.col("tile.column"))
    placed = placed.withColumn("guest", F.col("outside") & (F.col("own_row") == F.col("row"))).withColumn("resident", F.col("own_column") == F.col("column"))
    placed = placed.select("bucket", "row", "column", "key", "component", "outside", "guest", "resident", "bands", *_SIGS)
    kinds = "bucket long, row int, column int, key binary, component binary, guest boolean, resident boolean"
    asked = materialise(placed.groupBy("bucket", "row", "column").applyInArrow(_suspects(least_estimate(percent)), kinds))
    sets = full_sets(docs, classes, asked.select("key").distinct(), k)
    return materialise(asked.join(sets, "key").groupBy("bucket", "row", "column").applyInArrow(_forest(percent), "a binary, b binary").distinct())


def near_duplicates(docs: DataFrame, k: int = SHINGLE_WORDS, percent: int = PERCENT, text_key: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row; with ``text_key`` also the MD5 of its text."""
    carried = ["text_key"] if text_key else []
    sigs = materialise(signatures(docs, k, text_key))
    full = sigs.where("key IS NOT NULL")
    classes = materialise(full.groupBy("key").agg(F.min("doc_id").alias("first_id")))
    nodes = materialise(full.groupBy("key").agg(F.first("bands").alias("bands"), *(F.first(s).alias(s) for s in _SIGS)))
    every = nodes.select("key", F.explode("bands").alias("bucket"))
    # Each bucket draws its own centre, so a group that shares many buckets is compared with many of its members.
    drawn = F.min(F.struct(F.xxhash64("bucket", "key").alias("h"), "key"))
    centres = every.groupBy("bucket").agg(drawn.alias("least"), F.count("*").alias("n")).where("n > 1").select("bucket", F.col("least.key").alias("centre"))
    members = materialise(every.join(centres, "bucket").select("bucket", "key", "centre"))
    star = members.where("key != centre").select(F.least("centre", "key").alias("a"), F.greatest("centre", "key").alias("b")).distinct()
    links = confirm(docs, classes, materialise(_estimated(star, nodes, percent)), k, percent)
    names = components(links)
    more = _between_components(docs, classes, members.select("bucket", "key"), nodes, names, k, percent)
    if not more.isEmpty():
        names = components(links.union(more))
    named = classes.join(names.select(F.col("node").alias("key"), "component"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    ids = materialise(named.join(least, "component").select("key", "component_id"))
    out = sigs.select("doc_id", "n_shingles", "key", *carried).join(ids, "key", "left")
    named = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", named.alias("component_id"), F.col("doc_id").eqNullSafe(named).alias("kept"), *carried)


def deduplicate(docs: DataFrame, k: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` but for those that a near-duplicate with a smaller doc_id replaces.

    Rows with a null doc_id stay.
    """
    bound_batches(docs.sparkSession)
    gone_id, gone_key = unused_name(docs, "gone_id"), unused_name(docs, "gone_key")
    gone = near_duplicates(docs, k, percent, text_key=True).where("NOT kept AND doc_id IS NOT NULL")
    gone = materialise(gone.select(F.col("doc_id").alias(gone_id), F.col("text_key").alias(gone_key)).distinct())
    same = (docs["doc_id"].cast("long") == F.col(gone_id)) & (F.md5(docs["text"].cast("string")) == F.col(gone_key))
    return docs.join(small(gone, 64), same, "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
