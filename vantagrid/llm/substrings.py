"""Substring deduplication through an FM-index for each shard (operator 5).

A word goes if a window of ``WINDOW`` words covers it whose words also start
earlier: in a document with a smaller doc_id, or in the same document.  To
search each document in the index of every other shard would cost the square of the input, so
windows are routed first, without loss:

1. *Routing.*  Equal windows hold the same least ``GRAM``-word hash (their anchor).  Consecutive windows with
   one anchor make a *piece*.  Anchors that stand only once in the corpus are left behind.
2. *Classes.*  Equal pieces are one class, by an aggregate that combines before the shuffle; its occurrence in the smallest
   doc_id lends its words to the index.  So a passage that thousands of documents share is indexed once.
3. *Index.*  Classes are dealt by anchor to shards of about ``SHARD_PIECES``.  Each shard builds a compressed FM-index (a
   wavelet matrix over its BWT) of the words of its classes.
4. *Stream.*  All occurrences, the first ones too, are streamed through the index of their shard, ``STREAM_PIECES`` to a
   task; a shard with more has several tasks with the same index.  Backward search gives each word of a piece its matching statistic, the length
   of the longest match that ends there and stands earlier in the corpus; those of ``WINDOW`` words and more are
   reported as intervals.  Nothing is removed but by these.
5. *Hot anchors.*  An anchor with more classes than a shard is split: its pieces are routed by the hash of all their
   words, and the windows of each class, which may stand in pieces of other classes, by theirs.
6. *Removal.*  The intervals of a document (no more than it has windows) meet its text once more.

Null and empty texts have no words.  A null doc_id counts as larger than all others.  Rows that share a
doc_id count as one document with several texts, and none of them is removed for the
equal start in another.  Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialise, small, whole_text
from .fmindex import FMIndex
from .words import Words, _power, mix, pieces, runs

WINDOW = 20
GRAM = 6
SHARD_PIECES = 20_000
STREAM_PIECES = 200_000
BUSY_ROWS = 5_000
LAST = (1 << 63) - 1
_TIES = (1 << 24) - 1

# A place is one long: 24 bits that tell texts of one doc_id apart, the first word, and up to 31 windows in 5 bits.


def place(tie: np.ndarray, start: np.ndarray, windows: np.ndarray) -> np.ndarray:
    return (tie.astype(np.int64) << 39) | (start.astype(np.int64) << 5) | windows.astype(np.int64)


def _start(at: np.ndarray) -> np.ndarray:
    return (at >> 5) & ((1 << 34) - 1)


def routed(words: Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor, piece, text, start, windows) of each piece; starts count from the text's first word."""
    n = len(words.hash)
    if n < window:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    grams = runs(words.hash, gram)
    width, least, span = window - gram + 1, np.arange(len(grams)), 1
    while span < width:  # the leftmost least of ever longer stretches
        step = min(span, width - span)
        a, b = least[: len(least) - step], least[step:]
        least = np.where(grams[b] < grams[a], b, a)
        span += step
    starts = np.arange(n - window + 1)
    text = np.searchsorted(words.first, starts, side="right") - 1
    whole = starts + window <= words.first[text + 1]
    starts, text, least = starts[whole], text[whole], least[whole]
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(fresh)
    count = np.diff(np.append(first, len(starts)))
    start, text = starts[first], text[first]
    return grams[least[first]], _stretches(words.hash, start, count + window - 1), text, start - words.first[text], count


def _stretches(hashes: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A hash of each stretch of words, the same wherever it stands."""
    up, down = _power(len(hashes) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)])])
    return mix((sums[start + length] - sums[start]) * down[start] + length.astype(np.uint64))


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """Marks the first row of each distinct key; rows are in order of their start."""
    order = np.lexsort((np.arange(len(keys[0])), *keys))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    out = np.empty(len(order), bool)
    out[order] = new
    return out


def _ties(texts: pa.Array) -> np.ndarray:
    return np.array([zlib.crc32((t or "").encode("utf-8", "surrogatepass")) & _TIES for t in texts.to_pylist()], np.int64)


def _route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, piece, doc, at, again); ``again`` marks an occurrence that the same text held before."""
    for batch in batches:
        docs = batch["doc"].to_numpy()
        for i, j, _, _, words in pieces(batch["text"], lower=False):
            ties = _ties(batch["text"].slice(i, j - i))
            anchor, piece, text, start, count = routed(words)
            again = ~_first_of(piece, anchor, text)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), pa.array(piece.view(np.int64)), pa.array(docs[i + text]), pa.array(place(ties[text], start, count)), pa.array(again)],
                ["anchor", "piece", "doc", "at", "again"],
            )


_WORDS = pa.schema([("route", pa.int64()), ("piece", pa.int64()), ("doc", pa.int64()), ("at", pa.int64()), ("words", pa.binary()), ("again", pa.bool_())])


def _words_of_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The word hashes of the asked pieces, and of each window of those that are to be split.

    ``again`` is null for pieces; for windows it marks those that the same text held before.
    """
    for batch in batches:
        docs, asked = batch["doc"].to_numpy(), batch["asked"]
        for i, j, _, _, words in pieces(batch["text"], lower=False):
            rows: list[tuple] = []
            cut_text, cut_start, cut_at = [], [], []
            for k in range(i, j):
                for row in asked[k].as_py():
                    start, count = int(_start(row["at"])), row["at"] & 31
                    a = int(words.first[k - i]) + start
                    if row["whole"]:
                        rows.append((row["route"], row["piece"], docs[k], row["at"], words.hash[a : a + count + WINDOW - 1].tobytes(), None))
                    if row["hot"]:
                        cut_text += [k] * count
                        cut_start += range(a, a + count)
                        cut_at += [place(np.int64(row["at"] >> 39), np.int64(start + x), np.int64(1)) for x in range(count)]
            if cut_at:
                text, start, at = np.array(cut_text), np.array(cut_start), np.array(cut_at, np.int64)
                order = np.lexsort((start, text))
                text, start, at = text[order], start[order], at[order]
                keys = _stretches(words.hash, start, np.full(len(start), WINDOW))
                again = ~_first_of(keys, text)
                own = [words.hash[a : a + WINDOW].tobytes() for a in start]
                key = pa.array(keys.view(np.int64))
                yield pa.RecordBatch.from_arrays([key, key, pa.array(docs[text]), pa.array(at), pa.array(own, pa.binary()), pa.array(again)], schema=_WORDS)
            columns = list(zip(*rows)) or [()] * len(_WORDS)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _WORDS)], schema=_WORDS)


def _within(count: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of ``count``, one after the other."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)


def _streamed(classes: pa.Table, stream: pa.Table) -> pa.Table:
    """(doc, at) of the stretches of streamed pieces whose words stand earlier among the classes of the shard.

    A window's last word has its matching statistic: the length of the longest match that ends there and starts
    earlier in the corpus than the occurrence itself.  The search is done once for each class; how far it holds differs
    from occurrence to occurrence.
    """
    if not len(classes) or not len(stream):
        return pa.table({"doc": pa.array([], pa.int64()), "at": pa.array([], pa.int64())})
    doc, at = classes["doc"].to_numpy(), classes["at"].to_numpy()
    sizes = (at & 31) + WINDOW - 1
    ends = np.cumsum(sizes + 1)
    begin = ends - sizes - 1
    symbols = np.unique(np.frombuffer(b"".join(classes["words"].to_pylist()), np.uint64), return_inverse=True)[1] + 1
    text = np.zeros(int(ends[-1]), np.int64)
    filled = np.delete(np.arange(len(text)), ends - 1)
    text[filled] = symbols
    place_doc, place_start = np.repeat(doc, sizes), np.repeat(_start(at), sizes) + _within(sizes)
    by_order = np.lexsort((place_start, place_doc))
    order = np.full(len(text), len(filled), np.int64)  # separators come last
    order[filled[by_order]] = np.arange(len(filled))
    place_doc, place_start = place_doc[by_order], place_start[by_order]
    index = FMIndex(text, int(sizes.max()), order)

    # The classes that the stream asks for, and the last words of their windows.
    keys, sample = np.unique(classes["piece"].to_numpy(), return_index=True)
    asked, mine = np.unique(np.searchsorted(keys, stream["piece"].to_numpy()), return_inverse=True)
    sample = sample[asked]
    windows = at[sample] & 31
    first_window, window = np.cumsum(windows) - windows, _within(windows)
    last = np.repeat(begin[sample], windows) + window + WINDOW - 1
    low, high = index.single(text[last])
    for i in range(1, WINDOW):
        low, high = index.extend(text[last - i], low, high)

    own_doc, own_at = stream["doc"].to_numpy(), stream["at"].to_numpy()
    count = own_at & 31
    row, mine_window = np.repeat(np.arange(len(count)), count), _within(count)
    found = first_window[mine][row] + mine_window
    own_start = _start(own_at)[row] + mine_window
    statistic = np.zeros(len(row), np.int64)
    active, length, of_class = np.arange(len(row)), WINDOW, np.arange(len(last))
    earliest = np.empty(len(last), np.int64)
    while len(active):
        earliest[of_class] = index.earliest(low[of_class], high[of_class])
        least, d = earliest[found[active]], own_doc[row[active]]
        earlier = (place_doc[least] < d) | ((place_doc[least] == d) & (place_start[least] < own_start[active] - (length - WINDOW)))
        active = active[earlier]
        statistic[active] = length
        length += 1
        active = active[mine_window[active] >= length - WINDOW]
        of_class = np.unique(found[active])
        low[of_class], high[of_class] = index.extend(text[last[of_class] - (length - 1)], low[of_class], high[of_class])
    # An interval that the next word's covers isn't reported.
    top = statistic > 0
    top[:-1] &= (row[1:] != row[:-1]) | (statistic[1:] <= statistic[:-1])
    end = np.flatnonzero(top)
    beyond = statistic[end] - WINDOW
    return pa.table({"doc": own_doc[row[end]], "at": place(own_at[row[end]] >> 39, own_start[end] - beyond, beyond + 1)})


def _with_counted(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join with ``groups``, one row for each of ``keys`` and its number of rows ``n``.

    The groups of more than ``BUSY_ROWS`` are fewer than rows / ``BUSY_ROWS``; their rows stay where they are, and only
    those of other groups are shuffled, so no key can fill a task.
    """
    busy = small(groups.where(F.col("n") > BUSY_ROWS), 64)
    rest = rows.join(busy, keys, "left_anti").join(groups.where(F.col("n") <= BUSY_ROWS), keys)
    return rows.join(busy, keys).unionByName(rest)


def intervals(docs: DataFrame) -> DataFrame:
    """doc (null ids as the largest long), tie, and the removed stretches of each text."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), whole_text().alias("text"))
    every = materialise(rows.mapInArrow(_route, "anchor long, piece long, doc long, at long, again boolean"))
    often = materialise(every.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"))
    shared = materialise(_with_counted(every, often, ["anchor"]).drop("n"))
    classes = materialise(shared.groupBy("anchor", "piece").agg(F.min("doc").alias("first"), F.count("*").alias("n")))
    hot = classes.groupBy("anchor").agg(F.count("*").alias("classes")).where(F.col("classes") > SHARD_PIECES).select("anchor", F.lit(True).alias("hot"))
    marked = _with_counted(shared, classes, ["anchor", "piece"]).join(small(hot, 16), "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    whole = ~F.col("hot") | (F.col("n") > 1)
    marked = materialise(marked.select(F.when(F.col("hot"), F.col("piece")).otherwise(F.col("anchor")).alias("route"), "piece", "doc", "at", "again", "first", "hot", whole.alias("whole")))

    leaders = marked.where("doc = first AND NOT again")
    asked = leaders.groupBy("doc", F.shiftright("at", 39).alias("tie")).agg(F.collect_list(F.struct("route", "piece", "at", "hot", "whole")).alias("asked"))
    texts = rows.withColumn("tie", text_tie()).join(materialise(asked), ["doc", "tie"])
    found = materialise(texts.select("doc", "text", "asked").mapInArrow(_words_of_pieces, "route long, piece long, doc long, at long, words binary, again boolean"))
    cut = found.where("again IS NOT NULL")
    twice = cut.groupBy("route").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1").select("route", "first")
    cut = cut.join(twice, "route")
    columns = ["route", "piece", "doc", "at"]
    indexed = found.where("again IS NULL").select(*columns, "words").union(cut.where("doc = first AND NOT again").select(*columns, "words"))
    stream = marked.where("whole").select(*columns).union(cut.select(*columns))

    shards = max(1, -(-found.count() // SHARD_PIECES))
    shard = F.pmod(F.xxhash64("route"), F.lit(shards)).alias("shard")
    sizes = stream.groupBy(shard).agg(F.ceil(F.count("*") / STREAM_PIECES).cast("int").alias("tasks"))
    sizes = small(materialise(sizes), 16)  # one row a shard
    indexed = indexed.select("*", shard).join(sizes, "shard").withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))
    stream = stream.select("*", shard).join(sizes, "shard").withColumn("task", F.pmod(F.xxhash64("doc", "at"), F.col("tasks")).cast("int"))
    index_of = indexed.select("shard", "task", "piece", "doc", "at", "words").groupBy("shard", "task")
    stream_of = stream.select("shard", "task", "piece", "doc", "at").groupBy("shard", "task")
    gone = index_of.cogroup(stream_of).applyInArrow(_streamed, "doc long, at long")
    return materialise(gone.groupBy("doc", F.shiftright("at", 39).alias("tie")).agg(F.collect_list("at").alias("gone")))


def text_tie() -> Column:
    return F.crc32("text").bitwiseAND(F.lit(_TIES))


def _kept(texts: list[str], gone: list[list[int] | None]) -> Iterator[tuple[int, int, bytes]]:
    """(words, removed words, kept words joined by a space) of each text."""
    for text, places in zip(texts, gone):
        words = text.encode("utf-8", "surrogatepass").split()
        if not places:
            yield len(words), 0, b" ".join(words)
            continue
        at = np.array(places, np.int64)
        edges = np.zeros(len(words) + 1, np.int64)
        np.add.at(edges, _start(at), 1)
        np.add.at(edges, _start(at) + (at & 31) + WINDOW - 1, -1)
        keep = np.cumsum(edges)[:-1] == 0
        yield len(words), int((~keep).sum()), b" ".join(compress(words, keep.tolist()))


def _with_gone(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``gone`` for every row."""
    gone = intervals(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    rows = rows.withColumn("doc", F.coalesce("doc_id", F.lit(LAST))).withColumn("tie", text_tie())
    # Only texts that lose something meet their intervals; the others aren't shuffled.
    ids = small(gone.select("doc", "tie"), 32)
    hit = rows.join(ids, ["doc", "tie"], "left_semi").join(gone, ["doc", "tie"])
    rest = rows.join(ids, ["doc", "tie"], "left_anti").withColumn("gone", F.lit(None).cast("array<long>"))
    return hit.select("doc_id", "text", "gone").union(rest.select("doc_id", "text", "gone"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by a space as ``kept``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = list(zip(*_kept(batch["text"].to_pylist(), batch["gone"].to_pylist()))) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array([b.decode() for b in out[2]], pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return _with_gone(docs).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def digests(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(n, m, hashlib.sha256(b).hexdigest()) for n, m, b in _kept(batch["text"].to_pylist(), batch["gone"].to_pylist())]
            n, m, h = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(h, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _with_gone(docs).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
