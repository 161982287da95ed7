"""Benchmark decontamination by CGK embedding and bit-sampling LSH (operator 7).

Texts and items are sequences of words (runs of ASCII letters and digits and of
other UTF-8 bytes, ASCII lower-cased, so punctuation doesn't count).  An item of n words
is found where some stretch of a text is within ``ERRORS * n`` word edits of it.

*Windows.*  With k edits an item keeps at least one of k + 1 pieces whole, so a
match shares a run of q = (n - k) // (k + 1) words, three at most, with the item.
Each such run names a window of the item's size in the text.

*Bound.*  A stretch within k edits of an item of n words has n - k places whose words are the item's; a window
around which the text has fewer can't match and isn't looked at any further.

*Embedding.*  The CGK walk reads a sequence with one pointer; at step j it puts
out the word below the pointer and goes on by a random bit that depends on j
and that word.  Sequences within k edits come out within about k^2 places.
Walks (``repeats``: ``REPEATS`` of them, twice as many from ``LONG`` words on), each read at ``SAMPLES`` sampled places, are the hash
functions: a window becomes a candidate only if it agrees with its item in all places of some walk.
The target recall is 0.9 at the allowed edits, for every size of item.  Measured on 60 random items of each size (25 of 160 and 400 words), with all edits
spent on words left out, changed, added or mixed: 0.98 and more from 5 to 160 words, 0.92 and more with ``REPEATS`` walks at 400.
``exact=True`` takes every window that the bound allows; it misses nothing and costs verifications.

*Verification.*  The exact least edit distance of the item to any stretch near
its candidates decides; stretches that overlap are looked at as one.

*Memory.*  Items are kept in classes of sizes up to a power of two, windows are embedded ``CELLS`` words at a time, so one item of
10,000 words costs no more than its own length.  A window goes without walks once one of the same text and item less than k words away has agreed.

The items of a block (``BLOCK_ITEMS``, a fixed number) go to the tasks with the
code; a larger benchmark is worked off in several blocks.  Documents aren't
shuffled at all.  Items that are null or have no words match nothing, null
and empty texts hold nothing, repeated rows give repeated matches, an empty
benchmark gives no matches.  Extra columns are ignored by ``matches`` and kept by
``decontaminate``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, documents, frugal
from .words import mix, pieces, runs, separators, words_of

ERRORS = 0.2
REPEATS = 16
SAMPLES = 2
LONG = 256
LONGEST_RUN = 3
BLOCK_ITEMS = 20_000
#: Words of windows that are looked at together.
CELLS = 1 << 17
_APART = separators("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


def edits_allowed(n: int) -> int:
    return int(ERRORS * n)


def run_length(n: int) -> int:
    """So many words in a row of an item of n words survive the allowed edits."""
    k = edits_allowed(n)
    return max(1, min(LONGEST_RUN, n, (n - k) // (k + 1)))


def embed(windows: np.ndarray, steps: int, walk: int) -> np.ndarray:
    """The CGK embedding of each row of words; 0 stands for the end of a row."""
    n, width = windows.shape
    padded = np.concatenate([windows, np.zeros((n, 1), np.uint64)], axis=1)
    at, rows = np.zeros(n, np.int64), np.arange(n)
    out = np.empty((n, steps), np.uint64)
    salts = mix(np.arange(steps, dtype=np.uint64) + np.uint64(1_000_003 * (walk + 1))) | np.uint64(1)
    for j in range(steps):
        out[:, j] = word = padded[rows, at]
        at += ((word * salts[j]) >> np.uint64(63)).astype(np.int64) & (word != 0)
        np.minimum(at, width, out=at)
    return out


def repeats(n: int) -> int:
    return REPEATS if n < LONG else 2 * REPEATS


def distance(item: np.ndarray, stretch: np.ndarray) -> tuple[int, int, int]:
    """(edits, from, to) of the part of ``stretch`` that is nearest to ``item``; of equals the one that ends, then the one that starts first."""
    edit, places = 1 << 32, np.arange(len(stretch) + 1)
    row = places.copy()  # edits so far, and below them where the part starts
    for i, word in enumerate(item):
        through = np.empty_like(row)
        through[0] = (i + 1) * edit
        np.minimum(row[:-1] + (stretch != word) * edit, row[1:] + edit, out=through[1:])
        row = np.minimum.accumulate(through - places * edit) + places * edit
    end = int((row // edit).argmin())
    return int(row[end] // edit), int(row[end] % edit), end


class Sizes:
    """The items of one class of sizes: their words as rows, and what the walks say of them."""

    def __init__(self, words: list[np.ndarray], width: int, first_place: np.ndarray):
        self.width, self.sizes = width, np.array([len(w) for w in words], np.int64)
        self.padded = np.zeros((len(words), width), np.uint64)
        for i, w in enumerate(words):
            self.padded[i, : len(w)] = w
        self.repeats = repeats(width)
        self.places = (first_place[: self.repeats, None, :] * 3 * self.sizes[None, :, None]).astype(np.int64)
        self.at_once = max(1, CELLS // width)
        self.sampled = [np.concatenate([self.read(self.padded[i : i + self.at_once], r, np.arange(i, min(len(words), i + self.at_once))) for i in range(0, len(words), self.at_once)]) for r in range(self.repeats)]

    def read(self, rows: np.ndarray, walk: int, items: np.ndarray) -> np.ndarray:
        """What a walk over the rows puts out at their items' sampled places."""
        places = self.places[walk][items]
        return np.take_along_axis(embed(rows, int(places.max(initial=-1)) + 1, walk), places, 1)


class Items:
    """One block of the benchmark, laid out for look-up."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.words = [], []
        for item_id, text in items:
            raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
            found = words_of(raw, np.array([0, len(raw)]), True, _APART).hash
            if len(found):
                self.ids.append(item_id)
                self.words.append(found)
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        first_place = np.random.default_rng(7).random((2 * REPEATS, SAMPLES))
        self.width = np.array([1 << max(3, int(n - 1).bit_length()) for n in self.sizes], np.int64)
        self.row, self.classes = np.zeros(len(self.sizes), np.int64), {}
        for width in np.unique(self.width).tolist():
            mine = np.flatnonzero(self.width == width)
            self.row[mine] = np.arange(len(mine))
            self.classes[width] = Sizes([self.words[i] for i in mine], width, first_place)
        self.runs = {}
        for q in {run_length(int(n)) for n in self.sizes}:
            found = [(runs(w, q), i) for i, w in enumerate(self.words) if run_length(len(w)) == q]
            keys = np.concatenate([h for h, _ in found])
            owner = np.concatenate([np.full(len(h), i) for h, i in found])
            offset = np.concatenate([np.arange(len(h)) for h, _ in found])
            order = np.argsort(keys, kind="stable")
            self.runs[q] = (keys[order], owner[order], offset[order])
        flat, owner = (np.concatenate([c, *x]) for c, x in ((np.zeros(0, np.uint64), self.words), (np.zeros(0, np.int64), [np.full(len(w), i) for i, w in enumerate(self.words)])))
        self.vocabulary, word = np.unique(flat, return_inverse=True)
        self.held = np.unique(word * max(1, len(self.ids)) + owner)  # which item has which word

    def windows(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """(item, start, text, runs) of every window that shares runs with its item; ``first`` bounds the texts."""
        owners, starts, texts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for q, (keys, owner, offset) in self.runs.items():
            mine = runs(words, q)
            lo = np.searchsorted(keys, mine)
            place = np.flatnonzero((lo < len(keys)) & (keys[np.minimum(lo, len(keys) - 1)] == mine))
            text = np.searchsorted(first, place, side="right") - 1
            whole = place + q <= first[text + 1]
            place, text = place[whole], text[whole]
            lo, hi = lo[place], np.searchsorted(keys, mine[place], side="right")
            each = hi - lo
            entry = np.repeat(lo, each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            owners.append(owner[entry])
            starts.append(np.repeat(place, each) - offset[entry])
            texts.append(np.repeat(text, each))
        every = np.stack([np.concatenate(texts), np.concatenate(starts), np.concatenate(owners)])
        every = every[:, np.lexsort(every[::-1])]
        fresh = np.ones(every.shape[1], bool)
        fresh[1:] = (every[:, 1:] != every[:, :-1]).any(axis=0)
        text, start, owner = every[:, fresh]
        return owner, start, text, np.diff(np.append(np.flatnonzero(fresh), every.shape[1]))

    def may_match(self, known: np.ndarray, first: np.ndarray, owner: np.ndarray, start: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Which windows' stretches have at least as many words of the item as any match; ``known`` are places in the vocabulary."""
        n = self.sizes[owner]
        k = (ERRORS * n).astype(np.int64)
        lo, hi = np.maximum(first[text], start - k), np.minimum(first[text + 1], start + n + k)
        cell = lo[:, None] + np.arange(int((hi - lo).max(initial=0)))
        word = np.where(cell < hi[:, None], known[np.minimum(cell, len(known) - 1)], -1)
        key = word * max(1, len(self.ids)) + owner[:, None]
        row, column = np.nonzero(word >= 0)
        mine = key[row, column]
        at = np.minimum(np.searchsorted(self.held, mine), len(self.held) - 1)
        return np.bincount(row[self.held[at] == mine], minlength=len(owner)) >= n - k

    def possible(self, words: np.ndarray, first: np.ndarray, owner: np.ndarray, start: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Which windows the bound allows."""
        known = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        known = np.where(self.vocabulary[known] == words, known, -1)
        out = np.zeros(len(owner), bool)
        for width in self.classes:
            mine = np.flatnonzero(self.width[owner] == width)
            step = max(1, CELLS // width)
            for i in range(0, len(mine), step):
                part = mine[i : i + step]
                out[part] = self.may_match(known, first, owner[part], start[part], text[part])
        return out

    def agree(self, words: np.ndarray, owner: np.ndarray, start: np.ndarray, text: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """Which windows agree with their item in the sampled places of some walk; those that share most runs are asked first."""
        out = np.zeros(len(owner), bool)
        for width, group in self.classes.items():
            mine = np.flatnonzero(self.width[owner] == width)
            left = mine[np.argsort(-shared[mine], kind="stable")]
            while len(left):
                part, left = left[: group.at_once], left[group.at_once :]
                item = self.row[owner[part]]
                cell = start[part][:, None] + np.arange(width)
                ok = (cell >= 0) & (cell < len(words)) & (np.arange(width) < group.sizes[item][:, None])
                grid = np.where(ok, words[np.clip(cell, 0, len(words) - 1)], np.uint64(0))
                hit = np.zeros(len(part), bool)
                for r in range(group.repeats):
                    rest = np.flatnonzero(~hit)
                    if not len(rest):
                        break
                    hit[rest] = (group.read(grid[rest], r, item[rest]) == group.sampled[r][item[rest]]).all(axis=1)
                out[part] = hit
                left = left[~self.beside(part[hit], left, owner, start, text)]
        return out

    def beside(self, found: np.ndarray, left: np.ndarray, owner: np.ndarray, start: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Which of the windows ``left`` are less than their allowed edits away from one of ``found`` with the same text and item."""
        if not len(found) or not len(left):
            return np.zeros(len(left), bool)
        span = int(start.max(initial=0)) + int(self.sizes.max(initial=0)) + 1
        pair = lambda w: (text[w] * (len(self.ids) + 1) + owner[w]) * (3 * span)
        keys = np.sort(pair(found) + start[found] + span)
        mine, k = pair(left) + start[left] + span, (ERRORS * self.sizes[owner[left]]).astype(np.int64)
        at = np.searchsorted(keys, mine - k + 1)
        return (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] < mine + k)

    def matches(self, words: np.ndarray, first: np.ndarray, exact: bool = False) -> dict[tuple[int, int], tuple[int, int, int]]:
        """For each (text, item) that match: (edits, first word, words) of the nearest stretch."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        if not self.ids:
            return best
        owner, start, text, shared = self.windows(words, first)
        may = self.possible(words, first, owner, start, text)
        owner, start, text, shared = (v[may] for v in (owner, start, text, shared))
        if not exact:
            hit = self.agree(words, owner, start, text, shared)
            owner, start, text = (v[hit] for v in (owner, start, text))
        k = (ERRORS * self.sizes[owner]).astype(np.int64)
        lo, hi = np.maximum(first[text], start - k), np.minimum(first[text + 1], start + self.sizes[owner] + k)
        order = np.lexsort((lo, owner, text))
        stretches: list[list[int]] = []
        for t, i, a, b in zip(*(v[order].tolist() for v in (text, owner, lo, hi))):
            if stretches and stretches[-1][:2] == [t, i] and a <= stretches[-1][3]:
                stretches[-1][3] = max(b, stretches[-1][3])
            else:
                stretches.append([t, i, a, b])
        for t, i, a, b in stretches:
            allowed = edits_allowed(len(self.words[i]))
            if best.get((t, i), (1,))[0] == 0:
                continue
            edits, begin, end = distance(self.words[i], words[a:b])
            if edits <= allowed and (edits, a + begin) < best.get((t, i), (allowed + 1, 0))[:2]:
                best[t, i] = (edits, a + begin, end - begin)
        return {key: (e, a - int(first[key[0]]), m) for key, (e, a, m) in best.items()}


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    blocks = -(-rows.count() // BLOCK_ITEMS)
    for b in range(blocks):
        yield [tuple(r) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()]


_SCHEMA = "doc_id long, item_id long, edits int, similarity double, first_word long, n_words int"


def _match(items: list[tuple[int, str]], exact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Items(items)
        for batch in batches:
            for i, _, _, _, words in pieces(batch["text"], True, separator=_APART):
                found = sorted(block.matches(words.hash, words.first, exact).items())
                ids = batch["doc_id"].slice(i).take(pa.array([t for (t, _), _ in found], pa.int64()))
                columns = [
                    pa.array([block.ids[k] for (_, k), _ in found], pa.int64()),
                    pa.array([e for _, (e, _, _) in found], pa.int32()),
                    pa.array([1 - e / len(block.words[k]) for (_, k), (e, _, _) in found], pa.float64()),
                    pa.array([a for _, (_, a, _) in found], pa.int64()),
                    pa.array([m for _, (_, _, m) in found], pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", "item_id", "edits", "similarity", "first_word", "n_words"])

    return run


def matches(docs: DataFrame, benchmark: DataFrame, exact: bool = False) -> DataFrame:
    """One row for each document and item it holds, with the nearest stretch."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = [rows.mapInArrow(frugal(_match(items, exact)), _SCHEMA) for items in _blocks(benchmark)]
    return reduce(DataFrame.union, found) if found else rows.sparkSession.createDataFrame([], _SCHEMA)


def decontaminate(docs: DataFrame, benchmark: DataFrame, exact: bool = False) -> DataFrame:
    """The rows of ``docs`` whose text holds no item."""

    def counter(items: list[tuple[int, str]]):
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            block = Items(items)
            for batch in batches:
                held = np.zeros(len(batch), np.int32)
                for i, _, _, _, words in pieces(batch, True, separator=_APART):
                    for t, _ in block.matches(words.hash, words.first, exact):
                        held[i + t] += 1
                yield pa.array(held)

        return F.arrow_udf(frugal(run), "int")

    bound_batches(docs.sparkSession)
    for items in _blocks(benchmark):
        docs = docs.where(counter(items)(F.col("text").cast("string")) == 0)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
