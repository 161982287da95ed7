"""Language identification by rank-order profiles (operator 2).

A profile is the list of the ``PROFILE`` most frequent letter n-grams (one to
three characters, lower-cased; a run of anything but letters counts as one
border sign).  A text's own list is compared with each language's by the
out-of-place distance: the sum over the text's n-grams of how far their ranks
differ, ``PROFILE`` where the language's list lacks one.  The nearest language
wins; equal distances go to the language that sorts first.  The score is one
minus the distance's share of the largest possible one.

Profiles are learnt from about ``TRAIN_DOCS`` documents of each language: a
document is taken if a hash of its id and text is below that share of its
language's documents, so the sample is bounded whatever the input and no group
is gathered anywhere.  Counting runs in Spark; only the finished profiles
(languages x ``PROFILE`` rows) reach the driver.

Null texts and texts without letters are ``und`` with score 0, and so is every
text where nothing could be learnt.  Rows whose doc_id is null count as not
held out and aren't learnt from; repeated rows are kept.  Extra columns are
ignored by ``predict_query`` and kept by ``identify``; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, documents, frugal, unused_name

PROFILE = 300
LONGEST = 3
TRAIN_DOCS = 2000
UNDETERMINED = "und"
COMPACT_AT = 1 << 18
#: The pipeline rejects what scores lower: no learnt language is near.
LEAST_SCORE = 0.1
_BORDER = np.uint64(1)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def ngrams(text: str) -> np.ndarray:
    """Every n-gram of the text as an integer of 21 bits for each character."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.zeros(0, dtype=np.uint64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first sign after a letter stands for the border
    signs = np.where(letter, points, 1).astype(np.uint64)[keep]
    signs = np.concatenate([[_BORDER], signs, [_BORDER]]) if signs[-1] != _BORDER else np.concatenate([[_BORDER], signs])
    found, key = [signs[signs != _BORDER]], signs
    for n in range(2, LONGEST + 1):
        key = (key[:-1] << np.uint64(21)) | signs[n - 1 :]
        # A border may begin or end an n-gram, not stand inside it.
        found.append(key if n == 2 else key[signs[1:-1] != _BORDER])
    return np.concatenate(found)


def ranked(keys: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, the most frequent first; equal counts by their value."""
    if not len(keys):
        return keys
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts = np.diff(np.append(first, len(keys)))
    if len(first) > most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        kept = counts >= least
        first, counts = first[kept], counts[kept]
    order = np.argsort(-counts, kind="stable")[:most]
    return keys[first[order]]


class _Tally:
    """Counts of keys, kept short by summing whenever ``COMPACT_AT`` keys have come together."""

    def __init__(self):
        self.keys, self.counts, self.pending, self.held = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray) -> None:
        self.pending.append(keys)
        self.held += len(keys)
        if self.held > COMPACT_AT:
            self.compact()

    def compact(self) -> None:
        found, n = np.unique(np.concatenate([self.keys[:0], *self.pending]), return_counts=True)
        every, at = np.unique(np.concatenate([self.keys, found]), return_inverse=True)
        self.counts = np.bincount(at, np.concatenate([self.counts, n]), len(every)).astype(np.int64)
        self.keys, self.pending, self.held = every, [], 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-grams with their counts, by language, summed over each batch."""
    for batch in batches:
        tallies: dict[str, _Tally] = {}
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
            tallies.setdefault(lang, _Tally()).add(ngrams(text.as_py()))
        for lang, tally in sorted(tallies.items()):
            tally.compact()
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(tally.keys), pa.string()), pa.array(tally.keys.view(np.int64)), pa.array(tally.counts)], ["lang", "gram", "n"])


def held_out() -> F.Column:
    """Whether a document is kept from learning: crc32 of its doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, train_docs: int = TRAIN_DOCS, profile: int = PROFILE) -> dict[str, list[int]]:
    """The profile of every language among the documents that aren't held out."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    usable = rows.where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").where(~held_out())
    sizes = usable.groupBy("lang").agg(F.count("*").alias("docs"))
    share = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / (1 << 30)
    sample = usable.join(F.broadcast(sizes), "lang").where(share * F.col("docs") < train_docs)  # one row a language
    grams = sample.select("lang", "text").mapInArrow(frugal(_count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = grams.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= profile)
    found: dict[str, list[int]] = {}
    for row in top.orderBy("lang", "rank").collect():  # languages x profile
        found.setdefault(row["lang"], []).append(row["gram"])
    return found


class Profiles:
    """Profiles laid out for look-up: for each known n-gram its rank in each language."""

    def __init__(self, profiles: dict[str, list[int]], most: int = PROFILE):
        self.langs, self.most = sorted(profiles), most
        self.grams = np.unique(np.array([g for p in profiles.values() for g in p], dtype=np.int64).view(np.uint64))
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, dtype=np.int32)  # the last row: unknown
        for k, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.grams, np.array(profiles[lang], dtype=np.int64).view(np.uint64)), k] = np.arange(len(profiles[lang]))

    def nearest(self, text: str | None) -> tuple[str, float]:
        mine = ranked(ngrams(text), self.most) if text else ()
        if not len(mine) or not self.langs:
            return UNDETERMINED, 0.0
        at = np.searchsorted(self.grams, mine)
        at[at < len(self.grams)] = np.where(self.grams[at[at < len(self.grams)]] == mine[at < len(self.grams)], at[at < len(self.grams)], len(self.grams))
        ranks = self.ranks[at]
        apart = np.where(ranks < 0, self.most, np.abs(ranks - np.arange(len(mine))[:, None])).sum(axis=0)
        k = int(apart.argmin())
        return self.langs[k], float(1 - apart[k] / (self.most * len(mine)))


def _said(known: Profiles, texts: pa.Array) -> tuple[list[str], list[float]]:
    """Language and score of each text; one text at a time is a Python string."""
    found = [known.nearest(text.as_py()) for text in texts]
    return [lang for lang, _ in found], [score for _, score in found]


def identify(docs: DataFrame, profiles: dict[str, list[int]], most: int = PROFILE) -> DataFrame:
    """Add ``lang_pred`` and ``score``; only the text is looked at."""

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Profiles(profiles, most)
        for texts in batches:
            langs, scores = _said(known, texts)
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    inner = unused_name(docs, "said")
    said = docs.withColumn(inner, F.arrow_udf(frugal(predict), "lang_pred string, score double")(F.col("text").cast("string")))
    return said.withColumn("lang_pred", F.col(f"{inner}.lang_pred")).withColumn("score", F.col(f"{inner}.score")).drop(inner)


def accept(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: documents whose language can be told, with ``lang`` set to it.

    One pass predicts and lets only the accepted rows out, so that a text goes to Python once.
    """
    bound_batches(docs.sparkSession)
    profiles, schema = learn(docs), docs.withColumn("text", F.col("text").cast("string")).withColumn("lang", F.lit(None).cast("string")).schema
    names, at = docs.columns, docs.columns.index("lang")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Profiles(profiles)
        for batch in batches:
            langs, scores = _said(known, batch["text"])
            good = [lang != UNDETERMINED and score >= LEAST_SCORE for lang, score in zip(langs, scores)]
            columns = [pa.array(langs, pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(good, pa.bool_()))

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(frugal(keep), schema)


def predict_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    said = identify(docs.select("doc_id", "text"), learn(docs))
    return said.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "lang_pred", "score")
