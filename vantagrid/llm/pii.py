"""Personal data and information-theoretic sanitisation (operator 10).

*Base spans.*  E-mail addresses, IP addresses, card numbers and phone numbers,
found leftmost and without overlap for each kind; a match that fails its check
is dropped and not tried again.  All four scans are linear in the text.

*Secrets.*  A run of ``SECRET_CHARS`` or more letters, digits and ``_+/=-`` that mixes letters and digits, and whose
own signs carry ``SECRET_BITS`` of information each (their empirical entropy), is a key or token: protected too, and removed.

*Terms.*  What is protected are the entities: the values of base spans and secrets.  A term (a run of
three letters or more, lower-cased) is looked at if it stands within
``CONTEXT`` words of an entity, in however few texts.  Over all
documents the corpus tells how strongly it reveals the entity: the pointwise
mutual information log(p(t, e) / (p(t) p(e))) as a share of the entity's
information content -log p(e).  Full disclosure is 1: the term never stands
without the entity.  From ``GENERALISE`` on the term is generalised to its shape, and from ``REMOVE``
on removed, wherever it stands in a text that holds the entity.

Term counts follow the whole corpus.  A scan passes on only words whose
hash is set in a bitmap of ``BITMAP`` bits, made from the candidates; its size is
fixed whatever the input, and the join after it is exact.  A second scan names the disclosing terms of each text with an entity.  A
disclosure (entity, term) then meets the texts of its entity or those of its term, of whichever there are fewer, and is held against
the other; the pairs of all entities and terms of a text are never made.

Null text counts as empty: no spans.  A column that bears an inner name passes through.  Only the text decides, so null or repeated
doc_ids and repeated rows change nothing but counts.  Extra columns are
ignored by ``spans_query`` and kept by ``sanitise``; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, bounded, documents, frugal, materialise, small, unused_name, whole_text
from .words import pieces, separators, words_of

KINDS = ("email", "ip", "card", "phone")
SECRET_CHARS = 20
SECRET_BITS = 3.0
CONTEXT = 8
GENERALISE = 0.9
REMOVE = 0.99
BITMAP = 1 << 20
COMPACT_AT = 1 << 20

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: A match takes whole runs of digits, so the next one can't begin inside a run either.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_APART = separators("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_DIGIT = re.compile("[0-9]")
_SECRET = re.compile(rf"[A-Za-z0-9_+/=-]{{{SECRET_CHARS},}}+")
_LETTER = re.compile("[A-Za-z]")


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[str, int, int]]:
    """An address holds one sign ``@``; it begins where the run of local signs before that begins, or the last address ends."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield "email", start, found.end()
            last = found.end()
        at = text.find("@", at + 1)


def _octet(digits: str) -> bool:
    significant = digits.lstrip("0")
    return len(significant) < 3 or (len(significant) == 3 and significant <= "255")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then by start."""
    out = list(_emails(text))
    if not _DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 13 <= len(d) <= 19 and _luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def bits_per_sign(run: str) -> float:
    """The empirical entropy of the signs of a run."""
    n = len(run)
    return -sum(c / n * math.log2(c / n) for c in Counter(run).values())


def secret_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    for m in _SECRET.finditer(text):
        run = m[0]
        if _DIGIT.search(run) and _LETTER.search(run) and bits_per_sign(run) >= SECRET_BITS:
            found.append(("secret", *m.span()))
    return found


def _overlaps(start: int, end: int, taken: list[tuple[int, int]]) -> bool:
    """Whether [start, end) meets one of the stretches, which are in order of their start; their ends rise too."""
    at = bisect_right(taken, (start, math.inf))
    return (at > 0 and taken[at - 1][1] > start) or (at < len(taken) and taken[at][0] < end)


def _merged(found: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """The stretches that the spans cover, joined where they overlap."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in found):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def protected_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and secrets that overlap none of them."""
    base = base_spans(text)
    secrets = secret_spans(text)
    if base and secrets:
        taken = _merged(base)
        secrets = [s for s in secrets if not _overlaps(s[1], s[2], taken)]
    return base, secrets


def _entity(kind: str, value: str) -> str:
    return f"{kind}:{value.lower() if kind == 'email' else value if kind == 'ip' else _digits(value)}"


def _hash(terms: list[str]) -> np.ndarray:
    """The hashes that a scan gives to these terms; of runs of letters and other UTF-8 bytes."""
    raw = "\n".join(terms).encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    return words_of(data, np.array([0, len(data)]), True, _APART).hash.view(np.int64)


def _scan_key(word: str) -> str:
    """What a scan sees as one word: ASCII is lower-cased, the rest stays."""
    return word.translate(_ASCII_LOWER)


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
_SCANNED = re.compile("[A-Za-z\x80-\U0010ffff]+")


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entity, term, text_key) for terms near an entity; a row with a null term for each entity."""
    names = ["entity", "term", "text_key"]
    for batch in batches:
        rows: list[tuple[str, str | None, str]] = []
        for key, value in zip(batch["text_key"].to_pylist(), batch["text"]):
            text = value.as_py()
            found = sum(protected_spans(text), [])
            if not found:
                continue
            entities: set[tuple[str, str | None, str]] = {(_entity(k, text[a:b]), None, key) for k, a, b in found}
            taken = _merged(found)
            words = [m.span() for m in _WORD.finditer(text)]
            starts, ends = [w[0] for w in words], [w[1] for w in words]
            for kind, a, b in found:
                name = _entity(kind, text[a:b])
                before, after = bisect_left(starts, a), bisect_right(ends, b)
                near = [(x, min(y, a)) for x, y in words[max(0, before - CONTEXT) : before]] + [(max(x, b), y) for x, y in words[after : after + CONTEXT]]
                for x, y in near:
                    for m in _SCANNED.finditer(text, x, y):
                        if _TERM.fullmatch(m[0]) and not _overlaps(*m.span(), taken):
                            entities.add((name, _scan_key(m[0]), key))
            rows += entities
            if len(rows) >= COMPACT_AT // 16:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names)


def _frequencies(bits: bytes):
    """(term_hash, n): in how many documents each word stands whose hash is set in the bitmap."""

    def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        unique, at = np.unique(np.concatenate(keys), return_inverse=True)
        return unique, np.bincount(at, np.concatenate(counts), len(unique)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
        keys, counts, held = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
        for batch in batches:
            for _, _, _, _, words in pieces(batch["text"], True, separator=_APART):
                hit = np.flatnonzero(wanted[(words.hash & np.uint64(BITMAP - 1)).astype(np.int64)])
                text = np.searchsorted(words.first, hit, side="right")
                order = np.lexsort((words.hash[hit], text))
                h, t = words.hash[hit][order], text[order]
                fresh = np.ones(len(h), bool)
                fresh[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
                unique, n = np.unique(h[fresh], return_counts=True)
                keys.append(unique)
                counts.append(n)
                held += len(unique)
                if held > COMPACT_AT:
                    k, c = summed(keys, counts)
                    keys, counts, held = [k], [c], len(k)
                    if held > COMPACT_AT // 2:  # counts of a task may leave it in parts
                        yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c)], ["term_hash", "n"])
                        keys, counts, held = [k[:0]], [c[:0]], 0
        k, c = summed(keys, counts)
        yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c)], ["term_hash", "n"])

    return run


def _bitmap(terms: DataFrame) -> bytes:
    """Bits for the hashes of these terms, ``BITMAP`` in all."""
    slots = terms.select(F.col("term_hash").bitwiseAND(F.lit(BITMAP - 1)).cast("int").alias("slot")).distinct().toArrow()["slot"]
    bits = np.zeros(BITMAP, bool)
    bits[slots.to_numpy()] = True
    return np.packbits(bits).tobytes()


def _held(bits: bytes):
    """(term, text_key) of every text that holds an entity, for its terms whose hash is set in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
        for batch in batches:
            out = []
            for key, value in zip(batch["text_key"].to_pylist(), batch["text"]):
                text = value.as_py()
                if not any(protected_spans(text)):
                    continue
                words = sorted({_scan_key(m[0]) for m in _SCANNED.finditer(text) if _TERM.fullmatch(m[0])})
                if words:
                    out += [(words[i], key) for i in np.flatnonzero(wanted[_hash(words) & (BITMAP - 1)]).tolist()]
                if len(out) >= COMPACT_AT // 16:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], ["term", "text_key"])
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], ["term", "text_key"])

    return run


def _text_key(text: Column) -> Column:
    return F.md5(text)


def disclosures(docs: DataFrame) -> DataFrame:
    """text_key, and the terms to be generalised or removed in the texts with that key."""
    spark = docs.sparkSession
    rows = docs.select(whole_text().alias("text")).withColumn("text_key", _text_key(F.col("text")))
    near = materialise(rows.mapInArrow(frugal(_contexts), "entity string, term string, text_key string"))
    # Each document counts, copies too.
    pairs = near.groupBy("entity", "term").agg(F.count("*").alias("n_both"))

    def hashed(terms: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in terms:
            yield pa.array(_hash(batch.to_pylist()) if len(batch) else [], pa.int64())

    candidates = materialise(pairs.where("term IS NOT NULL").withColumn("term_hash", F.arrow_udf(hashed, "long")("term")))
    bits = _bitmap(candidates)
    counted = rows.select("text").mapInArrow(frugal(_frequencies(bits)), "term_hash long, n long") if any(bits) else spark.createDataFrame([], "term_hash long, n long")
    terms = small(materialise(counted.groupBy("term_hash").agg(F.sum("n").alias("n_term"))), 64)
    total = docs.count()
    # An entity stands in n_both documents at least, so its share is at most log(total / n_term) / log(total / n_both).
    known = candidates.join(terms, "term_hash").where((F.col("n_both") < total) & (F.log(total / F.col("n_term")) >= GENERALISE * F.log(total / F.col("n_both")) - 1e-9))
    entities = materialise(pairs.where("term IS NULL").select("entity", F.col("n_both").alias("n_entity")))
    known = materialise(known).join(entities, "entity")
    pmi = F.log(F.col("n_both") * total / (F.col("n_term") * F.col("n_entity")))
    share = pmi / F.log(total / F.col("n_entity"))
    told = known.withColumn("share", share).where((F.col("share") >= GENERALISE) & (F.col("n_entity") < total))
    told = materialise(told.select("entity", "term", "term_hash", "share", (F.col("n_entity") <= F.col("n_term")).alias("by_entity")))
    bits = _bitmap(told)
    if not any(bits):
        return spark.createDataFrame([], "text_key string, terms array<struct<term: string, remove: boolean>>")
    # A disclosure meets the texts of its entity or of its term, of whichever there are fewer, and is then held against the other.
    terms_of = materialise(rows.mapInArrow(frugal(_held(bits)), "term string, text_key string").distinct())
    entities_of = near.where("term IS NULL").select("entity", "text_key").distinct()
    through = lambda side, first, name, second, other: told.where(side).select("entity", "term", "share").join(first, name).join(second, ["text_key", other], "left_semi")
    mine = through(F.col("by_entity"), entities_of, "entity", terms_of, "term").select("text_key", "term", "share").union(through(~F.col("by_entity"), terms_of, "term", entities_of, "entity").select("text_key", "term", "share"))
    mine = mine.groupBy("text_key", "term").agg(F.max("share").alias("share"))
    return materialise(mine.groupBy("text_key").agg(F.collect_list(F.struct("term", (F.col("share") >= REMOVE).alias("remove"))).alias("terms")))


def all_spans(text: str, terms: list[dict] | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]], dict[str, bool]]:
    """Base spans, then spans of secrets and of disclosing terms, and which of the terms are removed."""
    base, secrets = protected_spans(text)
    if not terms:
        return base, secrets, {}
    remove = {t["term"]: t["remove"] for t in terms}
    taken = _merged(base + secrets)
    extra = [("term", *m.span()) for m in _SCANNED.finditer(text) if _scan_key(m[0]) in remove]
    return base, secrets + [s for s in extra if not _overlaps(s[1], s[2], taken)], remove


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def replaced(text: str, terms: list[dict] | None) -> str:
    """The text with base spans and secrets named by kind, and terms shaped or removed."""
    base, extra, remove = all_spans(text, terms)
    out, at = [], 0
    for kind, a, b in sorted(base + extra, key=lambda s: (s[1], s[2])):
        if b <= at:
            continue
        out.append(text[at : max(at, a)])
        if kind != "term":
            out.append(f"[{kind.upper()}]")
        elif not remove[_scan_key(text[a:b])]:
            out.append("[NAME]" if text[a].isupper() else "[WORD]")
        at = b
    return "".join([*out, text[at:]])


def _with_terms(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with the terms of each text, and the name of that column."""
    told = disclosures(docs)
    key, told_key, terms = (unused_name(docs, kind) for kind in ("text_key", "told_key", "terms"))
    keyed = docs.withColumn(key, _text_key(whole_text()))
    told = told.select(F.col("text_key").alias(told_key), F.col("terms").alias(terms))
    taken = 160 + F.aggregate(terms, F.lit(0), lambda a, t: a + 64 + 4 * F.length(t["term"]))
    return keyed.join(bounded(told, taken), F.col(key) == F.col(told_key), "left").drop(key, told_key), terms


_FOUND = (*KINDS, "secret", "term")


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, digest of the base spans, and all spans; also how many secrets and terms the method adds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, every, counts = [], [], {k: [] for k in _FOUND}
            for value, terms in zip(batch["text"], batch["_terms"]):
                found, extra, _ = all_spans(value.as_py(), terms.as_py())
                base.append(hashlib.sha256(_joined(found).encode()).hexdigest())
                every.append(_joined(found + extra))
                kinds = Counter(s[0] for s in found + extra)
                for k in _FOUND:
                    counts[k].append(kinds[k])
            columns = [batch["doc_id"], *(pa.array(counts[k], pa.int64()) for k in _FOUND), pa.array(base, pa.string()), pa.array(every, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in _FOUND), "base_sha256", "spans"])

    rows, _ = _with_terms(docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")))
    return rows.mapInArrow(frugal(run), "doc_id long, " + ", ".join(f"n_{k} long" for k in _FOUND) + ", base_sha256 string, spans string")


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data, secrets and disclosing terms replaced in ``text``, and ``n_chars`` to match; null stays null."""

    def run(texts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, terms in texts:
            yield pa.array((None if not t.is_valid else replaced(t.as_py(), m.as_py()) for t, m in zip(text, terms)), pa.string())

    bound_batches(docs.sparkSession)
    clean, terms = _with_terms(docs)
    clean = clean.withColumn("text", F.arrow_udf(frugal(run), "string")(F.col("text").cast("string"), F.col(terms)))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast("long"))
    return clean.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(documents(spark, sf_dir))
