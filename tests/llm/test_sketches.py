"""Every sketch recomputed from its text with another implementation of the hash, likeness and containment from sets, and estimates against the truth."""

import random
import re

import pytest

from vantagrid.llm import fingerprint

xxhash = pytest.importorskip("xxhash")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TOP = 1 << 64


def signed(h):
    return h - TOP if h >= TOP >> 1 else h


def shingles(text):
    """The hashes of a text's distinct shingles: words hashed with seed 42, then folded one after the other."""
    words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORDS.findall(text)]

    def fold(run):
        seed = 42
        for h in run:
            seed = xxhash.xxh64_intdigest(h.to_bytes(8, "little"), seed)
        return signed(seed)

    runs = [words[i : i + 5] for i in range(len(words) - 4)] or ([words] if words else [])
    return {fold(r) for r in runs}


def sketch(text):
    every = sorted(shingles(text))
    low = [h for h in every if h < -(TOP >> 1) + TOP // 8]
    return low if len(low) >= 16 else every[:16]


def compared(a, b):
    """(likeness, containment of a in b), from both sketches cut where both are whole."""
    reach = lambda s: TOP if len(s) < 16 else max(s[-1], -(TOP >> 1) + TOP // 8 - 1)
    end = min(reach(a), reach(b))
    x, y = ({h for h in s if h <= end} for s in (a, b))
    return (len(x & y) / len(x | y) if x | y else 1.0), (len(x & y) / len(x) if x else 1.0)


def corpus():
    rng = random.Random(11)
    say = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    long, middle = say(20_000), say(3000)
    words = long.split()
    near = [w if rng.random() > 0.02 else "other" for w in words]
    texts = [None, "", " \t", "one", "one two three four", "one two three four five", "a a a a a a a a", "é ü 漢 字 x y z", long, " ".join(near), " ".join(words[4000:6000]), " ".join(words[:300]), middle, middle, middle + " " + say(3000)]
    return texts + [say(rng.randint(1, 400)) for _ in range(60)]


@pytest.fixture(scope="module")
def found(spark):
    texts = corpus()
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    return texts, {r["doc_id"]: r for r in fingerprint.fingerprints(rows).collect()}


def test_sketches_and_likeness_equal_those_by_hand(found):
    texts, rows = found
    show = lambda s: " ".join(f"{h % TOP:x}" for h in s)
    for i, t in enumerate(texts):
        mine, after = t or "", texts[i - 1] or ""  # falling doc_id; after the first comes the last
        cut = len(mine) // 3
        edited = mine[: len(mine) - cut] + after[:cut]
        r, a, b, c = rows[i], sketch(mine), sketch(edited), sketch(after)
        assert (r["fingerprint"], r["edited_fingerprint"]) == (show(a), show(b)), i
        assert (r["near_edited"], r["in_edited"]) == pytest.approx(compared(a, b)) and (r["near_next"], r["in_next"]) == pytest.approx(compared(a, c)), i


def test_estimates_are_near_the_truth_for_unequal_documents(spark):
    texts = corpus()
    # Whole with near copy, part of 2,000 words in whole of 20,000, start of 300 in whole, half in whole.
    pairs = [(8, 9), (10, 8), (11, 8), (12, 14), (8, 10), (12, 8)]
    rows = spark.createDataFrame([(n, texts[a], texts[b]) for n, (a, b) in enumerate(pairs)], "n int, a string, b string")
    rows = fingerprint.add_sketch(fingerprint.add_sketch(rows, "a", "sa"), "b", "sb")
    for r in fingerprint.add_likeness(rows, "sa", "sb", "near", "inside").collect():
        x, y = (shingles(texts[i]) for i in pairs[r["n"]])
        assert abs(r["near"] - len(x & y) / len(x | y)) < 0.06 and abs(r["inside"] - len(x & y) / len(x)) < 0.06, pairs[r["n"]]
