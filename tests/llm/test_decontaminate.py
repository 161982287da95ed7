"""The walks of decontamination: that they choose, how much they find at the allowed edits, and very long items."""

import random
import resource

import numpy as np
import pytest

from vantagrid.llm import decontaminate
from vantagrid.llm.decontaminate import Items, _APART, distance, edits_allowed
from vantagrid.llm.words import words_of


def said(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def spoilt(rng, item, kind, k):
    words = list(item)
    for _ in range(k):
        how, at = kind if kind < 3 else rng.randrange(3), rng.randrange(len(words))
        words[at : at + 1] = ([], said(rng, 1), [words[at], *said(rng, 1)])[how]
    return words


def found(items, texts, exact=False):
    block = Items([(i, " ".join(w)) for i, w in enumerate(items)])
    raw = [" ".join(t).encode() for t in texts]
    at = np.cumsum([0, *map(len, raw)])
    words = words_of(np.frombuffer(b"".join(raw), np.uint8), at, True, _APART)
    return block.matches(words.hash, words.first, exact)


@pytest.mark.parametrize("n", [3, 5, 10, 20, 40, 59, 80, 150, 300])
def test_recall_at_the_allowed_edits(n):
    rng = random.Random(n)
    items = [said(rng, n) for _ in range(30 if n < 100 else 8)]
    texts = [said(rng, 30) + spoilt(rng, item, kind, edits_allowed(n)) + said(rng, 30) for item in items for kind in range(4)]
    all_of = found(items, texts, exact=True)
    assert all((t, t // 4) in all_of for t in range(len(texts)))
    by_walks = found(items, texts)
    assert len(by_walks) >= 0.9 * len(texts)
    assert all(key in all_of and edits >= all_of[key][0] for key, (edits, *_) in by_walks.items())


def test_without_walks_nothing_is_found(monkeypatch):
    rng = random.Random(1)
    items = [said(rng, 30) for _ in range(5)]
    texts = [said(rng, 9) + item for item in items]
    assert len(found(items, texts)) == 5
    monkeypatch.setattr(decontaminate, "repeats", lambda n: 0)
    assert not found(items, texts)
    monkeypatch.setattr(decontaminate, "repeats", lambda n: 1)
    spoiled = [said(rng, 9) + spoilt(rng, item, 3, 6) for item in items * 20]
    one = len(found(items, spoiled))
    monkeypatch.undo()
    assert one < len(found(items, spoiled))


def test_distance_equals_a_plain_table():
    rng = random.Random(3)
    for _ in range(60):
        item, stretch = ([rng.randrange(6) for _ in range(rng.randint(1, 9))] for _ in range(2))
        row = [(0, j) for j in range(len(stretch) + 1)]
        for i, x in enumerate(item):
            last, row = row, [(i + 1, 0)]
            for j, y in enumerate(stretch):
                row.append(min((last[j][0] + (x != y), last[j][1]), (last[j + 1][0] + 1, last[j + 1][1]), (row[j][0] + 1, row[j][1])))
        end = min(range(len(row)), key=lambda j: row[j][0])
        assert distance(np.array(item), np.array(stretch)) == (*row[end], end)


def test_one_very_long_item_among_many(monkeypatch):
    rng = random.Random(8)
    items = [said(rng, 20) for _ in range(20_000)] + [said(rng, 10_000)]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    text = said(rng, 50) + spoilt(rng, items[-1], 3, 300) + said(rng, 50)
    got = found(items, [text, items[7], said(rng, 3000)])
    assert set(got) == {(0, 20_000), (1, 7)} and got[0, 20_000][0] <= 300
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000  # KB
