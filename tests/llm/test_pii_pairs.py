"""Card and phone scans against plain patterns, and texts with very many entities and terms."""

import random
import re

from vantagrid.llm import pii
from vantagrid.llm.pii import protected_spans


def luhn(digits):
    total = sum(d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(int(c) for c in reversed(digits)))
    return total % 10 == 0


def plain(text, kind):
    found = []
    pattern = r"[0-9](?:[\x20-]?[0-9])+" if kind == "card" else r"\+[0-9][\x20().0-9-]+[0-9]"
    for m in re.finditer(pattern, text):
        digits = re.sub("[^0-9]", "", m[0])
        good = 13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15
        if good:
            found.append((kind, *m.span()))
    return found


def test_cards_and_phones_equal_the_plain_patterns():
    rng = random.Random(6)
    seen = {"card": 0, "phone": 0}
    for _ in range(3000):
        text = "".join(rng.choice(["4", "0", "1", "5", "9", " ", "-", "+", "(", ")", ".", "a", "12", "4539 1488 0343 6467", "+44 (0)20 7946", "5555-5555-5555-4444"]) for _ in range(rng.randint(1, 30)))
        base, _ = protected_spans(text)
        for kind in seen:
            want = plain(text, kind)
            seen[kind] += len(want)
            assert [s for s in base if s[0] == kind] == want, text
    assert min(seen.values()) > 100


def test_many_entities_and_terms_in_one_text(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(3000)]
    dense = " ".join(f"{words[2 * i]} u{i}@mail.example {words[2 * i + 1]}" for i in range(1500))
    rows = [(0, dense), (1, "nothing to see here"), (2, f"{words[0]} here"), (3, dense)] + [(i, " ".join(rng.sample(words, 40))) for i in range(4, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.spans(docs).collect()}
    assert found[0]["n_email"] == 1500 and found[0]["spans"] == found[3]["spans"] and found[2]["spans"] == ""
    told = pii.disclosures(docs)
    assert told.count() == 1 and found[0]["n_term"] == len(told.first()["terms"]) > 0
