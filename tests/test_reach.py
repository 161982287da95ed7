"""Reach sets, seeded layouts and greedy ones against plain sets."""

import math
import random

import pytest
from pyspark.sql import functions as F

from vantagrid.operators import reachsets


def pool():
    """200 places of two scenes, some of which reach nothing, over points of several bitmaps."""
    rng = random.Random(4)
    reach, at = {}, {}
    for s in (0, 7):
        for p in range(200):
            start = rng.randrange(0, 90_000)
            at[s, p] = tuple(rng.uniform(-9, 9) for _ in range(3)) if p % 50 else (1.0, 2.0, 3.0)
            reach[s, p] = {start + rng.randrange(0, 3000) for _ in range(rng.choice([0, 5, 400]))} | ({0, 1, 32768, 32769} if p in (3, 4) else set())
    return reach, at


@pytest.fixture(scope="module")
def tables(spark):
    reach, at = pool()
    rows = [(s, p, x) for (s, p), points in reach.items() for x in points]
    seen = spark.createDataFrame(rows + rows[:50], "scene long, place int, point long")
    places = spark.createDataFrame([(*key, *xyz, 11) for key, xyz in at.items()], "scene long, place int, px double, py double, pz double, seed long")
    return reach, at, reachsets.reach_sets(seen).cache(), places


def test_counts_unions_and_gains(tables):
    reach, _, sets, _ = tables
    assert {(r["scene"], r["place"]): r["n"] for r in reachsets.counts(sets).collect()} == {k: len(v) for k, v in reach.items() if v}
    assert {r["scene"]: r["n"] for r in reachsets.union_count(sets).collect()} == {s: len(set().union(*(v for k, v in reach.items() if k[0] == s))) for s in (0, 7)}
    held = {s: set().union(*(v for k, v in reach.items() if k[0] == s and k[1] < 20)) for s in (0, 7)}
    got = reachsets.gains(sets.where("place >= 20"), reachsets.union(sets.where("place < 20"))).collect()
    assert {(r["scene"], r["place"]): r["gain"] for r in got} == {k: len(v - held[k[0]]) for k, v in reach.items() if v and k[1] >= 20}


def test_greedy_over_more_than_128_places(tables):
    reach, at, sets, places = tables
    got = {}
    for r in reachsets.greedy(sets, places, 7).collect():
        got[r["scene"], r["step"]] = (r["place"], r["covered"])
    for s in (0, 7):
        held, left, apart = set(), list(range(200)), dict.fromkeys(range(200), math.inf)
        for step in range(1, 8):
            pick = max(left, key=lambda p: (len(reach[s, p] - held), apart[p], -p))
            held |= reach[s, pick]
            assert got[s, step] == (pick, len(held))
            left.remove(pick)
            apart = {p: min(apart[p], math.dist(at[s, p], at[s, pick])) for p in left}


def test_greedy_ends_with_the_places(tables):
    _, _, sets, places = tables
    few = places.where("place < 3 AND scene = 0")
    assert reachsets.greedy(sets, few, 9).count() == 3 and reachsets.greedy(sets, few.where("false"), 9).count() == 0


def plain_numbers(seed):
    def imul(a, b):
        return a * b & 0xFFFFFFFF

    a = seed & 0xFFFFFFFF
    while True:
        a = (a + 0x9E3779B9) & 0xFFFFFFFF
        t = a ^ a >> 16
        t = imul(t, 0x21F0AAAD)
        t ^= t >> 15
        t = imul(t, 0x735A2D97)
        t ^= t >> 15
        yield t / 2**32


def test_orders_go_on_from_trial_to_trial(spark, tables):
    *_, places = tables
    for take in (9, 500):
        got = {}
        for r in reachsets.trial_orders(places, 5, take).where("scene = 7").orderBy("trial", "k").collect():
            got.setdefault(r["trial"], []).append(r["place"])
        order = list(range(200))
        for t in range(5):
            stream = plain_numbers(11 ^ ((t + 1) * 0x9E3779B1 & 0xFFFFFFFF))
            for i in range(min(take, 200)):
                j = i + math.floor(next(stream) * (200 - i))
                order[i], order[j] = order[j], order[i]
            assert got[t] == order[:take]
    assert reachsets.trial_orders(places.where("false"), 5, 9).count() == 0


def test_generator_as_a_column(spark):
    stream = plain_numbers(-5)
    want = [next(stream) for _ in range(20)]
    got = spark.range(20).select(reachsets.generator(F.lit(-5), F.col("id")).alias("u")).collect()
    assert [r["u"] for r in got] == want == reachsets.numbers(-5, 20).tolist()


def test_curves_of_random_layouts(tables):
    reach, _, sets, places = tables
    orders = reachsets.trial_orders(places, 4, 12)
    layout = {}
    for r in orders.orderBy("k").collect():
        layout.setdefault((r["scene"], r["trial"]), []).append(r["place"])
    got = {(r["scene"], r["trial"], r["k"]): r["score"] for r in reachsets.trial_curve(orders, sets).collect()}
    want = {(s, t, k): len(set().union(*(reach[s, p] for p in ps[:k]))) for (s, t), ps in layout.items() for k in range(1, 13)}
    assert got == want
