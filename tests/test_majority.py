"""Cubes to any depth, and majorities, against plain counting."""

import random
from collections import Counter

from vantagrid.operators import aggregates


def test_majority_equals_counting(spark):
    rng = random.Random(1)
    cells = [(0, i, j, k, rng.choice([0, 1, 3]), rng.choice([0, -(1 << 63)]), rng.random() < 0.8) for i in range(8) for j in range(6) for k in range(8)]
    got = {(r["i"], r["j"], r["k"]): (r["mask"], r["mask_high"], r["valid"], r["n"]) for r in aggregates.majority(spark.createDataFrame(cells, "scene long, i long, j long, k long, mask long, mask_high long, valid boolean"), 2).collect()}
    order = lambda i, j, k: sum(((c >> b) & 1) << (3 * b + n) for b in range(2) for n, c in enumerate((i, j, k)))
    for cube in {(i >> 2, j >> 2, k >> 2) for _, i, j, k, *_ in cells}:
        own = sorted((order(i, j, k), (m, h, v)) for _, i, j, k, m, h, v in cells if (i >> 2, j >> 2, k >> 2) == cube)
        counts = Counter(key for _, key in own)  # in the order of first cells
        best = max(counts, key=counts.get)
        assert got[cube] == (*best, counts[best])


def test_cubes_join_until_nothing_does(spark):
    cells = [(0, i, j, k, 5 if i < 16 else i) for i in range(18) for j in range(16) for k in range(16)]
    got = aggregates.cubes(spark.createDataFrame(cells, "scene long, i long, j long, k long, cameras long")).collect()
    assert [tuple(r) for r in got if r["edge"] > 1] == [(0, 0, 0, 0, 16, 5)] and len(got) == 1 + 2 * 16 * 16
