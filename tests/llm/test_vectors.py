"""Whitening, hard negatives and top-k search against plain numpy, on copies, ties, nulls, short vectors, empty tables and clashing columns."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vantagrid.llm import negatives, topk, vectors, whitening

SCHEMA = "vec_id long, embedding array<double>, label int, row string, x long, slot int"


def rows_of_vectors():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 6))
    rows = [(i, (centres[i % 12] + 0.05 * rng.normal(size=6)).tolist(), int(i % 5)) for i in range(360)]
    rows += [(400 + i, centres[0].tolist(), int(i % 3)) for i in range(150)]  # one vector, very often
    rows += [(i, rows[i][1], rows[i][2]) for i in (0, 20, 20, 100)]  # rows that repeat
    rows += [(20, rng.normal(size=6).tolist(), 1), (None, centres[1].tolist(), 2), (600, [0.5, -0.25], 3), (620, [], 4), (640, [0.0] * 6, None)]
    rows += [(660, None, 1), (680, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (700, [math.nan] + [0.0] * 5, 1), (720, [math.inf] + [0.0] * 5, 2), (740, rng.normal(size=6).tolist(), None)]
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(*r, "k", 1, 2) for r in rows_of_vectors()], SCHEMA).repartition(5)


def plain(rows, factor):
    good = [(i, v, label) for i, v, label in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(factor * c) for c in v] + [0] * (6 - len(v)) for _, v, _ in good])
    return [i for i, _, _ in good], [label for *_, label in good], x


def nearest(ids, score, allowed, k):
    far = 1 << 62
    order = sorted(allowed, key=lambda j: (-score[j], far if ids[j] is None else ids[j], j))
    return order[:k]


@pytest.fixture
def small_shards(monkeypatch):
    monkeypatch.setattr(vectors, "LEAST_ROWS", 60)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 8)


def test_top_k_equals_brute_force(table, small_shards):
    ids, _, x = plain(rows_of_vectors(), 64)
    got = topk.top_k(table, F.col("vec_id") % 20 == 0, k=7).collect()
    want = []
    for q in [i for i, v in enumerate(ids) if v is not None and v % 20 == 0]:
        score = x @ x[q]
        want += [(ids[q], rank, ids[j], int(score[j])) for rank, j in enumerate(nearest(ids, score, [j for j in range(len(ids)) if j != q], 7), 1)]
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_top_k_goes_on_where_extents_are_too_large_to_be_sent(table, small_shards, monkeypatch):
    want = sorted(map(tuple, topk.top_k(table, F.col("vec_id") % 40 == 0, k=3).na.drop().collect()))
    monkeypatch.setattr(vectors, "EXTENT_BYTES", 0)
    monkeypatch.setattr(vectors, "TILE_PROBES", 5)
    monkeypatch.setattr(vectors, "ROUND", 2)
    assert sorted(map(tuple, topk.top_k(table, F.col("vec_id") % 40 == 0, k=3).na.drop().collect())) == want


def brute_negatives(rows, anchors):
    ids, labels, x = plain([r for r in rows if r[2] is not None], 256)
    out = []
    for a in [i for i, v in enumerate(ids) if v is not None and anchors(v)]:
        score = x @ x[a]
        for p in nearest(ids, score, [j for j in range(len(ids)) if j != a and labels[j] == labels[a]], 5):
            s = score[p]
            far = nearest(ids, score, [j for j in range(len(ids)) if labels[j] != labels[a] and 80 * s <= 100 * score[j] <= 100 * s], 5)
            out += [(ids[a], ids[p], rank, ids[n], int(s), int(score[n])) for rank, n in enumerate(far, 1)]
    return out


def test_hard_negatives_equal_brute_force(table, small_shards):
    got = negatives.mine(table, F.col("vec_id") % 10 == 0).collect()
    want = brute_negatives(rows_of_vectors(), lambda v: v % 10 == 0)
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert len(want) > 300 and sorted(map(tuple, got), key=key) == sorted(want, key=key)


def tile(n, probes, clusters, seed=1):
    """A shard of ``n`` vectors in tight clusters, and probes near them."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, 16))
    x = np.floor(64 * (centres[np.arange(n) % clusters] + 0.02 * rng.normal(size=(n, 16)))).astype(int)
    q = np.floor(64 * (centres[np.arange(probes) % clusters] + 0.02 * rng.normal(size=(probes, 16)))).astype(int)
    order = np.concatenate(vectors.halved(x, np.zeros(n, int), 16))
    block = np.repeat(np.arange(-(-n // 8)), 8)[:n]
    number = pa.array(order, pa.int64())
    held = pa.table({"block": pa.array(block, pa.int32()), "row": number, "vec_id": number, "label": pa.array(order % clusters % 4, pa.int64()), "vector": vectors.packed(x[order])})
    none = pa.nulls(probes, pa.int64())
    asked = pa.table({"query": pa.array(np.arange(probes) + n, pa.int64()), "slot": pa.array(np.zeros(probes), pa.int32()), "label": pa.array(np.arange(probes) % clusters % 4, pa.int64()), "vector": vectors.packed(q), "least": none, "most": none, "score": none, "vec_id": none})
    return held, asked, x, q


def test_blocks_are_pruned_and_nothing_is_lost():
    held, asked, x, q = tile(2000, 50, 40)
    finds, scored, every = topk.search_tile(held, asked, 16, "f8", 10)
    assert scored < every / 4
    got = {}
    for r in finds.to_pylist():
        got.setdefault(r["query"] - 2000, []).append((-r["score"], r["vec_id"]))
    for p in range(50):
        assert sorted(got[p]) == sorted((-int(s), j) for j, s in enumerate(x @ q[p]))[:10]


@pytest.mark.parametrize("same", [True, False])
def test_pairs_of_nodes_are_pruned_and_nothing_is_lost(same):
    held, asked, x, q = tile(2000, 800, 40)  # a leaf of probes lies in one cluster
    finds, scored, every = negatives.search_tile(held, asked, 16, "f8", 10, same)
    assert scored < every / 3
    label, got = np.arange(2000) % 40 % 4, {}
    for r in finds.to_pylist():
        got.setdefault(r["query"] - 2000, []).append((-r["score"], r["vec_id"]))
    for p in range(800):
        allowed = [(-int(s), j) for j, s in enumerate(x @ q[p]) if (label[j] == p % 40 % 4) == same]
        assert sorted(got[p]) == sorted(allowed)[:10]


def test_intervals_hold_every_product():
    rng = np.random.default_rng(2)
    a, b = (np.floor(30 * rng.normal(size=(40, 5))) for _ in range(2))
    trees = [negatives.Tree(v, np.zeros(40, int), np.arange(0, 41, 5)) for v in (a, b)]
    lo, hi = negatives.interval(*(tuple(np.repeat(v, 8, axis=0) if t is trees[0] else np.tile(v, (8, 1)) if v.ndim == 2 else np.tile(v, 8) for v in t.levels[0]) for t in trees))
    for n in range(64):
        product = a[n // 8 * 5 : n // 8 * 5 + 5] @ b[n % 8 * 5 : n % 8 * 5 + 5].T
        assert lo[n] <= product.min() and product.max() <= hi[n]


def test_whitening_equals_eigenvectors(table):
    ids, _, x = plain(rows_of_vectors(), 256)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    away = fit - s / n
    e, v = np.linalg.eigh(away.T @ away / n)
    e, v = e[::-1], v[:, ::-1]
    got = whitening.whiten(table).collect()
    assert len(got) == 4 * len(ids) and {r["n"] for r in got} == {n}
    want = {}
    for i, row in zip(ids, x):
        want.setdefault(i, []).append((int(((n * row - s) ** 2).sum()), (row - s / n) @ v[:, :4] / np.sqrt(e[:4])))
    first = max(want[0], key=lambda w: abs(w[1]).min())[1]
    signs = {}
    for r in got:
        c = r["component"] - 1
        assert int(r["deviation"]) in {d for d, _ in want[r["vec_id"]]}
        size = min(abs(abs(r["whitened"]) - abs(w[c])) for _, w in want[r["vec_id"]])
        assert size < 1e-9 and abs(r["explained"] / (e[c] / e.sum()) - 1) < 1e-9 and r["identity_error"] < 1e-9
        if r["vec_id"] == 0:
            signs.setdefault(c, np.sign(r["whitened"] * first[c]))
    for r in got:
        c = r["component"] - 1
        assert min(abs(r["whitened"] - signs[c] * w[c]) for _, w in want[r["vec_id"]]) < 1e-9


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], schema)).count() == 0
    line = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.25, 0.125]), (2, [0.25, 0.125]), (3, [0.0, 0.0])], schema)).collect()
    assert sorted((r["vec_id"], r["component"], r["n"]) for r in line) == [(1, 1, 3), (2, 1, 3), (2, 1, 3), (3, 1, 3)]
    assert all(abs(r["explained"] - 1) < 1e-12 for r in line)


def test_empty_and_too_large(spark, table):
    for rows in (spark.createDataFrame([], SCHEMA), table.where("vec_id = 660")):
        assert whitening.whiten(rows).count() == 0
        assert negatives.mine(rows, F.col("vec_id") % 10 == 0).count() == 0
        assert topk.top_k(rows, F.col("vec_id") % 10 == 0).count() == 0
    assert negatives.mine(table.where("label = 1"), F.col("vec_id") % 10 == 0).count() == 0
    with pytest.raises(ValueError, match="scores may pass"):
        topk.top_k(spark.createDataFrame([(1, [1e6, 2.0])], "vec_id long, embedding array<double>"), F.lit(True))
