"""Clustering and hard negatives against plain code in Python's whole numbers, also where vectors are odd, repeat or tie."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import hamerly, hard_negatives, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, id int, v double"


def clumps(seed, n, dims=64, places=12):
    """Vectors around a few places, some equal to others, ids not in order."""
    r = random.Random(seed)
    middles = [[r.gauss(0, 0.2) for _ in range(dims)] for _ in range(places)]
    ids = r.sample(range(5 * n), n)
    rows = []
    for i in ids:
        p = r.randrange(places)
        v = rows[-1][1] if rows and r.random() < 0.2 else [float(np.float32(x + r.gauss(0, 0.05))) for x in middles[p]]
        rows.append((i, v, (p + (r.random() < 0.2)) % 10, "x", 1, 0.5))
    return rows


def odd_rows(dims=64):
    nan, inf = float("nan"), float("inf")
    v = [0.25] * dims
    return [
        (None, v, 3, None, None, None), (100_001, None, 3, None, None, None), (100_002, [None, *v[1:]], 3, None, None, None), (100_003, [nan, *v[1:]], 3, None, None, None), (100_004, [inf, *v[1:]], 3, None, None, None),
        (100_005, [], 3, None, None, None), (100_006, v[1:], 3, None, None, None), (100_007, [*v, 1.0], 3, None, None, None), (100_008, v, None, None, None, None), (100_009, [float(2**19), *v[1:]], 3, None, None, None),
        (100_010, [-float(2**19) + 1, *v[1:]], 3, None, None, None), (100_011, [0.0] * dims, 3, None, None, None),
    ]


def steps(v):
    return [math.floor(256 * x) for x in v]


def fits(v):
    return v is not None and all(x is not None and math.isfinite(x) and abs(x) < 2**19 for x in v)


def plain_clusters(rows, k=40, rounds=5, dims=64):
    kept = [(i, steps(v)) for i, v, *_ in rows if fits(v) and len(v) == dims]
    begin = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in begin]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def nearest():
        return [min((distance(v, c), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        found = nearest()
        for n in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(kept, found, strict=True) if c == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = nearest()
    return [(i, c, d) for (i, _), (d, c) in zip(kept, found, strict=True)], centroids


def plain_negatives(rows, each=100, positives=5, negatives=10):
    kept = [(i, (label + 1) % 10 if i % 7 == 0 else label, steps(v)) for i, v, label, *_ in rows if fits(v) and label is not None and i is not None]
    out = []
    for i, label, v in kept:
        if i % each:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), j, m) for j, m, w in kept)
        for s, j, _ in [x for x in scored if x[2] == label and x[1] != i][:positives]:
            hard = [(n, -t) for t, n, m in scored if m != label and 30 * -s <= 100 * -t <= 90 * -s][:negatives]
            out += [(i, j, rank, n, -s, t) for rank, (n, t) in enumerate(hard, 1)]
    return sorted(out)


def key(row):
    return [(x is None, x or 0) for x in row]


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_equal_plain_code(spark, seed):
    rows = clumps(seed, 300) + odd_rows()
    rows += rows[:5]
    found, centroids = hamerly.cluster_vectors(spark.createDataFrame(rows, SCHEMA).repartition(4))
    want, plain = plain_clusters(rows)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(want, key=key)
    assert centroids.tolist() == plain


def test_few_equal_and_no_vectors(spark):
    few = [(i, [0.1] * 64, 1, "x", 1, 0.5) for i in (7, 8, 8)]
    found, centroids = hamerly.cluster_vectors(spark.createDataFrame(few, SCHEMA))
    assert sorted(map(tuple, found.collect())) == [(7, 0, 0), (8, 0, 0), (8, 0, 0)] and len(centroids) == 3
    nothing = hamerly.cluster_vectors(spark.createDataFrame([], SCHEMA))[0]
    assert nothing.count() == 0 and [t for _, t in nothing.dtypes] == ["bigint", "int", "bigint"]
    assert hard_negatives.hard_negatives(spark.createDataFrame([], SCHEMA), F.col("id") % 100 == 0).count() == 0


def test_bounds_spare_scans_and_change_nothing():
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(m, 5, (400, 64)) for m in r.normal(0, 60, (20, 64))]).round().astype(np.int64)
    centroids, before = x[r.choice(len(x), 20, replace=False)], None
    state = [None] * 3
    spared = 0
    for _ in range(6):
        *state, scanned = hamerly.Round(centroids, before).assign(x, *state)
        exact = vectors.squared_distances(x, centroids)
        assert (state[0] == exact.argmin(axis=1)).all()
        own, rest = np.sqrt(exact[np.arange(len(x)), state[0]]), np.sqrt(np.where(np.arange(20) == state[0][:, None], np.iinfo(np.int64).max, exact).min(axis=1))
        assert (state[1] >= own).all() and (state[2] <= rest).all()
        spared += (~scanned).sum()
        before, centroids = centroids, np.stack([x[state[0] == c].sum(axis=0) // max(1, (state[0] == c).sum()) if (state[0] == c).any() else centroids[c] for c in range(20)])
    assert spared > 3 * len(x)


@pytest.mark.parametrize("seed,anchors_each", [(4, 1000), (5, 40)])
def test_negatives_equal_plain_code(spark, seed, anchors_each, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 50)
    rows = [(i if i is None or i % 3 else i // 3 * 100, *rest) for i, *rest in clumps(seed, 400)] + odd_rows()
    rows += rows[:5] + [(100_100, [0.5] * 64, 3, None, None, None), (100_200, [-0.5] * 64, 3, None, None, None), (100_300, [0.0] * 64, 4, None, None, None), (100_400, [0.5] * 3, 4, None, None, None)]
    found = hard_negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(4), F.col("id") % 100 == 0, anchors_each=anchors_each)
    want = plain_negatives(rows)
    assert len(want) > 500 and sorted(map(tuple, found.collect())) == want


def test_brackets_hold_every_score_and_spare_most():
    r = np.random.default_rng(6)
    for scale in (50, 30_000_000):
        x = np.concatenate([r.normal(m, scale / 20, (100, 64)) for m in r.normal(0, scale, (16, 64))]).round().astype(np.int64)
        q = x[::50]
        square = int((x * x).sum(axis=1).max())
        pivots = hard_negatives.Pivots(x[:512], square, 16)
        search = hard_negatives.Search(np.arange(len(q)), np.zeros(len(q), np.int64), q, pivots)
        a, b = search.distances[:, None, :], pivots.of_rows(x).astype("<f4").astype(np.float64)[None]
        least, greatest = search.bracket(np.abs(a - b).max(axis=2), (a + b).min(axis=2), np.arange(len(q)))
        exact = vectors.products(q, x)
        assert (least <= exact).all() and (exact <= greatest).all()
        fifth = np.sort(exact, axis=1)[:, -5][:, None]
        assert (greatest >= fifth).mean() < 0.5


def test_products_and_distances_are_exact_at_any_size():
    r = random.Random(8)
    for most in (100, 2**20, 2**27 - 1):
        a, b = ([[r.randint(-most, most) for _ in range(64)] for _ in range(6)] for _ in range(2))
        assert vectors.products(np.array(a), np.array(b)).tolist() == [[sum(x * y for x, y in zip(v, w, strict=True)) for w in b] for v in a]
        assert vectors.squared_distances(np.array(a), np.array(b)).tolist() == [[sum((x - y) ** 2 for x, y in zip(v, w, strict=True)) for w in b] for v in a]
