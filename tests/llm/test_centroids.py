"""Clustering with heap-ordered bounds against plain rounds, and its defined edge cases."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripchain.llm import centroids

SCHEMA = "vec_id long, embedding array<float>"


def by_hand(rows, k=16, rounds=3, length=64):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of the usable rows."""
    kept = [(i, np.floor(np.clip(np.array(v, np.float64) * 64, -(2**27), 2**27)).astype(np.int64)) for i, v in rows
            if v is not None and len(v) == length and all(c is not None and np.isfinite(c) for c in v)]
    seed = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1].tolist())
    own = np.array([x for _, x in sorted(kept, key=seed)[:k]])
    x = np.array([x for _, x in kept])
    nearest = lambda: ((x[:, None] - own[None]) ** 2).sum(2)
    for _ in range(rounds):
        at = nearest().argmin(1)
        own = np.array([x[at == c].sum(0) // (at == c).sum() if (at == c).any() else own[c] for c in range(len(own))])
    d = nearest()
    at, d = d.argmin(1), d.min(1)
    sums = {c: int(d[at == c].sum()) for c in set(at.tolist())}
    return [(i, int(c), int(e), sums[int(c)], sum(sums.values()), hashlib.sha256(",".join(map(str, own[c].tolist())).encode()).hexdigest())
            for (i, _), c, e in zip(kept, at, d)]


def same(spark, rows, schema=SCHEMA):
    key = lambda r: tuple(map(str, r))
    got = centroids.report(spark.createDataFrame(rows, schema).repartition(5)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(by_hand([r[:2] for r in rows]), key=key)


def test_report_equals_plain_rounds(spark, monkeypatch):
    monkeypatch.setattr(centroids, "BLOCK_ROWS", 100)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 64))
    vectors = (centres[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 64)) * 0.4).astype(np.float32)
    vectors[200:700] = vectors[200]
    vectors[800:900] = np.round(vectors[800:900])
    rows = [(int(i), v.tolist()) for i, v in enumerate(vectors)]
    rows += [(None, rows[3][1]), (None, rows[4][1]), (5, rows[6][1]), (5, rows[6][1]), (7, None), (8, [1.0] * 63), (9, []), (10, [None] + [1.0] * 63),
             (11, [float("nan")] * 64), (12, [float("inf")] + [0.0] * 63), (13, [0.0] * 64), (14, [1e30, -1e30] + [0.0] * 62)]
    same(spark, rows)


@pytest.mark.parametrize("n", [1, 15, 16])
def test_few_vectors_and_equal_ones(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, rng.normal(size=64).astype(np.float32).tolist(), "clash", 1) for i in range(n)]
    same(spark, rows + [(100 + i, rows[0][1], "clash", 1) for i in range(30)], SCHEMA + ", vectors string, block long")


def test_ties_go_to_the_smaller_number(spark):
    """Whole steps on a line: many vectors are as far from one centroid as from another."""
    same(spark, [(i, [float(i % 37)] + [0.0] * 63) for i in range(400)])


def test_only_expired_gaps_are_scanned(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(16, 64)) * 3
    vectors = (np.repeat(centres, 60, axis=0) + rng.normal(size=(960, 64)) * 0.05).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    found, _, scanned = centroids.cluster(spark.createDataFrame(rows, SCHEMA), rounds=8)
    # Gaps of vectors near two seeds of one group expire in every round, the others once the drift of several rounds has added up.
    assert scanned[0] == 960 and min(scanned[1:]) < 960 / 4 and sum(scanned[1:]) < 8 * 960 / 2
    assert found.agg(F.countDistinct("vec_id")).first()[0] == 960


def test_empty_tables(spark):
    assert centroids.report(spark.createDataFrame([], SCHEMA)).count() == 0
    assert centroids.report(spark.createDataFrame([(1, None), (2, [1.0])], SCHEMA)).count() == 0
