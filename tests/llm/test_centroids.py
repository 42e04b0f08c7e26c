"""Operator 13 against a brute-force version in Python's whole numbers."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from findings_engine.llm import centroids


def brute(rows, k, rounds, bits=8):
    """(id, cluster, distance, sum of the cluster, sum, digest) of rows (id, vector)."""
    kept = [(i, [math.floor(Fraction(x) * 2**bits) for x in v]) for i, v in rows if v is not None and None not in v and all(map(math.isfinite, v))]
    order = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    found = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(found))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for n in range(len(found)):
            own = [v for (_, v), c in zip(kept, of, strict=True) if c == n]
            if own:
                found[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    last = [(i, *nearest(v)) for i, v in kept]
    sums = {n: sum(d for _, d, c in last if c == n) for n in range(len(found))}
    fits = lambda d: d if d < 2**63 else None
    told = all(d < 2**63 for _, d, _ in last)
    cluster = lambda n: fits(sums[n]) if all(d < 2**63 for _, d, c in last if c == n) else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found]
    return [(i, c, fits(d), cluster(c), fits(sum(sums.values())) if told else None, digest[c]) for i, d, c in last]


def both(spark, rows, k, rounds, dims):
    df = spark.createDataFrame([(i, v, 1, 2.0, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance double, id string").repartition(3)
    got = centroids.clustered(df, k=k, rounds=rounds, dimensions=dims).drop("components").collect()
    return sorted(map(tuple, got), key=repr), sorted(brute(rows, k, rounds), key=repr)


def test_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=6) * rng.choice([0.1, 1, 5])).tolist()) for i in range(300)]
    got, want = both(spark, rows, 12, 3, 6)
    assert got == want


def test_odd_vectors(spark):
    """Nulls, other lengths, repeated ids and vectors, ties on a coarse grid, components beyond 64 bits."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-2, 3, 3).astype(float).tolist()) for i in range(60)]
    rows += [(7, [1.0, 1.0, 1.0]), (7, [1.0, 1.0, 1.0]), (None, [0.0, 0.0, 0.5])]
    odd = [(900, None), (901, [1.0, 2.0]), (902, [1.0, None, 2.0]), (903, [1.0, float("nan"), 2.0]), (904, [float("inf"), 1.0, 2.0]), (905, [])]
    df_rows = rows + odd
    got, want = both(spark, [r for r in df_rows if r[1] is None or len(r[1]) == 3], 7, 3, 3)
    assert got == want
    assert len(both(spark, rows, 7, 2, 3)[0]) == len(rows)
    huge = [(i, [1.5, -2.25, float(i)]) for i in range(20)] + [(30, [1e300, 1.0, -3e200]), (31, [2.0**40, -(2.0**52) - 3, 0.0]), (32, [1.7e308, -1.7e308, 1e-300])]
    got, want = both(spark, huge, 6, 3, 3)
    assert got == want
    mixed = spark.createDataFrame(df_rows, "vec_id long, embedding array<double>")
    assert centroids.clustered(mixed, dimensions=3, k=4, rounds=1).count() == len(rows)


def test_empty_table_and_few_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    found = centroids.clustered(none)
    assert found.count() == 0 and found.columns[:3] == ["vec_id", "cluster", "distance"]
    one = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert {(r.cluster, r.distance) for r in centroids.clustered(one, dimensions=2).collect()} == {(0, 0)}


@pytest.mark.parametrize("spread", [0.0, 3.0])
def test_annulus_leaves_none_out(spread):
    """The nearest of all, boundary ties included; where norms differ, far fewer pairs than all are compared."""
    rng = np.random.default_rng(3)
    size = np.exp(rng.normal(size=400) * spread)[:, None]
    grid = centroids.on_grid(rng.normal(size=(400, 5)) * size)
    given = [centroids.whole(g) for g in grid[:64]]
    cluster, d, pairs = centroids.Search(given).nearest(grid)
    whole = [centroids.whole(g) for g in grid]
    all_pairs = [[sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in given] for v in whole]
    assert list(map(int, d)) == [min(x) for x in all_pairs] and cluster.tolist() == [x.index(min(x)) for x in all_pairs]
    if spread:
        assert pairs < 0.5 * 400 * 64
    # a centroid exactly on the boundary of the annulus ties with the bound
    line = centroids.Search([[256], [-256], [768]])
    assert line.nearest(np.array([[0.0], [2.0]]))[0].tolist() == [0, 0]
