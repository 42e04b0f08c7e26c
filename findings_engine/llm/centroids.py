"""Operator 13: clustering around centroids in exact whole numbers, by annulus search.

A vector's components become floor(2**BITS * x). A round assigns every vector to its nearest centroid (squared Euclidean distance, the
smaller number of equally near ones) and replaces each centroid that has vectors by floor(sum / count) of each component.

The search sorts the centroids by norm. Where a vector's norm falls among theirs, WINDOW centroids give an upper bound u of its least distance.
No centroid whose norm differs from the vector's by more than u can be nearer, so two binary searches give a range of the sorted centroids,
and those alone are compared exactly. Norms and u are floating-point numbers, widened by SLACK, and both ends of the range are included, so a
centroid that lies on the boundary, or ties, is always compared. Distances are whole numbers: 64-bit ones where they suffice, else Python's.

A round is one pass over the table and keeps nothing for a vector: a task sums its vectors by cluster, and the sums of all tasks meet in a
grouping of (cluster, component, limb), limbs being digits to the base 2**LIMB. What reaches the driver is k centroids, whatever the table's size.

Vectors of another length, or with a null, NaN or infinite component, are left out, as is a null vector. A null id is assigned but starts no
centroid; rows of one id are vectors of their own (starts of one id in the order of their components). Fewer vectors than k start fewer
centroids; an empty table gives none. A distance or sum beyond 64 bits is null. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

DIMENSIONS, CENTROIDS, ROUNDS, BITS = 64, 40, 5, 8
#: Centroids nearest in norm that give the upper bound, and what widens it against rounding.
WINDOW, SLACK = 4, 1e-9
#: Pairs of a vector and a centroid compared at a time.
PAIRS = 8_192
#: Components below this are compared in 64 bits (dimensions times the square of a difference has to fit).
SMALL = 2**26
LIMB = 40
LONGEST = 2**63 - 1


def usable(vector: Column, dimensions: int = DIMENSIONS) -> Column:
    """Whether a vector has the number of components and each is a finite number."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce((F.size(vector) == dimensions) & ~odd, F.lit(False))


def on_grid(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """floor(2**bits * x) / 2**bits, which a double holds exactly; doubles from 2**52 on are whole numbers already."""
    large = np.abs(x) >= 2.0**52
    return np.where(large, x, np.floor(np.where(large, 0, x) * 2.0**bits) / 2.0**bits)


def whole(row: np.ndarray, bits: int = BITS) -> list[int]:
    """The whole numbers that a row of ``on_grid`` stands for."""
    return [int(v) << bits if abs(v) >= 2.0**52 else int(v * 2.0**bits) for v in row.tolist()]


def norms(rows: np.ndarray) -> np.ndarray:
    most = np.maximum(np.abs(rows).max(axis=1, initial=0), 1.0)
    return most * np.sqrt(((rows / most[:, None]) ** 2).sum(axis=1))


def root(d: int, bits: int) -> float:
    try:
        return math.sqrt(d) / 2.0**bits
    except OverflowError:
        return math.inf


@dataclass
class Search:
    """The centroids in the order of their norms. ``given`` are lists of Python's whole numbers."""

    given: list[list[int]]
    bits: int = BITS

    def __post_init__(self):
        def units(n: int) -> float:
            try:
                return n / 2**self.bits
            except OverflowError:
                return math.copysign(math.inf, n)

        rows = np.array([[units(v) for v in c] for c in self.given], float)
        with np.errstate(invalid="ignore", over="ignore"):
            norm = np.nan_to_num(norms(rows), nan=math.inf)
        self.order = np.argsort(norm, kind="stable")
        self.norm = norm[self.order]
        self.small = np.array([max(map(abs, c), default=0) < SMALL for c in self.given])
        self.rows = np.array([c if s else [0] * len(c) for c, s in zip(self.given, self.small, strict=True)], np.int64)

    def distances(self, x: np.ndarray, fits: np.ndarray, grid: np.ndarray, vector: np.ndarray, centroid: np.ndarray) -> np.ndarray:
        """Squared distances of pairs, as 64-bit numbers if all pairs are of small components, else as Python's."""
        plain = fits[vector] & self.small[centroid]
        out = np.zeros(len(vector), np.int64 if plain.all() else object)
        at = np.flatnonzero(plain)
        for lo in range(0, len(at), PAIRS):
            one = at[lo : lo + PAIRS]
            apart = x[vector[one]] - self.rows[centroid[one]]
            out[one] = np.einsum("ij,ij->i", apart, apart)
        for i in np.flatnonzero(~plain):
            out[i] = sum((a - b) ** 2 for a, b in zip(whole(grid[vector[i]], self.bits), self.given[centroid[i]], strict=True))
        return out

    def nearest(self, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Of each row the number of its centroid and its squared distance; and how many pairs were compared."""
        n, k = len(grid), len(self.order)
        with np.errstate(over="ignore"):
            norm = norms(grid)
        fits = np.abs(grid).max(axis=1, initial=0) < SMALL / 2**self.bits
        x = np.where(fits[:, None], grid * 2.0**self.bits, 0).astype(np.int64)
        # an upper bound, infinite if a double can't hold it, from the centroids nearest in norm
        first = np.clip(np.searchsorted(self.norm, norm) - WINDOW // 2, 0, max(0, k - WINDOW))
        wide = min(WINDOW, k)
        pairs = self.distances(x, fits, grid, np.repeat(np.arange(n), wide), self.order[(first[:, None] + np.arange(wide)).ravel()])
        least = pairs.reshape(n, wide).min(axis=1)
        with np.errstate(over="ignore"):
            u = np.sqrt(least) / 2**self.bits if least.dtype != object else np.array([root(d, self.bits) for d in least])
            u = u * (1 + SLACK) + norm * SLACK + SLACK
        # the annulus: centroids whose norms are within u of the vector's, both ends included
        with np.errstate(over="ignore", invalid="ignore"):
            told = np.isfinite(norm + u)
            low, high = np.where(told, norm - u, -math.inf), np.where(told, norm + u, math.inf)
        lo, hi = np.searchsorted(self.norm, low, "left"), np.searchsorted(self.norm, high, "right")
        many = hi - lo
        of = np.repeat(np.arange(n), many)
        ends = np.cumsum(many)
        candidate = self.order[lo[of] + np.arange(len(of)) - (ends - many)[of]]
        d = self.distances(x, fits, grid, of, candidate)
        # the first of each vector's pairs by distance, then number
        best = np.lexsort((candidate, d, of)) if d.dtype != object else np.array(sorted(range(len(d)), key=lambda i: (of[i], d[i], candidate[i])), np.int64)
        best = best[ends - many]
        return candidate[best], d[best], n * wide + len(of)


def _grids(batches: Iterator[pa.RecordBatch], dimensions: int, bits: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            yield part, on_grid(part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions), bits)


def starts(vectors: DataFrame, k: int, bits: int = BITS) -> list[list[int]]:
    """The k vectors whose ids hash smallest (at most k rows reach the driver)."""
    mark = F.sha2(F.concat(F.lit("2:"), F.col("id").cast("string")), 256)
    rows = vectors.filter("id is not null").select(mark.alias("mark"), "vector").orderBy("mark", "vector").limit(k).collect()
    return [whole(on_grid(np.array(r.vector, float), bits), bits) for r in rows]


def moved(vectors: DataFrame, centroids: list[list[int]], bits: int = BITS) -> list[list[int]]:
    """The centroids after one round."""
    search, dimensions = Search(centroids, bits), len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((len(centroids), dimensions), object), np.zeros(len(centroids), np.int64)
        for _, grid in _grids(batches, dimensions, bits):
            cluster, _, _ = search.nearest(grid)
            counts += np.bincount(cluster, minlength=len(centroids))
            fits = np.abs(grid).max(axis=1, initial=0) < SMALL / 2**bits
            part = np.zeros(sums.shape, np.int64)
            np.add.at(part, cluster[fits], (grid[fits] * 2.0**bits).astype(np.int64))
            sums += part
            for i in np.flatnonzero(~fits):
                sums[cluster[i]] += np.array(whole(grid[i], bits), object)
        rows = [(c, -1, 0, int(counts[c])) for c in np.flatnonzero(counts)]
        for c in np.flatnonzero(counts):
            for place, total in enumerate(map(int, sums[c])):
                limb = 0
                while -(2**LIMB) > total or total >= 2**LIMB:
                    rows.append((c, place, limb, total & (2**LIMB - 1)))
                    total, limb = total >> LIMB, limb + 1
                rows.append((c, place, limb, total))
        columns = zip(*rows, strict=True) if rows else ((),) * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(map(int, c)), kind) for c, kind in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["cluster", "place", "limb", "s"])

    summed = vectors.select("vector").mapInArrow(run, "cluster int, place int, limb int, s long").groupBy("cluster", "place", "limb").agg(F.sum("s").alias("s")).collect()
    totals: dict[tuple[int, int], int] = {}
    for r in summed:
        totals[r.cluster, r.place] = totals.get((r.cluster, r.place), 0) + (r.s << (LIMB * r.limb))
    return [[totals[c, p] // totals[c, -1] for p in range(dimensions)] if (c, -1) in totals else old for c, old in enumerate(centroids)]


def assigned(vectors: DataFrame, centroids: list[list[int]], bits: int = BITS) -> DataFrame:
    """id, cluster, distance (squared; null beyond 64 bits)."""
    search, dimensions, kind = Search(centroids, bits), len(centroids[0]), dict(vectors.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, grid in _grids(batches, dimensions, bits):
            cluster, d, _ = search.nearest(grid)
            d = pa.array(d) if d.dtype != object else pa.array([int(v) if v <= LONGEST else None for v in d], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(cluster, pa.int32()), d], names=["id", "cluster", "distance"])

    return vectors.mapInArrow(run, f"id {kind}, cluster int, distance long")


def clustered(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, bits: int = BITS) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256, components (of the centroid, in decimal)."""
    vectors = df.filter(usable(F.col(vector_col), dimensions)).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    centroids = starts(vectors, k, bits)
    spark, kind = df.sparkSession, dict(df.dtypes)[id_col]
    if not centroids:
        return spark.createDataFrame([], f"`{id_col}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, components array<string>")
    for _ in range(rounds):
        centroids = moved(vectors, centroids, bits)
    rows = written(assigned(vectors, centroids, bits), "assigned")
    whole_sum = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(19,0)")))
    sums = rows.groupBy("cluster").agg(whole_sum.alias("sum"), (F.count("distance") == F.count("*")).alias("told"))
    total = sums.agg(F.when(F.bool_and("told"), F.sum("sum")).try_cast("long").alias("inertia"))
    texts = [[str(v) for v in c] for c in centroids]
    kinds = spark.createDataFrame([(n, hashlib.sha256(",".join(t).encode()).hexdigest(), t) for n, t in enumerate(texts)], "cluster int, centroid_sha256 string, components array<string>")
    of_cluster = F.broadcast(kinds.join(sums, "cluster").crossJoin(total))  # k rows at most
    out = rows.join(of_cluster, "cluster")
    return out.select(F.col("id").alias(id_col), "cluster", "distance", F.col("sum").try_cast("long").alias("cluster_inertia"), "inertia", "centroid_sha256", "components")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings")).drop("components")
