"""Exact centroid clustering with PCA-rotated filtering.

Vectors are integer: floor(scale * x), x as double. One pass sums the vectors
and their products; the eigenvectors of that covariance give a rotation, and
each vector is stored once with its ``LEAD`` leading rotated coordinates and the
norm of the rest. For a vector x and a centroid c, both rotated,

    |x - c|^2 >= |lead(x) - lead(c)|^2 + (rest(x) - rest(c))^2,

so a centroid whose bound (less a margin for rounding) exceeds the exact
distance to the most promising one is out. The survivors are verified in
integers, ties go to the smaller number, so the rotation decides only how much
is verified, never the result. A round is one pass over the stored vectors;
every batch sums its clusters, and no vector is shuffled. What reaches the
driver is ``k`` centroids and sums of ``k`` x ``dim`` and ``dim`` x ``dim``
numbers.

Vectors that are null, of another length, or hold a null or non-finite
component take no part. Components beyond a long are cut off at its limits;
distances beyond a long are compared exactly and cut off in the result. A repeated id is a vector for each row; rows of
one id among the first ``k`` by hash go by their components. A null id has no
hash and starts no centroid, but is assigned like any other. Fewer than ``k``
vectors give as many centroids, none an empty result. A centroid without
vectors stays where it is. Sums of distances beyond a long are cut off at its
limit. Further columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasklens.llm.common import written

LEAD = 16                # leading coordinates that are stored
SAFE = 1 << 27           # up to here, sums of squared differences fit a long
LARGEST = (1 << 63) - 1


def kept_vectors(rows: DataFrame, dim: int, scale: int, vec_id: str = "vec_id",
                 embedding: str = "embedding") -> DataFrame:
    """(id, v): the integer vectors that take part."""
    x = F.transform(F.col(embedding), lambda c: c.cast("double"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return (rows.select(F.col(vec_id).alias("id"), x.alias("x"))
            .filter(F.size("x") == dim).filter(~bad)
            .select("id", F.transform("x", lambda c: F.floor(c * scale)).alias("v")))


def matrix(column: pa.Array, dim: int, kind=np.int64) -> np.ndarray:
    """(rows, dim) of a list column."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, dim).astype(kind)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows; Python integers where a long may not do."""
    if max(np.abs(x.astype(float)).max(initial=0), np.abs(c.astype(float)).max(initial=0)) > SAFE:
        x, c = x.astype(object), c.astype(object)
    elif x.shape[1] > 128:
        raise ValueError("distances of so many components may exceed a long")
    return ((x - c) ** 2).sum(axis=1)


def rotation(vectors: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean, and eigenvectors by falling eigenvalue, of all vectors.

    Every task gives its sums of components (line ``dim``) and of products,
    which Spark adds up. They are rounded, which turns the axes a little and
    changes no result.
    """
    def sums(batches):
        total, n = np.zeros((dim + 1, dim)), 0
        for b in batches:
            x = matrix(b.column(0), dim, float)
            total[:dim] += x.T @ x
            total[dim] += x.sum(axis=0)
            n += len(x)
        if n:
            line, place = np.indices(total.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(line, pa.int32()), pa.array(place, pa.int32()), pa.array(np.full(total.size, n)),
                 pa.array(total.ravel())], names=["line", "place", "n", "s"])

    parts = vectors.select("v").mapInArrow(sums, "line int, place int, n long, s double")
    rows = parts.groupBy("line", "place").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    if not rows:
        return np.zeros(dim), np.eye(dim)
    total = np.zeros((dim + 1, dim))
    for r in rows:
        total[r.line, r.place] = r.s / r.n
    return total[dim], np.linalg.eigh(total[:dim] - np.outer(total[dim], total[dim]))[1][:, ::-1]


class Filter:
    """Centroids with their rotated leads and rests."""

    def __init__(self, centroids: np.ndarray, mean: np.ndarray, axes: np.ndarray, lead: int):
        self.centroids, self.mean, self.axes, self.lead = centroids, mean, axes, lead
        self.leads, self.rests = self.rotated(centroids)

    def rotated(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        turned = (x - self.mean) @ self.axes
        return turned[:, :self.lead], np.sqrt((turned[:, self.lead:] ** 2).sum(axis=1))

    def nearest(self, x: np.ndarray, leads: np.ndarray, rests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cluster and squared distance of each vector, and how many were computed for it."""
        bound = ((leads ** 2).sum(axis=1)[:, None] + (self.leads ** 2).sum(axis=1) - 2 * leads @ self.leads.T
                 + (rests[:, None] - self.rests) ** 2)
        rows = np.arange(len(x))
        best = bound.argmin(axis=1)
        least = squared(x, self.centroids[best])
        # rounding errors are relative to the squared norms that were subtracted
        size = (leads ** 2).sum(axis=1) + rests ** 2
        most = (self.leads ** 2).sum(axis=1) + self.rests ** 2
        margin = 1e-9 * (size[:, None] + most + (self.mean ** 2).sum()) + 1e-6
        open_ = bound - margin <= least.astype(float)[:, None]
        open_[rows, best] = False
        for c in range(len(self.centroids)):  # ascending, so that ties keep the smaller number
            r = np.flatnonzero(open_[:, c])
            d = squared(x[r], self.centroids[c:c + 1])
            if d.dtype != least.dtype:
                least = least.astype(object)
            closer = (d < least[r]) | ((d == least[r]) & (c < best[r]))
            best[r[closer]], least[r[closer]] = c, d[closer]
        return best, least, open_.sum(axis=1) + 1


def stored(vectors: DataFrame, dim: int, mean: np.ndarray, axes: np.ndarray, lead: int) -> DataFrame:
    """(id, v, lead, rest), written once for all rounds."""
    turn = Filter(np.zeros((1, dim), np.int64), mean, axes, lead)

    def add(batches):
        for b in batches:
            leads, rests = turn.rotated(matrix(b.column(1), dim))
            offsets = pa.array(np.arange(0, len(leads) * leads.shape[1] + 1, leads.shape[1]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.ListArray.from_arrays(offsets, pa.array(leads.ravel())), pa.array(rests)],
                names=["id", "v", "lead", "rest"])

    kind = vectors.schema["id"].dataType.simpleString()
    return written(vectors.mapInArrow(add, f"id {kind}, v array<bigint>, lead array<double>, rest double"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors with the least sha256 of ``seed:id``, in that order."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    rows = vectors.filter("id IS NOT NULL").select(hashed.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def summed(table: DataFrame, turn: Filter, dim: int) -> dict[int, tuple[int, list[int]]]:
    """Count and component sums of every cluster that has vectors, exact: a
    task adds Python integers and gives them as their upper and lower 32 bits."""
    lead, k = turn.lead, len(turn.centroids)

    def sums(batches):
        total, count = np.zeros((k, dim), object), np.zeros(k, np.int64)
        for b in batches:
            x = matrix(b.column(0), dim)
            best, _, _ = turn.nearest(x, matrix(b.column(1), lead, float), b.column(2).to_numpy())
            for c in np.unique(best):
                own = x[best == c]
                total[c] += ((own >> 32).sum(axis=0).astype(object) << 32) + (own & 0xFFFFFFFF).sum(axis=0)
                count[c] += len(own)
        found = np.flatnonzero(count)
        if len(found):
            flat = total[found].ravel().tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(found, dim), pa.int32()), pa.array(np.tile(np.arange(dim), len(found)), pa.int32()),
                 pa.array(np.repeat(count[found], dim)), pa.array([s >> 32 for s in flat], pa.int64()),
                 pa.array([s & 0xFFFFFFFF for s in flat], pa.int64())],
                names=["cluster", "place", "n", "upper", "lower"])

    parts = table.select("v", "lead", "rest").mapInArrow(sums, "cluster int, place int, n long, upper long, lower long")
    rows = parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("upper").alias("upper"),
                                                 F.sum("lower").alias("lower")).collect()
    out: dict[int, tuple[int, list[int]]] = {}
    for r in rows:
        out.setdefault(r.cluster, (r.n, [0] * dim))[1][r.place] = (r.upper << 32) + r.lower
    return out


def cluster(rows: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1,
            vec_id: str = "vec_id", embedding: str = "embedding", lead: int = LEAD) -> tuple[DataFrame, list]:
    """(vec_id, cluster, distance, verified) of all kept vectors, and the final
    centroids; ``verified`` is the number of centroids whose exact distance to the
    vector was computed."""
    vectors = kept_vectors(rows, dim, scale, vec_id, embedding)
    lead = min(lead, dim)
    centroids = first_centroids(vectors, k, seed)
    kind = vectors.schema["id"].dataType.simpleString()
    shape = f"id {kind}, cluster int, distance long, verified int"
    if not len(centroids):
        return rows.sparkSession.createDataFrame([], shape).withColumnRenamed("id", vec_id), []
    mean, axes = rotation(vectors, dim)
    table = stored(vectors, dim, mean, axes, lead)
    for _ in range(rounds):
        totals = summed(table, Filter(centroids, mean, axes, lead), dim)
        centroids = np.array([[s // totals[c][0] for s in totals[c][1]] if c in totals else old
                              for c, old in enumerate(centroids.tolist())], np.int64)
    turn = Filter(centroids, mean, axes, lead)

    def assign(batches):
        for b in batches:
            x = matrix(b.column(1), dim)
            best, least, n = turn.nearest(x, matrix(b.column(2), lead, float), b.column(3).to_numpy())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(best, pa.int32()), pa.array(np.minimum(least, LARGEST).astype(np.int64)),
                 pa.array(n, pa.int32())], names=["id", "cluster", "distance", "verified"])

    return table.mapInArrow(assign, shape).withColumnRenamed("id", vec_id), centroids.tolist()


def with_inertia(assigned: DataFrame, centroids: list) -> DataFrame:
    """Adds the summed distances and each centroid's digest (``k`` literals)."""
    if not centroids:
        return assigned.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (
            ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    sums = {r[0]: int(r[1]) for r in assigned.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(28,0)"))).collect()}

    def by_cluster(values: dict) -> Column:
        return F.create_map(*[F.lit(x) for c, v in values.items() for x in (c, v)])[F.col("cluster")]

    digest = {c: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for c, v in enumerate(centroids)}
    own = {c: min(n, LARGEST) for c, n in sums.items()} or {0: 0}
    return assigned.select("*", by_cluster(own).cast("long").alias("cluster_inertia"),
                           F.lit(min(sum(sums.values()), LARGEST)).cast("long").alias("inertia"),
                           by_cluster(digest).alias("centroid_sha256"))
