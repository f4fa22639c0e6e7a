"""Exact top-k search by a Voronoi kNN join.

Data are grouped into the Voronoi cells of a few pivots, queries into the cells
of fewer. A vector x of cell j at distance d from its pivot p has an inner
product with q of at most q.p + |q| d. A lower bound of each query's k-th score
comes from the cells' summaries (distinct ids and radii) and from a bounded probe set,
so a query group needs from cell j only the vectors with

    d >= min over its queries of (bound - q.p) / |q|

and only these are sent to it. A group's data are dealt out to blocks of about
``BLOCK`` rows and its queries to chunks of about ``CHUNK``, each pair of which
is solved by itself; the partial results are merged by rank. What reaches the
driver is bounded by the number of pivots and by the probe set.

Vectors are integer: floor(scale * x), x as double. Vectors that are null, hold
a null or non-finite component or have a null id take no part. Shorter vectors
are padded with zeros. A repeated id counts once, with its best score, and is
no candidate of its own query; a query id that is repeated with several vectors
takes the best score of any of them. Empty tables give an empty result; scores
beyond a long are cut off at its limits. Further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

SAMPLE = 2048       # vectors of the probe set, from which the pivots are taken
PIVOTS = 48
GROUPS = 4          # query groups at least
CHUNK = 4096        # queries solved against one block
BLOCK = 16384       # data rows solved at once
EXACT = 2.0 ** 53


def integer_vectors(rows: DataFrame, scale: int, vec_id: str = "vec_id",
                    embedding: str = "embedding") -> DataFrame:
    """(id, v): the integer vectors that take part."""
    x = F.transform(F.col(embedding), lambda c: c.cast("double"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return (rows.select(F.col(vec_id).alias("id"), x.alias("x"))
            .filter(F.col("id").isNotNull() & F.col("x").isNotNull()).filter(~bad)
            .select("id", F.transform("x", lambda c: F.floor(c * scale)).alias("v")))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """(rows, dim) of a list column, padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(size) and (size == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(size), dim), np.int64)
    out[np.arange(dim) < size[:, None]] = flat
    return out


def inner(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products, cut off at the limits of a long."""
    most = [float(np.abs(a.astype(float)).max(initial=0)) for a in (q, x)]
    if most[0] * most[1] * max(q.shape[1], 1) < EXACT:
        return (q.astype(float) @ x.T.astype(float)).astype(np.int64)
    whole = q.astype(object) @ x.T.astype(object)
    return np.clip(whole, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def spread_out(sample: np.ndarray, n: int) -> np.ndarray:
    """Pivots: each the sample vector farthest from those chosen before."""
    x = sample.astype(float)
    chosen, far = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(x)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d = (x.astype(float) ** 2).sum(1)[:, None] + (pivots ** 2).sum(1) - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(d, 0))


class Plan:
    """Pivots, probe set and cell summaries: all of bounded size."""

    def __init__(self, sample_ids, sample, k):
        self.k, self.dim = k, sample.shape[1]
        self.ids, self.sample = np.asarray(sample_ids), sample
        self.pivots = spread_out(sample, PIVOTS)
        self.count = np.zeros(len(self.pivots))
        self.radius = np.zeros(len(self.pivots))

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = distances(x, self.pivots)
        cell = d.argmin(axis=1)
        return cell, d[np.arange(len(x)), cell]

    def groups(self, q: np.ndarray, n: int) -> np.ndarray:
        return distances(q, self.pivots[:n]).argmin(axis=1)

    def bounds(self, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Lower bound of each query's k-th score."""
        norm = np.sqrt((q.astype(float) ** 2).sum(axis=1))
        low = q @ self.pivots.T - norm[:, None] * self.radius
        order = np.argsort(-low, axis=1)
        have = np.cumsum(self.count[order], axis=1) >= self.k + 1   # one id may be the query's own
        at = have.argmax(axis=1)
        rows = np.arange(len(q))
        best = np.where(have.any(axis=1), low[rows, order[rows, at]], -np.inf)
        # the margin covers rounding: a looser bound is still a bound
        best -= 1e-9 * (1 + np.abs(np.where(np.isfinite(best), best, 0)))
        if len(np.unique(self.ids)) == len(self.ids) > self.k:
            s = inner(q, self.sample).astype(float)
            s[ids[:, None] == self.ids] = -np.inf
            best = np.maximum(best, np.partition(s, -self.k, axis=1)[:, -self.k])
        return best

    def needed(self, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
        """(queries, cells): least pivot distance of vectors that matter."""
        bound, dot = self.bounds(ids, q), q @ self.pivots.T
        norm = np.sqrt((q.astype(float) ** 2).sum(axis=1))[:, None]
        short = bound[:, None] - dot
        short -= 1e-9 * (1 + np.abs(dot) + np.abs(np.where(np.isfinite(bound), bound, 0))[:, None])
        return np.where(norm > 0, short / np.where(norm > 0, norm, 1),
                        np.where(short <= 0, -np.inf, np.inf))


def top_k(data: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` largest inner products
    of every query with data of another id, ties to the smaller id.

    ``data`` and ``queries`` have the columns (id, v) of integer_vectors.
    """
    spark, out = data.sparkSession, "query_id long, vec_id long, score long"
    dim = data.agg(F.max(F.size("v"))).first()[0]
    first = data.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()      # the probe set
    nq = queries.count()
    if not len(first) or not nq:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = max(dim, queries.agg(F.max(F.size("v"))).first()[0])
    sample = np.zeros((len(first), dim), np.int64)
    for i, v in enumerate(first["v"]):
        sample[i, :len(v)] = v
    plan = Plan(first["id"].to_numpy(), sample, k)
    n_groups = min(max(GROUPS, -(-nq // CHUNK)), len(plan.pivots))
    cells = range(len(plan.pivots))

    def assign(batches):
        for b in batches:
            cell, d = plan.cells(matrix(b.column(1), dim))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cell.astype(np.int64)), pa.array(d)],
                                             names=["id", "cell", "d"])

    # an id counts once, by its row that is nearest to a pivot
    kind = data.schema["id"].dataType.simpleString()
    summary = (data.select("id", "v").mapInArrow(assign, f"id {kind}, cell long, d double")
               .groupBy("id").agg(F.min_by("cell", "d").alias("cell"), F.min("d").alias("d"))
               .groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("r")).collect())
    for s in summary:                                                          # one row for each pivot
        plan.count[s.cell], plan.radius[s.cell] = s.n, s.r

    def need(batches):
        for b in batches:
            q = matrix(b.column(1), dim)
            g, least = plan.groups(q, n_groups), plan.needed(b.column(0).to_numpy(), q)
            for i in np.unique(g):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * len(cells), pa.int64()), pa.array(cells, pa.int64()),
                     pa.array(least[g == i].min(axis=0)),
                     pa.array([int((g == i).sum())] * len(cells), pa.int64())],
                    names=["grp", "cell", "least", "n"])

    needs = (queries.mapInArrow(need, "grp long, cell long, least double, n long")
             .groupBy("grp", "cell").agg(F.min("least").alias("least"), F.sum("n").alias("n")).collect())
    least = np.full((n_groups, len(cells)), np.inf)                            # pivots by groups
    members = np.zeros(n_groups, np.int64)
    for r in needs:
        least[r.grp, r.cell], members[r.grp] = r.least, r.n

    def wanted(x):
        cell, d = plan.cells(x)
        return d[:, None] * (1 + 1e-9) + 1e-9 >= least[:, cell].T              # (rows, groups)

    def count(batches):
        n = np.zeros(n_groups, np.int64)
        for b in batches:
            n += wanted(matrix(b.column(0), dim)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(n_groups), pa.int64()), pa.array(n)],
                                         names=["grp", "n"])

    sent = np.zeros(n_groups, np.int64)
    for r in data.select("v").mapInArrow(count, "grp long, n long").groupBy("grp").agg(
            F.sum("n").alias("n")).collect():
        sent[r.grp] = r.n
    blocks, chunks = np.maximum(-(-sent // BLOCK), 1), np.maximum(-(-members // CHUNK), 1)

    def deal(batches, side):
        """Rows with every (group, block, chunk) that needs them, in turn."""
        turn = np.zeros(n_groups, np.int64)
        for b in batches:
            x = matrix(b.column(1), dim)
            rows, keys = [], []
            to = wanted(x) if side == "data" else plan.groups(x, n_groups)[:, None] == range(n_groups)
            for g in range(n_groups):
                at = np.flatnonzero(to[:, g])
                if not len(at):
                    continue
                spread = (turn[g] + np.arange(len(at)))
                turn[g] += len(at)
                mine, other = (blocks, chunks) if side == "data" else (chunks, blocks)
                own = np.repeat(spread % mine[g], other[g])
                each = np.tile(np.arange(other[g]), len(at))
                rows.append(np.repeat(at, other[g]))
                blk, chk = (own, each) if side == "data" else (each, own)
                keys.append(np.stack([np.full(len(own), g), blk, chk]))
            if not rows:
                continue
            got = b.take(pa.array(np.concatenate(rows)))
            key = np.concatenate(keys, axis=1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*map(pa.array, key), *got.columns],
                                             names=["grp", "blk", "chk", "id", "v"])

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        x, ids = matrix(left.column("v"), dim), left.column("id").to_numpy()
        q, qid = matrix(right.column("v"), dim), right.column("id").to_numpy()
        found = [np.zeros((3, 0), np.int64)]
        step = max((1 << 22) // max(len(x), 1), 1)
        for at in range(0, len(q) if len(x) else 0, step):
            part, own = q[at:at + step], qid[at:at + step]
            s = inner(part, x)
            ok = own[:, None] != ids
            floor = np.clip(plan.bounds(own, part), -(2.0 ** 63), 2.0 ** 63)[:, None]
            ok &= s >= floor
            for i in range(len(part)):
                c = np.flatnonzero(ok[i])
                order = c[np.lexsort((ids[c], -s[i, c]))]
                # a repeated id counts once, with its best score
                once = np.sort(np.unique(ids[order], return_index=True)[1])[:k]
                pick = order[once]
                found.append(np.stack([np.full(len(pick), own[i]), ids[pick], s[i, pick]]))
        got = np.concatenate(found, axis=1)
        return pa.table([pa.array(c) for c in got], names=["query_id", "vec_id", "score"])

    schema = f"grp long, blk long, chk long, id long, v array<{data.schema['v'].dataType.elementType.simpleString()}>"
    d = data.mapInArrow(lambda b: deal(b, "data"), schema).groupBy("grp", "blk", "chk")
    q = queries.mapInArrow(lambda b: deal(b, "queries"), schema).groupBy("grp", "blk", "chk")
    partial = d.cogroup(q).applyInArrow(solve, out)
    # both steps share one shuffle by query
    best = partial.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (best.withColumn("rank", rank).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def search(rows: DataFrame, is_query: Column, k: int, scale: int) -> DataFrame:
    """top_k of the rows with ``is_query`` (on ``vec_id``) against all rows."""
    data = integer_vectors(rows, scale)
    return top_k(data, integer_vectors(rows.filter(is_query), scale), k)
