"""Approximate nearest neighbours by learned partitions.

On a bounded sample of vectors a graph of neighbours by inner product is formed and cut in halves again and again, each time at the median of the
slowest vector of a random walk on the graph, so that parts are of one size and neighbours stay together. There is a part for each PART rows or so,
from 2 ** LEVELS to 2 ** MOST_LEVELS. A small network learns from the sample's parts, and its neighbours' parts, where a vector belongs by its direction and length. Every vector is indexed in its most
probable part; a query visits as many parts as the sample says are needed for the recall asked for, and what it finds is
reranked by inner products in double precision on the original vectors. A query whose parts hold fewer than it asks for visits all the others too.

Within a part, queries and candidates meet in blocks of bounded size, so a part that holds a third of all vectors is only more
blocks. Each block gives a query its nearest few, which are merged by a window over a bounded number of rows a query.

Defined results: vectors that are null, zero, of another length than most of the sample, or holding null or non-finite components take no part; all
other rows can be found, those with a repeated or null id too; of queries with the same id one is asked, the least vector; a query finds no row
of its own id; with fewer candidates than asked for it gets all of them; ties go to the smaller id, and to a null last; an empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.common import stored

SAMPLE, LEVELS, MOST_LEVELS, PART, NEIGHBOURS, RECALL, HIDDEN, EPOCHS, BLOCK = 6000, 4, 8, 1 << 16, 20, 0.97, 96, 40, 2048


def usable(v: str) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(v).isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """Each row's k nearest others by inner product."""
    out = []
    for i in range(0, len(x), 1024):
        s = x[i : i + 1024] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out.append(np.argpartition(-s, k - 1, axis=1)[:, :k])
    return np.concatenate(out)


def halved(near: np.ndarray, rows: np.ndarray, levels: int, rng, steps: int = 60) -> np.ndarray:
    """Part numbers of rows: 2 ** levels parts of one size (to a row), cut where few neighbours are parted."""
    part = np.zeros(len(rows), np.int64)
    if levels == 0 or len(rows) < 2:
        return part
    place = np.full(len(near), -1)
    place[rows] = np.arange(len(rows))
    to = place[near[rows]]
    a, b = np.repeat(np.arange(len(rows)), to.shape[1])[to.ravel() >= 0], to.ravel()[to.ravel() >= 0]
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    degree = np.bincount(a, minlength=len(rows)) + 1e-9
    v = rng.standard_normal(len(rows))
    for _ in range(steps):
        v -= (v * degree).sum() / degree.sum()
        v = 0.5 * v + 0.5 * np.bincount(a, v[b], len(rows)) / degree
        v /= np.abs(v).max() + 1e-300
    upper = np.zeros(len(rows), bool)
    upper[np.argsort(v, kind="stable")[len(rows) // 2 :]] = True
    for side in (False, True):
        own = upper == side
        part[own] = 2 * halved(near, rows[own], levels - 1, rng, steps) + side if levels > 1 else int(side)
    return part


@dataclass
class Router:
    """A network of one hidden layer from a vector's direction and length to the log-probabilities of parts, and how many parts to visit."""

    layers: list[np.ndarray]
    visits: int
    length: float = 1.0

    def seen(self, x: np.ndarray) -> np.ndarray:
        """What the network is shown: the direction, and the length beside a usual one's."""
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return np.concatenate([x / n, np.log(n / self.length)], axis=1).astype(np.float32)

    def ranked(self, x: np.ndarray, n: int) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.argsort(-(np.maximum(self.seen(x) @ w1 + b1, 0) @ w2 + b2), axis=1, kind="stable")[:, :n]


def fit(x: np.ndarray, levels: int = LEVELS, recall: float = RECALL, k: int = NEIGHBOURS, seed: int = 3) -> Router:
    rng = np.random.default_rng(seed)
    dim, parts = x.shape[1] + 1, 2**levels
    if len(x) < 4 * parts:  # too few to learn from: one part
        return Router([np.zeros((dim, 1), np.float32), np.zeros(1, np.float32), np.zeros((1, 1), np.float32), np.zeros(1, np.float32)], 1)
    near = neighbours(x, min(k, len(x) - 1))
    router = Router([], parts, float(np.median(np.linalg.norm(x, axis=1))))
    unit = router.seen(x)
    part = halved(near, np.arange(len(x)), levels, rng)
    soft = np.zeros((len(x), parts), np.float32)
    soft[np.arange(len(x)), part] = 1
    for j in range(near.shape[1]):
        soft[np.arange(len(x)), part[near[:, j]]] += 1 / near.shape[1]
    soft /= soft.sum(axis=1, keepdims=True)
    net = [(rng.standard_normal((dim, HIDDEN)) * (2 / dim) ** 0.5).astype(np.float32), np.zeros(HIDDEN, np.float32), (rng.standard_normal((HIDDEN, parts)) * HIDDEN**-0.5).astype(np.float32), np.zeros(parts, np.float32)]
    m, v, step = [np.zeros_like(p) for p in net], [np.zeros_like(p) for p in net], 0
    for _ in range(EPOCHS):
        for i in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
            h = np.maximum(unit[i] @ net[0] + net[1], 0)
            z = h @ net[2] + net[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            g = (p / p.sum(axis=1, keepdims=True) - soft[i]) / len(i)
            gh = (g @ net[2].T) * (h > 0)
            step += 1
            for q, grad, a, b in zip(net, (unit[i].T @ gh, gh.sum(axis=0), h.T @ g, g.sum(axis=0)), m, v, strict=True):
                a += 0.1 * (grad - a)
                b += 0.001 * (grad * grad - b)
                q -= 0.005 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    router.layers = net
    ranks = router.ranked(x, parts)
    home = ranks[:, 0]
    place = np.empty_like(ranks)
    np.put_along_axis(place, ranks, np.arange(parts)[None, :], axis=1)
    needed = np.take_along_axis(place, home[near], axis=1)
    router.visits = next((n for n in range(1, parts + 1) if (needed < n).mean() >= recall), parts)
    return router


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows, each summed in the same order wherever it stands."""
    return np.einsum("ij,ij->i", q, c)


def best(queries: np.ndarray, q_ids: np.ndarray, cands: np.ndarray, c_ids: np.ndarray, c_none: np.ndarray, k: int):
    """(query, candidate, whether it has no id, score) of the k nearest of each query: a fast product finds who may be among them, the exact one decides."""
    fast = queries @ cands.T
    slack = 1e-9 * (np.linalg.norm(queries, axis=1) * np.linalg.norm(cands, axis=1).max())
    for i in range(len(queries)):
        row = np.where((c_ids == q_ids[i]) & ~c_none, -np.inf, fast[i])
        n = min(k, int(np.isfinite(row).sum()))
        if n == 0:
            continue
        edge = np.partition(row, len(row) - n)[len(row) - n]
        at = np.flatnonzero(row >= edge - slack[i])
        s = scores(np.broadcast_to(queries[i], (len(at), queries.shape[1])), cands[at])
        first = np.lexsort((c_ids[at], c_none[at], -s))[:n]
        yield q_ids[i], c_ids[at[first]], c_none[at[first]], s[first]


def search(rows: DataFrame, is_query: Callable[[Column], Column], k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = SAMPLE, levels: int | None = None, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row whose id is_query takes for one, nearest first."""
    spark = rows.sparkSession
    clean = rows.select(F.col(id_col).cast("long").alias("_id"), F.col(vec_col).cast("array<double>").alias("_v")).filter(usable("_v"))
    # The sample takes an id once, however often it is repeated.
    once = clean.filter("_id is not null").groupBy("_id").agg(F.min("_v").alias("_v")).unionByName(clean.filter("_id is null"))
    some = once.orderBy(F.when(F.col("_id").isNull(), F.xxhash64("_v")).otherwise(F.xxhash64("_id")), "_id", "_v").limit(sample).collect()
    if levels is None:
        levels = min(max(LEVELS, (clean.count() // PART).bit_length()), MOST_LEVELS)
    dim = Counter(len(r["_v"]) for r in some).most_common(1)[0][0] if some else 0
    router = fit(np.array([r["_v"] for r in some if len(r["_v"]) == dim]), levels, recall) if some else fit(np.zeros((0, 1)), levels)
    held = spark.sparkContext.broadcast(router)
    asked = clean.filter(F.size("_v") == dim).withColumn("_asked", F.coalesce(is_query(F.col("_id")), F.lit(False))).withColumn("_row", F.monotonically_increasing_id())

    def route(batches: Iterator):
        import pyarrow as pa

        router = held.value
        for b in batches:
            if b.num_rows:
                x = np.array(b.column(1).flatten()).reshape(-1, dim)
                ranks = router.ranked(x, router.visits).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(ranks), pa.list_(pa.int32()))], names=["_id", "_v", "_asked", "_row", "_parts"])

    # Settled here, as another evaluation could number rows otherwise.
    routed = stored(asked.mapInArrow(route, "_id bigint, _v array<double>, _asked boolean, _row bigint, _parts array<int>"))
    home = routed.withColumn("_part", F.get("_parts", F.lit(0)))
    # As many rows as there are parts.
    sizes = {r["_part"]: r["n"] for r in home.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    asking = routed.filter("_asked").groupBy("_id").agg(F.min(F.struct("_v", "_row", "_parts")).alias("_least")).select("_id", "_least.*")
    visits = asking.select("_id", "_v", "_row", F.explode("_parts").alias("_part"))
    found = stored(nearest_in(visits, home, sizes, 2**levels, dim, k, block))
    if router.visits < 2**levels and len(router.layers[1]) > 1:
        short = stored(asking.join(found.groupBy("query_id").count().filter(F.col("count") >= k).select(F.col("query_id").alias("_id")), "_id", "left_anti"))
        if not short.isEmpty():
            rest = short.select("_id", "_v", "_row", F.explode(F.array_except(F.sequence(F.lit(0), F.lit(2**levels - 1)), "_parts")).alias("_part"))
            found = found.unionByName(nearest_in(rest, home, sizes, 2**levels, dim, k, block))
    return ranked_few(found, k).select("query_id", "rank", "vec_id", "score")


def ranked_few(found: DataFrame, k: int) -> DataFrame:
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))).cast("int"))
    return ranked.filter(F.col("rank") <= k)


def nearest_in(visits: DataFrame, home: DataFrame, sizes: dict[int, int], parts: int, dim: int, k: int, block: int) -> DataFrame:
    """(query_id, vec_id, score): the k nearest of each query (_id, _v, _row) in the parts that it visits (_part), of the rows at home there."""
    calls = {r["_part"]: r["n"] for r in visits.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = lambda n: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in range(parts) for x in (p, max(1, -(-n.get(p, 0) // block))))), F.col("_part")), F.lit(1))
    dealt = lambda n: F.pmod(F.xxhash64("_row"), blocks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), (blocks(n) - 1).cast("int")))
    cands = home.select("_part", dealt(sizes).alias("_c"), every(calls).alias("_q"), "_id", "_v")
    asks = visits.select("_part", every(sizes).alias("_c"), dealt(calls).alias("_q"), "_id", "_v")

    def meet(queries, cands):
        import pyarrow as pa

        read = lambda t: (np.array(t.column("_v").combine_chunks().flatten()).reshape(-1, dim), t.column("_id").combine_chunks())
        if queries.num_rows and cands.num_rows:
            (q, qi), (c, ci) = read(queries), read(cands)
            found = list(best(q, qi.to_numpy(), c, ci.fill_null(0).to_numpy(), ci.is_null().to_numpy(zero_copy_only=False), k))
        else:
            found = []
        return pa.table({"query_id": pa.array([x for i, n, *_ in found for x in [i] * len(n)], pa.int64()), "vec_id": pa.array([None if none else x for _, n, z, _ in found for x, none in zip(n, z, strict=True)], pa.int64()), "score": pa.array([x for *_, s in found for x in s], pa.float64())})

    each = asks.groupBy("_part", "_c", "_q").cogroup(cands.groupBy("_part", "_c", "_q")).applyInArrow(meet, "query_id bigint, vec_id bigint, score double")
    return ranked_few(each, k).select("query_id", "vec_id", "score")
