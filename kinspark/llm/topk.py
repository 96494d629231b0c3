"""Exact top-k inner products by ball-tree branch and bound, shard by shard.

Vectors are brought to integers, so scores are exact. Every shard of the candidates builds a ball tree. For a query q, no
vector in a ball with centre c and radius r scores more than q.c + |q| r: balls are visited in the order of that bound
and the search ends where it falls below the kth score so far. That score is shared: a first pass over a few vectors
of every shard gives each query a kth score that all shards start from, and a task's trees hand theirs on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import stored

LEAF = 64
QUERY_BYTES = 16 << 20  # vectors of queries that are broadcast at once; more are searched in further passes
SEARCHED = 4096  # queries whose bounds a task holds at a time
SHARD_ROWS = 20_000  # vectors that make up one tree at most
LONG = 2**63 - 1


class BallTree:
    """Balls over the rows of x: split at the median of the direction of greatest spread until LEAF rows are left."""

    def __init__(self, x: np.ndarray):
        self.order = np.arange(len(x))
        self.bounds: list[tuple[int, int]] = []
        self.children: list[tuple[int, int]] = []
        todo = [(0, len(x), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            node = len(self.bounds)
            self.bounds.append((a, b))
            self.children.append((-1, -1))
            if parent >= 0:
                left, right = self.children[parent]
                self.children[parent] = (node, right) if side == 0 else (left, node)
            if b - a > LEAF:
                rows = x[self.order[a:b]]
                axis = int(np.argmax(rows.max(0) - rows.min(0)))
                self.order[a:b] = self.order[a:b][np.argsort(rows[:, axis], kind="stable")]
                mid = (a + b) // 2
                todo += [(a, mid, node, 0), (mid, b, node, 1)]
        self.x = x[self.order]
        self.centres = np.stack([self.x[a:b].mean(0) for a, b in self.bounds])
        self.radii = np.array([np.sqrt(((self.x[a:b] - c) ** 2).sum(1).max()) for (a, b), c in zip(self.bounds, self.centres, strict=True)])
        self.leaves = np.array([i for i, (left, _) in enumerate(self.children) if left < 0])

    def bound(self, q: np.ndarray, nodes: list[int]) -> np.ndarray:
        """Upper bounds of inner products, queries by nodes; a little above the exact bound, so rounding loses nothing."""
        exact = q @ self.centres[nodes].T + np.sqrt((q * q).sum(1))[:, None] * self.radii[nodes][None]
        return exact + 1e-6 * np.abs(exact) + 1e-3


def _products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows of x and q, those beyond a long as the greatest or least long. Doubles are exact while
    no sum can pass 2**53; otherwise Python's integers are used."""
    if not len(x) or np.abs(x).max() * np.abs(q).sum() < 2.0**53:
        return (x @ q).astype(np.int64)
    own = [int(c) for c in q]
    return np.array([max(-LONG, min(LONG, sum(int(a) * b for a, b in zip(row, own, strict=True)))) for row in x.tolist()], np.int64)


def _search(tree: BallTree, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, floor: np.ndarray):
    """The k best (score, id) of each query in this tree that are not below floor, ties to the smaller id; floor rises to each kth
    score found. Branch and bound: from the root, bounds are taken of children of nodes whose own bound reaches the kth score;
    leaves are then read from the best bound on."""
    n = len(queries)
    ids = ids[tree.order]
    out_query, out_id, out_score = [], [], []
    alive = np.full((n, len(tree.bounds)), -np.inf)
    alive[:, 0] = tree.bound(queries, [0])[:, 0]
    for node, (left, right) in enumerate(tree.children):
        open_ = np.flatnonzero(alive[:, node] >= floor) if left >= 0 else []
        if len(open_):
            alive[np.ix_(open_, [left, right])] = tree.bound(queries[open_], [left, right])
    for q in range(n):
        leaves = tree.leaves[alive[q, tree.leaves] >= floor[q]]
        leaves = leaves[np.argsort(-alive[q, leaves], kind="stable")]
        kth, scores, found = floor[q], np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, step = 0, 1
        while at < len(leaves) and alive[q, leaves[at]] >= kth:
            some = leaves[at : at + step]
            some = some[alive[q, some] >= kth]
            at, step = at + step, min(step * 2, 32)
            rows = np.concatenate([np.arange(*tree.bounds[i]) for i in some])
            got = _products(tree.x[rows], queries[q])
            keep = (got >= kth) & (ids[rows] != query_ids[q])
            scores, found = np.concatenate([scores, got[keep]]), np.concatenate([found, ids[rows][keep]])
            if len(scores) > k:
                best = np.lexsort((found, -scores))[:k]
                scores, found = scores[best], found[best]
            if len(scores) == k:
                kth = max(kth, scores.min())
        floor[q] = kth
        out_query.append(np.full(len(found), query_ids[q]))
        out_id.append(found)
        out_score.append(scores)
    return np.concatenate(out_query), np.concatenate(out_id), np.concatenate(out_score)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in column]) if len(column) else np.zeros((0, 1))


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by every, the k other rows with the greatest integer inner
    product of floor(scale * x), ties to the smaller id.

    Rows with a null id, a null or empty vector, or one with null or non-finite components take no part. A query meets only vectors of
    its own length. Scaled components and scores beyond a long count as the greatest or least long. Of rows that repeat an id, each is a candidate (not for its own id) and
    one, the smallest, is the query. Other columns are ignored. Without queries or candidates the result is empty.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"), F.col(embedding).alias("e"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    v = v.where(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & (F.size("e") > 0) & ~F.exists("e", bad)).select("vec_id", "v")
    v = stored(v, "topk-vectors")
    queries = stored(v.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")), "topk-queries")
    size = queries.agg(F.sum(8 * (F.size("v") + 1))).first()[0]
    if size is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    passes = max(1, math.ceil(size / QUERY_BYTES))
    shards = max(1, math.ceil(v.count() / SHARD_ROWS))
    shards = max(shards, min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(v.count() / 1000)))
    dealt = stored(v.repartition(shards), "topk-shards")
    out = None
    for i in range(passes):
        block = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == i).toPandas().sort_values("vec_id")
        if not len(block):
            continue
        q = spark.sparkContext.broadcast({n: (part["vec_id"].to_numpy(np.int64), _matrix(part["v"])) for n, part in block.groupby(block["v"].map(len))})

        def scan(batches: Iterator[pd.DataFrame], q=q, sample: int = 0, floors=None) -> Iterator[pd.DataFrame]:
            floor = {n: np.array([(floors.value if floors else {}).get(i, -LONG - 1) for i in ids.tolist()], np.int64) for n, (ids, _) in q.value.items()}
            for every in _trees(batches, sample):
                for n, pdf in every.groupby(every["v"].map(len)):
                    if n not in q.value:
                        continue
                    query_ids, m = q.value[n]
                    tree, ids = BallTree(_matrix(pdf["v"])), pdf["vec_id"].to_numpy(np.int64)
                    for at in range(0, len(m), SEARCHED):
                        some = slice(at, at + SEARCHED)
                        a, b, s = _search(tree, ids, m[some], query_ids[some], k, floor[n][some])
                        yield pd.DataFrame({"query_id": a, "vec_id": b, "score": s})

        kind = "query_id long, vec_id long, score long"
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        probe = dealt.mapInPandas(lambda it, scan=scan: scan(it, sample=max(1, 2000 // shards)), kind)
        kth = probe.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("query_id", "score").toPandas()
        floors = spark.sparkContext.broadcast(dict(zip(kth["query_id"].tolist(), kth["score"].tolist(), strict=True)))
        found = dealt.mapInPandas(lambda it, scan=scan, floors=floors: scan(it, floors=floors), kind)
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        best = best if passes == 1 else stored(best, "topk-found")
        out = best if out is None else out.unionByName(best)
    return out


def _trees(batches: Iterator[pd.DataFrame], sample: int) -> Iterator[pd.DataFrame]:
    """Batches joined to trees of SHARD_ROWS rows at most; with sample, so many rows of each batch alone."""
    held, n = [], 0
    for pdf in batches:
        if sample:
            yield pdf.iloc[:: max(1, len(pdf) // sample)]
            continue
        for at in range(0, len(pdf), SHARD_ROWS):
            part = pdf.iloc[at : at + SHARD_ROWS]
            if n + len(part) > SHARD_ROWS:
                yield pd.concat(held)
                held, n = [], 0
            held.append(part)
            n += len(part)
    if n:
        yield pd.concat(held)
