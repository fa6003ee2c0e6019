"""Exact top-k search by inner product: ball trees, branch and bound.

Vectors are dealt to shards; a shard's ball tree is searched best node first, by the upper bound <q, c> + |q| r of
the inner product in a ball, and no node below the k-th score so far is opened. A first round searches one shard;
the k-th scores found there are the other shards' starting bounds, so shards share what is known.
Queries come in blocks, so that a task holds one shard and one block, whatever the size of either table.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a shard, queries in a block and vectors in a leaf.
SHARD, BLOCK, LEAF = 8192, 1024, 128
#: Products of lengths below which a sum of products can't leave a long, and a long's range.
EXACT, LONG = float(1 << 62), (-(1 << 63), (1 << 63) - 1)


class BallTree:
    """Over integer vectors. Nodes are kept by number: centre, radius, children or rows."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF):
        self.vectors = vectors
        real = vectors.astype(np.float64)
        centres, self.radius, self.children, self.rows = [], [], [], []
        todo = [(np.arange(len(vectors)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            node = len(centres)
            if parent >= 0:
                self.children[parent][side] = node
            points = real[rows]
            centre = points.mean(axis=0)
            away = np.sqrt(((points - centre) ** 2).sum(axis=1))
            centres.append(centre)
            self.radius.append(float(away.max()))
            if len(rows) <= leaf or not self.radius[-1]:
                self.children.append(None)
                self.rows.append(rows)
                continue
            a = points[away.argmax()]
            b = points[((points - a) ** 2).sum(axis=1).argmax()]
            order = np.argsort(points @ (a - b), kind="stable")
            self.children.append([0, 0])
            self.rows.append(None)
            todo += [(rows[order[: len(rows) // 2]], node, 0), (rows[order[len(rows) // 2 :]], node, 1)]
        self.centres, self.radius = np.array(centres), np.array(self.radius)
        self.far = np.sqrt((self.centres**2).sum(axis=1))

    def search(self, query: np.ndarray, k: int, ids: np.ndarray, own: int, floor: float) -> list[tuple[int, int]]:
        """The k best (score, -id) not below floor; ids equal to own take no part."""
        real = query.astype(np.float64)
        size = np.sqrt(float((real**2).sum()))
        bounds = self.centres @ real + size * self.radius
        # Rounding is relative to the sizes of what is multiplied, which may be far larger than the bound itself.
        bounds += 1e-12 * size * (self.far + self.radius) + 1
        best: list[tuple[int, int]] = []
        heap = [(-bounds[0], 0)]
        while heap and -heap[0][0] >= floor:
            node = heapq.heappop(heap)[1]
            if self.children[node]:
                for child in self.children[node]:
                    if bounds[child] >= floor:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            rows = self.rows[node]
            if size * (self.far[node] + self.radius[node]) < EXACT:
                scores = self.vectors[rows] @ query
            else:  # beyond a long: whole numbers of any size, held to a long's range
                scores = np.clip(self.vectors[rows].astype(object) @ query.astype(object), *LONG).astype(np.int64)
            for i in np.flatnonzero(scores >= floor):
                if (vec := int(ids[rows[i]])) != own:
                    item = (int(scores[i]), -vec)
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
            if len(best) == k:
                floor = max(floor, best[0][0])
        return best


def quantized(df: DataFrame, id_col: str, vector_col: str, scale: int = 1024) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component as a double, held to a long's range. Vectors that are null, empty
    or hold a null or non-finite component take no part, nor do rows without an id."""
    v = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(scale) * x.cast("double")))
    fit = F.forall(F.col(vector_col), lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(x.cast("double")))
    return df.select(F.col(id_col).cast("long").alias("vec_id"), F.when(fit, v).alias("v")).where("vec_id is not null and size(v) > 0")


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest integer inner products, ties to smaller vec_id.

    A query's own vec_id is no candidate of it; only vectors of its length are. Null vectors, and those that hold
    nulls or non-finite numbers, take no part. Scores are exact; one beyond a long is that long's bound. Repeated rows of candidates count
    each; repeated equal queries count once. Other columns are ignored. Empty tables give no rows.
    """
    rows = quantized(vectors, id_col, vector_col)
    asked = quantized(queries, id_col, vector_col).distinct()
    n_shards = max(1, -(-rows.count() // shard))
    n_blocks = max(1, -(-asked.count() // block))
    blocks = F.array(*[F.lit(i) for i in range(n_blocks)]) if n_blocks < 64 else F.sequence(F.lit(0), F.lit(n_blocks - 1))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_shards)).cast("int")).withColumn("block", F.explode(blocks))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int"))

    def search(key, mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        by_size: dict[int, list] = {}
        for vec, v in zip(theirs["vec_id"], theirs["v"], strict=True):
            by_size.setdefault(len(v), []).append((vec, v))
        trees = {n: (BallTree(np.array([v for _, v in x], np.int64)), np.array([i for i, _ in x], np.int64)) for n, x in by_size.items()}
        for query, v, floor in zip(mine["vec_id"], mine["v"], mine["floor"], strict=True):
            if len(v) in trees:
                tree, ids = trees[len(v)]
                q = np.array(v, np.int64)
                found = tree.search(q, k, ids, int(query), -np.inf if pd.isna(floor) else float(floor))
                out += [(int(query), v, -vec, score) for score, vec in found]
        return pd.DataFrame(out, columns=["query_id", "q", "vec_id", "score"])

    kind = "query_id long, q array<long>, vec_id long, score long"

    def searched(some: DataFrame, there: DataFrame) -> DataFrame:
        return some.groupBy("shard", "block").cogroup(there.groupBy("shard", "block")).applyInPandas(search, kind)

    none = F.lit(None).cast("long").alias("floor")
    found = searched(asked.select("vec_id", "v", "block", F.lit(0).alias("shard"), none), dealt.where("shard = 0"))
    if n_shards > 1:
        from strata.llm.common import checkpointed

        found = checkpointed(found)
        floors = found.groupBy("query_id", "q").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
        rest = asked.join(floors, (F.col("vec_id") == F.col("query_id")) & (F.col("v") == F.col("q")), "left")
        rest = rest.select("vec_id", "v", "block", F.explode(F.sequence(F.lit(1), F.lit(n_shards - 1))).alias("shard"), "floor")
        found = found.unionByName(searched(rest, dealt.where("shard > 0")))
    best = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
