"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

The tree is fitted on a bounded sample; every vector is then dealt to the leaf that a descent by
nearest centroids reaches. A query walks the tree with a priority queue of nodes ordered by the
distance to their centroids and visits the leaves it takes from the queue. How many it visits is
calibrated: on sampled queries with known neighbours, visits widen until the target recall is
reached; a query whose leaves hold too few vectors goes on until they hold enough. Leaves are dealt
to groups of about BLOCK vectors, and a leaf of more is split into blocks, so one task sees one
block of vectors and the queries that visit its leaves, CHUNK of them at most; vectors are copied
only where more queries than that visit one block. Each task keeps its nearest per query.

The tree has as many leaves as its sample allows, so beyond some 10 million vectors leaves grow with
the table, and the sample has to grow with it (a parameter) to keep the work in proportion.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.common import materialize, sliced_udf

#: Vectors that the tree is fitted on at most; the sample is brought to the driver.
SAMPLE = 20_000
BRANCHES = 8
#: Sampled vectors of a leaf at most.
LEAF = 64
ROUNDS = 8
CALIBRATION_QUERIES = 256
TARGET_RECALL = 0.97
#: Visits beyond the calibrated number, as a factor.
MARGIN = 1.15
#: Vectors of a block and queries of a chunk, about.
BLOCK, CHUNK = 8192, 32768
#: Groups that leaves are dealt to at least; each gives one list of nearest a query.
GROUPS = 24


@dataclass
class Tree:
    """Centroid, first child and number of children (0: a leaf) of each node, breadth first."""

    centroids: np.ndarray
    first: np.ndarray
    count: np.ndarray

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf that each vector descends to."""
        at = np.zeros(len(vectors), dtype=np.int64)
        moving = np.arange(len(vectors)) if self.count[0] else np.zeros(0, np.int64)
        while len(moving):
            for node in np.unique(at[moving]):
                mine = moving[at[moving] == node]
                a, n = self.first[node], self.count[node]
                at[mine] = a + _distances(vectors[mine], self.centroids[a : a + n]).argmin(axis=1)
            moving = moving[self.count[at[moving]] > 0]
        return at

    def best_bins(self, query: np.ndarray, visits: int, enough: int = 0, held: dict[int, int] | None = None) -> list[int]:
        """The first `visits` leaves that the priority queue yields, and more until they hold `enough` vectors."""
        queue, found, seen = [(0.0, 0)], [], 0
        while queue and (len(found) < visits or seen < enough):
            _, node = heapq.heappop(queue)
            if not self.count[node]:
                found.append(node)
                seen += (held or {}).get(node, 0)
                continue
            a, n = int(self.first[node]), int(self.count[node])
            away = ((self.centroids[a : a + n] - query) ** 2).sum(axis=1)
            for k, d in enumerate(away.tolist()):
                heapq.heappush(queue, (d, a + k))
        return found


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, fast; not exact to the last bits."""
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T


def _kmeans(points: np.ndarray, k: int, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    centers = points[random.choice(len(points), size=min(k, len(points)), replace=False)]
    for _ in range(ROUNDS):
        owner = _distances(points, centers).argmin(axis=1)
        centers = np.array([points[owner == j].mean(axis=0) for j in range(len(centers)) if (owner == j).any()])
    return centers, _distances(points, centers).argmin(axis=1)


def fit_tree(points: np.ndarray, branches: int = BRANCHES, leaf: int = LEAF, seed: int = 7) -> Tree:
    random = np.random.default_rng(seed)
    centroids, first, count = [points.mean(axis=0)], [0], [0]
    waiting = [(0, points)]
    while waiting:
        node, mine = waiting.pop(0)
        if len(mine) <= leaf:
            continue
        centers, owner = _kmeans(mine, branches, random)
        if len(np.unique(owner)) < 2:
            continue  # equal vectors: blocks split such a leaf
        first[node], count[node] = len(centroids), len(centers)
        for j, center in enumerate(centers):
            waiting.append((len(centroids), mine[owner == j]))
            centroids.append(center)
            first.append(0)
            count.append(0)
    return Tree(np.array(centroids), np.array(first), np.array(count))


def calibrate(tree: Tree, points: np.ndarray, k: int, target: float = TARGET_RECALL, queries: int = CALIBRATION_QUERIES) -> int:
    """The least number of leaf visits with the target recall at k on sampled queries."""
    total = int((tree.count == 0).sum())
    leaf_of, ranks = tree.leaves(points), []
    for q in np.linspace(0, len(points) - 1, min(queries, len(points))).astype(int):
        away = ((points - points[q]) ** 2).sum(axis=1)
        away[q] = np.inf
        near = np.argsort(away, kind="stable")[: min(k, len(points) - 1)]
        place = {leaf: r for r, leaf in enumerate(tree.best_bins(points[q], total))}
        ranks += [place[x] for x in leaf_of[near].tolist()]
    if not ranks:
        return total
    needed = int(np.sort(ranks)[max(0, math.ceil(target * len(ranks)) - 1)]) + 1
    return min(total, math.ceil(needed * MARGIN) + 1)


def usable(vector: Column) -> Column:
    """Neither null, empty nor zero, and all components finite."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(len(flat), -1)


def _nearest(k: int):
    """Nearest k of a block for each query of a chunk, over the leaves that the query visits."""

    def search(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out_q, out_v, out_d = [], [], []
        if queries.num_rows and vectors.num_rows:
            ids, leaves = np.asarray(vectors["vec_id"]), np.asarray(vectors["leaf"])
            points, wanted = _matrix(vectors["vector"]), _matrix(queries["vector"])
            names, visits = queries["query_id"].to_pylist(), queries["visits"].to_pylist()
            repeated = len(np.unique(ids)) < len(ids)
            rows_of = {leaf: np.flatnonzero(leaves == leaf) for leaf in np.unique(leaves).tolist()}
            for name, query, seen in zip(names, wanted, visits):
                mine = [rows_of[x] for x in seen if x in rows_of]
                if not mine:
                    continue
                rows = np.concatenate(mine)
                rows = rows[ids[rows] != name]
                if not len(rows):
                    continue
                away = np.sqrt(((points[rows] - query) ** 2).sum(axis=1))
                if repeated:
                    order = np.lexsort((away, ids[rows]))
                    order = order[np.concatenate([[True], np.diff(ids[rows[order]]) != 0])]
                    rows, away = rows[order], away[order]
                if len(rows) > k:
                    keep = np.flatnonzero(away <= np.partition(away, k - 1)[k - 1])
                    rows, away = rows[keep], away[keep]
                best = np.lexsort((ids[rows], away))[:k]
                out_q += [name] * len(best)
                out_v += ids[rows[best]].tolist()
                out_d += away[best].tolist()
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "score": pa.array(out_d, pa.float64())})

    return search


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", target: float = TARGET_RECALL, sample_size: int = SAMPLE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance in double precision); ties to the smaller vec_id.

    Queries are the usable rows for which `is_query` holds; candidates are all usable rows but those
    of the query's own key. Null, empty and zero vectors, vectors with null or non-finite components
    and rows with a null key take no part. Shorter vectors count as if zeros followed. Rows that
    share a key are one candidate, at its nearest vector, and one query, with its smallest vector.
    Each query has k results, or all candidates if there are fewer.
    """
    spark = vectors.sparkSession
    doubles = F.transform(F.col(vector), lambda x: x.cast("double"))
    every = vectors.filter(F.col(key).isNotNull() & usable(F.col(vector))).select(F.col(key).cast("long").alias("vec_id"), doubles.alias("vector"), is_query.alias("_query"))
    width = every.agg(F.max(F.size("vector"))).first()[0]
    result = "query_id long, rank int, vec_id long, score double"
    if not width:
        return spark.createDataFrame([], result)
    every = every.withColumn("vector", F.concat("vector", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("vector"))))
    sample = every.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_size).select("vector").toArrow()["vector"]
    points = _matrix(sample)
    tree = fit_tree(points)
    visits = calibrate(tree, points, k, target)
    leaf_of = sliced_udf(lambda column: pa.array(tree.leaves(_matrix(column))), T.LongType())
    placed = materialize(every.withColumn("leaf", leaf_of("vector")), "ann-placed")
    # Two numbers a leaf, as many as the tree has; keys that repeat in a leaf count once.
    counts = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("vec_id").alias("keys")).collect()
    held = {r["leaf"]: r["keys"] for r in counts}
    # So many other keys make k results certain: a key may lie in several leaves.
    enough = k + 1 + sum(held.values()) - placed.agg(F.count_distinct("vec_id")).first()[0]
    groups = min(len(counts), max(GROUPS, math.ceil(sum(r["n"] for r in counts) / BLOCK)))
    group_of = {leaf: g % groups for g, leaf in enumerate(sorted(held))}
    sizes = [0] * groups
    for r in counts:
        sizes[group_of[r["leaf"]]] += r["n"]
    blocks = F.element_at(F.lit([max(1, math.ceil(n / BLOCK)) for n in sizes]), F.col("_group") + 1)

    def visited(column: pa.Array) -> pa.Array:
        """For each query a list of its groups with the leaves to visit in each."""
        out = []
        for query in _matrix(column):
            by_group: dict[int, list[int]] = {}
            for leaf in tree.best_bins(query, visits, enough, held):
                if leaf in group_of:
                    by_group.setdefault(group_of[leaf], []).append(leaf)
            out.append([{"_group": g, "visits": leaves} for g, leaves in by_group.items()])
        return pa.array(out, pa.list_(pa.struct([("_group", pa.int32()), ("visits", pa.list_(pa.int64()))])))

    bins = sliced_udf(visited, T.ArrayType(T.StructType([T.StructField("_group", T.IntegerType()), T.StructField("visits", T.ArrayType(T.LongType()))])))
    queries = placed.filter("_query").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vector").alias("vector"))
    asked = materialize(queries.withColumn("_bins", bins("vector")).select("query_id", "vector", F.inline("_bins")), "ann-queries")
    # One number a group: how often its blocks are asked.
    chunks = {r["_group"]: math.ceil(r["n"] / CHUNK) for r in asked.groupBy("_group").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_chunks = F.element_at(F.lit([chunks.get(g, 0) for g in range(groups)]), F.col("_group") + 1)
    group = F.element_at(F.create_map(*[F.lit(x) for pair in group_of.items() for x in pair]), F.col("leaf"))
    right = (
        placed.withColumn("_group", group)
        .withColumn("_block", F.pmod(F.xxhash64("vec_id"), blocks).cast("int"))
        .withColumn("_chunk", F.explode(F.slice(F.sequence(F.lit(0), n_chunks), F.lit(1), n_chunks)))
        .select("_group", "_block", "_chunk", "vec_id", "leaf", "vector")
    )
    left = (
        asked.withColumn("_block", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("_chunk", F.pmod(F.xxhash64("query_id"), n_chunks).cast("int"))
        .select("_group", "_block", "_chunk", "query_id", "vector", "visits")
    )
    keys = ["_group", "_block", "_chunk"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_nearest(k), "query_id long, vec_id long, score double")
    by_query = found.repartition("query_id")
    once = Window.partitionBy("query_id", "vec_id").orderBy("score")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    distinct = by_query.withColumn("_at", F.row_number().over(once)).filter("_at = 1")
    return distinct.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
