"""Centroid clustering (Lloyd's rounds) in exact integers, with a vantage-point tree over the centroids.

Each round the driver builds a vantage-point tree over the current centroids, as many as the
parameter says, and broadcasts it. Tasks search it for each vector: nodes wait in the order of the
least distance that anything below them can have, and a node is entered as long as that is not above
the best distance found, equality included. A batch of vectors takes its steps side by side: in one
step every vector enters its own best node, so the search is each vector's own while the arithmetic
is done on arrays. Distances to centroids are squared and exact in 64-bit integers; square roots
only bound what can be left out, with a margin for their rounding. Equal distances go to the smaller
number.

Each task returns one sum of its vectors for each cluster; sums are added per cluster and component,
so the driver gets one number a component.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.common import materialize, packed

CLUSTERS, ROUNDS, SEED = 8, 10, 3
COMPONENTS = 64
SCALE = 1024
#: Components are held to this size: squared distances of 64 of them fit in 64 bits.
LARGEST = 1 << 26
#: Centroids of a leaf at most.
LEAF = 2
#: Part of a bound that the rounding of square roots could cost, well above what it does.
SLACK = 1e-9
#: Vectors that take their steps side by side.
SIDE_BY_SIDE = 8192


@dataclass
class VantageTree:
    """Nodes in the order they were made. An inner node has a vantage point, the radius that parts the rest and two children; a leaf has centroids."""

    centroids: np.ndarray
    vantage: list[int] = field(default_factory=list)
    radius: list[float] = field(default_factory=list)
    children: list[tuple[int, int]] = field(default_factory=list)
    leaf: list[list[int]] = field(default_factory=list)

    def __post_init__(self):
        self._grow(list(range(len(self.centroids))))

    def _grow(self, members: list[int]) -> int:
        me = len(self.vantage)
        self.vantage.append(-1)
        self.radius.append(0.0)
        self.children.append((-1, -1))
        self.leaf.append(members)
        if len(members) > LEAF:
            first, rest = members[0], np.array(members[1:])
            away = np.sqrt(squared(self.centroids[rest], self.centroids[first][None, :]).astype(np.float64))
            radius = float(np.sort(away)[(len(rest) - 1) // 2])
            inner, outer = rest[away <= radius].tolist(), rest[away > radius].tolist()
            self.vantage[me], self.radius[me], self.leaf[me] = first, radius, []
            self.children[me] = (self._grow(inner), self._grow(outer) if outer else -1)
        return me

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the nearest centroid of each vector, and the squared distance."""
        n, nodes = len(points), len(self.vantage)
        owner, best = np.full(n, -1, dtype=np.int64), np.full(n, np.iinfo(np.int64).max)
        bound = np.full((n, nodes), np.inf)  # of waiting nodes; infinite: not waiting
        bound[:, 0] = 0.0
        active = np.arange(n)

        def meet(rows: np.ndarray, centroid: int) -> np.ndarray:
            """Hold the vectors against one centroid."""
            away = squared(points[rows], self.centroids[centroid][None, :])
            nearer = (away < best[rows]) | ((away == best[rows]) & (centroid < owner[rows]))
            best[rows[nearer]], owner[rows[nearer]] = away[nearer], centroid
            return away

        while len(active):
            nearest_node = bound[active].argmin(axis=1)
            least = bound[active, nearest_node]
            # A bound that equals the best distance can still hide a tie of a smaller number.
            going = (least < np.inf) & (least <= np.sqrt(best[active].astype(np.float64)) * (1 + SLACK) + SLACK)
            active, nearest_node, least = active[going], nearest_node[going], least[going]
            bound[active, nearest_node] = np.inf
            for node in np.unique(nearest_node).tolist():
                rows, floor = active[nearest_node == node], least[nearest_node == node]
                for centroid in self.leaf[node]:
                    meet(rows, centroid)
                if self.vantage[node] >= 0:
                    away, radius = np.sqrt(meet(rows, self.vantage[node]).astype(np.float64)), self.radius[node]
                    margin = SLACK * (away + radius + 1)
                    inner, outer = self.children[node]
                    bound[rows, inner] = np.maximum(floor, away - radius - margin)
                    if outer >= 0:
                        bound[rows, outer] = np.maximum(floor, radius - away - margin)
        return owner, best


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    away = a - b
    return np.einsum("ij,ij->i", away, away)


def _points(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.int64).reshape(len(column), -1)


def _assigned(tree):
    """Columns of the batch, then cluster and distance."""

    def run(batches):
        search = tree.value
        for batch in batches:
            for at in range(0, batch.num_rows, SIDE_BY_SIDE):
                some = batch.slice(at, SIDE_BY_SIDE)
                owner, away = search.nearest(_points(some.column("point")))
                kept = [k for k in some.schema.names if k != "point"]
                yield pa.RecordBatch.from_arrays([*[some.column(k) for k in kept], pa.array(owner, pa.int32()), pa.array(away)], names=[*kept, "cluster", "distance"])

    return run


def _summed(tree):
    """For each cluster of a task the number of its vectors and their sum."""

    def run(batches):
        search = tree.value
        k, width = search.centroids.shape
        count, total = np.zeros(k, dtype=np.int64), np.zeros((k, width), dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, SIDE_BY_SIDE):
                points = _points(batch.column("point").slice(at, SIDE_BY_SIDE))
                owner, _ = search.nearest(points)
                count += np.bincount(owner, minlength=k)
                np.add.at(total, owner, points)
        used = np.flatnonzero(count)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(count[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    return run


def integers(vector: Column) -> Column:
    """floor(1024 * x) of each component, held to what 64-bit distances can carry."""
    bounded = lambda x: F.greatest(F.least(F.floor(x.cast("double") * SCALE), F.lit(float(LARGEST))), F.lit(float(-LARGEST)))
    return F.transform(vector, lambda x: bounded(x).cast("int"))


def usable(vector: Column, components: int) -> Column:
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) == components) & finite, F.lit(False))


def cluster(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, components: int = COMPONENTS, seed: int = SEED, carried: list[str] | None = None) -> tuple[DataFrame, np.ndarray]:
    """The kept rows (their columns, or those named in `carried`, in `row`) with cluster and squared distance, and the final centroids in the driver.

    Kept are vectors with exactly `components` components, none null or non-finite; components are
    held to 65,536 in size, so that distances fit in 64 bits. The first centroids are the k vectors
    with the smallest SHA-256 of `<seed>:<key>`, fewer if there are fewer; a null key counts as an
    empty one, and rows that share a key follow the order of their components. A cluster that is
    left empty keeps its centroid. Without any vector the result is empty.
    """
    spark = vectors.sparkSession
    named = packed(vectors, _key=key, _vector=vector).filter(usable(F.col("_vector"), components))
    row = F.col("row") if carried is None else F.struct(*[F.col("row").getField(c) for c in carried]).alias("row")
    points = materialize(named.select(row, F.col("_key").cast("string").alias("key"), integers(F.col("_vector")).alias("point")), "cluster-points")
    chosen = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce("key", F.lit(""))), 256)
    # Parameters bound what the driver gets: k vectors here, k sums a round below.
    first = points.select(chosen.alias("h"), "point").orderBy("h", "point").limit(k).collect()
    centroids = np.array([r["point"] for r in first], dtype=np.int64).reshape(len(first), components)
    if not len(centroids):
        return points.select("row", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")), centroids
    for _ in range(rounds):
        tree = spark.sparkContext.broadcast(VantageTree(centroids))
        sums = points.select("point").mapInArrow(_summed(tree), "cluster int, n long, total array<long>")
        parts = sums.select("cluster", "n", F.posexplode("total").alias("at", "x"))
        found = parts.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()
        centroids = centroids.copy()
        for r in found:
            centroids[r["cluster"], r["at"]] = r["x"] // r["n"]
        tree.unpersist()
    tree = spark.sparkContext.broadcast(VantageTree(centroids))
    schema = T.StructType([points.schema["row"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    return points.select("row", "point").mapInArrow(_assigned(tree), schema), centroids


def with_inertia(clustered: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Beside each row the sum of distances in its cluster and over all, and its `centroid`; a sum beyond 64 bits is null."""
    spark = clustered.sparkSession
    rows = materialize(clustered, "clustered")
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    # One row a cluster.
    sums = rows.groupBy("cluster").agg(total.alias("_sum")).withColumn("_all", F.sum("_sum").over(Window.partitionBy()))
    sums = sums.select("cluster", F.col("_sum").try_cast("long").alias("cluster_inertia"), F.col("_all").try_cast("long").alias("inertia"))
    places = spark.createDataFrame([(j, c.tolist()) for j, c in enumerate(centroids)], "cluster int, centroid array<long>")
    return rows.join(F.broadcast(sums), "cluster").join(F.broadcast(places), "cluster")
