"""Centroid clustering (operator 12): k-means in exact integers, filtered by partition-local ball trees.

Components become integers, floor(1024 x). Each task cuts its vectors into blocks of up to `BLOCK` and grows a ball tree over each: a
node holds a range of the block's vectors, the radius of the ball around their mean, their count and their integer sum; leaves hold
up to `LEAF`. The trees are written once; each round every task walks its trees from the roots: a ball whose nearest centroid stays
nearest for all of it by the triangle inequality (d1 + r < d2 - r) goes to it whole, by count and sum; else its halves are asked, and
in leaves distances are computed in exact integers. Tasks hand on a count and a sum a centroid, so a round moves no vectors and the
driver sees k rows. The last walk gives each vector its cluster and exact distance.

Kept are vectors of exactly `SIZE` components none of which is null or non-finite. Centroids start as the `K` kept vectors of the
smallest hex sha256 of SEED followed by the id, in that order (of equal ids, by their bytes; null ids last; with fewer vectors there
are as many centroids). Rows with equal or null ids and repeated rows count each. Of equally near centroids the smaller number wins.
Vectors too large for exact sums in double precision are computed in unbounded integers, without a tree; a sum that doesn't fit
a long is null. Empty tables give no rows. Extra columns are ignored: only vec_id and embedding are read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Workspace, stored, table
from .vectors import DISTANCE, KEPT, LONG, SUMS, Sums, exact, integers, kind_of, longs, mapped, sql_means, squared, total, whole_vectors

K, ROUNDS, SIZE, SEED = 8, 10, 64, "3:"
BLOCK, LEAF = 4096, 32
#: Share of a distance by which bounds are widened, far beyond the rounding of double precision.
SLACK = 1e-9


class Tree:
    """Nodes by number: the range [low, high) of rows, the first of two children that follow each other (-1: a leaf), the radius
    around the mean, and the integer sum."""

    def __init__(self, low: np.ndarray, high: np.ndarray, child: np.ndarray, radius: np.ndarray, sums: np.ndarray):
        self.low, self.high, self.child, self.radius, self.sums = low, high, child, radius, sums

    @classmethod
    def grow(cls, x: np.ndarray) -> tuple[Tree, np.ndarray]:
        """The tree over the rows of x, and the order in which it has them."""
        order, nodes = np.arange(len(x)), [(0, len(x))]
        child, radius, sums = [], [], []
        for low, high in nodes:  # grows as it is read
            rows = x[order[low:high]]
            sums.append(rows.sum(axis=0))
            child.append(-1)
            if x.dtype == object:
                radius.append(np.inf)
                continue
            far = _distances(rows, sums[-1][None] / len(rows))[:, 0]
            radius.append(far.max() * (1 + SLACK))
            if high - low <= LEAF or not far.max():
                continue
            a = _distances(rows, rows[[far.argmax()]])[:, 0]
            left = a <= _distances(rows, rows[[a.argmax()]])[:, 0]
            n = int(left.sum())
            if 0 < n < high - low:
                order[low:high] = np.concatenate([order[low:high][left], order[low:high][~left]])
                child[-1] = len(nodes)
                nodes += [(low, low + n), (low + n, high)]
        low, high = np.array(nodes).T
        return cls(low, high, np.array(child), np.array(radius), np.stack(sums)), order

    def assign(self, centroids: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
        """Balls that go to a centroid whole, as (node, centroid), and the rows of leaves that have to be measured."""
        balls, rows, front = [], [], np.zeros(1, int)
        while len(front):
            leaf = self.child[front] < 0
            sure = np.zeros(len(front), bool)
            if self.sums.dtype != object and centroids.dtype != object:
                d = _distances(self.sums[front] / (self.high - self.low)[front, None], centroids)
                best = d.argmin(axis=1)
                first = d[np.arange(len(d)), best]
                d[np.arange(len(d)), best] = np.inf
                second = d.min(axis=1)
                sure = first + 2 * self.radius[front] + SLACK * (1 + first) < second * (1 - SLACK)
                balls += zip(front[sure].tolist(), best[sure].tolist())
            rows += [np.arange(self.low[i], self.high[i]) for i in front[leaf & ~sure]]
            inner = self.child[front[~leaf & ~sure]]
            front = np.concatenate([inner, inner + 1])
        return balls, np.concatenate(rows) if rows else np.zeros(0, int)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([np.einsum("ij,ij->i", d, d) for d in (x - row for row in y)], axis=1))


TREE = "n int, data binary, low array<int>, high array<int>, child array<int>, radius array<double>, sums array<string>"


def trees(vectors: DataFrame, size: int, kind: str) -> DataFrame:
    """A row for each block of vectors (vec_id, data): the ids and vectors in the tree's order, and the tree."""
    id_type = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                tree, order = Tree.grow(integers(part.column(1).to_pylist(), size, kind))
                part = part.take(pa.array(order))
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                lists = [pa.array([x.tolist()], pa.list_(t)) for x, t in ((tree.low, pa.int32()), (tree.high, pa.int32()), (tree.child, pa.int32()), (tree.radius, pa.float64()))]
                sums = pa.array([[",".join(str(int(v)) for v in s) for s in tree.sums]], pa.list_(pa.string()))
                data = pa.array([b"".join(part.column(1).to_pylist())], pa.binary())
                yield pa.RecordBatch.from_arrays([ids, pa.array([part.num_rows], pa.int32()), data, *lists, sums], names=["ids", "n", "data", "low", "high", "child", "radius", "sums"])

    return mapped(vectors.select("vec_id", "data"), f"ids array<{id_type}>, {TREE}", run)


def _blocks(batches: Iterator[pa.RecordBatch], size: int, kind: str) -> Iterator[tuple[pa.Array, np.ndarray, Tree]]:
    width = int(kind[1]) * size
    for batch in batches:
        for i in range(batch.num_rows):
            n, data, low, high, child, radius, sums = (batch.column(c)[i].as_py() for c in range(1, 8))
            x = integers((data[j * width : (j + 1) * width] for j in range(n)), size, kind)
            held = np.array([[int(v) for v in s.split(",")] for s in sums], np.float64 if x.dtype != object else object)
            yield batch.column(0)[i].values, x, Tree(np.array(low), np.array(high), np.array(child), np.array(radius), held)


def moved(grown: DataFrame, centroids: list[list[int]], size: int, kind: str) -> list[list[int]]:
    """The centroids after a round: floored means of what is nearest to each; empty ones stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, c = Sums(), exact(centroids, size)
        for _, x, tree in _blocks(batches, size, kind):
            balls, rows = tree.assign(c)
            for node, best in balls:
                sums.add(best, int(tree.high[node] - tree.low[node]), tree.sums[node])
            if len(rows):
                near = squared(x[rows], c).argmin(axis=1)
                for best in np.unique(near).tolist():
                    own = x[rows[near == best]]
                    sums.add(best, len(own), own.sum(axis=0))
        yield sums.batch()

    found = total(mapped(grown, SUMS, run))
    return [[s // found[i][0] for s in found[i][1]] if i in found else old for i, old in enumerate(centroids)]


def assigned(grown: DataFrame, centroids: list[list[int]], size: int, kind: str) -> DataFrame:
    """vec_id, cluster, distance (squared; null: beyond a long) of every vector."""
    id_type = grown.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = exact(centroids, size)
        for ids, x, tree in _blocks(batches, size, kind):
            balls, rows = tree.assign(c)
            cluster, far = np.zeros(len(x), int), np.zeros(len(x), object)
            for node, best in balls:
                at = slice(tree.low[node], tree.high[node])
                cluster[at], far[at] = best, squared(x[at], c[[best]])[:, 0]
            if len(rows):
                d = squared(x[rows], c)
                cluster[rows], far[rows] = d.argmin(axis=1), d.min(axis=1)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), longs(far.tolist())], names=["vec_id", "cluster", "distance"])

    return mapped(grown, f"vec_id {id_type}, cluster int, distance bigint", run)


def clustered(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, size: int = SIZE, seed: str = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that is kept."""
    spark, kind = vectors.sparkSession, kind_of(vectors)
    space = Workspace(spark, "clusters")
    kept = space.stored(whole_vectors(vectors.filter(F.size("embedding") == size), "vec_id"), "vectors")
    turn = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = kept.select("data", turn.alias("turn")).orderBy(F.asc_nulls_last("turn"), "data").limit(k).collect()
    centroids = [[int(v) for v in row] for row in integers([bytes(r["data"]) for r in first], size, kind)]
    grown = space.stored(trees(kept, size, kind), "trees")
    for _ in range(rounds if first else 0):
        centroids = moved(grown, centroids, size, kind)
    if first:
        rows = space.stored(assigned(grown, centroids, size, kind), "assigned")
    else:
        rows = kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance"))
    whole = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")))
    sums = {r["cluster"]: r["d"] for r in rows.groupBy("cluster").agg(whole.alias("d")).collect()}  # k rows
    fits = lambda v: int(v) if v is not None and v < LONG else None
    everything = None if None in sums.values() else sum(map(int, sums.values()))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame([(i, fits(sums.get(i)), fits(everything), digest) for i, digest in enumerate(digests)], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    found = stored(rows.join(F.broadcast(facts), "cluster"), "clusters-found")
    space.clear()
    return found


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))


def oracle() -> str:
    """The query as SQL."""
    turn = f"sha256('{SEED}' || vec_id)"
    steps = [KEPT, f"vecs AS MATERIALIZED (SELECT vec_id, v AS x FROM kept WHERE len(v) = {SIZE})", f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {turn}) - 1 AS k, x AS c FROM vecs ORDER BY k LIMIT {K})"]
    for r in range(ROUNDS + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, x, m // {K} AS d, m % {K} AS k FROM (SELECT vec_id, any_value(x) AS x, min({DISTANCE} * {K} + k) AS m FROM vecs, c{r} GROUP BY vec_id))")
        if r < ROUNDS:
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT k, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN {sql_means(f'a{r}', 'k')} m USING (k))")
    text = "sha256(array_to_string(list_transform(c, lambda y: y::BIGINT), ','))"
    return f"WITH {', '.join(steps)} SELECT vec_id, k::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, {text} AS centroid_sha256 FROM a{ROUNDS} JOIN c{ROUNDS} USING (k)"
