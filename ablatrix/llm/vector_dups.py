"""Near-duplicates among vectors (operator 13): binary codes of randomly rotated vectors, estimates with bounds, exact verification.

1. Equal vectors are one node with a count. Everything below is about nodes.
2. Codes: unit vectors, padded to a power of two, are rotated at random (three rounds of random signs and a Hadamard transform). The
   signs of the rotated vector are its binary code; stored with it are the correction factor f, the inner product of code and vector,
   and the rotated vector in 8-bit steps, which is asked as a query. Signs of further rotations lengthen the code to `BITS`.
3. Candidates: nodes that agree on all bits of a band. Bands have as many bits as keep an average bucket near `BUCKET` nodes, and
   there are as many bands as let a pair of just the asked similarity share none with a probability of `MISS`.
4. Within a bucket the inner product of x and y is estimated from the code of x and the 8-bit form of y, divided by f; the estimate is
   unbiased. Of a pair of the asked similarity the part of y across x has a length of sin(angle) at most, so its estimate stays within
   `SURE` deviations of that length below. Pairs below this bound in one of both directions go; all others are computed again on the
   vectors in double precision. A pair is looked at only in the first band that it shares.
5. To buckets of more than `WIDE` nodes the vectors come along, and tasks hand on each node's number of links and a spanning forest
   instead of pairs. Of more than `BIG` nodes, they are cut into parts by hash, and each two parts meet in a task of their own. So a
   large group of different vectors that are all linked costs comparisons, which its links can't be counted without, but no row a pair.
6. Components of the links come from hooking and pointer jumping.

Every row of the table is a vector of its own: rows with equal or null ids and repeated rows link if their vectors do. Vectors that are
null, zero or hold null or non-finite components link with nothing, nor do vectors of different length. Vectors are scaled by their
largest component before anything else, so no length is too large or too small. Of a component the id is its smallest that isn't null,
and null if it has none; a null id equals a null id in `kept`. Empty tables give no rows. Extra columns are ignored: only vec_id and
embedding are read."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Workspace, stored, table
from .near_dup import components
from .vectors import floats, kind_of, mapped, whole_vectors, with_facts

SIMILARITY = 0.95
BITS, BUCKET, WIDE, BIG, MISS = 512, 128, 256, 2048, 1e-5
#: Standard deviations within which estimates are trusted.
SURE = 5.0
#: Least length of a rotated vector; shorter ones are padded.
LEAST = 64
#: Pairs whose shared bands are looked up at once.
CHUNK = 1 << 16


def units(data: list[bytes], size: int, kind: str) -> np.ndarray:
    x = floats(data, size, kind)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


class Plan:
    """Bits and bands for n nodes."""

    def __init__(self, n: int, similarity: float = SIMILARITY):
        self.similarity, angle = similarity, math.acos(similarity)
        self.bits = min(60, max(0, math.ceil(math.log2(max(n, 1) / BUCKET))))
        met = (1 - angle / math.pi) ** self.bits
        self.bands = 1 if not self.bits else math.ceil(math.log(MISS) / math.log(1 - met))
        self.across = math.sin(angle)
        rng = np.random.Generator(np.random.PCG64(13))
        self.at = np.stack([rng.permutation(BITS)[: self.bits] for _ in range(self.bands)])

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The first band that two codes (rows of a and b, packed) share."""
        other = np.unpackbits(a ^ b, axis=1)
        return (~other[:, self.at].any(axis=2)).argmax(axis=1)


def width(size: int) -> int:
    return max(LEAST, 1 << (size - 1).bit_length())


def rotated(x: np.ndarray, turn: int) -> np.ndarray:
    """Rows of x, padded, after rotation number `turn`."""
    n = width(x.shape[1])
    x = np.pad(x, ((0, 0), (0, n - x.shape[1])))
    rng = np.random.Generator(np.random.PCG64([29, turn]))
    for _ in range(3):
        x = x * rng.choice([-1.0, 1.0], n)
        step = 1
        while step < n:
            y = x.reshape(len(x), -1, 2, step)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
            step *= 2
        x = x / math.sqrt(n)
    return x


def encoded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of unit vectors: the code's bits, and the rows that Bucket reads: the bits packed, beyond BITS the signs of the rotated vector,
    its 8-bit steps, f and the step."""
    first = rotated(x, 0)
    turns = [first, *(rotated(x, t) for t in range(1, -(-BITS // first.shape[1])))]
    bits = np.concatenate([t > 0 for t in turns], axis=1)[:, :BITS]
    f = np.abs(first).sum(axis=1) / math.sqrt(first.shape[1])
    step = np.abs(first).max(axis=1) / 127
    eighth = np.rint(first / step[:, None]).astype(np.int8).view(np.uint8)
    signs = (first > 0).view(np.uint8)[:, : first.shape[1] if first.shape[1] > BITS else 0]
    return bits, np.concatenate([np.packbits(bits, axis=1), signs, eighth, np.stack([f, step], axis=1).astype("f4").view(np.uint8)], axis=1)


def codes(nodes: DataFrame, plan: Plan, kind: str) -> DataFrame:
    """node, n, size, keys (of the bands) and code of nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_numpy()
            for size in np.unique(sizes).tolist():
                part = batch.take(pa.array(np.flatnonzero(sizes == size)))
                bits, blobs = encoded(units(part.column(3).to_pylist(), size, kind))
                keys = bits[:, plan.at].astype(np.int64) @ (1 << np.arange(plan.bits, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), pa.array(list(keys), pa.list_(pa.int64())), pa.array([b.tobytes() for b in blobs], pa.binary())], names=["node", "n", "size", "keys", "code"])

    return mapped(nodes.select("node", "n", "size", "data"), "node bigint, n bigint, size int, keys array<bigint>, code binary", run)


class Bucket:
    """The codes of some nodes of one length."""

    def __init__(self, blobs: list[bytes], size: int):
        raw, n = np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), -1), width(size)
        self.bits = np.ascontiguousarray(raw[:, : BITS // 8])
        signs = raw[:, BITS // 8 : BITS // 8 + n] if n > BITS else np.unpackbits(self.bits, axis=1)[:, :n]
        self.signs = signs.astype(np.float32) * 2 - 1
        self.query = np.ascontiguousarray(raw[:, -8 - n : -8]).view(np.int8).astype(np.float32)
        self.f, self.step = np.ascontiguousarray(raw[:, -8:]).view("f4").astype(np.float64).T
        self.n = n

    def estimates(self, other: Bucket) -> tuple[np.ndarray, np.ndarray]:
        """(own, other): inner products of own codes with other vectors, and by how much rounding and one deviation of the part
        across can change them."""
        scale = 1 / (math.sqrt(self.n) * self.f)
        found = (self.signs @ other.query.T) * other.step[None] * scale[:, None]
        return found, np.sqrt((1 - np.minimum(self.f, 1) ** 2)) / (self.f * math.sqrt(self.n - 1))

    def likely(self, other: Bucket, plan: Plan) -> np.ndarray:
        """(own, other): pairs that the bounds leave open in both directions."""
        found, deviation = self.estimates(other)
        rounding = other.step[None] * math.sqrt(self.n) / (2 * self.f[:, None])
        return found + SURE * plan.across * deviation[:, None] + rounding + 1e-4 >= plan.similarity


#: what: 0 a pair to verify (m, n: nodes that a and b stand for), 1 a count of links (n) of a, 2 an edge.
FOUND = "what int, a bigint, b bigint, m bigint, n bigint"


def _forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what a symmetric matrix of links connects."""
    new, edges = np.ones(len(links), bool), []
    for start in range(len(links)):
        if new[start]:
            new[start], front = False, [start]
            while front:
                at = front.pop()
                near = np.flatnonzero(links[at] & new)
                new[near] = False
                edges += [(at, i) for i in near.tolist()]
                front += near.tolist()
    return edges


def candidates(coded: DataFrame, nodes: DataFrame, plan: Plan, kind: str, space: Workspace) -> DataFrame:
    """FOUND of all buckets."""
    rows = coded.select("size", F.posexplode("keys").alias("band", "key"), "node", "n", "code")
    counts = coded.select("size", F.posexplode("keys").alias("band", "key")).groupBy("size", "band", "key").count()
    large = space.stored(counts.filter(F.col("count") > WIDE).withColumn("parts", F.ceil(F.col("count") / BIG).cast("int")).drop("count"), "large")
    bucket = ["size", "band", "key"]
    some = large.limit(1).count() > 0
    small = rows.join(large, bucket, "left_anti") if some else rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for size, band, x, y, held in zip(*(c.to_pylist() for c in batch.columns[:4]), batch.column(4)):
                _meet(out, size, band, x, y, held.values)
                if len(out[0]) > CHUNK:
                    yield _batch(out)
                    out = [[] for _ in range(5)]
            yield _batch(out)

    def _batch(out: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int32(), *[pa.int64()] * 4))], names=["what", "a", "b", "m", "n"])

    def _meet(out: list[list], size: int, band: int, x: int, y: int, held: pa.StructArray) -> None:
        node, n, part = (held.field(c).to_numpy(zero_copy_only=False) for c in ("node", "n", "part"))
        data = held.field("data").to_pylist()
        at = np.argsort(node)
        left, right = (at, at) if x == y else (at[part[at] == x], at[part[at] == y])
        if not len(left) or not len(right):
            return
        blobs = held.field("code").to_pylist()
        a = Bucket([blobs[i] for i in left], size)
        b = a if x == y else Bucket([blobs[i] for i in right], size)
        open_ = a.likely(b, plan) & b.likely(a, plan).T
        if x == y:
            open_ = np.triu(open_, 1)
        whole = data[0] is not None
        if whole:
            u = units([data[i] for i in left], size, kind)
            v = u if x == y else units([data[i] for i in right], size, kind)
            open_ &= u @ v.T >= plan.similarity
        i, j = np.nonzero(open_)
        for s in range(0, len(i), CHUNK):
            p, q = i[s : s + CHUNK], j[s : s + CHUNK]
            first = plan.shared(a.bits[p], b.bits[q]) == band
            open_[p[~first], q[~first]] = False
        if not whole:
            i, j = np.nonzero(open_)
            columns = np.zeros(len(i), int), node[left[i]], node[right[j]], n[left[i]], n[right[j]]
        else:
            links = np.concatenate([open_ @ n[right], open_.T @ n[left]])
            nodes_ = np.concatenate([node[left], node[right]])
            grid = np.zeros((len(nodes_), len(nodes_)), bool)
            grid[: len(left), len(left) :] = open_
            edges = np.array(_forest(grid | grid.T), int).reshape(-1, 2) if x != y else np.array(_forest(open_ | open_.T), int).reshape(-1, 2)
            some_ = np.flatnonzero(links)
            none = np.zeros(len(some_) + len(edges), int)
            columns = (
                np.repeat([1, 2], [len(some_), len(edges)]), np.concatenate([nodes_[some_], nodes_[edges[:, 0]]]), np.concatenate([nodes_[some_], nodes_[edges[:, 1]]]), none, np.concatenate([links[some_], none[: len(edges)]]),
            )
        for column, values in zip(out, columns):
            column.extend(values.tolist())

    def met(rows: DataFrame, keys: list[str]) -> DataFrame:
        groups = rows.groupBy("size", "band", "key", *keys).agg(F.collect_list(F.struct("node", "n", "part", "code", "data")).alias("held"))
        x, y = keys or (F.lit(0).alias("x"), F.lit(0).alias("y"))
        return mapped(groups.filter(F.size("held") > 1).select("size", "band", x, y, "held"), FOUND, run)

    found = met(small.withColumns({"part": F.lit(0), "data": F.lit(None).cast("binary")}), [])
    if some:
        dealt = rows.join(large, bucket).withColumn("part", F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int"))
        dealt = dealt.join(nodes.select("node", "data"), "node").withColumn("with", F.explode(F.expr("sequence(0, parts - 1)")))
        found = found.union(met(dealt.withColumns({"x": F.least("part", "with"), "y": F.greatest("part", "with")}), ["x", "y"]))
    return space.stored(found, "candidates")


def verified(pairs: DataFrame, nodes: DataFrame, plan: Plan, kind: str) -> DataFrame:
    """pairs (a, b, m, n) of the asked cosine or more."""
    data = lambda k, c: nodes.select(F.col("node").alias(k), F.col("size").alias(f"{c}_size"), F.col("data").alias(c))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ok = batch.column(4).to_numpy(), np.zeros(batch.num_rows, bool)
            for size in np.unique(sizes).tolist():
                at = pa.array(np.flatnonzero(sizes == size))
                x, y = (units(batch.column(c).take(at).to_pylist(), size, kind) for c in (5, 6))
                ok[at.to_numpy()] = np.einsum("ij,ij->i", x, y) >= plan.similarity
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(ok)) for i in range(4)], names=["a", "b", "m", "n"])

    both = pairs.join(data("a", "x"), "a").join(data("b", "y"), "b")
    return mapped(both.select("a", "b", "m", "n", "x_size", "x", "y"), "a bigint, b bigint, m bigint, n bigint", run)


def linked(vectors: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors."""
    spark, kind = vectors.sparkSession, kind_of(vectors)
    space = Workspace(spark, "vector-dups")
    rows = whole_vectors(vectors, "vec_id", others=True, zeros=False)
    rows = space.stored(rows.withColumn("key", F.unhex(F.md5("data"))), "rows")
    whole = rows.filter("data is not null")
    nodes = whole.groupBy("key").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"), F.first("size").alias("size"), F.first("data").alias("data"))
    nodes = space.stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    plan = Plan(nodes.count(), similarity)
    found = candidates(space.stored(codes(nodes, plan, kind), "codes"), nodes, plan, kind, space)
    links = space.stored(verified(found.filter("what = 0").select("a", "b", "m", "n"), nodes, plan, kind), "links")
    counts = links.select(F.col("a").alias("node"), "n").union(links.select(F.col("b").alias("node"), F.col("m").alias("n"))).union(found.filter("what = 1").select(F.col("a").alias("node"), "n"))
    counts = counts.groupBy("node").agg(F.sum("n").alias("others"))
    roots = components(links.select("a", "b").union(found.filter("what = 2").select("a", "b")), space)
    named = nodes.select("node", "key", "n", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(counts, "node", "left")
    named = space.stored(named, "named")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    facts = named.join(least, "root").select("key", "n", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    facts = space.stored(facts, "facts")
    own = with_facts(whole.select("vec_id", "key"), facts, "key", "n", whole.count()).select("vec_id", "n_links", "component_id")
    alone = rows.filter("data is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    found = stored(own.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), "vector-dups-found")
    space.clear()
    return found


def op13_vector_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "embeddings"))


def oracle() -> str:
    """The query as SQL: all pairs, and components by reachability."""
    return f"""WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings WHERE embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= {SIMILARITY}),
reach AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN l ON l.a = r.other)
SELECT vec_id, (SELECT count(*) FROM l WHERE a = r.vec_id) AS n_links, min(other) AS component_id, vec_id = min(other) AS kept FROM reach r GROUP BY vec_id"""
