"""Approximate nearest neighbours (operator 9): an NN-descent neighbour graph built by Spark joins, and greedy graph search.

Nodes are distinct vectors; each keeps the `COPIES` smallest ids that have it, which is all that can show among `TOP` results.
1. Start: `STARTS` times, nodes are put into blocks of about `BLOCK` by the signs of random projections (blocks over twice that are
   dealt out at random, so that one huge cluster is no huge block), and every node takes its nearest ones of each block.
2. NN-descent: each node sends its neighbours, those not sent before first, and their reverses; a node's senders and neighbours
   meet at it (at most send + reverse + 1 vectors), and each learns of the nearest others that beat its farthest neighbour. Rounds go
   on until at most `SETTLED` of all entries are still to be sent as new ones. Pairs are measured from their differences, so a
   pair always has the same distance, no entry comes back once it has been pushed out, and the rounds come to an end.
3. Search: a query starts from its own neighbours. In each step it expands its nearest unexpanded nodes over the graph and its
   reverse edges, and keeps the beam nearest nodes. All queries take a step in the same joins, until no beam holds a node that
   has not been expanded.
4. The nearest `RERANK` nodes of each query are measured again on the original vectors in double precision.
Nodes lie in buckets of about `ROWS`, by their number: a bucket's vectors, lists and beams are rows of binary columns, joined with what
other buckets have sent it by grouping on the bucket. What goes from one bucket to another is one row, in which a vector stands once.
In the search queries' vectors travel to the buckets of what they have met, and only distances within the beam come back.
Vectors are kept as they come, in single or double precision, and all distances are computed in double precision from differences
(blocks choose by products around their own mean), so a common offset costs nothing. Lists and the beam grow with the logarithm of
the number of nodes (see `Effort`), what is sent and what meets does not grow.

Vectors that are null, zero, or hold null or non-finite components take no part. A distance needs vectors of one length, so the
vectors of each length are a graph of their own, built in the same joins, and a query finds vectors of its length. Queries are rows with ids divisible by `EVERY`; candidates are the rows with another id. A query
with fewer than TOP candidates gets all it finds. Null ids take no part. Repeated rows (same id and vector) count once. Extra
columns are ignored. Only vec_id and embedding are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import Workspace, stored, table, tidy

EVERY, TOP, COPIES = 100, 10, 11
K = 24
BLOCK, STARTS = 2048, 8
#: Rows of a block that are compared with it at once.
PART = 256
SEND, REVERSE, TELL = 12, 14, 6
DEGREE = 40
BEAM, EXPAND = 192, 56
RERANK = 48
#: The share of entries that may be left unsent when the descent ends.
SETTLED = 0.001
#: The nodes up to which the figures above hold, and the shares by which lists and the beam grow with every fourfold beyond.
BASE, LISTS, WIDTH = 51_282, 0.25, 1.0
#: Nodes of a bucket, about: their vectors, lists and beams are moved and worked on together.
ROWS = 2048


@dataclass(frozen=True)
class Effort:
    """Sizes for n nodes: with fixed ones the share of true neighbours found falls as the table grows."""

    n: int

    def _grown(self, size: int, share: float) -> int:
        return math.ceil(size * (1 + share * math.log(max(1.0, self.n / BASE), 4)))

    k = property(lambda self: self._grown(K, LISTS))
    degree = property(lambda self: self._grown(DEGREE, LISTS))
    beam = property(lambda self: self._grown(BEAM, WIDTH))
    expand = property(lambda self: self._grown(EXPAND, WIDTH))


def _kind(nodes: DataFrame) -> str:
    """The type of the components in `data`: that of the vectors."""
    return "f4" if nodes.schema["vector"].dataType.simpleString() == "array<float>" else "f8"


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
    return np.maximum(d, 0, out=d)


def nodes_of(vectors: DataFrame, space: Workspace) -> DataFrame:
    """node, ids (the COPIES smallest), data (the vector's bytes), size (its length), vector (as given), of all that take part."""
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & x.isNotNull() & ~bad & F.exists(x, lambda v: v != 0))
    # equal vectors: the smallest ids, chosen within each task before anything moves
    order = Window.partitionBy(F.xxhash64("embedding"), "embedding").orderBy("vec_id")
    few = rows.distinct().withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= COPIES)
    found = few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).value_lengths().to_numpy().astype(np.int64)
            data = _cut(batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(kind), sizes.cumsum())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), data, pa.array(sizes, pa.int32()), batch.column(2)], names=["node", "ids", "data", "size", "vector"])

    numbered = found.select(F.monotonically_increasing_id().alias("node"), "ids", F.col("embedding").alias("vector"))
    kind, type_ = _kind(numbered), vectors.schema["embedding"].dataType.simpleString()
    return space.stored(numbered.mapInArrow(store, f"node bigint, ids array<bigint>, data binary, size int, vector {type_}"), "nodes")


def _means(nodes: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """For each length of vectors, how many there are and their mean: one row per length comes to the driver."""
    kind = _kind(nodes)

    def add(batches: Iterator[pa.RecordBatch], read) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for size, n, x in read(batch):
                old = sums.setdefault(size, [0, 0.0])
                old[0], old[1] = old[0] + n, old[1] + x
        yield pa.RecordBatch.from_arrays([pa.array([*sums], pa.int32()), pa.array([n for n, _ in sums.values()], pa.int64()), pa.array([x.tobytes() for _, x in sums.values()], pa.binary())], names=["size", "n", "sum"])

    own = lambda batch: ((size, 1, np.frombuffer(x, kind).astype(np.float64)) for size, x in zip(*(c.to_pylist() for c in batch.columns)))
    told = lambda batch: ((size, n, np.frombuffer(x, np.float64)) for size, n, x in zip(*(c.to_pylist() for c in batch.columns)))
    schema = "size int, n bigint, sum binary"
    parts = nodes.select("size", "data").mapInArrow(lambda b: add(b, own), schema)
    rows = parts.repartition("size").mapInArrow(lambda b: add(b, told), schema).collect()
    return {r["size"]: (r["n"], np.frombuffer(bytes(r["sum"]), np.float64) / r["n"]) for r in rows}


def _rows(columns: list, schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema)], names=[n for n, _ in schema])


IDS = pa.list_(pa.int64())


def _buckets(n: int) -> int:
    return max(1, math.ceil(n / ROWS))


def _flat(table: pa.Table, name: str, kind: str | type, width: int = 0) -> np.ndarray:
    x = np.frombuffer(b"".join(v for v in table.column(name).to_pylist() if v is not None), kind)
    return x.reshape(-1, width) if width else x


def _lengths(table: pa.Table, name: str, width: int) -> np.ndarray:
    return np.array([len(v) // width for v in table.column(name).to_pylist() if v is not None], np.int64)


def _cut(x: np.ndarray, ends: np.ndarray) -> pa.Array:
    """x as binary values that end after these rows of it."""
    x, ends = np.ascontiguousarray(x), np.concatenate([[0], ends]) * x.dtype.itemsize * math.prod(x.shape[1:])
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(x)])


def _ends(sorted_: np.ndarray) -> np.ndarray:
    return np.append(np.flatnonzero(sorted_[1:] != sorted_[:-1]) + 1, len(sorted_)) if len(sorted_) else np.zeros(0, np.int64)


def _post(to: np.ndarray, above: int, buckets: int, columns: dict[str, np.ndarray]) -> pa.Table:
    """A row for each bucket that holds some of the nodes `to`, with what goes to them. above: the part of the key above the bucket."""
    bucket = to % buckets
    order = np.argsort(bucket, kind="stable")
    ends = _ends(bucket[order])
    keys = above + bucket[order[ends - 1]]
    return pa.table({"key": pa.array(keys, pa.int64()), **{name: _cut(x[order], ends) for name, x in columns.items()}})


def _letters(to: np.ndarray, who: np.ndarray, above: int, buckets: int, each: dict[str, np.ndarray], pairs: dict[str, np.ndarray]) -> pa.Table:
    """Like _post, where `each` (rows of `who` index them) goes to a bucket once, however many pairs there have it; `place` counts within a row."""
    bucket = to % buckets
    order = np.lexsort((who, bucket))
    bucket, who = bucket[order], who[order]
    ends = _ends(bucket)
    once = np.ones(len(who), bool)
    once[1:] = (who[1:] != who[:-1]) | (bucket[1:] != bucket[:-1])
    turn = np.cumsum(once) - 1
    sizes = np.diff(ends, prepend=0)
    place = turn - np.repeat(turn[ends - sizes], sizes)
    columns = {name: _cut(x[who[once]], turn[ends - 1] + 1) for name, x in each.items()} | {name: _cut(x[order], ends) for name, x in pairs.items()}
    return pa.table({"key": pa.array(above + bucket[ends - 1], pa.int64()), "place": _cut(place.astype(np.int32), ends), **columns})


def _places(table: pa.Table, each: str, width: int) -> np.ndarray:
    """The rows of the concatenated `each` that the concatenated pairs belong to."""
    rows, pairs = _lengths(table, each, width), _lengths(table, "place", 4)
    return _flat(table, "place", np.int32) + np.repeat(np.cumsum(rows) - rows, pairs)


def _first(row: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Where each (row, id) comes first, by row and id."""
    order = np.lexsort((ids, row))
    once = np.ones(len(order), bool)
    once[1:] = (ids[order[1:]] != ids[order[:-1]]) | (row[order[1:]] != row[order[:-1]])
    return order[once]


def _rank(sorted_: np.ndarray) -> np.ndarray:
    return np.arange(len(sorted_)) - np.searchsorted(sorted_, sorted_)


def _best(row: np.ndarray, ids: np.ndarray, d: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The `most` nearest entries of each row, and their ranks. Of an id that comes twice in a row the first is taken."""
    order = np.lexsort((ids, d, row))
    once = np.ones(len(order), bool)  # a pair always has the same distance
    once[1:] = (ids[order[1:]] != ids[order[:-1]]) | (row[order[1:]] != row[order[:-1]])
    order = order[once]
    rank = _rank(row[order])
    return order[rank < most], rank[rank < most]


def _filled(shape: tuple[int, int], row: np.ndarray, rank: np.ndarray, x: np.ndarray, empty) -> np.ndarray:
    out = np.full(shape, empty, x.dtype)
    out[row, rank] = x
    return out


def _schema(binary: str, more: str = "") -> str:
    return ", ".join(["key bigint", *(f"{c} binary" for c in binary.split()), *filter(None, [more])])


def _gather(run, schema: str, *frames: DataFrame) -> DataFrame:
    """run over all rows of a key, of whichever frame; columns that a frame hasn't are null in its rows."""
    both = frames[0]
    for frame in frames[1:]:
        both = both.unionByName(frame, allowMissingColumns=True)
    names = [part.split()[0] for part in schema.split(", ")]

    def tidied(table: pa.Table) -> pa.Table:
        return run(table).select(names)

    return both.groupBy("key").applyInArrow(tidied, schema)


def _each(run, schema: str, frame: DataFrame) -> DataFrame:
    """run over each row."""
    names = [part.split()[0] for part in schema.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from run(pa.Table.from_batches([batch.slice(i, 1)])).select(names).combine_chunks().to_batches()

    return frame.mapInArrow(tidy(rows), schema)


def _above(table: pa.Table) -> int:
    """The key without its bucket."""
    return table.column("key")[0].as_py() >> 32 << 32


def packed(nodes: DataFrame, buckets: int, space: Workspace) -> DataFrame:
    """key (length in bytes and bucket), ids (ascending), data: vectors by buckets of about ROWS nodes, of one length each."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("node").to_numpy()
        order = np.argsort(ids)
        data = table.column("data").to_pylist()
        return pa.table({"key": table.column("key")[:1], "ids": pa.array([ids[order].tobytes()], pa.binary()), "data": pa.array([b"".join(data[i] for i in order)], pa.binary())})

    key = F.shiftleft(F.octet_length("data").cast("bigint"), 32) + F.pmod("node", F.lit(buckets))
    return space.stored(_gather(run, _schema("ids data"), nodes.select(key.alias("key"), "node", "data")), "packed")


def _blocks(packs: DataFrame, size: Effort, means: dict[int, tuple[int, np.ndarray]], kind: str, buckets: int) -> DataFrame:
    """key, node, cand, dist: of every start, the nearest of each node's block. A block has vectors of one length, start and code: the
    signs of so many projections of the centred vector that a code has about BLOCK vectors."""
    most, width, block, starts = size.k, np.dtype(kind).itemsize, BLOCK, STARTS

    def coded(table: pa.Table) -> pa.Table:
        ids, above = _flat(table, "ids", np.int64), _above(table)
        data = _flat(table, "data", kind, (above >> 32) // width)
        n, mean = means[data.shape[1]]
        bits, x, out = math.ceil(math.log2(n / block)) if n > block else 0, data - mean, []
        for start in range(starts):
            planes = np.random.Generator(np.random.PCG64(101 + start)).standard_normal((data.shape[1], bits))
            code = ((x @ planes > 0) << np.arange(bits)).sum(axis=1)
            order = np.argsort(code, kind="stable")
            ends = _ends(code[order])
            m = len(ends)
            out.append(pa.table({"key": pa.array(np.full(m, above)), "start": pa.array(np.full(m, start)), "code": pa.array(code[order[ends - 1]].astype(np.int64)), "n": pa.array(np.diff(ends, prepend=0)), "ids": _cut(ids[order], ends), "data": _cut(data[order], ends)}))
        return pa.concat_tables(out)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "start", "code", "parts", "ids", "data"]
        for batch in batches:
            many = batch.column(names.index("parts")).to_numpy()
            yield batch.filter(pa.array(many == 1))
            for i in np.flatnonzero(many > 1).tolist():
                table = pa.Table.from_batches([batch.slice(i, 1)])
                ids, data = _flat(table, "ids", np.int64), _flat(table, "data", kind, (_above(table) >> 32) // width)
                part = np.random.Generator(np.random.PCG64([table.column("start")[0].as_py(), int(ids[0])])).integers(0, many[i], len(ids))
                order = np.argsort(part, kind="stable")
                ends = _ends(part[order])
                same = [pa.array(np.full(len(ends), table.column(c)[0].as_py())) for c in names[:3]]
                yield pa.RecordBatch.from_arrays([*same, pa.array(part[order[ends - 1]]), _cut(ids[order], ends), _cut(data[order], ends)], names=names)

    def nearest_(table: pa.Table) -> pa.Table:
        ids, above = _flat(table, "ids", np.int64), _above(table)
        x = _flat(table, "data", kind, (above >> 32) // width).astype(np.float64)
        x = x - x.mean(axis=0)
        k, out = min(most, len(ids) - 1), []
        for at in range(0, len(ids) if k > 0 else 0, PART):
            d = _distances(x[at : at + PART], x)
            d[np.arange(len(d)), at + np.arange(len(d))] = np.inf
            best = np.argpartition(d, k - 1, axis=1)[:, :k].ravel()
            node = np.repeat(np.arange(at, at + len(d)), k)
            out.append((node, best))
        node, best = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int))
        raw = _flat(table, "data", kind, x.shape[1])
        return _post(ids[node], above, buckets, {"node": ids[node], "cand": ids[best], "dist": _apart(raw, node, raw, best)})

    more = "start bigint, code bigint"
    blocks = _each(coded, _schema("ids data", f"{more}, n bigint"), packs)
    # the part of a key above the bucket is the vectors' length
    parts = blocks.groupBy("key", "start", "code").agg(F.ceil(F.sum("n") / (2 * block)).alias("parts"))
    blocks = blocks.join(parts, ["key", "start", "code"]).select("key", "start", "code", "parts", "ids", "data")
    blocks = blocks.mapInArrow(tidy(dealt), f"key bigint, {more}, parts bigint, ids binary, data binary")
    return blocks.groupBy("key", "start", "code", "parts").applyInArrow(nearest_, _schema("node cand dist"))


def _apart(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of rows i of a and j of b, from differences: those of a pair don't depend on the rows around it."""
    out = np.empty(len(i))
    for at in range(0, len(i), 4096):
        d = a[i[at : at + 4096]].astype(np.float64) - b[j[at : at + 4096]]
        out[at : at + 4096] = np.einsum("ij,ij->i", d, d)
    return out


GRAPH = "ids nbrs dists fresh send send_new worst"


def _merge(size: Effort, seed: int, *frames: DataFrame) -> DataFrame:
    """frames: the graph (or, at first, only ids) and what has been learnt. The new graph, and what it sends next."""
    k, send = size.k, SEND

    def run(table: pa.Table) -> pa.Table:
        ids = _flat(table, "ids", np.int64)
        old = {c: _flat(table, c, t) if c in table.column_names else np.zeros(0, t) for c, t in (("nbrs", np.int64), ("dists", np.float64), ("fresh", bool))}
        row, cand = np.concatenate([np.repeat(np.arange(len(ids)), len(old["nbrs"]) // max(1, len(ids))), np.searchsorted(ids, _flat(table, "node", np.int64))]), np.concatenate([old["nbrs"], _flat(table, "cand", np.int64)])
        d = np.concatenate([old["dists"], _flat(table, "dist", np.float64)])
        new = np.concatenate([old["fresh"], np.ones(len(d) - len(old["dists"]), bool)])
        held = np.flatnonzero(cand >= 0)
        best, rank = _best(row[held], cand[held], d[held], k)
        best, shape = held[best], (len(ids), k)
        nbrs, dists, fresh = _filled(shape, row[best], rank, cand[best], -1), _filled(shape, row[best], rank, d[best], np.inf), _filled(shape, row[best], rank, new[best], False)
        # new ones in random order, then old ones, where there are new ones at all
        turn = np.random.Generator(np.random.PCG64([seed, int(ids[0])])).random(shape) + np.where(fresh, 0, np.where(nbrs >= 0, 1, 2))
        some = np.argsort(turn, axis=1)[:, :send]
        sent_new = np.take_along_axis(fresh, some, 1)
        sent = np.where(fresh.any(axis=1)[:, None], np.take_along_axis(nbrs, some, 1), -1)
        left = fresh.copy()
        np.put_along_axis(left, some, False, 1)
        one = {"ids": ids, "nbrs": nbrs, "dists": dists, "fresh": left, "send": sent, "send_new": sent_new, "worst": dists[:, -1]}
        unsent = int(left.sum() + sent_new.sum())
        return pa.table({"key": table.column("key")[:1], **{c: pa.array([x.tobytes()], pa.binary()) for c, x in one.items()}, "unsent": pa.array([unsent], pa.int64())})

    return _gather(run, _schema(GRAPH, "unsent bigint"), *frames)


def _meet(graph: DataFrame, packs: DataFrame, kind: str, buckets: int, turn: int) -> DataFrame:
    """key, node, cand, dist: what nodes learn where their neighbours and senders meet."""
    tell, most, width = TELL, REVERSE, np.dtype(kind).itemsize

    def invite(table: pa.Table) -> pa.Table:
        ids, sent = _flat(table, "ids", np.int64), _flat(table, "send", np.int64)
        ok = sent >= 0
        at, member = sent[ok], np.repeat(ids, len(sent) // len(ids))[ok]
        return _post(at, _above(table), buckets, {"at": at, "member": member, "new": _flat(table, "send_new", bool)[ok]})

    def choose(table: pa.Table) -> pa.Table:
        at, member, new = _flat(table, "at", np.int64), _flat(table, "member", np.int64), _flat(table, "new", bool)
        chance = np.random.Generator(np.random.PCG64([turn, len(at)])).random(len(at))
        order = np.lexsort((chance, ~new, at))
        order = order[_rank(at[order]) < most]
        ids, sent = _flat(table, "ids", np.int64), _flat(table, "send", np.int64)
        ok, wide = sent >= 0, len(sent) // max(1, len(ids))
        own = ids[ok.reshape(len(ids), -1).any(axis=1)]
        at = np.concatenate([at[order], np.repeat(ids, wide)[ok], own])
        member, new = np.concatenate([member[order], sent[ok], own]), np.concatenate([new[order], _flat(table, "send_new", bool)[ok], np.zeros(len(own), bool)])
        order = np.lexsort((~new, member, at))
        once = np.ones(len(order), bool)
        once[1:] = (at[order[1:]] != at[order[:-1]]) | (member[order[1:]] != member[order[:-1]])
        at, member, new = (x[order[once]] for x in (at, member, new))
        some = np.isin(at, at[new])  # where nobody is new nothing is learnt
        at, member, new = at[some], member[some], new[some]
        return _post(member, _above(table), buckets, {"at": at, "member": member, "new": new})

    def fetch(table: pa.Table) -> pa.Table:
        ids, at, above = _flat(table, "ids", np.int64), _flat(table, "at", np.int64), _above(table)
        who = np.searchsorted(ids, _flat(table, "member", np.int64))
        data = _flat(table, "data", kind, (above >> 32) // width)
        return _letters(at, who, above, buckets, {"member": ids, "worst": _flat(table, "worst", np.float64), "data": data}, {"at": at, "new": _flat(table, "new", bool)})

    def meet(table: pa.Table) -> pa.Table:
        above = _above(table)
        ids, worst, data = _flat(table, "member", np.int64), _flat(table, "worst", np.float64), _flat(table, "data", kind, (above >> 32) // width)
        at, new, who = _flat(table, "at", np.int64), _flat(table, "new", bool), _places(table, "member", 8)
        order = np.argsort(at, kind="stable")
        ends, out = _ends(at[order]), []
        sizes = np.diff(ends, prepend=0)
        for m in np.unique(sizes[sizes > 1]).tolist():
            groups = (ends - sizes)[sizes == m][:, None] + np.arange(m)
            step, k = max(1, (1 << 20) // (m * data.shape[1] * 8 + 1)), min(tell, m - 1)
            for g in range(0, len(groups), step):
                pair = order[groups[g : g + step]]
                one, fresh = who[pair], new[pair]
                x, d = data[one].astype(np.float64), np.full((len(one), m, m), np.inf)
                for i in range(m - 1):
                    far = x[:, i + 1 :] - x[:, i : i + 1]
                    d[:, i, i + 1 :] = d[:, i + 1 :, i] = np.einsum("gij,gij->gi", far, far)
                d[~fresh[:, :, None] & ~fresh[:, None]] = np.inf
                best = np.argpartition(d, k - 1, axis=2)[:, :, :k]
                near = np.take_along_axis(d, best, 2)
                a, b, c = np.nonzero(near < worst[one][:, :, None])
                out.append((ids[one[a, b]], ids[one[a, best[a, b, c]]], near[a, b, c]))
        node, cand, d = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        once, _ = _best(node, cand, d, len(node))  # several nodes may tell the same
        return _post(node[once], above, buckets, {"node": node[once], "cand": cand[once], "dist": d[once]})

    invited = _each(invite, _schema("at member new"), graph.select("key", "ids", "send", "send_new"))
    asked = _gather(choose, _schema("at member new"), graph.select("key", "ids", "send", "send_new"), invited)
    known = packs.join(graph.select("key", "worst"), "key")
    sent = _gather(fetch, _schema("place member worst data at new"), known, asked)
    return _gather(meet, _schema("node cand dist"), sent)


def build_graph(nodes: DataFrame, space: Workspace) -> DataFrame:
    """node, nbrs (nearest first), dists (squared)."""
    means, kind = _means(nodes), _kind(nodes)
    size = Effort(sum(n for n, _ in means.values()))
    buckets = _buckets(size.n)
    packs = packed(nodes, buckets, space)
    graph, turn = space.stored(_merge(size, 0, packs.select("key", "ids"), _blocks(packs, size, means, kind, buckets)), "graph"), 0
    while (graph.agg(F.sum("unsent")).first()[0] or 0) > SETTLED * size.n * size.k:
        turn += 1
        learnt = _meet(graph, packs, kind, buckets, turn)
        graph = space.stored(_merge(size, turn, graph.select("key", "ids", "nbrs", "dists", "fresh"), learnt), "graph")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, nbrs, dists in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(ids, np.int64)
                nbrs, dists = (np.frombuffer(x, t).reshape(len(ids), -1) for x, t in ((nbrs, np.int64), (dists, np.float64)))
                held = nbrs >= 0
                ends = pa.array(np.concatenate([[0], held.sum(axis=1).cumsum()]), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(ids), *(pa.ListArray.from_arrays(ends, pa.array(x[held])) for x in (nbrs, dists))], names=["node", "nbrs", "dists"])

    return graph.select("ids", "nbrs", "dists").mapInArrow(rows, "node bigint, nbrs array<bigint>, dists array<double>")


def adjacency(graph: DataFrame, buckets: int, space: Workspace, degree: int = DEGREE) -> DataFrame:
    """key (the bucket), ids, links, many (how many links a node has): neighbours and the nodes that have it as a neighbour, at most
    degree, nearest first."""

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = np.repeat(batch.column(0).to_numpy(), batch.column(1).value_lengths().to_numpy())
            to, d = batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()
            both = np.concatenate([node, to])
            yield from _post(both, 0, buckets, {"node": both, "cand": np.concatenate([to, node]), "dist": np.concatenate([d, d])}).to_batches()

    def run(table: pa.Table) -> pa.Table:
        node, cand, d = _flat(table, "node", np.int64), _flat(table, "cand", np.int64), _flat(table, "dist", np.float64)
        best, _ = _best(node, cand, d, degree)
        ids, many = np.unique(node[best], return_counts=True)
        return pa.table({"key": table.column("key")[:1], **{c: pa.array([x.tobytes()], pa.binary()) for c, x in (("ids", ids), ("links", cand[best]), ("many", many.astype(np.int64)))}})

    sent = graph.select("node", "nbrs", "dists").mapInArrow(edges, _schema("node cand dist"))
    return space.stored(_gather(run, _schema("ids links many"), sent), "adjacency")


BEAMS = "asking own found dists done"


def search(queries: DataFrame, nodes: DataFrame, graph: DataFrame, space: Workspace) -> DataFrame:
    """queries: q (its node) and data. q, found: the nodes of the beam, nearest first."""
    size, kind = Effort(nodes.count()), _kind(nodes)
    buckets, wide, expand, width = _buckets(size.n), size.beam, size.expand, np.dtype(kind).itemsize
    links, packs = adjacency(graph, buckets, space, size.degree), packed(nodes, buckets, space)
    asking = packed(queries.select(F.col("q").alias("node"), "data"), buckets, space).select("key", F.col("ids").alias("asking"), F.col("data").alias("own"))

    def ask(table: pa.Table) -> pa.Table:
        """Who is expanded next, to the buckets of their links; a query that has not begun expands itself."""
        asking, above = _flat(table, "asking", np.int64), _above(table)
        if "ask" not in table.column_names:
            q = node = asking
        else:
            node = _flat(table, "ask", np.int64)
            q = np.repeat(asking, len(node) // len(asking))[node >= 0]
            node = node[node >= 0]
        return _post(node, 0, buckets, {"node": node, "q": q, "home": np.full(len(q), above)})

    def follow(table: pa.Table) -> pa.Table:
        ids, many, node, q, home = (_flat(table, c, np.int64) for c in ("ids", "many", "node", "q", "home"))
        at = np.searchsorted(ids, node)
        known = at < len(ids)
        known[known] = ids[at[known]] == node[known]
        at, q, home = at[known], q[known], home[known]
        n, first = many[at], (np.cumsum(many) - many)[at]
        cand = _flat(table, "links", np.int64)[np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        q, home = np.repeat(q, n), np.repeat(home, n)
        parts = [_post(q[i], above, buckets, {"q": q[i], "cand": cand[i]}) for above in np.unique(home).tolist() for i in [home == above]]
        return pa.concat_tables(parts) if parts else _post(q, 0, buckets, {"q": q, "cand": q})

    def probe(table: pa.Table) -> pa.Table:
        """What a query has met and not in its beam, to the buckets of the vectors, with its own."""
        asking, above = _flat(table, "asking", np.int64), _above(table)
        own, cand = _flat(table, "own", kind, (above >> 32) // width), _flat(table, "cand", np.int64)
        who = np.searchsorted(asking, _flat(table, "q", np.int64))
        bound, old = np.full(len(asking), np.inf), (np.arange(len(asking)), asking)
        if "found" in table.column_names:
            found = _flat(table, "found", np.int64).reshape(len(asking), -1)
            bound = np.where(found[:, -1] >= 0, _flat(table, "dists", np.float64).reshape(found.shape)[:, -1], np.inf)
            old = np.concatenate([old[0], np.nonzero(found >= 0)[0]]), np.concatenate([old[1], found[found >= 0]])
        row, ids = np.concatenate([old[0], who]), np.concatenate([old[1], cand])
        first = _first(row, ids)
        new = first[first >= len(old[0])] - len(old[0])
        return _letters(cand[new], who[new], above, buckets, {"q": asking, "bound": bound, "own": own}, {"cand": cand[new]})

    def measure(table: pa.Table) -> pa.Table:
        ids, above = _flat(table, "ids", np.int64), _above(table)
        x, own = (_flat(table, c, kind, (above >> 32) // width) for c in ("data", "own"))
        who, cand = _places(table, "q", 8), _flat(table, "cand", np.int64)
        d = _apart(x, np.searchsorted(ids, cand), own, who)
        ok = d <= _flat(table, "bound", np.float64)[who]
        q = _flat(table, "q", np.int64)[who[ok]]
        return _post(q, above, buckets, {"q": q, "cand": cand[ok], "dist": d[ok]})

    def advance(table: pa.Table) -> pa.Table:
        asking, row = _flat(table, "asking", np.int64), np.zeros(0, np.int64)
        ids, d, done = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool)
        if "found" in table.column_names:
            ids, d, done = _flat(table, "found", np.int64), _flat(table, "dists", np.float64), _flat(table, "done", bool)
            row = np.repeat(np.arange(len(asking)), len(ids) // len(asking))
            row, ids, d, done = (x[ids >= 0] for x in (row, ids, d, done))
        new = _flat(table, "cand", np.int64)
        row, ids = np.concatenate([row, np.searchsorted(asking, _flat(table, "q", np.int64))]), np.concatenate([ids, new])
        d, done = np.concatenate([d, _flat(table, "dist", np.float64)]), np.concatenate([done, np.zeros(len(new), bool)])
        best, rank = _best(row, ids, d, wide)
        shape = (len(asking), wide)
        found, dists, done = _filled(shape, row[best], rank, ids[best], -1), _filled(shape, row[best], rank, d[best], np.inf), _filled(shape, row[best], rank, done[best], True)
        some = np.argsort(done, axis=1, kind="stable")[:, :expand]
        asked = np.where(np.take_along_axis(done, some, 1), -1, np.take_along_axis(found, some, 1))
        np.put_along_axis(done, some, True, 1)
        one = {"asking": asking, "found": found, "dists": dists, "done": done, "ask": asked}
        own = next(v for v in table.column("own").to_pylist() if v is not None)
        return pa.table({"key": table.column("key")[:1], "own": pa.array([own], pa.binary()), **{c: pa.array([x.tobytes()], pa.binary()) for c, x in one.items()}, "open": pa.array([int((asked >= 0).sum())], pa.int64())})

    beam, left = asking, 1
    while left:
        sent = _each(ask, _schema("node q home"), beam.select("key", "asking", *[c for c in beam.columns if c == "ask"]))
        met = _gather(follow, _schema("q cand"), links, sent)
        state = beam.select(*[c for c in beam.columns if c not in ("ask", "open")])
        probes = _gather(probe, _schema("place q bound own cand"), state, met)
        answers = _gather(measure, _schema("q cand dist"), packs, probes)
        beam = space.stored(_gather(advance, _schema(f"{BEAMS} ask", "open bigint"), state, answers), "beam")
        left = beam.agg(F.sum("open")).first()[0] or 0

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asking, found in zip(*(c.to_pylist() for c in batch.columns)):
                asking = np.frombuffer(asking, np.int64)
                found = np.frombuffer(found, np.int64).reshape(len(asking), -1)
                yield _rows([asking, [x[x >= 0] for x in found]], [("q", pa.int64()), ("found", IDS)])

    return beam.select("asking", "found").mapInArrow(rows, "q bigint, found array<bigint>")


def nearest(vectors: DataFrame, every: int = EVERY, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score for each row whose id is divisible by every."""
    space = Workspace(vectors.sparkSession, "neighbours")
    nodes = nodes_of(vectors, space)
    # by vector, not by ids: a copy beyond the smallest COPIES may ask too
    rows = vectors.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")).distinct()
    asking = space.stored(rows.join(nodes.select("vector", "node"), "vector").select("query_id", "node"), "queries")
    queries = asking.select(F.col("node").alias("q")).distinct().join(nodes.select(F.col("node").alias("q"), "data"), "q")
    found = search(queries, nodes, build_graph(nodes, space), space)
    near = found.select("q", F.explode(F.concat(F.array("q"), F.slice("found", 1, RERANK))).alias("node")).distinct()
    x, y = F.col("a").cast("array<double>"), F.col("b").cast("array<double>")
    score = F.sqrt(F.aggregate(F.zip_with(x, y, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v))
    vectors_ = nodes.select("node", "ids", F.col("vector").alias("b"))
    scored = near.join(vectors_, "node").join(nodes.select(F.col("node").alias("q"), F.col("vector").alias("a")), "q").select("q", "ids", score.alias("score"))
    answers = asking.withColumnRenamed("node", "q").join(scored, "q").select("query_id", F.explode("ids").alias("vec_id"), "score").filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    best = answers.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", rank).filter(F.col("rank") <= top)
    found = stored(best.select("query_id", "rank", "vec_id", "score"), "neighbours-found")
    space.clear()
    return found


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
