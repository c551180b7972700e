"""Near-duplicates (operator 2): improved consistent weighted sampling over TF-IDF shingles, banded, verified.

Words are runs of ASCII letters, digits and non-ASCII characters of the lower-cased text; shingles are five words (a text of fewer
words is one shingle). A shingle weighs its count in the text times its idf, 1 + ln(N / df) / ln(N / L): 1 for what every document
holds, 2 for what fewer than L do. L is 1 / `COMMON` of all (document, shingle) pairs, so that at most `COMMON` shingles are held by
L documents or more, whatever the corpus; their df is counted exactly, and rarer ones all weigh 2. As pairs and documents grow
together, L is the same share of the documents at every size. The added 1 keeps what the many copies of one text share from
weighing next to nothing beside an edit: whatever the idf, a pair of a plain similarity of 0.86 or more has a weighted one of 0.8.
Two documents are linked if the weighted Jaccard similarity of their shingles is `SIMILARITY` or more; a class is a connected
component of links.

1. Frequencies: tasks sum documents by 2^`SLOTS` hash slots; shingles of slots that reach L are then counted one by one.
2. Signatures: `BANDS` x `ROWS` consistent weighted samples, from draws that are each shingle's own. Equal texts are one
   node from here on.
3. Candidates: nodes that share a band. Every member of a band is first compared with the band's hub, so that a huge group of
   copies costs one comparison a member. Components of these links come from hooking and pointer jumping.
4. Rest: in bands whose members are not all in one component, nodes go whose weights and whose weights shared with other components
   rule out any further link, and further hubs are tried.
5. What is left is joined on differences from a centre of each hub's nodes: how much of their differences two similar nodes share has
   an exact lower bound. Differences with the same holders are one unit, and a node whose bound takes several units asks for
   up to three at once, so that letters of one form, alike but for what was filled in, meet only if they agree on several fillings. No
   pair of candidates stays undecided. Nodes of more than 15 shared units ask for single ones: in large groups of such nodes,
   different texts that are all nearly similar, pairs can still grow faster than texts.
6. Comparisons join the two texts' shingle vectors and compute the weighted Jaccard similarity exactly.

A link of similarity s shares a band with probability 1 - (1 - s^ROWS)^BANDS: 0.9994 at 0.8, 0.9999986 at 0.9.

Null texts count as empty. Texts without words are classes of equal texts. Documents with equal texts are always one class,
repeated ids and null ids included; class_id is the smallest doc_id of the class (null if it has none). Of classes that share it, or
have none, the one of the lowest md5 keeps it, and the others get distinct numbers that are no doc_id. Empty tables give no rows.
Only doc_id and text are read, so further columns can't clash.
"""

from __future__ import annotations

import functools
import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import Workspace, cut, empty_text, map_rows, stored, table, tidy

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 14, 4
SAMPLES = BANDS * ROWS
SLOTS = 21
#: Shingles that have an idf of their own, at most.
COMMON = 1 << 19
SHARES = 256
CHUNK = 2 << 20
BLOCK = 1024
ROWS_OF_DRAWS = 1 << 12
#: Room for rounding in bounds on weights.
SLACK = 1 + 1e-6
#: Rounds over what the first hubs leave: all but the last with one more hub a band, the last by differences.
HUBS = 3
#: Units that are asked for at once, and the units of a node up to which they are (so that it has 575 codes at most).
TOGETHER, NARROW = 3, 15
LONG_WORD = 256
LETTER = np.array([chr(i).isalnum() if i < 128 else True for i in range(256)])
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words in lower-cased UTF-8."""
    letter = LETTER[data].view(np.int8)
    edges = np.flatnonzero(np.diff(letter, prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edges[0::2], edges[1::2]
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    begin, size = starts[order], sizes[order]
    h = np.full(len(starts), 0x2545F4914F6CDD1D, np.uint64)
    many = int((size > LONG_WORD).sum())
    for i in range(many):
        h[i] = int.from_bytes(hashlib.blake2b(data[begin[i] : begin[i] + size[i]].tobytes(), digest_size=8).digest(), "little")
    left = len(size)
    for k in range(min(LONG_WORD, int(size[many]) if many < len(size) else 0)):
        while left > many and size[left - 1] <= k:
            left = int(np.searchsorted(-size[:left], -k, side="left"))
        if left <= many:
            break
        part = h[many:left]
        part *= np.uint64(0x100000001B3)
        part ^= data[begin[many:left] + k]
    out = np.empty_like(h)
    out[order] = mixed(h)
    return starts, out


def shingle_sets(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted distinct shingles (uint64) and their counts, for each text."""
    raw = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    starts, words = word_hashes(np.frombuffer(b"\n".join(raw) + b"\n", np.uint8))
    offsets = np.cumsum([0, *[len(r) + 1 for r in raw]])
    at = np.searchsorted(starts, offsets)
    whole = sum((words[j : len(words) - SHINGLE + 1 + j] * MULTIPLIERS[j] for j in range(SHINGLE)), np.uint64(0)) if len(words) >= SHINGLE else words[:0]
    whole = mixed(whole)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= SHINGLE:
            yield np.unique(whole[a : b - SHINGLE + 1], return_counts=True)
        elif b > a:
            yield mixed((words[a:b] * MULTIPLIERS[: b - a]).sum(keepdims=True) + np.uint64(b - a)), np.ones(1, np.int64)
        else:
            yield words[:0], np.ones(0, np.int64)


def slot_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SLOTS)).astype(np.int64)


def slot_counts(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of documents, and the documents of each slot: 2^SLOTS numbers, however many documents there are."""
    width = (1 << SLOTS) // SHARES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, slots = 0, np.zeros(1 << SLOTS, np.uint32)  # of one task
        for batch in batches:
            for part in cut(batch, 0, CHUNK):
                texts = part.column(0).to_pylist()
                n += len(texts)
                for u, _ in shingle_sets(texts):
                    np.add.at(slots, slot_of(u), np.uint32(1))
        yield hand_on({-1: np.array([n], np.uint64)} | {i: x.astype(np.uint64) for i in range(SHARES) if (x := slots[i * width : (i + 1) * width]).any()} if n else {})

    def hand_on(shares: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([*shares], pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in shares.values()], pa.binary())], names=["share", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = np.frombuffer(zlib.decompress(x), np.uint64)
                sums[i] = sums[i] + got if i in sums else got
        yield hand_on(sums)

    schema = "share int, counts binary"
    parts = docs.select(empty_text().alias("text")).mapInArrow(tidy(count), schema)
    rows = parts.repartition("share").mapInArrow(tidy(add), schema).collect()  # SHARES rows that hold 2^SLOTS numbers
    df = np.zeros(1 << SLOTS, np.uint64)
    n = 0
    for i, x in rows:
        got = np.frombuffer(zlib.decompress(bytes(x)), np.uint64)
        if i < 0:
            n = int(got[0])
        else:
            df[i * width : (i + 1) * width] = got
    return n, df


def common_shingles(docs: DataFrame, slots: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that `least` documents or more hold, sorted, and how many hold them. slots: the documents of each slot."""
    flags = docs.sparkSession.sparkContext.broadcast(slots >= least)  # 2 MB

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        new: list[np.ndarray] = []

        def add(u: np.ndarray, count: np.ndarray):
            some, at = np.unique(np.concatenate([held, u]), return_inverse=True)
            return some, np.bincount(at, np.concatenate([n, count]), len(some)).astype(np.int64)

        def hand_on() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.view(np.int64)), pa.array(n)], names=["shingle", "n"])

        for batch in batches:
            for part in cut(batch, 0, CHUNK):
                new += [u[flags.value[slot_of(u)]] for u, _ in shingle_sets(part.column(0).to_pylist())]
                if sum(map(len, new)) > COMMON:
                    u = np.concatenate(new)
                    new.clear()
                    held, n = add(u, np.ones(len(u), np.int64))
                    if len(held) > COMMON:
                        yield hand_on()
                        held, n = held[:0], n[:0]
        if new:
            u = np.concatenate(new)
            held, n = add(u, np.ones(len(u), np.int64))
        yield hand_on()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(i).to_numpy().tobytes()], pa.binary()) for i in (0, 1)], names=["shingles", "counts"])

    found = docs.select(empty_text().alias("text")).mapInArrow(tidy(pick), "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    rows = found.filter(F.col("n") >= least).mapInArrow(pack, "shingles binary, counts binary").collect()  # COMMON numbers of each kind at most
    shingles, counts = (np.frombuffer(b"".join(bytes(r[i]) for r in rows), np.uint64) for i in (0, 1))
    flags.destroy()
    order = np.argsort(shingles)
    return shingles[order], counts[order]


@dataclass(frozen=True)
class Weights:
    """The idf of shingles: an exact one of each common shingle, `rare` of all others. flags: the slots that hold common ones."""

    flags: np.ndarray
    shingles: np.ndarray
    values: np.ndarray
    rare: float

    @classmethod
    def of(cls, n: int, least: int, shingles: np.ndarray, df: np.ndarray) -> Weights:
        flags = np.zeros(1 << SLOTS, bool)
        flags[slot_of(shingles)] = True
        if n <= least:
            return cls(flags, shingles, np.ones(len(shingles), np.float32), 1.0)
        return cls(flags, shingles, (1 + np.log(n / np.clip(df, least, n).astype(np.float64)) / math.log(n / least)).astype(np.float32), 2.0)

    def __call__(self, u: np.ndarray) -> np.ndarray:
        out = np.full(len(u), self.rare, np.float32)
        some = np.flatnonzero(self.flags[slot_of(u)])
        if len(some):
            at = np.minimum(np.searchsorted(self.shingles, u[some]), len(self.shingles) - 1)
            hit = self.shingles[at] == u[some]
            out[some[hit]] = self.values[at[hit]]
        return out


def inverse_document_frequencies(docs: DataFrame) -> Weights:
    n, slots = slot_counts(docs)
    least = max(1, math.ceil(int(slots.sum()) / COMMON))
    return Weights.of(n, least, *common_shingles(docs, slots, least))


@functools.cache
def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, beta and ln c of each sample, `ROWS_OF_DRAWS` of each."""
    rng = np.random.Generator(np.random.PCG64(20240117))
    shape = SAMPLES, ROWS_OF_DRAWS
    draws = rng.gamma(2.0, 1.0, shape) + 1e-6, rng.random(shape), np.log(rng.gamma(2.0, 1.0, shape) + 1e-12)
    return tuple(x.astype(np.float32) for x in draws)


def sample(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The consistent weighted samples: a hash of (shingle, t) for each draw. Shingles are sorted, ties take the first.

    A shingle's r, beta and ln c are drawn by three parts of its hash, so that shingles that share all three are as rare as one in
    ROWS_OF_DRAWS^3 and no long text runs out of draws."""
    draws, columns = _draws(), np.arange(SAMPLES)
    best, who, when = np.full(SAMPLES, np.inf, np.float32), np.zeros(SAMPLES, np.uint64), np.zeros(SAMPLES, np.float32)
    logs = np.log(weights).astype(np.float32)
    rows = [((shingles >> np.uint64(k)) & np.uint64(ROWS_OF_DRAWS - 1)).astype(np.intp) for k in (0, 16, 32)]
    for s in range(0, len(shingles), BLOCK):
        part = slice(s, s + BLOCK)
        r, beta, log_c = (x.take(at[part], axis=1, mode="wrap") for x, at in zip(draws, rows))
        t = logs[part] / r
        t += beta
        np.floor(t, out=t)
        a = t - beta
        a += 1
        a *= r
        np.subtract(log_c, a, out=a)
        i = a.argmin(axis=1)
        low = a[columns, i]
        better = low < best
        best = np.where(better, low, best)
        who, when = np.where(better, shingles[part][i], who), np.where(better, t[columns, i], when)
    return mixed(who * MULTIPLIERS[0] + when.astype(np.int64).astype(np.uint64))


def bands_of(samples: np.ndarray) -> np.ndarray:
    x = samples.reshape(BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * MULTIPLIERS[4]
    for k in range(ROWS):
        h = mixed(h * MULTIPLIERS[1] + x[:, k])
    return h.view(np.int64)


def _keyed(docs: DataFrame) -> DataFrame:
    text = empty_text()
    return docs.select("doc_id", F.unhex(F.md5(text.cast("binary"))).alias("key"), text.alias("text"))


def signatures(docs: DataFrame, weights) -> DataFrame:
    """doc_id, key (md5 of the text), bands (empty without words), weight (sum over shingles). weights: a broadcast Weights."""
    known: dict[bytes, tuple[list[int], float]] = {}  # each task gets an empty one

    def run(columns):
        new = {k: i for i, k in enumerate(columns[1]) if k not in known}
        if len(known) > 4096:
            known.clear()
            new = {k: i for i, k in enumerate(columns[1])}
        for (k, i), (u, n) in zip(new.items(), shingle_sets([columns[2][i] for i in new.values()])):
            w = n * weights.value(u)
            known[k] = (bands_of(sample(u, w)).tolist() if len(u) else [], float(w.sum()))
        found = [known[k] for k in columns[1]]
        return columns[0], columns[1], [x[0] for x in found], [x[1] for x in found]

    return map_rows(_keyed(docs), "doc_id bigint, key binary, bands array<bigint>, weight double", run, CHUNK, 2)


def vectors(texts: DataFrame) -> DataFrame:
    """node and vector: the text's shingles, each as often as it occurs, sorted."""

    def run(columns):
        return columns[0], [np.repeat(u, n).tobytes() for u, n in shingle_sets(columns[1])]

    return map_rows(texts.select("node", "text"), "node bigint, vector binary", run, CHUNK, 1)


def _counted(vector: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.frombuffer(vector, np.uint64), return_counts=True)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], weights: Weights) -> float:
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = float((np.minimum(a[1][i], b[1][j]) * weights(common)).sum(dtype=np.float64))
    total = sum(float((n * weights(u)).sum(dtype=np.float64)) for u, n in (a, b))
    return shared / (total - shared) if total > shared else 1.0


def difference(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], weights: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
    """Keys, amounts and weights of what a has more of than b and, with inverted keys, less of; the weights of a and of b."""
    every, at = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    more = np.bincount(at, np.concatenate([a[1], -b[1]]), len(every))
    some = more != 0
    idf = weights(every)
    wa, wb = (float((np.bincount(part, n, len(every)) * idf).sum()) for part, n in ((at[: len(a[0])], a[1]), (at[len(a[0]) :], b[1])))
    amounts = np.abs(more[some])
    return np.where(more[some] > 0, every[some], ~every[some]), amounts.astype(np.int64), amounts * idf[some], wa, wb


def moved(vector: tuple[np.ndarray, np.ndarray], keys: np.ndarray, amounts: np.ndarray) -> bytes:
    """The vector with what the keys of a difference say added or, for those of the inverted keys, taken away."""
    counts = dict(zip(vector[0].tolist(), vector[1].tolist()))
    inverted = ~keys
    for k, other, n in zip(keys.tolist(), inverted.tolist(), amounts.tolist()):
        if other in counts:
            counts[other] -= n
        else:
            counts[k] = counts.get(k, 0) + n
    held = sorted((k, n) for k, n in counts.items() if n > 0)
    return np.repeat(np.array([k for k, _ in held], np.uint64), [n for _, n in held]).tobytes()


def _with_vectors(pairs: DataFrame, vectors_: DataFrame) -> DataFrame:
    left, right = vectors_.select(F.col("node").alias("a"), F.col("vector").alias("x")), vectors_.select(F.col("node").alias("b"), F.col("vector").alias("y"))
    return pairs.join(left, "a").join(right, "b")


def compare(pairs: DataFrame, vectors_: DataFrame, weights) -> DataFrame:
    """pairs (a, b) of nodes with a similarity of SIMILARITY or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = [None, None]  # a hub's rows come together

        def load(node, data):
            if last[0] != node:
                last[:] = node, _counted(data.as_py())
            return last[1]

        for batch in batches:
            out = [], []
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if weighted_jaccard(_counted(x.as_py()), load(b, y), weights.value) >= SIMILARITY:
                    out[0].append(a)
                    out[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b"])

    return _with_vectors(pairs, vectors_).select("a", "b", "x", "y").mapInArrow(tidy(run), "a bigint, b bigint")


def components(edges: DataFrame, space: Workspace) -> DataFrame:
    """node, root: the smallest node reached, for every node of the edges (a, b). Nodes hook to their smallest neighbour, chains of
    hooks are halved until they are flat, and the edges between the roots go on. All in joins; only counts come to the driver."""
    edges = space.stored(edges.filter("a <> b").select("a", "b"), "edges")
    roots: DataFrame | None = None
    while edges.limit(1).count():
        both = edges.union(edges.select("b", "a"))
        hooks = space.stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root")), "hooks")
        while True:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("top"))
            jumped = space.stored(hooks.join(up, "root").select("node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")), "hooks")
            hooks = jumped.select("node", "root")
            if not jumped.filter("moved").limit(1).count():
                break
        if roots is None:
            roots = hooks
        else:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("top"))
            roots = space.stored(roots.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots")
        a, b = hooks.select(F.col("node").alias("a"), F.col("root").alias("ra")), hooks.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = space.stored(edges.join(a, "a").join(b, "b").filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "edges")
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def shared_weights(rest: DataFrame, vectors_: DataFrame, weights) -> DataFrame:
    """node, shared: the weight of a node's shingles that some node of another component of rest (node, root) holds as well."""

    def run(columns):
        out = [], [], [], []
        for node, root, data in zip(*columns):
            u, n = _counted(data)
            for column, value in zip(out, (node, root, u.view(np.int64), (n * weights.value(u)).astype(np.float64))):
                column.append(value)
        return out

    schema = "node bigint, root bigint, shingles array<bigint>, weights array<double>"
    rows = map_rows(vectors_.join(rest.select("node", "root").distinct(), "node").select("node", "root", "vector"), schema, run, CHUNK, 2)
    rows = rows.select("node", "root", F.explode(F.arrays_zip("shingles", "weights")).alias("s")).select("node", "root", F.col("s.shingles").alias("shingle"), F.col("s.weights").alias("w"))
    common = rows.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("shingle")
    return rows.join(common, "shingle").groupBy("node").agg(F.sum("w").alias("shared"))


def _rest_nodes(rest: DataFrame, vectors_: DataFrame, weights) -> DataFrame:
    """rest (band, node, root, weight) with `most`, the weight up to which a node can have a partner; nodes that can't have any go.

    What two nodes have in common weighs at most what either shares with other components, and a similarity s needs it to weigh
    s / (1 + s) of both totals. So a node of weight w and shared weight h only pairs with weights from s w to (1 + s) / s h - w."""
    ratio = (1 + SIMILARITY) / SIMILARITY
    rest = rest.join(shared_weights(rest, vectors_, weights), "node")
    return rest.withColumn("most", F.col("shared") * ratio * SLACK - F.col("weight")).drop("shared").filter(F.col("most") >= F.col("weight") * SIMILARITY / SLACK)


def _able() -> Column:
    """Two nodes (ra, wa, ma and rb, wb, mb) of different components that their weights still allow to be similar."""
    return (F.col("ra") != F.col("rb")) & (F.col("wb") <= F.col("ma")) & (F.col("wa") <= F.col("mb")) & (F.least("wa", "wb") * SLACK >= SIMILARITY * F.greatest("wa", "wb"))


def _still_split(rest: DataFrame, space: Workspace) -> DataFrame:
    """The rows of bands whose members are of several components. The bands are written first: a hot one can then be dealt out."""
    rest = space.stored(rest, "rest")
    split = space.stored(rest.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("band"), "split")
    return space.stored(rest.join(split, "band"), "rest")


def _hub_pairs(rest: DataFrame, turn: int, space: Workspace) -> DataFrame:
    """a, b, ra, rb: each node with one further hub of its band: in odd turns the one that shares most of its weight with other
    components, else one drawn by hash."""
    place = F.col("most") / F.col("weight") if turn % 2 else F.lit(0.0)
    hub = F.max_by(F.struct("node", "root", "weight", "most"), F.struct(F.round(place, 4), F.xxhash64("node", F.lit(turn)))).alias("h")
    hubs = rest.groupBy("band").agg(hub).select("band", F.col("h.node").alias("b"), F.col("h.root").alias("rb"), F.col("h.weight").alias("wb"), F.col("h.most").alias("mb"))
    x = rest.select("band", F.col("node").alias("a"), F.col("root").alias("ra"), F.col("weight").alias("wa"), F.col("most").alias("ma"))
    return x.join(space.stored(hubs, "hubs"), "band").filter(_able()).select("a", "b", "ra", "rb").distinct()


def combinations(sizes: list[float], need: float, count: int) -> Iterator[tuple[int, ...]]:
    """The places of `count` units that can be the first of a set of units (in this order) whose sizes add up to need or more."""
    left = np.concatenate([np.cumsum(sizes[::-1])[::-1], [0.0]])

    def go(start: int, held: float, chosen: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        if len(chosen) == count:
            yield chosen
            return
        for i in range(start, len(sizes)):
            if held + left[i] < need:
                return
            yield from go(i + 1, held + sizes[i], (*chosen, i))

    return go(0, 0.0, ())


def requests(units: list[tuple[int, int, float]], need: float) -> tuple[list[int], list[int]]:
    """Codes that a node asks for, and codes under which it is found. units: holders, fingerprint and size of each.

    Two nodes meet if they share units of `need` or more. If the heaviest of a node's units show that this takes c units, it asks for
    the c (at most `TOGETHER`) rarest of them at once. A node of more than `NARROW` units asks and is found by single ones only."""
    units = sorted(units)
    sizes, marks = [u[2] for u in units], [u[1] for u in units]
    if sum(sizes) < need:
        return [], []
    count = int(np.searchsorted(np.cumsum(sorted(sizes, reverse=True)), need)) + 1
    code = lambda c: hash((len(c), *(marks[i] for i in c))) & (1 << 63) - 1  # noqa: E731  of integers alone: the same in every process
    made = lambda n: [code(c) for c in combinations(sizes, need, n)]
    if len(units) > NARROW:
        single = made(1)
        return single, single
    return made(min(count, TOGETHER)) if need > 0 else [], [c for n in range(1, TOGETHER + 1) for c in made(n)]


def _pairs_by_differences(rest: DataFrame, hubs: DataFrame, vectors_: DataFrame, weights, space: Workspace) -> DataFrame:
    """a, b, ra, rb: what is left and may still be similar. hubs: the first hub of each band, around which its nodes are gathered.

    A group's centre is its hub, with every difference that more than half of its nodes have made the centre's own. Let D be what a node
    has more or less of than the centre, and W weights. x and y are similar if W(x - y) is at most g (W(x) + W(y)) with
    g = (1 - s) / (1 + s), and W(x - y) = W(Dx) + W(Dy) - 2 W(what Dx and Dy share). With e = W(D) - g W, they must share (ex + ey) / 2.
    Nodes with ex + e of the least node of at most 0 are similar to that one whatever they share. Any other x must share
    `need` = (ex + least e) / 2 at least; see requests(). Differences with the same holders are one unit, so that a passage that
    some nodes have instead of another counts once, however many shingles it has."""
    g = (1 - SIMILARITY) / (1 + SIMILARITY)
    fields = "a bigint, hub bigint, e double, slack double, keys array<bigint>, amounts array<bigint>, sizes array<double>"

    def apart(rows: DataFrame) -> DataFrame:
        """rows: a, hub, x, y (vectors). fields."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[list] = [[] for _ in range(7)]
                for a, hub, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                    keys, amounts, sizes, wx, wc = difference(_counted(x.as_py()), _counted(y.as_py()), weights.value)
                    for column, value in zip(out, (a, hub, float(sizes.sum()) - g * wx, 1e-6 * (wx + wc), keys.view(np.int64), amounts, sizes)):
                        column.append(value)
                types = pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["a", "hub", "e", "slack", "keys", "amounts", "sizes"])

        return rows.select("a", "hub", "x", "y").mapInArrow(tidy(run), fields)

    nodes = rest.select(F.col("node").alias("a"), "root", "weight", "most").distinct()
    pairs = space.stored(rest.join(hubs, "band").filter("node <> hub").select(F.col("node").alias("a"), "hub").distinct(), "gathered")
    of = lambda k, c: vectors_.select(F.col("node").alias(k), F.col("vector").alias(c))
    own = pairs.join(of("a", "x"), "a")
    first = apart(own.join(of("hub", "y"), "hub")).select("hub", F.explode(F.arrays_zip("keys", "amounts")).alias("d"))
    shared = first.groupBy("hub", F.col("d.keys").alias("key"), F.col("d.amounts").alias("amount")).agg(F.count("*").alias("n"))
    common = shared.join(pairs.groupBy("hub").agg(F.count("*").alias("m")), "hub").filter(F.col("n") * 2 > F.col("m"))
    common = common.groupBy("hub").agg(F.collect_list("key").alias("keys"), F.collect_list("amount").alias("amounts"))
    changed = pairs.select("hub").distinct().join(of("hub", "y"), "hub").join(common, "hub", "left")

    def centre(columns):
        return columns[0], [moved(_counted(v), np.array(k or [], np.int64).view(np.uint64), np.array(n or [], np.int64)) for v, k, n in zip(*columns[1:])]

    centres = space.stored(map_rows(changed.select("hub", "y", "keys", "amounts"), "hub bigint, y binary", centre, CHUNK, 1), "centres")
    rows = space.stored(apart(own.join(centres, "hub")).drop("amounts").join(nodes, "a"), "differences")
    least = space.stored(rows.groupBy("hub").agg(F.min_by("a", "e").alias("to"), F.min_by("root", "e").alias("to_root"), F.min("e").alias("least")), "least")
    rows = rows.join(least, "hub")
    sure = rows.filter((F.col("e") + F.col("least") <= F.col("slack")) & (F.col("root") != F.col("to_root"))).select("a", F.col("to").alias("b"), F.col("root").alias("ra"), F.col("to_root").alias("rb"))
    each = rows.withColumn("need", (F.col("e") + F.col("least")) / 2 - F.col("slack")).withColumn("d", F.explode(F.arrays_zip("keys", "sizes")))
    each = space.stored(each.select("hub", F.col("d.keys").alias("key"), "a", "root", "need", F.col("d.sizes").alias("size")), "differences")
    mark = lambda seed: F.bit_xor(F.xxhash64("a", F.lit(seed)))
    holders = each.groupBy("hub", "key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), mark(1).alias("mark")).filter("low <> high")
    held = each.join(space.stored(holders.select("hub", "key", "n", "mark"), "holders"), ["hub", "key"])
    units = held.groupBy("hub", "a", "need", "n", "mark").agg(F.sum("size").alias("size")).groupBy("hub", "a", "need").agg(F.collect_list("n").alias("n"), F.collect_list("mark").alias("mark"), F.collect_list("size").alias("size"))

    def told(columns):
        out: list[list] = [[], [], [], []]
        for hub, a, need, *lists in zip(*columns):
            for column, value in zip(out, (hub, a, *requests(list(zip(*lists)), need))):
                column.append(value)
        return out

    codes = space.stored(map_rows(units, "hub bigint, a bigint, asks array<bigint>, has array<bigint>", told), "codes").join(nodes, "a")
    side = lambda c, k: codes.select("hub", F.explode(c).alias("code"), F.col("a").alias(k), F.col("root").alias(f"r{k}"), F.col("weight").alias(f"w{k}"), F.col("most").alias(f"m{k}"))
    met = side("asks", "a").join(side("has", "b"), ["hub", "code"]).filter(_able()).select("a", "b", "ra", "rb").union(sure.select("a", "b", "ra", "rb"))
    turned = F.col("a") > F.col("b")
    pick = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x)).alias(x)
    return met.select(pick("a", "b"), pick("b", "a"), pick("ra", "rb"), pick("rb", "ra")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id for every row of docs, key, the md5 of its text, root, one number for each class, and first, the class's
    smallest doc_id."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    weights, space = spark.sparkContext.broadcast(inverse_document_frequencies(docs)), Workspace(spark, "near-dup")  # 8 MB at most
    signed = space.stored(signatures(docs, weights), "signatures")
    nodes = signed.groupBy("key").agg(F.min("doc_id").alias("first"), F.first("bands").alias("bands"), F.first("weight").alias("weight"))
    nodes = space.stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    members = nodes.select(F.explode("bands").alias("band"), "node", "weight")
    sizes = space.stored(members.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    members = space.stored(members.join(sizes, "band"), "members")
    # a band's hub is the member that meets the most others in all its bands: of a group of edited copies, one near their origin
    degrees = members.groupBy("node").agg(F.sum("n").alias("degree"))
    place = F.shiftleft("degree", 20) + F.pmod(F.xxhash64("node"), F.lit(1 << 20))
    hubs = space.stored(members.select("band", "node").join(degrees, "node").groupBy("band").agg(F.max_by("node", place).alias("hub")), "hubs")
    stars = members.select("band", "node").join(hubs, "band").filter("node <> hub")
    stars = space.stored(stars.select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), "stars")
    used = members.select("node").distinct().join(nodes.select("node", "key", "first"), "node")
    none = F.lit(-(1 << 63))
    texts = _keyed(docs).withColumn("id", F.coalesce("doc_id", none)).join(used.withColumn("id", F.coalesce("first", none)), ["key", "id"])
    texts = space.stored(vectors(texts).dropDuplicates(["node"]), "vectors")
    links = space.stored(compare(stars, texts, weights), "links")
    known = components(links, space)
    roots = space.stored(members.select("node").distinct().join(known, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "roots")
    rest = _still_split(members.select("band", "node", "weight").join(roots, "node"), space)
    rest = _rest_nodes(rest, texts, weights)
    for turn in range(1, HUBS + 1):
        rest = _still_split(rest, space)
        pairs = space.stored(_hub_pairs(rest, turn, space) if turn < HUBS else _pairs_by_differences(rest, hubs, texts, weights, space), "rest-pairs")
        more = compare(pairs.select("a", "b"), texts, weights).join(pairs, ["a", "b"]).select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        upper = components(more, space).select(F.col("node").alias("root"), F.col("root").alias("top"))
        up = lambda x: x.join(upper, "root", "left").withColumn("root", F.coalesce("top", "root")).drop("top")
        roots, rest = space.stored(up(roots), "roots"), up(rest)
    named = nodes.select("node", "key", "first").join(roots, "node", "left").select("key", "first", F.coalesce("root", "node").alias("root"))
    named = space.stored(named, "named")
    ids = named.groupBy("root").agg(F.min("first").alias("least"), F.min("key").alias("lead"))
    owners = ids.groupBy("least").agg(F.min_by("root", "lead").alias("root")).select("root", F.lit(True).alias("owns"))
    low, high = signed.agg(F.min("doc_id"), F.max("doc_id")).first()
    top = nodes.agg(F.max("node")).first()[0] or 0
    down = (low or 0) - 1 - top >= -(1 << 63)  # room below the ids for a number a root, else above them
    fresh = F.lit((low or 0) - 1) - F.col("root") if down else F.lit((high or 0) + 1) + F.col("root")
    ids = ids.join(owners, "root", "left").select("root", "least", F.when(F.col("owns"), F.col("least")).otherwise(fresh).alias("class_id"))
    classes = space.stored(named.join(space.stored(ids, "ids"), "root").select("key", "class_id", "root", F.col("least").alias("first")), "classes")
    found = stored(signed.select("doc_id", "key").join(classes, "key").select("doc_id", "class_id", "key", "root", "first"), "near-dup-classes")
    weights.destroy()
    space.clear()
    return found


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each class, all columns kept: that of the class's smallest doc_id (of rows that share it, one)."""
    found = near_duplicates(docs).filter(F.col("doc_id").eqNullSafe(F.col("first"))).groupBy("root", "first", "key").count()
    keep = found.groupBy("root", "first").agg(F.min(F.struct("key", "count")).alias("k"))
    keep = stored(keep.select(F.col("first").alias("_nd_id"), F.col("k.key").alias("_nd_key"), F.col("k.count").alias("_nd_rows")), "kept")
    key = F.unhex(F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary")))
    own = docs["doc_id"].eqNullSafe(F.col("_nd_id")) & (key == F.col("_nd_key"))
    if not keep.filter("_nd_rows > 1").limit(1).count():
        return docs.join(keep, own, "left_semi")
    more = docs.join(keep.filter("_nd_rows > 1"), own, "left_semi").withColumn("_nd_own", key).dropDuplicates(["doc_id", "_nd_own"]).drop("_nd_own")
    return docs.join(keep.filter("_nd_rows = 1"), own, "left_semi").union(more)


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")
