"""Vector code compression (operator 11): product codes whose nearest entries are found through a VA-file.

Components become integers, floor(1024 x). Vectors are cut into `PARTS` consecutive parts, and each part is coded by its nearest of
up to `ENTRIES` codebook entries. Codebooks start from the vectors of the smallest ids and are refined by `ROUNDS` rounds of
assignment and floored means, each one pass over all vectors: tasks hand on counts and sums of entries, never vectors.

The assignment quantises each coordinate of the entries into 2^`BITS` cells. For each part to be coded a lookup table holds, by
coordinate and cell, the least and the greatest squared distance; their sums over an entry's cells bound its distance from below and
above. Entries whose lower bound exceeds the least upper bound can't be nearest; the rest are measured in exact integers.

Left out are vectors that are null or hold null or non-finite components. Vectors of each length have codebooks of their own (one
length after another); lengths that don't divide by PARTS give parts of lengths one apart, and empty vectors have the code of zeros
and no error. Null ids come after all others when a codebook starts, and are coded like others; rows with equal ids, and repeated
rows, count each, in order of their bytes. With fewer than ENTRIES vectors there are as many entries. Distances have no bound
inside; an error, or a sum over such, that doesn't fit a long is null. Empty tables give no rows. Extra columns are ignored: only vec_id, label and
embedding are read, and label only for sums."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Workspace, stored, table
from .vectors import DISTANCE, KEPT, SUMS, Sums, exact, integers, kind_of, longs, mapped, sql_means, total, unbounded, whole_vectors, with_facts

PARTS, ENTRIES, ROUNDS, BITS = 4, 256, 4, 5
#: Vectors that are coded at once.
CHUNK = 1024


class Cells:
    """A VA-file over the entries of one part."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries = entries
        n, low = 1 << bits, entries.min(axis=0)
        width = (entries.max(axis=0) - low) // n + 1
        self.cell = ((entries - low) // width).astype(int)
        steps = np.arange(n).astype(entries.dtype)
        self.low = low[:, None] + width[:, None] * steps[None]  # (coordinate, cell), both ends included
        self.high = self.low + width[:, None] - 1

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, entries): the least and the greatest squared distance of each row to each entry's cells."""
        least = np.zeros((len(x), len(self.entries)), x.dtype)
        most = least.copy()
        for i in range(x.shape[1]):
            below, above = self.low[i] - x[:, i, None], x[:, i, None] - self.high[i]
            near, far = np.maximum(np.maximum(below, above), 0), np.maximum(-below, -above)
            least += (near * near)[:, self.cell[:, i]]
            most += (far * far)[:, self.cell[:, i]]
        return least, most

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row (of equal ones the first) and its squared distance."""
        if not len(x):
            return np.zeros(0, int), np.zeros(0)
        if x.dtype != self.entries.dtype:
            return Cells(unbounded(self.entries)).nearest(unbounded(x))
        least, most = self.bounds(x)
        row, entry = np.nonzero(least <= most.min(axis=1)[:, None])
        gap = x[row] - self.entries[entry]
        d = (gap * gap).sum(axis=1)
        best = np.minimum.reduceat(d, np.searchsorted(row, np.arange(len(x))))
        hit = np.flatnonzero(d == best[row])
        return entry[hit[np.unique(row[hit], return_index=True)[1]]], best


class Codebooks:
    """Codebooks of the parts of vectors of one length."""

    def __init__(self, size: int, entries: list[list[list[int]]]):
        """entries: by part and entry, the components."""
        self.size, self.cuts = size, [size * i // PARTS for i in range(PARTS + 1)]
        self.entries = entries

    @classmethod
    def of(cls, x: np.ndarray) -> Codebooks:
        """That start from the rows of x."""
        cuts = [x.shape[1] * i // PARTS for i in range(PARTS + 1)]
        return cls(x.shape[1], [[[int(v) for v in row] for row in x[:, a:b]] for a, b in zip(cuts, cuts[1:])])

    def cells(self) -> list[Cells]:
        return [Cells(exact(part, b - a)) for part, a, b in zip(self.entries, self.cuts, self.cuts[1:])]

    def codes(self, x: np.ndarray, cells: list[Cells]) -> tuple[np.ndarray, np.ndarray]:
        """(rows, PARTS) of entries and of squared distances. cells: those of cells()."""
        found = [c.nearest(x[:, a:b]) for c, a, b in zip(cells, self.cuts, self.cuts[1:])]
        return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)

    def decode(self, code: str) -> list[int]:
        """The components that a code stands for."""
        return [v for part, i in zip(self.entries, bytes.fromhex(code)) for v in part[i]]

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(v) for part in self.entries for entry in part for v in entry).encode()).hexdigest()

    def refined(self, vectors: DataFrame, kind: str) -> Codebooks:
        """With each entry that is used replaced by the floored mean of its parts."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, cells = Sums(), self.cells()
            for x in _chunks(batches, self.size, kind, 0):
                codes, _ = self.codes(x, cells)
                for p, (a, b) in enumerate(zip(self.cuts, self.cuts[1:])):
                    order = np.argsort(codes[:, p], kind="stable")
                    used, starts = np.unique(codes[order, p], return_index=True)
                    added = np.add.reduceat(x[order, a:b], starts, axis=0) if b > a else np.zeros((len(used), 0))
                    for entry, n, s in zip(used.tolist(), np.diff([*starts, len(x)]).tolist(), added):
                        sums.add(p * ENTRIES + entry, n, s)
            yield sums.batch()

        found = total(mapped(vectors.select("data"), SUMS, run))
        mean = lambda p, e, old: [s // found[p * ENTRIES + e][0] for s in found[p * ENTRIES + e][1]] if p * ENTRIES + e in found else old
        return Codebooks(self.size, [[mean(p, e, old) for e, old in enumerate(part)] for p, part in enumerate(self.entries)])

    def encode(self, vectors: DataFrame, kind: str) -> DataFrame:
        """vec_id, label, code, error (null: beyond a long) of vectors (vec_id, label, data)."""
        schema = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, label {vectors.schema['label'].dataType.simpleString()}, code string, error bigint"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells = self.cells()
            for batch in batches:
                for at in range(0, batch.num_rows, CHUNK):
                    part = batch.slice(at, CHUNK)
                    codes, errors = self.codes(integers(part.column(2).to_pylist(), self.size, kind), cells)
                    texts = [row.tobytes().hex() for row in codes.astype(np.uint8)]
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts), longs(errors.sum(axis=1).tolist())], names=["vec_id", "label", "code", "error"])

        return mapped(vectors.select("vec_id", "label", "data"), schema, run)


def _chunks(batches: Iterator[pa.RecordBatch], size: int, kind: str, column: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            yield integers(batch.column(column).slice(at, CHUNK).to_pylist(), size, kind)


def train(vectors: DataFrame, size: int, kind: str, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks over all of vectors (vec_id, data), which are of one length."""
    first = vectors.select("vec_id", "data", F.col("vec_id").isNull().alias("last")).orderBy("last", "vec_id", "data").limit(entries).collect()
    books = Codebooks.of(integers([bytes(r["data"]) for r in first], size, kind))
    for _ in range(rounds):
        books = books.refined(vectors, kind)
    return books


def compressed(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector that is kept."""
    spark, kind = vectors.sparkSession, kind_of(vectors)
    space = Workspace(spark, "codes")
    kept = space.stored(whole_vectors(vectors, "vec_id", "label"), "vectors")
    coded = None
    for row in kept.groupBy("size").count().orderBy("size").collect():  # a row for each length
        own = kept.filter(F.col("size") == row["size"])
        books = train(own, row["size"], kind)
        rows = books.encode(own, kind).withColumn("codebooks_sha256", F.lit(books.digest()))
        coded = rows if coded is None else coded.union(rows)
    if coded is None:
        types = vectors.schema["vec_id"].dataType.simpleString()
        return spark.createDataFrame([], f"vec_id {types}, code string, error bigint, label_error bigint, codebooks_sha256 string")
    coded = space.stored(coded, "coded")
    big = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = coded.groupBy("label").agg(F.when(F.count("error") == F.count("*"), big).try_cast("bigint").alias("label_error"), F.count("*").alias("rows"))
    found = with_facts(coded, space.stored(sums, "labels"), "label", "rows", coded.count())
    found = stored(found.select("vec_id", "code", "error", "label_error", "codebooks_sha256"), "codes-found")
    space.clear()
    return found


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(table(spark, sf_dir, "embeddings"))


def oracle() -> str:
    """The query as SQL, for vectors of one length."""
    steps = [
        KEPT, f"parts AS MATERIALIZED (SELECT vec_id, p, v[p * len(v) // {PARTS} + 1:(p + 1) * len(v) // {PARTS}] AS x FROM kept, range({PARTS}) t(p))",
        f"c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts QUALIFY e < {ENTRIES})",
    ]
    for r in range(ROUNDS + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, p, x, m // {ENTRIES} AS d, m % {ENTRIES} AS e FROM (SELECT vec_id, p, any_value(x) AS x, min({DISTANCE} * {ENTRIES} + e) AS m FROM parts JOIN c{r} USING (p) GROUP BY vec_id, p))")
        if r < ROUNDS:
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN {sql_means(f'a{r}', 'p, e')} m USING (p, e))")
    steps.append(f"coded AS (SELECT vec_id, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id)")
    digest = f"(SELECT sha256(string_agg(y::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) FROM (SELECT p, e, unnest(c) AS y, generate_subscripts(c, 1) AS i FROM c{ROUNDS}))"
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, {digest} AS codebooks_sha256 FROM coded JOIN kept USING (vec_id)"
