"""Helpers of the operators on vectors: whole vectors as bytes, exact integers, sums over tasks, joins back to hot keys."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .common import tidy

#: Components are multiplied by this and floored.
SCALE = 1024
LONG = 1 << 63
#: So many keys at most can hold such a share of the rows each: they are broadcast.
HOT = 1000


def whole_vectors(df: DataFrame, *carried: str, others: bool = False, zeros: bool = True) -> DataFrame:
    """carried, size, data: the rows whose `embedding` is not null and has no null or non-finite component (nor, without zeros, only
    zeros). data holds the components' bytes, in single precision where the column is, else in double. With others, the other rows
    come too, with null data."""
    found = df.schema["embedding"].dataType.simpleString()
    single = found == "array<float>"
    kind, width = ("f4", 4) if single else ("f8", 8)
    schema = T.StructType([*(T.StructField(c, df.schema[c].dataType) for c in carried), T.StructField("size", T.IntegerType()), T.StructField("data", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(carried))
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False), kind)  # nulls turn into NaN
            ends = np.cumsum(sizes)
            counted = lambda flags: np.concatenate([[0], np.cumsum(flags)])
            within = lambda c: c[ends] - c[ends - sizes]
            good = pc.is_valid(lists).to_numpy(zero_copy_only=False) & (within(counted(~np.isfinite(flat))) == 0)
            if not zeros:
                good &= within(counted(flat != 0)) > 0
            keep = np.arange(len(good)) if others else np.flatnonzero(good)
            raw = flat.tobytes()
            data = [raw[(ends[i] - sizes[i]) * width : ends[i] * width] if good[i] else None for i in keep]
            at = pa.array(keep)
            columns = [*(batch.column(i).take(at) for i in range(len(carried))), pa.array(sizes[keep], pa.int32()), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    x = F.col("embedding") if single else F.col("embedding").cast("array<double>")
    return df.select(*carried, x.alias("embedding")).mapInArrow(tidy(run), schema)


def kind_of(df: DataFrame) -> str:
    """The type of the components that whole_vectors() gives for df."""
    return "f4" if df.schema["embedding"].dataType.simpleString() == "array<float>" else "f8"


def floats(data: Iterable[bytes], size: int, kind: str) -> np.ndarray:
    """(rows, size), in double precision."""
    data = list(data)
    return np.frombuffer(b"".join(data), kind).reshape(len(data), size).astype(np.float64)


def integers(data: Iterable[bytes], size: int, kind: str) -> np.ndarray:
    """floor(SCALE * x) of each component: float64 where sums of squared differences are exact in it, else Python's integers."""
    x = floats(data, size, kind)
    y = np.floor(x * SCALE)
    top = np.abs(y).max(initial=0.0)
    if 4 * size * top * top < 1 << 53:
        return y
    exact = lambda v: int(v) * SCALE if abs(v) > 1e300 else math.floor(v * SCALE)
    return np.array([[exact(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


def unbounded(x: np.ndarray) -> np.ndarray:
    """Integers in any form as Python's."""
    return x if x.dtype == object else np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x and y, exactly: both come from integers() or are floored means of such."""
    if x.dtype == object or y.dtype == object:
        x, y = unbounded(x), unbounded(y)
        return np.array([[sum((a - b) ** 2 for a, b in zip(u, v)) for v in y] for u in x], object).reshape(len(x), len(y))
    return (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (x @ y.T)


def exact(rows: list[list[int]], size: int) -> np.ndarray:
    """Integer rows in the form that integers() gives."""
    top = max((abs(v) for r in rows for v in r), default=0)
    return np.array(rows, np.float64 if 4 * size * top * top < 1 << 53 else object).reshape(len(rows), size)


def longs(values: Iterable) -> pa.Array:
    """Exact integers as longs; null where they don't fit."""
    return pa.array([int(v) if v < LONG else None for v in values], pa.int64())


class Sums:
    """Counts and exact component sums by key, over all that a task sees."""

    def __init__(self):
        self.held: dict[int, list] = {}

    def add(self, key: int, n: int, total: np.ndarray) -> None:
        old = self.held.setdefault(key, [0, 0])
        old[0], old[1] = old[0] + n, old[1] + np.array([int(v) for v in total], object)

    def batch(self) -> pa.RecordBatch:
        """Sums are written as text: they have no bound."""
        texts = [",".join(map(str, s)) for _, s in self.held.values()]
        return pa.RecordBatch.from_arrays([pa.array([*self.held], pa.int64()), pa.array([n for n, _ in self.held.values()], pa.int64()), pa.array(texts, pa.string())], names=["key", "n", "sums"])


SUMS = "key bigint, n bigint, sums string"


def total(parts: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """By key: count and component sums over all tasks' Sums. Sums of a key meet in one task, a row a task before; as many rows as
    there are keys come to the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for batch in batches:
            for key, n, text in zip(*(c.to_pylist() for c in batch.columns)):
                sums.add(key, n, np.array([int(v) for v in text.split(",") if v], object))
        yield sums.batch()

    rows = parts.repartition("key").mapInArrow(add, SUMS).collect()
    return {r["key"]: (r["n"], [int(v) for v in r["sums"].split(",") if v]) for r in rows}


def with_facts(rows: DataFrame, facts: DataFrame, key: str, n: str, count: int) -> DataFrame:
    """rows (`count` of them) with the columns of facts, which has a row for every key (null keys equal each other) and, in column
    n, its number of rows. Keys that hold a `HOT`th of all rows or more, HOT at most, go to every task; only the rest is shuffled."""
    often = F.col(n) * HOT >= count
    known = lambda x: x.drop(n).withColumnRenamed(key, "_key")
    hot, rest = known(facts.filter(often)), known(facts.filter(~often))
    same = F.col(key).eqNullSafe(F.col("_key"))
    met = rows.join(F.broadcast(hot), same)
    others = rows.join(F.broadcast(hot.select("_key")), same, "left_anti").join(rest, same)
    return met.drop("_key").unionByName(others.drop("_key"))


def mapped(df: DataFrame, schema: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    return df.mapInArrow(tidy(run), schema)

# ---------------------------------------------------------------- SQL

#: The kept vectors as exact integers in double precision, for SQL over tables of small components.
KEPT = f"""kept AS MATERIALIZED (SELECT * EXCLUDE embedding, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""
#: Squared distances of lists x and c.
DISTANCE = "(list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c))::BIGINT"


def sql_means(rows: str, keys: str) -> str:
    """keys, c: floored means of the lists x of rows."""
    return f"(SELECT {keys}, list(floor(s / n) ORDER BY i) AS c FROM (SELECT {keys}, i, sum(y) AS s, count(*) AS n FROM (SELECT {keys}, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM {rows}) GROUP BY {keys}, i) GROUP BY {keys})"
