"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver did, if it lies outside their path."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset and Spark runs in one process, as in
    tests, a temporary folder of this process, removed at its end; on a cluster it must be set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (folder or _own_dir()).rstrip("/")


@functools.cache
def _own_dir() -> str:
    folder = tempfile.mkdtemp(prefix="ablatrix-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/ablatrix/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet in the shared folder and reads it again, so lost executors lose nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Workspace:
    """The tables that an operator writes on its way, in a folder of their own in the shared one. What the operator returns is
    written elsewhere, so clear() can remove them all."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.n = spark, scratch(spark, name), 0

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        remove(self.spark, self.path)


def remove(spark: SparkSession, path: str) -> None:
    """Removes path and all in it from whatever file system holds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def hand_back() -> None:
    """Gives freed memory back to the system. Python workers outlive their tasks, and what they keep adds up on an executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with the memory it has freed handed back when a task is through."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            hand_back()

    return tidied


def map_rows(
    df: DataFrame, schema: str, fn: Callable[[Sequence[list]], list[Sequence]], chunk_bytes: int = 8 << 20, size_column: int | None = None
) -> DataFrame:
    """mapInArrow whose fn gets Python lists of the columns and returns the output columns.

    A batch is handed over in chunks of at most chunk_bytes of the column size_column (single long values excepted)."""
    arrow_schema = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut(batch, size_column, chunk_bytes):
                columns = fn([c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, arrow_schema)], schema=arrow_schema
                )

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    parsed = StructType.fromDDL(schema)
    arrow_schema = to_arrow_schema(parsed)
    return df.mapInArrow(tidy(run), parsed)


def cut(batch: pa.RecordBatch, size_column: int | None, chunk_bytes: int) -> Iterable[pa.RecordBatch]:
    if size_column is None or batch.num_rows <= 1 or batch.nbytes <= chunk_bytes:
        yield batch
        return
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(size_column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > chunk_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)


def empty_text(column: str = "text") -> F.Column:
    return F.coalesce(F.col(column), F.lit(""))
