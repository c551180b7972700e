"""Tables that an analysis writes on its way, in a folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import functools
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset and Spark runs in one process, a temporary folder of this process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (folder or _own()).rstrip("/")


@functools.cache
def _own() -> str:
    folder = tempfile.mkdtemp(prefix="ablatrix-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


class Store:
    """A folder of its own in the shared one (or in `folder`) for tables that are written once."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.path, self.n = spark, f"{(folder or shared(spark)).rstrip('/')}/work-{uuid.uuid4().hex}", 0

    def put(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


class Runs:
    """The runs that are known: a table that is only added to. Rows of a state, a digest of all that decides the outcome, stand for
    every analysis of that state."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def rows(self) -> DataFrame:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def of(self, states: DataFrame) -> DataFrame:
        """Those of states (patch_id, state), each repetition once."""
        own = self.rows().join(states.select("patch_id", "state"), ["patch_id", "state"], "left_semi")
        return own.dropDuplicates(["patch_id", "variant_kind", "variant_key", "rep"])

    def add(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)
