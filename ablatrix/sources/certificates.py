"""Saved certificates: a reader with an explicit schema, relations of what they hold, and a writer of one file a report."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..operators.certificate import RUN_SET
from ..schema import CONTRASTS, ROLES

REF = "struct<ref: string, sha: string>"
MUTATION = "struct<id: string, path: string, label: string, patch: string, kind: string, additions: int, deletions: int, line: int, end_line: int>"
FOUND = f"struct<mutation_ids: array<string>, mutation_labels: array<string>, status: string, runs: {RUN_SET}, apply_error: string>"
SEARCH = f"struct<enabled: boolean, attempted: bigint, budget: bigint, exhaustive_at_found_order: boolean, found_order: int, results: array<{FOUND}>, note: string>"
#: A report as it is saved. `config` and `environment` may hold anything and are kept as JSON text.
REPORT = ", ".join(
    f"{name} {type_}"
    for name, type_ in {
        "schema_version": "int", "tool": "string", "generated_at": "string", "repo": "string", "base": REF, "candidate": REF, "test_command": "string", "config": "string", "contrast": "string",
        "candidate_run": RUN_SET, "baseline_with_candidate_tests_run": RUN_SET, "candidate_test_files_overlaid_on_base": "array<string>",
        "summary": "struct<mutations: bigint, witnessed: bigint, unwitnessed: bigint, inconclusive: bigint, ignored: bigint, witness_ratio: double, minimal_sufficient_order: int, minimal_sufficient_sets: bigint, mutual_backup_pairs: bigint, surplus_candidate_hunks: bigint>",
        "sufficient_search": SEARCH, "interaction_search": SEARCH, "surplus_candidate_mutation_ids": "array<string>", "minimization": "struct<removed_mutation_ids: array<string>, note: string>",
        "mutation_roles": "map<string, struct<role: string, in_minimal_sufficient_set: boolean>>", "results": f"array<struct<mutation: {MUTATION}, status: string, runs: {RUN_SET}, apply_error: string>>",
        "environment": "string", "interpretation": "map<string, string>", "certificate_id": "string",
    }.items()
)
#: Fields without which a file is no certificate, and what their values must be. Fixed values of the format.
REQUIRED = ("schema_version", "tool", "certificate_id", "base", "candidate", "test_command", "contrast", "summary", "results", "sufficient_search", "interaction_search")


def problem(report: Column) -> Column:
    """What is wrong with a report struct, or null."""
    absent = F.array_compact(F.array(*[F.when(report[c].isNull(), F.lit(c)) for c in REQUIRED]))
    strange = F.exists(report["results"], lambda r: r["mutation"]["id"].isNull() | ~F.coalesce(r["status"].isin(*ROLES), F.lit(False)))
    return (
        F.when(F.size(absent) > 0, F.concat(F.lit("missing: "), F.array_join(absent, ", "))).when(report["schema_version"] != 2, F.lit("unknown schema_version"))
        .when(~report["certificate_id"].rlike("^dw2_[0-9a-f]{20}$"), F.lit("malformed certificate_id")).when(~report["contrast"].isin(*CONTRASTS), F.lit("unknown contrast"))
        .when(strange, F.lit("malformed results"))
    )


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """certificates (patch_id, file, certificate_id, report) and what of the files under path is none (file, problem, text).

    Files hold a JSON object each, in any layout. patch_id is the number a file is named by, else a hash of its name."""
    names = T.StructType.fromDDL(REPORT).fieldNames()
    rows = spark.read.schema(f"{REPORT}, _malformed string").option("multiLine", True).option("columnNameOfCorruptRecord", "_malformed").json(path)
    file = F.col("_metadata.file_path")
    rows = rows.select(F.struct(*names).alias("report"), "_malformed", file.alias("file"))
    rows = rows.withColumn("problem", F.when(F.col("_malformed").isNotNull(), F.lit("not JSON of this format")).otherwise(problem(F.col("report"))))
    number = F.regexp_extract("file", r"(\d{1,18})\.json$", 1).try_cast("bigint")
    good = rows.filter("problem is null").select(F.coalesce(number, F.xxhash64("file")).alias("patch_id"), "file", F.col("report.certificate_id").alias("certificate_id"), "report")
    return good, rows.filter("problem is not null").select("file", "problem", F.coalesce("_malformed", F.to_json("report")).alias("text"))


def hunks(certificates: DataFrame) -> DataFrame:
    """A row for each hunk: patch_id, mut_ord, the mutation's fields, status, classification, runtime_s, role, in_minimal_sufficient_set."""
    rows = certificates.select("patch_id", F.posexplode("report.results").alias("mut_ord", "r"), F.col("report.mutation_roles").alias("roles"))
    role = F.element_at("roles", F.col("r.mutation.id"))
    return rows.select(
        "patch_id", "mut_ord", "r.mutation.*", "r.status", F.col("r.runs.classification").alias("classification"), F.col("r.runs.total_duration_s").alias("runtime_s"), role["role"].alias("role"),
        role["in_minimal_sufficient_set"].alias("in_minimal_sufficient_set"),
    )


def runs(certificates: DataFrame) -> DataFrame:
    """A row for each run of candidate, baseline and ablations: patch_id, variant_kind, variant_key, rep and the run's fields."""
    kinds = {"candidate": "candidate_run", "baseline": "baseline_with_candidate_tests_run"}
    whole = [F.struct(F.lit(kind).alias("variant_kind"), F.lit("").alias("variant_key"), F.col(f"report.{c}").alias("runs")) for kind, c in kinds.items()]
    own = F.transform("report.results", lambda r, i: F.struct(F.lit("ablate").alias("variant_kind"), i.cast("string").alias("variant_key"), r["runs"].alias("runs")))
    rows = certificates.select("patch_id", F.inline(F.concat(F.array(*whole), own))).filter("runs is not null")
    return rows.select("patch_id", "variant_kind", "variant_key", F.posexplode("runs.runs").alias("rep", "run")).select("patch_id", "variant_kind", "variant_key", "rep", "run.*")


def files(certificates: DataFrame, markdown: DataFrame) -> DataFrame:
    """name, text: `<patch_id>.json` and `<patch_id>.md` of certificates (patch_id, report) and their markdown (patch_id, markdown)."""
    texts = F.to_json("report", {"ignoreNullFields": "false", "pretty": "true"})
    named = lambda end, text: F.struct(F.concat(F.col("patch_id").cast("string"), F.lit(end)).alias("name"), text.alias("text"))
    one = certificates.select(named(".json", F.concat(texts, F.lit("\n"))).alias("f"))
    return one.union(markdown.select(named(".md", F.col("markdown")).alias("f"))).select("f.*")


@dataclass
class Written(WriterCommitMessage):
    manifest: str
    files: int


class FileWriter(DataSourceWriter):
    """Each row of (name, text) becomes a file in a folder that driver and executors share.

    A task writes a file under a temporary name and renames it in place, so that a name always holds a whole file, the same whichever
    attempt wrote it; its own manifest (name, bytes, sha256) stays in the temporary folder. Committing moves the manifests, one a task, and
    writes the count; a job that was killed leaves no count, and running it again replaces all it left."""

    def __init__(self, options: dict[str, str]):
        self.folder, self.job = Path(options["path"].removeprefix("file://")), uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Written:
        attempt = self.folder / "_temporary" / self.job
        attempt.mkdir(parents=True, exist_ok=True)
        lines = []
        for name, text in iterator:
            if not name or "/" in name or name.startswith(("_", ".")):
                raise ValueError(f"not a name for a file: {name}")
            data = (text or "").encode()
            held = attempt / f"{uuid.uuid4().hex}.part"
            held.write_bytes(data)
            os.replace(held, self.folder / name)
            lines.append(json.dumps({"name": name, "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()}))
        manifest = attempt / f"{uuid.uuid4().hex}.jsonl"
        manifest.write_text("".join(f"{x}\n" for x in lines), encoding="utf-8")
        return Written(manifest.name, len(lines))

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None]
        index = self.folder / "_manifest"
        shutil.rmtree(index, ignore_errors=True)
        index.mkdir(parents=True)
        for m in done:
            os.replace(self.folder / "_temporary" / self.job / m.manifest, index / m.manifest)
        (index / "_COMMITTED").write_text(json.dumps({"files": sum(m.files for m in done), "manifests": len(done)}), encoding="utf-8")
        shutil.rmtree(self.folder / "_temporary", ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.folder / "_temporary" / self.job, ignore_errors=True)


class FileSink(DataSource):
    """format("report_files"): see FileWriter. Option `path`."""

    @classmethod
    def name(cls) -> str:
        return "report_files"

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema: T.StructType, overwrite: bool) -> FileWriter:
        return FileWriter(dict(self.options))


def write_files(rows: DataFrame, path: str) -> None:
    """rows: name (unique), text."""
    rows.sparkSession.dataSource.register(FileSink)
    rows.select("name", "text").write.format("report_files").mode("append").save(path)
