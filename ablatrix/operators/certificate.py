"""The whole report of each patch as one nested row: run sets, searches, roles and interpretation, assembled from relations by patch.

Every list of a report is bounded by the hunks and budgets of its patch, so each is gathered in one aggregate by patch_id, and all
joins are on patch_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.canonical import canonical
from ..schema import ABLATE, APPLY_ERROR, BASELINE, CANDIDATE, MUTUAL_BACKUP, PAIR, SUBSET, SUFFICIENT, UNWITNESSED, WITNESSED
from . import evidence, stability, variants
from .report import CERTIFICATE_PREFIX

SCHEMA_VERSION, TOOL = 2, "ablatrix"
RUN = "duration_s double, returncode int, stderr_tail string, stdout_tail string, timed_out boolean"
RUN_SET = f"struct<classification: string, runs: array<struct<{', '.join(f.replace(' ', ': ') for f in RUN.split(', '))}>>, total_duration_s: double>"
#: What the statuses say, in reports.
INTERPRETATION = {
    "witnessed": "Without this change alone, every run of the evidence failed.",
    "unwitnessed": "Without this change alone, every run of the evidence still passed.",
    "inconclusive": "The change could not be taken off, or runs without it disagreed or ran out of time.",
    "sufficient": "The base with the candidate's tests and only these changes passed every run.",
    "mutual-backup": "Each of the two changes can go alone; without both, every run failed.",
}
#: Fields that a certificate's hash leaves out.
UNHASHED = ("generated_at", "certificate_id")


def run_sets(runs: DataFrame) -> DataFrame:
    """KEYS, classification, run_set (null where nothing ran), apply_error, failure: a row for each variant of runs.

    runs: the fields of runs, with or without apply_error and failure. Runs are in order of repetition."""
    for name in ("apply_error", "failure", "stdout_tail", "stderr_tail"):
        if name not in runs.columns:
            runs = runs.withColumn(name, F.lit(None).cast("string") if name in ("apply_error", "failure") else F.lit(""))
    ran = F.col("apply_error").isNull() & F.col("failure").isNull()
    one = F.struct("rep", *[f.split()[0] for f in RUN.split(", ")])
    kept = lambda name: F.max(name).alias(name)
    rows = runs.groupBy(*variants.KEYS).agg(
        F.array_sort(F.collect_list(F.when(ran, one))).alias("_runs"), stability.classification().alias("_class"), F.round(F.coalesce(F.sum("duration_s"), F.lit(0.0)), 4).alias("_total"), kept("apply_error"), kept("failure")
    )
    some = F.size("_runs") > 0
    plain = F.transform("_runs", lambda r: F.struct(*[r[f.split()[0]].alias(f.split()[0]) for f in RUN.split(", ")]))
    class_ = F.when(F.col("apply_error").isNotNull(), APPLY_ERROR).when(some, F.col("_class"))
    whole = F.struct(F.col("_class").alias("classification"), plain.alias("runs"), F.col("_total").alias("total_duration_s"))
    return rows.select(*variants.KEYS, class_.alias("classification"), F.when(some, whole).alias("run_set"), "apply_error", "failure")


def _searched(tried: DataFrame, sets: DataFrame, kind: str, good: str) -> DataFrame:
    """patch_id, results: the rows of a search that have a status, inconclusive ones first, each with its run set.

    Pairs come in order of their search instead: both states count there."""
    keyed = tried.filter("status is not null").withColumns({"variant_key": variants.key_of(F.col("members")), "variant_kind": F.lit(kind)})
    rows = keyed.join(sets.select(*variants.KEYS, "run_set"), list(variants.KEYS), "left")
    first = (F.col("status") == good) if kind == SUBSET else F.lit(False)
    row = F.struct(
        F.transform("members", lambda m: m["id"]).alias("mutation_ids"), F.transform("members", lambda m: m["label"]).alias("mutation_labels"), "status", F.col("run_set").alias("runs"),
        F.lit(None).cast("string").alias("apply_error"),
    )
    ordered = F.array_sort(F.collect_list(F.struct(first.alias("good"), "rank", row.alias("row"))))
    return rows.groupBy("patch_id").agg(F.transform(ordered, lambda x: x["row"]).alias("results"))


def _search(summary: DataFrame, results: DataFrame, name: str) -> DataFrame:
    """patch_id and the search as one struct. summary: patch_id, enabled, attempted, budget, exhaustive, found_order, note."""
    none = F.expr(f"cast(array() as {results.schema['results'].dataType.simpleString()})")
    rows = summary.join(results, "patch_id", "left")
    return rows.select("patch_id", F.struct(
        "enabled", F.col("attempted").cast("bigint").alias("attempted"), F.col("budget").cast("bigint").alias("budget"), F.col("exhaustive").alias("exhaustive_at_found_order"),
        F.col("found_order").cast("int").alias("found_order"), F.coalesce("results", none).alias("results"), "note",
    ).alias(name))


def reports(heads: DataFrame, results: DataFrame, sets: DataFrame, sufficient: DataFrame, tried: DataFrame, interaction: DataFrame, pairs: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """patch_id, certificate_id and report, the whole report as a struct: a row for each of heads.

    heads: patch_id, generated_at, repo, base_ref, base_sha, candidate_ref, candidate_sha, test_command, config (any struct), ignored, test_files,
    environment (any struct); results: hunks with status and apply_error; sets: run_sets(); sufficient, interaction: what _search() reads;
    tried, pairs: rows of searches; removed: patch_id, removed_ids, where a reduction was asked for."""
    own = sets.filter(F.col("variant_kind") == ABLATE).select("patch_id", F.col("variant_key").cast("int").alias("mut_ord"), "run_set")
    unit = [f for f in ("id", "path", "label", "patch", "kind", "additions", "deletions", "line", "end_line") if f in results.columns]
    hunk = F.struct(F.struct(*unit).alias("mutation"), "status", F.col("run_set").alias("runs"), "apply_error")
    n = lambda s: F.count_if(F.col("status") == s)
    base = results.join(own, ["patch_id", "mut_ord"], "left").groupBy("patch_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("mut_ord", hunk.alias("h")))), lambda x: x["h"]).alias("results"), F.count("*").alias("mutations"),
        n(WITNESSED).alias("witnessed"), n(UNWITNESSED).alias("unwitnessed"), F.count_if(~F.col("status").isin(WITNESSED, UNWITNESSED)).alias("inconclusive"),
    )
    of = lambda kind, c: F.max(F.when(F.col("variant_kind") == kind, F.col(c)))
    ends = sets.filter(F.col("variant_kind").isin(CANDIDATE, BASELINE)).groupBy("patch_id").agg(
        of(CANDIDATE, "run_set").alias("candidate_run"), of(BASELINE, "run_set").alias("baseline_run"), of(CANDIDATE, "classification").alias("candidate"), of(BASELINE, "classification").alias("baseline")
    )
    rows = heads.join(base, "patch_id", "left").join(ends, "patch_id", "left")
    rows = rows.join(_search(sufficient, _searched(tried, sets, SUBSET, SUFFICIENT), "sufficient_search"), "patch_id", "left")
    rows = rows.join(_search(interaction, _searched(pairs, sets, PAIR, MUTUAL_BACKUP), "interaction_search"), "patch_id", "left")
    if removed is not None:
        rows = rows.join(removed.select("patch_id", "removed_ids"), "patch_id", "left")
    else:
        rows = rows.withColumn("removed_ids", F.lit(None).cast("array<string>"))
    rows = rows.select("patch_id", _report(heads.schema).alias("report"))
    hashed = rows.schema["report"].dataType
    kept = T.StructType([f for f in hashed.fields if f.name not in UNHASHED])
    id_ = F.concat(F.lit(CERTIFICATE_PREFIX), F.substring(F.sha2(canonical(F.col("report"), kept).cast("binary"), 256), 1, 20))
    return rows.withColumn("certificate_id", id_).select("patch_id", "certificate_id", F.col("report").withField("certificate_id", F.col("certificate_id")).alias("report"))


def _report(heads: T.StructType) -> Column:
    """The struct, from the joined columns."""
    results = F.coalesce("results", F.expr("slice(results, 1, 0)"))
    rows = lambda search, status: F.filter(F.col(search)["results"], lambda r: r["status"] == status)
    sets, backups = rows("sufficient_search", SUFFICIENT), rows("interaction_search", MUTUAL_BACKUP)
    in_sets = F.flatten(F.transform(sets, lambda r: r["mutation_ids"]))
    ids = lambda x: F.transform(x, lambda r: r["mutation"]["id"])
    some = F.coalesce((F.size(sets) > 0) & F.col("sufficient_search")["exhaustive_at_found_order"], F.lit(False))
    surplus = F.when(some, F.array_except(ids(F.filter("results", lambda r: r["status"] == UNWITNESSED)), in_sets)).otherwise(F.expr("cast(array() as array<string>)"))
    role = lambda r: F.struct(evidence.role(r["status"]).alias("role"), F.array_contains(F.coalesce(in_sets, F.expr("cast(array() as array<string>)")), r["mutation"]["id"]).alias("in_minimal_sufficient_set"))
    entry = lambda r: F.struct(r["mutation"]["id"], role(r))
    every = F.col("results")
    last = lambda i: F.element_at(F.filter(every, lambda r: r["mutation"]["id"] == i), -1)
    once = F.size(F.array_distinct(ids(every))) == F.size(every)  # equal hunks of one file have one id
    roles = F.map_from_entries(F.when(once, F.transform(every, entry)).otherwise(F.transform(F.array_distinct(ids(every)), lambda i: entry(last(i)))))
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    size = lambda c, name: F.greatest(F.size(c), F.lit(0)).cast("bigint").alias(name)
    summary = F.struct(
        count("mutations"), count("witnessed"), count("unwitnessed"), count("inconclusive"), F.col("ignored").cast("bigint").alias("ignored"),
        F.try_divide(F.col("witnessed").cast("double"), F.col("witnessed") + F.col("unwitnessed")).alias("witness_ratio"), F.col("sufficient_search")["found_order"].alias("minimal_sufficient_order"),
        size(sets, "minimal_sufficient_sets"), size(backups, "mutual_backup_pairs"), size(surplus, "surplus_candidate_hunks"),
    )
    reduction = F.when(F.col("removed_ids").isNotNull(), F.struct(F.col("removed_ids").alias("removed_mutation_ids"), F.lit("A greedy reduction; another order can end at another subset.").alias("note")))
    spoken = F.create_map(*[F.lit(x) for pair in INTERPRETATION.items() for x in pair])
    ref = lambda side: F.struct(F.col(f"{side}_ref").alias("ref"), F.col(f"{side}_sha").alias("sha")).alias(side)
    return F.struct(
        F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(TOOL).alias("tool"), "generated_at", "repo", ref("base"), ref("candidate"), "test_command", "config",
        stability.contrast(F.col("candidate"), F.col("baseline")).alias("contrast"), "candidate_run", F.col("baseline_run").alias("baseline_with_candidate_tests_run"),
        F.array_sort("test_files").alias("candidate_test_files_overlaid_on_base"), summary.alias("summary"), "sufficient_search", "interaction_search", surplus.alias("surplus_candidate_mutation_ids"),
        reduction.alias("minimization"), roles.alias("mutation_roles"), results.alias("results"), "environment", spoken.alias("interpretation"),
    )


def rendered(certificates: DataFrame) -> DataFrame:
    """certificates (patch_id, report) as the flat rows that report.markdown(), annotations(), ci_outputs() and gates() read."""
    r = F.col("report")
    hunk = lambda x, i: F.struct(
        i.alias("mut_ord"), *[x["mutation"][f].alias(f) for f in ("id", "path", "label", "additions", "deletions", "line", "end_line")], x["status"].alias("status"), x["runs"]["total_duration_s"].alias("runtime_s")
    )
    found = lambda search, status: F.transform(F.filter(r[search]["results"], lambda x: x["status"] == status), lambda x, i: F.struct(i.alias("rank"), F.transform(x["mutation_ids"], lambda m, k: F.struct(m.alias("id"), F.get(x["mutation_labels"], k).alias("label"))).alias("members")))
    s = r["summary"]
    rows = certificates.select(
        "patch_id", r["certificate_id"].alias("certificate_id"), r["contrast"].alias("contrast"), r["candidate_run"]["classification"].alias("candidate"),
        r["baseline_with_candidate_tests_run"]["classification"].alias("baseline"), *[s[c].alias(c) for c in ("mutations", "witnessed", "unwitnessed", "inconclusive", "witness_ratio")],
        s["minimal_sufficient_order"].alias("found_order"), r["sufficient_search"]["exhaustive_at_found_order"].alias("exhaustive"), F.transform(r["results"], hunk).alias("results"),
        found("sufficient_search", SUFFICIENT).alias("sufficient_sets"), found("interaction_search", MUTUAL_BACKUP).alias("backups"), r["surplus_candidate_mutation_ids"].alias("_surplus"),
    )
    return rows.withColumn("surplus", F.filter("results", lambda h: F.array_contains("_surplus", h["id"]))).drop("_surplus")
