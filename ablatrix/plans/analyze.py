"""Whole analyses of changes in repositories, evaluated live: any number of changes at once.

Each step plans variants for all changes that have come so far, as rows; what is recorded already is left out by an anti-join, the
rest runs in one job, and its runs are appended to a table. Steps are: candidates and baselines; ablations; one a level of the
search for sufficient sets, for the changes that have found none yet; pairs; and, if asked for, one a place of the greedy reduction.
The driver sees whether a step has anything to run, never a run. A second analysis over the same folder runs nothing again."""

from __future__ import annotations

import json
import platform
import sys
import tempfile
from collections.abc import Iterable
from dataclasses import asdict, dataclass
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..operators import certificate, reduce, search, stability, variants
from ..schema import ABLATE, APPLY_ERROR, BASELINE, CANDIDATE, GREEDY, PAIR, STABLE_FAIL, STABLE_PASS, STATES, SUBSET, UNWITNESSED, Config
from ..sources import git
from ..sources.live import RESULTS, VARIANTS, Command, evaluate, reductions
from ..sources.store import Runs, Store, shared
from . import parse

CHANGES = f"{git.CHANGE}, test string, prepare string, timeout double, shared array<string>"


class AnalysisError(RuntimeError):
    """The change can't be analysed, or an argument is wrong."""


@dataclass
class Analysis:
    """states: patch_id, state, reason of every change; certificates: patch_id, certificate_id, report of those analysed; reductions:
    patch_id, removed_ids, reduction_patch (without config.minimize: no rows); runs: every run of these changes."""

    states: DataFrame
    certificates: DataFrame
    reductions: DataFrame
    runs: DataFrame


def changes_of(spark: SparkSession, rows: Iterable[tuple[int, Command, str, str | None]]) -> DataFrame:
    """CHANGES of (patch_id, command, base, candidate)."""
    return spark.createDataFrame([(i, c.repo, base, candidate, c.test, c.prepare, float(c.timeout), list(c.shared)) for i, c, base, candidate in rows], CHANGES)


class Analyzer:
    """The steps, over tables in `folder`."""

    def __init__(self, spark: SparkSession, config: Config, folder: str | None, parallel: int):
        self.config, self.parallel = config, parallel
        self.store = Store(spark, folder)
        self.known = Runs(spark, f"{(folder or self.store.path).rstrip('/')}/runs", RESULTS)

    def read(self, changes: DataFrame) -> None:
        """diffs, files, mutations and heads (a row for each change that has hunks to analyse) of changes."""
        c, put = self.config, self.store.put
        self.diffs = put(git.diffs(changes), "diffs")
        self.files = put(parse.file_patches(self.diffs.select("patch_id", "diff_text"), c.test_globs), "files")
        self.mutations = put(parse.mutations(self.files, c.include_tests, c.ignore_globs), "mutations")
        counts = parse.ignored_counts(self.files, c.include_tests, c.ignore_globs).filter("mutations > 0")
        heads = self.diffs.join(counts.select("patch_id", "ignored", "test_files"), "patch_id")
        if c.overlay_tests:
            heads = heads.join(parse.test_overlay(self.files), "patch_id")
        else:
            heads = heads.withColumn("overlay", F.lit(""))
        decides = ["root", "base_sha", "candidate_sha", "overlay", "test", "prepare", "timeout", "shared", F.lit(c.include_tests).alias("i"), F.lit(json.dumps([c.test_globs, c.ignore_globs])).alias("g")]
        self.heads = put(heads.withColumn("state", F.sha2(F.to_json(F.struct(*decides)).cast("binary"), 256)), "heads")

    def runs(self) -> DataFrame:
        return self.known.of(self.heads)

    def run(self, planned: DataFrame, side: str, name: str, reverse: bool = False) -> bool:
        """Runs what isn't recorded of planned (KEYS, pieces) on that side; false if there was nothing to run."""
        gaps = self.store.put(variants.missing(planned, self.runs(), self.config.stability_runs), name)
        if gaps.isEmpty():
            return False
        at = self.heads.select(
            "patch_id", "state", F.col("root").alias("repo"), F.col(f"{side}_sha").alias("commit"), F.col("overlay") if side == "base" else F.lit("").alias("overlay"), "test", "prepare", "timeout", "shared"
        )
        rows = gaps.join(at, "patch_id").withColumn("reverse", F.lit(reverse))
        self.known.add(evaluate(rows.select(*T.StructType.fromDDL(VARIANTS).fieldNames()), self.parallel))
        return True

    def sets(self) -> DataFrame:
        return self.store.put(certificate.run_sets(self.runs()), "sets")

    def ends(self) -> DataFrame:
        """patch_id, candidate, baseline, failure of what stands at both ends."""
        pieces = F.expr("cast(array() as array<struct<id: string, patch: string>>)").alias("pieces")
        both = variants.whole(self.heads).withColumn("pieces", pieces)
        self.run(both.filter(F.col("variant_kind") == CANDIDATE), "candidate", "candidates")
        self.run(both.filter(F.col("variant_kind") == BASELINE), "base", "baselines")
        of = lambda kind, c: F.max(F.when(F.col("variant_kind") == kind, F.col(c)))
        return self.sets().groupBy("patch_id").agg(of(CANDIDATE, "classification").alias("candidate"), of(BASELINE, "classification").alias("baseline"), of(BASELINE, "apply_error").alias("overlay_error"))

    def ablated(self, mutations: DataFrame) -> DataFrame:
        """mutations with status and apply_error."""
        self.run(variants.ablations(mutations, F.array(F.struct("id", "patch")).alias("pieces")), "candidate", "ablations", True)
        own = self.sets().filter(F.col("variant_kind") == ABLATE).select("patch_id", F.col("variant_key").cast("int").alias("mut_ord"), "classification", "apply_error")
        applied = F.when(F.col("classification") != APPLY_ERROR, F.col("classification"))
        return self.store.put(mutations.join(own, ["patch_id", "mut_ord"], "left").withColumn("status", stability.status(applied)).drop("classification"), "results")

    def classes(self, kind: str) -> DataFrame:
        return self.sets().filter(F.col("variant_kind") == kind).select("patch_id", "variant_key", F.col("classification").alias("class"))

    def with_class(self, rows: DataFrame, kind: str) -> DataFrame:
        keyed = rows.withColumn("variant_key", variants.key_of(F.col("members")))
        return keyed.join(self.classes(kind), ["patch_id", "variant_key"], "left")

    def searched(self, production: DataFrame, failing: DataFrame) -> DataFrame:
        """Combinations of production hunks, level by level, of the patches that have found no sufficient set yet."""
        c = self.config
        units = _units(production.join(failing, "patch_id", "left_semi"))
        every = self.store.put(search.combinations(units, c.max_subset_order, c.max_subset_runs), "combinations")
        rows = every.filter("ord < 1").withColumns({"variant_key": F.lit(""), "class": F.lit("")})
        for level in range(1, c.max_subset_order + 1):
            done = rows.filter(F.col("class") == STABLE_PASS).select("patch_id")
            front = self.store.put(every.filter(F.col("ord") == level).join(done, "patch_id", "left_anti"), "level")
            if front.isEmpty():
                break
            self.run(variants.combined(front, SUBSET, _pieces()), "base", "subsets")
            rows = self.store.put(self.with_class(every.filter(F.col("ord") <= level), SUBSET), "classes")
        return self.store.put(search.tried(rows), "tried")

    def paired(self, removable: DataFrame) -> DataFrame:
        pairs = self.store.put(search.combinations(_units(removable), 2, self.config.max_interaction_runs, min_order=2), "pairs")
        self.run(variants.combined(pairs, PAIR, _pieces()), "candidate", "pairs", True)
        return self.store.put(search.tried_pairs(self.with_class(pairs, PAIR)), "pairs")

    def reduced(self, production: DataFrame) -> DataFrame:
        """patch_id, removed_ids, reduction_patch: a step a place, each patch at its own."""
        units = production.select("patch_id", "mut_ord", F.struct("id", "patch").alias("piece"))
        while True:
            done = reduce.greedy_recorded(production, self.classes(GREEDY).withColumnRenamed("class", "classification"))
            front = self._removals(done.filter("missing is not null").select("patch_id", F.col("missing").alias("ords")), units)
            key = F.array_join(F.transform(F.array_sort("ords"), lambda i: i.cast("string")), ",")
            if not self.run(front.select("patch_id", F.lit(GREEDY).alias("variant_kind"), key.alias("variant_key"), "pieces"), "candidate", "removals", True):
                break
        at = self.heads.select("patch_id", F.col("root").alias("repo"), F.col("candidate_sha").alias("commit"))
        some = self._removals(done.filter(F.size("removed") > 0).select("patch_id", F.col("removed").alias("ords")), units)
        found = reductions(some.join(at, "patch_id").select("patch_id", "repo", "commit", "pieces").repartition(self.parallel))
        none = done.filter(F.size("removed") == 0).select("patch_id", "removed_ids", F.lit("").alias("reduction_patch"))
        return self.store.put(found.union(none), "reductions")

    @staticmethod
    def _removals(asked: DataFrame, units: DataFrame) -> DataFrame:
        """asked (patch_id, ords) with the pieces in that order."""
        one = asked.select("patch_id", F.posexplode("ords").alias("place", "mut_ord")).join(units, ["patch_id", "mut_ord"])
        gathered = one.groupBy("patch_id").agg(F.array_sort(F.collect_list(F.struct("place", "mut_ord", "piece"))).alias("x"))
        return gathered.select("patch_id", F.transform("x", lambda p: p["mut_ord"]).alias("ords"), F.transform("x", lambda p: p["piece"]).alias("pieces"))


def _pieces() -> Column:
    return F.transform("members", lambda m: F.struct(m["id"].alias("id"), m["patch"].alias("patch"))).alias("pieces")


def _units(mutations: DataFrame) -> DataFrame:
    w = Window.partitionBy("patch_id")
    rows = mutations.withColumns({"idx": F.row_number().over(w.orderBy("mut_ord")) - 1, "n": F.count("*").over(w)})
    return rows.select("patch_id", "idx", "n", F.struct("mut_ord", "id", "label", "patch").alias("unit"))


def states_of(changes: DataFrame, ends: DataFrame, failures: DataFrame) -> DataFrame:
    """patch_id, state (one of STATES), reason: every change is in exactly one.

    changes: patch_id, error, diff_text, mutations (null or 0: none left); ends: patch_id, candidate, baseline, overlay_error; failures:
    patch_id, failure."""
    rows = changes.join(ends, "patch_id", "left").join(failures, "patch_id", "left")
    state = (
        F.when(F.col("error").isNotNull(), STATES[0]).when(F.trim(F.coalesce("diff_text", F.lit(""))) == "", STATES[1]).when(F.coalesce("mutations", F.lit(0)) == 0, STATES[2])
        .when(F.col("failure").isNotNull(), STATES[3]).when(~F.col("candidate").eqNullSafe(F.lit(STABLE_PASS)), STATES[4]).when(F.col("baseline") == APPLY_ERROR, STATES[5]).otherwise(STATES[6])
    )
    reasons = {
        STATES[0]: F.col("error"), STATES[1]: F.lit("no changes to analyse"), STATES[2]: F.lit("nothing is left to analyse after filtering"), STATES[3]: F.col("failure"),
        STATES[4]: F.concat(F.lit("candidate is not stably green: "), F.coalesce("candidate", F.lit("not recorded"))), STATES[5]: F.concat(F.lit("test changes don't apply to the base: "), F.coalesce("overlay_error", F.lit(""))),
    }
    reason = F.lit(None).cast("string")
    for name, text in reasons.items():
        reason = F.when(F.col("state") == name, text).otherwise(reason)
    return rows.withColumn("state", state).select("patch_id", "state", reason.alias("reason"))


def analyze_many(spark: SparkSession, changes: DataFrame, config: Config = Config(), folder: str | None = None, parallel: int = 4) -> Analysis:
    """Analyses every row of changes (CHANGES, unique patch_ids). folder: where runs are recorded, for later calls to go on from;
    without it they go with this analysis. Repositories must be in reach of all executors, at the same paths."""
    a = Analyzer(spark, config, folder or f"{shared(spark)}/analyses", parallel)
    if folder is None:
        a.known.path = f"{a.store.path}/runs"
    a.read(changes)
    ends = a.store.put(a.ends(), "ends")
    counts = a.mutations.groupBy("patch_id").agg(F.count("*").alias("mutations"))
    every = a.diffs.select("patch_id", "error", "diff_text").join(counts, "patch_id", "left")
    failures = lambda: a.sets().filter("failure is not null").groupBy("patch_id").agg(F.min("failure").alias("failure"))
    able = a.store.put(states_of(every, ends, failures()).filter(F.col("state") == STATES[6]).select("patch_id"), "able")
    results = a.ablated(a.mutations.join(able, "patch_id", "left_semi"))
    production = results.filter("not is_test")
    fails = F.col("baseline").eqNullSafe(F.lit(STABLE_FAIL))
    patches = able.join(ends.select("patch_id", fails.alias("baseline_fails")), "patch_id")
    n = lambda rows: patches.join(rows.groupBy("patch_id").agg(F.count("*").alias("n")), "patch_id", "left").fillna(0, ["n"])
    nothing = search.combinations(_units(production.limit(0)), 1, 1).withColumns({"class": F.lit(""), "variant_key": F.lit("")})
    tried = a.searched(production, patches.filter("baseline_fails")) if config.sufficient_search else search.tried(nothing)
    removable = production.filter(F.col("status") == UNWITNESSED)
    pairs = a.paired(removable) if config.interaction_search else search.tried_pairs(nothing)
    reduced = a.reduced(production) if config.minimize else None
    sufficient = search.sufficient_summary(n(production), tried, config.max_subset_order, config.max_subset_runs)
    interaction = search.interaction_summary(n(removable), pairs, config.max_interaction_runs)
    told = lambda rows, on: rows.withColumns({"enabled": F.lit(on), "note": F.col("note") if on else F.lit(None).cast("string"), "exhaustive": F.col("exhaustive") & F.lit(on)})
    states = a.store.put(states_of(every, ends, failures()), "states")
    heads = a.heads.join(states.filter(F.col("state") == STATES[6]).select("patch_id"), "patch_id", "left_semi")
    heads = heads.select(
        "patch_id", F.lit(datetime.now(timezone.utc).isoformat()).alias("generated_at"), F.col("root").alias("repo"), F.col("base").alias("base_ref"), "base_sha",
        F.coalesce("candidate", F.lit(git.WORKTREE)).alias("candidate_ref"), "candidate_sha", F.col("test").alias("test_command"), _config(config).alias("config"), "ignored",
        F.col("test_files") if config.overlay_tests else F.expr("cast(array() as array<string>)").alias("test_files"),
        F.struct(F.lit(sys.version.split()[0]).alias("python"), F.lit(platform.platform()).alias("platform"), F.lit(git.version()).alias("git")).alias("environment"),
    )
    found = certificate.reports(heads, results, a.sets(), told(sufficient, config.sufficient_search), tried, told(interaction, config.interaction_search), pairs, reduced)
    nobody = spark.createDataFrame([], "patch_id bigint, removed_ids array<string>, reduction_patch string")
    return Analysis(states, a.store.put(found, "certificates"), reduced if reduced is not None else nobody, a.runs())


def _config(config: Config) -> Column:
    """The settings as a struct, those of the change's command with them."""
    values = {k: v for k, v in asdict(config).items() if not k.startswith("require_")}
    text = lambda v: F.array(*map(F.lit, v)).cast("array<string>") if isinstance(v, tuple) else F.lit(v)
    return F.struct(*[text(v).alias(k) for k, v in values.items()], "prepare", "timeout", F.col("shared").alias("shared_paths"))


def analyze(spark: SparkSession, command: Command, base: str, candidate: str | None = None, config: Config = Config(), parallel: int = 4) -> tuple[dict[str, Any], str | None]:
    """The report of one change, and the reduction patch (null unless config.minimize). candidate: a ref, or null or WORKTREE for a
    snapshot of the worktree."""
    with tempfile.TemporaryDirectory(prefix="ablatrix-") as folder:
        runs = analyze_many(spark, changes_of(spark, [(0, command, base, candidate)]), config, f"file://{folder}", parallel)
        state = runs.states.first()
        if state["state"] != STATES[6]:
            raise AnalysisError(state["reason"])
        report = runs.certificates.first()["report"].asDict(recursive=True)
        return report, runs.reductions.first()["reduction_patch"] if config.minimize else None
