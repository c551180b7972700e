"""The queries over the adapters, with SQL written from the semantics for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .functions.text import is_test_path
from .operators import certificate, evidence, reduce, report, search, stability, variants
from .plans import analyze, inverse, parse
from .schema import APPLY_ERROR, STABLE_FAIL, STABLE_PASS
from .sources import adapters, certificates, config
from .sources.store import Store

ORDER, BUDGET, PAIRS = 3, 20, 3
#: Repetitions asked for; two are recorded.
REPS = 3
#: Hunks of a patch, and of a removal, of which outcomes are recorded.
RECORDED, TOGETHER = 8, 3


def _sets(spark, d):
    return stability.run_sets(adapters.runs(spark, d))


def run_stability(spark: SparkSession, d: str) -> DataFrame:
    return _sets(spark, d)


def contrast_matrix(spark: SparkSession, d: str) -> DataFrame:
    return stability.patch_classes(_sets(spark, d)).groupBy("candidate", "baseline", "contrast").agg(F.count("*").alias("patches"))


def rejected_patches(spark: SparkSession, d: str) -> DataFrame:
    return stability.rejected(stability.patch_classes(_sets(spark, d)))


def mutation_status(spark: SparkSession, d: str) -> DataFrame:
    return adapters.mutation_results(spark, d).select("patch_id", "mut_ord", "id", "classification", "status")


def ablation_results(spark: SparkSession, d: str) -> DataFrame:
    """Hunks 0 to 2 of each patch of runs() against its recorded ablations; the third has no record."""
    hunks = adapters.runs(spark, d).select("patch_id").distinct().select("patch_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("mut_ord"))
    return evidence.mutation_results(hunks, _sets(spark, d)).select("patch_id", "mut_ord", "classification", "runtime_s", "status")


def witness_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = evidence.witness_summary(adapters.mutation_results(spark, d))
    return rows.withColumn("witness_ratio", F.round("witness_ratio", 6))


def _units(results: DataFrame) -> DataFrame:
    return results.select("patch_id", F.col("mut_ord").alias("idx"), "n", F.struct("id", "label", "weight").alias("unit"))


def _tried(results: DataFrame) -> DataFrame:
    return search.sufficient_search(_units(results), search.computed(adapters.subset_class(adapters.member_total())), ORDER, BUDGET)


def _pairs(results: DataFrame) -> DataFrame:
    w = Window.partitionBy("patch_id")
    rows = results.filter("flag = 'R'").withColumns({"idx": F.row_number().over(w.orderBy("mut_ord")) - 1, "n": F.count("*").over(w)})
    rows = rows.select("patch_id", "idx", "n", F.struct("id", "label", "weight").alias("unit"))
    return search.interaction_search(rows, search.computed(adapters.removal_class(adapters.member_total())), PAIRS)


def _ids(tried: DataFrame) -> DataFrame:
    return tried.filter("status = 'sufficient'").select("patch_id", F.explode("members.id").alias("id")).distinct()


def _patches(results: DataFrame) -> DataFrame:
    return results.groupBy("patch_id").agg(F.count("*").alias("n"))


def _summary(results: DataFrame) -> DataFrame:
    """Of the search alone, which takes every patch's baseline as failing."""
    return search.sufficient_summary(_patches(results).withColumn("baseline_fails", F.lit(True)), _tried(results), ORDER, BUDGET)


def sufficient_sets(spark: SparkSession, d: str) -> DataFrame:
    rows = _tried(adapters.mutation_results(spark, d)).filter("status is not null")
    return rows.select("patch_id", "ord", "rank", "key", F.array_join("members.id", ",").alias("ids"), "class", "status")


def search_summary(spark: SparkSession, d: str) -> DataFrame:
    return _summary(adapters.mutation_results(spark, d))


def mutual_backup_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = _pairs(adapters.mutation_results(spark, d)).filter("status is not null")
    return rows.select("patch_id", "rank", F.array_join("members.id", ",").alias("ids"), "status")


def interaction_summary(spark: SparkSession, d: str) -> DataFrame:
    results = adapters.mutation_results(spark, d)
    patches = results.groupBy("patch_id").agg(F.count_if(F.col("flag") == "R").alias("n"))
    return search.interaction_summary(patches, _pairs(results), PAIRS)


def mutation_roles(spark: SparkSession, d: str) -> DataFrame:
    results = adapters.mutation_results(spark, d)
    return evidence.mutation_roles(results, _ids(_tried(results))).select("patch_id", "mut_ord", "id", "role", "in_minimal_sufficient_set")


def surplus_mutations(spark: SparkSession, d: str) -> DataFrame:
    results = adapters.mutation_results(spark, d)
    return search.surplus_of(results, _tried(results), ORDER).select("patch_id", "mut_ord", "id", "label")


def greedy_reduction(spark: SparkSession, d: str) -> DataFrame:
    results = adapters.mutation_results(spark, d)
    rows = reduce.greedy_reduction(results, F.col("weight"), lambda total: total % 3 != 0)
    return rows.select("patch_id", F.size("removed_ids").alias("removed"), F.array_join("removed_ids", ",").alias("ids"))


class _Green:
    """What reports are made of: only patches whose candidate is stably green have one, and sufficient sets are searched only where the
    baseline stably fails. Hunks are numbered for green patches alone, and hunks and searches are written once for all that read them."""

    def __init__(self, spark: SparkSession, d: str):
        store = Store(spark)
        self.sets = store.put(certificate.run_sets(adapters.runs(spark, d)), "sets")
        self.classes = stability.patch_classes(self.sets).filter(F.col("candidate") == STABLE_PASS)
        self.classes = store.put(self.classes, "classes")
        self.results = store.put(adapters.mutation_results(spark, d, self.classes), "results")
        fails = F.col("baseline").eqNullSafe(F.lit(STABLE_FAIL))
        self.tried = store.put(_tried(self.results.join(self.classes.filter(fails), "patch_id", "left_semi")), "tried")
        self.pairs = store.put(_pairs(self.results), "pairs")
        self.patches = _patches(self.results).join(self.classes.select("patch_id", fails.alias("baseline_fails")), "patch_id")
        self.summary = search.sufficient_summary(self.patches, self.tried, ORDER, BUDGET)


def _reports(spark: SparkSession, d: str) -> DataFrame:
    g = _Green(spark, d)
    return report.reports(g.results, g.classes, g.summary, g.tried, g.pairs)


def _counts(spark: SparkSession, d: str) -> DataFrame:
    g = _Green(spark, d)
    return report.counts(g.results, g.classes, g.summary, g.tried, g.pairs)


def report_summary(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d).withColumn("witness_ratio", F.round("witness_ratio", 6))


def gates(spark: SparkSession, d: str) -> DataFrame:
    return report.gates(_counts(spark, d))


def ci_outputs(spark: SparkSession, d: str) -> DataFrame:
    return report.ci_outputs(report.report_counts(_reports(spark, d)))


def report_markdown(spark: SparkSession, d: str) -> DataFrame:
    return report.markdown(_reports(spark, d))


def certificate_id(spark: SparkSession, d: str) -> DataFrame:
    return _reports(spark, d).select("patch_id", "certificate_id")


def report_certificate_id(spark: SparkSession, d: str) -> DataFrame:
    """The hash of the report's columns as they are, as Python's json writes them."""
    return report.certificate_ids(_reports(spark, d))


def annotations(spark: SparkSession, d: str) -> DataFrame:
    return report.annotations(adapters.mutation_results(spark, d))


def file_blocks(spark: SparkSession, d: str) -> DataFrame:
    files = parse.file_patches(adapters.patches(spark, d))
    return files.select("patch_id", "file_ord", "path", "old_path", F.size("hunks").alias("hunks"), F.length("header").cast("bigint").alias("header_chars"), "structural", "binary", "is_test")


def hunk_ranges(spark: SparkSession, d: str) -> DataFrame:
    files = parse.file_patches(adapters.patches(spark, d)).select("patch_id", "path", F.posexplode("hunks").alias("hunk_ord", "h"))
    return files.select("patch_id", "path", "hunk_ord", *[F.col(f"h.{c}").alias(c) for c in ("additions", "deletions", "old_start", "old_count", "new_start", "new_count")])


def mutation_ids(spark: SparkSession, d: str) -> DataFrame:
    files = parse.file_patches(adapters.patches(spark, d))
    return parse.mutations(files, include_tests=True).select("patch_id", "mut_ord", "path", "label", "kind", "additions", "deletions", "line", "end_line", "id")


def test_path_flags(spark: SparkSession, d: str) -> DataFrame:
    return adapters.paths(spark, d).select("patch_id", "path", is_test_path(F.col("path")).alias("is_test"), is_test_path(F.col("path"), ["checks/*"]).alias("is_test_globbed"))


def ignored_mutations(spark: SparkSession, d: str) -> DataFrame:
    files = parse.file_patches(adapters.patches(spark, d))
    rows = parse.ignored_counts(files, ignore_globs=["lib/*"])
    return rows.select("patch_id", "mutations", "ignored", F.array_join("test_files", ",").alias("test_files"))


def test_overlay(spark: SparkSession, d: str) -> DataFrame:
    return parse.test_overlay(parse.file_patches(adapters.patches(spark, d))).select("patch_id", F.length("overlay").cast("bigint").alias("chars"), F.sha2(F.col("overlay").cast("binary"), 256).alias("digest"))


def binary_files(spark: SparkSession, d: str) -> DataFrame:
    """Files and mutations of diffs two thirds of which are binary."""
    files = parse.file_patches(adapters.page_patches(spark, d))
    units = parse.mutations(files).select("patch_id", "kind", "label", "line", "end_line", "additions", "deletions")
    return files.select("patch_id", "path", "structural", "binary", F.size("hunks").alias("hunks")).join(units, "patch_id")


def suggested_commands(spark: SparkSession, d: str) -> DataFrame:
    return config.suggestions(adapters.markers(spark, d))


def config_precedence(spark: SparkSession, d: str) -> DataFrame:
    return adapters.settings(spark, d).select("case_id", config.picked(F.col("given"), F.col("configured"), F.lit(2)).alias("value"))


def missing_variants(spark: SparkSession, d: str) -> DataFrame:
    """Candidate, baseline and each hunk's ablation, three repetitions each, against the recorded runs."""
    hunks = adapters.hunks(spark, d)
    planned = variants.whole(hunks.select("patch_id").distinct()).union(variants.ablations(hunks))
    rows = variants.missing(planned, adapters.runs(spark, d), REPS)
    return rows.select(*variants.KEYS, F.array_join(F.transform("reps", lambda r: r.cast("string")), ",").alias("reps"))


def greedy_recorded(spark: SparkSession, d: str) -> DataFrame:
    """The greedy reduction from recorded outcomes: of all sets of up to three of a patch's first eight hunks."""
    results = adapters.mutation_results(spark, d)
    few = results.filter(F.col("mut_ord") < RECORDED).select("patch_id", F.col("mut_ord").alias("idx"), F.least("n", F.lit(RECORDED)).alias("n"), F.struct("mut_ord", "weight").alias("unit"))
    every = search.combinations(few, TOGETHER, RECORDED**TOGETHER)
    # a hunk's index is its mut_ord, so that keys are those of variants
    outcomes = every.select("patch_id", F.col("key").alias("variant_key"), F.when(adapters.member_total() % 3 != 0, STABLE_PASS).otherwise(STABLE_FAIL).alias("classification"))
    rows = reduce.greedy_recorded(results, outcomes)
    text = lambda c: F.array_join(F.transform(c, lambda i: i.cast("string")), ",")
    return rows.select("patch_id", text("removed").alias("ords"), F.array_join("removed_ids", ",").alias("ids"), text("missing").alias("missing"))


def inverse_patches(spark: SparkSession, d: str) -> DataFrame:
    """The diffs of patches() turned round."""
    rows = inverse.inverse_patches(parse.file_patches(adapters.patches(spark, d)))
    return rows.select("patch_id", F.length("inverse").cast("bigint").alias("chars"), F.sha2(F.col("inverse").cast("binary"), 256).alias("digest"))


def patch_states(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of each order's diff: hunks under lib/ and in tests are left out; of recorded runs, two timeouts count as a failure,
    and every fifth patch's tests don't apply to its base."""
    changes, runs = adapters.changes(spark, d), adapters.runs(spark, d)
    counts = parse.ignored_counts(parse.file_patches(changes.select("patch_id", "diff_text")), ignore_globs=["lib/*"])
    ends = stability.patch_classes(_sets(spark, d)).withColumns({"baseline": F.when(F.col("patch_id") % 5 == 0, APPLY_ERROR).otherwise(F.col("baseline")), "overlay_error": F.lit("patch does not apply")})
    failures = runs.groupBy("patch_id").agg(F.count_if("timed_out").alias("late")).filter("late > 1").select("patch_id", F.lit("out of time").alias("failure"))
    return analyze.states_of(changes.join(counts.select("patch_id", "mutations"), "patch_id", "left"), ends, failures)


def production_sets(spark: SparkSession, d: str) -> DataFrame:
    """Sufficient sets where hunks of returned items are tests: they are analysed, but never searched."""
    rows = adapters.mutation_results(spark, d).withColumn("path", F.when(F.col("flag") == "R", "tests/R.py").otherwise(F.col("path")))
    w = Window.partitionBy("patch_id")
    units = rows.filter(~is_test_path(F.col("path"))).withColumns({"idx": F.row_number().over(w.orderBy("mut_ord")) - 1, "n": F.count("*").over(w)})
    units = units.select("patch_id", "idx", "n", F.struct("id", "label", "weight").alias("unit"))
    tried = search.sufficient_search(units, search.computed(adapters.subset_class(adapters.member_total())), ORDER, BUDGET).filter("status is not null")
    return tried.select("patch_id", "ord", "rank", "key", F.array_join("members.id", ",").alias("ids"), "status")


def _certificates(spark: SparkSession, d: str) -> DataFrame:
    """Whole reports (patch_id, certificate_id, report) of the green patches; ablations of a patch's first two hunks are recorded."""
    g = _Green(spark, d)
    text = lambda x: F.lit(x)
    heads = g.classes.join(g.patches.select("patch_id"), "patch_id").select(
        "patch_id", text("2026-01-01T00:00:00+00:00").alias("generated_at"), F.concat(text("repositories/"), F.col("patch_id")).alias("repo"), text("main").alias("base_ref"), F.sha1(F.concat(text("base"), F.col("patch_id"))).alias("base_sha"),
        text("HEAD").alias("candidate_ref"), F.sha1(F.concat(text("candidate"), F.col("patch_id"))).alias("candidate_sha"), text("make test").alias("test_command"),
        F.struct(F.lit(2).alias("stability_runs"), F.lit(ORDER).alias("max_subset_order"), F.lit(BUDGET).alias("max_subset_runs"), F.lit(PAIRS).alias("max_interaction_runs")).alias("config"), F.lit(0).alias("ignored"),
        F.array().cast("array<string>").alias("test_files"), F.struct(text("tables").alias("source")).alias("environment"),
    )
    numbered = lambda rows: rows.withColumn("members", F.transform("members", lambda m: F.struct(F.lit(0).alias("mut_ord"), m["id"].alias("id"), m["label"].alias("label"))))
    told = lambda rows: rows.withColumn("enabled", F.lit(True))
    removable = g.patches.select("patch_id").join(g.results.filter("flag = 'R'").groupBy("patch_id").agg(F.count("*").alias("n")), "patch_id", "left").fillna(0, ["n"])
    pairs = told(search.interaction_summary(removable, g.pairs, PAIRS))
    results = g.results.withColumns({"apply_error": F.lit(None).cast("string"), "patch": F.lit(""), "kind": F.lit("hunk")})
    return certificate.reports(heads, results, g.sets, told(g.summary), numbered(g.tried), pairs, numbered(g.pairs))


def certificate_searches(spark: SparkSession, d: str) -> DataFrame:
    """The rows of both searches in whole reports, in their order: inconclusive sets come before sufficient ones."""
    rows = _certificates(spark, d)
    of = lambda name: rows.select("patch_id", F.lit(name).alias("search"), F.posexplode(f"report.{name}_search.results").alias("place", "r"))
    return of("sufficient").union(of("interaction")).select("patch_id", "search", "place", F.array_join("r.mutation_ids", ",").alias("ids"), F.col("r.status").alias("status"))


def certificate_hunks(spark: SparkSession, d: str) -> DataFrame:
    """The hunks of whole reports, with their roles."""
    rows = certificates.hunks(_certificates(spark, d))
    return rows.select("patch_id", "mut_ord", "id", "path", "additions", "deletions", "line", "end_line", "status", "classification", F.round("runtime_s", 4).alias("runtime_s"), "role", "in_minimal_sufficient_set")


def certificate_runs(spark: SparkSession, d: str) -> DataFrame:
    """The runs that whole reports hold."""
    return certificates.runs(_certificates(spark, d)).select("patch_id", "variant_kind", "variant_key", "rep", "returncode", F.round("duration_s", 4).alias("duration_s"), "timed_out")


QUERIES = {
    f.__name__: f
    for f in (
        run_stability, contrast_matrix, rejected_patches, mutation_status, ablation_results, witness_summary, sufficient_sets, search_summary, mutual_backup_pairs, interaction_summary, mutation_roles,
        surplus_mutations, greedy_reduction, report_summary, gates, ci_outputs, report_markdown, certificate_id, report_certificate_id, annotations, file_blocks, hunk_ranges, mutation_ids, test_path_flags,
        ignored_mutations, test_overlay, suggested_commands, config_precedence, missing_variants, greedy_recorded, inverse_patches, patch_states, production_sets, certificate_searches, certificate_hunks, certificate_runs, binary_files,
    )
}

# ---------------------------------------------------------------- SQL

_RUNS = """runs AS (SELECT event_id // 8 AS patch_id, (event_id % 8) // 2 AS slot, value, value > 250 AS timed_out, CASE WHEN value > 250 THEN FALSE ELSE event_type NOT IN ('error', 'view') END AS ok FROM events),
sets AS (SELECT patch_id, slot, CASE WHEN bool_or(timed_out) THEN 'timeout' WHEN bool_and(ok) THEN 'stable-pass' WHEN NOT bool_or(ok) THEN 'stable-fail' ELSE 'flaky' END AS c, count(*) AS n, round(sum(value), 4) AS total
  FROM runs GROUP BY patch_id, slot),
cls AS (SELECT a.patch_id, a.c AS candidate, b.c AS baseline, CASE WHEN a.c <> 'stable-pass' THEN 'candidate-not-stable-green' WHEN b.c = 'stable-fail' THEN 'base-fail_candidate-pass'
  WHEN b.c = 'stable-pass' THEN 'base-pass_candidate-pass' ELSE 'base-inconclusive_candidate-pass' END AS contrast FROM sets a JOIN sets b ON a.patch_id = b.patch_id AND a.slot = 0 AND b.slot = 1)"""
_MUT = """mut AS (SELECT l_orderkey AS patch_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1)::INT AS mut_ord, count(*) OVER (PARTITION BY l_orderkey) AS n,
  l_quantity::INT AS additions, l_linenumber AS deletions, l_suppkey::INT AS line, (l_suppkey + l_linenumber - 1)::INT AS end_line, l_returnflag AS flag, l_partkey + l_suppkey AS weight, round(l_quantity / 10, 2) AS runtime_s,
  CASE l_returnflag WHEN 'A' THEN 'src/A.py' WHEN 'N' THEN 'lib/N.py' ELSE 'core/R.py' END AS path,
  CASE WHEN l_returnflag = 'A' THEN 'stable-fail' WHEN l_returnflag = 'R' THEN 'stable-pass' WHEN l_linestatus = 'F' THEN 'flaky' ELSE 'timeout' END AS classification,
  CASE l_returnflag WHEN 'A' THEN 'witnessed' WHEN 'R' THEN 'unwitnessed' ELSE 'inconclusive' END AS status FROM lineitem),
m AS (SELECT *, substr(sha256(patch_id || chr(0) || mut_ord), 1, 10) AS id, path || ' hunk ' || (mut_ord + 1) || '/' || n AS label FROM mut)"""
_CLASS = "CASE w % 16 WHEN 0 THEN 'stable-pass' WHEN 1 THEN 'flaky' WHEN 2 THEN 'timeout' WHEN 3 THEN 'apply-error' ELSE 'stable-fail' END"
_TRIED = f"""combos AS (SELECT patch_id, n, 1 AS ord, mut_ord AS i, -1 AS j, -1 AS k, mut_ord::VARCHAR AS key, id AS ids, '`' || label || '`' AS labels, weight AS w FROM m
  UNION ALL SELECT a.patch_id, a.n, 2, a.mut_ord, b.mut_ord, -1, a.mut_ord || ',' || b.mut_ord, a.id || ',' || b.id, '`' || a.label || '`, `' || b.label || '`', a.weight + b.weight FROM m a JOIN m b ON a.patch_id = b.patch_id AND a.mut_ord < b.mut_ord
  UNION ALL SELECT a.patch_id, a.n, 3, a.mut_ord, b.mut_ord, c.mut_ord, a.mut_ord || ',' || b.mut_ord || ',' || c.mut_ord, a.id || ',' || b.id || ',' || c.id, '`' || a.label || '`, `' || b.label || '`, `' || c.label || '`', a.weight + b.weight + c.weight
  FROM m a JOIN m b ON a.patch_id = b.patch_id AND a.mut_ord < b.mut_ord JOIN m c ON c.patch_id = b.patch_id AND b.mut_ord < c.mut_ord),
ranked AS (SELECT *, row_number() OVER (PARTITION BY patch_id ORDER BY ord, i, j, k) AS rank, {_CLASS} AS class FROM combos WHERE ord <= {ORDER}),
att AS (SELECT *, min(CASE WHEN class = 'stable-pass' THEN ord END) OVER (PARTITION BY patch_id) AS fo FROM ranked WHERE rank <= {BUDGET}),
tried AS (SELECT *, CASE WHEN class = 'stable-pass' THEN 'sufficient' WHEN class IN ('flaky', 'timeout') THEN 'inconclusive' END AS status FROM att WHERE fo IS NULL OR ord <= fo),
suff_ids AS (SELECT DISTINCT patch_id, unnest(string_split(ids, ',')) AS id FROM tried WHERE status = 'sufficient'),
summ AS (SELECT *, CASE WHEN found_order IS NULL THEN CASE WHEN attempted >= {BUDGET} AND total > {BUDGET} THEN 'No sufficient subset found before the search budget was exhausted.' ELSE 'No sufficient subset found within the configured maximum order.' END END AS note
  FROM (SELECT patch_id, any_value(n) AS n, count(*) AS attempted, max(fo) AS found_order, any_value(n + n * (n - 1) // 2 + n * (n - 1) * (n - 2) // 6) AS total,
  coalesce(count(*) FILTER (ord = fo) = any_value(CASE fo WHEN 1 THEN n WHEN 2 THEN n * (n - 1) // 2 WHEN 3 THEN n * (n - 1) * (n - 2) // 6 END), FALSE) AS exhaustive FROM tried GROUP BY patch_id))"""
_PAIRS = f"""rem AS (SELECT *, row_number() OVER (PARTITION BY patch_id ORDER BY mut_ord) AS pos FROM m WHERE flag = 'R'),
pr AS (SELECT a.patch_id, row_number() OVER (PARTITION BY a.patch_id ORDER BY a.pos, b.pos) AS rank, a.id || ',' || b.id AS ids, '`' || a.label || '` + `' || b.label || '`' AS labels, (a.weight + b.weight) % 5 AS w5
  FROM rem a JOIN rem b ON a.patch_id = b.patch_id AND a.pos < b.pos),
pairs AS (SELECT *, CASE w5 WHEN 0 THEN 'mutual-backup' WHEN 1 THEN 'inconclusive' END AS status FROM pr WHERE rank <= {PAIRS})"""
_SURPLUS = "surp AS (SELECT m.* FROM m JOIN summ s ON m.patch_id = s.patch_id AND s.exhaustive WHERE m.status = 'unwitnessed' AND NOT EXISTS (SELECT 1 FROM suff_ids x WHERE x.patch_id = m.patch_id AND x.id = m.id))"
_COUNTS = """cnt AS (SELECT b.*, contrast, candidate, baseline, s.found_order, s.exhaustive, (SELECT count(*) FROM tried t WHERE t.patch_id = b.patch_id AND t.status = 'sufficient') AS sufficient_sets,
  (SELECT count(*) FROM pairs p WHERE p.patch_id = b.patch_id AND p.status = 'mutual-backup') AS mutual_backup_pairs, (SELECT count(*) FROM surp u WHERE u.patch_id = b.patch_id) AS surplus
  FROM (SELECT patch_id, count(*) AS mutations, count(*) FILTER (status = 'witnessed') AS witnessed, count(*) FILTER (status = 'unwitnessed') AS unwitnessed, count(*) FILTER (status = 'inconclusive') AS inconclusive,
    CASE WHEN count(*) FILTER (status <> 'inconclusive') > 0 THEN count(*) FILTER (status = 'witnessed')::DOUBLE / count(*) FILTER (status <> 'inconclusive') END AS witness_ratio FROM m GROUP BY patch_id) b
  LEFT JOIN cls ON cls.patch_id = b.patch_id LEFT JOIN summ s ON s.patch_id = b.patch_id)"""
# reports: only patches with a stably passing candidate have one, and only those with a stably failing baseline are searched
_REPORTED = f"""{_MUT.replace('m AS (', 'every AS (')},
m AS (SELECT every.* FROM every JOIN cls ON cls.patch_id = every.patch_id AND cls.candidate = 'stable-pass'),
failing AS (SELECT m.* FROM m JOIN cls ON cls.patch_id = m.patch_id AND cls.baseline = 'stable-fail')"""
_QUOTED = """coalesce((SELECT string_agg('["' || replace(ids, ',', '","') || '"]', ',' ORDER BY rank) FROM {rows} z WHERE z.patch_id = cnt.patch_id AND z.status = '{status}'), '')"""
_CERTIFIED = f"""cert AS (SELECT patch_id, 'dw2_' || substr(sha256('{{"backups":[' || {_QUOTED.format(rows='pairs', status='mutual-backup')} || '],"baseline":' || coalesce('"' || baseline || '"', 'null') || ',"candidate":"' || candidate || '","contrast":"' || contrast || '","results":['
  || (SELECT string_agg('{{"additions":' || additions || ',"deletions":' || deletions || ',"end_line":' || end_line || ',"id":"' || id || '","label":"' || label || '","line":' || line || ',"path":"' || path || '","runtime":"' || printf('%.2f', runtime_s) || '","status":"' || status || '"}}', ',' ORDER BY mut_ord) FROM m WHERE m.patch_id = cnt.patch_id)
  || '],"search":{{"exhaustive":' || coalesce(exhaustive, FALSE) || ',"found_order":' || coalesce(found_order::VARCHAR, 'null') || '}},"sufficient_sets":[' || {_QUOTED.format(rows='tried', status='sufficient')}
  || '],"summary":{{"inconclusive":' || inconclusive || ',"mutations":' || mutations || ',"unwitnessed":' || unwitnessed || ',"witness_ratio":' || coalesce('"' || printf('%.6f', witness_ratio) || '"', 'null') || ',"witnessed":' || witnessed || '}},"surplus":['
  || coalesce((SELECT string_agg('"' || id || '"', ',' ORDER BY id) FROM surp z WHERE z.patch_id = cnt.patch_id), '') || ']}}'), 1, 20) AS certificate_id FROM cnt)"""
# whole rows of reports as JSON: fractions of two digits and ratios are laid out alike by both
_ROWS = """coalesce((SELECT string_agg('{{"additions":' || additions || ',"deletions":' || deletions || ',"end_line":' || end_line || ',"id":"' || id || '","label":"' || label || '","line":' || line || ',"mut_ord":' || mut_ord || ',"path":"' || path || '","runtime_s":' || runtime_s || ',"status":"' || status || '"}}', ',' ORDER BY mut_ord) FROM {rows} z WHERE z.patch_id = cnt.patch_id), '')"""
_SETS = """coalesce((SELECT '[' || string_agg('{{"members":[' || (SELECT string_agg('{{"id":"' || y.id || '","label":"' || y.label || '","weight":' || y.weight || '}}', ',' ORDER BY y.mut_ord) FROM m y WHERE y.patch_id = z.patch_id AND list_contains(string_split(z.ids, ','), y.id)) || '],"rank":' || rank || '}}', ',' ORDER BY rank) || ']' FROM {rows} z WHERE z.patch_id = cnt.patch_id AND z.status = '{status}'), 'null')"""
_REPORT = f"WITH {_RUNS},\n{_REPORTED},\n{_TRIED.replace('FROM m', 'FROM failing').replace('JOIN m ', 'JOIN failing ')},\n{_PAIRS},\n{_SURPLUS},\n{_COUNTS},\n{_CERTIFIED}\n"
_HUNKS = """h AS (SELECT l_orderkey AS patch_id, l_returnflag AS flag, CASE l_returnflag WHEN 'A' THEN 'src/A.py' WHEN 'N' THEN 'lib/N.py' ELSE 'tests/R.py' END AS path,
  (row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1)::INT AS hunk_ord, count(*) OVER (PARTITION BY l_orderkey, l_returnflag) AS hunks,
  l_partkey::INT AS old_start, l_linenumber AS old_count, l_suppkey::INT AS new_start, l_quantity::INT % 5 AS new_count, l_linestatus AS context FROM lineitem),
t AS (SELECT *, '@@ -' || old_start || CASE WHEN old_count = 1 THEN '' ELSE ',' || old_count END || ' +' || new_start || CASE WHEN new_count = 1 THEN '' ELSE ',' || new_count END || ' @@ ' || context || chr(10)
  || repeat('-old' || chr(10), old_count) || repeat('+new' || chr(10), new_count) || ' same' || chr(10) AS text FROM h),
f AS (SELECT patch_id, flag, path, any_value(hunks) AS hunks, flag = 'N' AND patch_id % 7 = 0 AS structural, string_agg(text, '' ORDER BY hunk_ord) AS body, sum(new_count) AS additions, sum(old_count) AS deletions, min(CASE WHEN hunk_ord = 0 THEN new_start END) AS first_start,
  (dense_rank() OVER (PARTITION BY patch_id ORDER BY flag) - 1)::INT AS file_ord,
  'diff --git a/' || path || ' b/' || path || chr(10) || CASE WHEN flag = 'N' AND patch_id % 7 = 0 THEN 'old mode 100644' || chr(10) || 'new mode 100755' || chr(10) ELSE '' END || '--- a/' || path || chr(10) || '+++ b/' || path || chr(10) AS header
  FROM t GROUP BY patch_id, flag, path)"""
_PATHS = """p AS (SELECT doc_id AS patch_id, CASE doc_id % 6 WHEN 0 THEN 'src/' WHEN 1 THEN 'tests/' WHEN 2 THEN 'Lib/Spec/' WHEN 3 THEN 'checks/' WHEN 4 THEN 'pkg/test_' ELSE 'web/' END || coalesce(source, '') || '_' || coalesce(lang, '')
  || CASE doc_id % 5 WHEN 0 THEN '.spec.ts' WHEN 1 THEN '_test.py' ELSE '.py' END AS path FROM documents)"""


_SECTION = "CASE WHEN {n} > 0 THEN chr(10) || chr(10) || '## {title}' || chr(10) || chr(10) || {text} ELSE '' END"

ORACLE_SQL = {
    "run_stability": f"WITH {_RUNS} SELECT patch_id, CASE slot WHEN 0 THEN 'candidate' WHEN 1 THEN 'baseline' ELSE 'ablate' END AS variant_kind, CASE WHEN slot < 2 THEN '' ELSE (slot - 2)::VARCHAR END AS variant_key, c AS classification, n AS n_runs, total AS total_duration_s FROM sets",
    "contrast_matrix": f"WITH {_RUNS} SELECT candidate, baseline, contrast, count(*) AS patches FROM cls GROUP BY ALL",
    "rejected_patches": f"WITH {_RUNS} SELECT patch_id, 'candidate is not stably green: ' || candidate AS reason FROM cls WHERE candidate <> 'stable-pass'",
    "mutation_status": f"WITH {_MUT} SELECT patch_id, mut_ord, id, classification, status FROM m",
    "ablation_results": f"WITH {_RUNS} SELECT q.patch_id, o.mut_ord, c AS classification, total AS runtime_s, CASE c WHEN 'stable-fail' THEN 'witnessed' WHEN 'stable-pass' THEN 'unwitnessed' ELSE 'inconclusive' END AS status FROM (SELECT DISTINCT patch_id FROM runs) q CROSS JOIN (VALUES (0), (1), (2)) o(mut_ord) LEFT JOIN sets s ON s.patch_id = q.patch_id AND s.slot = o.mut_ord + 2",
    "witness_summary": f"WITH {_MUT} SELECT patch_id, count(*) AS mutations, count(*) FILTER (status = 'witnessed') AS witnessed, count(*) FILTER (status = 'unwitnessed') AS unwitnessed, count(*) FILTER (status = 'inconclusive') AS inconclusive, CASE WHEN count(*) FILTER (status <> 'inconclusive') > 0 THEN round(count(*) FILTER (status = 'witnessed')::DOUBLE / count(*) FILTER (status <> 'inconclusive'), 6) END AS witness_ratio FROM m GROUP BY patch_id",
    "sufficient_sets": f"WITH {_MUT},\n{_TRIED} SELECT patch_id, ord, rank, key, ids, class, status FROM tried WHERE status IS NOT NULL",
    "search_summary": f"WITH {_MUT},\n{_TRIED} SELECT patch_id, {BUDGET} AS budget, attempted, found_order, exhaustive, 0::BIGINT AS missing_outcomes, note FROM summ",
    "mutual_backup_pairs": f"WITH {_MUT},\n{_PAIRS} SELECT patch_id, rank, ids, status FROM pairs WHERE status IS NOT NULL",
    "interaction_summary": f"WITH {_MUT},\n{_PAIRS} SELECT q.patch_id, {PAIRS} AS budget, coalesce(attempted, 0) AS attempted, CASE WHEN k > 0 THEN 2 END AS found_order, r >= 2 AND coalesce(attempted, 0) = r * (r - 1) // 2 AS exhaustive, CASE WHEN r < 2 THEN 'No pair search needed: fewer than two unwitnessed production hunks.' WHEN k = 0 THEN 'No mutual-backup pair found within the interaction search budget.' END AS note FROM (SELECT patch_id, count(*) FILTER (flag = 'R') AS r FROM m GROUP BY patch_id) q LEFT JOIN (SELECT patch_id, count(*) AS attempted, count(status) AS k FROM pairs GROUP BY patch_id) a ON a.patch_id = q.patch_id",
    "mutation_roles": f"WITH {_MUT},\n{_TRIED} SELECT patch_id, mut_ord, id, CASE status WHEN 'witnessed' THEN 'essential-under-selected-evidence' WHEN 'unwitnessed' THEN 'individually-removable-under-selected-evidence' ELSE 'inconclusive' END AS role, EXISTS (SELECT 1 FROM suff_ids x WHERE x.patch_id = m.patch_id AND x.id = m.id) AS in_minimal_sufficient_set FROM m",
    "surplus_mutations": f"WITH {_MUT},\n{_TRIED},\n{_SURPLUS} SELECT patch_id, mut_ord, id, label FROM surp",
    "greedy_reduction": f"WITH RECURSIVE {_MUT}, o AS (SELECT *, row_number() OVER (PARTITION BY patch_id ORDER BY CASE status WHEN 'unwitnessed' THEN 0 WHEN 'witnessed' THEN 2 ELSE 1 END, mut_ord) AS pos FROM m), g AS (SELECT patch_id, 0 AS pos, 0::BIGINT AS total, 0 AS removed, '' AS ids FROM o WHERE pos = 1 UNION ALL SELECT g.patch_id, (g.pos + 1)::INT, CASE WHEN (g.total + o.weight) % 3 <> 0 THEN g.total + o.weight ELSE g.total END, CASE WHEN (g.total + o.weight) % 3 <> 0 THEN g.removed + 1 ELSE g.removed END, CASE WHEN (g.total + o.weight) % 3 = 0 THEN g.ids WHEN g.ids = '' THEN o.id ELSE g.ids || ',' || o.id END FROM g JOIN o ON o.patch_id = g.patch_id AND o.pos = g.pos + 1) SELECT g.patch_id, g.removed, g.ids FROM g JOIN (SELECT patch_id, max(pos) AS last FROM o GROUP BY patch_id) l ON l.patch_id = g.patch_id AND l.last = g.pos",
    "report_summary": _REPORT + "SELECT patch_id, contrast, mutations, witnessed, unwitnessed, inconclusive, round(witness_ratio, 6) AS witness_ratio, found_order, sufficient_sets, mutual_backup_pairs, surplus FROM cnt",
    "gates": _REPORT + "SELECT patch_id, coalesce(contrast = 'base-fail_candidate-pass', FALSE) AS gate_contrast, unwitnessed = 0 AND inconclusive = 0 AS gate_all_witnessed, surplus = 0 AS gate_no_surplus, CASE WHEN coalesce(contrast = 'base-fail_candidate-pass', FALSE) AND unwitnessed = 0 AND inconclusive = 0 AND surplus = 0 THEN 0 ELSE 1 END AS exit_code FROM cnt",
    "ci_outputs": _REPORT + "SELECT patch_id, unnest(['certificate_id', 'contrast', 'witnessed', 'unwitnessed', 'inconclusive', 'witness_ratio', 'minimal_sufficient_order', 'surplus_candidate_hunks']) AS key, unnest([certificate_id, coalesce(contrast, ''), witnessed::VARCHAR, unwitnessed::VARCHAR, inconclusive::VARCHAR, CASE WHEN witness_ratio IS NULL THEN '' ELSE printf('%.6f', witness_ratio) END, coalesce(found_order::VARCHAR, ''), surplus::VARCHAR]) AS value FROM cnt JOIN cert USING (patch_id)",
    "certificate_id": _REPORT + "SELECT patch_id, certificate_id FROM cert",
    "report_certificate_id": _REPORT + f"""SELECT patch_id, 'dw2_' || substr(sha256('{{"backups":' || {_SETS.format(rows='pairs', status='mutual-backup')} || ',"baseline":' || coalesce('"' || baseline || '"', 'null') || ',"candidate":"' || candidate || '","contrast":"' || contrast || '","exhaustive":' || coalesce(exhaustive, FALSE)
  || ',"found_order":' || coalesce(found_order::VARCHAR, 'null') || ',"inconclusive":' || inconclusive || ',"mutations":' || mutations || ',"results":[' || {_ROWS.format(rows='m')} || '],"sufficient_sets":' || {_SETS.format(rows='tried', status='sufficient')} || ',"surplus":[' || {_ROWS.format(rows='surp')}
  || '],"unwitnessed":' || unwitnessed || ',"witness_ratio":' || coalesce(witness_ratio::VARCHAR, 'null') || ',"witnessed":' || witnessed || '}}'), 1, 20) AS certificate_id FROM cnt""",
    "report_markdown": _REPORT + f"""SELECT patch_id, concat_ws(chr(10), '# Evidence certificate', '', '**Certificate:** `' || certificate_id || '`  ', '**Contrast:** `' || coalesce(contrast, '') || '`  ', '**Candidate stability:** `' || coalesce(candidate, '') || '`  ', '**Baseline stability:** `' || coalesce(baseline, '') || '`', '',
  '## Evidence summary', '', '- Witnessed hunks: **' || witnessed || '**', '- Unwitnessed hunks: **' || unwitnessed || '**', '- Inconclusive hunks: **' || inconclusive || '**',
  CASE WHEN witness_ratio IS NULL THEN '- Witness ratio: n/a' ELSE '- Witness ratio: **' || printf('%.1f', witness_ratio * 100) || '%**' END,
  CASE WHEN found_order IS NULL THEN '- Minimal sufficient order: not found within budget' ELSE '- Minimal sufficient order: **' || found_order || '**' END, '- Mutual-backup pairs: **' || mutual_backup_pairs || '**', '- Surplus candidate hunks: **' || surplus || '**',
  '', '## Hunk witness map', '', '| Status | Change | Delta | Runtime |', '|---|---|---:|---:|',
  (SELECT string_agg('| ' || CASE status WHEN 'witnessed' THEN '✅ witnessed' WHEN 'unwitnessed' THEN '⚠️ unwitnessed' ELSE '❔ inconclusive' END || ' | `' || replace(label, '|', chr(92) || '|') || '` | +' || additions || '/-' || deletions || ' | ' || printf('%.2f', runtime_s) || 's |', chr(10) ORDER BY mut_ord) FROM m WHERE m.patch_id = cnt.patch_id))
  || {_SECTION.format(n='sufficient_sets', title='Minimal sufficient sets', text="(SELECT string_agg(place || '. ' || labels, chr(10) ORDER BY place) FROM (SELECT labels, row_number() OVER (PARTITION BY patch_id ORDER BY rank) AS place, patch_id FROM tried WHERE status = 'sufficient') z WHERE z.patch_id = cnt.patch_id)")}
  || {_SECTION.format(n='mutual_backup_pairs', title='Hidden redundancy / mutual backup', text="(SELECT string_agg('- ' || labels, chr(10) ORDER BY rank) FROM pairs z WHERE z.patch_id = cnt.patch_id AND z.status = 'mutual-backup')")}
  || {_SECTION.format(n='surplus', title='Strong surplus candidates', text="'" + report.SURPLUS_TEXT + "' || chr(10) || (SELECT string_agg('- `' || label || '`', chr(10) ORDER BY id) FROM surp z WHERE z.patch_id = cnt.patch_id)")}
  || chr(10) || chr(10) || '## What this proves — and what it does not' || chr(10) || chr(10) || '{report.LIMITS_TEXT}' || chr(10) AS markdown FROM cnt JOIN cert USING (patch_id)""",
    "annotations": f"WITH {_MUT} SELECT patch_id, mut_ord, '::' || CASE status WHEN 'unwitnessed' THEN 'warning' ELSE 'notice' END || ' file=' || path || ',title=' || CASE status WHEN 'unwitnessed' THEN 'no causal witness' ELSE 'inconclusive' END || CASE WHEN line <> 0 THEN ',line=' || line ELSE '' END || CASE WHEN end_line <> 0 THEN ',endLine=' || end_line ELSE '' END || '::' || CASE status WHEN 'unwitnessed' THEN '{report.MESSAGES['unwitnessed'][2]}' ELSE '{report.MESSAGES['inconclusive'][2]}' END AS annotation FROM m WHERE status <> 'witnessed'",
    "file_blocks": f"WITH {_HUNKS} SELECT patch_id, file_ord, path, path AS old_path, hunks::INT AS hunks, length(header) AS header_chars, structural, FALSE AS binary, flag = 'R' AS is_test FROM f",
    "hunk_ranges": f"WITH {_HUNKS} SELECT patch_id, path, hunk_ord, new_count AS additions, old_count AS deletions, old_start, old_count, new_start, new_count FROM h",
    "mutation_ids": f"""WITH {_HUNKS}, u AS (SELECT f.patch_id, file_ord, 0 AS hunk_ord, path, path || ' (file-level/structural)' AS label, header || body AS patch, 'structural' AS kind, additions::INT AS additions, deletions::INT AS deletions, first_start AS line, CASE WHEN first_start = 0 THEN 1 ELSE first_start END AS end_line FROM f WHERE structural
  UNION ALL SELECT t.patch_id, file_ord, hunk_ord, t.path, t.path || ' hunk ' || (hunk_ord + 1) || '/' || t.hunks || ' — ' || context, header || text, 'hunk', new_count, old_count, new_start, new_start + CASE WHEN new_count = 0 THEN 1 ELSE new_count END - 1 FROM t JOIN f ON f.patch_id = t.patch_id AND f.flag = t.flag WHERE NOT structural)
  SELECT patch_id, (row_number() OVER (PARTITION BY patch_id ORDER BY file_ord, hunk_ord) - 1)::INT AS mut_ord, path, label, kind, additions, deletions, line, end_line, substr(sha256(path || chr(0) || patch), 1, 10) AS id FROM u""",
    "test_path_flags": f"WITH {_PATHS}, q AS (SELECT *, patch_id % 6 IN (1, 2, 4) OR patch_id % 5 < 2 AS is_test FROM p) SELECT patch_id, path, is_test, is_test OR patch_id % 6 = 3 AS is_test_globbed FROM q",
    "ignored_mutations": f"WITH {_HUNKS}, u AS (SELECT *, CASE WHEN structural THEN 1 ELSE hunks END AS units FROM f) SELECT patch_id, sum(CASE WHEN flag = 'A' THEN units ELSE 0 END)::BIGINT AS mutations, sum(CASE WHEN flag = 'A' THEN 0 ELSE units END)::BIGINT AS ignored, CASE WHEN bool_or(flag = 'R') THEN 'tests/R.py' ELSE '' END AS test_files FROM u GROUP BY patch_id",
    "test_overlay": f"WITH {_HUNKS}, g AS (SELECT patch_id, coalesce(string_agg(header || body, '' ORDER BY file_ord) FILTER (flag = 'R'), '') AS overlay FROM f GROUP BY patch_id) SELECT patch_id, length(overlay) AS chars, sha256(overlay) AS digest FROM g",
    "suggested_commands": f"SELECT m.repo, min(r.place)::INT AS place, r.command FROM (SELECT DISTINCT concat_ws('/', source, lang) AS repo, {list(adapters.MARKERS)}[doc_id % {len(adapters.MARKERS)} + 1] AS marker FROM documents) m JOIN (VALUES {', '.join(str((i, *x)) for i, x in enumerate(config.SUGGESTIONS))}) r(place, marker, command) ON m.marker = r.marker GROUP BY m.repo, r.command",
    "config_precedence": "SELECT o_orderkey AS case_id, coalesce(CASE WHEN o_custkey % 3 = 0 THEN o_custkey % 7 END, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 5 END, 2) AS value FROM orders",
    "missing_variants": f"""WITH {_MUT}, planned AS (SELECT DISTINCT patch_id, kind AS variant_kind, '' AS variant_key, slot FROM m, (VALUES ('candidate', 0), ('baseline', 1)) k(kind, slot) UNION ALL SELECT patch_id, 'ablate', mut_ord::VARCHAR, mut_ord + 2 FROM m)
  SELECT patch_id, variant_kind, variant_key, string_agg(rep::VARCHAR, ',' ORDER BY rep) AS reps FROM planned, range({REPS}) r(rep) LEFT JOIN events e ON slot < 4 AND rep < 2 AND e.event_id = patch_id * 8 + slot * 2 + rep WHERE e.event_id IS NULL GROUP BY ALL""",
    "greedy_recorded": f"""WITH RECURSIVE {_MUT}, o AS (SELECT *, row_number() OVER (PARTITION BY patch_id ORDER BY CASE status WHEN 'unwitnessed' THEN 0 WHEN 'witnessed' THEN 2 ELSE 1 END, mut_ord) AS pos FROM m),
  g AS (SELECT patch_id, 0::BIGINT AS pos, 0::BIGINT AS total, []::INT[] AS ords, []::VARCHAR[] AS ids, NULL::INT[] AS missing FROM o WHERE pos = 1
  UNION ALL SELECT patch_id, pos, CASE WHEN taken THEN asked ELSE total END, CASE WHEN taken THEN ords || [mut_ord] ELSE ords END, CASE WHEN taken THEN ids || [id] ELSE ids END, CASE WHEN known OR missing IS NOT NULL THEN missing ELSE ords || [mut_ord] END
    FROM (SELECT *, known AND asked % 3 <> 0 AS taken FROM (SELECT g.patch_id, o.pos, g.total, g.ords, g.ids, g.missing, o.mut_ord, o.id, g.total + o.weight AS asked, o.mut_ord < {RECORDED} AND len(g.ords) < {TOGETHER} AS known FROM g JOIN o ON o.patch_id = g.patch_id AND o.pos = g.pos + 1)))
  SELECT g.patch_id, array_to_string(ords, ',') AS ords, array_to_string(ids, ',') AS ids, array_to_string(missing, ',') AS missing FROM g JOIN (SELECT patch_id, max(pos) AS last FROM o GROUP BY patch_id) l ON l.patch_id = g.patch_id AND l.last = g.pos""",
    "inverse_patches": f"""WITH {_HUNKS}, b AS (SELECT t.patch_id, t.flag, any_value(header) AS header, string_agg('@@ -' || new_start || CASE WHEN new_count = 1 THEN '' ELSE ',' || new_count END || ' +' || old_start || CASE WHEN old_count = 1 THEN '' ELSE ',' || old_count END || ' @@ ' || context || chr(10)
    || repeat('-new' || chr(10), new_count) || repeat('+old' || chr(10), old_count) || ' same' || chr(10), '' ORDER BY t.hunk_ord) AS body FROM t JOIN f ON f.patch_id = t.patch_id AND f.flag = t.flag GROUP BY t.patch_id, t.flag),
  i AS (SELECT patch_id, string_agg(replace(replace(replace(header, '100644', 'x'), '100755', '100644'), 'x', '100755') || body, '' ORDER BY flag) AS inverse FROM b GROUP BY patch_id) SELECT patch_id, length(inverse) AS chars, sha256(inverse) AS digest FROM i""",
    "patch_states": f"""WITH {_RUNS}, a AS (SELECT l_orderkey AS patch_id, count(*) FILTER (l_returnflag = 'A') AS kept FROM lineitem GROUP BY l_orderkey), late AS (SELECT patch_id FROM runs GROUP BY patch_id HAVING count(*) FILTER (timed_out) > 1),
  s AS (SELECT o_orderkey AS patch_id, candidate, CASE WHEN o_orderstatus = 'P' THEN 'unreadable' WHEN a.patch_id IS NULL THEN 'no-changes' WHEN kept = 0 THEN 'nothing-left' WHEN late.patch_id IS NOT NULL THEN 'failed' WHEN candidate IS DISTINCT FROM 'stable-pass' THEN 'candidate-not-green'
    WHEN o_orderkey % 5 = 0 THEN 'tests-do-not-apply' ELSE 'analysed' END AS state FROM orders LEFT JOIN a ON a.patch_id = o_orderkey LEFT JOIN late ON late.patch_id = o_orderkey LEFT JOIN cls ON cls.patch_id = o_orderkey)
  SELECT patch_id, state, CASE state WHEN 'unreadable' THEN 'no such repository' WHEN 'no-changes' THEN 'no changes to analyse' WHEN 'nothing-left' THEN 'nothing is left to analyse after filtering' WHEN 'failed' THEN 'out of time'
    WHEN 'candidate-not-green' THEN 'candidate is not stably green: ' || coalesce(candidate, 'not recorded') WHEN 'tests-do-not-apply' THEN 'test changes don''t apply to the base: patch does not apply' END AS reason FROM s""",
    "production_sets": f"WITH {_MUT},\nprod AS (SELECT * REPLACE ((row_number() OVER (PARTITION BY patch_id ORDER BY mut_ord) - 1)::INT AS mut_ord, count(*) OVER (PARTITION BY patch_id) AS n) FROM m WHERE flag <> 'R'),\n{_TRIED.replace('FROM m', 'FROM prod').replace('JOIN m ', 'JOIN prod ')} SELECT patch_id, ord, rank, key, ids, status FROM tried WHERE status IS NOT NULL",
    "certificate_searches": _REPORT + """SELECT patch_id, search, (row_number() OVER (PARTITION BY patch_id, search ORDER BY good, rank) - 1)::INT AS place, ids, status FROM (SELECT patch_id, 'sufficient' AS search, status = 'sufficient' AS good, rank, ids, status FROM tried WHERE status IS NOT NULL
  UNION ALL SELECT patch_id, 'interaction', FALSE, rank, ids, status FROM pairs WHERE status IS NOT NULL)""",
    "certificate_hunks": _REPORT + """SELECT m.patch_id, mut_ord, id, path, additions, deletions, line, end_line, status, sets.c AS classification, round(sets.total, 4) AS runtime_s, CASE status WHEN 'witnessed' THEN 'essential-under-selected-evidence' WHEN 'unwitnessed' THEN 'individually-removable-under-selected-evidence' ELSE 'inconclusive' END AS role,
  EXISTS (SELECT 1 FROM suff_ids x WHERE x.patch_id = m.patch_id AND x.id = m.id) AS in_minimal_sufficient_set FROM m LEFT JOIN sets ON sets.patch_id = m.patch_id AND sets.slot = m.mut_ord + 2 AND mut_ord < 2""",
    "certificate_runs": _REPORT + """SELECT patch_id, CASE slot WHEN 0 THEN 'candidate' WHEN 1 THEN 'baseline' ELSE 'ablate' END AS variant_kind, CASE WHEN slot < 2 THEN '' ELSE (slot - 2)::VARCHAR END AS variant_key, rep, CASE WHEN value > 250 THEN NULL WHEN event_type IN ('error', 'view') THEN 1 ELSE 0 END AS returncode,
  round(value, 4) AS duration_s, value > 250 AS timed_out FROM (SELECT event_id // 8 AS patch_id, (event_id % 8) // 2 AS slot, (event_id % 2)::INT AS rep, value, event_type FROM events) e JOIN (SELECT patch_id, count(*) AS n FROM m GROUP BY patch_id) k USING (patch_id) WHERE slot < 2 + n""",
    "binary_files": """SELECT page_id AS patch_id, 'pages/' || page_id || '.html' AS path, page_id % 3 < 2 AS structural, page_id % 3 < 2 AS binary, CASE WHEN page_id % 3 < 2 THEN 0 ELSE 1 END AS hunks, CASE WHEN page_id % 3 < 2 THEN 'binary' ELSE 'hunk' END AS kind,
  'pages/' || page_id || '.html' || CASE WHEN page_id % 3 < 2 THEN ' (file-level/structural)' ELSE ' hunk 1/1' END AS label, 1 AS line, 1 AS end_line, CASE WHEN page_id % 3 < 2 THEN 0 ELSE 1 END AS additions, CASE WHEN page_id % 3 < 2 THEN 0 ELSE 1 END AS deletions FROM pages""",
}
