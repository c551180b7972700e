"""Reports: summary, certificate, Markdown, annotations, CI outputs and gates, one row per patch or hunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.canonical import canonical
from ..functions.text import escape_data, escape_property
from ..schema import CONTRASTS, MUTUAL_BACKUP, SUFFICIENT, UNWITNESSED, WITNESSED
from .evidence import witness_summary

# The prefix of certificates.
CERTIFICATE_PREFIX = "dw2_"
# Texts of reports.
ICONS = {WITNESSED: "✅ witnessed", UNWITNESSED: "⚠️ unwitnessed", "inconclusive": "❔ inconclusive"}
MESSAGES = {
    UNWITNESSED: ("warning", "no causal witness", "The evidence passes without this hunk. It may be superfluous, or lack a test."),
    "inconclusive": ("notice", "inconclusive", "Runs without this hunk disagreed, ran out of time, or could not be made."),
}
SURPLUS_TEXT = "All sets of this size were tried; none that suffices needs these hunks, and each can go alone:"
LIMITS_TEXT = "Each status says what one command did in one environment with and without a hunk. It says nothing on what that command does not check: a hunk without a witness may serve another purpose, so look at it before it goes."


def annotations(results: DataFrame) -> DataFrame:
    """patch_id, mut_ord, line: a workflow command per hunk that isn't witnessed."""
    s = F.col("status")
    of = lambda i: F.when(s == UNWITNESSED, MESSAGES[UNWITNESSED][i]).otherwise(MESSAGES["inconclusive"][i])
    place = lambda name, c: F.when(F.coalesce(F.col(c), F.lit(0)) != 0, F.concat(F.lit(f",{name}="), F.col(c))).otherwise(F.lit(""))
    line = F.concat(
        F.lit("::"), of(0), F.lit(" file="), escape_property(F.col("path")), F.lit(",title="), escape_property(of(1)), place("line", "line"), place("endLine", "end_line"), F.lit("::"), escape_data(of(2))
    )
    return results.filter(s != WITNESSED).select("patch_id", "mut_ord", line.alias("annotation"))


def reports(results: DataFrame, classes: DataFrame, summary: DataFrame, tried: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per patch with what certificates hold.

    results: mutation results; classes: patch_classes(); summary: sufficient_summary(); tried, pairs: searches with status and
    members (id, label). Patches of results without classes or summary keep nulls there. certificate_id is a hash of document()."""
    hunk = F.struct("mut_ord", "id", "path", "label", "additions", "deletions", "line", "end_line", "status", "runtime_s")
    n = lambda s: F.count_if(F.col("status") == s)
    base = results.groupBy("patch_id").agg(
        F.array_sort(F.collect_list(hunk)).alias("results"), F.count("*").alias("mutations"), n(WITNESSED).alias("witnessed"), n(UNWITNESSED).alias("unwitnessed"),
        F.count_if(~F.col("status").isin(WITNESSED, UNWITNESSED)).alias("inconclusive"),
    )
    base = base.withColumn("witness_ratio", F.try_divide(F.col("witnessed").cast("double"), F.col("witnessed") + F.col("unwitnessed")))
    sets = lambda rows, status, name: rows.filter(F.col("status") == status).groupBy("patch_id").agg(F.array_sort(F.collect_list(F.struct("rank", "members"))).alias(name))
    rows = base.join(classes, "patch_id", "left").join(summary.select("patch_id", "found_order", "exhaustive"), "patch_id", "left")
    rows = rows.join(sets(tried, "sufficient", "sufficient_sets"), "patch_id", "left").join(sets(pairs, "mutual-backup", "backups"), "patch_id", "left")
    ids = F.array_distinct(F.flatten(F.transform("sufficient_sets", lambda s: F.transform(s["members"], lambda m: m["id"]))))
    removable = F.filter("results", lambda r: r["status"] == UNWITNESSED)
    surplus = F.filter(removable, lambda r: ~F.array_contains(ids, r["id"]))
    some = F.coalesce(F.col("exhaustive"), F.lit(False)) & F.col("sufficient_sets").isNotNull()
    rows = rows.withColumn("surplus", F.when(some, surplus).otherwise(F.slice("results", 1, 0)))
    return rows.withColumn("certificate_id", _hashed(F.to_json(document(), {"ignoreNullFields": "false"})))


def document() -> Column:
    """The whole of a row of reports() as one struct, for sinks and for the certificate: fields in alphabetical order, lists in the
    report's order, fractions as text of fixed digits, so that its JSON is the same bytes wherever it is written."""
    fixed = lambda digits, c: F.when(c.isNotNull(), F.format_string(f"%.{digits}f", c))
    ids = lambda c: F.coalesce(F.transform(c, lambda x: F.transform(x["members"], lambda m: m["id"])), F.expr("cast(array() as array<array<string>>)"))
    plain = lambda h: F.struct(*[h[k].alias(k) for k in ("additions", "deletions", "end_line", "id", "label", "line", "path")], fixed(2, h["runtime_s"]).alias("runtime"), h["status"].alias("status"))
    search_ = F.struct(F.coalesce("exhaustive", F.lit(False)).alias("exhaustive"), "found_order")
    summary = F.struct("inconclusive", "mutations", "unwitnessed", fixed(6, F.col("witness_ratio")).alias("witness_ratio"), "witnessed")
    return F.struct(
        ids("backups").alias("backups"), "baseline", "candidate", "contrast", F.transform("results", plain).alias("results"), search_.alias("search"), ids("sufficient_sets").alias("sufficient_sets"),
        summary.alias("summary"), F.array_sort(F.transform("surplus", lambda h: h["id"])).alias("surplus"),
    )


def _count(c: str) -> Column:
    return F.greatest(F.size(F.col(c)), F.lit(0)).cast("bigint")


def report_counts(report: DataFrame) -> DataFrame:
    """The scalar summary: counts of hunks, sets, pairs and surplus."""
    return report.select(
        "patch_id", "certificate_id", "contrast", "mutations", "witnessed", "unwitnessed", "inconclusive", "witness_ratio", "found_order",
        _count("sufficient_sets").alias("sufficient_sets"), _count("backups").alias("mutual_backup_pairs"), _count("surplus").alias("surplus"),
    )


def counts(results: DataFrame, classes: DataFrame, summary: DataFrame, tried: DataFrame, pairs: DataFrame) -> DataFrame:
    """What report_counts() says but for the certificate, from aggregates alone: no list of hunks or sets is made."""
    n = lambda rows, name: rows.groupBy("patch_id").agg(F.count("*").alias(name))
    sets = tried.filter(F.col("status") == SUFFICIENT)
    ids = sets.select("patch_id", F.explode("members.id").alias("id")).distinct()
    left = results.filter(F.col("status") == UNWITNESSED).select("patch_id", "id").join(ids, ["patch_id", "id"], "left_anti")
    rows = witness_summary(results).join(classes.select("patch_id", "contrast"), "patch_id", "left").join(summary.select("patch_id", "found_order", "exhaustive"), "patch_id", "left")
    for part in (n(sets, "sufficient_sets"), n(pairs.filter(F.col("status") == MUTUAL_BACKUP), "mutual_backup_pairs"), n(left, "_left")):
        rows = rows.join(part, "patch_id", "left")
    rows = rows.fillna(0, ["sufficient_sets", "mutual_backup_pairs", "_left"])
    surplus = F.when(F.coalesce("exhaustive", F.lit(False)) & (F.col("sufficient_sets") > 0), F.col("_left")).otherwise(F.lit(0)).cast("bigint")
    return rows.withColumn("surplus", surplus).drop("exhaustive", "_left")


def gates(counts: DataFrame) -> DataFrame:
    """patch_id, gate_contrast, gate_all_witnessed, gate_no_surplus (true: passed), exit_code with all gates required."""
    g = counts.select(
        "patch_id", F.col("contrast").eqNullSafe(F.lit(CONTRASTS[0])).alias("gate_contrast"), ((F.col("unwitnessed") == 0) & (F.col("inconclusive") == 0)).alias("gate_all_witnessed"), (F.col("surplus") == 0).alias("gate_no_surplus")
    )
    return g.withColumn("exit_code", F.when(F.col("gate_contrast") & F.col("gate_all_witnessed") & F.col("gate_no_surplus"), 0).otherwise(1))


def ci_outputs(counts: DataFrame) -> DataFrame:
    """patch_id, key, value: what a CI step hands on."""
    text = lambda c: F.col(c).cast("string")
    values = {
        "certificate_id": F.col("certificate_id"), "contrast": F.coalesce("contrast", F.lit("")), "witnessed": text("witnessed"), "unwitnessed": text("unwitnessed"), "inconclusive": text("inconclusive"),
        "witness_ratio": F.when(F.col("witness_ratio").isNull(), "").otherwise(F.format_string("%.6f", "witness_ratio")),
        "minimal_sufficient_order": F.coalesce(text("found_order"), F.lit("")), "surplus_candidate_hunks": text("surplus"),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values.items()])
    return counts.select("patch_id", F.inline(pairs))


def markdown(report: DataFrame) -> DataFrame:
    """patch_id, markdown. Sections on sets, backups and surplus only where there are any."""
    bold = lambda name, c: F.concat(F.lit(f"- {name}: **"), c.cast("string"), F.lit("**"))
    tick = lambda labels, by: F.array_join(F.transform(labels, lambda m: F.concat(F.lit("`"), m["label"], F.lit("`"))), by)
    lines = lambda c, f: F.array_join(F.transform(c, f), "\n")

    def hunk(h):
        icon = F.when(h["status"] == WITNESSED, ICONS[WITNESSED]).when(h["status"] == UNWITNESSED, ICONS[UNWITNESSED]).otherwise(ICONS["inconclusive"])
        time = F.when(h["runtime_s"].isNull(), "—").otherwise(F.concat(F.format_string("%.2f", h["runtime_s"]), F.lit("s")))
        return F.concat(F.lit("| "), icon, F.lit(" | `"), F.replace(h["label"], F.lit("|"), F.lit("\\|")), F.lit("` | +"), h["additions"].cast("string"), F.lit("/-"), h["deletions"].cast("string"), F.lit(" | "), time, F.lit(" |"))

    ratio = F.when(F.col("witness_ratio").isNull(), "- Witness ratio: n/a").otherwise(F.concat(F.lit("- Witness ratio: **"), F.format_string("%.1f", F.bround(F.col("witness_ratio") * 100, 1)), F.lit("%**")))
    order = F.when(F.coalesce("found_order", F.lit(0)) == 0, "- Minimal sufficient order: not found within budget").otherwise(bold("Minimal sufficient order", F.col("found_order")))
    by_id = F.array_sort(F.transform("surplus", lambda h: F.struct(h["id"].alias("id"), h["label"].alias("label"))))
    section = lambda c, title, text: F.when(F.size(c) > 0, F.concat(F.lit(f"\n\n## {title}\n\n"), text)).otherwise(F.lit(""))
    head = [
        F.lit("# Evidence certificate"), F.lit(""), F.concat(F.lit("**Certificate:** `"), F.col("certificate_id"), F.lit("`  ")), F.concat(F.lit("**Contrast:** `"), F.coalesce("contrast", F.lit("")), F.lit("`  ")),
        F.concat(F.lit("**Candidate stability:** `"), F.coalesce("candidate", F.lit("")), F.lit("`  ")), F.concat(F.lit("**Baseline stability:** `"), F.coalesce("baseline", F.lit("")), F.lit("`")),
        F.lit(""), F.lit("## Evidence summary"), F.lit(""), bold("Witnessed hunks", F.col("witnessed")), bold("Unwitnessed hunks", F.col("unwitnessed")), bold("Inconclusive hunks", F.col("inconclusive")),
        ratio, order, bold("Mutual-backup pairs", _count("backups")), bold("Surplus candidate hunks", _count("surplus")),
        F.lit(""), F.lit("## Hunk witness map"), F.lit(""), F.lit("| Status | Change | Delta | Runtime |"), F.lit("|---|---|---:|---:|"), lines("results", hunk),
    ]
    sets = section("sufficient_sets", "Minimal sufficient sets", lines("sufficient_sets", lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), tick(s["members"], ", "))))
    backups = section("backups", "Hidden redundancy / mutual backup", lines("backups", lambda s: F.concat(F.lit("- "), tick(s["members"], " + "))))
    surplus = section("surplus", "Strong surplus candidates", F.concat(F.lit(SURPLUS_TEXT + "\n"), lines(by_id, lambda h: F.concat(F.lit("- `"), h["label"], F.lit("`")))))
    end = F.lit(f"\n\n## What this proves — and what it does not\n\n{LIMITS_TEXT}\n")
    return report.select("patch_id", F.concat(F.array_join(F.array(*head), "\n"), sets, backups, surplus, end).alias("markdown"))


def _hashed(text: Column) -> Column:
    return F.concat(F.lit(CERTIFICATE_PREFIX), F.substring(F.sha2(text.cast("binary"), 256), 1, 20))


def certificate_ids(report: DataFrame) -> DataFrame:
    """patch_id, certificate_id: a hash of each report's canonical JSON, over all columns as they are. reports() has one over document(),
    whose fractions have fixed digits."""
    fields = [c for c in report.columns if c not in ("patch_id", "certificate_id")]
    return report.select("patch_id", _hashed(canonical(F.struct(*fields), report.select(*fields).schema)).alias("certificate_id"))
