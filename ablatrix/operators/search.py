"""Budgeted level-wise search over combinations of hunks, as sets.

A combination's place in the sequence (order, then lexicographic) is a closed form of its indexes, so the budget prunes prefixes
before each self-join: per patch at most about budget + n rows exist at a level, and neither a window nor a sort ranks them. All
joins are on patch_id, so no level needs another partitioning than the one before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import binomial
from ..schema import FLAKY, INCONCLUSIVE, MUTUAL_BACKUP, STABLE_FAIL, STABLE_PASS, SUFFICIENT, TIMEOUT

#: Classes of a combination's variant, given its row (with key, members, ord); or see recorded().
Evaluate = Callable[[DataFrame], DataFrame]


def recorded(outcomes: DataFrame) -> Evaluate:
    """Outcomes by patch_id and variant_key (comma-joined indexes). A combination without one has a null class."""
    found = outcomes.select("patch_id", F.col("variant_key").alias("key"), F.col("classification").alias("class"))
    return lambda rows: rows.join(found, ["patch_id", "key"], "left")


def computed(expression: Column) -> Evaluate:
    """Outcomes that are a function of the row."""
    return lambda rows: rows.withColumn("class", expression)


def combinations(units: DataFrame, max_order: int, budget: int, min_order: int = 1) -> DataFrame:
    """patch_id, n, ord, rank, key, members: the first `budget` combinations of each patch, in sequence.

    units: patch_id, idx (0-based within the patch), n (units of the patch), unit (any value, kept in members)."""
    n = F.col("n")
    levels = []
    offset = F.lit(0).cast("bigint")
    base = units.select("patch_id", F.col("n").cast("bigint").alias("n"), F.col("idx").cast("bigint").alias("idx"), "unit")
    for k in range(min_order, max_order + 1):
        rows = None
        for m in range(1, k + 1):
            r = k - m + 1
            if rows is None:
                rank = binomial(n, r) - binomial(n - F.col("idx"), r)
                rows = base.select("patch_id", "n", F.col("idx").alias("last"), (offset + rank + 1).alias("rank"), F.array("unit").alias("members"), F.array("idx").alias("at"))
            else:
                right = base.select(F.col("patch_id").alias("other"), "idx", "unit")
                rows = rows.join(right, (F.col("patch_id") == F.col("other")) & (F.col("last") < F.col("idx")))
                rank = F.col("rank") + binomial(n - 1 - F.col("last"), r) - binomial(n - F.col("idx"), r)
                rows = rows.select("patch_id", "n", F.col("idx").alias("last"), rank.alias("rank"), F.concat("members", F.array("unit")).alias("members"), F.concat("at", F.array("idx")).alias("at"))
            # the first completion of a prefix takes the next indexes in a row, so its rank is the prefix's
            rows = rows.filter((F.col("rank") <= budget) & (n - F.col("last") > k - m))
        levels.append(rows.select("patch_id", "n", F.lit(k).alias("ord"), "rank", F.array_join(F.transform("at", lambda i: i.cast("string")), ",").alias("key"), "members"))
        offset = offset + binomial(n, k)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def tried(rows: DataFrame) -> DataFrame:
    """Of combinations with their class, those up to the first order with a stable pass: with found_order (of the patch) and status:
    sufficient, inconclusive, or null (failed, or didn't apply)."""
    found = F.min(F.when(F.col("class") == STABLE_PASS, F.col("ord"))).over(Window.partitionBy("patch_id"))
    rows = rows.withColumn("found_order", found).filter(F.col("found_order").isNull() | (F.col("ord") <= F.col("found_order")))
    return rows.withColumn("status", F.when(F.col("class") == STABLE_PASS, SUFFICIENT).when(F.col("class").isin(FLAKY, TIMEOUT), INCONCLUSIVE))


def sufficient_search(units: DataFrame, evaluate: Evaluate, max_order: int = 3, budget: int = 32) -> DataFrame:
    """The combinations tried: those of combinations() with class, found_order and status."""
    return tried(evaluate(combinations(units, max_order, budget)))


NOTES = {
    "no-contrast": "Skipped: sufficiency requires a stable-failing base with candidate tests overlaid.",
    "no-production": "Skipped: no production mutations to search.",
    "budget": "No sufficient subset found before the search budget was exhausted.",
    "order": "No sufficient subset found within the configured maximum order.",
    "no-pairs": "No pair search needed: fewer than two unwitnessed production hunks.",
    "no-backup": "No mutual-backup pair found within the interaction search budget.",
}


def sufficient_summary(patches: DataFrame, tried: DataFrame, max_order: int = 3, budget: int = 32) -> DataFrame:
    """patches: patch_id, n, baseline_fails. One row each: attempted, found_order, exhaustive, missing_outcomes, note."""
    sums = tried.groupBy("patch_id").agg(
        F.count("*").alias("attempted"), F.max("found_order").alias("found_order"), F.count_if(F.col("ord") == F.col("found_order")).alias("_at"), F.count_if(F.col("class").isNull()).alias("missing_outcomes")
    )
    n = F.col("n").cast("bigint")
    rows = patches.join(sums, "patch_id", "left").fillna(0, ["attempted", "_at", "missing_outcomes"])
    total, size = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    for k in range(1, max_order + 1):
        total, size = total + binomial(n, k), F.when(F.col("found_order") == k, binomial(n, k)).otherwise(size)
    note = (
        F.when(~F.col("baseline_fails"), NOTES["no-contrast"]).when(n == 0, NOTES["no-production"]).when(F.col("found_order").isNotNull(), None)
        .when((F.col("attempted") >= budget) & (total > budget), NOTES["budget"]).otherwise(NOTES["order"])
    )
    return rows.select("patch_id", F.lit(budget).alias("budget"), "attempted", "found_order", F.coalesce(F.col("_at") == size, F.lit(False)).alias("exhaustive"), "missing_outcomes", note.alias("note"))


def tried_pairs(rows: DataFrame) -> DataFrame:
    """Pairs with their class, with status: mutual-backup, inconclusive, or null."""
    return rows.withColumn("status", F.when(F.col("class") == STABLE_FAIL, MUTUAL_BACKUP).when(F.col("class").isin(FLAKY, TIMEOUT), INCONCLUSIVE))


def interaction_search(units: DataFrame, evaluate: Evaluate, budget: int = 20) -> DataFrame:
    """Pairs of individually removable units that were tried."""
    return tried_pairs(evaluate(combinations(units, 2, budget, min_order=2)))


def interaction_summary(patches: DataFrame, tried: DataFrame, budget: int = 20) -> DataFrame:
    """patches: patch_id, n (removable units). found_order is 2 if any row exists; exhaustive means that all pairs were tried."""
    sums = tried.groupBy("patch_id").agg(F.count("*").alias("attempted"), F.count("status").alias("_rows"))
    rows = patches.join(sums, "patch_id", "left").fillna(0, ["attempted", "_rows"])
    n = F.col("n").cast("bigint")
    note = F.when(n < 2, NOTES["no-pairs"]).when(F.col("_rows") == 0, NOTES["no-backup"])
    return rows.select("patch_id", F.lit(budget).alias("budget"), "attempted", F.when(F.col("_rows") > 0, F.lit(2)).alias("found_order"), ((n >= 2) & (F.col("attempted") == binomial(n, 2))).alias("exhaustive"), note.alias("note"))


def surplus(results: DataFrame, sufficient_ids: DataFrame, exhaustive: DataFrame) -> DataFrame:
    """Unwitnessed rows of results whose id is in no sufficient set, in patches where the search was exhaustive at the order found.

    sufficient_ids: distinct (patch_id, id). exhaustive: patch_id of such patches."""
    rows = results.filter("status = 'unwitnessed'").join(exhaustive.select("patch_id"), "patch_id", "left_semi")
    return rows.join(sufficient_ids, ["patch_id", "id"], "left_anti")


def surplus_of(results: DataFrame, tried: DataFrame, max_order: int = 3) -> DataFrame:
    """surplus(), from the search itself, made once: combinations are counted where they lie by patch, and of patches whose search was
    exhaustive only the sufficient ones are gathered, of which such a patch has at least one."""
    n, size = F.col("n"), F.lit(None).cast("bigint")
    for k in range(1, max_order + 1):
        size = F.when(F.col("found_order") == k, binomial(n, k)).otherwise(size)
    at = F.count_if(F.col("ord") == F.col("found_order")).over(Window.partitionBy("patch_id"))
    found = tried.withColumn("_at", at).filter((F.col("status") == SUFFICIENT) & (F.col("_at") == size))
    patches = found.groupBy("patch_id").agg(F.flatten(F.collect_list("members.id")).alias("_used"))
    rows = results.filter("status = 'unwitnessed'").join(patches, "patch_id")
    return rows.filter(~F.array_contains("_used", F.col("id"))).select(*results.columns)
