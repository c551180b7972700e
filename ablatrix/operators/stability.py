"""Repeated runs to run sets: one aggregate per variant, combined within each task before anything moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import CONTRASTS, FLAKY, INCONCLUSIVE, STABLE_FAIL, STABLE_PASS, TIMEOUT, UNWITNESSED, WITNESSED

VARIANT = ("patch_id", "variant_kind", "variant_key")


def passed() -> Column:
    return ~F.col("timed_out") & F.col("returncode").eqNullSafe(F.lit(0))


def classification() -> Column:
    """Any timeout: timeout; all passed: stable-pass; none passed: stable-fail; else flaky."""
    return F.when(F.bool_or("timed_out"), TIMEOUT).when(F.bool_and(passed()), STABLE_PASS).when(~F.bool_or(passed()), STABLE_FAIL).otherwise(FLAKY)


def run_sets(runs: DataFrame) -> DataFrame:
    """patch_id, variant_kind, variant_key, classification, n_runs, total_duration_s."""
    return runs.groupBy(*VARIANT).agg(
        classification().alias("classification"), F.count("*").alias("n_runs"), F.round(F.coalesce(F.sum("duration_s"), F.lit(0.0)), 4).alias("total_duration_s")
    )


def status(class_: Column) -> Column:
    """Of a hunk, from the class of the candidate without it; a missing or failed application is inconclusive."""
    return F.when(class_ == STABLE_FAIL, WITNESSED).when(class_ == STABLE_PASS, UNWITNESSED).otherwise(INCONCLUSIVE)


def contrast(candidate: Column, baseline: Column) -> Column:
    return (
        F.when(~candidate.eqNullSafe(F.lit(STABLE_PASS)), CONTRASTS[3]).when(baseline == STABLE_FAIL, CONTRASTS[0]).when(baseline == STABLE_PASS, CONTRASTS[1]).otherwise(CONTRASTS[2])
    )


def patch_classes(sets: DataFrame) -> DataFrame:
    """patch_id, candidate, baseline (classes), contrast: one aggregate instead of a join of the two kinds."""
    of = lambda kind: F.max(F.when(F.col("variant_kind") == kind, F.col("classification")))
    rows = sets.filter(F.col("variant_kind").isin("candidate", "baseline")).groupBy("patch_id").agg(of("candidate").alias("candidate"), of("baseline").alias("baseline"))
    return rows.withColumn("contrast", contrast(F.col("candidate"), F.col("baseline")))


def rejected(classes: DataFrame) -> DataFrame:
    """patch_id, reason: patches whose candidate is not stably green can't be interpreted."""
    bad = classes.filter(~F.col("candidate").eqNullSafe(F.lit(STABLE_PASS)))
    return bad.select("patch_id", F.concat(F.lit("candidate is not stably green: "), F.coalesce("candidate", F.lit("not recorded"))).alias("reason"))
