"""Necessity: one variant per hunk, joined to its recorded outcome; summaries and roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import APPLY_ERROR, INCONCLUSIVE, ROLES, UNWITNESSED, WITNESSED
from .stability import status


def ablation_variants(mutations: DataFrame) -> DataFrame:
    """patch_id, variant_kind, variant_key of the candidate without each hunk."""
    return mutations.select("patch_id", F.lit("ablate").alias("variant_kind"), F.col("mut_ord").cast("string").alias("variant_key"))


def mutation_results(mutations: DataFrame, sets: DataFrame) -> DataFrame:
    """mutations with status, classification (null: not recorded) and runtime_s. sets: run sets; their kind `ablate` is used.

    A variant without a record is inconclusive and shows as such (classification null); it is never taken as a pass."""
    found = sets.filter("variant_kind = 'ablate'").select("patch_id", F.col("variant_key").cast("int").alias("mut_ord"), "classification", F.col("total_duration_s").alias("runtime_s"))
    rows = mutations.join(found, ["patch_id", "mut_ord"], "left")
    applied = F.when(F.col("classification") == APPLY_ERROR, None).otherwise(F.col("classification"))
    return rows.withColumn("status", status(applied))


def witness_summary(results: DataFrame) -> DataFrame:
    """patch_id, mutations, witnessed, unwitnessed, inconclusive, witness_ratio (null without a conclusive hunk)."""
    n = lambda s: F.count_if(F.col("status") == s)
    return results.groupBy("patch_id").agg(
        F.count("*").alias("mutations"), n(WITNESSED).alias("witnessed"), n(UNWITNESSED).alias("unwitnessed"), n(INCONCLUSIVE).alias("inconclusive"),
        F.try_divide(n(WITNESSED).cast("double"), n(WITNESSED) + n(UNWITNESSED)).alias("witness_ratio"),
    )


def role(status_: Column) -> Column:
    return F.when(status_ == WITNESSED, ROLES[WITNESSED]).when(status_ == UNWITNESSED, ROLES[UNWITNESSED]).otherwise(ROLES[INCONCLUSIVE])


def mutation_roles(results: DataFrame, sufficient_ids: DataFrame) -> DataFrame:
    """results with role and in_minimal_sufficient_set. sufficient_ids: distinct (patch_id, id)."""
    flag = sufficient_ids.select("patch_id", "id", F.lit(True).alias("_in"))
    rows = results.join(flag, ["patch_id", "id"], "left")
    return rows.select(*results.columns, role(F.col("status")).alias("role"), F.coalesce("_in", F.lit(False)).alias("in_minimal_sufficient_set"))
