"""What has to run: one relation of variants of all kinds, and which repetitions of them are not recorded yet.

A variant is a patch_id, variant_kind and variant_key: `` for candidate and baseline, the mut_ord of an ablation, else the sorted
mut_ords of its hunks, comma-joined. `units` are hunks (mut_ord, id, patch and any further fields)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import ABLATE, BASELINE, CANDIDATE

KEYS = ("patch_id", "variant_kind", "variant_key")


def key_of(units: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.transform(units, lambda u: u["mut_ord"])), lambda i: i.cast("string")), ",")


def whole(patches: DataFrame) -> DataFrame:
    """Candidate and baseline of each patch."""
    kinds = F.explode(F.array(F.lit(CANDIDATE), F.lit(BASELINE))).alias("variant_kind")
    return patches.select("patch_id", kinds, F.lit("").alias("variant_key"))


def ablations(mutations: DataFrame, *more: str | Column) -> DataFrame:
    """The candidate without each hunk."""
    return mutations.select("patch_id", F.lit(ABLATE).alias("variant_kind"), F.col("mut_ord").cast("string").alias("variant_key"), *more)


def combined(combinations: DataFrame, kind: str, *more: str | Column) -> DataFrame:
    """A variant for each of combinations (patch_id, members: units)."""
    return combinations.select("patch_id", F.lit(kind).alias("variant_kind"), key_of(F.col("members")).alias("variant_key"), *more)


def missing(planned: DataFrame, recorded: DataFrame, reps: int) -> DataFrame:
    """The planned variants that lack any of the repetitions 0 to reps - 1, with those they lack (`reps`, sorted).

    recorded: KEYS, rep and, where variants can fail as a whole, apply_error and failure: such a row stands for all repetitions. Both
    sides meet once, by KEYS: a row a variant on either, however many repetitions."""
    ended = [c for c in ("apply_error", "failure") if c in recorded.columns]
    over = F.bool_or(F.coalesce(*ended).isNotNull()) if ended else F.lit(False)
    have = recorded.groupBy(*KEYS).agg(F.collect_set("rep").alias("_have"), over.alias("_over"))
    reps_ = F.array_except(F.sequence(F.lit(0), F.lit(reps - 1)), F.coalesce("_have", F.array().cast("array<int>")))
    rows = planned.join(have, list(KEYS), "left").filter(~F.coalesce("_over", F.lit(False))).withColumn("reps", reps_).filter(F.size("reps") > 0)
    return rows.drop("_have", "_over")
