"""Greedy reduction: a fold over each patch's hunks, patches in parallel."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..schema import INCONCLUSIVE, STABLE_PASS, UNWITNESSED, WITNESSED


def removal_rank(status: Column) -> Column:
    """Hunks shown to be removable first, then what is open, then the witnessed ones."""
    return F.when(status == UNWITNESSED, 0).when(status == WITNESSED, 2).otherwise(1)


def greedy_reduction(results: DataFrame, weight: Column, stays_green: Callable[[Column], Column]) -> DataFrame:
    """patch_id, removed_ids (in order of removal). results: patch_id, mut_ord, id, status.

    stays_green(total) tells whether the candidate stays green without the hunks whose weights sum up to total."""
    item = F.struct(removal_rank(F.coalesce("status", F.lit(INCONCLUSIVE))).alias("rank"), "mut_ord", "id", weight.cast("bigint").alias("weight"))
    ordered = results.groupBy("patch_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.expr("struct(cast(0 as bigint) as total, cast(array() as array<string>) as ids)")

    def step(acc, x):
        total = acc["total"] + x["weight"]
        return F.when(stays_green(total), F.struct(total.alias("total"), F.concat(acc["ids"], F.array(x["id"])).alias("ids"))).otherwise(acc)

    return ordered.select("patch_id", F.aggregate("items", start, step, lambda acc: acc["ids"]).alias("removed_ids"))


def fold(ords: list[int], green: dict[int, bool]) -> tuple[list[int], list[int] | None]:
    """The places in ords of what comes off, and those of the first set of hunks without a record (null: none), after which the fold
    goes on as if that had failed. green: by set of mut_ords, as the number whose bits they are, whether that passed."""
    taken, held, unknown = [], 0, None
    for place, ord_ in enumerate(ords):
        asked = held | 1 << ord_
        if asked in green:
            if green[asked]:
                taken.append(place)
                held = asked
        elif unknown is None:
            unknown = [*taken, place]
    return taken, unknown


def greedy_recorded(results: DataFrame, outcomes: DataFrame) -> DataFrame:
    """patch_id, removed (mut_ords in order of removal), removed_ids, missing: as greedy_reduction(), from recorded outcomes.

    outcomes: patch_id, variant_key (comma-joined mut_ords, in any order), classification. A removal without a record is not taken;
    `missing` has the mut_ords of the first one, in order of removal, or is null. Each patch's outcomes are read into a
    dictionary once, so that a patch costs as many look-ups as it has hunks; keys that patches share are parsed once a batch."""
    item = F.struct(removal_rank(F.coalesce("status", F.lit(INCONCLUSIVE))).alias("rank"), "mut_ord", "id")
    ordered = results.groupBy("patch_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    passed = F.coalesce(F.col("classification") == STABLE_PASS, F.lit(False))
    known = outcomes.filter("variant_key <> ''").groupBy("patch_id").agg(F.collect_list("variant_key").alias("keys"), F.collect_list(passed).alias("passed"))
    rows = ordered.join(known, "patch_id", "left")
    rows = rows.select("patch_id", F.transform("items", lambda x: x["mut_ord"]).alias("ords"), F.transform("items", lambda x: x["id"]).alias("ids"), "keys", "passed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            keys = batch.column(3).flatten().dictionary_encode()
            sets = [sum(1 << int(i) for i in k.split(",")) for k in keys.dictionary.to_pylist()]
            green = list(zip((sets[i] for i in keys.indices.to_numpy().tolist()), batch.column(4).flatten().to_numpy(zero_copy_only=False).tolist()))
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(3)), 0).to_numpy()).tolist()
            flat = [batch.column(i).flatten().to_pylist() for i in (1, 2)]
            last = np.cumsum(pc.list_value_length(batch.column(1)).to_numpy()).tolist()
            for start, end, a, b in zip([0, *ends], ends, [0, *last], last):
                ords, ids = flat[0][a:b], flat[1][a:b]
                taken, unknown = fold(ords, dict(green[start:end]))
                for column, value in zip(out, ([ords[i] for i in taken], [ids[i] for i in taken], unknown and [ords[i] for i in unknown])):
                    column.append(value)
            types = pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, types))], names=["patch_id", "removed", "removed_ids", "missing"])

    return rows.mapInArrow(run, "patch_id bigint, removed array<int>, removed_ids array<string>, missing array<int>")
