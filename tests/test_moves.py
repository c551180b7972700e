"""What queries move between tasks, and the parser against plain Python."""

import os
import re

import pytest

from ablatrix import catalog
from ablatrix.operators import search
from ablatrix.plans import parse
from ablatrix.sources import adapters

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return len(re.findall(r"Exchange (?:hash|range|Round|Single)", plan(df)))


@tables
def test_diffs_are_made_with_one_shuffle(spark):
    assert shuffles(adapters.patches(spark, DATA)) == 1
    assert shuffles(catalog.mutation_ids(spark, DATA)) == shuffles(catalog.hunk_ranges(spark, DATA)) == shuffles(catalog.inverse_patches(spark, DATA)) == 1
    assert "collect_list" in plan(adapters.patches(spark, DATA)) and "Window" not in plan(adapters.patches(spark, DATA))


@tables
def test_missing_variants_move_no_line_items(spark):
    text = plan(catalog.missing_variants(spark, DATA))
    assert "l_extendedprice" not in text and "Window" not in text and "Generate explode(sequence(0, 2" not in text


@tables
def test_surplus_makes_the_search_once(spark):
    assert plan(catalog.surplus_mutations(spark, DATA)).count("- Union") == 1


@tables
def test_recorded_outcomes_need_no_keys_of_their_own(spark):
    assert "array_sort(transform(members" not in plan(catalog.greedy_recorded(spark, DATA))


LINES = re.compile(r"(?<=[\n\x0b\x0c\x1c-\x1e\x85\u2028\u2029])|(?<=\r)(?!\n)")


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r", "\x0b", "\x1c", "\x85", "\u2028"])
def test_hunks_like_plain_python(spark, end):
    block = ["diff --git a/x b/x", "--- a/x", "+++ b/x", "@@ -1,2 +3 @@ a, b", "+one", "++two", "+++three", "++++four", "-x", "---y", " @@ no", "-\x01@@ z", "@@ odd, header", "+k", "@@ -1,99999999999 +5,0 @@"]
    # a diff's first lines end in \n
    text = "\n".join(block[:3]) + "\n" + "".join(line + end for line in block[3:]) + "\n"
    rows = parse.file_patches(spark.createDataFrame([(1, text), (2, "before\n" + text + text)], "patch_id bigint, diff_text string")).orderBy("patch_id", "file_ord").collect()
    assert [(r.patch_id, r.file_ord, r.path) for r in rows] == [(1, 0, "x"), (2, 0, "x"), (2, 1, "x")]
    lines = [x for x in LINES.split(text) if x]
    starts = [i for i, x in enumerate(lines) if x.startswith("@@ ")]
    for r in rows:
        assert r.header == "".join(lines[: starts[0]])
        want = [lines[a:b] for a, b in zip(starts, [*starts[1:], len(lines)])]
        assert [h.text for h in r.hunks] == ["".join(w) for w in want]
        assert [h.header for h in r.hunks] == [w[0].rstrip("\n") for w in want]
        for sign, field in (("+", "additions"), ("-", "deletions")):
            assert [h[field] for h in r.hunks] == [sum(x.startswith(sign) and not x.startswith(sign * 3) for x in w) for w in want]
        assert [tuple(h[4:]) for h in r.hunks] == [(1, 2, 3, 1), (None,) * 4, (1, 1, 5, 0)]


def test_surplus_of_searches_that_end_at_any_order(spark):
    """Patch 1 is searched whole at order 1, 2's budget ends before, 3 has no sufficient set."""
    units = [(p, i, 3, {"id": f"{p}{i}", "label": "", "weight": w}) for p, ws in ((1, (16, 4, 5)), (2, (4, 4, 4)), (3, (5, 5, 5))) for i, w in enumerate(ws)]
    df = spark.createDataFrame(units, "patch_id bigint, idx int, n int, unit struct<id string, label string, weight bigint>")
    tried = search.sufficient_search(df, search.computed(adapters.subset_class(adapters.member_total())), 3, 7).cache()
    results = df.selectExpr("patch_id", "unit.id as id", "'unwitnessed' as status")
    ids = tried.filter("status = 'sufficient'").selectExpr("patch_id", "explode(members.id) as id").distinct()
    whole = search.sufficient_summary(df.selectExpr("patch_id", "n", "true as baseline_fails").distinct(), tried, 3, 7).filter("exhaustive")
    got = sorted(r.id for r in search.surplus_of(results, tried).collect())
    assert got == sorted(r.id for r in search.surplus(results, ids, whole).collect()) == ["11", "12"]
