"""Literal fixtures, and the set-based search against a sequential simulation."""

import hashlib
import itertools
import json
import random
import shlex

import pytest
from pyspark.sql import functions as F

from ablatrix.functions.text import glob_regex, is_test_path, tail
from ablatrix.operators import evidence, reduce, report, search, stability
from ablatrix.plans import parse
from ablatrix.schema import OUTCOMES, RUNS, Config
from ablatrix.sources import config

DIFF = """diff --git a/app.py b/app.py
--- a/app.py
+++ b/app.py
@@ -10,2 +10,3 @@ def f
 same
-old
+new
+more
diff --git a/tests/test_app.py b/tests/test_app.py
new file mode 100644
--- /dev/null
+++ b/tests/test_app.py
@@ -0,0 +1 @@
+x
"""


def run_rows(rows):
    return [(1, "ablate", v, i, code, 1.0, "", "", late) for v, runs in rows.items() for i, (code, late) in enumerate(runs)]


def test_classification(spark):
    rows = {"a": [(0, False), (0, False)], "b": [(1, False), (2, False)], "c": [(0, False), (1, False)], "d": [(None, True), (0, False)]}
    found = stability.run_sets(spark.createDataFrame(run_rows(rows), RUNS)).collect()
    assert {r.variant_key: r.classification for r in found} == {"a": "stable-pass", "b": "stable-fail", "c": "flaky", "d": "timeout"}


def test_paths(spark):
    cases = [
        ("tests/test_calc.py", True), ("src/foo.spec.ts", True), ("src/calculator.py", False), ("checks/example.case", True), ("Src/Tests/x.py", True),
        ("CHECKS/a.case", False), ("a/test", True), ("checks/a/b.case", True), ("conftest.py", True), ("x/my_test.py", True),
    ]
    df = spark.createDataFrame(cases, "path string, expected boolean")
    bad = df.filter(is_test_path(F.col("path"), ["checks/*.case"]) != F.col("expected")).collect()
    assert bad == []


@pytest.mark.parametrize("glob, path, ok", [("*.py", "a/b.py", True), ("[ab].c", "a.c", True), ("[!ab].c", "a.c", False), ("a?c", "abc", True), ("a.c", "abc", False), ("a", "a\n", False), ("[]]", "]", True), ("[x", "[x", True)])
def test_globs(spark, glob, path, ok):
    assert spark.createDataFrame([(path,)], "p string").select(F.col("p").rlike(glob_regex(glob))).first()[0] is ok


def test_one_hunk(spark):
    files = parse.file_patches(spark.createDataFrame([(1, DIFF), (2, ""), (3, None)], "patch_id bigint, diff_text string"))
    (m,) = parse.mutations(files).collect()
    assert (m.line, m.end_line, m.additions, m.deletions, m.kind, m.label) == (10, 12, 2, 1, "hunk", "app.py hunk 1/1 — def f")
    rows = parse.mutations(files, include_tests=True).orderBy("mut_ord").collect()
    assert [(r.kind, r.path) for r in rows] == [("hunk", "app.py"), ("structural", "tests/test_app.py")]
    counts = parse.ignored_counts(files).first()
    assert (counts.mutations, counts.ignored, counts.test_files) == (1, 1, ["tests/test_app.py"])
    assert parse.test_overlay(files).first().overlay == DIFF[DIFF.index("diff --git a/tests") :]


def test_odd_first_lines(spark):
    diffs = ['diff --git "a/x y.py" "b/x y.py"\n@@ -1 +1 @@\n-a\n+b\n', "diff --git a/my file.py b/my file.py\n@@ -1 +1 @@\n-a\n+++b\n", "diff --git a/it's.py b/it's.py\n", "diff --git a/x\n@@ bad @@\n+a\f+b\n"]
    files = parse.file_patches(spark.createDataFrame(list(enumerate(diffs)), "patch_id bigint, diff_text string")).orderBy("patch_id").collect()
    assert [(f.old_path, f.path) for f in files] == [("x y.py", "x y.py"), ("my", "file.py"), (None, "<unknown>"), (None, "<unknown>")]
    assert files[1].hunks[0].additions == 0
    assert files[2].structural
    h = files[3].hunks[0]
    assert (h.old_start, h.new_count, h.additions) == (None, None, 2)


def test_first_lines_read_like_a_shells(spark):
    def plain(line):
        try:
            words = shlex.split(line.strip())
        except ValueError:
            words = line.split()
        return (words[2].removeprefix("a/"), words[3].removeprefix("b/")) if len(words) >= 4 else (None, "<unknown>")

    rng = random.Random(8)
    lines = ["diff --git " + " ".join(side + "".join(rng.choice("ab/\"'\\ \t\u00a0\u3000é😀") for _ in range(rng.randint(0, 7))) for side in ("a/", "b/")) for _ in range(600)]
    lines += ['diff --git "a/x\\"y\\\\z\\n" \'b/q"\\\'', "diff --git '' \"\"", "diff --git a/x b/x\u00a0\x85", 'diff --git "a/' + "x\\\\y" * 60_000 + '" b/' + "\\ z" * 60_000]
    df = spark.createDataFrame(list(enumerate(lines)), "patch_id bigint, diff_text string")
    files = parse.file_patches(df)
    assert "ArrowEvalPython" not in files._jdf.queryExecution().toString()
    found = {r.patch_id: (r.old_path, r.path) for r in files.filter("file_ord = 0").select("patch_id", "old_path", "path").collect()}
    assert [found[i] for i in range(len(lines))] == [plain(x) for x in lines]


def test_lines_end_like_pythons(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab\n\r\x0b\x0c\x1c\x1d\x1e\x85   ") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", F.filter(F.split("t", parse.LINE_END), lambda x: x != "").alias("x")).collect():
        assert r.x == texts[r.i].splitlines(keepends=True)


def sequential(n, weight, classes, max_order, budget):
    """The search one combination after the other."""
    attempted, rows, found = 0, [], None
    for order in range(1, min(max_order, n) + 1):
        good, done = [], 0
        for combo in itertools.combinations(range(n), order):
            if attempted >= budget:
                break
            attempted, done = attempted + 1, done + 1
            c = classes(combo)
            if c == "stable-pass":
                good.append((combo, "sufficient"))
            elif c in ("flaky", "timeout"):
                rows.append((combo, "inconclusive"))
        if good:
            total = len(list(itertools.combinations(range(n), order)))
            return attempted, order, done == total, rows + good
        if attempted >= budget:
            break
    return attempted, None, False, rows


@pytest.mark.parametrize("max_order, budget", [(3, 20), (3, 1000), (2, 0), (4, 60)])
def test_search_against_simulation(spark, max_order, budget):
    rng = random.Random(max_order * 1000 + budget)
    sizes = {p: rng.randint(0, 7) for p in range(40)}
    table = {(p, c): rng.choice(["stable-pass"] + ["stable-fail"] * 12 + ["flaky", "timeout", "apply-error"]) for p, n in sizes.items() for k in range(1, max_order + 1) for c in itertools.combinations(range(n), k)}
    units = spark.createDataFrame([(p, i, n, (str(i), str(i))) for p, n in sizes.items() for i in range(n)], "patch_id bigint, idx int, n bigint, unit struct<id:string,label:string>")
    outcomes = spark.createDataFrame([(p, ",".join(map(str, c)), x) for (p, c), x in table.items()], OUTCOMES)
    tried = search.sufficient_search(units, search.recorded(outcomes), max_order, budget).cache()
    patches = spark.createDataFrame([(p, n, True) for p, n in sizes.items()], "patch_id bigint, n bigint, baseline_fails boolean")
    summary = {r.patch_id: r for r in search.sufficient_summary(patches, tried, max_order, budget).collect()}
    got = {}
    for r in tried.filter("status is not null").collect():
        got.setdefault(r.patch_id, set()).add((tuple(map(int, r.key.split(","))), r.status))
    for p, n in sizes.items():
        attempted, order, exhaustive, rows = sequential(n, None, lambda c: table[p, c], max_order, budget)
        s = summary[p]
        assert (s.attempted, s.found_order, s.exhaustive, s.missing_outcomes) == (attempted, order, exhaustive, 0), p
        assert got.get(p, set()) == set(rows), p


def test_missing_outcomes_show(spark):
    units = spark.createDataFrame([(1, i, 2, (str(i), "")) for i in range(2)], "patch_id bigint, idx int, n bigint, unit struct<id:string,label:string>")
    tried = search.sufficient_search(units, search.recorded(spark.createDataFrame([(1, "0", "stable-fail")], OUTCOMES)))
    patches = spark.createDataFrame([(1, 2, True), (2, 0, True), (3, 2, False)], "patch_id bigint, n bigint, baseline_fails boolean")
    rows = {r.patch_id: r for r in search.sufficient_summary(patches, tried).collect()}
    assert rows[1].missing_outcomes == 2 and rows[1].note == search.NOTES["order"]
    assert rows[2].note == search.NOTES["no-production"] and rows[3].note == search.NOTES["no-contrast"]


def test_core_and_surplus(spark):
    """Three hunks: 0 and 1 are needed together, 2 is surplus."""
    schema = "patch_id bigint, mut_ord int, n bigint, id string, path string, label string, additions int, deletions int, line int, end_line int, status string, runtime_s double"
    status = ["witnessed", "witnessed", "unwitnessed"]
    results = spark.createDataFrame([(1, i, 3, f"m{i}", "calc.py", f"calc.py hunk {i + 1}/3", 1, 1, i, i, s, 0.5) for i, s in enumerate(status)], schema)
    outcomes = spark.createDataFrame([(1, k, "stable-pass" if k == "0,1" else "stable-fail") for k in ("0", "1", "2", "0,1", "0,2", "1,2")], OUTCOMES)
    units = results.select("patch_id", F.col("mut_ord").alias("idx"), "n", F.struct("id", "label").alias("unit"))
    tried = search.sufficient_search(units, search.recorded(outcomes))
    patches = spark.createDataFrame([(1, 3, True)], "patch_id bigint, n bigint, baseline_fails boolean")
    summary = search.sufficient_summary(patches, tried)
    s = summary.first()
    assert (s.attempted, s.found_order, s.exhaustive) == (6, 2, True)
    ids = tried.filter("status = 'sufficient'").select("patch_id", F.explode("members.id").alias("id")).distinct()
    assert [r.id for r in search.surplus(results, ids, summary.filter("exhaustive")).collect()] == ["m2"]
    roles = {r.id: (r.role, r.in_minimal_sufficient_set) for r in evidence.mutation_roles(results, ids).collect()}
    assert roles["m0"] == ("essential-under-selected-evidence", True) and roles["m2"] == ("individually-removable-under-selected-evidence", False)
    assert evidence.witness_summary(results).first().witness_ratio == pytest.approx(2 / 3)
    greedy = spark.createDataFrame([(1, k, c) for k, c in (("2", "stable-pass"), ("0,2", "stable-fail"), ("1,2", "stable-fail"))], OUTCOMES)
    assert reduce.greedy_recorded(results, greedy).first().removed_ids == ["m2"]
    classes = spark.createDataFrame([(1, "stable-pass", "stable-fail", "base-fail_candidate-pass")], "patch_id bigint, candidate string, baseline string, contrast string")
    none = search.interaction_search(units.limit(0), search.recorded(outcomes))
    full = report.reports(results, classes, summary, tried, none)
    counts = report.report_counts(full)
    assert counts.first().surplus == 1 and counts.first().sufficient_sets == 1
    assert report.gates(counts).first().exit_code == 1
    text = report.markdown(full).first().markdown
    assert "1. `calc.py hunk 1/3`, `calc.py hunk 2/3`" in text and "- `calc.py hunk 3/3`" in text and "Witness ratio: **66.7%**" in text and "mutual backup" not in text
    row = full.select("certificate_id", report.document().alias("d")).first()
    body = json.dumps(row.d.asDict(True), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert row.certificate_id == "dw2_" + hashlib.sha256(body.encode()).hexdigest()[:20] and f"**Certificate:** `{row.certificate_id}`" in text
    assert [len(row.d[k]) for k in ("results", "sufficient_sets", "surplus", "backups")] == [3, 1, 1, 0]
    assert [r.key for r in report.ci_outputs(counts).collect()][:2] == ["certificate_id", "contrast"] and report.ci_outputs(counts).count() == 8
    assert {r.key: r.value for r in report.ci_outputs(counts).collect()}["witness_ratio"] == "0.666667"


def test_certificates_cover_the_whole_report(spark, monkeypatch):
    """Reports of equal counts differ by what they hold; the ids are hashes of Python's json."""
    import __spark_entry__ as entry
    from ablatrix import catalog

    hunk = "array<struct<mut_ord:int,id:string,label:string,status:string,runtime_s:double>>"
    sets = "array<struct<rank:bigint,members:array<struct<id:string,label:string>>>>"
    schema = f"patch_id bigint, contrast string, candidate string, results {hunk}, mutations bigint, witnessed bigint, unwitnessed bigint, inconclusive bigint, witness_ratio double, found_order int, sufficient_sets {sets}, backups {sets}, surplus {hunk}"
    one = lambda i, label, time: (0, i, label, "witnessed", time)
    row = lambda p, h, s: (p, "base-fail_candidate-pass", None, [h], 1, 1, 0, 0, 1 / 3, 1, s, None, [])
    rows = [row(1, one("a", "ä \"x\"/1", 1e-7), [(1, [("a", "ä")])]), row(2, one("b", "ä \"x\"/1", 1e-7), [(1, [("a", "ä")])]), row(3, one("a", "ä \"x\"/1", 1e20), None), row(4, one("a", "ä \"x\"/1", 0.5), [(2, [("a", "ä")])])]
    full = spark.createDataFrame(rows, schema)
    monkeypatch.setattr(catalog, "_reports", lambda *_: full)
    got = {r.patch_id: r.certificate_id for r in entry.queries()["report_certificate_id"](spark, "").collect()}
    for r in full.collect():
        stable = {k: v for k, v in r.asDict(True).items() if k != "patch_id"}
        text = json.dumps(stable, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert got[r.patch_id] == "dw2_" + hashlib.sha256(text.encode()).hexdigest()[:20]
    assert len(set(got.values())) == 4


def test_mutual_backup(spark):
    units = spark.createDataFrame([(1, i, 2, (f"m{i}", "")) for i in range(2)], "patch_id bigint, idx int, n bigint, unit struct<id:string,label:string>")
    pairs = search.interaction_search(units, search.recorded(spark.createDataFrame([(1, "0,1", "stable-fail")], OUTCOMES)))
    assert [r.status for r in pairs.collect()] == ["mutual-backup"]
    s = search.interaction_summary(spark.createDataFrame([(1, 2), (2, 1)], "patch_id bigint, n bigint"), pairs).orderBy("patch_id").collect()
    assert (s[0].found_order, s[0].exhaustive, s[0].note) == (2, True, None)
    assert (s[1].found_order, s[1].exhaustive, s[1].note) == (None, False, search.NOTES["no-pairs"])


def test_annotation_escapes(spark):
    row = spark.createDataFrame([(1, 0, "src/a,b.py", 7, 9, "unwitnessed"), (1, 1, "x", 0, None, "witnessed")], "patch_id bigint, mut_ord int, path string, line int, end_line int, status string")
    (r,) = report.annotations(row).collect()
    assert r.annotation.startswith("::warning file=src/a%2Cb.py,") and "line=7" in r.annotation and "endLine=9" in r.annotation


def test_tail(spark):
    df = spark.createDataFrame([("x" * 6000 + "y",), (None,)], "t string")
    assert [len(r[0]) for r in df.select(tail(F.col("t"))).collect()] == [5000, 0]


def test_config(tmp_path, spark):
    path = config.write(tmp_path / "e.toml", 'say "hi"', prepare="a\\b")
    assert config.load(path)["test"] == 'say "hi"' and config.load(path)["prepare"] == "a\\b"
    with pytest.raises(FileExistsError):
        config.write(path, "x")
    assert config.load(tmp_path / "none.toml") == {}
    assert config.pick_list(None, {"a": "x"}, "a") == [] and config.pick_list([1], {"a": [2]}, "a") == [1] and config.pick(0, {"a": 1}, "a", 2) == 0
    with pytest.raises(ValueError):
        Config(max_subset_order=0)
