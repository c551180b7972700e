"""Many changes in one analysis, against a sequential simulation; resuming; diffs read in tasks; saved certificates."""

import itertools
import json
import os
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from ablatrix.functions.canonical import canonical
from ablatrix.operators import certificate, report as report_
from ablatrix.plans import analyze as plan, inverse, parse
from ablatrix.schema import STATES, Config
from ablatrix.sources import certificates, git
from ablatrix.sources.live import VARIANTS, Command, evaluate

from test_live import PAD, certificate_id, commit

NAMES = "ABCD"
#: Evidence over the variables, which are 0 in the base and 1 in the candidate.
RULES = {
    1: ["A", "not A or A", "A"], 2: ["A and B", "A or B", "A", "B"], 3: ["A and B", "A or B or C", "A and (B or C)", "(A and B) or C", "A"],
    4: ["A and B and C", "(A or B) and (C or D)", "A and B and C and D", "(A and B) or (C and D)", "D"],
}


def passes(rule, on):
    return bool(eval(rule, {n: int(n in on) for n in NAMES}))


def simulate(k, rule, order, budget, pairs):
    """Statuses, order and sets found, whether exhaustive, attempts, backups and what comes off, one variant after another."""
    every = NAMES[:k]
    assert passes(rule, every)
    ablated = ["unwitnessed" if passes(rule, set(every) - {v}) else "witnessed" for v in every]
    found, attempts, exhaustive, sets = None, 0, False, []
    if not passes(rule, ""):
        for n in range(1, min(order, k) + 1):
            combos = list(itertools.combinations(range(k), n))
            tried = combos[: budget - attempts]
            attempts += len(tried)
            sets = [c for c in tried if passes(rule, [every[i] for i in c])]
            if sets:
                found, exhaustive = n, len(tried) == len(combos)
                break
    removable = [i for i in range(k) if ablated[i] == "unwitnessed"]
    both = list(itertools.combinations(removable, 2))[:pairs]
    backups = [c for c in both if not passes(rule, set(every) - {every[i] for i in c})]
    gone = []
    for i in sorted(range(k), key=lambda i: ablated[i] == "witnessed"):
        if passes(rule, set(every) - {every[j] for j in [*gone, i]}):
            gone.append(i)
    return ablated, found, sets, exhaustive, attempts, backups, gone


def make(folder, k, rule):
    subprocess.run(["git", "init", "-q", str(folder)], check=True)
    text = lambda v: f"\n{PAD}\n".join(f"{n} = {v}" for n in NAMES[:k]) + "\n"
    base = commit(folder, {"m.py": text(0), "tests/t.py": "pass\n"}, "base")
    commit(folder, {"m.py": text(1), "tests/t.py": f"from m import *\nassert {rule}\n"}, "candidate")
    return base




@pytest.fixture(scope="module")
def repos(tmp_path_factory):
    folder, made = tmp_path_factory.mktemp("repos"), []
    cases = [(k, rule) for k, rules in RULES.items() for rule in rules]
    for i in range(50):
        k, rule = cases[i % len(cases)]
        made.append((i, k, rule, folder / str(i), make(folder / str(i), k, rule)))
    return made


def test_fifty_repositories_at_once(spark, repos, tmp_path, monkeypatch):
    config = Config(max_subset_order=3, max_subset_runs=9, max_interaction_runs=4, minimize=True)
    command = "PYTHONDONTWRITEBYTECODE=1 python -S tests/t.py"
    rows = [(i, Command(str(folder), f"PYTHONPATH=. {command}", 60), base, "HEAD") for i, _, _, folder, base in repos]
    broken = [(100, Command(str(repos[0][3]), "false"), repos[0][4], "HEAD"), (101, Command(str(repos[0][3]), "true"), "HEAD", "HEAD"), (102, Command(str(tmp_path), "true"), "HEAD", "HEAD")]
    broken += [(103, Command(str(repos[1][3]), "true", prepare="exit 3"), repos[1][4], "HEAD"), (104, Command(str(repos[1][3]), "true"), repos[1][4], "no-such-ref")]
    changes = plan.changes_of(spark, rows + broken)
    folder = f"file://{tmp_path}/runs"
    found = plan.analyze_many(spark, changes, config, folder)
    states = {r.patch_id: (r.state, r.reason) for r in found.states.collect()}
    assert {states[i] for i, *_ in repos} == {("analysed", None)}
    assert [states[i][0] for i in range(100, 105)] == ["candidate-not-green", "no-changes", "unreadable", "failed", "unreadable"] and "prepare command failed" in states[103][1]
    reports = {r.patch_id: r.report.asDict(recursive=True) for r in found.certificates.collect()}
    assert set(reports) == {i for i, *_ in repos}
    gone = {r.patch_id: r for r in found.reductions.collect()}
    for i, k, rule, repo, base in repos:
        r, (ablated, order, sets, exhaustive, attempts, backups, removed) = reports[i], simulate(k, rule, 3, 9, 4)
        ids = [x["mutation"]["id"] for x in r["results"]]
        search, pairs = r["sufficient_search"], r["interaction_search"]
        assert [x["status"] for x in r["results"]] == ablated, rule
        assert (search["found_order"], search["exhaustive_at_found_order"], search["attempted"]) == (order, exhaustive, attempts), rule
        assert [x["mutation_ids"] for x in search["results"]] == [[ids[j] for j in c] for c in sets]
        assert [x["mutation_ids"] for x in pairs["results"]] == [[ids[j] for j in c] for c in backups], rule
        assert r["minimization"]["removed_mutation_ids"] == [ids[j] for j in removed] == gone[i].removed_ids
        assert gone[i].reduction_patch.count("\n-") - gone[i].reduction_patch.count("\n---") == len(removed)
        assert r["summary"]["witness_ratio"] == ablated.count("witnessed") / k and r["certificate_id"] == certificate_id(r)
        assert all(x["runs"]["runs"][0]["duration_s"] > 0 for x in r["results"])

    # a second analysis over the same folder runs nothing, and comes to the same
    before = found.runs.count()
    monkeypatch.setattr(plan, "evaluate", lambda *a: pytest.fail("nothing is left to run"))
    again = plan.analyze_many(spark, changes, config, folder)
    assert again.runs.count() == before and {r.patch_id: r.certificate_id for r in again.certificates.collect()} == {i: r["certificate_id"] for i, r in reports.items()}
    monkeypatch.undo()

    # more repetitions run only those that are new
    ran = []
    monkeypatch.setattr(plan, "evaluate", lambda rows, parallel: ran.extend(r.reps for r in rows.select("reps").collect()) or evaluate(rows, parallel))
    few = changes.filter("patch_id < 3")
    twice = plan.analyze_many(spark, few, Config(stability_runs=2, max_subset_order=3, max_subset_runs=9, max_interaction_runs=4), folder)
    assert set(map(tuple, ran)) == {(1,)} and {r.n for r in twice.runs.groupBy("patch_id", "variant_kind", "variant_key").agg(F.count("*").alias("n")).filter("variant_kind <> 'greedy'").collect()} == {2}
    monkeypatch.undo()

    # the same as each on its own, but for times and for output that names a sandbox
    def plain(r):
        drop = ("generated_at", "certificate_id", "duration_s", "total_duration_s", "stderr_tail")
        return {k: plain(v) for k, v in r.items() if k not in drop} if isinstance(r, dict) else [plain(x) for x in r] if isinstance(r, list) else r

    for i in (11,):
        one, patch = plan.analyze(spark, rows[i][1], rows[i][2], "HEAD", config)
        assert plain(one) == plain(reports[i]) and patch == gone[i].reduction_patch


def test_unstable_variants(spark, tmp_path):
    """Flaky subsets come before the sufficient ones, whatever their place in the search."""
    folder = tmp_path / "r"
    subprocess.run(["git", "init", "-q", str(folder)], check=True)
    base = commit(folder, {"m.py": f"A = 0\n{PAD}\nB = 0\n", "tests/t.py": "pass\n"}, "base")
    count = tmp_path / "n"
    flaky = f"import m\np = {str(count)!r} + str(m.A) + str(m.B)\nopen(p, 'a').write('x')\nassert m.A or (m.B and len(open(p).read()) % 2)\n"
    commit(folder, {"m.py": f"A = 1\n{PAD}\nB = 1\n", "tests/t.py": flaky}, "candidate")
    report, _ = plan.analyze(spark, Command(str(folder), "PYTHONDONTWRITEBYTECODE=1 PYTHONPATH=. python tests/t.py", 60, 2), base, "HEAD", Config(stability_runs=2))
    ids = [r["mutation"]["id"] for r in report["results"]]
    assert [r["status"] for r in report["results"]] == ["inconclusive", "unwitnessed"]
    assert [(x["mutation_ids"], x["status"], x["runs"]["classification"]) for x in report["sufficient_search"]["results"]] == [([ids[1]], "inconclusive", "flaky"), ([ids[0]], "sufficient", "stable-pass")]


def test_errors_name_the_hunk(spark, repos):
    """A piece that doesn't apply is named where there may be several; a prepare command that fails is a failure of its own."""
    _, _, _, folder, base = repos[0]
    piece = ("m1", "diff --git a/none b/none\n--- a/none\n+++ b/none\n@@ -1 +1 @@\n-a\n+b\n")
    row = lambda kind, key, pieces, prepare: (1, "s", kind, key, str(folder), base, "", pieces, True, "true", prepare, 9.0, [], [0, 1])
    rows = spark.createDataFrame([row("ablate", "0", [piece], None), row("pair", "0,1", [piece], None), row("greedy", "0", [], "exit 1"), row("subset", "0", [], None)], VARIANTS)
    got = {r.variant_kind: r for r in evaluate(rows, 2).orderBy(F.desc("rep")).collect()}
    assert got["pair"].apply_error == f"m1: {got['ablate'].apply_error}" and got["ablate"].failure is None
    assert got["greedy"].failure.startswith("prepare command failed") and got["greedy"].apply_error is None and got["subset"].returncode == 0
    assert evaluate(rows, 2).count() == 5


def test_changes_are_read_in_tasks(spark, repos):
    changes = [(i * 2 + side, str(folder), base if side else "HEAD", "HEAD" if side else base) for i, _, _, folder, base in repos for side in (0, 1)]
    rows = git.patches(spark, changes)
    assert rows.rdd.getNumPartitions() == len(changes) == 100
    got = {r.patch_id: r for r in rows.collect()}
    for i, repo, base, candidate in changes:
        assert got[i].diff_text == git.diff_text(repo, base, candidate) and got[i].error is None and len(got[i].base_sha) == 40
    one = spark.read.format("git_changes").option("repo", str(repos[0][3])).option("base", "HEAD").load().first()
    assert one.diff_text == "" and one.candidate is None and len(one.candidate_sha) == 40
    bad = git.patches(spark, [(1, "/nowhere", "a", "b"), (2, str(repos[0][3]), "none", None)]).collect()
    assert all(r.error and r.diff_text is None for r in bad)
    df = spark.createDataFrame([(i, r, b, c, "kept") for i, r, b, c in changes[:6]], f"{git.CHANGE}, more string")
    assert {(r.patch_id, r.diff_text, r.more) for r in git.diffs(df).collect()} == {(i, got[i].diff_text, "kept") for i, *_ in changes[:6]}


def test_worktree_is_a_candidate_by_name(spark, repos):
    _, _, _, folder, _ = repos[0]
    (folder / "new").write_text("x")
    try:
        a, b = (git.read_change(str(folder), "HEAD", c) for c in ("worktree", None))
        assert a == b and "+x" in a[3]
    finally:
        (folder / "new").unlink()


def saved(spark, n=437):
    """Reports of n patches over recorded runs."""
    runs = [(i, kind, key, rep, code if rep == 0 or i % 3 else 1 - code, 0.25 * rep, "é\u0001\\", "", False) for i in range(n) for rep in (0, 1) for kind, key, code in (("candidate", "", 0), ("baseline", "", 1), ("ablate", "0", 1), ("ablate", "1", 0), ("subset", "0", 0), ("subset", "1", 1))]
    sets = certificate.run_sets(spark.createDataFrame(runs, "patch_id bigint, variant_kind string, variant_key string, rep int, returncode int, duration_s double, stdout_tail string, stderr_tail string, timed_out boolean"))
    muts = spark.createDataFrame([(i, o, f"m{o}", f"f|{o}.py", f"f|{o}.py hunk 1/1 — “é”", "@@\n", "hunk", 1, 2, 3, 4) for i in range(n) for o in (0, 1)], "patch_id bigint, mut_ord int, id string, path string, label string, patch string, kind string, additions int, deletions int, line int, end_line int")
    own = sets.filter("variant_kind = 'ablate'").select("patch_id", F.col("variant_key").cast("int").alias("mut_ord"), "classification", "apply_error")
    from ablatrix.operators import search, stability

    results = muts.join(own, ["patch_id", "mut_ord"]).withColumn("status", stability.status(F.col("classification"))).drop("classification")
    units = muts.select("patch_id", F.col("mut_ord").alias("idx"), F.lit(2).alias("n"), F.struct("mut_ord", "id", "label").alias("unit"))
    outcomes = sets.filter("variant_kind = 'subset'").select("patch_id", "variant_key", "classification")
    tried = search.sufficient_search(units, search.recorded(outcomes), 1, 9)
    pairs = search.tried_pairs(search.combinations(units.limit(0), 2, 1, 2).withColumn("class", F.lit("")))
    patches = muts.select("patch_id").distinct().withColumns({"n": F.lit(2), "baseline_fails": F.lit(True)})
    told = lambda x: x.withColumn("enabled", F.lit(True))
    heads = patches.select(
        "patch_id", F.lit("2026-01-01T00:00:00+00:00").alias("generated_at"), F.lit("/r").alias("repo"), F.lit("main").alias("base_ref"), F.lit("0" * 40).alias("base_sha"), F.lit("HEAD").alias("candidate_ref"),
        F.lit("1" * 40).alias("candidate_sha"), F.lit("make test").alias("test_command"), F.struct(F.lit(2).alias("stability_runs"), F.lit(None).cast("string").alias("prepare")).alias("config"), F.lit(1).alias("ignored"),
        F.array(F.lit("tests/b"), F.lit("tests/a")).alias("test_files"), F.struct(F.lit("3").alias("python")).alias("environment"),
    )
    return certificate.reports(heads, results, sets, told(search.sufficient_summary(patches, tried, 1, 9)), tried, told(search.interaction_summary(patches, pairs, 9)), pairs).cache()


def test_certificates_are_written_read_and_rendered(spark, tmp_path):
    found = saved(spark)
    texts = {r.patch_id: r.markdown for r in report_.markdown(certificate.rendered(found)).collect()}
    folder = tmp_path / "out"
    for _ in range(2):  # again: the same files
        certificates.write_files(certificates.files(found, report_.markdown(certificate.rendered(found))), str(folder))
        names = [n for n in os.listdir(folder) if not n.startswith("_")]
        assert sorted(names) == sorted(f"{i}.{end}" for i in texts for end in ("json", "md")) and len(names) == 2 * 437
        listed = [json.loads(line) for p in (folder / "_manifest").glob("*.jsonl") for line in p.read_text().splitlines()]
        assert sorted(x["name"] for x in listed) == sorted(names) and json.loads((folder / "_manifest" / "_COMMITTED").read_text())["files"] == len(names)
        assert not (folder / "_temporary").exists()
    document = json.loads((folder / "5.json").read_text())
    assert certificate_id(document) == document["certificate_id"] and document["tool"] == "ablatrix" and document["results"][0]["runs"]["runs"][0]["stdout_tail"] == "é\u0001\\"
    (folder / "bad.json").write_text("{")
    (folder / "other.json").write_text('{"schema_version": 2}')
    (folder / "wrong.json").write_text(json.dumps({**document, "contrast": "?"}))
    good, bad = certificates.read(spark, f"{folder}/*.json")
    assert {r.file.rpartition("/")[2]: r.problem.partition(":")[0] for r in bad.collect()} == {"bad.json": "not JSON of this format", "other.json": "missing", "wrong.json": "unknown contrast"}
    assert {r.patch_id: r.markdown for r in report_.markdown(certificate.rendered(good)).collect()} == texts and len(texts) == 437
    assert {i: (folder / f"{i}.md").read_text() for i in texts} == texts
    runs = certificates.runs(good)
    assert runs.count() == 437 * 2 * 4 and {r.status for r in certificates.hunks(good).select("status").distinct().collect()} == {"witnessed", "unwitnessed", "inconclusive"}


def test_killed_writers_leave_whole_files(spark, tmp_path):
    rows = spark.createDataFrame([(f"{i}.json", "x" * 1000) for i in range(20)] + [("../up", "")], "name string, text string").repartition(4)
    with pytest.raises(Exception, match="not a name"):
        certificates.write_files(rows, str(tmp_path / "o"))
    assert not (tmp_path / "o" / "_manifest").exists() and not (tmp_path / "up").exists()
    assert all(len((tmp_path / "o" / n).read_text()) == 1000 for n in os.listdir(tmp_path / "o") if n.endswith(".json"))
    certificates.write_files(rows.filter("name <> '../up'"), str(tmp_path / "o"))
    assert sorted(os.listdir(tmp_path / "o")) == sorted([*(f"{i}.json" for i in range(20)), "_manifest"])


def test_states_are_named():
    assert len(set(STATES)) == len(STATES) == 7


def test_canonical_json_is_pythons(spark):
    rng = random.Random(1)
    numbers = [0.0, -0.0, 1e-7, 1e16, 1e15, 1e22, 123456789012345680.0, 0.1, 2**-44, 5e-324, 1.7976931348623157e308, 2.5e-5, 1e-4, 0.00012345, 100.0, 9007199254740993.0, 2e-3, 1e23, float("nan"), float("inf"), -float("inf")]
    numbers += [p / q for q in range(1, 60) for p in range(q)] + [round(rng.uniform(0, 300), 4) for _ in range(3000)]
    signs = [*map(chr, range(40)), "\\", "\\u001B", '"', "/", "é", "\u2028", "\x7f", "😀", "u000B", "\\\\"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    for values, type_ in ((numbers, "double"), (texts, "string")):
        df = spark.createDataFrame([(v,) for v in values], f"x {type_}")
        got = [r[0] for r in df.select(canonical(F.col("x"), df.schema["x"].dataType)).collect()]
        assert got == [json.dumps(v, ensure_ascii=False) for v in values]
    value = {"i": None, "m": {"b": 1.5, "a": None}, "a": [{"s": "x", "l": [1, 2], "b": True}, None], "d": [[1e-7], []]}
    df = spark.createDataFrame([tuple(value.values())], "i int, m map<string,double>, a array<struct<s:string,l:array<int>,b:boolean>>, d array<array<double>>")
    assert df.select(canonical(F.struct(*df.columns), df.schema)).first()[0] == json.dumps(value, sort_keys=True, separators=(",", ":"))


def test_diffs_turned_round_are_gits_way_back(spark, tmp_path):
    """Whole diffs, and every choice of hunks, against git: text edits, modes, renames, new, deleted, emptied and binary files."""
    repo = tmp_path / "r"
    subprocess.run(["git", "init", "-q", str(repo)], check=True)
    rng = random.Random(2)
    lines = [f"line {rng.random()}" for _ in range(60)]
    text = lambda x, end="\n": "\n".join(x) + end
    base = commit(repo, {"a.txt": text(lines), "run.sh": "x\n", "old name.txt": text(lines[:40]), "gone.txt": "1\n2\n", "keep/end.txt": text(lines[:9], ""), "big.txt": "old\n" * 20_000, "empty.txt": "full\n"}, "base")
    (repo / "bin").write_bytes(bytes(range(256)) * 4)
    base = commit(repo, {}, "binary")
    new = [*lines[:4], "added", *lines[4:20], *lines[23:40], "changed 41", "more", *lines[41:], "last"]
    (repo / "old name.txt").rename(repo / "new name.txt")
    (repo / "gone.txt").unlink()
    (repo / "bin").write_bytes(bytes(range(255, -1, -1)) * 5)
    os.chmod(repo / "run.sh", 0o755)
    candidate = commit(repo, {"a.txt": text(new), "new name.txt": text([*lines[:20], "x", *lines[21:40]]), "made.txt": "-- \n+++\n", "keep/end.txt": text([*lines[:8], "end"]), "big.txt": "new\n" * 20_000, "empty.txt": ""}, "candidate")
    diff = git.diff_text(repo, base, candidate)
    files = parse.file_patches(spark.createDataFrame([(1, diff)], "patch_id bigint, diff_text string")).cache()
    back = inverse.inverse_patches(files).first().inverse
    want = git.diff_text(repo, candidate, base)
    blocks = lambda d: sorted(f"diff --git {b}" for b in d.split("diff --git ")[1:])
    assert blocks(back) == blocks(want)  # files come in the order of the way there
    with git.worktree(repo, candidate) as tree:
        assert git.apply(tree, back) is None and git.git(tree, "add", "-A") and git.delta(tree, base) == ""

    found = files.filter("path = 'a.txt'").first()
    n = len(found.hunks)
    assert n == 4
    for k in range(1, n + 1):
        for chosen in itertools.combinations(range(n), k):
            removed = spark.createDataFrame([(1, found.file_ord, i) for i in chosen], "patch_id bigint, file_ord int, hunk_ord int")
            got = inverse.reduction_patches(files, removed).first().reduction_patch
            with git.worktree(repo, candidate) as tree:
                for i in chosen:
                    assert git.apply(tree, found.header + found.hunks[i].text, True) is None
                plain = lambda d: "".join(x for x in d.splitlines(True) if not x.startswith("index "))
                assert plain(got) == plain(git.delta(tree, candidate)), chosen
    every = files.select("patch_id", "file_ord", F.explode(F.expr("if(structural, array(0), sequence(0, size(hunks) - 1))")).alias("hunk_ord"))
    with git.worktree(repo, candidate) as tree:
        assert git.apply(tree, inverse.reduction_patches(files, every).first().reduction_patch) is None and git.git(tree, "add", "-A") and git.delta(tree, base) == ""
