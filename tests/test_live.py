"""Live evaluation in temporary repositories."""

import hashlib
import json
import subprocess

import pytest
from pyspark.sql import functions as F

from ablatrix import cli
from ablatrix.operators import certificate, report as report_
from ablatrix.plans.analyze import AnalysisError, analyze
from ablatrix.schema import Config
from ablatrix.sources import certificates, git
from ablatrix.sources.live import Command, run_command


def commit(repo, files, message):
    for name, text in files.items():
        path = repo / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    run = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *a], cwd=repo, check=True, capture_output=True)
    run("add", "-A")
    run("commit", "-qm", message)
    return git.resolve(repo, "HEAD")


@pytest.fixture
def repo(tmp_path):
    subprocess.run(["git", "init", "-q", str(tmp_path / "r")], check=True)
    return tmp_path / "r"


def certificate_id(report):
    """The hash of a report, by Python's json."""
    stable = {k: v for k, v in report.items() if k not in ("generated_at", "certificate_id")}
    return "dw2_" + hashlib.sha256(json.dumps(stable, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()[:20]


PAD = "\n".join(f"# line {i}" for i in range(12))


def calc(a, b, c):
    return f"A = {a}\n{PAD}\nB = {b}\n{PAD}\nC = {c}\n"


def test_core_and_surplus(spark, repo, tmp_path, capsys):
    base = commit(repo, {"calc.py": calc(0, 0, 0), "tests/test_calc.py": "print('none')\n"}, "base")
    commit(repo, {"calc.py": calc(1, 1, 1), "tests/test_calc.py": "import calc\nassert calc.A and calc.B\n"}, "candidate")
    command = Command(str(repo), "PYTHONDONTWRITEBYTECODE=1 PYTHONPATH=. python tests/test_calc.py", 60, 2)
    report, patch = analyze(spark, command, base, "HEAD", Config(stability_runs=2, max_subset_order=2, minimize=True))
    s = report["summary"]
    assert report["contrast"] == "base-fail_candidate-pass"
    assert (s["witnessed"], s["unwitnessed"], s["inconclusive"], s["minimal_sufficient_order"], s["surplus_candidate_hunks"]) == (2, 1, 0, 2, 1)
    assert report["sufficient_search"]["exhaustive_at_found_order"] and report["sufficient_search"]["attempted"] == 6
    assert len(report["minimization"]["removed_mutation_ids"]) == 1 and "C = 0" in patch
    assert report["certificate_id"].startswith("dw2_")
    path = tmp_path / "c.json"
    path.write_text(json.dumps(report))
    assert report["certificate_id"] == certificate_id(report) and set(certificates.REQUIRED) <= set(report)
    assert cli.main(["show", str(path)]) == 0 and "66.7%" in capsys.readouterr().out
    good, bad = certificates.read(spark, str(path))
    flat = certificate.rendered(good)
    assert bad.isEmpty() and report_.annotations(flat.select("patch_id", F.inline("results"))).count() == 1
    assert {r.key: r.value for r in report_.ci_outputs(report_.report_counts(flat)).collect()}["minimal_sufficient_order"] == "2"
    assert subprocess.run(["git", "worktree", "list"], cwd=repo, capture_output=True, text=True).stdout.count("\n") == 1


def test_mutual_backup(spark, repo):
    base = commit(repo, {"f.py": calc(0, 0, 0), "tests/t.py": ""}, "base")
    commit(repo, {"f.py": calc(1, 1, 0), "tests/t.py": "import f\nassert f.A or f.B\n"}, "candidate")
    command = Command(str(repo), "PYTHONDONTWRITEBYTECODE=1 PYTHONPATH=. python tests/t.py")
    report, _ = analyze(spark, command, base, None, Config(max_subset_order=1))
    assert report["summary"]["unwitnessed"] == 2 and report["summary"]["minimal_sufficient_sets"] == 2 and report["summary"]["mutual_backup_pairs"] == 1
    with pytest.raises(AnalysisError):
        analyze(spark, Command(str(repo), "false"), base)
    with pytest.raises(AnalysisError):
        analyze(spark, command, "HEAD", "HEAD")


def test_snapshot_holds_untracked_files(repo):
    commit(repo, {"a": "1"}, "base")
    (repo / "b").write_text("2")
    sha = git.snapshot_worktree(repo)
    assert len(sha) == 40 and "b" in git.diff_text(repo, "HEAD", sha)
    assert subprocess.run(["git", "status", "--porcelain"], cwd=repo, capture_output=True, text=True).stdout == "?? b\n"


def test_timeouts_and_tails(tmp_path):
    code, _, out, _, late = run_command("echo early; sleep 30", tmp_path, str(tmp_path), 1)
    assert (code, out, late) == (None, "early\n", True)
    assert len(run_command("head -c 9000 /dev/zero", tmp_path, str(tmp_path), 10)[2]) == 5000


def test_init_and_suggest(repo, capsys):
    commit(repo, {"go.mod": "", "tests/x": ""}, "base")
    assert cli.main(["init", "--repo", str(repo), "--test", "go test"]) == 0
    assert cli.main(["init", "--repo", str(repo), "--test", "go test"]) == 2
    capsys.readouterr()
    assert cli.main(["suggest", "--repo", str(repo)]) == 0
    assert capsys.readouterr().out.split("\n")[:2] == ["python -m pytest -q", "go test ./..."]
    with pytest.raises(ValueError):
        Command(str(repo), "x", shared=("../up",))


def test_options_and_settings(repo, capsys):
    given = "prove --config x.toml --share cache --share deps --include-test-changes --certificate c.json --no-github-actions --no-test-overlay --test-glob t/*"
    a = cli.parser().parse_args(given.split())
    assert (a.settings, a.shared_path, a.include_tests, str(a.json), a.ci, a.test_overlay, a.test_glob) == ("x.toml", ["cache", "deps"], True, "c.json", False, False, ["t/*"])
    assert cli.parser().parse_args(["prove"]).ci is None
    with pytest.raises(SystemExit) as end:
        cli.main(["--version"])
    assert end.value.code == 0 and capsys.readouterr().out.startswith("ablatrix ")
    commit(repo, {"readme": ""}, "base")
    assert cli.main(["suggest", "--repo", str(repo)]) == 1 and "no usual" in capsys.readouterr().out


def test_prove_reads_lists_of_settings(spark, repo, capsys, monkeypatch):
    monkeypatch.setattr(cli, "_save", lambda path, text: None)
    seen = {}

    def analyze_(spark_, changes, config, parallel):
        seen.update(globs=config.test_globs, shared=changes.first().shared)
        raise ValueError("enough")

    monkeypatch.setattr("ablatrix.plans.analyze.analyze_many", analyze_)
    for key in ("share", "shared_paths"):
        commit(repo, {"cache/x": "", ".evidence.toml": f'[evidence]\ntest = "true"\ntest_glob{"s" * (key != "share")} = ["t/*"]\n{key} = ["cache"]\n'}, key)
        assert cli.main(["prove", "--repo", str(repo)]) == 2 and "enough" in capsys.readouterr().err
        assert (list(seen["globs"]), list(seen["shared"])) == (["t/*"], ["cache"])
        seen.clear()
