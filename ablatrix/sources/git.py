"""Git as a source of diffs and sandboxes, read and made inside tasks: diffs of changes, worktrees for live evaluation."""

from __future__ import annotations

import contextlib
import json
import os
import shutil
import subprocess
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: The candidate that stands for the state of the worktree, in any case.
WORKTREE = "WORKTREE"
CHANGE = "patch_id bigint, repo string, base string, candidate string"
#: What a change's diff adds to it; with an error the others are null.
FOUND = "root string, base_sha string, candidate_sha string, diff_text string, error string"


class GitError(RuntimeError):
    """A git command failed."""


def git(repo: str | Path, *args: str, stdin: str | None = None, env: dict[str, str] | None = None, check: bool = True) -> subprocess.CompletedProcess:
    done = subprocess.run(["git", "-c", "core.quotepath=false", *args], cwd=repo, input=stdin, text=True, encoding="utf-8", errors="replace", capture_output=True, env={**os.environ, **(env or {})})
    if check and done.returncode:
        raise GitError(f"git {' '.join(args[:2])}: {(done.stderr or done.stdout).strip()}")
    return done


def repo_root(path: str | Path) -> Path:
    return Path(git(path, "rev-parse", "--show-toplevel").stdout.strip())


def resolve(repo: str | Path, ref: str) -> str:
    return git(repo, "rev-parse", "--verify", f"{ref}^{{commit}}").stdout.strip()


def version() -> str:
    return subprocess.run(["git", "--version"], capture_output=True, text=True).stdout.strip()


def snapshot_worktree(repo: str | Path) -> str:
    """An unreachable commit of all files that aren't ignored, staged or not, made through an index of its own; needs no identity.
    It bears the date of HEAD, so that equal worktrees are the same commit."""
    root = repo_root(repo)
    head = resolve(root, "HEAD")
    date = git(root, "show", "-s", "--format=%cI", head).stdout.strip()
    who = {f"GIT_{x}_{y}": z for x in ("AUTHOR", "COMMITTER") for y, z in (("NAME", "snapshot"), ("EMAIL", "snapshot@localhost"), ("DATE", date))}
    with tempfile.TemporaryDirectory() as folder:
        env = {**who, "GIT_INDEX_FILE": f"{folder}/index"}
        git(root, "read-tree", head, env=env)
        git(root, "add", "--all", env=env)
        tree = git(root, "write-tree", env=env).stdout.strip()
        return git(root, "commit-tree", tree, "-p", head, "-m", "worktree snapshot", env=env).stdout.strip()


def diff_text(repo: str | Path, base: str, candidate: str) -> str:
    """The diff with renames found, binary patches, three lines of context and unquoted paths."""
    return git(repo, "diff", "--no-color", "--no-ext-diff", "--find-renames", "--binary", "--unified=3", base, candidate).stdout


def read_change(repo: str, base: str, candidate: str | None) -> tuple[str | None, ...]:
    """FOUND of a change; candidate: a ref, or null or WORKTREE for a snapshot of the worktree."""
    try:
        root = str(repo_root(repo))
        base_sha = resolve(root, base)
        candidate_sha = snapshot_worktree(root) if candidate is None or candidate.upper() == WORKTREE else resolve(root, candidate)
        return root, base_sha, candidate_sha, diff_text(root, base_sha, candidate_sha), None
    except (GitError, OSError, TypeError) as e:
        return None, None, None, None, str(e)


def diffs(changes: DataFrame) -> DataFrame:
    """changes (CHANGE and any further columns) with FOUND, read in tasks: the repositories must be in reach of all executors."""
    names = changes.columns
    found = T.StructType.fromDDL(FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [read_change(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("repo", "base", "candidate")))]
            columns = [pa.array([r[i] for r in rows], pa.string()) for i in range(len(found))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*names, *found.names])

    return changes.mapInArrow(run, T.StructType([*changes.schema.fields, *found.fields]))


class ChangePartition(InputPartition):
    def __init__(self, change: list):
        self.change = change


class ChangeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.changes = json.loads(options["changes"]) if "changes" in options else [[0, options["repo"], options["base"], options.get("candidate")]]

    def partitions(self) -> list[ChangePartition]:
        return [ChangePartition(c) for c in self.changes]

    def read(self, partition: ChangePartition) -> Iterator[tuple]:
        patch_id, repo, base, candidate = partition.change
        yield (patch_id, repo, base, candidate, *read_change(repo, base, candidate))


class ChangeSource(DataSource):
    """format("git_changes"): a row (CHANGE, FOUND) for each change, each read in a task of its own. Options: `repo`, `base` and, but for the
    worktree, `candidate` of one change; or `changes`, a JSON list of [patch_id, repo, base, candidate]."""

    @classmethod
    def name(cls) -> str:
        return "git_changes"

    def schema(self) -> str:
        return f"{CHANGE}, {FOUND}"

    def reader(self, schema: T.StructType) -> ChangeReader:
        return ChangeReader(dict(self.options))


def patches(spark: SparkSession, changes: list[tuple[int, str, str, str | None]]) -> DataFrame:
    """CHANGE and FOUND of (patch_id, repo, base, candidate)."""
    spark.dataSource.register(ChangeSource)
    return spark.read.format("git_changes").option("changes", json.dumps(changes)).load()


def saved_patches(spark: SparkSession, path: str) -> DataFrame:
    """path, diff_text of saved diffs: one file a row, whole."""
    from pyspark.sql import functions as F

    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("diff_text"))


@contextlib.contextmanager
def worktree(repo: str | Path, commit: str) -> Iterator[Path]:
    """A detached worktree in a temporary folder, removed in the end."""
    folder = Path(tempfile.mkdtemp(prefix="sandbox-"))
    tree = folder / "tree"
    git(repo, "worktree", "add", "--detach", "--force", str(tree), commit)
    try:
        yield tree
    finally:
        git(repo, "worktree", "remove", "--force", str(tree), check=False)
        shutil.rmtree(folder, ignore_errors=True)


def reset(tree: Path, commit: str) -> None:
    """Tracked files as in the commit, untracked ones gone; ignored files stay."""
    git(tree, "reset", "--hard", "--quiet", commit)
    git(tree, "clean", "-fdq")


def apply(tree: Path, patch: str, reverse: bool = False) -> str | None:
    """None if the patch applied, else what git said."""
    done = git(tree, "apply", "--whitespace=nowarn", *(["--reverse"] if reverse else []), "-", stdin=patch, check=False)
    return None if done.returncode == 0 else (done.stderr or done.stdout).strip() or "patch does not apply"


def delta(tree: Path, commit: str) -> str:
    """What tracked files differ in from the commit."""
    return git(tree, "diff", "--no-color", "--no-ext-diff", "--binary", "--unified=3", commit).stdout
