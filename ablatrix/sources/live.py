"""Live evaluation: variants of any number of repositories, run in sandboxes inside Spark tasks. It runs arbitrary commands; use it on
purpose.

A task has a worktree of a commit at a time and resets it between variants. Results are written before they are used, and each row
names its variant and repetition, so that a task that is repeated replaces its rows instead of adding to them."""

from __future__ import annotations

import os
import signal
import subprocess
import time
from collections.abc import Iterator
from contextlib import ExitStack
from dataclasses import dataclass
from pathlib import Path, PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import TAIL
from ..schema import ABLATE
from . import git

PIECES = "array<struct<id: string, patch: string>>"
#: What to run: in a state (a digest of all that decides the outcome), on `commit` of repo, with `overlay` applied first and then the pieces, the repetitions `reps`.
VARIANTS = (
    f"patch_id bigint, state string, variant_kind string, variant_key string, repo string, commit string, overlay string, pieces {PIECES}, reverse boolean, "
    "test string, prepare string, timeout double, shared array<string>, reps array<int>"
)
#: apply_error: a piece doesn't apply; failure: the variant couldn't be made or prepared.
RESULTS = (
    "patch_id bigint, state string, variant_kind string, variant_key string, rep int, returncode int, duration_s double, stdout_tail string, stderr_tail string, timed_out boolean, "
    "apply_error string, failure string"
)


@dataclass(frozen=True)
class Command:
    """What to run: in repo's sandboxes, `test` up to timeout seconds, `runs` times; `prepare` first; shared paths are linked in."""

    repo: str
    test: str
    timeout: float = 300.0
    runs: int = 1
    prepare: str | None = None
    shared: tuple[str, ...] = ()

    def __post_init__(self):
        for p in self.shared:
            check_shared(self.repo, p)


def check_shared(repo: str, path: str) -> None:
    if PurePosixPath(path).is_absolute() or ".." in PurePosixPath(path).parts:
        raise ValueError(f"shared path must stay inside the repository: {path}")
    if not (Path(repo) / path).exists():
        raise ValueError(f"shared path does not exist: {path}")


def environment(repo: str) -> dict[str, str]:
    """The process's environment with the repository's node modules in reach, if it has any."""
    env, modules = dict(os.environ), Path(repo) / "node_modules"
    if (modules / ".bin").is_dir():
        env["PATH"] = os.pathsep.join([str(modules / ".bin"), env.get("PATH", "")])
    if modules.is_dir():
        env["NODE_PATH"] = os.pathsep.join(filter(None, [str(modules), env.get("NODE_PATH")]))
    return env


def run_command(command: str, cwd: str | Path, repo: str, timeout: float) -> tuple[int | None, float, str, str, bool]:
    """returncode (null: timed out), seconds, last characters of both streams, timed out. A timeout ends the whole group."""
    start = time.monotonic()
    process = subprocess.Popen(command, shell=True, cwd=cwd, env=environment(repo), stdout=subprocess.PIPE, stderr=subprocess.PIPE, start_new_session=True)
    try:
        out, err = process.communicate(timeout=timeout)
        late = False
    except subprocess.TimeoutExpired:
        os.killpg(process.pid, signal.SIGKILL)
        out, err = process.communicate()
        late = True
    last = lambda b: b.decode("utf-8", "replace")[-TAIL:]
    return None if late else process.returncode, time.monotonic() - start, last(out), last(err), late


def _prepare(v, tree: Path) -> None:
    for p in v["shared"] or ():
        check_shared(v["repo"], p)
        target = tree / p
        if not (target.exists() or target.is_symlink()):
            target.parent.mkdir(parents=True, exist_ok=True)
            target.symlink_to((Path(v["repo"]) / p).resolve())
    if v["prepare"]:
        code, _, _, err, late = run_command(v["prepare"], tree, v["repo"], v["timeout"])
        if code != 0:
            raise RuntimeError(f"prepare command {'timed out' if late else 'failed'}: {err[-500:]}")


def _patched(v, tree: Path) -> str | None:
    """What git said of the first piece that doesn't apply; among several, it is named."""
    if v["overlay"] and (error := git.apply(tree, v["overlay"])):
        return error
    pieces = v["pieces"] or ()
    for piece in pieces:
        if error := git.apply(tree, piece["patch"], v["reverse"]):
            return error if v["variant_kind"] == ABLATE else f"{piece['id']}: {error}"
    return None


def _rows(v, tree: Path) -> Iterator[tuple]:
    """Results of a variant in a worktree of its commit. Ablations are prepared before the patch comes off, the others after."""
    git.reset(tree, v["commit"])
    if v["variant_kind"] == ABLATE:
        _prepare(v, tree)
    if error := _patched(v, tree):
        yield 0, None, 0.0, "", "", False, error, None
        return
    if v["variant_kind"] != ABLATE:
        _prepare(v, tree)
    for rep in v["reps"]:
        yield rep, *run_command(v["test"], tree, v["repo"], v["timeout"]), None, None


def evaluate(variants: DataFrame, parallel: int) -> DataFrame:
    """RESULTS of VARIANTS: a row a repetition, or one row if a piece doesn't apply or the variant fails. Variants are dealt over
    `parallel` tasks in order of repository and commit, and a task has one worktree at a time."""
    names = [f.split()[0] for f in RESULTS.split(", ")]
    schema = to_arrow_schema(T.StructType.fromDDL(RESULTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ExitStack() as stack:
            held, tree = None, None
            for batch in batches:
                for v in batch.to_pylist():
                    key = v["patch_id"], v["state"], v["variant_kind"], v["variant_key"]
                    try:
                        if held != (v["repo"], v["commit"]):
                            stack.close()
                            held = None
                            tree = stack.enter_context(git.worktree(v["repo"], v["commit"]))
                            held = v["repo"], v["commit"]
                        rows = list(_rows(v, tree))
                    except (git.GitError, RuntimeError, ValueError, OSError) as e:
                        rows = [(0, None, 0.0, "", "", False, None, str(e))]
                    yield pa.RecordBatch.from_pylist([dict(zip(names, (*key, *r))) for r in rows], schema=schema)

    order = ["repo", "commit", "patch_id", "variant_kind", "variant_key"]
    return variants.repartitionByRange(parallel, *order).sortWithinPartitions(*order).mapInArrow(run, RESULTS)


REDUCTIONS = "patch_id bigint, removed_ids array<string>, reduction_patch string"


def reductions(removals: DataFrame) -> DataFrame:
    """REDUCTIONS of removals (patch_id, repo, commit, pieces): what of the pieces comes off in their order, and the change that makes."""
    schema = to_arrow_schema(T.StructType.fromDDL(REDUCTIONS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for v in batch.to_pylist():
                with git.worktree(v["repo"], v["commit"]) as tree:
                    gone = [p["id"] for p in v["pieces"] if git.apply(tree, p["patch"], True) is None]
                    row = {"patch_id": v["patch_id"], "removed_ids": gone, "reduction_patch": git.delta(tree, v["commit"]) if gone else ""}
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    return removals.mapInArrow(run, REDUCTIONS)
