"""Relations of the engine. Order columns (file_ord, hunk_ord, mut_ord) carry meaning and survive every shuffle."""

from __future__ import annotations

from dataclasses import dataclass, field

# Schemas, as DDL.
HUNK = "header string, text string, additions int, deletions int, old_start int, old_count int, new_start int, new_count int"
PATCHES = "patch_id bigint, diff_text string"
MUTATIONS = (
    "patch_id bigint, mut_ord int, id string, path string, label string, patch string, kind string, additions int, deletions int, line int, end_line int, is_test boolean"
)
RUNS = (
    "patch_id bigint, variant_kind string, variant_key string, rep int, returncode int, duration_s double, stdout_tail string, stderr_tail string, timed_out boolean"
)
OUTCOMES = "patch_id bigint, variant_key string, classification string"

# Names of classes, states and roles, as in the report format (schema version 2).
STABLE_PASS, STABLE_FAIL, FLAKY, TIMEOUT = "stable-pass", "stable-fail", "flaky", "timeout"
APPLY_ERROR = "apply-error"
CANDIDATE, BASELINE, ABLATE, SUBSET, PAIR, GREEDY = "candidate", "baseline", "ablate", "subset", "pair", "greedy"
WITNESSED, UNWITNESSED, INCONCLUSIVE = "witnessed", "unwitnessed", "inconclusive"
SUFFICIENT, MUTUAL_BACKUP = "sufficient", "mutual-backup"
ROLES = {
    WITNESSED: "essential-under-selected-evidence",
    UNWITNESSED: "individually-removable-under-selected-evidence",
    INCONCLUSIVE: "inconclusive",
}
CONTRASTS = ("base-fail_candidate-pass", "base-pass_candidate-pass", "base-inconclusive_candidate-pass", "candidate-not-stable-green")

#: What can become of a change, in the order in which it is decided.
STATES = ("unreadable", "no-changes", "nothing-left", "failed", "candidate-not-green", "tests-do-not-apply", "analysed")


@dataclass(frozen=True)
class Config:
    """Settings of an analysis; checked when made."""

    stability_runs: int = 1
    max_subset_order: int = 3
    max_subset_runs: int = 32
    max_interaction_runs: int = 20
    sufficient_search: bool = True
    interaction_search: bool = True
    minimize: bool = False
    overlay_tests: bool = True
    include_tests: bool = False
    test_globs: tuple[str, ...] = field(default=())
    ignore_globs: tuple[str, ...] = field(default=())
    require_contrast: bool = False
    require_all_witnessed: bool = False
    require_no_surplus: bool = False

    def __post_init__(self):
        if self.stability_runs < 1:
            raise ValueError("stability_runs must be at least 1")
        if self.max_subset_order < 1:
            raise ValueError("max_subset_order must be at least 1")
        if self.max_subset_runs < 0 or self.max_interaction_runs < 0:
            raise ValueError("budgets must not be negative")
