"""Settings files, precedence and command suggestions."""

from __future__ import annotations

import tomllib
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

# The settings a new file gets, in order.
DEFAULTS = (("stability_runs", 2), ("sufficient_search", True), ("max_subset_order", 3), ("max_subset_runs", 32), ("interaction_search", True), ("max_interaction_runs", 20))
# Marker (a file, or a script of the package file) to command, in the order of suggestions.
SUGGESTIONS = (
    ("package.json#test", "npm test"), ("package.json#typecheck", "npm run typecheck"), ("pyproject.toml", "python -m pytest -q"), ("pytest.ini", "python -m pytest -q"), ("tests", "python -m pytest -q"),
    ("Cargo.toml", "cargo test"), ("go.mod", "go test ./..."), ("pom.xml", "mvn test"), ("build.gradle", "./gradlew test"), ("build.gradle.kts", "./gradlew test"),
)


def load(path: str | Path, section: str = "evidence") -> dict[str, Any]:
    """The section of a TOML file, or its root without one; {} without a file."""
    path = Path(path)
    if not path.exists():
        return {}
    found = (data := tomllib.loads(path.read_text(encoding="utf-8"))).get(section, data)
    if not isinstance(found, dict):
        raise ValueError(f"[{section}] must be a table")
    return dict(found)


def write(path: str | Path, test: str, prepare: str | None = None, force: bool = False, section: str = "evidence") -> Path:
    path = Path(path)
    if path.exists() and not force:
        raise FileExistsError(f"{path} is there already")
    quoted = lambda x: '"' + x.replace("\\", "\\\\").replace('"', '\\"') + '"'
    lines = [f"[{section}]", f"test = {quoted(test)}", *([f"prepare = {quoted(prepare)}"] if prepare else [])]
    path.write_text("\n".join(lines + [f"{k} = {str(v).lower()}" for k, v in DEFAULTS]) + "\n", encoding="utf-8")
    return path


def pick(given: Any, configured: dict[str, Any], name: str, default: Any) -> Any:
    """What was given, else what is configured, else the default."""
    return given if given is not None else configured.get(name, default)


def pick_list(given: list | None, configured: dict[str, Any], name: str) -> list:
    """Lists replace, they don't merge; a configured value that is no list counts as none."""
    if given is not None:
        return list(given)
    return list(found) if isinstance(found := configured.get(name, []), list) else []


def picked(given: Column, configured: Column, default: Column) -> Column:
    return F.coalesce(given, configured, default)


def suggestions(markers: DataFrame) -> DataFrame:
    """repo, place, command: what to run in each repo, once per command, in the fixed order. markers: repo, marker."""
    pairs = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(m).alias("marker"), F.lit(c).alias("command")) for i, (m, c) in enumerate(SUGGESTIONS)])
    rules = markers.select("repo", "marker").distinct().select("repo", F.col("marker").alias("found"), F.inline(pairs)).filter("found = marker")
    return rules.groupBy("repo", "command").agg(F.min("place").alias("place")).select("repo", "place", "command")
