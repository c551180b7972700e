"""Scalar functions on strings and counts, as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, functions as F

#: Characters kept of each output stream. A fixed value.
TAIL = 5000


def tail(value: Column) -> Column:
    return F.coalesce(F.right(value, F.lit(TAIL)), F.lit(""))


def escape_data(value: Column) -> Column:
    """Percent escapes of a workflow command's message; `%` first."""
    for plain, escaped in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A")):
        value = F.replace(value, F.lit(plain), F.lit(escaped))
    return value


def escape_property(value: Column) -> Column:
    value = escape_data(value)
    for plain, escaped in ((":", "%3A"), (",", "%2C")):
        value = F.replace(value, F.lit(plain), F.lit(escaped))
    return value


def glob_regex(pattern: str) -> str:
    """A Java regex for a shell glob in which `*` crosses slashes: `*`, `?`, `[...]`, `[!...]`."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", i + (1 if pattern[i : i + 1] == "]" else 2 if pattern[i : i + 2] == "!]" else 0))) >= 0:
            body, i = pattern[i:end], end + 1
            negate, body = ("^", body[1:]) if body[:1] == "!" else ("", body)
            out.append(f"[{negate}{re.sub(r'([\[\]\\^&~])', r'\\\1', body)}]")
        else:
            out.append(re.sub(r"([^A-Za-z0-9_ /])", r"\\\1", c))
    return r"(?s)^(?:" + "".join(out) + r")\z"


def matches_any(path: Column, globs: Iterable[str]) -> Column:
    found = F.lit(False)
    for g in globs:
        found = found | path.rlike(glob_regex(g))
    return found


#: In either case of ASCII letters, which no other letter but the Kelvin sign has as its small one.
TEST_PATH = r"(?i)(?:^|/)(?:(?:tests?|__tests__|specs?)(?:/|\z)|(?:conftest\.py|pytest\.ini)\z|test_[^/]*\z)|_test\.py\z|\.(?:test|spec)\.[^/]*\z"


def is_test_path(path: Column, extra_globs: Iterable[str] = ()) -> Column:
    """Components name tests in either case, or the file name does, or the path as written matches an extra glob."""
    return path.rlike(TEST_PATH) | matches_any(path, extra_globs)


def binomial(n: Column, k: int) -> Column:
    """C(n, k) for a bigint column and a small k; 0 where n < k."""
    out = F.lit(1).cast("bigint")
    for i in range(k):
        out = F.call_function("div", out * (n - F.lit(i)), F.lit(i + 1))
    return F.when(n >= k, out).otherwise(F.lit(0).cast("bigint"))
