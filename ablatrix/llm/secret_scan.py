"""Secret scans through a trigram inverted index (operator 8).

Each rule's regex is parsed and turned into a Boolean query over trigrams that every match must contain. A block of documents
gets an inverted index from (case-folded) trigrams to the documents that hold them, kept for the trigrams that some query
names; queries intersect and unite postings, and only the documents left are scanned with the regex. Rules without mandatory
trigrams scan every document. Documents are always scanned whole; long ones are indexed in pieces that overlap by two bytes.

Null texts count as empty and have no secrets. Spans are code points, end exclusive. Rows may repeat; each is scanned alone.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from re import _constants as sre, _parser

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import map_rows, table

PIECE = 4 << 20
#: More alternatives than this are not multiplied out.
EXACT = 64

Query = tuple  # ("true",) | ("tri", bytes) | ("and"|"or", frozenset of queries)
TRUE: Query = ("true",)


@dataclass(frozen=True)
class Rule:
    """group, least: the match counts if that group has so many characters at least."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    flags: int = re.ASCII
    compiled: re.Pattern = field(init=False, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "compiled", re.compile(self.pattern, self.flags))

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in self.compiled.finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]


#: The base kinds, then what the scan adds. `hex` of 24 or more: the maximal runs of that length, as shorter runs are dropped.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("repo_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("url_login", r"[a-z]{2,9}://[^\s:/@]{1,64}:[^\s:/@]{3,64}@[A-Za-z0-9.-]+"),
)


def both(a: Query, b: Query, kind: str = "and") -> Query:
    if kind == "and":
        if TRUE in (a, b):
            return b if a == TRUE else a
    elif TRUE in (a, b):
        return TRUE
    parts = {*(a[1] if a[0] == kind else (a,)), *(b[1] if b[0] == kind else (b,))}
    return (kind, frozenset(parts)) if len(parts) > 1 else parts.pop()


def needs(strings: set[bytes]) -> Query:
    """What one of the strings needs."""
    out: Query | None = None
    for s in strings:
        q = TRUE
        for i in range(len(s) - 2):
            q = both(q, ("tri", s[i : i + 3]))
        out = q if out is None else both(out, q, "or")
    return out or TRUE


def derive(pattern: str, flags: int = re.ASCII) -> Query:
    """The Boolean trigram query of a regex; `TRUE` if nothing is mandatory."""
    exact, query = _walk(list(_parser.parse(pattern, flags)))
    return both(query, needs(exact)) if exact is not None else query


def _walk(items: list) -> tuple[set[bytes] | None, Query]:
    """All strings the sequence can match (None: too many) and, for what was too many, the query so far."""
    run: set[bytes] = {b""}
    query, whole = TRUE, True
    for op, arg in items:
        strings, q = _item(op, arg)
        query = both(query, q)
        if strings is not None and len(run) * len(strings) <= EXACT:
            run = {a + b for a in run for b in strings}
        else:
            query, whole = both(query, needs(run)), False
            run = strings if strings is not None and len(strings) <= EXACT else {b""}
    return (run, query) if whole else (None, both(query, needs(run)))


def _fold(code: int) -> bytes:
    return chr(code).encode().lower()


def _item(op, arg) -> tuple[set[bytes] | None, Query]:
    if op is sre.LITERAL:
        return {_fold(arg)}, TRUE
    if op is sre.IN:
        if all(o is sre.LITERAL for o, _ in arg):
            return {_fold(a) for _, a in arg}, TRUE
        return None, TRUE
    if op is sre.SUBPATTERN:
        return _walk(list(arg[-1]))
    if op is sre.BRANCH:
        found = [_walk(list(b)) for b in arg[1]]
        if all(s is not None for s, _ in found) and sum(len(s) for s, _ in found) <= EXACT:
            return set().union(*(s for s, _ in found)), TRUE
        out = None
        for s, q in found:
            q = both(q, needs(s)) if s is not None else q
            out = q if out is None else both(out, q, "or")
        return None, out
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        low, high, inner = arg
        strings, q = _walk(list(inner))
        if low == 0:
            return (strings | {b""}, TRUE) if high == 1 and strings is not None else (None, TRUE)
        if strings is not None and low == high and len(strings) ** low <= EXACT:
            out = {b""}
            for _ in range(low):
                out = {a + b for a in out for b in strings}
            return out, q
        return None, both(q, needs(strings)) if strings is not None else q
    if op is sre.AT or op in (sre.ASSERT, sre.ASSERT_NOT):
        return {b""}, TRUE
    return None, TRUE


class TrigramIndex:
    """Postings of a block of documents for the trigrams that the queries name."""

    def __init__(self, wanted: set[bytes]):
        self.wanted = sorted(wanted)
        self.slots = np.zeros(1 << 24, np.int16)
        for i, t in enumerate(self.wanted, 1):
            self.slots[int.from_bytes(t, "big")] = i
        self.postings: dict[bytes, np.ndarray] = {}
        self.n = 0

    def build(self, docs: list[bytes]) -> None:
        """docs: case-folded bytes. Replaces the block that was held."""
        self.n, pairs = len(docs), []
        block, owners, size = [], [], 0

        def flush():
            nonlocal size
            if block:
                data = np.frombuffer(b"\0\0".join([*block, b"\0\0"]), np.uint8).astype(np.uint32)
                slot = self.slots[(data[:-2] << 16) | (data[1:-1] << 8) | data[2:]]
                at = np.nonzero(slot)[0]
                ends = np.cumsum([len(b) + 2 for b in block])
                doc = np.asarray(owners)[np.searchsorted(ends, at, side="right")]
                pairs.append(np.unique(slot[at].astype(np.int64) << 32 | doc))
            block.clear(), owners.clear()
            size = 0

        for i, d in enumerate(docs):
            for k in range(0, max(1, len(d)), PIECE):
                block.append(d[k : k + PIECE + 2])
                owners.append(i)
                size += len(block[-1])
                if size >= PIECE:
                    flush()
        flush()
        found = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
        slot = found >> 32
        cuts = np.searchsorted(slot, np.arange(1, len(self.wanted) + 2))
        docs_of = (found & 0xFFFFFFFF).astype(np.int64)
        self.postings = {t: docs_of[cuts[i] : cuts[i + 1]] for i, t in enumerate(self.wanted)}

    def search(self, query: Query) -> np.ndarray:
        """The documents, in order, that satisfy the query."""
        kind = query[0]
        if kind == "true":
            return np.arange(self.n)
        if kind == "tri":
            return self.postings[query[1]]
        found = sorted((self.search(q) for q in query[1]), key=len)
        out = found[0]
        for x in found[1:]:
            out = np.intersect1d(out, x, True) if kind == "and" else np.union1d(out, x)
        return out


def trigrams_of(query: Query) -> set[bytes]:
    return {query[1]} if query[0] == "tri" else set().union(*map(trigrams_of, query[1])) if query[0] in ("and", "or") else set()


class SecretScanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules, self.queries = rules, [derive(r.pattern, r.flags) for r in rules]
        self.index = TrigramIndex(set().union(*map(trigrams_of, self.queries)))

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text the spans (start, ordinal of the rule, end), sorted."""
        self.index.build([t.encode("utf-8", "replace").lower() for t in texts])
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, query) in enumerate(zip(self.rules, self.queries)):
            for i in self.index.search(query).tolist():
                out[i] += [(a, k, b) for a, b in rule.spans(texts[i])]
        for x in out:
            x.sort()
        return out


_SCANNERS: dict[tuple[Rule, ...], SecretScanner] = {}


def _scanner(rules: tuple[Rule, ...]) -> SecretScanner:
    if rules not in _SCANNERS:
        _SCANNERS[rules] = SecretScanner(rules)
    return _SCANNERS[rules]


def scan_secrets(docs: DataFrame, more_rules: tuple[Rule, ...] = MORE_RULES) -> DataFrame:
    """doc_id and secrets array<struct<kind, start, end>> of every whole text, by start, then by the order of the rules."""
    plain = [(r.kind, r.pattern, r.group, r.least, r.flags) for r in (*BASE_RULES, *more_rules)]

    def run(columns):
        rules = tuple(Rule(*x) for x in plain)
        found = _scanner(rules).scan([t or "" for t in columns[1]])
        return columns[0], [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in x] for x in found]

    return map_rows(docs.select("doc_id", "text"), "doc_id bigint, secrets array<struct<kind:string,start:int,end:int>>", run, size_column=1)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: the contract's digest of scan_secrets()."""
    from pyspark.sql import functions as F

    found = scan_secrets(table(spark, sf_dir, "documents"))
    base = F.array(*[F.lit(r.kind) for r in BASE_RULES])
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    count = lambda k: F.size(F.filter("secrets", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *[count(r.kind) for r in BASE_RULES],
        F.sha2(joined(F.filter("secrets", lambda s: F.array_contains(base, s.kind))), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )
