"""Licence scans against all windows."""

import random
import time
from collections import Counter

from ablatrix.llm import licences

from .helpers import TEXTS, no_documents, odd_documents


def brute(text, templates, dice):
    """Every window of words of every template, then the same choice among overlapping ones."""
    words, found = licences.words_of(text), []
    grams = list(zip(words, words[1:]))
    for name, t in templates.items():
        w = licences.words_of(t)
        want = Counter(zip(w, w[1:]))
        size = sum(want.values())
        for a in range(len(grams)):
            if grams[a] not in want:
                continue
            best, have = (0.0, 0), Counter()
            for b in range(a, len(grams)):
                have[grams[b]] += 1
                d = 2 * sum((have & want).values()) / (b - a + 1 + size)
                best = max(best, (d, -b))
            if best[0] >= dice - 1e-12:
                found.append((-best[0], -size, a, name, -best[1] + 2))
    taken = []
    for d, _, a, name, b in sorted(found):
        if all(b <= x or y <= a for x, y, *_ in taken):
            taken.append((a, b, name, -d))
    return [(name, a, b, d) for a, b, name, d in sorted(taken)]


def words_at(text, m):
    before = len(licences.words_of(text[: m.start]))
    return before, before + len(licences.words_of(text[m.start : m.end]))


def test_against_all_windows():
    rng = random.Random(6)
    templates = {k: v for k, v in licences.TEMPLATES.items() if len(v) < 200}
    scanner = licences.LicenceScanner(templates)
    pool = [w for t in templates.values() for w in t.split()] + ["foo", "bar"]
    hits = 0
    for _ in range(250):
        parts = []
        for _ in range(rng.randint(0, 5)):
            part = rng.choice([*templates.values(), " ".join(rng.choice(pool) for _ in range(8))]).split()
            for _ in range(rng.randint(0, 2)):
                part[rng.randrange(len(part))] = rng.choice(pool)
            parts.append(" ".join(part))
        text = "\n".join(parts)
        got = [(m.template, *words_at(text, m), m.dice) for m in scanner.scan(text)]
        assert got == brute(text, templates, licences.DICE), text
        hits += len(got)
    assert hits > 200


def test_notices_in_running_text():
    scanner = licences.LicenceScanner(licences.TEMPLATES)
    for name, t in licences.TEMPLATES.items():
        text = f"İ before, {t.upper() if len(t) % 2 else t} And after."
        (m,) = [m for m in scanner.scan(text) if m.template == name]
        assert m.dice == 1.0 and licences.words_of(text[m.start : m.end]) == licences.words_of(t)
    long = "word " * 50_000 + licences.TEMPLATES["mit-text"].replace("hereby ", "") + " word" * 50_000
    assert [m.template for m in scanner.scan(long)] == ["mit-text"]
    assert scanner.scan("the rights of all are reserved under the law") == []


def test_long_texts_of_notices():
    """A megabyte of notices and of licence texts each take a few seconds at most."""
    scanner = licences.LicenceScanner(licences.TEMPLATES)
    for name in ("mit-notice", "mit-text"):
        text = licences.TEMPLATES[name] + " in between\n"
        n = 1_000_000 // len(text)
        start = time.process_time()
        found = scanner.scan(text * n)
        assert time.process_time() - start < 8, name
        assert [m.template for m in found].count(name) == n


def test_long_templates_against_all_windows():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(30)]
    templates = {"a": " ".join(rng.choice(words) for _ in range(120)), "b": " ".join(rng.choice(words) for _ in range(40))}
    scanner, hits = licences.LicenceScanner(templates), 0
    for _ in range(25):
        parts = []
        for _ in range(rng.randint(1, 4)):
            part = rng.choice([*templates.values(), " ".join(rng.choice(words) for _ in range(50))]).split()
            for _ in range(rng.randint(0, 12)):
                part[rng.randrange(len(part))] = rng.choice([*words, "x"])
            parts.append(" ".join(part))
        text = " ".join(parts)
        got = [(m.template, *words_at(text, m), m.dice) for m in scanner.scan(text)]
        assert got == brute(text, templates, licences.DICE)
        hits += len(got)
    assert hits > 15


def test_many_words_and_none():
    assert licences.LicenceScanner({}).scan("all rights reserved") == []
    templates = {f"t{k}": " ".join(f"w{k}x{i}" for i in range(60)) for k in range(200)}
    scanner = licences.LicenceScanner(templates)
    assert len(scanner.codes) == 200 * 59  # a table over all pairs of their words would take 576 MB
    (m,) = scanner.scan(f"Before. {templates['t7']} w3x1 w9x2 after")
    assert (m.template, m.start, m.dice) == ("t7", 8, 1.0)


def test_odd_rows(spark):
    rows = licences.scan_licences(odd_documents(spark)).collect()
    assert len(rows) == len(TEXTS) + 4 and not any(r.licences for r in rows)
    assert licences.scan_licences(no_documents(spark)).count() == 0
