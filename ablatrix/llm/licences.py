"""Licence scans (operator 4): passages against licence templates by the Dice coefficient over word bigrams.

Texts and templates are normalised to lower-case runs of letters and digits. For a window of a bigrams and a template of b, with
overlap o (multisets), Dice = 2 o / (a + b). A window reaches `DICE` only if a lies between b DICE / (2 - DICE) and
b (2 - DICE) / DICE, and if the text holds at least b DICE / (2 - DICE) of the template's bigrams at all. The second bound leaves
few candidate templates per text, the first limits windows. Best windows start and end at a bigram of the template, so for each such
start the best end is found from a table of the template's bigrams within the bound, made for many starts at once; starts are tried in
strides first, and left out where a bound on their neighbours shows that none reaches DICE. No window of the whole text is left out.
Of overlapping windows the one with the higher Dice stays (then the longer template, the earlier start, the template's name).

Null texts count as empty and hold no licences; texts of fewer than two words have no bigrams. Rows may repeat, each is scanned alone;
only doc_id and text are read, so further columns can't clash. Spans are code points, ends exclusive.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import map_rows, table

DICE = 0.8
WORD = re.compile(r"[^\W_]+")
#: Starts of a stride, and cells of a table of windows that is held at once.
STRIDE, CELLS = 8, 1 << 20

# Wording of usual licence notices and of short licences.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
    'http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
    "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "mit-notice": "Released under the MIT License.",
    "mit-notice-licensed": "Licensed under the MIT License.",
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "
    '"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE '
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE "
    "OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear "
    'in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE '
    "AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
    "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "all-rights-reserved": "All rights reserved.",
}


@dataclass(frozen=True)
class Match:
    template: str
    start: int
    end: int
    dice: float


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class LicenceScanner:
    """Templates as counts of bigrams over their own vocabulary; word 0 is any other word."""

    def __init__(self, templates: dict[str, str], dice: float = DICE):
        self.dice, self.names = dice, sorted(templates)
        words = {n: words_of(templates[n]) for n in self.names}
        self.ids = {w: i for i, w in enumerate(sorted({w for x in words.values() for w in x}), 1)}
        bigrams = {n: Counter(zip(x, x[1:])) for n, x in words.items()}
        self.width = len(self.ids) + 1
        code = lambda g: self.ids[g[0]] * self.width + self.ids[g[1]]
        known = sorted({g for c in bigrams.values() for g in c}, key=code)
        self.codes = np.array([code(g) for g in known], np.int64)  # grows with the templates' bigrams, not with the square of their words
        self.counts = np.zeros((len(self.names), len(known)), np.int32)
        for k, n in enumerate(self.names):
            for i, g in enumerate(known):
                self.counts[k, i] = bigrams[n][g]
        self.sizes = self.counts.sum(axis=1)

    def scan(self, text: str) -> list[Match]:
        """The licences of one text, in order of their starts."""
        get = self.ids.get
        ids = np.array([get(w, 0) for w in words_of(text)], np.int64)
        if len(ids) < 2 or not len(self.codes):
            return []
        grams = np.full(len(ids) - 1, -1)
        some = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))  # pairs with word 0 are in no template
        codes = ids[some] * self.width + ids[some + 1]
        place = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        grams[some] = np.where(self.codes[place] == codes, place, -1)
        at = np.flatnonzero(grams >= 0)
        if not len(at):
            return []
        held = np.bincount(grams[at], minlength=self.counts.shape[1])
        overlap = np.minimum(self.counts, held).sum(axis=1)
        found = []
        for k in np.flatnonzero(overlap * (2 - self.dice) >= self.dice * self.sizes - 1e-9):
            found += [(-d, -int(self.sizes[k]), a, self.names[k], b) for a, b, d in self._windows(k, at, grams)]
        taken: list[tuple[int, int]] = []  # apart from each other, in order
        out = []
        for d, _, a, name, b in sorted(found):
            i = bisect.bisect_left(taken, (a, b))
            if (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or b <= taken[i][0]):
                taken.insert(i, (a, b))
                out.append((name, a, b, -d))
        if not out:
            return []
        lower = text.lower()
        spans = [m.span() for m in WORD.finditer(lower)] if len(lower) == len(text) else self._spans(text)
        return sorted((Match(n, spans[a][0], spans[b - 1][1], d) for n, a, b, d in out), key=lambda m: (m.start, m.end))

    @staticmethod
    def _spans(text: str) -> list[tuple[int, int]]:
        """Spans in the text itself where lower-casing changes its length."""
        owner = [i for i, c in enumerate(text) for _ in c.lower()]
        return [(owner[m.start()], owner[m.end() - 1] + 1) for m in WORD.finditer("".join(c.lower() for c in text))]

    def _windows(self, k: int, at: np.ndarray, grams: np.ndarray) -> list[tuple[int, int, float]]:
        """(first word, word after the last, Dice) of the best window from each start that reaches the threshold.

        A bigram counts towards the overlap of a window unless the window holds as many of it before as the template has: `full` is
        the place of the last start with which it doesn't. The best Dice from one start exceeds that from a start before by a factor of
        at most exp(words between / size), so starts are first tried in strides, and only near those that come close each by each."""
        want, size = self.counts[k], int(self.sizes[k])
        at = at[want[grams[at]] > 0]
        n, most = len(at), int(size * (2 - self.dice) / self.dice + 1e-9)
        order = np.argsort(grams[at], kind="stable")
        mine = grams[at][order]
        first = np.searchsorted(mine, mine)
        before = np.arange(n) - want[mine]
        full = np.full(n, -1)
        full[order] = np.where(before >= first, order[np.maximum(before, 0)], -1)

        def best(starts: np.ndarray, more: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
            """The best Dice from each start over windows of most + more bigrams, and the place of its first end."""
            dice, end = np.zeros(len(starts)), np.zeros(len(starts), int)
            ends = np.searchsorted(at, at[starts] + most + more)  # windows end before this place
            wide = int((ends - starts).max())
            rows = max(1, CELLS // wide)
            for s in range(0, len(starts), rows):
                own = starts[s : s + rows, None]
                to = own + np.arange(wide)
                inside = to < ends[s : s + rows, None]
                to = np.minimum(to, n - 1)
                counted = (full[to] < own) & inside
                values = np.where(counted, 2 * np.cumsum(counted, axis=1) / (at[to] - at[own] + 1 + size), 0.0)
                place = values.argmax(axis=1)
                dice[s : s + rows], end[s : s + rows] = values[np.arange(len(place)), place], to[np.arange(len(place)), place]
            return dice, end

        coarse = np.arange(0, n, STRIDE)
        between = at[np.minimum(coarse + STRIDE, n) - 1] - at[coarse]
        reached, _ = best(coarse, np.minimum(between, most))
        close = (between > most) | (reached * np.exp(between / size) >= self.dice - 1e-9)
        starts = np.flatnonzero(np.repeat(close, np.minimum(STRIDE, n - coarse)))
        if not len(starts):
            return []
        dice, end = best(starts)
        ok = dice >= self.dice - 1e-12
        return list(zip(at[starts[ok]].tolist(), (at[end[ok]] + 2).tolist(), dice[ok].tolist()))


def scan_licences(docs: DataFrame, templates: dict[str, str] | None = None, dice: float = DICE) -> DataFrame:
    """doc_id and licences array<struct<template, start, end, dice>> of every whole text."""
    plain = tuple(sorted((TEMPLATES if templates is None else templates).items()))

    made: list[LicenceScanner] = []  # each task makes its own

    def run(columns):
        if not made:
            made.append(LicenceScanner(dict(plain), dice))
        scan = made[0].scan
        return columns[0], [[{"template": m.template, "start": m.start, "end": m.end, "dice": m.dice} for m in scan(t or "")] for t in columns[1]]

    return map_rows(docs.select("doc_id", "text"), "doc_id bigint, licences array<struct<template:string,start:int,end:int,dice:double>>", run, size_column=1)


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_licences, best (the template with the highest Dice, null without any), licences (template:start:end:dice, joined)."""
    found = scan_licences(table(spark, sf_dir, "documents"))
    joined = F.array_join(F.transform("licences", lambda m: F.concat_ws(":", m["template"], m["start"], m["end"], F.format_string("%.4f", m["dice"]))), ",")
    order = F.array_sort(F.transform("licences", lambda m: F.struct((-m["dice"]).alias("d"), m["start"].alias("s"), m["template"].alias("t"))))
    return found.select("doc_id", F.size("licences").cast("long").alias("n_licences"), F.get(order, F.lit(0))["t"].alias("best"), joined.alias("licences"))
