"""BPE encoding and decoding with a contiguous rank array (operator 7).

A word is held as part boundaries plus the rank of every adjacent pair. The smallest rank is searched by scanning the array,
its boundary is deleted, and the two neighbouring ranks are refreshed. Words over `LONG_WORD` symbols use a heap over the
same merges instead, which gives the same parts without the quadratic scan.

Null texts count as empty; an empty text has no tokens. Equal texts give equal rows; repeated rows stay repeated.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import map_rows, table

LONG_WORD = 256
CACHE_WORDS = 400_000
#: Only chunks up to so many characters are remembered.
CACHE_CHARS = 48
#: Python's split() takes these for white space, the vocabulary's rules don't.
ODD_SPACE = re.compile("[\x1c-\x1f]")
WHITE = regex.compile(r"\p{White_Space}+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable character for each byte: printable Latin-1 stands for itself, the rest follow from U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


class WordBpe:
    """A vocabulary of the tokenizers library: BPE with word ends, NFC and lower case, white space dropped."""

    def __init__(self, spec: bytes | str):
        conf = json.loads(spec)
        model = conf["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.end: str = model.get("end_of_word_suffix") or ""
        self.ranks: dict[tuple[str, str], int] = {}
        for i, m in enumerate(model["merges"]):
            self.ranks.setdefault(tuple(m) if isinstance(m, list) else tuple(m.split(" ")), i)
        self.special = {t["content"]: t["id"] for t in conf["added_tokens"]}
        self.strings = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        self.special_at = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        splits = [p["pattern"]["Regex"] for p in conf["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.word = regex.compile(splits[0].replace(r"^\s", r"^\p{White_Space}"))
        self.symbols = byte_symbols()
        self.cache: dict[str, tuple[int, str, str]] = {}

    def parts(self, word: str) -> list[str]:
        """The parts of one word (already normalised) after all merges."""
        symbols = [self.symbols[b] for b in word.encode()]
        symbols[-1] += self.end
        return self._scan(symbols) if len(symbols) <= LONG_WORD else self._heap(symbols)

    def _scan(self, parts: list[str]) -> list[str]:
        none, get = 1 << 60, self.ranks.get
        ranks = [get(pair, none) for pair in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == none:
                break
            i = ranks.index(least)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), none)
        return parts

    def _heap(self, parts: list[str]) -> list[str]:
        n, get = len(parts), self.ranks.get
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or parts[i] != left or parts[j] != right:
                continue
            parts[i], alive[j], after[i] = left + right, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := get((parts[a], parts[b]))) is not None:
                    heapq.heappush(heap, (r, a, parts[a], parts[b]))
        return [p for p, a in zip(parts, alive) if a]

    def _chunk(self, chunk: str) -> tuple[int, str, str]:
        """Count, ids and strings of the tokens of a chunk without white space."""
        text = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()  # letter by letter: no final sigma
        tokens = [p for w in self.word.findall(text) for p in self.parts(w)]
        found = [(i, t) for t in tokens if (i := self.ids.get(t)) is not None]
        entry = len(found), " ".join(str(i) for i, _ in found), " ".join(t for _, t in found)
        if len(chunk) <= CACHE_CHARS:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            self.cache[chunk] = entry
        return entry

    def _plain(self, text: str) -> Iterable[tuple[int, str, str]]:
        chunks = [c for c in WHITE.split(text) if c] if ODD_SPACE.search(text) else text.split()
        get, make = self.cache.get, self._chunk
        return [get(c) or make(c) for c in chunks]

    def pieces(self, text: str) -> list[tuple[int, str, str]]:
        """(count, ids, strings) of each chunk in order; chunks without tokens are left out."""
        if not self.special_at or not self.special_at.search(text):
            found = self._plain(text)
        else:
            found, at = [], 0
            for m in self.special_at.finditer(text):
                found += self._plain(text[at : m.start()])
                found.append((1, str(self.special[m[0]]), m[0]))
                at = m.end()
            found += self._plain(text[at:])
        return [x for x in found if x[0]]

    def encode(self, text: str) -> list[int]:
        return [int(i) for x in self.pieces(text) for i in x[1].split()]

    def decode(self, ids: Iterable[int]) -> str:
        """The strings of the ids, joined by a space: the vocabulary names no decoder."""
        return " ".join(self.strings[i] for i in ids)


_LOADED: dict[bytes, WordBpe] = {}


def _loaded(spec: bytes) -> WordBpe:
    key = hashlib.sha256(spec).digest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordBpe(spec)
    return _LOADED[key]


def _spec(spark: SparkSession, vocabulary: str | None):
    with open(vocabulary or default_vocabulary(), "rb") as f:
        return spark.sparkContext.broadcast(f.read())  # a vocabulary file: 1.7 MB, not a function of the data


def encode(docs: DataFrame, vocabulary: str | None = None, decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens long, ids array<int> of every whole text; nulls are empty texts. decoded: with decoded_sha256, of the text
    that the ids decode to."""
    spec = _spec(docs.sparkSession, vocabulary)

    def run(columns):
        bpe, ids, texts = _loaded(spec.value), [], []
        for text in columns[1]:
            joined = " ".join([x[1] for x in bpe.pieces(text or "")])
            ids.append(np.array(joined.split(), np.int32))
            if decoded:
                texts.append(hashlib.sha256(bpe.decode(ids[-1].tolist()).encode()).hexdigest())
        return (columns[0], [len(x) for x in ids], ids, texts)[: 3 + decoded]

    return map_rows(docs.select("doc_id", "text"), "doc_id bigint, n_tokens bigint, ids array<int>" + ", decoded_sha256 string" * decoded, run, size_column=1)


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and the decoded text of the ids; null ids decode to an empty text."""
    spec = _spec(encoded.sparkSession, vocabulary)

    def run(columns):
        bpe = _loaded(spec.value)
        return columns[0], [bpe.decode(x or ()) for x in columns[1]]

    return map_rows(encoded.select("doc_id", "ids"), "doc_id bigint, decoded string", run)


def encode_digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """encode() and decode() of each text in one pass, returned as digests: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    spec = _spec(docs.sparkSession, vocabulary)

    def run(columns):
        bpe, counts, ids, texts = _loaded(spec.value), [], [], []
        for text in columns[1]:
            found = bpe.pieces(text or "")
            joined = " ".join([x[1] for x in found])
            counts.append(sum([x[0] for x in found]))
            ids.append(hashlib.sha256(joined.encode()).hexdigest())
            texts.append(hashlib.sha256(bpe.decode(map(int, joined.split())).encode()).hexdigest())
        return columns[0], counts, ids, texts

    return map_rows(docs.select("doc_id", "text"), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", run, size_column=1)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"))
