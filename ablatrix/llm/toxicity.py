"""Toxicity (operator 6): maximum-scoring segments over token log-odds, calibrated by extreme values.

Tokens are runs of letters of the lower-cased text. Words, and the stems of longer words, are hashed to 2^`BITS` buckets, so that
every table below has a fixed size; a stem speaks for words that are too rare to be sure of.
1. Counts: one pass over all documents counts the occurrences of each bucket, and the labelled training documents that hold it, by
   label and fold (once per document: repeated words are no evidence of their own).
2. Log-odds: log-odds of each bucket in toxic against clean training documents, with a Dirichlet prior proportional to the
   bucket's frequency in the whole corpus; values within `Z` standard errors of 0 count as 0, and a drift is taken off each token.
3. Passages: a linear scan finds every maximal scoring segment of a text. With lambda the root of E[exp(lambda s)] = 1 over the
   corpus and K fitted to the best segments of clean training texts, a segment of score S in n tokens has E = K n exp(-lambda S).
   Segments with E of at most `SIGNIFICANT` are its toxic passages.
4. Score: a logistic function of the best segment's -ln E, the passages' summed -ln E and their number, fitted on training
   documents whose token scores came from the other fold.

Only labelled rows whose crc32(doc_id as text) mod 4 is not 2 train anything; at most `MAX_LABELS` of them (lowest md5 of the id)
are used, all if there are fewer. Everything else covers the whole corpus. Scores are functions of the text alone.

Null texts count as empty; a text without tokens gets the score of a text without any passage. Labels that repeat for an id
count once, toxic if any is; null labels are ignored; without labels of both classes every score is the share of toxic labels
(0 without labels). Repeated rows get equal scores. Only doc_id and text of documents are read, so further columns can't clash.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import cut, map_rows, stored, table, tidy

BITS = 20
SIZE = 1 << BITS
MAX_LABELS = 200_000
PRIOR = 2000.0
Z = 2.0
DRIFT = 0.4
CLIP = 8.0
SIGNIFICANT = 0.05
THRESHOLD = 0.3
#: Tokens within which a repeated word is damped. A word's log-odds is used up by the drift over CLIP / DRIFT tokens at most, so
#: farther than twice that, uses of a word are evidence for passages of their own.
SPAN = round(2 * CLIP / DRIFT)
#: Letters of a stem.
STEM = 5
WORD = re.compile(r"[^\W\d_]+")
CACHE_WORDS = 100_000
CHUNK = 4 << 20
#: Rows that a task hands on at once.
HAND_ON = 1 << 16
KINDS = ("corpus", "toxic0", "clean0", "toxic1", "clean1")


def _bucket(word: str, known: dict[str, int]) -> int:
    """Both buckets of a word in one number: its own, and that of its stem (its own again if it is short)."""
    found = known.get(word)
    if found is None:
        if len(known) >= CACHE_WORDS:
            known.clear()
        own = zlib.crc32(word.encode("utf-8", "replace")) & (SIZE - 1)
        stem = zlib.crc32((word[:STEM] + "*").encode("utf-8", "replace")) & (SIZE - 1) if len(word) > STEM else own
        found = known[word] = stem << BITS | own
    return found


def buckets(text: str | None, known: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the words and of their stems. known: what is remembered from one text to the next, within a task."""
    known = {} if known is None else known
    both = np.array([_bucket(w, known) for w in WORD.findall((text or "").lower())], dtype=np.int64)
    return both & (SIZE - 1), both >> BITS


def token_scores(odds: np.ndarray, b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A word's log-odds, or its stem's where the word's are not sure, less the drift.

    A positive word's k-th occurrence within `SPAN` tokens counts a k-th of its log-odds: a passage that repeats a word is no more
    toxic for it, and one far from earlier uses of its words scores as if they weren't there."""
    own = odds[b[0]]
    scores = np.where(own != 0, own, odds[b[1]])
    ups = np.flatnonzero(scores > 0)
    if len(ups) > 1:
        order = np.argsort(b[0][ups], kind="stable")
        place = (b[0][ups[order]] << 32) + ups[order]  # sorted; SPAN less stays above the places of the word before
        scores[ups[order]] /= np.arange(len(place)) - np.searchsorted(place, place - SPAN) + 1
    return scores - DRIFT


def training_labels(labels: DataFrame) -> DataFrame:
    """doc_id, toxic, fold of at most MAX_LABELS training rows."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = labels.select("doc_id", "toxic").filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (crc % 4 != 2))
    rows = rows.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    return rows.orderBy(F.md5(F.col("doc_id").cast("string"))).limit(MAX_LABELS).withColumn("fold", ((crc / 4).cast("bigint") % 2).cast("int"))


def _with_labels(docs: DataFrame, train: DataFrame, how: str) -> DataFrame:
    # at most MAX_LABELS rows of 16 bytes
    return docs.select("doc_id", "text").join(F.broadcast(train), "doc_id", how)


def count_buckets(docs: DataFrame, train: DataFrame) -> DataFrame:
    """bucket and a count per kind: summed within each task first, so a task hands on at most SIZE rows."""

    known: dict[str, int] = {}  # each task gets an empty one

    def run(batches):
        counts = np.zeros((len(KINDS), SIZE), np.int32)  # of one task
        for batch in batches:
            for part in cut(batch, 0, CHUNK):
                for text, toxic, fold in zip(*(c.to_pylist() for c in part.columns)):
                    own, stem = buckets(text, known)
                    found, n = np.unique(np.concatenate([own, stem[stem != own]]), return_counts=True)
                    counts[0, found] += n
                    if toxic is not None:
                        counts[1 + 2 * fold + (1 - toxic), found] += 1
        some = np.nonzero(counts[0])[0]
        for at in range(0, len(some), HAND_ON):
            x = some[at : at + HAND_ON]
            yield pa.RecordBatch.from_arrays([pa.array(x), *[pa.array(c[x].astype(np.int64)) for c in counts]], names=["bucket", *KINDS])

    rows = _with_labels(docs, train, "left").select("text", "toxic", "fold")
    found = rows.mapInArrow(tidy(run), "bucket bigint, " + ", ".join(f"{k} bigint" for k in KINDS))
    return found.groupBy("bucket").agg(*[F.sum(k).alias(k) for k in KINDS])


def log_odds(corpus: np.ndarray, unseen: float, toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Log-odds of each bucket, 0 where they are not sure. corpus: prior counts, unseen: their sum over buckets that no training
    document holds; toxic, clean: counts of the training classes."""
    prior = PRIOR * (corpus + 0.5) / (corpus.sum() + unseen + 0.5 * len(corpus))
    a, b = toxic + prior, clean + prior
    odds = np.log(a / (toxic.sum() + PRIOR - a)) - np.log(b / (clean.sum() + PRIOR - b))
    sure = np.abs(odds) >= Z * np.sqrt(1 / a + 1 / b)
    return np.clip(np.where(sure & (toxic + clean > 0), odds, 0.0), -CLIP, CLIP)


def scale(odds: np.ndarray, corpus: np.ndarray, unseen: float) -> float:
    """The positive root lambda of sum p exp(lambda s) = 1; 1 where no score is positive."""
    use = corpus > 0
    s, p = np.append(odds[use], 0.0) - DRIFT, np.append(corpus[use], unseen) / max(1, corpus.sum() + unseen)
    if not len(s) or s.max() <= 0 or (s * p).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    value = lambda x: float((p * np.exp(np.minimum(x * s, 700))).sum()) - 1
    while value(high) < 0 and high < 64:
        high *= 2
    low = high / 2 if value(high / 2) < 0 else 0.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return high


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """Every maximal scoring segment (start, end, score) in order, in linear time. Runs between positive scores are summed first."""
    ups = np.nonzero(scores > 0)[0]
    if not len(ups):
        return []
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    left_of, right_of = sums[ups].tolist(), sums[ups + 1].tolist()
    found: list[list] = []  # start, end, sum before the start, sum at the end, the nearest earlier one that starts lower
    for at, left, right in zip(ups.tolist(), left_of, right_of):
        new = [at, at + 1, left, right, -1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= new[3]:
                new[4] = j
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3], -1]
            del found[j:]
    return [(a, b, right - left) for a, b, left, right, _ in found]


@dataclass(frozen=True)
class Model:
    odds: np.ndarray
    lam: float
    log_k: float
    weights: tuple[float, ...]

    def judge(self, text: str | None, known: dict[str, int] | None = None) -> tuple[float, list[tuple[int, int, float, float]]]:
        """The score, and (start, end, score, ln E) of the significant segments, in tokens."""
        b, w = buckets(text, known), self.weights
        evidence, strong = [], []
        if n := len(b[0]):
            base = self.log_k + math.log(n)
            evidence = [(a, z, s, base - self.lam * s) for a, z, s in segments(token_scores(self.odds, b))]
            strong = [x for x in evidence if x[3] <= math.log(SIGNIFICANT)]
        features = min(30.0, max([0.0, *(-x[3] for x in evidence)])), math.log1p(-sum(x[3] for x in strong)), math.log1p(len(strong))
        odds = w[0] + sum(x * y for x, y in zip(w[1:], features))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))), strong


def fit_logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Newton's method; row i counts n[i] times. The ridge spares the intercept."""
    x = np.column_stack([np.ones(len(x)), x])
    w, pen = np.zeros(x.shape[1]), np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + pen, x.T @ (n * (y - p)) - pen @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def train(docs: DataFrame, labels: DataFrame) -> Model:
    spark = docs.sparkSession
    sample = stored(training_labels(labels), "toxicity-labels")
    counts, total = np.zeros((len(KINDS), SIZE)), F.sum("corpus")
    found = stored(count_buckets(docs, sample), "toxicity-counts")
    seen = found.filter("toxic0 + clean0 + toxic1 + clean1 > 0").toArrow()  # SIZE rows at most; the others' log-odds are 0
    for i, k in enumerate(KINDS):
        counts[i, seen["bucket"].to_numpy()] = seen[k].to_numpy()
    corpus = counts[0]
    unseen = (found.agg(total).first()[0] or 0) - corpus.sum()
    toxic, clean = counts[1] + counts[3], counts[2] + counts[4]
    if not toxic.sum() or not clean.sum():
        n = sample.agg(F.avg("toxic")).first()[0] or 0.0
        return Model(np.zeros(SIZE, np.float32), 1.0, 0.0, (math.log((n + 1e-9) / (1 - n + 1e-9)), 0.0, 0.0, 0.0))
    crossed = [log_odds(corpus, unseen, counts[3 - 2 * f], counts[4 - 2 * f]) for f in (0, 1)]  # fold f is scored by the other fold
    lams = [scale(s, corpus, unseen) for s in crossed]
    shipped = spark.sparkContext.broadcast((np.stack(crossed).astype(np.float32), lams))  # 8 MB
    known: dict[str, int] = {}

    def run(columns):
        odds, lam = shipped.value
        out = []
        for text, toxic_, fold in zip(*columns):
            b = buckets(text, known)
            out.append((toxic_, len(b[0]), [lam[fold] * s for *_, s in segments(token_scores(odds[fold], b))]))
        return list(zip(*out)) if out else [[], [], []]

    rows = _with_labels(docs, sample, "inner").select("text", "toxic", "fold")
    best = stored(map_rows(rows, "toxic int, n int, found array<double>", run, CHUNK, 0), "toxicity-segments")  # MAX_LABELS rows at most
    shipped.destroy()
    top = F.array_max("found")
    fit = best.filter("n > 0").select("toxic", "n", F.coalesce(top, F.lit(0.0)).alias("top"), "found")
    clean_mean = fit.filter("toxic = 0 and top > 0").agg(F.avg(F.col("top") - F.log("n"))).first()[0]
    log_k = (clean_mean if clean_mean is not None else 0.0) - 0.5772156649
    strong = F.filter(F.transform("found", lambda s: s - F.log("n") - F.lit(log_k)), lambda e: e >= -math.log(SIGNIFICANT))
    data = fit.select(
        "toxic",
        F.round(F.least(F.lit(30.0), F.when(F.size("found") > 0, F.greatest(F.lit(0.0), F.col("top") - F.log("n") - log_k)).otherwise(F.lit(0.0))), 1).alias("a"),
        F.round(F.log1p(F.aggregate(strong, F.lit(0.0), lambda a, e: a + e)), 1).alias("b"),
        F.round(F.log1p(F.size(strong)), 1).alias("c"),
    )
    data = data.groupBy("toxic", "a", "b", "c").count().orderBy("toxic", "a", "b", "c").toArrow()  # a grid of rounded features
    x = np.column_stack([data[c].to_numpy() for c in "abc"])
    odds = log_odds(corpus, unseen, toxic, clean)
    return Model(odds.astype(np.float32), scale(odds, corpus, unseen), log_k, fit_logistic(x, data["toxic"].to_numpy(), data["count"].to_numpy()))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score, n_passages, passages array<struct<start, end, score, log_e>> (in tokens) for every row of docs."""
    shipped = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    known: dict[str, int] = {}

    def run(columns):
        model, scores, found = shipped.value, [], []
        for text in columns[1]:
            score, passages = model.judge(text, known)
            scores.append(score)
            found.append([{"start": s, "end": e, "score": x, "log_e": y} for s, e, x, y in passages])
        return columns[0], scores, [len(x) for x in found], found

    schema = "doc_id bigint, score double, n_passages bigint, passages array<struct<start:int,end:int,score:double,log_e:double>>"
    return map_rows(docs.select("doc_id", "text"), schema, run, CHUNK, 1)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns kept, whose text scores below the threshold."""
    shipped = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    known: dict[str, int] = {}

    def run(batches):
        model = shipped.value
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for part in cut(batch, at, CHUNK):
                yield part.filter(pa.array([model.judge(t, known)[0] < threshold for t in part.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_passages")
