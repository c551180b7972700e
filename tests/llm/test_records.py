"""WARC archives, toxicity and the pipeline."""

import gzip
import hashlib
import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ablatrix.llm import bpe, common, mixing, near_dup, pii, toxicity, warc

from .helpers import DATA, SCHEMA, TEXTS, no_documents, odd_documents

PAGES = "page_id bigint, url string, html string, shard int, digest string, first string"


def pages():
    rng = random.Random(8)
    big = ["<html>" + "".join(rng.choice("abcdefgh <>/é\n") for _ in range(n)) for n in (200, 300, 5000, 120)]
    rows = [(i * 7, f"http://h/{i}", rng.choice([*big, "tiny", "", None, f"<p>{i}</p>" * 30])) for i in range(300)]
    return rows + [(None, None, big[0]), (None, "u", "unique text under null ids " * 10), (7, "http://again", rows[1][2])]


def lines(spark, rows):
    return spark.createDataFrame([(*r, 1, "d", "f") for r in rows], PAGES)


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    monkeypatch.setattr(warc, "SHARD_BYTES", 60_000)
    rows = pages()
    where = common.scratch(spark, "t-warc")
    manifest = warc.write_warc(lines(spark, rows), where).collect()
    folder = where.removeprefix("file://")
    assert len(manifest) > 5 and len({r["shard"] for r in manifest}) > 1
    for r in manifest:
        with open(f"{folder}/{r['name']}", "rb") as f:
            data = f.read()
        assert len(data) == r["bytes"] and hashlib.sha256(data).hexdigest() == r["sha256"] and len(gzip.decompress(data)) == r["raw_bytes"]
        assert r["records"] == len(list(warc.records_of(data)))
    assert not [n for n in os.listdir(folder) if n.startswith("_temporary")]
    with pytest.raises(FileExistsError):
        warc.write_warc(lines(spark, rows), where)
    back = warc.read_warc(spark, where, payloads=True).collect()
    assert len(back) == len(rows)
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    first = {}
    for p, _, t in rows:
        if p is not None and len((t or "").encode()) >= 100:
            first[digest(t)] = min(first.get(digest(t), p), p)
    assert sorted((r.page_id or -1, r.payload_digest, r.payload_bytes) for r in back) == sorted((p or -1, digest(t), len((t or "").encode())) for p, _, t in rows)
    seen = set()
    for r in back:
        to = first.get(r.payload_digest)
        if r.record_type == "response":
            assert r.refers_to is None and hashlib.sha256(r.payload).hexdigest() == r.payload_digest
            assert to in (None, r.page_id)
            assert r.payload_bytes < 100 or r.page_id is None or r.payload_digest not in seen
            seen.add(r.payload_digest)
        else:
            assert r.refers_to == to and bytes(r.payload) == b""
    other = common.scratch(spark, "t-warc")
    warc.write_warc(lines(spark, rows[::-1]).repartition(7), other)
    for r in manifest:
        with open(f"{folder}/{r['name']}", "rb") as a, open(f"{other.removeprefix('file://')}/{r['name']}", "rb") as b:
            assert a.read() == b.read()


def test_warc_shards_are_ranges_of_ids(spark, monkeypatch):
    """With an id far from all others, an id of many pages, a bin of many shards, and what a run that broke off has left."""
    monkeypatch.setattr(warc, "SHARD_BYTES", 30_000)
    text = lambda i: f"page {i} " * (40 + i % 60)
    rows = [(i, "u", text(i)) for i in range(600)] + [(1 << 50, "far", text(1)), *[(300, f"v{i}", text(1000 + i)) for i in range(200)], *[(None, "w", text(3000 + i)) for i in range(200)]]
    where = common.scratch(spark, "t-warc")
    folder = where.removeprefix("file://")
    os.makedirs(f"{folder}/_temporary")
    for name in ("_temporary/x", "part-00000-00000.warc.gz"):
        with open(f"{folder}/{name}", "w") as f:
            f.write("left over")
    manifest = warc.write_warc(lines(spark, rows), where).orderBy("name").collect()
    assert len(warc.read_warc(spark, where).collect()) == len(rows)
    ranges = {}
    for r in manifest:
        with open(f"{folder}/{r['name']}", "rb") as f:
            ids = [int(h["x-page-id"]) if "x-page-id" in h else -1 for h, _ in warc.records_of(f.read())]
        assert ids == sorted(ids)
        ranges.setdefault(r["shard"], []).extend(ids)
        assert r["raw_bytes"] <= 3 * warc.SHARD_BYTES
    shards = [ranges[k] for k in sorted(ranges)]
    assert len(shards) > 20 and sum(300 in s for s in shards) > 2 and sum(-1 in s for s in shards) > 2
    assert all(max(a) <= min(b) for a, b in zip(shards, shards[1:]))


def test_warc_notices_damage(spark):
    data = bytearray(warc.packed(warc.record("response", "u", 1, hashlib.sha256(b"x" * 200).hexdigest(), b"x" * 200, None)))
    assert len(list(warc.records_of(bytes(data)))) == 1
    with pytest.raises(ValueError):
        list(warc.records_of(bytes(data[:-40])))
    plain = warc.record("response", "u", 1, "d", b"abc", None).replace(b"abc", b"abd")
    with pytest.raises(ValueError):
        list(warc.records_of(plain))


def test_warc_without_pages(spark):
    where = common.scratch(spark, "t-warc")
    warc.write_warc(lines(spark, pages()).limit(0), where)
    assert warc.read_warc(spark, where).count() == 0


def brute_segments(scores):
    """Every maximal segment by its definition, by recursion on the best one."""

    def split(lo, hi):
        best = max(((sum(scores[a:b]), -(b - a), -a, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=None)
        if best is None or best[0] <= 1e-12:
            return []
        _, _, _, a, b = best
        return [*split(lo, a), (a, b), *split(b, hi)]

    return split(0, len(scores))


def test_segments_against_recursion():
    rng = np.random.default_rng(2)
    for _ in range(150):
        scores = rng.choice([-3.0, -1.7, -0.6, 0.9, 2.3, 3.1], rng.integers(0, 14)) + rng.random() * 1e-3
        assert [(a, b) for a, b, _ in toxicity.segments(scores)] == brute_segments(scores.tolist())


def test_scale_is_the_root():
    odds, corpus = np.array([2.0, 0.0, 4.0]), np.array([10.0, 1000.0, 2.0])
    lam = toxicity.scale(odds, corpus, 50.0)
    p = np.append(corpus, 50.0) / (corpus.sum() + 50)
    assert (p * np.exp(lam * (np.append(odds, 0.0) - toxicity.DRIFT))).sum() == pytest.approx(1, abs=1e-6)


def test_passages_score_the_same_wherever_they_stand():
    odds = np.full(toxicity.SIZE, -0.2)
    rude = ["idiot", "scum", "moron"]
    odds[toxicity.buckets(" ".join(rude))[0]] = 4.0
    model = toxicity.Model(odds, 1.0, -2.0, (-4.0, 0.5, 0.5, 0.5))
    words = ["calm"] * 2500
    plain = model.judge(" ".join(words + rude))
    for at, word in zip((100, 500, 900, 1300, 1700, 2100), rude * 2):
        words[at] = word
    used = model.judge(" ".join(words + rude))
    assert [x[:2] for x in plain[1]] == [x[:2] for x in used[1]] == [(2500, 2503)]
    assert used[1][0][2:] == pytest.approx(plain[1][0][2:]) and used[0] == pytest.approx(plain[0])
    scores = toxicity.token_scores(odds, toxicity.buckets("idiot calm idiot " + "calm " * 37 + "idiot " + "calm " * 40 + "idiot")) + toxicity.DRIFT
    assert scores[[0, 2, 40, 81]] == pytest.approx([4.0, 2.0, 4 / 3, 4.0])  # 40 tokens back counts, 41 doesn't


def labelled(spark, n=1500, seed=3):
    rng = random.Random(seed)
    calm, rude = [f"calm{i}x" for i in range(200)], ["idiot", "scumbag", "moronic"]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(calm) for _ in range(rng.randint(20, 120))]
        toxic = rng.random() < 0.2
        if toxic:
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice(rude) for _ in range(rng.randint(1, 3))]
        docs.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    scores = {r.doc_id: r.score for r in toxicity.score_documents(docs, labels).collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    good = sum((scores[i] >= toxicity.THRESHOLD) == bool(truth[i]) for i in held)
    assert good >= 0.98 * len(held) > 200
    hidden = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id: r.score for r in toxicity.score_documents(docs, hidden).collect()} == scores  # held-out labels change nothing
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, s in scores.items() if s < toxicity.THRESHOLD}


def test_passages_are_where_the_words_are(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels)
    score, passages = model.judge("calm1x calm2x calm3x idiot moronic calm4x calm5x " + "calm6x " * 30)
    assert score >= toxicity.THRESHOLD and [(a, b) for a, b, *_ in passages] == [(6, 8)]  # `calm1x` is two words
    assert model.judge("")[0] == model.judge(None)[0] < toxicity.THRESHOLD


def test_toxicity_odd_rows(spark):
    _, labels = labelled(spark, 40)
    more = labels.union(spark.createDataFrame([(None, 1, 1), (1, None, None), (1, 1, 1), (1, 1, 0)], labels.schema))
    rows = toxicity.score_documents(odd_documents(spark), more).collect()
    assert len(rows) == len(TEXTS) + 4 and all(0 <= r.score <= 1 for r in rows)
    for docs, known in ((no_documents(spark), labels), (odd_documents(spark), labels.limit(0)), (odd_documents(spark), labels.filter("toxic = 0"))):
        rows = toxicity.score_documents(docs, known).collect()
        assert all(0 <= r.score <= 1 for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_pipeline_stages(spark):
    """Each stage against what its operator says of the stage's own input."""
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["toxicity", "near_dup", "pii", "mixing", "bpe"]
    docs = common.table(spark, DATA, "documents")
    labels = common.table(spark, DATA, "labels")
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    out = {}
    for name, stage in p.STAGES:
        path = common.scratch(spark, f"t-{name}")
        before = docs
        stage(spark, docs, DATA).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
        if name != "bpe":
            assert docs.dtypes == before.dtypes
        if name == "toxicity":
            assert ids(docs) == ids(toxicity.score_documents(before, labels).filter(f"score < {toxicity.THRESHOLD}"))
        if name == "near_dup":
            assert ids(docs) == sorted({r.class_id for r in near_dup.near_duplicates(before).collect()})
        if name == "pii":
            assert ids(docs) == ids(before)
            left = pii.candidates(docs).filter(F.exists("pii_candidates", lambda s: s["base"])).count()
            assert left == 0 and docs.filter("n_chars <> length(text)").count() == 0
        if name == "mixing":
            want = mixing.copies(before).filter("copies > 0").select("doc_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
            assert ids(docs) == ids(want)
    with open(bpe.default_vocabulary(), "rb") as f:
        b = bpe.WordBpe(f.read())
    texts = {r.doc_id: r.text for r in out["mixing"].collect()}
    for r in out["bpe"].collect():
        assert r.ids == b.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(b.decode(r.ids).encode()).hexdigest()


def test_pipeline_odd_rows(spark):
    import corpus_pipeline as p

    base = common.scratch(spark, "t-odd")
    _, labels = labelled(spark, 40)
    labels.write.parquet(f"{base}/labels.parquet")
    for docs in (odd_documents(spark), no_documents(spark)):
        path = common.scratch(spark, "t-odd-docs")
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        for name, stage in p.STAGES:
            path = common.scratch(spark, f"t-odd-{name}")
            stage(spark, docs, base).write.parquet(path)
            docs = spark.read.parquet(path)
            assert name == "bpe" or docs.columns == [f.split()[0] for f in SCHEMA.split(", ")]


def test_duck_agrees_on_warc(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{DATA}/pages.parquet'")
    want = con.execute(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({warc.ORACLE})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in warc.op5_warc(spark, DATA).collect())
