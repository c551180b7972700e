"""Personal data: base spans against a plain scan, labelers and EM on a fixture, redaction."""

import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from ablatrix.llm import pii

from .helpers import TEXTS, no_documents, odd_documents


def digits(s):
    return re.sub("[^0-9]", "", s)


def luhn(s):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


PLAIN = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
    (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
)


def plain(text):
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(PLAIN) for m in re.finditer(p, text) if ok(m[0]))


def texts():
    rng = random.Random(9)
    pool = ["a.b@c.de", "a@b", "@", "x@y.z.", "_q@r.st", "1.2.3.4", "256.1.1.1", "001.2.3.4", ".5.6.7", "4111 1111 1111 1111", "4111-1111-1111-1112", "4465758382889437", "12345", "0" * 12, "9" * 25, "+1 (743) 555-3824", "+49", "+123456789", " ", "-", "é", "🙂", ", ", "a", "+", "%", "(743) 555-3824", "123-45-6789", "Mr. John Smith", "joe [at] site [dot] com"]
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) for _ in range(1500)] + ["1 " * 30_000 + "a" * 30_000 + "@b" + ".c" * 5000, ""]


def written(spark, rows, name):
    base = f"{spark.conf.get('spark.checkpoint.dir')}/{name}"
    spark.createDataFrame(rows, "doc_id bigint, text string").write.mode("overwrite").parquet(f"{base}/documents.parquet")
    return base


def test_base_spans(spark):
    known = texts()
    base = written(spark, [*enumerate(known), (None, None), (3, known[3])], "pii")
    rows = pii.op3_pii(spark, base).collect()
    assert len(rows) == len(known) + 2
    for r in rows:
        want = plain(known[r.doc_id] if r.doc_id is not None else "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want).encode()).hexdigest()
        assert {f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want} <= set(r.spans.split(",")) | {""}


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a@b.cd")], "doc_id bigint, text string")
    plan = pii.candidates(docs)._jdf.queryExecution().toString() + pii.redact(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_loose_spans_follow_the_evidence(spark):
    good = [f"please call my phone (212) 555-{1000 + i} today" for i in range(60)]
    bad = [f"order part 012.{100 + i}.{1000 + i} of the isbn list" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id bigint, text string")
    rows = {r.doc_id: r.pii for r in pii.detect_pii(docs).collect()}
    assert sum(bool(rows[i]) for i in range(60)) == 60
    assert sum(bool(rows[i]) for i in range(60, 120)) == 0


def test_many_matches_in_one_text(spark):
    """Time grows with the matches, not with their square: 100,000 matches take seconds, and all are found and replaced."""
    rows = [(1, "a@b.cd +1 (743) 555-3824, " * 50_000), (2, "(212) 555-1000 or a@b.cd; " * 2000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    start = time.time()
    found = {r.doc_id: r for r in pii.candidates(docs).select("doc_id", F.size("pii_candidates").alias("n"), F.array_max(F.col("pii_candidates.end")).alias("end")).collect()}
    assert (found[1].n, found[1].end) == (100_000, len(rows[0][1]) - 2) and found[2].n == 4000
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[1] == "[EMAIL] [PHONE], " * 50_000
    assert time.time() - start < 120


def test_loose_spans_keep_clear_of_base_spans(spark):
    """Against every pair: a loose candidate goes if a base one overlaps it."""
    docs = spark.createDataFrame(list(enumerate(texts()[:-2])), "doc_id bigint, text string")
    alone = docs.withColumn("found", F.concat(*[pii._candidates(F.col("text"), k) for k in pii.KINDS]))
    want = F.filter("found", lambda s: s["base"] | ~F.exists("found", lambda b: b["base"] & (b["start"] < s["end"]) & (s["start"] < b["end"])))
    want = alone.select("doc_id", F.array_sort(want).alias("want"))
    both = pii.candidates(docs).join(want, "doc_id")
    assert both.filter(F.exists("want", lambda s: ~s["base"])).count() > 50
    assert both.filter(~F.col("pii_candidates").eqNullSafe(F.col("want"))).count() == 0


def test_em_recovers_reliabilities():
    """Labels drawn from known reliabilities: the classifier ranks patterns as the truth does."""
    rng = random.Random(1)
    counts = {}
    for _ in range(4000):
        y = rng.random() < 0.6
        votes = "".join(rng.choices("+0-", (0.8, 0.1, 0.1) if y == 1 else (0.1, 0.1, 0.8))[0] for _ in pii.LABELERS)
        counts["4" + votes + "bw"] = counts.get("4" + votes + "bw", 0) + 1
    p = pii.accepted_patterns(sorted(counts.items()))
    assert p["4++++bw"] > 0.5 > p["4----bw"]
    assert pii.accepted_patterns([]) == {}


def test_redaction(spark):
    text = "mail a@b.cd and +1 (743) 555-3824 or 4465758382889437 end 🙂 1.2.3.4"
    rows = [(1, text, "k"), (2, None, "k"), (3, "", "k"), (4, "clean text", "k"), (4, "clean text", "k")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, pattern string")
    out = pii.redact(docs)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(1, "mail [EMAIL] and [PHONE] or [CARD] end 🙂 [IP]"), (2, None), (3, ""), (4, "clean text"), (4, "clean text")], key=str)


def test_odd_rows(spark):
    assert pii.detect_pii(odd_documents(spark)).count() == len(TEXTS) + 4
    assert pii.detect_pii(no_documents(spark)).count() == 0
    assert pii.redact(odd_documents(spark)).filter(F.col("text").isNull()).count() == 1
    assert pii.redact(no_documents(spark)).count() == 0
