"""Near-duplicates, neighbours and mixing against brute force."""

import collections
import math
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ablatrix.llm import ann, common, mixing, near_dup

from .helpers import DATA, TEXTS, no_documents, odd_documents

WORDS = [f"w{i}" for i in range(400)]


def near_texts(seed=3):
    """Groups of edited copies, exact copies, documents that share a passage, and loose ones."""
    rng = random.Random(seed)
    words = lambda n: [rng.choice(WORDS) for _ in range(n)]
    texts = []
    for _ in range(25):
        base = words(rng.randint(30, 200))
        texts.append(" ".join(base))
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 8)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            texts.append(" ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    passage = words(80)
    texts += [" ".join(words(30) + passage + words(30)) for _ in range(40)] + [" ".join(words(60)) for _ in range(60)]
    return texts + ["", "", "one two", "one two", "One, two!"]


def brute_classes(docs, idf):
    """Connected components of all pairs whose exact weighted Jaccard similarity reaches the threshold."""
    sets = [dict(zip(u.tolist(), (n * idf(u)).tolist())) for u, n in near_dup.shingle_sets(docs)]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    close = []
    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            shared = sum(min(a[k], b[k]) for k in a.keys() & b.keys())
            total = sum(a.values()) + sum(b.values()) - shared
            s = shared / total if total else float(docs[i] == docs[j])
            close.append((i, j, s))
            if s >= near_dup.SIMILARITY or docs[i] == docs[j]:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(docs))], close


@pytest.mark.parametrize("most", [1 << 19, 2000])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(near_dup, "COMMON", most)
    texts = near_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    counted = collections.Counter(x for u, _ in near_dup.shingle_sets(texts) for x in u.tolist())
    least = max(1, math.ceil(sum(counted.values()) / most))
    assert (least > 1) == (most == 2000)
    idf = near_dup.inverse_document_frequencies(docs)
    u = np.array(sorted(counted), np.uint64)
    df = np.maximum([counted[x] for x in u.tolist()], least)
    assert np.allclose(idf(u), 1 + np.log(len(texts) / df) / math.log(len(texts) / least), atol=1e-6)
    assert len(idf.shingles) == sum(x >= least for x in counted.values()) <= most
    want, close = brute_classes(texts, idf)
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert len(set(want)) < len(texts) - 20


def all_links(sets, weights):
    """Pairs of sets, as positions, whose weighted Jaccard similarity reaches the threshold: each set against all before it, by postings."""
    n, sizes = len(sets), np.array([len(u) for u, _ in sets])
    owner, counts = np.repeat(np.arange(n), sizes), np.concatenate([c for _, c in sets]).astype(float)
    keys, at = np.unique(np.concatenate([u for u, _ in sets]), return_inverse=True)
    order = np.argsort(at, kind="stable")
    starts, ends = np.searchsorted(at[order], np.arange(len(keys) + 1)), np.cumsum(sizes)
    total, weight, links = np.bincount(owner, counts * weights[at], n), weights[at], []
    for j in range(n):
        mine = slice(ends[j] - sizes[j], ends[j])
        posts = [order[starts[k] : starts[k + 1]] for k in at[mine]]
        if posts:
            repeat = [len(p) for p in posts]
            other = np.concatenate(posts)
            shared = np.bincount(owner[other], np.minimum(counts[other], np.repeat(counts[mine], repeat)) * np.repeat(weight[mine], repeat), n)[:j]
            links += [(i, j) for i in np.flatnonzero(shared >= near_dup.SIMILARITY * (total[:j] + total[j] - shared) - 1e-9)]
    return links


def test_near_duplicates_recall_on_tables(spark):
    """Against all pairs of different texts of sf0.1, with the operator's own weights and with none."""
    folder = os.path.join(os.path.dirname(DATA), "sf0.1")
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    docs = common.table(spark, folder, "documents").select("doc_id", "text")
    class_of = {r.doc_id: r.class_id for r in near_dup.near_duplicates(docs).collect()}
    idf, ids = near_dup.inverse_document_frequencies(docs), {r.text or "": r.doc_id for r in docs.collect()}
    sets, ids = list(near_dup.shingle_sets(list(ids))), list(ids.values())
    keys = np.unique(np.concatenate([u for u, _ in sets]))
    for weights, least in ((np.asarray(idf(keys), float), 0.99), (np.ones(len(keys)), 0.95)):
        links = all_links(sets, weights)
        assert len(links) > 50 and sum(class_of[ids[i]] == class_of[ids[j]] for i, j in links) >= least * len(links)


def test_pairs_by_differences_lose_none(spark, monkeypatch):
    """A large group of edited copies without their origin: every similar pair of it that shares a band is found."""
    monkeypatch.setattr(near_dup, "HUBS", 1)
    rng = random.Random(11)
    texts = []
    for g in range(3):
        base = [f"g{g}x{i}" for i in range(120)]
        for _ in range(120):
            copy = list(base)
            for _ in range(rng.randint(1, 4)):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randint(0, 2)] = [rng.choice(WORDS) for _ in range(rng.randint(0, 2))]
            texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want, _ = brute_classes(texts, near_dup.inverse_document_frequencies(docs))
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want


def letters(n, seed=5):
    """Letters of one form: seven fixed parts of 47 words, and between them six slots of three words, each from 50 values."""
    rng = random.Random(seed)
    parts = [" ".join(f"p{i}w{j}" for j in range(47)) for i in range(7)]
    slot = lambda i, v: " ".join(f"s{i}v{v}x{j}" for j in range(3))
    return [" ".join([parts[0], *(x for i in range(6) for x in (slot(i, rng.randrange(50)), parts[i + 1]))]) for _ in range(n)]


def test_letters_of_one_form_are_not_all_compared(spark, monkeypatch):
    """Pairs tested stay below the number of texts, and classes equal brute force's."""
    counted, plain = {}, near_dup._pairs_by_differences

    def counting(*args):
        found = plain(*args)
        counted["pairs"] = found.count()
        return found

    monkeypatch.setattr(near_dup, "_pairs_by_differences", counting)
    for n in (400, 1600):
        texts = letters(n)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
        got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(docs).collect()}
        assert counted["pairs"] <= n
        if n == 400:
            want, _ = brute_classes(texts, near_dup.inverse_document_frequencies(docs))
            assert [got[i] for i in range(n)] == want


def test_requests_meet_whatever_is_shared():
    """Of random units, each two nodes that share what they need meet by a code that one asks for and the other has."""
    rng = random.Random(3)
    for case in range(400):
        pool = [(rng.randint(2, 9), rng.getrandbits(60), rng.choice([0.5, 1.0, 4.0])) for _ in range(rng.choice([6, 12, 40]))]
        x, y = (rng.sample(pool, rng.randint(1, min(len(pool), rng.choice([5, 15, 30])))) for _ in range(2))
        shared = sum(u[2] for u in set(x) & set(y))
        if shared:
            need_x, need_y = (rng.choice([1.0, rng.random(), -1.0]) * shared for _ in range(2))
            (ask_x, has_x), (ask_y, has_y) = near_dup.requests(x, need_x), near_dup.requests(y, need_y)
            if max(need_x, need_y) > 0:
                assert set(ask_x) & set(has_y) or set(ask_y) & set(has_x), case


def test_differences_from_a_hub():
    weights = near_dup.Weights(np.zeros(1 << near_dup.SLOTS, bool), np.zeros(0, np.uint64), np.zeros(0, np.float32), 2.0)
    rng = np.random.default_rng(3)
    draw = lambda: np.unique(rng.integers(0, 40, 30).astype(np.uint64), return_counts=True)
    for _ in range(50):
        x, y, h = draw(), draw(), draw()
        one, other = (dict(zip(k.tolist(), s.tolist())) for k, _, s, *_ in (near_dup.difference(z, h, weights) for z in (x, y)))
        keys, amounts, sizes, wx, wy = near_dup.difference(x, y, weights)
        assert near_dup.moved(y, keys, amounts) == np.repeat(x[0], x[1]).tobytes()
        shared = sum(min(one[k], other[k]) for k in one.keys() & other.keys())
        assert sizes.sum() == pytest.approx(sum(one.values()) + sum(other.values()) - 2 * shared)
        assert near_dup.weighted_jaccard(x, y, weights) == pytest.approx((wx + wy - sizes.sum()) / (wx + wy + sizes.sum()))


@pytest.mark.parametrize("size", [40, 600, 30_000])
def test_samples_estimate_weighted_jaccard(size):
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 63, 7 * size).astype(np.uint64))
    hits, want = [], []
    for _ in range(60 if size > 40 else 300):
        pick = rng.permutation(len(a))
        x, y = np.sort(a[pick[:size]]), np.sort(a[pick[size // 4 : size // 4 + size]])
        w = {k: v for k, v in zip(a.tolist(), rng.gamma(2, 1, len(a)))}
        wx, wy = np.array([w[k] for k in x.tolist()]), np.array([w[k] * 1.3 for k in y.tolist()])
        shared = sum(min(w[k], w[k] * 1.3) for k in set(x.tolist()) & set(y.tolist()))
        want.append(shared / (wx.sum() + wy.sum() - shared))
        hits.append((near_dup.sample(x, wx) == near_dup.sample(y, wy)).mean())
    assert abs(np.mean(hits) - np.mean(want)) < 0.03


def test_word_hashes_against_plain():
    texts = ["Ab cd, é1!x", "", "a" * 300 + " b", "x " * 50 + "z" * 64]
    data = np.frombuffer("\n".join(t.lower() for t in texts).encode() + b"\n", np.uint8)
    starts, h = near_dup.word_hashes(data)
    words = {}
    for s, v in zip(starts, h):
        end = s
        while near_dup.LETTER[data[end]]:
            end += 1
        assert words.setdefault(data[s:end].tobytes(), v) == v
    assert len(set(words.values())) == len(words)
    assert [w for w in words if len(w) > 60]


def test_components_against_union_find(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1200)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in near_dup.components(spark.createDataFrame(edges, "a bigint, b bigint"), common.Workspace(spark, "t")).collect()}
    assert got == {i: find(i) for i in root}


def test_near_duplicate_odd_rows(spark):
    rows = near_dup.near_duplicates(odd_documents(spark)).collect()
    assert len(rows) == len(TEXTS) + 4
    classes = {r.doc_id: r.class_id for r in rows}
    assert classes[0] == classes[1] == 0 and classes[5] == classes[6] == 5 and classes[2] == 2 and classes[3] == 3 and classes[None] is None
    kept = near_dup.drop_near_duplicates(odd_documents(spark))
    assert kept.columns == odd_documents(spark).columns
    assert sorted(x for (x,) in kept.select("doc_id").collect() if x is not None) == sorted(set(v for k, v in classes.items() if v is not None))
    assert kept.filter("doc_id is null").count() == 1
    assert near_dup.near_duplicates(no_documents(spark)).count() == 0
    assert near_dup.drop_near_duplicates(no_documents(spark)).count() == 0


def test_near_duplicates_without_ids_of_their_own(spark):
    """Classes without an id, or with an id that others have too, stay apart."""
    words = lambda i: " ".join(f"x{i}y{j}" for j in range(30))
    rows = [(None, words(0)), (None, words(1)), (None, words(2)), (None, words(2)), (None, words(3)), (9, words(3)), (7, words(4)), (7, words(5)), (7, words(5)), (8, words(5)), (-5, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    classes = {}
    for r in near_dup.near_duplicates(docs).collect():
        classes.setdefault(bytes(r.key), set()).add(r.class_id)
    assert len(classes) == 7 and all(len(c) == 1 for c in classes.values())
    ids = [c for (c,) in classes.values()]
    assert len(set(ids)) == 7 and {None, 9, 7, -5} <= set(ids)
    assert all(c < -5 for c in set(ids) - {None, 9, 7, -5})
    kept = sorted(map(tuple, near_dup.drop_near_duplicates(docs).collect()), key=repr)
    assert kept == sorted([(None, words(0)), (None, words(1)), (None, words(2)), (9, words(3)), (7, words(4)), (7, words(5)), (-5, "")], key=repr)


def vectors(n, seed=1, dims=16):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((n, dims)).astype(np.float32)


def exact(ids, x, q, top=10):
    d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
    order = [i for i in np.lexsort((ids, d)) if ids[i] != ids[q]][:top]
    return [(int(ids[i]), d[i]) for i in order]


def test_neighbours_recall(spark):
    x = vectors(3000)
    ids = np.arange(3000)
    df = spark.createDataFrame([(int(i), v.tolist(), "k") for i, v in zip(ids, x)], "vec_id bigint, embedding array<float>, score string")
    got = collections.defaultdict(list)
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = 0
    for q in range(0, 3000, 100):
        want = exact(ids, x, q)
        assert [r for r, _, _ in got[q]] == list(range(1, 11))
        assert [s for _, _, s in got[q]] == sorted(s for _, _, s in got[q])
        hits += len({v for _, v, _ in got[q]} & {v for v, _ in want})
        for _, v, s in got[q]:
            assert s == pytest.approx(math.dist(x[v].tolist(), x[q].tolist()), abs=1e-12)
    assert hits >= 0.9 * 300


@pytest.mark.parametrize("kind", ["float", "double"])
def test_neighbours_far_from_the_origin(spark, monkeypatch, kind):
    """Small differences around a large common offset, with blocks far smaller than the table, and vectors of other lengths."""
    monkeypatch.setattr(ann, "BLOCK", 64)
    monkeypatch.setattr(ann, "STARTS", 4)
    x = (100 if kind == "float" else 1e7) + 0.01 * vectors(2500, 6, 8).astype(np.float32 if kind == "float" else float)
    short = vectors(300, 7, 3).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(10_000 + i, v.tolist()) for i, v in enumerate(short)]
    got = collections.defaultdict(set)
    for r in ann.nearest(spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>"), every=50).collect():
        got[r.query_id].add(r.vec_id)
    assert set(got) == {*range(0, 2500, 50), *range(10_000, 10_300, 50)}
    for ids, y in ((np.arange(2500), x), (np.arange(10_000, 10_300), short)):
        asked = [q for q in range(len(y)) if not ids[q] % 50]
        assert sum(len(got[ids[q]] & {v for v, _ in exact(ids, y, q)}) for q in asked) >= 0.95 * 10 * len(asked)


def test_neighbours_descend_until_settled(spark, monkeypatch):
    """From two starts of small blocks, a fixed few rounds leave most of the graph wrong."""
    monkeypatch.setattr(ann, "BLOCK", 16)
    monkeypatch.setattr(ann, "STARTS", 2)
    x = vectors(2000, 4, 8)
    space = common.Workspace(spark, "t")
    nodes = ann.nodes_of(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>"), space)
    ids = {r.node: r.ids[0] for r in nodes.select("node", "ids").collect()}
    hits = 0
    for r in ann.build_graph(nodes, space).collect():
        d = ((x - x[ids[r.node]]) ** 2).sum(1)
        hits += len(set(np.argsort(d, kind="stable")[1:11].tolist()) & {ids[i] for i in r.nbrs})
    assert hits >= 0.97 * 20_000


def test_neighbours_search_until_expanded(spark):
    """Along a chain each step reaches one node more."""
    n = 16
    rows = [(i, bytearray(np.array([i, 1], np.float64).tobytes()), [float(i), 1.0]) for i in range(n)]
    nodes = spark.createDataFrame(rows, "node bigint, data binary, vector array<double>")
    graph = spark.createDataFrame([(i, [i + 1], [1.0]) for i in range(n - 1)], "node bigint, nbrs array<bigint>, dists array<double>")
    queries = nodes.filter("node = 0").select(F.col("node").alias("q"), "data")
    assert sorted(ann.search(queries, nodes, graph, common.Workspace(spark, "t")).first().found) == list(range(1, n))


def test_neighbours_effort_grows():
    small, large = ann.Effort(ann.BASE), ann.Effort(4 * ann.BASE)
    assert (small.k, small.beam) == (ann.K, ann.BEAM) == (ann.Effort(2).k, ann.Effort(2).beam)
    assert large.k > small.k and large.beam == 2 * small.beam


def test_neighbours_effort_grows_slowly():
    """Lists and the beam grew with roots of the table; at sixteen times as many nodes a meeting cost four times as much, the beam was fourfold."""
    large = ann.Effort(16 * ann.BASE)
    assert large.k <= 1.5 * ann.K and large.degree <= 1.5 * ann.DEGREE and large.beam <= 3 * ann.BEAM and large.expand <= 3 * ann.EXPAND


def test_vectors_go_to_a_bucket_once():
    """However many nodes of a bucket a vector is sent to; a node that all others list went out once for each of them."""
    x = vectors(50, 8, 4)
    rng = np.random.default_rng(9)
    to, who = np.concatenate([np.arange(700), rng.integers(0, 700, 300)]), np.concatenate([np.zeros(700, int), rng.integers(0, 50, 300)])
    sent = ann._letters(to, who, 16 << 32, 7, {"member": np.arange(50), "data": x}, {"at": to})
    assert sorted(sent.column("key").to_pylist()) == [(16 << 32) + b for b in range(7)]
    members, at = ann._flat(sent, "member", np.int64), ann._flat(sent, "at", np.int64)
    assert len(members) == len({(t % 7, w) for t, w in zip(to.tolist(), who.tolist())}) and (members == 0).sum() == 7
    place = ann._places(sent, "member", 8)
    assert sorted(zip(at.tolist(), members[place].tolist())) == sorted(zip(to.tolist(), who.tolist()))
    assert (ann._flat(sent, "data", x.dtype, 4)[place] == x[members[place]]).all()


def test_neighbours_of_one_large_cluster(spark, monkeypatch):
    """Many small buckets, and a cluster of so many blocks' size that it is dealt out."""
    monkeypatch.setattr(ann, "BLOCK", 32)
    monkeypatch.setattr(ann, "ROWS", 100)
    x = np.concatenate([vectors(600, 10, 6), 5 + 1e-3 * vectors(900, 11, 6)]).astype(np.float32)
    got = collections.defaultdict(list)
    for r in ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>"), every=25).collect():
        got[r.query_id].append(r.vec_id)
    assert all(len(v) == len(set(v)) == 10 for v in got.values()) and len(got) == 60
    assert sum(len(set(got[q]) & {v for v, _ in exact(np.arange(1500), x, q)}) for q in got) >= 0.95 * 600


def test_neighbours_odd_rows(spark):
    x = vectors(60, 2, 4).tolist()
    rows = [(i, v) for i, v in enumerate(x)] + [(100, x[3]), (200, x[3]), *[(1000 + i, x[3]) for i in range(40)], (300, None), (400, [0.0] * 4), (500, [float("nan"), 1.0, 1.0, 1.0]), (600, [None, 1.0, 1.0, 1.0])]
    rows += [(700, [1.0, 2.0]), (None, x[0]), (100, x[3]), (800, [float("inf"), 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = collections.defaultdict(list)
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == {0, 100, 200, 1000}
    assert got[100] == [(3, 0.0), (200, 0.0), *[(1000 + i, 0.0) for i in range(8)]]
    assert got[1000] == [(3, 0.0), (100, 0.0), (200, 0.0), *[(1001 + i, 0.0) for i in range(7)]]
    assert len(got[0]) == 10
    one = spark.createDataFrame([(0, [1.0, 2.0])], "vec_id bigint, embedding array<float>")
    assert ann.nearest(one).count() == 0 and ann.nearest(one.limit(0)).count() == 0
    two = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 3.0])], "vec_id bigint, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(two).collect()] == [(0, 1, 1, 1.0)]


def duck(documents, sql):
    con = duckdb.connect()
    con.register("documents", documents.toPandas().astype({"doc_id": "Int64"}))
    return con.execute(sql).fetchall()


@pytest.mark.parametrize("plan", [mixing.PRODUCTION, mixing.MixPlan(seed=3, budget=500, max_epochs=1), mixing.MixPlan(share=5000, max_epochs=3, sources={"s1": 5}), mixing.MixPlan(budget=0), mixing.MixPlan(share=900, digits=1), mixing.MixPlan(budget=900, sources={"s0": 0}, langs={"de": 0, "en": 2}, domains={"d1": 0}), mixing.MixPlan(share=500, source_domains={"s0": "d3", "s9": "web"}), mixing.MixPlan(sources={x: 0 for x in ("s0", "s1", "s2", "s9", "")})])
def test_mixing_against_sql(spark, monkeypatch, plan):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 3, 10, 200])), rng.choice(["en", "de", None, "xx"]), rng.choice(["s0", "s0", "s0", "s1", "s2", None, "s9"])) for i in range(700)]
    rows += [rows[3], rows[3], (None, "a b", "en", "s0"), (None, None, "en", "s0")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    monkeypatch.setattr(mixing, "RANGE_ROWS", 1)  # ranges are made as fine as they get
    got = mixing.copies(docs, plan).select("copies", "doc_id", "domain", "lang", "n_tokens", "source").collect()
    want = duck(docs, f"SELECT copies, doc_id, domain, lang, n_tokens, source FROM ({mixing.oracle(plan)})")
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert mixing.mix(docs, plan).count() == sum(r[0] for r in want)


def test_shortages_go_to_siblings_first(spark):
    """Source s1 is short: its siblings in the language take what is missing, other languages keep their shares."""
    rows = [(i, "w " * 10, lang, source) for i, (lang, source) in enumerate([("en", "s1")] * 2 + [("en", "s5")] * 50 + [("de", "s5")] * 50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    plan = mixing.MixPlan(budget=400, max_epochs=1, domains={}, langs={})
    tagged = mixing._tagged(docs, plan).withColumn("domain", F.lit("d"))
    got = {(r.lang, r.source): r.share for r in mixing.leaf_budgets(tagged, plan).collect()}
    assert got == {("en", "s1"): 20, ("en", "s5"): 180, ("de", "s5"): 200}


def test_mixing_odd_rows(spark):
    with pytest.raises(ValueError):
        mixing.MixPlan(langs={"en": -1})
    assert mixing.copies(odd_documents(spark)).count() == len(TEXTS) + 4
    assert mixing.mix(odd_documents(spark)).columns == odd_documents(spark).columns
    assert mixing.copies(no_documents(spark)).count() == 0 and mixing.mix(no_documents(spark)).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_mixing_on_the_tables(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = con.execute(f"SELECT doc_id, copies FROM ({mixing.oracle()})").fetchall()
    assert sorted(map(tuple, mixing.op10_mixing(spark, DATA).select("doc_id", "copies").collect())) == sorted(want)
