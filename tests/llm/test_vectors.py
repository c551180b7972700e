"""Vector codes, clusters and near-duplicates of vectors against brute force and SQL."""

import collections
import hashlib
import math
import os

import duckdb
import numpy as np
import pytest

from ablatrix.llm import clusters, registry, vector_codes, vector_dups, vectors
from ablatrix.llm.common import Workspace

from .helpers import DATA

#: Every name that the operators use inside, as further columns of the input.
CLASHES = ("size", "data", "key", "n", "node", "code", "error", "cluster", "distance", "turn", "rows", "_key")
NAN, INF = float("nan"), float("inf")


def frame(spark, rows, kind="float"):
    """rows: vec_id, embedding, label."""
    extra = ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame([(i, x, label, *"abcdefghijkl") for i, x, label in rows], f"vec_id bigint, embedding array<{kind}>, label int, {extra}")


def unit(rng, n, size):
    x = rng.standard_normal((n, size))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def odd(size, rng):
    """Copies, ties, repeated rows, equal and null ids, and vectors that take no part."""
    x = unit(rng, 40, size).tolist()
    rows = [(i, v, i % 3 if i % 5 else None) for i, v in enumerate(x)]
    rows += [rows[3], rows[3], (3, x[7], 1), (None, x[8], 2), (None, x[9], None), (500, x[3], 0), (501, [-v for v in x[3]], 0), (502, [0.0] * size, 1)]
    return rows + [(600, None, 1), (601, [None, *x[0][1:]], 1), (602, [NAN, *x[0][1:]], None), (603, [-INF, *x[0][1:]], 2)]


def whole(rows):
    return [(i, x, label) for i, x, label in rows if x is not None and all(v is not None and math.isfinite(v) for v in x)]


def ints(x):
    return [math.floor(1024 * v) for v in x]


def far(x, y):
    return sum((a - b) ** 2 for a, b in zip(x, y))


def brute_codes(rows, parts=4, entries=256, rounds=4, kind=np.float32):
    kept = [(i, ints(kind(x).tolist()), label) for i, x, label in whole(rows)]
    out, errors = [], collections.Counter()
    for size in sorted({len(x) for _, x, _ in kept}):
        own = [r for r in kept if len(r[1]) == size]
        cuts = [size * i // parts for i in range(parts + 1)]
        start = sorted(own, key=lambda r: (r[0] is None, r[0] or 0, kind([v / 1024 for v in r[1]]).tobytes()))[:entries]
        books = [[r[1][a:b] for r in start] for a, b in zip(cuts, cuts[1:])]
        nearest = lambda p, v: min((far(v, e), k) for k, e in enumerate(books[p]))
        for _ in range(rounds):
            held = collections.defaultdict(list)
            for _, x, _ in own:
                for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    held[p, nearest(p, x[a:b])[1]].append(x[a:b])
            for (p, k), members in held.items():
                books[p][k] = [sum(c) // len(members) for c in zip(*members)]
        digest = hashlib.sha256(",".join(str(v) for part in books for e in part for v in e).encode()).hexdigest()
        for i, x, label in own:
            best = [nearest(p, x[a:b]) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            error = sum(d for d, _ in best)
            errors[label] += error
            out.append((i, label, "".join(f"{k:02x}" for _, k in best), error, digest))
    fits = lambda v: v if v < 1 << 63 else None
    return sorted(((i, code, fits(error), fits(errors[label]), digest) for i, label, code, error, digest in out), key=repr)


def test_codes_against_plain_loops(spark):
    rng = np.random.default_rng(1)
    rows = odd(10, rng) + [(900 + i, v, 4) for i, v in enumerate(unit(rng, 6, 3).tolist())] + [(950, [], 5), (951, [], None)]
    # components on the grid, so that bytes order as the integers' fractions do
    rows = [(i, None if x is None else [v if v is None or not math.isfinite(v) else math.floor(v * 1024) / 1024 for v in x], label) for i, x, label in rows]
    got = sorted((tuple(r) for r in vector_codes.compressed(frame(spark, rows)).collect()), key=repr)
    assert got == brute_codes(rows)
    assert vector_codes.compressed(frame(spark, [])).count() == 0
    assert vector_codes.compressed(frame(spark, [(1, None, 1)])).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_codes_of_large_components(spark):
    """Beyond what double precision holds exactly; an error that no long holds is null."""
    rows = [(i, [v * 1e30, 1.0, -v * 1e30, 0.5], 1) for i, v in enumerate(range(300))] + [(i, [float(2**40 + i), 0.0, 0.0, 0.0], 2) for i in range(300, 310)]
    rows += [(i, [1e30 * (i % 7), 1.0, 0.0, 0.5], 3) for i in range(400, 420)]
    got = sorted((tuple(r) for r in vector_codes.compressed(frame(spark, rows, "double")).collect()), key=repr)
    assert got == brute_codes(rows, kind=np.float64) and any(r[2] is None for r in got) and any(r[2] is not None for r in got)


@pytest.mark.parametrize("scale", [300, 1 << 40])
def test_cells_bound_distances(scale):
    rng = np.random.default_rng(2)
    x, e = (vectors.exact(rng.integers(-scale, scale, (n, 7)).tolist(), 7) for n in (50, 90))
    e[5] = e[3]
    cells = vector_codes.Cells(e)
    least, most = cells.bounds(x)
    d = vectors.squared(x, e)
    assert (least <= d).all() and (d <= most).all() and (least > most.min(axis=1)[:, None]).mean() > 0.5
    entry, best = cells.nearest(x)
    assert entry.tolist() == d.argmin(axis=1).tolist() and best.tolist() == d.min(axis=1).tolist()


def test_codes_round_trip():
    x = np.random.default_rng(3).integers(-500, 500, (200, 12)).astype(float)
    books = vector_codes.Codebooks.of(x[:100])
    codes, errors = books.codes(x, books.cells())
    for row, code, error in zip(x.tolist(), codes, errors):
        assert far(row, books.decode(bytes(code.astype(np.uint8)).hex())) == error.sum()
    assert not errors[:100].any()


def brute_clusters(rows, k=8, rounds=10, size=64, kind=np.float32):
    kept = [(i, ints(kind(x).tolist())) for i, x, _ in whole(rows) if len(x) == size]
    turn = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", kind([v / 1024 for v in r[1]]).tobytes())
    centroids = [x for _, x in sorted(kept, key=turn)[:k]]
    nearest = lambda x: min((far(x, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        held = collections.defaultdict(list)
        for _, x in kept:
            held[nearest(x)[1]].append(x)
        centroids = [[sum(c) // len(held[j]) for c in zip(*held[j])] if j in held else old for j, old in enumerate(centroids)]
    best = [(i, *nearest(x)) for i, x in kept]
    sums = collections.Counter()
    for _, d, j in best:
        sums[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    fits = lambda v: v if v < 1 << 63 else None
    return sorted(((i, j, fits(d), fits(sums[j]), fits(sum(sums.values())), digest[j]) for i, d, j in best), key=repr)


def on_grid(rows):
    return [(i, None if x is None else [v if v is None or not math.isfinite(v) else math.floor(v * 1024) / 1024 for v in x], label) for i, x, label in rows]


def test_clusters_against_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK", 60)
    monkeypatch.setattr(clusters, "LEAF", 4)
    rng = np.random.default_rng(4)
    tight = [(1000 + i, (unit(rng, 1, 64)[0] * 0.01 + (i % 4)).tolist(), None) for i in range(200)]
    rows = on_grid(odd(64, rng) + tight + [(2000, [1.0] * 63, 1), (2001, [1.0] * 65, 1), (2002, [], 1)])
    got = sorted((tuple(r) for r in clusters.clustered(frame(spark, rows)).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)
    assert got == brute_clusters(rows)
    few = on_grid(odd(64, rng))[:3]
    got = sorted((tuple(r) for r in clusters.clustered(frame(spark, few)).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)
    assert got == brute_clusters(few)
    assert clusters.clustered(frame(spark, [(1, [1.0], 1)])).count() == 0 and clusters.clustered(frame(spark, [])).count() == 0


def test_clusters_of_large_components(spark):
    rows = [(i, [float(i % 7) * 1e25, *[0.0] * 63], 1) for i in range(60)]
    got = clusters.clustered(frame(spark, rows, "double")).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_clusters(rows, kind=np.float64)


def test_balls_are_assigned_whole_and_right():
    rng = np.random.default_rng(5)
    x = np.floor(rng.standard_normal((3000, 8)) * 40 + 1000 * rng.integers(0, 5, (3000, 1)))
    tree, order = clusters.Tree.grow(x)
    x = x[order]
    c = x[rng.permutation(3000)[:5]]
    balls, rows = tree.assign(c)
    best, seen = vectors.squared(x, c).argmin(axis=1), np.zeros(3000, int)
    for node, j in balls:
        at = slice(tree.low[node], tree.high[node])
        seen[at] += 1
        assert (best[at] == j).all() and (tree.sums[node] == x[at].sum(axis=0)).all()
    seen[rows] += 1
    assert (seen == 1).all() and len(balls) > 0 and len(rows) < 2000


def brute_links(rows, similarity=0.95):
    good = [k for k, r in enumerate(rows) if whole([r]) and any(r[1])]
    single = {k: np.array(rows[k][1], np.float32).astype(float) for k in good}
    unit_ = {k: x / np.linalg.norm(x) for k, x in single.items()}
    links = {k: [j for j in good if j != k and len(unit_[j]) == len(unit_[k]) and unit_[j] @ unit_[k] >= similarity] for k in good}
    out = []
    for k, (i, _, _) in enumerate(rows):
        seen, front = {k}, [k]
        while front:
            new = [j for j in links.get(front.pop(), []) if j not in seen]
            seen.update(new)
            front += new
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((i, len(links.get(k, [])), least, i == least))
    return sorted(out, key=repr)


def near(rng, size, groups=12):
    """Groups of near copies, tight and loose, one of them large; chains of links; copies; and loose vectors."""
    rows = []
    for g in range(groups):
        base = unit(rng, 1, size)[0]
        for _ in range(70 if g == 0 else 6):
            rows.append(base + rng.standard_normal(size) * rng.choice([0.01, 0.15, 0.25]) / math.sqrt(size))
    x, step = unit(rng, 2, size), 0.2
    rows += [x[0] * math.cos(step * i) + x[1] * math.sin(step * i) for i in range(20)]
    rows += list(unit(rng, 150, size))
    return [(i, np.float32(v).tolist(), 0) for i, v in enumerate(rows)]


@pytest.mark.parametrize("bucket, big, size", [(128, 2048, 64), (16, 16, 64), (1 << 40, 40, 5), (32, 64, 600)])
def test_vector_dups_against_all_pairs(spark, monkeypatch, bucket, big, size):
    monkeypatch.setattr(vector_dups, "BUCKET", bucket)
    monkeypatch.setattr(vector_dups, "BIG", big)
    monkeypatch.setattr(vector_dups, "WIDE", min(big, 256))
    rng = np.random.default_rng(6)
    rows = near(rng, size) + [(i if i is None else 5000 + i, x, label) for i, x, label in odd(size, rng)] + [(7000, [1.0], 1), (7001, [2.0], 1), (7002, [], 1), (7003, [1e-44] + [0.0] * (size - 1), 1)]
    rows = [(i, x, label) for i, x, label in rows if i != 7003 or size > 1]
    got = sorted((tuple(r) for r in vector_dups.linked(frame(spark, rows)).select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)
    assert got == brute_links(rows)


def test_large_groups_make_no_rows_per_pair(spark):
    """Of a group of different vectors that are all linked, rows grow with its size, not with its square."""
    made = {}
    for n in (600, 2400):
        rng = np.random.default_rng(9)
        x = unit(rng, 1, 64)[0] + rng.standard_normal((n, 64)) * 0.05 / 8
        nodes = spark.createDataFrame([(i, 1, 64, bytearray(np.float32(v).tobytes())) for i, v in enumerate(x)], "node bigint, n bigint, size int, data binary")
        plan = vector_dups.Plan(n)
        space = Workspace(spark, "t")
        found = vector_dups.candidates(vector_dups.codes(nodes, plan, "f4"), nodes, plan, "f4", space).collect()
        degree = collections.Counter()
        for r in found:
            degree.update({r.a: 1, r.b: 1} if r.what == 0 else {r.a: r.n} if r.what == 1 else {})
        assert set(degree.values()) == {n - 1}
        made[n] = len(found)
    assert made[2400] < 8 * made[600] and made[2400] < 2400 * 2399 / 2 / 10


def test_vector_dups_of_extreme_lengths(spark):
    x = unit(np.random.default_rng(7), 1, 16)[0].astype(float)
    rows = [(i, (x * s).tolist(), 1) for i, s in enumerate([1e300, 1e-300, 1.0, -1.0])]
    got = {r.vec_id: r.n_links for r in vector_dups.linked(frame(spark, rows, "double")).collect()}
    assert got == {0: 2, 1: 2, 2: 2, 3: 0}
    assert vector_dups.linked(frame(spark, [])).count() == 0
    none = vector_dups.linked(frame(spark, [(4, None, 1), (None, [0.0], 1)])).collect()
    assert sorted((tuple(r) for r in none), key=repr) == [(4, 0, 4, True), (None, 0, None, True)]


@pytest.mark.parametrize("size", [64, 100, 700])
def test_estimates_are_unbiased_and_bounds_hold(size):
    rng = np.random.default_rng(8)
    base = unit(rng, 400, size).astype(float)
    other = base + rng.standard_normal((400, size)) * 0.3 / math.sqrt(size)
    plan = vector_dups.Plan(1000)
    blobs = [vector_dups.encoded(x / np.linalg.norm(x, axis=1, keepdims=True))[1] for x in (base, other)]
    a, b = (vector_dups.Bucket([r.tobytes() for r in x], size) for x in blobs)
    true = base @ (other / np.linalg.norm(other, axis=1, keepdims=True)).T
    found, _ = a.estimates(b)
    assert abs((found - true).mean()) < 0.01 and np.abs(found - true).mean() < 2 / math.sqrt(a.n)
    linked = true >= plan.similarity
    assert linked.sum() > 300 and a.likely(b, plan)[linked].all() and b.likely(a, plan).T[linked].all()
    assert (a.likely(b, plan) & ~linked).mean() < 0.01


def test_bands_grow_with_the_table():
    plans = [vector_dups.Plan(n) for n in (1, 10**5, 10**7, 10**9)]
    assert [p.bits for p in plans] == sorted(p.bits for p in plans) and plans[0].bands == 1 < plans[1].bands < plans[3].bands < 140
    for p in plans[1:]:
        met = (1 - math.acos(p.similarity) / math.pi) ** p.bits
        assert (1 - met) ** p.bands <= vector_dups.MISS


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_clusters", "op13_vector_dups"])
def test_vector_queries_match_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    want = con.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    got = registry.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, want.fetchall()))
