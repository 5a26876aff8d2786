"""Centroid clustering, the filter audit and line deduplication against brute force."""

import hashlib
import random
from fractions import Fraction
from itertools import permutations
from math import inf, nan

import duckdb
import numpy as np
import pytest

pytest.importorskip("lectern.llm")

from pyspark.sql import functions as F

from lectern.llm import op11_centroid_clustering as o11
from lectern.llm import op12_filter_audit as o12
from lectern.llm import op13_line_dedup as o13
from lectern.llm.queries import ORACLES, QUERIES

CLASH = ["id", "x", "lower", "cluster", "distance", "h", "part", "mask", "c", "key", "n", "good", "low", "k", "k2", "refs", "first", "drop"]


@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op12_filter_audit", "op13_line_dedup"])
def test_queries_match_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    a, b = QUERIES[name](spark, sf).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(a.columns) == sorted(b.columns) and len(a)
    rows = lambda d: sorted(tuple(str(v) for v in r) for r in d[sorted(a.columns)].itertuples(index=False))
    assert rows(a) == rows(b)


# ---- clustering


def brute_clusters(rows, k, rounds):
    vs = [(i, [int(np.floor(256.0 * c)) for c in v]) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and np.isfinite(c) for c in v)]
    order = sorted((i is None, hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "", np.array(v, "<i4").tobytes(), v) for i, v in vs)
    centres = [list(o[3]) for o in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, v in vs:
            groups.setdefault(near(v)[1], []).append(v)
        for j, g in groups.items():
            centres[j] = [sum(c) // len(g) for c in zip(*g)]
    return sorted(((i, *near(v)[::-1]) for i, v in vs), key=str), centres


def test_clusters_match_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), (rng.normal(size=64) * 0.1 + (i % 5)).tolist()) for i in range(160)]
    rows += [(300 + j, rows[j][1]) for j in range(20)] + [rows[3], rows[3], (3, rows[4][1])]  # ties and repeated ids
    rows += [(None, rows[9][1]), (400, None), (401, []), (402, [1.0] * 63), (403, [nan] * 64), (404, [inf] + [0.0] * 63), (405, [None] + [0.0] * 63), (406, [0.0] * 65)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in CLASH}).repartition(3)
    for k, rounds in ((12, 5), (1, 2), (300, 1)):
        got, centres, sums = o11.cluster_vectors(frame, k=k, rounds=rounds)
        want, want_centres = brute_clusters(rows, k, rounds)
        assert sorted(((r.id, r.cluster, r.distance) for r in got.collect()), key=str) == want
        assert centres.tolist() == want_centres
        assert sum(int(r.inertia) for r in sums) == sum(d for _, _, d in want)


def test_no_vectors_and_huge_ones(spark, tmp_path):
    none = spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<double>")
    assert o11.cluster_vectors(none)[0].count() == 0
    huge = spark.createDataFrame([(1, [1e300] * 64), (2, [-1e300] * 64), (3, [0.0] * 64)], "vec_id long, embedding array<double>")
    got = {r.id: (r.cluster, r.distance) for r in o11.cluster_vectors(huge, k=1, rounds=0)[0].collect()}
    assert max(d for _, d in got.values()) <= 64 * (2 * o11.LARGEST) ** 2 < 2**63
    none.write.parquet(str(tmp_path / "embeddings.parquet"))
    assert o11.op11_centroid_clustering(spark, str(tmp_path)).count() == 0


def test_points_of_a_sphere_come_no_nearer_than_the_bound():
    rng = np.random.default_rng(1)
    saved = 0
    for _ in range(400):
        centre, old, new = (rng.normal(size=3) * s for s in (3, 3, 3))
        new = old + rng.normal(size=3) * rng.choice([0.1, 1.0])
        radius = abs(rng.normal()) * 2
        bound, drift = o11.coming_nearer(centre, radius, old, new), np.linalg.norm(new - old)
        d = rng.normal(size=(500, 3))
        points = centre + radius * (d / np.linalg.norm(d, axis=1)[:, None]) * rng.random((500, 1)) ** 0.2
        nearer = np.linalg.norm(points - old, axis=1) - np.linalg.norm(points - new, axis=1)
        assert nearer.max() <= bound + 1e-9 <= drift + 2e-9
        saved += bound < 0.7 * drift
    assert saved > 100


def test_tightened_bounds_spare_scans(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), (rng.normal(size=64) * 0.05 + 3 * np.eye(64)[i % 8]).tolist()) for i in range(400)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    state = o11.cluster_vectors(frame, k=20)[0]
    assert state.agg(F.sum("scans")).first()[0] < 6 * 400 * 0.9
    x = np.array([v for _, v in rows])
    old, new = x[:20], x[:20] + rng.normal(size=(20, 64)) * 0.2
    drift = np.linalg.norm(new - old, axis=1)
    assert (o11.loosening(old, new, np.full(20, 0.3)) < drift.max()).mean() > 0.8


# ---- audit


def brute_audit(docs, labels):
    good, toxic, lowest = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}, {}
    for i, t, _ in docs:
        if i is not None:
            lowest[t or ""] = min(i, lowest.get(t or "", i))
    rows = []
    for i, t, lang in docs:
        t = t or ""
        w = t.encode().split()
        fails = "A" * (len(w) < 100) + "B" * (100 * len(set(w)) < 80 * len(w)) + "C" * (100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t)) + "D" * any(c in "#$%&*|" for c in t)
        fails += "E" * (i is not None and lowest[t] < i)
        rows.append((lang or "", fails, i in good and i is not None, i in toxic and i is not None))
    out = {}
    for part in {r[0] for r in rows}:
        mine, total = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                total[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in r[1] for r in mine) - len(gone), sum(r[1] == f for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(total[f])
    return out


def test_audit_matches_every_order_run_by_hand(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["Word", "x", "yy", "é", "LOUD", "a#b"]) + str(rng.randrange(400)) * rng.randrange(2) for _ in range(rng.choice([3, 99, 100, 160]))) for _ in range(40)]
    docs = [(rng.randrange(60), rng.choice(texts), rng.choice(["en", "de", None, ""])) for _ in range(250)]
    docs += [(None, texts[0], "en"), (None, texts[0], "en"), (None, None, None), (5, None, "en"), (6, "", "en"), (7, "a b", "fr"), (900, "long words " * 30_000, "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 60, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({c: F.lit("clash") for c in CLASH}).repartition(4)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): list(r[3:]) for r in o12.filter_audit(d, lab).collect()}
    assert got == brute_audit(docs, labels)
    assert o12.filter_audit(d.limit(0), lab).count() == 0
    assert len(got) == 600 * len({lang or "" for _, _, lang in docs})


def test_least_squares_gives_shapley_values_of_any_game():
    rng = random.Random(3)
    for n in (2, 3, 5):
        game = [0] + [rng.randrange(1000) for _ in range(2**n - 1)]
        want = [Fraction(0)] * n
        orders = list(permutations(range(n)))
        for order in orders:
            s = 0
            for k in order:
                want[k] += Fraction(game[s | 1 << k] - game[s], len(orders))
                s |= 1 << k
        assert o12.shapley(game, n) == want


# ---- lines


def brute_lines(rows):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").encode().lower()
    low, out = {}, []
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(line.strip(" \t\n\x0b\x0c\r")) >= 10:
                low[key(line)] = min(i, low.get(key(line), i))
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or low.get(key(x), i) >= i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def lined():
    rng = random.Random(6)
    pool = [f"line number {k} of the pool" for k in range(120)] + ["Ümläut zeile", "ümläut zeile", " ten chars", "ABCDEFGHIJ", "abcdefghij ", "abcdefghi"]
    rows = [(rng.randrange(500), "\n".join(rng.choice(pool) if rng.random() < 0.5 else f"own {rng.random()}" for _ in range(rng.randrange(8)))) for _ in range(150)]
    rows += [(None, pool[0]), (None, None), (7, None), (8, ""), (9, "\n\n"), (10, f"\t{pool[1].upper()}\r\n{pool[1]}"), (10, pool[1]), (600, "\n".join(["the same line twice", "the same line twice"]))]
    rows += [(1000 + k, f"a very common line\nrest {k} of it all") for k in range(200)] + [(2000, "\n".join(f"long text line {k % 5000}" for k in range(20_000)))]
    return rows


def shown(out):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in out.collect()), key=str)


@pytest.mark.parametrize("batches", [1, 2, 4])
def test_lines_match_brute_force(spark, lined, batches, monkeypatch):
    monkeypatch.setattr(o13, "BUCKETS", 64)
    monkeypatch.setattr(o13, "SHARD_KEYS", 100)
    monkeypatch.setattr(o13, "HEAVY", 50)
    docs = spark.createDataFrame(lined, "doc_id long, text string").withColumns({c: F.lit("clash") for c in CLASH}).repartition(3)
    assert shown(o13.line_dedup(docs, batches)) == brute_lines(lined)
    assert shown(o13.line_dedup(docs.limit(0), batches)) == []


def test_deletions_undo_insertions(spark, lined):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    rows = [r for r in lined if r[0] is not None]
    first, second = [r for r in rows if r[0] % 3 == 0], [r for r in rows if r[0] % 3]
    index = o13.LineIndex(spark)
    index.insert(frame(second))
    before = {tuple(r) for r in index.shared().collect()}
    alone = {r.shard: r.filter for r in index.filters.collect()}
    index.insert(frame(first))  # smaller and larger ids than those that are there
    assert shown(index.dedup(frame(rows))) == brute_lines(rows)
    index.delete(frame(first).select("doc_id").union(spark.createDataFrame([(99999,), (None,)], "doc_id long")))
    assert {tuple(r) for r in index.shared().collect()} == before
    assert shown(index.dedup(frame(second))) == brute_lines(second)
    count = lambda filters: sum(np.count_nonzero(np.frombuffer(f, "<u2")) for f in filters)
    assert index.keys == count(r.filter for r in index.filters.collect()) and (index.shards != len(alone) or count(alone.values()) == index.keys)
    index.insert(frame(first))
    assert shown(index.dedup(frame(rows))) == brute_lines(rows)
    index.delete(frame(rows).select("doc_id"))
    assert index.keys == 0 and index.shared().count() == 0 and not any(any(r.filter) for r in index.filters.collect())


def test_a_later_call_goes_on_from_an_index(spark, lined):
    rows = [r for r in lined if r[0] is not None]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    old, new = [r for r in rows if r[0] < 300], [r for r in rows if r[0] >= 300]
    index = o13.LineIndex(spark)
    o13.line_dedup(frame(old), index=index)
    want = [r for r in brute_lines(rows) if int(r[0]) >= 300]
    assert shown(o13.line_dedup(frame(new), index=index)) == want


def test_cuckoo_filter_holds_what_was_added_and_forgets_what_was_removed():
    rng = np.random.default_rng(5)
    keys = rng.integers(-(2**63), 2**63 - 1, o13.SHARD_KEYS * 11 // 10)
    f = o13.CuckooFilter()
    f.add(keys)
    assert f.may_hold(keys).all() and np.count_nonzero(f.table) == len(keys)
    others = rng.integers(-(2**63), 2**63 - 1, 100_000)
    assert f.may_hold(others).mean() < 0.002
    again = o13.CuckooFilter(f.stored())
    again.add(keys[:3])
    again.add(keys[:3])  # a multiset: removed once, still there
    again.remove(np.concatenate([keys[1000:], keys[:3], keys[:3]]))
    assert again.may_hold(keys[:1000]).all() and again.may_hold(keys[1000:]).mean() < 0.002
    again.remove(keys[:1000])
    assert not again.table.any()
    with pytest.raises(KeyError):
        again.remove(keys[:1])
