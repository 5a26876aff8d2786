"""Search fallbacks and routing, the quantised index and the pivot join against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import retrieval as V
from lectern.operators import vectors as I
from lectern.plans import registry

registry.load()


def unit(x):
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_patterns_of_section_names(spark):
    names = [
        (1, ["##  2.1   Linear  maps and their many kernels, images", "A (b)"]),
        (2, ["# x", " ", None, "xy", "XY"]),
        (3, ["(a) of *many* parts, a name of 33 c. and on it goes"]),
        (4, ["3.4 ab"]),
        (5, []),
    ]
    got = {r.i: r.p for r in spark.createDataFrame(names, "i int, s array<string>").select("i", V.section_patterns("s").alias("p")).collect()}
    assert got[1] == ["2\\.1 linear maps and their many kernels,", "2\\.1 linear maps and their", "a \\(b\\)"]
    assert got[2] == ["xy"] and got[4] == ["3\\.4 ab"] and got[5] == []
    assert got[3] == ["\\(a\\) of \\*many\\* parts, a name of 33 c\\"]


def test_every_path_of_a_question_is_taken(spark, sf):
    paths = {r.path for r in registry.QUERIES["v7_retrieve_context"](spark, sf).select("path").distinct().collect()}
    assert paths == {"section", "vector", "first of topic", "first of plan"}


CHUNKS = "chunk_id long, plan_id long, chunk_index long, content string, section string, topic string, embedding array<double>"


def test_fallbacks_one_by_one(spark):
    rows = [(k, 1, 9 - k, f"text {k % 7}" if k else "", "s", "t" if k % 2 else None, [1.0, k / 10] if k != 3 else None) for k in range(10)]
    rows += [(20, 2, 0, "x" * 3000, None, None, None), (21, 2, 1, None, "Z.1", "t", [0.0, 0.0])]
    chunks = spark.createDataFrame(rows, CHUNKS)
    asked = spark.createDataFrame(
        [(1, 1, [1.0, 0.0], []), (2, 1, None, []), (3, 1, [1.0, 0.0], ["t"]), (4, 1, [1.0, 0.0], ["no"]), (5, 2, [1.0, 0.0], []), (6, 2, None, ["t"]), (7, 3, [1.0, 0.0], None)],
        "query_id int, plan_id long, vector array<double>, topics array<string>",
    )
    hits = {}
    for r in V.vector_search_by_topic(asked, chunks, 3).orderBy("rank").collect():
        hits.setdefault(r.query_id, []).append((r.chunk_id, r.path))
    assert hits[1] == [(1, "vector"), (2, "vector"), (4, "vector")]  # the empty text goes, the one without a vector is not near
    assert hits[2] == [(9, "first of plan"), (8, "first of plan"), (7, "first of plan")]  # in the order of the document
    assert hits[3] == [(1, "vector"), (5, "vector"), (7, "vector")]
    assert hits[4] == hits[2]
    assert 5 not in hits  # the nearest chunk has no text, and no search is tried after one that found something
    assert 6 not in hits and 7 not in hits
    shown = V.vector_search(asked.where("query_id = 6"), chunks, 3).first()
    assert (shown.chunk_id, len(shown.content), shown.section, shown.topic, shown.score) == (20, 2000, "", "general", 0.5)
    none = V.search_by_section(asked.withColumn("sections", F.array(F.lit("s"))).limit(0), chunks, 3)
    assert none.count() == 0 and V.vector_search_by_topic(asked, chunks.limit(0), 3).count() == 0


def test_blocks_choose_what_all_pairs_would(spark):
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(400, 4)), 1)
    x[200:260] = x[200]  # a vector that very many chunks have
    odd = [[0.0] * 4, [None, 1.0, 0.0, 2.0], [float("nan"), 1.0, 0.0, 2.0], [float("inf"), 1.0, 0.0, 2.0], [1.0, 2.0], [3.0], [1e200, 1.0, 0.0, 0.0], [1e-200, 0.0, 0.0, 0.0], [1e-9, 1e-9, 0.0, 0.0], []]
    v = x.tolist() + odd * 4 + [None]
    chunks = spark.createDataFrame([(k, k % 2, -k, f"text {k}", "s", "t" if k % 3 else None, e) for k, e in enumerate(v)] + [(900 + k, 5, k, f"t {k}", "s", "t", e) for k, e in enumerate(odd[:8])], CHUNKS).repartition(3)
    asked = [(k, k % 2, e, ["t"] if k % 5 == 0 else []) for k, e in enumerate([*v[::7], *odd])]
    asked = [*asked, *((700 + k, 5, e, ["t"]) for k, e in enumerate(odd)), *((800 + k, 0, x[200].tolist(), []) for k in range(9))]
    asked = spark.createDataFrame(asked, "query_id int, plan_id long, vector array<double>, topics array<string>")
    shown = lambda d: sorted(map(str, d.collect()))
    every = asked.select("query_id", "plan_id").join(chunks.select("plan_id", "chunk_id"), "plan_id").drop("plan_id")
    got = shown(V.vector_search_by_topic(asked, chunks, 2))
    assert got == shown(V.vector_search_by_topic(asked, chunks, 2, every)) and len(got) > 100
    named = asked.withColumn("query_id", F.concat(F.lit("q"), "query_id"))
    assert [r.replace("'q", "").replace("',", ",") for r in shown(V.vector_search_by_topic(named, chunks, 2).select("query_id", "chunk_id", "rank"))] == shown(V.vector_search_by_topic(asked, chunks, 2).select("query_id", "chunk_id", "rank"))


@pytest.mark.parametrize("kind", ["one vector", "many"])
def test_chosen_pairs_grow_with_queries_not_with_all_pairs(spark, kind):
    x = np.ones((3000, 4)) if kind == "one vector" else np.random.default_rng(5).normal(size=(3000, 4))
    chunks = spark.createDataFrame([(k, 1, v) for k, v in enumerate(x.tolist())], "chunk_id long, plan_id long, embedding array<double>")
    queries = chunks.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "plan_id", F.col("embedding").alias("vector"))
    assert 60 * 12 <= V._nearest(queries, chunks, 12).count() <= 60 * 14  # all pairs: 180,000


def test_budget_counts_the_section_lines(spark):
    rows = [(1, k, k, 0.9, "sec" if k else "", "y" * 10, "vector") for k in range(4)]
    ranked = spark.createDataFrame(rows, "query_id int, chunk_id int, rank int, final double, section string, content string, path string")
    marked = V.within_budget(ranked, 60, V.context_lines(ranked))  # 24 (no section) + 18 + 18
    assert [r.in_budget for r in marked.orderBy("rank").collect()] == [True, True, True, False]
    assert V.context_of(marked).first().context == "[Tài liệu]\n" + "y" * 10 + "\n\n" + ("[sec]\n" + "y" * 10 + "\n\n") * 2


def vectors(kind, n, rng):
    if kind == "clustered":
        return unit(rng.normal(size=(40, 64)))[np.arange(n) % 40] * 3 + rng.normal(size=(n, 64)) * 0.15
    return rng.normal(size=(n, 64))


@pytest.mark.parametrize("kind", ["clustered", "unclustered"])
def test_quantised_search_finds_nine_of_ten_and_reads_a_fifth(spark, kind):
    rng = np.random.default_rng(3)
    x = unit(vectors(kind, 3000, rng))
    chunks = spark.createDataFrame([(k, 1, k, f"text {k}", "", "", v.tolist()) for k, v in enumerate(x)] + [(5000, 1, 5000, "other", "", "", [1.0, 2.0]), (5001, 1, 5001, "none", "", "", None)], CHUNKS)
    q = unit(x[::50] + rng.normal(size=(60, 64)) * 0.02)
    asked = spark.createDataFrame([(k, 1, v.tolist()) for k, v in enumerate(q)], "query_id long, plan_id long, vector array<double>")
    index = V.fit_index(chunks)
    near = I.candidates(asked, I.file_chunks(chunks, index), index, 80)
    assert near.groupBy("query_id").count().agg(F.max("count")).first()[0] <= 0.2 * 3000
    found = V.vector_search(asked, chunks, 10, near)
    want = {(k, int(c)) for k, row in enumerate(np.argsort(-(q @ x.T), axis=1)[:, :10]) for c in row}
    got = {(r.query_id, r.chunk_id) for r in found.collect()}
    assert len(got & want) >= 0.9 * len(want)
    assert {(r.query_id, r.chunk_id) for r in V.vector_search(asked, chunks, 10).collect()} == want
    if kind == "clustered":
        assert index.probes <= 8
    assert V.ann_search(asked, chunks.limit(0), 10).count() == 0


ROW = "lesson_id long, plan_id long, owner_id long, topic string, vector array<double>, is_public boolean"


def brute_reuse(asked, rows, own, public):
    out = {}
    for a in asked:
        lists = {True: [], False: []}
        for b in rows:
            va, vb = np.array(a[4]), np.array(b[4])
            if a[0] == b[0] or len(va) != len(vb) or not len(va):
                continue
            s = round(float(va @ vb / (np.linalg.norm(va) * np.linalg.norm(vb) + 1e-9)), 6)
            if a[2] == b[2] and s >= own:
                lists[True].append((-s, b[0], b))
            if b[5] and s >= public:
                lists[False].append((-s, b[0], b))
        for mine in (True, False):
            for s, i, b in sorted(lists[mine], key=lambda r: r[:2])[:20]:
                if a[0] not in out and a[1] != b[1] and (mine or a[2] != b[2]):
                    out[a[0]] = (i, -s, mine)
    return out


@pytest.mark.parametrize("block", [20_000, 40])
def test_pivot_join_equals_brute_force_on_few_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(I, "BLOCK", block)
    rng = np.random.default_rng(9)
    x = vectors("clustered", 900, rng)
    rows = [(k, k % 7, 1 if k % 3 else k % 11, "same topic words", x[k].tolist(), k % 2 == 0) for k in range(900)]
    rows += [(1000 + k, 50 + k % 3, 1, "same topic words", x[5].tolist(), True) for k in range(120)]  # copies of one vector, a hot owner
    rows += [(2000, 1, 1, "same topic words", [1.0, 2.0], True), (2001, 2, 1, "same topic words", [1.0, 2.1], True), (2002, 2, 1, "t", [0.0] * 64, True), (2003, 2, 1, "t", [], True)]
    asked = [r for r in rows if r[0] % 10 == 0 or r[0] in (5, 1003)]
    index, requests = spark.createDataFrame(rows, ROW).repartition(3), spark.createDataFrame(asked, ROW).drop("is_public")
    got = {r.lesson_id: (r.source_id, r.score, r.own) for r in V.reuse_candidates(requests, index).collect()}
    want = brute_reuse(asked, rows, 0.88, 0.92)
    assert got.keys() == want.keys() and len(got) > 50
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-6 and got[k][2] == want[k][2] for k in got)
    pivots = I.fit_pivots(index, "lesson_id", "vector", 0.92)
    pairs = I.meeting(requests.select("lesson_id", "vector"), index.select(F.col("lesson_id").alias("i"), F.col("vector").alias("i_vector")), pivots)
    assert pairs.count() < len(asked) * len(rows) / 10
    assert V.reuse_candidates(requests, index.limit(0)).count() == 0


def test_sql_functions_say_what_the_builders_say(spark):
    from lectern.functions import sql
    from lectern.functions import text as X

    assert sql.register(spark) == ["cosine", "jaccard", "bloom_level", "heading_level"]
    lines = ["# One", "##### five", "1. Intro", "2.3.4.5.6 Deep", "A. Letter", "IV. Roman line here", "Chương 3 vectors", "TWO WORDS", "F(X) = 2", "plain text", "", "  ", None, "Section II"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert df.select(X.heading_level("line").alias("a"), F.expr("heading_level(line)").alias("b")).where("not a <=> b").count() == 0
    pairs = spark.createDataFrame([([1.0, 2.0], [2.0, 1.0], ["a", "b"], ["b", "c"], 3, 7), ([1.0], [1.0, 2.0], [], ["a"], 1, 1), ([0.0], [0.0], ["a"], ["a"], 9, 4)], "a array<double>, b array<double>, s array<string>, t array<string>, day int, days int")
    got = pairs.select(V.cosine("a", "b").alias("c1"), F.expr("cosine(a, b)").alias("c2"), X.jaccard("s", "t").alias("j1"), F.expr("jaccard(s, t)").alias("j2"), X.bloom_level("day", "days").alias("b1"), F.expr("bloom_level(day, days)").alias("b2")).collect()
    assert all(r.c1 == r.c2 and r.j1 == r.j2 and r.b1 == r.b2 for r in got)


def test_vectors_pass_through_or_come_from_a_model(spark):
    docs = spark.createDataFrame([(1, "aab", None), (2, None, []), (3, "zz", [7.0])], "doc_id long, text string, own array<double>")
    got = {r.doc_id: r.embedding for r in V.vectorize(docs, "doc_id", "text", model=lambda texts: [[float(len(x))] for x in texts], given="own").collect()}
    assert got == {1: [3.0], 2: [0.0], 3: [7.0]}
    assert {r.doc_id for r in V.vectorize(docs, "doc_id", "text", given="own").collect()} == {1, 3}


def test_texts_of_reusable_lessons_stay_out_of_python(spark):
    """Only vectors go to Python, and what comes back are the nearest pairs, as many as a full comparison finds."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6))
    x[100:140] = x[7]  # more copies than the list is long
    rows = [(k, k % 5, k % 3, f"graph theory lesson {k % 4}", [float(v) for v in x[k]], k % 2 == 0) for k in range(300)] + [(900, 0, 0, "zero", [0.0] * 6, True), (901, 0, 0, "short", [1.0, 2.0], True), (902, 0, 0, "none", None, True)]
    index = spark.createDataFrame(rows, "lesson_id long, plan_id long, owner_id long, topic string, vector array<double>, is_public boolean")
    found = V.reuse_candidates(index.where("lesson_id % 10 = 0").drop("is_public"), index, own=0.3, public=0.35, overlap=0.01)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and not any("topic" in line for line in plan.splitlines() if "MapInArrow" in line or "python_arrow" in line)
    pairs = I.nearest_pairs(index.selectExpr("lesson_id as key", "vector", "0 as part"), index.selectExpr("lesson_id as i_key", "vector as i_vector", "0 as i_part"), 0.5, 5).collect()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    score = np.round(u @ u.T, 6)
    np.fill_diagonal(score, -1)
    for k in range(300):
        best = {j for j in np.lexsort((np.arange(300), -score[k]))[:5] if score[k, j] >= 0.5}
        assert best <= {p.i_key for p in pairs if p.key == k} <= set(np.flatnonzero(score[k] >= 0.4999))
    assert not {900, 901, 902} & {p.key for p in pairs if p.i_key != p.key}


def test_models_and_indexes_see_small_batches(spark):
    """What goes to Python at a time is bounded, and so is what the codes' tables take there."""
    name, rng = "spark.sql.execution.arrow.maxRecordsPerBatch", np.random.default_rng(5)
    rows = [(k, 0, [float(x) for x in v]) for k, v in enumerate(rng.normal(size=(700, 8)))]
    chunks = spark.createDataFrame(rows, "chunk_id long, plan_id long, embedding array<float>")
    asked = chunks.select(F.col("chunk_id").alias("query_id"), "plan_id", F.col("embedding").alias("vector")).coalesce(1)
    x = I.fit_index(chunks)
    spark.conf.set(name, "10000")
    filed = I.file_chunks(chunks, x)
    assert spark.conf.get(name) == "2000" and filed.count() == 700
    hits = I.candidates(asked, filed, x, 5)
    assert hits.groupBy("query_id").count().where("count = 5").count() == 700  # more queries than are worked on at a time
    spark.conf.set(name, "10000")
    made = V.vectorize(spark.createDataFrame([(1, "a b")], "id long, text string"), "id", "text", model=lambda texts: [[1.0] for _ in texts])
    assert spark.conf.get(name) == "2000" and made.first().embedding == [1.0]
    m = np.arange(12, dtype=np.float32).reshape(3, 4)
    assert I.lists(m).to_pylist() == m.tolist() and len(I.lists(m[:0])) == 0
