"""Notes, syllabus, guard, vectors and reuse against literal cases and brute force."""

import math
import random

import pytest

from lectern.functions import notes as N
from lectern.functions import repair as R
from lectern.operators import cleaner as C
from lectern.operators import lessons as L
from lectern.operators import retrieval as V
from lectern.operators import vectors
from lectern.plans import registry


def one(spark, f, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r[1] for r in sorted(rows.select("doc_id", f("text")).collect())]


def test_truncated_keywords_and_sentences(spark):
    assert one(spark, R.recover_keywords, "ELECT x ROM t | HERE ELECTRIC\n**EGIN TRAN** OIN(", "a OT NULL ROM  b") == ["ELECT x ROM t | HERE ELECTRIC\n**BEGIN TRAN** JOIN(", "a NOT NULL FROM  b"]
    docs = spark.createDataFrame([(1, "One. Two! three. Four\n| A. B |\n3.\n\n\n\nend &amp;eacute; &#124; \\_")], "doc_id long, text string")
    assert C.postprocess_markdown(docs).first().text == "One.\nTwo! three.\nFour\n| A. B |\n\nend &eacute; | _"


def test_concepts(spark):
    df = spark.createDataFrame([("# Overview\n## 1.2 `Tree` **height**\n### " + "w " * 11 + "\nselect count (*) from a left  join b; begin transaction Xcount(1)", "Cast(x)")], "c string, t string")
    assert df.select(N.extract_concepts("c", "t")).first()[0] == ["CAST", "COUNT", "LEFT JOIN", "BEGIN TRANSACTION", "TREE HEIGHT"]


def test_snippets_and_seeds(spark):
    long = "a" * 600 + " ví dụ one. " + "b" * 900
    got = one(spark, N.smart_context, long, "short")
    assert got[1] == "short" and got[0] == "\n---\n".join(["a" * 500, (long[601:1006]).strip()[:600], "b" * 300])[:1400]
    text = ". ".join(f"sentence number {k} is long enough" for k in range(4))
    assert one(spark, lambda c: N.objective_seeds(c, 2), text, "no")[0] == ["sentence number 0 is long enough", "sentence number 2 is long enough"]


def test_invented_code_goes(spark):
    block = "```sql\nSELECT @total FROM Ghosts JOIN Shadows EXEC spHaunt @p1\n```"
    rows = [(1, f"a {block} b", "CREATE TABLE Orders"), (2, f"a {block} b", "no queries here"), (3, f"a {block} b", "CREATE TABLE ghosts, shadows"), (4, f"a {block} b", None)]
    got = {r.lesson_id: r.content for r in L.code_guard(spark.createDataFrame(rows, "lesson_id long, content string, context string")).collect()}
    assert got[1] == "a > ⚠️ *Ví dụ code bị lược bỏ vì chứa tên không có trong tài liệu: `@total`, `spHaunt`, `Ghosts`, `Shadows`* b"
    assert got[2] == got[3] == got[4] == rows[0][1]


def test_syllabus_has_every_day_and_heading(spark):
    text = "\n".join(f"## Heading number {k}\nThis sentence of part {k} is long enough to be a seed." for k in range(9))
    docs = spark.createDataFrame([(1, text), (2, "Just some sentence that is long enough here. And another one of them follows.")], "doc_id long, text string")
    items = [(1, 1, "Same", "An objective that is long enough", ["Heading number 0"]), (1, 2, "Same", "An objective that is long enough", ["x"]), (1, 3, "Other", "introduction to all the things", [])]
    items += [(2, k, f"T{'abcdefgh'[k]}", f"An objective of day {k} that is long", None) for k in range(1, 8)]
    got = L.repair_syllabus(spark.createDataFrame(items, "doc_id long, day int, title string, objective string, sections array<string>"), docs, 5).collect()
    one, two = (sorted((r for r in got if r.doc_id == d), key=lambda r: r.day) for d in (1, 2))
    assert [r.day for r in one] == [r.day for r in two] == [1, 2, 3, 4, 5]
    assert [r.title for r in one[:3]] == ["Same", "Same (2)", "Other"] and one[0].objective == "An objective that is long enough" != one[1].objective != one[2].objective
    assert {f"Heading number {k}" for k in range(9)} <= {s for r in one[:3] for s in r.sections} and all(r.sections and r.objective for r in got)
    assert [r.sections for r in two] == [[r.title] for r in two]


def test_vectors_are_weighted_and_of_length_one(spark):
    docs = spark.createDataFrame([(1, "Tree tree leaf"), (2, "leaf, tree"), (3, ""), (4, None), (5, "tree leaf tree")], "doc_id long, text string")
    got = {r.doc_id: r.embedding for r in V.vectorize(docs, "doc_id", "text").collect()}
    assert set(got) == {1, 2, 5} and all(v == [0.0] * 384 for v in got.values())  # words of every text weigh nothing
    more = docs.union(spark.createDataFrame([(6, "root stem")], docs.schema))
    v = {r.doc_id: r.embedding for r in V.vectorize(more, "doc_id", "text").collect()}
    assert all(abs(math.sqrt(sum(x * x for x in w)) - 1) < 1e-5 for w in v.values()) and v[1] == v[5] != v[2] and sum(x > 0 for x in v[6]) == 2


def test_approximate_search_recalls_the_exact_one(spark):
    all_of = registry.queries()
    found = {n: {(r.query_id, r.chunk_id) for r in all_of[n](spark, "/root/testdata/sf0.01").select("query_id", "chunk_id").collect()} for n in ("v3_vector_search", "v13_ann_search")}
    assert len(found["v3_vector_search"] & found["v13_ann_search"]) >= 0.9 * len(found["v3_vector_search"])


@pytest.mark.parametrize("cell", [2000, 7])
def test_reuse_compares_all_with_all(spark, monkeypatch, cell):
    rng = random.Random(8)
    monkeypatch.setattr(vectors, "BLOCK", cell)
    base = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    words = "graph node tree leaf stack queue heap sort".split()
    rows = []
    for k in range(120):
        b = base[k % 6]
        rows.append((k, k % 5, k % 7 if k % 4 else 100 + k, " ".join(rng.sample(words, 3)), [x + rng.gauss(0, 0.25) for x in b], k % 3 == 0))
    d = spark.createDataFrame(rows, "lesson_id long, plan_id long, owner_id long, topic string, vector array<double>, is_public boolean")
    got = {r.lesson_id: (r.source_id, r.own) for r in V.reuse_candidates(d.where("lesson_id % 2 = 0").drop("is_public"), d).collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    want = {}
    for r in rows[::2]:
        for own in (True, False):
            near = sorted(((-round(cos(r[4], s[4]), 6), s[0], s) for s in rows if s[0] != r[0] and (s[2] == r[2] if own else s[5])), key=lambda x: x[:2])
            near = [x for x in near if -x[0] >= (0.88 if own else 0.92)][:20]
            ok = [s for _, _, s in near if s[1] != r[1] and (own or s[2] != r[2]) and len(set(s[3].split()) & set(r[3].split())) / len(set(s[3].split()) | set(r[3].split())) >= 0.15]
            if ok:
                want[r[0]] = (ok[0][0], own)
                break
    assert got == want and {own for _, own in want.values()} == {True, False}


def test_literal_topics_and_domains(spark):
    """The rule tables themselves, not twins made from them."""
    from lectern.operators import classify, documents

    chunks = spark.createDataFrame([(1, "x", "SELECT a FROM t JOIN u ON a = b GROUP BY a"), (2, "x", "nothing to be seen")], "chunk_id long, section string, content string")
    got = {r.chunk_id: r.topic for r in classify.classify_topics(chunks).collect()}
    assert got[1] != "general" and got[2] == "general"
    lessons = spark.createDataFrame([(1, 1, "Đạo hàm", "tích phân và ma trận"), (2, 2, "stack và queue", "đệ quy"), (3, 3, "none", "of it")], "lesson_id long, plan_id long, title string, content string")
    plans = spark.createDataFrame([(3, "gdp lạm phát")], "plan_id long, title string")
    assert {r.lesson_id: r.domain for r in documents.detect_domain(lessons, plans).collect()} == {1: "math", 2: "cs", 3: "economics"}
