"""The library without the training-data subpackage: oracles, folds, streams, sources, regular expressions."""

import math
import os
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.fixtures import TABLES, VIEWS, duck_sql, table
from lectern.functions import text as X
from lectern.operators import mutations as M
from lectern.operators import quiz as Z
from lectern.operators import windows as O
from lectern.plans import registry
from lectern.sources import files
from lectern.streaming import jobs

duckdb = pytest.importorskip("duckdb")
registry.load()


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    try:
        return round(float(v), 9) if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)


def same(a: pd.DataFrame, b: pd.DataFrame) -> bool:
    cols = sorted(a.columns)
    rows = lambda d: sorted((tuple(map(plain, r)) for r in d[cols].itertuples(index=False)), key=str)
    return cols == sorted(b.columns) and rows(a) == rows(b)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_its_sql(spark, sf, duck, name):
    assert same(registry.QUERIES[name](spark, sf).toPandas(), duck.execute(registry.ORACLES[name]).df())


@pytest.mark.parametrize("name", [*VIEWS, "marked_documents"])
def test_views_agree(spark, sf, duck, name):
    a, b = table(spark, sf, name).toPandas(), duck.execute(duck_sql(name)).df()
    text = lambda d: d.map(lambda v: str([getattr(x, "item", lambda: x)() for x in v]) if hasattr(v, "__len__") and not isinstance(v, str) else v)
    assert same(text(a), text(b))


def test_running_average_is_a_fold(spark):
    rng = [(1, 1, k, k, (k * 37) % 101) for k in range(50)]
    got = O.progress_fold(spark.createDataFrame(rng, "user_id long, plan_id long, ts long, submission_id long, pct int")).first()
    avg, n = 0.0, 0
    for *_, p in rng:
        raw = (avg * n + p) / (n + 1)
        avg, n = math.floor(raw + 0.5), n + 1
    assert (got.average_score, got.quizzes) == (avg, n)


@pytest.mark.parametrize("slots", [1, 5])
def test_streams_equal_their_batch_twins_on_late_and_shuffled_rows(spark, sf, slots):
    sub = table(spark, sf, "submissions")
    counts = jobs.latest(jobs.drain(jobs.topic_memory(jobs.replay(sub, slots)[0])), ["user_id", "topic"])
    assert same(counts.toPandas(), jobs.topic_memory(sub).toPandas())
    whole = jobs.drain(jobs.topic_memory(jobs.replay(sub, slots)[0]), "complete")
    assert same(whole.where(whole.batch == whole.agg(F.max("batch")).first()[0]).drop("batch").toPandas(), jobs.topic_memory(sub).toPandas())


def test_late_submissions_are_folded_in_order(spark, sf):
    """What comes late, but before the watermark, gives the result of ordered input; nothing counts before the watermark has passed it."""
    at = lambda d: datetime(2024, 1, 1) + timedelta(days=d)
    rows = [(1, 1, k, (k * 37) % 101, at(k)) for k in range(20)]
    schema = "user_id long, plan_id long, submission_id long, pct long, ts timestamp"
    swapped = [rows[k ^ 1] for k in range(20)]  # each pair comes the other way round
    stream, late, folder = jobs.replay(spark.createDataFrame(swapped, schema), 5, ts="ts")
    held = jobs.drain(jobs.running_progress(stream, late=late))
    assert 0 < held.agg(F.max("quizzes")).first()[0] < 20
    ends = [spark.createDataFrame([(jobs.NOBODY, 0, 0, 0, at(d))], schema) for d in (4000, 8000)]
    got = jobs.latest(jobs.drain_to_the_end(jobs.running_progress(stream, late=late), ends, folder), ["user_id", "plan_id"])
    assert same(got.toPandas(), O.progress_fold(spark.createDataFrame(rows, schema)).toPandas())


def test_rolling_windows_and_single_ingest(spark, sf, tmp_path):
    ev = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    stream = jobs.replay(ev, 3)[0]
    once = jobs.drain(jobs.ingest_once(stream, "user_id", "event_type", "ts", "1000 days"), "append")
    assert once.count() == ev.select("user_id", "event_type").distinct().count()
    none = jobs.drain(jobs.topic_memory(jobs.replay(table(spark, sf, "submissions").limit(0))[0]))
    assert none.count() == 0


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    sink = jobs.KeptOnce(f"file://{tmp_path}/kept", ["owner", "h"], "id")
    schema = "owner string, h string, id long"
    first, second = [("a", "x", 5), ("a", "x", 6), ("b", "x", 1)], [("a", "x", 2), ("a", "y", 9), ("b", "x", 3)]
    want = {("a", "x", 2), ("a", "y", 9), ("b", "x", 1)}
    for number, rows in ((0, first), (1, second), (1, second), (0, first)):
        sink.write(spark.createDataFrame(rows, schema), number)
        if number:
            assert {tuple(r) for r in sink.read(spark, schema + ", part int").collect()} == want
    assert {tuple(r) for r in sink.read(spark, schema + ", part int").collect()} == want


def test_sources_and_sinks(spark, sf, tmp_path):
    for name, body in (("a.txt", "long enough to be a document"), ("b.txt", "short"), ("c.md", "not a text file at all, this")):
        (tmp_path / name).write_text(body)
    assert [r.text for r in files.ingest_text_files(spark, str(tmp_path)).collect()] == ["long enough to be a document"]
    chunks = table(spark, sf, "chunks").select("chunk_id", "plan_id", "chunk_index")
    out = str(tmp_path / "chunks")
    files.write_chunks(chunks, out)
    files.write_chunks(chunks.where("plan_id = 1").limit(1), out)
    back = spark.read.parquet(out)
    assert back.where("plan_id = 1").count() == 1 and back.where("plan_id <> 1").count() == chunks.where("plan_id <> 1").count()
    plans = spark.createDataFrame([(1, "A  course", 7, False), (2, "Gone", 7, True), (3, None, None, False)], "plan_id long, title string, owner_id long, is_deleted boolean")
    lessons = spark.createDataFrame([(5, 1, 2, "Two", "locked", None, None, None, None), (4, 1, 1, "One", "completed", 3, "s\nt", ["n 1", "n2"], "text\nmore")], "lesson_id long, plan_id long, day_number int, title string, status string, questions int, summary string, notes array<string>, content string")
    files.export_course_report(plans, lessons, str(tmp_path / "report"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "report")).collect()) == [
        "plan 1 A course, owner 7, lessons 2 | day 1: ✅ One; quiz 3; summary: s t; notes: n 1, n2; content: text more | day 2: 🔒 Two; quiz 0; summary: ; notes: ; content: ", "plan 3 , owner N/A, lessons 0"
    ]
    files.reset_table(spark, out, chunks.schema)
    assert spark.read.parquet(out).count() == 0


def test_friendship_machine(spark):
    log = [(1, 1, 2, "request"), (2, 1, 2, "accept"), (3, 2, 1, "reject"), (4, 2, 1, "request"), (5, 1, 2, "accept"), (6, 3, 4, "request"), (7, 3, 4, "cancel"), (8, 5, 5, "request"), (9, 6, 5, "request")]
    got = {(r.a, r.b): (r.status, r.requester) for r in M.friendships(spark.createDataFrame(log, "seq long, actor long, other long, action string")).collect()}
    assert got == {(1, 2): ("accepted", 2), (5, 6): ("pending", 6)}


def test_quiz_parser_keeps_corrupt_rows_aside(spark):
    raw = [(1, 'Sure! ```json\n{"quiz":[{"question":"Q?","options":["a","b",],"correctAnswer":2},]}\n``` done'), (2, '[{"question":"R?","options":[],"correctAnswer":0}]'), (3, "no json here"), (4, None)]
    got = {(r.id, r.item.question if r.item else None, r.corrupt) for r in Z.parse_quiz_json(spark.createDataFrame(raw, "id int, raw string")).collect()}
    assert got == {(1, "Q?", False), (2, "R?", False), (3, None, True), (4, None, True)}


def test_boundaries_are_ascii_ones(spark):
    df = spark.createDataFrame([(" đạo hàm",), ("x CREATE TABLE y",), ("recreate table",)], "t string")
    p = X.js_regex(r"\b(đạo\s+hàm|create)\b")
    assert [r[0] for r in df.select(F.rlike("t", F.lit(p))).collect()] == [False, True, False]


def test_entities_and_marks(spark):
    df = spark.createDataFrame([("a &amp; &#65;&#x1F600; &#7;b &unknown;", "Đạo Hàm ở Việt Nam")], "t string, v string")
    r = df.select(X.decode_entities("t").alias("t"), X.fold_vi("v").alias("v"), X.fold_vi("v", map_d=True).alias("d")).first()
    assert r.t == "a & A\U0001f600 b &unknown;" and r.v == "đao ham o viet nam" and r.d == "dao ham o viet nam"


@pytest.mark.parametrize("name", ["j2_plans_by_instructor", "o4_recommend_courses", "v3_vector_search", "w4_review_threads"])
def test_plans_have_no_cross_products_and_no_python(spark, sf, name):
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("CartesianProduct", "BatchEvalPython", "ArrowEvalPython"))


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and os.path.exists(e.__file__)


def test_leaked_prompts_go(spark):
    from lectern.functions.cleaning import strip_prompt_leakage

    text = "```markdown\n===== CONTEXT a ===== secret =====\n# Lesson\n* [Context: x]\nBody.\n\n\n\nMore.\n## Quiz\nWhat?\n```"
    assert spark.createDataFrame([(text,)], "t string").select(strip_prompt_leakage("t")).first()[0] == "# Lesson\nBody.\n\nMore."


def test_topic_rules_are_only_tried_where_their_words_are(spark):
    from lectern.operators import classify as N

    assert X.needed_words(r"\bEXEC(UTE)?\s+\w+") == ["exec"] and X.needed_words(r"\bMODULO\b|%\s*\d+") == ["modulo", "%"] and X.needed_words(r"[+*]") == []
    texts = ["LỊCH  SỬ", "lịch sử x", "triều đại.", "ĐỘ PHỨC TẠP", "xđệ quy", "exıt exec p", "ma trận ſố", "hàm ſốx", "IN ( SELECT a", "50 % 7", "@a as b", "c@a as b", "SP_x", "begin\n", "Kinh độx", "xİ gen"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("f", X.fold_letters("text"))
    for _, patterns in N.TOPICS:
        for p in patterns:  # wherever a rule matches, its words are there
            assert rows.where(F.rlike("text", F.lit(X.js_regex(p))) & ~X.may_match("f", p)).isEmpty(), p
    assert sum(bool(X.needed_words(p)) for _, ps in N.TOPICS for p in ps) > 90


def test_adaptive_questions_are_ranked_where_they_can_be_chosen_only(spark):
    import glob
    import hashlib

    pool = [(q % 3, q, "easy" if q % 3 == 2 and q > 8 else ("easy", "medium", "hard")[q // 3 % 3]) for q in range(3000)]
    learners = [(u, u % 3, ("BEGINNER", "INTERMEDIATE", "EXPERT")[u % 4 % 3]) for u in range(60)]
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(glob.glob(f"{folder}/questions-near-*"))
    got = O.select_adaptive(spark.createDataFrame(pool, "lesson_id long, question_id long, difficulty string"), spark.createDataFrame(learners, "user_id long, lesson_id long, level string"), 5, "s")
    want = set()
    for user, lesson, level in learners:
        seen, rows = {}, []
        for o, q, d in sorted((hashlib.md5(f"s:{user}:{q}".encode()).hexdigest(), q, d) for at, q, d in pool if at == lesson):
            seen[d] = seen.get(d, 0) + 1
            rows.append((seen[d] > int(5 * dict(zip(("easy", "medium", "hard"), O.LEVEL_MIX[level]))[d] + 0.5), o, q))
        want |= {(user, lesson, q, k + 1) for k, (_, q) in enumerate(sorted((o, q) for _, o, q in sorted(rows)[:5]))}
    assert {tuple(r) for r in got.collect()} == want and len(want) == 300
    (near,) = set(glob.glob(f"{folder}/questions-near-*")) - before
    assert 0 < spark.read.parquet(near).count() < 60 * 1000 / 10


def test_digests_of_all_pairs_are_md5():
    """Every length of a beginning, also such as fill more than one block, and beginnings for which the bound keeps too few."""
    import hashlib

    import numpy as np

    from lectern.functions import digests as D

    ends = [b"", b"-7", b"12345", "ợ9".encode(), b"1234567890123"]
    for size in range(60):
        begins = [bytes([97 + k]) * size for k in range(3)]
        got = D.first_words(begins, D.Ends(ends), np.empty((7, 15), np.uint32))
        assert got.tolist() == [[int(hashlib.md5(b + e).hexdigest()[:8], 16) for e in ends] for b in begins]
    begins, ends = [f"s:{u}:".encode() for u in range(0, 4000, 7)], [str(q).encode() for q in range(900)]
    for most in (1, 6, 2000):
        i, j = D.smallest(begins, ends, most)
        want = {(u, q) for u, b in enumerate(begins) for _, q in sorted((hashlib.md5(b + e).digest(), q) for q, e in enumerate(ends))[:most]}
        assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want)


def test_adaptive_cells_give_no_more_than_can_be_chosen(spark, monkeypatch):
    """Blocks of any size give the same choice; a cell gives a learner as many of a difficulty as needed. A null id is an empty text, as in SQL."""
    import glob
    import hashlib

    pool = spark.range(90).selectExpr("1L as lesson_id", "id as question_id", "elt(1 + int(id % 3), 'easy', 'medium', 'hard') as difficulty")
    learners = spark.createDataFrame([(u, 1, "BEGINNER") for u in (None, *range(40))], "user_id long, lesson_id long, level string")
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(glob.glob(f"{folder}/questions-near-*"))
    got = {tuple(r) for r in O.select_adaptive(pool, learners, 5, "s").collect()}
    (near,) = set(glob.glob(f"{folder}/questions-near-*")) - before
    assert spark.read.parquet(near).count() == 41 * (3 + 2 + 1)
    for user in (None, *range(40)):
        order = sorted((hashlib.md5(f"s:{'' if user is None else user}:{q}".encode()).hexdigest(), q) for q in range(90))
        first = [(o, q) for d, most in enumerate((3, 2, 1)) for o, q in [x for x in order if x[1] % 3 == d][:most]]
        want = [q for _, q in sorted(sorted(first)[:5])]
        assert [q for _, _, q, _ in sorted((r for r in got if r[0] == user), key=lambda r: r[3])] == want
    monkeypatch.setattr(O, "LEARNERS", 7)
    monkeypatch.setattr(O, "QUESTIONS", 11)
    assert {tuple(r) for r in O.select_adaptive(pool, learners, 5, "s").collect()} == got


def test_courses_are_met_without_a_broadcast(spark):
    """Files of few distinct values are small, the tables in them are not: none of them may be sent through the driver."""
    texts = spark.range(300).selectExpr("id as plan_id", "concat('blue ring ', id % 3) as t")
    needles = spark.createDataFrame([("ring 1",), ("g",), ("e r",), ("none",)], "topic string")
    found = O.contained(texts, needles, "plan_id", "t", "topic")
    assert {(r.plan_id, r.topic) for r in found.collect()} == {(k, n) for k in range(300) for n in ("ring 1", "g", "e r") if n in f"blue ring {k % 3}"}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    users = spark.range(20).toDF("user_id")
    plans = spark.range(300).selectExpr(
        "id as plan_id", "'blue ring' as title", "id % 7 as owner_id", "concat('c', id % 5) as category", "array('blue', 'ring') as tags", "true as is_public", "false as is_deleted", "id as created_rank"
    )
    memory = users.selectExpr("user_id", "'click' as topic", "1L as count")
    got = O.recommend_courses(users, plans, memory, plans.selectExpr("plan_id", "1L as students"), plans.selectExpr("plan_id", "4.0D as avg_rating"))
    assert got.count() == 200 and "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_courses_of_a_group_share_their_state(spark):
    """A micro-batch costs a few calls for state, however many courses it meets, and the fold is that of each course alone."""
    calls = []

    class Value:
        held = None

        def __getattr__(self, name):
            calls.append(name)
            return {"exists": lambda: self.held is not None, "get": lambda: self.held, "update": lambda v: setattr(self, "held", v), "clear": lambda: setattr(self, "held", None)}[name]

    class Handle:
        getValueState = lambda self, *a: Value()
        getListState = lambda self, *a: Value()
        registerTimer = lambda self, at: calls.append("timer")

    class Times:
        getCurrentWatermarkInMs = lambda self: 3000

    p = jobs._Progress()
    p.init(Handle())
    rows = [(u, 1, at * 1_000_000, u * 10 + at, (u * 37 + at) % 101) for u in range(500) for at in (2, 1, 5)]
    list(p.handleInputRows((0,), iter([pd.DataFrame(rows, columns=["user_id", "plan_id", "at", "submission_id", "pct"])]), Times()))
    out = pd.concat(p.handleExpiredTimer((0,), Times(), None))
    assert len(calls) < 20 and len(out) == 500 and set(out["quizzes"]) == {2}
    first = lambda u: math.floor((u * 37 + 1) % 101 + 0.5)
    assert list(out.sort_values("user_id")["average_score"]) == [math.floor((first(u) + (u * 37 + 2) % 101) / 2 + 0.5) for u in range(500)]


def test_scope_counts_only_words_that_a_title_can_have(spark):
    from lectern.operators import documents as D

    rows = [(1, 1, "graph theory basics", "graph"), (1, 2, "more", "graph graph theory theory basics basics of of of"), (1, 2, "x", "graph graph"), (1, 3, "y", "of of graph graph")]
    out = D.scope_compliance(spark.createDataFrame(rows, "plan_id long, day_number int, title string, content string"))
    assert [tuple(r) for r in out.collect()] == [(1, 2, 1, 3)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("> 4") >= 2
