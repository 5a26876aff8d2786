"""Copies, deletions, moderation and visibility: single cases, and that a log applied twice changes nothing."""

import pytest
from pyspark.sql import functions as F

from lectern.fixtures import table
from lectern.operators import lifecycle as L
from lectern.plans import lifecycle as P
from lectern.plans import registry

PLAN = "plan_id long, owner_id long, instructor_id long, is_public boolean, is_deleted boolean, original_plan_id long, source_type string, shared_with array<long>, deleted_by_owner boolean, deleted_by_instructor boolean, title string"


def plan(i, owner=1, instructor=None, public=False, deleted=False, original=None, source="self", shared=(), o=False, n=False):
    return (i, owner, instructor, public, deleted, original, source, list(shared), o, n, f"plan {i}")


def rows(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()}


def test_only_allowed_requests_change_visibility(spark):
    plans = spark.createDataFrame([plan(1), plan(2, public=True), plan(3, source="imported", public=True), plan(4), plan(5, public=True), plan(6), plan(7, deleted=True)], PLAN)
    log = [
        (1, 1, "list", 1), (1, 99, "unlist", 2),  # a stranger's later request does not undo the owner's
        (2, 99, "takedown", 1), (2, 8, "unlist", 2),
        (3, 1, "remove_import", 1), (3, 1, "list", 2),
        (4, 1, "list", 1), (4, 50, "takedown", 2), (4, 1, "list", 3),  # what is taken down cannot be listed
        (5, 1, "unlist", 1), (5, 1, "remove_import", 2),  # not imported
        (6, 1, "list", 1), (6, 1, "unlist", 2), (6, 1, "list", 3),
        (7, 1, "list", 1),
    ]
    admins, log = spark.createDataFrame([(50,)], "user_id long"), spark.createDataFrame(log, "plan_id long, actor long, action string, seq long")
    got = {r.plan_id: (r.is_public, r.is_deleted) for r in L.apply_visibility(plans, log, admins).collect()}
    assert got == {1: (True, False), 2: (True, False), 3: (True, True), 4: (False, True), 5: (False, False), 6: (True, False), 7: (False, True)}


def test_plans_go_when_both_sides_have_deleted_them(spark):
    plans = spark.createDataFrame([plan(1), plan(2, instructor=2), plan(3, instructor=2), plan(4, public=True, original=1), plan(5, shared=[7, 8]), plan(6, owner=9, instructor=9), plan(7, o=True)], PLAN)
    asked = [(1, 1), (2, 1), (3, 1), (3, 2), (4, 1), (5, 7), (5, 77), (6, 9), (7, 3)]
    lessons = spark.createDataFrame([(k, k) for k in range(1, 8)], "lesson_id long, plan_id long")
    out = L.delete_plans(plans, spark.createDataFrame(asked, "plan_id long, user_id long"), {"lessons": lessons})
    assert rows(out["lessons"], "plan_id") == {(2,), (4,), (5,), (7,)}
    got = {r.plan_id: (r.shared_with, r.deleted_by_owner, r.deleted_by_instructor) for r in out["plans"].collect()}
    assert got == {2: ([], True, False), 4: ([], False, False), 5: ([8], False, False), 7: ([], True, False)}


def test_resolved_and_dismissed_reports(spark):
    users = spark.createDataFrame([(1, "Ann", True, 3.0, 9), (2, "Bob", False, 3.0, 9), (3, "Cy", False, 3.0, 9)], "user_id long, full_name string, is_admin boolean, avg_rating double, rating_count long")
    plans = spark.createDataFrame([plan(1, owner=2, public=True)], PLAN)
    reviews = spark.createDataFrame([(10, None, 2, "root", False), (11, 10, 3, "reply", False), (20, None, 2, "lonely", False), (30, None, 3, "root", False), (31, 30, 2, "r", False)], "review_id long, parent_id long, user_id long, content string, is_deleted boolean")
    ratings = spark.createDataFrame([(1, 2, 3, 5), (2, 2, 1, 2), (3, 2, 3, 4), (4, 3, 2, 1)], "rating_id long, instructor_id long, learner_id long, stars int")
    made = [(1, "course", 1, 3, "x"), (2, "course", 1, 3, "again"), (3, "review", 10, 3, "x"), (4, "review", 20, 3, "x"), (5, "instructorRating", 2, 2, "x"), (6, "instructorRating", 4, 2, "x"), (7, "review", 10, 1, "x"), (8, "other", 1, 1, "x"), (9, "review", 31, 1, "x"), (10, "review", 30, 1, "x"), (11, "course", 1, 2, None)]
    reports = L.take_reports(spark.createDataFrame(made, "report_id long, target_type string, target_id long, reported_by long, reason string"), plans, reviews, ratings, users)
    first = {r.report_id: (r.status, r.snapshot, r.snapshot_author) for r in reports.collect()}
    assert first[1] == ("pending", "plan 1", "Bob") and first[2][0] == first[8][0] == first[11][0] == "rejected" and first[5] == ("pending", "2", "Ann") and first[3] == ("pending", "root", "Bob")
    log = [(1, 1, "resolve", 3), (2, 1, "resolve", 1), (3, 3, "dismiss", 1), (4, 7, "resolve", 1), (5, 4, "resolve", 1), (6, 5, "resolve", 1), (7, 6, "resolve", 1), (8, 9, "resolve", 1), (9, 10, "resolve", 1), (10, 3, "resolve", 1), (11, 4, "dismiss", 1)]
    decisions = spark.createDataFrame(log, "seq long, report_id long, action string, actor long")
    out = L.moderate(reports, decisions, plans, reviews, ratings, users)
    status = {r.report_id: r.status for r in out["reports"].collect()}
    assert status == {1: "resolved", 2: "rejected", 3: "dismissed", 4: "resolved", 5: "resolved", 6: "resolved", 7: "resolved", 8: "rejected", 9: "resolved", 10: "resolved", 11: "rejected"}
    assert rows(out["plans"], "is_public", "is_deleted") == {(False, True)}
    shown = {r.review_id: (r.content, r.is_deleted) for r in out["reviews"].collect()}
    assert shown == {10: (L.TAKEN_DOWN, True), 11: ("reply", False), 20: ("lonely", True), 30: ("root", True), 31: ("r", True)}  # 31 was gone before its root
    assert {r.rating_id for r in out["ratings"].collect()} == {1, 3}
    assert {r.user_id: (r.avg_rating, r.rating_count) for r in out["users"].collect()} == {1: (3.0, 9), 2: (4.5, 2), 3: (0.0, 0)}
    again = L.moderate(out["reports"], decisions, out["plans"], out["reviews"], out["ratings"], out["users"])
    assert all(sorted(map(str, again[n].select(out[n].columns).collect())) == sorted(map(str, out[n].collect())) for n in out)


def test_drafts_are_sent_by_those_who_may(spark):
    kind = PLAN + ", has_title_draft boolean, draft_title string, status string, student_id long"
    plans = spark.createDataFrame([(*plan(1, instructor=2), True, "New", "pending", 5), (*plan(2, instructor=2), True, "", "pending", 5), (*plan(3), False, None, "pending", None)], kind)
    lessons = spark.createDataFrame([(k, p, "old", None, False, False) for k, p in ((1, 1), (2, 2), (3, 3))], "lesson_id long, plan_id long, title string, draft_title string, has_draft boolean, is_deleted boolean")
    edits = [(1, 2, 1, "a"), (1, 2, 2, "b"), (1, 7, 3, "c"), (2, 1, 1, "d"), (3, 1, 1, "e"), (3, 9, 2, "f")]
    staged = L.stage_edits(lessons, plans, spark.createDataFrame(edits, "lesson_id long, editor_id long, seq long, new_title string"), ["title"])
    assert rows(staged, "lesson_id", "title", "draft_title", "has_draft") == {(1, "old", "b", True), (2, "old", "d", True), (3, "e", None, False)}
    sent, done = L.publish_drafts(staged, plans, spark.createDataFrame([(1, 2), (2, 9), (3, 1)], "plan_id long, user_id long"), ["title"])
    assert rows(sent, "lesson_id", "title", "draft_title", "has_draft") == {(1, "b", None, False), (2, "old", "d", True), (3, "e", None, False)}
    assert rows(done, "plan_id", "title", "status", "has_title_draft") == {(1, "New", "reviewed", False), (2, "plan 2", "pending", True), (3, "plan 3", "reviewed", False)}


def test_bans_and_records(spark):
    users = spark.createDataFrame([(1, ["learner"], False, False), (2, ["instructor"], False, True), (3, ["admin", "learner"], True, True)], "user_id long, roles array<string>, is_admin boolean, is_banned boolean")
    log = [(1, "instructor", 1), (1, "ban", 2), (2, "learner", 1), (3, "instructor", 1), (3, "ban", 3), (3, "unban", 2), (9, "ban", 1)]
    got = {r.user_id: (r.roles, r.is_banned) for r in L.apply_account_changes(users, spark.createDataFrame(log, "user_id long, action string, seq long")).collect()}
    assert got == {1: (["instructor", "learner"], True), 2: (["learner"], True), 3: (["admin", "learner"], False)}
    quiz = spark.createDataFrame([(1, "a", ["x"], 1), (2, "b", ["y"], 1)], "quiz_id long, name string, questions array<string>, num_questions int")
    new = spark.createDataFrame([(1, ["p", "q"], 1), (1, [], 2), (5, ["z"], 1)], "quiz_id long, questions array<string>, seq long")
    out = L.replace_records(quiz, new, "quiz_id", F.size("questions") > 0, {"num_questions": F.size("questions")})
    assert {tuple(map(str, r)) for r in out.collect()} == {("1", "a", "['p', 'q']", "2"), ("2", "b", "['y']", "1")}


@pytest.mark.parametrize("name", ["delete", "erase"])
def test_deletions_twice_are_deletions_once(spark, sf, name):
    plans = P.view(table(spark, sf, "plans"), P.COURSES)
    same = lambda a, b: all(sorted(map(str, a[n].collect())) == sorted(map(str, b[n].select(a[n].columns).collect())) for n in a)
    if name == "delete":
        asked, lessons = P.view(table(spark, sf, "enrollments"), P.ASKED), table(spark, sf, "lessons")
        once = L.delete_plans(plans, asked, {"lessons": lessons})
        assert once["lessons"].count() < lessons.count()
        assert same(once, L.delete_plans(once["plans"], asked, {"lessons": once["lessons"]}))
    else:
        users, ids = table(spark, sf, "users"), table(spark, sf, "users").where(P.GONE).select("user_id")
        once = L.erase_users(users, ids, plans, P.view(table(spark, sf, "reviews"), P.REVIEWS), P.view(table(spark, sf, "submissions"), P.RATINGS))
        assert once["users"].count() < users.count() and once["users"].where("is_admin").count() == users.where("is_admin").count()
        assert same(once, L.erase_users(once["users"], ids, once["plans"], once["reviews"], once["ratings"]))


def test_every_kind_of_copy_is_made(spark, sf):
    got = registry.queries()["m1_copy_courses"](spark, sf).where("part = 'plans'").select(F.split("state", r"\|")[0].alias("kind")).groupBy("kind").count().collect()
    assert {r.kind for r in got} == {"import", "market", "assign", "self"}


def test_moderation_groups_the_reviews_once(spark, sf):
    """Five tables' next states read the written reviews and reports, none of them the view's own tables again."""
    out = registry.queries()["m6_apply_moderation"](spark, sf)
    assert not any("lineitem" in f for f in out.inputFiles())
    assert {r.part for r in out.select("part").distinct().collect()} == {"reports", "plans", "reviews", "ratings", "users"}
