"""Scans, predicates, joins and aggregations over the platform views, each with its DuckDB twin."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import filters as L
from ..operators import joins as J
from .registry import query

ORDERS_AS_OF = datetime(2001, 7, 31)
CATEGORIES = {"first": ["Brand#11", "Brand#12", "Brand#13"], "second": ["Brand#21", "Brand#22"]}
PROGRESS = "SELECT user_id, plan_id, count(DISTINCT day_number) AS days FROM submissions GROUP BY user_id, plan_id"


def progress(t):
    return t.submissions.groupBy("user_id", "plan_id").agg(F.count_distinct("day_number").alias("days"))


def ratings(t):
    return t.reviews.where("parent_id is null and rating is not null").select((F.col("plan_id") % 150).alias("instructor_id"), F.col("user_id").alias("learner_id"), F.col("rating").alias("stars"), "review_id", "created_at")


query("s1_scan", "SELECT plan_id, title, created_rank FROM plans WHERE is_public ORDER BY created_rank DESC, plan_id LIMIT 40 OFFSET 20")(
    lambda t: L.where_doc(t.plans, {"is_public": True}).select("plan_id", "title", "created_rank").orderBy(F.desc("created_rank"), "plan_id").offset(20).limit(40)
)
query("s2_public_view", "SELECT review_id, plan_id, user_id, rating, parent_id FROM reviews")(lambda t: L.public_view(t.reviews).select("review_id", "plan_id", "user_id", "rating", "parent_id"))
query(
    "f1_where_doc",
    "SELECT plan_id, level, duration FROM plans WHERE duration >= 3 AND duration <= 12 AND level IN ('Easy', 'basic', 'Hard') AND category NOT IN ('Brand#11') AND original_plan_id IS NULL AND len(tags) = 2 AND owner_id <> 7",
)(
    lambda t: L.where_doc(
        t.plans,
        {"duration": {"$gte": 3, "$lte": 12}, "level": {"$in": ["Easy", "basic", "Hard"]}, "category": {"$nin": ["Brand#11"]}, "original_plan_id": {"$exists": False}, "tags": {"$size": 2}, "owner_id": {"$ne": 7}},
    ).select("plan_id", "level", "duration")
)
query("f2_icontains", "SELECT user_id, full_name FROM users WHERE contains(lower(full_name), '#00000001')")(lambda t: t.users.where(L.icontains("full_name", "#00000001")).select("user_id", "full_name"))
query("f3_iregex_any", "SELECT plan_id, title FROM plans WHERE regexp_matches(title, '(?i)^[a-m].*e') OR len(list_filter(tags, lambda x: regexp_matches(x, '(?i)^[a-m].*e'))) > 0")(
    lambda t: L.iregex_any(t.plans, ["title", "tags"], "^[a-m].*e").select("plan_id", "title")
)
query("f4_or_nor", "SELECT plan_id FROM plans WHERE (owner_id = 3 OR instructor_id = 21 OR duration = 5) AND NOT (original_plan_id IS NOT NULL AND is_public)")(
    lambda t: L.where_doc(t.plans, {"$or": [{"owner_id": 3}, {"instructor_id": 21}, {"duration": 5}], "$nor": [{"original_plan_id": {"$exists": True}, "is_public": True}]}).select("plan_id")
)
query("f5_has_any", "SELECT plan_id FROM plans WHERE list_has_any(tags, ['almond', 'azure', 'beige', 'widget'])")(lambda t: t.plans.where(L.has_any("tags", ["almond", "azure", "beige", "widget"])).select("plan_id"))
query("f6_filter_category", "SELECT plan_id, category FROM plans WHERE category IN ('Brand#11', 'Brand#12', 'Brand#13')")(
    lambda t: L.filter_category(t.plans.withColumn("labels", F.array("category")), "first", CATEGORIES, "labels").select("plan_id", "category")
)
query("f7_filter_level", "SELECT plan_id, level FROM plans WHERE lower(level) IN ('medium', 'intermediate')")(lambda t: L.filter_level(t.plans, "Medium").select("plan_id", "level"))
query("f8_visible_plans", "SELECT plan_id FROM plans WHERE (owner_id = 7 OR coalesce(instructor_id = 7, false)) AND NOT is_deleted AND NOT (original_plan_id IS NOT NULL AND is_public)")(
    lambda t: L.visible_plans(t.plans, 7).select("plan_id")
)
query(
    "f9_search_quizzes",
    """SELECT plan_id, score FROM (SELECT plan_id, CAST(len(list_intersect(list_distinct(regexp_split_to_array(lower(title), '[^a-z0-9]+')), ['large', 'steel', 'part', 'widget', 'blue'])) AS INT) AS score
FROM plans WHERE is_public AND NOT is_deleted) WHERE score > 0""",
)(lambda t: L.search_quizzes(t.plans.where("is_public and not is_deleted"), "large steel part widget blue").select("plan_id", "score"))
query("f10_search_users", "SELECT user_id, full_name FROM users WHERE (contains(lower(full_name), '01') OR contains(email, '01')) AND user_id <> 1 ORDER BY user_id LIMIT 10")(
    lambda t: L.search_users(t.users, "01", 1).select("user_id", "full_name")
)
query("f11_find_user", "SELECT user_id FROM users WHERE lower(email) = 'customer#000000012@x.test' OR lower(full_name) = 'customer#000000012@x.test'")(lambda t: L.find_user(t.users, " Customer#000000012@X.test").select("user_id"))
query(
    "f12_hide_answers",
    "SELECT lesson_id, CAST(row_number() OVER (PARTITION BY lesson_id ORDER BY question_id) - 1 AS INT) AS index, question, array_to_string(options, '|') AS options, difficulty FROM questions",
)(lambda t: L.hide_answers(t.questions).withColumn("options", F.array_join("options", "|")))
query("f13_authorised", "SELECT user_id FROM users WHERE (is_instructor OR is_admin) AND NOT is_banned")(
    lambda t: L.authorised(t.users.withColumn("roles", F.array_compact(F.array(F.lit("learner"), F.when(F.col("is_instructor"), "instructor"), F.when(F.col("is_admin"), "admin")))), ["instructor", "admin"]).select("user_id")
)
query("f14_owned_by", "SELECT plan_id FROM plans WHERE owner_id = 11")(lambda t: L.owned_by(t.plans, "owner_id", 11).select("plan_id"))

query("j1_populate", "SELECT p.plan_id, u.full_name AS owner_full_name, u.email AS owner_email FROM plans p LEFT JOIN users u ON p.owner_id = u.user_id")(
    lambda t: J.populate(t.plans, "owner_id", t.users, "user_id", ["full_name", "email"], "owner").select("plan_id", "owner_full_name", "owner_email")
)
query(
    "j2_plans_by_instructor",
    "SELECT plan_id FROM plans WHERE owner_id IN (SELECT user_id FROM users WHERE contains(lower(full_name), '00000001')) OR instructor_id IN (SELECT user_id FROM users WHERE contains(lower(full_name), '00000001'))",
)(lambda t: J.plans_by_instructor(t.plans, t.users, "00000001").select("plan_id"))
query("j3_not_indexed", "SELECT lesson_id FROM lessons WHERE lesson_id NOT IN (SELECT vec_id FROM embeddings)")(
    lambda t: t.lessons.join(t.embeddings.select(F.col("vec_id").alias("lesson_id")), "lesson_id", "left_anti").select("lesson_id")
)
query("j4_with_counts", "SELECT p.plan_id, (SELECT count(*) FROM enrollments e WHERE e.plan_id = p.plan_id AND e.status = 'active') AS active_students FROM plans p")(
    lambda t: J.with_counts(t.plans, "plan_id", t.enrollments.where("status = 'active'"), "plan_id", "active_students").select("plan_id", "active_students")
)
query(
    "j5_friendship_status",
    """WITH m AS (SELECT CASE WHEN requester = 5 THEN recipient ELSE requester END AS user_id, status, requester = 5 AS mine,
 row_number() OVER (PARTITION BY CASE WHEN requester = 5 THEN recipient ELSE requester END ORDER BY updated_at DESC, friendship_id DESC) AS n FROM friendships WHERE requester = 5 OR recipient = 5)
SELECT u.user_id, coalesce(status, 'none') AS status, coalesce(mine, false) AS i_am_requester FROM users u LEFT JOIN (SELECT * FROM m WHERE n = 1) m ON u.user_id = m.user_id WHERE u.user_id <> 5""",
)(lambda t: J.friendship_status(t.users, t.friendships, 5))
query(
    "j6_friends_of",
    "SELECT friendship_id, u.user_id, updated_at, full_name FROM friendships f JOIN users u ON u.user_id = CASE WHEN requester = 5 THEN recipient ELSE requester END WHERE status = 'accepted' AND (requester = 5 OR recipient = 5)",
)(lambda t: J.friends_of(t.friendships, t.users, 5))
query(
    "j7_eligible_reviewers",
    f"""WITH g AS ({PROGRESS}), r AS (SELECT plan_id, coalesce(original_plan_id, plan_id) AS root FROM plans WHERE NOT is_deleted)
SELECT user_id, root AS plan_id, max(days) AS days FROM g JOIN r USING (plan_id) WHERE NOT EXISTS (SELECT 1 FROM reviews v WHERE v.parent_id IS NULL AND v.user_id = g.user_id AND v.plan_id = r.root)
GROUP BY user_id, root HAVING max(days) >= 2""",
)(lambda t: J.eligible_reviewers(t.plans, progress(t), t.reviews))
query("j8_latest_per", "SELECT user_id, topic, submission_id, pct FROM (SELECT *, row_number() OVER (PARTITION BY user_id, topic ORDER BY ts DESC, submission_id DESC) AS n FROM submissions) WHERE n = 1")(
    lambda t: J.latest_per(t.submissions, ["user_id", "topic"], ["ts", "submission_id"]).select("user_id", "topic", "submission_id", "pct")
)
query(
    "j9_instructor_roster",
    f"""WITH g AS ({PROGRESS}) SELECT enrollment_id, learner_id, e.plan_id, full_name, title, CAST(least(100, floor(100.0::DOUBLE * coalesce(days, 0) / duration + 0.5)) AS INT) AS percent
FROM enrollments e JOIN users u ON u.user_id = e.learner_id JOIN plans p ON p.plan_id = e.plan_id LEFT JOIN g ON g.user_id = e.learner_id AND g.plan_id = e.plan_id""",
)(lambda t: J.instructor_roster(t.enrollments, t.users, t.plans, progress(t)))
query(
    "j10_course_dashboard",
    f"""WITH g AS ({PROGRESS}), l AS (SELECT plan_id, count(*) AS lessons FROM lessons GROUP BY plan_id), s AS (SELECT plan_id, count(DISTINCT learner_id) AS students FROM enrollments WHERE status = 'active' GROUP BY plan_id),
d AS (SELECT g.plan_id, round(sum(least(100, floor(100.0::DOUBLE * days / duration + 0.5))) / count(*), 4) AS m FROM g JOIN plans p ON p.plan_id = g.plan_id GROUP BY g.plan_id)
SELECT p.plan_id, title, coalesce(lessons, 0) AS lessons, coalesce(students, 0) AS students, coalesce(m, 0.0::DOUBLE) AS mean_percent FROM plans p LEFT JOIN l ON l.plan_id = p.plan_id LEFT JOIN s ON s.plan_id = p.plan_id LEFT JOIN d ON d.plan_id = p.plan_id""",
)(lambda t: J.course_dashboard(t.plans, t.lessons, t.enrollments, progress(t)))
KNOWN = "SELECT plan_id, title, score FROM (SELECT s.plan_id, l.title, s.pct AS score, row_number() OVER (PARTITION BY s.plan_id, l.title ORDER BY s.ts DESC, s.submission_id DESC) AS n FROM submissions s JOIN lessons l ON l.plan_id = s.plan_id AND l.day_number = s.day_number) WHERE n = 1"
query(
    "j11_plan_results",
    f"""WITH k AS ({KNOWN}) SELECT lesson_id, l.plan_id, day_number, coalesce(score, 0) AS score, CASE WHEN score IS NULL THEN 'NOT_STARTED' WHEN score >= 80 THEN 'EXPERT' WHEN score < 50 THEN 'BEGINNER' ELSE 'INTERMEDIATE' END AS status
FROM lessons l LEFT JOIN k ON k.plan_id = l.plan_id AND k.title = l.title""",
)(
    lambda t: J.plan_results(
        t.lessons,
        J.latest_per(t.submissions.join(t.lessons.select("plan_id", "day_number", "title"), ["plan_id", "day_number"]), ["plan_id", "title"], ["ts", "submission_id"]).select("plan_id", "title", F.col("pct").alias("score")),
    )
)
query(
    "j12_clone_staleness",
    """WITH p AS (SELECT *, created_rank AS created_at, created_rank + 20.0::DOUBLE * (plan_id % 3) AS updated_at FROM plans)
SELECT c.original_plan_id, c.owner_id, s.updated_at > max(c.created_at) AS has_updates FROM p c JOIN p s ON s.plan_id = c.original_plan_id GROUP BY c.original_plan_id, c.owner_id, s.updated_at""",
)(lambda t: J.clone_staleness(t.plans.withColumn("created_at", F.col("created_rank")).withColumn("updated_at", F.expr("created_rank + 20.0D * (plan_id % 3)"))))
query(
    "j13_merge_drafts",
    """SELECT lesson_id, CASE WHEN lesson_id % 3 = 0 THEN coalesce(nullif(CASE WHEN lesson_id % 2 = 0 THEN 'Draft' ELSE '' END, ''), title) ELSE title END AS title, content FROM lessons""",
)(
    lambda t: J.merge_drafts(
        t.lessons.withColumn("has_draft", F.expr("lesson_id % 3 = 0")).withColumn("draft_title", F.expr("CASE WHEN lesson_id % 2 = 0 THEN 'Draft' ELSE '' END")).withColumn("draft_content", F.lit(None).cast("string"))
    )
)
query(
    "j14_student_detail",
    """SELECT s.user_id, s.plan_id, count(*) AS days, string_agg(coalesce(title, '-'), '|' ORDER BY s.day_number, coalesce(title, '-')) AS titles FROM (SELECT DISTINCT user_id, plan_id, day_number FROM submissions) s
LEFT JOIN lessons l ON l.plan_id = s.plan_id AND l.day_number = s.day_number GROUP BY s.user_id, s.plan_id""",
)(lambda t: J.student_detail(t.submissions, t.lessons))

query("g1_student_counts", "SELECT plan_id, count(*) AS students FROM enrollments WHERE status = 'active' GROUP BY plan_id")(lambda t: A.student_counts(t.enrollments))
query(
    "g2_review_summary",
    "SELECT plan_id, round(avg(rating), 1) AS avg_rating, count(*) AS total, "
    + ", ".join(f"count(*) FILTER (rating = {k}) AS star{k}" for k in range(5, 0, -1))
    + " FROM reviews WHERE parent_id IS NULL AND NOT is_deleted GROUP BY plan_id",
)(lambda t: A.review_summary(t.reviews))
query("g3_review_stats", "SELECT plan_id, round(avg(rating), 1) AS avg_rating, count(*) AS review_count FROM reviews WHERE parent_id IS NULL AND NOT is_deleted GROUP BY plan_id")(lambda t: A.review_stats(t.reviews))
query("g4_weekly_downloads", "SELECT plan_id, count(*) AS downloads FROM enrollments WHERE created_at >= TIMESTAMP '2001-07-31' - INTERVAL 7 DAYS GROUP BY plan_id")(lambda t: A.weekly_downloads(t.enrollments, ORDERS_AS_OF))
RATINGS = "SELECT plan_id % 150 AS instructor_id, user_id AS learner_id, rating AS stars, review_id, created_at FROM reviews WHERE parent_id IS NULL AND rating IS NOT NULL"
query(
    "g5_instructor_ratings",
    f"SELECT user_id, coalesce(a, 0.0::DOUBLE) AS avg_rating, coalesce(n, 0) AS rating_count FROM users LEFT JOIN (SELECT instructor_id, round(avg(stars), 1) AS a, count(*) AS n FROM ({RATINGS}) GROUP BY instructor_id) ON instructor_id = user_id WHERE is_instructor",
)(lambda t: A.instructor_ratings(t.users, ratings(t)))
query(
    "g6_dashboard_counts",
    """SELECT * FROM (SELECT count(*) FILTER (NOT is_admin) AS users, count(*) FILTER (is_instructor) AS instructors, count(*) FILTER (NOT is_instructor AND NOT is_admin) AS learners, count(*) FILTER (is_banned) AS banned FROM users) u,
(SELECT count(*) FILTER (NOT is_deleted) AS courses, count(*) FILTER (NOT is_deleted AND is_public) AS public_courses FROM plans) p""",
)(lambda t: A.dashboard_counts(t.users, t.plans))
query(
    "g7_user_detail",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY created_rank DESC, plan_id DESC) AS n FROM plans WHERE NOT is_deleted),
c AS (SELECT owner_id, count(*) AS courses, count(*) FILTER (is_public) AS public_courses, string_agg(CAST(plan_id AS VARCHAR), ',' ORDER BY n) FILTER (n <= 5) AS newest FROM r GROUP BY owner_id)
SELECT user_id, coalesce(courses, 0) AS courses, coalesce(public_courses, 0) AS public_courses, coalesce(newest, '') AS newest FROM users LEFT JOIN c ON owner_id = user_id""",
)(lambda t: A.user_detail(t.users, t.plans))
query(
    "g9_pool_breakdown",
    "SELECT lesson_id, count(*) FILTER (difficulty = 'easy') AS easy, count(*) FILTER (difficulty = 'medium') AS medium, count(*) FILTER (difficulty = 'hard') AS hard FROM questions GROUP BY lesson_id",
)(lambda t: A.pool_breakdown(t.questions))
query("g10_user_memory", "SELECT user_id, topic, count(*) AS n FROM submissions GROUP BY user_id, topic")(lambda t: A.user_memory(t.submissions))
query("g11_batch_quality", "SELECT user_id AS lesson_id, round(avg(pct), 4) AS mean_score, avg(pct) < 60 AS low FROM submissions GROUP BY user_id")(
    lambda t: A.batch_quality(t.submissions.select(F.col("user_id").alias("lesson_id"), F.col("pct").alias("score")))
)
query("g12_knowledge_map", "SELECT user_id, plan_id, topic, arg_max(pct, (ts, submission_id)) AS score FROM submissions GROUP BY user_id, plan_id, topic")(lambda t: A.knowledge_map(t.submissions))
query(
    "g13_completed_days",
    """WITH l AS (SELECT user_id, plan_id, day_number, pct FROM (SELECT *, row_number() OVER (PARTITION BY user_id, plan_id, day_number ORDER BY ts DESC, submission_id DESC) AS n FROM submissions) WHERE n = 1)
SELECT user_id, plan_id, count(*) AS n_days, string_agg(concat(CAST(day_number AS VARCHAR), ':', CAST(pct AS VARCHAR)), ',' ORDER BY day_number) AS day_scores FROM l GROUP BY user_id, plan_id""",
)(lambda t: A.completed_days(t.submissions))
query("g14_lesson_counts", "SELECT plan_id, count(*) AS lessons FROM lessons GROUP BY plan_id")(lambda t: A.lesson_counts(t.lessons))
