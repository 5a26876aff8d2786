"""Table mutations and set operations over the platform views, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mutations as M
from .registry import query

query(
    "m2_publish",
    "SELECT p.plan_id, c.copy_id, CASE WHEN c.copy_id IS NULL THEN 'create' ELSE 'update' END AS action FROM plans p LEFT JOIN (SELECT original_plan_id, min(plan_id) AS copy_id FROM plans WHERE original_plan_id IS NOT NULL AND is_public GROUP BY original_plan_id) c ON c.original_plan_id = p.plan_id",
)(lambda t: M.publish(t.plans, t.plans.select("plan_id")))
query(
    "m3_upsert_enrollments",
    "SELECT learner_id, plan_id, status FROM (SELECT *, row_number() OVER (PARTITION BY learner_id, plan_id ORDER BY nw DESC, created_at DESC, enrollment_id DESC) AS n FROM (SELECT learner_id, plan_id, CASE WHEN enrollment_id % 3 = 0 THEN 'active' ELSE status END AS status, created_at, enrollment_id, CASE WHEN enrollment_id % 3 = 0 THEN 1 ELSE 0 END AS nw FROM enrollments)) WHERE n = 1",
)(
    lambda t: M.upsert(t.enrollments.where("enrollment_id % 3 <> 0"), t.enrollments.where("enrollment_id % 3 = 0").withColumn("status", F.lit("active")), ["learner_id", "plan_id"], ["created_at", "enrollment_id"]).select("learner_id", "plan_id", "status")
)
ANSWER = "s.status = 'pending' AND x.actor <> s.asker AND x.action"
query(
    "m9_friendships",
    f"""WITH l AS (SELECT event_id AS seq, user_id % 40 AS actor, event_id % 40 AS other, ['request', 'accept', 'reject', 'cancel', 'unfriend'][CAST(event_id % 5 + 1 AS INT)] AS action FROM events),
p AS (SELECT least(actor, other) AS a, greatest(actor, other) AS b, list({{'actor': actor, 'action': action, 'status': '', 'asker': CAST(NULL AS BIGINT)}} ORDER BY seq) AS log FROM l WHERE actor <> other GROUP BY 1, 2),
f AS (SELECT a, b, list_reduce(list_prepend({{'actor': CAST(0 AS BIGINT), 'action': '', 'status': 'none', 'asker': CAST(NULL AS BIGINT)}}, log), lambda s, x: {{'actor': x.actor, 'action': x.action,
'status': CASE WHEN x.action = 'request' AND s.status IN ('none', 'rejected') THEN 'pending' WHEN {ANSWER} = 'accept' THEN 'accepted' WHEN {ANSWER} = 'reject' THEN 'rejected'
WHEN s.status = 'pending' AND x.actor = s.asker AND x.action = 'cancel' OR s.status = 'accepted' AND x.action = 'unfriend' THEN 'none' ELSE s.status END,
'asker': CASE WHEN x.action = 'request' AND s.status IN ('none', 'rejected') THEN x.actor WHEN s.status = 'pending' AND x.actor = s.asker AND x.action = 'cancel' OR s.status = 'accepted' AND x.action = 'unfriend' THEN NULL ELSE s.asker END}}) AS r FROM p)
SELECT a, b, r.status AS status, r.asker AS requester FROM f WHERE r.status <> 'none'""",
)(
    lambda t: M.friendships(
        t.events.select(F.col("event_id").alias("seq"), (F.col("user_id") % 40).alias("actor"), (F.col("event_id") % 40).alias("other"), F.element_at(F.array(*[F.lit(a) for a in ("request", "accept", "reject", "cancel", "unfriend")]), (F.col("event_id") % 5 + 1).cast("int")).alias("action"))
    )
)
query(
    "m10_ratings",
    "SELECT instructor_id, learner_id, stars FROM (SELECT *, row_number() OVER (PARTITION BY instructor_id, learner_id ORDER BY seq DESC) AS n FROM (SELECT user_id % 30 AS instructor_id, event_id % 90 AS learner_id, CASE WHEN event_id % 9 > 0 THEN event_id % 7 END AS stars, event_id AS seq FROM events) WHERE instructor_id <> learner_id AND (stars IS NULL OR stars BETWEEN 1 AND 5)) WHERE n = 1 AND stars IS NOT NULL",
)(
    lambda t: M.ratings(t.events.select((F.col("user_id") % 30).alias("instructor_id"), (F.col("event_id") % 90).alias("learner_id"), F.when(F.col("event_id") % 9 > 0, F.col("event_id") % 7).alias("stars"), F.col("event_id").alias("seq"))).select("instructor_id", "learner_id", "stars")
)
query(
    "m11_accept_reviews",
    """WITH e AS (SELECT DISTINCT learner_id AS user_id, plan_id FROM enrollments) SELECT review_id, parent_id, rating FROM (SELECT r.*, row_number() OVER (PARTITION BY r.user_id, r.plan_id ORDER BY created_at, review_id) AS n FROM reviews r JOIN e ON e.user_id = r.user_id AND e.plan_id = r.plan_id WHERE parent_id IS NULL AND rating BETWEEN 1 AND 5) WHERE n = 1
UNION ALL SELECT review_id, parent_id, NULL FROM reviews WHERE parent_id IS NOT NULL""",
)(lambda t: M.accept_reviews(t.reviews, t.enrollments.select(F.col("learner_id").alias("user_id"), "plan_id")))
query("u1_top_up", "SELECT plan_id, created_rank FROM plans WHERE duration = 5 OR category = 'Brand#11'")(
    lambda t: M.top_up(t.plans.where("duration = 5").select("plan_id", "created_rank"), t.plans.where("category = 'Brand#11'").select("plan_id", "created_rank"), "plan_id")
)
query("u2_merge_concepts", "SELECT plan_id, array_to_string(list_sort(list_distinct(list_transform(list_concat(tags, [category, 'Blue']), lambda x: upper(x)))), ',') AS concepts FROM plans")(
    lambda t: t.plans.withColumn("more", F.array("category", F.lit("Blue"))).select("plan_id", F.array_join(F.array_sort(M.merge_concepts("tags", "more")), ",").alias("concepts"))
)
query(
    "u5_reactions",
    """WITH s AS (SELECT review_id, user_id, list_reduce(list_prepend('', list(kind ORDER BY seq)), lambda a, x: CASE WHEN a = x THEN '' ELSE x END) AS kind FROM (SELECT event_id % 500 AS review_id, user_id % 7 AS user_id, CASE WHEN event_id % 3 = 0 THEN 'dislike' ELSE 'like' END AS kind, event_id AS seq FROM events) GROUP BY review_id, user_id)
SELECT review_id, count(*) FILTER (kind = 'like') AS likes, count(*) FILTER (kind = 'dislike') AS dislikes FROM s GROUP BY review_id""",
)(lambda t: M.reactions(t.events.select((F.col("event_id") % 500).alias("review_id"), (F.col("user_id") % 7).alias("user_id"), F.when(F.col("event_id") % 3 == 0, "dislike").otherwise("like").alias("kind"), F.col("event_id").alias("seq"))))
query(
    "u6_apply_shares",
    "SELECT plan_id, string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY user_id) AS shared_with FROM (SELECT *, row_number() OVER (PARTITION BY plan_id, user_id ORDER BY enrollment_id DESC) AS n FROM (SELECT plan_id, learner_id AS user_id, enrollment_id FROM enrollments)) WHERE n = 1 AND enrollment_id % 3 > 0 GROUP BY plan_id",
)(
    lambda t: M.apply_shares(t.enrollments.select("plan_id", F.col("learner_id").alias("user_id"), F.when(F.col("enrollment_id") % 3 > 0, "share").otherwise("unshare").alias("action"), F.col("enrollment_id").alias("seq"))).select(
        "plan_id", F.array_join(F.transform("shared_with", lambda x: x.cast("string")), ",").alias("shared_with")
    )
)
query("u7_toggle_tag", "SELECT plan_id, array_to_string(CASE WHEN plan_id % 5 <> 0 THEN tags WHEN list_contains(tags, 'blue') THEN list_filter(tags, lambda x: x <> 'blue') ELSE list_append(tags, 'blue') END, ',') AS tags FROM plans")(
    lambda t: M.toggle_tag(t.plans, t.plans.where("plan_id % 5 = 0"), "blue").select("plan_id", F.array_join("tags", ",").alias("tags"))
)
query("s15_lessons_needing_pool", "SELECT l.lesson_id, coalesce(n, 0) AS pool FROM lessons l LEFT JOIN (SELECT lesson_id, count(*) AS n FROM questions GROUP BY lesson_id) q ON q.lesson_id = l.lesson_id WHERE coalesce(n, 0) < 5")(
    lambda t: t.lessons.join(t.questions.groupBy("lesson_id").agg(F.count("*").alias("pool")), "lesson_id", "left").select("lesson_id", F.coalesce("pool", F.lit(0)).cast("long").alias("pool")).where("pool < 5")
)
