"""Ordered operators and rankings over the platform views, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cleaning as R
from ..operators import aggregates as A
from ..operators import windows as O
from .registry import query
from .relational import ORDERS_AS_OF
from .text import marks

query(
    "w1_paginate",
    "SELECT plan_id, title, total, CAST(ceil(total / 15) AS BIGINT) AS total_pages, 3 < ceil(total / 15) AS has_next, true AS has_prev FROM (SELECT plan_id, title, count(*) OVER () AS total FROM plans ORDER BY plan_id LIMIT 15 OFFSET 30)",
)(lambda t: O.paginate(t.plans.select("plan_id", "title"), [F.col("plan_id")], 3, 15))
query(
    "w2_attempt_numbers",
    "SELECT attempt_id, user_id, quiz_id, CAST(n AS INT) AS attempt_number, CAST(greatest(0, 4 - n) AS INT) AS remaining, n <= 3 AS allowed FROM (SELECT *, row_number() OVER (PARTITION BY user_id, quiz_id ORDER BY ts, attempt_id) AS n FROM attempts)",
)(lambda t: O.attempt_numbers(t.attempts))
query(
    "w3_progress_fold",
    """SELECT user_id, plan_id, f.a AS average_score, f.n AS quizzes, CASE WHEN f.r >= 85 THEN 'EXPERT' WHEN f.r < 60 THEN 'BEGINNER' ELSE 'INTERMEDIATE' END AS level FROM (
SELECT user_id, plan_id, list_reduce(list_prepend({'a': 0.0::DOUBLE, 'n': 0::BIGINT, 'r': 0.0::DOUBLE}, list({'a': pct::DOUBLE, 'n': -1::BIGINT, 'r': 0.0::DOUBLE} ORDER BY ts, submission_id)),
 lambda acc, x: {'a': floor((acc.a * acc.n + x.a) / (acc.n + 1) + 0.5), 'n': acc.n + 1, 'r': (acc.a * acc.n + x.a) / (acc.n + 1)}) AS f FROM submissions GROUP BY user_id, plan_id)""",
)(lambda t: O.progress_fold(t.submissions))
query(
    "w3b_progress_avg",
    "SELECT submission_id, round(avg(pct) OVER (PARTITION BY user_id, plan_id ORDER BY ts, submission_id ROWS UNBOUNDED PRECEDING), 6) AS running FROM submissions",
)(lambda t: O.progress_avg(t.submissions))
query(
    "w4_review_threads",
    """WITH r AS (SELECT *, coalesce(max(CASE WHEN NOT is_deleted THEN 1 ELSE 0 END) OVER (PARTITION BY parent_id ORDER BY created_at, review_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS later FROM reviews WHERE parent_id IS NOT NULL),
s AS (SELECT review_id, parent_id, is_deleted, row_number() OVER (PARTITION BY parent_id ORDER BY created_at, review_id) AS position FROM r WHERE NOT is_deleted OR later = 1),
c AS (SELECT parent_id AS pid, count(*) AS replies FROM s GROUP BY parent_id)
SELECT review_id, parent_id, is_deleted AS placeholder, 0::BIGINT AS position FROM reviews LEFT JOIN c ON pid = review_id WHERE parent_id IS NULL AND (NOT is_deleted OR coalesce(replies, 0) > 0)
UNION ALL SELECT review_id, parent_id, is_deleted, position FROM s""",
)(lambda t: O.review_threads(t.reviews))
REACTIONS = "SELECT event_id % 500 AS review_id, user_id, arg_max(CASE WHEN event_id % 3 = 0 THEN 'disliked' ELSE 'liked' END, (ts, event_id)) AS kind FROM events GROUP BY event_id % 500, user_id"


def reactions(t):
    kind = F.max_by(F.when(F.col("event_id") % 3 == 0, "disliked").otherwise("liked"), F.struct("ts", "event_id"))
    return t.events.groupBy((F.col("event_id") % 500).alias("review_id"), "user_id").agg(kind.alias("kind"))


query(
    "w5_reaction_view",
    f"SELECT review_id, count(*) FILTER (kind = 'liked') AS likes, count(*) FILTER (kind = 'disliked') AS dislikes, max(kind) FILTER (user_id = 7) AS mine FROM ({REACTIONS}) GROUP BY review_id",
)(lambda t: O.reaction_view(reactions(t), 7))
query(
    "w6_renumber_days",
    """WITH x AS (SELECT lesson_id, plan_id, day_number, 0 AS place FROM lessons WHERE NOT (plan_id % 4 = 0 AND day_number = 3) UNION ALL SELECT NULL, plan_id, 5, 1 FROM (SELECT DISTINCT plan_id FROM lessons WHERE plan_id % 3 = 0))
SELECT lesson_id, plan_id, row_number() OVER (PARTITION BY plan_id ORDER BY day_number, place, lesson_id NULLS LAST) AS day_number FROM x""",
)(
    lambda t: O.renumber_days(
        t.lessons,
        t.lessons.where("plan_id % 4 = 0").select("plan_id", F.lit(3).cast("long").alias("day_number"), F.lit("delete").alias("kind")).distinct()
        .union(t.lessons.where("plan_id % 3 = 0").select("plan_id", F.lit(5).cast("long"), F.lit("insert")).distinct()),
    )
)
query(
    "w7_unlock_lessons",
    """WITH d AS (SELECT DISTINCT user_id, plan_id, day_number FROM submissions), r AS (SELECT u.user_id, l.lesson_id, l.plan_id, l.day_number, d.day_number IS NOT NULL AS done FROM (SELECT DISTINCT user_id, plan_id FROM d) u JOIN lessons l USING (plan_id)
LEFT JOIN d ON d.user_id = u.user_id AND d.plan_id = l.plan_id AND d.day_number = l.day_number),
p AS (SELECT *, lag(done) OVER (PARTITION BY user_id, plan_id ORDER BY day_number, lesson_id) AS prev FROM r)
SELECT user_id, lesson_id, CASE WHEN done THEN 'completed' WHEN prev OR day_number = 1 THEN 'in-progress' ELSE 'locked' END AS status FROM p""",
)(lambda t: O.unlock_lessons(t.lessons, t.submissions))
query("w8_trim_history", "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role <> '' AND text <> '') WHERE n <= 4")(
    lambda t: O.trim_history(t.conversations.select("conv_id", "turn", "role", "text"), 4)
)
query(
    "w9_fit_budget",
    "SELECT plan_id, chunk_id FROM (SELECT *, sum(length(content)) OVER (PARTITION BY plan_id ORDER BY chunk_index ROWS UNBOUNDED PRECEDING) AS total FROM chunks) WHERE total <= 12000",
)(lambda t: O.fit_budget(t.chunks, "plan_id", rank="chunk_index").select("plan_id", "chunk_id"))
CONCEPTS = "SELECT DISTINCT plan_id, day_number, unnest(list_filter(regexp_split_to_array(lower(title), '[^a-z]+'), lambda x: length(x) >= 5)) AS concept FROM lessons"
query(
    "w10_concept_memory",
    f"SELECT plan_id, day_number, concept, min(day_number) OVER (PARTITION BY plan_id, concept) AS first_day, min(day_number) OVER (PARTITION BY plan_id, concept) < day_number AS already_taught FROM ({CONCEPTS})",
)(lambda t: O.concept_memory(t.lessons.select("plan_id", "day_number", F.explode(F.filter(F.split(F.lower("title"), "[^a-z]+"), lambda x: F.length(x) >= 5)).alias("concept"))))
query(
    "w11_uniform_cap",
    """WITH r AS (SELECT o_custkey % 5 AS k, o_orderkey, row_number() OVER (PARTITION BY o_custkey % 5 ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey % 5) AS n FROM orders),
p AS (SELECT DISTINCT k, least(CAST(floor(j * (n / 150) + 0.5) AS BIGINT), n - 1) AS i FROM (SELECT DISTINCT k, n FROM r) s, unnest(range(0, 150)) AS g(j))
SELECT r.k, o_orderkey FROM r JOIN p ON p.k = r.k AND p.i = r.i WHERE n > 150 UNION ALL SELECT k, o_orderkey FROM r WHERE n <= 150""",
)(lambda t: O.uniform_cap(t.orders.select((F.col("o_custkey") % 5).alias("k"), "o_orderkey"), "k", "o_orderkey"))
query("w12_keep_first", "SELECT lesson_id FROM (SELECT *, row_number() OVER (PARTITION BY lower(substring(content, 1, 80)) ORDER BY lesson_id) AS n FROM lessons) WHERE n = 1")(
    lambda t: O.keep_first(t.lessons, F.lower(F.substring("content", 1, 80)), [], [F.col("lesson_id")]).select("lesson_id")
)
query(
    "w13_disambiguate_titles",
    """SELECT plan_id, day_number, concat(word, array_to_string(list_transform(range(2, n + 1), lambda k: concat(' (', CAST(k AS VARCHAR), ')')), '')) AS title FROM
(SELECT *, row_number() OVER (PARTITION BY plan_id, word ORDER BY day_number) AS n FROM (SELECT o_custkey AS plan_id, o_orderkey AS day_number, o_orderpriority AS word FROM orders))""",
)(
    lambda t: O.disambiguate_titles(t.orders.select(F.col("o_custkey").alias("plan_id"), F.col("o_orderkey").alias("day_number"), F.col("o_orderpriority").alias("title")), F.col("title"))
)
query("w14_manual_course", "SELECT plan_id, CAST(unnest(range(1, greatest(1, least(30, coalesce(nullif(duration - 1, 0), 7))) + 1)) AS INT) AS day_number FROM plans")(
    lambda t: O.manual_course(t.plans.select("plan_id", (F.col("duration") - 1).alias("days")))
)
query(
    "o1_market_courses",
    """WITH s AS (SELECT plan_id, count(*) AS students FROM enrollments WHERE status = 'active' GROUP BY plan_id), v AS (SELECT plan_id, round(avg(rating), 1) AS a, count(*) AS c FROM reviews WHERE parent_id IS NULL AND NOT is_deleted GROUP BY plan_id),
d AS (SELECT plan_id, count(*) AS downloads FROM enrollments WHERE created_at >= TIMESTAMP '2001-07-31' - INTERVAL 7 DAYS GROUP BY plan_id)
SELECT p.plan_id, created_rank, coalesce(students, 0) AS students, coalesce(a, 0.0::DOUBLE) AS avg_rating, coalesce(c, 0) AS review_count, coalesce(downloads, 0) AS downloads FROM plans p LEFT JOIN s ON s.plan_id = p.plan_id LEFT JOIN v ON v.plan_id = p.plan_id LEFT JOIN d ON d.plan_id = p.plan_id
WHERE is_public AND NOT is_deleted ORDER BY students DESC, p.plan_id LIMIT 40""",
)(
    lambda t: O.market_courses(t.plans, A.student_counts(t.enrollments), A.review_stats(t.reviews), A.weekly_downloads(t.enrollments, ORDERS_AS_OF)).orderBy(F.desc("students"), "plan_id").limit(40)
)
query("o2_recent_courses", "SELECT plan_id, created_rank FROM plans WHERE is_public AND NOT is_deleted ORDER BY created_rank DESC, plan_id LIMIT 5")(
    lambda t: t.plans.where("is_public and not is_deleted").select("plan_id", "created_rank").orderBy(F.desc("created_rank"), "plan_id").limit(5)
)
query(
    "o3_instructor_directory",
    """SELECT user_id, full_name, coalesce(a, 0.0::DOUBLE) AS avg_rating, coalesce(n, 0) AS rating_count FROM users LEFT JOIN (SELECT plan_id % 150 AS i, round(avg(rating), 1) AS a, count(*) AS n FROM reviews WHERE parent_id IS NULL AND rating IS NOT NULL GROUP BY plan_id % 150) ON i = user_id
WHERE is_instructor AND interest IN ('BUILDING', 'MACHINERY') AND contains(lower(full_name), 'customer')""",
)(
    lambda t: A.instructor_ratings(t.users, t.reviews.where("parent_id is null and rating is not null").select((F.col("plan_id") % 150).alias("instructor_id"), F.col("rating").alias("stars")))
    .join(t.users.where(F.col("interest").isin("BUILDING", "MACHINERY") & F.contains(F.lower("full_name"), F.lit("customer"))).select("user_id", "full_name"), "user_id")
)
NORMAL_TAG = f"regexp_replace(trim(regexp_replace({marks('x')}, '[^a-z0-9\\s]', '', 'g')), '\\s+', '_', 'g')"
TAGS = f"list_concat(list_transform(tags, lambda x: lower(trim(x))), list_transform(tags, lambda x: {NORMAL_TAG}))"
NOISE = ", ".join(f"'{w}'" for w in R.NOISE)
query(
    "o4_recommend_courses",
    rf"""WITH l AS (SELECT * FROM plans WHERE is_public AND NOT is_deleted), o AS (SELECT *, owner_id AS user_id FROM plans WHERE NOT is_deleted),
mem AS (SELECT user_id, lower(trim(topic)) AS topic FROM (SELECT user_id, topic, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, topic) AS n FROM submissions GROUP BY user_id, topic) WHERE n <= 10),
tp AS (SELECT DISTINCT * FROM (SELECT user_id, topic FROM mem UNION ALL SELECT user_id, unnest(list_filter(list_transform(regexp_split_to_array(title, '[\s,\-.()\[\]/]+'), lambda x: lower(trim(x))), lambda x: length(x) >= 2 AND x NOT IN ({NOISE}))) FROM o) WHERE topic <> ''),
tg AS (SELECT DISTINCT user_id, unnest({TAGS}) AS tag FROM o), nm AS (SELECT d.topic, plan_id FROM (SELECT DISTINCT topic FROM tp) d JOIN l ON contains(lower(l.title), d.topic)),
pts AS (SELECT c.user_id, l.plan_id, 3 AS w FROM (SELECT DISTINCT user_id, category FROM o) c JOIN l ON l.category = c.category UNION ALL SELECT tg.user_id, x.plan_id, 2 FROM tg JOIN (SELECT plan_id, unnest({TAGS}) AS tag FROM l) x ON x.tag = tg.tag UNION ALL SELECT tp.user_id, nm.plan_id, 1 FROM tp JOIN nm ON nm.topic = tp.topic),
sc AS (SELECT user_id, plan_id, sum(w) AS score FROM pts GROUP BY user_id, plan_id), f AS (SELECT user_id, plan_id, score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY plan_id) AS n FROM sc) WHERE n <= 40),
few AS (SELECT user_id FROM users WHERE user_id NOT IN (SELECT user_id FROM f GROUP BY user_id HAVING count(*) >= 6)), nw AS (SELECT plan_id FROM l ORDER BY created_rank DESC, plan_id LIMIT 30),
a AS (SELECT user_id, plan_id, score FROM f UNION ALL SELECT user_id, plan_id, 0 FROM few, nw WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.user_id = few.user_id AND f.plan_id = nw.plan_id)),
s AS (SELECT plan_id, count(*) AS students FROM enrollments WHERE status = 'active' GROUP BY plan_id), v AS (SELECT plan_id, round(avg(rating), 1) AS r FROM reviews WHERE parent_id IS NULL AND NOT is_deleted GROUP BY plan_id)
SELECT user_id, plan_id, CAST(score AS BIGINT) AS score, CAST(place AS INT) AS place FROM (SELECT a.*, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, coalesce(students, 0) DESC, coalesce(r, 0.0) DESC, a.plan_id) AS place FROM a LEFT JOIN s ON s.plan_id = a.plan_id LEFT JOIN v ON v.plan_id = a.plan_id) WHERE place <= 10""",
)(
    lambda t: O.recommend_courses(t.users, t.plans, t.submissions.groupBy("user_id", "topic").agg(F.count("*").alias("count")), A.student_counts(t.enrollments), A.review_stats(t.reviews))
)
query("o2_top_instructors", "SELECT user_id, coalesce(a, 0.0::DOUBLE) AS avg_rating FROM users LEFT JOIN (SELECT plan_id % 150 AS i, round(avg(rating), 1) AS a FROM reviews WHERE parent_id IS NULL AND rating IS NOT NULL GROUP BY plan_id % 150) ON i = user_id WHERE is_instructor ORDER BY 2 DESC, 1 LIMIT 5")(
    lambda t: A.instructor_ratings(t.users, t.reviews.where("parent_id is null and rating is not null").select((F.col("plan_id") % 150).alias("instructor_id"), F.col("rating").alias("stars")))
    .select("user_id", "avg_rating").orderBy(F.desc("avg_rating"), "user_id").limit(5)
)
query("g15_replies_by_parent", "SELECT parent_id, string_agg(CAST(review_id AS VARCHAR), ',' ORDER BY created_at, review_id) AS replies FROM reviews WHERE parent_id IS NOT NULL GROUP BY parent_id")(
    lambda t: O.replies_by_parent(t.reviews).select("parent_id", F.array_join("replies", ",").alias("replies"))
)
query("o5_list_by", "SELECT enrollment_id, plan_id, created_at FROM enrollments WHERE learner_id = 7 ORDER BY created_at DESC, enrollment_id")(
    lambda t: t.enrollments.where("learner_id = 7").select("enrollment_id", "plan_id", "created_at").orderBy(F.desc("created_at"), "enrollment_id")
)
query(
    "o7_filter_by_score",
    "SELECT plan_id, chunk_id, CAST(rank AS INT) AS rank FROM (SELECT plan_id, chunk_id, length(content) * 1.0::DOUBLE AS score, row_number() OVER (PARTITION BY plan_id ORDER BY length(content) DESC, chunk_id) AS rank FROM chunks) WHERE score >= 5000 OR rank <= 3",
)(lambda t: O.filter_by_score(t.chunks.withColumn("score", F.length("content").cast("double")), "plan_id", 5000, 3).select("plan_id", "chunk_id", "rank"))
query(
    "o8_select_diverse",
    r"""WITH h AS (SELECT plan_id, chunk_id, content, chunk_id % 3 = 0 AS used, length(content) AS score FROM chunks),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY plan_id, lower(substring(trim(regexp_replace(content, '\s+', ' ', 'g')), 1, 80)) ORDER BY used, score DESC, chunk_id) AS n FROM h) WHERE n = 1)
SELECT plan_id, chunk_id, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY used, score DESC, chunk_id) AS rank FROM f) WHERE rank <= 6""",
)(lambda t: O.select_diverse(t.chunks.select("plan_id", "chunk_id", "content", (F.col("chunk_id") % 3 == 0).alias("used"), F.length("content").alias("score")), "plan_id", 6).select("plan_id", "chunk_id", "rank"))
query(
    "o10_select_adaptive",
    """WITH l AS (SELECT user_id, lesson_id, CASE WHEN user_id % 3 = 0 THEN 'BEGINNER' WHEN user_id % 3 = 1 THEN 'INTERMEDIATE' ELSE 'EXPERT' END AS level FROM (SELECT DISTINCT user_id, event_id % 50 AS lesson_id FROM events)),
q AS (SELECT l.user_id, l.lesson_id, level, question_id, difficulty, md5(concat('s:', CAST(user_id AS VARCHAR), ':', CAST(question_id AS VARCHAR))) AS o FROM l JOIN questions USING (lesson_id)),
m AS (SELECT *, row_number() OVER (PARTITION BY user_id, lesson_id, difficulty ORDER BY o) <= floor(5 * CASE level WHEN 'BEGINNER' THEN CASE difficulty WHEN 'easy' THEN 0.6 WHEN 'medium' THEN 0.3 ELSE 0.1 END WHEN 'INTERMEDIATE' THEN CASE difficulty WHEN 'easy' THEN 0.2 WHEN 'medium' THEN 0.5 ELSE 0.3 END ELSE CASE difficulty WHEN 'easy' THEN 0.1 WHEN 'medium' THEN 0.3 ELSE 0.6 END END + 0.5) AS inq FROM q),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, lesson_id ORDER BY inq DESC, o) AS place FROM m) WHERE place <= 5)
SELECT user_id, lesson_id, question_id, CAST(row_number() OVER (PARTITION BY user_id, lesson_id ORDER BY o) AS INT) AS position FROM p""",
)(
    lambda t: O.select_adaptive(
        t.questions,
        t.events.select("user_id", (F.col("event_id") % 50).alias("lesson_id")).distinct().withColumn("level", F.expr("CASE WHEN user_id % 3 = 0 THEN 'BEGINNER' WHEN user_id % 3 = 1 THEN 'INTERMEDIATE' ELSE 'EXPERT' END")),
        5,
        "s",
    )
)
