"""Copies, deletions, moderation, visibility, drafts and account changes over all the tables that they touch, each with its DuckDB twin.

A result has the rows of every table: part (the table), id and state (its columns, joined by |).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import lifecycle as L
from ..sources.files import written
from .registry import query

#: Columns over the platform views, in SQL that both engines read; {A} and {Z} open and close an array.
COURSES = [
    "plan_id", "title", "level", "owner_id", "instructor_id", "is_public", "is_deleted", "original_plan_id", "CASE WHEN original_plan_id IS NOT NULL THEN 'imported' ELSE 'self' END AS source_type",
    "{A}plan_id % 11 + 300, plan_id % 7 + 310{Z} AS shared_with", "plan_id % 4 = 0 AS deleted_by_owner", "plan_id % 6 = 0 AS deleted_by_instructor", "plan_id % 5 = 0 AS has_title_draft",
    "CASE WHEN plan_id % 5 = 0 THEN CASE WHEN plan_id % 10 = 0 THEN '' ELSE concat('Draft of ', title) END END AS draft_title", "'pending' AS status", "CASE WHEN plan_id % 2 = 0 THEN plan_id + 1 END AS student_id",
]
LESSONS = [
    "lesson_id", "plan_id", "day_number", "title", "md5(content) AS content", "CASE WHEN lesson_id % 3 = 0 THEN 'A summary' END AS summary", "CASE WHEN day_number < 4 THEN 'completed' ELSE 'locked' END AS status", "lesson_id % 11 = 0 AS is_deleted",
    "lesson_id % 2 = 0 AS has_draft", "CASE WHEN lesson_id % 2 = 0 AND lesson_id % 3 > 0 THEN CASE WHEN lesson_id % 3 = 1 THEN '' ELSE 'Draft title' END END AS draft_title",
    "CASE WHEN lesson_id % 4 = 0 THEN 'Draft content' END AS draft_content", "CASE WHEN lesson_id % 8 = 0 THEN 'Draft summary' END AS draft_summary",
]
REVIEWS = ["review_id", "parent_id", "user_id", "plan_id", "is_deleted", "concat('Words of ', CAST(user_id AS STRING)) AS content", "{A}user_id + 1, review_id % 13, review_id % 40{Z} AS likes", "{A}review_id % 9, user_id{Z} AS dislikes"]
RATINGS = ["submission_id AS rating_id", "submission_id % 30 AS instructor_id", "user_id AS learner_id", "1 + pct % 5 AS stars"]
PEOPLE = ["user_id", "full_name", "is_admin", "is_banned", "CASE WHEN is_instructor THEN 4.5 ELSE 0.0 END AS avg_rating", "CAST(9 AS BIGINT) AS rating_count"]


def view(df: DataFrame, exprs: list[str]) -> DataFrame:
    return df.selectExpr(*[e.format(A="array(", Z=")") for e in exprs])


def sub(name: str, exprs: list[str]) -> str:
    return f"SELECT {', '.join(e.format(A='[', Z=']') for e in exprs)} FROM {name}".replace("AS STRING", "AS VARCHAR").replace("4.5 ELSE 0.0", "4.5::DOUBLE ELSE 0.0::DOUBLE")


def state(*columns: str) -> str:
    """The columns as one text, in SQL that both engines read."""
    return "concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS STRING), '-')" for c in columns) + ")"


def listed(column: str) -> str:
    return f"array_join(transform(array_sort({column}), x -> cast(x as string)), ',')"


def listed_duck(column: str) -> str:
    return f"array_to_string(list_sort({column}), ',')"


def shown(**parts: tuple[DataFrame, str, tuple[str, ...]]) -> DataFrame:
    return L.union_of({n: d.selectExpr(f"{key} AS id", f"{state(*columns)} AS state") for n, (d, key, columns) in parts.items()})


def rows_of(**parts: tuple[str, str, tuple[str, ...]]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS part, CAST({key} AS BIGINT) AS id, {state(*columns).replace('AS STRING', 'AS VARCHAR')} AS state FROM {name}" for n, (name, key, columns) in parts.items())


# ---- M1
KINDS = ["enrollment_id AS request_id", "plan_id", "CASE WHEN enrollment_id % 3 = 0 THEN learner_id ELSE plan_id % 150 END AS user_id", "CASE WHEN enrollment_id % 4 = 0 THEN 'import' WHEN enrollment_id % 4 = 1 THEN 'market' WHEN enrollment_id % 4 = 2 THEN 'assign' ELSE 'self' END AS kind", "CASE WHEN enrollment_id % 9 > 0 THEN enrollment_id % 6 END AS instructor_id"]
NEW = ("kind", "source_id", "owner_id", "instructor_id", "title", "level", "original_plan_id", "is_public", "source_type", "status")
COPIED = ("source_lesson_id", "day_number", "title", "content", "summary", "status", "has_draft")
COPIES = f"""WITH p AS ({sub('plans', COURSES)}), l AS ({sub('lessons', LESSONS)}), q AS ({sub('enrollments', KINDS)}),
a AS (SELECT q.request_id, q.user_id, q.kind, q.instructor_id AS dest, p.* FROM q JOIN p ON p.plan_id = q.plan_id WHERE
  kind = 'import' OR (kind = 'market' AND q.user_id = p.owner_id AND NOT p.is_deleted AND NOT EXISTS (SELECT 1 FROM p c WHERE c.original_plan_id = p.plan_id AND c.is_public))
  OR (kind = 'assign' AND q.instructor_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM p c WHERE c.original_plan_id = p.plan_id AND c.instructor_id = q.instructor_id AND c.owner_id = q.user_id))
  OR (kind = 'self' AND (q.user_id = p.owner_id OR q.user_id = p.instructor_id))),
b AS (SELECT *, row_number() OVER (PARTITION BY kind, plan_id, CASE WHEN kind = 'assign' THEN user_id END, CASE WHEN kind = 'assign' THEN dest END ORDER BY request_id) AS nth FROM a),
n AS (SELECT 1000000 + request_id AS new_plan_id, plan_id AS source_id, kind, user_id AS owner_id, CASE WHEN kind = 'self' THEN concat(title, ' (Bản sao)') ELSE title END AS title, level,
  CASE kind WHEN 'market' THEN instructor_id WHEN 'assign' THEN dest END AS instructor_id, CASE WHEN kind = 'self' THEN original_plan_id ELSE plan_id END AS original_plan_id,
  CASE kind WHEN 'import' THEN false WHEN 'market' THEN true ELSE is_public END AS is_public, CASE kind WHEN 'import' THEN CASE WHEN is_public THEN 'imported' ELSE 'shared_import' END WHEN 'assign' THEN 'assigned' WHEN 'self' THEN 'self' ELSE source_type END AS source_type,
  CASE kind WHEN 'assign' THEN 'teaching' WHEN 'market' THEN status ELSE 'pending' END AS status FROM b WHERE nth = 1 OR kind IN ('import', 'self')),
c AS (SELECT new_plan_id, lesson_id AS source_lesson_id, day_number,
  CASE WHEN kind IN ('market', 'self') AND has_draft AND draft_title <> '' THEN draft_title ELSE l.title END AS title, CASE WHEN kind IN ('market', 'self') AND has_draft AND draft_content <> '' THEN draft_content ELSE content END AS content,
  CASE WHEN kind = 'self' AND has_draft AND draft_summary <> '' THEN draft_summary ELSE summary END AS summary, CASE WHEN kind <> 'import' THEN l.status WHEN day_number = 1 THEN 'in-progress' ELSE 'locked' END AS status, has_draft AND kind IN ('import', 'assign') AS has_draft
  FROM n JOIN l ON l.plan_id = n.source_id WHERE NOT is_deleted)
{rows_of(plans=('n', 'new_plan_id', NEW), lessons=('c', 'new_plan_id', COPIED))}"""


@query("m1_copy_courses", COPIES)
def copy_courses(t):
    new, lessons = L.copy_courses(view(t.plans, COURSES), view(t.lessons, LESSONS), view(t.enrollments, KINDS), 1_000_000)
    return shown(plans=(new, "new_plan_id", NEW), lessons=(lessons, "new_plan_id", COPIED))


# ---- M4
ASKED = ["plan_id", "CASE enrollment_id % 5 WHEN 0 THEN plan_id % 150 WHEN 1 THEN (plan_id * 7) % 150 WHEN 2 THEN plan_id % 11 + 300 ELSE learner_id END AS user_id", "enrollment_id"]
TABLES = {"lessons": "lesson_id", "chunks": "chunk_id", "enrollments": "enrollment_id", "reviews": "review_id", "submissions": "submission_id"}
PURGED = f"""WITH p AS ({sub('plans', COURSES)}), q AS (SELECT DISTINCT plan_id, user_id FROM ({sub('enrollments', ASKED)}) WHERE enrollment_id % 3 = 0),
a AS (SELECT p.*, q.user_id FROM p JOIN q ON q.plan_id = p.plan_id WHERE NOT (is_public AND original_plan_id IS NOT NULL)),
m AS (SELECT plan_id, max(CASE WHEN user_id = owner_id THEN 1 ELSE 0 END) AS o, max(CASE WHEN user_id = instructor_id THEN 1 ELSE 0 END) AS i,
  list(user_id) FILTER (list_contains(shared_with, user_id) AND user_id <> owner_id AND (instructor_id IS NULL OR user_id <> instructor_id)) AS gone FROM a GROUP BY plan_id),
n AS (SELECT p.* REPLACE (deleted_by_owner OR coalesce(o, 0) = 1 AS deleted_by_owner, deleted_by_instructor OR coalesce(i, 0) = 1 AS deleted_by_instructor, list_filter(shared_with, lambda x: NOT list_contains(coalesce(gone, []), x)) AS shared_with), coalesce(o, 0) + coalesce(i, 0) > 0 AS touched
  FROM p LEFT JOIN m ON m.plan_id = p.plan_id), g AS (SELECT plan_id FROM n WHERE touched AND deleted_by_owner AND (instructor_id IS NULL OR deleted_by_instructor))
{rows_of(plans=('n WHERE plan_id NOT IN (SELECT plan_id FROM g)', 'plan_id', (listed_duck('shared_with'), 'deleted_by_owner', 'deleted_by_instructor')), **{n: (f'{n} WHERE plan_id NOT IN (SELECT plan_id FROM g)', key, ('plan_id',)) for n, key in TABLES.items()})}"""


@query("m4_purge_plans", PURGED)
def purge_plans(t):
    out = L.delete_plans(view(t.plans, COURSES), view(t.enrollments, ASKED).where("enrollment_id % 3 = 0"), {n: getattr(t, n) for n in TABLES})
    return shown(plans=(out["plans"], "plan_id", (listed("shared_with"), "deleted_by_owner", "deleted_by_instructor")), **{n: (out[n], key, ("plan_id",)) for n, key in TABLES.items()})


# ---- M5
GONE = "user_id % 9 = 1 OR is_admin"
LIKED = ("user_id", listed("likes"), listed("dislikes"))
ERASED = f"""WITH g AS (SELECT user_id FROM users WHERE user_id % 9 = 1 AND NOT is_admin), p AS ({sub('plans', COURSES)}), r AS ({sub('reviews', REVIEWS)}), v AS ({sub('submissions', RATINGS)})
{rows_of(users=('users WHERE user_id NOT IN (SELECT user_id FROM g)', 'user_id', ('email',)),
         plans=('(SELECT plan_id, is_deleted OR owner_id IN (SELECT user_id FROM g) AS d, deleted_by_owner OR owner_id IN (SELECT user_id FROM g) AS o FROM p)', 'plan_id', ('d', 'o')),
         reviews=('(SELECT review_id, CASE WHEN NOT list_contains(ids, user_id) THEN user_id END AS u, list_filter(likes, lambda x: NOT list_contains(ids, x)) AS a, list_filter(dislikes, lambda x: NOT list_contains(ids, x)) AS b FROM r, (SELECT list(user_id) AS ids FROM g))', 'review_id', ('u', listed_duck('a'), listed_duck('b'))),
         ratings=('(SELECT rating_id, stars, CASE WHEN learner_id NOT IN (SELECT user_id FROM g) THEN learner_id END AS u FROM v)', 'rating_id', ('u', 'stars')))}"""


@query("m5_erase_users", ERASED)
def erase_users(t):
    out = L.erase_users(t.users, t.users.where(GONE).select("user_id"), view(t.plans, COURSES), view(t.reviews, REVIEWS), view(t.submissions, RATINGS))
    return shown(users=(out["users"], "user_id", ("email",)), plans=(out["plans"], "plan_id", ("is_deleted", "deleted_by_owner")), reviews=(out["reviews"], "review_id", LIKED), ratings=(out["ratings"], "rating_id", ("learner_id", "stars")))


# ---- M6
REPORTS = [
    "event_id AS report_id", "CASE event_id % 4 WHEN 0 THEN 'course' WHEN 1 THEN 'instructorRating' WHEN 2 THEN 'review' ELSE CASE WHEN event_id % 32 = 3 THEN 'other' ELSE 'review' END END AS target_type",
    "CASE WHEN event_id % 4 = 0 THEN event_id % 90 WHEN event_id % 4 = 1 THEN event_id % 200 ELSE (event_id % 60) * 10 + 1 + event_id % 3 END AS target_id", "user_id % 20 AS reported_by", "CASE WHEN event_id % 50 > 0 THEN 'spam' ELSE '' END AS reason",
]
DECIDED = ["event_id + 5000000 AS seq", "event_id - event_id % 3 AS report_id", "CASE WHEN event_id % 5 < 2 THEN 'resolve' ELSE 'dismiss' END AS action", "CASE WHEN event_id % 6 < 5 THEN 97 ELSE 5 END AS actor"]
REPORTED = ("status", "snapshot", "snapshot_author")
MODERATED = f"""WITH p AS ({sub('plans', COURSES)}), r AS ({sub('reviews', REVIEWS)}), v AS ({sub('submissions', RATINGS)}), u AS ({sub('users', PEOPLE)}), e AS ({sub('events', REPORTS)}), d AS ({sub('events', DECIDED)}),
k AS (SELECT e.*, CASE WHEN target_type <> 'other' AND reason <> '' AND report_id = min(CASE WHEN reason <> '' THEN report_id END) OVER (PARTITION BY target_type, target_id, reported_by) THEN 'pending' ELSE 'rejected' END AS first FROM e),
w AS (SELECT k.*, coalesce(p.title, r.content, CAST(v.stars AS VARCHAR)) AS snapshot, coalesce(u1.full_name, u2.full_name, u3.full_name) AS snapshot_author FROM k
  LEFT JOIN p ON target_type = 'course' AND p.plan_id = target_id LEFT JOIN u u1 ON u1.user_id = p.owner_id LEFT JOIN r ON target_type = 'review' AND r.review_id = target_id LEFT JOIN u u2 ON u2.user_id = r.user_id
  LEFT JOIN v ON target_type = 'instructorRating' AND v.rating_id = target_id LEFT JOIN u u3 ON u3.user_id = v.learner_id),
g AS (SELECT d.*, target_type, target_id FROM d JOIN w ON w.report_id = d.report_id WHERE first = 'pending' AND actor IN (SELECT user_id FROM users WHERE is_admin)),
o AS (SELECT report_id, min(seq) AS off FROM g WHERE action = 'dismiss' GROUP BY report_id),
x AS (SELECT target_type, target_id, min(seq) AS down FROM g WHERE action = 'resolve' AND NOT EXISTS (SELECT 1 FROM o WHERE o.report_id = g.report_id AND o.off < g.seq) GROUP BY target_type, target_id),
reports AS (SELECT w.*, CASE WHEN first <> 'pending' THEN first WHEN off < coalesce(down, 1e18::DOUBLE) THEN 'dismissed' WHEN down IS NOT NULL THEN 'resolved' ELSE first END AS status FROM w LEFT JOIN o ON o.report_id = w.report_id LEFT JOIN x ON x.target_type = w.target_type AND x.target_id = w.target_id),
z AS (SELECT r.*, down FROM r LEFT JOIN x ON x.target_type = 'review' AND x.target_id = review_id),
s AS (SELECT review_id, is_deleted OR down IS NOT NULL AS d, CASE WHEN down IS NOT NULL AND NOT is_deleted AND parent_id IS NULL AND EXISTS (SELECT 1 FROM z y WHERE y.parent_id = z.review_id AND NOT y.is_deleted AND (y.down IS NULL OR y.down > z.down)) THEN '{L.TAKEN_DOWN}' ELSE content END AS c FROM z),
t AS (SELECT v.*, down FROM v LEFT JOIN x ON x.target_type = 'instructorRating' AND x.target_id = rating_id),
f AS (SELECT instructor_id, coalesce(round(avg(stars) FILTER (down IS NULL), 1), 0.0) AS a, count(*) FILTER (down IS NULL) AS n FROM t WHERE instructor_id IN (SELECT instructor_id FROM t WHERE down IS NOT NULL) GROUP BY instructor_id)
{rows_of(reports=('reports', 'report_id', REPORTED), plans=("(SELECT plan_id, is_deleted OR down IS NOT NULL AS d, is_public AND down IS NULL AS b FROM p LEFT JOIN x ON x.target_type = 'course' AND x.target_id = plan_id)", 'plan_id', ('d', 'b')),
         reviews=('s', 'review_id', ('d', 'c')), ratings=('t WHERE down IS NULL', 'rating_id', ('instructor_id', 'stars')), users=('u LEFT JOIN f ON f.instructor_id = u.user_id', 'user_id', ('round(coalesce(a, avg_rating), 1)', 'coalesce(n, rating_count)')))}"""


@query("m6_apply_moderation", MODERATED)
def moderation(t):
    p, v, u = view(t.plans, COURSES), view(t.submissions, RATINGS), view(t.users, PEOPLE)
    # several plans read both: reviews are grouped and ranked once, reports are taken once
    r = written(view(t.reviews, REVIEWS).select("review_id", "parent_id", "user_id", "is_deleted", "content"), "reviews")
    reports = written(L.take_reports(view(t.events, REPORTS), p, r, v, u), "reports")
    out = L.moderate(reports, view(t.events, DECIDED), p, r, v, u.withColumn("avg_rating", F.col("avg_rating").cast("double")))
    return shown(
        reports=(out["reports"], "report_id", REPORTED), plans=(out["plans"], "plan_id", ("is_deleted", "is_public")), reviews=(out["reviews"], "review_id", ("is_deleted", "content")),
        ratings=(out["ratings"], "rating_id", ("instructor_id", "stars")), users=(out["users"], "user_id", ("round(avg_rating, 1)", "rating_count")),
    )


# ---- M7, M14
SENDERS = ["plan_id", "CASE WHEN enrollment_id % 3 = 0 THEN plan_id % 150 WHEN enrollment_id % 3 = 1 THEN (plan_id * 7) % 150 ELSE -1 END AS user_id", "enrollment_id"]
DRAFTED = ("title", "content", "summary", "draft_title", "has_draft")
TITLED = ("title", "draft_title", "has_title_draft", "status")
SENT = f"""WITH p AS ({sub('plans', COURSES)}), l AS ({sub('lessons', LESSONS)}), q AS ({sub('enrollments', SENDERS)}),
s AS (SELECT DISTINCT q.plan_id FROM q JOIN p ON p.plan_id = q.plan_id WHERE enrollment_id % 7 = 0 AND (q.user_id = owner_id OR q.user_id = instructor_id)),
m AS (SELECT l.*, plan_id IN (SELECT plan_id FROM s) AND has_draft AND NOT is_deleted AS o FROM l), k AS (SELECT p.*, plan_id IN (SELECT plan_id FROM s) AS o FROM p)
{rows_of(lessons=("(SELECT lesson_id, CASE WHEN o THEN coalesce(draft_title, title) ELSE title END AS title, CASE WHEN o THEN coalesce(draft_content, content) ELSE content END AS content, CASE WHEN o THEN coalesce(draft_summary, summary) ELSE summary END AS summary, CASE WHEN NOT o THEN draft_title END AS draft_title, has_draft AND NOT o AS has_draft FROM m)", 'lesson_id', DRAFTED),
         plans=("(SELECT plan_id, CASE WHEN o AND draft_title <> '' THEN draft_title ELSE title END AS title, CASE WHEN o AND draft_title <> '' THEN NULL ELSE draft_title END AS draft_title, has_title_draft AND NOT coalesce(o AND draft_title <> '', false) AS has_title_draft, CASE WHEN o THEN 'reviewed' ELSE status END AS status FROM k)", 'plan_id', TITLED))}"""


@query("m7_publish_drafts", SENT)
def publish_drafts(t):
    lessons, plans = L.publish_drafts(view(t.lessons, LESSONS), view(t.plans, COURSES), view(t.enrollments, SENDERS).where("enrollment_id % 7 = 0"), ["title", "content", "summary"])
    return shown(lessons=(lessons, "lesson_id", DRAFTED), plans=(plans, "plan_id", TITLED))


EDITS = ["doc_id AS lesson_id", "k AS seq", "CASE (doc_id + k) % 4 WHEN 0 THEN CAST(floor(doc_id / 7) AS BIGINT) % 150 WHEN 1 THEN (CAST(floor(doc_id / 7) AS BIGINT) * 7) % 150 ELSE 17 END AS editor_id", "concat('Edit ', CAST(k AS STRING)) AS new_title"]
STAGED = ("title", "draft_title", "has_draft")
EDITED = f"""WITH p AS ({sub('plans', COURSES)}), l AS ({sub('lessons', LESSONS)}), q AS ({sub('documents, (SELECT unnest(range(1, 5)) AS k)', EDITS)}),
v AS (SELECT q.*, q.editor_id = owner_id AND student_id IS NULL AS direct FROM q JOIN l ON l.lesson_id = q.lesson_id JOIN p ON p.plan_id = l.plan_id WHERE q.editor_id = owner_id OR q.editor_id = instructor_id),
w AS (SELECT lesson_id, arg_max(new_title, seq) FILTER (direct) AS a, arg_max(new_title, seq) FILTER (NOT direct) AS d FROM v GROUP BY lesson_id),
y AS (SELECT plan_id, trim(arg_max(concat('  Name ', CAST(enrollment_id AS VARCHAR), ' '), enrollment_id)) AS n FROM enrollments WHERE enrollment_id % 13 = 0 GROUP BY plan_id)
{rows_of(lessons=('(SELECT l.lesson_id, coalesce(a, title) AS title, coalesce(d, draft_title) AS draft_title, has_draft OR d IS NOT NULL AS has_draft FROM l LEFT JOIN w ON w.lesson_id = l.lesson_id)', 'lesson_id', STAGED),
         plans=('(SELECT p.plan_id, coalesce(n, draft_title) AS draft_title, has_title_draft OR n IS NOT NULL AS has_title_draft FROM p LEFT JOIN y ON y.plan_id = p.plan_id)', 'plan_id', ('draft_title', 'has_title_draft')))}"""


@query("m14_stage_edits", EDITED)
def stage_edits(t):
    edits = view(t.documents.select("doc_id", F.explode(F.array(*map(F.lit, range(1, 5)))).alias("k")), EDITS)
    titles = t.enrollments.where("enrollment_id % 13 = 0").selectExpr("plan_id", "concat('  Name ', enrollment_id, ' ') AS new_title", "enrollment_id AS seq")
    return shown(lessons=(L.stage_edits(view(t.lessons, LESSONS), view(t.plans, COURSES), edits, ["title"]), "lesson_id", STAGED), plans=(L.stage_titles(view(t.plans, COURSES), titles), "plan_id", ("draft_title", "has_title_draft")))


# ---- M8, M13
ACTIONS = ["user_id", "CASE event_id % 4 WHEN 0 THEN 'instructor' WHEN 1 THEN 'learner' WHEN 2 THEN 'ban' ELSE 'unban' END AS action", "event_id AS seq"]
ACCOUNTS = f"""WITH q AS (SELECT q.*, is_admin FROM ({sub('events', ACTIONS)}) q JOIN users u ON u.user_id = q.user_id WHERE NOT is_admin OR action = 'unban'),
m AS (SELECT user_id, arg_max(action, seq) FILTER (action IN ('instructor', 'learner')) AS r, arg_max(action, seq) FILTER (action IN ('ban', 'unban')) AS b FROM q GROUP BY user_id)
SELECT u.user_id, CASE WHEN coalesce(r = 'instructor', is_instructor) THEN CASE WHEN is_admin THEN 'admin,instructor,learner' ELSE 'instructor,learner' END WHEN is_admin THEN 'admin,learner' ELSE 'learner' END AS roles, coalesce(b = 'ban', is_banned) AS is_banned FROM users u LEFT JOIN m ON m.user_id = u.user_id"""
query("m8_apply_role_changes", ACCOUNTS)(
    lambda t: L.apply_account_changes(t.users.withColumn("roles", F.array_compact(F.array(F.lit("learner"), F.when(F.col("is_instructor"), "instructor"), F.when(F.col("is_admin"), "admin")))), view(t.events, ACTIONS)).withColumn("roles", F.array_join("roles", ","))
)
query(
    "m13_replace_records",
    """WITH u AS (SELECT event_id % 900 AS question_id, event_id AS seq, CASE WHEN event_id % 3 > 0 THEN ['a', 'b', 'c'][1:event_id % 4] ELSE [] END AS options FROM events), l AS (SELECT question_id, arg_max(options, seq) AS o FROM u WHERE len(options) > 0 GROUP BY question_id)
SELECT q.question_id, array_to_string(coalesce(o, options), ',') AS options, CAST(CASE WHEN o IS NULL THEN 0 ELSE len(o) END AS INT) AS num_options FROM questions q LEFT JOIN l ON l.question_id = q.question_id""",
)(
    lambda t: L.replace_records(
        t.questions.select("question_id", "options", F.lit(0).alias("num_options")),
        t.events.selectExpr("event_id % 900 AS question_id", "event_id AS seq", "CASE WHEN event_id % 3 > 0 THEN slice(array('a', 'b', 'c'), 1, cast(event_id % 4 as int)) ELSE array() END AS options"),
        "question_id", F.size("options") > 0, {"num_options": F.size("options")},
    ).withColumn("options", F.array_join("options", ","))
)

# ---- M12
VISIBLE = ["plan_id", "CASE WHEN enrollment_id % 5 < 3 THEN plan_id % 150 WHEN enrollment_id % 35 = 3 THEN 97 ELSE learner_id END AS actor", "CASE WHEN enrollment_id % 7 < 3 THEN 'list' WHEN enrollment_id % 7 < 5 THEN 'unlist' WHEN enrollment_id % 7 = 5 THEN 'remove_import' ELSE 'takedown' END AS action", "enrollment_id AS seq"]
SEEN = f"""WITH p AS ({sub('plans', COURSES)}), q AS (SELECT q.*, q.actor = owner_id AS mine, q.actor IN (SELECT user_id FROM users WHERE is_admin) AS adm, source_type, is_deleted FROM ({sub('enrollments', VISIBLE)}) q JOIN p ON p.plan_id = q.plan_id WHERE seq % 3 = 0 OR q.plan_id % 2 = 0),
e AS (SELECT plan_id, min(seq) AS fin FROM q WHERE (adm AND action = 'takedown') OR (mine AND action = 'remove_import' AND source_type = 'imported' AND NOT is_deleted) GROUP BY plan_id),
s AS (SELECT q.plan_id, arg_max(action = 'list', seq) AS on_ FROM q LEFT JOIN e ON e.plan_id = q.plan_id WHERE (mine AND action = 'unlist') OR (adm AND action = 'takedown') OR (mine AND action = 'list' AND NOT is_deleted AND (fin IS NULL OR seq < fin)) GROUP BY q.plan_id)
SELECT p.plan_id, coalesce(on_, is_public) AS is_public, is_deleted OR fin IS NOT NULL AS is_deleted FROM p LEFT JOIN e ON e.plan_id = p.plan_id LEFT JOIN s ON s.plan_id = p.plan_id"""
query("m12_apply_visibility", SEEN)(lambda t: L.apply_visibility(view(t.plans, COURSES), view(t.enrollments, VISIBLE).where("seq % 3 = 0 or plan_id % 2 = 0"), t.users.where("is_admin")))
