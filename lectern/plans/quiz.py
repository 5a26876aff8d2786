"""Quiz and learning queries over the platform views, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import quiz as Z
from .registry import query

CLEAN = r"""SELECT question_id, lesson_id, correct_answer, difficulty, explanation, CASE WHEN st <> '' AND NOT regexp_matches(st, '[?:.]$') THEN concat(st, '?') ELSE st END AS question,
list_transform(options, lambda o: regexp_replace(trim(o), '^[A-Da-d1-4]\s*[.)\-:\s]\s*', '')) AS options FROM (SELECT *, regexp_replace(trim(question), '(?i)^câu\s*[0-9]+\s*[.:\-\s]\s*', '') AS st FROM (SELECT * EXCLUDE (question), concat('Câu ', CAST(question_id AS VARCHAR), ': ', question) AS question FROM questions))"""


def raw(t):
    return t.questions.withColumn("question", F.concat(F.lit("Câu "), F.col("question_id").cast("string"), F.lit(": "), "question"))


query("q2_clean_questions", f"SELECT question_id, question, array_to_string(options, '|') AS options FROM ({CLEAN})")(
    lambda t: Z.clean_questions(raw(t)).select("question_id", "question", F.array_join("options", "|").alias("options"))
)
STRICT = r"""correct_answer BETWEEN 0 AND 3 AND length(trim(question)) >= 10 AND NOT regexp_matches(lower(question), 'placeholder|---|___+|\.\.\.') AND len(list_filter(options, lambda x: length(trim(x)) < 3)) = 0
AND len(list_distinct(list_transform(options, lambda x: lower(trim(x))))) = 4 AND length(trim(explanation)) >= 10 AND len(list_filter(options, lambda x: regexp_matches(lower(trim(x)), '^(?:đúng|sai|correct|incorrect|true|false)(?:[^A-Za-z0-9_]|$)'))) = 0"""
query(
    "q3_valid_questions",
    f"SELECT question_id FROM (SELECT *, sum(CASE WHEN s THEN 1 ELSE 0 END) OVER (PARTITION BY lesson_id) AS n FROM (SELECT *, {STRICT} AS s FROM ({CLEAN}))) WHERE CASE WHEN n >= 3 THEN s ELSE correct_answer BETWEEN 0 AND 3 END",
)(lambda t: Z.valid_questions(Z.clean_questions(raw(t)), 5).select("question_id"))
SCORE = r"""CASE WHEN regexp_matches(question, '(?i)(?:^|\s)---(?:\s|$)|^\s*\.\.\.\s*$|___+|placeholder') THEN 0 ELSE greatest(0, 100 - CASE WHEN length(explanation) < 20 THEN 20 ELSE 0 END
- CASE WHEN coalesce(options[correct_answer + 1], '') <> '' AND contains(question, substring(options[correct_answer + 1], 1, 40)) THEN 25 ELSE 0 END
- CASE WHEN len(list_distinct(list_transform(options, lambda x: substring(x, 1, 60)))) < 4 THEN 30 ELSE 0 END - CASE WHEN av < 20 THEN 15 ELSE 0 END - CASE WHEN list_sum(list_transform(options, lambda x: abs(length(x) - av))) / 4 < 8 THEN 10 ELSE 0 END
- CASE WHEN len(list_filter(options, lambda x: regexp_matches(x, '(?i)^(?:dung|sai)(?:[^a-z0-9_]|$)'))) > 0 THEN 35 ELSE 0 END) END"""
WITH_AV = "SELECT *, list_sum(list_transform(options, lambda x: length(x))) / 4 AS av FROM"
query("q4_score_questions", f"SELECT question_id, CAST({SCORE} AS INT) AS score FROM ({WITH_AV} questions)")(lambda t: Z.score_questions(t.questions).select("question_id", "score"))
LONG = "SELECT * REPLACE (list_transform(options, lambda x: concat(x, ' label')) AS options) FROM questions"


def long_options(t):
    return t.questions.withColumn("options", F.transform("options", lambda x: F.concat(x, F.lit(" label"))))


NORMAL = f"SELECT * EXCLUDE (correct_answer), CASE WHEN correct_answer BETWEEN 0 AND 3 THEN correct_answer ELSE 0 END AS correct_answer FROM ({LONG}) WHERE len(list_filter(options, lambda x: length(x) < 8)) = 0 AND len(list_distinct(list_transform(options, lambda x: substring(lower(x), 1, 120)))) = 4"
query("q5_normalize_questions", f"SELECT question_id, CAST(correct_answer AS INT) AS correct_answer, array_to_string(options, '|') AS options FROM ({NORMAL})")(
    lambda t: Z.normalize_questions(long_options(t)).select("question_id", "correct_answer", F.array_join("options", "|").alias("options"))
)
query(
    "q6_quiz_batch",
    f"""WITH s AS (SELECT lesson_id, question_id, question, CAST({SCORE} AS INT) AS score FROM ({WITH_AV} ({NORMAL}))), f AS (SELECT *, row_number() OVER (PARTITION BY lesson_id, lower(question) ORDER BY question_id) AS n FROM s)
SELECT lesson_id, question_id, score, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY lesson_id ORDER BY score DESC, question_id) AS place FROM f WHERE n = 1 AND score >= 50) WHERE place <= 10""",
)(lambda t: Z.quiz_batch(long_options(t)))
query("o9_rank_quiz", f"SELECT question_id, score FROM (SELECT question_id, CAST({SCORE} AS INT) AS score FROM ({WITH_AV} questions)) WHERE score >= 50")(
    lambda t: Z.score_questions(t.questions).where("score >= 50").select("question_id", "score").orderBy(F.desc("score"), "question_id")
)
KEY = "SELECT q AS quiz_id, p AS position, (q * 3 + p) % 4 AS correct FROM (SELECT DISTINCT event_id % 20 AS q FROM events), unnest([0, 1, 2, 3]) AS u(p)"


def key(t):
    return t.attempts.select("quiz_id").distinct().select("quiz_id", F.explode(F.array(*[F.lit(k) for k in range(4)])).alias("position")).withColumn("correct", (F.col("quiz_id") * 3 + F.col("position")) % 4)


query(
    "q7_grade_attempts",
    f"""WITH k AS ({KEY}) SELECT attempt_id, count(*) FILTER (answers[position + 1] = correct) AS score, count(*) AS total, CAST(floor(100.0::DOUBLE * count(*) FILTER (answers[position + 1] = correct) / count(*) + 0.5) AS INT) AS percent
FROM attempts a JOIN k ON k.quiz_id = a.quiz_id GROUP BY attempt_id""",
)(lambda t: Z.grade(t.attempts, key(t)))
query("q8_grade_lesson_quiz", "SELECT submission_id, CAST(floor(100.0::DOUBLE * (pct // 10) / 10 + 0.5) AS INT) AS percent FROM submissions")(
    lambda t: t.submissions.select("submission_id", F.floor(100.0 * F.floor(F.col("pct") / 10) / 10 + 0.5).cast("int").alias("percent"))
)
query(
    "q9_grade_adaptive",
    f"""WITH k AS ({KEY}), g AS (SELECT attempt_id, quiz_id, unnest([0, 1, 2]) AS position, unnest(list_transform(answers, lambda x: x - 1)) AS answer FROM attempts)
SELECT attempt_id, count(*) AS answered, count(*) FILTER (answer = correct) AS "right", CAST(floor(100.0::DOUBLE * count(*) FILTER (answer = correct) / count(*) + 0.5) AS INT) AS percent FROM g LEFT JOIN k ON k.quiz_id = g.quiz_id AND k.position = g.position WHERE answer >= 0 GROUP BY attempt_id""",
)(lambda t: Z.grade_adaptive(t.attempts.withColumn("answers", F.transform("answers", lambda x: x - 1)), key(t)))
query(
    "q10_lesson_scores",
    "SELECT l.lesson_id, coalesce(s.best, 0) AS best, coalesce(s.n, 0) AS attempts FROM lessons l LEFT JOIN (SELECT plan_id, day_number, max(pct) AS best, count(*) AS n FROM submissions GROUP BY plan_id, day_number) s ON s.plan_id = l.plan_id AND s.day_number = l.day_number",
)(
    lambda t: t.lessons.join(t.submissions.groupBy("plan_id", "day_number").agg(F.max("pct").alias("best"), F.count("*").alias("n")), ["plan_id", "day_number"], "left").select(
        "lesson_id", F.coalesce("best", F.lit(0)).alias("best"), F.coalesce("n", F.lit(0)).cast("long").alias("attempts")
    )
)
query(
    "q11_assignment_status",
    "SELECT submission_id, CASE WHEN submission_id % 3 = 0 THEN 'graded' WHEN submission_id % 3 = 1 THEN 'ai_graded' ELSE 'pending' END AS status, CASE WHEN submission_id % 3 < 2 THEN pct END AS final_score FROM submissions",
)(
    lambda t: Z.assignment_status(t.submissions.withColumns({"score": F.expr("CASE WHEN submission_id % 3 = 0 THEN pct END"), "ai_score": F.expr("CASE WHEN submission_id % 3 = 1 THEN pct END")})).select(
        "submission_id", "status", "final_score"
    )
)
query(
    "c5_quiz_bounds",
    """SELECT plan_id, CASE WHEN f AND d THEN 7 WHEN f THEN 5 WHEN d THEN 4 ELSE 3 END AS least, CASE WHEN f AND d THEN 10 WHEN f THEN 8 WHEN d THEN 6 ELSE 5 END AS most FROM (SELECT plan_id, plan_id % 3 = 0 AS f, plan_id % 2 = 0 AS d FROM plans)""",
)(
    lambda t: Z.quiz_bounds(t.plans.select("plan_id", F.when(F.col("plan_id") % 3 == 0, "practice").otherwise("other").alias("focus"), F.when(F.col("plan_id") % 2 == 0, "deep").alias("depth"))).select("plan_id", "least", "most")
)
query(
    "c7_learning_mode",
    "SELECT user_id, plan_id, topic, CASE WHEN s >= 80 THEN 'ADVANCED' WHEN s < 50 THEN 'REMEDIAL' ELSE 'NORMAL' END AS mode FROM (SELECT user_id, plan_id, topic, arg_max(pct, (ts, submission_id)) AS s FROM submissions GROUP BY user_id, plan_id, topic)",
)(lambda t: Z.learning_mode(A.knowledge_map(t.submissions)).select("user_id", "plan_id", "topic", "mode"))
RAW_QUIZ = "```json\n{\"quiz\": [{\"question\": \"%s\", \"options\": [\"a\", \"b\",], \"correctAnswer\": 1,}]}\n```"
query("q1_parse_quiz_json", "SELECT question_id, CASE WHEN question_id % 7 = 0 THEN NULL ELSE question END AS question, question_id % 7 = 0 AS corrupt FROM questions")(
    lambda t: Z.parse_quiz_json(t.questions.select("question_id", F.when(F.col("question_id") % 7 == 0, F.lit("no json")).otherwise(F.replace(F.lit(RAW_QUIZ), F.lit("%s"), "question")).alias("raw"))).select(
        "question_id", F.col("item.question").alias("question"), "corrupt"
    )
)
