"""The streaming jobs, run over several micro-batches of shuffled or late rows until the input is used up; the twins are batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import jobs
from ..sources.files import shared_path
from .registry import query


@query(
    "st1_rolling_downloads",
    """SELECT event_type, s AS start, count(*) AS n FROM (SELECT event_type, ts, unnest(list_transform(range(7), lambda k: date_trunc('day', ts) - to_days(CAST(k AS INT)))) AS s FROM events) GROUP BY event_type, s""",
)
def rolling_downloads(t):
    stream, late, _ = jobs.replay(t.events.select("event_id", "event_type", "ts"), ts="ts")
    return jobs.latest(jobs.drain(jobs.rolling_downloads(stream, "event_type", late=late)), ["event_type", "start"])


@query("st2_topic_memory", "SELECT user_id, topic, count(*) AS n FROM submissions GROUP BY user_id, topic")
def topic_memory(t):
    return jobs.latest(jobs.drain(jobs.topic_memory(jobs.replay(t.submissions)[0])), ["user_id", "topic"])


FOLD = """WITH s AS (SELECT user_id, plan_id, list(CAST(pct AS DOUBLE) ORDER BY ts, submission_id) AS p FROM submissions GROUP BY user_id, plan_id),
f AS (SELECT user_id, plan_id, len(p) AS n, list_reduce(list_prepend(0::DOUBLE, p[1:len(p) - 1]), lambda a, x, i: floor((a * (i - 2) + x) / (i - 1) + 0.5::DOUBLE)) AS a, p[len(p)] AS x FROM s),
r AS (SELECT user_id, plan_id, n, (a * (n - 1) + x) / n AS raw FROM f)
SELECT user_id, plan_id, floor(raw + 0.5::DOUBLE) AS average_score, n AS quizzes, CASE WHEN raw >= 85 THEN 'EXPERT' WHEN raw < 60 THEN 'BEGINNER' ELSE 'INTERMEDIATE' END AS level FROM r"""


@query("st3_running_progress", FOLD)
def running_progress(t):
    """The last rows, of no learner and of far days, move the watermark past all others."""
    rows = t.submissions.select("user_id", "plan_id", "submission_id", F.col("pct").cast("long").alias("pct"), F.col("ts").cast("timestamp").alias("ts"))
    nobody = [F.lit(jobs.NOBODY).cast("long").alias(c) for c in ("user_id", "plan_id", "submission_id", "pct")]
    ends = [rows.agg(F.max("ts").alias("ts")).select(*nobody, (F.col("ts") + F.expr(f"interval {days} days")).alias("ts")) for days in (4000, 8000)]
    stream, late, folder = jobs.replay(rows, 3, ts="ts")
    return jobs.latest(jobs.drain_to_the_end(jobs.running_progress(stream, late=late), ends, folder), ["user_id", "plan_id"])


@query("st4_ingest_once", "SELECT source, md5(text) AS content_hash, min(doc_id) AS doc_id FROM documents GROUP BY source, md5(text)")
def ingest_once(t):
    docs = t.documents.select("doc_id", "source", "text")
    sink = jobs.KeptOnce(shared_path(t.spark, "kept-once"), ["source", "content_hash"], "doc_id")
    jobs.ingest_into(jobs.replay(docs)[0], "source", "text", "doc_id", shared_path(t.spark, "stream-state"), sink)
    return sink.read(t.spark, "source string, content_hash string, doc_id long, part int")
