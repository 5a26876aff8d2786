"""Aggregations over platform tables; all with map-side combine."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def stars(column: str) -> Column:
    return F.round(F.avg(column), 1)


def student_counts(enrollments: DataFrame) -> DataFrame:
    return enrollments.where("status = 'active'").groupBy("plan_id").agg(F.count("*").alias("students"))


def review_summary(reviews: DataFrame) -> DataFrame:
    """For each plan: mean to one decimal, total and the number of each star, over live root reviews."""
    live = reviews.where("parent_id is null and not is_deleted")
    return live.groupBy("plan_id").agg(
        F.coalesce(stars("rating"), F.lit(0.0)).alias("avg_rating"), F.count("*").alias("total"), *[F.count_if(F.col("rating") == k).alias(f"star{k}") for k in range(5, 0, -1)]
    )


def review_stats(reviews: DataFrame) -> DataFrame:
    return reviews.where("parent_id is null and not is_deleted").groupBy("plan_id").agg(stars("rating").alias("avg_rating"), F.count("*").alias("review_count"))


def weekly_downloads(enrollments: DataFrame, as_of: datetime) -> DataFrame:
    """Enrolments of the seven days before as_of."""
    return enrollments.where(F.col("created_at") >= F.lit(as_of) - F.expr("INTERVAL 7 DAYS")).groupBy("plan_id").agg(F.count("*").alias("downloads"))


def instructor_ratings(users: DataFrame, ratings: DataFrame) -> DataFrame:
    """Mean stars to one decimal and their number for every instructor, 0 if none."""
    r = ratings.groupBy("instructor_id").agg(stars("stars").alias("avg_rating"), F.count("*").alias("rating_count"))
    return users.where("is_instructor").join(r, users.user_id == r.instructor_id, "left").select(
        "user_id", F.coalesce("avg_rating", F.lit(0.0)).alias("avg_rating"), F.coalesce("rating_count", F.lit(0)).cast("long").alias("rating_count")
    )


def dashboard_counts(users: DataFrame, plans: DataFrame) -> DataFrame:
    """One row of counters: one pass over each table, then two one-row frames side by side."""
    u = users.agg(
        F.count_if(~F.col("is_admin")).alias("users"), F.count_if("is_instructor").alias("instructors"), F.count_if(~F.col("is_instructor") & ~F.col("is_admin")).alias("learners"), F.count_if("is_banned").alias("banned")
    )
    p = plans.agg(F.count_if(~F.col("is_deleted")).alias("courses"), F.count_if(~F.col("is_deleted") & F.col("is_public")).alias("public_courses"))
    return u.join(p)


def user_detail(users: DataFrame, plans: DataFrame, newest: int = 5) -> DataFrame:
    """Courses of every user: how many, how many public, and the newest ones."""
    live = plans.where(~F.col("is_deleted"))
    counts = live.groupBy("owner_id").agg(F.count("*").alias("courses"), F.count_if("is_public").alias("public_courses"))
    order = W.partitionBy("owner_id").orderBy(F.desc("created_rank"), F.desc("plan_id"))
    top = live.select("owner_id", "plan_id", F.row_number().over(order).alias("n")).where(F.col("n") <= newest)
    listed = top.groupBy("owner_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "plan_id"))), lambda x: x["plan_id"].cast("string")), ",").alias("newest"))
    both = counts.join(listed, "owner_id")
    return users.join(both, users.user_id == both.owner_id, "left").select(
        "user_id", F.coalesce("courses", F.lit(0)).cast("long").alias("courses"), F.coalesce("public_courses", F.lit(0)).cast("long").alias("public_courses"), F.coalesce("newest", F.lit("")).alias("newest")
    )


def distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def pool_breakdown(questions: DataFrame) -> DataFrame:
    return questions.groupBy("lesson_id").pivot("difficulty", ["easy", "medium", "hard"]).count().na.fill(0)


def user_memory(submissions: DataFrame) -> DataFrame:
    return submissions.groupBy("user_id", "topic").agg(F.count("*").alias("n"))


def batch_quality(scored: DataFrame) -> DataFrame:
    """Batches whose mean score is below 60 are low."""
    return scored.groupBy("lesson_id").agg(F.round(F.avg("score"), 4).alias("mean_score"), (F.avg("score") < 60).alias("low"))


def knowledge_map(submissions: DataFrame) -> DataFrame:
    """The last score of each user, plan and topic."""
    return submissions.groupBy("user_id", "plan_id", "topic").agg(F.max_by("pct", F.struct("ts", "submission_id")).alias("score"))


def completed_days(submissions: DataFrame) -> DataFrame:
    """Distinct days and the last score of each, for each user and plan."""
    last = submissions.groupBy("user_id", "plan_id", "day_number").agg(F.max_by("pct", F.struct("ts", "submission_id")).alias("pct"))
    days = F.array_sort(F.collect_list(F.struct("day_number", "pct")))
    return last.groupBy("user_id", "plan_id").agg(F.transform(days, lambda x: F.concat_ws(":", x["day_number"].cast("string"), x["pct"].cast("string"))).alias("d")).select(
        "user_id", "plan_id", F.size("d").cast("long").alias("n_days"), F.array_join("d", ",").alias("day_scores")
    )


def lesson_counts(lessons: DataFrame) -> DataFrame:
    return lessons.groupBy("plan_id").agg(F.count("*").alias("lessons"))
