"""Lookups and joins of platform tables. Sides are left to the optimiser; nothing is broadcast by hint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .filters import icontains


def percent(part: Column, whole: Column) -> Column:
    """min(100, floor(100 part / whole + 1/2)), 0 where whole is 0 or missing."""
    return F.when(whole > 0, F.least(F.lit(100), F.floor(100.0 * part / whole + 0.5).cast("int"))).otherwise(0).cast("int")


def populate(df: DataFrame, key: str, dim: DataFrame, dim_key: str, cols: list[str], prefix: str) -> DataFrame:
    """Left lookup of a reference; nulls where it is missing."""
    side = dim.select(F.col(dim_key).alias("_key"), *[F.col(c).alias(f"{prefix}_{c}") for c in cols])
    return df.join(side, df[key] == side["_key"], "left").drop("_key")


def plans_by_instructor(plans: DataFrame, users: DataFrame, term: str) -> DataFrame:
    """Plans whose owner or instructor has a name that holds the term: two equi semi-joins, not one with OR."""
    ids = users.where(icontains("full_name", term)).select(F.col("user_id"))
    owners = plans.join(ids, plans.owner_id == ids.user_id, "left_semi").select("plan_id")
    teachers = plans.join(ids, plans.instructor_id == ids.user_id, "left_semi").select("plan_id")
    return plans.join(owners.union(teachers).distinct(), "plan_id", "left_semi")


def with_counts(df: DataFrame, key: str, child: DataFrame, child_key: str, name: str) -> DataFrame:
    """A count of child rows beside every row, 0 where there are none."""
    counts = child.groupBy(F.col(child_key).alias(key)).agg(F.count("*").alias(name))
    return df.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))


def friendship_status(users: DataFrame, edges: DataFrame, me: int) -> DataFrame:
    """Every other user with the newest edge to me in either direction."""
    mine = edges.where((F.col("requester") == me) | (F.col("recipient") == me)).select(
        F.when(F.col("requester") == me, F.col("recipient")).otherwise(F.col("requester")).alias("user_id"),
        F.struct("updated_at", "friendship_id", "status", (F.col("requester") == me).alias("i_am_requester")).alias("e"),
    )
    last = mine.groupBy("user_id").agg(F.max("e").alias("e"))
    return users.where(F.col("user_id") != me).join(last, "user_id", "left").select(
        "user_id", F.coalesce("e.status", F.lit("none")).alias("status"), F.coalesce("e.i_am_requester", F.lit(False)).alias("i_am_requester")
    )


def friends_of(edges: DataFrame, users: DataFrame, me: int) -> DataFrame:
    """The other ends of my accepted edges that still exist, with their edge's time."""
    other = F.when(F.col("requester") == me, F.col("recipient")).otherwise(F.col("requester"))
    mine = edges.where("status = 'accepted'").where((F.col("requester") == me) | (F.col("recipient") == me))
    return mine.select("friendship_id", other.alias("user_id"), "updated_at").join(users.select("user_id", "full_name"), "user_id")


def eligible_reviewers(plans: DataFrame, progress: DataFrame, reviews: DataFrame, min_days: int = 2) -> DataFrame:
    """(user, plan): two completed days on the plan or on a live copy of it, and no root review of it yet."""
    root = plans.where(~F.col("is_deleted")).select("plan_id", F.coalesce("original_plan_id", "plan_id").alias("root_id"))
    days = progress.join(root, "plan_id").groupBy("user_id", "root_id").agg(F.max("days").alias("days")).where(F.col("days") >= min_days)
    reviewed = reviews.where("parent_id is null").select("user_id", F.col("plan_id").alias("root_id"))
    return days.join(reviewed, ["user_id", "root_id"], "left_anti").select("user_id", F.col("root_id").alias("plan_id"), "days")


def latest_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row for each key; the last column of order breaks ties."""
    w = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def instructor_roster(enrollments: DataFrame, users: DataFrame, plans: DataFrame, progress: DataFrame) -> DataFrame:
    """Enrolments with learner, plan and percent done; rows whose learner or plan is gone are dropped."""
    return (
        enrollments.join(users.select(F.col("user_id").alias("learner_id"), "full_name"), "learner_id")
        .join(plans.select("plan_id", "title", "duration"), "plan_id")
        .join(progress.select(F.col("user_id").alias("learner_id"), "plan_id", "days"), ["learner_id", "plan_id"], "left")
        .select("enrollment_id", "learner_id", "plan_id", "full_name", "title", percent(F.coalesce("days", F.lit(0)), F.col("duration")).alias("percent"))
    )


def course_dashboard(plans: DataFrame, lessons: DataFrame, enrollments: DataFrame, progress: DataFrame) -> DataFrame:
    """For each plan: lessons, active students and their mean percent done."""
    active = enrollments.where("status = 'active'")
    n_lessons = lessons.groupBy("plan_id").agg(F.count("*").alias("lessons"))
    students = active.groupBy("plan_id").agg(F.count_distinct("learner_id").alias("students"))
    done = progress.join(plans.select("plan_id", "duration"), "plan_id").groupBy("plan_id").agg(F.sum(percent(F.col("days"), F.col("duration"))).alias("s"), F.count("*").alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return (
        plans.select("plan_id", "title").join(n_lessons, "plan_id", "left").join(students, "plan_id", "left").join(done, "plan_id", "left")
        .select("plan_id", "title", zero("lessons"), zero("students"), F.coalesce(F.round(F.col("s") / F.col("n"), 4), F.lit(0.0)).alias("mean_percent"))
    )


def plan_results(lessons: DataFrame, knowledge: DataFrame) -> DataFrame:
    """Lessons with the knowledge map's score and status, met by title; NOT_STARTED where there is none."""
    status = F.when(F.col("score") >= 80, "EXPERT").when(F.col("score") < 50, "BEGINNER").otherwise("INTERMEDIATE")
    return lessons.join(knowledge, ["plan_id", "title"], "left").select(
        "lesson_id", "plan_id", "day_number", F.coalesce("score", F.lit(0)).alias("score"), F.when(F.col("score").isNull(), "NOT_STARTED").otherwise(status).alias("status")
    )


def clone_staleness(plans: DataFrame) -> DataFrame:
    """Copies with a mark whether their source changed after the newest copy was made."""
    source = plans.select(F.col("plan_id").alias("original_plan_id"), F.col("updated_at").alias("source_updated"))
    newest = plans.where("original_plan_id is not null").groupBy("original_plan_id", "owner_id").agg(F.max("created_at").alias("copied_at"))
    return newest.join(source, "original_plan_id").select("original_plan_id", "owner_id", (F.col("source_updated") > F.col("copied_at")).alias("has_updates"))


def merge_drafts(lessons: DataFrame) -> DataFrame:
    """What readers see: an empty draft title, content or summary falls back, other draft fields on null only."""
    text = lambda c: F.when(F.col("has_draft"), F.coalesce(F.nullif(F.col(f"draft_{c}"), F.lit("")), F.col(c))).otherwise(F.col(c)).alias(c)
    return lessons.select("lesson_id", text("title"), text("content"))


def student_detail(submissions: DataFrame, lessons: DataFrame) -> DataFrame:
    """Completed days of each learner and plan, with the lessons' titles."""
    days = submissions.select("user_id", "plan_id", "day_number").distinct()
    titled = days.join(lessons.select("plan_id", "day_number", "title"), ["plan_id", "day_number"], "left")
    return titled.groupBy("user_id", "plan_id").agg(
        F.count("*").alias("days"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("day_number", F.coalesce("title", F.lit("-")).alias("t")))), lambda x: x["t"]), "|").alias("titles")
    )
