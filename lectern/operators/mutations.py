"""Write endpoints as table jobs: a table and a change log go in, the new table comes out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_action(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of a log for each key."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return log.withColumn("_n", n).where("_n = 1").drop("_n")


def publish(plans: DataFrame, requests: DataFrame) -> DataFrame:
    """Idempotent publication: a plan that has a public copy is marked for update, others for a new copy."""
    public = plans.where("original_plan_id is not null and is_public").groupBy(F.col("original_plan_id").alias("plan_id")).agg(F.min("plan_id").alias("copy_id"))
    return requests.join(public, "plan_id", "left").select("plan_id", "copy_id", F.when(F.col("copy_id").isNull(), "create").otherwise("update").alias("action"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Old and new rows, the latest of each key."""
    return last_action(old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1))), keys, ["_new", *order]).drop("_new")


def friendships(log: DataFrame) -> DataFrame:
    """State of every pair after its log (seq, actor, other, action) is replayed: request, accept, reject, cancel, unfriend.
    A rejected pair may be asked again, from either side."""
    pair = {"a": F.least("actor", "other"), "b": F.greatest("actor", "other")}
    seq = F.array_sort(F.collect_list(F.struct("seq", "actor", "action")))
    none = F.struct(F.lit("none").alias("status"), F.lit(None).cast("long").alias("asker"))

    def step(s: Column, x: Column) -> Column:
        ask = (x["action"] == "request") & s["status"].isin("none", "rejected")
        answer = (s["status"] == "pending") & (x["actor"] != s["asker"])
        return (
            F.when(ask, F.struct(F.lit("pending").alias("status"), x["actor"].alias("asker")))
            .when(answer & (x["action"] == "accept"), F.struct(F.lit("accepted").alias("status"), s["asker"].alias("asker")))
            .when(answer & (x["action"] == "reject"), F.struct(F.lit("rejected").alias("status"), s["asker"].alias("asker")))
            .when((s["status"] == "pending") & (x["actor"] == s["asker"]) & (x["action"] == "cancel"), none)
            .when((s["status"] == "accepted") & (x["action"] == "unfriend"), none)
            .otherwise(s)
        )

    folded = log.where("actor <> other").withColumns(pair).groupBy("a", "b").agg(F.aggregate(seq, none, step).alias("s"))
    return folded.select("a", "b", F.col("s.status").alias("status"), F.col("s.asker").alias("requester")).where("status <> 'none'")


def ratings(log: DataFrame) -> DataFrame:
    """The last valid rating of each learner for each instructor; a removal leaves none. log: instructor_id, learner_id, stars (null removes), seq."""
    valid = log.where("instructor_id <> learner_id and (stars is null or stars between 1 and 5)")
    return last_action(valid, ["instructor_id", "learner_id"], ["seq"]).where("stars is not null")


def accept_reviews(candidates: DataFrame, eligible: DataFrame) -> DataFrame:
    """Root reviews need an eligible writer, one to five stars, and are one for each user and plan; replies lose their stars."""
    roots = candidates.where("parent_id is null and rating between 1 and 5").join(eligible.select("user_id", "plan_id"), ["user_id", "plan_id"], "left_semi")
    n = F.row_number().over(W.partitionBy("user_id", "plan_id").orderBy("created_at", "review_id"))
    first = roots.withColumn("n", n).where("n = 1").select("review_id", "parent_id", "rating")
    return first.unionByName(candidates.where("parent_id is not null").select("review_id", "parent_id", F.lit(None).cast("int").alias("rating")))


def reactions(log: DataFrame) -> DataFrame:
    """Likes and dislikes after a log of toggles (review_id, user_id, kind, seq): the same again removes, the other replaces."""
    seq = F.array_sort(F.collect_list(F.struct("seq", "kind")))
    end = F.aggregate(seq, F.lit(""), lambda s, x: F.when(s == x["kind"], "").otherwise(x["kind"]))
    state = log.groupBy("review_id", "user_id").agg(end.alias("kind"))
    return state.groupBy("review_id").agg(F.count_if(F.col("kind") == "like").alias("likes"), F.count_if(F.col("kind") == "dislike").alias("dislikes"))


def apply_shares(log: DataFrame) -> DataFrame:
    """Users that each plan is shared with, after the last action of every pair."""
    return last_action(log, ["plan_id", "user_id"], ["seq"]).where("action = 'share'").groupBy("plan_id").agg(F.array_sort(F.collect_set("user_id")).alias("shared_with"))


def toggle_tag(plans: DataFrame, ids: DataFrame, tag: str) -> DataFrame:
    """The tag is removed where it was and added where it was not, for the named plans."""
    rows = plans.join(ids.select("plan_id").distinct().withColumn("_hit", F.lit(True)), "plan_id", "left")
    toggled = F.when(F.array_contains("tags", tag), F.array_remove("tags", tag)).otherwise(F.array_append("tags", F.lit(tag)))
    return rows.withColumn("tags", F.when(F.col("_hit"), toggled).otherwise(F.col("tags"))).drop("_hit")


def top_up(primary: DataFrame, secondary: DataFrame, key: str) -> DataFrame:
    """primary, then what secondary has besides."""
    return primary.unionByName(secondary.join(primary, key, "left_anti"))


def merge_concepts(a: str, b: str) -> Column:
    up = lambda c: F.transform(c, F.upper)
    return F.array_distinct(F.array_union(up(a), up(b)))
