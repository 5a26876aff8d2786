"""Ordered operators: paging, attempts, running averages, threads, unlocking, budgets, keep-first, rankings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cleaning import title_keywords
from ..functions.digests import smallest
from ..functions.text import normalize_tag
from ..sources.files import small_batches, written

LEVEL_MIX = {"BEGINNER": (0.6, 0.3, 0.1), "INTERMEDIATE": (0.2, 0.5, 0.3), "EXPERT": (0.1, 0.3, 0.6)}


def paginate(df: DataFrame, order: list[Column], page: int, limit: int = 10, cap: int = 50) -> DataFrame:
    """One page of rows with total, total_pages, has_next and has_prev beside each."""
    page, limit = max(1, page), min(max(1, limit), cap)
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(*order).offset((page - 1) * limit).limit(limit)
    pages = F.ceil(F.col("total") / limit)
    return rows.join(total).withColumns({"total_pages": pages, "has_next": page < pages, "has_prev": F.lit(page > 1)})


def attempt_numbers(attempts: DataFrame, max_attempts: int = 3) -> DataFrame:
    """The number of each attempt of a user at a quiz, what was left before it and whether it was allowed."""
    n = F.row_number().over(W.partitionBy("user_id", "quiz_id").orderBy("ts", "attempt_id"))
    return attempts.select("attempt_id", "user_id", "quiz_id", n.alias("attempt_number")).withColumns(
        {"remaining": F.greatest(F.lit(0), F.lit(max_attempts) - F.col("attempt_number") + 1).cast("int"), "allowed": F.col("attempt_number") <= max_attempts}
    )


def level(value: Column) -> Column:
    return F.when(value >= 85, "EXPERT").when(value < 60, "BEGINNER").otherwise("INTERMEDIATE")


def progress_fold(submissions: DataFrame) -> DataFrame:
    """Running average that is rounded after every submission; the level looks at the last unrounded value.

    The rounding makes it order-dependent, so each learner's course is folded in order; its length is bounded by the quizzes taken.
    """
    seq = F.array_sort(F.collect_list(F.struct("ts", "submission_id", "pct")))
    new = lambda a, x: (a["avg"] * a["n"] + x["pct"]) / (a["n"] + 1)
    fold = F.aggregate(
        seq,
        F.struct(F.lit(0.0).alias("avg"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("raw")),
        lambda a, x: F.struct(F.floor(new(a, x) + 0.5).cast("double").alias("avg"), (a["n"] + 1).alias("n"), new(a, x).alias("raw")),
    )
    g = submissions.groupBy("user_id", "plan_id").agg(fold.alias("f"))
    return g.select("user_id", "plan_id", F.col("f.avg").alias("average_score"), F.col("f.n").alias("quizzes"), level(F.col("f.raw")).alias("level"))


def progress_avg(submissions: DataFrame) -> DataFrame:
    """The plain running average after each submission."""
    w = W.partitionBy("user_id", "plan_id").orderBy("ts", "submission_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    return submissions.select("submission_id", F.round(F.avg("pct").over(w), 6).alias("running"))


def review_threads(reviews: DataFrame) -> DataFrame:
    """Root reviews and replies as shown: a deleted reply stays as a placeholder only if a live one follows it; a
    deleted root only if a reply is shown."""
    order = W.partitionBy("parent_id").orderBy("created_at", "review_id")
    replies = reviews.where("parent_id is not null")
    later = F.max(F.when(~F.col("is_deleted"), 1).otherwise(0)).over(order.rowsBetween(1, W.unboundedFollowing))
    shown = replies.withColumn("later", F.coalesce(later, F.lit(0))).where("not is_deleted or later = 1")
    shown = shown.select("review_id", "parent_id", "is_deleted", F.row_number().over(order).cast("long").alias("position"))
    counts = shown.groupBy(F.col("parent_id").alias("review_id")).agg(F.count("*").alias("replies"))
    roots = reviews.where("parent_id is null").join(counts, "review_id", "left").withColumn("replies", F.coalesce("replies", F.lit(0)))
    roots = roots.where("not is_deleted or replies > 0").select("review_id", "parent_id", F.col("is_deleted").alias("placeholder"), F.lit(0).cast("long").alias("position"))
    return roots.union(shown.select("review_id", "parent_id", "is_deleted", "position"))


def reaction_view(reactions: DataFrame, me: int) -> DataFrame:
    """Likes, dislikes and my own reaction for every review; reactions: review_id, user_id, kind."""
    mine = F.max(F.when(F.col("user_id") == me, F.col("kind")))
    return reactions.groupBy("review_id").agg(F.count_if(F.col("kind") == "liked").alias("likes"), F.count_if(F.col("kind") == "disliked").alias("dislikes"), mine.alias("mine"))


def renumber_days(lessons: DataFrame, edits: DataFrame) -> DataFrame:
    """Days after deletions and insertions: edits (plan_id, day_number, kind) with kind insert (after that day) or delete."""
    gone = edits.where("kind = 'delete'").select("plan_id", "day_number")
    new = edits.where("kind = 'insert'").select(F.lit(None).cast("long").alias("lesson_id"), "plan_id", "day_number", F.lit(1).alias("place"))
    rows = lessons.join(gone, ["plan_id", "day_number"], "left_anti").select("lesson_id", "plan_id", "day_number", F.lit(0).alias("place")).union(new)
    n = F.row_number().over(W.partitionBy("plan_id").orderBy("day_number", "place", F.asc_nulls_last("lesson_id")))
    return rows.select("lesson_id", "plan_id", n.cast("long").alias("day_number"))


def unlock_lessons(lessons: DataFrame, completed: DataFrame) -> DataFrame:
    """Status of every lesson for each learner of its plan: completed, open after a completed one (or the first day), locked."""
    learners = completed.select("user_id", "plan_id").distinct()
    done = completed.select("user_id", "plan_id", "day_number").distinct().withColumn("done", F.lit(True))
    rows = learners.join(lessons.select("lesson_id", "plan_id", "day_number"), "plan_id").join(done, ["user_id", "plan_id", "day_number"], "left")
    done_col = F.coalesce("done", F.lit(False))
    before = F.lag(done_col).over(W.partitionBy("user_id", "plan_id").orderBy("day_number", "lesson_id"))
    status = F.when(done_col, "completed").when(before | (F.col("day_number") == 1), "in-progress").otherwise("locked")
    return rows.select("user_id", "lesson_id", status.alias("status"))


def trim_history(conversations: DataFrame, turns: int) -> DataFrame:
    """The last turns of every conversation that have a role and a text."""
    kept = conversations.where("role <> '' and text <> ''")
    n = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    return kept.withColumn("n", n).where(F.col("n") <= turns).drop("n")


def fit_budget(ranked: DataFrame, key: str, limit: int = 12_000, rank: str = "rank", text: str = "content") -> DataFrame:
    """Rows in rank order up to the first that would overflow the budget of characters."""
    total = F.sum(F.length(text)).over(W.partitionBy(key).orderBy(rank).rowsBetween(W.unboundedPreceding, W.currentRow))
    return ranked.withColumn("total", total).where(F.col("total") <= limit).drop("total")


def concept_memory(concepts: DataFrame) -> DataFrame:
    """The first day of each concept in a plan, and whether a day repeats it; concepts: plan_id, day_number, concept."""
    first = F.min("day_number").over(W.partitionBy("plan_id", "concept"))
    return concepts.distinct().select("plan_id", "day_number", "concept", first.alias("first_day"), (first < F.col("day_number")).alias("already_taught"))


def uniform_cap(chunks: DataFrame, key: str, order: str, cap: int = 150) -> DataFrame:
    """At most cap rows of each key, evenly spaced: rows floor(i n / cap + 1/2) for i below cap, where n is above cap."""
    w = W.partitionBy(key)
    rows = chunks.withColumns({"_i": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count("*").over(w)})
    # a row is kept if one of the few k near its own share gives it; the formula itself decides, so no rounding is lost
    near = F.floor(F.col("_i") * cap / F.col("_n")).cast("int")
    gives = lambda k: k.between(0, cap - 1) & (F.least(F.floor(k * (F.col("_n") / cap) + 0.5), F.col("_n") - 1) == F.col("_i"))
    return rows.where((F.col("_n") <= cap) | F.exists(F.sequence(near - 2, near + 2), gives)).drop("_i", "_n")


def keep_first(df: DataFrame, key: Column, within: list[str], order: list[Column]) -> DataFrame:
    """The first row for each key within a group."""
    n = F.row_number().over(W.partitionBy(*within, key).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def disambiguate_titles(items: DataFrame, key: Column) -> DataFrame:
    """Repeated titles of a plan get (2), (3), … appended one after the other."""
    n = F.row_number().over(W.partitionBy("plan_id", key).orderBy("day_number"))
    more = F.aggregate(F.when(F.col("n") > 1, F.sequence(F.lit(2), F.col("n"))).otherwise(F.array().cast("array<int>")), F.lit(""), lambda s, k: F.concat(s, F.lit(" ("), k.cast("string"), F.lit(")")))
    return items.withColumn("n", n).withColumn("title", F.concat("title", more)).drop("n")


def manual_course(specs: DataFrame) -> DataFrame:
    """Empty lessons for day 1 to the wished number (7 if none, 30 at most)."""
    days = F.greatest(F.lit(1), F.least(F.lit(30), F.coalesce(F.nullif(F.col("days"), F.lit(0)), F.lit(7))))
    return specs.select("plan_id", F.explode(F.sequence(F.lit(1), days.cast("int"))).alias("day_number"))


# rankings


def market_courses(plans: DataFrame, enrollments: DataFrame, reviews: DataFrame, downloads: DataFrame) -> DataFrame:
    """Live public courses with students, rating, reviews and weekly downloads, and their places by students, by
    downloads and by age: statistics are aggregated first, then met on the plan."""
    listed = plans.where("is_public and not is_deleted")
    out = listed.join(enrollments, "plan_id", "left").join(reviews, "plan_id", "left").join(downloads, "plan_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("plan_id", "created_rank", zero("students"), F.coalesce("avg_rating", F.lit(0.0)).alias("avg_rating"), zero("review_count"), zero("downloads"))


#: Learners and questions that are met in one cell.
LEARNERS, QUESTIONS = 1024, 16384


def first_of_cells(cells: DataFrame, ids: dict[str, str]) -> DataFrame:
    """(lesson_id, difficulty, quota, need, user_id, question_id): of each cell's questions those that can be among the need first of a
    learner by the hash of head and tail. cells: lesson_id, difficulty, quota, need, users (user_id, head), questions (question_id, tail)."""
    rest = ["lesson_id", "difficulty", "quota", "need"]
    names = [*rest, "user_id", "question_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(len(b)):
                row = b.slice(k, 1)
                users, questions = row.column("users").flatten(), row.column("questions").flatten()
                heads, tails = ([t.encode() for t in x.field(1).to_pylist()] for x in (users, questions))
                i, j = smallest(heads, tails, row.column("need")[0].as_py())
                for at in range(0, len(i), 65536):
                    u, q = (pa.array(x[at : at + 65536]) for x in (i, j))
                    same = [row.column(c).take(pa.array(np.zeros(len(u), np.int64))) for c in rest]
                    yield pa.RecordBatch.from_arrays([*same, users.field(0).take(u), questions.field(0).take(q)], names=names)

    return cells.mapInArrow(work, ", ".join(f"{c} {ids[c]}" for c in names))


def select_adaptive(pool: DataFrame, learners: DataFrame, n: int, seed: str) -> DataFrame:
    """n questions for each learner and lesson, mixed by level, topped up from the rest, in a seeded order.

    Only the first of each difficulty can be chosen: as many as its quota and as all quotas together lack. The order is a hash of learner
    and question, so every pair of a lesson is hashed, by whole arrays (digests): learners and questions of a lesson are dealt to blocks,
    two blocks are a cell of a fixed size at most, and only the first questions of each learner leave it."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    head, tail = F.concat(F.lit(f"{seed}:"), text("user_id"), F.lit(":")), text("question_id")
    quota = F.lit(0)
    for lv, mix in LEVEL_MIX.items():
        for d, share in zip(("easy", "medium", "hard"), mix):
            quota = F.when((F.col("level") == lv) & (F.col("difficulty") == d), F.floor(F.lit(n * share) + 0.5)).otherwise(quota)
    small_batches(pool.sparkSession)
    asked = written(learners.select("user_id", "lesson_id", F.coalesce("level", F.lit("")).alias("level")), "learners-of-lessons")
    questions = pool.select("lesson_id", "question_id", F.coalesce("difficulty", F.lit("")).alias("difficulty"))
    # what a lesson has of each difficulty, and what learners of each level need of it
    sizes = questions.groupBy("lesson_id", "difficulty").agg(F.count("*").alias("size"))
    levels = asked.groupBy("lesson_id", "level").agg(F.ceil(F.count("*") / LEARNERS).cast("int").alias("blocks"))
    need = levels.join(sizes, "lesson_id").withColumn("quota", quota.cast("long"))
    missing = F.lit(n) - F.sum(F.least("quota", "size")).over(W.partitionBy("lesson_id", "level"))
    need = need.withColumn("need", F.least(F.col("size"), F.col("quota") + F.greatest(missing, F.lit(0)))).where("need > 0")
    need = written(need.select("lesson_id", "level", "difficulty", "blocks", "size", "quota", "need"), "questions-needed")

    dealt = lambda c, blocks: F.pmod(F.xxhash64(c), blocks).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), blocks - 1))
    parts = F.ceil(F.col("size") / QUESTIONS).cast("int")
    users = asked.join(unsent(levels), ["lesson_id", "level"]).groupBy("lesson_id", "level", dealt("user_id", F.col("blocks")).alias("block"))
    users = users.agg(F.collect_list(F.struct("user_id", head.alias("head"))).alias("users"))
    held = questions.join(unsent(sizes), ["lesson_id", "difficulty"]).groupBy("lesson_id", "difficulty", dealt("question_id", parts).alias("part"))
    held = held.agg(F.collect_list(F.struct("question_id", tail.alias("tail"))).alias("questions"))
    pairs = need.withColumn("block", every(F.col("blocks"))).withColumn("part", every(parts)).select("lesson_id", "level", "difficulty", "block", "part", "quota", "need")
    cells = pairs.join(unsent(users), ["lesson_id", "level", "block"]).join(unsent(held), ["lesson_id", "difficulty", "part"])
    # a cell is small and takes long, so it is dealt by number, which adaptive plans leave alone
    tasks = max(int(pool.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * pool.sparkSession.sparkContext.defaultParallelism)
    cells = cells.repartition(tasks, "lesson_id", "level", "difficulty", "block", "part").select("lesson_id", "difficulty", "quota", "need", "users", "questions")
    kept = written(first_of_cells(cells, {**dict(asked.dtypes), **dict(questions.dtypes), **dict(need.dtypes)}), "questions-near")

    who = W.partitionBy("user_id", "lesson_id")
    group = W.partitionBy("user_id", "lesson_id", "difficulty")
    q = kept.withColumn("o", F.md5(F.concat(head, tail)))
    q = q.withColumn("_n", F.row_number().over(group.orderBy("o"))).where("_n <= need").withColumn("in_quota", F.col("_n") <= F.col("quota"))
    q = q.withColumn("place", F.row_number().over(who.orderBy(F.desc("in_quota"), "o"))).where(F.col("place") <= n)
    return q.select("user_id", "lesson_id", "question_id", F.row_number().over(who.orderBy("o")).alias("position"))


def filter_by_score(hits: DataFrame, key: str, threshold: float, min_keep: int) -> DataFrame:
    """Hits of at least the threshold; the best min_keep where fewer pass."""
    n = F.row_number().over(W.partitionBy(key).orderBy(F.desc("score"), "chunk_id"))
    return hits.withColumn("rank", n).where((F.col("score") >= threshold) | (F.col("rank") <= min_keep))


def select_diverse(hits: DataFrame, key: str, k: int) -> DataFrame:
    """k chunks with distinct 80-character beginnings: unused before used, better before worse."""
    squeezed = F.lower(F.substring(F.trim(F.regexp_replace("content", r"\s+", " ")), 1, 80))
    best = [F.asc("used"), F.desc("score"), F.asc("chunk_id")]
    one = keep_first(hits, squeezed, [key], best)
    return one.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*best))).where(F.col("rank") <= k)


def unsent(df: DataFrame) -> DataFrame:
    """df for a join that never broadcasts either side. Files of few distinct values are much smaller than their rows, so Spark would take a
    table that grows with the input for a small one and send it through the driver."""
    return df.hint("merge")


def contained(texts: DataFrame, needles: DataFrame, key: str, text: str, needle: str) -> DataFrame:
    """(key, needle) where the needle is in the text. An inverted index of the texts' character trigrams: a needle of which one is
    in no text is nowhere; any other meets the texts of its rarest one only, and is looked for in those. Needles of one or two characters
    are their own index entry. Equal texts are indexed once."""
    grams = lambda c, n: F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n)))
    some = lambda c, n: F.when(F.length(c) >= n, grams(c, n)).otherwise(F.array().cast("array<string>"))
    wanted = needles.select(needle).where(F.length(needle) > 0).distinct()
    own = F.when(F.length(needle) < 3, F.array(needle)).otherwise(F.array_distinct(grams(F.col(needle), 3)))
    asked = wanted.select(needle, F.explode(own).alias("_gram"))
    held = texts.select(text).distinct().select(text, F.explode(F.array_distinct(F.concat(some(F.col(text), 1), some(F.col(text), 2), some(F.col(text), 3)))).alias("_gram"))
    counts = held.groupBy("_gram").agg(F.count("*").alias("_n"))
    met = asked.join(unsent(counts), "_gram", "left").groupBy(needle).agg(F.min_by("_gram", "_n").alias("_gram"), F.count_if(F.col("_n").isNull()).alias("_none"))
    found = held.join(unsent(met.where("_none = 0").select(needle, "_gram")), "_gram").where(F.contains(text, F.col(needle))).select(text, needle)
    return texts.join(unsent(found), text).select(key, needle)


def recommend_courses(users: DataFrame, plans: DataFrame, memory: DataFrame, students: DataFrame, ratings: DataFrame, top: int = 10, candidates: int = 40) -> DataFrame:
    """Courses for every user by interests: 3 for a category and 2 for each tag or normal tag of own courses, 1 for each topic
    (of the ten best remembered, and title keywords) in a course's title. The first 40 matches are candidates; where
    they are fewer than six, the 30 newest join them. Then students, then rating. The first 40 of all matches are among the
    first 40 of each interest, so users meet a list of 40 for each of theirs, and only their candidates are scored. memory: user_id, topic, count."""
    live = plans.where("is_public and not is_deleted")
    own = plans.where("not is_deleted").withColumnRenamed("owner_id", "user_id")
    small = lambda c: F.transform(c, lambda x: F.lower(F.trim(x)))
    both = lambda d: F.concat(small("tags"), F.transform("tags", lambda x: F.lower(normalize_tag(x))))
    best = memory.withColumn("n", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("count"), "topic"))).where("n <= 10")
    topics = best.select("user_id", F.lower(F.trim("topic")).alias("topic")).union(own.select("user_id", F.explode(title_keywords("title")))).where("topic <> ''").distinct()
    named = contained(live.select("plan_id", F.lower("title").alias("t")), topics, "plan_id", "t", "topic")

    # an interest is a weight and a word; what it is in a course can be there more than once (tags), in a user once
    held = (
        live.select("plan_id", F.lit(3).alias("w"), F.col("category").alias("word"))
        .union(live.select("plan_id", F.lit(2), F.explode(both(live)))).union(named.select("plan_id", F.lit(1), "topic")).groupBy("plan_id", "w", "word").agg(F.count("*").alias("times"))
    )
    held = written(held, "interests-of-courses")
    mine = own.select("user_id", F.lit(3).alias("w"), F.col("category").alias("word")).union(own.select("user_id", F.lit(2), F.explode(both(own)))).union(topics.select("user_id", F.lit(1), "topic")).distinct()
    mine = written(mine, "interests-of-users")
    heads = held.withColumn("n", F.row_number().over(W.partitionBy("w", "word").orderBy("plan_id"))).where(F.col("n") <= candidates)
    lists = heads.groupBy("w", "word").agg(F.collect_list("plan_id").alias("plans"))  # at most 40
    near = mine.join(unsent(lists), ["w", "word"]).select("user_id", F.explode("plans").alias("plan_id")).distinct()
    near = near.withColumn("n", F.row_number().over(W.partitionBy("user_id").orderBy("plan_id"))).where(F.col("n") <= candidates).drop("n")
    first = near.join(unsent(held), "plan_id").join(unsent(mine), ["user_id", "w", "word"]).groupBy("user_id", "plan_id").agg(F.sum(F.col("w") * F.col("times")).alias("score"))
    first = written(first, "first-courses")

    better = [F.desc(F.coalesce("students", F.lit(0))), F.desc(F.coalesce("avg_rating", F.lit(0.0))), F.asc("plan_id")]
    standing = written(students.join(ratings.select("plan_id", "avg_rating"), "plan_id", "full"), "standing-of-courses")
    known = lambda d: d.join(unsent(standing), "plan_id", "left")
    newest = [r.plan_id for r in known(live.orderBy(F.desc("created_rank"), "plan_id").limit(30).select("plan_id")).orderBy(*better).select("plan_id").collect()]
    offered = lambda ids: F.array(*map(F.lit, ids)).cast(f"array<{dict(live.dtypes)['plan_id']}>")
    counts = users.select("user_id").join(unsent(first.groupBy("user_id").agg(F.count("*").alias("n"))), "user_id", "left")
    # without candidates everyone has the same list; with few, as many of it as can be among the best
    same = counts.where("n is null").select("user_id", F.posexplode(offered(newest[:top])).alias("place", "plan_id")).select("user_id", "plan_id", F.lit(0).cast("long").alias("score"), F.col("place") + 1)
    more = counts.where("n < 6").select("user_id", F.explode(offered(newest[: top + 5])).alias("plan_id")).join(unsent(first), ["user_id", "plan_id"], "left_anti").select("user_id", "plan_id", F.lit(0).cast("long").alias("score"))
    n = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("score"), *better))
    return known(first.unionByName(more)).select("user_id", "plan_id", "score", n.alias("place")).where(F.col("place") <= top).union(same)


def replies_by_parent(reviews: DataFrame) -> DataFrame:
    """The replies of each root review in order of time."""
    rows = reviews.where("parent_id is not null").groupBy("parent_id")
    return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("created_at", "review_id", "user_id"))), lambda x: x["review_id"]).alias("replies"))
