"""Life of courses, accounts and reports: logs of requests, each checked for who may make it, become the tables' next state.

A request that is not allowed is dropped before anything is decided by it. What remains is decided by aggregates over the
log (the first removal, the last switch), so no log of one record is ever gathered in one place. Rows that several tables
lose are found once, as one written relation of ids, and every table has its own rule for them. Applying the same log
again changes nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import written
from .mutations import last_action

#: What a root review that is taken down, but has replies, says.
TAKEN_DOWN = "[Bình luận này đã bị gỡ do vi phạm]"
#: What the title of an instructor's own copy ends in.
COPY_SUFFIX = " (Bản sao)"


def _is(c: str, other: str) -> Column:
    return F.coalesce(F.col(c) == F.col(other), F.lit(False))


# ---- M4


def delete_plans(plans: DataFrame, requests: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Plans (plan_id, owner_id, instructor_id, is_public, original_plan_id, shared_with, deleted_by_owner, deleted_by_instructor) and the
    other tables (with plan_id) after requests (plan_id, user_id). A listed copy of the market cannot be deleted. Who only received the plan
    leaves shared_with; owner and instructor are marked, and a plan that its owner and its instructor, if it has one, have deleted
    is gone from all tables."""
    asked = requests.select("plan_id", "user_id").distinct().join(plans.select("plan_id", "owner_id", "instructor_id", "is_public", "original_plan_id", "shared_with"), "plan_id")
    asked = asked.where(~(F.col("is_public") & F.col("original_plan_id").isNotNull()))
    owner, instructor = _is("owner_id", "user_id"), _is("instructor_id", "user_id")
    got = F.array_contains("shared_with", F.col("user_id")) & ~owner & ~instructor
    marks = asked.groupBy("plan_id").agg(
        F.max(owner).alias("_o"), F.max(instructor).alias("_i"), F.collect_set(F.when(got, F.col("user_id"))).alias("_left")
    )
    now = plans.join(marks, "plan_id", "left").withColumns({
        "deleted_by_owner": F.col("deleted_by_owner") | F.coalesce("_o", F.lit(False)),
        "deleted_by_instructor": F.col("deleted_by_instructor") | F.coalesce("_i", F.lit(False)),
        "shared_with": F.when(F.size("_left") > 0, F.filter("shared_with", lambda x: ~F.array_contains("_left", x))).otherwise(F.col("shared_with")),
    })
    touched = F.coalesce(F.col("_o") | F.col("_i"), F.lit(False))
    over = touched & F.col("deleted_by_owner") & (F.col("instructor_id").isNull() | F.col("deleted_by_instructor"))
    gone = written(now.where(over).select("plan_id"), "gone-plans")
    out = {"plans": now.drop("_o", "_i", "_left").join(gone, "plan_id", "left_anti")}
    return out | {name: t.join(gone, "plan_id", "left_anti") for name, t in tables.items()}


# ---- M5


def _null_where_gone(df: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    there = gone.select(F.col("user_id").alias("_id"), F.lit(True).alias("_gone"))
    return df.join(there, df[column] == there["_id"], "left").withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).drop("_id", "_gone")


def _without(df: DataFrame, key: str, column: str, gone: DataFrame) -> DataFrame:
    """The array without ids that are gone; only rows that hold one are put together again."""
    hits = df.select(key, F.explode(column).alias("user_id")).join(gone, "user_id").groupBy(key).agg(F.collect_set("user_id").alias("_out"))
    return df.join(hits, key, "left").withColumn(column, F.when(F.col("_out").isNotNull(), F.filter(column, lambda x: ~F.array_contains("_out", x))).otherwise(F.col(column))).drop("_out")


def erase_users(users: DataFrame, ids: DataFrame, plans: DataFrame, reviews: DataFrame, ratings: DataFrame) -> dict[str, DataFrame]:
    """Accounts (ids: user_id) go, except an administrator's: their plans are deleted softly, reviews and ratings stay without a name, their likes
    and dislikes are taken back. plans: owner_id, is_deleted, deleted_by_owner; reviews: review_id, user_id, likes, dislikes; ratings: learner_id."""
    gone = written(users.where("not is_admin").join(ids.select("user_id").distinct(), "user_id", "left_semi").select("user_id"), "gone-users")
    owner = gone.select(F.col("user_id").alias("owner_id"), F.lit(True).alias("_gone"))
    mine = plans.join(owner, "owner_id", "left")
    soft = {c: F.col(c) | F.coalesce("_gone", F.lit(False)) for c in ("is_deleted", "deleted_by_owner")}
    named = _null_where_gone(reviews, "user_id", gone)
    return {
        "users": users.join(gone, "user_id", "left_anti"),
        "plans": mine.withColumns(soft).drop("_gone"),
        "reviews": _without(_without(named, "review_id", "likes", gone), "review_id", "dislikes", gone),
        "ratings": _null_where_gone(ratings, "learner_id", gone),
    }


# ---- M6


def take_reports(reports: DataFrame, plans: DataFrame, reviews: DataFrame, ratings: DataFrame, users: DataFrame) -> DataFrame:
    """New reports (report_id, target_type, target_id, reported_by, reason) with status and snapshot: of a reporter's reports of one target the
    first is pending, the others are rejected; those of an unknown kind or without a reason or target as well. The snapshot keeps a course's title
    and owner, a review's text and writer, a rating's stars and learner; only what is reported meets the users' names."""
    fit = F.col("target_type").isin("course", "review", "instructorRating") & F.col("target_id").isNotNull() & F.coalesce(F.col("reason") != "", F.lit(False))
    first = reports.where(fit).groupBy("target_type", "target_id", "reported_by").agg(F.min("report_id").alias("report_id")).select("report_id", F.lit(True).alias("_first"))
    name, asked = users.select("user_id", "full_name"), written(reports.select("target_type", "target_id").distinct(), "reported")
    kept = lambda kind, t, key, text, who: (
        t.select(F.col(key).alias("target_id"), F.col(text).cast("string").alias("snapshot"), F.col(who).alias("user_id"))
        .join(asked.where(F.col("target_type") == kind).select("target_id"), "target_id", "left_semi").join(name, "user_id", "left")
        .select(F.lit(kind).alias("target_type"), "target_id", "snapshot", F.col("full_name").alias("snapshot_author"))
    )
    shots = kept("course", plans, "plan_id", "title", "owner_id").unionByName(kept("review", reviews, "review_id", "content", "user_id")).unionByName(kept("instructorRating", ratings, "rating_id", "stars", "learner_id"))
    rows = reports.join(first, "report_id", "left").join(shots, ["target_type", "target_id"], "left")
    return rows.withColumn("status", F.when(F.col("_first"), "pending").otherwise("rejected")).drop("_first")


def moderate(reports: DataFrame, decisions: DataFrame, plans: DataFrame, reviews: DataFrame, ratings: DataFrame, users: DataFrame) -> dict[str, DataFrame]:
    """All tables after an administrator's decisions (seq, report_id, action: resolve or dismiss, actor), in order of seq; of the reports that were there
    before. Others' decisions and those on reports that are not pending any more have no effect.

    A dismissal settles its report. The first resolution of a target settles all its pending reports and takes the target down: a course is deleted
    and not public; a review is deleted, and a root one with a live reply at that time says so in place of its text; a rating goes and the instructor's
    average (to one place, 0 without ratings) and count are taken anew. plans: plan_id, is_public, is_deleted; reviews: review_id,
    parent_id, content, is_deleted; ratings: rating_id, instructor_id, stars; users: user_id, is_admin, avg_rating, rating_count."""
    may = users.where("is_admin").select(F.col("user_id").alias("actor"))
    target = ["target_type", "target_id"]
    pending = reports.where("status = 'pending'").select("report_id", *target)
    log = decisions.join(may, "actor", "left_semi").join(pending, "report_id")
    dismissed = log.where("action = 'dismiss'").groupBy("report_id").agg(F.min("seq").alias("off"))
    asked = log.where("action = 'resolve'").join(dismissed, "report_id", "left").where("off is null or seq < off")
    down = written(asked.groupBy(*target).agg(F.min("seq").alias("down")), "taken-down")
    settled = reports.join(dismissed, "report_id", "left").join(down, target, "left")
    before = F.col("off").isNotNull() & (F.col("down").isNull() | (F.col("off") < F.col("down")))
    status = F.when(F.col("status") != "pending", F.col("status")).when(before, "dismissed").when(F.col("down").isNotNull(), "resolved").otherwise(F.col("status"))
    of = lambda kind, key: down.where(F.col("target_type") == kind).select(F.col("target_id").alias(key), "down")

    courses = plans.join(of("course", "plan_id"), "plan_id", "left")
    courses = courses.withColumns({"is_deleted": F.col("is_deleted") | F.col("down").isNotNull(), "is_public": F.col("is_public") & F.col("down").isNull()}).drop("down")

    marked = reviews.join(of("review", "review_id"), "review_id", "left")
    hidden = F.col("down").isNotNull() & ~F.col("is_deleted")
    replies = marked.where("parent_id is not null and not is_deleted").select(F.col("parent_id").alias("review_id"), F.coalesce("down", F.lit(2**62)).alias("until"))
    replies = replies.join(of("review", "review_id").select("review_id"), "review_id", "left_semi")  # others' replies do not matter
    live = replies.groupBy("review_id").agg(F.max("until").alias("until"))  # the reply that is there longest
    marked = marked.join(live, "review_id", "left")
    kept = hidden & F.col("parent_id").isNull() & F.coalesce(F.col("until") > F.col("down"), F.lit(False))
    shown = marked.withColumns({"content": F.when(kept, TAKEN_DOWN).otherwise(F.col("content")), "is_deleted": F.col("is_deleted") | hidden}).drop("down", "until")

    rated = ratings.join(of("instructorRating", "rating_id"), "rating_id", "left")
    left = rated.where("down is null").drop("down")
    changed = rated.where("down is not null").select("instructor_id").distinct()
    fresh = changed.join(left, "instructor_id", "left").groupBy("instructor_id").agg(F.round(F.coalesce(F.avg("stars"), F.lit(0.0)), 1).alias("_avg"), F.count("stars").alias("_n"))
    people = users.join(fresh.withColumnRenamed("instructor_id", "user_id"), "user_id", "left")
    people = people.withColumns({"avg_rating": F.coalesce("_avg", "avg_rating"), "rating_count": F.coalesce("_n", "rating_count")}).drop("_avg", "_n")
    return {"reports": settled.withColumn("status", status).drop("off", "down"), "plans": courses, "reviews": shown, "ratings": left, "users": people}


# ---- M12


def apply_visibility(plans: DataFrame, log: DataFrame, admins: DataFrame) -> DataFrame:
    """plan_id, is_public and is_deleted after a log (plan_id, actor, action, seq). Only the owner lists (as long as the plan is not deleted), unlists, and removes an
    imported plan; only an administrator takes down, which deletes and hides. Whoever else asks, nothing changes, and an earlier request
    of the owner stays in force."""
    rows = log.join(plans.select("plan_id", "owner_id", "source_type", "is_deleted"), "plan_id").join(admins.select(F.col("user_id").alias("actor"), F.lit(True).alias("_admin")).distinct(), "actor", "left")
    mine, act = _is("owner_id", "actor"), F.col("action")
    down = F.coalesce("_admin", F.lit(False)) & (act == "takedown")
    remove = mine & (act == "remove_import") & (F.col("source_type") == "imported") & ~F.col("is_deleted")
    rows = rows.where((mine & act.isin("list", "unlist")) | down | remove)
    ends = rows.groupBy("plan_id").agg(F.min(F.when(down | remove, F.col("seq"))).alias("_end"))
    in_time = ~F.col("is_deleted") & (F.col("_end").isNull() | (F.col("seq") < F.col("_end")))
    switch = F.when(act == "list", F.when(in_time, True)).when(act.isin("unlist", "takedown"), False)
    last = rows.join(ends, "plan_id").withColumn("_switch", switch).where("_switch is not null").groupBy("plan_id").agg(F.max_by("_switch", "seq").alias("_switch"))
    out = plans.join(ends, "plan_id", "left").join(last, "plan_id", "left")
    return out.select("plan_id", F.coalesce("_switch", "is_public").alias("is_public"), (F.col("is_deleted") | F.col("_end").isNotNull()).alias("is_deleted"))


# ---- M7, M14


def publish_drafts(lessons: DataFrame, plans: DataFrame, requests: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """Lessons and plans after instructors or owners (requests: plan_id, user_id) have sent their changes: draft fields that are set overwrite those of
    lessons with a draft, drafts are cleared, the plan's draft title is its title, its status is reviewed."""
    asked = requests.join(plans.select("plan_id", "owner_id", "instructor_id"), "plan_id").where(_is("owner_id", "user_id") | _is("instructor_id", "user_id"))
    sent = asked.select("plan_id", F.lit(True).alias("_sent")).distinct()
    open_ = F.coalesce("_sent", F.lit(False)) & F.col("has_draft") & ~F.col("is_deleted")
    rows = lessons.join(sent, "plan_id", "left").withColumn("_open", open_)
    for f in fields:
        rows = rows.withColumn(f, F.when(F.col("_open"), F.coalesce(f"draft_{f}", f)).otherwise(F.col(f))).withColumn(f"draft_{f}", F.when(~F.col("_open"), F.col(f"draft_{f}")))
    rows = rows.withColumn("has_draft", F.col("has_draft") & ~F.col("_open")).drop("_open", "_sent")
    done = plans.join(sent, "plan_id", "left").withColumn("_sent", F.coalesce("_sent", F.lit(False)))
    titled = F.col("_sent") & F.col("has_title_draft") & F.coalesce(F.col("draft_title") != "", F.lit(False))
    done = done.withColumn("_titled", titled).withColumns({
        "title": F.when(F.col("_titled"), F.col("draft_title")).otherwise(F.col("title")), "has_title_draft": F.col("has_title_draft") & ~F.col("_titled"),
        "draft_title": F.when(~F.col("_titled"), F.col("draft_title")), "status": F.when(F.col("_sent"), "reviewed").otherwise(F.col("status")),
    })
    return rows, done.drop("_sent", "_titled")


def stage_edits(lessons: DataFrame, plans: DataFrame, edits: DataFrame, fields: list[str]) -> DataFrame:
    """Lessons after a log of edits (lesson_id, editor_id, seq, new_<field>). The owner's of a plan without a student are written at once; the owner's or the
    instructor's of other plans become the draft; anyone else's are dropped. The last of each kind counts."""
    rows = edits.join(lessons.select("lesson_id", "plan_id"), "lesson_id").join(plans.select("plan_id", "owner_id", "instructor_id", "student_id"), "plan_id")
    at_once = _is("owner_id", "editor_id") & F.col("student_id").isNull()
    rows = rows.where(_is("owner_id", "editor_id") | _is("instructor_id", "editor_id")).withColumn("_now", at_once)
    last = last_action(rows, ["lesson_id", "_now"], ["seq"])
    pick = lambda now, kind: last.where(F.col("_now") == now).select("lesson_id", F.lit(True).alias(kind), *[F.col(f"new_{f}").alias(f"{kind}_{f}") for f in fields])
    out = lessons.join(pick(True, "_w"), "lesson_id", "left").join(pick(False, "_d"), "lesson_id", "left")
    for f in fields:
        out = out.withColumn(f, F.when(F.col("_w"), F.col(f"_w_{f}")).otherwise(F.col(f))).withColumn(f"draft_{f}", F.when(F.col("_d"), F.col(f"_d_{f}")).otherwise(F.col(f"draft_{f}")))
    return out.withColumn("has_draft", F.col("has_draft") | F.coalesce("_d", F.lit(False))).drop("_w", "_d", *[f"{k}_{f}" for k in ("_w", "_d") for f in fields])


def stage_titles(plans: DataFrame, edits: DataFrame) -> DataFrame:
    """Plans with the last new title of a log (plan_id, new_title, seq) as their draft title."""
    last = last_action(edits, ["plan_id"], ["seq"]).select("plan_id", F.trim("new_title").alias("_title"))
    out = plans.join(last, "plan_id", "left")
    return out.withColumns({"draft_title": F.coalesce("_title", "draft_title"), "has_title_draft": F.col("has_title_draft") | F.col("_title").isNotNull()}).drop("_title")


# ---- M1


def copy_courses(plans: DataFrame, lessons: DataFrame, requests: DataFrame, first_id: int) -> tuple[DataFrame, DataFrame]:
    """New plans and lessons for requests (request_id, plan_id, user_id, kind, instructor_id); a new plan's id is first_id plus its request's.

    import: anyone's private copy; the first day is open, the others locked. market: the owner's public copy of a plan that is not deleted and has
    none yet, drafts merged. assign: a copy for an instructor, unless the owner has sent them one before. self: the owner's or instructor's own copy under
    another title, drafts merged. Deleted lessons are not copied. A merged draft's title, content or summary counts unless it is empty."""
    kind = F.col("kind")
    rows = requests.select("request_id", "plan_id", "user_id", "kind", F.col("instructor_id").alias("to_id")).join(plans, "plan_id")
    known = plans.where("original_plan_id is not null").select(F.col("original_plan_id").alias("plan_id"), F.col("owner_id").alias("_owner"), F.col("instructor_id").alias("_to"), F.col("is_public").alias("_public"))
    listed = known.where("_public").select("plan_id", F.lit("market").alias("kind")).distinct()
    sent = known.where("_to is not null").select("plan_id", F.col("_owner").alias("user_id"), F.col("_to").alias("to_id"), F.lit("assign").alias("kind")).distinct()
    mine = _is("owner_id", "user_id")
    may = (kind == "import") | ((kind == "market") & mine & ~F.col("is_deleted")) | ((kind == "assign") & F.col("to_id").isNotNull()) | ((kind == "self") & (mine | _is("instructor_id", "user_id")))
    rows = rows.where(may).join(listed, ["plan_id", "kind"], "left_anti").join(sent, ["plan_id", "user_id", "to_id", "kind"], "left_anti")
    once = F.when(kind == "market", F.lit("")).when(kind == "assign", F.concat_ws(":", "user_id", "to_id")).otherwise(F.col("request_id").cast("string"))
    rows = rows.withColumn("_once", once)
    first = rows.groupBy("plan_id", "kind", "_once").agg(F.min("request_id").alias("request_id")).select("request_id")
    rows = rows.join(first, "request_id", "left_semi")
    new = rows.select(
        (F.lit(first_id) + F.col("request_id")).alias("new_plan_id"), F.col("plan_id").alias("source_id"), "kind", F.col("user_id").alias("owner_id"),
        F.when(kind == "self", F.concat("title", F.lit(COPY_SUFFIX))).otherwise(F.col("title")).alias("title"), "level",
        F.when(kind == "market", F.col("instructor_id")).when(kind == "assign", F.col("to_id")).alias("instructor_id"),
        F.when(kind == "self", F.col("original_plan_id")).otherwise(F.col("plan_id")).alias("original_plan_id"),
        F.when(kind == "import", False).when(kind == "market", True).otherwise(F.col("is_public")).alias("is_public"),
        F.when(kind == "import", F.when(F.col("is_public"), "imported").otherwise("shared_import")).when(kind == "assign", "assigned").when(kind == "self", "self").otherwise(F.col("source_type")).alias("source_type"),
        F.when(kind == "assign", "teaching").when(kind.isin("self", "import"), "pending").otherwise(F.col("status")).alias("status"),
    )
    old = new.select("new_plan_id", F.col("source_id").alias("plan_id"), "kind").join(lessons.where("not is_deleted"), "plan_id")
    merged = kind.isin("market", "self") & F.col("has_draft")
    best = lambda f: F.when(merged, F.coalesce(F.nullif(f"draft_{f}", F.lit("")), f)).otherwise(F.col(f)).alias(f)
    status = F.when(kind == "import", F.when(F.col("day_number") == 1, "in-progress").otherwise("locked")).otherwise(F.col("status"))
    clear = kind.isin("market", "self")
    summary = F.when(kind == "self", best("summary")).otherwise(F.col("summary")).alias("summary")
    return new, old.select("new_plan_id", F.col("lesson_id").alias("source_lesson_id"), "day_number", best("title"), best("content"), summary, status.alias("status"), (F.col("has_draft") & ~clear).alias("has_draft"))


# ---- M8, M13


def apply_account_changes(users: DataFrame, log: DataFrame) -> DataFrame:
    """user_id, roles and is_banned after a log (user_id, action: instructor, learner, ban or unban; seq). Administrators' roles stay and they cannot be banned, but unbanned.
    A change to learner takes the instructor role and leaves or gives that of a learner."""
    rows = log.join(users.select("user_id", "is_admin"), "user_id").where("not is_admin or action = 'unban'")
    role = F.col("action").isin("instructor", "learner")
    # max_by of seq over each kind of action: one small aggregate
    last = rows.groupBy("user_id").agg(
        F.max_by("action", F.when(role, F.col("seq"))).alias("_role"), F.max_by("action", F.when(~role, F.col("seq"))).alias("_ban"), F.count_if(F.col("action") == "learner").alias("_learner"), F.count_if(role).alias("_n"), F.count_if(~role).alias("_m")
    )
    out = users.join(last, "user_id", "left")
    plus = F.when(F.col("_learner") > 0, F.array_union("roles", F.array(F.lit("learner")))).otherwise(F.col("roles"))
    roles = F.when((F.col("_n") > 0) & (F.col("_role") == "instructor"), F.array_union(plus, F.array(F.lit("instructor")))).when(F.col("_n") > 0, F.array_remove(plus, "instructor")).otherwise(F.col("roles"))
    banned = F.when(F.col("_m") > 0, F.col("_ban") == "ban").otherwise(F.col("is_banned"))
    return out.select("user_id", F.array_sort(roles).alias("roles"), banned.alias("is_banned"))


def replace_records(df: DataFrame, updates: DataFrame, key: str, valid: Column | None = None, derived: dict[str, Column] | None = None) -> DataFrame:
    """df with the last valid update of each key (seq) in place of its row; derived columns are made from the new row. Updates of unknown keys are dropped."""
    good = updates if valid is None else updates.where(valid)
    last = last_action(good, [key], ["seq"]).drop("seq").join(df.select(key), key, "left_semi")
    rest = [c for c in df.columns if c not in last.columns and c not in (derived or {})]
    new = last.join(df.select(key, *rest), key).withColumns(derived or {}).select(df.columns)
    return df.join(last.select(key), key, "left_anti").unionByName(new)


def union_of(parts: dict[str, DataFrame]) -> DataFrame:
    """Rows (id, state) of several tables as one, with the table's name as part."""
    return reduce(DataFrame.unionByName, [d.select(F.lit(n).alias("part"), F.col("id").cast("long").alias("id"), F.col("state").cast("string").alias("state")) for n, d in parts.items()])
