"""Projections and predicates over platform tables."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that no public view shows.
SECRET = ("password", "refreshToken", "refresh_token", "is_deleted", "deleted_at")
LEVELS = {"easy": ("easy", "basic"), "medium": ("medium", "intermediate"), "hard": ("hard", "advanced")}


def public_view(df: DataFrame) -> DataFrame:
    """Without passwords, tokens and deletion marks."""
    return df.drop(*SECRET)


def condition(spec: dict[str, Any]) -> Column:
    """A document filter as a Column: {"a": 1, "b": {"$gte": 2}, "$or": [...], "$nor": [...]}.

    A missing value is not equal to any value, so $ne and $nin hold for nulls.
    """
    ops = {
        "$ne": lambda c, v: ~c.eqNullSafe(F.lit(v)),
        "$in": lambda c, v: F.coalesce(c.isin(*v), F.lit(False)),
        "$nin": lambda c, v: ~F.coalesce(c.isin(*v), F.lit(False)),
        "$gte": lambda c, v: c >= v,
        "$gt": lambda c, v: c > v,
        "$lte": lambda c, v: c <= v,
        "$lt": lambda c, v: c < v,
        "$exists": lambda c, v: c.isNotNull() if v else c.isNull(),
        "$size": lambda c, v: F.size(c) == v,
    }
    terms = [F.lit(True)]
    for key, value in spec.items():
        if key in ("$or", "$nor", "$and"):
            parts = [condition(v) for v in value]
            joined = reduce((lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b), parts)
            terms.append(~joined if key == "$nor" else joined)
        elif isinstance(value, dict):
            terms += [ops[op](F.col(key), v) for op, v in value.items()]
        else:
            terms.append(F.col(key).eqNullSafe(F.lit(value)))
    return reduce(lambda a, b: a & b, terms)


def where_doc(df: DataFrame, spec: dict[str, Any]) -> DataFrame:
    return df.where(condition(spec))


def icontains(col: str | Column, term: str) -> Column:
    """Case-insensitive search for a plain string."""
    return F.contains(F.lower(col), F.lit(term.lower()))


def iregex_any(df: DataFrame, cols: list[str], pattern: str) -> DataFrame:
    """Rows in which any of the columns (strings or arrays of strings) matches a case-insensitive pattern."""
    p = F.lit(f"(?iu){pattern}")
    tests = [F.exists(c, lambda x: F.rlike(x, p)) if df.schema[c].dataType.typeName() == "array" else F.rlike(F.col(c), p) for c in cols]
    return df.where(reduce(lambda a, b: a | b, tests))


def has_any(col: str, values: list) -> Column:
    return F.arrays_overlap(F.col(col), F.array(*[F.lit(v) for v in values]))


def filter_level(plans: DataFrame, level: str) -> DataFrame:
    """Levels by their synonyms, without regard to case; an unknown level is compared as it is."""
    return plans.where(F.lower("level").isin(*LEVELS.get(level.lower(), (level.lower(),))))


def filter_category(plans: DataFrame, key: str, synonyms: dict[str, list[str]], labels: str = "tags") -> DataFrame:
    """Plans that carry any label of a canonical category; an unknown key is a label itself."""
    return plans.where(has_any(labels, synonyms.get(key, [key])))


def visible_plans(plans: DataFrame, user: int) -> DataFrame:
    """What an owner or instructor sees: not deleted, and no public copy of another course."""
    mine = (F.col("owner_id") == user) | F.coalesce(F.col("instructor_id") == user, F.lit(False))
    return plans.where(mine & ~F.col("is_deleted") & ~(F.col("original_plan_id").isNotNull() & F.col("is_public")))


def search_quizzes(quizzes: DataFrame, keyword: str, title: str = "title") -> DataFrame:
    """Titles that share a word with the keyword, scored by the number of shared words."""
    words = F.array_distinct(F.split(F.lower(title), "[^a-z0-9]+"))
    wanted = F.array(*[F.lit(w) for w in sorted(set(keyword.lower().split()))])
    return quizzes.withColumn("score", F.size(F.array_intersect(words, wanted))).where("score > 0")


def search_users(users: DataFrame, term: str, me: int, limit: int = 10) -> DataFrame:
    """Name or e-mail holds the term (two characters at least), without the asker."""
    if len(term.strip()) < 2:
        return users.limit(0)
    hit = icontains("full_name", term) | icontains("email", term)
    return users.where(hit & (F.col("user_id") != me)).orderBy("user_id").limit(limit)


def find_user(users: DataFrame, key: str) -> DataFrame:
    k = key.strip().lower()
    return users.where((F.lower("email") == k) | (F.lower("full_name") == k))


def hide_answers(questions: DataFrame) -> DataFrame:
    """Questions as learners see them, numbered within the lesson."""
    from pyspark.sql import Window as W

    index = (F.row_number().over(W.partitionBy("lesson_id").orderBy("question_id")) - 1).cast("int")
    return questions.select("lesson_id", index.alias("index"), "question", "options", "difficulty")


def authorised(users: DataFrame, roles: list[str]) -> DataFrame:
    """Users that hold one of the roles and are not banned; roles is an array column."""
    return users.where(has_any("roles", roles) & ~F.col("is_banned"))


def owned_by(df: DataFrame, owner: str, user: int) -> DataFrame:
    return df.where(F.col(owner) == user)
