"""Quiz questions: cleanup, validation, scoring, normal form, parsing and grading."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normalize_space

#: Patterns of meta options, boilerplate, verdict prefixes and placeholders.
META = "(?i)khong xuat hien trong tai lieu|suy doan ngoai ngu canh|Ket luan trai voi y chinh trong bai hoc"
BOILERPLATE = (
    "(?i)bo qua dieu kien|gioi han da neu|khong khop phan da hoc|khong can xem xet cac gia dinh|hoan toan thay the cho nhau|loai tru hoan toan moi phu thuoc"
    "|hoan doi vai tro trong cung mot co che|bo qua cac rang buoc hoac dieu kien bien|doc lap tuyet doi voi moi phan truoc"
)
PLACEHOLDER = r"(?i)(?:^|\s)---(?:\s|$)|^\s*\.\.\.\s*$|___+|placeholder"
VERDICT = r"(?i)^(?:dung|sai)(?:[^A-Za-z0-9_]|$)"
#: Phrases that no option may hold.
BANNED = (
    "tất cả đều đúng", "tất cả các đáp án trên", "tất cả đều sai", "không có đáp án nào đúng", "không thể xác định", "không biết",
    "cả a và b", "cả b và c", "cả 3 đáp án", "không liên quan", "không xuất hiện trong tài liệu", "tùy thuộc vào ngữ cảnh",
)
ITEM = "array<struct<question:string,options:array<string>,correctAnswer:int,explanation:string>>"


def clean_questions(df: DataFrame) -> DataFrame:
    """Without "câu N:" before the stem and "A." before options; a stem that ends openly gets a question mark."""
    stem = F.regexp_replace(F.trim("question"), r"(?iu)^câu\s*[0-9]+\s*[.:\-\s]\s*", "")
    asked = F.when((stem != "") & ~stem.rlike("[?:.]$"), F.concat(stem, F.lit("?"))).otherwise(stem)
    return df.withColumns({"question": asked, "options": F.transform("options", lambda o: F.regexp_replace(F.trim(o), r"^[A-Da-d1-4]\s*[.)\-:\s]\s*", ""))})


def strict(df: DataFrame) -> Column:
    """Four distinct options of three characters, an answer among them, a real stem and explanation, no verdicts, no banned phrases."""
    o = F.transform("options", lambda x: F.lower(F.trim(x)))
    q = F.lower(F.trim("question"))
    leak = lambda x: x.rlike(r"^(?:đúng|sai|correct|incorrect|true|false)(?:[^A-Za-z0-9_]|$)") & ~x.rlike(r"^sai (?:số|lệch|sót|phân)")
    banned = lambda x: reduce(lambda a, b: a | b, [F.contains(x, F.lit(t)) for t in BANNED])
    return (
        (F.size("options") == 4) & F.col("correct_answer").between(0, 3) & (F.length(q) >= 10) & ~q.rlike(r"placeholder|---|___+|\.\.\.")
        & F.forall(o, lambda x: F.length(x) >= 3) & (F.size(F.array_distinct(o)) == 4) & (F.length(F.trim("explanation")) >= 10) & ~F.exists(o, leak) & ~F.exists(o, banned)
    )


def valid_questions(df: DataFrame, target: int) -> DataFrame:
    """Strictly valid questions of each lesson; where they are fewer than 60 % of the target, the loosely valid ones."""
    loose = (F.length("question") > 0) & (F.size("options") == 4) & F.col("correct_answer").between(0, 3)
    rows = df.withColumns({"strict": strict(df), "loose": loose})
    n = F.sum(F.col("strict").cast("int")).over(W.partitionBy("lesson_id"))
    return rows.withColumn("n", n).where(F.when(F.col("n") >= -(-target * 6 // 10), F.col("strict")).otherwise(F.col("loose"))).drop("strict", "loose", "n")


def quality(df: DataFrame) -> Column:
    """100 less the penalties; 0 for what is no question of four options."""
    o = F.transform("options", normalize_space)
    q = normalize_space("question")
    n = F.transform("options", lambda x: F.length(x).cast("double"))
    avg = F.aggregate(n, F.lit(0.0), lambda s, x: s + x) / 4
    dev = F.aggregate(n, F.lit(0.0), lambda s, x: s + F.abs(x - avg)) / 4
    correct = normalize_space(F.coalesce(F.get("options", F.col("correct_answer")), F.lit("")))
    cost = lambda test, k: F.when(test, k).otherwise(0)
    total = (
        cost(F.size(F.filter(o, lambda x: x.rlike(META))) >= 2, 40) + cost(F.exists(o, lambda x: x.rlike(BOILERPLATE)), 30) + cost(F.exists(o, lambda x: x.rlike(VERDICT)), 35)
        + cost(F.length(F.coalesce("explanation", F.lit(""))) < 20, 20) + cost((correct != "") & F.contains(q, F.substring(correct, 1, 40)), 25)
        + cost(F.size(F.array_distinct(F.transform(o, lambda x: F.substring(x, 1, 60)))) < 4, 30) + cost(avg < 20, 15) + cost(dev < 8, 10)
    )
    return F.when((F.size("options") != 4) | q.rlike(PLACEHOLDER) | (q == ""), 0).otherwise(F.greatest(F.lit(0), 100 - total)).cast("int")


def score_questions(df: DataFrame) -> DataFrame:
    return df.withColumn("score", quality(df))


def normalize_questions(df: DataFrame) -> DataFrame:
    """Options without verdicts; only questions of four distinct options of eight characters; a bad answer becomes 0."""
    verdict = r"(?i)^(?:sai\s*:\s*|correct\s*:\s*|wrong\s*:\s*|dap\s*an\s*dung\s*:\s*|phuong\s*an\s*dung\s*:\s*|(?:sai|dung)\s*(?:vi|do|boi)\s*|phuong\s*an\s*(?:sai|dung)\s*)"

    def strip(x: Column) -> Column:
        x = normalize_space(F.regexp_replace(x, r"^\*+|\*+$", ""))
        for _ in range(4):
            x = normalize_space(F.regexp_replace(x, verdict, ""))
        return x

    out = df.withColumn("question", normalize_space("question")).withColumn("options", F.slice(F.filter(F.transform("options", strip), lambda x: x != ""), 1, 4))
    keys = F.transform("options", lambda x: F.substring(F.lower(x), 1, 120))
    good = (F.size("options") == 4) & F.forall("options", lambda x: (F.length(x) >= 8) & ~x.rlike(PLACEHOLDER)) & (F.size(F.array_distinct(keys)) == 4) & ~F.col("question").rlike(PLACEHOLDER)
    answer = F.when(F.col("correct_answer").between(0, 3), F.col("correct_answer")).otherwise(0)
    return out.where(good).withColumn("correct_answer", answer.cast("int"))


def quiz_batch(df: DataFrame, threshold: int = 50, most: int = 10) -> DataFrame:
    """The best questions of each lesson: normal form, distinct stems, scores of the threshold or more, so many at most."""
    rows = score_questions(normalize_questions(df))
    first = F.row_number().over(W.partitionBy("lesson_id", F.substring(F.lower("question"), 1, 120)).orderBy("question_id"))
    kept = rows.withColumn("n", first).where((F.col("n") == 1) & (F.col("score") >= threshold))
    place = F.row_number().over(W.partitionBy("lesson_id").orderBy(F.desc("score"), "question_id"))
    return kept.select("lesson_id", "question_id", "score", place.alias("place")).where(F.col("place") <= most)


def parse_quiz_json(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Questions from a model's answer: fences and what stands around the outermost braces go, trailing commas are
    repaired; rows that still cannot be read come back with corrupt set and no question."""
    body = F.regexp_replace(F.regexp_replace(F.col(column), "```(?:json)?", ""), r"(?s)^[^\[{]*|[^\]}]*$", "")
    fixed = F.regexp_replace(body, r",\s*([\]}])", "$1")
    wrapped = F.when(fixed.startswith("["), F.concat(F.lit('{"quiz":'), fixed, F.lit("}"))).otherwise(fixed)
    rows = raw.withColumn("items", F.from_json(wrapped, f"struct<quiz:{ITEM}>")["quiz"])
    return rows.withColumn("item", F.explode_outer("items")).withColumn("corrupt", F.col("item").isNull()).drop("items")


def grade(answers: DataFrame, key: DataFrame) -> DataFrame:
    """Score of every attempt: answers (attempt_id, quiz_id, answers) by position against key (quiz_id, position,
    correct); a missing answer is wrong."""
    total = key.groupBy("quiz_id").agg(F.count("*").alias("total"))
    given = answers.select("attempt_id", "quiz_id", F.posexplode_outer("answers").alias("position", "answer"))
    right = given.join(key, ["quiz_id", "position"]).groupBy("attempt_id").agg(F.count_if(F.col("answer") == F.col("correct")).alias("right"))
    out = answers.select("attempt_id", "quiz_id").join(total, "quiz_id").join(right, "attempt_id", "left")
    score = F.coalesce("right", F.lit(0))
    return out.select("attempt_id", score.alias("score"), "total", F.floor(100.0 * score / F.col("total") + 0.5).cast("int").alias("percent"))


def grade_multi(given: str | Column, correct: str | Column) -> Column:
    """Multiple choice: the same answers as a set, in any order."""
    return F.array_sort(F.array_distinct(given)) == F.array_sort(F.array_distinct(correct))


def grade_adaptive(answers: DataFrame, key: DataFrame) -> DataFrame:
    """As grade(), over answered questions only: -1 is skipped; a question that does not exist is wrong."""
    given = answers.select("attempt_id", "quiz_id", F.posexplode("answers").alias("position", "answer")).where("answer >= 0")
    g = given.join(key, ["quiz_id", "position"], "left").groupBy("attempt_id").agg(F.count("*").alias("answered"), F.count_if(F.col("answer") == F.col("correct")).alias("right"))
    return g.withColumn("percent", F.floor(100.0 * F.col("right") / F.col("answered") + 0.5).cast("int"))


def assignment_status(df: DataFrame) -> DataFrame:
    status = F.when(F.col("score").isNotNull(), "graded").when(F.col("ai_score").isNotNull(), "ai_graded").otherwise("pending")
    return df.withColumn("status", status).withColumn("final_score", F.coalesce("score", "ai_score"))


#: Least and most questions of a lesson by focus and depth.
BOUNDS = [("practice", "deep", 7, 10, 12), ("practice", "basic", 5, 8, 10), ("theory", "deep", 4, 6, 8), ("theory", "basic", 3, 5, 8)]


def quiz_bounds(df: DataFrame) -> DataFrame:
    """Bounds by learning goals; an unknown focus is theory, an unknown depth basic."""
    focus = F.when(F.col("focus").isin("practice", "theory"), F.col("focus")).otherwise("theory")
    depth = F.when(F.col("depth").isin("basic", "deep"), F.col("depth")).otherwise("basic")
    table = df.sparkSession.createDataFrame(BOUNDS, "focus string, depth string, least int, most int, pool int")  # four rows
    return df.withColumns({"focus": focus, "depth": depth}).join(F.broadcast(table), ["focus", "depth"])


def learning_mode(progress: DataFrame) -> DataFrame:
    """From the latest score of a topic: ADVANCED, REMEDIAL or NORMAL."""
    return progress.withColumn("mode", F.when(F.col("score") >= 80, "ADVANCED").when(F.col("score") < 50, "REMEDIAL").otherwise("NORMAL"))
