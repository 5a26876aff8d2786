"""Lessons: invented code taken out, syllabus repaired, records normalised, context put together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import notes as N
from ..functions.text import bloom_level, normalize_space, normalize_title, normalize_vn
from . import documents as D
from . import retrieval as V
from .quiz import quiz_batch
from .windows import disambiguate_titles, filter_by_score, select_diverse

#: Words of query and programming languages that no document has to name.
KEYWORDS = (
    "SELECT", "INSERT", "UPDATE", "DELETE", "FROM", "WHERE", "JOIN", "INNER", "LEFT", "RIGHT", "ON", "SET", "VALUES", "BEGIN", "END", "TRAN", "TRANSACTION", "COMMIT", "ROLLBACK", "CREATE", "ALTER", "DROP",
    "PROC", "PROCEDURE", "FUNCTION", "TABLE", "IF", "ELSE", "DECLARE", "EXEC", "EXECUTE", "RETURN", "PRINT", "CONVERT", "CAST", "NULL", "NOT", "AND", "OR", "AS", "INTO", "WITH", "RECOMPILE", "ENCRYPTION",
    "OUTPUT", "OUT", "COUNT", "SUM", "MIN", "MAX", "AVG", "IDENTITY", "TRANCOUNT", "ROWCOUNT", "SAVE", "LIKE", "IN", "EXISTS", "DISTINCT", "TOP", "ORDER", "BY", "GROUP", "HAVING", "RAISERROR", "TRY", "CATCH",
    "THROW", "GO", "USE", "INT", "VARCHAR", "MONEY", "DATETIME", "SMALLDATETIME", "BIT", "FLOAT", "NVARCHAR", "DATE", "PRIMARY", "KEY", "RETURNS", "SCOPE_IDENTITY", "GETDATE", "OBJECT_ID", "INVOICES",
    "VENDORS", "INVOICELINEITEMS", "INVOICECOPY", "VENDORCOPY", "DEF", "CLASS", "IMPORT", "SELF", "NONE", "TRUE", "FALSE", "ELIF", "FOR", "WHILE", "LAMBDA", "YIELD", "RAISE", "EXCEPT", "FINALLY", "PASS",
    "BREAK", "CONTINUE", "GLOBAL", "NONLOCAL", "ASSERT", "SUPER", "INIT", "APPEND", "EXTEND", "ITEMS", "KEYS", "ENUMERATE", "ZIP", "MAP", "FILTER", "LEN", "RANGE", "LIBRARY", "REQUIRE", "NA", "NAN", "FRAME",
    "VECTOR", "PUBLIC", "PRIVATE", "PROTECTED", "STATIC", "VOID", "NEW", "THIS", "EXTENDS", "IMPLEMENTS", "INTERFACE", "ABSTRACT", "FINAL", "OVERRIDE", "THROWS", "STRING", "BOOLEAN", "DOUBLE", "ALGORITHM",
    "INPUT", "REPEAT", "UNTIL", "NODE", "GRAPH", "TREE", "QUEUE", "STACK", "HEAP", "SORT", "SEARCH", "THEN", "DO", "EACH", "LET", "VAR", "CONST", "STEP", "MOD", "DIV", "ARRAY",
)
#: Signs of a context about queries; what names a parameter, a procedure and a table; the note.
QUERY_CONTEXT = r"(?i)\b(?:CREATE\s+(?:PROC|PROCEDURE|FUNCTION|TABLE)|DECLARE\s+@|BEGIN\s+TRAN|RAISERROR|EXEC\s+\w)|(?<=[A-Za-z0-9_])@@[A-Z]+"
CODE_NAMES = ((r"@[A-Za-z][A-Za-z0-9_]*", 0), (r"\b(?:sp|usp|fn)[A-Z][A-Za-z0-9_]+", 0), (r"(?i)(?:from|join|into|update|table|procedure|proc|function)\s+([A-Za-z#][A-Za-z0-9_]*)", 1))
NOTE = ("> ⚠️ *Ví dụ code bị lược bỏ vì chứa tên không có trong tài liệu: `", "`*")


def code_guard(lessons: DataFrame, least: int = 3) -> DataFrame:
    """Code blocks of lessons (lesson_id, content, context) about queries that name three things or more which the
    context does not hold give way to a note."""
    context = F.lower(F.replace(F.replace(F.replace("context", F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&")))

    def invented(block: Column) -> Column:
        names = F.concat(*[F.regexp_extract_all(block, F.lit(N.ascii_bounds(p)), g) for p, g in CODE_NAMES])
        bare = lambda x: F.regexp_replace(x, "^@", "")
        strange = lambda x: ~F.upper(bare(x)).isin(*KEYWORDS) & (F.length(x) > 2) & ~F.contains(F.col("_c"), F.lower(bare(x))) & ~(x.startswith("@") & (F.length(x) <= 4))
        return F.filter(names, strange)

    def guarded(text: Column, block: Column) -> Column:
        return N.let(invented(block), lambda bad: F.when(F.size(bad) >= least, F.replace(text, block, F.concat(F.lit(NOTE[0]), F.array_join(bad, "`, `"), F.lit(NOTE[1])))).otherwise(text))

    blocks = F.regexp_extract_all("content", F.lit(r"```[\w]*\n[\s\S]*?```"), 0)
    rows = lessons.withColumn("_c", context)
    about = F.coalesce(F.col("context").rlike(N.ascii_bounds(QUERY_CONTEXT)), F.lit(False))
    return rows.withColumn("content", F.when(about, F.aggregate(blocks, F.col("content"), guarded)).otherwise(F.col("content"))).drop("_c")


#: An objective that says nothing, and what stands in for missing parts.
GENERIC_OBJECTIVE = "(?i)tong quan|gioi thieu|overview|introduction"


def repair_syllabus(items: DataFrame, docs: DataFrame, days: int) -> DataFrame:
    """A syllabus of exactly so many days for every document that has items (doc_id, day, title, objective, sections): empty,
    short, generic and repeated objectives are seeded from the text, repeated titles numbered, days without sections
    given theirs, headings that no day covers added from the last day backwards, missing days filled from the text."""
    outlines = D.outline(docs)
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("day"))
    rows = items.withColumn("day", place.cast("int")).withColumn("objective", normalize_space(F.coalesce("objective", F.lit(""))))

    # objectives depend on those of earlier days: a fold over a document's few days
    key = lambda x: F.lower(F.substring(x, 1, 60))
    state = lambda used, out: F.struct(used.alias("used"), out.alias("out"))

    def step(s: Column, x: Column) -> Column:
        generic = (F.length(x["objective"]) < 20) | x["objective"].rlike(GENERIC_OBJECTIVE) | F.array_contains(s["used"], key(x["objective"]))
        seed = F.coalesce(F.nullif(F.get("seeds", x["day"] - 1), F.lit("")), F.concat(F.lit("Nắm vững nội dung "), bloom_level(x["day"], F.lit(days)), F.lit(" ngày "), x["day"].cast("string"), F.lit(".")))
        return N.let(F.when(generic, seed).otherwise(x["objective"]), lambda o: state(F.array_append(s["used"], key(o)), F.array_append(s["out"], F.struct(x["day"].alias("day"), o.alias("objective")))))

    seeds = docs.select("doc_id", N.objective_seeds("text", days).alias("seeds"))
    none = state(F.array().cast("array<string>"), F.array().cast("array<struct<day:int,objective:string>>"))
    listed = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("day", "objective"))).alias("items"), F.count("*").cast("int").alias("n")).join(seeds, "doc_id")
    objectives = listed.select("doc_id", "n", F.explode(F.aggregate("items", none, step)["out"]).alias("o")).select("doc_id", "n", "o.*")

    titled = disambiguate_titles(rows.select(F.col("doc_id").alias("plan_id"), F.col("day").alias("day_number"), F.coalesce("title", F.lit("")).alias("title")), normalize_title("title"))
    dealt = D.distribute_sections(outlines, days).groupBy("doc_id", "day").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "section"))), lambda x: x["section"]).alias("dealt"))
    own = F.filter(F.coalesce("sections", F.array().cast("array<string>")), lambda x: F.length(x) > 3)
    full = rows.select("doc_id", "day", own.alias("own")).join(objectives, ["doc_id", "day"]).join(titled.select(F.col("plan_id").alias("doc_id"), F.col("day_number").alias("day"), "title"), ["doc_id", "day"])
    full = full.join(outlines, "doc_id").join(dealt, ["doc_id", "day"], "left")
    turn = F.when(F.size("outline") > 0, F.array(F.get("outline", (F.col("day") - 1) % F.size("outline")))).otherwise(F.array(F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("Nội dung ngày "), F.col("day").cast("string")))))
    full = full.withColumn("sections", F.when(F.size("own") > 0, F.col("own")).otherwise(F.coalesce("dealt", turn))).drop("own", "dealt", "outline")

    heading = lambda c: F.substring(normalize_vn(c), 1, 30)
    wanted = outlines.select("doc_id", F.posexplode("outline").alias("i", "section")).withColumn("k", heading("section")).where(F.length("k") > 4)
    covered = full.select("doc_id", F.explode("sections").alias("section")).select("doc_id", normalize_vn("section").alias("k"))
    left = wanted.join(covered, ["doc_id", "k"], "left_anti").join(listed.select("doc_id", "n"), "doc_id")
    late = left.withColumn("at", F.row_number().over(W.partitionBy("doc_id").orderBy("i")) - 1).select("doc_id", (F.col("n") - F.col("at") % F.col("n")).cast("int").alias("day"), "at", "section")
    late = late.groupBy("doc_id", "day").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "section"))), lambda x: x["section"]).alias("late"))
    full = full.join(late, ["doc_id", "day"], "left").withColumn("sections", F.concat("sections", F.array_except(F.coalesce("late", F.array().cast("array<string>")), "sections"))).where(F.col("day") <= days)

    spare = D.fallback_plan(docs, days).join(listed.select("doc_id", "n"), "doc_id").where("day > n")
    words = F.array_join(F.slice(F.split("objective", " "), 1, 6), " ")
    title = F.when(F.length(words) > 10, words).otherwise(F.concat(F.lit("Chủ đề "), F.col("day").cast("string")))
    spare = spare.select("doc_id", "day", title.alias("title"), "objective", F.array(F.substring("objective", 1, 60)).alias("sections"))
    out = full.select("doc_id", "day", "title", "objective", "sections").unionByName(spare)
    return out.withColumn("bloom", bloom_level("day", F.lit(days)))


def normalize_lessons(lessons: DataFrame, questions: DataFrame, most: int = 5) -> DataFrame:
    """Lessons (lesson_id, content, summary, objective, notes) in normal form: trimmed content, a summary in any case, clean
    notes with the formula-like lines of the content, and the ids of their best questions, so many at most."""
    batch = quiz_batch(questions).where(F.col("place") <= most)
    quiz = batch.groupBy("lesson_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "question_id"))), lambda x: x["question_id"]).alias("quiz"))
    content = N.trim_all(F.coalesce("content", F.lit("")))
    summary = F.coalesce(F.nullif(N.trim_all("summary"), F.lit("")), F.nullif("objective", F.lit("")), F.lit("Tóm tắt nội dung chính."))
    notes = N.clean_notes(F.concat(F.coalesce("notes", F.array().cast("array<string>")), N.formula_notes(F.coalesce("content", F.lit("")))))
    out = lessons.select("lesson_id", content.alias("content"), summary.alias("summary"), notes.alias("notes"))
    return out.join(quiz, "lesson_id", "left").withColumn("quiz", F.coalesce("quiz", F.array().cast("array<bigint>")))


def lesson_context(queries: DataFrame, chunks: DataFrame, limit: int = 9000) -> DataFrame:
    """The context of each query (query_id, plan_id, vector, sections): ten chunks by section, or by vector where no section
    answers; those of a fair score (two at least), six with different beginnings, in the document's order."""
    hits = V.search_by_section(queries, chunks, 10).select("query_id", "chunk_id", "chunk_index", "content", "score")
    fair = filter_by_score(hits, "query_id", 0.30, 2).drop("rank").withColumn("used", F.lit(False))
    best = select_diverse(fair, "query_id", 6)
    text = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"])
    return best.groupBy("query_id").agg(F.substring(F.array_join(text, "\n---\n"), 1, limit).alias("context"), F.count("*").alias("chunks"))
