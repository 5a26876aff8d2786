"""Notes, concepts, syllabus, context and file sinks, with DuckDB twins where SQL can follow."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import notes as N
from ..functions import repair as R
from ..operators import chunking as K
from ..operators import cleaner as C
from ..operators import lessons as L
from ..sources import files
from .cleaning import q, trimmed
from .registry import query
from .retrieval import queries
from .text import WS

FIRST_SEEN = "list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def re2(pattern: str) -> str:
    return q(pattern.replace("(?iu)", "(?i)").replace("(?imu)", "(?im)"))


def distinct(name: str, source: str) -> str:
    """Column name of source as its distinct values in order of their first places."""
    return f"SELECT * EXCLUDE ({name}), {FIRST_SEEN.format(x=name)} AS {name} FROM ({source})"


#: Marks beside the whole text, so that every rule has something to find.
SQL_MARK = "## 2.1 **Joins** here\nSELECT COUNT (*), Cast(x) FROM Orders INNER  JOIN Items; CREATE TABLE tblOne begin tran usp_x uspGetAll(1) @@ROWCOUNT const myVar = fetchAll(2) UserController\n### Summary\n"
HEADS = r"list_transform(list_filter(string_split(x, chr(10)), lambda y: regexp_matches(y, '^#{1,4}\s+.')), lambda y: trim(regexp_replace(regexp_replace(regexp_replace(y, '^#{1,4}\s+', ''), '\*\*|`', '', 'g'), '^[0-9]+(?:\.[0-9]+)*[\s.]\s*', '')))"
CONCEPTS = rf"""SELECT doc_id, list_concat(list_transform(regexp_extract_all(x, '(?i){q(N.CONCEPT)}'), lambda y: upper(trim(regexp_replace(regexp_replace(y, '\s*\($', ''), '\s+', ' ', 'g')))),
list_transform(list_filter({HEADS}, lambda y: len(regexp_split_to_array(y, '\s+')) <= 10 AND NOT regexp_matches(y, '{re2(N.GENERIC)}')), lambda y: upper(y))) AS c FROM (SELECT doc_id, concat(chr(10), '{SQL_MARK}', text) AS x FROM marked_documents)"""
query("n8_extract_concepts", f"SELECT doc_id, replace(array_to_string(c, '|'), 'ẞ', 'SS') AS concepts FROM ({distinct('c', CONCEPTS)})")(
    lambda t: t.marked_documents.select("doc_id", F.array_join(N.extract_concepts(F.concat(F.lit(SQL_MARK), "text"), F.lit("")), "|").alias("concepts"))
)
FACT_MARK = "1. a numbered line of facts\nThere are three types of joins in it\nA set is defined as a group of things\n- Bullets Are lines of some length\n"
FACT_LISTS = []
for pattern, longest, some in N.FACTS:
    hits = f"list_transform(regexp_extract_all(x, '{re2(pattern)}'), lambda y: {trimmed('y')})"
    hits = f"list_transform({hits}, lambda y: substring(y, 1, {longest}))" if longest else hits
    FACT_LISTS.append(f"({hits})[1:{some}]" if some else hits)
FACTS = f"SELECT doc_id, flatten([{', '.join(FACT_LISTS)}]) AS f FROM (SELECT doc_id, regexp_replace(replace(replace(replace(concat('{FACT_MARK}', text), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&#[0-9]+;', '', 'g') AS x FROM marked_documents)"
query("n10_key_facts", f"SELECT doc_id, md5(array_to_string((list_filter(f, lambda y: length(y) >= 15))[1:15], '|')) AS facts, CAST(len((list_filter(f, lambda y: length(y) >= 15))[1:15]) AS INT) AS n FROM ({distinct('f', FACTS)})")(
    lambda t: t.marked_documents.select("doc_id", N.key_facts(F.concat(F.lit(FACT_MARK), "text")).alias("f")).select("doc_id", F.md5(F.array_join("f", "|")).alias("facts"), F.size("f").alias("n"))
)
NOTE_MARK = "area = width * height of it\n[Context: x = y and more of it]\nus/library/a.asp = some long page\nthe rule of three words stays here\n◦ a bullet = cut in the middle\nhttps://a.example/?x=long_enough\n"
NO_F, NO_N = ("|".join(f"(?:{p})" for p in ps) for ps in (N.NO_FORMULA, N.NO_NOTE))
BULLET = lambda y: rf"(regexp_matches({y}, '^[◦•]\s+') AND NOT regexp_matches(trim(regexp_replace({y}, '^[◦•]\s+', '')), '[.!?;:…]$') AND length(trim(regexp_replace({y}, '^[◦•]\s+', ''))) < 80)"
FORMULAS = rf"""SELECT doc_id, list_transform(list_filter(list_transform(regexp_split_to_array(x, '\r?\n'), lambda y: {trimmed('y')}), lambda y: y <> '' AND NOT regexp_matches(y, '{re2(NO_F)}') AND length(y) >= 20 AND len(regexp_extract_all(y, '{N.LETTERS}')) >= 6 AND NOT {BULLET('y')}
AND ((regexp_matches(y, '[=+\-*/^√∑∏≤≥≈%]') AND regexp_matches(y, '{N.LETTERS}{{3,}}')) OR regexp_matches(y, '{re2(N.DEFINES)}')) AND length(y) <= 250), lambda y: CASE WHEN length(y) > 180 THEN concat(substring(y, 1, 180), '...') ELSE y END) AS f FROM (SELECT doc_id, concat('{NOTE_MARK}', text) AS x FROM marked_documents)"""
query("n11_formula_notes", f"SELECT doc_id, array_to_string(f[1:8], '|') AS notes FROM ({distinct('f', FORMULAS)})")(
    lambda t: t.marked_documents.select("doc_id", F.array_join(N.formula_notes(F.concat(F.lit(NOTE_MARK), "text")), "|").alias("notes"))
)
NOTES = rf"""SELECT doc_id, list_filter(list_transform(string_split(x, chr(10)), lambda y: trim(regexp_replace(y, '{WS}+', ' ', 'g'))), lambda y: y <> '' AND NOT regexp_matches(y, '{re2(NO_N)}') AND NOT (regexp_matches(y, '[+,]$') AND length(y) < 80) AND len(regexp_extract_all(y, '{N.LETTERS}')) >= 6
AND NOT (regexp_matches(y, '^=>\s*.') AND length(trim(regexp_replace(y, '^=>\s*', ''))) < 30) AND NOT {BULLET('y')} AND length(y) >= 10) AS f FROM (SELECT doc_id, concat('{NOTE_MARK}', '=> short arrow', chr(10), text) AS x FROM marked_documents)"""
query("n12_clean_notes", f"SELECT doc_id, array_to_string(f[1:12], '|') AS notes FROM ({distinct('f', NOTES)})")(
    lambda t: t.marked_documents.select("doc_id", F.array_join(N.clean_notes(F.split(F.concat(F.lit(NOTE_MARK + "=> short arrow\n"), "text"), "\n")), "|").alias("notes"))
)
NAMES = []
for pattern, group, least, stop in N.IDENTIFIERS:
    NAMES.append(f"list_filter(regexp_extract_all(x, '{q(pattern)}', {group}), lambda y: length(y) >= {least}" + (f" AND NOT regexp_matches(y, '{stop}'))" if stop else ")"))
IDS = f"SELECT doc_id, flatten([{', '.join(NAMES)}]) AS f FROM (SELECT doc_id, regexp_replace(replace(replace(replace(concat('{SQL_MARK}', text), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&#[0-9]+;', '', 'g') AS x FROM documents)"
query("n13_code_identifiers", f"SELECT doc_id, array_to_string(f[1:15], '|') AS names FROM ({distinct('f', IDS)})")(
    lambda t: t.documents.select("doc_id", F.array_join(N.code_identifiers(F.concat(F.lit(SQL_MARK), "text")), "|").alias("names"))
)
BLOCK = "\n```sql\nSELECT @total FROM Ghosts JOIN Shadows\nEXEC spHaunt @p1\n```\n"
NAMES_OF = ", ".join(f"regexp_extract_all(block, '{q(p)}', {g})" for p, g in L.CODE_NAMES)
BARE = "regexp_replace(y, '^@', '')"
KNOWN_WORDS = ", ".join(f"'{w}'" for w in L.KEYWORDS)
BAD = f"list_filter(flatten([{NAMES_OF}]), lambda y: upper({BARE}) NOT IN ({KNOWN_WORDS}) AND length(y) > 2 AND NOT contains(c, lower({BARE})) AND NOT (starts_with(y, '@') AND length(y) <= 4))"
query(
    "n14_code_guard",
    rf"""WITH l AS (SELECT lesson_id, concat(content, '{BLOCK}', title) AS x, concat(CASE WHEN lesson_id % 2 = 0 THEN 'CREATE TABLE x ' ELSE '' END, content) AS context FROM lessons),
k AS (SELECT *, lower(replace(replace(replace(context, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS c FROM l),
g AS (SELECT lesson_id, CASE WHEN regexp_matches(context, '{q(L.QUERY_CONTEXT.replace("(?<=[A-Za-z0-9_])", "[A-Za-z0-9_]"))}') THEN list_reduce(list_prepend(x, regexp_extract_all(x, '```[\w]*\n[\s\S]*?```')), lambda acc, block: CASE WHEN len({BAD}) >= 3 THEN replace(acc, block, concat('{L.NOTE[0]}', array_to_string({BAD}, '`, `'), '{L.NOTE[1]}')) ELSE acc END) ELSE x END AS x FROM k)
SELECT lesson_id, md5(x) AS digest, contains(x, 'spHaunt @p1') AS kept FROM g""",
)(
    lambda t: L.code_guard(t.lessons.select("lesson_id", F.concat("content", F.lit(BLOCK), "title").alias("content"), F.concat(F.when(F.col("lesson_id") % 2 == 0, "CREATE TABLE x ").otherwise(""), "content").alias("context"))).select(
        "lesson_id", F.md5("content").alias("digest"), F.contains("content", F.lit("spHaunt @p1")).alias("kept")
    )
)
SNIPPETS = ", ".join(f"list_transform(regexp_extract_all(x, '{re2(p)}'), lambda y: {trimmed('y')})" for p in N.SNIPPETS)
SMART = f"SELECT doc_id, x, flatten([{SNIPPETS}]) AS f FROM (SELECT doc_id, concat(text, chr(10), 'Ví dụ: $a+b$ và ```x``` ', substring(text, 1, 40)) AS x FROM documents)"
query(
    "n15_smart_context",
    f"SELECT doc_id AS lesson_id, md5(CASE WHEN length(x) <= 1400 THEN x ELSE substring(array_to_string(list_filter([substring(x, 1, 500), substring(array_to_string(f, chr(10)), 1, 600), right(x, 300)], lambda y: y <> ''), chr(10) || '---' || chr(10)), 1, 1400) END) AS digest FROM ({distinct('f', SMART)})",
)(lambda t: t.lessons.select("lesson_id", F.md5(N.smart_context(F.concat("content", F.lit("\nVí dụ: $a+b$ và ```x``` "), "title"))).alias("digest")))
SEEDS = rf"SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '[.!?]\s+', chr(1), 'g'), chr(1)), lambda y: trim(regexp_replace(y, '{WS}+', ' ', 'g'))), lambda y: length(y) > 20) AS s FROM documents"
query("n16_objective_seeds", f"SELECT doc_id, CAST(d + 1 AS INT) AS day, substring(coalesce(s[CAST(floor(d * len(s) / 5) AS INT) + 1], ''), 1, 150) AS seed FROM ({SEEDS}), (SELECT unnest(range(5)) AS d)")(
    lambda t: t.documents.select("doc_id", F.posexplode(N.objective_seeds("text", 5)).alias("d", "seed")).select("doc_id", (F.col("d") + 1).alias("day"), "seed")
)


def items(t):
    """Drafts of three to nine days, some of them empty, generic or repeated."""
    days = t.marked_documents.select("doc_id", "text", F.explode(F.sequence(F.lit(1), (3 + F.col("doc_id") % 7).cast("int"))).alias("day"))
    objective = F.when(F.col("day") % 3 == 0, "overview of it all and more").when(F.col("day") % 3 == 1, F.substring("text", 1, 50)).otherwise(F.substring(F.col("text"), F.col("day") * 30, F.lit(50)))
    sections = F.when(F.col("day") % 2 == 0, F.array(F.substring("text", 1, 30))).otherwise(F.array(F.lit("ab")))
    return days.select("doc_id", "day", F.concat(F.lit("Part "), F.when(F.col("day") % 4 == 0, "x").otherwise(F.substring("text", 1, 8))).alias("title"), objective.alias("objective"), sections.alias("sections"))


query("c4_repair_syllabus")(lambda t: L.repair_syllabus(items(t), t.marked_documents, 7).select("doc_id", "day", "title", "objective", "bloom", F.array_join("sections", "|").alias("sections")))
query(
    "c8_normalize_lessons",
    rf"""WITH n AS ({distinct('f', NOTES.replace('marked_documents', 'documents').replace(f"concat('{NOTE_MARK}', '=> short arrow', chr(10), text)", 'text'))}), g AS ({distinct('f', FORMULAS.replace('marked_documents', 'documents').replace(f"concat('{NOTE_MARK}', text)", 'text'))}),
m AS (SELECT n.doc_id, list_concat(n.f, list_filter(list_transform(g.f[1:8], lambda y: trim(regexp_replace(y, '{WS}+', ' ', 'g'))), lambda y: NOT regexp_matches(y, '{re2(NO_N)}') AND NOT (regexp_matches(y, '[+,]$') AND length(y) < 80) AND NOT {BULLET('y')})) AS f FROM n JOIN g ON g.doc_id = n.doc_id)
SELECT doc_id AS lesson_id, md5({trimmed('text')}) AS content, CASE WHEN doc_id % 3 = 0 THEN 'A summary' WHEN doc_id % 3 = 1 THEN 'An objective' ELSE 'Tóm tắt nội dung chính.' END AS summary, md5(array_to_string(f[1:12], '|')) AS notes FROM ({distinct('f', 'SELECT * FROM m')}) JOIN documents USING (doc_id)""",
)(
    lambda t: L.normalize_lessons(
        t.lessons.select(
            "lesson_id", "content", F.when(F.col("lesson_id") % 3 == 0, " A summary ").otherwise(" ").alias("summary"), F.when(F.col("lesson_id") % 3 == 1, "An objective").otherwise("").alias("objective"), F.split("content", "\n").alias("notes")
        ),
        t.questions,
    ).select("lesson_id", F.md5("content").alias("content"), "summary", F.md5(F.array_join("notes", "|")).alias("notes"))
)
query("v8_lesson_context")(lambda t: L.lesson_context(queries(t).withColumn("sections", F.array(F.lit("src1"))), t.chunks).select("query_id", "chunks", F.md5("context").alias("digest"), F.length("context").alias("chars")))
TAIL = rf"SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda y: trim(y)), lambda y: length(y) > 20) AS s FROM documents"
query("k9_overlap_tail", f"SELECT doc_id, array_to_string(s[greatest(len(s) - 1, 1):], ' ') AS tail FROM ({TAIL})")(lambda t: t.documents.select("doc_id", K.overlap_tail(F.col("text")).alias("tail")))
query("s6_postprocess_markdown")(lambda t: C.postprocess_markdown(t.documents.withColumn("text", F.concat(F.lit("a&#124;b &eacute; \\_x ELECT *\n7.\n"), "text"))).select("doc_id", F.md5("text").alias("digest"), F.length("text").alias("chars")))
WHOLE = "x"
for cut, whole in R.TRUNCATED:  # twice, as neighbours share the sign between them
    for _ in range(2):
        WHOLE = rf"regexp_replace({WHOLE}, '([*| \n\t]){cut}([ \t\n\r*|{{(\[]|\z)', '\1{whole}\2', 'g')"
CUT_WORDS = "**EGIN TRAN** ELECT x ROM t | HERE y ELECT ELECT\n"
query("s7_recover_keywords", f"SELECT doc_id, md5({WHOLE}) AS digest FROM (SELECT doc_id, concat('{CUT_WORDS}', text, ' ETURN') AS x FROM documents)")(lambda t: t.documents.select("doc_id", F.md5(R.recover_keywords(F.concat(F.lit(CUT_WORDS), "text", F.lit(" ETURN")))).alias("digest")))


def reports(t):
    """Reports of all courses written as text files, whose path is returned."""
    path = files.shared_path(t.spark, "reports")
    more = t.lessons.withColumns({"status": F.expr("CASE day_number WHEN 1 THEN 'completed' WHEN 2 THEN 'in-progress' ELSE 'locked' END"), "questions": F.expr("lesson_id % 4"), "summary": F.col("title"), "notes": F.array("title", F.lit("a  note"))})
    files.export_course_report(t.plans, more, path)
    return path


FLAT = lambda c: f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
query(
    "s16_export_course_report",
    f"""WITH d AS (SELECT plan_id, count(*) AS n, string_agg(concat('day ', day_number, ': ', CASE day_number WHEN 1 THEN '✅' WHEN 2 THEN '🔓' ELSE '🔒' END, ' ', {FLAT('title')}, '; quiz ', lesson_id % 4, '; summary: ', {FLAT('title')}, '; notes: ', {FLAT('title')}, ', a note; content: ', {FLAT('content')}), ' | ' ORDER BY day_number, lesson_id) AS days FROM lessons GROUP BY plan_id)
SELECT concat('plan ', p.plan_id, ' ', {FLAT('title')}, ', owner ', owner_id, ', lessons ', coalesce(n, 0), CASE WHEN n > 0 THEN concat(' | ', days) ELSE '' END) AS value FROM plans p LEFT JOIN d ON d.plan_id = p.plan_id WHERE NOT is_deleted""",
)(lambda t: t.spark.read.text(reports(t)))
query("s3_ingest_text_files")(lambda t: files.ingest_text_files(t.spark, reports(t)).select("length", F.md5("text").alias("digest")))


def stored(t, reset: bool = False):
    """The chunks of all plans, those of every second plan replaced by a second write."""
    path, chunks = files.shared_path(t.spark, "chunks"), t.chunks.select("plan_id", "chunk_id", "chunk_index", F.lit("first").alias("version"))
    files.write_chunks(chunks, path)
    files.write_chunks(chunks.where("plan_id % 2 = 0").withColumn("version", F.lit("second")), path)
    if reset:
        files.reset_table(t.spark, path, t.spark.read.parquet(path).schema)
    return t.spark.read.parquet(path)


query("s11_write_chunks", "SELECT plan_id, chunk_id, CASE WHEN plan_id % 2 = 0 THEN 'second' ELSE 'first' END AS version FROM chunks")(lambda t: stored(t).select(F.col("plan_id").cast("long").alias("plan_id"), "chunk_id", "version"))
query("s18_reset_table", "SELECT chunk_id, 'first' AS version FROM chunks WHERE false")(lambda t: stored(t, reset=True).select("chunk_id", "version"))
