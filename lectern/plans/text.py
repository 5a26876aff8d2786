"""Cleaning, metrics, chunking and keyword queries over documents and pages, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from .registry import query

MARK_SQL = f"regexp_replace(translate(lower({{}}), '{X.MARKED}', '{X.PLAIN}'), '[\\x{{{{300}}}}-\\x{{{{36f}}}}]', '', 'g')"


def marks(c: str) -> str:
    return MARK_SQL.format(c)


WS = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
TEXT = "text"

h = "html"
for k in range(1, 7):
    h = f"regexp_replace({h}, '(?is)<h{k}[^>]*>([\\s\\S]*?)</h{k}>', chr(10) || '{'#' * k} \\1' || chr(10), 'g')"
for a, b in (
    (r"(?is)<p[^>]*>([\s\S]*?)</p>", "'\\1' || chr(10) || chr(10)"), (r"(?i)<br[^>]*>", "chr(10)"), (r"(?is)<strong[^>]*>([\s\S]*?)</strong>", "'**\\1**'"), (r"(?is)<b>([\s\S]*?)</b>", "'**\\1**'"),
    (r"(?is)<em[^>]*>([\s\S]*?)</em>", "'*\\1*'"), (r"(?is)<i>([\s\S]*?)</i>", "'*\\1*'"), (r"(?i)<tr[^>]*>", "chr(10) || '|'"), (r"(?is)<t[dh][^>]*>([\s\S]*?)</t[dh]>", "' \\1 |'"),
    (r"(?is)<li[^>]*>([\s\S]*?)</li>", "'- \\1' || chr(10)"), (r"<[^>]+>", "''"),
):
    h = f"regexp_replace({h}, '{a}', {b}, 'g')"
query("s4_html_to_markdown", f"SELECT page_id, md5({h}) AS digest, length({h}) AS chars FROM pages")(
    lambda t: t.pages.select("page_id", X.html_to_markdown("html").alias("m")).select("page_id", F.md5("m").alias("digest"), F.length("m").cast("long").alias("chars"))
)
query(
    "s8_collapse_image_markers",
    r"SELECT doc_id, regexp_replace(regexp_replace(x, '(?:<!-- image -->\s*){3,}', '[images omitted]' || chr(10), 'g'), '(?:<!-- image -->\s*){1,2}', '[image]' || chr(10), 'g') AS text FROM (SELECT doc_id, concat(repeat('<!-- image --> ', CAST(doc_id % 6 AS INT)), text, repeat('<!-- image --> ', CAST(doc_id % 4 AS INT))) AS x FROM documents)",
)(
    lambda t: t.documents.select(
        "doc_id", X.collapse_image_markers(F.concat(F.expr("repeat('<!-- image --> ', CAST(doc_id % 6 AS INT))"), "text", F.expr("repeat('<!-- image --> ', CAST(doc_id % 4 AS INT))"))).alias("text")
    )
)
query(
    "s9_truncate_middle",
    "SELECT doc_id, md5(CASE WHEN length(text) > 500 THEN concat(substring(text, 1, 300), '[..]', right(text, 200)) ELSE text END) AS digest FROM documents",
)(lambda t: t.documents.select("doc_id", F.md5(X.truncate_middle("text", 500, "[..]")).alias("digest")))
query(
    "s10_dedup_documents",
    "SELECT source, md5(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY source, md5(text)",
)(lambda t: t.documents.groupBy("source", F.md5("text").alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")))
query("s12_gate_chunks", "SELECT chunk_id FROM chunks WHERE length(content) >= 20 AND len(embedding) >= 64")(lambda t: t.chunks.where((F.length("content") >= 20) & (F.size("embedding") >= 64)).select("chunk_id"))
query(
    "s17_upload_gate",
    r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) >= 30 AS enough, round(length(regexp_replace(text, '[a-zA-Z0-9À-ỹ\s]', '', 'g')) / length(text), 6) > 0.4 AS junk FROM documents",
)(
    lambda t: t.documents.select("doc_id", (F.size(X.words("text")) >= 30).alias("enough"), (F.round(F.length(F.regexp_replace("text", r"[a-zA-Z0-9À-ỹ\s]", "")) / F.length("text"), 6) > 0.4).alias("junk"))
)
T17 = f"SELECT doc_id, trim(regexp_replace(x, '{WS}+', ' ', 'g')) AS space, {marks('x')} AS bare FROM (SELECT doc_id, replace(text, chr(10), ' ') AS x FROM documents)"
query(
    "t17_normal_forms",
    rf"""SELECT doc_id, md5(space) AS space, md5(trim(regexp_replace(regexp_replace(bare, '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS plain,
md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(bare, 'day\s*[0-9]+', '', 'g'), '[0-9]+', '', 'g'), '[^a-zA-Z0-9\x{{00C0}}-\x{{024F}}\s]', '', 'g'), '\s+', ' ', 'g'))) AS title,
md5(regexp_replace(trim(regexp_replace(bare, '[^a-z0-9\s]', '', 'g')), '\s+', '_', 'g')) AS tag FROM ({T17})""",
)(
    lambda t: t.documents.select("doc_id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("text")).select(
        "doc_id", F.md5(X.normalize_space("text")).alias("space"), F.md5(X.normalize_text("text")).alias("plain"), F.md5(X.normalize_title("text")).alias("title"), F.md5(X.normalize_tag("text")).alias("tag")
    )
)
query(
    "t18_sanitize_section",
    r"""SELECT lesson_id, CASE WHEN regexp_matches(s, '(?i)\[OUTPUT|OUT\]') OR (length(s) < 10 AND regexp_matches(s, '^\[') AND regexp_matches(s, '\]')) OR (length(s) < 30 AND regexp_matches(s, '[{}()\[\]|]')) OR regexp_matches(s, '^[0-9\s,.;:]+$') THEN '' ELSE substring(s, 1, 120) END AS section FROM (SELECT lesson_id, trim(title) AS s FROM lessons)""",
)(lambda t: t.lessons.select("lesson_id", X.sanitize_section("title").alias("section")))
query("t20_embedding_input", rf"SELECT doc_id, substring(trim(regexp_replace(text, '{WS}+', ' ', 'g')), 1, 500) AS text FROM documents")(lambda t: t.documents.select("doc_id", X.embedding_input("text").alias("text")))

NW = r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))"
LINES = "list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')"
METRICS = rf"""SELECT doc_id, CAST({NW} AS INT) AS words, CAST(length(text) AS INT) AS chars, CAST(len({LINES}) AS INT) AS lines, CAST(len(list_filter({LINES}, lambda x: regexp_matches(x, '^(?:#{{1,3}} |[0-9]+\. |CHƯƠNG )'))) AS INT) AS sections,
round(len(regexp_extract_all(text, '[a-zA-ZÀ-ỹ0-9]')) / length(text), 6) AS meaningful_ratio, CAST(len(regexp_extract_all(text, '[.!?]\s')) AS INT) AS sentences FROM marked_documents"""


def metrics(t):
    return t.marked_documents.withColumns(X.doc_metrics("text")).drop("text")


query("h1_doc_metrics", METRICS)(metrics)
query(
    "h2_validate_documents",
    f"SELECT doc_id, CASE WHEN words < 150 THEN 'error' WHEN words < 400 OR meaningful_ratio < 0.4 OR sentences < 5 THEN 'warn' ELSE 'ok' END AS level, words >= 150 AS passed FROM ({METRICS})",
)(
    lambda t: metrics(t).select(
        "doc_id", F.when(F.col("words") < 150, "error").when((F.col("words") < 400) | (F.col("meaningful_ratio") < 0.4) | (F.col("sentences") < 5), "warn").otherwise("ok").alias("level"), (F.col("words") >= 150).alias("passed")
    )
)
query(
    "h3_extract_quality",
    rf"""SELECT doc_id, words > 200 AND headings < 2 AS no_headings, short_lines / greatest(lines, 1) > 0.6 AS fragmented_lines, glued / greatest(words, 1) > 0.08 AS glued_words FROM (SELECT doc_id, {NW} AS words, len({LINES}) AS lines,
len(list_filter({LINES}, lambda x: length(trim(x)) < 30)) AS short_lines, len(list_filter({LINES}, lambda x: regexp_matches(x, '^#{{1,6}} '))) AS headings, len(regexp_extract_all(text, '[^\s]{{15,}}')) AS glued FROM marked_documents)""",
)(
    lambda t: t.marked_documents.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))
    .withColumns({"w": F.size(X.words("text")), "n": F.greatest(F.size("lines"), F.lit(1))})
    .select(
        "doc_id", ((F.col("w") > 200) & (F.size(F.filter("lines", lambda x: x.rlike("^#{1,6} "))) < 2)).alias("no_headings"),
        (F.size(F.filter("lines", lambda x: F.length(F.trim(x)) < 30)) / F.col("n") > 0.6).alias("fragmented_lines"),
        (F.regexp_count("text", F.lit(r"[^\s]{15,}")) / F.greatest(F.col("w"), F.lit(1)) > 0.08).alias("glued_words"),
    )
)
query("h4_vi_ratio", r"SELECT doc_id, CASE WHEN n < 50 THEN 1.0::DOUBLE ELSE round(len(regexp_extract_all(text, '[À-ỹđĐ]')) / n, 6) END AS ratio FROM (SELECT doc_id, text, length(regexp_replace(text, '\s', '', 'g')) AS n FROM documents)")(
    lambda t: t.documents.select("doc_id", X.vi_ratio("text").alias("ratio"))
)
query(
    "h5_is_slide_dump",
    rf"SELECT doc_id, n >= 10 AND bars / n > 0.35 AND seps < 3 AS slides FROM (SELECT doc_id, len({LINES}) AS n, len(list_filter({LINES}, lambda x: contains(x, '|'))) AS bars, len(list_filter({LINES}, lambda x: regexp_matches(x, '^\s*\|[\s:|-]+\|\s*$'))) AS seps FROM documents)",
)(
    lambda t: t.documents.withColumn("l", F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).select(
        "doc_id", ((F.size("l") >= 10) & (F.size(F.filter("l", lambda x: F.contains(x, F.lit("|")))) / F.greatest(F.size("l"), F.lit(1)) > 0.35) & (F.size(F.filter("l", lambda x: x.rlike(r"^\s*\|[\s:|-]+\|\s*$"))) < 3)).alias("slides")
    )
)
query(
    "h9_difficulty",
    f"SELECT doc_id, CASE WHEN doc_id % 11 = 0 OR w > 4000 THEN 'Hard' WHEN w < 1200 THEN 'Easy' ELSE 'Medium' END AS difficulty FROM (SELECT doc_id, {NW} AS w FROM documents)",
)(lambda t: t.documents.select("doc_id", F.size(X.words("text")).alias("w")).select("doc_id", F.when((F.col("doc_id") % 11 == 0) | (F.col("w") > 4000), "Hard").when(F.col("w") < 1200, "Easy").otherwise("Medium").alias("difficulty")))

LV = r"""CASE WHEN regexp_matches(line, '^#{1,4}\s+\S') THEN length(regexp_extract(line, '^(#{1,4})\s', 1)) WHEN regexp_matches(tr, '^[0-9]+(?:\.[0-9]+)*\s+[A-ZÀ-Ỹa-zà-ỹ]') THEN least(len(regexp_extract_all(tr, '\.')) + 1, 4)
WHEN regexp_matches(tr, '^[A-Z]\.\s+[A-ZÀ-Ỹa-zà-ỹ]') THEN 2 WHEN regexp_matches(tr, '(?i)^(?:I{1,3}|IV|V?I{0,3}|IX|X{0,3})\.\s+[A-ZÀ-Ỹa-zà-ỹ]') AND length(tr) <= 100 AND n >= 3 THEN 1
WHEN regexp_matches(tr, '(?i)^(?:chương|chapter|phần|section|part|module|unit|bài|mục|topic|lesson)\s+(?:[0-9]+|[IVX]+)') THEN 1
WHEN n >= 2 AND length(tr) BETWEEN 4 AND 80 AND tr = upper(tr) AND regexp_matches(tr, '[A-ZÀ-Ỹ]') AND NOT regexp_matches(tr, '[{}()\[\];=]') THEN 2 ELSE 0 END"""
LINE_ROWS = r"SELECT doc_id, i, line, trim(line) AS tr, len(list_filter(regexp_split_to_array(trim(line), '\s+'), lambda x: x <> '')) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM marked_documents)"


def line_rows(t):
    return t.marked_documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))


query("k2_heading_level", f"SELECT doc_id, CAST(i AS INT) AS i, CAST({LV} AS INT) AS level FROM ({LINE_ROWS})")(lambda t: line_rows(t).select("doc_id", "i", X.heading_level("line").alias("level")))
query(
    "k3_line_kind",
    rf"SELECT doc_id, CAST(i AS INT) AS i, CASE WHEN tr = '' THEN 'blank' WHEN regexp_matches(line, '^\s*```') THEN 'fence' WHEN regexp_matches(line, '^\s*\|') THEN 'table' WHEN regexp_matches(tr, '^#{{1,6}}\s') THEN 'heading' WHEN regexp_matches(line, '^\s*[-*+]\s|^\s*[0-9]+\.\s') THEN 'list' ELSE 'text' END AS kind FROM ({LINE_ROWS})",
)(lambda t: line_rows(t).select("doc_id", "i", X.line_kind("line").alias("kind")))


def sections(t):
    """Sections of every document: a heading begins one; an empty leading one is dropped."""
    w = W.partitionBy("doc_id").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = line_rows(t).withColumn("head", (X.heading_level("line") > 0).cast("int"))
    rows = rows.withColumn("section", F.sum("head").over(w))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"])
    return rows.groupBy("doc_id", "section").agg(F.array_join(lines, "\n").alias("content")).where("section > 0 or trim(content) <> ''")


SECTIONS = f"SELECT doc_id, CAST(section AS BIGINT) AS section, string_agg(line, chr(10) ORDER BY i) AS content FROM (SELECT doc_id, i, line, sum(CASE WHEN {LV} > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM ({LINE_ROWS})) GROUP BY doc_id, section"
query("k4_split_sections", f"SELECT doc_id, section, md5(content) AS digest FROM ({SECTIONS}) WHERE section > 0 OR trim(content) <> ''")(lambda t: sections(t).select("doc_id", "section", F.md5("content").alias("digest")))
query(
    "k8_chunk_flags",
    r"SELECT page_id, CASE WHEN code THEN 'code' WHEN tab THEN 'table' WHEN formula THEN 'formula' ELSE 'text' END AS kind FROM (SELECT page_id, regexp_matches(html, '```|<code') AS code, regexp_matches(html, '(?m)^\s*\||<table') AS tab, regexp_matches(html, '[=≤≥≈∑∏√∫]\s*[0-9a-z]') AS formula FROM pages)",
)(
    lambda t: t.pages.select(
        "page_id", F.when(F.col("html").rlike("```|<code"), "code").when(F.col("html").rlike(r"(?m)^\s*\||<table"), "table").when(F.col("html").rlike(r"[=≤≥≈∑∏√∫]\s*[0-9a-z]"), "formula").otherwise("text").alias("kind")
    )
)
query(
    "k13_normalize_external_chunks",
    rf"SELECT chunk_id, trim(regexp_replace(concat('## ', section), '^#+\s*', '')) AS section, lower(coalesce(nullif(trim(section), ''), 'general')) AS topic FROM (SELECT chunk_id, section, {NW.replace('text', 'content')} AS w FROM chunks) WHERE w >= 30",
)(
    lambda t: t.chunks.where(F.size(X.words("content")) >= 30).select(
        "chunk_id", F.trim(F.regexp_replace(F.concat(F.lit("## "), "section"), r"^#+\s*", "")).alias("section"), F.lower(F.coalesce(F.nullif(F.trim("section"), F.lit("")), F.lit("general"))).alias("topic")
    )
)
query("k14_dedup_chunks", "SELECT substring(sha256(concat(section, '::', content)), 1, 16) AS k, min(chunk_id) AS chunk_id FROM chunks GROUP BY 1")(
    lambda t: t.chunks.groupBy(F.substring(F.sha2(F.concat("section", F.lit("::"), "content"), 256), 1, 16).alias("k")).agg(F.min("chunk_id").alias("chunk_id"))
)
query(
    "k15_heading_density",
    f"SELECT doc_id, n >= 5 AND d < 0.2 AS external, CAST(n AS BIGINT) AS chunks FROM (SELECT doc_id, count(*) AS n, avg(CASE WHEN length(content) > 200 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS d FROM ({SECTIONS}) WHERE section > 0 OR trim(content) <> '' GROUP BY doc_id)",
)(
    lambda t: sections(t).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.avg((F.length("content") > 200).cast("double")).alias("d")).select("doc_id", ((F.col("chunks") >= 5) & (F.col("d") < 0.2)).alias("external"), "chunks")
)
RS = ", ".join(f"'{w}'" for w in X.REUSE_STOP)
query(
    "n3_reuse_keywords",
    rf"SELECT lesson_id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(translate({marks('title')}, 'đ', 'd'), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda x: length(x) >= 3 AND x NOT IN ({RS})), ' ') AS k FROM lessons",
)(lambda t: t.lessons.select("lesson_id", F.array_join(X.reuse_keywords("title"), " ").alias("k")))
RR = ", ".join(f"'{w}'" for w in X.RERANK_STOP)
query(
    "n4_rerank_keywords",
    rf"SELECT item_id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^A-Za-z0-9_\s\x{{00C0}}-\x{{024F}}]', ' ', 'g'), '\s+'), lambda x: length(x) >= 4 AND x NOT IN ({RR})), ' ') AS k FROM benchmark",
)(lambda t: t.benchmark.select("item_id", F.array_join(X.rerank_keywords("text"), " ").alias("k")))
query(
    "u3_jaccard",
    rf"""WITH k AS (SELECT lesson_id, plan_id, list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace({marks("content")}, '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda x: length(x) > 3)) AS w FROM lessons)
SELECT a.lesson_id AS a, b.lesson_id AS b, round(CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) END, 6) AS j FROM k a JOIN k b ON a.plan_id = b.plan_id AND a.lesson_id = b.lesson_id - 1""",
)(
    lambda t: (lambda k: k.alias("x").join(k.alias("y"), (F.col("x.plan_id") == F.col("y.plan_id")) & (F.col("x.lesson_id") == F.col("y.lesson_id") - 1)).select(
        F.col("x.lesson_id").alias("a"), F.col("y.lesson_id").alias("b"), F.round(X.jaccard(F.col("x.w"), F.col("y.w")), 6).alias("j")
    ))(t.lessons.select("lesson_id", "plan_id", F.array_distinct(X.dup_tokens("content")).alias("w")))
)
query("c1_bloom_level", "SELECT lesson_id, (['remember', 'understand', 'apply', 'analyze', 'evaluate', 'create'])[CAST(least(5, floor((day_number - 1) / greatest(1, 6) * 6)) AS INT) + 1] AS bloom FROM lessons")(
    lambda t: t.lessons.select("lesson_id", X.bloom_level("day_number", F.lit(7)).alias("bloom"))
)
query("c6_course_days", "SELECT page_id, least(14, greatest(1, coalesce(TRY_CAST(nullif(regexp_extract(url, '([0-9]{1,6})', 1), '') AS INT), 7))) AS days FROM pages")(lambda t: t.pages.select("page_id", X.course_days("url").alias("days")))
