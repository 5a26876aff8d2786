"""Text repairs and the cleaner, with DuckDB twins where SQL can follow; test marks stand beside whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import repair as R
from ..functions import text as X
from ..functions.cleaning import SPLIT_WORDS
from ..operators import cleaner as C
from ..operators.chunking import nfc
from .registry import query


def q(pattern: str) -> str:
    return pattern.replace("'", "''")


def trimmed(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


ENTITIES = "html"
for a, b in X.NAMED:
    ENTITIES = f"replace({ENTITIES}, '{q(a)}', '{q(b)}')"


def numbered(text: str, pattern: str, code: str) -> str:
    letter = f"CASE WHEN {code} < 32 AND {code} NOT IN (9, 10, 13) THEN '' WHEN {code} <= 1114111 AND {code} NOT BETWEEN 55296 AND 57343 THEN chr({code}) ELSE r END"
    return f"list_reduce(list_prepend({text}, list_distinct(regexp_extract_all({text}, '{pattern}'))), lambda t, r: replace(t, r, {letter}))"


T1 = f"SELECT page_id, {ENTITIES} AS x FROM (SELECT page_id, concat('&amp;#65; &#x42; &#7; &#9999999; ', html) AS html FROM pages)"
T1 = f"SELECT page_id, {numbered('x', '&#[0-9]{1,7};', 'CAST(regexp_extract(r, $$([0-9]+)$$, 1) AS INT)')} AS x FROM ({T1})"
T1 = f"SELECT page_id, {numbered('x', '&#x[0-9a-fA-F]{1,6};', 'CAST(concat($$0x$$, regexp_extract(r, $$x([0-9a-fA-F]+)$$, 1)) AS INT)')} AS x FROM ({T1})"
query("t1_decode_entities", f"SELECT page_id, md5(x) AS digest, CAST(length(x) AS INT) AS chars FROM ({T1})")(
    lambda t: t.pages.select("page_id", X.decode_entities(F.concat(F.lit("&amp;#65; &#x42; &#7; &#9999999; "), "html")).alias("m")).select("page_id", F.md5("m").alias("digest"), F.length("m").alias("chars"))
)
query("t2_fix_unicode_spacing", f"SELECT doc_id, md5(nfc_normalize(regexp_replace(regexp_replace(x, ' ({R.MARKS})', '\\1', 'g'), '({R.MARKS}) ', '\\1', 'g'))) AS digest FROM (SELECT doc_id, concat('cafe ', chr(769), ' u', chr(776), ' ', text, ' e ', chr(768)) AS x FROM documents)")(
    lambda t: t.documents.select("doc_id", F.md5(nfc(R.close_up_marks(F.concat(F.lit("cafe ́ ü "), "text", F.lit(" e ̀"))))).alias("digest"))
)
URLS = "x"
for p in R.BROKEN_URLS:
    URLS = f"regexp_replace({URLS}, '{q(p)}', '', 'g')"
query("t3_drop_broken_urls", f"SELECT doc_id, md5({URLS}) AS digest FROM (SELECT doc_id, concat(text, chr(10), 'see https://a.example/', source, ' now', chr(10), 'abc dir/file.ext', chr(10), text, chr(10), 'https://b.example/x') AS x FROM documents)")(
    lambda t: t.documents.select("doc_id", F.md5(R.drop_broken_urls(F.concat("text", F.lit("\nsee https://a.example/"), "source", F.lit(" now\nabc dir/file.ext\n"), "text", F.lit("\nhttps://b.example/x")))).alias("digest"))
)
BAD = "|".join(f"(?:{p})" for p in R.GARBAGE)
query(
    "t4_drop_garbage_lines",
    f"SELECT doc_id, md5(array_to_string(list_filter(string_split(x, chr(10)), lambda l: {trimmed('l')} = '' OR NOT regexp_matches({trimmed('l')}, '{q(BAD)}')), chr(10))) AS digest FROM (SELECT doc_id, concat(text, '\n(5)\n) 12\n3.\n1, 2 - 3\n(1)) 2/3\n--\n\n*a\n', text) AS x FROM documents)",
)(lambda t: t.documents.select("doc_id", F.md5(X.drop_garbage_lines(F.concat("text", F.lit("\n(5)\n) 12\n3.\n1, 2 - 3\n(1)) 2/3\n--\n\n*a\n"), "text"), R.GARBAGE)).alias("digest")))

#: Every word a line of its own: the shape of a table that fell apart.
CELLS = "SELECT doc_id, unnest(string_split(x, chr(10))) AS line, unnest(range(len(string_split(x, chr(10))))) AS i FROM (SELECT doc_id, concat('```', chr(10), 'a', chr(10), 'b', chr(10), '```', chr(10), replace(text, ' ', chr(10))) AS x FROM documents)"


def cells(t):
    return t.documents.select("doc_id", F.concat(F.lit("```\na\nb\n```\n"), F.replace("text", F.lit(" "), F.lit("\n"))).alias("text"))


BROKEN = f"NOT (t = '' OR regexp_matches(t, '{R.MARKUP}') OR regexp_matches(t, '[.:?!]$') OR length(t) > 60 OR regexp_matches(t, '{R.NUMBERED}') OR (length(t) > 40 AND len(regexp_extract_all(t, '{R.VI}')) > 3))"
query(
    "t6_flatten_broken_tables",
    f"""WITH l AS (SELECT doc_id, i, line, {trimmed('line')} AS t FROM ({CELLS})), c AS (SELECT *, sum(CASE WHEN starts_with(t, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) % 2 = 1 AS code FROM l),
e AS (SELECT *, NOT code AND {BROKEN} AS cell FROM c), g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, cell ORDER BY i) AS g FROM e),
n AS (SELECT *, cell AND count(*) OVER (PARTITION BY doc_id, cell, g) >= 4 AS flat FROM g)
SELECT doc_id, CAST(min(i) AS INT) AS i, string_agg(CASE WHEN flat THEN t ELSE line END, ' | ' ORDER BY i) AS line FROM (SELECT *, CASE WHEN flat THEN min(i) OVER (PARTITION BY doc_id, cell, g) ELSE i END AS place FROM n) GROUP BY doc_id, place""",
)(lambda t: C.flatten_broken_tables(C.lines_of(cells(t))).withColumn("i", F.col("i").cast("int")))
query("t7_unescape_markdown", r"SELECT doc_id, replace(replace(replace(replace(replace(replace(concat('\_a\*b\[c\]d\#e\|', text, '\_'), '\_', '_'), '\*', '*'), '\[', '['), '\]', ']'), '\#', '#'), '\|', '|') AS text FROM documents")(
    lambda t: t.documents.select("doc_id", X.unescape_markdown(F.concat(F.lit(r"\_a\*b\[c\]d\#e\|"), "text", F.lit(r"\_"))).alias("text"))
)
APART = "x"
for a, b in R.glued_pairs():
    APART = f"regexp_replace({APART}, '{a}', '{b}', 'gi')"
query("t8_split_known_glued", f"SELECT doc_id, md5({APART}) AS digest, {APART.replace('(x,', '(substring(x, 1, 40),')} AS head FROM (SELECT doc_id, concat('Thựchiện quátrình KHÁI NIỆM cơsởdữliệu ', text, ' VÍDỤ') AS x FROM documents)")(
    lambda t: t.documents.select("doc_id", F.concat(F.lit("Thựchiện quátrình KHÁI NIỆM cơsởdữliệu "), "text", F.lit(" VÍDỤ")).alias("x")).select("doc_id", F.md5(R.split_known_glued("x")).alias("digest"), R.split_known_glued(F.substring("x", 1, 40)).alias("head"))
)
WORDS = ", ".join(f"'{w.replace(' ', '')}'" for w in R.FREQUENT)
TOKEN = f"SELECT doc_id, concat(w[doc_id % len(w) + 1], upper(w[doc_id * 7 % len(w) + 1]), CASE WHEN doc_id % 3 = 0 THEN source ELSE '' END, w[doc_id * 11 % len(w) + 1]) AS x FROM (SELECT doc_id, source, [{WORDS}] AS w FROM documents)"
query(
    "t9_split_glued_vi",
    f"""WITH s AS (SELECT doc_id, x, regexp_extract_all(lower(x), '{R.segment_pattern()}') AS s FROM ({TOKEN})), k AS (SELECT *, list_filter(s, lambda y: length(y) >= 2) AS k FROM s)
SELECT doc_id, x AS token, CASE WHEN length(x) < 8 OR regexp_matches(x, '^[A-Z][A-Z0-9_]+$|^[0-9]|^https?://') OR len(k) < 2 OR length(array_to_string(k, '')) < 0.8 * length(x) THEN x
ELSE array_to_string(list_transform(range(1, len(s) + 1), lambda n: substring(x, CAST(1 + length(array_to_string(s[1:n - 1], '')) AS BIGINT), length(s[n]))), ' ') END AS words FROM k""",
)(
    lambda t: t.documents.withColumn("w", F.array(*[F.lit(w.replace(" ", "")) for w in R.FREQUENT]))
    .select(
        "doc_id",
        F.concat(
            F.get("w", (F.col("doc_id") % F.size("w")).cast("int")), F.upper(F.get("w", (F.col("doc_id") * 7 % F.size("w")).cast("int"))), F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(""), F.get("w", (F.col("doc_id") * 11 % F.size("w")).cast("int"))
        ).alias("token"),
    )
    .select("doc_id", "token", R.split_glued_vi("token").alias("words"))
)
SEGMENTS = f"regexp_extract_all(lower(tok), '{R.segment_pattern()}')"
LONGER = f"list_filter({SEGMENTS}, lambda y: length(y) >= 2)"
SEGMENTED = f"""CASE WHEN regexp_matches(tok, '^[A-Z][A-Z0-9_]+$|^[0-9]|^https?://') OR len({LONGER}) < 2 OR length(array_to_string({LONGER}, '')) < 0.8 * length(tok) THEN tok
ELSE array_to_string(list_transform(range(1, len({SEGMENTS}) + 1), lambda n: substring(tok, CAST(1 + length(array_to_string({SEGMENTS}[1:n - 1], '')) AS BIGINT), length({SEGMENTS}[n]))), ' ') END"""
CAMEL = "tok"
for a in (r"([a-z])([A-Z])", r"([A-Z]+)([A-Z][a-z])", r"([a-zA-Z])([0-9])", r"([0-9])([a-zA-Z])"):
    CAMEL = f"regexp_replace({CAMEL}, '{a}', '\\1 \\2', 'g')"
TOKENS = f"array_to_string(list_transform(regexp_split_to_array({APART.replace('(x,', '(line,')}, '\\s+'), lambda tok: CASE WHEN length(tok) < 8 THEN tok WHEN regexp_matches(tok, '{R.VI}') THEN {SEGMENTED} WHEN regexp_matches(tok, '^[A-Z0-9_]+$') AND length(tok) <= 10 THEN tok ELSE {CAMEL} END), ' ')"
FIXED = f"regexp_replace({TOKENS}, '([◦•])([A-ZÀ-Ỹa-zà-ỹ])', '\\1 \\2', 'g')"
for a, b in SPLIT_WORDS:
    FIXED = f"regexp_replace({FIXED}, '\\b{a}\\b', '{b}', 'gi')"
FIXED = f"regexp_replace(regexp_replace(regexp_replace({FIXED}, '\\s{{2,}}', ' ', 'g'), ' \\.', '.', 'g'), '\\s+$', '')"
GLUED_MARK = "Thựchiện StoredProcedure  err or .\n```\n| giátrị\n  đượcthựchiệntrong •Khaibáo XMLHttpRequest2go\n"
query(
    "t12_fix_glued_words",
    f"SELECT doc_id, md5(array_to_string(list_transform(string_split(x, chr(10)), lambda line: CASE WHEN regexp_matches({trimmed('line')}, '^(?:```|\\||//|/\\*|--)') THEN line ELSE {FIXED} END), chr(10))) AS digest FROM (SELECT doc_id, concat('{GLUED_MARK}', text) AS x FROM documents)",
)(lambda t: t.documents.select("doc_id", F.md5(R.fix_glued_words(F.concat(F.lit(GLUED_MARK), "text"))).alias("digest")))
WIDE = "SELECT doc_id, unnest(string_split(x, chr(10))) AS line, unnest(range(len(string_split(x, chr(10))))) AS i FROM (SELECT doc_id, replace(text, '. ', concat('.   ', chr(9))) AS x FROM marked_documents)"
query(
    "t13_tidy_lines",
    rf"""WITH l AS (SELECT doc_id, i, line, {trimmed('line')} AS t FROM ({WIDE})), c AS (SELECT *, sum(CASE WHEN starts_with(t, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) % 2 = 1 AS code FROM l)
SELECT doc_id, CAST(i AS INT) AS i, CASE WHEN code OR starts_with(t, '```') THEN line WHEN regexp_matches(line, '^\s*\|') THEN regexp_replace(line, '\s+$', '') WHEN regexp_matches(t, '^#{{1,6}}\s|{R.NUMBERED}') OR regexp_matches(line, '^\s*[-*+]\s|^\s*[0-9]+\.\s') THEN line
ELSE regexp_replace(replace(regexp_replace(line, '\s{{3,}}', '  ', 'g'), chr(9), '  '), '\s+$', '') END AS line FROM c""",
)(lambda t: C.tidy_lines(C.lines_of(t.marked_documents.select("doc_id", F.replace("text", F.lit(". "), F.lit(".   \t")).alias("text")))).withColumn("i", F.col("i").cast("int")))
query(
    "t14_defrag_lines",
    f"""WITH l AS (SELECT doc_id, i, line, {trimmed('line')} AS t FROM ({CELLS})), c AS (SELECT *, sum(CASE WHEN starts_with(t, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) % 2 = 1 AS code FROM l),
m AS (SELECT *, t <> '' AND NOT code AND length(t) <= 8 AND NOT regexp_matches(t, '{R.MARKUP}|{R.NUMBERED}') AS small FROM c),
p AS (SELECT *, i - coalesce(max(CASE WHEN t <> '' THEN i END) OVER w, -1) - 1 AS blanks, coalesce(last_value(CASE WHEN t <> '' THEN small END IGNORE NULLS) OVER w, false) AS after FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT *, CASE WHEN small AND NOT (after AND blanks < 2) THEN i END AS b FROM p WHERE NOT (t = '' AND after AND blanks = 0)),
g AS (SELECT *, CASE WHEN small THEN max(b) OVER (PARTITION BY doc_id ORDER BY i) ELSE i END AS place FROM k),
j AS (SELECT doc_id, place, CASE WHEN bool_or(small) THEN regexp_replace(string_agg(t, ' ' ORDER BY i), '\\s{{2,}}', ' ', 'g') ELSE any_value(CASE WHEN t = '' THEN '' ELSE line END) END AS line FROM g GROUP BY doc_id, place)
SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY place)) AS digest, CAST(length(string_agg(line, chr(10) ORDER BY place)) AS INT) AS chars FROM j GROUP BY doc_id""",
)(lambda t: C.text_of(t.documents, C.defrag_lines(C.lines_of(cells(t)))).select("doc_id", F.md5("text").alias("digest"), F.length("text").alias("chars")))
query("t15_clean_corpus")(lambda t: C.clean_corpus(t.marked_documents).select("doc_id", F.md5("text").alias("digest"), F.length("text").alias("chars")))
query("t16_light_clean")(
    lambda t: C.light_clean(t.marked_documents.withColumn("issues", F.when(F.regexp_count("text", F.lit(r"[^\s]{15,}")) / F.greatest(F.size(X.words("text")), F.lit(1)) > 0.08, F.array(F.lit("glued_words"))).otherwise(F.array().cast("array<string>")))).select(
        "doc_id", F.md5("text").alias("digest"), F.length("text").alias("chars")
    )
)
