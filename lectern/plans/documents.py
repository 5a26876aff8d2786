"""Structure, outline, coverage and duplication queries, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cleaning as R
from ..functions import text as X
from ..operators import chunking as C
from ..operators import documents as D
from .registry import query
from .text import LINES, LV, NW, line_rows, marks

ALL = "string_split(text, chr(10))"
STRUCT = rf"""SELECT doc_id, words, headings, formulas, bullets, CAST(CASE WHEN tr > 3 THEN ceil(tr / 4) ELSE 0 END AS INT) AS tables, CAST(floor(code) AS INT) AS code_blocks,
CASE WHEN words > 8000 OR headings > 20 OR (formulas AND code > 3) THEN 'high' WHEN words > 3000 OR headings > 10 OR code > 5 THEN 'medium' ELSE 'low' END AS complexity FROM (SELECT doc_id, CAST({NW} AS INT) AS words,
CAST(len(list_filter({ALL}, lambda x: regexp_matches(trim(x), '^#{{1,4}}\s+\S|^[0-9]+(?:\.[0-9]+)+\s+[A-ZÀ-Ỹa-zà-ỹ]'))) AS INT) AS headings, len(list_filter({ALL}, lambda x: regexp_matches(trim(x), '^\|.+\|'))) AS tr,
regexp_matches(text, '[∑∏∫√≤≥≈±×÷→←⇒⇔∈∉∩∪∀∃]') OR regexp_matches(text, '\$[^$]{{3,}}\$') AS formulas, len(regexp_extract_all(text, '```')) / 2 AS code, CAST(len(list_filter({ALL}, lambda x: regexp_matches(x, '^\s*[-*+•◦]\s'))) AS INT) AS bullets FROM marked_documents)"""
query("h6_doc_structure", STRUCT)(lambda t: D.doc_structure(t.marked_documents).drop("text"))
query(
    "h7_doc_metadata",
    f"SELECT doc_id, CAST({NW} AS INT) AS word_count, CAST(len({LINES}) AS INT) AS line_count, CASE WHEN len(regexp_extract_all(text, '\\|')) > 10 THEN 1 ELSE 0 END AS table_count FROM documents",
)(
    lambda t: t.documents.select(
        "doc_id", F.size(X.words("text")).alias("word_count"), F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).alias("line_count"), F.when(F.regexp_count("text", F.lit(r"\|")) > 10, 1).otherwise(0).alias("table_count")
    )
)
query(
    "h8_detect_corruption",
    rf"SELECT doc_id, (CASE WHEN e > 5 THEN 2 ELSE 0 END) + (CASE WHEN o > 50 THEN 1 ELSE 0 END) + (CASE WHEN s > 20 THEN 1 ELSE 0 END) >= 2 AS corrupt FROM (SELECT doc_id, len(list_filter({ALL}, lambda x: regexp_matches(x, '^\|\s*\|$'))) AS e, len(regexp_extract_all(text, '[^\x00-\x7F\x{{00C0}}-\x{{024F}}\x{{1E00}}-\x{{1EFF}}\s]')) AS o, len(list_filter({ALL}, lambda x: length(trim(x)) BETWEEN 1 AND 2)) AS s FROM documents)",
)(lambda t: t.documents.select("doc_id", D.detect_corruption("text").alias("corrupt")))
TOK = lambda c: f"list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace({marks(c)}, '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda x: length(x) > 3))"
ECHO = "(SELECT plan_id, day_number, title, CASE WHEN day_number % 3 = 0 THEN concat(first, ' ', first) ELSE content END AS content FROM (SELECT *, first_value(title) OVER (PARTITION BY plan_id ORDER BY day_number, lesson_id) AS first FROM lessons))"


def echoing(t):
    """Lessons of which every third day repeats the title of its plan's first lesson, so that the default thresholds are passed."""
    first = F.first("title").over(W.partitionBy("plan_id").orderBy("day_number", "lesson_id"))
    return t.lessons.withColumn("first", first).withColumn("content", F.when(F.col("day_number") % 3 == 0, F.concat("first", F.lit(" "), "first")).otherwise(F.col("content"))).drop("first")


H10 = lambda lessons, least: f"""WITH k AS (SELECT plan_id, day_number, {TOK('substring(content, 1, 1000)')} AS a, {TOK('title')} AS b FROM {lessons}), p AS (SELECT n.plan_id, n.day_number AS day, o.day_number AS earlier, len(list_intersect(n.a, o.b)) AS s, len(n.a) AS na, len(o.b) AS nb FROM k n JOIN k o ON o.plan_id = n.plan_id AND o.day_number < n.day_number)
SELECT plan_id, day, earlier, round(r, 6) AS ratio, CASE WHEN r > 0.65 THEN 'high' WHEN r > 0.5 THEN 'medium' ELSE 'low' END AS severity FROM (SELECT *, s / (na + nb - s) AS r FROM p WHERE s > 0) WHERE r > {least}"""  # noqa: E731
query("h10_content_duplication", H10("lessons", 0.05))(lambda t: D.content_duplication(t.lessons, 0.05))
query("h10_content_duplication_default", H10(ECHO, 0.35))(lambda t: D.content_duplication(echoing(t)))
PLAIN = lambda c: f"trim(regexp_replace(regexp_replace({marks(c)}, '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
H11 = lambda lessons, least: f"""WITH tw AS (SELECT plan_id, day_number AS earlier, unnest(list_filter(string_split({PLAIN('title')}, ' '), lambda x: length(x) > 4)) AS w FROM {lessons}), cw AS (SELECT plan_id, day, w, count(*) AS n FROM (SELECT plan_id, day_number AS day, unnest(string_split({PLAIN('content')}, ' ')) AS w FROM {lessons}) GROUP BY plan_id, day, w)
SELECT c.plan_id, day, earlier, count(*) AS hits FROM cw c JOIN tw ON tw.plan_id = c.plan_id AND tw.w = c.w WHERE n >= 2 AND earlier < day GROUP BY c.plan_id, day, earlier HAVING count(*) >= {least}"""  # noqa: E731
query("h11_scope_compliance", H11("lessons", 1))(lambda t: D.scope_compliance(t.lessons, least=1))
query("h11_scope_compliance_default", H11(ECHO, 3))(lambda t: D.scope_compliance(echoing(t)))
query("n5_dup_tokens", f"SELECT lesson_id, array_to_string(list_sort({TOK('title')}), ' ') AS tokens FROM lessons")(lambda t: t.lessons.select("lesson_id", F.array_join(F.array_sort(F.array_distinct(X.dup_tokens("title"))), " ").alias("tokens")))
N7 = ", ".join(f"{{'n': len(regexp_extract_all(x, '\\b(?:{p})\\b')), 'k': {-k}, 'd': '{d}'}}" for k, (d, p) in enumerate(D.DOMAINS))
query("n7_detect_domain", f"SELECT lesson_id, CASE WHEN m.n > 0 THEN m.d ELSE 'general' END AS domain FROM (SELECT lesson_id, list_max([{N7}]) AS m FROM (SELECT lesson_id, lower(concat(l.title, ' ', substring(content, 1, 800), ' ', coalesce(p.title, ''))) AS x FROM lessons l LEFT JOIN plans p ON p.plan_id = l.plan_id))")(
    lambda t: D.detect_domain(t.lessons, t.plans).select("lesson_id", "domain")
)
OUTLINE = r"""SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda y: CASE WHEN regexp_matches(trim(y), '^#{1,3}\s+(.+)') THEN substring(regexp_replace(regexp_extract(trim(y), '^#{1,3}\s+(.+)', 1), '[*_`]', '', 'g'), 1, 100)
WHEN regexp_matches(trim(y), '^([0-9]+(?:\.[0-9]+)*)\s+(.{3,80})') THEN substring(concat(regexp_extract(trim(y), '^([0-9]+(?:\.[0-9]+)*)\s+(.{3,80})', 1), ' ', regexp_extract(trim(y), '^([0-9]+(?:\.[0-9]+)*)\s+(.{3,80})', 2)), 1, 100) WHEN regexp_matches(trim(y), '(?i)^(?:chương|chapter|phần|section)\s+') THEN substring(trim(y), 1, 100) END), lambda z: z IS NOT NULL) AS o FROM marked_documents"""
FIRST = f"SELECT doc_id, section, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM (SELECT doc_id, section, min(pos) AS pos FROM (SELECT doc_id, unnest(o) AS section, unnest(range(len(o))) AS pos FROM ({OUTLINE})) GROUP BY doc_id, section)"
query("n9_outline", f"SELECT doc_id, CAST(i AS INT) AS i, section FROM ({FIRST}) WHERE i < 40")(lambda t: D.outline(t.marked_documents).select("doc_id", F.posexplode("outline").alias("i", "section")))
query("c2_distribute_sections", f"SELECT doc_id, CAST(i AS INT) AS i, section, CAST(least(floor(i / ceil(least(n, 40) / 7)), 6) + 1 AS INT) AS day FROM ({FIRST}) WHERE i < 40")(lambda t: D.distribute_sections(D.outline(t.marked_documents), 7))
query(
    "c3_fallback_plan",
    r"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(substring(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 1500), '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: length(x) > 20) AS p FROM documents), u AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM (SELECT doc_id, s, min(k) AS k FROM (SELECT doc_id, unnest(p) AS s, unnest(range(len(p))) AS k FROM p) GROUP BY doc_id, s)),
d AS (SELECT p.doc_id, CAST(g.day AS INT) AS day FROM p, (SELECT unnest(range(1, 8)) AS day) g)
SELECT d.doc_id, day, coalesce(substring(s, 1, 140), 'Nắm vững nội dung cốt lõi') AS objective FROM d LEFT JOIN u ON u.doc_id = d.doc_id AND u.i = (day - 1) % n""",
)(lambda t: D.fallback_plan(t.documents, 7))
VN = lambda c: f"trim(regexp_replace({marks(c)}, '[^a-z0-9\\s]', '', 'g'))"
query(
    "u4_repair_coverage",
    f"""WITH o AS (SELECT doc_id, i, section, substring({VN('section')}, 1, 30) AS k FROM ({FIRST}) WHERE i < 40), c AS (SELECT doc_id, {VN('section')} AS k FROM o WHERE i % 2 = 0)
SELECT doc_id, section, CAST(7 - (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1) % 7 AS INT) AS day FROM o WHERE length(k) > 4 AND NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = o.doc_id AND c.k = o.k)""",
)(lambda t: (lambda o: D.repair_coverage(o, o.select("doc_id", F.posexplode("outline").alias("i", "section")).where("i % 2 = 0"), 7))(D.outline(t.marked_documents)))
SEC = f"SELECT doc_id, section, any_value(line) FILTER (h = 1) AS heading, coalesce(list(line ORDER BY i) FILTER (h = 0), []) AS body FROM (SELECT doc_id, i, line, CASE WHEN {LV} > 0 THEN 1 ELSE 0 END AS h, sum(CASE WHEN {LV} > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM (SELECT doc_id, i, line, trim(line) AS tr, len(list_filter(regexp_split_to_array(trim(line), '\\s+'), lambda x: x <> '')) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM marked_documents))) GROUP BY doc_id, section"
NWX = lambda c: f"len(list_filter(regexp_split_to_array({c}, '\\s+'), lambda x: x <> ''))"
TRIM = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
query(
    "k5_merge_sections",
    rf"""WITH s AS (SELECT doc_id, section, heading, list_concat(CASE WHEN heading IS NULL THEN [] ELSE [heading] END, body) AS rows, body, {NWX("array_to_string(list_concat(CASE WHEN heading IS NULL THEN [] ELSE [heading] END, body), ' ')")} AS n FROM ({SEC}) WHERE heading IS NOT NULL OR trim(array_to_string(body, ' ')) <> ''),
f AS (SELECT *, n < CASE WHEN coalesce(regexp_matches(trim(heading), '^[0-9]+\.[0-9]'), false) THEN 15 ELSE 40 END AS short FROM s),
g AS (SELECT *, coalesce(sum(CASE WHEN short THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY section ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM f),
m AS (SELECT doc_id, g, flatten(list(rows ORDER BY section) FILTER (short)) AS pend, any_value(heading) FILTER (NOT short) AS heading, any_value(body) FILTER (NOT short) AS body, any_value(n) FILTER (NOT short) AS n FROM g GROUP BY doc_id, g),
c AS (SELECT doc_id, g, 0 AS o, 'merged' AS kind, {TRIM("array_to_string(pend, chr(10))")} AS content FROM m WHERE pend IS NOT NULL AND (n IS NULL OR n <= 350)
UNION ALL SELECT doc_id, g, 1, 'whole', {TRIM("array_to_string(list_concat(CASE WHEN heading IS NULL THEN [] ELSE [heading] END, body), chr(10))")} FROM m WHERE n <= 350
UNION ALL SELECT doc_id, g, 1, 'long', {TRIM("array_to_string(list_concat(CASE WHEN heading IS NULL THEN [] ELSE [heading] END, CASE WHEN pend IS NULL THEN [] ELSE list_append(pend, '') END, body), chr(10))")} FROM m WHERE n > 350)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY g, o) - 1 AS INT) AS position, kind, md5(content) AS digest, CAST({NWX('content')} AS INT) AS word_count FROM c WHERE kind <> 'merged' OR {NWX('content')} >= 15""",
)(lambda t: C.merge_sections(line_rows(t)).select("doc_id", "position", "kind", F.md5("content").alias("digest"), "word_count"))
query("k6_split_long_sections")(lambda t: C.split_long_sections(C.merge_sections(line_rows(t)).where("kind = 'long'")).select("doc_id", "position", "part", "content", "word_count"))
query("k7_chunk_documents")(lambda t: C.chunk_documents(t.marked_documents))
query("k10_propositions")(lambda t: C.propositions(C.chunk_documents(t.marked_documents)))
query("k11_expand_propositions")(lambda t: C.expand_propositions(C.chunk_documents(t.marked_documents)))
WINDOW = "substring(text, pos + 1, 8000)"
HEAD = f"length(regexp_extract({WINDOW}, '(?s)^(.*)\\n\\n', 1))"  # where the last blank line begins
CUT = f"CASE WHEN pos + 8000 >= length(text) THEN length(text) - pos WHEN contains({WINDOW}, chr(10) || chr(10)) AND {HEAD} > 4000 THEN {HEAD} + 2 ELSE 8000 END"
query(
    "k12_text_windows",
    f"""WITH RECURSIVE w AS (SELECT doc_id, text, 0 AS k, 0 AS pos, {CUT.replace('pos', '0')} AS n FROM documents WHERE text IS NOT NULL
UNION ALL SELECT doc_id, text, k, pos, {CUT} FROM (SELECT doc_id, text, k + 1 AS k, pos + CASE WHEN k = 0 THEN n ELSE greatest(n - 400, 1) END AS pos FROM w WHERE pos + 8000 < length(text)))
SELECT doc_id, CAST(k AS INT) AS "window", CAST(n AS INT) AS chars, md5(substring(text, pos + 1, n)) AS digest FROM w""",
)(lambda t: C.text_windows(t.documents).select("doc_id", "window", F.length("content").alias("chars"), F.md5("content").alias("digest")))
query("k16_build_chunk_index")(lambda t: C.build_chunk_index(t.marked_documents).select("doc_id", "chunk_index", "topic", "kind", "word_count"))
CELL = r"trim(regexp_replace(regexp_replace(regexp_replace(y, '(?i)<t[dh][^>]*>|</t[dh]>', '', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"
ROW = rf"concat('|', array_to_string(list_transform(regexp_extract_all(r, '(?i)<t[dh][^>]*>[\s\S]*?</t[dh]>'), lambda y: concat(' ', {CELL}, ' |')), ''), chr(10))"
TABLE = rf"concat(chr(10), chr(10), '[BẢNG DỮ LIỆU / SO SÁNH]', chr(10), array_to_string(list_transform(regexp_extract_all(tb, '(?i)<tr[^>]*>[\s\S]*?</tr>'), lambda r: {ROW}), ''), chr(10))"
#: The pages hold no tables: one about the page leads it, and its lists become tables of one column.
ABOUT = ("<TABLE class=a><tr><th>Address</th>\n<TD>", " <b>page</b>  </TD></tr><tr></tr></TABLE>")
query(
    "s5_html_tables_to_markdown",
    rf"""SELECT page_id, md5(list_reduce(list_prepend(x, regexp_extract_all(x, '(?i)<table[^>]*>[\s\S]*?</table>')), lambda acc, tb: replace(acc, tb, {TABLE}))) AS digest
FROM (SELECT page_id, concat('{ABOUT[0]}', url, '{ABOUT[1]}', regexp_replace(regexp_replace(html, '<(/?)[ou]l', '<\1table', 'g'), '<li>([^<]*)</li>', '<tr><td>\1</td></tr>', 'g')) AS x FROM pages)""",
)(
    lambda t: t.pages.select("page_id", F.regexp_replace(F.regexp_replace("html", "<(/?)[ou]l", "<$1table"), "<li>([^<]*)</li>", "<tr><td>$1</td></tr>").alias("x"), "url")
    .select("page_id", F.concat(F.lit(ABOUT[0]), "url", F.lit(ABOUT[1]), "x").alias("html"))
    .select("page_id", F.md5(C.html_tables_to_markdown("html")).alias("digest"))
)
query(
    "t5_unwrap_tables",
    r"""WITH l AS (SELECT doc_id, i, CASE WHEN (doc_id + i) % 3 = 0 THEN line ELSE concat('| ', line, ' |') END AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)),
r AS (SELECT doc_id, i, line, starts_with(trim(line), '|') AS bar, trim(regexp_replace(regexp_replace(trim(line), '^\|', ''), '\|$', '')) AS inr, len(list_filter(string_split(regexp_replace(regexp_replace(trim(line), '^\|', ''), '\|$', ''), '|'), lambda x: trim(x) <> '')) >= 2 AS keep FROM l),
b AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY i) AS block FROM (SELECT *, CASE WHEN lag(bar) OVER (PARTITION BY doc_id ORDER BY i) = bar THEN 0 ELSE 1 END AS nw FROM r))
SELECT doc_id, CAST(i AS INT) AS i, line FROM (SELECT doc_id, i, CASE WHEN NOT bar OR bool_or(keep) OVER (PARTITION BY doc_id, block) THEN line WHEN inr <> '' THEN inr END AS line FROM b) WHERE line IS NOT NULL""",
)(
    lambda t: D.unwrap_single_column_tables(
        t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("line", F.when((F.col("doc_id") + F.col("i")) % 3 == 0, F.col("line")).otherwise(F.concat(F.lit("| "), "line", F.lit(" |"))))
    )
)
query("v11_clone_lessons", "SELECT l.lesson_id AS reused_from, plan_id + 500 AS plan_id, day_number, title, concat('v', CAST(lesson_id % 3 + 2 AS VARCHAR)) AS version, CASE WHEN day_number = 1 THEN 'in-progress' ELSE 'locked' END AS status FROM lessons l")(
    lambda t: D.clone_lessons(t.lessons.withColumn("version", F.concat(F.lit("v"), (F.col("lesson_id") % 3 + 1).cast("string"))), t.lessons.select("lesson_id", (F.col("plan_id") + 500).alias("plan_id"), "day_number"))
)

CAMEL = "x"
for a in (r"([a-z])([A-Z])", r"([A-Z]+)([A-Z][a-z])", r"([a-zA-Z])([0-9])", r"([0-9])([a-zA-Z])"):
    CAMEL = f"regexp_replace({CAMEL}, '{a}', '\\1 \\2', 'g')"
query("t10_split_camel", f"SELECT plan_id, CASE WHEN regexp_matches(x, '^[A-Z0-9_]+$') AND length(x) <= 10 THEN x ELSE {CAMEL} END AS t FROM (SELECT plan_id, concat(replace(title, ' ', ''), 'HTTPServer', category) AS x FROM plans)")(
    lambda t: t.plans.select("plan_id", R.split_camel(F.concat(F.replace("title", F.lit(" "), F.lit("")), F.lit("HTTPServer"), "category")).alias("t"))
)
JOINED = "x"
for a, b in R.SPLIT_WORDS:
    JOINED = f"regexp_replace({JOINED}, '(?i)\\b{a}\\b', '{b}', 'gi')"
query("t11_join_broken_tokens", f"SELECT doc_id, {JOINED} AS t FROM (SELECT doc_id, concat('Err or in for mation, func  tion. ', text, ' oc curr ed') AS x FROM documents)")(
    lambda t: t.documents.select("doc_id", R.join_broken_tokens(F.concat(F.lit("Err or in for mation, func  tion. "), "text", F.lit(" oc curr ed"))).alias("t"))
)
query(
    "k1_merge_numbered_headings",
    r"""WITH l AS (SELECT doc_id, i, CASE WHEN i % 5 = 0 THEN concat(CAST(i AS VARCHAR), '.', CAST(doc_id % 4 AS VARCHAR)) ELSE line END AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)),
n AS (SELECT *, trim(lead(line) OVER (PARTITION BY doc_id ORDER BY i)) AS nx FROM l),
k AS (SELECT *, coalesce(regexp_matches(trim(line), '^[0-9]+(?:\.[0-9]+)+\s*$') AND NOT regexp_matches(nx, '^```|^\||^#{1,6}\s|^[-*+]\s|^[0-9]+\.\s|^[=+\-*/(){}\[\]|;,@#$^&<>]') AND length(nx) BETWEEN 2 AND 120 AND regexp_matches(nx, '^[A-ZÀ-Ỹa-zà-ỹ]'), false) AS tk FROM n)
SELECT doc_id, CAST(i AS INT) AS i, CASE WHEN tk THEN trim(regexp_replace(concat(trim(line), ' ', nx), '\s+', ' ', 'g')) ELSE line END AS line FROM (SELECT *, coalesce(lag(tk) OVER (PARTITION BY doc_id ORDER BY i), false) AS gone FROM k) WHERE NOT gone""",
)(
    lambda t: R.merge_numbered_headings(
        t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("line", F.when(F.col("i") % 5 == 0, F.concat(F.col("i").cast("string"), F.lit("."), (F.col("doc_id") % 4).cast("string"))).otherwise(F.col("line")))
    )
)
NOISE = ", ".join(f"'{w}'" for w in R.NOISE)
query("n2_title_keywords", rf"SELECT lesson_id, array_to_string(list_filter(list_transform(regexp_split_to_array(title, '[\s,\-.()\[\]/]+'), lambda x: lower(trim(x))), lambda x: length(x) >= 2 AND x NOT IN ({NOISE})), ' ') AS k FROM lessons")(
    lambda t: t.lessons.select("lesson_id", F.array_join(R.title_keywords("title"), " ").alias("k"))
)
LEAK = "x"
for p in (r"(?i)^```(?:markdown|md)?\n?", r"\n?```$"):
    LEAK = f"regexp_replace({LEAK}, '{p}', '', 'g')"
LEAK = TRIM(LEAK)
for p in R.LEAKS:
    LEAK = f"regexp_replace({LEAK}, '{p}', '', 'g')"
LEAK = TRIM(f"regexp_replace({LEAK}, '\\n{{3,}}', chr(10) || chr(10), 'g')")
for m in ("### Quiz", "## Quiz", "---\n**Quiz"):
    LEAK = TRIM(f"split_part({LEAK}, '{m}', 1)")
LEAK = TRIM(rf"array_to_string(list_filter(string_split({LEAK}, chr(10)), lambda y: NOT regexp_matches(trim(y), '(?i)^(?:[*-]\s*)?\[Context:|^\[BẢNG DỮ LIỆU')), chr(10))")
LEAKY = ("```markdown\n===== BÀI TRƯỚC ===== x =====\n[Context: a]\n", "\n━━━ y ━━━\n• Ngày 2: z\n## Quiz\nq\n```")
query("t19_strip_prompt_leakage", f"SELECT lesson_id, md5({LEAK}) AS digest FROM (SELECT lesson_id, concat('{LEAKY[0]}', content, '{LEAKY[1]}') AS x FROM lessons)")(
    lambda t: t.lessons.select("lesson_id", F.md5(R.strip_prompt_leakage(F.concat(F.lit(LEAKY[0]), "content", F.lit(LEAKY[1])))).alias("digest"))
)
