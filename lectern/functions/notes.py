"""What a text teaches: concepts, key facts, formula-like notes, code identifiers, snippets of high value."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .repair import let
from .text import col, normalize_space, trim_all


def ascii_bounds(pattern: str) -> str:
    """Word boundaries that look at ASCII letters, digits and the underscore only, before and behind what they bound."""
    return re.sub(r"\\b(?=[(\[A-Za-z])", "(?<![A-Za-z0-9_])", pattern).replace(r"\b", "(?![A-Za-z0-9_])")


#: Names of the query language that count as concepts where a bracket follows.
CALLED = (
    "YEAR", "MONTH", "DAY", "LEN", "LENGTH", "SUBSTRING", "CHARINDEX", "PATINDEX", "REPLACE", "STUFF", "UPPER", "LOWER", "LTRIM", "RTRIM", "TRIM", "CONCAT", "CONCAT_WS", "STRING_AGG", "STRING_SPLIT", "FORMAT",
    "ABS", "ROUND", "CEILING", "FLOOR", "POWER", "SQRT", "SUM", "AVG", "COUNT", "MIN", "MAX", "CAST", "CONVERT", "TRY_CAST", "TRY_CONVERT", "PARSE", "TRY_PARSE", "ROW_NUMBER", "RANK", "DENSE_RANK", "NTILE",
    "LEAD", "LAG", "FIRST_VALUE", "LAST_VALUE",
)
#: Names and phrases that count wherever they stand.
NAMED = (
    "DATEADD", "DATEDIFF", "GETDATE", "SYSDATETIME", "CURRENT_TIMESTAMP", "EOMONTH", "DATEFROMPARTS", "IF EXISTS", "WHILE", "CASE WHEN", "GROUP BY", "HAVING", "ORDER BY", "INNER JOIN", "LEFT JOIN", "RIGHT JOIN",
    "FULL JOIN", "CROSS JOIN", "CREATE TABLE", "ALTER TABLE", "CREATE INDEX", "CREATE VIEW", "CREATE PROCEDURE", "CREATE TRIGGER", "BEGIN TRANSACTION", "BEGIN TRAN", "COMMIT", "ROLLBACK", "BEGIN TRY", "BEGIN CATCH", "THROW", "RAISERROR",
)
#: Beginnings of headings that name no concept, and signs that a heading does.
GENERIC = (
    r"(?iu)^(?:kết\s*luận|tóm\s*tắt|ví\s*dụ(?:\s*thực\s*tế)?|tổng\s*kết|giới\s*thiệu|mục\s*tiêu|overview|summary|introduction|conclusion|examples?|notes?|lưu\s*ý|bài\s*tập|exercises?|quiz|câu\s*hỏi|bài\s*học|nội\s*dung"
    r"|phần|chương|section|chapter|day\s*[0-9]+|ngày\s*[0-9]+|so\s*sánh|ứng\s*dụng|thực\s*hành|practice)"
)
CONCEPT = "|".join([rf"\b(?:{'|'.join(sorted(CALLED, key=len, reverse=True))})\s*\(", rf"\b(?:{'|'.join(n.replace(' ', chr(92) + 's+') for n in NAMED)})\b", r"\bDECLARE\s+\w+\s+CURSOR\b"])


def heading_concepts(c: str | Column) -> Column:
    """Headings of at most ten words, without marks and numbers, that are not generic, in capitals."""
    lines = F.filter(F.split(col(c), "\n"), lambda x: x.rlike(r"^#{1,4}\s+."))
    bare = F.transform(lines, lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"^#{1,4}\s+", ""), r"\*\*|`", ""), r"^[0-9]+(?:\.[0-9]+)*[\s.]\s*", "")))
    return F.transform(F.filter(bare, lambda x: (F.size(F.split(x, r"\s+")) <= 10) & ~x.rlike(GENERIC)), lambda x: F.upper(x))


def extract_concepts(content: str | Column, title: str | Column) -> Column:
    """Distinct concepts of a lesson: names of the query language, then headings."""
    text = F.concat_ws("\n", F.coalesce(col(title), F.lit("")), F.coalesce(col(content), F.lit("")))
    named = F.transform(F.regexp_extract_all(text, F.lit(f"(?i){ascii_bounds(CONCEPT)}"), 0), lambda x: F.upper(F.trim(F.regexp_replace(F.regexp_replace(x, r"\s*\($", ""), r"\s+", " "))))
    return F.array_distinct(F.concat(named, heading_concepts(text)))


#: Lines that are no note.
NO_FORMULA = (
    r"^[-=─═]{2,}$", r"(?i)^\[Context:", r"(?iu)^\[BẢNG", r"(?i)^https?://", r"(?i)^[\w./%-]+\.(?:asp|php|html?|aspx|jsp)\b", r"^[\w-]+/[\w-]+/", r"^[,+;/\\()\[\]{}|]", r"[+,]$", r"^\[\^", r"^@<", r"^\[,\s*@", r"^[0-9\s\-./]+$",
)
NO_NOTE = (
    r"(?i)^\[Context:", r"(?iu)^\[BẢNG", r"^[-=─═]{1,}$", r"^\[\^", r"(?i)^https?://", r"(?i)^[\w./%-]+\.(?:asp|php|html?|aspx)\b", r"^[\w-]+/[\w-]+/", r"^[,+;/\\()\[\]]", r"^@<", r"^\[,\s*@", r"^[◦•▪]\s*$", r"^[0-9\s\-.]+$",
)
DEFINES = r"(?iu)định nghĩa|công thức|theorem|lemma|hệ quả|quy tắc|rule|property|axiom"
LETTERS = "[a-zA-ZÀ-ỹ]"


def cut_bullet(x: Column) -> Column:
    """A bullet that ends in the middle of a sentence and is short."""
    rest = F.trim(F.regexp_replace(x, r"^[◦•]\s+", ""))
    return x.rlike(r"^[◦•]\s+") & ~rest.rlike("[.!?;:…]$") & (F.length(rest) < 80)


def formula_notes(c: str | Column, most: int = 8) -> Column:
    """Lines with mathematics beside words, or with the word of a definition, cut at 180 characters."""
    lines = F.filter(F.transform(F.split(col(c), r"\r?\n"), trim_all), lambda x: x != "")
    sound = lambda x: ~x.rlike(ascii_bounds("|".join(f"(?:{p})" for p in NO_FORMULA))) & (F.length(x) >= 20) & (F.regexp_count(x, F.lit(LETTERS)) >= 6) & ~cut_bullet(x)
    tells = lambda x: (x.rlike(r"[=+\-*/^√∑∏≤≥≈%]") & x.rlike(LETTERS + "{3,}")) | x.rlike(DEFINES)
    kept = F.filter(lines, lambda x: sound(x) & tells(x) & (F.length(x) <= 250))
    return F.slice(F.array_distinct(F.transform(kept, lambda x: F.when(F.length(x) > 180, F.concat(F.substring(x, 1, 180), F.lit("..."))).otherwise(x))), 1, most)


def clean_notes(notes: Column, most: int = 12) -> Column:
    """Distinct notes in one line each, without headers, rules, links, code remains, bullets cut short and fragments."""
    arrow = lambda x: x.rlike(r"^=>\s*.") & (F.length(F.trim(F.regexp_replace(x, r"^=>\s*", ""))) < 30)
    sound = lambda x: ~x.rlike(ascii_bounds("|".join(f"(?:{p})" for p in NO_NOTE))) & ~(x.rlike("[+,]$") & (F.length(x) < 80)) & (F.regexp_count(x, F.lit(LETTERS)) >= 6) & ~arrow(x) & ~cut_bullet(x) & (F.length(x) >= 10)
    return F.slice(F.array_distinct(F.filter(F.transform(notes, normalize_space), lambda x: (x != "") & sound(x))), 1, most)


def plain_references(c: str | Column) -> Column:
    text = reduce(lambda x, s: F.replace(x, F.lit(s[0]), F.lit(s[1])), (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")), col(c))
    return F.regexp_replace(text, "&#[0-9]+;", "")


#: Fixed values: (pattern, longest kept, most kept): numbered lines, classes and definitions in two languages, bullets, headings.
#: A match of those in the middle always begins with its line, so they say so and never try the places in between.
FACTS = (
    (r"(?m)^\s*[0-9]+[.)\-]\s+.{10,}", 0, 0),
    (r"(?imu)^.{5,}(?:loại|trường hợp|nhóm|kiểu|dạng|cách|mức|bước)\s*:\.?.{5,}", 200, 0),
    (r"(?im)^.{5,}(?:types? of|categories|methods|steps|phases|stages|levels|forms|kinds)\s*.{5,}", 200, 0),
    (r"(?imu)^.{5,}(?:là một|là tập|là quá trình|được định nghĩa).{10,}", 200, 0),
    (r"(?im)^.{5,}(?:is defined as|refers to|is a |are the ).{10,}", 200, 0),
    (r"(?m)^\s*[◦•*\-] {1,}[A-ZÀ-ỹ].{15,}", 0, 8),
    (r"(?m)^#{1,3}\s+.{5,}", 0, 6),
)


def key_facts(c: str | Column, most: int = 15) -> Column:
    """Distinct facts of 15 characters or more, kind after kind."""

    def found(text: Column) -> Column:
        kinds = []
        for pattern, longest, some in FACTS:
            hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), trim_all)
            hits = F.transform(hits, lambda x: F.substring(x, 1, longest)) if longest else hits  # noqa: B023
            kinds.append(F.slice(hits, 1, some) if some else hits)
        return F.slice(F.filter(F.array_distinct(F.concat(*kinds)), lambda x: F.length(x) >= 15), 1, most)

    return let(plain_references(c), found)


#: Words that are no names of tables, of functions or of declared things.
NO_TABLE = "(?i)^(?:SELECT|WHERE|SET|VALUES|BEGIN|END|TRAN)$"
NO_CALL = (
    "(?i)^(?:if|while|for|switch|catch|def|class|function|print|console|log|return|SELECT|INSERT|UPDATE|DELETE|JOIN|CAST|CONVERT|YEAR|MONTH|DAY|LEN|ABS|ROUND|SUM|AVG|COUNT|MIN|MAX|AND|OR|NOT)$"
)
NO_DECLARED = "(?i)^(?:if|else|while|for|return|import|from)$"
#: (pattern, group, shortest, stop list), kind after kind.
IDENTIFIERS = (
    (r"\b(?:sp|usp|fn)[A-Z][A-Za-z0-9_]+", 0, 1, None),
    (r"(?i)CREATE\s+(?:PROC|PROCEDURE|FUNCTION|TABLE|VIEW)\s+(\w+)", 1, 3, None),
    (r"(?:FROM|JOIN|INTO|UPDATE|TABLE)\s+([A-Z][A-Za-z0-9_]+)", 1, 3, NO_TABLE),
    (r"(?i)@@[A-Z]+", 0, 1, None),
    (r"\b([a-zA-Z_][a-zA-Z0-9_]*)\s*\(", 1, 3, NO_CALL),
    (r"\b(?:const|let|var|def|class)\s+([a-zA-Z_][a-zA-Z0-9_]*)", 1, 3, NO_DECLARED),
    (r"\b([A-Z][a-z0-9]+[A-Z][a-zA-Z0-9]*)\b", 1, 4, None),
)


def code_identifiers(c: str | Column, most: int | None = 15) -> Column:
    """Distinct names of code in a text, kind after kind."""

    def found(text: Column) -> Column:
        kinds = []
        for pattern, group, least, stop in IDENTIFIERS:
            names = F.regexp_extract_all(text, F.lit(ascii_bounds(pattern)), group)
            kinds.append(F.filter(names, lambda x: (F.length(x) >= least) & (~x.rlike(stop) if stop else F.lit(True))))  # noqa: B023
        every = F.array_distinct(F.concat(*kinds))
        return F.slice(every, 1, most) if most else every

    return let(plain_references(c), found)


#: Snippets that are worth most, and how long each may be.
SNIPPETS = (r"(?iu)ví dụ[\s\S]{0,400}", r"(?iu)bài toán[\s\S]{0,400}", r"(?iu)định lý[\s\S]{0,300}", r"(?iu)công thức[\s\S]{0,300}", r"\$[\s\S]{0,150}\$", r"```[\s\S]{0,300}```")


def smart_context(c: str | Column, limit: int = 1400) -> Column:
    """A long text as its head, its snippets of high value and its tail."""
    text = col(c)
    snippets = F.array_distinct(F.concat(*[F.transform(F.regexp_extract_all(text, F.lit(p), 0), trim_all) for p in SNIPPETS]))
    parts = F.array(F.substring(text, 1, 500), F.substring(F.array_join(snippets, "\n"), 1, 600), F.right(text, F.lit(300)))
    return F.when(F.length(text) <= limit, text).otherwise(F.substring(F.array_join(F.filter(parts, lambda x: x != ""), "\n---\n"), 1, limit))


def objective_seeds(c: str | Column, days: int) -> Column:
    """For each day the sentence at its share of the text, 150 characters at most; empty where there are no sentences."""
    sentences = F.filter(F.transform(F.split(col(c), r"[.!?]\s+"), normalize_space), lambda x: F.length(x) > 20)
    return let(sentences, lambda s: F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda i: F.substring(F.coalesce(F.get(s, F.floor(i * F.size(s) / days).cast("int")), F.lit("")), 1, 150)))
