"""Repairs of text that converters broke: glued and split words, numbered headings, leaked prompts, title keywords."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .text import col, trim_all

#: Words that converters split, and what they are whole.
SPLIT_WORDS = (
    (r"err\s+or", "error"), (r"oc\s*curr\s*ed", "occurred"), (r"consist\s+ency", "consistency"), (r"prop\s+erty", "property"), (r"func\s+tion", "function"),
    (r"defi\s*ni\s*tion", "definition"), (r"imple\s*men\s*ta\s*tion", "implementation"), (r"ap\s*pli\s*ca\s*tion", "application"), (r"in\s*for\s*ma\s*tion", "information"),
)
#: Words of titles that say nothing about the subject.
NOISE = (
    "và", "của", "về", "trong", "cho", "các", "những", "một", "hai", "ba", "bản", "sao", "đang", "được", "bởi", "tại", "theo", "với", "như", "để", "này", "kia", "đó", "tôi", "bạn", "chúng", "cùng", "lên",
    "xuống", "trên", "dưới", "sau", "trước", "giữa", "từ", "đến", "qua", "lại", "ra", "vào", "ở", "có", "không", "đã", "sẽ", "rồi", "thì", "mà", "là", "nhưng", "hoặc", "hay", "nếu", "thế", "vì", "nên", "tới",
    "bị", "cả", "quá", "rất", "hơn", "chỉ", "tự", "làm", "thấy", "biết", "muốn", "cần", "khóa", "học", "bài", "tập", "đề", "thi", "cơ", "nâng", "cao", "trình", "lộ", "hướng", "dẫn", "giới", "thiệu", "tổng",
    "quan", "giáo", "tài", "liệu", "thuyết", "hành", "chuyên", "sâu", "the", "of", "in", "to", "for", "and", "a", "an", "on", "at", "by", "with", "about", "as", "into", "like", "through", "after", "before",
    "between", "under", "over", "from", "its", "their", "or", "but", "if", "then", "else", "when", "where", "why", "how", "who", "whom", "this", "that", "these", "those", "it", "he", "she", "they", "we",
    "you", "me", "him", "her", "us", "them", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "shall", "should", "can", "could", "may", "might",
    "must", "course", "lesson", "tutorial", "guide", "introduction", "basic", "advanced", "intermediate", "practice", "theory", "sao_chép", "clone", "copy",
)
#: What a generator's prompt leaves in its answer.
LEAKS = (
    r"(?i)={3,}\s*BÀI TRƯỚC[^=]*={3,}[\s\S]*?={3,}", r"(?i)={3,}\s*CONTEXT[^=]*={3,}[\s\S]*?={3,}", r"(?i)={3,}\s*PHẠM VI[^=]*={3,}", r"━{3,}[\s\S]*?━{3,}", r"(?m)^===== .+ =====$", r"(?m)^={3,}\s*$",
    r"(?m)^\[Context:.*\]$", r"(?m)^\[BẢNG DỮ LIỆU.*\]$", r"(?m)^• Ngày \d+:.*$", r"(?i)THÔNG TIN BÀI:[\s\S]*?YÊU CẦU OUTPUT:", r"(?i)YÊU CẦU OUTPUT:[\s\S]*",
)


def split_camel(token: str | Column) -> Column:
    """A Latin token cut where small letters meet capitals and letters meet digits; short capitals stay."""
    t = col(token)
    steps = ((r"([a-z])([A-Z])", "$1 $2"), (r"([A-Z]+)([A-Z][a-z])", "$1 $2"), (r"([a-zA-Z])([0-9])", "$1 $2"), (r"([0-9])([a-zA-Z])", "$1 $2"))
    return F.when(t.rlike("^[A-Z0-9_]+$") & (F.length(t) <= 10), t).otherwise(reduce(lambda x, s: F.regexp_replace(x, *s), steps, t))


def join_broken_tokens(c: str | Column) -> Column:
    """Known words that were split are whole again."""
    return reduce(lambda x, s: F.regexp_replace(x, f"(?i)(?<![A-Za-z0-9_]){s[0]}(?![A-Za-z0-9_])", s[1]), SPLIT_WORDS, col(c))


def strip_prompt_leakage(c: str | Column) -> Column:
    """A generated lesson without fences around it, prompt remains, quizzes and metadata lines."""
    t = trim_all(F.regexp_replace(F.regexp_replace(col(c), r"(?i)^```(?:markdown|md)?\n?", ""), r"\n?```$", ""))
    t = trim_all(F.regexp_replace(reduce(lambda x, p: F.regexp_replace(x, p, ""), LEAKS, t), r"\n{3,}", "\n\n"))
    t = reduce(lambda x, m: trim_all(F.substring_index(x, m, 1)), ("### Quiz", "## Quiz", "---\n**Quiz"), t)
    return trim_all(F.array_join(F.filter(F.split(t, "\n"), lambda x: ~F.trim(x).rlike(r"(?i)^(?:[*-]\s*)?\[Context:|^\[BẢNG DỮ LIỆU")), "\n"))


def merge_numbered_headings(lines: DataFrame) -> DataFrame:
    """A line of a number only, such as 2.1, takes the short title on the next line. lines: doc_id, i, line."""
    order = W.partitionBy("doc_id").orderBy("i")
    t, nxt = F.trim("line"), F.trim(F.lead("line").over(order))
    safe = ~nxt.rlike(r"^```|^\||^#{1,6}\s|^[-*+]\s|^[0-9]+\.\s|^[=+\-*/(){}\[\]|;,@#$^&<>]") & F.length(nxt).between(2, 120) & nxt.rlike("^[A-ZÀ-Ỹa-zà-ỹ]")
    rows = lines.withColumns({"_next": nxt, "_take": F.coalesce(t.rlike(r"^[0-9]+(?:\.[0-9]+)+\s*$") & safe, F.lit(False))})
    rows = rows.withColumn("_gone", F.coalesce(F.lag("_take").over(order), F.lit(False)))
    merged = F.trim(F.regexp_replace(F.concat_ws(" ", t, F.col("_next")), r"\s+", " "))
    return rows.where(~F.col("_gone")).select("doc_id", "i", F.when(F.col("_take"), merged).otherwise(F.col("line")).alias("line"))


def title_keywords(c: str | Column) -> Column:
    """Lower-case words of two characters at least, without noise words."""
    return F.filter(F.transform(F.split(col(c), r"[\s,\-.()\[\]/]+"), lambda x: F.lower(F.trim(x))), lambda x: (F.length(x) >= 2) & ~x.isin(*NOISE))
