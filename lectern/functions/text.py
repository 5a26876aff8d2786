"""Column builders over text: regular-expression helpers, normal forms, cleaning steps and document metrics."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as JavaScript sees it.
JS_WS = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
_ASCII_BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
#: Letters with marks and the letters they decompose to.
MARKED = "àáạảãâầấậẩẫăằắặẳẵèéẹẻẽêềếệểễìíịỉĩòóọỏõôồốộổỗơờớợởỡùúụủũưừứựửữỳýỵỷỹçñäëïöüåÿ"
PLAIN = "aaaaaaaaaaaaaaaaaeeeeeeeeeeeiiiiiooooooooooooooooouuuuuuuuuuuyyyyycnaeiouay"


#: Letters that fold to an ASCII letter where case folding is Unicode's, beside its own two forms.
FOLDED = {"i": "ıİ", "k": "\u212a", "s": "ſ"}
_WORD, _WORD_FOLDED = "[A-Za-z0-9_]", "(?-iu:[A-Za-z0-9_" + "".join(FOLDED.values()) + "])"


def _alternatives(pattern: str) -> list[list[str]]:
    """The alternatives of a pattern (of its one group, if that is all it is) as lists of tokens."""
    group = re.fullmatch(r"\\b\(([^()]*)\)\\b", pattern)
    parts: list[list[str]] = [[]]
    depth = 0
    for token in re.findall(r"\\.|\[(?:\\.|[^\]])*\]|.", group[1] if group else pattern, re.S):
        depth += (token == "(") - (token == ")")
        if token == "|" and not depth:
            parts.append([])
        else:
            parts[-1].append(token)
    return parts


def needed_words(pattern: str) -> list[str]:
    """Words in small letters of which every match of the pattern holds at least one; none where an alternative asks for none."""
    words = []
    for tokens in _alternatives(pattern):
        runs, depth = [""], 0
        for token, after in zip(tokens, [*tokens[1:], ""]):
            depth += (token == "(") - (token == ")")
            sure = not depth and re.fullmatch(r"[\w@#%]", token) and after not in ("?", "*", "{")
            runs = [*runs[:-1], runs[-1] + token.lower()] if sure else [*runs, ""]
        words.append(max(runs, key=len))
    return list(dict.fromkeys(words)) if all(words) else []


def fold_letters(c: str | Column) -> Column:
    """Small letters, also of the few signs that a pattern without regard to case takes for ASCII letters."""
    return F.lower(F.translate(col(c), "".join(FOLDED.values()), "iiks"))


def may_match(folded: str | Column, pattern: str) -> Column:
    """Whether a text (fold_letters of it) holds a word that the pattern needs: far cheaper to find than a match."""
    return reduce(lambda x, y: x | y, [F.contains(col(folded), F.lit(w)) for w in needed_words(pattern)] or [F.lit(True)])


def js_regex(pattern: str, unicode_boundaries: bool = False) -> str:
    """A pattern whose word boundaries are ASCII ones (as in JavaScript and RE2) and whose case folding is Unicode's."""
    # an ASCII pattern folds ASCII letters only, as in JavaScript, and is much faster so
    flags, word = ("(?i)", _WORD) if pattern.isascii() else ("(?iu)", _WORD_FOLDED)
    if not unicode_boundaries:
        group = re.fullmatch(r"\\b\(([^()]*)\)\\b", pattern)
        if group:  # what a boundary asks for beside each word follows from the word's own end; words of one first letter stand together, in order
            before = lambda w: f"(?<!{word})" if re.match("[A-Za-z0-9_]", w) else f"(?<={word})"
            after = lambda w: f"(?!{word})" if re.search("[A-Za-z0-9_]$", w) else f"(?={word})"
            begun: dict[str, list[str]] = {}
            for w in group[1].split("|"):
                begun.setdefault(w[0].lower(), []).append(w)
            pattern = "(?:" + "|".join(f"(?={c}){before(c)}(?:{'|'.join(w + after(w) for w in ws)})" for c, ws in begun.items()) + ")"
        # beside an ASCII letter a boundary is one look-around
        pattern = re.sub(r"\\b(?=[A-Za-z])", f"(?<!{word})", pattern)
        pattern = re.sub(r"(?<=[A-Za-z])\\b", f"(?!{word})", pattern).replace(r"\b", _ASCII_BOUNDARY)
    return flags + pattern


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_all(c: str | Column) -> Column:
    """Without white space of any kind at either end (Spark's trim takes spaces only)."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def strip_marks(c: str | Column) -> Column:
    """Lower-case letters without their marks; combining marks go as well. đ stays."""
    return F.regexp_replace(F.translate(F.lower(col(c)), MARKED, PLAIN), r"[\u0300-\u036f]", "")


def fold_vi(c: str | Column, map_d: bool = False) -> Column:
    folded = strip_marks(c)
    return F.translate(folded, "đ", "d") if map_d else folded


def normalize_space(c: str | Column) -> Column:
    return F.trim(F.regexp_replace(col(c), f"{JS_WS}+", " "))


def normalize_title(c: str | Column) -> Column:
    """Without marks, "day N", digits and signs."""
    steps = ((r"day\s*[0-9]+", ""), ("[0-9]+", ""), (r"[^a-zA-Z0-9À-ɏ\s]", ""), (r"\s+", " "))
    return F.trim(reduce(lambda x, s: F.regexp_replace(x, *s), steps, strip_marks(c)))


def normalize_text(c: str | Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(strip_marks(c), r"[^a-z0-9\s]", " "), r"\s+", " "))


def normalize_vn(c: str | Column) -> Column:
    return F.trim(F.regexp_replace(strip_marks(c), r"[^a-z0-9\s]", ""))


def normalize_tag(c: str | Column) -> Column:
    return F.regexp_replace(normalize_vn(c), r"\s+", "_")


def sanitize_section(c: str | Column) -> Column:
    """A section's name; empty where it is code or a number, 120 characters at most."""
    s = F.trim(F.coalesce(col(c), F.lit("")))
    junk = s.rlike(r"(?i)\[OUTPUT|OUT\]") | ((F.length(s) < 10) & s.rlike(r"^\[") & s.rlike(r"\]")) | ((F.length(s) < 30) & s.rlike(r"[{}()\[\]|]")) | s.rlike(r"^[0-9\s,.;:]+$")
    return F.when(junk, "").otherwise(F.substring(s, 1, 120))


def embedding_input(c: str | Column, limit: int = 500) -> Column:
    return F.substring(normalize_space(c), 1, limit)


def truncate_middle(c: str | Column, limit: int = 150_000, marker: str = "\n\n[... truncated ...]\n\n") -> Column:
    """The first 60 and the last 40 per cent of the limit where the text is longer."""
    head, tail = int(limit * 0.6), limit - int(limit * 0.6)
    return F.when(F.length(col(c)) > limit, F.concat(F.substring(col(c), 1, head), F.lit(marker), F.right(col(c), F.lit(tail)))).otherwise(col(c))


def collapse_image_markers(c: str | Column) -> Column:
    """Three or more image placeholders in a row become one long note, one or two a short one."""
    many = F.regexp_replace(col(c), r"(?:<!-- image -->\s*){3,}", "[images omitted]\n")
    return F.regexp_replace(many, r"(?:<!-- image -->\s*){1,2}", "[image]\n")


def unescape_markdown(c: str | Column) -> Column:
    return reduce(lambda x, s: F.replace(x, F.lit("\\" + s), F.lit(s)), ["_", "*", "[", "]", "#", "|"], col(c))


def html_to_markdown(c: str | Column) -> Column:
    """Headings, paragraphs, breaks, emphasis, table cells and list items as Markdown; other tags go. Order matters."""
    steps = [(rf"(?is)<h{k}[^>]*>([\s\S]*?)</h{k}>", "\n" + "#" * k + " $1\n") for k in range(1, 7)]
    steps += [
        (r"(?is)<p[^>]*>([\s\S]*?)</p>", "$1\n\n"), (r"(?i)<br[^>]*>", "\n"), (r"(?is)<strong[^>]*>([\s\S]*?)</strong>", "**$1**"), (r"(?is)<b>([\s\S]*?)</b>", "**$1**"),
        (r"(?is)<em[^>]*>([\s\S]*?)</em>", "*$1*"), (r"(?is)<i>([\s\S]*?)</i>", "*$1*"), (r"(?i)<tr[^>]*>", "\n|"), (r"(?is)<t[dh][^>]*>([\s\S]*?)</t[dh]>", " $1 |"),
        (r"(?is)<li[^>]*>([\s\S]*?)</li>", "- $1\n"), (r"<[^>]+>", ""),
    ]
    return reduce(lambda x, s: F.regexp_replace(x, *s), steps, col(c))


#: Named character references and what they stand for; the ampersand last, so that nothing is decoded twice here.
NAMED = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def decode_entities(c: str | Column) -> Column:
    """Named, then decimal, then hexadecimal references; control characters other than tab and line ends are dropped, what is no character stays."""

    def numbered(text: Column, pattern: str, code: Callable[[Column], Column]) -> Column:
        def letter(ref: Column) -> Column:
            n = code(ref)
            real = (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
            return F.when((n < 32) & ~n.isin(9, 10, 13), "").when(real, F.decode(F.unhex(F.lpad(F.hex(F.when(real, n).otherwise(0)), 8, "0")), "UTF-32")).otherwise(ref)

        return F.aggregate(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 0)), text, lambda t, ref: F.replace(t, ref, letter(ref)))

    text = reduce(lambda x, s: F.replace(x, F.lit(s[0]), F.lit(s[1])), NAMED, col(c))
    text = numbered(text, "&#[0-9]{1,7};", lambda ref: F.regexp_extract(ref, "([0-9]+)", 1).cast("int"))
    return numbered(text, "&#x[0-9a-fA-F]{1,6};", lambda ref: F.conv(F.regexp_extract(ref, "x([0-9a-fA-F]+)", 1), 16, 10).cast("int"))


def drop_garbage_lines(c: str | Column, patterns: tuple[str, ...]) -> Column:
    """Lines that match none of the patterns when trimmed; blank lines stay."""
    p = "|".join(f"(?:{x})" for x in patterns)
    return F.array_join(F.filter(F.split(col(c), "\n"), lambda x: (F.trim(x) == "") | ~F.trim(x).rlike(p)), "\n")


def words(c: str | Column) -> Column:
    return F.filter(F.split(col(c), r"\s+"), lambda x: x != "")


def doc_metrics(c: str) -> dict[str, Column]:
    lines = F.filter(F.split(F.col(c), "\n"), lambda x: F.trim(x) != "")
    chars = F.length(c)
    return {
        "words": F.size(words(c)), "chars": chars, "lines": F.size(lines), "sections": F.size(F.filter(lines, lambda x: x.rlike(r"^(?:#{1,3} |[0-9]+\. |CHƯƠNG )"))),
        "meaningful_ratio": F.round(F.when(chars > 0, F.regexp_count(F.col(c), F.lit("[a-zA-ZÀ-ỹ0-9]")) / chars).otherwise(0.0), 6), "sentences": F.regexp_count(F.col(c), F.lit(r"[.!?]\s")),
    }


def vi_ratio(c: str) -> Column:
    """Share of Vietnamese letters among the characters that are not white space; 1 for very short texts."""
    n = F.length(F.regexp_replace(c, r"\s", ""))
    return F.when(n < 50, 1.0).otherwise(F.round(F.regexp_count(F.col(c), F.lit("[À-ỹđĐ]")) / n, 6))


def heading_level(c: str | Column) -> Column:
    """0 to 4: Markdown, dotted numbers, letters, Roman numerals, keywords, or capitals."""
    t = F.trim(col(c))
    dots = F.regexp_count(t, F.lit(r"\."))
    n = F.size(F.filter(F.split(t, r"\s+"), lambda x: x != ""))
    capitals = (n >= 2) & F.length(t).between(4, 80) & (t == F.upper(t)) & t.rlike("[A-ZÀ-Ỹ]") & ~t.rlike(r"[{}()\[\];=]")
    return (
        F.when(col(c).rlike(r"^#{1,4}\s+\S"), F.length(F.regexp_extract(col(c), r"^(#{1,4})\s", 1)))
        .when(t.rlike(r"^[0-9]+(?:\.[0-9]+)*\s+[A-ZÀ-Ỹa-zà-ỹ]"), F.least(dots + 1, F.lit(4)))
        .when(t.rlike(r"^[A-Z]\.\s+[A-ZÀ-Ỹa-zà-ỹ]"), 2)
        .when(t.rlike(r"(?i)^(?:I{1,3}|IV|V?I{0,3}|IX|X{0,3})\.\s+[A-ZÀ-Ỹa-zà-ỹ]") & (F.length(t) <= 100) & (n >= 3), 1)
        .when(t.rlike(r"(?iu)^(?:chương|chapter|phần|section|part|module|unit|bài|mục|topic|lesson)\s+(?:[0-9]+|[IVX]+)"), 1)
        .when(capitals, 2)
        .otherwise(0)
        .cast("int")
    )


def line_kind(c: str | Column) -> Column:
    x = col(c)
    return (
        F.when(F.trim(x) == "", "blank").when(x.rlike(r"^\s*```"), "fence").when(x.rlike(r"^\s*\|"), "table").when(F.trim(x).rlike(r"^#{1,6}\s"), "heading")
        .when(x.rlike(r"^\s*[-*+]\s|^\s*[0-9]+\.\s"), "list").otherwise("text")
    )


def keywords(c: str | Column, drop: str, least: int, stop: tuple[str, ...]) -> Column:
    """Words of at least so many characters, without stop words, where characters of drop count as spaces."""
    return F.filter(F.split(F.regexp_replace(col(c), drop, " "), r"\s+"), lambda x: (F.length(x) >= least) & ~x.isin(*stop))


#: Stop words of the lesson-reuse keywords.
REUSE_STOP = (
    "va", "cac", "mot", "trong", "la", "co", "de", "duoc", "voi", "bai", "hoc", "kien", "thuc", "ve", "tu", "cua", "theo", "nguoi", "dung", "chu", "nay", "tim", "hieu", "ap", "ung", "phan", "gioi", "thieu",
    "tong", "quan", "the", "and", "of", "to", "a", "in", "is", "for", "on", "with", "an", "it", "be", "as", "at", "by", "this", "that", "are", "from", "or", "but", "not", "introduction", "overview", "basic",
    "advanced",
)
#: Stop words of the re-ranking keywords.
RERANK_STOP = (
    "là", "của", "và", "các", "cho", "với", "những", "một", "được", "này", "khi", "thì", "không", "phải", "như", "theo", "the", "a", "an", "is", "in", "of", "to", "and", "or", "for", "with",
)


def reuse_keywords(c: str | Column) -> Column:
    return keywords(fold_vi(c, map_d=True), r"[^a-z0-9\s]", 3, REUSE_STOP)


def rerank_keywords(c: str | Column) -> Column:
    return keywords(F.lower(col(c)), r"[^A-Za-z0-9_\sÀ-ɏ]", 4, RERANK_STOP)


def dup_tokens(c: str | Column) -> Column:
    return F.filter(F.split(normalize_text(c), " "), lambda x: F.length(x) > 3)


def jaccard(a: str | Column, b: str | Column) -> Column:
    """Of two arrays as sets; 0 where either is empty."""
    union = F.size(F.array_union(col(a), col(b)))
    return F.when((F.size(col(a)) == 0) | (F.size(col(b)) == 0), 0.0).otherwise(F.size(F.array_intersect(col(a), col(b))) / union)


def bloom_level(day: str | Column, days: str | Column) -> Column:
    """The cognitive level of a day (from 1) in a course of so many days."""
    names = F.array(*[F.lit(x) for x in ("remember", "understand", "apply", "analyze", "evaluate", "create")])
    i = F.least(F.lit(5), F.floor((col(day) - 1) / F.greatest(F.lit(1), col(days) - 1) * 6)).cast("int")
    return F.element_at(names, i + 1)


def course_days(c: str | Column) -> Column:
    """A number of days from a number or a text: its first digits, 7 if none, between 1 and 14."""
    n = F.coalesce(F.nullif(F.regexp_extract(col(c).cast("string"), "([0-9]{1,6})", 1), F.lit("")).cast("int"), F.lit(7))
    return F.least(F.lit(14), F.greatest(F.lit(1), n))
