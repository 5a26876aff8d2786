"""Documents into chunks: sections are merged when short and split when long; propositions, windows and the whole index job.

Sections, merging and numbering are windows and aggregates by document; splitting is one pass over a section's lines in the tasks.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import heading_level, words
from ..sources.files import small_batches
from .classify import classify_topics
from .windows import uniform_cap

MIN_WORDS, MIN_NUMBERED, MAX_WORDS, OVERLAP = 40, 15, 350, 2
#: Sections whose lines a task holds as Python's strings at once.
SECTIONS = 100


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode normal form C, which has no expression in Spark; ASCII texts have it already."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), lambda x: use(x)), 1)


def trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def count_words(c: Column) -> Column:
    return F.size(words(c))


def merge_sections(lines: DataFrame) -> DataFrame:
    """Pieces of every document in order. Short sections wait: they become a piece of their own before a section of normal
    size or at the end, or lead the body of a long one. lines: doc_id, i, line. kind is merged, whole or long."""
    doc = W.partitionBy("doc_id")
    rows = lines.withColumn("h", (heading_level("line") > 0).cast("int")).withColumn("section", F.sum("h").over(doc.orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)))
    body = F.transform(F.array_sort(F.collect_list(F.when(F.col("h") == 0, F.struct("i", "line")))), lambda x: x["line"])
    none = F.array().cast("array<string>")
    s = rows.groupBy("doc_id", "section").agg(F.max(F.when(F.col("h") == 1, F.col("line"))).alias("heading"), body.alias("body"))
    s = s.where("heading is not null or trim(array_join(body, ' ')) <> ''").withColumn("rows", F.concat(F.when(F.col("heading").isNull(), none).otherwise(F.array("heading")), "body"))
    s = s.withColumn("n", count_words(F.array_join("rows", " ")))
    numbered = F.coalesce(F.trim("heading").rlike(r"^[0-9]+\.[0-9]"), F.lit(False))
    s = s.withColumn("short", F.col("n") < F.when(numbered, MIN_NUMBERED).otherwise(MIN_WORDS))
    s = s.withColumn("g", F.coalesce(F.sum((~F.col("short")).cast("int")).over(doc.orderBy("section").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    pend = F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("short"), F.struct("section", "rows")))), lambda x: x["rows"]))
    last = F.max(F.when(~F.col("short"), F.struct("section", "heading", "body", "n")))
    m = s.groupBy("doc_id", "g").agg(pend.alias("pend"), last.alias("last"))
    head = F.when(F.col("last.heading").isNull(), none).otherwise(F.array("last.heading"))
    is_long, has = F.col("last.n") > MAX_WORDS, F.size("pend") > 0
    long_body = F.concat(F.when(has, F.concat("pend", F.array(F.lit("")))).otherwise(none), "last.body")
    piece = lambda o, kind, heading, lines: F.struct(F.lit(o).alias("o"), F.lit(kind).alias("kind"), heading.alias("heading"), lines.alias("lines"))
    own = F.when(has & ~F.coalesce(is_long, F.lit(False)), piece(0, "merged", F.lit(None).cast("string"), F.col("pend")))
    end = F.when(is_long, piece(1, "long", F.col("last.heading"), long_body)).when(F.col("last").isNotNull(), piece(1, "whole", F.col("last.heading"), F.col("last.body")))
    out = m.select("doc_id", "g", F.explode(F.array_compact(F.array(own, end))).alias("p")).select("doc_id", "g", "p.*")
    whole = F.concat(F.when(F.col("heading").isNull(), none).otherwise(F.array("heading")), "lines")
    out = out.withColumn("content", trim(F.array_join(whole, "\n"))).withColumn("word_count", count_words(F.col("content")))
    out = out.where(f"kind <> 'merged' or word_count >= {MIN_NUMBERED}")
    position = (F.row_number().over(doc.orderBy("g", "o")) - 1).cast("int")
    return out.select("doc_id", position.alias("position"), "kind", "heading", "lines", "content", "word_count")


#: White space as Spark's regular expressions see it, and what else can end a line for them.
WHITE, ENDS = " \t\n\x0b\f\r", "\x85\u2028\u2029"
_WORD = re.compile(f"[^{WHITE}]+")
_SENTENCE_END = re.compile(f"(?<=[.!?])[{WHITE}]+")


def _trimmed(text: str) -> str:
    """trim, in a task: white space goes before a last line end as well."""
    return text[:-1].strip(WHITE) + text[-1] if text and text[-1] in ENDS else text.strip(WHITE)


def _words(text: str) -> int:
    return len(_WORD.findall(text))


def overlap_tail(c: Column, n: int = OVERLAP) -> Column:
    """The last n sentences of more than 20 characters."""
    sentences = F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda x: F.length(x) > 20)
    return let(sentences, lambda s: F.array_join(F.slice(s, F.greatest(F.size(s) - (n - 1), F.lit(1)), F.lit(n)), " "))


def _last_sentences(text: str, n: int = OVERLAP) -> str:
    """overlap_tail, in a task."""
    return " ".join([x for x in (x.strip(" ") for x in _SENTENCE_END.split(text)) if len(x) > 20][-n:])


def split_section(heading: str | None, lines: list[str]) -> list[tuple[str, int]]:
    """The parts (content, words) of one long section."""
    head, own = ([], 0) if heading is None else ([heading, ""], _words(heading))
    done: list[tuple[str, int]] = []
    buf, n, fence, table = [*head], own, False, False

    def settle(least: int) -> None:
        """The buffer becomes a new part, or is joined to the last one where it is short."""
        content = _trimmed("\n".join(buf))
        size = _words(content)
        if size >= MIN_WORDS or (not done and size >= least):
            done.append((content, size))
        elif done and size:
            done[-1] = (f"{done[-1][0]}\n{content}", done[-1][1] + size)

    for line in lines:
        start, blank = line.lstrip(WHITE), not line.strip(" ")
        if not blank and start.startswith("```"):
            fence = not fence
        table = not blank and (table or (not fence and start.startswith("|")))
        full = not fence and not table and n >= MAX_WORDS
        if full or (blank and not fence and not table and n >= MIN_WORDS and n > own):
            settle(10**6)
            tail = _last_sentences(done[-1][0]) if done else ""
            buf, n = [*head, tail] if tail else [*head], own + _words(tail)
            if blank:
                continue
        buf.append(line)
        n += _words(line)
    settle(MIN_NUMBERED)
    return done


def split_long_sections(pieces: DataFrame) -> DataFrame:
    """Long pieces as parts: cut when 350 words are full outside code and tables, or at a blank line after 40; each part
    begins with the heading and the last sentences of the part before; a short end joins the last part. Every line is looked at once, in the tasks."""
    small_batches(pieces.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, SECTIONS):
                some = b.slice(k, SECTIONS)
                rows = [(i, part, c, n) for i, (h, ls) in enumerate(zip(some.column(2).to_pylist(), some.column(3).to_pylist())) for part, (c, n) in enumerate(split_section(h, ls))]
                at, part, content, words = zip(*rows) if rows else ((), (), (), ())
                ids, positions, headings = (some.column(j).take(pa.array(at, pa.int64())) for j in range(3))
                yield pa.RecordBatch.from_arrays([ids, positions, pa.array(part, pa.int32()), headings, pa.array(content, pa.string()), pa.array(words, pa.int32())], names=["doc_id", "position", "part", "heading", "content", "word_count"])

    kinds = dict(pieces.dtypes)
    return pieces.select("doc_id", "position", "heading", "lines").mapInArrow(work, f"doc_id {kinds['doc_id']}, position {kinds['position']}, part int, heading string, content string, word_count int")


def chunk_documents(docs: DataFrame) -> DataFrame:
    """doc_id, chunk_index, section, content, word_count of every chunk."""
    pieces = merge_sections(docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")))
    short = pieces.where("kind <> 'long'").select("doc_id", "position", F.lit(0).alias("part"), "heading", "content", "word_count")
    both = short.unionByName(split_long_sections(pieces.where("kind = 'long'")))
    index = (F.row_number().over(W.partitionBy("doc_id").orderBy("position", "part")) - 1).cast("int")
    return both.select("doc_id", index.alias("chunk_index"), F.coalesce("heading", F.lit("")).alias("section"), "content", "word_count")


#: Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = (
    r"v\.v", r"v\.v\.", "TP", r"GS\.TS", r"PGS\.TS", r"Th\.S", "GS", "PGS", "TS", "KS", "BS", "BN", "Tr", r"e\.g", r"i\.e", "etc", "vs", "approx", "dept", "fig", "eq", "no", "vol", "pp", "ed", "tr", "Dr",
    "Mr", "Mrs", "Ms", "St", "prob", "def", "thm", "prop", "cor", "ex", "sec", "ch", "ref", "Jan", "Feb", "Mar", "Apr", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec",
)


def propositions(chunks: DataFrame) -> DataFrame:
    """Sentences of 6 to 120 words as chunks of their own, led by the section's name; code, headings and list marks go."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace("content", r"(?s)```.*?```", ""), r"`([^`\n]+)`", "$1"), r"\.{3,}", " ")
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: (F.length(x) > 5) & ~x.startswith("#") & (x != F.trim("section")))
    # looked for behind each full stop, not at each letter
    guarded = lambda x: F.regexp_replace(x, r"(?iu)\.(?=\s)(?<=(?<![A-Za-z0-9_])(?:" + "|".join(ABBREVIATIONS) + r")\.)", "⟨DOT⟩")
    parts = F.flatten(F.transform(lines, lambda x: F.split(guarded(x), r"(?<!\d)[.!?](?=\s|$)")))
    clean = F.filter(F.transform(parts, lambda x: F.trim(F.replace(x, F.lit("⟨DOT⟩"), F.lit(".")))), lambda x: F.length(x) >= 8)
    clean = F.transform(clean, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"^[-*+]\s+", ""), r"^\d+\.\s+", "")))
    rows = chunks.withColumn("clean", clean).select("doc_id", "chunk_index", "section", F.posexplode("clean").alias("n", "sentence"))
    rows = rows.withColumn("section", F.trim(F.regexp_replace(F.trim("section"), r"^#+\s*", "")))
    rows = rows.where(count_words(F.col("sentence")).between(6, 120))
    content = F.when(F.col("section") != "", F.concat("section", F.lit(": "), "sentence")).otherwise(F.col("sentence"))
    return rows.select("doc_id", "chunk_index", "n", content.alias("content")).withColumn("word_count", count_words(F.col("content")))


def expand_propositions(chunks: DataFrame, least: int = 150, most: int = 3) -> DataFrame:
    """Chunks, then up to three propositions of each long one; numbered anew with the parents first."""
    long_ones = propositions(chunks.where(F.col("word_count") > least))
    place = F.row_number().over(W.partitionBy("doc_id", "chunk_index").orderBy("n"))
    some = long_ones.withColumn("n", place).where(F.col("n") <= most)
    both = chunks.select("doc_id", "chunk_index", F.lit(0).alias("n"), F.lit("parent").alias("kind"), "section", "content", "word_count").unionByName(
        some.select("doc_id", "chunk_index", "n", F.lit("proposition").alias("kind"), F.lit("").alias("section"), "content", "word_count")
    )
    index = (F.row_number().over(W.partitionBy("doc_id").orderBy(F.col("n") > 0, "chunk_index", "n")) - 1).cast("int")
    return both.select("doc_id", index.alias("chunk_index"), "kind", "section", "content", "word_count")


def text_windows(docs: DataFrame, size: int = 8000, overlap: int = 400) -> DataFrame:
    """Overlapping windows of so many characters that end at a blank line in their second half where there is one."""

    def cut(pos: Column) -> Column:
        """How long the window at pos (from 0) is."""
        piece = F.substring("text", pos + 1, F.lit(size))
        at = F.length(piece) - F.instr(F.reverse(piece), "\n\n") - 1  # where the last blank line begins
        return F.when((F.instr(piece, "\n\n") > 0) & (at > size // 2), at + 2).otherwise(F.length(piece))

    def step(s: Column, _: Column) -> Column:
        pos, last = s["pos"], s["pos"] + size >= F.length("text")
        rest = F.length("text") - pos
        return F.when(s["over"], s).otherwise(
            let(F.when(last, rest).otherwise(cut(pos)), lambda n: F.struct(
                F.array_append(s["out"], F.struct(pos.alias("a"), n.alias("n"))).alias("out"),
                (pos + F.when(F.size(s["out"]) == 0, n).otherwise(F.greatest(n - overlap, F.lit(1)))).alias("pos"), last.alias("over"),
            ))
        )

    rounds = F.sequence(F.lit(0), F.ceil(F.length("text") / (size // 2 - overlap)).cast("int") + 1)
    none = F.struct(F.array().cast("array<struct<a:int,n:int>>").alias("out"), F.lit(0).alias("pos"), F.lit(False).alias("over"))
    spans = F.aggregate(rounds, none, step)["out"]
    return docs.select("doc_id", "text", F.posexplode(spans).alias("window", "s")).select("doc_id", "window", F.substring("text", F.col("s.a") + 1, F.col("s.n")).alias("content"))


def html_tables_to_markdown(c: str) -> Column:
    """The tables of a page as Markdown rows under a header line."""
    cell = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"(?i)<t[dh][^>]*>|</t[dh]>", ""), r"<[^>]+>", " "), r"\s+", " "))
    row = lambda r: F.concat(F.lit("|"), F.array_join(F.transform(F.regexp_extract_all(r, F.lit(r"(?i)<t[dh][^>]*>[\s\S]*?</t[dh]>"), 0), lambda x: F.concat(F.lit(" "), cell(x), F.lit(" |"))), ""))
    table = lambda t: F.concat(F.lit("\n\n[BẢNG DỮ LIỆU / SO SÁNH]\n"), F.array_join(F.transform(F.regexp_extract_all(t, F.lit(r"(?i)<tr[^>]*>[\s\S]*?</tr>"), 0), lambda r: F.concat(row(r), F.lit("\n"))), ""), F.lit("\n"))
    found = F.regexp_extract_all(F.col(c), F.lit(r"(?i)<table[^>]*>[\s\S]*?</table>"), 0)
    return F.aggregate(found, F.col(c), lambda text, t: F.replace(text, t, table(t)))


def build_chunk_index(docs: DataFrame, cap: int = 150) -> DataFrame:
    """Chunks with propositions, topics and at most so many rows for each document, numbered in order."""
    rows = uniform_cap(expand_propositions(chunk_documents(docs)), "doc_id", "chunk_index", cap)
    return classify_topics(rows.withColumn("content", F.substring("content", 1, 3000)))
