"""The text cleaner: repairs that look at a document's lines together, and the whole chain.

Alone, a repair takes lines as rows: runs of lines are gaps and islands, windows by document mark them, one aggregate on (document,
place) joins them. The chain takes whole documents, in one pass without a shuffle (onetext); its steps give what the repairs give.
"""

from __future__ import annotations

import html
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import onetext as T
from ..functions import repair as R
from ..functions.text import trim_all
from ..sources.files import small_batches
from .chunking import nfc


def in_order() -> W:
    """The lines of a document in order."""
    return W.partitionBy("doc_id").orderBy("i")


def so_far() -> W:
    return in_order().rowsBetween(W.unboundedPreceding, W.currentRow)


def lines_of(docs: DataFrame, c: str = "text") -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split(c, "\n")).alias("i", "line"))


def text_of(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id and text put together from its lines; a document without lines has an empty text."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n")
    return docs.select("doc_id").join(lines.groupBy("doc_id").agg(text.alias("text")), "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def in_code(line: str = "line") -> Column:
    """Whether a line is inside a code fence; the fence that begins one is."""
    return F.sum(trim_all(line).startswith("```").cast("int")).over(so_far()) % 2 == 1


def joined(rows: DataFrame, separator: str) -> DataFrame:
    """Rows (doc_id, i, at, line) of equal at as one line at the place of the first."""
    parts = F.array_sort(F.collect_list(F.struct("i", "line")))
    return rows.groupBy("doc_id", "at").agg(parts.alias("p")).select("doc_id", F.col("at").alias("i"), F.array_join(F.transform("p", lambda x: x["line"]), separator).alias("line"))


def flatten_broken_tables(lines: DataFrame, least: int = 4) -> DataFrame:
    """Four or more broken-off cells on consecutive lines outside code become one line, joined by bars. lines: doc_id, i, line."""
    rows = lines.withColumns({"code": in_code(), "n": F.row_number().over(in_order())}).withColumn("cell", ~F.col("code") & R.looks_broken(F.col("line")))
    run = W.partitionBy("doc_id", "cell", "g")
    rows = rows.withColumn("g", F.col("n") - F.row_number().over(W.partitionBy("doc_id", "cell").orderBy("i")))
    rows = rows.withColumn("flat", F.col("cell") & (F.count("*").over(run) >= least)).withColumn("at", F.when(F.col("flat"), F.min("i").over(run)).otherwise(F.col("i")))
    return joined(rows.select("doc_id", "i", "at", F.when(F.col("flat"), trim_all("line")).otherwise(F.col("line")).alias("line")), " | ")


def tidy_lines(lines: DataFrame) -> DataFrame:
    """White space of plain lines outside code tidied; fences stay."""
    stays = F.col("code") | trim_all("line").startswith("```")
    return lines.withColumn("code", in_code()).select("doc_id", "i", F.when(stays, F.col("line")).otherwise(R.tidy_line(F.col("line"))).alias("line"))


def defrag_lines(lines: DataFrame, most: int = 8) -> DataFrame:
    """Plain lines of eight characters at most, with no more than one blank line between, become one line."""
    t = trim_all("line")
    rows = lines.withColumns({"code": in_code(), "n": F.row_number().over(in_order())}).withColumn("blank", t == "")
    rows = rows.withColumn("small", ~F.col("blank") & ~F.col("code") & (F.length(t) <= most) & ~t.rlike(R.MARKUP) & ~t.rlike(R.NUMBERED))
    before = F.last(F.when(~F.col("blank"), F.struct("n", "small")), ignorenulls=True).over(in_order().rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("before", before).withColumn("blanks", F.col("n") - F.coalesce("before.n", F.lit(0)) - 1)
    after_small = F.coalesce("before.small", F.lit(False))
    begins = F.col("small") & ~(after_small & (F.col("blanks") < 2))
    rows = rows.where(~(F.col("blank") & after_small & (F.col("blanks") == 0)))  # a lone blank line among fragments
    rows = rows.withColumn("at", F.when(F.col("small"), F.last(F.when(begins, F.col("i")), ignorenulls=True).over(so_far())).otherwise(F.col("i")))
    parts = F.array_sort(F.collect_list(F.struct("i", F.when(F.col("small") | F.col("blank"), t).otherwise(F.col("line")).alias("line"))))
    out = rows.groupBy("doc_id", "at").agg(parts.alias("p"), F.bool_or("small").alias("many"))  # a place has fragments only, or one other line
    line = F.array_join(F.transform("p", lambda x: x["line"]), " ")
    return out.select("doc_id", F.col("at").alias("i"), F.when(F.col("many"), F.regexp_replace(line, r"\s{2,}", " ")).otherwise(line).alias("line"))


def cleaned(rows: DataFrame, preserve: bool = False) -> DataFrame:
    """doc_id and the cleaned text of rows (doc_id, text, deep): the whole chain where deep is set, else the light one. One narrow pass:
    a document is cleaned where it is, and lines are not shuffled."""
    small_batches(rows.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = T.Words()
        for b in batches:
            pairs = zip(b.column("text").to_pylist(), b.column("deep").to_pylist())
            texts = [T.clean(t, words, preserve) if deep else T.clean_lightly(t, words) for t, deep in pairs]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "text", "deep").mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def clean_corpus(docs: DataFrame, preserve: bool = False) -> DataFrame:
    """doc_id and the cleaned text, all steps in their fixed order; preserve leaves broken tables and fragments as they are."""
    return cleaned(docs.withColumn("deep", F.lit(True)), preserve)


@F.pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    """All character references of the markup language, which no expression knows; texts without an ampersand stay."""
    return text.map(lambda t: t if t is None or "&" not in t else html.unescape(t))


def postprocess_markdown(docs: DataFrame) -> DataFrame:
    """doc_id and the text of a converter's Markdown: normal form, references, escapes, keywords, sentences, blank lines."""
    text = unescape(nfc("text"))
    for s in "_*[]#":
        text = F.replace(text, F.lit("\\" + s), F.lit(s))
    return docs.select("doc_id", text.alias("text")).select("doc_id", R.break_sentences(R.recover_keywords("text")).alias("text"))


#: Defects of a document that ask for the whole chain.
DEEP = ("slide_pdf_wrap", "glued_words", "accent_loss")


def light_clean(docs: DataFrame) -> DataFrame:
    """doc_id and text of documents (doc_id, text, issues): the whole chain for deep defects, a light one for the rest."""
    deep = F.arrays_overlap(F.coalesce("issues", F.array().cast("array<string>")), F.array(*[F.lit(x) for x in DEEP]))
    return cleaned(docs.withColumn("deep", F.coalesce(deep, F.lit(False))))
