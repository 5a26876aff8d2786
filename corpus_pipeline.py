"""A training corpus in five stages, each an operator of lectern.llm over all that the stage before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
docs of the next one. All but the last return the columns of documents; n_chars follows the text where it changed.

Nulls: null texts count as empty ones. Documents without an id are scored, but no near-duplicate or passage rule
can name them, so they stay. Rows that repeat an id: equal texts are copies, of which one stays; others stay. Empty tables
pass through. Columns beyond those of documents are dropped by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import read, stage
from lectern.llm.op01_quality_gam import score_quality
from lectern.llm.op02_near_texts import near_copies
from lectern.llm.op04_substring_dedup import substring_dedup
from lectern.llm.op07_decontamination import decontaminate
from lectern.llm.op09_packing import packing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
REST = ("lang", "source", "n_chars")
#: A document stays if its quality score is this or more.
MIN_QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model rejects go."""
    return score_quality(docs.select(COLUMNS), read(spark, sf_dir, "labels")).where(F.col("quality_score") >= MIN_QUALITY).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (Jaccard of five-word shingles 0.8 or more) the document of smallest id stays."""
    texts = near_copies(docs)
    first = texts.groupBy("group").agg(F.min(F.struct("doc_id", "text_hash")).alias("first")).select("first.*")
    named = docs.where("doc_id is not null").withColumn("text_hash", F.xxhash64("text")).join(first, ["doc_id", "text_hash"])
    return named.dropDuplicates(["doc_id", "text_hash"]).select(COLUMNS).unionByName(docs.where("doc_id is null").select(COLUMNS))


def _with_text(out: DataFrame, changed: str) -> DataFrame:
    """n_chars after the cut; documents of which nothing is left go."""
    left = (F.col(changed) == 0) | (F.trim(F.coalesce("text", F.lit(""))) != "")
    return out.where(left).withColumn("n_chars", F.when(F.col(changed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document of smaller id also has are cut out."""
    return _with_text(substring_dedup(docs, with_text=True, keep=REST), "n_removed")


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out."""
    return _with_text(decontaminate(docs, read(spark, sf_dir, "benchmark"), REST), "n_hit")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: the pieces of every document with their places."""
    import public_tokenizers

    return packing(docs, public_tokenizers.path("word_bpe_49k.json"), "word", 1)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("passage_dedup", passage_dedup),
    ("benchmark_free", benchmark_free),
    ("packing", packed),
]

#: Learned models and token ids have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
