"""Packing by harmonic classes: a bin of class k holds exactly k pieces of at most capacity / k tokens.

Documents are cut where they are long: whole capacities first (class 1); what is left goes whole into class
k = floor(capacity / length) if it nearly fills its k-th of a bin, else a piece of exactly capacity / (k + 1) is
cut off and the rest is looked at again. So a bin of any class is nearly full (k pieces of one token to 2048 fill at
least 95 % of it), and every worker classes its pieces by itself. A piece's bin is its number within the class divided by
k; numbers come from counts by (class, task), never from sorting a class in one place. What is left over in the classes'
last bins is at most one bin for each class: those are merged by first fit on the driver, over one row for each class.
Places within a sequence are sums over its own pieces, which are never more than its capacity.

Nulls: a null text is empty and has the end id alone. Rows of equal or null doc_id are each packed; a doc_id that is
no integer counts as null. An empty table gives no rows. Extra columns are not used, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read, small_batches, stage
from .encoding import encoder

CAPACITY = 2048
#: A piece goes whole into its class if it leaves free no more than this share of its part of a bin.
SLACK = 1 / 24


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(length, class) of a document's pieces, in order."""
    out = [(capacity, 1)] * (n // capacity)
    n %= capacity
    while n:
        k = capacity // n
        if capacity / k - n <= SLACK * capacity / k:
            return [*out, (n, k)]
        part = capacity // (k + 1)
        out.append((part, k + 1))
        n -= part
    return out


def pieces(docs: DataFrame, tokenizer: str, kind: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """All pieces with their class, the task that cut them and their number in (class, task)."""
    small_batches(docs.sparkSession)
    end = end_id.to_bytes(4, "little")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "task", "number"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, seen, task = encoder(tokenizer, kind), Counter(), TaskContext.get().partitionId()
        for b in batches:
            rows = []
            for doc_id, ids in zip(b.column(0).to_pylist(), coder.ids_bytes(t or "" for t in b.column(1).to_pylist())):
                ids, at = ids + end, 0
                total = len(ids) // 4
                for n, k in cut(total, capacity):
                    rows.append((doc_id, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)]), total, k, task, seen[k]))
                    seen[k] += 1
                    at += n
            cols = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, ", ".join(f"{n} long" for n in names))


def merge_rests(rests: list[tuple[int, int]], capacity: int) -> list[tuple[int, int]]:
    """First fit, largest first, over (class, tokens left over): the bin of each class's rest."""
    bins, out = [], []
    for k, tokens in sorted(rests, key=lambda r: (-r[1], r[0])):
        j = next((j for j, used in enumerate(bins) if used + tokens <= capacity), len(bins))
        if j == len(bins):
            bins.append(0)
        bins[j] += tokens
        out.append((k, j))
    return out


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id and offset for every piece; sequences are filled from offset 0 without gaps."""
    spark = cut_pieces.sparkSession
    p = stage(cut_pieces, "pieces")
    counts = p.groupBy("class", "task").agg(F.count("*").alias("n"))
    before = counts.select("class", "task", (F.sum("n").over(W.partitionBy("class").orderBy("task")) - F.col("n")).alias("before"))
    numbered = p.join(before, ["class", "task"]).withColumn("rank", F.col("before") + F.col("number")).drop("before", "number", "task")
    totals = {r["class"]: r.n for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()}  # one row a class
    full, base, at = {}, {}, 0
    for k in sorted(totals):
        full[k], base[k] = totals[k] // k, at
        at += full[k]
    schema = "class long, full long, base long"
    bins = spark.createDataFrame([(k, full[k], base[k]) for k in full], schema)  # a row a class: fewer than twice the root of the capacity, and one more for each cut
    classed = numbered.join(F.broadcast(bins), "class").withColumn("left", F.col("rank") >= F.col("full") * F.col("class"))
    rests = [(r["class"], r.tokens) for r in classed.where("left").groupBy("class").agg(F.sum("length").alias("tokens")).collect()]
    into = spark.createDataFrame([(k, at + j) for k, j in merge_rests(rests, capacity)], "class long, rest long")
    placed = classed.join(F.broadcast(into), "class", "left").withColumn(
        "sequence_id", F.when(F.col("left"), F.col("rest")).otherwise(F.col("base") + F.floor(F.col("rank") / F.col("class")))
    )
    order = W.partitionBy("sequence_id").orderBy("class", "rank")
    return placed.withColumn("offset", F.sum("length").over(order) - F.col("length")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "class"
    )


def packing(docs: DataFrame, tokenizer: str, kind: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    return pack(pieces(docs, tokenizer, kind, end_id, capacity), capacity)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = packing(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), "word", 1)
    return out.drop("class")
