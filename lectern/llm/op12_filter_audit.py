"""Audit of how five filters interact: what each removes in every order, and its fair share of all removals.

A coalition is a set of filters; it removes the documents that fail any of them. Documents are counted once by
(part, pattern of failed filters); the removals of all 32 coalitions are sums of these counts. The filters' Shapley
values are the additive model of the coalitions' removals that is best by least squares with the Shapley kernel's weights, under the
constraint that its values sum to what all filters remove: the normal equations with one multiplier are solved in
rationals, so the values are exact. What a step of an order removes is the difference of two coalitions.

Whether an earlier document has the same text is settled without bringing the copies of a text together: a text's rows
are first summed by (id, part, pattern, labels), then without the id, where the smallest id and its count are kept, and only such sums
meet on the text's SHA-256. Parts are solved independently, each from 32 rows.

Nulls: a null text is empty, a null lang is the part ''. Rows with a null doc_id are counted, but have no smaller id and are none
for others. Rows that repeat an id are all counted; equal texts of one id do not fail for each other. Of several labels of one
document any 1 counts. Empty tables give no rows. Other columns are not used, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import lru_cache
from itertools import permutations
from math import comb, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read, small_batches

UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SIGNS = re.compile(rb"[#$%&*|]")
#: Filters that look at one text (UTF-8 bytes, its words, its number of code points); true if it fails.
TEXT_FILTERS: dict[str, Callable[[bytes, list[bytes], int], bool]] = {
    "A": lambda b, words, chars: len(words) < 100,
    "B": lambda b, words, chars: 100 * len(set(words)) < 80 * len(words),
    "C": lambda b, words, chars: 100 * (len(b) - len(b.translate(None, UPPER))) > 10 * chars,
    "D": lambda b, words, chars: _SIGNS.search(b) is not None,
}
#: The filter that looks at the whole table: the text of a document of smaller id is the same.
COPY = "E"
FILTERS = "".join(TEXT_FILTERS) + COPY
N = len(FILTERS)


def failed(text: str | None) -> tuple[bytes, int]:
    """SHA-256 of a text and the bits of the text filters that it fails."""
    b = (text or "").encode("utf-8", "replace")
    words = b.split()  # at the six ASCII white spaces
    return hashlib.sha256(b).digest(), sum(f(b, words, len(text or "")) << k for k, f in enumerate(TEXT_FILTERS.values()))


def patterns(docs: DataFrame) -> DataFrame:
    """doc_id, part, h (the text's hash), and mask (text filters only) of every row."""
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [failed(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([h for h, _ in rows], pa.binary()), pa.array([m for _, m in rows], pa.int32())], names=["doc_id", "part", "h", "mask"]
            )

    source = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), "text")
    return source.mapInArrow(work, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, part string, h binary, mask int")


def tabulated(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (all filters), n, good and toxic: documents by the exact set of filters that they fail."""
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad"))
    rows = patterns(docs).groupBy("doc_id", "part", "h", "mask").agg(F.count("*").alias("c"))
    # rows without an id are dealt by their text and meet no label
    rows = rows.withColumns({"key": F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("h")), "known": F.col("doc_id").isNotNull()})
    seen = rows.join(marks.select(F.col("doc_id").cast("long").alias("key"), F.lit(True).alias("known"), "good", "bad"), ["key", "known"], "left")
    seen = seen.withColumns({"good": F.coalesce("good", F.lit(0)), "bad": F.coalesce("bad", F.lit(0))})
    named = F.col("doc_id").isNotNull()
    sums = seen.groupBy("h", "part", "mask", "good", "bad").agg(
        F.sum("c").alias("n"), F.sum(F.when(~named, F.col("c"))).alias("nameless"), F.min(F.when(named, F.struct("doc_id", "c"))).alias("low")
    )
    first = sums.withColumn("first", F.min("low.doc_id").over(W.partitionBy("h")))
    stays = F.coalesce("nameless", F.lit(0)) + F.when(F.col("low.doc_id") == F.col("first"), F.col("low.c")).otherwise(0)
    split = first.withColumn("each", F.array(F.struct(F.col("mask").alias("mask"), stays.alias("n")), F.struct((F.col("mask") + (1 << (N - 1))).alias("mask"), (F.col("n") - stays).alias("n"))))
    each = split.select("part", "good", "bad", F.inline("each"))
    return each.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("bad")).alias("toxic"))


@lru_cache(maxsize=None)
def normal_equations(n: int = N) -> list[list[Fraction]]:
    """Inverse of the bordered normal matrix: sum over coalitions of w(s) 1_S 1_S', with the row and column of the constraint."""
    weight = {s: Fraction(n - 1, comb(n, s) * s * (n - s)) for s in range(1, n)}
    m = [[Fraction(0)] * (n + 1) for _ in range(n + 1)]
    for coalition in range(1, 2**n - 1):
        inside = [i for i in range(n) if coalition >> i & 1]
        for i in inside:
            for j in inside:
                m[i][j] += weight[len(inside)]
    for i in range(n):
        m[i][n] = m[n][i] = Fraction(1)
    rows = [m[i] + [Fraction(int(i == j)) for j in range(n + 1)] for i in range(n + 1)]
    for c in range(n + 1):
        pivot = next(r for r in range(c, n + 1) if rows[r][c])
        rows[c], rows[pivot] = rows[pivot], [x / rows[pivot][c] for x in rows[pivot]]
        for r in range(n + 1):
            if r != c and rows[r][c]:
                rows[r] = [x - rows[r][c] * y for x, y in zip(rows[r], rows[c])]
    return [r[n + 1 :] for r in rows]


def shapley(removed: list[int], n: int = N) -> list[Fraction]:
    """Shapley values of a game given by what each of its 2**n coalitions removes, by constrained least squares."""
    right = [Fraction(0)] * n + [Fraction(removed[-1] - removed[0])]
    for coalition in range(1, 2**n - 1):
        size = coalition.bit_count()
        w = Fraction(n - 1, comb(n, size) * size * (n - size)) * (removed[coalition] - removed[0])
        for i in range(n):
            if coalition >> i & 1:
                right[i] += w
    return [sum(a * b for a, b in zip(row, right)) for row in normal_equations(n)[:n]]


def coalitions(counts: np.ndarray) -> list[int]:
    """What each coalition removes, from counts by exact pattern."""
    total = int(counts.sum())
    kept = counts.astype(object).copy()
    for k in range(N):  # sums over subsets
        for mask in range(2**N):
            if mask >> k & 1:
                kept[mask] += kept[mask ^ (1 << k)]
    return [total - int(kept[(2**N - 1) ^ mask]) for mask in range(2**N)]


def audited(n: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> list[tuple]:
    """filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for every order and step."""
    gone, gone_good, gone_toxic = coalitions(n), coalitions(good), coalitions(toxic)
    total, every = int(n.sum()), 2**N - 1
    share = [int(v * factorial(N)) for v in shapley(gone)]
    out = []
    for order in permutations(range(N)):
        name, before = "".join(FILTERS[k] for k in order), 0
        for step, k in enumerate(order, 1):
            after = before | 1 << k
            removed = gone[after] - gone[before]
            out.append((
                name, step, total - gone[after], removed, gone[1 << k] - removed, gone[every] - gone[every ^ 1 << k],
                gone_good[after] - gone_good[before], gone_toxic[after] - gone_toxic[before], share[k],
            ))
            before = after
    return out


COLUMNS = ["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
KINDS = [pa.string(), pa.int32()] + [pa.int64()] * 7


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step."""
    one = F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic"))))  # at most 32 entries
    tables = tabulated(docs, labels).groupBy("part").agg(one.alias("m"))
    tables = tables.select("part", F.transform(F.sequence(F.lit(0), F.lit(2**N - 1)), lambda k: F.try_element_at("m", k)).alias("t"))
    field = lambda name: F.transform("t", lambda x: F.coalesce(x[name], F.lit(0).cast("long"))).alias(name)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, *counts in zip(*(c.to_pylist() for c in b.columns)):
                cols = list(zip(*audited(*(np.array(c, np.int64) for c in counts))))
                arrays = [pa.array([part] * len(cols[0]), pa.string()), *(pa.array(c, t) for c, t in zip(cols, KINDS))]
                yield pa.RecordBatch.from_arrays(arrays, names=["part", *COLUMNS])

    return tables.select("part", field("n"), field("good"), field("toxic")).mapInArrow(
        work, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


ORACLE = """
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS g, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS b FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(g, 0) AS g, coalesce(b, 0) AS b, CASE WHEN len(words) < 100 THEN 1 ELSE 0 END
  + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
  + CASE WHEN 100 * (length(x) - length(regexp_replace(x, '[A-Z]', '', 'g'))) > 10 * length(x) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN t.doc_id > min(t.doc_id) OVER (PARTITION BY x) THEN 16 ELSE 0 END AS mask FROM t LEFT JOIN l ON l.doc_id = t.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(g) AS g, sum(b) AS b FROM f GROUP BY part, mask),
z AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(k, bit)),
o AS (SELECT concat(p.k, q.k, r.k, s.k, u.k) AS filter_order, [p.bit, q.bit, r.bit, s.bit, u.bit] AS bits FROM z p, z q, z r, z s, z u WHERE p.bit + q.bit + r.bit + s.bit + u.bit = 31 AND p.bit | q.bit | r.bit | s.bit | u.bit = 31),
y AS (SELECT filter_order, step, bits[step] AS bit, CAST(list_sum(list_concat([0], bits[1:step - 1])) AS BIGINT) AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
a AS (SELECT part, filter_order, step, bit,
  sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN g ELSE 0 END) AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN b ELSE 0 END) AS toxic_lost
  FROM c, y GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM a
"""
