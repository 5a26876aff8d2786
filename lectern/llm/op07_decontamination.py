"""Benchmark decontamination with an FM-index for each shard of the training documents.

A shard is a bounded number of whole documents that a task gathers while it streams through its rows. Over its word
sequence the task builds a suffix array, the Burrows-Wheeler transform, a wavelet matrix for ranks and a sample of
suffix positions. Every benchmark window is searched backwards, all windows at once, one word a step; occurrences
are located by walking to sampled positions, and the spans of each document are merged.

Words that no benchmark window has cannot be part of a match, so each stretch of them is one separator, as is each
document's end. Windows come to the tasks in blocks of at most BLOCK_WORDS words, the bound on what is sent to them:
a larger benchmark takes more passes, whose spans meet in one grouping by document.

Nulls: a null text has no words; a null item text has no windows; a null item_id counts as no item. Documents of
equal or null doc_id are each judged and returned. An empty table of documents gives no rows, an empty benchmark
finds nothing. Extra columns are not used, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small_batches, stage

WINDOW = 10
#: Words of a shard (a longer document is a shard of its own) and of the benchmark windows sent to the tasks at once.
SHARD_WORDS, BLOCK_WORDS = 200_000, 4_000_000
SAMPLE = 8
_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_KEEP).split()


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffixes of s (non-negative integers) in order, by prefix doubling over what is not yet decided; a suffix that
    ends sorts before its extensions."""
    n = len(s)
    rank = s.astype(np.int64) + 1
    sa = np.argsort(rank, kind="stable")
    key = rank[sa]
    first = np.append(True, key[1:] != key[:-1])
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank[sa] = start + 1
    h = 1
    # positions in sa of suffixes whose rank another one shares
    tied = np.flatnonzero(~(first & np.append(first[1:], True)))
    while len(tied):
        p = sa[tied]
        after = np.where(p + h < n, rank[np.minimum(p + h, n - 1)], 0)
        group = rank[p]
        order = np.lexsort((after, group))
        p, after, group = p[order], after[order], group[order]
        sa[tied] = p
        new = np.append(True, (group[1:] != group[:-1]) | (after[1:] != after[:-1]))
        rank[p] = np.maximum.accumulate(np.where(new, tied, 0)) + 1
        tied = tied[~(new & np.append(new[1:], True))]
        h *= 2
    return sa


class WaveletMatrix:
    """rank(c, i): how often c is among the first i symbols; all arguments are arrays."""

    def __init__(self, s: np.ndarray, top: int):
        self.levels, self.zeros = [], []
        for bit in range(max(1, int(top).bit_length()) - 1, -1, -1):
            b = ((s >> bit) & 1).astype(bool)
            self.levels.append((bit, np.append(np.int32(0), np.cumsum(b, dtype=np.int32))))
            self.zeros.append(int(len(b) - b.sum()))
            s = np.concatenate([s[~b], s[b]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        lo = np.zeros_like(i)
        for (bit, ones), zeros in zip(self.levels, self.zeros):
            one = ((c >> bit) & 1).astype(bool)
            l1, i1 = ones[lo], ones[i]
            lo, i = np.where(one, zeros + l1, lo - l1), np.where(one, zeros + i1, i - i1)
        return i - lo

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i and its rank before i."""
        c, lo = np.zeros_like(i), np.zeros_like(i)
        for (bit, ones), zeros in zip(self.levels, self.zeros):
            l1, i1 = ones[lo], ones[i]
            one = ones[i + 1] > i1
            lo, i = np.where(one, zeros + l1, lo - l1), np.where(one, zeros + i1, i - i1)
            c = (c << 1) | one
        return c, i - lo


class FMIndex:
    """Counts and locates patterns in a sequence of symbols; symbol 0 separates and is never searched."""

    def __init__(self, s: np.ndarray):
        n = len(s)
        sa = suffix_array(s)
        bwt = s[sa - 1]  # the first suffix is preceded by the last symbol, which is a separator
        top = int(s.max(initial=0))
        self.wave = WaveletMatrix(bwt, top)
        self.less = np.append(0, np.cumsum(np.bincount(s, minlength=top + 1)))
        self.n, self.top = n, top
        # positions that are multiples of SAMPLE or follow a separator, which no walk steps over
        self.sampled = (sa % SAMPLE == 0) | (bwt == 0)
        self.number = np.append(0, np.cumsum(self.sampled))
        self.samples = sa[self.sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of patterns, one a row, shorter ones led by -1."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[:, k]
            known = c <= self.top
            go = np.flatnonzero((c >= 0) & (lo < hi))
            lo[go[~known[go]]] = hi[go[~known[go]]] = 0
            go = go[known[go]]
            lo[go], hi[go] = self.less[c[go]] + self.wave.rank(c[go], lo[go]), self.less[c[go]] + self.wave.rank(c[go], hi[go])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes, by walking back to a sampled one."""
        out, steps, todo, at = np.zeros(len(rows), np.int64), 0, np.arange(len(rows)), rows.copy()
        while len(todo):
            hit = self.sampled[at]
            out[todo[hit]] = self.samples[self.number[at[hit]]] + steps
            todo, at = todo[~hit], at[~hit]
            c, r = self.wave.access_rank(at)
            at = self.less[c] + r
            steps += 1
        return out


class Phrases:
    """Windows of benchmark items: the vocabulary, distinct windows as rows of word numbers, and each one's items."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        at: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            w = [self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in words_of(text)]
            for k in range(max(len(w) - window, 0) + 1 if w else 0):
                at.setdefault(tuple(w[k : k + window]), set()).add(item)
        self.rows = np.full((len(at), window), -1, np.int64)
        for k, p in enumerate(at):
            self.rows[k, window - len(p) :] = p
        self.size = (self.rows >= 0).sum(1)
        self.items = [sorted(x) for x in at.values()]

    def spans(self, docs: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set[str]]]:
        """For each document of a shard: merged spans of hit words [from, to) and the items with occurring windows."""
        out = [([], set()) for _ in docs]
        get, parts, places, owners = self.vocabulary.get, [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.full(1, -1)]
        for d, words in enumerate(docs):
            s = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
            keep = np.flatnonzero((s > 0) | np.append(True, s[:-1] > 0))  # one separator for each stretch of other words
            parts += [s[keep], np.zeros(1, np.int64)]
            places += [keep, np.zeros(1, np.int64)]
            owners.append(np.full(len(keep) + 1, d))
        s, place, owner = np.concatenate(parts), np.concatenate(places), np.concatenate(owners)
        if not len(self.rows) or not s.any():
            return out
        index = FMIndex(s)
        lo, hi = index.search(self.rows)
        many = np.maximum(hi - lo, 0)
        which = np.repeat(np.arange(len(many)), many)
        rows = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + lo[which]
        at = index.locate(rows)
        begin, doc = place[at], owner[at]
        order = np.lexsort((begin, doc))
        for d, b, k in zip(doc[order].tolist(), begin[order].tolist(), which[order].tolist()):
            spans, items = out[d]
            e = b + int(self.size[k])
            if spans and b <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(e, spans[-1][1]))
            else:
                spans.append((b, e))
            items.update(self.items[k])
        return out


def shards(batches: Iterator[pa.RecordBatch], columns: list[str], limit: int) -> Iterator[tuple[list[pa.RecordBatch], list[list[bytes]]]]:
    """Rows (only these columns of them) and their words, by shards that end with the document that reaches the limit; a batch may have several shards."""
    held, words, size = [], [], 0
    for b in batches:
        begin, rows = 0, b.select(columns)
        for k, text in enumerate(b.column("text"), 1):
            words.append(words_of(text.as_py()))
            size += len(words[-1])
            if size >= limit:
                held.append(rows.slice(begin, k - begin))
                yield held, words
                held, words, size, begin = [], [], 0, k
        held.append(rows.slice(begin))
    if words:
        yield held, words


SPANS = "doc_id long, n_words long, begins array<long>, ends array<long>, items array<string>"


def _judge(docs: DataFrame, phrases: Phrases, keep: tuple[str, ...] = (), cut: bool = False) -> DataFrame:
    """Spans of every row, with the columns of keep beside them; with cut, a kept text comes without its hit words."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(c).alias(f"keep_{c}") for c in keep])
    kept = [f"keep_{c}" for c in keep]
    names, limit = [x.split()[0] for x in SPANS.split(", ")] + kept, SHARD_WORDS

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, words in shards(batches, ["doc_id", *kept], limit):
            found = phrases.spans(words)
            cols = [
                pa.array([len(w) for w in words], pa.int64()),
                pa.array([[a for a, _ in s] for s, _ in found], pa.list_(pa.int64())),
                pa.array([[b for _, b in s] for s, _ in found], pa.list_(pa.int64())),
                pa.array([sorted(i) for _, i in found], pa.list_(pa.string())),
            ]
            rows = pa.Table.from_batches(held).combine_chunks()
            table = pa.table([rows.column("doc_id"), *cols, *[rows.column(c) for c in kept]], names=names)
            if cut:
                texts = [t if t is None or not s else cut_spans(t, *zip(*s)) for t, (s, _) in zip(table["keep_text"].to_pylist(), found)]
                table = table.set_column(names.index("keep_text"), "keep_text", pa.array(texts, pa.string()))
            yield from table.to_batches(max_chunksize=1000)

    kinds = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in kept)
    out = docs.mapInArrow(work, SPANS + kinds)
    return out.select(*names[:5], *[F.col(f"keep_{c}").alias(c) for c in keep])


#: What separates words, as Spark reads it; and the words of a piece of an item.
NO_WORD = "[^0-9A-Za-z\\x{80}-\\x{10FFFF}]+"
PIECE = 4096


def _pieces(benchmark: DataFrame) -> DataFrame:
    """item_id and text of the items' distinct pieces: of PIECE words at most, each with the last words of the one before, so that every window is in
    one. An item that very many rows repeat is there once, and a very long one is dealt to several blocks."""
    named = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), F.filter(F.split("text", NO_WORD), lambda x: x != "").alias("w"))
    n = F.size("w")
    starts = F.when(n > PIECE, F.sequence(F.lit(0), n - WINDOW, F.lit(PIECE - WINDOW + 1))).otherwise(F.array(F.lit(0)))
    cut = named.where(n > 0).select("item_id", "w", F.explode(starts).alias("at"))
    return cut.select("item_id", F.array_join(F.slice("w", F.col("at") + 1, F.lit(PIECE)), " ").alias("text")).distinct()


def _blocks(pieces: DataFrame) -> int:
    """Passes needed so that the windows of one pass have at most BLOCK_WORDS words."""
    n = pieces.agg(F.sum(F.size(F.split("text", " ")))).first()[0] or 0
    return 1 + int(n) * WINDOW // BLOCK_WORDS


def hit_spans(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = (), cut: bool = False) -> DataFrame:
    """doc_id, n_words, begins, ends (merged spans of hit words) and items for every row, with the columns of keep; with
    cut, text (one of keep) comes without its hit words."""
    items = _pieces(benchmark)
    n = _blocks(items)
    part = lambda k: [(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()]
    if n == 1:
        return _judge(docs, Phrases(part(0)), keep, cut)
    # more passes: rows keep their identity by a number that is written once
    kept = stage(docs.select("doc_id", "text", *[c for c in keep if c != "text"]).withColumn("row", F.monotonically_increasing_id()), "decontamination-rows")
    found = None
    for k in range(n):
        spans = stage(_judge(kept.select(F.col("row").alias("doc_id"), "text"), Phrases(part(k))), "decontamination-spans")
        found = spans if found is None else found.unionByName(spans)
    merged = found.groupBy(F.col("doc_id").alias("row")).agg(
        F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list(F.arrays_zip("begins", "ends")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    # spans in order; one that begins within what is covered so far makes the last one longer
    empty = F.lit(None).cast("array<struct<begins:bigint,ends:bigint>>")
    join = F.aggregate(
        "spans",
        F.coalesce(empty, F.array().cast("array<struct<begins:bigint,ends:bigint>>")),
        lambda a, s: F.when(
            (F.size(a) > 0) & (s["begins"] <= F.element_at(a, -1)["ends"]),
            F.concat(
                F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))),
                F.array(F.struct(F.element_at(a, -1)["begins"].alias("begins"), F.greatest(F.element_at(a, -1)["ends"], s["ends"]).alias("ends"))),
            ),
        ).otherwise(F.concat(a, F.array(F.struct(s["begins"].alias("begins"), s["ends"].alias("ends"))))),
    )
    out = merged.withColumn("spans", join).join(kept, "row")
    names = [F.col("doc_id").cast("long").alias("doc_id"), "n_words", F.col("spans.begins").alias("begins"), F.col("spans.ends").alias("ends"), "items"]
    if not cut:
        return out.select(*names, *keep)

    @F.pandas_udf("string")
    def cleaned(text: pd.Series, begins: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or not len(b) else cut_spans(t, list(b), list(e)) for t, b, e in zip(text, begins, ends)], dtype=object)

    left = cleaned("text", F.col("spans.begins"), F.col("spans.ends")).alias("text")
    return out.select(*names, *[left if c == "text" else c for c in keep])


def cut_spans(text: str, begins: tuple[int, ...] | list[int], ends: tuple[int, ...] | list[int]) -> str:
    """The text without its hit words; what stands between two kept words stays."""
    b = text.encode("utf-8", "replace")
    out, done = [], 0
    places = [m.span() for m in re.finditer(rb"[^ ]+", b.translate(_KEEP))]
    for s, e in zip(begins, ends):
        out.append(b[done : places[s][0]])
        done = places[e - 1][1]
    out.append(b[done:])
    return b"".join(out).decode("utf-8", "replace")


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items and text with the hit spans cut out, for every row, with the columns of keep."""
    spans = hit_spans(docs, benchmark, ("text", *keep), cut=True)
    return spans.select("doc_id", "n_words", _hits().alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "text", *keep)


def _hits():
    return F.aggregate(F.zip_with("begins", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = hit_spans(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return spans.select(
        "doc_id",
        "n_words",
        _hits().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (_hits() > 0).alias("contaminated"),
    )


ORACLE = """
WITH fold AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
item AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark),
iw AS (SELECT item, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS st FROM item WHERE len(words) > 0),
win AS (SELECT DISTINCT item, array_to_string(words[st:st + 9], ' ') AS w, least(len(words), 10) AS n FROM iw),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS st FROM fold, sizes WHERE len(words) >= n),
hit AS (SELECT doc_id, st, dw.n AS n, item FROM dw JOIN win ON array_to_string(words[st:st + dw.n - 1], ' ') = w AND dw.n = win.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(st, st + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT fold.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM fold LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
