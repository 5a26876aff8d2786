"""Incremental substring removal with a log-structured index of window fingerprints.

A window is 13 consecutive words. Its fingerprint is the smallest hash among its runs of five words, so windows
that are equal have equal fingerprints, and neighbouring windows mostly share one: the index has about a fifth as many rows
as there are windows. The index is a list of immutable runs, one for each batch of documents: bucketed and
sorted by fingerprint, all with the same buckets, so that a new run meets the older ones in merge joins without
moving them. Before a batch, several runs are compacted into one, with which it is joined then; runs that it
replaces are dropped. An index that is kept goes on in later calls: their documents lose what documents of earlier calls hold. Of
those, only the ones that share a fingerprint with the new batch are read again, from where they came. A fingerprint that very many documents share weighs two rows for each batch of a task: documents
beyond the second are known to share it and are dealt by their own hash.

A matching fingerprint only makes candidates: windows under matching fingerprints, of old and new documents
alike, are then compared by 96 bits of hash over the whole window, and a word is removed if a window over it also
starts in a document of smaller doc_id. Of exact copies only the first is compared; the others lose all words that any
window covers. Windows that meet in one task are settled there before anything is moved, and a document that repeats a
window sends it once, with all its places; so a window that very many documents share weighs about a row for each task.

Nulls: a null text has no words. Rows with a null doc_id stay as they are and remove nothing elsewhere. Rows of
equal doc_id do not remove each other's words; they are told apart by 31 bits of the text's hash. A doc_id that is
no integer counts as null. Texts of fewer than 13 words have no window. An empty table gives
no rows. Extra columns are not used, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read, shared_path, small_batches, spent_shuffles_go, stage

WINDOW, GRAM = 13, 5
#: Runs that a batch is joined with; more are compacted first.
MAX_RUNS = 1
#: Shared windows that a task remembers; beyond them windows are settled after the exchange.
KNOWN = 400_000
#: Places where the copies of one text are dealt to.
SALTS = 32
#: The bits of a text's hash that tell rows of one doc_id apart.
TAG = 0x7FFFFFFF
#: The bit of a key that no fingerprint has.
SETTLED = np.uint64(1 << 61)
#: Fixed odd multipliers and a mixing constant for combining the hashes of words.
M1, M2, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9)


def word_hashes(text: str | None) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    words = (text or "").encode("utf-8", "replace").split()
    return np.fromiter((digest(w) for w in words), np.uint64, len(words))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX
    return h ^ (h >> np.uint64(31))


def runs_of(x: np.ndarray, size: int, by: np.uint64) -> np.ndarray:
    """A hash of every run of size consecutive elements."""
    n = len(x) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(size):
        h = h * by + x[j : n + j]
    return _mixed(h)


def window_prints(x: np.ndarray) -> np.ndarray:
    """The fingerprint of each window."""
    g = runs_of(x, GRAM, M1)
    n, k = len(x) - WINDOW + 1, WINDOW - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    low = g[:n].copy()
    for j in range(1, k):
        np.minimum(low, g[j : n + j], out=low)
    return low


def _id(docs: DataFrame) -> Column:
    """doc_id as a long; the bare column where it is one, so that Spark sees equal exchanges as equal and reuses them."""
    return F.col("doc_id") if dict(docs.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("long").alias("doc_id")


def keyed(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, tag (31 bits of the text's hash, so that rows of one doc_id stay apart), text and the columns of keep,
    without rows of null doc_id."""
    more = [F.col(c).alias(f"keep_{c}") for c in keep]
    return _named(docs).select(_id(docs), F.xxhash64("text").bitwiseAND(F.lit(TAG)).cast("int").alias("tag"), "text", *more)


def _named(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").cast("long").isNotNull())


def first_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, tag) of the row of smallest doc_id for each text."""
    return _named(docs).select(_id(docs), F.xxhash64("text").alias("a"), F.xxhash64(F.lit(7), "text").alias("b")).groupBy("a", "b").agg(
        F.min("doc_id").alias("doc_id")
    ).select("doc_id", F.col("a").bitwiseAND(F.lit(TAG)).cast("int").alias("tag"), "a", "b")


def prints(docs: DataFrame) -> DataFrame:
    """(k, h, doc_id): the distinct fingerprints of each text, 48 bits each; of copies that meet in one task only the
    smallest doc_id's, where it comes first. Rows are dealt by k: the fingerprint itself, or a hash of the document
    for one that two documents of the batch have before."""
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for b in batches:
            hs, ds = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                copy = xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "replace"))
                if seen.get(copy, doc_id + 1) <= doc_id:
                    continue
                seen[copy] = doc_id
                h = np.unique(window_prints(word_hashes(text)) >> np.uint64(16))
                hs.append(h)
                ds.append(np.full(len(h), doc_id, np.int64))
            if len(seen) > 200_000:
                seen.clear()
            h, doc = np.concatenate(hs), np.concatenate(ds)
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))[: len(h)]
            h, doc = h[new], doc[new]
            third = np.zeros(len(h), bool)
            third[2:] = h[2:] == h[:-2]
            k = np.where(third, _mixed(doc.view(np.uint64)) >> np.uint64(2) | SETTLED, h)
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(h.view(np.int64)), pa.array(doc)], names=["k", "h", "doc_id"])

    return keyed(docs).select("doc_id", "text").mapInArrow(work, "k long, h long, doc_id long")


@dataclass
class FingerprintIndex:
    """Runs are tables (k, h, doc_id) over files in the shared folder, bucketed and sorted by k; runs: their names and folders;
    texts: the documents (doc_id, text) of earlier calls, which must stay readable."""

    spark: SparkSession
    buckets: int = 0
    runs: dict[str, str] = field(default_factory=dict)
    texts: list[DataFrame] = field(default_factory=list)

    def __post_init__(self):
        self.buckets = self.buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, rows: DataFrame) -> str:
        name, path = f"window_run_{uuid.uuid4().hex}", shared_path(self.spark, "window-run")
        with spent_shuffles_go(self.spark):
            (
                rows.repartition(self.buckets, "k").sortWithinPartitions("k", "doc_id")
                .write.bucketBy(self.buckets, "k").sortBy("k").option("path", path).option("compression", "zstd")
                .saveAsTable(name)
            )
        self.runs[name] = path
        return name

    def add(self, batch: DataFrame) -> DataFrame:
        """Append a run for the batch; returns (h, doc_id) of all that its fingerprints share, old and new, written down."""
        older = [self.spark.table(r) for r in self.runs]
        new = self.spark.table(self._write(prints(batch)))
        shared = new.where("k = h").groupBy("k").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x <> y").select("k")
        out = new.where("k <> h").select("h", "doc_id").union(new.join(shared, "k", "left_semi").select("h", "doc_id"))
        for old in older:
            out = out.union(new.join(old, "k", "left_semi").select("h", "doc_id")).union(old.join(new, "k", "left_semi").select("h", "doc_id"))
        return stage(out, "shared-prints")

    def compact(self, force: bool = False) -> None:
        """Merge all runs into one where there are more than MAX_RUNS, and drop the old ones."""
        if len(self.runs) > MAX_RUNS or force and len(self.runs) > 1:
            old = list(self.runs)
            rows = self.spark.table(old[0])
            for r in old[1:]:
                rows = rows.union(self.spark.table(r))
            self._write(rows)
            self.drop(old)

    def sharing(self, candidates: DataFrame) -> DataFrame | None:
        """The documents of earlier calls that share a fingerprint with the candidates."""
        if not self.texts:
            return None
        rows = self.texts[0]
        for t in self.texts[1:]:
            rows = rows.unionByName(t)
        return stage(rows.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi"), "earlier-texts")

    def drop(self, names: list[str] | None = None) -> None:
        """Remove runs (all of them, if none are named) from the catalog and from the shared folder."""
        for name in list(self.runs) if names is None else names:
            self.spark.sql(f"DROP TABLE {name}")
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.runs.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def matching_windows(docs: DataFrame, candidates: DataFrame, first: DataFrame) -> DataFrame:
    """(w1, w2, doc_id, tag, at, more, hit) of the windows under candidate fingerprints, of first copies only; at is a
    window's first place in its document, more the others.

    Windows that meet in one task are settled there: of a batch only the smallest document's go on to be compared, and
    windows that were shared in a batch are remembered for the next ones. The others leave with hit set and a key of
    their own.
    """
    lists = candidates.groupBy("doc_id").agg(F.collect_set("h").alias("hs")).join(first.select("doc_id", "tag"), "doc_id")
    risky = keyed(docs).join(lists, ["doc_id", "tag"])
    names = ["w1", "w2", "doc_id", "tag", "at", "more", "hit"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known1, known2, known_doc = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64)
        for b in batches:
            found = [[np.zeros(0, t) for t in (np.uint64, np.int32, np.int64, np.int32, np.int32)]]
            for doc_id, tag, text, hs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                x = word_hashes(text)
                at = np.flatnonzero(np.isin(window_prints(x) >> np.uint64(16), hs.values.to_numpy().view(np.uint64)))
                w2 = (runs_of(_mixed(x), WINDOW, M2)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                found.append([runs_of(x, WINDOW, M1)[at], w2, np.full(len(at), doc_id), np.full(len(at), tag, np.int32), at.astype(np.int32)])
            w1, w2, doc, tag, at = (np.concatenate(c) for c in zip(*found))
            order = np.lexsort((at, tag, doc, w2, w1))
            w1, w2, doc, tag, at = (c[order] for c in (w1, w2, doc, tag, at))
            n = len(w1)
            if not n:
                continue
            window = np.append(True, (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1]))
            own = window | np.append(True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]))  # the first place in its document
            begin = np.flatnonzero(window)
            low, known = doc[begin], np.zeros(len(begin), bool)
            if len(known1):  # a smaller document of this task may have had the window
                near = np.minimum(np.searchsorted(known1, w1[begin]), len(known1) - 1)
                known = (known1[near] == w1[begin]) & (known2[near] == w2[begin])
                low = np.where(known, np.minimum(low, known_doc[near]), low)
            low = np.repeat(low, np.diff(np.append(begin, n)))
            hit = doc > low
            if len(known1) < KNOWN:
                fresh = begin[np.logical_or.reduceat(hit, begin) & ~known]
                known1, i = np.unique(np.append(known1, w1[fresh]), return_index=True)
                known2, known_doc = np.append(known2, w2[fresh])[i], np.append(known_doc, low[fresh])[i]
            w1, w2 = np.where(hit, doc.view(np.uint64), w1), np.where(hit, at, w2)  # what is settled is dealt by document
            rows = np.flatnonzero(own)
            size = np.diff(np.append(rows, n))
            rest = at[~own]
            bounds = np.append(0, np.cumsum(size - 1)).astype(np.int32)
            back = np.lexsort((at[rows], tag[rows], doc[rows]))  # by document again, so that equal bytes are neighbours
            more = pa.ListArray.from_arrays(pa.array(bounds), pa.array(rest)).take(pa.array(back))
            more = pc.if_else(pa.array(size[back] > 1), more, pa.scalar(None, more.type))
            rows = rows[back]
            cols = [pa.array(c[rows]) for c in (w1.view(np.int64), w2.astype(np.int32), doc, tag, at)] + [more, pa.array(hit[rows])]
            for k in range(0, len(rows), 200_000):
                yield pa.RecordBatch.from_arrays([c.slice(k, 200_000) for c in cols], names=names)

    return risky.select("doc_id", "tag", "text", "hs").mapInArrow(work, "w1 long, w2 int, doc_id long, tag int, at int, more array<int>, hit boolean")


WORD = re.compile(rb"[^ \t\n\x0b\x0c\r]+")


def keep_words(text: str | None, at: list[int], is_copy: bool) -> tuple[int, int, str, str | None]:
    """Words, removed words, sha256 of the kept words, and the text without the removed words (spaces between kept ones as they were)."""
    b = (text or "").encode("utf-8", "replace")
    words = b.split()
    n = len(words)
    if is_copy and n >= WINDOW:
        return n, n, hashlib.sha256(b"").hexdigest(), ""
    if not at:
        return n, 0, hashlib.sha256(b" ".join(words)).hexdigest(), text
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, np.array(at) + WINDOW, -1)
    gone = np.cumsum(change)[:n] > 0
    kept = [w for w, g in zip(words, gone) if not g]
    out, done = [], 0
    places = [m.span() for m in WORD.finditer(b)]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
        out.append(b[done : places[s][0]])
        done = places[e - 1][1]
    out.append(b[done:])
    return n, int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest(), b"".join(out).decode("utf-8", "replace")


def removed(docs: DataFrame, candidates: DataFrame, with_text: bool = False, keep: tuple[str, ...] = (), earlier: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, the text that is left, for every row of docs, with the columns of keep.
    Documents of earlier (doc_id, text) remove words of docs, and nothing is said about them."""
    small_batches(docs.sparkSession)
    every = docs if earlier is None else docs.select(_id(docs), "text").unionByName(earlier)
    first = first_copies(every)
    windows = matching_windows(every, candidates, first)
    so_far = W.partitionBy("w1", "w2").orderBy("doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)  # streams, holds no group
    hits = windows.withColumn("lo", F.min("doc_id").over(so_far)).where("hit or doc_id > lo").select("doc_id", "tag", "at", "more").repartition("doc_id", "tag")
    per_doc = hits.groupBy("doc_id", "tag").agg(F.concat(F.collect_list("at"), F.flatten(F.collect_list("more"))).alias("at"))
    rows = _named(every).select(_id(every), F.xxhash64("text").alias("a"), F.xxhash64(F.lit(7), "text").alias("b"))
    # a text that very many rows have is met by its copies in SALTS places
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    copied = rows.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    copied = copied.select("a", "b", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    copies = salted.join(copied, ["a", "b", "salt"]).where("doc_id > first").select("doc_id", F.col("a").bitwiseAND(F.lit(TAG)).cast("int").alias("tag")).distinct()
    marks = per_doc.select("doc_id", "tag", "at", F.lit(False).alias("is_copy")).union(copies.select("doc_id", "tag", F.lit(None).cast("array<int>").alias("at"), F.lit(True).alias("is_copy")))
    kept = [f"keep_{c}" for c in keep]
    marked = keyed(docs, keep).join(marks, ["doc_id", "tag"], "left").select("doc_id", "text", "at", "is_copy", *kept)
    none = [F.lit(None).cast("array<int>").alias("at"), F.lit(None).cast("boolean").alias("is_copy")]
    rest = docs.where(F.col("doc_id").cast("long").isNull()).select(_id(docs), "text", *none, *[F.col(c).alias(f"keep_{c}") for c in keep])
    kinds = "".join(f", {c} {marked.schema[c].dataType.simpleString()}" for c in kept)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [keep_words(t, a or [], bool(c)) for t, a, c in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)))]
            cols = list(zip(*rows)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            out = [pa.array(c if k < 3 or with_text else [None] * len(c), t) for k, (c, t) in enumerate(zip(cols, kinds))]
            yield pa.RecordBatch.from_arrays([b.column(0), *out, *b.columns[4:]], names=["doc_id", "n_words", "n_removed", "kept_sha256", "text", *kept])

    done = marked.union(rest).mapInArrow(work, "doc_id long, n_words long, n_removed long, kept_sha256 string, text string" + kinds)
    return done.select("doc_id", "n_words", "n_removed", "kept_sha256", *(["text"] if with_text else []), *[F.col(f"keep_{c}").alias(c) for c in keep])


def substring_dedup(docs: DataFrame, batches: int = 3, with_text: bool = False, keep: tuple[str, ...] = (), index: FingerprintIndex | None = None) -> DataFrame:
    """Feed the documents to an index in batches of ascending doc_id, each joined with what is there before it, then decide on all of
    them. The index is a new one that is dropped in the end, unless the caller gives one: then what it holds removes words as well, and it holds these documents
    afterwards. Documents of earlier calls are not judged again."""
    cuts = _named(docs).agg(F.percentile_approx(F.col("doc_id").cast("long"), [k / batches for k in range(1, batches)])).first()[0] if batches > 1 else []
    runs, candidates, low, number = index or FingerprintIndex(docs.sparkSession), None, None, F.col("doc_id").cast("long")
    try:
        for cut in [*sorted(set(cuts or [])), None]:
            part = docs.where((F.lit(True) if low is None else number > low) & (F.lit(True) if cut is None else number <= cut))
            runs.compact()
            found = runs.add(part)
            candidates = found if candidates is None else candidates.union(found)
            low = cut
        earlier = runs.sharing(candidates)
        runs.texts.append(_named(docs).select(_id(docs), "text"))
    finally:
        if index is None:
            runs.drop()
    return removed(docs, candidates, with_text, keep, earlier)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read(spark, sf_dir, "documents"))


ORACLE = """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS st FROM w WHERE len(words) >= 13),
k AS (SELECT doc_id, st, array_to_string(words[st:st + 12], ' ') AS win FROM p),
m AS (SELECT doc_id, st, min(doc_id) OVER (PARTITION BY win) AS lo FROM k),
h AS (SELECT DISTINCT doc_id, unnest(range(st, st + 13)) AS pos FROM m WHERE doc_id > lo),
g AS (SELECT doc_id, list(pos) AS gone FROM h GROUP BY doc_id),
a AS (SELECT w.doc_id, words, coalesce(gone, []) AS gone FROM w LEFT JOIN g USING (doc_id))
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_filter(words, lambda x, i: NOT list_contains(gone, i)), ' ')) AS kept_sha256 FROM a
"""
