"""Reversible line deduplication: sharded cuckoo filters in front of exact reference-count tables.

A line's key is the line without ASCII white space at its ends, in lower case (A-Z); keys of ten or more code points count.
The index holds, as immutable runs in the shared folder,
* references: (key, document, +1 or -1), one for each document that holds the key, written by insertions and deletions;
* counts: (key, references, smallest and largest holder, version); the row of highest version is in force;
* filters: one cuckoo filter for each shard of the keys with a count above zero.

An inserted batch sums its own references by key. Keys that their shard's filter does not know are new: their sums stand as
they are, and the filter learns them. Only keys that it may know meet the count tables of earlier batches; where those have
them, the sums are merged, and where they have not, it was a false alarm and the filter learns them as well. A deletion
writes negative references for all that its documents hold, takes the smallest and largest holders anew from the
references that are left, and removes keys without any from the filters, so that the index is as if the documents had never come.

A document loses a line if the line's key has a smaller holder in force. Shards hold SHARD_KEYS keys on average, so a filter and
the keys of a batch that meet it are small; the filters are built anew for more shards when keys outgrow them. A key that
very many documents hold is one row of the counts; its references meet it in a broadcast of the keys with more than a thousandth
of all references, of which there can be a thousand at most.

Nulls: a null or empty text is one empty line. Rows with a null doc_id (or one that is no integer) keep all lines and hold none for others. Rows
of one doc_id are one document: each loses what a smaller id holds, none what another of them holds. Empty tables give no rows.
Keys are told apart by 128 bits of hash. Other columns are not used, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small_batches, stage

MIN_CHARS, SPACES = 10, " \t\n\x0b\x0c\r"
#: A filter: buckets of four 16-bit fingerprints; and the keys of a shard on average, at most.
BUCKETS, SLOTS = 2**14, 4
SHARD_KEYS = int(0.65 * BUCKETS * SLOTS)
#: Rounds of moving fingerprints before a filter counts as overfull.
ROUNDS = 2000
#: A key with more than this part of all references is met by broadcast.
HEAVY = 1000


def line_keys(text: str | None) -> list[int | None]:
    """For each line of a text its key as a 128-bit hash, None for short ones."""
    out: list[int | None] = []
    for line in (text or "").split("\n"):
        key = line.strip(SPACES)
        out.append(xxhash.xxh3_128_intdigest(key.encode("utf-8", "replace").lower()) if len(key) >= MIN_CHARS else None)
    return out


def _halves(keys: list[int]) -> tuple[pa.Array, pa.Array]:
    part = lambda shift: pa.array(np.array([k >> shift & 0xFFFFFFFFFFFFFFFF for k in keys], np.uint64).view(np.int64))
    return part(64), part(0)


class CuckooFilter:
    """A set of 64-bit hashes, kept as fingerprints; all methods work on whole arrays."""

    def __init__(self, stored: bytes | None = None):
        self.table = np.frombuffer(stored, "<u2").reshape(-1, SLOTS).copy() if stored else np.zeros((BUCKETS, SLOTS), np.uint16)

    def stored(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    def _other(self, bucket: np.ndarray, print_: np.ndarray) -> np.ndarray:
        mixed = print_.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
        return bucket ^ (mixed.astype(np.int64) & (len(self.table) - 1))

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = hashes.view(np.uint64)
        print_ = np.maximum(h & np.uint64(0xFFFF), np.uint64(1)).astype(np.uint16)
        bucket = (h >> np.uint64(16)).astype(np.int64) & (len(self.table) - 1)
        return print_, bucket, self._other(bucket, print_)

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        print_, a, b = self._places(hashes)
        return ((self.table[a] == print_[:, None]) | (self.table[b] == print_[:, None])).any(axis=1)

    def add(self, hashes: np.ndarray) -> None:
        """All at once: what finds its bucket full tries its other one, then changes places with what is there."""
        print_, bucket, _ = self._places(hashes)
        moved = np.zeros(len(print_), bool)
        for turn in range(ROUNDS):
            if not len(print_):
                return
            order = np.argsort(bucket, kind="stable")
            print_, bucket, moved = print_[order], bucket[order], moved[order]
            first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            rank = np.arange(len(bucket)) - np.repeat(first, np.diff(np.append(first, len(bucket))))
            used = self.table[bucket] != 0
            free = SLOTS - used.sum(axis=1)
            fits = rank < free
            slot = np.argsort(used[fits], axis=1, kind="stable")[np.arange(int(fits.sum())), rank[fits]]
            self.table[bucket[fits], slot] = print_[fits]
            swap = ~fits & moved & (rank == free)  # one of each bucket
            at = (bucket[swap], np.full(int(swap.sum()), turn % SLOTS))
            print_[swap], self.table[at] = self.table[at], print_[swap]
            left = ~fits
            print_, bucket, moved = print_[left], self._other(bucket, print_)[left], np.ones(int(left.sum()), bool)
        raise RuntimeError("a cuckoo filter is overfull")

    def remove(self, hashes: np.ndarray) -> None:
        """Hashes must have been added; one fingerprint goes for each."""
        print_, a, b = self._places(hashes)
        while len(print_):
            pair = np.minimum(a, b) << 16 | print_
            _, one = np.unique(pair, return_index=True)  # equal fingerprints of a pair of buckets go one after another
            left = one
            for bucket in (a, b):
                found = self.table[bucket[left]] == print_[left][:, None]
                hit = found.any(axis=1)
                self.table[bucket[left][hit], found[hit].argmax(axis=1)] = 0
                left = left[~hit]
            if len(left):
                raise KeyError("a hash that the filter does not hold")
            rest = np.setdiff1d(np.arange(len(pair)), one)
            print_, a, b = print_[rest], a[rest], b[rest]


def references(docs: DataFrame) -> DataFrame:
    """(k, k2, doc_id, refs): each distinct key of every row of docs with 1."""
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, sizes = [], []
            for text in b.column(1).to_pylist():
                own = set(line_keys(text)) - {None}
                keys += own
                sizes.append(len(own))
            k, k2 = _halves(keys)
            doc = pa.array(np.repeat(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), sizes))
            yield pa.RecordBatch.from_arrays([k, k2, doc, pa.array(np.ones(len(keys), np.int64))], names=["k", "k2", "doc_id", "refs"])

    number = F.col("doc_id").cast("long")
    return docs.where(number.isNotNull()).select(number.alias("doc_id"), "text").mapInArrow(work, "k long, k2 long, doc_id long, refs long")


def _in_filters(keys: DataFrame, filters: DataFrame, shards: int, action: str) -> DataFrame:
    """Each shard's filter after its keys are added or removed (rows with filter set), and, for "probe", the keys that it may
    hold already (rows with k and k2); those are not added."""

    def work(_: tuple, new: pa.Table, old: pa.Table) -> pa.Table:
        shard = (new if new.num_rows else old).column("shard")[0].as_py()
        f = CuckooFilter(old.column("filter")[0].as_py() if old.num_rows else None)
        k, k2 = (new.column(c).to_numpy() for c in ("k", "k2"))
        maybe = f.may_hold(k2) if action == "probe" else np.zeros(len(k2), bool)
        (f.remove if action == "remove" else f.add)(k2[~maybe])
        n = int(maybe.sum())
        return pa.table({
            "shard": pa.array([shard] * (n + 1), pa.int64()), "k": pa.array([*k[maybe].tolist(), None], pa.int64()),
            "k2": pa.array([*k2[maybe].tolist(), None], pa.int64()), "filter": pa.array([None] * n + [f.stored()], pa.binary()),
        })

    dealt = keys.select(F.pmod("k", F.lit(shards)).alias("shard"), "k", "k2")
    return dealt.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(work, "shard long, k long, k2 long, filter binary")


def in_force(counts: DataFrame) -> DataFrame:
    """The row of highest version of each key."""
    return counts.groupBy("k", "k2").agg(F.max_by(F.struct("refs", "first", "last"), "version").alias("c")).select("k", "k2", "c.*")


def meet(refs: DataFrame, keys: DataFrame, total: int) -> DataFrame:
    """References joined with rows of their keys (with n, the references of each); of keys with more than a thousandth of all
    references there are a thousand at most, and they are broadcast."""
    heavy = F.broadcast(keys.where(F.col("n") > max(total // HEAVY, 1)))
    light = keys.where(F.col("n") <= max(total // HEAVY, 1))
    others = refs.join(heavy.select("k", "k2"), ["k", "k2"], "left_anti")
    return refs.join(heavy, ["k", "k2"]).unionByName(others.join(light, ["k", "k2"]))


class LineIndex:
    """Insert documents, delete them by id, and ask for lines with a smaller holder."""

    def __init__(self, spark: SparkSession):
        self.spark, self.shards, self.keys, self.total, self.version = spark, 0, 0, 0, 0
        self.refs: list[DataFrame] = []
        self.counts: list[DataFrame] = []
        self.filters = spark.createDataFrame([], "shard long, filter binary")

    def _all(self, runs: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, runs)

    def _count(self, rows: DataFrame, name: str) -> DataFrame:
        """A new run of the count tables."""
        self.version += 1
        run = stage(rows.select("k", "k2", "refs", "first", "last", F.lit(self.version).alias("version")), name)
        self.counts.append(run)
        return run

    def counted(self, keys: DataFrame) -> DataFrame:
        """The counts in force of the keys that have references."""
        if not self.counts:
            return self.spark.createDataFrame([], "k long, k2 long, refs long, first long, last long")
        return in_force(self._all([c.join(keys.select("k", "k2"), ["k", "k2"], "left_semi") for c in self.counts])).where("refs > 0")

    def _make_room(self, new: int) -> None:
        """More shards, if keys outgrow them: the filters are built anew from the counts."""
        if self.keys + new <= self.shards * SHARD_KEYS:
            return
        self.shards = 1 << max(0, (2 * (self.keys + new) // SHARD_KEYS)).bit_length()
        none = self.spark.createDataFrame([], "shard long, filter binary")
        if self.keys:
            held = in_force(self._all(self.counts)).where("refs > 0")
            self.filters = stage(_in_filters(held, none, self.shards, "add").select("shard", "filter"), "line-filters")

    def insert(self, docs: DataFrame) -> DataFrame:
        """Add documents that the index does not hold; the counts of the batch's keys that two documents or more hold now."""
        run = stage(references(docs), "line-refs")
        batch = stage(run.groupBy("k", "k2").agg(F.sum("refs").alias("refs"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last")), "line-keys")
        new = batch.count()
        self._make_room(new)
        probed = stage(_in_filters(batch, self.filters, self.shards, "probe"), "line-filters") if new else None
        maybe = probed.where("filter is null") if new else batch
        known = stage(self.counted(maybe), "line-known")
        if new:
            self.filters = probed.where("filter is not null").select("shard", "filter")
            alarms = stage(maybe.join(known, ["k", "k2"], "left_anti").select("k", "k2"), "line-alarms")
            if not alarms.isEmpty():
                self.filters = stage(_in_filters(alarms, self.filters, self.shards, "add").select("shard", "filter"), "line-filters")
        self.keys += new - known.count()
        self.total += run.count()
        own = self._count(batch, "line-counts")
        old = known.select("k", "k2", *[F.col(c).alias(f"o_{c}") for c in ("refs", "first", "last")])
        both = batch.join(old, ["k", "k2"]).select("k", "k2", (F.col("refs") + F.col("o_refs")).alias("refs"), F.least("first", "o_first").alias("first"), F.greatest("last", "o_last").alias("last"))
        merged = self._count(both, "line-counts")
        self.refs.append(run)
        return own.unionByName(merged).where("first < last")

    def delete(self, ids: DataFrame) -> None:
        """Take out all that the documents of these ids (doc_id) hold; ids that the index does not know are passed over."""
        if not self.refs:
            return
        held = self._all(self.refs)
        named = ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
        gone = stage(held.join(named, "doc_id").groupBy("k", "k2", "doc_id").agg((-F.sum("refs")).alias("refs")).where("refs < 0"), "line-refs")
        touched = stage(gone.groupBy("k", "k2").agg(F.sum("refs").alias("gone")), "line-keys")
        before = self.counted(touched).select("k", "k2", F.col("refs").alias("n"))
        left = meet(held.unionByName(gone), stage(before, "line-known"), self.total)
        left = left.groupBy("k", "k2", "doc_id").agg(F.sum("refs").alias("refs")).where("refs > 0")
        left = left.groupBy("k", "k2").agg(F.sum("refs").alias("refs"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        now = self._count(touched.join(left, ["k", "k2"], "left").withColumn("refs", F.coalesce("refs", F.lit(0))), "line-counts")
        dead = now.where("refs = 0")
        self.filters = stage(_in_filters(dead, self.filters, self.shards, "remove").select("shard", "filter"), "line-filters")
        self.keys -= dead.count()
        self.refs.append(gone)

    def shared(self) -> DataFrame:
        """The counts in force of all keys that two documents or more hold."""
        return in_force(self._all(self.counts)).where("refs > 0 and first < last") if self.counts else self.counted(self.filters)

    def dedup(self, docs: DataFrame, shared: DataFrame | None = None, with_text: bool = False, last: int = 0) -> DataFrame:
        """doc_id, n_lines, n_dropped, kept_sha256 (and text) of every row of docs, whose documents the index holds; all in the
        last so many runs, if that is given, which spares reading the others."""
        keys = stage((self.shared() if shared is None else in_force(shared)).select("k", "k2", F.col("refs").alias("n"), "first"), "line-shared")
        number = F.col("doc_id").cast("long")
        runs = self._all(self.refs[-last:]) if self.refs else references(docs.limit(0))
        hits = meet(runs.where("refs > 0"), keys, self.total).where("doc_id > first").select("doc_id", "k", "k2")
        drop = hits.groupBy("doc_id").agg(F.collect_list(F.struct("k", "k2")).alias("drop"))
        return cut(docs.where(number.isNotNull()).select(number.alias("doc_id"), "text").join(drop, "doc_id", "left"), docs.where(number.isNull()), with_text)


def cut(marked: DataFrame, nameless: DataFrame, with_text: bool) -> DataFrame:
    """Rows of marked without the lines whose keys are in drop, rows of nameless as they are."""
    small_batches(marked.sparkSession)

    def one(text: str | None, drop: list | None) -> tuple[int, int, str, str]:
        text = text or ""
        if not drop:
            return text.count("\n") + 1, 0, hashlib.sha256(text.encode("utf-8", "replace")).hexdigest(), text
        gone = {(d["k"] & 0xFFFFFFFFFFFFFFFF) << 64 | d["k2"] & 0xFFFFFFFFFFFFFFFF for d in drop}
        lines = text.split("\n")
        kept = [line for line, k in zip(lines, line_keys(text)) if k not in gone]
        left = "\n".join(kept)
        return len(lines), len(lines) - len(kept), hashlib.sha256(left.encode("utf-8", "replace")).hexdigest(), left

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(zip(*[one(t, d) for t, d in zip(b.column(1).to_pylist(), b.column(2).to_pylist())])) or [()] * 4
            arrays = [pa.array(c, t) for c, t in zip(cols[: 3 + with_text], (pa.int64(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], names=["doc_id", "n_lines", "n_dropped", "kept_sha256", "text"][: 4 + with_text])

    rest = nameless.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(None).cast(marked.schema["drop"].dataType).alias("drop"))
    return marked.select("doc_id", "text", "drop").union(rest).mapInArrow(work, "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + ", text string" * with_text)


def line_dedup(docs: DataFrame, batches: int = 2, with_text: bool = False, index: LineIndex | None = None) -> DataFrame:
    """Insert the documents in batches of ascending doc_id, then cut the lines of all of them that a smaller id holds (an
    index that is given counts as well, and holds them afterwards)."""
    number = F.col("doc_id").cast("long")
    cuts = docs.where(number.isNotNull()).agg(F.percentile_approx(number, [k / batches for k in range(1, batches)])).first()[0] if batches > 1 else []
    lines, found, low = index or LineIndex(docs.sparkSession), [], None
    for cut_ in [*sorted(set(cuts or [])), None]:
        part = docs.where((F.lit(True) if low is None else number > low) & (F.lit(True) if cut_ is None else number <= cut_))
        found.append(lines.insert(part))
        low = cut_
    return lines.dedup(docs, reduce(DataFrame.unionByName, found), with_text, len(found))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(read(spark, sf_dir, "documents"))


ORACLE = """
WITH l AS (SELECT doc_id, n, unnest(range(1, n + 1)) AS i, unnest(lines) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines, len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents)),
k AS (SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
m AS (SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS gone FROM k)
SELECT doc_id, CAST(max(n) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""
