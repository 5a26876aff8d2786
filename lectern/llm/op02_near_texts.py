"""SimHash near-dedup on five-word shingles, for texts of a Jaccard similarity of 0.8 or more.

Golay-code keys of the SimHash give the first candidates: texts whose fingerprints differ in four bits at most. At
Jaccard 0.8 two fingerprints differ in about ten bits of 64, beyond any radius that such keys hold, so the shingles'
smallest hashes give the rest: a pair of similarity 0.8 shares one of BANDS keys, each of ROWS minima, but for one
pair in 14,000; above it the share missed falls fast. Candidates of either kind are links only if the whole sets of
shingles say so. No group's pairs are listed:

* each member of a key is compared with the key's smallest and largest member, which joins most of a large group;
* where the members of a key are still of several components, those outside the commonest one are the queries of
  that component: in blocks, a task compares a chunk of them with a chunk of its members and of one another, and only
  the first link of a query to each component comes back.

Equal texts (lower case, white space aside) are one node from the start. Nulls: a null text has no words and equals
any other without words. Rows with a null doc_id take no part. An empty table gives no rows. Rows of equal doc_id
and different texts are told apart by text_hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, small_batches, stage, with_one
from .op02_simhash_golay import bits_of, links

#: Keys of each text and minima in each.
BANDS, ROWS = 24, 5
#: Members of a component, and queries of it, that are compared at a time.
CHUNK = 256
_RNG = np.random.default_rng(42)
FACTORS, ADDED = (_RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)), _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingles(text: str | None, size: int = 5) -> tuple[int, np.ndarray]:
    """The text's own hash and the hashes of its shingles of that many words, repeats included."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if not words:
        return digest(joined, 7), np.zeros(0, np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    k = min(size, len(words))
    h = [digest(joined[a:b], 42) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())]
    return digest(joined, 7), np.array(h, np.uint64)


def band_keys(s: np.ndarray) -> np.ndarray:
    """One signed long for each band; none for an empty set."""
    if not len(s):
        return np.zeros(0, np.int64)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(s), 512):
        low = np.minimum(low, (s[a : a + 512, None] * FACTORS + ADDED).min(axis=0))
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(low.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def _mapped(docs: DataFrame, size: int, keys: bool) -> DataFrame:
    """doc_id, text_hash, h (the hash of the text's words), fp (its SimHash) and v: its keys or its whole set."""
    small_batches(docs.sparkSession)
    names = ["doc_id", "text_hash", "h", "fp", "v"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, prints, values = [], [], []
            for t in b.column(2).to_pylist():
                h, s = shingles(t, size)
                own.append(h)
                prints.append(bits_of(s) if keys else 0)
                s = np.unique(s)
                values.append(band_keys(s) if keys else s.view(np.int64))
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), signed(own), signed(prints), pa.array(values, pa.list_(pa.int64()))], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").where("doc_id is not null")
    return rows.mapInArrow(work, "doc_id long, text_hash long, h long, fp long, v array<long>")


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are that similar."""
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared >= F.lit(similarity) * (F.size("sa") + F.size("sb") - shared) - 1e-9).select("a", "b")


def _simhash_pairs(nodes: DataFrame, total: int) -> DataFrame:
    """Pairs (a, b) of nodes that connect all whose fingerprints are within four bits; nodes: h, fp, total at most."""
    of_print = stage(nodes.groupBy("fp").agg(F.min("h").alias("node"), F.count("*").alias("n_rows")), "of-print")
    same = with_one(nodes, of_print, "fp", total).where("h <> node").select(F.col("h").alias("a"), F.col("node").alias("b"))
    return same.union(links(of_print, 4).select("a", "b"))


def _in_blocks(queries: DataFrame, members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between the components c of queries (main, node, c) and of what is similar to them among the members
    (main, node, c) of their main component, the queries included."""
    data = members.union(queries)
    parts = data.groupBy("main").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts"))
    blocks = queries.groupBy("main").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("blocks"))
    own = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # each member goes to every block of queries, each query to every part of the members: a pair meets in one cell
    sized = lambda d: d.join(parts, "main").join(blocks, "main")
    dealt = sized(data).select("main", own("parts").alias("part"), every("blocks").alias("block"), F.lit(0).alias("role"), "node", "c")
    asked = sized(queries).select("main", every("parts").alias("part"), own("blocks").alias("block"), F.lit(1).alias("role"), "node", "c")
    rows = dealt.union(asked).join(sets.select(F.col("h").alias("node"), "v"), "node")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, index = None, [], None
        for b in batches:
            found = []
            main, part, block, role, c = (b.column(k).to_pylist() for k in range(5))
            for k, v in enumerate(b.column(5)):
                v = v.values.to_numpy()
                if (main[k], part[k], block[k]) != now:
                    now, held, index = (main[k], part[k], block[k]), [], None
                if not role[k]:
                    held.append((c[k], v))
                    continue
                if index is None:  # all the chunk's hashes in order, with whose they are
                    sizes = np.array([len(x) for _, x in held])
                    owner, every = np.repeat(np.arange(len(held)), sizes), np.concatenate([x for _, x in held])
                    order = np.argsort(every, kind="stable")
                    index = every[order], owner[order], sizes
                every, owner, sizes = index
                lo, n = np.searchsorted(every, v), np.searchsorted(every, v, "right")
                n -= lo
                at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                shared = np.bincount(owner[at], minlength=len(held))
                seen = {c[k]}
                for j in np.flatnonzero(shared >= similarity * (len(v) + sizes - shared) - 1e-9).tolist():
                    if held[j][0] not in seen:
                        seen.add(held[j][0])
                        found.append((c[k], held[j][0]))
            if found:
                x, y = zip(*dict.fromkeys(found))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    # members come before the queries of their cell
    cell = ["main", "part", "block"]
    return rows.select(*cell, "role", "c", "v").repartition(*cell).sortWithinPartitions(*cell, "role").mapInArrow(work, "a long, b long")


def near_copies(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, text_hash and group for every row that has an id; a group is what similar pairs connect."""
    prints = stage(_mapped(docs, size, True), "prints")
    total = prints.count()
    nodes = prints.groupBy("h").agg(F.first("v").alias("v"))
    keyed = nodes.select(F.explode("v").alias("key"), F.col("h").alias("node"))
    ends = keyed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("n_rows")).where("lo < hi")
    met = stage(with_one(keyed, ends, "key", BANDS * total), "met")
    with_ends = met.select("node", F.explode(F.array("lo", "hi")).alias("end")).where("node <> end")
    golay = stage(_simhash_pairs(prints.select("h", "fp").distinct(), total), "simhash-pairs")
    both = with_ends.select(F.col("node").alias("a"), F.col("end").alias("b")).union(golay)
    pairs = both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    named = met.select(F.col("node").alias("h")).union(golay.select("a")).union(golay.select("b"))
    reps = prints.groupBy("h").agg(F.min("doc_id").alias("doc_id")).join(named, "h", "left_semi").select("doc_id").distinct()
    sets = stage(_mapped(docs.join(reps, "doc_id", "left_semi"), size, False).select("h", "v").dropDuplicates(["h"]), "sets")
    first = stage(_alike(pairs, sets, similarity), "alike")

    found = stage(components(first), "joined")
    members = stage(met.select("key", "node").join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c")), "members")
    sizes = members.groupBy("key", "c").agg(F.count("*").alias("n"))
    most = sizes.groupBy("key").agg(F.max(F.struct("n", "c")).alias("most"), F.count("*").alias("cs")).where("cs > 1").select("key", F.col("most.c").alias("main"))
    queries = stage(members.join(most, "key").where("c <> main").select("main", "node", "c").distinct(), "queries")
    mains = queries.select("main").distinct()
    second = _in_blocks(queries, members.select(F.col("c").alias("main"), "node", "c").distinct().join(mains, "main"), sets, similarity)

    # the second round joins components, far fewer than texts; texts and their copies take the names of the groups
    last = components(second).select(F.col("node").alias("c"), "component")
    texts = prints.groupBy("h").agg(F.count("*").alias("copies")).join(found.withColumnRenamed("node", "h"), "h", "left")
    texts = stage(texts.select("h", "copies", F.coalesce("component", "h").alias("c")), "texts")
    groups = texts.groupBy("c").agg(F.count("*").alias("n_rows")).join(last, "c", "left").select("c", "n_rows", F.coalesce("component", "c").alias("group"))
    named = with_one(texts, groups, "c", total).select("h", "group", F.col("copies").alias("n_rows"))
    return with_one(prints.select("doc_id", "text_hash", "h"), named, "h", total).select("doc_id", "text_hash", "group")
