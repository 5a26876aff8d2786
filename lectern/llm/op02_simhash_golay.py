"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into three segments of 21, 21 and 22 bits. Two fingerprints that differ in at
most four bits share a key in one of these ways, by the pigeonhole principle over the segments' errors:

* a segment has no error: the segment itself is a key (one for each segment);
* otherwise each segment has at least one error, so two of them have exactly one. Then their parities differ.
  In the extended Golay code [24, 12, 8] a word of odd weight lies within three bits of exactly one codeword,
  and a word of even weight within four bits of one or six. If two words differ in one bit, the odd one's
  codeword is among the even one's. So a pair of segments gives 1, 6 or 36 keys, each of two 12-bit codeword
  indices, and keys of two fingerprints meet if they are within one bit in both segments.

Keys are dealt and sorted by key; a task goes through the runs of equal keys, compares the members of a run
by popcount and keeps the links that join something new (a forest), so that a run gives fewer links than
members. A run longer than RUN is not compared there: its members go out in chunks, every pair of chunks is
compared by a task of its own, and again only forests come back. Keys are counted first, and one of more than HOT
fingerprints goes to chunks by a hash of the fingerprint at once. No run is held whole, none is dropped.
Equal fingerprints are one node from the start, so exact copies never meet in a run.

Nulls: a null text has no words and the fingerprint zero. Rows with a null doc_id are kept and form no smaller
id, nor does a doc_id that is no integer. Rows of equal doc_id are each returned. An empty table gives no rows. Extra columns are not used, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, read, small_batches, stage, with_one

#: Shift and width of each segment of a fingerprint.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Longest run compared within its own task, and members of a chunk of a longer one.
RUN = 1024
#: A key of more fingerprints than this is dealt out in chunks from the start and never meets in one task.
HOT = 64 * RUN
#: Generator polynomial of the binary Golay code of length 23.
GENERATOR = 0b101011100011


def fingerprint(text: str | None, size: int = 4) -> int:
    """SimHash over shingles of that many words, as an unsigned 64-bit integer."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    k = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    return bits_of(np.array([digest(joined[a:b], 42) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64))


def bits_of(h: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 4096):
        ones += np.unpackbits(h[a : a + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) for every row."""
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, size) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, fp long")


@cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """near: for each 23-bit syndrome (11 bits) the error pattern of up to three bits; code: the extended codeword
    (24 bits) of each 12-bit index; sextet: for each syndrome of an even word the up to six error patterns of
    length 24 with at most four bits, -1 where there are fewer."""
    bits = np.arange(23)

    def syndrome(v: np.ndarray) -> np.ndarray:
        v = v.copy()
        for k in range(22, 10, -1):
            v ^= np.where((v >> k) & 1, GENERATOR << (k - 11), 0)
        return v

    near = np.zeros(2048, np.int64)
    one = 1 << bits
    pairs = np.array([one[i] | one[j] for i in range(23) for j in range(i)])
    triples = np.array([one[i] | one[j] | one[k] for i in range(23) for j in range(i) for k in range(j)])
    for e in (triples, pairs, one, np.zeros(1, np.int64)):
        near[syndrome(e)] = e
    # a word of 24 bits: bit 23 is the overall parity of the codeword. Even words have even weight as they stand.
    even = np.full((2048, 6), -1, np.int64)
    fill = np.zeros(2048, np.int64)
    for e in [0, *pairs.tolist(), *one.tolist(), *triples.tolist(), *[int(t | one[m]) for t in triples for m in range(23) if one[m] > t]]:
        w = bin(e).count("1")
        full = e | ((w & 1) << 23)  # an odd pattern also flips the parity bit
        if bin(full).count("1") > 4:
            continue
        s = int(syndrome(np.array([e]))[0])
        if w <= 2 and bin(full).count("1") <= 2:
            even[s, 0], fill[s] = full, -9  # within two bits: the only codeword within four
        elif fill[s] >= 0:
            even[s, fill[s]] = full
            fill[s] += 1
    return near, syndrome(np.arange(1 << 12) << 11), even


def _syndrome(v: np.ndarray) -> np.ndarray:
    v = v.copy()
    for k in range(22, 10, -1):
        v ^= np.where((v >> k) & 1, np.int64(GENERATOR << (k - 11)), np.int64(0))
    return v


def segment_keys(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Odd or even weight of each segment word, and its codeword indices (12 bits): one for odd words, up to six
    for even ones, -1 where there are fewer."""
    near, _, even = golay()
    odd = (np.bitwise_count(v) & 1).astype(np.int64)
    s = _syndrome(v)
    out = np.full((len(v), 6), -1, np.int64)
    # An odd word w, seen with a zero 24th bit, has one codeword within three bits: over 23 bits that is the nearest
    # one, or it differs in the 24th bit as well; only the first twelve bits (the index) matter as a key.
    out[:, 0] = (v ^ near[s]) >> 11
    e = even[s]
    six = np.where(e >= 0, (v[:, None] ^ (e & 0x7FFFFF)) >> 11, -1)
    out[odd == 0] = six[odd == 0]
    return odd, out


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in fp, key) for every key of every fingerprint; fp unsigned."""
    seg = [((fp >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    rows, keys = [np.arange(len(fp))] * 3, [(np.int64(k) << 40) | s for k, s in enumerate(seg)]
    coded = [segment_keys(s) for s in seg]
    for t, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        (oi, ci), (oj, cj) = coded[i], coded[j]
        grid = np.where((ci[:, :, None] >= 0) & (cj[:, None, :] >= 0), (ci[:, :, None] << 12) | cj[:, None, :], -1).reshape(len(fp), -1)
        r, c = np.nonzero(grid >= 0)
        # fingerprints can meet here only if both parities differ, so equal and unequal parities never mix
        rows.append(r)
        keys.append((np.int64(3 + t) << 40) | ((oi ^ oj)[r] << 24) | grid[r, c])
    return np.concatenate(rows), np.concatenate(keys)


def forest(fa: np.ndarray, fb: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray, within: bool, limit: int) -> list[tuple[int, int]]:
    """Links (pairs of ids) of a forest that joins what is within limit bits, over a x b, or over a alone."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for lo in range(0, len(fa), 256):
        near = np.bitwise_count(fa[lo : lo + 256, None] ^ fb[None, :]) <= limit
        i, j = np.nonzero(near)
        i += lo
        if within:
            i, j = i[i < j], j[i < j]
        for x, y in zip(ids_a[i].tolist(), ids_b[j].tolist()):
            a, b = find(x), find(y)
            if a != b:
                root[a] = b
                out.append((x, y))
    return out


def links(nodes: DataFrame, limit: int = 4) -> DataFrame:
    """Edges (a, b) that connect all fingerprints within limit bits; nodes: node, fp, one row for each fp."""
    spark = nodes.sparkSession

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, fp = b.column(0).to_numpy(), b.column(1).to_numpy()
            at, key = keys_of(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[at]), pa.array(node[at])], names=["key", "fp", "node"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of equal keys; a long run leaves as chunks (a: key, b: node, c: fp, d: chunk), links have a null d."""
        held = [np.zeros(0, np.int64)] * 3
        long_key, chunk = None, 0

        def out(a, b, c, d):
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, c, d)], names=["a", "b", "c", "d"])

        def runs(key, fp, node, last: bool):
            """Finished runs are compared; what may go on in the next batch is returned."""
            nonlocal long_key, chunk
            found, rest, cuts = [], len(key), np.flatnonzero(np.diff(key)) + 1
            bounds = [0, *cuts.tolist(), len(key)]
            for s, e in zip(bounds, bounds[1:]):
                k, open_end = int(key[s]), e == len(key) and not last
                if k == long_key or e - s > RUN:
                    if k != long_key:
                        long_key, chunk = k, 0
                    for lo in range(s, e, RUN):
                        part = slice(lo, min(lo + RUN, e))
                        if open_end and part.stop - part.start < RUN:
                            rest = part.start
                            break
                        found.append(out(key[part], node[part], fp[part], [chunk] * (part.stop - part.start)))
                        chunk += 1
                elif open_end:
                    rest = s
                elif e - s > 16:
                    u = fp[s:e].view(np.uint64)
                    pairs = forest(u, u, node[s:e], node[s:e], True, limit)
                    if pairs:
                        a, b = zip(*pairs)
                        found.append(out(a, b, [None] * len(a), [None] * len(a)))
            # short runs all at once: compare each row with the next, the second next, and so on, of its run
            size = np.diff(bounds)
            run = np.repeat(np.arange(len(size)), size)
            short = (size <= 16)[run]
            short[rest:] = False
            for d in range(1, int(min(16, size.max()))):
                i = np.flatnonzero(short[:-d] & (run[:-d] == run[d:]))
                i = i[np.bitwise_count(fp[i].view(np.uint64) ^ fp[i + d].view(np.uint64)) <= limit]
                if len(i):
                    found.append(out(node[i], node[i + d], [None] * len(i), [None] * len(i)))
            return found, rest

        for b in batches:
            new = [b.column(k).to_numpy() for k in range(3)]
            key, fp, node = (np.concatenate([h, x]) for h, x in zip(held, new))
            if not len(key):
                continue
            found, at = runs(key, fp, node, False)
            yield from found
            held = [key[at:], fp[at:], node[at:]]
        if len(held[0]):
            yield from runs(*held, True)[0]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (key, i, j, side): chunk i against chunk j of a long run."""
        held, now = [], None

        def done():
            side = np.array([h[2] for h in held])
            fp, node = np.array([h[0] for h in held], np.int64).view(np.uint64), np.array([h[1] for h in held], np.int64)
            x, y = side == 0, side == 1
            pairs = forest(fp, fp, node, node, True, limit) if not y.any() else forest(fp[x], fp[y], node[x], node[y], False, limit)
            a, b = zip(*pairs) if pairs else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for key, i, j, side, fp, node in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if (key, i, j) != now:
                    if held:
                        yield done()
                    held, now = [], (key, i, j)
                held.append((fp, node, side))
        if held:
            yield done()

    keys = nodes.select("node", "fp").mapInArrow(spread, "key long, fp long, node long")
    hot = stage(keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT), "hot-keys")
    rows = keys.join(hot, "key", "left_anti").repartition("key").sortWithinPartitions("key")
    first = stage(rows.mapInArrow(compare, "a long, b long, c long, d long"), "links")
    edges = first.where("d is null").select("a", "b")
    long_runs = first.where("d is not null").select(F.col("a").alias("key"), F.col("b").alias("node"), F.col("c").alias("fp"), "d")
    dealt = keys.join(hot, "key").select("key", "node", "fp", F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / RUN)).alias("d"))
    long_runs = long_runs.union(dealt)
    if long_runs.isEmpty():
        return edges
    last = long_runs.groupBy("key").agg(F.max("d").alias("last"))
    pairs = (
        long_runs.join(last, "key")
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("last").cast("int"))))
        .select("key", F.least("d", "o").cast("long").alias("i"), F.greatest("d", "o").cast("long").alias("j"), (F.col("d") > F.col("o")).cast("int").alias("side"), "fp", "node")
        .repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j", "side")
    )
    return edges.union(pairs.mapInArrow(blocks, "a long, b long"))


def near_duplicates(docs: DataFrame, size: int = 4, limit: int = 4) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links) for every row."""
    prints = stage(fingerprints(docs, size), "fingerprints")
    nodes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("n_rows")), "nodes")
    found = components(links(nodes.where("node is not null"), limit))
    marked = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"), "n_rows")
    return with_one(prints, marked, "fp", prints.count()).select("doc_id", "fp", "component_id")


def op2_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
