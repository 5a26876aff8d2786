"""Vector indexes: a product-quantised inverted file for search, pivots for joins above a similarity, products of blocks for the nearest above one.

The first two are fitted on a bounded sample (so many rows of smallest hash of their id) and then hold every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.files import small_batches

SAMPLE = 20_000


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the commonest length of a column of arrays without nulls, and their unit vectors; zero vectors are left out."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    if not sizes.any():
        return np.zeros(0, np.int64), np.zeros((0, 1))
    return of_length(column, int(np.bincount(sizes[sizes > 0]).argmax()))


def of_length(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == size)
    x = column.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, size)
    length = np.sqrt((x * x).sum(1))
    good = np.isfinite(length) & (length > 0)
    return rows[good], x[good] / length[good, None]


def lists(x: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as lists, without a Python object for each number."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(1, x.shape[1]), dtype=np.int32)[: len(x) + 1]), pa.array(x.ravel()))


def sample_of(vectors: DataFrame, key: str, vector: str, rows: int = SAMPLE) -> np.ndarray:
    """Unit vectors of a sample, so many rows at most."""
    some = vectors.where(F.size(vector) > 0).orderBy(F.xxhash64(key), key).limit(rows).select(vector)
    return matrix(some.toArrow().column(0).combine_chunks())[1]


def lloyd(x: np.ndarray, k: int, seed: int = 7, rounds: int = 12) -> np.ndarray:
    """Centres of k-means."""
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = ((centres * centres).sum(1) - 2 * x @ centres.T).argmin(1)
        for j in np.unique(near):
            centres[j] = x[near == j].mean(0)
    return centres


# ---- search


@dataclass
class QuantisedIndex:
    """Unit vectors are filed under their nearest centre; what is left of them is cut into parts, each the number of its nearest code word."""

    centres: np.ndarray  # cells x size
    books: np.ndarray  # parts x words x size of a part
    probes: int

    @property
    def size(self) -> int:
        return self.centres.shape[1]

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Centres from near to far."""
        return np.argsort((self.centres * self.centres).sum(1) - 2 * x @ self.centres.T, axis=1)

    def codes(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        parts = (x - self.centres[cell]).reshape(len(x), len(self.books), -1)
        return np.stack([((b * b).sum(1) - 2 * parts[:, m] @ b.T).argmin(1) for m, b in enumerate(self.books)], axis=1).astype(np.int8)

    def table(self, q: np.ndarray) -> np.ndarray:
        """The product of a query's parts with every code word."""
        parts = q.reshape(len(q), len(self.books), -1)
        return np.einsum("nmd,mwd->nmw", parts, self.books).reshape(len(q), -1).astype(np.float32)


def fit_index(chunks: DataFrame, cells: int = 16, parts: int = 32, words: int = 16, sample: int = SAMPLE, recall: float = 0.98) -> QuantisedIndex | None:
    """Fit on a bounded sample. A query looks at the codes in so many cells as hold that part of the ten nearest of sampled queries."""
    x = sample_of(chunks, "chunk_id", "embedding", sample)
    if not len(x):
        return None
    parts = next(p for p in range(min(parts, x.shape[1]), 0, -1) if x.shape[1] % p == 0)
    index = QuantisedIndex(lloyd(x, cells), np.zeros((parts, 1, x.shape[1] // parts)), len(x))
    order = index.cells(x)
    rest = (x - index.centres[order[:, 0]]).reshape(len(x), parts, -1)
    books = [lloyd(rest[:, m], words) for m in range(parts)]
    index.books = np.stack(books)
    asked = np.arange(0, len(x), max(1, len(x) // 200))
    near = np.argsort(-(x[asked] @ x.T), axis=1)[:, 1:11]
    place = np.argsort(order[asked], axis=1)  # of each cell in a query's order
    needed = np.sort(np.take_along_axis(place, order[near, 0], axis=1).ravel())
    index.probes = int(needed[int(recall * (len(needed) - 1))]) + 1 if len(needed) else len(index.centres)
    return index


def file_chunks(chunks: DataFrame, index: QuantisedIndex) -> DataFrame:
    """chunk_id, plan_id, cell and code of every chunk with a vector of the index's length: the inverted file, a few bytes for each part."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = of_length(b.column(2), index.size)
            cell = index.cells(x)[:, 0]
            code = lists(index.codes(x, cell))
            yield pa.RecordBatch.from_arrays([b.column(k).take(pa.array(rows)) for k in (0, 1)] + [pa.array(cell.astype(np.int32)), code], names=["chunk_id", "plan_id", "cell", "code"])

    small_batches(chunks.sparkSession)
    kinds = dict(chunks.dtypes)
    return chunks.select("chunk_id", "plan_id", "embedding").mapInArrow(work, f"chunk_id {kinds['chunk_id']}, plan_id {kinds['plan_id']}, cell int, code array<tinyint>")


def candidates(queries: DataFrame, filed: DataFrame, index: QuantisedIndex, n: int) -> DataFrame:
    """(query_id, chunk_id) of the n best chunks of each query's plan by their codes: in each probed cell the query's product
    with the centre plus one table entry for each part of the code. No vector is read."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, every = of_length(b.column(2), index.size)
            for at in range(0, len(rows), ASKED):
                q, some = every[at : at + ASKED], rows[at : at + ASKED]
                cell = index.cells(q)[:, : index.probes]
                base = np.take_along_axis(q @ index.centres.T, cell, axis=1)
                each = np.repeat(np.arange(len(q)), cell.shape[1])
                cols = [b.column(k).take(pa.array(some[each])) for k in (0, 1)] + [pa.array(cell.ravel().astype(np.int32)), pa.array(base.ravel())]
                yield pa.RecordBatch.from_arrays([*cols, lists(index.table(q)[each])], names=["query_id", "plan_id", "cell", "base", "table"])

    small_batches(queries.sparkSession)
    kinds = dict(queries.dtypes)
    asked = queries.select("query_id", "plan_id", "vector").mapInArrow(work, f"query_id {kinds['query_id']}, plan_id {kinds['plan_id']}, cell int, base double, table array<float>")
    words = index.books.shape[1]
    score = sum((F.get("table", F.get("code", F.lit(m)) + F.lit(m * words)) for m in range(len(index.books))), F.col("base"))
    hits = asked.join(filed, ["plan_id", "cell"]).select("query_id", "chunk_id", score.alias("near"))
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("near"), "chunk_id"))
    return hits.withColumn("n", best).where(F.col("n") <= n).select("query_id", "chunk_id")


# ---- joins above a similarity

#: Index rows of a pivot that one block of the join holds.
BLOCK = 20_000


@dataclass
class Pivots:
    """Unit vectors far from one another. A vector is filed under its nearest pivot, in a ring of angles around it."""

    vectors: np.ndarray
    width: float  # of a ring, and the largest angle between matching vectors

    def angles(self, x: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(x @ self.vectors.T, -1.0, 1.0))


def fit_pivots(index: DataFrame, key: str, vector: str, threshold: float, most: int = 128, sample: int = 4000) -> Pivots:
    """Pivots from a bounded sample, each the vector that is farthest from those before it. Until none is farther than
    the width of a ring, or there are enough."""
    x = sample_of(index, key, vector, sample)
    width = float(np.arccos(np.clip(threshold, -1.0, 1.0))) + 1e-4  # room for scores that are rounded
    if not len(x):
        return Pivots(np.zeros((0, 1)), width)
    chosen, far = [0], x @ x[0]
    while len(chosen) < min(most, len(x)) and far.min() < np.cos(width):
        chosen.append(int(far.argmin()))
        far = np.maximum(far, x @ x[chosen[-1]])
    return Pivots(x[chosen], width)


def _placed(df: DataFrame, vector: str, pivots: Pivots, visits: bool) -> DataFrame:
    """df with pivot and ring: its own ones, or for visits all in which a match can be. A match is no more than the width w away. So it is
    in a ring that differs by one at most; and as it is no farther from its own pivot than from the request's nearest one, its own
    pivot is at most 2 w farther from the request than that one. Vectors of another length are filed by it alone."""
    common = pivots.vectors.shape[1] if len(pivots.vectors) else -1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(0)
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            rows, x = of_length(column, common) if common > 0 else (np.zeros(0, np.int64), np.zeros((0, 1)))
            at, pivot, ring = [np.flatnonzero((sizes > 0) & (sizes != common))], None, None
            pivot, ring = [-sizes[at[0]]], [np.zeros(len(at[0]), np.int64)]
            if len(rows):
                a = pivots.angles(x)
                if visits:
                    i, p = np.nonzero(a <= a.min(1)[:, None] + 2 * pivots.width)
                    for step in (-1, 0, 1):
                        at.append(rows[i])
                        pivot.append(p)
                        ring.append((a[i, p] // pivots.width).astype(np.int64) + step)
                else:
                    at.append(rows)
                    pivot.append(a.argmin(1))
                    ring.append((a.min(1) // pivots.width).astype(np.int64))
            at, pivot, ring = (np.concatenate(c) for c in (at, pivot, ring))
            cols = [c.take(pa.array(at)) for c in b.columns] + [pa.array(pivot.astype(np.int32)), pa.array(ring.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, "pivot", "ring"])

    rest = [c for c in df.columns if c != vector]
    source = df.select(vector, *rest)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    return source.mapInArrow(work, schema + ", pivot int, ring int")


def meeting(requests: DataFrame, index: DataFrame, pivots: Pivots, vector: str = "vector", other: str = "i_vector", also: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """Pairs of requests and index rows that can be similar enough, and equal in the columns of also: they meet on pivot, ring
    and those. The rows of a full pivot are dealt to blocks, and a request goes to all blocks of its pivots only."""
    filed, asked = _placed(index, other, pivots, False), _placed(requests, vector, pivots, True)
    full = filed.groupBy("pivot", "ring").count().where(F.col("count") > BLOCK)  # one row for a pivot and ring at most
    blocks = F.broadcast(full.select("pivot", "ring", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    number = F.coalesce("blocks", F.lit(1))
    filed = filed.join(blocks, ["pivot", "ring"], "left").withColumn("block", F.pmod(F.xxhash64(*[c for c in index.columns if c != other]), number).cast("int")).drop("blocks")
    asked = asked.join(blocks, ["pivot", "ring"], "left").withColumn("block", F.explode(F.sequence(F.lit(0), number - 1))).drop("blocks")
    filed = filed.withColumnsRenamed({"pivot": "_pivot", "ring": "_ring", "block": "_block"})
    on = [asked["pivot"] == filed["_pivot"], asked["ring"] == filed["_ring"], asked["block"] == filed["_block"], *(asked[a] == filed[b] for a, b in also)]
    same = on[0]
    for c in on[1:]:
        same = same & c
    return asked.join(filed, same).drop("pivot", "ring", "block", "_pivot", "_ring", "_block")


# ---- the nearest above a similarity

#: Index rows that one cell of the search holds, and queries that are multiplied with them at a time.
CELL, ASKED = 8192, 256
#: Scores are rounded to six places after the cut, so what is that much below it can still count.
ROUNDING = 2e-6


def nearest_pairs(requests: DataFrame, index: DataFrame, threshold: float, near: int, itself: bool = False) -> DataFrame:
    """(key, i_key) of each request's nearest index rows at a cosine of the threshold or more, near of them and what rounding could put
    among them. requests: key, vector, part; index: i_key, i_vector, i_part. Pairs have equal parts and vector lengths, and unequal keys, unless itself is set. The
    index rows of a part and length are dealt to cells, each request goes to all cells of its part and length, and a cell is a product
    of matrices: only the best pairs leave it, as ids. Zero vectors and such with nulls or other than finite numbers are near to none."""
    small_batches(index.sparkSession)
    dealt = index.where(F.size("i_vector") > 0).select("i_part", F.size("i_vector").alias("long"), F.col("i_key").alias("id"), F.col("i_vector").alias("v"))
    cells = dealt.groupBy("i_part", "long").agg(F.ceil(F.count("*") / CELL).cast("int").alias("cells"))
    marked = lambda d, role: d.select("part", "long", "cell", F.lit(role).alias("role"), F.xxhash64("id").alias("mark"), "id", "v")
    held = dealt.join(cells, ["i_part", "long"]).withColumn("cell", F.pmod(F.xxhash64("id"), "cells").cast("int")).withColumnRenamed("i_part", "part")
    asked = requests.where(F.size("vector") > 0).select(F.col("part").alias("i_part"), F.size("vector").alias("long"), F.col("key").alias("id"), F.col("vector").alias("v")).join(cells, ["i_part", "long"])
    asked = asked.withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).withColumnRenamed("i_part", "part")
    kind = dict(dealt.dtypes)["id"]
    names = ["key", "i_key", "near", "long"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, cell = None, [], None

        def measured(rows: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
            """ids, marks, unit vectors and the lengths that they had."""
            v, n = rows.column("v"), len(rows)
            x = v.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(n, -1)
            length = np.sqrt((x * x).sum(1))
            good = np.flatnonzero(np.isfinite(length) & (length > 0))
            return rows.column("id").take(pa.array(good)), rows.column("mark").to_numpy()[good], (x[good] / length[good, None]).astype(np.float32), length[good]

        for b in batches:
            where = np.stack([b.column(c).to_numpy() for c in ("place", "role")])
            cuts = [0, *(np.flatnonzero((where[:, 1:] != where[:, :-1]).any(0)) + 1).tolist(), len(b)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi == lo:
                    continue
                if where[0, lo] != now:
                    now, parts, cell = where[0, lo], [], None
                if not where[1, lo]:
                    parts.append(measured(b.slice(lo, hi - lo)))
                    continue
                if cell is None:
                    ids, *rest = zip(*parts) if parts else ((), (), (), ())
                    cell = (pa.concat_arrays(ids), *map(np.concatenate, rest)) if parts else ()
                    parts = []
                if not cell or not len(cell[0]):
                    continue
                for at in range(lo, hi, ASKED):
                    own, mark, x, length = measured(b.slice(at, min(ASKED, hi - at)))
                    if not len(x):
                        continue
                    score = x @ cell[2].T
                    if length.min() * cell[3].min() < 0.01:  # the score's divisor has 1e-9 added, which such short vectors feel
                        score /= (1 + 1e-9 / (length[:, None] * cell[3])).astype(np.float32)
                    room = ROUNDING + 2.4e-7 * x.shape[1]  # single precision as well
                    i, j = np.nonzero(score >= threshold - room)
                    many = np.flatnonzero(np.bincount(i, minlength=len(x)) > near)
                    if len(many):
                        cut = np.full(len(x), -2.0, np.float32)
                        other = score[many] if itself else np.where(mark[many, None] == cell[1], np.float32(-2), score[many])
                        cut[many] = np.partition(other, -near, axis=1)[:, -near] - room
                        best = score[i, j] >= cut[i]
                        i, j = i[best], j[best]
                    if len(i):
                        yield pa.RecordBatch.from_arrays([own.take(pa.array(i)), cell[0].take(pa.array(j)), pa.array(score[i, j].astype(np.float64)), pa.array(np.full(len(i), x.shape[1], np.int32))], names=names)

    # index rows come before the requests of their cell
    rows = marked(held, 0).union(marked(asked, 1)).repartition("part", "long", "cell").sortWithinPartitions("part", "long", "cell", "role")
    # neighbouring cells of a task must differ: their own places as a hash of 64 bits
    rows = rows.select(F.xxhash64("part", "long", "cell").alias("place"), "role", "mark", "id", "v")
    pairs = rows.mapInArrow(work, f"key {kind}, i_key {kind}, near double, long int").where(F.lit(itself) | (F.col("key") != F.col("i_key")))
    nth = F.max(F.when(F.col("n") == near, F.col("near"))).over(W.partitionBy("key"))
    ranked = pairs.withColumn("n", F.row_number().over(W.partitionBy("key").orderBy(F.desc("near"))))
    return ranked.withColumn("cut", nth).where(F.col("cut").isNull() | (F.col("near") >= F.col("cut") - ROUNDING - 2.4e-7 * F.col("long"))).select("key", "i_key").distinct()
