"""Quality classifier: a generalised additive model with pairwise interactions.

Each document becomes a row of text statistics. Boosting goes round the features; every step fits a shallow
tree to the gradients of one feature's bins and adds it to that feature's lookup table, then the same is done
for the strongest pairs of features. A score is the sum of table entries at the document's bins.

Scoring is one narrow pass over all documents. The fit alone sees a bounded sample: about max_rows labelled rows at
most, chosen by hash of the id, whose ids (a bounded table) are sent to the tasks and whose statistics come back.

Nulls and empty texts are texts of no words and get a score like any other. Null ids are scored, never learned
from. Repeated rows are each scored. Of several labels of one document the smallest counts; null labels are
ignored. Without labels of both kinds every score is the share of label 1 seen (0.5 if none). Extra columns
of the input are not used, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small_batches

#: Labelled rows that the fit sees at most (about; a hash of the id chooses them).
MAX_ROWS = 60_000
BLOCK = 64  # words of the local windows
FEATURES = [
    "log_words", "mean_word", "upper", "digit", "symbol", "bar", "mark", "angle", "stop", "space", "high", "line_rate",
    "distinct", "top_word", "adjacent", "repeat5", "dup_lines", "entropy", "max_symbol", "max_bar", "max_mark", "max_upper",
    "max_adjacent", "min_distinct", "long_word", "short_word",
]

#: The class of each byte: 1 capitals, 2 digits, 3 symbols, 4 bars, 5 marks, 6 angles, 7 stops, 8 spaces, 9 small letters.
_CLASS = np.zeros(256, np.uint8)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&", b"|", b"!?", b"<>", b".,;:", b" \t\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz")):
    _CLASS[list(_chars)] = _k + 1
_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(256, _ODD, np.uint64))


def describe(text: str | None) -> list[float]:
    """The statistics of one whole text."""
    b = (text or "").encode("utf-8", "replace")
    a = np.frombuffer(b, np.uint8)
    kind = _CLASS[a]
    inside = kind != 8
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    size = edge[1::2] - edge[::2]
    n = len(size)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(a, minlength=256)
    share = np.bincount(kind, minlength=10)[1:9] / len(b)
    p = counts[counts > 0] / len(b)
    # words as numbers: a hash of each word's bytes, then its rank among the distinct ones
    first = np.cumsum(size) - size
    wb, wk = a[inside], kind[inside]
    place = np.arange(len(wb)) - np.repeat(first, size)
    _, seq = np.unique(np.add.reduceat((wb.astype(np.uint64) + np.uint64(1)) * _POWERS[place & 255], first) ^ size.astype(np.uint64), return_inverse=True)
    distinct = int(seq.max()) + 1
    same = np.zeros(n)
    same[1:] = seq[1:] == seq[:-1]
    five = 0.0
    if n >= 5:
        h = seq[: n - 4].astype(np.uint64)
        for j in range(1, 5):
            h = h * _ODD + seq[j : n - 4 + j].astype(np.uint64)
        five = 1 - len(np.unique(h)) / len(h)
    lines = [x for x in b.split(b"\n") if x.strip()]
    of = lambda k: np.add.reduceat(wk == k, first, dtype=np.int64)
    capitals = (of(1) > 0) & (of(9) == 0) & (size > 1)
    starts = np.arange(0, n, BLOCK)
    width = np.diff(np.append(starts, n))
    local = np.add.reduceat(np.column_stack([of(3) > 0, of(4) > 0, np.add.reduceat(wb == 33, first, dtype=np.int64) > 0, capitals, same]).astype(np.float64), starts, axis=0) / np.maximum(width, 16)[:, None]
    in_block = np.bincount(np.unique(np.arange(n) // BLOCK * distinct + seq) // distinct, minlength=len(starts)) / width
    return [
        float(np.log1p(n)), float(size.mean()), *share, counts[128:].sum() / len(b), len(lines) / n,
        distinct / n, float(np.bincount(seq).max() / n), float(same.mean()), five, 1 - len(set(lines)) / len(lines), float(-(p * np.log(p)).sum()),
        *local.max(axis=0), float(in_block[width >= 16].min(initial=1.0)), float((size > 20).mean()), float((size < 3).mean()),
    ]


def text_statistics(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and the array x of statistics, for every row, with more columns kept."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text", *more)
    kept = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in more)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [describe(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64())), *b.columns[2:]], names=["doc_id", "x", *more])

    return docs.mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>{kept}")


@dataclass
class Additive:
    """Bin edges by feature, one lookup table for each feature and one for each chosen pair."""

    edges: list[np.ndarray]
    base: float
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)])

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        z = np.full(len(x), self.base)
        if self.tables:
            b = self.bins(x)
            for k, t in enumerate(self.tables):
                z += t[b[:, k]]
            for i, j, to_i, to_j, t in self.pairs:
                z += t[to_i[b[:, i]], to_j[b[:, j]]]
        return 1 / (1 + np.exp(-z))


def _leaf(g, h, ridge=1.0):
    return g / (h + ridge)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """A shallow tree over ordered bins: cuts chosen greedily by gain; returns the value of each bin."""
    cuts = [0, len(g)]
    G, H = np.append(0, np.cumsum(g)), np.append(0, np.cumsum(h))
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                m = np.arange(a + 1, b)
                gl, hl, gr, hr = G[m] - G[a], H[m] - H[a], G[b] - G[m], H[b] - H[m]
                gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - (G[b] - G[a]) ** 2 / (H[b] - H[a] + 1)
                gain[(hl < 0.5) | (hr < 0.5)] = 0
                k = int(gain.argmax())
                best = max(best, (float(gain[k]), int(m[k])), key=lambda t: t[0])
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = _leaf(G[b] - G[a], H[b] - H[a])
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree of depth two over a grid of bins: one cut in each direction; gain and the value of each cell."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    if min(G.shape) < 2:
        return 0.0, np.zeros_like(g)
    a, c = G[:-1, :-1], H[:-1, :-1]
    gq = np.stack([a, G[:-1, -1:] - a, G[-1:, :-1] - a, G[-1, -1] - G[:-1, -1:] - G[-1:, :-1] + a])
    hq = np.stack([c, H[:-1, -1:] - c, H[-1:, :-1] - c, H[-1, -1] - H[:-1, -1:] - H[-1:, :-1] + c])
    gain = (gq**2 / (hq + 1)).sum(0) - G[-1, -1] ** 2 / (H[-1, -1] + 1)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    v = _leaf(gq[:, i, j], hq[:, i, j])
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, n_pairs: int = 6, rate: float = 0.15, max_bins: int = 48, pair_bins: int = 8) -> Additive:
    """Cyclic boosting of the features' tables, then of the strongest pairs' tables."""
    if len(y) == 0 or y.min() == y.max():
        p = 0.5 if len(y) == 0 else float(np.clip(y.mean(), 0.02, 0.98))
        return Additive([], float(np.log(p / (1 - p))))
    q = np.linspace(0, 1, max_bins + 1)[1:-1]
    edges = [np.unique(np.quantile(x[:, k], q, method="nearest")) for k in range(x.shape[1])]
    p = float(y.mean())
    m = Additive(edges, float(np.log(p / (1 - p))), [np.zeros(len(e) + 1) for e in edges])
    b, z = m.bins(x), np.full(len(y), float(np.log(p / (1 - p))))

    def gradients():
        s = 1 / (1 + np.exp(-z))
        return y - s, s * (1 - s)

    for _ in range(rounds):
        for k, t in enumerate(m.tables):
            g, h = gradients()
            step = rate * _tree(np.bincount(b[:, k], g, len(t)), np.bincount(b[:, k], h, len(t)))
            t += step
            z += step[b[:, k]]
    coarse = [(np.arange(len(e) + 1) * min(pair_bins, len(e) + 1)) // (len(e) + 1) for e in edges]
    sizes = [c[-1] + 1 for c in coarse]
    c = np.column_stack([coarse[k][b[:, k]] for k in range(len(edges))])
    g, h = gradients()
    grid = lambda i, j, v: np.bincount(c[:, i] * sizes[j] + c[:, j], v, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])
    ranked = sorted(((-_quadrants(grid(i, j, g), grid(i, j, h))[0], i, j) for i in range(len(edges)) for j in range(i)))[:n_pairs]
    m.pairs = [(i, j, coarse[i], coarse[j], np.zeros((sizes[i], sizes[j]))) for _, i, j in ranked]
    for _ in range(pair_rounds):
        for i, j, _, _, t in m.pairs:
            g, h = gradients()
            step = rate * _quadrants(grid(i, j, g), grid(i, j, h))[1]
            t += step
            z += step[c[:, i], c[:, j]]
    return m


def remainder(doc_id: str, by: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % by


def sampled_marks(labels: DataFrame, label: str, keep: Column, max_rows: int, pick=F.min) -> DataFrame:
    """(doc_id, y) of about max_rows labelled documents at most, by hash of the id; small enough to be sent to every task."""
    marks = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(keep).groupBy("doc_id").agg(pick(label).alias("y"))
    n = marks.count()
    return marks if n <= max_rows else marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Additive:
    """A model from the labelled documents of the learning folds; only their statistics reach the driver."""
    marks = sampled_marks(labels, "quality", remainder("doc_id", 5) != 0, max_rows)
    stats = text_statistics(docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id").withColumn("h", F.xxhash64("text")), "y", "h")
    # rows that repeat an id count as one, so that the bound on ids is one on rows
    stats = stats.groupBy("doc_id").agg(F.min_by(F.struct("x", "y"), F.struct("h", "x")).alias("r")).select("doc_id", "r.*")
    rows = stats.toPandas().sort_values("doc_id", kind="stable")
    return fit(np.array(rows.x.tolist(), float).reshape(-1, len(FEATURES)), rows.y.to_numpy(float))


def score_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """All columns of docs, and quality_score, in place of one that docs has: how likely label 1 is."""
    small_batches(docs.sparkSession)
    model = fit_quality(docs, labels, max_rows)

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([describe(t) for t in text], float).reshape(-1, len(FEATURES))))

    return docs.withColumn("quality_score", scored("text"))


def op1_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_quality(docs, read(spark, sf_dir, "labels")).select(
        "doc_id", (F.coalesce(remainder("doc_id", 5), F.lit(-1)) == 0).alias("held_out"), F.col("quality_score").alias("score")
    )
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
