"""Centroid clustering of integer vectors with geometrically tightened bounds, exact in every assignment.

Every vector keeps its cluster and a lower bound on its distance to all other centroids. When centroids move, that
bound must be loosened by as much as any other centroid can have come nearer. The usual loosening is the longest drift.
Here the vectors of cluster i are known to lie in a sphere around its centroid, and in the plane through that centre and
the old and new place of centroid j the cone of directions that come nearer by more than |drift| cos(t) has
half-angle t at the middle of the drift: a sphere seen from there under an angle of f from the drift, and itself a wide,
comes nearer by |drift| cos(f - a) at most, and not at all if f - a is a right angle or more. A vector whose exact distance to its own
centroid stays below the loosened bound keeps its cluster; all others are scanned against every centroid.

Vectors are handled in their tasks: a round is one narrow pass that writes the new state, and one aggregate with a row
for each task and cluster. The driver sees centroids, counts and radii only. Distances and sums are integers, bounds are
floating-point numbers with room for rounding, so the result is that of scanning everything.

Kept are vectors of exactly `size` components, none null or not finite. Components are floor(scale * x), held within
+-2**27 so that distances fit a long (larger ones count as that). Null ids are clustered, but become no first centroid as long as others
are there. Repeated rows are each clustered; of equal ids the smaller vector comes first as a centroid. Fewer than k vectors
make as many clusters; an empty table gives no rows. A sum of distances beyond a long is null. Other columns are not used, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small_batches, stage

#: Components are held within these bounds: 64 squared differences then fit a long.
LARGEST = 2**27
#: Below this, sums of 64 products are exact in double precision.
EXACT = 2**22
#: Room for rounding in the bounds: relative and absolute.
ROOM, STEP = 1e-9, 1e-6


def whole_vectors(values: pa.Array, size: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are kept and their components as 32-bit integers."""
    lengths = values.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == size)
    x = values.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, size)
    with np.errstate(over="ignore", invalid="ignore"):
        finite = np.isfinite(x).all(axis=1)
        return rows[finite], np.clip(np.floor(scale * x[finite]), -LARGEST, LARGEST).astype(np.int32)


def quantised(vectors: DataFrame, vec_id: str, vector: str, size: int, scale: float) -> DataFrame:
    """id and x (the components as little-endian 32-bit integers) of the vectors that are kept."""
    small_batches(vectors.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = whole_vectors(b.column(1), size, scale)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array([r.tobytes() for r in x.astype("<i4")], pa.binary())], names=["id", "x"])

    source = vectors.select(F.col(vec_id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return source.mapInArrow(work, f"id {source.schema['id'].dataType.simpleString()}, x binary")


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all centres."""
    if max(np.abs(x).max(initial=0), np.abs(centres).max(initial=0)) < EXACT:
        a, c = x.astype(np.float64), centres.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2.0 * (a @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centres], axis=1)


def assign(x: np.ndarray, centres: np.ndarray, cluster: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """cluster, squared distance, lower bound on the distance to the others, and whether the row was scanned.

    lower holds for these centres already; a cluster below 0 is not known yet."""
    cluster, lower = cluster.copy(), lower.copy()
    own = ((x - centres[np.maximum(cluster, 0)]) ** 2).sum(1)
    scan = (cluster < 0) | ~(np.sqrt(own) * (1 + ROOM) + STEP < lower)
    if scan.any():
        far = squared(x[scan], centres)
        best = far.argmin(1)  # the smaller number of equal ones
        rows = np.arange(len(far))
        own[scan], cluster[scan] = far[rows, best], best
        if len(centres) > 1:
            far[rows, best] = np.iinfo(np.int64).max
            lower[scan] = np.sqrt(far.min(1)) * (1 - ROOM)
        else:
            lower[scan] = np.inf
    return cluster, own, lower, scan


def coming_nearer(centre: np.ndarray, radius: float, old: np.ndarray, new: np.ndarray) -> float:
    """The most by which the distance from a point of the sphere to a centroid can shrink as it moves from old to new."""
    drift = new - old
    length = float(np.sqrt(drift @ drift))
    if not length:
        return 0.0
    seen = centre - (old + new) / 2
    far = float(np.sqrt(seen @ seen))
    if radius >= far:
        return length
    off_axis = np.arccos(np.clip(seen @ drift / (far * length), -1.0, 1.0))
    return length * float(np.cos(np.clip(off_axis - np.arcsin(radius / far), 0.0, np.pi / 2)))


def loosening(old: np.ndarray, new: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """For each cluster, how much its vectors' lower bounds lose: the most that any other centroid comes nearer."""
    a, b = old.astype(np.float64), new.astype(np.float64)
    moved = np.flatnonzero((a != b).any(axis=1))
    return np.array([max((coming_nearer(a[i], r, a[j], b[j]) for j in moved if j != i), default=0.0) * (1 + ROOM) + STEP for i, r in enumerate(radii)])


def _pass(state: DataFrame, centres: np.ndarray, lost: np.ndarray | None) -> DataFrame:
    """One assignment of every vector: id, x, cluster, distance, lower, scans."""
    size = centres.shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.frombuffer(b"".join(b.column(1).to_pylist()), "<i4").reshape(-1, size).astype(np.int64)
            if lost is None:
                cluster, lower, scans = np.full(len(x), -1, np.int32), np.zeros(len(x)), np.zeros(len(x), np.int32)
            else:
                cluster, lower, scans = (b.column(k).to_numpy() for k in (2, 4, 5))
                lower = lower - lost[cluster]
            cluster, own, lower, scanned = assign(x, centres, cluster, lower)
            cols = [pa.array(c) for c in (cluster.astype(np.int32), own, lower, (scans + scanned).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=["id", "x", "cluster", "distance", "lower", "scans"])

    return state.mapInArrow(work, f"id {state.schema['id'].dataType.simpleString()}, x binary, cluster int, distance long, lower double, scans int")


def _sums(state: DataFrame, size: int) -> list:
    """For each cluster: componentwise sums (s0, s1, ...), n, far (the largest squared distance) and inertia."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            x = np.frombuffer(b"".join(b.column(0).to_pylist()), "<i4").reshape(-1, size).astype(np.int64)
            cluster, far = b.column(1).to_numpy(), b.column(2).to_numpy()
            for c in np.unique(cluster):
                at = cluster == c
                s = sums.setdefault(int(c), [np.zeros(size, np.int64), 0, 0, 0])
                s[0] += x[at].sum(0)
                s[1:] = s[1] + int(at.sum()), max(s[2], int(far[at].max())), s[3] + sum(far[at].tolist())
        rows = list(sums.items())
        cols = [pa.array([c for c, _ in rows], pa.int32()), pa.array([s[0].tolist() for _, s in rows], pa.list_(pa.int64()))]
        cols += [pa.array([s[1] for _, s in rows], pa.int64()), pa.array([s[2] for _, s in rows], pa.int64()), pa.array([str(s[3]) for _, s in rows], pa.string())]
        yield pa.RecordBatch.from_arrays(cols, names=["cluster", "s", "n", "far", "inertia"])

    parts = state.select("x", "cluster", "distance").mapInArrow(work, "cluster int, s array<long>, n long, far long, inertia string")
    each = [F.sum(F.get("s", F.lit(j))).alias(f"s{j}") for j in range(size)]
    return parts.groupBy("cluster").agg(*each, F.sum("n").alias("n"), F.max("far").alias("far"), F.sum(F.col("inertia").cast("decimal(38,0)")).alias("inertia")).collect()


def first_centres(vectors: DataFrame, k: int, salt: str, size: int) -> np.ndarray:
    """The k vectors with the smallest hashes of salt and id, in that order."""
    by = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    rows = vectors.orderBy(by.asc_nulls_last(), "x").select("x").limit(k).collect()
    return np.array([np.frombuffer(r.x, "<i4") for r in rows], np.int64).reshape(-1, size)


def cluster_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 40, rounds: int = 5, size: int = 64, scale: float = 256.0, salt: str = "2:") -> tuple[DataFrame, np.ndarray, list]:
    """Vectors with cluster, distance (squared) and scans (assignments that looked at every centroid), written down; the
    final centroids; and for each cluster its sums, size, radius and inertia."""
    rows = quantised(vectors, vec_id, vector, size, scale)
    centres = first_centres(rows, k, salt, size)
    if not len(centres):
        return rows.select("id", "x", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0.0).alias("lower"), F.lit(0).alias("scans")), centres, []
    state = stage(_pass(rows, centres, None), "clusters")
    sums = _sums(state, size)
    for _ in range(rounds):
        moved, radii = centres.copy(), np.zeros(len(centres))
        for r in sums:
            moved[r.cluster] = [r[f"s{j}"] // r.n for j in range(size)]
            radii[r.cluster] = np.sqrt(r.far) * (1 + ROOM)
        state = stage(_pass(state, moved, loosening(centres, moved, radii)), "clusters")
        centres = moved
        sums = _sums(state, size)
    return state, centres, sums


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector."""
    state, centres, sums = cluster_vectors(read(spark, sf_dir, "embeddings"))
    fits = lambda n: n if n < 2**63 else None
    inertia = {r.cluster: int(r.inertia) for r in sums}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    of = lambda values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values]) if len(values) else F.array().cast(f"array<{kind}>"), F.col("cluster"))
    return state.select(
        F.col("id").alias("vec_id"), "cluster", "distance",
        of([fits(inertia.get(c, 0)) for c in range(len(centres))], "long").alias("cluster_inertia"),
        F.lit(fits(sum(inertia.values()))).cast("long").alias("inertia"),
        of(digest, "string").alias("centroid_sha256"),
    )


def _oracle(rounds: int = 5) -> str:
    """Plain scans of all centroids in every round."""
    steps = [
        """v AS MATERIALIZED (SELECT vec_id, x FROM (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM (
  SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: isfinite(e))) = 64))),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256(concat('2:', CAST(vec_id AS VARCHAR)))) - 1 AS INT) AS j, x AS c FROM v ORDER BY j LIMIT 40)"""
    ]
    for t in range(rounds + 1):
        steps.append(
            f"""a{t} AS MATERIALIZED (SELECT vec_id, any_value(x) AS x, arg_min(j, d * 1000 + j) AS j, min(d) AS d FROM (
  SELECT vec_id, x, j, list_sum(list_transform(x, lambda e, i: (e - c[i]) * (e - c[i])))::BIGINT AS d FROM v, c{t}) GROUP BY vec_id)"""
        )
        if t < rounds:
            steps.append(
                f"""m{t} AS MATERIALIZED (SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM (SELECT j, i, CAST(sum(e) AS BIGINT) AS s, count(*) AS n FROM (
  SELECT j, unnest(x) AS e, unnest(range(1, 65)) AS i FROM a{t}) GROUP BY j, i) GROUP BY j),
c{t + 1} AS MATERIALIZED (SELECT j, coalesce(m{t}.c, c{t}.c) AS c FROM c{t} LEFT JOIN m{t} USING (j))"""
            )
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, j AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (j)"""


ORACLE = _oracle()
