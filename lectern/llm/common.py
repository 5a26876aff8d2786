"""What the operators of this subpackage share: reading, staging in the shared folder, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch handed to Python; a batch of very long documents stays small.
BATCH_ROWS, BATCH_BYTES = "2000", "16m"
#: A key that holds more than one in so many rows is common; fewer keys than this can be.
COMMON = 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers hold. Plans are run after the operator has returned, so the session keeps these two settings."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where none is set, a temporary one if driver and executors are one process, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def spent_shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Writes begun inside remove their shuffle files when they are done, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends there, every executor can read it."""
    path = shared_path(df.sparkSession, name)
    with spent_shuffles_go(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_one(rows: DataFrame, ones: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of rows with ones, which has one row for each key and n_rows, how many rows have it; n_rows goes.

    total is at least the number of rows, so fewer than COMMON keys hold more than total / COMMON of them. Those are
    broadcast and their rows stay where they are; only rows of other keys are shuffled to meet theirs.
    """
    most = total // COMMON
    common, others = ones.where(F.col("n_rows") > most).drop("n_rows"), ones.where(F.col("n_rows") <= most).drop("n_rows")
    rest = rows.join(F.broadcast(common.select(key)), key, "left_anti")
    return rows.join(F.broadcast(common), key).unionByName(rest.join(others, key))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges by alternating large-star and small-star.

    Returns (node, component), component being the smallest node reachable, for each node that has an edge to
    another node. Each round is two grouped minima with map-side combine and two joins on the node; no group
    is ever collected, and the edges of a hub stay divided (with_one). Rounds end when a round leaves the edge set as it was.
    """
    both = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    cur = stage(both, "edges")
    mark, size = None, cur.count()
    for _ in range(max_rounds):
        # large star: each larger neighbour of a node points to the node's smallest neighbour
        sym = cur.union(cur.select("v", "u")).toDF("n", "m")
        low = sym.groupBy("n").agg(F.min("m").alias("lo"), F.count("*").alias("n_rows")).select("n", F.least("n", "lo").alias("lo"), "n_rows")
        large = with_one(sym.where("m > n"), low, "n", 2 * size).select(F.col("m").alias("u"), F.col("lo").alias("v")).where("u <> v").distinct()
        # small star: a node and its smaller neighbours point to the smallest of them
        low2 = large.groupBy("u").agg(F.min("v").alias("lo"), F.count("*").alias("n_rows"))
        small = with_one(large, low2, "u", 2 * size).select(F.col("v").alias("u"), F.col("lo").alias("v")).where("u <> v")
        nxt = small.union(low2.select("u", F.col("lo").alias("v"))).distinct()
        cur = stage(nxt, "edges")
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == now:
            break
        mark, size = now, now[0]
    else:
        raise RuntimeError("components did not settle")
    return cur.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
