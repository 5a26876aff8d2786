"""Structured Streaming forms of the per-request counters and folds, and a sink that a replayed batch does not change."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StructField, StructType

from ..sources.files import shared_path


def rolling_downloads(stream: DataFrame, key: str, ts: str = "ts", size: str = "7 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """Rows of each key in sliding windows; rows later than the watermark are dropped."""
    w = F.window(F.col(ts).cast("timestamp"), size, slide)
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(key, w).agg(F.count("*").alias("n")).select(key, F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


def topic_memory(stream: DataFrame) -> DataFrame:
    """How often each user met each topic."""
    return stream.groupBy("user_id", "topic").agg(F.count("*").alias("n"))


#: The user_id of rows that only move the watermark.
NOBODY = -1
#: What a null is while it waits.
UNKNOWN = -(1 << 63)


#: Groups of learners' courses that are folded together, so that a micro-batch costs a few calls for state for each group, not for each course.
GROUPS = 1024


class _Progress(StatefulProcessor):
    """Of a group of learners' courses, by (user_id, plan_id): the rounded average, the number of quizzes and the unrounded one, and the
    submissions that the watermark has not passed yet. Each is one value of packed columns. A timer at the earliest submission folds, in
    order of time, all that it has passed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("progress", "keys binary, values binary")
        self.waiting = handle.getValueState("waiting", "rows binary")

    def _rest(self) -> np.ndarray:
        """user_id, plan_id, at, submission_id and pct of what waits."""
        return np.frombuffer(bytes(self.waiting.get()[0]), np.int64).reshape(-1, 5) if self.waiting.exists() else np.zeros((0, 5), np.int64)

    def _wait(self, rows: np.ndarray) -> None:
        if len(rows):
            self.waiting.update((rows.tobytes(),))
            self.handle.registerTimer(int(rows[:, 2].min()) // 1000)
        else:
            self.waiting.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [r[["user_id", "plan_id", "at", "submission_id", "pct"]].to_numpy(np.int64) for r in rows]
        self._wait(np.concatenate([self._rest(), *new]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting = self._rest()
        passed = waiting[:, 2] // 1000 < timerValues.getCurrentWatermarkInMs()
        due = waiting[passed]
        if not len(due):  # an earlier timer of this watermark has folded them
            return
        course: dict[tuple[int, int], tuple[float, float, float]] = {}
        if self.state.exists():
            keys, values = self.state.get()
            course = dict(zip(map(tuple, np.frombuffer(bytes(keys), np.int64).reshape(-1, 2).tolist()), map(tuple, np.frombuffer(bytes(values), np.float64).reshape(-1, 3).tolist())))
        met = {}
        for user, plan, _, _, pct in due[np.lexsort((due[:, 4], due[:, 3], due[:, 2]))].tolist():
            avg, n, raw = course.get((user, plan), (0.0, 0.0, 0.0))
            raw = (avg * n + pct) / (n + 1)
            course[user, plan] = met[user, plan] = (float(int(raw + 0.5)), n + 1, raw)
        self.state.update((np.array(list(course), np.int64).tobytes(), np.array(list(course.values()), np.float64).tobytes()))
        self._wait(waiting[~passed])
        levels = ["EXPERT" if raw >= 85 else "BEGINNER" if raw < 60 else "INTERMEDIATE" for _, _, raw in met.values()]
        users, plans = zip(*met)
        yield pd.DataFrame({"user_id": users, "plan_id": plans, "average_score": [a for a, _, _ in met.values()], "quizzes": [int(n) for _, n, _ in met.values()], "level": levels})

    def close(self) -> None:
        pass


def running_progress(stream: DataFrame, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """The running rounded average of every learner's course, with its level, after each group of submissions that the watermark
    passes. Submissions count in order of time, whatever order they come in, as long as they are not later than the
    watermark; rows of NOBODY only move the watermark (a filter before it would be pushed below it, and they would not). Needs
    the RocksDB state store."""
    rows = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    dealt = F.pmod(F.xxhash64("user_id", "plan_id"), F.lit(GROUPS)).cast("int").alias("dealt")
    rows = rows.select(dealt, *[F.coalesce(F.col(c).cast("long"), F.lit(UNKNOWN)).alias(c) for c in ("user_id", "plan_id")], ts, F.unix_micros(ts).alias("at"), F.col("submission_id").cast("long").alias("submission_id"), F.col("pct").cast("long").alias("pct"))
    folded = rows.groupBy("dealt").transformWithStateInPandas(
        statefulProcessor=_Progress(), outputStructType="user_id long, plan_id long, average_score double, quizzes long, level string", outputMode="Update", timeMode="EventTime"
    )
    known = [F.nullif(c, F.lit(UNKNOWN)).alias(c) for c in ("user_id", "plan_id")]
    return folded.select(*known, "average_score", "quizzes", "level").where(F.col("user_id") != NOBODY)


def ingest_once(stream: DataFrame, owner: str, text: str, ts: str, late: str = "1 day") -> DataFrame:
    """Documents whose owner has not sent the same text before, within the watermark."""
    hashed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withColumn("content_hash", F.md5(text))
    return hashed.withWatermark(ts, late).dropDuplicatesWithinWatermark([owner, "content_hash"])


class KeptOnce:
    """A folder that holds, for each key, the row of smallest id that any batch has brought. A batch writes a part under its
    own number and only what the other parts lack, so a batch that is run again replaces its part and changes nothing."""

    def __init__(self, path: str, keys: list[str], order: str):
        self.path, self.keys, self.order = path, keys, order

    def _parts(self, spark, schema) -> DataFrame:
        return spark.read.schema(schema).option("basePath", self.path).parquet(self.path)

    def write(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch."""
        spark = batch.sparkSession
        first = batch.groupBy(*self.keys).agg(F.min(self.order).alias(self.order))
        known = None
        if spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(self.path)):
            known = self._parts(spark, StructType([*first.schema.fields, StructField("part", IntegerType())])).where(F.col("part") != number).groupBy(*self.keys).agg(F.min(self.order).alias("_known"))
        new = first if known is None else first.join(known, self.keys, "left").where(f"_known is null or {self.order} < _known").drop("_known")
        new.write.mode("overwrite").parquet(f"{self.path}/part={number}")

    def read(self, spark, schema) -> DataFrame:
        return self._parts(spark, schema).groupBy(*self.keys).agg(F.min(self.order).alias(self.order))


def ingest_into(stream: DataFrame, owner: str, text: str, key: str, checkpoint: str, sink: KeptOnce) -> None:
    """Each owner's documents into the sink, each text once, under the smallest key that it came with."""
    rows = stream.select(owner, F.md5(text).alias("content_hash"), key)
    rows.writeStream.foreachBatch(sink.write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def replay(df: DataFrame, slots: int = 4, ts: str | None = None) -> tuple[DataFrame, str, str]:
    """A stream over the rows of df in so many groups of micro-batches, by how much a row can be late, and the stream's folder. With ts the groups
    follow time, but half of the rows come one group late; without, rows come in any order."""
    spark, path, late = df.sparkSession, shared_path(df.sparkSession, "replay"), "0 seconds"
    mixed = F.xxhash64(*[F.col(c) for c, t in df.dtypes if not t.startswith("map")])
    number = F.pmod(mixed, F.lit(slots)).cast("int")
    if ts:
        at = F.unix_micros(F.col(ts).cast("timestamp"))
        low, high = df.agg(F.min(at), F.max(at)).first()
        step = max(1, ((high or 0) - (low or 0)) // slots + 1)
        number = F.least(F.lit(slots - 1), F.floor((at - F.lit(low or 0)) / step).cast("int") + F.pmod(mixed, F.lit(2)).cast("int"))
        late = f"{2 * step // 1_000_000 + 2} seconds"
    for k in range(slots):  # one after another: a file source takes older files first
        df.where(number == k).write.parquet(f"{path}/slot{k}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 8).option("recursiveFileLookup", "true").parquet(path), late, path


def drain(stream: DataFrame, mode: str = "update", place: str | None = None) -> DataFrame:
    """Run a stream over all that is there; what each micro-batch emitted, with its number as batch. Written to the shared folder under the
    batch's number, so that a batch that is run again replaces what it wrote. With the same place a later call goes on from an earlier one."""
    spark = stream.sparkSession
    place = place or shared_path(spark, "stream")
    out = f"{place}/out"
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        put = lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")
        stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    there = spark._jvm.org.apache.hadoop.fs.Path(out)
    schema = StructType([*stream.schema.fields, StructField("batch", IntegerType())])
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(out)


def drain_to_the_end(stream: DataFrame, ends: list[DataFrame], folder: str) -> DataFrame:
    """drain, then the rows of each of ends put into the stream's folder and drained on their own: the watermark that one of them moves is
    in force for the next one's batch, so with two of a far day all that waits for the watermark comes out."""
    place = shared_path(stream.sparkSession, "stream")
    out = drain(stream, place=place)
    for k, end in enumerate(ends):
        end.write.parquet(f"{folder}/end{k}")
        out = drain(stream, place=place)
    return out


def latest(emitted: DataFrame, keys: list[str]) -> DataFrame:
    """The last that an updating stream emitted for each key."""
    rest = [c for c in emitted.columns if c not in (*keys, "batch")]
    return emitted.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")
