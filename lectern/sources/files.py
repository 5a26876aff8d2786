"""Text files in, reports and derived tables out."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; where none is set, in a temporary one if driver and executors are one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers hold. Plans are run after the operator has returned, so the session keeps these two settings."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, however many plans read it."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ingest_text_files(spark: SparkSession, path: str, max_bytes: int = 60_000_000, min_chars: int = 20) -> DataFrame:
    """Whole .txt files as rows; too large ones and nearly empty ones are left out before and after they are decoded."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(path)
    text = files.where(F.col("length") <= max_bytes).select("path", F.decode("content", "UTF-8").alias("text"), "length")
    return text.where(F.length("text") >= min_chars)


def write_chunks(df: DataFrame, path: str, key: str = "plan_id", order: str = "chunk_index") -> None:
    """Replace the chunks of the plans that df has, each plan's in order; other plans stay as they are."""
    rows = df.repartition(key).sortWithinPartitions(key, order)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def export_course_report(plans: DataFrame, lessons: DataFrame, path: str) -> None:
    """One line of text for each live plan: its head (id, title, owner, number of lessons), then its lessons by day with status,
    quiz count, summary, notes and content. lessons: lesson_id, plan_id, day_number, title, status, questions, summary,
    notes (an array), content."""
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    icon = F.when(F.col("status") == "completed", "✅").when(F.col("status") == "in-progress", "🔓").otherwise("🔒")
    line = F.concat(
        F.lit("day "), F.col("day_number").cast("string"), F.lit(": "), icon, F.lit(" "), flat(F.col("title")), F.lit("; quiz "), F.coalesce("questions", F.lit(0)).cast("string"), F.lit("; summary: "), flat(F.col("summary")),
        F.lit("; notes: "), F.array_join(F.transform(F.coalesce("notes", F.array().cast("array<string>")), flat), ", "), F.lit("; content: "), flat(F.col("content")),
    )
    rows = lessons.select("plan_id", "day_number", "lesson_id", line.alias("line")).groupBy("plan_id")
    days = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("day_number", "lesson_id", "line"))), lambda x: x["line"]).alias("days"))
    live = plans.where("not is_deleted").select("plan_id", "title", "owner_id").join(days, "plan_id", "left").withColumn("days", F.coalesce("days", F.array().cast("array<string>")))
    head = F.concat(F.lit("plan "), F.col("plan_id").cast("string"), F.lit(" "), flat(F.col("title")), F.lit(", owner "), F.coalesce(F.col("owner_id").cast("string"), F.lit("N/A")), F.lit(", lessons "), F.size("days").cast("string"))
    live.select(F.array_join(F.concat(F.array(head), "days"), " | ").alias("value")).write.mode("overwrite").text(path)


def reset_table(spark: SparkSession, path: str, schema: StructType) -> None:
    """An empty table of the same schema."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
