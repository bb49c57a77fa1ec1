"""Append and export sinks."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.schema import HISTORY, align_schema


ROWS_PER_FILE = 1_000_000


def append_history(df: DataFrame, path: str, batch: str | int | None = None,
                   rows_per_file: int = ROWS_PER_FILE) -> None:
    """Append rows in the full history schema, in day folders so that date filters prune.

    A day gets as many files as its rows need, whatever the number of tasks that made them. A named batch
    replaces what the same batch wrote before, so it can be repeated.
    """
    rows = align_schema(df, HISTORY).withColumn("analysis_day", F.to_date("analysis_date"))
    rows = rows.persist(StorageLevel.DISK_ONLY)
    days = rows.groupBy(F.col("analysis_day").alias("_day")).agg(
        F.ceil(F.count("*") / rows_per_file).cast("int").alias("_files"))
    files = days.agg(F.sum("_files")).first()[0] or 0
    share = F.pmod(F.xxhash64("id", "input_string", "user_id", "analysis_date"), F.col("_files"))
    # One row per day: dates have less than four million values.
    packed = rows.join(F.broadcast(days), F.col("analysis_day").eqNullSafe(F.col("_day"))).withColumn(
        "_file", share).repartition(max(1, int(files)), "analysis_day", "_file")
    name = uuid.uuid4().hex if batch is None else batch
    packed.drop("_day", "_files", "_file").write.mode("overwrite").partitionBy("analysis_day").parquet(
        f"{path}/batch={name}")
    rows.unpersist()


def append_feedback(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Header and double-quote escaping, one file per partition in the frame's order."""
    df.write.mode("overwrite").csv(
        path, header=True, escape='"', timestampFormat="yyyy-MM-dd HH:mm:ss",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_mail_json(df: DataFrame, path: str) -> None:
    """Full mail payload next to the history row."""
    df.select("id", "body", F.col("html").alias("html_content"),
              F.col("links").alias("embedded_links"), "attachments").write.mode(
        "overwrite").json(path)
