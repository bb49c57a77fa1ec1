"""Deletions of stored history rows: marks beside the days, folded in by a compaction.

``delete_rows`` writes one mark per row to delete, in folders of its day; ``read_history`` leaves marked
rows out; ``compact`` rewrites the folders of days that hold marks, and no others.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurewatch.operators import maintenance
from lurewatch.session import pin, shared_path
from lurewatch.sources import current

PLACE = ["batch", "analysis_day", "id"]
NO_DAY = dt.date(1, 1, 1)


def _marks_path(path: str) -> str:
    return f"{path.rstrip('/')}-deleted"


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return pin(spark).read.parquet(path).withColumn("batch", F.col("batch").cast("string"))


def _marks(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema("batch string, id bigint, analysis_day date").parquet(_marks_path(path))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _same(left: str, right: str) -> Column:
    out = F.lit(True)
    for c in PLACE:
        out = out & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def _unmarked(rows: DataFrame, marks: DataFrame) -> DataFrame:
    return rows.alias("r").join(marks.distinct().alias("m"), _same("r", "m"), "left_anti")


def delete_rows(rows: DataFrame, path: str) -> None:
    """Mark rows of the stored history (batch, analysis_day, id) as deleted; marking twice changes nothing."""
    rows.select(F.col("batch").cast("string").alias("batch"), "id", "analysis_day").write.mode("append").partitionBy("analysis_day").parquet(
        _marks_path(path))


def delete_users(spark: SparkSession, path: str, doomed: DataFrame) -> None:
    """Delete the stored history of users; rows without an owner stay."""
    rows = _rows(spark, path)
    mine = rows.join(doomed.select(F.col("id").alias("_id")).distinct(), F.col("user_id") == F.col("_id"), "left_semi")
    delete_rows(mine, path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The stored history without the deleted rows."""
    rows, marks = _rows(spark, path), _marks(spark, path)
    return (rows if marks is None else _unmarked(rows, marks)).drop("batch")


def compact(spark: SparkSession, path: str) -> list:
    """Rewrite the days that hold marks, without the marked rows; the days that were rewritten.

    A folder of which no row is left cannot be overwritten by nothing: its marks stay. Readers that run
    meanwhile see a marked row in neither form.
    """
    marks = _marks(spark, path)
    if marks is None:
        return []
    days = sorted((r[0] for r in marks.select("analysis_day").distinct().collect()), key=lambda d: d or NO_DAY)
    dated = [d for d in days if d is not None]
    wanted = F.col("analysis_day").isin(dated) if dated else F.lit(False)
    if len(dated) < len(days):
        wanted = wanted | F.col("analysis_day").isNull()
    kept = _unmarked(_rows(spark, path).filter(wanted), marks)
    scratch = shared_path(spark, "compacted")
    kept.write.partitionBy("batch", "analysis_day").parquet(scratch)
    spark.read.schema(kept.schema).parquet(scratch).repartition("batch", "analysis_day").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("batch", "analysis_day").parquet(path)
    rest = shared_path(spark, "marks")
    _marks(spark, path).alias("m").join(_rows(spark, path).filter(wanted).select(*PLACE).alias("r"), _same("m", "r"),
                                        "left_semi").write.parquet(rest)
    spark.read.schema("batch string, id bigint, analysis_day date").parquet(rest).write.mode("overwrite").partitionBy(
        "analysis_day").parquet(_marks_path(path))
    return dated


USER_KEYS = ["id"]


def store_users(users: DataFrame, path: str, version: int) -> None:
    """Merge users into the stored current ones; the greatest ``version`` of a user counts."""
    current.put(users.withColumn("version", F.lit(version)), path, USER_KEYS, ["version"])


def expire_sessions(spark: SparkSession, path: str, as_of: dt.datetime, version: int) -> None:
    """End the sessions that expired before ``as_of``: only the buckets of such users are rewritten."""
    users = spark.read.parquet(path).drop(current.BUCKET, "version")
    over = users.filter(F.col("session_expiry") < F.lit(as_of))
    store_users(maintenance.expire_sessions(over, as_of), path, version)
