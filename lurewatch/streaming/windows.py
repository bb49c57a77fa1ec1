"""Event-time windows over history and activity streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.functions import fixed_values as fv


def rolling_verdicts(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Verdict counts per day; later rows than the delay are dropped."""
    counted = stream.withWatermark("analysis_date", delay).groupBy(
        F.window("analysis_date", "1 day").alias("w")).agg(
        *[F.count_if(F.col("main_verdict") == v).alias(f"{v}_count") for v in fv.VERDICT_ORDER])
    return counted.select(F.to_date("w.start").cast("string").alias("check_date"),
                          *[f"{v}_count" for v in fv.VERDICT_ORDER])


def last_days(written: DataFrame, as_of: dt.datetime, days: int = 7) -> DataFrame:
    """The trend of the last ``days`` days from the day counts that ``runner.to_folder`` wrote: of each day
    the newest batch; older days are not read further than their date."""
    since = (as_of - dt.timedelta(days=days)).strftime("%Y-%m-%d")
    counts = [f"{v}_count" for v in fv.VERDICT_ORDER]
    return written.filter(F.col("check_date") >= since).groupBy("check_date").agg(
        F.max_by(F.struct(*counts), "batch").alias("c")).select("check_date", "c.*")


def sliding_sessions(stream: DataFrame, user: str = "user_id", when: str = "timestamp",
                     gap: str = "1 day") -> DataFrame:
    """Sessions per user, open ones too; a request exactly one gap after the last opens a new one.

    For the mode "complete" (session windows have no update mode): every batch gives all sessions so far,
    no request is late, and the state holds one row per session.
    """
    return stream.groupBy(
        user, F.session_window(when, gap).alias("w")).agg(F.count("*").alias("requests")).select(
        user, F.col("w.start").alias("started"), F.col("w.end").alias("expires"), "requests")


def last_batch(written: DataFrame) -> DataFrame:
    """The rows of the newest batch that ``runner.to_folder`` wrote, in mode "complete" the whole result."""
    newest = written.agg(F.max("batch")).first()[0]
    return written.filter(F.col("batch") == newest).drop("batch")


def activity_rows(stream: DataFrame) -> DataFrame:
    """Login and logout events as activity log rows."""
    return stream.filter(F.col("action").isin("login", "logout")).select(
        "username", "action", "timestamp")
