"""Check messages in, pongs, results, errors and history rows out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.plans import indicator_check
from lurewatch.schema import CHECK_MESSAGE
from lurewatch.sources import sinks


def asked(messages: DataFrame) -> DataFrame:
    """Add ``kind`` (pong, result, silent, error), ``input`` (of results), ``user_id`` and ``save``."""
    m = F.from_json("message", CHECK_MESSAGE)
    keys = F.coalesce(F.json_object_keys("message"), F.array().cast("array<string>"))
    is_check = (F.col("m.type") == "check_url") & F.array_contains(keys, "url")
    parsed = messages.withColumn("m", m).withColumn(
        "kind", F.when(F.col("m").isNull() | (F.size(keys) == 0), F.lit("error"))
        .when(F.col("m.type") == "ping", F.lit("pong"))
        .when(is_check & F.coalesce("m.analyze", F.lit(False)), F.lit("result"))
        .when(is_check, F.lit("silent")).otherwise(F.lit("error")))
    return parsed.withColumn("input", F.when(F.col("kind") == "result", F.col("m.url"))) \
        .withColumn("user_id", F.coalesce("m.user_id", F.lit(1).cast("bigint"))) \
        .withColumn("save", (F.col("kind") == "result")
                    & F.coalesce("m.saveToHistory", F.lit(False))).drop("m")


def respond(messages: DataFrame, reports: DataFrame, feed: DataFrame) -> DataFrame:
    """Messages with their kind and check result; works on a stream as well as on a table."""
    return indicator_check.check(asked(messages), reports, feed)


def writer(out: str, reports: str, feed: str) -> Callable[[DataFrame, int], None]:
    """Batch writer for messages: replies by kind, and the history rows to keep.

    Reports and feed are the paths of stored current rows (``indicator_check.deliver_reports``,
    ``deliver_feed``); a batch reads the buckets of its own inputs. Replies and history of a batch are
    replaced when it is repeated.
    """
    def write(batch: DataFrame, number: int) -> None:
        messages = asked(batch).persist()
        told = indicator_check.check_stored(messages, reports, feed).persist()
        told.write.mode("overwrite").partitionBy("kind").parquet(f"{out}/replies/batch={number}")
        sinks.append_history(told.filter("save").select(
            "id", F.col("input").alias("input_string"), "input_type", "is_malicious",
            "main_verdict", "community_score", "metadata", "vendor_analysis", "user_id",
            F.col("ts").alias("analysis_date")), f"{out}/history", number)
        told.unpersist()
        messages.unpersist()

    return write
