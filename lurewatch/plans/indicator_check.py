"""Indicator strings to history rows: classify, look up, merge feeds, roll up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.operators import reputation
from lurewatch.sources import current


def check(inputs: DataFrame, reports: DataFrame, feed: DataFrame, column: str = "input",
          version: str = "key", reanalysis: bool = False) -> DataFrame:
    """One checked row per input row, with verdict and JSON columns.

    ``reports`` may hold several reports per indicator: the one of the greatest ``version`` counts.
    """
    typed = reputation.classify(inputs, column)
    newest = reputation.latest_reports(reports, version)
    known = reputation.join_reputation(typed, reputation.report_columns(newest))
    return reputation.store_columns(reputation.join_second_feed(known, feed), reanalysis)


def deliver_reports(reports: DataFrame, path: str, version: str = "key") -> None:
    """Merge arriving reports into the stored current ones."""
    rows, newest = reputation.current_reports(reports, version)
    current.put(rows, path, reputation.REPORT_KEYS, newest)


def deliver_feed(feed: DataFrame, path: str, version: str = "seen") -> None:
    """Merge arriving rows of the second feed into the stored current ones."""
    rows, newest = reputation.current_feed(feed, version)
    current.put(rows, path, reputation.FEED_KEYS, newest)


def check_stored(inputs: DataFrame, reports: str, feed: str, column: str = "input") -> DataFrame:
    """As ``check``, from the stored current rows of both feeds; only the buckets of the inputs are read."""
    typed = reputation.classify(inputs, column)
    asked = typed.select(F.col("input_type").alias("indicator_type"), F.col("normalized_input").alias("indicator"))
    urls = typed.filter("input_type = 'url'").select(F.col("normalized_input").alias("url"))
    known = reputation.join_reputation(typed, current.get(reports, asked, reputation.REPORT_KEYS))
    return reputation.store_columns(reputation.join_second_feed(
        known, current.get(feed, urls, reputation.FEED_KEYS)))
