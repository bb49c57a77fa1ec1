"""Read the stored tables with explicit schemas (no inference, UTC timestamps)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lurewatch.session import pin

COLUMNS = {
    "customer": "c_custkey bigint, c_name string",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, "
              "props string",
    "lineitem": "l_orderkey bigint, l_suppkey bigint, l_linenumber int, l_returnflag string, "
                "l_linestatus string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "pages": "page_id bigint, url string, html string",
}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return pin(spark).read.schema(COLUMNS[name]).parquet(f"{folder}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Deal rows out by a key, into as many partitions as shuffles have.

    For tables that arrive as one unsplittable file; the plan is the same for every size.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def scan_history(spark: SparkSession, path: str) -> DataFrame:
    """History as written by ``sinks.append_history``: day folders prune date filters."""
    return pin(spark).read.parquet(path).drop("batch")
