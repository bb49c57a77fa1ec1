"""Long tables behind the CSV exports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurewatch.operators import curves, history, stats
from lurewatch.functions import verdicts


def export_history(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("id").alias("ID"), F.col("input_string").alias("URL"),
        F.when(F.col("is_malicious") == 1, F.lit("Suspicious")).otherwise(F.lit("Safe"))
        .alias("Result"),
        F.col("analysis_date").alias("Date"), F.col("metadata").alias("Details"),
        F.col("vendor_analysis").alias("Vendor Analysis")).orderBy(F.desc("Date"), F.desc("ID"))


def export_logs(activity: DataFrame, rows: DataFrame, users: DataFrame, as_of: dt.datetime,
                days: int = 90) -> DataFrame:
    """Activity rows, then analysis rows, each newest first, in five columns."""
    log = history.last_days(activity, as_of, days, "timestamp").select(
        F.lit("Activity").alias("Log Type"), F.col("username").alias("Username"),
        F.col("action").alias("Action/Input"), F.lit("").alias("Verdict"),
        F.col("timestamp").alias("Timestamp"))
    done = history.join_users(history.last_days(rows, as_of, days), users).select(
        F.lit("Analysis").alias("Log Type"), F.col("username").alias("Username"),
        F.col("input_string").alias("Action/Input"), F.col("main_verdict").alias("Verdict"),
        F.col("analysis_date").alias("Timestamp"))
    return log.unionByName(done).orderBy("Log Type", F.desc("Timestamp"))


def _plain(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


_STATS = [("Total Checks", "total_checks"), ("Total Threats", "threats_detected"),
          ("Phishing Detected", "phishing_count"), ("Malicious Detected", "malicious_count"),
          ("Suspicious Detected", "suspicious_count")]


def export_dashboard(df: DataFrame, recent: int = 50) -> DataFrame:
    """(user_id, section, ordinal, key, value) for every user, and the global section."""
    both = stats.user_and_global_stats(df)
    entries = [F.struct(F.lit(i + 1).alias("ordinal"), F.lit(label).alias("key"),
                        _plain(F.col(name)).alias("value")) for i, (label, name) in enumerate(_STATS)]
    entries.append(F.struct(F.lit(len(_STATS) + 1).alias("ordinal"),
                            F.lit("Threat Percentage").alias("key"),
                            F.concat(_plain(F.col("threat_percentage")), F.lit("%")).alias("value")))
    numbers = both.select(
        "user_id", F.when(F.col("is_global") == 1, F.lit("Global Statistics"))
        .otherwise(F.lit("User Statistics")).alias("section"),
        F.explode(F.array(*entries)).alias("e")).select("user_id", "section", "e.*")
    activity = history.recent_per_user(df, recent).select(
        "user_id", F.lit("Recent Activity").alias("section"), F.col("rank").alias("ordinal"),
        F.col("input_string").alias("key"),
        F.concat_ws(",", "main_verdict", F.date_format("analysis_date", "yyyy-MM-dd HH:mm:ss"))
        .alias("value"))
    return numbers.unionByName(activity)


def export_metrics(spark: SparkSession, df: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Sectioned model metrics: basic, ROC, PR, feature weights, evolution, vendor agreement."""
    line = lambda section, order, key, value: [
        F.lit(section).alias("section"), order.cast("double").alias("ordinal"),
        key.cast("string").alias("key"), value.cast("string").alias("value")]
    basic = stats.basic_metrics(df, as_of).select(F.explode(F.array(
        F.struct(*line("Basic Metrics", F.lit(1), F.lit("Total Checks"), F.col("total_checks"))),
        F.struct(*line("Basic Metrics", F.lit(2), F.lit("Detection Rate"),
                       F.format_string("%.2f", F.col("detection_rate") * 100))),
        F.struct(*line("Basic Metrics", F.lit(3), F.lit("Phishing Detected"),
                       F.col("phishing_detected"))))).alias("e")).select("e.*")
    scored = vendor_scores(df, as_of)
    return (
        basic
        .unionByName(curves.roc_points(scored).select(
            *line("ROC Curve Data", F.col("position"), F.col("fpr"), F.col("tpr"))))
        .unionByName(curves.pr_points(scored).select(
            *line("Precision-Recall Curve Data", F.col("threshold"), F.col("recall"),
                  F.col("precision"))))
        .unionByName(stats.feature_weights(spark).select(
            *line("Feature Importance Analysis", F.col("importance"), F.col("feature"),
                  F.col("importance"))))
        .unionByName(stats.model_evolution(df).select(
            *line("Model Performance Evolution", F.unix_date(F.col("check_day").cast("date")), F.col("check_day"),
                  F.col("detection_rate"))))
        .unionByName(stats.vendor_agreement(df, as_of).select(
            *line("Vendor Agreement Analysis", F.lit(0), F.col("agreement"), F.col("n")))))


def vendor_scores(df: DataFrame, as_of: dt.datetime, days: int = 30) -> DataFrame:
    """(score, label) rows: vendor confidence against the malicious flag; unreadable lists drop."""
    rows = history.last_days(df, as_of, days).filter(F.col("vendor_analysis").isNotNull())
    score = verdicts.confidence(verdicts.parse_vendors(F.col("vendor_analysis")))
    return rows.select(score.alias("score"), F.col("is_malicious").alias("label")).filter(
        F.col("score").isNotNull())
