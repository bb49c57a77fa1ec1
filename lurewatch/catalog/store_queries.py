"""Registered queries that write with a sink and read the stored result back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lurewatch.catalog.history_queries import COUNTS
from lurewatch.catalog.registry import query
from lurewatch.catalog.stream_queries import HANDLER, spaced
from lurewatch.catalog.verdict_queries import INPUTS, list_rollup
from lurewatch.operators import mail, spacing
from lurewatch.plans import exports, indicator_check
from lurewatch.session import shared_path
from lurewatch.sources import fixtures as fx
from lurewatch.sources import sinks
from lurewatch.sources.tables import read_table, scan_history


@query("src_table", "SELECT event_id, user_id, event_type, ts FROM events")
def _(spark, d):
    return read_table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")


@query("snk_history_append", """
SELECT id, input_string, input_type, main_verdict, user_id, analysis_date, 'UTC' AS timezone FROM rows_fx
WHERE analysis_date >= TIMESTAMP '2024-01-10'""", "rows_fx")
def _(spark, d):
    path = shared_path(spark, "history")
    rows = fx.history_rows(spark, d)
    early = F.dayofmonth("analysis_date") <= 15
    sinks.append_history(rows.filter(early), path)
    sinks.append_history(rows.filter(~early), path)
    # The day folder bound prunes files; the time bound decides.
    return scan_history(spark, path).filter(
        (F.col("analysis_day") >= "2024-01-10") & (F.col("analysis_date") >= "2024-01-10")).select(
        "id", "input_string", "input_type", "main_verdict", "user_id", "analysis_date", "timezone")


@query("snk_history_batches", f"""
WITH {INPUTS}
SELECT id, input_string, is_malicious, main_verdict, user_id,
  CAST(CAST(analysis_date AS DATE) AS VARCHAR) AS day FROM rows_fx
UNION ALL SELECT -1 - m.id, m.input, CAST(m.is_malicious AS INTEGER), {list_rollup('vendors')}, r.user_id,
  '2024-01-31' FROM merged m JOIN rows_fx r ON r.id = m.id WHERE m.input_type = 'url'""",
       "rows_fx reports_fx second_fx")
def _(spark, d):
    path = shared_path(spark, "history")
    rows = fx.history_rows(spark, d)
    early = F.dayofmonth("analysis_date") <= 15
    for name, part in (("early", early), ("late", ~early), ("early", early)):
        sinks.append_history(rows.filter(part), path, name, 1000)
    again = rows.filter("input_type = 'url'").select("id", F.col("input_string").alias("input"), "user_id")
    checked = indicator_check.check(again, fx.reports(spark, d), fx.second_feed(spark, d), reanalysis=True)
    sinks.append_history(checked.select(
        (-1 - F.col("id")).alias("id"), F.col("input").alias("input_string"), "input_type", "is_malicious",
        "main_verdict", "community_score", "metadata", "vendor_analysis", "user_id",
        F.lit(fx.AS_OF).alias("analysis_date")), path, "again")
    return scan_history(spark, path).select(
        "id", "input_string", "is_malicious", "main_verdict", "user_id", F.col("analysis_day").cast("string").alias("day"))


@query("snk_feedback_append", spaced(
    "feedback_fx", [*HANDLER, "message"], 60, "submission_date") + """
SELECT f.id, f.user_id, f.feedback_type, f.message FROM feedback_fx f
WHERE f.input_string IS NULL OR f.id IN (SELECT id FROM ids)""", "feedback_fx")
def _(spark, d):
    path = shared_path(spark, "feedback")
    accepted = spacing.mark_accepted(
        fx.feedback(spark, d), [*HANDLER, "message"], "submission_date", "id", 60)
    sinks.append_feedback(accepted.filter("accepted").drop("accepted"), path)
    return spark.read.parquet(path).select("id", "user_id", "feedback_type", "message")


@query("snk_export_history", """
SELECT id AS "ID", input_string AS "URL", CASE WHEN is_malicious = 1 THEN 'Suspicious' ELSE 'Safe' END AS "Result",
  strftime(analysis_date, '%Y-%m-%d %H:%M:%S') AS "Date", metadata AS "Details",
  coalesce(vendor_analysis, '-') AS "Vendor Analysis" FROM history_fx""", "history_fx")
def _(spark, d):
    path = shared_path(spark, "export")
    sinks.write_csv(exports.export_history(fx.history(spark, d)), path)
    names = "ID bigint, URL string, Result string, Date string, Details string, `Vendor Analysis` string"
    return spark.read.schema(names).csv(path, header=True, escape='"', multiLine=True).fillna(
        "-", ["Vendor Analysis"])


@query("snk_export_logs", """
SELECT 'Activity' AS "Log Type", username AS "Username", action AS "Action/Input", '-' AS "Verdict",
  strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS "Timestamp" FROM activity_fx
UNION ALL SELECT 'Analysis', username, input_string, main_verdict, strftime(analysis_date, '%Y-%m-%d %H:%M:%S')
FROM rows_fx h JOIN users_fx u ON h.user_id = u.id""", "activity_fx rows_fx users_fx")
def _(spark, d):
    path = shared_path(spark, "logs")
    sinks.write_csv(exports.export_logs(fx.activity(spark, d), fx.history_rows(spark, d),
                                        fx.users(spark, d), fx.AS_OF), path)
    names = "`Log Type` string, Username string, `Action/Input` string, Verdict string, Timestamp string"
    return spark.read.schema(names).csv(path, header=True, escape='"').fillna("-", ["Verdict"])


NUMBERS = ["total_checks", "threats_detected", "phishing_count", "malicious_count", "suspicious_count"]
TITLES = ["Total Checks", "Total Threats", "Phishing Detected", "Malicious Detected", "Suspicious Detected"]
ENTRIES = ", ".join(f"{{'ordinal': {i + 1}, 'key': '{t}', 'value': CAST({n} AS VARCHAR)}}"
                    for i, (t, n) in enumerate(zip(TITLES, NUMBERS)))


@query("snk_export_dashboard", f"""
WITH both_levels AS (SELECT user_id, {COUNTS} FROM rows_fx GROUP BY ROLLUP (user_id)),
long_rows AS (SELECT user_id, unnest([{ENTRIES}, {{'ordinal': 6, 'key': 'Threat Percentage',
  'value': regexp_replace(CAST(threat_percentage AS VARCHAR), '\\.0$', '') || '%'}}]) AS e FROM both_levels),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY analysis_date DESC, id DESC) AS rank FROM rows_fx)
SELECT coalesce(CAST(user_id AS VARCHAR), 'all') AS user_id,
  CASE WHEN user_id IS NULL THEN 'Global Statistics' ELSE 'User Statistics' END AS section,
  CAST(e.ordinal AS INTEGER) AS ordinal, e.key AS key, e.value AS value FROM long_rows
UNION ALL SELECT CAST(user_id AS VARCHAR), 'Recent Activity', CAST(rank AS INTEGER), input_string,
  main_verdict || ',' || strftime(analysis_date, '%Y-%m-%d %H:%M:%S') FROM ranked WHERE rank <= 50""", "rows_fx")
def _(spark, d):
    path = shared_path(spark, "dashboard")
    sinks.write_csv(exports.export_dashboard(fx.history_rows(spark, d)), path)
    stored = spark.read.schema(
        "user_id string, section string, ordinal int, key string, value string").csv(
        path, header=True, escape='"')
    return stored.fillna("all", ["user_id"])


@query("snk_export_metrics")
def _(spark, d):
    path = shared_path(spark, "metrics")
    sinks.write_csv(exports.export_metrics(spark, fx.history(spark, d), fx.AS_OF), path)
    return spark.read.schema("section string, ordinal double, key string, value string").csv(
        path, header=True, escape='"')


@query("snk_email_json", """
SELECT id, body, html AS html_content, len(urls) AS n_links FROM raw_fx""", "raw_fx")
def _(spark, d):
    path = shared_path(spark, "payload")
    none = F.array().cast("array<struct<filename:string,size:bigint>>")
    sinks.write_mail_json(mail.with_links(fx.emails(spark, d)).withColumn("attachments", none), path)
    stored = spark.read.schema(
        "id bigint, body string, html_content string, embedded_links array<struct<url:string>>").json(path)
    return stored.select("id", "body", "html_content", F.size("embedded_links").cast("bigint").alias("n_links"))


@query("ml_email_to_history", """
SELECT id, left(body, 5000) AS input_string, 'email' AS input_type,
  CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS is_malicious,
  CASE WHEN id % 3 = 0 THEN 'phishing' ELSE 'safe' END AS main_verdict,
  CAST(json_object('subject', subject, 'sender', sender) AS VARCHAR) AS metadata, '[]' AS vendor_analysis
FROM email_fx""", "email_fx")
def _(spark, d):
    scored = fx.emails(spark, d).withColumn("is_phishing", F.col("id") % 3 == 0)
    return mail.to_history(scored).select(
        "id", "input_string", "input_type", "is_malicious", "main_verdict", "metadata", "vendor_analysis")
