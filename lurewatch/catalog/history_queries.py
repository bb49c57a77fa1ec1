"""Registered queries over history, users, activity and feedback."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from lurewatch import schema
from lurewatch.catalog.registry import query
from lurewatch.functions import verdicts
from lurewatch.operators import history, maintenance, stats
from lurewatch.plans import exports
from lurewatch.session import shared_path
from lurewatch.sources import deletes, sinks
from lurewatch.sources import fixtures as fx
from lurewatch.sources.tables import scan_history

COUNTS = """count(*) AS total_checks, count(*) FILTER (main_verdict <> 'safe') AS threats_detected,
  count(*) FILTER (main_verdict = 'phishing') AS phishing_count,
  count(*) FILTER (main_verdict = 'malicious') AS malicious_count,
  count(*) FILTER (main_verdict = 'suspicious') AS suspicious_count,
  count(*) FILTER (main_verdict = 'safe') AS safe_count,
  count(*) FILTER (main_verdict <> 'safe') / count(*) * 100 AS threat_percentage"""
FOUR = """count(*) FILTER (main_verdict = 'phishing') AS phishing_count,
  count(*) FILTER (main_verdict = 'malicious') AS malicious_count,
  count(*) FILTER (main_verdict = 'suspicious') AS suspicious_count,
  count(*) FILTER (main_verdict = 'safe') AS safe_count"""


@query("agg_user_stats", f"SELECT user_id, {COUNTS} FROM rows_fx GROUP BY user_id", "rows_fx")
def _(spark, d):
    return stats.user_stats(fx.history_rows(spark, d))


@query("agg_global_stats", f"SELECT {COUNTS} FROM rows_fx", "rows_fx")
def _(spark, d):
    return stats.global_stats(fx.history_rows(spark, d))


@query("agg_user_and_global_stats",
       f"SELECT coalesce(CAST(user_id AS VARCHAR), 'all') AS user_id, {COUNTS}, "
       "CAST(grouping(user_id) AS INTEGER) AS is_global FROM rows_fx "
       "GROUP BY ROLLUP (user_id)", "rows_fx")
def _(spark, d):
    both = stats.user_and_global_stats(fx.history_rows(spark, d))
    return both.withColumn("is_global", F.col("is_global").cast("int")).withColumn(
        "user_id", F.coalesce(F.col("user_id").cast("string"), F.lit("all")))


@query("agg_profile_stats", """
SELECT *, phishing_detected + malicious_detected + suspicious_detected AS total_threats,
  (phishing_detected + malicious_detected + suspicious_detected) / total_checks * 100 AS detection_rate
FROM (SELECT user_id, count(*) AS total_checks,
  count(*) FILTER (main_verdict = 'phishing') AS phishing_detected,
  count(*) FILTER (main_verdict = 'malicious') AS malicious_detected,
  count(*) FILTER (main_verdict = 'suspicious') AS suspicious_detected
  FROM rows_fx GROUP BY user_id)""", "rows_fx")
def _(spark, d):
    return stats.profile_stats(fx.history_rows(spark, d))


@query("agg_admin_metrics", f"""
SELECT *, phishing_count / greatest(total_analyses, 1) * 100 AS phishing_rate,
  malicious_count / greatest(total_analyses, 1) * 100 AS malicious_rate,
  suspicious_count / greatest(total_analyses, 1) * 100 AS suspicious_rate,
  safe_count / greatest(total_analyses, 1) * 100 AS safe_rate
FROM (SELECT count(*) AS total_analyses, {FOUR} FROM rows_fx
      WHERE analysis_date >= TIMESTAMP '2024-01-31' - INTERVAL 90 DAY)""", "rows_fx")
def _(spark, d):
    return stats.admin_metrics(fx.history_rows(spark, d), fx.AS_OF)


@query("agg_verdict_distribution", f"SELECT user_id, {FOUR} FROM rows_fx GROUP BY user_id", "rows_fx")
def _(spark, d):
    return stats.verdict_distribution(fx.history_rows(spark, d))


@query("agg_daily_trend", f"""
SELECT *, phishing_count + malicious_count + suspicious_count AS threat_series FROM (
  SELECT CAST(CAST(analysis_date AS DATE) AS VARCHAR) AS check_date, {FOUR} FROM rows_fx
  WHERE analysis_date >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY GROUP BY 1)""", "rows_fx")
def _(spark, d):
    return stats.daily_trend(fx.history_rows(spark, d), fx.AS_OF)


@query("agg_basic_metrics", """
SELECT count(*) AS total_checks, count(*) FILTER (is_malicious = 1) AS phishing_detected,
  coalesce(avg(CAST(is_malicious AS DOUBLE)), 0) AS detection_rate
FROM rows_fx WHERE analysis_date >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAY""", "rows_fx")
def _(spark, d):
    return stats.basic_metrics(fx.history_rows(spark, d), fx.AS_OF)


@query("agg_daily_detection", """
SELECT CAST(CAST(analysis_date AS DATE) AS VARCHAR) AS check_day, count(*) AS total_checks,
  count(*) FILTER (is_malicious = 1) AS phishing_detected
FROM rows_fx GROUP BY 1 ORDER BY 1 DESC LIMIT 30""", "rows_fx")
def _(spark, d):
    return stats.daily_detection(fx.history_rows(spark, d))


@query("agg_model_evolution", """
SELECT CAST(CAST(analysis_date AS DATE) AS VARCHAR) AS check_day, count(*) AS total_checks,
  avg(CAST(is_malicious AS DOUBLE)) AS detection_rate
FROM rows_fx GROUP BY 1 ORDER BY 1 DESC LIMIT 30""", "rows_fx")
def _(spark, d):
    return stats.model_evolution(fx.history_rows(spark, d))


@query("agg_url_feedback_stats", """
SELECT user_id, count(*) AS total_feedback,
  count(*) FILTER (original_prediction <> user_feedback) AS disagreements,
  count(*) FILTER (original_prediction = user_feedback) / count(*) AS agreement_rate
FROM url_feedback_fx GROUP BY user_id
UNION ALL
SELECT 'all', count(*), count(*) FILTER (original_prediction <> user_feedback),
  count(*) FILTER (original_prediction = user_feedback) / count(*) FROM url_feedback_fx""",
       "url_feedback_fx")
def _(spark, d):
    rows = fx.url_feedback(spark, d)
    overall = stats.url_feedback_stats(rows, by_user=False)
    return stats.url_feedback_stats(rows).unionByName(
        overall.withColumn("user_id", F.lit("all")))


@query("agg_feedback_by_type",
       "SELECT feedback_type, count(*) AS n FROM feedback_fx GROUP BY feedback_type", "feedback_fx")
def _(spark, d):
    return stats.feedback_by_type(fx.feedback(spark, d))


@query("flt_history", """
SELECT id, input_string, input_type, main_verdict, analysis_date, user_id FROM rows_fx
WHERE input_type = 'url' AND main_verdict = 'phishing'
  AND analysis_date >= TIMESTAMP '2024-01-05' AND analysis_date < TIMESTAMP '2024-01-20'""", "rows_fx")
def _(spark, d):
    return history.filter_history(
        fx.history_rows(spark, d), input_type="url", verdict="phishing",
        date_from="2024-01-05", date_to="2024-01-20").select(
        "id", "input_string", "input_type", "main_verdict", "analysis_date", "user_id")


@query("flt_rolling_window", """
SELECT id, user_id, main_verdict, analysis_date FROM rows_fx
WHERE analysis_date >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY""", "rows_fx")
def _(spark, d):
    return history.last_days(fx.history_rows(spark, d), fx.AS_OF, 7).select(
        "id", "user_id", "main_verdict", "analysis_date")


@query("lst_activity_log", """
SELECT username, action, timestamp FROM activity_fx
WHERE timestamp >= TIMESTAMP '2024-01-31' - INTERVAL 90 DAY""", "activity_fx")
def _(spark, d):
    return history.activity_log(fx.activity(spark, d), fx.AS_OF)


@query("flt_not_null_json",
       "SELECT id, vendor_analysis FROM history_fx WHERE vendor_analysis IS NOT NULL", "history_fx")
def _(spark, d):
    return history.with_json(fx.history(spark, d), "vendor_analysis").select("id", "vendor_analysis")


@query("flt_point_lookup", """
SELECT o.o_orderkey AS id, h.input_string, coalesce(h.metadata, '{}') AS metadata,
  CAST(len(coalesce(h.vendors, [])) AS INTEGER) AS n_vendors
FROM orders o LEFT JOIN history_fx h ON h.id = o.o_orderkey""", "history_fx")
def _(spark, d):
    wanted = spark.read.schema("o_orderkey bigint").parquet(f"{d}/orders.parquet").select(
        F.col("o_orderkey").alias("id"))
    found = history.lookup(fx.history(spark, d), wanted)
    return found.select("id", "input_string", F.coalesce("metadata", F.lit("{}")).alias("metadata"),
                        F.coalesce(F.size("vendors"), F.lit(0)).alias("n_vendors"))


@query("prj_case_label", """
SELECT id, username, email, is_admin,
  CASE WHEN session_token IS NOT NULL THEN 'Online' ELSE 'Offline' END AS status FROM users_fx""",
       "users_fx")
def _(spark, d):
    return maintenance.user_status(fx.users(spark, d))


@query("prj_result_view", """
SELECT id, input_string,
  coalesce(json_extract_string(metadata, '$.final_url'), 'N/A') AS final_url,
  coalesce(json_extract_string(metadata, '$.serving_ip'), 'N/A') AS serving_ip,
  upper(main_verdict[1]) || main_verdict[2:] AS verdict,
  CAST(len(coalesce(vendors, [])) AS BIGINT) AS total_vendors,
  CAST(len(list_filter(coalesce(vendors, []), lambda v: v.verdict <> 'clean')) AS BIGINT) AS malicious_detections,
  CASE WHEN len(coalesce(vendors, [])) > 0
       THEN len(list_filter(vendors, lambda v: v.verdict <> 'clean')) / len(vendors) ELSE 0 END AS probability,
  strftime(analysis_date + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') || ' +08' AS analysis_time,
  community_score
FROM history_fx""", "history_fx")
def _(spark, d):
    return history.result_view(fx.history(spark, d))


@query("upd_expire_sessions", """
SELECT id, username,
  CASE WHEN session_expiry >= TIMESTAMP '2024-01-16' THEN session_token END AS session_token,
  CASE WHEN session_expiry >= TIMESTAMP '2024-01-16' THEN session_expiry END AS session_expiry
FROM users_fx""", "users_fx")
def _(spark, d):
    as_of = dt.datetime(2024, 1, 16, tzinfo=dt.timezone.utc)
    return maintenance.expire_sessions(fx.users(spark, d), as_of).select(
        "id", "username", "session_token", "session_expiry")


@query("upd_expire_sessions_stored", """
SELECT id, username,
  CASE WHEN session_expiry >= TIMESTAMP '2024-01-16' THEN session_token END AS session_token,
  CASE WHEN session_expiry >= TIMESTAMP '2024-01-16' THEN session_expiry END AS session_expiry
FROM users_fx""", "users_fx")
def _(spark, d):
    path = shared_path(spark, "users")
    deletes.store_users(fx.users(spark, d), path, 0)
    deletes.expire_sessions(spark, path, dt.datetime(2024, 1, 16, tzinfo=dt.timezone.utc), 1)
    return spark.read.parquet(path).select("id", "username", "session_token", "session_expiry")


@query("del_history_of_users", """
SELECT id, input_string, user_id, analysis_date FROM rows_fx
WHERE user_id IS NULL OR user_id NOT IN (SELECT id FROM users_fx WHERE session_token IS NOT NULL)
  AND user_id NOT IN (SELECT id FROM users_fx WHERE is_admin)""", "rows_fx users_fx")
def _(spark, d):
    path, people = shared_path(spark, "history"), fx.users(spark, d)
    sinks.append_history(fx.history_rows(spark, d), path)
    # One deletion is folded into the files, the other one is still a mark.
    deletes.delete_users(spark, path, people.filter(F.col("session_token").isNotNull()))
    deletes.compact(spark, path)
    deletes.delete_users(spark, path, people.filter("is_admin"))
    return deletes.read_history(spark, path).select("id", "input_string", "user_id", "analysis_date")


@query("upd_schema_value", """
SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'machines' ELSE c_mktsegment END AS c_mktsegment
FROM customer""")
def _(spark, d):
    people = spark.read.schema("c_custkey bigint, c_mktsegment string").parquet(
        f"{d}/customer.parquet")
    return maintenance.rewrite_value(people, "c_mktsegment", "MACHINERY", "machines")


@query("src_schema_align", """
SELECT event_id AS id, 'https://s' || (event_id % 97) AS input_string, 'unknown' AS main_verdict,
  'UTC' AS timezone, user_id, ts AS analysis_date, TRUE AS score_missing
FROM events""")
def _(spark, d):
    from lurewatch.sources.tables import read_table

    old = read_table(spark, d, "events").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("https://s"), F.col("event_id") % 97).alias("url"), "user_id",
        F.col("ts").alias("analysis_date"))
    return schema.align_schema(old).select(
        "id", "input_string", "main_verdict", "timezone", "user_id", "analysis_date",
        F.col("confidence_score").isNull().alias("score_missing"))


@query("join_history_users", """
SELECT h.id, input_string, main_verdict, analysis_date, username
FROM rows_fx h JOIN users_fx u ON h.user_id = u.id
WHERE analysis_date >= TIMESTAMP '2024-01-31' - INTERVAL 90 DAY""", "rows_fx users_fx")
def _(spark, d):
    rows = history.last_days(fx.history_rows(spark, d), fx.AS_OF, 90)
    return history.join_users(rows, fx.users(spark, d)).select(
        "id", "input_string", "main_verdict", "analysis_date", "username").orderBy(
        F.desc("analysis_date"), F.desc("id"))


@query("join_anti_delete_user", """
SELECT 'history' AS source, id, user_id FROM rows_fx
WHERE user_id NOT IN (SELECT id FROM users_fx WHERE session_token IS NOT NULL)
UNION ALL SELECT 'feedback', id, user_id FROM feedback_fx
WHERE user_id NOT IN (SELECT id FROM users_fx WHERE session_token IS NOT NULL)
UNION ALL SELECT 'users', id, id FROM users_fx WHERE session_token IS NULL""",
       "rows_fx feedback_fx users_fx")
def _(spark, d):
    people = fx.users(spark, d)
    doomed = people.filter(F.col("session_token").isNotNull())

    def left(df, key, name):
        return maintenance.drop_users(df, doomed, key).select(
            F.lit(name).alias("source"), "id", F.col(key).alias("user_id"))

    return left(fx.history_rows(spark, d), "user_id", "history").unionAll(
        left(fx.feedback(spark, d), "user_id", "feedback")).unionAll(left(people, "id", "users"))


def _top(k):
    return f"""
SELECT user_id, id, input_string, main_verdict, analysis_date, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY analysis_date DESC, id DESC) AS INTEGER)
    AS rank FROM rows_fx) WHERE rank <= {k}"""


@query("top_recent_user", _top(5), "rows_fx")
def _(spark, d):
    return history.recent_per_user(fx.history_rows(spark, d), 5).select(
        "user_id", "id", "input_string", "main_verdict", "analysis_date", "rank")


@query("top_recent_user_dashboard", _top(50), "rows_fx")
def _(spark, d):
    return history.recent_per_user(fx.history_rows(spark, d), 50).select(
        "user_id", "id", "input_string", "main_verdict", "analysis_date", "rank")


@query("top_latest_per_input", """
SELECT input_string, max(analysis_date) AS analysis_date,
  arg_max(main_verdict, struct_pack(a := analysis_date, b := id)) AS main_verdict FROM rows_fx
GROUP BY input_string""", "rows_fx")
def _(spark, d):
    return history.latest_per_input(fx.history_rows(spark, d)).select(
        "input_string", "analysis_date", "main_verdict")


@query("top_metadata_100", """
SELECT id, metadata, CAST(json_extract(metadata, '$.k') AS BIGINT) AS k, analysis_date FROM rows_fx
WHERE metadata IS NOT NULL ORDER BY analysis_date DESC, id DESC LIMIT 100""", "rows_fx")
def _(spark, d):
    return history.newest_with_metadata(fx.history_rows(spark, d)).select(
        "id", "metadata", F.get_json_object("metadata", "$.k").cast("bigint").alias("k"),
        "analysis_date")


@query("srt_history",
       "SELECT id, input_string, main_verdict, analysis_date FROM rows_fx ORDER BY main_verdict, id DESC",
       "rows_fx")
def _(spark, d):
    return history.sort_history(
        fx.history_rows(spark, d).select("id", "input_string", "main_verdict", "analysis_date"),
        "main_verdict", "asc")


@query("srt_users", "SELECT username, id FROM users_fx ORDER BY username", "users_fx")
def _(spark, d):
    return fx.users(spark, d).select("username", "id").orderBy("username")


@query("srt_vendors", """
SELECT id, array_to_string(list_transform(vendors, lambda v: v.name), '|') AS vendor_names FROM history_fx
WHERE vendors IS NOT NULL""", "history_fx")
def _(spark, d):
    rows = history.with_json(fx.history(spark, d), "vendor_analysis")
    names = F.array_sort(F.transform(
        verdicts.parse_vendors(F.col("vendor_analysis")), lambda v: v["name"]))
    return rows.select("id", F.array_join(names, "|").alias("vendor_names"))


def _page(extra, number, per, source):
    return f"""
SELECT *, (SELECT count(*) FROM {source}) AS total,
  CAST(ceil((SELECT count(*) FROM {source}) / {per}) AS BIGINT) AS pages,
  CAST({(number - 1) * per + 1} AS BIGINT) AS first_row,
  least(CAST({number * per} AS BIGINT), (SELECT count(*) FROM {source})) AS last_row
FROM (SELECT {extra} FROM {source} ORDER BY analysis_date DESC, id DESC
      LIMIT {per} OFFSET {(number - 1) * per})"""


@query("lim_page_history", "WITH picked AS (SELECT * FROM rows_fx WHERE main_verdict = 'phishing') "
       + _page("id, input_string, analysis_date", 3, 10, "picked"), "rows_fx")
def _(spark, d):
    rows = history.filter_history(fx.history_rows(spark, d), verdict="phishing")
    return history.page_by_time(rows.select("id", "input_string", "analysis_date"), 3, 10)


@query("lim_page_admin", "WITH picked AS (SELECT h.id, input_string, main_verdict, analysis_date, username "
       "FROM rows_fx h JOIN users_fx u ON h.user_id = u.id "
       "WHERE analysis_date >= TIMESTAMP '2024-01-31' - INTERVAL 90 DAY) "
       + _page("id, input_string, main_verdict, analysis_date, username", 2, 25, "picked"),
       "rows_fx users_fx")
def _(spark, d):
    rows = history.join_users(history.last_days(fx.history_rows(spark, d), fx.AS_OF, 90),
                              fx.users(spark, d))
    return history.page_by_time(
        rows.select("id", "input_string", "main_verdict", "analysis_date", "username"), 2, 25)


@query("lim_page_deep", _page("id, input_string, analysis_date", 37, 20, "rows_fx"), "rows_fx")
def _(spark, d):
    path = shared_path(spark, "history")
    sinks.append_history(fx.history_rows(spark, d), path)
    return history.page_by_time(scan_history(spark, path), 37, 20, most=50).select(
        "id", "input_string", "analysis_date", "total", "pages", "first_row", "last_row")


@query("set_export_logs", """
SELECT 'Activity' AS "Log Type", username AS "Username", action AS "Action/Input", '' AS "Verdict",
  timestamp AS "Timestamp" FROM activity_fx WHERE timestamp >= TIMESTAMP '2024-01-31' - INTERVAL 90 DAY
UNION ALL SELECT 'Analysis', username, input_string, main_verdict, analysis_date
FROM rows_fx h JOIN users_fx u ON h.user_id = u.id
WHERE analysis_date >= TIMESTAMP '2024-01-31' - INTERVAL 90 DAY""", "rows_fx users_fx activity_fx")
def _(spark, d):
    return exports.export_logs(fx.activity(spark, d), fx.history_rows(spark, d),
                               fx.users(spark, d), fx.AS_OF)
