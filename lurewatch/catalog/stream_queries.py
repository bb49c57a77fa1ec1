"""Registered queries over streams and over the order-dependent rules they share with batch jobs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lurewatch.catalog.registry import query
from lurewatch.catalog.verdict_queries import INPUTS, list_rollup
from lurewatch.operators import sessions, spacing
from lurewatch.plans import indicator_check
from lurewatch.session import pin, shared_path
from lurewatch.sources import fixtures as fx
from lurewatch.sources.tables import COLUMNS, read_table
from lurewatch.streaming import check_stream, feedback, runner, windows
from lurewatch.streaming import sessions as stream_sessions

SIX_HOURS = 6 * 3600


def spaced(source: str, keys: list[str], horizon: int, when: str) -> str:
    """Recursive rule: first second of a key, then the first one a horizon after the last kept."""
    on = " AND ".join(f"s.{k} = t.{k}" for k in keys)
    names = ", ".join(keys)
    own = ", ".join(f"s.{k}" for k in keys)
    filled = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    return f"""
WITH RECURSIVE s AS MATERIALIZED (SELECT {names}, CAST(floor(epoch({when})) AS BIGINT) AS sec, arg_min(id, ({when}, id)) AS id
  FROM {source} WHERE {filled} GROUP BY ALL),
nxt AS MATERIALIZED (SELECT {own}, s.sec, min(t.sec) AS next_sec FROM s LEFT JOIN s t ON {on} AND t.sec >= s.sec + {horizon}
  GROUP BY ALL),
kept AS (SELECT {names}, min(sec) AS sec FROM s GROUP BY ALL
  UNION ALL SELECT {', '.join(f'k.{x}' for x in keys)}, n.next_sec FROM kept k JOIN nxt n
    ON {' AND '.join(f'k.{x} = n.{x}' for x in keys)} AND k.sec = n.sec WHERE n.next_sec IS NOT NULL),
ids AS (SELECT s.id FROM s JOIN kept k ON {' AND '.join(f's.{x} = k.{x}' for x in keys)} AND s.sec = k.sec)"""


HANDLER = ["user_id", "feedback_type", "input_string"]
MARKED = """
SELECT f.id, f.input_string IS NULL OR f.id IN (SELECT id FROM ids) AS accepted FROM feedback_fx f"""


@query("st_feedback_dedup", spaced("feedback_fx", HANDLER, SIX_HOURS, "submission_date") + MARKED,
       "feedback_fx")
def _(spark, d):
    marked = spacing.mark_accepted(fx.feedback(spark, d), HANDLER, "submission_date", "id", SIX_HOURS)
    return marked.select("id", "accepted")


@query("st_feedback_dedup_route", spaced("feedback_fx", [*HANDLER, "message"], 60, "submission_date") + MARKED,
       "feedback_fx")
def _(spark, d):
    marked = spacing.mark_accepted(fx.feedback(spark, d), [*HANDLER, "message"], "submission_date", "id", 60)
    return marked.select("id", "accepted")


@query("st_feedback_dedup_type", spaced("feedback_fx", ["feedback_type"], 3600, "submission_date")
       + "SELECT id FROM ids", "feedback_fx")
def _(spark, d):
    # Few, dense keys: every decision hangs on the previous chunk's.
    return spacing.accepted_ids(fx.feedback(spark, d), ["feedback_type"], "submission_date", "id", 3600)


@query("st_feedback_dedup_stream", spaced("feedback_fx", HANDLER, SIX_HOURS, "submission_date")
       + "SELECT id FROM ids UNION ALL SELECT id FROM feedback_fx WHERE input_string IS NULL", "feedback_fx")
def _(spark, d):
    source, out, state = (shared_path(spark, n) for n in ("feedback", "accepted", "state"))
    rows = fx.feedback(spark, d)
    schema = rows.schema
    day = F.dayofmonth("submission_date")
    # Three deliveries; each run goes on from the state the one before it left.
    for part in (day <= 10, (day > 10) & (day <= 20), day > 20):
        rows.filter(part).write.mode("append").parquet(source)
        stream = pin(spark).readStream.schema(schema).parquet(source)
        accepted = feedback.accept(stream, HANDLER, "submission_date", "id", SIX_HOURS)
        runner.drain(accepted, runner.to_folder(out), state)
    return spark.read.parquet(out).select("id")


SLIDING_SESSION = """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 1 DAY THEN 0 ELSE 1 END AS fresh
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS started, max(ts) AS last_request,
  count(*) AS requests, max(ts) + INTERVAL 1 DAY AS expires FROM n GROUP BY user_id, session"""


@query("st_sliding_session", SLIDING_SESSION)
def _(spark, d):
    return sessions.sliding_sessions(read_table(spark, d, "events"), "user_id", "ts")


SINGLE_SESSION = spaced("logins", ["user_id", "logouts"], 86400, "timestamp").replace(
    "WITH RECURSIVE", """WITH RECURSIVE counted AS (SELECT *, CAST(sum(CASE WHEN action = 'logout' THEN 1 ELSE 0 END)
  OVER (PARTITION BY user_id ORDER BY floor(epoch(timestamp)), id) AS BIGINT) AS logouts FROM activity_fx),
logins AS (SELECT * FROM counted WHERE action = 'login' AND NOT is_admin),""") + """
SELECT id, username, CASE WHEN action = 'logout' THEN 'logout' WHEN is_admin OR id IN (SELECT id FROM ids)
  THEN 'accepted' ELSE 'refused' END AS outcome FROM activity_fx"""


@query("st_single_session", SINGLE_SESSION, "activity_fx")
def _(spark, d):
    return sessions.single_session(fx.activity(spark, d)).select("id", "username", "outcome")


def delivered(spark, rows, when: str, judge, mode: str = "append"):
    """Deliver ``rows`` in three parts to a stream that goes on from its state; what it wrote."""
    source, out, state = (shared_path(spark, n) for n in ("delivered", "told", "state"))
    schema, day = rows.schema, F.dayofmonth(when)
    for part in (day <= 10, (day > 10) & (day <= 20), day > 20):
        rows.filter(part).write.mode("append").parquet(source)
        stream = pin(spark).readStream.schema(schema).parquet(source)
        runner.drain(judge(stream), runner.to_folder(out), state, mode)
    return spark.read.parquet(out)


@query("st_single_session_stream", SINGLE_SESSION, "activity_fx")
def _(spark, d):
    # A name is an account here.
    told = delivered(spark, fx.activity(spark, d), "timestamp",
                     lambda s: stream_sessions.account_outcomes(s, "username"), "update")
    return told.select("id", "username", "outcome")


# The account's state is walked event by event: a session ends a day after its last login or valid request.
ACCOUNT_OUTCOMES = """
WITH RECURSIVE e AS MATERIALIZED (SELECT id, user_id, is_admin, action, CAST(floor(epoch(timestamp)) AS BIGINT) AS sec,
  row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(timestamp)), id) AS n FROM account_fx),
walk AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, '' AS outcome,
    CAST(NULL AS BIGINT) AS expiry FROM e
  UNION ALL SELECT user_id, n, id, outcome, CASE WHEN outcome IN ('accepted', 'valid') THEN sec + 86400
      WHEN outcome = 'logout' THEN NULL ELSE expiry END
  FROM (SELECT e.user_id, e.n, e.id, e.sec, w.expiry, CASE WHEN e.action = 'logout' THEN 'logout'
      WHEN e.action = 'login' THEN CASE WHEN e.is_admin OR w.expiry IS NULL OR e.sec >= w.expiry THEN 'accepted' ELSE 'refused' END
      WHEN e.sec <= w.expiry THEN 'valid' ELSE 'invalid' END AS outcome
    FROM walk w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1))
SELECT id, user_id, outcome FROM walk WHERE n > 0"""


@query("st_single_session_requests", ACCOUNT_OUTCOMES, "account_fx")
def _(spark, d):
    return sessions.account_outcomes(fx.account_events(spark, d)).select("id", "user_id", "outcome")


@query("st_single_session_requests_stream", ACCOUNT_OUTCOMES, "account_fx")
def _(spark, d):
    told = delivered(spark, fx.account_events(spark, d), "timestamp", stream_sessions.account_outcomes, "update")
    return told.select("id", "user_id", "outcome")


def events_stream(spark, d):
    return pin(spark).readStream.schema(COLUMNS["events"]).parquet(f"{d}/events*.parquet")


def answered(spark, d):
    """Folder with the replies and history rows of all messages; the reports arrive in two deliveries."""
    out, reports, feed = (shared_path(spark, n) for n in ("checks", "reports", "feed"))
    every = fx.reports(spark, d)
    for part in (F.col("key") % 2 == 0, F.col("key") % 2 == 1):
        indicator_check.deliver_reports(every.filter(part), reports)
    indicator_check.deliver_feed(fx.second_feed(spark, d), feed)
    runner.drain(fx.check_message(events_stream(spark, d)), check_stream.writer(out, reports, feed),
                 shared_path(spark, "state"))
    return out


CHECK = f"""
WITH {INPUTS},
m AS (SELECT event_id AS id, CASE WHEN event_id % 7 = 0 THEN 'pong' WHEN event_id % 7 = 2 THEN 'error'
  WHEN event_id % 7 = 1 THEN 'silent' ELSE 'result' END AS kind,
  CASE WHEN event_id % 7 <> 0 AND event_id % 3 <> 0 THEN user_id ELSE 1 END AS user_id,
  event_id % 7 > 2 AND event_id % 2 = 0 AS save FROM events)"""


@query("st_check_stream", CHECK + f"""
SELECT m.id, kind, m.user_id, save, CASE WHEN kind = 'result' THEN {list_rollup('vendors')} ELSE 'safe' END
  AS main_verdict FROM m JOIN merged ON m.id = merged.id""", "rows_fx reports_fx second_fx")
def _(spark, d):
    return spark.read.parquet(f"{answered(spark, d)}/replies").select("id", "kind", "user_id", "save", "main_verdict")


@query("st_check_stream_history", CHECK + f"""
SELECT m.id, input AS input_string, input_type, m.user_id, {list_rollup('vendors')} AS main_verdict
FROM m JOIN merged ON m.id = merged.id WHERE save""", "rows_fx reports_fx second_fx")
def _(spark, d):
    return spark.read.parquet(f"{answered(spark, d)}/history").select(
        "id", "input_string", "input_type", "user_id", "main_verdict")


@query("st_check_batch", CHECK + f"""
SELECT m.id, kind, m.user_id, save, CASE WHEN kind = 'result' THEN {list_rollup('vendors')} ELSE 'safe' END
  AS main_verdict FROM m JOIN merged ON m.id = merged.id""", "rows_fx reports_fx second_fx")
def _(spark, d):
    replies = check_stream.respond(
        fx.check_message(read_table(spark, d, "events")),
        fx.reports(spark, d), fx.second_feed(spark, d))
    return replies.select("id", "kind", "user_id", "save", "main_verdict")


@query("st_activity_log", "SELECT username, action, timestamp FROM activity_fx", "activity_fx")
def _(spark, d):
    out = shared_path(spark, "activity")
    people = fx.users(spark, d).select(F.col("id").alias("uid"), "username")
    kind = F.col("event_type")
    stream = events_stream(spark, d).join(people, F.col("user_id") == F.col("uid")).select(
        "username", F.when(kind == "signup", F.lit("login")).when(kind == "view", F.lit("logout"))
        .alias("action"), F.col("ts").alias("timestamp"))
    runner.drain(windows.activity_rows(stream), runner.to_folder(out), shared_path(spark, "state"))
    return spark.read.parquet(out).select("username", "action", "timestamp")


@query("st_rolling_metrics", """
SELECT CAST(CAST(analysis_date AS DATE) AS VARCHAR) AS check_date,
  count(*) FILTER (main_verdict = 'phishing') AS phishing_count, count(*) FILTER (main_verdict = 'malicious') AS malicious_count,
  count(*) FILTER (main_verdict = 'suspicious') AS suspicious_count, count(*) FILTER (main_verdict = 'safe') AS safe_count
FROM rows_fx GROUP BY 1""", "rows_fx")
def _(spark, d):
    out = shared_path(spark, "rolling")
    rows = events_stream(spark, d).select(
        F.col("ts").alias("analysis_date"),
        F.when(F.col("event_type") == "click", F.lit("suspicious"))
        .when(F.col("event_type") == "purchase", F.lit("malicious"))
        .when(F.col("event_type") == "error", F.lit("phishing")).otherwise(F.lit("safe"))
        .alias("main_verdict"))
    runner.drain(windows.rolling_verdicts(rows), runner.to_folder(out), shared_path(spark, "state"), "update")
    # Every batch writes the days it changed; the last word on a day is its latest batch.
    latest = F.row_number().over(Window.partitionBy("check_date").orderBy(F.desc("batch")))
    return spark.read.parquet(out).withColumn("n", latest).filter("n = 1").drop("n", "batch")


@query("st_rolling_metrics_week", """
SELECT CAST(CAST(analysis_date AS DATE) AS VARCHAR) AS check_date,
  count(*) FILTER (main_verdict = 'phishing') AS phishing_count, count(*) FILTER (main_verdict = 'malicious') AS malicious_count,
  count(*) FILTER (main_verdict = 'suspicious') AS suspicious_count, count(*) FILTER (main_verdict = 'safe') AS safe_count
FROM rows_fx WHERE analysis_date >= DATE '2024-01-31' - INTERVAL 7 DAY GROUP BY 1""", "rows_fx")
def _(spark, d):
    told = delivered(spark, fx.history_rows(spark, d).select("analysis_date", "main_verdict"), "analysis_date",
                     windows.rolling_verdicts, "update")
    return windows.last_days(told, fx.AS_OF)


@query("st_sliding_session_stream", SLIDING_SESSION)
def _(spark, d):
    told = delivered(spark, read_table(spark, d, "events"), "ts",
                     lambda s: stream_sessions.sliding_sessions(s, "user_id", "ts"), "update")
    found = stream_sessions.newest(told)
    along = Window.partitionBy("user_id").orderBy("started")
    return found.withColumn("session", F.row_number().over(along).cast("bigint"))
