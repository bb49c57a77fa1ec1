"""Streams in several deliveries against their batch rule."""

import datetime as dt
import json

from pyspark.sql import functions as F

from lurewatch.operators import sessions, spacing
from lurewatch.streaming import check_stream, feedback, runner, windows

T0 = dt.datetime(2024, 1, 1)
KEYS = ["user_id", "feedback_type"]


def test_feedback_across_restarts(spark, tmp_path):
    rows = [(i, i % 2, "bug", T0 + dt.timedelta(seconds=17 * i)) for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, user_id bigint, feedback_type string, ts timestamp")
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for lo in range(0, 200, 50):
        df.filter((F.col("id") >= lo) & (F.col("id") < lo + 50)).write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source)
        runner.drain(feedback.accept(stream, KEYS, "ts", "id", 60), runner.to_folder(out), state)
    got = sorted(r["id"] for r in spark.read.parquet(out).collect())
    want = sorted(r["id"] for r in spacing.accepted_ids(df, KEYS, "ts", "id", 60).collect())
    assert got == want


def test_feedback_of_one_second_in_any_order(spark, tmp_path):
    at = lambda ms: T0 + dt.timedelta(milliseconds=ms)
    rows = [(2, 1, "bug", at(900)), (1, 1, "bug", at(100)), (3, 1, "bug", at(100)),
            (4, None, "bug", at(0)), (5, None, "bug", at(1))]
    df = spark.createDataFrame(rows, "id bigint, user_id bigint, feedback_type string, ts timestamp")
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    df.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    runner.drain(feedback.accept(stream, KEYS, "ts", "id", 60), runner.to_folder(out), state)
    got = sorted(r["id"] for r in spark.read.parquet(out).collect())
    marked = spacing.mark_accepted(df, KEYS, "ts", "id", 60).filter("accepted").collect()
    assert got == sorted(r["id"] for r in marked) == [1, 4, 5]


def test_check_messages(spark):
    messages = [{"type": "ping"}, {"type": "check_url", "url": "https://a/"},
                {"type": "check_url", "url": "https://a/", "analyze": True, "saveToHistory": True, "user_id": 9},
                {"type": "check_url", "url": "https://a/", "analyze": True}, {"type": "check_url"}, {"type": "x", "url": "u"}]
    rows = [(i, T0, json.dumps(m)) for i, m in enumerate(messages)] + [(6, T0, "{broken")]
    df = spark.createDataFrame(rows, "id bigint, ts timestamp, message string")
    reports = spark.createDataFrame(
        [("url", "https://a/", {"malicious": 1, "harmless": 2}, {"v1": ("malicious", "phishing site"), "v2": ("harmless", "clean")})],
        "indicator_type string, indicator string, last_analysis_stats map<string,bigint>, "
        "last_analysis_results map<string,struct<category:string,result:string>>")
    feed = spark.createDataFrame([], "url string, query_status string, threat string")
    got = {r["id"]: r for r in check_stream.respond(df, reports, feed).collect()}
    assert [got[i]["kind"] for i in range(7)] == ["pong", "silent", "result", "result", "error", "error", "error"]
    assert (got[2]["main_verdict"], got[2]["community_score"], got[2]["user_id"], got[2]["save"]) == ("phishing", "1/3", 9, True)
    assert (got[3]["user_id"], got[3]["save"]) == (1, False)


def test_rolling_window_drops_late_rows(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    day = lambda n: T0 + dt.timedelta(days=n)
    kind = "analysis_date timestamp, main_verdict string"
    for rows in ([(day(0), "safe"), (day(5), "phishing")], [(day(0), "safe"), (day(5), "safe")]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(kind).parquet(source)
        runner.drain(windows.rolling_verdicts(stream), runner.to_folder(out), state, "update")
    stored = spark.read.parquet(out).groupBy("check_date").agg(
        F.max_by(F.struct("safe_count", "phishing_count"), "batch").alias("c")).collect()
    assert {r["check_date"]: tuple(r["c"]) for r in stored} == {"2024-01-01": (1, 0), "2024-01-06": (1, 1)}


def test_session_windows_hold_every_request(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    at = lambda h: T0 + dt.timedelta(hours=h)
    kind = "user_id bigint, ts timestamp"
    # Sessions that go on over deliveries, are open at the end, or get a late request.
    parts = [[(1, at(0)), (1, at(20)), (2, at(5))], [(1, at(39)), (2, at(90)), (3, at(91))], [(2, at(6)), (3, at(92))]]
    for rows in parts:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(kind).parquet(source)
        runner.drain(windows.sliding_sessions(stream, "user_id", "ts"), runner.to_folder(out), state, "complete")
    columns = ["user_id", "started", "expires", "requests"]
    got = windows.last_batch(spark.read.parquet(out)).select(*columns).collect()
    every = spark.createDataFrame(sum(parts, []), kind)
    want = sessions.sliding_sessions(every, "user_id", "ts").select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert sum(r["requests"] for r in got) == len(sum(parts, []))
