"""Threat-data views derived from the driver's tables; every view covers its whole tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurewatch.functions import verdicts
from lurewatch.sources.tables import read_table, dealt

AS_OF = dt.datetime(2024, 1, 31, tzinfo=dt.timezone.utc)


def users(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    return read_table(spark, d, "customer").select(
        c.alias("id"),
        F.col("c_name").alias("username"),
        F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit(""))), F.lit("@example.com"))
        .alias("email"),
        (c % 50 == 0).alias("is_admin"),
        F.when(c % 3 == 0, F.md5(c.cast("string").cast("binary"))).alias("session_token"),
        (F.lit(dt.datetime(2024, 1, 16, tzinfo=dt.timezone.utc)) + F.make_dt_interval((c % 30 - 15).cast("int")))
        .alias("session_expiry"))


def vendors(spark: SparkSession, d: str) -> DataFrame:
    """Long form: one row per (report key, vendor)."""
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    category = (F.when(flag == "R", F.lit("malicious")).when(flag == "A", F.lit("suspicious"))
                .when(status == "F", F.lit("harmless")).otherwise(F.lit("undetected")))
    result = (F.when((flag == "R") & (F.col("l_linenumber") % 2 == 1), F.lit("phishing"))
              .when(flag == "R", F.lit("malware")).otherwise(F.lit("clean")))
    return read_table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("key"),
        F.concat(F.lit("vendor"), F.col("l_suppkey"), F.lit("_"), F.col("l_linenumber"))
        .alias("name"),
        category.alias("category"), result.alias("result"),
        verdicts.categorize(category, result).alias("verdict"))


def event_input(event_id: Column, user_id: Column) -> tuple[Column, Column]:
    """(input_type, input_string) of an event."""
    i = event_id.cast("string")
    kind = F.element_at(F.array(*[F.lit(t) for t in ("url", "domain", "ip", "hash", "email")]),
                        (event_id % 5 + 1).cast("int"))
    text = (
        F.when(event_id % 5 == 0, F.concat(F.lit("https://s"), event_id % 97,
                                           F.lit(".example.com/p/"), i))
        .when(event_id % 5 == 1, F.concat(F.lit("d"), event_id % 31, F.lit(".example.org")))
        .when(event_id % 5 == 2, F.concat(F.lit("10."), event_id % 256, F.lit("."),
                                          user_id % 256, F.lit(".7")))
        .when(event_id % 5 == 3, F.md5(i.cast("binary")))
        .otherwise(F.concat(F.lit("user"), user_id, F.lit("@example.net"))))
    return kind, text


def inputs(spark: SparkSession, d: str) -> DataFrame:
    """Indicator strings of all events and all page URLs."""
    kind, text = event_input(F.col("event_id"), F.col("user_id"))
    events = read_table(spark, d, "events").select(text.alias("input"))
    every = events.unionAll(read_table(spark, d, "pages").select(F.col("url").alias("input")))
    return dealt(every, "input")


def history_rows(spark: SparkSession, d: str) -> DataFrame:
    """History without the vendor columns: a pure projection of the events."""
    kind, text = event_input(F.col("event_id"), F.col("user_id"))
    event = F.col("event_type")
    verdict = (F.when(event == "click", F.lit("suspicious"))
               .when(event == "purchase", F.lit("malicious"))
               .when(event == "error", F.lit("phishing")).otherwise(F.lit("safe")))
    return read_table(spark, d, "events").select(
        F.col("event_id").alias("id"), text.alias("input_string"), kind.alias("input_type"),
        (verdict != "safe").cast("int").alias("is_malicious"), verdict.alias("main_verdict"),
        F.col("props").alias("metadata"), "user_id", F.col("ts").alias("analysis_date"))


def vendor_lists(spark: SparkSession, d: str) -> DataFrame:
    """One report row per key. A report lists each vendor once, as its JSON cell does."""
    return vendors(spark, d).groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("name", "verdict"))).alias("vendors"),
        F.count_if(F.col("verdict").isin("phishing", "malicious")).alias("bad"),
        F.count("*").alias("total"))


def history(spark: SparkSession, d: str) -> DataFrame:
    """Full history with the vendor JSON and the community score."""
    rows, reports = dealt(history_rows(spark, d), "id"), vendor_lists(spark, d)
    joined = rows.join(reports, rows["id"] == reports["key"], "left")
    return joined.select(
        *rows.columns,
        F.when(rows["id"] % 11 != 0, F.coalesce(F.to_json("vendors"), F.lit("[]")))
        .alias("vendor_analysis"),
        F.when(F.col("input_type") != "email", F.concat_ws(
            "/", F.coalesce("bad", F.lit(0)), F.coalesce("total", F.lit(0))))
        .alias("community_score"))


def activity(spark: SparkSession, d: str) -> DataFrame:
    people = users(spark, d).select(F.col("id").alias("uid"), "username", "is_admin")
    events = read_table(spark, d, "events").filter(F.col("event_type").isin("signup", "view"))
    return events.join(people, events["user_id"] == people["uid"]).select(
        F.col("event_id").alias("id"), "user_id", "username", "is_admin",
        F.when(F.col("event_type") == "signup", F.lit("login")).otherwise(F.lit("logout"))
        .alias("action"), F.col("ts").alias("timestamp"))


def account_events(spark: SparkSession, d: str) -> DataFrame:
    """Logins, logouts and, as every other event, requests of known users."""
    people = users(spark, d).select(F.col("id").alias("uid"), "username", "is_admin")
    events = read_table(spark, d, "events")
    kind = F.col("event_type")
    return events.join(people, events["user_id"] == people["uid"]).select(
        F.col("event_id").alias("id"), "user_id", "username", "is_admin",
        F.when(kind == "signup", F.lit("login")).when(kind == "view", F.lit("logout"))
        .otherwise(F.lit("request")).alias("action"), F.col("ts").alias("timestamp"))


def feedback_columns(events: DataFrame) -> DataFrame:
    event = F.col("event_type")
    return events.select(
        F.col("event_id").alias("id"), "user_id",
        F.when(event == "error", F.lit("bug_report"))
        .when(event == "purchase", F.lit("feature_request"))
        .otherwise(F.lit("general_feedback")).alias("feedback_type"),
        F.when(F.col("event_id") % 13 != 0,
               F.concat(F.lit("in"), F.col("event_id") % 3)).alias("input_string"),
        event.alias("message"), F.col("ts").alias("submission_date"))


def feedback(spark: SparkSession, d: str) -> DataFrame:
    return feedback_columns(read_table(spark, d, "events"))


def url_feedback(spark: SparkSession, d: str) -> DataFrame:
    kind, text = event_input(F.col("event_id"), F.col("user_id"))
    return read_table(spark, d, "events").select(
        F.col("event_id").alias("id"), text.alias("url"),
        (F.col("value") > 50).alias("original_prediction"),
        (F.col("value") > 40).alias("user_feedback"),
        F.col("user_id").cast("string").alias("user_id"), F.col("ts").alias("feedback_date"))


GREETINGS = ["Dear Customer,", "Hi Team,", ""]
LURES = ["Urgent: verify your account at http://10.0.0.1/login",
         "Your payment was received. Contact us.",
         "Click here https://bit.ly/x1",
         "Unsubscribe any time at https://news.example.com/u", ""]


def _choice(values: list[str], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (i % len(values) + 1).cast("int"))


def emails(spark: SparkSession, d: str, separable: bool = False) -> DataFrame:
    """E-mails around all documents; ``separable`` makes the lure follow the class.

    They are dealt out last: after a join, partitions are packed by their bytes, and the few that a mail
    job would get leave cores without work.
    """
    docs, labels = read_table(spark, d, "documents"), read_table(spark, d, "labels")
    pages = read_table(spark, d, "pages")
    n_pages = pages.agg(F.count("*").alias("n")).scalar()
    i = F.col("doc_id")
    by = F.when(F.col("toxic") == 1, F.lit(0)).otherwise(F.lit(3)) if separable else i
    joined = docs.join(labels.select(F.col("doc_id"), "toxic"), "doc_id", "left").withColumn(
        "page_no", i % n_pages)
    every = joined.join(pages, joined["page_no"] == pages["page_id"], "left")
    return dealt(every, "doc_id").select(
        i.alias("id"),
        F.concat_ws("\n", _choice(GREETINGS, i), "text", _choice(LURES, by),
                    F.when(i % 2 == 0, F.lit("Regards,")).otherwise(F.lit(""))).alias("body"),
        F.col("html").alias("html"),
        F.concat(F.lit("Mail "), i).alias("subject"),
        F.when(i % 7 == 0, F.concat(F.lit("support@shop"), i % 5, F.lit(".com")))
        .otherwise(F.concat(F.lit("user"), i, F.lit("@example.net"))).alias("sender"),
        F.col("toxic").alias("class"))


def second_feed(spark: SparkSession, d: str) -> DataFrame:
    kind, text = event_input(F.col("event_id"), F.col("user_id"))
    i = F.col("event_id")
    urls = read_table(spark, d, "events").filter(kind == "url")
    newest = urls.select(
        text.alias("url"),
        F.when(i % 3 == 0, F.lit("ok")).otherwise(F.lit("no_results")).alias("query_status"),
        F.when(i % 4 == 0, F.lit("malware_download")).when(i % 4 == 1, F.lit("none"))
        .alias("threat"), F.lit(2).alias("seen"))
    # Every other URL is listed twice; the older row says the opposite.
    older = urls.filter(i % 2 == 0).select(
        text.alias("url"), F.lit("ok").alias("query_status"), F.lit("phishing_kit").alias("threat"),
        F.lit(1).alias("seen"))
    return newest.unionByName(older)


def report_entries(spark: SparkSession, d: str) -> DataFrame:
    """One entry per (report, vendor): a vendor listed twice keeps its greatest entry."""
    return vendors(spark, d).groupBy("key", "name").agg(
        F.max(F.struct("category", "result")).alias("e")).select("key", "name", "e.*")


def reports(spark: SparkSession, d: str) -> DataFrame:
    """Vendor reports in their delivered JSON shape, one per event with vendor rows."""
    kind, text = event_input(F.col("event_id"), F.col("user_id"))
    heads = read_table(spark, d, "events").select(
        F.col("event_id").alias("key"), kind.alias("indicator_type"), text.alias("indicator"))
    lists = report_entries(spark, d).groupBy("key").agg(
        F.collect_list(F.struct("name", F.struct("category", "result"))).alias("results"),
        *[F.count_if(F.col("category") == c).alias(c)
          for c in ("malicious", "suspicious", "harmless", "undetected")])
    return heads.join(lists, "key").select(
        "key", "indicator_type", "indicator",
        F.create_map(*[x for c in ("malicious", "suspicious", "harmless", "undetected")
                       for x in (F.lit(c), F.col(c))]).alias("last_analysis_stats"),
        F.map_from_entries("results").alias("last_analysis_results"),
        F.when(F.col("indicator_type") == "url", F.concat("indicator", F.lit("/final")))
        .alias("last_final_url"),
        F.when(F.col("indicator_type") == "domain", F.lit("2020-01-01")).alias("creation_date"),
        F.when(F.col("indicator_type") == "ip", F.lit("SG")).alias("country"),
        F.when(F.col("indicator_type") == "hash", F.col("key")).alias("size"))


def check_message(events: DataFrame) -> DataFrame:
    """Message JSON of each event: ping, no analysis, missing url, or a full check."""
    kind, text = event_input(F.col("event_id"), F.col("user_id"))
    i = F.col("event_id")
    return events.select(
        i.alias("id"), F.col("ts"),
        F.to_json(F.struct(
            F.when(i % 7 == 0, F.lit("ping")).otherwise(F.lit("check_url")).alias("type"),
            F.when((i % 7 != 0) & (i % 7 != 2), text).alias("url"),
            F.when(i % 7 != 0, i % 7 != 1).alias("analyze"),
            F.when(i % 7 != 0, i % 2 == 0).alias("saveToHistory"),
            F.when((i % 7 != 0) & (i % 3 != 0), F.col("user_id")).alias("user_id")))
        .alias("message"))
