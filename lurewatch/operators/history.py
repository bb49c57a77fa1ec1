"""History queries: filters, windows of time, look-ups, top-k, sorting and paging."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lurewatch.functions import verdicts
from lurewatch.functions.strings import to_local_time

SORTABLE = ("input_string", "input_type", "main_verdict", "analysis_date")


def filter_history(
    df: DataFrame,
    user_id: int | None = None,
    input_type: str = "all",
    verdict: str = "all",
    date_from: str | None = None,
    date_to: str | None = None,
) -> DataFrame:
    """Conjunction of the filters that are set. A date-only ``date_to`` excludes that day."""
    if user_id is not None:
        df = df.filter(F.col("user_id") == user_id)
    if input_type != "all":
        df = df.filter(F.col("input_type") == input_type)
    if verdict != "all":
        df = df.filter(F.col("main_verdict") == verdict)
    if date_from:
        df = df.filter(F.col("analysis_date") >= F.to_timestamp(F.lit(date_from)))
    if date_to:
        upper = F.to_timestamp(F.lit(date_to))
        when = F.col("analysis_date")
        df = df.filter(when < upper if len(date_to) == 10 else when <= upper)
    return df


def last_days(df: DataFrame, as_of: dt.datetime, days: int, when: str = "analysis_date",
              whole_days: bool = False) -> DataFrame:
    """Rows of the last ``days`` days before ``as_of``; the bound is a literal, so it pushes down."""
    if whole_days:
        as_of = as_of.replace(hour=0, minute=0, second=0, microsecond=0)
    return df.filter(F.col(when) >= F.lit(as_of - dt.timedelta(days=days)))


def activity_log(df: DataFrame, as_of: dt.datetime, days: int = 90) -> DataFrame:
    return last_days(df, as_of, days, "timestamp").select("username", "action", "timestamp") \
        .orderBy(F.desc("timestamp"), "username", "action")


def with_json(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull())


def details(df: DataFrame) -> DataFrame:
    """Row details with parsed JSON; missing JSON counts as empty."""
    vendors = verdicts.vendors_or_empty(F.col("vendor_analysis"))
    return df.withColumn("vendors", vendors).withColumn(
        "metadata", F.coalesce("metadata", F.lit("{}")))


def lookup(df: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    """History rows for the wanted keys; keys without a row stay, with empty fields."""
    return wanted.join(details(df), key, "left")


def result_view(df: DataFrame) -> DataFrame:
    """Result card fields of each row."""
    vendors = verdicts.vendors_or_empty(F.col("vendor_analysis"))
    staged = df.withColumn("vendors", vendors)
    total, bad = F.size("vendors"), verdicts.flagged_count(F.col("vendors"))
    shown = F.date_format("analysis_date", "yyyy-MM-dd HH:mm:ss")
    return staged.select(
        "id", "input_string",
        F.coalesce(F.get_json_object("metadata", "$.final_url"), F.lit("N/A")).alias("final_url"),
        F.coalesce(F.get_json_object("metadata", "$.serving_ip"), F.lit("N/A")).alias("serving_ip"),
        F.initcap("main_verdict").alias("verdict"),
        total.cast("bigint").alias("total_vendors"),
        bad.cast("bigint").alias("malicious_detections"),
        F.when(total > 0, bad / total).otherwise(F.lit(0.0)).alias("probability"),
        F.concat(to_local_time(shown), F.lit(" +08")).alias("analysis_time"),
        "community_score")


def _newest(*ties: str) -> list[Column]:
    return [F.desc("analysis_date"), *[F.desc(t) for t in ties]]


def recent_per_user(df: DataFrame, k: int = 5) -> DataFrame:
    """Latest k rows of every user; the rank limit prunes each map task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(*_newest("id")))
    return df.filter(F.col("user_id").isNotNull()).withColumn("rank", rank).filter(
        F.col("rank") <= k)


def recent_of_user(df: DataFrame, user_id: int, k: int = 5) -> DataFrame:
    return df.filter(F.col("user_id") == user_id).orderBy(*_newest("id")).limit(k)


def latest_per_input(df: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("input_string").orderBy(*_newest("id")))
    return df.withColumn("rank", rank).filter(F.col("rank") == 1).drop("rank")


def newest_with_metadata(df: DataFrame, k: int = 100) -> DataFrame:
    return with_json(df, "metadata").orderBy(*_newest("id")).limit(k)


def sort_history(df: DataFrame, by: str = "analysis_date", order: str = "desc") -> DataFrame:
    if order not in ("asc", "desc"):
        raise ValueError("order is asc or desc")
    by = by if by in SORTABLE else "analysis_date"
    direction = F.asc if order == "asc" else F.desc
    return df.orderBy(direction(by), direction("id"))


def page(df: DataFrame, order: list[Column], number: int = 1, per_page: int = 10) -> DataFrame:
    """One page plus total, pages, first and last row number, from one filtered plan."""
    skipped = (number - 1) * per_page
    total = df.agg(F.count("*").alias("n")).scalar()
    rows = df.orderBy(*order).offset(skipped).limit(per_page)
    return rows.withColumn("total", total).withColumn(
        "pages", F.ceil(F.col("total") / per_page).cast("bigint")).withColumn(
        "first_row", F.lit(skipped + 1).cast("bigint")).withColumn(
        "last_row", F.least(F.lit(skipped + per_page).cast("bigint"), F.col("total")))


def page_by_time(df: DataFrame, number: int = 1, per_page: int = 10, when: str = "analysis_date",
                 tie: str = "id", most: int = 1_000_000, day: str = "analysis_day") -> DataFrame:
    """One page of the newest rows first (time, then ``tie``, descending), as ``page`` gives it.

    Counts per day say which days hold the page; while those hold more than ``most`` rows they are counted
    per hour, minute and second. Only the rows of the last span are sorted, so no task passes over the
    rows before the page. The counts are as many as there are days in the table, or units in a span. Where
    the table is stored in folders of the column ``day``, other folders are not read.
    """
    skipped = (number - 1) * per_page
    scope, before, total = df, 0, None
    for unit in ("day", "hour", "minute", "second"):
        cells = scope.groupBy(F.date_trunc(unit, when).alias("cell")).agg(F.count("*").alias("n")).collect()
        cells.sort(key=lambda r: (r.cell is not None, r.cell), reverse=True)
        if total is None:
            total = sum(r.n for r in cells)
        chosen, at = [], before
        for r in cells:
            if at < skipped + per_page and at + r.n > skipped:
                chosen.append(r)
            elif not chosen:
                before += r.n
            at += r.n
        scope = scope.filter(_in_cells([r.cell for r in chosen], unit, when, day if day in df.columns else None))
        if sum(r.n for r in chosen) <= most:
            break
    rows = scope.orderBy(F.desc(when), F.desc(tie)).offset(skipped - before).limit(per_page)
    return rows.select("*", F.lit(total).cast("bigint").alias("total"),
                       F.lit(-(-total // per_page)).cast("bigint").alias("pages"),
                       F.lit(skipped + 1).cast("bigint").alias("first_row"),
                       F.lit(min(skipped + per_page, total)).cast("bigint").alias("last_row"))


def _in_cells(cells: list, unit: str, when: str, day: str | None) -> Column:
    """Rows whose time lies in neighbouring cells, given as their starts; None is a cell of its own."""
    timed = [c for c in cells if c is not None]
    inside = F.lit(False)
    if timed:
        end = max(timed) + dt.timedelta(**{f"{unit}s": 1})
        inside = (F.col(when) >= F.lit(min(timed))) & (F.col(when) < F.lit(end))
        if day:
            inside = inside & F.col(day).between(F.lit(min(timed).date()), F.lit(max(timed).date()))
    return inside | F.col(when).isNull() if len(timed) < len(cells) else inside


def join_users(history: DataFrame, users: DataFrame) -> DataFrame:
    """Inner join on the user key. Rows without a user drop; the planner picks broadcast by size
    and otherwise splits hot users at run time."""
    people = users.select(F.col("id").alias("uid"), "username")
    return history.join(people, history["user_id"] == people["uid"]).drop("uid")
