"""Join indicators with stored vendor reports and a second threat feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lurewatch.functions import fixed_values as fv
from lurewatch.functions import verdicts
from lurewatch.functions.indicators import detect_type


def classify(df: DataFrame, column: str = "input") -> DataFrame:
    """Add input_type and normalized_input."""
    return df.withColumn("_d", detect_type(F.col(column))).select(
        *df.columns, F.col("_d.type").alias("input_type"),
        F.col("_d.value").alias("normalized_input"))


def flatten_reports(reports: DataFrame, *keys: str) -> DataFrame:
    """One row per vendor of each report."""
    rows = reports.select(*keys, F.explode("last_analysis_results").alias("name", "entry"))
    category = F.coalesce("entry.category", F.lit("unknown"))
    return rows.select(*keys, "name", category.alias("category"),
                       F.col("entry.result").alias("result"),
                       verdicts.categorize(category, F.col("entry.result")).alias("verdict"))


def report_columns(reports: DataFrame, *more: str) -> DataFrame:
    """Score, flag, vendor list and type-specific metadata of each report, and the columns ``more``."""
    stats = F.col("last_analysis_stats")
    listed = F.transform(
        F.map_entries("last_analysis_results"),
        lambda e: F.struct(e["key"].alias("name"), verdicts.categorize(
            F.coalesce(e["value"]["category"], F.lit("unknown")), e["value"]["result"])
            .alias("verdict")))
    return reports.select(
        "indicator_type", "indicator", *[c for c in ("error",) if c in reports.columns],
        verdicts.community_score(stats).alias("community_score"),
        F.coalesce(verdicts.stats_malicious(stats), F.lit(False)).alias("is_malicious"),
        F.coalesce(F.array_sort(listed), F.array().cast(verdicts.VENDORS)).alias("vendors"),
        metadata_by_type(reports).alias("metadata"), *more)


def metadata_by_type(reports: DataFrame):
    """JSON text of the attributes that matter for the indicator's type."""
    have = set(reports.columns)
    col = lambda n, t="string": F.col(n) if n in have else F.lit(None).cast(t)
    pick = lambda *fields: F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return (
        F.when(F.col("indicator_type") == "url", pick(
            F.coalesce(col("last_final_url"), F.col("indicator")).alias("final_url"),
            F.coalesce(col("last_http_response_code_ip"), F.lit("Unknown")).alias("serving_ip")))
        .when(F.col("indicator_type") == "domain", pick(
            col("creation_date").alias("creation_date"), col("registrar").alias("registrar"),
            F.coalesce(col("last_dns_records", "array<string>"),
                       F.array().cast("array<string>")).alias("last_dns_records")))
        .when(F.col("indicator_type") == "ip", pick(
            col("as_owner").alias("as_owner"), col("country").alias("country"),
            col("network").alias("network")))
        .when(F.col("indicator_type") == "hash", pick(
            col("type_description").alias("type_description"),
            col("size", "bigint").alias("size"), col("type").alias("file_type")))
        .otherwise(F.lit("{}")))


def latest_reports(reports: DataFrame, version: str) -> DataFrame:
    """Newest report per indicator; the rank limit keeps one row per key and map task.

    Reports of the same version (or all, without such a column) are told apart by their content, so
    reruns agree.
    """
    newest = [F.desc(version)] if version in reports.columns else []
    content = F.sha2(F.to_json(F.struct(*reports.columns)), 256)
    rank = F.row_number().over(
        Window.partitionBy("indicator_type", "indicator").orderBy(*newest, content))
    return reports.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


REPORT_KEYS, FEED_KEYS = ["indicator_type", "indicator"], ["url"]


def current_reports(reports: DataFrame, version: str) -> tuple[DataFrame, list[str]]:
    """Reports as ``sources.current`` keeps them, and the columns that tell the newest of a key.

    The rolled-up columns stand beside the version and, for equal versions, the content: as in
    ``latest_reports`` the smallest hash counts, so its digits are turned round.
    """
    content = F.sha2(F.to_json(F.struct(*reports.columns)), 256)
    turned = F.translate(content, "0123456789abcdef", "fedcba9876543210")
    listed = report_columns(reports.select("*", F.struct(F.col(version), turned.alias("turned")).alias("_place")),
                            "_place")
    return listed.withColumnRenamed("_place", "place"), ["place"]


def current_feed(feed: DataFrame, version: str = "seen") -> tuple[DataFrame, list[str]]:
    """Second-feed rows as ``sources.current`` keeps them, by the rule of ``newest_by_url``."""
    have = [F.col(c) if c in feed.columns else F.lit(None).cast("string").alias(c) for c in FEED_FIELDS]
    row = F.struct(*have)
    order = [F.col(version)] if version in feed.columns else []
    return feed.select("url", *have, F.struct(*order, F.to_json(row).alias("content")).alias("place")), ["place"]


def join_reputation(checks: DataFrame, reputation: DataFrame) -> DataFrame:
    """Left join on (input_type, normalized_input). The table has one row per indicator, so the
    join never multiplies rows; hot indicators are split by adaptive skew handling."""
    known = reputation.select(
        F.col("indicator_type").alias("input_type"), F.col("indicator").alias("normalized_input"),
        "community_score", "is_malicious", "vendors", F.col("metadata").alias("report_metadata"),
        *[F.col(c).alias("report_error") for c in ("error",) if c in reputation.columns])
    joined = checks.join(known, ["input_type", "normalized_input"], "left")
    if "report_error" not in joined.columns:
        joined = joined.withColumn("report_error", F.lit(None).cast("string"))
    failed = F.col("report_error").isNotNull()
    blank = F.array().cast(verdicts.VENDORS)
    return joined.select(
        *checks.columns,
        F.when(failed, F.lit("0/0")).otherwise(F.coalesce("community_score", F.lit("0/0")))
        .alias("community_score"),
        (~failed & F.coalesce("is_malicious", F.lit(False))).alias("is_malicious"),
        F.when(failed, blank).otherwise(F.coalesce("vendors", blank)).alias("vendors"),
        F.when(failed, F.lit("{}")).otherwise(F.coalesce("report_metadata", F.lit("{}")))
        .alias("metadata"),
        F.when(F.col("input_type") == "unknown", F.lit("Unable to determine input type"))
        .otherwise(F.col("report_error")).alias("error"))


FEED_FIELDS = ("query_status", "threat", "blacklists")


def newest_by_url(feed: DataFrame, fields: tuple[str, ...], version: str = "seen") -> DataFrame:
    """One row per URL: that of the greatest ``version`` if the feed has one, ties by content.

    A partial aggregate, so a URL listed very often is thinned out before the shuffle.
    """
    have = [F.col(c) if c in feed.columns else F.lit(None).cast("string").alias(c) for c in fields]
    order = [F.col(version)] if version in feed.columns else []
    row = F.struct(*have)
    return feed.filter(F.col("url").isNotNull()).groupBy("url").agg(
        F.max_by(row, F.struct(*order, F.to_json(row))).alias("_row")).select("url", "_row.*")


def with_feed_metadata(metadata: Column, status: Column, threat: Column, blacklists: Column) -> Column:
    """Add the fields that the feed's row has to the JSON text."""
    names = fv.SECOND_FEED_METADATA
    extra = F.to_json(F.struct(status.alias(names[0]), threat.alias(names[1]),
                               blacklists.alias(names[2])))
    return (F.when(F.coalesce(extra, F.lit("{}")) == "{}", metadata)
            .when(metadata == "{}", extra)
            .otherwise(F.concat(metadata.substr(F.lit(1), F.length(metadata) - 1), F.lit(","),
                                extra.substr(F.lit(2), F.length(extra) - 1))))


def join_second_feed(checked: DataFrame, feed: DataFrame) -> DataFrame:
    """A threat in the second feed makes a URL malicious, and names the feed as a vendor unless a
    vendor already says malicious. A failed first report suppresses this step. The feed's fields are
    added to the metadata; of a URL listed several times the newest row counts."""
    extra = newest_by_url(feed, FEED_FIELDS).withColumnRenamed("url", "_url")
    # The row test stays out of the key: rows that ask nothing still spread over the join tasks.
    asks = (F.col("input_type") == "url") & F.col("error").isNull()
    joined = checked.join(extra, (F.col("normalized_input") == F.col("_url")) & asks, "left")
    hit = (F.coalesce("threat", F.lit("")) != "") & ~F.col("is_malicious")
    named = F.exists("vendors", lambda v: v["verdict"] == "malicious")
    mark = F.struct(F.lit(fv.SECOND_FEED_NAME).alias("name"), F.lit("malicious").alias("verdict"))
    return joined.select(
        *[c for c in checked.columns if c not in ("is_malicious", "vendors", "metadata")],
        with_feed_metadata(F.col("metadata"), F.col("query_status"), F.col("threat"),
                           F.col("blacklists")).alias("metadata"),
        (F.col("is_malicious") | hit).alias("is_malicious"),
        F.when(hit & ~named, F.array_append("vendors", mark)).otherwise(F.col("vendors"))
        .alias("vendors"),
        F.col("query_status").alias("feed_status"), F.col("threat").alias("feed_threat"))


def fuse_feeds(urls: DataFrame, stats: DataFrame, feed: DataFrame) -> DataFrame:
    """Confidence from two feeds: vendor share, and 0.8 for a listed threat. A null threat counts.

    Each feed gives one row per URL, so there is one result row per input row.
    """
    counts = newest_by_url(stats, ("last_analysis_stats",))
    joined = urls.join(counts, "url", "left").join(
        newest_by_url(feed, ("query_status", "threat")), "url", "left")
    of = lambda k: F.coalesce(
        F.try_element_at("last_analysis_stats", F.lit(k)), F.lit(0))
    flagged = of("malicious") + of("suspicious")
    listed = (F.col("query_status") == "ok") & ~F.col("threat").eqNullSafe("none")
    listed = F.coalesce(listed, F.lit(False))
    return joined.select(
        "url", ((flagged > 0) | listed).alias("is_phishing"),
        F.greatest(
            F.lit(0.0), F.when(flagged > 0, flagged / (flagged + of("harmless"))),
            F.when(listed, F.lit(fv.SECOND_FEED_CONFIDENCE))).alias("confidence"),
        F.array_compact(F.array(
            F.when(flagged > 0, F.format_string(
                fv.FIRST_FEED_REASON, of("malicious"), of("suspicious"))),
            F.when(listed, F.concat(F.lit(fv.SECOND_FEED_REASON),
                                    F.coalesce("threat", F.lit("None")))))).alias("reasons"))


def merge_text_links(mails: DataFrame, urls: str = "text_urls", links: str = "links") -> DataFrame:
    """Add text URLs that no link points at yet."""
    fresh = F.filter(urls, lambda u: ~F.exists(links, lambda x: x["url"] == u))
    return mails.withColumn(links, F.concat(links, F.transform(
        fresh, lambda u: F.struct(u.alias("url"), u.alias("text")))))


def store_columns(checked: DataFrame, reanalysis: bool = False) -> DataFrame:
    """Main verdict and JSON columns, ready to append to history.

    A check is flagged by its main verdict; a repeated analysis keeps the flag of its report.
    """
    main = verdicts.main_verdict(F.col("vendors"))
    flag = F.col("is_malicious") if reanalysis else F.col("main_verdict") != "safe"
    return checked.withColumn("main_verdict", main).withColumn(
        "is_malicious", flag.cast("int")).withColumn(
        "vendor_analysis", F.to_json("vendors"))
