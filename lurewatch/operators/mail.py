"""Mail records to links, features and history rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.functions import html, text
from lurewatch.functions.strings import first_filled


def with_page_links(mails: DataFrame) -> DataFrame:
    """Parse each html part once; all later link rules read ``page``."""
    return mails.withColumn("page", html.page_links(F.col("html")))


def with_links(mails: DataFrame) -> DataFrame:
    """Classified links of the raw body and the html part."""
    paged = mails if "page" in mails.columns else with_page_links(mails)
    urls = paged.withColumn("urls", html.found_urls(F.col("body"), F.col("page")))
    return urls.withColumn("links", html.classified_links(F.col("urls"), F.col("page"))).drop("urls")


def with_parser_links(mails: DataFrame) -> DataFrame:
    """Links as the mail-file reader reports them."""
    paged = mails if "page" in mails.columns else with_page_links(mails)
    return paged.withColumn("links", html.parser_links(F.col("body"), F.col("page")))


def featurize(mails: DataFrame, raw_text: bool = False) -> DataFrame:
    """Add ``processed`` and the feature struct ``f``.

    The default reads the preprocessed text, in which URLs are already ``URL``; ``raw_text`` reads
    the body as received.
    """
    paged = mails if "page" in mails.columns else with_page_links(mails)
    base = paged.withColumn("processed", text.preprocess(html.visible_text(F.col("body"))))
    source = F.col("body") if raw_text else F.col("processed")
    linked = base.withColumn("_urls", html.found_urls(source, F.col("page"))).withColumn(
        "_links", html.classified_links(F.col("_urls"), F.col("page")))
    return linked.withColumn("f", text.features(source, F.col("html"), F.col("_links"), one_line=not raw_text)).drop(
        "_urls", "_links")


METADATA = {"confidence": "confidence", "f": "features", "links": "embedded_links",
            "attachments": "attachments", "date": "date"}


def to_history(scored: DataFrame, input_rule: str = "body") -> DataFrame:
    """History columns of scored mails; input_string is the first 5000 characters of the body
    (html when empty), or the sender (subject when empty) with ``input_rule='sender'``.

    The metadata tell subject and sender and, of a scored mail, its confidence, features, links,
    attachments and date.
    """
    shown = {"body": F.substring(first_filled(F.col("body"), F.col("html")), 1, 5000),
             "sender": first_filled(F.col("sender"), F.col("subject"))}[input_rule]
    flag = F.col("is_phishing")
    told = [F.col(c).alias(n) for c, n in METADATA.items() if c in scored.columns]
    return scored.select(
        shown.alias("input_string"), F.lit("email").alias("input_type"),
        flag.cast("int").alias("is_malicious"),
        F.when(flag, F.lit("phishing")).otherwise(F.lit("safe")).alias("main_verdict"),
        F.lit(None).cast("string").alias("community_score"),
        F.to_json(F.struct("subject", "sender", *told)).alias("metadata"),
        F.lit("[]").alias("vendor_analysis"),
        *[F.col(c) for c in ("id", "user_id", "analysis_date") if c in scored.columns])
