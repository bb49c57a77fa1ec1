"""Vendor verdict expressions over one report's verdict list."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lurewatch.functions import fixed_values as fv
from lurewatch.functions.strings import let

VENDORS = "array<struct<name:string,verdict:string>>"


def parse_vendors(json: Column) -> Column:
    """Vendor list from JSON text, null when the text is not a list."""
    return F.from_json(json, VENDORS)


def vendors_or_empty(json: Column) -> Column:
    return F.coalesce(parse_vendors(json), F.array().cast(VENDORS))


def categorize(category: Column, result: Column, phishing_words: tuple[str, ...] = ("phish",)) -> Column:
    """Vendor category and result text to one verdict label."""
    phishing = F.lit(False)
    for word in phishing_words:
        phishing = phishing | F.contains(F.lower(F.coalesce(result, F.lit(""))), F.lit(word))
    return (F.when(category == "malicious",
                   F.when(phishing, F.lit("phishing")).otherwise(F.lit("malicious")))
            .when(category == "suspicious", F.lit("suspicious"))
            .when(category.isin("undetected", "harmless"), F.lit("clean"))
            .otherwise(category))


def verdict_rank(verdict: Column) -> Column:
    """3 phishing, 2 malicious, 1 suspicious, 0 anything else: a max over vendors rolls up."""
    v = F.lower(verdict)
    return (F.when(v == "phishing", 3).when(v == "malicious", 2)
            .when(v == "suspicious", 1).otherwise(0))


def rank_label(rank: Column) -> Column:
    return (F.when(rank == 3, F.lit("phishing")).when(rank == 2, F.lit("malicious"))
            .when(rank == 1, F.lit("suspicious")).otherwise(F.lit("safe")))


def main_verdict(vendors: Column, null_label: str = "safe") -> Column:
    best = F.array_max(F.transform(vendors, lambda v: verdict_rank(v["verdict"])))
    label = let(best, rank_label)
    if null_label == "safe":
        return label
    return F.when(vendors.isNull(), F.lit(null_label)).otherwise(label)


def agreement(vendors: Column) -> Column:
    """full_agreement, disagreement or partial_agreement; null for an empty list."""
    def label(labels: Column) -> Column:
        return (
            F.when(F.coalesce(F.size(labels), F.lit(0)) <= 0, F.lit(None))
            .when(F.size(labels) == 1, F.lit("full_agreement"))
            .when((F.array_contains(labels, "phishing") | F.array_contains(labels, "malicious"))
                  & F.array_contains(labels, "clean"), F.lit("disagreement"))
            .otherwise(F.lit("partial_agreement")))

    return let(F.array_distinct(F.transform(vendors, lambda v: v["verdict"])), label)


def confidence(vendors: Column) -> Column:
    """Share of malicious or phishing verdicts, 0.5 without vendors, null if one has no verdict."""
    def share(labels: Column) -> Column:
        bad = F.size(F.filter(labels, lambda v: v.isin("malicious", "phishing")))
        return (F.when(labels.isNull() | F.exists(labels, lambda v: v.isNull()), F.lit(None))
                .when(F.size(labels) == 0, F.lit(0.5))
                .otherwise(bad / F.size(labels)))

    return let(F.transform(vendors, lambda v: v["verdict"]), share)


def flagged_count(vendors: Column) -> Column:
    return F.size(F.filter(
        vendors, lambda v: F.lower(v["verdict"]).isin("phishing", "malicious", "suspicious")))


def names_in_bucket(vendors: Column, bucket: str) -> Column:
    """Sorted vendor names of one display bucket."""
    labels = fv.CLEAN_VERDICTS if bucket == "clean" else [bucket]
    return F.array_sort(F.transform(
        F.filter(vendors, lambda v: F.lower(v["verdict"]).isin(labels)), lambda v: v["name"]))


def community_score(stats: Column) -> Column:
    """``malicious/total`` text of a stats map; 0/0 without stats."""
    total = F.aggregate(F.map_values(stats), F.lit(0).cast("bigint"), lambda a, x: a + x)
    bad = F.coalesce(F.try_element_at(stats, F.lit("malicious")), F.lit(0))
    return F.when(stats.isNull(), F.lit("0/0")).otherwise(
        F.concat_ws("/", bad.cast("string"), total.cast("string")))


def stats_malicious(stats: Column) -> Column:
    return F.coalesce(F.try_element_at(stats, F.lit("malicious")), F.lit(0)) > 0
