"""Aggregations over history, vendor verdicts, feedback and the mail corpus.

Every one is a partial-then-final aggregate, so a hot user or day is combined before the shuffle.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurewatch.functions import fixed_values as fv
from lurewatch.functions import verdicts
from lurewatch.functions.text import tokens
from lurewatch.operators.history import last_days


def _of(verdict: str) -> Column:
    return F.count_if(F.col("main_verdict") == verdict)


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def _threat_counts() -> list[Column]:
    return [
        F.count("*").alias("total_checks"),
        F.count_if(F.col("main_verdict") != "safe").alias("threats_detected"),
        *[_of(v).alias(f"{v}_count") for v in fv.VERDICT_ORDER],
    ]


def _with_threat_share(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "threat_percentage", _percent(F.col("threats_detected"), F.col("total_checks")))


def user_stats(df: DataFrame) -> DataFrame:
    return _with_threat_share(df.groupBy("user_id").agg(*_threat_counts()))


def global_stats(df: DataFrame) -> DataFrame:
    return _with_threat_share(df.agg(*_threat_counts()))


def user_and_global_stats(df: DataFrame) -> DataFrame:
    """Both levels from one scan: counts per user first, then the rollup of those few rows."""
    names = ["total_checks", "threats_detected", *[f"{v}_count" for v in fv.VERDICT_ORDER]]
    per_user = df.groupBy("user_id").agg(*_threat_counts())
    return _with_threat_share(per_user.rollup("user_id").agg(
        *[F.sum(n).alias(n) for n in names], F.grouping("user_id").alias("is_global")))


def profile_stats(df: DataFrame) -> DataFrame:
    counted = df.groupBy("user_id").agg(
        F.count("*").alias("total_checks"),
        *[_of(v).alias(f"{v}_detected") for v in ("phishing", "malicious", "suspicious")])
    total = F.col("phishing_detected") + F.col("malicious_detected") + F.col("suspicious_detected")
    return counted.withColumn("total_threats", total).withColumn(
        "detection_rate", _percent(F.col("total_threats"), F.col("total_checks")))


def admin_metrics(df: DataFrame, as_of: dt.datetime, days: int = 90) -> DataFrame:
    counted = last_days(df, as_of, days).agg(
        F.count("*").alias("total_analyses"),
        *[_of(v).alias(f"{v}_count") for v in fv.VERDICT_ORDER])
    whole = F.greatest("total_analyses", F.lit(1))
    return counted.select("*", *[
        (F.col(f"{v}_count") / whole * 100).alias(f"{v}_rate") for v in fv.VERDICT_ORDER])


def verdict_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("user_id").agg(*[_of(v).alias(f"{v}_count") for v in fv.VERDICT_ORDER])


def daily_trend(df: DataFrame, as_of: dt.datetime, days: int = 7) -> DataFrame:
    """Verdicts per day of the last days; days without rows are absent."""
    counted = last_days(df, as_of, days, whole_days=True).groupBy(
        F.to_date("analysis_date").alias("check_date")).agg(
        *[_of(v).alias(f"{v}_count") for v in fv.VERDICT_ORDER])
    return counted.withColumn("threat_series", F.col("phishing_count") + F.col("malicious_count")
                              + F.col("suspicious_count")).orderBy("check_date").withColumn(
        "check_date", F.col("check_date").cast("string"))


def _malicious() -> Column:
    return F.col("is_malicious") == 1


def basic_metrics(df: DataFrame, as_of: dt.datetime, days: int = 30) -> DataFrame:
    return last_days(df, as_of, days).agg(
        F.count("*").alias("total_checks"),
        F.count_if(_malicious()).alias("phishing_detected"),
        F.coalesce(F.avg(_malicious().cast("double")), F.lit(0.0)).alias("detection_rate"))


def _per_day(df: DataFrame, *aggs: Column) -> DataFrame:
    """Latest 30 days that have data."""
    return df.groupBy(F.to_date("analysis_date").alias("check_day")).agg(
        F.count("*").alias("total_checks"), *aggs).orderBy(F.desc("check_day")).limit(30).withColumn(
        "check_day", F.col("check_day").cast("string"))


def daily_detection(df: DataFrame) -> DataFrame:
    return _per_day(df, F.count_if(_malicious()).alias("phishing_detected"))


def model_evolution(df: DataFrame) -> DataFrame:
    return _per_day(df, F.avg(_malicious().cast("double")).alias("detection_rate"))


AGREEMENT = ["full_agreement", "partial_agreement", "disagreement"]


def vendor_agreement(df: DataFrame, as_of: dt.datetime, days: int = 7) -> DataFrame:
    """Rows per agreement class; all three classes are always present."""
    rows = last_days(df, as_of, days).filter(F.col("vendor_analysis").isNotNull())
    label = verdicts.agreement(verdicts.parse_vendors(F.col("vendor_analysis")))
    counted = rows.select(label.alias("agreement")).agg(
        *[F.count_if(F.col("agreement") == a).alias(a) for a in AGREEMENT])
    return counted.unpivot([], AGREEMENT, "agreement", "n")


def agreement_from_rows(df: DataFrame, key: str = "key") -> DataFrame:
    """Agreement class per key from long vendor rows, without building vendor lists."""
    seen = df.groupBy(key).agg(
        F.min("verdict").alias("low"), F.max("verdict").alias("high"),
        F.bool_or(F.col("verdict").isin("phishing", "malicious")).alias("bad"),
        F.bool_or(F.col("verdict") == "clean").alias("clean"))
    return seen.select(key, F.when(F.col("low") == F.col("high"), F.lit("full_agreement"))
                       .when(F.col("bad") & F.col("clean"), F.lit("disagreement"))
                       .otherwise(F.lit("partial_agreement")).alias("agreement"))


def main_verdict_from_rows(df: DataFrame, key: str = "key") -> DataFrame:
    """Roll-up per key from long vendor rows: a maximum of ranks combines on the map side."""
    best = df.groupBy(key).agg(F.max(verdicts.verdict_rank(F.col("verdict"))).alias("best"))
    return best.select(key, verdicts.rank_label(F.col("best")).alias("main_verdict"))


def vendors_by_verdict(df: DataFrame) -> DataFrame:
    """Vendor names of each report by display bucket, straight from the row's own list."""
    v = verdicts.parse_vendors(F.col("vendor_analysis"))
    staged = df.filter(F.col("vendor_analysis").isNotNull()).select("id", v.alias("vendors"))
    return staged.select("id", *[
        verdicts.names_in_bucket(F.col("vendors"), b).alias(f"{b}_vendors")
        for b in ("phishing", "malicious", "suspicious", "clean")])


def url_feedback_stats(df: DataFrame, by_user: bool = True) -> DataFrame:
    grouped = df.groupBy("user_id") if by_user else df
    counted = grouped.agg(
        F.count("*").alias("total_feedback"),
        F.count_if(F.col("original_prediction") != F.col("user_feedback"))
        .alias("disagreements"))
    total = F.col("total_feedback")
    return counted.withColumn("agreement_rate", F.when(
        total > 0, (total - F.col("disagreements")) / total).otherwise(F.lit(0.0)))


def feedback_by_type(df: DataFrame) -> DataFrame:
    return df.groupBy("feedback_type").agg(F.count("*").alias("n"))


def dataset_stats(df: DataFrame, label: str = "class") -> DataFrame:
    """Corpus size and phishing share, counted before unmapped labels are dropped."""
    counted = df.agg(F.count("*").alias("total"),
                     F.count_if(F.col(label) == 1).alias("phishing"))
    return counted.select(
        "total", "phishing", (F.col("total") - F.col("phishing")).alias("legitimate"),
        F.when(F.col("total") > 0, F.col("phishing") / F.col("total")).alias("phishing_ratio"))


def class_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, plus accuracy, macro and weighted rows."""
    pairs = df.groupBy(F.col(label).cast("int").alias("l"),
                       F.col(prediction).cast("int").alias("p")).agg(F.count("*").alias("n"))
    sides = pairs.select(F.explode(F.array(
        F.struct(F.col("l").alias("cls"), F.col("n").alias("actual"), F.lit(0).alias("guessed"),
                 F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("p").alias("cls"), F.lit(0).alias("actual"), F.col("n").alias("guessed"),
                 F.lit(0).alias("hit")))).alias("s")).select("s.*")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    per = sides.groupBy("cls").agg(F.sum("actual").alias("support"),
                                   F.sum("guessed").alias("guessed"), F.sum("hit").alias("hit"))
    per = per.select("cls", "support", "hit", ratio(F.col("hit"), F.col("guessed")).alias("precision"),
                     ratio(F.col("hit"), F.col("support")).alias("recall"))
    p, r = F.col("precision"), F.col("recall")
    per = per.withColumn("f1", ratio(2 * p * r, p + r))
    scores = ["precision", "recall", "f1"]
    weight = F.col("support")
    overall = per.agg(
        F.sum("support").alias("support"), F.sum("hit").alias("hit"),
        *[F.avg(s).alias(f"macro_{s}") for s in scores],
        *[(F.sum(F.col(s) * weight) / F.sum(weight)).alias(f"weighted_{s}") for s in scores])
    accuracy = F.col("hit") / F.col("support")
    tail = overall.select(F.explode(F.array(
        F.struct(F.lit("accuracy").alias("row"), accuracy.alias("precision"),
                 accuracy.alias("recall"), accuracy.alias("f1"), F.col("support")),
        *[F.struct(F.lit(f"{m} avg").alias("row"),
                   *[F.col(f"{m}_{s}").alias(s) for s in scores], F.col("support"))
          for m in ("macro", "weighted")])).alias("s")).select("s.*")
    return per.select(F.col("cls").cast("string").alias("row"), *scores, "support").unionByName(tail)


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(F.col(label).cast("int").alias("label"),
                      F.col(prediction).cast("int").alias("prediction")).agg(F.count("*").alias("n"))


def term_frequencies(df: DataFrame, text: str = "body") -> DataFrame:
    """Corpus and document frequency of every term in one shuffle on the term."""
    words = df.select(tokens(F.col(text)).alias("w"))
    marks = words.select(F.explode(F.concat(
        F.transform("w", lambda t: F.struct(t.alias("term"), F.lit(1).alias("tf"), F.lit(0).alias("df"))),
        F.transform(F.array_distinct("w"),
                    lambda t: F.struct(t.alias("term"), F.lit(0).alias("tf"), F.lit(1).alias("df"))),
    )).alias("m")).select("m.*")
    return marks.groupBy("term").agg(F.sum("df").alias("document_frequency"),
                                     F.sum("tf").alias("term_frequency"))


def feature_weights(spark: SparkSession) -> DataFrame:
    """The displayed weight table as rows."""
    table = F.create_map(*[x for c, ws in fv.FEATURE_WEIGHTS.items() for x in (
        F.lit(c), F.create_map(*[y for k, w in ws.items() for y in (F.lit(k), F.lit(w))]))])
    rows = spark.range(1).select(F.explode(table).alias("category", "weights"))
    return rows.select("category", F.explode("weights").alias("name", "importance")).select(
        F.concat_ws(" - ", "category", "name").alias("feature"), "importance")


def text_entropy(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """Shannon entropy of long texts, 0 for null and empty ones: characters are counted on the map
    side, per row."""
    body = F.coalesce(F.col(text), F.lit(""))
    chars = df.select(row_id, body.alias("_body"), F.explode(F.split(body, "")).alias("ch")).filter(
        (F.col("ch") != "") | (F.col("_body") == ""))
    counts = chars.groupBy(row_id, "ch").agg(F.count("*").alias("k"))
    # -sum(k/n * log2(k/n)) with n = sum(k)
    k, n = F.col("k"), F.sum("k")
    return counts.groupBy(row_id).agg(
        (F.log2(n) - F.sum(k * F.log2(k)) / n).alias("entropy"))
