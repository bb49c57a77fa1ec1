"""ROC and precision-recall curves from (score, label) rows.

Rows are first reduced to distinct scores. Those are ranged by a sample of the scores themselves, so
crowded scores spread as well as even ones; one row per range is accumulated, and every range then
finishes on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lurewatch.session import shared_path


def score_counts(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    return df.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))


def _points(counts: DataFrame) -> DataFrame:
    """Per distinct score, highest first: cumulative tp and fp, totals, rank and the next counts."""
    spark = counts.sparkSession
    path = shared_path(spark, "ranges")
    ranged = counts.repartitionByRange("score").withColumn("range", F.spark_partition_id())
    ranged.write.parquet(path)
    cut = spark.read.schema(ranged.schema).parquet(path)
    first = F.struct(F.col("score"), "pos", "neg")
    sums = cut.groupBy("range").agg(
        F.sum("pos").alias("pos_sum"), F.sum("neg").alias("neg_sum"), F.count("*").alias("n_sum"),
        F.max(first).alias("first"))
    # One row per range from here to the join.
    down = Window.orderBy(F.desc("range"))
    above = down.rowsBetween(Window.unboundedPreceding, -1)
    everything = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("bigint")
    offsets = sums.select(
        "range",
        F.coalesce(F.sum("pos_sum").over(above), zero).alias("pos_above"),
        F.coalesce(F.sum("neg_sum").over(above), zero).alias("neg_above"),
        F.coalesce(F.sum("n_sum").over(above), zero).alias("n_above"),
        F.sum("pos_sum").over(everything).alias("all_pos"),
        F.sum("neg_sum").over(everything).alias("all_neg"),
        F.sum("n_sum").over(everything).alias("n_scores"),
        F.lead("first").over(down).alias("next_first"))
    local = Window.partitionBy("range").orderBy(F.desc("score"))
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    ranked = cut.select(
        "*", F.sum("pos").over(upto).alias("tp_in"), F.sum("neg").over(upto).alias("fp_in"),
        F.row_number().over(local).alias("n_in"),
        F.lead(F.struct("score", "pos", "neg")).over(local).alias("next_in"))
    joined = ranked.join(F.broadcast(offsets), "range")
    return joined.select(
        "score", "pos", "neg",
        (F.col("tp_in") + F.col("pos_above")).alias("tp"),
        (F.col("fp_in") + F.col("neg_above")).alias("fp"),
        (F.col("n_in") + F.col("n_above")).alias("position"),
        "n_scores", "all_pos", "all_neg",
        F.coalesce("next_in", "next_first").alias("next"))


def roc_points(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Curve points from (0,0) on, without the interior points of straight runs.

    A rate is null when its class is missing. An empty input gives no points.
    """
    points = _points(score_counts(df, score, label))
    inner = (F.col("position") > 1) & (F.col("position") < F.col("n_scores"))
    straight = (F.col("pos") == F.col("next.pos")) & (F.col("neg") == F.col("next.neg"))
    rate = lambda n, d: F.when(d > 0, n / d)
    point = F.struct(
        F.col("position").cast("bigint").alias("position"),
        rate(F.col("fp"), F.col("all_neg")).alias("fpr"), rate(F.col("tp"), F.col("all_pos")).alias("tpr"))
    origin = F.struct(
        F.lit(0).cast("bigint").alias("position"),
        rate(F.lit(0), F.col("all_neg")).alias("fpr"), rate(F.lit(0), F.col("all_pos")).alias("tpr"))
    return _opened(points.filter(~(inner & straight)), point, origin)


def _opened(points: DataFrame, point: Column, extra: Column) -> DataFrame:
    """One row per point; the first score also brings the curve's fixed end point."""
    both = F.when(F.col("position") == 1, F.array(extra, point)).otherwise(F.array(point))
    return points.select(F.explode(both).alias("p")).select("p.*")


def roc_auc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Trapezoid area under the curve: dropped points lie on straight runs, so each score adds its
    own trapezoid. 0 for empty input, null when one class is missing."""
    points = _points(score_counts(df, score, label))
    area = F.sum((F.col("tp") * 2 - F.col("pos")) * F.col("neg"))
    both = F.max("all_pos") * F.max("all_neg")
    return points.agg(
        F.when(F.count("*") == 0, F.lit(0.0))
        .when(both > 0, area / (both * 2)).alias("auc"))


def pr_points(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Precision and recall by ascending threshold, closed by the point (1, 0)."""
    points = _points(score_counts(df, score, label))
    point = F.struct(
        F.col("score").alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.when(F.col("all_pos") > 0, F.col("tp") / F.col("all_pos")).otherwise(F.lit(1.0))
        .alias("recall"))
    closing = F.struct(
        F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"))
    return _opened(points, point, closing)
