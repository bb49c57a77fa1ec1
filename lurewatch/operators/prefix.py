"""Running totals that no single hot key can serialise.

Rows are cut into ordered buckets, buckets are summed first, the few bucket sums are accumulated,
and each bucket then finishes on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(df: DataFrame, keys: list[str], bucket: Column, order: list[Column],
                values: dict[str, Column]) -> DataFrame:
    """Add inclusive running sums ``values`` per ``keys``; ``bucket`` must follow ``order``."""
    cut = df.withColumn("_bucket", bucket)
    sums = cut.groupBy(*keys, "_bucket").agg(*[F.sum(v).alias(n) for n, v in values.items()])
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_bucket", *[
        F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}") for n in values])
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0)
    local = cut.select("*", *[F.sum(v).over(inside).alias(n) for n, v in values.items()])
    # Null keys are a group of their own, so the sums meet their rows by null-safe equality.
    named = offsets.select(*[F.col(c).alias(f"_by_{c}") for c in [*keys, "_bucket"]],
                           *[f"_{n}" for n in values])
    same = F.lit(True)
    for c in [*keys, "_bucket"]:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    joined = local.join(named, same)
    return joined.select(*df.columns, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in values])
