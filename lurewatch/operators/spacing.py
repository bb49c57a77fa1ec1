"""Keep the rows of each key that are at least ``horizon`` seconds after the last kept row.

A rejected row does not extend the wait, so each decision depends on the one before it. To keep a
hot key off a single task, its time line is cut into chunks of about one day. A chunk holds at most
one entry per second (the stored resolution). Chunks that no wait can cross are decided alone;
where one can, each chunk is summarised as "earliest allowed second -> earliest allowed second
after the chunk", the summaries are combined in a tree (``steps``), and every chunk is then decided.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lurewatch.operators import steps

DAY = 86_400
ANY_TIME = -(2**62)


def _summary_udf(horizon: int, chunk: int):
    @F.pandas_udf("struct<heads:array<bigint>,nexts:array<bigint>>")
    def summary(seconds: pd.Series) -> pd.DataFrame:
        heads, nexts = [], []
        for values in seconds:
            s = np.asarray(values, dtype=np.int64)
            n = len(s)
            jump = np.append(np.searchsorted(s, s + horizon), n)
            after = np.append(s + horizon, 0)
            while True:  # pointer doubling: every entry reaches the last one it leads to
                further = np.where(jump < n, jump[jump], jump)
                after[:n] = np.where(jump[:n] < n, after[jump[:n]], after[:n])
                if np.array_equal(further, jump):
                    break
                jump = further
            entry = np.searchsorted(s, s[0] // chunk * chunk + horizon)
            k = min(n, entry + 1)
            last = np.append(after[1:k] != after[:k - 1], True)
            heads.append(s[:k][last].tolist())
            nexts.append(after[:k][last].tolist())
        return pd.DataFrame({"heads": heads, "nexts": nexts})

    return summary


def _keep(entries: Column, allowed: Column, horizon: int) -> Column:
    """Ids of the entries kept when nothing before ``allowed`` may be kept."""
    start = F.struct(allowed.cast("bigint").alias("next"),
                     F.array().cast("array<bigint>").alias("ids"))

    def step(acc: Column, e: Column) -> Column:
        return F.when(e["sec"] >= acc["next"], F.struct(
            (e["sec"] + horizon).alias("next"),
            F.array_append(acc["ids"], e["id"]).alias("ids"))).otherwise(acc)

    return F.aggregate(entries, start, step, lambda acc: acc["ids"])


def accepted_ids(df: DataFrame, keys: list[str], when: str, row_id: str, horizon: int) -> DataFrame:
    """Ids of the kept rows among those whose keys are all set."""
    known = df
    for k in keys:
        known = known.filter(F.col(k).isNotNull())
    per_second = known.groupBy(*keys, F.unix_seconds(when).alias("sec")).agg(
        F.min(F.struct(F.col(when), F.col(row_id)))[row_id].alias("id"))
    chunk = max(horizon, DAY // horizon * horizon)
    # The joins below ask for a set chunk; asking here keeps every reader's shuffle identical.
    cut = per_second.withColumn("chunk", F.floor(F.col("sec") / chunk)).filter(
        F.col("chunk").isNotNull())
    chunks = cut.groupBy(*keys, "chunk").agg(
        F.array_sort(F.collect_list(F.struct("sec", "id"))).alias("entries"))

    along = Window.partitionBy(*keys).orderBy("chunk")
    # The spans come from the chunks themselves, so all readers share one shuffle.
    spans = chunks.select(*keys, "chunk", F.col("entries")[0]["sec"].alias("lo"),
                          F.element_at("entries", -1)["sec"].alias("hi"))
    near = F.col("lo") < F.lag("hi").over(along) + horizon
    runs = spans.select(*keys, "chunk", F.sum(F.when(near, 0).otherwise(1)).over(along).alias("run"))
    linked = runs.withColumn("n", F.count("*").over(Window.partitionBy(*keys, "run"))).filter(
        F.col("n") > 1)

    summary = _summary_udf(horizon, chunk)(F.transform("entries", lambda e: e["sec"]))
    functions = chunks.join(linked, [*keys, "chunk"]).select(
        *keys, "run", F.col("chunk").alias("place"), summary.alias("f")).select(
        *keys, "run", "place", "f.heads", "f.nexts", (F.col("place") * chunk + horizon).alias("most"))
    # Only the time range decides how many rounds the tree has.
    ends = df.agg(F.min(F.unix_seconds(when)).alias("lo"), F.max(F.unix_seconds(when)).alias("hi")).first()
    entered = steps.entries(functions, [*keys, "run"], ANY_TIME, (ends.lo or 0) // chunk,
                            (ends.hi or 0) // chunk).select(
        *keys, F.col("place").alias("chunk"), F.col("entry").alias("allowed"))

    resolved = chunks.join(entered, [*keys, "chunk"], "left")
    kept = _keep(F.col("entries"), F.coalesce("allowed", F.lit(ANY_TIME)), horizon)
    return resolved.select(F.explode(kept).alias(row_id))


def mark_accepted(df: DataFrame, keys: list[str], when: str, row_id: str, horizon: int) -> DataFrame:
    """Add ``accepted``. A null key never equals another, so such rows are always accepted."""
    kept = accepted_ids(df, keys, when, row_id, horizon).withColumn("_kept", F.lit(True))
    open_key = F.lit(False)
    for k in keys:
        open_key = open_key | F.col(k).isNull()
    return df.join(kept, row_id, "left").withColumn(
        "accepted", open_key | F.col("_kept").isNotNull()).drop("_kept")
