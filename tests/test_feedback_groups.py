"""Feedback state of many keys in few groups."""

import datetime as dt

from pyspark.sql import functions as F

from lurewatch.operators import spacing
from lurewatch.streaming import feedback, runner

T0 = dt.datetime(2024, 1, 1)
KEYS = ["user_id", "feedback_type"]


def test_many_keys_cost_a_state_row_per_group(spark, tmp_path):
    # 150 keys, some silent for longer than the horizon, some with several rows in a second, over four batches.
    rows = [(i, i * 7 % 75, "bug" if i % 2 else None if i % 20 == 0 else "idea",
             T0 + dt.timedelta(milliseconds=700 * i + (4_000_000 if i >= 1500 else 0))) for i in range(3000)]
    df = spark.createDataFrame(rows, "id bigint, user_id bigint, feedback_type string, ts timestamp")
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for lo in range(0, 3000, 750):
        df.filter((F.col("id") >= lo) & (F.col("id") < lo + 750)).write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source)
        accepted = feedback.accept(stream, KEYS, "ts", "id", 60, groups=4)
        runner.drain(accepted, runner.to_folder(out), state)
    got = sorted(r["id"] for r in spark.read.parquet(out).collect())
    marked = spacing.mark_accepted(df, KEYS, "ts", "id", 60).filter("accepted").collect()
    assert got == sorted(r["id"] for r in marked)
    kept = spark.read.format("statestore").load(state)
    assert 0 < kept.count() <= 4
    # The first half's keys are beyond the horizon and gone, unless the second half has them too.
    assert kept.agg(F.sum(F.size("value.groupState.last"))).first()[0] <= 150


def test_a_row_without_time_is_not_accepted(spark, tmp_path):
    rows = [(1, 1, "bug", T0), (2, 1, "bug", None)]
    df = spark.createDataFrame(rows, "id bigint, user_id bigint, feedback_type string, ts timestamp")
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    df.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    runner.drain(feedback.accept(stream, KEYS, "ts", "id", 60), runner.to_folder(out), state)
    assert [r["id"] for r in spark.read.parquet(out).collect()] == [1]
