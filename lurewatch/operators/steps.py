"""Ordered folds whose state is one number, without a task that sees a whole key.

What a stretch of a key's time line does to the state is a step function: ``heads`` ascend, a state up to
``heads[i]`` (and above the one before) becomes ``nexts[i]``, a state above all heads stays. Such
functions compose, so they are combined FAN neighbours at a time up a tree, and the state in which each
stretch is entered is sent back down it. No cell holds more than FAN functions, and a composed function has
no heads beyond the greatest state that can reach it, whatever the length of the time line.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN = 32
EVERY = 2 ** 62
FUNCTION = "struct<heads:array<bigint>,nexts:array<bigint>>"


def then(heads: np.ndarray, nexts: np.ndarray, more: np.ndarray, further: np.ndarray):
    """The function that applies (heads, nexts) first and (more, further) after it."""
    if not len(more):
        return heads, nexts
    at = np.searchsorted(more, nexts)
    moved = np.where(at < len(more), further[np.minimum(at, len(more) - 1)], nexts)
    rest = more > heads[-1] if len(heads) else np.ones(len(more), bool)
    heads, nexts = np.concatenate([heads, more[rest]]), np.concatenate([moved, further[rest]])
    edge = np.append(nexts[1:] != nexts[:-1], True)
    return heads[edge], nexts[edge]


def within(heads: np.ndarray, nexts: np.ndarray, most: int):
    """Without the heads that no state up to ``most`` needs."""
    n = int(np.searchsorted(heads, most)) + 1
    return heads[:n], nexts[:n]


def value(heads: np.ndarray, nexts: np.ndarray, state: int) -> int:
    at = int(np.searchsorted(heads, state))
    return int(nexts[at]) if at < len(heads) else state


def _pair(step: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(step["heads"], np.int64), np.asarray(step["nexts"], np.int64)


def _composed(cells: pd.Series, most: pd.Series) -> pd.DataFrame:
    out = []
    for steps, reach in zip(cells, most):
        heads, nexts = _pair(steps[0])
        for step in steps[1:]:
            heads, nexts = then(heads, nexts, *_pair(step))
        out.append(within(heads, nexts, reach))
    return pd.DataFrame({"heads": [h.tolist() for h, _ in out], "nexts": [n.tolist() for _, n in out]})


def _walked(cells: pd.Series, entry: pd.Series) -> pd.Series:
    out = []
    for steps, state in zip(cells, entry):
        found = []
        for step in steps:
            found.append({"place": int(step["place"]), "entry": int(state)})
            state = value(*_pair(step), int(state))
        out.append(found)
    return pd.Series(out)


def entries(functions: DataFrame, keys: list[str], start: int, low: int, high: int,
            fan: int = FAN) -> DataFrame:
    """``keys``, place and ``entry``: the state in which each place is entered.

    ``functions`` has one row per key and place: place (between ``low`` and ``high``), heads, nexts and
    ``most``, the greatest state that can enter it. A key starts with the state ``start``. Keys are not
    null.
    """
    composed = F.pandas_udf(_composed, FUNCTION)
    walked = F.pandas_udf(_walked, "array<struct<place:bigint,entry:bigint>>")
    level = functions.withColumn("place", F.col("place") - low)
    high, groups = max(high - low, 0), []
    while True:
        cells = level.groupBy(*keys, F.floor(F.col("place") / fan).alias("up")).agg(
            F.array_sort(F.collect_list(F.struct("place", "heads", "nexts"))).alias("steps"),
            F.min("most").alias("most"))
        groups.append(cells)
        high //= fan
        if not high:
            break
        level = cells.select(*keys, F.col("up").alias("place"), "most", composed("steps", "most").alias(
            "f")).select(*keys, "place", "most", "f.heads", "f.nexts")
    known = groups[-1].withColumn("entry", F.lit(start).cast("bigint"))
    while True:
        found = known.select(*keys, F.explode(walked("steps", "entry")).alias("o")).select(
            *keys, "o.place", "o.entry")
        groups.pop()
        if not groups:
            return found.withColumn("place", F.col("place") + low)
        known = groups[-1].join(found.withColumnRenamed("place", "up"), [*keys, "up"])
