"""Accept feedback at most once per key and horizon, on a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


# Keys meet in this many groups, so a batch costs one Python call per group and not one per key.
GROUPS = 4096


def accept(stream: DataFrame, keys: list[str], when: str, row_id: str, horizon: int,
           delay: str = "1 minute", groups: int = GROUPS) -> DataFrame:
    """Accepted (keys, id, sec) rows; a row with a null key is always accepted, another without time never.

    Of the rows of a key and second that come in one batch the smallest (time, id) counts, as in the
    table rule; a batch is reduced to these chunk by chunk, so a task holds one entry per key and second of
    a group of keys. The state is one number per key, in one row per group; numbers that no row can
    meet any more leave with the next batch of their group, the row when none is left.
    """
    types = dict(stream.dtypes)
    seconds = stream.withWatermark(when, delay).select(
        *keys, row_id, when, F.unix_seconds(when).alias("sec"), F.unix_micros(when).alias("_micros"))
    out = ", ".join(f"{k} {types[k]}" for k in keys) + f", {row_id} bigint, sec bigint"
    stored = ", ".join(f"k{n} array<{types[k]}>" for n, k in enumerate(keys)) + ", last array<bigint>"

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        first = None
        for rows in batches:
            every = rows if first is None else pd.concat([first, rows])
            first = every.sort_values(["_micros", row_id]).drop_duplicates([*keys, "sec"])
        first = first.sort_values("sec")
        last = dict(zip(zip(*state.get[:-1]), state.get[-1])) if state.exists else {}
        kept = []
        for *key, ident, sec in zip(*(first[c].tolist() for c in [*keys, row_id, "sec"])):
            key = tuple(key)
            before = last.get(key)
            if before is None or sec >= before + horizon:
                kept.append((*key, int(ident), sec))
                last[key] = sec
        now = state.getCurrentWatermarkMs()
        last = {k: sec for k, sec in last.items() if (sec + horizon) * 1000 >= now}
        if last:
            state.update((*map(list, zip(*last)), list(last.values())))
            state.setTimeoutTimestamp(max((max(last.values()) + horizon) * 1000, now + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(kept, columns=[*keys, row_id, "sec"])

    no_key = F.lit(False)
    for k in keys:
        no_key = no_key | F.col(k).isNull()
    grouped = seconds.filter(~no_key & F.col("sec").isNotNull()).withColumn(
        "_group", F.pmod(F.xxhash64(*keys), F.lit(groups))).groupBy("_group")
    ruled = grouped.applyInPandasWithState(
        step, out, stored, "append", GroupStateTimeout.EventTimeTimeout)
    free = seconds.filter(no_key).select(*keys, F.col(row_id).cast("bigint"), "sec")
    return ruled.unionByName(free)
