"""Exact top-k search by inner product: tiles of queries against shards of vectors.

Vectors are dealt to shards by a hash of their id; every query goes to every shard. A task holds one
shard and streams the queries through it tile by tile: a matrix product, a partial selection, and one
list of k per query and shard. Lists are then merged in a tree, FAN shards at a time. The shards grow
with the square root of the table, so tasks and the copies of the queries grow in step, up to MOST_VALUES
components; a query's copy costs its bytes in the shuffle and a product with a whole shard in its task.

Components become floor(1024 * x). Products are exact: float64 while all partial sums stay below 2**53,
else Python integers; a score beyond a long is cut to the long range.

Defined cases: vectors that are null or hold a null or non-finite component take no part; a null id
takes no part; of vectors of different length the shorter counts as padded with zeros; an id that
repeats makes one query (its smallest vector) but every row is a candidate; a query's own id never is
one; fewer than k candidates give a shorter list; an empty table gives an empty result. Further columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, TILE, PART, FAN = 1024, 128, 8192, 32
# Twice 256 MB while a shard's parts are joined.
MOST_VALUES = 1 << 25
LONG = (1 << 63) - 1


def _grid(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Scaled components padded to one width, and the largest absolute component of each row."""
    column = column.cast(pa.list_(pa.float64()))
    at = column.offsets.to_numpy()
    flat = np.floor(column.values.to_numpy(zero_copy_only=False)[at[0]:at[-1]] * SCALE)
    at = at - at[0]
    width = np.diff(at)
    out = np.zeros((len(width), int(width.max(initial=0))))
    row = np.repeat(np.arange(len(width)), width)
    out[row, np.arange(len(flat)) - np.repeat(at[:-1], width)] = flat
    return out


def _widen(x: np.ndarray, n: int) -> np.ndarray:
    return x if x.shape[1] >= n else np.pad(x, ((0, 0), (0, n - x.shape[1])))


def _top(scores: np.ndarray, ids: np.ndarray, k: int):
    """Columns of the k best per row, ties to the smaller id; ids ascend along the columns."""
    n = scores.shape[1]
    if n <= k:
        pick = np.tile(np.arange(n), (len(scores), 1))
    else:
        edge = np.partition(scores, n - k, axis=1)[:, n - k, None]
        above, level = scores > edge, scores == edge
        room = k - above.sum(axis=1, keepdims=True)
        keep = above | (level & (np.cumsum(level, axis=1) <= room))
        pick = np.nonzero(keep)[1].reshape(len(scores), k)
    order = np.argsort(-np.take_along_axis(scores, pick, 1), axis=1, kind="stable")
    return np.take_along_axis(pick, order, 1)


def best(queries: np.ndarray, own: np.ndarray, grid: np.ndarray, ids: np.ndarray, k: int):
    """(query row, id, score) of each query's k best among the rows of ``grid``, not its own id."""
    width = max(queries.shape[1], grid.shape[1])
    queries, grid = _widen(queries, width), _widen(grid, width)
    peak = np.abs(queries).max(initial=0), np.abs(grid).max(initial=0)
    exact = peak[0] * peak[1] * max(width, 1) < 2.0 ** 53
    found = []
    for lo in range(0, len(grid), PART):
        part, names = grid[lo:lo + PART], ids[lo:lo + PART]
        if exact:
            scores = queries @ part.T
            scores[own[:, None] == names[None, :]] = -np.inf
            pick = _top(scores, names, k)
            got = np.take_along_axis(scores, pick, 1)
            row, col = np.nonzero(got > -np.inf)
            found.append((row, names[pick[row, col]], got[row, col].astype(np.int64)))
        else:
            whole = [[int(v) for v in x] for x in part]
            for r, q in enumerate(queries):
                q = [int(v) for v in q]
                line = sorted((-sum(map(int.__mul__, q, x)), int(i)) for x, i in zip(whole, names)
                              if i != own[r])[:k]
                found.append((np.full(len(line), r), np.array([i for _, i in line], np.int64),
                              np.array([max(-LONG - 1, min(LONG, -s)) for s, _ in line], np.int64)))
    row, name, score = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((name, -score.astype(object) if not exact else -score, row))
    row, name, score = row[order], name[order], score[order]
    first = np.searchsorted(row, row)
    keep = np.arange(len(row)) - first < k
    return row[keep], name[keep], score[keep]


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "vec_id",
           vector: str = "embedding", most_values: int = MOST_VALUES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows of ``vectors`` for every query row."""
    def usable(df: DataFrame, kind: int) -> DataFrame:
        v = F.col(vector).cast("array<double>")
        return (df.select(F.col(id_column).cast("long").alias("id"), v.alias("v"))
                .where(F.col("id").isNotNull() & F.col("v").isNotNull()
                       & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)
                                  & (F.abs(x) < float("inf"))))
                .withColumn("kind", F.lit(kind)))

    rows = usable(vectors, 0)
    asked = usable(queries, 1).groupBy("id", "kind").agg(F.min("v").alias("v"))
    n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    shards = max(1, math.ceil(math.sqrt(n) / 8), math.ceil(n * (width or 0) / most_values))
    # Neighbouring numbers go to any task: the shard number is its own partition key.
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards))).unionByName(
        asked.withColumn("shard", F.explode(F.sequence(
            F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))))
    sorted_rows = (dealt.repartition(shards, "shard")
                   .sortWithinPartitions("shard", "kind", "id", "v").select("shard", "kind", "id", "v"))

    def run(batches):
        shard, held, names, grid, ids = None, [], [], None, None
        for batch in batches:
            part = batch.column(0).to_numpy()
            kind = batch.column(1).to_numpy()
            name = batch.column(2).to_numpy()
            cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(part)]):
                if hi == lo:
                    continue
                if part[lo] != shard:
                    shard, held, names, grid = part[lo], [], [], None
                rows = _grid(batch.column(3).slice(lo, hi - lo))
                if kind[lo] == 0:
                    held.append(rows)
                    names.append(name[lo:hi])
                    continue
                if grid is None:
                    width = max((x.shape[1] for x in held), default=0)
                    grid = np.concatenate([_widen(x, width) for x in held] or [np.zeros((0, 0))])
                    ids, held = np.concatenate(names or [np.zeros(0, np.int64)]), []
                if not len(grid):
                    continue
                for at in range(lo, hi, TILE):
                    own = name[at:min(at + TILE, hi)]
                    row, found, score = best(rows[at - lo:at - lo + len(own)], own, grid, ids, k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(row), shard)), pa.array(own[row]), pa.array(found),
                         pa.array(score)], names=["shard", "query_id", "vec_id", "score"])

    lists = sorted_rows.mapInArrow(run, "shard long, query_id long, vec_id long, score long")
    entry = F.struct((-F.col("score").cast("decimal(20,0)")).alias("low"), "vec_id", "score")
    top = lists.groupBy("query_id", F.floor(F.col("shard") / FAN).alias("shard")).agg(
        F.slice(F.array_sort(F.collect_list(entry)), 1, k).alias("top"))
    while shards > FAN:
        shards = math.ceil(shards / FAN)
        top = top.groupBy("query_id", F.floor(F.col("shard") / FAN).alias("shard")).agg(
            F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
    return (top.select("query_id", F.posexplode("top").alias("at", "e"))
            .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "e.vec_id", "e.score"))
