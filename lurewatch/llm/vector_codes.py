"""Vector code compression: one codebook per part of the vectors, by dual-tree Lloyd rounds.

Components become integers floor(256 * x) and a vector is cut into ``parts`` equal consecutive parts. A
task takes its vectors chunk by chunk. Over the parts of a chunk it builds one tree for each part position
(halves along the widest side; every node keeps its box, count and sums), over each codebook another.
Both are walked downward together: of the entry nodes that meet a node of parts, those whose least
distance exceeds the least greatest distance are dropped. A node left with one entry is assigned whole,
by its cached sums; leaves that stay uncertain compare integers. A round sends counts and sums per
part position and entry, nothing else, and the driver holds the codebooks: as many numbers as a vector
has components, times ``entries``.

Defined cases: rows whose vector is null or holds null or non-finite components are dropped; a null id is
coded but starts no entry; of an id that repeats the smallest vector starts an entry, all rows are coded;
vectors of different length count as padded with zeros to the longest, rounded up to whole parts; with
fewer ids than entries the codebooks are shorter; with no id at all every entry is a zero vector of which
there is one; equal entries lose to the lower index; scaled components beyond 10**28 count as that, and
errors beyond a long as the largest long; an empty table gives an empty result. Further columns are not
carried, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.llm.common import stored

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
CHUNK, LEAF = 4096, 32
FAR, LONG = 10 ** 28, (1 << 63) - 1
#: More than this share of the rows makes a label hot; so at most SHARE labels are.
SHARE = 64


class Forest:
    """One tree per group of equally many points: level l cuts every group into 2**l runs of ``order``."""

    def __init__(self, points: np.ndarray, groups: int, leaf: int):
        n = len(points) // groups
        self.order = np.arange(len(points))
        bounds = np.arange(groups + 1) * n
        self.levels = []
        for level in range(max(0, (n // leaf).bit_length() - 1) + 1 if n else 0):
            if level:
                size = np.diff(bounds)
                wide = (self.levels[-1][2] - self.levels[-1][1]).argmax(axis=1)
                node = np.repeat(np.arange(len(size)), size)
                along = points[self.order, wide[node]]
                self.order = self.order[np.lexsort((along, node))]
                halves = np.empty(2 * len(size) + 1, np.int64)
                halves[0::2], halves[1::2] = bounds, (bounds[:-1] + bounds[1:]) // 2
                bounds = halves
            rows, at = points[self.order], bounds[:-1]
            self.levels.append((bounds, np.minimum.reduceat(rows, at), np.maximum.reduceat(rows, at)))
        rows = points[self.order]
        self.sums = [np.add.reduceat(rows, level[0][:-1]) for level in self.levels]


def _bounds(a, b, x, y):
    """Least and greatest squared distance between boxes ``a[x]`` and ``b[y]``."""
    near = far = 0
    for k in range(a[1].shape[1]):
        lo, hi = a[1][x, k] - b[2][y, k], a[2][x, k] - b[1][y, k]
        gap = np.maximum(np.maximum(lo, -hi), 0)
        wide = np.maximum(np.abs(lo), np.abs(hi))
        near, far = near + gap * gap, far + wide * wide
    return near, far


def assign(points: np.ndarray, entries: np.ndarray):
    """Nearest entry of each part (ties to the lower index), and counts and sums per entry.

    ``points`` is (positions, rows, width), ``entries`` (positions, entries, width), integers whose
    squared distances fit 64 bits.
    """
    groups, n, width = points.shape
    k = entries.shape[1]
    flat, book = points.reshape(-1, width), entries.reshape(-1, width)
    left, right = Forest(flat, groups, LEAF), Forest(book, groups, 1)
    nearest = np.zeros(groups * n, np.int64)
    counts, sums = np.zeros(groups * k, np.int64), np.zeros((groups * k, width), np.int64)
    p = e = np.arange(groups)
    depth = max(len(left.levels), len(right.levels))
    for step in range(depth):
        i, j = min(step, len(left.levels) - 1), min(step, len(right.levels) - 1)
        if step:
            if i == step:
                p, e = np.concatenate([2 * p, 2 * p + 1]), np.concatenate([e, e])
            if j == step:
                p, e = np.concatenate([p, p]), np.concatenate([2 * e, 2 * e + 1])
        a, b = left.levels[i], right.levels[j]
        near, far = _bounds(a, b, p, e)
        least = np.full(len(a[0]) - 1, np.iinfo(np.int64).max)
        np.minimum.at(least, p, far)
        stay = near <= least[p]
        p, e = p[stay], e[stay]
        alone = (np.bincount(p, minlength=len(least))[p] == 1) & (b[0][e + 1] - b[0][e] == 1)
        if alone.any():
            nodes, chosen = p[alone], right.order[b[0][e[alone]]]
            begin, size = a[0][nodes], a[0][nodes + 1] - a[0][nodes]
            np.add.at(counts, chosen, size)
            np.add.at(sums, chosen, left.sums[i][nodes])
            run = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
            nearest[left.order[run]] = np.repeat(chosen, size)
            p, e = p[~alone], e[~alone]
    if len(p):
        a, b = left.levels[-1], right.levels[-1]
        size = b[0][e + 1] - b[0][e]
        leaf = np.repeat(p, size)
        entry = right.order[np.repeat(b[0][e] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        by = np.lexsort((entry, leaf))
        leaf, entry = leaf[by], entry[by]
        # Leaves differ by one row at most; the last row stands twice in the shorter ones.
        most = int(np.diff(a[0]).max())
        place = np.minimum(a[0][leaf][:, None] + np.arange(most), a[0][leaf + 1][:, None] - 1)
        rows = left.order[place]
        far = sum((flat[rows, x] - book[entry, x][:, None]) ** 2 for x in range(width))
        first = np.flatnonzero(np.diff(leaf, prepend=-1))
        best = np.minimum.reduceat(far, first)
        number = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(leaf))))
        chosen = np.minimum.reduceat(np.where(far == best[number], entry[:, None], groups * k), first)
        size = np.diff(a[0])[leaf[first]]
        real = np.arange(most) < size[:, None]
        rows, chosen = rows[first][real], chosen[real]
        nearest[rows] = chosen
        np.add.at(counts, chosen, 1)
        np.add.at(sums, chosen, flat[rows])
    return (nearest.reshape(groups, n) - np.arange(groups)[:, None] * k, counts.reshape(groups, k),
            sums.reshape(groups, k, width))


def _assign_any(points: np.ndarray, entries: np.ndarray):
    """The same for integers of any size, one by one."""
    groups, n, width = points.shape
    nearest = np.zeros((groups, n), np.int64)
    counts = np.zeros(entries.shape[:2], np.int64)
    sums = np.zeros(entries.shape, object)
    for g in range(groups):
        for r in range(n):
            far = [sum((int(x) - int(y)) ** 2 for x, y in zip(points[g, r], c)) for c in entries[g]]
            nearest[g, r] = best = far.index(min(far))
            counts[g, best] += 1
            sums[g, best] += points[g, r]
    return nearest, counts, sums


def scaled(flat: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as 64-bit integers, or as Python integers if some are too large for them."""
    with np.errstate(over="ignore"):
        grown = np.floor(flat * float(SCALE))
    if np.abs(grown).max(initial=0) < 2.0 ** 53:
        return grown.astype(np.int64)
    whole = (int(g) if math.isfinite(g) else int(x) * SCALE for g, x in zip(grown.tolist(), flat.tolist()))
    return np.array([max(-FAR, min(FAR, w)) for w in whole], object)


def _parts(column: pa.Array, width: int, parts: int) -> np.ndarray:
    """(part, row, component) of a list column, short rows padded with zeros."""
    at = column.offsets.to_numpy()
    flat = scaled(column.values.to_numpy(zero_copy_only=False)[at[0]:at[-1]].astype(np.float64))
    at = at - at[0]
    size = np.diff(at)
    grid = np.zeros((len(size), width), flat.dtype)
    grid[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(at[:-1], size)] = flat
    return np.ascontiguousarray(grid.reshape(len(size), parts, -1).transpose(1, 0, 2))


def _nearest(points: np.ndarray, entries: np.ndarray):
    peak = max(int(abs(x).max(initial=0)) for x in (points, entries))
    if points.dtype != object and entries.dtype != object and (2 * peak) ** 2 * points.shape[2] < 1 << 62:
        return assign(points, entries)
    return _assign_any(points, entries)


def _chunks(batch: pa.RecordBatch, at: int, width: int, parts: int):
    """(first row, parts) of slices of up to CHUNK vectors."""
    for lo in range(0, batch.num_rows, CHUNK):
        yield lo, _parts(batch.column(at).slice(lo, CHUNK), width, parts)


def usable(vectors: DataFrame, id_column: str, vector: str, label: str | None) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    tag = F.lit(None).cast("int") if label is None else F.col(label)
    return (vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v"), tag.alias("label"))
            .where(F.col("v").isNotNull() & F.forall(
                "v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))))


def _start(rows: DataFrame, width: int, parts: int, entries: int) -> np.ndarray:
    """Codebooks from the vectors of the smallest ids: (part, entry, component)."""
    ids = [r.vec_id for r in rows.where("vec_id IS NOT NULL").select("vec_id").distinct()
           .orderBy("vec_id").limit(entries).collect()]
    found = rows.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("v").alias("v")).collect()
    first = [r.v for r in sorted(found, key=lambda r: r.vec_id)] or [[]]
    return _parts(pa.array(first, pa.list_(pa.float64())), width, parts)


def _round(rows: DataFrame, books: np.ndarray, width: int) -> np.ndarray:
    """Assign every part and replace each used entry by the floor of its parts' mean."""
    parts, entries, size = books.shape

    def run(batches):
        counts, sums = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, object)
        for batch in batches:
            for _, points in _chunks(batch, 0, width, parts):
                _, n, s = _nearest(points, books)
                counts += n
                sums += s
        used = np.argwhere(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used[:, 0], pa.int32()), pa.array(used[:, 1], pa.int32()),
             pa.array(counts[tuple(used.T)], pa.int64()),
             pa.array([[Decimal(int(x)) for x in sums[p, e]] for p, e in used],
                      pa.list_(pa.decimal128(38, 0)))], names=["part", "entry", "n", "sums"])

    found = rows.select("v").mapInArrow(
        run, "part int, entry int, n bigint, sums array<decimal(38,0)>").groupBy("part", "entry").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[k]) for k in range(size)]).alias("sums"))
    new = books.astype(object)
    for r in found.collect():
        new[r.part, r.entry] = [int(s) // r.n for s in r.sums]
    small = max(abs(int(x)) for x in new.flat) < 1 << 53 if new.size else True
    return new.astype(np.int64) if small else new


def learn(rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES,
          rounds: int = ROUNDS) -> np.ndarray:
    books = _start(rows, width, parts, entries)
    for _ in range(rounds):
        books = _round(rows, books, width)
    return books


def code(rows: DataFrame, books: np.ndarray, width: int) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error of every row."""
    parts = books.shape[0]

    def run(batches):
        for batch in batches:
            codes, errors = [], []
            for _, points in _chunks(batch, 2, width, parts):
                nearest, _, _ = _nearest(points, books)
                gap = points - books[np.arange(parts)[:, None], nearest]
                if gap.dtype != object and int(np.abs(gap).max(initial=0)) ** 2 * width >= 1 << 62:
                    gap = gap.astype(object)
                far = (gap * gap).sum(axis=(0, 2))
                errors += [min(LONG, int(x)) for x in far]
                codes += [row.tobytes().hex() for row in nearest.T.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(errors, pa.int64())],
                names=["vec_id", "label", "code", "error"])

    label = dict(rows.dtypes)["label"]
    return rows.select("vec_id", "label", "v").mapInArrow(
        run, f"vec_id bigint, label {label}, code string, error bigint")


def fingerprint(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in books.flat).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """Add the errors' sum over equal labels, null labels together.

    Labels with more than one SHAREth of the rows, SHARE at most, are looked up in a broadcast table;
    the rows of all others meet their sum in a shuffle.
    """
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)"))
    sums = coded.groupBy("label").agg(F.count("*").alias("n"), total.cast("long").alias("label_error"))
    sums = stored(sums.withColumnRenamed("label", "of"), "label-errors")
    rows = sums.agg(F.sum("n")).first()[0] or 0
    hot = sums.where(F.col("n") * SHARE > rows).select("of", "label_error", F.lit(True).alias("hot"))
    same = F.col("label").eqNullSafe(F.col("of"))
    seen = coded.join(F.broadcast(hot), same, "left").drop("of")
    columns = [*coded.columns, "label_error"]
    rest = seen.where("hot IS NULL").drop("hot", "label_error").join(
        sums.where(F.col("n") * SHARE <= rows).select("of", "label_error"), same)
    return seen.where("hot").select(*columns).unionByName(rest.select(*columns))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
             id_column: str = "vec_id", vector: str = "embedding", label: str | None = "label") -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 of every usable row; up to 256 entries."""
    if not 1 <= entries <= 256:
        raise ValueError("entries must lie between 1 and 256")
    rows = usable(vectors, id_column, vector, label)
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    width = max(1, -(-longest // parts)) * parts
    books = learn(rows, width, parts, entries, rounds)
    coded = stored(code(rows, books, width), "vector-codes")
    return with_label_error(coded).withColumn("codebooks_sha256", F.lit(fingerprint(books)))
