"""Array helpers shared by the operators: text chunks, words, strong hashes over Arrow batches."""

from __future__ import annotations

import ctypes
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lurewatch.session import shared_path

U64 = np.uint64
CHUNK_BYTES = 1 << 20
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
_caches: list = []
_last_stage: list[int | None] = [None]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: the lineage ends here."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Let an Arrow batch hold BATCH_BYTES at most (or one row): ten thousand long texts and the doubled
    buffers they are written to need not fit beside the heap."""
    number, unit = re.match(r"(\d+)\s*([kmg]?)", spark.conf.get(BATCH).lower()).groups()
    if int(number) << {"": 0, "k": 10, "m": 20, "g": 30}[unit] > BATCH_BYTES:
        spark.conf.set(BATCH, str(BATCH_BYTES))


def for_one_stage(empty) -> None:
    """Register what empties a cache that a Python worker keeps from task to task of one stage."""
    _caches.append(empty)


def give_back() -> None:
    """Return freed memory to the system; the allocators keep most of what large arrays have left."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def new_stage() -> None:
    """A Python worker outlives its stage: empty what the tasks of another stage have kept in it."""
    task = TaskContext.get()
    if task and task.stageId() != _last_stage[0]:
        _last_stage[0] = task.stageId()
        for empty in _caches:
            empty()
        give_back()


def lean(run):
    """``run`` over Arrow batches, in a worker that holds no caches of other stages before and no freed
    memory after the task: idle workers lie beside the heap of the executor."""
    def lean_run(batches):
        new_stage()
        yield from run(batches)
        give_back()

    return lean_run


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def in_training(id_column: str = "doc_id"):
    """Rows whose crc32(id as text) mod 3 is not 1."""
    return ~held_out(id_column)


def held_out(id_column: str = "doc_id"):
    """The remainder is 1; a null id counts as not held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fresh(df: DataFrame, *wanted: str) -> dict[str, str]:
    """Names for helper columns that clash with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = {}
    for name in wanted:
        new = name
        while new.lower() in taken:
            new = f"_{new}"
        taken.add(new.lower())
        out[name] = new
    return out


def schema_of(df: DataFrame, *columns: str) -> StructType:
    return StructType([StructField(f.name, f.dataType, True) for f in
                       (df.schema[c] for c in columns)])


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer with full avalanche, on uint64 arrays."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def _ladder(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for slot, base in ((0, _BASE), (1, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, U64)
            steps[0] = 1
            _powers[slot] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def _forget_ladder() -> None:
    _powers[:] = [np.ones(1, U64), np.ones(1, U64)]


for_one_stage(_forget_ladder)


class Spans:
    """Hashes of many slices of one array, from one running sum."""

    def __init__(self, values: np.ndarray):
        up, self._down = _ladder(len(values) + 1)
        self._sums = np.zeros(len(values) + 1, U64)
        np.cumsum(mix64(values.astype(U64) + U64(0x5851F42D4C957F2D)) * up[:-1],
                  out=self._sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((self._sums[ends] - self._sums[starts]) * self._down[starts]
                     + (ends - starts).astype(U64))


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES):
    """(first row, end row, bytes, offsets) of runs of whole texts, about ``limit`` bytes each.

    A longer text is a chunk of its own; a null text is empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, places, data = column.buffers()
    at = np.frombuffer(places, np.int64)[column.offset:column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]
        lo = hi


def text_slices(batch: pa.RecordBatch, place: int, limit: int = CHUNK_BYTES):
    """Slices of a batch with about ``limit`` bytes in its text column; a longer text is alone."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(place)), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < batch.num_rows:
        hi = int(np.searchsorted(size, (size[lo - 1] if lo else 0) + limit, "right"))
        hi = max(hi, lo + 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def words_of(data: np.ndarray, offsets: np.ndarray):
    """Starts, ends and row numbers of the words ``[^\\x20\\x09-\\x0D]+`` of a chunk."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    word = ~_SPACE[data]
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    filled = offsets[1:] > offsets[:-1]
    first[offsets[:-1][filled]] = True
    last[offsets[1:][filled] - 1] = True
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:] = ~word[:-1]
    after[:-1] = ~word[1:]
    starts = np.flatnonzero(word & (first | before))
    ends = np.flatnonzero(word & (last | after)) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z on UTF-8 bytes."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


_tables: dict[str, np.ndarray] = {}


def char_table(kind: str) -> np.ndarray:
    """Per code point: its one-character lower case, or whether it is a letter (or digit)."""
    if kind not in _tables:
        every = range(0x110000)
        if kind == "lower":
            made = np.arange(0x110000, dtype=np.uint32)
            for c in every:
                if not 0xD800 <= c < 0xE000:
                    low = chr(c).lower()
                    if len(low) == 1:
                        made[c] = ord(low)
        else:
            test = str.isalpha if kind == "letter" else str.isalnum
            made = np.fromiter((test(chr(c)) for c in every), bool, 0x110000)
        _tables[kind] = made
    return _tables[kind]


def letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of all texts in one line, spaces between words; and the texts' bounds.

    Every text begins and ends with a space; a text without a letter has nothing.
    """
    low, letter = char_table("lower"), char_table("letter")
    lines, ends = [], []
    for text in texts:
        points = low[code_points(text)]
        is_letter = letter[points]
        if is_letter.any():
            points = np.where(is_letter, points, np.uint32(32))
            line = np.concatenate([[np.uint32(32)], points, [np.uint32(32)]])
            gap = line == 32
            keep = ~gap
            keep[1:] |= gap[1:] & ~gap[:-1]
            keep[0] = True
            lines.append(line[keep])
        else:
            lines.append(np.zeros(0, np.uint32))
        ends.append(len(lines[-1]))
    return (np.concatenate(lines) if lines else np.zeros(0, np.uint32),
            np.concatenate([[0], np.cumsum(ends)]).astype(np.int64))


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)
