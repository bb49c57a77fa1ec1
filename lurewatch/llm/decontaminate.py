"""Benchmark passages in documents: q-gram lemma filtering in diagonal bands, then banded alignment.

Texts are compared by their letters and digits in lower case, other runs as one space. A passage of n
characters occurs if some part of a document is within ``budget`` = floor(RATE * n) edits of it. Then, by
the q-gram lemma, at least n - Q + 1 - Q * budget of its Q-grams lie, unchanged, on diagonals (place in
the document minus place in the passage) at most ``budget`` apart. Diagonals are cut into overlapping
bands of twice that width, so one band holds them all; bands with enough shared Q-grams are kept, and a
banded alignment of the passage with that region decides.

The Q-grams of the passages form an index that every task gets. It is made from at most INDEX_CHARS
characters of passages at a time; a larger benchmark takes several passes over the documents, so no
broadcast grows with it. Documents are read whole, in windows that overlap by more than a region.

Passages shorter than SHORT normalized characters must begin and end at bounds of words, because inside of
words they can't be told from chance; their edits are at most as many as the lemma allows with Q, which is
one less than ``budget`` for some lengths, and those without a Q-gram must occur unchanged.

Defined cases: a null or empty text has no hits; passages without a letter or digit occur nowhere; a null
item id is a passage of its own and is reported as null; equal passages under several ids hit under each
of them; rows that repeat an id are judged one by one and their equal hits are reported once; a null
document id is reported as null; a very long passage is aligned with windows of its own length, in time that
grows with the square of it; empty tables give an empty result. ``find`` ignores further columns, ``clean``
carries them whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.llm.common import U64, char_table, code_points, lean, mix64, schema_of, stored

Q, RATE, SHORT = 8, 0.1, 40
INDEX_CHARS, WINDOW = 1 << 21, 1 << 16
FILTER_BITS = 22
SCHEMA = "doc_id long, item_id long, begin int, end int, edits int"


def normalized(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Characters to compare, and the place of each in the text."""
    points = char_table("lower")[code_points(text)]
    kept = char_table("alnum")[points]
    points = np.where(kept, points, np.uint32(32))
    keep = kept.copy()
    keep[1:] |= kept[:-1]
    place = np.flatnonzero(keep)
    line = points[place]
    if len(line) and line[-1] == 32:
        line, place = line[:-1], place[:-1]
    return line, place


def _text(line: np.ndarray) -> str:
    return line.astype("<u4").tobytes().decode("utf-32-le")


def qgrams(line: np.ndarray) -> np.ndarray:
    n = len(line) - Q + 1
    if n <= 0:
        return np.zeros(0, U64)
    h = np.zeros(n, U64)
    for k in range(Q):
        h = h * U64(0x9E3779B97F4A7C15) + line[k:k + n].astype(U64) + U64(1)
    return mix64(h)


def aligned(item: np.ndarray, part: np.ndarray, low: int, high: int, budget: int):
    """(edits, begin, end) of the best match of ``item`` inside ``part``, or None over the budget.

    Only diagonals low to high (place in part minus place in item) are looked at; begin and end are
    places in ``part``. Unchanged copies are compared first; of equal matches the first counts.
    """
    width, n = high - low + 1, len(item)
    for d in range(max(low, 0), min(high, len(part) - n) + 1):
        if part[d] == item[0] and np.array_equal(part[d:d + n], item):
            return 0, d, d + n
    far = budget + 1
    places = np.arange(width) + low
    # Cost of the empty prefix is 0 at every start inside the part.
    cost = np.where((places >= 0) & (places <= len(part)), 0, far)
    start = places.copy()
    step = np.arange(width)
    for i in range(n):
        at = places + i
        inside = (at >= 0) & (at < len(part))
        same = np.zeros(width, bool)
        same[inside] = part[at[inside]] == item[i]
        new = cost + ~same
        new[~inside] = far
        begin = start.copy()
        # A character of the item is missing in the part: from the next diagonal.
        skip = np.append(cost[1:] + 1, far)
        skip[(at + 1 < 0) | (at + 1 > len(part))] = far
        better = skip < new
        new[better] = skip[better]
        begin[better] = np.append(start[1:], 0)[better]
        # A further character of the part: from the diagonals before, one edit each.
        reach = new - step
        best = np.minimum.accumulate(reach)
        source = np.maximum.accumulate(np.where(reach == best, step, 0))
        valid = (at + 1 >= 0) & (at + 1 <= len(part))
        cost = np.minimum(np.where(valid, best + step, far), far)
        start = begin[source]
        if cost.min() > budget:
            return None
    ends = places + n
    cost = np.where((ends >= 0) & (ends <= len(part)), cost, far)
    at = int(cost.argmin())
    if cost[at] > budget:
        return None
    return int(cost[at]), int(start[at]), int(ends[at])


class Passages:
    """The Q-grams of some passages: sorted hashes with their postings, and a bit filter before them.

    Short passages are an index of their own, with a space on both sides of each: their words' bounds.
    """

    def __init__(self, ids: list[int | None], texts: list[str | None]):
        lines = [(i, normalized(t)[0]) for i, t in zip(ids, texts)]
        self._index([(i, x) for i, x in lines if len(x) >= SHORT], False)
        short = [(i, np.pad(x, 1, constant_values=32)) for i, x in lines if 0 < len(x) < SHORT]
        self.short = Passages.__new__(Passages) if short else None
        if short:
            self.short._index([(i, x) for i, x in short if len(x) >= Q], True)
            self.short.tiny = [(i, _text(x)) for i, x in short if len(x) < Q]

    def _index(self, lines: list[tuple[int | None, np.ndarray]], bounded: bool) -> None:
        self.bounded, self.tiny, self.short = bounded, [], None
        self.ids, self.lines = [i for i, _ in lines], [x for _, x in lines]
        self.length = np.array([len(x) for x in self.lines], np.int64)
        self.budget = np.floor(RATE * (self.length - 2 * bounded)).astype(np.int64)
        if bounded:
            self.budget = np.minimum(self.budget, (self.length - Q) // Q)
        self.need = np.maximum(1, self.length - Q + 1 - Q * self.budget)
        hashes = [qgrams(x) for x in self.lines]
        every = np.concatenate(hashes) if hashes else np.zeros(0, U64)
        item = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else item
        order = np.argsort(every, kind="stable")
        self.item, self.place = item[order], place[order]
        self.hashes, self.first = np.unique(every[order], return_index=True)
        self.first = np.append(self.first, len(every))
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self._bit(self.hashes)] = True
        self.longest = int(self.length.max(initial=0))

    @staticmethod
    def _bit(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> U64(64 - FILTER_BITS)).astype(np.int64)

    def candidates(self, line: np.ndarray):
        """(item, lowest diagonal of the band) of the bands with enough shared Q-grams."""
        hashes = qgrams(line)
        spot = np.flatnonzero(self.filter[self._bit(hashes)])
        at = np.searchsorted(self.hashes, hashes[spot])
        at = np.minimum(at, max(len(self.hashes) - 1, 0))
        hit = self.hashes[at] == hashes[spot] if len(self.hashes) else np.zeros(0, bool)
        spot, at = spot[hit], at[hit]
        n = self.first[at + 1] - self.first[at]
        spot = np.repeat(spot, n)
        entry = np.arange(len(spot)) + np.repeat(self.first[at] - (np.cumsum(n) - n), n)
        item, diagonal = self.item[entry], spot - self.place[entry]
        width = self.budget[item] + 1
        band = np.floor_divide(diagonal, width)
        # Each diagonal lies in the band that begins at its cell and in the one before.
        item = np.concatenate([item, item])
        band = np.concatenate([band, band - 1])
        place = np.concatenate([self.place[entry]] * 2)
        size = np.int64(len(line) + self.longest + 4)
        # Distinct places of the passage count, so a repeated phrase doesn't fill a band.
        key = np.unique((item * (2 * size) + band + size) * np.int64(self.longest + 1) + place)
        cell, count = np.unique(key // (self.longest + 1), return_counts=True)
        item, band = cell // (2 * size), cell % (2 * size) - size
        enough = count >= self.need[item]
        item = item[enough]
        return item, band[enough] * (self.budget[item] + 1)

    def hits(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item id, begin, end, edits) of the passages in a text, in its own code points."""
        line, place = normalized(text)
        found = self._found(line, place)
        if self.short and len(line):
            found |= self.short._found(np.pad(line, 1, constant_values=32), np.pad(place, 1, "edge"))
        return [(i, a, b, e) for (i, a, b), e in sorted(
            found.items(), key=lambda x: (x[0][0] is None, x[0][0] or 0, x[0][1:]))]

    def _found(self, line: np.ndarray, place: np.ndarray) -> dict[tuple, int]:
        """Edits by (item id, begin, end)."""
        found = {}
        if self.tiny:
            whole = _text(line)
            for item, word in self.tiny:
                at = whole.find(word)
                while at >= 0:
                    found[item, int(place[at + 1]), int(place[at + len(word) - 2]) + 1] = 0
                    at = whole.find(word, at + 1)
        if not self.ids or not self.bounded and len(line) < SHORT - int(RATE * SHORT):
            return found
        overlap = 2 * self.longest + Q
        step = max(WINDOW, 2 * overlap)
        for lo in range(0, max(1, len(line) - overlap), step):
            window = line[lo:lo + step + overlap]
            for k, low in zip(*self.candidates(window)):
                budget = int(self.budget[k])
                match = aligned(self.lines[k], window, int(low), int(low) + 2 * budget + 1, budget)
                if match:
                    edits, begin, end = match
                    if self.bounded:
                        if window[begin] != 32 or window[end - 1] != 32 or end - begin < 3:
                            continue
                        begin, end = begin + 1, end - 1
                    spot = (self.ids[k], int(place[lo + begin]), int(place[lo + end - 1]) + 1)
                    found[spot] = min(edits, found.get(spot, edits))
        return found


def _indexes(benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text"):
    """(broadcast index of some passages, whether another pass follows) of each pass over the documents.

    An index is built when its pass begins. A pass that is followed by another is finished, and its index
    released, before that: no task and no executor holds more than one.
    """
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"),
                             F.col(item_text).cast("string").alias("text")).where(
        "text IS NOT NULL")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = max(1, -(-2 * chars // INDEX_CHARS))
    for k in range(passes):
        # About INDEX_CHARS / 2 characters of passages.
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).orderBy(
            "item_id", "text").toArrow()
        yield spark.sparkContext.broadcast(Passages(
            part.column(0).to_pylist(), part.column(1).to_pylist())), k < passes - 1


def find(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text",
         item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, begin, end, edits: every benchmark passage found in a document."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"),
                       F.col(text).cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], SCHEMA)
    for index, more in _indexes(benchmark, item_id, item_text):
        def run(batches, index=index):
            for batch in batches:
                found = [(i, *hit) for i, t in zip(batch.column(0).to_pylist(),
                                                   batch.column(1))
                         for hit in index.value.hits(t.as_py())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(x), kind) for x, kind in
                     zip(zip(*found) if found else [[]] * 5,
                         (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))],
                    names=["doc_id", "item_id", "begin", "end", "edits"])

        part = rows.mapInArrow(lean(run), SCHEMA)
        if more:
            part = stored(part, "hits")
            index.destroy()
        out = out.unionByName(part)
    return out.distinct()


def unsearched(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The passages shorter than SHORT, of which ``find`` only takes whole words and fewer edits."""
    def run(batches):
        for batch in batches:
            short = [len(normalized(t)[0]) < SHORT for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(short, pa.bool_()))],
                                             names=["item_id"])

    return benchmark.select(F.col(item_id).cast("long").alias("item_id"),
                            F.col(text).cast("string")).mapInArrow(lean(run), "item_id long")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows without a benchmark passage in their own text, with all their columns; ids play no part."""
    place = docs.columns.index("text")
    docs = docs.withColumn("text", F.col("text").cast("string"))
    for index, more in _indexes(benchmark):
        def run(batches, index=index):
            for batch in batches:
                yield batch.filter(pa.array([not index.value.hits(t.as_py())
                                             for t in batch.column(place)], pa.bool_()))

        docs = docs.mapInArrow(lean(run), schema_of(docs, *docs.columns))
        if more:
            docs = stored(docs, "clean")
            index.destroy()
    return docs
