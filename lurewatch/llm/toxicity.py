"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words and the beginnings (4 to 9 letters) of longer words, lower-cased. Kept are the terms that at least LEAST
examples have and whose presence depends on the label (chi-square of CHI or more): only these tell the
classes apart, so the vectors are small. Weights are (1 + ln tf) * idf, scaled to length one.

The index stores, per term, its postings in the order of the examples, cut into blocks of BLOCK
examples, and the largest weight per term and block. A search adds these up to a bound per block, reads
blocks in descending order of their bounds, and stops when no bound reaches the K-th cosine found: the
result is exact. Neighbours vote with their cosine; a vote counts as many rows as the example stands
for in its class. A logistic curve of the vote, of the number of known terms in the text and of its
length, fitted to the examples (each voted on without itself), makes the score, so one such term in a
long text weighs less than many in a short one. The neighbours are returned as evidence.

Examples are a bounded sample: about SAMPLE labelled rows of each class, those with the smallest hashes
of their id. Everything else reads all rows and whole texts.

Defined cases: a text without a known term (empty and null texts too) has the score of no neighbours;
without examples of both classes every score is the share of toxic examples, 0 if there is none; an id
labelled twice takes the higher label, null labels don't count; rows that repeat an id are judged one by
one; equal cosines go to the example that comes first in the index; an empty table gives an empty
result. ``score`` ignores further columns, ``below`` carries them whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.llm.common import U64, Spans, lean, letters, mix64, schema_of, text_slices

SAMPLE, LEAST, CHI = 2000, 3, 15.0
PREFIXES = (4, 5, 6, 7, 8, 9)
FILTER_BITS = 20
K, BLOCK, FIRST_BLOCKS, PRIOR_WEIGHT = 25, 64, 8, 0.5
CHUNK = 1 << 18


def terms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term hash) of every word and every beginning of a longer word; words of each row."""
    line, bounds = letters(texts)
    if not len(line):
        return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(len(texts), np.int64)
    word = line != 32
    starts = np.flatnonzero(word & np.concatenate([[True], ~word[:-1]]))
    ends = np.flatnonzero(word & np.concatenate([~word[1:], [True]])) + 1
    row = np.searchsorted(bounds, starts, "right") - 1
    spans = Spans(line)
    rows, found = [row], [spans.hash(starts, ends)]
    for n in PREFIXES:
        longer = ends - starts > n
        rows.append(row[longer])
        found.append(mix64(spans.hash(starts[longer], starts[longer] + n) + U64(n)))
    return np.concatenate(rows), np.concatenate(found), np.bincount(row, minlength=len(texts))


def _bit(term: np.ndarray) -> np.ndarray:
    return (term >> U64(64 - FILTER_BITS)).astype(np.int64)


def vectors(texts: list[str | None], known: np.ndarray):
    """(row, term number, count) of the known terms of each text, rows ascending; words of each row."""
    row, term, words = terms(texts)
    if not len(known) or not len(term):
        none = np.zeros(0, np.int64)
        return none, none, none, words
    passed = np.zeros(1 << FILTER_BITS, bool)
    passed[_bit(known)] = True
    maybe = passed[_bit(term)]
    row, term = row[maybe], term[maybe]
    at = np.minimum(np.searchsorted(known, term), len(known) - 1)
    hit = known[at] == term
    key, n = np.unique(row[hit] * len(known) + at[hit], return_counts=True)
    return key // len(known), key % len(known), n, words


class Index:
    """Block-max index of examples, given as (row, term, count) with ids, labels and row weights."""

    def __init__(self, known: np.ndarray, row, term, count, ids, labels, stands_for, words=None):
        n, size = len(ids), len(known)
        words = np.zeros(n) if words is None else words
        hits = np.bincount(row, count, minlength=n)
        self.known, self.base = known, 0.0
        if n:
            self.base = float((labels * stands_for).sum() / stands_for.sum())
        df = np.bincount(term, minlength=size)
        self.idf = np.log((1 + n) / (1 + df)) + 1
        weight = (1 + np.log(np.maximum(count, 1))) * self.idf[term]
        norm = np.sqrt(np.bincount(row, weight ** 2, minlength=n))
        weight = weight / norm[row]
        # Examples with the same strongest term and label lie together, which tightens the bounds.
        top = np.full(n, size)
        order = np.lexsort((weight, row))
        top[row[order]] = term[order]
        place = np.lexsort((ids, top, labels))
        rank = np.empty(n, np.int64)
        rank[place] = np.arange(n)
        self.ids, self.labels = ids[place], labels[place].astype(float)
        self.stands_for = stands_for[place].astype(float)
        self.hits, self.words = hits[place], words[place]
        order = np.lexsort((rank[row], term))
        self.example, self.weight = rank[row][order], weight[order]
        term = term[order]
        self.blocks = max(1, -(-n // BLOCK))
        cell = term * self.blocks + self.example // BLOCK
        self.start = np.searchsorted(cell, np.arange(size * self.blocks + 1)).astype(np.int64)
        self.peak = np.zeros(size * self.blocks)
        np.maximum.at(self.peak, cell, self.weight)
        self.peak = self.peak.reshape(size, self.blocks)
        self.curve = np.array([1.0, 0.0, 0.0, 0.0])

    def nearest(self, term: np.ndarray, weight: np.ndarray, skip: int = -1, k: int = K):
        """(example, cosine) of the k nearest with a cosine over 0, nearest first."""
        bound = weight @ self.peak[term]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        best_at, best, at, step = np.zeros(0, np.int64), np.zeros(0), 0, FIRST_BLOCKS
        while at < len(order):
            those = order[at:at + step]
            if len(best) >= k:
                those = those[bound[those] * (1 + 1e-9) >= best[k - 1]]
                if not len(those):
                    break
            cell = term[:, None] * self.blocks + those
            lo, n = self.start[cell].ravel(), (self.start[cell + 1] - self.start[cell]).ravel()
            first = np.cumsum(n) - n
            place = np.arange(n.sum()) + np.repeat(lo - first, n)
            got, where = np.unique(self.example[place], return_inverse=True)
            cosine = np.bincount(where, self.weight[place]
                                 * np.repeat(np.repeat(weight, len(those)), n), len(got))
            keep = got != skip
            best_at = np.concatenate([best_at, got[keep]])
            best = np.concatenate([best, cosine[keep]])
            top = np.lexsort((best_at, -best))[:k]
            best_at, best, at, step = best_at[top], best[top], at + step, step * 2
        return best_at, np.minimum(best, 1.0)

    def query(self, term: np.ndarray, count: np.ndarray) -> np.ndarray:
        weight = (1 + np.log(count)) * self.idf[term]
        return weight / np.sqrt((weight ** 2).sum())

    def vote(self, example: np.ndarray, cosine: np.ndarray) -> float:
        weight = cosine * self.stands_for[example]
        total = PRIOR_WEIGHT + weight.sum()
        return float((PRIOR_WEIGHT * self.base + (weight * self.labels[example]).sum()) / total)

    @staticmethod
    def _features(vote, hits, words):
        p = np.clip(np.asarray(vote, float), 1e-6, 1 - 1e-6)
        return np.stack([np.log(p / (1 - p)), np.log1p(hits), np.log1p(words), np.ones(p.shape)], -1)

    def calibrated(self, vote, hits, words):
        # Longer texts than any example count as the longest one: the curve is not carried on.
        top = (self.hits.max(initial=0), self.words.max(initial=0))
        z = self._features(vote, np.minimum(hits, top[0]), np.minimum(words, top[1])) @ self.curve
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    def calibrate(self) -> None:
        """Fit the logistic curve to the examples' votes, each without itself (Newton steps)."""
        positive = (self.labels * self.stands_for).sum()
        negative = self.stands_for.sum() - positive
        if not positive or not negative:
            return
        votes = np.full(len(self.ids), self.base)
        order = np.argsort(self.example, kind="stable")
        terms_of = np.repeat(np.arange(len(self.known)), np.diff(self.start[::self.blocks]))
        cuts = np.searchsorted(self.example[order], np.arange(len(self.ids) + 1))
        for e in range(len(self.ids)):
            own = order[cuts[e]:cuts[e + 1]]
            if len(own):
                votes[e] = self.vote(*self.nearest(terms_of[own], self.weight[own], skip=e))
        x = self._features(votes, self.hits, self.words)
        target = np.where(self.labels > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
        start = np.array([1.0, 0.0, 0.0, 0.0])
        beta, ridge = start, np.eye(4)
        for _ in range(100):
            now = 1 / (1 + np.exp(-np.clip(x @ beta, -50, 50)))
            gradient = x.T @ (self.stands_for * (target - now)) - ridge @ (beta - start)
            curvature = (x * (self.stands_for * now * (1 - now))[:, None]).T @ x + ridge
            step = np.linalg.solve(curvature, gradient)
            beta = beta + np.clip(step, -1, 1)
            if np.abs(step).max() < 1e-8:
                break
        # The curve rises with the vote.
        self.curve = np.concatenate([[max(float(beta[0]), 0.1)], beta[1:]])

    def score(self, texts: list[str | None]):
        """(score, neighbours) of each text; neighbours are (example, cosine) arrays or None."""
        row, term, count, words = vectors(texts, self.known)
        hits = np.bincount(row, count, minlength=len(texts))
        votes, near = np.full(len(texts), self.base), [None] * len(texts)
        cuts = np.searchsorted(row, np.arange(len(texts) + 1))
        for r in np.unique(row):
            own = slice(cuts[r], cuts[r + 1])
            near[r] = self.nearest(term[own], self.query(term[own], count[own]))
            votes[r] = self.vote(*near[r])
        return (self.calibrated(votes, hits, words) if 0 < self.base < 1 else votes), near


def examples(docs: DataFrame, labels: DataFrame, sample: int, id_column: str, text: str,
             label: str) -> tuple[DataFrame, dict[int, float]]:
    """(id, text, label) of the sampled rows, and how many rows one stands for, by class."""
    known = (labels.select(F.col(id_column).alias("id"), F.col(label).cast("int").alias("label"))
             .where("id IS NOT NULL AND label IS NOT NULL").groupBy("id")
             .agg((F.max("label") > 0).cast("int").alias("label")))
    sizes = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    bound = F.lit(0.0)
    for one, n in sizes.items():
        bound = F.when(F.col("label") == one, min(1.0, sample / n) * 2.0 ** 63).otherwise(bound)
    chosen = known.where(F.shiftrightunsigned(F.xxhash64("id", F.lit(23)), 1) < bound)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text")).join(
        F.broadcast(chosen), "id")  # about ``sample`` rows of each class, whatever the table's size
    return rows, {one: max(1.0, n / sample) for one, n in sizes.items()}


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_column: str = "doc_id",
          text: str = "text", label: str = "toxic") -> Index:
    """An index of labelled examples; ``docs`` and ``labels`` hold rows that may be learned from."""
    rows, stands_for = examples(docs, labels, sample, id_column, text, label)

    def count(batches):
        for batch in batches:
            row, term, _ = terms(batch.column(0).to_pylist())
            order = np.lexsort((term, row))
            row, term = row[order], term[order]
            first = np.ones(len(row), bool)
            first[1:] = (row[1:] != row[:-1]) | (term[1:] != term[:-1])
            toxic = batch.column(1).to_numpy()[row[first]]
            found, at = np.unique(term[first], return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.view(np.int64)),
                 pa.array(np.bincount(at, toxic == 0, len(found)).astype(np.int64)),
                 pa.array(np.bincount(at, toxic == 1, len(found)).astype(np.int64))],
                names=["term", "clean", "toxic"])

    rows = rows.select("text", "label", "id")
    seen = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    clean_n, toxic_n = seen.get(0, 0), seen.get(1, 0)
    if not clean_n or not toxic_n:
        none = np.zeros(0, np.int64)
        made = Index(np.zeros(0, U64), none, none, none, none, none, np.zeros(0))
        made.base = 1.0 if toxic_n else 0.0
        return made
    a, b = F.col("toxic"), F.col("clean")
    total, c, d = float(clean_n + toxic_n), toxic_n - F.col("toxic"), clean_n - F.col("clean")
    chi = total * (a * d - b * c) ** 2 / (float(toxic_n) * clean_n * (a + b) * (c + d))
    told = (rows.select("text", "label").mapInArrow(lean(count), "term long, clean long, toxic long")
            .groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
            .where((F.col("clean") + F.col("toxic") >= LEAST) & (c + d > 0) & (chi >= CHI)))
    # Bounded by the sample: the terms and the examples' vectors.
    known = np.sort(told.select("term").toArrow().column(0).to_numpy().view(U64))

    def sparse(batches):
        for batch in batches:
            n = batch.num_rows
            row, term, number, words = vectors(batch.column(0).to_pylist(), known)
            cuts = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x.astype(np.int32)))
                     for x in (term, number)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(2).cast(pa.int64()), batch.column(1), *lists, pa.array(words, pa.int64())],
                names=["id", "label", "term", "n", "words"])

    got = rows.mapInArrow(
        lean(sparse), "id long, label int, term array<int>, n array<int>, words long").toArrow()
    got = got.sort_by([("id", "ascending"), ("label", "ascending"), ("words", "ascending")])
    lists = got.column("term").combine_chunks()
    term = lists.flatten().to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(got)), np.diff(lists.offsets.to_numpy()))
    label = got.column("label").to_numpy()
    made = Index(known, row, term, got.column("n").combine_chunks().flatten().to_numpy(),
                 got.column("id").to_numpy(), label,
                 np.where(label == 1, stands_for.get(1, 1.0), stands_for.get(0, 1.0)),
                 got.column("words").to_numpy())
    made.calibrate()
    return made


def below(docs: DataFrame, index: Index, limit: float, text: str = "text") -> DataFrame:
    """The rows whose own score is below ``limit``, with all their columns; ids play no part."""
    held = docs.sparkSession.sparkContext.broadcast(index)
    place = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, place, CHUNK):
                scores, _ = held.value.score(part.column(place).to_pylist())
                yield part.filter(pa.array(np.asarray(scores) < limit))

    return docs.withColumn(text, F.col(text).cast("string")).mapInArrow(
        lean(run), schema_of(docs.withColumn(text, F.col(text).cast("string")), *docs.columns))


def score(docs: DataFrame, index: Index, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, evidence (id, cosine, label of the neighbours) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(index)
    entry = pa.list_(pa.struct([("id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, 1, CHUNK):
                scores, near = held.value.score(part.column(1).to_pylist())
                found = [[] if x is None else [
                    {"id": i, "cosine": c, "label": int(y)} for i, c, y in
                    zip(held.value.ids[x[0]].tolist(), x[1].tolist(), held.value.labels[x[0]])]
                    for x in near]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(scores, pa.float64()), pa.array(found, entry)], names=["doc_id", "score", "evidence"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"),
                       F.col(text).cast("string").alias("text")).mapInArrow(
        lean(run), "doc_id long, score double, evidence array<struct<id: long, cosine: double, label: int>>")
