"""Language identification with language-bitmask n-gram filters.

A model is a bit-sliced Bloom filter: a table of cells, each a mask with one bit per language. An
n-gram sets its languages' bits in HASHES cells; the AND of these cells gives, in one look, all
languages that contain it. A text is decided by the popcount per language over its n-grams, corrected
for the filter's false positives: with fill f of a language's bits a strange n-gram passes with
probability f**HASHES, so the expected passes are taken away before languages are compared.

An n-gram is assigned to every language whose share of texts with it is at least RATIO of the largest
share, and to none if that is seen in fewer than LEAST texts. Shares are counted on a sample of the
labelled rows, about SAMPLE texts per language (a hash of id, text and a number of the row below a bound
per language, so rows without an id or of one id are drawn one by one); whole texts are read, and all
counting runs in Spark. A cell has one word for 64 languages, and as many words as there are languages; the
driver holds the list of languages, a model's output.

Text is lower-cased per code point; runs of non-letters are one space.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; a text whose n-grams are
all unknown gets the most frequent language and score 0; ties go to the first language in code point
order; without any labelled row everything is ``und``; null ids are judged and learned from like others;
an empty table gives an empty result. Further columns are not carried, so their names cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.llm.common import U64, letters, mix64, text_slices

ORDERS = (2, 3, 4)
SAMPLE, LEAST, RATIO = 1500, 3, 0.5
HASHES, BITS_PER_GRAM = 3, 16
CHUNK = 1 << 18
_SALT = [U64(0x9E3779B97F4A7C15 * (2 * k + 1) & (2**64 - 1)) for k in range(8)]


def grams(line: np.ndarray, order: int) -> np.ndarray:
    """Hash of the n-gram that begins at each place of ``line``; 0 where none fits in."""
    n = len(line) - order + 1
    if n <= 0:
        return np.zeros(0, U64)
    h = np.full(n, order, U64)
    for k in range(order):
        h = (h + line[k:k + n].astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15)
        h ^= h >> U64(29)
    return mix64(h)


class Model:
    """The filter: ``cells`` (size, words) of language masks, and each language's share of bits."""

    def __init__(self, languages: list[str], hashes: np.ndarray, masks: np.ndarray, common: int):
        words = masks.shape[1]
        self.languages, self.common = languages, common
        self.bits = max(10, int(len(hashes) * BITS_PER_GRAM - 1).bit_length()) if len(hashes) else 10
        self.cells = np.zeros((1 << self.bits, words), U64)
        for k in range(HASHES):
            np.bitwise_or.at(self.cells, self._place(hashes, k), masks)
        fill = np.array([self._has(self.cells, j).mean() for j in range(len(languages))])
        self.false = fill ** HASHES

    def _place(self, hashes: np.ndarray, k: int) -> np.ndarray:
        return ((hashes * _SALT[k]) >> U64(64 - self.bits)).astype(np.int64)

    @staticmethod
    def _has(masks: np.ndarray, j: int) -> np.ndarray:
        return (masks[:, j // 64] >> U64(j % 64)) & U64(1) > 0

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        """Mask of the languages that contain each n-gram."""
        out = self.cells[self._place(hashes, 0)]
        for k in range(1, HASHES):
            out &= self.cells[self._place(hashes, k)]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        line, bounds = letters(texts)
        m, n = len(texts), np.diff(bounds)
        counts, tries = np.zeros((m, len(self.languages))), np.zeros(m)
        for order in ORDERS:
            hashes = grams(line, order)
            # Places whose n-gram would run into the next text don't count.
            valid = np.zeros(len(hashes), bool)
            row = np.repeat(np.arange(m), n)[:len(hashes)]
            inside = np.arange(len(hashes)) + order <= bounds[row + 1]
            valid[:] = inside
            row = row[valid]
            masks = self.masks(hashes[valid])
            tries += np.bincount(row, minlength=m)
            for j in range(len(self.languages)):
                counts[:, j] += np.bincount(row[self._has(masks, j)], minlength=m)
        names, scores = [], []
        sure = np.maximum(0.0, (counts - self.false * tries[:, None]) / (1 - self.false))
        for r in range(m):
            if not n[r] or not self.languages:
                names.append("und")
                scores.append(0.0)
                continue
            total = sure[r].sum()
            best = int(sure[r].argmax()) if total > 0 else self.common
            names.append(self.languages[best])
            scores.append(float(sure[r, best] / total) if total > 0 else 0.0)
        return names, scores


def learn(docs: DataFrame, sample: int = SAMPLE, id_column: str = "doc_id", text: str = "text",
          lang: str = "lang") -> Model:
    """A model of the non-null ``lang`` values of ``docs``."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"),
                       F.col(lang).cast("string").alias("lang")).where(
        "lang IS NOT NULL AND text IS NOT NULL")
    size = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(size)
    if not languages:
        return Model([], np.zeros(0, U64), np.zeros((0, 1), U64), 0)
    # A row is in the sample if its hash lies below sample / n of its language.
    table = rows.sparkSession.createDataFrame(
        [(name, k, min(1.0, sample / size[name]) * 2.0 ** 63, float(min(sample, size[name])))
         for k, name in enumerate(languages)], "lang string, number int, bound double, drawn double")
    place = F.shiftrightunsigned(F.xxhash64("id", "text", F.monotonically_increasing_id(), F.lit(17)), 1)
    chosen = (rows.withColumn("place", place).join(F.broadcast(table), "lang").where("place < bound")
              .select(F.col("number").alias("lang"), "text"))

    def count(batches):
        for batch in batches:
            lang = batch.column(0).to_numpy()
            texts = batch.column(1).to_pylist()
            for one in np.unique(lang):
                seen = []
                for text in (t for t, x in zip(texts, lang) if x == one):
                    line, _ = letters([text])
                    seen.append(np.unique(np.concatenate([grams(line, o) for o in ORDERS])))
                gram, n = np.unique(np.concatenate(seen), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(gram), one, np.int32)), pa.array(gram.view(np.int64)),
                     pa.array(n)], names=["lang", "gram", "n"])

    counted = (chosen.mapInArrow(count, "lang int, gram long, n long")
               .groupBy("gram", "lang").agg(F.sum("n").alias("n")))
    share = F.col("n") / F.col("drawn")
    counted = counted.join(F.broadcast(table.select(F.col("number").alias("lang"), "drawn")), "lang")
    assigned = (counted.where(F.col("n") >= LEAST).withColumn("share", share)
                .groupBy("gram").agg(F.collect_list(F.struct("lang", "share")).alias("all"))
                .withColumn("most", F.array_max(F.transform("all", lambda x: x["share"])))
                .select("gram", F.transform(F.filter(
                    "all", lambda x: x["share"] >= RATIO * F.col("most")),
                    lambda x: x["lang"]).alias("langs")))
    # Bounded by the sample: the n-grams that at least LEAST of its texts have.
    table = assigned.toArrow()
    hashes = table.column("gram").to_numpy().view(U64)
    order = np.argsort(hashes)
    lists = table.column("langs").combine_chunks()
    masks = np.zeros((len(hashes), -(-len(languages) // 64)), U64)
    at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    row = np.repeat(np.arange(len(hashes)), np.diff(at))
    np.bitwise_or.at(masks, (row, flat // 64), U64(1) << (flat % 64).astype(U64))
    common = max(range(len(languages)), key=lambda k: (size[languages[k]], -k))
    return Model(languages, hashes[order], masks[order], common)


def predict(docs: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row, from its whole text alone."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, 1, CHUNK):
                names, scores = held.value.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"),
                       F.col(text).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, lang_pred string, score double")
