"""Token ids in files of patched frame-of-reference blocks.

A file row is a segment: one binary cell with some documents' ids in ascending order of the document
id. Blocks hold BLOCK ids; each is stored as its minimum, a bit width that covers PERCENT of its
distances to the minimum, the packed low bits, and a list of exceptions (place, high part). An index
gives the start of every block and the end of every document, so any document is read alone.

The container is Parquet because Spark's writers commit it and executors share nothing else; the
segments inside have their own format. ``write`` ranges the table by id (equal ids by their text), so
segments follow each other by (part, number).

Defined cases: a null text is empty and has the end id alone; a null id comes first; rows that repeat
an id follow each other in the order of their texts; an empty table gives files without segments. Further
columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lurewatch.llm.common import U64, Spans, for_one_stage, lean
from lurewatch.session import shared_path

BLOCK, PERCENT, SEGMENT = 128, 90, 1 << 20
MAGIC = 0x31524650
_HEAD = np.dtype("<u4")
# Words a task remembers, pieces of one call of the tokenizer, bytes of text of one step.
KNOWN_WORDS, LINE, PIECE = 2_000_000, 20_000, 1 << 23
# Stops behind a word are a piece of their own for any tokenizer that cuts at letters.
STOPS = ".,;:!?"


def pack(ids: np.ndarray, doc_ids: np.ndarray, null_id: np.ndarray, ends: np.ndarray) -> bytes:
    """One segment. ``ends``: where each document's ids end."""
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    grid = np.empty(blocks * BLOCK, np.uint32)
    grid[:n] = ids
    if n:
        grid[n:] = ids[-1]
    grid = grid.reshape(blocks, BLOCK)
    low = grid.min(axis=1) if blocks else np.zeros(0, np.uint32)
    gap = grid - low[:, None]
    limit = np.partition(gap, BLOCK * PERCENT // 100 - 1, axis=1)[:, BLOCK * PERCENT // 100 - 1]
    width = np.zeros(blocks, np.uint8)
    for bit in range(32):
        width[limit >> np.uint32(bit) > 0] = bit + 1
    high = gap >> np.minimum(width, 31)[:, None].astype(np.uint32)
    high[width == 32] = 0
    odd = high > 0
    at_block, at_place = np.nonzero(odd)
    exceptions = np.bincount(at_block, minlength=blocks).astype("<u4")
    sizes = width.astype(np.int64) * (BLOCK // 8)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    data = np.zeros(int(starts[-1]), np.uint8)
    for w in np.unique(width[width > 0]):
        those = np.flatnonzero(width == w)
        bits = np.unpackbits(gap[those].astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
        packed = np.packbits(bits[:, :w].reshape(len(those), -1), axis=1, bitorder="little")
        data[(starts[those][:, None] + np.arange(packed.shape[1])).reshape(-1)] = packed.reshape(-1)
    return b"".join([
        np.array([MAGIC, len(doc_ids), n, blocks, len(at_block), len(data)], _HEAD).tobytes(),
        doc_ids.astype("<i8").tobytes(), null_id.astype(np.uint8).tobytes(),
        ends.astype("<u4").tobytes(), low.astype("<u4").tobytes(), width.tobytes(),
        starts[:-1].astype("<u4").tobytes(), exceptions.tobytes(),
        at_place.astype(np.uint8).tobytes(), high[odd].astype("<u4").tobytes(), data.tobytes()])


class Segment:
    """Reads a segment: all ids, or those of one document by the block index."""

    def __init__(self, cell: bytes):
        self._cell, self._at = memoryview(cell), 24
        magic, docs, self.n, blocks, odd, size = np.frombuffer(cell, _HEAD, 6).tolist()
        if magic != MAGIC:
            raise ValueError("not a token segment")
        self.doc_ids, self.null_id = self._next("<i8", docs), self._next(np.uint8, docs) > 0
        self.ends = self._next("<u4", docs).astype(np.int64)
        self.low, self.width = self._next("<u4", blocks), self._next(np.uint8, blocks)
        self.starts = self._next("<u4", blocks).astype(np.int64)
        count = self._next("<u4", blocks)
        self.first_odd = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
        self.place, self.high = self._next(np.uint8, odd), self._next("<u4", odd)
        self.data = self._next(np.uint8, size)

    def _next(self, kind, n: int) -> np.ndarray:
        kind = np.dtype(kind)
        out = np.frombuffer(self._cell, kind, n, self._at)
        self._at += n * kind.itemsize
        return out

    def ids(self, begin: int = 0, end: int | None = None) -> np.ndarray:
        """The ids at positions begin to end; only the blocks that hold them are unpacked."""
        end = self.n if end is None else end
        lo, hi = begin // BLOCK, -(-end // BLOCK)
        gap = np.zeros((max(hi - lo, 0), BLOCK), np.uint32)
        width = self.width[lo:hi]
        for w in np.unique(width[width > 0]):
            those = np.flatnonzero(width == w)
            cells = self.starts[lo:hi][those][:, None] + np.arange(int(w) * (BLOCK // 8))
            bits = np.zeros((len(those) * BLOCK, 32), np.uint8)
            bits[:, :w] = np.unpackbits(self.data[cells], axis=1, bitorder="little").reshape(-1, w)
            gap[those] = np.packbits(bits, axis=1, bitorder="little").view("<u4").reshape(-1, BLOCK)
        a, b = int(self.first_odd[lo]), int(self.first_odd[hi]) if hi > lo else 0
        if b > a:
            block = np.repeat(np.arange(hi - lo), np.diff(self.first_odd[lo:hi + 1]))
            gap[block, self.place[a:b]] |= self.high[a:b] << width[block].astype(np.uint32)
        line = (gap + self.low[lo:hi, None]).reshape(-1)
        return line[begin - lo * BLOCK:end - lo * BLOCK]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def _is_word(piece: str) -> bool:
    """Letters that a tokenizer may see in lower case without a change of their composition."""
    return piece.isalpha() and piece.lower().isalpha() and is_normalized("NFC", piece)


class Words:
    """Ids of single words, kept from text to text under two 64-bit hashes of each word.

    A word is a piece of letters and a tail of stops, or one other piece. Where the tokenizer marks
    ends of words, many new letter pieces are encoded in one line: each ends at the next id whose token
    carries the mark.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.is_end = None
        if suffix:
            vocabulary = self.tokenizer.get_vocab()
            self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
            self.is_end[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.clear()

    def clear(self) -> None:
        # Ascending by ``key``; ``check`` is the other hash.
        self.key, self.check = np.zeros(0, U64), np.zeros(0, U64)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _one_by_one(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        return (np.array([i for x in lists for i in x], np.uint32),
                np.array([len(x) for x in lists], np.int64))

    def _in_lines(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        (line,) = self.tokenizer.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)
        ids = np.array(line.ids, np.uint32)
        ends = np.flatnonzero(self.is_end[ids]) + 1
        if len(ends) != len(pieces) or ends[-1] != len(ids):
            return self._one_by_one(pieces)
        return ids, np.diff(np.concatenate([[0], ends]))

    def _pieces_of(self, words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Head and tail of each word."""
        heads = pc.utf8_rtrim(words, characters=STOPS)
        plain = pc.and_(pc.string_is_ascii(heads), pc.utf8_is_alpha(heads))
        tails = pc.replace_substring_regex(words, f"(?s)^.*?([{STOPS}]*)$", r"\1")
        heads = pc.if_else(plain, pc.ascii_lower(heads), heads)
        rest = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        whole = np.zeros(len(words), bool)
        whole[rest] = [not _is_word(x) for x in heads.take(rest).to_numpy(zero_copy_only=False)]
        whole = pa.array(whole)
        return pc.if_else(whole, words, heads), pc.if_else(whole, "", tails)

    def _encode_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids in a line, start and number of each piece's ids."""
        text = pieces.to_numpy(zero_copy_only=False)
        lined = np.zeros(len(text), bool)
        if self.is_end is not None:
            lined = pc.and_(pc.string_is_ascii(pieces), pc.utf8_is_alpha(pieces)).to_numpy(zero_copy_only=False).copy()
            rest = np.flatnonzero(~lined)
            lined[rest] = [_is_word(x) for x in text[rest]]
        ids, sizes, order = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], []
        for those, encode in ((np.flatnonzero(lined), self._in_lines), (np.flatnonzero(~lined), self._one_by_one)):
            for lo in range(0, len(those), LINE):
                found, size = encode(text[those[lo:lo + LINE]].tolist())
                ids.append(found)
                sizes.append(size)
            order.append(those)
        size = np.zeros(len(text), np.int64)
        start = np.zeros(len(text), np.int64)
        order, run = np.concatenate(order), np.concatenate(sizes)
        size[order], start[order] = run, np.cumsum(run) - run
        return np.concatenate(ids), start, size

    def _learn(self, words: pa.Array, key: np.ndarray, check: np.ndarray) -> None:
        heads, tails = self._pieces_of(words)
        coded = pa.concat_arrays([heads, tails]).dictionary_encode()
        ids, start, size = self._encode_pieces(coded.dictionary)
        run = coded.indices.to_numpy().reshape(2, -1).T.reshape(-1)
        sizes = size[run]
        first = np.cumsum(sizes) - sizes
        line = ids[np.arange(sizes.sum()) + np.repeat(start[run] - first, sizes)]
        size = sizes[0::2] + sizes[1::2]
        begin = len(self.ids) + np.cumsum(size) - size
        order = np.argsort(key)
        at = np.searchsorted(self.key, key[order])
        for name, more in (("key", key), ("check", check), ("start", begin), ("size", size)):
            setattr(self, name, np.insert(getattr(self, name), at, more[order]))
        self.ids = np.concatenate([self.ids, line])

    def _find(self, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of words, and which of them are known."""
        at = np.minimum(np.searchsorted(self.key, key), max(len(self.key) - 1, 0))
        if not len(self.key):
            return at, np.zeros(len(key), bool)
        return at, (self.key[at] == key) & (self.check[at] == check)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in a line, and each text's number of ids."""
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary
        _, places, data = words.buffers()
        at = np.frombuffer(places, np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8)[:at[-1]] if data is not None else np.zeros(0, np.uint8)
        key, check = (Spans(x).hash(at[:-1], at[1:]) for x in (raw, raw.astype(np.int16) + 256))
        if len(self.key) > KNOWN_WORDS:
            self.clear()
        place, known = self._find(key, check)
        if not known.all():
            new = np.flatnonzero(~known)
            self._learn(words.take(new), key[new], check[new])
            place, known = self._find(key, check)
        if not known.all():
            # Two words under one key: these texts are encoded as they are.
            return _whole(self.tokenizer, texts)
        which = place[coded.indices.to_numpy()]
        sizes = self.size[which]
        total = np.concatenate([[0], np.cumsum(sizes)])
        out = self.ids[np.arange(total[-1]) + np.repeat(self.start[which] - total[:-1], sizes)]
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        return out, np.diff(np.concatenate([[0], total[ends]]))


def _whole(tokenizer, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    lists = [e.ids for e in tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
    return (np.array([i for x in lists for i in x], np.uint32),
            np.array([len(x) for x in lists], np.int64))


@lru_cache(maxsize=2)
def _words(path: str) -> Words:
    return Words(path)


for_one_stage(_words.cache_clear)


def encode(path: str, texts: list[str | None] | pa.Array, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Ids of whole texts in a line, and each text's number of ids.

    The vocabularies meant here drop white space and never join characters across a space or a line
    end, so each distinct word is encoded once and a text is the line of its words' ids. ``whole``
    encodes texts as they are, for tokenizers that look across spaces.
    """
    words = _words(path)
    texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
    return _whole(words.tokenizer, texts) if whole else words.encode(texts)


def _pieces(column: pa.Array):
    """(first, end) of runs of rows with about PIECE bytes of text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(size):
        hi = int(np.searchsorted(size, (size[lo - 1] if lo else 0) + PIECE, "right"))
        hi = max(hi, lo + 1)
        yield lo, hi
        lo = hi


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_column: str = "doc_id",
          text: str = "text", whole: bool = False, segment: int = SEGMENT) -> None:
    """Write the ids of all documents, ``end_id`` behind each, in ascending order of the ids."""
    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        ids, docs_in, nulls, sizes, held = [], [], [], [], 0
        end = np.array([end_id], np.uint32)

        def flush():
            line = np.concatenate(ids)
            cell = pack(line, np.array(docs_in, np.int64), np.array(nulls, bool),
                        np.cumsum(np.array(sizes, np.int64)))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()),
                 pa.array([len(line)], pa.int64()), pa.array([cell], pa.large_binary())
                 .cast(pa.binary())], names=["part", "number", "n_ids", "cell"])

        for batch in batches:
            for lo, hi in _pieces(batch.column(1)):
                piece = batch.slice(lo, hi - lo)
                keys = piece.column(0)
                flags = pc.is_null(keys).to_pylist()
                line, size = encode(tokenizer, piece.column(1), whole)
                at = 0
                for key, null, n in zip(pc.fill_null(keys, 0).to_pylist(), flags, size.tolist()):
                    ids += [line[at:at + n], end]
                    at += n
                    docs_in.append(key)
                    nulls.append(null)
                    sizes.append(n + 1)
                    held += n + 1
                    if held >= segment:
                        yield flush()
                        number, ids, docs_in, nulls, sizes, held = number + 1, [], [], [], [], 0
        if docs_in:
            yield flush()

    ranged = (docs.select(F.col(id_column).cast("long").alias("doc_id"),
                          F.col(text).cast("string").alias("text"))
              .repartitionByRange(F.col("doc_id"), F.xxhash64("text"))
              .sortWithinPartitions(F.col("doc_id"), F.xxhash64("text"), F.col("text")))
    ranged.mapInArrow(lean(run), "part int, number int, n_ids long, cell binary").write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32."""
    files = spark.read.parquet(path)

    def run(batches):
        for batch in batches:
            for part, number, cell in zip(*(batch.column(k).to_pylist() for k in range(3))):
                seg = Segment(cell)
                ids = seg.ids().astype("<u4")
                begins = np.concatenate([[0], seg.ends[:-1]]).astype(np.int64)
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins, seg.ends)]
                n = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, number, np.int32)),
                     pa.array(seg.doc_ids, mask=seg.null_id), pa.array(begins),
                     pa.array(seg.ends - begins), pa.array(crc, pa.int64())],
                    names=["part", "number", "doc_id", "begin", "n_tokens", "ids_crc32"])

    rows = files.select("part", "number", "cell").mapInArrow(
        lean(run), "part int, number int, doc_id long, begin long, n_tokens long, ids_crc32 long")
    # One row per segment of a million ids: first inside each part, then over the parts.
    sizes = files.select("part", "number", "n_ids")
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("base"))
    offsets = (sizes.select("part", "number", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))
                            .alias("base0"))
               .join(parts, "part")
               .select("part", "number", (F.col("base0") + F.col("base")).alias("offset")))
    return (rows.join(offsets, ["part", "number"])
            .select("doc_id", (F.col("offset") + F.col("begin")).alias("start"), "n_tokens",
                    "ids_crc32"))


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2, **options) -> DataFrame:
    """Write to a fresh path of the shared folder, then read the files back."""
    path = shared_path(docs.sparkSession, "tokens")
    write(docs, path, tokenizer, end_id, **options)
    return read(docs.sparkSession, path)
