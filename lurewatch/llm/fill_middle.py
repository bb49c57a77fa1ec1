"""Fill-in-middle transformation over seekable compressed frames.

``store`` keeps a text as independent zstandard frames of about FRAME bytes, cut between code points;
beside each frame stand the counts of units (line ends), code points and bytes before it. ``transform``
finds the frame of a cut from these counts, decompresses that frame alone, and builds the output from
the pieces: frames without a cut are taken over as they are. ``digest`` and ``restore`` stream the
frames of an output in order; no step holds more than a few decompressed frames of a text.

A unit is a line with its line end, or what follows the last line end. The cuts and the form come from
``sha256("<seed>:<id>")``, so reruns and every order of rows agree.

Defined cases: a null text counts as empty; a null id hashes as the empty string; rows that repeat are
judged one by one (equal ids give equal cuts of equal texts); a text without a line end is one unit of
any length; cuts that fall together give an empty middle; an empty text or one that contains a control
string stays plain; an empty table gives an empty result. Further columns are not carried, so their
names cannot clash.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAME, FLUSH = 1 << 16, 8 << 20
MARKS = ("<P>", "<S>", "<M>")
KEPT = pa.list_(pa.struct([("units", pa.int64()), ("chars", pa.int64()), ("bytes", pa.int64()),
                           ("data", pa.binary())]))
MADE = pa.list_(pa.struct([("bytes", pa.int64()), ("data", pa.binary())]))
_KEPT_SQL = "array<struct<units: bigint, chars: bigint, bytes: bigint, data: binary>>"
_MADE_SQL = "array<struct<bytes: bigint, data: binary>>"
_codecs: list = []


def _codec():
    """Compressor and decompressor of this process."""
    if not _codecs:
        _codecs.extend((zstandard.ZstdCompressor(), zstandard.ZstdDecompressor()))
    return _codecs


def _points(data: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def pack(text: bytes, frame: int = FRAME) -> list[tuple[int, int, int, bytes]]:
    """(units, code points, bytes before; compressed frame) of a text's frames."""
    press, out = _codec()[0].compress, []
    at = units = chars = 0
    while at < len(text):
        end = min(at + frame, len(text))
        while at + 1 < end < len(text) and text[end] & 0xC0 == 0x80:
            end -= 1
        part = text[at:end]
        out.append((units, chars, at, press(part)))
        units += part.count(b"\n")
        chars += _points(part)
        at = end
    return out


def stream(frames: list[tuple]) -> Iterator[bytes]:
    """The text of frames, one frame at a time."""
    for entry in frames:
        yield _codec()[1].decompress(entry[-1])


class _Cutter:
    """Pieces of a stored text; only the frames that hold a cut are decompressed."""

    def __init__(self, frames: list[tuple]):
        self.frames, self.units, self.held = frames, [f[0] for f in frames], {}

    def part(self, k: int) -> bytes:
        if k not in self.held:
            self.held[k] = _codec()[1].decompress(self.frames[k][-1])
        return self.held[k]

    def locate(self, unit: int) -> tuple[int, int, int]:
        """Frame, byte in it and code points before the end of the first ``unit`` units."""
        if not unit:
            return 0, 0, 0
        k = bisect_left(self.units, unit) - 1
        part = self.part(k)
        ends = np.flatnonzero(np.frombuffer(part, np.uint8) == 10)
        wanted = unit - self.units[k] - 1
        at = int(ends[wanted]) + 1 if wanted < len(ends) else len(part)
        return k, at, self.frames[k][1] + _points(part[:at])

    def between(self, begin: tuple, end: tuple) -> Iterator[tuple[bool, bytes]]:
        """(whole frame?, frame or decompressed bytes) from one cut to another."""
        (k, at), (last, to) = begin[:2], end[:2]
        if k == last:
            if to > at:
                yield False, self.part(k)[at:to]
            return
        yield (True, self.frames[k][-1]) if not at else (False, self.part(k)[at:])
        for x in range(k + 1, last):
            yield True, self.frames[x][-1]
        if to:
            yield False, self.part(last)[:to]


def arrange(frames: list[tuple], form: str, first: int, second: int, marks=MARKS,
            frame: int = FRAME) -> tuple[list[tuple[int, bytes]], int | None, int | None]:
    """Output frames with the bytes before each, and the code points of prefix and middle."""
    press, out, loose, size = _codec()[0].compress, [], bytearray(), 0

    def close():
        nonlocal size
        for lo in range(0, len(loose), frame):
            part = bytes(loose[lo:lo + frame])
            out.append((size, press(part)))
            size += len(part)
        loose.clear()

    text = _Cutter(frames)
    start, end = (0, 0, 0), (len(frames), 0, 0)
    if form == "plain":
        a = b = end
        line = [(b"", (start, end))]
    else:
        a, b = text.locate(first), text.locate(second)
        p, s, m = (x.encode() for x in marks)
        line = [(p, (start, a)), (s, (b, end)), (m, (a, b))]
        if form == "spm":
            line = [line[1], line[0], line[2]]
    for mark, span in line:
        loose += mark
        for whole, piece in text.between(*span):
            if whole:
                close()
                out.append((size, piece))
                size += zstandard.frame_content_size(piece)
            else:
                loose += piece
    close()
    return (out, None, None) if form == "plain" else (out, a[2], b[2] - a[2])


def _range(frames: list[tuple], begin: int, end: int) -> Iterator[bytes]:
    """Bytes ``begin`` to ``end`` of an output; frames outside are not decompressed."""
    starts = [f[0] for f in frames]
    k = max(0, bisect_right(starts, begin) - 1)
    while begin < end and k < len(frames):
        part = next(stream(frames[k:k + 1]))
        yield part[begin - starts[k]:end - starts[k]]
        begin = starts[k] + len(part)
        k += 1


def restore(frames: list[tuple], form: str, marks=MARKS) -> Iterator[bytes]:
    """The text that an output was made from, read from the output and its form alone."""
    if form == "plain":
        yield from stream(frames)
        return
    sought, places = [x.encode() for x in marks], {}
    tail, at, longest = b"", 0, max(len(x.encode()) for x in marks)
    for part in stream(frames):
        joined = tail + part
        for x in sought:
            if x not in places and (found := joined.find(x)) >= 0:
                places[x] = at - len(tail) + found
        at += len(part)
        tail = joined[max(0, len(joined) - longest + 1):]
    order = sorted(sought, key=places.__getitem__)
    bounds = {x: (places[x] + len(x), places[y] if y else at) for x, y in zip(order, [*order[1:], None])}
    for x in (sought[0], sought[2], sought[1]):
        yield from _range(frames, *bounds[x])


def _rows(batches, size_at: int, make, schema: pa.Schema):
    """Turn rows one by one and give them out in batches of about FLUSH bytes."""
    rows, held = [], 0

    def close():
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    for batch in batches:
        for i in range(batch.num_rows):
            row = make(*(c[i] for c in batch.columns))
            rows.append(row)
            held += 100 + (sum(len(x[-1]) for x in row[size_at]) if size_at >= 0 else 0)
            if held >= FLUSH:
                yield close()
                rows, held = [], 0
    if rows:
        yield close()


def _entries(value) -> list[tuple]:
    """Frames of a list cell, without copying the compressed bytes twice."""
    return [tuple(x.values()) for x in value.as_py() or []]


def store(docs: DataFrame, id_column: str = "doc_id", text: str = "text", marks=MARKS,
          frame: int = FRAME) -> DataFrame:
    """doc_id, marked (contains a control string), n (units), frames."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    marked = F.lit(False)
    for x in marks:
        marked = marked | F.contains(body, F.lit(x))
    unit_ends = F.length(body) - F.length(F.replace(body, F.lit("\n")))
    n = unit_ends + ((body != "") & ~F.endswith(body, F.lit("\n"))).cast("int")
    schema = pa.schema([("doc_id", pa.int64()), ("marked", pa.bool_()), ("n", pa.int64()),
                        ("frames", KEPT)])

    def run(batches):
        yield from _rows(batches, 3, lambda i, m, n, t: (
            i.as_py(), m.as_py(), n.as_py(), pack(t.as_py(), frame)), schema)

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), marked.alias("marked"),
                       n.cast("long").alias("n"), body.cast("binary").alias("body")).mapInArrow(
        run, f"doc_id bigint, marked boolean, n bigint, frames {_KEPT_SQL}")


def transform(stored: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, marks=MARKS,
              frame: int = FRAME) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output (frames) of stored texts.

    ``rate`` of 100 documents are transformed, ``spm`` of 100 of them suffix first.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    cuts = [x % (F.col("n") + 1) for x in h[:2]]
    plain = (F.col("n") == 0) | F.col("marked") | (h[2] % 100 >= rate)
    form = F.when(plain, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()),
                        ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", MADE)])

    def make(i, n, form, first, second, frames):
        out, prefix, middle = arrange(_entries(frames), form.as_py(), first.as_py(), second.as_py(),
                                      marks, frame)
        return i.as_py(), n.as_py(), form.as_py(), prefix, middle, out

    def run(batches):
        yield from _rows(batches, 5, make, schema)

    return stored.select("doc_id", "n", form.alias("form"), F.least(*cuts).alias("first"),
                         F.greatest(*cuts).alias("second"), "frames").mapInArrow(
        run, f"doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, "
             f"output {_MADE_SQL}")


def digest(made: DataFrame, marks=MARKS) -> DataFrame:
    """Replace ``output`` by output_sha256 and restored_sha256."""
    names = [c for c in made.columns if c != "output"]
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()),
                        ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
                        ("output_sha256", pa.string()), ("restored_sha256", pa.string())])

    def make(i, n, form, prefix, middle, output):
        frames = _entries(output)
        whole, again = hashlib.sha256(), hashlib.sha256()
        for part in stream(frames):
            whole.update(part)
        for part in restore(frames, form.as_py(), marks):
            again.update(part)
        return (i.as_py(), n.as_py(), form.as_py(), prefix.as_py(), middle.as_py(),
                whole.hexdigest(), again.hexdigest())

    def run(batches):
        yield from _rows(batches, -1, make, schema)

    return made.select(*names, "output").mapInArrow(
        run, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, "
             "output_sha256 string, restored_sha256 string")
