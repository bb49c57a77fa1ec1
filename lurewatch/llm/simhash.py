"""Document fingerprints: SimHash over words and pairs of words, in DataFrame functions only.

A term's 64-bit hash votes on every bit with the term's weight: WORD for each word, PAIR for each pair of
neighbouring words, as often as it occurs; a bit is set when its yes votes outweigh the others. Words are
split at white space, and behind each character of scripts that write without spaces. Votes are summed
by one hash aggregation in which a long holds two counters, so every text is one row before the shuffle.

``within`` finds all fingerprints within a Hamming radius by permuted block tables. Of ``blocks`` blocks
of bits at least ``blocks - radius`` agree; there is one table for each such choice of leading blocks,
keyed by them. A pair is taken from the first table that holds it, then its distance is counted.

``in_order`` gives every document its neighbour by descending id without a sort of the whole table: rows
are cut into buckets by bounds that are rows themselves, each bound's row is sent to the bucket before it
as well, and the first of all to the last bucket, so a window per bucket sees every neighbour. A sample
of the ids only places the bounds. Rows of a key (id and text) with more than one HOTth of the table are
reduced to one before the shuffle.

Defined cases: a null text counts as empty; a text without words has the fingerprint 0; equal texts have
equal fingerprints; a null id counts as the smallest id; documents of one id are ordered by a hash of
their text, so a repeated row is followed by its repetition and the last of them by the next document; a
single document is followed by itself; an empty table gives an empty result. Very long texts are one row,
as they are in the table. Further columns are not carried, so their names cannot clash.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lurewatch.llm.common import stored

WORD, PAIR, BITS = 1, 2, 64
#: White space, and the place behind a Han, Kana, Hangul, Thai, Lao or Khmer character.
BREAK = (r"[\x20\x09-\x0D]+|(?<=[฀-໿ក-៿⺀-鿿가-힯豈-﫿])")
RADIUS, BLOCKS = 3, 6
BUCKET_CHARS, MOST_BUCKETS, HOT, HOT_ROWS = 8_000_000, 1 << 17, 256, 1000
LEAST = -(1 << 63)


def votes(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` and the fingerprint (long) of the texts; rows of equal keys vote together."""
    words = F.array_remove(F.split(F.lower(F.col(text)), BREAK), "")
    hashed = rows.select(*keys, F.transform(words, lambda w: F.xxhash64(w)).alias("_w"))
    rest = F.greatest(F.size("_w") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("_w", 1, rest), F.slice("_w", 2, rest), lambda a, b: F.xxhash64(a, b))
    terms = hashed.select(*keys, F.size("_w").alias("_n"), F.posexplode_outer(F.concat("_w", pairs)).alias(
        "_at", "_h"))
    weight = F.when(F.col("_at") < F.col("_n"), F.lit(WORD)).otherwise(F.lit(PAIR)).cast("long")
    weighed = terms.select(*keys, F.when(F.col("_h").isNull(), F.lit(0)).otherwise(weight).alias("_weight"),
                           F.coalesce("_h", F.lit(0).cast("long")).alias("_h"))
    both = F.lit((1 << 32) + 1)
    sums = [F.sum(F.shiftrightunsigned("_h", j).bitwiseAND(both) * F.col("_weight")).alias(f"_v{j}")
            for j in range(32)]
    counted = weighed.groupBy(*keys).agg(F.sum("_weight").alias("_all"), *sums)
    bits = F.lit(0).cast("long")
    for j in range(BITS):
        lane = F.col(f"_v{j % 32}")
        yes = F.shiftrightunsigned(lane, 32) if j >= 32 else lane.bitwiseAND(F.lit((1 << 32) - 1))
        one = (1 << j) - (1 << BITS if j == BITS - 1 else 0)
        bits = bits.bitwiseOR(F.when(yes * 2 > F.col("_all"), F.lit(one)).otherwise(F.lit(0)).cast("long"))
    return counted.select(*keys, bits.alias("fingerprint"))


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fingerprint (long) of every different text of an id."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return votes(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(body).alias("hash"),
                             body.alias("body")), ["doc_id", "hash"], "body").drop("hash")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def as_text(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), BITS // 4, "0")


def _masks(radius: int, blocks: int) -> list[int]:
    """Signed masks of the leading blocks, one for each table."""
    cut = [BITS * k // blocks for k in range(blocks + 1)]
    out = []
    for chosen in combinations(range(blocks), blocks - radius):
        mask = sum((1 << cut[k + 1]) - (1 << cut[k]) for k in chosen)
        out.append(mask - (1 << BITS) if mask >> (BITS - 1) else mask)
    return out


def within(table: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """query, fingerprint, distance: all different fingerprints of ``table`` within ``radius`` of a query.

    Both sides have the column ``fingerprint`` and are reduced to different values first. A query has at
    most as many results as there are ways to change ``radius`` bits.
    """
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("radius must be smaller than blocks")
    masks = _masks(radius, blocks)

    def keyed(df: DataFrame, name: str) -> DataFrame:
        value = F.col(name)
        keys = F.array(*[value.bitwiseAND(F.lit(m)) for m in masks])
        return df.select(F.col("fingerprint").alias(name)).where(value.isNotNull()).distinct().select(
            name, F.posexplode(keys).alias("table", "key"))

    met = keyed(table, "fingerprint").join(keyed(queries, "query"), ["table", "key"])
    apart = F.col("fingerprint").bitwiseXOR(F.col("query"))
    first = F.coalesce(*[F.when(apart.bitwiseAND(F.lit(m)) == 0, F.lit(t)) for t, m in enumerate(masks)])
    return met.where((F.bit_count(apart) <= radius) & (first == F.col("table"))).select(
        "query", "fingerprint", F.bit_count(apart).alias("distance"))


def _bounds(keys: DataFrame, rows: int, chars: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and hashes of the buckets' first rows, descending; the first is the first of all."""
    buckets = min(MOST_BUCKETS, math.ceil(chars / BUCKET_CHARS))
    one_of = max(1, rows // (8 * max(1, buckets)))
    drawn = keys.where(F.pmod(F.xxhash64("k", "h", F.lit(5)), F.lit(one_of)) == 0).select("k", "h").collect()
    top = keys.agg(F.max(F.struct("k", "h")).alias("top")).first().top
    points = sorted({(r.k, r.h) for r in drawn}, reverse=True)
    first = [points[len(points) * b // buckets] for b in range(1, buckets)] if points else []
    chosen = sorted({(top.k, top.h), *first}, reverse=True)
    return (np.array([k for k, _ in chosen], np.int64), np.array([h for _, h in chosen], np.int64))


def _bucket(ids: np.ndarray, hashes: np.ndarray, k: Column, h: Column) -> tuple[Column, Column]:
    """Number of a row's bucket, and whether the row is the bucket's bound."""
    id_at, hash_at = F.lit(ids), F.lit(hashes)

    def at(place):
        return F.get(id_at, place), F.get(hash_at, place)

    def step(held, size):
        i, x = at(held + size - 1)
        return held + F.when((i > k) | ((i == k) & (x >= h)), size).otherwise(F.lit(0))

    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(ids).bit_length()))])
    number = F.aggregate(steps, F.lit(0), step) - 1
    i, x = at(number)
    return number, (i == k) & (x == h)


def in_order(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame | None:
    """Rows with their neighbour by descending id, or None for an empty table.

    bucket, rn (place in the bucket), extra (another bucket's first row, without neighbour), doc_id,
    body, next_body, copies (rows this one stands for, whose neighbour but for the last is itself).
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), body.alias("body")).select(
        "doc_id", "body", F.coalesce("doc_id", F.lit(LEAST)).alias("k"), F.xxhash64("body").alias("h"))
    keys = stored(rows.groupBy("doc_id", "k", "h").agg(
        F.count("*").alias("n"), F.sum(F.length("body")).alias("chars")), "keys")
    total = keys.agg(F.sum("n").alias("n"), F.sum("chars").alias("chars")).first()
    if not total.n:
        return None
    ids, hashes = _bounds(keys, total.n, total.chars)
    hot = keys.where(F.col("n") > max(HOT_ROWS, total.n // HOT)).select(
        F.col("doc_id").alias("hot_id"), F.col("h").alias("hot_hash"), "n")
    same = F.col("doc_id").eqNullSafe(F.col("hot_id")) & (F.col("h") == F.col("hot_hash"))
    one = rows.withColumn("copies", F.lit(1).cast("long"))
    if not hot.isEmpty():
        # At most HOT keys are hot; their rows are reduced in the map tasks.
        few = rows.join(F.broadcast(hot), same).groupBy("doc_id", "k", "h", "n").agg(F.first("body").alias("body"))
        one = one.join(F.broadcast(hot), same, "left_anti").unionByName(few.withColumnRenamed("n", "copies"))
    number, is_bound = _bucket(ids, hashes, F.col("k"), F.col("h"))
    placed = one.withColumn("own", number).withColumn("is_bound", is_bound)
    before = F.when(F.col("own") == 0, F.lit(len(ids) - 1)).otherwise(F.col("own") - 1)
    here = F.struct(F.col("own").alias("bucket"), F.lit(False).alias("extra"))
    there = F.struct(before.alias("bucket"), F.lit(True).alias("extra"))
    spread = placed.select("doc_id", "k", "h", "copies", "body", F.explode(
        F.when(F.col("is_bound"), F.array(here, there)).otherwise(F.array(here))).alias("p"))
    spread = spread.select("p.bucket", "p.extra", "doc_id", "k", "h", "copies", "body").repartition(
        len(ids), "bucket")
    along = Window.partitionBy("bucket").orderBy("extra", F.desc("k"), F.desc("h"), F.desc_nulls_last("doc_id"))
    return spread.select("bucket", "extra", "doc_id", "copies", "body", F.row_number().over(along).alias("rn"),
                         F.lead("body").over(along).alias("next_body"))


def edited(body: Column, following: Column) -> Column:
    """The last third of a text replaced by the beginning of the following one."""
    third = F.floor(F.length(body) / 3).cast("int")
    return F.concat(F.left(body, F.length(body) - third), F.left(following, third))


def compare(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint and next_fingerprint (longs)."""
    out = ("doc_id long, n_chars long, edited_sha256 string, fingerprint long, edited_fingerprint long, "
           "next_fingerprint long")
    rows = in_order(docs, id_column, text)
    if rows is None:
        return docs.sparkSession.createDataFrame([], out)
    # (neighbour, whether it is the row itself, number of such rows)
    real = F.struct(F.col("next_body").alias("next"), F.lit(0).alias("self"), F.lit(1).cast("long").alias("times"))
    repeat = F.struct(F.col("body").alias("next"), F.lit(1).alias("self"), (F.col("copies") - 1).alias("times"))
    cases = rows.withColumn("c", F.explode(F.when((F.col("copies") > 1) & ~F.col("extra"), F.array(repeat, real))
                                           .otherwise(F.array(real))))
    made = cases.select("bucket", "rn", "extra", "doc_id", "body", "c.self", "c.times", F.when(
        ~F.col("extra"), edited(F.col("body"), F.col("c.next"))).alias("edited"))
    told = made.select("bucket", "rn", "extra", "doc_id", "self", "times", F.length("body").alias("n_chars"),
                       F.unhex(F.sha2("edited", 256)).alias("sha"),
                       F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("body").alias("t")),
                                         F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))).alias("v"))
    told = told.select("*", "v.kind", "v.t").where("t IS NOT NULL")
    keys = ["bucket", "rn", "extra", "doc_id", "self", "times", "n_chars", "sha", "kind"]
    voted = votes(told, keys, "t")
    # A row is followed by its edited text, then by the next row.
    along = Window.partitionBy("bucket").orderBy("rn", F.desc("self"), "kind")
    seen = voted.select("*", F.lead("fingerprint", 1).over(along).alias("edited_fingerprint"),
                        F.lead("fingerprint", 2).over(along).alias("next_fingerprint"))
    return seen.where("kind = 0 AND NOT extra").select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.lower(F.hex("sha")).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "next_fingerprint", F.explode(F.sequence(
            F.lit(1).cast("long"), F.col("times"))).alias("copy")).drop("copy")


def near_counts(rows: DataFrame, asked: Column, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Add near_found to ``rows``: how many other rows lie within ``radius``, for rows that are ``asked``."""
    table = rows.groupBy("fingerprint").agg(F.count("*").alias("n"))
    queries = rows.where(asked).select("fingerprint")
    found = within(table.select("fingerprint"), queries, radius, blocks).join(table, "fingerprint").groupBy(
        F.col("query").alias("fingerprint")).agg((F.sum("n") - 1).alias("near_found"))
    told = rows.where(asked).join(found, "fingerprint")
    none = rows.where(~F.coalesce(asked, F.lit(False))).withColumn("near_found", F.lit(None).cast("long"))
    columns = [*rows.columns, "near_found"]
    return told.select(*columns).unionByName(none.select(*columns))
