"""Near-duplicate classes by MinHash with tensored banding, confirmed on full shingle sets.

Two small collections of ``tables`` hashes each are made; a hash joins ``rows`` minhashes. A table key
is one pair of a hash of the first and a hash of the second collection, so tables**2 keys cost
2 * tables * rows minhashes. At similarity s a pair shares a key with probability
(1 - (1 - s**rows)**tables)**2: 0.99993 at 0.8 with the defaults.

Defined cases: null or empty text has no shingles and links with nothing; a text of fewer words than a
shingle has one, its whole word sequence; a null id is kept, without class; an id that repeats is
judged row by row, each text with its own links, and equal rows fall in one class. An empty
table gives an empty result. ``classes`` ignores further columns, ``one_of_each`` carries them whatever their
names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lurewatch.llm.common import (
    U64, Spans, fresh, lean, lower_ascii, mix64, new_stage, stored, text_chunks, words_of)

TABLES, ROWS = 10, 2
TILE, ROUNDS = 16, 2
# Bytes of text hashed at once; the arrays of a step take some seventy times as much.
CHUNK = 1 << 18
_rng = np.random.default_rng(20240131)
_COEF = _rng.integers(0, 1 << 63, 64, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_SEED = _rng.integers(0, 1 << 63, 256, dtype=np.int64).astype(U64)
_ODD = _rng.integers(0, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)


def shingle_sets(column: pa.Array, words: int):
    """Per chunk: first row, the distinct shingle hashes of its rows in a line, and their starts."""
    for lo, hi, data, offsets in text_chunks(column, CHUNK):
        starts, ends, row = words_of(data, offsets)
        hashed = Spans(lower_ascii(data)).hash(starts, ends)
        n = hi - lo
        count = np.bincount(row, minlength=n)
        head = np.concatenate([[0], np.cumsum(count)])
        full = np.zeros(len(hashed), U64)
        for j in range(words):
            part = hashed[j:] * _COEF[j]
            full[:len(part)] += part
        full = mix64(full)
        sets, sizes = [], np.zeros(n, np.int64)
        for r in range(n):
            a, b = head[r], head[r + 1]
            if b - a >= words:
                own = np.unique(full[a:b - words + 1])
            elif b > a:
                short = (hashed[a:b] * _COEF[:b - a]).sum(dtype=U64) + U64(b - a)
                own = mix64(np.array([short], U64))
            else:
                continue
            sets.append(own)
            sizes[r] = len(own)
        yield lo, np.concatenate(sets) if sets else np.zeros(0, U64), sizes


def _minima(line: np.ndarray, starts: np.ndarray, number: int) -> np.ndarray:
    out = np.empty((len(starts), number), U64)
    for i in range(number):
        x = (line ^ _SEED[i]) * _ODD[i]
        x = (x ^ (x >> U64(31))) * _ODD[-1 - i]
        out[:, i] = np.minimum.reduceat(x ^ (x >> U64(32)), starts)
    return out


def sketch(docs: DataFrame, words: int, tables: int = TABLES, rows: int = ROWS,
           id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, the set's fingerprint (two longs), and both collections of hashes."""
    def run(batches):
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for lo, line, sizes in shingle_sets(column, words):
                n = len(sizes)
                has = np.flatnonzero(sizes)
                begin = np.concatenate([[0], np.cumsum(sizes[has])[:-1]]).astype(np.int64)
                prints = np.zeros((n, 2), U64)
                bands = np.zeros((n, 2 * tables), U64)
                if len(has):
                    prints[has, 0] = np.add.reduceat(mix64(line), begin)
                    prints[has, 1] = np.add.reduceat(mix64(line ^ _SEED[-1]), begin)
                    low = _minima(line, begin, 2 * tables * rows).reshape(len(has), -1, rows)
                    joined = np.zeros(low.shape[:2], U64)
                    for k in range(rows):
                        joined = mix64(joined + low[:, :, k] * _COEF[k])
                    bands[has] = joined
                view = bands.view(np.int64)
                at = np.arange(n + 1, dtype=np.int32) * tables
                lists = [pa.ListArray.from_arrays(
                    pa.array(at), pa.array(np.ascontiguousarray(part).reshape(-1)))
                    for part in (view[:, :tables], view[:, tables:])]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, n).cast(pa.int64()), pa.array(sizes),
                     pa.array(prints[:, 0].view(np.int64)), pa.array(prints[:, 1].view(np.int64)),
                     *lists], names=["doc_id", "n_shingles", "fp1", "fp2", "left", "right"])

    return docs.select(F.col(id_column).cast("long"), F.col(text).cast("string")).mapInArrow(
        lean(run), "doc_id long, n_shingles long, fp1 long, fp2 long, left array<long>, right array<long>")


def _sets(docs: DataFrame, words: int, id_column: str, text: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            for lo, line, sizes in shingle_sets(batch.column(1), words):
                at = np.concatenate([[0], np.cumsum(sizes)])
                packed = [line[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
                prints = [int(mix64(line[a:b]).sum(dtype=U64).view(np.int64))
                          for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, len(sizes)), pa.array(prints, pa.int64()),
                     pa.array(packed, pa.binary())], names=["rid", "fp1", "shingles"])

    return docs.select(F.col(id_column).cast("long"), F.col(text).cast("string")).mapInArrow(
        lean(run), "rid long, fp1 long, shingles binary")


def _confirm(pairs: pd.DataFrame, sets: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Exact counts of the pairs (rid, hub) of one tile, and the shingles that only one of the two has."""
    new_stage()
    known = {r: np.frombuffer(s, U64) for r, s in zip(sets.rid, sets.shingles)}
    rows = []
    none = np.zeros(0, np.int64)
    for rid, hub, star in zip(pairs.rid, pairs.hub, pairs.star):
        x, h = known[rid], known[hub]
        at = np.minimum(np.searchsorted(h, x), len(h) - 1)
        same = h[at] == x
        both = int(same.sum())
        own = lack = none
        if star:
            own = x[~same].view(np.int64)
            # Two members can only link by the hub's part alone with this share of each in the hub.
            if 100 * both >= percent * len(x):
                lack = np.delete(h, at[same]).view(np.int64)
        rows.append((rid, hub, star, both, len(x), len(h), own, lack))
    return pd.DataFrame(rows, columns=["rid", "hub", "star", "both", "n", "nh", "own", "lack"])


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Compare the full sets of pairs (rid, hub, star): shared shingles and both sizes; for members of a
    star also the shingles that the hub lacks (own) and, if most of rid is in the hub, those of the hub
    that rid lacks (lack).

    Pairs are cut into tiles of two blocks of ids (``place``), so a task holds the sets of two blocks
    at most and a set that many pairs need moves once per tile.
    """
    place = sets.select("rid", "place")
    tiled = (pairs.join(place.withColumnRenamed("place", "pa"), "rid")
             .join(place.withColumnsRenamed({"rid": "hub", "place": "pb"}), "hub")
             .select("rid", "hub", "star", F.xxhash64("pa", "pb").alias("tile")))
    sides = (tiled.select(F.col("tile").alias("cell"), F.explode(F.array("rid", "hub")).alias("rid"))
             .distinct().join(sets.select("rid", "shingles"), "rid"))
    return tiled.groupBy("tile").cogroup(sides.groupBy("cell")).applyInPandas(
        lambda left, right: _confirm(left, right, percent),
        "rid long, hub long, star boolean, both long, n long, nh long, own array<long>, lack array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of the ids in edges (a, b): the smallest id that each one reaches.

    Alternating large and small stars until nothing changes; every round is written to the shared
    folder, and no round has more rows than there are edges. The smallest ids themselves are left out.
    """
    now = stored(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
                 .where("u != v").distinct(), "stars")
    seen = None
    while True:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (both.join(low, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u")
                 .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))
                         .alias("u"), F.col("m").alias("v")).distinct())
        now = stored(small, "stars")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
        seen = state


def candidates(reps: DataFrame, tables: int = TABLES) -> DataFrame:
    """(key, rid) of the table keys that at least two representatives share."""
    one, two = F.posexplode("left").alias("i", "x"), F.posexplode("right").alias("j", "y")
    keyed = (reps.select("rid", "right", one).select("rid", "i", "x", two)
             .select(F.xxhash64("i", "j", "x", "y").alias("key"), "rid"))
    shared = (keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    return keyed.join(shared.select("key", "n"), "key")


def link(docs: DataFrame, reps: DataFrame, words: int, percent: int, id_column: str,
         text: str) -> DataFrame:
    """(a, b) of confirmed links between representatives, enough of them to join every class.

    Buckets are compared with one hub each, not pair by pair. Members of a hub that are still in
    different classes may link with each other; by the prefix filter they then share one of their rarest
    shingles (``_rarest``), and members that do are a bucket of the next round, which no longer holds the
    hub. After ROUNDS rounds the pairs of the small buckets that still hold two classes are compared one
    by one. Nothing is dropped without such a bound.
    """
    rows = stored(candidates(reps), "bands")
    # A bucket's hub is the text that meets the most others.
    popular = stored(rows.groupBy("rid").agg(F.sum("n").alias("pop")), "popular")
    star = stored(_stars(rows.select("key", "rid"), popular), "buckets")
    # Texts with the same best hub lie in neighbouring blocks of TILE.
    home = (star.groupBy("rid").agg(F.max(F.struct("pop", "hub")).alias("h"))
            .select("rid", F.col("h.hub").alias("hub")))
    size = home.groupBy("hub").agg(F.count("*").alias("members"))
    place = home.join(size, "hub").select("rid", F.xxhash64("hub", F.pmod(
        F.xxhash64("rid"), F.ceil(F.col("members") / TILE))).alias("place"))
    need = docs.where(F.col(id_column).isNotNull()).join(
        place.select(F.col("rid").alias(id_column)), id_column, "left_semi")
    sets = stored(_sets(need, words, id_column, text).join(reps.select("rid", "fp1"), ["rid", "fp1"])
                  .groupBy("rid").agg(F.first("shingles").alias("shingles")).join(place, "rid"), "sets")
    enough = (100 + percent) * F.col("both") >= percent * (F.col("n") + F.col("nh"))
    # The largest set that could link with this one through the hub's shingles alone.
    reach = F.floor((100 + percent) * F.col("both") / F.lit(percent)) - F.col("n")
    pairs, edges = _pairs(star, True), None
    for number in range(ROUNDS + 1):
        checked = stored(verify(pairs, sets, percent), "checked")
        new = checked.where(enough).select(F.col("rid").alias("a"), F.col("hub").alias("b"))
        edges = new if edges is None else edges.union(new)
        if number == ROUNDS:
            return edges
        joined = components(edges).withColumnRenamed("id", "rid")
        named = (checked.where("star").join(joined, "rid", "left")
                 .withColumn("component", F.coalesce("component", "rid"))
                 .withColumns({"linked": enough, "reach": reach}))
        split = (named.groupBy("hub").agg(
            F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("n").alias("least"))
            .where("lo != hi").select("hub", "least"))
        left = stored(named.join(split, "hub"), "open")
        again = stored(_rarest(left, percent), "rare")
        if number < ROUNDS - 1:
            more = _stars(again.select("key", "rid"), popular)
        else:
            x, y = again.alias("x"), again.alias("y")
            # What two members have in common beyond their places in the order that both share.
            rest = F.least("x.rest", "y.rest")
            can = (F.when(F.col("x.part") == 0, (100 + percent) * (F.least("x.both", "y.both") + rest)
                          >= percent * (F.col("x.n") + F.col("y.n")))
                   .otherwise(2 * (100 + percent) * rest >= F.col("x.excess") + F.col("y.excess")))
            more = (x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.rid") < F.col("y.rid"))
                           & (F.col("x.component") != F.col("y.component")) & can)
                    .select(F.col("x.rid").alias("rid"), F.col("y.rid").alias("hub")))
        pairs = stored(_pairs(more, number < ROUNDS - 1), "pairs")


def _rarest(left: DataFrame, percent: int) -> DataFrame:
    """(key, rid, component, part, n, both, excess, rest): buckets in which members of a hub may still link.

    ``left`` holds members (hub, rid) with their class, set size n, shingles shared with the hub (both),
    those the hub lacks (own) and those of the hub that they lack (lack).

    Part 0: two members share at most min(|x & hub|, |y & hub|) shingles of the hub, so a link needs some
    outside it, unless the hub's part alone could do for both (reach).
    Part 1, for those: x and y differ in |Dx| + |Dy| - 2 |Dx & Dy| shingles, where Dx are the shingles in
    which x differs from the hub, and a link allows (100 - percent) / (100 + percent) of both sizes. What
    Dx has beyond the share of x is its ``excess`` (times 100 + percent), and half the excess of the pair
    must be common to Dx and Dy. The excess of two members in different classes is above 0, because
    one of them does not link with the hub.

    Of the shingles of a part a member keeps as many as prove that a linked pair has one in common, the
    rarest among the hub's members first: what thousands of them share stays out. ``rest`` is how many
    remain from a shingle's place on. Buckets of one class are left out.
    """
    # A partner has at least the size of the smallest member, and of percent of this one.
    smallest = F.greatest("least", F.ceil(percent * F.col("n") / 100))
    quota = F.ceil(percent * (F.col("n") + smallest) / F.lit(100 + percent))
    excess = (100 + percent) * (F.col("n") + F.col("nh") - 2 * F.col("both")) - (100 - percent) * F.col("n")
    told = left.withColumn("excess", excess)
    outside = told.withColumns({"part": F.lit(0), "needed": F.greatest(F.lit(1), quota - F.col("both")),
                                "asks": F.col("own")})
    far = told.where("reach >= least")
    lowest = far.groupBy("hub").agg(F.min("excess").alias("lowest"))
    # The partner of a member that links with the hub does not.
    other = F.when(F.col("linked"), (100 - percent) * F.col("nh") + 1).otherwise(F.col("lowest"))
    differ = far.join(lowest, "hub").withColumns({
        "part": F.lit(1), "needed": F.greatest(F.lit(1), F.ceil((F.col("excess") + other) / F.lit(2 * (100 + percent)))),
        "asks": F.concat("own", "lack")}).drop("lowest")
    asked = (outside.unionByName(differ)
             .select("hub", "rid", "component", "part", "n", "both", "excess", "needed",
                     F.size("asks").alias("size"), F.explode("asks").alias("shingle"))
             .withColumn("key", F.xxhash64("hub", "part", "shingle")))
    found = asked.groupBy("key").agg(F.count("*").alias("members"), F.min("component").alias("lo"),
                                     F.max("component").alias("hi"))
    place = F.row_number().over(Window.partitionBy("rid", "hub", "part").orderBy("members", "shingle"))
    return (asked.join(found, "key").withColumn("rest", F.col("size") - place + 1)
            .where((F.col("rest") >= F.col("needed")) & (F.col("lo") != F.col("hi")))
            .select("key", "rid", "component", "part", "n", "both", "excess", "rest"))


def _pairs(rows: DataFrame, star: bool) -> DataFrame:
    return rows.where("rid != hub").select("rid", "hub").distinct().withColumn("star", F.lit(star))


def _stars(rows: DataFrame, popular: DataFrame) -> DataFrame:
    """Add to rows (key, rid) the hub of their key and its popularity."""
    hubs = rows.join(popular, "rid").groupBy("key").agg(
        F.max(F.struct("pop", (-F.col("rid")).alias("low"))).alias("h"))
    return rows.join(hubs, "key").select("key", "rid", F.col("h.pop").alias("pop"),
                                         (-F.col("h.low")).alias("hub"))


def classes(docs: DataFrame, words: int = 5, percent: int = 80, id_column: str = "doc_id",
            text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id of its class), kept."""
    made = stored(sketch(docs, words, id_column=id_column, text=text), "sketches")
    some = made.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # The smallest id of each set stands for its copies; the other columns depend on the set alone.
    reps = stored(some.groupBy("fp1", "fp2", "n_shingles").agg(
        F.min("doc_id").alias("rid"), F.count("*").alias("copies"), F.first("left").alias("left"),
        F.first("right").alias("right")), "representatives")
    if not reps.groupBy("rid").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return _classes_by_row(docs, words, percent, id_column, text)
    edges = link(docs, reps.drop("copies"), words, percent, id_column, text)
    joined = components(edges)
    multiple = reps.where("copies > 1").select("fp1", "fp2", "rid")
    ids = made.select("doc_id", "n_shingles", "fp1", "fp2")
    own = (ids.where("n_shingles > 0").join(multiple, ["fp1", "fp2"], "left")
           .withColumn("rid", F.coalesce("rid", "doc_id")))
    named = (own.join(joined.withColumnRenamed("id", "rid"), "rid", "left")
             .withColumn("component_id", F.when(F.col("doc_id").isNotNull(),
                                                F.coalesce("component", "rid"))))
    alone = ids.where("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    every = named.select("doc_id", "n_shingles", "component_id").unionByName(
        alone.select("doc_id", "n_shingles", "component_id"))
    return every.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"),
                                               F.lit(True)))


def _classes_by_row(docs: DataFrame, words: int, percent: int, id_column: str, text: str) -> DataFrame:
    """The same where an id stands for several texts: every row gets a key of its own."""
    rows = stored(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
                  .withColumn("row", F.monotonically_increasing_id()), "rows")
    found = classes(rows.where("doc_id IS NOT NULL"), words, percent, "row").select(
        F.col("doc_id").alias("row"), "n_shingles", F.col("component_id").alias("class"))
    named = stored(found.join(rows.select("row", "doc_id"), "row"), "rows-of-classes")
    least = named.groupBy("class").agg(F.min("doc_id").alias("component_id"))
    told = named.join(least, "class").select("doc_id", "n_shingles", "component_id",
                                             (F.col("doc_id") == F.col("component_id")).alias("kept"))
    unnamed = sketch(rows.where("doc_id IS NULL"), words).select(
        "doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return told.unionByName(unnamed)


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay: the smallest id of each class, equal rows once.

    Every row is judged by its own text, whatever its id. Rows with a null id are compared like others;
    one of those in a class stays, beside the smallest id if there is one.
    """
    names = fresh(docs, "_row", "_key")
    # The key holds for every later read, because the rows are stored with it.
    rows = stored(docs.withColumn(names["_row"], F.monotonically_increasing_id()), "rows")
    row = F.col(names["_row"])
    found = classes(rows, words, percent, id_column=names["_row"]).select(
        F.col("doc_id").alias("key"), F.col("component_id").alias("class"))
    mine = rows.select(row.alias("key"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    kept = (found.join(mine, "key").groupBy("class", F.col("id").isNull().alias("unnamed"))
            .agg(F.min(F.struct(F.col("id").cast("long").alias("number"), "id", "hash", "key")).alias("m"))
            .select(F.col("m.key").alias(names["_key"])))
    stay = rows.join(kept, row == F.col(names["_key"]), "left_semi").select(*docs.columns)
    # Texts without shingles are in no class: equal rows of one id once.
    return stay.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"]).unionByName(
        stay.where("doc_id IS NULL"))
