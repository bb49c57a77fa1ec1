"""Mix sources to target weights: a multivariate-hypergeometric splitting tree over source blocks.

Sources in code point order (null last) weigh ``weights`` in turn and share all words; no source gets
more than ``most`` times its own words, and what it can't take is shared again by weight. A source is
cut into blocks of about ``block_words`` words by a hash of the id. Its target is so many whole passes
over its blocks and one part of a pass: blocks in permuted order while they fit, then every document
of the next block, in hashed order, that still fits. A block of one pass is a unit. What is still missing
is filled from the blocks after that one, larger documents first, until no document there fits.

The tree splits the exact unit counts of all sources over the output shards: a node with so many units
gives its left half a random sample of the right size, drawn source by source (an urn per source, unit
by unit, with hashed numbers), and the rest to the right half. A shard then draws its units as the next
ones of each source's permuted order, so no unit is drawn twice; inside a shard the order is that of
``key``. Everything is made of hashes, so reruns agree.

The tree begins with as many nodes as keep each near NODE units. Their samples come from one order of all
units by a hash, cut at the nodes' exact sizes, which has the same law as drawing them one after the
other; ranks in it come from ranges, so no task holds a source's units or all sources.

DataFrame operations only. The driver sees two numbers of the table (all words, and the words per
weight unit). One row per source, unit or node is all that the plan holds.

Defined cases: a null text has size 0; a document without words is never taken more often than others
of its block and counts 0; sources without words have target 0; rows that repeat an id are mixed one by
one; an empty table gives an empty result; carried columns may have any name but those that are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lurewatch.llm.common import stored
from lurewatch.operators.prefix import running_sum

WEIGHTS, MOST = (5, 2, 1), 3
SHARD_WORDS, BLOCKS_PER_SHARD = 1 << 22, 64
WORD = r"[^\x20\x09-\x0D]+"
# Larger than any number of blocks, so multiplying by one of them permutes the block numbers.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BUCKET, CHUNK, REGROUP = 256, 256, 4
NODE, STEP = 1 << 14, 1 << 12


def word_count(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def _running(df: DataFrame, order: list[Column], values: dict[str, Column]) -> DataFrame:
    """Add running sums before each row in a total order, without a task that sees all rows."""
    ranged = stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    across = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_part").agg(*[F.sum(v).alias(f"_{n}") for n, v in values.items()])
    before = sums.select("_part", *[F.coalesce(F.sum(f"_{n}").over(across), F.lit(0)).alias(f"_{n}")
                                    for n in values])
    local = ranged.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(n)
                                 for n, v in values.items()])
    return local.join(before, "_part").select(
        *df.columns, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in values])


def _numbers(rows: DataFrame, count: str, name: str) -> DataFrame:
    """Rows (with sid) once for each number below ``count``, in steps that are dealt to all tasks."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = rows.where(F.col(count) > 0).withColumn("_step", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((F.col(count) - 1) / STEP)))).repartition(tasks, "sid", "_step")
    return steps.withColumn(name, F.explode(F.sequence(
        F.col("_step") * STEP, F.least((F.col("_step") + 1) * STEP, F.col(count)) - 1))).drop("_step")


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, words, docs) with sid (from 0), weight and target: words shared by weight, capped."""
    numbered = _running(sizes, [F.col("source").asc_nulls_last()], {"sid": F.lit(1).cast("long")})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.col("sid") % len(weights) + 1).cast("int"))
    rows = numbered.withColumn("weight", weight).withColumn("most", most * F.col("words").cast("double"))
    total, all_weight = rows.agg(F.sum("words"), F.sum("weight")).first()
    total, all_weight = float(total or 0), float(all_weight or 1)
    # A source is capped if an even share of what is left, after all that cap earlier, exceeds its cap.
    led = _running(rows, [(F.col("most") / F.col("weight")).asc(), F.col("sid").asc()],
                   {"_most": F.col("most"), "_weight": F.col("weight")})
    capped = stored(led.withColumn(
        "capped", F.col("most") * (all_weight - F.col("_weight"))
        <= F.col("weight") * (total - F.col("_most"))).drop("_most", "_weight"), "capped")
    full, free = capped.agg(F.sum(F.when(F.col("capped"), F.col("most"))),
                            F.sum(F.when(~F.col("capped"), F.col("weight")))).first()
    level = (total - (full or 0.0)) / free if free else 0.0
    share = F.least(F.lit(level) * F.col("weight"), F.col("most"))
    return capped.withColumn("target", F.when(F.col("capped"), F.col("most")).otherwise(share)).select(
        "source", "sid", "words", "docs", "weight", "target")


def _permuted(place: Column, turn: Column, sid: Column, blocks: Column) -> Column:
    """Block at a place of the source's permuted order in its ``turn``-th pass."""
    by = F.element_at(F.array(*[F.lit(p) for p in PRIMES]), (turn % len(PRIMES) + 1).cast("int"))
    return F.pmod(by * place + F.pmod(F.xxhash64(sid, turn, F.lit(5)), blocks), blocks)


def _plan(named: DataFrame, block_words: int) -> DataFrame:
    """Passes and block counts of the sources."""
    passes = F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words"))).otherwise(0)
    return (named.withColumn("passes", passes.cast("long"))
            .withColumn("part", F.round(F.col("target") - F.col("passes") * F.col("words")).cast("long"))
            .withColumn("blocks", F.greatest(F.lit(1), F.ceil(
                (F.col("words") + F.col("docs")) / block_words)).cast("long")))


def _split(nodes: DataFrame, bound) -> DataFrame:
    """The two halves of every node that is no shard yet, and the shards."""
    middle = F.floor((F.col("lo") + F.col("hi")) / 2)
    draws = bound(middle) - bound(F.col("lo"))
    left_all = bound(F.col("hi")) - bound(F.col("lo"))

    def urn(state: Column, one: Column) -> Column:
        def draw(s: Column, k: Column) -> Column:
            number = F.shiftrightunsigned(
                F.xxhash64(F.col("lo"), F.col("hi"), one["sid"], k, F.lit(9)), 11) / F.lit(2.0 ** 53)
            hit = number * s["units"] < s["draws"]
            return F.struct((s["draws"] - F.when(hit, 1).otherwise(0)).alias("draws"),
                            (s["units"] - 1).alias("units"),
                            (s["got"] + F.when(hit, 1).otherwise(0)).alias("got"),
                            s["out"].alias("out"))

        start = F.struct(state["draws"].alias("draws"), state["units"].alias("units"),
                         F.lit(0).cast("long").alias("got"), state["out"].alias("out"))
        return F.aggregate(F.sequence(F.lit(1).cast("long"), one["n"]), start, draw, lambda s: F.struct(
            s["draws"].alias("draws"), s["units"].alias("units"),
            F.concat(s["out"], F.array(F.struct(one["sid"].alias("sid"), s["got"].alias("left"),
                                                (one["n"] - s["got"]).alias("right")))).alias("out")))

    empty = F.array().cast("array<struct<sid: bigint, left: bigint, right: bigint>>")
    drawn = F.aggregate("counts", F.struct(draws.alias("draws"), left_all.alias("units"),
                                           empty.alias("out")), urn, lambda s: s["out"])

    def side(name: str) -> Column:
        return F.transform(F.filter("drawn", lambda c: c[name] > 0),
                           lambda c: F.struct(c["sid"].alias("sid"), c[name].alias("n")))

    halves = F.array(F.struct("lo", F.col("mid").alias("hi"), side("left").alias("counts")),
                     F.struct(F.col("mid").alias("lo"), "hi", side("right").alias("counts")))
    inner = (nodes.where("hi - lo > 1").withColumns({"mid": middle, "drawn": drawn})
             .select(F.explode(halves).alias("h")).select("h.*"))
    return inner.unionByName(nodes.where("hi - lo <= 1"))


def _first_nodes(units: DataFrame, shards: int, total: int, node_units: int) -> tuple[DataFrame, int]:
    """(lo, hi, counts) of the nodes at the top of the tree, and the most shards that one of them has."""
    nodes = max(1, min(shards, -(-total // node_units)))
    each = _numbers(units, "n", "k").select("sid", "k", F.xxhash64("sid", "k", F.lit(11)).alias("key"))
    ranked = _running(each, [F.col("key"), F.col("sid"), F.col("k")], {"rank": F.lit(1).cast("long")})
    # The node whose run of ranks holds this one, by way of the shard.
    shard = F.expr(f"((rank + 1) * {shards}L - 1) div {max(total, 1)}L")
    counted = (ranked.withColumn("shard", shard)
               .withColumn("node", F.expr(f"((shard + 1) * {nodes}L - 1) div {shards}L"))
               .groupBy("node", "sid").agg(F.count("*").alias("n")))

    def edge(place: Column) -> Column:
        return F.floor(place * shards / nodes).cast("long")

    return counted.groupBy("node").agg(F.array_sort(F.collect_list(
        F.struct("sid", "n"))).alias("counts")).select(
        edge(F.col("node")).alias("lo"), edge(F.col("node") + 1).alias("hi"), "counts"), -(-shards // nodes)


def quotas(units: DataFrame, shards: int, total: int, node_units: int = NODE) -> DataFrame:
    """(shard, sid, start, n) from unit counts (sid, n): each shard's run of each source's units."""
    def bound(place: Column) -> Column:
        return F.floor(place * F.lit(total) / F.lit(shards)).cast("long")

    nodes, width = _first_nodes(units, shards, total, node_units)
    nodes, level = stored(nodes, "nodes"), 0
    while width > 1:
        nodes, width, level = _split(nodes, bound), -(-width // 2), level + 1
        if level % REGROUP == 0:
            # The nodes of a tree of this depth keep all cores busy.
            nodes = stored(nodes.repartition("lo"), "nodes")
    leaves = stored(nodes.select(F.col("lo").alias("shard"), F.explode("counts").alias("c"))
                    .select("shard", "c.sid", "c.n"), "quotas")
    before = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return leaves.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))


def mix(docs: DataFrame, carry: list[str], weights=WEIGHTS, most: int = MOST,
        shard_words: int = SHARD_WORDS, id_column: str = "doc_id", text: str = "text",
        source: str = "source") -> DataFrame:
    """Every row with its ``carry`` columns, mix_size, mix_source_size, mix_target, mix_taken,
    mix_shards (one entry per copy) and mix_key (order inside a shard)."""
    block_words = max(1, shard_words // BLOCKS_PER_SHARD)
    held = [f"_c{k}" for k in range(len(carry))]
    sized = docs.select(*[F.col(c).alias(h) for c, h in zip(carry, held)],
                        F.col(source).cast("string").alias("_source"),
                        F.xxhash64(F.col(id_column), F.lit(1)).alias("_hash"),
                        F.monotonically_increasing_id().alias("_row"),
                        word_count(text).alias("mix_size"))
    sized = stored(sized, "sized")
    sizes = sized.groupBy(F.col("_source").alias("source")).agg(
        F.sum("mix_size").alias("words"), F.count("*").alias("docs"))
    plan = stored(_plan(targets(sizes, weights, most), block_words), "plan")
    rows = (sized.join(plan.withColumnRenamed("source", "_name"),
                       F.col("_source").eqNullSafe(F.col("_name")))
            .withColumn("block", F.pmod("_hash", "blocks")))
    keys = ["sid", "block"]
    weighed = stored(rows.groupBy(*keys).agg(F.sum("mix_size").alias("words")), "blocks")
    # The part of a pass: blocks in permuted order while they fit, and the one where the rest ends.
    last = (_numbers(plan.where("part > 0").select("sid", "passes", "part", "blocks"), "blocks", "place")
            .withColumn("block", _permuted(F.col("place"), F.col("passes"), F.col("sid"), F.col("blocks"))))
    lined = running_sum(
        last.join(weighed, keys, "left").withColumn("words", F.coalesce("words", F.lit(0))),
        ["sid"], F.floor(F.col("place") / BUCKET), [F.col("place")], {"sum": F.col("words")})
    ends = lined.where(F.col("sum") - F.col("words") < F.col("part")).groupBy("sid").agg(
        F.count("*").alias("units"),
        F.max(F.when(F.col("sum") > F.col("part"), F.struct(
            "place", (F.col("part") - F.col("sum") + F.col("words")).alias("gap")))).alias("cut"))
    units = stored(plan.join(ends, "sid", "left").select(
        "sid", "passes", "blocks", "cut",
        (F.col("passes") * F.col("blocks") + F.coalesce("units", F.lit(0))).alias("n")), "units")
    words, total = plan.agg(F.sum("words")).first()[0] or 0, units.agg(F.sum("n")).first()[0] or 0
    shards = max(1, min(-(-words // shard_words), total))
    drawn = (quotas(units.select("sid", "n"), shards, total)
             .select("sid", "shard", F.explode(F.sequence(
                 F.col("start"), F.col("start") + F.col("n") - 1)).alias("unit"))
             .join(units.drop("n"), "sid")
             .withColumn("turn", F.floor(F.col("unit") / F.col("blocks")))
             .withColumn("place", F.col("unit") % F.col("blocks"))
             .withColumn("block", _permuted(F.col("place"), F.col("turn"), F.col("sid"),
                                            F.col("blocks")))
             .withColumn("ends", F.coalesce((F.col("turn") == F.col("passes"))
                                            & (F.col("place") == F.col("cut.place")), F.lit(False))))
    drawn = stored(drawn, "drawn")
    draws = stored(drawn.where("NOT ends").groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.col("shard").cast("int"))).alias("whole")), "draws")
    cuts = stored(drawn.where("ends").select(
        "sid", F.col("block").alias("cut_block"), F.col("cut.place").alias("cut_place"),
        F.col("cut.gap").alias("rest"), F.col("shard").cast("int").alias("cut_shard")), "cuts")
    picks = stored(_fill(rows.where("mix_size > 0").select(*keys, "_hash", "_row", "mix_size"),
                         last.select(*keys, "place"), cuts)
                   .join(cuts.select("sid", "cut_shard"), "sid"), "picks")
    own = ["_hash", *held, "mix_size", "words", "target", "whole"]
    # Only blocks with picked documents meet the picks.
    some = stored(picks.select(*keys).distinct(), "picked")
    every = rows.join(draws, keys, "left")
    plain = every.join(some, keys, "left_anti").select(*own, F.lit(None).cast("int").alias("cut_shard"))
    cut = (every.join(some, keys, "left_semi").join(picks.select("_row", "cut_shard"), "_row", "left")
           .select(*own, "cut_shard"))
    shards_of = F.concat(F.coalesce("whole", F.array().cast("array<int>")),
                         F.when(F.col("cut_shard").isNotNull(), F.array("cut_shard"))
                         .otherwise(F.array().cast("array<int>")))
    return (plain.unionByName(cut).withColumn("mix_shards", shards_of)
            .select(*[F.col(h).alias(c) for c, h in zip(carry, held)], "mix_size",
                    F.col("words").alias("mix_source_size"),
                    F.col("target").alias("mix_target"),
                    (F.col("mix_size") * F.size("mix_shards")).cast("long").alias("mix_taken"),
                    "mix_shards", F.xxhash64("_hash", F.lit(7)).alias("mix_key")))


def _first_fit(docs: DataFrame) -> DataFrame:
    """(sid, rest, taken) of rows (sid, rest, _hash, mix_size, _row), a block's documents per source:
    the keys of those that fit into what those before them in hashed order leave."""
    def take(state: Column, doc: Column) -> Column:
        fits = doc["mix_size"] <= state["rest"]
        return F.struct(
            F.when(fits, state["rest"] - doc["mix_size"]).otherwise(state["rest"]).alias("rest"),
            F.when(fits, F.concat(state["out"], F.array(doc["_row"]))).otherwise(state["out"]).alias("out"))

    def chunk(state: Column, begin: Column) -> Column:
        # Each step copies the list it adds to, so the list of a chunk is made by itself.
        start = F.struct(state["rest"].alias("rest"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(F.slice("docs", begin, CHUNK), start, take, lambda x: F.struct(
            x["rest"].alias("rest"), F.concat(state["out"], F.array(x["out"])).alias("out")))

    lined = docs.groupBy("sid").agg(F.max("rest").alias("rest"), F.array_sort(F.collect_list(
        F.struct("_hash", "mix_size", "_row"))).alias("docs"))
    start = F.struct(F.col("rest").cast("long").alias("rest"),
                     F.array().cast("array<array<bigint>>").alias("out"))
    filled = F.aggregate(F.sequence(F.lit(1), F.size("docs"), F.lit(CHUNK)), start, chunk)
    return lined.select("sid", filled.alias("f")).select(
        "sid", F.col("f.rest").alias("rest"), F.flatten("f.out").alias("taken"))


def _fill(docs: DataFrame, places: DataFrame, cuts: DataFrame) -> DataFrame:
    """(sid, block, _row) of the documents for the last words of each source in ``cuts``.

    A block has block_words words and documents at most, give or take one. After the block where the
    rest ends, cells of one block and one power of two of sizes are taken whole in the order of sizes,
    then places, and the first cell that is too large is filled. What is left then is less than the
    double of that power, and after the next round less than the power, so rounds are few.
    """
    first = docs.join(cuts.select("sid", F.col("cut_block").alias("block"), "rest"), ["sid", "block"])
    filled = stored(_first_fit(first.where("mix_size <= rest")), "filled")
    taken = filled.select("sid", F.explode("taken").alias("_row"))
    picks = taken.join(first.select("block", "_row"), "_row").select("sid", "block", "_row")
    # A block in which nothing fits leaves all of its rest.
    rests = stored(cuts.select("sid", "cut_place", F.col("rest").alias("_all")).join(
        filled.select("sid", "rest"), "sid", "left").select(
        "sid", "cut_place", F.coalesce("rest", "_all").alias("rest")).where("rest > 0"), "rests")
    later = (docs.join(rests, "sid").where("mix_size <= rest").join(places, ["sid", "block"])
             .where("place > cut_place").select(*docs.columns, "place"))
    while not rests.isEmpty():
        size_class = F.length(F.bin("mix_size"))
        later = stored(later.drop("rest").join(rests.select("sid", "rest"), "sid")
                       .where("mix_size <= rest").withColumn("class", -size_class), "later")
        cells = later.groupBy("sid", "class", "place").agg(
            F.sum("mix_size").alias("words"), F.max("rest").alias("rest"))
        summed = stored(running_sum(
            cells, ["sid"], F.struct("class", F.floor(F.col("place") / BUCKET).alias("at")),
            [F.col("class"), F.col("place")], {"sum": F.col("words")}), "cells")
        whole = later.join(summed.where("sum <= rest").select("sid", "class", "place"),
                           ["sid", "class", "place"])
        next_cell = summed.where("sum > rest").groupBy("sid").agg(F.min(F.struct(
            "class", "place", (F.col("rest") - F.col("sum") + F.col("words")).alias("rest"))).alias("c"))
        ends = (later.drop("rest").join(next_cell.select("sid", "c.*"), ["sid", "class", "place"]))
        filled = stored(_first_fit(ends), "filled")
        taken = whole.select("sid", "block", "_row").unionByName(
            filled.select("sid", F.explode("taken").alias("_row"))
            .join(ends.select("block", "_row"), "_row").select("sid", "block", "_row"))
        taken = stored(taken, "taken")
        picks = picks.unionByName(taken)
        # Where no cell was too large, all that fits is taken.
        rests = stored(filled.where("rest > 0").select("sid", "rest"), "rests")
        later = later.drop("class").join(taken.select("_row"), "_row", "left_anti")
    return picks


def copies(mixed: DataFrame, carry: list[str]) -> DataFrame:
    """The mix itself: one row per copy, with its shard and its key inside the shard."""
    return mixed.select(*carry, "mix_key", F.posexplode("mix_shards").alias("mix_copy", "mix_shard")) \
        .withColumn("mix_key", F.xxhash64("mix_key", "mix_copy", "mix_shard")).drop("mix_copy")


def write_shards(mixed: DataFrame, carry: list[str], path: str) -> None:
    """One folder per shard, its rows in the order of their keys."""
    (copies(mixed, carry).repartition("mix_shard").sortWithinPartitions("mix_shard", "mix_key")
     .write.partitionBy("mix_shard").parquet(path))
