"""Shards from a consistent-hash ring with virtual nodes and bounded loads.

A document's key is its text, so copies lie at one point of the ring. Every shard owns ``points``
virtual nodes; a key belongs to the next node clockwise. A shard has a capacity in rows: what finds its
shard full continues clockwise to the next node whose shard has room. With ``slack`` 0 the capacities
add up to the number of rows and differ by one at most, which is the law ``rows``. A larger slack
leaves more rows at their own node.

The ring is cut into ``2**bits`` cells. Rows are placed by their order on the ring (cell, then a hash
of id and text, then id and text); only counts per node, a table as long as the ring has nodes, decide
where the rows of a node go: one run of ranks per node and shard. Equal rows are counted first and have
consecutive ranks. Ranks come from counts per cell and per block of about BLOCK different rows, never
from a sort of a whole cell; copies are made again from the counts, RUN at a time.

Defined cases: a null text counts as empty; a null id is a row like others; equal rows are told apart
by their rank; an empty table gives an empty result. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lurewatch.llm.common import stored

POINTS, BITS, BLOCK, RUN = 64, 20, 128, 1 << 12


def _ring(shards: int, points: int, bits: int) -> list[tuple[int, int]]:
    """(cell, shard) of the virtual nodes, clockwise; a shard keeps its nodes when others join."""
    rng = [np.random.default_rng([77, s]) for s in range(shards)]
    nodes = sorted((int(c), s) for s in range(shards) for c in rng[s].integers(0, 1 << bits, points))
    return nodes


def capacities(total: int, shards: int, slack: float = 0.0) -> list[int]:
    """Rows a shard may hold: an even share, larger by ``slack``."""
    share = [total // shards + (s < total % shards) for s in range(shards)]
    return [c + int(np.ceil(c * slack)) for c in share]


def runs(counts: dict[int, int], nodes: list[tuple[int, int]], room: list[int]) -> list[tuple]:
    """(node, first rank in the node, end rank, shard): what each node's rows come to.

    Two turns around the ring: first every node fills its own shard, then what is left continues
    clockwise to the next node whose shard has room.
    """
    room, out, waiting = list(room), [], []
    for at, (_, shard) in enumerate(nodes):
        n = counts.get(at, 0)
        own = min(n, room[shard])
        room[shard] -= own
        if own:
            out.append((at, 0, own, shard))
        if n > own:
            waiting.append((at, own, n))
    for at, begin, end in waiting:
        step = at
        while begin < end:
            step = (step + 1) % len(nodes)
            shard = nodes[step][1]
            take = min(end - begin, room[shard])
            if take:
                room[shard] -= take
                out.append((at, begin, begin + take, shard))
                begin += take
    return sorted(out)


def _next_node(cell, cells: list[int], first: int = 0):
    """Number of the first node at or behind ``cell``: a binary search as an expression."""
    if not cells:
        return F.lit(first)
    mid = len(cells) // 2
    return F.when(cell <= cells[mid], _next_node(cell, cells[:mid], first)).otherwise(
        _next_node(cell, cells[mid + 1:], first + mid + 1))


def place(docs: DataFrame, shards: int = 8, slack: float = 0.0, points: int = POINTS,
          bits: int = BITS, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, home_shard (without bounds), shard, slot (gapless in the shard)."""
    spark = docs.sparkSession
    nodes = _ring(shards, points, bits)
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    row = docs.select(F.col(id_column).cast("long").alias("doc_id"),
                      (F.length(body) + 1).cast("long").alias("size"),
                      F.crc32(body).alias("text_crc32"), F.xxhash64(body).alias("h"))
    ring = row.withColumns({"cell": F.shiftrightunsigned("h", 64 - bits),
                            "turn": F.xxhash64("doc_id", "h", F.lit(3))})
    # Behind the last node comes the first.
    ring = ring.withColumn("node", _next_node(F.col("cell"), [c for c, _ in nodes]) % len(nodes))
    ring = stored(ring.groupBy(*ring.columns).agg(F.count("*").alias("copies")), "ring")
    per_cell = ring.groupBy("node", "cell").agg(F.sum("copies").alias("n"), F.count("*").alias("rows"))
    sums = per_cell.groupBy("node").agg(F.sum("n").alias("n"), F.max("rows").alias("most")).collect()
    counts = {r.node: r.n for r in sums}
    most = max((r.most for r in sums), default=0)
    plan = runs(counts, nodes, capacities(sum(counts.values()), shards, slack))
    held, rows = [0] * shards, []
    for at, begin, end, shard in plan:
        rows.append((at, begin, end, shard, held[shard], nodes[at][1]))
        held[shard] += end - begin
    by_node = (spark.createDataFrame(rows, "node int, begin long, end long, shard int, slot0 long, "
                                           "home_shard int").coalesce(1)
               .groupBy("node", "home_shard")
               .agg(F.collect_list(F.struct("begin", "end", "shard", "slot0")).alias("runs")))
    # Blocks of a cell: as many bits of the hash as the cell with the most different rows needs.
    cut = max(0, (max(most, 1) // BLOCK)).bit_length()
    ranged = ring.withColumn("block", F.shiftrightunsigned("turn", 64 - cut) if cut else F.lit(0))
    keys = ["node", "cell", "block"]

    def earlier(by: list[str], order: str):
        return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    offsets = per_cell.select("node", "cell", F.coalesce(
        F.sum("n").over(earlier(["node"], "cell")), F.lit(0)).alias("offset"))
    before = (ranged.groupBy(*keys).agg(F.sum("copies").alias("m"))
              .select(*keys, F.coalesce(F.sum("m").over(earlier(keys[:2], "block")), F.lit(0))
                      .alias("before"))
              .join(offsets, ["node", "cell"])
              .select(*keys, (F.col("before") + F.col("offset")).alias("base")))
    inside = (Window.partitionBy(*keys).orderBy("turn", "doc_id", "h", "text_crc32", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    begun = (ranged.withColumn("k", F.coalesce(F.sum("copies").over(inside), F.lit(0))).join(before, keys)
             .withColumn("first", F.col("base") + F.col("k")))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Rows with many copies go on in runs, which any task may take.
    few = begun.where(F.col("copies") <= RUN)
    many = begun.where(F.col("copies") > RUN).withColumn("at", F.explode(F.sequence(
        F.lit(0).cast("long"), F.col("copies") - 1, F.lit(RUN).cast("long")))).withColumns({
            "first": F.col("first") + F.col("at"), "copies": F.least(F.col("copies") - F.col("at"), F.lit(RUN))
        }).drop("at").repartition(tasks, "node", "first")
    ranked = few.unionByName(many).withColumn("rank", F.explode(F.sequence(
        F.col("first"), F.col("first") + F.col("copies") - 1)))
    mine = F.element_at(F.filter("runs", lambda r: (r["begin"] <= F.col("rank"))
                                 & (F.col("rank") < r["end"])), 1)
    # The plan has at most two entries per node and one per shard, whatever the table's size.
    return (ranked.join(F.broadcast(by_node), "node").withColumn("run", mine)
            .select("doc_id", "size", "text_crc32", "home_shard", F.col("run.shard").alias("shard"),
                    (F.col("run.slot0") + F.col("rank") - F.col("run.begin")).alias("slot")))
