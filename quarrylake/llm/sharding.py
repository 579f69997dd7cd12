"""Sharding: balanced label propagation.

Each linked node wants the shard where most of its links lead. Wishes are summed by (from, to, bin), where
the bin is a hash of the node, so the driver gets a table whose size depends on shards and bins alone; it
grants bins of moves while the shard they lead to has room beside the nodes that have links there, and
nodes move by a join with the grants. In a round, nodes move between two shards one way only, and the
other way in the next, so two linked nodes don't swap places; which way is hashed, so shards gain and lose
about as much. Rounds end when nobody may move any more. Nodes without a link at home, and those without
any link, then fill the shards up, bin by bin, until sizes are even.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylake.llm.cluster import discard, hot_join, hot_limit, materialise, task_number

#: Bins of moves that are granted whole, per pair of shards.
BINS = 512
#: Repeated rows are one node up to this share of a shard's size; beyond, they are spread over several.
NODE_SHARE = 1e-3
#: Differences of sizes, as shares of the mean, that need no more levelling; and from which links are cut for it.
EVEN, UNEVEN = 2e-4, 1e-2


def _grant(wishes, held: dict[int, int], room: float) -> list[tuple[int, int, int]]:
    """The (from, to, bin) that may move while what a shard holds by links, ``held``, stays within ``room``.

    A wish is (from, to, bin, size, the part of size that has links at home). Wishes are taken from all
    pairs in turn, so exchanges between two full shards go on as one gives room to the other; passes are
    repeated while they grant something.
    """
    by_pair = defaultdict(list)
    for src, dst, k, size, leaves in sorted(wishes):
        by_pair[src, dst].append((k, size, leaves))
    queue = []
    for turn in range(max(map(len, by_pair.values()), default=0)):
        queue += [(p, *x[turn]) for p, x in sorted(by_pair.items()) if turn < len(x)]
    granted = []
    while True:
        rest = []
        for (src, dst), k, size, leaves in queue:
            if held[dst] + size <= room:
                held[src] -= leaves
                held[dst] += size
                granted.append((src, dst, k))
            else:
                rest.append(((src, dst), k, size, leaves))
        if len(rest) == len(queue):
            return granted
        queue = rest


def _level(stock, load: dict[int, int]) -> list[tuple[int, int, int]]:
    """(from, to, bin) of movable bins that bring the shards' loads together, the largest gap first."""
    by = defaultdict(list)
    for src, k, size in stock:
        by[src].append((size, k))
    for x in by.values():
        x.sort()
    moves = []
    while True:
        dst = min(load, key=lambda s: (load[s], s))
        best = None
        for src in sorted(load, key=lambda s: (-load[s], s)):
            gap = load[src] - load[dst]
            # The largest bin that is no more than half of the gap leaves both nearer to each other.
            fit = [x for x in by[src] if 2 * x[0] <= gap]
            if fit:
                best = (src, fit[-1])
                break
        if best is None:
            return moves
        src, (size, k) = best
        by[src].remove((size, k))
        load[src] -= size
        load[dst] += size
        moves.append((src, dst, k))


def _bin(salt: int, bins: int = BINS) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), "node"), F.lit(bins)).cast("int")


def _moved(table: DataFrame, moves, on: list[str], keep: list[str]) -> DataFrame:
    """``table`` with the shard of rows in a moved bin changed; ``moves`` is bounded by shards and bins."""
    if not moves:
        return table.select("node", "size", "shard", *keep)
    to = table.sparkSession.createDataFrame(moves, "shard int, to int, bin int")
    if "dst" in on:
        to = to.withColumn("dst", F.col("to"))
    return table.join(F.broadcast(to), on, "left").select("node", "size", F.coalesce("to", "shard").alias("shard"), *keep)


def label_propagation(
    nodes: DataFrame, edges: DataFrame, *, shards: int = 8, rounds: int = 40, level_rounds: int = 3, hot_links: int | None = None
) -> DataFrame:
    """(node, size, shard) for ``nodes`` (node long, distinct; size long) and undirected ``edges`` (a, b).

    Rounds go on until no move is granted in two of them, ``rounds`` being far beyond that for groups of
    copies; they read and write linked nodes only. What a shard holds by links stays within the mean
    size, as far as single nodes allow, so the rest can level the sizes; only if too little is left for
    that do linked nodes move as well. A group larger than a shard fills one and then others. An empty
    table gives no rows; nodes without edges only serve to level; edges to unknown nodes are void. A node
    of more than ``hot_links`` links (by default, so many that at most 10,000 nodes have them) is joined
    with its own links by a broadcast.
    """
    both = edges.select(F.col("a").alias("src"), F.col("b").alias("node")).unionByName(edges.select(F.col("b").alias("src"), F.col("a").alias("node"))).where("src != node")
    both = materialise(both, "links")
    n_links = both.count()
    first = nodes.select("node", "size", F.pmod(F.xxhash64(F.lit(0), "node"), F.lit(shards)).cast("int").alias("shard"))
    mean = float(nodes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]) / shards
    linked, view, hot = None, None, None
    if n_links:
        ends = both.select("node").distinct()
        linked = materialise(first.join(ends, "node", "left_semi"), "linked")
        limit = hot_links or hot_limit(n_links)
        if n_links > limit:
            hot = materialise(both.groupBy("src").count().where(F.col("count") > limit), "hot")  # MOST_HOT rows at most

    def votes(table: DataFrame) -> DataFrame:
        """Linked nodes with the shard where most of their links lead, its links, and those at home."""
        shard_of = table.select(F.col("node").alias("src"), F.col("shard").alias("dst"))
        shard_of = shard_of.withColumn("count", F.lit(0)) if hot is None else shard_of.join(F.broadcast(hot), "src", "left").withColumn("count", F.coalesce("count", F.lit(0)))
        near = hot_join(both, shard_of, "src", "count", n_links, hot_links).groupBy("node", "dst").agg(F.count("*").alias("links"))
        # At most as many entries as shards.
        each = near.groupBy("node").agg(F.max(F.struct("links", F.xxhash64(F.lit(1), "dst").alias("tie"), "dst")).alias("best"), F.map_from_entries(F.collect_list(F.struct("dst", "links"))).alias("all"))
        return table.join(each, "node", "left").select("node", "size", "shard", F.col("best.dst").alias("dst"), F.coalesce("best.links", F.lit(0)).alias("links"), F.coalesce(F.try_element_at("all", F.col("shard")), F.lit(0)).alias("home"))

    idle = 0
    for step in range(rounds if n_links else 0):
        after = materialise(votes(linked).withColumn("bin", _bin(100 + step)), "votes")
        turn = F.pmod(F.xxhash64(F.least("dst", "shard"), F.greatest("dst", "shard")) + step, F.lit(2)) == 0
        wish = after.where((F.col("dst") != F.col("shard")) & (F.col("links") > F.col("home")))
        asked = wish.where((F.col("dst") > F.col("shard")) == turn).groupBy("shard", "dst", "bin").agg(F.sum("size"), F.sum(F.when(F.col("home") > 0, F.col("size")).otherwise(0)))
        asked = [tuple(r) for r in asked.collect()]  # at most shards * shards * bins rows
        held = {k: 0 for k in range(shards)} | {r["shard"]: r["size"] for r in after.where("home > 0").groupBy("shard").agg(F.sum("size").alias("size")).collect()}
        grants = _grant(asked, held, mean)
        idle = 0 if grants else idle + 1
        going = after.withColumn("bin", F.when((F.col("links") > F.col("home")) & (F.col("dst") != F.col("shard")), F.col("bin")))
        linked = _moved(going, grants, ["shard", "dst", "bin"], [])
        if view is not None:
            discard(view)
        view = after
        if idle == 2:
            break

    state = first.withColumn("loose", F.lit(True))
    if n_links:
        home = votes(linked).select("node", "size", "shard", (F.col("home") == 0).alias("loose"))
        state = first.join(ends, "node", "left_anti").select("node", "size", "shard", F.lit(True).alias("loose")).unionByName(home)
    state = materialise(state, "shards")
    for step in range(2 * level_rounds):
        load = {k: 0 for k in range(shards)} | {r["shard"]: r["size"] for r in state.groupBy("shard").agg(F.sum("size").alias("size")).collect()}
        # Linked nodes only move where the loose ones leave the shards far from even.
        if max(load.values()) - min(load.values()) <= (EVEN if step < level_rounds else UNEVEN) * mean:
            break
        movable = F.col("loose") if step < level_rounds else F.lit(True)
        binned = state.withColumn("bin", F.when(movable, _bin(200 + step, BINS << (2 * (step % level_rounds)))))
        stock = [tuple(r) for r in binned.where("bin is not null").groupBy("shard", "bin").agg(F.sum("size")).collect()]
        moves = _level(stock, load)
        if moves:
            after = materialise(_moved(binned, moves, ["shard", "bin"], ["loose"]), "shards")
            discard(state)
            state = after
    discard(both, *(x for x in (view, hot) if x is not None))
    return state.select("node", "size", "shard")


def _number(batches):
    """Rows with their task, and their number among the task's rows of their shard."""
    task, made = task_number(), {}
    for batch in batches:
        shard = batch.column(batch.num_columns - 1).to_numpy()
        nth = np.zeros(len(shard), np.int64)
        for s in np.unique(shard):
            own = shard == s
            nth[own] = np.arange(own.sum()) + made.get(int(s), 0)
            made[int(s)] = made.get(int(s), 0) + int(own.sum())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(shard), task, np.int64)), pa.array(nth)], names=[*batch.schema.names, "task", "nth"])


def shard_documents(docs: DataFrame, *, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Assign all documents to shards 0 to ``shards``-1 of near equal bytes, equal texts together.

    Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, law ('bytes'), shard, slot (gapless from 0 in
    each shard), grown_shard (null under this law). Equal texts are linked to one of them; a group that
    is larger than a shard's room is split, never dropped. A null text has size 1 and is linked with
    other nulls and empty texts; repeated rows stay together while they are a small part of a shard; a
    null id is an id like any other; a very long text goes to one shard, so sizes can differ by it. An
    empty table gives no rows; columns other than the two, whatever their names, are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    raw = text.cast("binary")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64(text).alias("content"),
    ).withColumn("base", F.xxhash64("doc_id", "text_crc32", "size", "content"))
    rows = texts = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "texts")
    n_rows, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    # At most shards / NODE_SHARE keys can be as heavy as this.
    heavy = rows.groupBy("base").agg(F.count("*").alias("n"), F.sum("size").alias("all")).where((F.col("n") > 1) & (F.col("all") > total / shards * NODE_SHARE))
    heavy = heavy.select("base", F.least("n", F.ceil(F.col("all") / (total / shards * NODE_SHARE))).alias("parts"))
    spread = F.xxhash64("base", F.pmod(F.xxhash64("row"), F.col("parts")))
    rows = rows.join(F.broadcast(heavy), "base", "left").withColumn("node", F.when(F.col("parts").isNull(), F.col("base")).otherwise(spread)).select("doc_id", "size", "text_crc32", "content", "node")
    nodes = materialise(rows.groupBy("node").agg(F.sum("size").alias("size"), F.first("content").alias("content"), F.first("text_crc32").alias("crc")), "nodes")
    hubs = nodes.groupBy("content", "crc").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1")
    edges = hot_join(nodes.select("node", F.struct("content", "crc").alias("key")), hubs.select(F.struct("content", "crc").alias("key"), "hub", "n"), "key", "n", n_rows)
    placed = label_propagation(nodes.select("node", "size"), edges.where("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b")), shards=shards)

    out = rows.select("doc_id", "size", "text_crc32", "node").join(placed.select("node", "shard"), "node").select("doc_id", "size", "text_crc32", "shard")
    out = materialise(out.mapInArrow(_number, "doc_id long, size long, text_crc32 long, shard int, task long, nth long"), "placed")
    counts = out.groupBy("shard", "task").count()
    earlier = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = counts.select("shard", "task", (F.sum("count").over(earlier) - F.col("count")).alias("before"))
    discard(texts, nodes)
    return out.join(before, ["shard", "task"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("nth")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
