"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

No pair within a group is ever emitted as a row.

1. Every document's distinct shingles; their fingerprint puts equal sets into one class, of which one
   row stands for all. Incidences are cut into blocks by shingle, 6 bytes each, and a shingle that
   several documents of a task hold is sent once. Blocks answer how many documents share each.
2. A size bound: a set with a partner at Jaccard >= t shares at least ceil(t*n) of its n shingles, which
   drops most documents at once. Of the s shared shingles of a document left, the first
   s - ceil(t*n) + 1, rarest first, hold one in common with each partner. Documents that share one of
   these are chained, in order of their sizes, wherever neighbouring sizes allow the bound; a shingle
   that many rows hold is reduced to one row per task before the shuffle. The chains' connected
   components hold every pair that can be linked.
3. Components are cut into tiles of bounded size, ordered by set size; pairs of tiles whose sizes
   exclude the bound are skipped. For the rest the exact overlap matrix is accumulated from blocks of
   shingles, and only row sums and a spanning forest of the links leave the task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylake.llm.cluster import bitmap, bounded_batches, components, discard, in_bitmap, lean, lean_group, materialise
from quarrylake.llm.textcore import chunks, mix, shingle_sets, signed

#: Incidences in a block, about; incidences and documents that a task gathers before it sends them.
BLOCK_ROWS = 1_000_000
FLUSH_ROWS = 800_000
FLUSH_DOCS = 60_000
#: Tile pairs that a task multiplies, about: their cost is quadratic, so tasks aren't merged by bytes.
TASK_PAIRS = 64
#: Shingles in a tile, about (one document may have more); bits of the candidate bitmap (2 MB).
TILE_SHINGLES = 400_000
LOG2_BITS = 24
#: Marks the incidence of a shingle that several documents of its task hold.
MANY = 0xFFFF

_PARTS = "kind string, key long, flush long, payload binary"


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap with a set at least as large: ceil(percent * n / 100)."""
    return -(-n * percent // 100)


def chain(hashes: np.ndarray, low: np.ndarray, high: np.ndarray, ids: np.ndarray, percent: int):
    """Chain rows of equal hash whose size ranges are compatible.

    Rows are (hash, smallest size, largest size, id of one member). Returns edges between ids and the
    chains, one row each. In order of smallest sizes, a chain ends only where the largest size so far is
    too small for the next smallest one, so any compatible pair ends in one chain.
    """
    order = np.lexsort((ids, low, hashes))
    h, lo, hi, x = hashes[order], low[order], high[order], ids[order]
    if not len(h):
        return np.zeros((0, 2), np.int64), (h, lo, hi, x)
    new = np.r_[True, h[1:] != h[:-1]]
    segment = np.cumsum(new)
    top = np.maximum.accumulate(hi + segment * (np.int64(1) << 40)) - segment * (np.int64(1) << 40)
    joins = ~new
    joins[1:] &= top[:-1] * 100 >= percent * lo[1:]
    i = np.flatnonzero(joins)
    edges = np.stack([x[i - 1], x[i]], axis=1)
    edges = edges[edges[:, 0] != edges[:, 1]]
    if len(edges):
        edges = np.unique(np.sort(edges, axis=1), axis=0)
    first = np.flatnonzero(~joins)
    return edges, (h[first], lo[first], np.maximum.reduceat(hi, first), x[first])


def _part(kind: str, keys, flush: int, payloads) -> pa.RecordBatch:
    n = len(keys)
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * n, pa.string()), pa.array(keys, pa.int64()), pa.array([flush] * n, pa.int64()), pa.array(payloads, pa.binary())],
        names=["kind", "key", "flush", "payload"],
    )


def _as_long(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _incidences(width: int, blocks: int):
    """Step 1, by task: documents, incidences by block, and incidences already known to be shared.

    A flush is named by what it holds, so a task that runs again sends the same rows.
    """

    def scan(batches):
        sent: set[int] = set()
        sets: list[np.ndarray] = []
        prints: list[int] = []
        size = 0

        def flush():
            flush_id = _as_long(xxhash.xxh3_64_intdigest(np.array(prints, np.uint64).tobytes()))
            n = np.array([len(x) for x in sets], np.int64)
            h = np.concatenate(sets)
            which = np.repeat(np.arange(len(sets), dtype=np.uint16), n)
            order = np.argsort(h, kind="stable")
            h, which = h[order], which[order]
            new = np.r_[True, h[1:] != h[:-1]]
            multiple = ~(new & np.r_[new[1:], True])
            # Blocks split the range of hashes, so rows are in order of block already.
            first = np.flatnonzero(new)
            who = np.where(multiple[first], np.uint16(MANY), which[first])
            block = ((h[first] >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
            low = (h[first] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            at = np.searchsorted(block, np.arange(blocks + 1))
            some = np.flatnonzero(at[1:] > at[:-1])
            times = np.diff(np.r_[first, len(h)]).astype(np.uint16)
            many_at = np.searchsorted(np.flatnonzero(who == MANY), at)
            times = times[who == MANY]
            payloads = [
                np.uint32(at[k + 1] - at[k]).tobytes() + low[at[k] : at[k + 1]].tobytes() + who[at[k] : at[k + 1]].tobytes() + times[many_at[k] : many_at[k + 1]].tobytes()
                for k in some
            ]
            yield _part("block", some, flush_id, payloads)
            m = np.flatnonzero(multiple)
            key = ((h[m] >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)) << np.uint64(32) | (h[m] & np.uint64(0xFFFFFFFF))
            home = flush_id % blocks
            yield _part("local", [home], flush_id, [key.tobytes() + which[m].tobytes()])
            yield _part("sizes", [home], flush_id, [np.array(prints, np.uint64).tobytes() + n.tobytes()])

        for batch in batches:
            count, named = [], []
            for _, _, data, offsets in chunks(batch.column(1)):
                for s in shingle_sets(data, offsets, width):
                    name = xxhash.xxh3_64_intdigest(s.tobytes())
                    count.append(len(s))
                    named.append(name)
                    if len(s) and name not in sent:
                        sent.add(name)
                        sets.append(s)
                        prints.append(name)
                        size += len(s)
                        if size >= FLUSH_ROWS or len(sets) >= FLUSH_DOCS:
                            yield from flush()
                            sets, prints, size = [], [], 0
            ids = batch.column(0)
            here = np.array(named, np.uint64)
            rows = ids.fill_null(0).to_numpy().tobytes() + np.array(count, np.int64).tobytes() + here.tobytes() + ids.is_valid().to_numpy(zero_copy_only=False).tobytes()
            if len(ids):
                yield _part("rows", [int(here[0] % np.uint64(blocks))], 0, [rows])
        if sets:
            yield from flush()

    return scan


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """How many documents share each incidence of a block, if several do, for each flush; the rest passes through."""
    other = pdf[pdf["kind"] != "block"]
    own = pdf[pdf["kind"] == "block"]
    if not len(own):
        return other
    low, who, times = [], [], []
    for p in own["payload"]:
        k = int(np.frombuffer(p, np.uint32, 1)[0])
        low.append(np.frombuffer(p, np.uint32, k, 4))
        who.append(np.frombuffer(p, np.uint16, k, 4 + 4 * k))
        count = np.ones(k, np.int64)
        count[who[-1] == MANY] = np.frombuffer(p, np.uint16, offset=4 + 6 * k)
        times.append(count)
    part = np.repeat(np.arange(len(low), dtype=np.int32), [len(x) for x in low])
    h, who, times = np.concatenate(low), np.concatenate(who), np.concatenate(times)
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    total = np.add.reduceat(times[order], first)
    held = np.empty(len(h), np.int64)
    held[order] = np.repeat(total, np.diff(np.r_[first, len(h)]))
    at = np.flatnonzero(held > 1)
    h, who, held, part = h[at], who[at], np.minimum(held[at], 65535).astype(np.uint16), part[at]
    at = np.searchsorted(part, np.arange(len(own) + 1))
    out = [
        ("shared", own["key"].iloc[0], flush, b"".join(x[at[k] : at[k + 1]].tobytes() for x in (h, who, held)))
        for k, flush in enumerate(own["flush"])
        if at[k + 1] > at[k]
    ]
    return pd.concat([other, pd.DataFrame(out, columns=pdf.columns)], ignore_index=True)


def _row_table(batches):
    """The documents' rows: doc_id, n, print."""
    for b in batches:
        for p in b.column(0):
            p = p.as_py()
            k = len(p) // 25
            ids, n, prints = (np.frombuffer(p, np.int64, k, 8 * k * i) for i in range(3))
            valid = np.frombuffer(p, np.bool_, k, 24 * k)
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=~valid), pa.array(n), pa.array(prints)], names=["doc_id", "n", "print"])


def _prefixes(percent: int, blocks: int):
    """Step 2, by flush: the documents with enough shared shingles, chained by the first of these."""

    def select(pdf: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"block": [], "payload": [], "a": [], "b": []})
        sizes = pdf.loc[pdf["kind"] == "sizes", "payload"]
        shared = pdf.loc[pdf["kind"] == "shared", ["key", "payload"]]
        local = pdf.loc[pdf["kind"] == "local", "payload"]
        if not len(sizes) or not len(shared):
            return none
        k = len(sizes.iloc[0]) // 16
        prints, n = np.frombuffer(sizes.iloc[0], np.int64, k), np.frombuffer(sizes.iloc[0], np.int64, k, 8 * k)
        key = np.concatenate([np.frombuffer(p, np.uint32, len(p) // 8).astype(np.uint64) | np.uint64(b) << np.uint64(32) for b, p in zip(shared["key"], shared["payload"])])
        who = np.concatenate([np.frombuffer(p, np.uint16, len(p) // 8, len(p) // 8 * 4) for p in shared["payload"]]).astype(np.int64)
        held = np.concatenate([np.frombuffer(p, np.uint16, len(p) // 8, len(p) // 8 * 6) for p in shared["payload"]])
        # The answers for shingles of several documents of this flush are given to each of them.
        many = who == MANY
        order = np.argsort(key[many])
        known, known_held = key[many][order], held[many][order]
        own_key = np.concatenate([np.frombuffer(p, np.uint64, len(p) // 10) for p in local])
        own_who = np.concatenate([np.frombuffer(p, np.uint16, len(p) // 10, len(p) // 10 * 8) for p in local]).astype(np.int64)
        key, who = np.concatenate([key[~many], own_key]), np.concatenate([who[~many], own_who])
        held = np.concatenate([held[~many], known_held[np.searchsorted(known, own_key)]])
        room = np.bincount(who, minlength=k) - needed(n, percent) + 1
        keep = room[who] > 0
        key, who, held = key[keep], who[keep], held[keep]
        order = np.lexsort((key, held, who))
        key, who = key[order], who[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        first = rank < room[who]
        key, who = key[first], who[first]
        edges, (h, lo, hi, x) = chain(key, n[who], n[who], prints[who], percent)
        block = (mix(h) % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        at = np.searchsorted(block[order], np.arange(blocks + 1))
        rows = []
        for b in range(blocks):
            o = order[at[b] : at[b + 1]]
            if len(o):
                rows.append((b, signed(h[o]).tobytes() + lo[o].astype(np.int32).tobytes() + hi[o].astype(np.int32).tobytes() + x[o].tobytes(), 0, 0))
        ends = pd.DataFrame({"block": -1, "payload": None, "a": edges[:, 0], "b": edges[:, 1]})
        return pd.concat([pd.DataFrame(rows, columns=["block", "payload", "a", "b"]), ends]) if len(rows) or len(ends) else none

    return select


def _chain_block(percent: int):
    """Chains across flushes: the rows of one block of shingles."""

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        h, lo, hi, x = [], [], [], []
        for p in pdf["payload"]:
            k = len(p) // 24
            h.append(np.frombuffer(p, np.int64, k).view(np.uint64))
            lo.append(np.frombuffer(p, np.int32, k, 8 * k).astype(np.int64))
            hi.append(np.frombuffer(p, np.int32, k, 12 * k).astype(np.int64))
            x.append(np.frombuffer(p, np.int64, k, 16 * k))
        edges, _ = chain(*map(np.concatenate, (h, lo, hi, x)), percent)
        return pd.DataFrame({"a": edges[:, 0], "b": edges[:, 1]})

    return join


def _sets_of(width: int, bits, log2_bits: int):
    """Pass 3: the shingle sets of the documents that may be candidates."""

    def scan(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            keep = in_bitmap(bits.value, log2_bits, mix(ids.astype(np.int64).view(np.uint64)))
            if not keep.any():
                continue
            chosen = batch.filter(pa.array(keep))
            for lo, hi, data, offsets in chunks(chosen.column(1)):
                sets = shingle_sets(data, offsets, width)
                yield pa.RecordBatch.from_arrays(
                    [chosen.column(0).slice(lo, hi - lo), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "grams"]
                )

    return scan


def overlaps(left: list[np.ndarray], right: list[np.ndarray], block: int = 1 << 12) -> np.ndarray:
    """Exact overlap counts of sorted sets: incidence blocks of ``block`` shingles, multiplied and added up."""
    rows = np.concatenate(left + right) if left or right else np.zeros(0, np.uint64)
    which = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in left + right])
    _, columns, counts = np.unique(rows, return_inverse=True, return_counts=True)
    shared = counts > 1
    number = np.cumsum(shared) - 1
    keep = shared[columns]
    columns, which = number[columns[keep]], which[keep]
    total = np.zeros((len(left), len(right)), np.float64)
    order = np.argsort(columns, kind="stable")
    columns, which = columns[order], which[order]
    for lo in range(0, int(number[-1]) + 1 if len(number) else 0, block):
        a, b = np.searchsorted(columns, [lo, lo + block])
        m = np.zeros((len(left) + len(right), block), np.float32)
        m[which[a:b], columns[a:b] - lo] = 1
        total += m[: len(left)] @ m[len(left) :].T
    return np.rint(total).astype(np.int64)


def _tile(percent: int):
    """Links between two tiles (or within one): each row's links, and a spanning forest by least id."""

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["tile", "rep"]).sort_values(["tile", "rep"], ignore_index=True)
        tiles = pdf["tile"].unique()
        parts = [pdf[pdf["tile"] == t] for t in tiles]
        left, right = parts[0], parts[-1]
        wanted = int(pdf["tiles"].iloc[0])
        if len(parts) < wanted:
            return pd.DataFrame({"rep": [], "links": [], "low": []})
        sets = [[np.frombuffer(g, np.uint64) for g in p["grams"]] for p in (left, right)]
        both = overlaps(*sets)
        n, m = (np.array([len(s) for s in x]) for x in sets)
        linked = both * 100 >= percent * (n[:, None] + m[None, :] - both)
        a, b = left["rep"].to_numpy(), right["rep"].to_numpy()
        if wanted == 1:
            np.fill_diagonal(linked, False)
        ids = a if wanted == 1 else np.concatenate([a, b])
        links = linked @ right["members"].to_numpy() if wanted == 1 else np.concatenate([linked @ right["members"].to_numpy(), linked.T @ left["members"].to_numpy()])
        labels = ids.copy()
        while True:
            la, lb = (labels, labels) if wanted == 1 else (labels[: len(a)], labels[len(a) :])
            big = np.iinfo(np.int64).max
            na = np.minimum(la, np.where(linked, lb[None, :], big).min(axis=1))
            nb = np.minimum(lb, np.where(linked, la[:, None], big).min(axis=0))
            after = np.minimum(na, nb) if wanted == 1 else np.concatenate([na, nb])
            if (after == labels).all():
                break
            labels = after
        some = links > 0
        return pd.DataFrame({"rep": ids[some], "links": links[some], "low": labels[some]})

    return product


def ngram_jaccard(docs: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents whose sets of ``width``-word shingles have a Jaccard index of at least ``percent``/100.

    Returns one row per input row: doc_id, n_shingles, n_similar (other rows linked directly, copies
    included), component_id (the least doc_id reachable by links, itself included). No link between
    different texts is lost and none is sampled; copies are counted, not expanded.

    Nulls and empty texts have no shingles and are linked with nothing; an empty table gives no rows. A
    text of fewer words than ``width`` is a single shingle; a very long one is a set like others, alone in
    a tile if it fills one. Repeated rows are documents of their own that are linked. A row with a
    null id keeps its row, with n_similar 0 and a null component, and isn't counted for others. Other
    columns, whatever their names, are not read. Shingles are compared by 64-bit hashes and sets by a
    64-bit fingerprint of these together with their size.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    # About a sixth of the bytes are shingles; more or fewer blocks only change their size.
    text_bytes = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = int(max(1, text_bytes // 6 // BLOCK_ROWS))
    first = materialise(source.mapInArrow(lean(_incidences(width, blocks)), _PARTS).groupBy("key").applyInPandas(lean_group(_answer), _PARTS), "incidences")
    rows = materialise(first.where("kind = 'rows'").select("payload").mapInArrow(_row_table, "doc_id long, n long, print long"), "rows")
    classes = materialise(
        rows.where("n > 0 and doc_id is not null").groupBy("print", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members")), "classes"
    )

    few = max(1, blocks // 8)
    second = materialise(
        first.where("kind in ('shared', 'local', 'sizes')").groupBy("flush").applyInPandas(lean_group(_prefixes(percent, few)), "block int, payload binary, a long, b long"), "prefixes"
    )
    across = second.where("block >= 0").select("block", "payload").groupBy("block").applyInPandas(lean_group(_chain_block(percent)), "a long, b long")
    chains = second.where("block < 0").select("a", "b").unionByName(across).distinct()
    by_print = classes.select("print", "rep")
    chains = (
        chains.join(by_print.select(F.col("print").alias("a"), F.col("rep").alias("x")), "a")
        .join(by_print.select(F.col("print").alias("b"), F.col("rep").alias("y")), "b")
        .select("x", "y")
    )
    groups = components(chains, "x", "y")

    # Tiles by set size within a component: a prefix sum over (component, size), then even cuts. Where
    # one size alone fills tiles, rows of that size are spread over them by hash.
    member = groups.join(classes, groups["node"] == classes["rep"]).select("component", "rep", "n", "members")
    steps = member.groupBy("component", "n").agg(F.sum("n").alias("mass"))
    by_size = steps.withColumn("before", F.sum("mass").over(_running("component", "n")) - F.col("mass"))
    spread = F.pmod(F.xxhash64("rep"), F.lit(1 << 31)) / F.lit(1 << 31)
    member = member.join(by_size, ["component", "n"]).select(
        "component", "rep", "n", "members", F.floor((F.col("before") + F.floor(spread * F.col("mass"))) / F.lit(TILE_SHINGLES)).cast("long").alias("tile")
    )
    member = materialise(member, "members")
    spans = member.groupBy("component", "tile").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    # Each tile is sent to the pairs in which sizes allow a link; tiles are far fewer than rows.
    other = spans.select("component", F.col("tile").alias("tile_b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"))
    pairs = spans.join(other, "component").where(
        (F.col("tile") <= F.col("tile_b")) & (F.col("low_b") * percent <= F.col("high") * 100) & (F.col("low") * percent <= F.col("high_b") * 100)
    ).select("component", F.col("tile").alias("tile_a"), "tile_b")
    pairs = materialise(pairs, "pairs")
    tasks = int(max(1, min(100_000, pairs.count() // TASK_PAIRS)))
    visits = pairs.select("component", "tile_a", "tile_b", F.explode(F.array_distinct(F.array("tile_a", "tile_b"))).alias("tile"), F.when(F.col("tile_a") == F.col("tile_b"), 1).otherwise(2).alias("tiles"))

    bits = spark.sparkContext.broadcast(bitmap(member, "rep", LOG2_BITS, mixed=False))
    sets = source.where("doc_id is not null").mapInArrow(lean(_sets_of(width, bits, LOG2_BITS)), "doc_id long, grams binary").withColumnRenamed("doc_id", "rep")
    sized = member.join(sets, "rep").where(F.octet_length("grams") == F.col("n") * 8)
    tiles = sized.join(visits, ["component", "tile"]).select("component", "tile_a", "tile_b", "tile", "tiles", "rep", "members", "grams")
    tiles = tiles.repartition(tasks, "component", "tile_a", "tile_b")
    links = materialise(tiles.groupBy("component", "tile_a", "tile_b").applyInPandas(lean_group(_tile(percent)), "rep long, links long, low long"), "links")
    degrees = links.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(links.select("rep", "low"), "rep", "low")

    found = (
        classes.join(degrees, "rep", "left")
        .join(joined.withColumnRenamed("node", "rep"), "rep", "left")
        .select(F.col("print").alias("p"), F.col("n").alias("m"), (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("similar"), F.coalesce("component", "rep").alias("lowest"))
    )
    named = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    out = rows.join(found, named & (F.col("print") == F.col("p")) & (F.col("n") == F.col("m")), "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("similar", F.lit(0)).cast("long").alias("n_similar"),
        F.coalesce("lowest", "doc_id").alias("component_id"),
    )
    discard(first, second, pairs)
    return out


def _running(group: str, order: str):
    from pyspark.sql import Window

    return Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
