"""Prefix trie of conversations, in succinct level-order form.

No text is shuffled: a turn is a label (120 bits of a SHA-256 of role and text) and a length, and a sequence of turns is a pair of polynomial hashes of its labels
modulo 2**61 - 1, which can be summed up from either side of a cut.  So turns are numbered and hashed in a sort by conversation and turn that cuts a long conversation
wherever a partition ends; what precedes a cut is added later, from three rows a partition at most.

A node weighs the turns in its subtree.  The topmost nodes of at most ``SHARD_TURNS`` are the roots of prefix shards: all turns below one meet in one task, in which numpy
lays its trie out level by level as LOUDS bits and labels and rolls counts up in reverse level order.  The heavy nodes above them, among them the top of any trie with more turns, merge
apart: their members are counted by aggregation, and what shards and heavy nodes have to add is summed along one path for each, in pieces of ``PATH_PIECE`` levels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chartloom.llm.shared import materialize, release, small_side

#: Turns below the root of a shard at most; turns that a task lays out at a time; levels of a heavy path that are summed in one window.
SHARD_TURNS, FLUSH_TURNS, PATH_PIECE = 50_000, 200_000, 4096
#: Conversations that share one origin, and the most turns that they take from it.
BLOCK, MOST_SHARED = 100, 5
PRIME = (1 << 61) - 1
BASES = tuple(int(hashlib.sha256(f"conversation prefix {i}".encode()).hexdigest()[:15], 16) for i in range(2))
_LOW31, _LOW30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)


# -- hashes modulo PRIME ---------------------------------------------------------------------


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))
    return np.where(x >= PRIME, x - np.uint64(PRIME), x)


def multiplied(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, both below it, by 31-bit halves."""
    a, b = np.asarray(a, np.uint64), np.asarray(b, np.uint64)
    a1, a0, b1, b0 = a >> np.uint64(31), a & _LOW31, b >> np.uint64(31), b & _LOW31
    middle = a0 * b1 + a1 * b0
    return _reduced(_reduced(a1 * b1 * np.uint64(2) + (middle >> np.uint64(30))) + _reduced((middle & _LOW30) << np.uint64(31)) + _reduced(a0 * b0))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo PRIME, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) <= n:
        out = np.concatenate([out, multiplied(out, np.uint64(pow(base, len(out), PRIME)))])
    return out[: n + 1]


def running(x: np.ndarray) -> np.ndarray:
    """Running sums modulo PRIME."""
    low, high = np.cumsum(x & _LOW31, dtype=np.uint64), np.cumsum(x >> np.uint64(31), dtype=np.uint64)
    return _reduced(multiplied(_reduced(high), np.uint64(1 << 31)) + _reduced(low))


_NUMBERED = "conv_id bigint, part int, n bigint, s1 bigint, s2 bigint, before1 bigint, before2 bigint, chars bigint, is_last boolean"


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv_id, a, b, chars) with their number within conversation and partition, and the hashes of the turns up to and before each.

    ``is_last`` marks a conversation's last row in the partition; one row is held back, as what follows a batch decides it.
    """
    part, held, conv, count, sums = TaskContext.get().partitionId(), None, None, 0, [0, 0]
    names = [c.split()[0] for c in _NUMBERED.split(", ")]
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        if held is not None:
            held["is_last"][:] = ids[0] != conv
            yield pa.RecordBatch.from_pydict(held)
        carried = count if conv is not None and ids[0] == conv else 0
        which = np.cumsum(np.isin(np.arange(len(ids)), starts)) - 1
        within = np.arange(len(ids)) - starts[which] + 1
        out = {"conv_id": ids, "part": np.full(len(ids), part, np.int32), "n": within + np.where(which == 0, carried, 0)}
        for k, (label, base) in enumerate(zip((1, 2), BASES)):
            terms = multiplied(batch.column(label).to_numpy(zero_copy_only=False).astype(np.uint64), powers(base, int(within.max()))[within])
            total = np.r_[np.zeros(1, np.uint64), running(terms)]
            shift = total[starts][which]
            upto, before = (_reduced(total[i : i + len(ids)] + np.uint64(PRIME) - shift) for i in (1, 0))
            if carried:
                first, factor = which == 0, np.uint64(pow(base, carried, PRIME))
                for side in (upto, before):
                    side[first] = _reduced(multiplied(side[first], factor) + np.uint64(sums[k]))
            sums[k] = int(upto[-1])
            out[f"s{k + 1}"], out[f"before{k + 1}"] = upto.astype(np.int64), before.astype(np.int64)
        conv, count = ids[-1], int(out["n"][-1])
        out["chars"], out["is_last"] = batch.column(3).to_numpy(zero_copy_only=False), np.r_[ids[1:] != ids[:-1], True]
        held = {c: out[c][-1:].copy() for c in names}
        if len(ids) > 1:
            yield pa.RecordBatch.from_pydict({c: out[c][:-1] for c in names})
    if held is not None:
        yield pa.RecordBatch.from_pydict(held)


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, n (from 1), s1, s2, before1, before2, chars of every turn of a conversation with an id."""
    role, said = (F.coalesce(conversations[c], F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, said).cast("binary"), 256)
    label = lambda i: F.conv(F.substring(digest, 15 * i + 1, 15), 16, 10).cast("long")
    rows = conversations.select(conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].alias("turn"), role.alias("role"), label(0).alias("a"), label(1).alias("b"), F.length(said).cast("long").alias("chars"))
    order = ["conv_id", "turn", "role", "a", "b"]  # nulls first
    dealt = rows.where("conv_id is not null").repartitionByRange(*order).sortWithinPartitions(*order)
    found = materialize(dealt.select("conv_id", "a", "b", "chars").mapInArrow(_numbered, _NUMBERED), "trie-numbered")
    # a conversation in several partitions is the last of one and the first of another: these are three rows a partition at most
    lasts = found.where("is_last").select("conv_id", "part", "n", "s1", "s2")
    spread = lasts.groupBy("conv_id").agg(F.count("*").alias("parts"), F.array_sort(F.collect_list(F.struct("part", "n", "s1", "s2"))).alias("each")).where("parts > 1")
    offsets = []
    for row in spread.select("conv_id", "each").collect():
        before, sums = 0, [0, 0]
        for part, n, *own in row["each"]:
            offsets.append((row["conv_id"], part, before, *sums, *(pow(b, before, PRIME) for b in BASES)))
            sums = [(s + o * pow(b, before, PRIME)) % PRIME for s, o, b in zip(sums, own, BASES)]
            before += n
    sides = found.sparkSession.createDataFrame(offsets, "conv_id bigint, part int, earlier bigint, e1 bigint, e2 bigint, f1 bigint, f2 bigint")
    joined = found.join(F.broadcast(sides), ["conv_id", "part"], "left")
    whole = lambda c, k: F.when(F.col("earlier") > 0, _sum(F.col(f"e{k}"), _product(F.col(c), F.col(f"f{k}")))).otherwise(F.col(c)).alias(c)
    return joined.select("conv_id", (F.col("n") + F.coalesce("earlier", F.lit(0))).alias("n"), whole("s1", 1), whole("s2", 2), whole("before1", 1), whole("before2", 2), "chars")


def _product(a: Column, b: Column) -> Column:
    whole = lambda c: c.cast("decimal(19,0)")  # noqa: E731  a product of two numbers below 2**61 has 37 digits
    return (whole(a) * whole(b) % F.lit(PRIME).cast("decimal(38,0)")).cast("long")


def _sum(a: Column, b: Column) -> Column:
    return (a + b) % F.lit(PRIME)


# -- rebuilt conversations -----------------------------------------------------------------------


def _rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, depth, k1, k2 (the node), p1, p2 (its parent), chars, length: one row per rebuilt conversation and prefix, the empty one too."""
    head = lambda i: F.max(F.when(F.col("n") == i, F.struct("s1", "s2", "before1", "before2", "chars"))).alias(f"h{i}")
    heads = turns.groupBy("conv_id").agg(F.max("n").alias("own"), *map(head, range(1, MOST_SHARED + 1)))
    heads = materialize(heads.select("conv_id", "own", F.array(*(f"h{i}" for i in range(1, MOST_SHARED + 1))).alias("heads")), "trie-heads")
    share = F.crc32(F.col("conv_id").cast("string").cast("binary")) % F.lit(MOST_SHARED + 1)
    origin = heads.select(F.col("conv_id").alias("origin_id"), F.col("own").alias("origin_own"), F.col("heads").alias("shared"))
    plans = heads.withColumn("h", share.cast("long")).withColumn("origin_id", F.col("conv_id") - F.col("conv_id") % BLOCK).join(origin, "origin_id", "left")
    plans = plans.withColumn("taken", F.least("h", F.coalesce("origin_own", F.lit(0))))
    at = lambda array, i, k: F.when(i > 0, F.try_element_at(array, i.cast("int"))[f"s{k}"]).otherwise(F.lit(0)).cast("long")
    dropped = F.least("h", "own")
    plans = plans.select("conv_id", "h", "taken", "shared", (F.col("taken") + F.col("own") - dropped).alias("length"), *(at(F.col("shared"), F.col("taken"), k).alias(f"t{k}") for k in (1, 2)), *(at(F.col("heads"), dropped, k).alias(f"d{k}") for k in (1, 2)))
    plans = materialize(plans, "trie-plans")
    zero = F.lit(0).cast("long")
    top = plans.select("conv_id", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), zero.alias("chars"), "length")
    taken = plans.where("taken > 0").select("conv_id", "length", F.posexplode(F.slice("shared", F.lit(1), F.col("taken").cast("int"))).alias("i", "x"))
    taken = taken.select("conv_id", (F.col("i") + 1).cast("long").alias("depth"), F.col("x.s1").alias("k1"), F.col("x.s2").alias("k2"), F.col("x.before1").alias("p1"), F.col("x.before2").alias("p2"), F.col("x.chars").alias("chars"), "length")
    # an own turn moves from n to n - h + taken: its hash loses what is dropped, is shifted, and gains what is taken
    missing = F.col("h") - F.col("taken")

    def moved(c: str, k: int) -> Column:
        kept = _sum(F.col(c) - F.col(f"d{k}"), F.lit(PRIME))
        shift = F.coalesce(*(F.when(missing == i, F.lit(pow(pow(BASES[k - 1], i, PRIME), -1, PRIME))) for i in range(1, MOST_SHARED + 1)))
        return _sum(F.col(f"t{k}"), F.when(missing == 0, kept).otherwise(_product(kept, shift)))

    own = turns.join(plans.drop("shared"), "conv_id").where("n > h")
    own = own.select("conv_id", (F.col("n") - missing).alias("depth"), moved("s1", 1).alias("k1"), moved("s2", 2).alias("k2"), moved("before1", 1).alias("p1"), moved("before2", 2).alias("p2"), "chars", "length")
    rows = materialize(reduce(DataFrame.unionByName, [top, taken, own]), "trie-rows")
    release(heads, plans)
    return rows


# -- shards ----------------------------------------------------------------------------------

NODE = ["depth", "k1", "k2"]
_NODES = "depth bigint, k1 bigint, k2 bigint, p1 bigint, p2 bigint, is_top boolean, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
NO_ENDS = hashlib.sha256(b"").hexdigest()


class Louds:
    """A forest in level order: unary degrees of a super-root and all nodes (``bits``), and the labels of the nodes."""

    def __init__(self, degrees: np.ndarray, labels: np.ndarray) -> None:
        self.labels = labels
        self.bits = np.ones(int(degrees.sum()) + len(degrees), dtype=bool)
        self.bits[np.cumsum(degrees + 1) - 1] = False

    def parents(self) -> np.ndarray:
        """Of each node, -1 for those below the super-root: the zeros before a node's one are the nodes whose degrees are over."""
        return np.cumsum(~self.bits)[self.bits] - 1

    def degrees(self) -> np.ndarray:
        return np.diff(np.flatnonzero(~self.bits))[0:] - 1


def laid_out(rows: dict[str, np.ndarray]) -> tuple[Louds, np.ndarray, np.ndarray]:
    """(trie, level of each node, node of each row) of rows with level, conv_id, k1, k2: one row per conversation and level."""
    level, k1, k2 = rows["level"], rows["k1"], rows["k2"]
    order = np.lexsort((k2, k1, level))
    fresh = np.r_[True, (level[order][1:] != level[order][:-1]) | (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])]
    node = np.empty(len(order), np.int64)
    node[order] = np.cumsum(fresh) - 1
    first = order[fresh]
    levels = level[first]
    walk = np.lexsort((level, rows["conv_id"]))
    deeper = level[walk][1:] > 0
    above = np.full(len(first), -1)
    above[node[walk[1:]][deeper]] = node[walk[:-1]][deeper]
    # nodes are numbered by level already; within a level they follow their parents
    rank, bounds = np.empty(len(first), np.int64), np.searchsorted(levels, np.arange(int(levels.max()) + 2))
    for start, stop in zip(bounds[:-1], bounds[1:]):
        own = np.arange(start, stop)
        rank[own[np.lexsort((own, rank[above[own]] if start else own * 0))]] = own
    labels = np.empty((len(first), 2), np.int64)
    labels[rank] = np.column_stack((k1[first], k2[first]))
    parent = np.full(len(first), -1)
    parent[rank] = np.where(above >= 0, rank[above], -1)
    return Louds(np.bincount(parent + 1, minlength=len(first) + 1), labels), levels, rank[node]


def _shard_nodes(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Nodes of whole shards, rolled up."""
    rows["level"] = rows["depth"] - rows["r0"]
    trie, levels, node = laid_out(rows)
    parents, degrees = trie.parents(), trie.degrees()
    n = len(levels)
    ends = rows["depth"] == rows["length"]
    convs, least, leaves, saved, chars = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), (degrees == 0).astype(np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    depth, p1, p2 = (np.empty(n, np.int64) for _ in range(3))
    for target, name in ((chars, "chars"), (depth, "depth"), (p1, "p1"), (p2, "p2")):
        target[node] = rows[name]
    np.add.at(convs, node[ends], 1)
    np.minimum.at(least, node[ends], rows["conv_id"][ends])
    bounds = np.searchsorted(levels, np.arange(int(levels.max()) + 2))
    for start, stop in zip(bounds[-2::-1], bounds[:0:-1]):  # from the deepest level up
        saved[start:stop] += (convs[start:stop] - 1) * chars[start:stop]
        if start:
            up = parents[start:stop]
            np.minimum.at(least, up, least[start:stop])
            for values in (convs, leaves, saved):
                np.add.at(values, up, values[start:stop])
    digests = [NO_ENDS] * n
    at, ids = node[ends], rows["conv_id"][ends]
    order = np.lexsort((ids, at))
    at, ids = at[order], ids[order].astype(str)
    cuts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
    for start, stop in zip(cuts, np.r_[cuts[1:], len(at)]):
        digests[at[start]] = hashlib.sha256(",".join(ids[start:stop]).encode()).hexdigest()
    top = parents < 0
    top_parent = depth == 0
    columns = [
        depth, trie.labels[:, 0], trie.labels[:, 1], pa.array(p1, mask=top_parent), pa.array(p2, mask=top_parent), top, least, pa.array(least[parents], mask=top), convs, degrees, leaves, saved, pa.array(digests)
    ]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [c.split()[0] for c in _NODES.split(", ")])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lays out rows that are sorted by shard (r0, r1, r2), several shards at a time; one that may go on is kept back."""
    kept: dict[str, np.ndarray] = {}
    for batch in batches:
        fresh = {c: batch.column(i).fill_null(0).to_numpy(zero_copy_only=False) if c in ("p1", "p2") else batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(batch.schema.names)}
        kept = {c: np.concatenate([kept[c], v]) for c, v in fresh.items()} if kept else fresh
        if len(kept["r0"]) < FLUSH_TURNS:
            continue
        goes_on = np.logical_and.reduce([kept[c] == kept[c][-1] for c in ("r0", "r1", "r2")])
        cut = len(goes_on) - int(goes_on[::-1].argmin()) if not goes_on.all() else 0
        if cut:
            yield _shard_nodes({c: v[:cut] for c, v in kept.items()})
            kept = {c: v[cut:] for c, v in kept.items()}
    if kept and len(kept["r0"]):
        yield _shard_nodes(kept)


_ENDS = "depth bigint, k1 bigint, k2 bigint, ends_sha256 string"


def _end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of rows sorted by node and conv_id.  A SHA-256 reads its text in order, so one task reads a node's ids, but it holds a batch of them only."""
    done, now, digest = [], None, None
    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        starts = np.flatnonzero(np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns[:3]])]) if batch.num_rows else []
        for start, stop in zip(starts, [*starts[1:], batch.num_rows]):
            key = tuple(int(c[start]) for c in columns[:3])
            text = ",".join(map(str, columns[3][start:stop].tolist())).encode()
            if key == now:
                digest.update(b"," + text)
                continue
            if now is not None:
                done.append((*now, digest.hexdigest()))
            now, digest = key, hashlib.sha256(text)
        if len(done) >= 1 << 14:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], [*NODE, "ends_sha256"])
            done = []
    if now is not None:
        done.append((*now, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], [*NODE, "ends_sha256"])


# -- heavy upper levels -------------------------------------------------------------------------


def _rolled_up(rows: DataFrame, heavy: DataFrame, tops: DataFrame, n_heavy: int) -> DataFrame:
    """The heavy nodes with their children, leaves and savings.

    Every heavy node and every shard hands what it has to its smallest member's path, where it is summed from below; a path's sums are then summed by node.
    """
    under = lambda df: df.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    children = under(heavy).unionByName(under(tops)).groupBy(*NODE).agg(F.count("*").alias("n_children"))
    whole = materialize(heavy.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-heavy")
    own = whole.select("conv_id", "depth", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    handed = tops.where("depth > 0").select("conv_id", (F.col("depth") - 1).alias("depth"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    given = own.unionByName(handed).groupBy("conv_id", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    given = materialize(given, "trie-given")
    paths = rows.join(small_side(heavy.select(*NODE), n_heavy), NODE, "left_semi").select("conv_id", *NODE).join(given.select("conv_id").distinct(), "conv_id", "left_semi")
    placed = materialize(paths.join(given, ["conv_id", "depth"], "left").fillna(0, ["leaves", "saved"]).withColumn("piece", F.expr(f"depth div {PATH_PIECE}")), "trie-paths")
    below = Window.partitionBy("conv_id", "piece").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = Window.partitionBy("conv_id").orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, -1)
    pieces = placed.groupBy("conv_id", "piece").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    pieces = pieces.select("conv_id", "piece", F.coalesce(F.sum("l").over(later), F.lit(0)).alias("l"), F.coalesce(F.sum("s").over(later), F.lit(0)).alias("s"))
    summed = placed.select("conv_id", *NODE, "piece", F.sum("leaves").over(below).alias("leaves"), F.sum("saved").over(below).alias("saved")).join(pieces, ["conv_id", "piece"])
    totals = summed.groupBy(*NODE).agg(F.sum(F.col("leaves") + F.col("l")).alias("n_leaves"), F.sum(F.col("saved") + F.col("s")).alias("saved_tokens"))
    return materialize(whole.join(totals, NODE), "trie-upper")


def prefix_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    conversations(conv_id, turn, role, text); every conversation c is rebuilt as the first h turns of conversation ``c - c % 100`` (as many as it has) and its own turns after the
    first h, h = crc32(c) % 6.  A node is named by its smallest member and its depth.  Null roles and texts are empty; turns are ordered by turn (null first), ties by role and then by
    a digest of role and text, and repeated rows are turns of their own; rows without a conv_id belong to no conversation.  Texts and conversations may be of any length.  An empty table gives an
    empty trie, without a root; other columns are ignored, whatever their names.  Exact up to collisions of 120 bits.
    """
    turns = _turns(conversations)
    rows = _rebuilt(turns)
    weighed = rows.groupBy(*NODE).agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("chars").alias("chars"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.sum(F.col("length") - F.col("depth") + 1).alias("turns")
    )
    heavy = materialize(weighed.where(F.col("turns") > shard_turns).drop("turns"), "trie-weighed")
    n_heavy = heavy.count()
    flagged = rows.join(small_side(heavy.select(*NODE, F.lit(True).alias("is_heavy")), n_heavy), NODE, "left")
    light = flagged.where("is_heavy is null").drop("is_heavy")
    roots = light.groupBy("conv_id").agg(F.min(F.struct("depth", "k1", "k2")).alias("r")).select("conv_id", F.col("r.depth").alias("r0"), F.col("r.k1").alias("r1"), F.col("r.k2").alias("r2"))
    sharded = light.join(roots, "conv_id").repartition("r0", "r1", "r2").sortWithinPartitions("r0", "r1", "r2")
    nodes = materialize(sharded.mapInArrow(_shards, _NODES), "trie-nodes")
    shown = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    if not n_heavy:
        release(rows)
        return nodes.select(*shown)
    tops = nodes.where("is_top")
    upper = _rolled_up(rows, heavy, tops, n_heavy)
    ended = rows.where("depth = length").join(small_side(heavy.select(*NODE), n_heavy), NODE, "left_semi").select(*NODE, "conv_id")
    digests = ended.repartition(*NODE).sortWithinPartitions(*NODE, "conv_id").mapInArrow(_end_digests, _ENDS)
    upper = upper.join(digests, NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
    names = heavy.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    named = lambda df: df.join(small_side(names, n_heavy), ["depth", "p1", "p2"], "left").select(*shown)
    return nodes.where("not is_top").select(*shown).unionByName(named(tops.drop("parent_conv_id"))).unionByName(named(upper))
