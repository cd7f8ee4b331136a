"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups (rows with equal texts) stay whole.  Best fit takes items in decreasing order of size, so items of one size follow each other, and
the tightest bin that holds one of them stays the tightest until it is full for that size: a size is packed at once for all its groups, and
what is packed is the histogram of sizes, whatever the number of groups (sizes that differ sum to their square, so no more than
``sqrt(2 * bytes)`` of them exist).  Bins are found in a balanced tree of their room; the smallest capacity for which this needs no more than the
wanted shards is found by bisection, over classes of sizes where there are many, and the sizes themselves are packed into that.  Groups of one size are numbered, and the number tells the shard.

A group is never split: one that is larger than an even share has a shard of its own, which is then larger than the others.
"""

from __future__ import annotations

import math
import random
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chartloom.llm.shared import materialize, release, small_side

#: Groups above this part of an even share (``shards * GRAIN`` of them at most) meet their rows by a broadcast; no task gets more of one group's rows than that.
GRAIN = 128
ROW_OVERHEAD = 16
#: More sizes than this are bisected by classes, ``CLASS_STEPS`` to each doubling (sizes up to 2 ** 64 are fewer than 64 times as many classes).
EXACT_SIZES, CLASS_STEPS = 4096, 128
#: Rows that one numbering task may hold.
LANE_ROWS = 100_000


class RoomTree:
    """Balanced search tree (treap) of (room, bin): insert, remove, least room of at least a size; O(log n) each."""

    def __init__(self) -> None:
        self._root = None
        self._random = random.Random(0)

    def _merge(self, left, right):
        if left is None or right is None:
            return left or right
        if left[1] > right[1]:
            left[3] = self._merge(left[3], right)
            return left
        right[2] = self._merge(left, right[2])
        return right

    def _split(self, node, key):
        """Nodes below ``key``, nodes from ``key`` on."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            node[3] = low
            return node, high
        low, high = self._split(node[2], key)
        node[2] = high
        return low, node

    def insert(self, room: int, which: int) -> None:
        low, high = self._split(self._root, (room, which))
        self._root = self._merge(self._merge(low, [(room, which), self._random.random(), None, None]), high)

    def remove(self, room: int, which: int) -> None:
        low, rest = self._split(self._root, (room, which))
        _, high = self._split(rest, (room, which + 1))
        self._root = self._merge(low, high)

    def tightest(self, size: int):
        node, best = self._root, None
        while node is not None:
            if node[0][0] >= size:
                best, node = node[0], node[2]
            else:
                node = node[3]
        return best


#: (size, bin, number): so many of the items of a size, in their order, go into the bin.
Placed = list[tuple[int, int, int]]


def best_fit_decreasing(histogram: list[tuple[int, int]], capacity: int, most: int | None = None) -> Placed | None:
    """Places the items of ``histogram`` (size, number), sizes decreasing; bins are numbered as they open.

    None if an item is too large or over ``most`` bins are needed.
    """
    tree, bins, placed = RoomTree(), 0, []
    for size, number in histogram:
        while number:
            found = tree.tightest(size)
            if found is None:
                if size > capacity or bins == most:
                    return None
                found, bins = (capacity, bins), bins + 1
            else:
                tree.remove(*found)
            fits = min(number, found[0] // size)
            placed.append((size, found[1], fits))
            number -= fits
            tree.insert(found[0] - fits * size, found[1])
    return placed


def _classes(histogram: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """``histogram`` with the sizes of a class taken as their mean."""
    if len(histogram) <= EXACT_SIZES:
        return histogram
    total, count = Counter(), Counter()
    for size, number in histogram:
        which = int(CLASS_STEPS * math.log2(size))
        total[which] += size * number
        count[which] += number
    return [(-(-total[c] // count[c]), count[c]) for c in sorted(count, reverse=True)]


def pack(histogram: list[tuple[int, int]], shards: int) -> Placed:
    """Best-fit-decreasing with the smallest capacity, to 0.1 %, that needs at most ``shards`` bins; sizes decrease.

    An item that is larger than an even share gets a bin of its own, so that the others still share the rest evenly.
    """
    placed, alone, left = [], 0, sum(size * number for size, number in histogram)
    rest = [list(x) for x in histogram]
    at = 0
    while at < len(rest) and alone < shards - 1 and rest[at][0] * (shards - alone) > left:
        placed.append((rest[at][0], alone, 1))
        left -= rest[at][0]
        alone += 1
        rest[at][1] -= 1
        at += rest[at][1] == 0
    rest, bins = [(s, n) for s, n in rest[at:] if n], shards - alone
    if not rest:
        return placed
    tried = _classes(rest)
    low = high = max(rest[0][0], -(-left // bins))
    while best_fit_decreasing(tried, high, bins) is None:
        low, high = high, high + max(1, high // 64)
    while high - low > max(1, low // 1000):
        middle = (low + high) // 2
        low, high = (low, middle) if best_fit_decreasing(tried, middle, bins) is not None else (middle, high)
    while (best := best_fit_decreasing(rest, high, bins)) is None:  # sizes may need a little more than the means of their classes
        high += max(1, high // 1000)
    return placed + [(size, alone + which, number) for size, which, number in best]


def _packed(histogram: DataFrame, shards: int) -> DataFrame:
    """histogram(bytes, n) to ``bytes, shard, first, stop``: the numbers of the groups of a size that go into a shard."""

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("bytes", ascending=False)
        placed = pd.DataFrame(pack(list(zip(frame["bytes"].tolist(), frame["n"].tolist())), shards), columns=["bytes", "shard", "number"])
        stop = placed.groupby("bytes")["number"].cumsum()
        return pd.DataFrame({"bytes": placed["bytes"], "shard": placed["shard"].astype("int32"), "first": stop - placed["number"], "stop": stop})

    return histogram.groupBy().applyInPandas(place, "bytes bigint, shard int, first bigint, stop bigint")


def _numbered(rows: DataFrame, n_rows: int, within: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with a number from 0 without gaps among those with one ``within``: by a hash of ``order``, then by ``order``.

    Rows are dealt into lanes by that hash, so no task numbers more than a lane.
    """
    lanes = max(16, math.ceil(n_rows / LANE_ROWS))
    laned = rows.withColumn("lane", F.pmod(F.xxhash64(*order, F.lit("lane")), F.lit(lanes)).cast("int"))
    counts = laned.groupBy(within, "lane").agg(F.count("*").alias("rows_"))
    earlier = Window.partitionBy(within).orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(counts.select(within, "lane", F.coalesce(F.sum("rows_").over(earlier), F.lit(0)).alias("offset")), "shard-lanes")
    number = F.row_number().over(Window.partitionBy(within, "lane").orderBy(*order))
    return laned.withColumn("n_", number).join(small_side(offsets, offsets.count()), [within, "lane"]).withColumn(name, F.col("offset") + F.col("n_") - 1).drop("lane", "offset", "n_")


def assign_shards(docs: DataFrame, shards: int = 40, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for every row; shards of near equal bytes.

    Size: UTF-8 bytes of the text, however long (null: none), plus 16.  Null and empty texts are one group (no bytes; CRC 0).  Groups of one size are
    told apart by their text's SHA-256.  ``slot`` numbers a shard's rows from 0 without gaps, by an id hash and then by id; repeated rows and rows without an id take
    slots of their own.  A group stays whole whatever its size; one above an even share makes its shard larger than the others, which share the rest evenly.  An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    text = F.coalesce(docs[text_column], F.lit(""))
    narrow = docs.select(
        docs[id_column].alias("doc_id"),
        (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("group_key"),
    )
    narrow = materialize(narrow, "shard-rows")
    totals = narrow.agg(F.sum("size"), F.count("*")).first()
    total, rows = int(totals[0] or 0), int(totals[1])
    groups = materialize(narrow.groupBy("group_key").agg(F.sum("size").alias("bytes")), "shard-groups")
    placed = materialize(_packed(groups.groupBy("bytes").agg(F.count("*").alias("n")), shards), "shard-sizes")
    sides = small_side(placed, placed.count())
    numbered = _numbered(groups, groups.count(), "bytes", ["group_key"], "nth")
    sharded = numbered.join(sides, "bytes").where((F.col("nth") >= F.col("first")) & (F.col("nth") < F.col("stop")))
    sharded = materialize(sharded.select("group_key", "shard", (F.col("bytes") > total // (shards * GRAIN)).alias("large")), "shard-of-groups")
    large = F.broadcast(sharded.where("large").select("group_key", F.col("shard").alias("large_shard")))
    met = narrow.join(large, "group_key", "left")
    rest = met.where("large_shard is null").drop("large_shard").join(sharded.select("group_key", "shard").hint("merge"), "group_key")
    columns = ["doc_id", "size", "text_crc32", "shard"]
    found = met.where("large_shard is not null").withColumnRenamed("large_shard", "shard").select(columns).unionByName(rest.select(columns))
    found = materialize(found, "shard-placed")
    release(narrow, groups, placed, sharded)
    return _numbered(found, rows, "shard", ["doc_id", "text_crc32"], "slot").select("doc_id", "size", "text_crc32", "shard", "slot")
