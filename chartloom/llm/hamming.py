"""Exact top-k search among binary codes by incremental multi-index hashing.

A 64-bit code is cut into segments, and an index holds, for each segment, the rows by segment value.  A query looks up
segment values at growing distance: radius 0 in every segment, then radius 1, and so on.  After radius ``r`` in the
first ``j`` of ``m`` segments and ``r - 1`` in the others, every row at distance ``m * r + j - 1`` or less has been seen
(each segment not yet looked up at ``r`` differs in ``r`` bits or more).  A query ends when its kth verified distance is within that.

Rows and queries are dealt into blocks of bounded size; each pair of blocks is searched on its own, and the pairs' top k are merged.
Of rows with one code only the ``k`` smallest ids can be among the answers, so a very common code is ``k`` rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chartloom.llm.shared import materialize

BITS = 64
#: Most rows and queries of a block; lookups made, and rows that they find looked at, at a time.
BLOCK_ROWS, BLOCK_QUERIES, LOOKUPS, HITS = 1 << 20, 1 << 16, 1 << 21, 1 << 20


def sign_code(vector: Column) -> Column:
    """Bit i is set where component i of the vector is above zero; null for a null vector, an error for one of more than 64 components."""
    vector = F.when(F.size(vector) > BITS, F.raise_error(F.lit(f"a sign code has {BITS} bits at most"))).otherwise(vector)
    bits = F.transform(F.slice(vector, 1, BITS), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda code, bit: code.bitwiseOR(bit))


class _Index:
    """Rows of one block by the value of each segment."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        width = min(16, max(8, int(np.log2(max(2, len(codes))))))
        m = round(BITS / width)
        cuts = [round(i * BITS / m) for i in range(m + 1)]
        self.segments = list(zip(cuts, [b - a for a, b in zip(cuts, cuts[1:])]))
        self.by, self.starts = [], []
        for at, width in self.segments:
            value = self.values(codes, at, width)
            self.by.append(np.argsort(value, kind="stable"))
            self.starts.append(np.r_[0, np.cumsum(np.bincount(value, minlength=1 << width))])

    @staticmethod
    def values(codes: np.ndarray, at: int, width: int) -> np.ndarray:
        return ((codes >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64)

    def first_found(self, difference: np.ndarray, radius: int, segment: int) -> np.ndarray:
        """Whether a lookup at this radius in this segment is the first that meets rows with these differing bits."""
        first = np.ones(len(difference), dtype=bool)
        for j, (at, width) in enumerate(self.segments):
            apart = np.bitwise_count(self.values(difference, at, width))
            first &= apart > radius if j < segment else apart >= radius
        return first


def _masks(width: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in chosen) for chosen in combinations(range(width), radius)], dtype=np.int64)


def search(codes: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, distance) of each query's k nearest rows, ties by id."""
    index, q = _Index(codes), len(queries)
    best_q, best_row, best_d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    kth = np.full(q, BITS + 1)
    active = np.arange(q)
    m = len(index.segments)

    def pruned() -> None:
        """Keeps the k nearest of what was found so far, and the kth distances."""
        nonlocal best_q, best_row, best_d
        order = np.lexsort((ids[best_row], best_d, best_q))
        best_q, best_row, best_d = best_q[order], best_row[order], best_d[order]
        new = np.flatnonzero(np.r_[True, best_q[1:] != best_q[:-1]]) if len(best_q) else np.zeros(0, np.int64)
        rank = np.arange(len(best_q)) - np.repeat(new, np.diff(np.r_[new, len(best_q)]))
        full = rank == k - 1
        kth[best_q[full]] = best_d[full]
        keep = rank < k
        best_q, best_row, best_d = best_q[keep], best_row[keep], best_d[keep]

    for radius in range(BITS + 1):
        for j, (at, width) in enumerate(index.segments):
            if not len(active) or radius > width:
                continue
            masks = _masks(width, radius)
            step = max(1, LOOKUPS // len(masks))
            for part in range(0, len(active), step):
                some = active[part : part + step]
                looked = (index.values(queries[some], at, width)[:, None] ^ masks[None, :]).ravel()
                counts = index.starts[j][looked + 1] - index.starts[j][looked]
                met = np.flatnonzero(counts)
                asking, looked, counts = np.repeat(some, len(masks))[met], looked[met], counts[met]
                all_ends = np.cumsum(counts)
                start = 0
                while start < len(counts):  # slices by the number of rows found; a value that many rows share is a slice of its own
                    stop = max(start + 1, int(np.searchsorted(all_ends, (all_ends[start - 1] if start else 0) + HITS, side="right")))
                    count = counts[start:stop]
                    which, begin, ends = np.repeat(asking[start:stop], count), index.starts[j][looked[start:stop]], np.cumsum(count)
                    row = index.by[j][np.arange(int(ends[-1])) + np.repeat(begin - (ends - count), count)]
                    difference = index.codes[row] ^ queries[which]
                    distance = np.bitwise_count(difference).astype(np.int64)
                    near = (distance <= kth[which]) & index.first_found(difference, radius, j)
                    best_q, best_row, best_d = np.r_[best_q, which[near]], np.r_[best_row, row[near]], np.r_[best_d, distance[near]]
                    if len(best_q) > HITS + k * q:
                        pruned()
                    start = stop
            pruned()
            active = active[kth[active] > m * radius + j]
    return best_q, ids[best_row], best_d


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``rows(id, code)`` and ``queries(query_id, code)`` to ``query_id, rank, id, distance``: the k nearest rows, ties by id.

    A row that is itself a query is among its own answers.  Rows and queries with a null id or code are left out.  With fewer
    than k rows, all are returned.  Repeated rows count once, repeated queries are answered each.  An empty table of either kind gives an empty result; other columns are ignored, whatever their
    names.  Memory is bounded whatever the codes: rows that lookups find are looked at ``HITS`` at a time.
    """
    rows, queries = rows.select("id", "code"), queries.select("query_id", "code")
    by_code = Window.partitionBy("code").orderBy("id")
    rows = rows.where("id is not null and code is not null").dropDuplicates(["id", "code"]).withColumn("_n", F.row_number().over(by_code)).where(F.col("_n") <= k).drop("_n")
    rows = materialize(rows, "hamming-rows")
    queries = queries.where("query_id is not null and code is not null")
    codes = materialize(queries.select("code").distinct(), "hamming-queries")
    n, q = rows.count(), codes.count()
    row_blocks = max(-(-n // BLOCK_ROWS), min(4, -(-n // 1024)), 1)
    query_blocks = max(-(-q // BLOCK_QUERIES), min(4, -(-q // 64)), 1)
    left = rows.withColumn("rb", F.pmod(F.xxhash64("id"), F.lit(row_blocks)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = codes.withColumn("qb", F.pmod(F.xxhash64("code"), F.lit(query_blocks)).cast("int")).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))

    def pair(data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        wanted = asked["code"].to_numpy(np.int64)
        found = search(data["code"].to_numpy(np.int64).view(np.uint64), data["id"].to_numpy(np.int64), wanted.view(np.uint64), k)
        return pd.DataFrame({"code": wanted[found[0]], "id": found[1], "distance": found[2].astype(np.int32)})

    near = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInPandas(pair, "code bigint, id bigint, distance int")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("code").orderBy("distance", "id"))).where(F.col("rank") <= k)
    return queries.join(ranked, "code").select("query_id", "rank", "id", "distance")
