"""SimHash of shingle sets at a Jaccard similarity well below one: a wide fingerprint, found by the segments of a ring.

Two sets of Jaccard similarity ``t`` have vectors with a cosine of at least ``2t / (1 + t)``, so each bit of their fingerprints differs with a probability of at most the
angle over pi: 0.15 at 0.8.  Of 64 bits that is a radius of a third, in which unlike texts fall too; of 1,024 it is one that no unlike pair comes near.

The fingerprint is cut into 64 segments of 16 bits on a ring.  Sets meet where a segment is equal (each one is with 0.8485^16 = 0.07 at 0.8, so 99 % meet at least once, and nearly all from 0.85 on); then the pigeonring
filter must hold from there: every chain of consecutive segments keeps within its share of the radius.  Then the whole Hamming distance is looked at.  The caller checks the similarity itself,
and finds by other bounds what has no segment in common.

The sets that share a segment stand in the order of the segments that follow, and each looks at the ``KEY_ROWS`` before it and takes the nearest that fits as its partner.  So a large group of near copies, or of texts
nearly that like, gives at most one pair for each member and segment, is linked along its likest members and never squared.  Sets that are known to be linked do not meet: the caller first asks in some of the segments
(``FIRST``), then in the others with the components so far, where the members of a large group no longer take each other's places and each set's partner is of another component.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import acos, ceil, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BITS, SEGMENT = 1024, 16
WORDS, SEGMENTS = BITS // 64, BITS // SEGMENT
#: Sets before it in a segment's order among which a set looks for its partner; partners that a set takes at most, one in each segment.
KEY_ROWS, PARTNERS = 64, SEGMENTS
#: Segments in which sets meet before components are known, and after: each segment's rows are shuffled once.
FIRST = range(0, SEGMENTS, 8)
LATER = [k for k in range(SEGMENTS) if k not in FIRST]
#: Deviations beyond the mean that the radius allows; what small sets may differ more, as their ties are no set bits.
DEVIATIONS, TIES = 6, 0.04
#: Hashes counted at a time: their sum fits a byte.
_SLICE = 255
_STEP, _MIX, _MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_OFFSETS = np.array([(k + 1) * _STEP % 2**64 for k in range(WORDS)], dtype=np.uint64)


def fingerprint_of(shingles: np.ndarray) -> np.ndarray:
    """The SimHash as longs: a bit is set where over half of the shingles' hashes (unsigned, each spread to 1,024 bits) have it; no shingles: 0."""
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(shingles), _SLICE):
        spread = shingles[start : start + _SLICE, None] + _OFFSETS
        spread = (spread ^ (spread >> np.uint64(30))) * np.uint64(_MIX)
        spread = (spread ^ (spread >> np.uint64(27))) * np.uint64(_MIX_2)
        spread ^= spread >> np.uint64(31)
        ones += np.unpackbits(spread.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(shingles), bitorder="little").view("<i8")


def radius(percent: int) -> int:
    """Most bits in which the fingerprints of sets of this similarity differ, but for one pair in many millions."""
    apart = acos(2 * percent / (100 + percent)) / pi
    return ceil(BITS * (apart + TIES) + DEVIATIONS * sqrt(BITS * apart * (1 - apart)))


def _keyed(nodes: DataFrame, segments: Sequence[int]) -> DataFrame:
    """(key, node, component, n, after): a row for each segment of a set among ``segments``; ``after`` holds the four segments that follow it on the ring."""
    own = np.array(segments)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ring = batch.column(3).flatten().to_numpy().view("<u2").reshape(-1, SEGMENTS).astype(np.uint64)
            keys = (np.arange(SEGMENTS, dtype=np.uint64) << np.uint64(SEGMENT)) | ring
            after = sum(np.roll(ring, -k, axis=1) << np.uint64(SEGMENT * (k - 1)) for k in range(1, 5))
            node, component, n = (np.repeat(batch.column(i).to_numpy(), len(own)) for i in range(3))
            columns = [keys[:, own].ravel().view(np.int64), node, component, n, after[:, own].ravel().view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "node", "component", "n", "after"])

    return nodes.select("node", "component", "n", "simhash").mapInArrow(work, "key bigint, node bigint, component bigint, n int, after bigint")


def _meets(row: Column, earlier: Column, percent: int) -> Column:
    """Components that differ and sizes that fit; and from the equal segment on, each chain of the following segments keeps within its share of the radius."""
    apart, share = row["after"].bitwiseXOR(earlier["after"]), radius(percent) / SEGMENTS
    fits = (row["component"] != earlier["component"]) & (F.least(row["n"], earlier["n"]) * 100 >= F.greatest(row["n"], earlier["n"]) * percent)
    for length in range(1, 5):
        part = apart.bitwiseAND(F.lit((1 << SEGMENT * length) - 1)) if length < 4 else apart
        fits = fits & (F.bit_count(part) <= int(share * (length + 1)))
    return fits


def candidates(nodes: DataFrame, percent: int, segments: Sequence[int] = range(SEGMENTS)) -> DataFrame:
    """Distinct pairs (a, b), a < b, of ``nodes`` (node, n shingles, simhash as an array of longs) that meet in one of the segments and keep the chains from there.

    Of the sets before it in a segment's order a set takes the nearest that fits.  Sets of one ``component`` (a further column, where something is known) do not meet.
    """
    if "component" not in nodes.columns:
        nodes = nodes.withColumn("component", F.col("node"))
    row = F.struct("node", "component", "n", "after")
    before = Window.partitionBy("key").orderBy("after", "node").rowsBetween(-KEY_ROWS, -1)
    sized = _keyed(nodes, segments).select(row.alias("row"), F.collect_list(row).over(before).alias("earlier"))
    fitting = F.filter("earlier", lambda e: _meets(F.col("row"), e, percent))["node"]  # the nearest is the last
    met = sized.select(F.col("row.node").alias("x"), F.try_element_at(fitting, F.lit(-1)).alias("y")).where("y is not null")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def within_radius(a: Column, b: Column, percent: int) -> Column:
    """The whole Hamming distance of two fingerprints."""
    apart = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(apart, F.lit(0), lambda total, d: total + d) <= radius(percent)
