"""SimHash near-duplicate detection with pigeonring candidate filtering.

A fingerprint is 64 bits.  Two fingerprints with at most three differing bits, cut into four
16-bit segments on a ring, have a segment from which every chain of ``l`` consecutive segments
differs in at most ``3 * l / 4`` bits: none in the first, one in the first two, two in the first
three (the pigeonring principle).  The join keys hold the first segment and, as at most one bit of
the second may differ, three of its four nibbles: 28 bits.  A pair that shares a key passes the
chain budgets before its whole Hamming distance is looked at.

Only distinct fingerprints are joined, so a group of exact copies is one row.  A key that more than
``KEY_ROWS`` fingerprints share is refined by a further quarter of the bits that it leaves open (at
most three of them differ, so one quarter is equal); refinement ends where 11 bits are left, so no
key ever pairs more than 2,048 fingerprints, whatever the data.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from chartloom.llm.components import connected_components
from chartloom.llm.shared import materialize
from chartloom.llm.similar import similar_components

BITS, SEGMENT, MAX_DISTANCE, SEED = 64, 16, 3, 42
#: Fingerprints that may share a key before it is refined; refinement rounds.
KEY_ROWS, REFINEMENTS = 64, 4
#: Shingles hashed at a time; bytes of a text cut into words at a time.
_SLICE, _BLOCK = 1 << 16, 1 << 22
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _word_lists(data: bytes) -> Iterator[list[bytes]]:
    """Words of a text in lists of bounded size, however long the text is; no word is cut."""
    start = 0
    while start < len(data):
        stop = start + _BLOCK
        if stop < len(data):
            end = _SPACE.search(data, stop)
            stop = end.start() if end else len(data)
        yield data[start:stop].split()  # bytes: split at ASCII white space only
        start = stop


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash: bit set where over half of the shingles' XXH64 have it.

    Words are those of the text with A-Z lower-cased; fewer words than ``shingle``: the whole
    sequence is the one shingle; no words or null: 0.
    """
    ones, count, carried = np.zeros(BITS, dtype=np.int64), 0, []

    def add(pieces: list[bytes]) -> None:
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), dtype="<u8", count=len(pieces))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        np.add(ones, bits.sum(axis=0, dtype=np.int64), out=ones)

    for words in _word_lists((text or "").encode("utf-8").lower()):
        words = carried + words
        whole = len(words) - shingle + 1
        for start in range(0, whole, _SLICE):
            add([b" ".join(words[i : i + shingle]) for i in range(start, min(whole, start + _SLICE))])
        count += max(0, whole)
        carried = words[max(0, whole) :]
    if not count:
        if not carried:
            return 0
        add([b" ".join(carried)])
        count = 1
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, shingle: int = 3) -> Column:
    """The fingerprint as a signed long (the same 64 bits)."""

    @F.pandas_udf(T.LongType())
    def fingerprints(texts: pd.Series) -> pd.Series:
        found = np.fromiter((fingerprint(t, shingle) for t in texts), dtype=np.uint64, count=len(texts))
        return pd.Series(found.view(np.int64))

    return fingerprints(text)


def _as_signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _quarters(open_bits: list[int]) -> list[list[int]]:
    cuts = [round(k * len(open_bits) / 4) for k in range(5)]
    return [open_bits[a:b] for a, b in zip(cuts, cuts[1:])]


def _mask_levels() -> list[dict[str, int]]:
    """Per refinement level, masks by path: '<first segment><nibble left open>' then quarters."""
    first: dict[str, int] = {}
    for i in range(4):
        for j in range(4):
            bits = [SEGMENT * i + b for b in range(SEGMENT)]
            after = SEGMENT * ((i + 1) % 4)
            bits += [after + 4 * k + b for k in range(4) if k != j for b in range(4)]
            first[f"{i}{j}"] = sum(1 << b for b in bits)
    levels = [first]
    for _ in range(REFINEMENTS):
        finer = {}
        for path, mask in levels[-1].items():
            left = [b for b in range(BITS) if not mask >> b & 1]
            for k, quarter in enumerate(_quarters(left)):
                finer[path + str(k)] = mask | sum(1 << b for b in quarter)
        levels.append(finer)
    return levels


def _bits_between(difference: Column, segment: Column) -> Column:
    return F.bit_count(F.call_function("shiftrightunsigned", difference, (segment % 4 * SEGMENT).cast("int")).bitwiseAND(F.lit(0xFFFF)))


def _within_chains(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, first) that keep every chain budget and the whole distance."""
    diff = F.col("a").bitwiseXOR(F.col("b"))
    first = F.col("first")
    one = _bits_between(diff, first)
    two = one + _bits_between(diff, first + 1)
    three = two + _bits_between(diff, first + 2)
    return pairs.where((one == 0) & (two <= 1) & (three <= 2)).where(F.bit_count(diff) <= MAX_DISTANCE)


def _keyed(fingerprints: DataFrame, masks: dict[str, int]) -> DataFrame:
    keys = F.array(*(F.struct(F.lit(path).alias("path"), F.col("fp").bitwiseAND(F.lit(_as_signed(mask))).alias("key")) for path, mask in masks.items()))
    return fingerprints.select("fp", F.explode(keys).alias("k")).select("fp", "k.path", "k.key")


def _refined(heavy: DataFrame, masks: dict[str, int], table: DataFrame) -> DataFrame:
    finer = heavy.join(F.broadcast(table), F.col("path") == F.col("parent"))  # table: a fixed number of masks
    return finer.select("fp", F.col("child").alias("path"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"))


def links_between(fingerprints: DataFrame) -> DataFrame:
    """Distinct ``fp`` (long, not null) to pairs (a, b), a < b, at ``MAX_DISTANCE`` bits or fewer.

    Complete: every such pair is returned, once or more.
    """
    spark = fingerprints.sparkSession
    levels = _mask_levels()
    keyed, found = _keyed(fingerprints, levels[0]), None
    for level in range(len(levels)):
        sized = keyed.withColumn("n", F.count("*").over(Window.partitionBy("path", "key"))).where("n > 1")
        sized = materialize(sized, f"simhash-keys-{level}")
        last = level == len(levels) - 1
        light = (sized if last else sized.where(F.col("n") <= KEY_ROWS)).drop("n")
        other = light.select(F.col("fp").alias("b"), "path", "key")
        pairs = light.withColumnRenamed("fp", "a").join(other, ["path", "key"]).where("a < b")
        pairs = _within_chains(pairs.withColumn("first", F.substring("path", 1, 1).cast("int"))).select("a", "b")
        found = pairs if found is None else found.union(pairs)
        if last or sized.where(F.col("n") > KEY_ROWS).isEmpty():
            return found
        table = spark.createDataFrame([(p[:-1], p, _as_signed(m)) for p, m in levels[level + 1].items()], "parent string, child string, mask long")
        keyed = _refined(sized.where(F.col("n") > KEY_ROWS), levels[level + 1], table)
    return found


def near_duplicates(docs: DataFrame, shingle: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every row's ``(doc_id, fp, component_id)``.

    ``component_id`` is the smallest id reachable over links of at most three differing bits, the
    row's own included.  Null or blank texts have fingerprint 0 and link like any other.  Repeated
    rows stay; rows with a null id keep their fingerprint, take no part in linking and get a null
    component.  An empty table gives an empty result; other columns are ignored.
    """
    marked = materialize(docs.select(F.col(id_column).cast("long").alias("doc_id"), fingerprint_column(F.col(text_column), shingle).alias("fp")), "simhash")
    distinct = materialize(marked.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-distinct")
    pairs = links_between(distinct.select("fp"))
    ends = pairs.join(distinct.withColumnsRenamed({"fp": "a", "node": "x"}), "a").join(distinct.withColumnsRenamed({"fp": "b", "node": "y"}), "b")
    members = connected_components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")))
    of_fp = distinct.join(members, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    joined = marked.join(of_fp, "fp", "left")
    return joined.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_representatives(docs: DataFrame, shingle: int = 3, similar_percent: int | None = None) -> DataFrame:
    """The documents whose id is that of their component; one row per component.

    Links are those of ``near_duplicates``; with ``similar_percent``, all those of that Jaccard similarity or more (``similar``).

    Columns are those of ``docs``, whatever their names.  Of repeated rows with one id, one stays, that with the smallest text (null first).
    Rows with a null id cannot be linked and stay.  Null and empty texts are like each other; texts may have any length.  An empty table gives an empty one.
    """
    linked = near_duplicates(docs, shingle) if similar_percent is None else similar_components(docs, shingle, similar_percent)
    groups = linked.where("doc_id = component_id").groupBy(F.col("doc_id").alias("_kept")).agg(F.count("*").alias("_rows"))
    groups = materialize(groups, "simhash-kept")
    # merged at every size: which ids stay grows with the documents, so it is never broadcast
    boxed = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("_doc"))
    found = boxed.join(groups.hint("merge"), F.col("_doc.doc_id") == F.col("_kept"))
    out = [F.col("_doc")[c].alias(c) for c in docs.columns]
    unlinked = docs.where(docs["doc_id"].isNull())
    if groups.where("_rows > 1").isEmpty():
        return found.select(*out).unionByName(unlinked)
    ranked = found.where("_rows > 1").withColumn("_nth", F.row_number().over(Window.partitionBy("_kept").orderBy("_doc.text"))).where("_nth = 1")
    return found.where("_rows = 1").select(*out).unionByName(ranked.select(*out)).unionByName(unlinked)
