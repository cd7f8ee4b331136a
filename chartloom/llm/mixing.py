"""Mixing sources to target weights by hash-threshold histograms.

Each document has a hash.  Words are summed by source and leading hash bits; the bucket in which a
source's budget runs out is the only one that is looked at more closely, by its next bits, until it
holds one hash value.  What lies below that threshold is taken: no sort, and a larger budget takes a
superset of what a smaller one takes.  Whole repeats of a source need no threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chartloom.llm.shared import materialize, small_side, word_count

HASH_BITS, STEP_BITS = 60, 12


def document_hash(id_: Column, text: Column, seed: int = 0) -> Column:
    """60-bit hash of id, text and seed; the text tells rows apart whose id is null or repeated."""
    return F.call_function("shiftrightunsigned", F.xxhash64(F.lit(seed), id_, text), F.lit(64 - HASH_BITS))


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """``(source, source_size)`` plus ``target``.

    Sources in code point order, null last, weigh ``weights`` in turn.  ``share`` of all sizes is split by
    weight; a target stops at ``most`` times its source's size and the excess goes to the others by weight,
    until none is above.  With sources ordered by cap/weight that level is the largest of the levels left
    after capping each prefix, so no loop is needed.  One row per source.
    """
    numbered = sources.withColumn("_i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weighted = numbered.withColumn("_w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("_i") - 1) % len(weights) + 1))
    capped = weighted.withColumn("_cap", F.col("source_size") * float(most))
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("_cap") / F.col("_w"), "_i").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * share - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    level = left / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    levelled = capped.withColumn("_level", level).withColumn("_level", F.max("_level").over(everything))
    return levelled.select("source", "source_size", F.least("_cap", F.col("_level") * F.col("_w")).alias("target"))


def _histogram(rows: DataFrame, shift: int) -> DataFrame:
    bucket = F.shiftright("h", shift)
    return rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("size"), F.min("h").alias("low"), F.max("h").alias("high"))


def _boundaries(histogram: DataFrame, plans: DataFrame, n_sources: int) -> DataFrame:
    """The bucket of each source in which what it still needs runs out."""
    up_to = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    keys = small_side(plans.select(F.col("source").alias("_s"), "before", "need"), n_sources)
    summed = histogram.join(keys, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("end", F.col("before") + F.sum("size").over(up_to))
    reached = summed.where((F.col("end") >= F.col("need")) & (F.col("end") - F.col("size") < F.col("need")))
    return reached.select("source", "need", "bucket", "low", "high", "size", (F.col("end") - F.col("size")).alias("before"))


def thresholds(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 0, id_column: str = "doc_id") -> tuple[DataFrame, DataFrame, int]:
    """(documents as ``id, source, size, h``; per source ``source_size, target, whole, threshold``; number of sources).

    A document is taken ``whole`` times, and once more if its hash is below ``threshold``.
    """
    narrow = docs.select(docs[id_column].alias("id"), docs["source"].alias("source"), word_count(docs["text"]).alias("size"), document_hash(docs[id_column], docs["text"], seed).alias("h"))
    narrow = materialize(narrow, "mix-sizes")
    shift = HASH_BITS - STEP_BITS
    histogram = materialize(_histogram(narrow, shift), "mix-histogram")
    plans = source_targets(histogram.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    size = F.col("source_size")
    plans = plans.withColumn("whole", F.when(size > 0, F.least(F.floor(F.col("target") / size), F.lit(most))).otherwise(F.lit(0)).cast("int"))
    plans = plans.withColumn("need", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * size))
    plans = materialize(plans, "mix-targets")
    n_sources = plans.count()
    bounds = _boundaries(histogram, plans.withColumn("before", F.lit(0).cast("long")), n_sources)
    bounds = materialize(bounds, "mix-bounds")
    while shift > 0 and not bounds.where("low < high").isEmpty():
        keys = small_side(bounds.select(F.col("source").alias("_s"), F.col("bucket").alias("_b")), n_sources)
        inside = narrow.join(keys, F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("h", shift) == F.col("_b"))).drop("_s", "_b")
        shift -= STEP_BITS
        bounds = materialize(_boundaries(_histogram(inside, shift), bounds.select("source", "before", "need"), n_sources), "mix-bounds")
    nearer = F.col("before") + F.col("size") - F.col("need") < F.col("need") - F.col("before")
    cut = bounds.select(F.col("source").alias("_s"), F.when(nearer, F.col("low") + 1).otherwise(F.col("low")).alias("threshold"))
    plans = plans.join(cut, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "source_size", "target", "whole", F.coalesce("threshold", F.lit(0).cast("long")).alias("threshold"))
    return narrow, materialize(plans, "mix-thresholds"), n_sources


def _with_copies(rows: DataFrame, plans: DataFrame, n_sources: int) -> DataFrame:
    """rows(source, h, ...) plus the plan of their source and ``copies``."""
    keys = small_side(plans.withColumnRenamed("source", "_s"), n_sources)
    joined = rows.join(keys, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    return joined.withColumn("copies", F.col("whole") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0))


def mixture(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 0) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` for every row.

    Size: words of the text, however long (null and empty: 0, never taken but as whole repeats of their source).  ``taken`` = copies * size; copies are 0 to
    ``most``.  A source's taken words differ from its target by half of one document at most; rows that agree in id and text, null ids included, are taken together and count as one document.
    Null sources form a source of their own, last in order.  A pure function of ids, texts, sources and seed, so
    reruns agree; documents of equal size are told apart by their hash.  An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    narrow, plans, n_sources = thresholds(docs, weights, share, most, seed)
    found = _with_copies(narrow, plans, n_sources)
    return found.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 0) -> DataFrame:
    """The mix itself: every document as often as ``mixture`` takes it, with the columns of ``docs``, whatever their names.

    Nulls, empty texts, repeated rows, ties and empty tables as for ``mixture``.
    """
    _, plans, n_sources = thresholds(docs, weights, share, most, seed)
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["source"].alias("source"), document_hash(docs["doc_id"], docs["text"], seed).alias("h"))
    taken = _with_copies(rows, plans.select("source", "whole", "threshold"), n_sources).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select(*(F.col("row")[c].alias(c) for c in docs.columns))
