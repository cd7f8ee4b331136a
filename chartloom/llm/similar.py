"""Near duplicates by the Jaccard similarity of their shingles, complete above a least similarity.

Candidates come from SimHash: a 1,024-bit fingerprint, equal segments, pigeonring chains and a Hamming radius that reaches the similarity (``wide_simhash``).  Some one pair in a hundred of those just at 0.8 has no segment
in common, so what is left in different components is then looked at by bounds that lose nothing: a prefix filter over the shingles in one global order (hash, frequent shingles last).  Of two sets with
``J >= t``, both have one of the other's shingles among their first ``n - ceil(t * n) + 1``, and they share so many of these that the rest of the
smaller could make up the overlap.  A 1,024-bit parity fingerprint holds the parity of the hashes at each bit: two of them differ in no more bits than the sets
in shingles, so the similarity sets a Hamming radius that is exact.  All candidates pass the pigeonring filter for that radius: on the ring of its 64-bit segments
some chain of consecutive segments must keep within its share of the radius at each of its lengths; then the whole distance is looked at.  The exact
Jaccard similarity of what the bounds leave decides.  Shingles count as equal when their 64-bit hashes are equal.

Equal sets are one node (named by 64 bits of a 128-bit digest).  Of a shingle's group only pairs that SimHash left in different components are looked at, so a large group of near copies is not squared.
Texts travel only for pairs that passed all bounds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.llm import wide_simhash
from chartloom.llm.components import connected_components
from chartloom.llm.shared import let, materialize, release

SEED, PARITY = 42, 1024
#: Segments of the fingerprint on the ring; lengths of its chains that are looked at before the whole distance.
SEGMENTS, CHAIN = PARITY // 64, 4
#: One document in so many is looked at for frequent shingles; rows of these that make a shingle frequent; most that are put last (longs, sent to every task).
#: A shingle that is not among them is rare, so a passage that many documents share is in few prefixes.
SAMPLED, FREQUENT, MOST_FREQUENT = 8, 2, 200_000
#: Rows worked on at a time in a Python worker.
SLICE = 512
_STEP, _MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


def shingle_hashes(text: str | None, shingle: int = 5) -> np.ndarray:
    """Distinct unsigned hashes, ascending, of a text's shingles; words as for ``simhash.fingerprint``.

    Fewer words than ``shingle``: the whole sequence is the one shingle; no words or null: none.
    """
    words = (text or "").encode("utf-8").lower().split()  # bytes: split at ASCII white space only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    width = min(shingle, len(words))
    own = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(SEED)), dtype=np.uint64, count=len(words))
    whole = len(words) - width + 1
    mixed = np.full(whole, width, dtype=np.uint64)
    for k in range(width):
        mixed = (mixed + own[k : k + whole]) * np.uint64(_STEP)
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(_MIX)
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


def prefix_length(n: int, percent: int) -> int:
    """Leading shingles of which two sets at this similarity share one."""
    return n - -(-n * percent // 100) + 1 if n else 0


def digest_of(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def parity_of(shingles: np.ndarray) -> np.ndarray:
    """The fingerprint as longs."""
    odd = np.bincount((shingles % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _digest_column(text: Column, shingle: int) -> Column:
    @F.pandas_udf(T.BinaryType())
    def digests(texts: pd.Series) -> pd.Series:
        return pd.Series([digest_of(shingle_hashes(t, shingle)) for t in texts], dtype=object)

    return digests(text)


def _prefix(shingles: np.ndarray, percent: int, frequent: np.ndarray) -> np.ndarray:
    found = shingles.view(np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
        late = frequent[at] == found
        found = np.concatenate([found[~late], found[late]])
    return found[: prefix_length(len(found), percent)]


_WORDS = [f"p{i}" for i in range(SEGMENTS)]


def _features(given: DataFrame, shingle: int, percent: int, last: Sequence[int]) -> DataFrame:
    """(digest, doc_id, n, prefix, simhash, p0, p1, ...) of each row with a word."""
    frequent = np.sort(np.array(last, dtype=np.int64))
    names = ["digest", "doc_id", "n", "prefix", "simhash", *_WORDS]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                ids, texts = (batch.column(i).slice(start, SLICE).to_pylist() for i in (0, 1))
                sets = [shingle_hashes(t, shingle) for t in texts]
                rows = [i for i, s in enumerate(sets) if len(s)]
                if not rows:
                    continue
                prefixes = [_prefix(sets[i], percent, frequent) for i in rows]
                bounds = np.cumsum([0, *map(len, prefixes)])
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(prefixes), pa.int64()))
                prints = np.concatenate([wide_simhash.fingerprint_of(sets[i]) for i in rows])
                wide = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * wide_simhash.WORDS, pa.int32()), pa.array(prints, pa.int64()))
                parity = np.array([parity_of(sets[i]) for i in rows])
                columns = [pa.array([digest_of(sets[i]) for i in rows], pa.binary()), pa.array([ids[i] for i in rows], pa.int64()), pa.array([len(sets[i]) for i in rows], pa.int32()), lists, wide]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(parity[:, k].copy(), pa.int64()) for k in range(SEGMENTS)], names)

    return given.mapInArrow(work, "digest binary, doc_id bigint, n int, prefix array<bigint>, simhash array<bigint>, " + ", ".join(f"{w} bigint" for w in _WORDS))


def _radius(percent: int) -> Column:
    """Most shingles in which similar sets of sizes na and nb differ: (na + nb) * (1 - t) / (1 + t)."""
    return (F.col("na") + F.col("nb")) * (100 - percent) / (100 + percent) + F.lit(1e-6)


def _within_chains(percent: int) -> Column:
    """Pigeonring filter on the fingerprints in the structs ``fa`` and ``fb``: a chain within its share of the radius at every length, then the whole distance."""

    def passes(x: Column) -> Column:
        apart, radius = x["apart"], x["radius"]
        part = lambda i, k: F.element_at(apart, F.pmod(i + k, F.lit(SEGMENTS)).cast("int") + 1)

        def keeps(i: Column) -> Column:
            total, fits = F.lit(0), F.lit(True)
            for length in range(1, CHAIN + 1):
                total = total + part(i, length - 1)
                fits = fits & (total <= radius * length / SEGMENTS)
            return fits

        whole = F.aggregate(apart, F.lit(0), lambda a, d: a + d)
        return F.exists(F.sequence(F.lit(0), F.lit(SEGMENTS - 1)), keeps) & (whole <= radius)

    apart = F.array(*(F.bit_count(F.col(f"fa.{w}").bitwiseXOR(F.col(f"fb.{w}"))) for w in _WORDS))
    return let(F.struct(apart.alias("apart"), _radius(percent).alias("radius")), passes)


def _similar_column(a: Column, b: Column, shingle: int, percent: int) -> Column:
    @F.pandas_udf(T.BooleanType())
    def similar(left: pd.Series, right: pd.Series) -> pd.Series:
        out, text, x = [], None, shingle_hashes(None, shingle)
        for s, t in zip(left, right):
            if s != text:  # neighbours often share it
                text, x = s, shingle_hashes(s, shingle)
            y = shingle_hashes(t, shingle)
            common = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * common >= percent * (len(x) + len(y) - common))
        return pd.Series(out, dtype=bool)

    return similar(a, b)


def _sizes_fit(percent: int) -> Column:
    return F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent


def _least_shared(percent: int) -> Column:
    """Prefix shingles that two sets of sizes na and nb share at least: the overlap they need, less the longer rest."""
    rest = lambda n: F.ceil(F.col(n) * percent / 100) - 1
    return F.ceil((F.col("na") + F.col("nb")) * percent / (100 + percent) - F.lit(1e-6)) - F.greatest(rest("na"), rest("nb"))


def _with_both(pairs: DataFrame, side: DataFrame, value: str, a: str, b: str) -> DataFrame:
    """pairs(a, b) with ``value`` of either node; joined by merging at every size, as both grow with the documents."""
    left = pairs.join(side.select(F.col("node").alias("a"), F.col(value).alias(a)).hint("merge"), "a")
    return left.join(side.select(F.col("node").alias("b"), F.col(value).alias(b)).hint("merge"), "b")


def _verified(pairs: DataFrame, given: DataFrame, nodes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that are similar; only texts that are in a pair travel."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = nodes.select("node", "doc_id", "digest").join(asked.hint("merge"), "node")
    found = given.join(wanted.hint("merge"), "doc_id").where(_digest_column(F.col("text"), shingle) == F.col("digest"))  # of rows with one id, that with the node's text
    texts = materialize(found.dropDuplicates(["node"]).select("node", "text"), "similar-texts")
    both = _with_both(pairs, texts, "text", "ta", "tb")
    links = materialize(both.where(_similar_column(F.col("ta"), F.col("tb"), shingle, percent)).select("a", "b"), "similar-links")
    release(texts)
    return links


def _linked(pairs: DataFrame, given: DataFrame, nodes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) that SimHash found and that are similar."""
    prints = nodes.select("node", F.struct("n", "simhash", "fingerprint").alias("prints"))
    met = _with_both(pairs, prints, "prints", "ga", "gb").where(wide_simhash.within_radius(F.col("ga.simhash"), F.col("gb.simhash"), percent))
    met = met.select("a", "b", F.col("ga.n").alias("na"), F.col("gb.n").alias("nb"), F.col("ga.fingerprint").alias("fa"), F.col("gb.fingerprint").alias("fb"))
    near = materialize(met.where(_within_chains(percent)).select("a", "b"), "similar-near")
    links = _verified(near, given, nodes, shingle, percent)
    release(near)
    return links


def _stars(members: DataFrame) -> DataFrame:
    """Links (a, b) that give the components of ``members`` again."""
    return members.select(F.col("component").alias("a"), F.col("node").alias("b"))


def similar_components(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Every row's ``(doc_id, component_id)``: the smallest id reachable over links of a Jaccard similarity of ``percent`` or more.

    Blank and null texts are equal to each other and to nothing else.  Rows with a null id are left out; repeated rows stay; of rows
    with one id and different texts, each is linked on its own.  Texts may have any length; other columns are ignored.  An empty table gives an empty result.
    """
    given = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = materialize(given.select("doc_id", _digest_column(F.col("text"), shingle).alias("digest")), "similar-marked")

    sample = _features(given.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0), shingle, percent, ()).select(F.explode("prefix").alias("token"))
    often = sample.groupBy("token").agg(F.count("*").alias("k")).where(F.col("k") > FREQUENT)
    last = [r.token for r in often.orderBy(F.desc("k"), "token").limit(MOST_FREQUENT).collect()]  # decides the order only

    single = _features(given, shingle, percent, last).groupBy("digest").agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("n", "prefix", "simhash", *_WORDS)))
    nodes = materialize(single.withColumn("node", F.xxhash64("digest")).withColumn("fingerprint", F.struct(*_WORDS)).drop(*_WORDS), "similar-nodes")

    nearest = wide_simhash.candidates(nodes, percent, wide_simhash.FIRST)
    members = connected_components(_linked(nearest, given, nodes, shingle, percent))  # large groups of near copies
    known = nodes.join(members.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    links = _linked(wide_simhash.candidates(known, percent, wide_simhash.LATER), given, nodes, shingle, percent).unionByName(_stars(members))

    tokens = nodes.select("node", "n", F.explode("prefix").alias("token"))
    repeated = tokens.groupBy("token").agg(F.count("*").alias("k")).where("k > 1")
    shared = materialize(tokens.join(repeated.hint("merge"), "token").drop("k"), "similar-tokens")
    ends = [F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")]
    members = connected_components(links)
    placed = materialize(shared.join(members.hint("merge"), "node", "left").select("token", "node", "n", F.coalesce("component", "node").alias("c")), "similar-placed")
    release(shared)
    parts = placed.groupBy("token", "c").agg(F.count("*").alias("k")).groupBy("token").agg(F.max_by("c", F.struct("k", "c")).alias("most"), F.count("*").alias("parts"))
    open_ = placed.join(parts.where("parts > 1").select("token", "most").hint("merge"), "token").join(nodes.select("node", "fingerprint").hint("merge"), "node")
    open_ = materialize(open_, "similar-open")
    few = open_.where("c <> most").select("token", F.col("node").alias("x"), F.col("n").alias("na"), F.col("c").alias("cx"), F.col("fingerprint").alias("fa"))
    every = open_.select("token", F.col("node").alias("y"), F.col("n").alias("nb"), F.col("c").alias("cy"), "most", F.col("fingerprint").alias("fb"))
    rest = few.join(every.hint("merge"), "token").where("cx <> cy and (cy = most or x < y)").where(_sizes_fit(percent)).where(_within_chains(percent))
    rest = rest.select(*ends, F.least("na", "nb").alias("na"), F.greatest("na", "nb").alias("nb")).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("k"))
    rest = materialize(rest.where(F.col("k") >= _least_shared(percent)).select("a", "b"), "similar-rest")
    release(placed, open_)
    both = _verified(rest, given, nodes, shingle, percent).unionByName(_stars(members))

    of_set = materialize(marked.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("node", F.xxhash64("digest")), "similar-sets")
    release(nodes, rest)
    found = of_set.join(connected_components(both).hint("merge"), "node", "left").select("digest", "doc_id", F.coalesce("component", "node").alias("component"))
    # written, so that both sides of the join are shuffled as they are and Spark can split what a large component has
    least = materialize(found.groupBy("component").agg(F.min("doc_id").alias("component_id")), "similar-least")
    of_digest = found.select("digest", "component").join(least.hint("merge"), "component").select("digest", "component_id")
    return marked.join(of_digest.hint("merge"), "digest").select("doc_id", "component_id")
