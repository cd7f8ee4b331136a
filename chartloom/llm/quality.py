"""Document quality rules and host-level verdicts, in DataFrame functions alone.

Documents fail rules on their own; hosts are judged by how often their documents fail, shrunk towards
the rate of all hosts by a beta prior fitted to the hosts (method of moments), so that a host with few
documents is not condemned for two bad ones.  Verdicts go back to the documents by a join on the host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.llm.shared import NON_WHITESPACE_CLASS, materialize, small_side, words_of

WINDOW = 8
#: Characters that count as symbols.
SYMBOLS = r"[^#*$%&|<>]+"
#: Rule limits: fewest words; share of repeated words, of symbols per word and of repeated lines, in percent.
MIN_WORDS, MAX_REPEATED, MAX_SYMBOLS, MAX_LINES = 20, 30, 10, 30
#: A host is rejected as a whole where its shrunk failure rate is above the prior's mean by this many standard deviations of the prior and this much besides, or above the last.
DEVIATIONS, LEAST_EXCESS, MAX_HOST_RATE = 3.0, 0.35, 0.8
#: Most documents that the prior weighs.
MOST_WEIGHT = 1e6


def _repeated_positions(pairs: Column) -> Column:
    def shared(pair: Column, i: Column) -> Column:
        same = lambda j: F.coalesce(F.get(pairs, j)["h"] == pair["h"], F.lit(False))
        return same(i - 1) | same(i + 1)

    return F.sort_array(F.transform(F.filter(pairs, shared), lambda pair: pair["i"]))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def with_text_counts(docs: DataFrame, text: Column, name: str = "counts") -> DataFrame:
    """``docs`` plus a struct ``name`` of n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (longs).

    A null text has no words and no lines.  n_repeat_words counts the words that lie in an 8-word window whose
    words occur twice or more in the text.  Every step is linear in the text but one sort of the windows of texts that repeat any.
    The columns of ``docs`` travel in a struct of their own, so that their names cannot clash with those of the steps.
    """
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike(NON_WHITESPACE_CLASS))
    step = docs.select(
        F.struct(*_own(docs)).alias("row"),
        words_of(text).alias("words"),
        lines.alias("lines"),
        F.length(F.regexp_replace(F.coalesce(text, F.lit("")), SYMBOLS, "")).cast("long").alias("n_symbols"),
    )
    step = step.select(
        "row",
        "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda word: F.xxhash64(word)).alias("hashes"),
    )
    counts = ["row", *COUNTS[:-1]]
    starts = F.sequence(F.lit(1), F.size("hashes") - (WINDOW - 1))
    windows = F.when(F.size("hashes") > WINDOW, F.transform(starts, lambda i: F.xxhash64(F.slice("hashes", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    step = step.select(*counts, windows.alias("windows"))
    paired = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    step = step.select(*counts, F.when(F.size(F.array_distinct("windows")) < F.size("windows"), paired).otherwise(none).alias("pairs"))
    step = step.select(*counts, _repeated_positions(F.col("pairs")).alias("at"))
    fresh = F.transform("at", lambda at, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("at"), i + 1) - at, F.lit(WINDOW))))
    step = step.select(*counts, F.aggregate(fresh, F.lit(0).cast("long"), lambda total, x: total + x).alias("n_repeat_words"))
    return step.select(*(F.col("row")[c].alias(c) for c in docs.columns if c != name), F.struct(*COUNTS).alias(name))


def _own(docs: DataFrame) -> list[Column]:
    return [docs[c] for c in docs.columns]


def base_failed(counts: Column) -> Column:
    return (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEATED * counts["n_words"])


def any_rule_failed(counts: Column) -> Column:
    """The base rules, or many symbols, or many repeated lines."""
    return base_failed(counts) | (100 * counts["n_symbols"] > MAX_SYMBOLS * counts["word_chars"]) | (100 * counts["n_dup_lines"] > MAX_LINES * counts["n_lines"])


def host_verdicts(hosts: DataFrame) -> DataFrame:
    """``(host, docs, failed)`` plus ``rate`` (shrunk), ``limit`` and ``host_kept``.

    The prior's mean is the pooled rate; its weight (in documents) follows from how much more the hosts' rates vary than chance alone
    would make them, between 1 and ``MOST_WEIGHT``.  A host is rejected where its shrunk rate lies above the prior's mean by more than ``DEVIATIONS`` of the
    prior's standard deviations and ``LEAST_EXCESS`` besides, so what is usual among the hosts is not rejected and the limit follows the data; above ``MAX_HOST_RATE`` it is rejected in any case.
    """
    share = F.col("failed") / F.col("docs")
    sums = hosts.agg(F.sum("failed").alias("f"), F.sum("docs").alias("d"), F.sum(F.col("docs") * share * share).alias("q"), F.count("*").alias("k"))
    mean = F.col("f") / F.col("d")
    chance = mean * (1 - mean) * F.col("k") / F.col("d")
    spread = F.greatest(F.col("q") / F.col("d") - mean * mean - chance, F.lit(1e-9))
    weight = F.greatest(F.lit(1.0), F.least(F.lit(MOST_WEIGHT), mean * (1 - mean) / spread - 1))
    prior = sums.where("d > 0").select(mean.alias("mean"), weight.alias("weight"))
    prior = prior.withColumn("limit", F.least(F.lit(MAX_HOST_RATE), F.col("mean") + LEAST_EXCESS + DEVIATIONS * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))))
    rate = (F.col("failed") + F.col("mean") * F.col("weight")) / (F.col("docs") + F.col("weight"))
    judged = hosts.join(F.broadcast(prior))  # the prior is one row
    return judged.withColumn("rate", rate).withColumn("host_kept", F.col("rate") <= F.col("limit")).select("host", "docs", "failed", "rate", "limit", "host_kept")


def _counted(docs: DataFrame, host_column: str, text_column: str, keep: list[str]) -> DataFrame:
    """``row`` (a struct of the columns to keep), ``host`` and ``counts``, written; the hosts' verdicts need all of them first."""
    counted = with_text_counts(docs.select(F.struct(*(docs[c] for c in keep)).alias("row"), docs[host_column].alias("host"), docs[text_column].alias("text")), F.col("text"))
    return materialize(counted.select("row", "host", "counts"), "quality-counts")


def _judged(counted: DataFrame) -> DataFrame:
    hosts = counted.groupBy("host").agg(F.count("*").alias("docs"), F.count_if(any_rule_failed(F.col("counts"))).alias("failed"))
    verdicts = materialize(host_verdicts(hosts), "quality-hosts")
    side = small_side(verdicts.select(F.col("host").alias("of"), "rate", "host_kept"), verdicts.count())
    return counted.join(side, F.col("host").eqNullSafe(F.col("of")), "left")


def with_verdicts(docs: DataFrame, host_column: str = "source", text_column: str = "text") -> DataFrame:
    """``docs`` without its text, plus the counts, base_failed, rate (of its host) and kept.

    A null host is a host of its own; a null or empty text has no words, so it fails; a text's length does not matter.  Repeated rows count as often as they
    occur.  Columns of ``docs`` with the names of those that are added are replaced by them.  An empty table gives an empty result.
    """
    added = [*COUNTS, "base_failed", "rate", "kept"]
    keep = [c for c in docs.columns if c != text_column and c not in added]
    joined = _judged(_counted(docs, host_column, text_column, keep))
    failed = base_failed(F.col("counts"))
    own = [F.col("row")[c].alias(c) for c in keep]
    return joined.select(*own, *(F.col("counts")[c].alias(c) for c in COUNTS), failed.alias("base_failed"), "rate", (~failed & F.col("host_kept")).alias("kept"))


def kept_documents(docs: DataFrame, host_column: str = "source", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass their own rules and whose host passes, with the columns of ``docs``, whatever their names.

    Nulls, empty texts, repeated rows and empty tables as for ``with_verdicts``.  The counts are worked out once: rows go to the shared folder with them.
    """
    joined = _judged(_counted(docs, host_column, text_column, docs.columns))
    return joined.where(~base_failed(F.col("counts")) & F.col("host_kept")).select(*(F.col("row")[c].alias(c) for c in docs.columns))
