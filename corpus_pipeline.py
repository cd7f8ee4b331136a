"""Corpus pipeline: from raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and is the next stage's input.
All stages but the last return the columns of ``documents``.

For every stage: a null text counts as an empty one; texts may have any length; an empty table gives an empty one; other columns of ``docs``, whatever their names, are carried
(by the last stage dropped) and decide nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.llm import mixing, pieces, pii, quality, simhash
from chartloom.llm.shared import materialize

#: Key of the pseudonyms and path of the tokenizer model; a deployment sets its own.
PSEUDONYM_KEY = "pipeline-key"
MODEL_PATH: str | None = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass their own rules, of hosts (sources) that pass.

    Null and empty texts have no words and go.  Null sources are one host.  Rows are judged one by one, so repeated rows go or stay together; ties do not arise.
    """
    return quality.kept_documents(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity of 0.8 or more): that with the smallest id.

    Null and empty texts are one group.  Of repeated rows with one id the one with the smallest text stays; rows without an id cannot be linked and stay.
    """
    return simhash.keep_representatives(docs, shingle=5, similar_percent=80)


def pii_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets replaced by pseudonyms of the same format; n_chars follows the new text.

    A null text stays null, as does its n_chars.  Equal values get equal pseudonyms, so repeated rows stay equal; of overlapping values the leftmost counts.
    """
    replaced = pii.with_pseudonyms(docs, PSEUDONYM_KEY)
    return replaced.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: sources weigh 5, 2, 1 in turn and share 150 % of all words; a document that is taken twice is two rows.

    Null and empty texts have no words and weigh nothing.  Null sources are one source, the last.  Ties of the hash are broken by id and text; rows that are equal in both are taken together.
    """
    return mixing.mixed_documents(docs, weights=(5, 2, 1), share=1.5, most=2)


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, and whether they decode to its very text.

    A null or empty text has the end id alone.  Of pairs with one rank the leftmost is merged first.  Rows are independent: repeated rows repeat their ids.
    """
    path = MODEL_PATH
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    coded = pieces.encode_and_decode(docs, path, keep=["doc_id", "text", "lang", "source"])
    exact = F.col("decoded") == F.coalesce(F.col("text"), F.lit(""))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", exact.alias("round_trip"))


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", simhash_near_dedup),
    ("pii pseudonyms", pii_pseudonyms),
    ("mixing to target weights", mix_sources),
    ("sentencepiece ids", sentencepiece_ids),
]

#: Fingerprints, keyed hashes and merges have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{i}")
    return docs
