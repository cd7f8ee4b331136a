"""Extension: retrieval chunks and a keyword index over extracted documents (announced by the domain, with no reference behaviour to match).

Chunk kinds: one per result, one per indexable section, one summary per document, one reference per table or visual.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.functions import text


def _chunk(df: DataFrame, kind: str, position, body) -> DataFrame:
    return df.select("doc_id", F.lit(kind).alias("kind"), position.cast("int").alias("position"), body.alias("body"))


def chunks(results: DataFrame, blocks: DataFrame, assets: DataFrame) -> DataFrame:
    """doc_id, kind, position, body, chunk_id.

    results(doc_id, row_index, analyte, value_raw, unit, observation_date), blocks(doc_id, page_number, place, section_title, index_text, is_indexable),
    assets(doc_id, asset_no, asset_id, caption): tables and visuals.
    """
    line = F.concat_ws(" ", "analyte", F.lit(":"), "value_raw", F.nullif("unit", F.lit("qualitative")), F.when(F.col("observation_date").isNotNull(), F.concat(F.lit("("), "observation_date", F.lit(")"))))
    single = _chunk(results, "result", F.col("row_index"), line)
    sections = _chunk(blocks.where("is_indexable"), "section", F.col("page_number") * 1000 + F.col("place"), F.concat_ws("\n", "section_title", "index_text"))
    ordered = F.array_sort(F.collect_list(F.struct("row_index", line.alias("line"))))
    summary = results.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("all"))
    references = _chunk(assets, "reference", F.col("asset_no"), F.concat_ws(": ", "asset_id", "caption"))
    every = reduce(lambda a, b: a.unionByName(b), [single, sections, _chunk(summary, "summary", F.lit(0), F.col("all")), references])
    return every.where(text.strip(F.col("body")) != "").withColumn("chunk_id", F.concat_ws("/", "doc_id", "kind", F.col("position").cast("string")))


def keyword_index(found: DataFrame) -> DataFrame:
    """term, chunk_id, weight: TF-IDF postings; counted per chunk before the shuffle on terms."""
    terms = found.select("chunk_id", F.explode(F.split(text.label(F.col("body")), "_")).alias("term")).where("length(term) > 1")
    tf = terms.groupBy("term", "chunk_id").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    total = found.select("chunk_id").distinct().count()
    return tf.join(df, "term").select("term", "chunk_id", F.round(F.col("tf") * (F.log(F.lit(1.0 + total) / (1 + F.col("df"))) + 1), 6).alias("weight"))


def search(index: DataFrame, queries: DataFrame, n: int = 10) -> DataFrame:
    """queries(query_id, body) to query_id, rank, chunk_id, score: the best chunks by summed weights, ties by chunk."""
    from pyspark.sql.window import Window

    asked = queries.select("query_id", F.explode(F.array_distinct(F.split(text.label(F.col("body")), "_"))).alias("term"))
    scored = asked.join(index, "term").groupBy("query_id", "chunk_id").agg(F.round(F.sum("weight"), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= n).select("query_id", "rank", "chunk_id", "score")
