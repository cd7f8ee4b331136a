"""Documents as they arrive: page files in a folder, extracted per micro-batch.

Almost every operator looks at a document's lines in order (row_number, lead), which a streaming DataFrame does not allow; a micro-batch is an
ordinary DataFrame, and a document is whole within its file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chartloom.plans import documents

SCHEMA = "doc_id string, page_number int, final_text string, native_text string, at timestamp"


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).json(folder)


def extract_stream(pages: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Results of each micro-batch go to ``output``/batch=n, which a retried batch replaces, so nothing is written twice."""

    def batch(df: DataFrame, number: int) -> None:
        extracted = documents.extract(df.drop("at"), share=True)
        documents.export(extracted).write.mode("overwrite").json(f"{output}/batch={number}")
        extracted.release()

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(pages: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Pages and documents (approximately) per time window; state older than ``late`` is dropped."""
    return pages.withWatermark("at", late).groupBy(F.window("at", window)).agg(F.count("*").alias("pages"), F.approx_count_distinct("doc_id").alias("documents"))
