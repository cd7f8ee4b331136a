"""Sources and sinks.  PDF and OCR engines are optional adapters: they deliver the page, block, word and table relations that the plans take."""

from __future__ import annotations

import importlib.util
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGES = "doc_id string, page_number int, width double, height double, native_text string, image_count int"


def work_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors share, as ``spark.checkpoint.dir`` names it; a temporary one only where the driver runs all tasks itself."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="chartloom-work-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def available(module: str) -> bool:
    """Whether an optional library is installed."""
    return importlib.util.find_spec(module) is not None


def csv(spark: SparkSession, path: str) -> DataFrame:
    """Header, every column a string, nothing instead of null; names trimmed."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return df.toDF(*(c.strip() for c in df.columns)).na.fill("")


def optional_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """As ``csv``; an empty table with these columns where there is no file."""
    try:
        return csv(spark, path)
    except AnalysisException:
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))


def column_named(df: DataFrame, aliases: list[str], required: bool = True) -> str | None:
    """The first of some names that the table has, whatever its case."""
    by_name = {c.lower(): c for c in df.columns}
    found = next((by_name[a.lower()] for a in aliases if a.lower() in by_name), None)
    if found is None and required:
        raise KeyError(f"none of the columns {aliases} exists")
    return found


def documents(spark: SparkSession, root: str, schema: str | None = None, name: str = "document.json") -> DataFrame:
    """JSON documents root/*/document.json (or files of another ``name``) with their path and raw text (for rules about which keys exist)."""
    raw = spark.read.text(f"{root.rstrip('/')}/*/{name}", wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))
    raw = raw.withColumn("keys", F.json_object_keys("raw"))
    return raw if schema is None else raw.withColumn("document", F.from_json("raw", schema))


def pdf_pages(spark: SparkSession, path: str, parse: Callable[[bytes], Iterator[dict]]) -> DataFrame:
    """Pages of PDF files through an adapter: ``parse(content)`` yields dicts of page_number, width, height, native_text, image_count.

    A file that breaks off gives one row with page_number 0 and the error as text, and stops no other file.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                stem = row.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                try:
                    pages = [{"doc_id": stem, **p} for p in parse(row.content)]
                except Exception as error:  # any fault of a file is that file's result
                    pages = [{"doc_id": stem, "page_number": 0, "native_text": f"{type(error).__name__}: {error}"}]
                yield pd.DataFrame(pages, columns=[c.split()[0] for c in PAGES.split(", ")])

    return files.mapInPandas(work, PAGES)


def _strict(value: Column, kind: T.DataType) -> Column:
    """``value`` with NaN and infinities as null, wherever in it they stand."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(_strict(value[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _strict(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: _strict(x, kind.valueType))
    return value


def without_non_finite(df: DataFrame) -> DataFrame:
    """NaN and infinities as null, as strict JSON asks, also inside arrays, maps and structs."""
    return df.select(*(_strict(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields))


def write_documents(df: DataFrame, path: str, partition: str = "doc_id") -> None:
    """One folder per value of ``partition``; only the folders of ``df`` are replaced, all others stay.

    At scale, partition by a bucket of the ids rather than by the id, so that files stay large.
    """
    without_non_finite(df).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).json(path)


def write_tables(tables: DataFrame, path: str) -> None:
    """Records of tables as JSON and CSV, by table; the tables are worked out once, CSV is written from the JSON."""
    rows = tables.select("table_id", F.posexplode("records").alias("row", "record"))
    rows.write.mode("overwrite").partitionBy("table_id").json(f"{path}/json")
    read = tables.sparkSession.read.schema(rows.schema).json(f"{path}/json")
    read.select("table_id", "row", F.to_json("record").alias("record")).write.mode("overwrite").partitionBy("table_id").csv(f"{path}/csv")


def report(judged: DataFrame, path: str) -> None:
    judged.write.mode("overwrite").json(path)


def page_file(number: Column) -> Column:
    return F.concat(F.format_string("page_%03d", number), F.lit(".json"))
