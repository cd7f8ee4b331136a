"""What the corpus operators share: the shared work folder, lineage cuts and word rules."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words (space, tab, LF, VT, FF, CR).
WHITESPACE_CLASS = r"[\x20\x09-\x0D]"
NON_WHITESPACE_CLASS = r"[^\x20\x09-\x0D]"


def work_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that is unset and the driver runs all tasks itself (tests on one
    machine) a temporary folder is made and set; elsewhere executors could not see it, so its absence is an error.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="chartloom-checkpoint-")
        context.setCheckpointDir(named)
    return named


_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The lineage is cut there, so a lost executor costs a re-read instead of a recomputation,
    and every later use reads only the columns it needs.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[written] = path
    return written


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote.  Only for tables on which nothing depends that is still to be run."""
    for table in tables:
        if path := _WRITTEN.pop(table, None):
            context = table.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def words_of(text: Column) -> Column:
    """Words of a text (null: none), in order, as an array."""
    pieces = F.split(F.coalesce(text, F.lit("")), WHITESPACE_CLASS + "+")
    return F.filter(pieces, lambda piece: piece != "")


def word_count(text: Column) -> Column:
    """Number of words (null: 0), as a long, without building a filtered array."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{WHITESPACE_CLASS}+|{WHITESPACE_CLASS}+$", "")
    counted = F.size(F.split(trimmed, WHITESPACE_CLASS + "+"))
    return F.when(trimmed == "", F.lit(0)).otherwise(counted).cast("long")


def let(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once, however often ``then`` uses it (lambdas would repeat it)."""
    return F.element_at(F.transform(F.array(value), then), 1)


def small_side(df: DataFrame, rows: int, limit: int = 50_000) -> DataFrame:
    """Hint a broadcast only where the counted rows are under ``limit``; else leave the join to shuffle."""
    return F.broadcast(df) if rows <= limit else df
