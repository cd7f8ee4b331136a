"""Staged tables: a relation that several steps use is written once into the shared folder and read from there.

A lost executor costs a re-read instead of the chain behind it, each use reads its own columns, and what builds on a stage is planned from a scan.
"""

from __future__ import annotations

import uuid
import weakref

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.sources import readers

_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` as written and read again; columns of nulls alone become strings, as Parquet has no such type."""
    df = df.withColumns({c: F.col(f"`{c}`").cast("string") for c, kind in df.dtypes if kind == "void"})
    path = f"{readers.work_folder(df.sparkSession)}/stage-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    read = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[read] = path
    return read


def release(*tables: DataFrame) -> None:
    """Deletes stages; only when nothing that reads them is still to run."""
    for table in tables:
        if path := _WRITTEN.pop(table, None):
            context = table.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
