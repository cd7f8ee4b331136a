"""A store of documents and their pages as JSON, at two levels with one commit.

Rows are dealt into a fixed number of buckets by document, a file each, so the number of files follows the buckets and not the documents.  A write puts new files for the buckets that it
touches beside the old ones, and then a manifest that names the folder of every bucket; the manifest with the highest number is the store.  A run that fails
before its manifest changes nothing, and of two that started from one manifest the second fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.sources import readers


class DocumentStore:
    """Levels of rows that all have a ``doc_id``, such as documents and pages."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    # -- files --------------------------------------------------------------------------

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, prefix: str) -> list[str]:
        path, files = self._path("")
        return sorted(n for x in (files.listStatus(path) if files.exists(path) else []) if (n := x.getPath().getName()).startswith(prefix))

    def manifest(self) -> dict:
        """{level: {schema, folders: {bucket: folder}}} and the number of the commit; empty before the first."""
        names = self._names("manifest-")
        if not names:
            return {"number": 0, "levels": {}}
        text = self.spark.read.text(f"{self.root}/{names[-1]}", wholetext=True).first()[0]
        return json.loads(text)

    def _commit(self, manifest: dict) -> None:
        path, files = self._path(f"manifest-{manifest['number']:09d}.json")
        out = files.create(path, False)  # fails where another run has committed this number
        try:
            out.write(bytearray(json.dumps(manifest), "utf-8"))
        finally:
            out.close()

    # -- rows ---------------------------------------------------------------------------

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(self.buckets)).cast("int")

    def read(self, level: str, buckets: set[int] | None = None) -> DataFrame:
        known = self.manifest()["levels"][level]
        folders = [f"{self.root}/{f}" for b, f in known["folders"].items() if buckets is None or int(b) in buckets]
        schema = T.StructType.fromJson(known["schema"])
        return self.spark.read.schema(schema).json(folders) if folders else self.spark.createDataFrame([], schema)

    def write(self, **levels: DataFrame) -> None:
        """Replaces the documents of all levels' rows, at every level, and keeps all others.

        A document that has rows at one level loses those of the others unless they are given too.
        """
        manifest = self.manifest()
        unknown = set(manifest["levels"]) - set(levels)
        if unknown:
            raise ValueError(f"levels {sorted(unknown)} are not given")
        fresh = {name: readers.without_non_finite(df) for name, df in levels.items()}
        ids = None
        for df in fresh.values():
            own = df.select(F.col("doc_id").cast("string").alias("doc_id"))
            ids = own if ids is None else ids.union(own)
        ids = ids.distinct()
        touched = {r[0] for r in ids.select(self._bucket().alias("b")).distinct().collect()}  # no more than there are buckets
        folder = f"data-{uuid.uuid4().hex}"
        for name, df in fresh.items():
            rows = df
            if name in manifest["levels"]:
                kept = self.read(name, touched)
                gone = ids.select(F.col("doc_id").alias("_id"))
                rows = kept.join(gone, F.col("doc_id").cast("string") == F.col("_id"), "left_anti").unionByName(df)
            self._put(rows, f"{folder}/{name}")
        done = {"number": manifest["number"] + 1, "levels": {}}
        for name, df in fresh.items():
            before = manifest["levels"].get(name, {}).get("folders", {})
            written = self._written(f"{folder}/{name}")
            folders = {b: f for b, f in before.items() if int(b) not in touched} | written
            done["levels"][name] = {"schema": df.schema.jsonValue(), "folders": folders}
        self._commit(done)

    def update(self, level: str, change: Callable[[DataFrame], DataFrame]) -> None:
        """Reads a level, changes it, and swaps it for what comes out; other levels stay."""
        manifest = self.manifest()
        rows = change(self.read(level))
        folder = f"data-{uuid.uuid4().hex}/{level}"
        self._put(rows, folder)
        manifest["number"] += 1
        manifest["levels"][level] = {"schema": rows.schema.jsonValue(), "folders": self._written(folder)}
        self._commit(manifest)

    def _put(self, rows: DataFrame, folder: str) -> None:
        dealt = rows.withColumn("bucket", self._bucket()).repartition(self.buckets, "bucket")
        dealt.write.partitionBy("bucket").json(f"{self.root}/{folder}")

    def _written(self, folder: str) -> dict[str, str]:
        path, files = self._path(folder)
        names = [x.getPath().getName() for x in files.listStatus(path)] if files.exists(path) else []
        return {n.removeprefix("bucket="): f"{folder}/{n}" for n in names if n.startswith("bucket=")}

    def vacuum(self) -> None:
        """Deletes data that the current manifest does not name, and older manifests; no reader of those may be running."""
        manifest, names = self.manifest(), self._names("manifest-")
        used = {f.split("/")[0] for level in manifest["levels"].values() for f in level["folders"].values()}
        for name in [n for n in self._names("data-") if n not in used] + names[:-1]:
            path, files = self._path(name)
            files.delete(path, True)
