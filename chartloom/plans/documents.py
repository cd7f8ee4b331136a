"""Assembly of documents, type-specific projection, and the whole extraction as one function of DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.functions import text
from chartloom.operators import relational as rel
from chartloom.plans import header as head
from chartloom.plans import hospital, stool
from chartloom.sources import stages
from chartloom.sources.store import DocumentStore


def relative_path(value: Column, root: str) -> Column:
    prefix = root.rstrip("/") + "/"
    return F.when(F.startswith(value, F.lit(prefix)), F.substr(value, F.lit(len(prefix) + 1))).otherwise(value)


def compact_json(*columns: str | Column) -> Column:
    """JSON of the columns; keys without a value are left out."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "true"})


def visual_as_image(visuals: DataFrame) -> DataFrame:
    """Visuals of scanned pages as images, with where they come from."""
    return visuals.select("doc_id", F.col("visual_id").alias("image_id"), "page_number", F.col("visual_type").alias("image_type"), "role", "is_indexable", "bbox", F.lit("ocr_visual").alias("lineage"))


def by_page(pages: DataFrame, assets: dict[str, DataFrame]) -> DataFrame:
    """pages with one array column per kind of asset (empty where a page has none); each asset is grouped before the join."""
    out = pages
    for name, df in assets.items():
        rest = [c for c in df.columns if c not in ("doc_id", "page_number")]
        grouped = df.groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name))
        out = out.join(grouped, ["doc_id", "page_number"], "left").withColumn(name, F.coalesce(name, F.array()))
    return out


def synced_checks(checks: Column, root: Column) -> Column:
    """The root's consistency checks mirror those of the validation report."""
    return F.coalesce(checks, root)


def with_consistency_checks(stored: DataFrame) -> DataFrame:
    """stored(doc_id, document JSON) with the parasite check of each document's own results as its ``consistency_checks``; nothing else in a document changes.

    Results are those of the stool view (section, parameter, result); a document without any is left as it is.
    """
    shape = "struct<results array<struct<section string, parameter string, result string>>>"
    rows = stored.select("doc_id", F.explode(F.from_json("document", shape.removeprefix("struct<").removesuffix(">"))["results"]).alias("r"))
    found = rows.where("r.section is not null").select("doc_id", "r.section", F.col("r.parameter").alias("analyte"), F.col("r.result").alias("value_raw"))
    checks = stool.consistency(found).select("doc_id", F.to_json(F.struct("status", "detected", "message")).alias("_checks"))
    joined = stored.join(checks, "doc_id", "left")
    parts = F.from_json("document", "map<string,variant>")
    rest = F.map_filter(parts, lambda k, _: k != "consistency_checks")
    merged = F.map_concat(rest, F.create_map(F.lit("consistency_checks"), F.parse_json("_checks")))
    return joined.withColumn("document", F.when(F.col("_checks").isNotNull(), F.to_json(merged)).otherwise(F.col("document"))).select(*stored.columns)


def inject_checks(store: DocumentStore, level: str = "documents") -> None:
    """Puts the checks into all stored documents; a run that fails leaves the store as it was."""
    store.update(level, with_consistency_checks)


class Relations(dict):
    """Named relations; each is planned when it is first asked for.  Those named in ``shared`` are used by several others and staged, until ``release``."""

    def __init__(self, makers: dict[str, Callable[["Relations"], DataFrame]], shared: tuple[str, ...] = ()) -> None:
        super().__init__()
        self._makers, self._shared = makers, shared

    def __missing__(self, name: str) -> DataFrame:
        made = self._makers[name](self)
        self[name] = stages.staged(made, name) if name in self._shared else made
        return self[name]

    def release(self) -> None:
        stages.release(*(self.pop(name) for name in self._shared if name in self))


def extract(pages: DataFrame, jitter: bool = False, share: bool = False) -> Relations:
    """pages(doc_id, page_number, final_text, native_text) to documents, header, stool_results, stool_stats, consistency, hospital_results, facility.

    Documents are routed by type: stool reports through the section parser, other hospital reports through running text.
    A document's rows are only ever joined to its own, so everything scales with the number of documents.  With ``share``, for callers that use several relations, texts are cut into
    lines and headers are read once and staged.
    """

    def lines(r: Relations) -> DataFrame:
        return head.document_lines(pages).withColumn("document_type", head.document_type())

    is_stool = F.col("document_type") == "parasitology_stool_report"

    def stool_rows(r: Relations) -> tuple[DataFrame, DataFrame]:
        return stool.results(r["lines"].where(is_stool), r["header"], jitter)

    def found(r: Relations) -> DataFrame:
        dates = r["header"].select(F.col("doc_id").cast("string").alias("doc_id"), head.observation_date(r["header"]).alias("observation_date"))
        return hospital.results(r["lines"].where(~is_stool & head.is_hospital_lab(F.col("first"))), dates)

    return Relations(
        {
            "lines": lines, "documents": lambda r: r["lines"].select("doc_id", "document_type", F.size("pages").alias("page_count")), "header": lambda r: head.header(r["lines"]), "facility": lambda r: head.facility(r["lines"]),
            "stool_results": lambda r: stool_rows(r)[0], "stool_stats": lambda r: stool_rows(r)[1], "consistency": lambda r: stool.consistency(r["stool_results"]), "hospital_results": found,
        },
        shared=("lines", "header", "stool_results") if share else (),
    )


def export(extracted: Relations) -> DataFrame:
    """doc_id, document: one JSON string per document, in the view of its type."""
    from chartloom.plans import pipeline

    return pipeline.export_all(extracted).select("doc_id", "document")
