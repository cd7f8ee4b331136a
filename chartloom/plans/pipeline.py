"""The whole extraction of reports that are neither stool nor hospital reports, and the export of documents of every kind.

Inputs are the relations that adapters deliver: page texts, positioned text blocks, cells of detected tables, images.  Every step joins a document's rows to its own
rows only, so the plan scales with the number of documents; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom import dims
from chartloom.functions import identity, text
from chartloom.plans import documents, generic, ocr_tables, qa, results, segments, stool, tables, visuals
from chartloom.plans import header as head
from chartloom.plans.documents import Relations


def _all_tables(cells: DataFrame, lines: DataFrame) -> DataFrame:
    """Normalised tables without repeats; tables of recognised lines for documents in which no table was detected."""
    native = tables.deduplicated(tables.normalized(cells)).withColumn("from_ocr", F.lit(False)).drop("cells")
    recognised = ocr_tables.distinct_tables(ocr_tables.as_tables(ocr_tables.result_rows(lines)))
    return tables.with_fallback_source(native, recognised)


def _classified(images: DataFrame, blocks: DataFrame) -> DataFrame:
    """images(doc_id, page_number, image_id, xref, bbox, width, height) without scans of whole pages, with context and kind."""
    near = visuals.context(visuals.without_rasters(images), blocks)
    kind = visuals.classify(F.col("page_number"), F.col("width"), F.col("height"), F.col("bbox"), F.col("context_text"))
    return near.withColumn("_k", kind).select("*", "_k.type", "_k.role", "_k.is_indexable").drop("_k")


def extract(pages: DataFrame, blocks: DataFrame, cells: DataFrame, images: DataFrame) -> Relations:
    """documents, tables, images, blocks, patient, report, facility, validation, raw_results, results, stats, validation_report, issues and judged of generic reports.

    pages(doc_id, page_number, final_text, native_text), blocks(doc_id, page_number, pos, text, bbox, source), cells(doc_id, page_number, table_no, table_id, cells),
    images(doc_id, page_number, image_id, xref, bbox, width, height).
    """
    lines = pages.select("doc_id", "page_number", text.lines(F.coalesce(F.nullif("final_text", F.lit("")), F.col("native_text"))).alias("lines"))

    def placed(r: Relations) -> DataFrame:
        return r["blocks"].select("doc_id", "page_number", (F.col("page_number") * 1000 + F.col("place")).alias("pos"), "block_type", "text", "is_indexable", F.col("confidence_score").alias("score"))

    def maps(r: Relations) -> DataFrame:
        info = r["tables"].where("table_role like '%_info_table'")
        return tables.key_values(info).join(info.select("doc_id", "table_id", "table_no", "table_role"), ["doc_id", "table_id"]).withColumn("has_box", F.lit(True))

    def fields(r: Relations) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        return r["documents"], r["maps"], placed(r), pages

    def semantic(r: Relations) -> DataFrame:
        bodies = r["tables"].select("doc_id", "page_number", "table_no", "table_role", tables.as_text(F.col("columns"), F.col("records")).alias("body"))
        return segments.finished(segments.generic_blocks(blocks, bodies, r["images"]))

    def raw(r: Relations) -> DataFrame:
        said = lines.select("doc_id", F.col("page_number").alias("block_no"), "page_number", "lines")
        return results.from_tables_or_lines(r["tables"], said).drop("tier")

    def checked(r: Relations) -> DataFrame:
        none = F.lit(None).cast("string")
        docs = r["documents"].join(r["stats"], "doc_id", "left").join(r["validation_report"].select("doc_id", "consistency_issues", "missing_from_raw"), "doc_id", "left")
        docs = docs.join(r["patient"].select("doc_id", F.col("patient_id.canonical").alias("patient_id")), "doc_id").join(r["report"].select("doc_id", F.col("report_date.canonical").alias("report_date")), "doc_id")
        docs = docs.select(
            "doc_id", F.array(*map(F.lit, dims.REQUIRED_SECTIONS)).alias("keys"), "document_type", "patient_id", none.alias("sample_id"), "report_date", F.coalesce("raw_result_rows", F.lit(0)).alias("raw_rows"), F.coalesce("canonical_result_rows", F.lit(0)).alias("canonical_rows"),
            F.coalesce("duplicate_rows_removed", F.lit(0)).alias("removed_rows"), F.coalesce("consistency_issues", F.lit(0)).alias("consistency_issues"), F.coalesce("missing_from_raw", F.lit(0)).alias("missing_from_raw"), none.alias("checks"), none.alias("root_checks"), none.alias("status"), F.lit(None).cast("map<string,array<string>>").alias("detected"),
        )
        found = r["results"].select(
            "doc_id", F.col("ordinal.i").alias("row"), "result_kind", "analyte", "value_raw", "value_numeric", "unit", F.lit(None).cast("string").alias("section"), "page_number", "observation_date", F.col("reference_range.low").alias("low"), F.col("reference_range.high").alias("high"), "dedup_key", F.col("confidence_score").alias("score")
        )
        return qa.document_issues(docs, found, placed(r), pages.select("doc_id", "page_number", "final_text"))

    def typed(r: Relations) -> DataFrame:
        docs = head.document_lines(pages)
        return docs.select("doc_id", F.size("pages").alias("page_count"), head.document_type().alias("document_type"))

    return Relations(
        {
            "documents": typed, "tables": lambda r: _all_tables(cells, lines), "maps": maps, "images": lambda r: _classified(images, blocks), "blocks": semantic, "patient": lambda r: generic.patient(*fields(r)), "report": lambda r: generic.report(*fields(r)), "facility": lambda r: generic.facility(blocks),
            "validation": lambda r: generic.reconciled_validator(segments.validation_fields(blocks, r["images"]), r["report"]), "raw_results": raw, "results": lambda r: results.canonical(r["raw_results"])[0], "stats": lambda r: results.canonical(r["raw_results"])[1],
            "validation_report": lambda r: results.validation_report(r["results"], r["raw_results"]), "issues": checked, "judged": lambda r: qa.evaluate(r["documents"], r["issues"]),
        },
        shared=("documents", "tables", "maps", "images", "blocks", "patient", "report", "facility", "validation", "raw_results", "results", "stats", "validation_report", "issues", "judged"),
    )


#: Fields of a record as a hospital header has them: field, column, rule of its name.
HEADER_FIELDS = {
    "patient": [("name", "patient", ""), ("patient_id", "patient_id", "patient_id"), ("birth_date", "birth_date", "birth_date"), ("age", "age", ""), ("sex", "sex", "sex"), ("age_consistency_status", "age_status", "")],
    "report": [
        ("exam_name", "exam_name", ""), ("sample_id", "sample_id", ""), ("sample_type", "specimen", ""), ("sample_label", "sample_label", ""), ("request_date", "request_iso", ""), ("received_date", "received_iso", ""), ("edited_date", "edited_iso", ""), ("print_date", "print_iso", ""),
        ("encounter_type", "origin", "encounter_type"), ("prescriber", "prescriber", ""), ("specialty", "specialty", "specialty"),
    ],
    "validation": [("validated_by", "validated_by", ""), ("edited_by", "edited_by", ""), ("printed_by", "printed_by", ""), ("actor_status", "validation_actor_status", "")],
}


def _normal_fields(rows: DataFrame) -> DataFrame:
    """rows(doc_id, document_type, record, field, rule, value, source) with the value as raw, canonical and status, by the rule of its field; fields without a value fall out."""
    rules = [rule for fields in HEADER_FIELDS.values() for *_, rule in fields if rule]
    named = rows.where("coalesce(value, '') <> ''").withColumn("_f", identity.named_by_rule(rules, F.col("rule"), F.col("value")))
    return named.select("doc_id", "document_type", "record", "field", "_f.raw", "_f.canonical", "_f.normalization_status", "source")


def records(extracted: Relations, generic_reports: Relations) -> DataFrame:
    """doc_id, document_type, record (patient, report, validation), field, raw, canonical, normalization_status, source: the records of documents of every kind as one relation.

    Stool and hospital reports have their fields from the header (``extracted`` of ``documents.extract``), all others from tables, blocks and the first page (``generic_reports`` of
    ``extract``), whose validator is the one under the validation title, else the report's prescriber.  A document's kind decides which of the two it is in; each field keeps where it came from.
    """
    kinds = extracted["documents"].select("doc_id", "document_type")
    headed = extracted["header"].join(kinds, "doc_id")
    every = F.array(*(F.struct(F.lit(record).alias("record"), F.lit(field).alias("field"), F.lit(rule).alias("rule"), F.col(column).cast("string").alias("value")) for record, fields in HEADER_FIELDS.items() for field, column, rule in fields))
    from_header = _normal_fields(headed.select("doc_id", "document_type", F.explode(every).alias("x")).select("doc_id", "document_type", "x.*", F.lit("header").alias("source")))

    def of(record: str, wanted: dict) -> DataFrame:
        held = F.array(*(F.struct(F.lit(f).alias("field"), *(F.col(f"{f}.{c}").alias(c) for c in ("raw", "canonical", "normalization_status")), F.try_element_at("sources", F.lit(f)).alias("source")) for f in wanted))
        rows = generic_reports[record].select("doc_id", F.explode(held).alias("x")).select("doc_id", F.lit(record).alias("record"), "x.*")
        return rows.where("raw is not null")

    signed = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("raw"), F.col(f).alias("canonical"), F.lit("as_extracted").alias("normalization_status"), F.lit("block").alias("source")) for f in ("validated_by", "specialty")))
    validators = generic_reports["validation"].select("doc_id", F.lit("validation").alias("record"), F.explode(signed).alias("x")).select("doc_id", "record", "x.*").where("raw is not null")
    others = of("patient", generic.PATIENT).unionByName(of("report", generic.REPORT)).unionByName(validators).join(generic_reports["documents"].select("doc_id", "document_type"), "doc_id")
    return from_header.unionByName(others)


def _listed(rows: DataFrame, order: list[str], columns: list[str | Column], name: str) -> DataFrame:
    """One array of structs per document, in order."""
    item = F.struct(F.struct(*order).alias("o"), F.struct(*columns).alias("v"))
    by_order = lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)  # noqa: E731  values may hold maps, which have no order
    return rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(item), by_order), lambda x: x["v"]).alias(name))


def export(r: Relations) -> DataFrame:
    """doc_id, document: one JSON string per generic report; parts that a document lacks are left out."""
    score = ["confidence", "confidence_score"]
    found = _listed(r["results"], ["page_number", "row_index"], ["analyte", "value_raw", "value_numeric", "unit", "reference_range", "observation_date", "result_kind", *score, "duplicate_sources"], "results")
    shown = _listed(r["blocks"], ["block_id"], ["block_id", "block_type", "section_title", "text", "index_text", "page_number", "is_indexable", *score], "blocks")
    kept = _listed(r["tables"], ["table_no"], ["table_id", "page_number", "table_role", "is_indexable", "columns"], "tables")
    seen = _listed(r["images"], ["image_id"], ["image_id", "page_number", "type", "role", "is_indexable", "context_text"], "images")
    part = lambda name, *columns: r[name].select("doc_id", F.struct(*columns).alias(name))
    canonical = lambda *names: [F.col(f"{n}.canonical").alias(n) for n in names]
    out = r["documents"]
    for side in (
        part("patient", *canonical("name", "patient_id", "birth_date", "sex", "address"), "reported_age"), part("report", *canonical("report_id", "report_date", "encounter_type", "prescriber", "specialty", "status")), part("facility", "raw_text", "address", "phone"),
        part("validation", "validated_by", "specialty"), part("validation_report", "results", "matched", "missing_from_raw", "raw_only", "consistency_issues"), part("judged", "status", "score"), found, shown, kept, seen,
    ):
        out = out.join(side, "doc_id", "left")
    return out.select("doc_id", documents.compact_json("document_type", "page_count", "patient", "report", "facility", "validation", "results", "blocks", "tables", "images", "validation_report", "judged").alias("document"))


#: Fields of a stool report's blocks that come from its header and facility: name of the field and the column that holds it.
FACILITY_FIELDS = ["country", "ministry", "organization", "department", "laboratory", "website", "phone", "fax"]
PATIENT_FIELDS = {
    "patient_id": "patient_id", "patient_name": "patient", "birth_date": "birth_iso", "reported_age": "reported_age", "computed_age_at_request_date": "computed_age", "age_consistency_status": "age_status", "sex": "sex", "origin": "origin", "service": "service", "prescriber": "prescriber",
    "request_date": "request_iso", "received_date": "received_iso", "sample_id": "sample_id", "sample_type": "specimen", "sample_label": "sample_label",
}
METADATA_FIELDS = {
    "exam_name": "exam_name", "sample_id": "sample_id", "request_date": "request_iso", "received_date": "received_iso", "origin": "origin", "service": "service", "prescriber": "prescriber", "sample_type": "specimen", "sample_label": "sample_label", "print_date": "print_iso", "printed_by": "printed_by",
    "edited_date": "edited_iso", "edited_by": "edited_by",
}
SAMPLE_FIELDS = {"exam_name": "exam_name", "sample_id": "sample_id", "sample_type": "specimen"}
EDITION_FIELDS = {"edited_by": "edited_by", "edited_date": "edited_iso", "printed_by": "printed_by", "print_date": "print_iso"}
_SOURCE = "native_text_section_parser"


def block_fields(extracted: Relations) -> DataFrame:
    """doc_id, block_type, structured_fields (a JSON object): what each of the ten blocks of a stool report holds as named values; names without a value are left out.

    One row per document carries header, facility and results (its own only), and its ten objects are expressions over that row.
    """
    view = stool.result_view(extracted["stool_results"])
    rows = _listed(view, ["row_index"], [c for c in view.columns if c != "doc_id"], "_results")
    head_row = extracted["header"].withColumn("patient_id", F.col("patient_field.canonical"))
    place = extracted["facility"].select("doc_id", F.struct(*FACILITY_FIELDS).alias("_facility"))
    docs = extracted["documents"].where("document_type = 'parasitology_stool_report'").select("doc_id").join(head_row, "doc_id", "left").join(place, "doc_id", "left").join(rows, "doc_id", "left")
    source = F.lit(_SOURCE).alias("source")
    named = lambda fields: documents.compact_json(*(F.col(c).alias(n) for n, c in fields.items()), source)
    of = lambda section: F.filter("_results", lambda r: r["section"] == section)
    listed = lambda section: documents.compact_json(F.coalesce(of(section), F.expr("slice(_results, 1, 0)")).alias("results"), F.coalesce(F.size(of(section)), F.lit(0)).alias("result_count"), source)
    single = lambda section: documents.compact_json(F.get(of(section), F.lit(0)).alias("result"), source)
    last = F.get(of("final_result"), F.lit(0))
    objects = {
        "facility_block": documents.compact_json(*(F.col(f"_facility.{c}").alias(c) for c in FACILITY_FIELDS), source),
        "patient_info_block": named(PATIENT_FIELDS),
        "report_metadata_block": named(METADATA_FIELDS),
        "sample_block": documents.compact_json(*(F.col(c).alias(n) for n, c in SAMPLE_FIELDS.items()), F.coalesce(F.nullif("sample_label", F.lit("")), F.lit("SELLES N°1")).alias("sample_label"), source),
        "macroscopic_exam_block": listed("macroscopic_exam"),
        "microscopic_exam_block": listed("microscopic_exam"),
        "enrichment_exam_block": single("enrichment_exam"),
        "staining_exam_block": single("staining_exam"),
        "final_result_block": documents.compact_json(F.lit("RÉSULTAT FINAL").alias("parameter"), last["result"].alias("result"), last["result_kind"].alias("result_kind"), last["clinical_significance"].alias("clinical_significance"), source),
        "edition_block": named(EDITION_FIELDS),
    }
    return docs.select("doc_id", F.explode(F.map_from_arrays(F.array(*map(F.lit, objects)), F.array(*objects.values()))).alias("block_type", "structured_fields"))


def projected_blocks(extracted: Relations) -> DataFrame:
    """The blocks of stool reports with their structured fields; a block that has some shows its plain text as normalised and as index text."""
    pages = extracted["lines"].where("document_type = 'parasitology_stool_report'").select("doc_id", F.explode("pages").alias("p")).select("doc_id", "p.page_number", "p.lines", F.lit("native").alias("text_source"))
    found = segments.finished(segments.stool_blocks(pages)).join(block_fields(extracted), ["doc_id", "block_type"], "left")
    has = F.col("structured_fields").isNotNull()
    return found.withColumn("normalized_text", F.when(has, F.col("text"))).withColumn("index_text", F.when(has, F.col("text")).otherwise(F.col("index_text")))


def export_all(extracted: Relations) -> DataFrame:
    """doc_id, document: one JSON string per document of ``documents.extract``, stool and hospital reports and all others, each in the view of its type.

    A stool report's blocks stand in the document and again in its pages, both with their fields.
    """
    view = stool.result_view(extracted["stool_results"])
    stool_rows = _listed(view, ["row_index"], [c for c in view.columns if c != "doc_id"], "stool_results")
    numbers = _listed(extracted["hospital_results"], ["ordinal"], ["analyte", "value_raw", "value_numeric", "unit", "reference_range", "result_kind", "observation_date", "page_number"], "results")
    shown = ["block_id", "block_type", "section_title", "text", "normalized_text", "index_text", "page_number", "is_indexable", "confidence", "confidence_score", F.parse_json("structured_fields").alias("structured_fields")]
    blocks = _listed(projected_blocks(extracted), ["block_id"], shown, "blocks")
    patient = F.struct(F.col("patient").alias("name"), F.col("patient_field.canonical").alias("patient_id"), F.col("birth_iso").alias("birth_date"), "age", "age_status", "sex")
    report = F.struct("exam_name", "sample_id", "sample_label", F.col("request_iso").alias("request_date"), F.col("received_iso").alias("received_date"), F.col("edited_iso").alias("edited_date"), "edited_by", "prescriber", "encounter_type", "validation_actor_status")
    headed = extracted["header"].select("doc_id", patient.alias("patient"), report.alias("report"))
    checks = extracted["consistency"].select("doc_id", F.struct("status", "detected", "message").alias("consistency_checks"))
    place = extracted["facility"].select("doc_id", F.struct("country", "organization", "department", "laboratory", "phone").alias("facility"))
    numbered = extracted["lines"].select("doc_id", F.transform("pages", lambda p: p["page_number"]).alias("_numbers"))
    out = extracted["documents"]
    for side in (headed, place, stool_rows, numbers, blocks, checks, numbered):
        out = out.join(side, "doc_id", "left")
    pages = F.transform("_numbers", lambda n: F.struct(n.alias("page_number"), F.filter("blocks", lambda b: b["page_number"] == n).alias("blocks")))
    stool_part = F.col("document_type") == "parasitology_stool_report"
    parts = lambda *columns: documents.compact_json("document_type", "page_count", "patient", "report", "facility", *columns)
    document = F.when(stool_part, parts(F.col("stool_results").alias("results"), "blocks", pages.alias("pages"), "consistency_checks")).otherwise(parts("results"))
    return out.select("doc_id", "document_type", document.alias("document"))
