"""Canonical laboratory results: records and lines to raw results, repair, ranked choice, reliability, confidence, lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.functions import confidence, identity, parse, text
from chartloom.operators import relational as rel
from chartloom.sources import stages

# Misreadings that make an analyte suspect; columns of a results table.
SUSPECT = ("ininatedonunt", "pinema", "sarin", "iid", "fang", "seni", "ainantiali", "earns")
COLUMNS = {"analyte": "Analyse / Observation", "value": "Resultat", "unit": "Unites", "reference": "Valeurs de reference", "date": "Date", "corrected": "Correction OCR appliquee", "ocr_value": "Resultat OCR brut", "reason": "Raison normalisation"}
INFERRED = "decimal inferred from reference range and expected numeric format"
QUALITATIVE = ("qualitative", "pathogen_identification", "microscopy_finding")


def _raw(base: DataFrame) -> DataFrame:
    """Adds the fields of raw results to doc_id, ordinal, page_number, table_id, row_index, analyte, value, unit_text, reference_text, date_text, from_ocr, kind."""
    from_ocr, kind, more = F.col("from_ocr"), F.col("kind"), [c for c in ("tier",) if c in base.columns]
    reference = parse.reference_range(F.col("reference_text"))
    base = base.withColumn("reference_range", reference).withColumn("_ocr", from_ocr)
    base = base.withColumn("_fix", parse.repair_numeric(F.col("value"), F.col("reference_range.low"), F.col("reference_range.high")))
    fixed = F.col("_ocr") & F.col("_fix.repaired")
    unit, date = identity.named_field("unit", F.col("unit_text")), identity.named_field("observation_date", F.col("date_text"))
    applied = F.coalesce(F.col("corrected"), F.lit(False)) | fixed
    return base.withColumn("_u", unit).withColumn("_d", date).select(
        "doc_id", "ordinal", "page_number", F.col("page_number").alias("source_page_number"), F.col("table_id").alias("source_table_id"), kind.alias("source_kind"), "row_index", text.ocr_analyte(F.col("analyte")).alias("analyte"),
        F.when(fixed, F.col("_fix.value_raw")).otherwise(text.inline(F.col("value"))).alias("value_raw"), F.when(fixed, F.col("_fix.value_numeric")).otherwise(parse.parse_float(F.col("value"))).alias("value_numeric"),
        F.col("_u.raw").alias("unit_raw"), parse.normalize_unit(F.col("_u.canonical")).alias("unit"), F.col("_u.normalization_status").alias("unit_normalization_status"), "reference_range",
        F.col("_d.raw").alias("observation_date_raw"), F.col("_d.canonical").alias("observation_date"), F.col("_d.normalization_status").alias("observation_date_normalization_status"), applied.alias("ocr_correction_applied"),
        F.when(F.col("corrected"), F.col("ocr_value")).when(fixed, text.inline(F.col("value"))).alias("raw_ocr_value"), F.when(applied, F.coalesce("reason", F.lit(INFERRED))).alias("normalization_reason"), F.lit("numeric").alias("result_kind"), *more,
    )


def _table_rows(tables: DataFrame) -> DataFrame:
    """tables(doc_id, table_no, table_id, page_number, table_role, from_ocr, records array<map<string,string>>): raw results of the results tables."""
    rows = tables.where("table_role = 'results_table'").select("doc_id", "table_no", "table_id", "page_number", "from_ocr", F.posexplode("records").alias("i", "record"))
    cell = lambda k: F.coalesce(F.try_element_at("record", F.lit(COLUMNS[k])), F.lit(""))
    return rows.select(
        "doc_id", F.struct("table_no", "i").alias("ordinal"), "page_number", "table_id", (F.col("i") + 1).alias("row_index"), cell("analyte").alias("analyte"), cell("value").alias("value"), cell("unit").alias("unit_text"), cell("reference").alias("reference_text"),
        cell("date").alias("date_text"), (F.lower(cell("corrected")) == "true").alias("corrected"), F.nullif(cell("ocr_value"), F.lit("")).alias("ocr_value"), F.nullif(cell("reason"), F.lit("")).alias("reason"), "from_ocr",
        F.when(F.col("from_ocr"), "ocr_results_table").otherwise("results_table").alias("kind"),
    )


def _line_rows(blocks: DataFrame) -> DataFrame:
    """blocks(doc_id, block_no, page_number, lines array<string>): raw results of the lines that read as results.

    Lines are taken as they are, before a block's text is put on one line.
    """
    rows = blocks.select("doc_id", "block_no", "page_number", F.posexplode("lines").alias("i", "line")).withColumn("p", parse.parse_result_line(F.col("line"))).where("p.analyte is not null")
    none = F.lit(None).cast("string")
    return rows.select(
        "doc_id", F.struct(F.col("block_no").alias("table_no"), "i").alias("ordinal"), "page_number", none.alias("table_id"), (F.col("i") + 1).alias("row_index"), "p.analyte", F.col("p.value_raw").alias("value"), F.col("p.unit").alias("unit_text"),
        F.col("p.reference").alias("reference_text"), F.col("p.observation_date").alias("date_text"), F.lit(False).alias("corrected"), none.alias("ocr_value"), none.alias("reason"),
        F.lit(True).alias("from_ocr"), F.lit("ocr_derived_text").alias("kind"),
    )


def from_tables(tables: DataFrame) -> DataFrame:
    return _raw(_table_rows(tables))


def from_lines(blocks: DataFrame) -> DataFrame:
    return _raw(_line_rows(blocks))


def from_tables_or_lines(tables: DataFrame, blocks: DataFrame) -> DataFrame:
    """Raw results of a document's tables, of its lines where it has none (``tier`` 1 or 2); what follows the choice is planned once."""
    return _raw(with_fallback([_table_rows(tables), _line_rows(blocks)]))


def dedup_key() -> Column:
    return F.concat_ws("|", text.label(F.col("analyte")), F.coalesce("observation_date", F.lit("")), F.coalesce("value_raw", F.lit("")), F.coalesce("unit", F.lit("")))


def quality_points() -> Column:
    """0 to 10: name +2, nothing suspect in it +2, known unit +2 (another -3), valid range +2, value in it or flagged by it +2, range by context +1."""
    low, high, value = F.col("reference_range.low"), F.col("reference_range.high"), F.col("value_numeric")
    valid = F.coalesce(high >= low, F.lit(False))
    # a value outside the range agrees with the flag that is inferred from that very range
    points = text.let(text.label(F.col("analyte")), lambda key: F.when(key != "", 2.0).otherwise(0.0) + F.when((key != "") & ~key.rlike("|".join(SUSPECT)), 2.0).otherwise(0.0))
    points += F.when(parse.is_known_unit(F.col("unit")), 2.0).when(F.coalesce("unit", F.lit("")) != "", -3.0).otherwise(0.0)
    points += F.when(valid, F.when(value.isNotNull(), 4.0).otherwise(2.0)).when(F.col("reference_range.text") == "Selon contexte", 1.0).otherwise(0.0)
    return points


def is_reliable(points: Column) -> Column:
    name = F.col("analyte")
    unknown = ~parse.is_known_unit(F.col("unit")) & ~F.coalesce(F.col("reference_range.text") == "Selon contexte", F.lit(False))

    def bad(key: Column) -> Column:
        single = (F.size(F.split(key, "_")) < 2) & ~key.isin("body_height", "body_weight")
        return (key == "") | key.isin("pinema", "plasma") | key.startswith("automated_count") | name.rlike(r"\[.*\[") | single | unknown | (key.rlike("|".join(SUSPECT)) & (points < 8.0)) | (points < 4.5)

    return ~text.let(text.label(name), bad)


def canonical(raw: DataFrame, share: bool = False) -> tuple[DataFrame, DataFrame]:
    """(reliable canonical results, stats): of equal results the one from the best source, most complete, on the earliest page and row.

    ``duplicate_sources`` lists the others in the order in which they lost.  With ``share``, for callers that use both, the results are staged.
    """
    completeness = sum((F.when(F.coalesce(F.col(c), F.lit("")) != "", 1).otherwise(0) for c in ("analyte", "observation_date", "value_raw", "unit", "reference_range.text")), F.lit(0))
    priority = F.when(F.col("source_kind") == "results_table", 3).when(F.col("source_kind") == "ocr_results_table", 2).otherwise(1)
    first = lambda c: -F.coalesce(F.nullif(F.col(c), F.lit(0)), F.lit(999))
    keyed = raw.withColumn("dedup_key", dedup_key()).withColumn("_points", quality_points())
    source = F.struct("source_table_id", "source_page_number", "source_kind", "row_index")
    best = rel.ranked_dedup(keyed, ["doc_id", "dedup_key"], [priority, completeness, first("source_page_number"), first("row_index"), F.col("_points")], "ordinal", source)
    kept = best.where(is_reliable(F.col("_points")))
    score = confidence.rounded(F.col("_points") / 10)
    score = F.when(F.col("source_kind").startswith("ocr_"), F.least(score, F.lit(0.92))).otherwise(score)
    score = F.when(F.col("ocr_correction_applied"), F.least(score, F.lit(0.88))).otherwise(score)
    kept = kept.withColumn("confidence_score", score).withColumn("confidence", confidence.band(score)).withColumn("is_canonical", F.lit(True))
    parsed = {"analyte": False, "value_raw": False, "value_numeric": True, "unit": False, "reference_range.text": False, "observation_date": True}
    fields = F.map_from_arrays(F.array(*(F.lit(c.split(".")[0]) for c in parsed)), F.array(*(confidence.field_confidence(F.col(c), F.col("confidence_score"), p) for c, p in parsed.items())))
    kept = kept.withColumn("field_confidence", fields).drop("_points")
    kept = stages.staged(kept, "canonical_results") if share else kept
    counts = raw.groupBy("doc_id").agg(F.count("*").alias("raw_result_rows")).join(kept.groupBy("doc_id").agg(F.count("*").alias("canonical_result_rows")), "doc_id", "left").na.fill(0)
    return kept, counts.withColumn("duplicate_rows_removed", F.greatest(F.lit(0), F.col("raw_result_rows") - F.col("canonical_result_rows")))


def consistency_issues() -> Column:
    """array of issue codes of a result; kinds without a number have none."""
    low, high, value = F.col("reference_range.low"), F.col("reference_range.high"), F.col("value_numeric")
    found = F.when(value.isNull(), F.lit("missing_numeric_value")).when(high < low, F.lit("invalid_reference_range"))
    return F.when(F.col("result_kind").isin(*QUALITATIVE), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(found)))


def signature() -> Column:
    return F.struct(text.label(F.col("analyte")).alias("a"), F.coalesce("value_raw", F.lit("")).alias("v"), F.coalesce("unit", F.lit("")).alias("u"))


def validation_report(kept: DataFrame, raw: DataFrame) -> DataFrame:
    """doc_id, results, matched, missing_from_raw, raw_only, consistency_issues: canonical results against raw ones by signature."""
    k = kept.select("doc_id", signature().alias("s"), F.size(consistency_issues()).alias("issues"))
    r = raw.select("doc_id", signature().alias("s")).distinct()
    matched = k.join(r, ["doc_id", "s"], "left_semi").groupBy("doc_id").agg(F.count("*").alias("matched"))
    missing = k.join(r, ["doc_id", "s"], "left_anti").groupBy("doc_id").agg(F.count("*").alias("missing_from_raw"))
    extra = r.join(k, ["doc_id", "s"], "left_anti").groupBy("doc_id").agg(F.count("*").alias("raw_only"))
    base = k.groupBy("doc_id").agg(F.count("*").alias("results"), F.sum("issues").alias("consistency_issues"))
    return base.join(matched, "doc_id", "left").join(missing, "doc_id", "left").join(extra, "doc_id", "left").na.fill(0)


def with_fallback(relations: list[DataFrame]) -> DataFrame:
    """Results of the first source that has any for a document: tables, then blocks, then hospital text."""
    return rel.fallback_union(relations, "doc_id")
