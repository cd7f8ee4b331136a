"""Stool report: section parser, result semantics, parasite consistency, logical table and views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chartloom import dims
from chartloom.functions import confidence, parse, text
from chartloom.operators import relational as rel
from chartloom.plans import header as head

# Titles of the final result, words that are values and not names.
FINAL_TITLES = ("resultat_final", "resulat_final")
VALUE_WORDS = ("absence", "presence", "negatif", "marron", "molle", "assez_nombreux")
ORDER = {s: i for i, s in enumerate(dims.STOOL_SECTIONS)}
_ROW = "struct<section:string,name:string,value:string,line_start:int,line_end:int>"


def _section_at(labels: Column, title: str) -> Column:
    """0-based place of the first of the lines' labels that contains the title's; null if there is none."""
    key = title.lower().replace("è", "e").replace("é", "e").replace(" ", "_")
    return F.array_min(F.filter(F.transform(labels, lambda x, i: F.when(x.contains(key), i)), lambda i: i.isNotNull()))


def _is_false(section: Column, name: Column, value: Column) -> Column:

    def disguised(x: Column) -> Column:
        key, said = x["key"], x["said"]
        return (key == "") | name.startswith(":") | key.isin("examen_macroscopique", "examen_microscopique", *VALUE_WORDS) | ((section != "final_result") & key.isin(*FINAL_TITLES)) | ((key == "resultat_final") & (said == "resultat_final"))

    return text.let(F.struct(text.label(name).alias("key"), text.label(value).alias("said")), disguised)


def semantics(section: Column, name: Column, value: Column) -> Column:
    """struct(result_kind, meaning, abnormal) of a result; the first rule that applies counts."""
    out = lambda kind, meaning, abnormal: F.struct(F.lit(kind).alias("result_kind"), F.lit(meaning).alias("meaning"), (abnormal if isinstance(abnormal, Column) else F.lit(abnormal)).alias("abnormal"))

    def meant(x: Column) -> Column:
        key, said = x["key"], x["said"]
        many = said == "assez_nombreux"
        return (
            F.when(section == "final_result", out("pathogen_identification", "pathogen_detected", ~said.isin("negatif", "absence")))
            .when((section == "staining_exam") & said.rlike("oeufs|parasite|ankylostoma|trichuris"), out("microscopy_finding", "parasite_elements_detected", True))
            .when((key == "leucocytes") & many, out("microscopy_finding", "inflammatory_finding", True))
            .when((key == "hematies") & many, out("microscopy_finding", "blood_cells_detected", True))
            .when(key.isin("glaire", "pus") & (said == "presence"), out("qualitative", "positive_finding", True))
            .when(section == "microscopic_exam", out("microscopy_finding", "normal_or_absent_finding", False))
            .otherwise(out("qualitative", "not_significant_or_expected", False))
        )

    return text.let(F.struct(text.label(name).alias("key"), text.label(value).alias("said")), meant)


def _paired(section: str, start: Column, end: Column) -> Column:
    part = F.slice("first", start + 2, F.greatest(end - start - 1, F.lit(0)))
    rows = F.transform(rel.pair_lines(part), lambda p: F.struct(F.lit(section).alias("section"), p["name"].alias("name"), p["value"].alias("value"), (p["at"] + start + 2).alias("line_start"), (p["at"] + start + 3).alias("line_end")))
    return F.when(start.isNotNull() & end.isNotNull(), rows).otherwise(F.array().cast(f"array<{_ROW}>"))


def _following(section: str, start: Column) -> Column:
    after = F.get("first", start + 1)
    row = F.struct(F.lit(section).alias("section"), F.lit(dims.STOOL_SECTIONS[section]).alias("name"), after.alias("value"), (start + 1).alias("line_start"), (start + 2).alias("line_end"))
    return F.when(after.isNotNull(), F.array(row)).otherwise(F.array().cast(f"array<{_ROW}>"))


def _final(start: Column) -> Column:
    """The first of the four lines after the title that says something and is not the title again."""
    four = F.transform(F.slice("first", start + 2, 4), lambda x, i: F.struct(text.strip(F.regexp_replace(x, "^:+", "")).alias("value"), i.alias("i")))
    said = F.get(F.filter(four, lambda x: (x["value"] != "") & ~text.label(x["value"]).isin(*FINAL_TITLES)), F.lit(0))
    title = dims.STOOL_SECTIONS["final_result"]
    row = F.struct(F.lit("final_result").alias("section"), F.lit(title).alias("name"), said["value"].alias("value"), (start + 1).alias("line_start"), (start + said["i"] + 2).alias("line_end"))
    return F.when(said.isNotNull(), F.array(row)).otherwise(F.array().cast(f"array<{_ROW}>"))


def results(docs: DataFrame, headers: DataFrame, jitter: bool = False) -> tuple[DataFrame, DataFrame]:
    """(accepted results in order, stats per document) from the first page's sections.

    Repeated results (section, name and value alike) count once; rows that are titles or values in disguise are counted as false positives.
    """
    at = {s: F.col(f"_{s}") for s in dims.STOOL_SECTIONS}
    keyed = rel.worked_out(docs.select("doc_id", "first", F.element_at("pages", 1)["page_number"].alias("page_number")), "_keys", F.transform("first", text.label))
    found = keyed.select("doc_id", "first", "page_number", *(_section_at(F.col("_keys"), t).alias(f"_{s}") for s, t in dims.STOOL_SECTIONS.items()))
    rows = F.concat(
        _paired("macroscopic_exam", at["macroscopic_exam"], at["microscopic_exam"]), _paired("microscopic_exam", at["microscopic_exam"], at["enrichment_exam"]), _following("enrichment_exam", at["enrichment_exam"]),
        _following("staining_exam", at["staining_exam"]), _final(at["final_result"]),
    )
    parsed = found.select("doc_id", "page_number", F.posexplode(rows).alias("ordinal", "r")).select("doc_id", "page_number", "ordinal", "r.*")
    parsed = parsed.withColumn("analyte", F.btrim(text.inline(F.col("name")), F.lit(": "))).withColumn("value_raw", text.strip(F.regexp_replace(text.inline(F.col("value")), "^:+", "")))
    parsed = rel.worked_out(parsed, "_false", _is_false(F.col("section"), F.col("analyte"), F.col("value_raw")))
    parsed = parsed.withColumn("dedup_key", F.concat_ws("|", text.label(F.col("section")), text.label(F.col("analyte")), text.label(F.col("value_raw"))))
    accepted = rel.keep_first(parsed.where("not _false"), ["doc_id", "dedup_key"], ["ordinal"])
    dates = headers.select("doc_id", parse.parse_iso_date(F.coalesce("request_date", "edited_date")).alias("observation_date"))
    accepted = accepted.join(dates, "doc_id", "left").withColumn("row_index", F.row_number().over(Window.partitionBy("doc_id").orderBy("ordinal")))
    titles = parse.look_up(dims.STOOL_SECTIONS, F.col("section"))
    score = confidence.extraction_confidence(F.concat_ws(" ", titles, "analyte", "value_raw"), F.lit("native"), field_length=F.length("value_raw"), jitter=jitter)
    out = accepted.withColumn("_s", semantics(F.col("section"), F.col("analyte"), F.col("value_raw"))).select(
        "doc_id", "row_index", "section", titles.alias("section_name"), "analyte", "value_raw", F.lit(None).cast("double").alias("value_numeric"), F.lit("qualitative").alias("unit"), "observation_date", "page_number",
        F.col("line_start").alias("source_line_start"), F.col("line_end").alias("source_line_end"), F.lit("parasitology_section_parser").alias("source_kind"), "_s.result_kind", "_s.meaning", "_s.abnormal", score.alias("confidence_score"),
        confidence.band(score).alias("confidence"), "dedup_key", F.lit(True).alias("is_canonical"),
    )
    counted = parsed.groupBy("doc_id").agg(F.count("*").alias("raw_result_rows"), F.count_if("_false").alias("false_positive_result_rows"))
    kept = accepted.groupBy("doc_id").agg(F.count("*").alias("canonical_result_rows"), F.count_distinct("section").alias("section_count"))
    stats = counted.join(kept, "doc_id", "left").na.fill(0).withColumn("duplicate_rows_removed", F.col("raw_result_rows") - F.col("false_positive_result_rows") - F.col("canonical_result_rows"))
    return out, stats.withColumn("expected_section_count", F.lit(len(dims.STOOL_SECTIONS)))


def entities(value: Column) -> Column:
    """Sorted parasite names in a text; a genus gives way to its species."""
    plain = F.replace(text.label(F.coalesce(value, F.lit(""))), F.lit("_"), F.lit(" "))
    named = F.array_compact(F.array(*(F.when(plain.rlike("|".join(p)), F.lit(n)) for n, p in dims.PARASITES.items())))
    redundant = F.array_compact(F.array(*(F.when(F.array_contains(named, s), F.lit(g)) for s, g in dims.GENUS_OF.items())))
    return F.array_sort(F.array_except(named, redundant))


MESSAGES = {
    "consistent": "The final result agrees with what earlier sections found.", "needs_review": "Earlier sections name a parasite, the final result does not.",
    "partial_overlap": "The final result and earlier sections share some parasites, not all.", "discordant_findings": "The final result names other parasites than the earlier sections.",
}


def consistency(found: DataFrame) -> DataFrame:
    """doc_id, status, detected (section to names), message: parasites of the final result against those of earlier sections."""
    watched = ("staining_exam", "enrichment_exam", "microscopic_exam", "final_result")
    named = found.select("doc_id", "section", entities(F.concat_ws(" ", "analyte", "value_raw")).alias("names"))
    sets = named.groupBy("doc_id").agg(*(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("section") == s, F.col("names")))))).alias(s) for s in watched))
    earlier = F.array_distinct(F.concat(*watched[:3]))
    judged = sets.withColumn("status", rel.set_agreement(F.col("final_result"), earlier))
    detected = F.map_from_arrays(F.array(*map(F.lit, watched)), F.array(*watched))
    return judged.select("doc_id", "status", detected.alias("detected"), parse.look_up(MESSAGES, F.col("status")).alias("message"))


def result_view(found: DataFrame) -> DataFrame:
    """The stool report's view of its results: parameter and result instead of analyte and value."""
    return found.select(
        "doc_id", "row_index", F.col("analyte").alias("parameter"), F.col("value_raw").alias("result"), "section", "section_name", "result_kind", F.col("meaning").alias("clinical_significance"), "abnormal", "observation_date",
        F.col("page_number").alias("source_page_number"), "source_line_start", "source_line_end", "confidence", "confidence_score", "dedup_key", "is_canonical",
    )


def logical_table(found: DataFrame, preview: int = 5) -> DataFrame:
    """One logical table per document: its results as records, the first few as preview; the column count follows from the columns."""
    columns = ["section", "parameter", "result", "result_kind"]
    record = F.struct("row_index", F.struct(F.col("section_name").alias("section"), F.col("analyte").alias("parameter"), F.col("value_raw").alias("result"), "result_kind").alias("r"))
    rows = found.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(record)), lambda x: x["r"]).alias("records"))
    return rows.select("doc_id", F.lit("logical_results_p001_01").alias("table_id"), F.lit("parasitology_results").alias("table_role"), F.array(*map(F.lit, columns)).alias("columns"), F.size("records").alias("row_count"), F.lit(len(columns)).alias("column_count"), "records", F.slice("records", 1, preview).alias("preview"))


def projected_records(records: DataFrame, found: DataFrame) -> DataFrame:
    """records(doc_id, section, parameter, result, result_kind) of logical tables with the kind of the result that they show.

    A record names its section by code or by title; of the results (doc_id, row_index, section, section_name, parameter, result, result_kind) that fit one key the last counts, and its kind replaces the record's own.
    """
    parts = [F.col("parameter"), F.col("result")]
    matched = rel.two_key_match(records, found, ["doc_id"], [[F.col("section"), *parts], [F.col("section_name"), *parts]], ["section", "parameter", "result"], "result_kind", "row_index")
    return matched.withColumn("result_kind", F.when(F.col("matched"), F.col("result_kind_found")).otherwise(F.col("result_kind"))).drop("result_kind_found")
