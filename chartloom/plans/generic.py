"""Patient, report and facility of other reports: field tables, then block labels, then the first page's text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.functions import confidence, identity, parse, text
from chartloom.operators import relational as rel

# The fields of each table, and the rule by which a field is normalised.
PATIENT = {"name": ("Patient", None), "patient_id": ("Identifiant", "patient_id"), "birth_date": ("Date de naissance", "birth_date"), "age": ("Age", None), "sex": ("Sexe", "sex"), "address": ("Adresse", None)}
REPORT = {"report_id": ("Numero de rapport", "report_id"), "report_date": ("Date du document", "report_date"), "encounter_type": ("Type de rencontre", "encounter_type"), "prescriber": ("Prescripteur", None), "specialty": ("Specialite", "specialty"), "status": ("Statut", None)}
# Words that are dropped from an analyte's fingerprint.
STOP_WORDS = ("in", "of", "by", "or", "the", "and", "blood", "serum", "plasma", "automated", "count", "direct", "assay", "ae", "ys", "fang", "seni", "ra", "pinema", "ininatedonunt", "janv", "earns")


def source_score(has_table: Column, has_box: Column, block_score: Column) -> Column:
    """0.97 for a table with a place on the page, 0.92 without, the block's own score (0.68 if it has none), 0 for nothing."""
    return F.when(has_table & has_box, 0.97).when(has_table, 0.92).otherwise(F.coalesce(block_score, F.lit(0.0)))


def fields(documents: DataFrame, tables: DataFrame, blocks: DataFrame, pages: DataFrame, wanted: dict, role: str, block_type: str) -> DataFrame:
    """doc_id, each field's raw, canonical value and status, the record's confidence, and ``sources`` (which candidate each field came from).

    tables(doc_id, table_no, table_role, fields map<string,string>, has_box), blocks(doc_id, pos, block_type, text, score),
    pages(doc_id, page_number, native_text).  A field's value comes from the first of table, block and first page that has it; identifiers and
    dates are taken from the first page before a table that has a place on it, as text there is not cut by cells.
    """
    labels = [n for n, _ in wanted.values()]
    table = rel.keep_first(tables.where(F.col("table_role") == role), ["doc_id"], ["table_no"]).select("doc_id", F.col("fields").alias("_t"), "has_box")
    block = rel.keep_first(blocks.where(F.col("block_type") == block_type), ["doc_id"], ["pos"]).select("doc_id", text.find_labels(text.inline(F.col("text")), labels).alias("_b"), F.coalesce("score", F.lit(0.68)).alias("_score"))
    first = pages.where("page_number = 1").select("doc_id", text.find_labels(text.inline(F.col("native_text")), labels).alias("_p"))
    joined = documents.select("doc_id").join(table, "doc_id", "left").join(block, "doc_id", "left").join(first, "doc_id", "left")
    joined = joined.withColumn("_source", source_score(F.col("_t").isNotNull(), F.coalesce("has_box", F.lit(False)), F.col("_score")))
    get = lambda m, n: F.nullif(F.try_element_at(m, n), F.lit(""))
    asked = F.array(*(F.struct(F.lit(shown).alias("shown"), F.lit(rule or "").alias("rule"), F.lit(n.endswith("_date") or n == "age").alias("parsed")) for n, (shown, rule) in wanted.items()))

    def chosen(x: Column) -> Column:
        """The candidates of a field in the order in which they count; what is chosen keeps its source."""
        shown, ruled = x["shown"], x["rule"] != ""
        candidate = lambda source, value, when: F.struct(F.lit(source).alias("source"), F.when(when, value).alias("value"))
        every = F.array(candidate("page", get("_p", shown), ruled & F.coalesce("has_box", F.lit(True))), candidate("table", get("_t", shown), F.lit(True)), candidate("block", get("_b", shown), F.col("_t").isNull()))
        return F.get(F.filter(every, lambda c: c["value"].isNotNull()), F.lit(0))

    def normal(x: Column) -> Column:
        return text.let(chosen(x), lambda c: F.struct(identity.named_by_rule([r for _, r in wanted.values() if r], x["rule"], c["value"]).alias("f"), c["source"].alias("source"), x["parsed"].alias("parsed")))

    joined = joined.withColumn("_n", F.transform(asked, normal))
    scores = F.transform("_n", lambda x: confidence.field_confidence(x["f"]["canonical"], F.col("_source"), x["parsed"])["score"])
    sources = F.map_from_arrays(F.array(*map(F.lit, wanted)), F.transform("_n", lambda x: x["source"]))
    return joined.select("doc_id", *(F.get("_n", F.lit(i))["f"].alias(n) for i, n in enumerate(wanted)), confidence.mean_positive(scores).alias("confidence"), sources.alias("sources"))


def patient(documents: DataFrame, tables: DataFrame, blocks: DataFrame, pages: DataFrame) -> DataFrame:
    found = fields(documents, tables, blocks, pages, PATIENT, "patient_info_table", "patient_info_block")
    return found.withColumn("reported_age", parse.parse_int(F.col("age.canonical"))).withColumn("age_status", F.lit("unknown"))


def report(documents: DataFrame, tables: DataFrame, blocks: DataFrame, pages: DataFrame) -> DataFrame:
    return fields(documents, tables, blocks, pages, REPORT, "report_info_table", "report_info_block")


def facility(blocks: DataFrame) -> DataFrame:
    """doc_id, raw_text, address, phone from the first block of page 1 that names a telephone."""
    first = rel.keep_first(blocks.where((F.col("page_number") == 1) & F.col("text").rlike(r"Tel[. ]")), ["doc_id"], ["pos"])
    shown, pattern = text.inline(F.col("text")), r"^(.*?)\s*-\s*Tel\.?\s*(.*)$"
    part = lambda i: F.nullif(text.inline(F.regexp_extract(shown, pattern, i)), F.lit(""))
    return first.select("doc_id", shown.alias("raw_text"), part(1).alias("address"), part(2).alias("phone"))


def reconciled_validator(validated: DataFrame, reports: DataFrame) -> DataFrame:
    """doc_id, validated_by, specialty: the validator's own fields, else those of the report's prescriber."""
    own = validated.select("doc_id", F.col("validated_by").alias("_v"), F.col("specialty").alias("_s"))
    other = reports.select("doc_id", F.col("prescriber.canonical").alias("_p"), F.col("specialty.canonical").alias("_q"))
    joined = other.join(own, "doc_id", "left")
    return joined.select("doc_id", F.coalesce("_v", "_p").alias("validated_by"), F.coalesce(identity.specialty(F.col("_s")), F.col("_q")).alias("specialty"))


def analyte_fingerprint(name: Column) -> Column:
    """The first six words of a name's label that carry meaning."""
    words = F.array_join(F.slice(F.filter(F.split(text.label(name), "_"), lambda w: ~w.isin(*STOP_WORDS)), 1, 6), "_")
    return F.coalesce(F.nullif(words, F.lit("")), text.label(name))


def points_band(points: Column) -> Column:
    """Label of a quality score of 0 to 10."""
    return F.when(points >= 8, "high").when(points >= 6, "medium").otherwise("low")
