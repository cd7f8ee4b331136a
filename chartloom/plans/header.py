"""Header of a hospital laboratory report: fields by label, dates by the label of the line beside them, age, facility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom import dims
from chartloom.functions import confidence, identity, parse, text

# Label patterns of the first page's header; whether the value may stand on the next line.
FIRST_PAGE_FIELDS = {
    "patient": (r"^Patient\s*:?", False), "patient_id": (r"^IP\s*Patient\s*:?", False), "birth_date": (r"N[ée]\(e\)\s*le\s*:?", True), "sex": (r"^Sexe\s*:?", False), "origin": (r"^Origine\s*:?", False), "service": (r"^Service\s*:?", False),
    "prescriber": (r"^Prescripteur\s*:?", True), "request_date": (r"^Date\s+Demande\s*:?", False), "received_date": (r"^Date\s+R[ée]ception\s*:?", False), "sample_id": (r"^N[°º]?\s*d['’]?[ée]chantillon\s*:?", False), "specimen": (r"^Nature\s*:?", False),
}
# Label patterns looked up on all pages.
DOCUMENT_FIELDS = {
    "sample_label": (r"^NATURE\s+DE\s+PR[ÉE]L[ÈE]VEMENT\s*:?", True), "validated_by": (r"Valid[ée]\(e\)\s*par\s*:?", False), "printed_by": (r"^Imprim[ée]\s+par\s*:?", False), "edited_by": (r"^Edit[ée]\(e\)\s+par\s*:?", False),
}
# How the hospital's reports name the institution.
STOOL_EXAM = "EXAMEN PARASITOLOGIQUE DES SELLES"
COUNTRY, MINISTRY, ORGANIZATION, DEPARTMENT, WEBSITE = "Maroc", "Ministère de la santé et de la protection sociale", "Centre Hospitalo-Universitaire Mohammed VI - Oujda", "Laboratoire Central", "www.chuoujda.ma"


def document_lines(pages: DataFrame) -> DataFrame:
    """pages(doc_id, page_number, final_text, native_text) to doc_id, pages (in order, with their lines), first (lines of the first) and lines (of all)."""
    shown = F.coalesce(F.nullif("final_text", F.lit("")), F.col("native_text"))
    per = pages.select("doc_id", "page_number", text.lines(shown).alias("lines"))
    docs = per.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "lines"))).alias("pages"))
    return docs.select("doc_id", "pages", F.element_at("pages", 1)["lines"].alias("first"), F.flatten(F.transform("pages", lambda p: p["lines"])).alias("lines"))


def line_value(lines: Column, pattern: str, next_line: bool = True) -> Column:
    """Value of the first line that has the label and a value: the rest of the line, else the next line unless that is a label itself."""
    labelled = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(f"(?iu){pattern}"), i)), lambda i: i.isNotNull())

    def value(i: Column) -> Column:
        own = F.nullif(text.labelled_value(F.get(lines, i), pattern), F.lit(""))
        after = F.get(lines, i + 1)
        follow = F.when(~after.rlike(r":\s*$"), after) if next_line else F.lit(None).cast("string")
        return F.coalesce(own, follow)

    return F.get(F.filter(F.transform(labelled, value), lambda v: v.isNotNull()), F.lit(0))


def document_type() -> Column:
    """Kind of a document (with ``first`` and ``lines``) by markers: stool report over all pages, the others on the first page."""
    key = text.label(F.array_join("lines", "\n"))
    stool = F.lit(True)
    for marker in dims.STOOL_MARKERS:
        stool = stool & key.contains(marker)
    first = F.lower(F.array_join("first", "\n"))
    has = lambda *words: first.rlike("|".join(words))
    return (
        F.when(stool, "parasitology_stool_report").when(has("laboratoire central", "n° d'échantillon", "n d'échantillon", "analyses biologiques"), "biology_report").when(has("imagerie"), "imaging_report").otherwise("medical_report")
    )


def is_hospital_lab(lines: Column) -> Column:
    """Whether lines come from the hospital's laboratory; also with the ordinal sign read as 'no'."""
    key = text.label(F.array_join(lines, "\n"))
    return key.contains("laboratoire_central") & key.rlike("ip_patient|n_d_echantillon|n_echantillon|no_d_echantillon|no_echantillon")


def _laboratory(lines: Column) -> Column:
    here = lambda x: text.label(x).rlike("^laboratoire_de_|^hematologie") | F.lower(x).contains("laboratoire de ")
    return F.get(F.filter(lines, here), F.lit(0))


def _dated(lines: Column) -> Column:
    """Lines 'Le: date' with the label of the next line; the colon is required, so that words that begin alike do not match."""
    spots = F.transform(lines, lambda x, i: F.struct(F.when(x.rlike(r"(?i)^Le\s*:"), text.labelled_value(x, r"^Le\s*:")).alias("date"), text.label(F.coalesce(F.get(lines, i + 1), F.lit(""))).alias("after"), i.alias("i")))
    return F.filter(spots, lambda s: s["date"].isNotNull())


def header(docs: DataFrame) -> DataFrame:
    """doc_id and the report header's fields, raw and parsed."""
    fields = [line_value(F.col("first"), p, n).alias(c) for c, (p, n) in FIRST_PAGE_FIELDS.items()] + [line_value(F.col("lines"), p, n).alias(c) for c, (p, n) in DOCUMENT_FIELDS.items()]
    base = docs.select("doc_id", "lines", _laboratory(F.col("first")).alias("specialty"), _dated(F.col("lines")).alias("_d"), *fields)
    named = lambda p: F.filter("_d", lambda s: s["after"].rlike(p))
    other = F.filter("_d", lambda s: ~s["after"].rlike("^edite_e_par|^valide_e_par"))
    base = base.withColumn("print_date", F.get(other, F.lit(0))["date"]).withColumn("edited_date", F.try_element_at(named("^edite_e_par|^valide_e_par"), F.lit(-1))["date"])
    base = base.withColumn("validation_date", F.get(named("^valide_e_par"), F.lit(0))["date"])
    age = F.regexp_extract("birth_date", r"(?i)-\s*(\d+)(?:[,.]\d+)?\s*ans", 1).try_cast("int")
    sample = F.regexp_replace("sample_label", r"^[:\s]+", "")
    base = base.withColumn("reported_age", age).withColumn("birth_iso", parse.parse_iso_date(F.col("birth_date"))).withColumn("sample_label", sample)
    for c in ("request", "received", "print", "edited", "validation"):
        base = base.withColumn(f"{c}_iso", parse.parse_datetime(F.col(f"{c}_date")))
    computed = parse.calendar_age(F.col("birth_iso"), F.coalesce("request_iso", "received_iso", "edited_iso"))
    base = base.withColumn("computed_age", computed).withColumn("age_status", parse.age_status(F.col("reported_age"), computed)).withColumn("age", F.coalesce("computed_age", "reported_age"))
    base = base.withColumn("age_source", F.when(F.col("computed_age").isNotNull(), "computed_from_birth_date").when(F.col("reported_age").isNotNull(), "reported"))
    base = base.withColumn("patient_field", identity.named_field("patient_id", F.col("patient_id"))).withColumn("encounter_type", identity.encounter_type(F.col("origin")))
    actor = F.when(F.col("validated_by").isNotNull(), "explicit_validator_present").when(F.col("edited_by").isNotNull() | F.col("printed_by").isNotNull(), "edition_only").otherwise("missing")
    exam = F.when(text.label(F.array_join("lines", "\n")).contains("examen_parasitologique_des_selles"), STOOL_EXAM)
    return base.withColumn("exam_name", exam).withColumn("validation_actor_status", actor).drop("_d", "lines")


def facility(docs: DataFrame) -> DataFrame:
    """doc_id and what the pages say of the hospital."""
    whole = F.array_join("lines", "\n")
    named = lambda words, value: F.when(whole.contains(words), value)
    number = lambda p: F.nullif(text.inline(F.regexp_extract(whole, p, 1)), F.lit(""))
    return docs.where(is_hospital_lab(F.col("first"))).select(
        "doc_id", F.lit(COUNTRY).alias("country"), named(MINISTRY, MINISTRY).alias("ministry"), named(ORGANIZATION, ORGANIZATION).alias("organization"), named("LABORATOIRE CENTRAL", DEPARTMENT).alias("department"),
        _laboratory(F.col("lines")).alias("laboratory"), named(WEBSITE, WEBSITE).alias("website"), F.replace(number(r"(?iu)T[ée]l\s*:\s*([0-9 ]+)"), F.lit(" "), F.lit("")).alias("phone"), number(r"(?i)Fax\s*:\s*([0-9 /]+)").alias("fax"),
        F.lit(0.9).alias("confidence_score"), confidence.band(F.lit(0.9)).alias("confidence"),
    )


def observation_date(h: DataFrame) -> Column:
    return F.coalesce(*(parse.parse_iso_date(F.col(c)) for c in ("request_date", "received_date", "validation_date")))
