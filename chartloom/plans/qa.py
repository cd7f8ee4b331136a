"""Quality rules over documents: a rule is a DataFrame of the documents (or parts of them) in which it fires."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom import dims
from chartloom.functions import identity, text

#: Points that an issue of each severity costs.
WEIGHTS = {"FAIL": 20, "WARNING": 10, "INFO": 2}
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
#: Kinds of results that have no number, statuses of the parasite check, its sections.
QUALITATIVE = ("qualitative", "pathogen_identification", "microscopy_finding")
STATUSES = ("consistent", "needs_review", "partial_overlap", "discordant_findings")
CHECKED_SECTIONS = ("staining_exam", "enrichment_exam", "microscopic_exam", "final_result")


def rule(number: int, severity: str, code: str, fired: DataFrame, ordinal: Column | None = None, message: Column | None = None) -> DataFrame:
    """``doc_id, rule_no, ord, severity, code, message`` for each row of ``fired``."""
    return fired.select(
        "doc_id", F.lit(number).alias("rule_no"), (F.lit(0) if ordinal is None else ordinal.cast("int")).alias("ord"), F.lit(severity).alias("severity"), F.lit(code).alias("code"), (F.lit(code) if message is None else message).alias("message")
    )


def issues(rules: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), rules)


def evaluate(documents: DataFrame, found: DataFrame) -> DataFrame:
    """``doc_id, status, score, issues``: the worst severity, 100 less the issues' weights (at least 0), issues in rule order."""
    weight = F.coalesce(*(F.when(F.col("severity") == s, F.lit(w)) for s, w in WEIGHTS.items()))
    listed = F.array_sort(F.collect_list(F.struct("rule_no", "ord", "severity", "code", "message")))
    per = found.groupBy("doc_id").agg(F.sum(weight).alias("_w"), F.count_if(F.col("severity") == "FAIL").alias("_f"), F.count_if(F.col("severity") == "WARNING").alias("_n"), listed.alias("issues"))
    status = F.when(F.col("_f") > 0, "FAIL").when(F.col("_n") > 0, "WARNING").otherwise("PASS")
    score = F.greatest(F.lit(0), F.lit(100) - F.coalesce("_w", F.lit(0))).cast("int")
    return documents.select("doc_id").join(per, "doc_id", "left").select("doc_id", status.alias("status"), score.alias("score"), F.coalesce("issues", F.array()).alias("issues"))


def summarize(judged: DataFrame) -> DataFrame:
    """One row: documents and how many of them pass, warn and fail."""
    return judged.agg(F.count("*").alias("documents"), *(F.count_if(F.col("status") == s).alias(s.lower()) for s in ("PASS", "WARNING", "FAIL")))


def finite(value: Column) -> Column:
    """Null for NaN and infinities, which JSON cannot hold."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def _blank(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("")) == ""


def _fired(df: DataFrame, rules: list[tuple[int, str, str, Column, Column | None, Column | None]]) -> DataFrame:
    """The rules (number, severity, code, condition, ordinal, message) that fire on each row, in one pass over it."""
    fired = []
    for number, severity, code, when, ordinal, message in rules:
        at = F.lit(0) if ordinal is None else ordinal.cast("int")
        fired.append(F.when(when, F.struct(F.lit(number).alias("rule_no"), at.alias("ord"), F.lit(severity).alias("severity"), F.lit(code).alias("code"), (F.lit(code) if message is None else message).alias("message"))))
    return df.select("doc_id", F.explode(F.array_compact(F.array(*fired))).alias("_f")).select("doc_id", "_f.*")


def document_issues(documents: DataFrame, results: DataFrame, blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """The rules for extracted documents.

    documents(doc_id, keys array<string>, document_type, patient_id, sample_id, report_date, raw_rows, canonical_rows, removed_rows,
    consistency_issues int, missing_from_raw int, checks string, root_checks string, status string, detected map<string,array<string>>);
    results(doc_id, row, result_kind, analyte, value_raw, value_numeric, unit, section, page_number, observation_date, low, high, dedup_key, score);
    blocks(doc_id, pos, text, is_indexable, score); pages(doc_id, page_number, final_text).

    A relation is read once for the rules on its rows (an array of what fires, exploded); results and blocks are read once more for what their document's rules need, as
    one aggregated row a document.
    """
    stool = F.col("document_type") == "parasitology_stool_report"
    scores = F.collect_set(F.round("score", 3))  # at most a thousand and one values
    of_results = results.groupBy("doc_id").agg(F.count("*").alias("_results"), F.count("dedup_key").alias("_keyed"), F.count_distinct("dedup_key").alias("_keys"), F.count("score").alias("_rs"), scores.alias("_r"))
    labelled = blocks.select("doc_id", "pos", "score", F.when(F.col("is_indexable"), F.nullif(text.label(F.col("text")), F.lit(""))).alias("label"))
    per_label = labelled.groupBy("doc_id", "label").agg(F.count("*").alias("n"), F.min("pos").alias("pos"), F.count("score").alias("s"), scores.alias("b"))
    of_blocks = per_label.groupBy("doc_id").agg(F.sum("n").alias("_blocks"), F.sum("s").alias("_bs"), F.flatten(F.collect_set("b")).alias("_b"), F.min_by(F.when(F.col("n") > 1, F.col("label")), F.when((F.col("n") > 1) & F.col("label").isNotNull(), F.col("pos"))).alias("_repeated"))
    none = F.array().cast("array<double>")
    whole = documents.join(of_results, "doc_id", "left").join(of_blocks, "doc_id", "left")
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, dims.REQUIRED_SECTIONS)), F.col("keys")))
    counters = F.col("raw_rows").isNull() | F.col("canonical_rows").isNull() | F.col("removed_rows").isNull()
    uniform = (F.coalesce("_rs", F.lit(0)) + F.coalesce("_bs", F.lit(0)) >= 6) & (F.size(F.array_distinct(F.concat(F.coalesce("_r", none), F.coalesce("_b", none)))) <= 2)
    judged = stool & F.col("checks").isNotNull() & F.col("status").isNotNull()
    named = judged & (F.size("detected") > 0)
    final = F.coalesce(F.try_element_at("detected", F.lit("final_result")), F.array().cast("array<string>"))
    earlier = F.flatten(F.array(*(F.coalesce(F.try_element_at("detected", F.lit(s)), F.array().cast("array<string>")) for s in CHECKED_SECTIONS[:3])))
    both = (F.size(final) > 0) & (F.size(earlier) > 0)
    differ = (F.size(F.array_except(final, earlier)) > 0) | (F.size(F.array_except(earlier, final)) > 0)
    patient, date = F.col("patient_id"), F.col("report_date")
    on_documents = _fired(
        whole,
        [
            (1, "FAIL", "missing_top_level_sections", F.size(missing) > 0, None, F.array_join(missing, ", ")),
            (2, "FAIL", "missing_patient_id", _blank(patient), None, None),
            (2, "FAIL", "invalid_patient_id", ~_blank(patient) & ~identity.is_patient_identifier(patient), None, None),
            (3, "FAIL", "missing_sample_id", stool & _blank(F.col("sample_id")), None, None),
            (3, "FAIL", "missing_report_date", ~stool & _blank(date), None, None),
            (3, "FAIL", "invalid_report_date", ~stool & ~_blank(date) & ~date.rlike(ISO_DATE), None, None),
            (6, "FAIL", "duplicate_dedup_keys", F.col("_keyed") > F.col("_keys"), None, None),
            (7, "FAIL", "invalid_dedup_counts", ~counters & (F.col("removed_rows") != F.col("raw_rows") - F.col("canonical_rows")), None, None),
            (7, "FAIL", "missing_dedup_counts", counters, None, None),
            (8, "WARNING", "validation_report_consistency_issues", F.col("consistency_issues") > 0, None, None),
            (8, "WARNING", "missing_from_raw_tables", F.col("missing_from_raw") > 0, F.lit(1), None),
            (9, "WARNING", "uniform_confidence_scores", uniform, None, None),
            (11, "WARNING", "repeated_indexable_blocks", F.col("_repeated").isNotNull(), None, F.col("_repeated")),
            (12, "FAIL", "missing_results", F.col("_results").isNull(), None, None),
            (13, "FAIL", "missing_blocks", F.col("_blocks").isNull(), None, None),
            (14, "WARNING", "missing_validation_report_consistency_checks", stool & F.col("checks").isNull(), None, None),
            (15, "WARNING", "missing_consistency_checks", stool & F.col("root_checks").isNull(), None, None),
            (16, "FAIL", "consistency_checks_mismatch", stool & (F.col("checks") != F.col("root_checks")), None, None),
            (17, "WARNING", "missing_parasite_consistency", stool & F.col("checks").isNotNull() & F.col("status").isNull(), None, None),
            (18, "FAIL", "legacy_parasite_consistency_status", judged & (F.col("status") == "inconsistent"), None, None),
            (19, "FAIL", "invalid_parasite_consistency_status", judged & ~F.col("status").isin(*STATUSES, "inconsistent"), None, None),
            (20, "WARNING", "missing_detected_sections", judged & (F.col("detected").isNull() | (F.size("detected") == 0)), None, None),
            (21, "WARNING", "missing_detected_section_keys", named & (F.size(F.array_except(F.array(*map(F.lit, CHECKED_SECTIONS)), F.map_keys("detected"))) > 0), None, None),
            (24, "WARNING", "discordance_has_overlap", judged & (F.col("status") == "discordant_findings") & F.arrays_overlap(final, earlier), None, None),
            (25, "WARNING", "false_consistent_parasite_status", judged & (F.col("status") == "consistent") & both & differ, None, None),
        ],
    )
    lowered = F.transform("names", lambda n: F.lower(text.strip(n)))
    place = F.coalesce(*(F.when(F.col("section") == s, i) for i, s in enumerate(CHECKED_SECTIONS)), F.lit(9))
    on_sections = _fired(
        documents.where(named).select("doc_id", F.explode("detected").alias("section", "names")),
        [
            (22, "WARNING", "invalid_detected_section_values", F.col("names").isNull(), place, None),
            (23, "WARNING", "duplicate_detected_entities", F.size(F.array_distinct(lowered)) < F.size(lowered), place, None),
        ],
    )
    kind = F.coalesce(F.col("result_kind").isin(*QUALITATIVE), F.lit(False))
    unnamed = _blank(F.col("analyte")) | _blank(F.col("value_raw"))
    seen = F.col("observation_date")
    flags = {
        "_s": unnamed | _blank(F.col("section")) | F.col("page_number").isNull(), "_o": unnamed | _blank(F.col("unit")) | _blank(seen) | (~kind & F.col("value_numeric").isNull()),
        "_d": ~_blank(seen) & ~seen.rlike(ISO_DATE), "_range": F.coalesce(~kind & (F.col("low") > F.col("high")), F.lit(False)),
    }
    suspect = results.select("doc_id", "row", *(flag.alias(name) for name, flag in flags.items())).where(" or ".join(flags)).join(documents.select("doc_id", "document_type"), "doc_id")
    on_results = _fired(
        suspect,
        [
            (4, "FAIL", "missing_result_fields", F.when(stool, F.col("_s")).otherwise(F.col("_o")), F.col("row") * 2, None),
            (4, "FAIL", "invalid_observation_date", ~stool & F.col("_d"), F.col("row") * 2 + 1, None),
            (5, "FAIL", "invalid_reference_range", F.col("_range"), F.col("row"), None),
        ],
    )
    on_pages = _fired(pages, [(10, "WARNING", "page_boilerplate_present", text.is_boilerplate(F.coalesce("final_text", F.lit(""))), F.col("page_number"), None)])
    return issues([on_documents, on_sections, on_results, on_pages])


#: What can be asked of a value in a document.
FACTS = ("equals", "absent", "present", "contains", "lacks", "size")


def unmet_facts(documents: DataFrame, expected: list[tuple[str, str, object]]) -> DataFrame:
    """``doc_id, path, rule, expected, actual, reason`` of what documents(doc_id, document JSON) do not fulfil.

    ``expected``: (JSON path, rule, value); rules: equals, absent, present, contains and lacks (a part of a text), size (of an array).  Reasons: ``absent``, ``unexpected``, ``different``, ``not_contained``,
    ``contained``, ``wrong_size``, ``invalid_document``.  A document is parsed once and every fact is an expression over it, so facts join nothing.
    """
    held = F.try_parse_json("document")
    checks = []
    for path, rule, value in expected:
        if rule not in FACTS:
            raise ValueError(f"{rule}: not one of {FACTS}")
        want = F.lit(None if value is None else str(value)).cast("string")
        found = F.try_variant_get("_v", path, "string")
        found = F.coalesce(found, F.to_json(F.try_variant_get("_v", path, "variant")))
        if rule == "size":
            found = F.size(F.try_variant_get("_v", path, "array<variant>")).cast("string")
        there = found.isNotNull()
        reason = {
            "equals": F.when(~there, "absent").when(found != want, "different"), "absent": F.when(there, "unexpected"), "present": F.when(~there, "absent"), "contains": F.when(~there, "absent").when(~F.contains(found, want), "not_contained"),
            "lacks": F.when(F.contains(found, want), "contained"), "size": F.when(~there, "absent").when(found != want, "wrong_size"),
        }[rule]
        reason = F.when(F.col("_v").isNull(), "invalid_document").otherwise(reason)
        checks.append(F.when(reason.isNotNull(), F.struct(F.lit(path).alias("path"), F.lit(rule).alias("rule"), want.alias("expected"), found.alias("actual"), reason.alias("reason"))))
    return documents.select("doc_id", held.alias("_v")).select("doc_id", F.explode(F.array_compact(F.array(*checks))).alias("_f")).select("doc_id", "_f.*")


def failed_documents(failures: DataFrame) -> DataFrame:
    """Issues of documents whose extraction broke off (doc_id, error); their score is 0 whatever else is known of them."""
    return rule(26, "FAIL", "extraction_exception", failures, message=F.col("error"))
