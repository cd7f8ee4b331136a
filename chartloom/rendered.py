"""Queries over clinical inputs that are rendered from the benchmark tables, so that every document operator runs over a whole table and SQL can say what must come out.

A renderer writes a document per customer (or order) around that row's own values; the SQL puts the same values into the rows that the rules give.
"""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chartloom.functions import confidence, geometry, parse, text
from chartloom.operators import relational as rel
from chartloom.plans import documents, generic, ocr_tables, pages, pipeline, qa, reports, results, segments, stool, tables, visuals
from chartloom.plans import header as head
from chartloom.plans.documents import Relations
from chartloom.queries import _query as _plain_query
from chartloom.sources import readers, stages, store

#: Customers become documents of many lines or tables, so their rows are dealt over all cores first.
_query = partial(_plain_query, spread=("customer",))


def _pick(key: Column, *values: str | None) -> Column:
    """The value at ``key`` modulo their number."""
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def _pick_sql(key: str, *values: str | None) -> str:
    shown = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"([{shown}])[CAST({key} % {len(values)} + 1 AS INTEGER)]"


def _text(lines: list[str | Column]) -> Column:
    return F.concat_ws("\n", *(F.lit(x) if isinstance(x, str) else x for x in lines))


def _k() -> Column:
    return F.col("c_custkey")


# -- the stool report and the hospital report of a customer -------------------------------------------

COLOURS, WHITE_CELLS = ("Marron", "Jaune", "Vert"), ("Assez nombreux", "Absence")
STAINED = ("Présence d'oeufs d'Ankylostoma duodenale", "Négatif", "Trichuris trichiura")
FINAL = ("TRICHURIS TRICHIURA", "Ankylostoma duodenale", "Négatif", "ABSENCE")


def stool_pages(customer: DataFrame, noisy: bool = False) -> DataFrame:
    """A stool report per customer; ``noisy``: with a result twice, one more whose name is a value, and an empty title before the final result's value."""
    more = ["Couleur", F.concat(F.lit(": "), _pick(_k(), *COLOURS)), "Absence", ": Molle", "couleur :", F.concat(F.lit(": "), F.upper(_pick(_k(), *COLOURS)))] if noisy else []
    title = [": Résultat final"] if noisy else []
    lines = [
        F.concat(F.lit("IP Patient : "), _k().cast("string")), F.concat(F.lit("Patient : "), "c_name"), F.concat(F.lit("Né(e) le : 01/02/"), (F.lit(1940) + _k() % 60).cast("string"), F.lit(" - 40 ans")), "Sexe : F", "Origine : Externe", "Prescripteur : Dr. X",
        "Date Demande : 03/06/2024 10:15", "Date Réception : 03/06/2024 11:00", F.concat(F.lit("N° d'échantillon : "), (_k() + 240_000).cast("string")), "Nature : SELLES", "LABORATOIRE CENTRAL", "Laboratoire de Parasitologie Mycologie",
        "Centre Hospitalo-Universitaire Mohammed VI - Oujda", "EXAMEN PARASITOLOGIQUE DES SELLES", "ECHANTILLON BIOLOGIQUE", "NATURE DE PRÉLÈVEMENT : SELLES N°1", "EXAMEN MACROSCOPIQUE", "Couleur", F.concat(F.lit(": "), _pick(_k(), *COLOURS)), "Consistance", ": Molle",
        "Glaire", ": Présence", *more, "EXAMEN MICROSCOPIQUE", "Leucocytes", F.concat(F.lit(": "), _pick(_k(), *WHITE_CELLS)), "Hématies", ": Absence", "EXAMEN APRÈS ENRICHISSEMENT", ": Négatif", "EXAMEN APRÈS COLORATION", F.concat(F.lit(": "), _pick(_k(), *STAINED)),
        "RÉSULTAT FINAL", *title, F.concat(F.lit(": "), _pick(_k(), *FINAL)), "Le : 04/06/2024 12:04:25", "Edité(e) par : A B",
    ]
    return customer.select(_k().cast("string").alias("doc_id"), F.lit(1).alias("page_number"), _text(lines).alias("final_text"), F.lit(None).cast("string").alias("native_text"))


def hospital_pages(customer: DataFrame) -> DataFrame:
    lines = [
        "LABORATOIRE CENTRAL", F.concat(F.lit("IP Patient : "), _k().cast("string")), F.concat(F.lit("Patient : "), "c_name"), "Date Demande : 05/06/2024 08:00", F.concat(F.lit("N° d'échantillon : "), (_k() + 980_000).cast("string")), "PARAMETRES", "Glycémie à jeun",
        F.concat((_k() % 9).cast("string"), F.lit(",4")), "mmol/L", "4,1 - 6,1", "Créatinine", F.concat((_k() % 20).cast("string"), F.lit(",8")), "mg/l", "( 7 - 13 )", "Cholestérol total", "< 2,0 g/L", "1,8g/L", "Page 1 sur 1", "Tel : 0536",
    ]
    return customer.select(_k().cast("string").alias("doc_id"), F.lit(1).alias("page_number"), _text(lines).alias("final_text"), F.lit(None).cast("string").alias("native_text"))


def words_pages(customer: DataFrame) -> DataFrame:
    """Hospital reports whose results are words."""
    lines = ["LABORATOIRE CENTRAL", F.concat(F.lit("IP Patient : "), _k().cast("string")), "EXAMEN DIRECT", "Cellules", _pick(_k(), "Absence", "Présence"), "Commentaire : à contrôler", "dans un mois", "Resultat final : ", F.concat(F.lit("Flore "), _pick(_k(), "normale", "pauvre", "riche")), "Page 1 sur 1"]
    return customer.select(_k().cast("string").alias("doc_id"), F.lit(1).alias("page_number"), _text(lines).alias("final_text"), F.lit(None).cast("string").alias("native_text"))


# -- tables of a customer ------------------------------------------------------------------------------

def _uuid(misread: bool = False) -> Column:
    digest = F.md5(_k().cast("string").cast("binary"))
    parts = F.concat_ws("-", *(F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return F.upper(F.translate(parts, "01", "ol")) if misread else parts


_UUID_SQL = "(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) FROM (SELECT md5(CAST(c_custkey AS VARCHAR)) AS h))"


def _cells(rows: list[list]) -> Column:
    return F.array(*(F.array(*(F.lit(c) if isinstance(c, str) else c for c in row)) for row in rows))


def raw_tables(customer: DataFrame) -> DataFrame:
    """Five detected tables: a patient's fields, a report's fields, results, the same results again (other case), and one that is neither."""
    sugar, potassium = (_k() % 120 + 40).cast("string"), F.concat((_k() % 3 + 3).cast("string"), F.lit(",5"))
    header = ["Analyse / Observation", "Resultat", "Unites", "Valeurs de reference", "Alerte", "Date"]
    rows = [["Glucose [Mass/volume] in Blood", sugar, "mg/dl", "70 - 99", "", "12 févr. 2023"], ["Potassium [Moles/volume] in Serum or Plasma", potassium, "mmol/L", "3,5 - 5,1", "", "12/02/2023"]]
    kinds = [
        ("t1", _cells([["Patient", F.col("c_name")], ["Identifiant", _uuid(True)], ["", ""], ["Date de naissance", F.concat(F.lit("07/03/"), (F.lit(1950) + _k() % 40).cast("string"))], ["Sexe", _pick(_k(), "Féminin", "male", "?")], ["Age", (_k() % 90).cast("string")], ["Age", (_k() % 90).cast("string")]])),
        ("t2", _cells([["Numero de rapport", F.concat(F.lit("rap#"), _k().cast("string"))], ["Date du document", "01/03/2023"], ["Type de rencontre", _pick(_k(), "externe", "Urgent care")], ["Specialite", "médecine  interne"]])),
        ("t3", _cells([header, *rows, rows[0], ["", "", "", "", "", ""]])),
        ("t4", _cells([[h.upper() for h in header], *rows])),
        ("t5", _cells([["Nom", "", "Nom"], [F.col("c_mktsegment"), "x", "y"], ["Document synthétique", "usage exclusif pour tests OCR", "z"]])),
    ]
    every = F.explode(F.array(*(F.struct(F.lit(n).alias("table_id"), F.lit(i + 1).alias("table_no"), c.alias("cells")) for i, (n, c) in enumerate(kinds))))
    return customer.select(_k().cast("string").alias("doc_id"), every.alias("t")).select("doc_id", "t.*")


def ocr_pages(customer: DataFrame) -> DataFrame:
    lines = [
        "Compte rendu", "Analyse / Observation Resultat Unites", F.concat(F.lit("Glucose [Mass/volume] in Blood "), (_k() % 120 + 40).cast("string"), F.lit(" mg/dl 70 - 99 12 févr. 2023")),
        F.concat(F.lit("Potassium [Moles/volume] in "), (_k() % 3 * 10 + 35).cast("string"), F.lit(" mmol/L 3.5 - 5.1 H 12 févr. 2023")), "Serum or Plasma", "Alert", "Body Weight 70.0 kg Selon contexte - 13 mars 2023", "no result 12", "Validation medicale", "Later 5 mg/L 1 - 2 12 mars 2023",
    ]
    return customer.select(_k().cast("string").alias("doc_id"), F.lit(1).alias("page_number"), F.array(*(F.lit(x) if isinstance(x, str) else x for x in lines)).alias("lines"))


def ocr_header_pages(customer: DataFrame) -> DataFrame:
    spoilt = _uuid(True)
    lines = [
        "Document synthétique", F.concat(F.lit("Patient "), "c_name", F.lit(" Numero de rapport rap-"), _k().cast("string")), F.concat(F.substring(spoilt, 1, 19), F.lit("- Date du document 01/03/2023")), F.concat(F.lit("Identifiant "), F.substring(spoilt, 25, 12)),
        "Type de rencontre Ambulatory", "Date de naissance 07/03/1950", "Prescripteur Dr. Y", "Age 70", "Specialite CARDIO", "Sexe F", "Statut final", "12 rue Haute", F.concat(F.lit("Adresse "), "c_mktsegment"), "75001 Paris", "Resultats selectionnes", "Sexe M",
    ]
    return customer.select(_k().cast("string").alias("doc_id"), F.lit(1).alias("page_number"), F.array(*(F.lit(x) if isinstance(x, str) else x for x in lines)).alias("lines"))


def _rows_sql(columns: str, rows: list[str]) -> str:
    """A customer's rows: ``c`` is the customer, each row an SQL tuple that may use its columns."""
    union = " UNION ALL ".join(f"SELECT c_custkey, c_name, c_mktsegment, {r} FROM customer" for r in rows)
    return f"(WITH r(c_custkey, c_name, c_mktsegment, {columns}) AS ({union}) SELECT * FROM r)"


_ID = "CAST(c_custkey AS VARCHAR) AS doc_id"
_COLOUR, _WHITE, _STAIN, _FINAL = (_pick_sql("c_custkey", *x) for x in (COLOURS, WHITE_CELLS, STAINED, FINAL))
_STOOL_SQL = _rows_sql(
    "row_index, section, analyte, value_raw, result_kind, meaning, abnormal, source_line_start, source_line_end",
    [
        f"1, 'macroscopic_exam', 'Couleur', {_COLOUR}, 'qualitative', 'not_significant_or_expected', false, 18, 19",
        "2, 'macroscopic_exam', 'Consistance', 'Molle', 'qualitative', 'not_significant_or_expected', false, 20, 21",
        "3, 'macroscopic_exam', 'Glaire', 'Présence', 'qualitative', 'positive_finding', true, 22, 23",
        f"4, 'microscopic_exam', 'Leucocytes', {_WHITE}, 'microscopy_finding', CASE WHEN c_custkey % 2 = 0 THEN 'inflammatory_finding' ELSE 'normal_or_absent_finding' END, c_custkey % 2 = 0, 25, 26",
        "5, 'microscopic_exam', 'Hématies', 'Absence', 'microscopy_finding', 'normal_or_absent_finding', false, 27, 28",
        "6, 'enrichment_exam', 'EXAMEN APRÈS ENRICHISSEMENT', 'Négatif', 'qualitative', 'not_significant_or_expected', false, 29, 30",
        f"7, 'staining_exam', 'EXAMEN APRÈS COLORATION', {_STAIN}, CASE WHEN c_custkey % 3 = 1 THEN 'qualitative' ELSE 'microscopy_finding' END, CASE WHEN c_custkey % 3 = 1 THEN 'not_significant_or_expected' ELSE 'parasite_elements_detected' END, c_custkey % 3 <> 1, 31, 32",
        f"8, 'final_result', 'RÉSULTAT FINAL', {_FINAL}, 'pathogen_identification', 'pathogen_detected', c_custkey % 4 < 2, 33, 34",
    ],
)


@_query(f"SELECT {_ID}, row_index, section, analyte, value_raw, 'qualitative' AS unit, '2024-06-03' AS observation_date, result_kind, meaning, abnormal, source_line_start, source_line_end FROM {_STOOL_SQL}", "customer")
def stool_results(customer: DataFrame) -> DataFrame:
    """Results of a stool report per customer, from its lines."""
    found = documents.extract(stool_pages(customer))["stool_results"]
    return found.select("doc_id", "row_index", "section", "analyte", "value_raw", "unit", "observation_date", "result_kind", "meaning", "abnormal", "source_line_start", "source_line_end")


@_query(f"SELECT {_ID}, row_index, analyte AS parameter, value_raw AS result, result_kind, meaning AS clinical_significance FROM {_STOOL_SQL}", "customer")
def stool_view(customer: DataFrame) -> DataFrame:
    return stool.result_view(documents.extract(stool_pages(customer))["stool_results"]).select("doc_id", "row_index", "parameter", "result", "result_kind", "clinical_significance")


_FINAL_NAMES = "(CASE c_custkey % 4 WHEN 0 THEN 'trichuris trichiura' WHEN 1 THEN 'ankylostoma duodenale' ELSE '' END)"
_STAIN_NAMES = "(CASE c_custkey % 3 WHEN 0 THEN 'ankylostoma duodenale' WHEN 2 THEN 'trichuris trichiura' ELSE '' END)"


@_query(
    f"SELECT {_ID}, 8 AS raw_rows, 8 AS canonical_rows, 0 AS false_rows, 5 AS sections, {_FINAL_NAMES} AS final_names, {_STAIN_NAMES} AS stained_names, CASE WHEN {_STAIN_NAMES} = '' THEN 'consistent' WHEN {_FINAL_NAMES} = '' THEN 'needs_review' WHEN {_FINAL_NAMES} = {_STAIN_NAMES} THEN 'consistent' ELSE 'discordant_findings' END AS status FROM customer",
    "customer",
)
def stool_checks(customer: DataFrame) -> DataFrame:
    """Counts and the parasites of the final result against those of earlier sections."""
    e = documents.extract(stool_pages(customer), share=True)
    names = lambda s: F.array_join(F.try_element_at("detected", F.lit(s)), ",")
    joined = e["stool_stats"].join(e["consistency"], "doc_id")
    return joined.select("doc_id", F.col("raw_result_rows").cast("int").alias("raw_rows"), F.col("canonical_result_rows").cast("int").alias("canonical_rows"), F.col("false_positive_result_rows").cast("int").alias("false_rows"), F.col("section_count").cast("int").alias("sections"), names("final_result").alias("final_names"), names("staining_exam").alias("stained_names"), "status")


@_query(
    f"SELECT {_ID}, CASE WHEN c_custkey % 2 = 0 THEN 11 ELSE 8 END AS raw_rows, 8 AS canonical_rows, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS false_rows, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 0 END AS removed, 'Couleur=' || {_COLOUR} || ',Consistance=Molle,Glaire=Présence' AS macroscopic, {_FINAL} AS final FROM customer",
    "customer",
)
def stool_noise(customer: DataFrame) -> DataFrame:
    """Repeated results count once, in any spelling; a name that is a value is a false positive; a title is no final result."""
    e = documents.extract(stool_pages(customer.where("c_custkey % 2 = 0"), noisy=True).union(stool_pages(customer.where("c_custkey % 2 = 1"))), share=True)
    part = lambda section, said: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("section") == section, F.struct("row_index", said.alias("s"))))), lambda x: x["s"]), ",")
    found = e["stool_results"].groupBy("doc_id").agg(part("macroscopic_exam", F.concat_ws("=", "analyte", "value_raw")).alias("macroscopic"), part("final_result", F.col("value_raw")).alias("final"))
    n = lambda c, name: F.col(c).cast("int").alias(name)
    return e["stool_stats"].join(found, "doc_id").select("doc_id", n("raw_result_rows", "raw_rows"), n("canonical_result_rows", "canonical_rows"), n("false_positive_result_rows", "false_rows"), n("duplicate_rows_removed", "removed"), "macroscopic", "final")


@_query(f"SELECT {_ID}, 8 AS row_count, 4 AS column_count, count(*) FILTER (row_index <= 5) AS previewed, md5(string_agg(analyte || '=' || value_raw || '/' || result_kind, ';' ORDER BY row_index)) AS body FROM {_STOOL_SQL} GROUP BY c_custkey", "customer")
def stool_logical_table(customer: DataFrame) -> DataFrame:
    t = stool.logical_table(documents.extract(stool_pages(customer))["stool_results"])
    said = F.array_join(F.transform("records", lambda r: F.concat(r["parameter"], F.lit("="), r["result"], F.lit("/"), r["result_kind"])), ";")
    return t.select("doc_id", "row_count", "column_count", F.size("preview").cast("long").alias("previewed"), F.md5(said.cast("binary")).alias("body"))


@_query(
    f"""SELECT {_ID}, 'parasitology_stool_report' AS document_type, c_name AS patient, CAST(c_custkey AS VARCHAR) AS patient_id, 'needs_review' AS id_status, CAST(1940 + c_custkey % 60 AS VARCHAR) || '-02-01' AS birth_date, CAST(84 - c_custkey % 60 AS INTEGER) AS age,
    CASE WHEN abs(44 - c_custkey % 60) <= 1 THEN 'consistent' ELSE 'inconsistent_with_birth_date' END AS age_status, 'computed_from_birth_date' AS age_source, 'External' AS encounter_type, 'Dr. X' AS prescriber, CAST(c_custkey + 240000 AS VARCHAR) AS sample_id, 'SELLES N°1' AS sample_label,
    'Laboratoire de Parasitologie Mycologie' AS specialty, '2024-06-03T10:15:00' AS requested, '2024-06-03T11:00:00' AS received, '2024-06-04T12:04:25' AS edited, 'A B' AS edited_by, 'edition_only' AS actor FROM customer""",
    "customer",
)
def report_header(customer: DataFrame) -> DataFrame:
    """Fields of the first page by label, of this or the next line; dates named by the line after them."""
    e = documents.extract(stool_pages(customer))
    h = e["header"].select(
        "doc_id", "patient", F.col("patient_field.canonical").alias("patient_id"), F.col("patient_field.normalization_status").alias("id_status"), F.col("birth_iso").alias("birth_date"), "age", "age_status", "age_source", "encounter_type", "prescriber", "sample_id", "sample_label", "specialty",
        F.col("request_iso").alias("requested"), F.col("received_iso").alias("received"), F.col("edited_iso").alias("edited"), "edited_by", F.col("validation_actor_status").alias("actor"),
    )
    return h.join(e["documents"].select("doc_id", "document_type"), "doc_id")


@_query(f"SELECT {_ID}, 'Maroc' AS country, 'Centre Hospitalo-Universitaire Mohammed VI - Oujda' AS organization, 'Laboratoire Central' AS department, 'Laboratoire de Parasitologie Mycologie' AS laboratory, CAST(NULL AS VARCHAR) AS phone, 0.9::DOUBLE AS confidence_score, 'high' AS confidence FROM customer", "customer")
def report_facility(customer: DataFrame) -> DataFrame:
    return documents.extract(stool_pages(customer))["facility"].select("doc_id", "country", "organization", "department", "laboratory", "phone", "confidence_score", "confidence")


_PATIENT_TEXT = "'Né(e) le: 01/02/' || CAST(1940 + c_custkey % 60 AS VARCHAR) || ' - 40 ans Sexe: F '"
_META_TEXT = "'Origine: Externe Prescripteur: Dr. X Date Demande:  Date Réception:  N° d''échantillon: ' || CAST(c_custkey + 240000 AS VARCHAR) || ' Nature: SELLES'"
_STAIN_LINE = f"'EXAMEN APRÈS COLORATION : ' || {_STAIN}"


@_query(
    f"""SELECT {_ID}, printf('block_%03d', place) AS block_id, block_type, body, indexable, score, CASE WHEN score >= 85 THEN 'high' ELSE 'medium' END AS confidence FROM """
    + _rows_sql(
        "place, block_type, body, indexable, score",
        [
            "1, 'facility_block', 'LABORATOIRE CENTRAL Laboratoire de Parasitologie Mycologie Centre Hospitalo-Universitaire Mohammed VI - Oujda', false, 85",
            f"2, 'patient_info_block', 'IP Patient: ' || c_custkey || ' Patient: ' || c_name || ' ' || {_PATIENT_TEXT} || {_META_TEXT}, false, 85",
            f"3, 'report_metadata_block', {_META_TEXT} || ' Imprimé par:  Edité(e) par: A B', false, 85",
            "4, 'sample_block', 'ECHANTILLON BIOLOGIQUE NATURE DE PRÉLÈVEMENT : SELLES N°1', true, 80",
            f"5, 'macroscopic_exam_block', 'EXAMEN MACROSCOPIQUE Couleur : ' || {_COLOUR} || ' Consistance : Molle Glaire : Présence', true, 80",
            f"6, 'microscopic_exam_block', 'EXAMEN MICROSCOPIQUE Leucocytes : ' || {_WHITE} || ' Hématies : Absence', true, 80",
            "7, 'enrichment_exam_block', 'EXAMEN APRÈS ENRICHISSEMENT : Négatif', true, 80",
            f"8, 'staining_exam_block', {_STAIN_LINE}, true, 90",
            f"9, 'final_result_block', 'RÉSULTAT FINAL : ' || {_FINAL}, true, 90",
            "10, 'edition_block', 'Le : 04/06/2024 12:04:25 Edité(e) par : A B', false, 80",
        ],
    ),
    "customer",
)
def stool_report_blocks(customer: DataFrame) -> DataFrame:
    """The ten blocks of a stool report's page."""
    found = segments.finished(segments.stool_blocks(_page_lines(stool_pages(customer), "native")))
    return found.select("doc_id", "block_id", "block_type", F.col("text").alias("body"), F.col("is_indexable").alias("indexable"), F.round(F.col("confidence_score") * 100).cast("int").alias("score"), "confidence")


def _page_lines(pages_: DataFrame, source: str) -> DataFrame:
    return head.document_lines(pages_).select("doc_id", F.explode("pages").alias("p")).select("doc_id", "p.page_number", "p.lines", F.lit(source).alias("text_source"))


@_query(
    f"""SELECT {_ID}, ordinal, analyte, value_raw, CAST(replace(value_raw, ',', '.') AS DOUBLE) AS value_numeric, unit, low, high, 'numeric' AS result_kind, 'chu_text_fallback' AS source_kind, '2024-06-05' AS observation_date FROM """
    + _rows_sql(
        "ordinal, analyte, value_raw, unit, low, high",
        [
            "0, 'Glycémie à jeun', CAST(c_custkey % 9 AS VARCHAR) || ',4', 'mmol/L', 4.1::DOUBLE, 6.1::DOUBLE",
            "1, 'Créatinine', CAST(c_custkey % 20 AS VARCHAR) || ',8', 'mg/l', 7::DOUBLE, 13::DOUBLE",
            "2, 'Cholestérol total', '1,8', 'g/L', NULL::DOUBLE, NULL::DOUBLE",
        ],
    ),
    "customer",
)
def hospital_results(customer: DataFrame) -> DataFrame:
    """Numeric results out of a hospital report's running text."""
    found = documents.extract(hospital_pages(customer))["hospital_results"]
    return found.select("doc_id", "ordinal", "analyte", "value_raw", "value_numeric", "unit", "reference_range.low", "reference_range.high", "result_kind", "source_kind", "observation_date")


@_query(
    f"SELECT {_ID}, ordinal, analyte, value_raw, 'qualitative' AS unit, 'qualitative' AS result_kind FROM "
    + _rows_sql(
        "ordinal, analyte, value_raw",
        [
            f"0, 'Cellules', {_pick_sql('c_custkey', 'Absence', 'Présence')}",
            f"1, 'Commentaire', 'à contrôler dans un mois Resultat final : Flore ' || {_pick_sql('c_custkey', 'normale', 'pauvre', 'riche')}",
            f"2, 'Résultat final', 'Flore ' || {_pick_sql('c_custkey', 'normale', 'pauvre', 'riche')}",
        ],
    ),
    "customer",
)
def hospital_word_results(customer: DataFrame) -> DataFrame:
    """Results without a number: name and word, comment, final result."""
    return documents.extract(words_pages(customer))["hospital_results"].select("doc_id", "ordinal", "analyte", "value_raw", "unit", "result_kind")


_HOSPITAL_TEXT = "'Glycémie à jeun ' || (c_custkey % 9) || ',4 mmol/L 4,1 - 6,1 Créatinine ' || (c_custkey % 20) || ',8 mg/l ( 7 - 13 ) Cholestérol total < 2,0 g/L 1,8g/L'"
_HOSPITAL_TOP = "'LABORATOIRE CENTRAL IP Patient : ' || c_custkey || ' Patient : ' || c_name || ' Date Demande : 05/06/2024 08:00 N° d''échantillon : ' || (c_custkey + 980000) || ' PARAMETRES '"


@_query(
    f"SELECT {_ID}, block_type, body, indexable, 85 AS score FROM "
    + _rows_sql("block_type, body, indexable", [f"'patient_info_block', {_HOSPITAL_TOP} || {_HOSPITAL_TEXT} || ' Page 1 sur 1', false", f"'results_table_block', {_HOSPITAL_TEXT}, true"]),
    "customer",
)
def hospital_report_blocks(customer: DataFrame) -> DataFrame:
    found = segments.finished(segments.hospital_blocks(_page_lines(hospital_pages(customer), "native")))
    return found.select("doc_id", "block_type", F.col("text").alias("body"), F.col("is_indexable").alias("indexable"), F.round(F.col("confidence_score") * 100).cast("int").alias("score"))


# -- tables --------------------------------------------------------------------------------------------

_SUGAR, _POTASSIUM = "CAST(c_custkey % 120 + 40 AS VARCHAR)", "(CAST(c_custkey % 3 + 3 AS VARCHAR) || ',5')"
_HEADER = "Analyse / Observation|Resultat|Unites|Valeurs de reference|Alerte|Date"
_RESULTS_TEXT = f"'Analyse / Observation: Glucose [Mass/volume] in Blood | Resultat: ' || {_SUGAR} || ' | Unites: mg/dl | Valeurs de reference: 70 - 99 | Date: 12 févr. 2023' || chr(10) || 'Analyse / Observation: Potassium [Moles/volume] in Serum or Plasma | Resultat: ' || {_POTASSIUM} || ' | Unites: mmol/L | Valeurs de reference: 3,5 - 5,1 | Date: 12/02/2023'"
_MISREAD = f"upper(translate({_UUID_SQL}, '01', 'ol'))"
_TABLES = [
    f"'t1', 'patient_info_table', false, 'Field|Value', 6, 'Patient: ' || c_name || chr(10) || 'Identifiant: ' || {_MISREAD} || chr(10) || 'Date de naissance: 07/03/' || (1950 + c_custkey % 40) || chr(10) || 'Sexe: ' || {_pick_sql('c_custkey', 'Féminin', 'male', '?')} || chr(10) || 'Age: ' || (c_custkey % 90)",
    f"'t2', 'report_info_table', false, 'Field|Value', 4, 'Numero de rapport: rap#' || c_custkey || chr(10) || 'Date du document: 01/03/2023' || chr(10) || 'Type de rencontre: ' || {_pick_sql('c_custkey', 'externe', 'Urgent care')} || chr(10) || 'Specialite: médecine interne'",
    f"'t3', 'results_table', true, '{_HEADER}', 2, {_RESULTS_TEXT}",
    f"'t4', 'results_table', true, '{_HEADER}', 2, {_RESULTS_TEXT}",
    "'t5', 'unknown', false, 'column_1|column_2|column_3', 3, 'column_1: Nom | column_3: Nom' || chr(10) || 'column_1: ' || c_mktsegment || ' | column_2: x | column_3: y' || chr(10) || 'column_3: z'",
]


@_query(f"SELECT {_ID}, table_id, table_role, is_indexable, columns AS names, CASE WHEN table_id = 't1' THEN 5 ELSE records END AS n_records, body FROM " + _rows_sql("table_id, table_role, is_indexable, columns, records, body", _TABLES), "customer")
def table_normalisation(customer: DataFrame) -> DataFrame:
    """Blank and repeated rows gone, header names, roles, and the tables as text."""
    t = tables.normalized(raw_tables(customer))
    return t.select("doc_id", "table_id", "table_role", "is_indexable", tables.as_text(F.col("columns"), F.col("records")).alias("body"), F.array_join("columns", "|").alias("names"), F.size("records").alias("n_records"))


@_query(f"SELECT {_ID}, unnest(['t1', 't2', 't3', 't5']) AS table_id FROM customer", "customer")
def table_duplicates(customer: DataFrame) -> DataFrame:
    """Of tables with one content the first, however their headers are written."""
    return tables.deduplicated(tables.normalized(raw_tables(customer))).select("doc_id", "table_id")


@_query(
    f"SELECT {_ID}, table_id, field, value FROM "
    + _rows_sql(
        "table_id, field, value",
        [
            "'t1', 'Patient', c_name", f"'t1', 'Identifiant', {_UUID_SQL}", "'t1', 'Date de naissance', (1950 + c_custkey % 40) || '-03-07'", f"'t1', 'Sexe', {_pick_sql('c_custkey', 'F', 'M', '?')}", "'t1', 'Age', CAST(c_custkey % 90 AS VARCHAR)",
            "'t2', 'Numero de rapport', 'RAP' || c_custkey", "'t2', 'Date du document', '2023-03-01'", f"'t2', 'Type de rencontre', {_pick_sql('c_custkey', 'External', 'Urgent care')}", "'t2', 'Specialite', 'MÉDECINE INTERNE'",
        ],
    ),
    "customer",
)
def table_fields(customer: DataFrame) -> DataFrame:
    """Field/value tables as maps, known fields normalised by name."""
    kv = tables.key_values(tables.normalized(raw_tables(customer)).where("table_role like '%_info_table'"))
    return kv.select("doc_id", "table_id", F.explode("fields").alias("field", "value"))


@_query(f"SELECT {_ID}, row_no, analyte FROM " + _rows_sql("row_no, analyte", ["0, 'Glucose'", "1, 'glucose '", "2, 'Glucose'"]) + " WHERE row_no = 0 OR row_no = 2 AND c_custkey % 2 = 1", "customer")
def table_row_duplicates(customer: DataFrame) -> DataFrame:
    """The first of results that agree in name, value and unit over all tables of a document."""
    rows = [(1, 0, "Glucose", "5", "mg/dl"), (2, 1, "glucose ", "5", "mg/dL"), (2, 2, "Glucose", None, "mg/dL")]
    every = F.explode(F.array(*(F.struct(F.lit(t).alias("table_no"), F.lit(n).alias("row_no"), F.lit(a).alias("analyte"), (F.lit(v) if v else F.when(_k() % 2 == 1, "6").otherwise("5")).alias("value"), F.lit(u).alias("unit")) for t, n, a, v, u in rows)))
    return tables.deduplicated_rows(customer.select(_k().cast("string").alias("doc_id"), every.alias("r")).select("doc_id", "r.*")).select("doc_id", "row_no", "analyte")


@_query(f"SELECT {_ID}, CASE WHEN c_custkey % 3 = 0 THEN 'second' ELSE 'first' END AS table_id FROM customer", "customer")
def table_fallback(customer: DataFrame) -> DataFrame:
    """Tables of the second detector only where the first found none."""
    given = customer.select(_k().cast("string").alias("doc_id"), _k().alias("k"))
    first = given.where("k % 3 > 0").select("doc_id", F.lit("first").alias("table_id"))
    return tables.with_fallback_source(first, given.select("doc_id", F.lit("second").alias("table_id")))


# -- recognised tables -----------------------------------------------------------------------------------



@_query(
    f"SELECT {_ID}, row_no, analyte, value, unit, reference, flag, shown, corrected, ocr_value FROM "
    + _rows_sql(
        "row_no, analyte, value, unit, reference, flag, shown, corrected, ocr_value",
        [
            f"0, 'Glucose [Mass/volume] in Blood', {_SUGAR}, 'mg/dL', '70 - 99', '-', '12 févr. 2023', false, NULL",
            "1, 'Potassium [Moles/volume] in Serum or Plasma', (['3.5', '4.5', '5.5'])[CAST(c_custkey % 3 + 1 AS INTEGER)], 'mmol/L', '3.5 - 5.1', 'H', '12 févr. 2023', true, CAST(c_custkey % 3 * 10 + 35 AS VARCHAR)",
            "2, 'Body Weight', '70.0', 'kg', 'Selon contexte', '-', '13 mars 2023', false, NULL",
        ],
    ),
    "customer",
)
def ocr_result_rows(customer: DataFrame) -> DataFrame:
    """Result rows out of recognised lines: names over two lines, lost decimal points repaired against the range."""
    found = ocr_tables.result_rows(ocr_pages(customer))
    return found.select("doc_id", F.col("row").alias("row_no"), "analyte", "value", "unit", "reference", "flag", F.col("date").alias("shown"), "corrected", "ocr_value")


@_query(f"SELECT {_ID}, 'table_p001_01' AS table_id, 3 AS records, 8 AS columns, 'results_table' AS table_role, true AS from_ocr FROM customer", "customer")
def ocr_result_tables(customer: DataFrame) -> DataFrame:
    t = ocr_tables.as_tables(ocr_tables.result_rows(ocr_pages(customer)))
    return ocr_tables.distinct_tables(t).select("doc_id", "table_id", F.size("records").alias("records"), F.size("columns").alias("columns"), "table_role", "from_ocr")


@_query(
    f"""SELECT {_ID}, c_name AS patient, 'RAP-' || c_custkey AS report_id, '01/03/2023' AS report_date, substr({_UUID_SQL}, 1, 18) || '-' || substr({_UUID_SQL}, 25, 12) AS patient_id, '07/03/1950' AS birth_date, '70' AS age, 'F' AS sex, 'Ambulatory' AS encounter_type, 'Dr. Y' AS prescriber, 'CARDIO' AS specialty, 'final' AS status,
    '12 rue Haute ' || c_mktsegment || ' 75001 Paris' AS address FROM customer""",
    "customer",
)
def ocr_header_fields(customer: DataFrame) -> DataFrame:
    """Header fields of a recognised page; an identifier cut over two lines is joined."""
    return ocr_tables.header_fields(ocr_header_pages(customer)).withColumn("patient_id", F.translate("patient_id", "oil", "011"))


# -- canonical results -----------------------------------------------------------------------------------


def _raw_results(customer: DataFrame) -> DataFrame:
    found = tables.normalized(raw_tables(customer)).select("doc_id", "table_no", "table_id", F.lit(1).alias("page_number"), "table_role", F.lit(False).alias("from_ocr"), "records")
    return results.from_tables(found)


def _result_lines(customer: DataFrame) -> DataFrame:
    lines = F.array(F.concat(F.lit("Sodium level "), (_k() % 20 + 130).cast("string"), F.lit(" mmol/L 135 - 145 H 12/03/2023")), F.lit("no result here"), F.lit("Urea 5 mmol/L 2 - 8 - "), F.lit("Potassium level 45 mmol/L 3,5 - 5,1 "))
    return results.from_lines(customer.select(_k().cast("string").alias("doc_id"), F.lit(1).alias("block_no"), F.lit(2).alias("page_number"), lines.alias("lines")))


@_query(
    f"SELECT {_ID}, analyte, value_raw, CAST(replace(value_raw, ',', '.') AS DOUBLE) AS value_numeric, unit, unit_status, low, high, '2023-02-12' AS observation_date, 'results_table' AS source_kind, 1::DOUBLE AS score, 'high' AS confidence, 't4' AS loser, 1 AS losers, 0.97::DOUBLE AS numeric_confidence FROM "
    + _rows_sql("analyte, value_raw, unit, unit_status, low, high", [f"'Glucose [Mass/volume] in Blood', {_SUGAR}, 'mg/dL', 'canonicalized', 70::DOUBLE, 99::DOUBLE", f"'Potassium [Moles/volume] in Serum or Plasma', {_POTASSIUM}, 'mmol/L', 'as_extracted', 3.5::DOUBLE, 5.1::DOUBLE"]),
    "customer",
)
def canonical_results(customer: DataFrame) -> DataFrame:
    """One result of each key, its confidence by field, and the table that lost."""
    kept, _ = results.canonical(_raw_results(customer))
    return kept.select(
        "doc_id", "analyte", "value_raw", "value_numeric", "unit", F.col("unit_normalization_status").alias("unit_status"), "reference_range.low", "reference_range.high", "observation_date", "source_kind", F.col("confidence_score").alias("score"), "confidence",
        F.col("duplicate_sources")[0]["source_table_id"].alias("loser"), F.size("duplicate_sources").alias("losers"), F.try_element_at("field_confidence", F.lit("value_numeric"))["score"].alias("numeric_confidence"),
    )


@_query(f"SELECT {_ID}, 4 AS raw_rows, 2 AS canonical_rows, 2 AS removed, 2 AS results, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 2 END AS matched, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS missing_from_raw, 0 AS raw_only, 0 AS issues FROM customer", "customer")
def results_validation(customer: DataFrame) -> DataFrame:
    """Counts of the ranked choice, and canonical results against raw ones, of which some documents lack one."""
    raw = stages.staged(_raw_results(customer), "raw_results")
    kept, stats = results.canonical(raw, share=True)
    checked = results.validation_report(kept, raw.where("cast(doc_id as bigint) % 2 = 1 or analyte like 'Glucose%'"))
    n = lambda c, name=None: F.col(c).cast("int").alias(name or c)
    return stats.join(checked, "doc_id").select("doc_id", n("raw_result_rows", "raw_rows"), n("canonical_result_rows", "canonical_rows"), n("duplicate_rows_removed", "removed"), n("results"), n("matched"), n("missing_from_raw"), n("raw_only"), n("consistency_issues", "issues"))


@_query(
    f"SELECT {_ID}, tier, analyte, value_raw, corrected, score FROM "
    + _rows_sql("tier, analyte, value_raw, corrected, score", ["2, 'Sodium level', CAST(c_custkey % 20 + 130 AS VARCHAR), false, 0.92::DOUBLE", "2, 'Potassium level', '4.5', true, 0.88::DOUBLE", f"1, 'Glucose [Mass/volume] in Blood', {_SUGAR}, false, 1::DOUBLE", f"1, 'Potassium [Moles/volume] in Serum or Plasma', {_POTASSIUM}, false, 1::DOUBLE"])
    + " WHERE (tier = 1) = (c_custkey % 3 > 0)",
    "customer",
)
def results_fallback(customer: DataFrame) -> DataFrame:
    """Results of tables, and of lines for documents whose tables have none; unreliable ones (one-word names) dropped."""
    first, _ = results.canonical(_raw_results(customer.where("c_custkey % 3 > 0")))
    second, _ = results.canonical(_result_lines(customer))
    found = results.with_fallback([first, second])
    return found.select("doc_id", "tier", "analyte", "value_raw", F.col("ocr_correction_applied").alias("corrected"), F.col("confidence_score").alias("score"))


_NAMES = ("Glucose [Mass/volume] in Blood by Automated count", "The Body Weight", "of", "Sodium earns")


@_query(f"SELECT c_custkey, {_pick_sql('c_custkey', 'glucose_mass_volume', 'body_weight', 'of', 'sodium')} AS fingerprint, {_pick_sql('c_custkey', 'high', 'medium', 'low')} AS band FROM customer", "customer")
def analyte_fingerprints(customer: DataFrame) -> DataFrame:
    return customer.select("c_custkey", generic.analyte_fingerprint(_pick(_k(), *_NAMES)).alias("fingerprint"), generic.points_band(F.element_at(F.array(*map(F.lit, (8.0, 6.5, 5.9))), (_k() % 3 + 1).cast("int"))).alias("band"))


# -- fields of patient and report from tables, blocks and the first page -------------------------------------


def _generic_inputs(customer: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    ids = customer.select(_k().cast("string").alias("doc_id"), _k().alias("k"), "c_name")
    normal = tables.normalized(raw_tables(customer.where("c_custkey % 3 = 0"))).where("table_role like '%_info_table'")
    found = tables.key_values(normal).join(normal.select("doc_id", "table_id", "table_no", "table_role"), ["doc_id", "table_id"]).select("doc_id", "table_no", "table_role", "fields", F.lit(True).alias("has_box"))
    said = F.concat(F.lit("Patient: "), "c_name", F.lit(" Identifiant: p-"), F.col("k").cast("string"), F.lit(" Sexe: masculin Age: 30 ans"))
    blocks = ids.where("k % 3 = 1").select("doc_id", F.lit(0).alias("pos"), F.lit("patient_info_block").alias("block_type"), said.alias("text"), F.lit(0.8).alias("score"))
    first = ids.select("doc_id", F.lit(1).alias("page_number"), F.when(F.col("k") % 3 == 0, "Date de naissance: 05/06/1970").otherwise("nothing").alias("native_text"))
    return ids.select("doc_id"), found, blocks, first


@_query(
    f"""SELECT {_ID}, CASE WHEN c_custkey % 3 < 2 THEN c_name END AS name, CASE c_custkey % 3 WHEN 0 THEN {_UUID_SQL} WHEN 1 THEN 'p-' || c_custkey END AS patient_id, CASE c_custkey % 3 WHEN 0 THEN 'as_extracted' WHEN 1 THEN 'needs_review' ELSE 'missing' END AS id_status,
    CASE WHEN c_custkey % 3 = 0 THEN '1970-06-05' END AS birth_date, CASE c_custkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'M' END AS sex, CASE c_custkey % 3 WHEN 0 THEN c_custkey % 90 WHEN 1 THEN 30 END AS reported_age, 'unknown' AS age_status FROM customer""",
    "customer",
)
def generic_patient(customer: DataFrame) -> DataFrame:
    """A patient's fields from the table, else the block; dates and identifiers from the first page before a table."""
    p = generic.patient(*_generic_inputs(customer))
    return p.select("doc_id", F.col("name.canonical").alias("name"), F.col("patient_id.canonical").alias("patient_id"), F.col("patient_id.normalization_status").alias("id_status"), F.col("birth_date.canonical").alias("birth_date"), F.col("sex.canonical").alias("sex"), "reported_age", "age_status")


@_query(
    f"""SELECT {_ID}, CASE WHEN c_custkey % 3 = 0 THEN 'RAP' || c_custkey END AS report_id, CASE WHEN c_custkey % 3 = 0 THEN '2023-03-01' END AS report_date, CASE WHEN c_custkey % 3 = 0 THEN {_pick_sql('c_custkey', 'External', 'Urgent care')} END AS encounter_type,
    CASE WHEN c_custkey % 3 = 0 THEN 'MÉDECINE INTERNE' END AS specialty, CASE WHEN c_custkey % 3 = 0 THEN 'high' ELSE 'low' END AS confidence FROM customer""",
    "customer",
)
def generic_report(customer: DataFrame) -> DataFrame:
    r = generic.report(*_generic_inputs(customer))
    return r.select("doc_id", *(F.col(f"{c}.canonical").alias(c) for c in ("report_id", "report_date", "encounter_type", "specialty")), F.col("confidence.label").alias("confidence"))


@_query(f"SELECT {_ID}, 'Hopital ' || c_mktsegment || ' - Tel. 05 36 ' || c_custkey AS raw_text, 'Hopital ' || c_mktsegment AS address, '05 36 ' || c_custkey AS phone FROM customer WHERE c_custkey % 2 = 0", "customer")
def generic_facility(customer: DataFrame) -> DataFrame:
    lines = F.posexplode(F.array(F.lit("Title"), F.when(_k() % 2 == 0, F.concat(F.lit("Hopital "), "c_mktsegment", F.lit(" - Tel. 05 36 "), _k().cast("string"))), F.lit("Tel. later"))).alias("pos", "text")
    blocks = customer.select(_k().cast("string").alias("doc_id"), lines).where("text is not null").withColumn("page_number", F.when(F.col("text") == "Tel. later", 2).otherwise(1))
    return generic.facility(blocks)


# -- boxes, images and blocks of a page -----------------------------------------------------------------------


def _boxed(lines: DataFrame) -> DataFrame:
    """Order lines as text blocks of one page, first lines as images."""
    x, y = F.col("l_quantity") * 10, (F.col("l_partkey") % 700).cast("double")
    box = F.struct(x.alias("x0"), y.alias("y0"), (x + 100).alias("x1"), (y + 40).alias("y1"))
    return lines.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_number"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("pos"), F.concat(F.lit("item "), F.col("l_partkey").cast("string"), F.lit("/"), F.col("l_suppkey").cast("string")).alias("text"), box.alias("bbox"))


_BOXED_SQL = "(SELECT l_orderkey AS doc_id, l_linenumber * 1000000 + l_partkey AS pos, 'item ' || l_partkey || '/' || l_suppkey AS text, l_quantity * 10 AS x0, CAST(l_partkey % 700 AS DOUBLE) AS y0, l_quantity * 10 + 100 AS x1, CAST(l_partkey % 700 + 40 AS DOUBLE) AS y1 FROM lineitem)"


@_query(
    f"""WITH b AS {_BOXED_SQL}, o AS (SELECT doc_id, pos, x1 - x0 AS w, y1 - y0 AS h, x0, y0, x1, y1, greatest(0, x0) AS a, least(400, x1) AS c, greatest(0, y0) AS e, least(600, y1) AS f, greatest(0, 200 - y1, y0 - 240) AS gap FROM b)
    SELECT doc_id, pos, w AS width, h AS height, w * h AS area, gap, 210 BETWEEN y0 AND y1 AS holds, CASE WHEN c - a >= 24 AND f - e >= 24 THEN c - a END AS cut_width, CASE WHEN c - a >= 24 AND f - e >= 24 THEN f - e END AS cut_height FROM o""",
    "lineitem",
)
def geometry_measures(lines: DataFrame) -> DataFrame:
    b, other = F.col("bbox"), geometry.box(F.lit(0), F.lit(200), F.lit(50), F.lit(240))
    cut = geometry.clamp(b, F.lit(400.0), F.lit(600.0))
    return _boxed(lines).select("doc_id", "pos", geometry.width(b).alias("width"), geometry.height(b).alias("height"), geometry.area(b).alias("area"), geometry.vertical_distance(b, other).alias("gap"), geometry.contains_y(b, F.lit(210.0)).alias("holds"), F.when(cut.isNotNull(), geometry.width(cut)).alias("cut_width"), F.when(cut.isNotNull(), geometry.height(cut)).alias("cut_height"))


@_query(
    f"""WITH b AS {_BOXED_SQL}, i AS (SELECT *, text AS image_id FROM b WHERE pos < 2000000), t AS (SELECT * FROM b WHERE pos >= 2000000),
    p AS (SELECT i.doc_id, image_id, t.pos, t.text, greatest(0, least(i.x1, t.x1) - greatest(i.x0, t.x0)) / greatest(1, least(i.x1 - i.x0, t.x1 - t.x0)) AS ov, greatest(0, t.y0 - i.y1, i.y0 - t.y1) AS gap, t.x1 < i.x0 - 15 OR t.x0 > i.x1 + 15 AS beside FROM i JOIN t USING (doc_id)),
    k AS (SELECT *, gap - 20 * ov AS score FROM p WHERE NOT (ov < 0.15 AND gap > 25) AND NOT (ov < 0.08 AND beside)),
    n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, image_id ORDER BY score, pos) AS r FROM k)
    SELECT i.doc_id, i.image_id, coalesce(c, '') AS context_text FROM i LEFT JOIN (SELECT doc_id, image_id, string_agg(text, ' | ' ORDER BY score, pos) AS c FROM n WHERE r <= 3 GROUP BY 1, 2) USING (doc_id, image_id)""",
    "lineitem",
)
def image_context(lines: DataFrame) -> DataFrame:
    """The three texts nearest to each image on its page."""
    boxed = _boxed(lines)
    images = boxed.where("pos < 2000000").select("doc_id", "page_number", F.col("text").alias("image_id"), "bbox")
    return visuals.context(images, boxed.where("pos >= 2000000")).select("doc_id", "image_id", "context_text")


@_query(
    """SELECT DISTINCT l_orderkey AS doc_id, l_linenumber % 3 AS xref, round(c, 4) AS page_coverage FROM (SELECT l_orderkey, l_linenumber, CAST((l_orderkey % 10 + 1) * 10 * 100 AS DOUBLE) / 10000 AS c FROM lineitem) WHERE c < 0.9""",
    "lineitem",
)
def image_rasters(lines: DataFrame) -> DataFrame:
    """Each image of a page once, without scans of the whole page."""
    side = (F.col("l_orderkey") % 10 + 1).cast("double") * 10
    box = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), side.alias("x1"), F.lit(100.0).alias("y1"))
    images = lines.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_number"), (F.col("l_linenumber") % 3).alias("xref"), box.alias("bbox"), F.lit(100.0).alias("width"), F.lit(100.0).alias("height"))
    return visuals.without_rasters(images).select("doc_id", "xref", "page_coverage")


def _titled(lines: DataFrame) -> DataFrame:
    """Order lines as texts with a font; titles are the bold ones."""
    size, bold = (F.col("l_partkey") % 5 + 8).cast("double").alias("max_font_size"), (F.col("l_partkey") % 4 == 0).alias("is_bold")
    x, y = (F.col("l_quantity") * 10), (F.col("l_partkey") % 90).cast("double")
    box = geometry.box(x, y, x + 100, y + 12).alias("bbox")
    return lines.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_number"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("pos"), box, size, bold, F.col("l_suppkey").alias("k"))


_TITLED_SQL = "(SELECT l_orderkey AS doc_id, l_linenumber * 1000000 + l_partkey AS pos, l_quantity * 10 AS x0, CAST(l_partkey % 90 AS DOUBLE) AS y0, l_quantity * 10 + 100 AS x1, CAST(l_partkey % 90 + 12 AS DOUBLE) AS y1, l_partkey % 5 + 8 AS size, l_partkey % 4 = 0 AS bold, l_suppkey AS k FROM lineitem)"


@_query(
    f"""WITH b AS {_TITLED_SQL} SELECT t.doc_id, t.pos, (SELECT arg_min(c.pos, (c.x0, c.pos)) FROM b c WHERE c.doc_id = t.doc_id AND c.pos <> t.pos AND c.bold AND c.size >= t.size - 0.5 AND abs(c.y0 - t.y0) <= 20 AND c.x0 > t.x0 + 40) AS companion_pos FROM b t WHERE t.bold""",
    "lineitem",
)
def companion_titles(lines: DataFrame) -> DataFrame:
    """The title beside each title of a page."""
    boxed = _titled(lines)
    return segments.companion_titles(boxed.where("is_bold"), boxed).select("doc_id", "pos", "companion_pos")


@_query(
    f"""WITH b AS {_TITLED_SQL} SELECT i.doc_id, i.pos AS image_id, (SELECT arg_max(t.pos, (t.y1, -t.pos)) FROM b t WHERE t.doc_id = i.doc_id AND t.bold AND t.y1 <= i.y0 + 5 AND i.y0 - t.y1 <= 25 AND t.x1 >= i.x0 - 20 AND t.x0 <= i.x1 + 20) AS title_pos FROM b i WHERE i.k % 3 = 0""",
    "lineitem",
)
def titles_above_images(lines: DataFrame) -> DataFrame:
    """The title right above each image."""
    boxed = _titled(lines)
    return segments.titles_above(boxed.where("k % 3 = 0").select("doc_id", "page_number", F.col("pos").alias("image_id"), "bbox"), boxed).select("doc_id", "image_id", "title_pos")


@_query(
    f"""WITH b AS {_TITLED_SQL}, s AS (SELECT *, (SELECT arg_min(c.pos, (c.x0, c.pos)) FROM b c WHERE c.doc_id = t.doc_id AND c.pos <> t.pos AND c.bold AND c.size >= t.size - 0.5 AND abs(c.y0 - t.y0) <= 20 AND c.x0 > t.x0 + 40) AS companion FROM b t WHERE t.bold),
    c AS (SELECT s.doc_id, s.pos, b.y0 AS y, 0 AS kind FROM s JOIN b ON s.doc_id = b.doc_id AND b.bold AND b.y0 > s.y0 AND b.size >= s.size AND b.pos IS DISTINCT FROM s.companion UNION ALL SELECT s.doc_id, s.pos, b.y0, 1 FROM s JOIN b ON s.doc_id = b.doc_id AND b.k % 5 = 0 AND b.y0 > s.y0
      UNION ALL SELECT s.doc_id, s.pos, b.y0, 2 FROM s JOIN b ON s.doc_id = b.doc_id AND b.k % 7 = 0 AND b.y0 > s.y0),
    n AS (SELECT doc_id, pos, min(y) AS y, arg_min(kind, (y, kind)) AS kind FROM c GROUP BY 1, 2)
    SELECT s.doc_id, s.pos, CASE WHEN y <= 80 * 0.95::DOUBLE THEN y ELSE 80 * 0.95::DOUBLE END AS end_y, CASE WHEN y <= 80 * 0.95::DOUBLE THEN (['title', 'table', 'stop'])[kind + 1] ELSE 'page' END AS end_kind FROM s LEFT JOIN n USING (doc_id, pos)""",
    "lineitem",
)
def next_boundaries(lines: DataFrame) -> DataFrame:
    """Where the section of each title ends: at a title, a table, a stop or the page's end."""
    boxed = _titled(lines)
    starts = segments.companion_titles(boxed.where("is_bold"), boxed).select("doc_id", "page_number", "pos", F.col("bbox.y0").alias("y0"), "max_font_size", "companion_pos")
    at = lambda when: boxed.where(when).select("doc_id", "page_number", F.col("bbox.y0").alias("y0"))
    return segments.next_boundaries(starts, boxed, at("k % 5 = 0"), at("k % 7 = 0"), 80.0).select("doc_id", "pos", "end_y", "end_kind")


@_query(
    """WITH f AS (SELECT l_orderkey AS doc_id, l_linenumber * 10000000 + l_partkey AS n, l_returnflag AS section, l_linestatus AS title, 'p' || l_partkey % 2 AS parameter, 'v' || l_suppkey % 2 AS result, CASE WHEN l_partkey % 9 > 0 THEN 'kind ' || l_linenumber END AS kind FROM lineitem),
    k AS (SELECT doc_id, key, parameter, result, arg_max({'kind': kind}, (n, form)).kind AS kind FROM (SELECT doc_id, n, parameter, result, kind, unnest([section, title]) AS key, unnest([0, 1]) AS form FROM f) GROUP BY ALL),
    r AS (SELECT o_orderkey AS doc_id, unnest(['A', 'N', 'R', 'O', 'F', 'X']) AS section, 'p' || o_custkey % 2 AS parameter, 'v' || o_orderkey % 2 AS result FROM orders)
    SELECT r.doc_id, r.section, r.parameter, r.result, k.doc_id IS NOT NULL AS matched, CASE WHEN k.doc_id IS NOT NULL THEN kind ELSE 'own' END AS result_kind FROM r LEFT JOIN k ON r.doc_id = k.doc_id AND r.section = k.key AND r.parameter = k.parameter AND r.result = k.result""",
    "orders",
    "lineitem",
)
def logical_record_kinds(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Records of logical tables, which name sections by code or title, with the kinds of their results; some fit by code, some by title, some by both, some by none."""
    found = lines.select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber").cast("long") * 10_000_000 + F.col("l_partkey")).alias("row_index"), F.col("l_returnflag").alias("section"), F.col("l_linestatus").alias("section_name"), F.concat(F.lit("p"), (F.col("l_partkey") % 2).cast("string")).alias("parameter"),
        F.concat(F.lit("v"), (F.col("l_suppkey") % 2).cast("string")).alias("result"), F.when(F.col("l_partkey") % 9 > 0, F.concat(F.lit("kind "), F.col("l_linenumber").cast("string"))).alias("result_kind"),
    )
    sections = F.explode(F.array(*map(F.lit, "ANROFX"))).alias("section")
    records = orders.select(_o().alias("doc_id"), sections, F.concat(F.lit("p"), (F.col("o_custkey") % 2).cast("string")).alias("parameter"), F.concat(F.lit("v"), (_o() % 2).cast("string")).alias("result"), F.lit("own").alias("result_kind"))
    return stool.projected_records(records, found).select("doc_id", "section", "parameter", "result", "matched", "result_kind")


@_query(
    """WITH b AS (SELECT l_orderkey AS doc_id, l_linenumber * 1000000 + l_partkey AS pos, 'p' || lpad(CAST(l_partkey AS VARCHAR), 7, '0') AS t, l_quantity * 10 AS x0, CAST(l_partkey % 90 AS DOUBLE) AS y0 FROM lineitem),
    s AS (SELECT doc_id, x0 < 250 AS leftmost, pos, t FROM b WHERE y0 >= 20 AND y0 < 70)
    SELECT doc_id, CASE WHEN leftmost THEN 'patient_info_block' ELSE 'report_info_block' END AS block_type, string_agg(t, chr(10) ORDER BY pos) AS body, CAST(max(n) AS INTEGER) AS sources FROM (SELECT doc_id, leftmost, t, min(pos) AS pos, sum(count(*)) OVER (PARTITION BY doc_id, leftmost) AS n FROM s GROUP BY doc_id, leftmost, t) GROUP BY 1, 2""",
    "lineitem",
)
def column_blocks(lines: DataFrame) -> DataFrame:
    """A band of a page split at its middle."""
    x, y = F.col("l_quantity") * 10, (F.col("l_partkey") % 90).cast("double")
    blocks = lines.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_number"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("pos"), F.concat(F.lit("p"), F.lpad(F.col("l_partkey").cast("string"), 7, "0")).alias("text"), geometry.box(x, y, x + 50, y + 10).alias("bbox"), F.lit("ocr").alias("source"))
    bands = blocks.select("doc_id", "page_number").distinct().select("*", F.lit(20.0).alias("start_y"), F.lit(70.0).alias("end_y"))
    return segments.column_blocks(blocks, bands, 500.0).select("doc_id", "block_type", F.col("text").alias("body"), "sources")


@_query(
    """WITH v AS (SELECT CAST(c_custkey AS VARCHAR) AS doc_id, CAST(500 + c_custkey % 100 AS DOUBLE) AS y FROM customer WHERE c_custkey % 3 > 0)
    SELECT doc_id, 'visual_p001_01' AS image_id, 'signature' AS image_type, 48::DOUBLE AS x0, y + 20 AS y0, 252::DOUBLE AS x1, 885::DOUBLE AS y1, 'ocr_visual' AS lineage FROM v UNION ALL SELECT doc_id, 'visual_p001_02', 'stamp', 348, y + 20, 516, 885, 'ocr_visual' FROM v""",
    "customer",
)
def scanned_visuals(customer: DataFrame) -> DataFrame:
    """What is cropped from recognised pages, as images with where they come from."""
    doc = _k().cast("string").alias("doc_id")
    y = (_k() % 100).cast("double") + 500
    said = F.explode(F.array(F.struct(F.lit(1).alias("pos"), F.when(_k() % 3 > 0, "Validation médicale").otherwise("other").alias("text"), geometry.box(F.lit(60.0), y - 12, F.lit(200.0), y).alias("bbox")), F.struct(F.lit(2).alias("pos"), F.lit("Document synthétique").alias("text"), geometry.box(F.lit(60.0), F.lit(900.0), F.lit(200.0), F.lit(912.0)).alias("bbox")))).alias("b")
    blocks = customer.select(doc, F.lit(1).alias("page_number"), said).select("doc_id", "page_number", "b.*")
    pages_ = customer.select(doc, F.lit(1).alias("page_number"), F.lit(600.0).alias("width"), F.lit(1000.0).alias("height"), F.lit("ocr").alias("text_source"))
    crops = visuals.scan_crops(pages_, blocks).withColumn("visual_type", F.col("label")).withColumn("role", F.lit("validation")).withColumn("is_indexable", F.lit(False))
    return documents.visual_as_image(crops).select("doc_id", "image_id", "image_type", F.round("bbox.x0", 6).alias("x0"), F.round("bbox.y0", 6).alias("y0"), F.round("bbox.x1", 6).alias("x1"), F.round("bbox.y1", 6).alias("y1"), "lineage")


@_query(
    f"""SELECT {_ID}, CASE WHEN c_custkey % 4 > 0 THEN 'Dr. ' || c_custkey END AS validated_by, CASE WHEN c_custkey % 4 > 1 THEN c_mktsegment END AS specialty, c_custkey % 3 = 0 AS has_signature, c_custkey % 3 = 1 AS has_stamp FROM customer""",
    "customer",
)
def validation_fields(customer: DataFrame) -> DataFrame:
    """The lines under the validation title, on the left and near it, and the images beside them."""
    doc = _k().cast("string").alias("doc_id")
    rows = [(F.lit("Validation médicale"), 60, 600), (F.when(_k() % 4 > 0, F.concat(F.lit("Dr. "), _k().cast("string"))), 60, 620), (F.when(_k() % 4 > 1, F.col("c_mktsegment")), 60, 640), (F.lit("right"), 400, 630), (F.lit("far"), 60, 690)]
    said = F.posexplode(F.array(*(F.struct(t.alias("text"), geometry.box(F.lit(float(x)), F.lit(float(y)), F.lit(x + 90.0), F.lit(y + 10.0)).alias("bbox")) for t, x, y in rows))).alias("pos", "b")
    blocks = customer.select(doc, F.lit(1).alias("page_number"), said).select("doc_id", "page_number", "pos", "b.*").where("text is not null")
    images = customer.select(doc, _pick(_k(), "signature", "stamp_or_seal", "unknown").alias("type"))
    return segments.validation_fields(blocks, images)


_NEAR = ("Cachet du service", "Validation médicale", "Échographie abdominale", "Vue analytique", "nothing", "nothing", "nothing", "nothing", "nothing")
_KINDS = [("stamp_or_seal", "validation", False), ("signature", "validation", False), ("medical_illustration", "clinical_visual", True), ("clinical_chart", "analytics", True), ("logo_or_branding", "branding", False), ("clinical_chart", "analytics", True), ("signature", "validation", False), ("stamp_or_seal", "validation", False), ("unknown", "unknown", False)]
_PLACES = [(1, 0, 0, 10, 10)] * 4 + [(1, 0, 10, 40, 30), (2, 0, 50, 40, 70), (3, 10, 50, 30, 60), (3, 60, 50, 70, 60), (1, 0, 50, 10, 60)]


@_query("SELECT c_custkey, " + ", ".join(f"{_pick_sql('c_custkey', *(str(k[i]) for k in _KINDS))} AS {n}" for i, n in enumerate(("type", "role", "shown"))) + " FROM customer", "customer")
def image_kinds(customer: DataFrame) -> DataFrame:
    """What an image is, by the words near it, then by its place."""
    at = lambda i: F.element_at(F.array(*(F.lit(float(p[i])) for p in _PLACES)), (_k() % 9 + 1).cast("int"))
    box = F.struct(at(1).alias("x0"), at(2).alias("y0"), at(3).alias("x1"), at(4).alias("y1"))
    found = customer.select("c_custkey", visuals.classify(at(0).cast("int"), F.lit(100.0), F.lit(100.0), box, _pick(_k(), *_NEAR)).alias("c"))
    return found.select("c_custkey", "c.type", "c.role", F.initcap(F.col("c.is_indexable").cast("string")).alias("shown"))


@_query(
    """WITH b AS (SELECT l_orderkey AS doc_id, l_suppkey % 3 AS block_no, l_linenumber AS line_no, 'p' || l_partkey AS t, l_quantity AS x0, CAST(l_linenumber * 10 AS DOUBLE) AS y0, l_quantity + 30 AS x1, CAST(l_linenumber * 10 + 8 AS DOUBLE) AS y1, CAST(l_partkey % 5 + 8 AS DOUBLE) AS size, l_partkey % 4 = 0 AS bold FROM lineitem WHERE l_partkey % 7 > 0),
    l AS (SELECT doc_id, block_no, line_no, string_agg(t, ' ' ORDER BY t) AS line, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, max(size) AS size, bool_or(bold) AS bold FROM b GROUP BY 1, 2, 3)
    SELECT doc_id, printf('text_p001_%02d', block_no) AS text_block_id, string_agg(line, chr(10) ORDER BY line_no) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, max(size) AS max_font_size, bool_or(bold) AS is_bold FROM l GROUP BY doc_id, block_no""",
    "lineitem",
)
def text_block_assembly(lines: DataFrame) -> DataFrame:
    """Spans to lines and blocks with their box and fonts; blank spans dropped."""
    order = F.dense_rank().over(Window.partitionBy("l_orderkey", "l_linenumber", F.col("l_suppkey") % 3).orderBy(F.concat(F.lit("p"), F.col("l_partkey").cast("string"))))
    spans = lines.select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_number"), (F.col("l_suppkey") % 3).cast("int").alias("block_no"), F.col("l_linenumber").alias("line_no"), order.alias("span_no"), F.when(F.col("l_partkey") % 7 > 0, F.concat(F.lit("p"), F.col("l_partkey").cast("string"))).otherwise(" ").alias("text"),
        (F.col("l_partkey") % 5 + 8).cast("double").alias("size"), F.when(F.col("l_partkey") % 4 == 0, "Arial-Bold").otherwise("Arial").alias("font"), F.col("l_quantity").alias("x0"), (F.col("l_linenumber") * 10).cast("double").alias("y0"), (F.col("l_quantity") + 30).alias("x1"), (F.col("l_linenumber") * 10 + 8).cast("double").alias("y1"),
    )
    return pages.text_blocks(spans).select("doc_id", "text_block_id", "text", "bbox.*", "max_font_size", "is_bold")


@_query(
    """WITH w AS (SELECT l_orderkey AS doc_id, l_linenumber % 2 AS line_num, 'w' || l_partkey AS t, CAST(round(l_discount * 100) AS INTEGER) - 1 AS conf, l_quantity AS x0, CAST(l_partkey % 50 AS DOUBLE) AS y0, l_quantity + 20 AS x1, CAST(l_partkey % 50 + l_linenumber AS DOUBLE) AS y1 FROM lineitem WHERE round(l_discount * 100) >= 1)
    SELECT doc_id, line_num, string_agg(t, ' ' ORDER BY x0 * 2, y0 * 2, t) AS text, min(x0) * 2 AS x0, min(y0) * 2 AS y0, max(x1) * 2 AS x1, max(y1) * 2 AS y1, max(y1 - y0) * 2 AS max_font_size, CAST(sum(conf) AS DOUBLE) / count(*) AS confidence FROM w GROUP BY 1, 2""",
    "lineitem",
)
def ocr_line_assembly(lines: DataFrame) -> DataFrame:
    """Recognised words to lines: in order of place, rejected words dropped."""
    words = lines.select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_number"), F.lit(1).alias("block_num"), F.lit(1).alias("par_num"), (F.col("l_linenumber") % 2).alias("line_num"), F.concat(F.lit(" w"), F.col("l_partkey").cast("string")).alias("text"), (F.round(F.col("l_discount") * 100) - 1).alias("conf"),
        F.col("l_quantity").alias("x0"), (F.col("l_partkey") % 50).cast("double").alias("y0"), (F.col("l_quantity") + 20).alias("x1"), (F.col("l_partkey") % 50 + F.col("l_linenumber")).cast("double").alias("y1"),
    )
    return pages.ocr_lines(words, 2.0).select("doc_id", "line_num", "text", "bbox.*", "max_font_size", "confidence")


@_query(
    """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 4 IN (0, 2) AND doc_id % 8 < 6 THEN 'ocr' ELSE 'hybrid' END WHEN doc_id % 4 = 1 THEN 'native' ELSE 'none' END AS text_source,
    CASE WHEN doc_id % 8 = 6 OR doc_id % 4 = 1 THEN 'Native text of document ' || doc_id || ', long enough.' WHEN doc_id % 2 = 0 THEN 'recognised text ' || doc_id ELSE '' END AS final_text, CAST(CASE WHEN doc_id % 2 = 0 THEN length('recognised text ' || doc_id || chr(10) || 'Page 3') ELSE 0 END AS INTEGER) AS ocr_text_chars FROM documents""",
    "documents",
)
def ocr_merge(docs: DataFrame) -> DataFrame:
    """Recognised text where native text is short, native text where it is not."""
    k = F.col("doc_id")
    native = F.when((k % 8 == 6) | (k % 4 == 1), F.concat(F.lit("Page 1\n\nNative  text of document "), k.cast("string"), F.lit(", long enough."))).when(k % 2 == 0, "short")
    pages_ = docs.select("doc_id", F.lit(1).alias("page_number"), native.alias("native_text"))
    ocr = docs.where("doc_id % 2 = 0").select("doc_id", F.lit(1).alias("page_number"), F.concat(F.lit("recognised text "), k.cast("string"), F.lit("\nPage 3")).alias("ocr_text"))
    return pages.merge_ocr(pages_, ocr).select("doc_id", "text_source", "final_text", "ocr_text_chars")


# -- quality rules over documents ------------------------------------------------------------------------------

def _o() -> Column:
    return F.col("o_orderkey")



def _qa_inputs(orders: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A document per order; each rule fires where the order's key is divisible by a number of its own."""
    hit = lambda n: _o() % n == 0
    required = ["blocks", "images", "pages", "patient", "report", "results", "tables", "validation_report"]
    keys = F.when(hit(11), F.array(*map(F.lit, required[:-2]))).otherwise(F.array(*map(F.lit, required)))
    names = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    final, stained = names("trichuris"), F.when(hit(7), names("trichuris")).when(hit(5), names("ankylostoma", " Ankylostoma")).otherwise(names("ankylostoma"))
    sections = ["final_result", "staining_exam", "enrichment_exam", "microscopic_exam"]
    detected = F.when(hit(13), F.create_map(F.lit("final_result"), final)).when(hit(17), F.create_map(F.lit("none"), final).cast("map<string,array<string>>")).otherwise(F.map_from_arrays(names(*sections), F.array(final, stained, F.when(hit(19), F.lit(None).cast("array<string>")).otherwise(names()), names())))
    docs = orders.select(
        _o().cast("string").alias("doc_id"), keys.alias("keys"), F.when(hit(2), "parasitology_stool_report").otherwise("biology_report").alias("document_type"), F.when(hit(23), "").when(hit(29), "bad id!").otherwise("p-1").alias("patient_id"), F.when(~hit(31), "s1").alias("sample_id"),
        F.when(hit(37), None).when(hit(41), "01/02/2024").otherwise("2024-02-01").alias("report_date"), F.when(~hit(43), 5).alias("raw_rows"), F.lit(3).alias("canonical_rows"), F.when(hit(47), 1).otherwise(2).alias("removed_rows"), F.when(hit(53), 1).otherwise(0).alias("consistency_issues"),
        F.when(hit(59), 2).otherwise(0).alias("missing_from_raw"), F.when(~hit(61), "c").alias("checks"), F.when(hit(67), None).when(hit(71), "d").otherwise("c").alias("root_checks"), F.when(hit(73), None).when(hit(79), "inconsistent").when(hit(83), "odd").when(hit(3), "consistent").otherwise("discordant_findings").alias("status"), detected.alias("detected"),
    )
    nth = lambda n: F.explode(F.sequence(F.lit(1), n)).alias("row")
    rows = orders.where(~hit(89)).select(
        _o().cast("string").alias("doc_id"), nth(F.when(hit(97), 2).otherwise(1)), F.when(hit(101), "qualitative").otherwise("numeric").alias("result_kind"), F.when(~hit(103), "Glucose").alias("analyte"), F.lit("5").alias("value_raw"), F.when(~hit(107), 5.0).alias("value_numeric"), F.when(~hit(109), "mg/dL").alias("unit"), F.lit("s").alias("section"),
        F.when(~hit(113), 1).alias("page_number"), F.when(hit(127), "2024/01/01").otherwise("2024-01-01").alias("observation_date"), F.when(hit(131), 9.0).otherwise(1.0).alias("low"), F.lit(8.0).alias("high"), F.lit("k").alias("dedup_key"), F.lit(0.9).alias("score"),
    )
    blocks = orders.where(~hit(137)).select(_o().alias("k"), _o().cast("string").alias("doc_id"), nth(F.when(hit(139), 6).when(hit(149), 2).otherwise(1))).select("doc_id", F.col("row").alias("pos"), F.when(F.col("k") % 149 == 0, "Same text").otherwise(F.concat(F.lit("text "), F.col("row").cast("string"))).alias("text"), F.lit(True).alias("is_indexable"), F.lit(0.9).alias("score"))
    shown = orders.select(_o().cast("string").alias("doc_id"), F.lit(1).alias("page_number"), F.when(hit(151), "Document synthétique").otherwise("text").alias("final_text"))
    return docs, rows, blocks, shown


def _fires(code: str, severity: str, when: str, times: str = "1") -> str:
    return f"SELECT o_orderkey, '{code}' AS code, '{severity}' AS severity, {times} AS n FROM k WHERE {when}"


_STATUS = "(CASE WHEN o_orderkey % 73 = 0 THEN NULL WHEN o_orderkey % 79 = 0 THEN 'inconsistent' WHEN o_orderkey % 83 = 0 THEN 'odd' WHEN o_orderkey % 3 = 0 THEN 'consistent' ELSE 'discordant_findings' END)"
_QA_SQL = " UNION ALL ".join(
    [
        _fires("missing_top_level_sections", "FAIL", "o_orderkey % 11 = 0"), _fires("missing_patient_id", "FAIL", "o_orderkey % 23 = 0"), _fires("invalid_patient_id", "FAIL", "o_orderkey % 23 > 0 AND o_orderkey % 29 = 0"), _fires("missing_sample_id", "FAIL", "stool AND o_orderkey % 31 = 0"),
        _fires("missing_report_date", "FAIL", "NOT stool AND o_orderkey % 37 = 0"), _fires("invalid_report_date", "FAIL", "NOT stool AND o_orderkey % 37 > 0 AND o_orderkey % 41 = 0"),
        _fires("missing_result_fields", "FAIL", "results > 0 AND (o_orderkey % 103 = 0 OR CASE WHEN stool THEN o_orderkey % 113 = 0 ELSE o_orderkey % 109 = 0 OR (o_orderkey % 101 > 0 AND o_orderkey % 107 = 0) END)", "results"),
        _fires("invalid_observation_date", "FAIL", "results > 0 AND NOT stool AND o_orderkey % 127 = 0", "results"), _fires("invalid_reference_range", "FAIL", "results > 0 AND o_orderkey % 101 > 0 AND o_orderkey % 131 = 0", "results"), _fires("duplicate_dedup_keys", "FAIL", "results > 1"),
        _fires("invalid_dedup_counts", "FAIL", "o_orderkey % 43 > 0 AND o_orderkey % 47 = 0"), _fires("missing_dedup_counts", "FAIL", "o_orderkey % 43 = 0"), _fires("validation_report_consistency_issues", "WARNING", "o_orderkey % 53 = 0"), _fires("missing_from_raw_tables", "WARNING", "o_orderkey % 59 = 0"),
        _fires("uniform_confidence_scores", "WARNING", "results + blocks >= 6"), _fires("page_boilerplate_present", "WARNING", "o_orderkey % 151 = 0"), _fires("repeated_indexable_blocks", "WARNING", "blocks > 1 AND o_orderkey % 149 = 0"), _fires("missing_results", "FAIL", "results = 0"), _fires("missing_blocks", "FAIL", "blocks = 0"),
        _fires("missing_validation_report_consistency_checks", "WARNING", "stool AND o_orderkey % 61 = 0"), _fires("missing_consistency_checks", "WARNING", "stool AND o_orderkey % 67 = 0"), _fires("consistency_checks_mismatch", "FAIL", "stool AND o_orderkey % 61 > 0 AND o_orderkey % 67 > 0 AND o_orderkey % 71 = 0"),
        _fires("missing_parasite_consistency", "WARNING", f"stool AND o_orderkey % 61 > 0 AND {_STATUS} IS NULL"), _fires("legacy_parasite_consistency_status", "FAIL", f"judged AND {_STATUS} = 'inconsistent'"), _fires("invalid_parasite_consistency_status", "FAIL", f"judged AND {_STATUS} = 'odd'"),
        _fires("missing_detected_section_keys", "WARNING", "judged AND (o_orderkey % 13 = 0 OR o_orderkey % 17 = 0)"), _fires("invalid_detected_section_values", "WARNING", "judged AND whole AND o_orderkey % 19 = 0"), _fires("duplicate_detected_entities", "WARNING", "judged AND whole AND o_orderkey % 7 > 0 AND o_orderkey % 5 = 0"),
        _fires("discordance_has_overlap", "WARNING", f"judged AND whole AND {_STATUS} = 'discordant_findings' AND o_orderkey % 7 = 0"), _fires("false_consistent_parasite_status", "WARNING", f"judged AND whole AND {_STATUS} = 'consistent' AND o_orderkey % 7 > 0"),
    ]
)


@_query(
    f"""WITH k AS (SELECT o_orderkey, o_orderkey % 2 = 0 AS stool, o_orderkey % 2 = 0 AND o_orderkey % 61 > 0 AND {_STATUS} IS NOT NULL AS judged, o_orderkey % 13 > 0 AND o_orderkey % 17 > 0 AS whole, CASE WHEN o_orderkey % 89 = 0 THEN 0 WHEN o_orderkey % 97 = 0 THEN 2 ELSE 1 END AS results,
    CASE WHEN o_orderkey % 137 = 0 THEN 0 WHEN o_orderkey % 139 = 0 THEN 6 WHEN o_orderkey % 149 = 0 THEN 2 ELSE 1 END AS blocks FROM orders), i AS ({_QA_SQL}) SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, code, severity, CAST(sum(n) AS BIGINT) AS n FROM i GROUP BY ALL""",
    "orders",
)
def qa_document_rules(orders: DataFrame) -> DataFrame:
    """The rules for extracted documents, each firing on documents of its own."""
    return qa.document_issues(*_qa_inputs(orders)).groupBy("doc_id", "code", "severity").agg(F.count("*").alias("n"))


@_query("SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, 'FAIL' AS status, CAST(80 AS INTEGER) AS score, 'extraction_exception' AS code, 'error ' || o_orderkey AS message FROM orders WHERE o_orderkey % 50 = 0", "orders")
def qa_failed_documents(orders: DataFrame) -> DataFrame:
    """Documents whose extraction broke off, judged like all others."""
    failed = orders.where("o_orderkey % 50 = 0").select(_o().cast("string").alias("doc_id"), F.concat(F.lit("error "), _o().cast("string")).alias("error"))
    judged = qa.evaluate(failed, qa.failed_documents(failed))
    return judged.select("doc_id", "status", "score", F.col("issues")[0]["code"].alias("code"), F.col("issues")[0]["message"].alias("message"))


# -- report rows from patient exports ---------------------------------------------------------------------------

_DESCRIBED = {"click": "Glucose [Mass/volume] in Blood", "view": "HDL Cholesterol", "error": "Hemoglobin A1c", "purchase": "Tobacco smoking status", "signup": "Body Weight"}
_OBSERVED_SQL = "(SELECT user_id AS patient, event_id AS n, " + "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _DESCRIBED.items()) + " END AS description, CAST(floor(value) AS BIGINT) AS v, date_trunc('second', ts) AS moment FROM events)"


def _observations(events: DataFrame) -> DataFrame:
    described = parse.look_up(_DESCRIBED, F.col("event_type"))
    return events.select(F.col("user_id").alias("patient"), F.col("event_id").alias("row"), described.alias("description"), F.floor("value").cast("string").alias("value"), F.lit("u").alias("units"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("date"), F.lit(" ").alias("type"))


_RANGE_SQL = "CASE WHEN description LIKE 'Glucose%' THEN [70, 99] WHEN description LIKE '%Cholesterol' THEN [0, 200] WHEN description LIKE 'Hemoglobin%' THEN [12, 17.5] WHEN description LIKE 'Body Weight' THEN [50, 100] END"
_REPORT_SQL = f"""WITH o AS (SELECT *, count(*) FILTER (description NOT LIKE 'Tobacco%') OVER (PARTITION BY patient) AS wanted FROM {_OBSERVED_SQL}),
  s AS (SELECT * FROM o WHERE wanted < 6 OR description NOT LIKE 'Tobacco%' QUALIFY row_number() OVER (PARTITION BY patient, description ORDER BY moment DESC, n) = 1),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY patient ORDER BY moment DESC, n) AS INTEGER) AS position, {_RANGE_SQL} AS bounds FROM s)
  SELECT patient, position, description, CAST(v AS VARCHAR) AS result, 'u' AS units, CASE WHEN bounds IS NULL THEN 'Context dependent' WHEN description LIKE 'Hemoglobin%' THEN '12 - 17.5' ELSE CAST(CAST(bounds[1] AS INTEGER) AS VARCHAR) || ' - ' || CAST(CAST(bounds[2] AS INTEGER) AS VARCHAR) END AS reference,
  CASE WHEN v < bounds[1] THEN 'L' WHEN v > bounds[2] THEN 'H' ELSE '' END AS flag, strftime(moment, '%d %b %Y') AS date, 'Observation' AS kind FROM r WHERE position <= 12"""


@_query(_REPORT_SQL, "events")
def report_result_rows(events: DataFrame) -> DataFrame:
    """A patient's report rows: preferred descriptions, the newest of each, with range and flag."""
    return reports.report_rows(_observations(events))


@_query(
    f"""WITH r AS ({_REPORT_SQL}), f AS (SELECT patient, list(description || CASE flag WHEN 'H' THEN ' is elevated' ELSE ' is reduced' END ORDER BY position) FILTER (flag IN ('H', 'L')) AS said FROM r GROUP BY 1),
    c AS (SELECT o_custkey AS patient, list(o_orderpriority ORDER BY d DESC, k) AS names FROM (SELECT o_custkey, o_orderpriority, max(CAST(o_orderdate AS DATE)) AS d, arg_min(o_orderkey, (-epoch(CAST(o_orderdate AS DATE)), o_orderkey)) AS k FROM orders GROUP BY 1, 2) GROUP BY 1)
    SELECT patient, CASE WHEN len(said) > 0 THEN 'Review of the most recent measurements indicates that ' || array_to_string(said[1:4], '; ') || '.' ELSE 'No measurement is outside its reference interval.' END || coalesce(' Documented background problems include ' || array_to_string(names[1:3], ', ') || '.', '') AS impression FROM f LEFT JOIN c USING (patient)""",
    "events",
    "orders",
)
def report_impressions(events: DataFrame, orders: DataFrame) -> DataFrame:
    """Flagged rows and the newest conditions in words."""
    conditions = orders.select(F.col("o_custkey").alias("patient"), _o().alias("row"), F.col("o_orderpriority").alias("description"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("start"))
    return reports.impression(reports.report_rows(_observations(events)), reports.conditions_of(conditions))


@_query(
    f"""WITH m AS (SELECT patient, description FROM (SELECT patient, description, count(*) AS c FROM {_OBSERVED_SQL} GROUP BY 1, 2 HAVING count(*) >= 3) QUALIFY row_number() OVER (PARTITION BY patient ORDER BY c DESC, description) = 1),
    l AS (SELECT * FROM {_OBSERVED_SQL} JOIN m USING (patient, description) QUALIFY row_number() OVER (PARTITION BY patient ORDER BY moment DESC, n DESC) <= 8)
    SELECT patient, description, CAST(row_number() OVER (PARTITION BY patient ORDER BY moment, n) AS INTEGER) AS position, CAST(v AS DOUBLE) AS number FROM l""",
    "events",
)
def report_trends(events: DataFrame) -> DataFrame:
    """The last points of a patient's most frequent measurement."""
    return reports.trend(_observations(events)).select("patient", "description", "position", "number")


@_query(
    """WITH l AS (SELECT o_custkey AS patient, o_orderkey AS k FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey) = 1)
    SELECT c_custkey AS patient, coalesce(n_name, 'Unknown facility') AS facility_name, CASE WHEN n_name IS NULL THEN '-' ELSE 'Street ' || n_nationkey || ', MA' END AS facility_address, coalesce(s_name, '-') AS provider_name, CASE WHEN s_name IS NULL THEN '-' ELSE 'GENERAL' END AS provider_specialty
    FROM customer LEFT JOIN l ON patient = c_custkey LEFT JOIN nation ON n_nationkey = k % 30 LEFT JOIN supplier ON s_suppkey = k % 120""",
    "customer",
    "orders",
    "nation",
    "supplier",
)
def report_contexts(customer: DataFrame, orders: DataFrame, nation: DataFrame, supplier: DataFrame) -> DataFrame:
    """Patients with the organisation and provider of their latest encounter, or defaults."""
    encounters = orders.select(F.col("o_custkey").alias("patient"), _o().alias("row"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("start"), (_o() % 30).cast("string").alias("organization"), (_o() % 120).cast("string").alias("provider"))
    places = nation.select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), F.concat(F.lit(" Street "), F.col("n_nationkey").cast("string")).alias("address"), F.lit("").alias("city"), F.lit("MA").alias("state"), F.lit(None).cast("string").alias("phone"))
    people = supplier.select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), F.lit("GENERAL").alias("speciality"))
    found = reports.patient_context(customer.select(_k().alias("patient")), encounters, places, people, {"facility_name": "Unknown facility"})
    return found.select("patient", "facility_name", "facility_address", "provider_name", "provider_specialty")


# -- small functions ---------------------------------------------------------------------------------------------

_FLAGS = ((" h ", "H"), ("-", None), ("N", None), ("nan", None), ("L", "L"), ("", None), (":", None), ("hh", "HH"))
_ANALYTES = (
    ("Glucose [Mass/volume] in Pinema", "Glucose [Mass/volume] in Plasma"), ("Automated count Leukocytes ra", "Leukocytes"), ("Cholesterol (Moles/volume] in P Plasma", "Cholesterol [Moles/volume] in Plasma"), ("Sodium earns [ Moles/volume ]", "Sodium [Moles/volume]"),
)
_NUMBERS = ((4.5, "4.5"), (130.0, "130"), (0.25, "0.25"), (12.3, "12.3"), (7.0, "7"))
_FRAGMENTS = ((["Alpha beta", "alpha  BETA", "gamma"], "Alpha beta/gamma"), (["beta", "Alpha beta", "-"], "beta"), (["one", "two", ""], "one/two"))


@_query(
    f"SELECT c_custkey, 'page_' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') AS page, {_pick_sql('c_custkey', *(b for _, b in _FLAGS))} AS flag, {_pick_sql('c_custkey', *(b for _, b in _ANALYTES))} AS analyte, {_pick_sql('c_custkey', *(b for _, b in _NUMBERS))} AS number, "
    f"{_pick_sql('c_custkey', *(b for _, b in _FRAGMENTS))} AS fragments, CASE c_custkey % 4 WHEN 0 THEN NULL ELSE CAST(c_custkey % 100 AS DOUBLE) + 0.5 END AS safe, CASE WHEN c_custkey % 2 = 0 THEN 'dir/' || c_custkey ELSE '/other/' || c_custkey END AS path FROM customer",
    "customer",
)
def scalar_cleanup(customer: DataFrame) -> DataFrame:
    numbers = F.element_at(F.array(*(F.lit(a) for a, _ in _NUMBERS)), (_k() % len(_NUMBERS) + 1).cast("int"))
    parts = F.element_at(F.array(*(F.array(*map(F.lit, a)) for a, _ in _FRAGMENTS)), (_k() % len(_FRAGMENTS) + 1).cast("int"))
    said = F.when(_k() % 4 == 0, "12 mg").otherwise(F.concat(F.lit(" "), (_k() % 100).cast("string"), F.lit(",5 ")))
    place = F.when(_k() % 2 == 0, F.concat(F.lit("/root/dir/"), _k().cast("string"))).otherwise(F.concat(F.lit("/other/"), _k().cast("string")))
    return customer.select(
        "c_custkey", text.page_name((_k() % 1000).cast("int")).alias("page"), parse.normalize_flag(_pick(_k(), *(a for a, _ in _FLAGS))).alias("flag"), text.ocr_analyte(_pick(_k(), *(a for a, _ in _ANALYTES))).alias("analyte"), parse.format_repaired(numbers).alias("number"),
        F.array_join(text.dedupe_fragments(parts), "/").alias("fragments"), parse.safe_float(said).alias("safe"), documents.relative_path(place, "/root").alias("path"),
    )


@_query("SELECT user_id, CASE WHEN n = 0 THEN 0::DOUBLE ELSE round(t / n, 3) END AS score, CASE WHEN n > 0 AND t / n >= 0.85 THEN 'high' WHEN n > 0 AND t / n >= 0.6 THEN 'medium' ELSE 'low' END AS label FROM (SELECT user_id, sum((event_id % 5) * 0.25) AS t, count(*) FILTER (event_id % 5 > 0) AS n FROM events GROUP BY 1)", "events")
def mean_positive_scores(events: DataFrame) -> DataFrame:
    """Mean of the scores above zero, with its band."""
    per = events.groupBy("user_id").agg(F.collect_list((F.col("event_id") % 5) * F.lit(0.25)).alias("scores"))
    return per.select("user_id", confidence.mean_positive(F.col("scores")).alias("c")).select("user_id", "c.score", "c.label")


@_query("SELECT a.event_id AS anchor, CAST(count(*) AS BIGINT) AS items FROM events a JOIN events b ON a.user_id = b.user_id AND b.value >= a.value AND b.value < a.value + 5 WHERE a.event_type = 'signup' GROUP BY 1", "events")
def value_bands(events: DataFrame) -> DataFrame:
    """Rows whose position lies in an anchor's half-open band, keys alike."""
    anchors = events.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("anchor"), F.col("value").alias("low"), (F.col("value") + 5).alias("high"))
    return rel.band_join(anchors, events.select("user_id", F.col("value").alias("at")), ["user_id"], "low", "high", "at").groupBy("anchor").agg(F.count("*").alias("items"))


@_query("SELECT c_custkey, line, name, value FROM " + _rows_sql("line, name, value", ["0, 'Name', ': ' || c_name", "2, 'Segment', ': ' || c_mktsegment", "5, 'Key', ': ' || c_custkey"]), "customer")
def label_value_pairs(customer: DataFrame) -> DataFrame:
    """Lines followed by one that begins with a colon; a line that served as a value begins no pair."""
    lines = F.array(F.lit("Name"), F.concat(F.lit(": "), "c_name"), F.lit("Segment"), F.concat(F.lit(": "), "c_mktsegment"), F.lit(": again"), F.lit("Key"), F.concat(F.lit(": "), _k().cast("string")), F.lit("end"))
    return customer.select("c_custkey", F.explode(rel.pair_lines(lines)).alias("p")).select("c_custkey", F.col("p.at").alias("line"), "p.name", "p.value")


# -- the whole pipeline of generic reports -----------------------------------------------------------------------------


def _generic_report(customer: DataFrame, varied: bool = False) -> Relations:
    """One report per customer; ``varied``: some without a patient's table, some without tables of results, of which half have a result in their text."""
    doc = _k().cast("string").alias("doc_id")
    shown = F.concat(F.lit("Rapport d'imagerie de "), "c_name")
    cells = raw_tables(customer).withColumn("page_number", F.lit(1))
    if varied:
        k = F.col("doc_id").cast("bigint")
        cells = cells.where(~((k % 6 == 5) & (F.col("table_id") == "t1")) & ~((k % 4 == 1) & F.col("table_id").isin("t3", "t4")))
        shown = F.when(_k() % 8 == 1, F.concat(shown, F.lit("\nSodium level "), (_k() % 20 + 130).cast("string"), F.lit(" mmol/L 135 - 145 12/03/2023"))).otherwise(shown)
    pages_ = customer.select(doc, F.lit(1).alias("page_number"), shown.alias("final_text"), shown.alias("native_text"))
    said = [
        (F.concat(F.lit("Hopital "), "c_mktsegment", F.lit(" - Tel. 05 36 "), _k().cast("string")), 40, 20), (F.lit("Résultats"), 40, 200), (F.lit("Synthèse clinique"), 40, 400), (F.concat(F.lit("Etat stable de "), "c_name"), 40, 420), (F.lit("Validation médicale"), 40, 600),
        (F.lit("Dr. Z"), 40, 620), (F.lit("CARDIO"), 40, 640), (F.lit("Document synthétique"), 40, 800),
    ]
    box = lambda x, y, w, h: geometry.box(F.lit(x), F.lit(y), F.lit(x + w), F.lit(y + h))
    every = F.posexplode(F.array(*(F.struct(t.alias("text"), box(x, y, 200, 12).alias("bbox")) for t, x, y in said))).alias("pos", "b")
    blocks = customer.select(doc, F.lit(1).alias("page_number"), every).select("doc_id", "page_number", "pos", "b.text", "b.bbox", F.lit("native").alias("source"))
    pictures = F.explode(F.array(*(F.struct(F.lit(n).alias("image_id"), F.lit(i).alias("xref"), b.alias("bbox")) for i, (n, b) in enumerate([("sign", box(60, 655, 80, 40)), ("scan", box(0, 0, 595, 842))])))).alias("i")
    images = customer.select(doc, F.lit(1).alias("page_number"), pictures).select("doc_id", "page_number", "i.*", F.lit(595.0).alias("width"), F.lit(842.0).alias("height"))
    return pipeline.extract(pages_, blocks, cells, images)


@_query(
    f"SELECT {_ID}, printf('block_%03d', place) AS block_id, block_type, body FROM "
    + _rows_sql(
        "place, block_type, body",
        [
            "1, 'document_header', 'Hopital ' || c_mktsegment || ' - Tel. 05 36 ' || c_custkey", "2, 'facility_block', 'Hopital ' || c_mktsegment || ' - Tel. 05 36 ' || c_custkey",
            *(f"{i + 3}, '{kind}', replace(({row.split(', ', 5)[5]}), chr(10), ' ')" for i, (kind, row) in enumerate(zip(("patient_info_block", "report_info_block", "results_table_block"), _TABLES))),
            "6, 'summary_block', 'Synthèse clinique Etat stable de ' || c_name", "7, 'validation_block', 'Validation médicale Dr. Z CARDIO'", "8, 'footer_block', 'Document synthétique'",
        ],
    ),
    "customer",
)
def generic_report_blocks(customer: DataFrame) -> DataFrame:
    """The semantic blocks of a generic report's page."""
    return _generic_report(customer)["blocks"].select("doc_id", "block_id", "block_type", F.col("text").alias("body"))


@_query(
    f"""WITH r AS (SELECT *, c_custkey % 6 = 5 AS nameless, c_custkey % 4 = 1 AS tableless, c_custkey % 8 = 5 AS resultless FROM customer)
    SELECT {_ID}, 'imaging_report' AS document_type, 1 AS page_count, CASE WHEN NOT nameless THEN c_name END AS patient, CASE WHEN NOT nameless THEN {_UUID_SQL} END AS patient_id, CASE WHEN NOT nameless THEN {_pick_sql('c_custkey', 'F', 'M', '?')} END AS sex,
    'RAP' || c_custkey AS report_id, '2023-03-01' AS report_date, 'Hopital ' || c_mktsegment AS address, 'Dr. Z' AS validated_by, CASE WHEN NOT tableless THEN 'Glucose [Mass/volume] in Blood=' || {_SUGAR} || ';Potassium [Moles/volume] in Serum or Plasma=' || {_POTASSIUM} WHEN NOT resultless THEN 'Sodium level=' || (c_custkey % 20 + 130) ELSE '' END AS results,
    'document_header,facility_block,' || CASE WHEN nameless THEN '' ELSE 'patient_info_block,' END || 'report_info_block,results_table_block,summary_block,validation_block,footer_block' AS blocks,
    CASE WHEN nameless THEN '' ELSE 't1,' END || 't2,' || CASE WHEN tableless THEN '' ELSE 't3,' END || 't5' AS tables, 'sign/signature' AS images, CASE WHEN NOT resultless THEN 0 END AS missing_from_raw,
    CASE WHEN nameless OR resultless THEN 'FAIL' ELSE 'PASS' END AS status, CAST(100 - 20 * CAST(nameless AS INTEGER) - 20 * CAST(resultless AS INTEGER) AS INTEGER) AS score,
    concat_ws(',', CASE WHEN nameless THEN 'missing_patient_id' END, CASE WHEN resultless THEN 'missing_results' END) AS codes FROM r""",
    "customer",
)
def generic_documents(customer: DataFrame) -> DataFrame:
    """The whole pipeline of generic reports: extraction, quality rules and export as one JSON document each, read back."""
    r = _generic_report(customer, varied=True)
    schema = (
        "document_type string, page_count int, patient struct<name string, patient_id string, sex string>, report struct<report_id string, report_date string>, facility struct<address string>, validation struct<validated_by string>, results array<struct<analyte string, value_raw string>>, "
        "blocks array<struct<block_type string>>, tables array<struct<table_id string>>, images array<struct<image_id string, type string>>, validation_report struct<missing_from_raw int>, judged struct<status string, score int>"
    )
    d = pipeline.export(r).select("doc_id", F.from_json("document", schema).alias("d")).join(r["judged"].select("doc_id", F.array_join("issues.code", ",").alias("codes")), "doc_id")
    said = lambda c, f: F.coalesce(F.array_join(F.transform(c, f), ","), F.lit("")).alias(c.split(".")[-1])
    found = F.coalesce(F.array_join(F.transform("d.results", lambda x: F.concat(x["analyte"], F.lit("="), x["value_raw"])), ";"), F.lit(""))
    return d.select(
        "doc_id", "d.document_type", "d.page_count", F.col("d.patient.name").alias("patient"), "d.patient.patient_id", "d.patient.sex", "d.report.report_id", "d.report.report_date", "d.facility.address", "d.validation.validated_by", found.alias("results"), said("d.blocks", lambda b: b["block_type"]),
        said("d.tables", lambda t: t["table_id"]), said("d.images", lambda i: F.concat_ws("/", i["image_id"], i["type"])), "d.validation_report.missing_from_raw", "d.judged.status", "d.judged.score", "codes",
    )


@_query(
    f"""SELECT CAST(c_custkey AS VARCHAR) AS doc_id, CASE WHEN c_custkey % 3 = 0 THEN 'parasitology_stool_report' ELSE 'biology_report' END AS document_type, c_name AS patient, CASE WHEN c_custkey % 3 = 0 THEN 8 ELSE 3 END AS results, CASE WHEN c_custkey % 3 = 0 THEN 10 ELSE -1 END AS blocks,
    CASE WHEN c_custkey % 3 = 0 THEN 10 ELSE -1 END AS page_blocks, CASE WHEN c_custkey % 3 = 0 THEN {_COLOUR} END AS colour FROM customer""",
    "customer",
)
def export_by_type(customer: DataFrame) -> DataFrame:
    """Documents of several types in one extraction, each exported in its own view; blocks on document and page with their fields."""
    pages_ = stool_pages(customer.where("c_custkey % 3 = 0")).union(hospital_pages(customer.where("c_custkey % 3 > 0")))
    block = "array<struct<block_type string, structured_fields struct<results array<struct<result string>>>>>"
    schema = f"document_type string, patient struct<name string>, results array<struct<row_index int>>, blocks {block}, pages array<struct<blocks {block}>>"
    d = documents.export(documents.extract(pages_, share=True)).select("doc_id", F.from_json("document", schema).alias("d"))
    inner = F.get("d.pages", F.lit(0))["blocks"]
    colour = F.get(F.filter(inner, lambda b: b["block_type"] == "macroscopic_exam_block"), F.lit(0))["structured_fields"]["results"][0]["result"]
    count = lambda c: F.coalesce(F.size(c), F.lit(-1))
    return d.select("doc_id", "d.document_type", F.col("d.patient.name").alias("patient"), F.size("d.results").alias("results"), count("d.blocks").alias("blocks"), count(inner).alias("page_blocks"), colour.alias("colour"))


_HEAD_JSON = "'\"request_date\":\"2024-06-03T10:15:00\",\"received_date\":\"2024-06-03T11:00:00\"'"
_SAMPLE = "'\"sample_id\":\"' || (c_custkey + 240000) || '\"'"


def _result_json(row: int, section: str, title: str, name: str, value: str, kind: str, meaning: str, abnormal: str) -> str:
    """The first names of a result's object, up to its meaning."""
    return f"""'{{"row_index":{row},"parameter":"{name}","result":"' || {value} || '","section":"{section}","section_name":"{title}","result_kind":"' || {kind} || '","clinical_significance":"' || {meaning} || '","abnormal":' || {abnormal}"""


_STAIN_KIND = "CASE WHEN c_custkey % 3 = 1 THEN 'qualitative' ELSE 'microscopy_finding' END"
_STAIN_MEANING = "CASE WHEN c_custkey % 3 = 1 THEN 'not_significant_or_expected' ELSE 'parasite_elements_detected' END"


@_query(
    f"SELECT {_ID}, block_type, fields FROM "
    + _rows_sql(
        "block_type, fields",
        [
            """'facility_block', '{"country":"Maroc","organization":"Centre Hospitalo-Universitaire Mohammed VI - Oujda","department":"Laboratoire Central","laboratory":"Laboratoire de Parasitologie Mycologie","source":"native_text_section_parser"}'""",
            f"""'patient_info_block', '{{"patient_id":"' || c_custkey || '","patient_name":"' || c_name || '","birth_date":"' || (1940 + c_custkey % 60) || '-02-01","reported_age":40,"computed_age_at_request_date":' || (84 - c_custkey % 60) || ',"age_consistency_status":"' || CASE WHEN abs(44 - c_custkey % 60) <= 1 THEN 'consistent' ELSE 'inconsistent_with_birth_date' END || '","sex":"F","origin":"Externe","prescriber":"Dr. X",' || {_HEAD_JSON} || ',' || {_SAMPLE} || ',"sample_type":"SELLES","sample_label":"SELLES N°1","source":"native_text_section_parser"}}'""",
            f"""'report_metadata_block', '{{"exam_name":"EXAMEN PARASITOLOGIQUE DES SELLES",' || {_SAMPLE} || ',' || {_HEAD_JSON} || ',"origin":"Externe","prescriber":"Dr. X","sample_type":"SELLES","sample_label":"SELLES N°1","edited_date":"2024-06-04T12:04:25","edited_by":"A B","source":"native_text_section_parser"}}'""",
            f"""'sample_block', '{{"exam_name":"EXAMEN PARASITOLOGIQUE DES SELLES",' || {_SAMPLE} || ',"sample_type":"SELLES","sample_label":"SELLES N°1","source":"native_text_section_parser"}}'""",
            f"""'macroscopic_exam_block', '{{"results":[' || {_result_json(1, "macroscopic_exam", "EXAMEN MACROSCOPIQUE", "Couleur", _COLOUR, "'qualitative'", "'not_significant_or_expected'", "'false'")}""",
            f"""'microscopic_exam_block', '{{"results":[' || {_result_json(4, "microscopic_exam", "EXAMEN MICROSCOPIQUE", "Leucocytes", _WHITE, "'microscopy_finding'", "CASE WHEN c_custkey % 2 = 0 THEN 'inflammatory_finding' ELSE 'normal_or_absent_finding' END", "CAST(c_custkey % 2 = 0 AS VARCHAR)")}""",
            f"""'enrichment_exam_block', '{{"result":' || {_result_json(6, "enrichment_exam", "EXAMEN APRÈS ENRICHISSEMENT", "EXAMEN APRÈS ENRICHISSEMENT", "'Négatif'", "'qualitative'", "'not_significant_or_expected'", "'false'")}""",
            f"""'staining_exam_block', '{{"result":' || {_result_json(7, "staining_exam", "EXAMEN APRÈS COLORATION", "EXAMEN APRÈS COLORATION", _STAIN, _STAIN_KIND, _STAIN_MEANING, "CAST(c_custkey % 3 <> 1 AS VARCHAR)")}""",
            f"""'final_result_block', '{{"parameter":"RÉSULTAT FINAL","result":"' || {_FINAL} || '","result_kind":"pathogen_identification","clinical_significance":"pathogen_detected","source":"native_text_section_parser"}}'""",
            """'edition_block', '{"edited_by":"A B","edited_date":"2024-06-04T12:04:25","source":"native_text_section_parser"}'""",
        ],
    ),
    "customer",
)
def stool_block_fields(customer: DataFrame) -> DataFrame:
    """Named values of the ten blocks of each stool report; objects of results up to the first one's meaning."""
    found = pipeline.block_fields(documents.extract(stool_pages(customer), share=True))
    cut = F.when(F.col("block_type").isin("macroscopic_exam_block", "microscopic_exam_block", "enrichment_exam_block", "staining_exam_block"), F.regexp_extract("structured_fields", '^.*?"abnormal":(?:true|false)', 0)).otherwise(F.col("structured_fields"))
    return found.select("doc_id", "block_type", cut.alias("fields"))


def _record_sql(when: str, record: str, values: dict[str, str], source: str, sources: dict[str, str] | None = None) -> str:
    rows = ", ".join(f"('{f}', CAST({v} AS VARCHAR), '{(sources or {}).get(f, source)}')" for f, v in values.items())
    return f"SELECT CAST(c_custkey AS VARCHAR) AS doc_id, '{record}' AS record, f.* FROM customer, LATERAL (VALUES {rows}) AS f(field, canonical, source) WHERE {when}"


_STOOL, _HOSPITAL, _OTHER = ("c_custkey % 3 = 0", "c_custkey % 3 = 1", "c_custkey % 3 = 2")
_RECORDS_SQL = " UNION ALL ".join(
    [
        _record_sql(_STOOL, "patient", {"name": "c_name", "patient_id": "c_custkey", "birth_date": "(1940 + c_custkey % 60) || '-02-01'", "age": "84 - c_custkey % 60", "sex": "'F'", "age_consistency_status": "CASE WHEN abs(44 - c_custkey % 60) <= 1 THEN 'consistent' ELSE 'inconsistent_with_birth_date' END"}, "header"),
        _record_sql(_STOOL, "report", {"exam_name": "'EXAMEN PARASITOLOGIQUE DES SELLES'", "sample_id": "c_custkey + 240000", "sample_type": "'SELLES'", "sample_label": "'SELLES N°1'", "request_date": "'2024-06-03T10:15:00'", "received_date": "'2024-06-03T11:00:00'", "edited_date": "'2024-06-04T12:04:25'", "encounter_type": "'External'", "prescriber": "'Dr. X'", "specialty": "'LABORATOIRE DE PARASITOLOGIE MYCOLOGIE'"}, "header"),
        _record_sql(_STOOL, "validation", {"edited_by": "'A B'", "actor_status": "'edition_only'"}, "header"),
        _record_sql(_HOSPITAL, "patient", {"name": "c_name", "patient_id": "c_custkey", "age_consistency_status": "'unknown'"}, "header"),
        _record_sql(_HOSPITAL, "report", {"sample_id": "c_custkey + 980000", "request_date": "'2024-06-05T08:00:00'"}, "header"),
        _record_sql(_HOSPITAL, "validation", {"actor_status": "'missing'"}, "header"),
        _record_sql(_OTHER, "patient", {"name": "c_name", "patient_id": _UUID_SQL, "birth_date": "(1950 + c_custkey % 40) || '-03-07'", "age": "c_custkey % 90", "sex": _pick_sql("c_custkey", "F", "M", "?")}, "table"),
        _record_sql(_OTHER, "report", {"report_id": "'RAP' || c_custkey", "report_date": "'2023-03-01'", "encounter_type": _pick_sql("c_custkey", "External", "Urgent care"), "specialty": "'MÉDECINE INTERNE'"}, "table"),
        _record_sql(_OTHER, "validation", {"validated_by": "'Dr. Z'", "specialty": "'CARDIO'"}, "block"),
    ]
)


@_query(_RECORDS_SQL, "customer")
def records_of_all_kinds(customer: DataFrame) -> DataFrame:
    """Patient, report and validation of stool, hospital and other reports as one relation; each field with its source."""
    pages_ = stool_pages(customer.where("c_custkey % 3 = 0")).union(hospital_pages(customer.where("c_custkey % 3 = 1")))
    found = pipeline.records(documents.extract(pages_, share=True), _generic_report(customer.where("c_custkey % 3 = 2")))
    return found.select("doc_id", "record", "field", "canonical", "source")


# -- sources and sinks ----------------------------------------------------------------------------------------------------


def _folder(df: DataFrame, name: str) -> str:
    return f"{readers.work_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"


@_query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END AS name, 'c_custkey' AS found, 0 AS missing FROM customer", "customer")
def csv_source(customer: DataFrame) -> DataFrame:
    """A CSV file: strings, trimmed names, nothing for null; a file that is not there is an empty table."""
    path = _folder(customer, "csv")
    customer.select("c_custkey", F.when(_k() % 5 > 0, F.col("c_name")).alias(" name ")).write.option("header", True).csv(path)
    read = readers.csv(customer.sparkSession, path)
    none = readers.optional_csv(customer.sparkSession, path + "-missing", ["a", "b"]).agg(F.count("a").cast("int").alias("missing"))
    return read.select("*", F.lit(readers.column_named(read, ["Id", "C_CUSTKEY"])).alias("found")).join(none)


@_query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS version, CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END AS balance, CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END AS inner_balance FROM customer", "customer")
def json_document_sink(customer: DataFrame) -> DataFrame:
    """JSON documents: those written again are replaced, the others stay; numbers that JSON cannot hold are null at any depth."""
    path = _folder(customer, "documents")
    odd = F.when(_k() % 3 > 0, F.col("c_acctbal")).otherwise(float("nan"))
    rows = customer.select("c_custkey", odd.alias("balance"), F.array(F.struct(odd.alias("x"))).alias("nested"), F.pmod(_k(), F.lit(2)).alias("bucket"))
    readers.write_documents(rows.withColumn("version", F.lit("old")), path, "bucket")
    readers.write_documents(rows.where("bucket = 0").withColumn("version", F.lit("new")), path, "bucket")
    read = customer.sparkSession.read.schema("c_custkey bigint, version string, balance double, nested array<struct<x double>>, bucket int").json(path)
    return read.select("c_custkey", "version", "balance", F.col("nested")[0]["x"].alias("inner_balance"))


@_query(f"SELECT {_ID}, table_id, CASE WHEN table_id = 't1' THEN 5 ELSE records END AS n_records FROM " + _rows_sql("table_id, table_role, is_indexable, columns, records, body", _TABLES), "customer")
def table_sink(customer: DataFrame) -> DataFrame:
    """Records of tables as JSON and CSV, by table, read back."""
    path = _folder(customer, "tables")
    t = tables.normalized(raw_tables(customer)).withColumn("table_id", F.concat_ws("_", "table_id", F.pmod(F.xxhash64("doc_id"), F.lit(4)).cast("string")))
    readers.write_tables(t.withColumn("records", F.transform("records", lambda r: F.map_concat(r, F.create_map(F.lit("doc"), F.col("doc_id"))))), path)
    read = customer.sparkSession.read.schema("row int, record map<string,string>, table_id string").json(f"{path}/json")
    return read.groupBy(F.element_at("record", "doc").alias("doc_id"), F.substring_index("table_id", "_", 1).alias("table_id")).agg(F.count("*").cast("int").alias("n_records"))


@_query(
    """SELECT n_nationkey, n_name AS name, ['name', 'region'] AS keys, n_regionkey AS region, 'root' || CAST(n_nationkey % 2 AS VARCHAR) AS checks, true AS has_json, false AS has_none FROM nation""",
    "nation",
)
def document_source(nation: DataFrame) -> DataFrame:
    """Stored JSON documents with the keys that each has; root checks mirror those of the report where it has any; optional libraries."""
    path = _folder(nation, "source")
    key = F.col("n_nationkey")
    nation.select(key, F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))).alias("value")).repartition(1).write.partitionBy("n_nationkey").text(path)
    read = readers.documents(nation.sparkSession, path, "name string, region int", "*.txt")
    checks = documents.synced_checks(F.when(F.col("n") % 2 == 0, "root0"), F.lit("root1"))
    number = F.regexp_extract("path", r"n_nationkey=(\d+)", 1).cast("int")
    return read.withColumn("n", number).select(F.col("n").alias("n_nationkey"), "document.name", "keys", "document.region", checks.alias("checks"), F.lit(readers.available("json")).alias("has_json"), F.lit(readers.available("no_such_library")).alias("has_none"))


@_query("SELECT CAST(c_custkey AS VARCHAR) AS doc_id, CASE WHEN c_custkey % 10 = 0 THEN 'new' ELSE 'old' END AS version, CASE WHEN c_custkey % 10 = 0 THEN 'new' ELSE 'old' END AS page_version, CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 2 END AS pages FROM customer", "customer")
def document_store_levels(customer: DataFrame) -> DataFrame:
    """Documents and pages in one store: every tenth document written again with fewer pages, all others as they were at both levels."""
    kept = store.DocumentStore(customer.sparkSession, _folder(customer, "store"), buckets=8)

    def levels(rows: DataFrame, version: str, pages_: int) -> dict[str, DataFrame]:
        docs = rows.select(_k().cast("string").alias("doc_id"), F.lit(version).alias("version"))
        return {"documents": docs, "pages": docs.select("*", F.explode(F.sequence(F.lit(1), F.lit(pages_))).alias("page_number"))}

    kept.write(**levels(customer, "old", 2))
    kept.write(**levels(customer.where("c_custkey % 10 = 0"), "new", 1))
    shown = kept.read("pages").groupBy("doc_id").agg(F.max("version").alias("page_version"), F.count("*").cast("int").alias("pages"))
    return kept.read("documents").join(shown, "doc_id", "full")


@_query(
    f"""SELECT {_ID}, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN {_STAIN_NAMES} = '' THEN 'consistent' WHEN {_FINAL_NAMES} = '' THEN 'needs_review' WHEN {_FINAL_NAMES} = {_STAIN_NAMES} THEN 'consistent' ELSE 'discordant_findings' END AS status,
    CASE WHEN c_custkey % 5 > 0 THEN {_FINAL_NAMES} END AS final_names, c_name AS name, c_acctbal AS balance FROM customer""",
    "customer",
)
def stored_checks(customer: DataFrame) -> DataFrame:
    """Parasite checks put into stored documents in place; what else they hold stays."""
    kept = store.DocumentStore(customer.sparkSession, _folder(customer, "checked"), buckets=8)
    row = lambda section, said: F.struct(F.lit(section).alias("section"), F.lit("x").alias("parameter"), said.alias("result"))
    found = F.when(_k() % 5 > 0, F.array(row("staining_exam", _pick(_k(), *STAINED)), row("final_result", _pick(_k(), *FINAL))))
    stored = customer.select(_k().cast("string").alias("doc_id"), F.to_json(F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_acctbal").alias("balance")).alias("account"), found.alias("results"))).alias("document"))
    kept.write(documents=stored)
    documents.inject_checks(kept)
    d = kept.read("documents").select("doc_id", F.from_json("document", "name string, account struct<balance double>, consistency_checks struct<status string, detected map<string,array<string>>>").alias("d"))
    names = F.array_join(F.try_element_at("d.consistency_checks.detected", F.lit("final_result")), ",")
    return d.select("doc_id", "d.consistency_checks.status", names.alias("final_names"), "d.name", "d.account.balance")


@_query(
    f"""SELECT doc_id, path, reason, actual FROM (SELECT {_ID}, '$.results[7].result' AS path, 'different' AS reason, {_FINAL} AS actual FROM customer WHERE c_custkey % 4 > 0 UNION ALL SELECT {_ID}, '$.patient.age_status', 'different', 'inconsistent_with_birth_date' FROM customer WHERE abs(44 - c_custkey % 60) > 1
    UNION ALL SELECT {_ID}, '$.blocks[4].text', 'not_contained', 'EXAMEN MACROSCOPIQUE Couleur : ' || {_COLOUR} || ' Consistance : Molle Glaire : Présence' FROM customer WHERE c_custkey % 3 > 0 UNION ALL SELECT {_ID}, '$.patient.name', 'unexpected', c_name FROM customer
    UNION ALL SELECT {_ID}, '$.blocks[8].text', 'contained', 'RÉSULTAT FINAL : ' || {_FINAL} FROM customer WHERE c_custkey % 4 = 3)""",
    "customer",
)
def golden_facts(customer: DataFrame) -> DataFrame:
    """Facts that exported stool reports should hold, and what is said where they do not."""
    exported = documents.export(documents.extract(stool_pages(customer), share=True))
    expected = [
        ("$.document_type", "equals", "parasitology_stool_report"), ("$.results", "size", 8), ("$.results[7].result", "equals", FINAL[0]), ("$.results[0].unit", "absent", None), ("$.patient.age_status", "equals", "consistent"), ("$.patient.address", "absent", None), ("$.patient.name", "absent", None),
        ("$.report.sample_label", "equals", "SELLES N°1"), ("$.blocks", "size", 10), ("$.blocks[4].text", "contains", "Marron"), ("$.blocks[8].text", "lacks", "ABSENCE"), ("$.blocks[9].structured_fields.edited_by", "equals", "A B"), ("$.pages[0].blocks[9].structured_fields.edited_by", "equals", "A B"), ("$.consistency_checks.status", "present", None),
    ]
    return qa.unmet_facts(exported, expected).select("doc_id", "path", "reason", "actual")


@_query(
    """SELECT o_orderkey, NULL AS field, 'missing_row' AS reason, NULL AS expected, NULL AS actual FROM orders WHERE o_orderkey % 50 = 0 UNION ALL SELECT -1 - o_orderkey, NULL, 'extra_row', NULL, NULL FROM orders WHERE o_orderkey % 40 = 0
    UNION ALL SELECT o_orderkey, 'o_orderstatus', 'different_value', o_orderstatus, o_orderstatus || '?' FROM orders WHERE o_orderkey % 50 > 0 AND o_orderkey % 7 = 0 UNION ALL SELECT o_orderkey, 'o_orderpriority', 'missing_value', o_orderpriority, NULL FROM orders WHERE o_orderkey % 50 > 0 AND o_orderkey % 11 = 0""",
    "orders",
)
def table_differences(orders: DataFrame) -> DataFrame:
    """Where a table differs from what is expected, cell by cell."""
    want = orders.select("o_orderkey", "o_orderstatus", "o_orderpriority")
    status, priority = F.when(_o() % 7 == 0, F.concat("o_orderstatus", F.lit("?"))).otherwise(F.col("o_orderstatus")), F.when(_o() % 11 > 0, F.col("o_orderpriority"))
    have = want.where("o_orderkey % 50 > 0").select("o_orderkey", status.alias("o_orderstatus"), priority.alias("o_orderpriority")).unionByName(want.where("o_orderkey % 40 = 0").withColumn("o_orderkey", -1 - _o()))
    return rel.diff_tables(want, have, ["o_orderkey"])


@_query("SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, CASE WHEN o_totalprice > 490000 THEN 'FAIL' ELSE 'PASS' END AS status FROM orders", "orders")
def qa_report_sink(orders: DataFrame) -> DataFrame:
    """The quality report as JSON, read back."""
    path = _folder(orders, "report")
    fired = orders.where("o_totalprice > 490000").select(_o().cast("string").alias("doc_id"))
    readers.report(qa.evaluate(orders.select(_o().cast("string").alias("doc_id")), qa.rule(1, "FAIL", "x", fired)), path)
    return orders.sparkSession.read.schema("doc_id string, status string").json(path)
