from pyspark.sql import functions as F

from chartloom.plans import generic, ocr_tables, results

LINES = [
    "Patient Jane Doe Numero de rapport sr-2024 01",
    "0a1b2c3d-0000-1111- Date du document 12 févr. 2023",
    "Identifiant 2222-33334444S555",
    "Sexe Féminin",
    "Statut Final",
    "12 Main Street",
    "Adresse Building 4",
    "Prescripteur Dr. A",
    "Analyse / Observation Resultat Unites",
    "Glucose [Mass/volume] in",
    "Blood 95 mg/dL 70 - 99 12 févr. 2023",
    "Hemoglobin [Mass/volume] in Blood by 14.1 g/dL 12 - 17.5 12 févr. 2023",
    "Automated count",
    "Potassium [Moles/volume] in Serum or 45 mmol/L 3.5 - 5.1 H 13 mars 2023",
    "Plasma",
    "Body Height 180 cm Selon contexte 14 mars 2023",
    "Validation médicale",
    "Other 1 2 3 - 4 1 mars 2020",
]


def test_rows_over_several_lines(spark):
    pages = spark.createDataFrame([("d", 1, LINES)], "doc_id string, page_number int, lines array<string>")
    rows = [(r.analyte, r.value, r.unit, r.reference, r.flag, r.date, r.corrected) for r in ocr_tables.result_rows(pages).orderBy("row").collect()]
    assert rows == [
        ("Glucose [Mass/volume] in Blood", "95", "mg/dL", "70 - 99", "-", "12 févr. 2023", False),
        ("Hemoglobin [Mass/volume] in Blood by Automated count", "14.1", "g/dL", "12 - 17.5", "-", "12 févr. 2023", False),
        ("Potassium [Moles/volume] in Serum or Plasma", "4.5", "mmol/L", "3.5 - 5.1", "H", "13 mars 2023", True),
        ("Body Height", "180", "cm", "Selon contexte", "-", "14 mars 2023", False),
    ]
    found = ocr_tables.as_tables(ocr_tables.result_rows(pages))
    kept, _ = results.canonical(results.from_tables(found))
    by = {r.analyte: (r.value_numeric, r.ocr_correction_applied, r.raw_ocr_value) for r in kept.collect()}
    assert by["Potassium [Moles/volume] in Serum or Plasma"] == (4.5, True, "45") and len(by) == 4
    assert ocr_tables.distinct_tables(found.unionByName(found.withColumn("table_no", F.lit(9)))).count() == 1


def test_header_fields(spark):
    pages = spark.createDataFrame([("d", 1, LINES)], "doc_id string, page_number int, lines array<string>")
    r = ocr_tables.header_fields(pages).first()
    assert (r.patient, r.report_id, r.report_date, r.sex, r.status, r.prescriber) == ("Jane Doe", "SR-202401", "12 févr. 2023", "Féminin", "Final", "Dr. A")
    assert r.patient_id.startswith("0a1b2c3d-0000-1111-2222-") and r.address == "12 Main Street Building 4"


def test_generic_report(spark):
    docs = spark.createDataFrame([("t",), ("b",), ("n",)], "doc_id string")
    tables = spark.createDataFrame([("t", 1, "patient_info_table", {"Patient": "Jane", "Sexe": "Féminin", "Age": "40 ans", "Identifiant": "x"}, False)], "doc_id string, table_no int, table_role string, fields map<string,string>, has_box boolean")
    blocks = spark.createDataFrame([("b", 1, 1, "patient_info_block", "Patient: John Sexe: M", None), ("b", 1, 2, "other", "1 Road - Tel. 05 06", None)], "doc_id string, page_number int, pos int, block_type string, text string, score double")
    pages = spark.createDataFrame([("b", 1, "Date de naissance 01/02/1980")], "doc_id string, page_number int, native_text string")
    found = {r.doc_id: r for r in generic.patient(docs, tables, blocks, pages).collect()}
    assert (found["t"].name.canonical, found["t"].sex.canonical, found["t"].reported_age, found["t"].patient_id.normalization_status) == ("Jane", "F", 40, "needs_review")
    assert (found["b"].name.canonical, found["b"].sex.canonical, found["b"].birth_date.canonical) == ("John", "M", "1980-02-01")
    assert found["n"].name.normalization_status == "missing" and found["n"].confidence.label == "low" and found["t"].confidence.label == "high"
    place = generic.facility(blocks).first()
    assert (place.address, place.phone) == ("1 Road", "05 06")
    reports = generic.report(docs, tables, blocks, pages)
    assert reports.count() == 3
    names = spark.createDataFrame([("Glucose [Mass/volume] in Blood",)], "n string")
    assert names.select(generic.analyte_fingerprint(F.col("n")).alias("f"), generic.points_band(F.lit(7.0)).alias("b")).first()[:] == ("glucose_mass_volume", "medium")
