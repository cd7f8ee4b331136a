import json

import pytest
from pyspark.sql import functions as F

from chartloom.operators import relational as rel
from chartloom.plans import catalogue, documents, pages, qa, reports, results, segments, tables, visuals
from chartloom.sources import readers


@pytest.fixture(scope="module")
def extracted(spark):
    return documents.extract(catalogue.fixture(spark))


def test_stool_report(extracted):
    head = {r.doc_id: r for r in extracted["header"].collect()}["stool"]
    assert (head.patient, head.patient_id, head.patient_field.normalization_status) == ("JANE DOE", "53", "needs_review")
    assert (head.birth_iso, head.reported_age, head.computed_age, head.age_status) == ("1980-02-01", 40, 44, "inconsistent_with_birth_date")
    assert (head.request_iso, head.received_iso, head.edited_iso) == ("2024-06-03T10:15:00", "2024-06-03T11:00:00", "2024-06-04T12:04:25")
    assert (head.encounter_type, head.sample_label, head.sample_id, head.validation_actor_status, head.edited_by) == ("External", "SELLES N°1", "123456789", "edition_only", "A B")
    assert {r.doc_id: r.document_type for r in extracted["documents"].collect()} == {"stool": "parasitology_stool_report", "hospital": "biology_report", "note": "imaging_report"}
    rows = extracted["stool_results"].orderBy("row_index").collect()
    assert [r.row_index for r in rows] == list(range(1, 9))
    assert [r.section for r in rows] == ["macroscopic_exam"] * 3 + ["microscopic_exam"] * 2 + ["enrichment_exam", "staining_exam", "final_result"]
    assert [r.result_kind for r in rows] == ["qualitative"] * 3 + ["microscopy_finding"] * 2 + ["qualitative", "microscopy_finding", "pathogen_identification"]
    assert (rows[0].analyte, rows[0].value_raw, rows[0].source_line_start, rows[0].source_line_end) == ("Couleur", "Marron", 18, 19)
    assert [(r.source_line_start, r.source_line_end) for r in rows if r.section in ("enrichment_exam", "final_result")] == [(29, 30), (33, 34)]
    assert {r.observation_date for r in rows} == {"2024-06-03"}
    stats = extracted["stool_stats"].first()
    assert (stats.raw_result_rows, stats.canonical_result_rows, stats.duplicate_rows_removed, stats.false_positive_result_rows, stats.section_count) == (8, 8, 0, 0, 5)
    check = extracted["consistency"].first()
    assert check.status == "discordant_findings" and check.detected["final_result"] == ["trichuris trichiura"] and check.detected["staining_exam"] == ["ankylostoma duodenale"]


def test_export_drops_missing_keys(extracted):
    document = json.loads(documents.export(extracted).first().document)
    assert document["patient"]["patient_id"] == "53" and len(document["results"]) == 8 and document["results"][7]["result"] == "TRICHURIS TRICHIURA"
    assert "validated_by" not in document["report"] and document["consistency_checks"]["status"] == "discordant_findings"


def test_hospital_text(extracted):
    rows = extracted["hospital_results"].orderBy("ordinal").collect()
    assert [(r.analyte, r.value_numeric, r.unit, r.reference_range.low, r.reference_range.high) for r in rows] == [("Glycémie à jeun", 5.4, "mmol/L", 4.1, 6.1), ("Créatinine", 9.8, "mg/l", 7.0, 13.0), ("Cholestérol total", 1.8, "g/L", None, None)]  # "< 2,0 g/L" reads as a value, and the last value counts
    assert {r.observation_date for r in rows} == {"2024-06-05"}
    assert extracted["facility"].where("doc_id = 'hospital'").first().department == "Laboratoire Central"


def test_stool_blocks(spark):
    blocks = {r.block_type: r for r in catalogue.stool_blocks(spark, "").collect()}
    assert set(blocks) == {"facility_block", "patient_info_block", "report_metadata_block", "sample_block", "macroscopic_exam_block", "microscopic_exam_block", "enrichment_exam_block", "staining_exam_block", "final_result_block", "edition_block"}
    assert blocks["final_result_block"].text == "RÉSULTAT FINAL : TRICHURIS TRICHIURA" and blocks["final_result_block"].confidence_score == 0.9
    assert "Jane".upper() in blocks["patient_info_block"].text and not blocks["patient_info_block"].is_indexable


HEADER = ["Analyse / Observation", "Résultat", "Unités", "Valeurs de référence", "Alerte", "Date"]


def results_table(rows):
    return [HEADER] + rows


def test_tables_to_canonical_results(spark):
    one = results_table([["Body Weight", "82", "kg", "50 - 100", "", "01/02/2024"], ["Body Weight", "82", "kg", "50 - 100", "", "01/02/2024"], ["Serum Potassium", "45", "mmol/L", "3.5 - 5.1", "", "01/02/2024"], ["Glucose", "5", "mg/dl", "1 - 9", "", "01/02/2024"], ["", "", "", "", "", ""]])
    two = results_table([["Body weight", "82", "kg", "50 - 100", "", "01/02/2024"]])
    fields = [["Identifiant", "53"], ["Sexe", "Féminin"], ["Adresse", "x"]]
    rows = [("d", 1, "t1", 2, one, True), ("d", 2, "t2", 3, two, False), ("d", 3, "t3", 1, fields, False), ("d", 4, "t4", 1, fields, False)]
    frame = spark.createDataFrame(rows, "doc_id string, table_no int, table_id string, page_number int, cells array<array<string>>, from_ocr boolean")
    typed = tables.normalized(frame)
    assert {r.table_id: r.table_role for r in typed.collect()} == {"t1": "results_table", "t2": "results_table", "t3": "patient_info_table", "t4": "patient_info_table"}
    assert sorted(r.table_id for r in tables.deduplicated(typed).collect()) == ["t1", "t2", "t3"]
    assert tables.key_values(typed.where("table_id = 't3'")).first().fields == {"Adresse": "x", "Identifiant": "53", "Sexe": "F"}
    raw = results.from_tables(typed)
    assert raw.count() == 4  # the repeated row went with the table's cleaning
    kept, stats = results.canonical(raw)
    by = {r.analyte: r for r in kept.collect()}
    assert set(by) == {"Body weight", "Serum Potassium"}  # one-word analytes are not reliable
    assert by["Serum Potassium"].value_raw == "4.5" and by["Serum Potassium"].ocr_correction_applied and by["Serum Potassium"].confidence_score == 0.88
    weight = by["Body weight"]
    assert weight.source_kind == "results_table" and [s.source_table_id for s in weight.duplicate_sources] == ["t1"] and weight.confidence == "high"
    assert stats.first().asDict() == {"doc_id": "d", "raw_result_rows": 4, "canonical_result_rows": 2, "duplicate_rows_removed": 2}
    report = results.validation_report(kept, raw).first()
    assert (report.results, report.matched, report.missing_from_raw) == (2, 2, 0)


def test_lines_to_results(spark):
    frame = spark.createDataFrame([("d", 1, 1, ["Body Weight 82 kg 50 - 100 N 12 févr. 2023", "no result", "Serum Sodium 140 mmol/L 135 - 145 "])], "doc_id string, block_no int, page_number int, lines array<string>")
    found = results.from_lines(frame).orderBy("row_index").collect()
    assert [(r.analyte, r.value_numeric, r.unit, r.reference_range.high, r.observation_date) for r in found] == [("Body Weight", 82.0, "kg", 100.0, "2023-02-12"), ("Serum Sodium", 140.0, "mmol/L", 145.0, None)]


def good_document():
    document = dict(doc_id="ok", keys=["blocks", "images", "pages", "patient", "report", "results", "tables", "validation_report"], document_type="biology_report", patient_id="53", sample_id="1", report_date="2024-01-01", raw_rows=1, canonical_rows=1, removed_rows=0, consistency_issues=0, missing_from_raw=0, checks="{}", root_checks="{}", status=None, detected=None)
    result = dict(doc_id="ok", row=1, result_kind="numeric", analyte="a b", value_raw="1", value_numeric=1.0, unit="kg", section=None, page_number=1, observation_date="2024-01-01", low=0.0, high=2.0, dedup_key="k", score=0.9)
    block = dict(doc_id="ok", pos=1, text="some text", is_indexable=True, score=0.8)
    page = dict(doc_id="ok", page_number=1, final_text="text")
    return document, [result], [block], [page]


SETS = {"staining_exam": ["x"], "enrichment_exam": [], "microscopic_exam": [], "final_result": ["x"]}
STOOL = dict(document_type="parasitology_stool_report", status="consistent", detected=SETS)
MUTATIONS = {
    "missing_top_level_sections": lambda d, r, b, p: d.update(keys=["blocks"]),
    "missing_patient_id": lambda d, r, b, p: d.update(patient_id=None),
    "invalid_patient_id": lambda d, r, b, p: d.update(patient_id="a b"),
    "missing_sample_id": lambda d, r, b, p: (d.update(STOOL, sample_id=""), r[0].update(section="s")),
    "missing_report_date": lambda d, r, b, p: d.update(report_date=""),
    "invalid_report_date": lambda d, r, b, p: d.update(report_date="1/2/24"),
    "missing_result_fields": lambda d, r, b, p: r[0].update(unit=None),
    "invalid_observation_date": lambda d, r, b, p: r[0].update(observation_date="soon"),
    "invalid_reference_range": lambda d, r, b, p: r[0].update(low=5.0),
    "duplicate_dedup_keys": lambda d, r, b, p: r.append(dict(r[0], row=2)),
    "invalid_dedup_counts": lambda d, r, b, p: d.update(removed_rows=3),
    "missing_dedup_counts": lambda d, r, b, p: d.update(raw_rows=None),
    "validation_report_consistency_issues": lambda d, r, b, p: d.update(consistency_issues=1),
    "missing_from_raw_tables": lambda d, r, b, p: d.update(missing_from_raw=1),
    "uniform_confidence_scores": lambda d, r, b, p: b.extend(dict(b[0], pos=i, text=f"t{i}", score=0.8) for i in range(2, 7)),
    "page_boilerplate_present": lambda d, r, b, p: p[0].update(final_text="Document synthétique"),
    "repeated_indexable_blocks": lambda d, r, b, p: b.append(dict(b[0], pos=2, text="Some  TEXT!", score=0.7)),
    "missing_results": lambda d, r, b, p: r.clear(),
    "missing_blocks": lambda d, r, b, p: b.clear(),
    "missing_validation_report_consistency_checks": lambda d, r, b, p: (d.update(STOOL, checks=None), r[0].update(section="s")),
    "missing_consistency_checks": lambda d, r, b, p: (d.update(STOOL, root_checks=None), r[0].update(section="s")),
    "consistency_checks_mismatch": lambda d, r, b, p: (d.update(STOOL, root_checks="{1}"), r[0].update(section="s")),
    "missing_parasite_consistency": lambda d, r, b, p: (d.update(STOOL, status=None), r[0].update(section="s")),
    "legacy_parasite_consistency_status": lambda d, r, b, p: (d.update(STOOL, status="inconsistent"), r[0].update(section="s")),
    "invalid_parasite_consistency_status": lambda d, r, b, p: (d.update(STOOL, status="fine"), r[0].update(section="s")),
    "missing_detected_sections": lambda d, r, b, p: (d.update(STOOL, detected={}), r[0].update(section="s")),
    "missing_detected_section_keys": lambda d, r, b, p: (d.update(STOOL, detected={"final_result": ["x"]}), r[0].update(section="s")),
    "invalid_detected_section_values": lambda d, r, b, p: (d.update(STOOL, detected=dict(SETS, enrichment_exam=None)), r[0].update(section="s")),
    "duplicate_detected_entities": lambda d, r, b, p: (d.update(STOOL, detected=dict(SETS, final_result=["x", "X "][:1] + ["x"])), r[0].update(section="s")),
    "discordance_has_overlap": lambda d, r, b, p: (d.update(STOOL, status="discordant_findings"), r[0].update(section="s")),
    "false_consistent_parasite_status": lambda d, r, b, p: (d.update(STOOL, detected=dict(SETS, final_result=["y"])), r[0].update(section="s")),
}


def test_every_rule_fires_alone(spark):
    docs, res, blk, pgs = [], [], [], []
    for name, change in {"ok": lambda *a: None, "stool": lambda d, r, b, p: (d.update(STOOL), r[0].update(section="s")), **MUTATIONS}.items():
        d, r, b, p = good_document()
        change(d, r, b, p)
        d["doc_id"] = name
        for x in (*r, *b, *p):
            x["doc_id"] = name
        docs.append(d), res.extend(r), blk.extend(b), pgs.extend(p)
    d = spark.createDataFrame(docs, "doc_id string, keys array<string>, document_type string, patient_id string, sample_id string, report_date string, raw_rows int, canonical_rows int, removed_rows int, consistency_issues int, missing_from_raw int, checks string, root_checks string, status string, detected map<string,array<string>>")
    r = spark.createDataFrame(res, "doc_id string, row int, result_kind string, analyte string, value_raw string, value_numeric double, unit string, section string, page_number int, observation_date string, low double, high double, dedup_key string, score double")
    b = spark.createDataFrame(blk, "doc_id string, pos int, text string, is_indexable boolean, score double")
    p = spark.createDataFrame(pgs, "doc_id string, page_number int, final_text string")
    found = qa.document_issues(d, r, b, p).unionByName(qa.failed_documents(spark.createDataFrame([("broken", "boom")], "doc_id string, error string")))
    codes = {}
    for x in found.collect():
        codes.setdefault(x.doc_id, set()).add(x.code)
    assert codes.pop("broken") == {"extraction_exception"}
    assert codes == {name: {name} for name in MUTATIONS}
    judged = qa.evaluate(d, found).collect()
    assert {x.doc_id: x.status for x in judged if x.doc_id in ("ok", "missing_results", "missing_from_raw_tables")} == {"ok": "PASS", "missing_results": "FAIL", "missing_from_raw_tables": "WARNING"}
    assert {x.score for x in judged} == {100, 90, 80}
    assert sum(qa.summarize(qa.evaluate(d, found)).first()[1:]) == len(docs)


def test_report_rows(spark):
    names = ["Glucose", "HDL Cholesterol", "Body Weight", "Heart rate", "Sodium level", "Calcium level", "Smoking status"]
    rows = [("p", i, n, v, "u", f"2024-01-{i + 1:02d}", "") for i, (n, v) in enumerate(zip(names, ["120", "45", "80.0", "55.25", "140", "abc", "never"]))]
    rows += [("p", 20, "Glucose", "95", "", "2024-03-01", ""), ("q", 30, "Smoking status", "never", "", "bad", "")] + [("q", 40 + i, "Pain", str(i), "s", f"2024-02-{i + 1:02d}", "") for i in range(10)]
    obs = spark.createDataFrame(rows, "patient string, row int, description string, value string, units string, date string, type string")
    found = {}
    for r in reports.report_rows(obs).orderBy("patient", "position").collect():
        found.setdefault(r.patient, []).append((r.description, r.result, r.units, r.reference, r.flag))
    assert found["p"][0] == ("Glucose", "95", "-", "70 - 99", "") and ("HDL Cholesterol", "45", "u", "0 - 200", "") in found["p"] and ("Heart rate", "55.2", "u", "60 - 100", "L") in found["p"]
    assert "Smoking status" not in [r[0] for r in found["p"]] and [r[0] for r in found["q"]] == ["Pain", "Smoking status"]
    series = [r.number for r in reports.trend(obs).orderBy("position").collect() if r.patient == "q"]
    assert series == [float(i) for i in range(2, 10)]
    patients = spark.createDataFrame([("p", "A"), ("q", "B"), ("z", "C")], "patient string, name string")
    assert [r.patient for r in reports.choose_patients(patients, obs, 1).collect()] == ["q"]
    enc = spark.createDataFrame([("p", 1, "2020-01-01", "o1", "v1"), ("p", 2, "2021-01-01", "o2", "v9"), ("q", 3, "x", "", "")], "patient string, row int, start string, organization string, provider string")
    org = spark.createDataFrame([("o2", "Clinic", "1 St", "", "MA", "")], "id string, name string, address string, city string, state string, phone string")
    pro = spark.createDataFrame([("v1", "Dr", "GP")], "id string, name string, speciality string")
    context = {r.patient: r for r in reports.patient_context(patients, enc, org, pro, {"facility_name": "Somewhere", "provider_name": "Someone"}).collect()}
    assert (context["p"].facility_name, context["p"].facility_address, context["p"].facility_phone, context["p"].provider_name) == ("Clinic", "1 St, MA", "-", "Someone") and context["z"].facility_name == "Somewhere"
    cond = reports.conditions_of(spark.createDataFrame([("p", 1, "Old", "2000-01-01"), ("p", 2, "New", "2020-01-01"), ("p", 3, "Old", "2001-01-01")], "patient string, row int, description string, start string"))
    assert cond.first().names == ["New", "Old"]
    said = {r.patient: r.impression for r in reports.impression(reports.report_rows(obs), cond).collect()}
    assert "Heart rate is reduced" in said["p"] and said["p"].endswith("New, Old.")


def test_pages_ocr_and_classes(spark):
    lines = {r.line_num: r for r in catalogue.ocr_row_assembly(spark, "").collect()}
    assert lines[1].text == "hello world" and tuple(lines[1].bbox) == (10.0, 10.0, 90.0, 22.0) and lines[2].text == "again" and lines[1].max_font_size == 12.0
    signals = spark.createDataFrame([("a", 1, 0, 1), ("b", 1, 90, 0), ("c", 1, 90, 0), ("c", 2, 3, 1)], "doc_id string, page_number int, native_text_chars int, image_count int")
    assert {r.doc_id: r.pdf_type for r in pages.classes(signals).collect()} == {"a": "scanned", "b": "digital", "c": "mixed"}
    native = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y" * 50), ("a", 3, ""), ("a", 4, "z" * 40)], "doc_id string, page_number int, native_text string")
    ocr = spark.createDataFrame([("a", 1, "recognised text"), ("a", 2, "other")], "doc_id string, page_number int, ocr_text string")
    assert [(r.text_source, r.final_text[:3]) for r in pages.merge_ocr(native, ocr).orderBy("page_number").collect()] == [("ocr", "rec"), ("hybrid", "yyy"), ("none", ""), ("native", "zzz")]
    spans = spark.createDataFrame([("d", 1, 1, 1, 1, "second ", 9.0, "Arial", 0.0, 50.0, 10.0, 60.0), ("d", 1, 2, 1, 1, " Big", 14.0, "Arial-Bold", 0.0, 10.0, 10.0, 20.0), ("d", 1, 2, 1, 2, "title", 12.0, "Arial", 10.0, 10.0, 30.0, 21.0), ("d", 1, 2, 2, 1, "sub", 8.0, "Arial", 0.0, 22.0, 30.0, 28.0)], "doc_id string, page_number int, block_no int, line_no int, span_no int, text string, size double, font string, x0 double, y0 double, x1 double, y1 double")
    assert [(b.text_block_id, b.text, b.is_bold, b.max_font_size) for b in pages.text_blocks(spans).collect()] == [("text_p001_02", "Big title\nsub", True, 14.0), ("text_p001_01", "second", False, 9.0)]


BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def test_visuals(spark):
    images = spark.createDataFrame([("d", 1, "i1", 7, 600.0, 800.0, (300.0, 600.0, 400.0, 700.0)), ("d", 1, "i1", 7, 600.0, 800.0, (300.0, 600.0, 400.0, 700.0)), ("d", 1, "i2", 8, 600.0, 800.0, (0.0, 0.0, 600.0, 800.0))], f"doc_id string, page_number int, image_id string, xref int, width double, height double, bbox {BOX}")
    blocks = spark.createDataFrame([("d", 1, 1, "Cachet du service", (300.0, 580.0, 400.0, 595.0), "ocr"), ("d", 1, 2, "far away", (0.0, 0.0, 50.0, 10.0), "ocr"), ("d", 1, 3, "Validation médicale", (50.0, 500.0, 200.0, 510.0), "ocr")], f"doc_id string, page_number int, pos int, text string, bbox {BOX}, source string")
    near = visuals.context(visuals.without_rasters(images), blocks)
    kinds = near.select("image_id", "context_text", visuals.classify(F.col("page_number"), F.col("width"), F.col("height"), F.col("bbox"), F.col("context_text")).alias("k")).collect()
    assert [(r.image_id, r.context_text, r.k.type) for r in kinds] == [("i1", "Cachet du service", "stamp_or_seal")]
    page = spark.createDataFrame([("d", 1, 600.0, 800.0, "ocr")], "doc_id string, page_number int, width double, height double, text_source string")
    crops = visuals.scan_crops(page, blocks).collect()
    assert [(c.visual_id, c.label) for c in crops] == [("visual_p001_01", "signature"), ("visual_p001_02", "stamp")] and crops[0].bbox.y0 == 526.0


def test_generic_blocks(spark):
    rows = [(1, "Title of report", 10.0), (2, "12 Street - Tel. 05", 30.0), (3, "Synthèse clinique", 300.0), (4, "All is well.", 320.0), (5, "Validation médicale", 500.0), (6, "Dr. A", 520.0), (7, "Biology", 540.0), (8, "Document synthétique x", 800.0)]
    blocks = spark.createDataFrame([("d", 1, p, t, (10.0, y, 200.0, y + 10), "native") for p, t, y in rows], f"doc_id string, page_number int, pos int, text string, bbox {BOX}, source string")
    tabs = spark.createDataFrame([("d", 1, 1, "results_table", "a: 1 | b: 2")], "doc_id string, page_number int, table_no int, table_role string, body string")
    imgs = spark.createDataFrame([("d", 1, "i", "analytics", "signature", "a chart of values")], "doc_id string, page_number int, image_id string, role string, type string, context_text string")
    found = {r.block_type: r for r in segments.finished(segments.generic_blocks(blocks, tabs, imgs)).collect()}
    assert list(found) and set(found) == {"document_header", "facility_block", "results_table_block", "summary_block", "image_context_block", "validation_block", "footer_block"}
    assert found["summary_block"].text == "Synthèse clinique All is well." and found["footer_block"].confidence_score == 0.2 and found["results_table_block"].confidence == "high"
    assert sorted(r.block_id for r in found.values()) == [f"block_{i:03d}" for i in range(1, 8)]
    signed = segments.validation_fields(blocks, imgs).first()
    assert (signed.validated_by, signed.specialty, signed.has_signature, signed.has_stamp) == ("Dr. A", "Biology", True, False)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text(" Id ,NAME\n1,\n2,x\n")
    df = readers.csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["Id", "NAME"] and [tuple(r) for r in df.collect()] == [("1", ""), ("2", "x")] and readers.column_named(df, ["ID", "x"]) == "Id"
    assert readers.optional_csv(spark, str(tmp_path / "none.csv"), ["A"]).count() == 0
    with pytest.raises(KeyError):
        readers.column_named(df, ["zzz"])
    (tmp_path / "docs/one").mkdir(parents=True)
    (tmp_path / "docs/one/document.json").write_text('{"patient": null, "results": []}')
    assert readers.documents(spark, str(tmp_path / "docs")).first()["keys"] == ["patient", "results"]
    (tmp_path / "x.pdf").write_bytes(b"good")
    (tmp_path / "y.pdf").write_bytes(b"bad")

    def parse(content):
        if content == b"bad":
            raise ValueError("broken")
        yield {"page_number": 1, "width": 1.0, "height": 2.0, "native_text": "t", "image_count": 0}

    assert sorted((r.doc_id, r.page_number, r.native_text) for r in readers.pdf_pages(spark, str(tmp_path / "*.pdf"), parse).collect()) == [("x", 1, "t"), ("y", 0, "ValueError: broken")]
    odd = spark.createDataFrame([("d", float("nan")), ("d", 1.0)], "doc_id string, v double")
    readers.write_documents(odd, str(tmp_path / "out"))
    assert sorted(r.v or 0 for r in spark.read.json(str(tmp_path / "out")).collect()) == [0, 1.0]


def test_stream(spark, tmp_path):
    from chartloom.streaming import pages as stream

    catalogue.fixture(spark).withColumn("at", F.lit("2024-01-01T00:00:00").cast("timestamp")).write.json(str(tmp_path / "in"))
    query = stream.extract_stream(stream.read_pages(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    found = {r.doc_id: r.document for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert sorted(found) == ["hospital", "note", "stool"]
    assert '"document_type":"parasitology_stool_report"' in found["stool"] and '"parameter"' in found["stool"] and '"consistency_checks"' in found["stool"]
    assert '"document_type":"biology_report"' in found["hospital"] and '"analyte"' in found["hospital"] and '"parameter"' not in found["hospital"]
    assert '"document_type":"imaging_report"' in found["note"] and '"results"' not in found["note"]


def test_look_up_of_a_repeated_key(spark):
    """A repeated key gives one whole row: the first by order, or the smallest."""
    facts = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    side = spark.createDataFrame([(1, 2, "b", "y"), (1, 1, "c", "x"), (2, 1, None, "z")], "id int, n int, name string, place string").repartition(3)
    look = lambda order: sorted(tuple(r) for r in rel.look_up(facts, side, [("k", "id")], {"name": "?", "place": "-"}, order).collect())
    assert look(["n"]) == [(1, "c", "x"), (2, "?", "z"), (3, "?", "-")]
    assert look(None) == [(1, "b", "y"), (2, "?", "z"), (3, "?", "-")]
