"""The two-level store with its one commit, checks put into stored documents, and the comparison operators."""

import json

import pytest
from pyspark.sql import functions as F

from chartloom.operators import relational as rel
from chartloom.plans import catalogue, documents, qa
from chartloom.sources.store import DocumentStore


def rows(spark, data, schema="doc_id string, document string"):
    return spark.createDataFrame(data, schema)


def levels(store):
    return {n: sorted(tuple(r) for r in store.read(n).collect()) for n in ("documents", "pages")}


def test_one_document_is_rewritten_at_both_levels(spark, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "store"), buckets=4)
    pages = "doc_id string, page_number int, text string"
    store.write(documents=rows(spark, [(f"d{i}", "old") for i in range(20)]), pages=rows(spark, [(f"d{i}", p, "old") for i in range(20) for p in (1, 2)], pages))
    store.write(documents=rows(spark, [("d3", "new"), ("x", "new")]), pages=rows(spark, [("d3", 1, "new")], pages))
    found = levels(store)
    assert found["documents"] == sorted([(f"d{i}", "new" if i == 3 else "old") for i in range(20)] + [("x", "new")])
    assert found["pages"] == sorted([(f"d{i}", p, "old") for i in range(20) for p in (1, 2) if i != 3] + [("d3", 1, "new")])
    assert all(len(x["folders"]) <= 4 for x in store.manifest()["levels"].values())
    store.vacuum()
    assert levels(store) == found
    with pytest.raises(ValueError):
        store.write(documents=rows(spark, [("d4", "new")]))


def test_a_failed_run_leaves_the_store(spark, tmp_path, monkeypatch):
    store = DocumentStore(spark, str(tmp_path / "store"), buckets=3)
    report = json.dumps({"b": 1, "results": [{"section": "staining_exam", "parameter": "x", "result": "oeufs d'ankylostoma"}, {"section": "final_result", "parameter": "RF", "result": "TRICHURIS TRICHIURA"}], "a": {"z": [1.5, None]}})
    store.write(documents=rows(spark, [("s", report), ("n", '{"results": []}'), ("o", None)]))
    before = sorted(tuple(r) for r in store.read("documents").fillna("-").collect())

    def broken(manifest):
        raise OSError("disk full")

    with monkeypatch.context() as patch:
        patch.setattr(store, "_commit", broken)
        with pytest.raises(OSError):
            documents.inject_checks(store)
    with pytest.raises(Exception, match="division|DIVIDE"):
        store.update("documents", lambda df: df.withColumn("document", F.raise_error(F.lit("division"))))
    assert sorted(tuple(r) for r in store.read("documents").fillna("-").collect()) == before
    documents.inject_checks(store)
    documents.inject_checks(store)
    found = {r.doc_id: r.document for r in store.read("documents").collect()}
    checked = json.loads(found["s"])
    assert checked.pop("consistency_checks")["status"] == "discordant_findings" and checked == json.loads(report)
    assert found["n"] == '{"results": []}' and found["o"] is None


def test_two_runs_from_one_manifest(spark, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "store"), buckets=2)
    store.write(documents=rows(spark, [("a", "1")]))
    stale = store.manifest()
    store.write(documents=rows(spark, [("a", "2")]))
    with pytest.raises(Exception, match="exist"):
        store._commit(stale | {"number": stale["number"] + 1})
    assert store.read("documents").first().document == "2"


def test_differences_cell_by_cell(spark):
    schema = "k int, n int, s string, l array<int>"
    want = rows(spark, [(1, 1, "a", [1]), (2, None, "b", [2]), (3, 3, "c", None), (None, 4, "d", None)], schema)
    have = rows(spark, [(1, 1, "a", [1]), (2, 5, None, [2, 3]), (None, 4, "d", None), (9, 9, "z", None)], schema)
    found = {(r.k, r.field): r.reason for r in rel.diff_tables(want, have, ["k"]).collect()}
    assert found == {(2, "n"): "extra_value", (2, "s"): "missing_value", (2, "l"): "different_value", (3, None): "missing_row", (9, None): "extra_row"}
    assert {(r.field, r.reason) for r in rel.diff_tables(want, have.drop("s").where("k = 1"), ["k"]).where("k = 1").collect()} == {("s", "missing_column")}
    assert rel.diff_tables(want, want, ["k"]).count() == 0


GOLDEN = [
    ("$.document_type", "equals", "parasitology_stool_report"), ("$.patient.name", "equals", "JANE DOE"), ("$.patient.patient_id", "equals", "53"), ("$.patient.address", "absent", None), ("$.patient.age_status", "equals", "inconsistent_with_birth_date"), ("$.report.report_id", "absent", None),
    ("$.report.exam_name", "equals", "EXAMEN PARASITOLOGIQUE DES SELLES"), ("$.report.sample_id", "equals", "123456789"), ("$.report.sample_label", "equals", "SELLES N°1"), ("$.facility.organization", "contains", "Centre Hospitalo-Universitaire Mohammed VI - Oujda"), ("$.facility.address", "absent", None),
    ("$.results", "size", 8), ("$.results[0].parameter", "present", None), ("$.results[0].unit", "absent", None), ("$.results[0].value_numeric", "absent", None), ("$.results[7].parameter", "equals", "RÉSULTAT FINAL"), ("$.results[7].result", "equals", "TRICHURIS TRICHIURA"), ("$.results[7].result_kind", "equals", "pathogen_identification"),
    ("$.blocks", "size", 10), ("$.blocks[1].text", "lacks", "Centre Hospitalo-Universitaire"), ("$.blocks[1].structured_fields.patient_id", "equals", "53"), ("$.blocks[2].structured_fields.exam_name", "equals", "EXAMEN PARASITOLOGIQUE DES SELLES"), ("$.blocks[7].text", "lacks", "RÉSULTAT FINAL"),
    ("$.blocks[8].text", "equals", "RÉSULTAT FINAL : TRICHURIS TRICHIURA"), ("$.blocks[8].text", "lacks", "Edité(e) par"), ("$.blocks[9].text", "contains", "A B"), ("$.blocks[9].structured_fields.edited_date", "equals", "2024-06-04T12:04:25"), ("$.pages[0].blocks", "size", 10), ("$.consistency_checks.status", "equals", "discordant_findings"),
]


def test_golden_facts_of_the_stool_report(spark):
    exported = documents.export(documents.extract(catalogue.fixture(spark), share=True)).where("doc_id = 'stool'")
    assert qa.unmet_facts(exported, GOLDEN).collect() == []
    wrong = [("$.patient.name", "equals", "X"), ("$.patient.name", "absent", None), ("$.patient.none", "present", None), ("$.patient.none", "equals", "X"), ("$.patient.name", "contains", "JOHN"), ("$.patient.name", "lacks", "JANE"), ("$.results", "size", 7), ("$.patient.name", "size", 1)]
    assert [r.reason for r in qa.unmet_facts(exported, wrong).collect()] == ["different", "unexpected", "absent", "absent", "not_contained", "contained", "wrong_size", "absent"]
    broken = rows(spark, [("b", "{"), ("n", None)])
    assert {(r.doc_id, r.reason) for r in qa.unmet_facts(broken, wrong[:1]).collect()} == {("b", "invalid_document"), ("n", "invalid_document")}
    with pytest.raises(ValueError):
        qa.unmet_facts(broken, [("$", "likes", None)])
