"""The hospital walk against a plain loop over the lines, and the operators around titles."""

import random

from pyspark.sql import functions as F

from chartloom.operators import relational as rel
from chartloom.plans import hospital, segments, stool

LINES = [
    "PARAMETRES", "EXAMEN DIRECT", "Cholestérol total", "Glycémie à jeun", "Cellules", "Urée", "4,5 mmol/L", "12", "< 3", "( 4 - 6 )", "Adulte", "mmol/L", "Page 1 sur 2", "Tel : 05", "Sexe : F", "Professeur X", "Automate : Y", "Négatif", "Absence", "Commentaire : revoir",
    "Commentaire", ": trace", "Résultat final : rien", "Resulat final", "---", "Resultats",
]


def loop(pages):
    numeric = [r for n, lines in pages for r in numbers(n, lines)]
    return numeric or [r for n, lines in pages for r in said(n, lines)]


def numbers(number, lines):
    out, name, reference, value, active = [], [], [], None, False

    def close():
        nonlocal name, reference, value
        if name and value is not None:
            out.append((number, " ".join(name), value, " ".join(reference), False))
        name, reference, value = [], [], None

    for x in lines:
        if x.opens:
            active = True
            continue
        active = active or (number != 1 and any(w in x.label for w in hospital.OPENERS))
        if not active:
            continue
        if x.is_footer:
            close()
            active = False
        elif x.is_admin or x.is_device:
            continue
        elif x.is_value and name:
            value = x.number
        elif x.is_reference and name:
            reference.append(x.line)
        elif x.is_analyte:
            if name and (reference or value is not None):
                close()
            name.append(x.line)
    close()
    return out


def said(number, lines):
    out = []
    add = lambda name, value: out.append((number, name, value, "Qualitatif", True))
    behind = lambda line: line.split(":", 1)[1].strip() if ":" in line else ""
    for x, after in zip(lines, lines[1:]):
        if after.line.startswith(":") and not x.is_admin and x.label not in hospital.FINAL and after.line.lstrip(": ").strip():
            add(x.line, after.line.lstrip(": ").strip())
    active, pending = False, None
    for i, x in enumerate(lines):
        if x.opens:
            active = True
        elif not active:
            continue
        elif x.is_footer:
            break
        elif x.is_admin:
            continue
        elif x.label.startswith("commentaire"):
            parts = [behind(x.line)]
            for y in lines[i + 1 :]:
                if y.is_footer:
                    break
                if not y.is_admin:
                    parts.append(y.line)
            if joined := " ".join(p for p in parts if p):
                add("Commentaire", joined)
            break
        elif pending and x.label in hospital.SAID:
            add(pending, x.line)
            pending = None
        elif x.is_value or x.is_reference:
            pending = None
        elif x.is_analyte:
            pending = x.line
    for i, x in enumerate(lines):
        if x.label in hospital.FINAL:
            value = behind(x.line) or (lines[i + 1].line.lstrip(": ").strip() if i + 1 < len(lines) else "")
            if value:
                add("Résultat final", value)
    return out


def test_fold_against_a_loop(spark):
    rng = random.Random(6)
    known = spark.createDataFrame([(LINES,)], "lines array<string>").select(hospital._classified(F.col("lines")).alias("x")).first().x
    of = dict(zip(LINES, known))
    wordy = [x for x in LINES if not of[x].is_value]
    docs = []
    for i in range(400):
        pool = LINES if i % 2 else wordy
        docs.append((f"d{i}", [(n, [rng.choice(pool) for _ in range(rng.randrange(0, 14))]) for n in range(1, rng.randrange(2, 4))]))
    docs += [("empty", [(1, [])]), ("none", [])]
    df = spark.createDataFrame(docs, "doc_id string, pages array<struct<page_number:int,lines:array<string>>>")
    found = {}
    for r in hospital.raw_results(df).orderBy("doc_id", "ordinal").collect():
        found.setdefault(r.doc_id, []).append((r.page_number, r.analyte, r.value_raw, r.reference_text, r.qualitative))
    expected = {d: loop([(n, [of[x] for x in lines]) for n, lines in p]) for d, p in docs}
    wrong = [(d, found.get(d, []), expected[d], p) for d, p in docs if found.get(d, []) != expected[d]]
    assert not wrong, wrong[0]
    assert sum(r[-1] for rows in found.values() for r in rows) > 100 and sum(not r[-1] for rows in found.values() for r in rows) > 20
    assert "Python" not in hospital.raw_results(df)._jdf.queryExecution().executedPlan().toString()


def boxes(spark, rows):
    df = spark.createDataFrame(rows, "doc_id string, page_number int, pos int, x0 double, y0 double, x1 double, y1 double, max_font_size double, is_bold boolean")
    return df.select("doc_id", "page_number", "pos", F.struct("x0", "y0", "x1", "y1").alias("bbox"), "max_font_size", "is_bold")


def test_titles_and_boundaries(spark):
    page = boxes(
        spark,
        [
            ("d", 1, 1, 10.0, 100.0, 90.0, 112.0, 12.0, True), ("d", 1, 2, 300.0, 115.0, 380.0, 127.0, 11.6, True), ("d", 1, 3, 200.0, 121.0, 280.0, 133.0, 12.0, True), ("d", 1, 4, 400.0, 95.0, 480.0, 107.0, 11.0, True), ("d", 1, 5, 120.0, 100.0, 180.0, 112.0, 14.0, False),
            ("d", 1, 6, 10.0, 300.0, 90.0, 312.0, 12.0, True), ("e", 1, 7, 10.0, 100.0, 90.0, 112.0, 12.0, True),
        ],
    )
    titles = segments.companion_titles(page.where("pos in (1, 6, 7)"), page)
    assert {r.pos: r.companion_pos for r in titles.collect()} == {1: 2, 6: None, 7: None}
    images = page.select("doc_id", "page_number", F.col("pos").alias("image_id"), F.struct(F.lit(0.0).alias("x0"), F.lit(135.0).alias("y0"), F.lit(95.0).alias("x1"), F.lit(200.0).alias("y1")).alias("bbox")).where("image_id in (1, 7)")
    assert {r.image_id: r.title_pos for r in segments.titles_above(images, page).collect()} == {1: 1, 7: 7}
    starts = titles.select("doc_id", "page_number", "pos", F.col("bbox.y0").alias("y0"), "max_font_size", "companion_pos")
    at = lambda *ys: spark.createDataFrame([("d", 1, y) for y in ys], "doc_id string, page_number int, y0 double")
    end = lambda tables, stops: {r.pos: (r.end_y, r.end_kind) for r in segments.next_boundaries(starts, page, at(*tables), at(*stops), 500.0).collect()}
    assert end([], [])[1] == (121.0, "title") and end([], [])[6] == (475.0, "page") and end([], [])[7] == (475.0, "page")
    assert end([110.0], [])[1] == (110.0, "table") and end([90.0, 110.0], [105.0])[1] == (105.0, "stop") and end([480.0], [])[6] == (475.0, "page")


def test_near_join_gives_each_pair_once(spark):
    rng = random.Random(1)
    a, b = ([(rng.randrange(3), i, rng.uniform(-50, 50)) for i in range(200)] for _ in range(2))
    left, right = spark.createDataFrame(a, "k int, i int, x double"), spark.createDataFrame(b, "k int, j int, y double")
    found = sorted((r.i, r.j) for r in rel.near_join(left, right, ["k"], F.col("x"), F.col("y"), 7.5).collect())
    assert found == sorted((i, j) for k, i, x in a for m, j, y in b if k == m and abs(x - y) <= 7.5)


def test_records_that_fit_by_code_title_or_both(spark):
    found = spark.createDataFrame([("d", 1, "c", "T", "p", "r", "first"), ("d", 2, "T", "U", "p", "r", "second"), ("d", 3, "c", "V", "q", None, None)], "doc_id string, row_index int, section string, section_name string, parameter string, result string, result_kind string")
    records = spark.createDataFrame([("d", s, p, r, "own") for s, p, r in [("c", "p", "r"), ("T", "p", "r"), ("U", "p", "r"), ("V", "q", None), ("c", "p", "x")]] + [("e", "c", "p", "r", "own")], "doc_id string, section string, parameter string, result string, result_kind string")
    assert sorted((r.doc_id, r.section, r.matched, r.result_kind) for r in stool.projected_records(records, found).collect()) == [("d", "T", True, "second"), ("d", "U", True, "second"), ("d", "V", True, None), ("d", "c", False, "own"), ("d", "c", True, "first"), ("e", "c", False, "own")]
