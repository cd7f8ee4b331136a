import hashlib
import random
import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chartloom.functions import confidence, geometry, identity, parse, text
from chartloom.operators import relational as rel


def column(spark, function, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", function(F.col("v")).alias("x")).orderBy("i").collect()]


def plain_label(value):
    value = re.sub(r"[^\S\n]+", " ", value.replace("\0", " ")).strip().lower()
    value = "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c))
    return re.sub(r"[^a-z0-9]+", "_", value).strip("_")


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abcXYZ019 -_.éÈçÀñÜœŒ\t\ń°ẞº", max_size=25), min_size=1, max_size=20))
def test_label_by_property(spark, values):
    assert column(spark, text.label, values) == [plain_label(v) for v in values]


def test_text(spark):
    assert column(spark, text.clean_text, ["a\r\nb\rc", " x\t y\n\n\n\nz ", "a\0b"]) == ["a\nb\nc", "x y\n\nz", "a b"]
    assert column(spark, text.inline, ["a \n b", None]) == ["a   b", None]
    assert column(spark, text.safe_stem, ["a b/c.pdf", "...", ""]) == ["a_b_c.pdf", "document", "document"]
    assert column(spark, text.slugify, ["Jané Doe", "--"]) == ["Jan_Doe", "patient"]
    assert column(spark, text.page_name, [3], "int") == ["page_003"]
    assert column(spark, text.strip_page_boilerplate, ["a\n\nPage 3\nDocument synthétique - x\n b ", None]) == ["a\nb", ""]
    assert column(spark, text.lines, ["a\n \nb\x0bc", None]) == [["a", "b", "c"], []]
    assert column(spark, text.ocr_analyte, ["Automated count Glucose (Moles/volume] in Pinema ra", None]) == ["Glucose [Moles/volume] in Plasma", ""]
    assert column(spark, text.dedupe_fragments, [["abc", "ab", "x", "xyz", "q", "?"]], "array<string>") == [["abc", "x", "q"]]
    found = column(spark, lambda v: text.find_labels(v, ["Patient", "Age", "Sexe", "None"]), ["Patient : Jane Age: 40 SEXE F"])
    assert found == [{"Patient": "Jane", "Age": "40", "Sexe": "F"}]


def test_dates(spark):
    cases = {"31/02/2024": None, "12 févr. 2023": "2023-02-12", "2024-13-40": "2024-13-40", "1-2-2024": "2024-02-01", "5 brumaire 2000": None, "le 3 Août 2021.": "2021-08-03", "": None, "29/02/2024": "2024-02-29"}
    assert column(spark, parse.parse_iso_date, list(cases)) == list(cases.values())
    times = {"03/06/2024 10:15": "2024-06-03T10:15:00", "04/06/2024 12:04:25": "2024-06-04T12:04:25", "04/06/2024 25:04": None, "03/06/2024": "2024-06-03"}
    assert column(spark, parse.parse_datetime, list(times)) == list(times.values())
    df = spark.createDataFrame([("1980-02-01", "2024-06-03"), ("2000-02-29", "2001-02-28"), ("2030-01-01", "2024-01-01"), ("x", "2024-01-01")], "b string, d string")
    assert [r.a for r in df.select(parse.calendar_age(F.col("b"), F.col("d")).alias("a")).collect()] == [44, 0, None, None]


def test_numbers_and_ranges(spark):
    assert column(spark, parse.parse_int, ["a -12 b", "x", None]) == [-12, None, None]
    assert column(spark, parse.parse_float, ["1,5 mg", ".5", "none"]) == [1.5, 5.0, None]
    row = lambda r: (r.text, r.low, r.high)
    assert [row(r) for r in column(spark, parse.reference_range, ["4,0 - 10,5", "< 5", "4-10", "", None])] == [("4,0 - 10,5", 4.0, 10.5), ("< 5", 5.0, None), ("4-10", 4.0, 10.0), (None, None, None), (None, None, None)]
    assert [row(r) for r in column(spark, parse.simple_reference_range, ["< 5", "> 2,5", "3 à 4", "see 1, 2 and 3"])] == [("< 5", None, 5.0), ("> 2,5", 2.5, None), ("3 à 4", 3.0, 4.0), ("see 1, 2 and 3", None, None)]
    assert column(spark, parse.normalize_unit, ["10°3/uL.", "mg/dl", "g / L", "", "odd"]) == ["10*3/uL", "mg/dL", "g/L", None, "odd"]
    assert column(spark, parse.is_known_unit, ["9", "odd", None]) == [True, False, False]
    assert column(spark, parse.normalize_flag, ["h", "N", "-", "x", None]) == ["H", None, None, "X", None]


def plain_repair(raw, low, high, flag):
    if "." in raw or "," in raw or float(raw) <= high:
        return float(raw)
    number, best, score = float(raw), None, None
    for x in (number, number / 10, number / 100):
        s = 6 if low <= x <= high else 4 if flag == "H" and x > high or flag == "L" and x < low else 2 if low * 0.8 <= x <= high * 1.2 else 0
        s -= max(low - x, x - high, 0) / max(high - low, 1) + (x == number)
        if score is None or s > score:
            best, score = x, s
    return best if best != number and score >= 3 else number


def test_repair(spark):
    rng = random.Random(1)
    rows = [("45", 3.5, 5.1, None), ("120", 90.0, 120.0, None), ("1305", 135.0, 145.0, None), ("1305", 135.0, 145.0, "L"), ("7,5", 1.0, 2.0, None), ("0", 0.0, 1.0, None)]
    rows += [(str(rng.randrange(1, 5000)), float(low := rng.randrange(1, 100)), float(low + rng.randrange(1, 60)), rng.choice([None, "H", "L"])) for _ in range(200)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, raw string, low double, high double, flag string")
    found = df.select("i", parse.repair_numeric(F.col("raw"), F.col("low"), F.col("high"), F.col("flag")).alias("r")).orderBy("i").collect()
    assert [f.r.value_numeric for f in found] == pytest.approx([plain_repair(r.replace(",", ".") if "," in r else r, a, b, c) if "," not in r else 7.5 for r, a, b, c in rows])
    assert [f.r.value_raw for f in found[:4]] == ["4.5", "120", "1305", "130.5"]


def test_identity(spark):
    good = "0a1b2c3d-0000-1111-2222-333344445555"
    spoilt = "OA1B2C3D-oooo-llll-2222-333344445555"
    split = "xx0a1b2c3d-0000-1111-2222-3333-44445555"
    assert column(spark, identity.canonical_uuid, [good, spoilt, split, "ab--12", "", None]) == [good, good, good, "ab-12", None, None]
    assert column(spark, identity.is_patient_identifier, [good, "53", "a b", None]) == [True, True, False, False]
    assert column(spark, identity.report_id, ["sr 12-a.b", "!"]) == ["SR12-AB", None]
    assert column(spark, identity.sex, ["Féminin", "male", "?"]) == ["F", "M", None]
    field = lambda name, v: tuple(column(spark, lambda c: identity.named_field(name, c), [v])[0])
    assert field("patient_id", "53") == ("53", "53", "needs_review") and field("sex", "F") == ("F", "F", "as_extracted") and field("unit", " ") == (None, None, "missing")
    assert field("encounter_type", "Externe") == ("Externe", "External", "canonicalized") and field("other", " x ") == ("x", "x", "as_extracted")


def plain_confidence(value, source, corrected=False, field_length=0):
    score = {"native": 0.95, "ocr": 0.85, "hybrid": 0.9}.get(source, 0.88) - 0.05 * corrected
    length = field_length or len(value)
    score -= 0.05 * (length < 3)
    score += 0.02 * bool(re.search(r"\d", value) and re.search(r"\b[a-z%/]{1,6}\b", value, re.I))
    score -= 0.05 * (not value or value.endswith(":") or value in ("-", "unknown") or "needs_review" in value)
    seed = int(hashlib.md5(f"{source}|{value}|{length}|{int(corrected)}".encode()).hexdigest()[:8], 16)
    return round(max(0.5, min(0.99, score + random.Random(seed).uniform(-0.02, 0.02))), 3)


def test_confidence(spark):
    values = ["Glucose 5.4 mmol", "x", "", "name:", "un très long texte", "-"]
    for source in ("native", "ocr", "other"):
        assert column(spark, lambda v: confidence.extraction_confidence(v, F.lit(source)), values) == pytest.approx([plain_confidence(v, source) for v in values])
    assert column(spark, confidence.band, [0.85, 0.6, 0.59], "double") == ["high", "medium", "low"]
    assert tuple(column(spark, confidence.mean_positive, [[0.9, 0.0, 0.8]], "array<double>")[0]) == ("high", 0.85)
    assert tuple(column(spark, confidence.mean_positive, [[]], "array<double>")[0]) == ("low", 0.0)


def test_geometry(spark):
    df = spark.createDataFrame([((0.0, 0.0, 10.0, 5.0), (5.0, 8.0, 15.0, 9.0))], "a struct<x0:double,y0:double,x1:double,y1:double>, b struct<x0:double,y0:double,x1:double,y1:double>")
    a, b = F.col("a"), F.col("b")
    r = df.select(geometry.area(a).alias("area"), geometry.vertical_distance(a, b).alias("v"), geometry.horizontal_overlap(a, b).alias("h"), geometry.envelope_of(F.array(a, b)).alias("e"), geometry.clamp(b, F.lit(100.0), F.lit(100.0)).alias("c"), geometry.contains_y(a, F.lit(5.0)).alias("y")).first()
    assert (r.area, r.v, r.h, tuple(r.e), r.c, r.y) == (50.0, 3.0, 0.5, (0.0, 0.0, 15.0, 9.0), None, True)


def test_pair_lines_do_not_overlap(spark):
    pairs = column(spark, rel.pair_lines, [["a", ":1", ":2", ":3", "b", ":4", "c"]], "array<string>")[0]
    assert [(p.at, p.name, p.value) for p in pairs] == [(0, "a", ":1"), (2, ":2", ":3"), (4, "b", ":4")]


def test_ranked_dedup_lists_losers_in_order(spark):
    rows = [(1, "k", "A", 2, -2), (2, "k", "B", 3, -3), (3, "k", "C", 3, -1), (4, "k", "D", 3, -1), (5, "j", "E", 1, 0)]
    df = spark.createDataFrame(rows, "n int, key string, name string, priority int, page int")
    found = {r.key: (r.name, [s.name for s in r.duplicate_sources]) for r in rel.ranked_dedup(df, ["key"], [F.col("priority"), F.col("page")], "n", F.struct("name")).collect()}
    assert found == {"k": ("C", ["A", "B", "D"]), "j": ("E", [])}
