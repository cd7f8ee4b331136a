"""Hospital laboratory results out of running text.

Lines are classified by Column expressions, and the walk over a page's lines, in which what a line means depends on those before it, is a fold (``aggregate``)
over their array: a state is carried from line to line inside the row, on the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.functions import parse, text
from chartloom.operators import relational as rel

# Units, words of reference ranges, labels that are skipped, beginnings of administrative lines, furniture, final titles, names that open a table, words that are values.
UNITS = r"10\*3/uL|mUI/L|uU/mL|mmol/L|mg/dL|mg/l|g/dL|g/l|µg/dl|UI/ml|UI/L|U/L|pg/ml|ng/ml|pmol/l|%"
REFERENCE_WORDS = ["homme", "femme", "adulte", "enfant", "nouveau", "nourrisson", "cordon", "sexe_age", "valeur_seuil", "negatif", "positif", "risque", "normale", "taux", "indicative", "cut_off"]
SKIPPED = ["laboratoire_central", "resultats", "valeurs_physiologiques", "resultats_ant", "parametres"]
ADMIN = [
    "ip_patient", "patient", "ne_e_le", "sexe", "origine", "service", "prescripteur", "date_demande", "date_reception", "n_d_echantillon", "no_d_echantillon", "nature", "royaume_du_maroc", "ministere", "centre_hospitalo", "chef", "professeur", "medecins", "infirmier", "vice_major",
    "technicien", "imprime", "page_", "adresse_web", "tel", "le_", "valide_e_par", "edite_e_par",
]
FOOTER = "^(?:page_|adresse_web|tel)"
FINAL = ["resultat_final", "resulat_final"]
OPENERS = ["cholesterol", "creatinine", "glucose", "magnesium", "igm_totales"]
SAID = ["negatif", "positif", "absence", "presence"]
_VALUE = r"(?iu)^([<>]=?)?\s*(-?\d+(?:[.,]\d+)?)\s*([A-Za-zµ/%]+(?:\[[A-Za-z]+\])?(?:/[A-Za-zµ]+)?|mUI/L|uU/mL)?$"


def is_value(line: Column) -> Column:
    return line.rlike(_VALUE)


def is_reference(line: Column, key: Column) -> Column:
    short = line.rlike(r"^[A-Z]{1,5}\s*\d{1,3}(?:-\d{1,3})?$")
    ranged = line.rlike(r"(?iu)\d+(?:[,.]\d+)?\s+(?:-|à|a|et)\s+\d") | line.rlike(r"\(\s*\d+(?:[,.]\d+)?\s*-\s*\d") | line.rlike("^[<>]")
    return (line != "") & ~short & (line.rlike(f"(?iu)^(?:{UNITS})$") | key.rlike("|".join(REFERENCE_WORDS)) | ranged)


def is_admin(line: Column, key: Column) -> Column:
    return (key == "") | key.isin(*SKIPPED) | key.rlike(f"^(?:{'|'.join(ADMIN)})") | line.rlike("المملكة|وزارة")


_LINES = "array<string>"
_ROW = "struct<page_number:int,analyte:string,value_raw:string,unit:string,reference_text:string,qualitative:boolean>"


def _classified(lines: Column) -> Column:
    """What each line may be; its label is worked out once."""
    part = lambda line, i: F.nullif(F.regexp_extract(line, _VALUE, i), F.lit(""))

    def known(line: Column, key: Column) -> Column:
        value, reference, admin = is_value(line), is_reference(line, key), is_admin(line, key)
        number = F.concat(F.coalesce(part(line, 1), F.lit("")), part(line, 2))
        return F.struct(
            line.alias("line"), key.alias("label"), value.alias("is_value"), reference.alias("is_reference"), admin.alias("is_admin"), F.when(value, number).alias("number"), F.when(value, parse.normalize_unit(part(line, 3))).alias("unit"),
            key.rlike(FOOTER).alias("is_footer"), ((key == "parametres") | key.startswith("examen_")).alias("opens"), key.startswith("automate").alias("is_device"),
        )

    def named(x: Column) -> Column:
        analyte = ~x["is_admin"] & ~x["is_reference"] & ~x["is_value"] & ~x["is_device"] & (F.length(x["line"]) <= 95) & x["line"].rlike("[A-Za-zÀ-ÿ]")
        return F.struct(*(x[c].alias(c) for c in ("line", "label", "is_value", "is_reference", "is_admin", "number", "unit", "is_footer", "opens", "is_device")), analyte.alias("is_analyte"))

    return F.transform(lines, lambda line: text.let(text.let(text.label(line), lambda key: known(line, key)), named))


def _struct(**parts: Column) -> Column:
    return F.struct(*(value.alias(name) for name, value in parts.items()))


def _numeric(number: Column, lines: Column) -> Column:
    """Numeric rows of a page: a fold over its lines that keeps the open row (name, reference, last value) and whether a table is open.

    A row is closed by a name that follows a value or reference, by the page's furniture, and by the page's end.
    """
    none = F.array().cast(_LINES)
    nothing = F.lit(None).cast("struct<number:string,unit:string>")
    start = _struct(active=F.lit(False), name=none, reference=none, value=nothing, out=F.array().cast(f"array<{_ROW}>"))

    def closed(s: Column) -> Column:
        row = _struct(page_number=number, analyte=F.array_join(s["name"], " "), value_raw=s["value"]["number"], unit=s["value"]["unit"], reference_text=F.array_join(s["reference"], " "), qualitative=F.lit(False))
        return F.when((F.size(s["name"]) > 0) & s["value"].isNotNull(), F.array_append(s["out"], row)).otherwise(s["out"])

    def step(s: Column, x: Column) -> Column:
        begun = F.size(s["name"]) > 0
        opened = s["active"] | ((number != 1) & x["label"].rlike("|".join(OPENERS)))
        event = (
            F.when(x["opens"], "open").when(~opened, "wait").when(x["is_footer"], "end").when(x["is_admin"] | x["is_device"], "skip").when(x["is_value"] & begun, "value").when(x["is_reference"] & begun, "reference")
            .when(x["is_analyte"], F.when(begun & ((F.size(s["reference"]) > 0) | s["value"].isNotNull()), "next").otherwise("name")).otherwise("skip")
        )

        def moved(e: Column) -> Column:
            ends = e.isin("end", "next")
            name = F.when(ends, none).otherwise(s["name"])
            return _struct(
                active=F.when(e == "open", True).when(e == "end", False).otherwise(opened),
                name=F.when(e.isin("name", "next"), F.array_append(name, x["line"])).otherwise(name),
                reference=F.when(ends, none).when(e == "reference", F.array_append(s["reference"], x["line"])).otherwise(s["reference"]),
                value=F.when(ends, nothing).when(e == "value", F.struct(x["number"].alias("number"), x["unit"].alias("unit"))).otherwise(s["value"]),
                out=F.when(ends, closed(s)).otherwise(s["out"]),
            )

        return text.let(event, moved)

    return F.aggregate(lines, start, step, closed)


def _said(number: Column, lines: Column) -> Column:
    """Named values of a page without a number: 'name' then ': value'; name then a word; comment; final result."""
    empty = F.array().cast(f"array<{_ROW}>")
    add = lambda name, value: _struct(page_number=number, analyte=name, value_raw=value, unit=F.lit("qualitative"), reference_text=F.lit("Qualitatif"), qualitative=F.lit(True))
    behind = lambda line: text.strip(F.regexp_replace(line, "^[^:]*:", ""))
    after_marks = lambda line: text.strip(F.regexp_replace(line, "^[: ]+", ""))

    def pair(x: Column, i: Column) -> Column:
        after = F.get(lines, i + 1)["line"]
        return F.when(after.startswith(":") & ~x["is_admin"] & ~x["label"].isin(*FINAL), text.let(after_marks(after), lambda v: F.when(v != "", add(x["line"], v))))

    def last(x: Column, i: Column) -> Column:
        own = F.when(x["line"].contains(":"), F.nullif(behind(x["line"]), F.lit("")))
        value = F.coalesce(own, F.nullif(after_marks(F.get(lines, i + 1)["line"]), F.lit("")))
        return F.when(x["label"].isin(*FINAL), text.let(value, lambda v: F.when(v.isNotNull(), add(F.lit("Résultat final"), v))))

    start = _struct(mode=F.lit("closed"), pending=F.lit(None).cast("string"), comment=F.array().cast(_LINES), out=empty)

    def step(s: Column, x: Column) -> Column:
        commented = s["mode"] == "comment"
        event = (
            F.when(s["mode"] == "over", "skip").when(commented, F.when(x["is_footer"], "end").when(x["is_admin"], "skip").otherwise("more")).when(x["opens"], "open").when(s["mode"] == "closed", "skip").when(x["is_footer"], "end").when(x["is_admin"], "skip")
            .when(x["label"].startswith("commentaire"), "comment").when(s["pending"].isNotNull() & x["label"].isin(*SAID), "word").when(x["is_value"] | x["is_reference"], "drop").when(x["is_analyte"], "name").otherwise("skip")
        )

        def moved(e: Column) -> Column:
            opening = F.when(x["line"].contains(":"), F.array(behind(x["line"]))).otherwise(F.array().cast(_LINES))
            return _struct(
                mode=F.when(e == "open", "open").when(e == "end", "over").when(e == "comment", "comment").otherwise(s["mode"]),
                pending=F.when(e.isin("word", "drop"), None).when(e == "name", x["line"]).otherwise(s["pending"]),
                comment=F.when(e == "comment", opening).when(e == "more", F.array_append(s["comment"], x["line"])).otherwise(s["comment"]),
                out=F.when(e == "word", F.array_append(s["out"], add(s["pending"], x["line"]))).otherwise(s["out"]),
            )

        return text.let(event, moved)

    def finished(s: Column) -> Column:
        said = F.array_join(F.filter(s["comment"], lambda x: x != ""), " ")
        return F.when(said != "", F.array_append(s["out"], add(F.lit("Commentaire"), said))).otherwise(s["out"])

    walked = F.aggregate(lines, start, step, finished)
    return F.concat(F.array_compact(F.transform(lines, pair)), walked, F.array_compact(F.transform(lines, last)))


def raw_results(docs: DataFrame) -> DataFrame:
    """Rows in order; named values count only in documents without a numeric row.

    A document's lines stay in its row: what a line means depends on those before it, so a page is folded, and nothing is shuffled.
    """
    pages = F.transform("pages", lambda p: F.struct(p["page_number"].cast("int").alias("n"), _classified(p["lines"]).alias("lines")))
    over = lambda rows: F.flatten(F.transform("_pages", lambda p: rows(p["n"], p["lines"])))
    known = docs.select(F.col("doc_id").cast("string").alias("doc_id"), pages.alias("_pages")).withColumn("_rows", over(_numeric))
    rows = F.when(F.size("_rows") > 0, F.col("_rows")).otherwise(over(_said))
    return known.select("doc_id", F.posexplode(rows).alias("ordinal", "r")).select("doc_id", "ordinal", "r.*")


def results(docs: DataFrame, dates: DataFrame) -> DataFrame:
    """Canonical rows; dates(doc_id, observation_date).  The key of a row holds its own unit only, not one inferred from the reference."""
    rows = raw_results(docs)
    inferred = parse.normalize_unit(F.try_element_at(F.regexp_extract_all("reference_text", F.lit(f"(?iu)({UNITS})"), F.lit(1)), F.lit(-1)))
    unit = F.coalesce("unit", inferred, F.when(F.col("qualitative"), "qualitative").otherwise("unknown"))
    key = F.concat_ws("|", text.label(F.col("analyte")), F.col("value_raw"), F.coalesce(parse.normalize_unit(F.col("unit")), F.lit("")))
    none = F.struct(F.lit("Qualitatif").alias("text"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    rows = rows.withColumn("dedup_key", key).withColumn("reference_range", F.when(F.col("qualitative"), none).otherwise(parse.simple_reference_range(F.col("reference_text"))))
    rows = rows.withColumn("value_numeric", F.when(~F.col("qualitative"), parse.parse_float(F.col("value_raw")))).withColumn("unit", unit)
    rows = rows.withColumn("result_kind", F.when(F.col("qualitative"), "qualitative").otherwise("numeric")).withColumn("source_kind", F.lit("chu_text_fallback"))
    return rel.keep_first(rows, ["doc_id", "dedup_key"], ["ordinal"]).join(dates, "doc_id", "left")
