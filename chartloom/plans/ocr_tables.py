"""Tables rebuilt from recognised lines: result rows that run over several lines, and header fields.

The lines of a page are an array in reading order; rows are put together by one fold over it (``aggregate``), inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.functions import identity, parse, text
from chartloom.operators import relational as rel
from chartloom.plans import tables

# Labels that open and close the results band, words that do not begin a row, words after which a name goes on, beginnings of header lines.
BAND_START, BAND_STOPS = "analyse_observation", "document_synthetique|validation_medicale|resume_du_dossier"
NO_START, SPECIMENS, UNFINISHED = ("automated", "count", "or", "plasma", "serum", "blood"), r"(?i)\b(Blood|Serum|Plasma|Pressure|Height)\b", ("by", "or", "in", "automated", "count", "serum", "plasma")
HEADER_LABELS = ("patient", "numero_de_rapport", "identifiant", "date_du_document", "type_de_rencontre", "date_de_naissance", "prescripteur", "age", "specialite", "sexe", "statut", "adresse")
SIMPLE_FIELDS = {"birth_date": "Date de naissance", "age": "Age", "sex": "Sexe", "encounter_type": "Type de rencontre", "prescriber": "Prescripteur", "specialty": "Specialite", "status": "Statut"}
_DATE = r"(\d{1,2}\s+[\p{L}\d_]+\.?\s+\d{4})\s*$"
_NUMBER = r"-?\d+(?:[.,]\d+)?"
_RANGE = rf"(?i)(Selon contexte|{_NUMBER}\s*-\s*{_NUMBER})\s*$"
_ROW = "array<struct<prefix:string,main:string,suffix:string>>"


def results_band(lines: Column) -> Column:
    """Lines after the results header up to the first closing label."""
    marked = F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"), text.label(x).alias("k")))

    def cut(m: Column) -> Column:
        first = lambda fits: F.array_min(F.transform(F.filter(m, fits), lambda r: r["i"]))
        ends = lambda start: F.struct(start.alias("start"), F.coalesce(first(lambda r: (r["i"] > start) & r["k"].rlike(BAND_STOPS)), F.size(m)).alias("stop"))
        inside = lambda e: F.transform(F.filter(m, lambda r: (r["i"] > e["start"]) & (r["i"] < e["stop"])), lambda r: r["x"])
        return F.coalesce(text.let(text.let(first(lambda r: r["k"].contains(BAND_START)), ends), inside), F.array().cast("array<string>"))

    return text.let(marked, cut)


def continuation(line: Column) -> Column:
    """A line's words that hold a letter, other characters dropped."""
    plain = F.regexp_replace(text.inline(line), r"[^A-Za-z0-9/\[\]()%._#+ -]+", " ")
    return F.array_join(F.filter(F.split(plain, r"\s+"), lambda t: t.rlike("[A-Za-z]")), " ")


def begins_row(line: Column) -> Column:
    first = F.get(F.split(text.label(line), "_"), F.lit(0))
    return ~first.isin(*NO_START) & (line.rlike(r"[\[/]") | line.rlike(SPECIMENS))


def _before_date(main: Column) -> Column:
    """struct(head, reference, flag): what stands before a row's date; head is null without a reference."""
    trimmed = F.regexp_replace(F.regexp_replace(main, _DATE, ""), r"[\s:;,.]+$", "")

    def unflagged(t: Column) -> Column:
        flagged = lambda flag: F.when(flag != "", F.regexp_replace(t, r"\s*\b[HL]$", "")).otherwise(F.regexp_replace(t, r"[\s:;,.\\/-]+$", ""))
        return text.let(F.regexp_extract(t, r"\b([HL])$", 1), lambda flag: F.struct(flag.alias("flag"), flagged(flag).alias("bare")))

    def ranged(x: Column) -> Column:
        def parts(reference: Column) -> Column:
            head = F.when(reference != "", text.strip(F.regexp_replace(x["bare"], _RANGE, "")))
            return F.struct(head.alias("head"), text.inline(F.nullif(reference, F.lit(""))).alias("reference"), F.coalesce(F.nullif(x["flag"], F.lit("")), F.lit("-")).alias("flag"))

        return text.let(F.regexp_extract(x["bare"], _RANGE, 1), parts)

    return text.let(text.let(trimmed, unflagged), ranged)


def _expects_more(row: Column) -> Column:
    """Whether a row's name, up to its value, ends with a word after which names go on."""
    name = lambda head: F.coalesce(F.nullif(F.regexp_extract(head, rf"^(.*?)\s+{_NUMBER}(?:\s+(?!{_NUMBER}(?:\s|$))\S+)*$", 1), F.lit("")), head)
    named = text.let(_before_date(F.concat_ws(" ", row["prefix"], row["main"]))["head"], name)
    return F.coalesce(F.element_at(F.split(text.label(named), "_"), -1).isin(*UNFINISHED), F.lit(False))


def assembled(lines: Column) -> Column:
    """Rows of a results band: what came before the line with the date, that line, and what its name still needs.

    A line that ends with a date is a row.  Other lines belong to the open row if its name is unfinished, else they are kept for the next row; a line that
    looks like the beginning of a row closes the open one.
    """
    facts = F.transform(lines, lambda x: F.struct(x.alias("x"), text.label(x).alias("k"), x.rlike(_DATE).alias("dated"), continuation(x).alias("more")))
    start = F.struct(F.array().cast(_ROW).alias("rows"), F.lit("").alias("buffer"), F.lit(False).alias("open"))

    def step(acc: Column, line: Column) -> Column:
        state = lambda rows, buffer, open_: F.struct(rows.alias("rows"), buffer.alias("buffer"), open_.alias("open"))
        row = F.struct(acc["buffer"].alias("prefix"), line["x"].alias("main"), F.lit("").alias("suffix"))
        last = F.try_element_at(acc["rows"], F.lit(-1))
        grown = F.concat(F.slice(acc["rows"], 1, F.greatest(F.size(acc["rows"]) - 1, F.lit(0))), F.array(F.struct(last["prefix"], last["main"], F.btrim(F.concat_ws(" ", last["suffix"], line["more"])).alias("suffix"))))
        return (
            F.when(line["k"].isin("", "alert", "date"), state(acc["rows"], acc["buffer"], acc["open"]))
            .when(line["dated"], state(F.concat(acc["rows"], F.array(row)), F.lit(""), F.lit(True)))
            .when(line["more"] == "", state(acc["rows"], acc["buffer"], acc["open"]))
            .when(acc["open"] & begins_row(line["more"]), state(acc["rows"], line["more"], F.lit(False)))
            .when(acc["open"] & _expects_more(last), state(grown, acc["buffer"], acc["open"]))
            .otherwise(state(acc["rows"], F.btrim(F.concat_ws(" ", acc["buffer"], line["more"])), acc["open"]))
        )

    return F.aggregate(facts, start, step)["rows"]


def result_rows(pages: DataFrame) -> DataFrame:
    """pages(doc_id, page_number, lines) to one results record per row, numbers repaired against their range, with what was changed."""
    rows = pages.select("doc_id", "page_number", F.posexplode(assembled(results_band(F.col("lines")))).alias("row", "r"))
    rows = rel.worked_out(rows, "b", _before_date(F.col("r.main"))).where("b.head is not null")
    pattern = rf"^(.*\S)\s+({_NUMBER})\s+(\S.*)$"
    part = lambda i: F.nullif(F.regexp_extract("b.head", pattern, i), F.lit(""))
    name = text.ocr_analyte(F.concat_ws(" ", F.nullif("r.prefix", F.lit("")), part(1), F.nullif("r.suffix", F.lit(""))))
    rows = rel.worked_out(rows.where(~F.col("b.head").rlike(rf"(?:^|\s){_NUMBER}$")), "analyte", name).select(
        "doc_id", "page_number", "row", "analyte", part(2).alias("value"), F.coalesce(parse.normalize_unit(part(3)), F.lit("unknown")).alias("unit"), F.col("b.reference").alias("reference"), F.col("b.flag").alias("flag"), text.inline(F.regexp_extract("r.main", _DATE, 1)).alias("date")
    )
    rows = rows.where("analyte <> '' and value is not null").withColumn("_range", parse.reference_range(F.col("reference")))
    fixed = parse.repair_numeric(F.col("value"), F.col("_range.low"), F.col("_range.high"), F.nullif("flag", F.lit("-")))
    rows = rows.withColumn("_f", fixed).withColumn("corrected", F.col("_f.repaired")).withColumn("ocr_value", F.when(F.col("corrected"), F.col("value")))
    return rows.withColumn("value", F.col("_f.value_raw")).drop("_range", "_f")


def _stripped(line: Column, name: str) -> Column:
    return text.inline(F.regexp_replace(line, rf"(?i)^{name}\s*", ""))


def header_fields(pages: DataFrame) -> DataFrame:
    """pages(doc_id, page_number, lines) of first pages to patient and report fields.

    An identifier that was cut over two lines (before 'Date du document' and after 'Identifiant') is joined and repaired; an address is what follows its label
    or the status up to the next label, from its first digit on.
    """
    lines = F.col("lines")
    keyed = F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"), text.label(x).alias("k")))
    base = pages.where("page_number = 1").withColumn("_all", keyed)
    stop = F.array_min(F.transform(F.filter("_all", lambda r: r["k"].rlike("^resultats_selectionnes|analyse_observation")), lambda r: r["i"]))
    base = base.withColumn("_h", F.filter("_all", lambda r: (r["i"] < F.coalesce(stop, F.size("_all"))) & (r["k"] != "") & ~r["k"].startswith("document_synthetique"))).withColumn("_h", F.transform("_h", lambda r, i: F.struct(r["x"].alias("x"), i.alias("i"), r["k"].alias("k"))))
    labelled = lambda k: k.rlike("^(?:" + "|".join(HEADER_LABELS) + ")")
    at = lambda key: F.try_element_at(F.filter("_h", lambda r: r["k"].startswith(key)), F.lit(-1))
    both = r"(?i)Patient\s+(.+?)\s+Numero de rapport\s+(.+)$"
    top = F.get(F.filter("_h", lambda r: r["x"].rlike(both)), F.lit(0))["x"]
    dated = F.try_element_at(F.filter("_h", lambda r: r["k"].contains("date_du_document")), F.lit(-1))["x"]
    lead = F.regexp_replace(F.regexp_extract(dated, r"(?i)^(.*?)Date du document", 1), "[^A-Za-z0-9-]", "")
    own = at("identifiant")
    follow = F.get("_h", own["i"] + 1)
    number = F.coalesce(F.nullif(_stripped(own["x"], "Identifiant"), F.lit("")), F.when(~labelled(follow["k"]), follow["x"]), F.lit(""))
    joined = F.concat(F.when(F.length(lead) >= 8, lead).otherwise(""), F.regexp_replace(number, "[^A-Za-z0-9-]", ""))

    def trailing(key: str) -> Column:
        begin = at(key)["i"]
        end = F.coalesce(F.array_min(F.transform(F.filter("_h", lambda r: (r["i"] > begin) & labelled(r["k"])), lambda r: r["i"])), F.size("_h"))
        return F.coalesce(F.transform(F.filter("_h", lambda r: (r["i"] > begin) & (r["i"] < end)), lambda r: r["x"]), F.array().cast("array<string>"))

    said = F.coalesce(F.array(_stripped(at("adresse")["x"], "Adresse")), F.array().cast("array<string>"))
    address = text.inline(F.array_join(F.concat(trailing("statut"), F.array_compact(said), trailing("adresse")), " "))
    address = F.coalesce(F.nullif(F.regexp_extract(address, r"\d.*", 0), F.lit("")), F.nullif(address, F.lit("")))
    fields = {c: F.nullif(_stripped(at(text_label(n))["x"], n), F.lit("")) for c, n in SIMPLE_FIELDS.items()}
    return base.select(
        "doc_id", text.inline(F.nullif(F.regexp_extract(top, both, 1), F.lit(""))).alias("patient"), identity.report_id(F.regexp_extract(top, both, 2)).alias("report_id"), F.nullif(text.inline(F.regexp_extract(dated, r"(?i)Date du document(.*)$", 1)), F.lit("")).alias("report_date"),
        identity.canonical_uuid(joined).alias("patient_id"), *(v.alias(c) for c, v in fields.items()), address.alias("address"),
    )


def text_label(name: str) -> str:
    return name.lower().replace(" ", "_")


def as_tables(rows: DataFrame) -> DataFrame:
    """Rows of a page as one results table, the columns named as in native tables."""
    names = {"Analyse / Observation": "analyte", "Resultat": "value", "Unites": "unit", "Valeurs de reference": "reference", "Alerte": "flag", "Date": "date", "Correction OCR appliquee": "corrected", "Resultat OCR brut": "ocr_value"}
    record = F.create_map(*(x for n, c in names.items() for x in (F.lit(n), F.coalesce(F.col(c).cast("string"), F.lit("")))))
    grouped = rows.groupBy("doc_id", "page_number").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", F.to_json(record).alias("j")))), lambda r: F.from_json(r["j"], "map<string,string>")).alias("records"))
    return grouped.select(
        "doc_id", F.col("page_number").alias("table_no"), F.format_string("table_p%03d_01", F.col("page_number")).alias("table_id"), "page_number", F.array(*map(F.lit, names)).alias("columns"), "records", F.lit("results_table").alias("table_role"), F.lit(True).alias("is_indexable"), F.lit(True).alias("from_ocr")
    )


def distinct_tables(found: DataFrame) -> DataFrame:
    return tables.deduplicated(found)
