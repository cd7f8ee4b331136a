"""Tables: cleaning, header names, roles, keys and duplicates.  A table is a row with ``cells array<array<string>>``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.functions import identity, parse, text
from chartloom.operators import relational as rel

# Labels of header cells and fields and how they are shown; fields that are normalised by name; labels of each role.
SHOWN = {
    "analyse_observation": "Analyse / Observation", "resultat": "Resultat", "unites": "Unites", "valeurs_de_reference": "Valeurs de reference", "alerte": "Alerte", "date": "Date", "patient": "Patient", "identifiant": "Identifiant",
    "date_de_naissance": "Date de naissance", "age": "Age", "sexe": "Sexe", "adresse": "Adresse", "numero_de_rapport": "Numero de rapport", "date_du_document": "Date du document", "type_de_rencontre": "Type de rencontre",
    "prescripteur": "Prescripteur", "specialite": "Specialite", "statut": "Statut", "champ": "Field", "valeur": "Value",
}
NORMALIZED = {"Identifiant": "patient_id", "Date de naissance": "birth_date", "Sexe": "sex", "Numero de rapport": "report_id", "Date du document": "report_date", "Type de rencontre": "encounter_type", "Specialite": "specialty"}
RESULT_COLUMNS = ("analyse_observation", "resultat", "unites")
PATIENT_FIELDS = ("patient", "identifiant", "date_de_naissance", "age", "sexe", "adresse")
REPORT_FIELDS = ("numero_de_rapport", "date_du_document", "type_de_rencontre", "prescripteur", "specialite", "statut")


def clean_cell(value: Column) -> Column:
    return text.let(text.inline(F.coalesce(value, F.lit(""))), lambda shown: F.when(text.is_boilerplate(shown), "").otherwise(shown))


def shown_name(value: Column) -> Column:
    return F.coalesce(parse.look_up(SHOWN, text.label(value)), value)


def header_names(cells: Column) -> Column:
    """Shown names of header cells; an empty one is column_i, the nth of equal names gets _n."""
    given = F.transform(cells, lambda c, i: F.when(c == "", F.concat(F.lit("column_"), (i + 1).cast("string"))).otherwise(shown_name(c)))

    def numbered(names: Column) -> Column:
        def one(name: Column, i: Column) -> Column:
            nth = F.size(F.filter(F.slice(names, 1, i + 1), lambda n: n == name))
            return F.when(nth > 1, F.concat(name, F.lit("_"), nth.cast("string"))).otherwise(name)

        return F.when(F.size(F.array_distinct(names)) == F.size(names), names).otherwise(F.transform(names, one))

    return text.let(given, numbered)


def is_field_value(rows: Column) -> Column:
    """Whether at least two, and half, of the first six rows begin with a known field."""
    some = F.slice(rows, 1, 6)
    known = F.size(F.filter(some, lambda r: text.label(F.get(r, F.lit(0))).isin(*PATIENT_FIELDS, *REPORT_FIELDS)))
    return known >= F.greatest(F.lit(2), F.floor(F.size(some) / 2))


def _normal(cells: Column) -> Column:
    """struct(columns, records, table_role) of a table's cells; one expression whose steps are bound once."""
    let = text.let

    def shaped(rows: Column) -> Column:
        top = F.coalesce(F.get(rows, F.lit(0)), F.array().cast("array<string>"))
        bad = F.exists(top, lambda c: c == "") | (F.size(F.array_distinct(top)) < F.size(top))
        return F.struct(rows.alias("rows"), is_field_value(rows).alias("fv"), top.alias("top"), bad.alias("bad"))

    def named(x: Column) -> Column:
        plain = F.transform(x["top"], lambda c, i: F.concat(F.lit("column_"), (i + 1).cast("string")))
        names = F.when(x["fv"], F.array(F.lit("Field"), F.lit("Value"))).when(x["bad"], plain).otherwise(header_names(x["top"]))
        data = F.when(x["fv"] | x["bad"], x["rows"]).otherwise(F.slice(x["rows"], 2, F.greatest(F.size(x["rows"]) - 1, F.lit(0))))
        return F.struct(x["fv"].alias("fv"), names.alias("columns"), data.alias("data"))

    def recorded(x: Column) -> Column:
        record = lambda r: F.map_from_entries(F.transform(x["columns"], lambda n, i: F.struct(n, F.coalesce(F.get(r, i), F.lit("")))))
        fields = F.transform(F.slice(x["data"], 1, 6), lambda r: text.key(F.coalesce(F.get(r, F.lit(0)), F.lit(""))))
        labels = F.transform(x["columns"], text.label)
        return F.struct(x["fv"].alias("fv"), x["columns"].alias("columns"), F.transform(x["data"], record).alias("records"), labels.alias("labels"), fields.alias("fields"))

    def with_role(x: Column) -> Column:
        has = lambda pool, a: F.arrays_overlap(a, F.array(*map(F.lit, pool)))
        result = F.size(F.array_except(F.array(*map(F.lit, RESULT_COLUMNS)), x["labels"])) == 0
        role = F.when(result, "results_table").when(x["fv"] & has(PATIENT_FIELDS, x["fields"]), "patient_info_table").when(x["fv"] & has(REPORT_FIELDS, x["fields"]), "report_info_table").otherwise("unknown")
        return F.struct(x["columns"].alias("columns"), x["records"].alias("records"), role.alias("table_role"))

    cleaned = F.transform(cells, lambda r: F.transform(r, clean_cell))
    rows = F.array_distinct(F.filter(cleaned, lambda r: F.exists(r, lambda c: c != "")))
    return let(let(let(let(rows, shaped), named), recorded), with_role)


def normalized(tables: DataFrame) -> DataFrame:
    """Adds columns (names), records (maps), table_role, is_indexable to doc_id, table_id, cells: blank and repeated rows go, field/value tables are told apart."""
    found = rel.worked_out(tables, "_n", _normal(F.col("cells")))
    return found.select("*", "_n.columns", "_n.records", "_n.table_role", (F.col("_n.table_role") == "results_table").alias("is_indexable")).drop("_n")


def fingerprint(role: Column, columns: Column, records: Column) -> Column:
    """One value for tables of one role, columns and set of records, however they are written."""
    entries = F.array_sort(F.transform(records, lambda r: F.array_join(F.array_sort(F.transform(F.map_entries(r), lambda e: F.concat_ws("=", text.label(e["key"]), text.label(e["value"])))), "|")))
    return F.sha2(F.concat_ws("#", role, F.array_join(columns, "|"), F.array_join(entries, "#")).cast("binary"), 256)


def deduplicated(tables: DataFrame) -> DataFrame:
    """The first table of each fingerprint in a document (by table_no)."""
    keyed = tables.withColumn("_f", fingerprint(F.col("table_role"), F.col("columns"), F.col("records")))
    return rel.keep_first(keyed, ["doc_id", "_f"], ["table_no"]).drop("_f")


def deduplicated_rows(rows: DataFrame) -> DataFrame:
    """rows(doc_id, table_no, row_no, analyte, value, unit): the first row of each result over all results tables of a document."""
    keyed = rows.withColumn("_k", F.struct(text.label(F.col("analyte")), text.inline(F.col("value")), F.coalesce(parse.normalize_unit(F.col("unit")), F.lit(""))))
    return rel.keep_first(keyed, ["doc_id", "_k"], ["table_no", "row_no"]).drop("_k")


def key_values(tables: DataFrame) -> DataFrame:
    """doc_id, table_id, fields: a field/value table as a map, known fields normalised; of repeated fields the last counts."""
    pairs = tables.select("doc_id", "table_id", F.posexplode("records").alias("i", "r")).select("doc_id", "table_id", "i", shown_name(F.try_element_at("r", F.lit("Field"))).alias("field"), F.try_element_at("r", F.lit("Value")).alias("value"))
    rule = parse.look_up(NORMALIZED, F.col("field"))
    value = F.when(rule.isNotNull(), identity.named_by_rule(NORMALIZED.values(), rule, F.col("value"))["canonical"]).otherwise(F.col("value"))
    return rel.pairs_to_map(pairs.withColumn("value", value).where("field is not null"), ["doc_id", "table_id"], "field", "value", "i")


def as_text(columns: Column, records: Column) -> Column:
    """Field/value tables as 'field: value' lines, others as 'column: value | ...' per record; empty cells left out."""
    pair = lambda r: F.concat_ws(": ", F.try_element_at(r, F.lit("Field")), F.try_element_at(r, F.lit("Value")))
    cells = lambda r: F.array_join(F.filter(F.transform(columns, lambda c: F.when(F.try_element_at(r, c) != "", F.concat(c, F.lit(": "), F.try_element_at(r, c)))), lambda x: x.isNotNull()), " | ")
    return F.array_join(F.transform(records, lambda r: F.when(F.array_contains(columns, "Field"), pair(r)).otherwise(cells(r))), "\n")


def with_fallback_source(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Tables of the second detector only for documents in which the first found none."""
    return primary.unionByName(fallback.join(primary.select("doc_id").distinct(), "doc_id", "left_anti"), allowMissingColumns=True)
