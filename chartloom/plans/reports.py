"""Report rows from relational patient exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chartloom.functions import parse, text
from chartloom.operators import relational as rel

# Descriptions that count as laboratory or vital measurements.
LAB_WORDS = [
    "glucose", "cholesterol", "hdl", "ldl", "triglyceride", "hemoglobin", "hematocrit", "platelet", "leukocyte", "white blood cell", "red blood cell", "creatinine", "potassium",
    "sodium", "calcium", "bilirubin", "albumin", "protein", "urea", "bun", "blood pressure", "heart rate", "oxygen saturation", "body mass index", "body weight", "body height", "respiratory rate",
]
# Words of a description, lower and upper bound; the first rule that applies counts.
RULES = [
    (("glucose",), "70", "99"), (("cholesterol",), "0", "200"), (("hdl",), "40", "80"), (("ldl",), "0", "100"), (("triglyceride",), "0", "150"), (("hemoglobin",), "12", "17.5"), (("hematocrit",), "36", "53"),
    (("platelet",), "150", "450"), (("white blood cell", "leukocyte"), "4", "11"), (("red blood cell",), "4.2", "6.1"), (("creatinine",), "0.6", "1.3"), (("potassium",), "3.5", "5.1"), (("sodium",), "135", "145"),
    (("calcium",), "8.5", "10.5"), (("albumin",), "3.5", "5.2"), (("bilirubin",), "0.1", "1.2"), (("oxygen saturation",), "95", "100"), (("heart rate",), "60", "100"), (("respiratory rate",), "12", "20"),
    (("body mass index",), "18.5", "24.9"), (("body weight",), "50", "100"), (("body height",), "150", "195"), (("systolic blood pressure",), "90", "120"), (("diastolic blood pressure",), "60", "80"),
]
PREFERRED, ROWS, CONDITIONS = 6, 12, 5


def infer_reference(description: Column, value: Column) -> Column:
    """struct(reference, flag): range of the first rule whose word the description contains and L, H or N; no rule: a remark and no flag."""
    named, number = F.lower(text.strip(description)), parse.safe_float(value)
    reference = flag = None
    for words, low, high in RULES:
        here = F.lit(False)
        for word in words:
            here = here | named.contains(word)
        judged = F.when(number.isNull(), "").when(number < float(low), "L").when(number > float(high), "H").otherwise("N")
        reference = F.when(here, f"{low} - {high}") if reference is None else reference.when(here, f"{low} - {high}")
        flag = F.when(here, judged) if flag is None else flag.when(here, judged)
    remark = F.when(number.isNull(), "See note").otherwise("Context dependent")
    return F.struct(reference.otherwise(remark).alias("reference"), flag.otherwise("").alias("flag"))


def format_result(value: Column) -> Column:
    """Whole and large numbers without decimals, from 10 with one, else two; trailing zeros dropped; text as it is, '-' for none."""
    number = parse.safe_float(value)
    trimmed = lambda places: F.regexp_replace(F.format_string(f"%.{places}f", F.bround(number, places)), r"(\.\d*?)0+$", "$1")
    bare = lambda c: F.regexp_replace(c, r"\.$", "")
    whole = (F.abs(number) >= 100) | (number == F.floor(number))
    shown = F.when(whole, F.bround(number, 0).cast("bigint").cast("string")).when(F.abs(number) >= 10, bare(trimmed(1))).otherwise(bare(trimmed(2)))
    return F.when(number.isNotNull(), shown).otherwise(F.coalesce(F.nullif(text.strip(value), F.lit("")), F.lit("-")))


def format_date(moment: Column) -> Column:
    return F.coalesce(F.date_format(moment, "dd MMM yyyy"), F.lit("-"))


def seed_from_text(value: Column) -> Column:
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, 8), 16, 10).cast("bigint")


def report_rows(observations: DataFrame) -> DataFrame:
    """observations(patient, row, description, value, units, date, type) to at most ``ROWS`` report rows per patient.

    Laboratory descriptions if the patient has ``PREFERRED`` of them, else all; newest first, one row per description;
    ``row`` breaks ties.
    """
    wanted = F.lower("description").rlike("|".join(LAB_WORDS))
    pool = rel.preferred_pool(observations.withColumn("at", F.try_to_timestamp("date")), ["patient"], wanted, PREFERRED)
    single = rel.latest(pool, ["patient", "description"], "at", "row")
    position = F.row_number().over(Window.partitionBy("patient").orderBy(F.col("at").desc_nulls_last(), "row"))
    rows = single.withColumn("position", position).where(F.col("position") <= ROWS).withColumn("r", infer_reference(F.col("description"), F.col("value")))
    default = lambda c, d: F.coalesce(F.nullif(text.strip(F.col(c)), F.lit("")), F.lit(d))
    flag = F.when(F.col("r.flag") == "N", "").otherwise(F.col("r.flag"))
    return rows.select(
        "patient", "position", default("description", "Observation").alias("description"), format_result(F.col("value")).alias("result"), default("units", "-").alias("units"), F.col("r.reference"), flag.alias("flag"), format_date(F.col("at")).alias("date"), default("type", "Observation").alias("kind")
    )


def trend(observations: DataFrame, least: int = 3, points: int = 8) -> DataFrame:
    """patient, description, position, at, number: the last points of the numeric description with most rows."""
    numeric = observations.withColumn("number", F.col("value").try_cast("double")).where("number is not null").withColumn("at", F.try_to_timestamp("date"))
    chosen = rel.modal(numeric, ["patient"], "description", least).select("patient", "description")
    series = numeric.join(chosen, ["patient", "description"])
    return rel.last_of_series(series, ["patient", "description"], "at", "row", points).select("patient", "description", "position", "at", "number", "units")


def conditions_of(conditions: DataFrame, n: int = CONDITIONS) -> DataFrame:
    """patient, names: up to ``n`` different conditions, newest first."""
    dated = conditions.withColumn("at", F.try_to_timestamp("start")).where(text.strip(F.col("description")) != "")
    newest = rel.latest(dated, ["patient", "description"], "at", "row")
    kept = rel.top_per_group(newest, ["patient"], [F.col("at").desc_nulls_last(), F.col("row")], n)
    ordered = F.array_sort(F.collect_list(F.struct((-F.unix_timestamp("at")).alias("t"), "row", "description")))
    return kept.groupBy("patient").agg(F.transform(ordered, lambda x: x["description"]).alias("names"))


def patient_context(patients: DataFrame, encounters: DataFrame, organizations: DataFrame, providers: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """patients(patient, ...) with the organisation and provider of the latest encounter(patient, row, start, organization, provider)."""
    last = rel.latest(encounters.withColumn("at", F.try_to_timestamp("start")), ["patient"], "at", "row").select("patient", "organization", "provider")
    joined = patients.join(last, "patient", "left")
    filled = lambda c: F.nullif(text.strip(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    address = F.nullif(F.concat_ws(", ", filled("address"), filled("city"), filled("state")), F.lit(""))
    places = organizations.select("id", filled("name").alias("facility_name"), address.alias("facility_address"), filled("phone").alias("facility_phone"))
    people = providers.select("id", filled("name").alias("provider_name"), filled("speciality").alias("provider_specialty"))
    pick = lambda names: {k: defaults.get(k, "-") for k in names}
    joined = rel.look_up(joined, places, [("organization", "id")], pick(["facility_name", "facility_address", "facility_phone"]))
    return rel.look_up(joined, people, [("provider", "id")], pick(["provider_name", "provider_specialty"]))


def choose_patients(patients: DataFrame, observations: DataFrame, n: int, patient: str | None = None) -> DataFrame:
    """The ``n`` patients with most observations (ties by id), or the one asked for."""
    if patient is not None:
        return patients.where(F.col("patient") == patient)
    top = observations.groupBy("patient").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "patient").limit(n)
    return patients.join(top, "patient", "left_semi")


def impression(rows: DataFrame, conditions: DataFrame) -> DataFrame:
    """patient, impression: up to four flagged rows in words (or a remark that none is), then up to three conditions."""
    said = F.concat("description", F.when(F.col("flag") == "H", " is elevated").otherwise(" is reduced"))
    flagged = rows.withColumn("s", F.when(F.col("flag").isin("H", "L"), F.struct("position", said.alias("said"))))
    per = flagged.groupBy("patient").agg(F.array_sort(F.collect_list("s")).alias("s"))
    words = F.array_join(F.transform(F.slice("s", 1, 4), lambda x: x["said"]), "; ")
    base = F.when(F.size("s") > 0, F.concat(F.lit("Review of the most recent measurements indicates that "), words, F.lit("."))).otherwise("No measurement is outside its reference interval.")
    problems = F.concat(F.lit(" Documented background problems include "), F.array_join(F.slice("names", 1, 3), ", "), F.lit("."))
    joined = per.join(conditions, "patient", "left")
    return joined.select("patient", F.concat(base, F.when(F.size("names") > 0, problems).otherwise("")).alias("impression"))
