"""Numbers, dates, ranges, flags and units out of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chartloom import dims
from chartloom.functions import text
from chartloom.functions.text import let

NUMBER = r"-?\d+(?:\.\d+)?"


def literal_map(entries: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in entries.items() for x in pair))


def look_up(entries: dict, key: Column) -> Column:
    """Value of a key in a fixed dictionary, else null."""
    return F.try_element_at(literal_map(entries), key)


def _some(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def parse_int(value: Column) -> Column:
    return _some(F.regexp_extract(text.inline(value), r"-?\d+", 0)).try_cast("bigint")


def _dotted(value: Column) -> Column:
    return F.translate(text.inline(value), ",", ".")


def parse_float(value: Column) -> Column:
    return _some(F.regexp_extract(_dotted(value), NUMBER, 0)).try_cast("double")


def safe_float(value: Column) -> Column:
    """The whole value as a number, else null."""
    return F.translate(text.strip(value), ",", ".").try_cast("double")


def _iso(year: Column, month: Column, day: Column) -> Column:
    joined = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.date_format(F.try_to_date(joined, "yyyy-MM-dd"), "yyyy-MM-dd")


def parse_iso_date(value: Column) -> Column:
    """ISO string of a date written as ISO (not range-checked), day/month/year, or day, French month name, year; else null."""
    numeric, named = r"\b(\d{1,2})[/-](\d{1,2})[/-](\d{4})\b", r"(\d{1,2})\s+([a-z]+)\s+(\d{4})"

    def spelled(plain: Column) -> Column:
        word = lambda i: F.regexp_extract(plain, named, i)
        return _iso(word(3), look_up(dims.FRENCH_MONTHS, word(2)).cast("string"), word(1))

    def dated(raw: Column) -> Column:
        part = lambda i: F.regexp_extract(raw, numeric, i)
        other = let(F.replace(text.without_accents(raw), F.lit("."), F.lit("")), spelled)
        return F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}$"), raw).when(raw.rlike(numeric), _iso(part(3), part(2), part(1))).otherwise(other)

    return let(F.btrim(F.lower(text.inline(value)), F.lit(". ")), dated)


def parse_datetime(value: Column) -> Column:
    """ISO string of 'd/m/Y H:M[:S]', else of a date alone, else null."""
    pattern = r"(\d{1,2})[/-](\d{1,2})[/-](\d{4})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?"

    def timed(one: Column) -> Column:
        part = lambda i: F.lpad(F.coalesce(_some(F.regexp_extract(one, pattern, i)), F.lit("0")), 2, "0")
        joined = F.concat(F.regexp_extract(one, pattern, 3), F.lit("-"), part(2), F.lit("-"), part(1), F.lit(" "), part(4), F.lit(":"), part(5), F.lit(":"), part(6))
        full = F.date_format(F.try_to_timestamp(joined, F.lit("yyyy-MM-dd HH:mm:ss")), "yyyy-MM-dd'T'HH:mm:ss")
        return F.when(one.rlike(pattern), full).otherwise(parse_iso_date(one))

    return let(text.inline(value), timed)


def calendar_age(birth: Column, at: Column) -> Column:
    """Whole years between two ISO strings by month and day; null if either is no date or the order is wrong."""
    born, day = F.try_to_date(F.substring(birth, 1, 10), "yyyy-MM-dd"), F.try_to_date(F.substring(at, 1, 10), "yyyy-MM-dd")
    before = (F.month(day) * 100 + F.dayofmonth(day)) < (F.month(born) * 100 + F.dayofmonth(born))
    age = F.year(day) - F.year(born) - before.cast("int")
    return F.when(age >= 0, age)


def age_in_days(birth: Column, at: Column) -> Column:
    """Days over 365.25, rounded down, at least 0, as a string; '-' if a date is missing."""
    years = F.greatest(F.lit(0), (F.datediff(at, birth) / 365.25).cast("int")).cast("string")
    return F.coalesce(years, F.lit("-"))


def age_status(reported: Column, computed: Column) -> Column:
    near = F.abs(reported - computed) <= 1
    return F.when(near, "consistent").when(~near, "inconsistent_with_birth_date").otherwise("unknown")


def reference_range(value: Column) -> Column:
    """struct(text, low, high): the first 'a - b', else the first two signed numbers."""
    pair = rf"({NUMBER})\s*-\s*({NUMBER})"

    def ranged(shown: Column) -> Column:
        def bounds(dotted: Column) -> Column:
            number = lambda i: _some(F.regexp_extract(dotted, pair, i)).try_cast("double")
            loose = lambda i: F.get(F.regexp_extract_all(dotted, F.lit(NUMBER), F.lit(0)), F.lit(i)).try_cast("double")
            is_pair = dotted.rlike(pair)
            return F.struct(_some(shown).alias("text"), F.when(is_pair, number(1)).otherwise(loose(0)).alias("low"), F.when(is_pair, number(2)).otherwise(loose(1)).alias("high"))

        return let(F.translate(shown, ",", "."), bounds)

    return let(text.inline(F.coalesce(value, F.lit(""))), ranged)


def simple_reference_range(value: Column) -> Column:
    """struct(text, low, high): '< x' bounds above, '> x' below, two numbers with a connector bound both."""

    def ranged(shown: Column) -> Column:
        def bounds(x: Column) -> Column:
            dotted, numbers = x["dotted"], x["numbers"]
            first, second = F.get(numbers, F.lit(0)).try_cast("double"), F.get(numbers, F.lit(1)).try_cast("double")
            below, above = dotted.rlike(r"^\(?\s*<"), dotted.rlike(r"^\(?\s*>")
            both = (F.size(numbers) == 2) & dotted.rlike(r"(?iu)\d\s*(?:-|à|a)\s*\d")
            low = F.when(above, first).when(both & ~below, first)
            high = F.when(below, first).when(both & ~above, second)
            return F.struct(_some(shown).alias("text"), low.alias("low"), high.alias("high"))

        dotted = F.translate(shown, ",", ".")
        return let(F.struct(dotted.alias("dotted"), F.regexp_extract_all(dotted, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)).alias("numbers")), bounds)

    return let(text.inline(F.coalesce(value, F.lit(""))), ranged)


def infer_flag(value: Column, low: Column, high: Column) -> Column:
    """'L' below, 'H' above, else null (bounds included; a null bound never flags)."""
    return F.when(value < low, "L").when(value > high, "H")


def normalize_flag(value: Column) -> Column:
    # What stands for no flag.
    return let(F.upper(text.inline(value)), lambda flag: F.when(flag.isin("", "-", "N", "NAN", "NONE", "NULL", ":", ";", "."), None).otherwise(flag))


def normalize_unit(value: Column) -> Column:
    """Unit without spaces and with misreadings repaired; null for nothing."""
    return let(F.replace(text.inline(value), F.lit(" "), F.lit("")), lambda unit: _some(F.coalesce(look_up(dims.UNIT_REPAIRS, unit), unit)))


def is_known_unit(value: Column) -> Column:
    return F.coalesce(normalize_unit(value).isin(*dims.KNOWN_UNITS), F.lit(False))


def format_repaired(value: Column) -> Column:
    """Whole numbers without decimals, others with two at most."""
    whole = value == F.floor(value)
    trimmed = F.regexp_replace(F.format_string("%.2f", F.bround(value, 2)), r"\.?0+$", "")
    return F.when(whole, value.cast("bigint").cast("string")).when(value.isNotNull(), trimmed)


def repair_numeric(raw: Column, low: Column, high: Column, flag: Column | None = None) -> Column:
    """struct(value_raw, value_numeric): a number that lost its decimal point gets it back if the range (or flag) clearly says so.

    Candidates are the number, a tenth and a hundredth.  Each scores 6 in range, else 4 where it agrees with the flag, else 2
    within a fifth of the range; less its distance from the range in spans, and 1 for no change.  The first best wins, and only with 3 or more.
    """
    flag = F.lit(None).cast("string") if flag is None else flag
    shown = text.inline(F.coalesce(raw, F.lit("")))

    def repaired(given: Column) -> Column:
        number, low, high, flag = (given[k] for k in ("number", "low", "high", "flag"))

        def scored(power: Column) -> Column:
            x = number / F.pow(F.lit(10.0), power)
            points = F.when(x.between(low, high), 6.0).when((flag == "H") & (x > high), 4.0).when((flag == "L") & (x < low), 4.0).when(x.between(low * 0.8, high * 1.2), 2.0).otherwise(0.0)
            distance = F.greatest(low - x, x - high, F.lit(0.0)) / F.greatest(high - low, F.lit(1.0))
            return F.struct((points - distance - F.when(power == 0, 1.0).otherwise(0.0)).alias("score"), (-power).alias("order"), x.alias("value"))

        suspect = number.isNotNull() & low.isNotNull() & high.isNotNull() & (high >= low) & ~given["shown"].rlike("[.,]") & (number > high)
        best = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(2)), scored))
        better = F.when(suspect, text.let(best, lambda b: F.when((b["order"] < 0) & (b["score"] >= 3.0), b["value"])))
        return text.let(better, lambda x: F.struct(F.coalesce(format_repaired(x), _some(given["shown"])).alias("value_raw"), F.coalesce(x, number).alias("value_numeric"), x.isNotNull().alias("repaired")))

    return text.let(F.struct(shown.alias("shown"), parse_float(shown).alias("number"), low.alias("low"), high.alias("high"), flag.alias("flag")), repaired)


def parse_result_line(line: Column) -> Column:
    """struct of a results line 'analyte value unit low - high [flag] [date]'; its analyte is null where the line is none."""
    number = r"-?\d+(?:[.,]\d+)?"
    pattern = rf"^(.+?)\s+({number})\s+(\S+)\s+({number}\s*-\s*{number})\s+(?:([HLN-])\s*)?(.*)$"
    part = lambda i: _some(text.inline(F.regexp_extract(line, pattern, i)))
    return F.struct(part(1).alias("analyte"), part(2).alias("value_raw"), normalize_unit(part(3)).alias("unit"), part(4).alias("reference"), parse_iso_date(part(6)).alias("observation_date"))
