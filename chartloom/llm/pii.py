"""Format-preserving pseudonyms for personal data, in DataFrame functions alone.

Values are found by pattern and validated (Luhn check digit, IBAN remainder, IPv4 octets, calendar dates).  Their
symbols are permuted by a keyed Feistel network over mixed radices: a digit becomes a digit, a letter a letter of its case,
an octet an octet, a date a date, and check digits are worked out anew.  The permutation depends on the key, the kind and
the symbols alone, not on separators, so equal values get equal pseudonyms in all documents, however they are written.
Slashed dates are day first, or month first where that is the only reading; dates before 1900 or after 2099 stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.llm.shared import let

ROUNDS = 10
#: Put before and after valid cards and IBANs while a text is scanned; how it and the escape are written where a text has them.
MARK, ESCAPE = "\ufdd0", "\ufdd2"
_ESCAPED = {ESCAPE: ESCAPE + "\ufdd3", MARK: ESCAPE + "\ufdd4"}
#: Symbols of an IBAN by country; others may have any number from 15 to 34.
IBAN_SYMBOLS = {
    15: "NO", 16: "BE", 18: "DK FO FI GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL OM SO",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: The patterns, in the order in which they are tried at a place of the text.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+\ufdd0-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*\.[A-Za-z]{2,}+",
    "access_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?i:password|passwd|pwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_/+.=\ufdd0-]{8,}+",
    "iban": r"(?<=\ufdd0)[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}(?=\ufdd0)",
    "date": r"(?<![A-Za-z0-9./-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![A-Za-z0-9/-]|\.\d)",
    "ipv4": r"(?<![A-Za-z0-9.])(?:\d{1,3}\.){3}\d{1,3}(?![A-Za-z0-9]|\.\d)",
    "french_phone": r"(?<![A-Za-z0-9.+-])0[1-9](?:[ .-]\d{2}){4}(?![A-Za-z0-9]|[ .-]\d)",
    "phone": r"(?<![A-Za-z0-9.+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![A-Za-z0-9]|[.-]\d)",
    "international": r"(?<![A-Za-z0-9.])\+\d{1,3}(?:[ .-]\d(?=[ .-]\d))?(?:\ufdd0?[ .-]?\ufdd0?\d{2,4}){2,5}(?![A-Za-z0-9]|[.-]\d)",
    "national_id": r"(?<![A-Za-z0-9.-])\d{3}-\d{2}-\d{4}(?![A-Za-z0-9]|[.-]\d)",
    "card": r"(?<=\ufdd0)\d(?:[ -]?\d){12,18}(?=\ufdd0)",
}
#: Where a card or an IBAN may start (no width); group 1: the most that it may be, and what follows.
_START = r"(?s)(?:(?<![A-Za-z0-9.+])(?=\d)|(?<![A-Za-z0-9])(?=[A-Z]{2}\d))(?=((?:\d(?:[ -]?\d){12,18}|[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}).{0,2}))"
#: 1900-01-01 to 2099-12-31 are 17 * 4297 days.
_FIRST_DAY, _DAY_RADICES = "1900-01-01", (17, 4297)
_DATE_FORMATS = {r"^\d{4}-": "yyyy-MM-dd", r"^\d{2}/": "dd/MM/yyyy", r"^\d{2}\.": "dd.MM.yyyy"}
#: Slashed dates that are none with the day first.
_MONTH_FIRST = "MM/dd/yyyy"


def permuted(values: Column, radices: Column, key: str, kind: str) -> Column:
    """Keyed permutation of ``values`` (array<int>), each below its radix: a Feistel network of ``ROUNDS`` rounds.

    Each round adds to one half a SHA-256 stream of the key, the round, the place and the other half, modulo the radices.
    """
    def halves(given: Column) -> Column:
        half = (F.size(given["v"]) / 2).cast("int")
        rest = F.size(given["v"]) - half
        return F.struct(
            F.slice(given["v"], 1, half).alias("a"), F.slice(given["r"], 1, half).alias("ra"), F.slice(given["v"], half + 1, rest).alias("b"), F.slice(given["r"], half + 1, rest).alias("rb")
        )

    def round_(acc: Column, i: Column) -> Column:
        def added(other: Column) -> Column:
            def moved(x: Column, place: Column) -> Column:
                stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), place.cast("string"), other).cast("binary"), 256)
                return F.pmod(x + F.conv(F.substring(stream, 1, 12), 16, 10).cast("bigint"), F.element_at(acc["ra"], place + 1)).cast("int")

            return F.transform(acc["a"], moved)

        joined = F.array_join(acc["b"].cast("array<string>"), ",")
        # a long half is hashed once a round, not once a symbol
        moved = let(let(joined, lambda x: F.when(F.length(x) > 1024, F.sha2(x.cast("binary"), 256)).otherwise(x)), added)
        return F.struct(acc["b"].alias("a"), acc["rb"].alias("ra"), moved.alias("b"), acc["ra"].alias("rb"))

    start = let(F.struct(values.alias("v"), radices.alias("r")), halves)
    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, round_)
    return let(end, lambda e: F.concat(e["a"], e["b"]))


def _characters(value: Column) -> Column:
    return F.filter(F.split(value, ""), lambda c: c != "")


def _symbols(value: Column) -> Column:
    return F.filter(_characters(value), lambda c: c.rlike("[A-Za-z0-9]"))


def _base(c: Column) -> Column:
    return F.when(c.rlike("[0-9]"), 48).when(c.rlike("[a-z]"), 97).otherwise(65)


def _permuted_symbols(symbols: Column, key: str, kind: str) -> Column:
    """Letters and digits (an array, worked out before) to letters and digits of the same class."""
    values = F.transform(symbols, lambda c: F.ascii(c) - _base(c))
    radices = F.transform(symbols, lambda c: F.when(c.rlike("[0-9]"), 10).otherwise(26))
    return F.zip_with(symbols, permuted(values, radices, key, kind), lambda c, v: F.char((_base(c) + v).cast("bigint")))


def _refilled(value: Column, symbols: Column) -> Column:
    """``value`` with its letters and digits, in turn, replaced by ``symbols``."""

    def put(acc: Column, c: Column) -> Column:
        here = c.rlike("[A-Za-z0-9]")
        return F.struct((acc["i"] + F.when(here, 1).otherwise(0)).alias("i"), F.concat(acc["out"], F.when(here, F.try_element_at(acc["s"], acc["i"])).otherwise(c)).alias("out"), acc["s"].alias("s"))

    start = F.struct(F.lit(1).alias("i"), F.lit("").alias("out"), symbols.alias("s"))
    return F.aggregate(_characters(value), start, put)["out"]


def _general(value: Column, key: str, kind: str) -> Column:
    return _refilled(value, let(_symbols(value), lambda symbols: _permuted_symbols(symbols, key, kind)))


def _after(value: Column, prefix: str, key: str, kind: str) -> Column:
    """Everything after a prefix (a pattern) is permuted."""
    head = F.regexp_extract(value, prefix, 0)
    return F.concat(head, _general(F.substr(value, F.length(head) + 1), key, kind))


def _email(value: Column, key: str) -> Column:
    return F.concat(_general(F.substring_index(value, "@", 1), key, "email"), F.lit("@"), F.substring_index(value, "@", -1))


def _luhn_sum(digits: Column, odd: int) -> Column:
    """Luhn sum of an array of digit strings; doubled are those whose distance from the end has remainder 1 - ``odd``."""

    def worth(d: Column, i: Column) -> Column:
        twice = d.cast("int") * 2
        doubled = F.pmod(F.size(digits) - 1 - i + F.lit(odd), F.lit(2)) == 1
        return F.when(doubled, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d.cast("int"))

    return F.aggregate(F.transform(digits, worth), F.lit(0), lambda total, x: total + x)


def _is_card(value: Column) -> Column:
    return let(_symbols(value), lambda digits: _luhn_sum(digits, 0) % 10 == 0)


def _card(value: Column, key: str) -> Column:
    def whole(body: Column) -> Column:
        return F.concat(body, F.array(F.pmod(-_luhn_sum(body, 1), F.lit(10)).cast("string")))

    def renewed(symbols: Column) -> Column:
        body = let(F.slice(symbols, 1, F.size(symbols) - 1), lambda digits: _permuted_symbols(digits, key, "card"))
        return let(body, whole)

    return _refilled(value, let(_symbols(value), renewed))


def _iban_rest(symbols: Column) -> Column:
    """Remainder modulo 97 of the account and then its country and check digits, letters counting from 10."""
    turned = F.concat(F.slice(symbols, 5, F.size(symbols) - 4), F.slice(symbols, 1, 4))

    def fold(rest: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        return F.when(digit, (rest * 10 + F.ascii(c) - 48) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(turned, F.lit(0), fold)


def _iban(value: Column, key: str) -> Column:
    def whole(parts: Column) -> Column:
        check = F.lpad((98 - _iban_rest(F.concat(parts["country"], F.array(F.lit("0"), F.lit("0")), parts["account"]))).cast("string"), 2, "0")
        return F.concat(parts["country"], _characters(check), parts["account"])

    def renewed(symbols: Column) -> Column:
        account = let(F.slice(symbols, 5, F.size(symbols) - 4), lambda own: _permuted_symbols(own, key, "iban"))
        return let(F.struct(F.slice(symbols, 1, 2).alias("country"), account.alias("account")), whole)

    return _refilled(value, let(_symbols(value), renewed))


def _is_iban(value: Column) -> Column:
    def valid(symbols: Column) -> Column:
        country, fits = F.array_join(F.slice(symbols, 1, 2), ""), F.lit(True)
        for size, countries in IBAN_SYMBOLS.items():
            fits = F.when(country.isin(countries.split()), F.size(symbols) == size).otherwise(fits)
        return fits & (_iban_rest(symbols) == 1)

    return let(_symbols(value), valid)


def _longest_valid(given: Column) -> Column:
    """The longest prefix, ending where a symbol ends, that is a valid card or IBAN; else an empty text."""
    cards = [F.regexp_extract(given, rf"(?s)^(\d(?:[ -]?\d){{{n - 1}}})(?![A-Za-z0-9]|[.-]\d)", 1) for n in range(19, 12, -1)]
    ibans = [F.regexp_extract(given, rf"(?s)^([A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]){{{n - 4}}})(?![A-Za-z0-9])", 1) for n in range(34, 14, -1)]
    card = F.filter(F.array(*cards), lambda x: (x != "") & _is_card(x))
    iban = F.filter(F.array(*ibans), lambda x: (x != "") & _is_iban(x))
    return F.coalesce(F.try_element_at(F.when(given.rlike("^[0-9]"), card).otherwise(iban), F.lit(1)), F.lit(""))


def _marked(text: Column) -> Column:
    """``text`` with marks around its valid cards and IBANs, from the left; what is not one of them is free for the other patterns."""
    heads = F.transform(F.regexp_extract_all(text, F.lit(_START), F.lit(1)), _longest_valid)
    parts = F.split(text, _START, -1)  # each but the first starts where a head does; the first also where the text starts with one
    pairs = let(F.struct(parts.alias("p"), heads.alias("h")), lambda x: F.arrays_zip(x["p"].alias("p"), F.concat(F.array_repeat(F.lit(""), F.size(x["p"]) - F.size(x["h"])), x["h"]).alias("h")))

    def walk(acc: Column, x: Column) -> Column:
        part, inside = x["p"], acc["left"] > 0
        left = F.when(inside, acc["left"]).otherwise(F.length(x["h"]))
        opened = F.when(~inside & (left > 0), F.lit(MARK)).otherwise(F.lit(""))
        ends = (left > 0) & (F.length(part) >= left)
        closed = F.concat(F.substr(part, F.lit(1), left), F.lit(MARK), F.substr(part, left + 1))
        rest = F.when(ends | (left == 0), F.lit(0)).otherwise(left - F.length(part))
        return F.struct(F.concat(acc["out"], opened, F.when(ends, closed).otherwise(part)).alias("out"), rest.alias("left"))

    return F.aggregate(pairs, F.struct(F.lit("").alias("out"), F.lit(0).alias("left")), walk)["out"]


def _octets(value: Column) -> Column:
    return F.transform(F.split(value, r"\."), lambda x: x.cast("int"))


def _ipv4(value: Column, key: str) -> Column:
    return F.array_join(permuted(_octets(value), F.array_repeat(F.lit(256), 4), key, "ipv4").cast("array<string>"), ".")


def _as_date(value: Column) -> Column:
    out = F.lit(None).cast("date")
    for shape, pattern in _DATE_FORMATS.items():
        out = F.when(value.rlike(shape), F.try_to_date(value, pattern)).otherwise(out)
    return F.coalesce(out, F.when(value.rlike("/"), F.try_to_date(value, _MONTH_FIRST)))


def _is_date(value: Column) -> Column:
    return F.coalesce(_as_date(value).between(F.lit(_FIRST_DAY).cast("date"), F.lit("2099-12-31").cast("date")), F.lit(False))


def _date(value: Column, key: str) -> Column:
    day = F.datediff(_as_date(value), F.lit(_FIRST_DAY).cast("date"))
    high, low = _DAY_RADICES
    parts = F.array((day / low).cast("int"), F.pmod(day, F.lit(low)))
    moved = permuted(parts, F.array(F.lit(high), F.lit(low)), key, "date")
    new = let(moved, lambda m: F.date_add(F.lit(_FIRST_DAY).cast("date"), F.element_at(m, 1) * low + F.element_at(m, 2)))
    out = F.lit(None).cast("string")
    for shape, pattern in _DATE_FORMATS.items():
        out = F.when(value.rlike(shape), F.date_format(new, pattern)).otherwise(out)
    month_first = value.rlike("/") & F.try_to_date(value, _DATE_FORMATS[r"^\d{2}/"]).isNull()
    return F.when(month_first, F.date_format(new, _MONTH_FIRST)).otherwise(out)


def _whole(kind: str) -> str:
    """The pattern for a value on its own."""
    return "^(?:" + PATTERNS[kind].replace(r"(?<=\ufdd0)", "").replace(r"(?=\ufdd0)", "") + ")$"


def pseudonym(value: Column, key: str) -> Column:
    """Pseudonym of one found value; the value itself where it is not valid as any kind."""
    is_ = lambda kind: value.rlike(_whole(kind))
    out = F.when(value.contains("@"), _email(value, key))
    out = out.when(is_("access_key"), _after(value, "^.{4}", key, "access_key"))
    out = out.when(is_("secret"), _after(value, r"^[^=:]*[=:]\s*", key, "secret"))
    out = out.when(is_("iban"), F.when(_is_iban(value), _iban(value, key)).otherwise(value))
    out = out.when(is_("date"), F.when(_is_date(value), _date(value, key)).otherwise(value))
    out = out.when(is_("ipv4"), F.when(F.forall(_octets(value), lambda x: x < 256), _ipv4(value, key)).otherwise(value))
    out = out.when(is_("phone") | is_("international") | is_("french_phone"), _after(value, r"^(?:\+\d{1,3})?", key, "phone"))
    out = out.when(is_("national_id"), _general(value, key, "national_id"))
    return out.when(is_("card"), F.when(_is_card(value), _card(value, key)).otherwise(value)).otherwise(value)


def with_pseudonyms(docs: DataFrame, key: str, text_column: str = "text", count_column: str | None = None) -> DataFrame:
    """``docs`` with pseudonyms in the text; with ``count_column``, also how many values were replaced (long).

    The key is the caller's secret.  Texts without a digit, ``@``, ``=``, ``:`` or the beginning of an access key, null and empty texts included, pass through unread by the patterns; texts may have any length.  Of overlapping
    candidates the leftmost wins, then the first of ``PATTERNS``, then the longest valid card or IBAN.  Dates outside 1900 to 2099, dates with one-digit days or months or with month names,
    and domains of e-mail addresses stay.  Rows are independent, whatever their other columns are called: repeated rows repeat their result, an empty table gives an empty one.
    A column named ``count_column`` is replaced.
    """
    anything = "(?<![A-Za-z0-9])(?:" + "|".join(PATTERNS.values()) + ")"  # values start where no word goes on: one look at most places
    found = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[text_column].alias("original"))
    original = F.col("original")
    suspect = F.coalesce(original.rlike("[0-9@=:]|AKIA|ASIA"), F.lit(False))
    escaped = original
    for plain, written in _ESCAPED.items():
        escaped = F.replace(escaped, F.lit(plain), F.lit(written))
    found = found.withColumn("text", F.when(suspect & original.rlike(_START), _marked(escaped)).otherwise(escaped))
    text = F.col("text")
    found = found.withColumn("found", F.when(suspect, F.regexp_extract_all(text, F.lit(anything), F.lit(0))).otherwise(F.array().cast("array<string>")))
    found = found.withColumn("found", F.transform("found", lambda value: F.replace(value, F.lit(MARK), F.lit(""))))
    found = found.withColumn("new", F.transform("found", lambda value: pseudonym(value, key)))
    between = F.split(text, anything, -1)
    woven = F.array_join(F.flatten(F.zip_with(between, F.concat("new", F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")
    woven = F.replace(woven, F.lit(MARK), F.lit(""))
    for plain, written in reversed(_ESCAPED.items()):
        woven = F.replace(woven, F.lit(written), F.lit(plain))
    new_text = F.when(F.size("found") > 0, woven).otherwise(original)
    columns = [new_text.alias(text_column) if c == text_column else F.col("row")[c].alias(c) for c in docs.columns if c != count_column]
    if count_column:
        changed = F.size(F.filter(F.arrays_zip("found", "new"), lambda x: x["found"] != x["new"])).cast("long")
        columns.append(changed.alias(count_column))
    return found.select(*columns)
