"""Text normalisation."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from chartloom import dims

_SPACE = r"(?U)[\s\x1c-\x1f]"
#: A text of visible ASCII and Latin characters with single spaces between its words, or nothing: cleaning leaves it as it is.
_PLAIN = r"\A(?:[!-~\xa1-\u024f]++(?: [!-~\xa1-\u024f]++)*+)?\z"


def _accent_table() -> tuple[str, str, dict[str, str]]:
    """(characters, their ASCII letter or digit, characters that become several) by Unicode decomposition."""
    single, base, several = [], [], {}
    for code in (*range(0x80, 0x2000), *range(0x2070, 0x2190), *range(0xFB00, 0xFB07)):
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.combining(x))
        if len(plain) == 1 and plain != c and plain.isascii():
            single.append(c)
            base.append(plain)
        elif len(plain) > 1 and plain.isascii() and plain.isalnum():
            several[c] = plain
    return "".join(single), "".join(base), several


_FROM, _TO, _SEVERAL = _accent_table()


def let(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once, however often ``then`` uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def strip(value: Column) -> Column:
    """Without white space of any script at both ends; only a text that begins or ends with some is searched for it."""
    edges = lambda x: F.concat(F.left(x, F.lit(1)), F.right(x, F.lit(1)))
    return let(value, lambda x: F.when(edges(x).rlike(_SPACE), F.regexp_replace(x, f"^{_SPACE}+|{_SPACE}+$", "")).otherwise(x))


def clean_text(value: Column) -> Column:
    """NUL to space, line ends to LF, runs of spaces and tabs to one space, at most one blank line, stripped."""
    value = F.regexp_replace(F.translate(value, "\0", " "), r"\r\n?", "\n")
    value = F.regexp_replace(value, r"[ \t]+", " ")
    return strip(F.regexp_replace(value, r"\n{3,}", "\n\n"))


def inline(value: Column) -> Column:
    """Cleaned text on one line; spaces that this brings together stay.  Cleaned text ends with no line feed, so nothing is left to strip.

    Most values are clean, which one pattern tells; only the others go through all steps.
    """
    return let(value, lambda x: F.when(x.rlike(_PLAIN), x).otherwise(F.translate(clean_text(x), "\n", " ")))


def without_accents(value: Column) -> Column:
    """Letters and digits of compatibility forms as ASCII, combining marks dropped; ASCII passes through untouched."""

    def plain(x: Column) -> Column:
        out = x
        for c in "ﬁﬂ":
            out = F.replace(out, F.lit(c), F.lit(_SEVERAL[c]))
        return F.when(F.length(x) == F.octet_length(x), x).otherwise(F.regexp_replace(F.translate(out, _FROM, _TO), r"\p{M}+", ""))

    return let(value, plain)


def key(line: Column) -> Column:
    joined = F.regexp_replace(without_accents(F.lower(line)), "[^a-z0-9]+", "_")
    return let(joined, lambda x: F.when(x.startswith("_") | x.endswith("_"), F.btrim(x, F.lit("_"))).otherwise(x))


def label(value: Column) -> Column:
    """The key by which texts are compared: lower case, no accents, every other run of characters one underscore.

    What cleaning a text changes (white space, line ends, NUL) is in those runs, so the text is not cleaned first.
    """
    return key(value)


def lines(value: Column) -> Column:
    """Lines that are not blank, each on one line, in order; the text is cleaned as a whole before it is cut."""
    return F.filter(F.transform(F.split(F.regexp_replace(F.translate(F.coalesce(value, F.lit("")), "\0", " "), r"[ \t]+", " "), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), strip), lambda x: x != "")


_FURNITURE = "|".join(dims.BOILERPLATE)


def is_boilerplate(value: Column) -> Column:
    """Whether a text names furniture of the page; a label has no more bytes than its text, so shorter ones than every name are not labelled."""
    return F.when(F.octet_length(value) < min(map(len, dims.BOILERPLATE)), False).otherwise(is_furniture_label(label(value)))


def is_furniture_label(key: Column) -> Column:
    return key.rlike(_FURNITURE)


def strip_page_boilerplate(value: Column) -> Column:
    """Text without blank lines, furniture lines and page numbers; null gives ''.

    A text whose label as a whole names no furniture has no such line, so lines are labelled only where it does.
    """
    numbered = lambda x: x.rlike(r"(?i)^page\s+\d+$")

    def kept(given: Column) -> Column:
        named = key(F.array_join(given, " ")).rlike(_FURNITURE)
        return F.array_join(F.when(named, F.filter(given, lambda x: ~key(x).rlike(_FURNITURE) & ~numbered(x))).otherwise(F.filter(given, lambda x: ~numbered(x))), "\n")

    return let(lines(value), kept)


def safe_stem(value: Column) -> Column:
    """File-name stem: other characters than letters, digits, '.', '_', '-' become '_'; 'document' if nothing is left."""
    stem = F.btrim(F.regexp_replace(value, r"[^A-Za-z0-9._-]+", "_"), F.lit("._-"))
    return F.coalesce(F.nullif(stem, F.lit("")), F.lit("document"))


def slugify(value: Column) -> Column:
    slug = F.btrim(F.regexp_replace(value, r"[^A-Za-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("patient"))


def page_name(number: Column) -> Column:
    return F.format_string("page_%03d", number)


def is_meaningful(value: Column, minimum: int = 30) -> Column:
    return F.length(clean_text(value)) >= minimum


def business_value(value: Column) -> Column:
    """One line, or null where nothing is left."""
    return F.nullif(inline(value), F.lit(""))


def ocr_analyte(value: Column) -> Column:
    """Name of an analyte without the usual misreadings."""
    # Misreadings and their repair.
    repairs = [(r"\(Moles/volume\]", "[Moles/volume]"), (r"\bPinema\b", "Plasma"), (r"\bP Plasma\b", "Plasma"), (r"\bJanv\b", ""), (r"\b(?:ae|ys|FANG|earns|seni)\b", ""), (r"^Automated count\s+", ""), (r"\bra\b$", "")]
    spaces = [(r"\s{2,}", " "), (r"\s+\]", "]"), (r"\[\s+", "["), (r"\s+([,/])", "$1")]

    def repaired(out: Column) -> Column:
        for pattern, repair in repairs:
            out = F.regexp_replace(out, f"(?iu){pattern}", repair)
        for pattern, repair in spaces:
            out = F.regexp_replace(out, pattern, repair)
        return out

    # a name in which nothing is to be repaired is looked at once
    some = "(?iu)" + "|".join(pattern for pattern, _ in repairs + spaces)
    return F.coalesce(F.btrim(let(inline(value), lambda x: F.when(x.rlike(some), repaired(x)).otherwise(x)), F.lit(" -:;,./")), F.lit(""))


def labelled_value(line: Column, pattern: str) -> Column:
    """What follows a label pattern on a line, without separators; null if the label is not there."""
    found = F.regexp_extract(line, f"(?iu)(?:{pattern})(.*)$", 1)
    return F.when(line.rlike(f"(?iu){pattern}"), inline(F.regexp_replace(found, r"^[ :;-]+", "")))


def dedupe_fragments(parts: Column) -> Column:
    """Greedy, in order: a fragment whose label equals, contains or is contained in that of a kept one is dropped."""

    def step(kept: Column, part: Column) -> Column:
        key = label(part)
        known = F.exists(kept, lambda k: (key == "") | label(k).contains(key) | key.contains(label(k)))
        return F.when(known | (key == ""), kept).otherwise(F.array_append(kept, part))

    return F.aggregate(parts, F.array().cast("array<string>"), step)


def find_labels(text: Column, names: list[str]) -> Column:
    """map label -> text up to the next label found (first occurrence of each, ignoring case)."""
    spots = F.array(*(F.struct(F.instr(F.lower(text), n.lower()).alias("at"), F.lit(n).alias("name")) for n in names))
    spots = F.array_sort(F.filter(spots, lambda s: s["at"] > 0))

    def entry(spot: Column, i: Column) -> Column:
        begin = spot["at"] + F.length(spot["name"])
        end = F.coalesce(F.get(spots, i + 1)["at"], F.length(text) + 1)
        return F.struct(spot["name"].alias("key"), inline(F.regexp_replace(F.substr(text, begin, F.greatest(F.lit(0), end - begin)), r"^[\s:;-]+", "")).alias("value"))

    return F.map_from_entries(F.transform(spots, entry))
