"""Identifiers and coded fields."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from chartloom import dims
from chartloom.functions import parse, text
from chartloom.functions.text import let

UUID = r"^[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}$"
_LENGTHS = (8, 4, 4, 4, 12)


def canonical_uuid(value: Column) -> Column:
    """UUID with misread letters repaired where its five parts can be made whole, else the cleaned text; null for nothing.

    Letters o, i, l stand for 0, 1, 1.  A part that is too long keeps its end if it is the first, else its beginning;
    parts beyond the fifth belong to the fifth.
    """
    cut = lambda p, i, n: F.when(i == 0, F.right(p, F.lit(n))).otherwise(F.left(p, F.lit(n)))

    def clipped(p: Column, i: Column) -> Column:
        out = p
        for k, n in enumerate(_LENGTHS):
            out = F.when(i == k, cut(p, i, n)).otherwise(out)
        return out

    def repaired(cleaned: Column) -> Column:
        def joined(whole: Column) -> Column:
            last = F.left(F.array_join(F.slice(whole, 5, F.greatest(F.size(whole) - 4, F.lit(1))), ""), F.lit(12))
            five = F.concat_ws("-", *(F.get(whole, F.lit(k)) for k in range(4)), last)
            complete = lambda x: (F.size(whole) >= 5) & x.rlike(r"^[a-z0-9]{8}(-[a-z0-9]{4}){3}-[a-z0-9]{12}$")
            return let(five, lambda x: F.when(complete(x), x).otherwise(F.btrim(F.regexp_replace(cleaned, "-+", "-"), F.lit("-"))))

        parts = F.filter(F.split(cleaned, "-"), lambda p: p != "")
        return let(F.transform(F.transform(parts, lambda p: F.translate(p, "oil", "011")), clipped), joined)

    return F.nullif(let(F.regexp_replace(F.lower(text.inline(value)), "[^a-z0-9-]", ""), repaired), F.lit(""))


def is_uuid(value: Column) -> Column:
    return F.coalesce(value.rlike(UUID), F.lit(False))


def is_patient_identifier(value: Column) -> Column:
    return F.coalesce(value.rlike(UUID) | value.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,63}$"), F.lit(False))


def report_id(value: Column) -> Column:
    return F.nullif(F.regexp_replace(F.upper(text.inline(value)), "[^A-Z0-9-]", ""), F.lit(""))


def sex(value: Column) -> Column:
    return parse.look_up(dims.SEXES, text.label(value))


def encounter_type(value: Column) -> Column:
    return parse.look_up(dims.ENCOUNTERS, text.label(value))


def specialty(value: Column) -> Column:
    return F.nullif(F.upper(text.strip(F.regexp_replace(text.inline(value), r"(?U)\s+", " "))), F.lit(""))


_NORMALIZERS = {
    "patient_id": lambda v: let(canonical_uuid(v), lambda x: F.when(is_uuid(x), x)),
    "birth_date": parse.parse_iso_date,
    "report_date": parse.parse_iso_date,
    "observation_date": parse.parse_iso_date,
    "report_id": report_id,
    "unit": parse.normalize_unit,
    "sex": sex,
    "encounter_type": encounter_type,
    "specialty": specialty,
}


def _judged(raw: Column, candidate: Column) -> Column:
    def status(found: Column) -> Column:
        canonical = F.coalesce(found, raw)
        said = F.when(raw.isNull(), "missing").when(found.isNull(), "needs_review").when(canonical == raw, "as_extracted").otherwise("canonicalized")
        return F.struct(raw.alias("raw"), canonical.alias("canonical"), said.alias("normalization_status"))

    return let(candidate, status)


def named_field(name: str, value: Column) -> Column:
    """struct(raw, canonical, normalization_status) by the rule of the field's name; a value that fails its rule stays as it is."""
    return let(text.business_value(value), lambda raw: _judged(raw, _NORMALIZERS[name](raw) if name in _NORMALIZERS else raw))


def named_by_rule(rules: Iterable[str], rule: Column, value: Column) -> Column:
    """As ``named_field``, for values that each carry the name of their rule, one of ``rules`` or another for none: one expression for any number of fields."""

    def candidate(raw: Column) -> Column:
        out = F
        for name in sorted(set(rules) & set(_NORMALIZERS)):
            out = out.when(rule == name, _NORMALIZERS[name](raw))
        return raw if out is F else out.otherwise(raw)

    return let(text.business_value(value), lambda raw: _judged(raw, candidate(raw)))
