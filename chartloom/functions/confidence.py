"""Confidence scores."""

from __future__ import annotations

import hashlib
import random

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.functions import text


def band(score: Column) -> Column:
    return F.when(score >= 0.85, "high").when(score >= 0.6, "medium").otherwise("low")


def rounded(score: Column) -> Column:
    """Between 0 and 1, three decimals."""
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 3)


def field_confidence(value: Column, source: Column, parsed: bool | Column = False) -> Column:
    """struct(label, score): nothing has 0; a parsed value loses 0.03."""
    loss = F.when(parsed, 0.03).otherwise(0.0) if isinstance(parsed, Column) else 0.03 if parsed else 0.0
    score = F.when(value.isNull() | (value.cast("string") == ""), 0.0).otherwise(rounded(source - loss))
    return F.struct(band(score).alias("label"), score.alias("score"))


def mean_positive(scores: Column) -> Column:
    """struct(label, score): mean of an array's scores above 0; ('low', 0) for none."""
    some = F.filter(scores, lambda s: s > 0)
    total = F.aggregate(some, F.lit(0.0), lambda a, s: a + s)
    mean = F.when(F.size(some) > 0, rounded(F.try_divide(total, F.size(some)))).otherwise(0.0)
    return F.struct(F.when(F.size(some) > 0, band(mean)).otherwise("low").alias("label"), mean.alias("score"))


@F.pandas_udf(T.DoubleType())
def _jitter(material: pd.Series) -> pd.Series:
    draw = lambda m: random.Random(int(hashlib.md5(m.encode("utf-8", "ignore")).hexdigest()[:8], 16)).uniform(-0.02, 0.02)
    return material.map(draw)


def extraction_confidence(value: Column, source: Column, corrected: Column | None = None, field_length: Column | None = None, jitter: bool = True) -> Column:
    """Confidence of an extracted text by its source and shape, between 0.5 and 0.99.

    With ``jitter`` a draw of the Mersenne Twister, seeded by a hash of the inputs, is added; no built-in function has it,
    so that part runs in Python in Arrow batches.
    """
    cleaned = text.inline(F.coalesce(value, F.lit("")))
    kind = F.lower(text.strip(F.coalesce(source, F.lit(""))))
    corrected = F.lit(False) if corrected is None else corrected
    length = F.length(cleaned) if field_length is None else F.when(field_length > 0, field_length).otherwise(F.length(cleaned))
    score = F.when(kind == "native", 0.95).when(kind == "ocr", 0.85).when(kind == "hybrid", 0.9).otherwise(0.88)
    score -= F.when(corrected, 0.05).otherwise(0.0)
    score -= F.when(length < 3, 0.05).otherwise(0.0)
    score += F.when(cleaned.rlike(r"\d") & cleaned.rlike(r"(?iU)\b[a-z%/]{1,6}\b"), 0.02).otherwise(0.0)
    score -= F.when((cleaned == "") | cleaned.endswith(":") | cleaned.isin("-", "unknown") | cleaned.contains("needs_review"), 0.05).otherwise(0.0)
    if jitter:
        score += _jitter(F.concat_ws("|", kind, cleaned, length.cast("string"), corrected.cast("int").cast("string")))
    return F.round(F.least(F.lit(0.99), F.greatest(F.lit(0.5), score)), 3)


def block_confidence(source: Column, block_type: Column, has_table: Column, has_image: Column, text_length: Column, sources: Column) -> Column:
    """struct(label, score) of a block by where it comes from and what supports it."""
    score = F.lit(0.45) + F.when(source == "native", 0.35).when(source == "hybrid", 0.2).when(source == "ocr", 0.05).otherwise(0.0)
    score += F.when(has_table, 0.2).otherwise(0.0) + F.when(has_image, 0.1).otherwise(0.0)
    score += F.when(sources >= 2, 0.05).otherwise(0.0) + F.when(text_length > 80, 0.05).otherwise(0.0)
    score -= F.when((block_type == "validation_block") & ~has_image & (sources == 0), 0.1).otherwise(0.0)
    floor = F.when((source == "native") & block_type.isin("staining_exam_block", "final_result_block") & (text_length > 0), 0.9).otherwise(0.0)
    score = rounded(F.greatest(score, floor))
    footer = block_type == "footer_block"
    return F.struct(F.when(footer, "low").otherwise(band(score)).alias("label"), F.when(footer, 0.2).otherwise(score).alias("score"))
