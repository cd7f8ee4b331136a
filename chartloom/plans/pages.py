"""Pages: signals, document class, text blocks, OCR words to lines, merge of native and recognised text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.functions import geometry, text

MEANINGFUL = 30


def classes(signals: DataFrame) -> DataFrame:
    """signals(doc_id, page_number, native_text_chars, image_count) to doc_id, pdf_type and counts."""
    has_text = F.col("native_text_chars") >= MEANINGFUL
    counts = signals.groupBy("doc_id").agg(F.count("*").alias("page_count"), F.count_if(has_text).alias("text_pages"), F.count_if(F.col("image_count") > 0).alias("image_pages"))
    kind = F.when(F.col("text_pages") == 0, "scanned").when((F.col("text_pages") == F.col("page_count")) & (F.col("image_pages") == 0), "digital").otherwise("mixed")
    return counts.withColumn("pdf_type", kind)


def to_recognise(pages: DataFrame) -> DataFrame:
    """Pages with too little native text."""
    return pages.where(F.coalesce(F.col("native_text_chars"), F.lit(0)) < MEANINGFUL)


def text_blocks(spans: DataFrame) -> DataFrame:
    """spans(doc_id, page_number, block_no, line_no, span_no, text, size, font, x0..y1) to blocks; ids number blocks as they come, rows are in reading order by (y0, x0)."""
    key = ["doc_id", "page_number", "block_no"]
    said = spans.withColumn("text", text.strip(F.col("text"))).where("text <> ''")
    line = F.array_sort(F.collect_list(F.struct("line_no", "span_no", "text")))
    merged = said.groupBy(*key).agg(line.alias("_s"), geometry.envelope(F.struct(*geometry.SIDES)).alias("bbox"), F.max("size").alias("max_font_size"), F.bool_or(F.lower("font").contains("bold")).alias("is_bold"), F.array_sort(F.collect_set("font")).alias("fonts"))
    numbers = F.array_distinct(F.transform("_s", lambda s: s["line_no"]))
    lines = F.transform(numbers, lambda n: F.array_join(F.transform(F.filter("_s", lambda s: s["line_no"] == n), lambda s: s["text"]), " "))
    merged = merged.withColumn("text", F.array_join(lines, "\n")).drop("_s")
    ident = F.format_string("text_p%03d_%02d", F.col("page_number"), F.col("block_no"))
    return merged.withColumn("text_block_id", ident).orderBy("doc_id", "page_number", F.col("bbox.y0"), F.col("bbox.x0"), "block_no")


def ocr_lines(words: DataFrame, scale: float = 1.0) -> DataFrame:
    """words(doc_id, page_number, block_num, par_num, line_num, text, conf, x0..y1) to lines: words by x0, box of all, height of the highest; empty and rejected words dropped."""
    kept = words.where((text.strip(F.col("text")) != "") & (F.col("conf") >= 0))
    box = F.struct(*((F.col(s) * scale).alias(s) for s in geometry.SIDES))
    ordered = F.array_sort(F.collect_list(F.struct("x0", "y0", text.strip(F.col("text")).alias("w"))))
    lines = kept.groupBy("doc_id", "page_number", "block_num", "par_num", "line_num").agg(
        F.array_join(F.transform(ordered, lambda x: x["w"]), " ").alias("text"), geometry.envelope(box).alias("bbox"), F.max((F.col("y1") - F.col("y0")) * scale).alias("max_font_size"), F.avg("conf").alias("confidence")
    )
    return lines.withColumn("is_bold", F.lit(False))


def merge_ocr(pages: DataFrame, ocr: DataFrame) -> DataFrame:
    """pages(doc_id, page_number, native_text) with ocr(doc_id, page_number, ocr_text): recognised text where native text is short, native text kept (source 'hybrid') where it is not."""
    joined = pages.join(ocr, ["doc_id", "page_number"], "left")
    native = text.strip_page_boilerplate(F.col("native_text"))
    joined = joined.withColumn("native_text", native).withColumn("native_text_chars", F.length("native_text"))
    used, short = F.col("ocr_text").isNotNull(), F.col("native_text_chars") < MEANINGFUL
    source = F.when(used & short, "ocr").when(used, "hybrid").when(F.col("native_text_chars") > 0, "native").otherwise("none")
    final = F.when(used & short, text.strip_page_boilerplate(F.col("ocr_text"))).otherwise(F.col("native_text"))
    return joined.withColumn("text_source", source).withColumn("final_text", final).withColumn("ocr_text_chars", F.coalesce(F.length("ocr_text"), F.lit(0)))
