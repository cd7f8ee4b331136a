"""Images: page coverage, text near them, kind and role, crops of scanned pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.functions import geometry, text
from chartloom.operators import relational as rel

FULL_PAGE = 0.9
# Words near an image that tell its kind, in the order of the rules: type, role, indexable.
RULES = [
    ("cachet_du_service|valide|seal", "stamp_or_seal", "validation", False),
    ("validation_medicale|validation", "signature", "validation", False),
    ("echographie|radiographie|image_medicale|illustration_d_imagerie", "medical_illustration", "clinical_visual", True),
    ("vue_analytique|visualisation_analytique|mixed_texte_tableau_image", "clinical_chart", "analytics", True),
]
# Labels of the blocks from which crops of a scanned page are measured.
ANCHORS = {
    "header": "dossier_patient_synthetique_multimodal|communicative_health_care_associates", "title": "compte_rendu_d_analyses|compte_rendu_d_imagerie",
    "caption": "bloc_image_rasterise|visualisation_analytique|image_medicaie_synthetique|image_medicale_synthetique", "chart": "vue_analytique_synthetique|synthese_radioclinique|radiographie_thoracique_synthetique|echographie_synthetique",
    "analytic": "vue_analytique_synthetique|visualisation_analytique", "validation": "validation_medicale", "stamp": "cachet_du_service",
}


def without_rasters(images: DataFrame) -> DataFrame:
    """Each image of a page once; scans of the whole page left out."""
    single = images.dropDuplicates(["doc_id", "page_number", "xref"])
    coverage = geometry.area(F.col("bbox")) / F.greatest(F.lit(1.0), F.col("width") * F.col("height"))
    return single.withColumn("page_coverage", F.round(coverage, 4)).where(coverage < FULL_PAGE)


def context(images: DataFrame, blocks: DataFrame, nearest: int = 3) -> DataFrame:
    """Adds context_text: the ``nearest`` blocks by vertical distance less twenty times the overlap, joined by ' | '.

    Blocks are joined on document and page, so a page's images meet that page's blocks only.
    """
    side = blocks.select("doc_id", "page_number", F.col("pos").alias("_pos"), F.col("text").alias("_text"), F.col("bbox").alias("_b"))
    pairs = images.select("doc_id", "page_number", "image_id", "bbox").join(side, ["doc_id", "page_number"]).where(~text.is_boilerplate(F.col("_text")))
    overlap, gap = geometry.horizontal_overlap(F.col("bbox"), F.col("_b")), geometry.vertical_distance(F.col("bbox"), F.col("_b"))
    beside = (F.col("_b.x1") < F.col("bbox.x0") - 15) | (F.col("_b.x0") > F.col("bbox.x1") + 15)
    pairs = pairs.where(~((overlap < 0.15) & (gap > 25)) & ~((overlap < 0.08) & beside)).withColumn("_score", gap - 20 * overlap)
    best = rel.top_per_group(pairs, ["doc_id", "image_id"], [F.col("_score"), F.col("_pos")], nearest)
    said = F.transform(F.array_sort(F.collect_list(F.struct("_score", "_pos", text.inline(F.col("_text")).alias("t")))), lambda x: x["t"])
    return images.join(best.groupBy("doc_id", "image_id").agg(F.array_join(said, " | ").alias("context_text")), ["doc_id", "image_id"], "left").na.fill({"context_text": ""})


def classify(page: Column, width: Column, height: Column, box: Column, near: Column) -> Column:
    """struct(type, role, is_indexable) by words near the image, then by where it stands on the page."""
    key = text.label(near)
    out = lambda t, r, i: F.struct(F.lit(t).alias("type"), F.lit(r).alias("role"), F.lit(i).alias("is_indexable"))
    chain = F.when(key.rlike(RULES[0][0]), out(*RULES[0][1:]))
    for words, *kind in RULES[1:]:
        chain = chain.when(key.rlike(words), out(*kind))
    w, h = F.greatest(width, F.lit(1.0)), F.greatest(height, F.lit(1.0))
    wide, high, top, left = (box["x1"] - box["x0"]) / w, (box["y1"] - box["y0"]) / h, box["y0"] / h, box["x0"] / w
    chain = chain.when((top < 0.18) & (wide > 0.28), out("logo_or_branding", "branding", False)).when((page == 2) & (wide > 0.25) & (high > 0.08), out("clinical_chart", "analytics", True))
    chain = chain.when((page == 3) & (left < 0.45) & (top > 0.35), out("signature", "validation", False)).when((page == 3) & (left > 0.55) & (top > 0.35), out("stamp_or_seal", "validation", False))
    return chain.otherwise(out("unknown", "unknown", False))


def scan_crops(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """pages(doc_id, page_number, width, height, text_source), blocks(doc_id, page_number, pos, text, bbox): boxes to crop from recognised pages.

    Measured from the first block with each anchor's words (the footer: the lowest); ids count attempts, boxes that are too small are dropped.
    """
    keyed = blocks.withColumn("_k", text.label(F.col("text")))
    at = lambda p: F.min_by(F.when(F.col("_k").rlike(p), F.col("bbox")), F.when(F.col("_k").rlike(p), F.col("pos")))
    footer = F.max(F.when(F.col("_k").contains("document_synthetique"), F.col("bbox.y0")))
    found = keyed.groupBy("doc_id", "page_number").agg(footer.alias("footer"), *(at(p).alias(n) for n, p in ANCHORS.items()))
    page = pages.where("text_source = 'ocr'").join(found, ["doc_id", "page_number"])
    w, h = F.col("width"), F.col("height")
    crop = lambda shown, name, x0, y0, x1, y1: F.when(shown, F.struct(name.alias("label"), geometry.box(w * x0, y0, w * x1, y1).alias("bbox")))
    has = lambda n: F.col(n).isNotNull()
    zero = F.lit(0.0)
    brand_top = F.coalesce(F.col("header.y0") - h * 0.02, h * 0.04)
    captioned = F.greatest(h * 0.10, F.col("caption.y0") - h * 0.20, F.coalesce(F.col("chart.y1") + h * 0.01, zero))
    titled = F.greatest(h * 0.18, F.col("chart.y0") + h * 0.04)
    chart_top = F.when(has("caption"), captioned).otherwise(titled)
    chart_end = F.when(has("caption"), F.col("caption.y0") - h * 0.008).otherwise(F.least(h * 0.55, titled + h * 0.24))
    under = F.coalesce(F.col("validation.y1"), F.col("stamp.y1")) + h * 0.02
    until = F.coalesce("footer", h * 0.94) - h * 0.015
    signed = has("validation") | has("stamp")
    attempts = F.array_compact(
        F.array(
            crop((F.col("page_number") == 1) & has("title"), F.lit("branding"), 0.08, brand_top, 0.92, F.greatest(h * 0.17, F.col("title.y0") - h * 0.015)),
            crop(has("caption") | has("chart"), F.when(has("analytic"), "chart").otherwise("visual"), 0.5, chart_top, 0.93, chart_end),
            crop(signed, F.lit("signature"), 0.08, under, 0.42, until),
            crop(signed, F.lit("stamp"), 0.58, under, 0.86, until),
        )
    )
    crops = page.select("doc_id", "page_number", "width", "height", F.posexplode(attempts).alias("i", "c")).withColumn("bbox", geometry.clamp(F.col("c.bbox"), w, h)).where("bbox is not null")
    return crops.select("doc_id", "page_number", F.format_string("visual_p%03d_%02d", F.col("page_number"), F.col("i") + 1).alias("visual_id"), F.col("c.label").alias("label"), "bbox")
