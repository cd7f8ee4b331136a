"""Semantic blocks of a document's pages.

A page type is a set of block specifications: an array of structs is built per page, blocks without text fall out, and block ids number what is left
by page and place, so no state is carried from block to block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chartloom import dims
from chartloom.functions import confidence, geometry, text
from chartloom.operators import relational as rel
from chartloom.plans import header as head

# Noise of recognised text, for blocks and for their index text.
NOISE = [r"=~\s*\w+", r"\b\d+\s*:\s*[A-Z]\s+\w+\b", r"(?:[~=_-]\s*){2,}", r"\b[a-zA-Z]\s*[-_]{2,}\w*\b"]
INDEX_NOISE = [r"\ba\s+on\b", r"\bNormal\s+i\b", r"\bMiscarria\s+je\s+in\s+first\b", r"\ba\s*,?\s*trimester\b", r"\bols\s+der\b", r"\bwr\b", r"\bfr\b", r"\bI\s+Te\b", r"\b\d+\s+so\s+R\b", r"\bve\s+Social\b"]
FACILITY = "laboratoire_central|royaume_du_maroc|ministere_de_la_sante|centre_hospitalo_universitaire|laboratoire_de_parasitologie_mycologie|adresse_web|tel"
METADATA = ["Origine", "Prescripteur", "Date Demande", "Date Réception", "N° d'échantillon", "Nature"]
STAFF = "^(?:chef|professeur|medecins|infirmier|vice_major|technicien|imprime)"
RESULT_TITLES, RESULT_STOPS = ["resultats_d_analyses", "tableau_des_resultats", "resultats"], ["synthese", "conclusion", "interpretation", "validation_medicale", "vue_analytique"]
SUMMARY_TITLES, VALIDATION_TITLES = ["synthese_clinique", "synthese", "conclusion"], ["validation_medicale", "cachet_du_service"]


def clean_block_text(value: Column, cleanup: Column) -> Column:
    """Block text on one line; noise of recognition is dropped where ``cleanup`` holds."""
    plain = text.inline(value)
    out = plain
    for p in NOISE:
        out = F.regexp_replace(out, f"(?U){p}", " ")
    return F.when(cleanup, text.strip(F.regexp_replace(out, r"\s{2,}", " "))).otherwise(plain)


def index_text(value: Column, cleanup: Column) -> Column:
    """Text for retrieval: without noise, and of its sentences those with four words or a word of the domain; all of it if none is left."""
    plain = text.inline(value)
    out = plain
    for p in (*NOISE, *INDEX_NOISE):
        out = F.regexp_replace(out, f"(?iU){p}", " ")
    for p, to in ((r"[~=_]+", " "), (r"(?U)[^\w\s.,;:()/\[\]'%-]", " "), (r"\s+[a-zA-Z]\s+[a-zA-Z]\s+", " "), (r"\b[a-zA-Z]\s*,\s*", " "), (r"\s{2,}", " ")):
        out = F.regexp_replace(out, p, to)
    out = text.strip(out)

    def good(s: Column) -> Column:
        words = F.size(F.regexp_extract_all(s, F.lit("([A-Za-zÀ-ÿ]{2,})"), F.lit(1)))
        domain = s.rlike(r"(?i)\b(patient|rapport|validation|image|resultat|antecedents)\b")
        return (s != "") & ~s.rlike("[~=_{}|]") & ((words >= 4) | domain) & ~s.rlike(r"(?i)\b(?:je|wr|ols|der|fr|trimester)\b")

    def kept(t: Column) -> Column:
        said = F.array_join(F.filter(F.transform(F.split(t, r"(?<=[.;:])\s+"), lambda s: F.btrim(s, F.lit(" -;,"))), good), " ")
        return F.when(said != "", said).otherwise(t)

    return F.when(cleanup, text.let(out, kept)).otherwise(plain)


def finished(blocks: DataFrame) -> DataFrame:
    """blocks(doc_id, page_number, place, block_type, section_title, text, is_indexable, source, has_table, has_image, sources) with ids, scores and index text."""
    score = confidence.block_confidence(F.col("source"), F.col("block_type"), F.col("has_table"), F.col("has_image"), F.length("text"), F.col("sources"))
    scored = blocks.where(text.strip(F.col("text")) != "").withColumn("_c", score)
    cleanup = (F.col("_c.score") < 0.75) | (F.col("_c.label") == "low")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number", "place"))
    shown = scored.withColumn("block_id", F.format_string("block_%03d", number)).withColumn("confidence", F.col("_c.label")).withColumn("confidence_score", F.col("_c.score"))
    return shown.withColumn("index_text", index_text(F.col("text"), cleanup)).withColumn("text", clean_block_text(F.col("text"), cleanup)).drop("_c")


def _find(labels: Column, title: str) -> Column:
    key = text.without_accents(F.lit(title.lower()))
    key = F.btrim(F.regexp_replace(key, "[^a-z0-9]+", "_"), F.lit("_"))
    return F.array_min(F.filter(F.transform(labels, lambda x, i: F.when(x.contains(key), i)), lambda i: i.isNotNull()))


def _slice(lines: Column, start: Column, end: Column | None = None) -> Column:
    stop = F.size(lines) if end is None else F.coalesce(end, F.size(lines))
    part = F.slice(lines, start + 1, F.greatest(stop - start, F.lit(0)))
    return F.when(start.isNotNull(), part).otherwise(F.array().cast("array<string>"))


def _metadata(lines: Column, name: str) -> Column:
    pattern = "^" + name.replace("(", r"\(").replace(")", r"\)").replace("°", "[°º]?") + r"\s*:?"
    shown = text.let(head.line_value(lines, pattern), lambda value: F.when(~value.contains(":"), value))
    return F.concat(F.lit(f"{name}: "), F.coalesce(shown, F.lit("")))


def _meaningful(lines: Column) -> Column:
    said = F.transform(lines, lambda x: text.strip(F.regexp_replace(x, "^:+", "")))
    return F.get(F.filter(said, lambda x: (x != "") & ~text.label(x).isin("resultat_final", "resulat_final")), F.lit(0))


def _spec(kind: str, title: str, lines: Column, indexable: bool) -> Column:
    return F.struct(F.lit(kind).alias("block_type"), F.lit(title).alias("section_title"), F.array_join(lines, "\n").alias("text"), F.lit(indexable).alias("is_indexable"))


def stool_blocks(pages: DataFrame) -> DataFrame:
    """pages(doc_id, page_number, lines, text_source): up to ten blocks per page of a stool report."""
    lines, keys = F.col("lines"), F.col("_keys")
    at = {s: F.col(f"_{s}") for s in (*dims.STOOL_SECTIONS, "sample", "footer")}
    titles = {**dims.STOOL_SECTIONS, "sample": "ECHANTILLON BIOLOGIQUE", "footer": "Adresse Web"}
    keyed = rel.worked_out(pages.select("doc_id", "page_number", "lines", "text_source"), "_keys", F.transform(lines, text.label))
    found = keyed.select("*", *(_find(keys, t).alias(f"_{s}") for s, t in titles.items()))
    macro, micro, enriched, stained, final = (at[s] for s in dims.STOOL_SECTIONS)
    said = lambda title, v: text.let(v, lambda x: F.when(x.isNotNull(), F.array(F.concat(F.lit(f"{title} : "), x))).otherwise(F.array().cast("array<string>")))
    stain_value = F.when(final.isNotNull(), _meaningful(_slice(lines, stained + 1, final)))
    final_value = _meaningful(F.slice(_slice(lines, final + 1, at["footer"]), 1, 5))
    edited = F.array_min(F.filter(F.transform(keys, lambda k, i: F.when(k.startswith("edite_e_par") | (k.startswith("le_") & (i > F.coalesce(final, F.lit(0)))), i)), lambda i: i.isNotNull()))
    facility = F.filter(lines, lambda x, i: F.get(keys, i).rlike(FACILITY) | x.rlike("المملكة|وزارة"))
    found = rel.worked_out(found.withColumn("_edited", edited), "_meta", F.array(*(_metadata(lines, n) for n in METADATA)))
    patient = F.concat(F.array(*(_metadata(lines, n) for n in ("IP Patient", "Patient", "Né(e) le", "Sexe"))), F.col("_meta"))
    meta = F.concat(F.col("_meta"), F.array(*(_metadata(lines, n) for n in ("Imprimé par", "Edité(e) par"))))
    specs = F.array(
        _spec("facility_block", "Facility", facility, False), _spec("patient_info_block", "Patient information", patient, False), _spec("report_metadata_block", "Report metadata", meta, False),
        _spec("sample_block", titles["sample"], _slice(lines, at["sample"], macro), True), _spec("macroscopic_exam_block", titles["macroscopic_exam"], _slice(lines, macro, micro), True),
        _spec("microscopic_exam_block", titles["microscopic_exam"], _slice(lines, micro, enriched), True), _spec("enrichment_exam_block", titles["enrichment_exam"], _slice(lines, enriched, stained), True),
        _spec("staining_exam_block", titles["staining_exam"], said(titles["staining_exam"], stain_value), True), _spec("final_result_block", titles["final_result"], said(titles["final_result"], final_value), True),
        _spec("edition_block", "Edition laboratoire", F.filter(_slice(lines, F.col("_edited"), at["footer"]), lambda x: ~text.label(x).startswith("resultat_final")), False),
    )
    return _exploded(found, specs)


def hospital_blocks(pages: DataFrame) -> DataFrame:
    """Header (page 1), results and validation of a hospital laboratory page."""
    lines = F.col("lines")
    place = lambda test, a=0: F.array_min(F.filter(F.transform(lines, lambda x, i: F.when(test(text.label(x)) & (i >= a), i)), lambda i: i.isNotNull()))
    opened = F.coalesce(place(lambda k: (k == "parametres") | k.startswith("examen_")), place(lambda k: k.contains("centre_hospitalo_universitaire"))) + 1
    base = pages.select("doc_id", "page_number", "lines", "text_source", opened.alias("_start"))
    base = base.withColumn("_end", place(lambda k: k.rlike("^(?:le_|page_|adresse_web|tel)"), F.col("_start")))
    top = F.when(F.col("page_number") == 1, F.slice(lines, 1, F.coalesce(place(lambda k: k.startswith("royaume_du_maroc")), F.least(F.size(lines), F.lit(18))))).otherwise(F.array().cast("array<string>"))
    results = F.filter(_slice(lines, F.col("_start"), F.col("_end")), lambda x: ~text.label(x).rlike(STAFF) & (text.label(x) != ""))
    signed = F.filter(lines, lambda x: text.label(x).rlike("^(?:valide_e_par|edite_e_par|imprime_par|le_)"))
    return _exploded(base, F.array(_spec("patient_info_block", "Patient information", top, False), _spec("results_table_block", "Resultats", results, True), _spec("validation_block", "Validation", signed, False)))


def _exploded(pages: DataFrame, specs: Column) -> DataFrame:
    rows = pages.select("doc_id", "page_number", F.col("text_source").alias("source"), F.posexplode(specs).alias("place", "b")).select("doc_id", "page_number", "source", "place", "b.*")
    return rows.withColumn("has_table", F.lit(False)).withColumn("has_image", F.lit(False)).withColumn("sources", F.lit(1))


def _band_text(blocks: DataFrame, anchors: DataFrame, kind: str, title: str, indexable: bool, place: int) -> DataFrame:
    """One block per anchor(doc_id, page_number, start_y, end_y): the page's text blocks in [start_y, end_y), boilerplate left out, repeats dropped."""
    inside = rel.band_join(anchors, blocks.select("doc_id", "page_number", "pos", "text", F.col("bbox.y0").alias("y0"), "bbox", "source"), ["doc_id", "page_number"], "start_y", "end_y", "y0").where(~text.is_boilerplate(F.col("text")))
    per = inside.groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("_t"), F.first("source").alias("source"), F.count("*").cast("int").alias("sources"), geometry.envelope(F.col("bbox")).alias("bbox"))
    said = F.array_join(text.dedupe_fragments(F.transform("_t", lambda x: x["text"])), "\n")
    return per.select("doc_id", "page_number", "source", F.lit(place).alias("place"), F.lit(kind).alias("block_type"), F.lit(title).alias("section_title"), said.alias("text"), F.lit(indexable).alias("is_indexable"), F.lit(False).alias("has_table"), F.lit(False).alias("has_image"), "sources")


def anchors(blocks: DataFrame, titles: list[str], stops: list[str], page_height: float) -> DataFrame:
    """Per page the band from the first block with a title to the next block below it with a stop word (or 95 % of the page)."""
    key = text.label(F.col("text"))
    keyed = blocks.withColumn("_title", key.rlike("|".join(titles))).withColumn("_stop", key.rlike("|".join(stops)))
    start = keyed.where("_title").groupBy("doc_id", "page_number").agg(F.min_by("bbox.y0", "pos").alias("start_y"))
    below = keyed.where("_stop").join(start, ["doc_id", "page_number"]).where(F.col("bbox.y0") > F.col("start_y")).groupBy("doc_id", "page_number").agg(F.min("bbox.y0").alias("_s"))
    return start.join(below, ["doc_id", "page_number"], "left").select("doc_id", "page_number", "start_y", F.coalesce("_s", F.lit(page_height * 0.95)).alias("end_y"))


def column_blocks(blocks: DataFrame, bands: DataFrame, page_width: float) -> DataFrame:
    """A band's text split at mid-page: patient on the left, report on the right."""
    parts = []
    for left, kind, title in ((True, "patient_info_block", "Patient"), (False, "report_info_block", "Report")):
        side = blocks.where((F.col("bbox.x0") < page_width / 2) == left)
        parts.append(_band_text(side, bands, kind, title, False, 2 if left else 3))
    return parts[0].unionByName(parts[1])


#: Bands of text by their title: place, kind, section, whether it is indexed, titles, stops.
BANDS = [
    (40, "results_table_block", "Resultats", True, RESULT_TITLES, RESULT_STOPS), (50, "summary_block", "Synthese", True, SUMMARY_TITLES, VALIDATION_TITLES), (70, "validation_block", "Validation", False, VALIDATION_TITLES, ["document_synthetique"]),
]


def _assets(df: DataFrame, name: str, *columns: str | Column) -> DataFrame:
    return df.groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))


def with_assets(blocks: DataFrame, tables: DataFrame, images: DataFrame) -> DataFrame:
    """doc_id, page_number and arrays of a page's text (with labels), known tables and clinical images; each input is read once, a page's rows meet once."""
    keyed = blocks.select("doc_id", "page_number", "pos", "text", F.col("bbox.y0").alias("y0"), "source", text.label(F.col("text")).alias("key"))
    marked = keyed.withColumn("furniture", text.is_furniture_label(F.col("key")))
    said = _assets(marked, "said", "pos", "text", "y0", "source", "key", "furniture")
    known = _assets(tables.where("table_role <> 'unknown'"), "known", "table_no", "table_role", "body")
    seen = _assets(images.where("role in ('clinical_visual', 'analytics')"), "seen", "image_id", "context_text")
    return said.join(known, ["doc_id", "page_number"], "full").join(seen, ["doc_id", "page_number"], "full")


def generic_blocks(blocks: DataFrame, tables: DataFrame, images: DataFrame, page_width: float = 595.0, page_height: float = 842.0) -> DataFrame:
    """Blocks of other reports: header, facility, tables, results, summary, image context, validation, footer.

    blocks(doc_id, page_number, pos, text, bbox, source), tables(doc_id, page_number, table_no, table_role, body),
    images(doc_id, page_number, image_id, role, context_text).  No interpretation block is made: its title is never set.
    A page's assets are gathered once, and all its blocks are expressions over them.
    """
    said = F.coalesce("said", F.array().cast("array<struct<pos:int,text:string,y0:double,source:string,key:string,furniture:boolean>>"))
    first = lambda rows: F.get(rows, F.lit(0))
    is_first = F.col("page_number") == 1

    def block(place: Column, kind: Column, title: Column, shown: Column, indexable: Column, source: Column, table: bool = False, image: bool = False, sources: Column | None = None) -> Column:
        return F.struct(
            source.alias("source"), place.cast("int").alias("place"), kind.alias("block_type"), title.alias("section_title"), shown.alias("text"), indexable.alias("is_indexable"), F.lit(table).alias("has_table"), F.lit(image).alias("has_image"),
            (F.lit(1) if sources is None else sources).cast("int").alias("sources"),
        )

    def single(place: int, kind: str, title: str, row: Column) -> Column:
        return block(F.lit(place), F.lit(kind), F.lit(title), row["text"], F.lit(False), row["source"])

    def of_table(t: Column) -> Column:
        kind = F.when(t["table_role"] == "results_table", "results_table_block").when(t["table_role"] == "patient_info_table", "patient_info_block").otherwise("report_info_block")
        return block(t["table_no"] + 10, kind, t["table_role"], t["body"], t["table_role"] == "results_table", F.lit("native"), table=True)

    def band(spec: Column) -> Column:
        """From the first text with a title to the nearest stop below it, or 95 % of the page."""
        start = first(F.filter("said", lambda b: F.rlike(b["key"], spec["titles"])))["y0"]
        stop = lambda y: F.coalesce(F.array_min(F.transform(F.filter("said", lambda b: F.rlike(b["key"], spec["stops"]) & (b["y0"] > y)), lambda b: b["y0"])), F.lit(page_height * 0.95))
        inside = lambda y, end: F.filter("said", lambda b: (b["y0"] >= y) & (b["y0"] < end) & ~b["furniture"])

        def joined(rows: Column) -> Column:
            shown = F.array_join(text.dedupe_fragments(F.transform(rows, lambda b: b["text"])), "\n")
            return F.when(F.size(rows) > 0, block(spec["place"], spec["kind"], spec["title"], shown, spec["indexable"], first(rows)["source"], sources=F.size(rows)))

        return text.let(start, lambda y: text.let(stop(y), lambda end: text.let(inside(y, end), joined)))

    tabled = F.exists("known", lambda t: t["table_role"] == "results_table")
    specs = F.array(*(F.struct(F.lit(place).alias("place"), F.lit(kind).alias("kind"), F.lit(title).alias("title"), F.lit(shown).alias("indexable"), F.lit("|".join(titles)).alias("titles"), F.lit("|".join(stops)).alias("stops")) for place, kind, title, shown, titles, stops in BANDS))
    bands = F.transform(F.filter(specs, lambda x: (x["kind"] != "results_table_block") | ~F.coalesce(tabled, F.lit(False))), band)
    head_text = F.filter("said", lambda b: is_first & ~b["furniture"])
    phones = F.filter("said", lambda b: is_first & b["text"].rlike(r"Tel[. ]"))
    low = F.reduce(F.filter("said", lambda b: b["furniture"]), F.get("said", F.lit(-1)), lambda a, b: F.when(a.isNull() | (b["y0"] > a["y0"]), b).otherwise(a))
    ones = F.array(
        *(F.when(row.isNotNull(), single(place, kind, title, row)) for place, kind, title, row in ((0, "document_header", "Header", first(head_text)), (1, "facility_block", "Facility", first(phones)), (90, "footer_block", "Footer", low)))
    )
    of_tables = F.transform(F.coalesce("known", F.array().cast("array<struct<table_no:int,table_role:string,body:string>>")), of_table)
    of_images = F.transform(F.coalesce("seen", F.array().cast("array<struct<image_id:string,context_text:string>>")), lambda i: block(F.lit(60), F.lit("image_context_block"), F.lit("Image"), i["context_text"], F.lit(True), F.lit("native"), image=True))
    paged = with_assets(blocks, tables, images).withColumn("said", said)
    return paged.select("doc_id", "page_number", F.explode(F.array_compact(F.concat(ones, of_tables, bands, of_images))).alias("b")).select("doc_id", "page_number", "b.*")


def companion_titles(titles: DataFrame, blocks: DataFrame) -> DataFrame:
    """titles(doc_id, page_number, pos, bbox, max_font_size) with ``companion_pos``: the leftmost bold text beside it, to its right, at its height and no smaller.

    blocks(doc_id, page_number, pos, bbox, max_font_size, is_bold).  Heights differ by 20 at most, so titles and texts meet by bands of the page.
    """
    side = blocks.where("is_bold").select("doc_id", "page_number", F.col("pos").alias("_pos"), F.col("bbox").alias("_b"), F.col("max_font_size").alias("_size"))
    pairs = rel.near_join(titles, side, ["doc_id", "page_number"], F.col("bbox.y0"), F.col("_b.y0"), 20.0)
    pairs = pairs.where((F.col("_pos") != F.col("pos")) & (F.col("_size") >= F.col("max_font_size") - 0.5) & (F.col("_b.x0") > F.col("bbox.x0") + 40))
    best = pairs.groupBy("doc_id", "page_number", "pos").agg(F.min_by("_pos", F.struct("_b.x0", "_pos")).alias("companion_pos"))
    return titles.join(best, ["doc_id", "page_number", "pos"], "left")


def titles_above(images: DataFrame, blocks: DataFrame) -> DataFrame:
    """images(doc_id, page_number, image_id, bbox) with ``title_pos``: the lowest bold text that ends from 25 above to 5 below the image's top, over it or within 20 beside it."""
    side = blocks.where("is_bold").select("doc_id", "page_number", F.col("pos").alias("_pos"), F.col("bbox").alias("_b"))
    pairs = rel.near_join(images, side, ["doc_id", "page_number"], F.col("bbox.y0") - 10, F.col("_b.y1"), 15.0)
    pairs = pairs.where((F.col("_b.x1") >= F.col("bbox.x0") - 20) & (F.col("_b.x0") <= F.col("bbox.x1") + 20))
    best = pairs.groupBy("doc_id", "page_number", "image_id").agg(F.max_by("_pos", F.struct("_b.y1", -F.col("_pos"))).alias("title_pos"))
    return images.join(best, ["doc_id", "page_number", "image_id"], "left")


def next_boundaries(starts: DataFrame, blocks: DataFrame, tables: DataFrame, stops: DataFrame, page_height: float = 842.0) -> DataFrame:
    """starts(doc_id, page_number, pos, y0, max_font_size, companion_pos) with ``end_y`` and ``end_kind``: what ends the section that starts there.

    That is the nearest below of bold texts no smaller than the start's (its companion title not counted), tables(doc_id, page_number, y0), stops(doc_id, page_number, y0), and 95 % of the page.
    A page's candidates are gathered once, in order of height, and each start looks for its first; no pair of them becomes a row.
    """
    none = F.lit(None)
    as_candidate = lambda df, kind, y, size, pos: df.select("doc_id", "page_number", F.struct(y.cast("double").alias("y"), F.lit(kind).alias("kind"), size.cast("double").alias("size"), pos.cast("bigint").alias("pos")).alias("c"))
    every = (
        as_candidate(blocks.where("is_bold"), 0, F.col("bbox.y0"), F.col("max_font_size"), F.col("pos")).unionByName(as_candidate(tables, 1, F.col("y0"), none, none)).unionByName(as_candidate(stops, 2, F.col("y0"), none, none))
    )
    gathered = every.groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list("c")).alias("_c"))
    fits = lambda c: (c["y"] > F.col("y0")) & ((c["kind"] > 0) | ((c["size"] >= F.col("max_font_size")) & ~c["pos"].eqNullSafe(F.col("companion_pos"))))
    first = F.get(F.filter("_c", fits), F.lit(0))
    found = starts.join(gathered, ["doc_id", "page_number"], "left").withColumn("_first", first)
    near = F.col("_first.y") <= page_height * 0.95
    kinds = F.array(F.lit("title"), F.lit("table"), F.lit("stop"))
    return found.select(*starts.columns, F.when(near, F.col("_first.y")).otherwise(page_height * 0.95).alias("end_y"), F.when(near, F.get(kinds, F.col("_first.kind"))).otherwise("page").alias("end_kind"))


def validation_fields(blocks: DataFrame, images: DataFrame, page_width: float = 595.0, reach: float = 80.0) -> DataFrame:
    """doc_id, validated_by, specialty, has_signature, has_stamp: the first two lines under the validation title on the left, and the images' roles."""
    title = anchors(blocks, VALIDATION_TITLES[:1], ["document_synthetique"], 842.0).withColumn("end_y", F.least("end_y", F.col("start_y") + reach))
    left = blocks.where(F.col("bbox.x0") < page_width * 0.55).select("doc_id", "page_number", "pos", "text", F.col("bbox.y0").alias("y0"))
    inside = rel.band_join(title, left, ["doc_id", "page_number"], "start_y", "end_y", "y0").where((F.col("y0") > F.col("start_y")) & ~text.is_boilerplate(F.col("text")))
    said = inside.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "pos", "text"))), lambda x: x["text"]).alias("_t"))
    seen = images.groupBy("doc_id").agg(F.bool_or(F.col("type") == "signature").alias("has_signature"), F.bool_or(F.col("type") == "stamp_or_seal").alias("has_stamp"))
    return said.join(seen, "doc_id", "full").select("doc_id", F.get("_t", F.lit(0)).alias("validated_by"), F.get("_t", F.lit(1)).alias("specialty"), F.coalesce("has_signature", F.lit(False)).alias("has_signature"), F.coalesce("has_stamp", F.lit(False)).alias("has_stamp"))
