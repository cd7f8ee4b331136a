"""The query catalogue: each clinical operator applied to the benchmark tables, with the same thing in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chartloom import dims
from chartloom.functions import confidence, geometry, identity, parse, text
from chartloom.operators import relational as rel
from chartloom.plans import documents, pages, qa, reports

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _spread(table: DataFrame) -> DataFrame:
    """``table`` with its rows dealt over all cores by its first column, the key.

    A file is read by as many tasks as it has row groups, and a million short rows are one of them; that suits a scan, not queries that make a whole document of every row.
    """
    return table.repartition(2 * table.sparkSession.sparkContext.defaultParallelism, table.columns[0])


def _query(sql: str | None = None, *tables: str, spread: tuple[str, ...] = ()):
    """Register ``f(table, ...)`` under its name, the tables read by name, those in ``spread`` dealt over all cores; with the SQL that says the same."""

    def register(f):
        read = lambda spark, sf_dir, t: _spread(_table(spark, sf_dir, t)) if t in spread else _table(spark, sf_dir, t)
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(*(read(spark, sf_dir, t) for t in tables))
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def _label_sql(x: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower({x})), '[^a-z0-9]+', '_', 'g'), '_')"


def _lines_sql(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, chr(10)), lambda s: trim(regexp_replace(s, '[ \\t]+', ' ', 'g'))), lambda s: s <> '')"


_BOILER_SQL = " AND ".join(f"NOT contains({_label_sql('s')}, '{p}')" for p in dims.BOILERPLATE)


# -- text ---------------------------------------------------------------------------------


@_query(f"SELECT doc_id, {_label_sql('text')} AS label FROM documents", "documents")
def label_documents(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text.label(F.col("text")).alias("label"))


@_query(f"SELECT doc_id, label FROM (SELECT doc_id, md5({_label_sql('text')}) AS label FROM documents) QUALIFY row_number() OVER (PARTITION BY label ORDER BY doc_id) = 1", "documents")
def exact_duplicate_documents(docs: DataFrame) -> DataFrame:
    """The first document of each label."""
    keyed = docs.select("doc_id", F.md5(text.label(F.col("text")).cast("binary")).alias("label"))
    return rel.keep_first(keyed, ["label"], ["doc_id"])


@_query(f"SELECT md5({_label_sql('text')}) AS label, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1", "documents")
def repeated_text_having(docs: DataFrame) -> DataFrame:
    keyed = docs.select("doc_id", F.md5(text.label(F.col("text")).cast("binary")).alias("label"))
    return keyed.groupBy("label").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


@_query(f"SELECT doc_id, md5(array_to_string(list_filter({_lines_sql('text')}, lambda s: {_BOILER_SQL} AND NOT regexp_full_match(s, '(?i)page\\s+[0-9]+')), chr(10))) AS body FROM documents", "documents")
def boilerplate_line_filter(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.md5(text.strip_page_boilerplate(F.col("text")).cast("binary")).alias("body"))


@_query(f"SELECT doc_id, CAST(i AS INTEGER) AS line_no, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, {_lines_sql('text')} AS l FROM documents))", "documents")
def line_ordinals(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(text.lines(F.col("text"))).alias("i", "line")).select("doc_id", (F.col("i") + 1).alias("line_no"), "line")


@_query(
    f"""WITH n AS (SELECT doc_id, i, {_label_sql('l[i]')} AS label FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, {_lines_sql('text')} AS l FROM documents))),
    s AS (SELECT doc_id, min(i) AS band_start FROM n WHERE contains(label, 'the') GROUP BY 1),
    e AS (SELECT n.doc_id, min(i) AS band_end FROM n JOIN s ON n.doc_id = s.doc_id WHERE i > band_start AND contains(label, 'licen') GROUP BY 1)
    SELECT s.doc_id, CAST(band_start AS INTEGER) AS band_start, count(*) AS lines FROM s LEFT JOIN e ON e.doc_id = s.doc_id JOIN n ON n.doc_id = s.doc_id
    WHERE i >= band_start AND i < coalesce(band_end, 1000000000) GROUP BY 1, 2""",
    "documents",
)
def section_band(docs: DataFrame) -> DataFrame:
    """Lines from the first that mentions a start word up to the next that mentions a stop word; all within the row."""
    numbered = docs.select("doc_id", F.transform(text.lines(F.col("text")), text.key).alias("labels"))
    ordinal = lambda word, after: F.array_min(F.filter(F.transform("labels", lambda x, i: F.when(x.contains(word) & (i + 1 > after), i + 1)), lambda i: i.isNotNull()))
    started = numbered.withColumn("band_start", ordinal("the", F.lit(0))).where("band_start is not null")
    ended = started.withColumn("band_end", F.coalesce(ordinal("licen", F.col("band_start")), F.size("labels") + 1))
    return ended.select("doc_id", "band_start", (F.col("band_end") - F.col("band_start")).cast("long").alias("lines"))


@_query("SELECT source, count(*) AS documents, count(*) FILTER (length(trim(regexp_replace(text, '[ \\t]+', ' ', 'g'), ' \n')) >= 200) AS meaningful FROM documents GROUP BY 1", "documents")
def meaningful_text_filter(docs: DataFrame) -> DataFrame:
    return docs.groupBy("source").agg(F.count("*").alias("documents"), F.count_if(text.is_meaningful(F.col("text"), 200)).alias("meaningful"))


@_query(
    """SELECT source AS doc_id, count(*) AS page_count, count(*) FILTER (n_chars % 400 >= 30) AS text_pages, count(*) FILTER (doc_id % 50 = 0) AS image_pages,
    CASE WHEN count(*) FILTER (n_chars % 400 >= 30) = 0 THEN 'scanned' WHEN count(*) FILTER (n_chars % 400 >= 30) = count(*) AND count(*) FILTER (doc_id % 50 = 0) = 0 THEN 'digital' ELSE 'mixed' END AS pdf_type FROM documents GROUP BY 1""",
    "documents",
)
def doc_class_signals(docs: DataFrame) -> DataFrame:
    """Each source as a document, its texts as pages."""
    return pages.classes(docs.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_number"), (F.col("n_chars") % 400).alias("native_text_chars"), (F.col("doc_id") % 50 == 0).cast("int").alias("image_count")))


@_query("SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN n_chars % 90 END AS native_text_chars FROM documents WHERE doc_id % 3 = 0 OR n_chars % 90 < 30", "documents")
def short_pages(docs: DataFrame) -> DataFrame:
    """Pages that need recognition: too little native text, or none."""
    return pages.to_recognise(docs.select("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("n_chars") % 90).alias("native_text_chars")))


@_query("SELECT page_id, coalesce(nullif(trim(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '._-'), ''), 'document') AS stem, coalesce(nullif(trim(regexp_replace(url, '[^A-Za-z0-9]+', '_', 'g'), '_'), ''), 'patient') AS slug FROM pages", "pages")
def safe_stem_urls(found: DataFrame) -> DataFrame:
    return found.select("page_id", text.safe_stem(F.col("url")).alias("stem"), text.slugify(F.col("url")).alias("slug"))


# -- parsing ------------------------------------------------------------------------------


@_query("SELECT event_id, TRY_CAST(nullif(regexp_extract(props, '-?[0-9]+'), '') AS BIGINT) AS k, TRY_CAST(nullif(regexp_extract(replace(replace(CAST(value AS VARCHAR), '.', ','), ',', '.'), '-?[0-9]+([.][0-9]+)?'), '') AS DOUBLE) AS v FROM events", "events")
def numeric_parse(events: DataFrame) -> DataFrame:
    shown = F.replace(F.col("value").cast("string"), F.lit("."), F.lit(","))
    return events.select("event_id", parse.parse_int(F.col("props")).alias("k"), parse.parse_float(shown).alias("v"))


@_query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN CAST(TRY_CAST(year(o_orderdate) || '-' || lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') || '-' || lpad(CAST(day(o_orderdate) % 5 + 27 AS VARCHAR), 2, '0') AS DATE) AS VARCHAR) ELSE '2024-13-40' END AS parsed FROM orders", "orders")
def iso_date_parse(orders: DataFrame) -> DataFrame:
    """Dates as day/month/year, some of days that a month does not have, and an ISO form that is not checked."""
    key, day = F.col("o_orderkey") % 3, F.col("o_orderdate")
    odd = F.concat_ws("-", (F.dayofmonth(day) % 5 + 27).cast("string"), F.month(day).cast("string"), F.year(day).cast("string"))
    shown = F.when(key == 0, F.date_format(day, "dd/MM/yyyy")).when(key == 1, odd).otherwise("2024-13-40")
    return orders.select("o_orderkey", parse.parse_iso_date(shown).alias("parsed"))


_MONTHS = ["janv.", "févr.", "mars", "Avril", "mai", "juin", "juil.", "Août", "sept.", "octobre", "nov.", "Décembre"]


@_query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS parsed FROM orders", "orders")
def french_date_parse(orders: DataFrame) -> DataFrame:
    month = F.element_at(F.array(*map(F.lit, _MONTHS)), F.month("o_orderdate"))
    month = F.when(F.col("o_orderkey") % 7 == 0, "brumaire").otherwise(month)
    shown = F.concat_ws(" ", F.dayofmonth("o_orderdate").cast("string"), month, F.year("o_orderdate").cast("string"))
    return orders.select("o_orderkey", parse.parse_iso_date(shown).alias("parsed"))


@_query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(l_quantity AS INTEGER) + 0.5 AS DOUBLE) AS low, CASE WHEN l_linenumber % 2 = 0 THEN CAST(CAST(l_quantity AS INTEGER) + 10 AS DOUBLE) END AS high FROM lineitem", "lineitem")
def reference_range_parse(lines: DataFrame) -> DataFrame:
    low = F.col("l_quantity").cast("int").cast("string")
    shown = F.when(F.col("l_linenumber") % 2 == 0, F.concat(low, F.lit(",5 - "), (F.col("l_quantity").cast("int") + 10).cast("string"))).otherwise(F.concat(F.lit("< "), low, F.lit(",5")))
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", parse.reference_range(shown).alias("r")).select("l_orderkey", "l_linenumber", "l_partkey", "r.low", "r.high")


@_query("SELECT event_id, CASE WHEN value < 20 THEN 'L' WHEN value > 80 THEN 'H' END AS flag FROM events", "events")
def flag_inference(events: DataFrame) -> DataFrame:
    return events.select("event_id", parse.infer_flag(F.col("value"), F.lit(20.0), F.lit(80.0)).alias("flag"))


@_query(
    """WITH n AS (SELECT event_id, CAST(floor(value * 10) AS BIGINT) AS v FROM events),
    s AS (SELECT event_id, v, unnest([{'p': 0, 'x': v / 1.0}, {'p': 1, 'x': v / 10.0}, {'p': 2, 'x': v / 100.0}], recursive := true) FROM n),
    b AS (SELECT event_id, v, p, x, (CASE WHEN x BETWEEN 5 AND 60 THEN 6.0 WHEN x BETWEEN 4 AND 72 THEN 2.0 ELSE 0.0 END) - greatest(5 - x, x - 60, 0) / 55.0 - (CASE WHEN p = 0 THEN 1 ELSE 0 END) AS score FROM s),
    r AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY score DESC, p) = 1)
    SELECT event_id, v > 60 AND p > 0 AND score >= 3 AS repaired, CASE WHEN v > 60 AND p > 0 AND score >= 3 THEN x ELSE v / 1.0 END AS number FROM r""",
    "events",
)
def numeric_repair(events: DataFrame) -> DataFrame:
    """Numbers that lost their decimal point, against the range 5 to 60."""
    raw = F.floor(F.col("value") * 10).cast("string")
    fixed = events.select("event_id", parse.repair_numeric(raw, F.lit(5.0), F.lit(60.0)).alias("r"))
    return fixed.select("event_id", "r.repaired", F.col("r.value_numeric").alias("number"))


_UNIT_CASES = ["mg/dl", "10°3/uL", "9", "g/L", " mmol / L ", "qualitatif", "furlongs", "mm{[Hg]"]


@_query(
    "WITH u(i, raw) AS (VALUES " + ", ".join(f"({i}, '{u}')" for i, u in enumerate(_UNIT_CASES)) + "), m(bad, good) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in dims.UNIT_REPAIRS.items()) + "), "
    "n AS (SELECT p_partkey, coalesce(good, replace(raw, ' ', '')) AS unit FROM part JOIN u ON i = p_partkey % 8 LEFT JOIN m ON bad = replace(raw, ' ', '')) "
    "SELECT p_partkey, unit, unit IN (" + ", ".join(f"'{u}'" for u in dims.KNOWN_UNITS) + ") AS known FROM n",
    "part",
)
def unit_canonicalisation(part: DataFrame) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, _UNIT_CASES)), (F.col("p_partkey") % 8 + 1).cast("int"))
    return part.select("p_partkey", parse.normalize_unit(raw).alias("unit"), parse.is_known_unit(raw).alias("known"))


@_query("WITH m AS (SELECT c_custkey, md5(CAST(c_custkey AS VARCHAR)) AS h FROM customer) SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN h ELSE substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) END AS id, c_custkey % 5 <> 0 AS valid FROM m", "customer")
def uuid_repair(customer: DataFrame) -> DataFrame:
    """Identifiers whose 0 and 1 were read as O and l; some without hyphens, which stay as they are."""
    digest = F.md5(F.col("c_custkey").cast("string").cast("binary"))
    spoilt = F.upper(F.translate(digest, "01", "ol"))
    parts = F.concat_ws("-", *(F.substring(spoilt, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    found = identity.canonical_uuid(F.when(F.col("c_custkey") % 5 == 0, digest).otherwise(parts))
    return customer.select("c_custkey", found.alias("id"), identity.is_uuid(found).alias("valid"))


@_query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN lower(c_mktsegment) ELSE c_mktsegment END AS raw, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS canonical, CASE WHEN c_custkey % 4 = 0 THEN 'missing' WHEN c_custkey % 4 = 1 THEN 'canonicalized' ELSE 'as_extracted' END AS status FROM customer", "customer")
def named_field_status(customer: DataFrame) -> DataFrame:
    key, segment = F.col("c_custkey") % 4, F.col("c_mktsegment")
    raw = F.when(key == 0, "  ").when(key == 1, F.lower(segment)).otherwise(segment)
    return customer.select("c_custkey", identity.named_field("specialty", raw).alias("f")).select("c_custkey", "f.raw", "f.canonical", F.col("f.normalization_status").alias("status"))


_BIRTH_SQL = "(DATE '1940-01-01' + CAST(o_custkey * 37 % 21000 AS INTEGER))"


def _birth() -> Column:
    return F.date_add(F.lit("1940-01-01").cast("date"), (F.col("o_custkey") * 37 % 21000).cast("int"))


@_query(f"SELECT o_orderkey, a AS age, CASE WHEN abs(a - 40) <= 1 THEN 'consistent' WHEN a IS NULL THEN 'unknown' ELSE 'inconsistent_with_birth_date' END AS status FROM (SELECT o_orderkey, CASE WHEN n >= 0 THEN n END AS a FROM (SELECT o_orderkey, CAST(year(o_orderdate) - year(b) - CASE WHEN month(o_orderdate) * 100 + day(o_orderdate) < month(b) * 100 + day(b) THEN 1 ELSE 0 END AS INTEGER) AS n FROM (SELECT *, {_BIRTH_SQL} AS b FROM orders)))", "orders")
def age_calendar(orders: DataFrame) -> DataFrame:
    aged = orders.select("o_orderkey", parse.calendar_age(_birth().cast("string"), F.col("o_orderdate").cast("date").cast("string")).alias("age"))
    return aged.withColumn("status", parse.age_status(F.lit(40), F.col("age")))


@_query(f"SELECT o_orderkey, CAST(greatest(0, CAST(floor(date_diff('day', {_BIRTH_SQL}, CAST(o_orderdate AS DATE)) / 365.25) AS INTEGER)) AS VARCHAR) AS age FROM orders", "orders")
def age_days(orders: DataFrame) -> DataFrame:
    return orders.select("o_orderkey", parse.age_in_days(_birth(), F.col("o_orderdate").cast("date")).alias("age"))


# -- confidence and geometry --------------------------------------------------------------


@_query("SELECT event_type, CASE WHEN value / 100 >= 0.85 THEN 'high' WHEN value / 100 >= 0.6 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM events GROUP BY 1, 2", "events")
def confidence_band(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type", confidence.band(F.col("value") / 100).alias("band")).agg(F.count("*").alias("n"))


@_query("SELECT doc_id, CASE WHEN s >= 85 THEN 'high' WHEN s >= 60 THEN 'medium' ELSE 'low' END AS band, s AS score FROM (SELECT doc_id, CAST(45 + CASE doc_id % 4 WHEN 0 THEN 35 WHEN 1 THEN 20 WHEN 2 THEN 5 ELSE 0 END + CASE WHEN n_chars > 80 THEN 5 ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN 5 ELSE 0 END AS INTEGER) AS s FROM documents)", "documents")
def block_confidence(docs: DataFrame) -> DataFrame:
    key = F.col("doc_id") % 4
    source = F.when(key == 0, "native").when(key == 1, "hybrid").when(key == 2, "ocr").otherwise("none")
    sources = F.when(F.col("doc_id") % 3 == 0, 2).otherwise(1)
    scored = docs.select("doc_id", confidence.block_confidence(source, F.lit("summary_block"), F.lit(False), F.lit(False), F.col("n_chars"), sources).alias("c"))
    return scored.select("doc_id", F.col("c.label").alias("band"), F.round(F.col("c.score") * 100).cast("int").alias("score"))


@_query("SELECT l_orderkey, min(l_quantity) AS x0, min(l_extendedprice) AS y0, max(l_quantity + 5) AS x1, max(l_extendedprice + 10) AS y1 FROM lineitem GROUP BY 1", "lineitem")
def bbox_envelope(lines: DataFrame) -> DataFrame:
    """Smallest box around an order's boxes."""
    boxed = F.struct(F.col("l_quantity").alias("x0"), F.col("l_extendedprice").alias("y0"), (F.col("l_quantity") + 5).alias("x1"), (F.col("l_extendedprice") + 10).alias("y1"))
    return lines.groupBy("l_orderkey").agg(geometry.envelope(boxed).alias("b")).select("l_orderkey", "b.*")


@_query("SELECT a.l_orderkey, a.l_linenumber AS first_line, b.l_linenumber AS second_line, count(*) AS pairs, CAST(sum(CAST(greatest(0, least(a.l_quantity, b.l_quantity) + 20 - greatest(a.l_quantity, b.l_quantity)) AS BIGINT)) AS BIGINT) AS overlap FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber WHERE abs(a.l_quantity - b.l_quantity) < 20 GROUP BY 1, 2, 3", "lineitem")
def bbox_overlap(lines: DataFrame) -> DataFrame:
    """Boxes of one order that overlap horizontally; all are 20 wide, so the ratio times 20 is the shared width."""
    boxed = lines.select("l_orderkey", "l_linenumber", F.struct(F.col("l_quantity").alias("x0"), F.lit(0.0).alias("y0"), (F.col("l_quantity") + 20).alias("x1"), F.lit(1.0).alias("y1")).alias("b"))
    other = boxed.select("l_orderkey", F.col("l_linenumber").alias("second_line"), F.col("b").alias("c"))
    near = boxed.join(other, "l_orderkey").where("l_linenumber < second_line").withColumn("ratio", geometry.horizontal_overlap(F.col("b"), F.col("c"))).where("ratio > 0")
    return near.groupBy("l_orderkey", F.col("l_linenumber").alias("first_line"), "second_line").agg(F.count("*").alias("pairs"), F.sum(F.round(F.col("ratio") * 20).cast("long")).alias("overlap"))


@_query("SELECT conv_id, md5(string_agg(text, ' ' ORDER BY turn)) AS body, count(*) AS turns FROM conversations GROUP BY 1", "conversations")
def reading_order_concat(turns: DataFrame) -> DataFrame:
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]), " ")
    return turns.groupBy("conv_id").agg(F.md5(ordered.cast("binary")).alias("body"), F.count("*").alias("turns"))


# -- relational ---------------------------------------------------------------------------


@_query("SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) = 1", "orders")
def latest_per_key(orders: DataFrame) -> DataFrame:
    return rel.latest(orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate"), ["o_custkey"], "o_orderdate", "o_orderkey").drop("o_orderdate")


@_query("SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS position FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 8)", "events")
def last_n_series(events: DataFrame) -> DataFrame:
    return rel.last_of_series(events.select("user_id", "event_id", "ts"), ["user_id"], "ts", "event_id", 8).drop("ts")


@_query("SELECT user_id, event_type, n AS rows FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) >= 3) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1", "events")
def modal_category(events: DataFrame) -> DataFrame:
    return rel.modal(events, ["user_id"], "event_type", 3)


@_query("SELECT c_custkey AS patient, c_name FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 10) JOIN customer ON c_custkey = o_custkey UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey = 7", "orders", "customer")
def top_n_entities(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """The ten customers with the most orders, and one that is asked for."""
    patients = customer.select(F.col("c_custkey").alias("patient"), "c_name")
    observed = orders.select(F.col("o_custkey").alias("patient"))
    return reports.choose_patients(patients, observed, 10).union(reports.choose_patients(patients, observed, 10, patient="7"))


@_query("SELECT event_id, user_id FROM (SELECT *, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id) AS n FROM events) WHERE event_type = 'purchase' OR n < 12", "events")
def conditional_pool(events: DataFrame) -> DataFrame:
    return rel.preferred_pool(events.select("event_id", "user_id", "event_type"), ["user_id"], F.col("event_type") == "purchase", 12).select("event_id", "user_id")


@_query("SELECT o_orderkey, coalesce(n_name, 'Unknown') AS nation, coalesce(c_mktsegment, '-') AS segment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey", "orders", "customer", "nation")
def lookup_with_default(orders: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    known = customer.where("c_custkey % 3 <> 0").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "c_mktsegment")
    found = rel.look_up(orders.select("o_orderkey", "o_custkey"), known, [("o_custkey", "c_custkey")], {"n_name": "Unknown", "c_mktsegment": "-"})
    return found.select("o_orderkey", F.col("n_name").alias("nation"), F.col("c_mktsegment").alias("segment"))


@_query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 400000)", "customer", "orders")
def semi_selected(customer: DataFrame, orders: DataFrame) -> DataFrame:
    chosen = orders.where("o_orderstatus = 'P' and o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return customer.join(chosen, "c_custkey", "left_semi").select("c_custkey", "c_name")


@_query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 400000)", "customer", "orders")
def anti_missing(customer: DataFrame, orders: DataFrame) -> DataFrame:
    chosen = orders.where("o_orderstatus = 'P' and o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return customer.join(chosen, "c_custkey", "left_anti").select("c_custkey", "c_name")


_KEYWORDS = [("ring", 1), ("red", 2), ("bolt", 3), ("i", 4)]


@_query("SELECT p_partkey, " + "CASE " + " ".join(f"WHEN contains(p_name, '{k}') THEN {n}" for k, n in _KEYWORDS) + " END AS rule FROM part", "part")
def keyword_theta_join(part: DataFrame) -> DataFrame:
    """The first rule whose keyword the name contains: an ordered choice, so no join is needed."""
    rule = F.coalesce(*(F.when(F.contains("p_name", F.lit(k)), F.lit(n)) for k, n in _KEYWORDS))
    return part.select("p_partkey", rule.alias("rule"))


_RANKED = "CASE l_returnflag WHEN 'N' THEN 3 WHEN 'A' THEN 2 ELSE 1 END DESC, CASE WHEN l_discount > 0 THEN 1 ELSE 0 END + CASE WHEN l_tax > 0 THEN 1 ELSE 0 END DESC, l_orderkey, l_linenumber"


def _line_rank() -> list:
    priority = F.when(F.col("l_returnflag") == "N", 3).when(F.col("l_returnflag") == "A", 2).otherwise(1)
    complete = (F.col("l_discount") > 0).cast("int") + (F.col("l_tax") > 0).cast("int")
    return [priority, complete, -F.col("l_orderkey"), -F.col("l_linenumber")]


@_query(f"SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, n - 1 AS losers FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY {_RANKED}) AS r, count(*) OVER (PARTITION BY l_partkey, l_suppkey) AS n FROM lineitem) WHERE r = 1", "lineitem")
def ranked_dedup(lines: DataFrame) -> DataFrame:
    """The canonical line of each part and supplier; the count of the others."""
    rows = lines.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_returnflag", "l_discount", "l_tax")
    rows = rows.withColumn("ordinal", F.struct("l_orderkey", "l_linenumber"))
    kept = rel.ranked_dedup(rows, ["l_partkey", "l_suppkey"], _line_rank(), "ordinal", F.struct("l_orderkey", "l_linenumber"))
    return kept.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", F.size("duplicate_sources").cast("long").alias("losers"))


@_query("SELECT l_returnflag, count(*) AS raw_rows, count(DISTINCT (l_partkey, l_suppkey)) AS canonical_rows, count(*) - count(DISTINCT (l_partkey, l_suppkey)) AS removed FROM lineitem GROUP BY 1", "lineitem")
def dedup_stats(lines: DataFrame) -> DataFrame:
    counts = lines.groupBy("l_returnflag").agg(F.count("*").alias("raw_rows"), F.count_distinct("l_partkey", "l_suppkey").alias("canonical_rows"))
    return counts.withColumn("removed", F.col("raw_rows") - F.col("canonical_rows"))


@_query("SELECT l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AS known, count(*) AS n, count(DISTINCT l_orderkey) AS signatures FROM lineitem GROUP BY 1", "lineitem", "orders")
def signature_membership(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """Lines whose order is among the finished ones, and those whose is not."""
    finished = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    known = lines.join(finished, "l_orderkey", "left_semi").select("l_orderkey").withColumn("known", F.lit(True))
    unknown = lines.join(finished, "l_orderkey", "left_anti").select("l_orderkey").withColumn("known", F.lit(False))
    return known.union(unknown).groupBy("known").agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("signatures"))


@_query("SELECT doc_id, quality AS value, 1 AS tier FROM labels UNION ALL SELECT doc_id, CASE WHEN n_chars > 500 THEN 1 ELSE 0 END, 2 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)", "labels", "documents")
def fallback_union(labels: DataFrame, docs: DataFrame) -> DataFrame:
    guessed = docs.select("doc_id", (F.col("n_chars") > 500).cast("int").alias("value"))
    return rel.fallback_union([labels.select("doc_id", F.col("quality").alias("value")), guessed], "doc_id")


@_query(
    """WITH s AS (SELECT user_id, list_sort(list_distinct(list(event_type) FILTER (ts >= TIMESTAMP '2024-01-29'))) AS f, list_sort(list_distinct(list(event_type) FILTER (ts < TIMESTAMP '2024-01-03'))) AS e FROM events GROUP BY 1),
    t AS (SELECT user_id, coalesce(f, []) AS f, coalesce(e, []) AS e FROM s)
    SELECT user_id, CASE WHEN len(e) = 0 THEN 'consistent' WHEN len(f) = 0 THEN 'needs_review' WHEN f = e THEN 'consistent' WHEN list_has_any(f, e) THEN 'partial_overlap' ELSE 'discordant_findings' END AS status FROM t""",
    "events",
)
def entity_set_consistency(events: DataFrame) -> DataFrame:
    """Kinds of events of the last days against those of the first days, per user."""
    sets = events.groupBy("user_id").agg(
        F.collect_set(F.when(F.col("ts") >= F.lit("2024-01-29").cast("timestamp_ntz"), F.col("event_type"))).alias("f"), F.collect_set(F.when(F.col("ts") < F.lit("2024-01-03").cast("timestamp_ntz"), F.col("event_type"))).alias("e")
    )
    return sets.select("user_id", rel.set_agreement(F.col("f"), F.col("e")).alias("status"))


@_query("SELECT o_orderkey, 'o_orderpriority=' || o_orderpriority || ',o_orderstatus=' || o_orderstatus AS fields FROM orders", "orders")
def kv_pivot(orders: DataFrame) -> DataFrame:
    """Rows to field/value pairs and back to one map per order."""
    pairs = rel.unpivot_pairs(orders, ["o_orderkey"], ["o_orderstatus", "o_orderpriority"]).withColumn("at", F.lit(1))
    maps = rel.pairs_to_map(pairs, ["o_orderkey"], "field", "value", "at")
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return maps.select("o_orderkey", shown.alias("fields"))


# -- quality rules ------------------------------------------------------------------------

_ISSUES_SQL = """
  SELECT o_orderkey AS doc_id, 1 AS rule_no, 'FAIL' AS severity, 'missing_results' AS code FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
  UNION ALL SELECT o_orderkey, 2, 'FAIL', 'invalid_report_date' FROM orders WHERE o_totalprice > 490000
  UNION ALL SELECT l_orderkey, 3, 'WARNING', 'invalid_reference_range' FROM lineitem WHERE l_discount > l_tax AND l_quantity > 48
  UNION ALL SELECT l_orderkey, 4, 'WARNING', 'duplicate_dedup_keys' FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1"""


def _issues(orders: DataFrame, lines: DataFrame) -> DataFrame:
    id_ = F.col("o_orderkey").alias("doc_id")
    keyed = lines.withColumnRenamed("l_orderkey", "doc_id")
    return qa.issues(
        [
            qa.rule(1, "FAIL", "missing_results", orders.select(id_).join(keyed.select("doc_id"), "doc_id", "left_anti")),
            qa.rule(2, "FAIL", "invalid_report_date", orders.where("o_totalprice > 490000").select(id_)),
            qa.rule(3, "WARNING", "invalid_reference_range", keyed.where("l_discount > l_tax and l_quantity > 48")),
            qa.rule(4, "WARNING", "duplicate_dedup_keys", keyed.groupBy("doc_id", "l_linenumber").count().where("count > 1").select("doc_id").distinct()),
        ]
    )


@_query(f"SELECT doc_id, rule_no, severity, code, count(*) AS n FROM ({_ISSUES_SQL}) GROUP BY ALL", "orders", "lineitem")
def qa_issues(orders: DataFrame, lines: DataFrame) -> DataFrame:
    return _issues(orders, lines).groupBy("doc_id", "rule_no", "severity", "code").agg(F.count("*").alias("n"))


@_query(f"WITH i AS ({_ISSUES_SQL}), d AS (SELECT o_orderkey, count(*) FILTER (severity = 'FAIL') AS f, count(*) FILTER (severity = 'WARNING') AS w FROM orders LEFT JOIN i ON doc_id = o_orderkey GROUP BY 1) SELECT CASE WHEN f > 0 THEN 'FAIL' WHEN w > 0 THEN 'WARNING' ELSE 'PASS' END AS status, count(*) AS documents FROM d GROUP BY 1", "orders", "lineitem")
def qa_status(orders: DataFrame, lines: DataFrame) -> DataFrame:
    judged = qa.evaluate(orders.select(F.col("o_orderkey").alias("doc_id")), _issues(orders, lines))
    return judged.groupBy("status").agg(F.count("*").alias("documents"))


@_query(f"WITH i AS ({_ISSUES_SQL}) SELECT o_orderkey AS doc_id, CAST(greatest(0, 100 - coalesce(sum(CASE severity WHEN 'FAIL' THEN 20 WHEN 'WARNING' THEN 10 END), 0)) AS INTEGER) AS score FROM orders LEFT JOIN i ON doc_id = o_orderkey GROUP BY 1", "orders", "lineitem")
def quality_score(orders: DataFrame, lines: DataFrame) -> DataFrame:
    return qa.evaluate(orders.select(F.col("o_orderkey").alias("doc_id")), _issues(orders, lines)).select("doc_id", "score")


@_query(f"WITH i AS ({_ISSUES_SQL}), d AS (SELECT o_orderkey, count(*) FILTER (severity = 'FAIL') AS f, count(*) FILTER (severity = 'WARNING') AS w FROM orders LEFT JOIN i ON doc_id = o_orderkey GROUP BY 1) SELECT count(*) AS documents, count(*) FILTER (f = 0 AND w = 0) AS pass, count(*) FILTER (f = 0 AND w > 0) AS warning, count(*) FILTER (f > 0) AS fail FROM d", "orders", "lineitem")
def qa_summary(orders: DataFrame, lines: DataFrame) -> DataFrame:
    return qa.summarize(qa.evaluate(orders.select(F.col("o_orderkey").alias("doc_id")), _issues(orders, lines)))


@_query("SELECT user_id, count(*) AS scores, count(DISTINCT CAST(floor(value / 50) AS INTEGER)) AS kinds, count(*) >= 6 AND count(DISTINCT CAST(floor(value / 50) AS INTEGER)) <= 2 AS uniform FROM events GROUP BY 1", "events")
def uniform_scores(events: DataFrame) -> DataFrame:
    counts = events.groupBy("user_id").agg(F.count("*").alias("scores"), F.count_distinct(F.floor(F.col("value") / 50)).alias("kinds"))
    return counts.withColumn("uniform", (F.col("scores") >= 6) & (F.col("kinds") <= 2))


@_query("SELECT conv_id, turn, role, next_role, length(next_text) AS next_chars FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'", "conversations")
def turn_pairs(turns: DataFrame) -> DataFrame:
    """A turn of the user with the answer after it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    paired = turns.select("conv_id", "turn", "role", F.lead("role").over(w).alias("next_role"), F.length(F.lead("text").over(w)).cast("long").alias("next_chars"))
    return paired.where("role = 'user' and next_role = 'assistant'")


@_query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value FROM events", "events")
def json_sanitise(events: DataFrame) -> DataFrame:
    odd = F.when(F.col("event_id") % 10 == 0, float("nan")).when(F.col("event_id") % 5 == 0, float("inf")).otherwise(F.col("value"))
    return events.select("event_id", qa.finite(odd).alias("value"))


@_query("SELECT severity, code, grouping_id(severity, code) AS level, count(*) AS n FROM (" + _ISSUES_SQL + ") GROUP BY ROLLUP (severity, code)", "orders", "lineitem")
def qa_rollup(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Issues by severity and code with totals."""
    rolled = _issues(orders, lines).rollup("severity", "code").agg(F.grouping_id("severity", "code").alias("level"), F.count("*").alias("n"))
    return rolled.select("severity", "code", "level", "n")


# -- report rows --------------------------------------------------------------------------


@_query("SELECT event_id, CASE event_type WHEN 'click' THEN '70 - 99' WHEN 'view' THEN '0 - 200' WHEN 'error' THEN '12 - 17.5' ELSE 'Context dependent' END AS reference, CASE event_type WHEN 'click' THEN CASE WHEN value < 70 THEN 'L' WHEN value > 99 THEN 'H' ELSE 'N' END WHEN 'view' THEN CASE WHEN value < 0 THEN 'L' WHEN value > 200 THEN 'H' ELSE 'N' END WHEN 'error' THEN CASE WHEN value < 12 THEN 'L' WHEN value > 17.5 THEN 'H' ELSE 'N' END ELSE '' END AS flag FROM events", "events")
def reference_rules(events: DataFrame) -> DataFrame:
    """Reference range and flag by the first rule whose keyword a description contains."""
    names = {"click": "Glucose [Mass/volume]", "view": "HDL Cholesterol", "error": "Hemoglobin A1c"}
    described = F.coalesce(parse.look_up(names, F.col("event_type")), F.lit("Something else"))
    return events.select("event_id", reports.infer_reference(described, F.col("value").cast("string")).alias("r")).select("event_id", "r.reference", "r.flag")


@_query("SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS INTEGER) AS row_no FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) = 1) QUALIFY row_no <= 3", "events")
def latest_distinct_rows(events: DataFrame) -> DataFrame:
    """Per user the newest event of each kind, the newest three of those."""
    single = rel.latest(events.select("user_id", "event_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "event_id")
    numbered = single.withColumn("row_no", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id")))
    return numbered.where("row_no <= 3").select("user_id", "event_id", "row_no")


# -- more relational operators --------------------------------------------------------------


@_query("SELECT user_id, session, min(event_id) AS first_event, count(*) AS events FROM (SELECT *, CAST(sum(CASE WHEN gap IS NULL OR gap > INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)) GROUP BY 1, 2", "events")
def sessions(events: DataFrame) -> DataFrame:
    """Runs of a user's events without a pause of over six hours (gaps and islands)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pause = F.col("ts") - F.lag("ts").over(w) > F.expr("INTERVAL '6' HOUR")
    flagged = events.select("user_id", "event_id", "ts", F.coalesce(pause, F.lit(True)).cast("long").alias("_new"))
    runs = flagged.withColumn("session", F.sum("_new").over(w))
    return runs.groupBy("user_id", "session").agg(F.min("event_id").alias("first_event"), F.count("*").alias("events"))


@_query("SELECT event_id, CASE WHEN next_type = 'purchase' THEN 'before' WHEN previous_type = 'purchase' THEN 'after' ELSE 'other' END AS position FROM (SELECT event_id, lead(event_type) OVER w AS next_type, lag(event_type) OVER w AS previous_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))", "events")
def neighbour_labels(events: DataFrame) -> DataFrame:
    """What a row means by the label of the next or the previous one."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    position = F.when(F.lead("event_type").over(w) == "purchase", "before").when(F.lag("event_type").over(w) == "purchase", "after").otherwise("other")
    return events.select("event_id", position.alias("position"))


@_query("SELECT o_custkey, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS cheapest, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS dearest FROM orders GROUP BY 1", "orders")
def argmin_argmax(orders: DataFrame) -> DataFrame:
    rank = F.struct("o_totalprice", "o_orderkey")
    return orders.groupBy("o_custkey").agg(F.min_by("o_orderkey", rank).alias("cheapest"), F.max_by("o_orderkey", rank).alias("dearest"))


@_query("SELECT user_id, arg_min(event_id, (ts, event_id)) FILTER (event_type = 'error' AND value > 50) AS first_error FROM events GROUP BY 1", "events")
def first_match(events: DataFrame) -> DataFrame:
    return rel.first_match(events, ["user_id"], (F.col("event_type") == "error") & (F.col("value") > 50), ["ts", "event_id"], F.col("event_id"), "first_error")


@_query("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem) WHERE n <= 2", "lineitem")
def limit_per_group(lines: DataFrame) -> DataFrame:
    rows = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return rel.top_per_group(rows, ["l_orderkey"], [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")], 2).select("l_orderkey", "l_linenumber", "l_partkey")


@_query("WITH k AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS seen FROM events WHERE ts < TIMESTAMP '2024-01-05' GROUP BY 1) SELECT user_id, array_to_string(list_filter(['click', 'error', 'purchase', 'signup', 'view'], lambda x: NOT list_contains(seen, x)), ',') AS missing, list_has_all(seen, ['click', 'view']) AS has_both, list_has_any(seen, ['signup', 'error']) AS has_any FROM k", "events")
def required_minus_present(events: DataFrame) -> DataFrame:
    """Required names that are absent, a subset test and an overlap test."""
    seen = events.where(F.col("ts") < F.lit("2024-01-05").cast("timestamp_ntz")).groupBy("user_id").agg(F.collect_set("event_type").alias("seen"))
    some = lambda *names: F.array(*map(F.lit, names))
    missing = F.array_join(F.array_sort(F.array_except(some("click", "error", "purchase", "signup", "view"), F.col("seen"))), ",")
    return seen.select("user_id", missing.alias("missing"), (F.size(F.array_except(some("click", "view"), F.col("seen"))) == 0).alias("has_both"), F.arrays_overlap("seen", some("signup", "error")).alias("has_any"))


@_query("SELECT 'customer' AS kind, c_custkey AS id, c_name AS name, c_acctbal > 5000 AS rich FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, NULL FROM supplier", "customer", "supplier")
def union_assets(customer: DataFrame, supplier: DataFrame) -> DataFrame:
    """Two kinds of rows in one relation; a column that one lacks is null there."""
    one = customer.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), (F.col("c_acctbal") > 5000).alias("rich"))
    return one.unionByName(supplier.select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), allowMissingColumns=True)


@_query("SELECT n_nationkey AS doc_id, coalesce(c, 0) AS customers, coalesce(s, 0) AS suppliers, coalesce(f, '') AS first_supplier FROM nation LEFT JOIN (SELECT c_nationkey, CAST(count(*) AS INTEGER) AS c FROM customer GROUP BY 1) ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, CAST(count(*) AS INTEGER) AS s, arg_min(s_name, s_suppkey) AS f FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey", "nation", "customer", "supplier")
def grouped_left_joins(nation: DataFrame, customer: DataFrame, supplier: DataFrame) -> DataFrame:
    """Nations as pages, customers and suppliers as their assets: each kind is grouped before it is joined, so children never multiply each other."""
    page = F.lit(1).alias("page_number")
    assets = {"c": customer.select(F.col("c_nationkey").alias("doc_id"), page, "c_custkey"), "s": supplier.select(F.col("s_nationkey").alias("doc_id"), page, "s_suppkey", "s_name")}
    found = documents.by_page(nation.select(F.col("n_nationkey").alias("doc_id"), page), assets)
    return found.select("doc_id", F.size("c").alias("customers"), F.size("s").alias("suppliers"), F.coalesce(F.get("s", F.lit(0))["s_name"], F.lit("")).alias("first_supplier"))


@_query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 45", "lineitem")
def distinct_pairs(lines: DataFrame) -> DataFrame:
    return lines.where("l_quantity > 45").select("l_partkey", "l_suppkey").dropDuplicates()


@_query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS patient, CAST(c_nationkey AS VARCHAR) AS age, c_mktsegment AS sexe FROM customer", "customer")
def label_spans(customer: DataFrame) -> DataFrame:
    """Values between labels of one running text; a label that is not there has none."""
    shown = F.concat(F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Patient: "), "c_name", F.lit(" "))).otherwise(""), F.lit("AGE "), F.col("c_nationkey").cast("string"), F.lit(" Sexe : "), "c_mktsegment")
    found = customer.select("c_custkey", text.find_labels(shown, ["Patient", "Age", "Sexe"]).alias("f"))
    get = lambda k: F.try_element_at("f", F.lit(k))
    return found.select("c_custkey", get("Patient").alias("patient"), get("Age").alias("age"), get("Sexe").alias("sexe"))


# a number as whole hundredths; halves are rounded to the even neighbour, at the place that its size asks for
_HUNDREDTHS = "CAST(round(o_totalprice * 100) AS BIGINT)"
_ROUNDED = "(c // {p} + CASE WHEN 2 * (c % {p}) > {p} OR (2 * (c % {p}) = {p} AND (c // {p}) % 2 = 1) THEN 1 ELSE 0 END)"


@_query(
    f"""SELECT o_orderkey, CASE WHEN c >= 10000 OR c % 100 = 0 THEN CAST({_ROUNDED.format(p=100)} AS VARCHAR) WHEN c >= 1000 THEN regexp_replace(CAST(CAST({_ROUNDED.format(p=10)} AS DECIMAL(18, 1)) / 10 AS VARCHAR), '[.]?0*$', '')
    ELSE regexp_replace(CAST(c // 100 AS VARCHAR) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0'), '0+$', '') END AS result,
    strftime(o_orderdate, '%d %b %Y') AS shown, CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8)) AS BIGINT) AS seed FROM (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN {_HUNDREDTHS} % 1000 WHEN 1 THEN {_HUNDREDTHS} % 10000 ELSE {_HUNDREDTHS} END AS c FROM orders)""",
    "orders",
)
def report_formats(orders: DataFrame) -> DataFrame:
    """Numbers of every size, dates and seeds as reports show them."""
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    part = F.when(F.col("o_orderkey") % 4 == 0, cents % 1000).when(F.col("o_orderkey") % 4 == 1, cents % 10000).otherwise(cents)
    shown = F.concat(F.floor(part / 100).cast("string"), F.lit("."), F.lpad((part % 100).cast("string"), 2, "0"))
    return orders.select("o_orderkey", reports.format_result(shown).alias("result"), reports.format_date(F.col("o_orderdate")).alias("shown"), reports.seed_from_text(F.col("o_orderkey").cast("string")).alias("seed"))


_CODES = {"FURNITURE": ("Féminin", "F"), "MACHINERY": ("male", "M"), "HOUSEHOLD": ("?", None)}
_VISITS = {"FURNITURE": ("externe", "External"), "MACHINERY": ("Urgent care", "Urgent care"), "HOUSEHOLD": ("other", None)}


@_query("SELECT c_custkey, CASE c_mktsegment WHEN 'FURNITURE' THEN 'F' WHEN 'MACHINERY' THEN 'M' END AS sex, CASE c_mktsegment WHEN 'FURNITURE' THEN 'External' WHEN 'MACHINERY' THEN 'Urgent care' END AS encounter, upper(replace(c_name, '#', '')) AS report_id FROM customer", "customer")
def coded_fields(customer: DataFrame) -> DataFrame:
    """Dictionary lookups by label, null for what is not in the dictionary."""
    said = lambda d: parse.look_up({k: v[0] for k, v in d.items()}, F.col("c_mktsegment"))
    return customer.select("c_custkey", identity.sex(said(_CODES)).alias("sex"), identity.encounter_type(said(_VISITS)).alias("encounter"), identity.report_id(F.col("c_name")).alias("report_id"))


@_query("SELECT event_type, count(*) FILTER (value >= 60) AS scored, CAST(sum(CAST(floor(value) AS BIGINT)) FILTER (value >= 60) AS BIGINT) AS total FROM events GROUP BY 1", "events")
def positive_mean_parts(events: DataFrame) -> DataFrame:
    """Parts of a mean over the values that count only."""
    counts = F.col("value") >= 60
    return events.groupBy("event_type").agg(F.count_if(counts).alias("scored"), F.sum(F.when(counts, F.floor("value"))).alias("total"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from chartloom import rendered  # noqa: F401  registers its queries
    from chartloom.plans import catalogue

    return _QUERIES | catalogue.queries()


def oracle_sql() -> dict[str, str]:
    from chartloom import rendered  # noqa: F401

    return dict(_SQL)
