"""One query per corpus operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.llm import fill_in_middle, hamming, html_text, licenses, mixing, pieces, pii, prefix_trie, quality, repeats, sharding, simhash, token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints and components of all documents."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest sign codes, among all embeddings, of every embedding whose id is divisible by 50."""
    codes = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), hamming.sign_code(F.col("embedding")).alias("code"))
    asked = codes.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    return hamming.top_k(codes, asked, k=10).select("query_id", "rank", F.col("id").alias("vec_id"), "distance")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License of every document, its own or that of the nearest directory.

    The table has no paths: a document lies at source/lang/number of its 64 ids/id.
    """
    path = F.concat_ws("/", "source", "lang", (F.col("doc_id") / 64).cast("bigint").cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    files = _table(spark, sf_dir, "documents").select("doc_id", "text", path.alias("path"))
    return licenses.scan(files)


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 50-byte strings that smaller documents have."""
    found = repeats.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    """Digests of ids and decoded text of all documents."""
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    coded = pieces.encode_and_decode(_table(spark, sf_dir, "documents"), model_path, keep=["doc_id"])
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix of all documents: 150 % of all words, sources weighing 5, 2, 1 in turn, at most twice each."""
    found = mixing.mixture(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2)
    return found.select("doc_id", "size", "source_size", "target", "taken", "source")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, own rules and host verdicts (host: source) of all documents."""
    found = quality.with_verdicts(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: Key of the query's pseudonyms; callers of the operator pass their own secret.
PSEUDONYM_KEY = "query-key"


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms for personal data and secrets."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.with_pseudonyms(docs, PSEUDONYM_KEY, count_column="n_replaced")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes, equal texts together."""
    found = sharding.assign_shards(_table(spark, sf_dir, "documents"), shards=40)
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return found.select("doc_id", "size", "text_crc32", law, "shard", F.col("slot").cast("long").alias("slot"), grown)


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    found = html_text.with_main_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), text_column="text")
    return found.select("page_id", "url", "text", "n_chars")


def op11_tokens(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """Token counts of all documents."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    counted = token_counts.with_token_counts(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path, limit=512)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all conversations."""
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-middle form of all documents, with digests of what comes out and of the text rebuilt from it."""
    made = fill_in_middle.with_fill_in_middle(_table(spark, sf_dir, "documents").select("doc_id", "text"), seed=42, cut_percent=50, spm_percent=80)
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(back).alias("restored_sha256"))


OP2_SQL = """
WITH pairs AS (
  SELECT q.vec_id AS query_id, r.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.embedding, r.embedding), lambda x: CAST((x[1] > 0) <> (x[2] > 0) AS INTEGER))) AS INTEGER) AS distance
  FROM embeddings q, embeddings r WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank, vec_id, distance FROM pairs
)
SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 10
"""


OP7_SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, i, list_slice(words, i, i + 7) AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) > 8)
), repeated AS (
  SELECT doc_id, unnest(places) AS i FROM (SELECT doc_id, list(i) AS places FROM windows GROUP BY doc_id, gram HAVING count(*) > 1)
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM repeated, (SELECT unnest(range(8)) AS k) GROUP BY doc_id
), counts AS (
  SELECT w.doc_id, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN covered USING (doc_id)
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * n_lines AS more_failed
  FROM counts
), hosts AS (
  SELECT source, count(*) AS d, count(*) FILTER (base_failed OR more_failed) AS f FROM judged GROUP BY 1
), sums AS (
  SELECT sum(f) / sum(d) AS m, count(*) AS k, sum(d) AS d, sum(d * (f / d) * (f / d)) / sum(d) AS q FROM hosts
), prior AS (
  SELECT m, greatest(1.0, least(1e6, m * (1 - m) / greatest(q - m * m - m * (1 - m) * k / d, 1e-9) - 1)) AS weight FROM sums
), verdicts AS (
  SELECT source, (f + m * weight) / (d + weight) <= least(0.8, m + 0.35 + 3 * sqrt(m * (1 - m) / (weight + 1))) AS host_kept FROM hosts, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_kept AS kept
FROM judged JOIN verdicts ON judged.source IS NOT DISTINCT FROM verdicts.source
"""


OP12_SQL = """
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x FROM conversations WHERE conv_id IS NOT NULL
), whole AS (
  SELECT conv_id, list(x ORDER BY n) AS l FROM turns GROUP BY 1
), hashed AS (
  -- CRC-32 bit by bit over the digits of the id
  SELECT conv_id, l, CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS UBIGINT))),
    lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda s, i: xor(s >> 1, CASE WHEN s % 2 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))), 4294967295::UBIGINT) % 6 AS INTEGER) AS h
  FROM whole
), rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.l[1:h], []), c.l[h + 1:]) AS s FROM hashed c LEFT JOIN whole b ON b.conv_id = c.conv_id - c.conv_id % 100
), members AS (
  SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM rebuilt
), nodes AS (
  SELECT d, s[1:d] AS node, min(conv_id) AS conv_id, count(*) AS n, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(s) = d) AS ends FROM members GROUP BY 1, 2
), marked AS (
  SELECT a.*, CASE WHEN d = 0 THEN 0 ELSE (n - 1) * length(node[d].t) END AS saved, (SELECT count(*) FROM nodes b WHERE b.d = a.d + 1 AND b.node[1:a.d] = a.node) AS children FROM nodes a
)
SELECT a.conv_id, a.d AS depth, max(p.conv_id) AS parent_conv_id, any_value(a.n) AS n_convs, any_value(a.children) AS n_children, CAST(count(*) FILTER (b.children = 0) AS BIGINT) AS n_leaves, CAST(sum(b.saved) AS BIGINT) AS saved_tokens,
       sha256(coalesce(any_value(a.ends), '')) AS ends_sha256
FROM marked a JOIN marked b ON b.d >= a.d AND b.node[1:a.d] = a.node LEFT JOIN nodes p ON p.d = a.d - 1 AND p.node = a.node[1:a.d - 1]
GROUP BY a.conv_id, a.d, a.node
"""


OP13_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x
  FROM documents
), hashed AS (
  SELECT doc_id, text, tokens, CAST(len(tokens) AS BIGINT) AS n, list_transform(range(0, 4), lambda i: CAST('0x' || substr(x, 8 * i + 1, 8) AS BIGINT)) AS h FROM cut
), formed AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM hashed
), parts AS (
  SELECT *, array_to_string(tokens[1:a], '') AS prefix, array_to_string(tokens[a + 1:b], '') AS middle, array_to_string(tokens[b + 1:], '') AS suffix FROM formed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""


def _op3_sql() -> str:
    # every document's path has directories, so a directory's files are those whose path begins with it
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({i}, '{name}', {quoted(body)})" for i, (name, body) in enumerate(licenses.TEMPLATES))
    words = lambda x: f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    spaced = lambda x: f"len(regexp_extract_all({x}, '[^\\x20\\x09-\\x0D]+'))"
    n = len(licenses.TEMPLATES)
    cut = "x"
    for pattern, stays in licenses.CUTS:
        cut = f"regexp_replace({cut}, {quoted(pattern)}, {quoted(stays)}, 'g')".replace("\\n", "' || chr(10) || '")
    return f"""
WITH templates(template, license, body) AS (VALUES {values}),
template_counts AS (SELECT template, license, token, count(*) AS tf FROM (SELECT template, license, unnest({words('body')}) AS token FROM templates) GROUP BY ALL),
idf AS (SELECT token, ln({1 + n}.0 / (1 + count(DISTINCT template))) + 1 AS idf FROM template_counts GROUP BY 1),
weights AS (SELECT template, license, token, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY template)) AS weight FROM template_counts JOIN idf USING (token)),
files AS (SELECT doc_id, text, source || '/' || lang || '/' || CAST(doc_id // 64 AS VARCHAR) || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path FROM documents),
lines AS (
  SELECT doc_id, path, {spaced('text')} AS n_words, list_transform(string_split(text, chr(10)), lambda l: regexp_replace(l, {quoted(licenses.COMMENT_MARKS)}, '', 'g')) AS l
  FROM files WHERE regexp_matches(text, '{licenses.CUES}')
),
parted AS (SELECT doc_id, path, n_words, flatten(list_transform(l, lambda x: CASE WHEN length(x) > {licenses.WRAPPED} THEN string_split({cut}, chr(10)) ELSE [x] END)) AS l FROM lines),
near AS (SELECT doc_id, path, n_words, l, unnest(list_filter(range(1, len(l) + 1), lambda i: regexp_matches(l[i], '{licenses.CUES}'))) AS i FROM parted),
stated AS (
  SELECT DISTINCT doc_id, path, n_words, trim(s, ' ') AS statement FROM (
    SELECT doc_id, path, n_words, unnest([m, CASE WHEN short THEN concat_ws(' ', b, m) END, CASE WHEN short THEN concat_ws(' ', m, a) END, CASE WHEN short THEN concat_ws(' ', b, m, a) END]) AS s
    FROM (SELECT *, l[i] AS m, length(l[i]) <= {licenses.WRAPPED} AS short, CASE WHEN i > 1 AND length(l[i - 1]) <= {licenses.WRAPPED} THEN l[i - 1] END AS b, CASE WHEN length(l[i + 1]) <= {licenses.WRAPPED} THEN l[i + 1] END AS a FROM near)
    UNION ALL SELECT doc_id, path, n_words, unnest(list_filter(l, lambda x: length(x) > {licenses.WRAPPED} AND regexp_matches(x, '{licenses.CUES}'))) FROM lines
  )
),
counts AS (SELECT statement, token, count(*) AS tf FROM (SELECT statement, unnest({words('statement')}) AS token FROM (SELECT DISTINCT statement FROM stated)) GROUP BY ALL),
own AS (SELECT statement, token, tf * coalesce(idf, ln({1 + n}.0) + 1) AS w FROM counts LEFT JOIN idf USING (token)),
norms AS (SELECT statement, sqrt(sum(w * w)) AS norm FROM own GROUP BY 1),
scored AS (
  SELECT statement, license, round(sum(w * weight) / any_value(norm), 9) AS cosine FROM own JOIN weights USING (token) JOIN norms USING (statement) GROUP BY statement, template, license
  QUALIFY row_number() OVER (PARTITION BY statement ORDER BY cosine DESC, license) = 1
),
hits AS (
  SELECT doc_id, path, license, cosine, {spaced('statement')} >= {licenses.MIN_SHARE} * n_words AS mostly FROM stated JOIN scored USING (statement) WHERE cosine >= {licenses.MIN_COSINE}
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, license, {spaced('statement')} DESC) = 1
),
dirs AS (
  SELECT regexp_replace(path, '/?[^/]*$', '') AS license_dir, license AS dir_license, cosine AS dir_cosine FROM hits WHERE mostly
  QUALIFY row_number() OVER (PARTITION BY license_dir ORDER BY cosine DESC, path, license) = 1
),
found AS (
  SELECT f.doc_id, f.path, h.license, h.cosine, d.* FROM files f LEFT JOIN hits h USING (doc_id)
  LEFT JOIN dirs d ON starts_with(f.path, d.license_dir || '/')
  QUALIFY row_number() OVER (PARTITION BY f.doc_id ORDER BY length(d.license_dir) DESC NULLS LAST) = 1
)
SELECT doc_id, path, coalesce(license, dir_license) AS license, coalesce(cosine, dir_cosine) AS cosine,
       CASE WHEN license IS NOT NULL THEN 'file' WHEN dir_license IS NOT NULL THEN 'directory' END AS found_in, CASE WHEN license IS NULL THEN license_dir END AS license_dir
FROM found
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_topk": op2_topk,
        "op3_licenses": op3_licenses,
        "op4_repeats": op4_repeats,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_mixing": op6_mixing,
        "op7_quality": op7_quality,
        "op8_pii": op8_pii,
        "op9_sharding": op9_sharding,
        "op10_html": op10_html,
        "op11_tokens": op11_tokens,
        "op12_trie": op12_trie,
        "op13_fim": op13_fim,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_topk": OP2_SQL, "op3_licenses": _op3_sql(), "op7_quality": OP7_SQL, "op12_trie": OP12_SQL, "op13_fim": OP13_SQL}
