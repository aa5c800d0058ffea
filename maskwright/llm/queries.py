"""The registered queries of the corpus operators, and SQL for those SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import chat, license_align, media, minhash, mixing, packing, pii_boost, quality, suffix_dedup, url_lists


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op1_webp_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_back(media.stored(_table(spark, sf_dir, "documents")))


def op2_chat_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat.digest(turns.union(extra))


def dated_lists(pages: DataFrame) -> DataFrame:
    """Dated list entries for the hosts, domains and first directories of ``pages``.

    The tables hold no lists, so dates and lists come from a digest of each value.
    """
    host, path = url_lists.host_of(F.col("url")), url_lists.path_of(F.col("url"))
    first = F.concat("host", F.lit("/"), F.get(F.split(path, "/"), F.lit(1)), F.lit("/"))
    parent = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in (("host", F.col("host")), ("domain", parent), ("prefix", first))])
    values = pages.withColumn("host", host).select(F.explode(kinds).alias("x")).select("x.*").dropna().distinct()
    h = F.conv(F.substring(F.md5("value"), 1, 7), 16, 10).cast("long")
    lists = F.element_at(F.array(*map(F.lit, ("spam", "adult", "allow", "malware"))), (h % 4 + 1).cast("int"))
    day = (h % 300).cast("int")
    steps = F.array(
        F.struct(F.lit("add").alias("action"), day.alias("day")),
        F.struct(F.when(h % 3 > 0, "remove").alias("action"), (day + 60 + (h % 90).cast("int")).alias("day")),
        F.struct(F.when(h % 3 == 2, "add").alias("action"), (day + 200).alias("day")),
    )
    dated = values.select(lists.alias("list"), "kind", "value", F.explode(steps).alias("s"))
    return dated.select("list", "kind", "value", "s.action", F.date_add(F.lit("2024-01-01").cast("date"), F.col("s.day")).alias("dated")).filter("action is not null")


def op3_temporal_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    # pages carry no fetch date; it is taken from the id
    captures = pages.withColumn("fetched_at", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 7919 % 730).cast("int")))
    return url_lists.evaluated(captures, dated_lists(pages))


def op4_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op6_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_boost.found(_table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(_table(spark, sf_dir, "documents"))


def op8_license_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_align.scan(_table(spark, sf_dir, "documents"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_webp_media, op2_chat_masks, op3_temporal_url_lists, op4_quality_cascade, op5_best_fit_packing, op6_boosted_pii, op7_suffix_dedup, op8_license_alignment, op9_source_mix, op10_minhash_dedup)}

_OP3 = r"""
WITH p AS (
  SELECT page_id, url, DATE '2024-01-01' + (page_id * 7919 % 730)::INTEGER AS fetched_at,
    nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '') AS host,
    regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
v AS (
  SELECT DISTINCT kind, value FROM (
    SELECT 'host' AS kind, host AS value FROM p
    UNION ALL SELECT 'domain', regexp_extract(host, '([^.]+\.[^.]+)$', 1) FROM p
    UNION ALL SELECT 'prefix', host || '/' || string_split(path, '/')[2] || '/' FROM p)
  WHERE value IS NOT NULL),
h AS (SELECT kind, value, ('0x' || substr(md5(value), 1, 7))::BIGINT AS h FROM v),
e AS (
  SELECT ['spam', 'adult', 'allow', 'malware'][h % 4 + 1] AS list, kind, value, h,
    DATE '2024-01-01' + (h % 300)::INTEGER AS d1,
    CASE WHEN h % 3 > 0 THEN DATE '2024-01-01' + (h % 300 + 60 + h % 90)::INTEGER END AS d2,
    CASE WHEN h % 3 = 2 THEN DATE '2024-01-01' + (h % 300 + 200)::INTEGER END AS d3 FROM h),
i AS (
  SELECT list, kind, value, d1 AS valid_from, d2 AS valid_to FROM e
  UNION ALL SELECT list, kind, value, d3, NULL FROM e WHERE d3 IS NOT NULL),
k AS (
  SELECT page_id, fetched_at, 'host' AS kind, host AS value FROM p
  UNION ALL SELECT page_id, fetched_at, 'domain', array_to_string(l[n:], '.')
    FROM (SELECT page_id, fetched_at, string_split(host, '.') AS l, unnest(range(1, greatest(len(string_split(host, '.')), 2))) AS n FROM p)
  UNION ALL SELECT DISTINCT page_id, fetched_at, 'prefix', host || array_to_string(s[1:n], '/') || CASE WHEN n < len(s) THEN '/' ELSE '' END
    FROM (SELECT page_id, fetched_at, host, string_split(path, '/') AS s, unnest(range(1, len(string_split(path, '/')) + 1)) AS n FROM p)),
m AS (
  SELECT DISTINCT k.page_id, i.list, i.list || ':' || k.kind || ':' || k.value AS entry
  FROM k JOIN i ON k.kind = i.kind AND k.value = i.value AND k.fetched_at >= i.valid_from AND (i.valid_to IS NULL OR k.fetched_at < i.valid_to))
SELECT p.page_id, p.host, p.fetched_at, count(m.entry) AS n_active, coalesce(string_agg(m.entry, ',' ORDER BY m.entry), '') AS active,
  count(m.entry) > 0 AND NOT coalesce(bool_or(m.list = 'allow'), false) AS blocked
FROM p LEFT JOIN m ON p.page_id = m.page_id GROUP BY p.page_id, p.host, p.fetched_at"""

_OP4 = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) AS n
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM win WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    len(ls)::BIGINT AS n_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 25 * n_words OR 100 * n_dup_lines > 50 * n_lines
    OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
FROM m"""

ORACLE_SQL: dict[str, str] = {"op3_temporal_url_lists": _OP3, "op4_quality_cascade": _OP4}
