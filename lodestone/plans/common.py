"""What the registered queries share: tables, and SQL fragments of their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import HTML_RULES, LINK, WORD
from lodestone.sources.ingest import pages_to_documents
from lodestone.sources.store import bounded_batches, spread

REGISTRY: dict[str, tuple] = {}


def query(name: str, sql: str | None = None):
    """Registers a function (spark, folder) -> DataFrame under a name, with its SQL."""

    def add(f):
        REGISTRY[name] = (f, sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. Unions are told not to keep their sides' partitioning: partitions that adaptive execution
    coalesced differently on the two sides would be taken for equal ones (Spark 4.1). Texts in few files are dealt out, and
    batches that go to Python are bounded by bytes."""
    bounded_batches(spark)
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(found) if name in ("documents", "pages") else found


def markdown_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_to_documents(table(spark, sf_dir, "pages")).withColumnRenamed("page_id", "doc_id")


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(expr: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({expr}, {lit(pattern)}, {lit(replacement.replace('$', chr(92)))}, 'g')"


def sql_words(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), {lit(WORD)})"


def sql_word_count(expr: str) -> str:
    return f"CAST(len(list_filter(string_split_regex({expr}, '\\s+'), lambda w: w <> '')) AS INT)"


def sql_tokens(expr: str) -> str:
    return f"CAST(greatest(1, ({sql_word_count(expr)}) * 4 // 3) AS INT)"


def _markdown(expr: str) -> str:
    for pattern, replacement in HTML_RULES:
        expr = rx(expr, pattern, replacement)
    return rx(expr, r"^\s+|\s+$", "")


_TITLE = r"(?is)<title[^>]*>(.*?)</title>"
MD = f"""md AS (
  SELECT * FROM (SELECT page_id AS doc_id, url, coalesce(nullif(trim(regexp_extract(html, {lit(_TITLE)}, 1)), ''), url) AS title, {_markdown('html')} AS markdown FROM pages)
  WHERE {sql_word_count('markdown')} >= 30)"""
_HELD = rx("markdown", r"(?m)^[ \t]*(#[^\n]*)$", "\n\n$1\n\n")
_LIST = f"list_filter(list_transform(string_split_regex({_HELD}, {lit(chr(10) + '[ ' + chr(9) + ']*(?:' + chr(10) + '[ ' + chr(9) + ']*)+')}), lambda b: regexp_replace(b, '^\\s+|\\s+$', '', 'g')), lambda b: b <> '')"
BLOCKS = f"{MD}, blocks AS (SELECT doc_id, unnest(l) AS content, CAST(generate_subscripts(l, 1) - 1 AS INT) AS block_idx FROM (SELECT doc_id, {_LIST} AS l FROM md))"
KIND = r"""CASE WHEN starts_with(content, '```') AND ends_with(content, '```') THEN 'code' WHEN starts_with(content, '#') THEN 'heading'
  WHEN contains(content, '|---') OR contains(content, '---|') THEN 'table' WHEN regexp_matches(content, '^(?:[-*] |\d+\.\s)') THEN 'list' ELSE 'text' END"""
HASH = f"md5(trim({rx(rx(rx('content', LINK, '[$1]'), r'[0-9]{4}-[0-9]{2}-[0-9]{2}', ''), r'\s+', ' ')}))"
METRICS = f"""{BLOCKS}, m0 AS (
  SELECT *, {KIND} AS block_type, {HASH} AS block_hash, {sql_words('content')} AS w, regexp_extract_all(content, {lit(LINK)}, 1) AS l FROM blocks
), metrics AS (
  SELECT doc_id, block_idx, content, block_type, block_hash, CAST(len(w) AS INT) AS word_count,
    CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w) ELSE 0.0 END AS unique_word_ratio, CAST(len(l) AS INT) AS link_count,
    CASE WHEN length(content) > 0 THEN coalesce(list_sum(list_transform(l, lambda x: length(x))), 0) / length(content) ELSE 0.0 END AS link_density,
    block_idx / count(*) OVER (PARTITION BY doc_id) AS position_ratio FROM m0)"""
FREQ = f"{METRICS}, freq AS (SELECT block_hash, count(DISTINCT doc_id) / (SELECT count(DISTINCT doc_id) FROM metrics) AS df FROM metrics GROUP BY block_hash)"
SCORED = f"""{FREQ}, near AS (
  SELECT m.*, f.df, coalesce(lag(CAST(link_density > 0.5 AND word_count < 15 AS INT)) OVER o, 0) + coalesce(lead(CAST(link_density > 0.5 AND word_count < 15 AS INT)) OVER o, 0) AS n
  FROM metrics m JOIN freq f USING (block_hash) WINDOW o AS (PARTITION BY doc_id ORDER BY block_idx)
), scored AS (
  SELECT *, CASE WHEN block_type NOT IN ('code', 'table', 'heading') THEN
    CASE WHEN df > 0.8 THEN 5.0 WHEN df > 0.4 THEN 3.0 WHEN df > 0.1 THEN 1.0 ELSE 0.0 END
    + CASE WHEN position_ratio < 0.1 OR position_ratio > 0.9 THEN 1.5 ELSE 0.0 END
    + CASE WHEN link_density > 0.8 THEN 3.0 WHEN link_density > 0.5 THEN 1.0 ELSE 0.0 END
    + CASE WHEN word_count < 10 AND link_count > 0 THEN 2.0 WHEN word_count > 30 AND link_density < 0.1 THEN -3.0 ELSE 0.0 END
    + CASE WHEN word_count > 5 AND unique_word_ratio < 0.5 THEN 2.0 ELSE 0.0 END + n END AS score,
    CASE WHEN block_type IN ('code', 'table', 'heading') THEN '' ELSE concat_ws(',',
      CASE WHEN df > 0.8 THEN 'frequency_high' WHEN df > 0.4 THEN 'frequency_med' WHEN df > 0.1 THEN 'frequency_low' END,
      CASE WHEN position_ratio < 0.1 OR position_ratio > 0.9 THEN 'edge_position' END,
      CASE WHEN link_density > 0.8 THEN 'link_density_high' WHEN link_density > 0.5 THEN 'link_density_med' END,
      CASE WHEN word_count < 10 AND link_count > 0 THEN 'info_density_low' END,
      CASE WHEN word_count > 5 AND unique_word_ratio < 0.5 THEN 'diversity_low' END,
      CASE WHEN n > 0 THEN 'context_penalty' END) END AS signals FROM near
), removed AS (
  SELECT *, CASE WHEN score > -1 THEN CASE WHEN df > 0.95 AND word_count < 15 THEN 1
    WHEN score >= 6 AND len(list_distinct(list_transform(string_split(signals, ','), lambda s: split_part(s, '_', 1)))) >= 2 THEN 2
    WHEN link_density > 0.9 AND df > 0.2 THEN 3 END END AS tier FROM scored)"""
