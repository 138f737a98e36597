"""Registered queries: sources, gates and cleaning."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import cleaning as C
from lodestone.plans.common import BLOCKS, FREQ, MD, METRICS, SCORED, lit, markdown_docs, query, sql_word_count, table
from lodestone.sources import ingest as I
from lodestone.sources import sinks as S


@query(
    "route_sources",
    r"""SELECT page_id, CASE WHEN http AND (ends_with(path, '.xml') OR contains(low, 'sitemap')) THEN 'sitemap' WHEN http AND page_id % 7 = 0 THEN 'document' WHEN http THEN 'web'
  WHEN regexp_matches(path, '\.(pdf|docx|md|txt)$') THEN 'document' ELSE 'unsupported' END AS kind
FROM (SELECT *, regexp_matches(low, '^https?://') AS http, regexp_replace(low, '[?#].*$', '') AS path FROM (SELECT page_id, lower(CASE page_id % 5 WHEN 0 THEN replace(url, 'http', 'file') || '.md' WHEN 1 THEN url || '/sitemap.xml' ELSE url END) AS low FROM pages))""",
)
def route_sources(spark, d):
    k = F.col("page_id") % 5
    source = F.when(k == 0, F.concat(F.replace("url", F.lit("http"), F.lit("file")), F.lit(".md"))).when(k == 1, F.concat("url", F.lit("/sitemap.xml"))).otherwise(F.col("url"))
    kind = F.when(F.col("page_id") % 7 == 0, "application/pdf")
    return table(spark, d, "pages").select("page_id", I.route(source, kind).alias("kind"))


@query("html_to_markdown", f"WITH {MD} SELECT doc_id, url, title, markdown, {sql_word_count('markdown')} AS word_count FROM md")
def html_to_markdown(spark, d):
    return markdown_docs(spark, d)


@query("scan_documents", "SELECT doc_id, source AS url, lang AS title, length(text) AS chars, md5(text) AS digest FROM documents")
def scan_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", F.col("source").alias("url"), F.col("lang").alias("title"), F.length("text").cast("bigint").alias("chars"), F.md5("text").alias("digest"))


@query(
    "sitemap_urls",
    "SELECT host, shard, CAST(row_number() OVER (PARTITION BY host, shard ORDER BY page_id) - 1 AS INT) AS pos, trim(url) AS loc, false AS is_sitemap FROM (SELECT page_id, url, regexp_extract(url, '^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1) AS host, CAST(page_id // 100 AS INT) AS shard FROM pages)",
)
def sitemap_urls(spark, d):
    """A sitemap for each host of ``pages``, built and read back."""
    host = F.parse_url("url", F.lit("HOST"))
    loc = F.concat(F.lit("<url><loc>"), F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</loc></url>"))
    shard = (F.col("page_id") / 100).cast("int").alias("shard")
    maps = table(spark, d, "pages").select("page_id", host.alias("host"), loc.alias("loc"), shard).groupBy("host", "shard").agg(F.array_sort(F.collect_list(F.struct("page_id", "loc"))).alias("l"))
    xml = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.array_join(F.transform("l", lambda x: x["loc"]), ""), F.lit("</urlset>"))
    return I.sitemap_locations(maps.select("host", "shard", xml.alias("xml")))


_HOSTS = "h AS (SELECT DISTINCT regexp_extract(url, '^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1) AS host FROM pages), t AS (SELECT host, regexp_extract(host, '[^.]*$') AS tld FROM h)"


@query(
    "sitemap_expand",
    f"""WITH RECURSIVE {_HOSTS}, edges AS (
  SELECT 'http://all/index.xml' AS parent, 'http://all/' || tld || '.xml' AS child, row_number() OVER (ORDER BY tld) AS n FROM (SELECT DISTINCT tld FROM t)
  UNION ALL SELECT 'http://all/' || tld || '.xml', 'http://' || host || '/map', row_number() OVER (PARTITION BY tld ORDER BY host) FROM t
  UNION ALL SELECT 'http://' || host || '/map', 'http://all/index.xml', 1 FROM t WHERE false
), walk AS (SELECT 'http://all/index.xml' AS url, 0 AS level UNION ALL SELECT child, level + 1 FROM walk JOIN edges ON parent = url WHERE n <= 10 AND level < 2),
p AS (SELECT 'http://' || regexp_extract(url, '^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1) || '/map' AS sitemap, trim(url) AS url FROM pages)
SELECT DISTINCT p.url, level FROM p JOIN walk w ON w.url = p.sitemap""",
)
def sitemap_expand(spark, d):
    """Pages under an index of indexes: one for each domain ending, which lists a sitemap for each of its hosts and the first index again."""
    host = F.parse_url("url", F.lit("HOST"))
    escaped = F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    pages = table(spark, d, "pages").select("page_id", host.alias("host"), escaped.alias("loc"))
    wrap = lambda tag, inner: F.concat(F.lit(f"<{tag}>"), inner, F.lit(f"</{tag}>"))
    listed = lambda tag, rows: wrap("urlset" if tag == "url" else "sitemapindex", F.array_join(F.transform(rows, lambda x: F.concat(F.lit(f"<{tag}><loc>"), x, F.lit(f"</loc></{tag}>"))), ""))
    urls = pages.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "loc"))), lambda x: x["loc"]).alias("l"))
    maps = urls.select(F.concat(F.lit("http://"), "host", F.lit("/map")).alias("url"), listed("url", F.col("l")).alias("xml"))
    hosts = urls.select("host", F.regexp_extract("host", "[^.]*$", 0).alias("tld")).groupBy("tld").agg(F.array_sort(F.collect_list("host")).alias("l"))
    of_tld = F.concat(F.lit("http://all/"), "tld", F.lit(".xml"))
    cyclic = F.array_append(F.transform("l", lambda x: F.concat(F.lit("http://"), x, F.lit("/map"))), F.lit("http://all/index.xml"))
    maps = maps.unionByName(hosts.select(of_tld.alias("url"), listed("sitemap", cyclic).alias("xml")))
    top = hosts.agg(F.array_sort(F.collect_list(of_tld)).alias("l")).select(F.lit("http://all/index.xml").alias("url"), listed("sitemap", F.col("l")).alias("xml"))
    roots = spark.createDataFrame([("http://all/index.xml",)], "root string")
    return I.expand_sitemaps(roots, maps.unionByName(top), depth=2).select("url", "level")


@query(
    "select_urls",
    rf"""WITH u AS (SELECT page_id AS pos, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_replace(url, '[?#].*$', '') AS url FROM pages),
k AS (SELECT * FROM u WHERE NOT regexp_matches(lower(url), '\.(pdf|png|jpg|jpeg|gif|svg|webp|ico|zip|tar|gz|xml|json|csv|xlsx|docx|mp3|mp4|avi|mov|woff|woff2|ttf|eot)$') AND contains(lower(url), '/en/')),
f AS (SELECT *, row_number() OVER (PARTITION BY host, url ORDER BY pos) AS n FROM k)
SELECT pos, host, url FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY pos) AS c FROM f WHERE n = 1) WHERE c <= 50""",
)
def select_urls(spark, d):
    urls = table(spark, d, "pages").select(F.col("page_id").alias("pos"), F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"), F.regexp_replace("url", "[?#].*$", "").alias("url"))
    return I.select_urls(urls, "/en/", cap=50, source="host")


@query(
    "promote_headings",
    f"""WITH {MD}, b AS (SELECT doc_id, string_split(regexp_replace(markdown, '(?m)^# (.{{3,70}})$', '**\\1**' || chr(10), 'g'), chr(10)) AS l FROM md),
x AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i, len(l) AS n, l FROM b)
SELECT doc_id, string_agg(CASE WHEN regexp_matches(line, '^\\*\\*[^*]{{2,78}}[^*.,:;]\\*\\*[ \t]*$') AND (i = n OR trim(l[i + 1], ' ' || chr(9)) = '') THEN '## ' || regexp_extract(line, '^\\*\\*([^*]+)\\*\\*', 1) ELSE line END, chr(10) ORDER BY i) AS markdown FROM x GROUP BY doc_id""",
)
def promote_headings(spark, d):
    bold = F.regexp_replace("markdown", r"(?m)^# (.{3,70})$", "**$1**\n")
    return markdown_docs(spark, d).select("doc_id", T.promote_headings(bold).alias("markdown"))


@query("strip_repeats")
def strip_repeats(spark, d):
    return table(spark, d, "documents").select("doc_id", T.strip_repeats(F.col("text")).alias("text"), F.length("text").alias("chars_before"))


@query(
    "text_quality_flags",
    """SELECT doc_id, len(l) = 0 OR coalesce(list_sum(list_transform(l, lambda x: length(x))), 0) < 5 * len(l) AS suspicious, length(text) < 50 AS needs_vision
FROM (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)""",
)
def text_quality_flags(spark, d):
    return table(spark, d, "documents").select("doc_id", T.suspicious_text(F.col("text")).alias("suspicious"), (F.length("text") < 50).alias("needs_vision"))


@query(
    "log_file_flag",
    r"""SELECT event_id, len(list_filter(l, lambda x: regexp_matches(x, '\d{4}-\d{2}-\d{2}[\sT]\d{2}:\d{2}:\d{2}'))) * 10 > len(l) * 4 AS is_log
FROM (SELECT event_id, string_split(strftime(ts, '%Y-%m-%d %H:%M:%S') || chr(10) || event_type || chr(10) || CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%H:%M:%S') ELSE props END, chr(10)) AS l FROM events)""",
)
def log_file_flag(spark, d):
    e = table(spark, d, "events")
    text = F.concat_ws("\n", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "event_type", F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "HH:mm:ss")).otherwise(F.col("props")))
    return e.select("event_id", T.looks_like_log(text).alias("is_log"))


@query(
    "ingestion_gates",
    """WITH q AS (SELECT source, count(*) AS n FROM documents GROUP BY source), g AS (
  SELECT doc_id, length(text) AS chars, CASE WHEN lang = 'es' THEN 'unsupported extension' WHEN length(text) * 100 > 20971520 THEN 'file too large' WHEN n >= 2000 THEN 'tenant quota reached'
    WHEN length(text) < 50 THEN 'too little text' WHEN length(text) > 1500000 THEN 'too much text' END AS gate_error FROM documents JOIN q USING (source))
SELECT doc_id, gate_error, CASE WHEN gate_error IS NULL THEN 'accepted' WHEN chars > 1500000 THEN 'failed' ELSE 'rejected' END AS gate_status FROM g""",
)
def ingestion_gates(spark, d):
    docs = table(spark, d, "documents")
    quota = docs.groupBy("source").agg(F.count("*").alias("n"))
    joined = docs.join(quota, "source")
    extension = F.when(F.col("lang") == "es", "xls").otherwise("txt")
    return I.gates(joined, F.length("text"), extension, F.length("text") * 100, F.col("n")).select("doc_id", "gate_error", "gate_status")


@query(
    "page_failures",
    f"""WITH {MD.split('WHERE')[0]}), r AS (SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS source, doc_id AS page_id, {sql_word_count('markdown')} < 120 AS failed, doc_id || ': ' || {sql_word_count('markdown')} || ' words' AS reason FROM md),
k AS (SELECT *, row_number() OVER (PARTITION BY source, failed ORDER BY page_id) AS n FROM r)
SELECT source, count(*) AS total, count(*) FILTER (NOT failed) AS indexed, count(*) FILTER (failed) AS failed, coalesce(string_agg(reason, '; ' ORDER BY page_id) FILTER (failed AND n <= 2), '') AS reasons FROM k GROUP BY source""",
)
def page_failures(spark, d):
    p = table(spark, d, "pages")
    docs = I.pages_to_documents(p, min_words=0)
    rows = docs.select("page_id", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("source"), (F.col("word_count") < 120).alias("failed"), F.concat(F.col("page_id"), F.lit(": "), F.col("word_count"), F.lit(" words")).alias("reason"))
    return I.page_failures(rows)


@query(
    "upsert_vectors",
    """WITH o AS (SELECT vec_id AS chunk_id, label AS tenant_id, 1 AS version FROM embeddings WHERE vec_id % 3 <> 0), n AS (SELECT vec_id, label, CAST(2 + vec_id % 2 AS INT) FROM embeddings WHERE vec_id % 2 = 0)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE chunk_id NOT IN (SELECT vec_id FROM n)""".replace("SELECT * FROM n UNION", "SELECT vec_id AS chunk_id, label AS tenant_id, CAST(2 + vec_id % 2 AS INT) AS version FROM embeddings WHERE vec_id % 2 = 0 UNION"),
)
def upsert_vectors(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("tenant_id"))
    old = v.where("chunk_id % 3 <> 0").withColumn("version", F.lit(1))
    new = v.where("chunk_id % 2 = 0").withColumn("version", (2 + F.col("chunk_id") % 2).cast("int"))
    return S.upserted(old, new, ["tenant_id", "chunk_id"], "version")


@query("delete_chunks", "SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_chunks(spark, d):
    gone = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("vec_id"))
    return S.delete_by_id(table(spark, d, "embeddings").select("vec_id", "label"), gone, "vec_id")


@query("resume_skip", "SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 4 = 0)")
def resume_skip(spark, d):
    p = table(spark, d, "pages").select("page_id", "url")
    return S.delete_by_id(p, p.where("page_id % 4 = 0"), "url").select("page_id", "url")


@query("parse_blocks", f"WITH {BLOCKS} SELECT * FROM blocks")
def parse_blocks(spark, d):
    return C.parse_blocks(markdown_docs(spark, d))


@query("classify_blocks", f"WITH {METRICS} SELECT block_type, count(*) AS n_blocks, count(DISTINCT doc_id) AS n_docs FROM metrics GROUP BY block_type")
def classify_blocks(spark, d):
    b = C.parse_blocks(markdown_docs(spark, d)).withColumn("block_type", C.block_type(F.col("content")))
    return b.groupBy("block_type").agg(F.count("*").alias("n_blocks"), F.count_distinct("doc_id").alias("n_docs"))


@query("block_metrics", f"WITH {METRICS} SELECT doc_id, block_idx, word_count, round(unique_word_ratio, 6) AS unique_word_ratio, link_count, round(link_density, 6) AS link_density, round(position_ratio, 6) AS position_ratio FROM metrics")
def block_metrics(spark, d):
    m = C.block_metrics(C.parse_blocks(markdown_docs(spark, d)))
    return m.select("doc_id", "block_idx", "word_count", F.round("unique_word_ratio", 6).alias("unique_word_ratio"), "link_count", F.round("link_density", 6).alias("link_density"), F.round("position_ratio", 6).alias("position_ratio"))


@query("block_hash", f"WITH {METRICS} SELECT doc_id, block_idx, block_hash FROM metrics")
def block_hash(spark, d):
    return C.parse_blocks(markdown_docs(spark, d)).select("doc_id", "block_idx", T.normalised_hash(F.col("content")).alias("block_hash"))


@query("block_doc_freq", f"WITH {FREQ} SELECT block_hash, round(df, 9) AS df FROM freq")
def block_doc_freq(spark, d):
    b = C.parse_blocks(markdown_docs(spark, d)).withColumn("block_hash", T.normalised_hash(F.col("content")))
    return C.document_frequency(b).select("block_hash", F.round("df", 9).alias("df"))


@query("boilerplate_score", f"WITH {SCORED} SELECT doc_id, block_idx, block_type, CAST(score AS DOUBLE) AS score, signals FROM removed")
def boilerplate_score(spark, d):
    return C.clean(markdown_docs(spark, d)).select("doc_id", "block_idx", "block_type", "score", F.array_join("signals", ",").alias("signals"))


@query("remove_boilerplate", f"WITH {SCORED} SELECT doc_id, block_idx, tier, tier IS NOT NULL AS is_removed FROM removed")
def remove_boilerplate(spark, d):
    return C.clean(markdown_docs(spark, d)).select("doc_id", "block_idx", "tier", "is_removed")


@query(
    "intra_doc_repeats",
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content FROM documents), h AS (SELECT *, md5(trim(regexp_replace(content, '\\s+', ' ', 'g'))) AS k, len(regexp_extract_all(lower(content), {lit(T.WORD)})) AS w FROM l WHERE trim(content) <> '')
SELECT doc_id, count(*) AS repeats FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS n FROM h) WHERE n >= 3 AND w BETWEEN 3 AND 29 GROUP BY doc_id""",
)
def intra_doc_repeats(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_idx", "content")).where(F.trim("content") != "")
    rows = lines.withColumns({"block_hash": F.md5(F.trim(F.regexp_replace("content", r"\s+", " "))), "word_count": F.size(T.words(F.col("content"))), "block_type": F.lit("text")})
    return C.intra_document_repeats(rows).where("is_repeat").groupBy("doc_id").agg(F.count("*").alias("repeats"))


_REBUILT = f"""{SCORED}, b AS (SELECT doc_id, string_agg(content, chr(10) || chr(10) ORDER BY block_idx) AS raw, coalesce(string_agg(content, chr(10) || chr(10) ORDER BY block_idx) FILTER (tier IS NULL), '') AS cleaned, count(*) FILTER (tier IS NOT NULL) AS removed_blocks FROM removed GROUP BY doc_id)"""


@query(
    "cleaning_stats",
    f"""WITH {_REBUILT}, w AS (SELECT *, {sql_word_count('raw')} AS words_before, {sql_word_count('cleaned')} AS words_after FROM b)
SELECT doc_id, removed_blocks, words_before, words_after, CASE WHEN words_before > 0 THEN round(100 * words_after / words_before, 2) ELSE 0.0 END AS retention,
  CAST(len(regexp_extract_all(cleaned, '(?m)^# ')) AS INT) AS h1, CAST(len(regexp_extract_all(cleaned, '(?m)^## ')) AS INT) AS h2 FROM w""",
)
def cleaning_stats(spark, d):
    return C.rebuilt(C.clean(markdown_docs(spark, d))).select("doc_id", "removed_blocks", "words_before", "words_after", "retention", "h1", "h2")


@query("cleaned_or_raw", f"WITH {_REBUILT} SELECT doc_id, CASE WHEN length(cleaned) >= 2000 THEN cleaned ELSE raw END AS text FROM b")
def cleaned_or_raw(spark, d):
    return C.cleaned_or_raw(C.rebuilt(C.clean(markdown_docs(spark, d))), least=2_000).select("doc_id", "text")
