"""Sources, routing and gates of ingestion."""

from __future__ import annotations

from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.html import markdown_with_structure
from lodestone.functions.text import markdown_from_html, word_count
from lodestone.sources.store import settled

#: Extensions of files that aren't pages.
SKIPPED_EXTENSIONS = ("pdf", "png", "jpg", "jpeg", "gif", "svg", "webp", "ico", "zip", "tar", "gz", "xml", "json", "csv", "xlsx", "docx", "mp3", "mp4", "avi", "mov", "woff", "woff2", "ttf", "eot")
MIN_PAGE_WORDS, MIN_CHARS, MAX_CHARS, MAX_UPLOAD, MAX_CHUNKS = 30, 50, 1_500_000, 20 * 1024 * 1024, 2_000


def route(source: Column, content_type: Column | None = None) -> Column:
    """Kind of a source: sitemap, document, web or unsupported."""
    low = F.lower(source)
    path = F.regexp_replace(low, r"[?#].*$", "")
    kind = F.coalesce(content_type, F.lit("")) if content_type is not None else F.lit("")
    http = low.rlike("^https?://")
    return (
        F.when(http & (path.endswith(".xml") | F.contains(low, F.lit("sitemap"))), "sitemap")
        .when(http & kind.rlike("pdf|text/plain|markdown"), "document")
        .when(http, "web")
        .when(path.rlike(r"\.(pdf|docx|md|txt)$"), "document")
        .otherwise("unsupported")
    )


def pages_to_documents(pages: DataFrame, min_words: int = MIN_PAGE_WORDS, structure: bool = False) -> DataFrame:
    """(page_id, url, title, markdown, word_count) of pages with enough words; the title falls back to the URL.

    With ``structure``, tables, code and bold text are kept, at the price of a pass through Python workers.
    """
    title = F.nullif(F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))
    docs = pages.select("page_id", "url", F.coalesce(title, "url").alias("title"), (markdown_with_structure if structure else markdown_from_html)(F.col("html")).alias("markdown"))
    return docs.withColumn("word_count", word_count(F.col("markdown"))).where(F.col("word_count") >= min_words)


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole text and markdown files: (url, title, text), the title being the file's name."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("url"), F.col("_metadata.file_name").alias("title"), F.col("value").alias("text"))


def locations(xml: str | None) -> list[tuple[int, str, bool]]:
    """(pos, loc, is_sitemap) of one sitemap: an index lists sitemaps, a URL set pages.

    Where neither has entries, any location counts, as a sitemap if it ends in .xml or has sitemap in it. What isn't XML
    has no locations.
    """
    try:
        root = ElementTree.fromstring(xml or "")
    except ElementTree.ParseError:
        return []
    name = lambda e: e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
    index = "sitemapindex" in name(root).lower()
    entry = "sitemap" if index else "url"
    of = [next((x for x in e if name(x) == "loc"), None) for e in root.iter() if name(e) == entry]
    found = [(x.text.strip(), index) for x in of if x is not None and (x.text or "").strip()]
    if not found:
        loose = [x.text.strip() for x in root.iter() if name(x) == "loc" and (x.text or "").strip()]
        found = [(x, x.lower().endswith(".xml") or "sitemap" in x.lower()) for x in loose]
    return [(k, loc, child) for k, (loc, child) in enumerate(found)]


def sitemap_locations(sitemaps: DataFrame, xml: str = "xml") -> DataFrame:
    """Other columns, ``pos``, ``loc`` and ``is_sitemap`` for each location of url sets and sitemap indexes, in order."""

    @F.pandas_udf("array<struct<pos: int, loc: string, is_sitemap: boolean>>")
    def read(batch: pd.Series) -> pd.Series:
        return pd.Series([[{"pos": k, "loc": loc, "is_sitemap": child} for k, loc, child in locations(x)] for x in batch], dtype=object)

    rest = [c for c in sitemaps.columns if c != xml]
    return sitemaps.select(*rest, F.explode(read(F.col(xml))).alias("__l")).select(*rest, "__l.*")


def expand_sitemaps(roots: DataFrame, sitemaps: DataFrame, depth: int = 1, children: int = 10) -> DataFrame:
    """(root, url, level, sitemap, pos): the pages that the sitemaps under each root (``root``) list, each once, where it is first met.

    ``sitemaps`` (url, xml) are what was fetched; those that weren't list nothing. Level by level, the first ``children``
    sitemaps of each index join the frontier, up to ``depth`` levels below the root; a sitemap that was visited from the
    same root isn't again, so cycles end.
    """
    frontier = settled(roots.select("root").distinct().select("root", F.col("root").alias("url")))
    visited, pages = frontier, None
    for level in range(depth + 1):
        listed = settled(sitemap_locations(frontier.join(sitemaps.select("url", "xml"), "url").select("root", F.col("url").alias("sitemap"), "xml")))
        own = listed.where("not is_sitemap").select("root", F.col("loc").alias("url"), F.lit(level).alias("level"), "sitemap", "pos")
        pages = own if pages is None else pages.unionByName(own)
        nth = F.row_number().over(W.partitionBy("root", "sitemap").orderBy("pos"))
        below = listed.where("is_sitemap").withColumn("__n", nth).where(F.col("__n") <= children).select("root", F.col("loc").alias("url")).distinct()
        frontier = settled(below.join(visited, ["root", "url"], "left_anti"))
        if level == depth or frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    first = F.min(F.struct("level", "sitemap", "pos")).alias("x")
    return pages.groupBy("root", "url").agg(first).select("root", "url", "x.*")


def robots_sitemaps(robots: Column) -> Column:
    """Sitemap lines of a robots file."""
    return F.transform(F.regexp_extract_all(robots, F.lit(r"(?im)^sitemap:\s*(\S+)"), F.lit(1)), lambda x: F.trim(x))


def select_urls(urls: DataFrame, url_contains: str | None = None, cap: int = 500, source: str | None = None, order: str = "pos") -> DataFrame:
    """URLs without skipped extensions that contain a text, first seen of each, at most ``cap`` a source."""
    path = F.regexp_replace(F.lower("url"), r"[?#].*$", "")
    kept = urls.where(~path.rlike(r"\.(" + "|".join(SKIPPED_EXTENSIONS) + ")$"))
    if url_contains:
        kept = kept.where(F.contains(F.lower("url"), F.lit(url_contains.lower())))
    by = [source] if source else []
    first = kept.withColumn("__n", F.row_number().over(W.partitionBy(*by, "url").orderBy(order))).where("__n = 1").drop("__n")
    if not source:
        return first.orderBy(order).limit(cap)
    return first.withColumn("__n", F.row_number().over(W.partitionBy(source).orderBy(order))).where(F.col("__n") <= cap).drop("__n")


def gates(docs: DataFrame, chars: Column, extension: Column, size: Column, tenant_chunks: Column) -> DataFrame:
    """``docs`` with gate_status and gate_error: the first gate that a document fails."""
    error = (
        F.when(~F.coalesce(extension.isin("pdf", "docx", "md", "txt", "html"), F.lit(False)), "unsupported extension")
        .when(size > MAX_UPLOAD, "file too large")
        .when(F.coalesce(tenant_chunks, F.lit(0)) >= MAX_CHUNKS, "tenant quota reached")
        .when(chars < MIN_CHARS, "too little text")
        .when(chars > MAX_CHARS, "too much text")
    )
    return docs.withColumns({"gate_error": error, "gate_status": F.when(error.isNull(), "accepted").when(chars > MAX_CHARS, "failed").otherwise("rejected")})


def page_failures(results: DataFrame, source: str = "source", failed: str = "failed", reason: str = "reason", order: str = "page_id") -> DataFrame:
    """Per source: total, indexed, failed, and the first two reasons joined by '; '. Sources are aggregated before they are shuffled."""
    bad, row = F.col(failed), F.struct(F.col(order).alias("at"), F.col(reason).alias("r"))
    first = F.min(F.when(bad, row))
    counts = results.groupBy(source).agg(F.count("*").alias("total"), F.count_if(~bad).alias("indexed"), F.count_if(bad).alias("failed"), first.alias("__first"))
    rest = results.join(counts.where("failed > 1").select(source, "__first"), source).where(bad & (row > F.col("__first")))
    second = rest.groupBy(source).agg(F.min(row).alias("__second"))
    reasons = F.array_compact(F.array(F.col("__first.r"), F.col("__second.r")))
    return counts.join(second, source, "left").select(source, "total", "indexed", "failed", F.array_join(reasons, "; ").alias("reasons"))
