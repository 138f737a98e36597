"""Cleaning of markdown by corpus statistics: blocks, metrics, boilerplate scores, removal, rebuilt text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.text import link_texts, normalised_hash, word_count, words
from lodestone.sources.store import settled

_HELD = "\x01"


def _fences_held(markdown: Column) -> Column:
    """Newlines inside closed code fences become a sign that no split sees."""
    parts = F.split(markdown, "```")
    n = F.size(parts)

    def one(x: Column, i: Column) -> Column:
        closed = (i % 2 == 1) & (i < n - 1)
        return F.when(closed, F.concat(F.lit("\n\n```"), F.replace(x, F.lit("\n"), F.lit(_HELD)), F.lit("```\n\n"))).when(i % 2 == 1, F.concat(F.lit("```"), x)).otherwise(x)

    return F.array_join(F.transform(parts, one), "")


def block_array(markdown: Column) -> Column:
    """Blocks in order: closed fences and pipe tables whole, heading lines alone, else text up to a blank line."""
    held = _fences_held(markdown)
    held = F.regexp_replace(held, r"(?m)((?:^\|[^\n]+\|[ \t]*(?:\n|\z))+)", "\n\n$1\n\n")
    held = F.regexp_replace(held, r"(?m)^[ \t]*(#[^\n]*)$", "\n\n$1\n\n")
    blocks = F.transform(F.split(held, r"\n[ \t]*(?:\n[ \t]*)+"), lambda b: F.regexp_replace(F.translate(b, _HELD, "\n"), r"^\s+|\s+$", ""))
    return F.filter(blocks, lambda b: b != "")


def parse_blocks(docs: DataFrame, doc: str = "doc_id", markdown: str = "markdown") -> DataFrame:
    """(doc, block_idx, content)."""
    return docs.select(doc, F.posexplode(block_array(F.col(markdown))).alias("block_idx", "content"))


def block_type(content: Column) -> Column:
    return (
        F.when(content.startswith("```") & content.endswith("```"), "code")
        .when(content.startswith("#"), "heading")
        .when(F.contains(content, F.lit("|---")) | F.contains(content, F.lit("---|")), "table")
        .when(content.rlike(r"^(?:[-*] |\d+\.\s)"), "list")
        .otherwise("text")
    )


def block_metrics(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``blocks`` with type, hash, word and link figures and the place in the document."""
    own = words(F.col("content"))
    texts = link_texts(F.col("content"))
    n = F.count("*").over(W.partitionBy(doc))
    with_words = blocks.withColumns({"__w": own, "__l": texts, "block_type": block_type(F.col("content"))} | ({} if "block_hash" in blocks.columns else {"block_hash": normalised_hash(F.col("content"))}))
    letters = F.aggregate("__l", F.lit(0), lambda a, x: a + F.length(x))
    return with_words.withColumns(
        {
            "word_count": F.size("__w"),
            "unique_word_ratio": F.when(F.size("__w") > 0, F.size(F.array_distinct("__w")) / F.size("__w")).otherwise(0.0),
            "link_count": F.size("__l"),
            "link_density": F.when(F.length("content") > 0, letters / F.length("content")).otherwise(0.0),
            "position_ratio": F.col("block_idx") / n,
        }
    ).drop("__w", "__l")


def document_counts(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(block_hash, n): how many documents hold a block; the row of a null hash is the number of all documents.

    Distinct (document, hash) pairs are reduced before hashes are counted, so a block that stands everywhere is
    pre-aggregated like any other.
    """
    pairs = blocks.select(doc, "block_hash").distinct()
    everyone = blocks.agg(F.count_distinct(doc).alias("n")).select(F.lit(None).cast("string").alias("block_hash"), "n")
    return pairs.groupBy("block_hash").agg(F.count("*").alias("n")).unionByName(everyone)


def frequencies(counts: DataFrame) -> DataFrame:
    """(block_hash, df): share of all documents that hold the block; 0 for a single document. Several counts add up."""
    summed = counts.groupBy("block_hash").agg(F.sum("n").alias("n"))
    docs = summed.where("block_hash is null").select(F.col("n").alias("n_docs"))
    share = F.when(F.col("n_docs") > 1, F.col("n") / F.col("n_docs")).otherwise(0.0)
    return summed.where("block_hash is not null").crossJoin(F.broadcast(docs)).select("block_hash", share.alias("df"))


def document_frequency(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(block_hash, df) of the documents of ``blocks``."""
    return frequencies(document_counts(blocks, doc))


def boilerplate_score(metrics: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``metrics`` (with df) plus score and signals; code, tables and headings are exempt (null score)."""
    order = W.partitionBy(doc).orderBy("block_idx")
    link_wall = (F.col("link_density") > 0.5) & (F.col("word_count") < 15)
    near = sum(F.coalesce(shift(link_wall.cast("int")).over(order), F.lit(0)) for shift in (F.lag, F.lead))
    df, density, n, at = F.col("df"), F.col("link_density"), F.col("word_count"), F.col("position_ratio")
    short = (n < 10) & (F.col("link_count") > 0)
    dull = (n > 5) & (F.col("unique_word_ratio") < 0.5)
    edge = (at < 0.1) | (at > 0.9)
    with_near = metrics.withColumn("__near", near)
    score = (
        F.when(df > 0.8, 5.0).when(df > 0.4, 3.0).when(df > 0.1, 1.0).otherwise(0.0)
        + F.when(edge, 1.5).otherwise(0.0)
        + F.when(density > 0.8, 3.0).when(density > 0.5, 1.0).otherwise(0.0)
        + F.when(short, 2.0).when((n > 30) & (density < 0.1), -3.0).otherwise(0.0)
        + F.when(dull, 2.0).otherwise(0.0)
        + F.col("__near")
    )
    signals = F.array_compact(
        F.array(
            F.when(df > 0.8, "frequency_high").when(df > 0.4, "frequency_med").when(df > 0.1, "frequency_low"),
            F.when(edge, "edge_position"),
            F.when(density > 0.8, "link_density_high").when(density > 0.5, "link_density_med"),
            F.when(short, "info_density_low"),
            F.when(dull, "diversity_low"),
            F.when(F.col("__near") > 0, "context_penalty"),
        )
    )
    exempt = F.col("block_type").isin("code", "table", "heading")
    return with_near.withColumns({"score": F.when(~exempt, score), "signals": F.when(~exempt, signals).otherwise(F.array().cast("array<string>"))}).drop("__near")


def removal(scored: DataFrame) -> DataFrame:
    """``scored`` with is_removed and tier (1 chrome, 2 several signals, 3 link wall)."""
    families = F.size(F.array_distinct(F.transform("signals", lambda s: F.split_part(s, F.lit("_"), F.lit(1)))))
    tier = (
        F.when((F.col("df") > 0.95) & (F.col("word_count") < 15), 1)
        .when((F.col("score") >= 6) & (families >= 2), 2)
        .when((F.col("link_density") > 0.9) & (F.col("df") > 0.2), 3)
    )
    held = F.coalesce(F.col("score") > -1, F.lit(False))
    return scored.withColumn("tier", F.when(held, tier)).withColumn("is_removed", F.col("tier").isNotNull())


def intra_document_repeats(metrics: DataFrame, doc: str = "doc_id", times: int = 3) -> DataFrame:
    """``metrics`` with is_repeat: blocks of 3 to 29 words, no code or table, that a document holds ``times`` times or more."""
    n = F.count("*").over(W.partitionBy(doc, "block_hash"))
    flag = (n >= times) & F.col("word_count").between(3, 29) & ~F.col("block_type").isin("code", "table")
    return metrics.withColumn("is_repeat", flag)


def rebuilt(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Cleaned markdown of each document and figures before and after."""

    def joined(keep: Column) -> Column:
        rows = F.array_sort(F.collect_list(F.when(keep, F.struct("block_idx", "content"))))
        return F.array_join(F.transform(rows, lambda x: x["content"]), "\n\n")

    kept = ~F.col("is_removed")
    out = blocks.groupBy(doc).agg(joined(F.lit(True)).alias("raw"), joined(kept).alias("cleaned"), F.count_if(F.col("is_removed")).alias("removed_blocks"))
    before, after = word_count(F.col("raw")), word_count(F.col("cleaned"))
    levels = {f"h{k}": F.regexp_count("cleaned", F.lit(rf"(?m)^{'#' * k} ")) for k in range(1, 5)}
    return out.withColumns({"words_before": before, "words_after": after, "retention": F.when(before > 0, F.round(100 * after / before, 2)).otherwise(0.0)} | levels)


def cleaned_or_raw(rebuilt_docs: DataFrame, least: int = 50) -> DataFrame:
    """``text``: the cleaned markdown, or the raw one where little is left."""
    return rebuilt_docs.withColumn("text", F.when(F.length("cleaned") >= least, F.col("cleaned")).otherwise(F.col("raw")))


#: No score and no tier looks at document frequencies up to this.
RARE = 0.1


def clean(docs: DataFrame, doc: str = "doc_id", markdown: str = "markdown", known: DataFrame | None = None) -> DataFrame:
    """All of it: blocks with metrics, frequencies, scores and removal. ``known``: document counts of earlier documents.

    Frequencies of rare blocks, which change nothing, read 0. Blocks in over a tenth of all documents are fewer than ten
    times the distinct blocks of a mean document, so they are sent to every task and no content is shuffled by hash.
    """
    # Blocks are written once: markdown is often made by many expressions, which two readers would each compute.
    blocks = settled(parse_blocks(docs, doc, markdown).withColumn("block_hash", normalised_hash(F.col("content"))), "blocks")
    counts = document_counts(blocks, doc)
    common = frequencies(counts if known is None else counts.unionByName(known.select("block_hash", "n"))).where(F.col("df") > RARE)
    metrics = block_metrics(blocks, doc).join(F.broadcast(common), "block_hash", "left").withColumn("df", F.coalesce("df", F.lit(0.0)))
    return removal(boilerplate_score(metrics, doc))
