"""Retrieval evaluation: matching, ranks, reports, integrity, review samples, regressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.text import has_sublist, identifier_tokens

EXACT, PARTIAL, NO = "Exact Match", "Partial Match", "No Match"


def matched(retrieved: DataFrame, queries: DataFrame) -> DataFrame:
    """Retrieved chunks (query_id, rank, url, section_title, heading_path) with match_type, rule and target.

    ``queries``: query_id, acceptable_documents, acceptable_headings. A document matches by substring or else by a
    stretch of tokens, the first acceptable one first; headings by title or path.
    """
    j = retrieved.join(queries, "query_id")
    tokens = identifier_tokens(F.col("url"))
    by_text = F.filter("acceptable_documents", lambda a: F.contains(F.col("url"), a))
    by_tokens = F.filter("acceptable_documents", lambda a: has_sublist(tokens, identifier_tokens(a)))
    target = F.coalesce(F.get(by_text, F.lit(0)), F.get(by_tokens, F.lit(0)))
    rule = F.when(F.size(by_text) > 0, "Exact Substring Match").when(F.size(by_tokens) > 0, "Normalized Token Sublist Match")
    title, path = identifier_tokens(F.col("section_title")), identifier_tokens(F.array_join("heading_path", " > "))
    heading = F.exists("acceptable_headings", lambda h: has_sublist(title, identifier_tokens(h)) | has_sublist(path, identifier_tokens(h)))
    kind = F.when(target.isNull(), NO).when((F.size("acceptable_headings") == 0) | heading, EXACT).otherwise(PARTIAL)
    return j.withColumns({"match_type": kind, "matching_rule": rule, "matched_target": target})


def query_ranks(matches: DataFrame, queries: DataFrame, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Per query: first matching rank, first exact rank (-1 without), hits at 1, 3 and 5, best match."""
    hit, exact = F.col("match_type") != NO, F.col("match_type") == EXACT
    ranks = matches.groupBy(*keys).agg(F.min(F.when(hit, F.col("rank"))).alias("r"), F.min(F.when(exact, F.col("rank"))).alias("e"))
    all_ = queries.select(*keys).distinct().join(ranks, list(keys), "left")
    best = F.when(F.col("e").isNotNull(), EXACT).when(F.col("r").isNotNull(), PARTIAL).otherwise(NO)
    hits = {f"hit{k}": F.coalesce(F.col("r") <= k, F.lit(False)) for k in (1, 3, 5)}
    return all_.withColumns(hits | {"best_match": best, "rank": F.coalesce("r", F.lit(-1)), "exact_rank": F.coalesce("e", F.lit(-1))}).drop("r", "e")


def report(results: DataFrame, *by: str) -> DataFrame:
    """Hit rates at 1, 3 and 5 and the mean reciprocal rank, by groups."""
    return results.groupBy(*by).agg(
        F.count("*").alias("n_queries"),
        *[F.round(F.avg(F.col(f"hit{k}").cast("int")), 6).alias(f"hit_at_{k}") for k in (1, 3, 5)],
        F.round(F.avg(F.when(F.col("rank") > 0, 1 / F.col("rank")).otherwise(0.0)), 6).alias("mrr"),
    )


#: Groups of up to this many values are ranked whole; of larger ones the values this close to the percentile, as a share.
WHOLE, CLOSE = 10_000, 0.001


def at_shares(df: DataFrame, value: str, shares: dict[str, tuple[float, Column]], by: list[str]) -> DataFrame:
    """``by`` and, for each share, the sorted values' elements at its place and the next one, as (low, high).

    ``shares``: name -> (number of a percentile, place from 0 as a Column of ``n``). Exact, but no group is sorted: an
    approximate percentile on either side bounds the values that are ranked, and those below are only counted.
    """
    percent = [min(1.0, max(0.0, p + d)) for p, _ in shares.values() for d in (-CLOSE, CLOSE)]
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("__v"))
    stats = rows.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx("__v", F.array(*map(F.lit, percent)), 10_000).alias("__b"))
    met = rows.join(F.broadcast(stats), by) if by else rows.crossJoin(F.broadcast(stats))
    whole, out = F.col("n") <= WHOLE, stats.drop("__b")
    for k, (name, (_, place)) in enumerate(shares.items()):
        low, high = F.col("__b")[2 * k], F.col("__b")[2 * k + 1]
        below = met.groupBy(*by).agg(F.count_if(~whole & (F.col("__v") < low)).alias("__below"), F.min(F.when(~whole & (F.col("__v") > high), F.col("__v"))).alias("__next"))
        near = met.where(whole | F.col("__v").between(low, high))
        near = (near.join(F.broadcast(below), by) if by else near.crossJoin(F.broadcast(below))).withColumn("__k", F.row_number().over(W.partitionBy(*by).orderBy("__v")) - 1 + F.col("__below"))
        at = near.groupBy(*by).agg(F.max(F.when(F.col("__k") == place, F.col("__v"))).alias("low"), F.max(F.when(F.col("__k") == place + 1, F.col("__v"))).alias("high"), F.first("__next").alias("next"))
        at = at.select(*by, F.struct("low", F.coalesce("high", "next").alias("high")).alias(name))
        out = out.join(at, by) if by else out.crossJoin(at)
    return out


def nearest_rank(df: DataFrame, value: str, shares: dict[str, float], *by: str) -> DataFrame:
    """Percentiles as the sorted values' element at int(n * p), not interpolated."""
    at = at_shares(df, value, {k: (p, F.least(F.floor(F.col("n") * p), F.col("n") - 1)) for k, p in shares.items()}, list(by))
    mean = df.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"))
    both = mean.join(at.drop("n"), list(by), "left") if by else mean.crossJoin(at.drop("n"))
    return both.select(*by, "n", "mean", *[F.col(f"{k}.low").alias(k) for k in shares])


def interpolated(df: DataFrame, value: str, shares: dict[str, float], *by: str) -> DataFrame:
    """Percentiles at (n - 1) * p, between two values in proportion."""
    at = at_shares(df, value, {k: (p, F.floor((F.col("n") - 1) * p)) for k, p in shares.items()}, list(by))

    def between(k: str, p: float) -> Column:
        part = (F.col("n") - 1) * p - F.floor((F.col("n") - 1) * p)
        return (F.col(f"{k}.low") + F.when(part > 0, part * (F.col(f"{k}.high") - F.col(f"{k}.low"))).otherwise(0.0)).alias(k)

    return at.select(*by, *[between(k, p) for k, p in shares.items()])


def group_metrics(results: DataFrame, *columns: str) -> DataFrame:
    """``report`` by each column apart, and for all: (dimension, value, ...)."""
    parts = [report(results.withColumns({"dimension": F.lit(c), "value": F.col(c).cast("string")}), "dimension", "value") for c in columns]
    out = report(results.withColumns({"dimension": F.lit("all"), "value": F.lit("all")}), "dimension", "value")
    for p in parts:
        out = out.unionByName(p)
    return out


def integrity(queries: DataFrame) -> DataFrame:
    """(query_id, problem): repeated queries, nothing acceptable, no topic, difficulty or category."""
    again = F.row_number().over(W.partitionBy("query").orderBy("query_id")) > 1
    checks = F.array_compact(
        F.array(
            F.when(F.col("__again"), "duplicate query"),
            F.when(F.coalesce(F.size("acceptable_documents"), F.lit(0)) < 1, "no acceptable documents"),
            F.when(F.coalesce(F.trim("expected_topic"), F.lit("")).isin("", "Unknown"), "no topic"),
            F.when(F.coalesce(F.trim("difficulty"), F.lit("")) == "", "no difficulty"),
            F.when(F.coalesce(F.trim("category"), F.lit("")) == "", "no category"),
        )
    )
    return queries.withColumn("__again", again).select("query_id", F.explode(checks).alias("problem"))


def evidence(queries: DataFrame, matches: DataFrame) -> DataFrame:
    """Each query with its first chunk and how that matches."""
    top = matches.where("rank = 1").select("query_id", "chunk_id", "match_type")
    return queries.select("query_id").join(top, "query_id", "left").withColumn("match_type", F.coalesce("match_type", F.lit(NO)))


def review_sample(results: DataFrame, n: int = 5, seed: int = 0) -> DataFrame:
    """Up to ``n`` queries of each best match, the same ones on every run."""
    order = F.md5(F.concat_ws(":", F.lit(seed), "query_id"))
    return results.withColumn("nth", F.row_number().over(W.partitionBy("best_match").orderBy(order, "query_id"))).where(F.col("nth") <= n)


def rerank_regressions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Queries whose first match fell after reranking (query_id, rank): (query_id, pre, post, delta, fell_off)."""
    a = before.where("rank > 0").select("query_id", F.col("rank").alias("pre"))
    b = after.where("rank > 0").select("query_id", F.col("rank").alias("post"))
    j = a.join(b, "query_id", "left").where("post is null or post > pre")
    return j.withColumns({"delta": F.col("post") - F.col("pre"), "fell_off": F.col("post").isNull()})


def fingerprint(queries: DataFrame, config: dict[str, str]) -> DataFrame:
    """One row: md5 of all queries in order, their number and the configuration.

    Queries are digested one by one first, so what is gathered is 16 bytes a query of a golden set.
    """
    rows = F.array_sort(F.collect_list(F.struct("query_id", F.md5("query").alias("d"))))
    out = queries.agg(F.md5(F.array_join(F.transform(rows, lambda x: x["d"]), "")).alias("dataset_md5"), F.count("*").alias("n_queries"))
    return out.withColumns({k: F.lit(v) for k, v in config.items()})
