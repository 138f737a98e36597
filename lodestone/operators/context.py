"""Context assembly for answers: budgets, citations, prompts, histories, model output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.text import token_estimate

BUDGET = 5_000


def parse_heading_path(path: Column) -> Column:
    """A JSON array of headings, or headings between ' > '."""
    plain = F.filter(F.transform(F.split(path, " > "), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(path.rlike(r"^\s*\["), F.from_json(path, "array<string>")).otherwise(plain)


def context_rows(ranked: DataFrame, budget: int = BUDGET, least: float = 0.0) -> DataFrame:
    """(query_id, rank, chunk_id, tokens, disposition): in rank order, chunks that fit are included, others excluded.

    Chunks that score under ``least`` are excluded. A later chunk may fit where an earlier one didn't. A copy of an
    included text is a duplicate. The fold runs over
    one query's ranked chunks, at most a few dozen.
    """
    row = F.struct("rank", "chunk_id", token_estimate(F.col("text")).alias("tokens"), F.sha2(F.trim("text"), 256).alias("digest"), (F.coalesce(F.col("score"), F.lit(0.0)) < least).alias("low"))
    own = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("c"))
    out = f"array<struct<rank: int, chunk_id: {dict(ranked.dtypes)['chunk_id']}, tokens: int, disposition: string>>"
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("seen"), F.array().cast(out).alias("out"))

    def step(state: Column, x: Column) -> Column:
        copy = ~x["low"] & F.array_contains(state["seen"], x["digest"])
        fits = ~x["low"] & ~copy & (state["used"] + x["tokens"] <= budget)
        what = F.when(copy, "duplicate").when(fits, "included").otherwise("excluded")
        entry = F.struct(x["rank"].cast("int").alias("rank"), x["chunk_id"].alias("chunk_id"), x["tokens"].alias("tokens"), what.alias("disposition"))
        return F.struct(
            F.when(fits, state["used"] + x["tokens"]).otherwise(state["used"]).alias("used"),
            F.when(fits, F.array_append(state["seen"], x["digest"])).otherwise(state["seen"]).alias("seen"),
            F.array_append(state["out"], entry).alias("out"),
        )

    return own.select("query_id", F.explode(F.aggregate("c", start, step, lambda s: s["out"])).alias("e")).select("query_id", "e.*")


def cited(url: Column, path: Column, text: Column) -> Column:
    head = F.concat(F.lit("[Source: "), url, F.when(F.size(path) > 0, F.concat(F.lit(" | Section: "), F.array_join(path, " > "))).otherwise(""), F.lit("]\n"))
    return F.concat(head, text)


def context_text(included: DataFrame) -> DataFrame:
    """(query_id, context_text, total_tokens, n_chunks) of included rows with rank, cited and tokens."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "cited")))
    return included.groupBy("query_id").agg(F.array_join(F.transform(rows, lambda x: x["cited"]), "\n\n---\n\n").alias("context_text"), F.sum("tokens").alias("total_tokens"), F.count("*").alias("n_chunks"))


def history(turns: DataFrame, last: int = 6, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """``turns`` with the ``last`` messages before each, as 'Role: text' lines."""
    before = W.partitionBy(conv).orderBy(turn).rowsBetween(-last, -1)
    line = F.concat(F.initcap("role"), F.lit(": "), F.coalesce("text", F.lit("")))
    return turns.withColumn("history", F.array_join(F.collect_list(line).over(before), "\n"))


def prompt(question: Column, context: Column, past: Column, cite: bool = True) -> Column:
    rules = "Answer from the context only. If it doesn't hold the answer, say so." + (" Cite sources by their headers." if cite else "")
    talk = F.when(past != "", F.concat(F.lit("\n\nConversation:\n"), past)).otherwise("")
    return F.concat(F.lit(rules), talk, F.lit("\n\nContext:\n"), F.coalesce(context, F.lit("")), F.lit("\n\nQuestion: "), question)


def json_of(output: Column, schema: str) -> Column:
    """The object in a model's output, fenced or not; null if there is none."""
    return F.from_json(F.regexp_extract(output, r"(?s)(\{.*\})", 1), schema)


def faithfulness(output: Column, failed: Column) -> tuple[Column, Column, Column]:
    """(score, reason, band) of a judge's output; a failed answer or unreadable output scores 0."""
    read = json_of(output, "score double, reasoning string")
    score = F.when(failed | read["score"].isNull(), 0.0).otherwise(read["score"])
    reason = F.when(failed, "generation failed").when(read["score"].isNull(), "unreadable output").otherwise(F.coalesce(read["reasoning"], F.lit("")))
    return score, reason, F.when(score >= 0.8, "High").when(score >= 0.6, "Partial").otherwise("Low")


def preview(text: Column, n: int = 200) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def empty_contexts(rows: DataFrame) -> DataFrame:
    """Queries all of whose chunks were excluded."""
    counts = rows.groupBy("query_id").agg(F.count_if(F.col("disposition") == "included").alias("included"), F.count_if(F.col("disposition") == "excluded").alias("excluded"))
    return counts.where("included = 0 and excluded > 0").withColumn("message", F.format_string("all %d chunks exceed the budget", "excluded"))


def usage(tokens: Column, text: Column) -> Column:
    """Tokens as reported, else a quarter of the characters."""
    return F.when(F.coalesce(tokens, F.lit(0)) == 0, F.floor(F.length(text) / 4)).otherwise(tokens)


def validated(requests: DataFrame, doc_counts: DataFrame) -> DataFrame:
    """``requests`` with problem (null if fine): query of 1 to 2000 characters, top_k 1 to 20, history of at most 20, a workspace with documents."""
    known = requests.join(doc_counts, "tenant_id", "left")
    problem = (
        F.when(~F.length("query").between(1, 2_000), "query length")
        .when(~F.col("top_k").between(1, 20), "top_k")
        .when(F.col("n_history") > 20, "history")
        .when(F.coalesce("n_docs", F.lit(0)) == 0, "empty workspace")
    )
    return known.withColumn("problem", problem).drop("n_docs")
