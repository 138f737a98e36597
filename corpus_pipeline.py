"""From raw documents to training sequences: five stages, each over all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.language import fit_likeness
from lodestone.llm.near_duplicates import near_duplicate_survivors
from lodestone.llm.packing import pack
from lodestone.llm.pii import session_key, pseudonymise
from lodestone.llm.shared import bounded_batches, new_path, table, written_at
from lodestone.llm.toxicity import fit_toxicity

#: Documents at least this likely toxic go. Toxic texts are one in ten, so this is already many times the usual likelihood.
TOXIC = 0.3


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects toxic documents; learns from labelled ones, as the toxicity query does."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return model.score(docs, out="__toxicity").where(F.col("__toxicity") < TOXIC).drop("__toxicity")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter or unlike every language of the corpus, by bars that its own documents set."""
    bounded_batches(spark)
    return docs.where(~fit_likeness(docs).unlike("text"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates: five-word shingles, a similarity of 0.8 or more."""
    bounded_batches(spark)
    return near_duplicate_survivors(docs, shingle=5, similarity=0.8)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by pseudonyms of the same format."""
    bounded_batches(spark)
    done = pseudonymise(docs, session_key(spark), found=None)
    return done.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else done


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences."""
    import public_tokenizers

    bounded_batches(spark)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("pseudonyms", pseudonyms),
    ("packing", packing),
]
#: SQL can't express the stages; tests compare them with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written_at(stage(spark, docs, sf_dir), new_path(spark, name))
    return STAGES[-1][1](spark, docs, sf_dir)
