"""Registry of documents and jobs: upserts, status events, dedup, quotas, cascades, repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.tenants import same_tenant

TERMINAL = ("complete", "failed", "partial_success")


def document_id(tenant: Column, source: Column) -> Column:
    return F.md5(F.concat_ws("_", tenant, source))


def registered(existing: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, status): complete documents stay complete, all others that are registered become pending."""
    a, b = existing.select("doc_id", "status"), new.select("doc_id").distinct().withColumn("new", F.lit(True))
    both = a.join(b, "doc_id", "full")
    return both.select("doc_id", F.when(F.col("status") == "complete", "complete").when(F.col("new"), "pending").otherwise(F.col("status")).alias("status"))


def job_state(events: DataFrame) -> DataFrame:
    """(job_id, status, error, progress_pct, created_at, finished_at, n_events) from events (job_id, seq, ts, status, error, pct)."""
    last = F.max_by(F.struct("status", "error", "ts"), "seq")
    state = events.groupBy("job_id").agg(last.alias("l"), F.max("pct").alias("progress_pct"), F.min("ts").alias("created_at"), F.count("*").alias("n_events"))
    done = F.col("l.status").isin(*TERMINAL)
    return state.select("job_id", "l.status", "l.error", F.when(F.col("l.status") == "complete", 100).otherwise(F.col("progress_pct")).alias("progress_pct"), "created_at", F.when(done, F.col("l.ts")).alias("finished_at"), "n_events")


def with_job_outcome(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """``documents`` (doc_id, status, error, ...) with what their jobs ended in."""
    ended = jobs.where(F.col("status").isin(*TERMINAL)).select("doc_id", F.col("status").alias("__s"), F.col("error").alias("__e"))
    joined = documents.join(ended, "doc_id", "left")
    return joined.withColumns({"status": F.coalesce("__s", "status"), "error": F.coalesce("__e", "error")}).drop("__s", "__e")


def reset_stuck(jobs: DataFrame) -> DataFrame:
    """Queued and processing jobs become failed."""
    stuck = F.col("status").isin("queued", "processing")
    return jobs.withColumn("error", F.when(stuck, "interrupted").otherwise(F.col("error"))).withColumn("status", F.when(stuck, "failed").otherwise(F.col("status")))


def merged_metadata(old: Column, new: Column) -> Column:
    """Both maps; the new one's values win."""
    empty = F.create_map().cast("map<string,string>")
    return F.map_zip_with(F.coalesce(old, empty), F.coalesce(new, empty), lambda _, a, b: F.coalesce(b, a))


def deduplicated(new: DataFrame, complete: DataFrame | None = None, text: str = "text", tenant: str = "tenant_id", order: str = "doc_id") -> DataFrame:
    """``new`` with content_hash, without texts that the tenant has complete, the first of equal texts in the batch."""
    hashed = new.withColumn("content_hash", F.sha2(text, 256))
    if complete is not None:
        hashed = hashed.join(complete.select(tenant, "content_hash").distinct(), [tenant, "content_hash"], "left_anti")
    n = F.row_number().over(W.partitionBy(tenant, "content_hash").orderBy(order))
    return hashed.withColumn("__n", n).where("__n = 1").drop("__n")


def looked_up(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """Documents by (source, tenant); null and empty tenants are equal."""
    d, w = documents.alias("d"), wanted.alias("w")
    return d.join(w, (F.col("d.source") == F.col("w.source")) & same_tenant(F.col("d.tenant_id"), F.col("w.tenant_id"))).select("d.*")


def tenant_quota(documents: DataFrame) -> DataFrame:
    return documents.groupBy("tenant_id").agg(F.sum(F.size("chunk_ids")).alias("n_chunks"))


def workspace_stats(documents: DataFrame) -> DataFrame:
    return documents.groupBy("tenant_id").agg(F.count("*").alias("n_docs"), F.sum("n_chunks").alias("n_chunks"), F.sum("tokens").alias("tokens"))


def title_of(source: Column) -> Column:
    """Last part of a path."""
    return F.element_at(F.split(F.regexp_replace(source, "/+$", ""), "/"), -1)


def delete_cascade(documents: DataFrame, jobs: DataFrame, chunks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the documents in ``gone`` (doc_id, tenant_id) that their tenant owns."""
    owned = documents.join(gone, ["doc_id", "tenant_id"], "left_semi").select("doc_id")
    return tuple(t.join(owned, "doc_id", "left_anti") for t in (documents, jobs, chunks))


def rebuilt(chunks: DataFrame) -> DataFrame:
    """Registry rows from stored chunks (doc_id, tenant_id, chunk_index, chunk_id); rows without ids are skipped."""
    ok = chunks.where("doc_id is not null and chunk_id is not null")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id"))), lambda x: x["chunk_id"])
    return ok.groupBy("doc_id").agg(ids.alias("chunk_ids"), F.max_by("tenant_id", "chunk_index").alias("tenant_id"))


def consistency(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per document: chunks registered and stored, where they differ."""
    stored = chunks.groupBy("doc_id").agg(F.count("*").alias("stored"))
    both = documents.select("doc_id", F.size("chunk_ids").alias("registered")).join(stored, "doc_id", "full")
    both = both.select("doc_id", F.coalesce("registered", F.lit(0)).alias("registered"), F.coalesce("stored", F.lit(0)).alias("stored"))
    return both.where("registered <> stored")


def job_view(jobs: DataFrame, documents: DataFrame) -> DataFrame:
    """Jobs with the chunk count of their document once they are complete or partly so."""
    sizes = documents.select("doc_id", F.size("chunk_ids").alias("n"))
    joined = jobs.join(sizes, "doc_id", "left")
    return joined.withColumn("chunk_count", F.when(F.col("status").isin("complete", "partial_success"), F.coalesce("n", F.lit(0)))).drop("n")
