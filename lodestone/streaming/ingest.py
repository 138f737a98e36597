"""Structured Streaming: incremental ingestion and job progress."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lodestone.functions.text import normalised_hash
from lodestone.operators import cleaning, registry
from lodestone.operators.chunking import chunk_documents, chunk_id
from lodestone.operators.slots import embed
from lodestone.sources.segments import Segments, ddl
from lodestone.sources.store import bounded_batches, remove


def chunks_of(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(tenant_id, doc_id, url, markdown) to embedded chunks. ``known``: block counts of earlier documents."""
    own = docs.withColumn("__key", F.to_json(F.struct("tenant_id", "doc_id")))
    cleaned = cleaning.cleaned_or_raw(cleaning.rebuilt(cleaning.clean(own.select("__key", "markdown"), doc="__key", known=known), doc="__key"))
    merged = chunk_documents(cleaned.select("__key", F.col("text").alias("markdown")), doc="__key").withColumnRenamed("doc_id", "__key")
    rows = merged.join(own.select("__key", "doc_id", "tenant_id", "url"), "__key").drop("__key")
    return embed(rows.withColumn("chunk_id", chunk_id(F.col("url"), F.col("chunk_index"))))


#: What a document is known by; one log holds the chunks, the documents' hashes and the block counts.
KEYS = ("tenant_id", "doc_id")


def chunk_store(target: str) -> Segments:
    return Segments(target, KEYS)


def stored_chunks(spark: SparkSession, target: str) -> DataFrame | None:
    """The chunks of all documents as they are now."""
    return chunk_store(target).read(spark, "chunks")


def block_counts(spark: SparkSession, target: str) -> DataFrame | None:
    """(block_hash, n): how many documents hold a block now; the null hash counts documents."""
    rows = chunk_store(target).rows(spark, "counts")
    return None if rows is None else rows.groupBy("block_hash").agg(F.sum("n").alias("n")).where("n <> 0")


def _counted(docs: DataFrame, sign: int) -> DataFrame:
    """Signed counts of documents (blocks): of each block, and of the documents themselves under a null hash."""
    blocks = docs.select(F.explode("blocks").alias("block_hash")).groupBy("block_hash").agg(F.count("*").alias("n"))
    every = docs.agg(F.count("*").alias("n")).select(F.lit(None).cast("string").alias("block_hash"), "n")
    return blocks.unionByName(every).select("block_hash", (F.col("n") * sign).alias("n"))


def ingest_batch(docs: DataFrame, target: str, deleted: DataFrame | None = None, stream: str = "", batch: int = -1) -> None:
    """Adds the documents of one batch to the store at ``target`` and deletes those of ``deleted`` (tenant_id, doc_id).

    Texts that a tenant already has are skipped. A document that comes with another text, or is deleted, is retracted:
    its chunks die by one key, and its blocks are subtracted from the counts that boilerplate is judged by, so counts
    always are those of the documents as they are. Chunks, documents and counts are committed by one record, written
    last; a batch that failed before it, or that comes again (``stream``, ``batch``), changes nothing more. Earlier
    documents are looked up by their key's partitions and narrow columns; their texts aren't read.

    Of rows of one document in a batch one stays, by its text's hash. Null tenants and ids are keys like others.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    store = chunk_store(target)
    if stream and store.has(spark, stream, batch):
        return
    segment = store.next(spark)
    have = store.read(spark, "documents")
    one = docs.groupBy(*KEYS).agg(F.max_by(F.struct("url", "markdown"), F.coalesce(F.sha2("markdown", 256), F.lit(""))).alias("x")).select(*KEYS, "x.url", "x.markdown")
    fresh = registry.deduplicated(one, None if have is None else have.select("tenant_id", "content_hash"), text="markdown")
    blocks = F.array_distinct(F.transform(cleaning.block_array(F.col("markdown")), normalised_hash))
    fresh = store.write("fresh", fresh.withColumn("blocks", F.coalesce(blocks, F.array().cast("array<string>"))), segment, bucketed=False)
    leaving = fresh.select(*KEYS) if deleted is None else fresh.select(*KEYS).unionByName(deleted.select(*KEYS)).distinct()
    old = store.read(spark, "documents", near=leaving)
    if old is not None:
        old, left = old.alias("old"), leaving.select(*[F.col(k).alias(f"__{k}") for k in KEYS])
        same = F.col("old.tenant_id").eqNullSafe(F.col("__tenant_id")) & F.col("old.doc_id").eqNullSafe(F.col("__doc_id"))
        old = store.write("retracted", old.join(left, same, "left_semi"), segment, bucketed=False)
    if fresh.isEmpty() and (old is None or old.isEmpty()):
        return
    change = _counted(fresh, 1) if old is None else _counted(fresh, 1).unionByName(_counted(old, -1))
    known = store.rows(spark, "counts")
    if old is not None:
        known = known.select("block_hash", "n").unionByName(_counted(old, -1))
    chunks = store.write("chunks", chunks_of(fresh, known), segment)
    documents = store.write("documents", fresh.select(*KEYS, "content_hash", "blocks"), segment)
    counts = store.write("counts", change, segment, bucketed=False)
    tables = {"chunks": ddl(chunks), "documents": ddl(documents), "counts": ddl(counts)}
    if old is not None:
        tables["gone"] = ddl(store.write("gone", old.select(*KEYS), segment, bucketed=False))
    store.commit(spark, segment, tables, stream, batch)
    for name in ("fresh", "retracted"):
        remove(spark, f"{target}/{name}/segment={segment}")


def compact(spark: SparkSession, target: str) -> None:
    """One segment in place of many; the files of the old ones are deleted."""
    store = chunk_store(target)
    store.compact(spark, {"counts": ("block_hash", "n")})
    store.vacuum(spark)


def stream_ingest(spark: SparkSession, source: str, schema: str | StructType, target: str, checkpoint: str, files_per_batch: int = 10, prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Ingests what is new in a folder of Parquet files and stops; the checkpoint says where to resume.

    ``prepare`` makes documents (tenant_id, doc_id, url, markdown) of a batch that holds something else.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(lambda df, n: ingest_batch(prepare(df) if prepare else df, target, stream=checkpoint, batch=n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def job_progress(events: DataFrame) -> DataFrame:
    """Latest status and highest progress of each job, for batch tables and for streams in update mode."""
    return events.groupBy("job_id").agg(F.max_by("status", "seq").alias("status"), F.max("pct").alias("progress_pct"), F.count("*").alias("n_events"))


def progress_log(target: str) -> Segments:
    return Segments(target, ("job_id",))


def stream_progress(spark: SparkSession, source: str, schema: str | StructType, target: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None, files_per_batch: int = 100) -> StreamingQuery:
    """Adds what is new in a folder of events to the log of job progress at ``target``, and stops.

    A batch writes one row for each job that it has events of: their number, the highest progress and the latest status
    with its place. Such rows merge in any order, so late events need no state, a batch that comes again is known by its
    commit, and the table is never missing. ``progress_table`` folds them; ``fold_progress`` makes one row of many.
    """
    log = progress_log(target)

    def add(df: DataFrame, batch: int) -> None:
        session = df.sparkSession
        if log.has(session, checkpoint, batch):
            return
        events = prepare(df) if prepare else df
        rows = events.groupBy("job_id").agg(F.max(F.struct("seq", "status")).alias("last"), F.max("pct").alias("pct"), F.count("*").alias("n"))
        segment = log.next(session)
        done = log.write("progress", rows, segment)
        log.commit(session, segment, {"progress": ddl(done)}, checkpoint, batch)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _folded_progress(rows: DataFrame) -> DataFrame:
    return rows.groupBy("job_id").agg(F.max("last").alias("last"), F.max("pct").alias("pct"), F.sum("n").alias("n"))


def progress_table(spark: SparkSession, target: str) -> DataFrame | None:
    """(job_id, status, progress_pct, n_events) of all jobs as they are now."""
    rows = progress_log(target).rows(spark, "progress")
    return None if rows is None else _folded_progress(rows).select("job_id", F.col("last.status").alias("status"), F.col("pct").alias("progress_pct"), F.col("n").alias("n_events"))


def fold_progress(spark: SparkSession, target: str, drop: tuple[str, ...] = ()) -> None:
    """One segment of one row a job; jobs whose latest status is in ``drop`` (such as those long finished) leave the table."""
    log = progress_log(target)
    rows = log.rows(spark, "progress")
    if rows is None:
        return
    segment = log.next(spark)
    log.write("progress", _folded_progress(rows).where(~F.col("last.status").isin(*drop)) if drop else _folded_progress(rows), segment)
    log.commit(spark, segment, {}, base=segment)
    log.vacuum(spark)
