"""Incremental ingestion: counts and chunks after any sequence of changes, failures at every write, log-structured tables."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.functions.text import normalised_hash
from lodestone.operators import cleaning
from lodestone.sources.segments import Segments
from lodestone.streaming import ingest as I

SCHEMA = "tenant_id string, doc_id bigint, url string, markdown string"
BLOCKS = [f"Paragraph {k} has some words that fill it." for k in range(6)] + ["# Heading", "[home](http://h) [news](http://n)", "Paragraph 0 has some words that fill it."]


def page(rng):
    return "\n\n".join(rng.choice(BLOCKS) for _ in range(rng.randrange(1, 6)))


def frame(spark, docs):
    return spark.createDataFrame([(t, i, f"http://h/{t}/{i}", m) for (t, i), m in docs.items()], SCHEMA)


def counted(spark, docs):
    """Counts of a fresh run over the documents as they are."""
    blocks = cleaning.parse_blocks(frame(spark, docs).select(F.concat_ws("/", "tenant_id", "doc_id").alias("doc_id"), "markdown"))
    rows = cleaning.document_counts(blocks.withColumn("block_hash", normalised_hash(F.col("content")))).collect()
    return {r["block_hash"]: r["n"] for r in rows if r["n"]}


def state(spark, target):
    counts = I.block_counts(spark, target)
    chunks = I.stored_chunks(spark, target)
    return {r["block_hash"]: r["n"] for r in counts.collect()}, sorted((str(r["tenant_id"]), r["doc_id"], r["chunk_id"], r["text"]) for r in chunks.collect())


def test_counts_are_those_of_the_documents_as_they_are(spark, tmp_path):
    rng, target, now = random.Random(3), str(tmp_path / "store"), {}
    for step in range(4):
        batch = {(rng.choice(["a", "b"]), rng.randrange(8)): page(rng) for _ in range(5)}
        gone = [k for k in rng.sample(sorted(now), min(len(now), 2)) if k not in batch]
        deleted = spark.createDataFrame(gone, "tenant_id string, doc_id bigint") if gone else None
        I.ingest_batch(frame(spark, batch), target, deleted=deleted)
        texts = {(t, m) for (t, _), m in now.items()}
        for (t, i), m in sorted(batch.items()):
            if (t, m) not in texts:
                texts.add((t, m))
                now[t, i] = m
        now = {k: m for k, m in now.items() if k not in gone}
        if step == 2:
            I.compact(spark, target)
        counts, chunks = state(spark, target)
        assert counts == counted(spark, now)
        assert {(t, i) for t, i, _, _ in chunks} == set(now)
        documents = I.chunk_store(target).read(spark, "documents").collect()
        assert Counter((r["tenant_id"], r["doc_id"]) for r in documents) == Counter(list(now))


def test_a_batch_that_failed_anywhere_changes_nothing_and_comes_again(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "store")
    first = {("a", k): f"# T{k}\n\nText number {k} of the first batch." for k in range(3)}
    second = {("a", 1): "# T1\n\nAnother text.", ("a", 7): "New one.\n\nText number 0 of the first batch."}
    I.ingest_batch(frame(spark, first), target, stream="s", batch=0)
    before, write = state(spark, target), Segments.write

    def fails_after(writes):
        done = []

        def fails(self, name, *args, **options):
            done.append(name)
            if len(done) > writes:
                raise OSError("lost")
            return write(self, name, *args, **options)

        return fails

    for writes in range(7):  # the last time all tables are written, but not the commit
        with monkeypatch.context() as m:
            m.setattr(Segments, "write", fails_after(writes))
            m.setattr(Segments, "commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError):
                I.ingest_batch(frame(spark, second), target, stream="s", batch=1)
        assert state(spark, target) == before
    I.ingest_batch(frame(spark, second), target, stream="s", batch=1)
    after = state(spark, target)
    assert after[0] == counted(spark, first | second)
    I.ingest_batch(frame(spark, second | {("a", 99): "Would be new."}), target, stream="s", batch=1)
    assert state(spark, target) == after


def test_re_ingesting_a_document_writes_its_rows_and_a_key(spark, tmp_path):
    target = str(tmp_path / "store")
    I.ingest_batch(frame(spark, {("a", k): f"Text {k} of a tenant with many documents." for k in range(30)} | {(None, 1): "Of nobody.", ("b", 1): "Of b."}), target)
    I.ingest_batch(frame(spark, {("a", 4): "Changed text of one document."}), target)
    store = I.chunk_store(target)
    rows = {r["segment"]: r["n"] for r in store.rows(spark, "chunks").groupBy("segment").agg(F.count("*").alias("n")).collect()}
    assert rows == {1: 32, 2: 1} and store.rows(spark, "gone").count() == 1
    assert store.read(spark, "chunks").count() == 32
    I.ingest_batch(frame(spark, {(None, 1): "Of nobody, again."}), target)
    assert {r["text"] for r in I.stored_chunks(spark, target).where("tenant_id is null").collect()} == {"Of nobody, again."}


def test_log_structured_table(spark, tmp_path):
    log = Segments(str(tmp_path / "log"), ("k",))
    rows = lambda *xs: spark.createDataFrame([(k, v, "x") for k, v in xs], "k int, v string, BUCKETS string")
    assert log.read(spark, "t") is None
    log.upsert("t", rows((1, "a"), (2, "b"), (None, "c"), (3, "d")))
    log.upsert("t", rows((2, "B"), (5, "e")), deleted=rows((1, ""), (77, "")))
    log.upsert("t", rows((1, "again")))
    got = lambda: sorted((str(r["k"]), r["v"]) for r in log.read(spark, "t").collect())
    want = [("1", "again"), ("2", "B"), ("3", "d"), ("5", "e"), ("None", "c")]
    assert got() == want and sorted(r["k"] for r in log.rows(spark, "gone").collect()) == [1, 1, 2]
    log.compact(spark)
    assert got() == want and len(log.commits(spark)) == 1
    log.vacuum(spark)
    assert got() == want
    log.upsert("t", rows((3, "D")), deleted=rows((5, "")))
    assert got() == [("1", "again"), ("2", "B"), ("3", "D"), ("None", "c")]
