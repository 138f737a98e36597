"""What the stored index shuffles: searches by blocks of items, phrases in rows, updates where the texts are read."""

import random
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestone.functions.stem import porter_stem
from lodestone.operators import keyword_index as KI
from lodestone.operators import retrieval as R
from lodestone.operators.keyword_index import KeywordIndex
from tests.test_keyword_index import QUERIES, asked, by_hand, frame, got, text


def shuffled(spark):
    """Rows that all stages so far wrote to shuffles."""
    context = spark.sparkContext
    jvm, bus = spark._jvm, context._jsc.sc().listenerBus()
    bus.waitUntilEmpty(30_000)
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(n).shuffleWriteRecords() for n in range(stages.size()))


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(12)
    made = {i: (f"t{rng.choice([0, 0, 1, 2])}", text(rng)) for i in range(300)}
    return made | {400: (None, "red alpha"), 401: ("t0", None), 402: ("t1", "State of the Art report"), 403: ("t1", "art the of state report state-of, the art")}


@pytest.fixture
def small(monkeypatch):
    """Every search meets by blocks, of few postings, packed some rows at a time."""
    monkeypatch.setattr(KI, "MOST_PAIRS", 0)
    monkeypatch.setattr(R, "POSTING_BLOCK", 300)
    monkeypatch.setattr(R, "PACKED_ROWS", 100)
    monkeypatch.setattr(R, "MOST_SCORES", 50)


@pytest.mark.parametrize("stem", [None, porter_stem])
def test_blocks_find_what_lookups_find(spark, docs, tmp_path, small, stem):
    index = KeywordIndex(str(tmp_path / "index"), stem=stem)
    index.update(frame(spark, docs), tenant="tenant_id")
    changed = {i: ("t1", "well-known annual-report of the art") for i in range(20)}
    index.update(frame(spark, changed), spark.createDataFrame([(402,), (999,)], "chunk_id bigint"), tenant="tenant_id")
    now = {i: x for i, x in (docs | changed).items() if i != 402}
    assert got(index.search(asked(spark), 4, tenant="tenant", allow_global=True)) == by_hand(now, QUERIES, 4, stem, allow_global=True)
    assert got(index.search(asked(spark), 4, tenant="tenant")) == by_hand(now, QUERIES, 4, stem)


def test_searches_shuffle_no_pairs(spark, tmp_path, monkeypatch):
    """200 queries that each meet 1,000 items: pairs are 400,000, postings 2,000."""
    monkeypatch.setattr(KI, "MOST_PAIRS", 1_000)
    index = KeywordIndex(str(tmp_path / "index"))
    index.update(spark.range(1_000).select(F.col("id").alias("chunk_id"), F.lit("t0").alias("tenant_id"), F.concat(F.lit("red of the blue n"), "id").alias("text")), tenant="tenant_id")
    queries = spark.range(200).select(F.col("id").alias("query_id"), F.lit("of the").alias("text"), F.lit("t0").alias("tenant"))
    before = shuffled(spark)
    assert index.search(queries, 3, tenant="tenant").count() == 600
    assert shuffled(spark) - before < 10_000


def test_phrases_shuffle_lists(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(KI, "MOST_PAIRS", 1_000)
    index = KeywordIndex(str(tmp_path / "index"))
    index.update(spark.range(5_000).select(F.col("id").alias("chunk_id"), F.lit("t0").alias("tenant_id"), F.when(F.col("id") % 7 == 0, "the of the").otherwise("of a the").alias("text")), tenant="tenant_id")
    queries = spark.createDataFrame([(1, "of-the"), (2, "the-of-the"), (3, "of-a the")], "query_id bigint, text string")
    before = shuffled(spark)
    found = got(index.search(queries, 2, allow_global=True))
    assert [(r[0], r[2], r[4]) for r in found] == [(1, 0, False), (1, 7, False), (2, 0, False), (2, 7, False), (3, 1, False), (3, 2, False)]
    assert shuffled(spark) - before < 2_000


def test_updates_shuffle_no_words(spark, tmp_path):
    index = KeywordIndex(str(tmp_path / "index"))
    rows = spark.range(500).select(F.col("id").alias("chunk_id"), F.lit("t0").alias("tenant_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(199)), lambda k: F.concat(F.lit("w"), (F.col("id") * 7 + k) % 997))).alias("text"))
    before = shuffled(spark)
    index.update(rows, tenant="tenant_id")
    assert shuffled(spark) - before < 2_000  # of 100,000 words
    assert index.terms(spark).agg(F.sum("cf"), F.sum("df")).first() == (100_000, 100_000)


def test_long_items_are_inverted_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(KI, "INVERTED_WORDS", 3)
    index = KeywordIndex(str(tmp_path / "index"))
    items = spark.createDataFrame([(1, None, 7, "a b a c a b a".split(), 0), (2, "x", 0, [], 0), (3, "x", 1, ["b"], 0), (4, "x", 2, ["a", "a"], 0)], "item bigint, tenant string, dl int, terms array<string>, block int").coalesce(1)
    found = KI._inverted(items, "bigint").select("term", "item", "tenant", "tf", "dl", "positions").collect()
    assert sorted(map(tuple, found), key=lambda r: (r[1], r[0])) == [("a", 1, None, 4, 7, [0, 2, 4, 6]), ("b", 1, None, 2, 7, [1, 5]), ("c", 1, None, 1, 7, [3]), ("b", 3, "x", 1, 1, [0]), ("a", 4, "x", 2, 2, [0, 1])]


def test_bounds_are_a_row_for_each_block_of_a_term(spark, docs, tmp_path, monkeypatch):
    """However small the batches that workers get and give, and however few words are inverted at once."""
    monkeypatch.setattr(KI, "INVERTED_WORDS", 200)
    monkeypatch.setattr(KI, "SENT_ROWS", 30)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "20")
    try:
        index = KeywordIndex(str(tmp_path / "index"))
        index.update(frame(spark, docs).coalesce(1), tenant="tenant_id")
    finally:
        spark.conf.set(key, before)
    rows = lambda df: sorted(map(str, df.select("term", "block", "tenant", "n", "max_tf", "min_dl").collect()))
    assert rows(index.dictionary(spark)) == rows(KI._blocks(index.postings(spark)))


def test_segments_are_compressed(spark, docs, tmp_path):
    index = KeywordIndex(str(tmp_path / "index"))
    index.update(frame(spark, docs), tenant="tenant_id")
    index.compact(spark)
    for name in ("postings", "blocks", "items"):
        groups = [pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in Path(tmp_path, "index", name).rglob("*.parquet") if pq.ParquetFile(f).metadata.num_row_groups]
        assert set(groups) == {"ZSTD"}, name


def test_rows_are_sent_in_small_batches(monkeypatch):
    monkeypatch.setattr(KI, "SENT_ROWS", 7)
    whole = pa.table({"n": list(range(20)), "at": [[k] * (k % 3) for k in range(20)]})
    for rows in (whole, whole.combine_chunks().to_batches()[0], pa.concat_tables([whole.slice(0, 3), whole.slice(3)])):
        sent = list(KI._sent(rows))
        assert max(b.num_rows for b in sent) <= 7 and pa.Table.from_batches(sent).equals(whole)
    assert list(KI._sent(whole.slice(0, 0))) == []
