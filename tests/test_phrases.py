"""Phrases that overlap themselves and passages too short for them, against the SQL of the queries."""

import random

import duckdb
import numpy as np
import pytest

from lodestone import plans
from lodestone.operators import keyword_index as KI
from lodestone.operators.keyword_index import _apart

PASSAGES = [(0, "the the x to y the z the"), (1, "of a b of a of"), (2, "un deux trois"), (3, "the"), (4, None), (5, "?!"), (6, "a a a a"), (7, "the the b zzz nowhere at all")]


def documents():
    rng = random.Random(4)
    texts = [None, "the the the", "the the the the to", "of a of a of", "a a a a a a a", "trois", "un deux trois", "the", ""]
    return texts + [" ".join(rng.choices(["the", "to", "of", "a", "z", "b"], weights=[6, 2, 2, 5, 2, 1], k=rng.randrange(4, 60))) for _ in range(150)]


@pytest.mark.parametrize("name, pairs", [("phrase_topk", 0), ("phrase_topk", 300_000), ("phrase_clauses", 300_000)])
def test_phrases_equal_sql(spark, tmp_path, monkeypatch, name, pairs):
    monkeypatch.setattr(KI, "MOST_PAIRS", pairs)
    docs = [(i, text, f"src{i % 3}") for i, text in enumerate(documents())]
    spark.createDataFrame(docs, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(PASSAGES, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    db = duckdb.connect()
    for table in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    want = db.execute(plans.ORACLES[name])
    found = plans.QUERIES[name](spark, str(tmp_path)).select(*[c[0] for c in want.description])
    assert sorted(map(tuple, found.collect())) == sorted(want.fetchall())


def test_places_apart_are_taken_from_the_left():
    rng = random.Random(5)
    for _ in range(300):
        n, starts = rng.randrange(1, 6), sorted(rng.sample(range(60), rng.randrange(0, 40)))
        taken = []
        for s in starts:
            if not taken or s >= taken[-1] + n:
                taken.append(s)
        assert _apart(np.array(starts, np.int64), n).tolist() == taken
