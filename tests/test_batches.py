"""Batches that go to Python workers are bounded by bytes: ten thousand long texts aren't held at once."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.plans.common import table
from lodestone.sources import store
from lodestone.streaming.ingest import ingest_batch

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def unset(spark):
    before = spark.conf.get(KEY, None)
    spark.conf.unset(KEY)
    yield spark
    spark.conf.unset(KEY) if before is None else spark.conf.set(KEY, before)


def rows_at_once(df):
    @F.pandas_udf("int")
    def seen(batch: pd.Series) -> pd.Series:
        return pd.Series([len(batch)] * len(batch))

    return df.select(seen("text").alias("n")).agg(F.max("n")).first()[0]


def test_tables_go_to_python_in_bounded_batches(unset, tmp_path):
    unset.range(0, 3_000, 1, 1).select("id", F.repeat(F.lit("some text "), 1_000).alias("text")).write.parquet(str(tmp_path / "labels.parquet"))
    assert rows_at_once(table(unset, str(tmp_path), "labels").coalesce(1)) * 10_000 <= 2 * store.BATCH_BYTES


def test_ingestion_bounds_its_batches(unset, tmp_path):
    docs = unset.createDataFrame([("t", 1, "http://a/1", "# One\n\nSome text of a page.")], "tenant_id string, doc_id bigint, url string, markdown string")
    ingest_batch(docs, str(tmp_path / "store"))
    assert int(unset.conf.get(KEY)) == store.BATCH_BYTES
