"""Golden sets of evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "query string, expected_topic string, expected_content_type string, acceptable_documents array<string>, acceptable_headings array<string>, difficulty string, category string"
#: What a record without the field means.
DEFAULTS = {"expected_topic": "Unknown", "expected_content_type": "concept", "difficulty": "medium", "category": "Concept"}


def with_defaults(raw: DataFrame) -> DataFrame:
    empty = F.array().cast("array<string>")
    texts = {c: F.coalesce(c, F.lit(v)) for c, v in DEFAULTS.items()}
    return raw.withColumns(texts | {c: F.coalesce(c, empty) for c in ("acceptable_documents", "acceptable_headings")})


def load_eval_queries(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of records, defaults filled in."""
    return with_defaults(spark.read.schema(SCHEMA).json(path, multiLine=True))


def parse_eval_queries(records: DataFrame, column: str = "record") -> DataFrame:
    """Records in a JSON text column, other columns kept."""
    rest = [c for c in records.columns if c != column]
    return with_defaults(records.select(*rest, F.from_json(column, SCHEMA).alias("__r")).select(*rest, "__r.*"))
