"""Sinks: idempotent upserts by key and run reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.sources.segments import ddl


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None, replaced: str | None = None) -> DataFrame:
    """Rows of both tables, the new one's winning; of several new rows of a key that with the largest ``order``.

    ``replaced``: a column (say doc_id) whose values in ``new`` lose all their old rows, as on re-ingestion.
    """
    if replaced:
        old = old.join(new.select(replaced).distinct(), replaced, "left_anti")
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    latest = W.partitionBy(*keys).orderBy(F.desc("__new"), *([F.desc(order)] if order else []))
    return both.withColumn("__n", F.row_number().over(latest)).where("__n = 1").drop("__n", "__new")


def write_by_tenant(df: DataFrame, path: str, tenant: str = "tenant_id") -> None:
    """Overwrites the partitions of the tenants in ``df`` and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(tenant).parquet(path)


def write_reports(reports: dict[str, DataFrame], folder: str) -> None:
    """Each report as JSON in a folder of its own."""
    for name, df in reports.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")


def markdown_table(df: DataFrame, title: str, order: str) -> DataFrame:
    """(at, line): a heading and a pipe table of ``df``'s rows in order, to be written as text."""
    names = df.columns
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in names]
    head = df.sparkSession.createDataFrame([(0, f"## {title}"), (1, ""), (2, "| " + " | ".join(names) + " |"), (3, "|" + " --- |" * len(names))], "at bigint, line string")
    nth = F.row_number().over(W.orderBy(order)) + 3  # a report has few rows
    return head.unionByName(df.select(nth.cast("bigint").alias("at"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line")))


def write_run(reports: dict[str, DataFrame], summary: DataFrame, folder: str, run: str) -> None:
    """One run's reports: JSON tables, a summary in markdown, and a manifest, written last, of what belongs to the run.

    A run whose manifest is missing hasn't ended; it can be written again.
    """
    spark, at = summary.sparkSession, f"{folder}/run={run}"
    write_reports(reports, at)
    summary.orderBy("at").select("line").coalesce(1).write.mode("overwrite").text(f"{at}/summary")
    rows = [(name, spark.read.schema(df.schema).json(f"{at}/{name}").count(), ddl(df)) for name, df in reports.items()]
    spark.createDataFrame([*rows, ("summary", spark.read.text(f"{at}/summary").count(), "line string")], "report string, n_rows bigint, fields string").coalesce(1).write.mode("overwrite").json(f"{at}/manifest")


def read_run(spark: SparkSession, folder: str, run: str, report: str) -> DataFrame:
    """A report of a run that has ended."""
    at = f"{folder}/run={run}"
    listed = spark.read.schema("report string, n_rows bigint, fields string").json(f"{at}/manifest")
    if report == "manifest":
        return listed
    fields = listed.where(F.col("report") == report).first()
    if fields is None:
        raise KeyError(f"run {run} has no report {report}")
    return spark.read.text(f"{at}/summary") if report == "summary" else spark.read.schema(fields["fields"]).json(f"{at}/{report}")


def delete_by_id(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")
