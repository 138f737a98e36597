"""Log-structured tables: each write adds a segment, and a commit record written last makes all its tables count at once.

A segment holds rows of named tables and the keys that it replaces or deletes (``gone``). Reading merges: rows count
if no later segment has their key among the gone. Re-writing a document therefore writes its rows and one key, whatever
else its tenant has. ``compact`` writes what is live as one segment; ``vacuum`` deletes those before. A segment without
its commit record is overwritten by the next write, so one that failed at any point and comes again changes nothing.
A log has one writer at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.store import exists, remove

COMMITS = "segment int, base int, stream string, batch bigint, tables string"
#: Partitions of a table by the hash of its key.
BUCKETS = 16


@dataclass(frozen=True)
class Segments:
    """A log at a path; ``keys`` are the columns that a document or row is replaced by."""

    path: str
    keys: tuple[str, ...]

    def commits(self, spark: SparkSession) -> list:
        """Rows of the segments that count, in order: a row for each write, folded by ``compact``."""
        if not exists(spark, f"{self.path}/commits"):
            return []
        rows = spark.read.schema(COMMITS).parquet(f"{self.path}/commits").orderBy("segment").collect()
        base = max((r["base"] for r in rows), default=0)
        return [r for r in rows if r["segment"] >= base]

    def has(self, spark: SparkSession, stream: str, batch: int) -> bool:
        """Whether a batch of a stream was committed, before or after a compaction."""
        if not exists(spark, f"{self.path}/commits"):
            return False
        return not spark.read.schema(COMMITS).parquet(f"{self.path}/commits").where((F.col("stream") == stream) & (F.col("batch") == batch)).isEmpty()

    def next(self, spark: SparkSession) -> int:
        return 1 + max((r["segment"] for r in self.commits(spark)), default=0)

    def write(self, name: str, rows: DataFrame, segment: int, bucketed: bool = True) -> DataFrame:
        """Rows of a table in a segment, partitioned by a hash of their key; gives them back, computed once."""
        path = f"{self.path}/{name}/segment={segment}"
        out = rows.write.mode("overwrite")
        if bucketed:
            out = rows.withColumn("bucket", self.bucket()).write.mode("overwrite").partitionBy("bucket")
        out.parquet(path)
        return rows.sparkSession.read.schema(rows.schema).parquet(path)

    def bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(BUCKETS)).cast("int")

    def commit(self, spark: SparkSession, segment: int, tables: dict[str, str], stream: str = "", batch: int = -1, base: int | None = None) -> None:
        """The segment counts from here on. ``tables``: name -> schema."""
        own = self.commits(spark)
        known = dict(x.split("=", 1) for r in own for x in r["tables"].split("\n") if x) | tables
        row = (segment, base if base is not None else own[0]["base"] if own else segment, stream, batch, "\n".join(f"{k}={v}" for k, v in known.items()))
        spark.createDataFrame([row], COMMITS).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def tables(self, spark: SparkSession) -> dict[str, str]:
        own = self.commits(spark)
        return dict(x.split("=", 1) for x in own[-1]["tables"].split("\n") if x) if own else {}

    def rows(self, spark: SparkSession, name: str, near: DataFrame | None = None) -> DataFrame | None:
        """All rows of a table, dead ones too, with ``segment``; of the partitions of ``near``'s keys only, where given."""
        schema = self.tables(spark).get(name)
        there = [p for r in self.commits(spark) if exists(spark, p := f"{self.path}/{name}/segment={r['segment']}")]
        if schema is None or not there:
            return None
        found = spark.read.schema(f"{schema}, bucket int, segment int").option("basePath", f"{self.path}/{name}").parquet(*there)
        if near is not None:
            found = found.where(F.col("bucket").isin([r[0] for r in near.select(self.bucket()).distinct().collect()]))  # BUCKETS at most
        return found.drop("bucket")

    def read(self, spark: SparkSession, name: str, near: DataFrame | None = None) -> DataFrame | None:
        """The live rows of a table; None before its first commit. The gone of many segments are reduced before they meet rows."""
        found = self.rows(spark, name, near)
        gone = None if found is None else self.rows(spark, "gone")
        if gone is not None:
            last = gone.groupBy(*[F.col(k).alias(f"__{k}") for k in self.keys]).agg(F.max("segment").alias("__gone"))
            same = F.lit(True)
            for k in self.keys:
                same = same & found[k].eqNullSafe(F.col(f"__{k}"))
            found = found.join(last, same & (F.col("segment") < F.col("__gone")), "left_anti")
        return None if found is None else found.drop("segment")

    def upsert(self, name: str, rows: DataFrame, deleted: DataFrame | None = None) -> None:
        """Adds rows in place of all that have their keys, and deletes the keys of ``deleted``."""
        spark = rows.sparkSession
        segment = self.next(spark)
        rows = self.write(name, rows, segment)
        gone = rows.select(*self.keys)
        gone = gone if deleted is None else gone.unionByName(deleted.select(*self.keys))
        old = self.rows(spark, name)
        if old is not None:
            # A key that is new needs no tombstone.
            gone = gone.distinct().join(old.select(*self.keys).distinct(), list(self.keys), "left_semi")
            self.write("gone", gone, segment, bucketed=False)
        self.commit(spark, segment, {name: ddl(rows), "gone": ddl(gone)})

    def compact(self, spark: SparkSession, sums: dict[str, tuple[str, str]] | None = None) -> None:
        """One segment of what is live. ``sums``: tables of signed counts, name -> (key, count), which are added up."""
        if not self.commits(spark):
            return
        segment = self.next(spark)
        for name in self.tables(spark):
            if name == "gone":
                continue
            if name in (sums or {}):
                key, n = sums[name]
                found = self.rows(spark, name)
                rows = None if found is None else found.groupBy(key).agg(F.sum(n).alias(n)).where(f"{n} <> 0")
            else:
                rows = self.read(spark, name)
            if rows is not None:
                self.write(name, rows, segment, bucketed=name not in (sums or {}))
        self.commit(spark, segment, {}, base=segment)

    def vacuum(self, spark: SparkSession) -> None:
        """Deletes the files of segments that a compaction replaced."""
        own = self.commits(spark)
        for n in range(1, own[0]["base"] if own else 1):
            for name in self.tables(spark):
                remove(spark, f"{self.path}/{name}/segment={n}")


def ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
