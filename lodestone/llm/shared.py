"""Helpers that the training-data operators share: the cluster's shared folder, stable samples, id hashes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where a local session names none (tests, a laptop) a temporary folder is made and set; a cluster must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            found = known.get()
        elif not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        else:
            found = "file://" + tempfile.mkdtemp(prefix="spark-")
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    return written_at(df, new_path(df.sparkSession, name))


def written_at(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table of ``written_at`` that no later step reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def unused_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Keys with over this share of all rows are hot; there are fewer of them than its inverse.
HOT_SHARE = 1e-4


def joined_evenly(rows: DataFrame, one: DataFrame, key: str) -> DataFrame:
    """``rows`` joined to ``one``, which has one row of each key; no task takes all rows of a hot key.

    Hot keys' rows of ``one`` are sent to every task: ten thousand at most, whatever the size of ``rows``.
    """
    plain_unions(rows.sparkSession)
    hot = written(rows.groupBy(key).count().where(F.col("count") > max(1_000, int(rows.count() * HOT_SHARE))).select(key), "hot")
    few = F.broadcast(one.join(F.broadcast(hot), key))
    return rows.join(few, key).unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(one, key))


def id_fold(id_col: str | Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds`` (null ids: null)."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(col.cast("string").cast("binary")) % folds


def hash_order(*cols: str | Column) -> Column:
    """A fixed pseudo-random order of rows, the same on every run and at every partitioning."""
    return F.xxhash64(F.lit(20_240_617), *cols)


def hash_share(*cols: str | Column) -> Column:
    """A fixed pseudo-random number from 0 to 1 of a row, other than ``hash_order``."""
    return F.pmod(F.xxhash64(F.lit(77_003), *cols), F.lit(1_000_003)) / 1_000_003.0


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of an Arrow batch between the JVM and a Python worker.
BATCH_BYTES = 4_000_000


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by bytes, not only by rows: ten thousand long texts don't fit a worker.

    A bound that the session has set itself stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def plain_unions(spark: SparkSession) -> None:
    """Unions don't keep their sides' partitioning: partitions that adaptive execution coalesced differently on the two
    sides would be taken for equal ones (Spark 4.1)."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder, for operators in Python: see ``bounded_batches`` and ``plain_unions``."""
    bounded_batches(spark)
    plain_unions(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
