"""Connected components of a table of links, by alternating large-star and small-star rounds (Kiveris et al., 2014).

Every round is two aggregations and two joins over the links; it is written to the shared folder before the next
one reads it, so lineage stays short and a lost executor costs one round at most. Nothing is collected. The links of a
node with many of them meet its least neighbour in a sort-merge join, whose hot partitions adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import new_path, remove, written_at

MAX_ROUNDS = 60


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b", made: list[str] | None = None) -> DataFrame:
    """(node, root) for every node that has a link to another one; root is the least node of its component.

    Null ends and links of a node to itself are left out; repeated links and both directions are fine; an empty
    table gives an empty table. The result is a table in the shared folder; its path is appended to ``made``.
    """
    spark = links.sparkSession
    now = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    path = new_path(spark, "links")
    now = written_at(_small_star(now), path)
    before = None
    for _ in range(MAX_ROUNDS):
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(sums) == before:
            break
        before, new = tuple(sums), new_path(spark, "links")
        now = written_at(_small_star(_large_star(now)), new)
        remove(spark, path)
        path = new
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    if made is not None:
        made.append(path)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
