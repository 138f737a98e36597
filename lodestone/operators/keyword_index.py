"""A keyword index that is kept: positional postings in segments, replaced by chunk id, searched by BM25.

On disk, below one folder, each update adds a segment:

* ``postings``: (term, item, tenant, tf, dl, positions, block), partitioned by a hash of the term, so that a search opens
  the partitions of its terms. An update makes them from the items where these are read, some thousand at a time in the
  order of terms, and shuffles nothing; compaction sorts whole files by term;
* ``blocks``: (term, block, tenant, n, max_tf, min_dl), the dictionary: a block is items of a tenant that came together,
  of at most ``BLOCK_ROWS`` rows of all tenants. A row bounds what the term can add to the score of any of its items, and
  counts them; a block may have several rows for a term. Replaced and deleted items subtract themselves by rows of
  negative ``n``, so counts are exact without looking at postings;
* ``items``: (item, tenant, dl, terms, block), the words in order, ``dl`` null for null texts: what postings are made of,
  and what an item must subtract when it goes;
* ``tombstones``: (item), whose postings in earlier segments are dead;
* ``commits``: one row a segment, written last: which segments count, what they add to the number of items and words.

A segment without its commit is overwritten by the next update: one that fails and comes again changes nothing.
``compact`` writes the live rows of all segments as one. An index has one writer at a time.

A search whose queries and items make few pairs never scores what can't win. Items with all clauses of a query are found
from its rarest clause. Where none has all, the items of the rarest clauses give a score that the k-th best must reach;
blocks whose bounds sum to less are left out, and in the others only items with a clause that is needed to reach it are
scored. A search of more pairs (``MOST_PAIRS``) shuffles its postings once, in lists, and scores them by blocks of items,
which give ``k`` rows a query; pairs are never rows there. Phrases are found the same way.

Defined results: null ids aren't indexed; null and empty texts have no words and are never found, but count as items;
of rows with one id in a batch one stays, by a hash of text and tenant; queries without a word find nothing; a phrase is
counted from left to right without overlap, so "the the the" holds "the the" once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.tenants import GLOBAL_TENANTS
from lodestone.functions.text import WORD, words
from lodestone.operators import retrieval as R
from lodestone.operators.retrieval import B, IDF_FLOOR, K1, MOST_TERMS, bm25_search, best_of_blocks, packed, runs, top_k, unpacked
from lodestone.sources.store import bounded_batches, exists, settled

#: Partitions of the postings, items of a block after compaction, and rows of a batch that share block numbers.
BUCKETS, BLOCK_ITEMS, BLOCK_ROWS = 32, 256, 5_000
#: Words from which on a task's batches are turned into postings, and those of a task that writes them.
INVERTED_WORDS, WRITTEN_WORDS = 1_000_000, 15_000_000
#: Postings whose bounds are found together, and rows that a Python worker gives back at once.
BOUND_ROWS, SENT_ROWS = 500_000, 50_000
#: Ids of items that are sent to every task, some 100 MB; more of them meet the rows in a shuffle.
MOST_IDS = 2_000_000
POSTINGS = "term string, item {item}, tenant string, tf int, dl int, positions array<int>, block int, bucket int"
BLOCKS = "term string, block int, tenant string, n bigint, max_tf int, min_dl int"
ITEMS = "item {item}, tenant string, dl int, terms array<string>, block int"
COMMITS = "segment int, base int, items bigint, words bigint, gone bigint, texts bigint"
EPS = 1e-6
#: Pairs of a query's clause and an item up to which a search looks items up; those of candidates are sent to every task, some 30 MB.
MOST_PAIRS = 300_000


@dataclass(frozen=True)
class KeywordIndex:
    """An index at a path. ``item``: the SQL type of ids. ``stem``: from words to what is indexed, for texts and queries alike.

    ``nulls``: whether null texts count in the mean length of searches, as empty ones do.
    """

    path: str
    item: str = "bigint"
    stem: Callable[[str], str] | None = None
    nulls: bool = True

    # -- reading --------------------------------------------------------------------------------------------------
    def commits(self, spark: SparkSession) -> list:
        """Rows of the segments that count, in order."""
        if not exists(spark, f"{self.path}/commits"):
            return []
        rows = spark.read.schema(COMMITS).parquet(f"{self.path}/commits").withColumn("texts", F.coalesce("texts", "items")).orderBy("segment").collect()
        base = max((r["base"] for r in rows), default=0)
        return [r for r in rows if r["segment"] >= base]

    def _read(self, spark: SparkSession, name: str, schema: str, segments: list[int]) -> DataFrame:
        schema = f"{schema.format(item=self.item)}, segment int"
        there = [p for n in segments if exists(spark, p := f"{self.path}/{name}/segment={n}")]
        return spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*there) if there else spark.createDataFrame([], schema)

    def _live(self, spark: SparkSession, rows: DataFrame, commits: list) -> DataFrame:
        """Rows of items that no later segment replaced or deleted."""
        if not any(r["gone"] for r in commits):
            return rows
        dead = self._read(spark, "tombstones", "item {item}", [r["segment"] for r in commits])
        dead = dead.groupBy(F.col("item").alias("__dead")).agg(F.max("segment").alias("__since"))
        dead = F.broadcast(dead) if sum(r["gone"] for r in commits) <= MOST_IDS else dead
        return rows.join(dead, (F.col("item") == F.col("__dead")) & (F.col("segment") < F.col("__since")), "left_anti")

    def postings(self, spark: SparkSession, wanted: DataFrame | None = None, commits: list | None = None) -> DataFrame:
        """Live postings; of the terms of ``wanted`` (term) only, where given."""
        commits = self.commits(spark) if commits is None else commits
        rows = self._read(spark, "postings", POSTINGS, [r["segment"] for r in commits])
        if wanted is not None:
            wanted = wanted.select("term").distinct()
            of = wanted.agg(F.count("*").alias("n"), F.collect_set(_bucket(F.col("term"))).alias("buckets")).first()  # BUCKETS numbers at most
            rows = rows.where(F.col("bucket").isin(of["buckets"])).join(F.broadcast(wanted) if of["n"] <= MOST_TERMS else wanted, "term", "left_semi")
        return self._live(spark, rows, commits)

    def items(self, spark: SparkSession, commits: list | None = None) -> DataFrame:
        commits = self.commits(spark) if commits is None else commits
        return self._live(spark, self._read(spark, "items", ITEMS, [r["segment"] for r in commits]), commits)

    def dictionary(self, spark: SparkSession, commits: list | None = None) -> DataFrame:
        """Blocks of all segments; of one (term, segment, block, tenant) only the sum of ``n`` tells how many items are left."""
        return self._read(spark, "blocks", BLOCKS, [r["segment"] for r in (self.commits(spark) if commits is None else commits)])

    def terms(self, spark: SparkSession) -> DataFrame:
        """(term, df, cf): in how many live items each term stands, and how often."""
        return self.postings(spark).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))

    def stemmed(self, found: Column) -> Column:
        """An array of words as they are indexed. A worker stems each distinct word of a batch once."""
        if self.stem is None:
            return found
        stem = self.stem

        @F.pandas_udf("array<string>")
        def stems(batch: pd.Series) -> pd.Series:
            known: dict[str, str] = {}
            return pd.Series([None if own is None else [known[w] if w in known else known.setdefault(w, stem(w)) for w in own] for own in batch], dtype=object)

        return stems(found)

    # -- writing --------------------------------------------------------------------------------------------------
    def update(self, chunks: DataFrame, gone: DataFrame | None = None, item: str = "chunk_id", text: str = "text", tenant: str | None = None) -> None:
        """Adds ``chunks``, each replacing what the index has under its id, and deletes the ids of ``gone`` (``item``)."""
        spark = chunks.sparkSession
        bounded_batches(spark)
        commits = self.commits(spark)
        segment = 1 + max((r["segment"] for r in commits), default=0)
        text_ = F.coalesce(F.col(text), F.lit(""))
        own = chunks.select(F.col(item).cast(self.item).alias("item"), (F.col(tenant) if tenant else F.lit(None)).cast("string").alias("tenant"), text_.alias("text"), F.col(text).isNotNull().alias("given")).where("item is not null")
        at = F.monotonically_increasing_id()  # a task's number and 33 bits of its row's
        own = own.select("item", "tenant", "given", self.stemmed(words(F.col("text"))).alias("terms"), F.struct(F.xxhash64("text").alias("hash"), "tenant", at.alias("at")).alias("nth"))
        block = F.pmod(F.shiftright("nth.at", 33), F.lit(1 << 20)) * 1_000 + F.pmod(F.floor(F.col("nth.at").bitwiseAND((1 << 33) - 1) / BLOCK_ROWS), F.lit(1_000))
        own = own.select("item", "tenant", F.when(F.col("given"), F.size("terms")).alias("dl"), "terms", block.cast("int").alias("block"), "nth")
        own = self._settled(own, "items", segment)
        # Only ids meet, not texts: of an id's rows one stays.
        last = own.groupBy("item").agg(F.max("nth").alias("nth"), F.count("*").alias("__n")).where("__n > 1")
        again = settled(last.select("item", F.col("nth").alias("__last")))
        if not again.isEmpty():
            own = own.join(again, "item", "left").where(F.col("__last").isNull() | (F.col("nth") == F.col("__last"))).drop("__last")
            own = self._settled(self._settled(own, "words", segment), "items", segment)
        own = own.drop("nth")
        old = None
        if commits:
            leaving = own.select("item")
            if gone is not None:
                leaving = leaving.unionByName(gone.select(F.col(item).cast(self.item).alias("item")).where("item is not null")).distinct()
            leaving = settled(leaving, "leaving")
            # Many items don't move for few that leave.
            old = self.items(spark, commits).join(F.broadcast(leaving) if leaving.count() <= MOST_IDS else leaving, "item", "left_semi")
        self._write(spark, own, old, segment, commits[0]["base"] if commits else segment)

    def compact(self, spark: SparkSession) -> None:
        """One segment of all live rows in place of the present ones, whose files ``vacuum`` deletes."""
        commits = self.commits(spark)
        if not commits:
            return
        segment = 1 + commits[-1]["segment"]
        n = sum(r["items"] for r in commits)
        items = self.items(spark, commits).drop("segment", "block")
        of_tenants = items.select("item", "tenant")
        self._write_postings(_in_blocks(self.postings(spark, commits=commits).drop("segment", "block"), n, of_tenants).select(*_names(POSTINGS)), segment)
        self._to(_in_blocks(items, n, of_tenants), "items", segment)
        self._to(_blocks(self._read(spark, "postings", POSTINGS, [segment])), "blocks", segment)
        self._commit(spark, segment, segment, sum(r["items"] for r in commits), sum(r["words"] for r in commits), 0, sum(r["texts"] for r in commits))

    def vacuum(self, spark: SparkSession) -> None:
        """Deletes the segments before the last compaction."""
        from lodestone.sources.store import remove

        commits = self.commits(spark)
        for n in range(1, commits[0]["base"] if commits else 1):
            for name in ("postings", "blocks", "items", "tombstones", "words"):
                remove(spark, f"{self.path}/{name}/segment={n}")

    def _settled(self, df: DataFrame, name: str, segment: int) -> DataFrame:
        self._to(df, name, segment)
        return df.sparkSession.read.schema(df.schema).parquet(f"{self.path}/{name}/segment={segment}")

    def _to(self, df: DataFrame, name: str, segment: int, *partitions: str) -> None:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}/segment={segment}", partitionBy=list(partitions) or None)

    def _write_postings(self, postings: DataFrame, segment: int) -> None:
        """Rows of one partition come together; a partition of hot terms is dealt out to several tasks."""
        self._to(postings.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term"), "postings", segment, "bucket")

    def _write_inverted(self, items: DataFrame, n_words: int, segment: int) -> None:
        """Postings of items, made and written by the tasks that read these: each keeps a file open for every bucket, so nothing is sorted."""
        spark, name = items.sparkSession, "spark.sql.maxConcurrentOutputFileWriters"
        tasks = max(spark.sparkContext.defaultParallelism, -(-n_words // WRITTEN_WORDS))
        postings = _inverted(items.coalesce(tasks), self.item).select("*", _bucket(F.col("term")).alias("bucket"))
        before = spark.conf.get(name)
        spark.conf.set(name, str(2 * BUCKETS))
        try:
            self._to(postings, "postings", segment, "bucket")
        finally:
            spark.conf.set(name, before)

    def _write(self, spark: SparkSession, own: DataFrame, old: DataFrame | None, segment: int, base: int) -> None:
        from lodestone.sources.store import remove

        sums = own.agg(F.count("*").alias("items"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words"), F.count("dl").alias("texts")).first()
        self._write_inverted(own, sums["words"], segment)
        blocks, gone = _bounds(self._read(spark, "postings", POSTINGS, [segment])), {"n": 0, "words": 0, "texts": 0}
        if old is not None:
            old = self._settled(old.drop("segment"), "tombstones", segment)
            gone = old.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words"), F.count("dl").alias("texts")).first()
            if gone["n"]:
                less = old.select("tenant", F.explode(F.array_distinct("terms")).alias("term")).groupBy("term", "tenant").agg((-F.count("*")).alias("n"))
                blocks = blocks.unionByName(less.select("term", F.lit(-1).alias("block"), "tenant", "n", F.lit(0).alias("max_tf"), F.lit(0).alias("min_dl")))
        self._to(blocks, "blocks", segment)
        remove(spark, f"{self.path}/words/segment={segment}")
        self._commit(spark, segment, base, sums["items"] - gone["n"], sums["words"] - gone["words"], gone["n"], sums["texts"] - gone["texts"])

    def _commit(self, spark: SparkSession, *row: int) -> None:
        spark.createDataFrame([tuple(map(int, row))], COMMITS).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    # -- searching ------------------------------------------------------------------------------------------------
    def search(self, queries: DataFrame, k: int = 5, tenant: str | None = None, allow_global: bool = False, phrases: bool = True) -> DataFrame:
        """(query_id, rank, chunk_id, score, fallback_used) of ``queries`` (query_id, text and, where named, a tenant).

        Items that hold all clauses of a query; where none of its tenant's does, those that hold some. A clause is a
        word, or with ``phrases`` what stands between white space: words joined by hyphens must stand in a row.
        Statistics are over the items of all tenants. With ``tenant``, a query sees its own tenant's items; without a
        tenant (null, empty, ``ALL``, ``*``) it sees all if ``allow_global`` and nothing otherwise.
        """
        spark = queries.sparkSession
        commits = self.commits(spark)
        total = sum(r["items"] for r in commits)
        if not total or not tenant and not allow_global:
            return spark.createDataFrame([], f"query_id {dict(queries.dtypes)['query_id']}, rank int, chunk_id {self.item}, score double, fallback_used boolean")
        if tenant:
            no_own = F.col(tenant).isNull() | F.col(tenant).isin(*GLOBAL_TENANTS)
            queries = queries.withColumn("__tenant", F.when(~no_own, F.col(tenant)))
            queries = queries if allow_global else queries.where("__tenant is not null")
        else:
            queries = queries.withColumn("__tenant", F.lit(None).cast("string"))
        clauses = clauses_of(queries, phrases, keep=("__tenant",))
        clauses = settled(clauses.withColumn("words", self.stemmed(F.col("words"))).withColumn("clause", F.array_join("words", " ")).dropDuplicates(["query_id", "clause"]))
        found = _Search(self, spark, clauses, commits, k, phrases)
        if found.by_blocks():
            best = found.best()
            return best.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("item").alias("chunk_id"), "score", "fallback_used")
        every = found.every()
        some = found.some(clauses.join(every.select("query_id").distinct(), "query_id", "left_anti"))
        both = every.withColumn("fallback_used", F.lit(False)).unionByName(some.withColumn("fallback_used", F.lit(True)))
        return both.where("score > 0").select("query_id", F.col("rank").cast("int").alias("rank"), F.col("item").alias("chunk_id"), "score", "fallback_used")


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


#: Tenants whose sizes are sent to every task; with more of them blocks are cut by items alone.
MOST_TENANTS = 100_000


def _in_blocks(rows: DataFrame, n: int, items: DataFrame | None = None) -> DataFrame:
    """``rows`` (item, tenant, ...) with a block, of about ``BLOCK_ITEMS`` items of one tenant; ``n`` items in all."""
    sizes = settled((rows if items is None else items).groupBy(F.col("tenant").alias("__tenant")).agg(F.ceil(F.count("*") / BLOCK_ITEMS).cast("int").alias("__blocks")))
    hash_ = F.xxhash64("item")
    if sizes.count() > MOST_TENANTS:
        return rows.withColumn("block", F.pmod(hash_, F.lit(max(1, -(-n // BLOCK_ITEMS)))).cast("int"))
    dealt = rows.join(F.broadcast(sizes), F.col("tenant").eqNullSafe(F.col("__tenant")))
    return dealt.withColumn("block", F.pmod(hash_, F.col("__blocks")).cast("int")).drop("__tenant", "__blocks")


def _blocks(postings: DataFrame) -> DataFrame:
    bounds = postings.groupBy("term", "block", "tenant").agg(F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"))
    return bounds.select("term", "block", "tenant", "n", "max_tf", "min_dl")


def _inverted(items: DataFrame, kind: str) -> DataFrame:
    """Postings of items (item, tenant, dl, terms, block), in the order of terms within some rows of a task."""

    def postings(own: pa.RecordBatch) -> pa.RecordBatch:
        docs, found = own.num_rows, own["terms"].flatten()
        sizes = pc.list_value_length(own["terms"]).to_numpy(zero_copy_only=False).astype(np.int64)
        term = found.dictionary_encode()
        rank = np.empty(len(term.dictionary), np.int64)
        rank[pc.sort_indices(term.dictionary).to_numpy()] = np.arange(len(rank))
        doc = np.repeat(np.arange(docs, dtype=np.int32), sizes)
        at = np.arange(len(doc), dtype=np.int32) - np.repeat((np.cumsum(sizes) - sizes).astype(np.int32), sizes)
        key = rank[term.indices.to_numpy(zero_copy_only=False)] * docs + doc
        order = np.argsort(key, kind="stable")
        starts = runs(key[order])
        del key
        first = order[starts[:-1]]
        of = pa.array(doc[first])
        columns = {"term": found.take(pa.array(first)), "item": own["item"].take(of), "tenant": own["tenant"].take(of), "tf": pa.array(np.diff(starts), pa.int32()), "dl": own["dl"].take(of)}
        positions = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(at[order], pa.int32()))
        return pa.RecordBatch.from_pydict(columns | {"positions": positions, "block": own["block"].take(of)})

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held, n = held + [batch], n + (pc.sum(batch["dl"]).as_py() or 0)
            if n >= INVERTED_WORDS:
                yield from _sent(postings(pa.concat_batches(held)))
                held, n = [], 0
        if n:
            yield from _sent(postings(pa.concat_batches(held)))

    return items.select("item", "tenant", "dl", "terms", "block").mapInArrow(invert, POSTINGS.format(item=kind).removesuffix(", bucket int"))


def _sent(rows: pa.RecordBatch | pa.Table) -> Iterator[pa.RecordBatch]:
    """Rows in batches that the JVM can hold for every task."""
    for at in range(0, rows.num_rows, SENT_ROWS):
        yield from rows.slice(at, SENT_ROWS).to_batches() if isinstance(rows, pa.Table) else [rows.slice(at, SENT_ROWS)]


def _bounds(postings: DataFrame) -> DataFrame:
    """As ``_blocks``, with a row for each ``BOUND_ROWS`` of a task that have some of a block's items: nothing is shuffled."""

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in chain(batches, [None]):
            if batch is not None:
                held, n = held + [batch], n + batch.num_rows
            if n >= BOUND_ROWS or n and batch is None:
                found = pa.Table.from_batches(held).group_by(["term", "block", "tenant"]).aggregate([([], "count_all"), ("tf", "max"), ("dl", "min")])
                yield from _sent(found.select(["term", "block", "tenant", "count_all", "tf_max", "dl_min"]).rename_columns(_names(BLOCKS)))
                held, n = [], 0

    return postings.select("term", "block", "tenant", "tf", "dl").mapInArrow(bounds, BLOCKS)


def clauses_of(queries: DataFrame, phrases: bool = True, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, words): what each query asks for, after its clean-up; with ``phrases`` words between hyphens stay together."""
    plain = F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\p{N}_\s?&+-]", " ")
    found = lambda s: F.regexp_extract_all(s, F.lit(WORD), F.lit(0))
    parts = F.transform(F.split(plain, r"\s+"), found) if phrases else F.transform(found(plain), lambda w: F.array(w))
    return queries.select("query_id", *keep, F.explode(F.array_distinct(F.filter(parts, lambda p: F.size(p) > 0))).alias("words"))


class _Search:
    """One batch of queries over an index. ``clauses``: (query_id, __tenant, words, clause)."""

    def __init__(self, index: KeywordIndex, spark: SparkSession, clauses: DataFrame, commits: list, k: int, phrases: bool) -> None:
        total = sum(r["items"] for r in commits)
        self.clauses, self.k, self.mean = clauses, k, sum(r["words"] for r in commits) / max(1, sum(r["items" if index.nulls else "texts"] for r in commits))
        distinct = clauses.select("clause", "words").distinct()
        single, several = distinct.where(F.size("words") == 1), distinct.where(F.size("words") > 1)
        wanted = clauses.select(F.explode("words").alias("term")).distinct()
        hits = index.postings(spark, wanted, commits)
        wanted = F.broadcast(wanted) if wanted.count() <= MOST_TERMS else wanted
        blocks = index.dictionary(spark, commits).join(wanted, "term", "left_semi").withColumnRenamed("term", "clause")
        phrases = phrases and not several.isEmpty()
        own = hits.join(single.select(F.col("clause").alias("term")), "term", "left_semi") if phrases else hits
        self.hits = own.select(F.col("term").alias("clause"), "item", "tenant", "tf", "dl", "segment", "block")
        counts = settled(blocks.groupBy("clause").agg(F.sum("n").alias("n")))
        if phrases:
            words_of = several.select(F.explode("words").alias("term")).distinct()
            n = counts.join(words_of, F.col("clause") == F.col("term"), "left_semi").agg(F.sum("n")).first()[0] or 0
            words_of = F.broadcast(words_of) if words_of.count() <= MOST_TERMS else words_of
            in_row = settled(_phrase_hits(several, hits.join(words_of, "term", "left_semi"), n, index.item))
            self.hits = self.hits.unionByName(in_row)
            counts = counts.unionByName(in_row.groupBy("clause").agg(F.count("*").alias("n")))
            bounds = in_row.groupBy("clause", "block", "tenant", "segment").agg(F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"))
            blocks = blocks.unionByName(bounds)
        idf = F.greatest(F.lit(IDF_FLOOR), F.log((F.lit(total) - F.col("n") + 0.5) / (F.col("n") + 0.5)))
        weights = counts.where("n > 0").select("clause", "n", idf.alias("idf"))
        self.asked = settled(clauses.join(weights, "clause", "left").select("query_id", "__tenant", "clause", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("idf", F.lit(0.0)).alias("idf")))
        self.blocks = blocks.where("n > 0 and block >= 0")

    def by_blocks(self) -> bool:
        """Whether queries and items make so many pairs that postings meet by blocks of items."""
        n = self.asked.agg(F.count("*").alias("asked"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs")).first()
        return n["pairs"] > MOST_PAIRS and n["asked"] <= R.MOST_ASKED

    def best(self) -> DataFrame:
        """(query_id, rank, item, score, fallback_used): the best items with all clauses, or with some where none has all.

        Each posting that some query may see is shuffled once, in lists.
        """
        counts = self.asked.groupBy("query_id").agg(F.count("*").alias("n_terms"))
        asked = settled(self.asked.join(counts, "query_id").where("n > 0").select("query_id", "__tenant", F.col("clause").alias("term"), "idf", "n_terms", F.lit(self.mean).alias("avgdl"), "n"), "asked")
        n = asked.select("term", "n").distinct().agg(F.sum("n")).first()[0]
        asked, hits = asked.drop("n"), self.hits.withColumnRenamed("clause", "term")
        if asked.where("__tenant is not null").isEmpty():
            asked = asked.drop("__tenant")
        else:
            seen = asked.select(F.col("term").alias("__term"), "__tenant").distinct()
            hits = hits.join(F.broadcast(seen), (F.col("term") == F.col("__term")) & (F.col("__tenant").isNull() | (F.col("__tenant") == F.col("tenant"))), "left_semi")
        return bm25_search(best_of_blocks(hits, asked, n, self.k, "item"), self.k, "item")

    def part(self, tf: str, dl: str) -> Column:
        return F.col("idf") * F.col(tf) * (K1 + 1) / (F.col(tf) + K1 * (1 - B + B * F.col(dl) / F.lit(self.mean)))

    def met(self, asked: DataFrame) -> DataFrame:
        """Clauses of queries with the items that hold them and that the query may see."""
        return asked.join(self.hits, "clause").where(F.col("__tenant").isNull() | (F.col("__tenant") == F.col("tenant")))

    def scored(self, candidates: DataFrame) -> DataFrame:
        """(query_id, item, score, n_matched) of candidates (query_id, item): only their own postings meet."""
        pairs = settled(candidates.join(self.asked.select("query_id", "clause", "idf"), "query_id"))
        # Few pairs go to the postings; many meet them in a shuffle.
        pairs = F.broadcast(pairs) if pairs.count() <= MOST_PAIRS else pairs
        sums = self.hits.join(pairs, ["clause", "item"]).groupBy("query_id", "item")
        return sums.agg(F.round(F.sum(self.part("tf", "dl")), 9).alias("score"), F.count("*").alias("n_matched"))

    def every(self) -> DataFrame:
        """The best items with all clauses, from those of the rarest clause."""
        rarest = W.partitionBy("query_id").orderBy("n", "clause")
        asked = self.asked.withColumns({"nth": F.row_number().over(rarest), "n_clauses": F.count("*").over(W.partitionBy("query_id")), "least": F.min("n").over(W.partitionBy("query_id"))})
        first = asked.where("nth = 1 and least > 0")
        candidates = self.met(first).select("query_id", "item")
        full = self.scored(candidates).join(first.select("query_id", "n_clauses"), "query_id").where("n_matched = n_clauses")
        return settled(top_k(full, self.k, item="item").select("query_id", "rank", "item", "score"))

    def needed(self, rest: DataFrame) -> tuple[DataFrame, DataFrame]:
        """For the queries in ``rest`` (query_id, clause): the clauses that an item can't do without, and the blocks that may hold one of the best ``k``."""
        asked = self.asked.join(rest.select("query_id", "clause"), ["query_id", "clause"], "left_semi").where("n > 0")
        # A score that the k-th best reaches: what the rarest clauses alone give the items that they find.
        before = F.sum("n").over(W.partitionBy("query_id").orderBy("n", "clause").rowsBetween(W.unboundedPreceding, -1))
        seeds = asked.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < 4 * self.k)
        partial = self.met(seeds).groupBy("query_id", "item").agg(F.sum(self.part("tf", "dl")).alias("score"))
        kth = F.max(F.when(F.col("rank") == self.k, F.col("score")))
        least = settled(top_k(partial, self.k, item="item").groupBy("query_id").agg(F.coalesce(kth, F.lit(0.0)).alias("least")))
        seen = asked.join(self.blocks, "clause").where(F.col("__tenant").isNull() | (F.col("__tenant") == F.col("tenant")))
        bound = self.part("max_tf", "min_dl")
        bounds = seen.select("query_id", "clause", F.coalesce("tenant", F.lit("")).alias("of"), "segment", "block", bound.alias("bound")).groupBy("query_id", "of", "segment", "block", "clause").agg(F.max("bound").alias("bound"))
        reach = bounds.groupBy("query_id", "of", "segment", "block").agg(F.sum("bound").alias("reach"))
        reaches = lambda of: F.col(of) + EPS >= F.coalesce("least", F.lit(0.0))
        alive = reach.join(least, "query_id", "left").where(reaches("reach")).select("query_id", "of", "segment", "block")
        most = bounds.groupBy("query_id", "clause").agg(F.max("bound").alias("most")).join(least, "query_id", "left")
        upto = F.sum("most").over(W.partitionBy("query_id").orderBy("most", "clause"))
        return settled(most.withColumn("upto", upto).where(reaches("upto")).select("query_id", "clause")), alive

    def candidates(self, rest: DataFrame) -> DataFrame:
        """(query_id, item): the items that may be among the best ``k`` of the queries in ``rest`` (query_id, clause)."""
        return self._candidates(*self.needed(rest))

    def _candidates(self, needed: DataFrame, alive: DataFrame) -> DataFrame:
        return self._alive(self.met(self.asked.join(needed, ["query_id", "clause"], "left_semi")), alive).select("query_id", "item").distinct()

    @staticmethod
    def _alive(met: DataFrame, alive: DataFrame) -> DataFrame:
        return met.withColumn("of", F.coalesce("tenant", F.lit(""))).join(alive, ["query_id", "of", "segment", "block"], "left_semi")

    def some(self, rest: DataFrame) -> DataFrame:
        """The best items with some clause.

        Looking up each candidate's clauses pays where few items hold a needed clause; a query whose needed clauses are
        in so many items that this is more than all its postings is scored from those, in the blocks that are left.
        """
        needed, alive = self.needed(rest)
        cost = self.asked.join(needed.withColumn("needed", F.lit(True)), ["query_id", "clause"], "left").where("n > 0").groupBy("query_id")
        cost = cost.agg(F.sum("n").alias("all"), (F.sum(F.when(F.col("needed"), F.col("n"))) * F.count("*")).alias("looked_up"))
        many = settled(cost.where("looked_up >= all").select("query_id"))
        of_many = self.met(self.asked.join(rest.select("query_id").distinct(), "query_id", "left_semi").join(many, "query_id", "left_semi"))
        direct = self._alive(of_many, alive).groupBy("query_id", "item").agg(F.round(F.sum(self.part("tf", "dl")), 9).alias("score"))
        looked_up = self.scored(self._candidates(needed.join(many, "query_id", "left_anti"), alive)).drop("n_matched")
        return top_k(direct.unionByName(looked_up), self.k, item="item").select("query_id", "rank", "item", "score")


def _apart(starts: np.ndarray, n: int) -> np.ndarray:
    """Of ascending places those taken from left to right, each at least ``n`` behind the one taken before."""
    taken = np.ones(len(starts), bool)
    for i in (np.flatnonzero(np.diff(starts) < n) + 1).tolist():
        if taken[i - 1]:
            last = starts[i - 1]
        taken[i] = starts[i] >= last + n
    return starts[taken]


def _phrase_hits(phrases: DataFrame, hits: DataFrame, n: int, kind: str) -> DataFrame:
    """(clause, item, ..., tf): how often the words of each phrase (clause, words) stand in a row.

    ``hits``: the words' postings, some ``n`` rows. They meet the phrases by blocks of items, each shuffled once, in lists; in
    a block the places of a phrase's rarest word are looked up among those of its others. What overlaps counts once.
    """
    parts = max(1, -(-n // R.POSTING_BLOCK))
    columns = ("item", "tenant", "tf", "dl", "segment", "of", "positions")
    held = packed(hits.withColumnRenamed("block", "of").withColumn("block", F.pmod(F.xxhash64("item"), F.lit(parts)).cast("int")), *columns)
    sent = phrases.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    names = ["clause", "item", "tenant", "tf", "dl", "segment", "block"]

    def find(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(asked):
            return pd.DataFrame({c: [] for c in names})
        code, terms, c = unpacked(own, *columns)
        at, items = pd.factorize(c["item"])
        row = np.repeat(np.arange(len(code)), c["tf"])
        places, of = (at[row].astype(np.int64) << 32) | c["positions"], code[row]
        order = np.lexsort((places, of))
        places, ends = places[order], np.cumsum(np.bincount(of, minlength=len(terms)))
        known = dict(zip(terms, range(len(terms))))
        found = []
        for clause, words in zip(asked["clause"], asked["words"]):
            codes = [known.get(w) for w in words]
            if None in codes:
                continue
            lists = [places[ends[t - 1] if t else 0 : ends[t]] for t in codes]
            rarest = min(range(len(lists)), key=lambda j: len(lists[j]))
            # A start before its item's first word has no first word.
            starts = lists[rarest] - rarest
            for j, there in enumerate(lists):
                if j != rarest:
                    wanted = starts + j
                    starts = starts[there[np.minimum(np.searchsorted(there, wanted), len(there) - 1)] == wanted]
            if len(starts):
                own_items, tf = np.unique(_apart(starts, len(words)) >> 32, return_counts=True)
                found.append((np.full(len(tf), clause, dtype=object), own_items, tf))
        if not found:
            return pd.DataFrame({c: [] for c in names})
        clause, where, tf = (np.concatenate(x) for x in zip(*found))
        first = np.empty(len(items), np.int64)
        first[at[::-1]] = np.arange(len(at))[::-1]
        one = first[where]
        return pd.DataFrame({"clause": clause, "item": items[where], "tenant": c["tenant"][one], "tf": tf, "dl": c["dl"][one], "segment": c["segment"][one], "block": c["of"][one]})

    return held.groupBy("block").cogroup(sent.groupBy("block")).applyInPandas(find, f"clause string, item {kind}, tenant string, tf int, dl int, segment int, block int")
