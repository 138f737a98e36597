"""Approximate nearest neighbours by cosine with an inverted multi-index.

Unit vectors are cut into two halves and each half is quantised by its own k-means codebook; a pair of centroids is
a cell, so k codewords a half make k * k cells. The index is the rows with their cells, written to the shared
folder. A query walks the centroid pairs in order of summed squared distance, with a heap over the sorted
distances of both halves, until the visited cells hold ``share`` of all rows (and enough for the answer); rows in
visited cells are scored exactly, in double precision on the original vectors.

Codebooks are fitted on a bounded sample (at most ``sample`` rows, those with the least hashed ids); every row is
indexed. Their size grows with the rows, so that a cell holds about ``CELL_ROWS``. Where ``share`` isn't given it is
measured: rows of the sample are looked up among the others, and the share is what they must visit to reach
``recall`` of their true neighbours; that is little for vectors in clusters and over half for random ones.

Cells are dealt into blocks of about ``BLOCK`` rows, a cell larger than that into several, and queries, neighbours
together, into blocks of ``QUERY_BLOCK``; a block of rows is sent to the blocks of queries that visit it, and each
task scores one block of rows for one block of queries and keeps the best of each query.

Defined results: vectors that are null, zero, hold null or non-finite components, or are not of the commonest
length (of equally common ones the shortest), take no part; nor do rows with a null id. A query isn't a candidate of its own: rows of its id are left
out. Queries of one id count once (the smallest vector). Ties go to the smaller id. An empty table gives an empty
table. Other columns take no part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.shared import hash_order, hash_share, new_path, remove, shuffle_partitions, table, written, written_at

#: Rows of a cell for which codebooks are sized, and their least and largest size.
CELL_ROWS, CODEWORDS = 8, (16, 256)
BLOCK = 1_024
QUERY_BLOCK = 2_048
SAMPLE = 20_000
#: Queries on which the share is measured, the part of their true neighbours to reach, and room for what the sample misses.
ASKED, RECALL, ROOM = 256, 0.95, 1.1


def usable(vector: str) -> Column:
    """Whether a vector has components, all finite and not all zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def kmeans(x: np.ndarray, k: int, rounds: int = 15, seed: int = 1) -> np.ndarray:
    """At most ``k`` centroids of the rows, from distinct rows as a start."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    c = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        near = distances(x, c).argmin(axis=1)
        for j in range(len(c)):
            own = x[near == j]
            if len(own):
                c[j] = own.mean(axis=0)
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x**2).sum(axis=1)[:, None] - 2 * x @ c.T + (c**2).sum(axis=1)[None, :]


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@dataclass(frozen=True)
class MultiIndex:
    first: np.ndarray
    second: np.ndarray

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u, h = unit(x), self.first.shape[1]
        return distances(u[:, :h], self.first), distances(u[:, h:], self.second)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.halves(x)
        return a.argmin(axis=1) * len(self.second) + b.argmin(axis=1)

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Summed distance of every row to every cell's centroid pair."""
        a, b = self.halves(x)
        return (a[:, :, None] + b[:, None, :]).reshape(len(x), -1)


def traverse(a: np.ndarray, b: np.ndarray, counts: np.ndarray, enough: int) -> list[int]:
    """Cells by summed distance until they hold ``enough`` rows. ``a``, ``b``: distances of a query's halves to the codewords."""
    p, q = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    heap, seen, out, held = [(a[p[0]] + b[q[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        cell = int(p[i]) * len(b) + int(q[j])
        out.append(cell)
        held += int(counts[cell])
        for n in ((i + 1, j), (i, j + 1)):
            if n[0] < len(a) and n[1] < len(b) and n not in seen:
                seen.add(n)
                heapq.heappush(heap, (a[p[n[0]]] + b[q[n[1]]], *n))
    return out


def best_of(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, reach: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, cosine) of each query's best ``k`` rows among those it reaches."""
    queries, rows = queries.astype(float), rows.astype(float)
    qn, rn = np.sqrt((queries**2).sum(axis=1)), np.sqrt((rows**2).sum(axis=1))
    near = (queries @ rows.T) / qn[:, None] / rn[None, :]
    near[~reach | (ids[None, :] == query_ids[:, None])] = -np.inf
    top = -np.partition(-near, min(k, near.shape[1]) - 1, axis=1)[:, min(k, near.shape[1]) - 1]
    at, to = np.nonzero((near >= top[:, None] - 1e-9) & np.isfinite(near))
    exact = (queries[at] * rows[to]).sum(axis=1) / (qn[at] * rn[to])
    order = np.lexsort((ids[to], -exact, at))
    at, to, exact = at[order], to[order], exact[order]
    rank = np.arange(len(at)) - np.searchsorted(at, at)
    keep = rank < k
    return query_ids[at[keep]], ids[to[keep]], exact[keep]


def measured_share(index: MultiIndex, u: np.ndarray, k: int, recall: float) -> float:
    """The share of rows that searches among the unit vectors ``u`` must visit to find ``recall`` of their ``k`` nearest others."""
    if len(u) <= k + 1:
        return 1.0
    asked = np.random.default_rng(2).permutation(len(u))[:ASKED]
    near = u[asked] @ u.T
    near[np.arange(len(asked)), asked] = -np.inf
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    cells = index.cells(u)
    counts = np.bincount(cells, minlength=len(index.first) * len(index.second))
    sums = index.sums(u[asked])
    need = []
    for row, own in zip(sums, best):
        order = np.argsort(row, kind="stable")
        upto, place = np.cumsum(counts[order]), np.empty(len(order), int)
        place[order] = np.arange(len(order))
        need += upto[place[cells[own]]].tolist()
    return float(np.quantile(need, recall)) / len(u)


def nearest(df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = 5, codewords: int | None = None, share: float | None = None, sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, ``id_col``, score): for each row of ``queries`` its ``k`` nearest rows of ``df``."""
    made: list[str] = []

    def kept(rows: DataFrame, name: str) -> DataFrame:
        made.append(new_path(df.sparkSession, name))
        return written_at(rows, made[-1])

    clean = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).alias("v")).where("id is not null").where(usable("v"))
    asked = queries.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).alias("v")).where("id is not null").where(usable("v"))
    sizes = clean.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    out = f"query_id bigint, rank int, {id_col} bigint, score double"
    if not sizes:
        return df.sparkSession.createDataFrame([], out)
    dim, n = sizes[0]["dim"], sizes[0]["count"]
    clean, asked = clean.where(F.size("v") == dim), asked.where(F.size("v") == dim)
    taken = clean.where(hash_share("id") < 1.2 * sample / n + 1e-3).select("v", hash_order("id").alias("at")).orderBy("at", "v").limit(sample).collect()
    u = unit(np.array([r["v"] for r in taken] or [r["v"] for r in clean.orderBy(hash_order("id"), "v").select("v").limit(CODEWORDS[0]).collect()], float))
    h = max(1, dim // 2)
    codewords = codewords or int(np.clip(np.sqrt(n / CELL_ROWS), *CODEWORDS))
    index = MultiIndex(kmeans(u[:, :h], codewords), kmeans(u[:, h:], codewords) if dim > 1 else np.zeros((1, 0)))
    cells_n = len(index.first) * len(index.second)

    @F.pandas_udf("int")
    def cell_of(batch: pd.Series) -> pd.Series:
        return pd.Series(index.cells(np.stack(batch.to_numpy())) if len(batch) else [], dtype="int32")

    share = share or min(1.0, ROOM * measured_share(index, u, k, recall))
    rows = kept(clean.withColumn("cell", cell_of("v")), "multi-index")
    counts = np.zeros(cells_n, np.int64)
    for r in rows.groupBy("cell").count().collect():
        counts[r["cell"]] = r["count"]
    # Blocks: small cells together, large ones in parts. Their number follows the rows; the table of cells doesn't.
    parts = np.maximum(1, -(-counts // BLOCK))
    first_block, now, room = np.zeros(cells_n, np.int64), -1, 0
    for c in range(cells_n):
        if now < 0 or parts[c] > 1 or counts[c] > room:
            first_block[c], room = now + 1, BLOCK - counts[c] if parts[c] == 1 else 0
            now += parts[c]
        else:
            first_block[c], room = now, room - counts[c]
    enough = max(int(np.ceil(share * n)), k + 1)

    def reached(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["v"].to_numpy()).astype(float)
            for i, v, to, a, b in zip(batch["id"], batch["v"], batch["query_block"], *index.halves(x)):
                # Rows of the query's own id don't count: one more cell than enough for them.
                visited = traverse(a, b, counts, enough)
                limit = max(a[c // len(b)] + b[c % len(b)] for c in visited)
                blocks = sorted({int(first_block[c] + p) for c in visited if counts[c] for p in range(parts[c])})
                yield pd.DataFrame({"query_id": i, "q": [v] * len(blocks), "reach": limit, "block": np.array(blocks, "int64"), "query_block": to})

    single = asked.groupBy("id").agg(F.min("v").alias("v")).withColumn("cell", cell_of("v"))
    # Queries of neighbouring cells go to the same block; a cell with many is dealt over several.
    asked_counts = np.zeros(cells_n, np.int64)
    single = kept(single.repartition(shuffle_partitions(df.sparkSession), "id"), "queries")
    for r in single.groupBy("cell").count().collect():
        asked_counts[r["cell"]] = r["count"]
    before = np.cumsum(asked_counts) - asked_counts

    @F.pandas_udf("bigint")
    def query_block_of(cell: pd.Series, at: pd.Series) -> pd.Series:
        c = cell.to_numpy()
        return pd.Series((before[c] + at.to_numpy() % np.maximum(asked_counts[c], 1)) // QUERY_BLOCK, dtype="int64")

    at = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    placed = single.withColumn("query_block", query_block_of("cell", at)).select("id", "v", "query_block")
    wanted = kept(placed.mapInPandas(reached, "query_id bigint, q array<double>, reach double, block bigint, query_block bigint"), "wanted")

    @F.pandas_udf("bigint")
    def block_of(cell: pd.Series, part: pd.Series) -> pd.Series:
        c = cell.to_numpy()
        return pd.Series(first_block[c] + part.to_numpy() % parts[c], dtype="int64")

    dealt = rows.withColumn("block", block_of("cell", at)).join(wanted.select("block", F.col("query_block").alias("to")).distinct(), "block")

    def scored(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": np.zeros(0, "int64"), "id": np.zeros(0, "int64"), "score": np.zeros(0)})
        if not len(left) or not len(right):
            return empty
        x, cells = np.stack(left["v"].to_numpy()), left["cell"].to_numpy()
        parts_ = []
        for s in range(0, len(right), 512):
            part = right.iloc[s : s + 512]
            q = np.stack(part["q"].to_numpy())
            a, b = index.halves(q)
            reach = a[:, cells // b.shape[1]] + b[:, cells % b.shape[1]] <= part["reach"].to_numpy()[:, None] + 1e-9
            parts_.append(best_of(q, part["query_id"].to_numpy(), x, left["id"].to_numpy(), reach, k))
        a, b, s_ = (np.concatenate(z) for z in zip(*parts_))
        return pd.DataFrame({"query_id": a, "id": b, "score": s_})

    near = dealt.groupBy("block", "to").cogroup(wanted.groupBy("block", "query_block")).applyInPandas(scored, "query_id bigint, id bigint, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    found = written(near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score"), "nearest")
    for path in made:
        remove(df.sparkSession, path)
    return found


def op8_multi_index(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))
