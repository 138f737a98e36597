"""Near-duplicate documents at a Jaccard similarity of word shingles: SimHash candidates, pivot tables, exact verification.

A document is the set of its distinct shingles' hashes. Of each different set the tasks compute a SimHash of
``BITS`` bits and ``BANDS`` keys, each of ``ROWS`` smallest hashes; sets of a key are candidates. (Fingerprints at
this similarity differ in some 40 of 256 bits, so no keys of fingerprint bits meet all pairs, as they do for a few
bits. A pair at 0.8 misses all keys once in 4,500 times, a closer one more rarely.) Within a key's group pivot
distance tables and sizes discard pairs, then the distance itself, both at a bound that one pair in some ten
thousand at the similarity exceeds. What survives links sets into clusters. Each cluster's sets then meet in one
task, which counts what every two of them share, exactly, so every link is a true one.

Tasks give spanning forests, not pairs, so a group of n copies costs n rows. Keys and clusters too large for a task
are dealt into parts. Their parts are linked first, each by itself; then rows outside the group's largest class meet
all of its parts, and each other, which is every pair that is not linked yet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.components import connected_components
from lodestone.llm.shared import joined_evenly, new_path, remove, shuffle_partitions, unused_name, written, written_at
from lodestone.llm.simhash import SEED, shingle_hashes

BITS = 256
WORDS = [f"w{k}" for k in range(BITS // 64)]
BANDS, ROWS = 16, 4
PIVOTS = 16
#: Rows of a part of a key, rows and shingles of a part of a cluster. Groups of up to ``SMALL`` rows give all their pairs.
GROUP, MEMBERS, SHINGLES, SMALL = 2_048, 1_024, 400_000, 12
#: Shingles that this many sets of a group have are counted by a product of matrices, of so many columns at a time.
COMMON, COLUMNS = 16, 2_048
#: Standard deviations over the mean distance of a pair at the similarity.
REACH = 4.0
_RANDOM = np.random.Generator(np.random.PCG64(SEED))
ODD = _RANDOM.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FLIP = _RANDOM.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)
REFERENCES = _RANDOM.integers(0, 2**64, (PIVOTS, BITS // 64), dtype=np.uint64)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; a text without a word has one of its own."""
    h = np.unique(shingle_hashes(text, shingle))
    return h if len(h) else np.zeros(1, np.uint64)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Another hash of hashes, for each k."""
    x = h + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def simhash_of(h: np.ndarray) -> np.ndarray:
    """SimHash of a set of hashes: a bit is 1 if it is set in over half of them."""
    ones = np.zeros(BITS, np.int64)
    for s in range(0, len(h), 16_384):
        part = np.stack([_mixed(h[s : s + 16_384], k) for k in range(BITS // 64)], axis=1)
        ones += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)


def band_keys(h: np.ndarray) -> list[int]:
    """A key for each band of smallest hashes."""
    least = np.full(BANDS * ROWS, np.uint64(2**64 - 1))
    for s in range(0, len(h), 1_024):
        least = np.minimum(least, ((h[s : s + 1_024, None] ^ FLIP) * ODD).min(axis=0))
    digest = xxhash.xxh3_64_intdigest
    keys = [digest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)]
    return [k - (1 << 64) if k >= 1 << 63 else k for k in keys]


def reach(n: np.ndarray, similarity: float) -> np.ndarray:
    """Bits in which fingerprints of sets of the similarity differ, nearly at most, where the smaller set has ``n`` hashes.

    A bit differs with the probability of the angle between the sets in half turns; in small sets ties add up to
    a third to it.
    """
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi) * np.where(n < 64, 4 / 3, 1.03)
    return BITS * p + REACH * np.sqrt(BITS * p * (1 - p))


class Near:
    """Whether rows of one or several groups may be of the similarity, by size, pivot table and distance."""

    def __init__(self, rows: pd.DataFrame, similarity: float) -> None:
        self.n, self.similarity = rows["n"].to_numpy(np.int64), similarity
        self.fps = np.ascontiguousarray(rows[WORDS].to_numpy(np.int64)).view(np.uint64)
        self.pivots = np.stack([np.bitwise_count(self.fps ^ p).sum(axis=1, dtype=np.int16) for p in REFERENCES], axis=1)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        less, more = np.minimum(self.n[i], self.n[j]), np.maximum(self.n[i], self.n[j])
        most = reach(less, self.similarity)
        near = less >= self.similarity * more - 1e-9
        near &= np.abs(self.pivots[i] - self.pivots[j]).max(axis=1) <= most
        return near & (np.bitwise_count(self.fps[i] ^ self.fps[j]).sum(axis=1, dtype=np.int16) <= most)


def _joined(label: np.ndarray, linked: np.ndarray) -> None:
    """Gives all rows that bear a label of the ``linked`` rows the least of these labels."""
    met = np.unique(label[linked])
    label[np.isin(label, met)] = met[0]


def reach_pairs(starts: np.ndarray, near: Near, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs within reach that connect, in each group, all that pairs within reach connect; not those of one root."""
    n = len(root)
    size = np.diff(np.r_[starts, n])
    end = np.repeat(starts + size, size)
    at = np.flatnonzero(np.repeat(size <= SMALL, size))
    for gap in range(1, SMALL):
        at = at[at + gap < end[at]]
        i = at[root[at] != root[at + gap]]
        i = i[near(i, i + gap)]
        yield i, i + gap
    for s, k in zip(starts[size > SMALL].tolist(), size[size > SMALL].tolist()):
        label = np.unique(root[s : s + k], return_inverse=True)[1]
        a, b = [], []
        for i in range(k - 1):
            j = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
            if not len(j):
                continue
            j = j[near(np.full(len(j), s + i), s + j)]
            if len(j):
                j = j[np.unique(label[j], return_index=True)[1]]
                a += [s + i] * len(j)
                b += (s + j).tolist()
                _joined(label, np.r_[i, j])
        yield np.array(a, np.int64), np.array(b, np.int64)


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many hashes each two sets share."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(h) for h in sets])
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.zeros((n, n), np.float32)
    common = np.flatnonzero(often >= COMMON)
    place = np.full(len(often), -1)
    place[common] = np.arange(len(common))
    for s in range(0, len(common), COLUMNS):
        at = np.flatnonzero((place[column] >= s) & (place[column] < s + COLUMNS))
        has = np.zeros((n, min(COLUMNS, len(common) - s)), np.float32)
        has[row[at], place[column[at]] - s] = 1
        shared += has @ has.T
    few = np.flatnonzero((often[column] > 1) & (often[column] < COMMON))
    few = few[np.argsort(column[few], kind="stable")]
    row, column = row[few], column[few]
    for gap in range(1, COMMON - 1):
        i = np.flatnonzero(column[gap:] == column[:-gap])
        if not len(i):
            break
        np.add.at(shared, (row[i], row[i + gap]), 1)
        np.add.at(shared, (row[i + gap], row[i]), 1)
    return shared


def similar_classes(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set the first one that links of the similarity connect it to."""
    size = np.array([len(h) for h in sets], np.float32)
    shared = shared_counts(sets)
    linked = shared >= similarity * (size[:, None] + size[None, :] - shared) - 1e-4
    np.fill_diagonal(linked, True)
    label, before = np.arange(len(sets), dtype=np.int32), None
    while before is None or (label != before).any():
        before = label
        label = np.stack([label[row].min() for row in linked])
        label = label[label]
    return label


def _groups(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """Batches of whole groups, of rows sorted by ``key``."""
    held: pd.DataFrame | None = None
    for batch in batches:
        if not len(batch):
            continue
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        same = (held[key] == held[key].iloc[-1]).all(axis=1).to_numpy()
        at = len(held) - int(same[::-1].cumprod().sum())
        if at:
            yield held.iloc[:at].reset_index(drop=True)
            held = held.iloc[at:].reset_index(drop=True)
    if held is not None:
        yield held


def linked_in_reach(rows: DataFrame, key: list[str], similarity: float) -> DataFrame:
    """Distinct (a, b): nodes within reach of each other, enough to connect all such rows that agree on ``key``."""

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _groups(batches, key):
            node, root = part["node"].to_numpy(np.int64), part["root"].to_numpy(np.int64)
            k = part[key].to_numpy(np.int64)
            starts = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]).any(axis=1)])
            i, j = (np.concatenate(z) for z in zip(*reach_pairs(starts, Near(part, similarity), root)))
            yield pd.DataFrame({"a": np.minimum(node[i], node[j]), "b": np.maximum(node[i], node[j])})

    near = rows.repartition(shuffle_partitions(rows.sparkSession), *key).sortWithinPartitions(*key, "node")
    return near.mapInPandas(pairs, "a bigint, b bigint").distinct()


def linked_in_fact(rows: DataFrame, key: list[str], similarity: float) -> DataFrame:
    """Distinct (a, b): nodes that links of the similarity connect among rows that agree on ``key``, each with the first of its class."""

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _groups(batches, key):
            node, k = part["node"].to_numpy(np.int64), part[key].to_numpy(np.int64)
            starts = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]).any(axis=1)])
            for s, e in zip(starts, np.r_[starts[1:], len(node)]):
                first = similar_classes([np.frombuffer(h, np.uint64) for h in part["h"].iloc[s:e]], similarity)
                own = np.flatnonzero(first != np.arange(e - s))
                if len(own):
                    yield pd.DataFrame({"a": node[s + first[own]], "b": node[s + own]})

    near = rows.repartition(shuffle_partitions(rows.sparkSession), *key).sortWithinPartitions(*key, "node")
    return near.mapInPandas(pairs, "a bigint, b bigint").distinct()


def in_parts(rows: DataFrame, group: str, parts: Column) -> tuple[DataFrame, list[str]]:
    """Rows of each ``group`` dealt into ``parts``; the first row of each part meets the others' again at a deeper level, and so on."""
    dealt = rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node", F.lit(0)), F.col("parts"))).withColumn("depth", F.lit(0))
    levels, others = [dealt], ["node", *(c for c in rows.columns if c not in (group, "node"))]
    most = dealt.agg(F.max("parts")).first()[0] or 1
    while most > 1:
        first = levels[-1].where("parts > 1").groupBy(group, "part").agg(F.min(F.struct(*others, F.col("parts").alias("of"))).alias("x"))
        depth, most = len(levels), -(-most // GROUP)
        first = first.select(group, *[F.col(f"x.{c}").alias(c) for c in others], F.ceil(F.col("x.of") / GROUP).cast("long").alias("parts"))
        levels.append(first.withColumn("part", F.pmod(F.xxhash64("node", F.lit(depth)), F.col("parts"))).withColumn("depth", F.lit(depth)))
    every = levels[0]
    for more in levels[1:]:
        every = every.unionByName(more)
    return every.withColumn("depth", F.col("depth").cast("long")).drop("parts"), [group, "depth", "part"]


def crossing(rows: DataFrame, group: str, size: Column) -> tuple[DataFrame, list[str]]:
    """Rows of each ``group`` dealt so that every two of different roots meet: the largest root's rows once for each part of the others.

    ``size``: of a row, as a share of what a part may hold. Groups of one root are left out.
    """
    by_root = rows.groupBy(group, "root").agg(F.sum(size).alias("s")).groupBy(group).agg(F.max(F.struct("s", "root")).alias("most"), F.sum("s").alias("all"), F.count("*").alias("n"))
    stats = by_root.where("n > 1").select(group, F.col("most.root").alias("largest"), F.greatest(F.ceil("most.s"), F.lit(1)).cast("long").alias("p_n"), F.greatest(F.ceil(F.col("all") - F.col("most.s")), F.lit(1)).cast("long").alias("q_n"))
    met = rows.join(stats, group)
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    own = lambda n: F.pmod(F.xxhash64("node", F.lit(1)), F.col(n))
    large, small = met.where("root = largest"), met.where("root <> largest")
    out = large.withColumn("p", own("p_n")).withColumn("q", F.explode(upto("q_n")))
    out = out.unionByName(small.withColumn("q", own("q_n")).withColumn("p", F.explode(upto("p_n"))))
    two = small.where("q_n > 1").withColumn("x", own("q_n")).withColumn("y", F.explode(upto("q_n")))
    two = two.withColumn("p", -1 - F.least("x", "y")).withColumn("q", F.greatest("x", "y")).drop("x", "y")
    return out.unionByName(two).select(*rows.columns, "p", "q"), [group, "p", "q"]


def with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with ``root``: what ``roots`` says of the node, itself if nothing."""
    return rows.drop("root").join(roots.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))


def near_duplicate_survivors(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each class of near-duplicates: that with the least id (and hash of its text).

    A link is a pair of texts whose sets of distinct shingles have a Jaccard similarity of ``similarity`` or more;
    classes are what links connect. Null, empty and wordless texts are equal to each other. Different texts under one
    id are judged each by itself; of repeated rows one stays. Rows with a null id can't be referred to and stay. An
    empty table gives an empty table. Other columns pass through, whatever their names.
    """
    spark = docs.sparkSession
    made: list[str] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        made.append(new_path(spark, name))
        return written_at(df, made[-1])

    fields = ["node", "n", *WORDS]

    @F.pandas_udf(", ".join(f"{c} bigint" for c in fields) + ", bands array<bigint>")
    def described(batch: pd.Series) -> pd.DataFrame:
        rows = []
        for t in batch:
            h = shingle_set(t, shingle)
            node = xxhash.xxh3_64_intdigest(h.tobytes(), SEED)
            rows.append((node - (1 << 64) if node >= 1 << 63 else node, len(h), *simhash_of(h).tolist(), band_keys(h)))
        return pd.DataFrame(rows, columns=[*fields, "bands"])

    @F.pandas_udf("binary")
    def hashed(batch: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, shingle).tobytes() for t in batch], dtype=object)

    # A text is named by its id and its hash; equal sets are one node, named by the hash of the set.
    name = [F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th")]
    known = docs.where(F.col(id_col).isNotNull())
    rows = kept(known.select(*name, described(F.col(text)).alias("x")).select("id", "th", "x.*"), "described")
    nodes = rows.groupBy("node").agg(F.min(F.struct("id", "th")).alias("of"), *[F.first(c).alias(c) for c in [*fields[1:], "bands"]])
    keyed = nodes.select("node", "of", "n", *WORDS, F.explode("bands").alias("k"))
    crowded = kept(keyed.groupBy("k").count().where("count > 1"), "crowded")
    met = kept(keyed.join(crowded, "k"), "met")

    # Clusters: what is within reach, part by part of each key, then across the parts of the keys that have several.
    columns, alone = ["k", "node", "root", "n", *WORDS], F.col("node").alias("root")
    parts = F.ceil(F.col("count") / GROUP).cast("long")
    dealt, key = in_parts(met.select("k", "node", alone, "n", *WORDS, "count"), "k", parts)
    near = kept(linked_in_reach(dealt, key, similarity), "near")
    clusters = connected_components(near, made=made)
    hot = kept(with_roots(met.where(F.col("count") > GROUP).drop("of"), clusters).select(*columns), "hot-keys")
    if not hot.isEmpty():
        dealt, key = crossing(hot, "k", F.lit(1 / GROUP))
        clusters = connected_components(near.unionByName(kept(linked_in_reach(dealt, key, similarity), "near")), made=made)
    clusters = clusters.select("node", F.col("root").alias("cluster"))
    clusters = kept(clusters.unionByName(clusters.select(F.col("cluster").alias("node"), "cluster").distinct()), "clusters")

    # Only texts in clusters are needed again. Their sets meet cluster by cluster, then across the parts of large ones.
    again = kept(nodes.join(clusters, "node").select("node", "of.id", "of.th", "cluster", "n"), "again")
    texts = known.select(*name, F.col(text).alias("text")).join(again.hint("merge"), ["id", "th"]).groupBy("node", "cluster", "n").agg(F.first("text", ignorenulls=True).alias("text"))
    sets = kept(texts.select("cluster", "node", alone, "n", hashed("text").alias("h")), "sets")
    share = F.greatest(F.lit(1 / MEMBERS), F.col("n") / SHINGLES)
    large = kept(sets.groupBy("cluster").agg(F.ceil(F.sum(share)).cast("long").alias("parts")), "cluster-parts")
    dealt = sets.join(large, "cluster").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    links = kept(linked_in_fact(dealt, ["cluster", "part"], similarity), "similar")
    roots = connected_components(links, made=made)
    across = kept(with_roots(sets.join(large.where("parts > 1"), "cluster").drop("parts"), roots), "large-clusters")
    if not across.isEmpty():
        dealt, key = crossing(across, "cluster", share)
        links = links.unionByName(kept(linked_in_fact(dealt, key, similarity), "similar"))
        roots = connected_components(links, made=made)

    member = rows.select("node").distinct().join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    classes = kept(joined_evenly(rows.select("id", "th", "node"), kept(member, "members"), "node").groupBy("root", "id", "th").count(), "classes")
    least = kept(classes.groupBy("root").agg(F.min(F.struct("id", "th")).alias("of")), "least")
    each = kept(joined_evenly(classes, least, "root").select("id", "th", "count", (F.struct("id", "th") == F.col("of")).alias("stays")), "each")
    as_text = {"id": unused_name(docs, "id"), "th": unused_name(docs, "th")}
    gone, repeated = (written(each.where(w).select("id", "th").withColumnsRenamed(as_text), n) for w, n in (("not stays", "gone"), ("stays and count > 1", "repeated")))
    for path in made:
        remove(spark, path)

    # The texts meet ids and hashes only, in a shuffle whatever their number, so the plan is one at every size.
    same = (F.col(id_col) == F.col(as_text["id"])) & (name[1] == F.col(as_text["th"]))
    stay = docs.join(gone.hint("merge"), same, "left_anti")
    if repeated.isEmpty():
        return stay
    row = F.struct(*[F.col(c) for c in docs.columns])
    single = stay.join(repeated, same, "left_semi").groupBy(F.col(id_col).alias("id"), name[1]).agg(F.min_by(row, F.xxhash64(row)).alias("row"))
    return stay.join(repeated, same, "left_anti").unionByName(single.select("row.*"))
