"""SimHash near-duplicates with pivot distance tables.

A text is lower-cased (A-Z), cut into words at white space, and every shingle of words is hashed by XXH64. A bit of
the fingerprint is 1 if it is set in over half of the shingles' hashes. Texts link if their fingerprints differ in
at most ``max_distance`` bits; components of links are the near-duplicate classes.

Pairs: the fingerprint is cut into blocks; two fingerprints within the distance agree on all but ``max_distance``
blocks, so grouping by every choice of that many blocks meets each linked pair, for certain. Within a group each
fingerprint has a row of a pivot table, its Hamming distances to fixed reference fingerprints. By the triangle
inequality a pair whose coordinates differ by more than ``max_distance`` anywhere can't be linked; it is
discarded, and survivors are verified bit by bit. (Pivot distances of 64-bit fingerprints crowd around 32, so alone
they would have to look at all pairs; that is why the blocks choose which pairs are looked at.)

Large groups are dealt out: a key with more than ``GROUP`` fingerprints is cut into parts, and every pair of parts
is a group of its own, so none exceeds twice that and no pair is lost. Large groups give a spanning forest of their
links, not all pairs.

Defined results: null and empty texts, and texts of white space, have fingerprint 0 and link like any other; equal
texts have equal fingerprints; repeated rows come back as often as they went in; rows with a null id get the class
of their fingerprint (null if no id is known in it); an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.components import connected_components
from lodestone.llm.shared import joined_evenly, new_path, shuffle_partitions, table, written_at

SEED = 42
PIVOTS = 24
GROUP = 2_048
SMALL = 12
#: Reference fingerprints.
PIVOT_FINGERPRINTS = np.random.Generator(np.random.PCG64(SEED)).integers(0, 2**64, (PIVOTS, 1), dtype=np.uint64)
KEY = ["t", "k", "p", "q"]


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included; of the whole word sequence if there are fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)], np.uint64)
    starts = np.zeros(len(words), np.int64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    np.cumsum(size[:-1] + 1, out=starts[1:])
    ends = (starts + size)[shingle - 1 :].tolist()
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends)), np.uint64, len(ends))


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The SimHash of a text as a signed 64-bit integer."""
    h = shingle_hashes(text, shingle)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for s in range(0, len(h), 65_536):
        part = h[s : s + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(text: str | Column, shingle: int = 4) -> Column:
    """Column of fingerprints (bigint)."""

    @F.pandas_udf("bigint")
    def simhash(batch: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in batch], dtype="int64")

    return simhash(F.col(text) if isinstance(text, str) else text)


def as_hex(fp: str) -> Column:
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


def block_masks(max_distance: int, blocks: int) -> list[int]:
    """Bit masks such that fingerprints within the distance agree under one at least."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    each = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(blocks)]
    masks = [sum(c) for c in combinations(each, blocks - max_distance)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints, whose words are the last axis."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int16)


def _pivot_table(fps: np.ndarray) -> np.ndarray:
    return np.stack([_apart(fps, p[: fps.shape[1]]) for p in PIVOT_FINGERPRINTS], axis=1)


def _small_groups(group: np.ndarray, fps: np.ndarray, most: int, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all linked pairs within groups of at most ``most`` neighbouring rows."""
    pivots, a, b = _pivot_table(fps), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for gap in range(1, most):
        i = np.flatnonzero(group[gap:] == group[:-gap])
        if not len(i):
            break
        for k in range(0, PIVOTS, 8):
            i = i[np.abs(pivots[i, k : k + 8] - pivots[i + gap, k : k + 8]).max(axis=1) <= max_distance]
        i = i[_apart(fps[i], fps[i + gap]) <= max_distance]
        a.append(i)
        b.append(i + gap)
    return np.concatenate(a), np.concatenate(b)


def _large_group(fps: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of a spanning forest of one group's links: sorted by the first pivot's coordinate, each row meets those in its reach."""
    pivots = _pivot_table(fps)
    order = np.argsort(pivots[:, 0], kind="stable")
    fps, pivots = fps[order], pivots[order]
    first, label = pivots[:, 0].astype(np.int64), np.arange(len(fps))
    upto = np.searchsorted(first, first + max_distance, side="right")
    for i in range(len(fps)):
        j = np.arange(i + 1, upto[i])
        j = j[label[j] != label[i]]
        for k in range(1, PIVOTS):
            if len(j) < 64:
                break
            j = j[np.abs(pivots[j, k] - pivots[i, k]) <= max_distance]
        j = j[_apart(fps[j], fps[i]) <= max_distance]
        if len(j):
            met = np.unique(np.r_[label[j], label[i]])
            label[np.isin(label, met)] = met[0]
    own = label != np.arange(len(fps))
    return order[own], order[label[own]]


def links_of(batches: Iterator[pd.DataFrame], max_distance: int, words: list[str]) -> Iterator[pd.DataFrame]:
    """Links (a, b) from rows sorted by group (``KEY``), with a node and its fingerprint's words; a group may span batches."""

    def found(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        fps = np.ascontiguousarray(part[words].to_numpy(np.int64)).view(np.uint64)
        node = part["node"].to_numpy(np.int64)
        key = part[KEY].to_numpy(np.int64)
        new = np.r_[True, (key[1:] != key[:-1]).any(axis=1)]
        group, starts = np.cumsum(new), np.flatnonzero(new)
        size = np.diff(np.r_[starts, len(fps)])
        small = np.flatnonzero(((size <= SMALL) & (size > 1))[group - 1])
        if len(small):
            a, b = _small_groups(group[small], fps[small], SMALL, max_distance)
            if len(a):
                yield pd.DataFrame({"a": node[small[a]], "b": node[small[b]]})
        for s, n in zip(starts[size > SMALL], size[size > SMALL]):
            a, b = _large_group(fps[s : s + n], max_distance)
            if len(a):
                yield pd.DataFrame({"a": node[s + a], "b": node[s + b]})

    held = None
    for batch in batches:
        if not len(batch):
            continue
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        key = held[KEY].to_numpy(np.int64)
        at = len(held) - int((key == key[-1]).all(axis=1)[::-1].cumprod().sum())
        if at:
            yield from found(held.iloc[:at])
            held = held.iloc[at:].reset_index(drop=True)
    if held is not None:
        yield from found(held)


def linked(keyed: DataFrame, max_distance: int, words: list[str]) -> DataFrame:
    """(a, b): links between nodes that share a key (columns t, k), node and fingerprint ``words``.

    Keys with more than ``GROUP`` rows are cut into parts, and each pair of parts is a group.
    """
    sizes = keyed.groupBy("t", "k").count().where(F.col("count") > GROUP)
    parts = F.coalesce(F.ceil(F.col("count") / GROUP), F.lit(1)).cast("long")
    dealt = keyed.join(sizes, ["t", "k"], "left").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.select("t", "k", F.least("part", "with").alias("p"), F.greatest("part", "with").alias("q"), "node", *words)
    near = dealt.repartition(shuffle_partitions(keyed.sparkSession), *KEY).sortWithinPartitions(*KEY, "node")
    return near.mapInPandas(lambda batches: links_of(batches, max_distance, words), "a bigint, b bigint").distinct()


def link_fingerprints(fps: DataFrame, max_distance: int = 4, blocks: int = 6) -> DataFrame:
    """(a, b): links that connect all fingerprints (column ``fp``, distinct) within the distance.

    ``blocks``: more blocks make longer keys and so smaller groups, for more keys a fingerprint: 6 make 15 keys of 21
    bits, enough for tens of millions of fingerprints; 8 make 70 keys of 32 bits, for billions. Links are the same.
    """
    masks = F.array(*[F.lit(m) for m in block_masks(max_distance, blocks)])
    keyed = fps.select("fp", F.posexplode(masks).alias("t", "mask")).select(F.col("fp").alias("node"), "fp", F.col("t").cast("long").alias("t"), F.col("fp").bitwiseAND(F.col("mask")).alias("k"))
    return linked(keyed, max_distance, ["fp"])


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 4, max_distance: int = 4, blocks: int = 6) -> DataFrame:
    """(``id_col``, fp, component_id): every row's fingerprint and the least id that its links reach."""
    made = [new_path(docs.sparkSession, name) for name in ("fingerprints", "classes")]
    rows = written_at(docs.select(F.col(id_col).alias("id"), fingerprints(text, shingle).alias("fp")), made[0])
    own = rows.groupBy("fp").agg(F.min("id").alias("least"))
    roots = connected_components(link_fingerprints(own.select("fp"), max_distance, blocks), made=made)
    member = written_at(own.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), made[1])
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = joined_evenly(member.select("fp", "root"), least, "root").select("fp", "component_id")
    return joined_evenly(rows, classes, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicate_classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", as_hex("fp").alias("fingerprint"), "component_id")
