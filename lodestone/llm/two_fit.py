"""Best-two-fit packing of documents' tokens into training sequences.

A document's ids and its end id stay together where they fit a window; a longer one is cut into windows, the rest of
it first. A sequence is filled greedily, the longest piece that still fits first. Then its smallest piece gives way to
two unpacked pieces, if two together fill the gap that it leaves more tightly than it did; of all pairs the one of
the largest sum is taken (ties: the pair with the longest piece).

What to fill a sequence with depends on nothing but how many pieces of each length are left, so the plan is made on
the histogram of lengths: at most a window of numbers, whatever the corpus. The same filling is repeated as long as the
counts that it was chosen by last, which gives just the sequences that packing piece by piece would. Pieces are then
numbered within their length, in parts that tasks number by themselves, and a piece's number tells its place.

Defined results: a null text is empty; an empty text is its end id alone; repeated rows are packed as often as they
occur; null ids are kept; an empty table gives an empty table. Other columns of the input take no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.bpe import ids_bytes, tree_bpe
from lodestone.llm.shared import new_path, shuffle_partitions, table, written_at

WINDOW = 2048
END_ID = 0
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


# -- cutting --------------------------------------------------------------------------------------------------------
def cuts(n: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: the rest first, then whole windows."""
    rest = n % window or min(n, window)
    return [(0, rest), *((s, window) for s in range(rest, n, window))]


def token_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the pieces of every document, its end id included."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = tree_bpe(path)
        for batch in batches:
            out = []
            for i, t in zip(batch["id"].astype("Int64"), batch["text"]):
                ids = ids_bytes([*bpe.encode(t), END_ID])
                out += [(i, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cuts(len(ids) // 4, window))]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")]).astype({"doc_id": "Int64"})

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text")).mapInPandas(pieces, PIECES)


# -- planning -------------------------------------------------------------------------------------------------------
def _below(left: np.ndarray, most: int) -> int:
    """The longest length of at most ``most`` of which a piece is left; 0 if there is none."""
    found = np.flatnonzero(left[: most + 1])
    return int(found[-1]) if len(found) else 0


def _pair(left: np.ndarray, more_than: int, most: int) -> tuple[int, int] | None:
    """Two lengths of pieces that are left, x >= y, of the largest sum over ``more_than`` and up to ``most``."""
    lengths = np.flatnonzero(left[: most + 1])
    if not len(lengths):
        return None
    # For each x the largest y <= x that fits; one of a kind needs two pieces for a pair of itself.
    at = np.minimum(np.searchsorted(lengths, most - lengths, "right") - 1, np.arange(len(lengths)))
    alone = (at == np.arange(len(lengths))) & (left[lengths] < 2)
    at = at - alone
    total = np.where(at >= 0, lengths + lengths[np.maximum(at, 0)], 0)
    best = len(total) - 1 - int(total[::-1].argmax())
    return (int(lengths[best]), int(lengths[at[best]])) if total[best] > more_than else None


def fill(left: np.ndarray, window: int = WINDOW) -> list[int]:
    """Lengths of one sequence, in order, taken from ``left`` (how many pieces of each length there are)."""
    own, room = [], window
    while n := _below(left, room):
        k = min(int(left[n]), room // n)
        own += [n] * k
        left[n] -= k
        room -= k * n
    if room and own:
        smallest = own[-1]
        pair = _pair(left, smallest, room + smallest)
        if pair is not None:
            left[smallest] += 1
            own[-1:] = pair
            np.subtract.at(left, list(pair), 1)
    return own


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[list[int], int]]:
    """(lengths in order, how many sequences of them); together they use the histogram exactly.

    A filling is repeated while each length that it takes is left as often as it takes it, and one of the smallest
    piece besides, which was left out for the pair: until then every choice falls out the same.
    """
    left = np.zeros(window + 1, np.int64)
    for n, k in histogram.items():
        left[n] += k
    out = []
    if left[window]:
        out.append(([window], int(left[window])))
        left[window] = 0
    while left.any():
        before = left.copy()
        own = fill(left, window)
        used = before - left
        kinds = np.flatnonzero(used)
        # Greedy filling takes as many of a length as fit; with fewer left than that, other lengths follow.
        times = max(1, int((_safe(before, used, own, window) // used[kinds]).min()))
        left[kinds] -= (times - 1) * used[kinds]
        out.append((own, times))
    return out


def _safe(before: np.ndarray, used: np.ndarray, own: list[int], window: int) -> np.ndarray:
    """Of each length in a filling, the pieces that may go before choices could change.

    A choice looks at a length's count only to know whether enough of it are left for this sequence: as many as the
    greedy filling takes, the swapped smallest piece included, and what the pair takes.
    """
    kinds = np.flatnonzero(used)
    replay = before.copy()
    room, greedy = window, np.zeros_like(before)
    while n := _below(replay, room):
        k = min(int(replay[n]), room // n)
        greedy[n], replay[n], room = k, replay[n] - k, room - k * n
    spare = np.maximum(greedy - used, 0)[kinds]  # the smallest piece, where a pair took its place
    return before[kinds] - spare


def slots(planned: list[tuple[list[int], int]]) -> pd.DataFrame:
    """Ranges of piece numbers of a length, [low, high), that go to the sequences first, first + 1, ... at an offset."""
    rows, used, first = [], {}, 0
    for lengths, times in planned:
        offset = 0
        for n in lengths:
            rows.append((n, used.get(n, 0), first, offset))
            used[n] = used.get(n, 0) + times
            offset += n
        first += times
    return pd.DataFrame(rows, columns=["length", "low", "first", "offset"], dtype="int64")


# -- assignment -----------------------------------------------------------------------------------------------------
def pack_two_fit(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): a row for each piece.

    The written pieces bear row numbers, so that equal rows are dealt out like others.
    """
    spark = docs.sparkSession
    pieces = written_at(token_pieces(docs, path, id_col, text, window).withColumn("row", F.monotonically_increasing_id()), new_path(spark, "pieces"))
    parts = 8 * shuffle_partitions(spark)
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    by_length = {n: g[["low", "first", "offset"]].to_numpy() for n, g in slots(plan(histogram, window)).groupby("length")}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            length, number = batch["length"].to_numpy("int64"), batch["number"].to_numpy("int64")
            sequence, offset = np.zeros(len(batch), "int64"), np.zeros(len(batch), "int64")
            for n in np.unique(length).tolist():
                at, own = np.flatnonzero(length == n), by_length[n]
                k = np.searchsorted(own[:, 0], number[at], side="right") - 1
                sequence[at], offset[at] = own[k, 1] + number[at] - own[k, 0], own[k, 2]
            yield batch.drop(columns="number").assign(doc_id=batch["doc_id"].astype("Int64"), sequence_id=sequence, offset=offset)

    before = counts.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    within = F.row_number().over(W.partitionBy("length", "part").orderBy("row")) - 1
    rows = pieces.withColumn("within", within).join(before, ["length", "part"]).withColumn("number", F.col("within") + F.col("before"))
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "number").mapInPandas(place, f"{PIECES}, sequence_id bigint, offset bigint").withColumnRenamed("doc_id", id_col)


def op11_two_fit(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_two_fit(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
