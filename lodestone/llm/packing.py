"""Packs documents' tokens into training sequences: non-negative least squares over length combinations.

Cutting: documents are cut into whole windows and a rest; the rest is cut at the last multiple of ``GRID`` into a
body and a tail shorter than ``GRID``. Cuts depend on the document alone, so one pass over the texts tokenizes,
cuts and digests the pieces; only their lengths are gathered, as a histogram of at most window / GRID + GRID numbers.

Planning, on that histogram: combinations of up to ``DEPTH`` bodies that fill a window exactly are enumerated, and
non-negative least squares finds how often to repeat each so that the lengths used match the histogram. Counts are
rounded down; what is left (and all tails) is packed greedily, longest first into the fullest window that takes it,
many windows at once while the histogram lasts. As tails of every short length are about, windows fill up; it is
the last sequences of all that may need padding.

Assignment: pieces are numbered within their length, by counts for each (length, bucket) and positions within
buckets, and a piece's number tells its sequence and its offset. The plan's size depends on the window alone.

Defined results: a null text is empty; an empty text is its end token alone; repeated rows are packed as often as
they occur; null ids are kept; an empty table gives an empty table. Other columns of the input take no part.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm.shared import shuffle_partitions, table, written
from lodestone.llm.vocabulary import encoding, ranks

WINDOW = 4096
GRID = 32
DEPTH = 3
END_ID = 2
#: Fixed value: the splitting pattern of vocabularies with word ends.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
WORDS_KEPT = 250_000


# -- tokens ---------------------------------------------------------------------------------------------------------
class WordBpe:
    """Encoder over a vocabulary with word ends that lower-cases and drops white space.

    No token spans white space, so ids of a text are those of its chunks; chunks met are kept in two generations
    of bounded size. Chunks outside ASCII and Latin letters, and texts with added tokens or with separators that
    only some libraries take for white space, go through the tokenizers library itself.
    """

    def __init__(self, path: str) -> None:
        table_, self.added = ranks(path, "</w>")
        self.single = encoding(path, WORD_PATTERN, "</w>")._core_bpe.encode_single_piece
        assert all(b in table_ for b in (b"a", b"a\xff"))
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.pieces = regex.compile(WORD_PATTERN)
        self.plain = re.compile(r"[\x00-ɏ]*\Z")
        self.odd = re.compile("[\x1c-\x1f]|" + "|".join(map(re.escape, self.added)))
        self.young, self.old = _Words(self), {}

    def chunk(self, chunk: str) -> bytes:
        if self.plain.match(chunk) is None:
            return array("I", self.library.encode(chunk, add_special_tokens=False).ids).tobytes()
        ids: list[int] = []
        low = chunk.lower()
        for p in (low,) if low.isalpha() else self.pieces.findall(low):
            ids += self.single(p.encode() + b"\xff")
        return array("I", ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        text = text or ""
        if self.odd.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.young.__getitem__, text.split()))


class _Words(dict):
    """Chunk -> ids; asks the older generation before encoding."""

    def __init__(self, bpe: WordBpe) -> None:
        super().__init__()
        self.bpe = bpe

    def __missing__(self, chunk: str) -> bytes:
        if len(self) > WORDS_KEPT:
            self.bpe.old = dict(self)
            self.clear()
        ids = self.bpe.old.get(chunk)
        if ids is None:
            ids = self.bpe.chunk(chunk)
        if len(chunk) < 64:
            self[chunk] = ids
        return ids


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


# -- cutting --------------------------------------------------------------------------------------------------------
def cuts(n: int, window: int = WINDOW, grid: int = GRID) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole windows, a body of a multiple of ``grid``, a tail."""
    whole, rest = divmod(n, window)
    out = [(k * window, window) for k in range(whole)]
    body = rest - rest % grid
    if body:
        out.append((whole * window, body))
    if rest % grid:
        out.append((whole * window + body, rest % grid))
    return out


def token_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, grid: int = GRID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): the pieces of every document, its end token included."""
    end = np.array([END_ID], "<u4").tobytes()

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = word_bpe(path)
        for batch in batches:
            ids_, start, length, crc, total = [], [], [], [], []
            for i, t in zip(batch["id"].astype("Int64"), batch["text"]):
                ids = bpe.encode(t) + end
                n = len(ids) // 4
                for s, k in cuts(n, window, grid):
                    ids_.append(i)
                    start.append(s)
                    length.append(k)
                    crc.append(zlib.crc32(ids[4 * s : 4 * (s + k)]))
                    total.append(n)
            yield pd.DataFrame({"doc_id": pd.array(ids_, "Int64"), "start": np.array(start, "int64"), "length": np.array(length, "int64"), "ids_crc32": np.array(crc, "int64"), "doc_tokens": np.array(total, "int64")})

    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInPandas(pieces, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


# -- planning -------------------------------------------------------------------------------------------------------
def combinations_filling(units: int, depth: int) -> np.ndarray:
    """Rows of at most ``depth`` positive lengths, largest first and zeros behind, that sum to ``units``."""
    out: list[list[int]] = []

    def extend(head: list[int], left: int) -> None:
        if left == 0:
            out.append(head + [0] * (depth - len(head)))
        elif len(head) < depth:
            for x in range(min(left, head[-1] if head else units), 0, -1):
                if x * (depth - len(head)) < left:
                    break
                extend(head + [x], left - x)

    extend([], units)
    return np.array(out, int)


def non_negative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that minimises |a x - b|: the active-set method of Lawson and Hanson."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        gradient = a.T @ (b - a @ x)
        gradient[free] = -np.inf
        k = int(gradient.argmax())
        if gradient[k] <= 1e-7 * max(1.0, np.abs(b).max()):
            break
        free[k] = True
        while True:
            s = np.zeros_like(x)
            s[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            low = free & (s <= 1e-12)
            if not low.any():
                break
            step = np.min(x[low] / np.maximum(x[low] - s[low], 1e-300))
            x = x + step * (s - x)
            free &= x > 1e-12
            x[~free] = 0
        x = s
    return np.maximum(x, 0)


def plan(histogram: dict[int, int], window: int = WINDOW, grid: int = GRID, depth: int = DEPTH) -> list[tuple[list[int], int]]:
    """(lengths in order, how many sequences of them); together they use the histogram exactly."""
    left = {n: c for n, c in histogram.items() if c > 0}
    out: list[tuple[list[int], int]] = []

    def use(lengths: list[int], times: int) -> None:
        out.append((lengths, times))
        for n in lengths:
            left[n] -= times

    if left.get(window):
        use([window], left[window])
    units = window // grid
    target = np.array([left.get(u * grid, 0) for u in range(1, units)], float)
    combos = combinations_filling(units, depth)
    combos = combos[combos[:, 1] > 0]
    if target.any() and len(combos):
        have = target > 0
        combos = combos[[all(have[x - 1] for x in c if x) for c in combos.tolist()]]
        a = np.zeros((len(target), len(combos)))
        for column in combos.T:
            np.add.at(a, (np.maximum(column - 1, 0), np.arange(len(combos))), column > 0)
        # Long bodies weigh more: what is left of them is harder to place than short ones.
        weight = np.sqrt(np.arange(1, units))
        for k, times in enumerate(np.floor(non_negative_least_squares(a * weight[:, None], target * weight) + 1e-6).astype(int) if len(combos) else []):
            lengths = [int(x) * grid for x in combos[k] if x]
            times = min([int(times), *(left[n] // lengths.count(n) for n in lengths)])
            if times > 0:
                use(lengths, times)
    while any(left.values()):
        lengths, room, taken = [], window, {}
        for n in sorted((n for n, c in left.items() if c), reverse=True):
            k = min(left[n], room // n)
            if k:
                lengths += [n] * k
                taken[n] = k
                room -= k * n
        use(lengths, min(left[n] // k for n, k in taken.items()))
    return out


def plan_slots(planned: list[tuple[list[int], int]]) -> pd.DataFrame:
    """For each length, ranges of piece numbers [low, high) that go to sequences first, first + 1, ... at an offset."""
    rows, used, first = [], {}, 0
    for lengths, times in planned:
        offset = 0
        for n in lengths:
            rows.append((n, used.get(n, 0), used.get(n, 0) + times, first, offset))
            used[n] = used.get(n, 0) + times
            offset += n
        first += times
    return pd.DataFrame(rows, columns=["length", "low", "high", "first", "offset"], dtype="int64")


# -- assignment -----------------------------------------------------------------------------------------------------
def numbered(pieces: DataFrame, buckets: int) -> DataFrame:
    """``pieces`` with ``number``, from 0 within each length: the bucket's start among the length's buckets plus the position in the bucket."""
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
    own = W.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    placed = dealt.withColumn("within", F.row_number().over(own) - 1)
    return placed.join(before, ["length", "bucket"]).withColumn("number", F.col("within") + F.col("before")).drop("bucket", "within", "before")


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, grid: int = GRID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): a row for each piece."""
    spark = docs.sparkSession
    pieces = written(token_pieces(docs, path, id_col, text, window, grid), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = plan_slots(plan(histogram, window, grid))
    by_length = {n: g[["low", "first", "offset"]].to_numpy() for n, g in slots.groupby("length")}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            length, number = batch["length"].to_numpy("int64"), batch["number"].to_numpy("int64")
            sequence, offset = np.zeros(len(batch), "int64"), np.zeros(len(batch), "int64")
            for n in np.unique(length).tolist():
                at, own = np.flatnonzero(length == n), by_length[n]
                k = np.searchsorted(own[:, 0], number[at], side="right") - 1
                sequence[at], offset[at] = own[k, 1] + number[at] - own[k, 0], own[k, 2]
            yield batch.drop(columns="number").assign(doc_id=batch["doc_id"].astype("Int64"), sequence_id=sequence, offset=offset)

    rows = numbered(pieces, 8 * shuffle_partitions(spark)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "number")
    return rows.mapInPandas(place, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")


def op7_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
