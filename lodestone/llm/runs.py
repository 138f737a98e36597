"""Periodic runs of words, found while the words arrive: catchers over completed power-of-two blocks.

A run of period q is a longest stretch in which words q apart are identical; in other words, a streak of places i
with word i = word i - q, and the q words before it. For periods from 2^k to 2^(k+1) - 1 (at k = 3 from 1 on), every
block of 2^k words that is completed has a catcher: it compares the block's name (a hash that doubles with k) with
the names of the stretches q before it. A streak of two periods, or of 24 - q words if that is more, always holds a
whole block, so a run of three periods and 24 words is caught at the latest when its last such block is completed.
A catch is verified word by word, carried to the left once, and stays open: each appended word compares itself with
the word q before it, which extends the streak or ends it. All squares of a streak merge into one run.

A stretch that is periodic is so with each multiple of its period. Catches whose stretch lies in a known streak of a
divisor of their period are dropped: the whole run would then have the shorter period.

Words may be appended one by one or in batches of any size with the same result. Names are kept for the last few
blocks of each size, so that a text needs its words and a multiple of its longest blocks.

Defined results: null and empty texts have no words and no run (four nulls, digests of empty strings); null ids alter
nothing; equal rows get equal results, each its own; very long texts are taken whole, in batches; an empty table
gives an empty table. Other columns of the input take no part.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction
from itertools import compress, count

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import table

#: A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: The smallest blocks have 2^FIRST words: the largest that every run of period below 2^(FIRST + 1) must hold.
FIRST = 3
#: Words appended at once.
BATCH = 32_768
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of stretches from the names of their halves."""
    x = a * _A + b
    x ^= x >> np.uint64(31)
    return x * _B


class SquareCatcher:
    """Finds runs of at least ``LEAST_WORDS`` words and ``LEAST_PERIODS`` periods in a growing sequence of integers."""

    def __init__(self) -> None:
        self.words, self.n = np.empty(64, np.int64), 0
        self.names: list[np.ndarray] = []  # of stretches of 2^(FIRST + level) words
        self.base: list[int] = []  # where the first kept name of a level starts
        self.done: list[int] = []  # completed blocks of a level whose catchers have looked back
        self.open: dict[int, int] = {}  # period -> start of the streak that still goes on
        self.spans: list[tuple[int, int, int]] = []  # (start, end, period) of streaks that ended
        self.runs: dict[tuple[int, int], int] = {}  # (start, end) -> smallest period

    def append(self, words: np.ndarray) -> list[tuple[int, int, int]]:
        """Takes more words; returns (start, end, period) of stretches that now end in or hold new squares."""
        old, self.n = self.n, self.n + len(words)
        if self.n > len(self.words):
            self.words = np.concatenate([self.words[:old], np.empty(max(self.n, 2 * old) - old, np.int64)])
        self.words[old : self.n] = words
        grown = []
        for q, start in list(self.open.items()):
            end = self._forward(q, old)
            if end < self.n:
                del self.open[q]
                self._end(q, start, end)
            grown.append((start - q, end, q))
        level = 0
        while LEAST_PERIODS << (FIRST + level) <= self.n:
            if level == len(self.names):
                self.names.append(np.empty(0, np.uint64))
                self.base.append(0)
                self.done.append(0)
            self._name(level)
            grown += self._look_back(level)
            level += 1
        for k in range(level):
            keep = self.n - (8 << (FIRST + k))
            if keep > 2 * self.base[k] and keep > self.base[k]:
                self.names[k], self.base[k] = self.names[k][keep - self.base[k] :].copy(), keep
        return [x for x in grown if x[1] - x[0] >= 2 * x[2] and x[1] > old]

    def finish(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of all runs, by start, then period."""
        for q, start in self.open.items():
            self._end(q, start, self.n)
        self.open = {}
        return sorted((a, e - a, q) for (a, e), q in self.runs.items())

    # -- names of stretches -----------------------------------------------------------------------------------------
    def _name(self, level: int) -> None:
        size = 1 << (FIRST + level)
        first, end = self.base[level] + len(self.names[level]), self.n - size + 1
        if end <= first:
            return
        if level == 0:
            x = (self.words[first : self.n].astype(np.uint64) + np.uint64(1)) * _B
            for half in (1 << j for j in range(FIRST)):
                x = _pair(x[:-half], x[half:])
        else:
            lower, at, half = self.names[level - 1], first - self.base[level - 1], size // 2
            x = _pair(lower[at : at + end - first], lower[at + half : at + half + end - first])
        self.names[level] = np.concatenate([self.names[level], x])

    # -- catchers ---------------------------------------------------------------------------------------------------
    def _look_back(self, level: int) -> list[tuple[int, int, int]]:
        """Catches of the blocks completed since: each block's name against those that start a period before it."""
        size = 1 << (FIRST + level)
        low, high = 1 if level == 0 else size, 2 * size
        first, last = self.done[level], self.n // size
        if last <= first:
            return []
        self.done[level] = last
        names, base = self.names[level], self.base[level]
        left, right = first * size - high + 1, (last - 1) * size - low + 1
        before = names[max(left, 0) - base : max(right - base, 0)]
        if left < 0:
            before = np.concatenate([np.zeros(min(-left, right - left), np.uint64), before])
        blocks = np.arange(first, last) * size
        row, column = np.nonzero(sliding_window_view(before, high - low)[::size] == names[blocks - base, None])
        if not len(row):
            return []
        b = blocks[row]
        q = b - (left + row * size + column)
        order = np.lexsort((q, b))
        b, q = b[order], q[order]
        todo, found = b >= q, []

        def covered(start: int, end: int, period: int) -> None:
            i, j = np.searchsorted(b, start), np.searchsorted(b, end - size, "right")
            todo[i:j] &= (q[i:j] % period != 0) | (b[i:j] - q[i:j] < start)

        for p, s in self.open.items():
            covered(s - p, self.n, p)
        for x in self.spans:
            if x[1] > left and x[1] - x[0] >= low + size:
                covered(*x)
        at = 0
        while todo[at:].any():
            at += int(todo[at:].argmax())
            todo[at] = False
            span = self._verified(int(b[at]), int(q[at]), size)
            if span is not None:
                covered(*span)
                found.append(span)
        return found

    def _verified(self, block: int, q: int, size: int) -> tuple[int, int, int] | None:
        """The streak around a block that really equals the stretch ``q`` before it; kept as open if it reaches the last word."""
        w = self.words
        if not np.array_equal(w[block : block + size], w[block - q : block - q + size]):
            return None
        start, step = block, 64
        while start > q:
            a = max(q, start - step)
            differ = np.flatnonzero(w[a:start] != w[a - q : start - q])
            if len(differ):
                start = a + int(differ[-1]) + 1
                break
            start, step = a, 2 * step
        end = self._forward(q, block + size)
        if end == self.n:
            self.open[q] = start
        else:
            self._end(q, start, end)
        return start - q, end, q

    def _forward(self, q: int, end: int) -> int:
        """Where the streak of lag ``q`` that reaches ``end`` ends, among the words so far."""
        w, step = self.words, 64
        while end < self.n:
            b = min(self.n, end + step)
            differ = w[end:b] != w[end - q : b - q]
            k = int(differ.argmax())
            if differ[k]:
                return end + k
            end, step = b, 2 * step
        return end

    def _end(self, q: int, start: int, end: int) -> None:
        span = (start - q, end)
        self.spans.append((*span, q))
        if end - span[0] >= max(LEAST_WORDS, LEAST_PERIODS * q):
            self.runs[span] = min(q, self.runs.get(span, q))


def numbers(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers, others different ones."""
    known: defaultdict[bytes, int] = defaultdict(count().__next__)
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def runs_of(values: np.ndarray, batch: int = BATCH) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence."""
    catcher = SquareCatcher()
    for k in range(0, len(values), batch):
        catcher.append(values[k : k + batch])
    return catcher.finish()


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """False where a run holds the word after its first period."""
    keep = np.ones(n, bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return keep


def repeated_from(n: int, doc_id: int | None) -> np.ndarray | None:
    """Which word stands at each place of a text that is altered to test the operator; None where it isn't."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % p)


SCHEMA = "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", alter: bool = False) -> DataFrame:
    """(``id_col``, n_runs, the run of most periods, digests of all runs and of the text without repeats), a row for each row.

    Each text is one small job of a task, so nothing is shuffled. ``alter`` first repeats words of every tenth text.
    """

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, t in zip(batch["id"].astype("Int64"), batch["text"]):
                words = (t or "").encode().split()  # bytes split at exactly \x20 and \x09-\x0D
                at = repeated_from(len(words), None if i is pd.NA else int(i)) if alter else None
                if at is not None:
                    words = [words[k] for k in at]
                runs = runs_of(numbers(words)) if len(words) >= LEAST_WORDS else []
                best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else None
                kept = compress(words, kept_words(len(words), runs).tolist()) if runs else words
                listed = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
                out.append((i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()))
            made = pd.DataFrame(out, columns=["id", *(c.split()[0] for c in SCHEMA.split(", "))])
            yield made.astype({"id": "Int64", "start": "Int64", "length": "Int64", "period": "Int64", "exponent_milli": "Int64"})

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text"))
    return rows.mapInPandas(found, f"id bigint, {SCHEMA}").withColumnRenamed("id", id_col)


def op12_runs(spark, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), alter=True)
