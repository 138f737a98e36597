"""BPE encoding of whole texts by tree concatenation, and decoding.

Short texts are encoded directly. A long text is cut into leaves that Spark encodes in parallel tasks; neighbours
are then joined pairwise up a tree. What the join of encoded halves L and R must be:

* The splitting pattern reads from left to right and never looks back, and looks ahead by two characters at most,
  so every piece of L but those at its end is a piece of the whole, and once a piece of the whole starts where a
  piece of R starts, all later ones agree. Only the pieces between are encoded again.
* If one unsplit piece runs across the join, its halves' tokens are kept and a window of tokens around the join is
  re-encoded, doubling until its first token is L's and its last is R's. BPE's result is the one sequence in which
  each two neighbours are what they would be alone, and every pair at the window's edges then is a pair of L, of R
  or of the window, so the joined sequence is exact. Long unsplit pieces within a leaf are halved the same way.

Defined results: null is the empty text, with no tokens; the vocabulary's added tokens in a text become their
ids, as the tokenizers library has it; repeated rows come back as often as they went in; null ids are kept; an
empty table gives an empty table. Other columns of the input take no part.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import shuffle_partitions, table
from lodestone.llm.vocabulary import BYTE_LEVEL_PATTERN, encoding, ranks

LEAF_CHARS = 32_768
#: Unsplit pieces over this many bytes are halved.
PIECE_BYTES = 512
#: A piece that starts this close to a text's end may be another one in a longer text ("'l" of "'ll").
AHEAD = 3
_UNSPLIT = re.compile(r"\S{256}|\s{256}")


class TreeBpe:
    """Encoder and decoder over one byte-level vocabulary file."""

    def __init__(self, path: str) -> None:
        self.ranks, self.added = ranks(path)
        self.core = encoding(path, BYTE_LEVEL_PATTERN)
        self.single = self.core._core_bpe.encode_single_piece
        self.bytes_of: list[bytes] = [b""] * (max([*self.ranks.values(), *self.added.values()]) + 1)
        for b, i in self.ranks.items():
            self.bytes_of[i] = b
        for s, i in self.added.items():
            self.bytes_of[i] = s.encode()
        self.split = regex.compile(BYTE_LEVEL_PATTERN)
        self.special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None

    # -- one unsplit piece ------------------------------------------------------------------------------------
    def piece(self, data: bytes) -> list[int]:
        """Tokens of bytes that the pattern doesn't split."""
        if len(data) <= PIECE_BYTES:
            return self.single(data)
        half = len(data) // 2
        return self.join_piece(self.piece(data[:half]), self.piece(data[half:]))

    def join_piece(self, left: list[int], right: list[int]) -> list[int]:
        """Tokens of one piece from the tokens of its two parts."""
        if not left or not right:
            return left + right
        k = 8
        while True:
            a, b = left[-k:], right[:k]
            data = b"".join(self.bytes_of[i] for i in a) + b"".join(self.bytes_of[i] for i in b)
            whole_left, whole_right = k >= len(left), k >= len(right)
            window = self.single(data) if len(data) <= 4 * PIECE_BYTES or (whole_left and whole_right) else None
            if window is None:
                window = self.join_piece(self.piece(data[: len(data) // 2]), self.piece(data[len(data) // 2 :]))
            if (whole_left or window[0] == a[0]) and (whole_right or window[-1] == b[-1]):
                return left[:-k] + window + right[k:]
            k *= 2

    # -- texts without added tokens ---------------------------------------------------------------------------
    def leaf(self, text: str) -> list[int]:
        if not _UNSPLIT.search(text):
            return self.core.encode_ordinary(text)
        out: list[int] = []
        for m in self.split.finditer(text):
            out += self.piece(m[0].encode())
        return out

    def open_start(self, text: str) -> int:
        """Where the first piece starts that a longer text may change."""
        for m in self.split.finditer(text):
            if m.end() == len(text) or m.start() + AHEAD > len(text):
                return m.start()
        return 0

    def join(self, left: tuple[str, list[int], int], right: tuple[str, list[int], int]) -> tuple[str, list[int], int]:
        """Of two encoded neighbours (text, tokens, start of the first open piece), the encoded whole."""
        (lt, li, s), (rt, ri, r_last) = left, right
        if not lt or not rt:
            return right if not lt else left
        text, n = lt + rt, len(lt)
        pieces, steps, i, j = [], 0, s, 0
        while i - n != j or not pieces:
            if i - n < j or not pieces:
                m = self.split.match(text, i)
                pieces.append((i, m.end()))
                i = m.end()
            else:
                j = self.split.match(rt, j).end()
                steps += 1
        tail, cut = len(lt[s:].encode()), len(li)
        while tail > 0:
            cut -= 1
            tail -= len(self.bytes_of[li[cut]])
        head, drop = len(rt[:j].encode()), 0
        while head > 0:
            head -= len(self.bytes_of[ri[drop]])
            drop += 1
        if len(pieces) == 1 and steps == 1 and self.split.match(lt, s).end() == n:
            middle = self.join_piece(li[cut:], ri[:drop])
        else:
            middle = [t for a, b in pieces for t in self.piece(text[a:b].encode())]
        last = next((a for a, b in pieces if b == len(text) or a + AHEAD > len(text)), n + max(j, r_last))
        return text, li[:cut] + middle + ri[drop:], last

    def tree(self, parts: list[tuple[str, list[int], int]]) -> list[int]:
        """Joins neighbours pairwise until one is left."""
        while len(parts) > 1:
            parts = [self.join(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0][1] if parts else []

    def ordinary(self, text: str, leaf_chars: int = LEAF_CHARS) -> list[int]:
        if len(text) <= leaf_chars:
            return self.leaf(text) if text else []
        cuts = [text[k : k + leaf_chars] for k in range(0, len(text), leaf_chars)]
        return self.tree([(c, self.leaf(c), self.open_start(c)) for c in cuts])

    # -- whole texts ------------------------------------------------------------------------------------------
    def segments(self, text: str) -> list[str]:
        """Text and added tokens in turn."""
        return self.special.split(text) if self.special and "<|" in text else [text]

    def encode(self, text: str | None, leaf_chars: int = LEAF_CHARS) -> list[int]:
        out: list[int] = []
        for k, s in enumerate(self.segments(text or "")):
            out += [self.added[s]] if k % 2 else self.ordinary(s, leaf_chars)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tree_bpe(path: str) -> TreeBpe:
    return TreeBpe(path)


def ids_bytes(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit ids."""
    return array("I", ids).tobytes() if array("I").itemsize == 4 and np.little_endian else np.array(ids, "<u4").tobytes()


def encode_texts(df: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """(``id_col``, text, ids): the whole text and its ids as little-endian unsigned 32-bit integers, a row for each input row."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    long_ = F.length("text") > leaf_chars

    @F.pandas_udf("binary")
    def direct(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = tree_bpe(path)
        for batch in batches:
            yield pd.Series([ids_bytes(bpe.encode(t)) for t in batch], dtype=object)

    def segment_leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = tree_bpe(path)
        for batch in batches:
            for i, t, copies in zip(batch["id"], batch["text"], batch["copies"]):
                key = hashlib.sha256(t.encode()).hexdigest()
                cuts = [(k, s[c : c + leaf_chars]) for k, s in enumerate(bpe.segments(t)) for c in range(0, max(1, len(s)), leaf_chars)]
                for s in range(0, len(cuts), 64):
                    part = cuts[s : s + 64]
                    yield pd.DataFrame({"id": pd.array([i] * len(part), "Int64"), "key": key, "copies": copies, "segment": [k for k, _ in part], "leaf": range(s, s + len(part)), "part": [p for _, p in part]})

    def encoded_leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = tree_bpe(path)
        for batch in batches:
            yield batch.assign(id=batch["id"].astype("Int64"), ids=[ids_bytes([bpe.added[p]] if k % 2 else bpe.leaf(p)) for k, p in zip(batch["segment"], batch["part"])])

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe, now, leaves = tree_bpe(path), None, []

        def whole() -> pd.DataFrame:
            ids: list[int] = []
            for k, own in groupby(leaves, key=lambda x: x[0]):
                part = [(p, np.frombuffer(b, "<u4").tolist()) for _, p, b in own]
                ids += part[0][1] if k % 2 else bpe.tree([(p, i, bpe.open_start(p)) for p, i in part])
            return pd.DataFrame({"id": pd.array([now[0]] * now[2], "Int64"), "text": "".join(x[1] for x in leaves), "ids": [ids_bytes(ids)] * now[2]})

        for batch in batches:
            for i, key, copies, segment, part, ids in zip(batch["id"].astype("Int64"), batch["key"], batch["copies"], batch["segment"], batch["part"], batch["ids"]):
                own = (None if i is pd.NA else int(i), key, int(copies))
                if own != now:
                    if now is not None:
                        yield whole()
                    now, leaves = own, []
                leaves.append((segment, part, ids))
        if now is not None:
            yield whole()

    n = shuffle_partitions(df.sparkSession)
    short = rows.where(~long_).withColumn("ids", direct("text"))
    once = rows.where(long_).groupBy("id", "text").agg(F.count("*").alias("copies"))
    columns = "id bigint, key string, copies bigint, segment int, leaf int, part string"
    leaves = once.mapInPandas(segment_leaves, columns).repartition(n).mapInPandas(encoded_leaves, f"{columns}, ids binary")
    longs = leaves.repartition(n, "id", "key").sortWithinPartitions("id", "key", "leaf").mapInPandas(joined, "id bigint, text string, ids binary")
    return short.unionByName(longs).withColumnRenamed("id", id_col)


def decoded(ids: str, path: str):
    """Column of decoded texts."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = tree_bpe(path)
        for batch in batches:
            yield pd.Series([bpe.decode(np.frombuffer(b, "<u4").tolist()) for b in batch], dtype=object)

    return decode(F.col(ids))


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    found = encode_texts(table(spark, sf_dir, "documents"), path).withColumn("decoded", decoded("ids", path))
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
