"""Lempel-Ziv phrase fingerprints.

A text is parsed from left to right into dictionary phrases: each is the shortest string that is no phrase yet, so
a phrase extends an earlier one by a character. The set of phrases says what a compressor would learn from the
text. Phrases are hashed and the ``SKETCH`` smallest hashes are the signature; the likeness of two texts is the
estimated Jaccard similarity of their phrase sets, from the smallest hashes of the union of both signatures
(exact where the union has no more phrases than that).

Defined results: null is the empty text, whose fingerprint is empty; two empty texts have likeness 1, an empty and
another one 0; equal texts have equal fingerprints; very long texts are parsed in full; an empty table gives an
empty table. Other columns of the input take no part.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import shuffle_partitions, table

SKETCH = 128
HEX = 8
#: Sort before all ids, and behind all hashes of texts.
NULL, MOST = -(1 << 70), 1 << 63


def parse(text: str, phrases: set[str] | None = None) -> tuple[set[str], str]:
    """The phrases of ``text`` after those already found, and the unfinished phrase at its end."""
    phrases = set() if phrases is None else phrases
    add, phrase = phrases.add, ""
    for c in text:
        phrase += c
        if phrase not in phrases:
            add(phrase)
            phrase = ""
    return phrases, phrase


def signature(phrases: set[str], rest: str = "") -> str:
    """The smallest hashes of the phrases (and the unfinished one, if it is not among them) in hexadecimal, ascending."""
    digest = xxhash.xxh32_intdigest
    h = np.fromiter(map(digest, phrases), np.uint32, len(phrases))
    if rest and rest not in phrases:
        h = np.append(h, np.uint32(digest(rest)))
    if len(h) > 8 * SKETCH:
        h = np.partition(h, 2 * SKETCH)[: 2 * SKETCH]
    return np.unique(h)[:SKETCH].astype(">u4").tobytes().hex()


def fingerprint(text: str | None) -> str:
    return signature(*parse(text or ""))


def likeness(a: str, b: str) -> float:
    """Estimated Jaccard similarity of the phrase sets behind two signatures."""
    x, y = ({s[k : k + HEX] for k in range(0, len(s), HEX)} for s in (a, b))
    if not x or not y:
        return float(x == y)
    both = x & y
    union = sorted(x | y)[:SKETCH]
    return sum(h in both for h in union) / len(union)


def fingerprints(text: str | Column) -> Column:
    """Column of fingerprints."""

    @F.pandas_udf("string")
    def lz(batch: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t) for t in batch], dtype=object)

    return lz(F.col(text) if isinstance(text, str) else text)


def likeness_of(a: str, b: str) -> Column:
    """Column of likenesses of two fingerprint columns."""

    @F.pandas_udf("double")
    def like(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([likeness(p, q) for p, q in zip(x, y)], dtype=float)

    return like(F.col(a), F.col(b))


def spliced_with_next(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text and of the next text, and their likenesses.

    The edited text replaces the last third (floor) of the characters by the first as many of the next document's,
    in descending order of id (equal ids: descending hash of the whole text; null ids last; after the last comes the
    first). One shuffle of the texts: rows are dealt into ranges of about equal count, and the first row of a range also
    goes, as a donor only, to the range before it. Ids with more rows than a range has are cut by the hashes of their
    texts, so that only rows that are equal in both stay together.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    n = 6 * shuffle_partitions(spark)
    ids, total = rows.select("id"), rows.count()
    edges = [(int(e), MOST) for e in ids.where("id is not null").approxQuantile("id", [k / n for k in range(1, n)], 1 / (4 * n))] if n > 1 else []
    # Fewer than n ids can have over an nth of all rows; together they are cut n times at most, at even steps of the hash.
    hot = ids.groupBy("id").count().where(F.col("count") > max(2, total // n)).collect()
    for r in hot:
        parts = -(-n * r["count"] // max(1, total))
        edges += [(NULL if r["id"] is None else r["id"], -(1 << 63) + (k << 64) // parts) for k in range(1, parts)]
    bounds = sorted({*edges, (NULL, MOST)})

    def place(i: object, hash_: int) -> int:
        """Ranges in descending order; null ids are last of all."""
        return len(bounds) - bisect_left(bounds, (NULL if pd.isna(i) else int(i), int(hash_)))

    @F.pandas_udf("bigint")
    def range_of(id_: pd.Series, hash_: pd.Series) -> pd.Series:
        return pd.Series([place(i, h) for i, h in zip(id_.astype("Int64"), hash_)], dtype="int64")

    first = F.max(F.struct(F.col("id").isNotNull(), "id", "hash")).alias("x")
    firsts = rows.select("id", "hash").withColumn("range", range_of("id", "hash")).groupBy("range").agg(first).select("range", "x.id", "x.hash").orderBy("range").collect()
    lends: dict[tuple, int] = {}
    for k, r in enumerate(firsts):
        lends[r["id"], r["hash"]] = firsts[k - 1]["range"]  # the first row of a range goes to the range before it

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = batch["id"].astype("Int64")
            names = [(None if i is pd.NA else int(i), int(h)) for i, h in zip(own, batch["hash"])]
            yield pd.DataFrame({"bucket": [place(i, h) for i, h in zip(own, batch["hash"])], "donor": False, "id": own, "hash": batch["hash"], "text": batch["text"]})
            donor = np.array([x in lends for x in names], bool)
            if donor.any():
                yield pd.DataFrame({"bucket": [lends[x] for x in names if x in lends], "donor": True, "id": own[donor], "hash": batch["hash"][donor], "text": batch["text"][donor]})

    def edited(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: list[tuple] = []
        held: tuple | None = None

        def close(b: tuple, nxt: str, nxt_print: str) -> None:
            _, i, t, own, head, rest = b
            lent = nxt[: len(t) // 3]
            kept = t[: len(t) - len(t) // 3]
            edit = signature(*parse(rest + lent, head))
            now.append((i, len(t), hashlib.sha256((kept + lent).encode()).hexdigest(), own, edit, likeness(own, edit), likeness(own, nxt_print)))

        for batch in batches:
            for b, donor, i, t in zip(batch["bucket"], batch["donor"], batch["id"].astype("Int64"), batch["text"]):
                if donor and (held is None or held[0] != b):
                    continue  # A donor's copy.
                head, rest = parse(t[: len(t) - len(t) // 3])
                whole, end = parse(rest + t[len(t) - len(t) // 3 :], set(head))
                own = signature(whole, end)
                if held is not None and held[0] == b:
                    close(held, t, own)
                held = None if donor else (b, i, t, own, head, rest)
            if now:
                yield pd.DataFrame(now, columns=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]).astype({"id": "Int64"})
            now.clear()

    schema = "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    ranged = rows.mapInPandas(dealt, "bucket bigint, donor boolean, id bigint, hash bigint, text string")
    ranged = ranged.repartition(shuffle_partitions(spark), "bucket").sortWithinPartitions("bucket", "donor", F.desc_nulls_last("id"), F.desc("hash"))
    return ranged.mapInPandas(edited, schema).withColumnRenamed("id", id_col)


def op1_lz(spark, sf_dir: str) -> DataFrame:
    return spliced_with_next(table(spark, sf_dir, "documents"))
