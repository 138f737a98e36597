"""Named slots for models, each wrapped once, with deterministic defaults that need no network.

A slot takes a Python callable over batches: ``encode`` (texts to vectors), ``generate`` (prompts to texts),
``judge`` (context, question, answer to JSON), ``stem`` (distinct words to stems). A batch that fails is tried again,
then gives nulls, so that callers can count and retry what failed. An encoder's batch is halved until only the bad
texts are left out.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources.segments import Segments
from lodestone.sources.store import settled

BATCH = 100
RETRIES = 3


@lru_cache(maxsize=50_000)  # some 20 MB of a worker
def _place(word: str, dim: int) -> tuple[int, int]:
    """A word's place in a vector and its sign, by two bytes of its md5."""
    d = hashlib.md5(word.encode()).digest()
    return d[0] % dim, 1 if d[1] < 128 else -1


def hashed_vectors(texts: list[str], dim: int = 64) -> list[list[float]]:
    """Vectors of signed word counts, hashed into ``dim`` places."""
    out = []
    for t in texts:
        v = [0.0] * dim
        for w in re.findall(r"\w+", t.lower()):
            at, sign = _place(w, dim)
            v[at] += sign
        out.append(v)
    return out


def encoded_each(texts: list[str], encode: Callable[[list[str]], list[list[float]]], retries: int = RETRIES) -> list[tuple[list[float] | None, str | None, int]]:
    """(vector, error, attempts) of each text. A batch that fails is halved until the bad text stands alone, and that is tried again."""
    if not texts:
        return []
    error = ""
    for attempt in range(1, (retries if len(texts) == 1 else 1) + 1):
        try:
            vectors = encode(texts)
            if len(vectors) != len(texts):
                raise ValueError(f"{len(vectors)} vectors of {len(texts)} texts")
            return [(v, None, attempt) for v in vectors]
        except Exception as e:  # noqa: BLE001 - a model may fail in any way; the row says how
            error = f"{type(e).__name__}: {e}"
    if len(texts) == 1:
        return [(None, error, retries)]
    half = len(texts) // 2
    return encoded_each(texts[:half], encode, retries) + encoded_each(texts[half:], encode, retries)


def embed_with_status(df: DataFrame, encode: Callable[[list[str]], list[list[float]]] = hashed_vectors, text: str = "text", out: str = "embedding", batch: int = BATCH) -> DataFrame:
    """``df`` with vectors, and a struct ``{out}_status`` of error and attempts; empty texts have neither vector nor error."""

    @F.pandas_udf("struct<vector: array<float>, error: string, attempts: int>")
    def encoded(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in series:
            result: list = [(None, None, 0)] * len(s)
            full = [i for i, t in enumerate(s) if isinstance(t, str) and t.strip()]
            for k in range(0, len(full), batch):
                part = full[k : k + batch]
                for i, done in zip(part, encoded_each([s.iloc[i] for i in part], encode)):
                    result[i] = done
            yield pd.DataFrame({"vector": pd.Series([r[0] for r in result], dtype=object), "error": pd.Series([r[1] for r in result], dtype=object), "attempts": pd.Series([r[2] for r in result], dtype="int32")})

    done = df.withColumn("__encoded", encoded(F.col(text)))
    status = F.struct(F.col("__encoded.error").alias("error"), F.col("__encoded.attempts").alias("attempts"))
    return done.withColumns({out: F.col("__encoded.vector"), f"{out}_status": status}).drop("__encoded")


def embed(df: DataFrame, encode: Callable[[list[str]], list[list[float]]] = hashed_vectors, text: str = "text", out: str = "embedding", batch: int = BATCH) -> DataFrame:
    """``df`` with vectors; empty texts and texts that the encoder can't take have null."""
    return embed_with_status(df, encode, text, out, batch).drop(f"{out}_status")


def to_retry(done: DataFrame, *keys: str, out: str = "embedding") -> DataFrame:
    """(keys, attempts, error) of the rows that failed: what a later run takes up again."""
    failed = F.col(f"{out}_status.error").isNotNull()
    return done.where(failed).select(*keys, F.col(f"{out}_status.attempts").alias("attempts"), F.col(f"{out}_status.error").alias("error"))


def query_key(text: Column) -> Column:
    return F.md5(F.lower(F.trim(text)))


def cached_vectors(queries: DataFrame, cache: Segments, bound: int = 500, encode: Callable[[list[str]], list[list[float]]] = hashed_vectors, text: str = "text", order: str = "query_id") -> DataFrame:
    """``queries`` with ``key``, ``embedding`` and ``hit``: whether the cache had the key's vector before.

    Keys ignore case and outer blanks. Each key that the cache doesn't have is encoded once and appended; beyond ``bound``
    keys, those that came first go. The cache is a log with key ``key``; its rows say in which batch and place they came.
    """
    spark = queries.sparkSession
    asked = queries.withColumn("key", query_key(F.col(text)))
    known, segment = cache.read(spark, "vectors"), cache.next(spark)
    new = asked.where(F.col("key").isNotNull()).groupBy("key").agg(F.min_by(text, order).alias("__text"), F.min(order).cast("bigint").alias("place"))
    new = new if known is None else new.join(known.select("key"), "key", "left_anti")
    new = settled(embed(new, encode, text="__text").select("key", "embedding", F.lit(segment).alias("arrived"), "place"))
    every = new if known is None else known.unionByName(new)
    out = asked.join(every.select("key", "embedding", (F.col("arrived") < segment).alias("hit")), "key", "left")
    out = settled(out.withColumn("hit", F.coalesce("hit", F.lit(False))))
    kept = settled(every.orderBy(F.desc("arrived"), F.desc("place"), "key").limit(bound).select("key"))
    gone = None if known is None else known.join(kept, "key", "left_anti")
    cache.upsert("vectors", new.join(kept, "key", "left_semi"), deleted=gone)
    return out


def generate(prompts: Column, model: Callable[[str], str] | None = None) -> Column:
    """Answers; the default repeats the first source of the context."""

    def echo(prompt: str) -> str:
        m = re.search(r"\[Source: ([^\]]*)\]\n([^\n]*)", prompt)
        return f"According to {m[1]}: {m[2]}" if m else "The context doesn't say."

    f = model or echo

    @F.pandas_udf("string")
    def answer(batch: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else f(p) for p in batch], dtype=object)

    return answer(prompts)


def rewritten(query: Column, history: Column, model: Callable[[str, str], str] | None = None) -> Column:
    """A stand-alone query from a follow-up; the query itself where the model fails or gives nothing."""
    if model is None:
        return query

    def tried(q: str | None, h: str | None) -> str | None:
        try:
            return model(q, h)
        except Exception:  # noqa: BLE001 - a model may fail in any way; the query then stands
            return None

    @F.pandas_udf("string")
    def rewrite(q: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([tried(a, b) for a, b in zip(q, h)], dtype=object)

    return F.coalesce(F.nullif(F.trim(rewrite(query, history)), F.lit("")), query)


def judged(context: Column, answer: Column, model: Callable[[str, str], str] | None = None) -> Column:
    """A judge's JSON; the default scores the share of the answer's words that the context has."""

    def overlap(c: str, a: str) -> str:
        own, words = set(re.findall(r"\w+", (c or "").lower())), re.findall(r"\w+", (a or "").lower())
        return json.dumps({"score": round(sum(w in own for w in words) / max(1, len(words)), 6), "reasoning": "share of words"})

    f = model or overlap

    @F.pandas_udf("string")
    def judge(c: pd.Series, a: pd.Series) -> pd.Series:
        return pd.Series([f(x, y) for x, y in zip(c, a)], dtype=object)

    return judge(context, answer)


def token_counts(text: Column, count: Callable[[list[str]], list[int]]) -> Column:
    """Exact token counts by a tokenizer, given as a callable over texts; null texts have none."""

    @F.pandas_udf("int")
    def counted(batch: pd.Series) -> pd.Series:
        return pd.Series(count(["" if t is None else t for t in batch]), dtype="int32")

    return F.when(text.isNotNull(), counted(text))


def bpe_counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts by a tokenizers file, opened once by each worker."""

    def count(texts: list[str]) -> list[int]:
        return [len(e.ids) for e in _tokenizer(path).encode_batch(texts, add_special_tokens=False)]

    return count


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


_STEPS = (("sses", "ss"), ("ies", "i"), ("ational", "ate"), ("ization", "ize"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("ing", ""), ("edly", ""), ("ed", ""), ("ly", ""))


def light_stem(word: str) -> str:
    """A short suffix stripper for the keyword index."""
    for end, new in _STEPS:
        if word.endswith(end) and len(word) - len(end) >= 3:
            return word[: -len(end)] + new
    return word[:-1] if word.endswith("s") and not word.endswith("ss") and len(word) > 3 else word


def stemmed(terms: DataFrame, stem: Callable[[str], str] = light_stem, term: str = "term") -> DataFrame:
    """``terms`` with ``stem``: the distinct vocabulary is stemmed once and joined back."""

    @F.pandas_udf("string")
    def stems(batch: pd.Series) -> pd.Series:
        return pd.Series([stem(w) for w in batch], dtype=object)

    return terms.join(terms.select(term).distinct().withColumn("stem", stems(F.col(term))), term)
