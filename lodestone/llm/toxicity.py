"""Toxicity by compression distance.

Two zstandard dictionaries are trained by zstandard itself: one on windows of ordinary texts, and one on passages of
toxic texts, those around byte n-grams that are commoner among toxic than among ordinary texts. The toxic one stands
behind a copy of the ordinary one, at the same offsets from a window, so common text compresses alike with both
and a window's two lengths differ by what the toxic passages add. Every window of a text is compressed with
both; how much shorter the toxic dictionary makes the windows (largest gain, gains over a margin, share of
gaining windows) is turned into a probability by a logistic calibration fitted on labelled texts that the
dictionaries have not seen.

Only text is an input of a score. Fitting reads a bounded sample of labelled rows: about ``max_docs`` texts of
each label (ids are hashed to a share of all) and at most ``max_chars`` characters of a label, texts over a
twentieth of that last (one text at least). Ids with both labels aren't learnt from. Scoring reads whole texts.

Defined results: a null or empty text has no windows and scores the calibrated value of "no gain"; very long
texts are scored in full, window by window; equal texts score equally; an empty table gives an empty table. The
output column replaces one of its name; other columns of the input pass through unchanged.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.shared import hash_order, hash_share, id_fold, table

WINDOW_BYTES = 64
STRIDE_BYTES = 48
GRAMS = (5, 7)
#: Sizes of the two trained dictionaries, and the most windows or passages to train one on.
ORDINARY_BYTES, TOXIC_BYTES = 16_000, 1_536
MAX_SAMPLES = 20_000
#: An n-gram marks a class if this many times commoner there ...
MARKING = 4
#: ... and this sure of it, in standard errors.
SURE = 3.5
#: A passage: a run of marking n-grams, cut at so many bytes, and so many bytes on either side.
RUN_BYTES, AROUND = 24, 2
LEVEL = 6
MIN_MATCH = 3
FEATURES = 12


def windows(data: bytes) -> list[bytes]:
    """Overlapping windows that together cover ``data``; a word is whole in at least one unless it is long."""
    return [data[i : i + WINDOW_BYTES] for i in range(0, max(1, len(data) - (WINDOW_BYTES - STRIDE_BYTES)), STRIDE_BYTES)] if data else []


def _bytes(text: str | None) -> bytes:
    return (text or "").lower().encode()


def _gram_hashes(data: bytes, n: int) -> np.ndarray:
    a = np.frombuffer(b" " + data + b" ", np.uint8).astype(np.uint64)
    if len(a) < n:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(a) - n + 1, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x100000001B3) + a[k : len(a) - n + 1 + k]
    return h


def without_copies(docs: list[bytes]) -> list[bytes]:
    """The texts that share at most one of four minimum hashes of 24-byte grams with earlier ones: a copied text counts once."""
    seen: set[tuple[int, int]] = set()
    kept = []
    for b in docs:
        h = _gram_hashes(b, 24)
        own = {(k, int((h * np.uint64(odd)).min())) for k, odd in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))} if len(h) else {(-1, hash(b))}
        if len(own & seen) < min(2, len(own)):
            kept.append(b)
        seen |= own
    return kept


def _doc_counts(docs: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    each = [np.unique(_gram_hashes(b, n)) for b in docs]
    return np.unique(np.concatenate(each), return_counts=True) if each else (np.zeros(0, np.uint64), np.zeros(0, int))


def _log_odds(c: np.ndarray, n: int, o: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """How much commoner among n own texts than among m others, and the root of the likelihood ratio against equal rates."""
    lo = np.log((c + 0.5) / (n + 1)) - np.log((o + 0.5) / (m + 1))
    own, other = (c + o) * n / max(1, n + m), (c + o) * m / max(1, n + m)
    ratio = c * np.log(np.maximum(c, 1e-9) / np.maximum(own, 1e-9)) + o * np.log(np.maximum(o, 1e-9) / np.maximum(other, 1e-9))
    return lo, np.sqrt(np.maximum(2 * ratio, 0))


def marking_passages(own: list[bytes], other: list[bytes]) -> list[bytes]:
    """The passages of ``own`` texts around runs of n-grams with high log-odds against ``other`` texts, in a fixed order."""
    found: list[bytes] = []
    for n in GRAMS:
        u, c = _doc_counts(own, n)
        v, e = _doc_counts(other, n)
        if not len(u):
            continue
        k = np.minimum(np.searchsorted(v, u), max(0, len(v) - 1))
        o = np.where(v[k] == u, e[k], 0) if len(v) else np.zeros(len(u))
        lo, z = _log_odds(c, len(own), o, len(other))
        grams = u[(z > SURE) & (lo > np.log(MARKING))]
        if not len(grams):
            continue
        for b in own:
            h = _gram_hashes(b, n)
            k = np.minimum(np.searchsorted(grams, h), len(grams) - 1)
            edge = np.flatnonzero(np.diff(np.r_[0, (grams[k] == h).astype(np.int8), 0]))
            padded = b" " + b + b" "
            found += [padded[max(0, s - AROUND) : min(e_ + n - 1, s + RUN_BYTES) + AROUND] for s, e_ in zip(edge[::2].tolist(), edge[1::2].tolist())]
    return _some(found)


def _some(samples: list[bytes]) -> list[bytes]:
    """The samples in an order of their hashes, ``MAX_SAMPLES`` at most."""
    return sorted(samples, key=lambda x: (zlib.crc32(x), x))[:MAX_SAMPLES]


def trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary that zstandard trains on the samples; of too few to train on, the samples themselves."""
    if len(samples) >= 8 and sum(map(len, samples)) > 2 * size:
        try:
            return zstandard.train_dictionary(size, samples, k=32, d=6, dict_id=1, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            pass  # All too much alike to train on.
    return b"".join(dict.fromkeys(samples))[:size]


def _compressor(dictionary: bytes):
    params = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=MIN_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False)
    data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=params).compress


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps of a ridge logistic regression; a last column of ones is the intercept."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass(frozen=True)
class ToxicityModel:
    """Two dictionaries of a few kB, the calibration's weights and the scaling of its features."""

    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]

    def gains(self) -> callable:
        """Function from text to the bytes that each window saves with the toxic dictionary."""
        short, long_ = _compressor(self.toxic), _compressor(self.ordinary)
        return lambda data: np.array([len(long_(w)) - len(short(w)) for w in windows(data)], float)

    def score_texts(self, texts: list[str | None]) -> np.ndarray:
        gains = self.gains()
        x = np.stack([features(gains(_bytes(t))) for t in texts]) if len(texts) else np.zeros((0, len(self.weights)))
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.weights), -30, 30)))

    def score(self, df: DataFrame, text: str = "text", out: str = "score") -> DataFrame:
        """``df`` with a column ``out``: the probability of label 1."""
        spark_model = self

        @F.pandas_udf("double")
        def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            gains, weights = spark_model.gains(), np.array(spark_model.weights)
            for batch in batches:
                x = np.array([features(gains(_bytes(t))) for t in batch]).reshape(len(batch), len(weights))
                yield pd.Series(1 / (1 + np.exp(-np.clip(x @ weights, -30, 30))))

        return df.withColumn(out, toxic(F.col(text)))


def features(gain: np.ndarray) -> np.ndarray:
    """Of a text's window gains: the largest, the third, what is over margins for its length, the length; and 1."""
    n = len(gain)
    if not n:
        return np.array([0.0] * (FEATURES - 1) + [1])
    top, root = np.sort(gain)[::-1], np.sqrt(n)
    return np.array([min(top[0], 12), min(top[min(1, n - 1)], 12), min(top[min(3, n - 1)], 12), np.maximum(gain - 2, 0).sum() / root, np.maximum(gain - 4, 0).sum() / root, (gain >= 4).mean() * 10, *(np.log1p((gain >= k).sum()) for k in (5, 6, 7)), (gain >= 6).mean() * 10, np.log(n), 1])


def fit_texts(toxic: list[str], ordinary: list[str], odds: float = 1.0) -> ToxicityModel:
    """Dictionaries from every second text of each list, calibration from the others.

    ``odds``: toxic to ordinary texts among all labelled ones, which the lists need not reflect.
    """
    t, o = without_copies([_bytes(x) for x in toxic]), without_copies([_bytes(x) for x in ordinary])
    t_fit, o_fit, t_cal, o_cal = t[::2], o[::2], t[1::2] or t, o[1::2] or o
    ordinary_dictionary = trained(_some([w for b in o_fit for w in windows(b)]), ORDINARY_BYTES)
    toxic_dictionary = trained(marking_passages(t_fit, o_fit), TOXIC_BYTES)
    model = ToxicityModel(ordinary_dictionary + toxic_dictionary, ordinary_dictionary + b"\0" * len(toxic_dictionary), ())
    gains = model.gains()
    x = np.stack([features(gains(b)) for b in (*t_cal, *o_cal)]) if t_cal or o_cal else np.zeros((1, FEATURES))
    y = np.r_[np.ones(len(t_cal)), np.zeros(len(o_cal))] if t_cal or o_cal else np.zeros(1)
    weights = _fit_logistic(x, y)
    weights[-1] += np.log(max(odds, 1e-6)) - np.log(max(1, len(t_cal)) / max(1, len(o_cal)))
    return ToxicityModel(model.toxic, model.ordinary, tuple(weights))


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_docs: int = 2_000, max_chars: int = 12_000_000, folds: int = 5) -> ToxicityModel:
    """Fits on labelled rows outside fold 0 of ``folds`` (crc32 of the id): about ``max_docs`` of each label, ``max_chars`` in all of a label.

    ``docs``: doc_id, text; ``labels``: doc_id, toxic. Rows with a null id, text or label are not learnt from. With
    ``folds`` = 0 every labelled row may be learnt from.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null").where(F.col("toxic").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other").drop("other")
    if folds:
        known = known.where(id_fold("doc_id", folds) != 0)
    count = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, max_docs / max(1, count.get(1, 0))).otherwise(max_docs / max(1, count.get(0, 0)))
    few = known.where(hash_share("doc_id") < share).select("doc_id", "toxic", hash_order("doc_id").alias("k"))
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(few), "doc_id")
    n, order = F.length("text"), W.partitionBy("toxic").orderBy(F.length("text") > max_chars // 20, "k", "text")
    rows = texts.withColumn("upto", F.sum(n).over(order)).where((F.col("upto") <= max_chars) | (F.col("upto") == n))
    found = sorted(rows.select("toxic", "k", "text").collect(), key=lambda r: (r["k"], r["text"]))
    return fit_texts([r["text"] for r in found if r["toxic"]], [r["text"] for r in found if not r["toxic"]], count.get(1, 0) / max(1, count.get(0, 0)))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = model.score(docs.select("doc_id", "text"))
    return scored.select("doc_id", (id_fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
