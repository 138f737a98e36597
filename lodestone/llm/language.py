"""Language identification by hyperdimensional profiles.

Every letter owns a fixed random vector of +1 and -1. A letter n-gram is bound by multiplying its letters'
vectors, each rolled by its distance from the end, and a text is the sum (bundle) of its n-gram vectors. The sum of
a language's training texts is its prototype; a text gets the language whose prototype has the largest cosine.
Prototypes are centred: the mean of all prototypes, which carries what the languages share, is taken out.

Only text is an input of a prediction. Fitting reads a bounded sample of labelled rows: about ``max_docs`` texts
of a language (ids are hashed to a share of all) and at most ``max_chars`` characters of it, texts over a twentieth of
that last (one text at least). Every language with a learnable text can be predicted; the model holds a vector for each.

Defined results: a null text or a text without a letter is ``und`` with score 0; a text shorter than an n-gram is
padded with spaces, so every text with a letter gets a language; ties go to the language first in alphabetical
order; with nothing to learn from every text is ``und``; an empty table gives an empty table. The output columns
replace those of their names; other columns of the input pass through unchanged.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.shared import hash_order, hash_share, id_fold, shuffle_partitions, table, unused_name

DIM = 1024
N = 3
SEED = 20_240_617
UNKNOWN = "und"
#: Texts that are bundled together, and n-grams of them at a time.
TOGETHER, BLOCK = 128, 2_048
#: Vectors of n-grams that a worker keeps, of ``DIM`` bytes each.
KEPT_VECTORS = 48_000
#: Memory for the inner products that a worker keeps.
KEPT_BYTES = 64_000_000
_BETWEEN = re.compile(r"[\W\d_]+")


def letter_vector(code: int) -> np.ndarray:
    """The +1/-1 vector of a code point, the same on every machine."""
    return np.random.Generator(np.random.PCG64([SEED, code])).integers(0, 2, DIM, dtype=np.int8) * np.int8(2) - np.int8(1)


def normalised(text: str | None) -> str:
    """Lower-case words, one space around each, without digits and signs; empty if there is no letter."""
    words = _BETWEEN.sub(" ", (text or "").lower()).strip()
    return f" {words} " if any(map(str.isalpha, words)) else ""


def grams_of(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """The distinct letter n-grams of a text, packed into 64 bits, and their counts; None without a letter."""
    words = normalised(text)
    if not words:
        return None
    c = np.frombuffer(words.encode("utf-32-le"), "<u4").astype(np.uint64)
    g = c[: len(c) - N + 1].copy()
    for k in range(1, N):
        g = (g << np.uint64(21)) | c[k : len(c) - N + 1 + k]
    return np.unique(g, return_counts=True)


class Binder:
    """Binds packed n-grams into their vectors and bundles these; keeps the letters' vectors, each rolled by its
    distance from the end, and the n-grams' vectors."""

    def __init__(self) -> None:
        self.letters: dict[int, np.ndarray] = {}
        self.codes, self.kept = np.zeros(0, np.uint64), np.zeros((0, DIM), np.int8)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) > 5_000:
                self.letters.clear()
            self.letters[code] = np.stack([np.roll(letter_vector(code), k) for k in range(N)])
        return self.letters[code]

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        v = np.ones((len(grams), DIM), np.int8)
        for k in range(N):
            codes, at = np.unique((grams >> np.uint64(21 * k)) & np.uint64(0x1FFFFF), return_inverse=True)
            v *= np.stack([self.letter(c)[k] for c in codes.tolist()])[at]
        return v

    def bundles(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """A bundle for each text's sorted distinct n-grams and counts: block by block, counts times vectors."""
        total = np.zeros((len(texts), DIM))
        grams = np.unique(np.concatenate([g for g, _ in texts])) if texts else np.zeros(0, np.uint64)
        for s in range(0, len(grams), BLOCK):
            part = grams[s : s + BLOCK]
            counts = np.zeros((len(texts), len(part)), np.float32)
            for k, (g, c) in enumerate(texts):
                a, b = np.searchsorted(g, part[[0, -1]], side="left")
                b += b < len(g) and g[b] == part[-1]
                counts[k, np.searchsorted(part, g[a:b])] = c[a:b]
            total += counts @ self.known(part).astype(np.float32)
        return total

    def known(self, grams: np.ndarray) -> np.ndarray:
        """``vectors``, looked up among those kept."""
        at = np.searchsorted(self.codes, grams)
        have = self.codes[np.minimum(at, len(self.codes) - 1)] == grams if len(self.codes) else np.zeros(len(grams), bool)
        if not have.all():
            if len(self.codes) + len(grams) > KEPT_VECTORS:
                self.codes, self.kept, have = self.codes[:0], self.kept[:0], np.zeros(len(grams), bool)
            new = grams[~have]
            codes, kept = np.r_[self.codes, new], np.concatenate([self.kept, self.vectors(new)])
            order = np.argsort(codes, kind="stable")
            self.codes, self.kept = codes[order], kept[order]
            at = np.searchsorted(self.codes, grams)
        return self.kept[at]

    def bundle(self, grams: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Weighted sum of the n-grams' vectors."""
        total = np.zeros(DIM)
        for s in range(0, len(grams), 2048):
            total += weights[s : s + 2048] @ self.vectors(grams[s : s + 2048]).astype(np.float32)
        return total


class Products:
    """Inner products of n-gram vectors with fixed vectors, kept for the n-grams met, so that a bundle's product is a weighted sum of them."""

    def __init__(self, fixed: np.ndarray) -> None:
        self.binder, self.fixed, self.most = Binder(), fixed.T.astype(np.float32), max(4_096, KEPT_BYTES // (4 * (len(fixed) + 4)))
        self.clear()

    def clear(self) -> None:
        self.codes, self.values = np.zeros(0, np.uint64), np.zeros((0, self.fixed.shape[1]), np.float32)

    def of(self, grams: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Products of the bundle of sorted distinct n-grams with each fixed vector."""
        total = np.zeros(self.fixed.shape[1])
        for s in range(0, len(grams), 2048):
            part = grams[s : s + 2048]
            k = np.searchsorted(self.codes, part)
            known = np.zeros(len(part), bool) if not len(self.codes) else self.codes[np.minimum(k, len(self.codes) - 1)] == part
            if not known.all():
                if len(self.codes) + len(part) > self.most:
                    self.clear()
                    known[:] = False
                new = part[~known]
                codes, values = np.r_[self.codes, new], np.r_[self.values, self.binder.vectors(new).astype(np.float32) @ self.fixed]
                order = np.argsort(codes, kind="stable")
                self.codes, self.values = codes[order], values[order]
                k = np.searchsorted(self.codes, part)
            total += count[s : s + 2048] @ self.values[k]
        return total


@dataclass(frozen=True)
class LanguageModel:
    """Languages and their unit prototypes (a row of ``DIM`` floats each)."""

    langs: tuple[str, ...]
    prototypes: np.ndarray
    shared: np.ndarray

    def nearest(self, texts: list[str | None], binder: Binder) -> tuple[list[str], list[float]]:
        """The nearest prototype by cosine of each text's bundle, centred as the prototypes are."""
        found, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        own = [(k, g) for k, t in enumerate(texts) if self.langs and (g := grams_of(t)) is not None]
        for s in range(0, len(own), TOGETHER):
            part = own[s : s + TOGETHER]
            bundles = binder.bundles([g for _, g in part])
            bundles -= (bundles @ self.shared)[:, None] * self.shared
            cosines = bundles @ self.prototypes.T / np.maximum(np.linalg.norm(bundles, axis=1, keepdims=True), 1e-12)
            for (k, _), best, row in zip(part, cosines.argmax(axis=1).tolist(), cosines):
                found[k], score[k] = self.langs[best], (1 + float(np.clip(row[best], -1, 1))) / 2
        return found, score

    def predict_texts(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        return self.nearest(texts, Binder())

    def predict(self, df: DataFrame, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
        """``df`` with the language and its score, half of 1 + cosine."""
        model = self

        @F.pandas_udf("lang string, score double")
        def languages(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            binder = Binder()
            for batch in batches:
                found, score_ = model.nearest(list(batch), binder)
                yield pd.DataFrame({"lang": pd.Series(found, dtype=object), "score": pd.Series(score_, dtype=float)})

        both = unused_name(df, "language_of_text")
        return df.withColumn(both, languages(F.col(text))).withColumns({lang: F.col(f"{both}.lang"), score: F.col(f"{both}.score")}).drop(both)


def fit_sums(langs: list[str], sums: np.ndarray) -> LanguageModel:
    """Prototypes from the sums of each language's bundles."""
    if not langs:
        return LanguageModel((), np.zeros((0, DIM)), np.zeros(DIM))
    unit = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    shared = unit.mean(axis=0) if len(langs) > 1 else np.zeros(DIM)
    shared = shared / max(np.linalg.norm(shared), 1e-12)
    centred = unit - (unit @ shared)[:, None] * shared
    return LanguageModel(tuple(langs), centred / np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-12), shared)


def bundled(pairs: Iterator[tuple[str, str]]) -> dict[str, np.ndarray]:
    """Sum of the unit bundles of each language's texts."""
    weights: dict[str, dict[int, float]] = {}
    for lang, text in pairs:
        if (own := grams_of(text)) is not None:
            grams, count = own
            into, unit = weights.setdefault(lang, {}), 1 / np.sqrt(float((count.astype(float) ** 2).sum()))
            for g, w in zip(grams.tolist(), (count * unit).tolist()):
                into[g] = into.get(g, 0.0) + w
    binder = Binder()
    return {lang: binder.bundle(np.fromiter(w, np.uint64, len(w)), np.fromiter(w.values(), np.float32, len(w))) for lang, w in weights.items()}


def fit_texts(pairs: list[tuple[str, str]]) -> LanguageModel:
    sums = bundled(pairs)
    langs = sorted(sums)
    return fit_sums(langs, np.stack([sums[k] for k in langs]) if langs else np.zeros((0, DIM)))


def learnt(docs: DataFrame, max_docs: int = 1_500, max_chars: int = 8_000_000, fold: tuple[int, int] | None = (4, 2)) -> DataFrame:
    """(lang, text): the bounded sample to learn from, of rows outside the held-out fold (crc32 of the id modulo ``fold[0]`` is ``fold[1]``)."""
    known = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    if fold:
        known = known.where(F.coalesce(id_fold("doc_id", fold[0]) != fold[1], F.lit(False)))
    share = known.groupBy("lang").count().select("lang", (F.lit(float(max_docs)) / F.col("count")).alias("share"))
    rows = known.join(F.broadcast(share), "lang").where(hash_share("doc_id") < F.col("share")).select("lang", "text", hash_order("doc_id").alias("k"))
    n, order = F.length("text"), W.partitionBy("lang").orderBy(F.length("text") > max_chars // 20, "k", "text")
    return rows.withColumn("upto", F.sum(n).over(order)).where((F.col("upto") <= max_chars) | (F.col("upto") == n)).select("lang", "text")


def language_sums(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and the sums of their bundles. Workers bundle the sample and add up; one vector for each language comes to the driver."""

    def sums_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = bundled(pair for batch in batches for pair in zip(batch["lang"], batch["text"]))
        yield pd.DataFrame({"lang": pd.Series(list(sums), dtype=object), "bundle": pd.Series([v.tobytes() for v in sums.values()], dtype=object)})

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, v in zip(batch["lang"], batch["bundle"]):
                total[lang] = total.get(lang, 0) + np.frombuffer(v)
        yield pd.DataFrame({"lang": pd.Series(list(total), dtype=object), "bundle": pd.Series([v.tobytes() for v in total.values()], dtype=object)})

    schema = "lang string, bundle binary"
    each = rows.mapInPandas(sums_of, schema).repartition(shuffle_partitions(rows.sparkSession), "lang").sortWithinPartitions("lang", "bundle")
    found = sorted(((r["lang"], np.frombuffer(r["bundle"])) for r in each.mapInPandas(added, schema).collect()), key=lambda x: x[0])
    return [k for k, _ in found], np.stack([v for _, v in found]) if found else np.zeros((0, DIM))


def fit_languages(docs: DataFrame, max_docs: int = 1_500, max_chars: int = 8_000_000, fold: tuple[int, int] | None = (4, 2)) -> LanguageModel:
    """Learns from text and non-null lang of rows of the sample ``learnt``."""
    return fit_sums(*language_sums(learnt(docs, max_docs, max_chars, fold)))


# -- texts unlike every language ------------------------------------------------------------------------------------
#: Numbers of n-grams from which a bar of its own holds; shorter texts than the first can't be told from a language's.
SIZES = (16, 64, 256, 1024)
#: A bar is this quantile of the learnt texts' likeness, times the slack.
LOW, SLACK = 0.01, 0.75
#: Fewer learnt texts than this set no bar.
MIN_TEXTS = 30


def likeness(product: np.ndarray, n: float) -> np.ndarray:
    """Mean cosine of a text's n-grams with fixed unit vectors; unlike a bundle's cosine it doesn't grow with the text."""
    return product / (n * np.sqrt(DIM))


def calibration(texts: Iterator[tuple[str, str]], langs: list[str], sums: np.ndarray) -> Iterator[tuple[str, int, float]]:
    """(language, place in ``SIZES``, likeness) of learnt texts and excerpts of them, to their language without the text itself."""
    norms = np.linalg.norm(sums, axis=1)
    products, at = Products(sums / np.maximum(norms[:, None], 1e-12)), {k: i for i, k in enumerate(langs)}
    for lang, text in texts:
        if lang not in at or (own := grams_of(text)) is None:
            continue
        i, (grams, count) = at[lang], own
        length, size = np.sqrt(float((count.astype(float) ** 2).sum())), norms[at[lang]]
        rest = size**2 - 2 * size * products.of(grams, count.astype(np.float32))[i] / length + DIM
        if rest < DIM / 2:
            continue  # The only text of its language.
        words = normalised(text)
        for k, n in enumerate(SIZES):
            if len(words) - N + 1 < n:
                break
            upto = len(words) if k + 1 == len(SIZES) or len(words) - N + 1 < SIZES[k + 1] else n + N - 1
            start = zlib.crc32(words[:64].encode()) % (len(words) - upto + 1)
            if (part := grams_of(words[start : start + upto])) is None:
                continue
            g, c = part
            shared = np.searchsorted(grams, g)
            known = grams[np.minimum(shared, len(grams) - 1)] == g
            itself = DIM * float((c[known] * count[shared[known]]).sum()) / length
            product = (size * products.of(g, c.astype(np.float32))[i] - itself) / np.sqrt(rest)
            yield lang, k, float(likeness(product, float(c.sum())))


@dataclass(frozen=True)
class Likeness:
    """Languages' unit prototypes, not centred, and for each the least likeness of a text of each size that is still its own."""

    langs: tuple[str, ...]
    prototypes: np.ndarray
    bars: np.ndarray

    def unlike_texts(self, texts: Iterator[str | None], products: Products | None = None) -> list[bool]:
        """Whether a text has no letter or is below every language's bar. Texts too short to tell aren't."""
        products, out = products or Products(self.prototypes), []
        for text in texts:
            own = grams_of(text)
            if own is None or not self.langs:
                out.append(True)
                continue
            grams, count = own
            n = int(count.sum())
            k = int(np.searchsorted(SIZES, n, side="right")) - 1
            out.append(k >= 0 and bool((likeness(products.of(grams, count.astype(np.float32)), n) < self.bars[:, k]).all()))
        return out

    def unlike(self, text: str = "text") -> Column:
        model = self

        @F.pandas_udf("boolean")
        def foreign(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            products = Products(model.prototypes)
            for batch in batches:
                yield pd.Series(model.unlike_texts(batch, products), dtype=bool)

        return foreign(F.col(text))


def bars_of(langs: list[str], quantiles: dict[tuple[str, int], tuple[float, int]]) -> np.ndarray:
    """Bars from (quantile, texts) by language and size; a language with few texts takes the least of the others'."""
    bars = np.full((len(langs), len(SIZES)), np.nan)
    for i, lang in enumerate(langs):
        for k in range(len(SIZES)):
            low, n = quantiles.get((lang, k), (0.0, 0))
            if n >= MIN_TEXTS:
                bars[i, k] = SLACK * low
    for k in range(len(SIZES)):
        known = bars[~np.isnan(bars[:, k]), k]
        bars[np.isnan(bars[:, k]), k] = known.min() if len(known) else -np.inf
    return bars


def fit_likeness(docs: DataFrame, max_docs: int = 1_500, max_chars: int = 8_000_000, fold: tuple[int, int] | None = None) -> Likeness:
    """Learns the languages of ``docs`` and, from the same sample, how unlike its language a text may be.

    Nothing of a text is collected: workers send sums, and a quantile for each language and size.
    """
    rows = learnt(docs, max_docs, max_chars, fold)
    langs, sums = language_sums(rows)

    def likenesses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = list(calibration((pair for batch in batches for pair in zip(batch["lang"], batch["text"])), langs, sums))
        yield pd.DataFrame({"lang": pd.Series([x[0] for x in found], dtype=object), "k": pd.Series([x[1] for x in found], dtype="int32"), "x": pd.Series([x[2] for x in found], dtype=float)})

    each = rows.mapInPandas(likenesses, "lang string, k int, x double").groupBy("lang", "k").agg(F.percentile_approx("x", LOW, 10_000).alias("low"), F.count("*").alias("n"))
    bars = bars_of(langs, {(r["lang"], r["k"]): (r["low"], r["n"]) for r in each.collect()} if langs else {})
    return Likeness(tuple(langs), sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12), bars)


def op10_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = fit_languages(docs).predict(docs.select("doc_id", "text"))
    return found.select("doc_id", (id_fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
