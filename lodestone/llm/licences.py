"""Licence scans by a trained paragraph classifier.

A text is cut into paragraphs at blank lines, and a paragraph, line ends counting as spaces, into the segments that
are classified: its sentences, up to three neighbouring ones together, its lines, and windows of ``WINDOWS`` words of
what is longer. A multinomial logistic regression over hashed word 1-, 2- and 3-grams gives each segment a
probability of every licence family, of ``unknown`` (the language of licences, but of none of the families) and of
``none``. It is trained on the fixed templates below, varied (cut, words dropped, set among ordinary words), on
licence sentences with invented names for unknown, and on ordinary paragraphs of the corpus. Examples that were not
trained on, the unknown ones with wordings and names of their own, set the temperature of the probabilities, the bar
from which a segment that no template confirms is an unknown licence, and the bar under which a family is too unsure.

A family stands only if one of its templates confirms it: the segment must share half of the template's word pairs (or
half of its own, with a long template), and pairs that only this family has. Otherwise it is unknown. Of
segments that overlap, the one counts that shares most with its template, then the likelier, then the shorter.

Defined results: null and empty texts have no licence; very long texts are read whole; equal texts get equal
results; ties between families go to the one first in alphabetical order; an empty table gives an empty table. The
output column replaces one of its name; other columns pass through unchanged.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import hash_share, table

#: The phrases by which licence families are known.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "apache": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "Licensed under the Apache License, Version 2.0.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
        "Released under the BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-NC-SA 4.0.",
        "Licensed under CC BY-NC-ND 4.0.",
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.', "Released under the ISC License."),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "mit": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "proprietary": ("All rights reserved. No part of this work may be reproduced or distributed without prior written permission of the copyright holder.", "All rights reserved.", "Copyright (c) 2024. All rights reserved.", "Confidential and proprietary. Unauthorized copying of this file is strictly prohibited."),
    "public-domain": ("This is free and unencumbered software released into the public domain.", "To the extent possible under law, the author has waived all copyright and related rights to this work.", "Released under CC0 1.0 Universal."),
}
#: Sentences of known licences that are of no family above; what they share with a family's tells nothing of it.
OTHERS = (
    "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed.",
    "This library is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0.",
    "Released under the Artistic License 2.0.",
    "The Artistic License 2.0",
    "Distributed under the Boost Software License, Version 1.0.",
    'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY.',
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
    "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    "Released under the zlib License.",
)
#: Sentences of licences of no family above, to train and to calibrate ``unknown``; {} is an invented name, # a number.
UNKNOWN_FIT = (
    "Licensed under the {} License.",
    "Released under the {} License, version #.",
    "This program and the accompanying materials are made available under the terms of the {} Public License #.#.",
    "You may redistribute and modify this work under the terms of the {} License.",
    "This project is licensed under the terms of the {} license.",
    "Permission is granted to anyone to use this software under the {} Public License, version #.",
    "License: {}",
    "SPDX-License-Identifier: {}-#.#",
    "Distributed under the {} {} License, see the accompanying file for the terms.",
    "Use of this source code is governed by the {} licence that can be found in the LICENSE file.",
    "This work is licensed under the {} Open Licence #.#.",
    "Copying and distribution of this file, with or without modification, are permitted under the {} License of our own making.",
    "You can redistribute it and/or modify it under the {} Public License, version #.",
    "The {} License applies to all copies and derivative works.",
)
UNKNOWN_HELD = (
    "Made available under the {} Licence, version #.#.",
    "Licensed under the {} Foundation License.",
    "The terms of the {} Public License v# apply to this software.",
    "Redistribution is permitted under the {} Public License, version #.",
    "Available under the {} license terms.",
    "SPDX-License-Identifier: {}",
)
NONE, UNKNOWN = "none", "unknown"
FAMILIES = tuple(sorted(TEMPLATES))
CLASSES = (*FAMILIES, UNKNOWN, NONE)
MAX_WORDS = 64
#: Words of the windows, which overlap by half, of segments that are longer.
WINDOWS = (16, MAX_WORDS)
#: Bits of the table in which n-grams are looked up; of two that fall together the weightier is kept.
BITS = 22
CONFIRM = 0.5
#: A segment that a template confirms need only be likelier licence-like than not.
LIKELY = 0.5
#: Share of ordinary segments that may pass for licence-like when the bar is set.
MISTAKEN = 0.001
_WORD = re.compile(r"[^\W_]+(?:[-.][^\W_]+)*")
_NUMBER = re.compile(r"\d+")
#: The end of a line or of a sentence.
_CUT = re.compile(r"\n|[.!?](?=\s)")
#: A licence tag that means the same as the SPDX one.
_TAG = re.compile(r"(?i)(?<![\w-])licen[cs]e:\s+(?=\w)")
_SHIFT = np.uint64(64 - BITS)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def numbered(words: list[str]) -> list[str]:
    """Words with every number as 0."""
    return [_NUMBER.sub("0", w) for w in words]


def words_of(paragraph: str) -> list[str]:
    """Lower-case words with every number as 0."""
    return numbered(_WORD.findall(_TAG.sub("SPDX-License-Identifier: ", paragraph).lower()))


class Words(dict):
    """Hashes of lower-case words, with every number as 0, kept for the next time."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(_NUMBER.sub("0", word))
        return h

    def hashes(self, words: list[str]) -> np.ndarray:
        if len(self) > 200_000:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def grams_at(h: np.ndarray) -> list[np.ndarray]:
    """Hashes of the 1-, 2- and 3-grams that start at each word."""
    out, now = [], np.zeros(0, np.uint64)
    for n in range(3):
        now = h[: max(0, len(h) - n)] * _ODD[n] if n == 0 else (now[: max(0, len(h) - n)] ^ (h[n:] >> np.uint64(7))) * _ODD[n]
        out.append((now ^ (now >> np.uint64(29))) * _ODD[0])
    return out


def words_and_cuts(low: str) -> tuple[list[str], tuple[list[int], list[int], list[int]]]:
    """The words of a lower-case text, and how many stand before each blank line, end of a sentence and end of a line."""
    words: list[str] = []
    blank, sentence, line = [], [], []
    at, newline = 0, -1
    for m in _CUT.finditer(low):
        words += _WORD.findall(low, at, m.end())
        at = m.end()
        if m[0] != "\n":
            sentence.append(len(words))
            continue
        line.append(len(words))
        if newline >= 0 and not low[newline:at].strip():
            blank.append(len(words))
        newline = at
    return words + _WORD.findall(low, at), (blank, sentence, line)


def _distinct(places: list[int]) -> np.ndarray:
    return np.array(sorted(set(places)), np.int64)


def segments_of(n: int, blank: list[int], sentence: list[int], line: list[int]) -> np.ndarray:
    """(first word, word behind the last) of the segments of a text of ``n`` words, distinct and in order."""
    paragraphs = _distinct([0, *blank, n])
    ends = _distinct([0, *blank, *sentence, n])
    found = []
    last = paragraphs[np.searchsorted(paragraphs, ends[:-1], side="right")]
    for k in (1, 2, 3):
        pair = np.stack([ends[:-k], ends[k:]], axis=1)
        found.append(pair[pair[:, 1] <= last[: len(pair)]])
    lines = _distinct([0, *line, n])
    found.append(np.stack([lines[:-1], lines[1:]], axis=1))
    every, sentences = np.concatenate(found), found[0]
    size = every[:, 1] - every[:, 0]
    out = [every[(size > 0) & (size <= MAX_WORDS)]]
    for w in WINDOWS:
        long_ = sentences[sentences[:, 1] - sentences[:, 0] > w]
        times = -(-(long_[:, 1] - long_[:, 0] - w // 2) // (w // 2))
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        at = np.repeat(long_[:, 0], times) + nth * (w // 2)
        out.append(np.stack([at, np.minimum(at + w, np.repeat(long_[:, 1], times))], axis=1))
    code = np.unique(np.concatenate([x[:, 0] << 32 | x[:, 1] for x in out]))
    return np.stack([code >> 32, code & 0xFFFFFFFF], axis=1)


def pairs_of(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:]))


_PAIRS = {f: [pairs_of(words_of(t)) for t in TEMPLATES[f]] for f in FAMILIES}
_SHARED = {f: {p for g in FAMILIES if g != f for pairs in _PAIRS[g] for p in pairs} | {p for t in OTHERS for p in pairs_of(words_of(t))} for f in FAMILIES}
#: Of each template, all its word pairs and those that no other family has.
_OWN = {f: [(pairs, pairs - _SHARED[f]) for pairs in _PAIRS[f]] for f in FAMILIES}


def confirmed(family: str, words: list[str]) -> int:
    """How many word pairs the segment shares with a template of the family that confirms it; 0 if none does.

    Between the first and the last of them, no more pairs may contradict the template than agree with it.
    """
    have, best = pairs_of(words), 0
    for pairs, own in _OWN[family]:
        shared, proper = len(have & pairs), len(have & own)
        at = [k for k, pair in enumerate(zip(words, words[1:])) if pair in pairs]
        if not at or 2 * len(at) < at[-1] - at[0] + 1:
            continue
        enough = shared >= CONFIRM * len(pairs) or (len(pairs) > 12 and shared >= max(6, CONFIRM * len(have)))
        if enough and proper >= (1 if len(pairs) > 12 else max(1, CONFIRM * len(own))):
            best = max(best, shared)
    return best


def _grams_of(segments: np.ndarray) -> np.ndarray:
    size = segments[:, 1] - segments[:, 0]
    return size + np.maximum(size - 1, 0) + np.maximum(size - 2, 0)


def _sums(values: list[np.ndarray], segments: np.ndarray) -> np.ndarray:
    """Sums over each segment of the values of the 1-, 2- and 3-grams that lie in it, from running sums."""
    total = 0
    for n, v in enumerate(values):
        upto = np.concatenate([np.zeros((1, *v.shape[1:])), np.cumsum(v, axis=0, dtype=float)])
        end = np.maximum(segments[:, 1] - n, segments[:, 0])
        total = total + upto[np.minimum(end, len(v))] - upto[np.minimum(segments[:, 0], len(v))]
    return total


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass(frozen=True)
class LicenceModel:
    #: Hashes of n-grams met in training, behind a first one that stands for all others, and a row of weights for each.
    met: np.ndarray
    weights: np.ndarray
    #: What a segment of words never met is taken for.
    bias: np.ndarray
    temperature: float
    #: Least probability of being licence-like of an unknown licence, and least share of it that is a family's.
    licence_bar: float
    family_bar: float

    @cached_property
    def table(self) -> np.ndarray:
        """The row of weights at each place of the table."""
        table = np.zeros(1 << BITS, np.int32)
        order = np.argsort(np.abs(self.weights).sum(axis=1), kind="stable")
        table[(self.met[order] >> _SHIFT).astype(np.int64)] = order
        return table

    def rows(self, h: np.ndarray) -> list[np.ndarray]:
        """The rows of weights of a text's 1-, 2- and 3-grams, by its words' hashes."""
        found = []
        for grams in grams_at(h):
            row = self.table[(grams >> _SHIFT).astype(np.int64)]
            found.append(np.where(self.met[row] == grams, row, 0))
        return found

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("table", "evidence")}

    @cached_property
    def evidence(self) -> np.ndarray:
        """What a row of weights adds at most to a licence class against none; less than nothing where it speaks against all."""
        return (self.weights[:, :-1] - self.weights[:, -1:]).max(axis=1).astype(float)

    def may_be(self, rows: list[np.ndarray], segments: np.ndarray) -> np.ndarray:
        """Whether a segment can be likelier licence-like than not, by a bound: each n-gram's evidence for the class it favours."""
        total = _sums([self.evidence[r] for r in rows], segments)
        most = ((self.bias[:-1] - self.bias[-1]).max() + total / np.sqrt(np.maximum(_grams_of(segments), 1))) / self.temperature
        return (len(CLASSES) - 1) * np.exp(np.minimum(most, 50)) >= LIKELY / (1 - LIKELY) * 0.999

    def probabilities(self, rows: list[np.ndarray], segments: np.ndarray) -> np.ndarray:
        """A row of class probabilities for each segment of a text whose n-grams have these ``rows`` of weights."""
        z = _sums([self.weights[r] for r in rows], segments)
        return _softmax((self.bias + z / np.sqrt(np.maximum(_grams_of(segments), 1))[:, None]) / self.temperature)

    def scan(self, text: str | None, kept: Words | None = None) -> list[tuple[int, int, str, float]]:
        """(start, end, class, probability) of the segments that aren't none, in order and without overlap."""
        low = (text or "").lower()
        if len(low) != len(text or ""):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        if "licen" in low:
            low = _TAG.sub(lambda m: "spdx:".ljust(len(m[0])), low)
        words, cuts = words_and_cuts(low)
        if not words:
            return []
        if "spdx" in low:
            words = ["spdx-license-identifier" if w == "spdx" else w for w in words]
        rows = self.rows((Words() if kept is None else kept).hashes(words))
        segments = segments_of(len(words), *cuts)
        segments = segments[self.may_be(rows, segments)]
        found = []
        for s in range(0, len(segments), 4_096):
            part = segments[s : s + 4_096]
            base, upto = int(part[:, 0].min()), int(part[:, 1].max())
            p = self.probabilities([r[base:upto] for r in rows], part - base)
            for k in np.flatnonzero(1 - p[:, -1] >= LIKELY).tolist():
                a, b = part[k].tolist()
                best = int(p[k, :-2].argmax())
                like = float(1 - p[k, -1])
                shared = confirmed(FAMILIES[best], numbered(words[a:b])) if p[k, best] >= self.family_bar * like else 0
                if not shared and like < self.licence_bar:
                    continue
                found.append((-shared, -float(p[k, best]) if shared else -like, b - a, a, b, best if shared else -1))
        if not found:
            return []
        spans, taken, out = [m.span() for m in _WORD.finditer(low)], np.zeros(len(words), bool), []
        for shared, p_, _, a, b, best in sorted(found):
            if taken[a:b].any():
                continue
            if shared:
                a, b = _trimmed(FAMILIES[best], words, a, b)
            taken[a:b] = True
            out.append((spans[a][0], spans[b - 1][1], FAMILIES[best] if shared else UNKNOWN, -p_))
        return sorted(out)

    def scan_column(self, df: DataFrame, text: str = "text", out: str = "licences") -> DataFrame:
        """``df`` with an array of (start, end, class, probability)."""
        model = self

        @F.pandas_udf("array<struct<start: int, end: int, class: string, probability: double>>")
        def licences(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            kept = Words()
            for batch in batches:
                yield pd.Series([[{"start": a, "end": b, "class": c, "probability": p} for a, b, c, p in model.scan(t, kept)] for t in batch], dtype=object)

        return df.withColumn(out, licences(F.col(text)))


def _trimmed(family: str, words: list[str], a: int, b: int) -> tuple[int, int]:
    """The part of a segment from the first to the last word pair that it shares with its best template."""
    own = numbered(words[a:b])
    best = max((pairs for pairs, _ in _OWN[family]), key=lambda pairs: len(pairs & pairs_of(own)))
    at = [a + k for k, pair in enumerate(zip(own, own[1:])) if pair in best]
    return at[0], at[-1] + 2


def varied(template: str, filler: list[str], rng: random.Random) -> list[str]:
    """Words of a template as texts may have it."""
    words = words_of(template)
    if len(words) > 8 and rng.random() < 0.5:
        n = rng.randint(max(6, len(words) // 2), len(words))
        s = rng.randint(0, len(words) - n)
        words = words[s : s + n]
    if len(words) > 6:
        words = [w for w in words if rng.random() > 0.06]
    before, after = (rng.choices(filler, k=rng.choice((0, 0, 1, 3, 10))) if filler else [] for _ in "ab")
    return before + words + after


def invented_name(rng: random.Random) -> str:
    return "".join(rng.choice("bcdfghjklmnprstvwz") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) + rng.choice(["", "x", "n", "pl", "soft"])


def named(sentence: str, rng: random.Random) -> str:
    """A sentence with invented names and numbers."""
    return re.sub(r"\{\}", lambda _: invented_name(rng), sentence).replace("#", str(rng.randint(1, 9)))


def fit_paragraphs(ordinary: list[str], seed: int = 7, each: int = 60, epochs: int = 12) -> LicenceModel:
    """Trains on varied templates and named sentences against ordinary paragraphs; every fifth example, and sentences of other wordings, calibrate."""
    rng, kept = random.Random(seed), Words()
    plain = [w for w in map(words_of, ordinary) if w]
    legal = {w for f in FAMILIES for t in TEMPLATES[f] for w in words_of(t)}
    filler = [w for words in plain for w in words if w not in legal]
    unknown, none = len(FAMILIES), len(FAMILIES) + 1

    def example(words: list[str]) -> np.ndarray:
        return np.concatenate(grams_at(kept.hashes(words[: 2 * MAX_WORDS])))

    x = [(example(varied(t, filler, rng)), k) for k, f in enumerate(FAMILIES) for t in TEMPLATES[f] for _ in range(each)]
    x += [(example(varied(named(t, rng), filler, rng)), unknown) for t in UNKNOWN_FIT for _ in range(3 * each)]
    x += [(example(varied(t, filler, rng)), unknown) for t in OTHERS for _ in range(each)]
    # Licence words out of their order tell nothing of a family.
    loose = [w for f in FAMILIES for t in TEMPLATES[f] for w in words_of(t)]
    mixed = [rng.choices(loose, k=rng.randint(1, 6)) + rng.choices(filler or loose, k=rng.randint(0, 12)) for _ in range(12 * each)]
    strange = [[invented_name(rng) for _ in range(rng.randint(1, 12))] for _ in range(12 * each)]
    # Nor does one word again and again, or a single one that a template has too.
    again = [[rng.choice(filler or loose)] * rng.randint(2, MAX_WORDS) for _ in range(12 * each)] + [[w] for w in sorted(legal)] * 4
    x += [(example(w), none) for w in plain + mixed + strange + again]
    rng.shuffle(x)
    fit, held = [e for k, e in enumerate(x) if k % 5], [e for k, e in enumerate(x) if k % 5 == 0]
    held += [(example(varied(named(t, rng), filler, rng)), unknown) for t in UNKNOWN_HELD for _ in range(each)]
    n = len(CLASSES)
    met = np.unique(np.concatenate([[np.uint64(0)], *(g for g, _ in fit)]))
    fit = [(np.searchsorted(met, g), y) for g, y in fit]
    weights, square = np.zeros((len(met), n), np.float32), np.full((len(met), n), 1e-6, np.float32)
    bias, bias_square = np.zeros(n), np.full(n, 1e-6)
    for _ in range(epochs):
        for g, y in fit:
            scale = 1 / np.sqrt(len(g))
            d = _softmax(bias + weights[g].sum(axis=0) * scale)
            d[y] -= 1
            bias_square += d**2
            bias -= 0.2 * d / np.sqrt(bias_square)
            step = (d * scale).astype(np.float32)
            square[g] += step**2
            weights[g] -= 0.2 * step / np.sqrt(square[g])
        rng.shuffle(fit)
    at = [np.minimum(np.searchsorted(met, g), len(met) - 1) for g, _ in held]
    z, y = np.array([bias + (weights[k] * (met[k] == g)[:, None]).sum(axis=0) / np.sqrt(len(g)) for k, (g, _) in zip(at, held)]), np.array([y for _, y in held])

    def loss(t: float) -> float:
        return float(-np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean())

    temperature = min((0.5, 0.7, 1, 1.4, 2, 2.8, 4), key=loss)
    p = _softmax(z / temperature)
    like = 1 - p[:, -1]
    share = p[:, :-2].max(axis=1) / np.maximum(like, 1e-12)
    # A text has many ordinary segments for each of a licence, so few of them may pass.
    licence_bar = float(np.clip(np.quantile(like[y == none], 1 - MISTAKEN), 0.5, 0.95)) if (y == none).any() else 0.5
    family_bar = _between(share[(y == unknown) & (like >= licence_bar)], share[(y < unknown) & (like >= licence_bar)])
    weights[0] = 0
    return LicenceModel(met, weights, bias, temperature, licence_bar, family_bar)


def _between(low: np.ndarray, high: np.ndarray) -> float:
    """The bar that puts fewest of both on the wrong side, each counted by its share; the highest such."""
    if not len(low) or not len(high):
        return 0.5
    at = np.unique(np.r_[low, high, 0.5])
    wrong = [(low >= t).mean() + (high < t).mean() for t in at]
    best = float(at[len(at) - 1 - int(np.argmin(wrong[::-1]))])
    return min(max(best, 1e-3), 1 - 1e-3)


def fit_licences(docs: DataFrame, text: str = "text", max_docs: int = 300, max_paragraphs: int = 4_000) -> LicenceModel:
    """Ordinary paragraphs are pieces of up to ``MAX_WORDS`` words from the lines of about ``max_docs`` texts, read whole.

    Ids are hashed to a share of all texts; tasks cut them, and ``max_paragraphs`` pieces at most, those with the
    least hashes, come to the driver. Pieces that a template confirms are left out.
    """
    n = max(1, docs.count())

    @F.pandas_udf("array<string>")
    def pieces(batch: pd.Series) -> pd.Series:
        out = []
        for t in batch:
            words = [line.split() for line in (t or "").split("\n")]
            out.append([" ".join(w[k : k + MAX_WORDS]) for w in words for k in range(0, len(w), MAX_WORDS)])
        return pd.Series(out, dtype=object)

    few = docs.where(hash_share("doc_id") < 2 * max_docs / n).select(F.explode(pieces(F.col(text))).alias("piece")).distinct()
    found = [r["piece"] for r in few.orderBy(F.xxhash64("piece"), "piece").limit(max_paragraphs).collect()]
    return fit_paragraphs([p for p in found if not any(confirmed(f, words_of(s)) for s in (p, *re.split(r"(?<=[.!?])\s+", p)) for f in FAMILIES)])


def op6_licences(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = fit_licences(docs).scan_column(docs)
    known = F.filter("licences", lambda x: x["class"] != UNKNOWN)
    best = F.array_max(F.transform(known, lambda x: F.struct(x["probability"].alias("p"), x["class"].alias("c"))))
    licence = F.coalesce(best["c"], F.when(F.size("licences") > 0, UNKNOWN).otherwise(NONE))
    return found.select(
        "doc_id",
        licence.alias("licence"),
        F.coalesce(best["p"], F.lit(0.0)).alias("probability"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(known, lambda x: x["class"]))), ",").alias("families"),
        F.size("licences").alias("n_paragraphs"),
        F.array_join(F.transform("licences", lambda x: F.concat_ws(":", x["start"], x["end"], x["class"])), " ").alias("spans"),
    )
