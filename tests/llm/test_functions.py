"""The operators' plain functions against brute force."""

import random
import time
from array import array

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestone.llm import bpe, language, licences, lz, multi_index, near_duplicates, packing, pii, simhash, toxicity, warc

ALPHABET = ["a", "b", "the", "ing", " ", "  ", "\n", "'s", "'ll", "1", "23", "é", "日本", "!", "..", "\t", "\xa0", "'", "tion", "<|endoftext|>", "<|", "ß", "😀", "Σ", "\x1c"]


# -- fingerprints ---------------------------------------------------------------------------------------------------
def test_lz_phrases_extend_known_phrases_by_one_character():
    phrases, rest = lz.parse("abababababa")
    assert phrases == {"a", "b", "ab", "aba", "ba"} and rest == "ba"
    assert all(len(p) == 1 or p[:-1] in phrases for p in phrases)


def test_lz_parse_resumes():
    text = "".join(random.Random(0).choices("abc ", k=3000))
    head, rest = lz.parse(text[:1234])
    assert lz.parse(rest + text[1234:], set(head)) == lz.parse(text)


def test_lz_likeness_is_jaccard():
    rng = random.Random(1)
    texts = ["".join(rng.choices("ab", k=60)) for _ in range(20)]
    for a, b in zip(texts, texts[1:]):
        x, y = lz.parse(a)[0], lz.parse(b)[0]
        assert lz.likeness(lz.fingerprint(a), lz.fingerprint(b)) == pytest.approx(len(x & y) / len(x | y))
    assert lz.fingerprint(None) == lz.fingerprint("") == ""
    assert lz.likeness("", "") == 1 and lz.likeness("", lz.fingerprint("x")) == 0


# -- simhash --------------------------------------------------------------------------------------------------------
def brute_fingerprint(text, k=4):
    words = text.encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", ["", " \n", "One", "a b c", "a b c d", "A a A a A a A", "é è\x0bü\x1cx y z " * 40, "x " * 70_000])
def test_simhash_fingerprint(text):
    assert simhash.fingerprint(text) & (2**64 - 1) == brute_fingerprint(text)


def test_block_masks_meet_every_near_pair():
    masks = [m & (2**64 - 1) for m in simhash.block_masks(4, 6)]
    assert len(masks) == 15
    rng = random.Random(2)
    for _ in range(500):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), 4):
            y ^= 1 << b
        assert any(x & m == y & m for m in masks)


def components(n, pairs):
    label = list(range(n))
    for a, b in pairs:
        x, y = label[a], label[b]
        label = [min(x, y) if v in (x, y) else v for v in label]
    return label


def test_large_group_keeps_every_component():
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**64, 3, dtype=np.uint64)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (3, 120, 3), dtype=np.uint64), axis=2)
    x = np.unique(np.concatenate([(centres[:, None] ^ flips).ravel(), rng.integers(0, 2**64, 50, dtype=np.uint64)]))
    a, b = simhash._large_group(x[:, None], 4)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 4
    assert components(len(x), zip(a, b)) == components(len(x), np.argwhere(np.triu(near, 1)))
    assert len(a) < len(x)


def test_reach_covers_pairs_at_the_similarity():
    """Fingerprints of sets of similarity 0.8 are within reach, whatever the sizes, and strangers aren't."""
    rng = np.random.default_rng(4)
    for n in (4, 5, 8, 9, 30, 100, 1000):
        far = 0
        for _ in range(200):
            shared = rng.integers(0, 2**64, n, dtype=np.uint64)
            more = rng.integers(0, 2**64, n // 4, dtype=np.uint64)
            a, b = near_duplicates.simhash_of(shared).view(np.uint64), near_duplicates.simhash_of(np.r_[shared, more]).view(np.uint64)
            far += np.bitwise_count(a ^ b).sum() > near_duplicates.reach(np.array([n]), 0.8)[0]
        assert far == 0
    strangers = [near_duplicates.simhash_of(rng.integers(0, 2**64, 300, dtype=np.uint64)).view(np.uint64) for _ in range(60)]
    assert all(np.bitwise_count(x ^ y).sum() > near_duplicates.reach(np.array([300]), 0.8)[0] for k, x in enumerate(strangers) for y in strangers[:k])


def test_shared_counts_and_classes_of_sets():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**64, 120, dtype=np.uint64)
    sets = [np.unique(np.r_[base[rng.random(120) < 0.9], rng.integers(0, 2**64, k % 30, dtype=np.uint64), rng.integers(0, 40, k % 7, dtype=np.uint64)]) for k in range(90)]
    sets += [np.zeros(1, np.uint64), np.unique(rng.integers(0, 2**64, 50, dtype=np.uint64))]
    got = near_duplicates.shared_counts(sets)
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    off = ~np.eye(len(sets), dtype=bool)
    assert (got[off] == want[off]).all()
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if 10 * want[a, b] >= 8 * (len(sets[a]) + len(sets[b]) - want[a, b])]
    assert 10 < len(pairs) and near_duplicates.similar_classes(sets, 0.8).tolist() == components(len(sets), pairs)


def test_reach_pairs_connect_all_in_reach():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**64, 200, dtype=np.uint64)
    sets = [np.r_[base[: 200 - k], rng.integers(0, 2**64, k, dtype=np.uint64)] for k in rng.integers(0, 110, 70).tolist()]
    rows = pd.DataFrame({"n": 200} | {c: v for c, v in zip(near_duplicates.WORDS, np.stack([near_duplicates.simhash_of(h) for h in sets]).T)}, index=range(70))
    near = near_duplicates.Near(rows, 0.8)
    every = [(a, b) for a in range(70) for b in range(a) if near(np.array([a]), np.array([b]))[0]]
    for starts in ([0], [0, 5, 16, 17]):
        ends = [*starts[1:], 70]
        got = [(a, b) for i, j in near_duplicates.reach_pairs(np.array(starts), near, np.arange(70)) for a, b in zip(i.tolist(), j.tolist())]
        within = [(a, b) for a, b in every if any(s <= b and a < e for s, e in zip(starts, ends))]
        assert components(70, got) == components(70, within)


def test_pairs_at_the_similarity_share_a_band():
    rng = np.random.default_rng(5)
    missed = 0
    for _ in range(1500):
        shared = rng.integers(0, 2**64, 160, dtype=np.uint64)
        a, b = (near_duplicates.band_keys(np.r_[shared, rng.integers(0, 2**64, 20, dtype=np.uint64)]) for _ in "ab")
        missed += not {*a} & {*b}
    assert missed <= 4


# -- toxicity and language ------------------------------------------------------------------------------------------
def invented(rng, n, extra=()):
    syllables = ["ta", "ro", "mi", "ne", "su", "ka", "lo", "vi"]
    words = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n)]
    for w in extra:
        words[rng.randrange(n)] = w
    return " ".join(words)


def test_toxicity_on_held_out_texts():
    rng = random.Random(5)
    bad = ["gruzzle", "skavort", "blimpox"]
    toxic = [invented(rng, 120, rng.choices(bad, k=5)) for _ in range(160)]
    plain = [invented(rng, 120) for _ in range(160)]
    model = toxicity.fit_texts(toxic[:120], plain[:120])
    s = model.score_texts(toxic[120:] + plain[120:] + [None, ""])
    assert (s[:40] >= 0.5).mean() > 0.9 and (s[40:80] < 0.5).mean() > 0.9
    assert ((s >= 0) & (s <= 1)).all() and s[-1] == s[-2] < 0.5


def test_toxicity_windows_cover_the_text():
    for n in (1, 47, 48, 64, 65, 500):
        data = bytes(i % 251 for i in range(n))
        w = toxicity.windows(data)
        assert w[0] + b"".join(x[toxicity.WINDOW_BYTES - toxicity.STRIDE_BYTES :] for x in w[1:]) == data
    assert toxicity.windows(b"") == []


def test_toxicity_without_labels_still_scores():
    assert len(toxicity.fit_texts([], []).score_texts(["x", None])) == 2


def test_toxicity_scores_are_those_of_the_stored_parts():
    """Scores against compression by new compressors over the two dictionaries and the features written out."""
    rng = random.Random(15)
    bad = ["gruzzle", "skavort", "blimpox"]
    toxic = [invented(rng, 120, rng.choices(bad, k=5)) for _ in range(120)]
    plain = [invented(rng, 120) for _ in range(120)]
    model = toxicity.fit_texts(toxic, plain)
    assert model.toxic[: toxicity.ORDINARY_BYTES] == model.ordinary[: toxicity.ORDINARY_BYTES] and len(model.toxic) == len(model.ordinary)
    assert any(w.encode() in model.toxic and w.encode() not in model.ordinary for w in bad)
    params = zstandard.ZstdCompressionParameters.from_level(6, min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False)

    def size(dictionary, data):
        raw = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(compression_params=params)
        return len(zstandard.ZstdCompressor(dict_data=raw, compression_params=params).compress(data))

    for text in (toxic[0], plain[0], "Gruzzle!", "", invented(rng, 900, bad)):
        b = text.lower().encode()
        cuts = [b[i : i + 64] for i in range(0, max(1, len(b) - 16), 48)] if b else []
        gain = sorted((size(model.ordinary, w) - size(model.toxic, w) for w in cuts), reverse=True)
        n = len(gain)
        x = [0.0] * 11 + [1.0]
        if n:
            over = lambda k: sum(g >= k for g in gain)
            root = n**0.5
            x = [min(gain[min(k, n - 1)], 12) for k in (0, 1, 3)] + [sum(max(g - k, 0) for g in gain) / root for k in (2, 4)]
            x += [over(4) / n * 10, *(np.log1p(over(k)) for k in (5, 6, 7)), over(6) / n * 10, np.log(n), 1.0]
        want = 1 / (1 + np.exp(-np.clip(np.dot(x, model.weights), -30, 30)))
        assert model.score_texts([text])[0] == pytest.approx(want)


def test_language_scores_are_cosines_of_bundles():
    """Predictions against bundles added up n-gram by n-gram."""
    rng = random.Random(16)
    pairs = [("aa", "tara lomi nera"), ("bb", "øyvi kjøss på"), ("aa", "nemi rota"), ("cc", "zzyx qwrt zzq")]
    model = language.fit_texts(pairs)
    texts = ["Tara på kjøss, tara!", "a", "zz", "日本 tara", "lomi " * 3_000, *(invented(rng, k) for k in range(1, 300))]
    found, score = model.predict_texts(texts)
    for text, lang, s in list(zip(texts, found, score))[:30]:
        words = language.normalised(text)
        bundle = np.zeros(language.DIM)
        for k in range(len(words) - 2):
            v = np.ones(language.DIM)
            for back, c in enumerate(reversed(words[k : k + 3])):
                v *= np.roll(language.letter_vector(ord(c)), back)
            bundle += v
        bundle -= (bundle @ model.shared) * model.shared
        cosine = model.prototypes @ bundle / np.linalg.norm(bundle)
        assert model.langs[int(cosine.argmax())] == lang and s == pytest.approx((1 + cosine.max()) / 2, abs=1e-6)


def test_ties_between_languages_go_to_the_first():
    model = language.fit_texts([("bb", "tara lomi"), ("aa", "tara lomi")])
    assert model.predict_texts(["tara"])[0] == ["aa"]


def test_language_defined_results():
    model = language.fit_texts([("aa", "tara lomi nera rota"), ("bb", "øyvi kjøss på blåbær")])
    found, score = model.predict_texts([None, "", "12 !?", "²½Ⅷ _", "a", "tara nera", "blåbær på", "日本語"])
    assert found[:4] == ["und"] * 4 and score[:4] == [0, 0, 0, 0]
    assert found[5:7] == ["aa", "bb"] and set(found[4:]) <= {"aa", "bb"} and all(0 <= s <= 1 for s in score)
    assert language.fit_texts([]).predict_texts(["x"])[0] == ["und"]


# -- PII ------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("size", [1, 2, 3, 7, 100, 101, 997, pii.RING + 1, pii.DAYS])
def test_feistel_is_a_permutation(size):
    f = pii.Feistel(b"k")
    moved = [f.moved(x, size, "t") for x in range(size)]
    assert size in (1, 10_001, pii.DAYS) or all(y != x for x, y in enumerate(moved))
    assert sorted(moved) == list(range(size)) and all(f.back(y, size, "t") == x for x, y in enumerate(moved))


def test_pseudonyms_keep_formats_and_links():
    f = pii.Feistel(b"k")
    text = "Call +1 (988) 555-2485, card 4041894974608795 4539 1488 0343 6467x jo.42@mail3.example.com 70.123.182.155\n1999-12-31 31.12.2001 078-05-1120 DE89 3704 0044 0532 0130 00 token = \"7602ad27cf5550de1c\""
    new, found = pii.pseudonymised(text, f)
    assert found == {"email": 1, "phone": 1, "card": 2, "iban": 1, "ssn": 1, "ip": 1, "date": 2, "secret": 1} or found["card"] == 1
    for value in ("988) 555-2485", "4041894974608795", "jo.42@", "70.123.182.155", "1999-12-31", "31.12.2001", "078-05-1120", "DE89 3704", "7602ad27cf5550de1c"):
        assert value in text and value not in new
    card = next(w for w in new.split() if len(w) == 16 and w.isdigit())
    assert pii.luhn_digit(card[:-1]) == card[-1]
    assert pii.pseudonymised("x 4041894974608795 y", f)[0] == f"x {card} y"
    assert pii.pseudonymised("card 4041894974608796, ip 999.1.1.1, 99/99/2001, ssn 666-12-1234, v2.0.1", f)[1] == dict.fromkeys(pii.KINDS, 0)
    assert pii.pseudonymised(None, f)[0] is None and pii.pseudonymised("", f)[0] == ""


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**15 - 1))
def test_cards_map_to_cards_and_back(n):
    f = pii.Feistel(b"other")
    body = f"{n:015d}"
    moved = f.text(body, pii.DIGITS, "card")
    assert len(moved) == 15 and f.back(int(moved), 10**15, "card") == n


@pytest.mark.parametrize("alphabet", [pii.DIGITS, pii.HEX, pii.LETTERS])
@pytest.mark.parametrize("n", [1, 2, 3, 24, 25, 100, 512, 10_000])
def test_values_of_any_length_are_permuted_whole(alphabet, n):
    """No position keeps its character more often than chance has it, and the way back gives the value."""
    f, rng = pii.Feistel(b"k"), random.Random(n)
    s = "".join(rng.choices(alphabet, k=n))
    new = f.text(s, alphabet, "secret")
    assert len(new) == n and new != s and set(new) <= set(alphabet) and f.text(new, alphabet, "secret", back=True) == s
    if n >= 512:
        p = 1 / len(alphabet)
        for half in (slice(0, n // 2), slice(n // 2, n)):
            same = sum(a == b for a, b in zip(s[half], new[half]))
            assert same <= n / 2 * p + 5 * (n / 2 * p * (1 - p)) ** 0.5
        other = f.text(s[:-1] + alphabet[alphabet.index(s[-1]) - 1], alphabet, "secret")
        assert sum(a == b for a, b in zip(new, other)) < n * (p + 0.1)


def test_long_lines_take_time_in_proportion():
    f, rng = pii.Feistel(b"k"), random.Random(3)
    for line in ("a b" * 330_000, "ab" * 500_000, "9" * 1_000_000, "a@" * 500_000, "." * 500_000 + "@" + "a." * 200_000 + "b", "token=" * 160_000, "".join(rng.choices("0123456789abcdef", k=1_000_000))):
        began = time.process_time()
        pii.pseudonymised(line, f)
        assert time.process_time() - began < 8


@pytest.mark.parametrize(
    "line,value",
    [
        ('{"password": "abcdefgh1"}', "abcdefgh1"),
        ('password="hunter2hunter2"', "hunter2hunter2"),
        ("api_key: sk-12345abcdef", "sk-12345abcdef"),
        ("apiKey=abcd1234efgh", "abcd1234efgh"),
        ("client_secret: 'zz9-zz9-zz9'", "zz9-zz9-zz9"),
        ('token = "abcdefghij"', "abcdefghij"),
        ("mail m\u00fcller.\u017ei\u017eka@ex.org now", "m\u00fcller.\u017ei\u017eka"),
        ("mail .a.bcd@x.com.", "a.bcd"),
    ],
)
def test_secrets_and_names_in_their_forms(line, value):
    new, found = pii.pseudonymised(line, pii.Feistel(b"k"))
    before, after = line.split(value)
    assert sum(found.values()) == 1 and new.startswith(before) and new.endswith(after) and len(new) == len(line)
    assert not [1 for a, b in zip(value, new[len(before) :]) if a == b and a.isalnum() and ord(a) > 127]
    assert value not in new


def test_prose_about_keys_stays():
    for line in ("the key: something else", '"key": "Backspace"', "monkey: bananas123", "a token: short1", "Password: required by the site"):
        assert pii.pseudonymised(line, pii.Feistel(b"k")) == (line, dict.fromkeys(pii.KINDS, 0))


def test_invalid_candidates_hide_no_valid_value():
    f = pii.Feistel(b"k")
    for line, kind, value in (
        ("pay AT61 1904 3002 3457 3201 EUR now", "iban", "AT61 1904 3002 3457 3201"),
        ("AT61 1904 3002 3457 3201 2024", "iban", "AT61 1904 3002 3457 3201"),
        ("XX12 AT61 1904 3002 3457 3201", "iban", "AT61 1904 3002 3457 3201"),
        ("order 2024 4111 1111 1111 1111", "card", "4111 1111 1111 1111"),
        ("order 2024 2025 4111 1111 1111 1111, 99/99/2001", "card", "4111 1111 1111 1111"),
        ("AB12 3456 7890 4111 1111 1111 1111", "card", "4111 1111 1111 1111"),
    ):
        new, found = pii.pseudonymised(line, f)
        before, after = line.split(value)
        assert value not in new and new.startswith(before) and new.endswith(after) and len(new) == len(line)
        assert found == dict.fromkeys(pii.KINDS, 0) | {kind: 1}
        assert pii.pseudonymised(value, f)[0] == new[len(before) : len(line) - len(after)]
    for line in ("4111 1111 1111 1112 3", "1.2.3.999", "666-12-1234", "AT61 1904 3002 3457 3202 EUR", "31/02/2001"):
        assert pii.pseudonymised(line, f) == (line, dict.fromkeys(pii.KINDS, 0))


# -- licences -------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def scanner():
    rng = random.Random(6)
    return licences.fit_paragraphs([invented(rng, 20) for _ in range(400)])


def families(model, text):
    return [c for *_, c, _ in model.scan(text)]


def test_licences_by_family(scanner):
    assert families(scanner, "Ta romi.\nReleased under the MIT License. Suka lo") == ["mit"]
    assert families(scanner, "vi ne Licensed under the Apache License, Version 2.0. ka") == ["apache"]
    assert families(scanner, "This work is licensed under the GNU General Public License, version 3.") == ["gpl"]
    assert families(scanner, "Licensed under CC BY-NC 4.0.") == ["cc-by-nc"]
    assert families(scanner, "") == families(scanner, None) == families(scanner, "Nothing here, no word of it.") == []
    text = "x\nReleased under the MIT License. y"
    a, b, *_ = scanner.scan(text)[0]
    assert text[a:b] == "Released under the MIT License"


@pytest.mark.parametrize(
    "text",
    [
        "Licensed under the Foo License of our own making",
        "This program is made available under the terms of the Eclipse Public License 2.0",
        "You may redistribute this work under the Frobnicate Public License, version 2",
        "Released under the WTFPL License.",
        "SPDX-License-Identifier: Zlib",
    ],
)
def test_licences_of_no_family_are_unknown(scanner, text):
    assert families(scanner, text) == ["unknown"]
    assert families(scanner, f"Tara lomi nera.\n\n{text}\n\nNemi rota suka.") == ["unknown"]


def test_wrapped_notices_are_one_paragraph(scanner):
    gpl = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.
"""
    assert families(scanner, f"Tara lomi.\n\n{gpl}\nNemi rota.") == ["gpl"]
    warranty = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
    assert families(scanner, warranty) == ["mit"]


def test_every_template_is_found_as_a_line(scanner):
    for family, templates in licences.TEMPLATES.items():
        for t in templates:
            for text in (t, f"ta romi\n{t}\nSuka lo.", f"Suka lo. {t} Vi ne."):
                found = scanner.scan(text)
                assert {c for *_, c, _ in found} - {licences.UNKNOWN} == {family}, (text, found)
                assert all(b - a > 0 and text[a:b] in text for a, b, _, _ in found)
    for line, family in (("License: MIT", "mit"), ("license: Apache-2.0", "apache"), ("# SPDX-License-Identifier: MIT", "mit")):
        assert families(scanner, line) == [family]


BOOST = """Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT."""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty.  In no event will the authors be held liable for any damages
arising from the use of this software."""


@pytest.mark.parametrize("text", [BOOST, ZLIB, "Some words before.\n\nThe Artistic License 2.0\n\nand behind."])
def test_licences_that_read_like_a_family_are_unknown(scanner, text):
    assert {c for *_, c, _ in scanner.scan(text)} == {licences.UNKNOWN}


def test_words_and_cuts():
    words, (blank, sentence, line) = licences.words_and_cuts("a b. c\n \nd e.f\ng! h.\n\n\ni")
    assert words == ["a", "b", "c", "d", "e.f", "g", "h", "i"]
    assert (sorted(set(blank)), sorted(set(sentence)), sorted(set(line))) == ([3, 7], [2, 6, 7], [3, 5, 7])
    assert licences.words_and_cuts("") == ([], ([], [], []))


def test_licences_side_by_side_all_count(scanner):
    assert families(scanner, "Released under the MIT License. Licensed under the Apache License, Version 2.0.") == ["mit", "apache"]


def test_licence_probabilities_are_those_of_single_segments(scanner):
    """Class probabilities by cumulative sums against the regression written out for each segment's n-grams."""
    rng = random.Random(18)
    text = f"{invented(rng, 70)}.\n\nReleased under the MIT License. {invented(rng, 9)}!\n{invented(rng, 30)}"
    words = licences.words_of(text)
    h = licences.Words().hashes(words)
    low, cuts = licences.words_and_cuts(text.lower())
    assert licences.numbered(low) == words
    segments = licences.segments_of(len(words), *cuts)
    rows = scanner.rows(h)
    got = scanner.probabilities(rows, segments)
    like = 1 - got[:, -1]
    assert scanner.may_be(rows, segments)[like >= licences.LIKELY].all()
    for (a, b), row in zip(segments.tolist(), got):
        g = np.concatenate(licences.grams_at(licences.Words().hashes(words[a:b])))
        z = (scanner.bias + scanner.weights[np.concatenate(scanner.rows(licences.Words().hashes(words[a:b])))].sum(axis=0, dtype=float) / np.sqrt(len(g))) / scanner.temperature
        want = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert row == pytest.approx(want, abs=1e-5)
    covered = {k for a, b in segments.tolist() for k in range(a, b)}
    assert covered == set(range(len(words))) and (segments[:, 1] - segments[:, 0] <= licences.MAX_WORDS).all()


def test_very_long_texts_are_scanned_whole(scanner):
    rng = random.Random(19)
    text = invented(rng, 60_000) + "\nReleased under the MIT License.\n" + invented(rng, 60_000)
    assert families(scanner, text) == ["mit"]


# -- packing --------------------------------------------------------------------------------------------------------
def test_combinations_fill_the_window():
    got = packing.combinations_filling(8, 3)
    want = {(a, b, c) for a in range(9) for b in range(a + 1) for c in range(b + 1) if a + b + c == 8 and a > 0}
    assert {tuple(r) for r in got.tolist()} == want


def test_non_negative_least_squares_is_optimal():
    rng = np.random.default_rng(7)
    for _ in range(20):
        a, b = rng.random((8, 12)), rng.random(8) * 5
        x = packing.non_negative_least_squares(a, b)
        gradient = a.T @ (a @ x - b)
        assert (x >= 0).all() and (gradient > -1e-5).all() and abs(gradient @ x) < 1e-5


@pytest.mark.parametrize("n", [1, 3, 400])
def test_plan_uses_the_histogram_exactly(n):
    rng = np.random.default_rng(n)
    histogram = {}
    for size in rng.lognormal(6, 1.2, n).astype(int) + 1:
        for start, length in packing.cuts(int(size)):
            histogram[length] = histogram.get(length, 0) + 1
    planned = packing.plan(histogram)
    used = {}
    for lengths, times in planned:
        assert sum(lengths) <= packing.WINDOW and times > 0
        for k in lengths:
            used[k] = used.get(k, 0) + times
    assert used == histogram
    total = sum(k * c for k, c in histogram.items())
    assert sum(t for _, t in planned) <= -(-total // packing.WINDOW) + 2


def test_word_bpe_equals_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    own, library, rng = packing.WordBpe(path), Tokenizer.from_file(path), random.Random(8)
    for _ in range(800):
        s = "".join(rng.choices([*ALPHABET, "İ", "́", "Ñ", "B"], k=rng.choice([1, 5, 30])))
        assert own.encode(s) == array("I", library.encode(s, add_special_tokens=False).ids).tobytes()
    assert own.encode(None) == own.encode("") == b""


# -- BPE ------------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def byte_bpe():
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.TreeBpe(path), Tokenizer.from_file(path)


def test_tree_concatenation_equals_the_library(byte_bpe):
    own, library = byte_bpe
    rng = random.Random(9)
    for _ in range(500):
        s = "".join(rng.choices(rng.sample(ALPHABET, 6), k=rng.choice([3, 8, 30, 100])))
        want = library.encode(s, add_special_tokens=False).ids
        for leaf in (1, 3, 7, 20):
            assert own.encode(s, leaf) == want, (s, leaf)
        assert own.decode(want) == library.decode(want, skip_special_tokens=False) == s


def test_unsplit_pieces_are_joined_exactly(byte_bpe, monkeypatch):
    own, library = byte_bpe
    monkeypatch.setattr(bpe, "PIECE_BYTES", 6)
    rng = random.Random(10)
    for _ in range(300):
        s = "".join(rng.choices("abcdeinthsrgo", k=rng.randint(5, 200)))
        assert own.encode(s, 9) == library.encode(s).ids


def test_very_long_unsplit_texts(byte_bpe):
    own, library = byte_bpe
    for s in ("a" * 50_000, " " * 40_000 + "x", "é" * 20_000):
        assert own.encode(s) == library.encode(s).ids


# -- search and archives --------------------------------------------------------------------------------------------
def test_traversal_is_in_order_of_summed_distance():
    rng = np.random.default_rng(11)
    a, b = rng.random(6), rng.random(5)
    counts = np.ones(30, int)
    cells = multi_index.traverse(a, b, counts, 30)
    sums = [a[c // 5] + b[c % 5] for c in cells]
    assert sorted(cells) == list(range(30)) and sums == sorted(sums)
    assert len(multi_index.traverse(a, b, counts, 7)) == 7


@pytest.mark.parametrize("url,key", [("https://www.Example.com:443/a?b#c", "com,example)/a?b"), ("http://u@a.b.org:8080", "org,b,a:8080)/"), ("nonsense", "nonsense"), (None, ""), ("", "")])
def test_reversed_host_keys(url, key):
    assert warc.reversed_host_key(url) == key


def test_warc_records_come_back():
    page = {"page_id": 7, "url": "http://a.b/\r\nx", "record_type": "response", "refers_to": None}
    headers, payload = warc.parsed(warc.record(page, "é\r\n\r\n".encode()))
    assert payload == "é\r\n\r\n".encode() and headers["X-Page-ID"] == "7" and headers["Content-Type"].startswith("application/http")
    headers, payload = warc.parsed(warc.record(page | {"record_type": "revisit", "refers_to": 9}, b"x" * 2000))
    assert payload == b"" and headers["X-Refers-To-Page-ID"] == "9" and headers["X-Payload-Bytes"] == "2000"
    assert warc.parsed(warc.warcinfo("a.warc.gz"))[0]["WARC-Type"] == "warcinfo"
