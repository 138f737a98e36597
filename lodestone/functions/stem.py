"""Porter's stemmer for English words (M. F. Porter, An algorithm for suffix stripping, 1980)."""

from __future__ import annotations

#: The suffixes of the paper's steps 2 to 4 and what they become.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _kinds(stem: str) -> str:
    """A letter for each letter: v for vowels, c for consonants; y is a vowel behind a consonant."""
    out = ""
    for k, x in enumerate(stem):
        out += "v" if x in "aeiou" or (x == "y" and k > 0 and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    """How often a vowel is followed by a consonant."""
    return _kinds(stem).count("vc")


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _kinds(word)[-1] == "c"


def _short_end(word: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    return _kinds(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _past(word: str) -> str:
    """Step 1b."""
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    end = _longest(word, ("ed", "ing"))
    if end is None or "v" not in _kinds(word[: -len(end)]):
        return word
    stem = word[: -len(end)]
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if _doubled(stem) and stem[-1] not in "lsz":
        return stem[:-1]
    return stem + "e" if _measure(stem) == 1 and _short_end(stem) else stem


def porter_stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters and words of other scripts stay."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    word = _past(word)
    if word.endswith("y") and "v" in _kinds(word[:-1]):
        word = word[:-1] + "i"
    for step in (STEP_2, STEP_3):
        end = _longest(word, step)
        if end is not None and _measure(word[: -len(end)]) > 0:
            word = word[: -len(end)] + step[end]
    end = _longest(word, STEP_4)
    if end is not None and _measure(word[: -len(end)]) > 1 and (end != "ion" or word[: -len(end)].endswith(("s", "t"))):
        word = word[: -len(end)]
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word
