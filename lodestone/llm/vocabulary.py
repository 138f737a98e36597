"""Loads public tokenizer files: the byte strings of a BPE vocabulary and a fast encoder over them."""

from __future__ import annotations

import json
from functools import lru_cache

import tiktoken

#: Fixed value: the splitting pattern of byte-level BPE vocabularies of this kind.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A byte that UTF-8 never uses stands for the end of a word.
WORD_END = b"\xff"


def _bytes_of_letters() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies: a byte that prints stands for itself, the others follow from 256 on."""
    own = [b for b in range(256) if chr(b).isprintable() and b != 0x20]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=4)
def ranks(path: str, end_of_word: str = "") -> tuple[dict[bytes, int], dict[str, int]]:
    """(byte string -> id, added token -> id) of a tokenizers JSON file whose ids follow the order of its merges.

    Ids then say which merge comes first, as the encoder needs; another file is refused.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    vocab, last = spec["model"]["vocab"], -1
    for m in spec["model"]["merges"]:
        made = vocab.get("".join(m.split(" ") if isinstance(m, str) else m), -1)
        if made <= last:
            raise ValueError(f"{path}: ids don't follow the merges")
        last = made
    letters, out = _bytes_of_letters(), {}
    for token, i in vocab.items():
        if token in added:
            continue
        ends = bool(end_of_word) and token.endswith(end_of_word)
        core = token[: -len(end_of_word)] if ends else token
        out[bytes(letters[c] for c in core) + (WORD_END if ends else b"")] = i
    return out, added


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str, end_of_word: str = "") -> tiktoken.Encoding:
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks(path, end_of_word)[0], special_tokens={})
