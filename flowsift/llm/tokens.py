"""Ids of whole texts by a byte-level BPE vocabulary file."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: The published splitting pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A character outside the ranges in which every Unicode version agrees on letters, numbers and spaces.
UNUSUAL = re.compile("[^\x00-ɏ - ]")

#: The faster library's pattern steps back through a run of white space and gives up on very long ones.
LONG_BLANK = 10_000
BLANKS = re.compile(rf"\s{{{LONG_BLANK}}}")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = sorted(set(range(256)) - set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TextEncoder:
    """The ids that the vocabulary file's own library gives.

    Texts of characters on which all Unicode versions agree go through the faster of two libraries with the same
    merges; the others go through the file's own library, whose character tables are then decisive, and so do texts with a very long
    run of white space.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet = byte_alphabet()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in token): n for token, n in spec["model"]["vocab"].items() if token not in special}
        self.fast = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.own = Tokenizer.from_file(path)
        self.own.no_truncation()
        self.own.no_padding()

    def ids(self, text: str) -> np.ndarray:
        """Ids as little-endian unsigned 32-bit integers. Special tokens spelled out in the text count as such."""
        if UNUSUAL.search(text) or (len(text) >= LONG_BLANK and BLANKS.search(text)):
            return np.array(self.own.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)


@lru_cache(maxsize=2)
def text_encoder(path: str) -> TextEncoder:
    """One encoder per Python worker and vocabulary file."""
    return TextEncoder(path)
