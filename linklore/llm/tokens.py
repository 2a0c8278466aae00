"""Token ids of whole texts, equal to those of a lower-casing BPE tokenizer with word ends.

Words are cut here and followed by a byte that stands for the end of a word.  Merging it to
the letter before comes first, so the rest are merges of byte strings in the order of the
tokenizer's file, which a ranked encoder does for a whole text at once.  Nothing is
remembered between texts.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from functools import lru_cache

import numpy as np

#: Beyond these a text goes through the tokenizer whole.  Below U+0250 normal form C
#: changes nothing, no rule of lower case looks at neighbours, and no token crosses
#: white space; special tokens begin with ``<|``; U+0001 ends a word here.
_USUAL = re.compile(r"[\x00-ɏ]*")
_APART = ("<|", "\x01", "\x1c", "\x1d", "\x1e", "\x1f")
_END = "\x01"


def _usual(text: str) -> bool:
    """Of a text in lower case."""
    if any(x in text for x in _APART):
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _USUAL.fullmatch(text) is not None
    return True


#: Where the tokenizer itself cuts a text: letters, single digits, the rest.
_LETTERS = "".join(c for c in map(chr, range(0x250)) if unicodedata.category(c)[0] == "L")
_DIGITS = "".join(c for c in map(chr, range(0x250)) if unicodedata.category(c)[0] == "N")
_PIECE = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[{_DIGITS}]|[^\s{_LETTERS}{_DIGITS}]+")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in files of such tokenizers, and the byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordEncoder:
    """Ids of texts, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        letters, suffix, vocab = _byte_letters(), model["end_of_word_suffix"], model["vocab"]

        def raw(token: str) -> bytes:
            end = token.endswith(suffix)
            return bytes(map(letters.__getitem__, token.removesuffix(suffix))) + _END.encode() * end

        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        # Single bytes, then a byte at the end of a word, then merges as they are ranked.
        order = [*letters, *(c + suffix for c in letters), *(a + b for a, b in merges)]
        ranks = {raw(t): i for i, t in enumerate(order)}
        if len(ranks) != len(order):
            raise ValueError("a token is made by two merges")
        self.true_id = np.array([vocab[t] for t in order], "<u4")
        self.ranked = tiktoken.Encoding("words", pat_str=rf"[^{_END}]+{_END}", mergeable_ranks=ranks, special_tokens={})

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _ranked(self, text: str) -> bytes:
        marked = _END.join([*_PIECE.findall(text), ""])
        return self.true_id[self.ranked.encode_to_numpy(marked, disallowed_special=())].tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        return [self._ranked(low) if _usual(low := t.lower()) else self._whole(t) for t in texts]


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
