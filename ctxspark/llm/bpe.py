"""A public byte-level BPE vocabulary, encoded through a memo of space-separated pieces."""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np
import tiktoken

from ctxspark.llm.common import MEMO_ENTRIES

#: The pre-tokenization pattern of this vocabulary, and its special token's text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = "<|endoftext|>"

_BESIDE = tuple(x for w in " \n\t\r" for x in dict.fromkeys((f" {w}", f"{w} "))) + tuple("\x0b\x0c\x1c\x1d\x1e\x1f")
_ODD = re.compile(r" \s|\s |[\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the machine keeps the public vocabulary of that name."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """ids(text) are those of the vocabulary file, as little-endian unsigned 32-bit numbers.

    No pre-token reaches over a space that stands between two other characters that are no white space, so the pieces
    between such spaces encode alone and the memo answers most. Other texts go whole to the tokenizer: those with
    other white space next to a space, and (through the file's own library) those that hold its special token."""

    def __init__(self, path: str):
        self.path = path
        letters = _byte_letters()
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        vocab = whole["model"]["vocab"] | {x["content"]: x["id"] for x in whole["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token != SPECIAL}
        self._bpe = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.sizes[i] = len(token)
        self.sizes[vocab[SPECIAL]] = len(SPECIAL)
        self._memo: dict[str, bytes] = {}
        self._own = None

    def _plain(self, text: str) -> bytes:
        return array("I", self._bpe.encode_ordinary(text)).tobytes()

    def _piece(self, piece: str) -> bytes:
        ids = self._plain(" " + piece)
        if len(self._memo) >= MEMO_ENTRIES // 2:
            self._memo.clear()
        if len(piece) < 64:
            self._memo[piece] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if SPECIAL in text:
            if self._own is None:
                from tokenizers import Tokenizer

                self._own = Tokenizer.from_file(self.path)
            return array("I", self._own.encode(text, add_special_tokens=False).ids).tobytes()
        if any(x in text for x in _BESIDE) if text.isascii() else _ODD.search(text):
            return self._plain(text)
        first, *rest = text.split(" ")
        known, make = self._memo.get, self._piece
        return b"".join([self._plain(first), *[known(p) or make(p) for p in rest]])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per process and file."""
    return Encoder(path)
