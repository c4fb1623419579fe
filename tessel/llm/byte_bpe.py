"""Token ids of a byte-level BPE vocabulary file, with a cache of chunks between spaces.

A space that stands between two characters other than white space always begins a token, so what lies between such
spaces has the same ids anywhere; texts with other white space beside a space are encoded whole.
"""

from __future__ import annotations

import json
import re
from functools import cache

import numpy as np

#: The pattern by which this kind of vocabulary splits texts; a fixed value of the public tokenizer.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A chunk of more characters isn't kept, and of more chunks than this none is kept beyond.
CHUNK_CHARS, CHUNKS = 48, 120_000
_ODD = re.compile(r" \s|\s $")


def byte_letters() -> dict[str, int]:
    """The letters by which such files write bytes: printable ones as they are, the rest in order from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Chunks(dict):
    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        ids = np.array(self.encode(f" {chunk}"), dtype="<u4").tobytes()
        if len(chunk) <= CHUNK_CHARS:
            if len(self) >= CHUNKS:
                self.clear()
            self[chunk] = ids
        return ids


class ByteBpe:
    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in self.special}
        self.encode = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.chunks = _Chunks(self.encode)
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _plain(self, text: str) -> bytes:
        if _ODD.search(text):
            return np.array(self.encode(text), dtype="<u4").tobytes()
        first, *rest = text.split(" ")
        return np.array(self.encode(first), dtype="<u4").tobytes() + b"".join(map(self.chunks.__getitem__, rest))

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids; the strings of special tokens stand for these."""
        if not self.split or "<" not in text:
            return self._plain(text)
        parts = self.split.split(text)
        return b"".join(np.array([self.special[x]], dtype="<u4").tobytes() if i % 2 else self._plain(x) for i, x in enumerate(parts) if x)


@cache
def load(path: str) -> ByteBpe:
    return ByteBpe(path)
