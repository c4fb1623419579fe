"""Hashes of words and of runs of words, for many texts at once in numpy.

Words are maximal runs of characters other than U+0020 and U+0009 to U+000D. A run of words has the hash
sum(word_hash[i] * B**i) mod 2**64, taken from prefix sums, so that any window of any length costs the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEP = np.zeros(256, dtype=bool)
_SEP[[32, 9, 10, 11, 12, 13]] = True
_BARE = np.arange(256, dtype=np.uint8)
_BARE[[b for b in range(128) if not chr(b).isalnum()]] = 32
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_pow: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Texts are taken together up to so many bytes; a longer text is taken alone.
CHUNK_BYTES = 1 << 18
#: Tables of up to so many powers stay in memory (16 bytes each); longer texts have theirs made anew.
KEPT_POWERS = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every bit depends on every other (splitmix64's finisher)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0 ... base**(n-1) and their inverses mod 2**64; base is odd."""
    have = _pow.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = (out[0], out[1])
        if size <= KEPT_POWERS:
            _pow[base] = have
    return have


def run_hash(prefix: np.ndarray, inverse: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (prefix[end] - prefix[start]) * inverse[start]


class Words:
    """Words of several texts: hash[i] of word i; text t has words first[t] to first[t + 1] - 1."""

    def __init__(self, texts: list[bytes], lower: bool = False, bare: bool = False) -> None:
        """lower: A-Z are lower-cased. bare: other ASCII characters than letters and digits part words, too, and each
        is hashed as a space."""
        sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        buf = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
        if lower:
            buf = _LOWER[buf]
        if bare:
            buf = _BARE[buf]
        self.buf = buf
        sep = _SEP[buf]
        change = np.flatnonzero(sep[1:] != sep[:-1]) + 1
        if len(buf) and not sep[0]:
            change = np.concatenate([np.zeros(1, dtype=change.dtype), change])
        self.start, self.end = change[0::2], change[1::2]
        if len(self.end) < len(self.start):
            self.end = np.append(self.end, len(buf))
        at = np.concatenate([[0], np.cumsum(sizes)])
        self.first = np.searchsorted(self.start, at)
        power, inverse = powers(_BYTE_BASE, len(buf) + 1)
        prefix = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[buf] * power[: len(buf)], out=prefix[1:])
        self.prefix, self.inverse = prefix, inverse
        self.hash = mix(run_hash(prefix, inverse, self.start, self.end) + (self.end - self.start).astype(np.uint64))

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """Prefix sums and inverse powers for run_hash() over words."""
        n = len(self.hash)
        power, inverse = powers(_WORD_BASE, n + 1)
        prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.hash * power[:n], out=prefix[1:])
        return prefix, inverse

    def windows(self, n: int) -> np.ndarray:
        """Mixed hash of the n words from each word on; those that leave the text are there too and not to be used."""
        if len(self.hash) < n:
            return np.zeros(0, dtype=np.uint64)
        prefix, inverse = self.runs()
        i = np.arange(len(self.hash) - n + 1)
        return mix(run_hash(prefix, inverse, i, i + n) + np.uint64(n))


def chunks(texts: list[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, the texts as bytes); a null is empty."""
    held: list[bytes] = []
    size, first = 0, 0
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass") if t else b""
        if held and size + len(b) > limit:
            yield first, held
            held, size, first = [], 0, i
        held.append(b)
        size += len(b) + 1
    if held:
        yield first, held
