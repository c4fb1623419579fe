"""BPE with word ends, from a vocabulary file: a priority queue of merges over a doubly linked list of symbols."""

from __future__ import annotations

import gc
import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer
from tokenizers.pre_tokenizers import Split

from tessel.llm.byte_bpe import byte_letters
from tessel.runtime import ship_package

#: Words, and chunks between white space, that are kept; a longer one than CHARS isn't.
WORDS, CHUNKS, CHARS = 400_000, 300_000, 48
_ODD_SPACE = regex.compile(r"[\x1c-\x1f]")
#: With other characters, the library itself normalizes and splits: Unicode versions differ there.
_USUAL = regex.compile(r"[\x00-\u024f]*")


class Merges:
    """The merges of a vocabulary by rank: pair (left << 32 | right) to rank, and what each rank joins and makes."""

    def __init__(self, merges: list[tuple[int, int, int]]) -> None:
        self.left, self.right, self.made = (list(x) for x in zip(*merges)) if merges else ([], [], [])
        self.rank = {a << 32 | b: rank for rank, (a, b, _) in enumerate(merges)}

    def merge(self, symbols: list[int]) -> list[int]:
        """symbols after all merges. The lowest rank goes first, of equals the leftmost. An entry of the queue, rank << 32
        | place, is stale, and skipped, if either symbol has changed since it was made."""
        n = len(symbols)
        if n < 2:
            return symbols
        rank_of, left, right, made_by = self.rank.get, self.left, self.right, self.made
        queue = []
        i, one = 0, symbols[0]
        for two in symbols[1:]:
            rank = rank_of(one << 32 | two)
            if rank is not None:
                queue.append(rank << 32 | i)
            i, one = i + 1, two
        if not queue:
            return symbols
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        symbols.append(-1)
        heapify(queue)
        while queue:
            entry = heappop(queue)
            i, rank = entry & 0xFFFFFFFF, entry >> 32
            j = after[i]
            if symbols[i] != left[rank] or symbols[j] != right[rank]:
                continue
            made = made_by[rank]
            symbols[i], symbols[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                rank = rank_of(made << 32 | symbols[k])
                if rank is not None:
                    heappush(queue, rank << 32 | i)
            h = before[i]
            if h >= 0:
                rank = rank_of(symbols[h] << 32 | made)
                if rank is not None:
                    heappush(queue, rank << 32 | h)
        return [s for s in symbols if s >= 0]


class _Kept(dict):
    """What make(key) gave, for short keys, at most `most` of them: when half are full, the older half goes, less what
    was asked for since."""

    def __init__(self, make, most: int) -> None:
        super().__init__()
        self.make, self.half, self.older = make, most // 2, {}

    def __missing__(self, key: str):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > CHARS:
                return value
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class WordBpe:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        self.vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.strings = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = Merges([(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in pairs])
        self.numbers = {i: str(i) for i in self.strings}
        letters = {b: c for c, b in byte_letters().items()}
        self.inner = [self.vocab.get(letters[b], -1) for b in range(256)]
        self.last = [self.vocab.get(letters[b] + suffix, -1) for b in range(256)]
        pattern = next(x["pattern"]["Regex"] for x in file["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.pattern = regex.compile(pattern)
        self.library_split = Split(Regex(pattern), "removed", invert=True)
        self.library_normal = Tokenizer.from_file(path).normalizer
        self.words = _Kept(self._word, WORDS)
        self.chunks = _Kept(self._chunk, CHUNKS)
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")

    def _word(self, word: str) -> tuple[str, str, int]:
        """Of a word: ids and strings, joined by spaces, and how many."""
        data = word.encode("utf-8", "surrogatepass")
        symbols = [self.inner[b] for b in data]
        symbols[-1] = self.last[data[-1]]
        if -1 in symbols:
            symbols = [s for s in symbols if s >= 0]
        ids = self.merges.merge(symbols)
        return " ".join([self.numbers[i] for i in ids]), " ".join([self.strings[i] for i in ids]), len(ids)

    def _chunk(self, chunk: str) -> tuple[str, str, int]:
        """The same of a run without white space, which may hold several words."""
        if chunk.isascii():
            chunk = chunk.lower()
            if chunk.isalpha():
                return self.words[chunk]
            words = self.pattern.findall(chunk)
        elif _USUAL.fullmatch(chunk):
            words = self.pattern.findall(unicodedata.normalize("NFC", chunk).lower())
        else:
            words = [w for w, _ in self.library_split.pre_tokenize_str(self.library_normal.normalize_str(chunk))]
        return _joined([self.words[w] for w in words])

    def _plain(self, text: str) -> list[tuple[str, str, int]]:
        runs = regex.split(r"\s+", text) if _ODD_SPACE.search(text) else text.split()
        chunks = self.chunks
        return [chunks[c] for c in runs if c]

    def encode(self, text: str) -> tuple[str, str, int]:
        """(ids joined by spaces, what they decode to, how many). Strings of special tokens stand for these; without a
        decoder in the file, decoding joins vocabulary strings by one space."""
        if "<|" in text:
            parts = self.split.split(text)
            return _joined([x for i, part in enumerate(parts) for x in ([(str(self.special[part]), part, 1)] if i % 2 else self._plain(part))])
        return _joined(self._plain(text))


def _joined(parts: list[tuple[str, str, int]]) -> tuple[str, str, int]:
    if len(parts) == 1:
        return parts[0]
    ids, strings, counts = zip(*parts) if parts else ((), (), ())
    if 0 in counts:
        return _joined([x for x in parts if x[2]])
    return " ".join(ids), " ".join(strings), sum(counts)


@cache
def load(path: str) -> WordBpe:
    """The tokenizer of a worker. Nothing here forms cycles, so the collector walks the tables and caches less often."""
    bpe = WordBpe(path)
    gc.freeze()
    gc.set_threshold(100_000, 20, 100)
    return bpe


def _map(documents: DataFrame, tokenizer: str, id_col: str, text_col: str, make, schema: str) -> DataFrame:
    ship_package(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for batch in batches:
            columns = make([bpe.encode(text or "") for text in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(c for _, c in columns)], names=["doc_id", *(n for n, _ in columns)])

    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id long, {schema}")


def encode_decode(documents: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) of each row; null texts are empty, ids and other columns are free, an empty table stays so."""

    def make(got):
        return [("ids", pa.array([[int(i) for i in x[0].split()] for x in got], pa.list_(pa.int32()))), ("decoded", pa.array([x[1] for x in got], pa.string()))]

    return _map(documents, tokenizer, id_col, text_col, make, "ids array<int>, decoded string")


def encode_digest(documents: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row, as encode_decode() has them."""

    def sha(x: str) -> str:
        return hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()

    def make(got):
        return [("n_tokens", pa.array([x[2] for x in got], pa.int64())), ("ids_sha256", pa.array([sha(x[0]) for x in got], pa.string())), ("decoded_sha256", pa.array([sha(x[1]) for x in got], pa.string()))]

    return _map(documents, tokenizer, id_col, text_col, make, "n_tokens long, ids_sha256 string, decoded_sha256 string")
