"""Repeated passages by compacting a De Bruijn graph over words.

A window of `span` words is an edge of the graph, from the node of its first span - 1 words to that of its last ones. The
windows of a text that follow one another and share their k-mer of the smallest hash (leftmost of equals) are held as one
longer edge, known by that k-mer and the hash of all its words; equal windows share that k-mer wherever they occur. Where
several different such edges have one k-mer, that is, where the graph may branch inside of them, they are taken apart into
their windows, wherever they occur in their first text. An edge is repeated if a text with a larger id has it, too; its
source is where it starts in the text with the smallest id.

Repeated edges are compacted: where a node has one repeated edge in and one out that follow each other in one source text,
both belong to one path, and rounds of joins (each edge takes its predecessor's head) give every edge the head of its
nonbranching path. Occurrences of a path's edges at one shift are one long span. Spans are verified on the words at their
source coordinates, by 128-bit digests, before anything is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.texthash import Words, chunks, mix, run_hash
from tessel.runtime import cut, drop_table, ids_side, ship_package


@dataclass(frozen=True)
class SubstringParams:
    """span: words in a window. k: words of the k-mer by which windows are held together."""

    span: int = 50
    k: int = 10


#: Low bits of a sort key that hold a word's place; a text has fewer words than 2**28.
_AT = np.uint64((1 << 28) - 1)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if width > have else out


def edges(words: Words, span: int, k: int) -> tuple[np.ndarray, ...]:
    """(first window, windows, hash of the k-mer, hash of all words, of the first and of the last node) of each edge."""
    n = len(words.hash)
    if n < span:
        none = np.zeros(0, dtype=np.int64)
        return (none, none, *[none.view(np.uint64)] * 4)
    prefix, inverse = words.runs()
    edge = words.windows(k)
    at = (sliding_min((edge & ~_AT) | np.arange(len(edge), dtype=np.uint64), span - k + 1) & _AT).astype(np.int64)
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    inside = np.flatnonzero(text[: n - span + 1] == text[span - 1 :])
    at = at[inside]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (inside[1:] != inside[:-1] + 1)])) if len(at) else np.zeros(0, dtype=np.int64)
    lo = inside[new]
    count = np.diff(np.concatenate([new, [len(at)]]))
    node = words.windows(span - 1)
    return lo, count, edge[at[new]], mix(run_hash(prefix, inverse, lo, lo + count + span - 1) + count.astype(np.uint64)), node[lo], node[lo + count]


_EDGES = "id long, n long, digest binary, lo array<int>, c array<int>, kmer array<long>, path array<long>, u array<long>, v array<long>"


def _digest_of(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _edges(p: SubstringParams):
    """Each text's edges, with the number and a digest of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch.column(1).to_pylist()):
                words = Words(texts)
                lo, *rest = edges(words, p.span, p.k)
                of = np.searchsorted(lo, words.first).astype(np.int32)
                rel = lo - np.repeat(words.first[:-1], np.diff(of))
                lists = [pa.ListArray.from_arrays(pa.array(of), pa.array(x)) for x in (rel.astype(np.int32), rest[0].astype(np.int32), *(x.view(np.int64) for x in rest[1:]))]
                whole = pa.array([_digest_of(t.split()) for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(np.diff(words.first).astype(np.int64)), whole, *lists],
                    names=["id", "n", "digest", "lo", "c", "kmer", "path", "u", "v"],
                )

    return run


def _windows(span: int):
    """(id, lo, u, v) of the windows in the ranges of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges = batch.column(2).to_pylist()
            for at, texts in chunks(batch.column(1).to_pylist()):
                words = Words(texts)
                node = words.windows(span - 1).view(np.int64)
                starts, sizes = [], [0]
                for own in ranges[at : at + len(texts)]:
                    parts = [np.arange(r["lo"], r["lo"] + r["c"]) for r in own]
                    starts.append(np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.int64))
                    sizes.append(sizes[-1] + len(starts[-1]))
                off, rel = pa.array(sizes, type=pa.int32()), np.concatenate(starts)
                i = rel + np.repeat(words.first[:-1], np.diff(sizes))
                lists = [pa.ListArray.from_arrays(off, pa.array(x)) for x in (rel.astype(np.int32), node[i], node[i + 1])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *lists], names=["id", "lo", "u", "v"])

    return run


def _sources(span: int):
    """(id, lo, c, digest) of the spans asked for of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(1)):
                words, asked = (text.as_py() or "").encode("utf-8", "surrogatepass").split(), batch.column(2)[i].as_py()
                lo, c = [r["lo"] for r in asked], [r["c"] for r in asked]
                got = [_digest_of(words[a : a + n + span - 1]) for a, n in zip(lo, c, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[i], len(lo)), pa.array(lo, pa.int32()), pa.array(c, pa.int32()), pa.array(got, pa.binary())], names=["id", "lo", "c", "digest"])

    return run


def compact(repeated: DataFrame) -> DataFrame:
    """(first, lo, c, head) of each repeated edge (first, lo, c, u, v): where its nonbranching path starts.

    (first, lo) is the edge's source, c its windows. Nodes with one edge in and one out join these, if they follow each
    other there; then each round doubles the stretch by which an edge sees back, so there are log2 of the longest path.
    """
    ends = repeated.select(F.col("v").alias("node"), F.lit(1).alias("in"), "first", "lo", "c").union(repeated.select(F.col("u").alias("node"), F.lit(0).alias("in"), "first", "lo", "c"))
    is_in = F.col("in") == 1
    side = lambda cond: F.max(F.when(cond, F.struct("first", "lo", "c")))
    node = ends.groupBy("node").agg(F.sum("in").alias("ins"), F.count("*").alias("all"), side(is_in).alias("e"), side(~is_in).alias("f"))
    links = node.where("ins = 1 AND all = 2 AND e.first = f.first AND e.lo + e.c = f.lo").select(F.col("f.first").alias("first"), F.col("f.lo").alias("lo"), F.col("e.lo").alias("head"))
    now = cut(repeated.select("first", "lo", "c").join(links, ["first", "lo"], "left").select("first", "lo", "c", F.coalesce("head", "lo").alias("head"), F.lit(True).alias("moved")), "ss-heads")
    while not now.where("moved AND head < lo").isEmpty():
        seen = now.where("head < lo").select("first", F.col("lo").alias("head"), F.col("head").alias("before"))
        step = now.join(seen, ["first", "head"], "left").select("first", "lo", "c", F.coalesce("before", "head").alias("head"), F.col("before").isNotNull().alias("moved"))
        after = cut(step, "ss-heads")
        drop_table(now)
        now = after
    return now.select("first", "lo", "c", "head")


def kept_words(text: bytes, ranges: list[dict] | None, span: int) -> tuple[list[bytes], int]:
    """The words that stay, and how many there were. Each range is held against its words: if they aren't those of its
    source, it takes nothing away."""
    words = text.split()
    ranges = [r for r in ranges or () if _digest_of(words[r["lo"] : r["lo"] + r["c"] + span - 1]) == r["digest"]]
    if not ranges:
        return words, len(words)
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(gone, [r["lo"] for r in ranges], 1)
    np.add.at(gone, [min(r["lo"] + r["c"] + span - 1, len(words)) for r in ranges], -1)
    stay = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
    return [words[i] for i in stay], len(words)


def repeated_ranges(documents: DataFrame, params: SubstringParams | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ranges): windows of each text that also start in a text with a smaller id, as (lo, c, digest): first word,
    windows, and a digest of the words at the source."""
    p = params or SubstringParams()
    ship_package(documents.sparkSession)
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    found = cut(docs.mapInArrow(_edges(p), _EDGES).where(f"n >= {p.span}"), "ss-edges")
    same = cut(found.groupBy("digest", "n").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("last > rep"), "ss-same")
    copies = cut(found.select("id", "digest", "n").join(same, ["digest", "n"]).where("id > rep").select("id", "n", "digest").distinct(), "ss-copies")
    one = found.join(ids_side(copies.select("id").distinct()), "id", "left_anti")
    edge = one.select("id", F.explode(F.arrays_zip("lo", "c", "kmer", "path", "u", "v")).alias("x")).select("id", "x.*")
    ends = [F.min(x).alias(x) for x in ("u", "v")]  # an edge's words have its nodes, so these are equal in a group
    graph = cut(edge.groupBy("kmer", "path").agg(F.min(F.struct("id", "lo", "c")).alias("at"), F.max("id").alias("last"), F.count("*").alias("times"), *ends), "ss-graph")
    branches = graph.groupBy("kmer").agg(F.count("*").alias("ways")).where("ways > 1").select("kmer")
    open_ = cut(graph.join(branches, "kmer").select("kmer", "path", "at.id", "at.lo", "at.c", "times"), "ss-open")
    often = open_.where("times > 1").select("kmer", "path", "id").distinct()
    again = edge.join(ids_side(often), ["kmer", "path", "id"]).select("id", "lo", "c")
    apart = open_.where("times = 1").select("id", "lo", "c").union(again).groupBy("id").agg(F.collect_list(F.struct("lo", "c")).alias("ranges"))
    apart = cut(apart, "ss-apart")
    text = docs.join(ids_side(apart.select("id")), "id", "left_semi").join(apart, "id").select("id", "text", "ranges")
    windows = text.mapInArrow(_windows(p.span), "id long, lo array<int>, u array<long>, v array<long>")
    window = cut(windows.select("id", F.explode(F.arrays_zip("lo", "u", "v")).alias("x")).select("id", "x.*"), "ss-windows")
    first = window.groupBy("u", "v").agg(F.min(F.struct("id", "lo")).alias("at"), F.max("id").alias("last")).where("last > at.id")
    first = cut(first.select("u", "v", F.col("at.id").alias("first"), F.col("at.lo").alias("flo")), "ss-first")

    long = graph.where("last > at.id").join(open_.select("kmer", "path").distinct(), ["kmer", "path"], "left_anti")
    source = [F.col("first"), F.col("flo").alias("lo")]
    heads = cut(compact(long.select(F.col("at.id").alias("first"), "at.lo", "at.c", "u", "v").union(first.select(*source, F.lit(1).alias("c"), "u", "v"))), "ss-paths")
    place = heads.select("first", F.col("lo").alias("flo"), "head")
    seen = graph.where("last > at.id").select("kmer", "path", F.col("at.id").alias("first"), F.col("at.lo").alias("flo"))
    seen = cut(seen.join(place, ["first", "flo"], "left").withColumn("head", F.coalesce("head", "flo")), "ss-seen")
    whole = edge.join(seen, ["kmer", "path"]).where("id > first").select("id", "lo", "c", "first", "flo", "head")
    single = window.join(first.join(place, ["first", "flo"]), ["u", "v"]).where("id > first").select("id", "lo", F.lit(1).alias("c"), "first", "flo", "head")
    spans = whole.union(single).withColumn("shift", F.col("lo") - F.col("flo")).groupBy("id", "first", "head", "shift")
    spans = spans.agg(F.min("lo").alias("lo"), (F.max(F.col("lo") + F.col("c")) - F.min("lo")).cast("int").alias("c"), F.sum("c").alias("have"), F.collect_set(F.struct("lo", "c")).alias("parts"))
    part = F.when(F.col("have") == F.col("c"), F.array(F.struct("lo", "c"))).otherwise(F.col("parts"))
    spans = cut(spans.select("id", "first", "shift", F.explode(part).alias("x")).select("id", "x.lo", "x.c", "first", (F.col("x.lo") - F.col("shift")).alias("flo")), "ss-spans")

    asked = cut(spans.groupBy("first").agg(F.collect_set(F.struct(F.col("flo").alias("lo"), "c")).alias("ranges")).withColumnRenamed("first", "id"), "ss-asked")
    text = docs.join(ids_side(asked.select("id")), "id", "left_semi").join(asked, "id").select("id", "text", "ranges")
    words = cut(text.mapInArrow(_sources(p.span), "id long, lo int, c int, digest binary").select(F.col("id").alias("first"), F.col("lo").alias("flo"), "c", "digest").distinct(), "ss-words")
    checked = spans.join(ids_side(words), ["first", "flo", "c"]).select("id", "lo", "c", "digest")
    all_words = copies.select("id", F.lit(0).alias("lo"), (F.col("n") - (p.span - 1)).cast("int").alias("c"), "digest")
    out = cut(checked.union(all_words).groupBy("id").agg(F.collect_list(F.struct("lo", "c", "digest")).alias("ranges")), "ss-ranges")
    for t in (found, same, copies, graph, open_, apart, window, first, heads, seen, spans, asked, words):
        drop_table(t)
    return out


def _with_ranges(documents: DataFrame, ranges: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(row, id, text, ranges) of the rows that have some, and (row, id, text) of the others; row is the whole row as a
    struct, so that no name clashes. Only texts that have some are shuffled while their ids are few."""
    name = lambda c: F.col("`" + c.replace("`", "``") + "`")
    rows = documents.select(F.struct(*map(name, documents.columns)).alias("row"), name(id_col).cast("long").alias("id"), name(text_col).alias("text"))
    ids = ids_side(ranges.select("id"))
    return rows.join(ids, "id", "left_semi").join(ranges, "id").select("row", "id", "text", "ranges"), rows.join(ids, "id", "left_anti").select("row", "id", "text")


def _digest(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, sha = [], [], []
            for text, ranges in zip(batch.column(1), batch.column(2), strict=True):
                words, total = kept_words((text.as_py() or "").encode("utf-8", "surrogatepass"), ranges.as_py(), span)
                n.append(total)
                gone.append(total - len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def substring_digest(documents: DataFrame, params: SubstringParams | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row; see drop_repeats() for what is removed."""
    p = params or SubstringParams()
    docs = documents.select("doc_id", "text")
    ranges = repeated_ranges(docs, p)
    some, none = _with_ranges(docs, ranges, "doc_id", "text")
    every = some.select("id", "text", "ranges").union(none.select("id", "text", F.lit(None).cast(ranges.schema["ranges"].dataType)))
    return every.mapInArrow(_digest(p.span), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def drop_repeats(documents: DataFrame, params: SubstringParams | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """documents without the words that a window covers which also starts in a text with a smaller id.

    A text that loses words is its other words joined by one space; another text stays as it is. Null texts have no
    words. Rows with the same id are one document and never repeat one another; where their texts differ, a row loses only
    what it has at the places found. One without an id loses nothing. Other columns stay, whatever their names; an empty
    table gives an empty one.
    """
    p = params or SubstringParams()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [b" ".join(kept_words((text.as_py() or "").encode("utf-8", "surrogatepass"), ranges.as_py(), p.span)[0]).decode("utf-8", "surrogatepass") for text, ranges in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["row", "text"])

    some, none = _with_ranges(documents, repeated_ranges(documents, p, id_col, text_col), id_col, text_col)
    same = none.select("row", "text")
    less = some.select("row", "text", "ranges").mapInArrow(run, same.schema)
    return same.union(less).select(*((F.col("text") if c == text_col else F.col("row").getField(c)).alias(c) for c in documents.columns))
