"""Near-duplicate documents by MinHash with tensored banding.

A document is the set of its distinct word shingles. Two small collections of half keys, A and B, each half key made of
a few minimum hashes, stand for |A| x |B| tables: the key of table (i, j) is the pair (A[i], B[j]). So 12 + 12 half keys
of 3 minima (72 minima) give 144 tables with 6 minima each, which plain banding would need 864 for. A pair with
similarity 0.8 shares no table with a probability of about 2 * (1 - 0.8**3)**12 = 0.0004, with 0.9 of 1e-7.

A row travels once per half key of A and carries B; its tables are formed after that shuffle. Texts with the same set
stand for one another, and only the smallest id takes part. Within a table each document is compared with the smallest
one; where that leaves more than one component in a table, the pairs across components are compared too, so no link
between components is lost to the choice of the centre. Links are confirmed on the full sets of 64-bit shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.llm.components import components
from tessel.llm.texthash import Words, chunks, mix
from tessel.runtime import cut, drop_table, ids_side, ship_package


@dataclass(frozen=True)
class NearDupParams:
    """shingle: words in a shingle. percent: least similarity, in hundredths. a, b: half keys in the collections.
    rows: minima in a half key. lower: whether A-Z are lower-cased. hot_rows, hot_keys: a half key with over hot_rows
    rows, and over one row in hot_keys of all, is dealt out over several tasks, so there are at most hot_keys of them."""

    shingle: int = 5
    percent: int = 80
    a: int = 12
    b: int = 12
    rows: int = 3
    lower: bool = True
    seed: int = 7
    hot_rows: int = 20_000
    hot_keys: int = 2_000


def shingles(texts: list[bytes], n: int, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): those of text t are first[t] to first[t + 1] - 1, distinct and sorted."""
    words = Words(texts, lower)
    prefix, inverse = words.runs()
    of_n = words.windows(n)
    parts, sizes = [], np.zeros(len(texts), dtype=np.int64)
    for t in range(len(texts)):
        lo, hi = words.first[t], words.first[t + 1]
        if hi - lo >= n:
            got = np.sort(of_n[lo : hi - n + 1])
            got = got[np.concatenate([[True], got[1:] != got[:-1]])]
        elif hi > lo:
            got = mix((prefix[hi : hi + 1] - prefix[lo]) * inverse[lo] + np.uint64(hi - lo))
        else:
            continue
        parts.append(got)
        sizes[t] = len(got)
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def minima(hashes: np.ndarray, first: np.ndarray, count: int, seed: int) -> np.ndarray:
    """count minimum hashes (32 bits) of each non-empty text, as rows."""
    rng = np.random.default_rng(seed)
    factor = rng.integers(0, 2**31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    flip = rng.integers(0, 2**32, count, dtype=np.uint32)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    at = first[:-1][np.diff(first) > 0]
    out = np.empty((len(at), count), dtype=np.uint32)
    for k in range(count):
        out[:, k] = np.minimum.reduceat((x ^ flip[k]) * factor[k], at) if len(at) else 0
    return out


def _half_keys(low: np.ndarray, rows: int) -> np.ndarray:
    key = np.zeros((len(low), low.shape[1] // rows), dtype=np.uint64)
    for r in range(rows):
        key = mix(key + low[:, r::rows].astype(np.uint64) + np.uint64(r + 1))
    return mix(key + np.arange(key.shape[1], dtype=np.uint64))


def _lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values))


_SIG = "id long, n long, s1 long, s2 long, a array<long>, b array<int>, parity array<long>"
#: Bits of the parity sketch: bit k says whether an odd number of a set's hashes fall on k. Sets A and B differ in at
#: least as many members as their sketches differ in bits, so pairs that differ in too many can't be similar enough.
_PARITY = 512


def _parity(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    key = owner * _PARITY + (hashes & np.uint64(_PARITY - 1)).astype(np.int64)
    odd = np.bincount(key, minlength=(len(first) - 1) * _PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _signatures(p: NearDupParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch.column(1).to_pylist()):
                ids = batch.column(0).slice(at, len(texts))
                hashes, first = shingles(texts, p.shingle, p.lower)
                n = np.diff(first)
                some = np.flatnonzero(n)
                low = minima(hashes, first, (p.a + p.b) * p.rows, p.seed)
                a = _half_keys(low[:, : p.a * p.rows], p.rows)
                b = _half_keys(low[:, p.a * p.rows :], p.rows)
                sums = np.zeros((2, len(texts)), dtype=np.uint64)
                if len(some):
                    sums[0, some] = np.add.reduceat(mix(hashes), first[some])
                    sums[1, some] = np.add.reduceat(mix(hashes ^ np.uint64(0x5BD1E995C6A4A793)), first[some])
                of = np.concatenate([[0], np.cumsum(n > 0)])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(n),
                        pa.array(sums[0].view(np.int64)),
                        pa.array(sums[1].view(np.int64)),
                        _lists(a.reshape(-1).view(np.int64), of * p.a),
                        _lists((b.reshape(-1) & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32), of * p.b),
                        _lists(_parity(hashes, first), np.arange(len(texts) + 1) * (_PARITY // 64)),
                    ],
                    names=["id", "n", "s1", "s2", "a", "b", "parity"],
                )

    return run


def _sets(p: NearDupParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch.column(1).to_pylist()):
                hashes, first = shingles(texts, p.shingle, p.lower)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), _lists(hashes.view(np.int64), first)], names=["id", "set"])

    return run


def _same_key(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("id")


def _members(reps: DataFrame, p: NearDupParams) -> DataFrame:
    """(bucket, place, id, n, center) for each table key that at least two documents have; center is the smallest there,
    place = i * |B| + j tells the table (i, j)."""
    half = reps.select("id", "n", "b", F.posexplode("a").alias("i", "ka"))
    total = reps.count() * p.a
    limit = max(p.hot_rows, total // p.hot_keys)
    hot = half.groupBy("ka").agg(F.count("*").alias("rows")).where(F.col("rows") > limit)
    hot = cut(hot.select("ka", (F.floor(F.col("rows") / limit) + 1).alias("salts")), "nd-hot")
    is_hot = hot.count() > 0
    if is_hot:
        half = half.join(F.broadcast(hot), "ka", "left")
        half = half.select("id", "n", "b", "i", "ka", F.coalesce(F.pmod(F.xxhash64("id"), "salts") + 1, F.lit(0)).alias("salt"))
    else:
        half = half.withColumn("salt", F.lit(0).cast("long"))
    # a constant salt among the keys would hide from the planner that rows are in place already, and all tables be shuffled
    by = ["ka", "salt"] if is_hot else ["ka"]
    full = half.repartition(*by).select("id", "n", "i", "ka", "salt", F.posexplode("b").alias("j", "kb"))

    def shared(df: DataFrame, *keys: str) -> DataFrame:
        w = _same_key(*keys)
        return df.withColumns({"before": F.lag("id").over(w), "after": F.lead("id").over(w), "center": F.first("id").over(w)})

    out = [F.xxhash64("ka", "j", "kb").alias("bucket"), (F.col("i") * p.b + F.col("j")).alias("place"), "id", "n", "center"]
    two: Column = F.col("before").isNotNull() | F.col("after").isNotNull()
    first = shared(full, *by, "j", "kb")
    if not is_hot:
        return first.where(two).select(out)
    first = cut(first.where(two | (F.col("salt") > 0)).select("i", "ka", "salt", "j", "kb", "id", "n", "center", two.alias("two")), "nd-first")
    heads = shared(first.where("salt > 0 AND id = center").select("i", "ka", "j", "kb", "id", "n"), "ka", "j", "kb")
    return first.where("two").select(out).union(heads.where(two).select(out))


def _across(open_: DataFrame, reps: DataFrame, p: NearDupParams) -> DataFrame:
    """Pairs (u, v) of different components that share a table, once each, less those whose sketches rule them out.

    A pair is taken in the first table that it shares: the first i with equal A[i] and the first j with equal B[j].
    """
    sketch = [F.get("parity", F.lit(k)).alias(f"p{k}") for k in range(_PARITY // 64)]
    sketch += [F.hash(F.get("a", F.lit(k))).alias(f"a{k}") for k in range(p.a)] + [F.get("b", F.lit(k)).alias(f"b{k}") for k in range(p.b)]
    rows = open_.join(reps.select("id", *sketch), "id")
    mine, other = rows.alias("x"), rows.alias("y")
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))

    def first(name: str, count: int) -> Column:
        return F.coalesce(*(F.when(x(f"{name}{k}") == y(f"{name}{k}"), F.lit(k)) for k in range(count)))

    differ = sum((F.bit_count(x(f"p{k}").bitwiseXOR(y(f"p{k}"))) for k in range(1, _PARITY // 64)), F.bit_count(x("p0").bitwiseXOR(y("p0"))))
    near = (x("n") * 100 >= y("n") * p.percent) & (y("n") * 100 >= x("n") * p.percent) & (differ * (100 + p.percent) <= (x("n") + y("n")) * (100 - p.percent))
    once = first("a", p.a) * p.b + first("b", p.b) == x("place")
    return mine.join(other, (x("bucket") == y("bucket")) & (x("id") > y("id")) & (x("comp") != y("comp")) & near & once).select(x("id").alias("u"), y("id").alias("v"))


def _confirmed(pairs: DataFrame, docs: DataFrame, p: NearDupParams) -> DataFrame:
    """Those of pairs (u, v) that are similar enough."""
    ids = cut(pairs.select(F.col("u").alias("id")).union(pairs.select(F.col("v").alias("id"))).distinct(), "nd-ids")
    sets = docs.join(ids_side(ids), "id", "left_semi").select("id", "text").mapInArrow(_sets(p), "id long, set array<long>")
    left = pairs.join(sets.select(F.col("id").alias("u"), F.col("set").alias("su")), "u")
    both = left.join(sets.select(F.col("id").alias("v"), F.col("set").alias("sv")), "v")
    near = both.select("u", "v", (F.size("su") + F.size("sv")).alias("total"), F.size(F.array_intersect("su", "sv")).alias("common"))
    out = cut(near.where(F.col("common") * (100 + p.percent) >= F.col("total") * p.percent).select("u", "v").distinct(), "nd-links")
    drop_table(ids)
    return out


def near_duplicates(documents: DataFrame, params: NearDupParams | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of documents.

    Null texts and those without a word have no shingle and are linked with nothing. A text with fewer words than a
    shingle has one, of all its words. Rows with the same id are the same document. A row without an id is linked with
    nothing; its component_id is null and it is kept. An empty table gives an empty one; other columns are ignored.
    """
    p = params or NearDupParams()
    spark = documents.sparkSession
    ship_package(spark)
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sig = cut(docs.mapInArrow(_signatures(p), _SIG), "nd-sig")
    some = sig.where("n > 0 AND id IS NOT NULL")
    same = cut(some.groupBy("s1", "s2", "n").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("last > rep"), "nd-same")
    copies = cut(some.select("id", "s1", "s2", "n").join(same, ["s1", "s2", "n"]).where("id > rep").select("id", "rep").distinct(), "nd-copies")
    reps = some.join(ids_side(copies.select("id")), "id", "left_anti").dropDuplicates(["id"])
    members = cut(_members(reps, p), "nd-members")

    stars = members.where("id <> center")
    tested = cut(stars.groupBy("id").agg(F.min("center").alias("v")).select(F.col("id").alias("u"), "v"), "nd-pairs")
    links = [_confirmed(tested, docs, p)]
    comp = components(links[0])
    member_of = members.join(comp, "id", "left").select("bucket", "place", "id", "n", F.coalesce("component_id", "id").alias("comp"))
    open_buckets = member_of.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("bucket")
    rest = cut(member_of.join(open_buckets, "bucket").select("bucket", "place", "id", "n", "comp"), "nd-open")
    across = cut(_across(rest, reps, p).distinct().join(tested, ["u", "v"], "left_anti"), "nd-across")
    if across.count():
        links.append(_confirmed(across, docs, p))
        comp = components(links[0].union(links[1]))
    linked = comp.select("id", F.col("component_id").alias("root"))
    moved = copies.join(linked.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("root", "rep").alias("root"))
    of = linked.union(moved)
    out = sig.select("id", "n").join(of, "id", "left")
    root = F.coalesce("root", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), root.alias("component_id"), (F.col("id").isNull() | (root == F.col("id"))).alias("kept"))
