"""Near-duplicate vectors by a forest of random-projection trees with spill.

A node of a tree splits its vectors by their projection on a random direction at a threshold; those within a margin go to
both sides, so that close vectors rarely part. A node is a leaf when no label has many vectors in it, or when no direction
and threshold tried keep most vectors on one side only (a tight cluster). Trees are fitted on a bounded sample of all
labels and hold seeds for directions; every vector is routed. Vectors of one label are compared exactly, in double
precision, within leaves. Equal vectors of a label are one, with a key of its own and a weight. A pair that meets in several leaves counts in the one with the smallest key, so leaves
send out one row for each vector, never pairs. A leaf with more rows than a block is compared block against block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.components import components
from tessel.runtime import cut, ship_package


@dataclass(frozen=True)
class ForestParams:
    """cosine: least similarity of a link. trees, leaf: trees, and rows of a label that a leaf aims at. spill: half the
    margin's width (of unit vectors). sample, numbers: vectors that the trees are fitted on, about, and numbers in them at
    most. tries: directions for a node. most: part that may go to both sides. block: rows compared with as many others at
    once."""

    cosine: float = 0.98
    trees: int = 5
    leaf: int = 256
    spill: float = 0.03
    sample: int = 40_000
    numbers: int = 1 << 23
    tries: int = 6
    most: float = 0.5
    block: int = 2048
    seed: int = 11


# A tree: a list of nodes, (seed of the direction, threshold, left, right), or None for a leaf.


def _direction(seed: int, dims: int) -> np.ndarray:
    """A random unit vector; those of one seed agree, up to their length, in the components that they share."""
    d = np.random.default_rng(seed).standard_normal(dims)
    return d / np.linalg.norm(d)


def _grow(x: np.ndarray, label: np.ndarray, scale: float, p: ForestParams, rng: np.random.Generator) -> list:
    nodes: list = []

    def node(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append(None)
        if len(rows) < 16 or np.bincount(label[rows]).max() * scale <= p.leaf or depth >= 40:
            return at
        best = None
        for seed in rng.integers(0, 2**62, p.tries).tolist():
            s = x[rows] @ _direction(seed, x.shape[1])
            for t in np.quantile(s, (0.35, 0.5, 0.65)):
                both = np.count_nonzero(np.abs(s - t) <= p.spill)
                worst = max(np.count_nonzero(s <= t + p.spill), np.count_nonzero(s >= t - p.spill))
                if best is None or both + worst < best[0]:
                    best = (both + worst, both, worst, seed, float(t), s)
        if best[1] > p.most * len(rows) or best[2] > 0.9 * len(rows):
            return at
        _, _, _, seed, t, s = best
        left, right = node(rows[s <= t + p.spill], depth + 1), node(rows[s >= t - p.spill], depth + 1)
        nodes[at] = (seed, t, left, right)
        return at

    node(np.arange(len(x)), 0)
    return nodes


def _route(x: np.ndarray, tree: list, spill: float) -> list[tuple[int, np.ndarray]]:
    """(leaf, rows that reach it)."""
    out, todo = [], [(0, np.arange(len(x)))]
    while todo:
        at, rows = todo.pop()
        if not len(rows):
            continue
        if tree[at] is None:
            out.append((at, rows))
            continue
        seed, t, left, right = tree[at]
        s = x[rows] @ _direction(seed, x.shape[1])
        todo += [(left, rows[s <= t + spill]), (right, rows[s >= t - spill])]
    return out


def _unit(rows: pa.Array) -> np.ndarray:
    """Vectors of length 1; the largest component is taken out first, so that no square over- or underflows."""
    x = np.array(rows.to_pylist(), dtype=np.float64).reshape(len(rows), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _fit(unique: DataFrame, p: ForestParams) -> list:
    """The trees, fitted on vectors of the length that most of the sample has."""
    size = unique.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dims")).first()
    if not size["n"]:
        return [[None]]
    draw = F.pmod(F.xxhash64("label", "vector", F.lit("forest")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = min(1.0, min(p.sample, max(64, p.numbers // size["dims"])) / size["n"])
    rows = unique.where(draw < share).select("label", "vector").orderBy("label", "vector").toArrow().combine_chunks()
    dims = np.array([len(v) for v in rows.column("vector").to_pylist()], dtype=np.int64)
    if not len(dims):
        return [[None]]
    own = np.flatnonzero(dims == np.bincount(dims).argmax())
    x = _unit(rows.column("vector").take(pa.array(own)))
    label = rows.column("label").combine_chunks().dictionary_encode().indices.to_numpy()[own]
    return [_grow(x, label, size["n"] / len(dims), p, np.random.default_rng([p.seed, t])) for t in range(p.trees)]


def _compare(x: np.ndarray, ids: np.ndarray, weight: np.ndarray, side: np.ndarray, early: list[set], p: ForestParams) -> tuple[np.ndarray, np.ndarray]:
    """(weight of new links, smallest id reachable) of each row of a block. side: 0 or 1 where two blocks meet, and only
    rows of different sides count then; early: keys of the smaller leaves of each row."""
    near = x @ x.T >= p.cosine
    np.fill_diagonal(near, False)
    if side.any() and not side.all():
        near &= side[:, None] != side[None, :]
    i, j = np.nonzero(np.triu(near))
    least = ids.copy()
    while True:  # smallest id by links in the block
        before = least.copy()
        np.minimum.at(least, i, before[j])
        np.minimum.at(least, j, before[i])
        if (before == least).all():
            break
    known = {key: n for n, key in enumerate(set().union(*early))} if early else {}
    if known:
        has = np.zeros((len(x), len(known)), dtype=np.float32)
        for r, keys in enumerate(early):
            has[r, [known[k] for k in keys]] = 1
        near &= has @ has.T == 0
    return near @ weight, least


def near_vectors(vectors: DataFrame, params: ForestParams | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row.

    Vectors link when their labels are equal and not null and their cosine reaches p.cosine. A vector that is null, empty
    or zero or holds a null or a number that isn't finite, and one without an id or a label, links with nothing. Vectors
    of different length don't link. Rows with the same id are different vectors, each with the component of its own vector. A row without an id
    has no component_id and is kept. Other columns are ignored; an empty table gives an empty one.
    """
    p = params or ForestParams()
    spark = vectors.sparkSession
    ship_package(spark)
    v = F.col("vector")
    every = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).alias("label"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)
    marked = every.withColumn("good", F.coalesce(good, F.lit(False)))
    size = F.size("vector")
    unique = cut(marked.where("good").groupBy("label", "vector").agg(F.min("id").alias("id"), F.count("*").alias("weight")).withColumn("key", F.monotonically_increasing_id()), "rp-unique")
    forest = spark.sparkContext.broadcast(_fit(unique, p))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = forest.value
        for batch in batches:
            lengths = np.array([len(r) for r in batch.column(1)])
            keys: list[list[int]] = [[] for _ in range(len(lengths))]
            for dims in set(lengths.tolist()):
                rows = np.flatnonzero(lengths == dims)
                x = _unit(batch.column(1).take(pa.array(rows)))
                for t, tree in enumerate(trees):
                    for leaf, part in _route(x, tree, p.spill):
                        for r in rows[part].tolist():
                            keys[r].append(t << 32 | leaf)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sorted(k) for k in keys], pa.list_(pa.int64()))], names=["key", "keys"])

    columns = unique.select("key", "label", "weight", "vector", size.alias("dims"))
    routed = cut(unique.select("key", "vector").mapInArrow(route, "key long, keys array<long>"), "rp-keys")
    rows = columns.join(routed, "key")
    rows = rows.select("key", "label", "weight", "vector", "dims", "keys", F.explode("keys").alias("leaf"))
    of = ["label", "dims", "leaf"]
    large = cut(rows.groupBy(*of).count().where(F.col("count") > p.block).select(*of, F.ceil(F.col("count") / p.block).cast("int").alias("parts")), "rp-large")
    if count := large.count():
        rows = rows.join(F.broadcast(large) if count <= 100_000 else large, of, "left")
        part = F.pmod(F.xxhash64("key"), F.coalesce("parts", F.lit(1))).cast("int")
        rows = rows.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        rows = rows.select("key", "weight", "vector", "keys", *of, F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), (F.col("part") > F.col("other")).cast("int").alias("side"))
    else:
        rows = rows.select("key", "weight", "vector", "keys", *of, F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("side"))

    def compare(table: pa.Table) -> pa.Table:
        leaf = table.column("leaf")[0].as_py()
        x = _unit(table.column("vector").combine_chunks())
        ids, weight = table.column("key").to_numpy(), table.column("weight").to_numpy()
        early = [{k for k in keys if k < leaf} for keys in table.column("keys").to_pylist()]
        side = table.column("side").to_numpy() if table.column("a")[0] != table.column("b")[0] else np.zeros(len(ids), dtype=np.int32)
        links, least = _compare(x, ids, weight.astype(np.float64), side, early, p)
        keep = (links > 0) | (least != ids)
        return pa.table({"key": ids[keep], "links": links[keep].astype(np.int64), "least": least[keep]})

    met = cut(rows.groupBy(*of, "a", "b").applyInArrow(compare, "key long, links long, least long"), "rp-met")
    links = met.groupBy("key").agg(F.sum("links").alias("links"))
    comp = components(met.where("key <> least").select(F.col("key").alias("u"), F.col("least").alias("v"))).select(F.col("id").alias("key"), F.col("component_id").alias("root"))
    named = comp.join(unique.select("key", "id"), "key").groupBy("root").agg(F.min("id").alias("component_id"))
    one = unique.join(links, "key", "left").join(comp.join(named, "root").select("key", "component_id"), "key", "left")
    one = one.select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    copies = one.where("n_links > 0")
    found = marked.join(copies, (marked["good"]) & (marked["label"] == copies["label"]) & (marked["vector"] == copies["vector"]), "left")
    root = F.coalesce(copies["component_id"], marked["id"])
    return found.select(marked["id"].alias(id_col), F.coalesce(copies["n_links"], F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), (marked["id"].isNull() | (root == marked["id"])).alias("kept"))
