"""Gradient boosting over histograms, and isolation forests.

A tree is four arrays over heap places (children of n are 2n and 2n + 1): the feature and the bin of a split (-1: leaf),
and the value. Histograms are larger than the rows of a small table, so up to HELD bytes all rows go to each of a few
barrier tasks: a task grows the trees of its scores, and tasks tell one another their trees after each round. Of a larger
table each level of all trees of a round is one pass: tasks add up gradients by tree, node, feature and bin in numpy,
these histograms meet by feature, where the best split is sought, and the driver gets one row a node. Nodes are then taken
best first up to the number of leaves, which gives the same tree as growing leaf by leaf, since a node's gain depends on
its rows alone.
"""

from __future__ import annotations

import heapq
import json
import secrets
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tessel.runtime import cut, drop_table, ship_package


#: Bytes of histograms that a task holds at once; what is beyond takes another pass over the rows.
HISTOGRAMS = 64 << 20
#: Bytes of a table's bins and scores up to which every task of a fit holds all rows.
HELD = 256 << 20


@dataclass
class Tree:
    feature: list[int]
    bin: list[int]
    value: list[float]
    depth: int

    def places(self, bins: np.ndarray) -> np.ndarray:
        """The node where each row's walk down ends."""
        f, b, every, node = np.array(self.feature), np.array(self.bin), np.arange(len(bins)), np.ones(len(bins), dtype=int)
        for _ in range(self.depth):
            at = f[node]
            node = np.where(at < 0, node, 2 * node + (bins[every, np.maximum(at, 0)] > b[node]))
        return node

    def predict(self, bins: np.ndarray) -> np.ndarray:
        """The value of the leaf that a row's bins lead to."""
        return np.array(self.value)[self.places(bins)]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of numbers out of lists of one length; nulls are NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _rows(y: pa.Array, bins: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel(), k), x.shape[1]).cast(pa.list_(k)) for x, k in ((bins, pa.int32()), (s, pa.float64()))]
    return pa.RecordBatch.from_arrays([y, *lists], ["_y", "_bins", "_s"])


def _add(s: np.ndarray, bins: np.ndarray, rounds: list[list[Tree]], rate: float) -> np.ndarray:
    """Scores after more rounds."""
    for trees in rounds:
        s = s + rate * np.stack([t.predict(bins) for t in trees], axis=1)
    return s


@dataclass
class Boosted:
    features: list[str]
    edges: list[list[float]]
    start: list[float]
    rate: float
    loss: str
    rounds: list[list[Tree]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Bin 0 is missing; a value on an edge goes right."""
        return np.stack([np.where(np.isnan(v), 0, np.searchsorted(np.array(e, dtype=float), v, side="right") + 1) for v, e in zip(x.T, self.edges, strict=True)], axis=1)

    def numbers(self) -> Column:
        return F.array(*(F.col(f).cast("double") for f in self.features))

    def raw(self, df: DataFrame, name: str = "_raw") -> DataFrame:
        """df with its scores, one for each class (or one)."""
        ship_package(df.sparkSession)
        names, width = [*df.columns, name], len(self.features)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                s = _add(np.tile(self.start, (b.num_rows, 1)), self.bins(_matrix(b.column(b.num_columns - 1).cast(pa.list_(pa.float64())), width)), self.rounds, self.rate)
                scores = pa.FixedSizeListArray.from_arrays(pa.array(s.ravel()), len(self.start)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], scores], names)

        return df.withColumn("_x", self.numbers()).mapInArrow(run, StructType([*df.schema.fields, StructField(name, ArrayType(DoubleType()))]))

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """The value, the probability of class 1, or the most probable class (the lowest of equals)."""
        d, s = self.raw(df), F.col("_raw")
        if self.loss == "squared":
            e = s[0]
        elif self.loss == "log":
            e = 1 / (1 + F.exp(-s[0]))
        else:
            e = (F.array_position(s, F.array_max(s)) - 1).cast("long")
        return d.withColumn(name, e).drop("_raw")


def _gradients(loss: str, s: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(g, h) of each row and tree; a row without a target has no gradient."""
    if loss == "squared":
        g, h = s - y[:, None], np.ones_like(s)
    else:
        if loss == "log":
            p, hit = 1 / (1 + np.exp(-s)), y[:, None]
        else:
            e = np.exp(s - s.max(1, keepdims=True))
            p, hit = e / e.sum(1, keepdims=True), (y[:, None] == np.arange(s.shape[1])).astype(float)
        g, h = p - hit, np.maximum(p * (1 - p), 1e-12)
    return np.where(np.isnan(y)[:, None], 0.0, g), h


def _histograms(model: Boosted, pending: list[list[Tree]], trees: list[Tree], nodes: list[tuple[int, int]], most: int):
    """(k, node, f, hist) of a task's rows at each of some nodes (tree, place): sums of g, h and rows by bin."""
    width, slots = len(model.features), {}
    for k, n in nodes:
        slots.setdefault(k, {})[n] = len(slots.get(k, {}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {k: np.zeros((3, len(at) * width * most)) for k, at in slots.items()}
        for b in batches:
            bins = _matrix(b.column("_bins"), width)
            y = b.column("_y").to_numpy(zero_copy_only=False).astype(float)
            g, h = _gradients(model.loss, _add(_matrix(b.column("_s"), len(model.start)), bins, pending, model.rate), y)
            for k, at in slots.items():
                slot = np.full(len(trees[k].feature), -1)
                slot[list(at)] = list(at.values())
                slot = slot[trees[k].places(bins)]
                rows = np.flatnonzero(slot >= 0)
                place = ((slot[rows, None] * width + np.arange(width)) * most + bins[rows]).ravel()
                for i, w in enumerate((g[rows, k], h[rows, k], None)):
                    held[k][i] += np.bincount(place, None if w is None else np.repeat(w, width), held[k].shape[1])
        for k, at in slots.items():
            x = held[k].reshape(3, len(at), width, most)
            for n, s in at.items():
                f = np.flatnonzero(x[2, s].any(axis=1))
                if len(f):
                    data = [np.ascontiguousarray(x[:, s, i]).tobytes() for i in f.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array([v] * len(f), pa.int32()) for v in (k, n)] + [pa.array(f, pa.int32()), pa.array(data, pa.binary())], ["k", "node", "f", "hist"])

    return run


def _room(count: int, most: int) -> tuple[np.ndarray, ...]:
    """Arrays that _cuts works in, for many calls: allocating them costs more than the sums."""
    return np.empty((count, 3, most)), *(np.empty((count, most)) for _ in range(3))


def _cuts(hist: np.ndarray, min_leaf: int, ridge: float, room: tuple[np.ndarray, ...] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Running sums over bins, and the best split's bin and gain, of each histogram; of equals the lowest bin."""
    left, gain, other, h = room or _room(len(hist), hist.shape[2])
    np.cumsum(hist, axis=2, out=left)
    total, least = left[:, :, -1:].copy(), ridge + 1e-12
    np.divide(np.multiply(left[:, 0], left[:, 0], out=gain), np.add(left[:, 1], least, out=h), out=gain)
    np.add(np.subtract(total[:, 1], left[:, 1], out=h), least, out=h)
    np.subtract(total[:, 0], left[:, 0], out=other)
    gain += np.divide(np.multiply(other, other, out=other), h, out=other)
    gain -= total[:, 0] * total[:, 0] / (total[:, 1] + least)
    np.minimum(np.subtract(total[:, 2], left[:, 2], out=h), left[:, 2], out=h)
    np.putmask(gain, h < min_leaf, -1.0)
    at = gain.argmax(1)
    return left, at, gain[np.arange(len(gain)), at]


def _best(most: int, min_leaf: int, ridge: float):
    """The best split of each (k, node, f) whose histograms are all in this task; of equals the lowest bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for b in batches:
            for k, n, f, x in zip(*(b.column(c).to_pylist() for c in ("k", "node", "f", "hist")), strict=True):
                x = np.frombuffer(x).reshape(3, most)
                held[k, n, f] = held[k, n, f] + x if (k, n, f) in held else x
        if not held:
            return
        left, at, gain = _cuts(np.stack(list(held.values())), min_leaf, ridge)
        keys, every = np.array(list(held), dtype=np.int32), np.arange(len(gain))
        out = [*keys.T, at.astype(np.int32), gain, left[every, 0, at], left[every, 1, at], left[:, 0, -1], left[:, 1, -1]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["k", "node", "f", "bin", "gain", "lg", "lh", "tg", "th"])

    return run


def _splits(d: DataFrame, model: Boosted, pending: list[list[Tree]], trees: list[Tree], level: list[tuple[int, int]], min_leaf: int, ridge: float) -> list:
    """One row a node of a level of all trees: its best split by gain; of equals the first feature and the lowest bin."""
    most = max((len(e) for e in model.edges), default=0) + 2
    step, out = max(1, HISTOGRAMS // (24 * most * max(1, len(model.features)))), []
    for i in range(0, len(level), step):
        hist = d.mapInArrow(_histograms(model, pending, trees, level[i : i + step], most), "k int, node int, f int, hist binary")
        c = hist.repartition("k", "node", "f").mapInArrow(_best(most, min_leaf, ridge), "k int, node int, f int, bin int, gain double, lg double, lh double, tg double, th double")
        best = F.min_by(F.struct("f", "bin", "gain", "lg", "lh", "tg", "th"), F.struct(-F.col("gain"), F.col("f"), F.col("bin")))
        out += c.groupBy("k", "node").agg(best.alias("s")).select("k", "node", "s.*").collect()
    return out


def grow(d: DataFrame, model: Boosted, pending: list[list[Tree]], depth: int, leaves: int, min_leaf: int, ridge: float) -> list[Tree]:
    """The trees of a round, one for each score, over the columns _y, _bins and _s: a level of all of them at a time."""
    size, count = 2 ** (depth + 1), len(model.start)
    trees = [Tree([-1] * size, [-1] * size, [0.0] * size, depth) for _ in range(count)]
    found, sums, least = [{} for _ in trees], [{} for _ in trees], [{} for _ in trees]
    level = [(k, 1) for k in range(count)]
    for _ in range(depth):
        rows, level = _splits(d, model, pending, trees, level, min_leaf, ridge), []
        for r in rows:
            k, n = r["k"], r["node"]
            sums[k][n] = (r["tg"], r["th"])
            if r["gain"] > 1e-12:
                found[k][n] = r
                trees[k].feature[n], trees[k].bin[n] = r["f"], r["bin"]
                sums[k][2 * n], sums[k][2 * n + 1] = (r["lg"], r["lh"]), (r["tg"] - r["lg"], r["th"] - r["lh"])
                least[k][n] = min(r["gain"], least[k].get(n // 2, r["gain"]))
        # nodes are taken by the least gain on their way from the root: below those beyond the leaves none is taken
        last = [sorted(x.values(), reverse=True)[: max(leaves - 1, 0)][-1:] or [np.inf] for x in least]
        level = [(r["k"], c) for r in rows if least[r["k"]].get(r["node"], -1.0) >= last[r["k"]][0] for c in (2 * r["node"], 2 * r["node"] + 1)]
        if not level:
            break
    out = []
    for k, tree in enumerate(trees):
        t = Tree([-1] * size, [-1] * size, [0.0] * size, depth)
        heap, made = [(-found[k][1]["gain"], 1)] if 1 in found[k] else [], 1
        while heap and made < leaves:
            _, n = heapq.heappop(heap)
            t.feature[n], t.bin[n] = tree.feature[n], tree.bin[n]
            made += 1
            for c in (2 * n, 2 * n + 1):
                if c in found[k]:
                    heapq.heappush(heap, (-found[k][c]["gain"], c))
        for n, (a, b) in sums[k].items():
            t.value[n] = float(-a / (b + ridge + 1e-12))
        out.append(t)
    return out


def _grown(bins: np.ndarray, g: np.ndarray, h: np.ndarray, most: int, depth: int, leaves: int, min_leaf: int, ridge: float) -> Tree:
    """A tree over rows in memory, leaf by leaf; of two children the one with more rows has its parent's histograms less
    the other's."""
    size, width = 2 ** (depth + 1), bins.shape[1]
    t, offsets = Tree([-1] * size, [-1] * size, [0.0] * size, depth), np.arange(width) * most
    heap: list[tuple] = []
    value = lambda x: float(-x[0] / (x[1] + ridge + 1e-12))

    room, step = _room(width, most), 2048
    place, weights = np.empty((step, width), dtype=np.intp), np.empty((step, width))

    def histograms(rows: np.ndarray) -> np.ndarray:
        x = np.zeros((3, width * most))
        for i in range(0, len(rows), step):
            r = rows[i : i + step]
            p, w = np.add(bins[r], offsets, out=place[: len(r)]).ravel(), weights[: len(r)]
            for j, v in enumerate((g, h)):
                w[:] = v[r, None]
                x[j] += np.bincount(p, w.ravel(), width * most)
            x[2] += np.bincount(p, None, width * most)
        return x.reshape(3, width, most)

    def candidate(n: int, rows: np.ndarray, x: np.ndarray) -> None:
        left, at, gain = _cuts(x.transpose(1, 0, 2), min_leaf, ridge, room)
        f = int(gain.argmax())
        total, part = left[f, :, -1].copy(), left[f, :, at[f]].copy()
        t.value[n] = value(total)
        if 2 * n < size and gain[f] > 1e-12:
            heapq.heappush(heap, (-gain[f], n, rows, x, f, int(at[f]), part, total))

    every, made = np.arange(len(bins)), 1
    candidate(1, every, histograms(every))
    while heap and made < leaves:
        _, n, rows, x, f, b, left, total = heapq.heappop(heap)
        made += 1
        t.feature[n], t.bin[n], t.value[2 * n], t.value[2 * n + 1] = f, b, value(left), value(total - left)
        right = bins[rows, f] > b
        parts = rows[~right], rows[right]
        few = int(len(parts[1]) < len(parts[0]))
        if made == leaves or 4 * n >= size or len(parts[1 - few]) < 2 * min_leaf:
            continue  # no child is split any more
        less = histograms(parts[few])
        x -= less
        x *= x[2] > 0
        for c, part, y in ((few, parts[few], less), (1 - few, parts[1 - few], x)):
            if len(part) >= 2 * min_leaf:
                candidate(2 * n + c, part, y)
    return t


def _slots(d: DataFrame) -> int:
    """Tasks that can run at once; a barrier stage needs all of its own, and can't be where executors come and go."""
    sc = d.sparkSession.sparkContext._jsc.sc()
    if sc.getConf().getBoolean("spark.dynamicAllocation.enabled", False):
        return 1
    return sc.maxNumConcurrentTasks(sc.resourceProfileManager().defaultResourceProfile())


def _told(task: int, tasks: int, key: bytes) -> Callable[[str], list[str]]:
    """What each task of a barrier stage says, told to all of them by way of task 0, whose address Spark gives out once:
    its own gathering takes a second a time."""
    from multiprocessing.connection import Client, Listener

    from pyspark import BarrierTaskContext

    context, at = BarrierTaskContext.get(), ""
    if task == 0:
        listener = Listener(("", 0), backlog=tasks, authkey=key)
        at = f"{context.getTaskInfos()[context.partitionId()].address.rpartition(':')[0]}:{listener.address[1]}"
    host, _, port = max(context.allGather(at)).rpartition(":")
    if task:
        peers = [Client((host, int(port)), authkey=key)]
    else:
        peers = [listener.accept() for _ in range(tasks - 1)]
        listener.close()

    def tell(said: str) -> list[str]:
        if task:
            peers[0].send_bytes(said.encode())
            return json.loads(peers[0].recv_bytes())
        told = [said, *(p.recv_bytes().decode() for p in peers)]
        for p in peers:
            p.send_bytes(json.dumps(told).encode())
        return told

    return tell


def _held(d: DataFrame, model: Boosted, rounds: int, depth: int, leaves: int, min_leaf: int, ridge: float) -> list[list[Tree]]:
    """All rounds over the columns _y and _bins by tasks that hold all rows, each with the trees of some of the scores."""
    width, count, most = len(model.features), len(model.start), max((len(e) for e in model.edges), default=0) + 2
    kind, tasks = "u1" if most <= 256 else "<i4", max(1, min(count, _slots(d)))
    key = secrets.token_bytes(32)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = b.column("_y").to_numpy(zero_copy_only=False).astype("<f8"), _matrix(b.column("_bins"), width).astype(kind)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in data], ["y", "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = 0, []
        for b in batches:
            task = b.column("task")[0].as_py()
            held += [(np.frombuffer(y.as_py(), "<f8"), np.frombuffer(x.as_py(), kind).reshape(-1, width)) for y, x in zip(b.column("y"), b.column("x"), strict=True)]
        y, bins = (np.concatenate(v) for v in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((*bins.T, y))  # sums don't hang on how rows came
        y, bins = y[order], np.ascontiguousarray(bins[order])
        s, mine = np.tile(model.start, (len(y), 1)), list(range(task, count, tasks))
        g, h = (np.empty((len(mine), len(y))) for _ in range(2))
        tell = _told(task, tasks, key) if tasks > 1 else lambda said: [said]
        parts, out = [slice(i, i + 16_384) for i in range(0, len(y), 16_384)], []
        for _ in range(rounds):
            for p in parts:
                both = _gradients(model.loss, s[p], y[p])
                g[:, p], h[:, p] = (v[:, mine].T for v in both)
            told = json.dumps([(k, t.feature, t.bin, t.value) for k, t in ((k, _grown(bins, g[i], h[i], most, depth, leaves, min_leaf, ridge)) for i, k in enumerate(mine))])
            trees = [Tree(*x[1:], depth) for x in sorted(x for one in tell(told) for x in json.loads(one))]
            for p in parts:
                s[p] = _add(s[p], bins[p], [trees], model.rate)
            out.append(json.dumps([(t.feature, t.bin, t.value) for t in trees]))
        if task == 0:
            yield pa.RecordBatch.from_arrays([pa.array(range(rounds), pa.int32()), pa.array(out, pa.string())], ["round", "trees"])

    all_rows = d.select("_y", "_bins").mapInArrow(packed, "y binary, x binary")
    dealt = d.sparkSession.range(0, tasks, 1, tasks).select(F.col("id").cast("int").alias("task")).crossJoin(F.broadcast(all_rows))
    got = dealt.mapInArrow(run, "round int, trees string", barrier=tasks > 1).collect()
    return [[Tree(*x, depth) for x in json.loads(r["trees"])] for r in sorted(got)]


def hist_boost(df: DataFrame, features: list[str], target: str, loss: str = "squared", rounds: int = 100, rate: float = 0.1, depth: int = 8, leaves: int = 31, min_leaf: int = 20, ridge: float = 0.0, bins: int = 255) -> Boosted:
    """loss is squared, log (target 0 or 1) or softmax (target 0 to k - 1). Edges are quantiles of a mergeable sketch;
    min_leaf is at most a quarter of the rows. By passes, scores are written every five rounds, so that plans stay short."""
    x = [F.col(f).cast("double") for f in features]
    y = F.col(target).cast("double")
    cuts = [i / bins for i in range(1, bins)]
    r = df.agg(F.count("*").alias("n"), F.avg(y).alias("m"), F.max(y).alias("k"), *(F.percentile_approx(F.when(~F.isnan(c), c), cuts, 10_000).alias(f"e{i}") for i, c in enumerate(x))).first()
    if not r["n"]:
        raise ValueError("no rows")
    edges = [sorted(set(r[f"e{i}"] or [])) for i in range(len(x))]
    if loss == "squared":
        start = [float(r["m"])]
    elif loss == "log":
        import math

        p = min(max(r["m"], 1e-7), 1 - 1e-7)
        start = [math.log(p / (1 - p))]
    else:
        start = [0.0] * (int(r["k"]) + 1)
    model = Boosted(list(features), edges, start, rate, loss)
    least = max(1, min(min_leaf, r["n"] // 4))
    ship_package(df.sparkSession)
    width, kind = len(features), "_y double, _bins array<int>, _s array<double>"

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = model.bins(_matrix(b.column("_x").cast(pa.list_(pa.float64())), width)).astype(np.int32)
            yield _rows(b.column("_y"), at, np.tile(start, (b.num_rows, 1)))

    d = df.select(y.alias("_y"), model.numbers().alias("_x")).mapInArrow(binned, kind)
    if rounds and r["n"] * (2 * width + 24 * len(start)) <= HELD:
        model.rounds = _held(d, model, rounds, depth, leaves, least, ridge)
        return model
    d = cut(d, "boost")
    pending: list[list[Tree]] = []
    for i in range(rounds):
        trees = grow(d, model, pending, depth, leaves, least, ridge)
        model.rounds.append(trees)
        pending.append(trees)
        if i % 5 == 4 and i + 1 < rounds:

            def scored(batches: Iterator[pa.RecordBatch], more: list = pending) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    at = _matrix(b.column("_bins"), width)
                    yield _rows(b.column("_y"), at, _add(_matrix(b.column("_s"), len(start)), at, more, rate))

            d, old = cut(d.mapInArrow(scored, kind), "boost"), d
            drop_table(old)
            pending = []
    drop_table(d)
    return model


def isolation_forest(df: DataFrame, key: str, features: list[str], trees: int = 100, sample: int = 256, contamination: float = 0.1, seed: int = 1) -> DataFrame:
    """(key, score, outlier): 2 ** -(mean path / c) over trees of `sample` rows drawn with replacement from at most
    trees * sample rows, which are fitted on the driver; outlier is a score at or over its 1 - contamination quantile."""
    import numpy as np
    import pandas as pd

    x = np.array([[float(v) for v in r] for r in df.select(*(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features)).orderBy(F.xxhash64(F.col(key), F.lit(seed))).limit(trees * sample).collect()]).reshape(-1, len(features))
    rng, deep = np.random.default_rng(seed), max(1, int(np.ceil(np.log2(sample))))

    def c(n):
        n = np.asarray(n, float)
        return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))

    feature, at, path = (np.full((trees, 2 ** (deep + 1)), v, t) for v, t in ((-1, int), (0.0, float), (0.0, float)))
    for t in range(trees if len(x) else 0):
        stack = [(1, 0, rng.integers(0, len(x), min(sample, len(x))))]
        while stack:
            n, depth, rows = stack.pop()
            low, high = x[rows].min(0), x[rows].max(0)
            live = np.flatnonzero(high > low)
            if depth == deep or len(rows) < 2 or not len(live):
                path[t, n] = depth + float(c(len(rows)))
                continue
            f = int(rng.choice(live))
            feature[t, n], at[t, n] = f, rng.uniform(low[f], high[f])
            left = x[rows, f] < at[t, n]
            for child, part in ((2 * n, rows[left]), (2 * n + 1, rows[~left])):
                if len(part):
                    stack.append((child, depth + 1, part))
                else:
                    path[t, child] = depth + 1
    unit = max(float(c(min(sample, max(len(x), 1)))), 1e-12)

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            v, total = p[features].fillna(0.0).to_numpy(float), np.zeros(len(p))
            for t in range(trees):
                n = np.ones(len(p), int)
                for _ in range(deep):
                    f = feature[t, n]
                    n = np.where(f < 0, n, 2 * n + (v[np.arange(len(p)), np.maximum(f, 0)] >= at[t, n]))
                total += path[t, n]
            yield pd.DataFrame({key: p[key], "score": 2 ** -(total / trees / unit)})

    scored = cut(df.select(key, *(F.col(f).cast("double").alias(f) for f in features)).mapInPandas(score, f"`{key}` {dict(df.dtypes)[key]}, score double"), "isolation")
    limit = scored.agg(F.percentile_approx("score", 1 - contamination, 10_000).alias("q")).first()["q"]
    return scored.withColumn("outlier", F.col("score") >= F.lit(limit))
