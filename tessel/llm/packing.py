"""Packing pieces of documents into sequences: a configuration linear program over the histogram of lengths.

A configuration is a multiset of lengths that fits one sequence. The linear program asks for amounts of configurations
that meet the demand for each length with the least sum. Multiplicative weights on the demands price configurations by a
knapsack dynamic program until all demands are met; the prices prove a lower bound on the way. Amounts are then rounded.
All of that sees only the histogram (at most `size` numbers), on the driver. The pieces then find their places by their
rank among those of their length: the plan is a table of ranges of ranks.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.llm.byte_bpe import load
from tessel.runtime import cut, ship_package


@dataclass(frozen=True)
class PackParams:
    """size: tokens in a sequence. end: id after each document. passes: (rate, share) of each try at the program: how far
    a weight falls while its demand is met, and the part of what its scarcest length needs that a configuration takes (all
    of it, if that is at most whole times). gap: no other pass is made once the plan has at most this part more sequences
    than the proven bound. near, many: at most many configurations within near of the best are taken from one dynamic
    program. rest: part of the tokens that may be left when a pass ends early, within gap. rows, salts: pieces are dealt
    over one salt more for each so many, up to salts, and ranked among those of their length and salt."""

    size: int = 2048
    end: int = 0
    passes: tuple[tuple[float, float], ...] = ((0.5, 1.0), (0.5, 0.5))
    gap: float = 0.0002
    near: float = 0.01
    many: int = 64
    whole: float = 4.0
    rest: float = 0.25
    rows: int = 4096
    salts: int = 4096


def best_fit(demand: dict[int, int], size: int) -> list[tuple[dict[int, int], int]]:
    """(configuration, times) by best fit, largest first; equal sequences are kept together."""
    bins: dict[int, list[tuple[dict[int, int], int]]] = defaultdict(list)
    for length in sorted(demand, reverse=True):
        left = demand[length]
        for room in sorted(r for r in bins if r >= length):
            while left and bins[room]:
                config, times = bins[room].pop()
                k = room // length
                use = min(times, left // k)
                if not use:
                    k, use = left, 1
                used = dict(config)
                used[length] = used.get(length, 0) + k
                bins[room - k * length].append((used, use))
                left -= k * use
                if times > use:
                    bins[room].append((config, times - use))
            if not bins[room]:
                del bins[room]
        if left:
            k = size // length
            if left // k:
                bins[size - k * length].append(({length: k}, left // k))
            if left % k:
                bins[size - left % k * length].append(({length: left % k}, 1))
    return [x for r in sorted(bins) for x in bins[r] if x[1]]


#: A plan of up to so many rows of six numbers is broadcast.
PLAN_ROWS = 500_000


def _knapsack(lengths: np.ndarray, worth: np.ndarray, most: np.ndarray, size: int) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray]:
    """(best worth by capacity, steps, better): each length is tried once, twice, four times and so on, a step each;
    better says of each step at which capacities it was worth taking."""
    steps = []
    for length, left in zip(lengths[::-1].tolist(), most[::-1].tolist(), strict=True):
        step = 1
        while left > 0:
            steps.append((length, min(step, left)))
            left -= step
            step *= 2
    value = dict(zip(lengths.tolist(), worth.tolist(), strict=True))
    best, better = np.zeros(size + 1), np.zeros((len(steps), size + 1), dtype=bool)
    for s, (length, n) in enumerate(steps):
        held, with_it = best[n * length :], best[: size + 1 - n * length] + n * value[length]
        np.greater(with_it, held + 1e-12, out=better[s, n * length :])
        np.maximum(held, with_it, out=held)
    return best, steps, better


def _filling(steps: list[tuple[int, int]], better: np.ndarray, room: int) -> dict[int, int]:
    out: dict[int, int] = defaultdict(int)
    s = len(steps)
    while len(taken := np.flatnonzero(better[:s, room])):
        s = int(taken[-1])
        length, n = steps[s]
        out[length] += n
        room -= n * length
    return out


def _price(lengths: np.ndarray, worth: np.ndarray, most: np.ndarray, size: int, near: float, many: int) -> tuple[float, list[tuple[tuple[int, int], ...]]]:
    """The worth of the best configuration, by a knapsack dynamic program, and up to many configurations that are worth at
    least 1 - near of it: for lengths that it could hold, the best ones first, the length and what fills up the rest. Of
    lengths over half of size one fits at most: these go on top of the others."""
    small = int(np.searchsorted(lengths, size // 2, side="right"))
    best, steps, better = _knapsack(lengths[:small], worth[:small], most[:small], size)
    with_one = worth + best[size - lengths]
    top = max([float(best[size]), *with_one[small:].tolist()])
    out = {tuple(sorted(_filling(steps, better, size).items())): None} if best[size] >= top * (1 - near) else {}
    order = np.argsort(-with_one, kind="stable")[: 4 * many]
    limit = dict(zip(lengths.tolist(), most.tolist(), strict=True))
    for i in order[with_one[order] >= top * (1 - near)].tolist():
        one = int(lengths[i])
        config = _filling(steps, better, size - one)
        config[one] += 1
        if config[one] <= limit[one]:
            out[tuple(sorted(config.items()))] = None
        if len(out) >= many:
            break
    return top, list(out)


def cover(demand: dict[int, int], p: PackParams, rate: float, share: float) -> tuple[dict[tuple[tuple[int, int], ...], float], float]:
    """(amounts of configurations that meet every demand, a lower bound of any such sum) by multiplicative weights.

    Each length has a price, its size times a weight that falls by exp(-rate) in all while its demand is met, and is 0
    afterwards. The knapsack finds the configurations of most worth at these prices; each takes a part of what its
    scarcest length still needs. Any prices give a bound: their sum over all demands, by the worth of the best one. Once
    no more than p.rest of all tokens are left, it ends with the rounded amounts if these are within p.gap of the bound.
    """
    lengths = np.array(sorted(demand), dtype=np.int64)
    count = np.array([demand[n] for n in lengths.tolist()], dtype=np.float64)
    most = np.minimum(count, p.size // lengths).astype(np.int64)
    left, weight = count.copy(), np.ones(len(lengths))
    amount: dict[tuple[tuple[int, int], ...], float] = defaultdict(float)
    bound = 0.0
    volume, rounds = float(lengths @ count), 0
    while (open_ := np.flatnonzero(left)).size:
        rounds += 1
        if rounds % 32 == 0 and lengths @ left <= p.rest * volume:
            plan = rounded(amount, demand, p.size)
            if sum(t for _, t in plan) <= math.ceil(max(bound, volume / p.size) - 1e-6) * (1 + p.gap):
                total: dict[tuple[tuple[int, int], ...], float] = defaultdict(float)
                for config, times in plan:
                    total[tuple(sorted(config.items()))] += times
                return total, bound
        worth = lengths[open_] * weight[open_]
        top, configs = _price(lengths[open_], worth, most[open_], p.size, p.near, p.many)
        bound = max(bound, float(count[open_] @ worth) / top)
        for nth, config in enumerate(configs):
            i, k = np.searchsorted(lengths, [n for n, _ in config]), np.array([k for _, k in config], dtype=np.float64)
            need = left[i] / k
            if nth and (not need.all() or (lengths[i] * weight[i]) @ k < top * (1 - p.near)):
                continue
            least = float(need.min())
            times = least if least <= p.whole else least * share
            amount[config] += times
            left[i] = np.maximum(left[i] - times * k, 0)
            left[i[left[i] < 1e-9 * count[i]]] = 0
            weight[i] *= np.exp(-rate * times * k / count[i])
        weight /= weight[left > 0].max() if left.any() else 1.0
    return amount, bound


def rounded(amount: dict[tuple[tuple[int, int], ...], float], demand: dict[int, int], size: int) -> list[tuple[dict[int, int], int]]:
    """(configuration, times) that use every length as often as demanded: amounts are rounded down, then up where all
    that the configuration holds is still needed, the largest parts first; best fit packs what is left over."""
    left, out = dict(demand), []

    def use(config: tuple[tuple[int, int], ...], times: int) -> None:
        times = min([times, *(left[n] // k for n, k in config)])
        if times > 0:
            out.append((dict(config), times))
            for n, k in config:
                left[n] -= k * times

    order = sorted(amount.items(), key=lambda x: (-(x[1] % 1), x[0]))
    for config, x in order:
        use(config, int(x + 1e-6))
    for config, x in order:
        use(config, 1 if x % 1 > 1e-6 else 0)
    return out + best_fit({n: c for n, c in left.items() if c}, size)


@dataclass(frozen=True)
class Packing:
    """plan: (configuration, times). fractional: the least value of the linear program found; bound: what it can't fall
    below; both in sequences."""

    plan: list[tuple[dict[int, int], int]]
    fractional: float
    bound: float

    @property
    def sequences(self) -> int:
        return sum(t for _, t in self.plan)


def program(demand: dict[int, int], p: PackParams) -> Packing:
    """The rounded solution of the configuration linear program; lengths of p.size need none.

    The program is solved with finer steps until the rounded plan is within p.gap of the proven bound or finer steps no
    longer help. Best fit's plan is a solution of the same program and is taken where it has fewer sequences.
    """
    whole = {n: c for n, c in demand.items() if n < p.size and c > 0}
    if not whole:
        return Packing([], 0.0, 0.0)
    found: Packing | None = None
    bound = sum(n * c for n, c in whole.items()) / p.size
    for rate, share in p.passes:
        amount, low = cover(whole, p, rate, share)
        bound = max(bound, low)
        now = Packing(rounded(amount, whole, p.size), sum(amount.values()), bound)
        better = found is None or now.sequences < found.sequences
        found = Packing((now if better else found).plan, min(now.fractional, found.fractional) if found else now.fractional, bound)
        if found.sequences <= math.ceil(bound - 1e-6) * (1 + p.gap) or not better:
            break
    greedy = best_fit(whole, p.size)
    if sum(t for _, t in greedy) < found.sequences:
        found = Packing(greedy, min(found.fractional, float(sum(t for _, t in greedy))), bound)
    assert found.sequences >= bound - 1e-6 * bound
    return found


def solve(demand: dict[int, int], p: PackParams) -> list[tuple[dict[int, int], int]]:
    """(configuration, times) by program(): every length is used as often as demanded."""
    return program(demand, p).plan


def pieces(documents: DataFrame, tokenizer: str, p: PackParams, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document's pieces; only the first is under p.size tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        end = np.array([p.end], dtype="<u4").tobytes()
        for batch in batches:
            of, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                ids = bpe.ids(text.as_py() or "") + end
                n = len(ids) // 4
                cuts = [0, *range(n % p.size or p.size, n + 1, p.size)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    of.append(row)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(memoryview(ids)[4 * a : 4 * b]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(documents: DataFrame, tokenizer: str, params: PackParams | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """pieces() with sequence_id and offset: where each piece lies.

    A null or empty text is the end token alone. Rows with the same or no id are packed as they are. An empty table
    gives an empty one; other columns are ignored. sequence_id is negative for a piece that fills its sequence.
    """
    p = params or PackParams()
    spark = documents.sparkSession
    ship_package(spark)
    every = cut(pieces(documents, tokenizer, p, id_col, text_col), "pk-pieces")
    full = every.where(F.col("length") == p.size).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    part = every.where(F.col("length") < p.size)
    demand = {r["length"]: r["count"] for r in part.groupBy("length").count().collect()}
    salts = min(p.salts, 1 + sum(demand.values()) // p.rows)
    rows, base = [], 0
    rank: dict[int, int] = defaultdict(int)
    for config, times in solve(demand, p):
        at = 0
        for n, k in sorted(config.items(), reverse=True):
            rows.append((n, rank[n], rank[n] + k * times, k, base, at))
            rank[n] += k * times
            at += n * k
        base += times
    names = ["length", "low", "high", "k", "base", "at"]
    table = np.array(rows, dtype=np.int64).reshape(-1, len(names))
    # from a list, rows would go through Python workers of a second pool, which stay in the executors' memory
    plan = spark.createDataFrame(pa.table(dict(zip(names, table.T, strict=True))))
    part = part.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = part.groupBy("length", "salt").count().withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).drop("count")
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1)
    part = part.join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))  # dealt out by these keys already
    placed = part.join(F.broadcast(plan) if len(rows) <= PLAN_ROWS else plan, "length").where("rank >= low AND rank < high")
    nth = F.col("rank") - F.col("low")
    placed = placed.select(*every.columns, (F.col("base") + F.floor(nth / F.col("k"))).alias("sequence_id"), (F.col("at") + nth % F.col("k") * F.col("length")).alias("offset"))
    return placed.union(full)
