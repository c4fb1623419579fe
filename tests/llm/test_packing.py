"""The packing program against bounds and small optima; odd rows through pack()."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

import public_tokenizers
from tessel.llm.packing import PackParams, best_fit, cover, pack, program


def meets(plan, demand, size):
    used = collections.Counter()
    for config, times in plan:
        assert times > 0 and sum(n * k for n, k in config.items()) <= size
        for n, k in config.items():
            used[n] += k * times
    return used == demand


def test_beats_best_fit_where_that_is_not_optimal():
    """40 + 30 + 30 fill 100; largest first puts two of 40 together and wastes a fifth."""
    demand = collections.Counter({40: 600, 30: 1200})
    found = program(demand, PackParams(size=100))
    assert meets(found.plan, demand, 100) and found.sequences == 600 == math.ceil(found.bound - 1e-6)
    assert sum(t for _, t in best_fit(demand, 100)) > 600


@pytest.mark.parametrize("low,high,size,gap", [(225, 450, 1024, 0.006), (300, 380, 1024, 0.01), (1, 1023, 1024, 0.0002)])
def test_near_the_proven_bound(low, high, size, gap):
    rng = random.Random(8)
    demand = collections.Counter(rng.randint(low, high) for _ in range(20_000))
    p = PackParams(size=size)
    found = program(demand, p)
    assert meets(found.plan, demand, size) and found.sequences <= sum(t for _, t in best_fit(demand, size))
    assert found.bound <= found.fractional + 1e-6 <= found.sequences + 1e-6 <= max(math.ceil(found.bound) * (1 + gap) + 1, found.fractional + 20)


def test_bound_is_not_above_the_optimum():
    """Prices prove a bound: small cases by search over all configurations."""
    rng = random.Random(5)
    for _ in range(20):
        demand = collections.Counter(rng.randint(3, 20) for _ in range(9))
        items = sorted(demand.elements(), reverse=True)

        def least(i, rooms, best):
            if len(rooms) >= best:
                return best
            if i == len(items):
                return len(rooms)
            for j in sorted({r: j for j, r in enumerate(rooms) if r >= items[i]}.values()):
                best = least(i + 1, [*rooms[:j], rooms[j] - items[i], *rooms[j + 1 :]], best)
            return least(i + 1, [*rooms, 30 - items[i]], best)

        found = program(demand, PackParams(size=30))
        optimum = least(0, [], 10)
        assert meets(found.plan, demand, 30) and found.bound <= optimum + 1e-6 and optimum <= found.sequences <= optimum + 1


def test_cover_meets_every_demand():
    rng = random.Random(9)
    demand = collections.Counter(rng.randint(100, 700) for _ in range(3000))
    amount, bound = cover(demand, PackParams(size=1024, gap=-1.0), 0.5, 1.0)
    for n, c in demand.items():
        assert sum(dict(config).get(n, 0) * x for config, x in amount.items()) >= c * (1 - 1e-6)
    assert bound <= sum(amount.values()) + 1e-6


def test_odd_rows(spark):
    rows = [(1, "a b"), (1, "a b"), (None, "c"), (None, None), (2, ""), (3, "word " * 30_000)]
    df = spark.createDataFrame([(i, t, 9, 9) for i, t in rows], "doc_id long, text string, length int, sequence_id int").repartition(3)
    got = pack(df, public_tokenizers.path("byte_bpe_50k.json"), PackParams(size=16)).collect()
    of = collections.Counter(r.doc_id for r in got)
    assert of[1] == 2 and of[None] == 2 and of[2] == 1 and of[3] > 1800
    long = sorted((r.piece, r.start, r.length) for r in got if r.doc_id == 3)
    assert [x[0] for x in long] == list(range(len(long))) and all(x[2] == 16 for x in long[1:]) and [x[1] for x in long[1:]] == [long[0][2] + 16 * i for i in range(len(long) - 1)]
    places = collections.defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for s in places.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:], strict=False)) and sum(n for _, n in s) <= 16
    assert pack(df.where(F.lit(False)), public_tokenizers.path("byte_bpe_50k.json")).count() == 0
