"""Substring dedup against brute force: branching graphs, long texts, hot passages, clashing names, compaction."""

import random

import pytest

from tessel.llm.substring import SubstringParams, compact, drop_repeats, repeated_ranges

SCHEMA = "doc_id long, text string, ranges int, id int, `row` string, spans string"


def truth(rows, span):
    words = {i: (t or "").split() for i, t, *_ in rows}
    first = {}
    for i in sorted(words):
        for s in range(len(words[i]) - span + 1):
            first.setdefault(tuple(words[i][s : s + span]), i)
    out = {}
    for i, w in words.items():
        gone = {s + k for s in range(len(w) - span + 1) if first[tuple(w[s : s + span])] < i for k in range(span)}
        out[i] = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else None
    return out


def corpus(seed, few):
    """few: so many different words, so that passages branch and join often."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(few)]
    passages = [rng.choices(words, k=rng.randint(5, 90)) for _ in range(6)]
    out = []
    for i in range(60):
        text = []
        for _ in range(rng.randint(0, 6)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            text += p[a:] if rng.random() < 0.5 else rng.choices(words, k=rng.randint(1, 30))
        out.append((3 * i + 1, " ".join(text) if i % 13 else None, 1, 2, "r", "s"))
    return out


@pytest.mark.parametrize("seed,few,span,k", [(1, 2000, 20, 5), (2, 3, 6, 2), (3, 1, 8, 3), (4, 40, 12, 4)])
def test_against_brute_force(spark, seed, few, span, k):
    rows = corpus(seed, few)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = drop_repeats(df, SubstringParams(span=span, k=k))
    want = truth(rows, span)
    assert out.schema == df.schema and sum(t is not None for t in want.values()) > 5
    got = {r.doc_id: r for r in out.collect()}
    for i, t, *rest in rows:
        assert got[i].text == (t if want[i] is None else want[i]) and [got[i].ranges, got[i].id, got[i]["row"], got[i].spans] == rest


def test_long_texts_and_a_hot_passage(spark):
    rng = random.Random(8)
    hot = [f"h{i}" for i in range(120)]
    long = [f"x{rng.randrange(10**6)}" for _ in range(180_000)]
    rows = [(1, " ".join(long), 0, 0, "", ""), (2, " ".join(long[100_000:] + ["a"] + long[:300]), 0, 0, "", "")]
    rows += [(10 + i, " ".join([f"y{rng.randrange(10**6)}" for _ in range(30)] + hot + [f"z{i}"]), 0, 0, "", "") for i in range(200)]
    assert len(rows[0][1]) > 1 << 20
    got = {r.doc_id: r.text for r in drop_repeats(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    want = truth(rows, 50)
    assert got == {i: t if want[i] is None else want[i] for i, t, *_ in rows}


def test_repeated_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(70))
    rows = [(1, a), (2, b), (2, a), (2, a), (None, a), (None, None), (3, "")]
    got = sorted((str(r.doc_id), r.text) for r in drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.text is not None)
    assert got == sorted([("1", a), ("2", b), ("2", ""), ("2", ""), ("None", a), ("3", "")])


def test_paths_are_compacted(spark):
    """A chain of edges becomes one path; a node with two ways out, or another source, ends it."""
    rows = [(1, i, 1, i, i + 1) for i in range(40)] + [(1, 40, 3, 40, 99), (1, 50, 1, 200, 201), (2, 7, 1, 201, 202), (1, 60, 1, 300, 301), (1, 61, 1, 301, 302), (5, 0, 1, 301, 303)]
    got = {(r.first, r.lo): r.head for r in compact(spark.createDataFrame(rows, "first long, lo int, c int, u long, v long")).collect()}
    assert got == {(1, i): 0 for i in range(41)} | {(1, 50): 50, (2, 7): 7, (1, 60): 60, (1, 61): 61, (5, 0): 0}


def test_long_spans_are_whole(spark):
    """A passage of 300 words that several texts share is one range in each."""
    rng = random.Random(3)
    shared = [f"s{i}" for i in range(300)]
    rows = [(i, " ".join([f"q{rng.randrange(10**9)}" for _ in range(20)] + shared + [f"q{rng.randrange(10**9)}" for _ in range(20)])) for i in range(5)]
    got = {r.id: [(x.lo, x.c) for x in r.ranges] for r in repeated_ranges(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: [(20, 251)] for i in range(1, 5)}
