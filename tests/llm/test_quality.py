"""The robust estimates against a many-start estimate in numpy on small groups, and verdicts for small and odd groups."""

import itertools
import random

import numpy as np
import pytest

from tessel.llm.quality import _L, _M, _PAIRS, QualityParams, estimates, judge, keep_good


def mcd(x, p, starts=300, seed=1):
    """(log of the least determinant, its start's mean and covariance) over many elemental starts, and from all rows."""
    rng, best = np.random.default_rng(seed), None
    h = int(np.ceil(p.half * (len(x) - 1))) + 1
    for _ in range(starts):
        part = rng.choice(len(x), 5, replace=False)
        det = np.inf
        while True:
            m, c = x[part].mean(0), np.cov(x[part].T, bias=True) + 1e-9 * np.eye(4)
            now = np.linalg.slogdet(c)[1]
            if len(part) > 5 and now >= det - 1e-9:
                break
            det = now if len(part) > 5 else np.inf
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            part = np.argsort(d, kind="stable")[:h]
        if best is None or now < best[0]:
            best = (now, m, c * p.consistency)
    return best[0] + 4 * np.log(p.consistency), best[1], best[2]


def reweighted(x, m, c, p):
    d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    y = x[d <= p.inner]
    m, c = y.mean(0), np.cov(y.T, bias=True) * p.reweighted
    return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)


def frame(spark, groups):
    rows = [(f"={k}", "=s", *map(float, v)) for k, x in groups.items() for v in x]
    return spark.createDataFrame(rows, "g_lang string, g_source string, x1 double, x2 double, x3 double, x4 double")


def test_least_determinant(spark):
    """Correlated rows with a third of them elsewhere: the estimate ignores these, as the many-start one does."""
    p, groups = QualityParams(floor=(1e-3,) * 4, half=0.6, bins=256), {}
    for k in range(3):
        rng = np.random.default_rng(k)
        a = rng.standard_normal((4, 4))
        good, bad = rng.standard_normal((70, 4)) @ a.T + 10, rng.standard_normal((30, 4)) * 0.3 + 10 + 8 * (k + 1)
        groups[str(k)] = np.concatenate([good, bad])
    got = {r.g_lang: r for r in estimates(frame(spark, groups), p).collect()}
    for k, x in groups.items():
        r = got[f"={k}"]
        raw, m, c = mcd(x, p)
        assert r.raw == pytest.approx(raw, abs=0.25)
        low = np.zeros((4, 4))
        for (i, j), name in zip(_PAIRS, _L, strict=True):
            low[i - 1, j - 1] = r[name]
        z = np.linalg.solve(low, (x - [r[c] for c in _M]).T)
        far, want = (z**2).sum(0), reweighted(x, m, c, p)
        assert (want[70:] > 3 * p.cutoff).all() and (far[70:] > 3 * p.cutoff).all()
        assert np.mean((far <= p.cutoff) == (want <= p.cutoff)) >= 0.98


def test_the_estimate_decides(spark):
    """Floors play no part where rows spread: the factor is that of the covariance."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((4000, 4)) @ np.diag([1.0, 2.0, 3.0, 4.0]) + 20
    r = estimates(frame(spark, {"a": x})).collect()[0]
    assert [r.l11, r.l22, r.l33, r.l44] == pytest.approx([1, 2, 3, 4], rel=0.08) and [r[m] for m in _M] == pytest.approx([20] * 4, abs=0.3)


def texts(n, seed, word=lambda rng: "".join(rng.choices("abcdefgh", k=rng.randint(2, 9)))):
    rng = random.Random(seed)
    return [" ".join(word(rng) for _ in range(120)) for _ in range(n)]


def test_small_groups_take_the_language_then_all(spark):
    odd = " ".join("$$$" + "abcdefgh"[: 2 + i % 6] + "x" * (i // 6) for i in range(120))
    rows = [("en", f"s{i % 30}", t) for i, t in enumerate(texts(200, 1))] + [("en", "s1", odd)]
    rows += [("fr", "a", t) for t in texts(3, 2)] + [("fr", "a", odd), (None, None, texts(1, 3)[0]), (None, "a", odd), ("de", None, texts(1, 4)[0])]
    rows = [(i, t, lang, source, 1, 2.0, "m") for i, (lang, source, t) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, start int, m1 double, g_lang string")
    got = {r.doc_id: r for r in judge(df).collect()}
    assert len(got) == len(rows) and all(got[i].kept == (t != odd) for i, t, *_ in rows)
    kept = keep_good(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, t, *_ in rows if t != odd}


@pytest.mark.parametrize("n", [1, 2, 5])
def test_few_rows_have_a_verdict(spark, n):
    rows = [(None if i == 3 else 7, t, "en", "s") for i, t in enumerate(texts(n, 5))] + [(7, None, None, None), (8, "", "en", "s")]
    got = judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert len(got) == n + 2 and sum(r.kept for r in got) == n and all(r.base_failed != r.kept for r in got)


def test_repeated_rows_and_long_texts(spark):
    """Equal texts are judged alike however many there are; a text of a million characters too."""
    same, long = texts(1, 6)[0], " ".join(itertools.chain.from_iterable(t.split() for t in texts(2000, 7)))
    rows = [(i, t, "en", "s") for i, t in enumerate([*texts(40, 8), *[same] * 60, long])]
    got = judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert len({r.kept for r in got if 40 <= r.doc_id < 100}) == 1 and len(long) > 1_000_000 and sum(r.n_words == 240_000 for r in got) == 1
