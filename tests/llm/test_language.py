"""Mixture inference against plain Python, and odd rows."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tessel.llm.language import LanguageParams, identify, infer, trigrams


def plain(text, model, p):
    """The same inference, one text and one trigram at a time."""
    _, bucket, count = trigrams([text], len(model))
    if not len(bucket):
        return -1, 0.0
    like, k = model[bucket].astype(float), model.shape[1]

    def fit(share):
        for _ in range(p.rounds):
            new = [0.0] * k
            for row, n in zip(like, count, strict=True):
                whole = max(sum(s * x for s, x in zip(share, row, strict=True)), 1e-30)
                for j in range(k):
                    new[j] += n * share[j] * row[j] / whole
            share = [x / count.sum() for x in new]
        return share, sum(n * math.log(max(sum(s * x for s, x in zip(share, row, strict=True)), 1e-30)) for row, n in zip(like, count, strict=True))

    alone = [float(sum(n * math.log(row[j]) for row, n in zip(like, count, strict=True))) for j in range(k)]
    first = max(range(k), key=lambda j: alone[j])
    every, _ = fit([1 / k] * k)
    chosen, share, best = {first}, [float(j == first) for j in range(k)], alone[first]
    for j in sorted((j for j in range(k) if j != first), key=lambda j: -every[j]):
        got, now = fit([1 / (len(chosen) + 1) if i in chosen | {j} else 0.0 for i in range(k)])
        if now - best <= p.penalty * math.log(count.sum() + 1):
            break
        chosen, share, best = chosen | {j}, got, now
    main = max(range(k), key=lambda j: share[j])
    return main, share[main]


def test_infer_against_plain_python():
    rng = np.random.default_rng(2)
    p = LanguageParams(buckets=512)
    model = rng.gamma(0.3, size=(512, 6)) + 0.01
    model = (model / model.mean(1, keepdims=True)).astype(np.float32)
    draw = random.Random(4)
    texts = ["".join(draw.choices("abcdefgh ij", k=draw.randint(1, 400))) for _ in range(30)] + ["", "12 3", "é", "a" * 900]
    best, score = infer(texts, model, p)
    for i, t in enumerate(texts):
        main, share = plain(t, model, p)
        assert best[i] == main and abs(score[i] - share) < 1e-3


def test_mixtures_of_many_languages(spark):
    """No number of languages is fixed, neither of those learned nor of those in a text."""
    letters = ["".join(chr(0x4E00 + 3 * i + j) for j in range(3)) for i in range(260)]  # no two are one letter in lower case
    rng = random.Random(1)
    word = lambda i: "".join(rng.choices(letters[i], k=4))
    rows = [(4 * i + j, " ".join(word(i) for _ in range(40)), f"l{i:03d}", 1, 2) for i in range(260) for j in (0, 2)]
    mixed = " ".join(word(i) for i in range(5) for _ in range(10 if i else 18))
    rows += [(9001, mixed, None, 1, 2), (9001, mixed, None, 1, 2), (None, None, None, 1, 2), (9005, "word " + word(7) * 300_000, None, 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int, held_out int")
    out = identify(df, F.col("doc_id") % 4 == 2, LanguageParams(penalty=2.0)).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(rows) and all(got[i].lang_pred == lang for i, _, lang, *_ in rows[:520])
    assert got[9001].lang_pred == "l000" and 0.15 < got[9001].score < 0.5 and got[9005].lang_pred == "l007" and got[None].lang_pred == "und"
