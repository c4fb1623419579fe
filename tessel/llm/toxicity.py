"""Toxicity of texts: a bidirectional gated recurrent network with attention pooling, written and trained in numpy.

A word's input is the embedding of its hash and the mean of the embeddings of its hashed character 4-grams, which know
its beginning and end. Windows of words overlap and cover the whole text; forward and backward recurrences run
over each, attention pools their states, and a text scores as its highest window. Only documents are labelled, so
training takes each one's highest window under the model so far, and for clean ones random windows too. A fifth of the sample is kept apart
to place the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm.texthash import Words, chunks, mix
from tessel.runtime import ship_package


@dataclass(frozen=True)
class ToxicityParams:
    """buckets: rows of each embedding table, a power of 2. word, char: sizes of the embeddings. state: of each
    recurrence. window, stride: words. sample: labelled documents of each class to learn from, about. epochs, batch,
    rate: of training. least: steps of training, in further epochs if need be. gram: bytes in a character n-gram."""

    buckets: int = 1 << 16
    word: int = 8
    char: int = 8
    state: int = 6
    window: int = 40
    stride: int = 30
    sample: int = 2000
    epochs: int = 5
    least: int = 150
    batch: int = 256
    rate: float = 0.01
    gram: int = 4
    seed: int = 3


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] of them), start[1], ..."""
    at = np.cumsum(count) - count
    return np.repeat(start - at, count) + np.arange(int(count.sum()))


class Texts:
    """Inputs of several texts. Distinct words: word[u] is the bucket, grams[first[u]:first[u + 1]] those of its n-grams.
    windows: indices of distinct words, -1 beyond a short text; owner: the text of each window."""

    def __init__(self, texts: list[bytes], p: ToxicityParams) -> None:
        words = Words([b"", *texts, b" " * p.gram], lower=True, bare=True)
        n = np.diff(words.first)[1:-1]
        _, at, which = np.unique(words.hash, return_index=True, return_inverse=True)
        top = np.uint64(64 - (p.buckets - 1).bit_length())
        self.word = (words.hash[at] >> top).astype(np.int64)
        start, length = words.start[at] - 1, words.end[at] - words.start[at]
        count = np.maximum(length + 3 - p.gram, 1)
        i = _ranges(start, count)
        self.grams = (mix((words.prefix[i + p.gram] - words.prefix[i]) * words.inverse[i]) >> top).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(count)])
        some = np.flatnonzero(n)
        wins = np.maximum(1, -(-(n[some] - p.window) // p.stride) + 1)
        self.owner = np.repeat(some, wins)
        k = _ranges(np.zeros(len(some), dtype=np.int64), wins)
        own = n[self.owner]
        begin = np.minimum(k * p.stride, np.maximum(own - p.window, 0))
        place = begin[:, None] + np.arange(p.window)
        base = words.first[1:-2][self.owner]
        inside = place < own[:, None]
        self.windows = np.where(inside, which[np.where(inside, base[:, None] + place, 0)] if len(which) else 0, -1)
        self.size = len(texts)


Model = dict[str, np.ndarray]


def start(p: ToxicityParams) -> Model:
    rng = np.random.default_rng(p.seed)
    d, h = p.word + p.char, p.state
    size = {"words": (p.buckets, p.word), "chars": (p.buckets, p.char), "wx": (d, 6 * h), "bx": (6 * h,), "uf": (h, 2 * h), "ub": (h, 2 * h), "nf": (h, h), "nb": (h, h), "att": (2 * h,), "out": (2 * h,), "bias": (1,)}
    scale = {"words": 0.02, "chars": 0.02, "bx": 0.0, "bias": 0.0}
    return {k: (rng.standard_normal(s) * scale.get(k, 1 / np.sqrt(s[0]))).astype(np.float32) for k, s in size.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + np.float32(0.5)


def inputs(m: Model, t: Texts, u: np.ndarray | None = None) -> np.ndarray:
    """Rows of distinct words (all or those of u): word embedding beside the mean of character embeddings."""
    if u is None:
        chars = np.add.reduceat(m["chars"][t.grams], t.first[:-1]) / np.diff(t.first)[:, None] if len(t.word) else np.zeros((0, m["chars"].shape[1]))
        return np.concatenate([m["words"][t.word], chars.astype(np.float32)], axis=1)
    count = t.first[u + 1] - t.first[u]
    i = _ranges(t.first[u], count)
    chars = np.add.reduceat(m["chars"][t.grams[i]], np.cumsum(count) - count) / count[:, None]
    return np.concatenate([m["words"][t.word[u]], chars.astype(np.float32)], axis=1)


def _recur(g: np.ndarray, mask: np.ndarray | None, ug: np.ndarray, un: np.ndarray, keep: list | None) -> np.ndarray:
    """States (steps, windows, h) from gate inputs g (steps, windows, 3h); keep gets what the way back needs."""
    steps, n, h3 = g.shape
    h = h3 // 3
    out = np.empty((steps, n, h), dtype=np.float32)
    s = np.zeros((n, h), dtype=np.float32)
    for t in range(steps):
        gate = s @ ug
        gate += g[t, :, : 2 * h]
        gate = _sigmoid(gate)
        r, z = gate[:, :h], gate[:, h:]
        rs = r * s
        c = np.tanh(g[t, :, 2 * h :] + rs @ un)
        new = c + z * (s - c)
        if mask is not None:
            new = np.where(mask[t][:, None], new, s)
        if keep is not None:
            keep.append((s, r, z, rs, c))
        out[t] = s = new
    return out


def _recur_back(d: np.ndarray, mask: np.ndarray, keep: list, ug: np.ndarray, un: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of g, ug and un from those of the states."""
    steps, n, h = d.shape
    dg, dug, dun = np.zeros((steps, n, 3 * h), dtype=np.float32), np.zeros_like(ug), np.zeros_like(un)
    ds = np.zeros((n, h), dtype=np.float32)
    for t in range(steps - 1, -1, -1):
        s, r, z, rs, c = keep[t]
        ds = ds + d[t]
        on = mask[t][:, None]
        dn = np.where(on, ds, 0)
        back = np.where(on, 0, ds) + dn * z
        da = dn * (1 - z) * (1 - c * c)
        dz = dn * (s - c) * z * (1 - z)
        drs = da @ un.T
        dr = drs * s * r * (1 - r)
        gate = np.concatenate([dr, dz], axis=1)
        dug += s.T @ gate
        dun += rs.T @ da
        dg[t, :, : 2 * h], dg[t, :, 2 * h :] = gate, da
        ds = back + drs * r + gate @ ug.T
    return dg, dug, dun


def _pool(states: np.ndarray, mask: np.ndarray | None, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(logits, attention, pooled) of states (steps, windows, 2h)."""
    e = states @ m["att"]
    if mask is not None:
        e = np.where(mask, e, np.float32(-1e9))
    a = np.exp(e - e.max(0))
    a /= a.sum(0)
    pooled = np.einsum("tn,tnh->nh", a, states)
    return pooled @ m["out"] + m["bias"][0], a, pooled


def logits(m: Model, t: Texts, rows: np.ndarray | None = None, at_once: int = 2048) -> np.ndarray:
    """One logit for each window."""
    windows = t.windows if rows is None else t.windows[rows]
    h = m["nf"].shape[0]
    g = np.concatenate([inputs(m, t) @ m["wx"] + m["bx"], np.zeros((1, 6 * h), dtype=np.float32)])
    out = np.empty(len(windows), dtype=np.float32)
    for a in range(0, len(windows), at_once):
        w = windows[a : a + at_once].T
        mask = None if (w >= 0).all() else w >= 0
        gw = g[w]
        f = _recur(gw[:, :, : 3 * h], mask, m["uf"], m["nf"], None)
        b = _recur(gw[::-1, :, 3 * h :], None if mask is None else mask[::-1], m["ub"], m["nb"], None)[::-1]
        out[a : a + at_once] = _pool(np.concatenate([f, b], axis=2), mask, m)[0]
    return out


def _by_row(bucket: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own, at = np.unique(bucket, return_inverse=True)
    out = np.zeros((len(own), d.shape[1]), dtype=np.float32)
    np.add.at(out, at, d)
    return own, out


def gradients(m: Model, t: Texts, rows: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
    """Loss of these windows, and its gradient for every array of the model; of the embeddings (rows, gradients)."""
    h = m["nf"].shape[0]
    u, local = np.unique(t.windows[rows], return_inverse=True)
    pad = len(u) > 0 and u[0] < 0
    w = local.reshape(len(rows), -1).T
    mask = np.ones(w.shape, dtype=bool) if not pad else w > 0
    words = u[1:] if pad else u
    x = inputs(m, t, words)
    g = x @ m["wx"] + m["bx"]
    if pad:
        g = np.concatenate([np.zeros((1, 6 * h), dtype=np.float32), g])
    gw = g[w]
    kf: list = []
    kb: list = []
    f = _recur(gw[:, :, : 3 * h], mask, m["uf"], m["nf"], kf)
    b = _recur(gw[::-1, :, 3 * h :], mask[::-1], m["ub"], m["nb"], kb)[::-1]
    states = np.concatenate([f, b], axis=2)
    logit, a, pooled = _pool(states, mask, m)
    prob = _sigmoid(logit)
    loss = float(-(weight * np.where(label > 0, np.log(prob + 1e-7), np.log(1 - prob + 1e-7))).sum() / weight.sum())
    dl = ((prob - label) * weight / weight.sum()).astype(np.float32)
    grad: dict = {"out": pooled.T @ dl, "bias": dl.sum(keepdims=True)}
    dp = dl[:, None] * m["out"]
    da = np.einsum("nh,tnh->tn", dp, states)
    de = a * (da - (a * da).sum(0))
    grad["att"] = np.einsum("tn,tnh->h", de, states)
    d = a[:, :, None] * dp + de[:, :, None] * m["att"]
    gf, grad["uf"], grad["nf"] = _recur_back(d[:, :, :h], mask, kf, m["uf"], m["nf"])
    gb, grad["ub"], grad["nb"] = _recur_back(d[::-1, :, h:], mask[::-1], kb, m["ub"], m["nb"])
    dg = np.zeros_like(g)
    np.add.at(dg, w.reshape(-1), np.concatenate([gf, gb[::-1]], axis=2).reshape(-1, 6 * h))
    dg = dg[1:] if pad else dg
    grad["wx"], grad["bx"] = x.T @ dg, dg.sum(0)
    dx = dg @ m["wx"].T
    n = m["words"].shape[1]
    grad["words"] = _by_row(t.word[words], dx[:, :n])
    count = t.first[words + 1] - t.first[words]
    grad["chars"] = _by_row(t.grams[_ranges(t.first[words], count)], np.repeat(dx[:, n:] / count[:, None], count, axis=0))
    return loss, grad


def _evidence(texts: list[Texts], labels: list[np.ndarray], p: ToxicityParams) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of each word's and n-gram's bucket by the documents that have it; NaN for those in under three."""
    seen = np.zeros((2, 2, p.buckets))
    total = np.zeros(2)
    for t, y in zip(texts, labels, strict=True):
        np.add.at(total, y, 1)
        at, word = np.divmod(np.unique(np.repeat(t.owner, t.windows.shape[1])[t.windows.reshape(-1) >= 0] * len(t.word) + t.windows.reshape(-1)[t.windows.reshape(-1) >= 0]), max(1, len(t.word)))
        count = t.first[word + 1] - t.first[word]
        for which, rows, bucket in ((0, at, t.word[word]), (1, np.repeat(at, count), t.grams[_ranges(t.first[word], count)])):
            own = np.unique(rows * p.buckets + bucket)
            np.add.at(seen[which], (y[own // p.buckets], own % p.buckets), 1)
    odds = np.log((seen[:, 1] + 0.5) / (total[1] + 1)) - np.log((seen[:, 0] + 0.5) / (total[0] + 1))
    odds[seen.sum(1) < 3] = np.nan
    return odds[0], odds[1]


def train(texts: list[bytes], labels: np.ndarray, p: ToxicityParams) -> Model:
    """The model from texts with labels 0 and 1. Without a text of either class it scores every text low."""
    m = start(p)
    if not len(texts) or labels.min() == labels.max():
        m["out"][:] = 0
        m["bias"][:] = -4
        return m
    apart = np.arange(len(texts)) % 5 == 4
    parts, of = [], []
    for at, some in chunks([t.decode("utf-8", "surrogatepass") for t, x in zip(texts, apart, strict=True) if not x]):
        parts.append(Texts(some, p))
        of.append(labels[~apart][at : at + len(some)].astype(np.int64))
    words, grams = _evidence(parts, of, p)
    known = {"words": ~np.isnan(words), "chars": ~np.isnan(grams)}  # the rest stay 0: nothing can be learned of them
    for k, odds in (("words", words), ("chars", grams)):
        m[k][:, 0] = np.clip(odds, -4, 8) / 4
        m[k][~known[k]] = 0
    rng = np.random.default_rng(p.seed)
    first = {k: np.zeros_like(v) for k, v in m.items()}
    second = {k: np.zeros_like(v) for k, v in m.items()}
    share = min(0.99, max(0.01, float(labels[~apart].mean())))
    step = 0
    epoch = -1
    while epoch + 1 < p.epochs or 0 < step < p.least:
        epoch += 1
        for c in rng.permutation(len(parts)).tolist():
            t, y = parts[c], of[c]
            if not len(t.windows):
                continue
            if epoch == 0:
                e = np.append((m["words"][t.word, 0] + np.add.reduceat(m["chars"][t.grams, 0], t.first[:-1]) / np.diff(t.first)), -9)
                score = np.sort(e[t.windows], axis=1)[:, -3:].sum(1)
            else:
                score = logits(m, t)
            order = np.lexsort((score, t.owner))
            best = order[np.concatenate([t.owner[order][1:] != t.owner[order][:-1], [True]])]
            other = rng.permutation(len(t.windows))
            other = other[y[t.owner[other]] == 0][: 2 * len(best)]
            rows = rng.permutation(np.concatenate([best, other]))
            for a in range(0, len(rows), p.batch):
                own = rows[a : a + p.batch]
                label = y[t.owner[own]]
                _, grad = gradients(m, t, own, label.astype(np.float32), np.where(label > 0, 1 / share, 1 / (1 - share)).astype(np.float32))
                step += 1
                for k, d in grad.items():  # rows of embeddings that weren't touched stay as they are
                    at, d = (d[0][known[k][d[0]]], d[1][known[k][d[0]]]) if isinstance(d, tuple) else (slice(None), d)
                    first[k][at] += 0.1 * (d - first[k][at])
                    second[k][at] += 0.01 * (d * d - second[k][at])
                    m[k][at] -= (p.rate * (first[k][at] / (1 - 0.9**step)) / (np.sqrt(second[k][at] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    m["bias"] -= _threshold(np.concatenate([best_logits(m, some, p) for _, some in chunks([t.decode("utf-8", "surrogatepass") for t, x in zip(texts, apart, strict=True) if x])]) if apart.any() else np.zeros(0), labels[apart])
    return m


def _threshold(x: np.ndarray, y: np.ndarray) -> np.float32:
    """The logit that parts the classes with the least error, each class weighing the same; amid the widest such gap."""
    x, y = x[np.isfinite(x)], y[np.isfinite(x)]
    if not len(y) or y.min() == y.max():
        return np.float32(0)
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    error = np.concatenate([[0], np.cumsum(y)]) / y.sum() + (1 - np.concatenate([[0], np.cumsum(1 - y)]) / (1 - y).sum())
    edge = np.concatenate([[x[0] - 1], x, [x[-1] + 1]])
    gap = np.where(error <= error.min() + 1e-9, np.diff(edge), -1)
    k = int(gap.argmax())
    return np.float32((edge[k] + edge[k + 1]) / 2)


def best_logits(m: Model, texts: list[bytes], p: ToxicityParams) -> np.ndarray:
    """Each text's highest window; -inf without a word."""
    t = Texts(texts, p)
    best = np.full(len(texts), -np.inf)
    np.maximum.at(best, t.owner, logits(m, t).astype(np.float64))
    return best


def score(m: Model, texts: list[bytes], p: ToxicityParams) -> np.ndarray:
    """A score for each text; 0 without a word."""
    best = best_logits(m, texts, p)
    return np.where(np.isinf(best), 0.0, 1 / (1 + np.exp(-np.clip(best, -60, 60))))


def toxicity(documents: DataFrame, labels: DataFrame, held_out: Column, params: ToxicityParams | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of documents; labels that are null or neither 0 nor 1, or of rows
    where held_out isn't false, aren't learned from.

    A text that is null or has no word scores 0. Of several labels of an id each counts. Rows with the same or no id stay
    as they are (a null id counts as held out where held_out is null). Other columns are ignored; an empty table gives an
    empty one.
    """
    p = params or ToxicityParams()
    spark = documents.sparkSession
    ship_package(spark)
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.coalesce(held_out, F.lit(True)).alias("held_out"), F.col(text_col).alias("text"))
    marks = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
    counts = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    draw = F.pmod(F.xxhash64("id", F.lit("toxic")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.lit(0.0)
    for y, n in counts.items():
        share = F.when(F.col("y") == y, min(1.0, p.sample / n)).otherwise(share)
    drawn = F.broadcast(marks.where(draw < share))  # about 2 * p.sample rows
    known = docs.where("NOT held_out AND text IS NOT NULL").join(drawn, "id").orderBy("id").select("text", "y").toArrow()
    model = spark.sparkContext.broadcast(train([x.encode("utf-8", "surrogatepass") for x in known.column("text").to_pylist()], known.column("y").to_numpy(), p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            got = np.zeros(batch.num_rows)
            for at, texts in chunks(batch.column(2).to_pylist(), 1 << 19):
                got[at : at + len(texts)] = score(m, texts, p)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got), pa.array((got >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
