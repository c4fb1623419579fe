"""Language of a text by mixture inference: proportions of languages by expectation-maximisation over n-grams.

Each language has probabilities of hashed character trigrams (lower case; other than letters are one space), learned
from a bounded sample of texts with a known language. A text is a mixture: its trigrams are drawn from languages in
unknown proportions, which expectation-maximisation finds. Languages enter the text's set one at a time, the one with
the largest proportion first, as long as the log-likelihood gains more than a penalty that grows with the text's length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm.texthash import mix
from tessel.runtime import ship_package


@dataclass(frozen=True)
class LanguageParams:
    """buckets: of hashed trigrams, a power of 2. cells: buckets are halved, down to 4096, while buckets x languages is
    more than this. sample: texts of each language to learn from, about. smooth: added to each count. rounds: of
    expectation-maximisation. penalty: times the logarithm of the text's trigrams, for each further language."""

    buckets: int = 1 << 16
    cells: int = 1 << 24
    sample: int = 400
    smooth: float = 0.3
    rounds: int = 8
    penalty: float = 4.0


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def trigrams(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, count) of the trigrams of each text that has a letter, sorted by text and bucket."""
    codes, owner = [], []
    letters = _letters()
    for t, text in enumerate(texts):
        c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        is_letter = letters[c]
        if not is_letter.any():
            continue
        c = np.where(is_letter, c, np.uint32(32))
        c = np.concatenate([[np.uint32(32)], c[np.concatenate([[is_letter[0]], is_letter[1:] | is_letter[:-1]])], [np.uint32(32)]])
        codes.append(c)
        owner.append(np.full(len(c), t, dtype=np.int64))
    if not codes:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.astype(np.float32)
    c, of = np.concatenate(codes).astype(np.uint64), np.concatenate(owner)
    inside = of[2:] == of[:-2]
    gram = mix(c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:])
    key = np.sort((of[2:] * buckets + (gram & np.uint64(buckets - 1)).astype(np.int64))[inside])
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.concatenate([at, [len(key)]]))
    return key[at] // buckets, key[at] % buckets, count.astype(np.float32)


def _em(like: np.ndarray, count: np.ndarray, at: np.ndarray, row: np.ndarray, total: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, log-likelihood) of each text; languages whose share is 0 at first stay out."""
    for _ in range(rounds):
        part = share[row] * like
        part *= (count / np.maximum(part.sum(1), 1e-30))[:, None]
        share = np.add.reduceat(part, at) / total[:, None]
    fit = np.add.reduceat(count * np.log(np.maximum((share[row] * like).sum(1), 1e-30)), at)
    return share, fit


def infer(texts: list[str], model: np.ndarray, p: LanguageParams) -> tuple[np.ndarray, np.ndarray]:
    """(index of the main language, its proportion) of each text; -1 and 0 where no letter is. model: buckets x languages,
    each trigram's probabilities divided by their mean over languages, which changes neither proportions nor gains."""
    best, score = np.full(len(texts), -1), np.zeros(len(texts))
    owner, bucket, count = trigrams(texts, len(model))
    if not len(owner):
        return best, score
    at = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    row = np.repeat(np.arange(len(at)), np.diff(np.concatenate([at, [len(owner)]])))
    total = np.add.reduceat(count, at)
    like = model[bucket]
    n, k = len(at), model.shape[1]
    alone = np.add.reduceat(count[:, None] * np.log(like), at)
    share, _ = _em(like, count, at, row, total, np.full((n, k), 1 / k, dtype=np.float32), p.rounds)
    first = alone.argmax(1)
    chosen = np.zeros((n, k), dtype=np.float32)
    chosen[np.arange(n), first] = 1
    fit, rest, final = alone[np.arange(n), first], share.copy(), chosen.copy()
    rest[np.arange(n), first] = 0
    going = np.ones(n, dtype=bool)
    for _ in range(k - 1):
        going &= rest.max(1) > 0
        if not going.any():
            break
        part = np.flatnonzero(going)
        add = rest[part].argmax(1)
        trial = chosen[part] > 0
        trial[np.arange(len(part)), add] = True
        rows = np.flatnonzero(going[row])
        local = np.cumsum(going) - 1
        starts = np.flatnonzero(np.concatenate([[True], np.diff(row[rows]) > 0]))
        got, better = _em(like[rows], count[rows], starts, local[row[rows]], total[part], (trial / trial.sum(1, keepdims=True)).astype(np.float32), p.rounds)
        gain = better - fit[part] > p.penalty * np.log(total[part] + 1)
        win = part[gain]
        chosen[win], final[win], fit[win] = trial[gain], got[gain], better[gain]
        rest[win, add[gain]] = 0
        going[part[~gain]] = False
    main = final.argmax(1)
    text = owner[at]
    best[text] = main
    score[text] = np.clip(final[np.arange(n), main], 0, 1)
    return best, score


def learn(documents: DataFrame, p: LanguageParams) -> tuple[list[str], np.ndarray]:
    """(languages, model) from rows (id, text, lang) with a text and a language: about p.sample texts of each."""
    known = documents.where("text IS NOT NULL AND lang IS NOT NULL")
    counts = [(r["lang"], r["count"]) for r in known.groupBy("lang").count().collect()]
    share = documents.sparkSession.createDataFrame([(lang, min(1.0, p.sample / n)) for lang, n in counts], "lang string, share double")
    draw = F.pmod(F.xxhash64("id", F.lit("lang")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    names = sorted(lang for lang, _ in counts)
    index = {n: i for i, n in enumerate(names)}
    buckets = p.buckets
    while buckets * len(names) > p.cells and buckets > 4096:
        buckets //= 2
    table = np.full((buckets, max(1, len(names))), p.smooth)
    for r in known.join(F.broadcast(share), "lang").where(draw < F.col("share")).select("lang", "text").toLocalIterator():
        _, bucket, count = trigrams([r["text"]], buckets)
        table[bucket, index[r["lang"]]] += count
    table /= table.sum(0)
    return names, (table / table.mean(1, keepdims=True)).astype(np.float32)


def identify(documents: DataFrame, held_out: Column, params: LanguageParams | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row; the model learns from rows where held_out is false.

    lang_pred is `und`, with score 0, if the text is null or has no letter, or if nothing could be learned; of equally
    likely languages the first by name wins. Rows with the same or no id stay as they are (a null id counts as held out
    where held_out is null). Other columns are ignored; an empty table gives an empty one.
    """
    p = params or LanguageParams()
    spark = documents.sparkSession
    ship_package(spark)
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.coalesce(held_out, F.lit(True)).alias("held_out"))
    names, table = learn(docs.where("NOT held_out"), p)
    shared = spark.sparkContext.broadcast((names, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, model = shared.value
        most = max(2000, min(400_000, p.cells // model.shape[1]))  # characters taken at once
        for batch in batches:
            texts = [x or "" for x in batch.column(2).to_pylist()]
            pred, score, at = [], [], 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= most):
                    size += len(texts[to])
                    to += 1
                got, how = infer(texts[at:to], model, p)
                pred += [names[i] if i >= 0 and names else "und" for i in got.tolist()]
                score += [s if names else 0.0 for s in how.tolist()]
                at = to
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
