"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxspark.llm.chargrams import BUCKETS, Words, collapsed, window_sums
from ctxspark.llm.common import bound_arrow, text_slices

#: Words whose vectors are averaged before the softmax; a text scores as its most toxic run of so many words.
WINDOW = 8
#: The bounded sample: at most so many labelled texts of class 0 and of class 1, none longer than so many characters.
SAMPLE_PER_CLASS = (2000, 1000)
SAMPLE_CHARS = 12_000
SPARE = 4
DIM = 8
ROUNDS = 6


@dataclass
class ToxicityModel:
    """weights: per subword bucket its embedding times the softmax difference (all that a score needs of both); the
    score of a mean m is 1 / (1 + exp(-(scale * m + shift)))."""

    weights: np.ndarray
    scale: float
    shift: float
    window: int = WINDOW

    def score(self, texts: list[bytes]) -> np.ndarray:
        words = Words(texts)
        z = self.scale * _peaks(words, self.weights, self.window)[0] + self.shift
        z[words.count == 0] = min(self.shift, -4.0)
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _peaks(words: Words, weights: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text the highest mean of its runs of window words, and of all words whether they stand in that run.
    Immediate repeats count once; a shorter text counts as filled up with neutral words."""
    values, count, at = collapsed(words, words.word_means(weights)[0])
    best, where = window_sums(values, count, window)
    own = words.doc[at]
    place = np.arange(len(at)) - (np.cumsum(count) - count)[own] - where[own]
    inside = np.zeros(len(words.doc), bool)
    inside[at[(place >= 0) & (place < window)]] = True
    return best / window, inside


class _Bags:
    """Texts as rows of a sparse matrix: bucket and weight; each row's weights sum to 1, or to its words / size. It is
    made a chunk of texts at a time; inside: per chunk which words count."""

    def __init__(self, chunks: list[Words], inside: list[np.ndarray] | None = None, size: int = 0):
        buckets, weights, lengths = [], [], []
        for k, words in enumerate(chunks):
            word, bucket, weight = words.matrix()
            if inside:
                keep = inside[k][word]
                word, bucket, weight = word[keep], bucket[keep], weight[keep]
            n = len(words.count)
            key, flat = np.unique(words.doc[word] * BUCKETS + bucket, return_inverse=True)
            row, weight = key // BUCKETS, np.bincount(flat, weight)
            weight = weight / (size or np.maximum(np.bincount(row, weight, minlength=n), 1e-9)[row])
            buckets.append((key % BUCKETS).astype(np.int32))
            weights.append(weight.astype(np.float32))
            lengths.append(np.bincount(row, minlength=n))
        self.bucket, self.weight = np.concatenate(buckets), np.concatenate(weights)
        self.at = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])


def _train(bags: _Bags, y: np.ndarray, emb: np.ndarray, out: np.ndarray, epochs: int, rng: np.random.Generator, rate: float) -> None:
    """Adagrad over both layers at once; emb: BUCKETS x DIM, out: DIM + 1 (the last is the bias). Classes weigh alike."""
    share = np.array([1 / max(1, (y == 0).sum()), 1 / max(1, (y == 1).sum())])[y] * len(y) / 2
    g_emb, g_out = np.full(BUCKETS, 1e-4), np.full(len(out), 1e-4)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(y), 64):
            rows = order[k : k + 64]
            take = np.concatenate([np.arange(bags.at[r], bags.at[r + 1]) for r in rows])
            local = np.repeat(np.arange(len(rows)), bags.at[rows + 1] - bags.at[rows])
            w, b = bags.weight[take], bags.bucket[take]
            keys, flat = np.unique(b, return_inverse=True)
            e = emb[keys]
            bag = np.stack([np.bincount(local, w * e[flat, d], minlength=len(rows)) for d in range(DIM)], 1)
            p = 1 / (1 + np.exp(-np.clip(bag @ out[:-1] + out[-1], -30, 30)))
            err = (p - y[rows]) * share[rows]
            grad_out = np.concatenate([err @ bag, [err.sum()]])
            per = np.bincount(flat, w * err[local], minlength=len(keys))
            grad = per[:, None] * out[:-1] + 1e-4 * e
            g_emb[keys] += (grad**2).mean(1)
            emb[keys] = e - rate * grad / np.sqrt(g_emb[keys])[:, None]
            g_out += grad_out**2
            out -= rate * grad_out / np.sqrt(g_out)


def _chunks(texts: list[bytes], size: int = 64) -> list[Words]:
    return [Words(texts[k : k + size]) for k in range(0, len(texts), size)]


def fit(texts: list[bytes], labels: list[int], window: int = WINDOW, seed: int = 11) -> ToxicityModel:
    """Both layers are first trained on means over whole texts, then on each text's run of words that scores highest
    so far (toxic texts hold few toxic words). A third of the texts is kept out of that and only sets scale and shift.
    With one class only, every text gets that class's share."""
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        return ToxicityModel(np.zeros(BUCKETS, np.float32), 0.0, 4.0 if len(y) and y[0] else -4.0, window)
    rng = np.random.default_rng(seed)
    aside = np.zeros(len(y), bool)
    for c in (0, 1):
        own = rng.permutation(np.flatnonzero(y == c))
        aside[own[: len(own) // 3]] = True
    rows = np.flatnonzero(~aside)
    if len(set(y[rows].tolist())) < 2:
        aside[:], rows = False, np.arange(len(y))
    chunks = _chunks([texts[i] for i in rows])
    emb, out = rng.normal(0, 0.1, (BUCKETS, DIM)), np.concatenate([rng.normal(0, 0.5, DIM), [0.0]])
    _train(_Bags(chunks), y[rows], emb, out, 4, rng, 0.3)
    for _ in range(ROUNDS):
        weights = (emb @ out[:-1]).astype(np.float32)
        bags = _Bags(chunks, [_peaks(words, weights, window)[1] for words in chunks], window)
        _train(bags, y[rows], emb, out, 3, rng, 0.2)
    model = ToxicityModel((emb @ out[:-1]).astype(np.float32), 1.0, float(out[-1]), window)
    held = np.flatnonzero(aside) if aside.any() else rows
    peaks = [_peaks(words, model.weights, window)[0] for words in _chunks([texts[i] for i in held])]
    model.scale, model.shift = _platt(np.concatenate(peaks), y[held])
    return model


def _platt(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic scale and shift by Newton steps, with slightly smoothed targets; classes weigh as many as they are."""
    n1, n0 = max(1, (y == 1).sum()), max(1, (y == 0).sum())
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    mean, sd = m.mean(), m.std() or 1.0
    x = np.stack([(m - mean) / sd, np.ones(len(m))], 1)
    a = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        g = x.T @ (p - t) + 1e-3 * a
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        a -= np.clip(np.linalg.solve(h, g), -2, 2)
    return float(a[0] / sd), float(a[1] - a[0] * mean / sd)


def training_sample(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = SAMPLE_PER_CLASS, chars: int = SAMPLE_CHARS) -> tuple[list[bytes], list[int]]:
    """At most per_class[c] labelled texts of each class c, none longer than chars: those with the smallest hash of their id
    among the SPARE times as many labels that are tried. docs: (id, text); labels: (id, label). Rows with nulls give
    nothing; a text with both labels counts as 1. The tried labels are of bounded number, so they are broadcast and
    texts are not shuffled."""
    labels = labels.where("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").cast("int").alias("label"))
    tried = [labels.where(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(SPARE * per_class[c]) for c in (0, 1)]
    known = docs.where(F.length("text") <= chars).join(F.broadcast(tried[0].unionByName(tried[1])), "id").select("id", "label", "text")
    rows = [r for c in (0, 1) for r in known.where(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(per_class[c]).collect()]
    return [r.text.encode() for r in rows], [r.label for r in rows]


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): one row per row of docs, its whole text's score from 0 to 1. Null, empty and wordless texts get a
    low score. Other columns are not read; repeated rows stay; an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches, limit=1 << 20):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(model.score(texts), pa.float64())], ["id", "score"])

    bound_arrow(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double")


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose score is below threshold; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches, text_col, limit=1 << 20):
            yield rows.filter(pa.array(model.score(texts) < threshold))

    bound_arrow(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
