"""Text quality from trusted positives and unlabelled texts: non-negative positive-unlabelled learning."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, held_out

#: Texts of each kind (trusted positive, unlabelled) that the model is fitted on at most: the bounded training sample.
TRAIN_TEXTS = 6000
BINS = 10
#: Steps of the fit, and of those whose scores the class prior is read from.
STEPS, PRIOR_STEPS = 1500, 400
BATCH = 4096
THRESHOLD = 0.3

_PUNCTUATION = [b for b in range(33, 127) if not chr(b).isalnum()]


def features(text: str) -> np.ndarray:
    """Shares and means over a whole text: character classes, words, lines, repetition."""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    bytes_ = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, lines = raw.split(), raw.split(b"\n")
    w, k = max(1, len(words)), max(1, len(lines))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    letters = max(1, int(bytes_[65:91].sum() + bytes_[97:123].sum() + bytes_[128:].sum()))
    first = bytes_[_PUNCTUATION] / w
    shape = [
        np.log1p(len(words)), lengths.mean(), lengths.std(), lengths.max(), bytes_[65:91].sum() / letters, bytes_[48:58].sum() / n,
        bytes_[_PUNCTUATION].sum() / n, bytes_[128:].sum() / n, bytes_[9:14].sum() / n, bytes_[:9].sum() / n,
        len(set(words)) / w, len(set(lines)) / k, w / k, sum(map(len, set(lines))) / n,
        sum(x[-1:].isalnum() for x in words) / w, sum(x[:1].isupper() for x in words) / w, sum(x.isupper() for x in words) / w,
        (lengths <= 3).sum() / w, (lengths >= 12).sum() / w,
    ]
    return np.concatenate([first, shape])


@dataclass
class Model:
    """An additive model: each feature's bin has a weight."""

    edges: list[np.ndarray]
    weights: np.ndarray
    prior: float

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Column numbers of the bins that the rows fall in."""
        at, base = np.empty(x.shape, np.int64), 0
        for j, e in enumerate(self.edges):
            at[:, j] = base + np.searchsorted(e, x[:, j], "left")
            base += len(e) + 1
        return at

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.weights[self.encode(x)].sum(axis=1) + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, decay: float = 1e-5) -> Model:
    """Minimises prior * E+[l(z)] + max(0, Eu[l(-z)] - prior * E+[l(-z)]) with the logistic loss l (Kiryo et al., 2017).

    Where the part in max() falls below zero the step goes up its gradient, so the model can't
    win by calling known positives negative.
    """
    everything = np.concatenate([positive, unlabelled])
    edges = [np.unique(np.quantile(everything[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(everything.shape[1])]
    model = Model(edges, np.zeros(sum(len(e) + 1 for e in edges) + 1), prior)
    p, u, size = model.encode(positive), model.encode(unlabelled), len(model.weights)
    m, v = np.zeros(size), np.zeros(size)

    def gradient(at: np.ndarray, slope: np.ndarray) -> np.ndarray:
        g = np.bincount(at.ravel(), np.repeat(slope, at.shape[1]), minlength=size)
        g[-1] = slope.sum()
        return g / len(at)

    draw = np.random.default_rng(0)
    all_p, all_u = p, u
    for step in range(1, steps + 1):
        w = model.weights
        p, u = all_p[draw.integers(0, len(all_p), BATCH)], all_u[draw.integers(0, len(all_u), BATCH)]
        zp, zu = w[p].sum(axis=1) + w[-1], w[u].sum(axis=1) + w[-1]
        sp, su = 1 / (1 + np.exp(-np.clip(zp, -30, 30))), 1 / (1 + np.exp(-np.clip(zu, -30, 30)))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        up = gradient(u, su) - prior * gradient(p, sp)
        g = prior * gradient(p, sp - 1) + up if negative >= 0 else -up
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        rate = 0.2 if step < steps * 2 // 3 else 0.04
        model.weights = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, from these two samples alone.

    Positives score alike whether trusted or not, so at any threshold the unlabelled that reach it are
    at least the prior times the positives that do, and at the top, where few negatives are, hardly
    more. A model is fitted on one half of the samples; on the other half the
    threshold is taken whose ratio, with what chance may add to it, is least (Garg et al., 2021): an estimate from above. Both halves take
    turns. Fewer than two of either kind tell nothing: 0.5.
    """
    found = []
    for own in (0, 1) if min(len(positive), len(unlabelled)) > 1 else ():
        model = fit(positive[1 - own :: 2], unlabelled[1 - own :: 2], 0.5, PRIOR_STEPS)
        p, u = np.sort(model.score(positive[own::2])), np.sort(model.score(unlabelled[own::2]))
        at = np.unique(p)
        reach_p, reach_u = 1 - np.searchsorted(p, at) / len(p), 1 - np.searchsorted(u, at) / len(u)
        chance = np.sqrt(np.log(40) / 2 / len(p)) + np.sqrt(np.log(40) / 2 / len(u))
        best = np.argmin((reach_u + chance) / reach_p)
        found.append(reach_u[best] / reach_p[best])
    return float(np.clip(np.mean(found), 0.02, 0.98)) if found else 0.5


def train(documents: DataFrame, labels: DataFrame, texts: int = TRAIN_TEXTS) -> Model:
    """Fits on texts outside the held-out fold: labelled 1 as positives, any as unlabelled. Labels of 0 aren't used.

    The class prior is estimated from the two samples. Without any positive, the model says 0.5 of all.
    """
    fold = documents.select("doc_id", "text").where(~held_out(F.col("doc_id")))
    taken = bounded_sample(labels.where("quality = 1").where(~held_out(F.col("doc_id"))), texts)
    positive = fold.join(F.broadcast(taken), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    unlabelled = bounded_sample(fold, texts)
    rows = positive.select(F.col("doc_id").cast("string"), "text", F.lit(True).alias("trusted")).unionByName(unlabelled.select(F.col("doc_id").cast("string"), "text", F.lit(False).alias("trusted")))

    def extract(batches):
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "trusted": batch["trusted"], "x": [features(t) for t in batch["text"].fillna("")]})

    found = rows.mapInPandas(extract, "doc_id string, trusted boolean, x array<double>").toPandas()
    found = found.iloc[np.argsort([zlib.crc32(i.encode()) for i in found["doc_id"]], kind="stable")]  # in the same order whatever task was first
    x = np.stack(found["x"].tolist()) if len(found) else np.zeros((0, len(features(""))))
    known = found["trusted"].to_numpy(bool)
    if not known.any() or known.all():
        return Model([np.zeros(0)] * x.shape[1], np.zeros(x.shape[1] + 1), 0.5)
    return fit(x[known], x[~known], estimated_prior(x[known], x[~known]))


def quality(text: Column, model: Model, documents: DataFrame) -> Column:
    """Score from 0 to 1 of a whole text; null counts as empty."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype=float)
        return pd.Series(shared.value.score(np.stack([features(t) for t in texts.fillna("")])))

    return score.asNondeterministic()(text)


def score_quality(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Null and empty texts are scored as empty ones. Rows that repeat are scored each, a null
    doc_id stays null and counts as held out, an empty table gives an empty one; columns other than
    doc_id and text (of `labels`: doc_id and quality) are not read.
    """
    model = train(documents, labels)
    scored = documents.select("doc_id", quality(F.col("text"), model, documents).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
