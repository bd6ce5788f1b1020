"""Toxicity grades by cumulative-link ordinal regression on sparse word features."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, held_out

MASK = (1 << 20) - 1
#: Lengths of words' beginnings that are features too: inflected words share them.
BEGINNINGS = (4, 5)
#: Labelled texts of either label that the model is fitted on at most: the bounded training sample.
TRAIN_TEXTS = 2000
#: A word bucket takes part if this many training texts have it.
LEAST_TEXTS = 3
#: and if the logarithm of its odds between grade 0 and the others is this many standard errors from zero.
LEAST_Z = 3.0
STEPS = 800
L1 = 5e-5

#: Words that a task remembers; the memo is emptied when full.
MEMO_WORDS = 200_000

_WORD = re.compile(r"[^\W\d_]+")


def word_buckets(word: str) -> list[int]:
    """Of a word and of its beginnings."""
    parts = [(word, 0), *((word[:k], k) for k in BEGINNINGS if len(word) > k)]
    return [zlib.crc32(part.encode("utf-8", "surrogatepass"), k) & MASK for part, k in parts]


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words of a whole text and of their beginnings, with their values: 0.5 for standing there and the logarithm of how densely."""
    counts = Counter(_WORD.findall(text.lower()))
    total, buckets = max(1, counts.total()), {}
    for word, n in counts.items():
        for b in word_buckets(word):
            buckets[b] = buckets.get(b, 0) + n
    at = np.fromiter(buckets, np.int64, len(buckets))
    return at, 0.5 + np.log1p(100 * np.fromiter(buckets.values(), float, len(buckets)) / total)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class Model:
    """P(grade >= k) = sigmoid(w.x - thresholds[k - 1]), thresholds ascending: one w for all of them."""

    columns: np.ndarray  # sorted buckets that have a weight
    weights: np.ndarray
    thresholds: np.ndarray

    def evidence(self, x: tuple[np.ndarray, np.ndarray]) -> float:
        at = np.searchsorted(self.columns, x[0])
        at[at == len(self.columns)] = 0
        known = self.columns[at] == x[0] if len(self.columns) else np.zeros(len(x[0]), bool)
        return float((self.weights[at[known]] * x[1][known]).sum())

    def evidence_of(self, text: str, memo: dict[str, list[int]]) -> float:
        """Evidence of a whole text. As of its features, but buckets without a weight aren't looked at; `memo` keeps words' weighed buckets."""
        counts = Counter(_WORD.findall(text.lower()))
        if len(memo) > MEMO_WORDS:
            memo.clear()
        found: dict[int, int] = {}
        for word, n in counts.items():
            known = memo.get(word)
            if known is None:
                known = memo[word] = [b for b in word_buckets(word) if b in self.weight_of]
            for b in known:
                found[b] = found.get(b, 0) + n
        total = max(1, counts.total())
        return sum(self.weight_of[b] * (0.5 + math.log1p(100 * n / total)) for b, n in found.items())

    @cached_property
    def weight_of(self) -> dict[int, float]:
        return dict(zip(self.columns.tolist(), self.weights.tolist()))

    def reach(self, evidence: float) -> np.ndarray:
        """Probabilities of reaching each grade from 1 on; they never rise."""
        return _sigmoid(evidence - self.thresholds)


def odds(rows: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the rows, where each row's are among them, in how many rows each is, and its odds of being in a toxic row: their logarithm in standard errors."""
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    columns, at, texts = np.unique(np.concatenate([r[0] for r in rows]), return_inverse=True, return_counts=True)
    upper = np.bincount(at, toxic[row], minlength=len(columns)) + 0.5
    lower, high, low = texts + 1.0 - upper, toxic.sum() + 1.0, (~toxic).sum() + 1.0
    return columns, at, texts, np.log(upper * low / (lower * high)) / np.sqrt(1 / upper + 1 / lower)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, steps: int = STEPS, l1: float = L1) -> Model:
    """Maximises the likelihood of the grades (0 to K) by proximal steps, with an L1 price on the weights.

    Every threshold's cumulative logistic loss pulls at the same weights. Buckets whose odds
    say nothing of the grade are left out before.
    """
    top, n = int(grades.max(initial=0)), len(rows)
    value = np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(n), [len(r[0]) for r in rows])
    columns, at, texts, z = odds(rows, grades > 0)
    live = (texts >= LEAST_TEXTS) & (np.abs(z) >= LEAST_Z)
    keep = live[at]
    row, at, value, columns = row[keep], (np.cumsum(live) - 1)[at[keep]], value[keep], columns[live]
    price = 1 / n
    w, theta = np.zeros(len(columns)), np.linspace(1, 3, top)
    square_w, square_t = np.full(len(columns), 1e-8), np.full(top, 1e-8)
    reached = grades[:, None] >= np.arange(1, top + 1)
    for _ in range(steps):
        z = np.bincount(row, value * w[at], minlength=n)
        wrong = (_sigmoid(z[:, None] - theta) - reached) * price
        gw = np.bincount(at, value * wrong.sum(axis=1)[row], minlength=len(columns))
        gt = -wrong.sum(axis=0)
        square_w, square_t = square_w + gw * gw, square_t + gt * gt
        rate = 0.5 / np.sqrt(square_w)
        w = w - rate * gw
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
        theta = np.maximum.accumulate(theta - 0.5 / np.sqrt(square_t) * gt)
    live = w != 0
    return Model(columns[live], w[live], theta)


def density_grades(rows: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray) -> np.ndarray:
    """Grades 0 (not toxic), 1 and 2 of labelled texts: toxic ones are split at the median share of their words that are toxic ones.

    Labels give only two grades. Which words are toxic is counted in one half of the rows (LEAST_Z standard
    errors of their odds) and looked up in the other half, so no text takes part in its own grade, nor does the model.
    """
    grades = toxic.astype(np.int64)
    for half in (0, 1):
        other, own = np.arange(1 - half, len(rows), 2), np.arange(half, len(rows), 2)
        if not toxic[own].any() or not toxic[other].any() or toxic[other].all():
            continue
        columns, _, texts, z = odds([rows[i] for i in other], toxic[other])
        words = columns[(texts >= LEAST_TEXTS) & (z >= LEAST_Z)]
        dense = np.array([np.expm1(rows[i][1][np.isin(rows[i][0], words)] - 0.5).sum() for i in own])
        grades[own] += toxic[own] & (dense > np.median(dense[toxic[own]]))
    return grades


def train(documents: DataFrame, labels: DataFrame, texts: int = TRAIN_TEXTS) -> Model:
    """Fits on a bounded sample of labelled texts outside the held-out fold."""
    labels = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic is not null").where(~held_out(F.col("doc_id")))
    labels = labels.groupBy("doc_id").agg((F.max("toxic") == 1).alias("toxic"))
    taken = bounded_sample(labels, texts, "toxic")
    rows = documents.select("doc_id", "text").where("text is not null").join(F.broadcast(taken), "doc_id")
    rows = rows.groupBy(F.col("doc_id").cast("string").alias("doc_id"), "toxic").agg(F.min("text").alias("text"))

    def extract(batches):
        for batch in batches:
            found = [features(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "at": [f[0].astype("<i4").tobytes() for f in found], "value": [f[1].astype("<f4").tobytes() for f in found]})

    found = rows.mapInPandas(extract, "doc_id string, toxic boolean, at binary, value binary").toPandas()
    found = found.iloc[np.argsort([zlib.crc32(i.encode()) for i in found["doc_id"]], kind="stable")]  # in the same order whatever task was first
    toxic = found["toxic"].to_numpy(bool)
    if not len(found) or toxic.all() or not toxic.any():
        return Model(np.zeros(0, np.int64), np.zeros(0), np.array([6.0, 12.0]))
    sparse = [(np.frombuffer(at, "<i4").astype(np.int64), np.frombuffer(value, "<f4").astype(float)) for at, value in zip(found["at"], found["value"])]
    return fit(sparse, density_grades(sparse, toxic))


def severity(text: Column, model: Model, documents: DataFrame) -> Column:
    """struct(score, grade, expected_severity) of a whole text; null counts as empty."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    _memo: dict[str, list[int]] = {}

    @F.pandas_udf("struct<score: double, grade: int, expected_severity: double>")
    def judge(texts: pd.Series) -> pd.DataFrame:
        model = shared.value
        reach = [model.reach(model.evidence_of(t, _memo)) for t in texts.fillna("")]
        return pd.DataFrame([(float(r[0]), int((r >= 0.5).sum()), float(r.sum())) for r in reach], columns=["score", "grade", "expected_severity"])

    return judge.asNondeterministic()(text)


def grade_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, grade, expected_severity, toxic of every document.

    `score` is the probability of any toxicity, `grade` the highest grade that is likelier reached than
    not, `expected_severity` the mean grade, `toxic` whether the grade is over 0. Null texts are
    judged as empty. Rows that repeat are judged each, a null doc_id stays null and counts as held
    out, an empty table gives an empty one, without labels of both kinds nothing is toxic; columns
    other than doc_id and text (of `labels`: doc_id and toxic) are not read.
    """
    model = train(documents, labels)
    judged = documents.select("doc_id", severity(F.col("text"), model, documents).alias("s"))
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "s.score", "s.grade", "s.expected_severity", (F.col("s.grade") > 0).alias("toxic"))
