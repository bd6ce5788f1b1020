"""Language mixtures of documents: expectation-maximisation over character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, held_out

UNKNOWN = "und"
BUCKETS = 1 << 15
#: Labelled documents of each language that the n-gram counts are taken from at most: the bounded training sample.
TRAIN_PER_LANGUAGE = 1500
#: Log-likelihood that one more language must add, for each halved log of the number of n-grams (1 would be the Bayesian criterion; n-grams overlap, so they're fewer than they look).
PENALTY = 3.0
STEPS = 40


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def ngram_buckets(text: str) -> np.ndarray:
    """Hash buckets of the trigrams of a text: letters lower-cased, each run of other characters one blank."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    ascii_ = points < 128
    letter = ~ascii_ | ((points >= 97) & (points <= 122))
    if (~ascii_).any():
        other = np.unique(points[~ascii_])
        silent = other[[not chr(c).isalpha() for c in other.tolist()]]
        if len(silent):
            letter &= ~np.isin(points, silent)
    points = np.where(letter, points, 32).astype(np.uint64)
    keep = letter | np.r_[True, letter[:-1]]
    points = np.r_[np.uint64(32), points[keep], np.uint64(32)]
    mixed = points[:-2] * np.uint64(0x9E3779B185EBCA87) + points[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + points[2:] * np.uint64(0x165667B19E3779F9)
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(49)).astype(np.int64)


@dataclass
class Model:
    """p[l, b]: probability of bucket b in language l."""

    languages: list[str]
    p: np.ndarray

    def mixture(self, buckets: np.ndarray, chosen: list[int], counts: np.ndarray) -> tuple[np.ndarray, float]:
        """Proportions of the chosen languages and the log-likelihood, by expectation-maximisation."""
        p = self.p[np.ix_(chosen, buckets)]
        share, last, total = np.full(len(chosen), 1 / len(chosen)), -np.inf, counts.sum()
        for step in range(STEPS + 1):
            mixed = share @ p
            if step % 5 == 0:  # the logarithm costs as much as a step
                likelihood = float(counts @ np.log(mixed))
                if likelihood - last < 1e-2:
                    break
                last = likelihood
            share = share * (p @ (counts / mixed)) / total
        return share, likelihood

    def infer(self, text: str) -> tuple[list[int], np.ndarray]:
        """The language set and its proportions: languages join, best first, while the penalised likelihood grows.

        The mixture of all languages bounds what any set can reach; where that adds too little
        to the best single language, nothing else needs to be tried.
        """
        buckets, counts = np.unique(ngram_buckets(text), return_counts=True)
        counts = counts.astype(float)
        penalty = PENALTY * 0.5 * np.log(max(2.0, counts.sum()))
        single = np.log(self.p[:, buckets]) @ counts
        chosen, best, share = [int(single.argmax())], float(single.max()), np.ones(1)
        everything = list(range(len(self.languages)))
        if len(everything) > 1:
            full, ceiling = self.mixture(buckets, everything, counts)
            order = [int(i) for i in np.argsort(-full) if i not in chosen]
            for candidate in order:
                if ceiling - best < penalty or len(chosen) == len(everything):
                    break
                new_share, likelihood = self.mixture(buckets, [*chosen, candidate], counts)
                if likelihood - best > penalty:
                    chosen, best, share = [*chosen, candidate], likelihood, new_share
        return chosen, share


def train(documents: DataFrame, per_language: int = TRAIN_PER_LANGUAGE, buckets: int = BUCKETS) -> Model:
    """N-gram probabilities of each language, counted over a sample of labelled documents outside the held-out fold.

    Each task adds up what it has read; a row a language and bucket at most leaves it. A model holds
    MOST_STRATA languages at most; training fails with more.
    """
    labelled = documents.select("doc_id", "text", "lang").where("lang is not null and text is not null").where(~held_out(F.col("doc_id")))
    sample = bounded_sample(labelled, per_language, "lang").select("lang", "text")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                if has_letter(text):
                    part = np.bincount(ngram_buckets(text), minlength=buckets)
                    sums[lang] = sums[lang] + part if lang in sums else part
        for lang, n in sums.items():
            b = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "bucket": b, "n": n[b]})

    rows = sample.mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(rows["lang"].unique())
    counts = np.zeros((len(languages), buckets))
    counts[rows["lang"].map({v: i for i, v in enumerate(languages)}).to_numpy(int), rows["bucket"].to_numpy(int)] = rows["n"]
    background = counts.sum(axis=0) + 0.5
    smooth = 200.0 * background / background.sum()  # each language is drawn a little to what all have in common
    p = (counts + smooth) / (counts + smooth).sum(axis=1, keepdims=True)
    return Model(languages, p)


def language(text: Column, model: Model, documents: DataFrame) -> Column:
    """struct(lang_pred, score, languages, proportions): of a text null or without letters, `und`, 0 and nothing."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred: string, score: double, languages: array<string>, proportions: array<double>>")
    def infer(texts: pd.Series) -> pd.DataFrame:
        model, rows = shared.value, []
        for text in texts:
            if text is None or not model.languages or not has_letter(text):
                rows.append((UNKNOWN, 0.0, [], []))
                continue
            chosen, share = model.infer(text)
            order = np.argsort(-share, kind="stable")
            names, parts = [model.languages[chosen[i]] for i in order], [min(1.0, float(share[i])) for i in order]
            rows.append((names[0], parts[0], names, parts))
        return pd.DataFrame(rows, columns=["lang_pred", "score", "languages", "proportions"])

    return infer.asNondeterministic()(text)


def identify(documents: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages, proportions of every document.

    `score` is the share of the predicted language. Without any labelled row every text is
    `und`. Rows that repeat are judged each; an empty table gives an empty one; columns other than
    doc_id, text and lang aren't read.
    """
    model = train(documents, per_language)
    judged = documents.select("doc_id", language(F.col("text"), model, documents).alias("l"))
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "l.lang_pred", "l.score", "l.languages", "l.proportions")
