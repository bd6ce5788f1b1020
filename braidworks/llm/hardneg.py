"""Hard negatives: for anchors and their nearest rows of the same label, the nearest rows of other labels inside a window of scores.

Scores are integer inner products, computed as dense products of matrices in float64. A wave of anchors of bounded size is
broadcast; each task multiplies it with its own candidates block by block and keeps a few best a row, and these
merge by a window whose limit is applied before the shuffle too. A second pass takes the windows from the positives found.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .vectors import is_sound, matrix, of_common_length, slices

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90
#: Anchors of a wave on average, and numbers of their vectors at most: what is broadcast and what a task keeps beside it.
WAVE_ANCHORS, WAVE_ENTRIES = 32_768, 1 << 23
ANCHOR_BLOCK, CANDIDATE_BLOCK = 256, 4096
#: Squared length from which on a row takes no part: below it every score fits a long.
TOO_LONG = float(1 << 62)
#: Below this bound, scores are exact in float64 and a score and a place fit one long.
EXACT = float(1 << 50)
NOTHING, NO_ID = -(1 << 62), np.iinfo(np.int64).max


class Block:
    """Rows in order of vec_id, as arrays: ids, labels, integer vectors as float64."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        squared = (vectors * vectors).sum(axis=1)
        order = np.argsort(ids, kind="stable")
        order = order[squared[order] < TOO_LONG]
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        self.longest = float(np.sqrt(squared[order].max())) if len(order) else 0.0

    @classmethod
    def of(cls, batch: pa.RecordBatch | pa.Table, d: int) -> Block:
        ids, labels = (batch[c].to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
        return cls(ids, labels, np.floor(SCALE * matrix(batch["vector"], d, float)))

    def part(self, at: slice | np.ndarray) -> Block:
        found = object.__new__(Block)
        found.ids, found.labels, found.vectors, found.longest = self.ids[at], self.labels[at], self.vectors[at], self.longest
        return found


def scores_of(anchors: Block, candidates: Block) -> tuple[np.ndarray, bool]:
    """All inner products; and whether they're known to be below EXACT. By float64, or by integers where that wouldn't be exact."""
    small = anchors.longest * candidates.longest < EXACT
    if small:
        return anchors.vectors @ candidates.vectors.T, True
    return anchors.vectors.astype(np.int64) @ candidates.vectors.T.astype(np.int64), False


def first(scores: np.ndarray, fits: np.ndarray, ids: np.ndarray, k: int, small: bool) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores of each row among those that fit, and their ids; candidates are in order of id, so ties go by place.

    Where fewer fit, NOTHING and NO_ID fill up.
    """
    width = scores.shape[1]
    k = min(k, width)
    whole = scores.astype(np.int64)
    if small:  # score and place in one number, all different
        key = np.where(fits, whole * width + np.arange(width - 1, -1, -1), np.iinfo(np.int64).min)
        best = np.argpartition(key, width - k, axis=1)[:, width - k :] if k < width else np.broadcast_to(np.arange(width), key.shape)
    else:
        best = np.argsort(np.where(fits, -whole, -NOTHING), axis=1, kind="stable")[:, :k]
    kept = np.take_along_axis(fits, best, axis=1)
    return np.where(kept, np.take_along_axis(whole, best, axis=1), NOTHING), np.where(kept, ids[best], NO_ID)


def merged(scores: np.ndarray, ids: np.ndarray, more_scores: np.ndarray, more_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best of two lists of each row, as many as the first has: higher scores first, then smaller ids."""
    k = scores.shape[1]
    scores, ids = np.hstack([scores, more_scores]), np.hstack([ids, more_ids])
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, axis=1), np.take_along_axis(ids, order, axis=1)


def positives_in(batches: Iterator[pa.RecordBatch], anchors: Block, d: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the first k rows with each anchor's label and another id."""
    scores, ids = np.full((len(anchors.ids), k), NOTHING), np.full((len(anchors.ids), k), NO_ID)
    by_label = {label: np.flatnonzero(anchors.labels == label) for label in np.unique(anchors.labels)}
    for batch in slices(batches, d, CANDIDATE_BLOCK):
        candidates = Block.of(batch, d)
        for label in np.unique(candidates.labels):
            these = candidates.part(candidates.labels == label)
            own = by_label.get(label, np.zeros(0, np.int64))
            for at in range(0, len(own), ANCHOR_BLOCK):
                rows = own[at : at + ANCHOR_BLOCK]
                found, small = scores_of(anchors.part(rows), these)
                fits = anchors.ids[rows, None] != these.ids[None, :]
                scores[rows], ids[rows] = merged(scores[rows], ids[rows], *first(found, fits, these.ids, k, small))
    return scores, ids


def windows_of(positive_scores: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score of a negative: low% and high% of the positive's, both included; an empty window where there's no positive."""
    wide = positive_scores.astype(object)
    least, most = -((-low * wide) // 100), (high * wide) // 100
    none = positive_scores == NOTHING
    return np.where(none, 1, least).astype(np.int64), np.where(none, 0, most).astype(np.int64)


def negatives_in(batches: Iterator[pa.RecordBatch], anchors: Block, d: int, least: np.ndarray, most: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the first k rows of another label inside each of an anchor's windows."""
    shape = (*least.shape, k)
    scores, ids = np.full(shape, NOTHING), np.full(shape, NO_ID)
    for batch in slices(batches, d, CANDIDATE_BLOCK):
        candidates = Block.of(batch, d)
        for at in range(0, len(anchors.ids) if len(candidates.ids) else 0, ANCHOR_BLOCK):
            rows = slice(at, at + ANCHOR_BLOCK)
            found, small = scores_of(anchors.part(rows), candidates)
            other = anchors.labels[rows, None] != candidates.labels[None, :]
            for p in range(shape[1]):
                fits = other & (found >= least[rows, p, None]) & (found <= most[rows, p, None])
                some = np.flatnonzero(fits.any(axis=1))
                if len(some):
                    into = at + some
                    scores[into, p], ids[into, p] = merged(scores[into, p], ids[into, p], *first(found[some], fits[some], candidates.ids, k, small))
    return scores, ids


def best(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first k rows of each group, with their `rank` from 1: higher scores first, then smaller ids."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("vec_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(candidates: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, wave_anchors: int = WAVE_ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `candidates` has vec_id, label (integers both) and vector; anchors are those of its rows where `is_anchor` is true. A row without id or
    label takes no part; nor does one whose vector is null, empty, holds a null or non-finite entry, isn't as long as most are or
    has a squared length of 2^62 or more after scaling by 256. An anchor's positives are rows of its label with another id; copies of a row are
    candidates each, and copies of an anchor give each their own, equal rows. An anchor without positives, or a
    positive without a negative in its window, gives no row; so do empty tables. Other columns aren't read.

    Waves of anchors are read from a table in the shared checkpoint folder, and a wave's result is written there before the
    next begins, so neither the driver nor a task ever holds more than a wave.
    """
    rows = candidates.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "vector", F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows, d = of_common_length(rows.where("vec_id IS NOT NULL AND label IS NOT NULL").where(is_sound(F.col("vector"))), "vector")
    anchors = cut(rows.where("anchor").select("vec_id", "label", "vector", F.monotonically_increasing_id().alias("nth")))
    each = max(1, min(wave_anchors, WAVE_ENTRIES // max(1, d)))
    waves = -(-anchors.count() // each)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    context, parts = rows.sparkSession.sparkContext, []
    for wave in range(waves):
        here = anchors.where(F.pmod(F.xxhash64("nth"), F.lit(waves)) == wave)
        block = Block.of(here.toArrow(), d)
        if not len(block.ids):
            continue
        sent = context.broadcast(block)
        tops = best(rows.drop("anchor").mapInArrow(_positives(sent, d, positives), "anchor int, score long, vec_id long"), ["anchor"], positives).toArrow()
        scores, ids = np.full((len(block.ids), positives), NOTHING), np.full((len(block.ids), positives), NO_ID)
        place = tops["anchor"].to_numpy(), tops["rank"].to_numpy() - 1
        scores[place], ids[place] = tops["score"].to_numpy(), tops["vec_id"].to_numpy()
        known = context.broadcast((scores, ids, *windows_of(scores, low, high)))
        found = rows.drop("anchor").mapInArrow(
            _negatives(sent, known, d, negatives), "anchor int, positive int, anchor_id long, positive_id long, positive_score long, score long, vec_id long")
        ranked = best(found, ["anchor", "positive"], negatives).select(
            "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        parts.append(cut(ranked))
        sent.unpersist()
        known.unpersist()
    return reduce(DataFrame.unionAll, parts) if parts else rows.sparkSession.createDataFrame([], schema)


def _positives(sent, d: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, ids = positives_in(batches, sent.value, d, k)
        anchor, nth = np.nonzero(scores != NOTHING)
        yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int32()), pa.array(scores[anchor, nth]), pa.array(ids[anchor, nth])], ["anchor", "score", "vec_id"])

    return run


def _negatives(sent, known, d: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        positive_scores, positive_ids, least, most = known.value
        scores, ids = negatives_in(batches, sent.value, d, least, most, k)
        anchor, positive, nth = np.nonzero(scores != NOTHING)
        columns = {
            "anchor": pa.array(anchor, pa.int32()), "positive": pa.array(positive, pa.int32()), "anchor_id": sent.value.ids[anchor], "positive_id": positive_ids[anchor, positive],
            "positive_score": positive_scores[anchor, positive], "score": scores[anchor, positive, nth], "vec_id": ids[anchor, positive, nth],
        }
        yield pa.RecordBatch.from_pydict(columns)

    return run


def mixed_labels(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, vector of the embeddings; where vec_id is divisible by 7, the label is the next of ten."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return embeddings.select("vec_id", label.alias("label"), F.col("embedding").alias("vector"))
