"""Benchmark decontamination: passages of test items are searched in an FM-index of each shard of documents."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh
from .fmindex import FMIndex

WINDOW_WORDS = 10
#: UTF-8 bytes of test items that are searched at once (and broadcast, as about four times that); more are searched slice by slice.
SLICE_BYTES = 32 << 20
#: Characters of text in a shard; a longer document is a shard by itself.
SHARD_CHARS = 16 << 20
#: Windows that are searched at once, and hits that are located at once: what a task holds beside its index.
SEARCHED_WINDOWS, LOCATED_HITS = 1 << 16, 1 << 18
RESULT = "struct<n_words: long, items: array<string>, spans: array<struct<start: long, end: long>>>"

#: ASCII letters lower-cased and other ASCII than letters and digits to spaces; bytes from 80 on (all of any other character) stay.
_WORDS = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split()


@dataclass
class Phrases:
    """The different windows of some test items: window i is symbols[starts[i] : starts[i] + lengths[i]], and the names of the items that have it are names[item[first[i] : first[i + 1]]]."""

    vocabulary: dict[bytes, int]
    symbols: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    first: np.ndarray
    item: np.ndarray
    names: list[str]

    @classmethod
    def of(cls, items: Iterable[tuple[object, str]], window: int) -> "Phrases":
        vocabulary: dict[bytes, int] = {}
        parts, names = [np.zeros(0, np.int32)], []
        for item, text in items:
            numbers = np.fromiter((vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)), np.int32)
            if len(numbers):
                parts.append(numbers)
                names.append(None if item is None else str(item))
        sizes = np.array([len(p) for p in parts[1:]], np.int64)
        symbols, begin = np.concatenate(parts), np.cumsum(sizes) - sizes
        n = np.maximum(1, sizes - window + 1)
        owner = np.repeat(np.arange(len(sizes)), n).astype(np.int32)
        starts = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + begin[owner]).astype(np.int32)
        lengths = np.minimum(sizes, window).astype(np.int32)[owner]
        order, same = _grouped(symbols, starts, lengths, window)
        starts, lengths, owner = starts[order], lengths[order], owner[order]
        group = np.cumsum(~same) - 1
        named = np.array([x is not None for x in names], bool)[owner]
        pairs = np.unique(np.stack([group[named], owner[named]], axis=1), axis=0)
        first = np.searchsorted(pairs[:, 0], np.arange((~same).sum() + 1)).astype(np.int32)
        return cls(vocabulary, symbols, starts[~same], lengths[~same], first, pairs[:, 1].astype(np.int32), names)

    def columns(self, some: slice, window: int) -> np.ndarray:
        """Symbols of some windows, right-aligned after zeros."""
        at = self.starts[some, None] + self.lengths[some, None] - window + np.arange(window)
        return np.where(at >= self.starts[some, None], self.symbols[np.maximum(at, 0)], 0).astype(np.int64)


def _grouped(symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the windows in which equal ones stand together, and whether each equals the one before it.

    Sorted by a symbol at a time, from the last to the first, so no table of all windows' symbols is made.
    """
    order = np.argsort(lengths, kind="stable")
    at = lambda k, o: np.where(k < lengths[o], symbols[np.minimum(starts[o] + k, len(symbols) - 1)], 0)
    if not len(starts):
        return order, np.zeros(0, bool)
    for k in range(window - 1, -1, -1):
        order = order[np.argsort(at(k, order), kind="stable")]
    same = np.r_[False, lengths[order][1:] == lengths[order][:-1]]
    for k in range(window):
        column = at(k, order)
        same[1:] &= column[1:] == column[:-1]
    return order, same


def search_shard(texts: list[str], phrases: Phrases) -> list[tuple[int, list[str], list[dict]]]:
    """Words, items found and merged spans of words of each text.

    Only runs of words that some item has can hold a window, so the index holds these alone.
    """
    counts, runs, documents, offsets = [], [], [], []
    shortest = int(phrases.lengths.min()) if len(phrases.lengths) else 0
    number = phrases.vocabulary.get
    for d, text in enumerate(texts):
        words = words_of(text)
        counts.append(len(words))
        if not shortest or len(words) < shortest:
            continue
        numbers = np.fromiter(map(number, words, repeat(0)), np.int64, len(words))
        known = np.r_[False, numbers > 0, False]
        edges = np.flatnonzero(known[1:] != known[:-1]).reshape(-1, 2)
        for a, b in edges[edges[:, 1] - edges[:, 0] >= shortest].tolist():
            runs += [numbers[a:b], [0]]
            documents.append(np.full(b - a + 1, d))
            offsets.append(np.arange(a, b + 1))
    found: list[tuple[int, list[str], list[dict]]] = [(n, [], []) for n in counts]
    if not runs:
        return found
    document, offset = np.concatenate(documents), np.concatenate(offsets)
    index = FMIndex(np.concatenate(runs).astype(np.int64), int(len(phrases.vocabulary)).bit_length())
    change = np.zeros(len(document) + 1, np.int64)
    items: list[set[int]] = [set() for _ in texts]
    window = int(phrases.lengths.max())
    for start in range(0, len(phrases.starts), SEARCHED_WINDOWS):
        some = slice(start, start + SEARCHED_WINDOWS)
        low, high = index.find(phrases.columns(some, window), phrases.lengths[some])
        ends = np.cumsum(high - low)
        done = 0
        while done < len(low):  # windows in turn, as many as have some hits in all
            upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + LOCATED_HITS, "right")))
            hits = (high - low)[done:upto]
            for part in range(0, int(hits.sum()), LOCATED_HITS):  # one window may have more
                which = np.repeat(np.arange(done, upto), hits)[part : part + LOCATED_HITS]
                rows = (np.arange(hits.sum()) - np.repeat(np.cumsum(hits) - hits, hits) + np.repeat(low[done:upto], hits))[part : part + LOCATED_HITS]
                at, which = index.locate(rows), which + start
                for d, w in np.unique(np.stack([document[at], which], axis=1), axis=0).tolist():
                    items[d].update(phrases.item[phrases.first[w] : phrases.first[w + 1]].tolist())
                np.add.at(change, at, 1)
                np.add.at(change, at + phrases.lengths[which], -1)
            done = upto
    covered = np.r_[False, np.cumsum(change[:-1]) > 0, False]
    for a, b in np.flatnonzero(covered[1:] != covered[:-1]).reshape(-1, 2).tolist():
        found[document[a]][2].append({"start": int(offset[a]), "end": int(offset[b - 1]) + 1})
    return [(n, sorted({phrases.names[i] for i in own}), spans) for (n, _, spans), own in zip(found, items)]


def _search(text: Column, phrases: Phrases, documents: DataFrame) -> Column:
    shared = documents.sparkSession.sparkContext.broadcast(phrases)

    @F.pandas_udf(RESULT)
    def search(texts: pd.Series) -> pd.DataFrame:
        rows, shard, size = [], [], 0
        for text in texts.fillna(""):
            if shard and size + len(text) > SHARD_CHARS:
                rows += search_shard(shard, shared.value)
                shard, size = [], 0
            shard.append(text)
            size += len(text)
        rows += search_shard(shard, shared.value)
        return pd.DataFrame(rows, columns=["n_words", "items", "spans"])

    return search.asNondeterministic()(text)


def _merged(spans: Column) -> Column:
    """Sorted spans with those joined that touch."""
    empty = F.array().cast("array<struct<start: bigint, end: bigint>>")

    def add(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        touches = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= span["start"])
        return F.when(touches, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(F.array_sort(spans), empty, add)


def find_contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, slice_bytes: int = SLICE_BYTES, into: str = "contamination") -> DataFrame:
    """`documents` with one more column: struct(n_words, items, spans).

    `items` are the ids, as strings and sorted as such, of test items of which some window (of `window` words; all words of a
    shorter item) occurs in the text, `spans` the merged ranges [start, end) of the text's words
    inside any occurrence. A null text has no words; null and empty items match nothing; an item
    with a null id marks words but is no item. Nothing is shuffled: each batch of documents is a
    shard. The items are broadcast in slices of a checked size.
    """
    items = benchmark.select("item_id", "text").where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    slices = max(1, -(-int(size) // slice_bytes))
    names = []
    for k in range(slices):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(slices)) == k) if slices > 1 else items
        phrases = Phrases.of(((r.item_id, r.text) for r in part.toLocalIterator()), window)
        names.append(fresh(documents, f"__found{k}"))
        documents = documents.withColumn(names[-1], _search(F.col("text"), phrases, documents))
    if slices == 1:
        return documents.withColumnRenamed(names[0], into)
    found = F.struct(
        F.col(names[0])["n_words"].alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(n)["items"] for n in names])))).alias("items"),
        _merged(F.flatten(F.array(*[F.col(n)["spans"] for n in names]))).alias("spans"),
    )
    return documents.withColumn(into, found).drop(*names)


def contamination_report(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document.

    Rows that repeat are judged each, a null doc_id stays null, an empty table gives an empty one.
    """
    found = find_contamination(documents.select("doc_id", "text"), benchmark, window)
    items, spans = F.col("contamination.items"), F.col("contamination.spans")
    n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    listed = F.array_join(items, ",")
    return found.select(
        "doc_id", F.col("contamination.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
