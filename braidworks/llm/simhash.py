"""SimHash fingerprints and near-duplicate classes by sharded BK-trees."""

from __future__ import annotations

from itertools import combinations
from math import comb, log2

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bktree import Forest
from .common import cut, fresh, looked_up, release
from .components import connected_components
from .signatures import OddSketches, mix, odd_sketch, signatures

BITS = 64
#: Members that a shard's tree holds at most; shards with more are searched slice against slice.
SHARD_MOST = 1 << 18
#: Distinct fingerprints that a shard should hold on average, at most.
SHARD_FINGERPRINTS = 64


def shingle_hashes(text: str, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of `words` words, repeats included; of the whole sequence if it's shorter."""
    found = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: both touch ASCII only
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    if len(found) > words:
        starts, ends = starts[: 1 - words] if words > 1 else starts, ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    view, h = memoryview(joined), xxhash.xxh64_intdigest
    return np.fromiter((h(view[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """Each bit is 1 if set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[i : i + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: Column, words: int = 4, seed: int = 42) -> Column:
    """The 64-bit SimHash of a text's word shingles, as a signed long. Null and texts without words: zero."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        bits = [majority(shingle_hashes(t, words, seed)) for t in texts.fillna("")]
        return pd.Series(np.array(bits, np.uint64).view(np.int64))

    return simhash.asNondeterministic()(text)


def blocks_for(n: int, radius: int) -> tuple[int, int]:
    """Into how many blocks the bits are cut, and how many of them make a shard's key.

    Two fingerprints that differ in at most `radius` bits agree in at least blocks - radius
    blocks, so they meet in the shard of one choice of these. More rows take longer keys.
    """
    for blocks in range(radius + 1, 2 * radius + 8):
        chosen = blocks - radius
        if log2(max(n, 1) / SHARD_FINGERPRINTS) <= BITS * chosen / blocks or comb(blocks, chosen) > 150:
            return blocks, chosen
    return 2 * radius + 7, radius + 7


def shard_keys(fp: Column, n: int, radius: int) -> Column:
    """Array of the (choice, block values) keys of the shards that a fingerprint belongs to."""
    blocks, chosen = blocks_for(n, radius)
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    value = [F.shiftrightunsigned(fp, a).bitwiseAND((1 << (b - a)) - 1) for a, b in zip(cuts, cuts[1:])]
    keys = []
    for k, choice in enumerate(combinations(range(blocks), chosen)):
        key = F.lit(k).cast("long")
        for i in choice:
            key = F.shiftleft(key, cuts[i + 1] - cuts[i]).bitwiseOR(value[i])
        keys.append(key)
    return F.array(*keys)


def links(fingerprints: DataFrame, radius: int, most: int = SHARD_MOST) -> DataFrame:
    """Edges (a, b) that connect what fingerprints within `radius` bits connect.

    `fingerprints` has one distinct long column `fp`. Each shard becomes a BK-tree in the task that
    holds it; a dense shard yields a star a class, never all its pairs, and no pair is lost
    to the classes. A shard of more than `most` members is cut into slices by a hash; each two slices
    meet in a tree of their own, so no task holds more than that of one shard, however large it is.
    """
    n = fingerprints.count()
    blocks, chosen = blocks_for(n, radius)
    sharded = fingerprints.select("fp", F.explode(shard_keys(F.col("fp"), n, radius)).alias("shard"))
    members = sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > most)  # at most n * comb / most of them
    dense = F.broadcast(members.select(F.col("shard").alias("dense"), F.ceil(2 * F.col("members") / most).cast("long").alias("slices")))
    own = F.pmod(F.xxhash64("fp"), F.col("slices"))
    place = F.transform(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1), lambda j: F.least(own, j) * F.col("slices") + F.greatest(own, j) + 1)
    sliced = sharded.join(dense, F.col("shard") == F.col("dense"), "left")
    sliced = sliced.select("fp", "shard", F.explode(F.when(F.col("slices").isNull(), F.array(F.lit(0).cast("long"))).otherwise(place)).alias("part"))

    def grow(batches):
        tables = list(batches)
        if not tables:
            return
        rows = pa.Table.from_batches(tables)
        shard, part, fp = (rows[c].to_numpy() for c in ("shard", "part", "fp"))
        order = np.lexsort((fp, part, shard))
        shard, part, fp = shard[order], part[order], fp[order]
        same = np.r_[False, (np.diff(shard) == 0) & (np.diff(part) == 0)]
        crowd = same | np.r_[same[1:], False]  # whoever is alone in a shard meets nobody
        group, fp = np.cumsum(~same)[crowd], fp[crowd]
        label = Forest(fp.view(np.uint64).reshape(-1, 1), group, radius).link_all(radius)
        linked = np.flatnonzero(label != np.arange(len(label)))
        yield pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[label[linked]])], names=["a", "b"])

    tasks = max(int(sharded.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * comb(blocks, chosen) >> 20)
    found = sliced.repartition(tasks, "shard", "part").mapInArrow(grow, "a long, b long")
    return found.where("a <> b")


def near_duplicates(documents: DataFrame, radius: int = 4, words: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document.

    component_id is the least doc_id that is reachable over links of at most `radius` differing
    bits. Null texts and texts without words have fingerprint zero and are linked like
    others; rows that repeat are kept; a null doc_id stays null and is no component's id unless all
    ids of the component are null; an empty table gives an empty one; other columns are not read.
    """
    docs = cut(documents.select("doc_id", fingerprint(F.col("text"), words, seed).alias("fp")))
    distinct = cut(docs.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("documents")))
    roots = connected_components(links(distinct.select("fp"), radius))
    rooted = cut(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", "documents", F.coalesce("root", "fp").alias("root")))
    classes = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("fingerprints")))
    of_fp = cut(looked_up(rooted, classes, ["root"], "fingerprints").select("fp", "component_id", "documents"))
    named = looked_up(docs, of_fp, ["fp"], "documents")
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Standard deviations by which the fingerprints of two texts at exactly the least similarity may differ more than expected for large sets. Of pairs of large sets
#: about one in 5 * 10^7 does (binomial tail); small sets of odd and even size differ in more bits: of pairs of 4 and 5 shingles about one in 10^5 is beyond.
SPREAD = 6.0
#: Texts of candidate pairs, as 32 bytes each, or their pairs that are broadcast at most to fetch their shingles; more meet their rows by shuffle.
BROADCAST_TEXTS = 1 << 20
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Shingle signatures that a task of the candidate search takes, about.
TASK_SIGNATURES = 1 << 19
#: Rows that a task of the candidate search hands on at once.
BATCH_ROWS = 1 << 15
#: Rows of an Arrow batch whose texts or sets of hashes are Python's own at once.
SLICE_ROWS = 256
#: Candidate edges that a task holds before it puts them out.
HELD_EDGES = 1 << 20
#: Times as many candidates of another class a text gives in each further search.
NEXT_CANDIDATES = 4


def shingle_set(text: str, words: int) -> np.ndarray:
    """The different hashes of a text's shingles, sorted. A shingle's is made of its words' hashes, so each word is hashed once."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    size = min(words, len(h))
    if not size:
        return h
    rolled = h[: len(h) - size + 1]
    for j in range(1, size):
        rolled = rolled * FACTOR + h[j : len(h) - size + 1 + j]
    return np.unique(mix(rolled))


def wide(own: np.ndarray) -> tuple[int, int]:
    """A 128-bit SimHash of a set of hashes: of themselves, and of themselves mixed."""
    return majority(own), majority(mix(own))


def wide_radius(similarity: float) -> int:
    """Bits in which the 128-bit SimHashes of two sets with this Jaccard similarity or more differ at most, but for chance beyond SPREAD."""
    differ = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(np.ceil(128 * differ + SPREAD * np.sqrt(128 * differ * (1 - differ))))


def _slices(batches):
    """Batches of SLICE_ROWS at most: a batch's texts or sets of hashes take as much memory again once they're Python's own values."""
    for batch in batches:
        yield from (batch.slice(start, SLICE_ROWS) for start in range(0, batch.num_rows, SLICE_ROWS))


def _with_made(rows: DataFrame, of: str, make, **kinds: pa.DataType) -> DataFrame:
    """`rows` with the columns that `make` makes of each value of the column `of`, and without that one. Results leave a task slice by slice."""
    kept = rows.drop(of)

    def run(batches):
        for part in _slices(batches):
            made = zip(*map(make, part[of].to_pylist()))
            yield pa.RecordBatch.from_arrays([*[part[c] for c in names], *map(pa.array, made, kinds.values())], names=[*names, *kinds])

    names, schema = kept.columns, kept.schema
    for name, kind in kinds.items():
        schema = schema.add(name, {pa.int64(): "long", pa.binary(): "binary"}[kind])
    return rows.mapInArrow(run, schema)


def _batches(names: list[str], columns: list[np.ndarray]):
    """Rows in batches of bounded size: what the JVM holds of a task's results outside its heap."""
    for start in range(0, len(columns[0]), BATCH_ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c[start : start + BATCH_ROWS]) for c in columns], names=names)


def shared_signatures(documents: DataFrame, words: int, similarity: float, tasks: int) -> DataFrame:
    """(shard, id, first): the texts of each signature that several different texts have, with the least id of these.

    `documents` has id (a hash of the text) and text. A text that a task has seen before isn't
    dealt again, so however many exact copies there are, few rows leave each task. Copies share many signatures: those
    that the same texts have are one shard, which is a hash of their ids. Should two sets of texts have one hash,
    they'd be one shard together, in which no pair is lost.
    """

    def deal(batches):
        seen: set[int] = set()
        ids, marks, rows = [], [], 0
        for batch in _slices(batches):
            for i, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist()):
                if i in seen:
                    continue
                seen.add(i)
                marks.append(signatures(shingle_set(text, words), similarity))
                ids.append(np.full(len(marks[-1]), i, np.int64))
                rows += len(ids[-1])
                if rows >= BATCH_ROWS:
                    yield from _batches(["signature", "id"], [np.concatenate(marks).view(np.int64), np.concatenate(ids)])
                    ids, marks, rows = [], [], 0
        if ids:
            yield from _batches(["signature", "id"], [np.concatenate(marks).view(np.int64), np.concatenate(ids)])

    def meet(batches):
        held = [(b["signature"].to_numpy(), b["id"].to_numpy()) for b in batches]
        if not held:
            return
        mark, ids = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((ids, mark))
        mark, ids = mark[order], ids[order]
        same = np.r_[False, mark[1:] == mark[:-1]]
        new = ~(same & np.r_[False, ids[1:] == ids[:-1]])
        mark, ids, same = mark[new], ids[new], same[new]
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(mark))))
        crowd = same | np.r_[same[1:], False]
        ids, first, same = ids[crowd], ids[first[crowd]], same[crowd]
        heads = np.flatnonzero(~same)
        shard = mix(np.add.reduceat(mix(ids.view(np.uint64)), heads)).view(np.int64)
        yield from _batches(["shard", "id", "first"], [np.repeat(shard, np.diff(np.r_[heads, len(ids)])), ids, first])

    dealt = documents.select("id", "text").mapInArrow(deal, "signature long, id long")
    return dealt.repartition(tasks, "signature").mapInArrow(meet, "shard long, id long, first long").distinct()


def nearest_of_classes(texts: DataFrame, radius: int, similarity: float, most: int, tasks: int) -> DataFrame:
    """Candidate edges (a, b, d) among `texts` (shard, id, fp0, fp1, size, odd, class).

    Of a shard's texts, those of another class whose fingerprints differ in d bits, up to `radius`, and whose odd sketches let them be similar.

    A shard's BK-tree is searched for each of its texts. With a `most` of 0 a text gives its nearest one of
    another class alone, so there are no more edges than texts in shards. Else it gives the `most` nearest of every
    other class in the shard; where that leaves out a pair from both sides, an edge with a d of -1 joins some text
    of each of the two classes, which are to be searched again with a larger `most`.
    """

    def grow(batches):
        held = list(batches)
        if not held:
            return
        rows = pa.Table.from_batches(held)
        mark, ids, classes = (rows[c].to_numpy() for c in ("shard", "id", "class"))
        words = np.stack([rows[name].to_numpy().view(np.uint64) for name in ("fp0", "fp1")], axis=1)
        order = np.lexsort((ids, classes, mark))
        mark, ids, classes, words = mark[order], ids[order], classes[order], words[order]
        same = np.r_[False, (np.diff(mark) == 0) & (np.diff(classes) == 0)]
        label = np.maximum.accumulate(np.where(same, 0, np.arange(len(mark))))
        forest = Forest(words, mark, -1, label)
        sketches = OddSketches(rows["odd"].take(pa.array(order)).to_pylist(), rows["size"].to_numpy()[order])

        def edges(parts):  # each once: a pair meets from both sides, and in several shards
            a, b, d = np.unique(np.concatenate(parts, axis=1), axis=1)
            return _batches(["a", "b", "d"], [a, b, d.astype(np.int32)])

        left_out, kept = [np.zeros((0, 2), np.int64)], []  # (class, other class) of lists that were cut; edges so far
        for start in range(0, len(ids), 4096):
            found = []
            for q, node, d in forest.search(np.arange(start, min(len(ids), start + 4096)), radius):
                good = sketches.may_be_similar(q, node, similarity)
                if good.any():
                    found.append((q[good], node[good], d[good]))
            if not found:
                continue
            q, node, d = (np.concatenate(x) for x in zip(*found))
            by = np.lexsort((d, label[node], q) if most else (ids[node], d, q))
            q, node, d = q[by], node[by], d[by]
            head = np.r_[True, (q[1:] != q[:-1]) | ((label[node][1:] != label[node][:-1]) if most else False)]
            rank = np.arange(len(q)) - np.maximum.accumulate(np.where(head, np.arange(len(q)), 0))
            near, over = rank < max(most, 1), (rank == most) & (most > 0)
            left_out.append(np.unique(np.stack([label[q[over]], label[node[over]]], axis=1), axis=0))
            kept.append(np.stack([np.maximum(ids[q[near]], ids[node[near]]), np.minimum(ids[q[near]], ids[node[near]]), d[near]]))
            if sum(k.shape[1] for k in kept) > HELD_EDGES:
                yield from edges(kept)
                kept = []
        if kept:
            yield from edges(kept)
        a, b = np.unique(np.concatenate(left_out), axis=0).T
        both = (a < b) & np.isin(a * len(ids) + b, b * len(ids) + a)  # cut from one side only, the other side gave all
        yield from edges([np.stack([np.maximum(ids[a], ids[b]), np.minimum(ids[a], ids[b]), np.full(len(a), -1)])[:, both]])

    found = texts.select("shard", "id", "fp0", "fp1", "size", "odd", "class").repartition(tasks, "shard").mapInArrow(grow, "a long, b long, d int")
    return found.groupBy("a", "b").agg(F.max("d").alias("d"), F.min("d").alias("least_d"))


def similarity_of(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two sorted sets of hashes; two empty sets are equal."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def drop_near_duplicates(documents: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Of each class of near copies, the document with the least doc_id; all columns.

    Two texts are linked if the Jaccard similarity of their sets of word shingles is at least
    `similarity`, and classes are connected components. Any two such texts share a signature (see
    signatures.py), so the texts of a signature are a shard, once for all signatures that the same texts have. First each shard's texts are compared with one of them, which joins
    nearly all copies. In the shards that still hold several classes, BK-trees of 128-bit SimHash fingerprints find
    each text's nearest one of another class, and then all within the radius that SPREAD gives, until nothing of these is
    left unchecked between two classes (a pair beyond the radius is missed: SPREAD says how often); odd sketches leave out nearly all that isn't similar and nothing that is. Each candidate
    is checked on the whole texts. Signatures are less than one a shingle whatever the number of texts.

    Null texts are empty; texts without words are near copies of each
    other; a null doc_id comes last in its class; of rows that repeat one stays.
    """
    radius = wide_radius(similarity)

    def described(text: str) -> tuple[int, int, int, bytes]:
        own = shingle_set(text, words)
        return *np.array(wide(own), np.uint64).view(np.int64).tolist(), len(own), odd_sketch(own)

    def hashes(text: str) -> tuple[bytes]:
        return (shingle_set(text, words).astype("<u8").tobytes(),)

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series, a_size: pd.Series, b_size: pd.Series) -> pd.Series:
        n = np.arange(len(a))
        both = OddSketches([*a, *b], np.concatenate([a_size, b_size])) if len(a) else None
        return pd.Series(both.may_be_similar(n, n + len(a), similarity) if len(a) else [], dtype=bool)

    def similar(batches):
        for part in _slices(batches):
            yield part.filter(pa.array([similarity_of(x, y) >= similarity for x, y in zip(part["sa"].to_pylist(), part["sb"].to_pylist())], pa.bool_())).select(["a", "b"])

    text = F.coalesce(F.col("text"), F.lit(""))
    h0, h1, least, rows = (fresh(documents, name) for name in ("__h0", "__h1", "__least", "__rows"))
    keys = [F.xxhash64(text).alias(h0), F.xxhash64(F.lit(1), text).alias(h1)]  # together they name a text; h0 alone names it well enough for candidates
    facts = {"fp0": pa.int64(), "fp1": pa.int64(), "size": pa.int64(), "odd": pa.binary()}
    hashed = _with_made(documents.select("doc_id", *keys, text.alias("__text")), "__text", described, **facts)
    hashed = hashed.groupBy(h0, h1, "doc_id").agg(F.any_value(F.struct(*facts)).alias("w"), F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id")
    texts = hashed.groupBy(h0, h1).agg(F.min_by(F.struct("doc_id", "n"), order).alias("l"), F.any_value("w").alias("w"))
    texts = cut(texts.select(h0, h1, F.col("l.doc_id").alias("least"), F.col("l.n").alias("rows"), "w.fp0", "w.fp1", "w.size", "w.odd").withColumn("id", F.monotonically_increasing_id()))
    release(documents.sparkSession)
    tasks = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), (texts.agg(F.sum("size")).first()[0] or 0) // TASK_SIGNATURES)
    shards = cut(shared_signatures(documents.select(keys[0].alias("id"), text.alias("text")), words, similarity, tasks))
    release(documents.sparkSession)  # the signatures' shuffle is the largest there is
    facts = ["id", *facts]
    ends = {side: texts.select(F.col(h0).alias(side + "_hash"), *[F.col(c).alias(side if c == "id" else f"{side}_{c}") for c in facts]) for side in ("a", "b")}

    def may_be_similar(pairs: DataFrame) -> DataFrame:
        """(a, b) as numbers of texts, of pairs of hashes, as far as sizes, fingerprints and sketches let them be similar."""
        both = pairs.join(ends["a"], "a_hash").join(ends["b"], "b_hash").where("a <> b")
        sized = F.least("a_size", "b_size") >= F.greatest("a_size", "b_size") * similarity - 1e-6
        bits = sum((F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in ("fp0", "fp1")), F.lit(0))
        return both.where(sized & (bits <= radius)).where(near("a_odd", "b_odd", "a_size", "b_size")).select("a", "b")

    def whole(ids: DataFrame, held: Column) -> DataFrame:
        """`ids` (id and other columns) with the text's shingles, as often as the text's row is there. `held`: ids that a row of `ids` holds."""
        named = cut(ids.join(texts, "id").select(*ids.columns, h0, h1, "least"))
        named = F.broadcast(named) if (named.agg(F.sum(held)).first()[0] or 0) <= BROADCAST_TEXTS else named
        rows = documents.select(*keys, "doc_id", text.alias("__text")).join(named, [h0, h1]).where(F.col("doc_id").eqNullSafe(F.col("least")))
        return _with_made(rows.select(*ids.columns, "__text"), "__text", hashes, shingles=pa.binary())

    def checked(some: DataFrame) -> DataFrame:
        """The pairs (a, b) that are similar, by their whole texts. Shingles are stored for each b alone; those of an a go straight to its pairs."""
        some = cut(some)
        seconds = cut(whole(some.select(F.col("b").alias("id")).distinct(), F.lit(1)).groupBy("id").agg(F.any_value("shingles").alias("sb")).withColumnRenamed("id", "b"))
        release(documents.sparkSession)
        firsts = whole(some.groupBy(F.col("a").alias("id")).agg(F.collect_list("b").alias("others")), F.size("others"))
        pairs = firsts.select(F.col("id").alias("a"), F.explode("others").alias("b"), F.col("shingles").alias("sa"))
        return cut(pairs.join(seconds, "b").select("a", "b", "sa", "sb").mapInArrow(similar, "a long, b long").distinct())

    seen = cut(may_be_similar(shards.where("id <> first").select(F.col("id").alias("a_hash"), F.col("first").alias("b_hash")).distinct()))
    same_hash = texts.groupBy(h0).agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("a", "b")  # two texts of one hash, if ever
    linked, most, open_ = checked(seen.unionByName(same_hash)), 0, None
    while True:
        roots = cut(connected_components(linked))
        class_of = texts.join(roots, texts.id == roots.node, "left").select(h0, "id", F.coalesce("root", "id").alias("class"))
        if open_ is not None:
            class_of = class_of.join(open_, "class", "left_semi")
        placed = shards.select("shard", F.col("id").alias(h0)).join(class_of, h0).drop(h0)
        mixed = placed.groupBy("shard").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("shard")
        searched = placed.join(mixed, "shard", "left_semi").join(texts.select(*facts), "id")  # sketches come last: they're shuffled once a shard that is searched
        some = cut(nearest_of_classes(searched, radius, similarity, most, tasks))
        pairs = some.where("d >= 0").select("a", "b").join(seen.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), ["a", "b"], "left_anti")
        new = cut(pairs)
        linked = linked.unionByName(checked(new))
        if not most:  # a crowd whose members are alike, but not like the first of their shards, is far fewer classes now
            seen, most = seen.unionByName(new), 1
            continue
        roots = cut(connected_components(linked))
        ends_of = [roots.select(F.col("node").alias(side), F.col("root").alias("r" + side)) for side in ("a", "b")]
        left = some.where("least_d < 0").join(ends_of[0], "a", "left").join(ends_of[1], "b", "left").select(F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb")).where("ra <> rb")
        open_ = cut(left.select(F.explode(F.array("ra", "rb")).alias("class")).distinct())
        if open_.isEmpty():
            break
        seen, most = seen.unionByName(new), most * NEXT_CANDIDATES
    rooted = texts.join(roots, texts.id == roots.node, "left").select(h0, h1, "least", "rows", "id", F.coalesce("root", "id").alias("root"))
    first = F.struct(F.col("least").isNull(), F.col("least"), F.col("id"))
    kept = rooted.groupBy("root").agg(F.min_by(F.struct(h0, h1, "least", "rows"), first).alias("k")).select(f"k.{h0}", f"k.{h1}", F.col("k.least").alias(least), F.col("k.rows").alias(rows))
    marked = documents.withColumns({h0: keys[0], h1: keys[1]}).join(kept, [h0, h1]).where(F.col("doc_id").eqNullSafe(F.col(least)))
    repeated = marked.where(F.col(rows) > 1).dropDuplicates([h0, h1])  # the same id and text more than once
    return marked.where(F.col(rows) == 1).unionByName(repeated).select(*[F.col(f"`{c}`") for c in documents.columns])
