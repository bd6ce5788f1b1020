"""Text operators against brute force on small tables with nulls, repeats, ties, odd characters and clashing columns."""

import hashlib
import json
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from braidworks.llm.signatures import OddSketches, odd_sketch, signatures
from braidworks.llm import bktree, components, decontaminate, fmindex, packing, prefixhash, simhash, tokens

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a", "b", "The", " ", "  ", "\n", "\t", "\x1c", "\x1f", "​", "᠎", "\xa0", "　", "é", "1", "22", "'s", "'", ".", "!!", "<|endoftext|>", "<|endof", "日本", "́", "🙂", "\x85", "\x00"]


def documents(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clash = ["fingerprint", "start", "score", "run", "shard", "n", "fp", "key", "held_out", "__h0", "kind", "bound", "contamination"]
    return df.withColumns({c: F.lit("x") for c in clash}) if extra else df


def odd_texts(n, seed=1, most=60):
    draw = random.Random(seed)
    return ["".join(draw.choice(ODD) for _ in range(draw.randint(0, most))) for _ in range(n)]


# Tokens and packing.


def test_chunks_splice_to_the_librarys_ids():
    library, encoder = Tokenizer.from_file(VOCABULARY), tokens.Encoder(VOCABULARY)
    assert encoder.fast is not None
    slow = tokens.Encoder(VOCABULARY)
    slow.fast = None
    for text in odd_texts(600):
        expected = library.encode(text, add_special_tokens=False).ids
        for chunk, overlap in ((1 << 20, 9), (8, 2), (20, 5)):
            assert tokens.encode(encoder, text, chunk, overlap).tolist() == expected
            assert tokens.encode(slow, text, chunk, overlap).tolist() == expected


def test_a_run_without_white_space_widens_to_the_whole():
    encoder = tokens.Encoder(VOCABULARY)
    text = "abcdé" * 400 + " end"
    assert tokens.encode(encoder, text, 64, 4).tolist() == encoder.ids(text).tolist()


def test_other_vocabularies_have_no_stable_places():
    with open(VOCABULARY, encoding="utf-8") as file:
        settings = json.load(file)
    assert tokens.is_plain(settings)
    model, split, special = settings["model"], settings["pre_tokenizer"], settings["added_tokens"][0]
    swapped = [model["merges"][1], model["merges"][0], *model["merges"][2:]]
    for other in (
        {"normalizer": {"type": "NFC"}}, {"pre_tokenizer": split | {"add_prefix_space": True}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": model | {"ignore_merges": True}},
        {"model": model | {"merges": swapped}}, {"added_tokens": [special | {"lstrip": True}]}, {"added_tokens": [special | {"content": "a b"}]},
    ):
        assert not tokens.is_plain(settings | other)
    path = public_tokenizers.path("word_bpe_49k.json")
    library, encoder = Tokenizer.from_file(path), tokens.Encoder(path)
    assert not encoder.plain and encoder.fast is None
    for text in odd_texts(60, most=200):
        assert tokens.encode(encoder, text, 20, 5).tolist() == library.encode(text, add_special_tokens=False).ids


def test_token_counts(spark):
    texts = [None, "", *odd_texts(30), "word " * 9000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1, ""), (None, "x")]
    got = sorted(map(tuple, tokens.count_tokens(documents(spark, rows), VOCABULARY).collect()), key=repr)
    library = Tokenizer.from_file(VOCABULARY)
    size = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    assert got == sorted(((i, len((t or "").encode()), size(t), size(t) > 512) for i, t in rows), key=repr)
    assert tokens.count_tokens(documents(spark, []), VOCABULARY).count() == 0


def test_sentencepiece_counts(spark):
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    got = tokens.count_tokens(documents(spark, [(1, "a b  c"), (2, None)]), model).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {1: len(library.encode("a b  c")), 2: 0}


def first_fit(lengths, capacity):
    bins, out = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = next((k for k, used in enumerate(bins) if used + lengths[i] <= capacity), len(bins))
        if b == len(bins):
            bins.append(0)
        out[i] = (b, bins[b])
        bins[b] += lengths[i]
    return [out[i] for i in range(len(lengths))]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 300])
def test_tournament_tree_is_first_fit(n):
    draw = np.random.default_rng(n)
    lengths = draw.integers(1, 101, n)
    bins, offsets = packing.first_fit_decreasing(lengths, 100)
    assert list(zip(bins.tolist(), offsets.tolist())) == first_fit(lengths.tolist(), 100)


def test_packing_keeps_every_id_once(spark):
    rows = [(i, t) for i, t in enumerate([None, "", *odd_texts(60), "many words here " * 2000])] + [(3, "twice"), (3, "twice"), (None, "nobody")]
    got = packing.pack_documents(documents(spark, rows), VOCABULARY, capacity=64).collect()
    library = Tokenizer.from_file(VOCABULARY)
    expected, found, places = [], {}, {}
    for i, t in rows:
        expected.append((i, (*library.encode(t or "", add_special_tokens=False).ids, 0)))
    for r in got:
        ids = struct.unpack(f"<{r.length}I", r.ids)
        assert r.ids_crc32 == zlib.crc32(r.ids) and 0 < r.length <= 64
        found.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, ids))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    whole = sorted((i, n) for (i, n), parts in found.items() for _ in range(sum(s == 0 for s, _ in parts)) if i is not None)
    assert whole == sorted((i, len(ids)) for i, ids in expected if i is not None)
    joined = {i: ids for i, ids in expected if sum(j == i for j, _ in expected) == 1}
    for (i, _), parts in found.items():
        if i in joined:
            assert sum((ids for _, ids in sorted(parts)), ()) == joined[i]
    assert packing.pack_documents(documents(spark, []), VOCABULARY).count() == 0


def test_packing_keeps_columns_of_any_name(spark):
    pieces = spark.createDataFrame([(i, 0, 1 + i % 9) for i in range(50)], "doc_id long, start long, length long").withColumns({c: F.lit(c) for c in ("__nth", "__group", "_", "n")})
    got = packing.place(pieces, 16, 20)
    assert got.columns == [*pieces.columns, "sequence_id", "offset"]
    assert {(r["__nth"], r["__group"]) for r in got.collect()} == {("__nth", "__group")} and got.count() == 50


# Fingerprints.


def brute_fingerprint(text, k=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(items, linked):
    label = {i: i for i in items}
    while True:
        new = {i: min(label[j] for j in items if j == i or linked(i, j)) for i in items}
        if new == label:
            return label
        label = new


def test_near_duplicates_match_all_pairs(spark):
    draw = random.Random(8)
    base = [" ".join(draw.choice(["one", "two", "three", "ÄB", "c", "d", "e"]) for _ in range(draw.randint(0, 60))) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(base)]
    for t in base:
        w = t.split() + ["x"]
        w[draw.randrange(len(w))] = "y"
        rows.append((100 + len(rows), " ".join(w)))
        rows.append((100 + len(rows), t.upper()))
    rows += [(900, None), (901, "\x1f"), (902, " \n"), (903, ""), (5, base[5])]
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    fps = {i: brute_fingerprint(t) for i, t in rows}
    label = classes(set(fps), lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 4)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{fps[i]:016x}", label[i]) for i, _ in rows)
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


@pytest.mark.parametrize("n", [1000, 10**6, 10**8, 10**10])
def test_blocks_miss_no_link(spark, n):
    draw = random.Random(n)
    rows = []
    for i in range(300):
        a = draw.getrandbits(64)
        b = a
        for bit in draw.sample(range(64), draw.randint(0, 4)):
            b ^= 1 << bit
        rows.append((i, *(x - (1 << 64) if x >> 63 else x for x in (a, b))))
    pairs = spark.createDataFrame(rows, "i int, a long, b long")
    met = pairs.where(F.arrays_overlap(simhash.shard_keys(F.col("a"), n, 4), simhash.shard_keys(F.col("b"), n, 4)))
    assert met.count() == 300


def test_forest_joins_what_all_pairs_join():
    draw = np.random.default_rng(0)
    base = draw.integers(0, 2**63, 120, dtype=np.uint64)
    parts = [base]
    for _ in range(8):
        x = base[:40].copy()
        for _ in range(3):
            x ^= np.uint64(1) << draw.integers(0, 64, 40).astype(np.uint64)
        parts.append(x)
    words = np.unique(np.concatenate(parts))
    shard = np.sort(draw.integers(0, 3, len(words)))
    label = bktree.Forest(words.reshape(-1, 1), shard, 4).link_all(4)
    near = (np.bitwise_count(words[:, None] ^ words) <= 4) & (shard[:, None] == shard)
    assert label.tolist() == list(classes(range(len(words)), lambda i, j: near[i, j]).values())


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 200), (300, 300)]
    draw = random.Random(1)
    names = list(range(400))
    draw.shuffle(names)
    edges = [(names[a], names[b]) for a, b in edges]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    linked = {frozenset(e) for e in edges}
    assert got == classes(nodes, lambda i, j: frozenset((i, j)) in linked)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text, k=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_near_dedup_keeps_one_of_each_class(spark):
    draw = random.Random(11)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    rows = []
    for g in range(30):
        base = [word() for _ in range(draw.randint(80, 300))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(draw.randint(0, 3)):
            copy = list(base)
            for _ in range(draw.choice([0, 1, 2, 30])):
                copy[draw.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
    rows += [(0, rows[0][1]), (700, None), (701, ""), (702, " "), (None, "lonely text of nobody at all here")]
    docs = documents(spark, rows)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    sets = {i: shingles(t) for i, t in rows if i is not None}
    label = classes(set(sets), lambda i, j: jaccard(sets[i], sets[j]) >= 0.8)
    got = [r.doc_id for r in kept.collect()]
    assert sorted(got, key=repr) == sorted([*set(label.values()), None], key=repr)
    assert simhash.drop_near_duplicates(documents(spark, [])).count() == 0


def two_classes(seed):
    """Near copies of two texts: these have a Jaccard similarity of 270 / 330, and no other pair across reaches 0.8."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(8))
    base = [word() for _ in range(304)]
    places = draw.sample(range(5, 295, 10), 28)
    changed = lambda text, at: [word() if i in at else w for i, w in enumerate(text)]
    other = changed(base, places[:6])
    texts = [base, *(changed(base, [i]) for i in places[6:17]), other, *(changed(other, [i]) for i in places[17:])]
    return [" ".join(t) for t in texts]


def test_large_classes_are_joined_by_a_single_borderline_pair(spark):
    rows = [(100 * g + i, t) for g in range(12) for i, t in enumerate(two_classes(g))]
    first = [shingles(t) for _, t in rows[:24]]
    assert [(i, j) for i in range(12) for j in range(12, 24) if jaccard(first[i], first[j]) >= 0.8] == [(0, 12)]
    kept = simhash.drop_near_duplicates(documents(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == [100 * g for g in range(12)]


def test_similar_sets_share_a_signature():
    draw = np.random.default_rng(5)
    seen = 0
    for _ in range(6000):
        a = draw.integers(0, 2**64, int(draw.choice([1, 2, 3, 4, 5, 7, 9, 12, 17, 25, 40, 80, 250])) + int(draw.integers(0, 6)), dtype=np.uint64)
        b = np.concatenate([a[draw.integers(0, len(a) // 4 + 1) :], draw.integers(0, 2**64, draw.integers(0, len(a) // 4 + 1), dtype=np.uint64)])
        both = len(np.intersect1d(a, b))
        if both >= 0.8 * (len(a) + len(b) - both):
            seen += 1
            assert len(np.intersect1d(signatures(np.sort(a), 0.8), signatures(np.sort(b), 0.8)))
    assert seen > 2000
    assert len(signatures(np.zeros(0, np.uint64), 0.8)) == 1
    assert len(signatures(np.sort(draw.integers(0, 2**64, 10**5, dtype=np.uint64)), 0.8)) < 0.8 * 10**5


def test_odd_sketches_leave_out_no_similar_pair():
    draw = np.random.default_rng(12)
    sets = []
    for n in (0, 1, 5, 60, 250, 260, 1000, 1100):
        base = np.unique(draw.integers(0, 2**64, n, dtype=np.uint64))
        sets += [base] + [np.unique(np.r_[base[draw.integers(0, n // 4 + 1) :], draw.integers(0, 2**64, draw.integers(0, n // 4 + 1), dtype=np.uint64)]) for _ in range(6)]
    a, b = (x.ravel() for x in np.indices((len(sets), len(sets))))
    got = OddSketches([odd_sketch(s) for s in sets], np.array([len(s) for s in sets])).may_be_similar(a, b, 0.8)
    true = np.array([jaccard(set(sets[i].tolist()), set(sets[j].tolist())) for i, j in zip(a, b)])
    assert got[true >= 0.8].all() and not got[true < 0.6].any() and got.sum() < 1.3 * (true >= 0.8).sum()


def test_a_crowd_of_near_copies_gives_a_star(spark):
    draw = random.Random(3)
    base = ["".join(draw.choice("abcdefgh") for _ in range(8)) for _ in range(200)]
    rows = []
    for i in range(800):
        copy = list(base)
        copy[draw.randrange(200)] = f"x{i % 300}"
        rows += [(i, " ".join(copy))] * (1 + i % 2)
    shards = simhash.shared_signatures(spark.createDataFrame(rows, "id long, text string"), 5, 0.8, 8)
    edges = shards.where("id <> first").select("id", "first").distinct()
    assert 799 <= edges.count() < 800 * 12
    assert {r.root for r in components.connected_components(edges.toDF("a", "b")).collect()} == {0}
    assert simhash.drop_near_duplicates(documents(spark, rows)).count() == 1


def test_signatures_of_the_same_texts_are_one_shard(spark):
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base), " ".join([*base[:20], "x", *base[21:]]), " ".join([*base[:180], "y", *base[181:]]), "one two three four five six"]
    rows = simhash.shared_signatures(spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(2), 5, 0.8, 8).collect()
    members: dict = {}
    for shard, i, first in rows:
        members.setdefault(shard, []).append(i)
    sets = [tuple(sorted(ids)) for ids in members.values()]
    assert len(sets) == len(set(sets)) and (0, 1, 2) in sets and all(1 < len(ids) == len(set(ids)) for ids in sets)
    assert {(i, first) for _, i, first in rows} >= {(1, 0), (2, 0)} and all(first == min(members[shard]) for shard, _, first in rows)


def test_near_dedup_stores_shingles_of_one_side_of_its_pairs(spark, monkeypatch):
    stored, cut = [], simhash.cut

    def seen(df):
        done = cut(df)
        if any(kind == "binary" for c, kind in done.dtypes if c != "odd"):
            stored.append(done.count())
        return done

    monkeypatch.setattr(simhash, "cut", seen)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*base, *(f"x{j}" for j in range(i))])) for i in range(20)]
    assert [r.doc_id for r in simhash.drop_near_duplicates(documents(spark, rows)).collect()] == [0]
    assert 0 < max(stored) < 19


def test_near_dedup_matches_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    sets = {i: shingles(t) for i, t in rows}
    ids, owners = list(sets), {}
    for i in ids:
        for s in sets[i]:
            owners.setdefault(s, []).append(i)
    linked = {(i, j) for own in owners.values() for i in own for j in own if i < j}  # pairs with a shingle in common: all that can be similar
    linked = [(i, j) for i, j in linked if jaccard(sets[i], sets[j]) >= 0.8]
    label = {i: i for i in ids}
    for _ in ids:
        new = dict(label)
        for i, j in linked:
            new[i] = new[j] = min(new[i], new[j])
        if new == label:
            break
        label = new
    kept = simhash.drop_near_duplicates(documents(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label.values()))


def test_dense_shards_are_searched_slice_against_slice(spark):
    draw = random.Random(9)
    near = sorted({draw.getrandbits(5) << 40 | draw.getrandbits(6) << 3 | 7 for _ in range(400)})
    fps = spark.createDataFrame([(x,) for x in near], "fp long")
    for most in (1 << 18, 24):
        roots = components.connected_components(simhash.links(fps, 4, most))
        label = classes(near, lambda i, j: bin(i ^ j).count("1") <= 4)
        assert {r.node: r.root for r in roots.collect()} == {i: r for i, r in label.items() if sum(x == r for x in label.values()) > 1}


# Prefix hashes.


def test_extensions_match_a_scan():
    draw = random.Random(1)
    for _ in range(400):
        a = "".join(draw.choice("ab") for _ in range(draw.randint(0, 20)))
        b = draw.choice([a, a[:5] + "x" + a[5:], "".join(draw.choice("ab") for _ in range(draw.randint(0, 20)))])
        x, y = prefixhash.PrefixHashes(a), prefixhash.PrefixHashes(b)
        i, j = draw.randint(0, len(a)), draw.randint(0, len(b))
        e = next((k for k in range(30) if a[i + k : i + k + 1] != b[j + k : j + k + 1] or i + k >= len(a)), 0)
        assert x.extension(i, y, j) == e
        back = next(k for k in range(30) if k >= min(i, j) or a[i - 1 - k] != b[j - 1 - k])
        assert x.extension_left(i, y, j) == back
        assert (x.fingerprint == y.fingerprint) == (a == b)
        half = draw.randint(0, len(b))
        assert x.spliced(i, y, half).fingerprint == prefixhash.PrefixHashes(a[:i] + b[:half]).fingerprint


@pytest.mark.parametrize("range_bytes", [80, 1 << 26])
def test_edits_of_neighbours(spark, range_bytes):
    texts = [None, "", "🙂é", *odd_texts(40), "same text", "same text"]
    rows = [(i * i - 50, t) for i, t in enumerate(texts)]
    shuffled = rows[::2] + rows[1::2]
    got = {r.doc_id: r for r in prefixhash.compare_with_edits(documents(spark, shuffled), range_bytes).collect()}
    assert len(got) == len(rows)
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        t, after, r = t or "", after or "", got[i]
        edit = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
        assert (r.fingerprint == r.edited_fingerprint) == (t == edit) and (r.near_edited == 1) == (t == edit) and (r.near_next == 1) == (t == after)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if len(t) > 2:
            assert r.near_edited >= 0.45 * min(1, len(edit) / len(t))
        same = next((k for k in range(len(t) + 1) if t[k : k + 1] != after[k : k + 1] or k == len(t)), 0)
        assert r.near_next >= same / max(1, len(t), len(after)) - 1e-12


def test_single_empty_and_null_ids(spark):
    assert prefixhash.compare_with_edits(documents(spark, [])).count() == 0
    only = prefixhash.compare_with_edits(documents(spark, [(4, "abcd")])).first()
    assert only.near_next == 1 and only.edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    got = prefixhash.compare_with_edits(documents(spark, [(2, "x"), (None, "y"), (2, "x")])).collect()
    assert sorted((r.doc_id for r in got), key=repr) == [2, 2, None]


def test_one_id_and_very_long_texts_are_whole(spark):
    rows = [(7, f"text {i % 50}") for i in range(400)]
    got = prefixhash.compare_with_edits(documents(spark, rows), 200).collect()
    assert len(got) == 400 and {r.doc_id for r in got} == {7} and sum(r.near_next == 1 for r in got) >= 350
    long = ["ab c" * 500_000, "ab c" * 499_999 + "x"]
    a, b = prefixhash.compare_with_edits(documents(spark, list(enumerate(long)))).orderBy("doc_id").collect()
    assert (a.n_chars, b.n_chars) == (2_000_000, 1_999_997) and a.near_next > 0.99 and b.near_next > 0.99
    assert a.edited_sha256 == hashlib.sha256((long[0][:1_000_000] + long[1][:1_000_000]).encode()).hexdigest()
    prefixhash.Powers.upto(prefixhash.Powers.KEPT + 5)
    assert prefixhash.Powers.upto(3).shape[1] == prefixhash.Powers.KEPT


# Decontamination.


def test_fm_index_counts_and_locates():
    draw = np.random.default_rng(2)
    text = draw.integers(1, 4, 400)
    text[[57, 123, 124, 399]] = 0
    index = fmindex.FMIndex(text.astype(np.int64), 2)
    for k in (1, 2, 5):
        phrases = draw.integers(1, 4, (40, k))
        low, high = index.find(phrases.astype(np.int64), np.full(40, k))
        for p, a, b in zip(phrases, low, high):
            expected = [i for i in range(400 - k + 1) if (text[i : i + k] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == expected


def brute_contamination(text, items, k):
    words, hit, found = decontaminate.words_of(text or ""), set(), set()
    for item, passage in items:
        w = decontaminate.words_of(passage or "")
        for j in range(max(1, len(w) - k + 1) if w else 0):
            window = w[j : j + k]
            for q in range(len(words) - len(window) + 1):
                if words[q : q + len(window)] == window:
                    hit.update(range(q, q + len(window)))
                    found.add(str(item))
    return len(words), sorted(found), hit


@pytest.mark.parametrize("slice_bytes", [1 << 20, 20])
def test_contamination_matches_a_scan(spark, slice_bytes):
    draw = random.Random(3)
    say = lambda vocabulary, n: " ".join(draw.choice(vocabulary) for _ in range(n))
    items = [(i, say(["A", "b", "ü", "d7"], draw.randint(0, 8))) for i in range(7)] + [(90, None), (3, "zz")]
    rows = [(i, say(["a", "B", "Ü", "ü", "d7", "zz"], draw.randint(0, 70))) for i in range(40)] + [(50, None), (51, ""), (52, "!?"), (None, "A b ü d7"), (1, "zz")]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("n_words", F.lit(1))
    found = decontaminate.find_contamination(documents(spark, rows), benchmark, window=4, slice_bytes=slice_bytes, into="found").select("text", "found").collect()
    assert len(found) == len(rows)
    for r in found:
        n, expected, hit = brute_contamination(r.text, items, 4)
        covered = [x for s in r.found.spans for x in range(s.start, s.end)]
        assert (r.found.n_words, list(r.found["items"]), covered) == (n, expected, sorted(hit))
        assert all(a.end < b.start for a, b in zip(r.found.spans, r.found.spans[1:]))


def test_item_ids_of_any_kind_sort_as_strings(spark):
    for kind, ids in (("string", ["b/2", "b/10", "a"]), ("long", [(1 << 62) + 1, 9, 10])):
        items = spark.createDataFrame([(i, "same old words") for i in ids] + [(None, "same old words")], f"item_id {kind}, text string")
        got = decontaminate.contamination_report(documents(spark, [(1, "the same old words"), (2, "x " * 200_000 + "same old words")]), items).collect()
        expected = ",".join(sorted(map(str, ids)))
        assert {(r.n_items, r.n_hit, r.items_sha256) for r in got} == {(3, 3, hashlib.sha256(expected.encode()).hexdigest())}


def test_equal_windows_are_one(spark):
    draw = random.Random(6)
    items = [(i, " ".join(draw.choice("ab") for _ in range(draw.randint(0, 14)))) for i in range(30)]
    phrases = decontaminate.Phrases.of(items, 5)
    owners = {}
    for i, t in items:
        w = t.split()
        for k in range(max(1, len(w) - 4) if w else 0):
            owners.setdefault(tuple(w[k : k + 5]), set()).add(str(i))
    word = {n: w.decode() for w, n in phrases.vocabulary.items()}
    got = {}
    for i, (a, n) in enumerate(zip(phrases.starts, phrases.lengths)):
        got[tuple(word[x] for x in phrases.symbols[a : a + n])] = {phrases.names[k] for k in phrases.item[phrases.first[i] : phrases.first[i + 1]]}
    assert got == owners and len(phrases.starts) == len(owners)


def test_contamination_report_of_no_rows_and_no_items(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.contamination_report(documents(spark, [(1, "a b")]), none).first()
    assert (got.n_words, got.n_hit, got.n_items, got.items_sha256, got.contaminated) == (2, 0, 0, hashlib.sha256(b"").hexdigest(), False)
    assert decontaminate.contamination_report(documents(spark, []), none).count() == 0


def test_sets_of_hashes_are_made_slice_by_slice(spark):
    import pyarrow as pa

    n = 2 * simhash.SLICE_ROWS + 3
    parts = list(simhash._slices([pa.RecordBatch.from_pydict({"x": list(range(n))})]))
    assert [p.num_rows for p in parts] == [simhash.SLICE_ROWS, simhash.SLICE_ROWS, 3] and [x for p in parts for x in p["x"].to_pylist()] == list(range(n))
    rows = spark.range(n).select(F.nullif("id", F.lit(5)).alias("doc_id"), F.concat(F.lit("a b c d e "), "id").alias("t")).coalesce(1)
    made = simhash._with_made(rows, "t", lambda t: (len(t), t.encode()), size=pa.int64(), raw=pa.binary())
    assert made.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("raw", "binary")]
    assert [(r.doc_id, r["size"], bytes(r.raw)) for r in made.collect()] == [(i if i != 5 else None, len(f"a b c d e {i}"), f"a b c d e {i}".encode()) for i in range(n)]

    def rows_of(batches):
        yield from (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches)

    assert made.mapInArrow(rows_of, "n long").agg(F.sum("n")).first()[0] == n
