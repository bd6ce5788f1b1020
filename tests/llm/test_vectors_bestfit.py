"""Best-fit packing, whitening and hard negatives against brute force, with nulls, repeats, ties, long texts and clashing columns."""

import json
import random
import struct
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from braidworks.llm import bestfit, hardneg, whitening, wordtokens
from braidworks.llm.queries import OP13_SQL, op12_best_fit_packing, op13_hard_negatives

WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = ["a", "B", "The", "don't", "'S", " ", "  ", "\n", "\t", "\x1c", "\x1f", "\x85", "\xa0", "　", "é", "É", "ß", "ẞ", "İ", "1", "22", "'", ".", "!!", ">", "̸", "́", "<|endoftext|>", "<|endof", "日本", "🙂", "\x00", "ﬁ", "Σ", "ς", "ｱ"]
CLASH = ["piece", "start", "length", "sequence_id", "offset", "x", "n", "rank", "anchor", "vector", "__nth", "part", "score", "component"]


def with_clashes(df):
    return df.withColumns({c: F.lit("x") for c in CLASH if c not in df.columns})


# Word by word.


def test_runs_give_the_librarys_ids():
    library, encoder = Tokenizer.from_file(WORDS), wordtokens.WordEncoder(WORDS)
    assert encoder.runs is not None
    draw = random.Random(3)
    texts = ["".join(draw.choice(ODD) for _ in range(draw.randint(0, 40))) for _ in range(1500)]
    texts += ["Plain words, and l'été: it's 2024!  (Ärger)\n\tend.", "x" * 300 + " y", "'re'll''t", "a<|endoftext|>b <|startoftext|>"]
    for text in texts:
        ids = encoder.packed_ids(text)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_full_caches_are_emptied(monkeypatch):
    monkeypatch.setattr(wordtokens, "MOST_RUNS", 3)
    monkeypatch.setattr(wordtokens, "MOST_WORDS", 2)
    encoder, text = wordtokens.WordEncoder(WORDS), "one two three four five one two, three. 1 2 3"
    assert encoder.packed_ids(text) == wordtokens.packed(encoder.library, text)
    assert len(encoder.runs) <= 3 and len(encoder.runs.words) <= 2


def test_other_vocabularies_get_whole_texts(tmp_path):
    with open(WORDS, encoding="utf-8") as file:
        settings = json.load(file)
    assert wordtokens.goes_by_runs(settings)
    assert not wordtokens.goes_by_runs(settings | {"normalizer": {"type": "NFC"}})
    assert not wordtokens.goes_by_runs(settings | {"model": settings["model"] | {"dropout": 0.1}})
    spaced = [settings["added_tokens"][0] | {"content": "a b"}]
    assert not wordtokens.goes_by_runs(settings | {"added_tokens": spaced})
    plain = wordtokens.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert plain.runs is None and plain.packed_ids("two words") == wordtokens.packed(plain.library, "two words")


# Best fit.


def best_fit(lengths, capacity):
    rooms, out = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fitting = [r for r in rooms if r >= lengths[i]]
        room = min(fitting) if fitting else capacity
        if fitting:
            rooms.remove(room)
        rooms.append(room - lengths[i])
        out[i] = room
    return [out[i] for i in range(len(lengths))], len(rooms)


@pytest.mark.parametrize("n,capacity", [(0, 10), (1, 10), (2, 1), (40, 10), (300, 100), (500, 64), (400, 2048)])
def test_tree_finds_the_tightest_bin(n, capacity):
    lengths = np.random.default_rng(n).integers(1, capacity + 1, n)
    bins, offsets = bestfit.best_fit_decreasing(lengths, capacity)
    rooms, used = best_fit(lengths.tolist(), capacity)
    assert (capacity - offsets).tolist() == rooms and len(set(bins.tolist())) == used
    for b in set(bins.tolist()):
        parts = sorted((o, s) for o, s, x in zip(offsets.tolist(), lengths.tolist(), bins.tolist()) if x == b)
        assert [o for o, _ in parts] == [sum(s for _, s in parts[:k]) for k in range(len(parts))] and sum(s for _, s in parts) <= capacity


def packed_rows(spark, rows, **options):
    return bestfit.pack_best_fit(with_clashes(spark.createDataFrame(rows, "doc_id long, text string")), WORDS, **options).collect()


def test_every_document_is_packed_once_and_only_long_ones_are_cut(spark):
    texts = [None, "", " \n", *["".join(random.Random(i).choices(ODD, k=60)) for i in range(60)], "many words here " * 3000, "x" * 20_000]
    rows = list(enumerate(texts)) + [(3, "twice"), (3, "twice"), (None, "nobody")]
    got = packed_rows(spark, rows, capacity=64, group_pieces=30)
    library = Tokenizer.from_file(WORDS)
    expected = sorted((-1 if i is None else i, struct.pack(f"<{len(ids)}I", *ids)) for i, t in rows for ids in [[*library.encode(t or "", add_special_tokens=False).ids, 0]])
    pieces = sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got)
    assert pieces == sorted((i, k, 64 * k, len(p) // 4, zlib.crc32(p), p) for i, ids in expected for k, p in enumerate(ids[at : at + 256] for at in range(0, len(ids), 256)))
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(s for _, s in parts[:k]) for k in range(len(parts))] and sum(s for _, s in parts) <= 64


def test_nothing_to_pack(spark):
    assert packed_rows(spark, []) == []


def test_sequences_are_nearly_as_few_as_can_be(spark):
    got = op12_best_fit_packing(spark, "/root/testdata/sf0.01").toPandas()
    library = Tokenizer.from_file(WORDS)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    tokens = sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts)
    assert got.length.sum() == tokens
    long = int((got.length > 1024).sum())  # no two of them share a sequence
    assert got.sequence_id.nunique() <= 1.01 * max(-(-tokens // 2048), long) + 1


# Whitening.


def sound(rows):
    return [(i, [int(np.floor(64 * c)) + 1_000_000 for c in v]) for i, v in rows]


def check_whitening(got, rows, most=16):
    """Against the covariance of the different vectors, summed up in fractions."""
    fit = sorted({tuple(x) for _, x in rows})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(most, int((values > values[0] * 1e-14).sum()))
    assert {r.component for r in got} == set(range(1, k + 1)) and len(got) == k * len(rows)
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error <= 1e-6
    deviation = {i: sum((n * a - s) ** 2 for a, s in zip(x, sums)) for i, x in rows}
    own = {i: np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums)]) for i, x in rows}
    signs = {}
    for r in got:
        assert r.deviation == deviation[r.vec_id]
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-6)
        expected = own[r.vec_id] @ vectors[:, r.component - 1] / np.sqrt(values[r.component - 1])
        if abs(expected) > 1e-6:
            signs.setdefault(r.component, np.sign(expected) == np.sign(r.whitened))
            assert r.whitened == pytest.approx(expected * (1 if signs[r.component] else -1), rel=1e-5, abs=1e-7)


@pytest.mark.parametrize("n,d,parts", [(300, 20, 7), (40, 3, 40), (500, 64, 3)])
def test_whitening_matches_the_covariances_eigenvectors(spark, n, d, parts):
    draw = np.random.default_rng(d)
    m = draw.normal(size=(n, d)) * np.linspace(1, 9, d)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(m)] + [(n + i, [float(c) for c in m[0]]) for i in range(n // 2)]
    df = with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts))
    check_whitening(whitening.whiten(df).collect(), sound(rows))


def test_unsound_vectors_are_left_out_and_ids_may_repeat(spark):
    draw = np.random.default_rng(0)
    good = [(i, [float(c) for c in v]) for i, v in enumerate(draw.normal(size=(30, 4)))]
    nan, inf = float("nan"), float("inf")
    bad = [(100, None), (101, [1.0, None, 2.0, 3.0]), (102, [nan, 1.0, 1.0, 1.0]), (103, [1.0, -inf, 1.0, 1.0]), (104, []), (105, [1.0, 2.0]), (106, [1e30, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(good + bad + [good[0], (None, good[1][1])], "vec_id long, embedding array<float>")
    got = whitening.whiten(df).collect()
    assert sorted({r.vec_id for r in got if r.vec_id is not None}) == list(range(30)) and {r.n for r in got} == {30}
    assert sum(r.vec_id == 0 for r in got) == 8 and sum(r.vec_id is None for r in got) == 4
    seen = {}
    for r in got:
        seen.setdefault(((0 if r.vec_id == 0 else 1 if r.vec_id in (1, None) else r.vec_id), r.component), set()).add((r.whitened, r.deviation, r.explained))
    assert all(len(v) == 1 for v in seen.values())


def test_directions_without_spread_have_no_component(spark):
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(50)], "vec_id long, embedding array<double>")
    got = whitening.whiten(flat).collect()
    assert {r.component for r in got} == {1} and len(got) == 50 and got[0].explained == pytest.approx(1.0) and got[0].identity_error < 1e-9
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert whitening.whiten(one).count() == 0 and whitening.whiten(one.limit(0)).count() == 0
    assert whitening.whiten(one).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_far_apart_numbers_stay_exact(spark):
    rows = [(i, [float(v)]) for i, v in enumerate([0, 1, 2**44, -(2**44), 5, 2**43])]
    got = {r.vec_id: r for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    x = [x for _, (x,) in sound(rows)]
    exact = [(6 * v - sum(x)) ** 2 for v in x]
    assert [got[i].deviation for i in range(6)] == [e if e < 1 << 63 else None for e in exact]
    assert whitening.numerators(np.array([[2**61], [-(2**61)]]), 4, [12]).tolist() == [[4 * 2**61 - 12], [-4 * 2**61 - 12]]


# Hard negatives.


def brute_negatives(rows, is_anchor, positives=5, negatives=10):
    """(anchor, positive, rank, negative, scores) by going through all rows."""
    out = []
    for i, label, v in rows:
        if not is_anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in rows if j != i)
        for s, j, _ in [x for x in scored if x[2] == label][:positives]:
            fitting = [(t, k) for t, k, other in scored if other != label and -30 * s <= -100 * t <= -90 * s][:negatives]
            out += [(i, j, rank, k, -s, -t) for rank, (t, k) in enumerate(fitting, 1)]
    return sorted(out)


def integers(v):
    return [int(np.floor(256 * c)) for c in v]


@pytest.mark.parametrize("scale,kind", [(1.0, "float"), (0.02, "float"), (3e5, "double"), (2e5 * 2**3, "double")])
def test_negatives_match_a_scan(spark, monkeypatch, scale, kind):
    monkeypatch.setattr(hardneg, "ANCHOR_BLOCK", 7)
    monkeypatch.setattr(hardneg, "CANDIDATE_BLOCK", 50)
    draw = np.random.default_rng(5)
    centre = draw.normal(size=8)
    m = (draw.normal(size=(400, 8)) * 0.6 + centre) * scale
    m[100:180] = m[100]  # one vector many times: ties
    m = m.astype(np.float32 if kind == "float" else np.float64)
    rows = [(int(i) * 5 - 300, int(draw.integers(0, 3)), [float(c) for c in v]) for i, v in enumerate(m)]
    df = with_clashes(spark.createDataFrame(rows, f"vec_id long, label int, embedding array<{kind}>").repartition(6)).drop("vector").withColumnRenamed("embedding", "vector")
    for wave in (hardneg.WAVE_ANCHORS, 9):
        got = hardneg.mine(df, F.col("vec_id") % 50 == 0, wave_anchors=wave).collect()
        assert sorted(map(tuple, got)) == brute_negatives([(i, label, integers(v)) for i, label, v in rows], lambda i: i % 50 == 0)


def test_rows_that_take_no_part(spark):
    nan = float("nan")
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.1]), (2, 2, [0.5, 0.0]), (3, 2, [0.6, nan]), (4, None, [0.6, 0.0]), (None, 2, [0.6, 0.0]), (6, 2, None), (7, 2, [0.6, None]), (8, 2, [0.6]), (9, 2, []), (10, 2, [1e300, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, vector array<double>")
    assert [tuple(r) for r in hardneg.mine(df, F.col("vec_id") % 100 == 0).collect()] == [(0, 1, 1, 2, 65536, 32768)]
    assert hardneg.mine(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert hardneg.mine(df, F.col("vec_id") == 99).count() == 0 and hardneg.mine(df, F.lit(None).cast("boolean")).count() == 0


def test_copies_of_rows_are_each_their_own(spark):
    rows = [(0, 1, [1.0]), (0, 1, [1.0]), (1, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.5]), (2, 2, [0.5])]
    got = hardneg.mine(spark.createDataFrame(rows, "vec_id long, label int, vector array<double>"), F.col("vec_id") == 0).collect()
    assert sorted(map(tuple, got)) == sorted([(0, 1, rank, 2, 65536, 32768) for rank in (1, 2)] * 4)


def test_labels_of_every_seventh_row_are_the_next_ones(spark):
    df = spark.createDataFrame([(7, 9, [1.0]), (8, 9, [1.0]), (None, 3, [1.0]), (14, None, [1.0])], "vec_id long, label int, embedding array<double>")
    assert [r.label for r in hardneg.mixed_labels(df).collect()] == [0, 9, 3, None]


def test_query_matches_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet'")
    got = op13_hard_negatives(spark, "/root/testdata/sf0.01").toPandas()
    expected = con.execute(OP13_SQL).df()[list(got.columns)]
    assert sorted(map(tuple, got.itertuples(index=False))) == sorted(map(tuple, expected.itertuples(index=False))) and len(got) > 0
