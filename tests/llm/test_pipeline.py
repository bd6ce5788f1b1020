"""The pipeline's stages over a small table: columns, decisions, and what is left for the next stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from braidworks.llm import decontaminate
from braidworks.llm.common import table
from test_text_operators import jaccard, shingles

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """Documents before the first and after each stage."""
    folder, docs = tmp_path_factory.mktemp("stages"), table(spark, DATA, "documents")
    docs = docs.withColumns({c: F.lit("x") for c in ("__h0", "__quality", "__language", "__found", "__found0", "__least", "w", "least", "id")})
    results = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        results.append(docs)
    return results


def test_stages_keep_the_columns_and_drop_rows(staged):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and len(set(names)) == 5
    for before, after in zip(staged, staged[1:-1]):
        assert after.columns == staged[0].columns
        assert after.where("__h0 <> 'x' or __quality <> 'x' or __language <> 'x' or __found <> 'x' or __found0 <> 'x' or __least <> 'x'").count() == 0
        assert after.select("doc_id", "text").exceptAll(before.select("doc_id", "text")).count() == 0
    counts = [d.count() for d in staged[:-1]]
    assert counts == sorted(counts, reverse=True) and counts[-1] > counts[0] / 2


def test_no_near_copies_and_no_passages_are_left(spark, staged):
    kept = [(r.doc_id, shingles(r.text)) for r in staged[3].select("doc_id", "text").collect()]
    near = [(i, j) for n, (i, a) in enumerate(kept) for j, b in kept[:n] if jaccard(a, b) >= 0.8]
    assert near == []
    gone = staged[2].join(staged[3].select("doc_id"), "doc_id", "left_anti").select("doc_id", "text").collect()
    before = [(r.doc_id, shingles(r.text)) for r in staged[2].select("doc_id", "text").collect()]
    assert all(any(jaccard(shingles(r.text), s) >= 0.8 for i, s in before if i < r.doc_id) for r in gone)
    items = decontaminate.Phrases.of([(r.item_id, r.text) for r in table(spark, DATA, "benchmark").collect()], 10)
    found = decontaminate.search_shard([r.text for r in staged[4].select("text").collect()], items)
    assert not any(spans for _, _, spans in found)
    clean = decontaminate.search_shard([r.text for r in staged[3].select("text").collect()], items)
    assert staged[4].count() == sum(not spans for _, _, spans in clean)


def test_every_document_that_is_left_is_packed(staged):
    packed, left = staged[5], staged[4]
    assert packed.select("doc_id").distinct().count() == left.count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_run_is_the_stages_in_order(spark, staged):
    got = corpus_pipeline.run(spark, DATA).select("doc_id", "start", "ids_crc32")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, staged[5].select("doc_id", "start", "ids_crc32").collect()))


@pytest.mark.parametrize("k", range(5))
def test_stages_take_nulls_repeats_and_no_rows(spark, k):
    docs = table(spark, DATA, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (900, "", None, None, 0), (900, "", None, None, 0), (901, "12 34", "en", "s", 5), (902, "x" * 200_000, "en", "s", 9)], docs.schema)
    stage = corpus_pipeline.STAGES[k][1]
    mixed = stage(spark, docs.limit(60).unionByName(odd), DATA)
    assert mixed.count() > 0
    none = stage(spark, docs.limit(0), DATA)
    assert none.count() == 0 and (k == 4 or none.columns == docs.columns)
