"""The registered pipeline against a plain version that goes through the documents one by one."""

import sys
from pathlib import Path

import public_tokenizers
import pytest
import sentencepiece
from cases import contamination, linked, normal, simhash

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from relspark.llm import toxicity  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity",
        "exact_dedup",
        "simhash_near_dedup",
        "benchmark_decontamination",
        "sentencepiece",
    ]


def test_run(spark):
    docs, items = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "benchmark"))
    model = toxicity.fit(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    scores = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    left = {r.doc_id: r.text for r in docs.collect() if scores[r.doc_id] < toxicity.THRESHOLD}
    first = {}
    for doc_id in sorted(left):
        first.setdefault(normal(left[doc_id]), doc_id)
    left = {i: left[i] for i in first.values()}
    prints = {i: simhash(t) for i, t in left.items()}
    root, one = linked(prints.values()), {}
    for doc_id in sorted(left):
        one.setdefault(root[prints[doc_id]], doc_id)
    known = [(r.item_id, r.text) for r in items.collect()]
    stay = {i for i in one.values() if not contamination(left[i], known)[1]}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {r.doc_id: r.ids for r in got} == {i: library.encode(left[i] or "") for i in stay}
    assert len(got) == len(stay) < docs.count()
    assert all(r.round_trip for r in got)


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_empty_tables_and_further_columns(spark, stage):
    name, function = corpus_pipeline.STAGES[stage]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").selectExpr("*", "'x' AS row", "'y' AS fp")
    assert function(spark, docs.limit(0), SF_DIR).count() == 0
    kept = function(spark, docs, SF_DIR)
    if name != "sentencepiece":
        assert kept.columns == docs.columns
    assert 0 < kept.count() <= docs.count()
