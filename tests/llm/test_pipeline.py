"""The corpus pipeline against a brute-force version of its stages."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from graphloom.llm import language_id

from .conftest import ODD, prose
from .test_pairs import brute_fingerprint, reachable
from .test_rows import brute_contaminated, brute_spans


def test_stages_on_odd_rows(spark):
    """Nulls, empty and long texts, ties, repeated rows, clashing names, an empty table; lang is null where nothing is to be learned."""
    shape = "doc_id long, text string, lang string, Found int, __key int, N_TOKENS int, Rejected int"
    some = [(100 + i, prose(i, 40), "aa", 1, 2, 3, 4) for i in range(3)]
    docs = spark.createDataFrame([(i, t, None, 1, 2, 3, 4) for i, t in ODD] + some, shape)
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        if name != "bpe":
            assert out.columns == docs.columns and out.where("Found <> 1 or __key <> 2 or N_TOKENS <> 3 or Rejected <> 4").count() == 0
        left[name] = sorted((r.doc_id for r in out.select("doc_id").collect()), key=str)
        assert stage(spark, docs.where("false"), "/root/testdata/sf0.001").count() == 0
    whole = sorted([i for i, _ in ODD] + [100, 101, 102], key=str)
    assert left["decontamination"] == left["secret_scan"] == left["bpe"] == whole
    assert left["simhash_near_dedup"] == sorted([1, 4, 6, 7, 100, 101, 102], key=str)
    assert left["language_id"] == sorted([None, 4, 5, 5, 7, 100, 101, 102], key=str)


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_pipeline(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rejected = {r.doc_id for r in language_id.identify(docs).where("rejected").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in rejected}
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    texts = {i: texts[i] for i in set(reachable(texts, lambda x, y: (fps[x] ^ fps[y]).bit_count() <= 4).values())}
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    texts = {i: t for i, t in texts.items() if not brute_contaminated(t, items)}
    texts = {i: t for i, t in texts.items() if not brute_spans(t)}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in texts.items()} and 0 < len(got) < docs.count()
