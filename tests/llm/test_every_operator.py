"""Odd and empty tables through every operator; SQL twins; the pipeline."""

import collections

import duckdb
import pytest
from check import compare, connect

import corpus_pipeline
from wayfold.llm import bootstrap_pii, crossparse, divergence, hash_tree, licences, mixing, packing, quartile_digest, simhash_trie
from wayfold.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
BY_ROW = {
    "simhash": simhash_trie.fingerprints_and_components, "quality": divergence.quality, "language": crossparse.identify_documents, "mix": mixing.mixed_words, "licence": licences.scan,
    "shards": hash_tree.shard_documents, "pii": bootstrap_pii.find, "digest": quartile_digest.fingerprint_documents,
}


def ids(df):
    return collections.Counter(r["doc_id"] for r in df.select("doc_id").collect())


@pytest.mark.parametrize("name", sorted(BY_ROW))
def test_one_result_for_each_odd_row(odd, name):
    assert ids(BY_ROW[name](odd)) == ids(odd)


@pytest.mark.parametrize("name", sorted(BY_ROW) + ["pack"])
def test_empty_table(odd, name):
    assert {**BY_ROW, "pack": packing.pack}[name](odd.limit(0)).count() == 0


def test_packing_of_odd_rows(odd):
    assert set(ids(packing.pack(odd))) == set(ids(odd))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_take_odd_and_empty_rows_and_return_the_columns(spark, odd, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, odd, "")
    assert out.columns == odd.columns
    out.collect()
    assert stage(spark, odd.limit(0), "").count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.parametrize("folder", [SMALL, "/root/testdata/sf0.01"])
def test_sql_twin(spark, name, folder):
    assert compare(QUERIES[name](spark, folder), connect(folder), ORACLES[name]) == ""


@pytest.mark.parametrize("name", ["op5_water_filling", "op6_licence_digests"])
def test_sql_twin_on_odd_rows(spark, odd, name):
    con = duckdb.connect()
    frame = odd.toPandas()
    con.register("frame", frame)
    con.execute("CREATE VIEW documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text, lang, source FROM frame")
    operator = {"op5_water_filling": mixing.mixed_words, "op6_licence_digests": licences.scan}[name]
    assert compare(operator(odd), con, ORACLES[name]) == ""


def test_hash_tree_against_sql(spark):
    found = hash_tree.shard_documents(spark.read.parquet(f"{SMALL}/documents.parquet")).drop("text_crc32")
    assert compare(found, connect(SMALL), hash_tree.SHARD_SQL) == ""


def test_pipeline_against_its_stages_by_hand(spark, small):
    refs = divergence.references(small)
    docs = [r for r in small.collect() if divergence.judge(r["text"], r["lang"], refs)[6]]
    assert ids(corpus_pipeline.quality(spark, small, "")) == collections.Counter(r["doc_id"] for r in docs)
    out = corpus_pipeline.run(spark, SMALL)
    assert set(ids(out)) <= {r["doc_id"] for r in docs}
    fill = collections.Counter()
    for r in out.collect():
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= packing.LENGTH
