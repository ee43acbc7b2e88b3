"""Stages of the pipeline over odd rows and columns, small sources, and pseudonyms of short parts."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from loreweave.llm import mixing, pii

SF = "/root/testdata/sf0.001"
CLASHING = ("spans", "n_found", "size", "pieces", "target", "taken", "source_size", "_doc", "_id", "_text", "_row", "_keep_text", "key", "found", "uid")


def test_stages_keep_columns_of_any_name(spark):
    plain = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(None, None, None, None, None), (900_001, "", "en", "src0", 0), (900_002, "mail j@x.com " * 20_000, "en", "src9", None)]
    docs = plain.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long"))
    docs = docs.unionByName(docs.filter("doc_id % 50 = 0")).withColumns({c: F.lit(f"own {c}") for c in CLASHING})
    for stage in (s for _, s in corpus_pipeline.STAGES[:-1]):
        docs, _ = corpus_pipeline.store(stage(spark, docs, SF))
        assert docs.columns == [*plain.columns, *CLASHING]
        assert docs.filter(" or ".join(f"`{c}` <> 'own {c}'" for c in CLASHING)).count() == 0
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert {900_001} <= ids or stage is corpus_pipeline.mix_sources
    assert 900_002 in ids and docs.filter("text like '%j@x.com%'").count() == 0
    assert docs.filter("n_chars <> length(text)").count() == 0
    last = corpus_pipeline.encode(spark, docs, SF)
    assert last.count() == docs.count()


def test_stages_over_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_small_sources_come_near_their_targets(spark):
    rows = [(1, "a b c d e", "s0"), (2, "f g h", "s1"), (3, "w " * 1000, "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for r in mixing.mix(docs).collect():
        assert abs(r.taken - r.target) <= max(1, r.target / 10), r


def test_short_parts_of_addresses_change(spark):
    found = ["j@x.com", "a@b.co", "x.y@z.org", "1@2.net", "ab@cd.io"]
    df = spark.createDataFrame([(i, f"to {m}!") for i, m in enumerate(found)], "doc_id long, text string")
    for key in ("k1", "k2", "k3"):
        for r in pii.pseudonymise(df, key).collect():
            new = re.fullmatch(r"to (.*)!", r.text)[1]
            assert r.n_found == 1 and new != found[r.doc_id]
            if len(found[r.doc_id].split("@")[0]) == 1:
                assert new[0] != found[r.doc_id][0] and new[2] != found[r.doc_id][2]


def test_single_characters_are_permuted_one_to_one(spark):
    df = spark.createDataFrame([(ord(c), f"{c}@{c}{c}.com") for c in "abcdefghijklmnopqrstuvwxyz0123456789"], "doc_id long, text string")
    new = [r.text[0] for r in pii.pseudonymise(df, "k").collect()]
    assert sorted(new) == sorted("abcdefghijklmnopqrstuvwxyz0123456789")
