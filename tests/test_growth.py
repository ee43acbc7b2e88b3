"""Plans whose cost has to grow no faster than their input."""

import pytest
from pyspark.sql import functions as F

from loreweave.operators import batch_resolution as br
from loreweave.operators import graph_expand as gx
from loreweave.operators import graph_store as gs
from loreweave.operators import index as ix
from loreweave.plans import tables as tb


def plan_of(df, stage="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), stage)().toString()


def test_entities_are_folded_by_hashing(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(tb, "cut_lineage", lambda df: seen.append(df) or df)
    t = tb.Tables(spark, "/root/testdata/sf0.001")
    t.entities
    plan = plan_of(seen[-1], "sparkPlan")
    assert "HashAggregate(keys=[user_id" in plan.replace("ObjectHashAggregate", "").replace("SortAggregate", "")


def test_members_meet_deleted_documents_once(spark):
    ents = spark.createDataFrame([("u", "a"), ("u", "b"), ("u", "c")], "user_id string, name_lower string")
    docs = spark.createDataFrame([("u", "a", "1"), ("u", "b", "1"), ("u", "b", "2")], "user_id string, name_lower string, document_id string")
    keys = "user_id string, source_lower string, target_lower string, relation string"
    edges = spark.createDataFrame([("u", "a", "b", "r"), ("u", "b", "c", "r")], keys)
    edge_docs = edges.withColumn("document_id", F.when(F.col("source_lower") == "a", "1").otherwise("2"))
    gone = spark.createDataFrame([("u", "1")], "user_id string, document_id string")
    nodes, node_docs, links, link_docs = gs.delete_document(gone, ents, docs, edges, edge_docs)
    assert sorted(r["name_lower"] for r in nodes.collect()) == ["b", "c"]
    assert [tuple(r) for r in node_docs.select("name_lower", "document_id").collect()] == [("b", "2")]
    assert [r["source_lower"] for r in links.collect()] == ["b"] and [r["source_lower"] for r in link_docs.collect()] == ["b"]
    assert plan_of(links).count("LogicalRDD") <= 3  # edges, their documents, the deleted ones; the nodes are stored


def test_incoming_edges_are_folded_before_their_ends_are_looked_up(spark):
    keys = "user_id string, source_lower string, target_lower string, relation string, created_at timestamp"
    rows = spark.createDataFrame([], keys)
    plan = plan_of(gs.upsert_edges(rows, rows.unionByName(rows), spark.createDataFrame([("u", "a")], "user_id string, name_lower string")), "analyzed")
    assert plan.count("Aggregate") == 2


def test_highlight_reads_the_facts_once(spark):
    answers = spark.createDataFrame([(1, "a red bolt", True), (2, "none", True), (3, "none", True)], "query_id int, answer string, used_graph boolean")
    facts = spark.createDataFrame([(1, "Bolt"), (2, "Bolt")], "query_id int, name string")
    out = gx.highlight(answers, facts, spark.createDataFrame([], "query_id int, document_id string"))
    assert [(r["highlighted"], r["has_graph"]) for r in out.orderBy("query_id").collect()] == [(["Bolt"], True), ([], True), ([], False)]
    assert plan_of(out).count("Aggregate") == 2


def test_repeated_rows_are_walked_once(spark):
    rows = [("u", "d", 0, i, "T", k) for i, k in enumerate(["a", "a", "b", "a", "a", "b", "b", "a"])]
    rows = spark.createDataFrame(rows, "user_id string, document_id string, at long, id long, type string, key string")
    turns = {r["id"]: r["turn"] for r in br._turns(rows).collect()}
    # A repeat counts again once a new key of its type has come.
    assert turns == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3, 5: 2, 6: 2, 7: 3}


def test_big_bucket_is_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(0, 40_000, 1, 8).select(
        F.lit("u").alias("user_id"), F.lit("d").alias("document_id"), F.col("id").alias("chunk_id"), F.sha2(F.col("id").cast("string"), 512).alias("text")
    )
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "512KB")
    try:
        ix.write_index(rows, str(tmp_path / "i"), buckets=4)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    files = list((tmp_path / "i").rglob("*.parquet"))
    assert len(files) > 1 and spark.read.parquet(str(tmp_path / "i")).count() == 40_000


@pytest.mark.parametrize("hops", [1])
def test_relations_are_cleaned_once_a_name(spark, hops):
    ents = spark.createDataFrame(
        [("u", "bolt", "Bolt", "T", "d", 1), ("u", "ring", "Ring", "T", "", 2)], "user_id string, name_lower string, name string, type string, description string, last_seen_at int"
    )
    edges = spark.createDataFrame([("u", "bolt", "ring", " holds ")], "user_id string, source_lower string, target_lower string, relation string")
    q = spark.createDataFrame([(1, "u", "a bolt"), (2, "u", "bolt?")], "query_id int, user_id string, query string")
    chunks = spark.createDataFrame([], "query_id int, user_id string, document_id string, text string, rank int")
    docs = spark.createDataFrame([], "user_id string, name_lower string, document_id string")
    out = gx.expand_with_graph(q, chunks, ents, docs, edges, hops=hops)
    got = [(r["query_id"], r["name"], r["relations"][0]["relation"], r["relations"][0]["other"]) for r in out.orderBy("query_id").collect()]
    assert got == [(1, "Bolt", "holds", "Ring"), (2, "Bolt", "holds", "Ring")]
    assert "transform(" not in plan_of(out)


def test_snippets_are_not_stored_with_the_replies_of_pairs(spark, monkeypatch):
    from loreweave.operators import extraction as ex

    seen, real = [], ex.parse_reconciled
    monkeypatch.setattr(ex, "parse_reconciled", lambda pairs: seen.append(pairs.columns) or real(pairs))
    chunks = spark.createDataFrame([("u", "d", 0, "a knows b")], "user_id string, document_id string, chunk_index int, text string")
    said = '{"entities":[{"name":"a"},{"name":"b"}]}'
    extractor = lambda c: c.withColumns({"pass1_raw": F.lit(said), "pass1_failed": F.lit(False), "pass2_raw": F.lit("{}"), "pass2_failed": F.lit(False)})
    asked = lambda p: p.withColumn("raw", F.concat(F.lit('{"relation":"'), "snippets_a", F.lit('","direction":"BA"}')))
    _, relations, _ = ex.extract_graph(chunks, extractor, asked)
    assert [(r["source"], r["target"], r["relation"]) for r in relations.collect()] == [("b", "a", "a knows b")]
    assert seen == [["user_id", "document_id", "rank", "name_a", "name_b", "raw"]]


def test_names_are_looked_up_by_a_run_and_not_listed_beside_a_text(spark):
    names = ["Cosine", "Cosine Distance", "cosine", "İst", "a b"]
    ents = spark.createDataFrame([("u", str(i), n, i) for i, n in enumerate(names)], "user_id string, name_lower string, name string, last_seen_at int")
    long = "x" * 250 + "cosine distance" + "y" * 900 + "a b"
    texts = spark.createDataFrame([(1, "u", long), (2, "u", "ab"), (3, "u", "i̇st i̇st"), (4, "v", "cosine")], "query_id int, user_id string, haystack string")
    out = gx.match_entities(texts, ents)
    # Newest first among equals: "cosine" is newer than "Cosine".
    assert sorted((r["query_id"], r["pos"], r["name"]) for r in out.collect()) == [(1, 0, "Cosine Distance"), (1, 1, "cosine"), (1, 2, "a b"), (3, 0, "İst")]
    assert "lambda" not in plan_of(out)


def test_facts_of_two_hops_store_three_tables(spark, monkeypatch):
    seen, real = [], gs.cut_lineage
    monkeypatch.setattr(gs, "cut_lineage", lambda df: seen.append(df) or real(df))
    ents = spark.createDataFrame([("u", f"n{i}", f"N{i}", "T", "d") for i in range(5)], "user_id string, name_lower string, name string, type string, description string")
    rows = [("u", "n0", f"n{i}", r) for i in range(1, 4) for r in ("q", "p")]
    edges = spark.createDataFrame(rows, "user_id string, source_lower string, target_lower string, relation string")
    got = {r["name_lower"]: [(x["other"], x["distance"], x["relation_chain"]) for x in r["relations"]] for r in gs.entity_facts(ents, ents, edges, 2).collect()}
    assert got["n1"] == [("N0", 1, ["p"]), ("N2", 2, ["p", "p"]), ("N3", 2, ["p", "p"])]
    assert [x[0] for x in got["n0"]] == ["N1", "N2", "N3"] and got["n4"] == []
    assert len(seen) == 3


def test_answer_facts_are_not_numbered_by_user(spark):
    from loreweave.plans import catalogue  # noqa: F401 (tables first)
    from loreweave.plans.graph_plans import _answer_facts

    facts = _answer_facts(tb.Tables(spark, "/root/testdata/sf0.001"))
    assert "Window" not in plan_of(facts)


def test_verifier_puts_together_only_facts_that_can_show(spark):
    from loreweave.operators import answers as an

    facts = spark.range(6000).select(  # pmod: a query id that is no constant
        F.pmod("id", F.lit(1)).alias("query_id"), F.lit("").alias("name"), F.lit("").alias("type"), F.lit("").alias("description"),
        F.array().cast("array<struct<relation_chain:array<string>,other:string>>").alias("relations"), F.format_string("%05d", 5999 - F.col("id")).alias("rank"),
    )
    answers = spark.createDataFrame([(0, "a")], "query_id int, answer string")
    chunks = spark.createDataFrame([], "query_id int, rank int, text string")
    web = spark.createDataFrame([], "query_id int, rank int, title string, url string, content string")
    out = an.verifier_context(answers, chunks, facts, web)
    told = "\n".join(["-  ()"] * 6000)[:4000] + "…"
    assert f"Knowledge-graph facts:\n{told}\n\nWeb results:" in out.first()["message"]
    assert "WindowGroupLimit" in plan_of(out)


def test_a_stored_table_leaves_no_shuffle_behind(spark):
    import time
    from pathlib import Path

    from loreweave.session import cut_lineage

    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    files = lambda: {f for d in dirs for f in Path(str(d)).rglob("shuffle_*")}
    before = files()
    kept = cut_lineage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().join(spark.range(7).withColumnRenamed("id", "k").hint("merge"), "k"))
    deadline = time.time() + 20
    while time.time() < deadline and files() - before:
        time.sleep(0.2)
    assert not files() - before
    assert kept.count() == 7


def test_pairs_are_not_shuffled(spark):
    from itertools import combinations

    from loreweave.operators import extraction as ex

    said = {0: ["b", "a"], 1: ["c"], 3: ["A", "d"], 6: ["e"], 9: ["f"], 11: ["a"]}
    rows = [("u", "d", c, [(i, n, "T", "") for i, n in enumerate(ns)], [(0, "A ", "c", "r")] if c == 1 else []) for c, ns in said.items()]
    results = spark.createDataFrame(rows, f"user_id string, document_id string, chunk_index int, entities array<{ex.ENTITY}>, relationships array<{ex.RELATION}>")
    pairs = ex._open_pairs(ex.mentions(results), ex.relation_rows(results), 40, "name")
    places = {}
    for c, ns in said.items():
        for n in ns:
            places.setdefault(n.lower(), []).append(c)
    score = lambda x, y: sum({0: 3, 1: 2, 2: 1, 3: 1}.get(abs(i - j), 0) for i in places[x] for j in places[y])
    want = {(x, y): score(x, y) for x, y in combinations(sorted(places), 2) if score(x, y) and (x, y) != ("a", "c")}
    got = pairs.collect()
    assert {(r["a"], r["b"]): r["score"] for r in got} == want
    assert [(r["rank"], r["score"]) for r in got] == [(i + 1, s) for i, s in enumerate(sorted(want.values(), reverse=True))]
    assert {n for r in got for n in (r["name_a"], r["name_b"])} == {"a", "b", "c", "d", "e", "f"}  # the first spelling
    # Mentions and relations are shuffled, each once and by document; pairs are not.
    ran = plan_of(pairs, "executedPlan").split("== Initial Plan ==")[0]
    assert ran.count("Exchange hashpartitioning(user_id") == ran.count("Exchange") == 2


def test_what_a_deletion_leaves_is_stored(spark):
    ents = spark.createDataFrame([("u", n) for n in "abcd"], "user_id string, name_lower string")
    docs = spark.createDataFrame([("u", "a", "1"), ("u", "b", "1"), ("u", "b", "2"), ("u", "c", "2")], "user_id string, name_lower string, document_id string")
    keys = "user_id string, source_lower string, target_lower string, relation string"
    edges = spark.createDataFrame([("u", "a", "b", "r"), ("u", "b", "c", "r"), ("u", "c", "d", "r")], keys)
    edge_docs = edges.filter("source_lower <> 'c'").withColumn("document_id", F.when(F.col("source_lower") == "a", "1").otherwise("2"))
    nodes, node_docs, links, link_docs = gs.delete_document(spark.createDataFrame([("u", "1")], "user_id string, document_id string"), ents, docs, edges, edge_docs)
    # A node or an edge that no document was ever known for stays.
    assert sorted(r["name_lower"] for r in nodes.collect()) == ["b", "c", "d"]
    assert sorted(r["name_lower"] for r in node_docs.collect()) == ["b", "c"]
    assert sorted(r["source_lower"] for r in links.collect()) == ["b", "c"] and [r["source_lower"] for r in link_docs.collect()] == ["b"]
    assert "LogicalRDD" not in plan_of(link_docs) and "LogicalRDD" not in plan_of(links)


def test_lexical_search_keeps_postings_of_the_asked_terms_only(spark):
    from loreweave.operators import inverted as iv
    from loreweave.operators import retrieval as rt

    words = ["ant", "bee", "cow", "dog", "elk", "fox"]
    text = F.array_join(F.array(*[F.when(F.col("id") % (i + 2) == 0, w).otherwise("the") for i, w in enumerate(words)]), " ")
    chunks = spark.range(400).select(F.lit("u").alias("user_id"), (F.col("id") % 9).cast("string").alias("document_id"), F.col("id").cast("string").alias("chunk_id"), F.col("id").alias("chunk_index"), text.alias("text"))
    index = ix.build_index(chunks).drop("dense").localCheckpoint()
    asked = rt.encode_queries(spark.createDataFrame([(1, "u", "bee elk"), (2, "u", "the fox"), (3, "v", "ant")], "query_id int, user_id string, query string"))
    one = iv.build_inverted(index, asked=asked)
    assert sorted(r["term"] for r in one.terms.collect()) == ["bee", "elk", "fox", "the"]
    rows = lambda df: sorted((r["query_id"], r["branch_rank"], r["chunk_id"], r["score"]) for r in df.collect())
    found = rt.sparse_top_k(asked, index, 7)
    assert rows(found) == rows(rt.sparse_top_k(asked, index, 7, inverted=iv.build_inverted(index))) and found.count() == 14
    assert "MapInArrow" not in plan_of(found)  # scores are stored, and the shuffles before them gone


def test_names_of_requests_are_shuffled_by_node_once(spark):
    import re

    req = spark.createDataFrame([(1, "u", "a"), (1, "u", "b"), (2, "u", "b")], "query_id int, user_id string, document_id string")
    docs = spark.createDataFrame([("u", "x", "a"), ("u", "x", "b"), ("u", "y", "b"), ("u", "z", "c")], "user_id string, name_lower string, document_id string")
    ents = spark.createDataFrame([("u", n, n.upper(), i) for i, n in enumerate("xyz")], "user_id string, name_lower string, name string, last_seen_at int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for store in (False, True):
            out = gs.entities_of_documents(req, ents, docs, 5, store)
            assert sorted((r["query_id"], r["rank"], r["name"]) for r in out.collect()) == [(1, 1, "Y"), (1, 2, "X"), (2, 1, "Y"), (2, 2, "X")]
            ran = plan_of(out, "executedPlan")
            assert not re.search(r"hashpartitioning\(query_id#\d+, user_id#\d+, name_lower", ran)
        assert plan_of(out).count("LogicalRDD") == 1  # the nodes; what tells the names is stored
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_facts_that_cannot_show_are_not_looked_up(spark):
    from loreweave.plans import catalogue  # noqa: F401 (tables first)
    from loreweave.plans.graph_plans import _answer_facts

    t = tb.Tables(spark, "/root/testdata/sf0.001")
    whole = {(r["query_id"], r["rank"]): r["relations"] for r in _answer_facts(t).collect()}
    first = {(r["query_id"], r["rank"]): r["relations"] for r in _answer_facts(t, 3).collect()}
    users = {u for u, _ in whole}
    want = {(u, k) for u in users for k in sorted(k for v, k in whole if v == u)[:3]}
    assert set(first) == want and all(first[k] == whole[k] for k in want)


def test_replies_are_read_without_variants_and_alike(spark):
    from loreweave.functions.jsonrec import recover_json
    from loreweave.operators import extraction as ex

    item = '{"name":"A","type":"T","description":"d"}'
    odd = [
        f'{{"entities":[{item},5,{{"name":"b"}},{{"name":""}},{{"name":"c","type":null}},{{"name":"d","type":7}},null]}}', f'x {{"entities":[{item}]}} y }}', "no", None, "", "{}", "null",
        f'```JSON\n{{"entities":[{item}]}}\n``` {{', f'[{{"entities":[{item}]}}]', f'{{"entities":[{item}],"entities":[]}}', f'{{"entities":[{{"name":"a:b","name":"c"}}]}}', '{"entities":[{"name":"a:b"}]}',
        f'{{"entities":[{item}]', '{"entities":[{"name":"\\ud800"}]}', '{"entities":[{"name":"x","n":NaN}]}', '{"entities":{"name":"x"}}', '{"entities":null}', f'﻿{{"entities":[{item}]}}', f'{{"entities":[{item}]}} {{',
        '{"entities":[{"name":"' + "n" * 200 + '"},{"name":"' + "n" * 201 + '"}]}', '{"a {"entities":[{"name":"x"}]}', '{"x":{"y":1,"y":2},"entities":[{"name":"x"}]}',
    ]
    df = spark.createDataFrame(list(enumerate(odd)), "i int, raw string")
    want = {r["i"]: r["e"] for r in recover_json(df, "raw").select("i", ex.parse_entities(F.col("obj")).alias("e")).collect()}
    assert {r["i"]: r["e"] for r in df.select("i", ex.read_entities("raw").alias("e")).collect()} == want and sum(map(bool, want.values())) > 7
    replies = spark.createDataFrame([], "user_id string, document_id string, chunk_index int, pass1_raw string, pass1_failed boolean, pass2_raw string, pass2_failed boolean")
    assert "variant" not in plan_of(ex.chunk_results(replies)) and "parse_json" not in plan_of(ex.chunk_results(replies))
