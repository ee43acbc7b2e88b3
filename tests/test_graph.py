import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from loreweave.operators import extraction as ex
from loreweave.operators import graph_expand as gx
from loreweave.operators import graph_store as gs

ENT = "user_id string, name_lower string, name string, type string, description string, embedding array<double>, created_at timestamp, last_seen_at timestamp"
EDGE = "user_id string, source_lower string, target_lower string, relation string, created_at timestamp"


def graph(spark, seed, nodes=12, links=18):
    rng = random.Random(seed)
    ents, edges = [], set()
    for u in ("a", "b"):
        ents += [(u, f"n{i}", f"N{i}", "Concept", None, None, None, None) for i in range(nodes)]
        for _ in range(links):
            s, t = rng.sample(range(nodes - 2), 2)
            edges.add((u, f"n{s}", f"n{t}", rng.choice(["r", "s", "t"]), None))
    return spark.createDataFrame(ents, ENT), spark.createDataFrame(sorted(edges, key=str), EDGE), edges


def shortest(edges, user, seed, hops):
    steps = {}
    for u, s, t, r, _ in edges:
        if u == user:
            steps.setdefault(s, set()).add((t, r))
            steps.setdefault(t, set()).add((s, r))
    best, frontier = {}, {seed: ()}
    for d in range(1, hops + 1):
        nxt = {}
        for node, chain in frontier.items():
            for other, r in steps.get(node, ()):
                if other != seed and other not in best:
                    nxt[other] = min(nxt.get(other, chain + (r,)), chain + (r,))
        for other, chain in nxt.items():
            best[other] = (d, chain)
        frontier = nxt
    return best


@pytest.mark.parametrize("hops", [1, 2, 3])
def test_facts_match_breadth_first_search(spark, hops):
    ents, edges, raw = graph(spark, hops)
    seeds = ents.select("user_id", F.upper("name").alias("name"))
    for r in gs.entity_facts(seeds, ents, edges, hops, per_seed=100).collect():
        want = shortest(raw, r["user_id"], r["name_lower"], hops)
        assert {x["other"].lower(): (x["distance"], tuple(x["relation_chain"])) for x in r["relations"]} == want


def test_hop_limits_and_isolated_seed(spark):
    ents, edges, _ = graph(spark, 1)
    with pytest.raises(ValueError):
        gs.entity_facts(ents, ents, edges, 4)
    row = gs.entity_facts(ents.filter("name = 'N11'"), ents, edges, 2).first()
    assert row["relations"] == []


def test_hub_keeps_nearest_twelve(spark):
    ents = spark.createDataFrame([("u", f"n{i:03d}", f"n{i:03d}", "Concept", None, None, None, None) for i in range(400)], ENT)
    edges = spark.createDataFrame([("u", "n000", f"n{i:03d}", "r", None) for i in range(1, 400)], EDGE)
    got = {r["name_lower"]: [x["other"] for x in r["relations"]] for r in gs.entity_facts(ents, ents, edges, 2).collect()}
    assert got["n000"] == [f"n{i:03d}" for i in range(1, 13)]
    assert got["n005"][0] == "n000" and len(got["n005"]) == 12


def test_delete_only_document_removes_entity_for_its_tenant(spark):
    ents, edges, _ = graph(spark, 3)
    docs = ents.select("user_id", "name_lower", F.when(F.col("name_lower").isin("n0", "n1"), "x").otherwise("y").alias("document_id"))
    edge_docs = edges.select(*gs.EDGE, F.lit("y").alias("document_id"))
    gone = spark.createDataFrame([("a", "x")], "user_id string, document_id string")
    nodes, nd, links, ld = gs.delete_document(gone, ents, docs, edges, edge_docs)
    left = {(r["user_id"], r["name_lower"]) for r in nodes.collect()}
    assert left == {(u, f"n{i}") for u, i in product("ab", range(12))} - {("a", "n0"), ("a", "n1")}
    assert links.filter("user_id = 'a' and (source_lower in ('n0', 'n1') or target_lower in ('n0', 'n1'))").count() == 0
    assert links.filter("user_id = 'b'").count() == edges.filter("user_id = 'b'").count()
    assert nd.filter("user_id = 'a' and document_id = 'x'").count() == 0 and ld.count() == links.count()


def test_upsert_keeps_first_non_null(spark):
    cols = "user_id string, name_lower string, name string, type string, description string, embedding array<double>, seen_at timestamp, seq long"
    new = spark.createDataFrame([("u", "k", None, "A", None, None, None, 1), ("u", "k", "K", "B", "d", [1.0], None, 2), ("u", "k", "Z", "C", "e", [2.0], None, 3)], cols)
    r = gs.upsert_entities(spark.createDataFrame([], ENT), new).first()
    assert (r["name"], r["type"], r["description"], r["embedding"]) == ("K", "A", "d", [1.0])


def test_cooccurrence_gaps(spark):
    rows = [("u", g, "a", 0) for g in ("0", "1", "3", "10")] + [("u", g, "b", int(g)) for g in ("0", "1", "3", "10")]
    got = {r["document_id"]: r["score"] for r in ex.cooccurrence(spark.createDataFrame(rows, "user_id string, document_id string, entity string, chunk_index int")).collect()}
    assert got == {"0": 3, "1": 2, "3": 1}


def test_cooccurrence_matches_all_pairs(spark):
    rng = random.Random(8)
    rows = sorted({("u", "d", rng.choice("abcd"), rng.randrange(25)) for _ in range(60)})
    want = {}
    for (_, _, a, ca), (_, _, b, cb) in product(rows, rows):
        gap = abs(ca - cb)
        if a < b and gap <= 3:
            want[a, b] = want.get((a, b), 0) + (3 if gap == 0 else 2 if gap == 1 else 1)
    got = {(r["a"], r["b"]): r["score"] for r in ex.cooccurrence(spark.createDataFrame(rows, "user_id string, document_id string, entity string, chunk_index int")).collect()}
    assert got == want


def test_match_prefers_long_names_and_skips_short(spark):
    names = ["Cosine", "Cosine Distance", "AI", "cosine", "Other"]
    ents = spark.createDataFrame([("u", str(i), n, "Concept", None, None, None, None) for i, n in enumerate(names)], ENT)
    texts = spark.createDataFrame([(1, "u", "what is cosine distance in ai?")], "query_id long, user_id string, haystack string")
    assert [r["name"] for r in gx.match_entities(texts, ents).orderBy("pos").collect()] == ["Cosine Distance", "Cosine"]


def test_merge_unique_keeps_first_spelling(spark):
    rows = [(1, "u", 0, 0, "B"), (1, "u", 0, 1, "a"), (1, "u", 1, 0, "A"), (1, "u", 1, 1, "c")]
    out = gx.merge_unique(spark.createDataFrame(rows, "query_id long, user_id string, source int, pos int, name string"), 3)
    assert [r["name"] for r in out.orderBy("rank").collect()] == ["B", "a", "c"]


def test_cut_lists_keep_the_nearest(spark):
    """Hubs with more neighbours than a list holds, names that many nodes share, and few facts a seed."""
    rng = random.Random(8)
    names = ["Same" if i % 3 == 0 else f"n{i:03d}" for i in range(120)]
    ents = spark.createDataFrame([("u", f"k{i:03d}", n, "Concept", None, None, None, None) for i, n in enumerate(names)], ENT)
    pairs = {(0, i) for i in range(1, 80)} | {(1, i) for i in range(3, 60, 3)} | {(rng.randrange(60, 120), rng.randrange(60, 120)) for _ in range(60)}
    rows = [("u", f"k{a:03d}", f"k{b:03d}", rng.choice("pqr"), None) for a, b in sorted(pairs) if a != b]
    edges = spark.createDataFrame(rows, EDGE)
    for hops in (1, 2, 3):
        for r in gs.entity_facts(ents, ents, edges, hops, per_seed=3).collect():
            want = shortest(rows, "u", r["name_lower"], hops)
            order = sorted((d, names[int(o[1:])], o, c) for o, (d, c) in want.items() if names[int(o[1:])] != r["name"])[:3]
            assert [(x["distance"], x["other"], tuple(x["relation_chain"])) for x in r["relations"]] == [(d, n, c) for d, n, _, c in order], r


def test_replies_are_parsed_in_one_pass(spark, monkeypatch):
    from loreweave.functions import jsonrec
    from loreweave.operators import extraction as ex

    stored = []
    monkeypatch.setattr(jsonrec, "cut_lineage", lambda df: stored.append(df) or df)
    good, odd = '{"name":"A"},{"name":"B","type":"Person"}', 'null,5,"x",{"name":7},{"name":"C","type":null},{"name":"D","description":3},{"Name":"E"}'
    one = ['{"entities":[%s]}', "```json\n" + '{"entities":[%s]}' + "\n```", 'so {"entities":[%s]} } ok', '{"entities":[%s]} {"a":1}']
    two = '{"relationships":[{"source":"a","target":" b ","relation":"r"},7,null,{"source":"A","target":"B","relation":null},{"source":"A","target":"Z","relation":"r"}]}'
    rows = [("u", "d", i, x % f"{good},{odd}", False, two, False) for i, x in enumerate(one)]
    got = ex.chunk_results(spark.createDataFrame(
        rows, "user_id string, document_id string, chunk_index int, pass1_raw string, pass1_failed boolean, pass2_raw string, pass2_failed boolean"
    ))
    want = [(0, "A", "Concept", ""), (1, "B", "Person", "")]
    assert stored == []
    for r in got.collect():
        assert [tuple(e) for e in r["entities"]] == want and [tuple(x) for x in r["relationships"]] == [(0, "a", " b ", "r")]
