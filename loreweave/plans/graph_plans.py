"""Graph store, graph reads and expansion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreweave.functions.text import PREDICATE_ALIASES, canonical_predicate
from loreweave.operators import graph_expand as gx
from loreweave.operators import graph_store as gs
from loreweave.operators.ranking import top_k
from loreweave.plans.registry import plan, table

def ranked(df):
    return df.withColumn("rank", F.col("rank").cast("long"))


@plan("k1_entity_upsert", """
SELECT user_id, name_lower, arg_min(name, o) AS name, arg_min(type, o) AS type, arg_min(description, o) FILTER (WHERE description IS NOT NULL) AS description,
  arg_min(seen_at, o) AS created_at, max(seen_at) AS last_seen_at
FROM (SELECT *, (seq % 2) * 1000000000000 + seq AS o FROM observations) GROUP BY 1, 2
""", ("observations",))
def k1(t):
    """Even orders are the stored graph, odd orders come on top of it."""
    obs = t.observations
    empty = t.entities.limit(0)
    stored = gs.upsert_entities(empty, obs.filter("seq % 2 = 0"))
    merged = gs.upsert_entities(stored, obs.filter("seq % 2 = 1"))
    return merged.select("user_id", "name_lower", "name", "type", "description", "created_at", "last_seen_at")


@plan("k1_entity_documents", "SELECT user_id, name_lower, CAST(count(*) AS BIGINT) AS documents, min(document_id) AS first_document FROM entity_docs GROUP BY 1, 2", ("entity_docs",))
def k1b(t):
    obs = t.observations.select("user_id", "name_lower", "document_id", "seq")
    merged = gs.upsert_members(obs.filter("seq % 3 = 0"), obs.filter("seq % 3 <> 1").unionByName(obs.filter("seq % 3 = 1")), gs.NODE)
    return merged.groupBy(*gs.NODE).agg(F.count(F.lit(1)).alias("documents"), F.min("document_id").alias("first_document"))


@plan("k2_edge_upsert", """
SELECT e.user_id, source_lower, target_lower, relation, min(created_at) AS created_at, CAST(count(DISTINCT document_id) AS BIGINT) AS documents FROM edge_rows e
JOIN (SELECT user_id, name_lower FROM entities WHERE name_lower NOT LIKE '%7') a ON a.user_id = e.user_id AND a.name_lower = e.source_lower
JOIN (SELECT user_id, name_lower FROM entities WHERE name_lower NOT LIKE '%7') b ON b.user_id = e.user_id AND b.name_lower = e.target_lower
GROUP BY 1, 2, 3, 4
""", ("edge_rows", "entities"))
def k2(t):
    known = t.entities.filter(~F.col("name_lower").endswith("7"))
    rows = t.edge_rows
    none = rows.limit(0)
    edges = gs.upsert_edges(none, rows, known)
    # The join with the edges leaves out sets of edges without both ends.
    members = gs.upsert_members(none, rows, gs.EDGE)
    counts = members.groupBy(*gs.EDGE).agg(F.count(F.lit(1)).alias("documents"))
    return edges.join(counts, gs.EDGE)


@plan("k3_alias_candidates", "SELECT user_id, name_lower, coalesce(type, 'Concept') AS type FROM (SELECT user_id, name_lower, CASE WHEN length(name_lower) % 5 <> 0 THEN type END AS type FROM entities)", ("entities",))
def k3(t):
    return gs.alias_candidates(t.entities.withColumn("type", F.when(F.length("name_lower") % 5 != 0, F.col("type"))))


@plan("k3_semantic_candidates", """
SELECT CAST(label % 3 AS VARCHAR) AS user_id, 'v' || vec_id AS name_lower, coalesce(CASE WHEN label <> 4 THEN CAST(label AS VARCHAR) END, 'Concept') AS type, CAST(len(embedding) AS BIGINT) AS dims
FROM embeddings WHERE vec_id % 3 <> 0
""")
def k3b(t):
    v = t.vectors.withColumn("name_lower", F.concat(F.lit("v"), "vec_id")).withColumn("type", F.when(F.col("type") != "4", F.col("type")))
    v = v.withColumn("embedding", F.when(F.col("vec_id") % 3 != 0, F.col("embedding")))
    return gs.semantic_candidates(v).select("user_id", "name_lower", "type", F.size("embedding").cast("long").alias("dims"))


@plan("k4_recent_entities", """
SELECT user_id, name, type, description, CAST(rank AS BIGINT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_seen_at DESC, name_lower) AS rank FROM entities) WHERE rank <= 200
""", ("entities",))
def k4(t):
    return ranked(gs.recent_entities(t.entities)).select("user_id", "name", "type", "description", "rank")


@plan("k5_one_hop_neighbours", """
SELECT user_id, source, target, relation, target_type, target_description, CAST(rank AS BIGINT) AS rank FROM (
  SELECT a.user_id, a.name AS source, b.name AS target, s.relation, b.type AS target_type, b.description AS target_description,
    row_number() OVER (PARTITION BY a.user_id, a.name_lower ORDER BY b.name, s.relation, s.direction, b.name_lower) AS rank
  FROM entities a JOIN sym s ON s.user_id = a.user_id AND s.node = a.name_lower JOIN entities b ON b.user_id = a.user_id AND b.name_lower = s.other_lower) WHERE rank <= 50
""", ("entities", "sym"))
def k5(t):
    return ranked(gs.neighbours(t.entities.select("user_id", "name"), t.entities, t.edges)).drop("direction")


table("snap_nodes", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_seen_at DESC, name_lower) AS rank FROM entities) WHERE rank <= 500
""", ("entities",))
table("snap_links", """
SELECT user_id, source, target, relation FROM (
  SELECT e.user_id, a.name AS source, b.name AS target, e.relation, row_number() OVER (PARTITION BY e.user_id ORDER BY e.source_lower, e.target_lower, e.relation) AS rank
  FROM edges e JOIN snap_nodes a ON a.user_id = e.user_id AND a.name_lower = e.source_lower JOIN snap_nodes b ON b.user_id = e.user_id AND b.name_lower = e.target_lower)
WHERE rank <= 2000
""", ("edges", "snap_nodes"))


@plan("k6_snapshot_nodes", "SELECT user_id, name AS id, name, coalesce(type, 'Concept') AS type, coalesce(description, '') AS description, CAST(rank AS BIGINT) AS rank FROM snap_nodes", ("snap_nodes",))
def k6a(t):
    return ranked(gs.snapshot(t.entities, t.edges)[0]).drop("name_lower")


@plan("k6_snapshot_links", "SELECT * FROM snap_links", ("snap_links",))
def k6b(t):
    return gs.snapshot(t.entities, t.edges)[1].drop("rank")


# Documents asked for: every order of a customer, one request per customer.
table("asked_docs", """
SELECT DISTINCT c_name AS query_id, user_id, document_id FROM order_lines
""", ("order_lines",))


def asked_docs(t):
    return t.order_lines.select(F.col("c_name").alias("query_id"), "user_id", "document_id").distinct()


@plan("k7_entities_of_documents", """
SELECT query_id, name, CAST(rank AS BIGINT) AS rank FROM (
  SELECT x.query_id, e.name, row_number() OVER (PARTITION BY x.query_id ORDER BY e.last_seen_at DESC, e.name_lower) AS rank FROM (
    SELECT DISTINCT a.query_id, d.user_id, d.name_lower FROM asked_docs a JOIN entity_docs d USING (user_id, document_id)) x JOIN entities e USING (user_id, name_lower))
WHERE rank <= 32
""", ("asked_docs", "entity_docs", "entities"))
def k7(t):
    return ranked(gs.entities_of_documents(asked_docs(t), t.entities, t.entity_docs, 32)).select("query_id", "name", "rank")


FACTS = """
SELECT s.user_id, s.name_lower AS seed, s.name, o.other, o.distance, o.chain, o.rank, o.other_type, o.other_description FROM ({seeds}) s LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY user_id, seed ORDER BY distance, other, node) AS rank FROM (
    SELECT r.user_id, r.seed, r.node, r.distance, r.chain, e.name AS other, e.type AS other_type, e.description AS other_description
    FROM (SELECT user_id, seed, node, 1 AS distance, chain FROM {p}hop1 UNION ALL SELECT user_id, seed, node, 2, chain FROM {p}hop2) r
    JOIN entities e ON e.user_id = r.user_id AND e.name_lower = r.node JOIN ({seeds}) z ON z.user_id = r.user_id AND z.name_lower = r.seed WHERE e.name <> z.name)) o
  ON o.user_id = s.user_id AND o.seed = s.name_lower AND o.rank <= 12
"""


def fact_tables(prefix: str, seeds: str, uses: tuple[str, ...]) -> None:
    """Two-hop breadth-first search from the seed rows, unrolled."""
    table("step" if prefix == "" else f"{prefix}step", "SELECT user_id, node, other_lower, min(relation) AS relation FROM sym GROUP BY 1, 2, 3", ("sym",))
    step = "step" if prefix == "" else f"{prefix}step"
    table(f"{prefix}hop1", f"""
SELECT s.user_id, s.name_lower AS seed, t.other_lower AS node, min(t.relation) AS chain FROM ({seeds}) s JOIN {step} t ON t.user_id = s.user_id AND t.node = s.name_lower
WHERE t.other_lower <> s.name_lower GROUP BY 1, 2, 3""", (step, *uses))
    table(f"{prefix}hop2", f"""
SELECT h.user_id, h.seed, t.other_lower AS node, min(h.chain || ' → ' || t.relation) AS chain FROM {prefix}hop1 h JOIN {step} t ON t.user_id = h.user_id AND t.node = h.node
WHERE t.other_lower <> h.seed AND NOT EXISTS (SELECT 1 FROM {prefix}hop1 x WHERE x.user_id = h.user_id AND x.seed = h.seed AND x.node = t.other_lower) GROUP BY 1, 2, 3""",
          (f"{prefix}hop1", step))
    table(f"{prefix}facts", FACTS.format(seeds=seeds, p=prefix), (f"{prefix}hop1", f"{prefix}hop2", "entities", *uses))


fact_tables("", "SELECT user_id, name_lower, name FROM entities", ("entities",))


@plan("k8_multi_hop_facts", """
SELECT user_id, name, coalesce(other, '') AS other, coalesce(other_type, '') AS other_type, CAST(coalesce(distance, 0) AS BIGINT) AS distance, coalesce(chain, '') AS chain, CAST(coalesce(rank, 0) AS BIGINT) AS rank FROM facts
""", ("facts",))
def k8(t):
    seeds = t.entities.select("user_id", F.upper("name").alias("name"))
    rows = gs.entity_facts(seeds, t.entities, t.edges, hops=2)
    r = F.col("r")
    return rows.select("user_id", "name", F.explode_outer("relations").alias("r")).select(
        "user_id", "name", F.coalesce(r["other"], F.lit("")).alias("other"), F.coalesce(r["other_type"], F.lit("")).alias("other_type"),
        F.coalesce(r["distance"], F.lit(0)).cast("long").alias("distance"),
        F.coalesce(F.array_join(r["relation_chain"], " → "), F.lit("")).alias("chain"), F.coalesce(r["rank"], F.lit(0)).cast("long").alias("rank"),
    )


table("gone_docs", "SELECT DISTINCT user_id, document_id FROM order_lines WHERE seq % 5 <> 0", ("order_lines",))
table("left_nodes", """
SELECT * FROM entities e WHERE NOT EXISTS (SELECT 1 FROM (SELECT user_id, name_lower, bool_and(g.document_id IS NOT NULL) AS all_gone FROM entity_docs d LEFT JOIN gone_docs g USING (user_id, document_id) GROUP BY 1, 2) x
  WHERE x.user_id = e.user_id AND x.name_lower = e.name_lower AND x.all_gone)
""", ("entities", "entity_docs", "gone_docs"))


def _after_delete(t):
    gone = t.order_lines.filter("seq % 5 <> 0").select("user_id", "document_id")
    return gs.delete_document(gone, t.entities, t.entity_docs, t.edges, t.edge_docs)


@plan("k9_delete_entities", "SELECT user_id, name_lower, name, type FROM left_nodes", ("left_nodes",))
def k9a(t):
    return _after_delete(t)[0].select("user_id", "name_lower", "name", "type")


@plan("k9_delete_edges", """
SELECT d.user_id, d.source_lower, d.target_lower, d.relation, CAST(count(*) AS BIGINT) AS documents FROM edge_docs d LEFT JOIN gone_docs g USING (user_id, document_id)
JOIN left_nodes a ON a.user_id = d.user_id AND a.name_lower = d.source_lower JOIN left_nodes b ON b.user_id = d.user_id AND b.name_lower = d.target_lower
WHERE g.document_id IS NULL GROUP BY 1, 2, 3, 4
""", ("edge_docs", "gone_docs", "left_nodes"))
def k9b(t):
    # Document sets are those of edges that are left, and every edge that a document supports has one.
    return _after_delete(t)[3].groupBy(*gs.EDGE).agg(F.count(F.lit(1)).alias("documents"))


@plan("k10_backfill_name_keys", """
SELECT user_id, CAST(count(*) AS BIGINT) AS backfilled FROM entities WHERE length(name) % 2 = 0 GROUP BY 1
""", ("entities",))
def k10(t):
    rows = t.entities.withColumn("name_lower", F.when(F.length("name") % 2 != 0, F.col("name_lower")))
    return gs.backfill_name_keys(rows)[1]


@plan("k10_backfilled_rows", "SELECT user_id, name, name_lower FROM entities", ("entities",))
def k10b(t):
    rows = t.entities.withColumn("name_lower", F.when(F.length("name") % 2 != 0, F.col("name_lower")))
    return gs.backfill_name_keys(rows)[0].select("user_id", "name", "name_lower")


@plan("k11_backfill_embeddings", r"""
WITH words AS (
  SELECT user_id, name_lower, unnest(string_split_regex(lower(name || CASE WHEN coalesce(description, '') <> '' THEN ': ' || description ELSE '' END), '[^\p{L}\p{N}]+')) AS tok FROM entities),
slots AS (
  SELECT user_id, name_lower, slot, c / sqrt(sum(c * c) OVER (PARTITION BY user_id, name_lower)) AS v FROM (
    SELECT user_id, name_lower, CAST(('0x' || substr(md5(tok), 1, 8)) AS BIGINT) % 64 AS slot, CAST(count(*) AS DOUBLE) AS c FROM words WHERE tok <> '' GROUP BY 1, 2, 3))
SELECT user_id, name_lower, CAST(count(*) AS BIGINT) AS slots, round(sum(v), 6) AS total, round(sum(v * slot), 6) AS moment, min(n) AS backfilled
FROM slots JOIN (SELECT user_id, count(*) AS n FROM entities GROUP BY 1) USING (user_id) GROUP BY 1, 2
""", ("entities",))
def k11(t):
    filled, counts = gs.backfill_embeddings(t.entities)
    plus = lambda a, x: a + x
    at = F.transform("embedding", lambda x, i: F.when(x != 0, x * i).otherwise(0.0))
    return filled.join(counts, "user_id").select(
        "user_id", "name_lower", F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("slots"),
        F.round(F.aggregate("embedding", F.lit(0.0), plus), 6).alias("total"), F.round(F.aggregate(at, F.lit(0.0), plus), 6).alias("moment"), "backfilled",
    )


# Question texts: what a customer bought, in one order.
table("asks", """
SELECT document_id AS query_id, user_id, lower(min(c_name) || ' bought ' || string_agg(p_name, ', ' ORDER BY l_linenumber, p_name) || ' from ' || max(s_name)) AS haystack
FROM order_lines GROUP BY 1, 2
""", ("order_lines",))
table("matched", """
SELECT query_id, user_id, name, row_number() OVER (PARTITION BY query_id ORDER BY length(name) DESC, pool) AS rank FROM (
  SELECT a.query_id, a.user_id, e.name, e.pool FROM asks a JOIN (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_seen_at DESC, name_lower) AS pool FROM entities) e
  ON e.user_id = a.user_id AND e.pool <= 500 AND length(e.name) >= 3 AND contains(a.haystack, lower(e.name)))
""", ("asks", "entities"))


def _asks(t):
    from loreweave.operators.ranking import join_text

    bought = join_text(F.col("p_name"), [F.col("l_linenumber"), F.col("p_name")], ", ")
    return t.order_lines.groupBy(F.col("document_id").alias("query_id"), "user_id").agg(
        F.lower(F.concat(F.min("c_name"), F.lit(" bought "), bought, F.lit(" from "), F.max("s_name"))).alias("haystack")
    )


@plan("k12_text_entity_match", "SELECT query_id, user_id, name, CAST(rank - 1 AS BIGINT) AS pos FROM matched WHERE rank <= 8", ("matched",))
def k12(t):
    return gx.match_entities(_asks(t), t.entities).withColumn("pos", F.col("pos").cast("long"))


table("line_names", """
SELECT user_id, document_id AS query_id, 0 AS source, l_linenumber AS pos, upper(p_name) AS name FROM order_lines
UNION ALL SELECT user_id, document_id, 1, l_linenumber, p_name FROM order_lines UNION ALL SELECT user_id, document_id, 2, l_linenumber, s_name FROM order_lines
""", ("order_lines",))


@plan("k13_first_seen_union", """
SELECT query_id, lower(name) AS name_key, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s, p, lower(name)) AS BIGINT) AS rank FROM (
  SELECT query_id, arg_min(name, source * 1000 + pos) AS name, min(source * 1000 + pos) // 1000 AS s, min(source * 1000 + pos) % 1000 AS p FROM line_names GROUP BY query_id, lower(name))
""", ("line_names",))
def k13(t):
    rows = t.order_lines.select("user_id", F.col("document_id").alias("query_id"), F.col("l_linenumber").alias("pos"), F.inline(F.array(
        F.struct(F.lit(0).alias("source"), F.upper("p_name").alias("name")), F.struct(F.lit(1).alias("source"), F.col("p_name").alias("name")),
        F.struct(F.lit(2).alias("source"), F.col("s_name").alias("name")),
    )))
    return ranked(gx.merge_unique(rows)).select("query_id", F.lower("name").alias("name_key"), "rank")


@plan("k13_document_order", """
SELECT query_id, document_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY r) AS BIGINT) AS rank FROM (
  SELECT query_id, document_id, min(rank) AS r FROM candidates GROUP BY 1, 2)
""", ("candidates",))
def k13b(t):
    from loreweave.operators import retrieval

    pool = retrieval.candidate_search(retrieval.encode_queries(t.questions), t.index, inverted=t.inverted)
    return ranked(gx.chunk_documents(pool)).select("query_id", "document_id", "rank")


@plan("k14_relation_cleanup", r"""
SELECT name, l_linenumber, other, relation, CAST(len(chain) AS BIGINT) AS hops FROM (
  SELECT c_name AS name, l_linenumber, CASE WHEN l_linenumber % 3 <> 0 THEN p_name END AS other, chain, array_to_string(chain, ' → ') AS relation FROM (
    SELECT *, list_transform(list_filter(CASE l_linenumber % 4 WHEN 0 THEN ['uses ', NULL, 'part of'] WHEN 1 THEN ['uses', ''] WHEN 2 THEN ['', NULL] ELSE [' in'] END, lambda x: x IS NOT NULL AND x <> ''), lambda x: trim(x)) AS chain FROM order_lines))
WHERE other IS NOT NULL AND len(chain) > 0
""", ("order_lines",))
def k14(t):
    n = F.col("l_linenumber") % 4
    s = lambda *xs: F.array(*[F.lit(x).cast("string") for x in xs])
    chain = F.when(n == 0, s("uses ", None, "part of")).when(n == 1, s("uses", "")).when(n == 2, s("", None)).otherwise(s(" in"))
    none = F.lit(None).cast("string")
    raw = F.array(F.struct(
        F.when(F.col("l_linenumber") % 3 != 0, F.col("p_name")).alias("other"), none.alias("other_type"), none.alias("other_description"),
        F.lit(None).cast("int").alias("distance"), chain.alias("relation_chain"),
    ))
    rows = t.order_lines.select(F.col("c_name").alias("name"), "l_linenumber", F.explode(gx.clean_relations(raw)).alias("r"))
    return rows.select("name", "l_linenumber", "r.other", "r.relation", F.col("r.distance").cast("long").alias("hops"))


# Expansion: one question per order; its passage is the order text, its document the order.
table("expand_targets", """
SELECT query_id, user_id, name, rank FROM (
  SELECT query_id, user_id, name, row_number() OVER (PARTITION BY query_id ORDER BY o, k) AS rank FROM (
    SELECT query_id, user_id, arg_min(name, o) AS name, min(o) AS o, k FROM (
      SELECT query_id, user_id, name, rank AS o, lower(name) AS k FROM matched WHERE rank <= 8
      UNION ALL SELECT query_id, user_id, name, 1000 + rank, lower(name) FROM (
        SELECT x.query_id, x.user_id, e.name, row_number() OVER (PARTITION BY x.query_id ORDER BY e.last_seen_at DESC, e.name_lower) AS rank
        FROM (SELECT DISTINCT document_id AS query_id, user_id, name_lower FROM entity_docs) x JOIN entities e USING (user_id, name_lower)) WHERE rank <= 32)
    GROUP BY query_id, user_id, k)) WHERE rank <= 8
""", ("matched", "entity_docs", "entities"))
fact_tables("x", "SELECT DISTINCT e.user_id, e.name_lower, e.name FROM entities e JOIN expand_targets t ON t.user_id = e.user_id AND lower(t.name) = e.name_lower", ("entities", "expand_targets"))


def _expanded(t):
    asks = _asks(t)
    queries = asks.select("query_id", "user_id", F.col("haystack").alias("query"))
    passages = asks.select("query_id", "user_id", F.col("query_id").alias("document_id"), F.lit("").alias("text"), F.lit(1).alias("rank"))
    return gx.expand_with_graph(queries, passages, t.entities, t.entity_docs, t.edges)


@plan("k15_graph_expansion", """
SELECT t.query_id, e.name, e.type, coalesce(e.description, '') AS description, CAST(t.rank AS BIGINT) AS rank, coalesce(f.facts, '') AS facts
FROM expand_targets t JOIN entities e ON e.user_id = t.user_id AND e.name_lower = lower(t.name)
LEFT JOIN (SELECT user_id, seed, string_agg(chain || ' ' || other || ' ' || distance, '; ' ORDER BY rank) AS facts FROM xfacts WHERE other IS NOT NULL GROUP BY 1, 2) f
  ON f.user_id = e.user_id AND f.seed = e.name_lower
""", ("expand_targets", "entities", "xfacts"))
def k15(t):
    line = F.transform("relations", lambda r: F.concat_ws(" ", r["relation"], r["other"], r["distance"].cast("string")))
    return ranked(_expanded(t)).select("query_id", "name", "type", "description", "rank", F.array_join(line, "; ").alias("facts"))


# Facts of all seeds as the answer of one question per user; nodes take the better description.
def _answer_facts(t, first=None):
    """``first``: only so many facts of every user, by their rank."""
    seeds = t.entities.select("user_id", "name")
    if first is not None:
        seeds = top_k(t.entities, ["user_id"], [F.asc("name_lower")], first, salt_on=["name_lower"]).select("user_id", "name")
    rows = gs.entity_facts(seeds, t.entities, t.edges, hops=2)
    # Direction follows the hop parity so that both readings occur.
    rel = F.transform(gx.clean_relations(F.col("relations")), lambda r: r.withField("direction", F.when(r["distance"] == 2, "in").otherwise("out")))
    return rows.select(
        F.col("user_id").alias("query_id"), "name", F.lit("Concept").alias("type"), F.coalesce("description", F.lit("")).alias("description"),
        # Facts are only ever put in order by their rank, so the key serves as one and no user's facts are numbered by one task.
        rel.alias("relations"), F.col("name_lower").alias("rank"),
    )


@plan("k16_answer_nodes", """
SELECT query_id, name, coalesce(arg_min(type, o) FILTER (WHERE type <> 'Concept'), 'Concept') AS type, coalesce(arg_min(description, o) FILTER (WHERE description <> ''), '') AS description FROM (
  SELECT user_id AS query_id, name, 'Concept' AS type, coalesce(description, '') AS description, row_number() OVER (PARTITION BY user_id ORDER BY name_lower) AS o FROM entities
  UNION ALL SELECT user_id, other, other_type, coalesce(other_description, ''), 1000000000 + dense_rank() OVER (PARTITION BY user_id ORDER BY seed) * 100 + rank FROM facts WHERE other IS NOT NULL)
GROUP BY 1, 2
""", ("facts", "entities"))
def k16a(t):
    return gx.answer_subgraph(_answer_facts(t))[0]


@plan("k16_answer_links", """
SELECT DISTINCT user_id AS query_id, CASE WHEN distance = 2 THEN other ELSE name END AS source, CASE WHEN distance = 2 THEN name ELSE other END AS target, chain AS relation FROM facts WHERE other IS NOT NULL
""", ("facts",))
def k16b(t):
    return gx.answer_subgraph(_answer_facts(t))[1]


@plan("k17_answer_highlight", """
SELECT a.query_id, coalesce(h.names, '') AS highlighted, coalesce(c.docs, '') AS document_ids, a.used AND f.query_id IS NOT NULL AS has_graph FROM (
  SELECT document_id AS query_id, user_id, lower(string_agg(p_name, ' and ' ORDER BY l_linenumber, p_name)) AS answer, seq % 3 <> 0 AS used FROM order_lines GROUP BY 1, 2, seq) a
LEFT JOIN (SELECT query_id, string_agg(name, '|' ORDER BY name) AS names FROM (
  SELECT DISTINCT q.query_id, e.name FROM (SELECT document_id AS query_id, lower(string_agg(p_name, ' and ' ORDER BY l_linenumber, p_name)) AS answer FROM order_lines GROUP BY 1) q
  JOIN entity_docs d ON d.document_id = q.query_id AND CAST(d.document_id AS BIGINT) % 2 = 0 JOIN entities e USING (user_id, name_lower) WHERE contains(q.answer, lower(e.name))) GROUP BY 1) h USING (query_id)
LEFT JOIN (SELECT document_id AS query_id, string_agg(DISTINCT CAST(l_linenumber AS VARCHAR), '|' ORDER BY CAST(l_linenumber AS VARCHAR)) AS docs FROM order_lines GROUP BY 1) c USING (query_id)
LEFT JOIN (SELECT DISTINCT document_id AS query_id FROM entity_docs WHERE CAST(document_id AS BIGINT) % 2 = 0) f USING (query_id)
""", ("order_lines", "entity_docs", "entities"))
def k17(t):
    from loreweave.operators.ranking import join_text

    answers = t.order_lines.groupBy(F.col("document_id").alias("query_id"), "seq").agg(
        join_text(F.col("p_name"), [F.col("l_linenumber"), F.col("p_name")], " and ").alias("answer")
    ).withColumn("used_graph", F.col("seq") % 3 != 0)
    facts = t.entity_docs.filter(F.col("document_id").cast("long") % 2 == 0).join(t.entities, gs.NODE).select(F.col("document_id").alias("query_id"), "name")
    cited = t.order_lines.select(F.col("document_id").alias("query_id"), F.col("l_linenumber").cast("string").alias("document_id"))
    out = gx.highlight(answers, facts, cited)
    return out.select("query_id", F.array_join("highlighted", "|").alias("highlighted"), F.array_join("document_ids", "|").alias("document_ids"), "has_graph")


SEARCH = "SELECT user_id, CASE user_id WHEN 'u0' THEN ' RING' WHEN 'u1' THEN '' WHEN 'u2' THEN 'nation_7' WHEN 'u3' THEN '#00000000' ELSE 'zzz' END AS q FROM (SELECT DISTINCT user_id FROM entities)"
table("search_kept", f"""
SELECT DISTINCT user_id, name FROM (
  SELECT n.user_id, n.name FROM snap_nodes n JOIN ({SEARCH}) s USING (user_id) WHERE contains(lower(n.name), lower(trim(s.q)))
  UNION ALL SELECT l.user_id, CASE WHEN m.name = l.source THEN l.target ELSE l.source END FROM snap_links l JOIN (
    SELECT n.user_id, n.name FROM snap_nodes n JOIN ({SEARCH}) s USING (user_id) WHERE contains(lower(n.name), lower(trim(s.q)))) m ON m.user_id = l.user_id AND (m.name = l.source OR m.name = l.target))
""", ("snap_nodes", "snap_links", "entities"))


def _searched(t):
    nodes, links = gs.snapshot(t.entities, t.edges)
    u = F.col("user_id")
    asked = t.entities.select("user_id").distinct().withColumn(
        "search", F.when(u == "u0", " RING").when(u == "u1", "").when(u == "u2", "nation_7").when(u == "u3", "#00000000").otherwise("zzz")
    )
    return gx.search_subgraph(asked, nodes, links)


@plan("k18_search_nodes", "SELECT n.user_id, n.name, n.type FROM snap_nodes n JOIN search_kept k USING (user_id, name)", ("snap_nodes", "search_kept"))
def k18a(t):
    return _searched(t)[0].select("user_id", "name", "type")


@plan("k18_search_links", """
SELECT l.* FROM snap_links l JOIN search_kept a ON a.user_id = l.user_id AND a.name = l.source JOIN search_kept b ON b.user_id = l.user_id AND b.name = l.target
""", ("snap_links", "search_kept"))
def k18b(t):
    return _searched(t)[1].select("user_id", "source", "target", "relation")


@plan("k19_node_relations", """
SELECT l.user_id, l.source AS name, 'outgoing' AS direction, l.source, l.target, l.relation FROM snap_links l JOIN snap_nodes n ON n.user_id = l.user_id AND n.name = l.source
UNION ALL SELECT l.user_id, l.target, 'incoming', l.source, l.target, l.relation FROM snap_links l JOIN snap_nodes n ON n.user_id = l.user_id AND n.name = l.target
""", ("snap_links", "snap_nodes"))
def k19(t):
    nodes, links = gs.snapshot(t.entities, t.edges)
    return gx.relations_of_node(nodes, links.drop("rank"))


@plan("a3_predicate_canonicalisation", """
SELECT raw, CASE trim(regexp_replace(regexp_replace(lower(trim(raw)), '\\s+', ' ', 'g'), '[.]+$', '')) WHEN 'headquartered in' THEN 'located in' WHEN 'based in' THEN 'located in' WHEN 'situated in' THEN 'located in' WHEN 'utilizes' THEN 'uses' END AS relation,
  CAST(count(*) AS BIGINT) AS n FROM (
  SELECT 'Headquartered in' AS raw FROM order_lines UNION ALL SELECT 'utilizes' FROM order_lines UNION ALL SELECT 'based  in.' FROM order_lines UNION ALL SELECT 'situated in' FROM order_lines) GROUP BY 1, 2
""".replace("\\\\", "\\"), ("order_lines",))
def a3(t):
    raw = t.raw_edges.select(F.col("relation").alias("raw"), canonical_predicate(F.col("relation")).alias("relation"))
    return raw.groupBy("raw", "relation").agg(F.count(F.lit(1)).alias("n"))


_PHRASES = sorted(PREDICATE_ALIASES) + ["knows", "part of"]
_FORMS = "[x, upper(x), '  ' || replace(x, ' ', '   ') || ' ', x || '.)', x || '?!']"


@plan("a3_all_predicates", f"""
WITH said AS (SELECT document_id, l_linenumber, unnest(list_transform({_PHRASES!r}, lambda p: p)) AS x FROM order_lines WHERE l_linenumber = 1),
forms AS (SELECT document_id, unnest({_FORMS}) AS raw FROM said)
SELECT raw, coalesce(m.b, k) AS relation, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT raw, regexp_replace(trim(regexp_replace(lower(raw), '\\s+', ' ', 'g')), '[.,;:!?''"()\\[\\]]+$', '') AS k FROM forms)
LEFT JOIN (SELECT unnest({sorted(PREDICATE_ALIASES)!r}) AS a, unnest({[PREDICATE_ALIASES[k] for k in sorted(PREDICATE_ALIASES)]!r}) AS b) m ON m.a = k GROUP BY 1, 2
""", ("order_lines",))
def a3b(t):
    """Every alias in every spelling, once an order."""
    said = t.order_lines.filter("l_linenumber = 1").select("document_id", F.explode(F.array(*[F.lit(p) for p in _PHRASES])).alias("x"))
    x = F.col("x")
    forms = F.array(x, F.upper(x), F.concat(F.lit("  "), F.replace(x, F.lit(" "), F.lit("   ")), F.lit(" ")), F.concat(x, F.lit(".)")), F.concat(x, F.lit("?!")))
    raw = said.select(F.explode(forms).alias("raw"))
    return raw.select("raw", canonical_predicate(F.col("raw")).alias("relation")).groupBy("raw", "relation").agg(F.count(F.lit(1)).alias("n"))
