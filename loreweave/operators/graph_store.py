"""Knowledge graph as tables.

``entities``: one row per (user_id, name_lower). ``entity_docs``: its document set in long form.
``edges``: one row per (user_id, source_lower, target_lower, relation). ``edge_docs``: likewise.
Document sets stay in rows: the set of a hub may be as large as its tenant and must not become one value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreweave.functions.names import name_key
from loreweave.functions.vectors import Embedder, embed
from loreweave.operators.ranking import top_k
from loreweave.operators.resolution import entity_text
from loreweave.session import cut_lineage

NODE = ["user_id", "name_lower"]
EDGE = ["user_id", "source_lower", "target_lower", "relation"]

# List limits and hop bounds of the graph reads.
RECENT_LIMIT, NEIGHBOUR_LIMIT, SNAPSHOT_NODES, SNAPSHOT_LINKS = 200, 50, 500, 2000
FACTS_PER_SEED, MAX_HOPS = 12, 3
FOUND = ("distance", "other", "node", "other_type", "other_description", "chain")  # what a seed has reached, in order of rank
SPARE = 8  # entries of a neighbour list beyond those that a seed can leave out


def upsert_entities(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Merge entity observations: first non-null value of every attribute wins, last_seen moves forward.

    ``incoming``: ``NODE, name, type, description, embedding, seen_at, seq`` where ``seq`` orders writes.
    Everything is a partial aggregate, so a hot entity is combined on the map side.
    """
    attrs = ["name", "type", "description", "embedding"]
    old = current.select(
        *NODE, *attrs, "created_at", "last_seen_at", F.lit(-1).cast("long").alias("seq")
    )
    new = incoming.select(
        *NODE, *attrs, F.col("seen_at").alias("created_at"), F.col("seen_at").alias("last_seen_at"), F.col("seq").cast("long")
    )
    first = [F.min_by(a, F.when(F.col(a).isNotNull(), F.col("seq"))).alias(a) for a in attrs]
    return old.unionByName(new).groupBy(*NODE).agg(
        *first, F.min_by("created_at", "seq").alias("created_at"), F.max("last_seen_at").alias("last_seen_at")
    )


def upsert_members(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Union of document sets in long form (``keys, document_id``)."""
    columns = [*keys, "document_id"]
    return current.select(columns).unionByName(incoming.select(columns)).distinct()


def existing_ends(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges whose both endpoints exist."""
    for end in ("source_lower", "target_lower"):
        edges = edges.join(entities.select("user_id", F.col("name_lower").alias(end)), ["user_id", end], "left_semi")
    return edges


def upsert_edges(current: DataFrame, incoming: DataFrame, entities: DataFrame) -> DataFrame:
    """Merge edges by key triple; incoming edges need both endpoints. ``created_at`` is the first one.

    Incoming rows are folded before their ends are looked up, so an edge that many documents state is looked up once.
    """
    first = F.min("created_at").alias("created_at")
    new = existing_ends(incoming.groupBy(*EDGE).agg(first), entities).select(*EDGE, "created_at")
    return current.select(*EDGE, "created_at").unionByName(new).groupBy(*EDGE).agg(first)


def alias_candidates(entities: DataFrame) -> DataFrame:
    return entities.filter(F.col("name_lower").isNotNull()).select(
        *NODE, F.coalesce("type", F.lit("Concept")).alias("type")
    )


def semantic_candidates(entities: DataFrame) -> DataFrame:
    return entities.filter(F.col("name_lower").isNotNull() & F.col("embedding").isNotNull()).select(
        *NODE, F.coalesce("type", F.lit("Concept")).alias("type"), "embedding"
    )


def recent_entities(entities: DataFrame, limit: int = RECENT_LIMIT) -> DataFrame:
    """Newest entities per user; ties by key."""
    return top_k(entities, ["user_id"], [F.desc("last_seen_at"), F.asc("name_lower")], limit, salt_on=["name_lower"])


def document_lists(rows: DataFrame, entity_docs: DataFrame) -> DataFrame:
    """Document ids of listed entities, one row each."""
    return rows.join(entity_docs, NODE).select(*NODE, "document_id")


def symmetric(edges: DataFrame) -> DataFrame:
    """Both readings of every edge: ``user_id, node, other_lower, relation, direction``."""
    forth = edges.select("user_id", F.col("source_lower").alias("node"), F.col("target_lower").alias("other_lower"), "relation", F.lit("out").alias("direction"))
    back = edges.select("user_id", F.col("target_lower").alias("node"), F.col("source_lower").alias("other_lower"), "relation", F.lit("in").alias("direction"))
    return forth.unionByName(back)


def neighbours(seeds: DataFrame, entities: DataFrame, edges: DataFrame, limit: int = NEIGHBOUR_LIMIT) -> DataFrame:
    """One-hop relations of named entities (``user_id, name``) in either direction; the seed is the source."""
    start = entities.join(seeds.select("user_id", "name").distinct(), ["user_id", "name"], "left_semi").select(
        "user_id", F.col("name_lower").alias("node"), F.col("name").alias("source")
    )
    other = entities.select(
        "user_id", F.col("name_lower").alias("other_lower"), F.col("name").alias("target"),
        F.col("type").alias("target_type"), F.col("description").alias("target_description"),
    )
    rows = start.join(symmetric(edges), ["user_id", "node"]).join(other, ["user_id", "other_lower"])
    order = [F.asc("target"), F.asc("relation"), F.asc("direction"), F.asc("other_lower")]
    picked = top_k(rows, ["user_id", "node"], order, limit, salt_on=["other_lower", "relation"])
    return picked.select("user_id", "source", "target", "relation", "direction", "target_type", "target_description", "rank")


def snapshot(entities: DataFrame, edges: DataFrame, nodes: int = SNAPSHOT_NODES, links: int = SNAPSHOT_LINKS) -> tuple[DataFrame, DataFrame]:
    """Newest nodes per user and the links among them."""
    kept = recent_entities(entities, nodes)
    shown = kept.select(
        *NODE, F.col("name").alias("id"), "name", F.coalesce("type", F.lit("Concept")).alias("type"),
        F.coalesce("description", F.lit("")).alias("description"), "rank",
    )
    inside = existing_ends(edges, kept)
    names = kept.select("user_id", "name_lower", "name")
    for end in ("source", "target"):
        inside = inside.join(names.select("user_id", F.col("name_lower").alias(f"{end}_lower"), F.col("name").alias(end)), ["user_id", f"{end}_lower"])
    order = [F.asc("source_lower"), F.asc("target_lower"), F.asc("relation")]
    cut = top_k(inside, ["user_id"], order, links, salt_on=["source_lower", "target_lower"])
    return shown, cut.select("user_id", "source", "target", "relation", "rank")


def entities_of_documents(requests: DataFrame, entities: DataFrame, entity_docs: DataFrame, limit: int = RECENT_LIMIT, store: bool = False) -> DataFrame:
    """Names tagged with any document of a request (``query_id, user_id, document_id``), newest first.

    ``store`` keeps less on disk at a time for one more pass: what tells the names of a request is written before the names are looked up.
    """
    wanted = requests.select("query_id", "user_id", "document_id").distinct()
    # Shuffled by node once, for repeated rows to go and for the join with the nodes.
    hit = wanted.join(entity_docs, ["user_id", "document_id"]).select("query_id", *NODE).repartition(*NODE).distinct()
    hit = cut_lineage(hit) if store else hit
    rows = hit.join(entities.select(*NODE, "name", "last_seen_at"), NODE)
    # Many small groups: the map-side group limit is enough, slices would only add a shuffle.
    return top_k(rows, ["query_id"], [F.desc("last_seen_at"), F.asc("name_lower")], limit)


def adjacency(edges: DataFrame, entities: DataFrame, limit: int) -> DataFrame:
    """A row per node: its first ``limit`` neighbours by (name, key) in that order, ``cut`` where it has more.

    ``near`` holds ``other, node, other_type, other_description, relation``, the relation being the alphabetically first
    one. Ranks count neighbours, not edges, so edges need no fold of their own, and a hub is cut on the map side.
    """
    other = entities.select(
        "user_id", F.col("name_lower").alias("other_lower"), F.col("name").alias("other"),
        F.col("type").alias("other_type"), F.col("description").alias("other_description"),
    )
    first = Window.partitionBy("user_id", "node").orderBy("other", "other_lower")
    ranked = symmetric(edges).drop("direction").join(other, ["user_id", "other_lower"]).withColumn("_r", F.dense_rank().over(first)).filter(F.col("_r") <= limit + 1)
    item = F.struct("_r", "relation", "other", F.col("other_lower").alias("node"), "other_type", "other_description")
    lists = ranked.groupBy("user_id", "node").agg(F.array_sort(F.collect_list(item)).alias("_all"), (F.max("_r") > limit).alias("cut"))
    once = F.filter("_all", lambda x, i: (x["_r"] <= limit) & ((i == 0) | (F.get("_all", i - 1)["_r"] != x["_r"])))
    near = F.transform(once, lambda x: F.struct(*[x[c].alias(c) for c in ("other", "node", "other_type", "other_description", "relation")]))
    return lists.select("user_id", "node", "cut", near.alias("near"))


def _over_all_edges(own: DataFrame, other: DataFrame, edges: DataFrame, hops: int, per_seed: int) -> DataFrame:
    """``user_id, seed, found`` by whole hops, for the few seeds whose lists may be too short."""
    steps = cut_lineage(symmetric(edges).groupBy("user_id", "node", "other_lower").agg(F.min("relation").alias("relation")))
    frontier = own.select("user_id", "seed", "seed_name", F.col("seed").alias("node"), F.array().cast("array<string>").alias("chain"))
    reached = frontier.select("user_id", "seed", "node")
    layers = []
    for hop in range(1, hops + 1):
        wide = frontier.join(steps, ["user_id", "node"]).select(
            "user_id", "seed", "seed_name", F.col("other_lower").alias("node"), F.concat("chain", F.array("relation")).alias("chain")
        )
        first = wide.groupBy("user_id", "seed", "seed_name", "node").agg(F.min("chain").alias("chain"))
        fresh = cut_lineage(first.join(reached, ["user_id", "seed", "node"], "left_anti"))
        layers.append(fresh.join(other, ["user_id", "node"]).filter(F.col("other") != F.col("seed_name")).withColumn("distance", F.lit(hop)))
        if hop < hops:
            counts = reduce(DataFrame.unionByName, layers).groupBy("user_id", "seed").agg(F.count(F.lit(1)).alias("_n"))
            frontier = fresh.join(counts.filter(F.col("_n") >= per_seed), ["user_id", "seed"], "left_anti")
            reached = reached.unionByName(fresh.select("user_id", "seed", "node"))
    best = top_k(reduce(DataFrame.unionByName, layers), ["user_id", "seed"], [F.asc("distance"), F.asc("other"), F.asc("node")], per_seed, salt_on=["node"])
    return best.groupBy("user_id", "seed").agg(F.collect_list(F.struct(*FOUND)).alias("found"))


def entity_facts(
    seeds: DataFrame, entities: DataFrame, edges: DataFrame, hops: int = 1, per_seed: int = FACTS_PER_SEED
) -> DataFrame:
    """Nearest neighbours of every seed name with the relation chain of a shortest path.

    ``seeds``: ``user_id, name`` (case-insensitive). Output per seed: ``user_id, name_lower, name, type,
    description, relations`` – at most ``per_seed`` structs ``other, other_type, other_description,
    distance, relation_chain``, nearest first, then by name. Isolated seeds have an empty list. Among
    equally short paths the alphabetically first chain is reported.

    A seed is one row with what it has reached, and a hop adds the lists (:func:`adjacency`) of the nodes reached last. Nearer
    neighbours always rank first, so a seed that has ``per_seed`` of them is finished and takes no further hop, and an unfinished
    one has few nodes to go on from, each with a short list. A hub's degree is read once, when the lists are made. Where so many
    of a list's entries are left out that it may be too short, that seed is walked again over all edges.
    """
    if not 1 <= hops <= MAX_HOPS:
        raise ValueError(f"hops must be between 1 and {MAX_HOPS}")
    asked = seeds.select("user_id", F.lower("name").alias("_l")).distinct()
    start = entities.withColumn("_l", F.lower("name")).join(asked, ["user_id", "_l"], "left_semi").drop("_l")
    lists = cut_lineage(adjacency(edges, entities, 2 * per_seed + SPARE))
    own = start.select("user_id", F.col("name_lower").alias("seed"), F.col("name").alias("seed_name"))

    def reach(hop: int, entries: Column, chain: Column) -> Column:
        """Entries of a list as structs of FOUND."""
        return F.transform(entries, lambda x: F.struct(F.lit(hop).alias("distance"), *[x[c].alias(c) for c in FOUND[1:-1]], F.concat(chain, F.array(x["relation"])).alias("chain")))

    def named(found: Column) -> Column:
        return F.filter(found, lambda x: x["other"] != F.col("seed_name"))

    others = F.filter("near", lambda x: x["node"] != F.col("seed"))
    enough = F.size(named(others)) >= per_seed
    first = F.when(enough, F.slice(named(others), 1, per_seed)).otherwise(others)  # a finished seed keeps what it reports
    state = own.join(lists.withColumnRenamed("node", "seed"), ["user_id", "seed"]).select(
        "user_id", "seed", "seed_name", reach(1, first, F.array().cast("array<string>")).alias("found"), (F.col("cut") & ~enough).alias("short")
    )
    done = []
    for hop in range(2, hops + 1):
        state = cut_lineage(state)
        full = F.col("short") | (F.size(named(F.col("found"))) >= per_seed)
        done.append(state.filter(full))
        going = state.filter(~full)
        last = going.withColumn("at", F.explode(F.filter("found", lambda x: x["distance"] == hop - 1))).select(
            "user_id", "seed", "seed_name", F.col("at.node").alias("node"), F.col("at.chain").alias("chain"),
            F.concat(F.array("seed"), F.transform("found", lambda x: x["node"])).alias("seen"),
        )
        unseen = F.filter("near", lambda x: ~F.array_contains("seen", x["node"]))
        step = last.join(lists, ["user_id", "node"]).withColumn("new", reach(hop, unseen, F.col("chain")))
        added = step.groupBy("user_id", "seed").agg(
            F.array_sort(F.flatten(F.collect_list(F.transform("new", lambda x: F.struct(x["node"].alias("node"), x["chain"].alias("chain"), x.alias("x")))))).alias("_new"),
            F.max(F.col("cut") & (F.size(named(F.col("new"))) < per_seed)).alias("_short"),
        )
        once = F.transform(F.filter("_new", lambda x, i: (i == 0) | (F.get("_new", i - 1)["node"] != x["node"])), lambda x: x["x"])
        state = going.join(added, ["user_id", "seed"], "left").select(
            "user_id", "seed", "seed_name", F.concat("found", F.coalesce(once, F.array().cast(state.schema["found"].dataType))).alias("found"),
            F.coalesce("_short", F.lit(False)).alias("short"),
        )
    state = cut_lineage(reduce(DataFrame.unionByName, [*done, state]))
    best = state.select("user_id", "seed", "short", F.slice(F.array_sort(named(F.col("found"))), 1, per_seed).alias("found"))
    short = state.filter("short").select("user_id", "seed", "seed_name")
    if not short.isEmpty():
        other = entities.select(
            "user_id", F.col("name_lower").alias("node"), F.col("name").alias("other"),
            F.col("type").alias("other_type"), F.col("description").alias("other_description"),
        )
        again = _over_all_edges(short, other, edges, hops, per_seed).withColumn("found", F.array_sort("found"))
        best = best.filter(~F.col("short")).drop("short").unionByName(again)
    fact = lambda x, i: F.struct(
        (i + 1).alias("rank"), *[x[c].alias(c) for c in ("other", "other_type", "other_description", "distance")], x["chain"].alias("relation_chain")
    )
    rows = best.select("user_id", F.col("seed").alias("name_lower"), F.transform("found", fact).alias("relations"))
    return (
        start.join(rows, NODE, "left")
        .select(*NODE, "name", "type", "description", F.coalesce("relations", F.array().cast(rows.schema["relations"].dataType)).alias("relations"))
    )


def delete_document(
    deleted: DataFrame, entities: DataFrame, entity_docs: DataFrame, edges: DataFrame, edge_docs: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Remove documents (``user_id, document_id``) from all sets; what no document supports disappears,
    and edges go with their nodes.

    Members meet the deleted documents once. What is left of a set, and of the edges, is stored: it is read again, and what it
    was made by doesn't lie on disk until the last step.
    """
    gone = deleted.select("user_id", "document_id").distinct()

    def prune(rows: DataFrame, members: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
        left = cut_lineage(members.join(gone, ["user_id", "document_id"], "left_anti"))
        orphaned = members.select(*keys).distinct().join(left.select(*keys).distinct(), keys, "left_anti")
        return rows.join(orphaned, keys, "left_anti"), left

    nodes, node_docs = prune(entities, entity_docs, NODE)
    nodes = cut_lineage(nodes)  # read for itself and at both ends of the edges
    links, link_docs = prune(edges, edge_docs, EDGE)
    links = cut_lineage(existing_ends(links, nodes))
    return nodes, node_docs, links, link_docs.join(links.select(EDGE), EDGE, "left_semi")


def backfill_name_keys(entities: DataFrame, nfkc: bool = True) -> tuple[DataFrame, DataFrame]:
    """Fill missing name keys; entities without a usable name stay as they are. Also counts per user."""
    key = F.nullif(name_key(F.col("name"), nfkc), F.lit(""))
    filled = entities.withColumn("name_lower", F.coalesce("name_lower", key))
    counts = (
        entities.filter(F.col("name_lower").isNull()).withColumn("_k", key).filter(F.col("_k").isNotNull())
        .groupBy("user_id").agg(F.count(F.lit(1)).alias("backfilled"))
    )
    return filled, counts


def backfill_embeddings(entities: DataFrame, embedder: Embedder | None = None) -> tuple[DataFrame, DataFrame]:
    """Embed entities that have no vector yet; the model only sees those rows."""
    missing = entities.filter(F.col("embedding").isNull())
    texts = missing.drop("embedding").withColumn("_t", entity_text(F.col("name"), F.col("description")))
    filled = embed(texts, "_t", embedder, "embedding").drop("_t")
    filled = filled.withColumn("embedding", F.col("embedding").cast(entities.schema["embedding"].dataType))
    counts = missing.groupBy("user_id").agg(F.count(F.lit(1)).alias("backfilled"))
    return entities.filter(F.col("embedding").isNotNull()).unionByName(filled.select(entities.columns)), counts
