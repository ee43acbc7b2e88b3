"""Post-processing of model replies into entities and relations, and pair candidates for a second look.

Model calls stay outside: their raw replies arrive as columns. One row per chunk holds
``user_id, document_id, chunk_index, pass1_raw, pass1_failed, pass2_raw, pass2_failed``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreweave.functions.jsonrec import recover_json, reply_object
from loreweave.functions.text import let, strip
from loreweave.operators.ranking import join_text, top_k
from loreweave.session import cut_lineage

# Entity types, field limits, pair limits, snippet sizes, single-shot input limit.
ENTITY_TYPES = ("Person", "Organization", "Location", "Concept", "Technology", "Product", "Event", "Date")
NAME_LIMIT, TYPE_LIMIT, DESCRIPTION_LIMIT, RELATION_LIMIT = 200, 64, 500, 120
PAIRS_PER_DOCUMENT = 40
SNIPPETS_PER_ENTITY, SNIPPET_CHARS = 3, 500
SNIPPET_BREAK = "\n\n---\n\n"
SINGLE_SHOT_CHARS = 12_000

ENTITY = "struct<pos int, name string, type string, description string>"
RELATION = "struct<pos int, source string, target string, relation string>"
DOC = ["user_id", "document_id"]


def _items(obj: Column, name: str, fields: tuple[str, ...]) -> Column:
    """A list field with the named fields of its objects as variants; an element that is no object is null."""
    return F.try_variant_get(obj, f"$.{name}", f"array<struct<{', '.join(f'`{f}` variant' for f in fields)}>>")


def _text(v: Column) -> Column:
    """Value of a field that is a string, else null."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _within(c: Column, low: int, high: int) -> Column:
    return F.coalesce(F.length(c).between(low, high), F.lit(False))


def _entities(obj: Column) -> Column:
    return F.transform(_items(obj, "entities", ("name", "type", "description")), _entity)


def _relations(obj: Column) -> Column:
    return F.transform(_items(obj, "relationships", ("source", "target", "relation")), _relation)


def _entity(item: Column, pos: Column) -> Column:
    def check(x: Column) -> Column:
        ok = _within(x["name"], 1, NAME_LIMIT) & _within(x["type"], 0, TYPE_LIMIT) & _within(x["description"], 0, DESCRIPTION_LIMIT)
        return F.when(ok, F.struct(pos.cast("int").alias("pos"), x["name"].alias("name"), x["type"].alias("type"), x["description"].alias("description")))

    kind = F.when(item["type"].isNull(), "Concept").otherwise(_text(item["type"]))
    about = F.when(item["description"].isNull(), "").otherwise(_text(item["description"]))
    return let(F.struct(_text(item["name"]).alias("name"), kind.alias("type"), about.alias("description")), check)


def _relation(item: Column, pos: Column) -> Column:
    def check(x: Column) -> Column:
        ok = _within(x["source"], 1, NAME_LIMIT) & _within(x["target"], 1, NAME_LIMIT) & _within(x["relation"], 1, RELATION_LIMIT)
        return F.when(ok, F.struct(pos.cast("int").alias("pos"), x["source"].alias("source"), x["target"].alias("target"), x["relation"].alias("relation")))

    return let(F.struct(*[_text(item[f]).alias(f) for f in ("source", "target", "relation")]), check)


def parse_entities(obj: Column) -> Column:
    """``array<struct<pos, name, type, description>>``: valid items only, in reply order."""
    return F.coalesce(F.filter(_entities(obj), lambda e: e.isNotNull()), F.array().cast(f"array<{ENTITY}>"))


def _items_type(*fields: str) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), *[T.StructField(f, T.StringType()) for f in fields]]))


def _strings(values: list[str | None]) -> pa.Array:
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:  # half a surrogate pair has no UTF-8 form
        return pa.array([v and v.encode("utf-8", "replace").decode("utf-8") for v in values], pa.string())


def _listed(raw: pa.Array, field: str, one: tuple, two: tuple, three: tuple) -> pa.Array:
    """Valid items of a list field of every reply as structs with ``pos``, their place in that list.

    Each of the three keys comes with the least and greatest length of its text and what stands for it where it is missing (None: the item is invalid).
    """
    (a, a_low, a_high, no_a), (b, b_low, b_high, no_b), (c, c_low, c_high, no_c) = one, two, three
    ends, places, xs, ys, zs = [0], [], [], [], []
    for text in raw.to_pylist():
        found = reply_object(text) if text is not None else None
        items = found.get(field) if found else None
        for pos, item in enumerate(items if isinstance(items, list) else ()):
            if isinstance(item, dict):
                x, y, z = item.get(a, no_a), item.get(b, no_b), item.get(c, no_c)
                if (
                    isinstance(x, str) and a_low <= len(x) <= a_high and isinstance(y, str) and b_low <= len(y) <= b_high
                    and isinstance(z, str) and c_low <= len(z) <= c_high
                ):
                    places.append(pos)
                    xs.append(x)
                    ys.append(y)
                    zs.append(z)
        ends.append(len(places))
    fields = [pa.array(places, pa.int32()), _strings(xs), _strings(ys), _strings(zs)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, names=["pos", a, b, c]))


@F.arrow_udf(_items_type("name", "type", "description"))
def read_entities(raw: pa.Array) -> pa.Array:
    """:func:`parse_entities` of the replies themselves: one pass over each, at a fraction of the cost of a variant and its fields."""
    return _listed(raw, "entities", ("name", 1, NAME_LIMIT, None), ("type", 0, TYPE_LIMIT, "Concept"), ("description", 0, DESCRIPTION_LIMIT, ""))


@F.arrow_udf(_items_type("source", "target", "relation"))
def read_relations(raw: pa.Array) -> pa.Array:
    """Valid relations of replies, whatever their endpoints."""
    return _listed(raw, "relationships", ("source", 1, NAME_LIMIT, None), ("target", 1, NAME_LIMIT, None), ("relation", 1, RELATION_LIMIT, None))


def own_relations(relations: Column, entities: Column) -> Column:
    """Relations whose both endpoints are names of the chunk's own ``entities``."""

    def member(names: Column) -> Column:
        return F.filter(
            relations,
            lambda r: F.array_contains(names, F.lower(strip(r["source"]))) & F.array_contains(names, F.lower(strip(r["target"]))),
        )

    return let(F.transform(entities, lambda e: F.lower(strip(e["name"]))), member)


def chunk_results(replies: DataFrame) -> DataFrame:
    """Per-chunk outcome: ``entities, relationships, transient``.

    A failed first pass is transient and empty; an empty first pass never uses the second; a failed
    second pass keeps the entities. Replies that are not used are not read.
    """
    failed = F.coalesce("pass1_failed", F.lit(False))
    first = replies.withColumn("entities", read_entities(F.when(~failed, F.col("pass1_raw"))))
    use_second = (F.size("entities") > 0) & ~F.coalesce("pass2_failed", F.lit(False))
    second = first.withColumn("_said", read_relations(F.when(use_second, F.col("pass2_raw"))))
    own = F.when(F.size("_said") > 0, own_relations(F.col("_said"), F.col("entities"))).otherwise(F.array().cast(f"array<{RELATION}>"))
    return second.select(*DOC, "chunk_index", "entities", own.alias("relationships"), failed.alias("transient"))


def entity_rows(results: DataFrame) -> DataFrame:
    """Merged entities of all chunks in (chunk, position) order; nothing is deduplicated here."""
    return results.select(*DOC, "chunk_index", F.inline("entities"))


def relation_rows(results: DataFrame) -> DataFrame:
    return results.select(*DOC, "chunk_index", F.inline("relationships"))


def merge_results(*parts: DataFrame) -> DataFrame:
    """Bag union of partial extractions; ``part`` orders them ahead of (chunk, position)."""
    return reduce(DataFrame.unionByName, [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)])


def document_outcome(results: DataFrame) -> DataFrame:
    """A document failed transiently iff every one of its chunks did."""
    return results.groupBy(*DOC).agg(
        F.count(F.lit(1)).alias("chunks"),
        F.sum(F.size("entities")).alias("entities"),
        F.sum(F.size("relationships")).alias("relationships"),
        F.bool_and("transient").alias("transient_failure"),
    )


def normalize_extraction(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trim, first entity per case-insensitive name, closed type list; relations between kept names only,
    without self-loops and duplicates. Order columns: ``chunk_index, pos``."""
    order = F.struct("chunk_index", "pos")
    trimmed = entities.withColumn("name", strip(F.col("name"))).filter(F.col("name") != "")
    kept = (
        trimmed.groupBy(*DOC, F.lower("name").alias("name_key"))
        .agg(F.min_by(F.struct("name", "type", "description"), order).alias("e"), F.min(order).alias("o"))
        .select(
            *DOC, "name_key", "o.chunk_index", "o.pos", "e.name",
            F.when(F.col("e.type").isin(*ENTITY_TYPES), F.col("e.type")).otherwise("Concept").alias("type"),
            strip(F.col("e.description")).alias("description"),
        )
    )
    names = kept.select(*DOC, "name_key")
    rel = relations.select(
        *DOC, "chunk_index", "pos", *[strip(F.col(c)).alias(c) for c in ("source", "target", "relation")]
    )
    keys = rel.withColumn("s", F.lower("source")).withColumn("t", F.lower("target")).filter(F.col("s") != F.col("t"))
    inside = keys.join(names.withColumnRenamed("name_key", "s"), [*DOC, "s"], "left_semi").join(
        names.withColumnRenamed("name_key", "t"), [*DOC, "t"], "left_semi"
    )
    unique = (
        inside.groupBy(*DOC, "s", "t", F.lower("relation").alias("r"))
        .agg(F.min_by(F.struct("source", "target", "relation"), order).alias("x"), F.min(order).alias("o"))
        .select(*DOC, "o.chunk_index", "o.pos", "x.*")
    )
    return kept.drop("name_key"), unique


def mentions(results: DataFrame) -> DataFrame:
    """Distinct (document, chunk, entity key) with the first display name and type of the key.

    Rows are shuffled once, by document; what later counts per document needs no further shuffle.
    """
    rows = entity_rows(results).withColumn("entity", F.lower(strip(F.col("name")))).filter(F.col("entity") != "").repartition(*DOC)
    first = F.first(F.struct("name", "type")).over(Window.partitionBy(*DOC, "entity").orderBy("chunk_index", "pos"))
    return rows.select(*DOC, "entity", "chunk_index", first.alias("first")).select(*DOC, "entity", "chunk_index", "first.name", "first.type").distinct()


def _near(mentioned: DataFrame, *shown: str) -> DataFrame:
    """Pairs ``a`` < ``b`` of mentions at most three chunks apart with their ``points``; each of ``shown`` as ``…_a`` and ``…_b``.

    A chunk is a row with its entities and meets the rows before it, so a pair exists only inside the task that counts it.
    """
    cells = mentioned.groupBy(*DOC, "chunk_index").agg(F.collect_set(F.struct("entity", *shown)).alias("own"))
    before = Window.partitionBy(*DOC).orderBy("chunk_index")
    cell = F.struct("chunk_index", "own")
    others = F.array(cell, *[F.lag(cell, i).over(before) for i in range(1, 4)])
    near = cells.select(*DOC, "chunk_index", "own", others.alias("others")).select(*DOC, "chunk_index", "own", F.explode("others").alias("o"))
    gap = F.col("chunk_index") - F.col("o.chunk_index")
    points = F.when(gap == 0, 3).when(gap == 1, 2).when(gap <= 3, 1)
    near = near.select(*DOC, "own", points.alias("points"), F.col("o.own").alias("theirs")).filter(F.col("points").isNotNull())
    pairs = near.select(*DOC, "points", "theirs", F.explode("own").alias("x")).select(*DOC, "points", "x", F.explode("theirs").alias("y"))
    forth = F.col("x.entity") < F.col("y.entity")
    # Inside a chunk every pair is met in both readings, between two chunks in one.
    pairs = pairs.filter(F.when(F.col("points") == 3, forth).otherwise(F.col("x.entity") != F.col("y.entity")))
    end = lambda c, first, then: F.when(forth, F.col(f"{first}.{c}")).otherwise(F.col(f"{then}.{c}"))
    return pairs.select(
        *DOC, end("entity", "x", "y").alias("a"), end("entity", "y", "x").alias("b"), "points",
        *[c for s in shown for c in (end(s, "x", "y").alias(f"{s}_a"), end(s, "y", "x").alias(f"{s}_b"))],
    )


def cooccurrence(mentioned: DataFrame) -> DataFrame:
    """Proximity score of entity pairs of a document: gap 0 → 3, 1 → 2, 2–3 → 1, summed over chunk pairs."""
    near = _near(mentioned.select(*DOC, "entity", "chunk_index").repartition(*DOC))
    return near.groupBy(*DOC, "a", "b").agg(F.sum("points").alias("score"))


def candidate_pairs(mentioned: DataFrame, relations: DataFrame, k: int = PAIRS_PER_DOCUMENT) -> DataFrame:
    """Best ``k`` unrelated pairs per document by proximity, ties in name order."""
    return _open_pairs(mentioned.select(*DOC, "entity", "chunk_index").repartition(*DOC), relations, k)


def _open_pairs(mentioned: DataFrame, relations: DataFrame, k: int, *shown: str) -> DataFrame:
    """:func:`candidate_pairs` of mentions that lie together by document, with what is ``shown`` of both ends.

    Related pairs are counted along with the near ones, so neither is shuffled for the other.
    """
    s, t = F.lower(strip(F.col("source"))), F.lower(strip(F.col("target")))
    near = _near(mentioned, *shown).withColumn("related", F.lit(False))
    related = relations.select(*DOC, F.least(s, t).alias("a"), F.greatest(s, t).alias("b"), F.lit(True).alias("related")).repartition(*DOC)
    both = near.unionByName(related, allowMissingColumns=True)
    counted = both.groupBy(*DOC, "a", "b").agg(
        F.sum("points").alias("score"), F.bool_or("related").alias("related"), *[F.max(f"{c}_{x}").alias(f"{c}_{x}") for c in shown for x in "ab"]
    )
    return top_k(counted.filter(~F.col("related")).drop("related"), DOC, [F.desc("score"), F.asc("a"), F.asc("b")], k)


def gather_snippets(mentioned: DataFrame, chunks: DataFrame) -> DataFrame:
    """Text around each entity: its first three chunks, 500 characters each."""
    first = top_k(
        mentioned.select(*DOC, "entity", "chunk_index").distinct(), [*DOC, "entity"], [F.asc("chunk_index")],
        SNIPPETS_PER_ENTITY,
    )
    text = F.substring(strip(F.col("text")), 1, SNIPPET_CHARS)
    picked = first.join(chunks.select(*DOC, "chunk_index", text.alias("piece")), [*DOC, "chunk_index"])
    return picked.groupBy(*DOC, "entity").agg(
        join_text(F.nullif(F.col("piece"), F.lit("")), [F.col("chunk_index")], SNIPPET_BREAK).alias("snippets")
    )


@F.arrow_udf(T.StructType([T.StructField("relation", T.StringType()), T.StructField("direction", T.StringType())]))
def read_pair_reply(raw: pa.Array) -> pa.Array:
    """``relation`` and ``direction`` of the reply on a pair, where they are texts."""
    found = [reply_object(text) or {} if text is not None else {} for text in raw.to_pylist()]
    fields = [[v if isinstance(v := f.get(key), str) else None for f in found] for key in ("relation", "direction")]
    return pa.StructArray.from_arrays([_strings(x) for x in fields], names=["relation", "direction"])


def parse_reconciled(pairs: DataFrame) -> DataFrame:
    """Relations from pair replies (``name_a, name_b, raw``): blank means none, ``BA`` swaps the ends."""
    said = pairs.withColumn("_o", read_pair_reply("raw"))
    swap = F.upper(strip(F.coalesce(F.col("_o.direction"), F.lit("")))) == "BA"
    ends = said.select(
        *[c for c in pairs.columns if c not in ("raw", "name_a", "name_b")], strip(F.col("_o.relation")).alias("relation"),
        F.when(swap, F.col("name_b")).otherwise(F.col("name_a")).alias("source"), F.when(swap, F.col("name_a")).otherwise(F.col("name_b")).alias("target"),
    )
    return ends.filter(_within(F.col("relation"), 1, RELATION_LIMIT) & _within(F.col("source"), 1, NAME_LIMIT) & _within(F.col("target"), 1, NAME_LIMIT))


Extractor = Callable[[DataFrame], DataFrame]


def extract_graph(
    chunks: DataFrame, extractor: Extractor, reconciler: Extractor | None = None, k: int = PAIRS_PER_DOCUMENT
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, relations and per-document outcome for all chunks.

    ``extractor`` adds the reply columns to non-blank chunks (a UDF, or a join to a table of replies);
    ``reconciler`` adds ``raw`` to ``name_a, name_b`` pairs with their snippets.
    """
    replies = extractor(chunks.filter(strip(F.col("text")) != ""))
    # Replies are parsed once; entities, relations, mentions and the outcome all read the parsed rows.
    results = cut_lineage(chunk_results(replies))
    entities, relations = entity_rows(results), relation_rows(results)
    if reconciler is not None:
        seen = mentions(results)
        around = gather_snippets(seen, chunks)
        side = lambda x: around.select(*DOC, F.col("entity").alias(x), F.col("snippets").alias(f"snippets_{x}"))
        pairs = _open_pairs(seen, relations, k, "name").join(side("a"), [*DOC, "a"], "left").join(side("b"), [*DOC, "b"], "left")
        # What the reconciler has said is stored, so that it is asked once; snippets, names and raw replies are not.
        found = parse_reconciled(reconciler(pairs).select(*DOC, "rank", "name_a", "name_b", "raw"))
        last = F.lit(2**31 - 1)
        relations = relations.unionByName(
            cut_lineage(found.select(*DOC, last.alias("chunk_index"), F.col("rank").alias("pos"), "source", "target", "relation"))
        )
    return entities, relations, document_outcome(results)


def single_shot_input(texts: DataFrame) -> DataFrame:
    """Whole-document prompt text, cut at 12,000 characters."""
    return texts.withColumn("text", F.substring("text", 1, SINGLE_SHOT_CHARS))


def single_shot(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One reply per document (``raw``): any invalid item voids the reply; the rest is normalised."""
    obj = F.col("_o")

    def all_valid(field: str, made: Column) -> Column:
        absent = F.schema_of_variant(F.try_variant_get(obj, f"$.{field}", "variant")).isNull()
        valid = F.forall(made, lambda e: e.isNotNull())
        return absent | F.coalesce(valid, F.lit(False))

    read = recover_json(replies, "raw", "_o").filter(obj.isNotNull())
    good = read.filter(all_valid("entities", _entities(obj)) & all_valid("relationships", _relations(obj)))
    zero = F.lit(0).alias("chunk_index")
    entities = good.select(*DOC, zero, F.inline(parse_entities(obj)))
    made = _relations(obj)
    relations = good.select(*DOC, zero, F.inline(F.coalesce(made, F.array().cast(f"array<{RELATION}>"))))
    return normalize_extraction(entities, relations)
